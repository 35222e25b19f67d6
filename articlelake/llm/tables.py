"""Reading the given tables, settling columns, and sizes of parallel work."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from articlelake.session import prepare, stored

__all__ = ["map_rows", "prepare", "prefix_sums", "read", "stored", "text_or_empty"]


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def map_rows(
    frame: DataFrame,
    start: Callable[[], Callable[..., Iterable[tuple]]],
    schema: str,
    flush_bytes: int = 4 << 20,
) -> DataFrame:
    """Run a row function over Arrow batches of each partition.

    ``start`` is called once per task and returns the function; it gets the values of a row
    and yields output tuples. Output is cut into batches of about ``flush_bytes``, so long
    values do not pile up. If the function has an attribute ``finish``, it is called after
    the last row and yields the rest.
    """
    arrow = _arrow_schema(frame.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = start()
        rows: list[tuple] = []
        size = 0

        def cut() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[] for _ in arrow]
            arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for row in function(*values):
                    rows.append(row)
                    size += 64 + sum(len(v) for v in row if isinstance(v, (bytes, str, list)))
                    if size >= flush_bytes:
                        yield cut()
                        rows, size = [], 0
        for row in getattr(function, "finish", tuple)():
            rows.append(row)
            size += 64 + sum(len(v) for v in row if isinstance(v, (bytes, str, list)))
            if size >= flush_bytes:
                yield cut()
                rows, size = [], 0
        yield cut()

    return frame.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def prefix_sums(frame: DataFrame, part: str, size: str, out: str) -> DataFrame:
    """The sum of ``size`` in all parts before each part.

    One row goes in per part. Parts number as many as tasks, not rows, so ordering them in
    one window is cheap.
    """
    from pyspark.sql import Window

    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = frame.groupBy(part).agg(F.sum(size).alias("_size"))
    return sums.select(part, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias(out))
