"""Readers and writers. Captures arrive as files; nothing here opens a connection."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articlelake.sources import schemas

# The profiles approved for production.
DEFAULT_PROFILES = (
    ("cnn_indonesia", ["www.cnnindonesia.com"], "jsonld_article", None, True, 0),
    (
        "kompas",
        ["www.kompas.com", "nasional.kompas.com", "surabaya.kompas.com"],
        "jsonld_article",
        None,
        False,
        1,
    ),
)


def request_list(
    spark: SparkSession, urls: Iterable[str], metadata: Mapping[str, str] | None = None
) -> DataFrame:
    """One GET request per URL in the given order, with shared metadata.

    A blank URL refuses the whole list. For URL tables use ``requests_from``.
    """
    numbered = [(position, str(url)) for position, url in enumerate(urls)]
    blank = [position for position, url in numbered if not url or url.isspace()]
    if blank:
        raise ValueError(f"blank URL at position {blank[0]}")
    rows = spark.createDataFrame(numbered, "position bigint, url string")
    return requests_from(rows, metadata)


def requests_from(frame: DataFrame, metadata: Mapping[str, str] | None = None) -> DataFrame:
    """Requests from a table with ``position`` and ``url``; other columns get defaults."""
    shared = [part for pair in (metadata or {}).items() for part in map(F.lit, pair)]
    empty = F.create_map().cast("map<string,string>")
    defaults = {
        "method": F.lit("GET"),
        "headers": empty,
        "query_params": empty,
        "body": F.lit(None).cast("binary"),
        "metadata": F.create_map(*shared) if shared else empty,
    }
    added = {name: value for name, value in defaults.items() if name not in frame.columns}
    return frame.withColumns(added)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet scan with a fixed schema from ``schemas``."""
    return spark.read.schema(schema).parquet(path)


def stream_table(spark: SparkSession, folder: str, schema: str, **options: str) -> DataFrame:
    """The same scan over a landing folder, as a stream."""
    return spark.readStream.schema(schema).options(**options).parquet(folder)


def read_raw_dumps(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Page bodies stored as plain files: path, modification time and bytes."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .load(folder)
        .select("path", F.col("modificationTime").alias("fetched_at"), F.col("content").alias("body"))
    )


def default_profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEFAULT_PROFILES), schemas.PROFILES)


def write_raw(documents: DataFrame, path: str, mode: str = "append") -> None:
    """Raw captures, in a folder per day where they have a time (see ``read_captures``)."""
    if "fetched_at" not in documents.columns:
        documents.write.mode(mode).parquet(path)
        return
    dated = documents.withColumn("capture_date", F.to_date("fetched_at"))
    _partitioned(dated, "capture_date", path, mode)


def read_captures(spark: SparkSession, path: str, schema: str, first: str, last: str) -> DataFrame:
    """Captures of the days ``first`` to ``last`` (ISO dates); other folders are not read."""
    dated = spark.read.schema(f"{schema}, capture_date date").parquet(path)
    return dated.where(F.col("capture_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def _partitioned(frame: DataFrame, part: str, path: str, mode: str) -> None:
    """Rows meet by partition before they are written; a large one is split by its size."""
    frame.hint("rebalance", F.col(part)).write.mode(mode).partitionBy(part).parquet(path)


def write_ordered(rows: DataFrame, path: str, key: str, parts: int | None = None) -> None:
    """Rows in the order of ``key``, without one sorted file: ordered parts and a manifest.

    Rows are range-partitioned by ``key`` (unique, not null), and each part is one folder,
    sorted inside. The manifest holds a row per part: its number, bounds and rows, and the
    rows of all parts before it. An empty table gives an empty manifest.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, key).withColumn("part", F.spark_partition_id())
    ranged.sortWithinPartitions("part", key).write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    # The columns, for an export without rows.
    rows.limit(0).write.mode("overwrite").parquet(f"{path}/columns")
    written = _ordered_parts(rows.sparkSession, path)
    bounds = written.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    numbered = bounds.withColumn("rows_before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    numbered.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def _ordered_parts(spark: SparkSession, path: str) -> DataFrame:
    columns = spark.read.parquet(f"{path}/columns").schema.fields
    schema = T.StructType([*columns, T.StructField("part", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{path}/rows")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


def read_ordered(
    spark: SparkSession, path: str, key: str, first: object = None, last: object = None
) -> DataFrame:
    """An ordered export with ``line``, the place of each row in the whole order, from 1.

    Only parts whose bounds meet ``first`` to ``last`` are read; their numbers, one per part,
    come from the manifest. No exchange orders the parts: each is numbered by itself and
    moved up by the rows before it.
    """
    manifest = read_manifest(spark, path)
    bounded = manifest
    within = F.lit(True)
    if first is not None:
        bounded, within = bounded.where(F.col("last") >= F.lit(first)), within & (F.col(key) >= F.lit(first))
    if last is not None:
        bounded, within = bounded.where(F.col("first") <= F.lit(last)), within & (F.col(key) <= F.lit(last))
    wanted = [row["part"] for row in bounded.select("part").collect()]
    rows = _ordered_parts(spark, path).where(F.col("part").isin(wanted) if wanted else F.lit(False))
    placed = rows.join(F.broadcast(manifest.select("part", "rows_before")), "part")
    line = F.row_number().over(Window.partitionBy("part").orderBy(key)) + F.col("rows_before")
    return placed.withColumn("line", line).where(within).drop("rows_before")


def write_articles(articles: DataFrame, path: str, mode: str = "append") -> None:
    """Articles by source."""
    _partitioned(articles, "source", path, mode)


def write_failed(failed: DataFrame, path: str, mode: str = "append") -> None:
    _partitioned(failed, "reason_code", path, mode)
