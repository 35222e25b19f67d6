"""User-supplied parsers: any number of items per document, at most one failure."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articlelake.operators.articles import build_articles
from articlelake.operators.profiles import ARTICLE_FAMILY

# The parser families that profiles may name, and the operator that builds their items.
FAMILIES = {ARTICLE_FAMILY: build_articles}

_FLUSH_ROWS, _FLUSH_BYTES = 1024, 4 << 20
_CONTRACT, _EXECUTION = "parser_contract", "parser_execution"


def build_items(
    frame: DataFrame, families: Mapping[str, Callable[[DataFrame], DataFrame]] = FAMILIES
) -> DataFrame:
    """Add ``article`` and ``article_reason`` by the operator of each row's family."""
    found: dict[str, list] = {"article": [], "article_reason": []}
    for number, (family, build) in enumerate(families.items()):
        frame = build(frame)
        for name, values in found.items():
            frame = frame.withColumnRenamed(name, f"_{name}_{number}")
            values.append(F.when(F.col("parser_family") == family, F.col(f"_{name}_{number}")))
    built = frame.withColumns({name: F.coalesce(*values) for name, values in found.items()})
    return built.drop(*[f"_{name}_{number}" for name in found for number in range(len(families))])


class DocumentRejected(Exception):
    """Raised by a user parser to refuse a document with its own reason code."""

    def __init__(self, reason_code: str) -> None:
        super().__init__(reason_code)
        self.reason_code = reason_code


def parse_rows(
    frame: DataFrame,
    parse: Callable[[dict], Iterable[Mapping[str, object]]],
    item_schema: T.StructType,
    *,
    key: str,
    inputs: list[str],
    failure: str = _EXECUTION,
) -> DataFrame:
    """Run ``parse`` on every row and return ``key, item_pos, item, reason_code``.

    ``parse`` gets a dict of the ``inputs`` columns and yields items lazily. Each item
    must be a mapping that fits ``item_schema``, else the row ends with
    ``parser_contract``. ``DocumentRejected`` ends it with its own code and any other
    error with ``failure``. Items yielded before the failure are kept. Output is flushed
    in small batches, so that a document with very many items stays small in memory.
    """
    columns = list(dict.fromkeys([key, *inputs]))
    schema = _output_schema(key, frame.select(key).schema[0].dataType, item_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        pending: list[tuple] = []
        size = 0
        for batch in batches:
            for row in range(batch.num_rows):
                values = {name: batch.column(name)[row].as_py(maps_as_pydicts="lossy") for name in columns}
                given = {name: values[name] for name in inputs}
                for output in _outputs(parse, values[key], given, failure):
                    pending.append(output)
                    size += _size(output[2])
                    if len(pending) >= _FLUSH_ROWS or size >= _FLUSH_BYTES:
                        rows, refused = _fitting(pending, target)
                        yield _batch(rows, target)
                        pending, size = [], 0
                        if refused:
                            break
        if pending:
            yield _batch(_fitting(pending, target)[0], target)

    return frame.select(*columns).mapInArrow(run, schema)


def register_parser(
    spark: SparkSession,
    name: str,
    parse: Callable[[dict], Iterable[Mapping[str, object]]],
    item_schema: T.StructType,
    *,
    key: str,
    key_type: T.DataType,
    inputs: Iterable[str],
    failure: str = _EXECUTION,
) -> None:
    """Make ``parse`` the SQL table function ``name``, with the output and rules of ``parse_rows``.

    A table argument, partitioned or not, has its columns read by name, and a column that it
    lacks is null: ``SELECT * FROM name(TABLE(documents))``. In ``LATERAL name(...)`` the
    arguments are the key and then the ``inputs``; those left out at the end are null. Each
    row is parsed by itself, so a partitioned argument only decides where.
    """
    inputs = list(inputs)
    schema = _output_schema(key, key_type, item_schema)

    class Parser:
        def eval(self, *given):
            if len(given) == 1 and isinstance(given[0], Row):
                row = given[0].asDict()
                row_key, values = row[key], {field: row.get(field) for field in inputs}
            else:
                row_key, others = given[0], list(given[1:])
                values = dict(zip(inputs, others + [None] * (len(inputs) - len(others)), strict=True))
            for output in _outputs(parse, row_key, values, failure):
                kept, refused = _fitting([output], self.target)
                yield from kept
                if refused:
                    return

        def __init__(self):
            from pyspark.sql.pandas.types import to_arrow_schema

            self.target = to_arrow_schema(schema)

    spark.udtf.register(name, F.udtf(Parser, returnType=schema))


def _output_schema(key: str, key_type: T.DataType, item_schema: T.StructType) -> T.StructType:
    return T.StructType(
        [
            T.StructField(key, key_type),
            T.StructField("item_pos", T.IntegerType()),
            T.StructField("item", item_schema),
            T.StructField("reason_code", T.StringType()),
        ]
    )


def _outputs(parse: Callable, key: object, given: dict, failure: str) -> Iterator[tuple]:
    """The rows of one document: its items, and a last row with the reason if it failed."""
    position = 0
    try:
        for item in parse(given):
            if not isinstance(item, Mapping):
                raise DocumentRejected(_CONTRACT)
            yield key, position, dict(item), None
            position += 1
    except DocumentRejected as refused:
        yield key, position, None, refused.reason_code
    except Exception:
        yield key, position, None, failure


def _size(item: dict | None) -> int:
    return 64 + sum(len(v) for v in (item or {}).values() if isinstance(v, (str, bytes)))


def _fitting(rows: list[tuple], target: pa.Schema) -> tuple[list[tuple], bool]:
    """Rows whose items fit the schema, and whether the last document was refused.

    Items are tried all at once; only if one does not fit are they tried one by one. The
    first such item ends its document, whose outputs begin at position 0.
    """

    def fits(items: list) -> bool:
        try:
            pa.array(items, target.field("item").type)
        except (pa.ArrowException, TypeError, ValueError, OverflowError):
            return False
        return True

    if fits([row[2] for row in rows]):
        return rows, False
    kept: list[tuple] = []
    refused = False
    for key, position, item, reason in rows:
        refused = refused and position > 0
        if not refused:
            refused = not fits([item])
            kept.append((key, position, None, _CONTRACT) if refused else (key, position, item, reason))
    return kept, refused


def _batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    arrays = [
        pa.array(list(values), field.type)
        for values, field in zip(zip(*rows, strict=True), target, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=target)


#: What a parser of documents, and one of raw responses, is given of each row.
DOCUMENT_FIELDS = ("requested_url", "final_url", "status_code", "headers", "content", "encoding", "metadata")
RESPONSE_FIELDS = ("url", "final_url", "status_code", "headers", "response_body", "elapsed", "metadata")


def _inputs(frame: DataFrame, fields: tuple[str, ...], renamed: Mapping[str, str]) -> DataFrame:
    """``frame`` with the fields under their names; a field that is not there is null."""
    given = frame.withColumns(
        {name: F.col(other) for name, other in renamed.items() if name not in frame.columns and other in frame.columns}
    )
    return given.withColumns({name: F.lit(None).cast("string") for name in fields if name not in given.columns})


def parse_documents(frame: DataFrame, parse, item_schema: T.StructType, *, key: str) -> DataFrame:
    """``parse_rows`` over decoded documents; ``parse`` gets the DOCUMENT_FIELDS.

    ``frame`` may come from ``crawl.decode``, whose url and response_headers are taken.
    """
    if "response_headers" in frame.columns:
        frame = frame.drop("headers")
    given = _inputs(frame, DOCUMENT_FIELDS, {"requested_url": "url", "headers": "response_headers"})
    return parse_rows(given, parse, item_schema, key=key, inputs=list(DOCUMENT_FIELDS))


def parse_responses(frame: DataFrame, parse, item_schema: T.StructType, *, key: str) -> DataFrame:
    """``parse_rows`` over raw responses; ``parse`` gets the RESPONSE_FIELDS.

    Frames of ``capture.attach_responses`` fit, and so do bare response tables.
    """
    # Requests have headers too; those of the response count.
    if "response_headers" in frame.columns:
        frame = frame.drop("headers")
    given = _inputs(frame, RESPONSE_FIELDS, {"url": "request_url", "headers": "response_headers", "response_body": "body"})
    return parse_rows(given, parse, item_schema, key=key, inputs=list(RESPONSE_FIELDS))
