"""From requests and captured responses to strictly decoded HTML documents."""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from email.message import Message

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articlelake.functions.batches import in_slices
from articlelake.functions.text import is_blank, strip
from articlelake.operators.choice import first_rows
from articlelake.operators.joins import skewed_left_join

# Accepted media types, and charset labels decoded on the JVM with the
# codec name that the document reports.
HTML_TYPES = ("text/html", "application/xhtml+xml")
NATIVE_CHARSETS = {
    "": "utf-8",
    "utf-8": "utf-8",
    "utf8": "utf-8",
    "ascii": "ascii",
    "us-ascii": "ascii",
    "iso-8859-1": "iso8859-1",
    "iso8859-1": "iso8859-1",
    "latin-1": "iso8859-1",
    "latin1": "iso8859-1",
}

# Headers with quoting, comments or continuations go to the e-mail header parser.
_INTRICATE = r"[\"*\\<>(),]|[^\x20-\x7e]"
_QUOTED_CHARSET = r'(?i)charset="([a-z0-9_.:\-]*)"'
_CHARSET = r"(?i)(?:\A|;)\s*charset\s*(?:=\s*([^;]*?))?\s*(?:;|\z)"

_DECODED = T.StructType(
    [T.StructField("encoding", T.StringType()), T.StructField("content", T.StringType())]
)


def normalize_requests(requests: DataFrame) -> DataFrame:
    """Upper-case methods and add ``request_reason`` for blank URLs."""
    blank = F.coalesce(is_blank(F.col("url")), F.lit(True))
    return requests.withColumn("method", F.upper(strip(F.col("method")))).withColumn(
        "request_reason", F.when(blank, F.lit("request_url_blank"))
    )


def attach_responses(
    requests: DataFrame, responses: DataFrame, *, hot: DataFrame | None = None
) -> DataFrame:
    """Each request with its captured response (nulls when there is none).

    ``responses`` holds one row per ``request_url``; see ``first_responses``. ``hot``
    lists the URLs that very many requests repeat (``joins.hot_keys``); they are salted.
    """
    right = responses.select(
        F.col("request_url").alias("url"),
        "final_url",
        "status_code",
        F.col("headers").alias("response_headers"),
        F.col("body").alias("response_body"),
        F.coalesce("elapsed", F.lit(0.0)).alias("elapsed"),
    )
    return skewed_left_join(requests, right, "url", spread="position", hot=hot)


def first_responses(responses: DataFrame, *, in_files: bool = False) -> DataFrame:
    """The earliest capture of every ``request_url``, chosen without touching the bodies.

    Ties in time go by status, final URL and elapsed time, then by the place in the files.
    ``in_files``: ``responses`` is a scan of files (``tables.read_table``); see
    ``choice.first_rows``.
    """
    order = {name: F.col(name) for name in ("fetched_at", "status_code", "final_url", "elapsed")}
    chosen = first_rows(responses, "request_url", order, in_files=in_files)
    return chosen.select("request_url", *[name for name in responses.columns if name not in ("request_url", "metadata")])


def content_type(headers: Column) -> Column:
    """Value of the first header named content-type, in any letter case."""
    named = F.filter(
        F.map_entries(headers), lambda entry: F.lower(entry["key"]) == "content-type"
    )
    return F.try_element_at(named, F.lit(1))["value"]


def media_type(header: Column) -> Column:
    """Lower-case type before the first ';'; text/plain unless it holds one '/'."""
    kind = F.lower(strip(F.substring_index(header, ";", 1)))
    slashes = F.length(kind) - F.length(F.replace(kind, F.lit("/"), F.lit("")))
    return F.when(slashes == 1, kind).otherwise(F.when(header.isNotNull(), F.lit("text/plain")))


def media_reason(header: Column) -> Column:
    return F.when(header.isNull(), F.lit("content_type_missing")).when(
        ~media_type(header).isin(*HTML_TYPES), F.lit("content_type_unsupported")
    )


def is_success(status: Column) -> Column:
    return F.coalesce(status.between(200, 299), F.lit(False))


@F.arrow_udf(_DECODED)
def _decode_rare(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Charset lookup and strict decode for labels the JVM does not decode."""

    def decode(header: str | None, body: bytes | None) -> dict[str, str] | None:
        if header is None:
            return None
        message = Message()
        message["Content-Type"] = header
        try:
            encoding = codecs.lookup(message.get_content_charset() or "utf-8").name
            content = (body or b"").decode(encoding, errors="strict")
            content.encode("utf-8")
        except (LookupError, UnicodeError):
            return None
        return {"encoding": encoding, "content": content}

    kind = pa.struct([("encoding", pa.string()), ("content", pa.string())])
    for headers, bodies in batches:
        yield from in_slices(decode, kind, headers, bodies)
        del headers, bodies  # before the next batch is read


def decode_documents(frame: DataFrame, header: str, body: str, accepted: Column) -> DataFrame:
    """Add ``encoding`` and ``content``; both stay null when strict decoding fails.

    UTF-8, ASCII and Latin-1 are decoded on the JVM. Only rows with another charset, or
    an intricate header, hand their bytes to Python; all others pass it as null. Rows
    that are not ``accepted`` are not decoded.
    """
    simple = F.regexp_replace(F.col(header), _QUOTED_CHARSET, "charset=$1")
    label = F.lower(F.regexp_extract(simple, _CHARSET, 1))
    names = F.create_map(*[F.lit(part) for pair in NATIVE_CHARSETS.items() for part in pair])
    staged = frame.withColumn("_accepted", F.coalesce(accepted, F.lit(False))).withColumn(
        "_native",
        F.when(
            F.col("_accepted") & ~simple.rlike(_INTRICATE), F.try_element_at(names, label)
        ),
    )
    raw = F.coalesce(F.col(body), F.lit(b""))
    text = raw.cast("string")
    native = F.col("_native")
    content = (
        F.when((native == "utf-8") & F.is_valid_utf8(text), text)
        .when((native == "ascii") & (F.length(text) == F.octet_length(raw)) & F.is_valid_utf8(text), text)
        .when(native == "iso8859-1", F.decode(raw, "ISO-8859-1"))
    )
    rare = F.col("_accepted") & native.isNull()
    decoded = staged.withColumn(
        "_rare", _decode_rare(F.when(rare, F.col(header)), F.when(rare, F.col(body)))
    ).withColumn("content", F.coalesce(content, F.col("_rare.content")))
    return decoded.withColumn(
        "encoding",
        F.when(F.col("content").isNotNull(), F.coalesce(native, F.col("_rare.encoding"))),
    ).drop("_accepted", "_native", "_rare")


def document_reason() -> Column:
    """Contract of a decoded document (an empty body is fine)."""
    bad = is_blank(F.col("final_url")) | is_blank(F.col("encoding")) | (F.col("status_code") <= 0)
    return F.when(F.coalesce(bad, F.lit(True)), F.lit("document_invalid"))
