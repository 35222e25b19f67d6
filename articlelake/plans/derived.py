"""Inputs that the registered queries derive from the given tables.

The given pages hold no article metadata, so captures are written from the documents:
each document becomes one page that carries its whole text, in one of sixteen shapes.
Nothing here is part of the library proper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from articlelake.functions.staging import once
from articlelake.operators.profiles import ARTICLE_FAMILY

AGENT = "Example-Agent/1.0 (+https://agent.example/about)"
SHAPES = 16


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    """The same for tables of long texts, dealt out by key: one row group may be one task."""
    return table(spark, folder, name).repartition(F.col(key))


def landing_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The same as a stream, whether the table is one file or a folder of part files.

    A pattern is needed: a stream takes a plain path for a folder, and a filter on names
    would be applied to part files.
    """
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{name}}}.parquet")


def page_hosts(spark: SparkSession, folder: str) -> DataFrame:
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    return table(spark, folder, "pages").select(host.alias("host")).distinct()


def page_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """One profile per page host, with a repeated and an extra domain."""
    host = F.col("host")
    return page_hosts(spark, folder).select(
        F.concat(F.lit("s"), F.substring(F.md5("host"), 1, 12)).alias("source"),
        F.array(host, F.concat(F.upper(host), F.lit(".")), F.concat(F.lit("alt."), host)).alias(
            "domains"
        ),
        F.lit(ARTICLE_FAMILY).alias("parser_family"),
        F.when(F.length(host) % 5 == 0, F.lit("custom")).alias("adapter_key"),
        (F.length(host) % 3 != 0).alias("enabled"),
        F.crc32(host).alias("position"),
    )


def document_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """One profile per document source, with two hosts."""
    source = F.col("source")
    return (
        table(spark, folder, "documents")
        .select("source")
        .distinct()
        .select(
            "source",
            F.array(
                F.concat(F.lit("www."), source, F.lit(".example")),
                F.concat(F.lit("m."), source, F.lit(".example")),
            ).alias("domains"),
            F.lit(ARTICLE_FAMILY).alias("parser_family"),
            F.lit(None).cast("string").alias("adapter_key"),
            F.lit(True).alias("enabled"),
            F.crc32(source).alias("position"),
        )
    )


def document_robots(spark: SparkSession, folder: str) -> DataFrame:
    """One robots file per document host; one language folder is closed on each."""
    files = F.lit("User-agent: *\nDisallow: /closed/\nAllow: /")
    return document_profiles(spark, folder).select(
        F.concat(F.lit("https://"), F.col("domains")[0]).alias("origin"),
        F.lit(200).alias("status_code"),
        F.encode(files, "UTF-8").alias("body"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("fetched_at"),
    )


def page_robots(spark: SparkSession, folder: str) -> DataFrame:
    """Two captures per page origin: a later one that must lose, and the first one."""
    origin = F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1)
    origins = table(spark, folder, "pages").select(origin.alias("origin")).distinct()
    kind = F.length("origin") % 5
    status = F.when(kind == 0, 404).when(kind == 1, 403).when(kind == 4, 500).otherwise(200)
    body = F.when(
        kind == 2, F.lit("User-agent: *\nDisallow: /en/\nAllow: /\n")
    ).otherwise(
        F.lit(
            "User-agent: *\nDisallow: /\n\n# for one agent\nUser-Agent: example-agent\n"
            "Allow: /de/\nDisallow: /%64e\nDisallow: /es/ # closed\nDisallow: /*?page\n"
        )
    )
    first = origins.select(
        "origin",
        status.alias("status_code"),
        F.encode(body, "UTF-8").alias("body"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("fetched_at"),
    )
    later = first.select(
        "origin",
        "status_code",
        F.encode(F.lit("User-agent: *\nDisallow: /"), "UTF-8").alias("body"),
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("fetched_at"),
    )
    return first.unionByName(later)


def flat_text(text: Column) -> Column:
    """Control characters and runs of blanks as one blank."""
    return F.trim(F.regexp_replace(text, r"[\x00-\x20\x7f]+", " "))


def _json(value: Column) -> Column:
    """A string as a JSON literal that cannot close the script element around it."""
    listed = F.to_json(F.array(value))
    return F.replace(
        F.substr(listed, F.lit(2), F.length(listed) - 2), F.lit("<"), F.lit("\\u003c")
    )


def _attribute(value: Column) -> Column:
    escaped = F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    return F.replace(escaped, F.lit("<"), F.lit("&lt;"))


def _field(name: str, literal: Column) -> Column:
    """``"name": literal,`` or nothing when the literal is null."""
    return F.coalesce(F.concat(F.lit(f'"{name}":'), literal, F.lit(",")), F.lit(""))


def _meta(name: str, value: Column, attribute: str = "property") -> Column:
    tag = F.concat(F.lit(f'<meta {attribute}="{name}" content="'), _attribute(value), F.lit('">'))
    return F.coalesce(tag, F.lit(""))


def _script(block: Column) -> Column:
    return F.concat(F.lit('<script type="application/ld+json">'), block, F.lit("</script>"))


def page_url() -> Column:
    """The URL of a document's page; every 25th lies in the closed folder."""
    folder = F.when(F.col("doc_id") % 25 == 24, F.lit("closed/")).otherwise(F.lit("r/"))
    return F.concat(
        F.lit("https://www."), F.col("source"), F.lit(".example/"), folder, F.col("doc_id").cast("string")
    )


def captures(documents: DataFrame) -> DataFrame:
    """One captured page per document, shaped by ``doc_id % 16``."""
    # Long texts are settled step by step, so that each is made once.
    documents = once(documents.withColumn("_flat", flat_text(F.col("text"))), "_flat")
    shape, doc = F.col("doc_id") % SHAPES, F.col("doc_id").cast("string")
    site = F.concat(F.lit("https://www."), F.col("source"), F.lit(".example/"))
    canonical = F.concat(site, F.lit("a/"), doc)
    flat = F.col("_flat")
    title = F.concat(F.lit("No. "), doc, F.lit(": "), F.left(flat, F.lit(60)))
    instant = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 61)
    fraction = F.when(F.col("doc_id") % 3 == 0, F.lit(".25")).otherwise(F.lit(""))

    def local(pattern: str, hours: int) -> Column:
        return F.concat(
            F.date_format(instant + F.expr(f"interval {hours} hours"), pattern), fraction
        )

    published = (
        F.when(shape == 12, local("yyyy-MM-dd'T'HH:mm:ss", 0))
        .when(shape == 15, F.concat(local("yyyyMMdd'T'HHmmss", 0), F.lit("Z")))
        .otherwise(F.concat(local("yyyy-MM-dd'T'HH:mm:ss", 7), F.lit("+07:00")))
    )
    authors = (
        F.when(
            shape == 15,
            F.lit('[{"name":" Ann Lee "},{"url":"x"},42,"Ann Lee",{"name":"Bo <i>"},"  "]'),
        )
        .when(F.col("doc_id") % 3 == 1, _json(F.concat(F.lit("Desk "), F.col("source"))))
        .when(F.col("doc_id") % 3 == 2, F.lit('{"@type":"Person","name":"Ann Lee"}'))
    )
    image = (
        F.when(shape == 14, F.lit('"https://10.0.0.1/x.jpg"'))
        .when(shape == 0, F.concat(F.lit('["http://img.example.org/x.jpg",{"url":"https://img.example.org/'), doc, F.lit('.jpg"}]')))
        .when(shape == 1, F.concat(F.lit('{"contentUrl":"https://img.example.org/'), doc, F.lit('.jpg"}')))
    )
    identity = F.when(shape == 9, F.concat(site, F.lit("other"))).otherwise(canonical)
    kind = (
        F.when(shape == 1, F.lit('"Article"'))
        .when(shape == 15, F.lit('["Thing","NewsArticle"]'))
        .otherwise(F.lit('"NewsArticle"'))
    )
    description = F.when(shape == 13, F.col("text")).otherwise(flat)
    node = F.concat(
        F.lit('{"@type":'), kind, F.lit(","),
        _field("mainEntityOfPage", F.concat(F.lit('{"@id":'), _json(identity), F.lit("}"))),
        _field("headline", F.when(~shape.isin(3, 11), _json(title))),
        _field("datePublished", _json(published)),
        _field("dateModified", F.when(shape == 2, _json(F.lit("2024-06-01T00:00:00-02:30")))),
        _field("description", _json(description)),
        _field("author", authors),
        _field("image", image),
        _field("articleSection", F.when(F.col("n_chars") % 4 > 0, _json(F.concat(F.lit(" Part "), (F.col("n_chars") % 4).cast("string"))))),
        _field("inLanguage", F.when(shape == 15, F.lit('"EN-us"')).when(shape != 4, _json(F.col("lang")))),
        F.lit('"publisher":{"name":"Not an author"}}'),
    )
    noded = once(documents.withColumn("_node_json", node), "_node_json")
    node = F.col("_node_json")
    other = F.concat(
        F.lit('{"@type":"Article","url":'), _json(F.concat(site, F.lit("other"))),
        F.lit(',"headline":"Other"}'),
    )
    blocks = (
        F.when(shape == 2, _script(F.concat(F.lit('{"@graph":['), other, F.lit(","), node, F.lit("]}"))))
        .when(shape == 6, F.concat(_script(F.lit('{"broken":')), _script(node)))
        .when(shape == 7, F.lit(""))
        .when(shape == 8, F.concat(_script(node), _script(node)))
        .otherwise(_script(node))
    )
    link = F.when(shape == 10, F.lit("https://foreign.example/a")).otherwise(canonical)
    html = F.concat(
        F.lit('<!DOCTYPE html><html lang="'), F.col("lang"), F.lit('"><head><meta charset="utf-8">'),
        F.when(~shape.isin(4, 5), F.concat(F.lit('<link rel="alternate canonical" href="'), link, F.lit('">'))).otherwise(F.lit("")),
        F.coalesce(_meta("og:url", F.when(shape == 4, canonical)), F.lit("")),
        _meta("og:title", F.when(shape == 3, title)),
        blocks,
        F.lit("</head><body><p>"), _attribute(F.col("text")), F.lit("</p></body></html>"),
    )
    return noded.select(
        F.col("doc_id").alias("position"),
        page_url().alias("url"),
        canonical.alias("final_url"),
        F.lit(200).alias("status_code"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8")).alias("response_headers"),
        F.encode(html, "UTF-8").alias("response_body"),
    )


def head_captures(documents: DataFrame) -> DataFrame:
    """One captured page per document whose fields stand in its head, by ``doc_id % 8``.

    The JSON-LD node has a headline, and values that cannot be used where the head must
    step in. Every ninth page has no usable time anywhere.
    """
    documents = once(documents.withColumn("_flat", flat_text(F.col("text"))), "_flat")
    shape, doc, flat = F.col("doc_id") % 8, F.col("doc_id").cast("string"), F.col("_flat")
    canonical = F.concat(F.lit("https://www."), F.col("source"), F.lit(".example/h/"), doc)
    time = F.concat(F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 61), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    picture = F.concat(F.lit("https://img.example.org/h/"), doc, F.lit(".jpg"))
    node = F.concat(
        F.lit('{"@type":"NewsArticle",'),
        _field("mainEntityOfPage", _json(canonical)),
        _field("datePublished", F.when(shape == 7, F.lit('"yesterday"'))),
        _field("dateModified", F.when(shape == 6, F.lit('"soon"'))),
        _field("description", F.when(shape == 3, F.lit('"  "'))),
        _field("image", F.when(shape == 5, F.lit('"http://img.example.org/plain.jpg"'))),
        F.lit('"headline":"No. '), doc, F.lit('"}'),
    )
    html = F.concat(
        F.lit('<html lang="'), F.col("lang"), F.lit('"><head>'),
        _meta("article:published_time", F.when(F.col("doc_id") % 9 < 8, time)),
        _meta("article:modified_time", F.when(shape.isin(1, 6), F.lit("2024-06-01T00:00:00Z"))),
        _meta("og:description", F.when(shape.isin(1, 3), flat).when(shape == 2, F.lit(""))),
        _meta("description", F.when(shape == 1, F.lit("Last choice")).when(shape.isin(2, 7), flat), "name"),
        _meta("description", F.when(shape == 7, F.lit("Second of two")), "name"),
        _meta("og:image", F.when(shape.isin(4, 5), picture)),
        _script(node),
        F.lit("</head><body><p>"), _attribute(F.col("text")), F.lit("</p></body></html>"),
    )
    return documents.select(
        F.col("doc_id").alias("position"),
        page_url().alias("url"),
        canonical.alias("final_url"),
        F.lit(200).alias("status_code"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8")).alias("response_headers"),
        F.encode(html, "UTF-8").alias("response_body"),
    )
