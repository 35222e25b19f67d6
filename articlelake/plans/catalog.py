"""The registered queries. Each takes ``(spark, folder)`` and reads the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articlelake.functions import hosts as host_rules
from articlelake.functions import text, times, urls
from articlelake.operators import (
    articles,
    attempts,
    capture,
    identity,
    logs,
    metadata,
    parsers,
    profiles,
    robots,
)
from articlelake.operators.joins import hot_keys
from articlelake.plans import crawl, derived
from articlelake.plans.derived import AGENT, landing_table, spread_table, table
from articlelake.session import prepare, scratch_folder, stored
from articlelake.sources import schemas, snapshots, tables
from articlelake.streaming import articles as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(prepare(spark), folder)

    QUERIES[function.__name__] = run
    return function


def _pages_with_url(spark: SparkSession, folder: str) -> DataFrame:
    return urls.with_url(table(spark, folder, "pages").select("page_id", "url"), "url", "p")


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    documents = spread_table(spark, folder, "documents", "doc_id")
    return crawl.crawl_captures(derived.captures(documents), *_document_lookups(spark, folder))


def _document_lookups(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Stored snapshots of the robots rules and the profile hosts of all documents."""
    rules = robots.robots_rules(derived.document_robots(spark, folder))
    hosts = profiles.profile_hosts(derived.document_profiles(spark, folder))
    return stored(robots.rules_for_agent(rules, AGENT), "robots"), stored(hosts, "hosts")


def _page_hosts_table(spark: SparkSession, folder: str, *, include_disabled: bool) -> DataFrame:
    declared = profiles.validate_profiles(derived.page_profiles(spark, folder))
    return stored(profiles.profile_hosts(declared, include_disabled=include_disabled), "hosts")


# --- requests, URLs and hosts ---------------------------------------------------------


@query
def request_table(spark: SparkSession, folder: str) -> DataFrame:
    """One request per page URL with shared metadata; blank URLs are marked."""
    method = F.when(F.col("page_id") % 3 == 0, F.lit(" post\t")).otherwise(F.lit("get"))
    listed = table(spark, folder, "pages").select(
        F.col("page_id").alias("position"),
        F.when(F.col("page_id") % 17 == 0, F.lit(" \t\r\n")).otherwise(F.col("url")).alias("url"),
        method.alias("method"),
    )
    requests = tables.requests_from(listed, {"batch": "daily"})
    return capture.normalize_requests(requests).select(
        "position", "url", "method", F.col("metadata")["batch"].alias("batch"), "request_reason"
    )


@query
def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    part = F.col("p")
    return _pages_with_url(spark, folder).select(
        "page_id",
        part["scheme"].alias("scheme"),
        part["host"].alias("host"),
        part["path"].alias("path"),
        part["query"].alias("query"),
        part["fragment"].alias("fragment"),
        urls.origin(part).alias("origin"),
    )


@query
def https_boundary(spark: SparkSession, folder: str) -> DataFrame:
    """The four URL rules side by side on the same URLs."""
    part, url = F.col("p"), F.col("url")
    domains = F.when(F.length(part["host"]) % 2 == 0, F.array(part["host"])).otherwise(F.array())
    return _pages_with_url(spark, folder).select(
        "page_id",
        urls.fetch_target_reason(part).alias("target_reason"),
        urls.resolvable_host(url, part).alias("resolvable"),
        urls.is_article_url(url, part, allow_fragment=True).alias("requested_ok"),
        urls.is_article_url(url, part, allow_fragment=False).alias("canonical_ok"),
        urls.page_url_reason(url, part, domains).alias("page_reason"),
    )


@query
def fetch_targets(spark: SparkSession, folder: str) -> DataFrame:
    """The target rule on every page URL and on spoiled forms of it."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    forms = {
        "whole": F.col("url"),
        "no_scheme": F.concat(F.lit("//"), host, F.lit("/a")),
        "no_host": F.lit("https:///a"),
        "open_bracket": F.concat(F.lit("https://["), host, F.lit("/a")),
        "bad_port": F.concat(F.lit("https://"), host, F.lit(":99999/a")),
        "worded_port": F.concat(F.lit("https://"), host, F.lit(":port/a")),
        "inner_blank": F.concat(F.lit("https://"), host, F.lit(" x/a")),
    }
    listed = F.array(*(F.struct(F.lit(name).alias("form"), url.alias("given")) for name, url in forms.items()))
    given = table(spark, folder, "pages").select("page_id", F.inline(listed))
    checked = urls.with_url(given, "given", "p")
    return checked.select("page_id", "form", urls.fetch_target_reason(F.col("p")).alias("reason"))


@query
def host_rules_table(spark: SparkSession, folder: str) -> DataFrame:
    """The three host rules on variants of every page host."""
    host = F.col("host")
    variants = F.array(
        F.concat(F.upper(host), F.lit("..")),
        F.concat(F.lit(" "), host),
        F.concat(host, F.lit(".local")),
        F.concat(host, F.lit(":443")),
        F.concat(F.lit("my_"), host),
        F.substring_index(host, ".", 1),
        F.concat(F.lit("10.0.0."), (F.length(host) % 256).cast("string")),
        F.concat(F.lit("bücher."), host),
    )
    listed = derived.page_hosts(spark, folder).select(F.explode(variants).alias("given"))
    return listed.select(
        "given",
        host_rules.profile_host(F.col("given")).alias("profile_form"),
        host_rules.article_host(F.col("given")).alias("article_form"),
        host_rules.parser_domain(F.col("given")).alias("parser_form"),
    )


# --- profiles -------------------------------------------------------------------------


@query
def source_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Pages per outcome of the exact-host lookup, disabled profiles included."""
    hosts = _page_hosts_table(spark, folder, include_disabled=True)
    pages = table(spark, folder, "pages").select("page_id", "url")
    resolved = profiles.resolve_by_url(pages, "url", hosts)
    outcome = F.coalesce(profiles.dispatch_reason(), F.lit("resolved"))
    return resolved.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("pages"))


@query
def seed_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Planted URLs against the seed profiles and those of all documents, in declared order.

    ``line`` is the place of the owner in the exported registry.
    """
    after = tables.default_profiles(spark).agg(F.max("position")).scalar() + 1
    own = derived.document_profiles(spark, folder).withColumn("position", F.conv(F.substring(F.md5("source"), 1, 7), 16, 10).cast("long") + after)
    declared = profiles.registry(tables.default_profiles(spark).unionByName(own))
    path = scratch_folder(spark, "registry")
    tables.write_ordered(declared, path, "position")
    order = tables.read_ordered(spark, path, "position").select(F.col("source").alias("owner"), F.col("line").cast("long"))
    hosts = stored(profiles.profile_hosts(spark.read.parquet(f"{path}/rows"), include_disabled=True), "hosts")
    doc = F.col("doc_id")
    planted = F.array(
        F.lit("https://WWW.cnnindonesia.com/news/"), F.lit("https://surabaya.kompas.com./read/"),
        F.lit("https://kompas.com/read/"), F.lit("http://www.kompas.com/read/"),
    )
    url = F.when(doc % 5 == 4, derived.page_url()).otherwise(
        F.concat(F.element_at(planted, (F.least(doc % 5, F.lit(3)) + 1).cast("int")), doc.cast("string"))
    )
    listed = table(spark, folder, "documents").select("doc_id", url.alias("url"))
    resolved = profiles.resolve_by_url(listed, "url", hosts).withColumnRenamed("source", "owner")
    numbered = resolved.join(order, "owner", "left").withColumnRenamed("owner", "source")
    outcome = F.coalesce(profiles.dispatch_reason(), F.lit("resolved"))
    return numbered.select("doc_id", "source", "line", outcome.alias("outcome"))


@query
def profile_lookups(spark: SparkSession, folder: str) -> DataFrame:
    """Lookup by URL, by host in another spelling, and by source name, per page."""
    declared = stored(profiles.validate_profiles(derived.page_profiles(spark, folder)), "profiles")
    hosts = profiles.profile_hosts(declared).select("profile_host", F.col("source").alias("found"))
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    pages = table(spark, folder, "pages").select(
        "page_id",
        "url",
        F.concat(F.lit("ALT."), F.upper(host), F.lit(".")).alias("host"),
        F.concat(
            F.when(F.col("page_id") % 2 == 0, F.lit("s")).otherwise(F.lit("S")),
            F.substring(F.md5(host), 1, 12),
        ).alias("name"),
    )
    by_url = profiles.resolve_by_url(pages, "url", hosts).withColumnRenamed("found", "by_url")
    by_host = profiles.resolve_by_host(by_url, "host", hosts).withColumnRenamed("found", "by_host")
    by_source = profiles.resolve_by_source(by_host, "name", declared)
    return by_source.select(
        "page_id", "by_url", "by_host", F.col("profile.source").alias("by_source")
    )


@query
def unresolved_pages(spark: SparkSession, folder: str) -> DataFrame:
    hosts = _page_hosts_table(spark, folder, include_disabled=False)
    return profiles.unresolved(table(spark, folder, "pages").select("page_id", "url"), "url", hosts)


@query
def profile_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Sources and hosts that planted copies of some profiles declare twice."""
    declared = profiles.validate_profiles(derived.page_profiles(spark, folder)).drop("reason")
    size = F.length(F.col("domains")[0])
    same_source = declared.where(size % 4 == 0).withColumn(
        "domains", F.transform("domains", lambda host: F.concat(F.lit("copy."), host))
    )
    same_host = declared.where(size % 7 == 0).withColumn("source", F.concat("source", F.lit("_b")))
    planted = declared.unionByName(same_source).unionByName(same_host)
    by_source = profiles.duplicate_sources(planted).select(
        F.lit("source").alias("kind"), F.col("source").alias("value"), F.col("declarations").alias("claims")
    )
    by_host = profiles.duplicate_hosts(planted).select(
        F.lit("host").alias("kind"), F.col("host").alias("value"), F.col("owners").alias("claims")
    )
    return by_source.unionByName(by_host)


@query
def profile_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Planted faults in each profile field, and the first one that is reported."""
    size = F.length(F.col("domains")[0]) % 8
    planted = derived.page_profiles(spark, folder).select(
        F.when(size == 0, F.concat(F.lit("9"), "source")).when(
            size == 1, F.concat("source", F.lit("\n"))
        ).otherwise(F.col("source")).alias("source"),
        F.when(size == 2, F.array().cast("array<string>"))
        .when(size == 3, F.array(F.lit("localhost")))
        .when(size == 0, F.array(F.lit("https://x.example/")))
        .otherwise(F.col("domains"))
        .alias("domains"),
        F.when(size == 4, F.lit("other")).otherwise(F.col("parser_family")).alias("parser_family"),
        F.when(size == 5, F.lit("Bad Key")).otherwise(F.col("adapter_key")).alias("adapter_key"),
        "enabled",
        "position",
        F.col("source").alias("key"),
    )
    return profiles.validate_profiles(planted).select(
        "key", "reason", F.array_join("domains", "|").alias("domains")
    )


@query
def profile_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    declared = profiles.validate_profiles(derived.page_profiles(spark, folder))
    domains = F.col("domains")
    return declared.select(
        "source",
        profiles.primary_domain(domains).alias("primary_domain"),
        profiles.supports_host(domains, F.concat(domains[0], F.lit("."))).alias("supports_own"),
        profiles.supports_host(domains, F.concat(F.lit("sub."), domains[0])).alias("supports_sub"),
        profiles.dispatch_reason().alias("reason"),
        profiles.profile_json().alias("record"),
    )


# --- robots ---------------------------------------------------------------------------


@query
def robots_origins(spark: SparkSession, folder: str) -> DataFrame:
    pages = robots.with_origin(table(spark, folder, "pages").select("url"), "url")
    return pages.groupBy("origin").agg(F.count(F.lit(1)).alias("pages")).withColumn(
        "robots_url", robots.robots_url(F.col("origin"))
    )


@query
def robots_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Policy and rule counts of the first captured file of every origin."""
    rules = robots.robots_rules(derived.page_robots(spark, folder))
    bound = robots.rules_for_agent(rules, AGENT)
    return rules.select(
        "origin", "policy", "reason", F.coalesce(F.size("groups"), F.lit(0)).alias("groups")
    ).join(
        bound.select("origin", F.coalesce(F.size("robots_rules"), F.lit(0)).alias("rules")), "origin"
    )


@query
def robots_decisions(spark: SparkSession, folder: str) -> DataFrame:
    snapshot = robots.robots_rules(derived.page_robots(spark, folder))
    rules = stored(robots.rules_for_agent(snapshot, AGENT), "robots")
    pages = robots.with_origin(table(spark, folder, "pages").select("page_id", "url"), "url")
    return robots.decide(pages, "url", rules).select("page_id", "robots_reason")


# --- attempts and identity ------------------------------------------------------------


def _attempts(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    request = F.floor(F.col("event_id") / 4)
    return table(spark, folder, "events").select(
        request.alias("request_id"),
        (F.col("event_id") % 4 + 1).cast("int").alias("attempt_no"),
        F.when(request % 3 == 0, F.lit("post")).otherwise(F.lit("get")).alias("method"),
        F.when(kind == "view", 200).when(kind == "click", 404).when(kind == "error", 503).when(
            kind == "signup", 429
        ).alias("status_code"),
        F.when(
            kind == "purchase",
            F.when(F.col("user_id") % 2 == 0, F.lit("ReadTimeout")).otherwise(
                F.lit("UnsupportedProtocol")
            ),
        ).alias("error_class"),
        "ts",
    )


@query
def attempt_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return attempts.resolve_attempts(_attempts(spark, folder).drop("ts"))


@query
def unnumbered_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """The same log without attempt numbers: order comes from the time."""
    numbered = attempts.number_attempts(_attempts(spark, folder).drop("attempt_no"))
    return attempts.resolve_attempts(numbered.drop("ts"))


@query
def backoff_schedule(spark: SparkSession, folder: str) -> DataFrame:
    rule = attempts.RetryRule(backoff_base=1.0, backoff_max=3.0)
    log = _attempts(spark, folder)
    return log.select(
        "request_id",
        "attempt_no",
        attempts.backoff_seconds(F.col("attempt_no")).alias("delay"),
        attempts.backoff_seconds(F.col("attempt_no"), rule).alias("short_delay"),
        attempts.should_retry_status(F.col("status_code")).alias("retry_status"),
        attempts.is_retry_method(F.col("method")).alias("retry_method"),
    )


@query
def identity_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Identities built from page hosts, with one planted fault in most of them."""
    host, kind = F.col("host"), F.length("host") % 8
    built = derived.page_hosts(spark, folder).select(
        "host",
        F.when(kind == 0, F.lit("My Agent")).when(kind == 1, F.lit("xGoogleBot")).otherwise(
            F.concat(F.lit("Agent-"), F.length("host").cast("string"))
        ).alias("product_name"),
        F.when(kind == 2, F.lit("")).otherwise(F.lit("1.2")).alias("product_version"),
        F.when(kind == 3, F.concat(F.lit("http://"), host))
        .when(kind == 4, F.concat(F.lit("https://"), host, F.lit("/?q=1")))
        .otherwise(F.concat(F.lit("https://"), host, F.lit("/about")))
        .alias("project_url"),
        F.when(kind == 5, F.lit("https://10.0.0.1/"))
        .when(kind == 6, F.concat(F.lit("https://"), host, F.lit("/"), F.repeat(F.lit("c"), 240)))
        .when(kind == 7, F.concat(F.lit("https://"), host, F.lit("/c")))
        .alias("contact"),
    )
    return identity.audit_identities(built).select("host", "user_agent", "identity_reason")


@query
def identity_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Origins whose page log and robots log disagree on the user agent."""
    pages = robots.with_origin(table(spark, folder, "pages").select("page_id", "url"), "url")
    agent = F.when(F.col("page_id") % 40 == 0, F.lit("Other/2")).otherwise(F.lit("Agent/1"))
    page_log = pages.select("origin", agent.alias("user_agent"))
    robots_log = pages.select(
        "origin",
        F.when(F.length("origin") % 9 == 0, F.lit("Other/2")).otherwise(F.lit("Agent/1")).alias(
            "user_agent"
        ),
    ).where(F.length("origin") % 4 > 0)
    return identity.identity_disagreements(page_log, robots_log)


# --- captures -------------------------------------------------------------------------


def _responses(spark: SparkSession, folder: str) -> DataFrame:
    """One response per document with varied statuses, header names and charsets."""
    doc = F.col("doc_id")
    header = F.element_at(
        F.array(
            *[
                F.lit(value)
                for value in (
                    "text/html; charset=utf-8",
                    "text/html",
                    'TEXT/HTML;level="1";Charset="UTF-8"',
                    "application/xhtml+xml; charset=",
                    "application/json",
                    "text/html; charset=iso-8859-1",
                    "text/html; charset=windows-1252",
                    "text/html; charset=us-ascii",
                    "text/html; charset=nope",
                    "html",
                )
            ]
        ),
        (doc % 10 + 1).cast("int"),
    )
    name = F.element_at(
        F.array(F.lit("Content-Type"), F.lit("content-type"), F.lit("CONTENT-TYPE")),
        (doc % 3 + 1).cast("int"),
    )
    headers = F.when(
        doc % 13 == 12, F.create_map(F.lit("Server"), F.lit("x"))
    ).otherwise(F.create_map(F.lit("Server"), F.lit("x"), name, header))
    body = F.encode("text", "UTF-8")
    return spread_table(spark, folder, "documents", "doc_id").select(
        F.concat(F.lit("https://www.example.org/"), doc.cast("string")).alias("request_url"),
        F.concat(F.lit("https://www.example.org/final/"), doc.cast("string")).alias("final_url"),
        F.when(doc % 11 == 0, 404).when(doc % 11 == 1, 500).when(doc % 11 == 2, 204).otherwise(200).alias("status_code"),
        headers.alias("headers"),
        F.when(doc % 20 == 10, F.concat(body, F.unhex(F.lit("FF")))).otherwise(body).alias("body"),
        F.lit(None).cast("double").alias("elapsed"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("fetched_at"),
    )


@query
def capture_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Requests joined to captured responses, filtered and decoded over whole bodies.

    Every third response was captured twice; the later capture must lose.
    """
    first = _responses(spark, folder)
    again = first.where(F.length("request_url") % 3 == 0).withColumns(
        {
            "status_code": F.lit(503),
            "fetched_at": F.lit("2024-02-01 00:00:00").cast("timestamp"),
        }
    )
    responses = capture.first_responses(first.unionByName(again))
    doc = F.col("doc_id")
    listed = table(spark, folder, "documents").select(
        doc.alias("position"),
        F.when(doc % 19 == 18, F.lit("https://www.example.org/missing"))
        .otherwise(F.concat(F.lit("https://www.example.org/"), doc.cast("string")))
        .alias("url"),
    )
    requests = tables.requests_from(listed).withColumn("early_reason", F.lit(None).cast("string"))
    decoded = crawl.decode(capture.attach_responses(requests, responses))
    return decoded.select(
        "position",
        F.col("document_stage_reason").alias("reason"),
        "encoding",
        F.length("content").cast("long").alias("content_chars"),
        "elapsed",
    )


@query
def page_language(spark: SparkSession, folder: str) -> DataFrame:
    """Pages per declared language, read from the whole page by the head pass."""
    pages = spread_table(spark, folder, "pages", "page_id").select(metadata.page_meta(F.col("html")).alias("page"))
    language = text.language_tag(F.col("page.html_lang"))
    return pages.groupBy(language.alias("language")).agg(F.count(F.lit(1)).alias("pages"))


@query
def first_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """First value per conversation and role, as a table operator."""
    turns = table(spark, folder, "conversations").select("conv_id", "role", "turn", "text")
    return metadata.first_values(turns, ["conv_id", "role"], "turn", "text")


# --- articles -------------------------------------------------------------------------


@query
def article_extract(spark: SparkSession, folder: str) -> DataFrame:
    """The articles of all captured documents, with whole texts as descriptions."""
    accepted = _outcomes(spark, folder).where(F.col("reason_code").isNull())
    record = articles.article_record()
    columns = [
        F.array_join("article.author_names", "|").alias("author_names")
        if name == "author_names"
        else column
        for name, column in zip(schemas.ARTICLE_COLUMNS, record, strict=True)
    ]
    return accepted.select("position", *columns)


@query
def head_fallbacks(spark: SparkSession, folder: str) -> DataFrame:
    """Times, descriptions and images that only the head of a page states, or states usably."""
    documents = spread_table(spark, folder, "documents", "doc_id")
    outcomes = crawl.crawl_captures(derived.head_captures(documents), *_document_lookups(spark, folder))
    record = dict(zip(schemas.ARTICLE_COLUMNS, articles.article_record(), strict=True))
    taken = ("published_at", "modified_at", "description", "lead_image_url")
    return outcomes.select("position", "reason_code", *(record[name] for name in taken))


@query
def article_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return crawl.failed(_outcomes(spark, folder))


@query
def article_json(spark: SparkSession, folder: str) -> DataFrame:
    """Field order and kept nulls of the serialised record: its keys, per article."""
    record = articles.article_json()
    return _outcomes(spark, folder).where(F.col("reason_code").isNull()).select(
        "position",
        F.array_join(F.json_object_keys(record), "|").alias("keys"),
        F.get_json_object(record, "$.published_at").alias("published_at"),
        record.contains('"lead_image_url":null').alias("null_image"),
    )


@query
def fail_fast_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Articles before the first failure; outcomes are stored once and read twice."""
    stored = crawl.write_outcomes(_outcomes(spark, folder), scratch_folder(spark, "outcomes"))
    return crawl.fail_fast(stored).select("position", F.col("article.canonical_url").alias("canonical_url"))


@query
def ordered_export(spark: SparkSession, folder: str) -> DataFrame:
    """Requests exported in their order as parts with a manifest, and read back by it."""
    path = scratch_folder(spark, "ordered")
    listed = table(spark, folder, "documents").select(F.col("doc_id").alias("position"), derived.page_url().alias("url"))
    tables.write_ordered(listed, path, "position")
    lines = tables.read_ordered(spark, path, "position")
    bounds = tables.read_manifest(spark, path).select("part", "first", "last")
    return lines.join(F.broadcast(bounds), "part").select(
        "position", "url", F.col("line").cast("long").alias("line"), F.col("position").between(F.col("first"), F.col("last")).alias("in_bounds")
    )


@query
def article_sinks(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per partition of the three sinks after writing and reading them back."""
    base = scratch_folder(spark, "sinks")
    stored = crawl.write_outcomes(_outcomes(spark, folder), f"{base}/outcomes")
    tables.write_articles(crawl.articles(stored), f"{base}/processed")
    tables.write_failed(crawl.failed(stored), f"{base}/failed")
    tables.write_raw(
        derived.captures(table(spark, folder, "documents")).select("position", "url", "response_body"),
        f"{base}/raw",
    )

    def counted(name: str, part: str) -> DataFrame:
        return spark.read.parquet(f"{base}/{name}").groupBy(F.expr(part).alias("part")).agg(
            F.count(F.lit(1)).alias("rows")
        ).withColumn("sink", F.lit(name))

    return (
        counted("processed", "source")
        .unionByName(counted("failed", "reason_code"))
        .unionByName(counted("raw", "'all'"))
    )


@query
def jsonld_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks around both limits, nested or widened by the id of the document."""
    doc = F.col("doc_id")
    beyond = F.floor(doc / 2) % 4
    deep = (beyond + 61).cast("int")
    wide = (beyond + 9_994).cast("int")
    node = F.lit('{"@type":"Article","headline":"H"}')
    block = F.when(
        doc % 2 == 0,
        F.concat(F.repeat(F.lit("["), deep), node, F.repeat(F.lit("]"), deep)),
    ).otherwise(
        F.concat(F.lit("[0,1,"), node, F.repeat(F.lit(",0"), wide), F.lit("]"))
    )
    html = F.concat(
        F.lit('<script type="application/ld+json">'), block, F.lit("</script><p>"),
        F.replace("text", F.lit("<"), F.lit("&lt;")),
    )
    pages = spread_table(spark, folder, "documents", "doc_id").select(
        "doc_id", metadata.page_meta(html).alias("page")
    )
    return pages.select(
        "doc_id",
        F.col("page.parse_error").alias("reason"),
        F.size("page.candidates").cast("long").alias("candidates"),
    )


@query
def author_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Author shapes built from the words of each text."""
    words = F.filter(F.split(derived.flat_text(F.col("text")), " "), lambda word: word != "")
    named = F.transform(words, lambda word: F.concat(F.lit(" "), word, F.lit(" ")))
    listed = spread_table(spark, folder, "documents", "doc_id").select(
        "doc_id", text.ordered_distinct_text(named).alias("names"), F.size(named).alias("given")
    )
    return listed.select(
        "doc_id",
        F.col("given").cast("long").alias("given"),
        F.size("names").cast("long").alias("kept"),
        F.try_element_at("names", F.lit(1)).alias("first_name"),
        F.element_at("names", -1).alias("last_name"),
    )


@query
def timestamp_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Event times written in eight forms, and the instants read from them."""
    kind = F.col("event_id") % 8
    shifted = F.col("ts") + F.expr("interval 330 minutes")

    def form(column, pattern: str, tail: str):
        return F.concat(F.date_format(column, pattern), F.lit(tail))

    written = (
        F.when(kind == 0, form(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "Z"))
        .when(kind == 1, form(shifted, "yyyy-MM-dd HH:mm:ss,SSS", "+05:30"))
        .when(kind == 2, form(shifted, "yyyyMMdd'T'HHmmss", "+0530"))
        .when(kind == 3, form(F.col("ts"), "yyyy-MM-dd'T'HH", "+00"))
        .when(kind == 4, form(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss", ""))
        .when(kind == 5, form(F.col("ts"), "yyyy-MM-dd", ""))
        .when(kind == 6, form(F.col("ts"), "yyyy-MM-dd'T'HH:mm", "-24:00"))
        .otherwise(
            F.concat(
                F.extract(F.lit("YEAROFWEEK"), F.col("ts")).cast("string"),
                F.lit("-W"),
                F.lpad(F.weekofyear("ts").cast("string"), 2, "0"),
                F.lit("-"),
                (F.weekday("ts") + 1).cast("string"),
                F.lit("T"),
                F.date_format("ts", "HH:mm"),
                F.lit("z"),
            )
        )
    )
    read = table(spark, folder, "events").select("event_id", written.alias("written"))
    return read.select(
        "event_id", times.to_timestamp(times.iso_micros("array(written)")[0]).alias("instant")
    ).select("event_id", times.iso_text(F.col("instant")).alias("instant"))


@query
def crawl_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """The whole flow from separate tables: requests per stage and reason."""
    pages = derived.captures(spread_table(spark, folder, "documents", "doc_id"))
    responses = pages.select(
        F.col("url").alias("request_url"),
        "final_url",
        "status_code",
        F.col("response_headers").alias("headers"),
        F.col("response_body").alias("body"),
        F.lit(0.5).alias("elapsed"),
    ).where(F.col("request_url").endswith("7") == F.lit(False))
    requests = table(spark, folder, "documents").select(
        F.col("doc_id").alias("position"), derived.page_url().alias("url")
    )
    log = attempts.resolve_attempts(
        requests.select(
            F.col("position").alias("request_id"),
            F.lit(1).alias("attempt_no"),
            F.lit("GET").alias("method"),
            F.when(F.col("position") % 9 > 0, 200).alias("status_code"),
            F.when(F.col("position") % 9 == 0, F.lit("InvalidURL")).alias("error_class"),
        )
    )
    rules, hosts = _document_lookups(spark, folder)
    hot = hot_keys(requests, "url")
    outcomes = crawl.crawl(requests, responses, rules, hosts, attempts=log, hot=hot)
    return outcomes.groupBy(
        F.coalesce("stage", F.lit("accepted")).alias("stage"),
        F.coalesce("reason_code", F.lit("accepted")).alias("reason_code"),
    ).agg(F.count(F.lit(1)).alias("requests"))


# --- user parsers ---------------------------------------------------------------------

_ITEM = T.StructType(
    [T.StructField("label", T.StringType()), T.StructField("size", T.LongType())]
)


def _toy_parser(document: dict):
    """0..n items per page; some pages fail after their first items."""
    content, kind = document["content"], len(document["requested_url"]) % 6
    if kind == 0:
        return
    yield {"label": "page", "size": len(content)}
    yield {"label": "paragraphs", "size": content.count("<p>")}
    if kind == 1:
        raise parsers.DocumentRejected("article_invalid")
    if kind == 2:
        yield ["not", "a", "mapping"]
    if kind == 3:
        yield {"label": "broken", "size": "many"}
    if kind == 4:
        raise KeyError("x")


@query
def document_items(spark: SparkSession, folder: str) -> DataFrame:
    pages = spread_table(spark, folder, "pages", "page_id").select(
        "page_id", F.col("url").alias("requested_url"), F.col("html").alias("content")
    )
    items = parsers.parse_documents(pages, _toy_parser, _ITEM, key="page_id")
    return items.select("page_id", "item_pos", "item.label", "item.size", "reason_code")


@query
def item_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Items before the first failure, those of the failing page included."""
    pages = spread_table(spark, folder, "pages", "page_id").select(
        "page_id", F.col("url").alias("requested_url"), F.col("html").alias("content")
    )
    items = parsers.parse_documents(pages, _toy_parser, _ITEM, key="page_id")
    stored_at = scratch_folder(spark, "items")
    items.write.parquet(stored_at)
    kept = crawl.fail_fast_items(spark.read.parquet(stored_at), "page_id")
    return kept.select("page_id", "item_pos", "item.label")


def _response_parser(response: dict):
    """Up to three items per response; some end with a refusal or an error."""
    status, headers = response["status_code"], response["headers"]
    if status == 404:
        return
    yield {"label": "status", "size": status}
    if status == 500:
        raise parsers.DocumentRejected("response_status")
    yield {"label": "bytes", "size": len(response["response_body"])}
    if status == 204:
        yield {"label": "broken", "size": "many"}
    yield {"label": {name.lower(): value for name, value in headers.items()}["content-type"].lower(), "size": len(headers)}


@query
def response_items(spark: SparkSession, folder: str) -> DataFrame:
    """A parser of raw responses as a table function in SQL."""
    parsers.register_parser(
        spark, "parse_response", _response_parser, _ITEM,
        key="position", key_type=T.LongType(), inputs=parsers.RESPONSE_FIELDS,
    )
    return spark.sql(
        """SELECT position, item_pos, item.label AS label, item.size AS size, reason_code
        FROM parse_response(TABLE(SELECT
            cast(substring_index(request_url, '/', -1) AS bigint) AS position, request_url AS url,
            final_url, status_code, headers, body AS response_body, elapsed FROM {responses}))""",
        responses=_responses(spark, folder),
    )


# --- redaction and logs ---------------------------------------------------------------


@query
def redact_documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread_table(spark, folder, "documents", "doc_id").select(
        "doc_id", text.redact_text(F.col("text")).alias("text")
    )


@query
def redact_maps(spark: SparkSession, folder: str) -> DataFrame:
    """Event properties with planted keys, redacted by key."""
    key = F.element_at(
        F.array(*[F.lit(name) for name in ("Password", "user", "API-Key", "api key", "TOKEN")]),
        (F.col("event_id") % 5 + 1).cast("int"),
    )
    arguments = F.create_map(key, F.col("props"), F.lit("event"), F.col("event_type"))
    redacted = text.redact_map(arguments)
    return table(spark, folder, "events").select(
        "event_id", redacted[key].alias("planted"), redacted["event"].alias("event")
    )


@query
def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Events as log records; level by type, correlation missing for every third."""
    level = F.element_at(
        F.array(*[F.lit(name) for name in logs.LEVELS]), (F.col("event_id") % 5 + 1).cast("int")
    )
    records = table(spark, folder, "events").select(
        "event_id",
        "ts",
        level.alias("level"),
        F.concat(F.lit("app."), F.col("event_type")).alias("logger"),
        F.when(F.col("event_id") % 3 > 0, F.col("user_id").cast("string")).alias("correlation_id"),
        F.concat(
            F.lit("props="), F.col("props"), F.lit(" token: "), F.col("user_id").cast("string")
        ).alias("message"),
    )
    return logs.log_lines(records, "WARNING").select("event_id", "line")


# --- streams --------------------------------------------------------------------------


@query
def stream_articles(spark: SparkSession, folder: str) -> DataFrame:
    """The batch columns over a file stream, run to its end and read from the sink."""
    landing = landing_table(spark, folder, "documents")
    rules, hosts = _document_lookups(spark, folder)
    base = scratch_folder(spark, "stream")
    streaming.write_outcomes(
        derived.captures(landing), lambda _: (rules, hosts), f"{base}/outcomes", f"{base}/state"
    ).awaitTermination()
    return (
        spark.read.parquet(f"{base}/outcomes")
        .groupBy(F.coalesce("reason_code", F.lit("accepted")).alias("outcome"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("article.canonical_url").alias("first_url"),
            F.sum(F.length("article.description")).alias("description_chars"),
        )
    )


@query
def stream_robots(spark: SparkSession, folder: str) -> DataFrame:
    """Page URLs as a stream of robots captures; the first file per origin is kept."""
    landing = landing_table(spark, folder, "pages")
    captures = robots.with_origin(landing.select("url"), "url").select(
        "origin",
        F.lit(200).alias("status_code"),
        F.encode(F.lit("User-agent: *\nDisallow: /en/\nAllow: /"), "UTF-8").alias("body"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("fetched_at"),
    )
    base = scratch_folder(spark, "robots")
    streaming.write_robots_snapshots(captures, f"{base}/rules", f"{base}/state").awaitTermination()
    snapshot = streaming.read_robots_snapshot(spark, f"{base}/rules")
    return robots.rules_for_agent(snapshot, AGENT).select(
        "origin", F.col("robots_policy").alias("policy"), F.size("robots_rules").cast("long").alias("rules")
    )


@query
def stream_first_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Captures of all documents, and later failed ones of the same URLs: the first batch counts."""
    captures = derived.captures(table(spark, folder, "documents"))
    base = scratch_folder(spark, "stream")
    for part, status in ((0, F.col("status_code")), (1, F.lit(500).cast(captures.schema["status_code"].dataType))):
        fetched = F.timestamp_seconds(F.lit(1_704_067_200 + 3600 * part))
        rows = captures.withColumn("status_code", status).withColumn("fetched_at", fetched)
        rows.repartition(_LANDED_FILES).write.mode("append").parquet(f"{base}/landing")
    schema = spark.read.parquet(f"{base}/landing").schema
    landing = spark.readStream.schema(schema).option("maxFilesPerTrigger", _LANDED_FILES).parquet(f"{base}/landing")
    lookups = _document_lookups(spark, folder)
    streaming.write_outcomes(
        streaming.first_captures(landing), lambda _: lookups, f"{base}/outcomes", f"{base}/state"
    ).awaitTermination()
    return (
        spark.read.parquet(f"{base}/outcomes")
        .groupBy(F.coalesce("reason_code", F.lit("accepted")).alias("outcome"))
        .agg(F.count(F.lit(1)).alias("rows"), F.min("article.canonical_url").alias("first_url"))
    )


#: Files of one landed part, and parts of a landed log.
_LANDED_FILES, _LANDED_PARTS = 8, 3


def _landed_stream(spark: SparkSession, log: DataFrame, late: Column, path: str) -> DataFrame:
    """A stream over a log with ``ts``, landed part after part by its time.

    Rows that are ``late`` land as if they had happened half an hour later. A last row of
    nulls a week after the log lets all windows of the log close.
    """
    landed = F.unix_timestamp("ts") + F.when(late, 1800).otherwise(0)
    rows = stored(log.withColumn("_landed", landed), "log")
    first, last = rows.agg(F.min("_landed"), F.max("_landed")).first()
    length = ((last or 0) - (first or 0)) // _LANDED_PARTS + 1
    for part in range(_LANDED_PARTS):
        inside = rows.where(F.floor((F.col("_landed") - (first or 0)) / length) == part).drop("_landed")
        inside.repartition(_LANDED_FILES).write.mode("append").parquet(path)
    end = spark.range(1).select(F.timestamp_seconds(F.lit((last or 0) + 7 * 86_400)).alias("ts"))
    nulls = (F.lit(None).cast(field.dataType).alias(field.name) for field in log.schema if field.name != "ts")
    end.select("ts", *nulls).select(*log.columns).write.mode("append").parquet(path)
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", _LANDED_FILES).parquet(path)


@query
def stream_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """The attempt log as a stream with late rows; a request's row comes when its time is up."""
    base = scratch_folder(spark, "attempts")
    log = _attempts(spark, folder)
    second = F.lit(1_704_067_200) + (F.col("request_id") * 4 + F.col("attempt_no")) * 61
    log = log.withColumn("ts", F.timestamp_seconds(second))
    landing = _landed_stream(spark, log, (F.col("request_id") % 5 == 0) & (F.col("attempt_no") % 2 == 0), f"{base}/landing")
    streaming.write_stream(attempts.resolve_attempt_stream(landing), f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").where(F.col("request_id").isNotNull())


@query
def stream_identities(spark: SparkSession, folder: str) -> DataFrame:
    """Page and robots logs as two streams with late rows; origins that disagree, per day."""
    base = scratch_folder(spark, "identities")
    pages = robots.with_origin(table(spark, folder, "pages").select("page_id", "url"), "url")
    first = 1_704_067_200
    page_log = pages.select(
        F.timestamp_seconds(F.lit(first) + F.col("page_id") * 61).alias("ts"), "origin",
        F.when(F.col("page_id") % 40 == 0, F.lit("Other/2")).otherwise(F.lit("Agent/1")).alias("user_agent"),
    )
    robots_log = pages.where(F.length("origin") % 4 > 0).select(
        F.timestamp_seconds(F.lit(first) + F.col("page_id") * 61 + 7).alias("ts"), "origin",
        F.when(F.length("origin") % 9 == 0, F.lit("Other/2")).otherwise(F.lit("Agent/1")).alias("user_agent"),
    )
    late = F.second("ts") % 7 == 0
    both = [_landed_stream(spark, log, late, f"{base}/{name}") for name, log in (("pages", page_log), ("robots", robots_log))]
    streaming.write_stream(identity.windowed_disagreements(*both), f"{base}/out", f"{base}/state").awaitTermination()
    day = ((F.unix_timestamp("window_start") - first) / 86_400).cast("long").alias("day")
    return spark.read.parquet(f"{base}/out").select(day, "origin", "page_agents", "robots_agents", "agents")


def _robots_landing(spark: SparkSession, folder: str, base: str) -> str:
    """Two files of robots captures: a first fetch of every page origin, and a later one.

    The first fetch fails for origins of even length; the later one closes every origin.
    """
    origin = F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1)
    origins = table(spark, folder, "pages").select(origin.alias("origin"))
    failed = F.length("origin") % 2 == 0
    for part, status, body in (
        (0, F.when(failed, 500).otherwise(200), "User-agent: *\nDisallow: /en/\nAllow: /"),
        (1, F.lit(200), "User-agent: *\nDisallow: /"),
    ):
        captures = origins.select(
            "origin", status.cast("int").alias("status_code"), F.encode(F.lit(body), "UTF-8").alias("body"),
            F.timestamp_seconds(F.lit(1_704_067_200 + part)).alias("fetched_at"),
        )
        captures.coalesce(1).write.mode("append").parquet(f"{base}/landing")
    return f"{base}/landing"


@query
def robots_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Robots captures of all page origins in two batches; the first usable file is kept.

    The first version is pinned and read beside the latest one, which has been compacted.
    """
    base = scratch_folder(spark, "robots")
    landing = tables.stream_table(spark, _robots_landing(spark, folder, base), schemas.ROBOTS, maxFilesPerTrigger="1")
    streaming.write_robots_snapshots(landing, f"{base}/rules", f"{base}/state", compact_every=2).awaitTermination()

    def rules(version: int | None, name: str) -> DataFrame:
        snapshot = robots.rules_for_agent(streaming.read_robots_snapshot(spark, f"{base}/rules", version), AGENT)
        policy = F.coalesce("robots_error", "robots_policy").alias(f"{name}_policy")
        return snapshot.select("origin", policy, F.coalesce(F.size("robots_rules"), F.lit(0)).cast("long").alias(f"{name}_rules"))

    stored_rows = snapshots.read_version(spark, f"{base}/rules").groupBy("origin").agg(F.count(F.lit(1)).alias("rows"))
    return rules(0, "first").join(rules(None, "latest"), "origin").join(stored_rows, "origin")


@query
def robots_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions for all page URLs before and after the robots snapshot is refreshed."""
    path = f"{scratch_folder(spark, 'robots')}/rules"
    captures = derived.page_robots(spark, folder)
    before = robots.refresh_snapshot(captures, path)
    closed = captures.withColumn("body", F.encode(F.lit("User-agent: *\nDisallow: /de/"), "UTF-8")).withColumn("status_code", F.lit(200))
    after = robots.refresh_snapshot(closed, path)
    urls_of_pages = robots.with_origin(table(spark, folder, "pages").select("page_id", "url"), "url")
    for version, name in ((before, "before"), (after, "after")):
        rules = robots.rules_for_agent(streaming.read_robots_snapshot(spark, path, version), AGENT)
        urls_of_pages = robots.decide(urls_of_pages, "url", stored(rules, "robots")).withColumnRenamed("robots_reason", name)
    return urls_of_pages.select("page_id", "before", "after")
