"""The whole flow: requests and captures in, one outcome per request out.

The same columns serve batch and stream. Cheap checks and both lookups run on the
narrow request rows, and so does the attempt log; page bytes join afterwards, once, only
for requests that may be fetched; and only pages that can still become articles reach the Python pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articlelake.functions.staging import once
from articlelake.operators import capture, metadata, profiles, robots
from articlelake.operators.joins import fits_broadcast, hot_keys, skewed_left_join
from articlelake.operators.parsers import FAMILIES, build_items
from articlelake.sources.schemas import ARTICLE_COLUMNS, PROFILE_COLUMNS, STAGE_OF_REASON
from articlelake.sources.tables import requests_from


def check_requests(
    requests: DataFrame, agent_rules: DataFrame, hosts: DataFrame, *, idna: bool = True
) -> DataFrame:
    """Add ``early_reason`` (request, target, robots) and the profile of each URL."""
    checked = robots.with_origin(capture.normalize_requests(requests_from(requests)), "url")
    decided = robots.decide(checked, "url", agent_rules)
    early = F.coalesce("request_reason", "target_reason", "robots_reason")
    resolved = profiles.resolve_by_url(decided, "url", hosts, idna=idna)
    return resolved.withColumn("early_reason", early).drop(
        "request_reason", "target_reason", "robots_reason", "origin"
    )


def attach(
    checked: DataFrame, responses: DataFrame, *, hot: DataFrame | None = None
) -> DataFrame:
    """Join page bytes to the requests that may be fetched (``first_responses`` form)."""
    refused = F.coalesce(
        "early_reason", *[name for name in ("transport_reason",) if name in checked.columns]
    )
    keyed = checked.withColumn("_requested", F.col("url")).withColumn(
        "url", F.when(refused.isNull(), F.col("url"))
    )
    joined = capture.attach_responses(keyed, responses, hot=hot)
    return joined.withColumn("url", F.col("_requested")).drop("_requested")


def transport_reasons(attempts: DataFrame) -> DataFrame:
    """``request_id, transport_reason`` from ``attempts.resolve_attempts`` output."""
    ended = F.col("outcome")
    reason = F.when(ended == "incomplete", F.lit("request_error")).when(
        ended != "response", ended
    )
    return attempts.select("request_id", reason.alias("transport_reason"))


def decode(captured: DataFrame) -> DataFrame:
    """Add ``document_stage_reason``, ``encoding`` and ``content`` to captured rows."""
    header = captured.withColumn("_content_type", capture.content_type(F.col("response_headers")))
    transport = (
        F.col("transport_reason") if "transport_reason" in captured.columns else F.lit(None)
    ).cast("string")
    reason = F.coalesce(
        F.col("early_reason"),
        transport,
        F.when(F.col("status_code").isNull(), F.lit("request_error")),
        F.when(~capture.is_success(F.col("status_code")), F.lit("response_status")),
        capture.media_reason(F.col("_content_type")),
    )
    staged = header.withColumn("_reason", reason)
    decoded = capture.decode_documents(
        staged, "_content_type", "response_body", F.col("_reason").isNull()
    )
    return decoded.withColumn(
        "document_stage_reason",
        F.coalesce(
            F.col("_reason"),
            F.when(F.col("content").isNull(), F.lit("decoding_failed")),
            capture.document_reason(),
        ),
    ).drop("_reason", "_content_type", "response_body", "early_reason")


def parse(decoded: DataFrame) -> DataFrame:
    """One outcome per row: ``position, request_url, source, reason_code, stage, article``."""
    waiting = F.col("document_stage_reason").isNull() & F.col("_dispatch").isNull()
    dispatched = decoded.withColumn("_dispatch", profiles.dispatch_reason(tuple(FAMILIES))).withColumn(
        "_page_text",
        F.when(waiting & metadata.needs_pass(F.col("content")), F.col("content")),
    )
    built = build_items(dispatched.withColumn("page", metadata.page_meta(F.col("_page_text"))))
    reason = F.coalesce(
        "document_stage_reason",
        "_dispatch",
        "article_reason",
        F.when(F.col("article").isNull(), F.lit("no_candidate")),
    )
    decided = built.withColumn("reason_code", reason).select(
        "position", F.col("url").alias("request_url"), "source", "reason_code", "article"
    )
    settled = once(decided, "reason_code", "article")
    return settled.withColumn("stage", stage_of(F.col("reason_code")))


def stage_of(reason: Column) -> Column:
    stages = F.create_map(*[F.lit(part) for pair in STAGE_OF_REASON.items() for part in pair])
    return F.when(reason.isNotNull(), F.try_element_at(stages, reason))


def crawl(
    requests: DataFrame,
    responses: DataFrame,
    agent_rules: DataFrame,
    hosts: DataFrame,
    *,
    attempts: DataFrame | None = None,
    hot: DataFrame | None = None,
    idna: bool = True,
) -> DataFrame:
    """Outcomes of a request table.

    ``responses`` has one row per URL (``capture.first_responses``), ``agent_rules``
    comes from ``robots.rules_for_agent``, ``hosts`` from ``profiles.profile_hosts`` and
    ``attempts`` (optional) from ``resolve_attempts`` with the position as request id.
    ``hot`` lists URLs whose requests one task should not take alone (``joins.hot_keys``).
    """
    checked = check_requests(requests, agent_rules, hosts, idna=idna)
    if attempts is not None:
        reasons = transport_reasons(attempts).withColumnRenamed("request_id", "position")
        checked = checked.join(reasons, "position", "left")
    return parse(decode(attach(checked, responses, hot=hot)))


def crawl_captures(
    captures: DataFrame,
    agent_rules: DataFrame,
    hosts: DataFrame,
    *,
    idna: bool = True,
    by_url: bool | None = None,
) -> DataFrame:
    """Outcomes of rows that already hold request and response; batch or stream.

    Needs ``position, url, final_url, status_code, response_headers, response_body``. When a
    lookup is too large to broadcast (or ``by_url`` says so), distinct URLs without page
    bytes are checked, and the verdicts join to the pages once.
    """
    if by_url is None:
        by_url = not captures.isStreaming and not (fits_broadcast(agent_rules) and fits_broadcast(hosts))
    if not by_url:
        return parse(decode(check_requests(captures, agent_rules, hosts, idna=idna)))
    urls = captures.select("url").where(F.col("url").isNotNull()).distinct()
    verdicts = check_requests(urls.withColumn("position", F.xxhash64("url")), agent_rules, hosts, idna=idna)
    narrow = verdicts.select("url", "early_reason", *PROFILE_COLUMNS)
    pages = capture.normalize_requests(requests_from(captures))
    hot = hot_keys(captures, "url", weight=F.octet_length("response_body"))
    joined = skewed_left_join(pages, narrow, "url", spread="position", hot=hot)
    reason = F.coalesce("request_reason", "early_reason")
    return parse(decode(joined.withColumn("early_reason", reason).drop("request_reason")))


def articles(outcomes: DataFrame) -> DataFrame:
    accepted = outcomes.where(F.col("reason_code").isNull())
    return accepted.select("position", *[f"article.{name}" for name in ARTICLE_COLUMNS])


def failed(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("reason_code").isNotNull()).select(
        "request_url", "position", "stage", "reason_code", "source"
    )


def write_outcomes(outcomes: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Store outcomes once and read them back, so that both sinks share one run."""
    outcomes.withColumn("accepted", F.col("reason_code").isNull()).write.mode(mode).partitionBy(
        "accepted"
    ).parquet(path)
    return outcomes.sparkSession.read.parquet(path)


def fail_fast(outcomes: DataFrame) -> DataFrame:
    """Only the rows before the first failure in request order.

    The first failed position is one aggregated number, used as a scalar subquery. Both
    uses read ``outcomes``, so store them first (``write_outcomes``).
    """
    first = outcomes.where(F.col("reason_code").isNotNull()).agg(F.min("position")).scalar()
    return outcomes.where(F.col("reason_code").isNull()).where(
        F.coalesce(F.col("position") < first, F.lit(True))
    )


def fail_fast_items(items: DataFrame, key: str) -> DataFrame:
    """The same for ``parse_rows`` output: items before a failure in its row are kept."""
    first = (
        items.where(F.col("reason_code").isNotNull())
        .agg(F.min(F.struct(key, "item_pos")))
        .scalar()
    )
    return items.where(F.col("reason_code").isNull()).where(
        F.coalesce(F.struct(key, "item_pos") < first, F.lit(True))
    )


def in_request_order(rows: DataFrame, *columns: str) -> DataFrame:
    """Total order by request position; only for a final, ordered export."""
    return rows.orderBy("position", *columns)
