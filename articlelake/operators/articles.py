"""From page metadata to one validated article: choice, fallbacks and contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articlelake.functions import times
from articlelake.functions.hosts import article_host
from articlelake.functions.text import (
    bad_required_text,
    bad_text,
    has_control,
    language_tag,
    optional_text,
    ordered_distinct_text,
    present,
    strip,
)
from articlelake.functions.urls import (
    is_article_url,
    page_url_reason,
    with_first_image,
    with_url,
    with_urls,
)
from articlelake.operators.profiles import article_source
from articlelake.sources.schemas import ARTICLE_COLUMNS

_PREFERRED = "NewsArticle"


def candidate_identity(candidate: Column) -> Column:
    """Main entity when it is not empty, else the node's own URL."""
    return F.coalesce(F.nullif(candidate["main_id"], F.lit("")), candidate["node_url"])


def eligible_candidates(candidates: Column) -> Column:
    """The preferred kind when there is any, else all."""
    preferred = F.filter(candidates, lambda node: node["kind"] == _PREFERRED)
    return F.when(F.size(preferred) > 0, preferred).otherwise(candidates)


def select_candidate(eligible: Column, page_identity: Column) -> tuple[Column, Column]:
    """The chosen node and the reason why there is none; one of the two is null."""
    matches = F.filter(eligible, lambda node: candidate_identity(node) == page_identity)
    count, found = F.size(eligible), F.size(matches)
    only = F.try_element_at(eligible, F.lit(1))
    by_page = F.when(found == 1, F.try_element_at(matches, F.lit(1))).when(
        (found == 0) & (count == 1) & candidate_identity(only).isNull(), only
    )
    chosen = F.when(page_identity.isNotNull(), by_page).when(count == 1, only)
    ambiguous = F.when(page_identity.isNull(), count != 1).otherwise(found > 1)
    reason = F.when(ambiguous, F.lit("candidate_ambiguous")).when(
        chosen.isNull(), F.lit("candidate_no_match")
    )
    return chosen, reason


def build_articles(
    frame: DataFrame,
    *,
    requested_url: str = "url",
    source: str = "source",
    domains: str = "domains",
    page: str = "page",
) -> DataFrame:
    """Add ``article`` (struct of the twelve fields) and ``article_reason``.

    Exactly one of them is null for a row with page metadata. Checks run in contract
    order and the first failure gives the reason.
    """
    meta = F.col(page)
    identified = frame.withColumns(
        {
            "_page_identity": F.coalesce(
                F.nullif(meta["canonical_href"], F.lit("")), meta["og_url"]
            ),
            "_eligible": eligible_candidates(meta["candidates"]),
        }
    )
    page_identity = F.col("_page_identity")
    chosen, select_reason = select_candidate(F.col("_eligible"), page_identity)
    selected = identified.withColumns(
        {"_node": chosen, "_select_reason": select_reason}
    ).withColumn("_canonical", F.coalesce(page_identity, candidate_identity(F.col("_node"))))
    addressed = with_urls(
        selected, {"_canonical_url": "_canonical", "_requested_url": requested_url}
    )

    node = F.col("_node")
    stamps = ", ".join(
        ("_node.date_published", f"{page}.meta_published", "_node.date_modified", f"{page}.meta_modified")
    )
    fields = addressed.withColumns(
        {
            "_headline": F.coalesce(present(node["headline"]), meta["og_title"]),
            "_stamps": times.iso_micros(f"array({stamps})"),
            "_description": F.coalesce(
                present(node["description"]),
                F.nullif(meta["og_description"], F.lit("")),
                meta["meta_description"],
            ),
            "_authors": F.coalesce(
                ordered_distinct_text(node["authors"]), F.array().cast("array<string>")
            ),
            "_section": present(node["section"]),
            "_language": F.coalesce(
                language_tag(node["in_language"]), language_tag(meta["html_lang"])
            ),
        }
    ).withColumns(
        {
            "_published": F.coalesce(F.col("_stamps")[0], F.col("_stamps")[1]),
            "_modified": F.coalesce(F.col("_stamps")[2], F.col("_stamps")[3]),
        }
    )
    empty = F.array().cast("array<string>")
    images = F.concat(F.coalesce(node["images"], empty), F.array(meta["og_image"]))
    checked = with_url(with_first_image(fields, images, "_image"), "_image", "_image_url")

    canonical = F.col("_canonical")
    canonical_reason = page_url_reason(canonical, F.col("_canonical_url"), F.col(domains))
    reason = F.coalesce(
        meta["parse_error"],
        F.when(F.size(meta["candidates"]) == 0, F.lit("no_candidate")),
        F.when(page_identity.isNotNull(), F.col("_canonical_reason")),
        F.col("_select_reason"),
        F.col("_canonical_reason"),
        F.when(F.col("_headline").isNull(), F.lit("headline_missing")),
        F.when(F.col("_published").isNull(), F.lit("published_missing")),
        _contract_reason(requested_url, source),
    )
    article = F.struct(
        article_source(F.col(source)).alias("source"),
        article_host(F.col("_canonical_url.host")).alias("source_domain"),
        F.col(requested_url).alias("requested_url"),
        canonical.alias("canonical_url"),
        strip(F.col("_headline")).alias("headline"),
        times.to_timestamp(F.col("_published")).alias("published_at"),
        optional_text(F.col("_description")).alias("description"),
        F.col("_authors").alias("author_names"),
        times.to_timestamp(F.col("_modified")).alias("modified_at"),
        optional_text(F.col("_section")).alias("section"),
        F.col("_image").alias("lead_image_url"),
        F.col("_language").alias("language"),
    )
    decided = (
        checked.withColumn("_canonical_reason", canonical_reason)
        .withColumn("article_reason", F.when(meta.isNotNull(), reason))
        .withColumn(
            "article", F.when(meta.isNotNull() & F.col("article_reason").isNull(), article)
        )
    )
    helpers = [name for name in decided.columns if name.startswith("_") and name not in frame.columns]
    return decided.drop(*helpers)


def _contract_reason(requested_url: str, source: str) -> Column:
    image = F.col("_image")
    bad_author = F.exists("_authors", has_control)
    invalid, execution = F.lit("article_invalid"), F.lit("parser_execution")
    return (
        F.when(article_source(F.col(source)).isNull(), invalid)
        .when(article_host(F.col("_canonical_url.host")).isNull(), invalid)
        .when(
            ~is_article_url(F.col(requested_url), F.col("_requested_url"), allow_fragment=True),
            invalid,
        )
        .when(
            ~is_article_url(F.col("_canonical"), F.col("_canonical_url"), allow_fragment=False),
            invalid,
        )
        .when(
            image.isNotNull() & ~is_article_url(image, F.col("_image_url"), allow_fragment=False),
            invalid,
        )
        .when(bad_required_text(F.col("_headline")), invalid)
        .when(~times.in_range(F.col("_published")), execution)
        .when(bad_text(F.col("_description")), invalid)
        .when(bad_author, invalid)
        .when(~times.in_range(F.col("_modified")), execution)
        .when(bad_text(F.col("_section")), invalid)
    )


def article_record(article: str = "article") -> list[Column]:
    """The twelve fields in fixed order with timestamps as ISO text."""
    columns = []
    for name in ARTICLE_COLUMNS:
        field = F.col(f"{article}.{name}")
        columns.append((times.iso_text(field) if name.endswith("_at") else field).alias(name))
    return columns


def article_json(article: str = "article") -> Column:
    return F.to_json(F.struct(*article_record(article)), {"ignoreNullFields": "false"})
