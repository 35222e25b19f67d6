"""Audit of the identity that requests were sent with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articlelake.functions.hosts import IPV4
from articlelake.functions.text import has_control
from articlelake.functions.urls import with_urls

# Product names that must not be imitated, and the length limit.
IMITATED = (
    "baiduspider",
    "bingbot",
    "chrome",
    "duckduckbot",
    "edge",
    "facebookexternalhit",
    "firefox",
    "googlebot",
    "mozilla",
    "safari",
    "twitterbot",
    "yandexbot",
)
MAX_USER_AGENT = 256
_TOKEN = r"\A[!#$%&'*+\-.^_`|~0-9A-Za-z]+\z"
_PRIVATE_HOST = rf"\A(?:{IPV4}|localhost|[^.]*)\z|:|\.local\z"


def user_agent(name: Column, version: Column, project_url: Column, contact: Column) -> Column:
    """``name/version (+url)`` or ``name/version (+url; contact=url)``."""
    extra = F.coalesce(F.concat(F.lit("; contact="), contact), F.lit(""))
    return F.concat(name, F.lit("/"), version, F.lit(" (+"), project_url, extra, F.lit(")"))


def is_public_https_url(url: Column, parts: Column) -> Column:
    """https, public named host, no user info, query or fragment, no control characters."""
    host = F.rtrim(parts["host"], F.lit("."))
    ok = (
        (url != "")
        & ~has_control(url)
        & parts["netloc_valid"]
        & (parts["scheme"] == "https")
        & parts["host"].isNotNull()
        & ~parts["has_userinfo"]
        & (parts["query"] == "")
        & (parts["fragment"] == "")
        & ~host.rlike(_PRIVATE_HOST)
    )
    return F.coalesce(ok, F.lit(False))


def _is_token(value: Column) -> Column:
    return F.coalesce(value.rlike(_TOKEN), F.lit(False))


def audit_identities(identities: DataFrame) -> DataFrame:
    """Add ``user_agent`` and ``identity_reason`` (null: sound) to an identity table.

    Expects ``product_name, product_version, project_url, contact``.
    """
    name, version = F.col("product_name"), F.col("product_version")
    url, contact = F.col("project_url"), F.col("contact")
    folded = F.lower(name)
    imitates = folded.rlike("|".join(IMITATED))
    agent = user_agent(name, version, url, contact)
    reason = (
        F.when(~_is_token(name), F.lit("product_name_invalid"))
        .when(imitates, F.lit("product_name_imitates"))
        .when(~_is_token(version), F.lit("product_version_invalid"))
        .when(~is_public_https_url(url, F.col("_project")), F.lit("project_url_invalid"))
        .when(
            contact.isNotNull() & ~is_public_https_url(contact, F.col("_contact")),
            F.lit("contact_invalid"),
        )
        .when(F.length(agent) > MAX_USER_AGENT, F.lit("user_agent_too_long"))
    )
    parts = with_urls(identities, {"_project": "project_url", "_contact": "contact"})
    return (
        parts.withColumn("user_agent", agent)
        .withColumn("identity_reason", reason)
        .drop("_project", "_contact")
    )


def windowed_disagreements(
    page_log: DataFrame, robots_log: DataFrame, *, window: str = "1 day", delay: str = "1 hour"
) -> DataFrame:
    """``identity_disagreements`` per origin and window of ``ts``, for two batches or two streams.

    Both logs are watermarked, and the slower one decides when a window closes. The state of
    an open window is one row per origin and agent, so a busy origin costs no more than its
    number of agents; the logs are never joined row by row. Late rows count until their
    window closes.
    """

    def side(log: DataFrame, page: int) -> DataFrame:
        flags = F.lit(page).alias("_page"), F.lit(1 - page).alias("_robots")
        return log.withWatermark("ts", delay).select("ts", "origin", "user_agent", *flags)

    pairs = (
        side(page_log, 1).unionByName(side(robots_log, 0))
        .groupBy(F.window("ts", window), "origin", "user_agent")
        .agg(F.max("_page").alias("_page"), F.max("_robots").alias("_robots"))
    )
    counts = pairs.groupBy(F.window(F.window_time("window"), window), "origin").agg(
        F.sum("_page").alias("page_agents"), F.sum("_robots").alias("robots_agents"), F.count(F.lit(1)).alias("agents")
    )
    differ = (F.col("page_agents") > 0) & (F.col("robots_agents") > 0) & (F.col("agents") > 1)
    return counts.where(differ).select(F.col("window.start").alias("window_start"), "origin", "page_agents", "robots_agents", "agents")


def identity_disagreements(page_log: DataFrame, robots_log: DataFrame) -> DataFrame:
    """Origins whose page and robots fetches did not all carry one user agent.

    Both logs are reduced to distinct (origin, agent) pairs first, so that a busy origin
    is small before the pairs of an origin meet; no pair is compared with another.
    """
    pages = page_log.select("origin", "user_agent", F.lit(1).alias("_page"), F.lit(0).alias("_robots"))
    robots = robots_log.select(
        "origin", "user_agent", F.lit(0).alias("_page"), F.lit(1).alias("_robots")
    )
    pairs = pages.unionByName(robots).groupBy("origin", "user_agent").agg(
        F.max("_page").alias("_page"), F.max("_robots").alias("_robots")
    )
    return (
        pairs.groupBy("origin")
        .agg(
            F.sum("_page").alias("page_agents"),
            F.sum("_robots").alias("robots_agents"),
            F.count(F.lit(1)).alias("agents"),
        )
        .where((F.col("page_agents") > 0) & (F.col("robots_agents") > 0) & (F.col("agents") > 1))
    )
