"""Source profiles: validation, conflicts, exact-host resolution and parser dispatch."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articlelake.functions import hosts as host_rules
from articlelake.functions.staging import once
from articlelake.functions.text import strip
from articlelake.functions.urls import resolvable_host, with_url
from articlelake.operators.joins import lookup_join
from articlelake.sources.schemas import PROFILE_COLUMNS

# The one parser family and the two identifier grammars.
ARTICLE_FAMILY = "jsonld_article"
_IDENTIFIER = r"\A[a-z][a-z0-9_]{0,63}\z"
_SOURCE = r"\A[a-z0-9]++(?:_[a-z0-9]++)*+\z"


def is_identifier(value: Column) -> Column:
    return F.coalesce(value.rlike(_IDENTIFIER), F.lit(False))


def article_source(value: Column) -> Column:
    """Stripped source name as articles carry it, or null. Not the same as above."""
    stripped = strip(value)
    return F.when(stripped.rlike(_SOURCE), stripped)


def validate_profiles(
    profiles: DataFrame, families: Iterable[str] = (ARTICLE_FAMILY,)
) -> DataFrame:
    """Normalise ``domains`` (ordered, without repeats) and add ``reason``.

    ``reason`` is null for a sound profile; checks run in field order.
    """
    checked = profiles.withColumn("_hosts", host_rules.profile_hosts(F.col("domains")))
    domains = F.array_distinct("_hosts")
    sound = (F.size("_hosts") > 0) & ~F.exists("_hosts", lambda host: host.isNull())
    reason = (
        F.when(~is_identifier(F.col("source")), F.lit("source_invalid"))
        .when(~F.coalesce(sound, F.lit(False)), F.lit("domains_invalid"))
        .when(
            ~F.coalesce(F.col("parser_family").isin(*families), F.lit(False)),
            F.lit("family_invalid"),
        )
        .when(
            F.col("adapter_key").isNotNull() & ~is_identifier(F.col("adapter_key")),
            F.lit("adapter_key_invalid"),
        )
        .when(F.col("enabled").isNull(), F.lit("enabled_invalid"))
    )
    valid = checked.withColumn("reason", reason).withColumn(
        "domains", F.when(F.coalesce(sound, F.lit(False)), domains).otherwise(F.col("domains"))
    )
    return once(valid.drop("_hosts"), "domains", "reason")


def duplicate_sources(profiles: DataFrame) -> DataFrame:
    """Sources declared more than once."""
    return (
        profiles.groupBy("source")
        .agg(F.count(F.lit(1)).alias("declarations"))
        .where(F.col("declarations") > 1)
    )


def duplicate_hosts(profiles: DataFrame) -> DataFrame:
    """Hosts claimed by more than one profile (repeats inside a profile do not count)."""
    return (
        profiles.select("source", F.explode(F.array_distinct("domains")).alias("host"))
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("owners"))
        .where(F.col("owners") > 1)
    )


def profile_hosts(profiles: DataFrame, *, include_disabled: bool = False) -> DataFrame:
    """One row per owned host with the profile's fields; input must be validated."""
    kept = profiles if include_disabled else profiles.where("enabled")
    return kept.select(
        F.explode("domains").alias("profile_host"), *PROFILE_COLUMNS
    )


def registry(profiles: DataFrame) -> DataFrame:
    """Validated profiles in declared order; raises on a bad or conflicting profile.

    The eager counterpart of the lazy functions above, for configuration tables.
    """
    checked = validate_profiles(profiles)
    bad = checked.where(F.col("reason").isNotNull()).select("source", "reason").first()
    if bad is not None:
        raise ValueError(f"invalid source profile {bad['source']!r}: {bad['reason']}")
    twice = duplicate_sources(checked).first()
    if twice is not None:
        raise ValueError(f"two profiles are named {twice['source']}")
    claimed = duplicate_hosts(checked).first()
    if claimed is not None:
        raise ValueError(f"two profiles own the host {claimed['host']}")
    return checked.drop("reason").orderBy("position")


def _resolve(frame: DataFrame, host: Column, hosts: DataFrame, *, idna: bool, spread: str) -> DataFrame:
    keyed = frame.withColumn("profile_host", host_rules.profile_host(host, idna=idna))
    return lookup_join(keyed, hosts, "profile_host", spread=spread).drop("profile_host")


def resolve_by_url(
    frame: DataFrame, url: str, hosts: DataFrame, *, idna: bool = True
) -> DataFrame:
    """Add the profile fields of the exact host of an absolute https URL, else nulls."""
    parts = with_url(frame, url, "_resolve_url")
    return _resolve(
        parts, resolvable_host(F.col(url), F.col("_resolve_url")), hosts, idna=idna, spread=url
    ).drop("_resolve_url")


def resolve_by_host(
    frame: DataFrame, host: str, hosts: DataFrame, *, idna: bool = True
) -> DataFrame:
    return _resolve(frame, F.col(host), hosts, idna=idna, spread=host)


def resolve_by_source(
    frame: DataFrame, source: str, profiles: DataFrame, *, include_disabled: bool = False
) -> DataFrame:
    """Add the fields of the profile with that exact source under ``profile``."""
    kept = profiles if include_disabled else profiles.where("enabled")
    right = kept.select(
        F.col("source").alias("_source_key"), F.struct(*PROFILE_COLUMNS).alias("profile")
    )
    keyed = frame.withColumn(
        "_source_key", F.when(is_identifier(F.col(source)), F.col(source))
    )
    return lookup_join(keyed, right, "_source_key", spread=source).drop("_source_key")


def unresolved(frame: DataFrame, url: str, hosts: DataFrame, *, idna: bool = True) -> DataFrame:
    """Rows whose URL no listed profile owns."""
    resolved = resolve_by_url(
        frame, url, hosts.select("profile_host", F.col("source").alias("_owner")), idna=idna
    )
    return resolved.where(F.col("_owner").isNull()).drop("_owner")


def dispatch_reason(families: Iterable[str] = (ARTICLE_FAMILY,)) -> Column:
    """Why the resolved profile of a row cannot be parsed, or null."""
    return (
        F.when(F.col("source").isNull(), F.lit("source_unresolved"))
        .when(~F.col("enabled"), F.lit("source_disabled"))
        .when(F.col("adapter_key").isNotNull(), F.lit("source_adapter_unsupported"))
        .when(~F.col("parser_family").isin(*families), F.lit("source_family_unsupported"))
        .when(article_source(F.col("source")).isNull(), F.lit("source_parser_refused"))
    )


def primary_domain(domains: Column) -> Column:
    return F.try_element_at(domains, F.lit(1))


def supports_host(domains: Column, host: Column, *, idna: bool = True) -> Column:
    """Exact membership of the normalised host; a bad host is simply not supported."""
    normal = host_rules.profile_host(host, idna=idna)
    return F.coalesce(F.array_contains(domains, normal), F.lit(False))


def profile_json() -> Column:
    """The five declared fields in fixed order, with nulls kept."""
    return F.to_json(F.struct(*PROFILE_COLUMNS), {"ignoreNullFields": "false"})
