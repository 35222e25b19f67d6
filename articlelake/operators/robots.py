"""Robots rules: one row per origin, and one decision per URL.

The file grammar is regular, so a file is cut into groups with one pattern instead of
a line-by-line fold: every line becomes a token, and a group is a run of agent tokens
followed by a run of rule tokens with no empty line between. Cost is linear in the file.
"""

from __future__ import annotations

from urllib.parse import uses_netloc, uses_params

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articlelake.functions.text import is_blank, strip
from articlelake.functions.urls import (
    fetch_target_reason,
    let,
    netloc_valid_sql,
    origin,
    percent_decode,
    percent_encode,
    url_cut,
    with_url,
)
from articlelake.operators.joins import lookup_join
from articlelake.sources import snapshots

# Statuses that close or open a whole origin.
DENY_STATUSES = (401, 403)
ALLOW_STATUSES = (404, 410)

_LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
# Agent tokens start with A; rules with Y (allow), N (disallow) or X (other); B is an
# empty line. Possessive loops do not recurse, so file length is no limit.
# Rule values that stay as they are; most do, and then skip the full cut.
_PLAIN_PATH = r"\A(?:/(?!/)[A-Za-z0-9_.~/\-]*)?\z"
_GROUP = r"(?md)(?:^A[^\n]*+\n)++(?:^[YNX][^\n]*+\n)++"


def with_origin(frame: DataFrame, url: str) -> DataFrame:
    """Add ``origin`` and ``target_reason`` (why the URL cannot be fetched, or null)."""
    parts = with_url(frame, url, "_target")
    return (
        parts.withColumn("target_reason", fetch_target_reason(F.col("_target")))
        .withColumn("origin", origin(F.col("_target")))
        .drop("_target")
    )


def robots_url(origin_column: Column) -> Column:
    return F.concat(origin_column, F.lit("/robots.txt"))


def _usable(status: Column) -> Column:
    known = status.between(200, 299) | status.isin(*DENY_STATUSES, *ALLOW_STATUSES)
    return F.coalesce(known, F.lit(False))


def first_capture(captures: DataFrame) -> DataFrame:
    """The first usable file of every origin, or its first failure if none is usable.

    Partial aggregation leaves one row per origin and task before the shuffle.
    """
    order = F.struct(~_usable(F.col("status_code")), F.col("fetched_at"), F.xxhash64("status_code", "body"))
    return (
        captures.groupBy("origin")
        .agg(F.min_by(F.struct("status_code", "body", "fetched_at"), order).alias("_first"))
        .select("origin", "_first.*")
    )


def _token(line: Column) -> Column:
    body = strip(F.substring_index(line, "#", 1))
    key = F.lower(strip(F.substring_index(body, ":", 1)))
    value = strip(F.regexp_extract(body, r"(?s)\A[^:]*:(.*)\z", 1))
    mark = (
        F.when(key == "user-agent", F.lit("A"))
        .when(key == "allow", F.lit("Y"))
        .when(key == "disallow", F.lit("N"))
        .when(key.isin("crawl-delay", "request-rate"), F.lit("X"))
    )
    named = F.when(F.contains(body, F.lit(":")), F.concat(mark, value))
    return F.when(line == "", F.lit("B")).otherwise(named)


def _trim_params(path: Column) -> Column:
    """Drop an empty parameter mark at the end of the last path segment."""
    return F.regexp_replace(path, r"(?s)\A((?:.*/)?[^/;]*);\z", "$1")


def _rebuilt(pieces: Column) -> Column:
    """A rule value in the form it is compared in: cut, put together, percent-encoded."""
    scheme = F.lower(pieces[0])
    netloc = pieces[1]
    path = F.when(scheme.isin(*uses_params), _trim_params(pieces[2])).otherwise(pieces[2])
    rooted = F.startswith(path, F.lit("/"))
    marks = (
        F.when(netloc != "", F.concat(F.lit("//"), netloc))
        .when(F.startswith(path, F.lit("//")), F.lit("//"))
        .when(
            (scheme != "") & scheme.isin(*uses_netloc) & ((path == "") | rooted), F.lit("//")
        )
        .otherwise(F.lit(""))
    )
    prefix = F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit(""))
    return percent_encode(F.concat(prefix, marks, path, _tail(pieces)))


def _tail(pieces: Column) -> Column:
    query = F.when(pieces[3] != "", F.concat(F.lit("?"), pieces[3])).otherwise(F.lit(""))
    fragment = F.when(pieces[4] != "", F.concat(F.lit("#"), pieces[4])).otherwise(F.lit(""))
    return F.concat(query, fragment)


def parse_groups(text: Column) -> Column:
    """Groups of a robots file: ``array<struct<agents, rules<path, allow, netloc>>>``."""
    lines = F.split(text, _LINE_ENDS)
    tokens = F.filter(F.transform(lines, _token), lambda token: token.isNotNull())
    joined = F.concat(F.array_join(tokens, "\n"), F.lit("\n"))
    return F.transform(F.regexp_extract_all(joined, F.lit(_GROUP), F.lit(0)), _group)


def _group(text: Column) -> Column:
    tokens = F.split(text, "\n")
    agents = F.filter(tokens, lambda token: F.startswith(token, F.lit("A")))
    rules = F.filter(tokens, lambda token: token.rlike(r"\A[YN]"))
    return F.struct(
        F.transform(agents, lambda token: percent_decode(_value(token))).alias("agents"),
        F.transform(rules, _rule).alias("rules"),
    )


def _value(token: Column) -> Column:
    return F.substring(token, 2, 2147483647)


def _rule(token: Column) -> Column:
    return let(percent_decode(_value(token)), lambda value: _cut_rule(token, value))


def _cut_rule(token: Column, value: Column) -> Column:
    allow = F.startswith(token, F.lit("Y")) | (value == "")

    def rule(path: Column, netloc: Column) -> Column:
        return F.struct(path.alias("path"), allow.alias("allow"), netloc.alias("netloc"))

    return F.when(value.rlike(_PLAIN_PATH), rule(value, F.lit(""))).otherwise(
        let(url_cut(value), lambda cut: rule(_rebuilt(cut), cut[1]))
    )


def robots_rules(captures: DataFrame) -> DataFrame:
    """Snapshot of rules: ``origin, policy, reason, groups``; one row per origin.

    ``policy`` is allow_all, deny_all, rules or error; ``reason`` is set for error.
    """
    status = F.col("status_code")
    first = first_capture(captures).withColumn(
        "_text",
        F.when(
            status.between(200, 299),
            F.make_valid_utf8(F.coalesce(F.col("body"), F.lit(b"")).cast("string")),
        ),
    )
    parsed = first.withColumn(
        "groups", F.when(~is_blank(F.col("_text")), parse_groups(F.col("_text")))
    )
    unreadable = f"exists(groups, g -> exists(g.rules, r -> NOT {netloc_valid_sql('r.netloc')}))"
    broken = F.coalesce(F.expr(unreadable), F.lit(False))
    reason = (
        F.when(status.isNull(), F.lit("robots_unavailable"))
        .when(~_usable(status), F.lit("robots_status_unsupported"))
        .when(broken, F.lit("robots_unparseable"))
    )
    policy = (
        F.when(F.col("reason").isNotNull(), F.lit("error"))
        .when(status.isin(*DENY_STATUSES), F.lit("deny_all"))
        .when(F.col("groups").isNull(), F.lit("allow_all"))
        .otherwise(F.lit("rules"))
    )
    return (
        parsed.withColumn("reason", reason)
        .withColumn("policy", policy)
        .select("origin", "policy", "reason", "groups")
    )


def rules_for_agent(rules: DataFrame, user_agent: Column | str) -> DataFrame:
    """The rules that bind one agent: ``origin, robots_policy, robots_error, robots_rules``.

    Chosen once per origin, so that the join to the URLs carries one group only.
    """
    agent = F.lit(user_agent) if isinstance(user_agent, str) else user_agent
    token = F.lower(F.substring_index(agent, "/", 1))
    named = F.filter(
        "groups",
        lambda group: ~F.array_contains(group["agents"], "*")
        & F.exists(group["agents"], lambda name: F.contains(token, F.lower(name))),
    )
    default = F.filter("groups", lambda group: F.array_contains(group["agents"], "*"))
    chosen = F.coalesce(F.try_element_at(named, F.lit(1)), F.try_element_at(default, F.lit(1)))
    return rules.select(
        "origin",
        F.col("policy").alias("robots_policy"),
        F.col("reason").alias("robots_error"),
        F.transform(
            chosen["rules"], lambda rule: F.struct(rule["path"].alias("path"), rule["allow"].alias("allow"))
        ).alias("robots_rules"),
    )


def match_path(pieces: Column) -> Column:
    """The text that rules are compared with, from the pieces of the decoded URL."""
    scheme = F.lower(pieces[0])
    path = F.when(scheme.isin(*uses_params), _trim_params(pieces[2])).otherwise(pieces[2])
    double = F.when(F.startswith(path, F.lit("//")), F.lit("//")).otherwise(F.lit(""))
    encoded = percent_encode(F.concat(double, path, _tail(pieces)))
    return F.when(encoded == "", F.lit("/")).otherwise(encoded)


def decide(frame: DataFrame, url: str, agent_rules: DataFrame) -> DataFrame:
    """Add ``robots_reason`` (null: allowed) to rows that carry ``origin``.

    The first matching rule wins; there is no longest match and no wildcard. A lookup
    that finds no file for the origin is ``robots_unavailable``.
    """
    joined = lookup_join(frame, agent_rules, "origin", spread=url)
    cut = joined.withColumn("_cut", url_cut(percent_decode(F.col(url))))
    located = cut.withColumn("_path", match_path(F.col("_cut"))).withColumn(
        "_readable", F.expr(netloc_valid_sql("_cut[1]"))
    )
    first = F.try_element_at(
        F.filter(
            "robots_rules",
            lambda rule: (rule["path"] == "*") | F.startswith(F.col("_path"), rule["path"]),
        ),
        F.lit(1),
    )
    reason = (
        F.when(F.col("robots_policy").isNull(), F.lit("robots_unavailable"))
        .when(F.col("robots_policy") == "error", F.col("robots_error"))
        .when(~F.col("_readable"), F.lit("robots_unparseable"))
        .when(F.col("robots_policy") == "deny_all", F.lit("robots_disallowed"))
        .when(F.col("robots_policy") == "allow_all", F.lit(None).cast("string"))
        .when(~F.coalesce(first["allow"], F.lit(True)), F.lit("robots_disallowed"))
    )
    return located.withColumn("robots_reason", F.when(F.col("origin").isNotNull(), reason)).drop(
        "_cut", "_path", "_readable", "robots_policy", "robots_error", "robots_rules"
    )


def refresh_snapshot(captures: DataFrame, path: str) -> int:
    """Forget all cached rules: commit a version of the snapshot from ``captures`` alone.

    Readers of earlier versions keep them; a stream that reads the snapshot for every batch
    uses the new rules from its next batch on.
    """
    return snapshots.commit(robots_rules(captures), path, replace=True)
