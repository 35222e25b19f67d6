"""Robots rules against the interpreter's own parser, plus status and lookup rules."""

import random
from datetime import datetime
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from articlelake.operators import robots

AGENT = "Example-Agent/1.0 (+https://agent.example/about)"
HOST = "https://news.example"


def expected(body, url):
    parser = RobotFileParser(HOST + "/robots.txt")
    text = body.decode("utf-8", errors="replace")
    try:
        parser.parse(text.splitlines() if text.strip() else ["User-agent: *", "Disallow:"])
        return parser.can_fetch(AGENT, url)
    except ValueError:
        return "robots_unparseable"


def decisions(spark, cases):
    """``cases``: list of (status, body, url); every case gets an origin of its own."""
    pages, files = [], []
    for number, (status, body, url) in enumerate(cases):
        origin = f"https://o{number}.example"
        files.append((origin, status, body, datetime(2026, 1, 1)))
        pages.append((number, origin, url))
    captures = spark.createDataFrame(
        files, "origin string, status_code int, body binary, fetched_at timestamp"
    )
    rules = robots.rules_for_agent(robots.robots_rules(captures), AGENT)
    frame = spark.createDataFrame(pages, "n int, origin string, url string")
    rows = robots.decide(frame, "url", rules).collect()
    return {row["n"]: row["robots_reason"] for row in rows}


LINES = [
    "User-agent: *", "User-agent: example", "user-agent: Example-Agent", "USER-AGENT : other",
    "User-agent:", "Disallow: /", "Disallow:", "Allow: /public", "Disallow: /private",
    "Disallow: /a%2Fb", "Allow: /a b", "Disallow: *", "Disallow: /*.html$", "Crawl-delay: 3",
    "Request-rate: 1/5", "Sitemap: https://x/y", "# note", "   ", "", "", "Disallow: /p?q=1#f",
    "Allow: /é", "nonsense", "Disallow: //x", "Allow: /p;", "Disallow: /p;v=1", "Disallow: /%zz",
    "Disallow: /private # why", " Allow : /private/ok ", "Disallow: http:/private",
    "Disallow: https://news.example/private", "User-agent: agent%2A", "Disallow: /%E9x", "Disallow: //[",
]
URLS = [
    "", "/", "/public", "/private", "/private/ok", "/private/x?y", "/a/b", "/a%2Fb", "/a b", "/a%20b",
    "/x.html", "/p?q=1#f", "/p", "/p;", "/p;v=1", "/%C3%A9", "/é", "//x", "/%zz", "?", "/%E9x",
]


def test_rules_agree_with_the_interpreter(spark):
    rng = random.Random(7)
    cases = []
    for _ in range(1500):
        count = rng.randint(0, 12)
        text = rng.choice(["\n", "\n", "\r\n", "\r", "\u2028"]).join(rng.choice(LINES) for _ in range(count))
        cases.append((200, text.encode(), HOST + rng.choice(URLS)))
    got = decisions(spark, cases)
    for number, (_, body, url) in enumerate(cases):
        want = expected(body, url)
        reason = {True: None, False: "robots_disallowed"}.get(want, want)
        assert got[number] == reason, (body, url, want)


@pytest.mark.parametrize(
    ("status", "reason"),
    [
        (200, None), (204, None), (401, "robots_disallowed"), (403, "robots_disallowed"),
        (404, None), (410, None), (300, "robots_status_unsupported"),
        (400, "robots_status_unsupported"), (500, "robots_status_unsupported"),
        (None, "robots_unavailable"),
    ],
)
def test_status_policy(spark, status, reason):
    assert decisions(spark, [(status, b"", HOST + "/x")])[0] == reason


def test_invalid_utf8_is_replaced_and_bom_hides_the_first_line(spark):
    bad = b"User-agent: *\nDisallow: /\xff\nDisallow: /private"
    bom = "\ufeffUser-agent: *\nDisallow: /".encode()
    got = decisions(spark, [(200, bad, HOST + "/private"), (200, bom, HOST + "/x")])
    assert got == {0: "robots_disallowed", 1: None}


def test_first_usable_file_of_an_origin_is_kept(spark):
    files = [
        ("https://a.example", 500, b"", datetime(2026, 1, 1)),
        ("https://a.example", 200, b"User-agent: *\nDisallow: /x", datetime(2026, 1, 2)),
        ("https://a.example", 200, b"User-agent: *\nDisallow: /y", datetime(2026, 1, 3)),
    ]
    captures = spark.createDataFrame(
        files, "origin string, status_code int, body binary, fetched_at timestamp"
    )
    (row,) = robots.robots_rules(captures).collect()
    assert row["policy"] == "rules"
    assert row["groups"][0]["rules"][0]["path"] == "/x"


def test_missing_file_is_unavailable(spark):
    rules = spark.createDataFrame(
        [],
        "origin string, robots_policy string, robots_error string, "
        "robots_rules array<struct<path: string, allow: boolean>>",
    )
    frame = robots.with_origin(spark.createDataFrame([("https://h.example/x",)], "url string"), "url")
    assert robots.decide(frame, "url", rules).first()["robots_reason"] == "robots_unavailable"


@pytest.mark.parametrize(
    ("url", "origin", "reason"),
    [
        ("https://Example.com/path", "https://example.com", None),
        ("HTTP://example.com:80/", "http://example.com:80", None),
        ("https://user:secret@example.com:8443/p", "https://example.com:8443", None),
        ("https://[2001:DB8::1]:443/p", "https://[2001:db8::1]:443", None),
        ("https://example.com:0080/", "https://example.com:80", None),
        ("/relative", None, "target_url_incomplete"),
        ("https:///missing", None, "target_url_incomplete"),
        ("https://exa mple.com/", None, "target_url_incomplete"),
        ("https://example.com:bad/", None, "target_url_malformed"),
        ("https://[::1/", None, "target_url_malformed"),
    ],
)
def test_origins(spark, url, origin, reason):
    row = robots.with_origin(spark.createDataFrame([(url,)], "url string"), "url").first()
    assert (row["origin"], row["target_reason"]) == (origin, reason)


def test_long_files_do_not_overflow_the_stack(spark):
    body = ("User-agent: *\n" + "Disallow: /private/path\n" * 60_000).encode()
    got = decisions(spark, [(200, body, HOST + "/private/path/x"), (200, body, HOST + "/x")])
    assert got == {0: "robots_disallowed", 1: None}


def test_a_shuffled_skewed_lookup_gives_the_same_rows(spark):
    captures = spark.range(40).select(
        F.concat(F.lit("https://h"), "id", F.lit(".example")).alias("origin"),
        F.lit(200).alias("status_code"),
        F.lit(b"User-agent: *\nDisallow: /private").alias("body"),
        F.lit(datetime(2026, 1, 1)).alias("fetched_at"),
    )
    rules = robots.rules_for_agent(robots.robots_rules(captures), AGENT)
    host = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50)
    frame = spark.range(3000).select(
        "id", F.concat(F.lit("https://h"), host.cast("string"), F.lit(".example")).alias("origin")
    ).withColumn("url", F.concat("origin", F.when(F.col("id") % 2 == 0, "/private").otherwise("/x")))
    from articlelake.operators.joins import lookup_join

    small = lookup_join(frame, rules, "origin", spread="url")
    salted = lookup_join(
        frame, rules, "origin", spread="url", max_rows=5, hot_rows=100
    )
    columns = ["id", "origin", "url", "robots_policy"]
    first, second = small.select(*columns), salted.select(*columns)
    assert first.count() == second.count() == 3000
    assert first.exceptAll(second).count() == 0
