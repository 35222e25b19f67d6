"""Attempts, identities, decoding, user parsers, the crawl plan and the streams."""

import itertools
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articlelake.operators import attempts, capture, identity, logs, parsers, profiles, robots
from articlelake.operators.joins import hot_keys
from articlelake.plans import crawl
from articlelake.session import scratch_folder
from articlelake.sources import schemas, snapshots, tables
from articlelake.streaming import articles as streaming
from test_articles import html as markup, story

ATTEMPT = "request_id bigint, attempt_no int, method string, status_code int, error_class string"


def attempt_loop(method, steps, rule):
    """The retry loop spelled out for one request; None when the log ends too early."""
    limit = rule.max_attempts if method.upper() in ("GET", "HEAD") else 1
    for number, (status, error) in enumerate(steps[:limit], 1):
        if error in attempts.TRANSIENT_ERRORS:
            if number == limit:
                return number, "request_error", None
        elif error is not None:
            return number, "response_error" if error == "HTTPStatusError" else "request_error", None
        elif status in rule.retry_statuses:
            if number == limit:
                return number, "response_retry_exhausted", status
        else:
            return number, "response", status
    return min(limit, len(steps)), "incomplete", None


def test_attempts_equal_the_loop(spark):
    steps = [(200, None), (404, None), (503, None), (429, None), (None, "UnsupportedProtocol"),
             (None, "HTTPStatusError")] + [(None, name) for name in attempts.TRANSIENT_ERRORS[:2]]
    rule = attempts.RetryRule(max_attempts=3, backoff_base=1.0, backoff_max=1.5)
    rows, want = [], {}
    logs_of = itertools.chain(itertools.product(steps, repeat=1), itertools.product(steps, repeat=3))
    for number, (method, steps_of) in enumerate(itertools.product(("GET", "head", "post"), list(logs_of))):
        rows += [(number, at, method, *step) for at, step in enumerate(steps_of, 1)]
        want[number] = attempt_loop(method, list(steps_of), rule)
    result = attempts.resolve_attempts(spark.createDataFrame(rows, ATTEMPT), rule).collect()
    assert {row[0]: (row[1], row[2], row[3]) for row in result} == want
    waits = {1: 0.0, 2: 1.0, 3: 2.5}
    assert all(row["total_backoff"] == waits[row["attempts_used"]] for row in result)


def test_backoff_and_arguments(spark):
    rule = attempts.RetryRule(backoff_base=1.0, backoff_max=3.0)
    frame = spark.range(1, 6).select(attempts.backoff_seconds(F.col("id"), rule))
    assert [row[0] for row in frame.collect()] == [0.0, 1.0, 2.0, 3.0, 3.0]
    for bad in ({"max_attempts": 0}, {"backoff_base": -1.0}, {"backoff_base": 9.0}):
        with pytest.raises(ValueError):
            attempts.RetryRule(**bad)


def test_identities(spark):
    good = "https://agent.example/about"
    rest = 256 - len("Agent/1 (+https://example.test/)")
    cases = [
        ("Agent", "1", good, None, None), ("Agent", "1", good, good, None),
        ("", "1", good, None, "product_name_invalid"), ("in valid", "1", good, None, "product_name_invalid"),
        ("BingBot-News", "1", good, None, "product_name_imitates"), ("Agent", "", good, None, "product_version_invalid"),
        ("Agent", "1.0\n", good, None, "product_version_invalid"), ("Agent", "1.0 (x)", good, None, "product_version_invalid"),
        ("Agent", "1", "https://example.test/" + "a" * rest, None, None),
        ("Agent", "1", "https://example.test/" + "a" * (rest + 1), None, "user_agent_too_long"),
    ]
    for url in ("", "example.test/p", "http://example.test/p", "https://u:p@example.test/", "https://example.test/?q=1",
                "https://example.test/#d", "https://localhost/p", "https://machine.local/p", "https://127.0.0.1/p",
                "https://[::1]/", "https://intranet/p", "https://example.test/\x7f"):
        cases += [("Agent", "1", url, None, "project_url_invalid"), ("Agent", "1", good, url, "contact_invalid")]
    frame = spark.createDataFrame(
        [(n, *case[:4]) for n, case in enumerate(cases)],
        "n int, product_name string, product_version string, project_url string, contact string",
    )
    got = identity.audit_identities(frame).orderBy("n").collect()
    assert [row["identity_reason"] for row in got] == [case[4] for case in cases]
    assert got[1]["user_agent"] == f"Agent/1 (+{good}; contact={good})"


DECODE = [
    ({"Content-Type": "text/html"}, b"<html></html>", "utf-8", "<html></html>", None),
    ({"content-type": "TEXT/HTML; CHARSET=UTF-8"}, b"", "utf-8", "", None),
    ({"CONTENT-TYPE": "application/xhtml+xml"}, b"x", "utf-8", "x", None),
    ({"Content-Type": "text/html; charset=iso-8859-1"}, "café".encode("latin-1"), "iso8859-1", "café", None),
    ({"Content-Type": 'text/html; charset="windows-1252"'}, b"\x93a\x94", "cp1252", "“a”", None),
    ({"Content-Type": "text/html; charset=Shift_JIS"}, "日".encode("shift_jis"), "shift_jis", "日", None),
    ({"Content-Type": "text/html; charset*=utf-8''latin1"}, b"\xe9", "iso8859-1", "é", None),
    ({"Content-Type": "text/html; x=1; charset = ascii"}, b"a", "ascii", "a", None),
    ({"Content-Type": "text/html; charset=ascii"}, b"\xc3\xa9", None, None, "decoding_failed"),
    ({"Content-Type": "text/html; charset=utf-16"}, "aé".encode("utf-16"), "utf-16", "aé", None),
    ({"Content-Type": "text/html; charset=base64"}, b"YQ==", None, None, "decoding_failed"),
    ({"Content-Type": "text/html; charset=unknown-codec"}, b"x", None, None, "decoding_failed"),
    ({"Content-Type": "text/html; charset=utf-8"}, b"\xff", None, None, "decoding_failed"),
    ({"Content-Type": "text/html; charset=utf-8"}, b"\xed\xa0\x80", None, None, "decoding_failed"),
    ({"Content-Type": "text/html"}, b"\xef\xbb\xbfx", "utf-8", "\ufeffx", None),
    ({"Server": "x"}, b"x", None, None, "content_type_missing"),
    ({"Content-Type": "application/json"}, b"x", None, None, "content_type_unsupported"),
    ({"Content-Type": "text/html/x"}, b"x", None, None, "content_type_unsupported"),
    ({"Content-Type": "; charset=utf-8"}, b"x", None, None, "content_type_unsupported"),
]


def test_decoding(spark):
    rows = [
        (n, "https://h.example/", "https://h.example/", 200, headers, body, None)
        for n, (headers, body, *_) in enumerate(DECODE)
    ]
    rows.append((len(rows), "https://h.example/", "https://h.example/", 300, {"Content-Type": "text/html"}, b"", None))
    rows.append((len(rows), "https://h.example/", " ", 200, {"Content-Type": "text/html"}, b"", None))
    frame = spark.createDataFrame(
        rows, "position bigint, url string, final_url string, status_code int, "
        "response_headers map<string,string>, response_body binary, early_reason string"
    )
    got = [
        (row["encoding"], row["content"], row["document_stage_reason"])
        for row in crawl.decode(frame).orderBy("position").collect()
    ]
    assert got[: len(DECODE)] == [tuple(case[2:]) for case in DECODE]
    assert [item[2] for item in got[len(DECODE):]] == ["response_status", "document_invalid"]


def test_request_lists(spark):
    with pytest.raises(ValueError):
        tables.request_list(spark, ["https://a.example/", " \t\r\n"])
    rows = capture.normalize_requests(
        tables.request_list(spark, ["https://b.example/", "https://a.example/"], {"k": "v"})
    )
    assert [(row["position"], row["method"], row["metadata"]) for row in crawl.in_request_order(rows).collect()] == [
        (0, "GET", {"k": "v"}), (1, "GET", {"k": "v"}),
    ]


def test_user_parsers_keep_items_before_a_failure(spark):
    schema = T.StructType([T.StructField("value", T.LongType())])

    def parse(document):
        for value in range(len(document["content"])):
            yield {"value": value}
        if document["content"].endswith("!"):
            raise parsers.DocumentRejected("article_invalid")
        if document["content"].endswith("?"):
            raise RuntimeError("secret content")
        if document["content"].endswith("#"):
            yield "not a mapping"

    texts = ["", "ab", "ab!", "ab?", "ab#", "x" * 5000]
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, content string")
    rows = parsers.parse_documents(frame, parse, schema, key="n").collect()
    found = {}
    for row in sorted(rows, key=lambda row: (row["n"], row["item_pos"])):
        found.setdefault(row["n"], []).append(row["reason_code"] or row["item"]["value"])
    assert found == {
        1: [0, 1], 2: [0, 1, 2, "article_invalid"], 3: [0, 1, 2, "parser_execution"],
        4: [0, 1, 2, "parser_contract"], 5: list(range(5000)),
    }


def test_log_lines(spark):
    rows = [
        (datetime(2026, 1, 1, 12), "info", "app", None, "token=abc"),
        (datetime(2026, 1, 1, 12), "ERROR", "app", "c-1", "fine"),
        (datetime(2026, 1, 1, 12), "DEBUG", "app", "c-1", "hidden"),
    ]
    lines = logs.log_lines(spark.createDataFrame(rows, schemas.LOGS), "INFO").collect()
    assert [row["line"] for row in lines] == [
        "2026-01-01T12:00:00+0000 | INFO | app | - | token=[REDACTED]",
        "2026-01-01T12:00:00+0000 | ERROR | app | c-1 | fine",
    ]


AGENT = "Example-Agent/1.0 (+https://agent.example/about)"


def inputs(spark, count=60):
    """Requests, a third of them for one URL, with everything else they need."""
    url = "https://news.example/articles/one"
    urls = [url if n % 3 == 0 else f"https://news.example/articles/{n}" for n in range(count)]
    urls[1], urls[2], urls[4] = " ", "https:///x", "https://news.example/private/x"
    urls[5], urls[7], urls[8] = "https://foreign.example/x", "https://norobots.example/x", "http://news.example/x"
    requests = tables.requests_from(spark.createDataFrame(list(enumerate(urls)), "position bigint, url string"))
    html = markup(story(mainEntityOfPage=None), canonical=url).encode()
    responses = spark.createDataFrame(
        [(u, u, 200, {"Content-Type": "text/html"}, html, None, None, datetime(2026, 1, 1)) for u in sorted(set(urls) - {urls[10]})],
        schemas.RESPONSES,
    )
    files = [(f"{scheme}://{host}.example", 200, b"User-agent: *\nDisallow: /private", datetime(2026, 1, 1))
             for scheme, host in (("https", "news"), ("http", "news"), ("https", "foreign"))]
    rules = robots.rules_for_agent(robots.robots_rules(spark.createDataFrame(files, schemas.ROBOTS)), AGENT)
    hosts = profiles.profile_hosts(
        spark.createDataFrame([("example_news", ["news.example"], "jsonld_article", None, True, 0)], schemas.PROFILES)
    )
    return requests, responses, rules, hosts


WANT = {1: "request_url_blank", 2: "target_url_incomplete", 4: "robots_disallowed", 5: "source_unresolved",
        7: "robots_unavailable", 8: "source_unresolved", 10: "request_error"}


def test_crawl_gives_one_outcome_per_request(spark):
    requests, responses, rules, hosts = inputs(spark)
    outcomes = crawl.write_outcomes(
        crawl.crawl(requests, capture.first_responses(responses), rules, hosts), scratch_folder(spark, "t")
    )
    assert {r["position"]: r["reason_code"] for r in crawl.failed(outcomes).collect()} == WANT
    assert crawl.articles(outcomes).count() == 60 - len(WANT)
    assert [r["position"] for r in crawl.fail_fast(outcomes).collect()] == [0]
    assert set(crawl.articles(outcomes).columns) == {"position", *schemas.ARTICLE_COLUMNS}


def test_salted_response_join_keeps_every_row(spark):
    requests, responses, _, _ = inputs(spark)
    requests = requests.withColumn("url", F.when(F.col("position") % 7 > 0, F.col("url")))
    assert hot_keys(requests, "url", hot_rows=1000) is None
    hot = hot_keys(requests, "url", hot_rows=5)
    assert [row["url"] for row in hot.collect()] == ["https://news.example/articles/one"]
    sizes = responses.select(F.col("request_url").alias("url"), F.octet_length("body").alias("_bytes"))
    heavy = hot_keys(requests, "url", sizes=sizes, hot_bytes=2 * len(responses.first()["body"]))
    assert [row["url"] for row in heavy.collect()] == ["https://news.example/articles/one"] and heavy.first()["_salts"] > 2
    columns = ["position", "url", "final_url"]
    plain = capture.attach_responses(requests, responses).select(*columns)
    salted = capture.attach_responses(requests, responses, hot=hot).select(*columns)
    assert plain.count() == salted.count() == 60
    assert plain.exceptAll(salted).count() == 0
    assert plain.where("url is null and final_url is not null").count() == 0


def test_stream_equals_batch(spark):
    requests, responses, rules, hosts = inputs(spark)
    captures = capture.attach_responses(requests, responses).select(
        "position", "url", "final_url", "status_code", "response_headers", "response_body"
    )
    base = scratch_folder(spark, "stream-test")
    captures.repartition(3).write.parquet(f"{base}/landing")
    landing = spark.readStream.schema(captures.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/landing")
    streamed = streaming.stream_outcomes(landing, rules, hosts)
    streaming.write_stream(streamed, f"{base}/out", f"{base}/state").awaitTermination()
    batch = crawl.crawl_captures(captures, rules, hosts).select("position", "reason_code")
    stored = spark.read.parquet(f"{base}/out").select("position", "reason_code")
    assert stored.exceptAll(batch).count() == 0 and stored.count() == 60


def test_batches_of_a_stream_read_their_lookups(spark):
    requests, responses, rules, hosts = inputs(spark)
    captures = capture.attach_responses(requests, responses).select(
        "position", "url", "final_url", "status_code", "response_headers", "response_body"
    )
    base = scratch_folder(spark, "batches-test")
    captures.repartition(2).write.parquet(f"{base}/landing")
    landing = spark.readStream.schema(captures.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/landing")
    streaming.write_outcomes(landing, lambda _: (rules, hosts), f"{base}/out", f"{base}/state").awaitTermination()
    found = spark.read.parquet(f"{base}/out")
    assert {r["position"]: r["reason_code"] for r in crawl.failed(found).collect()} == WANT
    assert found.count() == 60 and found.select("batch").distinct().count() == 2


def test_page_bytes_move_once_when_lookups_are_large(spark):
    requests, responses, rules, hosts = inputs(spark)
    captures = capture.attach_responses(requests, responses).select(
        "position", "url", "final_url", "status_code", "response_headers", "response_body"
    )
    path = scratch_folder(spark, "captures-test")
    captures.write.parquet(path)
    captures = spark.read.parquet(path)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        outcomes = crawl.crawl_captures(captures, rules, hosts, by_url=True)
        assert {r["position"]: r["reason_code"] for r in crawl.failed(outcomes).collect()} == WANT
        assert outcomes.count() == 60
        plan = outcomes._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    scans = [line for line in plan.splitlines() if "FileScan" in line and "response_body" in line]
    assert len(scans) == 1


def test_raw_captures_are_pruned_by_day(spark):
    path = scratch_folder(spark, "raw-test")
    _, responses, _, _ = inputs(spark, 12)
    later = responses.withColumn("fetched_at", F.lit("2026-02-03 00:00:00").cast("timestamp"))
    tables.write_raw(responses.unionByName(later), path)
    found = tables.read_captures(spark, path, schemas.RESPONSES, "2026-02-01", "2026-02-28")
    assert found.count() == responses.count()
    assert "PartitionFilters: [isnotnull(capture_date" in found._jdf.queryExecution().executedPlan().toString()


def test_families_build_their_own_rows(spark):
    def family(value):
        return lambda frame: frame.withColumns({"article": F.lit(value), "article_reason": F.lit(None).cast("string")})

    frame = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "n int, parser_family string")
    built = parsers.build_items(frame, {"a": family("x"), "b": family("y")})
    assert [tuple(r) for r in built.orderBy("n").select("n", "article").collect()] == [(1, "x"), (2, "y"), (3, None)]
    assert built.columns == ["n", "parser_family", "article", "article_reason"]


def test_response_parsers_see_the_whole_contract(spark):
    requests, responses, _, _ = inputs(spark, 12)
    schema = T.StructType([T.StructField("seen", T.StringType())])

    def parse(response):
        yield {"seen": "|".join(sorted(response))}
        yield {"seen": f"{response['headers']} {response['elapsed']}"}
        yield {"seen": {}}

    rows = parsers.parse_responses(capture.attach_responses(requests, responses), parse, schema, key="position").collect()
    of = {(r["position"], r["item_pos"]): r for r in rows}
    assert len(of) == 36 and of[0, 0]["item"]["seen"] == "|".join(sorted(parsers.RESPONSE_FIELDS))
    assert of[0, 1]["item"]["seen"] == "{'Content-Type': 'text/html'} 0.0"
    assert {of[n, 2]["reason_code"] for n in range(12)} == {"parser_contract"}


def test_default_profiles_are_sound(spark):
    rows = profiles.registry(tables.default_profiles(spark)).collect()
    assert [(row["enabled"], len(row["domains"])) for row in rows] == [(True, 1), (False, 3)]


def test_robots_stream_keeps_the_first_usable_file(spark):
    base = scratch_folder(spark, "robots-test")
    body, other = b"User-agent: *\nDisallow: /a", b"User-agent: *\nDisallow: /b\nDisallow: /c"
    batches = [
        [("https://a.example", 200, body), ("https://b.example", 500, b"")],
        [("https://a.example", 200, other), ("https://b.example", 200, other)],
        [("https://b.example", 200, body), ("https://c.example", 404, b"")],
    ]
    for number, rows in enumerate(batches):
        frame = spark.createDataFrame([(*row, datetime(2026, 1, 1)) for row in rows], schemas.ROBOTS)
        frame.coalesce(1).write.mode("append").parquet(f"{base}/landing")
        landing = tables.stream_table(spark, f"{base}/landing", schemas.ROBOTS)
        streaming.write_robots_snapshots(landing, f"{base}/rules", f"{base}/state").awaitTermination()
    rows = streaming.read_robots_snapshot(spark, f"{base}/rules").collect()
    found = {row["origin"]: (row["policy"], len((row["groups"] or [{"rules": []}])[0]["rules"])) for row in rows}
    assert found == {
        "https://a.example": ("rules", 1), "https://b.example": ("rules", 2), "https://c.example": ("allow_all", 0),
    }


def test_robots_snapshot_versions(spark):
    base = scratch_folder(spark, "robots-test")
    path, when = f"{base}/rules", datetime(2026, 1, 1)

    def captures(*rows):
        return spark.createDataFrame([(*row, when) for row in rows], schemas.ROBOTS)

    def found(version=None):
        return {r["origin"]: r["policy"] for r in streaming.read_robots_snapshot(spark, path, version).collect()}

    assert snapshots.read_version(spark, path) is None and found() == {}
    for number in range(4):
        status = 500 if number == 0 else 404
        captures(("https://a.example", status, b""), (f"https://{number}.example", 200, b"x")).coalesce(1).write.mode("append").parquet(f"{base}/landing")
        landing = tables.stream_table(spark, f"{base}/landing", schemas.ROBOTS)
        streaming.write_robots_snapshots(landing, path, f"{base}/state", compact_every=3).awaitTermination()
    # Batches 0, 1 and 2 are versions 0 to 2, version 3 compacts them, batch 3 is version 4.
    listed = {r["version"]: (r["batch"], len(r["folders"])) for r in snapshots.versions(spark, path).collect()}
    assert listed == {0: (0, 1), 1: (1, 2), 2: (2, 3), 3: (None, 1), 4: (3, 2)}
    assert found(0) == {"https://a.example": "error", "https://0.example": "rules"} and found(2) == found(3)
    compacted = snapshots.read_version(spark, path, 3)
    assert compacted.count() == compacted.select("origin").distinct().count() == 4
    assert found()["https://a.example"] == "allow_all" and len(found()) == 5
    # A batch that comes again after a failure is not written twice.
    assert snapshots.commit(robots.robots_rules(captures(("https://z.example", 404, b""))), path, batch=3) == 4
    assert len(found()) == 5
    # A refresh forgets everything; pinned readers are not disturbed.
    assert robots.refresh_snapshot(captures(("https://a.example", 403, b"")), path) == 5
    assert found() == {"https://a.example": "deny_all"} and len(found(4)) == 5


def test_sinks_round_trip(spark):
    base = scratch_folder(spark, "sinks-test")
    requests, responses, rules, hosts = inputs(spark, 12)
    outcomes = crawl.write_outcomes(crawl.crawl(requests, responses, rules, hosts), f"{base}/outcomes")
    tables.write_articles(crawl.articles(outcomes), f"{base}/processed")
    tables.write_failed(crawl.failed(outcomes), f"{base}/failed")
    articles = tables.read_table(spark, f"{base}/processed", schemas.ARTICLES + ", position bigint")
    assert {row["published_at"] for row in articles.collect()} == {datetime(2031, 3, 9, 6, 15)}
    reasons = spark.read.parquet(f"{base}/failed").groupBy("reason_code").count().collect()
    assert sum(row["count"] for row in reasons) + articles.count() == 12


def test_raw_dumps_are_read_as_bytes(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"<html>\xff")
    (row,) = tables.read_raw_dumps(spark, str(tmp_path), "*.html").collect()
    assert bytes(row["body"]) == b"<html>\xff"


def test_no_request_of_the_log_is_lost(spark):
    rows = [(1, n, "GET", 503 if n < 5 else 200, None) for n in range(1, 6)]
    rows += [(2, n, "GET", 200, None) for n in range(3)]
    rows += [(3, None, "GET", 200, None)]
    log = spark.createDataFrame(rows, ATTEMPT)
    found = {r["request_id"]: r for r in attempts.resolve_attempts(log, attempts.RetryRule(max_attempts=5)).collect()}
    assert (found[1]["outcome"], found[1]["attempts_used"], found[1]["final_status"]) == ("response", 5, 200)
    assert {found[k]["outcome"] for k in (2, 3)} == {"bad_attempt_numbers"}
    numbered = attempts.number_attempts(log.drop("attempt_no").withColumn("ts", F.monotonically_increasing_id()))
    assert numbered.count() == len(rows)


def test_log_lines_keep_unknown_levels_and_empty_fields(spark):
    rows = [("NOTICE", None, "a"), ("DEBUG", "app", "b"), (None, "app", None), ("ERROR", "app", "c")]
    events = spark.createDataFrame(rows, "level string, logger string, message string")
    events = events.withColumn("ts", F.lit("2030-01-02 03:04:05").cast("timestamp")).withColumn("correlation_id", F.lit(None).cast("string"))
    got = [r["line"].split(" | ")[1:] for r in logs.log_lines(events, "INFO").collect()]
    assert got == [["NOTICE", "", "-", "a"], ["", "app", "-", ""], ["ERROR", "app", "-", "c"]]
