"""State of streams: attempts with timers, identities per window, captures that come again."""

from datetime import datetime, timedelta

import pytest

from articlelake.operators import attempts, identity
from articlelake.plans.catalog import QUERIES
from articlelake.session import scratch_folder
from articlelake.streaming import articles as streaming

NOON = datetime(2024, 1, 1, 12)
ATTEMPTS = "request_id long, attempt_no int, method string, status_code int, error_class string, ts timestamp"
LOG = "ts timestamp, origin string, user_agent string"
CAPTURES = "position long, url string, status_code int, fetched_at timestamp"


def at(minutes):
    return NOON + timedelta(minutes=minutes)


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def landed(spark, schema, batches, base):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(base)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(base)


def emitted(spark, frame, base):
    streaming.write_stream(frame, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out")


def test_attempts_wait_for_their_timer(spark, few_partitions):
    first = [
        (1, 1, "get", 503, None, at(0)),
        (2, 2, "get", 200, None, at(1)),  # comes before its first attempt
        (3, 1, "get", None, "ReadTimeout", at(2)),  # nothing ends it
        (4, 0, "get", 200, None, at(3)),
        (5, 1, "get", 503, None, at(4)),
        (9, 1, "get", 200, None, None),  # no time
    ]
    second = [(1, 2, "get", 200, None, at(5)), (2, 1, "get", 503, None, at(0)), (7, 1, "get", 404, None, at(100))]
    third = [
        (5, 2, "get", 200, None, at(101)),  # its timer has run out: a row of its own
        (8, 1, "get", 200, None, at(300)),  # stays open
    ]
    fourth = [(6, 1, "get", 200, None, at(1))]  # behind the watermark
    base = scratch_folder(spark, "attempts-test")
    stream = landed(spark, ATTEMPTS, [first, second, third, fourth], f"{base}/log")
    rows = emitted(spark, attempts.resolve_attempt_stream(stream, idle="10 minutes", delay="30 minutes"), base).collect()
    found = sorted((r["request_id"], r["attempts_used"], r["outcome"], r["final_status"]) for r in rows)
    assert [f[:3] for f in found] == [
        (1, 2, "response"), (2, 2, "response"), (3, 1, "incomplete"), (4, 0, "bad_attempt_numbers"),
        (5, 1, "incomplete"), (5, 2, "response"), (7, 1, "response"),
    ]
    batch = spark.createDataFrame([r for r in first + second if r[5]], ATTEMPTS)
    expected = attempts.resolve_attempts(batch).where("request_id < 5").collect()
    assert sorted(map(tuple, expected)) == sorted(tuple(r) for r in rows if r["request_id"] < 5)
    timed = attempts.resolve_attempt_stream(spark.createDataFrame(first + second, ATTEMPTS)).where("request_id < 5").collect()
    assert sorted(map(tuple, timed)) == sorted(map(tuple, expected))


def test_identities_close_with_the_slower_log(spark, few_partitions):
    pages = [
        [(at(0), "a", "X"), (at(1), "b", "X"), (at(2), "c", "X"), (at(3), "d", "X")],
        [(at(2), "d", "Y"), (at(200), "e", "X")],  # late, but its window is open
        [(at(900), None, None)],
        [(at(901), None, None)],
        [(at(1), "b", "Z"), (at(902), None, None)],  # behind the watermark
    ]
    robots = [
        [(at(0), "a", "X"), (at(1), "b", "Y")],
        [(at(4), "d", "X"), (at(200), "e", "Y")],
        [(at(900), None, None)],
        [(at(901), None, None)],
        [(at(902), "c", "Y")],  # a later window
    ]
    base = scratch_folder(spark, "identity-test")
    logs = [landed(spark, LOG, rows, f"{base}/{name}") for name, rows in (("pages", pages), ("robots", robots))]
    rows = emitted(spark, identity.windowed_disagreements(*logs, window="6 hours", delay="30 minutes"), base).collect()
    found = {r["origin"]: (r["page_agents"], r["robots_agents"], r["agents"]) for r in rows}
    assert found == {"b": (1, 1, 2), "d": (2, 1, 2), "e": (1, 1, 2)}


def test_an_earlier_batch_keeps_its_captures(spark, few_partitions):
    batches = [
        [(1, "https://a/", 200, at(0)), (2, None, 200, at(0)), (3, None, 200, at(0))],
        [(4, "https://a/", 500, at(5)), (5, "https://b/", 200, at(5)), (6, "p2", 200, at(6))],
        [(7, "https://b/", 404, at(1)), (8, None, 200, at(9)), (9, "https://a/", 500, at(9))],
    ]
    base = scratch_folder(spark, "captures-test")
    stream = landed(spark, CAPTURES, batches, f"{base}/landing")
    rows = emitted(spark, streaming.first_captures(stream), base).collect()
    assert sorted(r["position"] for r in rows) == [1, 2, 3, 5, 6, 8]
    assert set(rows[0].asDict()) == {"position", "url", "status_code"}


@pytest.mark.parametrize("parts", [1, 3])
def test_streams_read_tables_of_part_files(spark, few_partitions, tmp_path, parts):
    documents = [(n, f"Some words of text {n}.", "en", f"src{n % 2}", 20) for n in range(12)]
    pages = [(n, f"https://host{n % 4}.example/en/{n}", "<p>x") for n in range(12)]
    for name, rows, schema in (
        ("documents", documents, "doc_id long, text string, lang string, source string, n_chars long"),
        ("pages", pages, "page_id long, url string, html string"),
    ):
        spark.createDataFrame(rows, schema).repartition(parts).write.parquet(f"{tmp_path}/{name}.parquet")
    outcomes = QUERIES["stream_articles"](spark, str(tmp_path)).collect()
    assert sum(r["rows"] for r in outcomes) == 12
    assert QUERIES["stream_robots"](spark, str(tmp_path)).count() == 4
