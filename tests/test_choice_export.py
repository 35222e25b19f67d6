"""Choosing captures without their bytes, and ordered exports."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from articlelake.operators import capture, choice
from articlelake.session import scratch_folder
from articlelake.sources import schemas, tables


def captures(spark):
    draw = random.Random(3)
    day = datetime.datetime(2024, 1, 1)
    rows = []
    for k in range(400):
        url = None if k % 50 == 0 else f"https://a.example/{draw.randint(0, 60)}"
        body = None if k % 9 == 0 else b"x" * draw.randint(0, 2000) + str(k).encode()
        rows.append((url, f"https://a.example/{k}", draw.choice([200, 404, None]), {"A": str(k)}, body, draw.random(), {}, day + datetime.timedelta(hours=draw.randint(0, 30)) if k % 11 else None))
    rows += rows[:20]  # repeated rows tie in everything
    frame = spark.createDataFrame(rows, schemas.RESPONSES).repartition(5)
    path = scratch_folder(spark, "captures")
    frame.write.parquet(path)
    return rows, path


def winners(rows):
    def order(row):
        return tuple((v is not None, v) for v in (row[7], row[2], row[1], row[5]))

    best = {}
    for row in rows:
        if row[0] not in best or order(row) < order(best[row[0]]):
            best[row[0]] = row
    return sorted((repr(r[0]), r[1], r[2], r[4] and bytes(r[4])) for r in best.values())


def found(frame):
    return sorted((repr(r["request_url"]), r["final_url"], r["status_code"], r["body"] and bytes(r["body"])) for r in frame.collect())


@pytest.mark.parametrize("in_files", [True, False])
@pytest.mark.parametrize("max_bytes", [1 << 26, 0])
def test_first_capture_of_every_url(spark, in_files, max_bytes):
    rows, path = captures(spark)
    table = tables.read_table(spark, path, schemas.RESPONSES)
    order = {name: F.col(name) for name in ("fetched_at", "status_code", "final_url", "elapsed")}
    chosen = choice.first_rows(table, "request_url", order, in_files=in_files, max_bytes=max_bytes)
    assert chosen.columns == table.columns and found(chosen) == winners(rows)
    assert choice.first_rows(table.limit(0), "request_url", order).count() == 0


def test_bodies_are_neither_sorted_nor_exchanged(spark):
    _, path = captures(spark)
    table = tables.read_table(spark, path, schemas.RESPONSES)
    responses = capture.first_responses(table, in_files=True)
    responses.count()
    plan = responses._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "ObjectHashAggregate" not in plan
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_the_first_pass_reads_narrow_columns_only(spark, monkeypatch):
    _, path = captures(spark)
    seen = []
    monkeypatch.setattr(choice, "stored", lambda frame, name: seen.append(frame) or __import__("articlelake.session", fromlist=["x"]).stored(frame, name))
    capture.first_responses(tables.read_table(spark, path, schemas.RESPONSES), in_files=True)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.rindex("ReadSchema") :]
    assert "fetched_at" in read and "body" not in read and "headers" not in read


@pytest.mark.parametrize("parts", [1, 7])
def test_ordered_export_reads_back_in_order(spark, parts):
    path = scratch_folder(spark, "ordered")
    numbers = random.Random(5).sample(range(10_000), 500)
    rows = spark.createDataFrame([(n, f"t{n}") for n in numbers], "position long, url string").repartition(6)
    tables.write_ordered(rows, path, "position", parts)
    manifest = tables.read_manifest(spark, path).orderBy("part").collect()
    assert sum(m["rows"] for m in manifest) == 500 and len(manifest) <= parts
    assert all(a["last"] < b["first"] for a, b in zip(manifest, manifest[1:], strict=False))
    lines = {r["line"]: r["position"] for r in tables.read_ordered(spark, path, "position").collect()}
    assert [lines[k] for k in range(1, 501)] == sorted(numbers)
    wanted = [(k, n) for k, n in enumerate(sorted(numbers), 1) if 2000 <= n <= 4000]
    some = tables.read_ordered(spark, path, "position", 2000, 4000)
    assert sorted((r["line"], r["position"]) for r in some.collect()) == wanted
    if parts == 7:
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [part#" in plan and "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert tables.read_ordered(spark, path, "position", 20_000).count() == 0


def test_empty_ordered_export(spark):
    path = scratch_folder(spark, "ordered")
    tables.write_ordered(spark.createDataFrame([], "position long, url string"), path, "position")
    assert tables.read_manifest(spark, path).count() == 0
    assert tables.read_ordered(spark, path, "position").columns == ["part", "position", "url", "line"]
    assert tables.read_ordered(spark, path, "position").count() == 0
