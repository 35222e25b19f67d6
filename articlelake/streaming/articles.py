"""Articles and robots snapshots from landing folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from articlelake.operators.robots import robots_rules
from articlelake.plans import crawl
from articlelake.sources import snapshots


def stream_outcomes(
    captures: DataFrame, agent_rules: DataFrame, hosts: DataFrame, *, idna: bool = True
) -> DataFrame:
    """The batch columns over a stream of captures; lookups are static tables.

    Nothing is kept between batches, so no watermark or state is needed.
    """
    return crawl.crawl_captures(captures, agent_rules, hosts, idna=idna)


def first_captures(captures: DataFrame, within: str = "7 days") -> DataFrame:
    """Captures of a stream without those of a URL that an earlier batch has had.

    The state holds one key per URL until the watermark of ``fetched_at`` passes its capture
    by ``within``; no body is kept. Of several captures of a URL in one batch one stays, so
    choose inside a landing file first (``capture.first_responses``) if they may differ. Rows
    without a URL all stay, by their position.
    """
    key = F.coalesce(F.concat(F.lit("u"), F.col("url")), F.concat(F.lit("p"), F.col("position").cast("string")))
    timed = captures.withColumn("_key", key).withWatermark("fetched_at", within)
    return timed.dropDuplicatesWithinWatermark(["_key"]).drop("_key", "fetched_at")


def write_outcomes(
    captures: DataFrame,
    lookups: Callable[[SparkSession], tuple[DataFrame, DataFrame]],
    path: str,
    checkpoint: str,
    **trigger,
) -> StreamingQuery:
    """Outcomes of a stream of captures, each batch by the whole batch plan.

    ``lookups`` gives agent rules and hosts and is called for every batch, so a new robots
    snapshot counts from the next batch on, and large lookups and hot keys are handled as
    in a batch. A batch that is repeated after a failure replaces its own folder.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        outcomes = crawl.crawl_captures(batch, *lookups(batch.sparkSession))
        outcomes.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        captures.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(append)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def write_stream(frame: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream to a Parquet folder, exactly once, through its checkpoint."""
    return (
        frame.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )


def write_robots_snapshots(
    captures: DataFrame, path: str, checkpoint: str, *, compact_every: int = 100, **trigger
) -> StreamingQuery:
    """Keep the first usable robots file of every origin in a growing, versioned snapshot.

    Each batch is first reduced to one file per origin inside its tasks, so that a busy
    origin costs one row in the shuffle, and then leaves out the origins already stored. The
    snapshot is the state: between compactions it has at most two rows per origin, as a
    failed file is stored once and does not keep a later usable one out. Each batch is one
    version (``snapshots``); after ``compact_every`` folders a version with one row per
    origin follows.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        rules = robots_rules(batch)
        earlier = snapshots.read_version(batch.sparkSession, path)
        if earlier is not None:
            known = earlier.select(F.col("origin").alias("_origin"), (F.col("policy") != "error").alias("_usable"))
            settled = (F.col("origin") == F.col("_origin")) & (F.col("_usable") | (F.col("policy") == "error"))
            rules = rules.join(known, settled, "left_anti")
        snapshots.commit(rules, path, batch=batch_id)
        if len(snapshots.manifest(batch.sparkSession, path)["folders"]) >= compact_every:
            compact_robots_snapshot(batch.sparkSession, path)

    return (
        captures.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(append)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_robots_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One row per origin: the first usable rules, else the first failure.

    ``version`` pins a version; by default the latest is read. Before the first commit there
    are no rows.
    """
    rows = snapshots.read_version(spark, path, version)
    if rows is None:
        empty = spark.createDataFrame([], "origin string, status_code int, body binary, fetched_at timestamp")
        return robots_rules(empty)
    order = F.struct(F.col("policy") == "error", "added")
    return (
        rows.groupBy("origin")
        .agg(F.min_by(F.struct("policy", "reason", "groups"), order).alias("_first"))
        .select("origin", "_first.*")
    )


def compact_robots_snapshot(spark: SparkSession, path: str) -> int:
    """A version of one folder, with one row per origin."""
    return snapshots.commit(read_robots_snapshot(spark, path), path, replace=True)
