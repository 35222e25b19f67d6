"""Counting quotient filters and exact deduplication of whole texts.

Each task puts the fingerprints of its texts into counting quotient filters, one per shard
of the fingerprint space. Filters of a shard hold sorted remainders under their quotients,
so they merge by one pass over both, without loss and without the texts. Fingerprints whose
merged count is above one go to byte verification: only those texts are grouped by
their bytes, with a partial count in every task, so a text that fills a third of the table
moves once per task.

A null text equals an empty one. Of equal texts the row with the largest doc_id stays, a
null doc_id being smallest; of rows that repeat both, one stays. An empty table gives no
rows. Other columns are carried along unread, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import map_rows, stored, text_or_empty

#: Fingerprints that a task holds before it writes filters.
HELD = 1 << 22


class CountingQuotientFilter:
    """A static counting quotient filter over ``width``-bit fingerprints.

    The high bits of a fingerprint, its quotient, select a run of slots; the slot keeps the
    low bits, the remainder. ``occupied`` marks quotients that have a run and ``ends`` the
    last slot of each run, both in order, so the n-th occupied quotient owns the run up to
    the n-th end. ``counted`` marks slots with a count above one; their counts follow in
    slot order.
    """

    def __init__(self, width: int, quotient_bits: int, occupied, ends, remainders, counted, counts) -> None:
        self.width, self.quotient_bits = width, quotient_bits
        self.occupied, self.ends, self.remainders = occupied, ends, remainders
        self.counted, self.counts = counted, counts

    @classmethod
    def build(cls, width: int, values: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        """From distinct sorted fingerprints and their counts."""
        quotient_bits = min(width, max(1, int(len(values) - 1).bit_length()))
        low = np.uint64(width - quotient_bits)
        quotients = (values >> low).astype(np.int64)
        occupied = np.zeros(1 << quotient_bits, dtype=bool)
        occupied[quotients] = True
        ends = np.append(quotients[1:] != quotients[:-1], True)[: len(values)]
        remainders = values & np.uint64((1 << int(low)) - 1)
        counted = counts > 1
        return cls(width, quotient_bits, occupied, ends, remainders, counted, counts[counted])

    def values(self) -> tuple[np.ndarray, np.ndarray]:
        """All fingerprints in order, and their counts."""
        run = np.cumsum(self.ends) - self.ends
        quotients = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        counts = np.ones(len(self.remainders), dtype=np.int64)
        counts[self.counted] = self.counts
        return quotients << np.uint64(self.width - self.quotient_bits) | self.remainders, counts

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        values, counts = (np.concatenate(x) for x in zip(self.values(), other.values(), strict=True))
        return self.build(self.width, *summed(values, counts))

    def to_bytes(self) -> bytes:
        low = -(-(self.width - self.quotient_bits) // 8)
        slots = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low]
        head = np.array([self.width, self.quotient_bits, len(self.remainders), len(self.counts)], dtype="<i8")
        bits = (np.packbits(x).tobytes() for x in (self.occupied, self.ends, self.counted))
        return b"".join([head.tobytes(), *bits, slots.tobytes(), self.counts.astype("<i8").tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        width, quotient_bits, slots, n_counts = np.frombuffer(data, dtype="<i8", count=4).tolist()
        at = 32
        parts = []
        for size in (1 << quotient_bits, slots, slots):
            raw = np.frombuffer(data, dtype=np.uint8, count=-(-size // 8), offset=at)
            parts.append(np.unpackbits(raw, count=size).astype(bool))
            at += len(raw)
        low = -(-(width - quotient_bits) // 8)
        wide = np.zeros((slots, 8), dtype=np.uint8)
        wide[:, :low] = np.frombuffer(data, dtype=np.uint8, count=slots * low, offset=at).reshape(slots, low)
        counts = np.frombuffer(data, dtype="<i8", count=n_counts, offset=at + slots * low)
        return cls(width, quotient_bits, parts[0], parts[1], wide.view("<u8").ravel(), parts[2], counts)


def summed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted values with the sums of their counts."""
    if not len(values):
        return values, counts
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[first], np.add.reduceat(counts, first)


def repeated(fingerprints: DataFrame, shard_bits: int) -> DataFrame:
    """Fingerprints (one long column) that occur more than once, with their counts."""
    width = 64 - shard_bits

    def build():
        held: list[int] = []

        def close():
            if not held:
                return
            values = np.array(held, dtype=np.int64).view(np.uint64)
            held.clear()
            values, counts = np.unique(values, return_counts=True)
            shards = (values >> np.uint64(width)).astype(np.int64)
            cuts = np.flatnonzero(np.append(True, shards[1:] != shards[:-1]))
            for begin, end in zip(cuts, [*cuts[1:], len(values)], strict=True):
                inner = values[begin:end] & np.uint64((1 << width) - 1)
                part = CountingQuotientFilter.build(width, inner, counts[begin:end])
                yield int(shards[begin]), part.to_bytes()

        def rows(fingerprint):
            held.append(fingerprint)
            if len(held) >= HELD:
                yield from close()

        rows.finish = close
        return rows

    def merge():
        state: dict = {"shard": None, "filter": None}

        def close():
            if state["filter"] is not None:
                values, counts = state["filter"].values()
                values = values[counts > 1] | np.uint64(state["shard"] << width)
                yield from zip(values.view(np.int64).tolist(), counts[counts > 1].tolist(), strict=True)

        def rows(shard, data):
            part = CountingQuotientFilter.from_bytes(data)
            if shard == state["shard"]:
                state["filter"] = state["filter"].merge(part)
            else:
                yield from close()
                state.update(shard=shard, filter=part)

        rows.finish = close
        return rows

    filters = map_rows(fingerprints, build, "shard long, filter binary")
    ordered = filters.repartition("shard").sortWithinPartitions("shard")
    return map_rows(ordered, merge, "fingerprint long, n long")


def mark_copies(docs: DataFrame) -> DataFrame:
    """Each row as a struct ``row``, with keep_id, group_size, kept and text_sha256."""
    spark = docs.sparkSession
    # At least four shards per shuffle partition, so that a shard stays small.
    shard_bits = max(8, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    whole = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        text_or_empty().alias("text"),
    ).withColumn("fingerprint", F.xxhash64("text"))
    copied = stored(repeated(whole.select("fingerprint"), shard_bits).select("fingerprint"), "copied")
    verified = (
        whole.join(copied, "fingerprint", "left_semi")
        .groupBy("fingerprint", "text")
        .agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
        .filter("group_size > 1")
        .select("fingerprint", F.sha2("text", 256).alias("text_sha256"), "group_size", "keep_id")
    )
    groups = stored(verified, "copy-groups")
    keyed = whole.select("row", "doc_id", "fingerprint", F.sha2("text", 256).alias("text_sha256"))
    marked = keyed.join(groups, ["fingerprint", "text_sha256"], "left")
    marked = marked.withColumn("last", F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")))
    # Rows that repeat text and doc_id are rare; only they are numbered.
    again = stored(
        marked.filter("group_size > 1 AND last").groupBy("fingerprint", "text_sha256").count().filter("count > 1")
        .select("fingerprint", "text_sha256", F.lit(True).alias("again")),
        "copy-ties",
    )
    if again.isEmpty():
        marked = marked.withColumn("kept", F.col("last"))
    else:
        marked = marked.join(again, ["fingerprint", "text_sha256"], "left")
        tied = F.coalesce(F.col("again") & F.col("last"), F.lit(False))
        number = F.row_number().over(Window.partitionBy("fingerprint", "text_sha256").orderBy(F.lit(0)))
        ties = marked.filter(tied).withColumn("kept", number == 1)
        marked = marked.filter(~tied).withColumn("kept", F.col("last")).unionByName(ties)
    return marked.select(
        "row",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        "kept",
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with their columns."""
    return mark_copies(docs).filter("kept").select("row.*")
