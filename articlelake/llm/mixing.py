"""Mix sources to target weights with a low-discrepancy schedule of equal-token blocks.

The documents of a source lie on a line in shuffled order, cut into blocks of equally many
words. The mix is a row of slots. Slot i has the golden-ratio point frac(i * phi), which
falls into one source's interval of the cumulative targets; its rank among the slots of that
source selects the block. After the last block a source begins again. The last slot of a
source is cut so that its words meet the target to the word, and the few slots that the
point sequence owes a source are put at the end.

Everything is DataFrame operations. Ranks and running sums go over chunks first and then
inside a chunk, so the slots or documents of a source that has a third of all rows are
never in one group.

A null text has size 0, and documents of size 0 are never taken. A null source is a source
of its own, the last one. Repeated rows lie on the line one after the other. Without words
all targets are 0; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words, and how often a document may be taken.
TOTAL, MOST = 1.5, 2
BLOCK_WORDS = 256
#: phi as a share of 2 to the 31, made odd, so that points repeat only after 2 to the 31 slots.
STEP, PERIOD = 1327217885, 1 << 31
#: Slots per chunk when ranks are counted, and chunks of a source's shuffled line.
CHUNK, LINE_CHUNKS = 1 << 16, 1 << 12
#: Equal parts of the unit interval by which points meet source intervals.
CELLS = 1 << 12


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """One row per source: number, source, source_size, target, quota (words, whole).

    Raising a common level until all words are given out, sources stop in order of
    most * size / weight; the level at the first source that does not stop is the final one.
    The windows order the table of sources, one row each.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    choice = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    table = (
        sums.withColumn("number", F.row_number().over(by_name).cast("long") - 1)
        .withColumn("weight", choice.cast("double"))
        .withColumn("cap", most * F.col("source_size").cast("double"))
        .withColumn("stop", F.col("cap") / F.col("weight"))
    )
    by_stop = Window.orderBy("stop", "number")
    everything = by_stop.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stopped = F.coalesce(F.sum("cap").over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    going = F.sum("weight").over(by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (total * F.sum(F.col("source_size").cast("double")).over(everything) - stopped) / going
    table = table.withColumn("level", level)
    final = F.first(F.when(F.col("level") < F.col("stop"), F.col("level")), ignorenulls=True).over(everything)
    target = F.least(F.col("cap"), F.coalesce(final, F.lit(0.0)) * F.col("weight"))
    return table.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(0.0)).select(
        "number", "source", "source_size", "target", F.round("target").cast("long").alias("quota")
    )


def _needed(block_words: int) -> Column:
    """Slots that bring a source to its quota."""
    rounds = F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(F.lit(0).cast("long"))
    rest = F.col("quota") - rounds * F.col("source_size")
    return rounds * F.col("blocks") + F.ceil(rest / block_words).cast("long")


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All slots of the mix: slot, number (of the source), rank, block, take (words).

    ``sources`` must be a stored table from :func:`targets`.
    """
    spark = sources.sparkSession
    plan = sources.withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    plan = plan.withColumn("needed", _needed(block_words)).filter("needed > 0")
    slots = int(plan.agg(F.sum("needed")).first()[0] or 0)
    in_order = Window.orderBy("number")
    upto = F.sum("needed").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    intervals = plan.select(
        "number",
        ((upto - F.col("needed")) / float(max(slots, 1))).alias("low"),
        (upto / float(max(slots, 1))).alias("high"),
    )
    first_cell, last_cell = (F.floor(F.col(c) * CELLS).cast("long") for c in ("low", "high"))
    cells = intervals.select("*", F.explode(F.sequence(first_cell, F.least(last_cell, F.lit(CELLS - 1)))).alias("cell"))
    point = (F.col("id") % PERIOD * STEP % PERIOD) / float(PERIOD)
    drawn = (
        spark.range(slots)
        .select(F.col("id").alias("slot"), point.alias("point"))
        .withColumn("cell", F.floor(F.col("point") * CELLS).cast("long"))
        .join(cells, "cell")
        .filter("point >= low AND point < high")
        .select("slot", "number", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    )
    counts = stored(drawn.groupBy("number", "chunk").agg(F.count("*").alias("n")), "slot-counts")
    earlier = Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("number", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("number", "chunk").orderBy("slot"))
    ranked = drawn.withColumn("inside", inside).join(before, ["number", "chunk"])
    ranked = ranked.select("slot", "number", (F.col("before") + F.col("inside") - 1).alias("rank"))
    owed = (
        plan.join(counts.groupBy("number").agg(F.sum("n").alias("drawn")), "number", "left")
        .withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("long")))
        .filter("drawn < needed")
        .select("number", F.explode(F.sequence("drawn", F.col("needed") - 1)).alias("rank"))
        .select((F.lit(slots) + F.col("rank")).alias("slot"), "number", "rank")
    )
    full = ranked.unionByName(owed).join(plan, "number").filter("rank < needed")
    block = F.col("rank") % F.col("blocks")
    words_before = F.expr("rank div blocks") * F.col("source_size") + block * block_words
    length = F.least(F.lit(block_words).cast("long"), F.col("source_size") - block * block_words)
    return full.select(
        "slot", "number", "rank", block.alias("block"), F.least(length, F.col("quota") - words_before).alias("take")
    ).filter("take > 0")


def mix(docs: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, size, source_size, target and taken."""
    sized = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
        ),
        "sizes",
    )
    sources = stored(targets(sized), "targets")
    numbered = sized.join(sources.select("number", F.col("source").alias("_source")), F.col("source").eqNullSafe(F.col("_source")))
    placed = numbered.select("doc_id", "number", "size", F.xxhash64("doc_id", F.lit(seed)).alias("order"))
    placed = stored(placed.withColumn("part", F.shiftright("order", 64 - (LINE_CHUNKS.bit_length() - 1))), "line")
    sums = placed.groupBy("number", "part").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("number").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("number", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("number", "part").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    line = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(before, ["number", "part"])
    line = stored(
        line.select("doc_id", "number", "size", (F.col("before") + F.col("inside")).alias("begin"))
        .withColumn("row", F.monotonically_increasing_id()), "placed-line",
    )
    # A block is taken whole by all slots but one, the last of its source.
    whole = F.least(F.lit(block_words).cast("long"), F.col("source_size") - F.col("block") * block_words)
    slots = schedule(sources, block_words).join(sources.select("number", "source_size"), "number")
    blocks = slots.groupBy("number", "block").agg(
        F.count(F.when(F.col("take") == whole, 1)).alias("rounds"),
        F.coalesce(F.max(F.when(F.col("take") < whole, F.col("take"))), F.lit(0).cast("long")).alias("cut"),
    )
    last_block = F.expr(f"(begin + size - 1) div {block_words}")
    parts = line.filter("size > 0").select(
        "row", "number", "begin", "size", F.explode(F.sequence(F.expr(f"begin div {block_words}"), last_block)).alias("block")
    )
    at = F.col("block") * block_words
    begin, end = F.greatest(F.col("begin"), at), F.least(F.col("begin") + F.col("size"), at + block_words)
    share = F.col("rounds") * (end - begin) + F.greatest(F.lit(0).cast("long"), F.least(end, at + F.col("cut")) - begin)
    taken = parts.join(blocks, ["number", "block"]).groupBy("row").agg(F.sum(share).alias("taken"))
    return (
        line.join(taken, "row", "left")
        .join(sources, "number")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    )


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The documents of the mix, a row each time one is taken.

    A document whose taken words are at least half of its size (or of a second reading)
    comes whole; only the document at which a source's quota ends is taken in part.
    Repeated rows share what is taken of their doc_id.
    """
    drawn = mix(docs, seed).filter("taken > 0").groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    copies = F.round(F.col("_taken") / F.col("_size")).cast("int")
    drawn = drawn.select(F.col("doc_id").alias("_id"), F.col("taken").alias("_taken"), F.col("size").alias("_size"))
    chosen = docs.join(drawn, F.col("doc_id").eqNullSafe(F.col("_id"))).filter(copies > 0)
    return chosen.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).select(*(f"`{c}`" for c in docs.columns))
