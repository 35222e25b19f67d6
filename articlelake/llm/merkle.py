"""Merkle manifest of a table by butterfly exchange.

A row is a leaf: the hash of its fields. In each source, leaves ascend by doc_id; every
``FANOUT`` consecutive nodes become their hash until one, the subroot, is left. Subroots in
the order of their sources are the leaves of one more tree, which ends in the root.

1. Leaves are hashed where the texts lie; only ids and digests move from then on. They are
   range-partitioned by source and doc_id, and places in a source come from the sums of the
   partitions before, so no source, however large, is ordered in one task.
2. Aligned runs of ``FANOUT ** LEVELS`` leaves are blocks. Each hashes its own subtree.
3. Butterfly: in round r, blocks whose numbers differ in digit r alone (base ``FANOUT``)
   swap their subtree roots, and each hashes the parent for itself. After the last round
   every block has the root and the siblings of all its ancestors; nothing is sent down. In
   a last group that is not full, blocks stand in for the missing ones in turn.
4. The subroots take the same three steps, and each leaf joins both parts of its proof.

A round moves ``FANOUT`` digests per block, and is a written table. Null doc_ids come first
and null sources form the first source; rows that tie in doc_id go by their leaf, equal rows
count each. Null doc_ids are never tampered with. An empty table gives no rows. Other columns
are neither read nor hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import map_rows, stored

FANOUT = 3
#: A block has this many levels, so at most FANOUT ** LEVELS leaves.
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(fields: dict[str, Column]) -> Column:
    """Hash of all fields; each is its byte count, a colon and its value, or ``-``."""
    parts = [F.coalesce(F.concat(F.octet_length(c), F.lit(":"), c), F.lit("-")) for c in (v.cast("string") for v in fields.values())]
    return F.sha2(F.concat(*parts), 256)


def _digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def grow(leaves: list[str], height: int) -> list[list[str]]:
    """All levels of a subtree, from the leaves up, ``height`` levels above them."""
    levels = [leaves]
    for _ in range(height):
        below = levels[-1]
        levels.append([_digest(below[k : k + FANOUT]) for k in range(0, len(below), FANOUT)])
    return levels


def siblings(levels: list[list[str]], at: int) -> Iterator[tuple[str, str]]:
    """What stands before and after the leaf ``at`` in its run, level by level."""
    for nodes in levels[:-1]:
        first = at - at % FANOUT
        yield "".join(nodes[first:at]), "".join(nodes[at + 1 : first + FANOUT])
        at //= FANOUT


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for before, after in path:
        leaf = _digest([before, leaf, after])
    return leaf


def _height(count: Column) -> Column:
    """Levels above ``count`` nodes of one block until one is left."""
    powers = F.array(*(F.lit(FANOUT**k) for k in range(LEVELS + 1)))
    return F.size(F.filter(powers, lambda power: power < count))


def numbered(frame: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``place`` (from 0 in its group, by ``order``) and ``count`` (rows of the group).

    ``group`` has no nulls. Rows are range-partitioned; a window only sees one number per
    group and partition.
    """
    from pyspark.sql import Window

    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = frame.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    at = F.monotonically_increasing_id()
    ranged = stored(ranged.withColumn("_part", F.shiftright(at, 33)).withColumn("_at", at), "merkle-order")
    counts = ranged.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"), F.sum("_n").over(whole).alias("count")
    )
    placed = ranged.join(stored(offsets, "merkle-offsets"), [group, "_part"])
    return placed.withColumn("place", F.col("_at") + F.col("_offset")).drop("_part", "_at", "_offset")


def blocks(placed: DataFrame, group: str, items: list[str]) -> tuple[DataFrame, DataFrame]:
    """Blocks (group, block, blocks, height, ``items`` by place) and their nodes (group, block, blocks, node)."""
    size = FANOUT**LEVELS
    gathered = placed.groupBy(group, F.expr(f"place div {size}").alias("block"), "count").agg(
        F.array_sort(F.collect_list(F.struct("place", *items))).alias("items")
    )  # never more than ``size`` items
    height = F.when(F.col("count") > size, F.lit(LEVELS)).otherwise(_height(F.col("count")))
    shaped = gathered.select(
        group, "block", F.expr(f"(count + {size - 1}) div {size}").alias("blocks"), height.alias("height"), "items"
    )
    shaped = stored(shaped, "merkle-blocks")
    raised = map_rows(
        shaped.select(group, "block", "blocks", "height", F.col("items.leaf").alias("leaves")),
        lambda: lambda key, block, number, up, leaves: [(key, block, number, grow(leaves, up)[-1][0])],
        "group string, block long, blocks long, node string",
    )
    return shaped, stored(raised, "merkle-nodes")


def butterfly(nodes: DataFrame) -> DataFrame:
    """(group, block, node, path): the root of each group and the siblings above each block.

    ``nodes`` has group, block, blocks and node, the root of the block's own subtree.
    """
    state = nodes.withColumn("path", F.array().cast("array<struct<before:string,after:string>>"))
    most = nodes.agg(F.max("blocks")).first()[0] or 0
    width = 1
    while width < most:
        # The subtrees of the own run, and in each the block that swaps with this one.
        waiting = state.filter(F.col("blocks") > width)
        base = F.expr(f"block div {width * FANOUT} * {FANOUT}")
        digits = F.filter(F.sequence(F.lit(0), F.lit(FANOUT - 1)), lambda d: (base + d) * width < F.col("blocks"))
        asked = waiting.select("group", "block", "blocks", F.explode(digits).alias("digit"))
        subtree = F.expr(f"block div {width * FANOUT} * {FANOUT} + digit")
        filled = F.least(F.lit(width), F.col("blocks") - subtree * width)
        partner = subtree * width + F.pmod(F.col("block"), F.lit(width)) % filled
        sent = state.select("group", F.col("block").alias("partner"), "node")
        met = asked.withColumn("partner", partner).join(sent, ["group", "partner"])
        runs = met.groupBy("group", "block").agg(F.array_sort(F.collect_list(F.struct("digit", "node"))).alias("run"))
        own = F.expr(f"block div {width} % {FANOUT}")

        def part(keep):
            return F.array_join(F.transform(F.filter("run", keep), lambda m: m["node"]), "")

        swapped = waiting.drop("node").join(runs, ["group", "block"]).select(
            "group", "block", "blocks", F.sha2(part(lambda m: m["digit"] >= 0), 256).alias("node"),
            F.concat("path", F.array(F.struct(part(lambda m: m["digit"] < own).alias("before"), part(lambda m: m["digit"] > own).alias("after")))).alias("path"),
        )
        state = stored(swapped.unionByName(state.filter(F.col("blocks") <= width)), "merkle-round")
        width *= FANOUT
    return state.select("group", "block", "node", "path")


def manifest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    The folded root is that of the untampered siblings and the row's own leaf, which is
    tampered with (text without line ends) where two divides the crc32 of doc_id.
    """
    fields = {c: F.col(c) for c in FIELDS}
    changed = {**fields, "text": F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(""))}
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    # A key without nulls in the same order: no source, then sources by their bytes.
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    leaves = docs.select(key.alias("group"), F.col("doc_id").cast("long").alias("doc_id"), leaf_hash(fields).alias("leaf"), F.when(tampered, leaf_hash(changed)).alias("tampered"))
    leaves = stored(leaves, "merkle-leaves")

    parts, nodes = blocks(numbered(leaves, "group", ["doc_id", "leaf", "tampered"]), "group", ["doc_id", "leaf", "tampered"])
    climbed = butterfly(nodes)

    # The tree over all subroots.
    subroots = climbed.filter("block = 0").select(F.lit("").alias("group"), F.col("group").alias("source"), F.col("node").alias("leaf"))
    top_parts, top_nodes = blocks(numbered(stored(subroots, "merkle-subroots"), "group", ["source"]), "group", ["source", "leaf"])
    top = top_parts.join(butterfly(top_nodes), ["group", "block"])

    def unfold():
        def rows(height, sources, subroots, root, path):
            upper = [(p["before"], p["after"]) for p in path]
            levels = grow(subroots, height)
            for at, (source, subroot) in enumerate(zip(sources, subroots, strict=True)):
                both = [*siblings(levels, at), *upper]
                yield source, subroot, root, [{"before": b, "after": a} for b, a in both]

        return rows

    tops = map_rows(
        top.select("height", "items.source", "items.leaf", "node", "path"),
        unfold,
        "group string, subroot string, root string, top array<struct<before:string,after:string>>",
    )
    proofs = climbed.join(stored(tops, "merkle-top"), "group").select("group", "block", "subroot", "root", F.concat("path", "top").alias("path"))

    def prove():
        def rows(height, ids, leaves, others, subroot, root, path):
            upper = [(p["before"], p["after"]) for p in path]
            levels = grow(leaves, height)
            for at, (doc_id, leaf, other) in enumerate(zip(ids, leaves, others, strict=True)):
                whole = [*siblings(levels, at), *upper]
                back = folded(leaf if other is None else other, whole)
                yield doc_id, leaf, subroot, root, _digest([x for pair in whole for x in pair]), back, back == root

        return rows

    return map_rows(
        parts.join(proofs, ["group", "block"]).select("height", "items.doc_id", "items.leaf", "items.tampered", "subroot", "root", "path"),
        prove,
        "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    )
