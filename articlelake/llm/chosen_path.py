"""Near-duplicate components by a chosen-path set similarity join.

A document is its set of word shingles, and a sketch of ``TOKENS`` minwise tokens of the set;
two sets agree in a token with the probability of their Jaccard similarity.

1. Each of ``TREES`` independent trees starts with all sets in its root. A node selects each
   token with probability ``1 / (share * TOKENS)`` by a hash of its own name; a set goes to
   the child of each selected token's value. The name of a child is a hash of its path, so
   sets find their nodes without any exchange. Linked sets stay together in at least one
   child per node on average; the unlike are dealt apart. Comparisons begin two levels below
   the roots, where sets that share no more than a passage have parted.
2. Nodes whose sets are all in one component end. A node is small if its sets have at most
   ``SMALL`` (later ``WIDE``) others outside of their components on average; then its sets meet
   in one task, which compares all sketches across components and gives back only sets that
   are near. In a larger one, all sets are compared with one leader, the set of most
   links so far, and unless that leaves one component, the node branches again. Sets of the leader's component that are too close to
   the leader to be linked to any other set of the node stay behind: Jaccard distance obeys
   the triangle inequality.
3. Candidates whose sketches agree far too little are dropped, the others are confirmed on
   full sets: in pairs where a set has at most ``PAIRS`` of them in its node, else by an index
   of the shingles of all such sets of the node, which gives back a link only if it joins two
   components. Links of all trees together form components, and pairs in one component need
   no comparison, so neither copies nor near copies ever give all their pairs.

After ``DEPTH`` levels, sets of several components that are still together are compared
across components, ``BLOCK_SETS`` sets at a time. A pair at the threshold meets in a tree with probability 0.47 while
nodes are small, so missing all ``TREES`` trees has a probability of about 4e-5; in deep
nodes a tree finds it with about 0.2. Trees depend on nothing but the sets: reruns agree.

Texts are read whole. A null or wordless text has an empty set and links with nothing; its
component is its own doc_id. Rows that repeat a doc_id count each with their own text. A
null doc_id stays null unless its group has another. An empty table gives no rows; other
columns are ignored. Shingles, sets and texts are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articlelake.operators.joins import fits_broadcast

from .components import components
from .shingles import mix, shingle_set
from .tables import map_rows, stored, text_or_empty

WORDS, SHARE = 4, 80  # shingle width; 100 * intersection >= SHARE * union
TOKENS, TREES, DEPTH = 64, 16, 8
#: In a node compared in full, a set has so many sets of other components on average: at
#: first, when each set is a component of its own, and once links are known.
SMALL, WIDE = 8, 1024
#: Near sets of a set in a small node that are confirmed pair by pair.
PAIRS = 4
#: Sets outside of the largest component, and all sets, that are compared in one task, and bytes of their shingles.
BLOCK_SETS, BLOCK_ROWS, BLOCK_BYTES = 1 << 10, 1 << 12, 16 << 20
#: A candidate below so many equal tokens is no link: 4.3 standard deviations below a pair at 80 %.
LEAST_EQUAL = 38
#: Rows of one key that one task takes; keys of more get their facts by broadcast.
HOT_ROWS = 200_000
#: Pairs of one set that are confirmed in one task.
PAIRS_PER_TASK = 1000

_RANDOM = np.random.default_rng(20_240_611)
_FACTORS = _RANDOM.integers(0, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _RANDOM.integers(0, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2)
_PLACES = mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BLOCK = 1 << 11


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The minwise token of a set under each of ``TOKENS`` hash functions, in 16 bits."""
    least = np.full(TOKENS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for begin in range(0, len(shingles), _BLOCK):
        block = (shingles[None, begin : begin + _BLOCK] ^ _MASKS[:, None]) * _FACTORS[:, None]
        np.minimum(least, block.min(axis=1), out=least)
    return (mix(least) >> np.uint64(48)).astype("<u2")


def _limit(share: int) -> np.uint64:
    return np.uint64(int(2.0**64 / (share / 100 * TOKENS)))


def selected(node: np.uint64, share: int = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that a node selects, and the names they give its children."""
    draw = mix(_PLACES ^ node)
    chosen = np.flatnonzero(draw < _limit(share))
    return chosen, draw[chosen]


def children(chosen: np.ndarray, draw: np.ndarray, tokens: np.ndarray) -> list[int]:
    """Names of the children that a set with these tokens goes to."""
    return mix(draw + tokens[chosen].astype(np.uint64)).view(np.int64).tolist()


def roots(share: int = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """What the roots of all trees select."""
    trees = [selected(node, share) for node in mix(np.arange(1, TREES + 1, dtype=np.uint64) << np.uint64(32))]
    return tuple(np.concatenate(x) for x in zip(*trees, strict=True))


def first_nodes(trees: tuple[np.ndarray, np.ndarray], tokens: np.ndarray, share: int = SHARE) -> list[int]:
    """The nodes of a set two levels below the roots."""
    nodes = mix(trees[1] + tokens[trees[0]].astype(np.uint64))
    draw = mix(_PLACES[None, :] ^ nodes[:, None])
    row, chosen = np.nonzero(draw < _limit(share))
    return mix(draw[row, chosen] + tokens[chosen].astype(np.uint64)).view(np.int64).tolist()


def sketches(docs: DataFrame, words: int, share: int) -> DataFrame:
    """Per document: doc_id, text_key, n, set_id, tokens, and its nodes two levels below all roots."""

    def start():
        trees = roots(share)

        def rows(doc_id, key, text):
            found = shingle_set(text, words)
            if not len(found):
                yield doc_id, key, 0, None, None, []
                return
            set_id = int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)
            tokens = sketch(found)
            yield doc_id, key, len(found), set_id, tokens.tobytes(), first_nodes(trees, tokens, share)

        return rows

    frame = keyed(docs).select("doc_id", "text_key", "text")
    return map_rows(frame, start, "doc_id long, text_key long, n long, set_id long, tokens binary, nodes array<long>")


def keyed(docs: DataFrame) -> DataFrame:
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return text.withColumn("text_key", F.xxhash64("text"))


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(set_id, text) of the ``chosen`` rows (set_id, doc_id, text_key), one row for each.

    Rows without a doc_id are first merged by text in their tasks.
    """
    rows = keyed(docs)
    named = rows.join(chosen.filter("doc_id IS NOT NULL"), ["doc_id", "text_key"]).select("set_id", "text")
    nameless = rows.filter("doc_id IS NULL").groupBy("text_key").agg(F.min("text").alias("text"))
    nameless = nameless.join(chosen.filter("doc_id IS NULL").select("set_id", "text_key"), "text_key").select("set_id", "text")
    return named.unionByName(nameless)


def estimated(pairs: DataFrame) -> DataFrame:
    """(a, b, equal) for pairs with the tokens of both: how many of them are equal."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, t = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype="<u2").reshape(-1, TOKENS) for k in (2, 3))
            equal = pa.array((s == t).sum(axis=1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), equal], names=["a", "b", "equal"])

    return pairs.select("a", "b", "tokens_a", "tokens_b").mapInArrow(compare, "a long, b long, equal int")


def compared(small: DataFrame, tokens: DataFrame) -> DataFrame:
    """What is near in small nodes, by sketches: node, block, a, b, equal, component and own.

    A set with few near sets gives a row for each of these pairs. One with more (``own``) gives
    a row without b, and so does each of its near sets. Sets outside of the largest component
    meet all others; nodes of very many such sets, or sets, are cut into blocks.
    """
    outside = F.col("component") != F.col("main")
    cuts = F.ceil(F.col("outsiders") / BLOCK_SETS)
    parts = F.ceil(F.col("size") / BLOCK_ROWS)
    cell = F.explode(F.sequence(F.lit(0).cast("long"), cuts * parts - 1)).alias("block")
    dealt = small.select("node", "set_id", "component", outside.alias("outside"), cuts.alias("cuts"), parts.alias("parts"), cell)
    place = F.xxhash64("set_id", F.lit("block"))
    own = F.col("outside") & (F.pmod(place, F.col("cuts")) == F.pmod(F.col("block"), F.col("cuts")))
    other = F.pmod(place, F.col("parts")) == F.floor(F.col("block") / F.col("cuts"))
    dealt = dealt.select("node", "block", "set_id", "component", "outside", own.alias("own"), other.alias("other")).filter("own OR other")
    met = dealt.join(tokens, "set_id").repartition("node", "block").sortWithinPartitions("node", "block")
    met = met.select("node", "block", "set_id", "component", "outside", "own", "other", "n", "tokens")
    return met.mapInArrow(_near_sets, "node long, block long, a long, b long, equal int, component long, own boolean")


_NEAR = ["node", "block", "a", "b", "equal", "component", "own"]
_NEAR_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()]


def _near_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    last = None

    def ends(batch: pa.RecordBatch) -> np.ndarray:
        node, block = (batch.column(k).to_numpy() for k in (0, 1))
        return np.flatnonzero((node[1:] != node[:-1]) | (block[1:] != block[:-1])) + 1

    for batch in batches:
        if not batch.num_rows:
            continue
        first = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
        cut = ends(batch)
        if last is not None and first != last:
            yield from _near_in_groups(held)
            held = []
        if len(cut):
            # Whole nodes are compared; the last one may go on in the next batch.
            yield from _near_in_groups([*held, batch.slice(0, cut[-1])])
            held = [batch.slice(cut[-1])]
        else:
            held.append(batch)
        last = batch.column(0)[-1].as_py(), batch.column(1)[-1].as_py()
    yield from _near_in_groups(held)


def _near_in_groups(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    node, block, sets, component, outside, own, other, n = (table.column(k).to_numpy() for k in range(8))
    tokens = np.frombuffer(b"".join(table.column(8).to_pylist()), dtype="<u2").reshape(-1, TOKENS)
    cuts = np.flatnonzero((node[1:] != node[:-1]) | (block[1:] != block[:-1])) + 1
    starts = np.concatenate([[0], cuts])
    sizes = np.diff(np.concatenate([starts, [len(node)]]))
    of = np.repeat(np.arange(len(starts)), sizes)
    a_rows = np.flatnonzero(own)
    # Each such set meets the rows of its group, in slices of pairs.
    many = sizes[of[a_rows]]
    edges, found = np.concatenate([[0], np.cumsum(many)]), []
    at = 0
    while at < len(a_rows):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + (1 << 16), side="right")) - 1)
        chosen, repeats = a_rows[at:to], many[at:to]
        left = np.repeat(chosen, repeats)
        right = np.arange(len(left)) - np.repeat(edges[at:to] - edges[at], repeats) + np.repeat(starts[of[chosen]], repeats)
        keep = other[right] & (component[left] != component[right]) & (~outside[right] | (sets[left] < sets[right]))
        left, right = left[keep], right[keep]
        equal = (tokens[left] == tokens[right]).sum(axis=1)
        near = equal >= LEAST_EQUAL
        found.append((left[near], right[near], equal[near]))
        at = to
    left, right, equal = (np.concatenate([f[k] for f in found]) if found else np.empty(0, dtype=np.int64) for k in range(3))
    counts = np.bincount(left, minlength=len(node))
    few = counts[left] <= PAIRS
    rows = [_near_rows(node[left[few]], block[left[few]], sets[left[few]], sets[right[few]], equal[few], component[left[few]], np.ones(int(few.sum()), dtype=bool))]
    left, right = left[~few], right[~few]
    if len(left):
        # Crowded sets are dealt into blocks of so many bytes of shingles; a near set goes to each block it is needed in.
        crowded = np.flatnonzero(counts > PAIRS)
        weight = np.cumsum(n[crowded] * 8)
        begin = np.searchsorted(of[crowded], of[crowded], side="left")
        part = (weight - (weight - n[crowded] * 8)[begin]) // BLOCK_BYTES
        part_of = np.zeros(len(node), dtype=np.int64)
        part_of[crowded] = part
        to = np.unique(np.stack([right, part_of[left]], axis=1), axis=0)
        # A set that is crowded itself stands in its own block already.
        to = to[~((counts[to[:, 0]] > PAIRS) & (part_of[to[:, 0]] == to[:, 1]))]
        row, sub = np.concatenate([crowded, to[:, 0]]), np.concatenate([part, to[:, 1]])
        owns = np.arange(len(row)) < len(crowded)
        rows.append(_near_rows(node[row], block[row] << 20 | sub, sets[row], None, None, component[row], owns))
    yield from rows


def _near_rows(node, block, a, b, equal, component, own) -> pa.RecordBatch:
    columns = (node, block, a, b, equal, component, own)
    arrays = [pa.nulls(len(node), t) if c is None else pa.array(c).cast(t) for c, t in zip(columns, _NEAR_TYPES, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=_NEAR)


def joining(crowds: DataFrame, shingled: DataFrame, share: int) -> DataFrame:
    """Links (a, b, overlap, n_a, n_b) that join the components of crowded sets and their near sets.

    In each block the crowded sets come first and are indexed by shingle; every set is looked
    up there, and a link is given if its ends are not yet joined in this block.
    """

    met = crowds.join(shingled.withColumnRenamed("set_id", "a"), "a")
    met = met.repartition("node", "block").sortWithinPartitions("node", "block", F.col("own").desc(), "a")

    def start():
        state = {"at": None, "crowd": [], "index": None}

        def look_up(set_id, component, values):
            index = state["index"]
            place = np.minimum(np.searchsorted(index["shingles"], values), len(index["shingles"]) - 1)
            place = place[index["shingles"][place] == values]
            begin, many = index["starts"][place], index["starts"][place + 1] - index["starts"][place]
            steps = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            overlap = np.bincount(index["sets"][np.repeat(begin, many) + steps], minlength=len(index["n"]))
            linked = (100 + share) * overlap >= share * (index["n"] + len(values))
            roots = state["roots"]
            while component in state["renamed"]:
                component = state["renamed"][component]
            linked &= roots != component
            while linked.any():
                k = int(np.argmax(linked))
                old = roots[k]
                yield index["ids"][k], set_id, int(overlap[k]), int(index["n"][k]), len(values)
                linked &= roots != old
                roots[roots == old] = component
                state["renamed"][int(old)] = component

        def built():
            crowd = state["crowd"]
            sets = np.repeat(np.arange(len(crowd)), [len(c[2]) for c in crowd])
            every = np.concatenate([c[2] for c in crowd])
            order = np.argsort(every, kind="stable")
            shingles, starts = np.unique(every[order], return_index=True)
            state["index"] = {
                "shingles": shingles, "starts": np.append(starts, len(every)), "sets": sets[order],
                "n": np.array([len(c[2]) for c in crowd]), "ids": [c[0] for c in crowd],
            }
            state["roots"], state["renamed"] = np.array([c[1] for c in crowd], dtype=np.int64), {}
            state["crowd"] = []
            for set_id, component, values in crowd:
                yield from look_up(set_id, component, values)

        def rows(node, block, a, component, own, shingles):
            if state["at"] != (node, block):
                if state["crowd"]:
                    yield from built()
                state["at"], state["index"] = (node, block), None
            values = np.frombuffer(shingles, dtype=np.uint64)
            if own:
                state["crowd"].append((a, component, values))
                return
            if state["index"] is None:
                yield from built()
            yield from look_up(a, component, values)

        rows.finish = lambda: built() if state["crowd"] else ()
        return rows

    return map_rows(met.select("node", "block", "a", "component", "own", "shingles"), start, "a long, b long, overlap long, n_a long, n_b long")


def sets_of(needed: DataFrame, docs: DataFrame, unique: DataFrame, words: int) -> DataFrame:
    """(set_id, shingles) of the needed set_ids, stored."""
    chosen = unique.join(needed.distinct(), "set_id", "left_semi").select("set_id", "doc_id", "text_key")

    def cut():
        def rows(set_id, text):
            yield set_id, shingle_set(text, words).tobytes()

        return rows

    return stored(map_rows(texts_of(docs, chosen), cut, "set_id long, shingles binary").dropDuplicates(["set_id"]), "path-sets")


def confirmed(pairs: DataFrame, shingled: DataFrame) -> DataFrame:
    """(a, b, overlap, n_a, n_b) on full sets.

    Each set b travels to its a, which is held once there; an a of very many pairs has
    several places.
    """
    places = F.floor(F.col("degree") / PAIRS_PER_TASK) + 1
    degrees = stored(pairs.groupBy("a").agg(F.count("*").alias("degree")).withColumn("places", places), "path-degrees")
    others = with_facts(pairs, degrees, "a", "degree", degrees.agg(F.max("degree")).first()[0] or 0).withColumn("place", F.pmod(F.xxhash64("b"), F.col("places")))
    others = others.join(shingled.withColumnRenamed("set_id", "b"), "b").select("a", "place", "b", "shingles")
    own = degrees.join(shingled.withColumnRenamed("set_id", "a"), "a").select(
        "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("places") - 1)).alias("place"), F.lit(None).cast("long").alias("b"), "shingles"
    )
    met = others.unionByName(own).repartition("a", "place").sortWithinPartitions("a", "place", F.col("b").asc_nulls_first())

    def compare():
        state: dict = {}

        def rows(a, b, shingles):
            values = np.frombuffer(shingles, dtype=np.uint64)
            if b is None:
                state["own"] = values
            else:
                own = state["own"]
                yield a, b, len(np.intersect1d(own, values, assume_unique=True)), len(own), len(values)

        return rows

    return map_rows(met.select("a", "b", "shingles"), compare, "a long, b long, overlap long, n_a long, n_b long")


def with_facts(rows: DataFrame, facts: DataFrame, key: str, size: str, largest: int) -> DataFrame:
    """Rows joined to the facts of their key; a key of very many rows is not shuffled.

    ``facts`` is a stored table with the number of rows of each key, ``largest`` the largest.
    Keys of more than ``HOT_ROWS`` are fewer than one in so many rows, and are broadcast once
    measured.
    """
    hot = facts.filter(F.col(size) > HOT_ROWS)
    if largest <= HOT_ROWS or not fits_broadcast(hot):
        return rows.join(facts, key)
    cool = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.filter(F.col(size) <= HOT_ROWS), key)
    return cool.unionByName(rows.join(F.broadcast(hot), key))


def named(frame: DataFrame, side: str, *columns: str) -> DataFrame:
    """The set as ``side``, and its columns with the side in their names."""
    return frame.select(F.col("set_id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns))


def links(unique: DataFrame, docs: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """Links (a, b) that join the sets of each component; ``unique`` has a row per set."""
    tokens = unique.select("set_id", "tokens", "n")
    entries = unique.select(F.explode("nodes").alias("node"), "set_id", F.col("set_id").alias("component"), F.lit(0).cast("long").alias("degree"))
    checked = known = None
    for depth in range(1, DEPTH + 2):
        rank = F.struct(-F.col("degree"), F.xxhash64("set_id", F.lit(depth)), "set_id")
        parts = entries.groupBy("node", "component").agg(F.count("*").alias("n"), F.min(rank).alias("first"))
        facts = parts.groupBy("node").agg(
            F.sum("n").alias("size"), F.min("first")["set_id"].alias("leader"), F.max(F.struct("n", "component"))["component"].alias("main"),
            (F.pow(F.sum("n"), F.lit(2)) - F.sum(F.col("n") * F.col("n"))).alias("across"), (F.sum("n") - F.max("n")).alias("outsiders"),
        )
        few = F.lit(depth > DEPTH) | (F.col("across") <= 2 * (SMALL if depth == 1 else WIDE) * F.col("size"))
        facts = stored(facts.filter("across > 0").select("node", "size", "leader", "main", "outsiders", few.alias("few")), "path-nodes")
        largest, ended = facts.agg(F.coalesce(F.max("size"), F.lit(0)), F.coalesce(F.bool_and("few"), F.lit(True))).first()
        entries = stored(with_facts(entries, facts, "node", "size", largest), "path-entries")

        # Small nodes: what is near across components.
        near = stored(compared(entries.filter("few"), tokens), "path-near")
        pairs = near.filter("b IS NOT NULL").select("a", "b", "equal", F.lit(None).cast("long").alias("hub"))
        crowds = near.filter("b IS NULL").select("node", "block", "a", "component", "own")
        if not ended:
            # In large nodes, the leader meets each other set.
            leaders = facts.filter("not few").select("node", "size", F.col("leader").alias("a")).join(named(tokens, "a", "tokens"), "a")
            leaders = stored(leaders, "path-leaders")
            large = entries.filter("not few").select("node", "set_id", "leader")
            led = with_facts(large.select("node", F.col("set_id").alias("b")), leaders, "node", "size", largest).filter("a <> b")
            led = estimated(led.select("a", "b", "tokens_a").distinct().join(named(tokens, "b", "tokens"), "b"))
            pairs = pairs.unionByName(led.withColumn("hub", F.col("a")))

        # A pair is confirmed once, at its leader if it has one.
        pairs = pairs.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.max("hub").alias("hub"), F.max("equal").alias("equal"))
        if checked is not None:
            pairs = pairs.join(checked.select("low", "high"), ["low", "high"], "left_anti")
        pairs = stored(pairs, "path-pairs")
        hub = F.coalesce("hub", "low")
        likely = pairs.filter(F.col("equal") >= LEAST_EQUAL).select(hub.alias("a"), F.when(hub == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b"))
        likely = stored(likely, "path-likely")
        needed = likely.select(F.col("a").alias("set_id")).union(likely.select("b")).union(crowds.select("a"))
        shingled = sets_of(needed, docs, unique, words)
        new = stored(confirmed(likely, shingled).unionByName(joining(crowds, shingled, share)), "path-confirmed")
        checked = pairs if checked is None else checked.unionByName(pairs)
        known = new if known is None else known.unionByName(new)
        linked = known.filter((100 + share) * F.col("overlap") >= share * (F.col("n_a") + F.col("n_b"))).select("a", "b")
        if ended:
            break
        degrees = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
        grouped = components(linked).join(degrees, "node").select(F.col("node").alias("set_id"), F.col("component").alias("joined"), "degree")
        grouped = stored(grouped, "path-components")
        large = joined(large, grouped, "set_id", "component")
        leaders = leaders.select("node", "size", F.col("a").alias("set_id"))
        leaders = stored(joined(leaders, grouped, "set_id", "main").select("node", "main", "size"), "path-leaders")
        left = apart(with_facts(large, leaders, "node", "size", largest), checked, known, largest, share)
        entries = branched(left, tokens, share)
    return linked


def joined(rows: DataFrame, grouped: DataFrame, key: str, name: str) -> DataFrame:
    return rows.join(grouped.withColumnRenamed("set_id", key), key, "left").withColumn(name, F.coalesce("joined", key)).drop("joined")


def apart(large: DataFrame, checked: DataFrame, known: DataFrame, largest: int, share: int) -> DataFrame:
    """Entries of nodes with several components, without sets too near to the leader to link outside.

    ``main`` is the component of the leader. Its sets at distance d from the leader are at
    least D - d away from a set at distance D. Unconfirmed distances are at least what the
    sketch gives within 4.3 standard deviations.
    """
    low, high = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
    exact = known.select(low, high, (1 - F.col("overlap") / (F.col("n_a") + F.col("n_b") - F.col("overlap"))).alias("exact"))
    slack = 4.3 * math.sqrt(0.25 / TOKENS)
    ends = checked.join(exact, ["low", "high"], "left").select(
        "low", "high", "exact", F.coalesce("exact", F.greatest(F.lit(1 - share / 100), 1 - slack - F.col("equal") / TOKENS)).alias("least")
    )
    low, high = F.least("set_id", "leader").alias("low"), F.greatest("set_id", "leader").alias("high")
    measured = large.select("*", low, high).join(ends, ["low", "high"], "left").drop("low", "high")
    measured = stored(measured, "path-measured")
    outside = F.col("component") != F.col("main")
    nearest = measured.groupBy("node").agg(F.min(F.when(outside, F.coalesce("least", F.lit(0.0)))).alias("nearest"), F.max("size").alias("size"))
    nearest = stored(nearest.filter("nearest IS NOT NULL"), "path-nearest")
    placed = with_facts(measured.drop("size"), nearest, "node", "size", largest)
    distance = F.when(F.col("set_id") == F.col("leader"), F.lit(0.0)).otherwise(F.col("exact"))
    # A little is given for rounding.
    near = F.coalesce(F.col("nearest") - distance <= 1 - share / 100 + 1e-9, F.lit(True))
    return placed.filter(outside | near).select("node", "set_id", "component", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def branched(entries: DataFrame, tokens: DataFrame, share: int) -> DataFrame:
    def start():
        def rows(node, set_id, component, degree, values):
            for child in children(*selected(np.uint64(node & 0xFFFFFFFFFFFFFFFF), share), np.frombuffer(values, dtype="<u2")):
                yield child, set_id, component, degree

        return rows

    carried = entries.join(tokens.drop("n"), "set_id").select("node", "set_id", "component", "degree", "tokens")
    return stored(map_rows(carried, start, "node long, set_id long, component long, degree long"), "path-children")


def join(docs: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id and kept."""
    docs = docs.select("doc_id", "text")
    found = stored(sketches(docs, words, share), "path-sketches")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("first")
    unique = found.filter("n > 0").groupBy("set_id").agg(first, F.first("tokens").alias("tokens"), F.first("nodes").alias("nodes"), F.first("n").alias("n"))
    unique = stored(unique.select("set_id", "first.doc_id", "first.text_key", "tokens", "nodes", "n"), "path-unique")
    grouped = components(links(unique, docs, words, share))
    labels = unique.join(grouped.withColumnRenamed("node", "set_id"), "set_id", "left").select("set_id", "doc_id", F.coalesce("component", "set_id").alias("component"))
    labels = stored(labels, "path-labels")
    smallest = labels.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = labels.join(smallest, "component").select("set_id", "component_id")
    labelled = found.select("doc_id", "n", "set_id").join(by_set, "set_id", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return labelled.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
