"""Exact Jaccard self-join of documents on word shingles, by set relations.

1. Every shingle gets a level from its exact count over all documents. Levels are kept in a
   table of fixed size, one byte for each bucket of hashes (the largest level in it), so
   what is broadcast does not grow; a coarser table only makes lists longer.
2. Rare shingles first, a set's prefix is so long that two linked sets share a shingle of
   both prefixes. Sets with equal shingles are one set. Shingles that occur once get no list.
3. Short lists give pairs, skipped by size and by position in the prefix.
4. In long lists each set is first compared with the first of a few random small crews, then
   with one leader, the set of the list with most links. Linked sets form components. A list
   whose sets are all in one component is done. In the others, sets are kept in
   blocks by component, size, position and distance to the leader, and pairs of blocks are
   skipped when they have met in an earlier list, or when their positions or the answers
   already computed for the leader rule a link out: |s & t| <= min(|s & l|, |t & l|) + min(|s - l|, |t - l|). For pairs of sets the
   answer is derived more closely from their differences to the leader. Pairs that may still
   be links are verified, so no link between two components is lost, and pairs inside a
   component, of which a group of copies has very many, are never made.

Texts are read whole. A null or wordless text has an empty set and links with nothing; its
component is its own doc_id. Rows that repeat a doc_id count each with their own text. A
null doc_id stays null unless its group has another. An empty table gives no rows; other
columns are ignored. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shingles import shingle_set
from .tables import map_rows, stored, text_or_empty

WORDS, SHARE = 5, 80  # shingle width; 100 * intersection >= SHARE * union
#: The table of levels has 2 to this power bytes.
LEVEL_BITS = 25
#: A list of more sets goes by its leader first.
SHORT_LIST = 48
#: In a long list, sets are first compared inside so many random draws of crews of about this size.
DRAWS, CREW = 3, 16
#: So many of a set's first lists are remembered, to skip pairs of blocks that met in one of them.
REMEMBERED = 3
#: Pairs of one set that are verified in one task.
PAIRS_PER_TASK = 1000
#: Shingles that a task holds before it passes them on.
HELD = 1 << 21


def levels(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """One byte per bucket of hashes: 0 if all its shingles occur once, else by the largest count."""
    spark = docs.sparkSession
    range_bits = min(LEVEL_BITS, max(8, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))

    def gather():
        held: list[np.ndarray] = []
        state = {"n": 0}

        def close():
            if not held:
                return
            values = np.sort(np.concatenate(held))
            held.clear()
            state["n"] = 0
            ranges = (values >> np.uint64(64 - range_bits)).astype(np.int64)
            low = (values >> np.uint64(32 - range_bits)).astype("<u4")
            cuts = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1]))
            for begin, end in zip(cuts, [*cuts[1:], len(values)], strict=True):
                yield int(ranges[begin]), low[begin:end].tobytes()

        def rows(text):
            found = shingle_set(text, words)
            if len(found):
                held.append(found)
                state["n"] += len(found)
            if state["n"] >= HELD:
                yield from close()

        rows.finish = close
        return rows

    def count():
        state: dict = {"range": None, "held": []}

        def close():
            if state["held"]:
                low, n = np.unique(np.frombuffer(b"".join(state["held"]), dtype="<u4"), return_counts=True)
                level = np.where(n > 1, np.minimum(255, 1 + np.floor(8 * np.log2(n))), 0).astype(np.uint8)
                table = np.zeros(1 << (LEVEL_BITS - range_bits), dtype=np.uint8)
                np.maximum.at(table, low[level > 0] >> np.uint32(32 - LEVEL_BITS + range_bits), level[level > 0])
                yield state["range"], zlib.compress(table.tobytes(), 1)
            state["held"] = []

        def rows(number, data):
            if number != state["range"]:
                yield from close()
                state["range"] = number
            state["held"].append(data)

        rows.finish = close
        return rows

    parts = map_rows(docs.select(text_or_empty()), gather, "range long, data binary")
    merged = map_rows(parts.repartition("range").sortWithinPartitions("range"), count, "range long, data binary")
    table = np.zeros((1 << range_bits, 1 << (LEVEL_BITS - range_bits)), dtype=np.uint8)
    for row in merged.collect():  # 2 to the LEVEL_BITS bytes in all, before compression
        table[row["range"]] = np.frombuffer(zlib.decompress(row["data"]), dtype=np.uint8)
    return table.ravel()


def _read(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def sets(docs: DataFrame, table: np.ndarray, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """Per document: doc_id, text_hash, n, set_id and the listed shingles of its prefix with their places."""
    shared = docs.sparkSession.sparkContext.broadcast(table.tobytes())

    def start():
        level_of = np.frombuffer(shared.value, dtype=np.uint8)

        def rows(doc_id, text_hash, text):
            found = shingle_set(text, words)
            n = len(found)
            if not n:
                yield doc_id, text_hash, 0, None, [], []
                return
            level = level_of[(found >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)]
            prefix = n - -(-share * n // 100) + 1
            order = np.lexsort((found, level))[:prefix]
            places = np.flatnonzero(level[order] > 0)
            set_id = int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)
            yield doc_id, text_hash, n, set_id, found[order[places]].view(np.int64).tolist(), places.tolist()

        return rows

    schema = "doc_id long, text_hash long, n long, set_id long, shingles array<long>, places array<long>"
    return map_rows(_read(docs), start, schema)


def texts_of(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """set_id and text of each row (set_id, doc_id, text_hash).

    A doc_id alone does not name a text, as it may be null or repeated. Copies without an id
    are reduced to one before they meet their row.
    """
    read = _read(docs)
    wanted = rows.select("set_id", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    named = wanted.join(read, (F.col("_id") == F.col("doc_id")) & (F.col("_hash") == F.col("text_hash")))
    nameless = read.filter("doc_id IS NULL").groupBy("text_hash").agg(F.first("text").alias("text"))
    nameless = wanted.filter("_id IS NULL").join(nameless, F.col("_hash") == F.col("text_hash"))
    return named.select("set_id", "text").unionByName(nameless.select("set_id", "text"))


def _may_link(overlap: Column, n: Column, m: Column, share: int) -> Column:
    """100 * i >= share * (n + m - i), for an upper bound of i or i itself."""
    return (100 + share) * overlap >= share * (n + m)


def difference(a: np.ndarray, b: np.ndarray) -> list[int]:
    """What b lacks of a and has besides it, by 64 cells of the hash, and the size of a.

    Each of the two is three bit maps, of the cells with at least one, two and three such
    shingles, and the number of shingles beyond.
    """
    numbers = []
    for part in (np.setdiff1d(a, b, assume_unique=True), np.setdiff1d(b, a, assume_unique=True)):
        cells = np.bincount((part >> np.uint64(58)).astype(np.int64), minlength=64)
        maps = [np.packbits(cells > k, bitorder="little").view("<i8")[0] for k in range(3)]
        numbers += [*map(int, maps), int(np.maximum(cells - 3, 0).sum())]
    return [*numbers, len(a)]


def _shared_at_most(s: Column, t: Column, overlap_s: Column, overlap_t: Column) -> Column:
    """A bound of |s & t| from what is known of both against one set l.

    |s & t & l| is |s & l| + |t & l| - |l| + |(l - s) & (l - t)|. The last term, and what s
    and t share outside of l, are at most the sums of the smaller counts in each cell.
    """
    cells = [F.bit_count(s[k].bitwiseAND(t[k])) for k in (0, 1, 2, 4, 5, 6)]
    return overlap_s + overlap_t - s[8] + sum(cells[1:], cells[0]) + F.least(s[3], t[3]) + F.least(s[7], t[7])


def overlaps(pairs: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """For each pair (a, b) overlap, the intersection size, and the difference() of both.

    ``texts`` has set_id and text of each set.

    The sets of all b are sent to the place of their a, which is held once; an a of very
    many pairs has several places.
    """
    pairs = stored(pairs.distinct(), "pairs")
    degrees = pairs.groupBy("a").agg(F.count("*").alias("degree"))
    needed = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()

    def start():
        seen = set()  # repeated rows of one set lie in one partition

        def rows(set_id, text):
            if set_id not in seen:
                seen.add(set_id)
                yield set_id, shingle_set(text, words).tobytes()

        return rows

    used = texts.join(needed, "set_id", "left_semi").select("set_id", "text")
    shingled = stored(map_rows(used, start, "set_id long, shingles binary"), "verified-sets")
    places = (F.col("degree") / PAIRS_PER_TASK).cast("long") + 1
    placed = pairs.join(degrees, "a").select("a", "b", F.pmod(F.xxhash64("b"), places).alias("place"))
    others = placed.join(shingled, placed["b"] == shingled["set_id"]).select("a", "place", "b", "shingles")
    own = degrees.join(shingled, degrees["a"] == shingled["set_id"]).select(
        "a", F.explode(F.sequence(F.lit(0).cast("long"), places - 1)).alias("place"), F.lit(None).cast("long").alias("b"), "shingles"
    )
    ordered = others.unionByName(own).repartition("a", "place").sortWithinPartitions("a", "place", F.col("b").asc_nulls_first())

    def compare():
        state: dict = {"own": None}

        def rows(a, b, shingles):
            values = np.frombuffer(shingles, dtype=np.uint64)
            if b is None:
                state["own"] = values
            else:
                yield a, b, len(np.intersect1d(state["own"], values, assume_unique=True)), difference(state["own"], values)

        return rows

    return map_rows(ordered.select("a", "b", "shingles"), compare, "a long, b long, overlap long, difference array<long>")


def links(found: DataFrame, docs: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """Links (a, b) between sets that connect the same sets as all links do.

    ``found`` is a stored table from :func:`sets`. Links inside a component may be left out.
    """
    first = F.min_by(F.struct("doc_id", "text_hash", "n", "shingles", "places"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    unique = stored(found.filter("n > 0").groupBy("set_id").agg(first.alias("first")).select("set_id", "first.*"), "unique-sets")
    entries = unique.select("set_id", "n", F.explode(F.arrays_zip("shingles", "places")).alias("e")).select(
        F.col("e.shingles").alias("shingle"), "set_id", "n", F.col("e.places").alias("place")
    )
    lengths = entries.groupBy("shingle").agg(F.count("*").alias("length")).filter("length > 1")
    lists = stored(entries.join(lengths, "shingle"), "lists")
    texts = texts_of(unique, docs)

    def both(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
        return tuple(frame.select("shingle", *(F.col(c).alias(f"{c}_{k}") for c in frame.columns if c != "shingle")) for k in "ab")

    def by_position(a: DataFrame, b: DataFrame) -> Column:
        room = F.least(a["n_a"] - a["place_a"], b["n_b"] - b["place_b"])
        return _may_link(room, a["n_a"], b["n_b"], share)

    def verified(pairs: DataFrame) -> DataFrame:
        sizes = unique.select("set_id", "n")
        counted = overlaps(pairs, texts, words)
        counted = counted.join(sizes.select(F.col("set_id").alias("a"), F.col("n").alias("n_a")), "a")
        return counted.join(sizes.select(F.col("set_id").alias("b"), F.col("n").alias("n_b")), "b")

    def is_link() -> Column:
        return _may_link(F.col("overlap"), F.col("n_a"), F.col("n_b"), share)

    a, b = both(lists.filter(F.col("length") <= SHORT_LIST).drop("length"))
    short = a.join(b, "shingle").filter((F.col("set_id_a") < F.col("set_id_b")) & by_position(a, b))
    pairs = short.select(F.col("set_id_a").alias("a"), F.col("set_id_b").alias("b"))

    long = lists.filter(F.col("length") > SHORT_LIST)
    # Draws of small crews: each set is compared with the first of its crew.
    crews = F.pmod(F.xxhash64("set_id", "draw"), F.pow(F.lit(2), F.greatest(F.ceil(F.log2(F.col("length") / CREW)), F.lit(0))).cast("long"))
    drawn = long.select("shingle", "set_id", "length", F.explode(F.sequence(F.lit(1), F.lit(DRAWS))).alias("draw"))
    drawn = drawn.select("shingle", "set_id", "draw", crews.alias("crew"))
    firsts = drawn.groupBy("shingle", "draw", "crew").agg(F.min("set_id").alias("a"))
    to_first = drawn.join(firsts, ["shingle", "draw", "crew"]).filter("a <> set_id").select("a", F.col("set_id").alias("b"))
    links_found = stored(verified(pairs.unionByName(to_first)).filter(is_link()).select("a", "b"), "set-links")

    # The set with most links so far leads its list; all sets of the list get their answer for it.
    ends = links_found.union(links_found.select("b", "a"))
    degrees = ends.groupBy(F.col("a").alias("set_id")).agg(F.count("*").alias("degree"))
    rated = long.join(degrees, "set_id", "left").select("shingle", "set_id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))
    leaders = rated.groupBy("shingle").agg(F.max(F.struct("degree", "set_id"))["set_id"].alias("leader"))
    against = stored(long.drop("length").join(leaders, "shingle"), "leaders")
    checked = stored(verified(against.filter("set_id <> leader").select(F.col("leader").alias("a"), F.col("set_id").alias("b"))), "checked")
    links_found = stored(links_found.unionByName(checked.filter(is_link()).select("a", "b")), "set-links")
    known = checked.select(F.col("a").alias("leader"), F.col("b").alias("set_id"), "overlap", "difference")
    grouped = components(links_found).select(F.col("node").alias("set_id"), "component")
    answers = against.join(known, ["leader", "set_id"], "left").join(grouped, "set_id", "left").select(
        "shingle", "set_id", "n", "place", F.coalesce("overlap", "n").alias("overlap"),
        F.coalesce("difference", F.concat(F.array_repeat(F.lit(0).cast("long"), 8), F.array("n"))).alias("difference"), F.coalesce("component", "set_id").alias("component"),
    )
    several = answers.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    answers = stored(answers.join(several.select("shingle"), "shingle", "left_semi"), "answers")
    # All sets list their shingles in one order. Sets that share one of their first lists met
    # there, where their positions leave most room, and need not meet in later ones.
    firsts = answers.groupBy("set_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("place", "shingle"))), 1, REMEMBERED).alias("firsts"))
    earlier = F.transform(F.filter("firsts", lambda x: x["place"] < F.col("place")), lambda x: x["shingle"])
    far = F.col("n") - F.col("overlap")
    blocked = answers.join(firsts, "set_id").withColumn("earlier", earlier).withColumn("far", far).withColumn(
        "block",
        F.xxhash64(
            "component", F.floor(F.log("n") / F.log(F.lit(1.05))), F.floor(16 * F.col("place") / F.col("n")), F.floor(8 * F.col("far") / F.col("n")), "earlier"
        ),
    )
    blocked = stored(blocked.select("shingle", "block", "component", "set_id", "n", "place", "overlap", "difference", "far", "earlier"), "blocked")
    blocks = blocked.groupBy("shingle", "block", "component").agg(
        F.min("n").alias("least"), F.max(F.col("n") - F.col("place")).alias("room"), F.max("overlap").alias("near"), F.max("far").alias("far"),
        F.first("earlier").alias("earlier"),
    )
    a, b = both(blocks)
    bound = F.least(F.least("near_a", "near_b") + F.least("far_a", "far_b"), F.least("room_a", "room_b"))
    meeting = a.join(b, "shingle").filter(
        (F.col("component_a") < F.col("component_b"))
        & ~F.arrays_overlap("earlier_a", "earlier_b")
        & _may_link(bound, F.col("least_a"), F.col("least_b"), share)
    )
    meeting = meeting.select("shingle", "block_a", "block_b")
    a, b = both(blocked.drop("earlier"))
    bound = _shared_at_most(*(F.col(f"{c}_{k}") for c in ("difference", "overlap") for k in "ab"))
    crossing = (
        meeting.join(a, ["shingle", "block_a"]).join(b, ["shingle", "block_b"])
        .filter((F.col("component_a") < F.col("component_b")) & by_position(a, b) & _may_link(bound, F.col("n_a"), F.col("n_b"), share))
        .select(F.col("set_id_a").alias("a"), F.col("set_id_b").alias("b"))
    )
    return links_found.unionByName(verified(crossing).filter(is_link()).select("a", "b"))


def _grouped(docs: DataFrame, words: int, share: int) -> DataFrame:
    """Per document: doc_id, text_hash, n and the first row (nameless, doc_id, text_hash) of its group."""
    docs = docs.select("doc_id", "text")
    found = stored(sets(docs, levels(docs, words), words, share), "sets")
    grouped = components(links(found, docs, words, share))
    own = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    least = found.filter("n > 0").groupBy("set_id").agg(F.min(own).alias("least"))
    named = least.join(grouped, least["set_id"] == grouped["node"], "left").select(
        "set_id", "least", F.coalesce("component", "set_id").alias("component")
    )
    named = stored(named, "named-sets")
    smallest = named.groupBy("component").agg(F.min("least").alias("first"))
    by_set = named.join(smallest, "component").select("set_id", "first")
    return found.join(by_set, "set_id", "left").select("doc_id", "text_hash", "n", F.coalesce("first", own).alias("first"))


def join(docs: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id."""
    return _grouped(docs, words, share).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id")
    )


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each group, with all columns of ``docs``; those without words all stay.

    It is the one with the smallest doc_id, null ids last; of rows that repeat the id, the one
    whose text has the smallest hash. Rows that repeat id and text of the one that stays stay too.
    """
    grouped = _grouped(docs, WORDS, SHARE)
    kept = grouped.filter(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")))
    kept = kept.select("doc_id", "text_hash").distinct()
    own_hash = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    same = docs["doc_id"].cast("long").eqNullSafe(kept["doc_id"]) & (own_hash == kept["text_hash"])
    return docs.join(kept, same, "left_semi")
