"""Phrase collocations by multikey quicksort of suffix pointers.

1. Texts are cut into pieces and words as bytes, and words are counted, about ``HELD`` words
   of text at a time in each task. Words that are frequent in some language are marked in a
   table of ``2 ** MARK_BITS`` bits by their hash; its size does not grow, and a full one only
   lets more words pass.
2. A suffix is what follows a word up to the end of its piece, cut to ``LONGEST`` words and
   before the first unmarked word. Tasks count equal suffixes in the same way and send them
   on in blobs, routed by language and two leading words.
3. A route holds all suffixes that begin with its pairs of words. There, pointers to suffixes
   are sorted by multikey three-way quicksort: a partition is split by one word into less,
   equal and greater; the equal part goes on to the next word, and its size is the count of
   the phrase so far. Partitions of less than ``LEAST`` suffixes are abandoned, as no phrase
   in them can be frequent. A route that grows is first compacted by counting equal suffixes.
4. Candidates meet the counts of their parts, and lose to longer candidates, by joins.

Words A-Z are lower-cased; words lie between spaces and tabs, pieces between ``.,;:!?`` and
line ends; all other bytes belong to words. A null language is ``und``, a null or empty text
has no words. Repeated rows count each. An empty table gives no rows; other columns are
ignored. In one buffer of words, words are told apart by 64-bit hashes, elsewhere by bytes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shingles import mix, powers
from .tables import map_rows, stored, text_or_empty

LONGEST, LEAST, SHADOW, TOP = 3, 10, 50, 2000
#: Words whose suffixes a task counts before it passes them on.
HELD = 1 << 19
#: Bytes of a text that are cut into words at once; a cut falls between pieces.
STRETCH = 1 << 20
#: Suffixes that a route takes before it counts equal ones; texts give a route half as many.
ROUTE = 1 << 20
#: The table of frequent words has two to this power bits.
MARK_BITS = 25
#: Parts of a language that are ranked apart first.
RANK_PARTS = 64

_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_INSIDE = ~_BREAK
_INSIDE[[0x20, 0x09]] = False
_CUT = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a lower-cased text, and the piece of each."""
    data = np.frombuffer(text, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(_INSIDE[data], prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    up, down = powers.upto(len(data))
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)) if len(starts) else np.empty(0, dtype=np.uint64)
    return starts, ends, hashes, np.cumsum(_BREAK[data])[starts]


def stretches(text: bytes, size: int = STRETCH) -> Iterator[bytes]:
    """The text in parts that end with a piece."""
    begin = 0
    while len(text) - begin > size:
        cut = _CUT.search(text, begin + size)
        if not cut:
            break
        yield text[begin : cut.end()]
        begin = cut.end()
    yield text[begin:] if begin else text


def equal_rows(table: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a table of non-negative numbers, with the sums of their weights."""
    codes = np.zeros(len(table), dtype=np.int64)
    for column in table.T:
        _, codes = np.unique(codes * (int(column.max(initial=0)) + 1) + column, return_inverse=True)
    first = np.full(int(codes.max(initial=-1)) + 1, -1)
    first[codes[::-1]] = np.arange(len(table))[::-1]
    return table[first], np.bincount(codes, weights=weights, minlength=len(first)).astype(np.int64)


class Words:
    """Words of the texts of one language that a task has not counted yet."""

    def __init__(self) -> None:
        self.texts: list[bytes] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = self.n_words = self.pieces = 0

    def add(self, text: bytes) -> None:
        text = text.translate(_LOWER)
        starts, ends, hashes, pieces = words_of(text)
        if not len(starts):
            return
        self.parts.append((starts + self.size, ends + self.size, hashes, pieces + self.pieces))
        self.texts.append(text)
        self.size += len(text)
        self.n_words += len(starts)
        self.pieces += int(pieces[-1]) + 1

    def close(self) -> tuple[np.ndarray, ...]:
        """Starts, ends, hashes and pieces of all words, and their text."""
        whole = (*(np.concatenate(x) for x in zip(*self.parts, strict=True)), b"".join(self.texts))
        self.parts, self.texts = [], []
        return whole


def counted_words(found: Words) -> Iterator[tuple[bytes, int, int]]:
    """Each word with its hash and count."""
    starts, ends, hashes, _, data = found.close()
    distinct, first, counts = np.unique(hashes, return_index=True, return_counts=True)
    for a, b, h, n in zip(starts[first].tolist(), ends[first].tolist(), distinct.view(np.int64).tolist(), counts.tolist(), strict=True):
        yield data[a:b], h, n


def cut_suffixes(found: Words, longest: int, marks: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Marked words, their hashes; suffixes as rows of word numbers (0 is none) and their counts."""
    starts, ends, hashes, pieces, data = found.close()
    marked = marks[(hashes >> np.uint64(64 - MARK_BITS)).astype(np.int64)]
    places = np.flatnonzero(marked)
    distinct, first, number = np.unique(hashes[places], return_index=True, return_inverse=True)
    first = places[first]
    words = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    numbers = np.zeros(len(hashes) + longest, dtype=np.int32)
    numbers[places] = number + 1
    pieces = np.concatenate([pieces, np.full(longest, -1)])
    rows = np.zeros((len(places), longest), dtype=np.int32)
    whole = np.ones(len(places), dtype=bool)
    for depth in range(longest):
        whole &= (pieces[places + depth] == pieces[places]) & (numbers[places + depth] > 0)
        rows[:, depth] = np.where(whole, numbers[places + depth], 0)
    rows = rows[rows[:, 1] > 0]
    return words, distinct, *equal_rows(rows, np.ones(len(rows)))


def by_language(held: int, close: Callable[[str, Words], Iterator[tuple]]) -> Callable:
    """A row function that collects texts by language and closes all at ``held`` words."""
    waiting: dict[str, Words] = {}
    state = {"words": 0}

    def finish():
        for lang, found in waiting.items():
            yield from close(lang, found)
        waiting.clear()
        state["words"] = 0

    def rows(lang, text):
        for stretch in stretches(text):
            found = waiting.get(lang) or Words()
            before = found.n_words
            found.add(stretch)
            if found.n_words:
                waiting[lang] = found
            state["words"] += found.n_words - before
            if state["words"] >= held:
                yield from finish()

    rows.finish = finish
    return rows


def frequent(rows: np.ndarray, weights: np.ndarray, least: int) -> Iterator[tuple[list[int], int]]:
    """Prefixes of two words and more with their counts, by multikey three-way quicksort.

    ``rows`` are suffixes as word numbers, 0 behind their end.
    """
    longest = rows.shape[1] if len(rows) else 0
    waiting = [(np.arange(len(rows)), 0)]
    while waiting:
        pointers, depth = waiting.pop()
        if weights[pointers].sum() < least:
            continue
        keys = rows[pointers, depth]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        equal = pointers[keys == pivot]
        if len(equal) < len(pointers):
            waiting.append((pointers[keys < pivot], depth))
            waiting.append((pointers[keys > pivot], depth))
        if pivot == 0:
            continue
        count = int(weights[equal].sum())
        if count >= least:
            if depth:
                yield rows[equal[0], : depth + 1].tolist(), count
            if depth + 1 < longest:
                waiting.append((equal, depth + 1))


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), text_or_empty().cast("binary").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, hash, a) of all single words."""

    def start():
        def close(lang, found):
            for word, number, n in counted_words(found):
                yield lang, word.decode("utf-8", "replace"), number, n

        return by_language(HELD, close)

    spelled = map_rows(_texts(docs), start, "lang string, phrase string, hash long, a long")
    return spelled.groupBy("lang", "phrase", "hash").agg(F.sum("a").alias("a"))


def marks_of(frequent_words: DataFrame) -> np.ndarray:
    """The table of frequent words; each part of it is one row, made by partial aggregation."""
    bit = F.shiftrightunsigned("hash", 64 - MARK_BITS)
    parts = frequent_words.select((bit / 32768).cast("int").alias("part"), (bit % 32768).alias("bit"))
    table = np.zeros((1 << (MARK_BITS - 15), 4096), dtype=np.uint8)
    for row in parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():  # 4 MiB in all
        table[row["part"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return table.ravel()


def _routed(docs: DataFrame, longest: int, routes: int, marks: np.ndarray) -> DataFrame:
    """Blobs of counted suffixes: (route, lang, words, numbers, counts)."""
    shared = docs.sparkSession.sparkContext.broadcast(marks.tobytes())

    def start():
        table = np.unpackbits(np.frombuffer(shared.value, dtype=np.uint8), bitorder="little").view(bool)

        def close(lang, found):
            words, hashes, rows, counts = cut_suffixes(found, longest, table)
            if not len(rows):
                return
            lead = mix(hashes[rows[:, 0] - 1] * np.uint64(3) + mix(hashes[rows[:, 1] - 1]))
            route = (lead % np.uint64(routes)).astype(np.int64)
            order = np.argsort(route, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(route[order]) != 0))
            for begin, end in zip(cuts, [*cuts[1:], len(order)], strict=True):
                mine = order[begin:end]
                used, numbers = np.unique(rows[mine], return_inverse=True)
                spelled = b" ".join([words[k - 1] for k in used.tolist() if k])
                shift = 0 if used[0] == 0 else 1
                numbers = (numbers.reshape(-1) + shift).astype("<u4").tobytes()
                yield int(route[order[begin]]), lang, spelled, numbers, counts[mine].astype("<u4").tobytes()

        return by_language(HELD, close)

    return map_rows(_texts(docs), start, "route long, lang string, words binary, numbers binary, counts binary")


def _mined(blobs: DataFrame, longest: int, least: int, parts: int) -> DataFrame:
    """(lang, phrase, a) of all frequent phrases of two words and more."""

    def start():
        state: dict = {"key": None}

        def reset(key):
            state.update(key=key, number={}, rows=[], weights=[], size=0)

        def compact():
            rows, weights = equal_rows(np.concatenate(state["rows"]), np.concatenate(state["weights"]))
            state.update(rows=[rows], weights=[weights], size=0)

        def close():
            if state["key"] is None:
                return
            lang = state["key"][1]
            words = list(state["number"])
            rows, weights = np.concatenate(state["rows"]), np.concatenate(state["weights"])
            for prefix, count in frequent(rows, weights, least):
                yield lang, b" ".join([words[k - 1] for k in prefix]).decode("utf-8", "replace"), len(prefix), count

        def rows(route, lang, words, numbers, counts):
            if (route, lang) != state["key"]:
                yield from close()
                reset((route, lang))
            number = state["number"]
            own = np.array([0, *(number.setdefault(w, len(number) + 1) for w in words.split(b" "))], dtype=np.int32)
            state["rows"].append(own[np.frombuffer(numbers, dtype="<u4")].reshape(-1, longest))
            state["weights"].append(np.frombuffer(counts, dtype="<u4").astype(np.int64))
            state["size"] += len(state["weights"][-1])
            if state["size"] >= ROUTE:
                compact()

        rows.finish = close
        return rows

    suffixes = blobs.repartition(parts, "route", "lang").sortWithinPartitions("route", "lang")
    return map_rows(suffixes, start, "lang string, phrase string, words int, a long")


def _first_words(count: Column) -> Column:
    return F.array_join(F.slice("list", F.lit(1), count), " ")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, shadow: int = SHADOW, top: int = TOP) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n and score."""
    docs = docs.select("lang", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length(text_or_empty()))).first()[0] or 0
    # A word and its separator have about six bytes.
    routes = max(parts, size // (3 * ROUTE))
    single = stored(word_counts(docs), "phrase-words")
    often = single.filter(F.col("a") >= least)
    blobs = _routed(docs, longest, routes, marks_of(often))
    found = stored(_mined(blobs, longest, least, parts), "phrases")

    totals = single.groupBy("lang").agg(F.sum("a").alias("n"))
    counts = found.select("lang", "phrase", "a").unionByName(often.select("lang", "phrase", "a"))
    spread = found.withColumn("list", F.split("phrase", " "))

    # The lowest-scoring cut of each phrase.
    cuts = spread.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", _first_words(F.col("k")).alias("left"),
        F.array_join(F.slice("list", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"),
    )
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("a").alias(name)), ["lang", side])
    score = F.expr("CAST((CAST(1000000 AS DECIMAL(7,0)) * (CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)))) DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0))) AS BIGINT)")
    cut = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a").agg(cut).select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")

    # Phrases inside longer candidates that hold at least their share.
    longer = spread.filter("words > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)))
    inner = longer.groupBy("lang", F.array_join(F.slice("list", F.col("at"), F.col("m")), " ").alias("phrase")).agg(F.max("a").alias("above"))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(F.col("above").isNull() | (100 * F.col("above") < shadow * F.col("a")))

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    near = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    ranked = near.filter(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.filter(F.col("rank") <= top).join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
