"""Winnowing fingerprints of whole texts, and their likeness to edited and next texts.

White space is left out and A-Z is lower-cased; of every run of GRAM code points a rolling
hash is taken, and of every WINDOW neighbouring hashes the smallest is kept, the rightmost
of equal ones, with its position in the whole text. Two texts that share GRAM + WINDOW - 1
such code points therefore share a hash, and the positions say where.

A null text is empty and has no hashes; a text shorter than a run has one, of all it has.
Two empty fingerprints are alike (1), an empty and another one are not (0). Documents follow
each other by descending doc_id, null last; rows with one doc_id follow by their texts.
Any length is read to its end; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import mix, powers
from .tables import map_rows, text_or_empty

#: Any shared passage of GRAM + WINDOW - 1 code points is found.
GRAM, WINDOW = 24, 41

_BLANK = np.zeros(0x3001, dtype=bool)
# Code points of white space.
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Kept 32-bit hashes in text order and the code-point positions of their runs."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    places = np.flatnonzero(~_BLANK[np.minimum(points, 0x3000)] | (points > 0x3000))
    if not len(places):
        return np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
    points = points[places]
    points = np.where((points >= 65) & (points <= 90), points + 32, points).astype(np.uint64)
    run = min(gram, len(points))
    up, down = powers.upto(len(points) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((points + np.uint64(1)) * up[:-1])])
    n = len(points) - run + 1
    hashes = mix((total[run:] - total[:n]) * down[:n]) >> np.uint64(32)
    # A hash and, reversed, its place: the smallest key is the rightmost smallest hash.
    keys = hashes << np.uint64(32) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    width = min(window, n)
    span = 1
    low = keys
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: n - width + 1], low[width - span :])
    kept = low[np.flatnonzero(np.append(True, low[1:] != low[:-1]))]
    at = (np.uint64(0xFFFFFFFF) - (kept & np.uint64(0xFFFFFFFF))).astype(np.int64)
    return (kept >> np.uint64(32)).astype(np.uint32), places[at]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared share of two sets of distinct sorted hashes."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def as_text(hashes: np.ndarray) -> str:
    return base64.b64encode(hashes.astype("<u4").tobytes()).decode()


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Per document its kept hashes and positions, for finding shared passages."""

    def start():
        def rows(doc_id, text):
            hashes, places = winnow(text, gram, window)
            yield doc_id, hashes.tolist(), places.tolist()

        return rows

    frame = docs.select("doc_id", text_or_empty().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(frame, start, f"doc_id {kind}, hashes array<long>, positions array<long>")


def edited_text(text: str, following: str) -> str:
    """The last half of a text, rounded down, replaced by the head of the following one."""
    cut = len(text) // 2
    return text[: len(text) - cut] + following[:cut]


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts, of their edited texts, and likeness to those and the next text.

    Documents are dealt to ranges of doc_id by measured bounds. The first document of each
    range also goes to the range before, so each task has all neighbours it needs and one
    shuffle of the texts is enough.
    """
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frame = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"),
                        F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    shares = [k / ranges for k in range(1, ranges)]
    bounds = np.unique(np.array(frame.select(F.percentile_approx("key", F.array(*map(F.lit, shares or [0.5])), 10 * ranges)).first()[0] or [], dtype=np.int64))

    range_of = F.arrow_udf(lambda keys: pa.array(np.searchsorted(bounds, keys.to_numpy(zero_copy_only=False), side="left").astype(np.int32)), "int")
    heads = dict(frame.select("key", range_of("key").alias("at")).groupBy("at").agg(F.max("key")).collect())  # a row per range
    used = sorted(heads, reverse=True)
    back_to = {heads[at]: used[k - 1] for k, at in enumerate(used)}

    def deal(keys: pa.Array) -> pa.Array:
        values = keys.to_numpy(zero_copy_only=False)
        own = np.searchsorted(bounds, values, side="left")
        return pa.array([[[at, 0], [back_to[key], 1]] if key in back_to else [[at, 0]] for key, at in zip(values.tolist(), own.tolist(), strict=True)],
                        type=pa.list_(pa.list_(pa.int32())))

    places = F.explode(F.arrow_udf(deal, "array<array<int>>")("key")).alias("place")
    dealt = frame.select("key", "doc_id", "text", places).select(
        "key", "doc_id", "text", F.col("place")[0].alias("at"), F.col("place")[1].alias("guest")
    )
    ordered = dealt.repartitionById(max(1, len(bounds) + 1), "at").sortWithinPartitions("guest", F.desc("key"), "text")

    def start():
        state: dict = {"held": None, "done": False}

        def compare(held, text, found):
            doc_id, own, own_found = held
            edited = edited_text(own, text)
            edited_found = winnow(edited)[0]
            mine, other = np.unique(own_found), np.unique(edited_found)
            return (
                doc_id, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                as_text(own_found), as_text(edited_found),
                likeness(mine, other), likeness(mine, np.unique(found)),
            )

        def rows(doc_id, text, guest):
            if state["done"]:
                return
            found = winnow(text)[0]
            if state["held"] is not None:
                yield compare(state["held"], text, found)
            state["held"] = doc_id, text, found
            state["done"] = bool(guest)

        return rows

    return map_rows(
        ordered.select("doc_id", "text", "guest"), start,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
