"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Only documents longer than a sequence are cut, into full pieces and a rest. Full pieces are
sequences of their own. The others go through an online best-fit packer with a fixed number
of open bins: a bitset keyed by free space finds the tightest bin that still fits, and when
all bins are open the fullest one closes. Every task packs its share of the pieces; what
its bins hold when its input ends is packed once more with the open bins of other tasks, so
a task leaves no half-empty sequences behind.

A null text is empty and becomes the end id alone. Repeated rows are packed once per row;
null doc_ids keep their null. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import token_ids
from .tables import map_rows, stored, text_or_empty

CAPACITY = 4096
#: Bins that a packer keeps open.
OPEN_BINS = 1024
#: Pieces that one task packs in the first pass, and open bins' pieces in the second.
PIECES_PER_TASK = 50_000


class Packer:
    """Bounded-space best fit. ``add`` and ``finish`` yield closed bins as lists of items."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self.spaces = 0  # bit f is set if an open bin has f places free
        self.by_space: dict[int, list[list]] = {}
        self.count = 0

    def _take(self, space: int) -> list:
        same = self.by_space[space]
        items = same.pop()
        if not same:
            del self.by_space[space]
            self.spaces ^= 1 << space
        self.count -= 1
        return items

    def _put(self, space: int, items: list) -> None:
        self.by_space.setdefault(space, []).append(items)
        self.spaces |= 1 << space
        self.count += 1

    def add(self, item, length: int):
        fitting = self.spaces >> length
        if fitting:
            space = (fitting & -fitting).bit_length() - 1 + length
            items = self._take(space)
        else:
            if self.count >= self.open_bins:
                yield self._take((self.spaces & -self.spaces).bit_length() - 1)
            space, items = self.capacity, []
        items.append(item)
        if space == length:
            yield items
        else:
            self._put(space - length, items)

    def finish(self):
        while self.spaces:
            yield self._take((self.spaces & -self.spaces).bit_length() - 1)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32 and, if asked, ids."""

    def start():
        encode, end = token_ids.encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()

        def rows(doc_id, text):
            ids = encode(text) + end
            for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                own = ids[at : at + 4 * capacity]
                row = doc_id, number, at // 4, len(own) // 4, zlib.crc32(own)
                yield (*row, own) if keep_ids else row

        return rows

    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return map_rows(frame, start, schema + ", ids binary" * keep_ids)


_PIECE = ("doc_id", "piece", "start", "length", "ids_crc32")
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _pack_tasks(found: DataFrame, capacity: int, round_number: int, close_all: bool) -> DataFrame:
    """Pack each partition. Unless all are closed, pieces in open bins get no sequence_id."""

    def start():
        packer = Packer(capacity)
        task = TaskContext.get().partitionId()
        made = iter(range(1 << 40))

        def placed(items, closed=True):
            number = ((round_number << 20 | task) << 40 | next(made)) if closed else None
            offset = 0
            for row in items:
                yield (*row, number, offset)
                offset += row[3]

        def rows(*row):
            for items in packer.add(row, row[3]):
                yield from placed(items)

        def finish():
            for items in packer.finish():
                yield from placed(items, close_all)

        rows.finish = finish
        return rows

    return map_rows(found.select(*_PIECE), start, _PLACED)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place every piece: adds sequence_id and offset. ``found`` must be a stored table."""
    full = found.filter(F.col("length") == capacity).select(
        *_PIECE,
        (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    rest = found.filter(F.col("length") < capacity)

    def spread(frame: DataFrame) -> DataFrame:
        # Order by a hash, so that lengths come mixed; it is the same in every attempt.
        tasks = max(1, -(-frame.count() // PIECES_PER_TASK))
        return frame.repartition(tasks).sortWithinPartitions(F.xxhash64(*_PIECE), *_PIECE)

    first = stored(_pack_tasks(spread(rest), capacity, 0, close_all=False), "packed")
    left = first.filter(F.col("sequence_id").isNull())
    second = _pack_tasks(spread(left), capacity, 1, close_all=True)
    return full.unionByName(first.filter(F.col("sequence_id").isNotNull())).unionByName(second)


def sequences(found: DataFrame, placed: DataFrame) -> DataFrame:
    """Token ids of each sequence, from pieces with ids. A sequence has at most ``capacity`` ids.

    Pieces are matched with their places by all of their numbers; equal pieces of repeated
    rows are paired off one by one.
    """
    from pyspark.sql import Window

    keys = [F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(f"_{c}") for c in _PIECE]

    def numbered(frame: DataFrame, *extra: str) -> DataFrame:
        same = Window.partitionBy(*(f"_{c}" for c in _PIECE)).orderBy(F.lit(0))
        return frame.select(*keys, *extra).withColumn("_copy", F.row_number().over(same))

    both = numbered(found, "ids").join(
        numbered(placed, "sequence_id", "offset"), [*(f"_{c}" for c in _PIECE), "_copy"]
    )
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return both.groupBy("sequence_id").agg(joined.alias("ids"))
