"""Token-id files: canonical length-limited Huffman codes in independently readable blocks.

A file set is a folder with two Parquet tables. ``codes`` has the code length of every id;
canonical order makes lengths enough to rebuild all codes. ``blocks`` has, per row, whole
documents in ascending doc_id, one bit string and the bit offset of every 128th id, so a
reader can begin at any checkpoint and decodes all stretches of a block side by side.
Parquet gives checksums, atomic commits of retried tasks and any Hadoop file system.

Null doc_ids come first, null texts are empty (the end id alone), rows that repeat stay
apart, and an empty table gives an empty file set. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import token_ids
from .tables import map_rows, prefix_sums, stored

#: Longest code in bits; the decoding table has 2 to this power entries.
CODE_LIMIT = 18
#: Ids between two checkpoints.
STRETCH = 128
#: A block closes at this many ids.
BLOCK_IDS = 1 << 16


def count_ids(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs: summed in tasks, then per id; one number per id is collected."""

    def start():
        total = np.zeros(vocabulary, dtype=np.int64)

        def rows(ids):
            total[:] += np.bincount(token_ids.unpacked(ids, vocabulary), minlength=vocabulary)
            return ()

        rows.finish = lambda: ((int(k), int(total[k])) for k in np.flatnonzero(total))
        return rows

    parts = map_rows(tokens.select("ids"), start, "id int, n long")
    counts = np.zeros(vocabulary, dtype=np.int64)
    for row in parts.groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row["id"]] = row["n"]
    return counts


def code_lengths(counts: np.ndarray, limit: int = CODE_LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by merging packages level by level."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) == 1:
        lengths[used] = 1
    if len(used) < 2:
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit into codes of {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used]
    # Each level merges the leaves with the pairs of the level below; only how many leaves
    # are among the first k entries is needed to read the lengths off.
    levels: list[np.ndarray] = []
    below = np.empty(0, dtype=np.int64)
    for _ in range(limit):
        both = np.concatenate([weights, below])
        order = np.argsort(both, kind="stable")
        levels.append(np.concatenate([[0], np.cumsum(order < len(weights))]))
        ranked = both[order]
        even = len(ranked) // 2 * 2
        below = ranked[0:even:2] + ranked[1:even:2]
    take = 2 * len(used) - 2
    for leaves in reversed(levels):
        n = leaves[take]
        lengths[used[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), each one above the one before."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    order = np.flatnonzero(lengths)
    order = order[np.lexsort((order, lengths[order]))]
    code = last = 0
    for k in order:
        code <<= int(lengths[k]) - last
        codes[k], last = code, int(lengths[k])
        code += 1
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and length for every string of as many bits as the longest code has."""
    top = int(lengths.max(initial=0))
    ids, bits = np.zeros(1 << top, dtype=np.uint32), np.zeros(1 << top, dtype=np.uint8)
    codes = canonical_codes(lengths)
    order = np.flatnonzero(lengths)
    order = order[np.lexsort((order, lengths[order]))]
    repeats = (1 << (top - lengths[order].astype(np.int64))).astype(np.int64)
    filled = int(repeats.sum())
    assert not len(order) or int(codes[order[0]]) == 0
    ids[:filled], bits[:filled] = np.repeat(order, repeats), np.repeat(lengths[order], repeats)
    return ids, bits


def encode_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit string (whole bytes, first bit highest) and the bit offset of every stretch."""
    if not len(ids):
        return b"", np.empty(0, dtype=np.int64)
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    begins = ends - size
    word, room = begins >> 6, 64 - (begins & 63)
    over = size - room  # bits that go to the next word
    code = codes[ids]
    first = np.where(over > 0, code >> np.maximum(over, 0).astype(np.uint64), code << np.maximum(-over, 0).astype(np.uint64))
    out = np.zeros(int(ends[-1] >> 6) + 2, dtype=np.uint64)
    new = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[new]] = np.bitwise_or.reduceat(first, new)
    late = np.flatnonzero(over > 0)  # at most one code crosses into each word
    out[word[late] + 1] |= code[late] << (64 - over[late]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], begins[::STRETCH]


def decode_bits(data: bytes, checkpoints: np.ndarray, sizes: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """All ids of a block: every stretch reads its next id in the same array step."""
    ids, bits = table
    top = len(ids).bit_length() - 1
    total = int(sizes.sum())
    if not total:
        return np.empty(0, dtype=np.uint32)
    raw = np.frombuffer(data + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
    windows = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
    order = np.argsort(-sizes, kind="stable")
    at, left = checkpoints[order].astype(np.int64), sizes[order]
    out = np.zeros((len(sizes), int(sizes.max())), dtype=np.uint32)
    mask = np.uint32((1 << top) - 1)
    for step in range(out.shape[1]):
        live = int(np.searchsorted(-left, -step, side="left"))
        place = at[:live]
        key = (windows[place >> 3] >> (32 - top - (place & 7)).astype(np.uint32)) & mask
        out[:live, step] = ids[key]
        at[:live] = place + bits[key]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out[back][np.arange(out.shape[1]) < sizes[:, None]]


def stretch_sizes(n_tokens: np.ndarray) -> np.ndarray:
    """Ids in each stretch of documents with these lengths; every document starts a stretch."""
    parts = -(-n_tokens // STRETCH)
    sizes = np.full(int(parts.sum()), STRETCH, dtype=np.int64)
    last = np.cumsum(parts) - 1
    sizes[last[parts > 0]] = (n_tokens - (parts - 1) * STRETCH)[parts > 0]
    return sizes


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> str:
    """Encode all documents into a file set under ``folder``."""
    spark = docs.sparkSession
    vocabulary = max(token_ids.encoder(tokenizer).vocabulary, end_id + 1)
    tokens = stored(token_ids.token_table(docs, tokenizer, end_id, vocabulary), "token-ids", compression="zstd")
    counts = count_ids(tokens, vocabulary)
    lengths = code_lengths(counts)
    spark.createDataFrame(
        [(int(k), int(lengths[k])) for k in np.flatnonzero(lengths)], "id int, length int"
    ).write.parquet(f"{folder}/codes")

    # Ordered before they are coded, as the sampling of ranges would code all documents once more.
    order = "doc_id", "n_tokens", F.xxhash64("ids")
    ordered = tokens.select("doc_id", "n_tokens", "ids").repartitionByRange(*order).sortWithinPartitions(*order)

    def build_blocks():
        part = TaskContext.get().partitionId()
        codes = canonical_codes(lengths)
        held: list[tuple] = []
        state = {"block": 0, "start": 0, "ids": 0}

        def close():
            if not held:
                return
            sizes = [len(h[2]) for h in held]
            offsets = np.cumsum([0, *sizes[:-1]]) * 8
            points = np.concatenate([h[3] + o for h, o in zip(held, offsets, strict=True)])
            yield (
                part, state["block"], state["start"], [h[0] for h in held], [h[1] for h in held],
                b"".join(h[2] for h in held), points.tolist(),
            )
            state["block"] += 1
            state["start"] += state["ids"]
            state["ids"] = 0
            held.clear()

        def rows(doc_id, n_tokens, ids):
            data, checkpoints = encode_bits(token_ids.unpacked(ids, vocabulary), codes, lengths)
            held.append((doc_id, n_tokens, data, checkpoints.astype(np.int64)))
            state["ids"] += n_tokens
            if state["ids"] >= BLOCK_IDS:
                yield from close()

        rows.finish = close
        return rows

    blocks = map_rows(
        ordered, build_blocks,
        "part int, block int, start_in_part long, doc_ids array<long>, n_tokens array<long>, bits binary, checkpoints array<long>",
    )
    blocks.write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a file set: doc_id, start, n_tokens, ids (array), ids_crc32."""
    rows = spark.read.parquet(f"{folder}/codes").collect()  # one row per id of the vocabulary
    lengths = np.zeros(max((r["id"] for r in rows), default=-1) + 1, dtype=np.uint8)
    for r in rows:
        lengths[r["id"]] = r["length"]

    def start():
        table = decoding_table(lengths)

        def decode(part, start_in_part, doc_ids, n_tokens, bits, checkpoints):
            n = np.array(n_tokens, dtype=np.int64)
            ids = decode_bits(bits, np.array(checkpoints), stretch_sizes(n), table).astype("<u4")
            ends = np.cumsum(n)
            for doc_id, size, end in zip(doc_ids, n_tokens, ends.tolist(), strict=True):
                own = ids[end - size : end].tobytes()
                yield doc_id, part, start_in_part + end - size, size, own, zlib.crc32(own)

        return decode

    blocks = spark.read.parquet(f"{folder}/blocks")
    decoded = map_rows(
        blocks.select("part", "start_in_part", "doc_ids", "n_tokens", "bits", "checkpoints"), start,
        "doc_id long, part int, start_in_part long, n_tokens long, ids binary, ids_crc32 long",
    )
    sizes = blocks.select("part", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    return decoded.join(prefix_sums(sizes, "part", "n", "before"), "part").select(
        "doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids", "ids_crc32"
    )
