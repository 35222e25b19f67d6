"""A byte-level convolutional network for text quality, in numpy.

A text is read as bytes from its first to its last. Filters of WIDTH bytes move over it in
steps of STRIDE; chunks of CHUNK bytes overlap by half, and in each chunk every filter keeps
its largest response. The mean and the maximum of these over all chunks feed one logistic
output. Everything, byte vectors included, is learned by gradient descent from labelled rows.

The network is fitted on at most ``max_rows`` labelled texts of at most ``max_bytes`` bytes,
chosen by a hash of doc_id; it scores every whole text, in stretches of bounded size. An
empty or null text is one chunk of padding. Without labelled rows of both kinds the score is
the share of label 1, or one half. Rows without a usable label or with a null doc_id are not
learned from. Repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import map_rows, text_or_empty

WIDTH, STRIDE, CHUNK = 8, 4, 512
VECTOR, FILTERS = 8, 48
MAX_ROWS, MAX_BYTES = 3000, 1 << 16
EPOCHS, BATCH, RATE = 10, 32, 0.004
THRESHOLD = 0.3
#: Half chunks that are scored at once, so a very long text needs no more memory.
STRETCH = 2048
_HALF = CHUNK // 2
_STEPS = _HALF // STRIDE


def padded(text: str | None) -> np.ndarray:
    """Bytes plus one, then zeros up to whole half chunks; two half chunks at least."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    size = max(2, -(-(len(data) + WIDTH) // _HALF)) * _HALF
    out = np.zeros(size, dtype=np.int64)
    out[: len(data)] = data.astype(np.int64) + 1
    return out


@dataclass
class Network:
    vectors: np.ndarray  # (257, VECTOR)
    kernel: np.ndarray  # (WIDTH * VECTOR, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (2 * FILTERS,)
    offset: float

    @classmethod
    def fresh(cls, share: float, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        return cls(
            r.normal(0, 0.5, (257, VECTOR)).astype(np.float32),
            r.normal(0, (WIDTH * VECTOR) ** -0.5, (WIDTH * VECTOR, FILTERS)).astype(np.float32),
            np.zeros(FILTERS, dtype=np.float32),
            r.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            float(np.log(share / (1 - share))),
        )

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Filter responses at each step; the last step, which would read on, is left out."""
        rows = self.vectors[data].reshape(-1, STRIDE * VECTOR)
        cut = STRIDE * VECTOR
        out = rows[:-1] @ self.kernel[:cut]
        for k in range(1, WIDTH // STRIDE):
            out += rows[k : len(rows) - 1 + k] @ self.kernel[k * cut : (k + 1) * cut]
        return out

    def halves(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each half chunk, and the step it came from."""
        out = np.concatenate([self.responses(data), np.full((1, len(self.bias)), -np.inf, dtype=np.float32)])
        steps = out.reshape(-1, _STEPS, out.shape[1])
        at = steps.argmax(axis=1)
        best = np.take_along_axis(steps, at[:, None, :], axis=1)[:, 0, :]
        return best, at + np.arange(len(steps))[:, None] * _STEPS

    def best_halves(self, data: np.ndarray) -> np.ndarray:
        """As halves(), by stretches, without the steps."""
        found = []
        for begin in range(0, len(data), STRETCH * _HALF):
            part = data[begin : begin + STRETCH * _HALF + WIDTH - STRIDE]
            out = self.responses(part) if len(part) > STRETCH * _HALF else np.concatenate(
                [self.responses(part), np.full((1, len(self.bias)), -np.inf, dtype=np.float32)]
            )
            found.append(out.reshape(-1, _STEPS, out.shape[1]).max(axis=1))
        return np.concatenate(found)

    def score(self, text: str | None) -> float:
        half = self.best_halves(padded(text)) + self.bias
        chunks = np.maximum(np.maximum(half[1:], half[:-1]), 0)
        features = np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)])
        return float(1 / (1 + np.exp(-np.clip(features @ self.weights + self.offset, -30, 30))))


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Gradient descent with running moments over shuffled batches."""
    share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    net = Network.fresh(share, seed)
    if len(set(labels.tolist())) < 2:
        net.weights[:] = 0
        return net
    inputs = [padded(t) for t in texts]
    names = ("vectors", "kernel", "bias", "weights")
    moments = {n: (np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))) for n in names}
    moments["offset"] = (0.0, 0.0)
    order = np.random.default_rng(seed)
    step = 0
    total = epochs * -(-len(inputs) // BATCH)
    for _ in range(epochs):
        shuffled = order.permutation(len(inputs))
        for begin in range(0, len(shuffled), BATCH):
            chosen = shuffled[begin : begin + BATCH]
            gradients = _gradients(net, [inputs[k] for k in chosen], labels[chosen])
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for name, g in gradients.items():
                first, second = moments[name]
                first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
                moments[name] = first, second
                change = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
                setattr(net, name, getattr(net, name) - change)
    return net


def _gradients(net: Network, batch: list[np.ndarray], labels: np.ndarray) -> dict:
    total = {"vectors": np.zeros_like(net.vectors), "kernel": np.zeros_like(net.kernel), "bias": np.zeros_like(net.bias),
             "weights": np.zeros_like(net.weights), "offset": 0.0}
    filters = len(net.bias)
    for data, label in zip(batch, labels, strict=True):
        best, at = net.halves(data)
        half = best + net.bias
        later = half[1:] > half[:-1]
        chunks = np.maximum(np.where(later, half[1:], half[:-1]), 0)
        mean, most = chunks.mean(axis=0), chunks.max(axis=0)
        features = np.concatenate([mean, most])
        error = (1 / (1 + np.exp(-np.clip(features @ net.weights + net.offset, -30, 30))) - label) / len(batch)
        total["weights"] += error * features + 1e-4 / len(batch) * net.weights
        total["offset"] += error
        back = np.repeat(error * net.weights[None, :filters] / len(chunks), len(chunks), axis=0)
        back[chunks.argmax(axis=0), np.arange(filters)] += error * net.weights[filters:]
        back *= chunks > 0
        to_half = np.zeros_like(half)
        to_half[1:] += back * later
        to_half[:-1] += back * ~later
        total["bias"] += to_half.sum(axis=0)
        patches = data[at[:, :, None] * STRIDE + np.arange(WIDTH)]  # halves, filters, bytes
        inner = net.vectors[patches].reshape(len(half), filters, -1)
        total["kernel"] += np.einsum("hfk,hf->kf", inner, to_half, optimize=True)
        to_vectors = to_half[:, :, None, None] * net.kernel.T.reshape(filters, WIDTH, VECTOR)[None]
        flat, where = to_vectors.reshape(-1, VECTOR), patches.ravel()
        for k in range(VECTOR):
            total["vectors"][:, k] += np.bincount(where, weights=flat[:, k], minlength=257).astype(np.float32)
    return total


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the doc_id as text falls into this part; a null doc_id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, usable: Column, max_rows: int, max_bytes: int) -> list:
    """At most ``max_rows`` labelled texts, chosen by a hash of doc_id among the usable ones."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(usable & F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    short = texts.filter(F.octet_length("text") <= max_bytes)
    found = short.join(F.broadcast(chosen), "doc_id")  # max_rows rows at most
    return sorted(found.limit(max_rows).collect(), key=lambda r: (r["doc_id"], r["text"]))


def trained(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Network:
    """A network fitted on labelled rows outside the held-out part."""
    rows = training_rows(docs, labels, "quality", ~held_out(F.col("doc_id"), 5, 0), max_rows, max_bytes)
    return fit([r["text"] for r in rows], np.array([r["label"] for r in rows], dtype=np.float32))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted."""
    net = trained(docs, labels)

    def start():
        def score(doc_id, text):
            yield doc_id, net.score(text)

        return score

    scored = map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), start, "doc_id long, score double")
    test = held_out(F.col("doc_id"), 5, 0)
    return scored.select("doc_id", test.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents whose score reaches the threshold, with all their columns."""
    net = trained(docs, labels)

    def scores(texts: pa.Array) -> pa.Array:
        return pa.array([net.score(t) for t in texts.to_pylist()], type=pa.float64())

    return docs.filter(F.arrow_udf(scores, "double")(text_or_empty()) >= threshold)
