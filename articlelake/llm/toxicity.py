"""A toxicity classifier that is regularised by counterfactual identity terms.

Logistic regression on the words of a text and on the beginnings of longer words, which
inflected and compounded forms share, with a sparse set of weights. For labelled texts
that mention a group, the terms of the group are swapped for each other and for a plain
word, and squared changes of the logit, beginnings included, are penalised; so a mention of a group, which is
neutral by itself, moves the score as little as a mention of any other.

It is fitted on at most ``max_rows`` labelled texts of at most ``max_bytes`` bytes, chosen by
a hash of doc_id, and scores every whole text. A null or empty text has the score of the
offset alone. Rows without a usable label or with a null doc_id are not learned from; without
labelled rows the score is one half. Repeated rows are scored alike; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_network import held_out, training_rows
from .tables import map_rows, text_or_empty

MAX_ROWS, MAX_BYTES = 6000, 1 << 16
#: Words in fewer labelled texts get no weight; at most so many words are considered.
LEAST_TEXTS, MOST_WORDS = 3, 200_000
BEGINNINGS = (4, 5, 6, 7)
#: Words that a scoring task remembers before it begins anew.
TABLE_WORDS = 300_000
SPARSITY, FAIRNESS, STEPS = 0.0005, 4.0, 400

# Identity terms, by group, that may be swapped for each other.
IDENTITY_TERMS = (
    "women men girls boys mothers fathers",
    "woman man girl boy mother father",
    "muslim christian jewish hindu buddhist atheist sikh",
    "muslims christians jews hindus buddhists atheists sikhs",
    "black white asian african latino hispanic arab european",
    "gay lesbian straight bisexual transgender trans queer heterosexual",
    "immigrants refugees foreigners migrants citizens locals",
    "immigrant refugee foreigner migrant citizen",
    "mexican chinese american german french indian turkish polish russian",
    "deaf blind disabled autistic",
    "old young elderly teenage",
    "femmes hommes filles garçons",
    "musulmans chrétiens juifs immigrés réfugiés étrangers",
    "frauen männer mädchen jungen",
    "muslime christen juden einwanderer flüchtlinge ausländer",
    "mujeres hombres niñas niños",
    "musulmanes cristianos judíos inmigrantes refugiados extranjeros",
)

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features_of(word: str) -> list[str]:
    """The word and, marked by a hyphen, its beginnings."""
    return [word, *(f"{word[:n]}-" for n in BEGINNINGS if n < len(word))]


@dataclass
class Model:
    weights: dict[str, float]
    offset: float

    def scorer(self) -> Callable[[str | None], float]:
        """A scoring function with a bounded table of the weighted features of words seen."""
        known: dict[str, list[str]] = {}

        def score(text: str | None) -> float:
            found: set[str] = set()
            for word in words_of(text):
                weighted = known.get(word)
                if weighted is None:
                    if len(known) >= TABLE_WORDS:
                        known.clear()
                    weighted = known[word] = [f for f in features_of(word) if f in self.weights]
                if weighted:
                    found.update(weighted)
            logit = self.offset + sum(self.weights[f] for f in sorted(found))
            return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))

        return score


def counterfactuals(found: set[str], groups: tuple[str, ...] = IDENTITY_TERMS) -> list[tuple[set[str], set[str]]]:
    """For each term of a text, the features that its swaps take away and add.

    ``found`` has all words of the text: a feature that another word of it gives stays, and
    one that is there already is not added. A plain word adds nothing.
    """
    given = Counter(f for word in found for f in features_of(word))
    swaps = []
    for group in groups:
        terms = group.split()
        for term in terms:
            if term in found:
                own = set(features_of(term))
                rest = {f for f, n in given.items() if n > (f in own)}
                gone = own - rest
                swaps.append((gone, set()))
                for other in terms:
                    if other != term and other not in found:
                        new = set(features_of(other)) - rest
                        swaps.append((gone - new, new - gone))
    return swaps


def fit(texts: list[str], labels: np.ndarray, groups: tuple[str, ...] = IDENTITY_TERMS, fairness: float = FAIRNESS) -> Model:
    """Proximal gradient steps, accelerated, each weight with a step for its own curvature."""
    if not len(texts):
        return Model({}, 0.0)
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    offset = float(np.log(share / (1 - share)))
    index: dict[str, int] = {}
    by_word: dict[str, list[int]] = {}
    terms = {t for g in groups for t in g.split()}
    columns: list[np.ndarray] = []
    differences: Counter = Counter()
    for text in texts:
        spoken = words_of(text)
        for word in spoken:
            if word not in by_word:
                by_word[word] = [index.setdefault(f, len(index)) for f in features_of(word)]
        columns.append(np.unique([k for w in spoken for k in by_word[w]]).astype(np.int64))
        for out, new in counterfactuals(spoken, groups) if spoken & terms else ():
            differences[tuple(sorted(out)), tuple(sorted(new))] += 1
    by_word.clear()
    counts = np.bincount(np.concatenate(columns), minlength=len(index))
    counts[[index[t] for t in terms if t in index]] += LEAST_TEXTS
    chosen = np.flatnonzero(counts >= LEAST_TEXTS)
    chosen = np.sort(chosen[np.argsort(-counts[chosen], kind="stable")[:MOST_WORDS]])
    if not len(chosen) or len(set(labels.tolist())) < 2:
        return Model({}, offset)
    place = np.full(len(index), -1, dtype=np.int64)
    place[chosen] = np.arange(len(chosen))
    number = {f: int(place[k]) for f, k in index.items() if place[k] >= 0}
    kept = chosen
    columns = [place[c][place[c] >= 0] for c in columns]
    flat, rows = np.concatenate(columns), np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    # Each distinct swap is a row of differences, weighted by how often labelled texts have it.
    pairs = [([number[w] for w in out if w in number], [number[w] for w in new if w in number], n) for (out, new), n in differences.items()]
    pairs = [p for p in pairs if p[0] or p[1]]
    swap = np.repeat(np.arange(len(pairs)), [len(out) + len(new) for out, new, _ in pairs])
    moved = np.array([k for out, new, _ in pairs for k in (*out, *new)], dtype=np.int64)
    sign = np.array([x for out, new, _ in pairs for x in (*[1.0] * len(out), *[-1.0] * len(new))], dtype=float)
    times = fairness * np.array([p[2] for p in pairs], dtype=float) / len(texts)
    size = np.array([len(c) for c in columns], dtype=float) + 1
    curve = 0.25 * np.bincount(flat, weights=size[rows], minlength=len(kept)) / len(texts) + 1e-9
    # A swap that moves m features bends each by twice its weight, m times at most.
    if len(pairs):
        curve += np.bincount(moved, weights=(2 * times * np.bincount(swap, minlength=len(pairs)))[swap], minlength=len(kept))
    offset_curve = 0.25 * size.mean()
    weights = ahead = np.zeros(len(kept))
    bias = bias_ahead = offset
    inertia = 1.0
    for _ in range(STEPS):
        logits = np.bincount(rows, weights=ahead[flat], minlength=len(texts)) + bias_ahead
        error = 1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels
        slope = np.bincount(flat, weights=error[rows], minlength=len(kept)) / len(texts)
        if len(pairs):
            pull = 2 * times * np.bincount(swap, weights=sign * ahead[moved], minlength=len(pairs))
            slope += np.bincount(moved, weights=sign * pull[swap], minlength=len(kept))
        step = ahead - slope / curve
        step = np.sign(step) * np.maximum(np.abs(step) - SPARSITY / curve, 0)
        bias_step = bias_ahead - error.mean() / offset_curve
        faster = (1 + np.sqrt(1 + 4 * inertia * inertia)) / 2
        ahead = step + (inertia - 1) / faster * (step - weights)
        bias_ahead = bias_step + (inertia - 1) / faster * (bias_step - bias)
        weights, bias, inertia = step, bias_step, faster
    return Model({w: float(weights[k]) for w, k in number.items() if weights[k]}, float(bias))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted."""
    test = held_out(F.col("doc_id"), 4, 2)
    rows = training_rows(docs, labels, "toxic", ~test, max_rows, max_bytes)
    model = fit([r["text"] for r in rows], np.array([r["label"] for r in rows], dtype=float))

    def start():
        score = model.scorer()

        def rows(doc_id, text):
            yield doc_id, score(text)

        return rows

    scored = map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), start, "doc_id long, score double")
    return scored.select("doc_id", test.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
