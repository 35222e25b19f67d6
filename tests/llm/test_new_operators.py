"""Chosen paths, the Merkle manifest and phrases on small awkward tables, against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from articlelake.llm import chosen_path, merkle, phrases
from articlelake.llm.shingles import shingle_set
from test_queries import SCHEMA, awkward, by_key, docs, nothing, session  # noqa: F401


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    def leaf(values):
        return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([digest(levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
        return levels

    def path(levels, at):
        for nodes in levels[:-1]:
            first = at // 3 * 3
            yield nodes[first:at], nodes[at + 1 : first + 3]
            at //= 3

    sources = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        own = leaf((doc_id, source, lang, n_chars, text))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        changed = leaf((doc_id, source, lang, n_chars, None if text is None else text.replace("\n", ""))) if hit else own
        sources.setdefault(source, []).append(((doc_id is not None, doc_id), own, changed))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([own for _, own, _ in sorted(sources[s])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    found = []
    for k, s in enumerate(names):
        for i, ((_, doc_id), own, changed) in enumerate(sorted(sources[s])):
            steps = [*path(trees[s], i), *path(top, k)]
            back = changed
            for before, after in steps:
                back = digest([*before, back, *after])
            proof = digest(x for before, after in steps for x in before + after)
            found.append((doc_id, own, trees[s][-1][0], top[-1][0], proof, back, back == top[-1][0]))
    return sorted(found, key=repr)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_equals_a_plain_tree(docs, nothing, monkeypatch, levels):  # noqa: F811
    monkeypatch.setattr(merkle, "LEVELS", levels)
    frame, rows = docs
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert by_key(merkle.manifest(frame), *columns) == plain_manifest(rows)
    if levels == 1:
        assert merkle.manifest(nothing).count() == 0
        alone = merkle.manifest(frame.filter("doc_id = 20")).first()
        assert alone["leaf"] == alone["subroot"] == alone["root"] and alone["proof_sha256"] == digest([])


@pytest.mark.parametrize("number", [1, 2, 3, 4, 5, 9, 10, 14, 27, 28, 31])
def test_butterfly_gives_every_block_the_whole_upper_tree(session, number):  # noqa: F811
    nodes = [digest([str(k)]) for k in range(number)]
    table = session.createDataFrame([("g", k, number, h) for k, h in enumerate(nodes)], "group string, block long, blocks long, node string")
    height = next(k for k in range(9) if 3**k >= number)
    levels = merkle.grow(nodes, height)
    got = {r["block"]: r for r in merkle.butterfly(table).collect()}
    assert len(got) == number
    for k, row in got.items():
        path = [(p["before"], p["after"]) for p in row["path"]]
        assert row["node"] == levels[-1][0] == merkle.folded(nodes[k], path) and path == list(merkle.siblings(levels, k))


def plain_collocations(rows, least, top):
    counts, totals = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    found = []
    for lang, c in counts.items():
        often = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in often.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in often.items()):
                continue
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            found.append((lang, rank, p.decode(), -a, l, r, totals[lang], -score))
    return sorted(found, key=repr)


def phrase_rows():
    draw = random.Random(4)
    names = ["Sea", "sea", "ice", "é", "中文", "a-b", "x'y", "of", "the"]
    marks = [" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\x0b", "! ", "\x1f"]
    texts = ["".join(draw.choice(names) + draw.choice(marks) for _ in range(draw.randint(0, 90))) for _ in range(60)]
    texts += [None, "", " \n", "word", "the sea " * 4000, ". ".join(["of the ice"] * 30)]
    langs = ["en", "en", "en", "de", None, "und"]
    return [(k % 50, t, langs[k % 6], "s", 1, "x", "y") for k, t in enumerate(texts)] + [(None, texts[0], "en", None, None, None, None)] * 2


@pytest.mark.parametrize("held,stretch", [(1 << 19, 1 << 20), (50, 100)])
def test_collocations_equal_plain_counts(session, nothing, monkeypatch, held, stretch):  # noqa: F811
    monkeypatch.setattr(phrases, "HELD", held)
    monkeypatch.setattr(phrases, "ROUTE", 40 if held == 50 else phrases.ROUTE)
    cut = phrases.stretches
    monkeypatch.setattr(phrases, "stretches", lambda text: cut(text, stretch))
    rows = phrase_rows()
    frame = session.createDataFrame(rows, SCHEMA).repartition(3)
    columns = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert by_key(phrases.collocations(frame, top=25), *columns) == plain_collocations(rows, 10, 25)
    assert phrases.collocations(nothing).count() == 0


def test_quicksort_counts_all_frequent_prefixes():
    draw = np.random.default_rng(2)
    rows = np.sort(draw.integers(0, 6, (400, 3)), axis=1)[:, ::-1].astype(np.int32)
    weights = draw.integers(1, 4, 400)
    wanted = Counter()
    for row, n in zip(rows.tolist(), weights.tolist(), strict=True):
        for k in (2, 3):
            if 0 not in row[:k]:
                wanted[tuple(row[:k])] += n
    for least in (1, 10, 60):
        got = {tuple(p): n for p, n in phrases.frequent(rows, weights, least)}
        assert got == {p: n for p, n in wanted.items() if n >= least}
    assert b"".join(phrases.stretches(b"ab. cd\nef gh", 3)) == b"ab. cd\nef gh"


def links_by_four_words(rows):
    spaced = [(r[0], " ".join(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")), *r[2:]) for r in rows]
    sets = [shingle_set(t, 4) for _, t, *_ in spaced]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a]) and len(sets[b]):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    up[root(a)] = root(b)
    least = {}
    for k, (doc_id, *_) in enumerate(rows):
        if doc_id is not None and len(sets[k]):
            least[root(k)] = min(least.get(root(k), doc_id), doc_id)
    out = [(r[0], len(s), least.get(root(k)) if len(s) else r[0]) for k, (r, s) in enumerate(zip(rows, sets, strict=True))]
    return sorted(((d, n, c, d == c) for d, n, c in out), key=repr)


@pytest.mark.parametrize("small,hot", [(8, 200_000), (1, 5)])
def test_chosen_paths_find_all_components(session, nothing, monkeypatch, small, hot):  # noqa: F811
    monkeypatch.setattr(chosen_path, "SMALL", small)
    monkeypatch.setattr(chosen_path, "HOT_ROWS", hot)
    monkeypatch.setattr(chosen_path, "PAIRS_PER_TASK", 5)
    rows = awkward()
    near = rows[50][1].split()
    rows += [(None, " ".join(["zz", *near[1:]]), None, None, None, None, None), (7, " ".join([*near[:-1], "zz"]), "en", "s", 1, "x", "y")]
    frame = session.createDataFrame(rows, SCHEMA).repartition(3)
    assert by_key(chosen_path.join(frame), "doc_id", "n_shingles", "component_id", "kept") == links_by_four_words(rows)
    if small == 1:
        assert chosen_path.join(nothing).count() == 0


def test_near_copies_around_the_threshold_give_few_pairs(session, monkeypatch):  # noqa: F811
    draw = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(300):
        words = list(base)
        for _ in range(draw.choice((2, 3, 4, 9))):
            words[draw.randrange(120)] = f"x{draw.randrange(10**6)}"
        rows.append((k, " ".join(words), "en", "s", 1, "x", "y"))
    made, stored = [], chosen_path.stored

    def counted(frame, name, **how):
        table = stored(frame, name, **how)
        if name in ("path-near", "path-pairs", "path-confirmed"):
            made.append(table.count())
        return table

    monkeypatch.setattr(chosen_path, "stored", counted)
    # Blocks smaller than a node, so that their borders are crossed.
    monkeypatch.setattr(chosen_path, "BLOCK_SETS", 200, raising=False)
    monkeypatch.setattr(chosen_path, "BLOCK_ROWS", 200, raising=False)
    frame = session.createDataFrame(rows, SCHEMA)
    assert by_key(chosen_path.join(frame), "doc_id", "n_shingles", "component_id", "kept") == links_by_four_words(rows)
    assert max(made) < 10_000  # of 44,850 pairs


def test_sketches_estimate_similarity():
    draw = np.random.default_rng(1)
    for shared in (200, 800, 950):
        both = draw.integers(0, 1 << 63, 2 * 1000 - shared, dtype=np.uint64)
        a, b = both[:1000], both[1000 - shared :]
        equal = np.count_nonzero(chosen_path.sketch(np.sort(a)) == chosen_path.sketch(np.sort(b)))
        assert abs(equal / 64 - shared / (2000 - shared)) < 0.27
    chosen, names = chosen_path.roots()
    assert 0.7 * 1.25 * chosen_path.TREES < len(chosen) < 1.4 * 1.25 * chosen_path.TREES and len(set(names.tolist())) == len(names)
