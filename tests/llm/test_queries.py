"""Operators on small awkward tables against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from articlelake.llm import byte_network, huffman_files, line_dedup, main_text, mixing, ngram_join, packing, quotient_filter, toxicity, winnowing
from articlelake.llm.tables import stored
from articlelake.session import prepare, scratch_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, kept string"


@pytest.fixture(scope="module")
def session(spark):
    prepare(spark).conf.set("spark.sql.shuffle.partitions", "4")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def awkward():
    """Copies, near copies, ties, nulls in every column, empty and long texts, one hot source."""
    draw = random.Random(11)

    def words(n):
        return " ".join("".join(draw.choices("abcdefghijklm", k=draw.randint(2, 6))) for _ in range(n))

    base = words(60)
    texts = [words(draw.randint(1, 80)) for _ in range(40)] + [None, "", " \n ", "one two", "one two", words(9000)]
    for _ in range(70):  # a family whose members are linked with some of each other
        changed = base.split()
        for _ in range(draw.randint(0, 3)):
            changed[draw.randrange(60)] = words(1)
        texts.append(" ".join(changed))
    texts += [base] * 8 + [base.upper() + "\n" + words(1)]
    rows = [(k, t, "en", "hot" if k % 3 else f"s{k % 7}", 1, "x", "y") for k, t in enumerate(texts)]
    rows += [(None, "no id", None, None, None, None, None), (None, None, None, None, None, None, None)]
    return rows + [rows[3], rows[3], (7, "other text", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(session):
    rows = awkward()
    return stored(session.createDataFrame(rows, SCHEMA).repartition(3), "awkward"), rows


@pytest.fixture(scope="module")
def nothing(session):
    return stored(session.createDataFrame([], SCHEMA), "nothing")


def by_key(frame, *keys):
    return sorted((tuple(r[k] for k in keys) for r in frame.collect()), key=repr)


def linked_components(rows):
    sets = []
    for doc_id, text, *_ in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = {}
    for k, (doc_id, *_) in enumerate(rows):
        if doc_id is not None and sets[k]:
            least[root(k)] = min(least.get(root(k), doc_id), doc_id)
    return [(r[0], len(s), least.get(root(k)) if s else r[0]) for k, (r, s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("short_list", [48, 3])
def test_ngram_join(docs, nothing, monkeypatch, short_list):
    monkeypatch.setattr(ngram_join, "SHORT_LIST", short_list)
    monkeypatch.setattr(ngram_join, "PAIRS_PER_TASK", 5)
    frame, rows = docs
    assert by_key(ngram_join.join(frame), "doc_id", "n_shingles", "component_id") == sorted(linked_components(rows), key=repr)
    if short_list == 3:
        assert ngram_join.join(nothing).count() == 0
        kept = ngram_join.representatives(frame)
        assert kept.columns == frame.columns and kept.count() < len(rows)


def test_ngram_join_of_null_and_repeated_ids(session):
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghij", k=5)) for _ in range(400)]

    def near(text):
        return " ".join(text.split()[:-1] + ["changed"])

    one, two, three, four = (" ".join(words[k : k + 90]) for k in (0, 95, 190, 285))
    rows = [(1, one), (None, near(one)), (None, near(one))]  # a link through rows without an id
    rows += [(None, two), (None, near(two)), (None, two), (None, "")]  # a group without any id
    rows += [(7, three), (7, four), (7, "of a third text only"), (8, near(three)), (9, near(four)), (9, near(four))]  # one id, several texts
    rows = [(k, text, "en", "s", 1, "x", "y") for k, text in rows]
    frame = stored(session.createDataFrame(rows, SCHEMA).repartition(3), "null-ids")
    assert by_key(ngram_join.join(frame), "doc_id", "n_shingles", "component_id") == sorted(linked_components(rows), key=repr)
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.representatives(frame.withColumn("text_hash", F.lit(1)).withColumn("_id", F.lit(2))).collect()]
    assert (1, one) in kept and (None, "") in kept and (None, near(one)) not in kept
    assert ((None, two) in kept) != ((None, near(two)) in kept)
    assert sorted(text for k, text in kept if k == 7) == sorted([three, four, "of a third text only"]) and not [k for k, _ in kept if k in (8, 9)]


def test_exact_dedup(docs, nothing):
    frame, rows = docs
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc_id)
    marked = quotient_filter.mark_copies(frame).select("row.doc_id", "row.text", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert len(marked) == len(rows)
    survivors = {}
    for r in marked:
        ids = groups[r["text"] or ""]
        assert r["group_size"] == len(ids) and r["text_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
        if r["kept"]:
            assert r["doc_id"] == r["keep_id"]
            survivors[r["text"] or ""] = survivors.get(r["text"] or "", 0) + 1
    assert survivors == dict.fromkeys(groups, 1)
    assert quotient_filter.drop_copies(frame).columns == frame.columns
    assert quotient_filter.drop_copies(nothing).count() == 0


def test_token_files(session, docs, nothing):
    frame, rows = docs
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = huffman_files.read(session, huffman_files.write(frame, scratch_folder(session, "ids"), path, 2)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    at, wanted = 0, []
    for r in got:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]) // 4) and zlib.crc32(r["ids"]) == r["ids_crc32"]
        at += r["n_tokens"]
    for r in rows:
        wanted.append(np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [2], dtype="<u4").tobytes())
    assert sorted(bytes(r["ids"]) for r in got) == sorted(wanted)
    assert huffman_files.read(session, huffman_files.write(nothing, scratch_folder(session, "ids"), path, 2)).count() == 0


def test_packing(docs, nothing):
    frame, rows = docs
    path = public_tokenizers.path("word_bpe_49k.json")
    found = stored(packing.pieces(frame, path, 1, keep_ids=True), "pieces")
    placed = stored(packing.pack(found), "placed")
    keys = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert by_key(placed, *keys) == by_key(found, *keys)
    bins = {}
    for r in placed.collect():
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096
    total = sum(n for parts in bins.values() for _, n in parts)
    assert len(bins) <= -(-total // 4096) + 1
    built = packing.sequences(found, placed)
    assert built.select(F.sum(F.octet_length("ids"))).first()[0] == 4 * total and built.count() == len(bins)
    assert packing.pack(stored(packing.pieces(nothing, path, 1), "pieces")).count() == 0


def test_mixing(docs, nothing):
    frame, rows = docs
    got = mixing.mix(frame, block_words=16).collect()
    sizes = {}
    for _, text, _, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(mixing.WORD, text or ""))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, free = {}, {s for s in names if sizes[s]}
    left = 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    target.update({s: level * weight[s] for s in free})
    wanted = {round(v, 6) for v in target.values()}
    assert len(got) == len(rows) and {round(r["target"], 6) for r in got} <= wanted | {0.0}
    taken = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["target"]] = taken.get(r["target"], 0) + r["taken"]
    assert all(abs(n - t) <= 0.5001 for t, n in taken.items())
    again = mixing.mix(frame, block_words=16)
    assert by_key(again, "doc_id", "size", "taken") == sorted(((r["doc_id"], r["size"], r["taken"]) for r in got), key=repr)
    assert mixing.mix(nothing).count() == 0
    assert mixing.mixed_documents(frame).columns == frame.columns


def test_winnowing_neighbours(docs, nothing):
    frame, rows = docs
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    got = winnowing.with_neighbours(frame)
    wanted = []
    for k, (doc_id, text, *_) in enumerate(order):
        edited = winnowing.edited_text(text or "", order[(k + 1) % len(order)][1] or "")
        own, other, following = (np.unique(winnowing.winnow(t)[0]) for t in (text or "", edited, order[(k + 1) % len(order)][1] or ""))
        wanted.append((doc_id, len(text or ""), hashlib.sha256(edited.encode()).hexdigest(), winnowing.likeness(own, other), winnowing.likeness(own, following)))
    assert by_key(got, "doc_id", "n_chars", "edited_sha256", "near_edited", "near_next") == sorted(wanted, key=repr)
    assert winnowing.with_neighbours(nothing).count() == 0


def test_line_dedup(session, nothing):
    long = "the quick brown fox jumps over the lazy dog near the old stone bridge by the river while the sun goes down slowly behind far hills"
    rows = [(1, f"{long}\nfirst own line here"), (2, f"Short\n{long.upper()}!\nsecond own line here"), (3, None), (None, long), (4, "Short\nShort")]
    rows += [(5, "first own line here")] * 2
    got = line_dedup.dedup_lines(session.createDataFrame(rows, "doc_id long, text string"))
    assert by_key(got, "doc_id", "text") == sorted(
        [(1, f"{long}\nfirst own line here"), (2, "Short\nsecond own line here"), (3, ""), (None, ""), (4, "Short\nShort"), (5, ""), (5, "")], key=repr
    )
    assert line_dedup.dedup_lines(nothing).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_one_changed_place_is_found_at_any_length(session):
    draw = random.Random(9)
    rows, han = [], "这是一个关于海港的故事在冬天关闭了"
    for n in (4, 10, 20, 40, 100):
        for k in range(12):
            words = ["".join(draw.choices("abcdefghijklm", k=draw.randint(4, 8))) for _ in range(n)]
            at = draw.randrange(n)
            # A letter goes or comes; from eleven words on a whole word is another one.
            edits = (words[at][1:], words[at] + "x", "".join(draw.choices("nopqrst", k=4)) if n >= 20 else "x" + words[at][1:])
            rows += [" ".join(words), " ".join([*words[:at], edits[k % 3], *words[at + 1 :]])]
    rows += [han, han, "two words"]
    table = [(2 * k, t) for k, t in enumerate(rows)] + [(2 * len(rows) - 2, "two words")]
    got = {r["doc_id"]: r["n_kept"] for r in line_dedup.dedup_lines(session.createDataFrame(table, "doc_id long, text string")).collect()}
    assert [got[2 * k] for k in range(len(rows))] == [1, 0] * (len(rows) // 2) + [1]


def test_words_of_spaced_lines_are_counted_without_scripts(session):
    han, thai = "这是一个关于海港的故事", "ภาษาไทย"
    lines = ["", "one", "one two three", "élan кот δύο", "שלום مرحبا हिंदी", han, f"in {han} 2", thai, f"{thai} and one", "가나 다라", "𠀀𠀁 x", "ᏣᎳᎩ one"]
    wanted = [0, 1, 3, 3, 3, len(han), len(han) + 2, len(thai), len(thai) + 2, 2, 3, 2]
    words = line_dedup._n_words(F.col("line"))
    frame = session.createDataFrame([(k, t) for k, t in enumerate(lines)], "k int, line string").filter("line <> ''")
    slow = F.regexp_count("line", F.lit(rf"{line_dedup._UNSPACED}|[^ {line_dedup._UNSPACED[1:-1]}]+"))
    got = frame.select("k", words.alias("n"), slow.alias("slow")).collect()
    assert all(r["n"] == r["slow"] == wanted[r["k"]] for r in got) and len(got) == len(lines) - 1


def test_long_lines_join_within_a_tenth(session):
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefghijklm", k=7)) for _ in range(1000)]
    # Seventy words with other letters: 490 of 7,999 characters, 6 %.
    changed = words[:60] + ["nopqrst"] * 70 + words[130:]
    rows = [(1, " ".join(words)), (2, " ".join(changed))]
    table = session.createDataFrame([(k, 0, len(t)) for k, t in rows], "id long, simhash long, size int")
    table = table.withColumn("ends", F.array().cast("array<bigint>")).withColumn("first", F.struct(F.col("id").alias("doc_id"), F.when(F.col("id") == 1, F.xxhash64(F.lit(rows[0][1]))).otherwise(F.xxhash64(F.lit(rows[1][1]))).alias("text_hash"), F.lit(0).alias("place")))
    docs = session.createDataFrame(rows, "doc_id long, text string")
    assert line_dedup.groups(docs, stored(table, "classes")).count() == 2


def test_letter_counts_never_refute_a_pair_within_the_edits(session):
    draw = random.Random(5)
    base = ["".join(draw.choices("abcdefghij klmnop éжם海", k=n)) for n in (3, 40, 300, 1000)]
    rows = [(0, "a" * 1023), (1, "b" * 1023), (2, "a" * 1024), (3, "𠀀" * 500)]
    rows += list(enumerate([t for b in base for t in (b, b[1:], b[:2] + "zz" + b[2:], b[::-1], "".join(draw.choices("qrstuv", k=len(b))))], 4))
    frame = session.createDataFrame(rows, "id long, line string")
    counts = line_dedup.letter_counts(frame)
    names = [f"c{k}" for k in range(line_dedup.LETTER_LONGS)]
    a, b = (counts.select(*(F.col(c).alias(f"{c}{k}") for c in ("id", *names))) for k in "ab")
    missing = line_dedup.letters_missing(*([F.col(f"{c}{k}") for c in names] for k in "ab"))
    texts, kinds = dict(rows), line_dedup.LETTER_LONGS * line_dedup.LETTER_FIELDS
    got = a.crossJoin(b).select("ida", "idb", missing.alias("n")).collect()
    assert {r["ida"] for r in got} == {k for k, t in rows if len(t) <= line_dedup.MOST_COUNTED}
    for r in got:
        x, y = (collections.Counter(ord(c) % kinds for c in texts[r[k]]) for k in ("ida", "idb"))
        assert r["n"] == (x - y).total()
    lines = [frame.select(F.col("id").alias(k), F.col("line").alias(f"line_{k}")) for k in "ab"]
    pairs = lines[0].crossJoin(lines[1]).filter("length(line_a) < 500 and length(line_b) < 500")
    far = pairs.withColumn("distance", F.expr("levenshtein(line_a, line_b)")).join(a.withColumnRenamed("ida", "a"), "a").join(b.withColumnRenamed("idb", "b"), "b")
    assert far.count() > 100 and far.filter(missing > F.col("distance")).count() == 0


def test_shared_ends_are_cut_and_the_distance_stays(session):
    draw = random.Random(6)
    start, end = ("".join(draw.choices("abcd ", k=400)) for _ in range(2))
    texts = [start + end, start + "x" + end, start + end[1:], "y" + start + end, start + end + "z", start, end, start[:20], "", "ab", "aab", "é" * 40, "é" * 30, start + "ж海" + end]
    rows = [(i, j, x, y) for i, x in enumerate(texts) for j, y in enumerate(texts)]
    pairs = session.createDataFrame(rows, "a long, b long, line_a string, line_b string")
    cut = line_dedup._without_ends(pairs).withColumn("left", F.expr("levenshtein(line_a, line_b)"))
    got = cut.withColumn("n", F.length("line_a") + F.length("line_b")).drop("line_a", "line_b").join(pairs, ["a", "b"])
    got = got.withColumn("whole", F.expr("levenshtein(line_a, line_b)")).collect()
    assert len(got) == len(rows) and all(r["left"] == r["whole"] and r["allowed"] == max(len(r["line_a"]), len(r["line_b"])) // 10 for r in got)
    by = {(r["a"], r["b"]): r["n"] for r in got}
    assert by[0, 1] <= 250 and by[0, 0] <= 15 and by[0, 3] <= 250


def test_simhash_is_the_majority_of_word_hashes(session):
    draw = random.Random(7)
    texts = [" ".join(f"w{draw.randrange(50)}" for _ in range(n)) for n in (3, 4, 57, 58, 700)] + ["a b a b", "This -- is\u0085the;same  line ", "this is the same line"]
    found = line_dedup.lines(session.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    words = session.createDataFrame([(k, w) for k, t in enumerate(texts) for w in re.split(r"[^a-z0-9]+", t.lower().strip()) if w], "k long, word string")
    hashes = collections.defaultdict(list)
    for r in words.select("k", F.xxhash64("word").alias("h")).collect():
        hashes[r["k"]].append(r["h"])
    got = {r["doc_id"]: r["simhash"] for r in found.collect()}
    for k, hs in hashes.items():
        bits = sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hs) > len(hs))
        assert got[k] % (1 << 64) == bits
    # More words than leave a bit free are compared one by one.
    sums = [F.lit((300_000 if k % 2 else 299_999) * line_dedup._EVERY_FIELD) for k in range(line_dedup.FIELD)]
    bits = session.range(1).select(line_dedup._majority(sums, F.lit(599_998).cast("long")).alias("bits")).first()["bits"]
    assert bits % (1 << 64) == sum(1 << bit for bit in range(64) if bit % line_dedup.FIELD % 2)


@pytest.mark.parametrize("score,label", [(byte_network.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_scores_of_all_rows(session, docs, nothing, score, label):
    frame, rows = docs
    labels = session.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (3, None)], f"doc_id long, {label} int")
    got = score(frame, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    parts, part = (5, 0) if label == "quality" else (4, 2)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % parts == part) for r in got)
    assert score(nothing, labels).count() == 0 and score(frame, labels.limit(0)).count() == len(rows)


def test_pages_of_any_kind(session):
    rows = [(1, "u", None, "c"), (1, "u", "", "c"), (None, None, "<p>x", "c")]
    pages = session.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert main_text.extract(pages).count() == 3 and main_text.extract(pages.limit(0)).count() == 0
