"""Array code against plain loops, exact round trips and held-out accuracy; no Spark."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from articlelake.llm import byte_network, huffman_files, main_text, packing, quotient_filter, shingles, token_ids, toxicity, winnowing


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_give_the_ids_of_whole_texts(name):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    library.encode_special_tokens = True
    encode = token_ids.TextEncoder(public_tokenizers.path(name))
    draw = random.Random(3)
    signs = [" ", "  ", "   ", "\n", "\n\n", "\t", "\x1f", "\x85", "a", "The", "é", "é", "'s", "12", "!?", "中", "İ", "<|endoftext|>"]
    texts = ["", " ", "\n", "word " * 4000] + ["".join(draw.choices(signs, k=draw.randint(0, 30))) for _ in range(4000)]
    for text in texts:
        ids = np.frombuffer(encode(text), dtype="<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, text
    plain = [chr(k) for k in range(32, 127)] * 2 + list("etaoinETAO  ") * 6 + ["don't", "<|startoftext|>", "2024", "é"]
    for _ in range(6000):
        text = "".join(draw.choices(plain, k=draw.randint(1, 40)))
        ids = np.frombuffer(encode(text), dtype="<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=900), st.integers(9, 16))
def test_huffman_round_trip(ids, limit):
    ids = np.array(ids, dtype=np.uint32)
    lengths = huffman_files.code_lengths(np.bincount(ids, minlength=301), limit)
    assert lengths.max() <= limit
    data, points = huffman_files.encode_bits(ids, huffman_files.canonical_codes(lengths), lengths)
    sizes = huffman_files.stretch_sizes(np.array([len(ids)]))
    assert (huffman_files.decode_bits(data, points, sizes, huffman_files.decoding_table(lengths)) == ids).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1), st.lists(st.integers(0, 60), min_size=1))
def test_filters_merge_to_exact_counts(a, b):
    def built(values):
        found, counts = np.unique(np.array(values, dtype=np.uint64) << np.uint64(40), return_counts=True)
        part = quotient_filter.CountingQuotientFilter.build(56, found, counts)
        return quotient_filter.CountingQuotientFilter.from_bytes(part.to_bytes())

    values, counts = built(a).merge(built(b)).values()
    wanted, n = np.unique(np.array(a + b, dtype=np.uint64) << np.uint64(40), return_counts=True)
    assert (values == wanted).all() and (counts == n).all()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 8))
def test_packer_keeps_all_items_within_capacity(lengths, open_bins):
    packer = packing.Packer(50, open_bins)
    bins = [b for k, n in enumerate(lengths) for b in packer.add((k, n), n)] + list(packer.finish())
    assert sorted(x for b in bins for x in b) == list(enumerate(lengths))
    assert all(sum(n for _, n in b) <= 50 for b in bins)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAb é\n\t ", max_size=60))
def test_shingles_are_those_of_plain_words(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    wanted = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    assert len(shingles.shingle_set(text)) == len(wanted)
    assert (shingles.shingle_set(text) == shingles.shingle_set(" ".join(words))).all()


def test_shared_passages_are_found():
    draw = random.Random(1)
    def word():
        return "".join(draw.choices("abcdefgh", k=5))

    passage = " ".join(word() for _ in range(20))
    a, b = (" ".join(word() for _ in range(80)) + " " + passage + " " + word() for _ in range(2))
    (ha, pa), (hb, pb) = winnowing.winnow(a), winnowing.winnow(b)
    common = set(ha.tolist()) & set(hb.tolist())
    assert common
    where = dict(zip(ha.tolist(), pa.tolist(), strict=True))
    assert any(where[h] >= a.index(passage) for h in common)
    assert winnowing.likeness(np.unique(ha), np.unique(ha)) == 1.0
    assert winnowing.likeness(ha[:0], ha[:0]) == 1.0 and winnowing.likeness(ha[:0], np.unique(ha)) == 0.0
    assert len(winnowing.winnow("")[0]) == 0 and len(winnowing.winnow(" \n\t")[0]) == 0 and len(winnowing.winnow("ab")[0]) == 1


def test_winnowing_equals_a_plain_loop():
    draw = random.Random(5)
    for _ in range(40):
        text = "".join(draw.choices("aab ", k=draw.randint(1, 90)))
        hashes, places = winnowing.winnow(text, gram=3, window=4)
        letters = [k for k, c in enumerate(text) if c != " "]
        runs = [text.replace(" ", "")[k : k + 3] for k in range(max(1, len(letters) - 2))] if letters else []
        value = {run: int(winnowing.winnow(run, gram=3, window=4)[0][0]) for run in runs}
        kept = []
        width = min(4, len(runs))
        for k in range(len(runs) - width + 1 if runs else 0):
            at = min(range(k, k + width), key=lambda j: (value[runs[j]], -j))
            if not kept or kept[-1] != at:
                kept.append(at)
        assert hashes.tolist() == [value[runs[k]] for k in kept]
        assert places.tolist() == [letters[k] for k in kept]


def test_main_text_leaves_out_what_surrounds_the_article():
    long = "The harbour was closed for the winter and all of the boats that were in it had to be taken to the other side of the bay, where they are to stay until the ice has gone and it is safe for them to return to the town."
    page = (
        f"<html><head><title>T</title><script>var a='<p>{long}</p>';</script></head><body><nav><a href=/>Home</a></nav>"
        f"<div class='cookie-notice'><p>{long}</p></div><div id=main><h2>On the bay</h2><p>{long}<br>more &amp; more&nbsp;&#8212; x</p><p>Short end."
        f"</div><aside><p>{long}</p></aside><div class=comments><p>{long}</p></div><form><p>{long}</p></form><footer>{long}</footer></body></html>"
    )
    assert main_text.main_text(page) == f"On the bay\n{long} more & more — x\nShort end."
    assert main_text.main_text(None) == main_text.main_text("") == main_text.main_text("<p></p>") == ""


def test_main_text_survives_unclosed_and_empty_silent_elements():
    long = "The harbour was closed for the winter and all of the boats that were in it had to be taken to the other side of the bay, where they are to stay until the ice has gone and it is safe for them to return to the town."
    assert main_text.main_text(f"<html><head><title>T</title><body><article><p>{long}</article>") == long
    assert main_text.main_text(f"<html><head><title>T</title><meta charset=x><article><p>{long}</article>") == long
    for tag in ("svg", "iframe", "canvas", "object"):
        assert main_text.main_text(f"<article><p>{long}</p><{tag} a='b' /><p>{long}</p><{tag}>no</{tag}><p>{long}</p></article>") == "\n".join([long] * 3)
        assert main_text.main_text(f"<article><div><{tag}>no</div><p>{long}</p></article>") == long
        assert main_text.main_text(f"<article><p>{long} <{tag}><div>no</div></{tag}>more</p></article>") == f"{long} more"
    page = f"<article><p>{long}</p><p>So <math><mi>x</mi></math> is it.</p><figure><figcaption>{long}</figcaption></figure></article><script>a"
    assert main_text.main_text(page) == f"{long}\nSo x is it.\n{long}"


def test_names_of_containers_do_not_lose_the_article():
    long = "The harbour was closed for the winter and all of the boats that were in it had to be taken to the other side of the bay, where they are to stay until the ice has gone and it is safe for them to return to the town."
    for tag in ("main class='content-with-sidebar'", "article class='post has-social-share'", "div id=page class=no-sidebar", "div class='legal-news'", "div class=sidebar"):
        page = f"<body><{tag}><p>{long}</p></{tag.split()[0]}><div class='left-sidebar'><p>Is it on? {long[:90]}</p></div></body>"
        assert main_text.main_text(page) == long, tag
    assert main_text.main_text(f"<div class='layout sidebar'><main><p>{long}</p></main></div><div class=comments><p>{long * 3}</p></div>") == long
    assert main_text.main_text(f"<article><header class='entry-header header'><h1>Ice</h1></header><p>{long}</p></article>") == f"Ice\n{long}"


def test_swapped_identity_terms_do_not_move_the_score():
    texts = ["gay people are idiot here"] * 8 + ["gay women idiot"] * 4 + ["straight people are fine here"] * 20 + ["all is well"] * 20
    labels = np.array([1.0] * 12 + [0.0] * 40)
    fair, plain = toxicity.fit(texts, labels), toxicity.fit(texts, labels, fairness=0.0)
    gap = [m.scorer()("gay people are here") - m.scorer()("straight people are here") for m in (fair, plain)]
    assert abs(gap[0]) < abs(gap[1]) / 2
    assert fair.scorer()("what an idiot") > 0.5 > fair.scorer()("")
    assert toxicity.fit([], np.array([])).scorer()("x") == 0.5


@pytest.mark.parametrize("term,other", [("muslim", "jewish"), ("immigrants", "refugees"), ("transgender", "heterosexual")])
def test_beginnings_of_identity_terms_do_not_move_the_score(term, other):
    texts = [f"{term} people are here"] * 12 + [f"{other} people are here"] * 20 + ["all is well"] * 20
    labels = np.array([1.0] * 12 + [0.0] * 40)

    def gap(model):
        score = lambda t: (lambda p: np.log(p / (1 - p)))(model.scorer()(t))
        return abs(score(f"{term} people") - score(f"{other} people"))

    fair, plain = toxicity.fit(texts, labels), toxicity.fit(texts, labels, fairness=0.0)
    assert gap(fair) < gap(plain) / 4
    gone, new = next(x for x in toxicity.counterfactuals({term, term + "ly"}) if other in x[1])
    assert gone == {term} and new == set(toxicity.features_of(other))


def test_network_learns_and_reads_to_the_end():
    draw = random.Random(2)
    good = [" ".join(draw.choices(["the", "sea", "is", "calm", "and", "blue,"], k=draw.randint(5, 200))) for _ in range(150)]
    bad = [t.replace(" ", "### ") for t in good]
    net = byte_network.fit(good[:100] + bad[:100], np.array([1.0] * 100 + [0.0] * 100, dtype=np.float32), epochs=6)
    assert np.mean([net.score(t) >= 0.3 for t in good[100:]]) > 0.95
    assert np.mean([net.score(t) < 0.3 for t in bad[100:]]) > 0.95
    long = good[0] * 3000
    assert net.score(long) != net.score(long + bad[0] * 3000)
    assert np.allclose(net.best_halves(byte_network.padded(long)), net.halves(byte_network.padded(long))[0], atol=1e-4)
    assert 0 <= net.score(None) == net.score("") <= 1
