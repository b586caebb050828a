import random

import numpy as np
import pytest

from horograph.llm import leaks
from horograph.llm.fm_index import FMIndex, phrase_steps, suffix_array
from horograph.llm.text import WordIds, words

DOCS, ITEMS = "doc_id bigint, text string, item_id string, share int", "item_id bigint, item_text string, doc_id string"
rng = random.Random(4)
VOCAB = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
passage = lambda n: [rng.choice(VOCAB) for _ in range(n)]


def changed(w, share, seed):
    r = random.Random(seed)
    out = []
    for x in w:
        k = r.random()
        if k < share / 3:
            continue
        out.append(r.choice(VOCAB) if k < 2 * share / 3 else x)
        if k > 1 - share / 3:
            out.append(r.choice(VOCAB))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_index_finds_every_place(seed):
    r = np.random.default_rng(seed)
    s = r.integers(0, r.integers(2, 6), r.integers(1, 120))
    if seed % 3 == 0:
        b = r.integers(1, 5, 15)
        s = np.r_[b, 0, b, 0, b]
    s = np.r_[s, 0]

    def suffix(p):
        out = []
        for q in range(p, len(s)):
            if s[q] == 0:
                return [*out, (0, q)]
            out.append((1, int(s[q])))

    assert list(suffix_array(s)) == sorted(range(len(s)), key=suffix)
    index = FMIndex(s, 6, sample=4)
    for k in (1, 2, 3):
        p = np.unique(r.integers(1, 6, (25, k)), axis=0)
        lo, hi = index.search(phrase_steps(p))
        for x, a, b in zip(p, lo, hi):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(s) - k + 1) if (s[i : i + k] == x).all()]


def test_words_of_dirty_texts():
    assert words("The ﬁrst RESIL-\nient <b>café</b> &amp; Ｆull　width, dÃ©jÃ  x­yz") == ["the", "first", "resilient", "café", "full", "width", "déjà", "xyz"]
    ids = WordIds({"café": 1, "a": 2, "b": 3})
    assert ids.of("CAFÉ a—b — unknown") == [1, 2, 3, 0]
    assert words("") == [] and ids.of("") == []


def test_leaks_are_found_and_lookalikes_not(spark):
    items = [(k, passage(rng.randrange(95, 200))) for k in range(12)]
    docs, want = [], set()
    for k, w in items:
        h = len(w) // 2 + 2
        for d, piece in enumerate([w, changed(w, 0.12, k), w[:h], changed(w[-h:], 0.1, k + 50)]):
            docs.append((100 * k + d, passage(150) + piece + passage(80)))
            want.add((100 * k + d, k))
        q = len(w) // 4
        docs.append((100 * k + 10, passage(50) + w[:q] + passage(100)))
        docs.append((100 * k + 11, sum([w[i : i + 4] + passage(9) for i in range(0, len(w), 4)], [])))
    text = lambda w, d: (" ".join(w).upper() if d % 2 else ",\n".join(w))
    rows = [(d, text(w, d), "x", 1) for d, w in docs] + [(9000, None, "", 0), (9001, "", "", 0), (9002, " .,", "", 0), (9003, text(items[0][1], 0), "", 0), (9004, text(items[0][1], 0), "", 0)]
    want |= {(9003, 0), (9004, 0)}
    found = leaks.find_leaks(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame([(k, " ".join(w), "x") for k, w in items] + [(99, None, ""), (98, "one two", "")], ITEMS))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want
    spans = {r["doc_id"]: (r["first_word"], r["last_word"]) for r in leaks.removal_spans(found).collect()}
    assert spans[0] == (150, 150 + len(items[0][1]) - 1)


def test_long_text_in_pieces(spark):
    item = passage(120)
    text = passage(3000) + item + passage(2500) + item + passage(40)
    d, i = spark.createDataFrame([(1, " ".join(text), "", 0)], DOCS), spark.createDataFrame([(7, " ".join(item), "")], ITEMS)
    a, b = leaks.find_leaks(d, i).collect(), leaks.find_leaks(d, i, block_words=500).collect()
    assert len(a) == len(b) == 1 and a[0]["share"] == b[0]["share"] == 1.0


def test_empty(spark):
    d, i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert leaks.find_leaks(d, i).count() == 0
    assert leaks.find_leaks(spark.createDataFrame([(1, "a b", "", 0)], DOCS), i).count() == 0
    assert leaks.removal_spans(leaks.find_leaks(d, spark.createDataFrame([(1, "a b c d e f", "")], ITEMS))).count() == 0


def test_items_in_groups_are_all_found(spark):
    items = [(k, passage(100)) for k in range(9)]
    docs = spark.createDataFrame([(k, " ".join(passage(40) + w), "", 0) for k, w in items], DOCS)
    found = leaks.find_leaks(docs, spark.createDataFrame([(k, " ".join(w), "") for k, w in items], ITEMS), group_chars=1500)
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(k, k) for k in range(9)]


@pytest.mark.parametrize("seed", range(4))
def test_stock_phrases_lose_no_leak_and_cost_little(seed, monkeypatch):
    """Items that share stock phrases; the search from rare phrases gives what a look at every pair gives."""
    r = random.Random(seed)
    words_of = lambda n: [r.choice(VOCAB[:400]) for _ in range(n)]
    stock = [words_of(7) for _ in range(4)]
    item = lambda: sum([words_of(r.randrange(8, 20)) + r.choice(stock) for _ in range(7)], [])
    items = [(k, " ".join(item())) for k in range(15)]
    phrases = leaks.Phrases(items, 5)
    docs = []
    for k in range(60):
        w = items[r.randrange(15)][1].split()
        h = r.randrange(0, len(w) // 2)
        piece = changed(w[h : h + len(w) // 2 + 4], 0.1, seed * 100 + k) if k % 3 == 0 else w[h : h + len(w) // 4]
        docs.append(sum(stock * 3, []) + piece + words_of(30) + r.choice(stock))
    seqs = [np.array([phrases.vocabulary.get(x, 0) for x in d] + [0]) for d in docs]
    starts = np.cumsum([0, *map(len, seqs)])[:-1]
    got = leaks._search_block(np.concatenate(seqs), starts, phrases, leaks.SHARE)
    want = []
    for d, s in enumerate(seqs):
        places = {}
        for q in range(len(s) - 5):
            places.setdefault(tuple(s[q : q + 5].tolist()), []).append(q)
        for i, t in enumerate(phrases.words):
            at = [(p, q) for p in range(len(t) - 4) for q in places.get(tuple(t[p : p + 5].tolist()), [])]
            need = int(np.ceil(leaks.FIRST * len(t)))
            if len(at) * 5 < need:
                continue
            p, q = np.array(at).T
            covered, band = leaks._best_band(q - p, p, len(t), 5, need)
            if covered >= need and (x := leaks._exact(t, s, band, leaks.RUN))[0] >= leaks.SHARE:
                want.append((d, i, *x))
    assert sorted(got) == sorted(want) and len(want) >= 15
    monkeypatch.setattr(leaks, "SLICE", 50)
    assert sorted(leaks._search_block(np.concatenate(seqs), starts, phrases, leaks.SHARE)) == sorted(want)
