import numpy as np
import pytest

from horograph.llm import mixing

DOCS, TARGETS = "doc_id bigint, source string, text string, tokens string, p string", "source string, target_share double, max_repeats int"


def test_flight_keeps_the_totals():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 50, 5000):
        p, t = rng.random(n), rng.integers(0, 900, n)
        q = mixing.flight(p, t, rng)
        assert ((q > 0) & (q < 1)).sum() <= 2 and ((q >= 0) & (q <= 1)).all()
        assert abs(q.sum() - p.sum()) < 1e-5 * max(1, n) and abs((q * t).sum() - (p * t).sum()) < 1e-2 * max(1, n)
    same = mixing.flight(np.full(30, 0.5), np.full(30, 7), rng)
    assert ((same > 0) & (same < 1)).sum() <= 2 and abs(same.sum() - 15) < 1e-6


def test_flight_is_unbiased():
    rng = np.random.default_rng(1)
    p, t = rng.random(12), rng.integers(1, 50, 12)
    mean = np.mean([mixing.flight(p, t, rng) for _ in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.04


def test_shares_and_caps(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [" Alpha", "BETA", "gamma ", "other", None][k % 5], " ".join(["word"] * int(rng.integers(1, 60))) if k % 11 else None, "x", "y") for k in range(3000)]
    targets = [("alpha", 0.3, 4), ("Beta", 0.1, 1), ("gamma", 0.5, 1), ("missing", 0.1, 3)]
    taken, report = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame(targets, TARGETS))
    r = {x["source"]: x for x in report.collect()}
    total = sum(len(t.split()) for _, s, t, *_ in rows if s and t)
    for name, share in (("alpha", 0.3), ("Beta", 0.1)):
        assert abs(r[name]["taken_tokens"] - share * total) < 150 and not r[name]["falls_short"]
    assert r["gamma"]["falls_short"] and r["gamma"]["taken_tokens"] == r["gamma"]["tokens"] and r["missing"]["falls_short"]
    copies = {(x["doc_id"]): x["copies"] for x in taken.collect()}
    assert len(copies) == taken.count() and max(copies.values()) <= 4
    assert sum(x["taken_tokens"] for x in r.values()) == sum(len(rows[d][2].split()) * c for d, c in copies.items())


def test_long_texts_count_as_a_whole():
    with open(mixing.TOKENIZER, "rb") as f:
        encode = mixing._encoding(f.read()).encode_ordinary
    text = "a few words, 12 numbers\n\n and  spaces; " * 9000
    assert mixing.count_tokens(encode, text) == len(encode(text))
    assert mixing.count_tokens(encode, "") == 0
    # nowhere to cut, then a place to cut
    for text in ("ab" * 230_000, "x  y" * 120_000, "\u00e4 " * 60_000 + "-" * 150_000 + " end"):
        assert mixing.count_tokens(encode, text) == len(encode(text))


def test_many_open_documents_settle_in_groups(spark):
    rows = [(k, "a" if k % 2 else "b", 1 + k % 7, 0.25 + 0.5 * (k % 2)) for k in range(400)]
    out = mixing.settle(spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint, p double"), 3, group=16).toPandas()
    assert len(out) == 400 and set(out["p"]) <= {0.0, 1.0}
    for s, share in (("a", 0.75), ("b", 0.25)):
        own = out[out["source"] == s]
        wanted = sum(t for _, x, t, _ in rows if x == s) * share
        assert abs(own["p"].sum() - 200 * share) < 1.01 and abs((own["tokens"] * own["p"]).sum() - wanted) <= 14


def test_shortfalls_come_from_the_drawn_rows(spark):
    taken = spark.createDataFrame([(1, "a", 10, 2), (2, "a", 20, 2), (3, "b", 10, 1), (4, "b", 30, 2)], "doc_id bigint, source string, tokens bigint, copies bigint")
    want = [{"name": n, "source": n, "share": s, "cap": c} for n, s, c in (("a", 0.7, 2), ("b", 0.8, 2), ("c", 0.1, 1), ("d", 0.0, 1))]
    rows = {r[0]: r for r in mixing.shortfalls(taken, want, {"a": (30, 2), "b": (40, 2)}, 100)}
    assert {n: r[-3] for n, r in rows.items()} == {"a": True, "b": False, "c": True, "d": False}
    assert all(r[-2] for r in rows.values()) and {n: r[-1] for n, r in rows.items()} == {"a": True, "b": True, "c": True, "d": True}
    over = mixing.shortfalls(taken, [{"name": "a", "source": "a", "share": 0.1, "cap": 1}], {"a": (30, 2)}, 100)[0]
    assert over[-3:] == (False, False, False)


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    taken, report = mixing.mix(none, spark.createDataFrame([("a", 1.0, 2)], TARGETS))
    assert taken.count() == 0 and report.first()["tokens"] == 0
    taken, report = mixing.mix(spark.createDataFrame([(1, "a", "", "", "")], DOCS), spark.createDataFrame([("a", 1.0, 2)], TARGETS))
    assert taken.count() == 0 and not report.first()["falls_short"]


@pytest.mark.parametrize("p", [[0.5, 0.5], [0.2, 0.1], [0.9], []])
def test_landing_is_as_near_as_it_can(p):
    for s in range(50):
        n = mixing.land(np.array(p), np.random.default_rng(s)).sum()
        assert np.floor(sum(p)) <= n <= np.ceil(sum(p))
