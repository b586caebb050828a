import numpy as np

from horograph.llm import neighbors
from horograph.llm.additive_quant import encode, fit_books, lift, to_frame

SCHEMA = "vec_id bigint, x array<double>, id string, cell int"


def frame(spark, ids, xs):
    return spark.createDataFrame([(int(i), None if x is None else [None if v is None else float(v) for v in x], "x", 1) for i, x in zip(ids, xs)], SCHEMA)


def brute(ids, xs, k):
    good = [(i, np.array(x, float)) for i, x in zip(ids, xs) if x is not None and len(x) == 16 and None not in list(x) and np.isfinite(np.array(x, float)).all() and (np.array(x, float) ** 2).sum() < 1]
    if not good:
        return {}
    who, x = np.array([i for i, _ in good]), np.array([x for _, x in good])
    gap = 1 - (x * x).sum(axis=1)
    out = {}
    for n, i in enumerate(who):
        d = ((x - x[n]) ** 2).sum(axis=1) / (gap * gap[n])
        d[n] = np.inf
        out[int(i)] = who[np.lexsort((who, d))[: min(k, len(who) - 1)]].tolist()
    return out


def points(n, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(max(1, n // 30), 16))
    x = c[rng.integers(0, len(c), n)] + 0.3 * rng.normal(size=(n, 16))
    return x / np.linalg.norm(x, axis=1, keepdims=True) * rng.uniform(0.1, 0.99, (n, 1))


def test_recall_against_brute_force(spark):
    x = points(1500)
    ids = np.random.default_rng(3).permutation(5000)[:1500]
    near = neighbors.nearest(frame(spark, ids, x), cell_rows=16)
    got = {}
    for r in near.collect():
        got.setdefault(r["id"], []).append(r["neighbor"])
    want = brute(ids, x, 10)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in want]) >= 0.95
    own = neighbors.recall(near, frame(spark, ids, x), "vec_id", "x", 16, 10).first()
    assert own["recall"] >= 0.9 and own["asked"] == sum(i % 20 == 0 for i in ids)


def test_regions_and_parts_agree(spark):
    x = points(300, 5)
    key = lambda df: sorted((r["id"], r["rank"], r["neighbor"]) for r in df.collect())
    one_cell = key(neighbors.nearest(frame(spark, range(300), x), cell_rows=1000, rerank=300))
    assert one_cell == key(neighbors.nearest(frame(spark, range(300), x), cell_rows=1000, rerank=300, region_rows=60))
    cells = neighbors.build(frame(spark, range(300), x), cell_rows=20)
    assert cells.profile()["cells"] > 4
    assert key(cells.nearest(rerank=300)) == key(cells.nearest(rerank=300, region_rows=60))


def test_cells_beyond_the_sample_are_split(spark):
    x = points(3000, 8)
    index = neighbors.build(frame(spark, range(3000), x), cell_rows=16, sample_rows=200)
    p = index.profile()
    assert p["vectors"] == 3000 and p["largest"] <= 64 and p["cells"] > 3000 / 64 and p["share"] < 0.5
    near = index.nearest()
    assert neighbors.recall(near, frame(spark, range(3000), x), "vec_id", "x", 16, 10).first()["recall"] >= 0.95
    assert (index.points.sum(), index.asks.sum()) == (3000, 3000 * p["probes"])


def test_recall_in_blocks_is_one_recall(spark):
    x = points(400, 9)
    near = neighbors.nearest(frame(spark, range(400), x), cell_rows=1000, rerank=20).cache()
    whole = neighbors.recall(near, frame(spark, range(400), x), "vec_id", "x", 16, 10).first()
    parts = neighbors.recall(near, frame(spark, range(400), x), "vec_id", "x", 16, 10, block=5).first()
    want = brute(range(0, 400), x, 10)
    got = {}
    for r in near.collect():
        got.setdefault(r["id"], set()).add(r["neighbor"])
    share = np.mean([len(got[i] & set(want[i])) / 10 for i in range(0, 400, 20)])
    assert tuple(whole) == tuple(parts) and whole["asked"] == 20 and abs(whole["recall"] - share) < 1e-12


def test_copies_ties_and_unusable_vectors(spark):
    x = points(40, 2).tolist()
    xs = [*x, *[x[0]] * 60, *[x[1]] * 3, None, [0.0] * 15, [0.1] * 15 + [None], [0.1] * 15 + [float("nan")], [1.0] + [0.0] * 15, [float("inf")] + [0.0] * 15, [0.0] * 16]
    ids = list(range(1000, 1000 + len(xs)))
    got = {}
    for r in neighbors.nearest(frame(spark, ids, xs)).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbor"])
    assert got == brute(ids, xs, 10)


def test_few_and_none(spark):
    assert neighbors.nearest(frame(spark, [], [])).count() == 0
    assert neighbors.nearest(frame(spark, [1], points(1))).count() == 0
    assert neighbors.neighbor_pairs(neighbors.nearest(frame(spark, [5, 3, 9], points(3)))).count() == 3


def test_codes_come_near(spark):
    h = lift(points(3000, 4))
    centre = h[:1] * 0 + np.r_[1.0, np.zeros(16)]
    books = fit_books(h, centre, 8, 256, 1)
    z = to_frame(h, centre[0])
    assert np.allclose(z[:, 0] ** 2 - (z[:, 1:] ** 2).sum(axis=1), 1, atol=1e-6 * z[:, 0].max() ** 2)
    u = z[:, 1:] / np.linalg.norm(z[:, 1:], axis=1, keepdims=True)
    error = lambda beam: ((u - sum(books[m][encode(u, books, beam)[:, m]] for m in range(8))) ** 2).sum(axis=1).mean()
    assert error(4) < 0.05 and error(4) <= error(1) * 1.001


def test_copies_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "is_small", lambda df: False)
    x = points(30, 6).tolist()
    test = frame(spark, range(130), [*x, *[x[0]] * 90, *[x[1]] * 10])
    got = {}
    for r in neighbors.nearest(test).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbor"])
    assert got == brute(range(130), [*x, *[x[0]] * 90, *[x[1]] * 10], 10)
