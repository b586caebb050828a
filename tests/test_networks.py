import numpy as np
import pytest
from graphs import EDGES
from pyspark.sql import functions as F

from horograph.operators import dense, embedders, optimizer, parameters
from horograph.plans import models

FITTED = ["poincare_maps", "poincare_embeddings", "poincare_embeddings_fermi_dirac", "lorentz_embeddings", "hydra_plus", "hypermap", "dmercator"]
# the karate club, and a ring with chords
RING = [(100 + k, 100 + (k + s) % 24) for k in range(24) for s in (1, 2, 5)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two networks with repeated rows, both directions, self-loops and nulls."""
    d = str(tmp_path_factory.mktemp("networks"))
    rows = [(1, a, b, float(1 + (a + b) % 3)) for a, b in EDGES] + [(2, a, b, None if a % 5 == 0 else 2.0) for a, b in RING]
    dirty = [(n, b, a, w) for n, a, b, w in rows[::3]] + [(1, 3, 3, 1.0), (2, 101, None, 1.0)]
    spark.createDataFrame([*rows, *dirty], "net_id bigint, src bigint, dst bigint, weight double").write.parquet(f"{d}/network_edges.parquet")
    return d


@pytest.mark.parametrize("name", FITTED)
def test_queries_place_every_node_of_every_network(spark, folder, name):
    out = models.catalog.queries[name](spark, folder).collect()
    assert sorted((o["net_id"], o["node_id"]) for o in out) == [(1, k) for k in range(34)] + [(2, 100 + k) for k in range(24)]
    assert all(np.isfinite([o["r"], *o["v"], o["first_loss"], o["last_loss"]]).all() for o in out)


def test_queries_keep_the_default_steps_and_draws(spark, folder, monkeypatch):
    seen = {}
    monkeypatch.setattr(models.embedders, "fit_networks", lambda edges, e: seen.setdefault(name, e))
    for name in FITTED:
        models.catalog.queries[name](spark, folder)
    monkeypatch.setattr(models.embedders, "fit_unknown_networks", lambda edges, unknown, e: seen.setdefault("joint", e))
    models.catalog.queries["unknown_edge_joint_fit"](spark, folder)
    assert len(seen) == 8
    for e in seen.values():
        usual = type(e)()
        assert e.n_steps == usual.n_steps and getattr(e, "negatives", 0) == getattr(usual, "negatives", 0)


@pytest.mark.parametrize(
    "model",
    [embedders.PoincareMaps(n_steps=15), embedders.PoincareEmbeddings(n_steps=15), embedders.LorentzEmbeddings(n_steps=15), embedders.HydraPlus(n_steps=15), embedders.HyperMap(gamma=2.5, n_steps=15), embedders.DMercator(n_steps=15)],
    ids=lambda m: type(m).__name__,
)
def test_a_network_is_fitted_like_a_graph(spark, folder, model):
    e = models._networks(spark, folder)
    got = {(o["net_id"], o["node_id"]): (o["r"], o["v"]) for o in embedders.fit_networks(e, model).collect()}
    want = model.fit(e.where("net_id = 1").drop("net_id"))
    assert len(got) == 58
    for k, r, v in zip(want.ids.tolist(), want.r, want.v):
        assert got[(1, k)][0] == pytest.approx(r, abs=1e-6) and np.allclose(got[(1, k)][1], v, atol=1e-6)


def test_unknown_weights_of_a_network_are_fitted_like_those_of_a_graph(spark, folder):
    e = models._networks(spark, folder).withColumn("weight", F.lit(1.0))
    hidden = [(0, 1), (5, 16), (9, 20), (14, 26)]
    unknown = spark.createDataFrame([(1, a, b) for a, b in hidden] + [(2, 100, 101)], "net_id bigint, src bigint, dst bigint")
    model = embedders.PoincareEmbeddings(loss="fermi_dirac", n_steps=25, lr_a=0.1)
    got = {(o["net_id"], o["src"], o["dst"]): o["w"] for o in embedders.fit_unknown_networks(e, unknown, model).collect()}
    want = model.fit(e.where("net_id = 1").drop("net_id"), unknown.where("net_id = 1").drop("net_id")).unknown.collect()
    assert len(got) == 5 and len(want) == 4
    for o in want:
        assert got[(1, o["src"], o["dst"])] == pytest.approx(o["w"], abs=1e-9)


def test_joint_query_hides_pairs_of_every_network(spark, folder):
    out = models.catalog.queries["unknown_edge_joint_fit"](spark, folder).collect()
    assert {o["net_id"] for o in out} == {1, 2} and all(0 < o["w"] < 1 for o in out)


def test_closed_forms_of_the_weight_gradient():
    from horograph.operators import optimizer

    rng = np.random.default_rng(0)
    v = rng.normal(size=(12, 2))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    r, a = rng.uniform(0.5, 3, 12), np.triu(rng.random((12, 12)), 1)
    a, i, j = a + a.T, np.array([0, 3, 7]), np.array([5, 4, 11])
    for m in (embedders.PoincareEmbeddings(loss="fermi_dirac", r=1.5, t=0.7), embedders.PoincareMaps(gamma=0.8)):
        want = []
        for x, y in zip(i, j):
            value = []
            for s in (1e-5, -1e-5):
                b = a.copy()
                b[x, y] += s
                b[y, x] += s
                value.append(optimizer.block_gradient(np.arange(12), r, v, m.target(b), m.loss(12))[0])
            want.append((value[0] - value[1]) / 2e-5)
        assert np.allclose(m.weight_gradient(a, i, j, r, v), want, rtol=1e-4, atol=1e-5)
    # ranking: linear in the weight, from both ends, with negatives that are no neighbours
    m = embedders.PoincareEmbeddings(n_negatives=4000)
    a[a < 0.6] = 0
    d = dense.polar_matrix(r, v)
    a[i, j] = a[j, i] = 0.5
    mean = [np.exp(-d[k])[(a[k] == 0) & (np.arange(12) != k)].mean() * 4000 for k in range(12)]
    want = [2 * d[x, y] + np.log(np.exp(-d[x, y]) + mean[x]) + np.log(np.exp(-d[x, y]) + mean[y]) for x, y in zip(i, j)]
    assert np.allclose(m.weight_gradient(a, i, j, r, v), want, rtol=0.02)
    assert (embedders.LorentzEmbeddings().weight_gradient(a, i, j, r, v) == 0).all()


@pytest.mark.parametrize("below", [False, True])
def test_ranking_gradient_matches_differences(below):
    rng = np.random.default_rng(1)
    a = np.triu(rng.integers(0, 4, (9, 9)) * (rng.random((9, 9)) < 0.5), 1).astype(float)
    a, d, rows = a + a.T, rng.uniform(0.5, 3, (9, 9)), np.arange(9)
    # a new loss repeats its draws
    f = lambda x: optimizer.ranking_loss(6, 2, below)(rows, x, a)
    g, h = f(d)[1], 1e-6
    for p in range(9):
        for q in range(9):
            e = np.zeros((9, 9))
            e[p, q] = h
            assert (f(d + e)[0] - f(d - e)[0]) / (2 * h) == pytest.approx(g[p, q], abs=1e-5)
            if a[p, q] == 0 and p == q:
                assert g[p, q] == 0
            if not below and a[p, q] > 0:
                assert g[p, q] >= 0


def test_growth_arrays_equal_growth_radii(spark):
    order = spark.range(1, 41).select(F.col("id").alias("node_id"), F.col("id").alias("i"))
    for gamma in (2.5, 3.0, 2.0):
        c = parameters.growth_constants(40, 120, 1, gamma)
        want = parameters.growth_radii(order, c).orderBy("i").toPandas()
        for x, y in zip(parameters.growth_arrays(40, c), ("r", "threshold", "links")):
            assert np.allclose(x, want[y])


def test_closure_of_networks(spark, folder):
    got = {tuple(o) for o in models.catalog.queries["transitive_closure"](spark, folder).collect()}
    want = set()
    for net, edges in ((1, EDGES), (2, RING)):
        up = {}
        for a, b in edges:
            up.setdefault(min(a, b), set()).add(max(a, b))
        for s in up:
            todo = [s]
            while todo:
                for y in up.get(todo.pop(), ()):
                    if (net, s, y) not in want:
                        want.add((net, s, y))
                        todo.append(y)
    assert got == want
