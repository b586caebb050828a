import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from horograph.functions import charts, distances
from horograph.functions.scalars import angle_normaliser, hurwitz_zeta, mean_degree_mu, sphere_radius
from horograph.operators import dense, optimizer, pairs
from horograph.operators.placement import Placement
from horograph.operators import parameters
from graphs import EDGES, PLACED


def points(spark, n=40, d=4, seed=0, top=6.0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    r = rng.uniform(0, top, n)
    r[0] = 0.0
    return spark.createDataFrame([(k, float(r[k]), v[k].tolist()) for k in range(n)], "node_id bigint, r double, v array<double>"), r, v


def test_charts_round_trip(spark):
    df, r, v = points(spark)
    x = charts.polar_to_ball(F.col("r"), F.col("v"))
    h = charts.polar_to_hyperboloid(F.col("r"), F.col("v"))
    rb, vb = charts.ball_to_polar(x)
    rh, vh = charts.hyperboloid_to_polar(h)
    a, s = charts.ball_to_hyperspherical(x)
    out = df.select("node_id", "v", rb.alias("rb"), vb.alias("vb"), rh.alias("rh"), vh.alias("vh"), x.alias("x"), charts.hyperspherical_to_ball(a, s).alias("y"), charts.hyperboloid_to_ball(h).alias("z"), charts.ball_to_hyperboloid(x).alias("h2"), h.alias("h")).orderBy("node_id").collect()
    for k, o in enumerate(out):
        assert abs(o["rb"] - r[k]) < 1e-9 and abs(o["rh"] - r[k]) < 1e-9
        if k:
            assert np.allclose(o["vb"], v[k], atol=1e-9) and np.allclose(o["vh"], v[k], atol=1e-9)
            assert np.allclose(o["x"], o["y"], atol=1e-9)
        else:
            assert o["vb"] == [1.0, 0.0, 0.0, 0.0]
        assert np.allclose(o["x"], o["z"], atol=1e-9) and np.allclose(o["h"], o["h2"], rtol=1e-9, atol=1e-9)


def test_recentering_is_an_isometry(spark):
    df, r, v = points(spark, 12, 3, 1, 2.5)
    x = df.select("node_id", charts.polar_to_ball(F.col("r"), F.col("v")).alias("x"))
    c = x.where("node_id = 5").select(F.col("x").alias("c"))
    y = x.crossJoin(c).select("node_id", "x", charts.recenter(F.col("x"), F.col("c")).alias("y")).orderBy("node_id").collect()
    assert np.allclose(y[5]["y"], 0, atol=1e-12)
    dist = lambda p, q: np.arccosh(1 + 2 * ((p - q) ** 2).sum() / ((1 - p @ p) * (1 - q @ q)))
    for i in range(12):
        for j in range(i):
            p, q, s, t = (np.array(z) for z in (y[i]["x"], y[j]["x"], y[i]["y"], y[j]["y"]))
            assert abs(dist(p, q) - dist(s, t)) < 1e-8


def test_distances_agree(spark):
    df, r, v = points(spark)
    e = df.withColumn("x", charts.polar_to_ball(F.col("r"), F.col("v"))).withColumn("h", charts.polar_to_hyperboloid(F.col("r"), F.col("v")))
    g = pairs.gather(pairs.expand_pairs(df), e, ["r", "v", "x", "h"])
    c = lambda n: (F.col(f"{n}_i"), F.col(f"{n}_j"))
    rows = g.select("i", "j", distances.polar(F.col("r_i"), F.col("v_i"), F.col("r_j"), F.col("v_j")).alias("p"), distances.ball(*c("x")).alias("b"), distances.hyperboloid(*c("h")).alias("h")).collect()
    tiled = {(t["i"], t["j"]): t["d"] for t in pairs.polar_distances(df, tile=7).collect()}
    assert len(rows) == len(tiled) == 40 * 39 // 2
    m = dense.polar_matrix(r, v)
    for o in rows:
        assert abs(o["p"] - o["b"]) < 1e-7 and abs(o["p"] - o["h"]) < 1e-5 and abs(o["p"] - tiled[(o["i"], o["j"])]) < 1e-9 and abs(o["p"] - m[o["i"], o["j"]]) < 1e-5


def test_nulls_and_empty_pairs(spark):
    df = spark.createDataFrame([(1, 1.0, [1.0, 0.0]), (None, 1.0, [1.0, 0.0]), (2, None, [1.0, 0.0]), (3, 2.0, None), (4, 3.0, [1.0, 0.0])], "node_id bigint, r double, v array<double>")
    assert [tuple(x) for x in pairs.polar_distances(df).collect()] == [(1, 4, pytest.approx(2.0))]
    assert pairs.polar_distances(df.limit(0)).count() == 0


def test_closed_forms():
    assert sphere_radius(100, 1) == pytest.approx(100 / (2 * math.pi))
    assert mean_degree_mu(3.0, 1, 8.0) == pytest.approx(3 * math.sin(math.pi / 3) / (2 * math.pi * 8))
    assert angle_normaliser(1) == pytest.approx(1 / math.pi)
    for s, a in ((2.5, 1.0), (1.8, 4.0), (6.0, 30.0)):
        direct = sum((a + k) ** -s for k in range(200000)) + (a + 200000) ** (1 - s) / (s - 1) + 0.5 * (a + 200000) ** -s
        assert float(hurwitz_zeta(s, np.array([a]))[0]) == pytest.approx(direct, rel=1e-9)


def test_placement_matches_published_values():
    ids = [p[0] for p in PLACED]
    at = {k: i for i, k in enumerate(ids)}
    a = np.zeros((34, 34))
    for x, y in EDGES:
        a[at[x], at[y]] = a[at[y], at[x]] = 1
    c = parameters.growth_constants(34, 78, 1, 2.7248981998107187, 1.0, 0.5, 1.0)
    i, n, b = np.arange(1, 35.0), 34, c["beta"]
    links = c["m"] + 2 * c["inner"] * (1 - b) / ((1 - n ** (b - 1)) ** 2 * (2 * b - 1)) * ((n / i) ** (2 * b - 1) - 1) * (1 - i ** (b - 1))
    r = 2 * np.log(i)
    threshold = r - c["shift"] - 2 * np.log(np.maximum((1 - i ** (b - 1)) / (1 - b) / links, 1e-12))
    angle, final = Placement(a, r, threshold, links, c).run()
    gap = np.abs((angle - np.array([p[1] for p in PLACED]) + math.pi) % (2 * math.pi) - math.pi)
    assert gap.max() < 1e-6 and np.abs(final - np.array([p[2] for p in PLACED])).max() < 1e-7


def _problem(seed=0, n=9, d=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    a = np.triu(rng.random((n, n)) < 0.4, 1).astype(float)
    a = a + a.T
    hops = dense.hop_matrix(a)
    return rng.uniform(0.5, 2, n), v, {"bce": (optimizer.bce_loss(2.0, 0.8), a), "late": (optimizer.bce_loss(np.linspace(1, 3, n), 0.7), a), "stress": (optimizer.stress_loss(1.3), np.where(np.isfinite(hops), hops, 0.0)), "kl": (optimizer.symmetric_kl_loss(0.8), dense.forest(a))}


@pytest.mark.parametrize("name", ["bce", "late", "stress", "kl"])
@pytest.mark.parametrize("chart", list(optimizer.CHARTS))
def test_gradients_match_differences(name, chart):
    r, v, problems = _problem()
    loss, target = problems[name]
    blocks = [np.arange(s, min(9, s + 4)) for s in range(0, 9, 4)]
    total = lambda r, v: sum(optimizer.block_gradient(b, r, v, target[b], loss)[0] for b in blocks)
    parts = [optimizer.block_gradient(b, r, v, target[b], loss)[1:] for b in blocks]
    gr, gv = sum(p[0] for p in parts), sum(p[1] for p in parts)
    c = optimizer.CHARTS[chart]()
    x = c.start(r, v)
    g = c.gradient(x, gr, gv)
    for seed in range(3):
        w = c.riemannian(x, np.random.default_rng(seed).normal(size=x.shape))
        f = lambda h: total(*c.polar(c.move(x, h * w)))
        assert (f(1e-5) - f(-1e-5)) / 2e-5 == pytest.approx((g * w).sum(), rel=1e-4, abs=1e-5)


@pytest.mark.parametrize("chart", list(optimizer.CHARTS))
def test_optimiser_lowers_the_loss(chart):
    r, v, problems = _problem()
    loss, target = problems["stress"]
    h = optimizer.optimize(target, r, v, loss, chart, 0.03, 120).history
    assert h[-1] < 0.3 * h[0]


def test_dense_kernels():
    rng = np.random.default_rng(2)
    a = np.triu(rng.random((8, 8)), 1)
    a = a + a.T
    q = dense.forest(a)
    assert np.allclose(q.sum(axis=1), 1)
    b = a.copy()
    b[0, 1] += 0.7
    b[1, 0] += 0.7
    assert np.allclose(dense.forest(b), dense.forest_edge_update(q, 0, 1, 0.7))
    c = np.zeros((9, 9))
    c[:8, :8] = a
    c[8, 2] = c[2, 8] = 0.4
    c[8, 5] = c[5, 8] = 2.0
    assert np.allclose(dense.forest(c), dense.forest_add_node(q, {2: 0.4, 5: 2.0}))
    r, v, _ = _problem(1, 12)
    exact = dense.hydra(dense.polar_matrix(r, v), 3, 1.0, 1.0, isotropic=False)
    assert exact["stress"] < 1e-4 and np.allclose(exact["r"], exact["r"])
    from itertools import combinations, permutations

    tree = np.zeros((15, 15))
    for i in range(1, 15):
        tree[i, (i - 1) // 2] = tree[(i - 1) // 2, i] = 1
    assert dense.hyperbolicity(dense.hop_matrix(tree), np.array(list(combinations(range(15), 4)))).max() == 0
    ring = np.zeros((4, 4))
    for i in range(4):
        ring[i, (i + 1) % 4] = ring[(i + 1) % 4, i] = 1
    assert dense.hyperbolicity(dense.hop_matrix(ring), np.array([[0, 1, 2, 3]]))[0] == 1
    for k in (2, 3, 4, 5):
        cost = rng.random((k, k))
        assert dense.transport_cost(np.full(k, 1 / k), np.full(k, 1 / k), cost) == pytest.approx(min(sum(cost[i, p[i]] for i in range(k)) / k for p in permutations(range(k))))


def test_sphere_model_start():
    from horograph.operators.sphere_model import initialise, local_clustering, onion

    a = np.zeros((34, 34))
    for x, y in EDGES:
        a[x, y] = a[y, x] = 1
    assert local_clustering(a) == pytest.approx(0.5706384782)
    assert sorted(onion(a, np.random.default_rng(0))) == list(range(34))
    for dim in (1, 2):
        s = initialise(a, dim, seed=1)
        assert s["v"].shape == (34, dim + 1) and np.allclose(np.linalg.norm(s["v"], axis=1), 1)
        assert s["beta"] > dim and (s["r"] >= 0).all() and np.corrcoef(s["r"], a.sum(axis=1))[0, 1] < -0.5
        d = dense.polar_matrix(s["r"], s["v"])
        link, other = d[(a > 0)], d[(a == 0) & ~np.eye(34, dtype=bool)]
        assert (link[:, None] < other[None]).mean() > 0.75
