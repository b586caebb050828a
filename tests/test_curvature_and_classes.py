"""Diagnostics without a matrix of the graph, classification by folds, pairs in tiles, exact quantiles and the temperature."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from horograph.operators import classification, curvature, dense, generation, graph, ordering, pairs

EDGE = "src bigint, dst bigint, weight double"


def frame(spark, rows):
    return spark.createDataFrame([(int(min(e)), int(max(e)), 1.0) for e in rows], EDGE)


def random_graph(n, m, seed):
    rng = random.Random(seed)
    e = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)} | {(i, i + 1) for i in range(n - 1)}
    return sorted(e)


@pytest.mark.parametrize("joins", [False, True])
def test_hyperbolicity_of_known_graphs(spark, monkeypatch, joins):
    if joins:
        monkeypatch.setattr(graph, "HOP_EDGES", 0)
    ring = curvature.mean_hyperbolicity(frame(spark, [(0, 1), (1, 2), (2, 3), (3, 0)]), 50).first()
    assert (ring["mean_delta"], ring["max_delta"], ring["diameter"], ring["quadruples"]) == (1.0, 1.0, 2.0, 50)
    tree = curvature.mean_hyperbolicity(frame(spark, [((i - 1) // 2, i) for i in range(1, 31)]), 300).first()
    assert (tree["mean_delta"], tree["diameter"], tree["quadruples"]) == (0.0, 8.0, 300)
    few = curvature.mean_hyperbolicity(frame(spark, [(0, 1), (2, 3)]), 10).first()
    assert few["quadruples"] == 0 and few["mean_delta"] == 0.0


def test_hyperbolicity_by_sample_is_near_the_mean_of_all(spark):
    e = random_graph(24, 14, 3)
    _, a = dense.adjacency(frame(spark, e).toPandas())
    every = np.array(list(itertools.combinations(range(24), 4)))
    want = dense.hyperbolicity(dense.hop_matrix(a), every).mean()
    assert curvature.mean_hyperbolicity(frame(spark, e), 40_000).first()["mean_delta"] == pytest.approx(want, abs=0.02)


def test_large_graphs_need_no_matrix(spark):
    n = 50_000
    e = spark.range(1, n).select(F.floor((F.col("id") - 1) / 2).alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))
    h = curvature.mean_hyperbolicity(e, 500, pool=40).first()
    assert h["mean_delta"] == 0.0 and h["quadruples"] == 500
    r = curvature.ricci_curvature(e, 40).first()
    assert r["edges"] == 40 and r["mean"] < 0.3


@pytest.mark.parametrize("seed", [1, 2])
def test_curvature_is_that_of_the_matrix(spark, seed):
    e = random_graph(18, 30, seed)
    _, a = dense.adjacency(frame(spark, e).toPandas())
    want = dict(zip(e, dense.ricci(a, np.array(e))))
    got = {(r["src"], r["dst"]): r["curvature"] for r in curvature.edge_curvature(frame(spark, e)).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert curvature.edge_curvature(frame(spark, e), sample=5, neighbours=2).count() == 5
    assert curvature.edge_curvature(frame(spark, []), sample=5).count() == 0


def points(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    r = rng.uniform(0.1, 3, n)
    rows = [(int(3 * k), float(r[k]), v[k].tolist(), int(k % 4), int(k % 3)) for k in range(n)]
    return spark.createDataFrame(rows, "node_id bigint, r double, v array<double>, label int, fold int"), rows


def test_nearest_in_tiles_are_the_nearest(spark):
    df, rows = points(spark, 90)
    d = {(min(p["i"], p["j"]), max(p["i"], p["j"])): p["d"] for p in pairs.polar_distances(df, tile=1000).collect()}
    for group, tile in ((None, 1000), (None, 16), ("fold", 16)):
        got = {}
        for x in pairs.nearest_in_tiles(df, pairs.polar_kernel, 4, tile=tile, group=group).collect():
            got.setdefault(x["a"], set()).add(x["b"])
        for a, _, _, _, f in rows:
            others = [(d[(min(a, b), max(a, b))], b) for b, _, _, _, g in rows if b != a and (group is None or f != g)]
            assert got[a] == {b for _, b in sorted(others)[:4]}
    assert pairs.nearest_in_tiles(df.limit(0), pairs.polar_kernel, 4).count() == 0
    assert pairs.nearest_in_tiles(df.limit(2), pairs.polar_kernel, 4).count() == 2


def test_pairs_and_what_is_left_of_them(spark):
    ids = spark.createDataFrame([(k,) for k in [*range(40), 3, None]], "node_id bigint")
    want = set(itertools.combinations(range(40), 2))
    drop = [p for p in want if sum(p) % 3 == 0]
    links = spark.createDataFrame([*drop, (100, 200)], "i bigint, j bigint")
    for tile in (7, 1000):
        got = [tuple(r) for r in pairs.expand_pairs(ids, tile=tile).collect()]
        assert len(got) == len(want) and set(got) == want
        got = [tuple(r) for r in pairs.pairs_without(ids, links, tile=tile).collect()]
        assert len(got) == len(want) - len(drop) and set(got) == want - set(drop)
    assert pairs.pairs_without(ids.limit(0), links).count() == 0


def test_classification_by_folds(spark):
    df, rows = points(spark, 60, 2)
    d = {(min(p["i"], p["j"]), max(p["i"], p["j"])): p["d"] for p in pairs.polar_distances(df).collect()}
    got = {r["node_id"]: (r["label"], r["predicted"]) for r in classification.knn_predictions(df, 3).collect()}
    for a, _, _, label, f in rows:
        near = sorted((d[(min(a, b), max(a, b))], b, lab) for b, _, _, lab, g in rows if g != f)[:3]
        votes = [lab for _, _, lab in near]
        assert got[a] == (label, min(set(votes), key=lambda x: (-votes.count(x), x)))
    folds = classification.stratified_folds(df.drop("fold"), 5).groupBy("label", "fold").count().collect()
    assert {r["count"] for r in folds} <= {3} and len(folds) == 20
    s = classification.scores(spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 2)], "label int, predicted int")).first()
    assert (s["accuracy"], s["nodes"], s["classes"]) == (0.5, 4, 3) and s["f1"] == pytest.approx((2 * (2 / 3) + 1 * 0.5) / 4)


def test_exact_quantiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    for last in (20_000, 7):
        monkeypatch.setattr(ordering, "LAST", last)
        for x in (rng.normal(size=501), np.r_[np.full(300, 2.0), rng.exponential(size=200)], np.array([1.5]), np.r_[1e-300, 1.0, 1e300]):
            df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "d double").repartition(3)
            for q in (0.0, 0.25, 0.5, 0.9, 1.0):
                assert ordering.quantile(df, "d", q) == pytest.approx(float(np.quantile(x, q)), rel=1e-12)
            assert ordering.kth(df, "d", len(x)) is None
    assert ordering.quantile(df.limit(0), "d", 0.5) is None


def test_closest_pairs_are_cut_before_they_are_sorted(spark):
    rows = [(i, j, float((i * 7 + j * 3) % 11)) for i in range(20) for j in range(i + 1, 20)]
    got = [(r["i"], r["j"]) for r in generation.threshold_graph(spark.createDataFrame(rows, "i bigint, j bigint, d double"), 30).orderBy("d", "i", "j").collect()]
    assert got == [(i, j) for i, j, _ in sorted(rows, key=lambda r: (r[2], r[0], r[1]))[:30]]
    assert generation.threshold_graph(spark.createDataFrame(rows, "i bigint, j bigint, d double"), 0).count() == 0
    assert generation.threshold_graph(spark.createDataFrame(rows, "i bigint, j bigint, d double"), 10_000).count() == len(rows)


def test_temperature_is_found_again(spark):
    rng = np.random.default_rng(7)
    n, t = 160, 0.4
    u = {(i, j): rng.uniform(-4, 4) for i in range(n) for j in range(i + 1, n)}
    threshold = rng.uniform(1, 6, n)
    rows = [(i, j, u[i, j] + threshold[j]) for i, j in u]
    edges = [(i, j, 1.0) for (i, j), x in u.items() if rng.random() < 1 / (1 + np.exp(x / (2 * t)))]
    p = spark.createDataFrame([(i, j, float(d)) for i, j, d in rows], "i bigint, j bigint, d double")
    arrival = spark.createDataFrame([(k, k, float(threshold[k])) for k in range(n)], "node_id bigint, pos bigint, threshold double")
    assert generation.estimate_temperature(p, arrival, spark.createDataFrame(edges, EDGE)) == pytest.approx(t, rel=0.1)
    with pytest.warns(UserWarning, match="bound"):
        cut = spark.createDataFrame([(i, j, 1.0) for (i, j), x in u.items() if x < 0], EDGE)
        assert generation.estimate_temperature(p, arrival, cut) < 1e-2
    with pytest.raises(ValueError):
        generation.estimate_temperature(p.limit(0), arrival, cut)
