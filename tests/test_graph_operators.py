import random
from datetime import datetime, timedelta
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphs import EDGES
from horograph.operators import embedders, generation, graph, links, ordering, parameters, ranking
from horograph.streaming import deltas


def edges(spark, rows, weight=1.0):
    return spark.createDataFrame([(a, b, weight) for a, b in rows], "src bigint, dst bigint, weight double")


@pytest.fixture(scope="module")
def karate(spark):
    return edges(spark, EDGES)


def test_canonical_edges(spark):
    df = spark.createDataFrame([(1, 2, 3.0), (2, 1, 5.0), (1, 1, 1.0), (None, 2, 1.0), (3, None, 1.0), (2, 3, None)], "src bigint, dst bigint, weight double")
    assert sorted(map(tuple, graph.canonical_edges(df).collect())) == [(1, 2, 2.0), (2, 3, 1.0)]
    assert (1, 2, 5.0) in set(map(tuple, graph.canonical_edges(df, weight="weight").collect()))


def test_triangles_and_clustering(karate):
    adj = {}
    for a, b in EDGES:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    want = {t for t in combinations(sorted(adj), 3) if t[1] in adj[t[0]] and t[2] in adj[t[0]] and t[2] in adj[t[1]]}
    assert {tuple(sorted(r)) for r in graph.triangles(karate).collect()} == want
    s = graph.degree_and_clustering(karate).first()
    assert (s["nodes"], s["edges"], s["max_degree"]) == (34, 78, 17)
    assert s["average_clustering"] == pytest.approx(0.5706384782) and s["transitivity"] == pytest.approx(0.2556818182)


def test_components_and_paths(spark):
    rng = random.Random(0)
    rows = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(35)]
    rows = sorted({(min(a, b), max(a, b)) for a, b in rows if a != b})
    e = edges(spark, rows)
    parent = {x: x for r in rows for x in r}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in rows:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node_id"]: r["component"] for r in graph.connected_components(e, spark.createDataFrame([(999,), (None,)], "node_id bigint")).collect()}
    assert got == {**{x: find(x) for x in parent}, 999: 999}
    assert graph.largest_component(e).count() == 60
    hops = {r["node_id"]: r["hops"] for r in graph.hop_distances(e, spark.createDataFrame([(110,)], "node_id bigint")).collect()}
    assert hops == {k: abs(k - 110) for k in range(100, 161)}
    w = {r["node_id"]: r["distance"] for r in graph.weighted_distances(edges(spark, [(1, 2), (2, 3)], 0.5).unionByName(edges(spark, [(1, 3)], 5.0)), spark.createDataFrame([(1,)], "node_id bigint")).collect()}
    assert w == {1: 0.0, 2: 0.5, 3: 1.0}
    assert graph.connected_components(e.limit(0)).count() == 0
    new, table = graph.relabel(edges(spark, [(5, 9), (9, 30)]))
    assert sorted(map(tuple, new.select("src", "dst").collect())) == [(0, 1), (1, 2)]


def test_closure_and_tree(spark):
    t = graph.balanced_tree(spark, 2, 4)
    c = {tuple(r) for r in graph.transitive_closure(t, "dst", "src").collect()}
    assert len(c) == sum(k * 2**k for k in range(5)) and (30, 0) in c and (30, 14) in c


def test_running_totals_over_partitions(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 as v").repartition(5)
    got = {r["id"]: r["t"] for r in ordering.running_totals(df, [F.asc("id")], {"t": F.col("v")}, 6).collect()}
    run = 0
    for k in range(1000):
        assert got[k] == run
        run += k % 7
    assert {r["id"]: r["rn"] for r in ordering.numbered(df, [F.desc("id")]).collect()} == {k: 1000 - k for k in range(1000)}
    assert ordering.numbered(df.limit(0), [F.asc("id")]).count() == 0


def cands(spark, scores, positive):
    return spark.createDataFrame([(k, float(s), k in positive) for k, s in enumerate(scores)], "cand_id bigint, score double, is_positive boolean")


def test_ranking_by_hand(spark):
    c = cands(spark, [0.9, 0.8, 0.1, 0.2, 0.3, 0.05, 0.7, 0.4, 0.6, 0.15], {0, 1})
    assert ranking.precision_recall_f1(c).first()["f1"] == 1
    assert [r["lift"] for r in ranking.lift_curve(c, 2).orderBy("bin").collect()] == [2, 0]
    assert ranking.roc_auc(cands(spark, [0.5, 1, 4, 2, 5], {0, 2, 4})).first()["auc"] == pytest.approx(4 / 6)
    assert ranking.roc_auc(cands(spark, [1] * 10, {1, 2, 3})).first()["auc"] == 0.5
    assert ranking.hits_at(cands(spark, [5, 4, 3, 2, 1], {0, 3}), 2).first()["hits"] == 0.5
    # the last bin takes the rest; ties come in reverse order where a high score links
    assert [r["n"] for r in ranking.lift_curve(cands(spark, range(11), {3}), 4).orderBy("bin").collect()] == [2, 2, 2, 5]
    tied = cands(spark, [1, 1, 1, 1], {3})
    assert ranking.precision_recall_f1(tied, 1).first()["hits"] == 1 and ranking.precision_recall_f1(tied, 1, False).first()["hits"] == 0
    assert ranking.precision_recall_f1(cands(spark, [float("inf"), float("-inf")], {0})).first()["f1"] == 1
    for bad in ([float("nan"), 1.0],):
        with pytest.raises(Exception, match="numbers"):
            ranking.precision_recall_f1(cands(spark, bad, {0})).collect()
    with pytest.raises(Exception, match="both classes"):
        ranking.roc_auc(cands(spark, [1, 2], set())).collect()


def test_split_and_candidates(karate):
    nodes = karate.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    s = links.split_edges(karate, 0.8, 1)
    c = links.candidates(s, nodes)
    removed = s.where("part = 'R'").count()
    assert c.where("is_positive").count() == removed and c.count() == removed + 34 * 33 // 2 - 78
    assert links.training_graph(s).count() == 78 - removed
    n = {r["node_id"]: r["negatives"] for r in links.negative_counts(karate, nodes).collect()}
    assert n[33] == 33 - 17
    u = links.unknown_weights(karate, karate.where("src = 0 and dst = 1").select("src", "dst"), 34).first()
    assert u["w_init"] == pytest.approx((15 / 33 + 8 / 33) / 2)


def test_power_law(spark):
    rng = np.random.default_rng(0)
    k = np.floor((3 - 0.5) * (1 - rng.random(20000)) ** (-1 / 1.5) + 0.5).astype(int)
    deg = spark.createDataFrame([(i, int(x)) for i, x in enumerate(k)], "node_id bigint, degree bigint")
    fit = parameters.choose_kmin(deg).first()
    assert abs(fit["gamma"] - 2.5) < 0.1
    assert abs(parameters.gamma_mle(deg, 3).first()["gamma"] - 2.5) < 0.1
    assert parameters.exponential_ratio(deg, 3.0, 2.5).first()["ratio"] > 0
    assert parameters.choose_kmin(deg.limit(10)).count() == 0
    g = parameters.goodness_of_fit(deg.limit(3000), 20).first()
    assert g["replicates"] == 20 and 0 <= g["p"] <= 1


def test_generator_recovers_its_parameters(spark):
    p = spark.range(40000).selectExpr("id as i", "id + 1 as j", "(id % 1000) / 200.0 as d")
    drawn = generation.fermi_dirac_sample(p, 2.0, 0.5, 1, 3).selectExpr("i as src", "j as dst")
    f = generation.fit_fermi_dirac(p, drawn)
    assert abs(f["r"] - 2) < 0.05 and abs(f["t"] - 0.5) < 0.05
    assert generation.threshold_graph(p, 7).count() == 7
    disk = generation.uniform_hyperbolic_disk(spark, 2000, 5.0).agg(F.max("r"), F.avg("r")).first()
    assert disk[0] <= 5 and disk[1] > 3.8


@pytest.mark.parametrize("model", [embedders.PoincareMaps(n_steps=60, lr=0.05), embedders.PoincareEmbeddings(n_steps=40, lr=0.05, n_negatives=8), embedders.PoincareEmbeddings(loss="fermi_dirac", n_steps=60, lr=0.05), embedders.LorentzEmbeddings(n_steps=40, lr=0.1, n_negatives=8), embedders.HydraPlus(n_steps=60)], ids=lambda m: type(m).__name__)
def test_embedders_lower_their_loss(spark, model):
    e = model.fit(graph.balanced_tree(spark, 2, 3))
    assert e.coordinates.count() == 15 and e.history[-1] < e.history[0]
    assert np.allclose(np.linalg.norm(e.v, axis=1), 1, atol=1e-6)


def test_update_and_unknown(spark, karate):
    t = graph.balanced_tree(spark, 2, 3)
    m = embedders.PoincareEmbeddings(loss="fermi_dirac", n_steps=20)
    m.fit(t)
    new, e = m.update(t, added=edges(spark, [(13, 14)]))
    assert new.count() == 15 and len(e.ids) == 15
    with pytest.raises(ValueError, match="disconnects"):
        m.update(t, removed=edges(spark, [(0, 1)]))
    u = embedders.PoincareEmbeddings(loss="fermi_dirac", n_steps=40, lr_a=0.1).fit(t, spark.createDataFrame([(1, 3), (7, 14)], "src bigint, dst bigint")).unknown
    w = {(r["src"], r["dst"]): r["w"] for r in u.collect()}
    assert len(w) == 2 and all(0 < x < 1 for x in w.values())
    with pytest.raises(ValueError):
        m.fit(t.limit(0))


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, rng.choice(["add_edge", "remove_edge", "set_weight", None]), rng.choice([None, *range(6)]), rng.randrange(6), rng.choice([None, 1.5, 2.5]), datetime(2024, 1, 1) + timedelta(hours=rng.randrange(50))) for k in range(300)]
    df = spark.createDataFrame([*rows, *rows[:40]], "delta_id bigint, op string, src bigint, dst bigint, weight double, ts timestamp_ntz")
    df.repartition(6).write.parquet(str(tmp_path / "in"))
    want = {}
    for k, op, a, b, w, ts in rows:
        if op and a is not None and a != b:
            key = (min(a, b), max(a, b))
            want[key] = max(want.get(key, (datetime.min, -1, "", 0.0)), (ts, k, op, 1.0 if w is None else w))
    want = {(a, b, c[3]) for (a, b), c in want.items() if c[2] != "remove_edge"}
    state = deltas.replay(spark, str(tmp_path / "in"), str(tmp_path / "cp"), 2)
    assert state.batches >= 3
    assert {tuple(r) for r in state.edges().collect()} == want == {tuple(r) for r in deltas.current_edges(deltas.last_changes(df)).collect()}
    assert deltas.RefitPolicy().decide(5, 0, 1000) == "wait" and deltas.RefitPolicy().decide(500, 0, 1000) == "cold" and deltas.RefitPolicy().decide(5, 9999, 1000) == "warm"


def test_a_stream_that_starts_again_keeps_its_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(deltas, "COMPACT", 3)
    schema = "delta_id bigint, op string, src bigint, dst bigint, weight double, ts timestamp_ntz"
    rng, every, folder = random.Random(8), [], str(tmp_path / "in")
    for part in range(4):
        rows = [(100 * part + k, rng.choice(["add_edge", "remove_edge", "set_weight"]), rng.randrange(5), rng.randrange(5), float(k), datetime(2024, 1, 1) + timedelta(hours=rng.randrange(50))) for k in range(40)]
        every += rows
        spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(folder)
        # a new process knows nothing but the folders
        state = deltas.replay(spark, folder, str(tmp_path / "cp"), 1)
        assert {tuple(r) for r in state.edges().collect()} == {tuple(r) for r in deltas.current_edges(deltas.last_changes(spark.createDataFrame(every, schema))).collect()}
    assert state.batches == 8 and len(state._parts()[0]) < 4
    # the last batch again, as after a failure before it was acknowledged
    before = state.edges().collect()
    state.fold(spark.createDataFrame(every[-40:], schema), 7)
    assert sorted(before) == sorted(state.edges().collect())


def test_dot_product_graphs(spark):
    p = spark.createDataFrame([(k, [1.0, 0.0] if k < 20 else [0.0, 0.5], [1.0, 1.0]) for k in range(60)], "node_id bigint, x array<double>, signs array<double>")
    got = {(r["i"], r["j"]) for r in generation.dot_product_sample(p, 1, 3).collect()}
    assert {x for x in got if x[1] < 20} == {(a, b) for b in range(20) for a in range(b)}
    assert not any(a < 20 <= b for a, b in got)
    assert 0.15 < len([x for x in got if x[0] >= 20]) / (40 * 39 / 2) < 0.35
