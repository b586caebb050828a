"""Accessors of fits, distance tables, the generator, comparisons and readers."""

import numpy as np
import pytest

from horograph.operators import embedders, evaluation, generation
from horograph.sources import graphs


def test_charts_of_a_fit_agree(spark):
    e = embedders.DMercator(n_steps=0).fit(graphs.karate_club(spark))
    r = {x["node_id"]: (x["r"], np.array(x["v"])) for x in e.coordinates.collect()}
    for x in e.ball.collect():
        assert np.allclose(x["x"], np.tanh(r[x["node_id"]][0] / 2) * r[x["node_id"]][1])
    for x in e.hyperboloid.collect():
        assert np.allclose(x["h"][1:], np.sinh(r[x["node_id"]][0]) * r[x["node_id"]][1]) and x["h"][0] == pytest.approx(np.cosh(r[x["node_id"]][0]))
    assert all(x["r"] == pytest.approx(r[x["node_id"]][0]) for x in e.hyperspherical.collect())
    assert e.native.count() == 34 and min(x["kappa"] for x in e.native.collect()) > 0
    order = spark.createDataFrame([(k, 33 - k) for k in range(30)], "node_id bigint, pos bigint")
    assert {(x["node_id"], x["pos"]) for x in e.aligned(order).collect()} == {(k, 33 - k) for k in range(30)}
    with pytest.raises(ValueError):
        embedders.Hydra().fit(graphs.karate_club(spark)).native


def test_distances_in_place_of_a_graph(spark):
    k = graphs.karate_club(spark)
    h = embedders.Hydra()
    by_graph = h.fit(k)
    hops = h.structural_similarity(k)
    d = hops.where("i < j").selectExpr("j i", "i j", "s d")
    by_table = embedders.Hydra().fit_distance(d)
    assert np.allclose(by_graph.r, by_table.r) and np.allclose(by_graph.v, by_table.v) and by_graph.info == pytest.approx(by_table.info)
    plus = embedders.HydraPlus(n_steps=20).fit_distance(d)
    assert len(plus.history) == 20 and plus.history[-1] < plus.history[0]
    with pytest.raises(ValueError):
        h.fit_distance(d.limit(0))


def test_similarities(spark):
    k = graphs.karate_club(spark)
    assert embedders.LorentzEmbeddings().structural_similarity(k).count() == 156
    assert embedders.PoincareMaps().structural_similarity(k).groupBy().sum("s").first()[0] == pytest.approx(34)
    assert embedders.Hydra().structural_similarity(k).groupBy().max("s").first()[0] == 5


def test_generator(spark):
    e = embedders.Hydra().fit(graphs.karate_club(spark)).coordinates
    g = generation.FermiDirac.from_embedding(e)
    assert g.probabilities().where("p > 0.5").count() == pytest.approx(34 * 33 / 4, abs=2)
    g.fit(graphs.karate_club(spark))
    wanted = g.probabilities().groupBy().sum("p").first()[0]
    assert wanted == pytest.approx(78, abs=0.5)
    drawn = g.sample(20, 3).groupBy("graph_id").count().collect()
    assert len(drawn) == 20 and np.mean([x["count"] for x in drawn]) == pytest.approx(78, abs=10)


def test_methods_on_the_same_splits(spark):
    k = graphs.karate_club(spark)
    methods = {"spectral": (evaluation.spectral_scores(2), True), "hydra": (evaluation.embedding_scores(embedders.Hydra()), False)}
    rows = evaluation.compare(k, methods, [0, 1]).collect()
    assert {(r["method"], r["seed"]) for r in rows} == {(m, s) for m in methods for s in (0, 1)}
    table = evaluation.ladder({"club": k}, methods, "hydra", "spectral", [0]).collect()
    assert [r["graph"] for r in table] == ["club"] and table[0]["pairs"] == 1 and 0 <= table[0]["delta"] < 1
    with pytest.raises(ValueError):
        evaluation.compare(k, {}, [0])


def test_noun_database(spark, tmp_path):
    path = tmp_path / "data.noun"
    path.write_text(
        "  1 licence\n"
        "00000001 03 n 01 entity 0 000 | all\n"
        "00000002 05 n 02 mammal 0 beast 1 001 @ 00000001 n 0000 | warm\n"
        "00000003 05 n 01 dog 0 002 @ 00000002 n 0000 ~ 00000004 n 0000 | barks\n"
        "00000004 05 n 01 puppy 0 001 @i 00000003 n 0000 | small\n"
        "00000005 05 n 01 stone 0 001 @ 00000001 n 0000 | hard\n"
    )
    rows = lambda *a: {tuple(r) for r in graphs.word_net(spark, str(path), *a).collect()}
    assert rows() == {(2, 1), (3, 2), (4, 3), (5, 1)}
    assert rows("Mammal") == {(3, 2), (4, 3)} and rows("mammal", 1) == {(3, 2)} and rows("unicorn") == set()
    (tmp_path / "l.csv").write_text("1,a\n2,b\n,c\n")
    assert {tuple(r) for r in graphs.node_labels(spark, str(tmp_path / "l.csv")).collect()} == {(1, "a"), (2, "b")}


def test_graph_of_cells_is_joined_by_the_shortest_links(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([c + 0.1 * rng.normal(size=(4, 2)) for c in ([0, 0], [3, 0], [3, 4], [40, 0], [41, 3])])
    points = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(x)], "node_id bigint, x array<double>")
    got = {(r["src"], r["dst"]) for r in graphs.cell_graph(points, 2).collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    group = np.arange(20) // 4
    cross = {(a, b) for a, b in got if group[a] != group[b]}
    # one component after the other takes its shortest link outwards
    inside, want = {0}, set()
    while len(inside) < 5:
        a, b = min(((a, b) for a in range(20) for b in range(20) if group[a] in inside and group[b] not in inside), key=lambda p: d[p])
        inside.add(group[b])
        want.add((min(a, b), max(a, b)))
    assert cross == want
