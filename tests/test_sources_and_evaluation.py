import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphs import EDGES
from horograph.operators import embedders, evaluation, graph
from horograph.sources import graphs as g


def test_edge_lists(spark, tmp_path):
    with gzip.open(tmp_path / "a.txt.gz", "wt") as f:
        f.write("# a comment\n1\t2\n2 1\n 3   4 \n\n5 5\n")
    assert sorted(tuple(r)[:2] for r in g.snap_edges(spark, str(tmp_path / "a.txt.gz")).collect()) == [(1, 2), (3, 4)]
    (tmp_path / "b.csv").write_text("1,2,0.5\n2,1,0.75\n7,8,\n")
    assert sorted(map(tuple, g.csv_edges(spark, str(tmp_path / "b.csv"), weighted=True).collect()), key=str) == [(1, 2, 0.75), (7, 8, None)]


def test_route_files(spark, tmp_path):
    (tmp_path / "routes.dat").write_text('A,1,X,10,Y,20,,0,\nA,1,X,20,Y,30,,0,"a,b"\nA,1,X,40,Y,40,,0,\nA,1,X,50,Y,60,,0,\nbroken\nA,1,X,\\N,Y,10,,0,\n')
    (tmp_path / "airports.dat").write_text('10,"Ten ""X"" Field","C","D","TEN",\\N,1.5,2.5,10,1,"E","tz","airport","s"\n')
    edges, nodes = g.route_graph(spark, str(tmp_path / "routes.dat"), str(tmp_path / "airports.dat"))
    assert sorted(tuple(r)[:2] for r in edges.collect()) == [(0, 1), (1, 2)]
    n = {r["node_id"]: (r["pos"], r["iata"]) for r in nodes.collect()}
    assert n == {10: (0, "TEN"), 20: (1, None), 30: (2, None)}


def test_cells_with_bare_cr(spark, tmp_path):
    rows = ["X1,X2,labels"] + [f"{k % 10}.5,{k // 10},{'a' if k < 20 else 'b'}" for k in range(40)]
    (tmp_path / "c.csv").write_bytes("\r".join(rows).encode())
    p = g.cells(spark, str(tmp_path / "c.csv"), normalize=True)
    assert p.count() == 40 and {r[0] for r in p.select("label").distinct().collect()} == {"a", "b"}
    e = g.cell_graph(p, 3)
    assert graph.connected_components(e).select("component").distinct().count() == 1


def test_precomputed(spark):
    ok = spark.createDataFrame([(1, [0.5, 0.5])], "node_id bigint, x array<double>")
    assert g.precomputed(ok).count() == 1
    with pytest.raises(Exception, match="inside the ball"):
        g.precomputed(spark.createDataFrame([(1, [1.0, 0.0])], "node_id bigint, x array<double>")).collect()


def test_evaluation(spark):
    e = spark.createDataFrame([(a, b, 1.0) for a, b in EDGES], "src bigint, dst bigint, weight double")
    splits = evaluation.prepare_splits(e, [0, 1], 0.85, giant=True)
    a = evaluation.evaluate(splits, "hydra", evaluation.embedding_scores(embedders.Hydra(d=2)))
    b = evaluation.evaluate(splits, "spectral", evaluation.spectral_scores(4), higher_is_link=True)
    r = a.unionByName(b)
    rows = r.collect()
    assert len(rows) == 4 and all(0 <= x["auc"] <= 1 for x in rows)
    r = spark.createDataFrame(rows, r.schema)
    assert evaluation.summary(r).count() == 2 and evaluation.advantage(r, "hydra", "spectral").first()["pairs"] == 2
    assert "| method |" in g.markdown(evaluation.summary(r))
    d = evaluation.diagnose(e, 2000, 40).first()
    assert d["verdict"] in ("hyperbolic", "euclidean", "ambiguous") and d["nodes"] == 34


def test_correlations_and_plots(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 4.0), (3.0, 9.0), (3.0, 16.0), (None, 1.0)], "a double, b double")
    c = evaluation.correlations(df, "a", "b").first()
    assert c["spearman"] == pytest.approx(0.9486832981) and c["pearson"] == pytest.approx(np.corrcoef([1, 2, 3, 3], [1, 4, 9, 16])[0, 1])
    e = evaluation.chart_errors(spark, [1.0, 8.0, 18.0]).orderBy("r").collect()
    assert all(x["polar"] < 1e-12 for x in e) and e[1]["ball"] < 1e-6 and e[2]["hyperboloid"] > 1e-3
    nodes = spark.createDataFrame([(1, 0.5, [1.0, 0.0]), (2, 1.5, [0.0, 1.0])], "node_id bigint, r double, v array<double>")
    edges = spark.createDataFrame([(1, 2)], "src bigint, dst bigint")
    assert evaluation.plot_edges(edges, nodes, edges).first()["known"] is False
    assert evaluation.disk_coordinates(nodes.withColumn("theta", F.lit(0.0))).orderBy("node_id").collect()[1]["x"] == pytest.approx(0.97)
