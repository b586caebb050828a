"""Queries of the spectral, iterative and streaming operators; SQL where it can express them."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horograph.operators import curvature, dense, embedders, evaluation, generation, graph, links, pairs
from horograph.plans import data_quality
from horograph.plans.catalog import Catalog
from horograph.plans.hyperbolic import EMB, PAIRS, ROUTE_GRAPH, TRIANGLES, emb, rg
from horograph.runtime import checkpoint_dir, materialize, table
from horograph.sources.route_lines import parse_routes
from horograph.streaming import deltas

catalog = Catalog()


def _tree(spark) -> DataFrame:
    return graph.balanced_tree(spark, 2, 4)


def _networks(spark, d) -> DataFrame:
    """(net_id, src, dst, weight): the distinct edges of every network; the largest weight, 1 where none is known."""
    t = table(spark, d, "network_edges").where("net_id IS NOT NULL AND src <> dst")
    return t.groupBy("net_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.coalesce(F.max("weight"), F.lit(1.0)).alias("weight"))


def _fitted(spark, d, embedder: embedders.Embedder) -> DataFrame:
    return embedders.fit_networks(materialize(_networks(spark, d)), embedder)


_LAST = """
WITH l AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, op, coalesce(weight, 1.0) AS w, ts, delta_id FROM graph_deltas
 WHERE src <> dst AND ts IS NOT NULL AND op IN ('add_edge', 'remove_edge', 'set_weight')),
n AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY ts DESC, delta_id DESC, op DESC, w DESC) AS k FROM l)
SELECT a AS src, b AS dst, w AS weight FROM n WHERE k = 1 AND op <> 'remove_edge'
"""


@catalog.add("delta_stream_apply", _LAST)
def delta_stream_apply(spark, d):
    # a pattern, since a stream source wants one or a folder
    state = deltas.replay(spark, f"{d}/graph_deltas.parque[t]", f"{checkpoint_dir(spark)}/stream-{uuid.uuid4()}")
    return state.edges()


@catalog.add("delta_batch_apply", _LAST)
def delta_batch_apply(spark, d):
    return deltas.current_edges(deltas.last_changes(table(spark, d, "graph_deltas")))


@catalog.add("forest_matrix", ROUTE_GRAPH + "SELECT node_id AS i, 1.0::DOUBLE AS total, TRUE AS own_is_largest, TRUE AS in_range FROM deg")
def forest_matrix(spark, d):
    """What holds for every row of the matrix: its sum is 1, its diagonal is its largest entry, no entry is below 0."""
    own = F.col("i") == F.col("j")
    rows = dense.forest_matrix(rg(spark, d)).groupBy("i").agg(F.max(F.when(own, F.col("q"))).alias("own"), F.max(F.when(~own, F.col("q"))).alias("other"), F.min("q").alias("least"), F.round(F.sum("q"), 9).alias("total"))
    return rows.select("i", "total", (F.col("own") > F.col("other")).alias("own_is_largest"), (F.col("least") > -1e-12).alias("in_range"))


@catalog.add("hydra_embedding")
def hydra_embedding(spark, d):
    return dense.hydra_embedding(graph.largest_component(materialize(rg(spark, d))))


@catalog.add("laplacian_eigenmaps", ROUTE_GRAPH + "SELECT node_id, 1.0::DOUBLE AS norm FROM deg")
def laplacian_eigenmaps(spark, d):
    """The norm of every place, which is 1."""
    return dense.eigenmaps(rg(spark, d), 2).select("node_id", F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 9).alias("norm"))


@catalog.add("adjacency_spectral")
def adjacency_spectral(spark, d):
    return dense.adjacency_spectral(rg(spark, d), 8)


@catalog.add("hyperbolicity")
def hyperbolicity(spark, d):
    return curvature.mean_hyperbolicity(rg(spark, d))


@catalog.add("ricci_curvature")
def ricci_curvature(spark, d):
    return curvature.ricci_curvature(rg(spark, d))


@catalog.add("balanced_tree", "SELECT CAST((i - 1) // 2 AS BIGINT) AS src, CAST(i AS BIGINT) AS dst, 1.0::DOUBLE AS weight FROM range(1, 31) t(i)")
def balanced_tree(spark, d):
    return _tree(spark)


@catalog.add(
    "transitive_closure",
    """WITH RECURSIVE e AS (SELECT DISTINCT net_id, least(src, dst) AS child, greatest(src, dst) AS parent FROM network_edges WHERE net_id IS NOT NULL AND src <> dst),
 c(net_id, child, ancestor) AS (SELECT net_id, child, parent FROM e UNION SELECT c.net_id, c.child, e.parent FROM c JOIN e ON e.net_id = c.net_id AND e.child = c.ancestor)
 SELECT net_id, child, ancestor FROM c""",
)
def transitive_closure(spark, d):
    """(net_id, child, ancestor): the closure of every network, its edges pointing to the larger id."""
    edges = table(spark, d, "network_edges").where("net_id IS NOT NULL AND src <> dst")
    # rows that repeat don't change the closure
    return graph.network_closures(edges.select(F.col("net_id").cast("bigint").alias("net_id"), F.least("src", "dst").cast("bigint").alias("src"), F.greatest("src", "dst").cast("bigint").alias("dst")))


@catalog.add(
    "fermi_dirac_sample",
    PAIRS + f", g AS (SELECT unnest([0, 1]) AS graph_id) SELECT CAST(graph_id AS INTEGER) AS graph_id, i, j FROM p, g WHERE {generation.uniform_sql('i', 'j', 'graph_id', '0')} < 1 / (exp((d - 2.0) / 0.5) + 1)",
)
def fermi_dirac_sample(spark, d):
    return generation.fermi_dirac_sample(pairs.polar_distances(emb(spark, d)), 2.0, 0.5, 2)


@catalog.add("fermi_dirac_fit")
def fermi_dirac_fit(spark, d):
    p = materialize(pairs.polar_distances(emb(spark, d)))
    f = generation.fit_fermi_dirac(p, graph.knn_graph_of(emb(spark, d), k=15))
    return spark.createDataFrame([(f["r"], f["t"], f["nll"])], "r double, t double, nll double")


@catalog.add(
    "uniform_hyperbolic_disk",
    f"SELECT i AS node_id, round(acosh(1 + {generation.uniform_sql('i', '0', '0')} * ({math.cosh(6.0)!r} - 1)), 9) AS r, round(2 * pi() * {generation.uniform_sql('i', '0', '1')}, 9) AS theta FROM range(1000) t(i)",
)
def uniform_hyperbolic_disk(spark, d):
    return generation.uniform_hyperbolic_disk(spark, 1000, 6.0).select("node_id", F.round("r", 9).alias("r"), F.round("theta", 9).alias("theta"))


@catalog.add("poincare_maps")
def poincare_maps(spark, d):
    return _fitted(spark, d, embedders.PoincareMaps(lr=0.05))


@catalog.add("poincare_embeddings")
def poincare_embeddings(spark, d):
    return _fitted(spark, d, embedders.PoincareEmbeddings(lr=0.05))


@catalog.add("poincare_embeddings_routes")
def poincare_embeddings_routes(spark, d):
    """The whole route graph with the default steps and negatives, over gathered pairs; the loss of the first and the last step beside the coordinates."""
    f = embedders.PoincareEmbeddings(lr=0.05).fit(graph.unweighted(materialize(rg(spark, d))))
    return f.coordinates.select("*", F.lit(f.history[0]).alias("first_loss"), F.lit(f.history[-1]).alias("last_loss"))


@catalog.add("poincare_embeddings_fermi_dirac")
def poincare_embeddings_fermi_dirac(spark, d):
    return _fitted(spark, d, embedders.PoincareEmbeddings(loss="fermi_dirac", lr=0.05))


@catalog.add("lorentz_embeddings")
def lorentz_embeddings(spark, d):
    return _fitted(spark, d, embedders.LorentzEmbeddings(lr=0.1))


@catalog.add("hydra_plus")
def hydra_plus(spark, d):
    return _fitted(spark, d, embedders.HydraPlus())


@catalog.add("hypermap")
def hypermap(spark, d):
    return _fitted(spark, d, embedders.HyperMap(gamma=2.5))


@catalog.add("dmercator")
def dmercator(spark, d):
    return _fitted(spark, d, embedders.DMercator())


@catalog.add("unknown_edge_joint_fit")
def unknown_edge_joint_fit(spark, d):
    """In every network a tenth of the edges and one in a thousand of the other pairs are unknown."""
    e = materialize(_networks(spark, d).withColumn("weight", F.lit(1.0)))
    held = links.split_edges(e, 0.9, 3).where(F.col("part") == "R").select("net_id", "src", "dst")
    nodes = materialize(e.select("net_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct())
    a, b = nodes.withColumnRenamed("node_id", "src"), nodes.withColumnRenamed("node_id", "dst")
    drawn = a.join(b, "net_id").where((F.col("src") < F.col("dst")) & (links.pair_hash(F.col("src"), F.col("dst"), 4) < 1))
    extra = drawn.join(e.select("net_id", "src", "dst"), ["net_id", "src", "dst"], "left_anti")
    return embedders.fit_unknown_networks(e, held.unionByName(extra), embedders.PoincareEmbeddings(loss="fermi_dirac", lr=0.05, lr_a=0.05))


@catalog.add(
    "route_line_graph",
    data_quality.JUDGED
    + r""", g AS (SELECT CASE WHEN s <> '\N' THEN CAST(s AS BIGINT) END AS a, CASE WHEN d <> '\N' THEN CAST(d AS BIGINT) END AS b FROM j WHERE reason IS NULL)
 SELECT least(a, b) AS src, greatest(a, b) AS dst, CAST(count(*) AS DOUBLE) AS weight FROM g WHERE a <> b GROUP BY 1, 2""",
)
def route_line_graph(spark, d):
    """The graph of the raw route lines that parse."""
    return graph.canonical_edges(parse_routes(table(spark, d, "routes_raw"))[0])


@catalog.add(
    "degree_triangle_correlation",
    TRIANGLES
    + """, r AS (SELECT degree, triangles, rank() OVER (ORDER BY degree) + (count(*) OVER (PARTITION BY degree) - 1) / 2 AS rd, rank() OVER (ORDER BY triangles) + (count(*) OVER (PARTITION BY triangles) - 1) / 2 AS rt FROM cl)
 SELECT round(corr(degree, triangles), 6) AS pearson, round(corr(rd, rt), 6) AS spearman FROM r""",
)
def degree_triangle_correlation(spark, d):
    c = evaluation.correlations(graph.clustering(rg(spark, d)), "degree", "triangles")
    return c.select(F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@catalog.add(
    "disk_display",
    EMB
    + """, s AS (SELECT min(r) AS lo, max(r) AS hi FROM emb), f AS (SELECT node_id, 0.97 * (r - lo) / (hi - lo) AS rho, atan2(v[2], v[1]) AS t FROM emb, s)
 SELECT node_id, round(rho * cos(t), 7) AS x, round(rho * sin(t), 7) AS y FROM f""",
)
def disk_display(spark, d):
    n = emb(spark, d).withColumn("theta", F.atan2(F.col("v")[1], F.col("v")[0]))
    return evaluation.disk_coordinates(n).select("node_id", F.round("x", 7).alias("x"), F.round("y", 7).alias("y"))


@catalog.add("chart_conditioning")
def chart_conditioning(spark, d):
    return evaluation.chart_errors(spark, [1, 2, 4, 6, 8, 10, 12, 14, 16, 18])


@catalog.add("geometry_diagnostics")
def geometry_diagnostics(spark, d):
    return evaluation.diagnose(rg(spark, d))


@catalog.add("link_prediction_spectral")
def link_prediction_spectral(spark, d):
    """Five paired splits for each of three dimensions."""
    splits = evaluation.prepare_splits(materialize(rg(spark, d)), [0, 1, 2, 3, 4], 0.9, giant=True)
    rows = [evaluation.evaluate(splits, f"spectral_{k}", evaluation.spectral_scores(k), higher_is_link=True) for k in (2, 8, 16)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
