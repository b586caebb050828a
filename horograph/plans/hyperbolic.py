"""Queries of the hyperbolic operators, with their SQL.

``emb`` places the vectors of ``embeddings`` in the polar chart: the unit vector
is the direction, the radius is 2 artanh((1 + vec_id mod 9) / 10).  ``rg`` is
the graph of all routes between two different airports.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horograph.functions import charts, distances
from horograph.functions.vectors import unit
from horograph.operators import classification, generation, graph, links, pairs, parameters, ranking
from horograph.operators.ordering import numbered
from horograph.plans.catalog import Catalog
from horograph.runtime import materialize, table

catalog = Catalog()


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    r = 2 * F.atanh((1 + F.col("vec_id") % 9) / 10)
    return table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull()).select(F.col("vec_id").alias("node_id"), "label", r.alias("r"), unit(v).alias("v"))


def rg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.canonical_edges(table(spark, sf_dir, "routes"))


def rg_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()


EMB = """
WITH e0 AS (SELECT vec_id AS node_id, label, 2 * atanh((1 + vec_id % 9) / 10.0) AS r, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS u FROM embeddings WHERE embedding IS NOT NULL),
emb AS (SELECT node_id, label, r, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u))) AS v FROM e0)
"""
_PAIRS = (
    EMB
    + """, m AS (SELECT a.node_id AS i, b.node_id AS j, a.label AS li, b.label AS lj,
  2 * pow((exp((a.r - b.r) / 2) - exp((b.r - a.r) / 2)) / 2, 2) + 0.5 * (exp(a.r) - exp(-a.r)) / 2 * (exp(b.r) - exp(-b.r)) / 2 * pow(list_distance(a.v, b.v), 2) AS m
  FROM emb a JOIN emb b ON a.node_id < b.node_id),
p AS (SELECT i, j, li, lj, ln(1 + m + sqrt(m * (m + 2) + 1e-30)) AS d FROM m)
"""
)
_RG = """
WITH rg AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, CAST(count(*) AS DOUBLE) AS weight FROM routes WHERE src <> dst GROUP BY 1, 2),
deg AS (SELECT node_id, CAST(count(*) AS BIGINT) AS degree FROM (SELECT src AS node_id FROM rg UNION ALL SELECT dst FROM rg) GROUP BY 1)
"""


PAIRS, ROUTE_GRAPH = _PAIRS, _RG


def _coords(df: DataFrame, c: str) -> DataFrame:
    """First two coordinates and the sum of all, rounded."""
    x = F.col(c)
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    return df.select("node_id", F.round(x[0], 7).alias("x0"), F.round(x[1], 7).alias("x1"), F.round(total, 6).alias("total"))


def _coords_sql(x: str) -> str:
    return EMB + f", q AS (SELECT node_id, {x} AS x FROM emb) SELECT node_id, round(x[1], 7) AS x0, round(x[2], 7) AS x1, round(list_sum(x), 6) AS total FROM q"


_SINH, _COSH = "((exp(r) - exp(-r)) / 2)", "((exp(r) + exp(-r)) / 2)"
_BALL = "list_transform(v, lambda c: tanh(r / 2) * c)"


@catalog.add("polar_to_ball", _coords_sql(_BALL))
def polar_to_ball(spark, d):
    return _coords(emb(spark, d).withColumn("x", charts.polar_to_ball(F.col("r"), F.col("v"))), "x")


@catalog.add("ball_to_polar", EMB + "SELECT node_id, round(r, 7) AS r, round(v[1], 7) AS v0 FROM emb")
def ball_to_polar(spark, d):
    r, v = charts.ball_to_polar(F.col("x"))
    return emb(spark, d).withColumn("x", charts.polar_to_ball(F.col("r"), F.col("v"))).select("node_id", F.round(r, 7).alias("r"), F.round(v[0], 7).alias("v0"))


@catalog.add("polar_to_hyperboloid", _coords_sql(f"list_concat([{_COSH}], list_transform(v, lambda c: {_SINH} * c))"))
def polar_to_hyperboloid(spark, d):
    return _coords(emb(spark, d).withColumn("h", charts.polar_to_hyperboloid(F.col("r"), F.col("v"))), "h")


@catalog.add("hyperboloid_to_polar", EMB + "SELECT node_id, round(r, 7) AS r, round(v[1], 7) AS v0 FROM emb")
def hyperboloid_to_polar(spark, d):
    r, v = charts.hyperboloid_to_polar(F.col("h"))
    return emb(spark, d).withColumn("h", charts.polar_to_hyperboloid(F.col("r"), F.col("v"))).select("node_id", F.round(r, 7).alias("r"), F.round(v[0], 7).alias("v0"))


@catalog.add("ball_to_hyperboloid", _coords_sql(f"list_concat([{_COSH}], list_transform(v, lambda c: {_SINH} * c))"))
def ball_to_hyperboloid(spark, d):
    x = charts.polar_to_ball(F.col("r"), F.col("v"))
    return _coords(emb(spark, d).withColumn("h", charts.ball_to_hyperboloid(x)), "h")


@catalog.add("hyperboloid_to_ball", _coords_sql(_BALL))
def hyperboloid_to_ball(spark, d):
    return _coords(emb(spark, d).withColumn("h", charts.polar_to_hyperboloid(F.col("r"), F.col("v"))).withColumn("x", charts.hyperboloid_to_ball(F.col("h"))), "x")


@catalog.add("tangent_vector", _coords_sql("list_transform(v, lambda c: r * c)"))
def tangent_vector(spark, d):
    return _coords(emb(spark, d).withColumn("z", F.transform("v", lambda c: c * F.col("r"))), "z")


_FLAT = ", f AS (SELECT node_id, r, atan2(v[2], v[1]) AS theta FROM emb) "


@catalog.add("polar_to_poincare_2d", EMB + _FLAT + "SELECT node_id, round(tanh(r / 2) * cos(theta), 7) AS x, round(tanh(r / 2) * sin(theta), 7) AS y FROM f")
def polar_to_poincare_2d(spark, d):
    x = charts.flat_polar_to_ball(F.atan2(F.col("v")[1], F.col("v")[0]), F.col("r"))
    return emb(spark, d).select("node_id", F.round(x[0], 7).alias("x"), F.round(x[1], 7).alias("y"))


@catalog.add("poincare_to_polar_2d", EMB + _FLAT + "SELECT node_id, round(CASE WHEN theta < 0 THEN theta + 2 * pi() ELSE theta END, 7) AS theta, round(r, 7) AS r FROM f")
def poincare_to_polar_2d(spark, d):
    flat = emb(spark, d).withColumn("x", charts.flat_polar_to_ball(F.atan2(F.col("v")[1], F.col("v")[0]), F.col("r")))
    theta, r = charts.ball_to_flat_polar(F.col("x"))
    return flat.select("node_id", F.round(theta, 7).alias("theta"), F.round(r, 7).alias("r"))


@catalog.add("hyperspherical_roundtrip", _coords_sql(_BALL))
def hyperspherical_roundtrip(spark, d):
    x = emb(spark, d).withColumn("x", charts.polar_to_ball(F.col("r"), F.col("v")))
    angles, r = charts.ball_to_hyperspherical(F.col("x"))
    return _coords(x.withColumn("a", angles).withColumn("s", r).withColumn("y", charts.hyperspherical_to_ball(F.col("a"), F.col("s"))), "y")


@catalog.add(
    "poincare_recenter",
    EMB
    + f""", x AS (SELECT node_id, {_BALL} AS x FROM emb), c AS (SELECT x AS c FROM x ORDER BY node_id LIMIT 1),
 t AS (SELECT node_id, x, c, -list_dot_product(c, x) AS g, list_dot_product(c, c) AS c2, list_dot_product(x, x) AS x2 FROM x, c),
 k AS (SELECT node_id, x, c, -(1 + 2 * g + x2) / (1 + 2 * g + c2 * x2) AS kc, (1 - c2) / (1 + 2 * g + c2 * x2) AS kx FROM t)
 SELECT node_id, round(kc * c[1] + kx * x[1], 7) AS y0, round(kc * c[2] + kx * x[2], 7) AS y1 FROM k""",
)
def poincare_recenter(spark, d):
    x = emb(spark, d).select("node_id", charts.polar_to_ball(F.col("r"), F.col("v")).alias("x"))
    center = x.orderBy("node_id").limit(1).select(F.col("x").alias("c"))
    y = charts.recenter(F.col("x"), F.col("c"))
    return x.crossJoin(F.broadcast(center)).withColumn("y", y).select("node_id", F.round(F.col("y")[0], 7).alias("y0"), F.round(F.col("y")[1], 7).alias("y1"))


@catalog.add("pair_distance_polar", _PAIRS + "SELECT i, j, round(d, 6) AS d FROM p")
def pair_distance_polar(spark, d):
    return pairs.polar_distances(emb(spark, d)).withColumn("d", F.round("d", 6))


def _rounded(p: DataFrame) -> DataFrame:
    return p.select("i", "j", F.round("d", 6).alias("d"))


def _pair_sql(expr: str) -> str:
    return _PAIRS + f"SELECT i, j, round({expr}, 6) AS d FROM p"


def _ball_kernel(curvature: float, ceiling: bool):
    import numpy as np

    def run(r1, x1, r2, x2):
        gap = ((x1[:, None, :] - x2[None, :, :]) ** 2).sum(axis=2)
        m = 2 * gap / ((1 - (x1 * x1).sum(axis=1))[:, None] * (1 - (x2 * x2).sum(axis=1))[None])
        out = np.log1p(m + np.sqrt(m * (m + 2))) / math.sqrt(curvature)
        return np.minimum(out, distances.BALL_CEILING) if ceiling else out

    return run


def _ball_nodes(spark, d):
    return emb(spark, d).withColumn("v", charts.polar_to_ball(F.col("r"), F.col("v")))


@catalog.add("pair_distance_ball", _pair_sql("least(d, 16.811242831518264)"))
def pair_distance_ball(spark, d):
    return _rounded(pairs.all_pairs(_ball_nodes(spark, d), _ball_kernel(1.0, True)))


@catalog.add("pair_distance_curvature", _pair_sql("d / sqrt(2.5)"))
def pair_distance_curvature(spark, d):
    return _rounded(pairs.all_pairs(_ball_nodes(spark, d), _ball_kernel(2.5, False)))


@catalog.add("pair_distance_lorentz", _pair_sql("d"))
def pair_distance_lorentz(spark, d):
    import numpy as np

    def run(r1, h1, r2, h2):
        flip = h2.copy()
        flip[:, 1:] *= -1
        return np.arccosh(np.maximum(1.0, h1 @ flip.T))

    return _rounded(pairs.all_pairs(emb(spark, d).withColumn("v", charts.polar_to_hyperboloid(F.col("r"), F.col("v"))), run))


@catalog.add("gathered_distance", _PAIRS + "SELECT i, j, round(d, 6) AS d FROM p WHERE li = lj")
def gathered_distance(spark, d):
    e = emb(spark, d)
    same = pairs.gather(pairs.expand_pairs(e), e, ["label"]).where(F.col("label_i") == F.col("label_j")).select("i", "j")
    return pairs.gathered_polar(same, e).withColumn("d", F.round("d", 6))


def _knn_sql(chosen: str) -> str:
    return (
        _PAIRS
        + f""", b AS (SELECT i AS a, j AS b, d FROM p UNION ALL SELECT j, i, d FROM p),
 n AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM b),
 s AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, max(d) AS weight, count(*) AS chosen FROM n WHERE k <= 15 GROUP BY 1, 2)
 SELECT src, dst, round(weight, 6) AS weight FROM s WHERE {chosen}"""
    )


@catalog.add("knn_graph_symmetric", _knn_sql("TRUE"))
def knn_graph_symmetric(spark, d):
    return graph.knn_graph_of(emb(spark, d), k=15).withColumn("weight", F.round("weight", 6))


@catalog.add("knn_graph_mutual", _knn_sql("chosen = 2"))
def knn_graph_mutual(spark, d):
    return graph.knn_graph_of(emb(spark, d), k=15, symmetric=False).withColumn("weight", F.round("weight", 6))


@catalog.add("canonical_edges", _RG + "SELECT src, dst, weight FROM rg")
def canonical_edges(spark, d):
    return rg(spark, d)


@catalog.add("degree_histogram", _RG + "SELECT degree, CAST(count(*) AS BIGINT) AS nodes FROM deg GROUP BY 1")
def degree_histogram(spark, d):
    return graph.degrees(rg(spark, d)).groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


TRIANGLES = (
    _RG
    + """, tri AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM rg x JOIN rg y ON y.src = x.dst JOIN rg z ON z.src = x.src AND z.dst = y.dst),
per AS (SELECT node_id, CAST(count(*) AS BIGINT) AS t FROM (SELECT a AS node_id FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri) GROUP BY 1),
cl AS (SELECT node_id, degree, coalesce(t, 0) AS triangles, CASE WHEN degree > 1 THEN coalesce(t, 0) / (degree * (degree - 1) / 2) ELSE 0.0 END AS clustering FROM deg LEFT JOIN per USING (node_id))
"""
)


@catalog.add("triangle_clustering", TRIANGLES + "SELECT node_id, degree, CAST(triangles AS BIGINT) AS triangles, round(clustering, 9) AS clustering FROM cl")
def triangle_clustering(spark, d):
    return graph.clustering(rg(spark, d)).withColumn("clustering", F.round("clustering", 9))


@catalog.add(
    "degree_stats",
    TRIANGLES
    + """SELECT CAST(count(*) AS BIGINT) AS nodes, CAST(sum(degree) / 2 AS BIGINT) AS edges, round(avg(degree), 6) AS mean_degree, round(stddev_pop(degree), 6) AS std_degree,
 max(degree) AS max_degree, round(avg(clustering), 6) AS average_clustering, round(sum(triangles) / sum(degree * (degree - 1) / 2), 6) AS transitivity FROM cl""",
)
def degree_stats(spark, d):
    s = graph.degree_and_clustering(rg(spark, d))
    return s.select("nodes", "edges", "max_degree", *[F.round(c, 6).alias(c) for c in ("mean_degree", "std_degree", "average_clustering", "transitivity")])


@catalog.add(
    "common_neighbors",
    TRIANGLES
    + """, side AS (SELECT a AS src, b AS dst FROM tri UNION ALL SELECT a, c FROM tri UNION ALL SELECT b, c FROM tri), n AS (SELECT src, dst, count(*) AS k FROM side GROUP BY 1, 2)
 SELECT src, dst, CAST(coalesce(k, 0) AS BIGINT) AS common FROM rg LEFT JOIN n USING (src, dst)""",
)
def common_neighbors(spark, d):
    return graph.edge_common_neighbors(rg(spark, d))


_SPLIT = _RG + ", sp AS (SELECT *, CASE WHEN ((src * 2654435761 + dst * 40503) % 1000 + 1000) % 1000 < 900 THEN 'E' ELSE 'R' END AS part FROM rg)"
_NONE = _SPLIT + ", ne AS (SELECT a.node_id AS src, b.node_id AS dst FROM deg a JOIN deg b ON a.node_id < b.node_id ANTI JOIN rg ON rg.src = a.node_id AND rg.dst = b.node_id)"


@catalog.add("link_split", _SPLIT + " SELECT src, dst, part FROM sp")
def link_split(spark, d):
    return links.split_edges(rg(spark, d)).select("src", "dst", "part")


@catalog.add("training_graph", _SPLIT + " SELECT src, dst, weight FROM sp WHERE part = 'E'")
def training_graph(spark, d):
    return links.training_graph(links.split_edges(rg(spark, d)))


@catalog.add("non_edges", _NONE + " SELECT src, CAST(count(*) AS BIGINT) AS n, CAST(sum(dst) AS BIGINT) AS dst_sum FROM ne GROUP BY 1")
def non_edges(spark, d):
    e = materialize(rg(spark, d))
    return links.non_edges(e, rg_nodes(e)).groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("dst").alias("dst_sum"))


@catalog.add(
    "candidate_scores",
    _NONE
    + """, td AS (SELECT node_id, count(*) AS k FROM (SELECT src AS node_id FROM sp WHERE part = 'E' UNION ALL SELECT dst FROM sp WHERE part = 'E') GROUP BY 1),
 ca AS (SELECT src, dst, TRUE AS is_positive FROM sp WHERE part = 'R' UNION ALL SELECT src, dst, FALSE FROM ne)
 SELECT is_positive, CAST(count(*) AS BIGINT) AS n, CAST(sum(coalesce(x.k, 0) * coalesce(y.k, 0)) AS BIGINT) AS score FROM ca LEFT JOIN td x ON x.node_id = src LEFT JOIN td y ON y.node_id = dst GROUP BY 1""",
)
def candidate_scores(spark, d):
    split = materialize(links.split_edges(rg(spark, d)))
    c = links.candidates(split, rg_nodes(split))
    k = graph.degrees(links.training_graph(split))
    a, b = k.select(F.col("node_id").alias("src"), F.col("degree").alias("x")), k.select(F.col("node_id").alias("dst"), F.col("degree").alias("y"))
    s = c.join(a, "src", "left").join(b, "dst", "left").withColumn("score", F.coalesce("x", F.lit(0)) * F.coalesce("y", F.lit(0)))
    return s.groupBy("is_positive").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))


_CANDS = _PAIRS + ", c AS (SELECT i * 1000000 + j AS cand_id, round(d, 9) AS score, li = lj AS is_positive FROM p), n AS (SELECT *, row_number() OVER (ORDER BY score, cand_id) AS rn FROM c)"


def label_candidates(spark, d) -> DataFrame:
    """Pairs of vectors ranked by distance; positive where the labels agree."""
    e = emb(spark, d)
    g = pairs.gather(pairs.polar_distances(e), e, ["label"])
    return g.select((F.col("i") * 1000000 + F.col("j")).alias("cand_id"), F.round("d", 9).alias("score"), (F.col("label_i") == F.col("label_j")).alias("is_positive"))


@catalog.add(
    "f1_at_k",
    _CANDS
    + """, k AS (SELECT count(*) FILTER (WHERE is_positive) AS k FROM c), h AS (SELECT count(*) FILTER (WHERE is_positive AND rn <= k) AS hits, any_value(k) AS k FROM n, k)
 SELECT CAST(k AS BIGINT) AS k, CAST(hits AS BIGINT) AS hits, round(hits / k, 9) AS "precision", round(hits / k, 9) AS recall, round(hits / k, 9) AS f1 FROM h""",
)
def f1_at_k(spark, d):
    r = ranking.precision_recall_f1(label_candidates(spark, d), higher_is_link=False)
    return r.select("k", "hits", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@catalog.add(
    "roc_auc",
    _CANDS
    + """, t AS (SELECT is_positive, rank() OVER (ORDER BY score DESC) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS mid FROM c),
 s AS (SELECT sum(mid) FILTER (WHERE is_positive) AS r, count(*) FILTER (WHERE is_positive) AS np, count(*) FILTER (WHERE NOT is_positive) AS nn FROM t)
 SELECT round((r - np * (np + 1) / 2) / (np * nn), 9) AS auc FROM s""",
)
def roc_auc(spark, d):
    return ranking.roc_auc(label_candidates(spark, d), higher_is_link=False).select(F.round("auc", 9).alias("auc"))


@catalog.add(
    "lift_curve",
    _CANDS
    + """, a AS (SELECT count(*) AS n, count(*) FILTER (WHERE is_positive) AS np FROM c), b AS (SELECT least((rn - 1) // (a.n // 10), 9) AS bin, is_positive, a.n AS alln, np FROM n, a)
 SELECT CAST(bin AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE is_positive) AS BIGINT) AS positives, round(count(*) FILTER (WHERE is_positive) / count(*), 9) AS rate,
 round(count(*) FILTER (WHERE is_positive) / count(*) / (any_value(np) / any_value(alln)), 9) AS lift FROM b GROUP BY 1""",
)
def lift_curve(spark, d):
    return ranking.lift_curve(label_candidates(spark, d), higher_is_link=False).withColumn("rate", F.round("rate", 9)).withColumn("lift", F.round("lift", 9))


@catalog.add(
    "hits_at_k",
    _CANDS + ", k AS (SELECT max(score) AS s FROM (SELECT score FROM c WHERE NOT is_positive ORDER BY score LIMIT 20)) SELECT round(avg(CASE WHEN score < s THEN 1.0 ELSE 0.0 END), 9) AS hits FROM c, k WHERE is_positive",
)
def hits_at_k(spark, d):
    return ranking.hits_at(label_candidates(spark, d), 20, higher_is_link=False).select(F.round("hits", 9).alias("hits"))


_VOTE = (
    _PAIRS
    + """, b AS (SELECT i AS a, j AS b, lj AS lb, d FROM p UNION ALL SELECT j, i, li, d FROM p),
 n AS (SELECT a, lb, row_number() OVER (PARTITION BY a ORDER BY round(d, 9), b) AS k FROM b WHERE a * 2654435761 % 5 <> b * 2654435761 % 5),
 v AS (SELECT a, lb, count(*) AS c FROM n WHERE k <= 5 GROUP BY 1, 2), w AS (SELECT a, lb, row_number() OVER (PARTITION BY a ORDER BY c DESC, lb) AS o FROM v),
 x AS (SELECT a AS node_id, CAST(a * 2654435761 % 5 AS INTEGER) AS fold, label, lb AS predicted FROM w JOIN emb ON emb.node_id = a WHERE o = 1)
"""
)


def _voted(spark, d) -> DataFrame:
    fold = F.pmod(F.col("node_id") * F.lit(2654435761).cast("bigint"), F.lit(5)).cast("int")
    return classification.knn_predictions(emb(spark, d).withColumn("fold", fold), 5, digits=9)


@catalog.add("knn_classification", _VOTE + "SELECT node_id, fold, label, predicted FROM x")
def knn_classification(spark, d):
    """Majority vote of the 5 nearest nodes of the other four folds; folds by hash, so that SQL can repeat them."""
    return _voted(spark, d)


@catalog.add(
    "knn_classification_scores",
    _VOTE
    + """, c AS (SELECT DISTINCT fold, label AS c FROM x UNION SELECT DISTINCT fold, predicted FROM x),
 s AS (SELECT c.fold, c.c, count(*) FILTER (WHERE label = c.c) AS size, count(*) FILTER (WHERE predicted = c.c) AS said, count(*) FILTER (WHERE label = c.c AND predicted = c.c) AS hits FROM c JOIN x ON x.fold = c.fold GROUP BY 1, 2)
 SELECT fold, round(sum(hits) / sum(size), 9) AS accuracy, round(sum(size * 2 * hits / (size + said)) / sum(size), 9) AS f1, CAST(sum(size) AS BIGINT) AS nodes, CAST(count(*) FILTER (WHERE size > 0) AS BIGINT) AS classes FROM s GROUP BY 1""",
)
def knn_classification_scores(spark, d):
    s = classification.scores(_voted(spark, d), by_fold=True)
    return s.select("fold", F.round("accuracy", 9).alias("accuracy"), F.round("f1", 9).alias("f1"), "nodes", "classes")


def label_graph(spark, d) -> DataFrame:
    """Pairs of vectors with the same label, as edges of weight 1."""
    e = emb(spark, d)
    return pairs.gather(pairs.expand_pairs(e), e, ["label"]).where(F.col("label_i") == F.col("label_j")).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.lit(1.0).alias("weight"))


@catalog.add("fermi_dirac_probabilities", _PAIRS + ", r AS (SELECT quantile_cont(d, 0.5) AS r FROM p) SELECT i, j, round(1 / (exp(d - r) + 1), 6) AS p FROM p, r")
def fermi_dirac_probabilities(spark, d):
    return links.decode_fermi_dirac(materialize(pairs.polar_distances(emb(spark, d)))).select("i", "j", F.round("p", 6).alias("p"))


@catalog.add(
    "fermi_dirac_nll",
    _PAIRS + ", q AS (SELECT li = lj AS a, greatest(1e-12, least(1 - 1e-12, 1 / (exp(d - 2.0) + 1))) AS q FROM p) SELECT round(sum(-CASE WHEN a THEN ln(q) ELSE ln(1 - q) END), 4) AS nll FROM q",
)
def fermi_dirac_nll(spark, d):
    p = links.decode_fermi_dirac(pairs.polar_distances(emb(spark, d)), 2.0, 1.0)
    return links.cross_entropy(p, label_graph(spark, d)).select(F.round("nll", 4).alias("nll"))


@catalog.add(
    "dmercator_nll",
    _PAIRS + ", z AS (SELECT li = lj AS a, 1.5 * (6.0 - d) AS z FROM p) SELECT round(sum(CASE WHEN a THEN ln(1 + exp(-z)) ELSE ln(1 + exp(z)) END), 4) AS nll FROM z",
)
def dmercator_nll(spark, d):
    return links.sphere_nll(pairs.polar_distances(emb(spark, d)), label_graph(spark, d), 3.0, 6.0).select(F.round("nll", 4).alias("nll"))


@catalog.add(
    "hypermap_nll",
    _PAIRS
    + """, n AS (SELECT node_id, row_number() OVER (ORDER BY r, node_id) AS pos, 3.0 + r AS t FROM emb),
 q AS (SELECT li = lj AS a, greatest(1e-12, least(1 - 1e-12, 1 / (exp(d - CASE WHEN y.pos > x.pos THEN y.t ELSE x.t END) + 1))) AS q FROM p JOIN n x ON x.node_id = i JOIN n y ON y.node_id = j)
 SELECT round(sum(-CASE WHEN a THEN ln(q) ELSE ln(1 - q) END), 4) AS nll FROM q""",
)
def hypermap_nll(spark, d):
    e = emb(spark, d)
    arrival = numbered(e.select("node_id", "r"), [F.asc("r"), F.asc("node_id")], "pos").select("node_id", "pos", (3.0 + F.col("r")).alias("threshold"))
    return links.cross_entropy(links.decode_younger(pairs.polar_distances(e), arrival), label_graph(spark, d)).select(F.round("nll", 4).alias("nll"))


@catalog.add(
    "softmin_decoder",
    _PAIRS
    + """, b AS (SELECT i, j, exp(-d) AS w FROM p UNION ALL SELECT j, i, exp(-d) FROM p UNION ALL SELECT node_id, node_id, 1.0 FROM emb), t AS (SELECT i, sum(w) AS t FROM b GROUP BY 1)
 SELECT i, round(max(CASE WHEN i <> j THEN w / t END), 7) AS largest, round(max(CASE WHEN i = j THEN w / t END), 7) AS own, round(sum(w / t), 7) AS total FROM b JOIN t USING (i) GROUP BY 1""",
)
def softmin_decoder(spark, d):
    p = links.decode_softmin(pairs.polar_distances(emb(spark, d)))
    own = F.col("i") == F.col("j")
    return p.groupBy("i").agg(F.round(F.max(F.when(~own, F.col("p"))), 7).alias("largest"), F.round(F.max(F.when(own, F.col("p"))), 7).alias("own"), F.round(F.sum("p"), 7).alias("total"))


@catalog.add(
    "ranking_nll_full_negatives",
    _PAIRS
    + """, b AS (SELECT i, d, li = lj AS a FROM p UNION ALL SELECT j, d, li = lj FROM p), n AS (SELECT i, sum(exp(-d)) AS s FROM b WHERE NOT a GROUP BY 1)
 SELECT round(sum(d + ln(exp(-d) + coalesce(s, 0) + 1e-12)), 4) AS nll FROM b LEFT JOIN n USING (i) WHERE a""",
)
def ranking_nll_full_negatives(spark, d):
    return links.ranking_nll(pairs.polar_distances(emb(spark, d)), label_graph(spark, d)).select(F.round("nll", 4).alias("nll"))


@catalog.add("stress", _PAIRS + ", s AS (SELECT sum(pow(d - list_distance(x.v, y.v), 2)) AS l FROM p JOIN emb x ON x.node_id = i JOIN emb y ON y.node_id = j) SELECT round(l, 4) AS loss, round(sqrt(l), 5) AS stress FROM s")
def stress(spark, d):
    import numpy as np

    def euclid(r1, v1, r2, v2):
        return np.sqrt(((v1[:, None, :] - v2[None, :, :]) ** 2).sum(axis=2))

    e = emb(spark, d)
    return links.stress(pairs.polar_distances(e), pairs.all_pairs(e, euclid)).select(F.round("loss", 4).alias("loss"), F.round("stress", 5).alias("stress"))


_UNKNOWN = _SPLIT + ", u AS (SELECT src, dst FROM sp WHERE part = 'R')"


@catalog.add(
    "two_cluster_threshold",
    _PAIRS + ", s AS (SELECT avg(d) FILTER (WHERE li = lj) AS linked, avg(d) FILTER (WHERE li <> lj) AS unlinked FROM p) SELECT round(linked, 6) AS linked, round(unlinked, 6) AS unlinked, round((linked + unlinked) / 2, 6) AS threshold FROM s",
)
def two_cluster_threshold(spark, d):
    t = links.two_cluster_threshold(pairs.polar_distances(emb(spark, d)), label_graph(spark, d))
    return t.select(*[F.round(c, 6).alias(c) for c in ("linked", "unlinked", "threshold")])


_WEIGHTS = (
    _UNKNOWN
    + """, h AS (SELECT node_id, count(*) AS h FROM (SELECT src AS node_id FROM u UNION ALL SELECT dst FROM u) GROUP BY 1),
 t AS (SELECT node_id, sum(weight) AS t FROM (SELECT src AS node_id, weight FROM sp WHERE part = 'E' UNION ALL SELECT dst, weight FROM sp WHERE part = 'E') GROUP BY 1),
 m AS (SELECT node_id, coalesce(t, 0) / ((SELECT count(*) FROM deg) - h) AS m FROM h LEFT JOIN t USING (node_id)),
 w AS (SELECT src, dst, (x.m + y.m) / 2 AS w FROM u JOIN m x ON x.node_id = src JOIN m y ON y.node_id = dst)
"""
)


def _unknown(spark, d):
    split = materialize(links.split_edges(rg(spark, d)))
    unknown = split.where(F.col("part") == "R").select("src", "dst")
    return split, unknown, links.unknown_weights(split, unknown, rg_nodes(split).count())


@catalog.add("unknown_weight_init", _WEIGHTS + "SELECT src, dst, round(w, 9) AS w_init FROM w")
def unknown_weight_init(spark, d):
    return _unknown(spark, d)[2].withColumn("w_init", F.round("w_init", 9))


@catalog.add("imputation_results", _WEIGHTS + "SELECT src, dst, 1 AS actual, CAST(w > 0.05 AS INTEGER) AS predicted, round(w, 9) AS weight FROM w")
def imputation_results(spark, d):
    split, unknown, w = _unknown(spark, d)
    return links.imputation_results(unknown, split, w.withColumnRenamed("w_init", "w"), 0.05).withColumn("weight", F.round("weight", 9))


@catalog.add("negative_candidates", _RG + "SELECT node_id, CAST((SELECT count(*) FROM deg) - 1 - degree AS BIGINT) AS negatives FROM deg")
def negative_candidates(spark, d):
    e = materialize(rg(spark, d))
    return links.negative_counts(e, rg_nodes(e))


@catalog.add(
    "similarity_negative_counts",
    _RG
    + """, b AS (SELECT src, dst, weight FROM rg UNION ALL SELECT dst, src, weight FROM rg)
 SELECT src, dst, CAST(rank() OVER (PARTITION BY src ORDER BY weight) - 1 + (SELECT count(*) FROM deg) - 1 - count(*) OVER (PARTITION BY src) AS BIGINT) AS negatives FROM b""",
)
def similarity_negative_counts(spark, d):
    e = materialize(rg(spark, d))
    return links.similarity_negatives(e, rg_nodes(e).count())


_GROWTH = (
    _RG
    + """, c AS (SELECT count(*) AS n, sum(degree) / 2 AS e, min(degree) AS m FROM deg),
 k AS (SELECT CAST(n AS DOUBLE) AS n, CAST(m AS DOUBLE) AS m, greatest(0, (2 * e / n - 2 * m) / 2) AS l, 1 / 1.5 AS beta FROM c),
 o AS (SELECT node_id, row_number() OVER (ORDER BY degree DESC, node_id) AS i FROM deg),
 g AS (SELECT node_id, i, 2 * ln(i) AS r, (1 - pow(i, beta - 1)) / (1 - beta) AS integral,
  m + 2 * l * (1 - beta) / (pow(1 - pow(n, beta - 1), 2) * (2 * beta - 1)) * (pow(n / i, 2 * beta - 1) - 1) * (1 - pow(i, beta - 1)) AS links FROM o, k)
"""
)


@catalog.add("hypermap_radii", _GROWTH + "SELECT node_id, CAST(i AS BIGINT) AS i, round(r, 6) AS r, round(r - 2 * ln(1.0 / sin(pi() * 0.5)) - 2 * ln(greatest(integral / links, 1e-12)), 6) AS threshold, round(links, 6) AS links FROM g")
def hypermap_radii(spark, d):
    deg = materialize(graph.degrees(rg(spark, d)))
    s = deg.agg(F.count(F.lit(1)).alias("n"), (F.sum("degree") / 2).cast("bigint").alias("e"), F.min("degree").alias("m")).first()
    c = parameters.growth_constants(s["n"], s["e"], s["m"], 2.5)
    out = parameters.growth_radii(parameters.arrival_order(deg), c)
    return out.select("node_id", "i", *[F.round(x, 6).alias(x) for x in ("r", "threshold", "links")])


@catalog.add(
    "sphere_radial_map",
    _RG
    + """, s AS (SELECT count(*) AS n, avg(degree) AS k, min(degree) AS l FROM deg),
 h AS (SELECT l, 2 * ln(2 * (n / (2 * pi())) / (2.5 * sin(pi() / 2.5) / (2 * pi() * k) * l * l)) AS rh FROM s)
 SELECT node_id, CAST(degree AS DOUBLE) AS kappa, round(rh - 2 * ln(degree / l), 6) AS r, round(rh, 6) AS r_hat FROM deg, h""",
)
def sphere_radial_map(spark, d):
    k = graph.degrees(rg(spark, d)).select("node_id", F.col("degree").cast("double").alias("kappa"))
    return parameters.radial_map(k, 2.5, 1).select("node_id", "kappa", F.round("r", 6).alias("r"), F.round("r_hat", 6).alias("r_hat"))


@catalog.add("powerlaw_gamma_mle", _RG + "SELECT CAST(count(*) AS BIGINT) AS n_tail, round(1 + count(*) / sum(ln(degree / 4.5)), 6) AS gamma FROM deg WHERE degree >= 5")
def powerlaw_gamma_mle(spark, d):
    return parameters.gamma_mle(graph.degrees(rg(spark, d)), 5).withColumn("gamma", F.round("gamma", 6))


@catalog.add(
    "powerlaw_kmin_scan_continuous",
    _RG
    + """, h AS (SELECT CAST(degree AS DOUBLE) AS k, count(*) AS n FROM deg GROUP BY 1), q AS (SELECT quantile_cont(degree, 0.9) AS p90 FROM deg),
 t AS (SELECT c.k AS k_min, h.k, h.n FROM h c JOIN h ON h.k >= c.k JOIN q ON c.k <= p90),
 f AS (SELECT k_min, sum(n) AS nt, 1 + sum(n) / sum(n * ln(k / (k_min - 0.5))) AS gamma FROM t GROUP BY 1 HAVING sum(n) >= 20),
 g AS (SELECT k_min, nt, gamma, n, sum(n) OVER (PARTITION BY k_min ORDER BY k DESC) AS up, pow(k / k_min, -(gamma - 1)) AS model FROM t JOIN f USING (k_min))
 SELECT k_min, CAST(nt AS BIGINT) AS n_tail, round(gamma, 6) AS gamma, round(max(greatest(abs(model - up / nt), abs(model - (up - n + 1) / nt))), 6) AS ks FROM g GROUP BY k_min, nt, gamma""",
)
def powerlaw_kmin_scan_continuous(spark, d):
    return parameters.continuous_scan(materialize(graph.degrees(rg(spark, d)))).withColumn("gamma", F.round("gamma", 6)).withColumn("ks", F.round("ks", 6))


@catalog.add(
    "loglik_vs_exponential",
    _RG + ", t AS (SELECT count(*) AS n, sum(ln(degree / 4.5)) AS s, avg(degree - 5.0) AS m FROM deg WHERE degree >= 5) SELECT CAST(n AS BIGINT) AS n, round(ln(1.5 / 4.5) - 2.5 * s / n + ln(m) + 1, 6) AS ratio FROM t",
)
def loglik_vs_exponential(spark, d):
    return parameters.exponential_ratio(graph.degrees(rg(spark, d)), 5.0, 2.5).withColumn("ratio", F.round("ratio", 6))


@catalog.add("powerlaw_kmin_scan_zeta")
def powerlaw_kmin_scan_zeta(spark, d):
    return parameters.choose_kmin(graph.degrees(rg(spark, d)))


@catalog.add("powerlaw_gof")
def powerlaw_gof(spark, d):
    return parameters.goodness_of_fit(materialize(graph.degrees(rg(spark, d))))


@catalog.add("hyperbolic_rgg", _PAIRS + ", k AS (SELECT (SELECT count(*) FROM emb) * 4 AS m), n AS (SELECT i, j, row_number() OVER (ORDER BY round(d, 9), i, j) AS rn FROM p) SELECT i, j FROM n, k WHERE rn <= m")
def hyperbolic_rgg(spark, d):
    """Random geometric graph: the 4N closest pairs are linked."""
    e = emb(spark, d)
    p = materialize(pairs.polar_distances(e).withColumn("d", F.round("d", 9)))
    return generation.threshold_graph(p, 4 * e.count()).select("i", "j")


@catalog.add("hypermap_temperature")
def hypermap_temperature(spark, d):
    """The temperature at which the places of the vectors fit the graph of their 15 nearest best; arrival by radius."""
    e = emb(spark, d)
    arrival = numbered(e.select("node_id", "r"), [F.asc("r"), F.asc("node_id")], "pos").select("node_id", "pos", (0.5 * F.col("r")).alias("threshold"))
    t = generation.estimate_temperature(pairs.polar_distances(e), arrival, graph.knn_graph_of(e, k=15))
    return spark.createDataFrame([(t,)], "temperature double")


# both directions, and labels or hops that only ever fall
_BOTH = _RG.replace("WITH rg", "WITH RECURSIVE rg") + ", b AS (SELECT src, dst FROM rg UNION ALL SELECT dst, src FROM rg)"
_HOPS = (
    _BOTH
    + """, r(source, node_id, hops) USING KEY (source, node_id) AS (SELECT node_id, node_id, 0 FROM deg
 UNION SELECT r.source, b.dst, min(r.hops) + 1 FROM r JOIN b ON b.src = r.node_id ANTI JOIN recurring.r AS o ON o.source = r.source AND o.node_id = b.dst GROUP BY r.source, b.dst)
"""
)


def components_sql(both: str, nodes: str, name: str = "c") -> str:
    """A recursive table (node_id, component) over the columns src and dst of ``both``."""
    return f"""{name}(node_id, component) USING KEY (node_id) AS (SELECT node_id, node_id FROM {nodes}
 UNION SELECT x.dst, min({name}.component) FROM {name} JOIN {both} x ON x.src = {name}.node_id JOIN recurring.{name} AS o ON o.node_id = x.dst WHERE {name}.component < o.component GROUP BY x.dst)"""


@catalog.add("hop_distances", _HOPS + "SELECT source, CAST(hops AS INTEGER) AS hops, CAST(count(*) AS BIGINT) AS nodes, CAST(sum(node_id) AS BIGINT) AS id_sum FROM r GROUP BY 1, 2")
def hop_distances(spark, d):
    """The hops between all pairs, as the nodes that every node reaches in so many hops: their number and the sum of their ids."""
    return graph.all_hop_distances(rg(spark, d)).groupBy("source", "hops").agg(F.count(F.lit(1)).alias("nodes"), F.sum("node_id").alias("id_sum"))


@catalog.add("connected_components", _BOTH + ", " + components_sql("b", "deg") + " SELECT node_id, component FROM c")
def connected_components(spark, d):
    return graph.connected_components(rg(spark, d))


@catalog.add(
    "giant_component_filter",
    _SPLIT.replace("WITH rg", "WITH RECURSIVE rg")
    + ", b AS (SELECT src, dst FROM sp WHERE part = 'E' UNION ALL SELECT dst, src FROM sp WHERE part = 'E'), n AS (SELECT DISTINCT src AS node_id FROM b), "
    + components_sql("b", "n")
    + """, t AS (SELECT component FROM c GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1), g AS (SELECT node_id FROM c JOIN t USING (component))
 SELECT src, dst, part FROM sp WHERE src IN (SELECT node_id FROM g) AND dst IN (SELECT node_id FROM g)""",
)
def giant_component_filter(spark, d):
    split = materialize(links.split_edges(rg(spark, d)))
    train = links.training_graph(split)
    big = graph.largest_component(train).select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return links.inside_component(split, big).select("src", "dst", "part")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well hyperbolic distance separates pairs with equal labels from the others."""
    c = materialize(label_candidates(spark, sf_dir))
    return ranking.roc_auc(c, higher_is_link=False).crossJoin(ranking.hits_at(c, 20, higher_is_link=False)).crossJoin(ranking.precision_recall_f1(c, higher_is_link=False))


__all__ = ["EMB", "PAIRS", "ROUTE_GRAPH", "TRIANGLES", "catalog", "emb", "flagship", "label_graph", "rg"]
