"""Evaluation drivers: paired splits, metrics per seed and method, correlations, geometry reports, plot tables."""

from __future__ import annotations

import weakref
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horograph.functions import distances
from horograph.functions.charts import polar_to_ball
from horograph.operators import curvature, dense, graph, links, parameters, ranked_pairs, ranking
from horograph.operators.ordering import running_totals
from horograph.runtime import is_small, materialize


def metrics(cands: DataFrame, higher_is_link: bool, bins: int = 10) -> DataFrame:
    """One row: f1, auc, hits@20 and the lift of the first bin."""
    # ranked once for all of them
    c = materialize(ranking.ranked(cands, higher_is_link))
    first = ranking.lift_of(c, bins).where("bin = 0").select(F.col("lift").alias("first_lift"), F.col("positives").alias("captured"))
    rows = c.drop("rn")
    return ranking.precision_of(c).select("f1").crossJoin(ranking.roc_auc(rows, higher_is_link)).crossJoin(ranking.hits_at(rows, 20, higher_is_link)).crossJoin(first)


def prepare_splits(edges: DataFrame, seeds: list[int], q: float = 0.9, giant: bool = False) -> dict[int, DataFrame]:
    """One split per seed, shared by all methods; with ``giant`` only pairs inside the largest component of the training graph."""
    out = {}
    for seed in seeds:
        split = links.split_edges(edges, q, seed)
        if giant:
            members = graph.largest_component(links.training_graph(split)).select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
            split = links.inside_component(split, materialize(members))
        out[seed] = materialize(split)
    return out


#: Candidates of the splits in use, so that methods on one split share them.
_KNOWN: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _candidates(split: DataFrame) -> DataFrame:
    if split not in _KNOWN:
        nodes = split.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
        _KNOWN[split] = materialize(links.candidates(split, nodes))
    return _KNOWN[split]


def evaluate(splits: dict[int, DataFrame], method: str, score: Callable[[DataFrame, DataFrame], DataFrame], higher_is_link: bool = False) -> DataFrame:
    """(method, seed, f1, auc, hits, first_lift, captured).

    ``score(train, candidates)`` returns the candidates (src, dst) with ``score``;
    those it leaves out, such as nodes without a training edge, count as the worst.
    ``PointScores`` are ranked without a table of the candidates.
    """
    if isinstance(score, PointScores) and splits and (ends := {s: _ends(split) for s, split in splits.items()}) and all(e is not None and len(e[0]) * score.dim <= HELD for e in ends.values()):
        return _evaluate_points(splits, ends, method, score, higher_is_link)
    out, worst = None, F.lit(float("-inf") if higher_is_link else float("inf"))
    for seed, split in splits.items():
        train = materialize(graph.unweighted(links.training_graph(split)))
        c = _candidates(split)
        known = score(train, c).select("src", "dst", "score", F.lit(True).alias("known"))
        value = F.when(F.col("known"), F.col("score")).otherwise(worst)
        scored = c.join(known, ["src", "dst"], "left").select(F.xxhash64("src", "dst").alias("cand_id"), value.alias("score"), "is_positive")
        row = metrics(scored, higher_is_link).select(F.lit(method).alias("method"), F.lit(seed).alias("seed"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def summary(results: DataFrame) -> DataFrame:
    cols = ("f1", "auc", "hits", "first_lift")
    return results.groupBy("method").agg(F.count(F.lit(1)).alias("seeds"), *[F.avg(c).alias(f"{c}_mean") for c in cols], *[F.stddev_pop(c).alias(f"{c}_std") for c in cols])


def compare(edges: DataFrame, methods: dict[str, tuple[Callable[[DataFrame, DataFrame], DataFrame], bool]], seeds: list[int], q: float = 0.9, giant: bool = False) -> DataFrame:
    """The results of several methods on the same splits; ``methods``: name -> (score, whether a high score means a link)."""
    splits, out = prepare_splits(materialize(edges), seeds, q, giant), None
    for name, (score, higher) in methods.items():
        rows = evaluate(splits, name, score, higher)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("there are no methods to compare")
    return out


def ladder(graphs: dict[str, DataFrame], methods: dict[str, tuple[Callable[[DataFrame, DataFrame], DataFrame], bool]], hyperbolic: str, baseline: str, seeds: list[int], metric: str = "auc") -> DataFrame:
    """One row per graph: the geometry it shows (mean delta over diameter, curvature) and what ``hyperbolic`` gains over ``baseline`` on it."""
    out = None
    for name, edges in graphs.items():
        gain = advantage(materialize(compare(edges, {m: methods[m] for m in (hyperbolic, baseline)}, seeds, giant=True)), hyperbolic, baseline, metric)
        d = diagnose(edges, 5_000, 100).select((F.col("mean_delta") / F.greatest("diameter", F.lit(1.0))).alias("delta"), "ricci_mean", "verdict")
        row = gain.crossJoin(F.broadcast(d)).select(F.lit(name).alias("graph"), "*")
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("there are no graphs to compare")
    return out


def advantage(results: DataFrame, method: str, baseline: str, metric: str = "auc") -> DataFrame:
    """Paired by seed: mean and deviation of the gain of ``method`` over ``baseline``, and its wins."""
    a = results.where(F.col("method") == method).select("seed", F.col(metric).alias("a"))
    b = results.where(F.col("method") == baseline).select("seed", F.col(metric).alias("b"))
    g = a.join(b, "seed").withColumn("gain", F.col("a") - F.col("b"))
    return g.agg(F.count(F.lit(1)).alias("pairs"), F.avg("gain").alias("mean_gain"), F.stddev_pop("gain").alias("std_gain"), F.sum((F.col("gain") > 0).cast("int")).alias("wins"))


def embedding_scores(embedder) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Distance of the fitted points as the score of a candidate."""
    from horograph.operators.pairs import gathered_polar

    def score(train: DataFrame, cands: DataFrame) -> DataFrame:
        e = embedder.fit(train).coordinates
        return gathered_polar(cands.select(F.col("src").alias("i"), F.col("dst").alias("j")), e).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("d").alias("score"))

    return score


#: Up to so many coordinates and removed edges of a split are held by the driver and each task; beyond, the candidates are written.
HELD = 20_000_000
#: (sorted nodes, ends of the removed edges) of the splits in use; None where they are more than ``HELD``.
_ENDS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _ends(split: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    if split not in _ENDS:
        nodes = split.select(F.explode(F.array(F.col("src").cast("bigint"), F.col("dst").cast("bigint"))).alias("node_id")).where("node_id IS NOT NULL").distinct()
        removed = split.where(F.col("part") == "R").select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))
        _ENDS[split] = None
        if is_small(removed, HELD) and is_small(nodes, HELD):
            t = removed.toArrow()
            _ENDS[split] = np.sort(nodes.toArrow().column("node_id").to_numpy()), t.column("src").to_numpy(), t.column("dst").to_numpy()
    return _ENDS[split]


@dataclass(frozen=True)
class PointScores:
    """Scores that are signed dot products of points in ``dim`` dimensions; ``points(train)``: (node_id, x, signs)."""

    dim: int
    points: Callable[[DataFrame], DataFrame]

    def __call__(self, train: DataFrame, cands: DataFrame) -> DataFrame:
        x = materialize(self.points(train))
        a = x.select(F.col("node_id").alias("src"), F.col("x").alias("p"), "signs")
        b = x.select(F.col("node_id").alias("dst"), F.col("x").alias("q"))
        dot = F.aggregate(F.zip_with(F.zip_with("p", "q", lambda u, v: u * v), "signs", lambda u, s: u * s), F.lit(0.0), lambda s, v: s + v)
        return cands.select("src", "dst").join(a, "src").join(b, "dst").select("src", "dst", dot.alias("score"))


def _evaluate_points(splits: dict[int, DataFrame], ends: dict[int, tuple], method: str, score: PointScores, higher_is_link: bool) -> DataFrame:
    spark, points = next(iter(splits.values())).sparkSession, None
    for seed, split in splits.items():
        own = score.points(graph.unweighted(links.training_graph(split))).select(F.lit(seed).alias("seed"), "node_id", "x", "signs")
        points = own if points is None else points.unionByName(own)
    # the points of all splits in one job
    t = points.toArrow()
    of, nodes, held = t.column("seed").to_numpy(), t.column("node_id").to_numpy(), {}
    x, signs = (t.column(c).combine_chunks().flatten().to_numpy().reshape(len(nodes), -1) for c in ("x", "signs"))
    for seed in splits:
        k = np.flatnonzero(of == seed)
        held[seed] = ranked_pairs.Held.of(*ends[seed], nodes[k], x[k], signs[k[0]] if len(k) else np.zeros(x.shape[1]), higher_is_link)
    found = ranked_pairs.metrics(held, splits)
    return spark.createDataFrame([(method, seed, *found[seed]) for seed in splits], "method string, seed int, f1 double, auc double, hits double, first_lift double, captured bigint")


def spectral_scores(dim: int = 8) -> PointScores:
    """Signed dot products of the adjacency spectral embedding."""
    return PointScores(dim, lambda train: dense.adjacency_spectral(train, dim))


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: Pearson, and Spearman by mid-ranks."""
    c = materialize(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))

    def mid(col: str) -> DataFrame:
        h = c.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
        t = running_totals(h, [F.asc(col)], {"below": F.col("n")})
        return t.select(col, (F.col("below") + (F.col("n") + 1) / 2).alias(f"r{col}"))

    return c.join(mid("x"), "x").join(mid("y"), "y").agg(F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"))


def diagnose(edges: DataFrame, quadruples: int = 20_000, ricci_edges: int = 500, seed: int = 0) -> DataFrame:
    """One row: structure, delta, curvature and tail of a graph, four signals and the verdict."""
    e = materialize(edges)
    s = graph.degree_and_clustering(e)
    h = curvature.mean_hyperbolicity(graph.largest_component(e), quadruples, seed)
    r = curvature.ricci_curvature(e, ricci_edges, seed).select(F.col("mean").alias("ricci_mean"), F.col("negative").alias("ricci_negative"))
    deg = materialize(graph.degrees(e))
    best = parameters.continuous_scan(deg).orderBy("ks", "k_min").first()
    fit = {"k_min": None, "gamma": None, "ks": None, "ratio": None}
    if best is not None:
        fit = {k: best[k] for k in ("k_min", "gamma", "ks")} | {"ratio": parameters.exponential_ratio(deg, best["k_min"], best["gamma"]).first()["ratio"]}
    row = s.crossJoin(h).crossJoin(r).select("*", *[F.lit(v).cast("double").alias(k) for k, v in fit.items()])
    no = F.lit(False)
    # Bounds of the four signals: fixed values.
    signals = {
        "sparse_and_clustered": (F.col("mean_degree") < 0.1 * F.col("nodes")) & (F.col("average_clustering") > 5 * F.col("mean_degree") / F.col("nodes")),
        "heterogeneous_degree": F.coalesce((F.col("gamma") > 1.5) & (F.col("gamma") < 3.5) & (F.col("ratio") > -0.05), no),
        "tree_like_metric": F.when(F.col("diameter") > 0, F.col("mean_delta") / F.col("diameter") < 0.2).otherwise(no),
        "negative_curvature": F.coalesce(F.col("ricci_mean") < 0, no),
    }
    score = sum((c.cast("int") for c in signals.values()), F.lit(0))
    verdict = F.when(score >= 3, "hyperbolic").when(score <= 1, "euclidean").otherwise("ambiguous")
    return row.select("*", *[c.alias(n) for n, c in signals.items()], score.alias("score"), verdict.alias("verdict"))


def disk_coordinates(nodes: DataFrame, radius: str = "r", angle: str = "theta", top: float = 0.97) -> DataFrame:
    """(node_id, x, y) for drawing: radii rescaled to [0, top], angles kept."""
    span = nodes.agg(F.min(radius).alias("lo"), F.max(radius).alias("hi"))
    rho = F.when(F.col("hi") > F.col("lo"), top * (F.col(radius) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return nodes.crossJoin(F.broadcast(span)).select("node_id", (rho * F.cos(angle)).alias("x"), (rho * F.sin(angle)).alias("y"))


def plot_edges(edges: DataFrame, coordinates: DataFrame, unknown: DataFrame | None = None) -> DataFrame:
    """(src, dst, x1, y1, x2, y2, known): segments in the disk, ready to draw."""
    x = polar_to_ball(F.col("r"), F.col("v"))
    at = coordinates.select("node_id", x[0].alias("x"), x[1].alias("y"))
    rows = edges.select("src", "dst").withColumn("known", F.lit(True))
    if unknown is not None:
        rows = rows.join(unknown.select("src", "dst"), ["src", "dst"], "left_anti").unionByName(unknown.select("src", "dst").withColumn("known", F.lit(False)))
    a = at.select(F.col("node_id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = at.select(F.col("node_id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return rows.join(a, "src").join(b, "dst").select("src", "dst", "x1", "y1", "x2", "y2", "known")


def chart_errors(spark: SparkSession, radii: list[float], step: float = 1.0) -> DataFrame:
    """(r, polar, ball, hyperboloid): relative error of each chart for two points ``step`` apart at radius r on one ray."""
    df = spark.createDataFrame([(float(r),) for r in radii], "r double")
    v = F.array(F.lit(1.0), F.lit(0.0))
    s = F.col("r") + step
    ball = distances.ball(polar_to_ball(F.col("r"), v), polar_to_ball(s, v))
    h = lambda x: F.array(F.cosh(x), F.sinh(x), F.lit(0.0))
    err = lambda d: F.abs(d / step - 1)
    return df.select("r", err(distances.polar(F.col("r"), v, s, v)).alias("polar"), err(ball).alias("ball"), err(distances.hyperboloid(h(F.col("r")), h(s))).alias("hyperboloid"))


__all__ = ["PointScores", "advantage", "chart_errors", "compare", "correlations", "diagnose", "disk_coordinates", "embedding_scores", "evaluate", "ladder", "metrics", "plot_edges", "prepare_splits", "spectral_scores", "summary"]
