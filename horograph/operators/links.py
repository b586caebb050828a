"""Link prediction: splits, candidates, decoders, losses and imputation of unknown edges.

Splits are drawn by a hash of the pair, so they need no random state and every
engine can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from horograph.functions import distances
from horograph.operators.ordering import quantile
from horograph.operators.pairs import gather, pairs_without

# Multipliers of the pair hash: fixed values.
HASH_A, HASH_B, HASH_SEED = 2654435761, 40503, 97


def pair_hash(i: Column, j: Column, seed: int, modulus: int = 1000) -> Column:
    return F.pmod(i * F.lit(HASH_A).cast("bigint") + j * F.lit(HASH_B) + F.lit(seed * HASH_SEED), F.lit(modulus))


def split_edges(edges: DataFrame, q: float = 0.9, seed: int = 0) -> DataFrame:
    """Edges with ``part`` E (kept for training) or R (removed)."""
    kept = pair_hash(F.col("src"), F.col("dst"), seed) < int(round(1000 * q))
    return edges.withColumn("part", F.when(kept, "E").otherwise("R"))


def non_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst) of all pairs of nodes that are no edge: an output of quadratic size."""
    return pairs_without(nodes, edges.select(F.col("src").alias("i"), F.col("dst").alias("j"))).select(F.col("i").alias("src"), F.col("j").alias("dst"))


def candidates(split: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, is_positive): the removed edges and all non-edges."""
    removed = split.where(F.col("part") == "R").select("src", "dst", F.lit(True).alias("is_positive"))
    return removed.unionByName(non_edges(split, nodes).withColumn("is_positive", F.lit(False)))


def training_graph(split: DataFrame) -> DataFrame:
    return split.where(F.col("part") == "E").drop("part")


def inside_component(split: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs whose two ends are in ``members`` (node_id)."""
    a, b = members.select(F.col("node_id").alias("src")), members.select(F.col("node_id").alias("dst"))
    return split.join(a, "src", "left_semi").join(b, "dst", "left_semi")


def candidate_scores(cands: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores (i, j, score) looked up for every candidate, whatever the order of its ends."""
    table = scores.select(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst"), "score")
    return cands.join(table, ["src", "dst"], "left")


# decoders on pair distances (i, j, d)


def decode_fermi_dirac(pairs: DataFrame, r: float | None = None, t: float = 1.0) -> DataFrame:
    """Link probabilities; ``r`` defaults to the median distance."""
    if r is None:
        r = quantile(pairs, "d", 0.5) or 0.0
    return pairs.withColumn("p", distances.fermi_dirac(F.col("d"), r, t))


def decode_younger(pairs: DataFrame, arrival: DataFrame, zeta: float = 1.0, temperature: float = 0.5) -> DataFrame:
    """Probabilities with the threshold radius of the end that arrived later; ``arrival``: (node_id, pos, threshold)."""
    g = gather(pairs, arrival, ["pos", "threshold"])
    later = F.when(F.col("pos_j") > F.col("pos_i"), F.col("threshold_j")).otherwise(F.col("threshold_i"))
    return g.withColumn("p", distances.sigmoid((later - F.col("d")) * (zeta / (2 * temperature)))).drop("pos_i", "pos_j", "threshold_i", "threshold_j")


def decode_sphere(pairs: DataFrame, beta: float, r_hat: float) -> DataFrame:
    return pairs.withColumn("p", distances.sigmoid((F.lit(r_hat) - F.col("d")) * (beta / 2)))


def decode_softmin(pairs: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(i, j, p): softmax of -d / gamma over j for each i, the pair of a node with itself included."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("i").alias("i"), F.col("j").alias("j")), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("e"), F.exp(-F.col("d") / gamma).alias("w")).select("e.i", "e.j", "w")
    total = both.groupBy("i").agg((F.sum("w") + 1.0).alias("total"))
    own = total.select("i", F.col("i").alias("j"), F.lit(1.0).alias("w"))
    return both.unionByName(own).join(total, "i").select("i", "j", (F.col("w") / F.col("total")).alias("p"))


# losses


def _observed(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    e = edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1.0).alias("a"))
    return pairs.join(e, ["i", "j"], "left").withColumn("a", F.coalesce("a", F.lit(0.0)))


def cross_entropy(probabilities: DataFrame, edges: DataFrame, eps: float = distances.FLOOR) -> DataFrame:
    """One row ``nll``: over i < j, probabilities clamped."""
    p = distances.clamp(F.col("p"), eps)
    o = _observed(probabilities, edges)
    return o.agg(F.coalesce(F.sum(-(F.col("a") * F.log(p) + (1 - F.col("a")) * F.log(1 - p))), F.lit(0.0)).alias("nll"))


def sphere_nll(pairs: DataFrame, edges: DataFrame, beta: float, r_hat: float) -> DataFrame:
    """The same for the sphere model in its overflow-safe form."""
    z = (beta / 2) * (F.lit(r_hat) - F.col("d"))
    o = _observed(pairs, edges)
    return o.agg(F.coalesce(F.sum(-F.when(F.col("a") > 0, distances.log_sigmoid(z)).otherwise(distances.log_sigmoid(-z))), F.lit(0.0)).alias("nll"))


def ranking_nll(pairs: DataFrame, edges: DataFrame, eps: float = distances.FLOOR) -> DataFrame:
    """Soft ranking loss with every non-neighbour as a negative; each edge counts from both ends."""
    o = _observed(pairs, edges)
    both = o.select(F.explode(F.array("i", "j")).alias("i"), "d", "a")
    w = F.exp(-F.col("d"))
    negative = both.where(F.col("a") == 0).groupBy("i").agg(F.sum(w).alias("neg"))
    pos = both.where(F.col("a") > 0).join(negative, "i", "left")
    return pos.agg(F.coalesce(F.sum(F.col("d") + F.log(w + F.coalesce("neg", F.lit(0.0)) + eps)), F.lit(0.0)).alias("nll"))


def stress(pairs: DataFrame, targets: DataFrame, scale: float = 1.0) -> DataFrame:
    """One row: ``loss``, the sum of squared gaps between d and the target distance, and ``stress``, its root."""
    gap = F.col("d") - F.col("target") * scale
    return pairs.join(targets.select("i", "j", F.col("d").alias("target")), ["i", "j"]).agg(F.coalesce(F.sum(gap * gap), F.lit(0.0)).alias("loss")).withColumn("stress", F.sqrt("loss"))


def symmetric_kl(decoded: DataFrame, similarity: DataFrame, eps: float = distances.FLOOR) -> DataFrame:
    """Sum over ordered pairs of the symmetric divergence of (i, j, p) and (i, j, q)."""
    p, q = F.greatest(F.col("p"), F.lit(eps)), F.greatest(F.coalesce("q", F.lit(0.0)), F.lit(eps))
    return decoded.join(similarity, ["i", "j"], "left").agg(F.sum((p - q) * (F.log(p) - F.log(q))).alias("loss"))


# imputation


def two_cluster_threshold(pairs: DataFrame, edges: DataFrame, unknown: DataFrame | None = None) -> DataFrame:
    """Mean distance of linked and of other known pairs, and their midpoint; only weight 1 is a link."""
    e = edges.where(F.col("weight") == 1).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1).alias("a"))
    known = pairs if unknown is None else pairs.join(unknown.select(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")), ["i", "j"], "left_anti")
    m = known.join(e, ["i", "j"], "left").agg(F.avg(F.when(F.col("a") == 1, F.col("d"))).alias("linked"), F.avg(F.when(F.col("a").isNull(), F.col("d"))).alias("unlinked"))
    return m.withColumn("threshold", (F.col("linked") + F.col("unlinked")) / 2)


def unknown_weights(edges: DataFrame, unknown: DataFrame, nodes: int) -> DataFrame:
    """(src, dst, w_init): mean of the row means of both ends over their known entries, the diagonal included."""
    known = edges.join(unknown.select("src", "dst"), ["src", "dst"], "left_anti")
    end = lambda df, v: df.select(F.explode(F.array("src", "dst")).alias("node_id"), v.alias("v")).groupBy("node_id").agg(F.sum("v").alias("v"))
    total = end(known, F.col("weight")).withColumnRenamed("v", "total")
    hidden = end(unknown, F.lit(1)).withColumnRenamed("v", "hidden")
    mean = hidden.join(total, "node_id", "left").select("node_id", (F.coalesce("total", F.lit(0.0)) / (nodes - F.col("hidden"))).alias("m"))
    a, b = mean.select(F.col("node_id").alias("src"), F.col("m").alias("ma")), mean.select(F.col("node_id").alias("dst"), F.col("m").alias("mb"))
    return unknown.select("src", "dst").join(a, "src").join(b, "dst").select("src", "dst", ((F.col("ma") + F.col("mb")) / 2).alias("w_init"))


def known_adjacency(edges: DataFrame, unknown: DataFrame, estimates: DataFrame | None = None) -> DataFrame:
    """Edges without the unknown pairs, or with the current estimates (src, dst, w) in their place."""
    known = edges.select("src", "dst", "weight").join(unknown.select("src", "dst"), ["src", "dst"], "left_anti")
    return known if estimates is None else known.unionByName(estimates.select("src", "dst", F.col("w").alias("weight")))


def imputation_results(unknown: DataFrame, edges: DataFrame, weights: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(src, dst, actual, predicted, weight) for every unknown pair; ``weights``: (src, dst, w)."""
    e = edges.select("src", "dst", F.lit(1).alias("a"))
    return unknown.select("src", "dst").join(e, ["src", "dst"], "left").join(weights.select("src", "dst", "w"), ["src", "dst"], "left").select("src", "dst", F.coalesce("a", F.lit(0)).alias("actual"), (F.col("w") > threshold).cast("int").alias("predicted"), F.col("w").alias("weight"))


def distance_results(unknown: DataFrame, edges: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(src, dst, actual, predicted, distance): predicted where the distance is below the threshold."""
    e = edges.select("src", "dst", F.lit(1).alias("a"))
    d = pairs.select(F.col("i").alias("src"), F.col("j").alias("dst"), "d")
    return unknown.select("src", "dst").join(e, ["src", "dst"], "left").join(d, ["src", "dst"], "left").select("src", "dst", F.coalesce("a", F.lit(0)).alias("actual"), (F.col("d") < threshold).cast("int").alias("predicted"), F.col("d").alias("distance"))


# negatives


def negative_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, negatives): how many nodes each node could draw as a negative."""
    n = nodes.select("node_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    deg = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))
    out = nodes.select("node_id").distinct().join(deg, "node_id", "left").crossJoin(F.broadcast(n))
    return out.select("node_id", (F.col("n") - 1 - F.coalesce("degree", F.lit(0))).cast("bigint").alias("negatives"))


def similarity_negatives(edges: DataFrame, nodes: int) -> DataFrame:
    """(src, dst, negatives) per directed edge: nodes whose similarity to ``src`` is below that of ``dst``.

    Nodes without an edge to ``src`` have similarity 0; among its neighbours the
    rank of the weight counts the smaller ones.
    """
    both = edges.where(F.col("weight") > 0).select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("e"), "weight").select("e.a", "e.b", "weight")
    per = both.groupBy("a", "weight").agg(F.count(F.lit(1)).alias("n"))
    below = per.withColumn("below", F.coalesce(F.sum("n").over(Window.partitionBy("a").orderBy("weight").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    deg = per.groupBy("a").agg(F.sum("n").alias("degree"))
    return both.join(below, ["a", "weight"]).join(deg, "a").select(F.col("a").alias("src"), F.col("b").alias("dst"), (F.col("below") + nodes - 1 - F.col("degree")).cast("bigint").alias("negatives"))
