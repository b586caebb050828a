"""Classification of nodes by the labels of their nearest neighbours in hyperbolic space.

Every node is classified once, in its own fold, by nodes of the other folds.
Folds are drawn inside each label by numbering the nodes in the order of label
and hash, so every fold holds about the same share of each label.  Nodes with a
null id, coordinate or label take no part; ties of distance go to the smaller
id, ties of votes to the smaller label; fewer than ``k`` training nodes vote as
many as there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from horograph.operators.ordering import numbered
from horograph.operators.pairs import Kernel, nearest_in_tiles, polar_kernel
from horograph.runtime import materialize


def stratified_folds(nodes: DataFrame, folds: int = 5, seed: int = 0) -> DataFrame:
    """``nodes`` (node_id, label, ...) with ``fold`` from 0."""
    hashed = nodes.withColumn("__h", F.xxhash64("node_id", F.lit(seed)))
    placed = numbered(hashed, [F.asc("label"), F.asc("__h"), F.asc("node_id")], "__n")
    return placed.withColumn("fold", ((F.col("__n") - 1) % folds).cast("int")).drop("__h", "__n")


def knn_predictions(nodes: DataFrame, k: int = 5, kernel: Kernel = polar_kernel, digits: int | None = None) -> DataFrame:
    """(node_id, fold, label, predicted) of nodes (node_id, r, v, label, fold)."""
    known = materialize(nodes.where(F.col("label").isNotNull() & F.col("fold").isNotNull()).select("node_id", "r", "v", "label", "fold"))
    near = nearest_in_tiles(known, kernel, k, group="fold", digits=digits)
    votes = near.join(known.select(F.col("node_id").alias("b"), F.col("label").alias("vote")), "b").groupBy("a", "vote").agg(F.count(F.lit(1)).alias("n"))
    first = votes.withColumn("o", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "vote"))).where(F.col("o") == 1)
    return first.select(F.col("a").alias("node_id"), F.col("vote").alias("predicted")).join(known.select("node_id", "fold", "label"), "node_id").select("node_id", "fold", "label", "predicted")


def scores(predictions: DataFrame, by_fold: bool = False) -> DataFrame:
    """accuracy, f1 (weighted by the size of the labels, 0 where undefined), nodes and classes; one row, or one per fold."""
    keys = ["fold"] if by_fold else []
    p = predictions if by_fold else predictions.drop("fold")
    ends = F.explode(F.array(F.struct(F.col("label").alias("c"), F.lit(1).alias("is"), F.lit(0).alias("said")), F.struct(F.col("predicted").alias("c"), F.lit(0).alias("is"), F.lit(1).alias("said"))))
    hit = (F.col("label") == F.col("predicted")).cast("int")
    per = p.select(*keys, "label", hit.alias("hit"), ends.alias("e")).groupBy(*keys, "e.c").agg(F.sum("e.is").alias("size"), F.sum("e.said").alias("said"), F.sum(F.col("e.is") * F.col("hit")).alias("hits"))
    f1 = F.when(F.col("size") + F.col("said") > 0, 2 * F.col("hits") / (F.col("size") + F.col("said"))).otherwise(0.0)
    all_ = F.sum("size")
    return per.groupBy(*keys).agg((F.sum("hits") / all_).alias("accuracy"), (F.sum(f1 * F.col("size")) / all_).alias("f1"), all_.alias("nodes"), F.sum((F.col("size") > 0).cast("bigint")).alias("classes"))
