"""Metrics of ranked candidates: precision, recall and F1 at k, ROC AUC, Hits@K, lift.

Candidates have ``cand_id``, ``score`` and ``is_positive``.  Infinite scores are
legal, NaN and null scores raise.  Ties are ordered by ``cand_id``, in reverse
where a high score means a link, as a reversed stable sort would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from horograph.operators.ordering import numbered, running_totals


def checked(cands: DataFrame) -> DataFrame:
    score = F.col("score").cast("double")
    bad = score.isNull() | F.isnan(score)
    return cands.select("cand_id", F.when(bad, F.raise_error(F.lit("scores must be numbers")).cast("double")).otherwise(score).alias("score"), F.col("is_positive").cast("boolean").alias("is_positive"))


def _order(higher_is_link: bool) -> list[Column]:
    return [F.desc("score"), F.desc("cand_id")] if higher_is_link else [F.asc("score"), F.asc("cand_id")]


def ranked(cands: DataFrame, higher_is_link: bool = True) -> DataFrame:
    return numbered(checked(cands), _order(higher_is_link))


def precision_recall_f1(cands: DataFrame, k: int | None = None, higher_is_link: bool = True) -> DataFrame:
    """One row: k, hits, precision, recall, f1; without ``k`` the number of positives; 0 where undefined."""
    return precision_of(ranked(cands, higher_is_link), k)


def precision_of(r: DataFrame, k: int | None = None) -> DataFrame:
    """``precision_recall_f1`` of candidates that are ranked already."""
    positives = r.agg(F.sum(F.col("is_positive").cast("bigint")).alias("positives"))
    cut = F.col("positives") if k is None else F.lit(k).cast("bigint")
    hits = r.join(F.broadcast(positives)).agg(
        F.coalesce(F.max(cut), F.lit(0)).alias("k"),
        F.coalesce(F.max("positives"), F.lit(0)).alias("positives"),
        F.coalesce(F.sum(F.when((F.col("rn") <= cut) & F.col("is_positive"), 1).otherwise(0)), F.lit(0)).cast("bigint").alias("hits"),
        F.coalesce(F.sum(F.when(F.col("rn") <= cut, 1).otherwise(0)), F.lit(0)).cast("bigint").alias("taken"),
    )
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, q = div(F.col("hits"), F.col("taken")), div(F.col("hits"), F.col("positives"))
    return hits.select("k", "hits", p.alias("precision"), q.alias("recall"), div(2 * p * q, p + q).alias("f1"))


def roc_auc(cands: DataFrame, higher_is_link: bool = True) -> DataFrame:
    """One row ``auc``: Mann-Whitney with mid-ranks; raises without both classes."""
    sign = 1 if higher_is_link else -1
    hist = checked(cands).groupBy((F.col("score") * sign).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_positive").cast("bigint")).alias("pos"))
    t = running_totals(hist, [F.asc("s")], {"below": F.col("n")})
    sums = t.agg(F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2)).alias("ranks"), F.sum("pos").cast("double").alias("np"), F.sum(F.col("n") - F.col("pos")).cast("double").alias("nn"))
    one = (F.col("np") == 0) | (F.col("nn") == 0) | F.col("np").isNull()
    value = (F.col("ranks") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * F.col("nn"))
    return sums.select(F.when(one, F.raise_error(F.lit("AUC needs both classes")).cast("double")).otherwise(value).alias("auc"))


def hits_at(cands: DataFrame, k: int = 20, higher_is_link: bool = True) -> DataFrame:
    """One row ``hits``: the share of positives that score above the k-th best negative."""
    c = checked(cands).withColumn("s", F.col("score") * (1 if higher_is_link else -1))
    kth = c.where(~F.col("is_positive")).orderBy(F.desc("s")).limit(k).agg(F.min("s").alias("kth"), F.count(F.lit(1)).alias("n"))
    above = F.when((F.col("n") < k) | (F.col("s") > F.col("kth")), 1.0).otherwise(0.0)
    return c.where("is_positive").crossJoin(F.broadcast(kth)).agg(F.coalesce(F.avg(above), F.lit(0.0)).alias("hits"))


def lift_curve(cands: DataFrame, bins: int = 10, higher_is_link: bool = True) -> DataFrame:
    """(bin, n, positives, rate, lift): bins of floor(n / bins) candidates, the last one takes the rest."""
    return lift_of(ranked(cands, higher_is_link), bins)


def lift_of(r: DataFrame, bins: int = 10) -> DataFrame:
    """``lift_curve`` of candidates that are ranked already."""
    all_ = r.agg(F.count(F.lit(1)).alias("all"), F.sum(F.col("is_positive").cast("bigint")).alias("all_pos"))
    size = F.greatest(F.lit(1), F.floor(F.col("all") / bins))
    place = F.least(F.floor((F.col("rn") - 1) / size), F.lit(bins - 1)).cast("int")
    per = r.crossJoin(F.broadcast(all_)).groupBy(place.alias("bin"), "all", "all_pos").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_positive").cast("bigint")).alias("positives"))
    base = F.col("all_pos") / F.col("all")
    rate = F.col("positives") / F.col("n")
    return per.select("bin", "n", "positives", rate.alias("rate"), F.when(base > 0, rate / base).otherwise(0.0).alias("lift"))
