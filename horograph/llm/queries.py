"""Queries of the operators for training data (problems 2, 3, 6, 7 and 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horograph.llm import cooccurrence, leaks, mixing, neighbors, subjects
from horograph.plans.catalog import Catalog
from horograph.runtime import table

catalog = Catalog()


@catalog.add("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.neighbor_pairs(neighbors.nearest(table(spark, sf_dir, "node_vectors")))


@catalog.add("p2_nearest")
def p2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.nearest(table(spark, sf_dir, "node_vectors"))


@catalog.add("p2_recall")
def p2_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recall, and what it took: cells, probes and the share of the collection scored for a vector."""
    rows = table(spark, sf_dir, "node_vectors")
    index = neighbors.build(rows)
    if index is None:
        return spark.createDataFrame([], "asked bigint, recall double, cells int, probes int, share double")
    p = index.profile()
    return neighbors.recall(index.nearest(), rows, "vec_id", "x", 16, 10).select("asked", "recall", *[F.lit(p[c]).alias(c) for c in ("cells", "probes", "share")])


@catalog.add(
    "p2_recall_holds",
    """SELECT CAST(count(*) AS BIGINT) AS asked, TRUE AS enough FROM node_vectors
 WHERE vec_id % 20 = 0 AND len(x) = 16 AND len(list_filter(x, lambda v: v IS NOT NULL AND isfinite(v))) = 16 AND list_sum(list_transform(x, lambda v: v * v)) < 1""",
)
def p2_recall_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether 19 in 20 of the true neighbours are found, by brute force for every vector whose id is divisible by 20."""
    return p2_recall(spark, sf_dir).select("asked", (F.col("recall") >= 0.95).alias("enough"))


_CN = """
WITH e AS (SELECT DISTINCT net_id, src AS a, dst AS b FROM network_edges WHERE net_id IS NOT NULL AND src <> dst
           UNION SELECT net_id, dst, src FROM network_edges WHERE net_id IS NOT NULL AND src <> dst),
n AS (SELECT net_id, a, count(*) AS k FROM e GROUP BY 1, 2),
s AS (SELECT net_id, count(*) AS nodes FROM n GROUP BY 1),
c AS (SELECT x.net_id, x.b AS node_a, y.b AS node_b, count(*) AS n_both FROM e x JOIN e y ON x.net_id = y.net_id AND x.a = y.a AND x.b < y.b GROUP BY 1, 2, 3 HAVING count(*) >= 8),
f AS (SELECT c.net_id, node_a, node_b, CAST(n_both AS BIGINT) AS empirical_cn, CAST(p.k AS BIGINT) AS n_a, CAST(q.k AS BIGINT) AS n_b, CAST(nodes AS BIGINT) AS nodes
      FROM c JOIN n p ON p.net_id = c.net_id AND p.a = node_a JOIN n q ON q.net_id = c.net_id AND q.a = node_b JOIN s ON s.net_id = c.net_id
      WHERE n_both * nodes >= 3 * p.k * q.k)
"""


@catalog.add("p3_found", _CN + "SELECT net_id, node_a, node_b FROM f")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.cooccurring(table(spark, sf_dir, "network_edges")).select("net_id", "node_a", "node_b")


@catalog.add("p3_pairs", _CN + "SELECT net_id, node_a, node_b, empirical_cn, n_a, n_b, nodes, round(empirical_cn * nodes / (n_a * n_b), 6) AS ratio FROM f")
def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.cooccurring(table(spark, sf_dir, "network_edges")).withColumn("ratio", F.round("ratio", 6))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@catalog.add("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


@catalog.add("p6_items")
def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test items that leaked, with the number of documents and the largest share found."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("share").alias("largest_share"))


@catalog.add("p6_spans")
def p6_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.removal_spans(_leaks(spark, sf_dir))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


# words and marks stand for tokens: any usual tokenizer gives the same sources
_SHORT = r"""
WITH d AS (SELECT lower(trim(source, ' ')) AS source, len(regexp_extract_all(text, '\w+|[^\w\s]')) AS n FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
s AS (SELECT source, sum(n) AS n FROM d GROUP BY 1),
m AS (SELECT t.source, coalesce(s.n, 0) * max_repeats < target_share * (SELECT sum(n) FROM d) AS falls_short FROM mix_targets t LEFT JOIN s ON s.source = lower(trim(t.source, ' ')))
"""


@catalog.add("p7_found", _SHORT + "SELECT source FROM m WHERE falls_short")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1].where("falls_short").select("source")


@catalog.add("p7_shares", _SHORT + "SELECT source, falls_short, TRUE AS within_cap, TRUE AS on_target FROM m")
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the drawn rows say about each source, against its target, its cap and what landing may cost."""
    return _mix(spark, sf_dir)[1].select("source", "falls_short", "within_cap", "on_target")


@catalog.add("p7_report")
def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


@catalog.add("p7_mix")
def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return subjects.classify(docs, subjects.learn(docs, table(spark, sf_dir, "doc_subjects"), table(spark, sf_dir, "subjects")))


@catalog.add("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "doc_subjects").where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return _areas(spark, sf_dir).join(labelled, "doc_id", "left_anti").select("doc_id", "subject")


@catalog.add("p8_accuracy")
def p8_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall on labelled documents that the terms and thresholds were fitted without; some labels are wrong."""
    rows = subjects.held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_subjects"), table(spark, sf_dir, "subjects"))
    div = lambda a, b: a / b if b else None
    return spark.createDataFrame([(c, n, div(both, given), div(both, true)) for c, n, given, true, both in rows], "by_claims boolean, documents bigint, precision double, recall double")


@catalog.add("p8_composition")
def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.composition(table(spark, sf_dir, "documents"), _areas(spark, sf_dir))
