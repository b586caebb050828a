import pytest
from pyspark.sql import functions as F

from horograph.operators import evaluation
from horograph.plans import models


@pytest.mark.parametrize("high", [True, False])
def test_candidates_without_a_score_count_as_the_worst(spark, high):
    # node 5 loses its only edge, a positive; the other removed edge has the best score
    split = spark.createDataFrame([(1, 2, 1.0, "E"), (2, 3, 1.0, "E"), (3, 4, 1.0, "E"), (1, 3, 1.0, "R"), (4, 5, 1.0, "R")], "src bigint, dst bigint, weight double, part string")
    best = F.when((F.col("src") == 1) & (F.col("dst") == 3), 0.9).otherwise(0.2)
    score = lambda train, c: c.where("dst <> 5").select("src", "dst", (best if high else -best).alias("score"))
    o = evaluation.evaluate({0: split}, "m", score, high).first()
    # one positive above all five negatives; the other below two and level with three
    assert o["auc"] == pytest.approx((5 + 1.5) / 10)


def test_the_query_runs_all_seeds_and_dimensions(spark, monkeypatch):
    dims = []
    monkeypatch.setattr(models, "rg", lambda spark, d: spark.createDataFrame([(1, 2, 1.0)], "src bigint, dst bigint, weight double"))
    monkeypatch.setattr(models.evaluation, "prepare_splits", lambda e, seeds, q, giant: list(seeds))
    monkeypatch.setattr(models.evaluation, "spectral_scores", lambda k: dims.append(k))
    monkeypatch.setattr(models.evaluation, "evaluate", lambda splits, method, score, higher_is_link: spark.createDataFrame([(method, s) for s in splits], "method string, seed int"))
    out = models.catalog.queries["link_prediction_spectral"](spark, "").collect()
    assert dims == [2, 8, 16] and len({tuple(o) for o in out}) == len(out) == 15
