import numpy as np
import pytest
from pyspark.sql import functions as F

from horograph.operators import evaluation, links, ranked_pairs


def split_of(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    rows = sorted({(int(min(a, b)), int(max(a, b))) for a, b in zip(rng.integers(0, n, 5 * n), rng.integers(0, n, 5 * n)) if a != b})
    return spark.createDataFrame([(5 * a - 40, 5 * b - 40, 1.0, "R" if rng.random() < 0.3 else "E") for a, b in rows], "src bigint, dst bigint, weight double, part string").cache()


def points_of(spark, split, whole, without=()):
    ids = sorted({r["node_id"] for r in split.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct().collect()})
    rng = np.random.default_rng(3)
    # small whole numbers: many equal scores
    x = rng.integers(-1, 2, (len(ids), 3)).astype(float) if whole else rng.normal(size=(len(ids), 3))
    rows = [(i, v.tolist(), [1.0, -1.0, 1.0]) for i, v in zip(ids, x) if i not in without]
    return lambda train: spark.createDataFrame(rows, "node_id bigint, x array<double>, signs array<double>")


def test_pair_ids_are_those_of_spark(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(-(2**62), 2**62, 50), np.arange(50) - 25
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "i bigint, j bigint")
    want = [r["h"] for r in df.select(F.xxhash64("i", "j").alias("h")).collect()]
    assert ranked_pairs.pair_ids(a, b).tolist() == want


@pytest.mark.parametrize("whole, high, without", [(True, True, ()), (True, False, (0, 5, 100)), (False, False, ()), (False, True, (0, 5, 100))])
def test_points_are_ranked_as_a_table_of_the_candidates(spark, monkeypatch, whole, high, without):
    split = split_of(spark)
    score = evaluation.PointScores(3, points_of(spark, split, whole, without))
    for name, value in {"PAIRS": 150, "ROWS": 4, "COLUMNS": 16, "TASK_PAIRS": 400, "BLOCK": 7}.items():
        monkeypatch.setattr(ranked_pairs, name, value)
    got = evaluation.evaluate({0: split}, "m", score, high).first()
    # the same by a table
    monkeypatch.setattr(evaluation, "HELD", 0)
    evaluation._ENDS.clear()
    want = evaluation.evaluate({0: split}, "m", score, high).first()
    assert got.asDict() == pytest.approx(want.asDict())


def test_spectral_scores_write_no_table_of_candidates(spark, monkeypatch):
    splits = {s: split_of(spark, seed=s) for s in (0, 1)}
    want = evaluation.evaluate(splits, "m", lambda t, c: evaluation.spectral_scores(4)(t, c), higher_is_link=True).orderBy("seed").collect()
    monkeypatch.setattr(links, "candidates", None)
    monkeypatch.setattr(evaluation, "_candidates", None)
    got = evaluation.evaluate(splits, "m", evaluation.spectral_scores(4), higher_is_link=True).orderBy("seed")
    assert [r.asDict() for r in got.collect()] == [pytest.approx(r.asDict()) for r in want]
    assert got.dtypes == [("method", "string"), ("seed", "int"), ("f1", "double"), ("auc", "double"), ("hits", "double"), ("first_lift", "double"), ("captured", "bigint")]


def test_both_classes_and_numbers_are_needed(spark):
    split = spark.createDataFrame([(1, 2, 1.0, "E"), (2, 3, 1.0, "E")], "src bigint, dst bigint, weight double, part string")
    with pytest.raises(ValueError, match="both classes"):
        evaluation.evaluate({0: split}, "m", evaluation.spectral_scores(2), higher_is_link=True)
    split = split_of(spark)
    bad = evaluation.PointScores(1, lambda t: t.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct().select("node_id", F.array(F.lit(float("nan"))).alias("x"), F.array(F.lit(1.0)).alias("signs")))
    with pytest.raises(ValueError, match="numbers"):
        evaluation.evaluate({0: split}, "m", bad, higher_is_link=True)
