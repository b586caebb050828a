import random
from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F

from horograph.operators import heavy_keys as h

SCHEMA = "net_id bigint, src bigint, dst bigint, seen_at timestamp_ntz, node_id string, chunk int"


def edges(spark, rows):
    return spark.createDataFrame([(*r, datetime(2024, 1, 1), "x", 1) for r in rows], SCHEMA)


def test_degrees_with_a_hot_node(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), 1 if rng.random() < 0.4 else rng.randrange(40), rng.choice([None, *range(40)])) for _ in range(3000)]
    rows += [(None, 1, 2), (0, None, 3), (0, 7, 7)]
    pairs = {(n, min(a, b), max(a, b)) for n, a, b in rows if None not in (n, a, b) and a != b}
    want = Counter(x for _, a, b in pairs for x in (a, b))
    got = h.degrees(edges(spark, rows).repartition(5), chunks=4096, least_rows=10)
    assert {r["node_id"]: r["degree"] for r in got.collect()} == dict(want)
    assert got.agg(F.max("chunks")).first()[0] > 3
    top = {r["node_id"] for r in h.dominating(got).collect()}
    assert top == {k for k, n in want.items() if n * 50 >= len(pairs)}


def test_numbers_are_exact_and_chunks_equal(spark):
    df = spark.range(5000).selectExpr("case when id % 3 = 0 then 7 else id % 50 end as k", "id").repartition(6)
    rows = h.number_rows(df, "k", ["id"], chunks=100, least_rows=40).collect()
    heavy = [r for r in rows if r["k"] == 7]
    assert sorted(r["number"] for r in heavy) == list(range(len(heavy)))
    sizes = Counter(r["chunk"] for r in heavy)
    assert len({n for c, n in sizes.items() if c < max(sizes)}) == 1
    assert len(rows) == 5000


def test_ordered_merge(spark):
    df = spark.range(1000).selectExpr("1 as k", "id").coalesce(4)
    n = h.number_rows(df, "k", ["id"], chunks=10, least_rows=10)
    r = h.reduce_chunks(n, "k", {"a": F.min_by("id", "number"), "z": F.max_by("id", "number")}, {"first": ("first", "a"), "last": ("last", "z")}).first()
    ordered = [x["id"] for x in sorted(n.collect(), key=lambda x: x["number"])]
    assert (r["first"], r["last"], r["chunks"]) == (ordered[0], ordered[-1], 10)


def test_empty(spark):
    got = h.degrees(edges(spark, []))
    assert got.count() == 0 and h.dominating(got).count() == 0


def test_small_tables_are_chunked_too(spark):
    rows = [(k % 7, 1, 10 + k // 7) for k in range(7 * 400)] + [(8, 100 + k, 101 + k) for k in range(300)]
    got = {r["node_id"]: (r["degree"], r["chunks"]) for r in h.degrees(edges(spark, rows).repartition(3)).collect()}
    assert got[1] == (2800, 3) and got[10] == (7, 1)
