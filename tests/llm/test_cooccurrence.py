import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from horograph.llm import cooccurrence as c

SCHEMA = "net_id bigint, src bigint, dst bigint, nodes string, block string"


def brute(rows, least, lift):
    adj = {}
    for n, a, b in rows:
        if None not in (n, a, b) and a != b:
            adj.setdefault(n, {}).setdefault(a, set()).add(b)
            adj[n].setdefault(b, set()).add(a)
    out = {}
    for n, g in adj.items():
        for a, b in combinations(sorted(g), 2):
            both = len(g[a] & g[b])
            if both >= least and both * len(g) >= lift * len(g[a]) * len(g[b]):
                out[(n, a, b)] = (both, len(g[a]), len(g[b]), len(g))
    return out


@pytest.mark.parametrize("block,task", [(1000, 10_000), (7, 10_000), (7, 40)])
def test_pairs_match_brute_force(spark, block, task, monkeypatch):
    rng = random.Random(block)
    if block == 7:  # networks too large for one task, then tables too large to broadcast
        monkeypatch.setattr(c, "WHOLE_NODES", 30)
        monkeypatch.setattr(c, "RECORD_BLOCK", 8)
        if task == 40:
            monkeypatch.setattr(c, "is_small", lambda df: False)
    rows = [(rng.randrange(3), rng.randrange(60), rng.choice([None, *range(60)])) for _ in range(1500)]
    rows += [(9, a, 100 + b) for a in range(12) for b in range(10)] + rows[:200] + [(b, a, n) for n, a, b in rows[:5]] + [(None, 1, 2)]
    got = c.cooccurring(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA), least=3, lift=1.2, block_items=block, task_rows=task).collect()
    assert {(r["net_id"], r["node_a"], r["node_b"]): (r["empirical_cn"], r["n_a"], r["n_b"], r["nodes"]) for r in got} == brute(rows, 3, 1.2)
    assert len(got) == len(brute(rows, 3, 1.2))


def test_a_network_of_100_000_nodes_stays_in_small_tasks(spark):
    rng = random.Random(5)
    # a ring, a hub, and groups whose members share their neighbours
    rows = [(1, k, (k + 1) % 100_000) for k in range(100_000)] + [(1, 7, rng.randrange(100_000)) for _ in range(45_000)]
    for g in range(200):
        rows += [(1, 1000 + 10 * g + a, 50_000 + 9 * g + b) for a in range(10) for b in range(9)]
    df = spark.createDataFrame(rows, "net_id bigint, src bigint, dst bigint")
    placed = c.block_rows(c.links(df).distinct(), 8, 3.0, block_items=512, task_rows=4000)
    per = placed.groupBy("net_id", "i", "j", "part").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item").alias("items")).agg(F.max("n"), F.max("items"), F.count(F.lit(1))).first()
    assert per[0] < 3 * 4000 and per[1] < 3 * 512 and per[2] > 20
    # the hub is in no pair, and no basket goes where it has no item
    assert placed.where("item = 7").count() == 0 and placed.count() < 20 * 200 * 90
    want = {p for g in range(200) for first, n in ((1000 + 10 * g, 10), (50_000 + 9 * g, 9)) for p in combinations(range(first, first + n), 2)}
    assert {(r["node_a"], r["node_b"]) for r in c.cooccurring(df, block_items=512, task_rows=4000).collect()} == want


def test_empty(spark):
    assert c.cooccurring(spark.createDataFrame([], SCHEMA)).count() == 0
    assert c.cooccurring(spark.createDataFrame([(1, 2, 2, "", ""), (1, None, 2, "", "")], SCHEMA)).count() == 0
