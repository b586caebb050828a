import random

import pytest

from horograph.operators import graph
from horograph.plans import hyperbolic


def brute(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for s in near:
        out[(s, s)], todo = 0, [s]
        for x in todo:
            for y in near[x]:
                if (s, y) not in out:
                    out[(s, y)] = out[(s, x)] + 1
                    todo.append(y)
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A random part, a path of 45 nodes, a separate pair; repeated rows, self-loops and nulls."""
    rng = random.Random(3)
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(50)] + [(100 + k, 101 + k) for k in range(44)] + [(900, 901)]
    rows = [*pairs, *[(b, a) for a, b in pairs[::4]], (5, 5), (7, None)]
    d = str(tmp_path_factory.mktemp("routes"))
    spark.createDataFrame(rows, "src bigint, dst bigint").write.parquet(f"{d}/routes.parquet")
    return d, {(a, b) for a, b in pairs if a != b}


@pytest.mark.parametrize("joins", [False, True])
def test_every_node_is_a_source(spark, folder, monkeypatch, joins):
    d, pairs = folder
    if joins:
        monkeypatch.setattr(graph, "HOP_EDGES", 0)
    out = graph.all_hop_distances(hyperbolic.rg(spark, d)).collect()
    got = {(o["source"], o["node_id"]): o["hops"] for o in out}
    assert len(out) == len(got) and got == brute(pairs) and max(got.values()) == 44
    per = {(o["source"], o["hops"]): (o["nodes"], o["id_sum"]) for o in hyperbolic.catalog.queries["hop_distances"](spark, d).collect()}
    assert per == {(s, h): (len(at := [y for (x, y), k in got.items() if (x, k) == (s, h)]), sum(at)) for (s, _), h in got.items()}


def test_search_ends_when_nothing_is_new(spark):
    e = spark.createDataFrame([(k, k + 1, 1.0) for k in range(40)], "src bigint, dst bigint, weight double")
    start = spark.createDataFrame([(0,), (None,), (0,)], "node_id bigint")
    assert sorted(tuple(r) for r in graph.hop_distances(e, start).collect()) == [(0, k, k) for k in range(41)]
    assert sorted(tuple(r) for r in graph.hop_distances(e, start, within=3).collect()) == [(0, k, k) for k in range(4)]
