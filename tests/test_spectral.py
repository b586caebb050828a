import numpy as np
import pandas as pd

from horograph.operators import dense, spectral


def graph(n, links, seed=0):
    """A random graph whose low ids have many links, and two pairs apart from it."""
    rng = np.random.default_rng(seed)
    e = {(min(a, b), max(a, b)) for a, b in zip((n * rng.random(links) ** 3).astype(int), rng.integers(0, n, links)) if a != b}
    e |= {(n, n + 1), (n + 2, n + 3)}
    rows = np.array(sorted(e))
    return pd.DataFrame({"src": rows[:, 0] * 7, "dst": rows[:, 1] * 7, "weight": rng.integers(1, 5, len(rows)).astype(float)})


def table(spark, e):
    return spark.createDataFrame(e, "src bigint, dst bigint, weight double")


def product(x, signs):
    return (x * signs) @ x.T


def check_adjacency(spark, e):
    ids, a = dense.adjacency(e, weighted=False)
    want = product(*dense.spectral_embedding(a, 4))
    got = {r["node_id"]: r for r in dense.adjacency_spectral(table(spark, e), 4).collect()}
    assert sorted(got) == ids.tolist()
    x, signs = np.array([got[i]["x"] for i in ids]), np.array(got[ids[0]]["signs"])
    assert np.allclose(product(x, signs), want, atol=1e-7)


def test_adjacency_spectral(spark, monkeypatch):
    e = graph(300, 1500)
    check_adjacency(spark, e)
    # with rows that stay in the cluster
    monkeypatch.setattr(spectral, "LOCAL_EDGES", 10)
    check_adjacency(spark, e)


def test_more_nodes_than_a_dense_matrix_may_have(spark):
    n = 5200
    e = pd.DataFrame({"src": np.zeros(n - 1, int), "dst": np.arange(1, n), "weight": 1.0})
    rows = dense.adjacency_spectral(table(spark, e), 2).collect()
    # a star: its two values are plus and minus the root of n - 1
    assert len(rows) == n and sorted(rows[0]["signs"]) == [-1.0, 1.0]
    x = {r["node_id"]: r["x"] for r in rows}
    assert abs(sum(s * a * b for s, a, b in zip(rows[0]["signs"], x[0], x[17])) - 1) < 1e-8
    assert abs(np.square(x[0]).sum() - np.sqrt(n - 1)) < 1e-6


def test_eigenmaps(spark, monkeypatch):
    e = graph(300, 900)
    connected = e[e["dst"] < 7 * 300]
    ids, a = dense.adjacency(connected)
    ids, rows = dense.numbered_edges(connected)
    parts = len(np.unique(rows.components()))
    strength = a.sum(axis=1)
    lap = np.eye(len(a)) - a / np.sqrt(strength[:, None] * strength[None])
    u = dense.laplacian_pairs(rows, rows.times, len(ids), parts + 2)
    values = np.linalg.eigvalsh(lap)[: parts + 3]
    assert np.allclose(u.T @ u, np.eye(parts + 3), atol=1e-9)
    assert np.allclose(lap @ u, u * values, atol=1e-7)
    for limit in (spectral.LOCAL_EDGES, 10):
        monkeypatch.setattr(spectral, "LOCAL_EDGES", limit)
        got = {r["node_id"]: r["v"] for r in dense.eigenmaps(table(spark, e), 2).collect()}
        assert len(got) == len(np.unique(e[["src", "dst"]])) and all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in got.values())


def test_eigenmaps_of_many_nodes(spark):
    n = 5200
    e = pd.DataFrame({"src": np.zeros(n - 1, int), "dst": np.arange(1, n), "weight": 1.0})
    assert dense.eigenmaps(table(spark, e), 2).count() == n


def test_forest_matrix(spark):
    e = graph(60, 150)
    ids, a = dense.adjacency(e)
    got = {(r["i"], r["j"]): r["q"] for r in dense.forest_matrix(table(spark, e)).collect()}
    want = dense.forest(a)
    assert len(got) == len(ids) ** 2
    assert np.allclose([[got[i, j] for j in ids] for i in ids], want, atol=1e-12)


def test_forest_matrix_of_many_nodes(spark):
    n = 5200
    e = pd.DataFrame({"src": np.zeros(n - 1, int), "dst": np.arange(1, n), "weight": 1.0})
    row = dense.forest_matrix(table(spark, e)).where("i = 5").selectExpr("count(*) AS n", "sum(q) AS total", "max(q) AS own").first()
    assert row["n"] == n and abs(row["total"] - 1) < 1e-9 and row["own"] > 0.5


def test_inverse_in_blocks():
    x = np.random.default_rng(0).normal(size=(37, 37))
    a = x @ x.T + np.eye(37)
    assert np.allclose(dense.invert_in_place(a.copy(), 10), np.linalg.inv(a))


def test_hydra_in_blocks_of_hops(spark, monkeypatch):
    from horograph.operators.graph import largest_component

    edges = largest_component(table(spark, graph(200, 500)))
    _, a = dense.adjacency(edges.toPandas())
    want = dense.hydra(dense.hop_matrix(a))
    monkeypatch.setattr(dense, "WHOLE_NODES", 10)
    monkeypatch.setattr(dense, "MAX_NODES", 10)
    got = dense.hydra_embedding(edges).orderBy("node_id").toPandas()
    assert np.allclose(got["r"], want["r"], atol=1e-9)
    assert abs(got["stress"][0] - want["stress"]) < 1e-6 * want["stress"] + 0.5 and abs(got["strain"][0] - want["strain"]) < 1e-7 * want["strain"]


def test_closures_of_networks(spark, monkeypatch):
    from horograph.operators import graph as g

    rng = np.random.default_rng(1)
    rows = {(int(k), int(min(a, b)), int(max(a, b))) for k, a, b in zip(rng.integers(0, 3, 90), rng.integers(0, 40, 90), rng.integers(0, 40, 90)) if a != b}
    # a ring: edges that don't point to later nodes
    rows |= {(9, k, (k + 1) % 5) for k in range(5)}
    want = {(n, a, b) for n, a, b in rows}
    while True:
        more = want | {(n, a, d) for n, a, b in want for m, c, d in rows if m == n and c == b}
        if more == want:
            break
        want = more
    e = spark.createDataFrame(sorted(rows), "net_id bigint, src bigint, dst bigint")
    for limit in (g.CLOSURE_NODES, 20):
        monkeypatch.setattr(g, "CLOSURE_NODES", limit)
        got = [tuple(r) for r in g.network_closures(e).collect()]
        assert len(got) == len(set(got)) and set(got) == want
