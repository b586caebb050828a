"""Hyperbolicity and Ricci curvature of graphs of any size, from samples.

Neither holds a matrix of the graph.  Hyperbolicity needs the hops between the
nodes of a pool only, so each pool node is one search; curvature needs the hops
between the neighbours of the two ends of an edge, which are 0, 1, 2 or 3 and
follow from two equi-joins.  The bounds on the pool, on edges and on neighbours
are parameters of the estimate: below them the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from horograph.operators import dense, graph
from horograph.runtime import is_small, materialize

POOL, NEIGHBOURS = 5000, 25


def _pool(edges: DataFrame, pool: int, seed: int) -> np.ndarray:
    """Ids of at most ``pool`` nodes, by hash."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return np.sort(ids.orderBy(F.xxhash64("node_id", F.lit(seed)), "node_id").limit(pool).toPandas()["node_id"].to_numpy(np.int64))


def hops_between(edges: DataFrame, pool: np.ndarray) -> DataFrame:
    """(pos, at, hops): for every pool node the places in the pool it reaches, and their hops."""
    spark = edges.sparkSession
    shared = spark.sparkContext.broadcast(pool)
    e = materialize(edges.select("src", "dst"))
    if is_small(e, graph.HOP_EDGES):
        search = graph.searcher(e)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for pos in b["id"]:
                    hops = search(int(shared.value[pos]), shared.value)
                    at = np.flatnonzero(hops >= 0)
                    yield pd.DataFrame({"pos": [pos], "at": [at.astype(np.int32)], "hops": [hops[at].astype(np.int32)]})

        return spark.range(0, len(pool), 1, max(1, -(-len(pool) // 64))).mapInPandas(run, "pos bigint, at array<int>, hops array<int>")
    nodes = spark.createDataFrame(pd.DataFrame({"node_id": pool, "pos": np.arange(len(pool))}), "node_id bigint, pos bigint")
    found = graph.hop_distances(edges, nodes).join(F.broadcast(nodes.withColumnRenamed("pos", "there")), "node_id")
    found = found.join(F.broadcast(nodes.select(F.col("node_id").alias("source"), "pos")), "source")
    # as many entries as the pool has nodes
    row = found.groupBy("pos").agg(F.collect_list(F.struct("there", "hops")).alias("row"))
    return row.select("pos", F.col("row.there").cast("array<int>").alias("at"), F.col("row.hops").cast("array<int>").alias("hops"))


def draw_quadruples(group: np.ndarray, samples: int, rng: np.random.Generator) -> np.ndarray:
    """(samples, 4) places that differ and lie in one group; none if no group has four."""
    size = np.bincount(group)
    big = np.flatnonzero(size >= 4)
    if not len(big):
        return np.zeros((0, 4), np.int64)
    # each group in proportion to the quadruples it has
    ways = size[big].astype(float) * (size[big] - 1) * (size[big] - 2) * (size[big] - 3)
    order = np.argsort(group, kind="stable")
    first = np.r_[0, np.cumsum(size)]
    out = [np.zeros((0, 4), np.int64)]
    while (left := samples - sum(map(len, out))) > 0:
        g = rng.choice(big, left, p=ways / ways.sum())
        q = order[first[g][:, None] + (rng.random((left, 4)) * size[g][:, None]).astype(np.int64)]
        s = np.sort(q, axis=1)
        out.append(q[(s[:, 1:] != s[:, :-1]).all(axis=1)])
    return np.concatenate(out)


def mean_hyperbolicity(edges: DataFrame, samples: int = 50_000, seed: int = 0, pool: int = POOL) -> DataFrame:
    """One row: mean and largest four-point delta over ``samples`` quadruples of distinct, connected nodes, the largest number of hops seen, and the number of quadruples.

    Quadruples come from at most ``pool`` nodes drawn by hash; with as many
    nodes in the graph the diameter is exact.  0 quadruples if no four nodes of
    the pool are connected.
    """
    ids = _pool(edges, pool, seed)
    n = len(ids)

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        d = np.full((n, n), -1, np.int32)
        for pos, at, hops in zip(rows["pos"], rows["at"], rows["hops"]):
            d[pos, at] = hops
        group = (d >= 0).argmax(axis=1)
        q = draw_quadruples(group, samples, np.random.default_rng(seed))
        delta = dense.hyperbolicity(d, q)
        return pd.DataFrame({"mean_delta": [delta.mean() if len(q) else 0.0], "max_delta": [delta.max(initial=0.0)], "diameter": [float(d.max(initial=0))], "quadruples": [len(q)]})

    # one row of at most ``pool`` numbers per pool node
    return hops_between(edges, ids).groupBy(F.lit(0).alias("all")).applyInPandas(kernel, "mean_delta double, max_delta double, diameter double, quadruples bigint")


def edge_curvature(edges: DataFrame, sample: int = 500, seed: int = 0, alpha: float = 0.5, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(src, dst, curvature) of at most ``sample`` edges drawn by hash: 1 - the cost of moving the lazy walk of one end to that of the other.

    A walk stays with ``alpha`` and else goes to one of at most ``neighbours``
    neighbours, drawn by hash.
    """
    own = materialize(edges.select("src", "dst").orderBy(F.xxhash64("src", "dst", F.lit(seed)), "src", "dst").limit(sample))
    both = materialize(graph.directed(edges.select("src", "dst", F.lit(1.0).alias("weight"))).select("src", "dst"))
    ends = F.broadcast(own.select(F.explode(F.array("src", "dst")).alias("src")).distinct())
    near = both.join(ends, "src", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy(F.xxhash64("dst", F.lit(seed)), "dst"))).where(F.col("k") <= neighbours)
    walk = near.groupBy("src").agg(F.collect_list("dst").alias("to")).select(F.col("src").alias("end"), F.concat(F.array("src"), "to").alias("to"))
    # at most ``sample`` edges with ``neighbours`` + 1 nodes at either end
    a, b = walk.select(F.col("end").alias("src"), F.col("to").alias("x")), walk.select(F.col("end").alias("dst"), F.col("to").alias("y"))
    walks = materialize(own.join(a, "src").join(b, "dst"))
    met = walks.select(F.explode("x").alias("x"), "y").select("x", F.explode("y").alias("y")).where("x <> y")
    wanted = materialize(met.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")).distinct())
    linked = materialize(wanted.join(edges.select(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).distinct(), ["i", "j"], "left_semi"))
    far = wanted.join(linked, ["i", "j"], "left_anti")
    # the end with fewer neighbours is opened
    degree = graph.degrees(edges)
    sized = far.join(degree.select(F.col("node_id").alias("i"), F.col("degree").alias("di")), "i").join(degree.select(F.col("node_id").alias("j"), F.col("degree").alias("dj")), "j")
    small = F.col("di") <= F.col("dj")
    opened = sized.select("i", "j", F.when(small, F.col("i")).otherwise(F.col("j")).alias("src"), F.when(small, F.col("j")).otherwise(F.col("i")).alias("other"))
    via = opened.join(both, "src").select("i", "j", "other", F.col("dst").alias("via"))
    two = via.join(both.select(F.col("src").alias("via"), F.col("dst").alias("other")), ["via", "other"], "left_semi").select("i", "j").distinct()
    hops = materialize(linked.withColumn("d", F.lit(1.0)).unionByName(two.withColumn("d", F.lit(2.0))))
    cells = walks.select("src", "dst", "x", "y", F.posexplode("x").alias("p", "a")).select("src", "dst", "x", "y", "p", "a", F.posexplode("y").alias("q", "b"))
    cells = cells.withColumn("i", F.least("a", "b")).withColumn("j", F.greatest("a", "b")).select("src", "dst", "p", "q", "a", "b", "i", "j")
    cost = cells.join(hops, ["i", "j"], "left").select("src", "dst", "p", "q", F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.coalesce("d", F.lit(3.0))).alias("d"))

    def mass(n: int) -> np.ndarray:
        return np.r_[alpha, np.full(n - 1, (1 - alpha) / max(1, n - 1))]

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((rows["p"].max() + 1, rows["q"].max() + 1))
        m[rows["p"], rows["q"]] = rows["d"]
        return pd.DataFrame({"src": rows["src"].iloc[:1], "dst": rows["dst"].iloc[:1], "curvature": 1.0 - dense.transport_cost(mass(m.shape[0]), mass(m.shape[1]), m)})

    return cost.groupBy("src", "dst").applyInPandas(solve, "src bigint, dst bigint, curvature double")


def ricci_curvature(edges: DataFrame, sample: int = 500, seed: int = 0) -> DataFrame:
    """One row: mean and deviation of the curvature of sampled edges, the share below 0 and their number."""
    c = F.col("curvature")
    return edge_curvature(edges, sample, seed).agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.avg((c < 0).cast("double")).alias("negative"), F.count(F.lit(1)).alias("edges"))
