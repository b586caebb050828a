"""Graph operators on edge tables.

An edge table has ``src``, ``dst`` and ``weight``, with ``src < dst`` and one row
per pair.  Null ends and self-loops are dropped by ``canonical_edges``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from horograph.operators import pairs as pairs_
from horograph.runtime import is_small, materialize

#: Up to so many edges a search from all nodes sends the whole graph to every task (16 bytes an edge and direction).
HOP_EDGES = 4_000_000
#: Up to so many nodes the closure of a network is one matrix of bytes in a task, and at most its square of rows.
CLOSURE_NODES = 4000


def canonical_edges(df: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None) -> DataFrame:
    """One row per unordered pair; the weight is the largest of the rows, or their number."""
    w = F.max(weight) if weight else F.count(F.lit(1))
    ok = F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))
    return df.where(ok).groupBy(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst")).agg(w.cast("double").alias("weight"))


def unweighted(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.lit(1.0).alias("weight"))


def directed(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    both = F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"))))
    return edges.select(both.alias("e"), "weight").select(F.col("e.a").alias("src"), F.col("e.b").alias("dst"), "weight")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c), each triangle once.

    Edges point from the lower to the higher degree, so a hub starts few wedges
    and the join stays near the number of edges to the power 1.5.
    """
    d = materialize(degrees(edges))
    e = edges.join(d.select(F.col("node_id").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("node_id").alias("dst"), F.col("degree").alias("dd")), "dst")
    up = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    o = materialize(e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b")))
    wedges = o.join(o.select("a", F.col("b").alias("c")), "a").where(F.col("b") < F.col("c"))
    pair = edges.select(F.col("src").alias("b"), F.col("dst").alias("c"))
    return wedges.join(pair, ["b", "c"]).select("a", "b", "c")


def clustering(edges: DataFrame) -> DataFrame:
    """(node_id, degree, triangles, clustering): 0 for nodes of degree below 2."""
    t = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("triangles"))
    wedges = F.col("degree") * (F.col("degree") - 1) / 2
    out = degrees(edges).join(t, "node_id", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)).cast("bigint"))
    return out.withColumn("clustering", F.when(F.col("degree") > 1, F.col("triangles") / wedges).otherwise(0.0))


def degree_and_clustering(edges: DataFrame) -> DataFrame:
    c = clustering(edges)
    wedges = F.sum(F.col("degree") * (F.col("degree") - 1) / 2)
    return c.agg(
        F.count(F.lit(1)).alias("nodes"),
        (F.sum("degree") / 2).cast("bigint").alias("edges"),
        F.avg("degree").alias("mean_degree"),
        F.stddev_pop("degree").alias("std_degree"),
        F.max("degree").alias("max_degree"),
        F.avg("clustering").alias("average_clustering"),
        F.when(wedges > 0, F.sum("triangles") / wedges).otherwise(0.0).alias("transitivity"),
    )


def edge_common_neighbors(edges: DataFrame) -> DataFrame:
    """(src, dst, common): common neighbours of the ends of every edge."""
    t = triangles(edges)
    sides = F.explode(F.array(*[F.struct(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst")) for x, y in (("a", "b"), ("a", "c"), ("b", "c"))]))
    n = t.select(sides.alias("s")).groupBy("s.src", "s.dst").agg(F.count(F.lit(1)).alias("common"))
    return edges.select("src", "dst").join(n, ["src", "dst"], "left").select("src", "dst", F.coalesce("common", F.lit(0)).cast("bigint").alias("common"))


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, rounds: int = 60) -> DataFrame:
    """(node_id, component): the smallest id of the component.

    Each round takes the smallest label of the neighbourhood and then of the
    label's own label, so long paths halve; stops when nothing changes.
    """
    both = materialize(directed(edges).select("src", "dst"))
    ids = both.select(F.col("src").alias("node_id"))
    if nodes is not None:
        ids = ids.unionByName(nodes.where(F.col("node_id").isNotNull()).select(F.col("node_id").cast("bigint").alias("node_id")))
    state = materialize(ids.distinct().select("node_id", F.col("node_id").alias("component")))
    for _ in range(rounds):
        near = both.join(state.select(F.col("node_id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node_id")).agg(F.min("component").alias("near"))
        hooked = state.join(near, "node_id", "left").select("node_id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("c"))
        up = state.select(F.col("node_id").alias("c"), F.col("component").alias("cc"))
        new = materialize(hooked.join(up, "c").select("node_id", "old", F.least("c", "cc").alias("component")))
        changed = new.where(F.col("old") != F.col("component")).limit(1).count()
        state = new.select("node_id", "component")
        if not changed:
            return state
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges inside the largest component; the smaller label wins a tie."""
    c = materialize(connected_components(edges))
    top = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    inside = c.join(F.broadcast(top), "component", "left_semi").select(F.col("node_id").alias("src"))
    return edges.join(inside, "src", "left_semi")


def relabel(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges on 0..N-1, node table): ids numbered in their order."""
    from horograph.operators.ordering import numbered

    ids = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    table = numbered(ids, [F.asc("node_id")], "pos").withColumn("pos", F.col("pos") - 1)
    table = materialize(table)
    a, b = table.select(F.col("node_id").alias("src"), F.col("pos").alias("s")), table.select(F.col("node_id").alias("dst"), F.col("pos").alias("d"))
    return edges.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "weight"), table


def hop_distances(edges: DataFrame, sources: DataFrame, within: int | None = None) -> DataFrame:
    """(source, node_id, hops) by breadth-first search from every source at once until no node is new, or up to ``within`` hops; other pairs are absent."""
    both = materialize(directed(edges).select("src", "dst"))
    start = sources.select(F.col("node_id").cast("bigint").alias("source")).where(F.col("source").isNotNull()).distinct()
    seen = frontier = materialize(start.select("source", F.col("source").alias("node_id"), F.lit(0).alias("hops")))
    hop = 0
    while within is None or hop < within:
        hop += 1
        step = frontier.join(both, F.col("node_id") == F.col("src")).select("source", F.col("dst").alias("node_id")).distinct()
        frontier = materialize(step.join(seen.select("source", "node_id"), ["source", "node_id"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.limit(1).count() == 0:
            break
        seen = seen.unionByName(frontier)
        if hop % 8 == 0:
            seen = materialize(seen)
    return seen


def all_hop_distances(edges: DataFrame) -> DataFrame:
    """(source, node_id, hops) from every node of the graph, whatever the number of hops: an output of quadratic size.

    Sources are spread over the tasks, and each task searches the whole graph,
    so no pair is shuffled; graphs beyond ``HOP_EDGES`` are searched by joins.
    """
    e = materialize(edges.select("src", "dst"))
    if not is_small(e, HOP_EDGES):
        return hop_distances(edges, degrees(edges))
    ids = np.unique(e.toPandas().to_numpy(np.int64))
    shared, search = edges.sparkSession.sparkContext.broadcast(ids), searcher(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch["id"]:
                hops = search(int(shared.value[s]), shared.value)
                found = np.flatnonzero(hops >= 0)
                yield pd.DataFrame({"source": shared.value[s], "node_id": shared.value[found], "hops": hops[found]})

    return edges.sparkSession.range(0, len(ids), 1, max(1, -(-len(ids) // 64))).mapInPandas(run, "source bigint, node_id bigint, hops int")


def searcher(edges: DataFrame) -> Callable[[int, np.ndarray], np.ndarray]:
    """A search that gives the hops from a node to sorted ids, -1 where there is no way; it carries the whole graph, so the caller checks its size."""
    rows = edges.select("src", "dst").toPandas().to_numpy(np.int64)
    ids, at = np.unique(rows.ravel(), return_inverse=True)
    a, b = at.reshape(-1, 2).T
    tail, head = np.r_[a, b], np.r_[b, a]
    near = head[np.argsort(tail, kind="stable")].astype(np.int32)
    begin = np.r_[0, np.cumsum(np.bincount(tail, minlength=len(ids)))]
    shared = edges.sparkSession.sparkContext.broadcast((ids, near, begin))

    def search(source: int, wanted: np.ndarray) -> np.ndarray:
        ids, near, begin = shared.value
        n = len(ids)
        start = np.searchsorted(ids, source)
        hops, front, hop = np.full(n, -1, np.int32), np.array([start]), 0
        hops[start] = 0
        while len(front):
            hop += 1
            size = begin[front + 1] - begin[front]
            step = near[np.repeat(begin[front] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            step = step[hops[step] < 0]
            hops[step] = hop
            front = np.flatnonzero(hops == hop) if 8 * len(step) > n else np.unique(step)
        return hops[np.searchsorted(ids, wanted)]

    return search


def weighted_distances(edges: DataFrame, sources: DataFrame, rounds: int = 1000) -> DataFrame:
    """(source, node_id, distance) by relaxation of all edges until nothing improves; weights must not be negative."""
    both = materialize(directed(edges))
    best = materialize(sources.select(F.col("node_id").cast("bigint").alias("source")).distinct().select("source", F.col("source").alias("node_id"), F.lit(0.0).alias("distance")))
    moved = best
    for _ in range(rounds):
        step = moved.join(both, F.col("node_id") == F.col("src")).select("source", F.col("dst").alias("node_id"), (F.col("distance") + F.col("weight")).alias("new"))
        step = step.groupBy("source", "node_id").agg(F.min("new").alias("new"))
        joined = materialize(best.join(step, ["source", "node_id"], "full").select("source", "node_id", F.col("distance").alias("old"), F.least("distance", "new").alias("distance")))
        best = joined.select("source", "node_id", "distance")
        moved = materialize(joined.where(F.col("old").isNull() | (F.col("distance") < F.col("old"))).select("source", "node_id", "distance"))
        if moved.limit(1).count() == 0:
            return best
    raise RuntimeError("distances did not settle")


def transitive_closure(edges: DataFrame, child: str = "src", parent: str = "dst", limit: int = 64) -> DataFrame:
    """(child, ancestor): every ancestor of every node of a directed table, by doubling of path lengths."""
    known = materialize(edges.where(F.col(child).isNotNull() & F.col(parent).isNotNull()).select(F.col(child).alias("child"), F.col(parent).alias("ancestor")).distinct())
    n = known.count()
    for _ in range(limit):
        longer = known.join(known.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("next")), "ancestor").select("child", F.col("next").alias("ancestor"))
        known = materialize(known.unionByName(longer).distinct())
        m = known.count()
        if m == n:
            return known
        n = m
    raise RuntimeError("closure did not settle")


def reached(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, their ancestors) of the edges src -> dst of one graph."""
    ids, at = np.unique(np.r_[src, dst], return_inverse=True)
    a, b = at.reshape(2, -1)
    n = len(ids)
    link = np.zeros((n, n), bool)
    link[a, b] = True
    near, reach = [np.flatnonzero(row) for row in link], link.copy()
    # from the last node up one pass is enough where every edge points to a later node
    while True:
        before = np.count_nonzero(reach)
        for k in range(n - 1, -1, -1):
            if len(near[k]):
                reach[k] |= reach[near[k]].any(axis=0)
        if (a < b).all() or np.count_nonzero(reach) == before:
            i, j = np.nonzero(reach)
            return ids[i], ids[j]


def network_closures(edges: DataFrame) -> DataFrame:
    """(net_id, child, ancestor): the closure of every network of (net_id, src, dst), each in one task; networks of more than ``CLOSURE_NODES`` nodes by joins."""
    size = edges.select("net_id", F.explode(F.array("src", "dst")).alias("node_id")).groupBy("net_id").agg(F.countDistinct("node_id").alias("nodes"))
    wide = materialize(size.where(F.col("nodes") > CLOSURE_NODES).select("net_id"))

    def run(table: pa.Table) -> pa.Table:
        child, ancestor = reached(table["src"].to_numpy(), table["dst"].to_numpy())
        return pa.table({"net_id": np.full(len(child), table["net_id"][0].as_py()), "child": child, "ancestor": ancestor})

    few = wide.limit(1).count() == 0
    small = edges if few else edges.join(wide, "net_id", "left_anti")
    out = small.select("net_id", "src", "dst").groupBy("net_id").applyInArrow(run, "net_id bigint, child bigint, ancestor bigint")
    if few:
        return out
    node = lambda c: F.struct("net_id", F.col(c).alias("node_id")).alias(c)
    c = transitive_closure(edges.join(wide, "net_id", "left_semi").select(node("src"), node("dst")))
    return out.unionByName(c.select("child.net_id", F.col("child.node_id").alias("child"), F.col("ancestor.node_id").alias("ancestor")))


def knn_graph(pairs: DataFrame, k: int = 15, symmetric: bool = True) -> DataFrame:
    """(src, dst, weight) from pair distances (i, j, d): the ``k`` nearest of each node, equal distances by id.

    Symmetric edges keep an edge that either end chose; otherwise both must have chosen it.
    """
    both = pairs.select(F.explode(F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b")))).alias("e"), "d").select("e.a", "e.b", "d")
    near = both.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("r") <= k)
    return _merged(near, symmetric)


def knn_graph_of(nodes: DataFrame, kernel: pairs_.Kernel = pairs_.polar_kernel, k: int = 15, symmetric: bool = True) -> DataFrame:
    """``knn_graph`` of points (node_id, r, v), without a table of all pairs."""
    return _merged(pairs_.nearest_in_tiles(nodes, kernel, k), symmetric)


def _merged(near: DataFrame, symmetric: bool) -> DataFrame:
    merged = near.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.max("d").alias("weight"), F.count(F.lit(1)).alias("chosen"))
    return merged.where(F.lit(symmetric) | (F.col("chosen") == 2)).select("src", "dst", "weight")


def balanced_tree(spark, branching: int = 2, depth: int = 4) -> DataFrame:
    n = sum(branching**k for k in range(depth + 1))
    return spark.range(1, n).select(F.floor((F.col("id") - 1) / branching).alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))
