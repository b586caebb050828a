"""Tables of pairs of points: all pairs by tiles, gathered pairs by equi-joins.

All pairs are an output of quadratic size, so only the way there can be spared:
nodes are hashed into tiles whose number follows from a count, each tile is
shipped once per tile it meets, and a task computes one pair of tiles with
NumPy.  The hash makes tiles of about ``TILE`` points.  Where only the nearest
of each point are wanted (``nearest_in_tiles``), a pair of tiles gives only
those.  Points with a null id or coordinate are left out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from horograph.functions import distances

TILE = 512

Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def polar_kernel(r1: np.ndarray, v1: np.ndarray, r2: np.ndarray, v2: np.ndarray) -> np.ndarray:
    gap2 = np.zeros((len(r1), len(r2)))
    # summed by coordinate: differences first, so near directions keep their digits
    for k in range(v1.shape[1]):
        gap2 += (v1[:, k, None] - v2[None, :, k]) ** 2
    m = 2 * np.sinh((r1[:, None] - r2[None]) / 2) ** 2 + 0.5 * np.sinh(r1)[:, None] * np.sinh(r2)[None] * gap2
    m = np.maximum(m, 0.0)
    return np.log1p(m + np.sqrt(m * (m + 2) + 1e-30))


def _tiled(nodes: DataFrame, r: str, v: str, id_col: str, tile: int, extra: list[str]) -> DataFrame:
    """Points once per pair of tiles (ti <= tj) that needs them; ``b`` is their own tile."""
    points = nodes.where(F.col(id_col).isNotNull() & F.col(r).isNotNull() & F.col(v).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(r).cast("double").alias("r"), F.col(v).cast("array<double>").alias("v"), *extra
    )
    tiles = tile_count(points, tile)
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    return points.withColumn("b", tile_of("id", tiles)).withColumn("o", other).select(F.least("b", "o").alias("ti"), F.greatest("b", "o").alias("tj"), "b", "id", "r", "v", *extra)


def tile_count(points: DataFrame, tile: int = TILE) -> int:
    return max(1, -(-points.count() // tile))


def tile_of(id_col: str, tiles: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(tiles)).cast("int")


def _distances(key: tuple, t: pa.Table, kernel: Kernel) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(places on the left, places on the right, distances, whether both are one tile)."""
    ti, tj = key[0].as_py(), key[1].as_py()
    b, rr = t.column("b").to_numpy(), t.column("r").to_numpy()
    vv = np.array(t.column("v").combine_chunks().flatten()).reshape(len(b), -1)
    left, right = np.flatnonzero(b == ti), np.flatnonzero(b == tj)
    if not len(left) or not len(right):
        return left, right, np.zeros((len(left), len(right))), ti == tj
    return left, right, kernel(rr[left], vv[left], rr[right], vv[right]), ti == tj


def all_pairs(nodes: DataFrame, kernel: Kernel, r: str = "r", v: str = "v", id_col: str = "node_id", tile: int = TILE) -> DataFrame:
    """(i, j, d) for i < j."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        left, right, d, same = _distances(key, t, kernel)
        ids = t.column("id").to_numpy()
        a, c = np.broadcast_to(ids[left][:, None], d.shape), np.broadcast_to(ids[right][None], d.shape)
        keep = a < c if same else a != c
        return pa.table({"i": np.minimum(a, c)[keep], "j": np.maximum(a, c)[keep], "d": d[keep]})

    return _tiled(nodes, r, v, id_col, tile, []).groupBy("ti", "tj").applyInArrow(run, "i bigint, j bigint, d double")


def nearest_in_tiles(nodes: DataFrame, kernel: Kernel, k: int, r: str = "r", v: str = "v", id_col: str = "node_id", tile: int = 2 * TILE, group: str | None = None, digits: int | None = None) -> DataFrame:
    """(a, b, d): the ``k`` nearest of every point, equal distances by id.

    Every pair of tiles gives at most ``k`` rows per point and side, so no table
    of all pairs is written.  With ``group`` (an integer column) only points of
    other groups are neighbours; ``digits`` rounds the distances before they are
    compared.
    """
    extra = [group] if group else []

    def run(key: tuple, t: pa.Table) -> pa.Table:
        left, right, d, same = _distances(key, t, kernel)
        ids = t.column("id").to_numpy()
        if digits is not None:
            d = np.round(d, digits)
        g = t.column(group).to_numpy() if group else None
        out = []
        for here, there, m in ((left, right, d),) if same else ((left, right, d), (right, left, d.T)):
            if not m.size:
                continue
            m = m.copy()
            m[ids[here][:, None] == ids[there][None]] = np.inf
            if g is not None:
                m[g[here][:, None] == g[there][None]] = np.inf
            if k < m.shape[1]:
                row, column = np.nonzero((m <= np.partition(m, k - 1, axis=1)[:, k - 1 : k]) & np.isfinite(m))
            else:
                row, column = np.nonzero(np.isfinite(m))
            order = np.lexsort((ids[there][column], m[row, column], row))
            row, column = row[order], column[order]
            near = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append((ids[here][row[near]], ids[there][column[near]], m[row[near], column[near]]))
        a, b, c = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"a": a, "b": b, "d": c})

    found = _tiled(nodes, r, v, id_col, tile, extra).groupBy("ti", "tj").applyInArrow(run, "a bigint, b bigint, d double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("rank") <= k).drop("rank")


def polar_distances(nodes: DataFrame, id_col: str = "node_id", tile: int = TILE) -> DataFrame:
    return all_pairs(nodes, polar_kernel, id_col=id_col, tile=tile)


def _id_tiles(nodes: DataFrame, id_col: str, tile: int) -> tuple[DataFrame, int]:
    ids = nodes.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id")).distinct()
    return ids, tile_count(ids, tile)


def expand_pairs(nodes: DataFrame, id_col: str = "node_id", tile: int = TILE) -> DataFrame:
    """(i, j) for all i < j, as an equi-join on pairs of tiles."""
    ids, tiles = _id_tiles(nodes, id_col, tile)
    ids = ids.withColumn("b", tile_of("id", tiles))
    left = ids.select(F.col("id").alias("i"), F.col("b").alias("ti"), F.explode(F.sequence(F.col("b"), F.lit(tiles - 1))).alias("tj"))
    right = ids.select(F.col("id").alias("j"), F.col("b").alias("tj"), F.explode(F.sequence(F.lit(0), F.col("b"))).alias("ti"))
    # two points of one tile meet twice, those of two tiles once
    met = left.join(right, ["ti", "tj"]).where((F.col("ti") != F.col("tj")) | (F.col("i") < F.col("j")))
    return met.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))


def pairs_without(nodes: DataFrame, links: DataFrame, id_col: str = "node_id", tile: int = TILE) -> DataFrame:
    """(i, j) for all i < j that are no row (i, j) of ``links``.

    The links go to the pair of tiles of their ends, so the pairs themselves are
    never shuffled.
    """
    ids, tiles = _id_tiles(nodes, id_col, tile)
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    placed = ids.withColumn("b", tile_of("id", tiles)).withColumn("o", other).select(F.least("b", "o").alias("ti"), F.greatest("b", "o").alias("tj"), "b", "id")
    a, b = tile_of("i", tiles), tile_of("j", tiles)
    known = links.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j")).select(F.least(a, b).alias("ti"), F.greatest(a, b).alias("tj"), "i", "j")

    def run(key: tuple, t: pa.Table, drop: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({"i": pa.array([], pa.int64()), "j": pa.array([], pa.int64())})
        own, names = t.column("b").to_numpy(), t.column("id").to_numpy()
        left, right = np.sort(names[own == key[0].as_py()]), np.sort(names[own == key[1].as_py()])
        free = left[:, None] < right[None] if key[0].as_py() == key[1].as_py() else np.ones((len(left), len(right)), bool)
        i, j = drop.column("i").to_numpy(), drop.column("j").to_numpy()
        for x, y in ((i, j), (j, i)):
            at, to = np.searchsorted(left, x), np.searchsorted(right, y)
            hit = (at < len(left)) & (to < len(right))
            at, to, x, y = at[hit], to[hit], x[hit], y[hit]
            hit = (left[at] == x) & (right[to] == y)
            free[at[hit], to[hit]] = False
        row, column = np.nonzero(free)
        return pa.table({"i": np.minimum(left[row], right[column]), "j": np.maximum(left[row], right[column])})

    return placed.groupBy("ti", "tj").cogroup(known.groupBy("ti", "tj")).applyInArrow(run, "i bigint, j bigint")


def gather(pairs: DataFrame, nodes: DataFrame, columns: list[str], id_col: str = "node_id") -> DataFrame:
    """Each pair with the columns of both ends, suffixed ``_i`` and ``_j``."""
    end = lambda s: nodes.select(F.col(id_col).alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns])
    return pairs.join(end("i"), "i").join(end("j"), "j")


def gathered_polar(pairs: DataFrame, nodes: DataFrame, id_col: str = "node_id") -> DataFrame:
    g = gather(pairs, nodes, ["r", "v"], id_col)
    return g.withColumn("d", distances.polar(F.col("r_i"), F.col("v_i"), F.col("r_j"), F.col("v_j"))).drop("r_i", "v_i", "r_j", "v_j")


def canonical(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)
