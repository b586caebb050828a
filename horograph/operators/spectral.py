"""Outer eigenpairs of large symmetric matrices that are only known by their products.

``outer_pairs`` is a block Krylov method with restarts: it holds a few blocks of
vectors, never the matrix.  Products come from the rows of a graph in one task
(``LocalRows``) or, beyond ``LOCAL_EDGES`` edges, from rows that stay in the
cluster (``shared_product``), one Spark job each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many edges a graph is held by one task (some 40 bytes an edge and direction).
LOCAL_EDGES = 4_000_000
#: Numbers that one step of a product, and all blocks of vectors, hold at once.
CHUNK, VECTORS = 4_000_000, 20_000_000

Product = Callable[[np.ndarray], np.ndarray]


class LocalRows:
    """Rows of a symmetric matrix on 0..n-1, each with at least one entry."""

    def __init__(self, i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int) -> None:
        tail, head, both = np.r_[i, j], np.r_[j, i], np.r_[w, w].astype(float)
        order = np.argsort(tail, kind="stable")
        self.n, self.cols, self.vals = n, head[order].astype(np.int32), both[order]
        self.begin = np.r_[0, np.cumsum(np.bincount(tail, minlength=n))]

    def slices(self, width: int) -> Iterator[tuple[int, int]]:
        """Ranges of rows of at most CHUNK numbers in ``width`` columns, or of one row."""
        at, most = 0, max(1, CHUNK // width)
        while at < self.n:
            end = max(at + 1, int(np.searchsorted(self.begin, self.begin[at] + most, side="right")) - 1)
            yield at, end
            at = end

    def times(self, x: np.ndarray) -> np.ndarray:
        # column by column: gathers from a short vector stay in the cache
        return np.stack([np.add.reduceat(c.take(self.cols) * self.vals, self.begin[:-1]) for c in np.ascontiguousarray(x.T)], axis=1)

    def any_near(self, x: np.ndarray) -> np.ndarray:
        """The bits that any neighbour has."""
        out = np.empty_like(x)
        for a, b in self.slices(x.shape[1]):
            lo = self.begin[a]
            out[a:b] = np.bitwise_or.reduceat(x[self.cols[lo : self.begin[b]]], self.begin[a:b] - lo, axis=0)
        return out

    def strengths(self) -> np.ndarray:
        return np.add.reduceat(self.vals, self.begin[:-1])

    def components(self) -> np.ndarray:
        """The smallest node of the component of every node; entries of 0 don't link."""
        on = self.vals != 0
        rows, cols = np.repeat(np.arange(self.n), np.diff(self.begin))[on], self.cols[on]
        label = np.arange(self.n)
        while True:
            near = label.copy()
            np.minimum.at(near, rows, label[cols])
            near = near[near]
            if np.array_equal(near, label):
                return label
            label = near

    def hops(self, sources: np.ndarray) -> np.ndarray:
        """Hops from each source to every node, -1 where there is no way: 64 searches in one word."""
        words = -(-len(sources) // 64)
        seen = np.zeros((self.n, words), np.uint64)
        k = np.arange(len(sources))
        np.bitwise_or.at(seen, (sources, k // 64), np.uint64(1) << (k % 64).astype(np.uint64))
        out = np.full((self.n, len(sources)), -1, np.int16)
        out[sources, k] = 0
        front, hop = seen.copy(), 0
        while True:
            hop += 1
            front = self.any_near(front) & ~seen
            rows = np.flatnonzero(front.any(axis=1))
            if not len(rows):
                return out.T
            seen |= front
            bits = np.unpackbits(front[rows].view(np.uint8), axis=1, bitorder="little")[:, : len(sources)].astype(bool)
            part = out[rows]
            part[bits] = hop
            out[rows] = part


def shared_product(edges: DataFrame, n: int) -> Product:
    """Products with the matrix of edges (src, dst, weight) on 0..n-1: its rows stay in the cluster, a product is one job."""
    from horograph.operators.graph import directed
    from horograph.runtime import materialize

    rows = materialize(directed(edges).groupBy(F.col("src").alias("pos")).agg(F.collect_list("dst").alias("cols"), F.collect_list(F.col("weight").cast("double")).alias("vals")))
    spark = edges.sparkSession

    def times(x: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(x)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                pos, cols, vals = b.column("pos").to_numpy(), b.column("cols"), b.column("vals")
                at, y = np.r_[0, np.cumsum(cols.value_lengths().to_numpy())], np.empty((len(pos), x_width))
                flat_c, flat_v = cols.flatten().to_numpy(), vals.flatten().to_numpy()
                for k in range(len(pos)):
                    y[k] = flat_v[at[k] : at[k + 1]] @ sent.value[flat_c[at[k] : at[k + 1]]]
                yield pa.record_batch({"pos": pa.array(pos), "y": pa.array(list(y), pa.list_(pa.float64()))})

        x_width = x.shape[1]
        out = np.zeros_like(x)
        for b in rows.mapInArrow(run, "pos bigint, y array<double>").toArrow().to_batches():
            out[b.column("pos").to_numpy()] = b.column("y").flatten().to_numpy().reshape(-1, x.shape[1])
        sent.destroy()
        return out

    return times


def by_modulus(values: np.ndarray) -> np.ndarray:
    return np.argsort(-np.abs(values), kind="stable")


def by_value(values: np.ndarray) -> np.ndarray:
    return np.argsort(-values, kind="stable")


def both_ends(values: np.ndarray) -> np.ndarray:
    """The largest first, then from the smallest up."""
    order = np.argsort(values, kind="stable")
    return np.r_[order[-1:], order[:-1]]


def outer_pairs(product: Product, n: int, count: int, order: Callable[[np.ndarray], np.ndarray] = by_modulus, away: np.ndarray | None = None, tolerance: float = 1e-10, rounds: int = 2000, steps: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the first ``count`` eigenpairs by ``order``, orthogonal to the columns of ``away``.

    A round spans the products of a block and joins the best vectors of that
    space; it ends when no residual is above ``tolerance`` times the largest
    value.  The largest entry of a vector is positive.
    """
    held = np.zeros((n, 0)) if away is None else away
    room = n - held.shape[1]
    count = min(count, room)
    width = min(room, count + 8)
    steps = max(1, min(steps, room // width, max(3, VECTORS // (2 * n * width))))

    def clean(x: np.ndarray, *known: np.ndarray) -> np.ndarray:
        for _ in range(3):
            for k in (held, *known):
                x = x - k @ (k.T @ x)
            x = np.linalg.qr(x)[0]
        return x

    block = clean(np.random.default_rng(0).normal(size=(n, width)))
    for _ in range(rounds):
        space, images = [block], []
        for s in range(steps):
            images.append(product(space[-1]))
            if s + 1 < steps:
                space.append(clean(images[-1], *space))
        basis, image = np.hstack(space), np.hstack(images)
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        first = order(values)[:width]
        values, block = values[first], basis @ turn[:, first]
        gap = np.linalg.norm(image @ turn[:, first] - block * values, axis=0)[:count]
        if count == 0 or gap.max() <= tolerance * max(np.abs(values).max(), 1e-300):
            vectors = block[:, :count]
            sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(count)])
            return values[:count], vectors * np.where(sign == 0, 1.0, sign)
    raise RuntimeError(f"eigenpairs did not settle in {rounds} rounds")
