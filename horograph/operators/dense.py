"""Dense kernels on one bounded block: inverses, spectra, transport; and graph operators that do without one.

Kernels that hold N x N numbers refuse more than ``MAX_NODES`` nodes; each runs
in one Arrow task that gets the edges of the graph.  The forest matrix, the
embedding of hops and the two spectral embeddings hold rows or blocks only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horograph.operators import spectral
from horograph.runtime import is_small, materialize, tasks_of

MAX_NODES = 5000
#: Up to so many nodes the whole matrix of hops is taken apart in one task.
WHOLE_NODES = 2000


def adjacency(rows: pd.DataFrame, ids: np.ndarray | None = None, weighted: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(sorted ids, symmetric matrix) of edges src, dst, weight."""
    if ids is None:
        ids = np.unique(np.r_[rows["src"].to_numpy(np.int64), rows["dst"].to_numpy(np.int64)])
    if len(ids) > MAX_NODES:
        raise ValueError(f"{len(ids)} nodes need a dense matrix of {len(ids)} squared; at most {MAX_NODES} are allowed")
    a = np.zeros((len(ids), len(ids)))
    i, j = np.searchsorted(ids, rows["src"]), np.searchsorted(ids, rows["dst"])
    a[i, j] = rows["weight"] if weighted else 1.0
    a[j, i] = a[i, j]
    return ids, a


def forest(a: np.ndarray) -> np.ndarray:
    """(I + L)^-1 with the weighted Laplacian L."""
    return np.linalg.inv(np.eye(len(a)) + np.diag(a.sum(axis=1)) - a)


def forest_edge_update(q: np.ndarray, i: int, j: int, change: float) -> np.ndarray:
    """The forest matrix after the weight of edge (i, j) grew by ``change``: a rank-one update."""
    u = q[:, i] - q[:, j]
    return q - np.outer(u, u) * (change / (1 + change * (u[i] - u[j])))


def forest_add_node(q: np.ndarray, neighbours: dict[int, float]) -> np.ndarray:
    """The forest matrix with one more node: a bordered unit row, then one update per new edge."""
    n = len(q)
    out = np.zeros((n + 1, n + 1))
    out[:n, :n], out[n, n] = q, 1.0
    for j, w in neighbours.items():
        out = forest_edge_update(out, n, j, w)
    return out


def hop_matrix(a: np.ndarray, weighted: bool = False) -> np.ndarray:
    """All-pairs shortest paths; unreachable pairs are infinite."""
    n = len(a)
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0.0)
    if weighted:
        d = np.where(a > 0, a, d)
        np.fill_diagonal(d, 0.0)
        for k in range(n):
            np.minimum(d, d[:, k, None] + d[None, k], out=d)
        return d
    reach, front = np.eye(n, dtype=bool), np.eye(n, dtype=bool)
    link = (a > 0).astype(np.float32)
    hop = 0
    while front.any():
        hop += 1
        front = ((front.astype(np.float32) @ link) > 0) & ~reach
        d[front] = hop
        reach |= front
    return d


def polar_block(rows: np.ndarray, r: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Distances of the nodes ``rows`` to all."""
    gap = np.maximum(0.0, 2.0 - 2.0 * v[rows] @ v.T)
    m = np.maximum(0.0, 2 * np.sinh((r[rows, None] - r[None]) / 2) ** 2 + 0.5 * np.outer(np.sinh(r[rows]), np.sinh(r)) * gap)
    return np.log1p(m + np.sqrt(m * (m + 2) + 1e-30))


def polar_matrix(r: np.ndarray, v: np.ndarray) -> np.ndarray:
    gap = np.maximum(0.0, 2.0 - 2.0 * v @ v.T)
    m = np.maximum(0.0, 2 * np.sinh((r[:, None] - r[None]) / 2) ** 2 + 0.5 * np.outer(np.sinh(r), np.sinh(r)) * gap)
    d = np.log1p(m + np.sqrt(m * (m + 2) + 1e-30))
    np.fill_diagonal(d, 0.0)
    return d


def hydra_points(time: np.ndarray, space: np.ndarray, low: np.ndarray, alpha: float = 1.1, equi: float = 0.5, isotropic: bool | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(r, directions) from the vector of the largest value and those of the smallest values ``low`` of the Gram matrix."""
    n, dim = space.shape
    time = -time if time[0] < 0 else time
    if isotropic is False or (isotropic is None and dim == 2):
        space = space * np.sqrt(np.maximum(-low, 0.0))
    size = np.linalg.norm(space, axis=1, keepdims=True)
    direction = np.where(size > 0, space / np.where(size > 0, size, 1.0), np.eye(1, dim))
    floor = min(1.0, float(time.min()))
    rho = np.sqrt(np.maximum(0.0, (alpha * time - floor) / (alpha * time + floor)))
    if dim == 2 and equi > 0:
        angle = np.arctan2(space[:, 1], space[:, 0])
        place = np.empty(n, int)
        place[np.argsort(angle, kind="stable")] = np.arange(n)
        even = -math.pi + 2 * math.pi * place / n
        angle = (1 - equi) * angle + equi * even
        direction = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    return 2 * np.arctanh(np.minimum(rho, 1 - 1e-12)), direction


def hydra(d: np.ndarray, dim: int = 2, curvature: float = 1.0, alpha: float = 1.1, equi: float = 0.5, isotropic: bool | None = None) -> dict:
    """Spectral embedding of a distance matrix: norm in the ball, directions, stress and strain."""
    gram = np.cosh(math.sqrt(curvature) * d)
    if not np.isfinite(gram).all():
        raise ValueError("distances are too large for this curvature")
    values, vectors = np.linalg.eigh(gram)
    r, direction = hydra_points(vectors[:, -1] * math.sqrt(values[-1]), vectors[:, :dim], values[:dim], alpha, equi, isotropic)
    upper = np.triu_indices(len(d), 1)
    fitted = polar_matrix(r, direction)[upper] / math.sqrt(curvature)
    dropped = np.r_[values[dim:-1]]
    return {"r": r, "v": direction, "curvature": curvature, "stress": float(np.sqrt(((fitted - d[upper]) ** 2).sum())), "strain": float(np.sqrt((dropped**2).sum()))}


def golden_section(f: Callable[[float], float], low: float, high: float, steps: int = 60) -> float:
    g = (math.sqrt(5) - 1) / 2
    a, b = high - g * (high - low), low + g * (high - low)
    fa, fb = f(a), f(b)
    for _ in range(steps):
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - g * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + g * (high - low)
            fb = f(b)
        if high - low < 1e-10:
            break
    return (low + high) / 2


def hydra_best_curvature(d: np.ndarray, dim: int = 2, **kw) -> dict:
    return best_curvature(lambda c: hydra(d, dim, c, **kw), float(d.max()))


def best_curvature(fit: Callable[[float], dict], diameter: float) -> dict:
    """Curvature by golden section on the stress up to (8 / diameter)^2, never worse than curvature 1."""
    top = (8.0 / max(diameter, 1e-12)) ** 2
    best = fit(golden_section(lambda c: fit(c)["stress"], 1e-8, top))
    try:
        plain = fit(1.0)
    except ValueError:
        return best
    return plain if plain["stress"] < best["stress"] else best


def laplacian_eigenmaps(a: np.ndarray, dim: int) -> np.ndarray:
    """Unit rows of the eigenvectors 1..dim of the symmetric normalised Laplacian."""
    s = a.sum(axis=1)
    root = np.where(s > 0, 1 / np.sqrt(np.where(s > 0, s, 1.0)), 0.0)
    lap = np.eye(len(a)) - root[:, None] * a * root[None]
    _, vectors = np.linalg.eigh((lap + lap.T) / 2)
    return unit_rows(vectors[:, 1 : dim + 1])


def unit_rows(u: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(u, axis=1, keepdims=True)
    return np.where(n > 1e-12, u / np.where(n > 1e-12, n, 1.0), np.eye(1, u.shape[1]))


def laplacian_pairs(rows: spectral.LocalRows | None, times: spectral.Product, n: int, dim: int) -> np.ndarray:
    """The eigenvectors 0..dim of the symmetric normalised Laplacian, as columns.

    The null space is known: the roots of the strengths inside each component.
    The first vector has all of them; the next ones set the components apart,
    the largest first.
    """
    strength = times(np.ones((n, 1)))[:, 0]
    root = np.where(strength > 0, 1 / np.sqrt(np.where(strength > 0, strength, 1.0)), 0.0)[:, None]
    null = np.sqrt(np.maximum(strength, 0.0))[:, None]
    if rows is not None:
        label = rows.components()
        parts, size = np.unique(label[strength > 0], return_counts=True)
        for c in parts[np.argsort(-size, kind="stable")][: min(dim, len(parts) - 1)]:
            null = np.hstack([null, np.where(label == c, null[:, 0], 0.0)[:, None]])
    null = np.linalg.qr(null)[0] * -1.0
    if null.shape[1] > dim:
        return null[:, : dim + 1]
    # a shift by 1 makes the largest value of the adjacency the largest by modulus too
    _, rest = spectral.outer_pairs(lambda x: root * times(root * x) + x, n, dim + 1 - null.shape[1], spectral.by_value, null)
    return np.hstack([null, rest])


def spectral_embedding(a: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Adjacency spectral embedding: (X, signs) with X diag(signs) X' the best rank-``dim`` fit by modulus."""
    values, vectors = np.linalg.eigh(a)
    top = np.argsort(-np.abs(values), kind="stable")[:dim]
    return vectors[:, top] * np.sqrt(np.abs(values[top])), np.sign(values[top])


def hyperbolicity(d: np.ndarray, quads: np.ndarray) -> np.ndarray:
    """Four-point delta of each row of ``quads``: half the gap between the two largest sums."""
    a, b, c, e = quads.T
    s = np.sort(np.stack([d[a, b] + d[c, e], d[a, c] + d[b, e], d[a, e] + d[b, c]], axis=1), axis=1)
    return (s[:, 2] - s[:, 1]) / 2


def transport_cost(supply: np.ndarray, demand: np.ndarray, cost: np.ndarray) -> float:
    """Least cost of moving ``supply`` to ``demand``: successive shortest paths with potentials on the bipartite graph."""
    s, t = supply.astype(float).copy(), demand.astype(float).copy()
    m, n = cost.shape
    flow = np.zeros((m, n))
    pu, pv = np.zeros(m), np.zeros(n)
    total = 0.0
    while s.max(initial=0.0) > 1e-12 and t.max(initial=0.0) > 1e-12:
        du, dv = np.where(s > 1e-12, 0.0, np.inf), np.full(n, np.inf)
        from_u, from_v = np.full(n, -1), np.full(m, -1)
        done_u, done_v = np.zeros(m, bool), np.zeros(n, bool)
        while True:
            iu = int(np.where(done_u, np.inf, du).argmin())
            iv = int(np.where(done_v, np.inf, dv).argmin())
            best_u = np.inf if done_u[iu] else du[iu]
            best_v = np.inf if done_v[iv] else dv[iv]
            if min(best_u, best_v) == np.inf:
                break
            if best_u <= best_v:
                done_u[iu] = True
                new = best_u + np.maximum(0.0, cost[iu] + pu[iu] - pv)
                better = ~done_v & (new < dv - 1e-15)
                dv[better], from_u[better] = new[better], iu
            else:
                done_v[iv] = True
                if t[iv] > 1e-12:
                    break
                new = best_v + np.maximum(0.0, -(cost[:, iv] + pu - pv[iv]))
                better = ~done_u & (flow[:, iv] > 1e-15) & (new < du - 1e-15)
                du[better], from_v[better] = new[better], iv
        end = int(np.where(t > 1e-12, dv, np.inf).argmin())
        reach = dv[end]
        if not np.isfinite(reach):
            break
        path, v = [], end
        while True:
            u = int(from_u[v])
            path.append((u, v, 1))
            if from_v[u] < 0 or s[u] > 1e-12 and du[u] == 0:
                break
            path.append((u, int(from_v[u]), -1))
            v = int(from_v[u])
        amount = min(s[path[-1][0]], t[end], *[flow[a, b] for a, b, sign in path if sign < 0] or [np.inf])
        for a, b, sign in path:
            flow[a, b] += sign * amount
            total += sign * amount * cost[a, b]
        s[path[-1][0]] -= amount
        t[end] -= amount
        pu += np.minimum(du, reach)
        pv += np.minimum(dv, reach)
    return total


def ricci(a: np.ndarray, edges: np.ndarray, alpha: float = 0.5, cap: int = 25, cutoff: int = 3, seed: int = 0) -> np.ndarray:
    """Ollivier-Ricci curvature of the given edges (index pairs): 1 - W1 of the lazy walks at both ends."""
    rng = np.random.default_rng(seed)
    link = a > 0
    d = np.minimum(hop_matrix(a), cutoff)

    def walk(i: int) -> tuple[np.ndarray, np.ndarray]:
        near = np.flatnonzero(link[i])
        if len(near) > cap:
            near = rng.choice(near, cap, replace=False)
        return np.r_[i, near], np.r_[alpha, np.full(len(near), (1 - alpha) / max(1, len(near)))]

    out = []
    for i, j in edges:
        (x, p), (y, q) = walk(i), walk(j)
        out.append(1.0 - transport_cost(p / p.sum(), q / q.sum(), d[np.ix_(x, y)]))
    return np.array(out)


def checked_nodes(edges: DataFrame) -> int:
    """The number of nodes; raises beyond MAX_NODES before any task gets the edges."""
    n = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct().count()
    if n > MAX_NODES:
        raise ValueError(f"{n} nodes need a dense matrix of {n} squared; at most {MAX_NODES} are allowed")
    return n


def on_graph(edges: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], pd.DataFrame], schema: str, weighted: bool = True) -> DataFrame:
    """Run ``kernel(ids, matrix)`` in one task, after a count shows that it gets at most MAX_NODES nodes."""
    checked_nodes(edges)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return kernel(*adjacency(rows, weighted=weighted))

    return edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).groupBy(F.lit(0).alias("all")).applyInPandas(lambda rows: run(rows), schema)


def numbered_edges(rows: pd.DataFrame) -> tuple[np.ndarray, spectral.LocalRows]:
    """(sorted ids, rows of the matrix) of edges src, dst, weight."""
    ids, at = np.unique(rows[["src", "dst"]].to_numpy(np.int64).ravel(), return_inverse=True)
    i, j = at.reshape(-1, 2).T
    return ids, spectral.LocalRows(i, j, rows["weight"].to_numpy(float), len(ids))


def on_rows(edges: DataFrame, solve: Callable, columns: Callable[[object], dict], schema: str) -> DataFrame:
    """(node_id, the columns of ``schema``) of ``solve(rows, product, nodes)``.

    Up to ``spectral.LOCAL_EDGES`` edges one task holds the rows of the graph;
    beyond, the rows stay in the cluster, ``rows`` is None and this process
    holds blocks of vectors only.
    """
    edges = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    edges = materialize(edges)

    def frame(ids: np.ndarray, found: object) -> pd.DataFrame:
        return pd.DataFrame({"node_id": ids} | {k: x.tolist() for k, x in columns(found).items()})

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ids, rows = numbered_edges(part)
        return frame(ids, solve(rows, rows.times, len(ids)))

    schema = f"node_id bigint, {schema}"
    if is_small(edges, spectral.LOCAL_EDGES):
        return edges.groupBy(F.lit(0).alias("all")).applyInPandas(lambda part: run(part), schema)
    from horograph.operators.graph import relabel

    small, table = relabel(edges)
    ids = table.orderBy("pos").select("node_id").toPandas()["node_id"].to_numpy()
    return edges.sparkSession.createDataFrame(frame(ids, solve(None, spectral.shared_product(small, len(ids)), len(ids))), schema)


def apart(rows: spectral.LocalRows) -> np.ndarray:
    """Which nodes to eliminate first: no two of them are linked, those of few links are preferred."""
    chosen, free = np.zeros(rows.n, bool), np.ones(rows.n, bool)
    for k in np.argsort(np.diff(rows.begin), kind="stable"):
        if free[k]:
            chosen[k] = True
            free[rows.cols[rows.begin[k] : rows.begin[k + 1]]] = False
    return chosen


def invert_in_place(a: np.ndarray, block: int = 512) -> np.ndarray:
    """The inverse of a symmetric positive definite matrix in its own place, by blocks of pivots."""
    n = len(a)
    for s in range(0, n, block):
        k = slice(s, min(n, s + block))
        pivot = np.linalg.inv(a[k, k])
        row = pivot @ a[k]
        row[:, k] = 0.0
        for t in range(0, n, block):
            if t != s:
                i = slice(t, min(n, t + block))
                left = a[i, k].copy()
                a[i] -= left @ row
                a[i, k] = -left @ pivot
        a[k], a[k, k] = row, pivot
    return a


def forest_matrix(edges: DataFrame) -> DataFrame:
    """(i, j, q) for all ordered pairs, whatever the number of nodes: an output of quadratic size.

    Nodes that are not linked to each other are eliminated, since their part of
    I + L is diagonal; one task inverts what is left of the matrix and gives
    each row of the result at the nodes left, from which the rows follow in
    many tasks.
    """
    spark = edges.sparkSession
    # fewer numbers than the output has
    part = edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).toPandas()
    if not len(part):
        return spark.createDataFrame([], "i bigint, j bigint, q double")
    ids, rows = numbered_edges(part)
    shared = spark.sparkContext.broadcast((ids, rows, apart(rows)))

    def solved(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, out = shared.value
        n, place = len(ids), np.cumsum(~out) - 1
        core = np.flatnonzero(~out)
        d = 1.0 + rows.strengths()
        s = np.zeros((len(core), len(core)))
        s[np.arange(len(core)), np.arange(len(core))] = d[core]
        links = {}
        for k in range(n):
            lo, hi = rows.begin[k], rows.begin[k + 1]
            cols, vals = rows.cols[lo:hi], rows.vals[lo:hi]
            if out[k]:
                c = place[cols]
                s[np.ix_(c, c)] -= np.outer(vals, vals / d[k])
                links[k] = (c, vals / d[k])
            else:
                inner = ~out[cols]
                s[place[k], place[cols[inner]]] -= vals[inner]
        s = invert_in_place(s)
        for k in range(n):
            y = links[k][1] @ s[links[k][0]] if out[k] else s[place[k]]
            yield pa.record_batch({"pos": pa.array([k], pa.int64()), "y": pa.array([np.ascontiguousarray(y).tobytes()], pa.binary())})

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, out = shared.value
        place, d = np.cumsum(~out) - 1, 1.0 + rows.strengths()
        keep = np.repeat(out, np.diff(rows.begin))
        cols, vals = place[rows.cols[keep]], rows.vals[keep]
        begin = np.r_[0, np.cumsum(np.diff(rows.begin)[out])][:-1]
        for b in batches:
            for k, y in zip(b.column("pos").to_pylist(), b.column("y")):
                y = np.frombuffer(y.as_buffer(), float)
                q = np.empty(len(ids))
                q[~out] = y
                q[out] = np.add.reduceat(y[cols] * vals, begin) / d[out]
                if out[k]:
                    q[k] += 1 / d[k]
                yield pa.record_batch({"i": pa.array(np.full(len(ids), ids[k])), "j": pa.array(ids), "q": pa.array(q)})

    rows_of = spark.range(0, 1, 1, 1).mapInArrow(solved, "pos bigint, y binary")
    return rows_of.repartition(max(tasks_of(edges), len(ids) // 256)).mapInArrow(whole, "i bigint, j bigint, q double")


class HopBlocks:
    """The hops between all pairs of nodes in blocks of rows that stay in the cluster; pairs without a way have 0."""

    def __init__(self, edges: DataFrame) -> None:
        self.spark = spark = edges.sparkSession
        self.ids, rows = numbered_edges(edges.select("src", "dst", F.lit(1.0).alias("weight")).toPandas())
        self.n = n = len(self.ids)
        size = max(64, min(512, 32_000_000 // n // 64 * 64))
        shared = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for start in b.column("id").to_pylist():
                    h = np.maximum(shared.value.hops(np.arange(start, min(n, start + size))), 0)
                    wide = bool(h.max() > 255)
                    h = h.astype(np.uint16 if wide else np.uint8)
                    yield pa.record_batch({"start": pa.array([start], pa.int64()), "hops": pa.array([h.tobytes()], pa.binary()), "wide": pa.array([wide]), "counts": pa.array([np.bincount(h.ravel())], pa.list_(pa.int64()))})

        self.blocks = materialize(spark.range(0, n, size, max(1, min(-(-n // size), 4 * tasks_of(edges)))).mapInArrow(run, "start bigint, hops binary, wide boolean, counts array<bigint>"))
        counts = [np.array(r["counts"]) for r in self.blocks.select("counts").toLocalIterator()]
        self.counts = sum(np.pad(c, (0, max(map(len, counts)) - len(c))) for c in counts)

    def on_blocks(self, f: Callable[[int, np.ndarray, object], np.ndarray], sent: object) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, ``f(first row, hops, sent)``) of every few rows."""
        n, sent = self.n, self.spark.sparkContext.broadcast(sent)
        step = max(1, spectral.CHUNK // n)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for start, data, wide in zip(b.column("start").to_pylist(), b.column("hops"), b.column("wide").to_pylist()):
                    h = np.frombuffer(data.as_buffer(), np.uint16 if wide else np.uint8).reshape(-1, n)
                    for s in range(0, len(h), step):
                        yield pa.record_batch({"start": pa.array([start + s], pa.int64()), "y": pa.array([f(start + s, h[s : s + step], sent.value).tobytes()], pa.binary())})

        for b in self.blocks.select("start", "hops", "wide").mapInArrow(run, "start bigint, y binary").toArrow().to_batches():
            for start, y in zip(b.column("start").to_pylist(), b.column("y")):
                yield start, np.frombuffer(y.as_buffer(), float)
        sent.destroy()

    def hydra(self, dim: int, curvature: float) -> dict:
        root, n = math.sqrt(curvature), self.n
        cosh = np.cosh(root * np.arange(len(self.counts)))
        if not np.isfinite(cosh).all():
            raise ValueError("distances are too large for this curvature")

        def product(x: np.ndarray) -> np.ndarray:
            out = np.empty_like(x)
            for start, y in self.on_blocks(lambda s, h, sent: sent[0][h] @ sent[1], (cosh, x)):
                y = y.reshape(-1, x.shape[1])
                out[start : start + len(y)] = y
            return out

        values, vectors = spectral.outer_pairs(product, n, dim + 1, spectral.both_ends, steps=6)
        r, v = hydra_points(vectors[:, 0] * math.sqrt(values[0]), vectors[:, 1:], values[1:])

        def gaps(s: int, h: np.ndarray, sent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
            i = np.arange(s, s + len(h))
            fitted = polar_block(i, *sent) / root
            return np.array([np.where(np.arange(n)[None] > i[:, None], (fitted - h) ** 2, 0.0).sum()])

        stress = math.sqrt(sum(float(y[0]) for _, y in self.on_blocks(gaps, (r, v))))
        strain = math.sqrt(max(0.0, float(self.counts @ cosh**2) - float(values @ values)))
        return {"r": r, "v": v, "curvature": curvature, "stress": stress, "strain": strain}


def hydra_embedding(edges: DataFrame, dim: int = 2, curvature: float | None = 1.0, weighted: bool = False) -> DataFrame:
    """(node_id, r, v, curvature, stress, strain); unreachable pairs get distance 0.

    Beyond ``WHOLE_NODES`` nodes the hops stay in the cluster in blocks of rows;
    only distances by weight are bound to a matrix in one task.
    """
    schema = "node_id bigint, r double, v array<double>, curvature double, stress double, strain double"

    def frame(ids: np.ndarray, h: dict) -> pd.DataFrame:
        return pd.DataFrame({"node_id": ids, "r": h["r"], "v": h["v"].tolist(), "curvature": h["curvature"], "stress": h["stress"], "strain": h["strain"]})

    def kernel(ids: np.ndarray, a: np.ndarray) -> pd.DataFrame:
        d = hop_matrix(a, weighted)
        d[~np.isfinite(d)] = 0.0
        return frame(ids, hydra_best_curvature(d, dim) if curvature is None else hydra(d, dim, curvature))

    edges = materialize(edges)
    if weighted or edges.select(F.explode(F.array("src", "dst"))).distinct().count() <= WHOLE_NODES:
        return on_graph(edges, kernel, schema)
    b = HopBlocks(edges)
    h = best_curvature(lambda c: b.hydra(dim, c), len(b.counts) - 1.0) if curvature is None else b.hydra(dim, curvature)
    return edges.sparkSession.createDataFrame(frame(b.ids, h), schema)


def eigenmaps(edges: DataFrame, dim: int = 2) -> DataFrame:
    """(node_id, v); the graph is held by its rows, whatever the number of nodes."""
    return on_rows(edges, lambda rows, times, n: laplacian_pairs(rows, times, n, dim)[:, 1 : dim + 1], lambda u: {"v": unit_rows(u)}, "v array<double>")


def adjacency_spectral(edges: DataFrame, dim: int = 8) -> DataFrame:
    """(node_id, x, signs); the graph is held by its rows, whatever the number of nodes."""
    edges = edges.select("src", "dst", F.lit(1.0).alias("weight"))

    def solve(rows: spectral.LocalRows | None, times: spectral.Product, n: int) -> tuple[np.ndarray, np.ndarray]:
        values, vectors = spectral.outer_pairs(times, n, dim)
        return vectors * np.sqrt(np.abs(values)), np.sign(values)

    return on_rows(edges, solve, lambda f: {"x": f[0], "signs": np.repeat(f[1][None], len(f[0]), axis=0)}, "x array<double>, signs array<double>")
