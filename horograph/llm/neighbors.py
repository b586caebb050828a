"""The k most similar vectors for every vector, by hyperbolic distance.

Equal vectors are searched once: a distinct vector stands for all its copies,
and its neighbours are filled up with the smallest ids of each group of copies
(no more than ``k + 1`` of them can matter).

``build`` fits the codebooks on at most ``sample_rows`` distinct vectors and
encodes every vector.  The first codebook are the centres of cells of about
``cell_rows`` rows: cells that are crowded in the sample are split there, and
those crowded in the whole collection are split on rows of their own, cell by
cell in parallel, until none is left.  How many of the nearest cells a vector
probes is chosen on the sample so that they hold a share ``target`` of all true
neighbours; the choice, the share of the collection that it scores and the
recall can be read from ``Index.profile`` and ``recall``.

Cells that lie together form regions of at most ``region_rows`` rows.  A vector
travels once to each region it probes, not once per cell, and its codes and
norms stay with the region of its own cell.  In a region points are scored by
look-up in the stored codes and norms, and the exact vector is read only for
the ``rerank`` best of each query.  The exact vectors lie there because, at 136
bytes each, moving them once costs less than fetching the survivors of every
query by a join.  A region that gets very many queries, or a cell that cannot
be split, becomes several tasks.

Defined results: null, short or long vectors, null or non-finite entries and
norms of 1 or more are unusable and neither ask nor answer; equal distances go
to the smaller id; a vector is not its own neighbour; with fewer than ``k``
other vectors all of them are returned where the probed cells hold them; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from horograph.llm.additive_quant import (
    CROWDED,
    LEAST_FIT,
    Points,
    Quantizer,
    choose_probes,
    fit_books,
    fit_cells,
    lift,
    lorentz_kmeans,
    nearest_centre,
    nearest_of,
    search,
    split_cell,
)
from horograph.runtime import hot_keys, is_small, materialize, skew_join

#: Rows of the sample that ask for the choice of probes, and rows the residual codebooks are fitted on.
PROBE_ASKS, BOOK_ROWS = 2048, 20_000


def usable(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    x = F.col(vec_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    norm2 = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
    return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) == dim)).where(finite & (norm2 < 1.0)).select(F.col(id_col).cast("bigint").alias("id"), x.alias("x"))


def _matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = col.flatten() if isinstance(col, pa.Array) else col.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def _bytes(a: np.ndarray) -> pa.Array:
    """One binary value per row of a matrix."""
    a = np.ascontiguousarray(a)
    width = a.shape[1] * a.itemsize
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(np.arange(0, (len(a) + 1) * width, max(width, 1), dtype=np.int32)[: len(a) + 1] if width else np.zeros(len(a) + 1, np.int32)), pa.py_buffer(a.tobytes())])


def _joined(a: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value per run of ``counts`` int32 numbers."""
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(np.r_[0, 4 * np.cumsum(counts)].astype(np.int32)), pa.py_buffer(a.astype(np.int32).tobytes())])


def _read(col: pa.Array | pa.ChunkedArray, kind: str, width: int | None = None) -> np.ndarray:
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], pa.binary())
    _, offsets, data = a.buffers()
    o = np.frombuffer(offsets, np.int32)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int32)
    flat = np.frombuffer(data if data is not None else b"", np.uint8)[o[0] : o[-1]].view(kind)
    return flat if width is None else flat.reshape(-1, width)


def _lengths(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.binary_length(col).to_numpy(zero_copy_only=False)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from (b.slice(s, rows) for s in range(0, b.num_rows, rows))


def _crowded(distinct: DataFrame, centres: np.ndarray, dim: int, cell_rows: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Splits every cell that is crowded in the whole collection, each on a sample of its own rows."""
    sc = distinct.sparkSession.sparkContext
    for turn in range(rounds):
        shared = sc.broadcast(centres)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(shared.value), np.int64)
            for b in _slices(batches):
                total += np.bincount(nearest_centre(lift(_matrix(b.column("x"), dim)), shared.value), minlength=len(total))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

        size = np.zeros(len(centres), np.int64)
        for r in distinct.select("x").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            size[r["cell"]] = r["n"]
        crowded = size > CROWDED * cell_rows
        if not crowded.any():
            break
        # wanted parts of a crowded cell and the share of its rows they are fitted on
        parts = np.where(crowded, np.minimum(256, 2 * -(-size // cell_rows)), 0)
        rate = sc.broadcast(np.minimum(1.0, 2.0 * LEAST_FIT * parts / np.maximum(size, 1)))

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _slices(batches):
                cell = nearest_centre(lift(_matrix(b.column("x"), dim)), shared.value)
                ids = b.column("id").to_numpy().astype(np.uint64) + np.uint64(turn)
                u = ((ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) / float(1 << 53)
                keep = pa.array(u < rate.value[cell])
                yield pa.RecordBatch.from_arrays([pa.array(cell).filter(keep), b.column("x").filter(keep)], names=["cell", "x"])

        def fit(key: tuple, t: pa.Table) -> pa.Table:
            c = key[0].as_py()
            new = split_cell(lift(_matrix(t.column("x"), dim)), shared.value[c], min(int(parts[c]), max(1, t.num_rows // 4)), seed + turn)
            return pa.table({"cell": pa.array([c] * len(new), pa.int64()), "h": pa.array(new.tolist(), pa.list_(pa.float64()))})

        new = distinct.select("id", "x").mapInArrow(draw, "cell bigint, x array<double>").groupBy("cell").applyInArrow(fit, "cell bigint, h array<double>").collect()
        children = Counter(r["cell"] for r in new)
        grown = [c for c, n in children.items() if n > 1]
        if not grown:
            break
        added = sorted((r["cell"], r["h"]) for r in new if children[r["cell"]] > 1)
        centres = np.concatenate([np.delete(centres, grown, axis=0), np.array([h for _, h in added])])
    return centres


def group_cells(centres: np.ndarray, points: np.ndarray, region_rows: int, seed: int = 5) -> np.ndarray:
    """Region of every cell: cells that lie together, halved until a region has at most ``region_rows`` points or one cell."""
    region = np.zeros(len(centres), np.int32)
    todo, done = [np.arange(len(centres))], 0
    while todo:
        own = todo.pop()
        if len(own) == 1 or points[own].sum() <= region_rows:
            region[own] = done
            done += 1
            continue
        side = nearest_centre(centres[own], lorentz_kmeans(centres[own], 2, 6, seed))
        if side.min() == side.max():
            side = np.arange(len(own)) % 2
        todo += [own[side == 0], own[side == 1]]
    return region


def _encoder(shared, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Quantizer = shared.value
        for b in _slices(batches):
            x = np.ascontiguousarray(_matrix(b.column("x"), dim))
            cell, codes, norms, near = q.encode(lift(x))
            code = np.hstack([codes, norms.view(np.uint8).reshape(len(codes), -1)])
            yield pa.RecordBatch.from_arrays([b.column("id"), _bytes(x), b.column("copied"), pa.array(cell.astype(np.int32)), _bytes(code), _bytes(near.astype(np.int32))], names=["id", "x", "copied", "cell", "code", "probes"])

    return run


_CODED = "id bigint, x binary, copied boolean, cell int, code binary, probes binary"
_PLACED = "region int, p int, a int, id bigint, x binary, copied boolean, cell int, code binary, asks binary"


def _per_probe(shared, of):
    """Counts of ``of(cells, probed cells)``, a pair of arrays of numbers and an array of probes per row, per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            points, asks = of(shared.value, b.column("cell").to_numpy(), _read(b.column("probes"), "<i4").reshape(b.num_rows, -1))
            for at, values in enumerate((points, asks)):
                for c, n in zip(*np.unique(values, return_counts=True)):
                    total.setdefault(int(c), [0, 0])[at] += int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1] for v in total.values()], pa.int64())], names=["at", "points", "asks"])

    return run


def _pairs_of(probes: np.ndarray, region: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, region, cells in order, number of cells) for every region that a row probes."""
    width = probes.shape[1]
    row, cell = np.repeat(np.arange(len(probes)), width), probes.ravel()
    order = np.lexsort((region[cell], row))
    row, cell = row[order], cell[order]
    r = region[cell]
    start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (r[1:] != r[:-1])])
    return row[start], r[start], cell, np.diff(np.r_[start, len(row)])


def _router(shared):
    """Rows of ``coded`` sent to the tasks that need them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, point_parts, ask_parts = shared.value
        for b in _slices(batches):
            ids, own = b.column("id").to_numpy(), region[b.column("cell").to_numpy()]
            spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            own_p = (spread % point_parts[own].astype(np.uint64)).astype(np.int64)
            probes = _read(b.column("probes"), "<i4").reshape(b.num_rows, -1)
            row, r, cells, count = _pairs_of(probes, region)
            # an ask meets every part of the points of a region
            times = point_parts[r]
            which = np.repeat(np.arange(len(row)), times)
            p = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
            begin = np.cumsum(count) - count
            at = np.repeat(begin[which], count[which]) + np.arange(count[which].sum()) - np.repeat(np.cumsum(count[which]) - count[which], count[which])
            ask = row[which]
            a = (spread[ask] % ask_parts[r[which]].astype(np.uint64)).astype(np.int64)
            home = (r[which] == own[ask]) & (p == own_p[ask])
            # a point meets every part of the asks of its region; it is with its own ask already
            more = np.repeat(np.arange(len(ids)), ask_parts[own] - 1)
            step = np.arange(len(more)) - np.repeat(np.cumsum(ask_parts[own] - 1) - (ask_parts[own] - 1), ask_parts[own] - 1)
            own_a = (spread % ask_parts[own].astype(np.uint64)).astype(np.int64)
            others = (own_a[more] + 1 + step) % ask_parts[own[more]]
            take = pa.array(np.r_[ask, more])
            code = b.column("code").take(pa.array(np.r_[ask, more], mask=np.r_[~home, np.zeros(len(more), bool)]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[r[which], own[more]].astype(np.int32)),
                    pa.array(np.r_[p, own_p[more]].astype(np.int32)),
                    pa.array(np.r_[a, others].astype(np.int32)),
                    *(b.column(c).take(take) for c in ("id", "x", "copied", "cell")),
                    code,
                    _joined(cells[at], np.r_[count[which], np.zeros(len(more), np.int64)]),
                ],
                names=["region", "p", "a", "id", "x", "copied", "cell", "code", "asks"],
            )

    return run


def _searcher(shared, k: int, rerank: int, dim: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        q: Quantizer = shared.value
        ids, copied = t.column("id").to_numpy(), t.column("copied").to_numpy()
        h = lift(_read(t.column("x"), "<f8", dim))
        point = pc.is_valid(t.column("code")).to_numpy()
        m = len(q.books)
        code = _read(t.column("code").filter(pa.array(point)), "u1", m + 8)
        points = Points(t.column("cell").to_numpy()[point], ids[point], code[:, :m], np.ascontiguousarray(code[:, m:]).view("<f4").reshape(-1, 2), h[point])
        count = _lengths(t.column("asks")) // 4
        asking = np.flatnonzero(count)
        at = np.repeat(np.arange(len(asking)), count[asking])
        who, near, c, _ = search(q, points, h[asking], ids[asking], at, _read(t.column("asks"), "<i4"), k, rerank)
        runs = np.searchsorted(who, np.arange(len(asking) + 1)).astype(np.int32)
        lists = lambda v, kind: pa.ListArray.from_arrays(pa.array(runs), pa.array(v, kind))
        touched = copied[asking].copy()
        many = np.sort(ids[point & copied])
        if len(many) and len(near):
            hit = many[np.minimum(np.searchsorted(many, near), len(many) - 1)] == near
            np.logical_or.at(touched, who[hit], True)
        return pa.table({"id": ids[asking], "near": lists(near, pa.int64()), "c": lists(c, pa.float64()), "touched": touched})

    return run


@dataclass
class Index:
    """Codebooks, the coded distinct vectors, and how many points and asks each cell has."""

    rows: DataFrame
    distinct: DataFrame
    coded: DataFrame
    quantizer: Quantizer
    points: np.ndarray
    asks: np.ndarray
    copies: int
    dim: int

    def profile(self) -> dict[str, float]:
        """Number of distinct vectors, cells, rows of the largest cell, probes, and the share of the collection scored for a vector on average."""
        n = int(self.points.sum())
        return {"vectors": n, "cells": len(self.points), "largest": int(self.points.max(initial=0)), "probes": self.quantizer.probes, "share": float((self.points * self.asks).sum()) / max(1, n) ** 2}

    def nearest(self, k: int = 10, rerank: int = 48, region_rows: int = 8192) -> DataFrame:
        """(id, neighbor, distance, rank): the ``k`` nearest of every usable vector."""
        sc = self.coded.sparkSession.sparkContext
        region = group_cells(self.quantizer.centres, self.points, region_rows)
        count = int(region.max(initial=0)) + 1
        of_region = sc.broadcast(region)

        def regions(table: np.ndarray, cell: np.ndarray, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return table[cell], _pairs_of(probes, table)[1]

        points, asks = _sums(self.coded.mapInArrow(_per_probe(of_region, regions), "at int, points bigint, asks bigint"), count)
        plan = sc.broadcast((region, np.maximum(1, -(-points // (2 * region_rows))), np.maximum(1, -(-asks // (8 * region_rows)))))
        tasks = int((plan.value[1] * plan.value[2]).sum())
        shared = sc.broadcast(self.quantizer)
        placed = self.coded.mapInArrow(_router(plan), _PLACED).repartition(min(tasks, 20_000), "region", "p", "a")
        found = placed.groupBy("region", "p", "a").applyInArrow(_searcher(shared, k, rerank, self.dim), "id bigint, near array<bigint>, c array<double>, touched boolean")
        merged = F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("c", "near")))), 1, k)
        best = found.groupBy("id").agg(merged.alias("list"), F.max("touched").alias("touched"))
        if self.copies:
            best = self._with_copies(materialize(best), k)
        return best.select("id", F.posexplode("list").alias("r", "e")).select("id", F.col("e.near").alias("neighbor"), F.acosh(1.0 + F.col("e.c")).alias("distance"), (F.col("r") + 1).alias("rank"))

    def _with_copies(self, best: DataFrame, k: int) -> DataFrame:
        """Lists with the copies of the vectors in them, and the lists of the copies themselves."""
        reps = self.distinct.where(F.col("copies") > 1).select(F.col("id").alias("rep"), "x")
        if is_small(reps):
            members = self.rows.join(F.broadcast(reps), "x").select("rep", "id")
        else:
            members = skew_join(self.rows, reps, ["x"]).select("rep", "id")
        members = materialize(members)
        # the k + 1 smallest ids of every group
        first = materialize(members.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1).select(F.col("rep").alias("near"), F.col("id").alias("member")))
        small = first.select("near", "member")
        small = F.broadcast(small) if is_small(first) else small
        entries = best.where("touched").select("id", F.explode("list").alias("e")).select("id", "e.near", "e.c")
        others = entries.join(small, "near", "left").select("id", "c", F.coalesce("member", "near").alias("near"))
        own = first.select(F.col("near").alias("id"), F.lit(0.0).alias("c"), F.col("member").alias("near"))
        # k + 1 entries, since a copy must still skip itself
        listed = own.unionByName(others).groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("c", "near"))), 1, k + 1).alias("list"))
        listed = materialize(listed)
        copies = members.where(F.col("rep") != F.col("id"))
        copied = skew_join(copies, listed.withColumnRenamed("id", "rep"), ["rep"], hot=hot_keys(copies, ["rep"])).select("id", "list")
        rest = F.slice(F.filter("list", lambda e: e["near"] != F.col("id")), 1, k)
        return best.where(~F.col("touched")).select("id", "list").unionByName(listed.unionByName(copied).select("id", rest.alias("list")))


def _sums(counts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and asks per cell or region, at most one row each."""
    points, asks = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r in counts.groupBy("at").agg(F.sum("points").alias("points"), F.sum("asks").alias("asks")).collect():
        points[r["at"]], asks[r["at"]] = r["points"], r["asks"]
    return points, asks


def build(df: DataFrame, id_col: str = "vec_id", vec_col: str = "x", dim: int = 16, k: int = 10, target: float = 0.985, cell_rows: int = 128, sample_rows: int = 65_536, levels: int = 4, words: int = 256, seed: int = 7) -> Index | None:
    """The index of all usable vectors; None if there are none."""
    rows = usable(df, id_col, vec_col, dim)
    distinct = materialize(rows.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")))
    n, copies = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("copies") > 1).cast("int")), F.lit(0))).first()
    if not n:
        return None
    some = distinct.select("id", "x")
    sample = (some if n <= sample_rows else some.orderBy(F.xxhash64("id"), "id").limit(sample_rows)).toArrow().sort_by("id")
    h = lift(_matrix(sample.column("x"), dim))
    h = h[np.random.default_rng(seed).permutation(len(h))]
    centres = fit_cells(h, n, cell_rows, seed)
    if n > len(h):
        centres = _crowded(distinct, centres, dim, cell_rows, seed)
    probes = choose_probes(h[:BOOK_ROWS], n, centres, k, target, PROBE_ASKS, seed)
    quantizer = Quantizer(centres, fit_books(h[:BOOK_ROWS], centres, levels, words, seed), probes)
    shared = df.sparkSession.sparkContext.broadcast(quantizer)
    coded = materialize(distinct.select("id", "x", (F.col("copies") > 1).alias("copied")).mapInArrow(_encoder(shared, dim), _CODED))

    def cells(_: Quantizer, cell: np.ndarray, probed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return cell, probed.ravel()

    points, asks = _sums(coded.mapInArrow(_per_probe(shared, cells), "at int, points bigint, asks bigint"), len(centres))
    return Index(rows, distinct, coded, quantizer, points, asks, int(copies), dim)


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "x", dim: int = 16, k: int = 10, rerank: int = 48, region_rows: int = 8192, **kw) -> DataFrame:
    """(id, neighbor, distance, rank): the ``k`` nearest of every usable vector."""
    index = build(df, id_col, vec_col, dim, k, **kw)
    if index is None:
        return df.sparkSession.createDataFrame([], "id bigint, neighbor bigint, distance double, rank int")
    return index.nearest(k, rerank, region_rows)


def neighbor_pairs(near: DataFrame) -> DataFrame:
    """Unordered pairs of which at least one is among the nearest of the other."""
    return near.select(F.least("id", "neighbor").alias("vec_a"), F.greatest("id", "neighbor").alias("vec_b")).distinct()


def _scanner(shared, k: int, dim: int):
    """The ``k`` nearest rows of a task for each asking vector, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, h = shared.value
        flipped = h * np.r_[1.0, -np.ones(dim)]
        best_c, best_i = np.full((len(ids), k), np.inf), np.zeros((len(ids), k), np.int64)
        for b in _slices(batches, 1024):
            y, y_ids = lift(_matrix(b.column("x"), dim)), b.column("id").to_numpy()
            for s in range(0, len(h), 4096):
                own = slice(s, s + 4096)
                # the plain product finds the few that can enter; its error is bounded by the size of its terms
                rough = flipped[own] @ y.T - 1.0
                rough -= 1e-12 * np.outer(h[own, 0], y[:, 0])
                row, column = np.nonzero(rough <= best_c[own, -1][:, None])
                diff = y[column] - h[own][row]
                diff *= diff
                c = np.maximum(0.5 * (diff[:, 1:].sum(axis=1) - diff[:, 0]), 0.0)
                wide = np.full(rough.shape, np.inf)
                wide[row, column] = np.where(y_ids[column] == ids[own][row], np.inf, c)
                wide, names = np.hstack([best_c[own], wide]), np.hstack([best_i[own], np.broadcast_to(y_ids, rough.shape)])
                r, col = nearest_of(wide, names, k)
                start = np.searchsorted(r, np.arange(len(wide)))
                new_c, new_i = np.full((len(wide), k), np.inf), np.zeros((len(wide), k), np.int64)
                new_c[r, np.arange(len(r)) - start[r]], new_i[r, np.arange(len(r)) - start[r]] = wide[r, col], names[r, col]
                best_c[own], best_i[own] = new_c, new_i
        keep = np.isfinite(best_c)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, keep.sum(axis=1))), pa.array(best_i[keep]), pa.array(best_c[keep])], names=["id", "neighbor", "c"])

    return run


def recall(near: DataFrame, df: DataFrame, id_col: str, vec_col: str, dim: int, k: int, every: int = 20, block: int = 16_384) -> DataFrame:
    """One row: vectors whose id is divisible by ``every``, and the share of their true neighbours among all rows that was found.

    The asking vectors are broadcast in blocks of about ``block`` rows, by hash
    of their id; each block is one pass over the table.
    """
    spark = df.sparkSession
    rows = materialize(usable(df, id_col, vec_col, dim))
    asks = rows.where(F.col("id") % every == 0)
    blocks = max(1, -(-asks.count() // block))
    truth = None
    for b in range(blocks):
        own = asks.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        if not own.num_rows:
            continue
        shared = spark.sparkContext.broadcast((own.column("id").to_numpy(), lift(_matrix(own.column("x"), dim))))
        found = rows.mapInArrow(_scanner(shared, k, dim), "id bigint, neighbor bigint, c double")
        best = materialize(found.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("c", "neighbor"))).where(F.col("r") <= k).select("id", "neighbor"))
        truth = best if truth is None else truth.unionByName(best)
    if truth is None:
        return spark.createDataFrame([], "asked bigint, recall double")
    hit = near.select("id", "neighbor", F.lit(1).alias("hit"))
    return truth.join(hit, ["id", "neighbor"], "left").agg(F.countDistinct("id").alias("asked"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
