"""Ranking metrics of all candidates of splits whose scores are signed products of points.

No table of candidates is written.  A task scores the pairs of a range of nodes
in blocks, leaves the edges out, and counts the others by their place between
the removed edges, which it holds in order.  The counts of all tasks give the
exact rank of every removed edge; equal scores go by the hash of the pair, as in
``ranking``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs that a task scores and sorts at once, and rows and columns that it fills at once, so that they stay in the cache.
PAIRS, ROWS, COLUMNS = 4_000_000, 32, 2048
#: Pairs of one task, and most tasks of one split.
TASK_PAIRS, TASKS = 8_000_000, 64
#: Counts in one row of the result of a task.
BLOCK = 8192

SCHEMA = "seed int, block int, counts array<bigint>, twice bigint, negatives bigint, best array<double>"

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def pair_ids(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """What ``xxhash64`` gives for two bigint columns."""
    h = np.full(len(i), 42, np.uint64)
    for x in (i, j):
        h = _turned(np.asarray(x, np.int64).view(np.uint64) * _P2, 31) * _P1 ^ (h + _P5 + np.uint64(8))
        h = _turned(h, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


@dataclass
class Held:
    """The points of a split by id (``x`` by coordinate) and its removed edges, the worst first."""

    ids: np.ndarray
    x: np.ndarray
    signs: np.ndarray
    known: np.ndarray
    higher: bool
    scores: np.ndarray
    keys: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, src: np.ndarray, dst: np.ndarray, nodes: np.ndarray, x: np.ndarray, signs: np.ndarray, higher: bool) -> Held:
        """``ids``: all nodes, sorted; ``src``, ``dst``: the removed edges; ``nodes``, ``x``: the points, of some nodes."""
        at, known = np.searchsorted(ids, nodes), np.zeros(len(ids), bool)
        points = np.zeros((x.shape[1], len(ids)))
        points[:, at], known[at] = x.T, True
        held = cls(ids, points, signs, known, higher, np.zeros(0), np.zeros(0, np.int64))
        a, b = np.searchsorted(ids, src), np.searchsorted(ids, dst)
        scores = np.zeros(len(a))
        for p, s in zip(points, signs):
            scores += p[a] * s * p[b]
        scores = np.where(known[a] & known[b], scores if higher else -scores, -np.inf)
        if np.isnan(scores).any():
            raise ValueError("scores must be numbers")
        keys = held.key(src, dst)
        order = np.lexsort((keys, scores))
        held.scores, held.keys = scores[order], keys[order]
        return held

    def key(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of two candidates with one score the one with the larger key is ranked first."""
        h = pair_ids(i, j)
        return h if self.higher else ~h

    def bounds(self) -> np.ndarray:
        """Ranges of nodes with about as many pairs: a pair belongs to its smaller id."""
        n = len(self.ids)
        before = np.r_[0, np.cumsum(np.arange(n - 1, -1, -1))]
        tasks = int(min(TASKS, max(1, -(-before[-1] // TASK_PAIRS))))
        return np.r_[0, np.searchsorted(before[:-1], before[-1] * np.arange(1, tasks) // tasks), n]

    def tile(self, a: int, b: int, c: int) -> np.ndarray:
        """Scores of the rows a to b and the columns from c; a high one means a link."""
        out = np.zeros((b - a, len(self.ids) - c))
        step = np.empty((ROWS, COLUMNS))
        for r in range(0, out.shape[0], ROWS):
            for k in range(0, out.shape[1], COLUMNS):
                part = out[r : r + ROWS, k : k + COLUMNS]
                product = step[: part.shape[0], : part.shape[1]]
                # one coordinate after the other: a score doesn't depend on the tile
                for p, s in zip(self.x, self.signs):
                    np.multiply((p[a + r : a + r + part.shape[0]] * s)[:, None], p[None, c + k : c + k + part.shape[1]], out=product)
                    part += product
        if not self.higher:
            np.negative(out, out=out)
        if not self.known.all():
            out[~self.known[a:b]] = -np.inf
            out[:, ~self.known[c:]] = -np.inf
        return out

    def counts(self, begin: int, end: int, low: np.ndarray, high: np.ndarray, most: int) -> tuple[np.ndarray, int, int, np.ndarray]:
        """What the pairs of the nodes ``begin`` to ``end`` with later ones are, without the edges ``low``, ``high`` (places).

        (pairs between each removed edge and the one before, twice the number of
        removed edges above each pair with ties as halves, pairs, their ``most``
        best scores)
        """
        n = len(self.ids)
        order = np.argsort(low, kind="stable")
        low, high = low[order], high[order]
        values, first, times = np.unique(self.scores, return_index=True, return_counts=True)
        under, twice, pairs, best = np.zeros(len(self.scores), np.int64), 0, 0, np.zeros(0)
        a = begin
        while a < end:
            b = min(end, a + max(1, PAIRS // max(1, n - a - 1)))
            tile = self.tile(a, b, a + 1)
            keep = np.ones(tile.shape, bool)
            corner = keep[:, : b - a - 1]
            corner &= np.arange(corner.shape[1])[None] >= np.arange(b - a)[:, None]
            inside = slice(*np.searchsorted(low, (a, b)))
            keep[low[inside] - a, high[inside] - a - 1] = False
            free = tile[keep]
            free.sort()
            if len(free):
                if np.isnan(free[-1]):
                    raise ValueError("scores must be numbers")
                below, upto = np.searchsorted(free, values, "left"), np.searchsorted(free, values, "right")
                under += np.repeat(below, times)
                twice += int(((below + upto) * times).sum())
                if (tied := np.flatnonzero(upto > below)).size:
                    self._ties(under, tile, keep, a, values, first, times, tied)
                pairs += len(free)
                best = np.sort(np.r_[best, free[-most:]])[-most:]
            a = b
        return np.diff(under, prepend=0), twice, pairs, best

    def _ties(self, under: np.ndarray, tile: np.ndarray, keep: np.ndarray, a: int, values: np.ndarray, first: np.ndarray, times: np.ndarray, tied: np.ndarray) -> None:
        """Adds to ``under`` the pairs with the score of a removed edge and a smaller key."""
        if len(tied) == 1:
            row, column = np.nonzero(keep & (tile == values[tied[0]]))
            which = np.zeros(len(row), int)
        else:
            at = np.minimum(np.searchsorted(values[tied], tile), len(tied) - 1)
            row, column = np.nonzero(keep & (values[tied][at] == tile))
            which = at[row, column]
        keys = self.key(self.ids[a + row], self.ids[a + 1 + column])
        edges = np.concatenate([np.arange(first[t], first[t] + times[t]) for t in tied])
        own = np.repeat(np.arange(len(tied)), times[tied])
        # an edge stands before the pairs of its key
        order = np.lexsort((np.r_[np.zeros(len(edges), bool), np.ones(len(row), bool)], np.r_[self.keys[edges], keys], np.r_[own, which]))
        before = np.cumsum(order >= len(edges))
        place = np.empty(len(order), int)
        place[order] = before
        smaller = np.r_[0, np.cumsum(np.bincount(which, minlength=len(tied)))]
        under[edges] += place[: len(edges)] - smaller[own]


def _stripe(bounds: np.ndarray, ids: np.ndarray) -> Column:
    low = F.least("src", "dst")
    return sum(((low >= F.lit(int(ids[b]))).cast("int") for b in bounds[1:-1] if b < len(ids)), F.lit(0))


def _count(held: dict[int, Held], splits: dict[int, DataFrame], most: int) -> list[dict]:
    """The rows of SCHEMA, summed by seed and block."""
    spark = next(iter(splits.values())).sparkSession
    ranges, edges = [], None
    for seed, h in held.items():
        bounds = h.bounds()
        e = splits[seed].where("src IS NOT NULL AND dst IS NOT NULL").select((F.lit(len(ranges)) + _stripe(bounds, h.ids)).alias("slot"), F.least("src", "dst").cast("bigint").alias("low"), F.greatest("src", "dst").cast("bigint").alias("high"))
        edges = e if edges is None else edges.unionByName(e)
        ranges += [(seed, int(a), int(b)) for a, b in zip(bounds, bounds[1:])]
    # a row for every task, also for those without an edge
    tasks = spark.range(len(ranges)).select(F.col("id").cast("int").alias("slot"), F.lit(None).cast("bigint").alias("low"), F.lit(None).cast("bigint").alias("high"))
    sent = {seed: spark.sparkContext.broadcast(h) for seed, h in held.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        slot, none = t.column("slot").to_numpy(), t.column("low").is_null().to_numpy()
        low, high = (t.column(c).fill_null(0).to_numpy() for c in ("low", "high"))
        for k in np.unique(slot).tolist():
            seed, a, b = ranges[k]
            h, own = sent[seed].value, (slot == k) & ~none
            counts, twice, pairs, best = h.counts(a, b, np.searchsorted(h.ids, low[own]), np.searchsorted(h.ids, high[own]), most)
            for block, at in enumerate(range(0, len(counts), BLOCK)):
                yield _row(seed, block, counts[at : at + BLOCK], twice if not block else 0, pairs if not block else 0, best if not block else best[:0])

    def added(key: tuple, t: pa.Table) -> pa.Table:
        counts = sum(x.values.to_numpy() for x in t.column("counts"))
        best = np.sort(np.concatenate([x.values.to_numpy() for x in t.column("best")]))[-most:]
        return pa.Table.from_batches([_row(key[0].as_py(), key[1].as_py(), counts, sum(t.column("twice").to_pylist()), sum(t.column("negatives").to_pylist()), best)])

    rows = edges.unionByName(tasks).repartitionById(len(ranges), F.col("slot")).mapInArrow(run, SCHEMA)
    found = rows.groupBy("seed", "block").applyInArrow(added, SCHEMA).toArrow().to_batches()
    for b in sent.values():
        b.destroy()
    return [{c: b.column(c)[k].values.to_numpy() if c in ("counts", "best") else b.column(c)[k].as_py() for c in b.schema.names} for b in found for k in range(b.num_rows)]


def _row(seed: int, block: int, counts: np.ndarray, twice: int, pairs: int, best: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch(
        {
            "seed": pa.array([seed], pa.int32()), "block": pa.array([block], pa.int32()), "counts": pa.array([counts], pa.list_(pa.int64())),
            "twice": pa.array([twice], pa.int64()), "negatives": pa.array([pairs], pa.int64()), "best": pa.array([best], pa.list_(pa.float64())),
        }
    )


def metrics(held: dict[int, Held], splits: dict[int, DataFrame], bins: int = 10, hits: int = 20) -> dict[int, tuple[float, float, float, float, int]]:
    """seed -> (f1, auc, hits, first_lift, captured), as ``evaluation.metrics`` gives them for a table of the candidates."""
    rows, out = _count(held, splits, hits), {}
    for seed, h in held.items():
        own = sorted((r for r in rows if r["seed"] == seed), key=lambda r: r["block"])
        positives, negatives = len(h.scores), sum(r["negatives"] for r in own)
        if not positives or not negatives:
            raise ValueError("AUC needs both classes")
        under = np.cumsum(np.concatenate([r["counts"] for r in own]))
        # better ones: the pairs not under an edge and the edges after it
        rank = negatives - under + np.arange(positives, 0, -1)
        taken = int((rank <= positives).sum())
        p = taken / positives
        everything = positives + negatives
        size = everything if bins == 1 else max(1, everything // bins)
        captured = int((rank <= size).sum())
        best = np.concatenate([r["best"] for r in own])
        above = (h.scores > best.min()).mean() if len(best) == hits else 1.0
        out[seed] = (2 * p * p / (p + p) if p else 0.0, sum(r["twice"] for r in own) / 2 / (positives * negatives), float(above), captured / size / (positives / everything), captured)
    return out
