"""Items that appear together: a blocked Gram matrix per network.

A basket is a node of a network, its items are the node's neighbours.  A pair
can only stand out if both items are in at least ``least`` baskets and in no
more than 1 / ``lift`` of them, since they are together at most as often as the
rarer one occurs; other items never enter a matrix, but count in the marginals.

A network of at most ``WHOLE_NODES`` nodes is one block: its rows go to one
task, which drops repeated ones and multiplies the binary matrix of its baskets
and items with its transpose.  The items of a larger network are hashed into
blocks of about ``block_items``; a basket is sent to the pairs of blocks (I, J)
that its own items touch and to no other, and the baskets of a pair of blocks
are spread over tasks of about ``task_rows`` rows.  Each task sums the products
of the transposed blocks over its record blocks; the partial sums of a pair are
added up, and only then compared with the thresholds.  No task holds more than
two blocks of items and one block of records as a matrix.

Defined results: null ends and self-loops join nobody; repeated rows and both
directions of an edge count once; a null network id is dropped; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horograph.runtime import is_small, materialize, skew_join

BLOCK_ITEMS = 1024
RECORD_BLOCK = 4096
#: A network goes to one task if it has no more nodes (by an estimate that counts nodes twice) and raw rows than these.
WHOLE_NODES, WHOLE_ROWS = 2048, 4_000_000
#: Rows of a pair of blocks in one task.
TASK_ROWS = 1_000_000
SCHEMA = "net_id bigint, node_a bigint, node_b bigint, empirical_cn bigint, n_a bigint, n_b bigint, nodes bigint"
NAMES = ["net_id", "node_a", "node_b", "empirical_cn", "n_a", "n_b", "nodes"]


def links(edges: DataFrame) -> DataFrame:
    """(net_id, lo, hi), one row for each that joins two nodes."""
    ok = F.col("net_id").isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))
    return edges.where(ok).select(F.col("net_id").cast("bigint").alias("net_id"), F.least("src", "dst").cast("bigint").alias("lo"), F.greatest("src", "dst").cast("bigint").alias("hi"))


def standing_out(both: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, nodes: np.ndarray, least: int, lift: float) -> np.ndarray:
    return (both >= least) & (both * nodes >= lift * n_a * n_b)


def _whole(least: int, lift: float):
    """All pairs of one network that stand out."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        ends = np.stack([t.column("lo").to_numpy(), t.column("hi").to_numpy()])
        nodes, at = np.unique(ends.ravel(), return_inverse=True)
        n = len(nodes)
        lo, hi = at.reshape(2, -1)
        seen = np.unique(lo * n + hi)
        record, item = np.r_[seen // n, seen % n], np.r_[seen % n, seen // n]
        size = np.bincount(item, minlength=n)
        able = (size >= least) & (size * lift <= n)
        column = np.cumsum(able) - 1
        kept = np.flatnonzero(able)
        own = able[item]
        basket = np.zeros((n, len(kept)), np.float32)
        basket[record[own], column[item[own]]] = 1.0
        both = basket.T @ basket
        a, b = np.nonzero(np.triu(standing_out(both, size[kept][:, None], size[kept][None], n, least, lift), 1))
        rows = len(a)
        cols = [np.full(rows, key[0].as_py(), np.int64), nodes[kept[a]], nodes[kept[b]], both[a, b].astype(np.int64), size[kept[a]], size[kept[b]], np.full(rows, n, np.int64)]
        return pa.table(dict(zip(NAMES, map(pa.array, cols))))

    return run


class _Cell:
    """Products of two blocks of items, summed over blocks of records as their rows stream past."""

    def __init__(self, key: tuple) -> None:
        self.key = key
        self.at: list[dict[int, int]] = [{}, {}]
        self.size: list[dict[int, int]] = [{}, {}]
        self.total = np.zeros((0, 0))

    def _places(self, side: int, item: np.ndarray, size: np.ndarray) -> np.ndarray:
        own, first, back = np.unique(item, return_index=True, return_inverse=True)
        at = self.at[side]
        for i, n in zip(own.tolist(), size[first].tolist()):
            if i not in at:
                at[i] = len(at)
                self.size[side][i] = n
        return np.array([at[i] for i in own.tolist()], np.int64)[back]

    def add(self, record: np.ndarray, item: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        """Rows of whole records in their order; ``left`` and ``right`` say on which sides of the cell an item is."""
        p, q = self._places(0, item[left], size[left]), self._places(1, item[right], size[right])
        grown = np.zeros((len(self.at[0]), len(self.at[1])))
        grown[: self.total.shape[0], : self.total.shape[1]] = self.total
        self.total = grown
        number = np.cumsum(np.r_[True, record[1:] != record[:-1]]) - 1
        x, y = number[left], number[right]
        for s in range(0, int(number[-1]) + 1, RECORD_BLOCK):
            a, b = np.searchsorted(x, [s, s + RECORD_BLOCK])
            c, d = np.searchsorted(y, [s, s + RECORD_BLOCK])
            if a == b or c == d:
                continue
            rows = min(RECORD_BLOCK, int(number[-1]) + 1 - s)
            one, two = np.zeros((rows, grown.shape[0]), np.float32), np.zeros((rows, grown.shape[1]), np.float32)
            one[x[a:b] - s, p[a:b]] = 1.0
            two[y[c:d] - s, q[c:d]] = 1.0
            self.total += one.T @ two

    def pairs(self, net: int, nodes: int, least: int, lift: float, alone: bool) -> pa.RecordBatch:
        """Pairs with their counts; only those that stand out if no other task has rows of the cell."""
        items = [np.array(list(d), np.int64) for d in self.at]
        sizes = [np.array([s[i] for i in d], np.int64) for d, s in zip(self.at, self.size)]
        a, b = np.nonzero(standing_out(self.total, sizes[0][:, None], sizes[1][None], nodes, least, lift) if alone else self.total > 0)
        if self.key[1] == self.key[2]:
            up = items[0][a] < items[1][b]
            a, b = a[up], b[up]
        x, y, m, n, both = items[0][a], items[1][b], sizes[0][a], sizes[1][b], self.total[a, b].astype(np.int64)
        swap = x > y
        cols = [np.full(len(x), net, np.int64), np.where(swap, y, x), np.where(swap, x, y), both, np.where(swap, n, m), np.where(swap, m, n), np.full(len(x), nodes, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=NAMES)


def _blocked(least: int, lift: float, slice_rows: int = TASK_ROWS):
    """Kernel over rows (net_id, i, j, part, parts, record, item, block, size, nodes) sorted by cell, part and record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: _Cell | None = None
        held: list[tuple[np.ndarray, ...]] = []
        nodes, alone = 0, True

        def feed(upto: int | None = None) -> None:
            nonlocal held
            if not held or cell is None:
                return
            record, item, block, size = (np.concatenate(c) for c in zip(*held))
            end = len(record) if upto is None else int(np.searchsorted(record, record[-1]))
            if end:
                b = block[:end]
                cell.add(record[:end], item[:end], size[:end], b == cell.key[1], b == cell.key[2])
            held = [(record[end:], item[end:], block[end:], size[end:])] if end < len(record) else []

        for batch in batches:
            if not batch.num_rows:
                continue
            net, i, j, part, parts, record, item, block, size, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("net_id", "i", "j", "part", "parts", "record", "item", "block", "size", "nodes"))
            cut = np.flatnonzero(np.r_[True, (net[1:] != net[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (part[1:] != part[:-1])])
            for s, e in zip(cut, np.r_[cut[1:], len(net)]):
                key = (int(net[s]), int(i[s]), int(j[s]), int(part[s]))
                if cell is None or cell.key != key:
                    if cell is not None:
                        feed()
                        yield cell.pairs(cell.key[0], nodes, least, lift, alone)
                    cell, held, nodes, alone = _Cell(key), [], int(n[s]), int(parts[s]) == 1
                held.append((record[s:e], item[s:e], block[s:e], size[s:e]))
                if sum(len(h[0]) for h in held) > slice_rows:
                    # the last record may go on in the next batch
                    feed(-1)
        if cell is not None:
            feed()
            yield cell.pairs(cell.key[0], nodes, least, lift, alone)

    return run


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(F.broadcast(right), keys) if is_small(right) else skew_join(left, right, keys)


def block_rows(pairs: DataFrame, least: int, lift: float, block_items: int = BLOCK_ITEMS, task_rows: int = TASK_ROWS) -> DataFrame:
    """The rows of ``_blocked`` for distinct links: each item of a basket once for every block that the basket touches."""
    both = pairs.select("net_id", F.explode(F.array(F.struct(F.col("lo").alias("record"), F.col("hi").alias("item")), F.struct(F.col("hi").alias("record"), F.col("lo").alias("item")))).alias("e")).select("net_id", "e.record", "e.item")
    size = materialize(both.groupBy("net_id", "item").agg(F.count(F.lit(1)).alias("size")))
    nodes = materialize(size.groupBy("net_id").agg(F.count(F.lit(1)).alias("nodes")))
    able = materialize(_join(size, nodes, ["net_id"]).where((F.col("size") >= least) & (F.col("size") * lift <= F.col("nodes"))))
    blocks = able.groupBy("net_id").agg(F.ceil(F.count(F.lit(1)) / block_items).cast("int").alias("blocks"))
    items = materialize(_join(able, materialize(blocks), ["net_id"]).withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int")).drop("blocks"))
    rows = materialize(_join(both, items, ["net_id", "item"]))
    touched = rows.select("net_id", "record", F.col("block").alias("other")).distinct()
    placed = skew_join(rows, touched, ["net_id", "record"])
    cells = placed.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    parts = cells.groupBy("net_id", "i", "j").agg(F.ceil(F.count(F.lit(1)) / task_rows).cast("int").alias("parts"))
    sized = _join(cells, materialize(parts), ["net_id", "i", "j"])
    return sized.select("net_id", "i", "j", F.pmod(F.xxhash64("record"), F.col("parts")).cast("int").alias("part"), "parts", "record", "item", "block", "size", "nodes")


def large_networks(edges: DataFrame) -> DataFrame:
    """(net_id) of the networks that are too large for one task."""
    per = links(edges).groupBy("net_id").agg(F.count(F.lit(1)).alias("rows"), (F.approx_count_distinct("lo") + F.approx_count_distinct("hi")).alias("ends"))
    return per.where((F.col("rows") > WHOLE_ROWS) | (F.col("ends") > WHOLE_NODES)).select("net_id")


def cooccurring(edges: DataFrame, least: int = 8, lift: float = 3.0, block_items: int = BLOCK_ITEMS, task_rows: int = TASK_ROWS) -> DataFrame:
    """(net_id, node_a, node_b, empirical_cn, n_a, n_b, nodes, ratio) for pairs with at least ``least`` common neighbours, ``lift`` times what chance gives."""
    large = materialize(large_networks(edges))
    some = large.limit(1).count() > 0
    own = links(edges)
    if some:
        mark = F.broadcast(large) if is_small(large) else large
        own = own.join(mark, "net_id", "left_anti")
    found = own.groupBy("net_id").applyInArrow(_whole(least, lift), SCHEMA)
    if some:
        pairs = materialize(links(edges).join(mark, "net_id", "left_semi").distinct())
        rows = block_rows(pairs, least, lift, block_items, task_rows)
        cells = rows.repartition("net_id", "i", "j", "part").sortWithinPartitions("net_id", "i", "j", "part", "record")
        partial = cells.mapInArrow(_blocked(least, lift), SCHEMA)
        summed = partial.groupBy("net_id", "node_a", "node_b", "n_a", "n_b", "nodes").agg(F.sum("empirical_cn").alias("empirical_cn"))
        out = (F.col("empirical_cn") >= least) & (F.col("empirical_cn") * F.col("nodes") >= lift * F.col("n_a") * F.col("n_b"))
        found = found.unionByName(summed.where(out).select(*NAMES))
    return found.withColumn("ratio", F.col("empirical_cn") * F.col("nodes") / (F.col("n_a") * F.col("n_b")))
