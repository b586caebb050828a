"""Per-key results when a few keys hold most of the rows: exact offset chunking.

Rows are counted per input partition and key; prefix sums of the counts give
each partition the number at which its rows of a key begin, so every row gets
its exact number within its key without gathering the key anywhere.  The number
divided by the chunk size is the chunk; chunks of one size are reduced in
parallel whatever key they belong to, and the states of a key's chunks are
merged in their order.

Only keys with more rows than a chunk need numbers.  The chunk size is the rows
divided by the number of chunks wanted, so there are never more such keys than
wanted chunks, and their table is broadcast.  The input is materialised first:
the numbers refer to its partitions, so these may not change when a task is
run again.

Defined results: rows with a null key form no key; repeated rows count each
unless the caller makes them distinct; an empty table gives no keys; columns
other than the key and the payload are dropped on entry, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from horograph.runtime import materialize, tasks_of

#: Chunks wanted for each task of a shuffle and at least, and the fewest rows worth a chunk.
TASK_CHUNKS, LEAST_CHUNKS, LEAST_ROWS = 4, 64, 1_000


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``local``: the number of the row among the rows of its key in this partition."""
    seen: dict[int, int] = {}
    for b in batches:
        key = b.column(0).to_numpy(zero_copy_only=False)
        if not len(key):
            continue
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        length = np.diff(np.r_[first, len(ranked)])
        base = np.array([seen.get(k, 0) for k in ranked[first].tolist()], dtype=np.int64)
        for k, n in zip(ranked[first].tolist(), (base + length).tolist()):
            seen[k] = n
        local = np.empty(len(key), np.int64)
        local[order] = np.arange(len(key)) - np.repeat(first, length) + np.repeat(base, length)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local)], names=[*b.schema.names, "local"])


def number_rows(df: DataFrame, key: str, payload: list[str], chunks: int | None = None, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(key, *payload, number, chunk) for a bigint ``key``; ``number`` and ``chunk`` are 0 for keys of at most one chunk."""
    rows = materialize(df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias(key), *payload))
    pid = F.spark_partition_id().alias("pid")
    counts = materialize(rows.groupBy(pid, key).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    size = max(least_rows, -(-total // (chunks or max(LEAST_CHUNKS, TASK_CHUNKS * tasks_of(df)))))
    heavy = counts.groupBy(key).agg(F.sum("n").alias("all")).where(F.col("all") > size).select(key)
    offsets = (
        counts.join(F.broadcast(heavy), key, "left_semi")
        .withColumn("start", F.sum("n").over(Window.partitionBy(key).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)))
        .select(key, "pid", F.coalesce("start", F.lit(0)).alias("start"))
    )
    flagged = rows.withColumn("pid", F.spark_partition_id()).join(F.broadcast(heavy.withColumn("heavy", F.lit(True))), key, "left")
    light = flagged.where(F.col("heavy").isNull()).select(key, *payload, F.lit(0).cast("bigint").alias("number"), F.lit(0).cast("bigint").alias("chunk"))
    local = flagged.where(F.col("heavy")).select(key, *payload, "pid")
    schema = T.StructType([*local.schema.fields, T.StructField("local", T.LongType())])
    numbered = local.mapInArrow(_numbered, schema).join(offsets, [key, "pid"])
    number = F.col("start") + F.col("local")
    return light.unionByName(numbered.select(key, *payload, number.alias("number"), F.floor(number / size).cast("bigint").alias("chunk")))


def reduce_chunks(numbered: DataFrame, key: str, states: dict[str, Column], merges: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per key.

    ``states`` are the aggregates of a chunk; ``merges`` names, for each
    output, how the states of a key's chunks are put together: ``sum``, ``min``,
    ``max``, ``first`` or ``last`` (by chunk) and the state it reads.
    """
    chunk = numbered.groupBy(key, "chunk").agg(*[c.alias(n) for n, c in states.items()])
    by = {
        "sum": F.sum,
        "min": F.min,
        "max": F.max,
        "first": lambda c: F.min_by(c, F.col("chunk")),
        "last": lambda c: F.max_by(c, F.col("chunk")),
    }
    return chunk.groupBy(key).agg(F.count(F.lit(1)).alias("chunks"), *[by[how](state).alias(out) for out, (how, state) in merges.items()])


def edge_ends(edges: DataFrame) -> DataFrame:
    """(net_id, node_id, other) twice per distinct edge: a network and an unordered pair of different nodes."""
    pairs = (
        edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("net_id").isNotNull() & (F.col("src") != F.col("dst")))
        .groupBy("net_id", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
        .agg(F.max("seen_at").alias("seen_at"))
    )
    ends = F.array(F.struct(F.col("lo").alias("node_id"), F.col("hi").alias("other")), F.struct(F.col("hi").alias("node_id"), F.col("lo").alias("other")))
    return pairs.select("net_id", "seen_at", F.explode(ends).alias("e")).select("e.node_id", "net_id", "e.other", "seen_at")


def degrees(edges: DataFrame, chunks: int | None = None, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(node_id, degree, last_seen, chunks): distinct edges of a node over all networks."""
    numbered = number_rows(edge_ends(edges), "node_id", ["seen_at"], chunks, least_rows)
    return reduce_chunks(
        numbered,
        "node_id",
        {"n": F.count(F.lit(1)), "seen": F.max("seen_at")},
        {"degree": ("sum", "n"), "last_seen": ("max", "seen")},
    )


def dominating(per_node: DataFrame, share: int = 50) -> DataFrame:
    """Nodes that are an end of at least one in ``share`` of all distinct edges."""
    edges = per_node.agg((F.sum("degree") / 2).cast("bigint").alias("edges"))
    return per_node.crossJoin(F.broadcast(edges)).where(F.col("degree") * share >= F.col("edges"))
