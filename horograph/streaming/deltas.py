"""Graph changes as a stream.

Changes (``op`` add_edge, remove_edge or set_weight) arrive in any order and
more than once.  The state keeps, per unordered pair, the last change by event
time (``ts``, then ``delta_id``); a later arrival with an earlier event time
does not overwrite it.  The current graph is the pairs whose last change is not
a removal.  Each micro-batch folds its changes to one per pair and writes them
under its number, beside the stream's own checkpoint: a batch that is run again
writes the same folder, and a stream that is started again goes on with the
state of all batches before.  The state is the last change over these folders;
every ``COMPACT`` batches they are folded into one, so neither reading nor
writing grows with the number of batches.

Defined results: changes without an end, an op or a time are dropped, self-loops
too; a missing weight is 1 for added edges; deliveries of one change again
change nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "src bigint, dst bigint, op string, weight double, ts timestamp_ntz, delta_id bigint"
OPS = ("add_edge", "remove_edge", "set_weight")


def last_changes(deltas: DataFrame) -> DataFrame:
    """The last change of every pair."""
    ok = F.col("op").isin(*OPS) & F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")) & F.col("ts").isNotNull()
    rows = deltas.where(ok).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "op", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.col("ts").cast("timestamp_ntz").alias("ts"), "delta_id")
    when = F.struct("ts", "delta_id", "op", "weight")
    last = rows.groupBy("src", "dst").agg(F.max(when).alias("c"))
    return last.select("src", "dst", "c.op", "c.weight", "c.ts", "c.delta_id")


def merge(state: DataFrame, deltas: DataFrame) -> DataFrame:
    return last_changes(state.unionByName(last_changes(deltas)))


def current_edges(state: DataFrame) -> DataFrame:
    return state.where(F.col("op") != "remove_edge").select("src", "dst", "weight")


#: Batches after which their folders are folded into one.
COMPACT = 16


class EdgeState:
    """State of the stream in the folder ``path``; ``fold`` is its foreachBatch function."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _folder(self, name: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the folders of a kind that were written to their end."""
        p, fs = self._folder()
        if not fs.exists(p):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName().startswith(f"{kind}=")]
        return sorted(int(n.split("=")[1]) for n in names if fs.exists(self._folder(f"{n}/_SUCCESS")[0]))

    def _parts(self) -> tuple[list[str], int]:
        """Folders that make up the state, and the last batch in the compact one."""
        upto = max(self._numbers("upto"), default=-1)
        batches = [f"batch={b}" for b in self._numbers("batch") if b > upto]
        return ([f"upto={upto}"] if upto >= 0 else []) + batches, upto

    @property
    def batches(self) -> int:
        return max([*self._numbers("batch"), *self._numbers("upto")], default=-1) + 1

    @property
    def state(self) -> DataFrame:
        parts, _ = self._parts()
        if not parts:
            return self.spark.createDataFrame([], STATE)
        read = self.spark.read.schema(STATE).parquet(*[f"{self.path}/{p}" for p in parts])
        return last_changes(read) if len(parts) > 1 else read

    def fold(self, batch: DataFrame, batch_id: int) -> None:
        last_changes(batch).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        parts, upto = self._parts()
        if batch_id - upto >= COMPACT:
            self.state.write.mode("overwrite").parquet(f"{self.path}/upto={batch_id}")
            # what the new folder holds is needed no more
            for old in parts:
                p, fs = self._folder(old)
                fs.delete(p, True)

    def edges(self) -> DataFrame:
        return current_edges(self.state)


def replay(spark: SparkSession, path: str, checkpoint: str, files_per_batch: int = 4) -> EdgeState:
    """Run the changes at ``path`` (a folder or a pattern) through the stream until all are taken in; the same ``checkpoint`` goes on where the last run stopped."""
    schema = spark.read.parquet(path).schema
    out = EdgeState(spark, f"{checkpoint}/state")
    q = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path).writeStream.foreachBatch(out.fold).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return out


@dataclass
class RefitPolicy:
    """When changes call for a refit: by their number, by elapsed time, or by their share of the graph."""

    count: int = 1000
    seconds: float = 3600.0
    share: float = 0.2

    def decide(self, changes: int, elapsed: float, edges: int) -> str:
        """``wait``, ``warm`` (refit from the last coordinates) or ``cold``."""
        if edges and changes / edges >= self.share:
            return "cold"
        return "warm" if changes >= self.count or (changes and elapsed >= self.seconds) else "wait"
