"""References to records that do not exist, kept up to date batch by batch.

``OrphanTracker`` keeps its state in a folder that all executors share: the
parent index (kind, key and the interval in which the parent exists), the
pending orphans and a log of the rows taken in, one for all references of a row.  A batch brings new
references, parents that arrive and parents that end:

* a new reference probes the parent index and waits as an orphan if nothing
  holds it at its time;
* an arriving parent resolves the waiting orphans of its key and interval;
* an ending parent reopens the references of its key from that time on, unless
  another parent of the key holds them.  They are read from the log, which is
  cut by batch and filtered by time in the scan: batches that hold no reference
  as late as the earliest end are not read.

So a reference is read once when it comes in and again only if it is later than
an end that becomes known after it.  Each batch writes its tables and then a
mark; a tracker on the same folder goes on after the last marked batch, and a
batch that was cut short is written again.  The pending table of each batch is
counted per table and month; the counts of all batches are the snapshots.  The
final pending table does not depend on how the rows were cut into batches.

Parent sides are broadcast if counted small, else joined by key with hot keys
salted.  Defined results: a null key, an empty or blank code and ``\\N`` are no
references; a reference without a time is held by no parent; a parent without
a start exists from ever, without an end for ever; repeated deliveries of a
reference give one orphan, the earliest; empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from horograph.runtime import checkpoint_dir, hot_keys, is_small, materialize, skew_join

REF = ["ref_table", "row_id", "ref_field", "kind", "key", "at"]
IDENTITY = ["ref_table", "row_id", "ref_field"]
PARENT = ["parent", "kind", "key", "valid_from", "valid_to"]

TIME = "timestamp_ntz"


def code(c: Column) -> Column:
    """A code as it is compared; null if it is no reference."""
    t = F.upper(F.trim(c))
    return F.when((t != "") & (t != r"\N"), t)


def micros(c: Column) -> Column:
    """A time as a number, by which a scan can skip row groups."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast(TIME), c)


@dataclass(frozen=True)
class Source:
    """A table that refers to parents: its key, the time of its rows, when they arrived, and the columns that hold ids and codes."""

    name: str
    row_id: str
    at: str
    arrived: str
    ids: tuple[str, ...] = ()
    codes: tuple[str, ...] = ()

    @property
    def schema(self) -> str:
        return ", ".join(["row_id bigint, at timestamp_ntz, at_us bigint", *[f"id_{c} string" for c in self.ids], *[f"code_{c} string" for c in self.codes], "batch int"])

    def wide(self, df: DataFrame) -> DataFrame:
        """Its rows as the log keeps them, one for all their references, with the time they arrived."""
        at = F.col(self.at).cast(TIME)
        keys = [F.col(c).cast("string").alias(f"id_{c}") for c in self.ids] + [code(F.col(c)).alias(f"code_{c}") for c in self.codes]
        return df.select(F.col(self.row_id).cast("bigint").alias("row_id"), at.alias("at"), micros(at).alias("at_us"), F.coalesce(F.col(self.arrived), F.col(self.at)).cast(TIME).alias("arrived"), *keys)

    def references(self, wide: DataFrame) -> DataFrame:
        """The references in long form (REF columns)."""
        cells = [F.struct(F.lit(c).alias("f"), F.lit(kind).alias("kind"), F.col(f"{kind}_{c}").alias("key")) for kind, columns in (("id", self.ids), ("code", self.codes)) for c in columns]
        return (
            wide.select("row_id", "at", F.explode(F.array(*cells)).alias("c"))
            .where(F.col("c.key").isNotNull())
            .select(F.lit(self.name).alias("ref_table"), "row_id", F.col("c.f").alias("ref_field"), F.col("c.kind").alias("kind"), F.col("c.key").alias("key"), "at")
        )


def airport_parents(airports: DataFrame) -> DataFrame:
    cells = F.array(F.struct(F.lit("id").alias("kind"), F.col("airport_id").cast("string").alias("key")), F.struct(F.lit("code").alias("kind"), code(F.col("iata")).alias("key")))
    # rows of one id may differ in their interval: each interval is a parent of its own
    span = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    parent = F.concat_ws("|", F.col("airport_id").cast("string"), span("added_at"), span("removed_at"))
    rows = airports.select(parent.alias("parent"), F.col("added_at").cast(TIME).alias("valid_from"), F.col("removed_at").cast(TIME).alias("valid_to"), F.explode(cells).alias("c"))
    return rows.where(F.col("c.key").isNotNull()).select("parent", "c.kind", "c.key", "valid_from", "valid_to")


def _holds(refs: DataFrame, parents: DataFrame, how: str, small: bool) -> DataFrame:
    """References that some parent holds (left_semi) or none does (left_anti)."""
    p = parents.select(F.col("kind"), F.col("key"), F.col("valid_from").alias("__from"), F.col("valid_to").alias("__to"))
    inside = (F.col("__from").isNull() | (F.col("at") >= F.col("__from"))) & (F.col("__to").isNull() | (F.col("at") < F.col("__to"))) & F.col("at").isNotNull()
    if small:
        p = F.broadcast(p)
        return refs.join(p, (refs["kind"] == p["kind"]) & (refs["key"] == p["key"]) & inside, how)
    return skew_join(refs, p, ["kind", "key"], how, hot=hot_keys(refs, ["kind", "key"]), extra=inside)


def snapshot(pending: DataFrame, batch: int) -> DataFrame:
    month = F.date_trunc("month", F.col("at"))
    return pending.groupBy("ref_table", "ref_field", month.alias("month")).agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(batch).alias("batch"), "ref_table", "ref_field", "month", "orphans")


_PARENTS = "parent string, kind string, key string, valid_from timestamp_ntz, valid_to timestamp_ntz"
_PENDING = "ref_table string, row_id bigint, ref_field string, kind string, key string, at timestamp_ntz"


class OrphanTracker:
    """State of the check in the folder ``path``; ``apply`` takes the next batch."""

    def __init__(self, spark: SparkSession, sources: Sequence[Source], path: str | None = None) -> None:
        self.spark, self.sources = spark, list(sources)
        self.path = path or f"{checkpoint_dir(spark)}/orphans-{uuid.uuid4()}"
        self.batch = 0
        while self._exists(f"done/{self.batch}"):
            self.batch += 1

    def _hadoop(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        p, fs = self._hadoop(name)
        return fs.exists(p)

    def _table(self, name: str, schema: str) -> DataFrame:
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    @property
    def parents(self) -> DataFrame:
        return self._table(f"parents/{self.batch - 1}", _PARENTS)

    @property
    def pending(self) -> DataFrame:
        return self._table(f"pending/{self.batch - 1}", _PENDING)

    @property
    def snapshots(self) -> list[DataFrame]:
        return [snapshot(self._table(f"pending/{k}", _PENDING), k) for k in range(self.batch)]

    def stage(self, tables: dict[str, DataFrame]) -> None:
        """Writes the rows of all sources, with their ``batch``, into the log in one pass; the batches are then applied without them."""
        for s in self.sources:
            tables[s.name].drop("arrived").write.mode("overwrite").partitionBy("batch").parquet(f"{self.path}/log/{s.name}")

    def _references(self, which: Column) -> DataFrame:
        """The references of the rows of the log for which ``which`` holds."""
        parts = [s.references(self._table(f"log/{s.name}", s.schema).where(which)) for s in self.sources]
        return reduce(DataFrame.unionByName, parts)

    def apply(self, tables: dict[str, DataFrame] | None, arriving: DataFrame, ending: DataFrame) -> "OrphanTracker":
        """``tables``: new rows of the sources by name, None if they are staged.  ``arriving``: new parents (PARENT columns, valid_to null).  ``ending``: parents with their valid_to."""
        k = self.batch
        for s in self.sources if tables is not None else []:
            if s.name in tables:
                s.wide(tables[s.name]).drop("arrived").write.mode("overwrite").parquet(f"{self.path}/log/{s.name}/batch={k}")
        arriving, ending = materialize(arriving.select(*PARENT)), materialize(ending.select(*PARENT))
        ended = ending.select(*PARENT[:-1], F.col("valid_to").alias("__end"))
        known = self.parents.unionByName(arriving)
        same = [known[c].eqNullSafe(ended[c]) for c in PARENT[:-1]]
        joined = known.join(ended, same[0] & same[1] & same[2] & same[3], "left")
        joined.select(*[known[c] for c in PARENT[:-1]], F.coalesce(known["valid_to"], F.col("__end")).alias("valid_to")).distinct().write.mode("overwrite").parquet(f"{self.path}/parents/{k}")
        parents = self._table(f"parents/{k}", _PARENTS)
        small = is_small(parents)
        waiting = _holds(self._references(F.col("batch") == k), parents, "left_anti", small)
        if k:
            touched = parents.join(arriving.select("kind", "key").distinct(), ["kind", "key"], "left_semi")
            waiting = waiting.unionByName(_holds(self.pending, touched, "left_anti", small))
            earliest = ending.agg(F.min(micros(F.col("valid_to")))).first()[0]
            if earliest is not None:
                gone = ending.select("parent", "kind", "key", F.col("valid_to").alias("valid_from"), F.lit(None).cast(TIME).alias("valid_to"))
                later = self._references((F.col("batch") < k) & (F.col("at_us") >= earliest))
                waiting = waiting.unionByName(_holds(_holds(later, gone, "left_semi", small), parents, "left_anti", small))
        first = F.min(F.struct(F.col("at").isNull().alias("none"), "at", "kind", "key")).alias("f")
        waiting.groupBy(*IDENTITY).agg(first).select(*IDENTITY, "f.kind", "f.key", "f.at").write.mode("overwrite").parquet(f"{self.path}/pending/{k}")
        p, fs = self._hadoop(f"done/{k}")
        fs.create(p).close()
        self.batch = k + 1
        return self


def cut_times(first: datetime | None, last: datetime | None, batches: int) -> list[Column]:
    """Ends of all but the last of ``batches`` equal spans, to the microsecond below."""
    if first is None or batches < 2:
        return []
    return [F.lit(str(first + (last - first) * k // batches)).cast(TIME) for k in range(1, batches)]


def track(tables: list[tuple[Source, DataFrame]], parents: DataFrame, batches: int = 3, path: str | None = None) -> OrphanTracker:
    """Run the tracker over ``batches`` equal parts of the arrival times; a parent arrives when it is added and ends when it is removed."""
    wide = {s.name: s.wide(df) for s, df in tables}
    first, last = reduce(DataFrame.unionByName, [w.select("arrived") for w in wide.values()]).agg(F.min("arrived"), F.max("arrived")).first()
    cuts = cut_times(first, last, batches)

    def place(c: Column) -> Column:
        """The batch of a time; a missing one counts as the earliest."""
        out = F.lit(len(cuts))
        for k in reversed(range(len(cuts))):
            out = F.when(c <= cuts[k], k).otherwise(out)
        return F.when(c.isNull(), 0).otherwise(out).cast("int")

    state = OrphanTracker(parents.sparkSession, [s for s, _ in tables], path)
    if not state.batch:
        state.stage({name: w.withColumn("batch", place(F.col("arrived"))) for name, w in wide.items()})
    start, end = F.col("valid_from"), F.col("valid_to")
    # an end before the start is known with the start
    timed = materialize(parents.select(*PARENT, place(start).alias("from_batch"), F.when(end < start, place(start)).when(end.isNotNull(), place(end)).alias("to_batch")))
    for k in range(state.batch, len(cuts) + 1):
        arriving = timed.where(F.col("from_batch") == k).withColumn("valid_to", F.lit(None).cast(TIME))
        state.apply(None, arriving, timed.where(F.col("to_batch") == k))
    return state
