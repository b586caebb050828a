"""Shared plumbing: tables, materialisation, size-checked broadcast, skew-safe joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when a count shows that it has no more rows than this.
BROADCAST_ROWS = 200_000
#: And, where its rows hold texts of any length, no more characters than this.
BROADCAST_CHARS = 32_000_000
#: A key is hot when it holds more rows than so many tasks have on average.
HOT_TASKS = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, in local mode else a temporary folder."""
    sc = spark.sparkContext
    now = sc.getCheckpointDir()
    if now is None:
        wanted = spark.conf.get("spark.checkpoint.dir", None)
        if wanted is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            wanted = tempfile.mkdtemp(prefix="horograph-")
            atexit.register(shutil.rmtree, wanted, ignore_errors=True)
        sc.setCheckpointDir(wanted)
        now = sc.getCheckpointDir()
    return now


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there: cuts the lineage, survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, text: str | None = None) -> bool:
    """Whether ``df`` has at most ``rows`` rows, counted no further than one beyond, and at most BROADCAST_CHARS characters in the column ``text``."""
    if df.select(F.lit(1)).limit(rows + 1).count() > rows:
        return False
    return text is None or (df.agg(F.sum(F.length(text).cast("bigint"))).first()[0] or 0) <= BROADCAST_CHARS


def tasks_of(df: DataFrame) -> int:
    """The number of tasks a shuffle of this session has."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hot_keys(df: DataFrame, keys: Sequence[str], tasks: int | None = None) -> DataFrame:
    """The keys that hold more rows than ``HOT_TASKS`` mean tasks, with ``__parts``, the number of mean tasks their rows fill.

    There are fewer of them than half the tasks, and their parts are at most
    twice the tasks, whatever the input.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    mean = counts.agg((F.sum("__n") / (tasks or tasks_of(df))).alias("__mean"))
    return counts.crossJoin(F.broadcast(mean)).where(F.col("__n") > HOT_TASKS * F.col("__mean")).select(*keys, F.ceil(F.col("__n") / F.col("__mean")).cast("int").alias("__parts"))


def skew_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", hot: DataFrame | None = None, extra: Column | None = None) -> DataFrame:
    """Equi-join that spreads the rows of ``left`` with hot keys over as many parts as they fill tasks.

    ``hot`` is what ``hot_keys`` gives for ``left`` (a bounded table, so it is
    broadcast); rows of ``right`` with such a key are repeated once per part.
    ``how`` is one of inner, left, left_semi, left_anti.
    """
    keys = list(keys)
    if hot is None:
        hot = hot_keys(left, keys)
    flag = F.broadcast(hot.select(*keys, "__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    salted = left.join(flag, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), parts).cast("int")).drop("__parts")
    spread = right.join(flag, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    if extra is None:
        return salted.join(spread, [*keys, "__salt"], how).drop("__salt")
    on = [salted[c] == spread[c] for c in [*keys, "__salt"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    out = salted.join(spread, cond & extra, how)
    if how not in ("left_semi", "left_anti"):
        for c in [*keys, "__salt"]:
            out = out.drop(spread[c])
    return out.drop("__salt")
