"""Running totals and ranks over a whole table without gathering it in one task.

Rows are range-partitioned by the order, each partition is summed, and the sums
before a partition (one row per partition) are added to the running totals
inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from horograph.runtime import materialize


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, Column], parts: int | None = None) -> DataFrame:
    """``df`` with, for each name, the sum of its expression over all rows before this one in ``order``.

    ``order`` must put rows in one definite order for the totals to be definite.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    valued = df.select("*", *[c.alias(f"__v_{n}") for n, c in totals.items()])
    ranged = materialize(valued.repartitionByRange(parts, *order)).withColumn("__pid", F.spark_partition_id())
    sums = ranged.groupBy("__pid").agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in totals])
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    starts = sums.select("__pid", *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in totals])
    inside = Window.partitionBy("__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(starts), "__pid")
    return out.select(*df.columns, *[(F.col(f"__s_{n}") + F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0))).alias(n) for n in totals])


def numbered(df: DataFrame, order: list[Column], name: str = "rn", parts: int | None = None) -> DataFrame:
    """``df`` with its 1-based place in ``order``."""
    t = running_totals(df, order, {name: F.lit(1).cast("bigint")}, parts)
    return t.withColumn(name, F.col(name) + 1)


#: Bins of one pass over the values, and values of the last bin that the driver takes.
BINS, LAST = 4096, 20_000


def _bin_of(df: DataFrame, col: str, rank: int) -> tuple[float, float, int, int] | None:
    """(low, high, rows below, rows inside) of a range that holds the row of the 0-based ``rank``: at most LAST rows or one value.

    Each pass counts the rows of ``BINS`` equal parts of the last range, so a
    task sends at most so many counts, whatever the number of rows.
    """
    c = F.col(col).cast("double")
    values = df.where(c.isNotNull() & ~F.isnan(c))
    low, high, inside = values.agg(F.min(c), F.max(c), F.count(F.lit(1))).first()
    if not inside or rank >= inside:
        return None
    below = 0
    while inside > LAST and low < high:
        width = (high - low) / BINS
        if width <= 0 or low + width == low:
            break
        part = F.least(F.floor((c - low) / width), F.lit(BINS - 1))
        counts = values.where((c >= low) & (c <= high)).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("low"), F.max(c).alias("high")).orderBy("part").collect()
        for r in counts:
            if below + r["n"] > rank:
                if (r["low"], r["high"]) == (low, high):
                    return low, high, below, r["n"]
                low, high, inside = r["low"], r["high"], r["n"]
                break
            below += r["n"]
    return low, high, below, inside


def kth(df: DataFrame, col: str, rank: int) -> float | None:
    """The value of the 0-based ``rank`` among the values of a column; None if there are not so many."""
    at = _bin_of(df, col, rank)
    if at is None:
        return None
    low, high, below, inside = at
    if low == high:
        return low
    c = F.col(col).cast("double")
    if inside <= LAST:
        return sorted(r[0] for r in df.where((c >= low) & (c <= high)).select(c.alias("x")).collect())[rank - below]
    return numbered(df.where((c >= low) & (c <= high)).select(c.alias("x")), [F.asc("x")]).where(F.col("rn") == rank - below + 1).first()["x"]


def quantile(df: DataFrame, col: str, q: float) -> float | None:
    """The exact quantile with linear interpolation between the two nearest values; None without values."""
    c = F.col(col).cast("double")
    n = df.where(c.isNotNull() & ~F.isnan(c)).count()
    if not n:
        return None
    place = q * (n - 1)
    first = kth(df, col, int(place))
    return first if place == int(place) else first + (kth(df, col, int(place) + 1) - first) * (place - int(place))
