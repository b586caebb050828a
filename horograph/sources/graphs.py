"""Readers of graphs: edge lists, route files, single-cell tables, precomputed coordinates; and the sinks of reports.

All readers have a fixed schema or take one; none infers types by a pass over
the data, but for the features of a single-cell table, whose columns are not
known beforehand.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horograph.functions.vectors import norm
from horograph.operators import graph, pairs
from horograph.runtime import materialize
from horograph.sources.route_lines import parse_routes

AIRPORTS = "airport_id int, name string, city string, country string, iata string, icao string, lat double, lon double, alt int, tz string, dst string, tz_name string, kind string, source string"
LABELS = ("labels", "label", "cell_type")


def snap_edges(spark: SparkSession, path: str) -> DataFrame:
    """White-space separated pairs of ids with # comments, plain or gzip."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)")).select(parts[0].try_cast("bigint").alias("src"), parts[1].try_cast("bigint").alias("dst"))
    return graph.canonical_edges(rows)


def csv_edges(spark: SparkSession, path: str, weighted: bool = False, header: bool = False) -> DataFrame:
    """Comma separated pairs of ids, with a weight if ``weighted``."""
    schema = "src bigint, dst bigint" + (", weight double" if weighted else "")
    return graph.canonical_edges(spark.read.csv(path, schema=schema, header=header), weight="weight" if weighted else None)


def labelled_edges(spark: SparkSession, path: str, graph_id: int | None = None) -> DataFrame:
    """Parquet edges with optional ``relation`` and ``graph_id`` columns, direction and relation dropped."""
    rows = spark.read.parquet(path)
    if graph_id is not None:
        rows = rows.where(F.col("graph_id") == graph_id)
    return graph.canonical_edges(rows)


def split_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, split, is_positive) of a published split with positive and negative pairs."""
    return spark.read.parquet(path).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "split", F.col("is_positive").cast("boolean").alias("is_positive"))


def route_graph(spark: SparkSession, routes_path: str, airports_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of routes.dat: lines that fail are left out, self-loops dropped, the largest component kept and numbered from 0."""
    lines = spark.read.text(routes_path).select(F.monotonically_increasing_id().alias("line_id"), F.col("value").alias("raw_line"))
    routes, _ = parse_routes(lines)
    edges, nodes = graph.relabel(graph.largest_component(graph.canonical_edges(routes)))
    if airports_path:
        about = spark.read.csv(airports_path, schema=AIRPORTS, nullValue="\\N", escape='"').select(F.col("airport_id").cast("bigint").alias("node_id"), "iata", "name", "country", "lat", "lon")
        nodes = nodes.join(about, "node_id", "left")
    return edges, nodes


def cells(spark: SparkSession, path: str, normalize: bool = False) -> DataFrame:
    """(node_id, label, x) of a table with one row per cell; lines may end in a bare CR."""
    raw = spark.read.option("header", True).option("inferSchema", True).csv(path)
    label = next((c for c in LABELS if c in raw.columns), None)
    features = [c for c, kind in raw.dtypes if c != label and kind in ("int", "bigint", "double", "float")]
    cols = [F.col(f"`{c}`").cast("double") for c in features]
    if normalize:
        s = raw.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(cols)]).first()
        cols = [(c - (s[f"m{k}"] or 0.0)) / (s[f"s{k}"] or 1.0) for k, c in enumerate(cols)]
    return raw.select(F.monotonically_increasing_id().alias("node_id"), (F.col(label) if label else F.lit(None)).cast("string").alias("label"), F.array(*cols).alias("x"))


def _euclid(r1: np.ndarray, v1: np.ndarray, r2: np.ndarray, v2: np.ndarray) -> np.ndarray:
    return np.sqrt(((v1[:, None, :] - v2[None, :, :]) ** 2).sum(axis=2))


def cell_graph(points: DataFrame, k: int = 15, symmetric: bool = True) -> DataFrame:
    """k-nearest-neighbour graph of cells; its components are joined by the shortest links that span them."""
    placed = points.withColumn("r", F.lit(0.0)).withColumnRenamed("x", "v")
    edges = materialize(graph.knn_graph_of(placed, _euclid, k, symmetric))
    d, nodes = pairs.all_pairs(placed, _euclid), points.select("node_id")
    # every round each component takes its closest link outwards, so their number at least halves
    while True:
        comp = materialize(graph.connected_components(edges, nodes))
        if comp.select("component").distinct().limit(2).count() < 2:
            return edges
        cross = pairs.gather(d, comp, ["component"]).where(F.col("component_i") != F.col("component_j"))
        own = cross.select(F.explode(F.array("component_i", "component_j")).alias("component"), F.struct("d", "i", "j").alias("link"))
        best = own.groupBy("component").agg(F.min("link").alias("link")).select("link").distinct()
        edges = materialize(edges.unionByName(best.select(F.col("link.i").alias("src"), F.col("link.j").alias("dst"), F.col("link.d").alias("weight"))))


def precomputed(df: DataFrame, id_col: str = "node_id", x_col: str = "x") -> DataFrame:
    """(node_id, x) of ball coordinates; raises where a norm is not below 1."""
    x = F.col(x_col).cast("array<double>")
    bad = x.isNull() | (norm(x) >= 1) | F.isnan(norm(x))
    return df.select(F.col(id_col).cast("bigint").alias("node_id"), F.when(bad, F.raise_error(F.lit("coordinates must lie inside the ball")).cast("array<double>")).otherwise(x).alias("x"))


# The karate club (Zachary 1977): node, its neighbours with a larger number; fixed values.
KARATE = {
    0: [1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 17, 19, 21, 31], 1: [2, 3, 7, 13, 17, 19, 21, 30], 2: [3, 7, 8, 9, 13, 27, 28, 32], 3: [7, 12, 13],
    4: [6, 10], 5: [6, 10, 16], 6: [16], 8: [30, 32, 33], 9: [33], 13: [33], 14: [32, 33], 15: [32, 33], 18: [32, 33], 19: [33], 20: [32, 33],
    22: [32, 33], 23: [25, 27, 29, 32, 33], 24: [25, 27, 31], 25: [31], 26: [29, 33], 27: [33], 28: [31, 33], 29: [32, 33], 30: [32, 33], 31: [32, 33], 32: [33],
}


def karate_club(spark: SparkSession) -> DataFrame:
    """The 78 friendships of 34 members, without weights."""
    return spark.createDataFrame([(a, b, 1.0) for a, near in KARATE.items() for b in near], "src bigint, dst bigint, weight double")


def word_net(spark: SparkSession, path: str, word: str = "", depth: int | None = None) -> DataFrame:
    """(child, parent) of a noun database file, one line per synset with its pointers; below ``word``, to a depth.

    A line holds the offset of the synset, its file number and kind, the number
    of words in hexadecimal, the words with their senses, the number of pointers
    and the pointers (symbol, offset, kind, places); ``@`` and ``@i`` point to
    parents.  Lines that begin with a space are the licence.  Synsets are named
    by their offset; without ``word`` all are kept.
    """
    part = F.split(F.split("value", r" \| ")[0], " ")
    words = F.conv(part[3], 16, 10).cast("int")
    at = F.lit(4) + 2 * words
    rows = spark.read.text(path).where(~F.col("value").startswith(" ") & (F.trim("value") != "")).select(part[0].cast("bigint").alias("child"), part.alias("p"), words.alias("words"), at.alias("at"))
    names = rows.select("child", F.explode(F.transform(F.sequence(F.lit(0), F.col("words") - 1), lambda k: F.element_at("p", (4 + 2 * k + 1).cast("int")))).alias("word"))
    count = F.element_at("p", F.col("at") + 1).cast("int")
    pointer = F.explode(F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct(F.element_at("p", (F.col("at") + 4 * k + 2).cast("int")).alias("kind"), F.element_at("p", (F.col("at") + 4 * k + 3).cast("int")).cast("bigint").alias("parent")))))
    up = rows.select("child", pointer.alias("q")).where(F.col("q.kind").isin("@", "@i")).select("child", F.col("q.parent").alias("parent")).distinct()
    if not word:
        return up
    up = materialize(up)
    roots = names.where(F.lower("word") == word.lower()).select(F.col("child").alias("node_id"))
    down = up.select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    seen = level = materialize(roots.distinct())
    step = 0
    while depth is None or step < depth:
        step += 1
        level = materialize(level.join(down, F.col("node_id") == F.col("src")).select(F.col("dst").alias("node_id")).distinct().join(seen, "node_id", "left_anti"))
        if level.limit(1).count() == 0:
            break
        seen = materialize(seen.unionByName(level))
    return up.join(seen.select(F.col("node_id").alias("child")), "child", "left_semi").join(seen.select(F.col("node_id").alias("parent")), "parent", "left_semi").select("child", "parent")


def node_labels(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """(node_id, label) of comma separated rows; null ids are dropped."""
    return spark.read.csv(path, schema="node_id bigint, label string", header=header).where(F.col("node_id").isNotNull())


LOADERS: dict[str, Callable[..., DataFrame]] = {"snap": snap_edges, "csv": csv_edges, "labelled": labelled_edges, "split": split_edges, "balanced_tree": graph.balanced_tree, "karate": karate_club, "word_net": word_net}


def markdown(df: DataFrame, digits: int = 4, rows: int = 1000) -> str:
    """A report table as Markdown; reports are small, more than ``rows`` rows raise."""
    data = df.limit(rows + 1).collect()
    if len(data) > rows:
        raise ValueError(f"a report of more than {rows} rows")
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(v) for v in r) + " |" for r in data)])


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
