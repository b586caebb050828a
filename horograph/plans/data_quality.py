"""Queries on rows that fail to parse, orphan references and dominating keys (problems 1, 4 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horograph.operators import heavy_keys, orphans
from horograph.plans.catalog import Catalog
from horograph.runtime import table
from horograph.sources.route_lines import parse_routes

catalog = Catalog()

_FIELD = '"(?:[^"]|"")*"|[^",]*'
JUDGED = rf"""
WITH l AS (SELECT line_id, regexp_replace(raw_line, '\r$', '') AS line FROM routes_raw),
f AS (SELECT line_id, regexp_full_match(line, '(?:{_FIELD})(?:,(?:{_FIELD}))*') AS quoted,
             regexp_extract_all(',' || line, ',({_FIELD})', 1) AS v FROM l),
c AS (SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN len(v) <> 9 THEN 'columns' END AS structure,
             trim(regexp_replace(v[4], '^"(.*)"$', '\1', 's'), ' ') AS s, trim(regexp_replace(v[6], '^"(.*)"$', '\1', 's'), ' ') AS d FROM f),
j AS (SELECT *, coalesce(structure, CASE WHEN NOT ((s = '\N' OR (regexp_full_match(s, '[0-9]{{1,6}}') AND try_cast(s AS BIGINT) > 0))
             AND (d = '\N' OR (regexp_full_match(d, '[0-9]{{1,6}}') AND try_cast(d AS BIGINT) > 0))) THEN 'value' END) AS reason FROM c)
"""


def _parsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return parse_routes(table(spark, sf_dir, "routes_raw"))


@catalog.add("p1_found", JUDGED + "SELECT line_id, reason FROM j WHERE reason IS NOT NULL")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir)[1].select("line_id", "reason")


def _plain(k: int) -> str:
    """The text of a field without its quotes, null for ``\\N``."""
    return rf"""nullif(CASE WHEN starts_with(v[{k}], '"') THEN replace(substr(v[{k}], 2, len(v[{k}]) - 2), '""', '"') ELSE v[{k}] END, '\N')"""


def _whole(k: int, kind: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({_plain(k)}, ' '), '[+-]?[0-9]{{1,18}}') THEN try_cast(trim({_plain(k)}, ' ') AS {kind}) END"


@catalog.add(
    "p1_routes",
    JUDGED
    + rf"""SELECT line_id, {_plain(1)} AS airline, {_whole(2, "BIGINT")} AS airline_id, {_plain(3)} AS src_iata, CASE WHEN s <> '\N' THEN CAST(s AS BIGINT) END AS src,
 {_plain(5)} AS dst_iata, CASE WHEN d <> '\N' THEN CAST(d AS BIGINT) END AS dst, {_plain(7)} AS codeshare, {_whole(8, "INTEGER")} AS stops, {_plain(9)} AS equipment,
 CAST(CASE WHEN {_plain(2)} IS NOT NULL AND {_whole(2, "BIGINT")} IS NULL THEN 1 ELSE 0 END + CASE WHEN {_plain(8)} IS NOT NULL AND {_whole(8, "INTEGER")} IS NULL THEN 1 ELSE 0 END AS INTEGER) AS untyped
 FROM j WHERE reason IS NULL""",
)
def p1_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir)[0].withColumn("untyped", F.size("untyped"))


@catalog.add("p1_reasons", JUDGED + "SELECT reason, CAST(count(*) AS BIGINT) AS lines FROM j WHERE reason IS NOT NULL GROUP BY reason")
def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))


_ORPHANS = r"""
WITH r AS (
 SELECT 'routes' AS ref_table, route_id AS row_id, 'src' AS ref_field, 'id' AS k, CAST(src AS VARCHAR) AS v, recorded_at AS t FROM routes
 UNION ALL SELECT 'routes', route_id, 'dst', 'id', CAST(dst AS VARCHAR), recorded_at FROM routes
 UNION ALL SELECT 'routes', route_id, 'src_iata', 'code', upper(trim(src_iata, ' ')), recorded_at FROM routes
 UNION ALL SELECT 'routes', route_id, 'dst_iata', 'code', upper(trim(dst_iata, ' ')), recorded_at FROM routes
 UNION ALL SELECT 'graph_deltas', delta_id, 'src', 'id', CAST(src AS VARCHAR), ts FROM graph_deltas
 UNION ALL SELECT 'graph_deltas', delta_id, 'dst', 'id', CAST(dst AS VARCHAR), ts FROM graph_deltas),
p AS (SELECT 'id' AS k, CAST(airport_id AS VARCHAR) AS v, added_at, removed_at FROM airports
 UNION ALL SELECT 'code', upper(trim(iata, ' ')), added_at, removed_at FROM airports),
o AS (SELECT ref_table, row_id, ref_field, min(t) AS t FROM r WHERE v IS NOT NULL AND v <> '' AND v <> '\N'
 AND NOT EXISTS (SELECT 1 FROM p WHERE p.k = r.k AND p.v = r.v AND (added_at IS NULL OR r.t >= added_at) AND (removed_at IS NULL OR r.t < removed_at))
 GROUP BY 1, 2, 3)
"""


ROUTES = orphans.Source("routes", "route_id", "recorded_at", "loaded_at", ("src", "dst"), ("src_iata", "dst_iata"))
DELTAS = orphans.Source("graph_deltas", "delta_id", "ts", "arrived_at", ("src", "dst"))


def _tracked(spark: SparkSession, sf_dir: str) -> orphans.OrphanTracker:
    return orphans.track([(s, table(spark, sf_dir, s.name)) for s in (ROUTES, DELTAS)], orphans.airport_parents(table(spark, sf_dir, "airports")))


@catalog.add("p4_found", _ORPHANS + "SELECT ref_table, row_id, ref_field FROM o")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tracked(spark, sf_dir).pending.select("ref_table", "row_id", "ref_field")


@catalog.add(
    "p4_report",
    _ORPHANS + "SELECT ref_table, ref_field, strftime(t, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS orphans FROM o GROUP BY 1, 2, 3",
)
def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tracked(spark, sf_dir).snapshots[-1].select("ref_table", "ref_field", F.date_format("month", "yyyy-MM").alias("month"), "orphans")


# A batch sees the references, the starts and the ends that are known by its end.
_SNAPSHOTS = r"""
WITH r0 AS (
 SELECT 'routes' AS ref_table, route_id AS row_id, recorded_at AS t, coalesce(loaded_at, recorded_at) AS arrived, unnest(['src', 'dst', 'src_iata', 'dst_iata']) AS ref_field, unnest(['id', 'id', 'code', 'code']) AS k,
  unnest([CAST(src AS VARCHAR), CAST(dst AS VARCHAR), upper(trim(src_iata, ' ')), upper(trim(dst_iata, ' '))]) AS v FROM routes
 UNION ALL SELECT 'graph_deltas', delta_id, ts, coalesce(arrived_at, ts), unnest(['src', 'dst']), unnest(['id', 'id']), unnest([CAST(src AS VARCHAR), CAST(dst AS VARCHAR)]) FROM graph_deltas),
w AS (SELECT min(epoch_us(a)) AS lo, max(epoch_us(a)) AS hi FROM (SELECT coalesce(loaded_at, recorded_at) AS a FROM routes UNION ALL SELECT coalesce(arrived_at, ts) FROM graph_deltas)),
b AS (SELECT i AS batch, CASE WHEN i < 2 THEN make_timestamp(CAST(lo + ((hi - lo) * (i + 1)) // 3 AS BIGINT)) END AS upto FROM range(3) x(i), w),
r AS (SELECT * FROM r0 WHERE v IS NOT NULL AND v <> '' AND v <> '\N'),
p AS (SELECT 'id' AS k, CAST(airport_id AS VARCHAR) AS v, added_at, removed_at, CASE WHEN removed_at < added_at THEN added_at ELSE removed_at END AS ended_at FROM airports
 UNION ALL SELECT 'code', upper(trim(iata, ' ')), added_at, removed_at, CASE WHEN removed_at < added_at THEN added_at ELSE removed_at END FROM airports),
s AS (SELECT batch, ref_table, row_id, ref_field, min(t) AS t FROM r JOIN b ON upto IS NULL OR arrived IS NULL OR arrived <= upto
 WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k = r.k AND p.v = r.v AND (added_at IS NULL OR ((upto IS NULL OR added_at <= upto) AND r.t >= added_at)) AND r.t IS NOT NULL
  AND (removed_at IS NULL OR r.t < removed_at OR (upto IS NOT NULL AND ended_at > upto)))
 GROUP BY ALL)
SELECT CAST(batch AS INTEGER) AS batch, ref_table, ref_field, date_trunc('month', t)::TIMESTAMP AS month, CAST(count(*) AS BIGINT) AS orphans FROM s GROUP BY ALL
"""


@catalog.add("p4_snapshots", _SNAPSHOTS)
def p4_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts after every batch, as they stood then."""
    first, *rest = _tracked(spark, sf_dir).snapshots
    for s in rest:
        first = first.unionByName(s)
    return first.withColumn("month", F.col("month").cast(orphans.TIME))


_DEGREES = """
WITH e AS (SELECT net_id, least(src, dst) AS a, greatest(src, dst) AS b, max(seen_at) AS seen_at FROM network_edges
 WHERE net_id IS NOT NULL AND src <> dst GROUP BY 1, 2, 3),
d AS (SELECT node_id, CAST(count(*) AS BIGINT) AS degree, max(seen_at) AS last_seen FROM (SELECT a AS node_id, seen_at FROM e UNION ALL SELECT b, seen_at FROM e) GROUP BY 1)
"""


@catalog.add("p5_found", _DEGREES + "SELECT node_id FROM d WHERE degree * 50 >= (SELECT count(*) FROM e)")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys.dominating(heavy_keys.degrees(table(spark, sf_dir, "network_edges"))).select("node_id")


@catalog.add("p5_degrees", _DEGREES + "SELECT node_id, degree, last_seen FROM d")
def p5_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys.degrees(table(spark, sf_dir, "network_edges")).select("node_id", "degree", "last_seen")
