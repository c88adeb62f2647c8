"""Skeleton, coverage, regridding and set joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellhour.operators import grid, regrid, split
from cellhour.operators.diagnose import live_zero_runs, zero_runs
from cellhour.plans import build
from cellhour.sources import fields, points

from .adapters import (DENSE, JANUARY, TABLE_FOLDS, V_FIELD, V_HOURS, V_POINTS, V_TABLE, Tables)
from .registry import query

POINT_ROWS = "v_wide AS (SELECT lat, lon, \"time\"," + ", ".join(
    f"avg(value) FILTER (WHERE parameter = '{p}') AS \"{p}\"" for p in ("PS", "PRECTOTCORR", "T2M", "RH2M", "WS2M")
) + ' FROM v_points WHERE value IS NOT NULL GROUP BY lat, lon, "time")'
NEAREST = """v_lat AS (SELECT cell, source FROM (SELECT c.lat AS cell, p.lat AS source,
  row_number() OVER (PARTITION BY c.lat ORDER BY abs(c.lat - p.lat), p.lat) AS place
  FROM (SELECT DISTINCT lat FROM v_hours) c, (SELECT DISTINCT lat FROM v_points WHERE value IS NOT NULL) p) x WHERE place = 1),
v_lon AS (SELECT cell, source FROM (SELECT c.lon AS cell, p.lon AS source,
  row_number() OVER (PARTITION BY c.lon ORDER BY abs(c.lon - p.lon), p.lon) AS place
  FROM (SELECT DISTINCT lon FROM v_hours) c, (SELECT DISTINCT lon FROM v_points WHERE value IS NOT NULL) p) x WHERE place = 1)"""


@query("J1_skeleton", "lat:d lon:d time:t", 'SELECT lat, lon, "time" FROM v_hours, (SELECT 1 FROM events LIMIT 1) e', [V_HOURS])
def skeleton(t: Tables) -> DataFrame:
    coverage = grid.observed_months(t.strikes, JANUARY)
    return grid.skeleton(t.spark, JANUARY, kept_months=grid.coverage_gate(coverage, 0.5))


@query("J2_dense_join", "lat:d lon:d time:t flash_count:l mean_peak_current_ka:d",
       'SELECT lat, lon, "time", flash_count, mean_peak_current_ka FROM v_dense', DENSE)
def dense_join(t: Tables) -> DataFrame:
    stats = grid.event_statistics(grid.cell_hours(t.strikes, JANUARY))
    return grid.densify(grid.skeleton(t.spark, JANUARY), stats)


@query("J3_coverage_join", "lat:d lon:d time:t month:t observed_days:l days_in_month:l coverage:d",
       'SELECT lat, lon, "time", "month", observed_days, days_in_month, coverage FROM v_dense', DENSE)
def coverage_join(t: Tables) -> DataFrame:
    return grid.with_coverage(grid.skeleton(t.spark, JANUARY), grid.observed_months(t.strikes, JANUARY))


@query("J4_assemble_sources", "lat:d lon:d time:t flash_count:l T2M:d RH2M:d CAPE:d CIN:d hour_of_day_local:l",
       """SELECT d.lat, d.lon, d."time", d.flash_count, w."T2M", w."RH2M", f.cape AS "CAPE", f.cin AS "CIN",
       (hour(d."time") + 7) % 24 AS hour_of_day_local FROM v_dense d
       JOIN v_lat ON d.lat = v_lat.cell JOIN v_lon ON d.lon = v_lon.cell
       LEFT JOIN v_wide w ON w.lat = v_lat.source AND w.lon = v_lon.source AND w."time" = d."time"
       LEFT JOIN v_cells f ON f.lat = d.lat AND f.lon = d.lon AND f."time" = d."time" """,
       [*DENSE, V_POINTS, POINT_ROWS, NEAREST, V_FIELD,
        """v_cells AS (SELECT lat, lon, "time", avg(cape) AS cape, avg(cin) AS cin FROM (
        SELECT file, floor(latitude / 0.5e0) * 0.5e0 + 0.25e0 AS lat,
        floor((CASE WHEN longitude > 180 THEN longitude - 360 ELSE longitude END) / 0.5e0) * 0.5e0 + 0.25e0 AS lon,
        date_trunc('hour', valid_time) AS "time", avg(cape) AS cape, avg(cin) AS cin FROM v_field GROUP BY 1, 2, 3, 4) p
        GROUP BY 1, 2, 3)"""])
def assemble_sources(t: Tables) -> DataFrame:
    point = build.point_predictors(t.points, JANUARY)
    field = build.field_predictors(fields.normalise(t.field, keep=["file"]))
    return build.build(t.strikes, JANUARY, point, field)


@query("J5_nearest_regrid", "lat:d lon:d time:t PS:d T2M:d WS2M:d",
       """SELECT v_lat.cell AS lat, v_lon.cell AS lon, w."time", w."PS", w."T2M", w."WS2M"
       FROM v_lat, v_lon, v_wide w WHERE w.lat = v_lat.source AND w.lon = v_lon.source""",
       [V_HOURS, V_POINTS, POINT_ROWS, NEAREST])
def nearest_regrid(t: Tables) -> DataFrame:
    wide = points.parameter_matrix(t.points)
    return regrid.regrid(wide, grid.cells(t.spark, JANUARY), ["PS", "T2M", "WS2M"])


@query("J6_coarse_to_hours", "lat:d lon:d time:t value:d",
       """SELECT lat, lon, day + to_hours(h) AS "time", value FROM (SELECT lat, lon,
       CAST(date_trunc('day', "time") AS TIMESTAMP) AS day, avg(value) AS value FROM v_points WHERE parameter = 'PS'
       GROUP BY 1, 2, 3) d, range(24) r(h)""", [V_POINTS])
def coarse_to_hours(t: Tables) -> DataFrame:
    daily = t.points.filter("parameter = 'PS'").groupBy(
        "lat", "lon", F.date_trunc("day", "time").cast("timestamp_ntz").alias("time")).agg(F.avg("value").alias("value"))
    return regrid.every_hour(daily, "D")


@query("J7_parameters_side_by_side", "lat:d lon:d time:t PS:d T2M:d",
       """SELECT lat, lon, "time", avg(value) FILTER (WHERE parameter = 'PS') AS "PS",
       avg(value) FILTER (WHERE parameter = 'T2M') AS "T2M" FROM v_points
       WHERE value IS NOT NULL AND parameter IN ('PS', 'T2M') GROUP BY lat, lon, "time" """, [V_POINTS])
def parameters_side_by_side(t: Tables) -> DataFrame:
    """Two frames on their own keys; the single-pass form is A5."""
    one = lambda p: points.parameter_matrix(t.points, [p])
    return regrid.side_by_side([one("PS"), one("T2M")], ["lat", "lon", "time"])


MEMBERS = """m_rows AS (SELECT floor(latitude / 0.5e0) * 0.5e0 + 0.25e0 AS lat,
  floor((CASE WHEN longitude > 180 THEN longitude - 360 ELSE longitude END) / 0.5e0) * 0.5e0 + 0.25e0 AS lon,
  date_trunc('hour', valid_time) AS "time", event_id, cape, kx, cin FROM v_field)"""


@query("J8_member_merge", "lat:d lon:d time:t cape:d cin:d",
       """SELECT lat, lon, "time", a.cape, b.cin FROM
       (SELECT lat, lon, "time", avg(cape) AS cape FROM m_rows WHERE event_id % 3 <> 0 GROUP BY 1, 2, 3) a FULL OUTER JOIN
       (SELECT lat, lon, "time", avg(cin) AS cin FROM m_rows WHERE event_id % 4 <> 0 GROUP BY 1, 2, 3) b
       USING (lat, lon, "time")""", [V_FIELD, MEMBERS])
def member_merge(t: Tables) -> DataFrame:
    rows = fields.normalise(t.field, keep=["event_id"])
    member = lambda rule, name: fields.spatial_mean(rows.filter(rule).select("lat", "lon", "time", name))
    return fields.merge_members([member("event_id % 3 <> 0", "cape"), member("event_id % 4 <> 0", "cin")])


@query("J9_supplement_merge", "lat:d lon:d time:t cape:d kx:d cin:d",
       """SELECT lat, lon, "time", a.cape, b.kx, b.cin FROM
       (SELECT lat, lon, "time", avg(cape) AS cape FROM m_rows WHERE event_id % 3 <> 0 GROUP BY 1, 2, 3) a LEFT JOIN
       (SELECT lat, lon, "time", avg(kx) AS kx, avg(cin) AS cin FROM m_rows WHERE event_id % 4 <> 0 GROUP BY 1, 2, 3) b
       USING (lat, lon, "time")""", [V_FIELD, MEMBERS])
def supplement_merge(t: Tables) -> DataFrame:
    """The main rows hold cape and an empty kx; the supplement may fill kx and cin but not replace cape."""
    rows = fields.normalise(t.field, keep=["event_id"])
    main = fields.spatial_mean(rows.filter("event_id % 3 <> 0").select(
        "lat", "lon", "time", "cape", F.lit(None).cast("double").alias("kx")))
    extra = fields.spatial_mean(rows.filter("event_id % 4 <> 0").select("lat", "lon", "time", "cape", "kx", "cin"))
    return fields.supplement(main, extra)


@query("J10_month_membership", "l_orderkey:l l_linenumber:l month:t",
       """SELECT l_orderkey, l_linenumber, "month" FROM v_table WHERE "month" IN (
       SELECT "month" FROM v_table GROUP BY "month" HAVING max(coverage) >= 0.95)""", [V_TABLE])
def month_membership(t: Tables) -> DataFrame:
    months = t.table.groupBy("month").agg(F.max("coverage").alias("coverage"))
    return t.table.join(grid.coverage_gate(months, 0.95), "month", "left_semi")


@query("J11_live_cells", "lat:d lon:d start:t length:l",
       """SELECT lat, lon, min("time") AS start, count(*) AS length FROM (SELECT *, sum(flip) OVER w AS run FROM (
       SELECT lat, lon, "time", flash_count = 0 AS zero, CASE WHEN (flash_count = 0) IS DISTINCT FROM
       lag(flash_count = 0) OVER (PARTITION BY lat, lon ORDER BY "time") THEN 1 ELSE 0 END AS flip FROM v_dense) f
       WINDOW w AS (PARTITION BY lat, lon ORDER BY "time")) r WHERE zero AND (lat, lon) IN (
       SELECT (lat, lon) FROM v_dense GROUP BY lat, lon HAVING sum(flash_count) > 0) GROUP BY lat, lon, run""", DENSE)
def live_cells(t: Tables) -> DataFrame:
    stats = grid.event_statistics(grid.cell_hours(t.strikes, JANUARY))
    return live_zero_runs(zero_runs(grid.densify(grid.skeleton(t.spark, JANUARY), stats), "day"))


@query("J12_key_intersection", "lat:d lon:d time:t",
       """SELECT lat, lon, "time" FROM v_hours INTERSECT SELECT lat + 0.25e0, lon, "time" FROM v_points""",
       [V_HOURS, V_POINTS])
def key_intersection(t: Tables) -> DataFrame:
    moved = t.points.select((F.col("lat") + 0.25).alias("lat"), "lon", "time")
    return grid.skeleton(t.spark, JANUARY).intersect(moved)


@query("J13_name_differences", "name:s status:s",
       """SELECT DISTINCT 'o' || o_custkey AS name, 'extra' AS status FROM orders WHERE o_custkey NOT IN (
       SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) UNION ALL
       SELECT 'o' || c_custkey, 'missing' FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def name_differences(t: Tables) -> DataFrame:
    name = lambda c: F.concat(F.lit("o"), F.col(c)).alias("name")
    expected = t.read("customer").filter("c_custkey % 3 <> 0").select(name("c_custkey"))
    return points.reconcile(expected, t.read("orders").select(name("o_custkey")))


@query("J14_whole_days", "l_orderkey:l l_linenumber:l time:t",
       """SELECT l_orderkey, l_linenumber, "time" FROM v_table WHERE year = 2001 AND date_trunc('day', "time") IN (
       SELECT day FROM (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS m FROM (
       SELECT DISTINCT date_trunc('day', "time") AS day FROM v_table WHERE year = 2001) d) n
       WHERE i IN (SELECT round_even(k * (m - 1) / 29e0, 0) FROM range(30) r(k)))""", [V_TABLE])
def whole_days(t: Tables) -> DataFrame:
    return split.spaced_days(t.table.filter("year = 2001"), 30)


@query("J15_fold_assignment", "fold:l role:s n:l flashes:l",
       "SELECT fold, role, count(*) AS n, sum(flash_count) AS flashes FROM (" + " UNION ALL ".join(
           f"SELECT {i} AS fold, CASE WHEN year = {test} THEN 'test' ELSE 'train' END AS role, flash_count FROM v_table "
           f"WHERE year BETWEEN {train[0]} AND {test}" for i, (train, test) in enumerate(TABLE_FOLDS)) + ") u GROUP BY fold, role",
       [V_TABLE])
def fold_assignment(t: Tables) -> DataFrame:
    folds = split.folds(t.spark, TABLE_FOLDS)
    return split.assign_folds(t.table, folds).groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.sum("flash_count").alias("flashes"))
