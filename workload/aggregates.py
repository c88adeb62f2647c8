"""Aggregation of events, points and field rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellhour.functions import clean
from cellhour.model import DAILY_STATISTIC
from cellhour.operators import grid, periods, profile
from cellhour.sources import fields, points

from .adapters import DENSE, JANUARY, V_FIELD, V_POINTS, V_STRIKES, V_TABLE, Tables
from .joins import POINT_ROWS
from .registry import query

STATISTICS = ("flash_count:l mean_peak_current_ka:d positive_share:d median_abs_peak_current_ka:d "
              "max_abs_peak_current_ka:d p95_abs_peak_current_ka:d")


@query("A1_event_cell_hour", "lat:d lon:d time:t " + STATISTICS, "SELECT * FROM v_agg", DENSE)
def event_cell_hour(t: Tables) -> DataFrame:
    return grid.event_statistics(grid.cell_hours(t.strikes, JANUARY))


@query("A1b_dense_cell_hours", "domain:s lat:d lon:d time:t month:t area_km2:d observed_days:l coverage:d "
                               "gfd_per_km2_per_day:d gfd_per_km2_per_year:d " + STATISTICS,
       """SELECT 'tropis' AS domain, *, flash_count / area_km2 * 24 AS gfd_per_km2_per_day,
       flash_count / area_km2 * 24 * 365.25 AS gfd_per_km2_per_year FROM v_dense""", DENSE)
def dense_cell_hours(t: Tables) -> DataFrame:
    return grid.dense_table(t.strikes, JANUARY)


@query("A1c_hot_cell_statistics", "lat:d lon:d time:t " + STATISTICS,
       """SELECT lat, lon, "time", count(*) AS flash_count, avg(peak) AS mean_peak_current_ka,
       avg(CASE WHEN peak >= 0 THEN 1e0 ELSE 0e0 END) AS positive_share,
       quantile_cont(abs(peak), 0.5) AS median_abs_peak_current_ka, max(abs(peak)) AS max_abs_peak_current_ka,
       quantile_cont(abs(peak), 0.95) AS p95_abs_peak_current_ka FROM hot GROUP BY 1, 2, 3""",
       [V_STRIKES, """hot AS (SELECT peak_current_ka AS peak, CASE WHEN event_id % 3 = 0 THEN -6.25e0 ELSE floor(lat / 0.5e0) * 0.5e0 + 0.25e0 END AS lat,
       CASE WHEN event_id % 3 = 0 THEN 107.25e0 ELSE floor(lon / 0.5e0) * 0.5e0 + 0.25e0 END AS lon,
       CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-01-01' ELSE date_trunc('hour', "timestamp") END AS "time" FROM v_strikes)"""])
def hot_cell_statistics(t: Tables) -> DataFrame:
    """A third of all events in one cell-hour: that group goes through sliced running totals."""
    moved = F.col("event_id") % 3 == 0
    events = t.strikes.withColumns({
        "lat": F.when(moved, -6.25).otherwise(F.col("lat")), "lon": F.when(moved, 107.25).otherwise(F.col("lon")),
        "timestamp": F.when(moved, F.lit("2024-01-01").cast("timestamp_ntz")).otherwise(F.col("timestamp"))})
    labelled = grid.cell_hours(events, JANUARY)
    return grid.event_statistics(labelled, hot_rows=1000)


def period_sql(unit: str, times: str, days: str) -> str:
    """Dense statistics of a period, from the events themselves."""
    return f"""WITH a AS (SELECT floor(lat / 0.5e0) * 0.5e0 + 0.25e0 AS lat, floor(lon / 0.5e0) * 0.5e0 + 0.25e0 AS lon,
       date_trunc('{unit}', "timestamp") AS "time", count(*) AS flash_count, avg(peak_current_ka) AS mean_peak_current_ka,
       avg(CASE WHEN polarity = 'positive' THEN 1e0 ELSE 0e0 END) AS positive_share,
       quantile_cont(abs(peak_current_ka), 0.5) AS median_abs_peak_current_ka, max(abs(peak_current_ka)) AS max_abs_peak_current_ka,
       quantile_cont(abs(peak_current_ka), 0.95) AS p95_abs_peak_current_ka FROM v_strikes GROUP BY 1, 2, 3),
       h AS (SELECT -7.75e0 + i / 2e0 AS lat, 106.25e0 + j / 2e0 AS lon, "time", 55.287e0 * 55.66e0 * cos(radians(-7.75e0 + i / 2e0)) AS area_km2
       FROM range(5) x(i), range(6) y(j), (SELECT {times} AS "time") z)
       SELECT h.lat, h.lon, h."time", date_trunc('month', h."time") AS "month", h.area_km2, {days} AS period_days,
       c.observed_days, c.coverage, coalesce(a.flash_count, 0) AS flash_count,
       coalesce(a.flash_count, 0) / h.area_km2 / {days} AS gfd_per_km2_per_day, mean_peak_current_ka, positive_share,
       median_abs_peak_current_ka, max_abs_peak_current_ka, p95_abs_peak_current_ka
       FROM h LEFT JOIN a ON h.lat = a.lat AND h.lon = a.lon AND h."time" = CAST(a."time" AS TIMESTAMP), v_coverage c"""


PERIOD_COLUMNS = ("lat:d lon:d time:t month:t area_km2:d period_days:d observed_days:l coverage:d gfd_per_km2_per_day:d "
                  + STATISTICS)


@query("A1d_cell_day", PERIOD_COLUMNS,
       period_sql("day", "unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY))", "1e0"), DENSE)
def cell_day(t: Tables) -> DataFrame:
    return periods.tables(t.strikes, JANUARY, ["day"])["day"]


@query("A1e_cell_month", PERIOD_COLUMNS, period_sql("month", "TIMESTAMP '2024-01-01'", "nullif(c.observed_days * 1e0, 0)"), DENSE)
def cell_month(t: Tables) -> DataFrame:
    """Months hold many different peaks: with this limit their percentiles come from sliced totals."""
    return periods.tables(t.strikes, JANUARY, ["month"], hot_values=20)["month"]


@query("A2_observed_months", "month:t observed_days:l days_in_month:l coverage:d",
       """SELECT m AS "month", count(DISTINCT CAST(ts AS DATE)) AS observed_days, day(last_day(m)) AS days_in_month,
       count(DISTINCT CAST(ts AS DATE)) / CAST(day(last_day(m)) AS DOUBLE) AS coverage
       FROM (SELECT TIMESTAMP '2023-11-01' + to_months(i) AS m FROM range(5) r(i)) g
       LEFT JOIN events ON date_trunc('month', ts) = m GROUP BY m""")
def observed_months(t: Tables) -> DataFrame:
    from dataclasses import replace
    return grid.observed_months(t.strikes, replace(JANUARY, first_month="2023-11", last_month="2024-03"))


@query("A3_coverage_gate", "month:t observed_days:l coverage:d state:s",
       """SELECT *, CASE WHEN observed_days = 0 THEN 'empty' WHEN coverage < 0.95 THEN 'thin' ELSE 'kept' END AS state
       FROM (SELECT "month", max(observed_days) AS observed_days, max(coverage) AS coverage FROM v_table GROUP BY "month") m""",
       [V_TABLE])
def coverage_gate(t: Tables) -> DataFrame:
    months = t.table.groupBy("month").agg(F.max("observed_days").alias("observed_days"),
                                          F.max("coverage").alias("coverage"))
    return grid.thin_months(months, 0.95)


CELL_OF_FIELD = """floor(latitude / 0.5e0) * 0.5e0 + 0.25e0 AS lat,
  floor((CASE WHEN longitude > 180 THEN longitude - 360 ELSE longitude END) / 0.5e0) * 0.5e0 + 0.25e0 AS lon"""
FIELD_NAMES = ["cape", "kx", "tciw", "tclw", "cin", "cbh"]


@query("A4_spatial_mean", "lat:d lon:d time:t " + " ".join(f"{c}:d" for c in FIELD_NAMES),
       f"""SELECT {CELL_OF_FIELD}, date_trunc('hour', valid_time) AS "time", {', '.join(f'avg({c}) AS {c}' for c in FIELD_NAMES)}
       FROM v_field GROUP BY 1, 2, 3""", [V_FIELD])
def spatial_mean(t: Tables) -> DataFrame:
    return fields.spatial_mean(fields.normalise(t.field))


@query("A4b_mean_of_files", "lat:d lon:d time:t " + " ".join(f"{c}:d" for c in FIELD_NAMES),
       f"""SELECT lat, lon, "time", {', '.join(f'avg({c}) AS {c}' for c in FIELD_NAMES)} FROM (
       SELECT file, {CELL_OF_FIELD}, date_trunc('hour', valid_time) AS "time",
       {', '.join(f'avg({c}) AS {c}' for c in FIELD_NAMES)} FROM v_field GROUP BY 1, 2, 3, 4) p GROUP BY 1, 2, 3""", [V_FIELD])
def mean_of_files(t: Tables) -> DataFrame:
    return fields.mean_of_files(fields.normalise(t.field, keep=["file"]))


@query("A5_parameter_matrix", "lat:d lon:d time:t PS:d PRECTOTCORR:d T2M:d RH2M:d WS2M:d",
       "SELECT * FROM v_wide", [V_POINTS, POINT_ROWS])
def parameter_matrix(t: Tables) -> DataFrame:
    return points.parameter_matrix(t.points)


@query("A6_daily_statistics", "lat:d lon:d time:t cape:d kx:d tciw:d cin:d",
       """SELECT latitude AS lat, CASE WHEN longitude > 180 THEN longitude - 360 ELSE longitude END AS lon,
       CAST(date_trunc('day', valid_time) AS TIMESTAMP) AS "time", max(cape) AS cape, max(kx) AS kx, avg(tciw) AS tciw,
       avg(cin) AS cin FROM v_field GROUP BY 1, 2, 3
       HAVING count(cape) >= 3 AND count(kx) >= 3 AND count(tciw) >= 3 AND count(cin) >= 3""", [V_FIELD])
def daily_statistics(t: Tables) -> DataFrame:
    rows = fields.normalise(t.field).select("lat", "lon", "time", "cape", "kx", "tciw", "cin")
    return fields.daily_statistics(rows, DAILY_STATISTIC, hours=3)


@query("A7_zero_shares", "zero_share:d nonzero_share:d n_observed:l zero_share_observed:d",
       """SELECT avg(CASE WHEN flash_count = 0 THEN 1e0 ELSE 0e0 END) AS zero_share,
       avg(CASE WHEN flash_count <> 0 THEN 1e0 ELSE 0e0 END) AS nonzero_share, count(*) FILTER (WHERE coverage > 0) AS n_observed,
       avg(CASE WHEN flash_count = 0 THEN 1e0 ELSE 0e0 END) FILTER (WHERE coverage > 0) AS zero_share_observed FROM v_table""",
       [V_TABLE])
def zero_shares(t: Tables) -> DataFrame:
    return profile.zero_shares(t.table)


@query("A13_diurnal", "hour_local:l n:l is_peak:b peak_in_afternoon:b",
       """SELECT h AS hour_local, n, h = peak AS is_peak, peak BETWEEN 12 AND 21 AS peak_in_afternoon FROM (
       SELECT h, n, first_value(h) OVER (ORDER BY n DESC, h) AS peak FROM (
       SELECT h, count(ts) AS n FROM range(24) r(h) LEFT JOIN events ON (hour(ts) + 7) % 24 = h GROUP BY h) c) p""")
def diurnal(t: Tables) -> DataFrame:
    return grid.diurnal(t.strikes, "Asia/Jakarta")


@query("A13b_one_month_check", "day:t n:l cells:l",
       """SELECT CAST(date_trunc('day', "time") AS TIMESTAMP) AS "day", sum(flash_count) AS n,
       count(*) FILTER (WHERE flash_count > 0) AS cells FROM v_dense GROUP BY 1""", DENSE)
def one_month_check(t: Tables) -> DataFrame:
    dense = grid.dense_table(t.strikes, JANUARY)
    return dense.groupBy(clean.period(F.col("time"), "day").alias("day")).agg(
        F.sum("flash_count").alias("n"), F.count_if(F.col("flash_count") > 0).alias("cells"))
