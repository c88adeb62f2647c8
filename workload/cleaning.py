"""Projections, filters and row cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellhour.functions import clean, geo
from cellhour.operators import grid
from cellhour.sources import events

from .adapters import JANUARY, V_STRIKES, V_TABLE, Tables
from .registry import query


@query("P1_safe_cast", "event_id:l number:d stamp:t",
       """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS number,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE date_trunc('second', ts) END AS stamp FROM events""")
def safe_cast(t: Tables) -> DataFrame:
    text = t.events.selectExpr(
        "event_id", "CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE concat(' ', CAST(value AS STRING)) END AS v",
        "CASE WHEN event_id % 5 = 0 THEN '31/31/2024' ELSE date_format(CAST(ts AS TIMESTAMP), 'yyyy-MM-dd HH:mm:ss') END AS d")
    return text.select("event_id", clean.number(F.col("v")).alias("number"),
                       clean.timestamp(F.col("d"), "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@query("P3_optional_column", "event_id:l code:s kind:s",
       "SELECT event_id, 'CG' AS code, event_type AS kind FROM events")
def optional_column(t: Tables) -> DataFrame:
    return t.events.select("event_id", clean.optional(t.events, "Discrimination", F.lit("CG")).alias("code"),
                           clean.optional(t.events, "event_type", F.lit("CG")).alias("kind"))


CODED = "CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_type = 'view' THEN 'cg+' WHEN event_type = 'click' THEN 'CG-' ELSE 'IC' END"


@query("P4_prefix_filter", "event_id:l code:s",
       f"SELECT event_id, {CODED} AS code FROM events WHERE upper({CODED}) LIKE 'CG%'")
def prefix_filter(t: Tables) -> DataFrame:
    coded = t.events.select("event_id", F.expr(CODED).alias("code"))
    return coded.filter(clean.has_prefix(F.col("code"), "CG"))


@query("P4b_filter_report", "kept:l dropped:l",
       f"""SELECT count(*) FILTER (WHERE upper({CODED}) LIKE 'CG%') AS kept,
       count(*) - count(*) FILTER (WHERE upper({CODED}) LIKE 'CG%') AS dropped FROM events""")
def filter_report(t: Tables) -> DataFrame:
    coded = t.events.select(F.expr(CODED).alias("code"))
    return events.drop_report(coded, clean.has_prefix(F.col("code"), "CG"))


@query("P5_polarity", "event_id:l by_sign:s by_suffix:s",
       f"""SELECT event_id, CASE WHEN event_id % 9 <> 0 AND peak_current_ka >= 0 THEN 'positive' ELSE 'negative' END AS by_sign,
       CASE WHEN {CODED.replace('event_type', 'source')} LIKE '%+' THEN 'positive' ELSE 'negative' END AS by_suffix
       FROM v_strikes""", [V_STRIKES])
def polarity(t: Tables) -> DataFrame:
    signal = clean.finite(F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("peak_current_ka")))
    return t.strikes.select("event_id", clean.polarity_of_sign(signal).alias("by_sign"),
                            clean.polarity_of_suffix(F.expr(CODED.replace("event_type", "source"))).alias("by_suffix"))


@query("P6_drop_null_keys", "event_id:l lat:d lon:d",
       "SELECT event_id, lat, lon FROM v_strikes WHERE event_id % 8 <> 0 AND event_id % 6 <> 0", [V_STRIKES])
def drop_null_keys(t: Tables) -> DataFrame:
    holes = t.strikes.selectExpr("event_id", "CASE WHEN event_id % 8 <> 0 THEN lat END AS lat",
                                 "CASE WHEN event_id % 6 <> 0 THEN lon END AS lon")
    return holes.na.drop(subset=["lat", "lon"])


@query("P7_deduplicate", "timestamp:t lat:d lon:d peak_current_ka:d source:s",
       """SELECT "timestamp", lat, lon, peak_current_ka, min(source) AS source FROM (
       SELECT "timestamp", lat, lon, peak_current_ka, source FROM v_strikes UNION ALL
       SELECT "timestamp", lat, lon, peak_current_ka, 'copy' FROM v_strikes WHERE event_id % 3 = 0) u
       GROUP BY 1, 2, 3, 4""", [V_STRIKES])
def deduplicate(t: Tables) -> DataFrame:
    rows = t.strikes.select("timestamp", "lat", "lon", "peak_current_ka", "source")
    copies = t.strikes.filter("event_id % 3 = 0").select(
        "timestamp", "lat", "lon", "peak_current_ka", F.lit("copy").alias("source"))
    return events.deduplicate(rows.unionByName(copies))


@query("P8_clock_to_utc", "event_id:l utc:t", "SELECT event_id, ts - to_hours(7) AS utc FROM events")
def clock_to_utc(t: Tables) -> DataFrame:
    return t.events.select("event_id", clean.to_utc(F.col("ts"), "Asia/Jakarta").alias("utc"))


@query("P9_period_bins", "event_id:l hour:t day:t month:t",
       """SELECT event_id, date_trunc('hour', ts) AS "hour", CAST(date_trunc('day', ts) AS TIMESTAMP) AS "day",
       CAST(date_trunc('month', ts) AS TIMESTAMP) AS "month" FROM events""")
def period_bins(t: Tables) -> DataFrame:
    return t.events.select("event_id", *[clean.period(F.col("ts"), u).alias(u) for u in ("hour", "day", "month")])


@query("P10_date_keys", "event_id:l freq:s time:t",
       """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'D' WHEN 2 THEN 'h' END AS freq,
       CASE event_id % 5 WHEN 0 THEN CAST(date_trunc('month', ts) AS TIMESTAMP) WHEN 1 THEN CAST(date_trunc('day', ts) AS TIMESTAMP)
       WHEN 2 THEN date_trunc('hour', ts) END AS "time" FROM events""")
def date_keys(t: Tables) -> DataFrame:
    stamp = F.col("ts").cast("timestamp")
    key = (F.when(F.col("event_id") % 5 == 0, F.date_format(stamp, "yyyyMM"))
           .when(F.col("event_id") % 5 == 1, F.date_format(stamp, "yyyyMMdd"))
           .when(F.col("event_id") % 5 == 2, F.date_format(stamp, "yyyyMMddHH"))
           .when(F.col("event_id") % 5 == 3, "202413").otherwise("2024"))
    keyed = t.events.select("event_id", key.alias("key"))
    return keyed.select("event_id", clean.key_frequency(F.col("key")).alias("freq"),
                        clean.key_period(F.col("key")).alias("time"))


@query("P11_sentinel", "event_id:l value:d",
       "SELECT event_id, CASE WHEN event_id % 10 < 2 THEN NULL ELSE value END AS value FROM events")
def sentinel(t: Tables) -> DataFrame:
    raw = t.events.selectExpr("event_id", "CASE event_id % 10 WHEN 0 THEN -999e0 WHEN 1 THEN -1200e0 ELSE value END AS raw")
    return raw.select("event_id", clean.sentinel_to_null(F.col("raw")).alias("value"))


@query("P12_longitude_wrap", "event_id:l lon:d",
       """SELECT event_id, CASE WHEN x >= 180 THEN x - 360 ELSE x END AS lon FROM (
       SELECT event_id, (event_id % 720) / 2e0 AS x FROM events) e""")
def longitude_wrap(t: Tables) -> DataFrame:
    return t.events.select("event_id", geo.wrap_longitude((F.col("event_id") % 720) / F.lit(2.0)).alias("lon"))


@query("P13_grid_cells", "event_id:l lat_bin:d lon_bin:d",
       """SELECT event_id, floor(lat / 0.5e0) * 0.5e0 + 0.25e0 AS lat_bin, floor(lon / 0.5e0) * 0.5e0 + 0.25e0 AS lon_bin
       FROM v_strikes""", [V_STRIKES])
def grid_cells(t: Tables) -> DataFrame:
    return grid.assign_cells(t.strikes)


@query("P14_snapped_box", "source:s lat_lo:d lat_hi:d lon_lo:d lon_hi:d",
       """SELECT source, floor((min(lat) - 0.3e0) / 0.5e0) * 0.5e0 AS lat_lo, ceil((max(lat) + 0.3e0) / 0.5e0) * 0.5e0 AS lat_hi,
       floor((min(lon) - 0.3e0) / 0.5e0) * 0.5e0 AS lon_lo, ceil((max(lon) + 0.3e0) / 0.5e0) * 0.5e0 AS lon_hi
       FROM v_strikes GROUP BY source""", [V_STRIKES])
def snapped_box(t: Tables) -> DataFrame:
    box = t.strikes.groupBy("source").agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon")
                                            for n, f in (("min", F.min), ("max", F.max))])
    return box.select("source", *[
        e.alias(n) for c in ("lat", "lon") for n, e in (
            (f"{c}_lo", geo.snap_down(F.col(f"min_{c}"), pad=0.3)), (f"{c}_hi", geo.snap_up(F.col(f"max_{c}"), pad=0.3)))])


@query("P15_box_filter", "event_id:l lat_bin:d lon_bin:d",
       """SELECT * FROM (SELECT event_id, floor(lat / 0.5e0) * 0.5e0 + 0.25e0 AS lat_bin,
       floor(lon / 0.5e0) * 0.5e0 + 0.25e0 AS lon_bin FROM v_strikes) g
       WHERE lat_bin BETWEEN -8 AND -5.5 AND lon_bin BETWEEN 106 AND 108.5""", [V_STRIKES])
def box_filter(t: Tables) -> DataFrame:
    from dataclasses import replace
    smaller = replace(JANUARY, lon_max=108.2)
    binned = grid.assign_cells(t.strikes)
    return binned.filter(geo.inside(smaller, F.col("lat_bin"), F.col("lon_bin")))


@query("P16_cell_area", "lat:d area_km2:d",
       "SELECT DISTINCT lat, 55.287e0 * 55.66e0 * cos(radians(lat)) AS area_km2 FROM v_table", [V_TABLE])
def cell_area(t: Tables) -> DataFrame:
    return t.table.select("lat").distinct().withColumn("area_km2", geo.cell_area_km2(F.col("lat")))


@query("P17_density", "time:t lat:d lon:d flash_count:l per_day:d per_year:d per_month:d",
       """SELECT "time", lat, lon, flash_count, flash_count / area_km2 * 24 AS per_day,
       flash_count / area_km2 * 24 * 365.25 AS per_year,
       CASE WHEN observed_days > 0 THEN flash_count / area_km2 / observed_days END AS per_month FROM v_table""", [V_TABLE])
def density(t: Tables) -> DataFrame:
    daily = geo.density_per_day(F.col("flash_count"), F.col("area_km2"), geo.period_days("h"))
    monthly = geo.density_per_day(F.col("flash_count"), F.col("area_km2"),
                                  geo.period_days("M", F.col("observed_days")))
    return t.table.select("time", "lat", "lon", "flash_count", daily.alias("per_day"),
                          geo.density_per_year(daily).alias("per_year"), monthly.alias("per_month"))


@query("P18_calendar", "event_id:l year:l month_of_year:l day_of_year:l hour_of_day_utc:l hour_of_day_local:l",
       """SELECT event_id, year(ts) AS year, month(ts) AS month_of_year, dayofyear(ts) AS day_of_year,
       hour(ts) AS hour_of_day_utc, (hour(ts) + 19) % 24 AS hour_of_day_local FROM events""")
def calendar(t: Tables) -> DataFrame:
    return t.events.withColumns(geo.calendar(F.col("ts"), "Etc/GMT+5"))


@query("P20_row_predicates", "predicate:s n:l",
       """SELECT 'observed' AS predicate, count(*) AS n FROM v_table WHERE coverage > 0 UNION ALL
       SELECT 'training', count(*) FROM v_table WHERE year <> 2001 UNION ALL
       SELECT 'flashing', count(*) FROM v_table WHERE flash_count > 0""", [V_TABLE])
def row_predicates(t: Tables) -> DataFrame:
    labels = F.array_compact(F.array(F.when(F.col("coverage") > 0, "observed"),
                                     F.when(F.col("year") != 2001, "training"),
                                     F.when(F.col("flash_count") > 0, "flashing")))
    return (t.table.select(F.explode(labels).alias("predicate")).groupBy("predicate")
            .agg(F.count(F.lit(1)).alias("n")))


@query("P21_complete_case", "time:t lat:d lon:d CIN:d CBH:d",
       'SELECT "time", lat, lon, "CIN", "CBH" FROM v_table WHERE "CIN" IS NOT NULL AND "CBH" IS NOT NULL', [V_TABLE])
def complete_case(t: Tables) -> DataFrame:
    return t.table.na.drop(subset=["CIN", "CBH"])


@query("P22_absolute_companion", "event_id:l peak_current_ka:d abs_peak:d",
       "SELECT event_id, peak_current_ka, abs(peak_current_ka) AS abs_peak FROM v_strikes", [V_STRIKES])
def absolute_companion(t: Tables) -> DataFrame:
    return t.strikes.withColumn("abs_peak", F.abs("peak_current_ka"))
