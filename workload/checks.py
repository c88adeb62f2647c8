"""Data-quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellhour.model import INTENSITY
from cellhour.operators import grid, quality
from cellhour.sources import points

from .adapters import DENSE, JANUARY, ROW_KEY, V_POINTS, V_SCORED, V_STRIKES, V_TABLE, Tables
from .registry import query


@query("C6_key_overlap", "n_keys:l n_covered:l share:d verdict:s",
       """SELECT count(*) AS n_keys, count(p.hit) AS n_covered, count(p.hit) / CAST(count(*) AS DOUBLE) AS share,
       CASE WHEN count(p.hit) = 0 THEN 'none' WHEN count(p.hit) < 0.5 * count(*) THEN 'low' ELSE 'ok' END AS verdict
       FROM v_hours h LEFT JOIN (SELECT DISTINCT lat + 0.25e0 AS lat, lon, "time", 1 AS hit FROM v_points
       WHERE value IS NOT NULL) p ON h.lat = p.lat AND h.lon = p.lon AND h."time" = p."time" """,
       [V_POINTS, DENSE[1]])
def key_overlap(t: Tables) -> DataFrame:
    table = grid.skeleton(t.spark, JANUARY)
    wide = points.parameter_matrix(t.points.withColumn("lat", F.col("lat") + 0.25))
    return quality.key_overlap(table, wide)


@query("C7_completeness", "n_rows:l n_cells:l n_hours:l complete:b",
       """SELECT count(*) AS n_rows, count(DISTINCT (lat, lon)) AS n_cells, count(DISTINCT "time") AS n_hours,
       count(*) = count(DISTINCT (lat, lon)) * count(DISTINCT "time") AS complete FROM v_dense""", DENSE)
def completeness(t: Tables) -> DataFrame:
    return quality.completeness(grid.dense_table(t.strikes, JANUARY))


@query("C8_metadata_drift", "fact:s recorded:l actual:l",
       """SELECT 'n_rows' AS fact, count(*) AS recorded, count(*) FILTER (WHERE year <> 2001) AS actual FROM v_table
       UNION ALL SELECT 'n_cells', count(DISTINCT (lat, lon)),
       count(DISTINCT (lat, lon)) FILTER (WHERE lat < -6) FROM v_table""", [V_TABLE])
def metadata_drift(t: Tables) -> DataFrame:
    """A table that lost a year, and one that lost its northern cells, against the full table's facts."""
    known = t.table.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("lat", "lon").alias("n_cells")).first()
    rows = quality.metadata_drift(t.table.filter("year <> 2001"), {"n_rows": known["n_rows"]})
    cells = quality.metadata_drift(t.table.filter("lat < -6"), {"n_cells": known["n_cells"]})
    found = [(k, *v) for k, v in {**rows, **cells}.items()]
    return t.spark.createDataFrame(found, "fact STRING, recorded BIGINT, actual BIGINT")


@query("C9_duplicates", "n_duplicate_keys:l n_duplicate_rows:l",
       """SELECT (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM r GROUP BY lat, lon, "timestamp") k) AS n_duplicate_keys,
       (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM r GROUP BY lat, lon, "timestamp", source) w) AS n_duplicate_rows""",
       [V_STRIKES, """r AS (SELECT lat, lon, "timestamp", source FROM v_strikes UNION ALL
       SELECT lat, lon, "timestamp", CASE WHEN event_id % 4 = 0 THEN 'copy' ELSE source END FROM v_strikes WHERE event_id % 3 = 0)"""])
def duplicates(t: Tables) -> DataFrame:
    rows = t.strikes.select("lat", "lon", "timestamp", "source")
    copies = t.strikes.filter("event_id % 3 = 0").selectExpr(
        "lat", "lon", "timestamp", "CASE WHEN event_id % 4 = 0 THEN 'copy' ELSE source END AS source")
    return quality.duplicates(rows.unionByName(copies), ["lat", "lon", "timestamp"])


PREDICTORS = ["PS", "T2M", "CAPE", "CIN", "CBH", "GONE"]


@query("C10_missing_predictors", "predictor:s null_share:d all_missing:b",
       "SELECT * FROM (" + " UNION ALL ".join(
           f"""SELECT '{p}' AS predictor, avg(CASE WHEN {'NULL' if p == 'GONE' else chr(34) + p + chr(34)} IS NULL THEN 1e0 ELSE 0e0 END)
           AS null_share, count({'NULL' if p == 'GONE' else chr(34) + p + chr(34)}) = 0 AS all_missing FROM v_table"""
           for p in PREDICTORS) + ") u", [V_TABLE])
def missing_predictors(t: Tables) -> DataFrame:
    return quality.missing_predictors(t.table.withColumn("GONE", F.lit(None).cast("double")), PREDICTORS)


@query("C11_dead_cells", "lat:d lon:d n_rows:l",
       """SELECT lat, lon, count(*) AS n_rows FROM q GROUP BY lat, lon HAVING sum(flash_count) = 0""",
       [V_TABLE, "q AS (SELECT lat, lon, CASE WHEN lat > -7 THEN 0 ELSE flash_count END AS flash_count FROM v_table)"])
def dead_cells(t: Tables) -> DataFrame:
    quiet = t.table.selectExpr("lat", "lon", "CASE WHEN lat > -7 THEN 0L ELSE flash_count END AS flash_count")
    return quality.dead_cells(quiet)


@query("C11b_without_dead_cells", "lat:d lon:d n:l",
       """SELECT lat, lon, count(*) AS n FROM v_table WHERE lat <= -7 GROUP BY lat, lon""", [V_TABLE])
def without_dead_cells(t: Tables) -> DataFrame:
    quiet = t.table.selectExpr("lat", "lon", "CASE WHEN lat > -7 THEN 0L ELSE flash_count END AS flash_count")
    return quality.without_dead_cells(quiet).groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"))


@query("C12_intensity_usable", "n_nonzero:l n_usable:l share:d",
       "SELECT count(*) AS n_nonzero, count(*) FILTER (WHERE ok) AS n_usable, count(*) FILTER (WHERE ok) / CAST(count(*) AS DOUBLE) AS share "
       "FROM (SELECT " + " AND ".join(f"{c} IS NOT NULL" for c in INTENSITY) + " AS ok FROM v_table WHERE flash_count > 0) x",
       [V_TABLE])
def intensity_usable(t: Tables) -> DataFrame:
    return quality.intensity_usable(t.table)


@query("C13_fit_inputs", "column:s n_bad:l iqr:d fits:b",
       "SELECT *, n_bad = 0 AND iqr > 0 AS fits FROM (" + " UNION ALL ".join(
           f"""SELECT '{c}' AS "column", count(*) - count("{c}") AS n_bad,
           quantile_cont("{c}", 0.75) - quantile_cont("{c}", 0.25) AS iqr FROM v_table"""
           for c in ("CAPE", "T2M", "CIN", "flash_count")) + ") u", [V_TABLE])
def fit_inputs(t: Tables) -> DataFrame:
    return quality.fit_inputs(t.table, ["CAPE", "T2M", "CIN", "flash_count"])


@query("C14_alignment", "left_only:l right_only:l",
       """SELECT count(*) FILTER (WHERE l_linenumber = 7) AS left_only, 0 AS right_only FROM v_scored""", [V_SCORED])
def alignment(t: Tables) -> DataFrame:
    return quality.alignment(t.scored, t.scored.filter("l_linenumber <> 7"), [*ROW_KEY, "time"])


@query("C15_fingerprint", "variant:s same:b n_rows:l",
       """SELECT 'reordered' AS variant, TRUE AS same, count(*) AS n_rows FROM v_table UNION ALL
       SELECT 'changed', FALSE, count(*) FROM v_table""", [V_TABLE])
def fingerprint(t: Tables) -> DataFrame:
    """The same rows in another order and layout keep their fingerprint; one changed column does not."""
    base = quality.fingerprint(t.table.select("lat", "lon", "time", "CAPE"))
    moved = quality.fingerprint(t.table.select("CAPE", "time", "lon", "lat").repartition("time", "lon", "lat", "CAPE"))
    bent = quality.fingerprint(t.table.selectExpr("lat", "lon", "time", "CAPE + 1 AS CAPE"))
    first = base.select(F.col("xor").alias("x"), F.col("checksum").alias("c"), F.col("n_rows").alias("n"))
    compare = lambda other, name: other.join(F.broadcast(first), F.lit(True)).select(
        F.lit(name).alias("variant"), ((F.col("xor") == F.col("x")) & (F.col("checksum") == F.col("c"))).alias("same"),
        "n_rows")
    return compare(moved, "reordered").unionByName(compare(bent, "changed"))
