"""Folds, chronological splits, stratified draws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellhour.functions import draws
from cellhour.operators import split
from cellhour.plans import experiment

from .adapters import ROW_KEY, TABLE_FOLDS, V_TABLE, Tables
from .registry import query

# A draw number both engines compute alike.
PORTABLE = "(l_orderkey * 48271 + l_partkey * 16807 + l_linenumber * 69621 + l_suppkey * 39373) % 2147483647"
TIE = ", ".join(ROW_KEY)
STRATA = ["lat", "lon", "month_of_year"]
ROW = "l_orderkey:l l_linenumber:l l_partkey:l l_suppkey:l l_extendedprice:d"
ROW_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
TRAIN_YEARS, TEST_YEAR = TABLE_FOLDS[1]
IN_TRAIN = f"year BETWEEN {TRAIN_YEARS[0]} AND {TRAIN_YEARS[-1]}"
CUT = f"""v_cut AS (SELECT quantile_cont(CAST(epoch_us("time") AS DOUBLE), 0.85) AS cut FROM v_table WHERE {IN_TRAIN})"""
V_SPLIT = f"""v_split AS (SELECT *, CASE WHEN year = {TEST_YEAR} THEN 'test' WHEN epoch_us("time") > cut THEN 'validation'
  ELSE 'train' END AS split FROM v_table, v_cut WHERE {IN_TRAIN} OR year = {TEST_YEAR})"""


def portable():
    return F.expr(PORTABLE)


def allocation_sql(name: str, rows: str, n: str) -> str:
    return f"""{name} AS (SELECT lat, lon, month_of_year, size, least(size, fl + CASE WHEN place <= left_over THEN 1 ELSE 0 END) AS take
  FROM (SELECT *, row_number() OVER (ORDER BY exact - fl DESC, lat, lon, month_of_year) AS place,
  {n} - sum(fl) OVER () AS left_over FROM (SELECT *, floor(exact) AS fl FROM (SELECT lat, lon, month_of_year, count(*) AS size,
  count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) * {n} AS exact FROM {rows} GROUP BY 1, 2, 3) a) b) c)"""


def draw_sql(rows: str, quota: str) -> str:
    return f"""SELECT {ROW_SQL}, flash_count FROM (SELECT r.*, take, row_number() OVER (PARTITION BY lat, lon, month_of_year
      ORDER BY {PORTABLE}, {TIE}) AS place FROM {rows} r JOIN {quota} USING (lat, lon, month_of_year)) d WHERE place <= take"""


@query("W4_validation_cut", "cut:d", "SELECT cut FROM v_cut", [V_TABLE, CUT])
def validation_cut(t: Tables) -> DataFrame:
    rows = t.table.filter(F.col("year").isin(TRAIN_YEARS))
    return t.spark.createDataFrame([(float(split.validation_cut(rows)),)], "cut DOUBLE")


@query("W5_allocation", "lat:d lon:d month_of_year:l size:l take:l", "SELECT * FROM v_quota",
       [V_TABLE, allocation_sql("v_quota", "v_table", "1000")])
def allocation(t: Tables) -> DataFrame:
    sizes = t.table.groupBy(*STRATA).agg(F.count(F.lit(1)).alias("size"))
    return draws.allocate(sizes, STRATA, 1000)


@query("W6_stratified_draw", ROW, draw_sql("v_table", "v_quota"), [V_TABLE, allocation_sql("v_quota", "v_table", "5000")])
def stratified_draw(t: Tables) -> DataFrame:
    return draws.stratified_draw(t.table, STRATA, 5000, portable(), ROW_KEY, bucket_rows=50)


@query("W7_spaced_days", "day:t n:l",
       """SELECT CAST(day AS TIMESTAMP) AS "day", n FROM (SELECT day, n, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS m
       FROM (SELECT date_trunc('day', "time") AS day, count(*) AS n FROM v_table WHERE year = 2000 GROUP BY 1) d) n
       WHERE i IN (SELECT round_even(k * (m - 1) / 19e0, 0) FROM range(20) r(k))""", [V_TABLE])
def spaced_days(t: Tables) -> DataFrame:
    kept = split.spaced_days(t.table.filter("year = 2000"), 20)
    return kept.groupBy(F.date_trunc("day", "time").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("V1_folds", "fold:l name:s test_year:l n_train:l n_test:l",
       "SELECT * FROM (" + " UNION ALL ".join(
           f"""SELECT {i} AS fold, 'fold{i}_{tr[0]}-{tr[-1]}_test{te}' AS name, {te} AS test_year,
           count(*) FILTER (WHERE year BETWEEN {tr[0]} AND {tr[-1]}) AS n_train, count(*) FILTER (WHERE year = {te}) AS n_test
           FROM v_table""" for i, (tr, te) in enumerate(TABLE_FOLDS)) + ") f", [V_TABLE])
def folds(t: Tables) -> DataFrame:
    table = split.folds(t.spark, TABLE_FOLDS)
    counted = split.assign_folds(t.table.select("year"), table).groupBy("fold").agg(
        F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "test").alias("n_test"))
    return table.join(counted, "fold")


@query("V2_chronological_split", ROW + " split:s", f"SELECT {ROW_SQL}, split FROM v_split", [V_TABLE, CUT, V_SPLIT])
def chronological_split(t: Tables) -> DataFrame:
    return split.split(t.table, TRAIN_YEARS, TEST_YEAR)


@query("V3_stage_rows", "stage:s n:l", """SELECT 'occurrence' AS stage, count(*) AS n FROM v_table UNION ALL
       SELECT 'count', count(*) FROM v_table WHERE flash_count > 0""", [V_TABLE])
def stage_rows(t: Tables) -> DataFrame:
    counted = lambda s: split.stage_rows(t.table, s).agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit(s))
    return counted("occurrence").unionByName(counted("count"))


@query("V4_subsample", ROW + " flash_count:l", draw_sql("v_train", "v_quota"),
       [V_TABLE, f"v_train AS (SELECT * FROM v_table WHERE {IN_TRAIN})", allocation_sql("v_quota", "v_train", "3000")])
def subsample(t: Tables) -> DataFrame:
    return split.subsample(t.table.filter(F.col("year").isin(TRAIN_YEARS)), 3000, portable(), ROW_KEY)


@query("V4b_balanced_subsample", ROW + " flash_count:l",
       draw_sql("v_zero", "v_zero_quota") + " UNION ALL " + draw_sql("v_rest", "v_rest_quota"),
       [V_TABLE, f"v_zero AS (SELECT * FROM v_table WHERE {IN_TRAIN} AND flash_count = 0)",
        f"v_rest AS (SELECT * FROM v_table WHERE {IN_TRAIN} AND flash_count > 0)",
        allocation_sql("v_zero_quota", "v_zero", "1500"), allocation_sql("v_rest_quota", "v_rest", "500")])
def balanced_subsample(t: Tables) -> DataFrame:
    return split.subsample(t.table.filter(F.col("year").isin(TRAIN_YEARS)), 2000, portable(), ROW_KEY, zero_ratio=0.75)


@query("V5_validation_cap", ROW, draw_sql("v_held", "v_quota"),
       [V_TABLE, CUT, V_SPLIT, "v_held AS (SELECT * FROM v_split WHERE split = 'validation')",
        allocation_sql("v_quota", "v_held", "1000")])
def validation_cap(t: Tables) -> DataFrame:
    held = split.split(t.table, TRAIN_YEARS, TEST_YEAR).filter("split = 'validation'")
    return split.cap(held, 1000, portable(), ROW_KEY)


SETTINGS = experiment.Settings(features=("T2M", "CAPE", "RH2M"), train_rows=None, validation_rows=None, test_days=None)


def scaled_sql(c: str) -> str:
    unit = f'("{c}" - lo_{c}) / (hi_{c} - lo_{c})'
    return f"avg(pi() * CASE WHEN split = 'train' THEN {unit} ELSE greatest(0e0, least(1e0, {unit})) END)"


@query("V6_prepared_dataset", "split:s n:l T2M:d CAPE:d RH2M:d hour_sin:d y:d",
       f"""SELECT split, count(*) AS n, {scaled_sql('T2M')} AS "T2M", {scaled_sql('CAPE')} AS "CAPE", {scaled_sql('RH2M')} AS "RH2M",
       {scaled_sql('hour_sin')} AS hour_sin, avg((ln(1e0 + flash_count) - m) / s) AS y FROM v_rows, (SELECT
       {', '.join(f'min("{c}") AS "lo_{c}", max("{c}") AS "hi_{c}"' for c in ('T2M', 'CAPE', 'RH2M', 'hour_sin'))},
       avg(ln(1e0 + flash_count)) AS m, stddev_pop(ln(1e0 + flash_count)) AS s FROM v_rows WHERE split = 'train') f GROUP BY split""",
       [V_TABLE, CUT, V_SPLIT, """v_rows AS (SELECT *, sin(2 * pi() * hour_of_day_local / 24e0) AS hour_sin FROM v_split
       WHERE flash_count > 0)"""])
def prepared_dataset(t: Tables) -> DataFrame:
    done = experiment.prepare(t.table, TABLE_FOLDS[1], "count", 0, SETTINGS, ROW_KEY)
    out = None
    for name in ("train", "validation", "test"):
        part = getattr(done, name).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in (
            "T2M", "CAPE", "RH2M", "hour_sin", "y")]).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("V7_pooled_domains", "domain:s n:l flashes:l", """SELECT domain, count(*) AS n, sum(flash_count) AS flashes FROM v_table
       GROUP BY domain""", [V_TABLE])
def pooled_domains(t: Tables) -> DataFrame:
    frames = [t.table.filter(F.col("domain") == d) for d in ("tropis", "subtropis")]
    return split.pooled(frames).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.sum("flash_count").alias("flashes"))
