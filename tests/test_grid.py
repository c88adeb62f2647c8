"""Grid, density, runs, regridding, windows."""

import datetime as dt
import zoneinfo
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellhour.functions import clean, geo
from cellhour.model import SUBTROPIS, TROPIS
from cellhour.operators import diagnose, evaluate, grid, regrid
from cellhour.plans import build, describe
from cellhour.sources import fields
from workload.adapters import JANUARY

QUICK = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


@QUICK
@given(st.lists(st.floats(-180, 180), min_size=1, max_size=50), st.sampled_from([0.1, 0.25, 0.5, 2.0]))
def test_cell_centres(spark, values, g):
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE").withColumn("c", geo.cell_centre(F.col("v"), g))
    for r in df.withColumn("again", geo.cell_centre(F.col("c"), g)).collect():
        assert abs(r["c"] - r["v"]) <= g / 2 + 1e-9
        assert r["again"] == pytest.approx(r["c"])


@pytest.mark.parametrize("domain,count", [(TROPIS, 30), (SUBTROPIS, 56)])
def test_cells_of_the_two_domains(spark, domain, count):
    assert grid.cells(spark, domain).distinct().count() == count


@pytest.mark.parametrize("g", [0.5, 0.1])
def test_events_meet_the_skeleton_on_any_grid(spark, tables, g):
    dense = grid.dense_table(tables.strikes, JANUARY, g)
    rows, columns = JANUARY.shape(g)
    found = dense.agg(F.count(F.lit(1)).alias("n"), F.sum("flash_count").alias("s")).first()
    boxed = grid.cell_hours(tables.strikes, JANUARY, g).count()
    assert found["n"] == rows * columns * 744 and found["s"] == boxed


def test_dense_table_is_described_and_diagnosed(tables):
    names = ["cape", "tclw", "tciw", "cin", "cbh"]
    field = build.field_predictors(fields.normalise(tables.field, names, keep=["file"]))
    table = build.build(tables.strikes, JANUARY, build.point_predictors(tables.points, JANUARY, ["T2M"]), field).persist()
    for name, frame in {**describe.describe(table), **describe.diagnosis(table)}.items():
        assert frame.limit(1).count() == 1, name
    assert table.columns[:2] == ["domain", "time"] and "p95_abs_peak_current_ka" in table.columns
    table.unpersist()


def test_gate(spark, tables):
    coverage = grid.observed_months(tables.strikes, replace(JANUARY, first_month="2023-12", last_month="2024-01"))
    assert [r["state"] for r in grid.thin_months(coverage, 0.5).orderBy("month").collect()] == ["empty", "kept"]
    with pytest.raises(ValueError):
        grid.coverage_gate(coverage.filter("observed_days = 0"), 0.5)


@QUICK
@given(st.lists(st.integers(0, 1), min_size=1, max_size=80), st.sampled_from(["day", "week", "month"]))
def test_zero_runs_against_brute_force(spark, counts, chunk):
    start = dt.datetime(2024, 1, 30, 20)
    rows = [(1.0, 2.0, start + dt.timedelta(hours=i), c) for i, c in enumerate(counts)]
    df = spark.createDataFrame(rows, "lat DOUBLE, lon DOUBLE, time TIMESTAMP_NTZ, flash_count BIGINT")
    expected, i = [], 0
    while i < len(counts):
        j = i
        while j < len(counts) and counts[j] == counts[i]:
            j += 1
        expected.append((start + dt.timedelta(hours=i), counts[i] == 0, j - i))
        i = j
    got = diagnose.zero_runs(df, chunk).orderBy("start").collect()
    assert [(r["start"], r["is_zero"], r["length"]) for r in got] == expected


def test_clock_changes_become_null(spark):
    zone = zoneinfo.ZoneInfo("America/New_York")
    stamps = [dt.datetime(2024, 3, 10, 0, 30) + dt.timedelta(hours=i) for i in range(5)]
    stamps += [dt.datetime(2024, 11, 3, 0, 30) + dt.timedelta(hours=i) for i in range(4)]
    df = spark.createDataFrame([(s,) for s in stamps], "t TIMESTAMP_NTZ")
    for r in df.withColumn("u", clean.to_utc(F.col("t"), "America/New_York")).collect():
        early, late = (r["t"].replace(tzinfo=zone, fold=f).astimezone(dt.timezone.utc) for f in (0, 1))
        expected = early.replace(tzinfo=None) if early == late else None
        assert r["u"] == expected


def test_nearest_prefers_the_lower_of_two(spark):
    targets = spark.createDataFrame([(-7.75,), (-5.25,), (3.0,)], "t DOUBLE")
    sources = spark.createDataFrame([(-8.0,), (-7.5,), (-5.0,)], "s DOUBLE")
    got = {r["t"]: r["s"] for r in regrid.nearest(targets, sources, "t", "s").collect()}
    assert got == {-7.75: -8.0, -5.25: -5.0, 3.0: -5.0}


def test_monthly_rows_fill_their_month(spark):
    df = spark.createDataFrame([(1.0, 2.0, dt.datetime(2024, 2, 1), 5.0)],
                               "lat DOUBLE, lon DOUBLE, time TIMESTAMP_NTZ, v DOUBLE")
    assert regrid.every_hour(df, "M").count() == 29 * 24


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.5, 2.0, 3.0, 3.1)], "v DOUBLE")
    got = [r[0] for r in df.select(diagnose.right_closed(F.col("v"), [0.0, 1.0, 2.0, 3.0])).collect()]
    assert got == [0, 0, 1, 1, 2, None]


def test_windows_keep_totals(tables):
    total = tables.scored.agg(F.sum("observed")).first()[0]
    sums = evaluate.windows(tables.scored).groupBy("window_h").agg(F.sum("observed").alias("s")).collect()
    assert {r["window_h"] for r in sums} == {1, 3, 6, 24}
    assert all(r["s"] == pytest.approx(total) for r in sums)


def test_area_shrinks_towards_the_pole(spark):
    rows = spark.createDataFrame([(0.25,), (60.25,)], "lat DOUBLE").select(geo.cell_area_km2(F.col("lat"))).collect()
    assert rows[1][0] / rows[0][0] == pytest.approx(np.cos(np.radians(60.25)) / np.cos(np.radians(0.25)))
