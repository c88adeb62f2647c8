"""Manifests and open days against day-by-day counting."""

import datetime as dt
import random

import pytest

from cellhour.model import Domain
from cellhour.sources import manifest, points

BOX = Domain("tropis", -8.0, -5.5, 106.0, 109.0, "2023-11", "2025-02")
START = dt.date(2023, 12, 10)
SPANS = "k STRING, first DATE, last DATE"


def drawn(seed, n):
    pick = random.Random(seed)
    return [(pick.choice(["a", "b", None]), pick.randint(0, 420), pick.randint(-3, 70)) for _ in range(n)]


def spans(spark, rows):
    day = lambda n: START + dt.timedelta(days=n)
    return spark.createDataFrame([(k, day(a), day(a + n)) for k, a, n in rows], SPANS)


def days(rows):
    return {(k, d) for k, a, n in rows if k for d in range(a, a + n + 1)}


@pytest.mark.parametrize("seed, n_wanted, n_found", [(1, 8, 10), (2, 12, 30), (3, 3, 0), (4, 0, 5)])
def test_open_days(spark, seed, n_wanted, n_found):
    wanted, found = drawn(seed, n_wanted), drawn(seed + 10, n_found)
    got = manifest.uncovered(spans(spark, wanted), spans(spark, found), ["k"]).collect()
    listed = [(r["k"], (r["first"] - START).days + i) for r in got for i in range(r["n_days"])]
    assert len(listed) == len(set(listed))
    assert set(listed) == days(wanted) - days(found)
    held = set(listed)
    for r in got:  # spans are as long as they can be
        assert (r["k"], (r["first"] - START).days - 1) not in held
        assert (r["k"], (r["last"] - START).days + 1) not in held
        assert r["n_days"] == (r["last"] - r["first"]).days + 1


def test_complete_acquisition_has_no_open_days(spark):
    files = manifest.point_manifest(spark, BOX, {"PS": "h", "T2M": "D", "RH2M": "M"})
    assert files.count() == 30 * 3 + 3 + 1
    assert manifest.point_gaps(spark, BOX, files).isEmpty()
    assert manifest.off_grid(spark, BOX, files).isEmpty()
    read = manifest.point_files(files, "tropis")
    assert read.exceptAll(files.select(*read.columns)).isEmpty() and read.count() == files.count()
    hourly = points.expected_files(spark, BOX)
    assert hourly.exceptAll(files.filter("freq = 'h'").select("name")).isEmpty()


def test_names_that_say_nothing(spark):
    names = [(n,) for n in (
        None, "", "notes.txt", "power_tropis_hourly_m008p000_p106p250_20240101_20231231.json",
        "power_tropis_hourly_m008p000_p106p250_20240231_20241231.json",
        "power_tropis_hourly_m008p100_p106p250_20240101_20241231.json")]
    table = spark.createDataFrame(names, "name STRING")
    off = manifest.off_grid(spark, BOX, table).collect()
    assert [(r["lat"], r["lon"]) for r in off] == [(-8.1, 106.25)]
    gaps = manifest.point_gaps(spark, BOX, table)
    whole = [(r["first"], r["last"]) for r in gaps.collect()]
    assert whole == [(dt.date(2023, 11, 1), dt.date(2025, 2, 28))] * 30
    assert manifest.point_gaps(spark, BOX, table.limit(0)).count() == 30


def test_windows(spark):
    cut = [tuple(r) for r in manifest.windows(spark, BOX, 30).orderBy("first").collect()]
    assert cut[0] == (dt.date(2023, 11, 1), dt.date(2023, 11, 30)) and cut[-1][1] == dt.date(2025, 2, 28)
    assert all(b[0] == a[1] + dt.timedelta(days=1) for a, b in zip(cut, cut[1:]))
    assert manifest.windows(spark, BOX, "month").count() == 16
    assert [tuple(r) for r in manifest.windows(spark, BOX, "whole").collect()] == [
        (dt.date(2023, 1, 1), dt.date(2025, 12, 31))]
    assert manifest.windows(spark, BOX, "year").count() == 3
    names = {r["name"] for r in manifest.field_manifest(spark, BOX, ["cin"]).collect()}
    assert len(names) == 32 and {"era5_tropis_hourly_202402.nc", "era5_tropis_hourly_202402_cin.nc"} <= names
