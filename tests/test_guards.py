"""Everything that should raise, and files on disk."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from cellhour import model
from cellhour.functions import encode
from cellhour.operators import features, quality, split
from cellhour.plans import screen
from cellhour.sources import events, fields, points, table


def test_name_lists():
    for call in (lambda: model.require({"a": ["CAPE", "flash_count"]}, {"outcome"}), lambda: model.require({"a": []}, {"outcome"}),
                 lambda: model.require({"a": ["year"]}, {"calendar"}), lambda: model.require({"a": ["lat"]}, {"place"}),
                 lambda: model.require({"a": ["x"], "b": ["x", "y"]}, set(), same_width=True)):
        with pytest.raises(model.ContractError):
            call()
    report = model.role_gaps(["lat", "lon", "CAPE", "mystery"])
    assert report["unclassified"] == ["mystery"] and "CIN" in report["missing"]


def test_grid_must_be_complete_and_unique(tables):
    rows = tables.table.select("lat", "lon", "time", "flash_count")
    with pytest.raises(AssertionError):
        quality.check_complete(rows)
    with pytest.raises(AssertionError):
        quality.check_unique(rows.unionByName(rows.limit(3)))


def test_keys_must_match(tables):
    rows = tables.table.select("lat", "lon", "time")
    with pytest.raises(TypeError):
        quality.check_keys(rows, rows.withColumn("time", F.col("time").cast("timestamp")), "typed")
    with pytest.raises(ValueError):
        quality.check_keys(rows, rows.withColumn("lat", F.col("lat") + 100), "moved")
    with pytest.raises(ValueError):
        quality.check_aligned(rows, rows.limit(10))


def test_scaler_refuses_bad_columns(tables):
    with pytest.raises(ValueError):
        features.AngleScaler.fit(tables.table.select("CIN"), ["CIN"])
    with pytest.raises(ValueError):
        features.AngleScaler.fit(tables.table.select(F.lit(1.0).alias("T2M")), ["T2M"])
    with pytest.raises(ValueError):
        features.AngleScaler.fit(tables.table.select("CAPE", "T2M"), ["T2M", "CAPE"])
    with pytest.raises(KeyError):
        features.matrix(tables.table, ["nothing"])
    with pytest.raises(ValueError):
        features.components_wanted("umap3")


def test_scaler_travels_as_json(tables):
    fitted = features.AngleScaler.fit(tables.table.select("T2M", "RH2M"), ["T2M", "RH2M"])
    again = features.AngleScaler.from_json(fitted.to_json())
    assert again == fitted
    found = again.apply(tables.table.select("T2M", "RH2M")).agg(F.min("T2M"), F.max("T2M"), F.min("RH2M"), F.max("RH2M")).first()
    assert all(0 <= v <= 3.1415927 for v in found)


def test_split_needs_both_sides(tables):
    with pytest.raises(ValueError):
        split.split(tables.table, [1900], 2001)
    with pytest.raises(ValueError):
        encode.stage_target(F.lit(1), "third")


def test_mixed_key_lengths_raise(spark, tmp_path):
    doc = {"type": "Feature", "geometry": {"coordinates": [106.25, -7.5, 3.0]},
           "properties": {"parameter": {"T2M": {"2024010100": 1.0, "20240101": 2.0}}}}
    (tmp_path / "mixed.json").write_text(json.dumps(doc))
    with pytest.raises(ValueError, match="mixed"):
        points.read_points(spark, str(tmp_path))


def test_documents_without_values_raise(spark, tmp_path):
    (tmp_path / "odd.json").write_text(json.dumps({"type": "Something"}))
    with pytest.raises(ValueError, match="no dated values"):
        points.read_points(spark, str(tmp_path))


def test_monthly_document(spark, tmp_path):
    feature = {"type": "Feature", "geometry": {"coordinates": [106.25, -7.5, 3.0]},
               "properties": {"parameter": {"T2M": {"202401": 1.0, "202402": -999.0, "202413": 7.0}}}}
    (tmp_path / "all.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}))
    rows = sorted(points.read_points(spark, str(tmp_path)).collect(), key=lambda r: r["time"])
    assert [(r["time"], r["value"], r["freq"]) for r in rows] == [
        (dt.datetime(2024, 1, 1), 1.0, "M"), (dt.datetime(2024, 2, 1), None, "M")]


def test_missing_columns_and_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Time\n01/02/2024,03:04:05.0000001\n")
    with pytest.raises(ValueError):
        events.normalise_csv(events.read_text_table(spark, str(tmp_path), "*.csv"))
    with pytest.raises(FileNotFoundError):
        events.combine([])
    with pytest.raises(ValueError):
        fields.normalise(spark.createDataFrame([(1.0, 2.0)], "latitude DOUBLE, longitude DOUBLE"))


def test_csv_rules(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        " Date ,Time,Latitude,Longitude ,Signal Strength\n"
        "01/02/2024,03:04:05.1234567,1.5,2.5,-7\n01/02/2024,03:04:05.1234567,1.5,2.5,-7\n"
        "01/02/2024,03:04:06.1234567,1.5,2.5,\n01/02/2024,bad,1.5,2.5,3\n01/02/2024,03:04:07.0000000,,2.5,3\n")
    rows = sorted(events.read_strikes(spark, str(tmp_path)).collect(), key=lambda r: r["timestamp"])
    assert [(r["timestamp"].microsecond, r["peak_current_ka"], r["polarity"]) for r in rows] == [
        (123456, -7.0, "negative"), (123456, None, "negative")]
    assert rows[0]["source"] == "csv:a.csv"


@pytest.mark.parametrize("names", ["ab", "ba"])
def test_csv_columns_go_by_name(spark, tmp_path, names):
    (tmp_path / f"{names[0]}.csv").write_text("Date,Time,Latitude,Longitude,Signal Strength\n01/02/2024,03:04:05.0000001,1.5,2.5,-7\n")
    (tmp_path / f"{names[1]}.csv").write_text("Longitude,Latitude,Time,Date\n20,10,03:04:06.0000001,01/02/2024\n")
    rows = sorted(events.read_strikes(spark, str(tmp_path)).collect(), key=lambda r: r["lat"])
    assert [(r["lat"], r["lon"], r["peak_current_ka"]) for r in rows] == [(1.5, 2.5, -7.0), (10.0, 20.0, None)]


def test_listing_reconciles(spark, tmp_path):
    (tmp_path / "x.json").write_text("{}")
    (tmp_path / "y.json").write_text("{}")
    expected = spark.createDataFrame([("x.json",), ("z.json",)], "name STRING")
    got = points.reconcile(expected, points.list_files(spark, str(tmp_path), "*.json"))
    assert {(r["name"], r["status"]) for r in got.collect()} == {("z.json", "missing"), ("y.json", "extra")}


def test_mirror_guard_and_sidecar(spark, tables, tmp_path):
    rows = tables.table
    with pytest.raises(ValueError):
        table.csv_mirror(rows.select("lat"), str(tmp_path / "m"), limit=10)
    written = table.write_sidecar(rows, model.TROPIS, str(tmp_path / "s"))
    assert table.read_sidecar(spark, str(tmp_path / "s"))["n_rows"] == written["n_rows"] == rows.count()
    assert quality.metadata_drift(rows, written) == {}
    drift = quality.metadata_drift(rows.drop("CAPE").limit(5), written)
    assert set(drift) >= {"n_rows", "columns"}


def test_stored_sets_are_checked(spark, tmp_path):
    bad = spark.createDataFrame([("shared", None, "count", 1, "lat")], screen.SET_SCHEMA)
    with pytest.raises(model.ContractError):
        screen.write_sets(bad, str(tmp_path / "sets"))


def test_lines_are_documents_of_their_own(spark, tmp_path):
    feature = '{"type": "Feature", "geometry": {"coordinates": [106.25, %s]}, "properties": {"parameter": {"T2M": {"%s": 1.0}}}}'
    (tmp_path / "a.json").write_text("\n".join([feature % (lat, "2024010100") for lat in (-8.0, -7.5)] + ["", feature % (-7.0, "2024010101")]))
    rows = points.read_points(spark, str(tmp_path), lines=True).collect()
    assert sorted(r["lat"] for r in rows) == [-8.0, -7.5, -7.0]
    (tmp_path / "b.json").write_text(feature % (-8.0, "2024010100") + "\n{}")
    with pytest.raises(ValueError, match="no dated values"):
        points.read_points(spark, str(tmp_path), lines=True)
