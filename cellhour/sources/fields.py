"""Gridded field rows: renaming, member merge, file groups and variable inventory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean, geo
from ..model import FIELD_REQUESTED, FIELD_SHORT_NAMES

# Coordinate aliases of the field source.
ALIASES = {"valid_time": "time", "forecast_reference_time": "time",
           "latitude": "lat", "longitude": "lon"}
KEYS = ["lat", "lon", "time"]


def normalise(rows: DataFrame, names: Sequence[str] = tuple(FIELD_SHORT_NAMES),
              keep: Sequence[str] = ()) -> DataFrame:
    """Common coordinate names, known variables only, hourly key, longitude in -180..180."""
    renamed = rows.withColumnsRenamed({a: b for a, b in ALIASES.items() if a in rows.columns})
    if "time" not in renamed.columns:
        raise ValueError("no recognisable time coordinate")
    known = [c for c in renamed.columns if c in names]
    return renamed.select(
        *keep, "lat", geo.wrap_longitude(F.col("lon")).alias("lon"),
        clean.period(F.col("time"), "hour").alias("time"),
        *[clean.finite(F.col(c).cast("double")).alias(c) for c in known])


def variables(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in KEYS]


def merge_members(members: Sequence[DataFrame]) -> DataFrame:
    """Members of one download, side by side on their shared axes."""
    out = members[0]
    for member in members[1:]:
        out = out.join(member, KEYS, "full_outer")
    return out


def spatial_mean(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Native points averaged onto project cells; missing values do not count."""
    values = [c for c in rows.columns if c not in (*KEYS, *keys)]
    cells = rows.withColumns({"lat": geo.cell_centre(F.col("lat")), "lon": geo.cell_centre(F.col("lon"))})
    return cells.groupBy(*keys, *KEYS).agg(*[F.avg(c).alias(c) for c in values])


def mean_of_files(rows: DataFrame, file: str = "file") -> DataFrame:
    """Cell means per file, then their mean, so overlapping files weigh alike."""
    values = [c for c in rows.columns if c not in (*KEYS, file)]
    per_file = spatial_mean(rows, keys=[file])
    return per_file.groupBy(*KEYS).agg(*[F.avg(c).alias(c) for c in values])


def daily_statistics(rows: DataFrame, statistic: dict[str, str], hours: int = 24) -> DataFrame:
    """One value per point and day; days with fewer hours in any variable are left out.

    Partial sums, counts and maxima are Spark's own map-side combine.
    """
    values = variables(rows)
    day = rows.withColumn("time", clean.period(F.col("time"), "day"))
    pick = {"max": F.max, "mean": F.avg}
    stats = [pick[statistic.get(c, "mean")](c).alias(c) for c in values]
    counts = [F.count(c).alias(f"{c}__n") for c in values]
    full = F.lit(True)
    for c in values:
        full = full & (F.col(f"{c}__n") >= hours)
    return day.groupBy(*KEYS).agg(*stats, *counts).filter(full).select(*KEYS, *values)


def file_groups(names: DataFrame, domain: str) -> DataFrame:
    """name, tag: main files carry a bare six-digit stamp, supplements a tag after it.

    A file that is neither is left out.
    """
    stem = rf"^era5_{domain}_hourly_"
    main = F.col("name").rlike(stem + r"\d{6}\.nc$")
    supplement = F.regexp_extract("name", stem + r"\d[^_]*_(.+)\.nc$", 1)
    tag = F.when(main, "main").when(supplement != "", supplement)
    return names.select("name", tag.alias("tag")).filter(F.col("tag").isNotNull())


def supplement(main: DataFrame, extra: DataFrame) -> DataFrame:
    """Columns of `extra` the main table has no value for, joined on the cell-hour."""
    shared = [c for c in variables(extra) if c in main.columns]
    filled: set[str] = set()
    if shared:
        held = main.agg(*[F.count(c).alias(c) for c in shared]).first()
        filled = {c for c in shared if held[c] > 0}
    wanted = [c for c in variables(extra) if c not in filled]
    if not wanted:
        return main
    return main.drop(*wanted).join(extra.select(*KEYS, *wanted), KEYS, "left")


def to_column_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in FIELD_SHORT_NAMES.items() if k in df.columns})


def variable_inventory(rows: DataFrame, requested: Sequence[str] = tuple(FIELD_REQUESTED)) -> DataFrame:
    """Per variable: requested, found, mapped, null share; and the axes' extent on every row."""
    renamed = rows.withColumnsRenamed({a: b for a, b in ALIASES.items() if a in rows.columns})
    found = [c for c in renamed.columns if c not in KEYS]
    names = sorted({*found, *requested})
    stats = renamed.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("time").alias("n_times"),
        F.count_distinct(F.hour("time")).alias("hours_per_day"),
        F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"),
        *[F.avg(F.col(c).isNull().cast("double")).alias(f"null__{c}") for c in found])
    entry = F.explode(F.array(*[F.struct(
        F.lit(c).alias("variable"), F.lit(c in requested).alias("requested"),
        F.lit(c in found).alias("found"), F.lit(c in FIELD_SHORT_NAMES).alias("mapped"),
        (F.col(f"null__{c}") if c in found else F.lit(None).cast("double")).alias("null_share"))
        for c in names])).alias("v")
    extent = ["n_rows", "n_times", "hours_per_day", "lon_min", "lon_max"]
    return stats.select(*extent, entry).select("v.*", *extent)


