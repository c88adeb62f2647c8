"""Manifests of an acquisition: the files a complete one holds, and the days that found files leave open.

A manifest has one row per file: its name, what it is of, and the days it
covers, both ends included. Windows are whole days, so coverage is by day.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Domain
from .points import coordinate_tag, native_points

# The strike archive gives out at most this many days a file.
STRIKE_DAYS = 30
# Period letters and what file names call them.
FREQUENCY_NAMES = {"h": "hourly", "D": "daily", "M": "monthly"}

COORDINATE = r"([mp]\d{3}p\d{3})"
DAYS = r"(\d{8})_(\d{8})"
YEARS = r"(\d{4})_(\d{4})"


def compact(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def bounds(domain: Domain) -> tuple[Column, Column]:
    """First and last day of the configured months."""
    first = F.lit(f"{domain.first_month}-01").cast("date")
    return first, F.last_day(F.lit(f"{domain.last_month}-01").cast("date"))


def windows(spark: SparkSession, domain: Domain, length: int | str) -> DataFrame:
    """first, last: the configured days cut into so many days, or by month.

    `year` and `whole` cut whole calendar years, from the first configured one to the last.
    """
    first, last = bounds(domain)
    if length in ("year", "whole"):
        first, last = F.trunc(first, "year"), F.add_months(F.trunc(last, "year"), 12) - F.expr("INTERVAL 1 DAY")
    one = spark.range(1)
    if length == "whole":
        return one.select(first.cast("date").alias("first"), last.cast("date").alias("last"))
    if isinstance(length, int):
        start = F.explode(F.sequence(first, last, F.make_dt_interval(F.lit(length)))).alias("first")
        end = F.date_add("first", length - 1)
    else:
        months = 1 if length == "month" else 12
        start = F.explode(F.sequence(first, last, F.make_ym_interval(F.lit(0), F.lit(months)))).alias("first")
        end = F.date_sub(F.add_months("first", months), 1)
    return (one.select(start, last.cast("date").alias("_end"))
            .select("first", F.least(end, F.col("_end")).alias("last")))


def strike_manifest(spark: SparkSession, domain: Domain, days: int = STRIKE_DAYS) -> DataFrame:
    """name, first, last of every event file."""
    name = F.concat(F.lit("merlin_"), compact(F.col("first")), F.lit("_"), compact(F.col("last")), F.lit(".csv"))
    return windows(spark, domain, days).select(name.alias("name"), "first", "last")


def point_manifest(spark: SparkSession, domain: Domain, frequencies: Mapping[str, str]) -> DataFrame:
    """name, lat, lon, parameter, freq, first, last; `frequencies` maps parameters to period letters.

    All hourly parameters of a native point and year share a file, without a
    parameter. A coarser parameter has one file for the whole box, without a
    place: a year a file, or one file of all years where it is monthly.
    """
    parts = []
    stamp = lambda c: compact(F.col(c))
    if "h" in frequencies.values():
        years = F.sequence(*[F.year(end) for end in bounds(domain)])
        placed = native_points(spark, domain).select("lat", "lon", F.explode(years).alias("year")).select(
            "lat", "lon", F.make_date("year", F.lit(1), F.lit(1)).alias("first"),
            F.make_date("year", F.lit(12), F.lit(31)).alias("last"))
        name = F.concat_ws("_", F.lit(f"power_{domain.name}_hourly"), coordinate_tag(F.col("lat")),
                           coordinate_tag(F.col("lon")), stamp("first"), stamp("last"))
        parts.append(placed.select(
            F.concat(name, F.lit(".json")).alias("name"), "lat", "lon", F.lit(None).cast("string").alias("parameter"),
            F.lit("h").alias("freq"), "first", "last"))
    for parameter, freq in frequencies.items():
        if freq == "h":
            continue
        monthly = freq == "M"
        stamp_of = (lambda c: F.date_format(c, "yyyy")) if monthly else stamp
        name = F.concat_ws("_", F.lit(f"power_{domain.name}_{parameter}_{FREQUENCY_NAMES[freq]}"),
                           stamp_of("first"), stamp_of("last"))
        nowhere = F.lit(None).cast("double")
        parts.append(windows(spark, domain, "whole" if monthly else "year").select(
            F.concat(name, F.lit(".json")).alias("name"), nowhere.alias("lat"), nowhere.alias("lon"),
            F.lit(parameter).alias("parameter"), F.lit(freq).alias("freq"), "first", "last"))
    if not parts:
        raise ValueError("a manifest of no parameters")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def field_manifest(spark: SparkSession, domain: Domain, tags: Sequence[str] = ()) -> DataFrame:
    """name, tag, first, last: the main file of every month, and one for each supplement's tag."""
    tag = F.explode(F.array(*map(F.lit, ["main", *tags]))).alias("tag")
    ending = F.when(F.col("tag") == "main", "").otherwise(F.concat(F.lit("_"), "tag"))
    name = F.concat(F.lit(f"era5_{domain.name}_hourly_"), F.date_format("first", "yyyyMM"), ending, F.lit(".nc"))
    return windows(spark, domain, "month").select("first", "last", tag).select(
        name.alias("name"), "tag", "first", "last")


def coordinate(tag: Column) -> Column:
    """The number a coordinate tag stands for; null where there is no tag."""
    size = F.substring(tag, 2, 3).try_cast("double") + F.substring(tag, 6, 3).try_cast("double") / 1000
    return F.when(tag.startswith("m"), -size).otherwise(size)


def point_files(names: DataFrame, domain: str) -> DataFrame:
    """name, lat, lon, parameter, freq, first, last read from names of point files, once each.

    Names of another form, impossible dates and windows that end before they start are left out.
    """
    placed = rf"^power_{domain}_hourly_{COORDINATE}_{COORDINATE}_{DAYS}\.json$"
    wide = rf"^power_{domain}_([A-Z0-9]+)_(daily|monthly)_(?:{DAYS}|{YEARS})\.json$"
    name = F.col("name")
    part = lambda pattern, i: F.nullif(F.regexp_extract(name, pattern, i), F.lit(""))
    day = lambda text: F.try_to_date(text, "yyyyMMdd")
    first = F.coalesce(part(placed, 3), part(wide, 3), F.concat(part(wide, 5), F.lit("0101")))
    last = F.coalesce(part(placed, 4), part(wide, 4), F.concat(part(wide, 6), F.lit("1231")))
    freq = F.when(name.rlike(placed), "h").when(part(wide, 2) == "daily", "D").when(part(wide, 2) == "monthly", "M")
    said = F.struct(coordinate(part(placed, 1)).alias("lat"), coordinate(part(placed, 2)).alias("lon"),
                    part(wide, 1).alias("parameter"), freq.alias("freq"),
                    day(first).alias("first"), day(last).alias("last"))
    # Unfolding a list of one keeps the filters, and with them the patterns, behind the distinct names.
    return (names.select("name").distinct().select("name", F.explode(F.array(said)).alias("said"))
            .select("name", "said.*")
            .filter(F.col("freq").isNotNull() & (F.col("first") <= F.col("last"))))


def _by_year(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spans cut at the turns of the years: keys, year, lo, hi."""
    years = F.explode(F.sequence(F.year("first"), F.year("last"))).alias("year")
    whole = (spans.filter(F.col("first") <= F.col("last")).na.drop(subset=list(keys))
             .select(*keys, "first", "last", years))
    return whole.select(*keys, "year",
                        F.greatest("first", F.make_date("year", F.lit(1), F.lit(1))).alias("lo"),
                        F.least("last", F.make_date("year", F.lit(12), F.lit(31))).alias("hi"))


def uncovered(wanted: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spans of wanted days that no found window covers: keys, first, last, n_days.

    Both sides have the keys and `first`, `last`. Windows may overlap, repeat
    and reach beyond what is wanted. Rows whose key or ends are null, or that
    end before they start, say nothing.

    Spans are cut into years first, and of the windows that start on one day
    only the longest counts, so a group is at most the days of a year however
    many files a key has. What is open at a turn of the year is joined up after.
    """
    keys = list(keys)
    group = [*keys, "year"]
    asked = _by_year(wanted, keys).groupBy(*group, "lo").agg(F.max("hi").alias("hi"))
    held = _by_year(found, keys).groupBy(*group, "lo").agg(F.max("hi").alias("hi"))
    pieces = asked.select(*group, F.col("lo").alias("a"), F.col("hi").alias("b")).join(
        held, group, "left").filter(F.col("lo").isNull() | ((F.col("lo") <= F.col("b")) & (F.col("hi") >= F.col("a"))))
    # Each wanted span ends with a window of no days just past it, so that the rest of it is a gap like any other.
    bars = asked.select(*group, F.col("lo").alias("a"), F.col("hi").alias("b"), F.date_add("hi", 1).alias("lo"),
                        F.col("hi").alias("hi"))
    order = Window.partitionBy(*group, "a").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("hi").over(order), F.date_sub("a", 1))
    gaps = (pieces.filter(F.col("lo").isNotNull()).unionByName(bars)
            .withColumn("reached", F.greatest(reached, F.date_sub("a", 1)))
            .filter(F.col("lo") > F.date_add("reached", 1))
            .select(*keys, F.date_add("reached", 1).alias("first"), F.date_sub("lo", 1).alias("last")))
    ahead = Window.partitionBy(*keys).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.coalesce(F.col("first") > F.date_add(F.max("last").over(ahead), 1), F.lit(True))
    joined = (gaps.withColumn("starts", starts.cast("int")).withColumn("span", F.sum("starts").over(upto))
              .groupBy(*keys, "span").agg(F.min("first").alias("first"), F.max("last").alias("last")))
    return joined.select(*keys, "first", "last", (F.datediff("last", "first") + 1).alias("n_days"))


def point_gaps(spark: SparkSession, domain: Domain, names: DataFrame) -> DataFrame:
    """lat, lon, first, last, n_days: the days of every native point that no hourly file covers."""
    hourly = point_files(names, domain.name).filter(F.col("freq") == "h")
    first, last = bounds(domain)
    wanted = native_points(spark, domain).select("lat", "lon", first.alias("first"), last.alias("last"))
    return uncovered(wanted, hourly, ["lat", "lon"])


def off_grid(spark: SparkSession, domain: Domain, names: DataFrame) -> DataFrame:
    """name, lat, lon of hourly files at places that are not native points of the box."""
    hourly = point_files(names, domain.name).filter(F.col("freq") == "h")
    return hourly.join(F.broadcast(native_points(spark, domain)), ["lat", "lon"], "left_anti").select(
        "name", "lat", "lon")
