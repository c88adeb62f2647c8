"""Cell tables of any period from one pass over the events.

Events collapse to partials, one row per (cell, hour, size of the peak) with
counts and sums. Partials of days are sums of those of hours, and months of
days, so the exact median and 95th percentile of a longer period need no second
look at the events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean, geo, ordering
from ..functions.ordering import SLICE_ROWS
from ..model import GRID_DEG, KEY, REPORTING_TARGET, TARGET, Domain
from ..session import scratch
from . import grid as grids

LETTERS = {"hour": "h", "day": "D", "month": "M"}
UNITS = tuple(LETTERS)
SUMS = ("n", "held", "total", "signed", "positive")
PROBS = (0.5, 0.95)


def partials(labelled: DataFrame) -> DataFrame:
    """lat, lon, time, abs_peak and what a mean and a share need, of events labelled by cell and hour."""
    sign = F.col("polarity")
    return labelled.groupBy(*KEY, "abs_peak").agg(
        F.count(F.lit(1)).alias("n"), F.count("peak_current_ka").alias("held"),
        F.sum("peak_current_ka").alias("total"), F.count(sign).alias("signed"),
        F.count_if(sign == "positive").alias("positive"))


def roll_up(parts: DataFrame, unit: str) -> DataFrame:
    """Partials of a longer period."""
    longer = parts.withColumn("time", clean.period(F.col("time"), unit))
    return longer.groupBy(*KEY, "abs_peak").agg(*[F.sum(c).alias(c) for c in SUMS])


def statistics(parts: DataFrame, hot_values: int = SLICE_ROWS) -> DataFrame:
    """Count and intensity of each cell and period, as `grid.event_statistics` has them for hours.

    A percentile's buffer holds the different peaks of its group. Groups of more
    than `hot_values` of them take their percentiles from sliced running totals.
    """
    plain = [
        F.sum("n").alias(TARGET), (F.sum("total") / F.sum("held")).alias("mean_peak_current_ka"),
        (F.sum("positive") / F.sum("signed")).alias("positive_share"),
        F.max("abs_peak").alias("max_abs_peak_current_ka"),
    ]
    hot = ordering.hot_keys(parts, KEY, hot_values)
    cold = parts if hot is None else parts.join(hot, KEY, "left_anti")
    found = cold.groupBy(*KEY).agg(
        *plain, F.percentile("abs_peak", F.array(*map(F.lit, PROBS)), F.col("n")).alias("q"))
    if hot is not None:
        rows = parts.join(hot, KEY, "left_semi")
        found = found.unionByName(rows.groupBy(*KEY).agg(*plain).join(
            counted_quantiles(rows, hot_values), KEY, "left"))
    return found.select(
        *KEY, TARGET, "mean_peak_current_ka", "positive_share", F.col("q")[0].alias("median_abs_peak_current_ka"),
        "max_abs_peak_current_ka", F.col("q")[1].alias("p95_abs_peak_current_ka"))


def counted_quantiles(parts: DataFrame, slice_rows: int) -> DataFrame:
    """Percentiles of groups of any size, over (value, count) rows cut into slices of the value."""
    counts = parts.where(F.col("abs_peak").isNotNull()).select(*KEY, F.col("abs_peak").alias("value"), "n")
    bounds = ordering.slice_bounds(counts, ["value"], slice_rows)
    sliced = ordering.with_slices(counts, bounds).withColumnRenamed("value__slice", "slice")
    totals = ordering.running_totals(sliced, KEY, ["n"], sliced=bool(bounds))
    return totals.groupBy(*KEY).agg(F.array(*[ordering.interpolated(p) for p in PROBS]).alias("q"))


def skeleton(spark: SparkSession, domain: Domain, unit: str, grid: float = GRID_DEG) -> DataFrame:
    """Every cell at every period of the configured months: lat, lon, time."""
    if unit == "hour":
        return grids.skeleton(spark, domain, grid)
    starts = grids.months(spark, domain).withColumnRenamed("month", "time")
    if unit == "day":
        last = F.col("time") + F.expr("INTERVAL 1 MONTH") - F.expr("INTERVAL 1 DAY")
        starts = starts.select(F.explode(F.sequence("time", last, F.expr("INTERVAL 1 DAY"))).alias("time"))
    return grids.cells(spark, domain, grid).join(F.broadcast(starts), F.lit(True)).select(*KEY)


def dense(parts: DataFrame, coverage: DataFrame, domain: Domain, unit: str, grid: float = GRID_DEG,
          hot_values: int = SLICE_ROWS) -> DataFrame:
    """Statistics on every cell and period, with coverage of the month and densities.

    A month's density is over its observed days, and null without one.
    """
    frame = skeleton(parts.sparkSession, domain, unit, grid)
    table = grids.with_coverage(grids.densify(frame, statistics(parts, hot_values)), coverage)
    days = geo.period_days(LETTERS[unit], F.col("observed_days"))
    table = table.withColumns({"area_km2": geo.cell_area_km2(F.col("lat"), grid), "period_days": days})
    daily = geo.density_per_day(F.col(TARGET), F.col("area_km2"), F.col("period_days"))
    return table.withColumn("gfd_per_km2_per_day", daily).withColumns({
        REPORTING_TARGET: geo.density_per_year(F.col("gfd_per_km2_per_day")), "domain": F.lit(domain.name)})


def tables(events: DataFrame, domain: Domain, units: Sequence[str] = UNITS, grid: float = GRID_DEG,
           hot_values: int = SLICE_ROWS) -> dict[str, DataFrame]:
    """The dense table of each unit. Partials go to the shared folder once a unit, each from the one before."""
    unknown = set(units) - set(UNITS)
    if unknown:
        raise ValueError(f"unknown periods {sorted(unknown)}")
    spark = events.sparkSession
    coverage = grids.fixed(grids.observed_months(events, domain))
    inside = grids.cell_hours(events, domain, grid)
    months = coverage.select("month")
    parts = partials(inside.withColumn("month", clean.period(F.col("time"), "month"))
                     .join(F.broadcast(months), "month", "left_semi").drop("month"))
    found = {}
    for unit in UNITS[: max(map(UNITS.index, units), default=-1) + 1]:
        path = scratch(spark, f"{unit}_partials")
        (parts if unit == "hour" else roll_up(parts, unit)).write.parquet(path)
        parts = spark.read.parquet(path)
        if unit in units:
            found[unit] = dense(parts, coverage, domain, unit, grid, hot_values)
    return found
