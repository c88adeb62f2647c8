"""Why values are missing, what shape the zeros have, and how maps spread a column."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean, ordering
from ..functions.narrowing import Between, order_statistics
from ..model import BOUNDS, TARGET
from .profile import share

DECILES = [i / 10 for i in range(11)]


def right_closed(value: Column, edges: Sequence[float]) -> Column:
    """Number of the bin (edge, next edge]; the lowest edge belongs to the first bin."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        above = value >= edges[i] if i == 0 else value > edges[i]
        out = F.when(above & (value <= edges[i + 1]), i).otherwise(out)
    return out


def null_rate_by_partner(table: DataFrame, column: str, partner: str) -> DataFrame:
    """Null rate of a column over the deciles of its partner, where the partner is positive."""
    positive = table.filter(F.col(partner) > 0)
    edges = sorted({e for e in ordering.quantiles(positive, [partner], DECILES)[partner]
                    if e is not None})
    if len(edges) <= 2:
        edges = []
    bin_of = right_closed(F.col(partner), edges)
    low = F.element_at(F.array(*map(F.lit, edges)), F.col("bin") + 1) if edges else F.lit(None)
    high = F.element_at(F.array(*map(F.lit, edges)), F.col("bin") + 2) if edges else F.lit(None)
    return (positive.select(bin_of.alias("bin"), F.col(column).isNull().alias("gone"))
            .filter(F.col("bin").isNotNull()).groupBy("bin")
            .agg(share(F.col("gone")).alias("null_rate"), F.count(F.lit(1)).alias("n_rows"))
            .select("bin", low.cast("double").alias("low"), high.cast("double").alias("high"),
                    "null_rate", "n_rows"))


def partner_split(table: DataFrame, column: str, partner: str) -> DataFrame:
    """Null rate where the partner is absent and where it is not."""
    gone = F.col(column).isNull().cast("double")
    absent = F.coalesce(F.col(partner) <= 0, F.lit(False))
    return table.agg(F.count_if(absent).alias("partner_zero_rows"),
                     F.avg(F.when(absent, gone)).alias("null_rate_where_partner_zero"),
                     F.avg(F.when(~absent, gone)).alias("null_rate_where_partner_positive"))


def residual(table: DataFrame, column: str, partner: str,
             slice_rows: int = ordering.SLICE_ROWS) -> DataFrame:
    """Rows the partner does not explain: partner positive, column still null."""
    left = F.col(column).isNull() & F.coalesce(F.col(partner) > 0, F.lit(False))
    counts = table.agg(
        F.count_if(left).alias("n_rows"), F.count(F.lit(1)).alias("_all"),
        F.count_if(F.col(column).isNull()).alias("_null"),
        F.max(F.when(left, F.col(partner))).alias("_top")).withColumns({
            "share_of_all_rows": F.col("n_rows") / F.col("_all"),
            "share_of_nulls": F.try_divide(F.col("n_rows"), F.col("_null"))})
    totals = ordering.column_totals(table.filter(left), [partner], slice_rows)
    spread = totals.groupBy("column").agg(
        F.min("value").alias("min"), *[ordering.interpolated(p).alias(n) for n, p in (
            ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p99", 0.99))], F.max("value").alias("max")
    ).drop("column")
    below = (table.filter(F.col(column).isNotNull())
             .join(F.broadcast(counts.select("_top")), F.lit(True))
             .agg(F.avg(F.when(F.col(partner) < F.col("_top"), 1.0).otherwise(0.0))
                  .alias("partner_percentile_of_residual_max")))
    # One row beside one row.
    return (counts.drop("_all", "_null", "_top").join(F.broadcast(spread), F.lit(True), "left")
            .join(F.broadcast(below), F.lit(True), "left"))


def residual_by_month(table: DataFrame, column: str, partner: str) -> DataFrame:
    left = F.col(column).isNull() & F.coalesce(F.col(partner) > 0, F.lit(False))
    return table.groupBy("month_of_year").agg(share(left).alias("share"))


def missing_against_target(table: DataFrame, column: str, partner: str) -> DataFrame:
    """The target in the blocks null, present, residual and explained; blocks overlap."""
    gone = F.col(column).isNull()
    has, none = F.col(partner) > 0, F.col(partner) <= 0
    label = lambda condition, name: F.when(F.coalesce(condition, F.lit(False)), name)
    labels = F.filter(F.array(label(gone, "null"), label(~gone, "present"),
                              label(gone & has, "residual"), label(gone & none, "explained")),
                      lambda x: x.isNotNull())
    blocks = table.select(F.explode(labels).alias("block"), F.col(TARGET)).groupBy("block").agg(
        F.count(F.lit(1)).alias("n_rows"), share(F.col(TARGET) == 0).alias("zero_share"),
        F.avg(TARGET).alias("mean_flash"), F.sum(TARGET).alias("total_flashes"))
    everything = F.sum(F.when(F.col("block").isin("null", "present"), F.col("total_flashes"))).over(
        Window.partitionBy())  # four rows
    return blocks.withColumn("share_of_all_flashes", F.try_divide(F.col("total_flashes"), everything))


def ceiling(table: DataFrame, column: str) -> DataFrame:
    """Whether rows pile up at the maximum."""
    values = table.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    top = table.agg(F.max(column).alias("max"))
    near = F.col(column) >= F.col("max") * 0.99
    return values.join(F.broadcast(top), F.lit(True)).groupBy("max").agg(
        F.sum(F.when(F.col(column) == F.col("max"), F.col("n")).otherwise(0)).alias("n_at_max"),
        F.sum(F.when(near, F.col("n")).otherwise(0)).alias("n_within_1pct_of_max"))


def top_values(table: DataFrame, column: str, k: int = 8) -> DataFrame:
    return (table.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
            .agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("value")).limit(k))


def zero_runs(table: DataFrame, chunk: str = "year") -> DataFrame:
    """Runs of zero and of non-zero hours per cell: lat, lon, start, is_zero, length.

    Runs are found inside (cell, chunk of time), then only the first and last run
    of each chunk are stitched to their neighbours. No task holds a cell's
    whole record.
    """
    zero = F.col(TARGET) == 0
    rows = table.select("lat", "lon", "time", zero.alias("is_zero"),
                        clean.period(F.col("time"), chunk).alias("chunk"))
    inside = Window.partitionBy("lat", "lon", "chunk").orderBy("time")
    flip = F.coalesce(F.col("is_zero") != F.lag("is_zero").over(inside), F.lit(True))
    numbered = rows.withColumn("flip", flip.cast("int")).withColumn("run", F.sum("flip").over(inside))
    local = numbered.groupBy("lat", "lon", "chunk", "run").agg(
        F.first("is_zero").alias("is_zero"), F.min("time").alias("start"), F.count(F.lit(1)).alias("length"))
    whole = Window.partitionBy("lat", "lon", "chunk")
    local = local.withColumn("edge", (F.col("run") == 1) | (F.col("run") == F.max("run").over(whole)))
    across = Window.partitionBy("lat", "lon").orderBy("chunk", "run")
    same = ((F.col("chunk") != F.lag("chunk").over(across))
            & (F.col("is_zero") == F.lag("is_zero").over(across)))
    edges = (local.filter("edge").withColumn("opens", (~F.coalesce(same, F.lit(False))).cast("int"))
             .withColumn("joint", F.sum("opens").over(across)))
    stitched = edges.groupBy("lat", "lon", "joint").agg(
        F.first("is_zero").alias("is_zero"), F.min("start").alias("start"), F.sum("length").alias("length"))
    kept = ["lat", "lon", "start", "is_zero", "length"]
    return local.filter(~F.col("edge")).select(*kept).unionByName(stitched.select(*kept))


def live_zero_runs(runs: DataFrame) -> DataFrame:
    """Zero runs of cells that saw at least one event."""
    live = runs.filter(~F.col("is_zero")).select("lat", "lon").distinct()
    return runs.filter("is_zero").join(live, ["lat", "lon"], "left_semi")


def run_summary(runs: DataFrame, slice_rows: int = ordering.SLICE_ROWS) -> DataFrame:
    """Lengths of zero runs in live cells, and how much of all zero hours long runs hold."""
    live = live_zero_runs(runs)
    totals = ordering.column_totals(live, ["length"], slice_rows)
    length, n = F.col("value"), F.col("n")
    rows = F.sum(length * n)
    over = lambda limit: F.sum(F.when(length > limit, length * n).otherwise(0)) / rows
    spread = totals.groupBy("column").agg(
        F.sum("n").alias("n_zero_runs"), *[ordering.interpolated(p).alias(name) for name, p in (
            ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p99", 0.99))],
        F.max("value").cast("bigint").alias("max"),
        over(24).alias("share_over_24h"), over(168).alias("share_over_168h")).drop("column")
    cells = runs.filter(~F.col("is_zero")).agg(F.count_distinct("lat", "lon").alias("n_live_cells"))
    return spread.join(F.broadcast(cells), F.lit(True))


def zero_share_by(table: DataFrame, key: str) -> DataFrame:
    return table.groupBy(key).agg(share(F.col(TARGET) == 0).alias("zero_share"))


def count_shape(table: DataFrame, slice_rows: int = ordering.SLICE_ROWS) -> DataFrame:
    """Zero share against what a Poisson and a moment-fitted negative binomial would give."""
    t = F.col(TARGET)
    mean, var = F.col("mean"), F.col("variance")
    base = table.agg(F.avg(t).alias("mean"), F.var_pop(t).alias("variance"),
                     share(t == 0).alias("observed_zero_share"))
    over = (var > mean) & (mean > 0)
    base = base.withColumns({
        "var_over_mean": F.try_divide(var, mean), "poisson_zero_share": F.exp(-mean),
        "negbin_r": F.when(over, mean * mean / (var - mean))})
    r = F.col("negbin_r")
    base = base.withColumn("negbin_zero_share", F.pow(r / (r + mean), r))
    base = base.withColumn("excess_over_negbin", F.col("observed_zero_share") - F.col("negbin_zero_share"))
    flashing = table.filter(t > 0)
    totals = ordering.column_totals(flashing, [TARGET], slice_rows).groupBy("column").agg(
        F.sum("n").alias("n_nonzero"),
        (F.sum(F.when(F.col("value") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("share_equal_to_1"),
        *[ordering.interpolated(p).alias(f"nonzero_{name}") for name, p in (
            ("p50", 0.5), ("p90", 0.9), ("p99", 0.99))],
        F.max("value").cast("bigint").alias("nonzero_max")).drop("column")
    stats = flashing.agg(F.avg(t).alias("nonzero_mean"),
                         (F.var_pop(t) / F.avg(t)).alias("nonzero_var_over_mean"))
    # One row beside one row.
    return (base.join(F.broadcast(totals), F.lit(True), "left")
            .join(F.broadcast(stats), F.lit(True), "left"))


def seasonal_cube(table: DataFrame) -> DataFrame:
    """Counts per cell, local hour and month: at most 288 rows per cell feed every profile."""
    return table.groupBy("lat", "lon", "hour_of_day_local", "month_of_year").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(TARGET) == 0).alias("zeros"),
        F.sum(TARGET).alias("events"))


def _cycle(cube: DataFrame, keys: Sequence[str], part: str, name: str, peak: str, trough: str) -> DataFrame:
    level = cube.groupBy(*keys, part).agg(
        (F.sum("zeros") / F.sum("n")).alias("zero_share"), (F.sum("events") / F.sum("n")).alias("rate"))
    first = lambda score: F.max_by(part, F.struct(score, -F.col(part)))
    return level.groupBy(*keys).agg(
        (F.max("zero_share") - F.min("zero_share")).alias(f"{name}_amplitude"),
        first(F.col("rate")).alias(peak), first(F.col("zero_share")).alias(trough))


def temporal_by_cell(table: DataFrame) -> DataFrame:
    """Diurnal and seasonal amplitude and peaks of each live cell; ties go to the lower hour."""
    cell = ["lat", "lon"]
    cube = seasonal_cube(table)
    totals = cube.groupBy(*cell).agg(F.sum("events").alias("total_flashes")).filter("total_flashes > 0")
    day = _cycle(cube, cell, "hour_of_day_local", "diurnal", "peak_hour_local", "trough_hour_local")
    year = _cycle(cube, cell, "month_of_year", "seasonal", "peak_month", "trough_month")
    return totals.join(day, cell).join(year, cell).drop("trough_month")


def temporal_pooled(table: DataFrame) -> DataFrame:
    cube = seasonal_cube(table)
    day = _cycle(cube, [], "hour_of_day_local", "diurnal", "peak_flash_hour_local", "trough_hour")
    year = _cycle(cube, [], "month_of_year", "seasonal", "peak_flash_month", "trough_month")
    return day.join(F.broadcast(year), F.lit(True)).select(  # one row beside one row
        "diurnal_amplitude", "seasonal_amplitude",
        F.try_divide("diurnal_amplitude", "seasonal_amplitude").alias("ratio"),
        "peak_flash_hour_local", "peak_flash_month")


def temporal_spread(by_cell: DataFrame) -> DataFrame:
    """Whether the cells of a domain agree on what drives them; one row per cell goes in."""
    ratio = F.when(F.col("seasonal_amplitude") > 0, F.col("diurnal_amplitude") / F.col("seasonal_amplitude"))
    rated = by_cell.withColumn("ratio", ratio)
    return rated.agg(
        F.min("peak_hour_local").alias("peak_hour_min"), F.max("peak_hour_local").alias("peak_hour_max"),
        F.count_distinct("peak_hour_local").alias("n_peak_hours"),
        F.min("ratio").alias("ratio_min"), F.percentile("ratio", 0.5).alias("ratio_p50"),
        F.max("ratio").alias("ratio_max"), F.count_if(F.col("ratio") > 1).alias("n_cells_diurnal_dominant"),
        F.count("ratio").alias("n_cells"))


def busiest_cells(by_cell: DataFrame, k: int = 12) -> DataFrame:
    return by_cell.orderBy(F.desc("total_flashes"), "lat", "lon").limit(k)


@dataclass(frozen=True)
class UnitMap:
    """A rising map of a column onto 0..1: linear from `a` to `b`, or bent around `a` with scale `b`."""

    kind: str
    a: float
    b: float

    @property
    def flat(self) -> float | None:
        """The one value of a map without extent."""
        if self.kind == "arctan":
            return 0.5 if self.b <= 0 else None
        return 0.0 if self.b <= self.a else None

    def column(self, value: Column) -> Column:
        if self.flat is not None:
            return F.when(value.isNotNull(), F.lit(self.flat))
        if self.kind == "arctan":
            return F.atan((value - F.lit(self.a)) / F.lit(self.b)) / F.lit(math.pi) + F.lit(0.5)
        return F.greatest(F.least((value - F.lit(self.a)) / F.lit(self.b - self.a), F.lit(1.0)), F.lit(0.0))

    def number(self, value: float) -> float:
        if self.flat is not None:
            return self.flat
        if self.kind == "arctan":
            return math.atan((value - self.a) / self.b) / math.pi + 0.5
        return max(min((value - self.a) / (self.b - self.a), 1.0), 0.0)

    def quantile(self, around: Between) -> float:
        """A quantile of the mapped column: the map keeps the order, so the same rows surround it."""
        low, high = self.number(around.low), self.number(around.high)
        return low + (high - low) * around.part


ENCODING_PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def encoding_maps(column: str, fit: Sequence[float]) -> dict[str, UnitMap]:
    """Three maps of a column onto 0..1, fitted on its quantiles at `ENCODING_PROBS`."""
    low, q1, p25, p50, p75, q99, high = map(float, fit)
    if column in BOUNDS:
        low, high = q1, q99 = BOUNDS[column]
    return {"minmax": UnitMap("minmax", low, high), "quantile": UnitMap("quantile", q1, q99),
            "arctan": UnitMap("arctan", p50, p75 - p25)}


def encoding_resolution(frames: dict[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """Per source, target, column and map: share of the range the middle half covers, and share pinned.

    All maps rise, so a target's own quartiles, mapped, are the quartiles of the mapped column: no map is applied to
    rows to find them. One pass over a target counts what every source's maps pin.
    """
    known = {name: order_statistics(rows, columns, ENCODING_PROBS) for name, rows in frames.items()}
    maps = {(source, c, m): unit for source, found in sorted(known.items()) for c in columns if found[c]
            for m, unit in encoding_maps(c, [b.value for b in found[c]]).items()}
    rows = []
    for target, frame in sorted(frames.items()):
        ends = lambda e: F.count_if((e <= 1e-12) | (e >= 1.0 - 1e-12))
        pinned = frame.agg(*[F.count(c).alias(f"n_{c}") for c in columns], *[
            ends(unit.column(F.col(c).cast("double"))).alias(f"at{i}") for i, ((_, c, _), unit) in enumerate(maps.items())]).first()
        for i, ((source, c, m), unit) in enumerate(maps.items()):
            around = known[target][c]
            if around:
                q25, q75 = (unit.quantile(around[ENCODING_PROBS.index(p)]) for p in (0.25, 0.75))
                rows.append((source, target, c, m, q75 - q25, pinned[f"at{i}"] / pinned[f"n_{c}"]))
    like = next(iter(frames.values()))
    return like.sparkSession.createDataFrame(
        rows, "source STRING, target STRING, column STRING, map STRING, iqr_share DOUBLE, pinned DOUBLE")


def resolution_means(resolution: DataFrame) -> DataFrame:
    scope = F.when(F.col("source") == F.col("target"), "within").otherwise("cross")
    return resolution.groupBy(scope.alias("scope"), "map").agg(F.avg("iqr_share").alias("mean_iqr_share"))
