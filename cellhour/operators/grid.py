"""Point events to a dense (cell, hour) table with explicit zeros and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clean, geo
from ..functions.ordering import SLICE_ROWS, group_quantiles, hot_keys
from ..model import GRID_DEG, KEY, PERIOD_DAYS, REPORTING_TARGET, TARGET, Domain

COVERAGE = T.StructType([
    T.StructField("month", T.TimestampNTZType()),
    T.StructField("observed_days", T.IntegerType()),
    T.StructField("days_in_month", T.IntegerType()),
    T.StructField("coverage", T.DoubleType()),
])


def assign_cells(events: DataFrame, grid: float = GRID_DEG) -> DataFrame:
    return events.withColumns({"lat_bin": geo.cell_centre(F.col("lat"), grid),
                               "lon_bin": geo.cell_centre(F.col("lon"), grid)})


def cells(spark: SparkSession, domain: Domain, grid: float = GRID_DEG) -> DataFrame:
    """Every cell centre of the box: lat, lon."""
    rows, columns = domain.shape(grid)
    return _centres(spark.range(rows * columns).withColumnRenamed("id", "cell"), domain, grid)


def _centres(numbered: DataFrame, domain: Domain, grid: float) -> DataFrame:
    """Cell number to cell centre, by the arithmetic that bins events."""
    i0, _, j0, _ = domain.index_box(grid)
    _, columns = domain.shape(grid)
    rest = [c for c in numbered.columns if c != "cell"]
    return numbered.select(
        ((F.floor(F.col("cell") / columns) + i0) * F.lit(float(grid)) + grid / 2).alias("lat"),
        ((F.col("cell") % columns + j0) * F.lit(float(grid)) + grid / 2).alias("lon"), *rest)


def months(spark: SparkSession, domain: Domain) -> DataFrame:
    """First hour of every configured month."""
    start, end = (F.lit(f"{m}-01 00:00:00").cast("timestamp_ntz")
                  for m in (domain.first_month, domain.last_month))
    return spark.range(1).select(
        F.explode(F.sequence(start, end, F.expr("INTERVAL 1 MONTH"))).alias("month"))


def hours(spark: SparkSession, domain: Domain) -> DataFrame:
    """Every hour of the configured months, spread over all cores."""
    start = F.lit(f"{domain.first_month}-01 00:00:00").cast("timestamp_ntz")
    end = F.lit(f"{domain.last_month}-01 00:00:00").cast("timestamp_ntz") + F.expr("INTERVAL 1 MONTH")
    count = spark.range(1).select(F.timestamp_diff("HOUR", start, end).alias("n")).first()["n"]
    return spark.range(count).select(F.timestamp_add("HOUR", F.col("id"), start).alias("time"))


def observed_months(events: DataFrame, domain: Domain, time: str = "timestamp") -> DataFrame:
    """Days with any event per configured month; months without one stay, at zero.

    Takes events before any box filter: a strike outside the box still shows
    that the network was up.
    """
    seen = (events.select(clean.period(F.col(time), "month").alias("month"),
                          F.to_date(time).alias("day"))
            .groupBy("month").agg(F.count_distinct("day").alias("days")))
    days = F.dayofmonth(F.last_day("month"))
    observed = F.coalesce(F.col("days"), F.lit(0)).cast("int")
    return (months(events.sparkSession, domain).join(seen, "month", "left")
            .select("month", observed.alias("observed_days"), days.alias("days_in_month"),
                    (observed / days).alias("coverage")))


def fixed(small: DataFrame) -> DataFrame:
    """A table of at most one row per configured month, computed once and held."""
    return small.sparkSession.createDataFrame(small.collect(), small.schema)


def coverage_gate(coverage: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Months at or above the threshold; zero keeps all, keeping none is an error."""
    kept = coverage.filter(F.col("coverage") >= threshold) if threshold > 0 else coverage
    if kept.isEmpty():
        raise ValueError(f"no month reaches a coverage of {threshold}")
    return kept


def thin_months(coverage: DataFrame, threshold: float) -> DataFrame:
    """What a gate would say about each month: empty, thin or kept."""
    state = (F.when(F.col("observed_days") == 0, "empty")
             .when(F.col("coverage") < threshold, "thin").otherwise("kept"))
    return coverage.withColumn("state", state)


def cell_hours(events: DataFrame, domain: Domain, grid: float = GRID_DEG,
               time: str = "timestamp") -> DataFrame:
    """Events inside the box, labelled by cell and hour."""
    binned = assign_cells(events, grid)
    boxed = binned.filter(geo.inside(domain, F.col("lat_bin"), F.col("lon_bin"), grid))
    return boxed.select(
        F.col("lat_bin").alias("lat"), F.col("lon_bin").alias("lon"),
        clean.period(F.col(time), "hour").alias("time"), "peak_current_ka",
        F.abs("peak_current_ka").alias("abs_peak"), "polarity")


def event_statistics(labelled: DataFrame, hot_rows: int = SLICE_ROWS) -> DataFrame:
    """Count and intensity of each cell-hour that saw events.

    Exact percentiles keep one buffer per group, which suits cell-hours of any
    ordinary size. Groups above `hot_rows` are found first and take their
    percentiles from sliced running totals instead.
    """
    plain = [
        F.count(F.lit(1)).alias(TARGET),
        F.avg("peak_current_ka").alias("mean_peak_current_ka"),
        F.avg((F.col("polarity") == "positive").cast("double")).alias("positive_share"),
        F.max("abs_peak").alias("max_abs_peak_current_ka"),
    ]
    probs = [0.5, 0.95]
    hot = hot_keys(labelled, KEY, hot_rows)
    cold = labelled if hot is None else labelled.join(hot, KEY, "left_anti")
    stats = cold.groupBy(*KEY).agg(*plain, F.percentile("abs_peak", F.array(*map(F.lit, probs))).alias("q"))
    if hot is not None:
        rows = labelled.join(hot, KEY, "left_semi")
        stats = stats.unionByName(rows.groupBy(*KEY).agg(*plain).join(
            group_quantiles(rows, KEY, "abs_peak", probs, hot_rows), KEY, "left"))
    return stats.select(
        *KEY, TARGET, "mean_peak_current_ka", "positive_share",
        F.col("q")[0].alias("median_abs_peak_current_ka"), "max_abs_peak_current_ka",
        F.col("q")[1].alias("p95_abs_peak_current_ka"))


def skeleton(spark: SparkSession, domain: Domain, grid: float = GRID_DEG,
             kept_months: DataFrame | None = None) -> DataFrame:
    """Every cell at every hour of the kept months: lat, lon, time.

    Each hour unfolds into its cells in place, so the dense table is generated
    where it is needed rather than shuffled into being.
    """
    every = hours(spark, domain)
    if kept_months is not None:
        every = (every.withColumn("month", clean.period(F.col("time"), "month"))
                 .join(F.broadcast(kept_months.select("month")), "month", "left_semi").drop("month"))
    rows, columns = domain.shape(grid)
    unfolded = every.select(
        "time", F.explode(F.sequence(F.lit(0), F.lit(rows * columns - 1))).alias("cell"))
    return _centres(unfolded, domain, grid).select(*KEY)


def densify(frame: DataFrame, statistics: DataFrame) -> DataFrame:
    """Statistics on every cell-hour; no event means a zero count and null intensity."""
    return frame.join(statistics, KEY, "left").fillna(0, [TARGET])


def with_coverage(table: DataFrame, coverage: DataFrame) -> DataFrame:
    """Month label and its coverage; the table has one row per configured month."""
    labelled = table.withColumn("month", clean.period(F.col("time"), "month"))
    return labelled.join(F.broadcast(coverage), "month", "left")


def with_density(table: DataFrame, grid: float = GRID_DEG) -> DataFrame:
    out = table.withColumns({"area_km2": geo.cell_area_km2(F.col("lat"), grid),
                             "period_days": F.lit(PERIOD_DAYS)})
    daily = geo.density_per_day(F.col(TARGET), F.col("area_km2"), F.col("period_days"))
    out = out.withColumn("gfd_per_km2_per_day", daily)
    return out.withColumn(REPORTING_TARGET, geo.density_per_year(F.col("gfd_per_km2_per_day")))


def dense_table(events: DataFrame, domain: Domain, grid: float = GRID_DEG, fill: bool = True,
                min_coverage: float = 0.0, hot_rows: int = SLICE_ROWS) -> DataFrame:
    """Events to one row per cell and hour, with coverage and densities.

    The coverage table (one row per configured month) is computed once; the
    events are then read once more for the aggregate.
    """
    spark = events.sparkSession
    coverage = fixed(observed_months(events, domain))
    kept = coverage_gate(coverage, min_coverage)
    labelled = cell_hours(events, domain, grid)
    in_months = (labelled.withColumn("month", clean.period(F.col("time"), "month"))
                 .join(F.broadcast(kept.select("month")), "month", "left_semi").drop("month"))
    table = event_statistics(in_months, hot_rows)
    if fill:
        gate = kept if min_coverage > 0 else None
        table = densify(skeleton(spark, domain, grid, gate), table)
    return with_density(with_coverage(table, kept), grid).withColumn("domain", F.lit(domain.name))


def diurnal(events: DataFrame, zone: str, time: str = "timestamp") -> DataFrame:
    """Events per local hour, all 24 hours present, with the peak and its verdict."""
    local = F.hour(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(time)))
    counted = events.groupBy(local.alias("hour_local")).agg(F.count(F.lit(1)).alias("n"))
    day = events.sparkSession.range(24).select(F.col("id").cast("int").alias("hour_local"))
    full = day.join(F.broadcast(counted), "hour_local", "left").fillna(0, ["n"])
    peak = full.agg(F.max_by("hour_local", F.struct("n", -F.col("hour_local"))).alias("peak"))
    return full.join(F.broadcast(peak), F.lit(True)).select(
        "hour_local", "n", (F.col("hour_local") == F.col("peak")).alias("is_peak"),
        F.col("peak").between(12, 21).alias("peak_in_afternoon"))
