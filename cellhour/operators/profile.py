"""Description of a table: columns, missing values, target, coverage, ranks and tails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordering
from ..functions.moments import moments
from ..model import TARGET

PROFILE_PROBS = {"p1": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}


def corrected_skew(skew: Column, n: Column) -> Column:
    """Sample-corrected skewness from the population value."""
    return F.when(n > 2, skew * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(excess: Column, n: Column) -> Column:
    """Sample-corrected excess kurtosis from the population value."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * excess + 6))


def sample_skew(col: Column) -> Column:
    return corrected_skew(F.skewness(col), F.count(col))


def is_zero(col: Column) -> Column:
    return (col == 0).cast("double")


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def zero_shares(table: DataFrame) -> DataFrame:
    """Zero and non-zero share of the target, over all rows and over observed rows."""
    observed = F.col("coverage") > 0
    zero = F.col(TARGET) == 0
    return table.agg(
        share(zero).alias("zero_share"), share(~zero).alias("nonzero_share"),
        F.count_if(observed).alias("n_observed"),
        F.avg(F.when(observed, zero.cast("double"))).alias("zero_share_observed"))


def columns(table: DataFrame, names: Sequence[str], slice_rows: int = ordering.SLICE_ROWS) -> DataFrame:
    """One row per column: moments, quantiles, shares, distinct values and the largest point mass.

    Everything but the means comes from one (column, value) count, so the rows
    are unfolded and shuffled once. Equally frequent values resolve to the
    smallest.
    """
    totals = ordering.column_totals(table, names, slice_rows)
    centre = table.agg(*[F.avg(c).alias(c) for c in names]).unpivot([], list(names), "column", "mean")
    totals = totals.join(F.broadcast(centre), "column")
    quantile = [ordering.interpolated(p).alias(name) for name, p in PROFILE_PROBS.items()]
    n, value = F.sum("n"), F.col("value")
    off = value - F.col("mean")
    power = lambda k: F.sum(F.col("n") * F.pow(off, F.lit(float(k)))) / n
    found = totals.groupBy("column").agg(
        n.alias("n"), F.max("mean").alias("mean"), power(2).alias("m2"), power(3).alias("m3"), power(4).alias("m4"),
        F.min("value").alias("min"), *quantile, F.max("value").alias("max"),
        (F.sum(F.when(value == 0, F.col("n")).otherwise(0)) / n).alias("zero_share"),
        (F.sum(F.when(value < 0, F.col("n")).otherwise(0)) / n).alias("negative_share"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.max_by("value", F.struct("n", -value)).alias("largest_point_mass_value"),
        (F.max("n") / n).alias("largest_point_mass_share"))
    m2, rows = F.col("m2"), F.col("n")
    skew = F.when(m2 > 0, F.col("m3") / F.pow(m2, F.lit(1.5)))
    excess = F.when(m2 > 0, F.col("m4") / (m2 * m2) - 3)
    return found.withColumns({
        "sd": F.when(rows > 1, F.sqrt(m2 * rows / (rows - 1))), "skew": corrected_skew(skew, rows),
        "kurtosis": corrected_kurtosis(excess, rows),
        "is_constant": F.col("n_distinct") <= 1}).drop("m2", "m3", "m4")


def missingness(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """Null count and share per column."""
    counts = table.agg(F.count(F.lit(1)).alias("_n"),
                       *[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return (counts.unpivot(["_n"], list(names), "column", "n_null")
            .select("column", "n_null", (F.col("n_null") / F.col("_n")).alias("share")))


def missing_rows(table: DataFrame, names: Sequence[str]) -> DataFrame:
    any_null = F.lit(False)
    for c in names:
        any_null = any_null | F.col(c).isNull()
    return table.agg(F.count_if(any_null).alias("rows_any_null"),
                     F.count_if(~any_null).alias("rows_all_present"))


def missing_together(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """Given one column is null, how often another is too; all pairs in one aggregate."""
    pairs = [(a, b) for a in names for b in names if a != b]
    null = {c: F.col(c).isNull() for c in names}
    counts = table.agg(*[F.count_if(null[c]).alias(f"n_{c}") for c in names],
                       *[F.count_if(null[a] & null[b]).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.array(*[F.struct(
        F.lit(a).alias("column"), F.lit(b).alias("other"), F.col(f"n_{a}").alias("n_null"),
        (F.col(f"`{a}|{b}`") / F.greatest(F.col(f"n_{a}"), F.lit(1))).alias("share")) for a, b in pairs])
    return (counts.select(F.explode(cells).alias("c")).select("c.*").filter(F.col("n_null") > 0))


def missing_by(table: DataFrame, names: Sequence[str], key: str) -> DataFrame:
    """Null share per column and calendar part."""
    shares = table.groupBy(key).agg(*[share(F.col(c).isNull()).alias(c) for c in names])
    return shares.unpivot([key], list(names), "column", "null_share")


def target_summary(table: DataFrame) -> DataFrame:
    """Moments of the target, its zero share, and how uneven it is."""
    t = F.col(TARGET)
    observed = F.col("coverage") > 0
    return table.agg(
        F.count(F.lit(1)).alias("n_rows"), share(t == 0).alias("zero_share_all_rows"),
        F.count_if(observed).alias("n_rows_observed"),
        F.avg(F.when(observed, is_zero(t))).alias("zero_share_observed_rows"),
        F.count_if(t > 0).alias("n_nonzero"), F.sum(t).alias("total_flashes"),
        F.avg(t).alias("mean"), F.var_samp(t).alias("variance"),
        F.try_divide(F.var_samp(t), F.avg(t)).alias("var_over_mean"),
        sample_skew(t).alias("skew_raw"), sample_skew(F.log1p(t.cast("double"))).alias("skew_log1p"))


def nonzero_summary(table: DataFrame, slice_rows: int = ordering.SLICE_ROWS) -> DataFrame:
    """Quantiles, mean and skew of the target where events happened."""
    flashing = table.filter(F.col(TARGET) > 0)
    totals = ordering.column_totals(flashing, [TARGET], slice_rows)
    by_value = totals.groupBy("column").agg(
        F.min("value").alias("min"), *[ordering.interpolated(p).alias(n) for n, p in PROFILE_PROBS.items()],
        F.max("value").alias("max"))
    stats = flashing.agg(F.avg(TARGET).alias("mean"), sample_skew(F.col(TARGET)).alias("skew"))
    return by_value.drop("column").join(F.broadcast(stats), F.lit(True))


def target_by_year(table: DataFrame) -> DataFrame:
    return table.groupBy("year").agg(F.sum(TARGET).alias("total"),
                                     share(F.col(TARGET) == 0).alias("zero_share"))


def coverage_summary(table: DataFrame, slice_rows: int = ordering.SLICE_ROWS) -> DataFrame:
    """Coverage weighted by rows and by cell-months; both means are stated."""
    per_cell_month = table.groupBy("lat", "lon", "month").agg(F.min("coverage").alias("coverage"))
    by_cell_month = per_cell_month.agg(
        F.avg("coverage").alias("cell_month_weighted_mean"), F.count(F.lit(1)).alias("n_cell_months"),
        F.count_distinct("month").alias("n_months"),
        F.count_if(F.col("coverage") == 0).alias("cell_months_zero_coverage"))
    totals = ordering.column_totals(table, ["coverage"], slice_rows)
    n = F.sum("n")
    by_row = totals.groupBy("column").agg(
        (F.sum(F.col("value") * F.col("n")) / n).alias("row_weighted_mean"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        *[ordering.interpolated(p).alias("median" if name == "p50" else name)
          for name, p in PROFILE_PROBS.items()],
        F.sum(F.when(F.col("value") == 0, F.col("n")).otherwise(0)).alias("n_rows_zero_coverage"))
    return by_row.drop("column").join(F.broadcast(by_cell_month), F.lit(True))


def rank_correlation(table: DataFrame, names: Sequence[str], key: Sequence[str],
                     **limits: int) -> DataFrame:
    """Spearman's rho of every pair over the rows where both have a value: a, b, rho.

    Columns missing on exactly the same rows share one ranking. Columns of two
    such classes are ranked again on the rows both have, so the number of
    rankings follows the number of different gaps, not of columns.
    """
    names = list(names)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    here = {c: F.col(c).isNotNull() for c in names}
    held = table.agg(*[F.count(c).alias(c) for c in names],
                     *[F.count_if(here[a] & here[b]).alias(f"{a}|{b}") for a, b in pairs]).first()
    classes: list[list[str]] = []
    for c in names:
        for known in classes:
            if held[c] == held[known[0]] == held[f"{known[0]}|{c}"]:
                known.append(c)
                break
        else:
            classes.append([c])
    found: list[tuple[str, str, float]] = []

    def correlate(wanted: Sequence[str], apart: Sequence[str]) -> None:
        """Ranks on the common rows; with `apart`, only pairs across the two classes count."""
        listed = [*wanted, *apart]
        m = ordering.rank_moments(table.select(*listed).na.drop(), listed, **limits)
        corr, sd = m.correlation(), m.sd
        for i, a in enumerate(listed):
            for j in range(i + 1, len(listed)):
                b = listed[j]
                if (not apart or (a in wanted) != (b in wanted)) and sd[i] > 0 and sd[j] > 0:
                    first, second = sorted((a, b), key=names.index)
                    found.append((first, second, float(corr[i, j])))

    for i, one in enumerate(classes):
        if len(one) > 1 and held[one[0]]:
            correlate(one, [])
        for other in classes[i + 1:]:
            first, second = sorted((one[0], other[0]), key=names.index)
            if held[f"{first}|{second}"] > 1:
                correlate(one, other)
    return table.sparkSession.createDataFrame(found, "a STRING, b STRING, rho DOUBLE")


def ranked_pairs(pairs: DataFrame, top: int | None = None) -> DataFrame:
    """Pairs by strength of correlation, without a threshold."""
    ordered = pairs.orderBy(F.desc(F.abs("rho")), "a", "b")
    return ordered.limit(top) if top else ordered


def tails(table: DataFrame, names: Sequence[str], slice_rows: int = ordering.SLICE_ROWS) -> DataFrame:
    """How far the extremes stand off from the bulk, in units of the bulk's own spread."""
    totals = ordering.column_totals(table, names, slice_rows)
    edges = totals.groupBy("column").agg(
        ordering.interpolated(0.001).alias("p001"), ordering.interpolated(0.5).alias("p50"),
        ordering.interpolated(0.999).alias("p999"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.min_by("n", "value").alias("n_at_min"), F.max_by("n", "value").alias("n_at_max"))
    beyond = (totals.join(F.broadcast(edges.select("column", "p001", "p999")), "column")
              .groupBy("column").agg(
                  F.sum(F.when(F.col("value") > F.col("p999"), F.col("n")).otherwise(0)).alias("n_above_p999"),
                  F.sum(F.when(F.col("value") < F.col("p001"), F.col("n")).otherwise(0)).alias("n_below_p001")))
    high, low = F.col("p999") - F.col("p50"), F.col("p50") - F.col("p001")
    return edges.join(beyond, "column").withColumns({
        "max_detachment": F.when(high > 0, (F.col("max") - F.col("p999")) / high),
        "min_detachment": F.when(low > 0, (F.col("p001") - F.col("min")) / low)})


def extreme_values(table: DataFrame, names: Sequence[str], k: int = 10,
                   slice_rows: int = ordering.SLICE_ROWS) -> DataFrame:
    """The k most extreme distinct values per end and column, and how many rows hold each."""
    return ordering.extremes(ordering.value_counts(table, names, slice_rows), k)


def extreme_rows(table: DataFrame, column: str, end: str = "highest", values: int = 3, k: int = 10,
                 keys: Sequence[str] = ("time", "lat", "lon")) -> DataFrame:
    """The k rows at the most extreme distinct values of one column."""
    by = F.desc if end == "highest" else F.asc
    edge = (table.filter(F.col(column).isNotNull()).select(column).distinct()
            .orderBy(by(column)).limit(values))
    return (table.join(F.broadcast(edge), column, "left_semi")
            .select(*keys, column, TARGET).orderBy(by(column), *keys, TARGET).limit(k))


def spread_of_runs(runs: DataFrame, metric: str,
                   by: Sequence[str] = ("stage", "scenario", "model")) -> DataFrame:
    """Mean, spread and number of runs of a metric."""
    return runs.groupBy(*by).agg(F.round(F.avg(metric), 4).alias("mean"),
                                 F.round(F.stddev_samp(metric), 4).alias("std"),
                                 F.count(metric).alias("count"))
