"""Scores: ranking curves, classification and regression metrics, reporting windows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordering
from ..model import HOURS_PER_YEAR, WINDOW_HOURS
from .models import Linear, score_cuts, slice_sizes, sliced_scores, unpacked
from .profile import share

CLIP = 1e-9


def ranking_curve(scored: DataFrame, label: str, score: str, by: Sequence[str] = (),
                  slice_rows: int = ordering.SLICE_ROWS) -> DataFrame:
    """Per distinct score, from the highest down: hits and rows at it and above it.

    Rows collapse to distinct scores first; running totals then go slice by slice.
    """
    by = list(by)
    bounds = ordering.slice_bounds(scored, [score], slice_rows)
    counts = (ordering.long_form(scored, [score], keep=[*by, label], bounds=bounds)
              .groupBy(*by, "slice", "value")
              .agg(F.sum(F.col(label).cast("bigint")).alias("hit"), F.count(F.lit(1)).alias("n")))
    totals = ordering.running_totals(counts, by, ["hit", "n"], sliced=bool(bounds))
    return totals.select(
        *by, F.col("value").alias("score"), "hit", "n", "hit_before", "n_before", "hit_total", "n_total",
        (F.col("hit_total") - F.col("hit_before")).alias("hits_above"),
        (F.col("n_total") - F.col("n_before")).alias("rows_above"))


def ranking_scores(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average precision by steps, and the area under the ROC curve with ties halved."""
    hit, n = F.col("hit"), F.col("n")
    miss = n - hit
    miss_before = F.col("n_before") - F.col("hit_before")
    misses = F.col("n_total") - F.col("hit_total")
    precision = F.try_divide(hit, F.col("hit_total")) * F.col("hits_above") / F.col("rows_above")
    area = hit * (miss_before + miss / 2)
    return curve.groupBy(*by).agg(
        F.sum(precision).alias("average_precision"),
        F.try_divide(F.sum(area), F.max(F.col("hit_total") * misses)).alias("roc_auc"))


def fits_ranking(rows: DataFrame, fits: Sequence[Linear], label: str, **limits: int) -> dict[int, tuple[float | None, float | None]]:
    """Average precision and ROC area of every logistic fit with a score, as `ranking_scores` of a `ranking_curve` by fit has them.

    The scores are never rows: one pass counts hits and rows of every slice of each fit's scores, which tells what lies above and
    below a slice, and a second hands each slice, packed, to one task. A slice holds some `slice_rows` rows.
    """
    cuts = score_cuts(rows, fits, **limits)
    sizes = slice_sizes(rows, fits, label, cuts)
    total = sizes.sum(axis=1)
    upto = np.cumsum(sizes, axis=1)
    below, above = upto - sizes, total[:, None, :] - upto

    def measure(key: tuple, table: pa.Table) -> pa.Table:
        fit, at = key[0].as_py(), key[1].as_py()
        packed = {c: table.column(c).to_pylist() for c in ("hits", "hit_counts", "misses", "miss_counts")}
        score, hit = unpacked(packed["hits"], packed["hit_counts"])
        other, miss = unpacked(packed["misses"], packed["miss_counts"])
        passed = np.concatenate([[0], np.cumsum(miss)])
        low, high = (passed[np.searchsorted(other, score, side=side)] for side in ("left", "right"))
        hits_above = above[fit, at, 1] + np.cumsum(hit[::-1])[::-1]
        rows_above = hits_above + above[fit, at, 0] + passed[-1] - low
        precision = float((hit / max(total[fit, 1], 1) * hits_above / rows_above).sum())
        area = float((hit * (below[fit, at, 0] + low + (high - low) / 2)).sum())
        return pa.table({"fit": pa.array([fit], pa.int32()), "precision": [precision], "area": [area]})

    found = (sliced_scores(rows, fits, label, cuts).groupBy("fit", "slice").applyInArrow(measure, "fit int, precision double, area double")
             .groupBy("fit").agg(F.sum("precision").alias("precision"), F.sum("area").alias("area")).collect())
    out: dict[int, tuple[float | None, float | None]] = {}
    for r in found:
        misses, hits = (int(n) for n in total[r["fit"]])
        out[r["fit"]] = (r["precision"] if hits else None, r["area"] / (hits * misses) if hits and misses else None)
    return out


def classification(scored: DataFrame, label: str, score: str, by: Sequence[str] = (),
                   threshold: float | None = None,
                   slice_rows: int = ordering.SLICE_ROWS) -> DataFrame:
    """Log loss, Brier, F1 at the base rate, ranking scores, and the base-rate floor.

    One row per group; ranking scores and F1 are null when only one class is present.
    """
    by = list(by)
    p = F.greatest(F.least(F.col(score), F.lit(1 - CLIP)), F.lit(CLIP))
    rows = scored.select(*by, F.col(label).cast("int").alias("_y"), p.alias("_p"))
    y = F.col("_y")
    loss = -(y * F.log("_p") + (1 - y) * F.log(1 - F.col("_p")))
    base = rows.groupBy(*by).agg(
        F.avg(loss).alias("log_loss"), F.avg((F.col("_p") - y) * (F.col("_p") - y)).alias("brier"),
        F.avg("_y").alias("base_rate"), F.count(F.lit(1)).alias("n"))
    base = base.withColumn("threshold", F.col("base_rate") if threshold is None else F.lit(float(threshold)))
    curve = ranking_curve(rows, "_y", "_p", by, slice_rows)
    on = by if by else F.lit(True)
    cut = F.broadcast(base.select(*by, "threshold"))  # one row per group
    at = (curve.join(cut, on).filter(F.col("score") >= F.col("threshold")).groupBy(*by)
          .agg(F.sum("hit").alias("_tp"), F.sum("n").alias("_called"), F.max("hit_total").alias("_all")))
    out = (base.join(F.broadcast(ranking_scores(curve, by)), on, "left")
           .join(F.broadcast(at), on, "left"))
    rate = F.greatest(F.least(F.col("base_rate"), F.lit(1 - CLIP)), F.lit(CLIP))
    mixed = (F.col("base_rate") > 0) & (F.col("base_rate") < 1)
    floor = -(F.col("base_rate") * F.log(rate) + (1 - F.col("base_rate")) * F.log(1 - rate))
    f1 = F.coalesce(F.try_divide(2 * F.col("_tp"), F.col("_called") + F.col("_all")), F.lit(0.0))
    return out.select(
        *by, "log_loss", "brier", "threshold", "base_rate", "n",
        F.when(mixed, F.col("roc_auc")).alias("auc"),
        F.when(mixed, F.col("average_precision")).alias("avg_precision"),
        F.when(mixed, f1).alias("f1"), floor.alias("baseline_log_loss"),
        (1 - F.try_divide(F.col("log_loss"), floor)).alias("skill_score"))


def regression_columns(observed: Column, predicted: Column, baseline: Column | None = None) -> dict[str, Column]:
    """Aggregates of one regression report.

    Without a given baseline the floor is the mean of the observed values, whose
    RMSE is their population spread.
    """
    error = predicted - observed
    rmse = F.sqrt(F.avg(error * error))
    spread = F.stddev_pop(observed)
    extent = F.max(observed) - F.min(observed)
    floor = spread if baseline is None else F.sqrt(F.avg((observed - baseline) * (observed - baseline)))
    return {
        "rmse": rmse, "mae": F.avg(F.abs(error)),
        "r2": F.when(spread > 0, 1 - F.sum(error * error) / (F.count(observed) * F.var_pop(observed))),
        "nrmse": F.when(extent > 0, rmse / extent), "bias": F.avg(error),
        "mean_observed": F.avg(observed), "mean_predicted": F.avg(predicted), "n": F.count(F.lit(1)),
        "baseline_rmse": floor, "skill_score": F.when(floor > 0, 1 - rmse / floor),
    }


def regression(scored: DataFrame, observed: str, predicted: str, by: Sequence[str] = (),
               baseline: float | None = None) -> DataFrame:
    given = F.lit(float(baseline)) if baseline is not None else None
    report = regression_columns(F.col(observed), F.col(predicted), given)
    return scored.groupBy(*by).agg(*[c.alias(n) for n, c in report.items()])


def r_squared(scored: DataFrame, observed: str, predicted: str) -> DataFrame:
    return regression(scored, observed, predicted).select("r2", "n")


def smearing_factor(validation: DataFrame, observed: str = "observed", predicted: str = "predicted",
                    by: Sequence[str] = ()) -> DataFrame:
    """Mean observed over mean predicted count; 1 where that is not a usable number."""
    means = validation.groupBy(*by).agg(F.avg(observed).alias("o"), F.avg(predicted).alias("p"))
    usable = (F.col("p") > 1e-12) & (F.col("o") > 0) & (F.col("p") < F.lit(float("inf")))
    return means.select(*by, F.when(usable, F.col("o") / F.col("p")).otherwise(1.0).alias("factor"))


def window_start(time: Column, hours: Column | int) -> Column:
    """Start of the reporting window, counted from the epoch in UTC."""
    hours = F.lit(hours) if isinstance(hours, int) else hours
    seconds = F.unix_seconds(time.cast("timestamp"))
    size = hours * F.lit(3600)
    return F.timestamp_seconds(F.floor(seconds / size) * size).cast("timestamp_ntz")


def windows(predictions: DataFrame, hours: Sequence[int] = WINDOW_HOURS,
            by: Sequence[str] = ()) -> DataFrame:
    """Predicted and observed counts per cell and window, for every window size in one job.

    Only rows that exist are summed; no window is invented.
    """
    sized = predictions.select(
        *by, "lat", "lon", "time", "area_km2", "predicted", F.col("observed").cast("double").alias("observed"),
        F.explode(F.array(*[F.lit(h) for h in hours])).alias("window_h"))
    return sized.groupBy(*by, "window_h", "lat", "lon", window_start(F.col("time"), F.col("window_h")).alias("window")).agg(
        F.sum("predicted").alias("predicted"), F.sum("observed").alias("observed"),
        F.min("area_km2").alias("area_km2"), F.count(F.lit(1)).alias("n_hours"))


def window_density(count: Column, area: Column, n_hours: Column) -> Column:
    return count / area / (n_hours / F.lit(HOURS_PER_YEAR))


def calibration_columns(observed: Column, predicted: Column) -> dict[str, Column]:
    mean = F.avg(observed)
    return {
        "cal_mean_observed": mean, "cal_mean_predicted": F.avg(predicted),
        "cal_ratio": F.when(mean > 0, F.avg(predicted) / mean),
        "cal_zero_share_observed": share(observed == 0), "cal_n_windows": F.count(F.lit(1)),
    }


def calibration(windowed: DataFrame, by: Sequence[str] = ("window_h",)) -> DataFrame:
    report = calibration_columns(F.col("observed"), F.col("predicted"))
    return windowed.groupBy(*by).agg(*[c.alias(n) for n, c in report.items()])


def window_curve(predictions: DataFrame, hours: Sequence[int] = WINDOW_HOURS,
                 by: Sequence[str] = ()) -> DataFrame:
    """Skill in density units, and calibration in counts, by window size."""
    w = windows(predictions, hours, by)
    density = lambda c: window_density(F.col(c), F.col("area_km2"), F.col("n_hours"))
    rows = w.withColumns({"gfd_observed": density("observed"), "gfd_predicted": density("predicted")})
    report = {**regression_columns(F.col("gfd_observed"), F.col("gfd_predicted")),
              **calibration_columns(F.col("observed"), F.col("predicted"))}
    return rows.groupBy(*by, "window_h").agg(*[c.alias(n) for n, c in report.items()])
