"""Run records: one nested JSON line per run."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = ["log_loss", "brier", "threshold", "base_rate", "auc", "avg_precision", "f1",
           "baseline_log_loss", "skill_score", "rmse", "mae", "r2", "nrmse", "bias",
           "mean_observed", "mean_predicted", "baseline_rmse", "smearing_factor"]
WINDOW = ("STRUCT<window_h: INT, n: BIGINT, rmse: DOUBLE, mae: DOUBLE, r2: DOUBLE, nrmse: DOUBLE, "
          "bias: DOUBLE, cal_ratio: DOUBLE, cal_zero_share_observed: DOUBLE, cal_n_windows: BIGINT>")
SCHEMA = (
    "scenario STRING, stage STRING, model STRING, fold STRING, seed INT, train_rows BIGINT, "
    "n_params INT, seconds DOUBLE, epochs_run INT, best_epoch INT, stopped_early BOOLEAN, "
    "metrics STRUCT<" + ", ".join(f"{m}: DOUBLE" for m in METRICS)
    + f", n: BIGINT, windows: ARRAY<{WINDOW}>, windows_raw: ARRAY<{WINDOW}>>, "
    "config MAP<STRING, STRING>")


def append(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def store(records: DataFrame, path: str, fit: str) -> None:
    """The records of one fit, in a folder of its key; storing them again replaces them."""
    records.write.mode("overwrite").json(f"{path.rstrip('/')}/fit={fit}")


def _published(spark: SparkSession, path: str) -> DataFrame:
    """Records under their fits' keys; a folder that does not exist yet holds none."""
    try:
        return spark.read.schema(SCHEMA + ", fit STRING").option("basePath", path).json(path)
    except AnalysisException as absent:
        if absent.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA + ", fit STRING")


def stored_fits(spark: SparkSession, path: str) -> DataFrame:
    """Keys of the fits whose records are stored."""
    return _published(spark, path).select("fit").distinct()


def load(spark: SparkSession, path: str, fits: DataFrame | None = None) -> DataFrame:
    """All records of a folder, or those of the given fits."""
    if fits is None:
        return spark.read.schema(SCHEMA).json(path)
    return _published(spark, path).join(fits, "fit", "left_semi").drop("fit")


def flatten(records: DataFrame) -> DataFrame:
    """Runs with their scalar metrics as columns; the window curves stay behind."""
    plain = [c for c in records.columns if c not in ("metrics", "config")]
    return records.select(*plain, *[F.col(f"metrics.{m}").alias(m) for m in METRICS])


def window_curves(records: DataFrame, curve: str = "windows") -> DataFrame:
    """One row per run and reporting window."""
    runs = ["scenario", "stage", "model", "fold", "seed"]
    return records.select(*runs, F.explode(f"metrics.{curve}").alias("w")).select(*runs, "w.*")
