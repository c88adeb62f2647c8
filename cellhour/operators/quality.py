"""Checks on data: each returns a report, the `check_` ones also raise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import quantiles
from ..model import INTENSITY, KEY, TARGET


def key_overlap(table: DataFrame, source: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """How many distinct keys of the table the source covers."""
    keys = list(keys)
    mine = table.select(*keys).distinct()
    theirs = source.select(*keys).distinct().withColumn("_hit", F.lit(1))
    joined = mine.join(theirs, keys, "left")
    hit = F.count("_hit")
    return joined.agg(
        F.count(F.lit(1)).alias("n_keys"), hit.alias("n_covered"),
        (hit / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("share")).withColumn(
        "verdict", F.when(F.col("n_covered") == 0, "none").when(F.col("share") < 0.5, "low").otherwise("ok"))


def key_types(table: DataFrame, source: DataFrame, keys: Sequence[str] = KEY) -> list[str]:
    """Keys whose types differ; a join on them would match nothing."""
    return [k for k in keys if table.schema[k].dataType != source.schema[k].dataType]


def check_keys(table: DataFrame, source: DataFrame, name: str, keys: Sequence[str] = KEY) -> dict:
    wrong = key_types(table, source, keys)
    if wrong:
        raise TypeError(f"{name}: key types differ on {wrong}")
    report = key_overlap(table, source, keys).first().asDict()
    if report["verdict"] == "none":
        raise ValueError(f"{name}: no key in common with the table")
    return report


def completeness(table: DataFrame) -> DataFrame:
    """Rows against cells times hours."""
    facts = table.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("lat", "lon").alias("n_cells"),
                      F.count_distinct("time").alias("n_hours"))
    return facts.withColumn("complete", F.col("n_rows") == F.col("n_cells") * F.col("n_hours"))


def check_complete(table: DataFrame) -> dict:
    report = completeness(table).first().asDict()
    if not report["complete"]:
        raise AssertionError(f"not a complete grid: {report}")
    return report


def metadata_drift(table: DataFrame, recorded: dict) -> dict:
    """Sizes and columns that disagree with what the sidecar recorded."""
    now = table.agg(F.count(F.lit(1)).alias("n_rows"),
                    F.count_distinct("lat", "lon").alias("n_cells")).first().asDict()
    drift = {k: (recorded[k], v) for k, v in now.items() if k in recorded and recorded[k] != v}
    if "columns" in recorded and list(recorded["columns"]) != table.columns:
        drift["columns"] = (sorted(set(recorded["columns"]) - set(table.columns)),
                            sorted(set(table.columns) - set(recorded["columns"])))
    return drift


def duplicates(table: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Surplus rows on the key, and on the whole row.

    Whole rows group first; the key then groups what is left, so a row with very
    many copies has shrunk to one before the second shuffle.
    """
    whole = table.groupBy(*table.columns).agg(F.count(F.lit(1)).alias("_copies"))
    per_key = whole.groupBy(*keys).agg(F.sum("_copies").alias("_rows"), F.count(F.lit(1)).alias("_kinds"))
    return per_key.agg(
        F.sum(F.col("_rows") - 1).alias("n_duplicate_keys"),
        F.sum(F.col("_rows") - F.col("_kinds")).alias("n_duplicate_rows"))


def check_unique(table: DataFrame, keys: Sequence[str] = KEY) -> None:
    found = duplicates(table, keys).first()
    if found["n_duplicate_keys"]:
        raise AssertionError(f"{found['n_duplicate_keys']} surplus rows on {list(keys)}")


def missing_predictors(table: DataFrame, predictors: Sequence[str]) -> DataFrame:
    """Null share per predictor, and whether nothing ever arrived."""
    shares = table.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in predictors])
    long = shares.unpivot([], list(predictors), "predictor", "null_share")
    return long.withColumn("all_missing", F.col("null_share") == 1.0)


def dead_cells(table: DataFrame) -> DataFrame:
    """Cells without a single event, and how many rows they hold."""
    return (table.groupBy("lat", "lon").agg(F.sum(TARGET).alias("events"), F.count(F.lit(1)).alias("n_rows"))
            .filter(F.col("events") == 0).select("lat", "lon", "n_rows"))


def without_dead_cells(table: DataFrame) -> DataFrame:
    return table.join(dead_cells(table).select("lat", "lon"), ["lat", "lon"], "left_anti")


def intensity_usable(table: DataFrame, columns: Sequence[str] = INTENSITY) -> DataFrame:
    """Non-zero rows, and those that carry every intensity statistic."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    eventful = F.col(TARGET) > 0
    usable = F.count_if(eventful & whole)
    return table.agg(F.count_if(eventful).alias("n_nonzero"), usable.alias("n_usable"),
                     F.try_divide(usable, F.count_if(eventful)).alias("share"))


def not_finite(name: str) -> Column:
    value = F.col(name).cast("double")
    return value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))


def fit_inputs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """What would stop a fit: values missing or not finite, and columns without quartile spread."""
    counts = df.agg(*[F.count_if(not_finite(c)).alias(c) for c in columns]).first()
    rows = []
    for c, (q1, q3) in quantiles(df, columns, [0.25, 0.75]).items():
        iqr = None if q1 is None else q3 - q1
        rows.append((c, counts[c], iqr, counts[c] == 0 and iqr is not None and iqr > 0))
    return df.sparkSession.createDataFrame(rows, "column STRING, n_bad BIGINT, iqr DOUBLE, fits BOOLEAN")


def check_fit_inputs(df: DataFrame, columns: Sequence[str]) -> None:
    """Nothing is imputed, so a null, NaN or infinity in a fitted column is a fault."""
    counts = df.agg(*[F.count_if(not_finite(c)).alias(c) for c in columns]).first().asDict()
    found = {c: n for c, n in counts.items() if n}
    if found:
        raise ValueError(f"values missing or not finite: {found}")


def alignment(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Rows of each side without a partner; both zero when the frames describe the same rows."""
    keys = list(keys)
    mark = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    both = mark(left, "l").join(mark(right, "r"), keys, "full_outer").fillna(0, ["l", "r"])
    return both.agg(F.sum(F.greatest(F.col("l") - F.col("r"), F.lit(0))).alias("left_only"),
                    F.sum(F.greatest(F.col("r") - F.col("l"), F.lit(0))).alias("right_only"))


def check_aligned(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEY) -> None:
    report = alignment(left, right, keys).first().asDict()
    if report["left_only"] or report["right_only"]:
        raise ValueError(f"frames do not describe the same rows: {report}")


def fingerprint(table: DataFrame) -> DataFrame:
    """A number that changes when any row changes, whatever the row order."""
    row = F.xxhash64(*[F.col(c) for c in sorted(table.columns)])
    return table.agg(F.bit_xor(row).alias("xor"), F.sum(F.pmod(row, F.lit(2 ** 31))).alias("checksum"),
                     F.count(F.lit(1)).alias("n_rows"))
