"""Event sources: text exports in, normalised strikes out."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clean
from ..model import EVENT_COLUMNS, EVENT_KEY

# Header names and patterns of the two export layouts.
CSV_REQUIRED = ["Date", "Time", "Latitude", "Longitude"]
CSV_PATTERN = "MM/dd/yyyy HH:mm:ss.SSSSSS"
SHEET_REQUIRED = ["Date and time", "Latitude", "Longitude"]
SHEET_PATTERN = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def read_text_table(spark: SparkSession, path: str | Sequence[str], pattern: str | None = None) -> DataFrame:
    """CSV with every column read as text, header names trimmed, and the file name kept.

    Each file is read by its own header; files of one header are read together,
    and a column that only some headers have is null elsewhere.
    """
    parts = []
    for header, files in headers(spark, path, pattern):
        names = [name.strip() for name in next(csv.reader([header]))]
        schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
        rows = spark.read.option("header", True).schema(schema).csv(files)
        parts.append(rows.select("*", F.col("_metadata.file_name").alias("_file")))
    if not parts:
        raise FileNotFoundError(f"no event files with a header under {path}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def headers(spark: SparkSession, path: str | Sequence[str], pattern: str | None = None) -> list[tuple[str, list[str]]]:
    """The different first lines under a path, each with its files, in order."""
    reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    lines = reader.text(path).where((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != ""))
    first = lines.select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("at")) \
        .groupBy("file").agg(F.min_by("value", "at").alias("header"))
    decoded = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    found = first.groupBy("header").agg(F.array_sort(F.collect_list(decoded)).alias("files")).orderBy("header").collect()
    return [(r["header"].lstrip("\ufeff"), r["files"]) for r in found]


def _require(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"required columns missing: {missing}")


def normalise_csv(df: DataFrame, label: str = "csv") -> DataFrame:
    """Date and time in two text columns, already UTC; polarity from the sign."""
    _require(df, CSV_REQUIRED)
    stamp = F.concat_ws(" ", F.trim("Date"), F.trim(clean.micros_only(F.col("Time"))))
    signal = clean.number(clean.optional(df, "Signal Strength", F.lit(None).cast("string")))
    out = df.select(
        clean.timestamp(stamp, CSV_PATTERN).alias("timestamp"),
        clean.number(F.col("Latitude")).alias("lat"),
        clean.number(F.col("Longitude")).alias("lon"),
        signal.alias("peak_current_ka"),
        clean.polarity_of_sign(signal).alias("polarity"),
        F.concat(F.lit(f"{label}:"), F.col("_file")).alias("source"))
    return out.na.drop(subset=["timestamp", "lat", "lon"])


def normalise_sheet(df: DataFrame, zone: str, label: str = "sheet") -> DataFrame:
    """One wall-clock text column; cloud-to-ground rows only; polarity from the code's suffix."""
    _require(df, SHEET_REQUIRED)
    code = clean.optional(df, "Discrimination", F.lit("CG"))
    signal = clean.number(clean.optional(df, "Signal (kA)", F.lit(None).cast("string")))
    local = clean.timestamp(F.trim("Date and time"), SHEET_PATTERN)
    out = df.filter(clean.has_prefix(code, "CG")).select(
        clean.to_utc(local, zone).alias("timestamp"),
        clean.number(F.col("Latitude")).alias("lat"),
        clean.number(F.col("Longitude")).alias("lon"),
        signal.alias("peak_current_ka"),
        clean.polarity_of_suffix(code).alias("polarity"),
        F.concat(F.lit(f"{label}:"), F.col("_file")).alias("source"))
    return out.na.drop(subset=["timestamp", "lat", "lon"])


def combine(frames: Sequence[DataFrame]) -> DataFrame:
    """All strikes of all files; nothing to read is an error."""
    if not frames:
        raise FileNotFoundError("no event files")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.select(*EVENT_COLUMNS)


def deduplicate(strikes: DataFrame, key: Sequence[str] = EVENT_KEY) -> DataFrame:
    """One row per strike key.

    Rows of one key may differ in their labels only; the smallest label wins,
    so a rerun picks the same row. The aggregate combines map-side, so copies of
    one strike shrink before the shuffle.
    """
    rest = [c for c in strikes.columns if c not in key]
    first = F.min(F.struct(*rest)).alias("_rest")
    return strikes.groupBy(*key).agg(first).select(*key, "_rest.*").select(*strikes.columns)


def read_strikes(spark: SparkSession, path: str | Sequence[str], layout: str = "csv",
                 pattern: str = "*.csv", zone: str = "UTC") -> DataFrame:
    """Every matching export under a path, deduplicated, in one scan per layout."""
    raw = read_text_table(spark, path, pattern)
    strikes = normalise_csv(raw) if layout == "csv" else normalise_sheet(raw, zone)
    return deduplicate(combine([strikes]))


def drop_report(before: DataFrame, kept: Column) -> DataFrame:
    """How many rows a filter keeps and drops."""
    kept = F.coalesce(kept, F.lit(False))
    return before.agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"))
