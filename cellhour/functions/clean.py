"""Cleaning expressions: casts, defaults, clocks and period keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import FILL_VALUE


def number(col: Column) -> Column:
    """Text to double; bad text and NaN become null."""
    value = F.trim(col).try_cast("double")
    return F.when(~F.isnan(value), value)


def finite(col: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(col) & (F.abs(col) != F.lit(float("inf"))), col)


def timestamp(text: Column, pattern: str) -> Column:
    """Text to a zone-less timestamp; bad text becomes null."""
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def micros_only(text: Column) -> Column:
    """Cut a fraction of more than six digits down to six."""
    return F.regexp_replace(text, r"(\.\d{6})\d+", "$1")


def optional(df: DataFrame, name: str, default: Column) -> Column:
    """The named column if the table has it, else a default."""
    return F.col(f"`{name}`") if name in df.columns else default


def has_prefix(col: Column, prefix: str) -> Column:
    """Case-insensitive prefix test; null is false."""
    return F.coalesce(F.upper(col).startswith(prefix.upper()), F.lit(False))


def polarity_of_sign(signal: Column) -> Column:
    """A missing signal counts as negative."""
    return F.when(F.coalesce(signal >= 0, F.lit(False)), "positive").otherwise("negative")


def polarity_of_suffix(code: Column) -> Column:
    return F.when(F.coalesce(code.endswith("+"), F.lit(False)), "positive").otherwise("negative")


def to_utc(local: Column, zone: str) -> Column:
    """Wall-clock time of a zone to UTC.

    Hours a clock change skips or repeats become null: a skipped hour does not
    survive the round trip, a repeated one maps to the same wall clock an hour
    later or earlier as well.
    """
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    if zone.upper() == "UTC":
        return local
    back = lambda t: F.convert_timezone(F.lit("UTC"), F.lit(zone), t)
    hour = F.expr("INTERVAL 1 HOUR")
    ambiguous = (back(utc + hour) == local) | (back(utc - hour) == local)
    return F.when((back(utc) == local) & ~ambiguous, utc)


def period(col: Column, unit: str) -> Column:
    """Hour, day or month label without a zone."""
    return F.date_trunc(unit, col).cast("timestamp_ntz")


# Date keys by length, their period letter and pattern.
DATE_KEYS = {6: ("M", "yyyyMM"), 8: ("D", "yyyyMMdd"), 10: ("h", "yyyyMMddHH")}


def key_frequency(key: Column) -> Column:
    """Period letter of a date key; roll-up months and other lengths are null."""
    size = F.length(key)
    monthly = (size == 6) & ~key.endswith("13")
    return (F.when(monthly, "M").when(size == 8, "D").when(size == 10, "h"))


def key_period(key: Column) -> Column:
    """Start of the period a date key names."""
    size = F.length(key)
    parsed = F.lit(None).cast("timestamp_ntz")
    for length, (_, pattern) in DATE_KEYS.items():
        parsed = F.when(size == length, timestamp(key, pattern)).otherwise(parsed)
    return F.when(key_frequency(key).isNotNull(), parsed)


def sentinel_to_null(value: Column, fill: float = FILL_VALUE) -> Column:
    return F.when(value > fill, value)
