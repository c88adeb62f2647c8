"""Predictors onto the dense table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..model import (BOOKKEEPING, CANDIDATES, INTENSITY, KEY, RAW_TEMPORAL, REPORTING_TARGET, TARGET,
                     Domain)
from .quality import check_keys


def with_calendar(table: DataFrame, domain: Domain) -> DataFrame:
    return table.withColumns(geo.calendar(F.col("time"), domain.solar_tz))


def attach(table: DataFrame, source: DataFrame | None, name: str, check: bool = True) -> DataFrame:
    """Left join of one predictor source; a source that is absent is skipped."""
    if source is None:
        return table
    if check:
        check_keys(table, source, name)
    return table.join(source, KEY, "left")


def ordered(table: DataFrame) -> DataFrame:
    """Contract order first; columns the contract does not name keep their place at the end."""
    predictors = [c for c in CANDIDATES if c not in ("lat", "lon")]
    contract = (["domain", "time", *RAW_TEMPORAL, "lat", "lon", *predictors, TARGET, *INTENSITY]
                + [c for c in BOOKKEEPING if c not in ("domain", "time")]
                + ["gfd_per_km2_per_day", REPORTING_TARGET])
    front = [c for c in contract if c in table.columns]
    return table.select(*front, *[c for c in table.columns if c not in front])
