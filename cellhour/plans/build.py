"""Events and two predictor sources to one table per domain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import (CANDIDATES, GRID_DEG, INTENSITY, POINT_PARAMETERS, SPATIAL, TARGET, Domain)
from ..operators import assemble, grid, quality, regrid
from ..sources import fields, points


def point_predictors(rows: DataFrame, domain: Domain,
                     parameters: Sequence[str] = POINT_PARAMETERS) -> DataFrame:
    """Long point series (lat, lon, time, parameter, value, freq) to wide cell-hours.

    Parameters that share their native points and frequency go through one
    pivot and one regrid; a parameter on a grid of its own gets its own axis map.
    """
    cells = grid.cells(rows.sparkSession, domain)
    layout = (rows.filter(F.col("value").isNotNull() & F.col("parameter").isin(*parameters))
              .groupBy("parameter", "freq")
              .agg(F.array_sort(F.collect_set("lat")).alias("lats"),
                   F.array_sort(F.collect_set("lon")).alias("lons")).collect())  # grid axes only
    if not layout:
        raise ValueError("no usable point parameter")
    groups: dict[tuple, list[str]] = {}
    for r in layout:
        groups.setdefault((r["freq"], tuple(r["lats"]), tuple(r["lons"])), []).append(r["parameter"])
    frames = []
    for (freq, _, _), names in sorted(groups.items(), key=lambda g: sorted(g[1])):
        names = [p for p in parameters if p in names]
        wide = points.parameter_matrix(rows.filter(F.col("freq") == freq), names)
        frames.append(regrid.every_hour(regrid.regrid(wide, cells, names), freq)
                      .filter(F.col("time").isNotNull()))
    return regrid.side_by_side(frames, ["lat", "lon", "time"])


def field_predictors(rows: DataFrame, extra: Sequence[DataFrame] = ()) -> DataFrame:
    """Field rows with a `file` column, and supplements, to cell-hours."""
    out = fields.mean_of_files(rows)
    for more in extra:
        out = fields.supplement(out, fields.mean_of_files(more))
    return fields.to_column_names(out)


def build(strikes: DataFrame, domain: Domain, point: DataFrame | None = None,
          field: DataFrame | None = None, grid_deg: float = GRID_DEG, min_coverage: float = 0.0,
          check: bool = True) -> DataFrame:
    """The complete table in contract order; sources left out are skipped."""
    table = grid.dense_table(strikes, domain, grid_deg, min_coverage=min_coverage)
    table = assemble.attach(table, point, "point", check)
    table = assemble.attach(table, field, "field", check)
    return assemble.ordered(assemble.with_calendar(table, domain))


def report(table: DataFrame) -> dict[str, DataFrame]:
    predictors = [c for c in CANDIDATES if c in table.columns and c not in SPATIAL]
    return {
        "zero_share": table.agg(F.avg((F.col(TARGET) == 0).cast("double")).alias("zero_share")),
        "dead_cells": quality.dead_cells(table),
        "missing": quality.missing_predictors(table, predictors) if predictors else None,
        "intensity": quality.intensity_usable(table, [c for c in INTENSITY if c in table.columns]),
    }
