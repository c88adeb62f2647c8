"""Bringing coarser sources onto the project grid and clock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean


def nearest(targets: DataFrame, sources: DataFrame, target: str, source: str) -> DataFrame:
    """For each target coordinate its nearest source coordinate; a tie goes to the lower one.

    Both sides are the distinct coordinates of one axis, so the sources travel
    as one sorted array to the targets instead of pairing every two.
    """
    axis = sources.agg(F.array_sort(F.collect_set(source)).alias("axis"))
    pick = F.aggregate(
        "axis", F.lit(None).cast("double"),
        lambda best, s: F.when(best.isNull() | (F.abs(F.col(target) - s) < F.abs(F.col(target) - best)), s)
        .otherwise(best))
    return (targets.select(target).distinct().join(F.broadcast(axis), F.lit(True))
            .select(target, pick.alias(source)))


def regrid(rows: DataFrame, cells: DataFrame, values: Sequence[str]) -> DataFrame:
    """Each cell takes the series of the nearest source point, axis by axis.

    Every cell has a nearest point, so the cells, whose number the grid fixes,
    are sent to the rows and the rows stay where they are. Call once per
    parameter when parameters live on different native grids.
    """
    axes = rows.select("lat", "lon").distinct()
    by_lat = nearest(cells.withColumnRenamed("lat", "cell_lat"), axes, "cell_lat", "lat")
    by_lon = nearest(cells.withColumnRenamed("lon", "cell_lon"), axes, "cell_lon", "lon")
    placed = (cells.withColumnsRenamed({"lat": "cell_lat", "lon": "cell_lon"})
              .join(F.broadcast(by_lat), "cell_lat").join(F.broadcast(by_lon), "cell_lon"))
    joined = rows.join(F.broadcast(placed), ["lat", "lon"])
    return joined.select(F.col("cell_lat").alias("lat"), F.col("cell_lon").alias("lon"), "time", *values)


def every_hour(rows: DataFrame, freq: str) -> DataFrame:
    """Repeat a daily or monthly row over the hours it contains."""
    if freq == "h":
        return rows
    hour = F.expr("INTERVAL 1 HOUR")
    span = {"D": F.expr("INTERVAL 1 DAY"), "M": F.expr("INTERVAL 1 MONTH")}[freq]
    start = clean.period(F.col("time"), {"D": "day", "M": "month"}[freq])
    rest = [c for c in rows.columns if c != "time"]
    filled = F.explode(F.sequence(start, start + span - hour, hour)).alias("time")
    return rows.select(*rest, filled).select(*rows.columns)


def side_by_side(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Outer join on the keys; every key of every frame survives."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.join(frame, list(keys), "full_outer")
    return out
