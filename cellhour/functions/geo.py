"""Grid, area, density and calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import (DAYS_PER_YEAR, GRID_DEG, KM_PER_DEG_LAT, KM_PER_DEG_LON, PERIOD_DAYS, Domain)


def wrap_longitude(lon: Column) -> Column:
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def cell_centre(coordinate: Column, grid: float = GRID_DEG) -> Column:
    return F.floor(coordinate / grid) * F.lit(float(grid)) + grid / 2


def snap_down(coordinate: Column, grid: float = GRID_DEG, pad: float = 0.0) -> Column:
    return F.floor((coordinate - pad) / grid) * F.lit(float(grid))


def snap_up(coordinate: Column, grid: float = GRID_DEG, pad: float = 0.0) -> Column:
    return F.ceil((coordinate + pad) / grid) * F.lit(float(grid))


def inside(domain: Domain, lat: Column, lon: Column, grid: float = GRID_DEG) -> Column:
    la0, la1, lo0, lo1 = domain.snapped(grid)
    return lat.between(la0, la1) & lon.between(lo0, lo1)


def cell_area_km2(lat: Column, grid: float = GRID_DEG) -> Column:
    """Cells narrow towards the poles."""
    return F.lit(grid * KM_PER_DEG_LAT) * F.lit(grid * KM_PER_DEG_LON) * F.cos(F.radians(lat))


def density_per_day(count: Column, area: Column, days: Column | float = PERIOD_DAYS) -> Column:
    days = F.lit(days) if isinstance(days, float) else days
    return count / area / days


def density_per_year(per_day: Column) -> Column:
    return per_day * DAYS_PER_YEAR


def period_days(freq: str, observed_days: Column | None = None) -> Column:
    """Length of one row's period; monthly rows count observed days only."""
    if freq == "M":
        return F.when(observed_days > 0, observed_days.cast("double"))
    return F.lit({"h": PERIOD_DAYS, "D": 1.0}[freq])


def calendar(time: Column, solar_zone: str) -> dict[str, Column]:
    local = F.convert_timezone(F.lit("UTC"), F.lit(solar_zone), time)
    return {
        "year": F.year(time),
        "month_of_year": F.month(time),
        "day_of_year": F.dayofyear(time),
        "hour_of_day_utc": F.hour(time),
        "hour_of_day_local": F.hour(local),
    }
