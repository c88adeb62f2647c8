"""Derived features and target transforms as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def cyclic(value: Column, cycle: float) -> tuple[Column, Column]:
    angle = F.lit(2.0) * F.pi() * value / F.lit(float(cycle))
    return F.sin(angle), F.cos(angle)


def solar_zenith_cosine(day: Column, hour: Column, lat: Column) -> Column:
    """Sine rule of spherical astronomy with a sinusoidal declination."""
    tilt = F.radians(F.lit(23.44)) * F.sin(F.lit(2.0) * F.pi() * (day - 81) / 365.25)
    hour_angle = F.radians((hour - F.lit(12.0)) * 15.0)
    phi = F.radians(lat)
    return F.sin(phi) * F.sin(tilt) + F.cos(phi) * F.cos(tilt) * F.cos(hour_angle)


def hour_encoding(kind: str, column: str = "hour_of_day_local") -> dict[str, Column]:
    """How the hour enters a model: not at all, as a number, or as a circle."""
    if kind == "none":
        return {}
    if kind == "raw":
        return {column: F.col(column)}
    if kind == "cyclic":
        sine, cosine = cyclic(F.col(column), 24.0)
        return {"hour_sin": sine, "hour_cos": cosine}
    raise ValueError(f"unknown hour encoding {kind!r}")


@dataclass(frozen=True)
class Derivation:
    """A feature computed from columns of the table."""

    name: str
    family: str
    inputs: tuple[str, ...]
    of: Callable[..., Column]

    def column(self) -> Column:
        return self.of(*[F.col(c) for c in self.inputs]).alias(self.name)


def _wave(name: str, column: str, cycle: float, side: int) -> Derivation:
    return Derivation(name, "temporal", (column,), lambda value: cyclic(value, cycle)[side])


#: Every derived feature, in contract order. Names, cycles, and kelvin at zero Celsius.
DERIVATIONS = {d.name: d for d in (
    _wave("hour_sin", "hour_of_day_local", 24.0, 0),
    _wave("hour_cos", "hour_of_day_local", 24.0, 1),
    _wave("doy_sin", "day_of_year", 365.25, 0),
    _wave("doy_cos", "day_of_year", 365.25, 1),
    Derivation("cos_sza", "temporal", ("day_of_year", "hour_of_day_local", "lat"), solar_zenith_cosine),
    # How far the air is from saturation, and total condensate.
    Derivation("dewpoint_depression", "moisture", ("T2M", "D2M"), lambda air, dew: air - (dew - F.lit(273.15))),
    Derivation("cloud_water", "moisture", ("TCLW", "TCIW"), lambda liquid, ice: liquid + ice),
)}


def family(name: str) -> dict[str, Column]:
    """All derivations of one family, by name."""
    return {d.name: d.column() for d in DERIVATIONS.values() if d.family == name}


def stage_target(count: Column, stage: str, transform: str = "log1p") -> Column:
    if stage == "occurrence":
        return (count > 0).cast("double")
    if stage != "count":
        raise ValueError(f"unknown stage {stage!r}")
    return forward(count, transform)


def forward(count: Column, transform: str) -> Column:
    if transform == "log1p":
        return F.log1p(count.cast("double"))
    if transform == "anscombe":
        return F.lit(2.0) * F.sqrt(count + F.lit(0.375))
    if transform == "none":
        return count.cast("double")
    raise ValueError(f"unknown target transform {transform!r}")


def inverse(value: Column, transform: str = "log1p") -> Column:
    if transform == "log1p":
        return F.expm1(value)
    if transform == "anscombe":
        return F.pow(value / 2.0, F.lit(2.0)) - F.lit(0.375)
    return value


def to_counts(value: Column, mean: float = 0.0, sd: float = 1.0, transform: str = "log1p") -> Column:
    """Model scale to raw counts: undo the standardisation, then the transform, then floor."""
    return F.greatest(inverse(value * F.lit(float(sd)) + F.lit(float(mean)), transform), F.lit(0.0))
