"""Tables of hours, days and months from one set of partials."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cellhour.model import KEY
from cellhour.operators import grid, periods
from workload.adapters import JANUARY, Tables

from .conftest import SF


def rounded(df, key):
    numbers = [c for c, t in df.dtypes if t in ("double", "bigint") and c not in key]
    return {tuple(r[k] for k in key): tuple(None if r[c] is None else round(r[c], 9) for c in sorted(numbers)) for r in df.collect()}


@pytest.mark.parametrize("hot", [3, 250_000])
def test_every_period_equals_statistics_of_the_events(spark, hot):
    events = Tables(spark, SF).strikes.withColumn(
        "peak_current_ka", F.when(F.col("event_id") % 17 != 0, F.round("peak_current_ka", 0)))
    parts = periods.partials(grid.cell_hours(events, JANUARY))
    for unit in periods.UNITS:
        parts = parts if unit == "hour" else periods.roll_up(parts, unit)
        labelled = grid.cell_hours(events, JANUARY).withColumn("time", F.date_trunc(unit, "time").cast("timestamp_ntz"))
        assert rounded(periods.statistics(parts, hot), KEY) == rounded(grid.event_statistics(labelled), KEY)


def test_skeletons_cover_every_period(spark):
    domain = replace(JANUARY, first_month="2024-01", last_month="2024-03")
    rows, columns = domain.shape()
    sizes = {u: periods.skeleton(spark, domain, u).distinct().count() for u in periods.UNITS}
    assert sizes == {"hour": rows * columns * 91 * 24, "day": rows * columns * 91, "month": rows * columns * 3}


def test_no_events_give_zeros_and_an_unknown_period_is_an_error(spark):
    none = Tables(spark, SF).strikes.where(F.lit(False))
    found = periods.tables(none, JANUARY)
    assert set(found) == set(periods.UNITS)
    assert found["day"].where("flash_count <> 0 OR median_abs_peak_current_ka IS NOT NULL").isEmpty()
    with pytest.raises(ValueError, match="week"):
        periods.tables(none, JANUARY, ["week"])
