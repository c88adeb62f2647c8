"""The driver's tables seen as strikes, point series, field rows and a built table.

Every recipe is plain arithmetic on columns, written once as SQL expressions
that Spark and the oracle evaluate alike; the few functions that differ by
dialect are filled in per engine.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from cellhour.model import Domain

JANUARY = Domain("tropis", -8.0, -5.5, 106.0, 109.0, "2024-01", "2024-01", "Asia/Jakarta", "Asia/Jakarta")
FIRST_YEAR, LAST_YEAR = 1995, 2001
TABLE_FOLDS = [([1995, 1996, 1997, 1998], 1999), ([1995, 1996, 1997, 1998, 1999], 2000),
               ([1995, 1996, 1997, 1998, 1999, 2000], 2001)]
ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

SPARK = {
    "hour_of": lambda c: f"CAST(date_trunc('hour', {c}) AS TIMESTAMP_NTZ)",
    "month_of": lambda c: f"CAST(date_trunc('month', {c}) AS TIMESTAMP_NTZ)",
    "plus_hours": lambda c, n: f"timestampadd(HOUR, {n}, {c})",
    "days_in_month": lambda c: f"dayofmonth(last_day({c}))",
}
DUCK = {
    "hour_of": lambda c: f"date_trunc('hour', {c})",
    "month_of": lambda c: f"date_trunc('month', {c})",
    "plus_hours": lambda c, n: f"({c} + to_hours({n}))",
    "days_in_month": lambda c: f"day(last_day({c}))",
}

SIGN = "CASE WHEN event_type IN ('error', 'view') THEN -1e0 ELSE 1e0 END"


def strikes_layers(d: dict) -> list[dict[str, str]]:
    return [{
        "event_id": "event_id",
        "timestamp": "ts",
        "lat": "-8e0 + ((user_id * 37) % 250) / 1e2",
        "lon": "106e0 + ((event_id * 53) % 300) / 1e2",
        "peak_current_ka": f"value * ({SIGN})",
        "polarity": f"CASE WHEN value * ({SIGN}) >= 0 THEN 'positive' ELSE 'negative' END",
        "source": "event_type",
    }]


PARAMETER = ("CASE event_type WHEN 'view' THEN 'PS' WHEN 'click' THEN 'PRECTOTCORR' WHEN 'error' THEN 'T2M' "
             "WHEN 'signup' THEN 'RH2M' ELSE 'WS2M' END")


def points_layers(d: dict) -> list[dict[str, str]]:
    return [{
        "event_id": "event_id",
        "lat": "-8e0 + (user_id % 6) / 2e0",
        "lon": "106.25e0 + (event_id % 5) * 0.625e0",
        "time": d["hour_of"]("ts"),
        "parameter": PARAMETER,
        "value": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END",
        "freq": "'h'",
    }]


def field_layers(d: dict) -> list[dict[str, str]]:
    return [{
        "event_id": "event_id",
        "file": "CASE WHEN event_id % 3 = 0 THEN 'a' ELSE 'b' END",
        "latitude": "-8e0 + (user_id % 11) / 4e0",
        "longitude": "106e0 + (event_id % 13) / 4e0 + CASE WHEN event_id % 2 = 0 THEN 360e0 ELSE 0e0 END",
        "valid_time": "ts",
        "cape": "value * 1e1",
        "kx": "value / 2e0",
        "tciw": "(event_id % 50) / 1e2",
        "tclw": "(user_id % 40) / 1e2",
        "cin": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 90) * 1e0 END",
        "cbh": "CASE WHEN user_id % 5 = 0 THEN NULL ELSE (user_id % 60) * 1e1 END",
        "number": "0",
        "expver": "'0001'",
        "oddity": "event_id % 3",
    }]


def table_layers(d: dict) -> list[dict[str, str]]:
    keys = {c: c for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                           "l_discount", "l_tax", "l_quantity")}
    first = {
        **keys,
        "time": d["plus_hours"]("l_shipdate", "l_orderkey % 24"),
        "domain": "CASE WHEN l_suppkey % 3 = 0 THEN 'tropis' ELSE 'subtropis' END",
        "lat": "-7.75e0 + (l_suppkey % 5) / 2e0",
        "lon": "106.25e0 + (l_partkey % 6) / 2e0",
        "PS": "95e0 + (l_partkey % 97) / 1e1",
        "PRECTOTCORR": "((l_partkey * 7) % 13) / 2e0",
        "T2M": "18e0 + l_quantity / 4e0",
        "RH2M": "l_discount * 1e3",
        "WS2M": "l_tax * 1e2",
        "CAPE": "greatest(0e0, l_extendedprice - 2e4) / 2e1",
        "KX": "l_extendedprice * l_discount / 1e2",
        "TCIW": "CASE WHEN l_linenumber <= 2 THEN 0e0 ELSE l_discount END",
        "TCLW": "CASE WHEN l_linenumber <= 2 THEN 0e0 ELSE l_linenumber / 1e1 + l_tax END",
        "D2M": "290.15e0 + l_quantity / 4e0 - l_tax * 5e1",
        "flash_count": "CAST(greatest(0e0, floor(l_extendedprice * l_discount / 1e2) - 60) AS BIGINT)",
    }
    second = {
        **{c: c for c in first},
        "CIN": "CASE WHEN CAPE > 0 AND l_partkey % 5 <> 0 THEN least(1000e0, (l_suppkey % 45) * 25e0) END",
        "CBH": "CASE WHEN TCLW + TCIW > 0 AND l_suppkey % 9 <> 0 THEN l_partkey * 1.5e0 END",
        "year": "CAST(year(time) AS INT)",
        "month_of_year": "CAST(month(time) AS INT)",
        "day_of_year": "CAST(dayofyear(time) AS INT)",
        "hour_of_day_utc": "CAST(hour(time) AS INT)",
        "hour_of_day_local": "CAST((hour(time) + 7) % 24 AS INT)",
        "month": d["month_of"]("time"),
        "days_in_month": f"CAST({d['days_in_month']('time')} AS INT)",
        "area_km2": "55.287e0 * 55.66e0 * cos(radians(lat))",
        "mean_peak_current_ka": "CASE WHEN flash_count > 0 THEN l_tax * 1e2 - l_discount * 1e2 END",
        "positive_share": "CASE WHEN flash_count > 0 THEN l_tax * 1e1 END",
        "median_abs_peak_current_ka": "CASE WHEN flash_count > 0 AND l_linenumber <> 7 THEN l_quantity END",
        "max_abs_peak_current_ka": "CASE WHEN flash_count > 0 THEN l_quantity * 2e0 END",
        "p95_abs_peak_current_ka": "CASE WHEN flash_count > 0 THEN l_quantity * 1.5e0 END",
    }
    third = {
        **{c: c for c in second},
        "observed_days": "CAST(CASE WHEN (year * 12 + month_of_year) % 7 = 0 THEN 0 "
                         "ELSE days_in_month - month_of_year % 3 END AS INT)",
        "cloud_water": "TCLW + TCIW",
    }
    fourth = {**{c: c for c in third}, "coverage": "observed_days / (days_in_month * 1e0)"}
    return [first, second, third, fourth]


def scored_layers(d: dict) -> list[dict[str, str]]:
    """Labels, probabilities and predicted counts beside the observed ones."""
    return [{
        **{c: c for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")},
        "time": d["plus_hours"]("l_shipdate", "l_orderkey % 24"),
        "year": "CAST(year(l_shipdate) AS INT)",
        "lat": "-7.75e0 + (l_suppkey % 5) / 2e0",
        "lon": "106.25e0 + (l_partkey % 6) / 2e0",
        "area_km2": "3e3 + (l_suppkey % 5)",
        "observed": "CAST(greatest(0e0, floor(l_extendedprice * l_discount / 1e2) - 60) AS BIGINT)",
        "flashed": "CAST(CASE WHEN floor(l_extendedprice * l_discount / 1e2) > 60 THEN 1 ELSE 0 END AS INT)",
        "p": "least(1e0, greatest(0e0, floor(l_extendedprice / 5e2) * l_discount / 2e1))",
        "predicted": "l_quantity * l_discount",
    }]


def render(name: str, base: str, layers: list[dict[str, str]]) -> str:
    """The layers as nested SELECTs in a named sub-query."""
    inner = base
    for i, layer in enumerate(layers):
        shown = ", ".join(e if e == c else f'{e} AS "{c}"' for c, e in layer.items())
        inner = f"(SELECT {shown} FROM {inner}) AS layer{i}" if i < len(layers) - 1 else f"SELECT {shown} FROM {inner}"
    return f"{name} AS ({inner})"


V_STRIKES = render("v_strikes", "events", strikes_layers(DUCK))
V_POINTS = render("v_points", "events", points_layers(DUCK))
V_FIELD = render("v_field", "events", field_layers(DUCK))
V_TABLE = render("v_table", "lineitem", table_layers(DUCK))
V_SCORED = render("v_scored", "lineitem", scored_layers(DUCK))
V_HOURS = """v_hours AS (SELECT -7.75e0 + i / 2e0 AS lat, 106.25e0 + j / 2e0 AS lon,
  TIMESTAMP '2024-01-01' + to_hours(h) AS "time"
  FROM range(5) a(i), range(6) b(j), range(744) c(h))"""
# Strikes counted per cell and hour on the complete grid of January 2024.
V_DENSE = """v_agg AS (SELECT floor(lat / 0.5e0) * 0.5e0 + 0.25e0 AS lat, floor(lon / 0.5e0) * 0.5e0 + 0.25e0 AS lon,
  date_trunc('hour', "timestamp") AS "time", count(*) AS flash_count, avg(peak_current_ka) AS mean_peak_current_ka,
  avg(CASE WHEN polarity = 'positive' THEN 1e0 ELSE 0e0 END) AS positive_share,
  quantile_cont(abs(peak_current_ka), 0.5) AS median_abs_peak_current_ka,
  max(abs(peak_current_ka)) AS max_abs_peak_current_ka,
  quantile_cont(abs(peak_current_ka), 0.95) AS p95_abs_peak_current_ka
  FROM v_strikes WHERE floor(lat / 0.5e0) * 0.5e0 + 0.25e0 BETWEEN -8 AND -5.5
  AND floor(lon / 0.5e0) * 0.5e0 + 0.25e0 BETWEEN 106 AND 109 GROUP BY 1, 2, 3),
v_coverage AS (SELECT count(DISTINCT CAST("timestamp" AS DATE)) AS observed_days, 31 AS days_in_month,
  count(DISTINCT CAST("timestamp" AS DATE)) / 31e0 AS coverage FROM v_strikes
  WHERE date_trunc('month', "timestamp") = TIMESTAMP '2024-01-01'),
v_dense AS (SELECT h.lat, h.lon, h."time", coalesce(a.flash_count, 0) AS flash_count, a.mean_peak_current_ka,
  a.positive_share, a.median_abs_peak_current_ka, a.max_abs_peak_current_ka, a.p95_abs_peak_current_ka,
  TIMESTAMP '2024-01-01' AS "month", c.observed_days, c.days_in_month, c.coverage,
  55.287e0 * 55.66e0 * cos(radians(h.lat)) AS area_km2
  FROM v_hours h LEFT JOIN v_agg a ON h.lat = a.lat AND h.lon = a.lon AND h."time" = a."time", v_coverage c)"""
DENSE = [V_STRIKES, V_HOURS, V_DENSE]


@dataclass(frozen=True)
class Tables:
    """The driver's tables of one folder, and the views made of them."""

    spark: SparkSession
    sf_dir: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _layered(self, base: str, layers: list[dict[str, str]]) -> DataFrame:
        df = self.read(base)
        for layer in layers:
            df = df.selectExpr(*[f"{e} AS `{c}`" for c, e in layer.items()])
        return df

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events")

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.read("lineitem")

    @cached_property
    def strikes(self) -> DataFrame:
        return self._layered("events", strikes_layers(SPARK))

    @cached_property
    def points(self) -> DataFrame:
        return self._layered("events", points_layers(SPARK))

    @cached_property
    def field(self) -> DataFrame:
        return self._layered("events", field_layers(SPARK))

    @cached_property
    def table(self) -> DataFrame:
        return self._layered("lineitem", table_layers(SPARK))

    @cached_property
    def scored(self) -> DataFrame:
        return self._layered("lineitem", scored_layers(SPARK))
