"""Every description and diagnosis of a built table, as named DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CANDIDATES, KEY
from ..operators import diagnose, profile, quality

# Which column is expected to be absent because of which other.
PARTNERS = {"CIN": "CAPE", "CBH": "cloud_water"}


def describe(table: DataFrame, key: Sequence[str] = KEY) -> dict[str, DataFrame]:
    """Profile of a table; raises when the grid is incomplete or a key repeats."""
    quality.check_complete(table)
    quality.check_unique(table, key)
    names = [c for c in CANDIDATES if c in table.columns]
    gappy = [r["column"] for r in profile.missingness(table, names).collect() if r["n_null"]]
    return {
        "missingness": profile.missingness(table, names),
        "missing_rows": profile.missing_rows(table, names),
        **({"missing_together": profile.missing_together(table, gappy)} if len(gappy) > 1 else {}),
        **({"missing_by_year": profile.missing_by(table, gappy, "year"),
            "missing_by_month": profile.missing_by(table, gappy, "month_of_year")} if gappy else {}),
        "columns": profile.columns(table, names),
        "target": profile.target_summary(table),
        "target_by_year": profile.target_by_year(table),
        "nonzero": profile.nonzero_summary(table),
        "coverage": profile.coverage_summary(table),
        "rank_pairs": profile.ranked_pairs(profile.rank_correlation(table, names, key)),
        "tails": profile.tails(table, names),
        "extremes": profile.extreme_values(table, names),
    }


def diagnosis(table: DataFrame) -> dict[str, DataFrame]:
    """Missing values against their partners, the shape of the zeros, and the two cycles."""
    if {"TCLW", "TCIW"} <= set(table.columns):
        table = table.withColumn("cloud_water", F.col("TCLW") + F.col("TCIW"))
    out: dict[str, DataFrame] = {}
    for column, partner in PARTNERS.items():
        if column not in table.columns or partner not in table.columns:
            continue
        out[f"{column}_split"] = diagnose.partner_split(table, column, partner)
        out[f"{column}_deciles"] = diagnose.null_rate_by_partner(table, column, partner)
        out[f"{column}_residual"] = diagnose.residual(table, column, partner)
        out[f"{column}_residual_months"] = diagnose.residual_by_month(table, column, partner)
        out[f"{column}_target"] = diagnose.missing_against_target(table, column, partner)
        out[f"{column}_ceiling"] = diagnose.ceiling(table, column)
        out[f"{column}_top"] = diagnose.top_values(table, column)
    by_cell = diagnose.temporal_by_cell(table)
    return {
        **out,
        "runs": diagnose.run_summary(diagnose.zero_runs(table)),
        "by_hour": diagnose.zero_share_by(table, "hour_of_day_local"),
        "by_month": diagnose.zero_share_by(table, "month_of_year"),
        "shape": diagnose.count_shape(table),
        "cycles": diagnose.temporal_pooled(table),
        "cycles_by_cell": by_cell,
        "cycle_spread": diagnose.temporal_spread(by_cell),
        "busiest": diagnose.busiest_cells(by_cell),
    }
