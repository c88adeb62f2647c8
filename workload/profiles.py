"""Description and diagnosis of the built table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from cellhour.operators import diagnose, profile

from .adapters import ROW_KEY, V_SCORED, V_TABLE, Tables
from .registry import query
from .sources import RUN_ROWS, run_records

NAMES = ["lat", "PS", "PRECTOTCORR", "T2M", "RH2M", "WS2M", "CAPE", "KX", "TCIW", "CIN", "CBH"]
GAPPY = ["CIN", "CBH"]


def union(parts) -> str:
    return "SELECT * FROM (" + "\nUNION ALL ".join(parts) + ") u"


def moments_sql(v: str) -> str:
    return f"avg({v}) AS mean, stddev_samp({v}) AS sd, skewness({v}) AS skew, kurtosis({v}) AS kurtosis"


def quantiles_sql(v: str, probs: dict[str, float]) -> str:
    return ", ".join(f"quantile_cont({v}, {p}) AS {n}" for n, p in probs.items())


@query("A8_column_profile", "column:s n:l mean:d sd:d min:d p1:d p25:d p50:d p75:d p99:d max:d skew:d kurtosis:d "
                            "zero_share:d negative_share:d n_distinct:l is_constant:b largest_point_mass_value:d "
                            "largest_point_mass_share:d",
       union(f"""SELECT '{c}' AS "column", count("{c}") AS n, {moments_sql(f'"{c}"')}, min("{c}") AS min, max("{c}") AS max,
       {quantiles_sql(f'"{c}"', profile.PROFILE_PROBS)},
       avg(CASE WHEN "{c}" = 0 THEN 1e0 ELSE 0e0 END) FILTER (WHERE "{c}" IS NOT NULL) AS zero_share,
       avg(CASE WHEN "{c}" < 0 THEN 1e0 ELSE 0e0 END) FILTER (WHERE "{c}" IS NOT NULL) AS negative_share,
       count(DISTINCT "{c}") AS n_distinct, count(DISTINCT "{c}") <= 1 AS is_constant,
       (SELECT "{c}" FROM v_table WHERE "{c}" IS NOT NULL GROUP BY "{c}" ORDER BY count(*) DESC, "{c}" LIMIT 1) AS largest_point_mass_value,
       (SELECT count(*) FROM v_table WHERE "{c}" IS NOT NULL GROUP BY "{c}" ORDER BY count(*) DESC LIMIT 1) / CAST(count("{c}") AS DOUBLE) AS largest_point_mass_share
       FROM v_table""" for c in NAMES), [V_TABLE])
def column_profile(t: Tables) -> DataFrame:
    return profile.columns(t.table, NAMES)


@query("A9_missingness", "column:s n_null:l share:d",
       union(f"""SELECT '{c}' AS "column", count(*) - count("{c}") AS n_null, (count(*) - count("{c}")) / CAST(count(*) AS DOUBLE) AS share
       FROM v_table""" for c in NAMES), [V_TABLE])
def missingness(t: Tables) -> DataFrame:
    return profile.missingness(t.table, NAMES)


@query("A9b_missing_rows", "rows_any_null:l rows_all_present:l",
       """SELECT count(*) FILTER (WHERE "CIN" IS NULL OR "CBH" IS NULL) AS rows_any_null,
       count(*) FILTER (WHERE "CIN" IS NOT NULL AND "CBH" IS NOT NULL) AS rows_all_present FROM v_table""", [V_TABLE])
def missing_rows(t: Tables) -> DataFrame:
    return profile.missing_rows(t.table, NAMES)


@query("A9c_missing_together", "column:s other:s n_null:l share:d",
       union(f"""SELECT '{a}' AS "column", '{b}' AS other, count(*) FILTER (WHERE "{a}" IS NULL) AS n_null,
       count(*) FILTER (WHERE "{a}" IS NULL AND "{b}" IS NULL) / CAST(count(*) FILTER (WHERE "{a}" IS NULL) AS DOUBLE) AS share
       FROM v_table""" for a, b in (GAPPY, GAPPY[::-1])), [V_TABLE])
def missing_together(t: Tables) -> DataFrame:
    return profile.missing_together(t.table, GAPPY)


@query("A9d_missing_by_year", "year:l column:s null_share:d",
       union(f"""SELECT year, '{c}' AS "column", avg(CASE WHEN "{c}" IS NULL THEN 1e0 ELSE 0e0 END) AS null_share
       FROM v_table GROUP BY year""" for c in GAPPY), [V_TABLE])
def missing_by_year(t: Tables) -> DataFrame:
    return profile.missing_by(t.table, GAPPY, "year")


@query("A10_target_report", "n_rows:l zero_share_all_rows:d n_rows_observed:l zero_share_observed_rows:d n_nonzero:l "
                            "total_flashes:l mean:d variance:d var_over_mean:d skew_raw:d skew_log1p:d",
       """SELECT count(*) AS n_rows, avg(CASE WHEN flash_count = 0 THEN 1e0 ELSE 0e0 END) AS zero_share_all_rows,
       count(*) FILTER (WHERE coverage > 0) AS n_rows_observed,
       avg(CASE WHEN flash_count = 0 THEN 1e0 ELSE 0e0 END) FILTER (WHERE coverage > 0) AS zero_share_observed_rows,
       count(*) FILTER (WHERE flash_count > 0) AS n_nonzero, sum(flash_count) AS total_flashes, avg(flash_count) AS mean,
       var_samp(flash_count) AS variance, var_samp(flash_count) / avg(flash_count) AS var_over_mean,
       skewness(flash_count) AS skew_raw, skewness(ln(1 + flash_count)) AS skew_log1p FROM v_table""", [V_TABLE])
def target_report(t: Tables) -> DataFrame:
    return profile.target_summary(t.table)


@query("A10b_nonzero_target", "min:d p1:d p25:d p50:d p75:d p99:d max:d mean:d skew:d",
       f"""SELECT min(flash_count) AS min, max(flash_count) AS max, avg(flash_count) AS mean, skewness(flash_count) AS skew,
       {quantiles_sql('flash_count', profile.PROFILE_PROBS)} FROM v_table WHERE flash_count > 0""", [V_TABLE])
def nonzero_target(t: Tables) -> DataFrame:
    return profile.nonzero_summary(t.table)


@query("A10c_target_by_year", "year:l total:l zero_share:d",
       """SELECT year, sum(flash_count) AS total, avg(CASE WHEN flash_count = 0 THEN 1e0 ELSE 0e0 END) AS zero_share
       FROM v_table GROUP BY year""", [V_TABLE])
def target_by_year(t: Tables) -> DataFrame:
    return profile.target_by_year(t.table)


@query("A11_coverage_report", "row_weighted_mean:d min:d max:d p1:d p25:d median:d p75:d p99:d n_rows_zero_coverage:l "
                              "cell_month_weighted_mean:d n_cell_months:l n_months:l cell_months_zero_coverage:l",
       f"""SELECT r.*, m.* FROM (SELECT avg(coverage) AS row_weighted_mean, min(coverage) AS min, max(coverage) AS max,
       {quantiles_sql('coverage', {'p1': 0.01, 'p25': 0.25, 'median': 0.5, 'p75': 0.75, 'p99': 0.99})},
       count(*) FILTER (WHERE coverage = 0) AS n_rows_zero_coverage FROM v_table) r,
       (SELECT avg(c) AS cell_month_weighted_mean, count(*) AS n_cell_months, count(DISTINCT "month") AS n_months,
       count(*) FILTER (WHERE c = 0) AS cell_months_zero_coverage FROM (
       SELECT lat, lon, "month", min(coverage) AS c FROM v_table GROUP BY 1, 2, 3) g) m""", [V_TABLE])
def coverage_report(t: Tables) -> DataFrame:
    return profile.coverage_summary(t.table)


RANKED = ["T2M", "RH2M", "WS2M", "CAPE", "CIN", "CBH"]


def rho_sql(a: str, b: str) -> str:
    rank = lambda c: f'rank() OVER (ORDER BY "{c}") + (count(*) OVER (PARTITION BY "{c}") - 1) / 2e0'
    return (f"SELECT '{a}' AS a, '{b}' AS b, corr(ra, rb) AS rho FROM (SELECT {rank(a)} AS ra, {rank(b)} AS rb "
            f'FROM v_table WHERE "{a}" IS NOT NULL AND "{b}" IS NOT NULL) r')


PAIRS = [(a, b) for i, a in enumerate(RANKED) for b in RANKED[i + 1:]]


@query("A12_rank_correlation", "a:s b:s rho:d", union(rho_sql(a, b) for a, b in PAIRS), [V_TABLE])
def rank_correlation(t: Tables) -> DataFrame:
    return profile.rank_correlation(t.table, RANKED, ROW_KEY)


@query("T3_top_rank_pairs", "a:s b:s rho:d",
       union(rho_sql(a, b) for a, b in PAIRS) + " ORDER BY abs(rho) DESC, a, b LIMIT 5", [V_TABLE])
def top_rank_pairs(t: Tables) -> DataFrame:
    return profile.ranked_pairs(profile.rank_correlation(t.table, RANKED, ROW_KEY), 5)




@query("A14_null_rate_by_partner", "bin:l low:d high:d null_rate:d n_rows:l",
       """SELECT bin, list_extract(e, bin + 1) AS low, list_extract(e, bin + 2) AS high, avg(gone) AS null_rate, count(*) AS n_rows
       FROM (SELECT e, gone, greatest(0, len(list_filter(e, lambda x: x < v)) - 1) AS bin FROM (
       SELECT "CAPE" AS v, CASE WHEN "CIN" IS NULL THEN 1e0 ELSE 0e0 END AS gone FROM v_table WHERE "CAPE" > 0) p,
       (SELECT list_sort(list_distinct(quantile_cont("CAPE", [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e
       FROM v_table WHERE "CAPE" > 0) d) b GROUP BY bin, e""", [V_TABLE])
def null_rate_by_partner(t: Tables) -> DataFrame:
    return diagnose.null_rate_by_partner(t.table, "CIN", "CAPE")


@query("A14b_partner_split", "partner_zero_rows:l null_rate_where_partner_zero:d null_rate_where_partner_positive:d",
       """SELECT count(*) FILTER (WHERE "CAPE" <= 0) AS partner_zero_rows,
       avg(CASE WHEN "CIN" IS NULL THEN 1e0 ELSE 0e0 END) FILTER (WHERE "CAPE" <= 0) AS null_rate_where_partner_zero,
       avg(CASE WHEN "CIN" IS NULL THEN 1e0 ELSE 0e0 END) FILTER (WHERE "CAPE" > 0) AS null_rate_where_partner_positive
       FROM v_table""", [V_TABLE])
def partner_split(t: Tables) -> DataFrame:
    return diagnose.partner_split(t.table, "CIN", "CAPE")


@query("A15_residual", "n_rows:l share_of_all_rows:d share_of_nulls:d min:d p25:d p50:d p75:d p99:d max:d "
                       "partner_percentile_of_residual_max:d",
       """SELECT r.*, n_rows / CAST(n AS DOUBLE) AS share_of_all_rows, n_rows / CAST(n_null AS DOUBLE) AS share_of_nulls,
       (SELECT avg(CASE WHEN cloud_water < r.max THEN 1e0 ELSE 0e0 END) FROM v_table WHERE "CBH" IS NOT NULL) AS partner_percentile_of_residual_max
       FROM (SELECT count(*) AS n_rows, min(cloud_water) AS min, quantile_cont(cloud_water, 0.25) AS p25,
       quantile_cont(cloud_water, 0.5) AS p50, quantile_cont(cloud_water, 0.75) AS p75, quantile_cont(cloud_water, 0.99) AS p99,
       max(cloud_water) AS max FROM v_table WHERE "CBH" IS NULL AND cloud_water > 0) r,
       (SELECT count(*) AS n, count(*) - count("CBH") AS n_null FROM v_table) a""", [V_TABLE])
def residual(t: Tables) -> DataFrame:
    return diagnose.residual(t.table, "CBH", "cloud_water")


@query("A15b_residual_by_month", "month_of_year:l share:d",
       """SELECT month_of_year, avg(CASE WHEN "CIN" IS NULL AND "CAPE" > 0 THEN 1e0 ELSE 0e0 END) AS share
       FROM v_table GROUP BY 1""", [V_TABLE])
def residual_by_month(t: Tables) -> DataFrame:
    return diagnose.residual_by_month(t.table, "CIN", "CAPE")


@query("A16_missing_against_target", "block:s n_rows:l zero_share:d mean_flash:d total_flashes:l share_of_all_flashes:d",
       "SELECT *, total_flashes / (SELECT CAST(sum(flash_count) AS DOUBLE) FROM v_table) AS share_of_all_flashes FROM (" + union(
           f"""SELECT '{name}' AS block, count(*) AS n_rows, avg(CASE WHEN flash_count = 0 THEN 1e0 ELSE 0e0 END) AS zero_share,
           avg(flash_count) AS mean_flash, sum(flash_count) AS total_flashes FROM v_table WHERE {rule}"""
           for name, rule in (("null", '"CIN" IS NULL'), ("present", '"CIN" IS NOT NULL'),
                              ("residual", '"CIN" IS NULL AND "CAPE" > 0'), ("explained", '"CIN" IS NULL AND "CAPE" <= 0'))) + ") b",
       [V_TABLE])
def missing_against_target(t: Tables) -> DataFrame:
    return diagnose.missing_against_target(t.table, "CIN", "CAPE")


@query("A17_ceiling", "max:d n_at_max:l n_within_1pct_of_max:l",
       """SELECT max("CIN") AS max, count(*) FILTER (WHERE "CIN" = (SELECT max("CIN") FROM v_table)) AS n_at_max,
       count(*) FILTER (WHERE "CIN" >= 0.99e0 * (SELECT max("CIN") FROM v_table)) AS n_within_1pct_of_max FROM v_table""", [V_TABLE])
def ceiling(t: Tables) -> DataFrame:
    return diagnose.ceiling(t.table, "CIN")


@query("T2_top_values", "value:d n_rows:l",
       """SELECT "CIN" AS value, count(*) AS n_rows FROM v_table WHERE "CIN" IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 8""",
       [V_TABLE])
def top_values(t: Tables) -> DataFrame:
    return diagnose.top_values(t.table, "CIN")


@query("A18_zero_share_by_hour", "hour_of_day_local:l zero_share:d",
       """SELECT hour_of_day_local, avg(CASE WHEN flash_count = 0 THEN 1e0 ELSE 0e0 END) AS zero_share FROM v_table GROUP BY 1""",
       [V_TABLE])
def zero_share_by_hour(t: Tables) -> DataFrame:
    return diagnose.zero_share_by(t.table, "hour_of_day_local")


@query("A18b_zero_share_by_month", "month_of_year:l zero_share:d",
       """SELECT month_of_year, avg(CASE WHEN flash_count = 0 THEN 1e0 ELSE 0e0 END) AS zero_share FROM v_table GROUP BY 1""",
       [V_TABLE])
def zero_share_by_month(t: Tables) -> DataFrame:
    return diagnose.zero_share_by(t.table, "month_of_year")


@query("A19_count_shape", "mean:d variance:d observed_zero_share:d var_over_mean:d poisson_zero_share:d negbin_r:d "
                          "negbin_zero_share:d excess_over_negbin:d n_nonzero:l share_equal_to_1:d nonzero_p50:d nonzero_p90:d "
                          "nonzero_p99:d nonzero_max:l nonzero_mean:d nonzero_var_over_mean:d",
       """SELECT *, variance / mean AS var_over_mean, exp(-mean) AS poisson_zero_share,
       pow(negbin_r / (negbin_r + mean), negbin_r) AS negbin_zero_share,
       observed_zero_share - pow(negbin_r / (negbin_r + mean), negbin_r) AS excess_over_negbin FROM (
       SELECT *, mean * mean / (variance - mean) AS negbin_r FROM (SELECT avg(flash_count) AS mean, var_pop(flash_count) AS variance,
       avg(CASE WHEN flash_count = 0 THEN 1e0 ELSE 0e0 END) AS observed_zero_share FROM v_table) b) c,
       (SELECT count(*) AS n_nonzero, avg(CASE WHEN flash_count = 1 THEN 1e0 ELSE 0e0 END) AS share_equal_to_1,
       quantile_cont(flash_count, 0.5) AS nonzero_p50, quantile_cont(flash_count, 0.9) AS nonzero_p90,
       quantile_cont(flash_count, 0.99) AS nonzero_p99, max(flash_count) AS nonzero_max, avg(flash_count) AS nonzero_mean,
       var_pop(flash_count) / avg(flash_count) AS nonzero_var_over_mean FROM v_table WHERE flash_count > 0) n""", [V_TABLE])
def count_shape(t: Tables) -> DataFrame:
    return diagnose.count_shape(t.table)


def cycle_sql(keys: str, part: str, name: str) -> str:
    group = f"{keys}, {part}" if keys else part
    over = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""{name} AS (SELECT {lead}max(z) - min(z) AS amplitude, arg_max({part}, r * 1e6 - {part} * 1e-6) AS peak,
      arg_max({part}, z * 1e6 - {part} * 1e-6) AS trough FROM (SELECT {lead}{part},
      avg(CASE WHEN flash_count = 0 THEN 1e0 ELSE 0e0 END) AS z, avg(flash_count) AS r FROM v_table GROUP BY {group}) g {over})"""


BY_CELL = [V_TABLE, cycle_sql("lat, lon", "hour_of_day_local", "d"), cycle_sql("lat, lon", "month_of_year", "s"),
           """v_cell AS (SELECT lat, lon, total_flashes, d.amplitude AS diurnal_amplitude, s.amplitude AS seasonal_amplitude,
           d.peak AS peak_hour_local, d.trough AS trough_hour_local, s.peak AS peak_month FROM
           (SELECT lat, lon, sum(flash_count) AS total_flashes FROM v_table GROUP BY 1, 2 HAVING sum(flash_count) > 0) t
           JOIN d USING (lat, lon) JOIN s USING (lat, lon))"""]


@query("A20_temporal_by_cell", "lat:d lon:d total_flashes:l diurnal_amplitude:d seasonal_amplitude:d peak_hour_local:l "
                               "trough_hour_local:l peak_month:l", "SELECT * FROM v_cell", BY_CELL)
def temporal_by_cell(t: Tables) -> DataFrame:
    return diagnose.temporal_by_cell(t.table)


@query("A20b_temporal_pooled", "diurnal_amplitude:d seasonal_amplitude:d ratio:d peak_flash_hour_local:l peak_flash_month:l",
       """SELECT d.amplitude AS diurnal_amplitude, s.amplitude AS seasonal_amplitude, d.amplitude / s.amplitude AS ratio,
       d.peak AS peak_flash_hour_local, s.peak AS peak_flash_month FROM d, s""",
       [V_TABLE, cycle_sql("", "hour_of_day_local", "d"), cycle_sql("", "month_of_year", "s")])
def temporal_pooled(t: Tables) -> DataFrame:
    return diagnose.temporal_pooled(t.table)


@query("A20c_temporal_spread", "peak_hour_min:l peak_hour_max:l n_peak_hours:l ratio_min:d ratio_p50:d ratio_max:d "
                               "n_cells_diurnal_dominant:l n_cells:l",
       """SELECT min(peak_hour_local) AS peak_hour_min, max(peak_hour_local) AS peak_hour_max,
       count(DISTINCT peak_hour_local) AS n_peak_hours, min(r) AS ratio_min, quantile_cont(r, 0.5) AS ratio_p50, max(r) AS ratio_max,
       count(*) FILTER (WHERE r > 1) AS n_cells_diurnal_dominant, count(r) AS n_cells FROM (
       SELECT *, CASE WHEN seasonal_amplitude > 0 THEN diurnal_amplitude / seasonal_amplitude END AS r FROM v_cell) c""", BY_CELL)
def temporal_spread(t: Tables) -> DataFrame:
    return diagnose.temporal_spread(diagnose.temporal_by_cell(t.table))


@query("T4_busiest_cells", "lat:d lon:d total_flashes:l diurnal_amplitude:d",
       "SELECT * FROM v_cell ORDER BY total_flashes DESC, lat, lon LIMIT 12", BY_CELL)
def busiest_cells(t: Tables) -> DataFrame:
    return diagnose.busiest_cells(diagnose.temporal_by_cell(t.table))


ENCODED = ["CAPE", "RH2M", "T2M"]
DOMAINS = ["subtropis", "tropis"]


def encoding_sql(source: str, target: str, c: str) -> str:
    bounds = "0e0 AS lo, 100e0 AS hi, 0e0 AS ql, 100e0 AS qh" if c == "RH2M" else (
        f'min("{c}") AS lo, max("{c}") AS hi, quantile_cont("{c}", 0.01) AS ql, quantile_cont("{c}", 0.99) AS qh')
    maps = {"minmax": "CASE WHEN hi <= lo THEN 0e0 ELSE greatest(0e0, least(1e0, (v - lo) / (hi - lo))) END",
            "quantile": "CASE WHEN qh <= ql THEN 0e0 ELSE greatest(0e0, least(1e0, (v - ql) / (qh - ql))) END",
            "arctan": "atan((v - med) / iqr) / pi() + 0.5e0"}
    return union(f"""SELECT '{source}' AS source, '{target}' AS target, '{c}' AS "column", '{m}' AS map,
      quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS iqr_share,
      avg(CASE WHEN y <= 1e-12 OR y >= 1 - 1e-12 THEN 1e0 ELSE 0e0 END) AS pinned FROM (SELECT {e} AS y FROM
      (SELECT "{c}" AS v FROM v_table WHERE domain = '{target}') a, (SELECT {bounds}, quantile_cont("{c}", 0.5) AS med,
      quantile_cont("{c}", 0.75) - quantile_cont("{c}", 0.25) AS iqr FROM v_table WHERE domain = '{source}') f) y""" for m, e in maps.items())


ENCODING = union(encoding_sql(s, g, c) for s in DOMAINS for g in DOMAINS for c in ENCODED)


def domain_frames(t: Tables) -> dict[str, DataFrame]:
    return {d: t.table.filter(F.col("domain") == d) for d in DOMAINS}


@query("A21_encoding_resolution", "source:s target:s column:s map:s iqr_share:d pinned:d", ENCODING, [V_TABLE])
def encoding_resolution(t: Tables) -> DataFrame:
    return diagnose.encoding_resolution(domain_frames(t), ENCODED)


@query("A21b_resolution_means", "scope:s map:s mean_iqr_share:d",
       f"""SELECT CASE WHEN source = target THEN 'within' ELSE 'cross' END AS scope, map, avg(iqr_share) AS mean_iqr_share
       FROM ({ENCODING}) e GROUP BY 1, 2""", [V_TABLE])
def resolution_means(t: Tables) -> DataFrame:
    return diagnose.resolution_means(diagnose.encoding_resolution(domain_frames(t), ENCODED))


@query("A23_spread_of_runs", "stage:s scenario:s model:s mean:d std:d count:l",
       f"""SELECT stage, scenario, model, round(avg(rmse), 4) AS mean, round(stddev_samp(rmse), 4) AS std, count(rmse) AS "count"
       FROM ({RUN_ROWS}) r GROUP BY 1, 2, 3""", [V_SCORED])
def spread_of_runs(t: Tables) -> DataFrame:
    rows = run_records(t)
    return profile.spread_of_runs(rows.select("stage", "scenario", "model", "metrics.rmse"), "rmse")


TAILED = ["CAPE", "CIN", "T2M", "KX"]


@query("W3_tails", "column:s p001:d p50:d p999:d min:d max:d n_at_min:l n_at_max:l n_above_p999:l n_below_p001:l "
                   "max_detachment:d min_detachment:d",
       union(f"""SELECT '{c}' AS "column", p001, p50, p999, lo AS min, hi AS max,
       (SELECT count(*) FROM v_table WHERE "{c}" = lo) AS n_at_min, (SELECT count(*) FROM v_table WHERE "{c}" = hi) AS n_at_max,
       (SELECT count(*) FROM v_table WHERE "{c}" > p999) AS n_above_p999, (SELECT count(*) FROM v_table WHERE "{c}" < p001) AS n_below_p001,
       CASE WHEN p999 > p50 THEN (hi - p999) / (p999 - p50) END AS max_detachment,
       CASE WHEN p50 > p001 THEN (p001 - lo) / (p50 - p001) END AS min_detachment FROM (
       SELECT quantile_cont("{c}", 0.001) AS p001, quantile_cont("{c}", 0.5) AS p50, quantile_cont("{c}", 0.999) AS p999,
       min("{c}") AS lo, max("{c}") AS hi FROM v_table) q""" for c in TAILED), [V_TABLE])
def tails(t: Tables) -> DataFrame:
    return profile.tails(t.table, TAILED)


@query("W3b_extreme_values", "column:s end:s position:l value:d n:l",
       union(f"""SELECT * FROM (SELECT '{c}' AS "column", '{e}' AS "end", row_number() OVER (ORDER BY "{c}" {o}) AS position,
       "{c}" AS value, count(*) AS n FROM v_table WHERE "{c}" IS NOT NULL GROUP BY "{c}") x WHERE position <= 10"""
             for c in TAILED for e, o in (("lowest", "ASC"), ("highest", "DESC"))), [V_TABLE])
def extreme_values(t: Tables) -> DataFrame:
    return profile.extreme_values(t.table, TAILED)


@query("W3c_extreme_rows", "time:t lat:d lon:d CIN:d flash_count:l",
       """SELECT "time", lat, lon, "CIN", flash_count FROM v_table WHERE "CIN" IN (SELECT DISTINCT "CIN" FROM v_table
       WHERE "CIN" IS NOT NULL ORDER BY 1 DESC LIMIT 3) ORDER BY "CIN" DESC, "time", lat, lon, flash_count LIMIT 10""", [V_TABLE])
def extreme_rows(t: Tables) -> DataFrame:
    return profile.extreme_rows(t.table, "CIN")
