"""Models and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellhour.functions import encode
from cellhour.operators import evaluate, models

from .adapters import ROW_KEY, V_SCORED, V_TABLE, Tables
from .registry import query
from .solving import linear, logistic_ctes, standard

ROW = "l_orderkey:l l_linenumber:l "
ROW_SQL = "l_orderkey, l_linenumber, "


def train(t: Tables) -> DataFrame:
    return t.table.filter("year <> 2001")


def test(t: Tables) -> DataFrame:
    return t.table.filter("year = 2001")


@query("M1_base_rate", ROW + "predicted:d",
       f"""SELECT {ROW_SQL} (SELECT avg(CASE WHEN flash_count > 0 THEN 1e0 ELSE 0e0 END) FROM v_table WHERE year <> 2001) AS predicted
       FROM v_table WHERE year = 2001""", [V_TABLE])
def base_rate(t: Tables) -> DataFrame:
    fitted = models.base_rate(train(t).withColumn("y", encode.stage_target(F.col("flash_count"), "occurrence")), "y")
    return models.predict(test(t), fitted, "occurrence")


# Two-feature ridge by Cramer's rule on centred sums.
RIDGE = """v_fit AS (SELECT w1, w2, my - w1 * m1 - w2 * m2 AS w0 FROM (SELECT *, (c1 * g22 - c2 * g12) / (g11 * g22 - g12 * g12) AS w1,
  (c2 * g11 - c1 * g12) / (g11 * g22 - g12 * g12) AS w2 FROM (SELECT count(*) * var_pop(x1) + 1 AS g11, count(*) * var_pop(x2) + 1 AS g22,
  count(*) * covar_pop(x1, x2) AS g12, count(*) * covar_pop(x1, y) AS c1, count(*) * covar_pop(x2, y) AS c2, avg(x1) AS m1, avg(x2) AS m2,
  avg(y) AS my FROM v_xy) s) w)"""
XY = """v_xy AS (SELECT "T2M" AS x1, "CAPE" AS x2, ln(1e0 + flash_count) AS y FROM v_table WHERE year <> 2001)"""


@query("M2_ridge", "name:s weight:d",
       "SELECT 'T2M' AS name, w1 AS weight FROM v_fit UNION ALL SELECT 'CAPE', w2 FROM v_fit UNION ALL SELECT 'intercept', w0 FROM v_fit",
       [V_TABLE, XY, RIDGE])
def ridge(t: Tables) -> DataFrame:
    rows = train(t).withColumn("y", F.log1p(F.col("flash_count").cast("double")))
    fitted = models.ridge(rows, ["T2M", "CAPE"], "y")
    return t.spark.createDataFrame([*zip(fitted.names, fitted.weights), ("intercept", fitted.intercept)],
                                   "name STRING, weight DOUBLE")


LOGISTIC = ["T2M", "RH2M", "CAPE"]
V_ALL = "v_derived AS (SELECT * FROM v_table)"


@query("M3_logistic", ROW + "predicted:d",
       f"SELECT {ROW_SQL} 1e0 / (1e0 + exp(-({linear(LOGISTIC)}))) AS predicted FROM v_z_test, v_logit",
       [V_TABLE, V_ALL, *standard("v_z", LOGISTIC), *logistic_ctes("v_logit", "v_z_train", LOGISTIC, "hit")])
def logistic(t: Tables) -> DataFrame:
    scale = models.standardiser(train(t), LOGISTIC)
    rows = models.standardised(train(t), scale).withColumn("y", (F.col("flash_count") > 0).cast("int"))
    fitted = models.logistic(rows, LOGISTIC, "y")
    return models.predict(models.standardised(test(t), scale), fitted, "occurrence")


@query("M4_batch_scoring", ROW + "predicted:d",
       f"""SELECT {ROW_SQL} greatest(0e0, least(1e0, "T2M" * 2e-2 - "RH2M" * 1e-2 + 5e-2)) AS predicted FROM v_table WHERE year = 2001""",
       [V_TABLE])
def batch_scoring(t: Tables) -> DataFrame:
    """A model given as a Python function, applied batch by batch inside the tasks."""
    rows = test(t).select("l_orderkey", "l_linenumber", "T2M", "RH2M")
    return models.predict_foreign(rows, ["T2M", "RH2M"], lambda x: x[:, 0] * 2e-2 - x[:, 1] * 1e-2 + 5e-2, "occurrence")


@query("M4b_expression_scoring", ROW + "predicted:d",
       f"""SELECT {ROW_SQL} greatest(0e0, least(1e0, "T2M" * w1 + "CAPE" * w2 + w0)) AS predicted FROM v_table, v_fit
       WHERE year = 2001""", [V_TABLE, XY, RIDGE])
def expression_scoring(t: Tables) -> DataFrame:
    rows = train(t).withColumn("y", F.log1p(F.col("flash_count").cast("double")))
    return models.predict(test(t), models.ridge(rows, ["T2M", "CAPE"], "y"), "occurrence")


@query("M5_hurdle", ROW + "predicted:d", f"SELECT {ROW_SQL} p * predicted AS predicted FROM v_scored", [V_SCORED])
def hurdle(t: Tables) -> DataFrame:
    first = t.scored.select(*ROW_KEY, "time", F.col("p").alias("p_occurrence"))
    second = t.scored.select(*ROW_KEY, "time", F.col("predicted").alias("count_given_occurrence"))
    return models.hurdle(first, second, [*ROW_KEY, "time"])


CURVE = """v_curve AS (SELECT p, sum(flashed) AS hit, count(*) AS n, sum(sum(flashed)) OVER (ORDER BY p DESC) AS tp,
  sum(count(*)) OVER (ORDER BY p DESC) AS called, sum(sum(flashed)) OVER () AS hits, sum(count(*)) OVER () AS total
  FROM v_scored GROUP BY p)"""
AP = "(SELECT sum(hit / CAST(hits AS DOUBLE) * tp / called) FROM v_curve)"
AUC = """(SELECT sum(hit * ((total - called) - (hits - tp) + (n - hit) / 2e0)) / max(CAST(hits AS DOUBLE) * (total - hits)) FROM v_curve)"""


@query("M6_average_precision", "average_precision:d", f"SELECT {AP} AS average_precision", [V_SCORED, CURVE])
def average_precision(t: Tables) -> DataFrame:
    return evaluate.ranking_scores(evaluate.ranking_curve(t.scored, "flashed", "p"))


@query("M7_roc_auc", "roc_auc:d",
       """SELECT (sum(r) FILTER (WHERE flashed = 1) - n1 * (n1 + 1) / 2e0) / (n1 * n0) AS roc_auc FROM (
       SELECT flashed, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0 AS r FROM v_scored) x,
       (SELECT CAST(sum(flashed) AS DOUBLE) AS n1, CAST(count(*) - sum(flashed) AS DOUBLE) AS n0 FROM v_scored) c GROUP BY n1, n0""",
       [V_SCORED])
def roc_auc(t: Tables) -> DataFrame:
    return evaluate.ranking_scores(evaluate.ranking_curve(t.scored, "flashed", "p", slice_rows=20_000))


@query("M7b_ranking_by_year", "year:l average_precision:d roc_auc:d",
       """SELECT year, sum(hit / CAST(hits AS DOUBLE) * tp / called) AS average_precision,
       sum(hit * ((total - called) - (hits - tp) + (n - hit) / 2e0)) / max(CAST(hits AS DOUBLE) * (total - hits)) AS roc_auc FROM (
       SELECT year, p, sum(flashed) AS hit, count(*) AS n, sum(sum(flashed)) OVER (PARTITION BY year ORDER BY p DESC) AS tp,
       sum(count(*)) OVER (PARTITION BY year ORDER BY p DESC) AS called, sum(sum(flashed)) OVER (PARTITION BY year) AS hits,
       sum(count(*)) OVER (PARTITION BY year) AS total FROM v_scored GROUP BY year, p) c GROUP BY year""", [V_SCORED])
def ranking_by_year(t: Tables) -> DataFrame:
    return evaluate.ranking_scores(evaluate.ranking_curve(t.scored, "flashed", "p", ["year"]), ["year"])


@query("M8_r_squared", "r2:d n:l",
       """SELECT 1 - sum((observed - predicted) ** 2) / sum((observed - m) ** 2) AS r2, count(*) AS n FROM v_scored,
       (SELECT avg(observed) AS m FROM v_scored WHERE observed > 0) a WHERE observed > 0""", [V_SCORED])
def r_squared(t: Tables) -> DataFrame:
    return evaluate.r_squared(t.scored.filter("observed > 0"), "observed", "predicted")


@query("M9_classification", "log_loss:d brier:d threshold:d base_rate:d n:l auc:d avg_precision:d f1:d baseline_log_loss:d skill_score:d",
       f"""SELECT log_loss, brier, b AS threshold, b AS base_rate, n, {AUC} AS auc, {AP} AS avg_precision,
       2e0 * tp / (called + hits) AS f1, floor_loss AS baseline_log_loss, 1 - log_loss / floor_loss AS skill_score FROM (
       SELECT avg(-(flashed * ln(q) + (1 - flashed) * ln(1 - q))) AS log_loss, avg((q - flashed) ** 2) AS brier, count(*) AS n,
       max(b) AS b, -(max(b) * ln(max(b)) + (1 - max(b)) * ln(1 - max(b))) AS floor_loss,
       count(*) FILTER (WHERE q >= b AND flashed = 1) AS tp, count(*) FILTER (WHERE q >= b) AS called, sum(flashed) AS hits
       FROM (SELECT flashed, greatest(1e-9, least(1 - 1e-9, p)) AS q FROM v_scored) s,
       (SELECT avg(flashed) AS b FROM v_scored) r) m""", [V_SCORED, CURVE])
def classification(t: Tables) -> DataFrame:
    return evaluate.classification(t.scored, "flashed", "p")


REGRESSION = "rmse:d mae:d r2:d nrmse:d bias:d mean_observed:d mean_predicted:d n:l baseline_rmse:d skill_score:d"


def regression_sql(o: str, p: str) -> str:
    rmse = f"sqrt(avg(({p} - {o}) ** 2))"
    return (f"{rmse} AS rmse, avg(abs({p} - {o})) AS mae, 1 - sum(({p} - {o}) ** 2) / (count(*) * var_pop({o})) AS r2, "
            f"{rmse} / (max({o}) - min({o})) AS nrmse, avg({p} - {o}) AS bias, avg({o}) AS mean_observed, "
            f"avg({p}) AS mean_predicted, count(*) AS n, stddev_pop({o}) AS baseline_rmse, 1 - {rmse} / stddev_pop({o}) AS skill_score")


@query("M10_regression", "year:l " + REGRESSION,
       f"SELECT year, {regression_sql('observed', 'predicted')} FROM v_scored GROUP BY year", [V_SCORED])
def regression(t: Tables) -> DataFrame:
    return evaluate.regression(t.scored, "observed", "predicted", ["year"])


@query("M11_back_to_counts", ROW + "counts:d",
       f"SELECT {ROW_SQL} greatest(0e0, exp((p - 0.4e0) * 1.5e0 + 0.2e0) - 1) AS counts FROM v_scored", [V_SCORED])
def back_to_counts(t: Tables) -> DataFrame:
    return t.scored.withColumn("counts", encode.to_counts(F.col("p") - 0.4, mean=0.2, sd=1.5))


@query("M12_smearing_factor", "factor:d degenerate:d",
       """SELECT avg(observed) / avg(predicted) AS factor, 1e0 AS degenerate FROM v_scored WHERE year = 2000""", [V_SCORED])
def smearing_factor(t: Tables) -> DataFrame:
    held = t.scored.filter("year = 2000")
    flat = evaluate.smearing_factor(held.withColumn("predicted", F.lit(0.0))).withColumnRenamed("factor", "degenerate")
    return evaluate.smearing_factor(held).join(F.broadcast(flat), F.lit(True))


WINDOWS = """v_windows AS (SELECT h AS window_h, lat, lon, time_bucket(to_hours(h), "time", TIMESTAMP '1970-01-01') AS "window",
  sum(predicted) AS predicted, sum(observed) AS observed, min(area_km2) AS area_km2, count(*) AS n_hours
  FROM v_scored, (VALUES (1), (3), (6), (24)) w(h) GROUP BY 1, 2, 3, 4)"""


@query("M13_reporting_windows", "window_h:l lat:d lon:d window:t predicted:d observed:d area_km2:d n_hours:l",
       "SELECT * FROM v_windows", [V_SCORED, WINDOWS])
def reporting_windows(t: Tables) -> DataFrame:
    return evaluate.windows(t.scored)


@query("M14_window_density", "window_h:l lat:d lon:d window:t gfd:d",
       """SELECT window_h, lat, lon, "window", observed / area_km2 / (n_hours / 8766e0) AS gfd FROM v_windows WHERE window_h = 6""",
       [V_SCORED, WINDOWS])
def window_density(t: Tables) -> DataFrame:
    rows = evaluate.windows(t.scored, [6])
    return rows.withColumn("gfd", evaluate.window_density(F.col("observed"), F.col("area_km2"), F.col("n_hours")))


CALIBRATION = "cal_mean_observed:d cal_mean_predicted:d cal_ratio:d cal_zero_share_observed:d cal_n_windows:l"
CALIBRATION_SQL = """avg(observed) AS cal_mean_observed, avg(predicted) AS cal_mean_predicted, avg(predicted) / avg(observed) AS cal_ratio,
  avg(CASE WHEN observed = 0 THEN 1e0 ELSE 0e0 END) AS cal_zero_share_observed, count(*) AS cal_n_windows"""


@query("M15_calibration", "window_h:l " + CALIBRATION,
       f"SELECT window_h, {CALIBRATION_SQL} FROM v_windows GROUP BY window_h", [V_SCORED, WINDOWS])
def calibration(t: Tables) -> DataFrame:
    return evaluate.calibration(evaluate.windows(t.scored))


@query("M16_window_curve", f"window_h:l {REGRESSION} {CALIBRATION}",
       f"""SELECT window_h, {regression_sql('gfd_o', 'gfd_p')}, {CALIBRATION_SQL} FROM (SELECT *,
       observed / area_km2 / (n_hours / 8766e0) AS gfd_o, predicted / area_km2 / (n_hours / 8766e0) AS gfd_p FROM v_windows) w
       GROUP BY window_h""", [V_SCORED, WINDOWS])
def window_curve(t: Tables) -> DataFrame:
    return evaluate.window_curve(t.scored)
