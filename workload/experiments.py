"""Ablation, width sweep, scenarios and the experiment grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellhour.plans import ablate, experiment
from cellhour.session import scratch
from cellhour.sources import records

from .adapters import ROW_KEY, TABLE_FOLDS, V_TABLE, Tables
from .registry import query
from .scoring import RIDGE, test, train
from .solving import ablation_ctes, area_of, linear, logistic_ctes, precision_of, standard

OCCURRENCE = ["T2M", "RH2M", "CAPE"]
COUNT = ["T2M", "RH2M", "CAPE", "KX"]
ARMS = {"full": ["T2M", "RH2M", "WS2M", "CAPE", "hour_sin"], "meteorology": ["T2M", "RH2M", "WS2M", "CAPE"]}
SCORES = "arm:s stage:s dropped:s score:d delta:d"

# Standardised on all training rows; fitted and scored on flashing rows.
STANDARD = """v_scale AS (SELECT avg("T2M") AS m1, stddev_pop("T2M") AS s1, avg("RH2M") AS m2, stddev_pop("RH2M") AS s2
  FROM v_table WHERE year <> 2001),
v_z AS (SELECT year, ("T2M" - m1) / s1 AS x1, ("RH2M" - m2) / s2 AS x2, ln(1e0 + flash_count) AS y FROM v_table, v_scale WHERE flash_count > 0),
v_xy AS (SELECT * FROM v_z WHERE year <> 2001)"""


@query("K10_fit_score_count", "r2:d n:l",
       """SELECT 1 - sum((y - (x1 * w1 + x2 * w2 + w0)) ** 2) / (count(*) * var_pop(y)) AS r2, count(*) AS n
       FROM v_z, v_fit WHERE year = 2001""", [V_TABLE, STANDARD, RIDGE])
def fit_score_count(t: Tables) -> DataFrame:
    score = ablate.fit_score(train(t), test(t), ["T2M", "RH2M"], "count")
    n = test(t).filter("flash_count > 0").count()
    return t.spark.createDataFrame([(score["r2"], n)], "r2 DOUBLE, n BIGINT")


V_ALL = "v_derived AS (SELECT * FROM v_table)"
LOGIT = [V_TABLE, V_ALL, *standard("v_zo", OCCURRENCE), *logistic_ctes("v_logit", "v_zo_train", OCCURRENCE, "hit"),
         f"v_scored_zo AS (SELECT hit, 1e0 / (1e0 + exp(-({linear(OCCURRENCE)}))) AS p FROM v_zo_test, v_logit)"]


@query("K10b_fit_score_occurrence", "pr_auc:d roc_auc:d",
       f"SELECT ({precision_of('SELECT * FROM v_scored_zo')}) AS pr_auc, ({area_of('SELECT * FROM v_scored_zo')}) AS roc_auc", LOGIT)
def fit_score_occurrence(t: Tables) -> DataFrame:
    score = ablate.fit_score(train(t), test(t), OCCURRENCE, "occurrence")
    return t.spark.createDataFrame([(score["pr_auc"], score["roc_auc"])], "pr_auc DOUBLE, roc_auc DOUBLE")


def ablations(t: Tables) -> DataFrame:
    found = {("full", "occurrence"): ablate.ablate(train(t), test(t), OCCURRENCE, "occurrence", ROW_KEY),
             ("full", "count"): ablate.ablate(train(t), test(t), COUNT, "count", ROW_KEY)}
    return ablate.ablation_table(t.table, found)


ABLATED = [*ablation_ctes("v_o", "occurrence", OCCURRENCE, "v_ablated_occurrence"), *ablation_ctes("v_c", "count", COUNT, "v_ablated_count")]
DELTA = "CASE WHEN dropped IS NOT NULL THEN (SELECT score FROM {0} WHERE dropped IS NULL) - score END AS delta"


@query("K11_leave_one_out", SCORES, " UNION ALL ".join(
    f"SELECT 'full' AS arm, '{stage}' AS stage, dropped, score, {DELTA.format(f'v_ablated_{stage}')} FROM v_ablated_{stage}"
    for stage in ("occurrence", "count")), [V_TABLE, V_ALL, *ABLATED])
def leave_one_out(t: Tables) -> DataFrame:
    return ablations(t)


@query("T6_ablation_order", "dropped:s delta:d",
       f"SELECT dropped, {DELTA.format('v_ablated_count')} FROM v_ablated_count WHERE dropped IS NOT NULL",
       [V_TABLE, V_ALL, *ablation_ctes("v_c", "count", COUNT, "v_ablated_count")])
def ablation_order(t: Tables) -> DataFrame:
    """All features by what their removal costs the count model."""
    found = ablate.ablate(train(t), test(t), COUNT, "count", ROW_KEY)
    table = ablate.ablation_table(t.table, {("full", "count"): found})
    return table.filter("dropped IS NOT NULL").orderBy(F.desc("delta"), "dropped")


def widths(t: Tables, **options) -> DataFrame:
    """Both arms over every candidate the contract names, at all widths of the sweep."""
    return ablate.run_widths(train(t), test(t), key=ROW_KEY, seeds=0, **options)


@query("K12_climatology_gap", "width:l stage:s full:d meteorology:d gap:d meteorology_share:d")
def climatology_gap(t: Tables) -> DataFrame:
    return ablate.climatology_gap(widths(t, leave_one_out=False))


@query("K13_width_sweep", "width:l " + SCORES)
def width_sweep(t: Tables) -> DataFrame:
    return widths(t)


@query("K14_complete_case", "stage:s without:d with:d cost_of_dropping:d delta_cin:d delta_cbh:d")
def complete_case(t: Tables) -> DataFrame:
    found = ablate.complete_case(train(t), test(t), 3, ROW_KEY, names=ARMS["full"])
    return found.withColumns({"delta_cin": F.col("deltas")["CIN"], "delta_cbh": F.col("deltas")["CBH"]})


SETTINGS = experiment.Settings(features=("T2M", "CAPE", "RH2M", "KX"))
RUN = "scenario:s stage:s model:s fold:s seed:l train_rows:l n_params:l "


def frames(t: Tables) -> dict[str, DataFrame]:
    return {d: t.table.filter(F.col("domain") == d) for d in ("tropis", "subtropis")}


@query("M17_scenario_evaluation", RUN + "window_h:l n:l rmse:d r2:d cal_ratio:d")
def scenario_evaluation(t: Tables) -> DataFrame:
    """One fit on a domain, scored at home and abroad through its own scaler and smearing factor."""
    tables = frames(t)
    fitted = experiment.fit(tables["tropis"], "tropis", TABLE_FOLDS[2], "fold2", "count", 0, SETTINGS, key=ROW_KEY)
    home = experiment.score(fitted, fitted.prepared.test, "tropis_in")
    abroad = experiment.score(fitted, experiment.target_rows(tables["subtropis"], TABLE_FOLDS[2], fitted, ROW_KEY), "tropis_to_sub")
    both = home.unionByName(abroad)
    curve = records.window_curves(both)
    runs = both.select("scenario", "stage", "model", "fold", "seed", "train_rows", "n_params")
    return curve.join(runs, ["scenario", "stage", "model", "fold", "seed"])


@query("M18_experiment_grid", RUN + "log_loss:d avg_precision:d rmse:d r2:d smearing_factor:d")
def experiment_grid(t: Tables) -> DataFrame:
    """Both stages, domains and all folds; one seed, for without sampling all seeds give the same."""
    path = scratch(t.spark, "grid")
    runs = experiment.run_grid(frames(t), SETTINGS, path, TABLE_FOLDS, seeds=(0,), key=ROW_KEY)
    return records.flatten(runs)


@query("M18b_one_factor_sweep", RUN + "encoding:s log_loss:d avg_precision:d")
def one_factor_sweep(t: Tables) -> DataFrame:
    path = scratch(t.spark, "sweep")
    runs = experiment.run_sweep(t.table, "hour_encoding", ("none", "raw", "cyclic"), SETTINGS, path, TABLE_FOLDS[2], key=ROW_KEY)
    metrics = [F.col(f"metrics.{m}").alias(m) for m in ("log_loss", "avg_precision")]
    return runs.select("scenario", "stage", "model", "fold", "seed", "train_rows", "n_params",
                       F.col("config")["hour_encoding"].alias("encoding"), *metrics)


@query("M18c_reduction_sweep", "reduction:s model:s n_params:l log_loss:d")
def reduction_sweep(t: Tables) -> DataFrame:
    path = scratch(t.spark, "sweep")
    runs = experiment.run_sweep(t.table, "reduction", (None, "pca3"), SETTINGS, path, TABLE_FOLDS[2], key=ROW_KEY)
    return runs.select(F.col("config")["reduction"].alias("reduction"), "model", "n_params",
                       F.col("metrics.log_loss").alias("log_loss"))
