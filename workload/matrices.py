"""Derived features, scalers and reductions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellhour.functions import encode
from cellhour.operators import features

from .adapters import V_TABLE, Tables
from .profiles import union
from .registry import query

ROW = "l_orderkey:l l_linenumber:l "
ROW_SQL = "l_orderkey, l_linenumber, "
HOUR = "2 * pi() * hour_of_day_local / 24e0"
DAY = "2 * pi() * day_of_year / 365.25e0"
ZENITH = """sin(radians(lat)) * sin(radians(23.44e0) * sin(2 * pi() * (day_of_year - 81) / 365.25e0))
  + cos(radians(lat)) * cos(radians(23.44e0) * sin(2 * pi() * (day_of_year - 81) / 365.25e0))
  * cos(radians(15e0 * (hour_of_day_local - 12)))"""
V_FEATURES = f"""v_features AS (SELECT *, sin({HOUR}) AS hour_sin, cos({HOUR}) AS hour_cos, sin({DAY}) AS doy_sin,
  cos({DAY}) AS doy_cos, {ZENITH} AS cos_sza, "T2M" - ("D2M" - 273.15e0) AS dewpoint_depression FROM v_table)"""


@query("F1_cyclic_encoding", ROW + "hour_sin:d hour_cos:d doy_sin:d doy_cos:d",
       f"SELECT {ROW_SQL} hour_sin, hour_cos, doy_sin, doy_cos FROM v_features", [V_TABLE, V_FEATURES])
def cyclic_encoding(t: Tables) -> DataFrame:
    return t.table.withColumns(encode.family("temporal"))


@query("F1b_hour_encodings", ROW + "raw:l hour_sin:d hour_cos:d n_none:l",
       f"SELECT {ROW_SQL} hour_of_day_local AS raw, hour_sin, hour_cos, 0 AS n_none FROM v_features", [V_TABLE, V_FEATURES])
def hour_encodings(t: Tables) -> DataFrame:
    both = t.table.withColumns({**encode.hour_encoding("raw"), **encode.hour_encoding("cyclic")})
    return both.withColumns({"raw": F.col("hour_of_day_local"), "n_none": F.lit(len(encode.hour_encoding("none")))})


@query("F3_solar_zenith", ROW + "cos_sza:d", f"SELECT {ROW_SQL} cos_sza FROM v_features", [V_TABLE, V_FEATURES])
def solar_zenith(t: Tables) -> DataFrame:
    cosine = encode.solar_zenith_cosine(F.col("day_of_year"), F.col("hour_of_day_local"), F.col("lat"))
    return t.table.withColumn("cos_sza", cosine)


@query("F4_cloud_water", ROW + "cloud_water:d", f'SELECT {ROW_SQL} "TCLW" + "TCIW" AS cloud_water FROM v_table', [V_TABLE])
def cloud_water(t: Tables) -> DataFrame:
    return t.table.drop("cloud_water").withColumns(encode.family("moisture"))


@query("F5_dewpoint_depression", ROW + "dewpoint_depression:d",
       f"SELECT {ROW_SQL} dewpoint_depression FROM v_features", [V_TABLE, V_FEATURES])
def dewpoint_depression(t: Tables) -> DataFrame:
    return t.table.withColumns(encode.family("moisture"))


ARM = ["PS", "PRECTOTCORR", "T2M", "RH2M", "WS2M", "CAPE", "KX", "TCIW", "TCLW", "D2M", "hour_sin", "hour_cos",
       "doy_sin", "doy_cos", "cos_sza", "dewpoint_depression", "cloud_water"]


@query("F6_candidate_matrix", ROW + " ".join(f"{c}:d" for c in ARM),
       f"SELECT {ROW_SQL} " + ", ".join(f'"{c}"' for c in ARM) + " FROM v_features", [V_TABLE, V_FEATURES])
def candidate_matrix(t: Tables) -> DataFrame:
    names = features.arm_features(t.table, "shared")
    return features.matrix(t.table, names, ["l_orderkey", "l_linenumber"])


@query("F7_named_matrix", "cos_sza:d CAPE:d hour_sin:d T2M:d", 'SELECT cos_sza, "CAPE", hour_sin, "T2M" FROM v_features',
       [V_TABLE, V_FEATURES])
def named_matrix(t: Tables) -> DataFrame:
    return features.matrix(t.table, ["cos_sza", "CAPE", "hour_sin", "T2M"])


ANGLES = ["T2M", "KX", "RH2M", "hour_sin", "WS2M"]
BOUNDS = {"RH2M": (0, 100), "hour_sin": (-1, 1)}
PARAMS = "v_params AS (" + union(
    f"SELECT '{c}' AS name, 'bound' AS kind, {BOUNDS[c][0]}e0 AS low, {BOUNDS[c][1]}e0 AS high, NULL AS centre, NULL AS spread"
    if c in BOUNDS else
    f"""SELECT '{c}' AS name, 'arctan' AS kind, NULL AS low, NULL AS high, quantile_cont("{c}", 0.5) AS centre,
    quantile_cont("{c}", 0.75) - quantile_cont("{c}", 0.25) AS spread FROM v_features WHERE year <> 2001""" for c in ANGLES) + ")"
ANGLE_ROWS = f"v_angles AS (SELECT {ROW_SQL} year, " + ", ".join(
    f'greatest(0e0, least(1e0, ("{c}" - {BOUNDS[c][0]}) / {BOUNDS[c][1] - BOUNDS[c][0]}e0)) * pi() AS "{c}"' if c in BOUNDS else
    f"""(atan(("{c}" - (SELECT centre FROM v_params WHERE name = '{c}')) / (SELECT spread FROM v_params WHERE name = '{c}'))
    / pi() + 0.5e0) * pi() AS "{c}" """ for c in ANGLES) + " FROM v_features)"


def scaler(t: Tables) -> features.AngleScaler:
    return features.AngleScaler.fit(features.matrix(t.table.filter("year <> 2001"), ANGLES), ANGLES)


@query("F9_scaler_fit", "name:s kind:s low:d high:d centre:d spread:d", "SELECT * FROM v_params", [V_TABLE, V_FEATURES, PARAMS])
def scaler_fit(t: Tables) -> DataFrame:
    return scaler(t).table(t.table)


@query("F10_scaler_apply", ROW + " ".join(f"{c}:d" for c in ANGLES), "SELECT * FROM v_angles",
       [V_TABLE, V_FEATURES, PARAMS, ANGLE_ROWS])
def scaler_apply(t: Tables) -> DataFrame:
    keep = ["l_orderkey", "l_linenumber"]
    return scaler(t).apply(features.matrix(t.table, ANGLES, keep), keep)


REPORT = "v_report AS (" + union(
    f"""SELECT '{c}' AS name, '{'bound' if c in BOUNDS else 'arctan'}' AS kind,
    (quantile_cont("{c}", 0.75) - quantile_cont("{c}", 0.25)) / pi() AS iqr_share, min("{c}") AS angle_min, max("{c}") AS angle_max
    FROM v_angles WHERE year <> 2001""" for c in ANGLES) + ")"


@query("F12_scaling_report", "name:s kind:s iqr_share:d angle_min:d angle_max:d", "SELECT * FROM v_report",
       [V_TABLE, V_FEATURES, PARAMS, ANGLE_ROWS, REPORT])
def scaling_report(t: Tables) -> DataFrame:
    return features.scaling_report(features.matrix(t.table.filter("year <> 2001"), ANGLES), scaler(t))


@query("F12b_class_spread", "bound_mean:d fitted_mean:d n_bound:l n_fitted:l ratio:d",
       """SELECT *, bound_mean / fitted_mean AS ratio FROM (SELECT avg(iqr_share) FILTER (WHERE kind = 'bound') AS bound_mean,
       avg(iqr_share) FILTER (WHERE kind = 'arctan') AS fitted_mean, count(*) FILTER (WHERE kind = 'bound') AS n_bound,
       count(*) FILTER (WHERE kind = 'arctan') AS n_fitted FROM v_report) r""",
       [V_TABLE, V_FEATURES, PARAMS, ANGLE_ROWS, REPORT])
def class_spread(t: Tables) -> DataFrame:
    return features.class_spread(scaling_report(t))


RANGED = ["T2M", "CAPE", "FLAT"]


@query("F13_range_scaler", ROW + " ".join(f"{c}:d" for c in RANGED),
       f"SELECT {ROW_SQL} " + ", ".join(
           f"""greatest(0e0, least(1e0, ("{c}" - lo_{c}) / (hi_{c} - lo_{c}))) * pi() AS "{c}" """ for c in RANGED[:2])
       + """, 0e0 AS "FLAT" FROM v_table, (SELECT min("T2M") AS "lo_T2M", max("T2M") AS "hi_T2M", min("CAPE") AS "lo_CAPE",
       max("CAPE") AS "hi_CAPE" FROM v_table WHERE year < 1997 AND l_quantity < 40) f""", [V_TABLE])
def range_scaler(t: Tables) -> DataFrame:
    flat = t.table.withColumn("FLAT", F.lit(3.0))
    fitted = features.fit_range(flat.filter("year < 1997 AND l_quantity < 40"), RANGED)
    return fitted.apply(flat, ["l_orderkey", "l_linenumber"])


@query("F14_components", "component:l explained:d loading_1:d loading_2:d",
       """SELECT 1 AS component, (1 + abs(r)) / 2 AS explained, sqrt(0.5e0) AS loading_1, sqrt(0.5e0) AS loading_2 FROM (
       SELECT corr("T2M", "D2M") AS r FROM v_table WHERE year <> 2001) c UNION ALL
       SELECT 2, (1 - abs(r)) / 2, sqrt(0.5e0), sqrt(0.5e0) FROM (
       SELECT corr("T2M", "D2M") AS r FROM v_table WHERE year <> 2001) c""", [V_TABLE])
def components(t: Tables) -> DataFrame:
    """Two standardised columns have known components up to sign, which is left out here."""
    found = features.principal_components(t.table.filter("year <> 2001"), ["T2M", "D2M"], 2)
    rows = [(i + 1, found["explained"][i], abs(found["components"][i][0]), abs(found["components"][i][1]))
            for i in range(2)]
    return t.spark.createDataFrame(rows, "component INT, explained DOUBLE, loading_1 DOUBLE, loading_2 DOUBLE")


@query("F14b_reduced_matrix", ROW + "pc1:d pc2:d pc3:d")
def reduced_matrix(t: Tables) -> DataFrame:
    names = ["T2M", "D2M", "CAPE", "KX", "RH2M", "WS2M"]
    fitted = features.fit_range(t.table.filter("year <> 2001"), names, "pca3")
    return fitted.apply(t.table, ["l_orderkey", "l_linenumber"])


@query("F14c_embedding_components", "label:l n:l pc1:d pc2:d")
def embedding_components(t: Tables) -> DataFrame:
    """Sixty-four wide rows: the products come from matrix blocks inside the tasks."""
    wide = t.read("embeddings")
    names = [f"e{i}" for i in range(64)]
    matrix = wide.select("label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    fitted = features.fit_range(matrix, names, "pca2")
    return fitted.apply(matrix, ["label"]).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("pc1").alias("pc1"), F.avg("pc2").alias("pc2"))


@query("F15_target_transforms", ROW + "occurrence:d log1p:d anscombe:d plain:d back_log1p:d back_anscombe:d",
       f"""SELECT {ROW_SQL} CASE WHEN flash_count > 0 THEN 1e0 ELSE 0e0 END AS occurrence, ln(1e0 + flash_count) AS log1p,
       2 * sqrt(flash_count + 0.375e0) AS anscombe, flash_count AS plain, flash_count AS back_log1p,
       flash_count AS back_anscombe FROM v_table""", [V_TABLE])
def target_transforms(t: Tables) -> DataFrame:
    c = F.col("flash_count")
    out = t.table.withColumns({
        "occurrence": encode.stage_target(c, "occurrence"), "log1p": encode.stage_target(c, "count"),
        "anscombe": encode.stage_target(c, "count", "anscombe"), "plain": encode.stage_target(c, "count", "none")})
    return out.withColumns({"back_log1p": encode.inverse(F.col("log1p")),
                            "back_anscombe": encode.inverse(F.col("anscombe"), "anscombe")})


@query("F16_target_standardisation", ROW + "y:d back:d",
       f"""SELECT {ROW_SQL} (ln(1e0 + flash_count) - m) / s AS y, ln(1e0 + flash_count) AS back FROM v_table, (
       SELECT avg(ln(1e0 + flash_count)) AS m, stddev_pop(ln(1e0 + flash_count)) AS s FROM v_table
       WHERE flash_count > 0 AND year <> 2001) f WHERE flash_count > 0""", [V_TABLE])
def target_standardisation(t: Tables) -> DataFrame:
    rows = t.table.filter("flash_count > 0")
    fitted = features.fit_range(rows.filter("year <> 2001"), ["T2M"], target=F.log1p(F.col("flash_count").cast("double")))
    scaled = rows.withColumn("y", fitted.scale_target(F.log1p(F.col("flash_count").cast("double"))))
    return scaled.withColumn("back", F.col("y") * fitted.target_sd + fitted.target_mean)
