"""Point time series: GeoJSON in, long rows out, and the file inventory behind them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean
from ..model import POINT_PARAMETERS, Domain

# Native steps of the point source.
STEP_LAT, STEP_LON = 0.5, 0.625

FEATURE = ("STRUCT<geometry: STRUCT<coordinates: ARRAY<DOUBLE>>, "
           "properties: STRUCT<parameter: MAP<STRING, MAP<STRING, DOUBLE>>>>")
DOCUMENT = (f"STRUCT<type: STRING, features: ARRAY<{FEATURE}>, "
            + FEATURE.removeprefix("STRUCT<"))


def read_documents(spark: SparkSession, path: str | Sequence[str], pattern: str = "*.json",
                   lines: bool = False) -> DataFrame:
    """One row per file: path and whole text. With `lines` one row per line that is not blank, told apart by its digest.

    Files of lines hold any number of documents and are split between tasks.
    """
    if lines:
        kept = spark.read.option("pathGlobFilter", pattern).text(path).filter(F.trim("value") != "")
        return kept.select(F.concat_ws("#", F.col("_metadata.file_path"), F.sha2("value", 256)).alias("file"),
                           F.col("value").alias("text"))
    return (spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")))


def explode_series(documents: DataFrame) -> DataFrame:
    """file, lat, lon, time, parameter, value, freq of every dated value.

    A document is one Feature or a collection of them. Roll-up keys and keys of
    unknown length are left out; the fill value becomes null.
    """
    parsed = documents.select("file", F.from_json("text", DOCUMENT).alias("doc"))
    alone = F.struct(F.col("doc.geometry").alias("geometry"), F.col("doc.properties").alias("properties"))
    features = F.when(F.col("doc.features").isNotNull(), F.col("doc.features")).when(
        F.col("doc.type") == "Feature", F.array(alone))
    feature = parsed.select("file", F.explode(features).alias("f"))
    series = feature.select(
        "file", F.element_at("f.geometry.coordinates", 2).alias("lat"),
        F.element_at("f.geometry.coordinates", 1).alias("lon"),
        F.explode("f.properties.parameter").alias("parameter", "dated"))
    rows = series.select("file", "lat", "lon", "parameter", F.explode("dated").alias("key", "value"))
    return (rows.withColumn("freq", clean.key_frequency(F.col("key")))
            .filter(F.col("freq").isNotNull())
            .select("file", "lat", "lon", clean.key_period(F.col("key")).alias("time"), "parameter",
                    clean.sentinel_to_null(F.col("value")).alias("value"), "freq"))


def file_problems(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """Files that yield nothing, or mix key lengths."""
    seen = rows.groupBy("file").agg(F.count_distinct("freq").alias("freqs"))
    found = documents.select("file").distinct().join(seen, "file", "left")
    problem = F.when(F.col("freqs").isNull(), "no dated values").when(
        F.col("freqs") > 1, "mixed key lengths")
    return found.select("file", problem.alias("problem")).filter(F.col("problem").isNotNull())


def read_points(spark: SparkSession, path: str | Sequence[str], pattern: str = "*.json",
                lines: bool = False) -> DataFrame:
    documents = read_documents(spark, path, pattern, lines)
    rows = explode_series(documents)
    bad = file_problems(documents, rows).limit(5).collect()
    if bad:
        raise ValueError(f"unusable files: {[(r['file'], r['problem']) for r in bad]}")
    return rows.drop("file")


def coordinate_tag(value: Column) -> Column:
    """File-name form of a coordinate: sign letter, whole degrees, p, thousandths."""
    size = F.abs(value)
    whole = F.floor(size)
    thousandths = F.round((size - whole) * 1000).cast("int")
    return F.concat(F.when(value < 0, "m").otherwise("p"), F.lpad(whole.cast("string"), 3, "0"),
                    F.lit("p"), F.lpad(thousandths.cast("string"), 3, "0"))


def native_points(spark: SparkSession, domain: Domain) -> DataFrame:
    """Source points inside the snapped box."""
    la0, la1, lo0, lo1 = domain.snapped()
    axis = lambda lo, hi, step: F.sequence(F.ceil(F.lit(lo) / step), F.floor(F.lit(hi + 1e-9) / step))
    return (spark.range(1).select(F.explode(axis(la0, la1, STEP_LAT)).alias("i"))
            .select("i", F.explode(axis(lo0, lo1, STEP_LON)).alias("j"))
            .select((F.col("i") * F.lit(STEP_LAT)).alias("lat"),
                    (F.col("j") * F.lit(STEP_LON)).alias("lon")))


def expected_files(spark: SparkSession, domain: Domain) -> DataFrame:
    """Names a complete acquisition writes: one hourly file per point and year."""
    first, last = int(domain.first_month[:4]), int(domain.last_month[:4])
    years = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year")
    name = F.concat_ws("_", F.lit("power"), F.lit(domain.name), F.lit("hourly"),
                       coordinate_tag(F.col("lat")), coordinate_tag(F.col("lon")),
                       F.concat("year", F.lit("0101")), F.concat("year", F.lit("1231")))
    return native_points(spark, domain).select("lat", "lon", years).select(
        F.concat(name, F.lit(".json")).alias("name"))


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
            .select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
                    F.col("length").alias("size")))


def reconcile(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Names on one side only: name, status (missing or extra)."""
    missing = expected.select("name").distinct().join(found, "name", "left_anti")
    extra = found.select("name").distinct().join(expected, "name", "left_anti")
    return (missing.withColumn("status", F.lit("missing"))
            .unionByName(extra.withColumn("status", F.lit("extra"))))


def parameter_matrix(rows: DataFrame, parameters: Sequence[str] = POINT_PARAMETERS,
                     keys: Sequence[str] = ("lat", "lon", "time")) -> DataFrame:
    """Long to wide: the mean per parameter, keys without any value left out.

    One aggregation carries all parameters, where side-by-side joins would
    shuffle once per parameter.
    """
    present = rows.filter(F.col("value").isNotNull() & F.col("parameter").isin(*parameters))
    return present.groupBy(*keys).agg(*[
        F.avg(F.when(F.col("parameter") == p, F.col("value"))).alias(p) for p in parameters])
