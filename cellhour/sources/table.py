"""The built table at rest: scan, sorted write, sidecar and CSV mirror."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CANDIDATES, EXCLUDE, GRID_DEG, KEY, SEED, TARGET, Domain



def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
         drop_dead_cells: bool = False) -> DataFrame:
    """The table or some of its columns; filters on domain and year prune partitions."""
    table = spark.read.parquet(path)
    if drop_dead_cells:
        live = (table.groupBy("lat", "lon").agg(F.sum(TARGET).alias("events"))
                .filter(F.col("events") > 0).select("lat", "lon"))
        table = table.join(live, ["lat", "lon"], "left_semi")
    return table.select(*columns) if columns else table


def write(table: DataFrame, path: str, partitions: Sequence[str] = ("domain", "year"),
          files: int | None = None) -> None:
    """Parquet by domain and year, rows ordered by time and cell within a file.

    Range partitioning keeps neighbours in time together, so readers skip row
    groups, and a hot period spreads over several files.
    """
    order = [*partitions, *[k for k in ("time", "lat", "lon") if k in table.columns]]
    ranged = (table.repartitionByRange(files, *order) if files else table.repartitionByRange(*order))
    ranged.sortWithinPartitions(*order).write.mode("overwrite").partitionBy(*partitions).parquet(path)


def sidecar(table: DataFrame) -> DataFrame:
    """Facts about a table in one row: sizes, zero share, span, coverage over months."""
    months = table.groupBy("month").agg(F.max("coverage").alias("coverage"))
    coverage = months.agg(F.avg("coverage").alias("mean_coverage"),
                          F.min("coverage").alias("min_coverage_observed"))
    facts = table.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("lat", "lon").alias("n_cells"),
        F.avg((F.col(TARGET) == 0).cast("double")).alias("zero_target_share"),
        F.min("time").alias("first_period"), F.max("time").alias("last_period"))
    return (facts.withColumn("n_columns", F.lit(len(table.columns)))
            .join(F.broadcast(coverage), F.lit(True)))  # one row beside one row


def write_sidecar(table: DataFrame, domain: Domain, path: str) -> dict:
    """The facts and the configuration that made them, as one JSON document."""
    facts = sidecar(table).first().asDict()
    document = {
        **{k: (v if isinstance(v, (int, float)) else str(v)) for k, v in facts.items()},
        "domain": domain.name, "bbox_snapped": list(domain.snapped()),
        "months": [domain.first_month, domain.last_month], "grid_deg": GRID_DEG,
        "seed": SEED, "target": TARGET, "candidates": CANDIDATES, "exclude": EXCLUDE,
        "columns": table.columns,
    }
    text = table.sparkSession.createDataFrame([(json.dumps(document),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(path)
    return document


def read_sidecar(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r["value"] for r in spark.read.text(path).collect()))


def csv_mirror(table: DataFrame, path: str, limit: int | None = None) -> None:
    """A CSV copy of all rows for people; where a limit is given, a larger table is an error."""
    if limit is not None and (n := table.count()) > limit:
        raise ValueError(f"{n} rows are more than the limit of {limit} for a CSV copy")
    table.write.mode("overwrite").option("header", True).csv(path)


def sorted_view(table: DataFrame) -> DataFrame:
    return table.orderBy("time", *[k for k in KEY if k != "time"])
