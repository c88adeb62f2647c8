"""Folds, chronological splits and stratified sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean, ordering
from ..functions.draws import draw_number, stratified_draw
from ..model import FOLDS, TARGET, VALIDATION_SHARE

STRATA = ["lat", "lon", "month_of_year"]


def folds(spark: SparkSession, definition: Sequence[tuple[list[int], int]] = FOLDS) -> DataFrame:
    """index, name, train_years, test_year; a handful of rows."""
    rows = [(i, f"fold{i}_{train[0]}-{train[-1]}_test{test}", train, test)
            for i, (train, test) in enumerate(definition)]
    return spark.createDataFrame(rows, "fold INT, name STRING, train_years ARRAY<INT>, test_year INT")


def assign_folds(table: DataFrame, fold_table: DataFrame) -> DataFrame:
    """Each row once per fold it serves, as training or as test row; other years leave."""
    roles = (fold_table.select("fold", F.explode("train_years").alias("year"), F.lit("train").alias("role"))
             .unionByName(fold_table.select("fold", F.col("test_year").alias("year"),
                                            F.lit("test").alias("role"))))
    return table.join(F.broadcast(roles), "year")


def time_micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def validation_cut(train: DataFrame, share: float = VALIDATION_SHARE) -> float:
    """The moment after which training rows become validation rows, in microseconds."""
    moment = train.select(time_micros(F.col("time")).alias("t"))
    return ordering.quantiles(moment, ["t"], [1.0 - share])["t"][0]


def validation_cuts(table: DataFrame, train_years: Sequence[Sequence[int]], share: float = VALIDATION_SHARE) -> list[float | None]:
    """The cut of every list of training years, from the same passes; None where no training row has a time."""
    moment = time_micros(F.col("time"))
    names = [f"t{i}" for i in range(len(train_years))]
    of = table.select(*[F.when(F.col("year").isin(*years), moment).alias(n) for n, years in zip(names, train_years)])
    found = ordering.quantiles(of, names, [1.0 - share])
    return [found[n][0] for n in names]


def split(table: DataFrame, train_years: Sequence[int], test_year: int,
          share: float = VALIDATION_SHARE, cuts: dict[tuple[int, ...], float | None] | None = None) -> DataFrame:
    """Adds `split`: train, validation (the latest part of the training years) or test.

    Rows of other years are left out. Filters on `year` and prunes partitions.
    `cuts` gives the validation cut by training years, where it is known already.
    """
    rows = table.filter(F.col("year").isin(*train_years, test_year))
    train = rows.filter(F.col("year").isin(*train_years))
    if train.isEmpty() or rows.filter(F.col("year") == test_year).isEmpty():
        raise ValueError(f"no rows to train on {list(train_years)} or to test on {test_year}")
    cut = validation_cut(train, share) if cuts is None else cuts[tuple(train_years)]
    late = time_micros(F.col("time")) > F.lit(cut)
    label = F.when(F.col("year") == test_year, "test").when(late, "validation").otherwise("train")
    return rows.withColumn("split", label)


def stage_rows(table: DataFrame, stage: str) -> DataFrame:
    """The count stage sees rows with events only."""
    return table.filter(F.col(TARGET) > 0) if stage == "count" else table


def subsample(train: DataFrame, n: int | None, number: Column, tie: Sequence[str],
              zero_ratio: float | None = None, strata: Sequence[str] = STRATA) -> DataFrame:
    """n training rows, stratified; with a ratio, zeros and non-zeros are drawn apart."""
    if n is None:
        return train
    zero = F.col(TARGET) == 0
    sizes = train.agg(F.count(F.lit(1)).alias("all"), F.count_if(zero).alias("zero")).first()
    if n >= sizes["all"]:
        return train
    keys = [k for k in strata if k in train.columns]
    if zero_ratio is None:
        return stratified_draw(train, keys, n, number, tie)
    n_zero = min(round(n * zero_ratio), sizes["zero"])
    n_rest = min(n - n_zero, sizes["all"] - sizes["zero"])
    part = lambda rows, m, size: rows if m >= size else stratified_draw(rows, keys, m, number, tie)
    return part(train.filter(zero), n_zero, sizes["zero"]).unionByName(
        part(train.filter(~zero), n_rest, sizes["all"] - sizes["zero"]))


def cap(rows: DataFrame, n: int | None, number: Column, tie: Sequence[str],
        strata: Sequence[str] = STRATA) -> DataFrame:
    """At most n rows, stratified; for validation rows, which only steer a fit."""
    return subsample(rows, n, number, tie, strata=strata)


def spaced_days(table: DataFrame, k: int | None) -> DataFrame:
    """Whole days at even steps over the days present.

    The days of a table are calendar days, so their list is short; positions
    round half to even.
    """
    if k is None:
        return table
    day = clean.period(F.col("time"), "day")
    days = sorted(r["day"] for r in table.select(day.alias("day")).distinct().collect())
    if len(days) <= k:
        return table
    step = (len(days) - 1) / (k - 1) if k > 1 else 0.0
    chosen = sorted({days[round(i * step)] for i in range(k)})
    kept = table.sparkSession.createDataFrame([(d,) for d in chosen], "day TIMESTAMP_NTZ")
    return (table.withColumn("day", day).join(F.broadcast(kept), "day", "left_semi").drop("day"))


def pooled(tables: Sequence[DataFrame]) -> DataFrame:
    """Domains stacked; `domain` stays as a label and the contract keeps it out of features."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def default_number(seed: int, key: Sequence[str]) -> Column:
    return draw_number(seed, *[F.col(k) for k in key])
