"""Prepared data, fits, scenario evaluation, the experiment grid and one-factor sweeps."""

from __future__ import annotations

import time as clock
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict, dataclass, replace
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encode
from ..model import FOLDS, KEY, SCENARIOS, STAGES, TARGET, WINDOW_HOURS, require
from ..operators import evaluate, features, models, split
from ..session import materialise, scratch
from ..sources import records

MODELS = ("baseline_trivial", "ridge")


@dataclass(frozen=True)
class Settings:
    """Everything a run depends on, stored with its record; all rows and days unless told otherwise."""

    features: tuple[str, ...]
    hour_encoding: str = "cyclic"
    transform: str = "log1p"
    reduction: str | None = None
    train_rows: int | None = None
    zero_ratio: float | None = None
    validation_rows: int | None = None
    test_days: int | None = None
    validation_share: float = 0.15
    alpha: float = 1.0

    def snapshot(self) -> dict[str, str]:
        return {k: "" if v is None else ",".join(v) if isinstance(v, tuple) else str(v)
                for k, v in asdict(self).items()}


@dataclass(frozen=True)
class Prepared:
    """Rows on the model's scale, with what is needed to read predictions back."""

    train: DataFrame
    validation: DataFrame
    test: DataFrame
    scaler: features.RangeScaler
    settings: Settings
    stage: str

    @property
    def names(self) -> list[str]:
        return self.scaler.outputs


def encoded(table: DataFrame, settings: Settings) -> tuple[DataFrame, list[str]]:
    """The table with its hour encoding, and the feature names in order."""
    extra = encode.hour_encoding(settings.hour_encoding)
    names = [*settings.features, *extra]
    missing = [n for n in settings.features if n not in table.columns]
    if missing:
        raise KeyError(f"features not in the table: {missing}")
    require({"features": names}, {"outcome"})
    return table.withColumns(extra) if extra else table, names


def _model_rows(rows: DataFrame, scaler: features.RangeScaler, stage: str, settings: Settings,
                key: Sequence[str], clip: bool) -> DataFrame:
    raw = encode.stage_target(F.col(TARGET), stage, settings.transform)
    target = scaler.scale_target(raw) if stage == "count" else raw
    index = [c for c in dict.fromkeys([*key, "time", "lat", "lon", "area_km2", TARGET])
             if c in rows.columns]
    renamed = {c: f"_{c}" for c in index if c in scaler.names}
    kept = rows.withColumn("y", target).withColumns({new: F.col(old) for old, new in renamed.items()})
    out = scaler.apply(kept, [*[renamed.get(c, c) for c in index], "y"], clip)
    return out


def prepare(table: DataFrame, fold: tuple[list[int], int], stage: str, seed: int, settings: Settings,
            key: Sequence[str] = KEY,
            number: Callable[[int, Sequence[str]], Column] = split.default_number,
            cuts: dict[tuple[int, ...], float | None] | None = None) -> Prepared:
    """Encode, guard, split, filter by stage, cap, sample, scale — in that order.

    Only training rows are reshaped, and only training rows are fitted on.
    """
    rows, names = encoded(table, settings)
    labelled = split.split(rows, *fold, share=settings.validation_share, cuts=cuts)
    part = lambda name: split.stage_rows(labelled.filter(F.col("split") == name), stage)
    draw = number(seed, key)
    validation = split.cap(part("validation"), settings.validation_rows, draw, key)
    test = split.spaced_days(part("test"), settings.test_days)
    train = split.subsample(part("train"), settings.train_rows, draw, key, settings.zero_ratio)
    # Capped frames are small and read by every model and metric.
    if settings.train_rows is not None:
        train = materialise(train)
    if settings.validation_rows is not None:
        validation = materialise(validation)
    target = encode.stage_target(F.col(TARGET), stage, settings.transform) if stage == "count" else None
    scaler = features.fit_range(train, names, settings.reduction, target)
    scaled = lambda df, clip: _model_rows(df, scaler, stage, settings, key, clip)
    return Prepared(scaled(train, False), scaled(validation, True), scaled(test, True), scaler,
                    settings, stage)


@dataclass(frozen=True)
class Fitted:
    source: str
    fold: str
    seed: int
    prepared: Prepared
    models: dict[str, models.Linear]
    smearing: dict[str, float]
    seconds: dict[str, float]
    train_rows: int


def counts_of(scored: DataFrame, fitted: Prepared, factor: float = 1.0) -> DataFrame:
    """Predictions as counts, beside the observed count."""
    s = fitted.scaler
    value = encode.to_counts(F.col("predicted"), s.target_mean, s.target_sd, fitted.settings.transform)
    return scored.withColumns({"predicted": value * F.lit(float(factor)),
                               "observed": F.col(TARGET).cast("double")})


def fit(table: DataFrame, source: str, fold: tuple[list[int], int], fold_name: str, stage: str, seed: int,
        settings: Settings, ladder: Sequence[str] = MODELS, key: Sequence[str] = KEY, **options) -> Fitted:
    """Every model of the ladder on one prepared frame; smearing comes from validation rows, of all models in one pass."""
    prepared = prepare(table, fold, stage, seed, settings, key, **options)
    fitted, seconds = {}, {}
    for name in ladder:
        started = clock.perf_counter()
        if name == "baseline_trivial":
            fitted[name] = models.base_rate(prepared.train, "y")
        elif name == "ridge":
            fitted[name] = models.ridge(prepared.train, prepared.names, "y", settings.alpha)
        else:
            raise ValueError(f"unknown model {name!r}")
        seconds[name] = clock.perf_counter() - started
    done = Fitted(source, fold_name, seed, prepared, fitted, {}, seconds, prepared.train.count())
    if stage != "count":
        return done
    held = counts_of(predictions(done, prepared.validation), prepared)
    found = {r["model"]: float(r["factor"]) for r in evaluate.smearing_factor(held, by=["model"]).collect()}  # one row a model
    return replace(done, smearing={name: found.get(name, 1.0) for name in ladder})


def target_rows(table: DataFrame, fold: tuple[list[int], int], fitted: Fitted,
                key: Sequence[str] = KEY) -> DataFrame:
    """Another domain's test rows through the source domain's scaler."""
    p = fitted.prepared
    rows, _ = encoded(table, p.settings)
    test = split.stage_rows(rows.filter(F.col("year") == fold[1]), p.stage)
    return _model_rows(split.spaced_days(test, p.settings.test_days), p.scaler, p.stage, p.settings, key, True)


def _index_names(rows: DataFrame, scaler: features.RangeScaler) -> DataFrame:
    """Index columns back under their own names, beside nothing else they could clash with."""
    back = {f"_{c}": c for c in ("lat", "lon", "time") if f"_{c}" in rows.columns}
    return rows.drop(*back.values()).withColumnsRenamed(back) if back else rows


def predictions(fitted: Fitted, rows: DataFrame) -> DataFrame:
    """model, predicted and the index of every row: all models of the ladder in one pass."""
    p = fitted.prepared
    scores = {name: models.bounded(m.score(), p.stage) for name, m in fitted.models.items()}
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), e.alias("predicted"))
                                for n, e in scores.items()])).alias("cell")
    index = _index_names(rows.withColumn("cell", cells), p.scaler)
    keep = [c for c in ("time", "lat", "lon", "area_km2", TARGET) if c in index.columns]
    return index.select(*keep, "y", "cell.*")


def curves(fitted: Fitted, scored: DataFrame, hours: Sequence[int] = WINDOW_HOURS) -> DataFrame:
    """model, windows, windows_raw: the corrected and the raw curve of each model, from one job."""
    p = fitted.prepared
    variants = F.array(*[F.struct(
        F.lit(name).alias("model"), F.lit(curve).alias("curve"), F.lit(float(factor)).alias("factor"))
        for name, smearing in fitted.smearing.items()
        for curve, factor in (("windows", smearing), ("windows_raw", 1.0))])
    counted = counts_of(scored, p).withColumn("v", F.explode(F.filter(
        variants, lambda v: v["model"] == F.col("model"))))
    counted = counted.select("model", F.col("v.curve").alias("curve"), "time", "lat", "lon", "area_km2",
                             "observed", (F.col("predicted") * F.col("v.factor")).alias("predicted"))
    curve = evaluate.window_curve(counted, hours, ["model", "curve"])
    wanted = F.struct("window_h", "n", "rmse", "mae", "r2", "nrmse", "bias", "cal_ratio",
                      "cal_zero_share_observed", "cal_n_windows")
    of = lambda name: F.array_sort(F.collect_list(F.when(F.col("curve") == name, wanted))).alias(name)
    return curve.groupBy("model").agg(of("windows"), of("windows_raw"))  # a few windows each


def score(fitted: Fitted, rows: DataFrame, scenario: str,
          hours: Sequence[int] = WINDOW_HOURS) -> DataFrame:
    """One run record per model: nested metrics, window curves and settings."""
    p = fitted.prepared
    scored = predictions(fitted, rows)
    if p.stage == "occurrence":
        record = evaluate.classification(scored, "y", "predicted", ["model"])
        lists: list[str] = []
    else:
        factor = F.create_map(*[x for n, v in fitted.smearing.items() for x in (F.lit(n), F.lit(float(v)))])
        record = evaluate.regression(scored, "y", "predicted", ["model"]).withColumn(
            "smearing_factor", factor[F.col("model")])
        record = record.join(F.broadcast(curves(fitted, scored, hours)), "model")  # one row per model
        lists = ["windows", "windows_raw"]
    fields = [F.col(m) if m in record.columns else F.lit(None).cast("double").alias(m)
              for m in [*records.METRICS, "n"]]
    facts = F.create_map(*[x for n, m in fitted.models.items() for x in (
        F.lit(n), F.struct(F.lit(m.n_params).alias("n_params"), F.lit(fitted.seconds[n]).alias("seconds")))])
    settings = F.create_map(*[x for k, v in p.settings.snapshot().items() for x in (F.lit(k), F.lit(v))])
    return record.select(
        F.lit(scenario).alias("scenario"), F.lit(p.stage).alias("stage"), "model",
        F.lit(fitted.fold).alias("fold"), F.lit(fitted.seed).alias("seed"),
        F.lit(fitted.train_rows).cast("bigint").alias("train_rows"),
        facts[F.col("model")]["n_params"].alias("n_params"), facts[F.col("model")]["seconds"].alias("seconds"),
        F.lit(0).alias("epochs_run"), F.lit(0).alias("best_epoch"), F.lit(False).alias("stopped_early"),
        F.struct(*fields, *lists).alias("metrics"), settings.alias("config"))


PLAN = ("fit STRING, stage STRING, source STRING, fold INT, seed INT, "
        "targets ARRAY<STRUCT<scenario: STRING, target: STRING>>")


def grid_plan(spark: SparkSession, settings: Settings, folds: Sequence[tuple[list[int], int]] = FOLDS,
              seeds: Iterable[int] = (0, 1, 2), stages: Sequence[str] = STAGES,
              scenarios: Sequence[tuple[str, str, str]] = SCENARIOS, version: str = "") -> DataFrame:
    """One row per fit with the scenarios it serves, keyed by all that its records depend on.

    `version` names the state of the tables; other tables, settings, years or scenarios give other keys.
    """
    given = "\n".join([version, *(f"{k}={v}" for k, v in sorted(settings.snapshot().items()))])
    serves = {source: [(s, t) for s, o, t in scenarios if o == source] for _, source, _ in scenarios}
    fits = [(given + f"\n{folds[i]}\n{serves[source]}", stage, source, i, seed, serves[source])
            for stage, source, i, seed in product(stages, serves, range(len(folds)), seeds)]
    return spark.createDataFrame(fits, PLAN).withColumn(
        "fit", F.sha2(F.concat_ws("\n", "fit", "stage", "source", "seed"), 256))


def stored_rows(table: DataFrame, years: Iterable[int], settings: Sequence[Settings], key: Sequence[str] = KEY) -> DataFrame:
    """The rows of these years, with the columns that fits and scores of these settings read, written once and divided by year.

    Every fit passes over its rows some ten times; so each pass reads a few stored columns of its own
    years, and the columns of the table are worked out once for all fits.
    """
    wanted = ["year", "time", "lat", "lon", "area_km2", "hour_of_day_local", TARGET, *[n for s in settings for n in s.features]]
    if any(s.train_rows is not None or s.validation_rows is not None for s in settings):
        wanted += [*key, *split.STRATA]
    rows = table.select(*[c for c in dict.fromkeys(wanted) if c in table.columns]).filter(F.col("year").isin(*years))
    path = scratch(table.sparkSession, "rows")
    rows.write.partitionBy("year").parquet(path)
    return table.sparkSession.read.schema(rows.schema).parquet(path)


def fold_cuts(table: DataFrame, folds: Sequence[tuple[list[int], int]], settings: Settings) -> dict[tuple[int, ...], float | None]:
    """The validation cut of every fold by its training years; stages and seeds share them."""
    years = list(dict.fromkeys(tuple(train) for train, _ in folds))
    return dict(zip(years, split.validation_cuts(table, years, settings.validation_share)))


def run_grid(tables: dict[str, DataFrame], settings: Settings, path: str,
             folds: Sequence[tuple[list[int], int]] = FOLDS, seeds: Iterable[int] = (0, 1, 2),
             stages: Sequence[str] = STAGES, scenarios: Sequence[tuple[str, str, str]] = SCENARIOS,
             version: str = "", key: Sequence[str] = KEY, **options) -> DataFrame:
    """The records of every fit of the plan; fits whose records are stored are not made again.

    The records of a fit are one write, which Spark publishes whole or not at
    all, under the fit's key: a run that was stopped goes on where it was, and a
    write that is repeated replaces itself.
    """
    spark = next(iter(tables.values())).sparkSession
    plan = grid_plan(spark, settings, folds, seeds, stages, scenarios, version)
    missing = plan.join(records.stored_fits(spark, path), "fit", "left_anti").orderBy("stage", "source", "fold", "seed")
    runs = missing.collect()  # one row per fit, not per data row
    used = [folds[i] for i in sorted({run["fold"] for run in runs})]
    needed = sorted({d for run in runs for d in (run["source"], *[target for _, target in run["targets"]])})
    if "number" not in options:  # a draw of the caller's own may read any column
        every = {year for years, held in used for year in (*years, held)}
        tables = {**tables, **{d: stored_rows(tables[d], every, [settings], key) for d in needed}}
    cuts = {source: fold_cuts(tables[source], used, settings) for source in sorted({run["source"] for run in runs})}
    for run in runs:
        years, held = folds[run["fold"]]
        fitted = fit(tables[run["source"]], run["source"], folds[run["fold"]],
                     f"fold{run['fold']}_{years[0]}-{years[-1]}_test{held}", run["stage"], run["seed"], settings, key=key,
                     cuts=cuts[run["source"]], **options)
        parts = [score(fitted, fitted.prepared.test if target == run["source"] else
                       target_rows(tables[target], folds[run["fold"]], fitted, key), scenario)
                 for scenario, target in run["targets"]]
        records.store(reduce(DataFrame.unionByName, parts), path, run["fit"])
    return records.load(spark, path, plan.select("fit"))


def run_sweep(table: DataFrame, axis: str, values: Sequence, settings: Settings, path: str,
              fold: tuple[list[int], int] = FOLDS[2], stage: str = "occurrence", seed: int = 0,
              **options) -> DataFrame:
    """One setting varied, all others held; the value is part of the stored configuration."""
    varied = [replace(settings, **{axis: value}) for value in values]
    if varied and "number" not in options:  # a draw of the caller's own may read any column
        table = stored_rows(table, {*fold[0], fold[1]}, varied, options.get("key", KEY))
    cuts = {s: fold_cuts(table, [fold], replace(settings, validation_share=s)) for s in {v.validation_share for v in varied}}
    for changed in varied:
        fitted = fit(table, "sweep", fold, f"test{fold[1]}", stage, seed, changed, cuts=cuts[changed.validation_share], **options)
        records.append(score(fitted, fitted.prepared.test, f"sweep_{axis}"), path)
    return records.load(table.sparkSession, path)
