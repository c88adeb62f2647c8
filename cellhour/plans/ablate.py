"""What each selected feature is worth to a plain linear model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw_number, seeded_sample
from ..functions.moments import Moments, moments
from ..model import KEY, SEED, SEEDS, SELECT_N, STAGES, SWEEP_WIDTHS, TARGET, UNDEFINED_COLUMNS
from ..operators import evaluate, features, models
from ..session import stored
from . import screen

PRIMARY = {"occurrence": "pr_auc", "count": "r2"}
Scale = dict[str, tuple[float, float]]
SCORE_SCHEMA = "arm STRING, stage STRING, dropped STRING, score DOUBLE, roc_auc DOUBLE, delta DOUBLE"


@dataclass(frozen=True)
class Ablation:
    """Score of the full set, and of the set without each feature."""

    stage: str
    names: list[str]
    full: float
    roc_auc: float | None
    without: dict[str, float]

    @property
    def deltas(self) -> dict[str, float]:
        return {n: self.full - s for n, s in self.without.items()}

    @property
    def order(self) -> list[str]:
        return sorted(self.names, key=lambda n: -self.deltas[n])


def _rescaled(m: Moments, scale: dict[str, tuple[float, float]]) -> Moments:
    shift = np.array([scale.get(n, (0.0, 1.0))[0] for n in m.names])
    size = np.array([scale.get(n, (0.0, 1.0))[1] for n in m.names])
    return Moments(m.names, m.n, (m.mean - shift) / size, m.cov / np.outer(size, size))


def count_scores(train: DataFrame, test: DataFrame, subsets: Sequence[Sequence[str]],
                 names: Sequence[str], alpha: float = 1.0, scale: Scale | None = None) -> list[float | None]:
    """R-squared per feature subset on flashing test rows.

    Ridge fit and error are functions of moments, so any number of subsets
    costs two passes: one over the training rows, one over the test rows.
    """
    scale = scale or models.standardiser(train, names)
    target = "log_count"
    known = lambda df: _rescaled(moments(
        df.filter(F.col(TARGET) > 0).withColumn(target, F.log1p(F.col(TARGET).cast("double"))),
        [*names, target]), scale)
    fit, held = known(train), known(test)
    return [models.linear_r2(models.ridge_from(fit, s, target, alpha), held, target) for s in subsets]


def occurrence_scores(train: DataFrame, test: DataFrame, subsets: Sequence[Sequence[str]],
                      names: Sequence[str], scale: Scale | None = None) -> list[tuple[float, float]]:
    """Average precision and ROC area per feature subset on the whole test year.

    All fits take their steps together and are scored together. Some ten passes
    read the rows, so they should be stored ones.
    """
    scale = scale or models.standardiser(train, names)
    labelled = lambda df: models.standardised(df, {n: scale[n] for n in names}).select(
        *names, (F.col(TARGET) > 0).cast("int").alias("flashed"))
    fits = models.logistic_fits(labelled(train), subsets, "flashed")
    found = evaluate.fits_ranking(labelled(test), fits, "flashed")
    return [found[i] for i in range(len(fits))]


def fit_score(train: DataFrame, test: DataFrame, names: Sequence[str], stage: str) -> dict[str, float]:
    if stage == "occurrence":
        rows = [stored(df.select(*names, TARGET)) for df in (train, test)]
        ap, auc = occurrence_scores(*rows, [list(names)], names)[0]
        return {"pr_auc": ap, "roc_auc": auc}
    return {"r2": count_scores(train, test, [list(names)], names)[0]}


def stored_scores(train: DataFrame, test: DataFrame, subsets: Sequence[Sequence[str]], stage: str,
                  scale: Scale | None = None) -> list[tuple[float | None, float | None]]:
    """Primary score and ROC area (occurrence only) of every feature subset on rows that hold target and features."""
    names = list(dict.fromkeys(n for s in subsets for n in s))
    if stage == "count":
        return [(r2, None) for r2 in count_scores(train, test, subsets, names, scale=scale)]
    return occurrence_scores(train, test, subsets, names, scale)


def subset_scores(train: DataFrame, test: DataFrame, subsets: Sequence[Sequence[str]], stage: str,
                  key: Sequence[str] = KEY, extra: Sequence[str] = (), fit_rows: int | None = None,
                  number: Column | None = None) -> list[tuple[float | None, float | None]]:
    """Primary score and ROC area (occurrence only) of every feature subset, from one matrix and one run of fits.

    `extra` names table columns the arms leave out, such as the undefined ones.
    Fits read all rows; `fit_rows` draws so many for the logistic fits instead.
    """
    names = list(dict.fromkeys(n for s in subsets for n in s))
    plain = [n for n in names if n not in extra]
    rows = lambda df: features.matrix(
        df, plain, [*[k for k in key if k not in names], TARGET, *[c for c in extra if c in names]])
    if stage == "count":
        return [(r2, None) for r2 in count_scores(rows(train), rows(test), subsets, names)]
    drawn = rows(train)
    if fit_rows is not None:
        drawn = seeded_sample(drawn, fit_rows, draw_number(SEED, *[F.col(k) for k in key]) if number is None else number, key)
    return occurrence_scores(stored(drawn.select(*names, TARGET)), stored(rows(test).select(*names, TARGET)), subsets, names)


def without_each(names: Sequence[str]) -> list[list[str]]:
    """The whole set, then the set without each of its features."""
    return [list(names), *[[m for m in names if m != n] for n in names]]


def ablate(train: DataFrame, test: DataFrame, names: Sequence[str], stage: str, key: Sequence[str] = KEY,
           extra: Sequence[str] = (), fit_rows: int | None = None, number: Column | None = None) -> Ablation:
    """Full set against every set with one feature left out; test rows stay whole."""
    names = list(names)
    (full, auc), *rest = subset_scores(train, test, without_each(names), stage, key, extra, fit_rows, number)
    return Ablation(stage, names, full, auc, {n: score for n, (score, _) in zip(names, rest)})


def ablation_table(like: DataFrame, results: dict[tuple[str, str], Ablation]) -> DataFrame:
    rows = []
    for (arm, stage), a in results.items():
        rows.append((arm, stage, None, a.full, a.roc_auc, None))
        rows += [(arm, stage, n, a.without[n], None, a.deltas[n]) for n in a.order]
    return like.sparkSession.createDataFrame(rows, SCORE_SCHEMA)


def climatology_gap(scores: DataFrame) -> DataFrame:
    """Full-arm score against the meteorology arm, per stage (and width, if present)."""
    by = [c for c in ("width", "stage") if c in scores.columns]
    whole = scores.filter(F.col("dropped").isNull())
    of = lambda arm: whole.filter(F.col("arm") == arm).select(*by, F.col("score").alias(arm))
    return of("full").join(of("meteorology"), by).select(
        *by, "full", "meteorology", (F.col("full") - F.col("meteorology")).alias("gap"),
        F.try_divide("meteorology", "full").alias("meteorology_share"))


def run_widths(train: DataFrame, test: DataFrame, widths: Sequence[int] = (SELECT_N, *SWEEP_WIDTHS),
               key: Sequence[str] = KEY, arms: dict[str, Sequence[str] | None] | None = None,
               stages: Sequence[str] = STAGES, leave_one_out: bool = True, fit_rows: int | None = None,
               **options) -> DataFrame:
    """Scores per width, arm and stage.

    A greedy order does not depend on where it stops, so each arm is ranked once
    and every width reads a prefix of that order. Fits see the rows where all
    selected features have a value. Some thirty passes read the features, so
    they are worked out and written once.
    """
    names = screen.arm_names(train, arms or {a: None for a in screen.ARMS})
    every = list(dict.fromkeys(n for listed in names.values() for n in listed))
    draws = options.get("seeds", SEEDS) or fit_rows is not None  # only draws read the key
    rows = stored(screen.feature_rows(train, every, key if draws else []))
    ranked = screen.rank_arms(rows, names, key, **options)
    chosen = {(width, arm, stage): r.selected(stage, width)
              for width in sorted(set(widths)) for arm, r in ranked.items() for stage in stages}
    read = list(dict.fromkeys(n for listed in chosen.values() for n in listed))
    held = stored(screen.feature_rows(test, read, []))
    scale = models.standardiser(rows, read)
    results: dict[int, dict[tuple[str, str], Ablation]] = {}
    for stage in stages:  # all widths and arms of a stage are fitted together
        sets = {k: names for k, names in chosen.items() if k[2] == stage}
        subsets = {k: without_each(names) if leave_one_out else [names] for k, names in sets.items()}
        different = list(dict.fromkeys(tuple(s) for listed in subsets.values() for s in listed))
        fitted, known = rows, scale
        if stage == "occurrence" and fit_rows is not None:
            fitted, known = stored(seeded_sample(rows, fit_rows, draw_number(SEED, *[F.col(k) for k in key]), key)), None
        found = dict(zip(different, stored_scores(fitted, held, different, stage, known)))
        for (width, arm, _), listed in subsets.items():
            (full, auc), *rest = [found[tuple(s)] for s in listed]
            names = sets[width, arm, stage] if leave_one_out else []
            results.setdefault(width, {})[arm, stage] = Ablation(stage, names, full, auc, {n: r[0] for n, r in zip(names, rest)})
    parts = [ablation_table(train, found).withColumn("width", F.lit(width)) for width, found in results.items()]
    return reduce(DataFrame.unionByName, parts)


def complete_case(train: DataFrame, test: DataFrame, k: int = SELECT_N, key: Sequence[str] = KEY,
                  undefined: Sequence[str] = UNDEFINED_COLUMNS, names: Sequence[str] | None = None,
                  stages: Sequence[str] = STAGES, fit_rows: int | None = None, **options) -> DataFrame:
    """Price of leaving out the undefined columns, on rows where all of them exist."""
    tr, te = train.na.drop(subset=list(undefined)), test.na.drop(subset=list(undefined))
    ranked = screen.screen_arm(tr, "full", key, names, **options)
    rows = []
    for stage in stages:
        without = [n for n in ranked.selected(stage, k) if n not in undefined]
        a = ablate(tr, te, without, stage, key, fit_rows=fit_rows)
        b = ablate(tr, te, [*without, *undefined], stage, key, extra=undefined, fit_rows=fit_rows)
        rows.append((stage, a.full, b.full, b.full - a.full, {u: b.deltas[u] for u in undefined}))
    return train.sparkSession.createDataFrame(
        rows, "stage STRING, without DOUBLE, with DOUBLE, cost_of_dropping DOUBLE, "
              "deltas MAP<STRING, DOUBLE>")
