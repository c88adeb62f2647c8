"""Ranking of candidate features per arm and stage, and the stored selection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..model import KEY, SELECT_N, STAGES, TARGET, TEST_YEAR, require
from ..operators import features, selection
from ..operators.split import pooled

ARMS = ("full", "meteorology")
SET_SCHEMA = "scope STRING, domain STRING, stage STRING, position INT, feature STRING"


@dataclass(frozen=True)
class ArmResult:
    arm: str
    features: list[str]
    rankings: dict[str, selection.Ranking]

    def selected(self, stage: str, k: int) -> list[str]:
        return self.rankings[stage].order[:k]


def feature_rows(table: DataFrame, names: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Key, target and features; a feature that is part of the key appears once."""
    keep = [*[k for k in key if k not in names], TARGET]
    return features.matrix(table, names, keep)


def arm_names(table: DataFrame, arms: dict[str, Sequence[str] | None]) -> dict[str, list[str]]:
    """The features each arm ranks: those given, or all that the table offers it."""
    return {arm: list(given or features.arm_features(table, arm)) for arm, given in arms.items()}


def rank_arms(rows: DataFrame, names: dict[str, list[str]], key: Sequence[str] = KEY, **options) -> dict[str, ArmResult]:
    """Several arms from one pass of statistics per stage over the union of their features, which `rows` holds."""
    every = list(dict.fromkeys(n for listed in names.values() for n in listed))
    statistics = {stage: selection.stage_statistics(rows, every, stage, key, **options) for stage in STAGES}
    return {arm: ArmResult(arm, listed, {stage: s.select(listed) for stage, s in statistics.items()})
            for arm, listed in names.items()}


def screen_arms(train: DataFrame, arms: dict[str, Sequence[str] | None], key: Sequence[str] = KEY,
                **options) -> dict[str, ArmResult]:
    names = arm_names(train, arms)
    every = list(dict.fromkeys(n for listed in names.values() for n in listed))
    return rank_arms(feature_rows(train, every, key), names, key, **options)


def screen_arm(train: DataFrame, arm: str, key: Sequence[str] = KEY, names: Sequence[str] | None = None,
               **options) -> ArmResult:
    return screen_arms(train, {arm: names}, key, **options)[arm]


def screen_domain(table: DataFrame, test_year: int = TEST_YEAR, arms: Sequence[str] = ARMS,
                  **options) -> dict[str, ArmResult]:
    """All arms on the years before the held-out one; a filter on `year` prunes partitions."""
    train = table.filter(table["year"] != test_year)
    return screen_arms(train, {arm: None for arm in arms}, **options)


def screen_shared(tables: Sequence[DataFrame], test_year: int = TEST_YEAR,
                  key: Sequence[str] = ("domain", *KEY), **options) -> ArmResult:
    """One ranking over the domains' stacked training rows, coordinates left out."""
    train = pooled([t.filter(t["year"] != test_year) for t in tables])
    return screen_arm(train, "shared", key, **options)


def steps_table(spark_frame: DataFrame, results: Sequence[ArmResult]) -> DataFrame:
    """arm, stage, position, feature, relevance, redundancy, score."""
    rows = [(r.arm, stage, i + 1, s.feature, float(s.relevance), float(s.redundancy), float(s.score))
            for r in results for stage, ranking in r.rankings.items()
            for i, s in enumerate(ranking.steps)]
    return spark_frame.sparkSession.createDataFrame(
        rows, f"arm STRING, stage STRING, {selection.STEP_SCHEMA}")


def feature_sets(spark: SparkSession, within: dict[str, ArmResult], shared: ArmResult,
                 k: int = SELECT_N) -> DataFrame:
    """The selected sets: one per domain and stage, and one shared per stage."""
    rows = [("within", d, stage, i + 1, f) for d, r in within.items() for stage in STAGES
            for i, f in enumerate(r.selected(stage, k))]
    rows += [("shared", None, stage, i + 1, f) for stage in STAGES
             for i, f in enumerate(shared.selected(stage, k))]
    return spark.createDataFrame(rows, SET_SCHEMA)


def check_sets(sets: DataFrame) -> dict[tuple[str, str | None, str], list[str]]:
    """The sets as lists in their order; raises when one breaks the contract."""
    lists: dict[tuple[str, str | None, str], list[str]] = {}
    for r in sorted(sets.collect(), key=lambda r: r["position"]):
        lists.setdefault((r["scope"], r["domain"], r["stage"]), []).append(r["feature"])
    for stage in STAGES:
        of = lambda wanted: {f"{scope} {domain or 'pooled'} {s}": names
                             for (scope, domain, s), names in lists.items() if (scope, s) == (wanted, stage)}
        require(of("within"), {"outcome", "calendar"}, same_width=True)
        require(of("shared"), {"outcome", "calendar", "place"})
    return lists


def write_sets(sets: DataFrame, path: str) -> dict:
    """Store the sets, then read them back through the contract."""
    sets.coalesce(1).write.mode("overwrite").json(path)
    return check_sets(read_sets(sets.sparkSession, path))


def read_sets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SET_SCHEMA).json(path)
