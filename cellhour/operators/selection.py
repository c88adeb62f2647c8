"""Feature relevance, redundancy and greedy selection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordering
from ..functions.draws import SPAN, draw_number
from ..functions.moments import Moments
from ..model import REPEAT_SHARE, SEED, SEEDS, TARGET

BINS = 10
TIE_PLACES = 9  # scores that agree to so many places are equal: their order must not hang on how a sum was added


def bin_edges(df: DataFrame, columns: Sequence[str], bins: int = BINS,
              counted: ordering.Counted | None = None, packed: ordering.Packed | None = None) -> dict[str, list[float]]:
    """Distinct inner quantiles of each column; a few numbers per column.

    Columns with few distinct values have them from the counts of those, given
    or taken here, others from their slices where these are given; only what is
    left is narrowed down.
    """
    probs = [i / bins for i in range(1, bins)]
    counted = counted or ordering.counted_values(df, columns)
    sliced = [c for c in columns if packed and c in counted.many and c in packed.names]
    found = ordering.quantiles(df, [c for c in columns if c in counted.many and c not in sliced], probs)
    found |= {c: packed.quantiles(c, probs) for c in sliced}
    found |= {c: counted.quantiles(c, probs) for c in columns if c not in counted.many}
    found = {c: found[c] for c in columns}
    return {c: sorted({e for e in q if e is not None}) for c, q in found.items()}


def bin_number(value: Column, edges: Sequence[float]) -> Column:
    """How many edges lie below the value."""
    out = F.lit(0)
    for e in edges:
        out = out + (value > F.lit(float(e))).cast("int")
    return out


def contingency(df: DataFrame, edges: dict[str, list[float]], label: Column,
                by: Sequence[str] = ()) -> DataFrame:
    """by, feature, bin, label, n: every feature counted against the label in one job.

    A task counts its batches into one table per feature, so what it hands on
    depends on the bins, labels and groups it met, not on its rows.
    """
    names, ends = list(edges), [np.array(e, dtype=float) for e in edges.values()]
    width, outer = max((len(e) for e in ends), default=0) + 2, [*by, "label"]
    rows = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(names)], *by, label.alias("label"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict[tuple, int] = {}
        counts, fields = np.zeros((len(names), 0, width), dtype=np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            fields = [batch.schema.field(len(names) + i) for i in range(len(outer))]
            coded, parts = np.zeros(batch.num_rows, dtype=np.int64), []
            for i in range(len(outer)):
                part = batch.column(len(names) + i).dictionary_encode(null_encoding="encode")
                parts.append(part.dictionary.to_pylist())
                coded = coded * len(parts[-1]) + part.indices.to_numpy(zero_copy_only=False)
            met, group = np.unique(coded, return_inverse=True)
            place = []
            for code in met.tolist():
                found = []
                for values in reversed(parts):
                    code, at = divmod(code, len(values))
                    found.append(values[at])
                place.append(slots.setdefault(tuple(reversed(found)), len(slots)))
            counts = np.pad(counts, ((0, 0), (0, len(slots) - counts.shape[1]), (0, 0)))
            slot = np.array(place)[group] * width
            for i, e in enumerate(ends):
                column = batch.column(i)
                bins = np.searchsorted(e, column.to_numpy(zero_copy_only=False)) + 1
                if column.null_count:
                    bins[column.is_null().to_numpy(zero_copy_only=False)] = 0
                counts[i] += np.bincount(slot + bins, minlength=counts[i].size).reshape(-1, width)
        if fields:
            feature, slot, bins = np.nonzero(counts)
            keys = list(slots)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([keys[s][i] for s in slot], type=f.type) for i, f in enumerate(fields)],
                 pa.array([names[f] for f in feature], type=pa.string()),
                 pa.array(bins - 1, mask=bins == 0, type=pa.int32()), pa.array(counts[feature, slot, bins])],
                names=[*outer, "feature", "bin", "n"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[len(names):])
    return (rows.mapInArrow(count, f"{schema}, feature string, bin int, n bigint")
            .groupBy(*by, "feature", "bin", "label").agg(F.sum("n").alias("n"))
            .select(*by, "feature", "bin", "label", "n"))


def mutual_information(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, feature, mi, entropy of the label; works on the small contingency table."""
    keys = [*by, "feature"]
    total = F.sum("n").over(Window.partitionBy(*keys))
    shares = table.withColumns({
        "p": F.col("n") / total,
        "pb": F.sum("n").over(Window.partitionBy(*keys, "bin")) / total,
        "pl": F.sum("n").over(Window.partitionBy(*keys, "label")) / total})
    return shares.groupBy(*keys).agg(
        F.sum(F.col("p") * F.log(F.col("p") / (F.col("pb") * F.col("pl")))).alias("mi"),
        (-F.sum(F.col("p") * F.log("pl"))).alias("entropy"))


def uncertainty_removed(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, feature, relevance from a contingency table: information over the entropy of the label."""
    value = F.when(F.col("entropy") > 0, F.col("mi") / F.col("entropy")).otherwise(F.col("mi"))
    return mutual_information(table, by).select(*by, "feature", value.alias("relevance"))


def occurrence_relevance(df: DataFrame, edges: dict[str, list[float]],
                         by: Sequence[str] = ()) -> DataFrame:
    """Share of the uncertainty about an event each feature removes."""
    return uncertainty_removed(contingency(df, edges, (F.col(TARGET) > 0).cast("int"), by), by)


def count_information(df: DataFrame, edges: dict[str, list[float]], count_edges: Sequence[float],
                      by: Sequence[str] = ()) -> DataFrame:
    """Information each feature holds about the size of the count, where there are events."""
    level = bin_number(F.log1p(F.col(TARGET).cast("double")), count_edges)
    return mutual_information(contingency(df, edges, level, by), by)


def count_relevance(df: DataFrame, edges: dict[str, list[float]], count_edges: Sequence[float],
                    by: Sequence[str] = ()) -> DataFrame:
    """Count information relative to the best feature; only the order within one table means anything."""
    mi = count_information(df, edges, count_edges, by)
    top = F.max("mi").over(Window.partitionBy(*by))
    value = F.when(top > 0, F.col("mi") / top).otherwise(F.col("mi"))
    return mi.select(*by, "feature", value.alias("relevance"))


def rank_moments(df: DataFrame, features: Sequence[str], key: Sequence[str],
                 counted: ordering.Counted | None = None, packed: ordering.Packed | None = None, **limits: int) -> Moments:
    """Covariance of the average ranks: everything redundancy needs, from one ranking. The key is not read."""
    return ordering.rank_moments(df, features, counted, packed=packed, **limits)


def rank_r2(ranks: Moments, candidate: str, chosen: Sequence[str]) -> float:
    """Share of a candidate's rank variance the chosen features explain, within 0..1."""
    if not chosen:
        return 0.0
    at = [ranks.names.index(c) for c in chosen]
    i = ranks.names.index(candidate)
    if ranks.cov[i, i] <= 0:
        return 0.0
    corr = ranks.correlation()
    inner, cross = corr[np.ix_(at, at)], corr[at, i]
    weights = np.linalg.lstsq(inner, cross, rcond=1e-12)[0]
    return float(min(1.0, max(0.0, cross @ weights)))


@dataclass(frozen=True)
class Step:
    feature: str
    relevance: float
    redundancy: float
    score: float


def greedy(relevance: dict[str, float], ranks: Moments, k: int | None = None) -> list[Step]:
    """Take the best of relevance minus redundancy until k are chosen; ties go to the earlier name."""
    left, steps = list(relevance), []
    while left and (k is None or len(steps) < k):
        chosen = [s.feature for s in steps]
        options = [Step(c, relevance[c], r2, relevance[c] - r2)
                   for c in left for r2 in [rank_r2(ranks, c, chosen)]]
        best = max(options, key=lambda s: round(s.score, TIE_PLACES))
        steps.append(best)
        left.remove(best.feature)
    return steps


STEP_SCHEMA = ("position INT, feature STRING, relevance DOUBLE, redundancy DOUBLE, score DOUBLE")


def step_table(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    rows = [(i + 1, s.feature, float(s.relevance), float(s.redundancy), float(s.score))
            for i, s in enumerate(steps)]
    return df.sparkSession.createDataFrame(rows, STEP_SCHEMA)


def stability(orders: DataFrame, k: int) -> DataFrame:
    """From (seed, feature, position): how often in the top k, and the mean position."""
    return orders.groupBy("feature").agg(
        F.avg((F.col("position") <= k).cast("double")).alias("share_in_top_k"),
        F.avg("position").alias("mean_position"))


@dataclass(frozen=True)
class Ranking:
    """One stage's selection: its steps, and how repetitions ordered the features."""

    steps: list[Step]
    orders: dict[int, list[str]]

    @property
    def order(self) -> list[str]:
        return [s.feature for s in self.steps]

    def orders_table(self, df: DataFrame) -> DataFrame:
        rows = [(s, f, i + 1) for s, order in self.orders.items() for i, f in enumerate(order)]
        return df.sparkSession.createDataFrame(rows, "seed INT, feature STRING, position INT")


@dataclass(frozen=True)
class StageStatistics:
    """What every selection on one stage's rows starts from: information, and rank moments.

    `whole` is taken from all rows, `by_seed` from each repetition's share of
    them. Neither depends on which other features are candidates, so one
    computation serves all arms.
    """

    stage: str
    whole: dict[str, float]
    by_seed: dict[int, dict[str, float]]
    ranks: Moments

    def relevance(self, found: dict[str, float], names: Sequence[str]) -> dict[str, float]:
        values = {n: found[n] for n in names}
        top = max(values.values(), default=0.0)
        if self.stage == "count" and top > 0:
            return {n: v / top for n, v in values.items()}
        return values

    def select(self, names: Sequence[str]) -> Ranking:
        """Greedy order on the relevance over all rows, and on that of each repetition."""
        ranks = self.ranks.part(list(names))
        orders = {s: [step.feature for step in greedy(self.relevance(found, names), ranks)]
                  for s, found in self.by_seed.items()}
        return Ranking(greedy(self.relevance(self.whole, names), ranks), orders)


def repetition_mask(seeds: int, share: float, key: Sequence[str], number=draw_number) -> Column:
    """Bit s is set where repetition s reads the row: its draw number lies below the share."""
    keys = [F.col(k) for k in key]
    bits = [F.when(number(SEED + s, *keys) < F.lit(share * SPAN), F.lit(1 << s)).otherwise(F.lit(0))
            for s in range(seeds)]
    return sum(bits[1:], bits[0]) if bits else F.lit(0)


def repeated(table: DataFrame, seeds: int) -> DataFrame:
    """seed, feature, bin, label, n from a contingency table by `mask`; seed -1 holds all rows."""
    reads = F.filter(F.array(*[F.lit(s) for s in range(-1, seeds)]), lambda s: (s < 0) | (
        F.col("mask").bitwiseAND(F.element_at(F.array(*[F.lit(1 << max(i, 0)) for i in range(-1, seeds)]), s + 2)) > 0))
    return (table.select(F.explode(reads).alias("seed"), "feature", "bin", "label", "n")
            .groupBy("seed", "feature", "bin", "label").agg(F.sum("n").alias("n")))


def stage_statistics(df: DataFrame, features: Sequence[str], stage: str, key: Sequence[str],
                     seeds: int = SEEDS, share: float = REPEAT_SHARE, bins: int = BINS,
                     number=draw_number, **limits: int) -> StageStatistics:
    """Information over all rows and over each repetition's share of them, and rank moments over all rows.

    `df` has the key, the features and the target; the count stage sees rows
    with events only. One aggregate, with the repetitions a row belongs to as
    part of its key, counts for all of them, however many there are.
    """
    rows = df if stage == "occurrence" else df.filter(F.col(TARGET) > 0)
    level = F.log1p(F.col(TARGET).cast("double")).alias("_level")
    columns = [F.col(f) for f in features] + ([level] if stage != "occurrence" else [])
    counted = ordering.counted_values(rows.select(*columns), [*features, *(["_level"] if stage != "occurrence" else [])],
                                      limits.get("broadcast_values", ordering.BROADCAST_VALUES))
    packed = ordering.packed_rows(rows, list(dict.fromkeys(features)), counted, limits.get("slice_rows", ordering.SLICE_ROWS))
    edges = bin_edges(rows, features, bins, counted, packed)
    masked = rows.withColumn("mask", repetition_mask(seeds, share, key, number))
    if stage == "occurrence":
        label = (F.col(TARGET) > 0).cast("int")
    else:
        label = bin_number(F.log1p(F.col(TARGET).cast("double")), bin_edges(rows.select(level), ["_level"], bins, counted)["_level"])
    counts = repeated(contingency(masked, edges, label, ["mask"]), seeds)
    information = (uncertainty_removed(counts, ["seed"]) if stage == "occurrence" else
                   mutual_information(counts, ["seed"]).withColumnRenamed("mi", "relevance"))
    found: dict[int, dict[str, float]] = {s: dict.fromkeys(features, 0.0) for s in range(-1, seeds)}
    for r in information.collect():  # seeds x features
        found[r["seed"]][r["feature"]] = r["relevance"]
    ranks = rank_moments(rows, features, key, counted, packed, **limits)
    return StageStatistics(stage, found.pop(-1), found, ranks)


def rank_stage(df: DataFrame, features: Sequence[str], stage: str, key: Sequence[str], **options) -> Ranking:
    return stage_statistics(df, features, stage, key, **options).select(features)


def compare_stages(selected: DataFrame) -> DataFrame:
    """From (arm, stage, feature): features of both stages and of one only."""
    of = lambda stage: selected.filter(F.col("stage") == stage).select("arm", "feature")
    occurrence, count = of("occurrence"), of("count")
    label = lambda df, name: df.withColumn("found_in", F.lit(name))
    return (label(occurrence.intersect(count), "both")
            .unionByName(label(occurrence.exceptAll(count), "occurrence"))
            .unionByName(label(count.exceptAll(occurrence), "count")))


def top(orders: DataFrame, k: int) -> DataFrame:
    return orders.filter(F.col("position") <= k)
