"""Baseline models: base rate, ridge, logistic regression, and the two-stage product."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.moments import Moments, moments
from ..session import portable

portable(__name__)

START_ROWS = 50_000
START_GROWTH = 32
CHUNK = 512  # rows of a batch that are worked on at a time; a product of so many numbers up to 2 does not overflow
BLOCK = 1 << 17
SLICE_ROWS = 500_000
MAX_SLICES = 1024
SAMPLE_PER_SLICE = 100


@dataclass(frozen=True)
class Linear:
    """Weights and intercept on named columns; scores as an expression."""

    names: list[str]
    weights: list[float]
    intercept: float
    link: str = "identity"

    def score(self) -> Column:
        out = F.lit(float(self.intercept))
        for n, w in zip(self.names, self.weights):
            out = out + F.col(n) * F.lit(float(w))
        if self.link == "logit":
            return F.lit(1.0) / (F.lit(1.0) + F.exp(-out))
        return out

    @property
    def n_params(self) -> int:
        return len(self.weights) + 1


def base_rate(train: DataFrame, target: str) -> Linear:
    """The training mean for every row."""
    return Linear([], [], float(train.agg(F.avg(target)).first()[0]))


def ridge_from(m: Moments, names: Sequence[str], target: str, alpha: float = 1.0) -> Linear:
    """Ridge with a free intercept, solved exactly from moments of the training rows."""
    if m.n == 0:
        raise ValueError("no complete rows to fit on")
    x, y = m.part(list(names)), m.names.index(target)
    at = [m.names.index(c) for c in names]
    gram = x.cov * m.n
    cross = m.cov[at, y] * m.n
    weights = np.linalg.solve(gram + alpha * np.eye(len(at)), cross) if at else np.zeros(0)
    return Linear(list(names), weights.tolist(), float(m.mean[y] - x.mean @ weights))


def ridge(train: DataFrame, names: Sequence[str], target: str, alpha: float = 1.0) -> Linear:
    """One pass of sums, then a solve of the size of the feature list."""
    return ridge_from(moments(train, [*names, target]), names, target, alpha)


def linear_r2(model: Linear, test: Moments, target: str) -> float | None:
    """R-squared of a linear model on rows known by their moments only."""
    y = test.names.index(target)
    at = [test.names.index(c) for c in model.names]
    w = np.array(model.weights)
    bias = float(test.mean[y] - (test.mean[at] @ w + model.intercept))
    var = test.cov[y, y]
    error = var - 2 * w @ test.cov[at, y] + w @ test.cov[np.ix_(at, at)] @ w + bias ** 2
    return float(1 - error / var) if var > 0 else None


def logistic(train: DataFrame, names: Sequence[str], target: str, c: float = 1.0) -> Linear:
    """Logistic regression with a free intercept; the penalty is half the squared weights against C times the log loss."""
    return logistic_fits(train, [names], target, c)[0]


@dataclass
class _Ascent:
    """One fit on its way: the best point so far, the way on from it, and how much of that way is tried."""

    at: list[int]  # columns, the intercept last
    best: np.ndarray
    way: np.ndarray
    share: float = 0.0
    loss: float = np.inf
    done: bool = False
    hessian: np.ndarray | None = None
    stale: bool = True  # whether the next pass has to add up the Hessian
    size: float = 0.0

    @property
    def tried(self) -> np.ndarray:
        return self.best + self.share * self.way

    def take(self, loss: float, gradient: np.ndarray, hessian: np.ndarray | None, c: float, tolerance: float) -> None:
        """Accept the point tried, or halve the step; then look for the next one by Newton's rule.

        Near the end the Hessian hardly changes, so the last one serves while each step is far shorter than the one
        before; a step is the last one when what it is expected to leave lies below the tolerance.
        """
        point, free = self.tried, np.append(np.ones(len(self.at) - 1), 0.0) / c
        loss += 0.5 * float(point @ (free * point))
        if loss > self.loss + 1e-12 * abs(self.loss):
            self.share /= 2
            self.done = self.share < 1e-9
            return
        self.best, self.loss, self.share = point, loss, 1.0
        if hessian is not None:
            self.hessian = hessian + np.diag(free)
        slope = gradient + free * point
        self.way = -np.linalg.lstsq(self.hessian, slope, rcond=None)[0]
        gain, size = -float(slope @ self.way), float(np.abs(self.way).max())
        shorter, self.size = size / self.size if self.size else 1.0, size
        self.stale = gain > 1e-6 * abs(loss) or (hessian is None and shorter > 0.1)
        self.done = size < tolerance or gain < 1e-18 * max(1.0, abs(loss))
        if not self.done and shorter < 0.1 and size * shorter < tolerance:
            self.best, self.done = point + self.way, True


def logistic_fits(train: DataFrame, subsets: Sequence[Sequence[str]], target: str, c: float = 1.0,
                  tolerance: float = 1e-9, max_steps: int = 60, start_rows: int = START_ROWS) -> list[Linear]:
    """One logistic fit for each set of features, over the rows where all features have a value.

    All fits take their Newton steps together: a step is one pass, in which every task adds up loss, gradient and,
    where a fit needs a new one, Hessian of every fit as matrix products of its batches. So the number of jobs depends
    on the steps, some ten, and not on the number of fits; what a task hands on depends on the features only.

    Above some `start_rows` rows the steps set out from the fits of a sample of about so many, and those of a very large
    table from the fits of a second sample of START_GROWTH times as many; their penalty is as strong beside the loss of
    a row. It only saves steps: the fits end where all rows put them.
    """
    names = list(dict.fromkeys(n for s in subsets for n in s))
    rows = train.select(*[F.col(n).cast("double").alias(n) for n in names], F.col(target).cast("double").alias("_target")).na.drop()
    at = [[*(names.index(n) for n in s), len(names)] for s in subsets]
    start, total = [np.zeros(len(places)) for places in at], rows.count()
    larger = start_rows * START_GROWTH
    wide = rows.sample(fraction=larger / total, seed=len(names)).persist() if total > 4 * larger else None
    if total > 4 * start_rows:
        share = start_rows / (larger if wide is not None else total)
        sample = (rows if wide is None else wide).sample(fraction=share, seed=len(names) + (wide is not None)).persist()
        for near, held in ((1e-3, sample), (1e-4, wide)):
            if held is not None and held.count():
                start = [f.best for f in _ascend(held, at, start, c * total / held.count(), near, max_steps)]
                held.unpersist()
    fits = _ascend(rows, at, start, c, tolerance, max_steps)
    return [Linear(list(s), f.best[:-1].tolist(), float(f.best[-1]), "logit") for s, f in zip(subsets, fits)]


def _ascend(rows: DataFrame, places: Sequence[list[int]], start: Sequence[np.ndarray], c: float,
            tolerance: float, max_steps: int) -> list[_Ascent]:
    """The fits after their Newton steps from `start`; the target is the last column of `rows`."""
    width = len(rows.columns)
    fits = [_Ascent(at, point, np.zeros(len(at))) for at, point in zip(places, start)]
    ends = np.cumsum([0, *range(width, 0, -1)])  # of the products of a column with itself and those after it
    for _ in range(max_steps):
        live = sorted((f for f in fits if not f.done), key=lambda f: not f.stale)
        if not live:
            break
        points, bent = np.zeros((len(live), width)), sum(f.stale for f in live)
        for i, f in enumerate(live):
            points[i, f.at] = f.tried

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, slopes, bends = np.zeros(len(points)), np.zeros((len(points), width)), np.zeros((bent, ends[-1]))
            products, n = np.empty((ends[-1], CHUNK)), 0
            for batch in batches:
                n += batch.num_rows
                rows = np.ones((width, batch.num_rows))
                for i in range(width - 1):
                    rows[i] = batch.column(i).to_numpy(zero_copy_only=False)
                hits = batch.column(width - 1).to_numpy(zero_copy_only=False)
                for first in range(0, batch.num_rows, CHUNK):
                    x, y = np.ascontiguousarray(rows[:, first:first + CHUNK]), hits[first:first + CHUNK]
                    z = points @ x
                    above, size = z >= 0, np.abs(z)
                    loss += (np.abs(above - y) * size).sum(axis=1)  # only what lies on the wrong side: nothing cancels
                    small = np.exp(np.negative(size, out=size), out=size)  # at most 1, so nothing overflows
                    whole = small + 1.0
                    loss += np.log(whole.prod(axis=1))
                    far = np.divide(1.0, whole, out=whole)  # the likelier side of each row, then the other
                    near = np.multiply(small, far, out=small)
                    slopes += (np.where(above, far, near) - y) @ x.T
                    if bent:
                        for i in range(width):
                            np.multiply(x[i], x[i:], out=products[ends[i]:ends[i + 1], :len(y)])
                        bends += (near[:bent] * far[:bent]) @ products[:, :len(y)].T
            flat = np.concatenate([[n], loss, slopes.ravel(), bends.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "v"])

        found = rows.mapInArrow(sums, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
        flat = found.sort_values("at")["v"].to_numpy()
        if not len(flat) or flat[0] == 0:
            raise ValueError("no complete rows to fit on")
        losses, slopes, bends = np.split(flat[1:], np.cumsum([len(live), len(live) * width]))
        first, second = np.triu_indices(width)
        for i, f in enumerate(live):
            hessian = None
            if i < bent:
                hessian = np.zeros((width, width))
                hessian[first, second] = hessian[second, first] = bends.reshape(bent, -1)[i]
                hessian = hessian[np.ix_(f.at, f.at)]
            f.take(float(losses[i]), slopes.reshape(len(live), -1)[i, f.at], hessian, c, tolerance)
    return fits


def standardiser(train: DataFrame, names: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population spread per column; a column without spread keeps its scale."""
    found = train.agg(*[a for n in names for a in (F.avg(n), F.stddev_pop(n))]).first()
    return {n: (float(found[2 * i]), float(found[2 * i + 1]) or 1.0) for i, n in enumerate(names)}


def standardised(rows: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    return rows.withColumns({n: (F.col(n) - F.lit(m)) / F.lit(s) for n, (m, s) in scale.items()})


def _terms(fits: Sequence[Linear]) -> tuple[list[str], list[tuple[float, list[tuple[int, float]]]]]:
    """All features of the fits, and for each fit its intercept and its weights by the place of their feature."""
    names = list(dict.fromkeys(n for f in fits for n in f.names))
    return names, [(float(f.intercept), [(names.index(n), float(w)) for n, w in zip(f.names, f.weights)]) for f in fits]


def _logits(columns: Sequence[np.ndarray], rows: int, intercept: float, weights: Sequence[tuple[int, float]]) -> np.ndarray:
    z, part = np.full(rows, intercept), np.empty(rows)  # summed in order, so that equal rows score alike
    for at, w in weights:
        z += np.multiply(columns[at], w, out=part)
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-z))


def scores(rows: DataFrame, fits: Sequence[Linear], label: str) -> DataFrame:
    """label, fit (its number) and score of every row by every logistic fit; null where a feature is."""
    names, terms = _terms(fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))]
            gone = [batch.column(i).is_null().to_numpy(zero_copy_only=False) for i in range(len(names))]
            for i, (intercept, weights) in enumerate(terms):
                absent = np.zeros(batch.num_rows, dtype=bool)
                for at, _ in weights:
                    absent |= gone[at]
                score = _logits(columns, batch.num_rows, intercept, weights)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(len(names)), pa.array(np.full(batch.num_rows, i, dtype=np.int32)), pa.array(score, mask=absent)],
                    names=[label, "fit", "score"])

    return rows.select(*[F.col(n).cast("double").alias(n) for n in names], label).mapInArrow(
        run, f"{label} int, fit int, score double")


def _score_blocks(batches: Iterator[pa.RecordBatch], terms: Sequence[tuple[float, list[tuple[int, float]]]],
                  width: int, block: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """fit, scores of rows with a hit, scores of the others, for blocks of some rows; rows without a score are left out.

    The label is the last column; a null one is no hit. NaN comes last, as in Spark's order: it is 2 here, above all scores.
    """
    def blocks() -> Iterator[list[pa.RecordBatch]]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= block:
                yield held
                held = []
        if held:
            yield held

    for held in blocks():
        parts, hits, gone = [], [], []
        for batch in held:
            parts.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)])
            gone.append([batch.column(i).is_null().to_numpy(zero_copy_only=False) if batch.column(i).null_count else None
                         for i in range(width)])
            hits.append(batch.column(width).fill_null(0).to_numpy(zero_copy_only=False) > 0)
        for i, (intercept, weights) in enumerate(terms):
            hit, miss = [], []
            for columns, flashed, absent in zip(parts, hits, gone):
                score = _logits(columns, len(flashed), intercept, weights)
                score[np.isnan(score)] = 2.0
                known = np.ones(len(flashed), dtype=bool)
                for at, _ in weights:
                    if absent[at] is not None:
                        known &= ~absent[at]
                hit.append(score[flashed & known])
                miss.append(score[~flashed & known])
            yield i, np.concatenate(hit), np.concatenate(miss)


def score_cuts(rows: DataFrame, fits: Sequence[Linear], slice_rows: int = SLICE_ROWS) -> list[np.ndarray]:
    """For each fit, scores that cut the rows into slices of about `slice_rows`; they come from a sample and decide no result."""
    names, terms = _terms(fits)
    total = rows.count()
    parts = min(MAX_SLICES, -(-total // slice_rows))
    if parts <= 1:
        return [np.zeros(0) for _ in fits]
    # At most MAX_SLICES * SAMPLE_PER_SLICE rows are expected here, however large the table.
    seen = rows.select(*[F.col(n).cast("double").alias(n) for n in names]).sample(
        fraction=min(1.0, SAMPLE_PER_SLICE * parts / total), seed=parts).toPandas()
    columns, cuts = [seen[n].to_numpy(dtype=float) for n in names], []
    for intercept, weights in terms:
        score = _logits(columns, len(seen), intercept, weights)
        score = score[~np.isnan(score)]
        cuts.append(np.unique(np.quantile(score, np.arange(1, parts) / parts)) if len(score) else np.zeros(0))
    return cuts


def slice_sizes(rows: DataFrame, fits: Sequence[Linear], label: str, cuts: Sequence[np.ndarray], block: int = BLOCK) -> np.ndarray:
    """Rows by fit, slice of its score (ascending), and whether the label says hit (1) or not (0)."""
    names, terms = _terms(fits)
    parts = max((len(c) for c in cuts), default=0) + 1
    shape = (len(fits), parts, 2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros(shape, dtype=np.int64)
        for i, hit, miss in _score_blocks(batches, terms, len(names), block):
            for side, values in enumerate((miss, hit)):
                sizes[i, :, side] += np.bincount(np.searchsorted(cuts[i], values, side="right"), minlength=parts)
        at = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sizes.ravel()[at])], names=["at", "n"])

    found = (rows.select(*[F.col(n).cast("double").alias(n) for n in names], F.col(label).cast("int").alias(label))
             .mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas())
    sizes = np.zeros(int(np.prod(shape)), dtype=np.int64)
    sizes[found["at"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return sizes.reshape(shape)


PACKED = "fit int, slice int, hits binary, hit_counts binary, misses binary, miss_counts binary"


def sliced_scores(rows: DataFrame, fits: Sequence[Linear], label: str, cuts: Sequence[np.ndarray], block: int = BLOCK) -> DataFrame:
    """Scores of all fits as PACKED: for each block of rows, fit and slice, the different scores of hits and of other rows.

    A score is eight bytes here, not a row; how many rows have each is given only where some have the same.
    """
    names, terms = _terms(fits)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, *sides in _score_blocks(batches, terms, len(names), block):
            columns: list[list[bytes]] = []
            for values in sides:
                values, counts = _distinct(np.sort(values))
                ends = [0, *np.searchsorted(values, cuts[i], side="left"), len(values)]
                bounds = list(zip(ends, ends[1:]))
                columns.append([values[a:b].tobytes() for a, b in bounds])
                columns.append([b"" if (counts[a:b] == 1).all() else counts[a:b].tobytes() for a, b in bounds])
            held = [s for s in range(len(cuts[i]) + 1) if columns[0][s] or columns[2][s]]
            if held:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(held), pa.int32()), pa.array(held, pa.int32()), *[pa.array([c[s] for s in held], pa.binary()) for c in columns]],
                    names=["fit", "slice", "hits", "hit_counts", "misses", "miss_counts"])

    return rows.select(*[F.col(n).cast("double").alias(n) for n in names], F.col(label).cast("int").alias(label)).mapInArrow(pack, PACKED)


def _distinct(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of an ascending array, and how often each comes."""
    if not len(ordered):
        return ordered, np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[starts], np.diff(np.append(starts, len(ordered)))


def unpacked(values: Sequence[bytes], counts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The different scores of several blocks, ascending, and how many rows have each."""
    found = [np.frombuffer(v) for v in values]
    every = np.concatenate([np.zeros(0), *found])
    if not any(counts):
        return _distinct(np.sort(every))
    weights = np.concatenate([np.frombuffer(c, dtype=np.int64) if c else np.ones(len(v), dtype=np.int64) for v, c in zip(found, counts)])
    order = np.argsort(every, kind="stable")
    ordered, upto = every[order], np.cumsum(weights[order])
    different, times = _distinct(ordered)
    return different, np.diff(upto[np.cumsum(times) - 1], prepend=0)


def bounded(score: Column, stage: str) -> Column:
    """Occurrence scores are kept within 0..1; counts stay on the model's scale."""
    return F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)) if stage == "occurrence" else score


def predict(rows: DataFrame, model: Linear, stage: str = "count", output: str = "predicted") -> DataFrame:
    return rows.withColumn(output, bounded(model.score(), stage))


def predict_foreign(rows: DataFrame, names: Sequence[str], score: Callable[[np.ndarray], np.ndarray],
                    stage: str = "count", output: str = "predicted", batch: int = 512) -> DataFrame:
    """Scores of a model Spark cannot express, in batches inside each task."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {output} double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = frame[list(names)].to_numpy(dtype=float)
            parts = [np.asarray(score(x[i:i + batch]), dtype=float) for i in range(0, len(x), batch)]
            value = np.concatenate(parts) if parts else np.empty(0)
            yield frame.assign(**{output: np.clip(value, 0.0, 1.0) if stage == "occurrence" else value})

    return rows.mapInPandas(run, schema)


def hurdle(occurrence: DataFrame, count: DataFrame, keys: Sequence[str],
           probability: str = "p_occurrence", expected: str = "count_given_occurrence") -> DataFrame:
    """Expected count: probability of an event times its size; both on the raw scale, same rows."""
    joined = occurrence.select(*keys, probability).join(count.select(*keys, expected), list(keys))
    return joined.withColumn("predicted", F.col(probability) * F.col(expected))


