"""Order statistics that never put one whole column, or one hot key, in one task.

Rows first collapse to (value, count). Where the distinct values may still be
many, a small sample cuts every column into slices of about equal size; running
totals are then taken inside a slice and shifted by the totals of the slices
before it. The sample only decides where the cuts lie, never a result. Small
columns have a single slice and need no sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import portable
from .moments import Moments
from .narrowing import Between, order_statistics
from .packed_ranks import Packed, pack, rank_products

portable(__name__)

SLICE_ROWS = 250_000
MAX_SLICES = 4096
SAMPLE_PER_SLICE = 100
BROADCAST_VALUES = 1_000_000

Slices = dict[str, list[float]]


def slice_bounds(df: DataFrame, columns: Sequence[str], slice_rows: int = SLICE_ROWS,
                 rows: int | None = None) -> Slices:
    """Cut points per column, from the number of rows; small tables get none."""
    rows = df.count() if rows is None else rows
    if rows <= slice_rows:
        return {}
    held = df.agg(*[F.count(F.col(c)).alias(c) for c in columns]).first()
    parts = {c: min(MAX_SLICES, math.ceil(held[c] / slice_rows)) for c in columns}
    large = {c: p for c, p in parts.items() if p > 1}
    if not large:
        return {}
    fraction = min(1.0, SAMPLE_PER_SLICE * max(large.values()) / rows)
    # At most MAX_SLICES * SAMPLE_PER_SLICE rows are expected here, however large the table.
    sample = (df.select(*[F.col(c).cast("double").alias(c) for c in large])
              .sample(fraction=fraction, seed=len(large)).toPandas())
    bounds = {}
    for c, p in large.items():
        seen = sample[c].dropna().to_numpy()
        cuts = np.quantile(seen, np.arange(1, p) / p) if len(seen) else []
        bounds[c] = sorted({float(v) for v in cuts})
    return {c: b for c, b in bounds.items() if b}


def with_slices(df: DataFrame, bounds: Slices, suffix: str = "__slice") -> DataFrame:
    """Add one slice number per cut column."""
    if not bounds:
        return df
    names = list(bounds)
    inf = float("inf")
    buckets = Bucketizer(inputCols=names, outputCols=[f"{c}{suffix}" for c in names],
                         splitsArray=[[-inf, *bounds[c], inf] for c in names],
                         handleInvalid="keep")
    return buckets.transform(df)


def named(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Column numbers back to their names."""
    names = F.array(*map(F.lit, columns))
    return df.withColumn("column", F.element_at(names, F.col("column") + 1))


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (),
              bounds: Slices | None = None) -> DataFrame:
    """One row per (row, column) with a non-null value: keep..., column number, value, slice.

    Numbers sort and shuffle far faster than names; `named` puts the names back.
    """
    bounds = bounds or {}
    sliced = with_slices(df, bounds)
    cells = F.array(*[
        F.struct(F.lit(columns.index(c)).alias("column"), F.col(c).cast("double").alias("value"),
                 (F.coalesce(F.col(f"{c}__slice").cast("int"), F.lit(0)) if c in bounds
                  else F.lit(0)).alias("slice"))
        for c in columns])
    return (sliced.select(*keep, F.explode(cells).alias("cell"))
            .select(*keep, "cell.*").filter(F.col("value").isNotNull()))


def value_counts(df: DataFrame, columns: Sequence[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """column, slice, value, n — the shared input of every whole-column statistic."""
    return named(_numbered_counts(df, columns, slice_bounds(df, columns, slice_rows)), columns)


def _numbered_counts(df: DataFrame, columns: Sequence[str], bounds: Slices) -> DataFrame:
    return (long_form(df, columns, bounds=bounds)
            .groupBy("column", "slice", "value").agg(F.count(F.lit(1)).alias("n")))


def running_totals(counts: DataFrame, keys: Sequence[str], sums: Sequence[str],
                   order: str = "value", sliced: bool = True) -> DataFrame:
    """Add `<s>_before` and `<s>_total` for every column to sum, ascending by `order`.

    `sliced=False` promises that each key has one slice.
    """
    keys = list(keys)
    inside = keys + (["slice"] if sliced else [])
    ahead = (Window.partitionBy(*inside).orderBy(order)
             .rowsBetween(Window.unboundedPreceding, -1))
    local = {f"{s}_before": F.coalesce(F.sum(s).over(ahead), F.lit(0)) for s in sums}
    if not sliced:
        whole = (Window.partitionBy(*keys).orderBy(order)
                 .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return counts.withColumns({**local, **{f"{s}_total": F.sum(s).over(whole) for s in sums}})

    slices = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = (Window.partitionBy(*keys).orderBy("slice")
             .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    offsets = counts.groupBy(*inside).agg(*[F.sum(s).alias(f"{s}_here") for s in sums])
    offsets = offsets.select(*inside, *[
        F.coalesce(F.sum(f"{s}_here").over(slices), F.lit(0)).alias(f"{s}_shift") for s in sums
    ], *[F.sum(f"{s}_here").over(whole).alias(f"{s}_total") for s in sums])
    joined = counts.withColumns(local).join(offsets, inside)
    return joined.withColumns({
        f"{s}_before": F.col(f"{s}_before") + F.col(f"{s}_shift") for s in sums
    }).drop(*[f"{s}_shift" for s in sums])


def column_totals(df: DataFrame, columns: Sequence[str], slice_rows: int = SLICE_ROWS,
                  rows: int | None = None) -> DataFrame:
    """value_counts with running totals: column, value, n, n_before, n_total."""
    bounds = slice_bounds(df, columns, slice_rows, rows)
    counts = _numbered_counts(df, columns, bounds)
    return named(running_totals(counts, ["column"], ["n"], sliced=bool(bounds)), columns)


def at_rank(position: Column, before: Column, value: Column) -> Column:
    """Aggregate: the value holding a zero-based rank in ascending order."""
    return F.max(F.when(before <= position, value))


def interpolated(p: float, value: str = "value", before: str = "n_before",
                 total: str = "n_total") -> Column:
    """Aggregate: linearly interpolated quantile over running totals."""
    position = F.lit(float(p)) * (F.col(total) - 1)
    low = at_rank(F.floor(position), F.col(before), F.col(value))
    high = at_rank(F.ceil(position), F.col(before), F.col(value))
    part = F.max(position - F.floor(position))
    return low + (high - low) * part


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    """Exact quantiles on the driver: one short list per column."""
    found = order_statistics(df, columns, probs)
    return {c: [b.value for b in found[c]] if found[c] else [None] * len(probs) for c in columns}


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int = SLICE_ROWS) -> DataFrame | None:
    """Keys with more than `limit` rows, or None when there are none."""
    if df.count() <= limit:
        return None
    hot = df.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys)
    return None if hot.isEmpty() else hot


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    slice_rows: int = SLICE_ROWS) -> DataFrame:
    """keys, q for groups of any size: sliced running totals instead of one buffer per group.

    The slices come from the whole column, so no (group, slice) exceeds a slice.
    """
    keys = list(keys)
    bounds = slice_bounds(df, [value], slice_rows)
    counts = (long_form(df, [value], keep=keys, bounds=bounds)
              .groupBy(*keys, "slice", "value").agg(F.count(F.lit(1)).alias("n")))
    totals = running_totals(counts, keys, ["n"], sliced=bool(bounds))
    return totals.groupBy(*keys).agg(F.array(*[interpolated(p) for p in probs]).alias("q"))


def average_ranks(df: DataFrame, columns: Sequence[str], slice_rows: int = SLICE_ROWS,
                  rows: int | None = None) -> DataFrame:
    """column, value, n, rank — tied values share the mean of their ranks."""
    totals = column_totals(df, columns, slice_rows, rows)
    return totals.select("column", "value", "n",
                         (F.col("n_before") + (F.col("n") + 1) / 2).alias("rank"))


@dataclass(frozen=True)
class Counted:
    """Sorted values of each column that has few of them, and how many rows hold each; `many` names the other columns."""

    values: dict[str, np.ndarray]
    counts: dict[str, np.ndarray]
    many: list[str]
    rows: int

    def ranks(self, column: str) -> np.ndarray:
        """The average rank of each value."""
        n = self.counts[column]
        return np.cumsum(n) - (n - 1) / 2

    def quantiles(self, column: str, probs: Sequence[float]) -> list[float | None]:
        """Exact quantiles, as `quantiles` finds them; NaN is no value."""
        known = ~np.isnan(self.values[column])
        values, upto = self.values[column][known], np.cumsum(self.counts[column][known])
        if not len(values):
            return [None] * len(probs)
        at = lambda rank: float(values[np.searchsorted(upto, rank, side="right")])
        places = [p * (int(upto[-1]) - 1) for p in probs]
        return [Between(at(math.floor(x)), at(math.ceil(x)), x - math.floor(x)).value for x in places]


def _added(parts: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different values, ascending, and their counts in all parts together."""
    values, at = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    counts = np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(values))
    return values, counts.astype(np.int64)


def counted_values(df: DataFrame, columns: Sequence[str], broadcast_values: int = BROADCAST_VALUES) -> Counted:
    """Values and counts of the columns with few distinct ones: at most `broadcast_values` of them all together.

    A task counts the values of its batches and gives up on the columns with most while it holds more than that.
    """
    names = list(dict.fromkeys(columns))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {i: (np.zeros(0), np.zeros(0, dtype=np.int64)) for i in range(len(names))}
        fresh: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {i: [] for i in held}
        waiting, rows = dict.fromkeys(held, 0), 0

        def settle(i: int) -> None:
            held[i], fresh[i], waiting[i] = _added([held[i], *fresh[i]]), [], 0
            while sum(len(v) for v, _ in held.values()) > broadcast_values:
                del held[max(held, key=lambda j: len(held[j][0]))]

        for batch in batches:
            rows += batch.num_rows
            for i in list(held):
                if i not in held:
                    continue
                column = batch.column(i)
                values = (column.drop_null() if column.null_count else column).to_numpy(zero_copy_only=False)
                fresh[i].append(np.unique(values + 0.0, return_counts=True))  # no negative zero
                waiting[i] += len(fresh[i][-1][0])
                if waiting[i] > max(1 << 16, len(held[i][0])):
                    settle(i)
        for i in list(held):
            if i in held and fresh[i]:
                settle(i)
        given = [i for i in range(len(names)) if i not in held]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *(-2 - i for i in given)], pa.int32()), pa.array([0.0] * (1 + len(given))),
                                          pa.array([rows, *[0] * len(given)], pa.int64())], names=["column", "value", "n"])
        for i, (values, counts) in held.items():
            for at in range(0, len(values), 1 << 16):
                part = values[at:at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), i, dtype=np.int32)), pa.array(part), pa.array(counts[at:at + len(part)])],
                                                 names=["column", "value", "n"])

    parts = (df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(names)])
             .mapInArrow(count, "column int, value double, n bigint").persist())
    kept = {r["column"]: r for r in parts.groupBy("column").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n")).collect()}
    sizes = {i: kept[i]["size"] if i in kept else 0 for i in range(len(names)) if -2 - i not in kept}
    total = (parts.filter(F.col("column").isin(*sizes)) if sizes else parts.limit(0)).groupBy("column", "value").agg(F.sum("n").alias("n"))
    if sum(sizes.values()) > broadcast_values:  # tasks met the same values, so there may be fewer
        sizes = dict.fromkeys(sizes, 0) | {r["column"]: r["count"] for r in total.groupBy("column").count().collect()}
    few, room = [], broadcast_values
    for i in sorted(sizes, key=lambda i: sizes[i]):
        if sizes[i] <= room:
            few.append(i)
            room -= sizes[i]
    values, counts = {}, {}
    if few:
        found = total.filter(F.col("column").isin(*few)).toArrow()
        column, value, n = (found.column(i).to_numpy() for i in range(3))
        order = np.lexsort((value, column))
        starts, ends = (np.searchsorted(column[order], few, side=side) for side in ("left", "right"))
        for i, start, end in zip(few, starts, ends):
            at = order[start:end]
            values[names[i]], counts[names[i]] = value[at], n[at]
    parts.unpersist()
    return Counted(values, counts, [c for i, c in enumerate(names) if i not in few], kept[-1]["n"] if -1 in kept else 0)


def packed_rows(df: DataFrame, columns: Sequence[str], counted: Counted, slice_rows: int = SLICE_ROWS) -> Packed | None:
    """The columns as blocks and slices where one of them has many distinct values."""
    if not set(columns).intersection(counted.many):
        return None
    return pack(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), columns,
                {c: counted.values[c] for c in columns if c not in counted.many}, counted.rows, slice_rows)


def rank_moments(df: DataFrame, columns: Sequence[str], counted: Counted | None = None, broadcast_values: int = BROADCAST_VALUES,
                 slice_rows: int = SLICE_ROWS, packed: Packed | None = None) -> Moments:
    """Moments of the average ranks over the rows where every column has a value; ranks are those in the whole column.

    Ranks of columns with few distinct values are looked up in each batch; the
    others are ranked by slices, see `packed_ranks`. Rows need no key.
    """
    names = list(dict.fromkeys(columns))
    counted = counted or counted_values(df, names, broadcast_values)
    known = {c: (counted.values[c], counted.ranks(c)) for c in names if c not in counted.many}
    k, origin = len(names), (counted.rows + 1) / 2
    packed = packed or packed_rows(df, names, counted, slice_rows)
    if packed:
        return _rank_moments_from(names, rank_products(packed, {c: ranks for c, (_, ranks) in known.items()}, origin), origin)
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    rows = numbers.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in names))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            x = np.ones((k + 1, batch.num_rows))
            for i, c in enumerate(names):
                values, ranks = known[c]
                x[i + 1] = ranks[np.searchsorted(values, batch.column(i).to_numpy(zero_copy_only=False))] - origin
            total += x @ x.T
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "v"])

    cells = (rows.select(*names).mapInArrow(products, "at bigint, v double")
             .groupBy("at").agg(F.sum("v").alias("v")).collect())
    full = np.zeros((k + 1) ** 2)
    for cell in cells:
        full[cell["at"]] = cell["v"]
    return _rank_moments_from(names, full.reshape(k + 1, k + 1), origin)


def _rank_moments_from(names: list[str], full: np.ndarray, origin: float) -> Moments:
    n, k = int(round(full[0, 0])), len(names)
    if n == 0:
        return Moments(names, 0, np.zeros(k), np.zeros((k, k)))
    mean = full[0, 1:] / n
    return Moments(names, n, mean + origin, full[1:, 1:] / n - np.outer(mean, mean))


def with_ranks(df: DataFrame, columns: Sequence[str], key: Sequence[str], suffix: str = "__rank",
               broadcast_values: int = BROADCAST_VALUES, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Every row with the average rank of each named column.

    Columns with few distinct values (counted first) join broadcast rank tables
    of at most `broadcast_values` rows all together. The others go through one long shuffle and come back by `key`,
    which must tell rows apart up to equal values of these columns; values
    frequent enough to make a hot shuffle key are broadcast there as well.
    """
    sizes = df.agg(F.count(F.lit(1)).alias("n"),
                   *[F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(c))).alias(c) for c in columns]).first()
    few, room = [], broadcast_values
    for c in sorted(columns, key=lambda c: sizes[c]):
        if sizes[c] <= room:
            few.append(c)
            room -= sizes[c]
    many = [c for c in columns if c not in few]
    out = df
    if few:
        # At most `broadcast_values` rows, read once per column below.
        tables = average_ranks(df, few, max(slice_rows, sizes["n"]), sizes["n"]).persist()
        for c in few:
            one = tables.filter(F.col("column") == c).select(
                F.col("value").alias(f"_{c}"), F.col("rank").alias(f"{c}{suffix}"))
            out = out.join(F.broadcast(one), F.col(c).cast("double") == F.col(f"_{c}"), "left").drop(f"_{c}")
    if many:
        ranks = average_ranks(df, many, slice_rows, sizes["n"])
        hot_rows = max(slice_rows, sizes["n"] // 1000)
        hot = ranks.filter(F.col("n") > hot_rows)
        cells = named(long_form(df, many, keep=key), many)
        match = ["column", "value"]
        ranked = (cells.join(F.broadcast(hot), match)
                  .unionByName(cells.join(F.broadcast(hot.select(*match)), match, "left_anti")
                               .join(ranks.filter(F.col("n") <= hot_rows), match)))
        wide = ranked.groupBy(*key).agg(*[
            F.max(F.when(F.col("column") == c, F.col("rank"))).alias(f"{c}{suffix}") for c in many])
        out = out.join(wide, list(key), "left")
    return out


def extremes(counts: DataFrame, k: int) -> DataFrame:
    """The k lowest and k highest distinct values of each column, with their row counts."""
    low = Window.partitionBy("column").orderBy("value")
    high = Window.partitionBy("column").orderBy(F.desc("value"))
    pick = lambda window, end: (
        counts.select("column", "value", "n", F.row_number().over(window).alias("position"))
        .filter(F.col("position") <= k).withColumn("end", F.lit(end)))
    return pick(low, "lowest").unionByName(pick(high, "highest"))
