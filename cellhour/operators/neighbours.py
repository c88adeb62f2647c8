"""Mutual information from nearest neighbours, against a class or against a second continuous side.

Values first go to whole numbers on a fine grid, so that distances are exact, and
equal rows collapse to one row with a count. Both estimators then need two
things, and neither needs a window over a whole column or a pair of all rows:

* the distance to the k-th nearest neighbour. On one axis it lies among the k
  different values to either side: rows are cut into ranges, and the k values
  that lie before and after a range travel with it (its halo). On two axes rows
  are cut into cells of about equal size, a cell finds its own k nearest, and a
  row whose square pokes out of its cell is asked again in the cells it touches;
* how many rows lie closer than that on one axis: a difference of two running
  totals, looked up at both ends among range-cut totals.

Ranges and cells are cut by Spark's range partitioning and fixed by writing them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import TARGET
from ..session import scratch

NEIGHBOURS = 3
RESOLUTION_BITS = 30
ROWS_PER_CELL = 20_000
MOST_CELLS = 1 << 16


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, so that every later job sees the same cuts."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def digamma(n: Column) -> Column:
    """Digamma of a whole number of at least 1: six steps up, then the asymptotic series."""
    x = n + F.lit(6.0)
    series = F.log(x) - 0.5 / x - 1.0 / (12.0 * x ** 2) + 1.0 / (120.0 * x ** 4) - 1.0 / (252.0 * x ** 6)
    return series - sum((1.0 / (n + F.lit(float(i))) for i in range(1, 6)), 1.0 / n)


def grid_step(sd: float, largest: float, mantissa_bits: int = 0) -> float:
    """Width of the grid for a column of this spread: its spread to so many binary places, over 2^30.

    It is never so fine that the largest value would need more than 52 bits.
    """
    power = 2.0 ** np.floor(np.log2(sd)) if sd > 0 else 0.0
    fine = np.floor(sd / power * 2 ** mantissa_bits) / 2 ** mantissa_bits * power * 2.0 ** -RESOLUTION_BITS if power else 0.0
    return float(max(fine, largest * 2.0 ** -52)) or 1.0


def on_grid(df: DataFrame, columns: Sequence[str], mantissa_bits: int = 0) -> dict[str, Column]:
    """Each column as whole grid steps."""
    known = df.agg(*[f.alias(f"{c}{end}") for c in columns for f, end in (
        (F.stddev_pop(c), "_sd"), (F.max(F.abs(c)).cast("double"), "_top"))]).first()
    return {c: F.floor(F.col(c).cast("double") / F.lit(grid_step(known[f"{c}_sd"] or 0.0, known[f"{c}_top"] or 0.0, mantissa_bits)) + 0.5)
            for c in columns}


def cut(df: DataFrame, name: str, by: Sequence[str], parts: int | None = None) -> DataFrame:
    """The rows in ranges of `by`, with the number of their range as `name`; rows of equal `by` share one."""
    ranges = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    return written(ranges.withColumn(name, F.spark_partition_id()), name)


def totals_at(counts: DataFrame, asked: DataFrame, parts: int | None = None) -> DataFrame:
    """axis, position, upto: rows of `counts` (axis, value, n) whose value is at most each position asked (axis, position)."""
    both = counts.groupBy("axis", "value").agg(F.sum("n").alias("n")).unionByName(
        asked.select("axis", F.col("position").alias("value")).distinct().withColumn("n", F.lit(None).cast("long")))
    held = cut(both, "range", ["axis", "value"], parts)
    # A position follows the rows of its own value.
    inside = Window.partitionBy("axis", "range").orderBy("value", F.col("n").isNull()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("axis").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shift = held.groupBy("axis", "range").agg(F.sum("n").alias("here")).select(
        "axis", "range", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("shift"))
    local = held.withColumn("upto", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return local.where("n IS NULL").join(shift, ["axis", "range"]).select(
        "axis", F.col("value").alias("position"), (F.col("upto") + F.col("shift")).alias("upto"))


def closer(rows: DataFrame, counts: DataFrame, axis: str, value: str, out: str, parts: int | None = None) -> DataFrame:
    """`rows` with the number of rows nearer than `radius` on an axis, or equal to the value where that is none."""
    reach = F.greatest("radius", F.lit(1))
    ends = {"low": F.col(value) - reach, "high": F.col(value) + reach - 1}
    marked = rows.withColumns(ends)
    asked = marked.select(F.col(axis).alias("axis"), F.explode(F.array("low", "high")).alias("position"))
    found = totals_at(counts, asked, parts)
    for end in ends:
        at = found.select(F.col("axis").alias(axis), F.col("position").alias(end), F.col("upto").alias(f"{end}_upto"))
        marked = marked.join(at, [axis, end])
    return marked.withColumn(out, F.col("high_upto") - F.col("low_upto")).drop("low", "high", "low_upto", "high_upto")


def kth_on_axis(counts: DataFrame, groups: Sequence[str], k: int = NEIGHBOURS, parts: int | None = None) -> DataFrame:
    """`counts` (groups, value, n) with `size` of the group, `k` used and `radius`, the distance to the k-th other row.

    Groups of k rows or fewer use all others; groups of one row drop out.
    """
    groups = list(groups)
    sizes = counts.groupBy(*groups).agg(F.sum("n").alias("size"))
    held = cut(counts, "range", [*groups, "value"], parts)
    entry = F.struct("value", "n").alias("entry")
    inside = Window.partitionBy(*groups, "range")

    def edge(order: Column, beside: tuple[int, int], last_first: bool) -> DataFrame:
        """For every range, the k nearest entries beyond one of its ends: the k ranges there hold them."""
        near = held.withColumn("place", F.row_number().over(inside.orderBy(order))).where(F.col("place") <= k)
        per_range = near.groupBy(*groups, "range").agg(F.collect_list(entry).alias("entries"))
        around = Window.partitionBy(*groups).orderBy("range").rowsBetween(*beside)
        listed = F.array_sort(F.flatten(F.collect_list("entries").over(around)))
        kept = F.slice(F.reverse(listed) if last_first else listed, 1, k)
        return (per_range.withColumn("kept", kept).select(*groups, "range", F.explode("kept").alias("e"))
                .select(*groups, "range", "e.value", "e.n"))

    halo = edge(F.desc("value"), (-k, -1), True).unionByName(edge(F.asc("value"), (1, k), False)).withColumn("own", F.lit(False))
    rows = held.select(*groups, "range", "value", "n").withColumn("own", F.lit(True)).unionByName(halo)
    ordered = inside.orderBy("value")
    around = F.concat(F.collect_list(entry).over(ordered.rowsBetween(-k, -1)), F.collect_list(entry).over(ordered.rowsBetween(1, k)))
    near = F.array_sort(F.transform(around, lambda e: F.struct(
        F.abs(e["value"] - F.col("value")).alias("d"), F.least(e["n"], F.lit(k).cast("long")).alias("n"))))
    start = F.struct((F.col("n") - 1).alias("seen"), F.when(F.col("n") > F.col("k"), F.lit(0).cast("long")).alias("radius"))
    walked = F.aggregate("near", start, lambda s, e: F.struct(
        (s["seen"] + e["n"]).alias("seen"),
        F.coalesce(s["radius"], F.when(s["seen"] + e["n"] >= F.col("k"), e["d"])).alias("radius")))
    return (rows.withColumn("near", near).where("own").drop("own", "range")
            .join(sizes, groups).where("size > 1").withColumn("k", F.least(F.lit(k).cast("long"), F.col("size") - 1))
            .withColumn("radius", walked["radius"]).drop("near"))


def class_information(df: DataFrame, features: Sequence[str], label: Column, k: int = NEIGHBOURS,
                      parts: int | None = None) -> DataFrame:
    """feature, mi: information each feature holds about a class, over rows where it has a value.

    A row looks for its k-th neighbour within its own class and counts all rows that are nearer.
    """
    grid = on_grid(df, features)
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), grid[f].alias("value")) for f in features])
    counts = (df.select(label.alias("label"), F.explode(cells).alias("c")).select("label", "c.*")
              .where("value IS NOT NULL AND label IS NOT NULL").groupBy("feature", "label", "value").agg(F.count(F.lit(1)).alias("n")))
    counts = written(counts, "class-counts")
    rows = kth_on_axis(counts, ["feature", "label"], k, parts)
    whole = rows.select(F.col("feature").alias("axis"), "value", "n")
    met = closer(rows, whole, "feature", "value", "m", parts)
    n, mean = F.sum("n"), lambda c: F.sum(F.col("n") * c) / F.sum("n")
    mi = digamma(n) + mean(digamma(F.col("k"))) - mean(digamma(F.col("size"))) - mean(digamma(F.col("m")))
    return met.groupBy("feature").agg(F.greatest(mi, F.lit(0.0)).alias("mi"))


def nearest(px: np.ndarray, py: np.ndarray, qx: np.ndarray, qy: np.ndarray, limit: np.ndarray, k: int) -> np.ndarray:
    """For each query, the k smallest distances (larger of both sides) to the points, of those up to `limit`.

    Points come sorted by x. Queries walk away from their place to both sides until x alone is too far.
    """
    far = np.iinfo(np.int64).max
    best = np.full((len(qx), k), far, dtype=np.int64)
    for way in (1, -1):
        at = np.searchsorted(px, qx, side="left") - (way < 0)
        live = np.arange(len(qx))
        while len(live):
            at_live = at[live]
            inside = (at_live >= 0) & (at_live < len(px))
            live, at_live = live[inside], at_live[inside]
            dx = np.abs(px[at_live] - qx[live])
            go = dx <= np.minimum(best[live, -1], limit[live])
            live, at_live, dx = live[go], at_live[go], dx[go]
            d = np.maximum(dx, np.abs(py[at_live] - qy[live]))
            better = (d < best[live, -1]) & (d <= limit[live])
            rows = live[better]
            best[rows, -1] = d[better]
            best[rows] = np.sort(best[rows], axis=1)
            at[live] += way
    return best


def _sorted_points(part: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Points by x, each as often as it can matter among k others."""
    times = np.minimum(part["n"].to_numpy(np.int64), k + 1)
    order = np.argsort(part["x"].to_numpy(np.int64), kind="stable")
    return tuple(np.repeat(part[c].to_numpy(np.int64)[order], times[order]) for c in ("x", "y"))


def _chunks(rows: pd.DataFrame, size: int) -> Iterator[pd.DataFrame]:
    return (rows.iloc[i:i + size] for i in range(0, len(rows), size))


def cells_of(points: DataFrame, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """The points (feature, x, y, n) with their `cell`: bands of x, then ranges of y within a band."""
    n = points.count()
    cells = max(1, min(MOST_CELLS, -(-n // rows_per_cell)))
    bands = max(1, round(cells ** 0.5))
    banded = cut(points, "band", ["feature", "x", "y"], bands)
    return cut(banded, "cell", ["feature", "band", "y", "x"], cells).drop("band")


def kth_on_plane(points: DataFrame, k: int = NEIGHBOURS, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """Different points (feature, x, y, n) with `radius`: the distance, the larger of both sides, to the k-th other row."""
    held = cells_of(points, rows_per_cell)
    far = int(np.iinfo(np.int64).max)
    kind = "feature string, x long, y long, n long, cell int, best array<long>"

    def own(part: pd.DataFrame) -> pd.DataFrame:
        px, py = _sorted_points(part, k)
        x, y = part["x"].to_numpy(np.int64), part["y"].to_numpy(np.int64)
        found = nearest(px, py, x, y, np.full(len(x), far), k + 1)[:, 1:]  # the first is the row itself
        return part.assign(best=pd.Series(list(found), index=part.index, dtype=object))[["feature", "x", "y", "n", "cell", "best"]]

    local = written(held.groupBy("feature", "cell").applyInPandas(own, kind), "nearest")
    # At most MOST_CELLS boxes for each feature.
    boxes = local.groupBy("feature", "cell").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max)]).toPandas()
    by_feature = {f: b for f, b in boxes.groupby("feature")}

    def touched(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(query, cell) for every other cell that a query's square reaches."""
        for part in parts:
            for feature, rows in part.groupby("feature"):
                box = by_feature[feature]
                for chunk in _chunks(rows, max(1, 4_000_000 // len(box))):
                    x, y, r = (chunk[c].to_numpy(np.float64)[:, None] for c in ("x", "y", "radius"))
                    meets = ((box["min_x"].to_numpy() <= x + r) & (box["max_x"].to_numpy() >= x - r)
                             & (box["min_y"].to_numpy() <= y + r) & (box["max_y"].to_numpy() >= y - r)
                             & (box["cell"].to_numpy() != chunk["cell"].to_numpy()[:, None]))
                    row, cell = np.nonzero(meets)
                    yield chunk.iloc[row][["feature", "x", "y", "radius"]].assign(cell=box["cell"].to_numpy()[cell])

    queries = local.select("feature", "x", "y", "cell", F.element_at("best", k).alias("radius"))
    sent = queries.mapInPandas(touched, "feature string, x long, y long, radius long, cell int")

    def abroad(key: tuple, points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        px, py = _sorted_points(points, k)
        x, y, limit = (asked[c].to_numpy(np.int64) for c in ("x", "y", "radius"))
        return asked.assign(best=pd.Series(list(nearest(px, py, x, y, limit, k)), index=asked.index, dtype=object))[["feature", "x", "y", "best"]]

    others = sent.groupBy("feature", "cell")
    answers = held.groupBy("feature", "cell").cogroup(others).applyInPandas(abroad, "feature string, x long, y long, best array<long>")
    both = local.select("feature", "x", "y", "n", "best").unionByName(answers.withColumn("n", F.lit(None).cast("long")))
    merged = both.groupBy("feature", "x", "y").agg(F.max("n").alias("n"), F.flatten(F.collect_list("best")).alias("best"))
    return merged.withColumn("radius", F.element_at(F.array_sort("best"), k)).drop("best")


def plane_information(df: DataFrame, features: Sequence[str], other: str, k: int = NEIGHBOURS,
                      rows_per_cell: int = ROWS_PER_CELL, parts: int | None = None) -> DataFrame:
    """feature, mi: information each feature holds about the column `other`, over rows where both have a value.

    Both sides are measured in their own spread. With k rows or fewer there is no k-th neighbour and no information.
    """
    grid = on_grid(df, [*features, other], mantissa_bits=20)
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), grid[f].alias("x")) for f in features])
    points = (df.select(grid[other].alias("y"), F.explode(cells).alias("c")).select("c.*", "y").where("x IS NOT NULL AND y IS NOT NULL")
              .groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("n")))
    enough = points.groupBy("feature").agg(F.sum("n").alias("size")).where(F.col("size") > k)
    points = written(points.join(enough, "feature").drop("size"), "points")
    rows = written(kth_on_plane(points, k, rows_per_cell), "radii")
    for side, out in (("x", "near_x"), ("y", "near_y")):
        rows = closer(rows, points.select(F.col("feature").alias("axis"), F.col(side).alias("value"), "n"), "feature", side, out, parts)
    n, mean = F.sum("n"), lambda c: F.sum(F.col("n") * c) / F.sum("n")
    mi = digamma(n) + digamma(F.lit(float(k))) - mean(digamma(F.col("near_x")) + digamma(F.col("near_y")))
    return rows.groupBy("feature").agg(F.greatest(mi, F.lit(0.0)).alias("mi"))


def occurrence_relevance(df: DataFrame, features: Sequence[str], k: int = NEIGHBOURS, **limits: int) -> DataFrame:
    """feature, relevance: share of the uncertainty about an event that each feature removes."""
    base = df.agg(F.avg((F.col(TARGET) > 0).cast("double"))).first()[0] or 0.0
    entropy = -(base * np.log(base) + (1 - base) * np.log(1 - base)) if 0 < base < 1 else 1.0
    found = class_information(df, features, (F.col(TARGET) > 0).cast("int"), k, **limits)
    return found.select("feature", (F.col("mi") / F.lit(float(entropy))).alias("relevance"))


def count_relevance(df: DataFrame, features: Sequence[str], k: int = NEIGHBOURS, **limits: int) -> DataFrame:
    """feature, relevance: information about the logarithm of the count where there are events, relative to the best feature."""
    rows = df.filter(F.col(TARGET) > 0).select(*features, F.log1p(F.col(TARGET).cast("double")).alias("_level"))
    found = plane_information(rows, features, "_level", k, **limits)
    best = found.agg(F.max("mi").alias("best"))  # one row
    return found.crossJoin(F.broadcast(best)).select(
        "feature", F.when(F.col("best") > 0, F.col("mi") / F.col("best")).otherwise(F.col("mi")).alias("relevance"))
