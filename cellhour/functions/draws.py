"""Repeatable sampling: a row's draw number depends on its key and the seed only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

SPAN = 2 ** 31 - 1
BUCKET_ROWS = 100_000
HELD_ROWS = 100_000
CUTS = 32
SAMPLE_PER_CUT = 20
MOST_TURNS = 100


def draw_number(seed: int | Column, *key: Column) -> Column:
    """Uniform integer in [0, SPAN) from a row key and a seed."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.pmod(F.xxhash64(seed, *key), F.lit(SPAN))


def kth_row(rows: DataFrame, names: Sequence[str], k: int, held_rows: int = HELD_ROWS) -> tuple:
    """The values of the k-th row (from 1) in ascending order of `names`, nulls first.

    No row is shuffled while more than `held_rows` can still be it: a small
    sample cuts the rows, one pass counts those up to each cut, and the search
    goes on between the two cuts around k. The sample only decides where the
    cuts lie. `names` must tell rows apart.
    """
    inside, here, turn = rows.select(*names), rows.count(), 0
    if not 1 <= k <= here:
        raise ValueError(f"no row {k} among {here}")
    while here > held_rows:
        turn += 1
        if turn > MOST_TURNS:
            raise ValueError(f"{list(names)} do not tell rows apart")
        share = min(1.0, CUTS * SAMPLE_PER_CUT / here)
        seen = [tuple(r) for r in inside.sample(fraction=share, seed=turn).orderBy(*names).collect()]
        cuts = [seen[i * len(seen) // CUTS] for i in range(CUTS)] if seen else [tuple(inside.first())]
        cuts = list(dict.fromkeys(cuts))
        counts = inside.agg(*[F.count_if(up_to(inside, names, c)) for c in cuts]).first()
        low = max((i for i, n in enumerate(counts) if n < k), default=None)
        high = min((i for i, n in enumerate(counts) if n >= k), default=None)
        before = counts[low] if low is not None else 0
        bounds = F.lit(True)
        if low is not None:
            bounds = ~up_to(inside, names, cuts[low])
        if high is not None:
            bounds = bounds & up_to(inside, names, cuts[high])
        inside, here, k = inside.filter(bounds), (counts[high] if high is not None else here) - before, k - before
    held = inside.orderBy(*names).limit(k)
    return tuple(held.agg(F.max(F.struct(*names)).alias("row")).first()["row"])


def up_to(rows: DataFrame, names: Sequence[str], values: tuple) -> Column:
    """Rows that come no later than the given one."""
    types = [rows.schema[n].dataType for n in names]
    return F.struct(*names) <= F.struct(*[F.lit(v).cast(t).alias(n) for n, v, t in zip(names, values, types)])


def allocate(sizes: DataFrame, keys: Sequence[str], n: int, size: str = "size",
             held_rows: int = HELD_ROWS) -> DataFrame:
    """Share n rows over strata by largest remainder; adds `take`.

    `sizes` has one row per stratum; it is read several times, so it is written
    once. Equal remainders go by stratum key, so the result is the same on
    every run. The last stratum to get a row for its remainder is found by
    counts; the strata themselves stay where they are.
    """
    keys = list(keys)
    sizes = materialise(sizes.select(*keys, F.col(size)))
    total = sizes.agg(F.sum(size)).first()[0] or 0
    exact = F.col(size) / F.lit(total) * n
    # Floor less value: ascending, the largest remainder comes first.
    shares = sizes.withColumns({"floor": F.floor(exact), "lacks": F.floor(exact) - exact})
    left = n - (shares.agg(F.sum("floor")).first()[0] or 0)
    order = ["lacks", *keys]
    if left <= 0 or total == 0:
        more = F.lit(False)
    elif left >= shares.count():
        more = F.lit(True)
    else:
        more = up_to(shares, order, kth_row(shares, order, left, held_rows))
    take = F.col("floor") + more.cast("bigint")
    return shares.select(*keys, F.col(size), F.least(take, F.col(size)).alias("take"))


def stratified_draw(df: DataFrame, strata: Sequence[str], n: int, number: Column,
                    tie: Sequence[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Exactly n rows, shared over strata in proportion to their size.

    Inside a stratum the rows with the smallest draw numbers win. Draw numbers
    are uniform, so cutting their range into buckets of about `bucket_rows`
    rows leaves one bucket per stratum to be ranked; a stratum with a third of
    all rows is ranked in many tasks.
    """
    strata = list(strata)
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("size"))
    quota = (allocate(sizes, strata, n)
             .withColumn("buckets", F.ceil(F.col("size") / bucket_rows)))
    numbered = df.withColumn("_number", number)
    marked = numbered.join(quota, strata).withColumn(
        "_bucket", F.floor(F.col("_number") * F.col("buckets") / F.lit(float(SPAN))))
    per_bucket = marked.groupBy(*strata, "_bucket").agg(F.count(F.lit(1)).alias("_here"))
    ahead = (Window.partitionBy(*strata).orderBy("_bucket")
             .rowsBetween(Window.unboundedPreceding, -1))
    per_bucket = per_bucket.withColumn("_ahead", F.coalesce(F.sum("_here").over(ahead), F.lit(0)))
    order = Window.partitionBy(*strata, "_bucket").orderBy("_number", *tie)
    ranked = (marked.join(per_bucket, [*strata, "_bucket"])
              .filter(F.col("_ahead") < F.col("take"))
              .withColumn("_place", F.col("_ahead") + F.row_number().over(order)))
    return ranked.filter(F.col("_place") <= F.col("take")).select(*df.columns)


def seeded_sample(df: DataFrame, n: int, number: Column, tie: Sequence[str],
                  bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The n rows with the smallest draw numbers, without sorting the table."""
    total = df.count()
    if n >= total:
        return df
    buckets = math.ceil(total / bucket_rows)
    marked = df.withColumn("_number", number).withColumn(
        "_bucket", F.floor(F.col("_number") * F.lit(buckets) / F.lit(float(SPAN))))
    order = Window.partitionBy("_bucket").orderBy("_number", *tie)
    if buckets == 1:
        kept = marked.withColumn("_place", F.row_number().over(order))
        return kept.filter(F.col("_place") <= n).select(*df.columns)
    # One short row per bucket.
    ahead = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = marked.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_here"))
    per_bucket = per_bucket.withColumn("_ahead", F.coalesce(F.sum("_here").over(ahead), F.lit(0)))
    kept = (marked.join(per_bucket.filter(F.col("_ahead") < n), "_bucket")
            .withColumn("_place", F.col("_ahead") + F.row_number().over(order)))
    return kept.filter(F.col("_place") <= n).select(*df.columns)
