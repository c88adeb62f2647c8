"""First and second moments of many columns in one pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SUM_COLUMNS = 80


@dataclass(frozen=True)
class Moments:
    """Row count, means and population covariance; small enough for the driver."""

    names: list[str]
    n: int
    mean: np.ndarray
    cov: np.ndarray

    @property
    def sd(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.cov), 0.0, None))

    def correlation(self) -> np.ndarray:
        sd = np.where(self.sd > 0, self.sd, 1.0)
        corr = self.cov / np.outer(sd, sd)
        np.fill_diagonal(corr, 1.0)
        return corr

    def part(self, names: Sequence[str]) -> "Moments":
        at = [self.names.index(c) for c in names]
        return Moments(list(names), self.n, self.mean[at], self.cov[np.ix_(at, at)])


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Moments over the rows where every column has a value.

    Columns are taken relative to the values of one row, so that sums of squares
    do not cancel where a column lies far from zero. Narrow column sets are plain
    sums in the JVM. Beyond `MAX_SUM_COLUMNS` sums the partial products are matrix
    products per Arrow batch, one short row per task; both add up on Spark.
    """
    names = list(columns)
    k = len(names)
    given = df.select(*[F.col(c).cast("double").alias(c) for c in names]).na.drop()
    some = given.first()
    origin = np.array([v if v is not None and np.isfinite(v) else 0.0 for v in some or [0.0] * k])
    rows = given.select(*[(F.col(c) - F.lit(float(o))).alias(c) for c, o in zip(names, origin)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    if len(pairs) + k <= MAX_SUM_COLUMNS:
        values = rows.agg(
            F.count(F.lit(1)), *[F.sum(c) for c in names],
            *[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs]).first()
        n = values[0]
        sums = np.array([v or 0.0 for v in values[1:k + 1]])
        gram = np.zeros((k, k))
        for (i, j), v in zip(pairs, values[k + 1:]):
            gram[i, j] = gram[j, i] = v or 0.0
    else:
        def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((k + 1, k + 1))
            for batch in batches:
                x = np.column_stack([np.ones(len(batch)), batch.to_numpy(dtype=float)])
                total += x.T @ x
            yield pd.DataFrame({"at": np.arange(total.size), "v": total.ravel()})

        cells = (rows.mapInPandas(products, "at int, v double")
                 .groupBy("at").agg(F.sum("v").alias("v")).collect())
        full = np.zeros((k + 1) ** 2)
        for cell in cells:
            full[cell["at"]] = cell["v"]
        full = full.reshape(k + 1, k + 1)
        n, sums, gram = int(round(full[0, 0])), full[0, 1:], full[1:, 1:]
    if n == 0:
        return Moments(names, 0, np.zeros(k), np.zeros((k, k)))
    mean = sums / n
    return Moments(names, n, mean + origin, gram / n - np.outer(mean, mean))
