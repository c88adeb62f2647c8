"""Nearest-neighbour information against brute force over all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellhour.operators import neighbours


def psi(n):
    return sum(1.0 / i for i in range(1, int(n))) - 0.5772156649015329


def steps(v, bits):
    return np.floor(v / neighbours.grid_step(float(np.std(v)), float(np.abs(v).max()), bits) + 0.5).astype(np.int64)


def brute_class(values, labels, k):
    v = steps(values, 0)
    used, parts = [], []
    for c in set(labels.tolist()):
        at = np.flatnonzero(labels == c)
        if len(at) > 1:
            used += at.tolist()
            kk = min(k, len(at) - 1)
            parts += [(i, kk, len(at), np.sort(np.abs(v[at] - v[i]))[kk]) for i in at]
    all_v = v[used]
    near = [(np.abs(all_v - v[i]) < max(r, 1)).sum() for i, *_, r in parts]
    return max(0.0, psi(len(used)) + np.mean([psi(p[1]) for p in parts]) - np.mean([psi(p[2]) for p in parts]) - np.mean([psi(m) for m in near]))


def brute_plane(x, y, k):
    x, y = steps(x, 20), steps(y, 20)
    total = 0.0
    for i in range(len(x)):
        dx, dy = np.abs(x - x[i]), np.abs(y - y[i])
        r = max(1, np.sort(np.maximum(dx, dy))[k])
        total += psi((dx < r).sum()) + psi((dy < r).sum())
    return max(0.0, psi(len(x)) + psi(k) - total / len(x))


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 600
    y = rng.normal(size=n)
    columns = {"smooth": y + 0.3 * rng.normal(size=n), "noise": rng.normal(size=n) * 1e6, "steps": np.round(y * 2) / 4,
               "hot": np.where(rng.random(n) < 0.4, 0.0, rng.normal(size=n)), "constant": np.full(n, 7.0)}
    label = np.where(y > 1.9, 9, np.where(y > 0.5, 1, 0))
    label[0] = 5  # a class of one row
    rows = [(*(float(columns[c][i]) for c in columns), float(y[i]), int(label[i])) for i in range(n)]
    rows += [(None, None, None, None, None, 1.0, 1), (1.0, None, 1.0, 1.0, 1.0, None, None)]
    schema = ", ".join(f"{c} double" for c in columns) + ", y double, label int"
    return columns, y, label, spark.createDataFrame(rows, schema).repartition(3)


@pytest.mark.parametrize("parts", [None, 25])
def test_information_about_a_class(data, parts):
    columns, _, label, df = data
    df = df.where("label IS NOT NULL")
    got = {r.feature: r.mi for r in neighbours.class_information(df, list(columns), F.col("label"), 3, parts).collect()}
    for c, v in columns.items():
        assert got[c] == pytest.approx(brute_class(v, label, 3), abs=1e-8), c


@pytest.mark.parametrize("cells, parts", [(20_000, None), (20, 9)])
def test_information_about_a_second_side(data, cells, parts):
    columns, y, _, df = data
    df = df.where("noise IS NOT NULL")
    got = {r.feature: r.mi for r in neighbours.plane_information(df, list(columns), "y", 3, cells, parts).collect()}
    for c, v in columns.items():
        assert got[c] == pytest.approx(brute_plane(v, y, 3), abs=1e-8), c
    assert got["smooth"] > 0.5 > got["noise"]


def test_few_rows(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 0), (2.0, 1.0, 1)], "x double, y double, label int")
    assert neighbours.plane_information(rows, ["x"], "y").collect() == []
    assert neighbours.class_information(rows, ["x"], F.col("label")).collect() == []
    assert neighbours.class_information(rows.limit(0), ["x"], F.col("label")).collect() == []


def test_digamma(spark):
    rows = spark.range(1, 200).select("id", neighbours.digamma(F.col("id")).alias("d")).collect()
    assert all(math.isclose(r.d, psi(r.id), abs_tol=1e-8) for r in rows)
