"""Sliced, hot-key and sampled paths against brute force on small tables."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellhour.functions import draws, narrowing, ordering, packed_ranks
from cellhour.functions.moments import moments
from cellhour.operators import evaluate, profile

QUICK = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    return pd.DataFrame({
        "id": np.arange(3000), "g": np.where(rng.random(3000) < 0.4, 0, rng.integers(1, 9, 3000)),
        "x": np.round(rng.lognormal(size=3000), 3), "y": np.where(rng.random(3000) < 0.35, 0.0, rng.normal(size=3000)),
        "z": rng.integers(0, 5, 3000).astype(float)})


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame)


@pytest.mark.parametrize("limits", [{}, {"accuracy": 20, "held_rows": 5}, {"accuracy": 200, "held_rows": 1}])
def test_quantiles(df, frame, limits, monkeypatch):
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    rounds, real = [], narrowing._narrow
    monkeypatch.setattr(narrowing, "_narrow", lambda *a: rounds.append(1) or real(*a))
    found = narrowing.order_statistics(df, ["x", "y", "z"], probs, **limits)
    for c in ("x", "y", "z"):
        assert np.allclose([b.value for b in found[c]], frame[c].quantile(probs), atol=1e-12)
    assert bool(rounds) == bool(limits)


def test_quantiles_of_few_and_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1.0, None, nan, 5, inf), (2.0, None, 1.0, 5, -inf), (None, None, None, None, 0.0), (4.0, None, 3.0, 6, 1.0)]
    df = spark.createDataFrame(rows, "a double, none double, b double, c int, d double")
    found = ordering.quantiles(df, ["a", "none", "b", "c", "d"], [0.0, 0.5, 0.75])
    assert found == {"a": [1.0, 2.0, 3.0], "none": [None] * 3, "b": [1.0, 2.0, 2.5], "c": [5.0, 5.0, 5.5], "d": [-inf, 0.5, inf]}
    assert ordering.quantiles(df.limit(0), ["a"], [0.5]) == {"a": [None]}


def test_a_sketch_that_misses_is_put_right(df, frame, monkeypatch):
    """Brackets that hold none of their ranks are moved to where the counts say."""
    b = [narrowing._Bracket("x", rank, low, low + 0.1, 1.0) for rank, low in ((1500, 0.0), (1501, 0.0), (2990, 0.5))]
    rows, values = df.select("x"), None
    while values is None:
        values = narrowing._pick(rows, b)
    ordered = np.sort(frame["x"].to_numpy())
    assert values == {("x", r): ordered[r] for r in (1500, 1501, 2990)}


def test_group_quantiles_of_a_hot_group(df, frame):
    rows = ordering.group_quantiles(df, ["g"], "x", [0.5, 0.95], slice_rows=150).collect()
    expected = frame.groupby("g")["x"].quantile([0.5, 0.95]).unstack()
    assert len(rows) == len(expected)
    for r in rows:
        assert np.allclose(r["q"], expected.loc[r["g"]])


@pytest.mark.parametrize("limits", [{}, {"broadcast_values": 3, "slice_rows": 200}])
def test_row_ranks(df, frame, limits):
    rows = ordering.with_ranks(df, ["x", "y", "z"], ["id"], **limits).toPandas().set_index("id").sort_index()
    for c in ("x", "y", "z"):
        assert np.allclose(rows[f"{c}__rank"], frame[c].rank())


def test_hot_values_are_broadcast(spark):
    """Half of all rows share one value; its rank does not pass through the value shuffle."""
    frame = pd.DataFrame({"id": range(4000), "v": [1.5] * 2000 + [float(i) for i in range(2000)]})
    rows = ordering.with_ranks(spark.createDataFrame(frame), ["v"], ["id"], broadcast_values=10, slice_rows=500)
    got = rows.toPandas().set_index("id").sort_index()["v__rank"]
    assert np.allclose(got, frame["v"].rank())


@QUICK
@given(st.lists(st.one_of(st.none(), st.floats(-50, 50)), min_size=1, max_size=60))
def test_rank_sum(spark, values):
    ranks = ordering.average_ranks(spark.createDataFrame([(v,) for v in values], "v DOUBLE"), ["v"])
    n = sum(v is not None for v in values)
    total = ranks.agg(F.sum(F.col("n") * F.col("rank"))).first()[0] or 0.0
    assert total == pytest.approx(n * (n + 1) / 2)


@QUICK
@given(st.lists(st.integers(1, 400), min_size=1, max_size=25), st.integers(0, 300))
def test_allocation_sums_to_n(spark, sizes, n):
    n = min(n, sum(sizes))
    table = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "k INT, size BIGINT")
    rows = draws.allocate(table, ["k"], n).collect()
    assert sum(r["take"] for r in rows) == n
    assert all(r["take"] <= r["size"] for r in rows)


@pytest.mark.parametrize("held", [1, 7, 10_000])
def test_allocation_by_counts(spark, held):
    rng = np.random.default_rng(5)
    named = [(None if i == 40 else f"k{i % 9}", i // 9, int(v)) for i, v in enumerate(rng.integers(1, 5, 180))]
    table = spark.createDataFrame(named, "a STRING, b INT, size BIGINT").repartition(5)
    total, n = sum(s for *_, s in named), 101
    share = {(a, b): s / total * n for a, b, s in named}
    order = sorted(share, key=lambda k: (np.floor(share[k]) - share[k], k[0] is not None, k[0] or "", k[1]))
    left = n - sum(int(v) for v in share.values())
    expected = {k: int(share[k]) + (i < left) for i, k in enumerate(order)}
    rows = draws.allocate(table, ["a", "b"], n, held_rows=held)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    assert {(r["a"], r["b"]): r["take"] for r in rows.collect()} == expected


def test_allocation_of_nothing(spark):
    none = spark.createDataFrame([], "a STRING, size BIGINT")
    assert draws.allocate(none, ["a"], 5).isEmpty()
    with pytest.raises(ValueError):
        draws.kth_row(none, ["a"], 1)


def test_draws_do_not_depend_on_layout(df):
    number = draws.draw_number(7, F.col("id"))
    one = draws.stratified_draw(df, ["g"], 500, number, ["id"], bucket_rows=40)
    two = draws.stratified_draw(df.repartition(3, "x"), ["g"], 500, number, ["id"])
    assert one.count() == 500 and one.exceptAll(two).isEmpty()
    three = draws.seeded_sample(df, 700, number, ["id"], bucket_rows=60)
    four = draws.seeded_sample(df, 700, number, ["id"])
    assert three.count() == 700 and three.exceptAll(four).isEmpty()


def test_moments_both_ways(df, frame, monkeypatch):
    narrow = moments(df, ["x", "y", "z"])
    monkeypatch.setattr("cellhour.functions.moments.MAX_SUM_COLUMNS", 0)
    wide = moments(df, ["x", "y", "z"])
    expected = np.cov(frame[["x", "y", "z"]].T, bias=True)
    assert narrow.n == wide.n == 3000
    assert np.allclose(narrow.cov, expected) and np.allclose(wide.cov, expected)


def test_rank_correlation_with_gaps(spark, frame):
    holes = frame.assign(x=frame["x"].where(frame["id"] % 5 > 0), y=frame["y"].where(frame["id"] % 3 > 0))
    df = spark.createDataFrame(holes).withColumns({
        c: F.when(~F.isnan(c), F.col(c)) for c in ("x", "y")})
    expected = holes[["x", "y", "z"]].corr(method="spearman")
    for r in profile.rank_correlation(df, ["x", "y", "z"], ["id"]).collect():
        assert r["rho"] == pytest.approx(expected.loc[r["a"], r["b"]])


def brute_average_precision(y, p):
    found = 0.0
    for cut in sorted(set(p), reverse=True):
        at = sum(1 for a, b in zip(y, p) if b == cut and a)
        above = [(a, b) for a, b in zip(y, p) if b >= cut]
        found += at / sum(y) * sum(a for a, _ in above) / len(above)
    return found


@QUICK
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 12)), min_size=5, max_size=60))
def test_ranking_scores(spark, rows):
    if not 0 < sum(y for y, _ in rows) < len(rows):
        return
    y, p = [r[0] for r in rows], [r[1] / 12 for r in rows]
    pairs = [(a > b) + 0.5 * (a == b) for a, u in zip(p, y) if u for b, v in zip(p, y) if not v]
    for bend in (lambda v: v, lambda v: v ** 3 + 2):
        df = spark.createDataFrame([(a, float(bend(b))) for a, b in zip(y, p)], "y INT, p DOUBLE")
        got = evaluate.ranking_scores(evaluate.ranking_curve(df, "y", "p", slice_rows=7)).first()
        assert got["average_precision"] == pytest.approx(brute_average_precision(y, p))
        assert got["roc_auc"] == pytest.approx(sum(pairs) / len(pairs))


@pytest.mark.parametrize("limits", [{}, {"broadcast_values": 3, "slice_rows": 200}])
def test_rank_moments_need_no_key(spark, frame, limits):
    """Keys that repeat or are missing lose no row; rows without a value are left out, ranks are those of whole columns."""
    gaps = frame.assign(x=frame["x"].where(frame["id"] % 10 != 0))
    rows = spark.createDataFrame(gaps[["x", "y", "z"]]).withColumn("x", F.nanvl("x", F.lit(None)))
    found = ordering.rank_moments(rows, ["x", "y", "z"], **limits)
    ranks = gaps[["x", "y", "z"]].rank().dropna()
    assert found.n == len(ranks)
    assert np.allclose(found.mean, ranks.mean()) and np.allclose(found.cov, ranks.cov(ddof=0))


def test_frequent_values_and_many_slices_keep_their_ranks(spark, monkeypatch):
    """A value that fills slices is ranked by counts, rows come in several blocks, and NaN is the last value."""
    rng = np.random.default_rng(11)
    x = np.where(rng.random(3000) < 0.4, 0.0, rng.normal(size=3000).round(2))
    y = np.where(rng.random(3000) < 0.1, np.nan, rng.random(3000))
    z = [None if i % 17 == 0 else float(i % 5) for i in range(3000)]
    rows = spark.createDataFrame([(float(a), float(b), c) for a, b, c in zip(x, y, z)], "x DOUBLE, y DOUBLE, z DOUBLE").repartition(4)
    monkeypatch.setattr(packed_ranks, "BLOCK", 300)
    found = ordering.rank_moments(rows, ["x", "y", "z"], broadcast_values=5, slice_rows=100)
    ranks = pd.DataFrame({"x": x, "y": np.where(np.isnan(y), 2.0, y), "z": z}).rank().dropna()
    assert found.n == len(ranks)
    assert np.allclose(found.mean, ranks.mean()) and np.allclose(found.cov, ranks.cov(ddof=0))
    packed = ordering.packed_rows(rows, ["x", "y", "z"], ordering.counted_values(rows, ["x", "y", "z"], 5), 100)
    probs = [0.0, 0.1, 0.35, 0.5, 0.9, 1.0]
    for c, values in (("x", x), ("y", y[~np.isnan(y)])):
        assert packed.quantiles(c, probs) == pytest.approx(list(np.quantile(values, probs)))


def test_counted_values_give_exact_quantiles(spark, frame, df):
    probs = [i / 10 for i in range(1, 10)]
    counted = ordering.counted_values(df, ["x", "z"])
    for c in ("x", "z"):
        assert counted.quantiles(c, probs) == pytest.approx(list(frame[c].quantile(probs)))
