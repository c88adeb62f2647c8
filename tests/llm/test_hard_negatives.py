"""Hard negatives against brute force, with ties, repeated ids, vectors of several lengths and tiny blocks."""

import collections

import numpy as np
import pytest

from cellhour.llm import hard_negatives


def brute(rows, positives, k, floor=80):
    good = [(i, c, tuple(np.floor(256 * np.array(v)).astype(int).tolist())) for i, v, c in rows
            if i is not None and c is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = collections.Counter()
    for i, c, v in good:
        if i % 10:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, d) for j, d, w in good if j != i and len(w) == len(v)]
        for s, j, _ in sorted(x for x in scored if x[2] == c)[:positives]:
            window = sorted(x for x in scored if x[2] != c and floor * -s <= 100 * -x[0] <= 100 * -s)[:k]
            out.update((i, j, r, x[1], -s, -x[0]) for r, x in enumerate(window, 1))
    return out


def table(rng, n, kind):
    draw = {"plain": lambda: rng.normal(size=4), "ties": lambda: rng.integers(-1, 2, 4) / 256.0,
            "close": lambda: 1 + 0.02 * rng.normal(size=4)}[kind]
    rows = [(i, [float(x) for x in draw()], int(rng.integers(3))) for i in range(n)]
    one = rows[5][1]
    rows += [(i, one, 1 + i % 2) for i in range(n, n + 40)]  # one very common vector
    rows += [(n + 50, None, 1), (n + 51, [1.0, None, 1.0, 1.0], 1), (n + 52, [float("nan")] * 4, 1), (n + 53, [float("inf")] * 4, 2),
             (n + 54, one, None), (None, one, 1), (20, one, 1), (20, rows[20][1], rows[20][2]), (21, rows[21][1], rows[21][2]),
             (n + 60, [1.0], 0), (n + 61, [1.1], 0), (n + 62, [1.05], 1), (n + 70, [], 0), (n + 71, [], 0), (n + 72, [], 1)]
    return rows


@pytest.mark.parametrize("kind", ["plain", "ties", "close"])
@pytest.mark.parametrize("small", [False, True])
def test_windows_against_brute_force(spark, monkeypatch, kind, small):
    if small:
        for name, value in {"ANCHORS_PER_BLOCK": 4, "ROWS_PER_BLOCK": 16, "BLOCKS_PER_STRIPE": 3, "ANCHORS_AT_ONCE": 3}.items():
            monkeypatch.setattr(hard_negatives, name, value)
    rows = table(np.random.default_rng(4), 150, kind)
    df = spark.createDataFrame([(*r, "own") for r in rows], "vec_id long, embedding array<double>, label int, score string")
    got = hard_negatives.mine(df, "vec_id % 10 = 0", positives=4, k=3)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert collections.Counter(tuple(r) for r in got.collect()) == brute(rows, 4, 3)


def test_empty_tables_and_no_anchor(spark):
    kind = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, [1.0], 1)], [(10, [1.0], 1)]):
        assert hard_negatives.mine(spark.createDataFrame(rows, kind), "vec_id % 10 = 0").collect() == []


def test_large_scores_stay_exact():
    rng = np.random.default_rng(0)
    a, b = rng.integers(-2**29, 2**29, (5, 6)), rng.integers(-2**29, 2**29, (7, 6))
    assert (hard_negatives.products(a, b) == [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]).all()
