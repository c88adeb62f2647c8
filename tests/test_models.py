"""Fits, selection and the experiment grid against numpy."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellhour.functions.moments import Moments
from cellhour.operators import evaluate, features, models, selection
from cellhour.plans import ablate, experiment
from workload.adapters import ROW_KEY, TABLE_FOLDS

NAMES = ["T2M", "CAPE", "RH2M"]


@pytest.fixture(scope="module")
def train(tables):
    return tables.table.filter("year <> 2001").withColumn("y", F.log1p(F.col("flash_count").cast("double")))


@pytest.fixture(scope="module")
def arrays(train):
    pdf = train.select(*NAMES, "y", "flash_count").toPandas()
    return pdf[NAMES].to_numpy(float), pdf["y"].to_numpy(float), pdf["flash_count"].to_numpy()


def test_ridge_equals_the_normal_equations(train, arrays):
    x, y, _ = arrays
    a = np.hstack([x, np.ones((len(x), 1))])
    weights = np.linalg.solve(a.T @ a + np.diag([1.0, 1.0, 1.0, 0.0]), a.T @ y)
    fitted = models.ridge(train, NAMES, "y")
    assert np.allclose([*fitted.weights, fitted.intercept], weights, rtol=1e-6, atol=1e-9)


def test_logistic_sits_at_the_optimum(train, arrays):
    x, _, counts = arrays
    scale = models.standardiser(train, NAMES)
    rows = models.standardised(train, scale).withColumn("o", (F.col("flash_count") > 0).cast("int"))
    fitted = models.logistic(rows, NAMES, "o")
    z = (x - x.mean(0)) / x.std(0)
    p = 1 / (1 + np.exp(-(z @ np.array(fitted.weights) + fitted.intercept)))
    gradient = z.T @ (p - (counts > 0)) + np.array(fitted.weights)
    assert np.abs(gradient).max() < 1e-6


def test_all_logistic_fits_in_one_run_of_steps(spark, train, arrays, monkeypatch):
    """Every fit equals its own; the number of passes does not grow with the fits."""
    scale = models.standardiser(train, NAMES)
    rows = models.standardised(train, scale).withColumn("o", (F.col("flash_count") > 0).cast("int")).cache()
    subsets = [NAMES, *[[m for m in NAMES if m != n] for n in NAMES], []]
    passes, real = [], type(rows).mapInPandas
    monkeypatch.setattr(type(rows), "mapInPandas", lambda self, *a: passes.append(1) or real(self, *a))
    together, n_together = models.logistic_fits(rows, subsets, "o"), len(passes)
    one_by_one = [models.logistic(rows, s, "o") for s in subsets]
    assert n_together <= max(12, len(passes) - n_together)
    for a, b in zip(together, one_by_one):
        assert np.allclose([*a.weights, a.intercept], [*b.weights, b.intercept], atol=1e-6) and a.names == b.names
    base = (arrays[2] > 0).mean()
    assert together[-1].intercept == pytest.approx(np.log(base / (1 - base)))
    with pytest.raises(ValueError):
        models.logistic(rows.limit(0), NAMES, "o")
    one_class = models.logistic(rows.where("o = 0"), NAMES, "o")
    assert np.isfinite([*one_class.weights, one_class.intercept]).all()


def test_components_equal_svd(train, arrays):
    x = arrays[0]
    z = (x - x.mean(0)) / x.std(0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    found = features.principal_components(train, NAMES, 2)
    assert np.allclose(found["explained"], (s ** 2 / (s ** 2).sum())[:2])
    for got, want in zip(np.array(found["components"]), vt):
        assert np.allclose(np.abs(got), np.abs(want), atol=1e-6) and got[np.abs(got).argmax()] > 0


def test_rank_r2_equals_least_squares(train):
    ranks = selection.rank_moments(train, NAMES, ROW_KEY)
    r = train.select(*NAMES).toPandas().rank()
    a = np.column_stack([np.ones(len(r)), r["T2M"], r["RH2M"]])
    fitted = a @ np.linalg.lstsq(a, r["CAPE"], rcond=None)[0]
    expected = 1 - ((r["CAPE"] - fitted) ** 2).sum() / ((r["CAPE"] - r["CAPE"].mean()) ** 2).sum()
    assert selection.rank_r2(ranks, "CAPE", ["T2M", "RH2M"]) == pytest.approx(expected)


def test_greedy_prefers_the_independent_feature():
    cov = np.array([[1.0, 0.99, 0.0], [0.99, 1.0, 0.0], [0.0, 0.0, 1.0]])
    ranks = Moments(["a", "b", "c"], 10, np.zeros(3), cov)
    steps = selection.greedy({"a": 0.9, "b": 0.89, "c": 0.2}, ranks)
    assert [s.feature for s in steps] == ["a", "c", "b"]
    assert selection.greedy({"a": 0.5, "b": 0.5, "c": 0.5}, ranks, 1)[0].feature == "a"


def test_count_scores_equal_direct_fits(tables, train, arrays):
    x, y, counts = arrays
    held = tables.table.filter("year = 2001").select(*NAMES, "flash_count").toPandas()
    mean, sd = x.mean(0), x.std(0)
    z, flashing = (x - mean) / sd, counts > 0
    zt, yt = (held[NAMES].to_numpy(float) - mean) / sd, np.log1p(held["flash_count"].to_numpy(float))
    test = held["flash_count"].to_numpy() > 0
    subsets = [NAMES, ["T2M", "CAPE"], ["RH2M"]]
    got = ablate.count_scores(train, tables.table.filter("year = 2001"), subsets, NAMES)
    for subset, score in zip(subsets, got):
        at = [NAMES.index(c) for c in subset]
        a = np.column_stack([z[flashing][:, at], np.ones(flashing.sum())])
        w = np.linalg.solve(a.T @ a + np.diag([1.0] * len(at) + [0.0]), a.T @ y[flashing])
        p = np.column_stack([zt[test][:, at], np.ones(test.sum())]) @ w
        expected = 1 - ((yt[test] - p) ** 2).sum() / ((yt[test] - yt[test].mean()) ** 2).sum()
        assert score == pytest.approx(expected, abs=1e-6)


def test_experiment_records(tables, tmp_path):
    settings = experiment.Settings(features=("T2M", "CAPE", "lat"), train_rows=500, validation_rows=200, test_days=20)
    frames = {d: tables.table.filter(F.col("domain") == d) for d in ("tropis", "subtropis")}
    rows = experiment.run_grid(frames, settings, str(tmp_path / "runs"), TABLE_FOLDS[2:], seeds=(0,), key=ROW_KEY).collect()
    assert len(rows) == 2 * 4 * 2
    for r in rows:
        assert r["train_rows"] == 500 or r["stage"] == "count"
        assert (r["metrics"]["windows"] is None) == (r["stage"] == "occurrence")
        if r["stage"] == "count":
            assert len(r["metrics"]["windows"]) == 4


def test_reduction_changes_the_model_width(tables):
    settings = experiment.Settings(features=("T2M", "CAPE", "RH2M", "KX"), reduction="pca2", train_rows=None,
                                   validation_rows=None, test_days=None)
    done = experiment.prepare(tables.table, TABLE_FOLDS[0], "occurrence", 0, settings, ROW_KEY)
    assert done.names == ["pc1", "pc2"] and {"pc1", "pc2", "y"} <= set(done.test.columns)


def test_repetitions_count_their_share_and_the_whole_table_in_one_aggregate(spark):
    from cellhour.functions.draws import SPAN, draw_number
    from cellhour.model import SEED

    rows = spark.range(2000).select(
        "id", (F.col("id") % 7).cast("double").alias("x"), F.rand(3).alias("noise"),
        (F.col("id") % 7 > 4).cast("int").alias("flash_count"))
    found = selection.stage_statistics(rows, ["x", "noise"], "occurrence", ["id"], seeds=2, share=0.4)
    edges = selection.bin_edges(rows, ["x", "noise"])
    for seed, got in [(None, found.whole), *found.by_seed.items()]:
        part = rows if seed is None else rows.filter(draw_number(SEED + seed, F.col("id")) < 0.4 * SPAN)
        wanted = {r["feature"]: r["relevance"] for r in selection.occurrence_relevance(part, edges).collect()}
        assert got == pytest.approx(wanted)
    assert found.select(["x", "noise"]).order[0] == "x"


def test_a_stopped_grid_goes_on_and_a_finished_one_fits_nothing(tables, tmp_path, monkeypatch):
    settings = experiment.Settings(features=("T2M", "CAPE"), train_rows=300, validation_rows=100, test_days=10)
    frames = {d: tables.table.filter(F.col("domain") == d) for d in ("tropis", "subtropis")}
    path, made, real = str(tmp_path / "grid"), [], experiment.fit
    scenarios = [("tropis_in", "tropis", "tropis"), ("tropis_to_sub", "tropis", "subtropis"), ("sub_in", "subtropis", "subtropis")]

    def counted(*args, **kw):
        if len(made) == stop:
            raise KeyboardInterrupt
        made.append(str(args[1:6]))
        return real(*args, **kw)

    monkeypatch.setattr(experiment, "fit", counted)
    run = lambda **kw: experiment.run_grid(frames, settings, path, TABLE_FOLDS[2:], seeds=(0,), key=ROW_KEY,
                                           scenarios=scenarios, stages=("occurrence",), **kw).collect()
    stop = 1
    with pytest.raises(KeyboardInterrupt):
        run()
    stop = None
    first = run()
    assert len(made) == 2 and len(set(made)) == 2  # the fit that was stored is not made again
    assert sorted((r["scenario"], r["model"]) for r in first) == sorted(
        (s, m) for s, _, _ in scenarios for m in experiment.MODELS)
    assert sorted(map(str, run())) == sorted(map(str, first)) and len(made) == 2
    assert len(run(version="other rows")) == 6 and len(made) == 4  # another key, beside the first
    assert len(run()) == 6


def test_features_are_resolved_by_what_they_need(tables):
    from cellhour.operators import features

    few = tables.table.select("T2M", "D2M", "hour_of_day_local")
    assert features.offered(few.columns) == ["T2M", "D2M", "hour_sin", "hour_cos", "dewpoint_depression"]
    assert features.matrix(few, ["dewpoint_depression", "T2M"]).columns == ["dewpoint_depression", "T2M"]
    for name, word in (("cloud_water", "TCIW"), ("CAPE", "lacks"), ("other", "no feature")):
        with pytest.raises(KeyError, match=word):
            features.matrix(few, [name])


@pytest.mark.parametrize("most", [80, 0])
def test_moments_far_from_zero(spark, monkeypatch, most):
    from cellhour.functions import moments as module

    monkeypatch.setattr(module, "MAX_SUM_COLUMNS", most)
    rng = np.random.default_rng(1)
    a = rng.normal(size=2000)
    x = np.column_stack([1e9 + a, -1e9 + 0.5 * a + rng.normal(size=2000), rng.normal(size=2000)])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"])).repartition(5)
    found = module.moments(df, ["a", "b", "c"])
    exact = np.cov((x - [1e9, -1e9, 0]).T, bias=True)
    assert np.allclose(found.cov, exact, rtol=1e-6, atol=1e-7) and np.allclose(found.mean, x.mean(0), rtol=1e-12)
    assert module.moments(df.limit(0), ["a"]).n == 0


def test_a_sampled_start_changes_no_fit(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 3))
    hit = (x @ [1.0, -2.0, 0.5] + rng.logistic(size=4000) > 0.3).astype(int)
    rows = spark.createDataFrame([(*map(float, v), int(h)) for v, h in zip(x, hit)], "a DOUBLE, b DOUBLE, c DOUBLE, hit INT")
    sets = [["a", "b", "c"], ["c", "a"], []]
    plain, started = models.logistic_fits(rows, sets, "hit"), models.logistic_fits(rows, sets, "hit", start_rows=300)
    for p, s in zip(plain, started):
        assert np.allclose([*p.weights, p.intercept], [*s.weights, s.intercept], atol=1e-8)
    scored = models.scores(rows, started, "hit").groupBy("fit").count().collect()
    assert {r["fit"]: r["count"] for r in scored} == {0: 4000, 1: 4000, 2: 4000}


def test_fits_are_ranked_like_their_curve(spark):
    """Packed slices give what the curve of all scores gives, with equal rows, missing features, missing labels and NaN."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(900, 2)), 1)
    cells = [(None if i % 41 == 0 else float(a), float("nan") if i % 53 == 0 else float(b), None if i % 37 == 0 else int(a > 0.3 * b))
             for i, (a, b) in enumerate(x)]
    rows = spark.createDataFrame(cells * 2, "a DOUBLE, b DOUBLE, hit INT").repartition(3)
    fits = [models.Linear(["a", "b"], [1.5, -0.5], 0.1, "logit"), models.Linear(["b"], [90.0], 1.0, "logit"), models.Linear([], [], 0.2, "logit")]
    curve = evaluate.ranking_curve(models.scores(rows, fits, "hit"), "hit", "score", ["fit"])
    wanted = {r["fit"]: (r["average_precision"], r["roc_auc"]) for r in evaluate.ranking_scores(curve, ["fit"]).collect()}
    for slice_rows in (10_000, 90):
        found = evaluate.fits_ranking(rows, fits, "hit", slice_rows=slice_rows)
        assert found.keys() == wanted.keys() == {0, 1, 2}
        for fit, (precision, area) in wanted.items():
            assert found[fit] == pytest.approx((precision, area), abs=1e-12)
    assert set(evaluate.fits_ranking(rows.where("hit = 0"), fits, "hit").values()) == {(None, None)}


def test_a_width_sweep_works_out_the_features_once(spark):
    """Every pass after the first reads stored features: the rows of each table come by once."""
    rng = np.random.default_rng(9)
    cells = [(*map(float, v), int(max(0, v[0] * 3 + v[1] + e))) for v, e in zip(rng.normal(size=(600, 3)), rng.normal(size=600))]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    kind = "T2M DOUBLE, RH2M DOUBLE, CAPE DOUBLE, flash_count BIGINT"
    rows = spark.createDataFrame(cells, kind).mapInArrow(counted, kind)
    names = ["T2M", "RH2M", "CAPE"]
    found = ablate.run_widths(rows, rows, (2, 3), [], {"full": names}, seeds=0).collect()
    assert read.value == 600 * 2  # training rows and test rows
    assert len(found) == 2 * (3 + 4)
    whole = next(r for r in found if (r["width"], r["stage"], r["dropped"]) == (3, "occurrence", None))
    assert whole["score"] == pytest.approx(ablate.fit_score(rows, rows, names, "occurrence")["pr_auc"], abs=1e-9)


def test_contingency_counts_every_cell(spark):
    rows = spark.createDataFrame([("p", 1.0, 0), ("p", 3.0, 1), (None, 3.0, None), ("p", None, 1), ("p", 2.0, 1)], "g STRING, x DOUBLE, y INT")
    got = {(r["g"], r["bin"], r["label"]): r["n"] for r in selection.contingency(rows, {"x": [1.0, 2.0]}, F.col("y"), ["g"]).collect()}
    assert got == {("p", 0, 0): 1, ("p", 2, 1): 1, (None, 2, None): 1, ("p", None, 1): 1, ("p", 1, 1): 1}


@pytest.fixture(scope="module")
def odd_rows(spark):
    """Two domains of four years, with nulls, every row twice and keys that repeat."""
    def row(i):
        year = 1995 + i % 4
        return ("tropis" if i % 3 else "subtropis", year, dt.datetime(year, 1 + i % 12, 1 + i % 28, i % 24), None if i % 31 == 0 else -7.75 + i % 3, 106.25,
                3000.0, i % 24, None if i % 17 == 0 else 20.0 + (i * 7) % 11, float((i * i) % 101), None if i % 41 == 0 else max(0, (i * 13) % 10 - 5), i // 2)

    return spark.createDataFrame([row(i) for i in range(800)] * 2, "domain STRING, year INT, time TIMESTAMP_NTZ, lat DOUBLE, lon DOUBLE, "
                                 "area_km2 DOUBLE, hour_of_day_local INT, T2M DOUBLE, CAPE DOUBLE, flash_count BIGINT, id BIGINT")


def watched(monkeypatch):
    """What is stored, the quantiles looked for, and the fits with their arguments."""
    from cellhour.functions import ordering

    stored, sought, fitted = [], [], []
    keep, find, fit = experiment.stored_rows, ordering.quantiles, experiment.fit
    monkeypatch.setattr(experiment, "stored_rows", lambda *a, **k: stored.append(a) or keep(*a, **k))
    monkeypatch.setattr(ordering, "quantiles", lambda *a, **k: sought.append(a) or find(*a, **k))
    monkeypatch.setattr(experiment, "fit", lambda *a, **k: fitted.append((a, fit(*a, **k))) or fitted[-1][1])
    return stored, sought, fitted, fit


ODD = experiment.Settings(features=("T2M", "CAPE"))


def test_a_sweep_stores_its_rows_and_finds_their_cut_once(odd_rows, tmp_path, monkeypatch):
    stored, sought, fitted, _ = watched(monkeypatch)
    fold = ([1995, 1996, 1997], 1998)
    swept = experiment.run_sweep(odd_rows, "hour_encoding", ("none", "raw"), ODD, str(tmp_path / "sweep"), fold, key=["id"])
    assert (len(stored), len(sought), len(fitted), swept.count()) == (1, 1, 2, 4)
    with pytest.raises(ValueError, match="no rows"):
        experiment.run_sweep(odd_rows, "hour_encoding", ("raw",), ODD, str(tmp_path / "none"), ([1900], 1901), key=["id"])


def test_a_grid_stores_each_domain_and_finds_each_cut_once(odd_rows, tmp_path, monkeypatch):
    from cellhour.operators import split

    stored, sought, fitted, fit = watched(monkeypatch)
    frames = {d: odd_rows.filter(F.col("domain") == d) for d in ("tropis", "subtropis")}
    scenarios = [("tropis_in", "tropis", "tropis"), ("tropis_to_sub", "tropis", "subtropis")]
    rows = experiment.run_grid(frames, ODD, str(tmp_path / "grid"), [([1995, 1996], 1997)], seeds=(0,), scenarios=scenarios, key=["id"]).collect()
    assert (len(stored), len(sought), len(fitted), len(rows)) == (2, 1, 2, 8)
    for given, done in fitted:
        alone = fit(frames["tropis"], *given[1:], key=["id"])
        assert done.train_rows == alone.train_rows and done.smearing == pytest.approx(alone.smearing)
        for name, model in alone.models.items():
            assert [done.models[name].intercept, *done.models[name].weights] == pytest.approx([model.intercept, *model.weights])
    years = [[1995], [1995, 1996, 1997], [1900]]
    cuts = [split.validation_cut(odd_rows.filter(F.col("year").isin(*y))) for y in years]
    assert split.validation_cuts(odd_rows, years) == cuts and cuts[2] is None
