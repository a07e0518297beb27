"""Fitted stages: invariants, persistence, and the same result under any partitioning."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from regimecast.operators import batched, clean, features, forest, metrics, normalise
from regimecast.operators.clustering import DualClusterer, DualClustererModel, FuzzyCMeans, fit_hard
from regimecast.operators.preprocess import SeriesPreprocessor, SeriesPreprocessorModel
from regimecast.plans import experiments
from regimecast.plans.forecasting import ForecastSettings, RegimeForecaster, RegimeForecasterModel, lag_frame, regime_columns
from regimecast.session import scratch_path
from tests.conftest import rows

TYPE = ["event_type"]


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(11)
    points = np.concatenate([rng.normal(c, 0.05, (40, 2)) for c in ((0, 0), (1, 1), (0, 1))])
    return spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "i int, x array<double>").persist()


def reference_fuzzy(x, centres, m, steps):
    for _ in range(steps):
        d = np.linalg.norm(x[:, None] - centres[None], axis=2)
        u = d ** (-2 / (m - 1))
        u /= u.sum(axis=1, keepdims=True)
        w = u**m
        centres = (w.T @ x) / w.sum(axis=0)[:, None]
    return centres


@pytest.mark.parametrize("m", [1.7, 2.0])
def test_fuzzy_updates_match_numpy(blobs, m):
    x = np.array([r["x"] for r in blobs.collect()])
    start = [[0.2, 0.1], [0.8, 0.9], [0.1, 0.7]]
    model = FuzzyCMeans(k=3, fuzziness=m, maxIter=5, tol=0.0, initCentres=start).fit(blobs)
    assert np.allclose(model.getOrDefault("centres"), reference_fuzzy(x, np.array(start), m, 4))


def test_fuzzy_fit_invariants(blobs):
    model = FuzzyCMeans(k=3, maxIter=60).fit(blobs)
    history = model.getOrDefault("history")
    assert all(b <= a + 1e-9 for a, b in zip(history, history[1:]))
    assert model.getOrDefault("iterations") < 60
    sums = [sum(r["u"]) for r in model.transform(blobs).collect()]
    assert sums == pytest.approx([1.0] * 120)
    found = sorted(tuple(np.round(c, 1) + 0.0) for c in model.getOrDefault("centres"))
    assert found == [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)]


def test_random_start_ignores_partitioning(blobs):
    fits = [FuzzyCMeans(k=3, maxIter=3).fit(blobs.repartition(n)).getOrDefault("centres") for n in (1, 4, 13)]
    assert np.allclose(fits[0], fits[1]) and np.allclose(fits[0], fits[2])


def test_fuzziness_must_exceed_one():
    with pytest.raises(ValueError):
        FuzzyCMeans(fuzziness=1.0)


def test_a_callers_cache_survives_a_fit(blobs):
    held = blobs.select("x").persist()
    held.count()
    FuzzyCMeans(k=2, maxIter=2).fit(held)
    fit_hard(held, "x", 2, n_init=1)
    assert held.storageLevel.useMemory


def test_aligned_labels_agree(blobs):
    model = DualClusterer(k=3, maxIter=30, nInit=2).fit(blobs)
    out = model.transform(blobs).withColumn("top", F.expr("array_position(u, array_max(u)) - 1"))
    assert out.where("k = top").count() == 120


def test_dual_model_inside_a_saved_pipeline(spark, blobs):
    fitted = Pipeline(stages=[DualClusterer(k=2, maxIter=5, nInit=1)]).fit(blobs)
    path = scratch_path(spark, "pipeline")
    fitted.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    assert isinstance(loaded.stages[0], DualClustererModel)
    assert rows(loaded.transform(blobs)) == rows(fitted.transform(blobs))


def test_preprocessor_round_trip(spark, views):
    df = views.hourly_gappy
    model = SeriesPreprocessor(TYPE, ["ts"], "y").fit(df)
    out = model.transform(df)
    span = out.agg(F.min("y_norm"), F.max("y_norm")).first()
    assert tuple(span) == (0.0, 1.0)
    back = model.inverse(out, "y_norm", "again")
    assert back.where(F.abs(F.col("again") - F.col("y")) > 1e-6).count() == 0
    path = scratch_path(spark, "prep")
    model.save(path)
    assert rows(SeriesPreprocessorModel.load(spark, path).transform(df)) == rows(out)


def test_series_without_variance_scales_to_zero(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), (None, 1.0), (None, 3.0)], "k string, y double")
    out = normalise.apply(df, normalise.fit(df, ["k"], "y"), ["k"], "y")
    got = {(r["k"], r["y"]): r["y_norm"] for r in out.collect()}
    assert got == {("a", 2.0): 0.0, (None, 1.0): 0.0, (None, 3.0): 1.0}


SMALL = ForecastSettings(
    keys=("event_type",), lags=(1, 2, 3), n_clusters=3, cluster_iterations=5, cluster_starts=1, trees=5, depth=4
)


@pytest.fixture(scope="module")
def fitted(spark):
    from regimecast.sources.views import Views
    from tests.conftest import SMALL as folder

    df = experiments.split_frame(Views(spark, folder).hourly_type, SMALL).persist()
    return df, RegimeForecaster(SMALL).fit(df.where("split = 'train'").drop("split"))


def test_tree_mean_is_the_forest_prediction(fitted):
    df, model = fitted
    framed = regime_columns(lag_frame(model.prep.transform(df.drop("split")), model.settings), model.settings, model.dual)
    scored = model.forest.transform(framed)
    plain = model.forest.model.setPredictionCol("whole").transform(
        forest.assemble(scored, model.forest.settings.features)
    )
    assert plain.where(F.abs(F.col("whole") - F.col("yhat")) > 1e-9).count() == 0
    assert plain.where("sigma < 0 OR sigma IS NULL").count() == 0


def test_forecasts_are_whole_and_ordered(fitted):
    df, model = fitted
    direct = model.predict_direct(df)
    per_series = {r[0]: r[1] for r in df.groupBy("event_type").count().collect()}
    assert direct.count() == sum(n - 3 for n in per_series.values())
    assert direct.where("NOT (lower <= yhat AND yhat <= upper)").count() == 0
    assert direct.where("target_ts IS NULL").count() == len(per_series)
    test = df.where("split = 'test'").drop("split")
    scored = model.evaluate(df.drop("split"), test)
    assert scored.count() == test.count()


def test_recursive_first_step_is_the_direct_forecast(fitted):
    df, model = fitted
    steps = model.predict_recursive(df, steps=5, cut_every=2)
    assert steps.groupBy("event_type").count().where("count <> 5").count() == 0
    first = steps.where("step = 1").select("event_type", "yhat", "lower", "upper")
    last = model.predict_direct(df).where("target_ts IS NULL").select("event_type", "yhat", "lower", "upper")
    assert rows(first, 6) == rows(last, 6)


@pytest.mark.parametrize("variant", ["full", "distance_indeterminacy", "raw"])
def test_walked_steps_are_the_projected_ones(fitted, monkeypatch, variant):
    df, model = fitted
    if variant != "full":
        settings = replace(model.settings, variant=variant)
        model = RegimeForecaster(settings).fit(df.where("split = 'train'").drop("split"), prep=model.prep, dual=model.dual)
    walked = rows(model.predict_recursive(df, steps=6), 6)
    monkeypatch.setattr(forest, "MAX_LEAVES", 0)
    model.forest._nodes.clear()
    assert rows(model.predict_recursive(df, steps=6, cut_every=3), 6) == walked
    assert len(walked) == 6 * df.select("event_type").distinct().count()
    model.forest._nodes.clear()


def test_leaf_table_is_tree_by_tree(fitted, monkeypatch):
    df, model = fitted
    framed = regime_columns(lag_frame(model.prep.transform(df.drop("split")), model.settings), model.settings, model.dual)
    three = model.with_trees(3).forest
    looked_up = rows(three.transform(framed).select("event_type", "ts", "yhat", "sigma"), 9)
    assert three.transform(framed)._jdf.queryExecution().toString().count("predictLeaf") <= 1
    monkeypatch.setattr(forest, "MAX_LEAVES", 0)
    model.forest._nodes.clear()
    assert rows(three.transform(framed).select("event_type", "ts", "yhat", "sigma"), 9) == looked_up
    model.forest._nodes.clear()


def test_robustness_is_that_of_each_level_alone(fitted):
    df, model = fitted
    got = {(r["kind"], r["level"]): r["rmse"] for r in experiments.robustness(df, SMALL, (0.0, 0.15), (0.2,), model).collect()}
    test, past = df.where("split = 'test'").drop("split"), df.where("split <> 'test'").drop("split")
    noisy = experiments.add_noise(test, TYPE, "ts", "y", 0.15)
    gappy = clean.fill(experiments.remove_values(test, TYPE, "ts", "y", 0.2), TYPE, ["ts"], "y")
    for key, touched in {("noise", 0.0): test, ("noise", 0.15): noisy, ("missing", 0.2): gappy}.items():
        alone = metrics.point(model.evaluate(past.unionByName(touched), test), []).first()["rmse"]
        assert got[key] == pytest.approx(alone)
    assert len(got) == 3


def test_batched_fits_are_plain_ones(blobs):
    x = np.array([r["x"] for r in blobs.collect()])
    found = batched.Rows(blobs.repartition(5), "x")
    fits = batched.fit_hard_many(found, [2, 3, 4], 4, tol=0.0)
    for k, runs in fits.items():
        for fit in runs:
            far = ((x[:, None] - fit.centres[None]) ** 2).sum(axis=2)
            assert fit.cost == pytest.approx(far.min(axis=1).sum())
            label = far.argmin(axis=1)
            assert np.allclose(fit.centres, [x[label == j].mean(axis=0) for j in range(k)])
    best = [min(runs, key=lambda f: f.cost) for runs in fits.values()]
    for fit, score in zip(best, batched.silhouettes(found, best)):
        label = ((x[:, None] - fit.centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        square = ((x[:, None] - x[None]) ** 2).sum(axis=2)
        values = []
        for i in range(len(x)):
            own = (label == label[i]).sum()
            a = square[i][label == label[i]].sum() / max(own - 1, 1)
            b = min(square[i][label == j].mean() for j in set(label) - {label[i]})
            values.append((b - a) / max(a, b) if own > 1 else 0.0)
        assert score == pytest.approx(np.mean(values))


def test_soft_fits_with_the_bound_are_the_plain_loop(blobs):
    x = np.array([r["x"] for r in blobs.collect()])
    start = np.array([[0.2, 0.1], [0.8, 0.9], [0.1, 0.7]])
    fit = batched.SoftClustering(start.copy(), fuzziness=2.0)
    batched.fit_soft_many(batched.Rows(blobs, "x"), [fit], 100, 1e-4)
    centres, before, passes = start, None, 0
    while True:
        u, _ = batched.memberships(x, centres, 2.0)
        passes += 1
        if before is not None and np.sqrt(((u - before) ** 2).sum()) < 1e-4:
            break
        w = u * u
        before, centres = u, (w.T @ x) / w.sum(axis=0)[:, None]
    assert fit.settled and fit.passes == passes
    assert np.allclose(fit.centres, centres, atol=1e-6)


def test_short_series_is_reported(fitted):
    df, model = fitted
    first = df.where("event_type = 'view'").orderBy("ts").limit(3)
    steps = model.predict_recursive(df.where("event_type <> 'view'").unionByName(first), steps=3)
    assert steps.where("event_type = 'view'").count() == 3
    assert steps.where("event_type = 'view' AND yhat IS NOT NULL").count() == 0
    assert steps.where("event_type <> 'view' AND yhat IS NULL").count() == 0


def test_null_series_is_evaluated(fitted):
    df, model = fitted
    settings = model.settings
    named = df.withColumn("event_type", F.nullif("event_type", F.lit("view")))
    train = named.where("split = 'train'").drop("split")
    refit = RegimeForecaster(settings).fit(train, dual=model.dual)
    test = named.where("split = 'test'").drop("split")
    scored = refit.evaluate(named.drop("split"), test)
    assert scored.count() == test.count()
    assert scored.where("event_type IS NULL AND yhat IS NOT NULL").count() > 0


def test_saved_forecaster(spark, fitted):
    df, model = fitted
    path = scratch_path(spark, "forecaster")
    model.save(path)
    loaded = RegimeForecasterModel.load(spark, path)
    assert loaded.settings == model.settings
    assert rows(loaded.predict_direct(df), 6) == rows(model.predict_direct(df), 6)


def test_importance_covers_every_feature(fitted):
    _, model = fitted
    table = model.forest.importance().collect()
    assert {r["feature"] for r in table} == set(model.settings.feature_columns())
    assert sum(r["importance"] for r in table) == pytest.approx(1.0)
    share = model.forest.tif_share().first()
    assert 0 <= share["tif_share"] <= 1 and share["strongest"] in forest.TIF_FEATURES


def test_feature_sets_differ():
    sizes = {v: len(replace(SMALL, variant=v).feature_columns()) for v in experiments.VARIANTS}
    assert sizes == {
        "full": 13, "without_tif": 10, "hard_only": 7, "soft_only": 7, "without_indeterminacy": 12,
        "distance_indeterminacy": 13, "raw": 4,
    }
    with pytest.raises(ValueError):
        replace(SMALL, variant="none").feature_columns()


def test_ablation_and_sensitivity_tables(fitted):
    df, _ = fitted
    scores = experiments.score_table(
        experiments.ablation(df, SMALL, ["full", "distance_indeterminacy"]), ["model"]
    ).collect()
    assert {r["model"] for r in scores} == {"full", "distance_indeterminacy", "linear_lags"}
    table = experiments.sensitivity(df, SMALL, {"gamma": (1.0, 2.0), "beta": (0.5,), "trees": (3,)}).collect()
    assert len(table) == 4 and sum(r["is_best"] for r in table) == 3
    cover = {r["setting"]: r["picp"] for r in table if r["parameter"] == "gamma"}
    assert cover[2.0] >= cover[1.0]


def test_missing_values_are_exactly_the_share(views):
    df = views.hourly_type
    out = experiments.remove_values(df, TYPE, "ts", "y", 0.2)
    counts = out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y").isNull()).alias("m"))
    assert all(r["m"] == int(r["n"] * 0.2) for r in counts.collect())
    assert rows(experiments.add_noise(df.repartition(3), TYPE, "ts", "y", 0.1)) == rows(
        experiments.add_noise(df.repartition(11), TYPE, "ts", "y", 0.1)
    )


def test_robustness_starts_from_the_clean_score(fitted):
    df, model = fitted
    table = experiments.robustness(df, SMALL, noise=(0.0, 0.2), missing=(0.0,)).collect()
    clean = [r["rmse"] for r in table if r["level"] == 0.0]
    assert clean[0] == pytest.approx(clean[1])


@pytest.mark.parametrize("n", [1, 4, 13])
def test_ordered_features_ignore_partitioning(views, n):
    want = rows(features.add_lags(views.hourly_type, TYPE, ["ts"], "y"))
    mixed = views.hourly_type.repartition(n, F.rand(5))
    assert rows(features.add_lags(mixed, TYPE, ["ts"], "y")) == want


def test_leaf_table_holds_where_few_trees_are_looked_up_too(fitted, monkeypatch):
    monkeypatch.setattr(forest, "_FEW_TREES", 0)
    test_leaf_table_is_tree_by_tree(fitted, monkeypatch)
    test_tree_mean_is_the_forest_prediction(fitted)
