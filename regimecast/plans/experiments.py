"""Experiment grids. Each loops over a few configurations on the driver and unions lazy long
prediction tables (keys, ts, model, y, yhat, lower, upper); measures are grouped queries over them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import replace
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regimecast.operators import features, forest, metrics, significance
from regimecast.operators.clean import fill
from regimecast.operators.clustering import fit_dual_many
from regimecast.operators.ordering import join_params, row_index
from regimecast.plans.forecasting import (
    VARIANTS,
    ForecastSettings,
    RegimeForecaster,
    RegimeForecasterModel,
    model_features,
    regime_features,
)
from regimecast.session import kept, materialise

# Fixed values of the experiment grids.
NOISE_LEVELS = (0.0, 0.05, 0.10, 0.15, 0.20)
MISSING_RATES = (0.0, 0.05, 0.10, 0.15, 0.20)
SENSITIVITY = {
    "n_clusters": (3, 4, 5, 6, 7, 8),
    "fuzziness": (1.5, 2.0, 2.5, 3.0),
    "trees": (50, 100, 150, 200),
    "gamma": (1.0, 1.5, 1.96, 2.0, 2.5),
    "beta": (0.5, 1.0, 1.5, 2.0),
}
Z95 = 1.96
PARALLEL_FITS = 8
PROPOSED = "regime_forest"


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def split_frame(df: DataFrame, settings: ForecastSettings, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """(keys, ts, value, split), written once: an experiment passes over it for every fit and score."""
    s = settings
    return materialise(
        features.chronological_split(df.select(*s.keys, s.ts, s.value), list(s.keys), [s.ts], train, val)
    )


def _part(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.col("split") == name).drop("split")


def _banded(scored: DataFrame) -> DataFrame:
    half = Z95 * F.col("sigma")
    return scored.withColumns({"lower": F.col("yhat") - half, "upper": F.col("yhat") + half})


def proposed_predictions(
    rows: DataFrame, settings: ForecastSettings, name: str = PROPOSED, **stages: object
) -> DataFrame:
    """Fit on the training split, forecast the test split."""
    model = RegimeForecaster(settings).fit(_part(rows, "train"), **stages)
    return model.evaluate(rows.drop("split"), _part(rows, "test")).withColumn("model", F.lit(name))


def _baselines(settings: ForecastSettings, rounds: int) -> dict[str, Callable[..., DataFrame]]:
    s = settings
    return {
        "vanilla_forest": lambda tr, te, x: forest.vanilla_forest(tr, te, x, trees=s.trees, depth=s.depth, seed=s.seed),
        "boosted_trees": lambda tr, te, x: forest.boosted_trees(tr, te, x, rounds=rounds, seed=s.seed),
        "linear_lags": forest.linear_lags,
    }


def baseline_predictions(
    rows: DataFrame, settings: ForecastSettings, names: Sequence[str] | None = None, n_lags: int = 24, rounds: int = 100
) -> DataFrame:
    """The trained baselines on raw lags, fitted on the training split."""
    s = settings
    framed = model_features(rows, s.keys, s.ts, s.value, n_lags)
    x = [f"lag_{k}" for k in range(n_lags, 0, -1)]
    train, test = _part(framed, "train"), _part(framed, "test")
    known = _baselines(s, rounds)
    out = []
    for name in names or known:
        scored = _banded(known[name](train, test, x))
        out.append(
            scored.select(
                *s.keys, s.ts, F.col(s.value).alias("y"), "yhat", "lower", "upper", F.lit(name).alias("model")
            )
        )
    return _union(out)


def compare_baselines(
    datasets: dict[str, DataFrame], settings: ForecastSettings, rounds: int = 100, names: Sequence[str] | None = None
) -> DataFrame:
    """Predictions of the proposed model and every baseline on every data set."""
    out = []
    for name, df in datasets.items():
        rows = split_frame(df, settings)
        for predictions in (
            proposed_predictions(rows, settings),
            baseline_predictions(rows, settings, names, rounds=rounds),
        ):
            out.append(predictions.withColumn("dataset", F.lit(name)))
    return _union(out)


def score_table(predictions: DataFrame, by: Sequence[str] = ("dataset", "model")) -> DataFrame:
    aggs = {**metrics.point_metrics(), **metrics.interval_metrics()}
    return predictions.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])


def reference_tests(predictions: DataFrame, settings: ForecastSettings, reference: str = PROPOSED) -> DataFrame:
    """The proposed model against each baseline per data set, on the rows both predict."""
    row_key = ["dataset", *settings.keys, settings.ts]
    return significance.against_reference(predictions, ["dataset"], row_key, reference)


def _shared_stages(rows: DataFrame, settings: ForecastSettings) -> tuple[RegimeForecaster, dict[str, object]]:
    plan, train = RegimeForecaster(settings), _part(rows, "train")
    prep = plan.preprocessor().fit(train)
    with kept(prep.transform(train)) as clean:
        return plan, {"prep": prep, "dual": plan.discover(clean)}


def _at_once(spark: SparkSession, tasks: Sequence[Callable[[], object]], parallelism: int = PARALLEL_FITS) -> list:
    """Independent fits, a few at a time: the passes of one leave most of a cluster idle."""
    with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda task: task()), tasks)


def ablation(rows: DataFrame, settings: ForecastSettings, variants: Sequence[str] = VARIANTS) -> DataFrame:
    """Predictions with real subsets of the features, and a linear model on lags.

    Preprocessing and regimes are the same for every subset and fitted once.
    """
    first, stages = _shared_stages(rows, settings)
    fit = lambda v: lambda: proposed_predictions(rows, replace(first.settings, variant=v), v, **stages)
    frames = _at_once(rows.sparkSession, [fit(v) for v in variants])
    frames.append(baseline_predictions(rows, settings, ["linear_lags"]))
    return _union(frames)


def sensitivity(
    rows: DataFrame, settings: ForecastSettings, grid: dict[str, Sequence[float]] | None = None
) -> DataFrame:
    """RMSE and coverage along each parameter, every setting by itself against the others' defaults."""
    return sensitivity_table(sensitivity_predictions(rows, settings, grid))


def sensitivity_table(predictions: DataFrame) -> DataFrame:
    """RMSE, coverage and the best setting of every parameter."""
    table = predictions.groupBy("parameter", "setting").agg(
        metrics.point_metrics()["rmse"].alias("rmse"), F.avg(metrics.covered()).alias("picp")
    )
    order = Window.partitionBy("parameter").orderBy("rmse", "setting")
    return table.withColumn("is_best", F.row_number().over(order) == 1)


def sensitivity_predictions(
    rows: DataFrame, settings: ForecastSettings, grid: dict[str, Sequence[float]] | None = None
) -> DataFrame:
    """Test forecasts of every setting: (keys, ts, y, yhat, lower, upper, parameter, setting).

    Nothing here changes the preprocessing. The regimes of all settings are discovered in shared passes.
    Interval parameters do not change the fit. The largest forest is fitted once, and a smaller one is its first trees.
    """
    grid = SENSITIVITY if grid is None else grid
    train, test, inputs = _part(rows, "train"), _part(rows, "test"), rows.drop("split")
    trees = max([settings.trees, *map(int, grid.get("trees", ()))])
    plans = {None: RegimeForecaster(replace(settings, trees=trees))}
    for name in ("n_clusters", "fuzziness"):
        for value in grid.get(name, ()):
            if value != getattr(settings, name):
                plans[name, value] = RegimeForecaster(replace(settings, **{name: value}))
    prep = plans[None].preprocessor().fit(train)
    with kept(prep.transform(train)) as clean:
        duals = fit_dual_many(regime_features(clean), [p.clusterer() for p in plans.values()])
    fit = lambda plan, dual: lambda: plan.fit(train, prep=prep, dual=dual)
    fitted = dict(zip(plans, _at_once(rows.sparkSession, [fit(p, d) for p, d in zip(plans.values(), duals)])))
    shared = fitted[None].with_trees(settings.trees)
    out = []
    for name, values in grid.items():
        for value in values:
            if name == "trees":
                model = fitted[None].with_trees(int(value))
            elif name in ("gamma", "beta"):
                model = replace(shared, settings=replace(shared.settings, **{name: value}))
            else:
                model = fitted.get((name, value), shared)
            tags = {"parameter": F.lit(name), "setting": F.lit(float(value))}
            out.append(model.evaluate(inputs, test).withColumns(tags))
    return _union(out)


def cross_dataset(datasets: dict[str, DataFrame], settings: ForecastSettings) -> DataFrame:
    """Train on one data set, test on each other one; one fit per training set.

    The input is scaled with the target set's own parameters: its series have other units.
    """
    parts = {name: split_frame(df, settings) for name, df in datasets.items()}
    out = []
    for source in datasets:
        model = RegimeForecaster(settings).fit(_part(parts[source], "train"))
        for target in datasets:
            if source == target:
                continue
            rows = parts[target]
            local = replace(model, prep=model.prep.settings.fit(_part(rows, "train")))
            predictions = local.evaluate(rows.drop("split"), _part(rows, "test"))
            out.append(
                predictions.withColumns({"train_set": F.lit(source), "test_set": F.lit(target)})
            )
    return _union(out)


def _unit(row_key: Sequence[str], salt: int) -> Column:
    h = F.xxhash64(*[F.col(c) for c in row_key], F.lit(salt))
    return (F.pmod(h, F.lit(1 << 52)) + 1) / float(1 << 52)


def add_noise(df: DataFrame, keys: Sequence[str], ts: str, value: str, level: float, seed: int = 42) -> DataFrame:
    """Gaussian noise of a share of the series' deviation, clipped at 0; the same in every run."""
    spread = df.groupBy(*keys).agg(F.stddev_samp(value).alias("_sd"))
    row_key = [*keys, ts]
    z = F.sqrt(-2.0 * F.log(_unit(row_key, seed))) * F.cos(2.0 * F.pi() * _unit(row_key, seed + 1))
    noisy = F.greatest(F.col(value) + level * F.col("_sd") * z, F.lit(0.0))
    return join_params(df, spread, keys).withColumn(value, noisy).select(*df.columns)


def remove_values(df: DataFrame, keys: Sequence[str], ts: str, value: str, rate: float, seed: int = 42) -> DataFrame:
    """Null exactly the floored share of each series, chosen by hash order."""
    row_key = [*keys, ts]
    shuffled = row_index(df, keys, [F.xxhash64(*[F.col(c) for c in row_key], F.lit(seed)), F.col(ts)], "_i")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    gone = F.col("_i") < F.floor(F.col("_n") * rate)
    return join_params(shuffled, sizes, keys).withColumn(value, F.when(~gone, F.col(value))).select(*df.columns)


def disturbed(
    test: DataFrame,
    settings: ForecastSettings,
    noise: Sequence[float] = NOISE_LEVELS,
    missing: Sequence[float] = MISSING_RATES,
) -> DataFrame:
    """The rows once for every kind of disturbance and level, which join the series keys as ``kind`` and ``level``.

    Values and gaps of a level are those of ``add_noise`` and ``remove_values``; gaps are not filled yet.
    """
    s, keys = settings, list(settings.keys)
    row_key = [*keys, s.ts]
    facts = test.groupBy(*keys).agg(F.stddev_samp(s.value).alias("_sd"), F.count(F.lit(1)).alias("_n"))
    placed = row_index(test, keys, [F.xxhash64(*[F.col(c) for c in row_key], F.lit(s.seed)), F.col(s.ts)], "_i")
    levels = [F.struct(F.lit(k).alias("kind"), F.lit(float(v)).alias("level")) for k, vs in (("noise", noise), ("missing", missing)) for v in vs]
    wide = join_params(placed, facts, keys).withColumn("_l", F.explode(F.array(*levels))).select("*", "_l.*")
    z = F.sqrt(-2.0 * F.log(_unit(row_key, s.seed))) * F.cos(2.0 * F.pi() * _unit(row_key, s.seed + 1))
    noisy = F.greatest(F.col(s.value) + F.col("level") * F.col("_sd") * z, F.lit(0.0))
    gappy = F.when(F.col("_i") >= F.floor(F.col("_n") * F.col("level")), F.col(s.value))
    changed = F.when(F.col("kind") == "noise", noisy).otherwise(gappy)
    return wide.withColumn(s.value, changed).select("kind", "level", *test.columns)


def robustness(
    rows: DataFrame,
    settings: ForecastSettings,
    noise: Sequence[float] = NOISE_LEVELS,
    missing: Sequence[float] = MISSING_RATES,
    model: RegimeForecasterModel | None = None,
) -> DataFrame:
    """RMSE on the clean test split when the test input is noisy or has gaps; one fitted model.

    Kind and level are part of the series key, so all levels are filled, framed and scored in one pass.
    """
    s = settings
    model = model or RegimeForecaster(s).fit(_part(rows, "train"))
    test = _part(rows, "test")
    keys = ["kind", "level", *s.keys]
    touched = fill(disturbed(test, s, noise, missing), keys, [s.ts], s.value)
    tags = touched.sparkSession.createDataFrame(
        [(k, float(v)) for k, vs in (("noise", noise), ("missing", missing)) for v in vs], "kind string, level double"
    )
    every = lambda df: df.join(F.broadcast(tags))  # noqa: E731  one row for each level
    prep = model.prep
    prep = replace(prep, settings=replace(prep.settings, keys=keys), params=every(prep.params))
    by_level = replace(model, settings=replace(model.settings, keys=tuple(keys)), prep=prep)
    past = every(rows.where(F.col("split") != "test").drop("split"))
    scored = by_level.evaluate(past.unionByName(touched), every(test))
    return scored.groupBy("kind", "level").agg(metrics.point_metrics()["rmse"].alias("rmse"))


def summarise(scores: DataFrame, baseline: str, by: str = "dataset") -> DataFrame:
    """Rank by RMSE per data set, the best model, and degradation against the baseline in percent."""
    w = Window.partitionBy(by)  # a handful of models per data set
    base = F.max(F.when(F.col("model") == baseline, F.col("rmse"))).over(w)
    return scores.select(
        by,
        "model",
        "rmse",
        F.row_number().over(w.orderBy("rmse", "model")).alias("rank"),
        ((F.col("rmse") - base) / base * 100).alias("degradation"),
    ).withColumn("is_best", F.col("rank") == 1)


def significant_wins(tests: DataFrame, by: str = "dataset") -> DataFrame:
    """How many models the reference beats significantly: a negative statistic favours it."""
    win = F.col("significant") & (F.col("statistic") < 0)
    return tests.groupBy(by).agg(F.count(F.lit(1)).alias("comparisons"), F.count_if(win).alias("wins"))
