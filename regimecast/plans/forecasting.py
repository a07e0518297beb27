"""End-to-end forecasting: preprocess, discover regimes, score T/I/F, train, predict with intervals."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regimecast.functions import vectors as vec
from regimecast.functions.tails import normal_quantile
from regimecast.operators import normalise, regimes
from regimecast.operators.clustering import DualClusterer, DualClustererModel
from regimecast.operators.forest import UncertainForest, UncertainForestModel
from regimecast.operators.ordering import last_rows, over_series
from regimecast.operators.preprocess import SeriesPreprocessor, SeriesPreprocessorModel
from regimecast.plans.recursion import Walker, walk
from regimecast.session import kept, materialise

# Fixed names of the feature sets an ablation can choose.
VARIANTS = (
    "full", "without_tif", "hard_only", "soft_only", "without_indeterminacy", "distance_indeterminacy", "raw",
)


@dataclass(frozen=True)
class ForecastSettings:
    keys: tuple[str, ...]
    ts: str = "ts"
    value: str = "y"
    lags: tuple[int, ...] = (1, 2, 3, 6, 12, 24)
    horizon: int = 1
    n_clusters: int = 5
    fuzziness: float = 2.0
    cluster_iterations: int = 100
    cluster_starts: int = 10
    align: bool = True
    trees: int = 100
    depth: int = 20
    gamma: float | None = None
    beta: float = 1.0
    level: float = 0.95
    variant: str = "full"
    outlier_z: float = 3.0
    seed: int = 42

    def originals(self) -> list[str]:
        return ["y_norm", *[f"lag_{k}" for k in self.lags]]

    def feature_columns(self) -> list[str]:
        """Columns of the chosen feature set in order."""
        hard = [f"hard_{j}" for j in range(self.n_clusters)]
        soft = [f"soft_{j}" for j in range(self.n_clusters)]
        tif = ["truth", "indeterminacy", "falsity"]
        sets = {
            "full": [*hard, *soft, *tif],
            "without_tif": [*hard, *soft],
            "hard_only": hard,
            "soft_only": soft,
            "without_indeterminacy": [*hard, *soft, "truth", "falsity"],
            "distance_indeterminacy": [*hard, *soft, *tif],
            "raw": [],
        }
        if self.variant not in sets:
            raise ValueError(f"unknown variant {self.variant!r}; known: {list(VARIANTS)}")
        return [*self.originals(), *sets[self.variant]]


def regime_features(clean: DataFrame) -> DataFrame:
    """What the regimes are discovered in."""
    return clean.select(F.array("y_norm").alias("x"))


def regime_columns(df: DataFrame, settings: ForecastSettings, dual: DualClustererModel) -> DataFrame:
    """Hard and soft regimes of the current value with T, I, F and their feature columns."""
    size = len(dual.getOrDefault("softCentres"))
    rows = dual.transform(df.withColumn("x", F.array("y_norm")))
    rows = regimes.tif(rows, "k", "u", size)
    if settings.variant == "distance_indeterminacy":
        # Ambiguity from the two closest centres instead of the entropy: equal distances give 1.
        near = F.array_sort(F.array(*vec.distances("x", dual.getOrDefault("softCentres"))))
        ratio = F.get(near, F.lit(0)) / F.nullif(F.get(near, F.lit(1)), F.lit(0.0))
        rows = rows.withColumn("indeterminacy", F.coalesce(ratio, F.lit(0.0)))
    return regimes.enrich(rows, settings.originals(), "k", "u", size).drop("x", "u", "k")


def lag_frame(df: DataFrame, settings: ForecastSettings) -> DataFrame:
    """Current value, its lags and the value ``horizon`` rows ahead, which is null at the end."""
    s = settings

    def build(w) -> dict[str, Column]:
        out = {f"lag_{k}": F.lag("y_norm", k).over(w) for k in s.lags}
        out["target"] = F.lead("y_norm", s.horizon).over(w)
        out["target_ts"] = F.lead(s.ts, s.horizon).over(w)
        return out

    framed = over_series(df, list(s.keys), [F.col(s.ts)], build, back=max(s.lags), ahead=s.horizon)
    return framed.na.drop(subset=[f"lag_{k}" for k in s.lags])


@dataclass(frozen=True)
class RegimeForecaster:
    settings: ForecastSettings

    def preprocessor(self) -> SeriesPreprocessor:
        s = self.settings
        return SeriesPreprocessor(list(s.keys), [s.ts], s.value, outlier_z=s.outlier_z)

    def clusterer(self) -> DualClusterer:
        s = self.settings
        return DualClusterer(
            k=s.n_clusters, fuzziness=s.fuzziness, maxIter=s.cluster_iterations, seed=s.seed,
            nInit=s.cluster_starts, align=s.align,
        )

    def discover(self, clean: DataFrame) -> DualClustererModel:
        return self.clusterer().fit(regime_features(clean))

    def fit(
        self,
        train: DataFrame,
        prep: SeriesPreprocessorModel | None = None,
        dual: DualClustererModel | None = None,
    ) -> "RegimeForecasterModel":
        """Fit the stages in order; stages already fitted on the same rows can be passed in."""
        s = self.settings
        prep = prep or self.preprocessor().fit(train)
        with kept(prep.transform(train.select(*s.keys, s.ts, s.value))) as clean:
            dual = dual or self.discover(clean)
            s = replace(s, n_clusters=len(dual.getOrDefault("softCentres")))
            rows = regime_columns(lag_frame(clean, s), s, dual).where(F.col("target").isNotNull())
            forest = UncertainForest(s.feature_columns(), "target", s.trees, s.depth, seed=s.seed).fit(rows)
        return RegimeForecasterModel(s, prep, dual, forest)


@dataclass(frozen=True)
class RegimeForecasterModel:
    settings: ForecastSettings
    prep: SeriesPreprocessorModel = field(repr=False)
    dual: DualClustererModel = field(repr=False)
    forest: UncertainForestModel = field(repr=False)

    def with_trees(self, trees: int) -> "RegimeForecasterModel":
        """The model with the first ``trees`` trees of its forest."""
        forest = replace(self.forest, settings=replace(self.forest.settings, trees=trees))
        return replace(self, settings=replace(self.settings, trees=trees), forest=forest)

    def _intervals(self, scored: DataFrame) -> DataFrame:
        s = self.settings
        gamma = s.gamma if s.gamma is not None else normal_quantile(s.level)
        half = F.lit(gamma) * F.col("sigma") + F.lit(s.beta) * F.col("indeterminacy")
        return scored.withColumns({"_lower": F.col("yhat") - half, "_upper": F.col("yhat") + half})

    def _original_units(self, scored: DataFrame) -> DataFrame:
        s, method = self.settings, self.prep.settings.method
        names = {"yhat": "yhat", "_lower": "lower", "_upper": "upper"}
        return normalise.invert_all(scored, self.prep.params, list(s.keys), names, method)

    def score_features(self, df: DataFrame) -> DataFrame:
        return self._intervals(self.forest.transform(regime_columns(df, self.settings, self.dual)))

    def _framed(self, df: DataFrame) -> DataFrame:
        s = self.settings
        return lag_frame(self.prep.transform(df.select(*s.keys, s.ts, s.value)), s)

    def predict_direct(self, df: DataFrame) -> DataFrame:
        """One forecast per row for the time ``horizon`` rows later, original units.

        Rows at the end of a series, whose target lies in the future, have a null ``target_ts``.
        """
        s = self.settings
        out = self._original_units(self.score_features(self._framed(df)))
        return out.select(*s.keys, s.ts, "target_ts", "yhat", "lower", "upper", "sigma", "indeterminacy")

    def evaluate(self, df: DataFrame, truth: DataFrame | None = None) -> DataFrame:
        """Forecasts next to the truth: (keys, ts, y, yhat, lower, upper) at the target time.

        ``truth`` holds the rows to score when they differ from the model's input, for example a
        test split or a clean copy of noisy input. Only those rows reach the forest.
        """
        s = self.settings
        truth = df if truth is None else truth
        truth = truth.select(*s.keys, F.col(s.ts).alias("target_ts"), F.col(s.value).alias("_truth"))
        truth = truth.select(*[F.col(k).alias(f"_t_{k}") for k in s.keys], F.col("target_ts").alias("_t_ts"), "_truth")
        rows = self._framed(df)
        match = rows["target_ts"] == truth["_t_ts"]
        for k in s.keys:
            match = match & rows[k].eqNullSafe(truth[f"_t_{k}"])
        framed = rows.join(truth, match).drop("_t_ts", *[f"_t_{k}" for k in s.keys])
        out = self._original_units(self.score_features(framed))
        return out.select(
            *s.keys, F.col("target_ts").alias(s.ts), F.col("_truth").alias("y"), "yhat", "lower", "upper"
        )

    def predict_recursive(self, df: DataFrame, steps: int = 180, cut_every: int = 10) -> DataFrame:
        """Forecast ``steps`` rows past the end of every series, feeding predictions back.

        The state of a series is the array of its last values, and a task carries its series through all
        steps. A forest with too many nodes for that takes one projection a step. A series with fewer rows
        than the lags need gets one row per step with null forecasts.
        """
        s = self.settings
        keys, depth = list(s.keys), max(s.lags) + 1
        clean = self.prep.transform(df.select(*keys, s.ts, s.value))
        back = last_rows(clean, keys, s.ts, depth)
        state = back.groupBy(*keys).agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("i"), F.col("y_norm").alias("v")))),
                lambda e: e["v"],
            ).alias("recent"),
        )
        state = materialise(state)
        short = state.where(F.size("recent") < depth).select(*keys, F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
        state = state.where(F.size("recent") == depth)
        table = self.forest.nodes(df.sparkSession)
        if table is None:
            done = self._step_by_step(state, steps, cut_every)
        else:
            held = df.sparkSession.sparkContext.broadcast(self._walker(table))
            flat = F.pandas_udf(walk(held, steps), "array<double>")("recent")
            points = state.select(*keys, flat.alias("_f"), F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
            part = lambda i: F.get("_f", 3 * (F.col("step") - 1) + i)
            names = ["yhat", "sigma", "indeterminacy"]
            done = self._intervals(points.select(*keys, "step", *[part(i).alias(n) for i, n in enumerate(names)]))
        names = [*keys, "step", "yhat", "lower", "upper", "sigma", "indeterminacy"]
        return self._original_units(done).select(*names).unionByName(short, allowMissingColumns=True)

    def _walker(self, table) -> Walker:
        s, f = self.settings, self.forest.settings
        table = table[table["treeID"] < f.trees]
        start = table.groupby("treeID").size().cumsum().shift(fill_value=0)
        base = table["treeID"].map(start).to_numpy()
        left, right = (np.where(table[c] >= 0, table[c] + base, -1) for c in ("left", "right"))
        return Walker(
            np.asarray(self.dual.getOrDefault("hardCentres")), np.asarray(self.dual.getOrDefault("softCentres")),
            self.dual.getOrDefault("fuzziness"), tuple(s.lags), tuple(f.features), s.variant == "distance_indeterminacy",
            table["feature"].to_numpy(), table["threshold"].to_numpy(float), left, right, table["value"].to_numpy(float), start.to_numpy(),
        )

    def _step_by_step(self, state: DataFrame, steps: int, cut_every: int = 10) -> DataFrame:
        """The same with one projection a step, for a forest too large for the tasks; the lineage is cut every few steps."""
        s, keys = self.settings, list(self.settings.keys)
        depth = max(s.lags) + 1
        done: DataFrame | None = None
        pending: list[str] = []
        for step in range(1, steps + 1):
            at = lambda k: F.get("recent", F.lit(depth - 1 - k))
            rows = state.withColumns({"y_norm": at(0), **{f"lag_{k}": at(k) for k in s.lags}})
            scored = self.score_features(rows)
            kept = [c for c in state.columns if c != "recent"]
            point = F.struct(
                F.lit(step).alias("step"), "yhat", F.col("_lower"), F.col("_upper"), "sigma", "indeterminacy"
            )
            state = scored.select(
                *kept,
                F.concat(F.slice("recent", 2, depth - 1), F.array("yhat")).alias("recent"),
                point.alias(f"_s{step}"),
            )
            pending.append(f"_s{step}")
            if step % cut_every == 0 or step == steps:
                state = materialise(state)
                part = state.select(*keys, F.explode(F.array(*pending)).alias("_p")).select(*keys, "_p.*")
                done = part if done is None else done.unionByName(part)
                state, pending = state.select(*keys, "recent"), []
        return done

    def save(self, path: str) -> None:
        self.prep.save(f"{path}/preprocess")
        self.dual.write().overwrite().save(f"{path}/dual")
        self.forest.save(f"{path}/forest")
        spark = self.prep.params.sparkSession
        row = [(json.dumps(asdict(self.settings)),)]
        spark.createDataFrame(row, "settings string").write.mode("overwrite").json(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "RegimeForecasterModel":
        row = spark.read.schema("settings string").json(f"{path}/settings").first()
        raw = json.loads(row["settings"])
        settings = ForecastSettings(**{**raw, "keys": tuple(raw["keys"]), "lags": tuple(raw["lags"])})
        return RegimeForecasterModel(
            settings,
            SeriesPreprocessorModel.load(spark, f"{path}/preprocess"),
            DualClustererModel.load(f"{path}/dual"),
            UncertainForestModel.load(spark, f"{path}/forest"),
        )


def model_features(df: DataFrame, keys: Sequence[str], ts: str, value: str, n_lags: int = 24) -> DataFrame:
    """Raw lag columns for the baselines: the row's own value is the target."""

    def build(w) -> dict[str, Column]:
        return {f"lag_{k}": F.lag(value, k).over(w) for k in range(n_lags, 0, -1)}

    out = over_series(df, list(keys), [F.col(ts)], build, back=n_lags)
    return out.na.drop(subset=[f"lag_{n_lags}"]).withColumn("target", F.col(value))

