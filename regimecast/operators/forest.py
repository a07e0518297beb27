"""Tree ensembles with per-tree spread, and the other trained baselines."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    GBTRegressor,
    LinearRegression,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimecast.session import kept, scratch_path

#: Numbers (rows times features) of a training task, 26,000 rows of 20 features.
_TASK_NUMBERS = 1 << 19
#: Leaves of all trees whose values are broadcast, 8 bytes each.
MAX_LEAVES = 4_000_000
#: Trees that are scored one by one: their plan is short, and no row leaves the JVM.
_FEW_TREES = 8
TIF_FEATURES = ("truth", "indeterminacy", "falsity")


def assemble(df: DataFrame, features: Sequence[str], name: str = "_features") -> DataFrame:
    """Feature vector of the named columns; a null or NaN entry raises."""
    return VectorAssembler(inputCols=list(features), outputCol=name, handleInvalid="error").transform(df)


def _few_tasks(rows: DataFrame, width: int) -> DataFrame:
    """Tasks of equal size whose number grows with the rows, at most one for every core.

    Every task of a training pass sends statistics of all nodes, so few rows stay together. Rows are dealt
    anew where they lie in fewer partitions: those of series come in one for each series or less.
    """
    context = rows.sparkSession.sparkContext
    wanted = max(1, -(-rows.count() * width // _TASK_NUMBERS))
    return rows.repartition(min(wanted, max(1, context.defaultParallelism)))


@dataclass(frozen=True)
class UncertainForest:
    """Random forest whose trees also give the spread of each prediction."""

    features: Sequence[str]
    label: str = "target"
    trees: int = 100
    depth: int = 20
    subset: str = "sqrt"
    min_rows: int = 1
    seed: int = 42

    def fit(self, df: DataFrame) -> "UncertainForestModel":
        forest = RandomForestRegressor(
            featuresCol="_features",
            labelCol=self.label,
            predictionCol="yhat",
            numTrees=self.trees,
            maxDepth=self.depth,
            featureSubsetStrategy=self.subset,
            minInstancesPerNode=self.min_rows,
            seed=self.seed,
            # Deep trees: remember the node of every row and grow many nodes in a pass.
            cacheNodeIds=True,
            maxMemoryInMB=1024,
        )
        rows = assemble(df.select(*self.features, self.label), self.features).select("_features", self.label)
        with kept(rows) as held:
            return UncertainForestModel(self, forest.fit(_few_tasks(held, len(self.features))))


@dataclass(frozen=True)
class UncertainForestModel:
    settings: UncertainForest
    model: RandomForestRegressionModel = field(repr=False)
    _nodes: list = field(default_factory=list, repr=False, compare=False)

    def transform(self, df: DataFrame, yhat: str = "yhat", sigma: str = "sigma") -> DataFrame:
        """Mean of the first ``settings.trees`` trees and their population deviation.

        One ML transform finds the leaf of every tree, and the values of the leaves are looked up in a
        broadcast table. A forest with more than ``MAX_LEAVES`` leaves or few trees is scored tree by tree instead.
        The mean over all trees is the model's own prediction, so without ``sigma`` nothing is looked up.
        """
        rows = assemble(df, self.settings.features)
        n = min(self.settings.trees, self.model.getNumTrees)
        table = self.leaf_values(df.sparkSession) if n > _FEW_TREES else None
        if table is None:
            return self._tree_by_tree(rows, n, yhat, sigma)
        ends = np.cumsum([0, *map(len, table)])[:n]
        held = rows.sparkSession.sparkContext.broadcast((np.concatenate(table), ends))

        def spread(leaves: pd.Series) -> pd.DataFrame:
            values, starts = held.value
            if not len(leaves):
                return pd.DataFrame({"m": [], "s": []}, dtype=float)
            votes = values[np.stack(leaves.to_numpy())[:, : len(starts)].astype(np.int64) + starts]
            return pd.DataFrame({"m": votes.mean(axis=1), "s": votes.std(axis=1)})

        own = n == self.model.getNumTrees
        model = self.model.copy().setLeafCol("_leaf").setPredictionCol("_own" if own else "")
        found = model.transform(rows).drop("_features")
        both = F.pandas_udf(spread, "m double, s double")(vector_to_array("_leaf"))
        names = [c for c in df.columns if c not in (yhat, sigma)]
        mean = ["_own"] if own else []
        found = found.select(*names, *mean, both.alias("_both"))
        return found.select(*names, F.col("_own" if own else "_both.m").alias(yhat), F.col("_both.s").alias(sigma))

    def nodes(self, spark: SparkSession) -> pd.DataFrame | None:
        """All nodes, tree after tree and in each tree its left part before its right one; None for a forest with too many leaves.

        Columns: treeID, id, value, left, right (ids, below 0 at a leaf), feature, threshold.
        """
        if not self._nodes:
            # A tree has one leaf more than it has splits.
            if (self.model.totalNumNodes + self.model.getNumTrees) // 2 > MAX_LEAVES:
                self._nodes.append(None)
            else:
                path = scratch_path(spark, "forest")
                self.model.write().save(path)
                rows = spark.read.parquet(f"{path}/data")
                split = F.col("nodeData.split")
                table = rows.select(
                    "treeID", "nodeData.id", F.col("nodeData.prediction").alias("value"), F.col("nodeData.leftChild").alias("left"),
                    F.col("nodeData.rightChild").alias("right"), split["featureIndex"].alias("feature"),
                    F.get(split["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
                )
                # Columns, whatever the session's settings: a Python object for every node holds up all other fits.
                self._nodes.append(table.toArrow().to_pandas().sort_values(["treeID", "id"], ignore_index=True))
        return self._nodes[0]

    def leaf_values(self, spark: SparkSession) -> list[np.ndarray] | None:
        """Per tree the values of its leaves from left to right; None for a forest with too many of them."""
        table = self.nodes(spark)
        if table is None:
            return None
        return [g["value"].to_numpy(float) for _, g in table[table["left"] < 0].groupby("treeID")]

    def _tree_by_tree(self, rows: DataFrame, n: int, yhat: str, sigma: str) -> DataFrame:
        votes = []
        for i, tree in enumerate(self.model.trees[:n]):
            votes.append(f"_tree_{i}")
            rows = tree.setPredictionCol(votes[-1]).transform(rows)
        rows = rows.withColumn("_votes", F.array(*votes)).drop("_features", *votes)
        rows = rows.withColumn(yhat, F.aggregate("_votes", F.lit(0.0), lambda a, t: a + t) / float(n))
        square = F.aggregate(
            "_votes", F.lit(0.0), lambda a, t: a + (t - F.col(yhat)) * (t - F.col(yhat))
        )
        return rows.withColumn(sigma, F.sqrt(square / float(n))).drop("_votes")

    def importance(self) -> DataFrame:
        """Features ranked by importance."""
        scores = self.model.featureImportances.toArray()
        ordered = sorted(zip(self.settings.features, scores), key=lambda p: (-p[1], p[0]))
        spark = SparkSession.getActiveSession()
        rows = [(name, float(s), i) for i, (name, s) in enumerate(ordered, 1)]
        return spark.createDataFrame(rows, "feature string, importance double, rank int")

    def tif_share(self) -> DataFrame:
        """Share of the total importance held by truth, indeterminacy and falsity; largest and smallest of them."""
        flag = F.col("feature").isin(*TIF_FEATURES)
        part = F.sum(F.when(flag, F.col("importance")).otherwise(0.0))
        return self.importance().agg(
            part.alias("tif_importance"),
            (part / F.nullif(F.sum("importance"), F.lit(0.0))).alias("tif_share"),
            F.max_by("feature", F.when(flag, F.col("importance"))).alias("strongest"),
            F.min_by("feature", F.when(flag, F.col("importance"))).alias("weakest"),
        )

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/forest")
        spark = SparkSession.getActiveSession()
        row = [(json.dumps({**asdict(self.settings), "features": list(self.settings.features)}),)]
        spark.createDataFrame(row, "settings string").write.mode("overwrite").json(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "UncertainForestModel":
        row = spark.read.schema("settings string").json(f"{path}/settings").first()
        settings = UncertainForest(**json.loads(row["settings"]))
        return UncertainForestModel(settings, RandomForestRegressionModel.load(f"{path}/forest"))


def _constant_sigma(train: DataFrame, scored: DataFrame) -> DataFrame:
    """A tenth of the spread of the training predictions on every row."""
    spread = train.agg((F.stddev_pop("yhat") * 0.1).alias("sigma"))
    return scored.join(F.broadcast(spread))  # one row


def boosted_trees(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    label: str = "target",
    rounds: int = 100,
    depth: int = 5,
    step: float = 0.1,
    seed: int = 42,
) -> DataFrame:
    """Gradient-boosted trees; they have no variance of their own."""
    booster = GBTRegressor(
        featuresCol="_features", labelCol=label, predictionCol="yhat", maxIter=rounds, maxDepth=depth,
        stepSize=step, seed=seed,
    )
    rows = assemble(train, features)
    with kept(rows.select("_features", label)) as held:
        fitted = booster.fit(_few_tasks(held, len(features)))
    return _constant_sigma(fitted.transform(rows), fitted.transform(assemble(test, features)).drop("_features"))


def linear_lags(
    train: DataFrame, test: DataFrame, features: Sequence[str], label: str = "target", z: float = 1.96
) -> DataFrame:
    """Least squares on lags with a residual-spread interval."""
    model = LinearRegression(featuresCol="_features", labelCol=label, predictionCol="yhat", solver="normal")
    rows = assemble(train, features)
    fitted = model.fit(rows)
    resid = fitted.transform(rows).agg(F.stddev_pop(F.col(label) - F.col("yhat")).alias("sigma"))
    scored = fitted.transform(assemble(test, features)).drop("_features").join(F.broadcast(resid))  # one row
    return scored.withColumns(
        {"lower": F.col("yhat") - z * F.col("sigma"), "upper": F.col("yhat") + z * F.col("sigma")}
    )


def vanilla_forest(
    train: DataFrame, test: DataFrame, features: Sequence[str], label: str = "target", trees: int = 100,
    depth: int = 20, seed: int = 42,
) -> DataFrame:
    """The plain forest on raw lags."""
    return UncertainForest(features, label, trees, depth, seed=seed).fit(train).transform(test)
