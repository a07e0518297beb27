"""Regime discovery: fuzzy C-means, K-Means and the two together, as ML estimators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimecast.functions import vectors as vec
from regimecast.operators import batched, regimes

Centres = Sequence[Sequence[float]]


class _ClusterParams(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "array<double> column", TypeConverters.toString)
    k = Param(Params._dummy(), "k", "number of clusters", TypeConverters.toInt)
    fuzziness = Param(Params._dummy(), "fuzziness", "fuzzy exponent, above 1", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "most iterations", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "change of all memberships to stop at", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)
    initCentres = Param(
        Params._dummy(), "initCentres", "given starting centres", TypeConverters.toListListFloat
    )
    nInit = Param(Params._dummy(), "nInit", "hard clusterings tried, the best one kept", TypeConverters.toInt)
    align = Param(Params._dummy(), "align", "pair soft centres with hard ones", TypeConverters.toBoolean)
    labelCol = Param(Params._dummy(), "labelCol", "hard label column", TypeConverters.toString)
    membershipCol = Param(Params._dummy(), "membershipCol", "membership column", TypeConverters.toString)

    def _get(self, name: str):
        return self.getOrDefault(getattr(self, name))


# --- fuzzy C-means ------------------------------------------------------------------------


def hashed_memberships(x: str, k: int, seed: int, keys: Sequence[str] = ()) -> list[Column]:
    """Random starting memberships from a hash of the row, the same under any partitioning."""
    source = [F.col(c) for c in keys] or [F.col(x)]
    unit = [
        (F.pmod(F.xxhash64(*source, F.lit(j), F.lit(seed)), F.lit(1 << 52)) + 1) / float(1 << 52)
        for j in range(k)
    ]
    total = vec.fold(unit)
    return [v / total for v in unit]


def _power(share: str, fuzziness: float) -> str:
    return f"{share} * {share}" if fuzziness == 2.0 else f"power({share}, {float(fuzziness)!r}D)"


def _centre_sums(x: str, u: Sequence[str], fuzziness: float, width: int) -> list[Column]:
    """Aggregates holding each cluster's weighted mean."""
    out = []
    for j, share in enumerate(u):
        weight = _power(share, fuzziness)
        if width <= vec.UNROLLED_WIDTH:
            means = [f"sum({weight} * get({x}, {d})) / nullif(sum({weight}), 0D)" for d in range(width)]
            out.append(F.expr(f"array({', '.join(means)})").alias(f"_c{j}"))
        else:
            mean = Summarizer.metrics("mean").summary(F.col("_vec"), F.expr(weight)).getField("mean")
            out.append(vector_to_array(mean).alias(f"_c{j}"))
    return out


def _objective(dist: Sequence[str], u: Sequence[str], fuzziness: float) -> Column:
    return F.expr("sum(" + " + ".join(f"{_power(s, fuzziness)} * {d} * {d}" for s, d in zip(u, dist)) + ")")


def fuzzy_objective(df: DataFrame, x: str, centres: Centres, fuzziness: float = 2.0) -> DataFrame:
    soft, d, u = regimes.soft_columns(df, x, centres, len(centres), len(centres[0]), fuzziness)
    return soft.agg(_objective(d, u, fuzziness).alias("objective"))


class FuzzyCMeans(Estimator, _ClusterParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fuzzy C-means. Every iteration is one pass over the features that carries no row-sized state."""

    @keyword_only
    def __init__(self, *, featuresCol="x", k=5, fuzziness=2.0, maxIter=100, tol=1e-4, seed=42,
                 initCentres=None, membershipCol="u"):
        super().__init__()
        self._setDefault(featuresCol="x", k=5, fuzziness=2.0, maxIter=100, tol=1e-4, seed=42, membershipCol="u")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        if self._get("fuzziness") <= 1.0:
            raise ValueError("fuzziness must be above 1")

    def _fit(self, df: DataFrame) -> "FuzzyCMeansModel":
        rows = batched.Rows(df, self._get("featuresCol"))
        start = self._get("initCentres") if self.isSet(self.initCentres) else None
        fit = soft_start(rows, self._get("k"), self._get("fuzziness"), self._get("seed"), start)
        batched.fit_soft_many(rows, [fit], self._get("maxIter"), self._get("tol"))
        return self._model(fit)

    def _model(self, fit: batched.SoftClustering) -> "FuzzyCMeansModel":
        return FuzzyCMeansModel(
            centres=fit.centres.tolist(),
            history=fit.history,
            iterations=fit.passes,
            featuresCol=self._get("featuresCol"),
            fuzziness=self._get("fuzziness"),
            membershipCol=self._get("membershipCol"),
        )


def soft_start(
    rows: batched.Rows, k: int, fuzziness: float, seed: int = 42, centres: Centres | None = None
) -> batched.SoftClustering:
    """A fuzzy fit at given centres, or at the means under random memberships; without weight a mean is the origin."""
    if centres is None:
        held = rows.frame if rows.width <= vec.UNROLLED_WIDTH else rows.frame.withColumn("_vec", array_to_vector("x"))
        names = [f"_u{j}" for j in range(k)]
        start = held.withColumns(dict(zip(names, hashed_memberships("x", k, seed))))
        row = start.agg(*_centre_sums("x", names, fuzziness, rows.width)).first()
        centres = [[v if v is not None else 0.0 for v in row[f"_c{j}"]] for j in range(k)]
    return batched.SoftClustering(np.asarray(centres, float), fuzziness=fuzziness)


class FuzzyCMeansModel(Model, _ClusterParams, DefaultParamsReadable, DefaultParamsWritable):
    centres = Param(Params._dummy(), "centres", "fitted centres", TypeConverters.toListListFloat)
    history = Param(Params._dummy(), "history", "objective per iteration", TypeConverters.toListFloat)
    iterations = Param(Params._dummy(), "iterations", "iterations used", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, centres=None, history=None, iterations=0, featuresCol="x", fuzziness=2.0,
                 membershipCol="u"):
        super().__init__()
        self._setDefault(featuresCol="x", fuzziness=2.0, membershipCol="u", history=[], iterations=0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        return regimes.assign_soft(
            df, self._get("featuresCol"), self._get("centres"), self._get("fuzziness"), self._get("membershipCol")
        )


# --- K-Means and both together --------------------------------------------------------------


def fit_hard(
    df: DataFrame | batched.Rows, x: str, k: int, seed: int = 42, n_init: int = 10, max_iter: int = 300, tol: float = 1e-4
) -> tuple[list[list[float]], float]:
    """Centres and inertia of the best of ``n_init`` K-Means fits, all fitted in the same passes."""
    rows = df if isinstance(df, batched.Rows) else batched.Rows(df, x)
    best = min(batched.fit_hard_many(rows, [k], n_init, seed, max_iter, tol)[k], key=lambda f: f.cost)
    return best.centres.tolist(), float(best.cost)


class DualClusterer(Estimator, _ClusterParams, DefaultParamsReadable, DefaultParamsWritable):
    """Hard labels by K-Means and soft memberships by fuzzy C-means over the same features.

    With ``align`` (default) each soft centre takes the number of the hard centre it is paired
    with; without it the two numberings stay independent.
    """

    @keyword_only
    def __init__(self, *, featuresCol="x", k=5, fuzziness=2.0, maxIter=100, tol=1e-4, seed=42, nInit=10,
                 align=True, labelCol="k", membershipCol="u"):
        super().__init__()
        self._setDefault(featuresCol="x", k=5, fuzziness=2.0, maxIter=100, tol=1e-4, seed=42, nInit=10,
                         align=True, labelCol="k", membershipCol="u")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "DualClustererModel":
        return fit_dual_many(df, [self])[0]

    def _model(self, hard: Centres, soft: batched.SoftClustering) -> "DualClustererModel":
        x, centres = self._get("featuresCol"), soft.centres.tolist()
        # K-Means may find fewer centres than asked for; then there is nothing to pair.
        if self._get("align") and len(hard) == len(centres):
            centres = [centres[j] for j in regimes.match_centres(hard, centres)]
        return DualClustererModel(
            hardCentres=hard, softCentres=centres, featuresCol=x, fuzziness=self._get("fuzziness"),
            labelCol=self._get("labelCol"), membershipCol=self._get("membershipCol"),
        )


def fit_dual_many(df: DataFrame, stages: Sequence[DualClusterer]) -> list["DualClustererModel"]:
    """The models of several stages over the same features; stages with equal limits share their passes."""
    out: list[DualClustererModel | None] = [None] * len(stages)
    alike: dict[tuple, list[int]] = {}
    for i, s in enumerate(stages):
        alike.setdefault(tuple(s._get(n) for n in ("featuresCol", "seed", "nInit", "tol", "maxIter")), []).append(i)
    for (x, seed, starts, tol, passes), mine in alike.items():
        rows = batched.Rows(df, x)
        hard = batched.fit_hard_many(rows, sorted({stages[i]._get("k") for i in mine}), starts, seed, tol=tol)
        soft = [soft_start(rows, stages[i]._get("k"), stages[i]._get("fuzziness"), seed) for i in mine]
        batched.fit_soft_many(rows, soft, passes, tol)
        for i, fit in zip(mine, soft):
            best = min(hard[stages[i]._get("k")], key=lambda f: f.cost)
            out[i] = stages[i]._model(best.centres.tolist(), fit)
    return out


class DualClustererModel(Model, _ClusterParams, DefaultParamsReadable, DefaultParamsWritable):
    hardCentres = Param(Params._dummy(), "hardCentres", "K-Means centres", TypeConverters.toListListFloat)
    softCentres = Param(Params._dummy(), "softCentres", "fuzzy centres", TypeConverters.toListListFloat)

    @keyword_only
    def __init__(self, *, hardCentres=None, softCentres=None, featuresCol="x", fuzziness=2.0, labelCol="k",
                 membershipCol="u"):
        super().__init__()
        self._setDefault(featuresCol="x", fuzziness=2.0, labelCol="k", membershipCol="u")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        x = self._get("featuresCol")
        hard = regimes.assign_hard(df, x, self._get("hardCentres"), self._get("labelCol"))
        return regimes.assign_soft(
            hard, x, self._get("softCentres"), self._get("fuzziness"), self._get("membershipCol")
        )


# --- information about a clustering -----------------------------------------------------------


def _per_cluster(wide: DataFrame, fields: Sequence[Sequence[Column]], name: str) -> DataFrame:
    rows = [F.struct(F.lit(j).alias(name), *cols) for j, cols in enumerate(fields)]
    return wide.select("*", F.explode(F.array(*rows)).alias("_r"))


def cluster_sizes(df: DataFrame, x: str, label: str, centres: Centres) -> DataFrame:
    """Size and inertia of every cluster, empty ones included, with the largest to smallest ratio."""
    k = len(centres)
    dist = regimes.centre_distances(df, x, centres, "_d")
    hit = [F.col(label) == j for j in range(k)]
    square = [F.get("_d", F.lit(j)) * F.get("_d", F.lit(j)) for j in range(k)]
    wide = dist.agg(
        F.array(*[F.count_if(h) for h in hit]).alias("_n"),
        F.array(*[F.coalesce(F.sum(F.when(h, s)), F.lit(0.0)) for h, s in zip(hit, square)]).alias("_s"),
    )
    fields = [[F.get("_n", F.lit(j)).alias("size"), F.get("_s", F.lit(j)).alias("inertia")] for j in range(k)]
    most, least = F.array_max("_n"), F.array_min("_n")
    return _per_cluster(wide, fields, label).select(
        f"_r.{label}",
        "_r.size",
        "_r.inertia",
        (F.col("_r.size") == most).alias("is_largest"),
        (F.col("_r.size") == least).alias("is_smallest"),
        (most / F.nullif(least, F.lit(0))).alias("size_ratio"),
    )


def fuzzy_info(df: DataFrame, u: str, size: int) -> DataFrame:
    """Per cluster: rows it wins and mean membership; the partition coefficient repeats on each row."""
    won = df.withColumn("_w", vec.first_max(u))
    parts = vec.elements(u, size)
    wide = won.agg(
        F.array(*[F.count_if(F.col("_w") == j) for j in range(size)]).alias("_n"),
        F.array(*[F.avg(p) for p in parts]).alias("_m"),
        F.avg(vec.fold(parts, lambda p: p * p)).alias("partition_coefficient"),
    )
    fields = [
        [F.get("_n", F.lit(j)).alias("size"), F.get("_m", F.lit(j)).alias("mean_membership")] for j in range(size)
    ]
    return _per_cluster(wide, fields, "j").select("_r.*", "partition_coefficient")


def agreement(df: DataFrame, label: str, u: str, hard: Centres, soft: Centres) -> DataFrame:
    gaps = np.linalg.norm(np.asarray(hard, float) - np.asarray(soft, float), axis=1)
    return df.agg(
        F.avg((F.col(label) == vec.first_max(u)).cast("double")).alias("exact_agreement"),
        F.avg(F.get(u, F.col(label))).alias("mean_strength"),
        F.lit(float(gaps.mean())).alias("mean_centre_distance"),
        F.lit(float(gaps.max())).alias("max_centre_distance"),
        F.lit(float(gaps.min())).alias("min_centre_distance"),
    )


def quality_flags(df: DataFrame, label: str, u: str, size: int) -> DataFrame:
    """Balance of the hard clusters present, agreement of both views, fuzziness; with flags."""
    counts = [F.nullif(F.count_if(F.col(label) == j), F.lit(0)) for j in range(size)]
    # array_min and array_max skip the nulls of clusters without rows.
    out = df.agg(
        (F.array_min(F.array(*counts)) / F.array_max(F.array(*counts))).alias("balance_ratio"),
        F.avg((F.col(label) == vec.first_max(u)).cast("double")).alias("exact_agreement"),
        F.avg(vec.fold(vec.elements(u, size), lambda p: p * p)).alias("partition_coefficient"),
    )
    out = out.withColumns(
        {
            "imbalanced": F.col("balance_ratio") < 0.1,
            "low_agreement": F.col("exact_agreement") < 0.5,
            "very_fuzzy": F.col("partition_coefficient") < 0.7,
        }
    )
    flagged = F.col("imbalanced") | F.col("low_agreement") | F.col("very_fuzzy")
    return out.withColumn("is_valid", ~flagged)
