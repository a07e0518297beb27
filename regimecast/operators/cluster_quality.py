"""Validity indices of a labelling and comparison of two labellings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regimecast.operators import batched, clustering, regimes
from regimecast.operators.ordering import join_params, running_sums


@dataclass(frozen=True)
class ClusterStats:
    """One entry per cluster: label, size, mean vector, sum of squares around it."""

    labels: list[int]
    sizes: np.ndarray
    means: np.ndarray
    within: np.ndarray


def cluster_stats(df: DataFrame, x: str, label: str) -> ClusterStats:
    vec = array_to_vector(x)
    stats = Summarizer.metrics("count", "mean", "variance").summary(vec)
    rows = (
        df.groupBy(label)
        .agg(stats.alias("s"))
        .select(label, "s.count", vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("var"))
        .orderBy(label)
        .collect()
    )
    sizes = np.array([r["count"] for r in rows], float)
    spread = np.array([sum(r["var"]) for r in rows])
    return ClusterStats(
        [r[label] for r in rows], sizes, np.array([r["mean"] for r in rows]), spread * np.maximum(sizes - 1, 0)
    )


def _one_row(df: DataFrame, name: str, value: float) -> DataFrame:
    return df.sparkSession.createDataFrame([(float(value),)], f"{name} double")


def silhouette(df: DataFrame, x: str, label: str) -> DataFrame:
    """Mean silhouette under squared Euclidean distance, one pass over the rows."""
    scored = df.select(array_to_vector(x).alias("_vec"), F.col(label).cast("double").alias("_label"))
    score = ClusteringEvaluator(
        predictionCol="_label", featuresCol="_vec", metricName="silhouette", distanceMeasure="squaredEuclidean"
    ).evaluate(scored)
    return _one_row(df, "silhouette", score)


def silhouette_univariate(df: DataFrame, value: str, label: str, size: int) -> DataFrame:
    """Mean silhouette of single values under plain distance, exact.

    Sorted by value, the distances of a row to a whole cluster follow from how many members lie
    below it and what they sum to, so one sort replaces all pairs.
    """
    hit = [F.col(label) == j for j in range(size)]
    v = F.col(value)
    below = running_sums(
        df.select(value, label),
        [],
        [v],
        {
            **{f"_n{j}": F.when(h, 1).otherwise(0) for j, h in enumerate(hit)},
            **{f"_s{j}": F.when(h, v).otherwise(0.0) for j, h in enumerate(hit)},
        },
    )
    totals = df.agg(
        *[F.count_if(h).alias(f"_tn{j}") for j, h in enumerate(hit)],
        *[F.sum(F.when(h, v).otherwise(0.0)).alias(f"_ts{j}") for j, h in enumerate(hit)],
    )
    rows = join_params(below, totals, [])

    def reach(j: int) -> Column:
        n, s, tn, ts = (F.col(f"{c}{j}") for c in ("_n", "_s", "_tn", "_ts"))
        return v * n - s + (ts - s) - v * (tn - n)

    own_sum = F.element_at(F.array(*[reach(j) for j in range(size)]), F.col(label) + 1)
    own_n = F.element_at(F.array(*[F.col(f"_tn{j}") for j in range(size)]), F.col(label) + 1)
    others = F.array_min(
        F.array(
            *[
                F.when(F.col(label) != j, reach(j) / F.nullif(F.col(f"_tn{j}"), F.lit(0)))
                for j in range(size)
            ]
        )
    )
    staged = rows.select(own_sum.alias("_own"), own_n.alias("_cnt"), others.alias("_b"))
    a = F.col("_own") / F.nullif(F.col("_cnt") - 1, F.lit(0))
    top = F.greatest(a, F.col("_b"))
    score = F.when((F.col("_cnt") > 1) & (top > 0), (F.col("_b") - a) / top).otherwise(F.lit(0.0))
    return staged.agg(F.avg(score).alias("silhouette"))


def calinski_harabasz(df: DataFrame, x: str, label: str) -> DataFrame:
    s = cluster_stats(df, x, label)
    n, k = s.sizes.sum(), len(s.sizes)
    centre = (s.sizes[:, None] * s.means).sum(axis=0) / n
    between = (s.sizes * ((s.means - centre) ** 2).sum(axis=1)).sum()
    within = s.within.sum()
    score = 1.0 if within == 0 else between * (n - k) / (within * (k - 1))
    return _one_row(df, "calinski_harabasz", score)


def davies_bouldin(df: DataFrame, x: str, label: str) -> DataFrame:
    s = cluster_stats(df, x, label)
    at = F.lit(len(s.labels))
    for j, name in reversed(list(enumerate(s.labels))):
        at = F.when(F.col(label) == name, F.lit(j)).otherwise(at)
    dist = regimes.centre_distances(df.withColumn("_j", at), x, s.means.tolist(), "_d")
    rows = dist.groupBy("_j").agg(F.avg(F.get("_d", F.col("_j"))).alias("spread")).collect()
    spread = np.zeros(len(s.labels))
    for r in rows:
        spread[r["_j"]] = r["spread"]
    apart = np.linalg.norm(s.means[:, None, :] - s.means[None, :, :], axis=2)
    np.fill_diagonal(apart, np.inf)
    apart[apart == 0] = np.inf
    return _one_row(df, "davies_bouldin", ((spread[:, None] + spread[None, :]) / apart).max(axis=1).mean())


def inertia(df: DataFrame, x: str, label: str) -> DataFrame:
    return _one_row(df, "inertia", cluster_stats(df, x, label).within.sum())


def balance(df: DataFrame, label: str) -> DataFrame:
    """1 / (1 + coefficient of variation of the cluster sizes)."""
    sizes = df.groupBy(label).count()
    return sizes.agg((1.0 / (1.0 + F.stddev_pop("count") / F.avg("count"))).alias("balance"))


def validate(df: DataFrame, x: str, label: str) -> DataFrame:
    """All indices in one row."""
    s = cluster_stats(df, x, label)
    if len(s.labels) < 2:
        return df.sparkSession.createDataFrame([(len(s.labels), False)], "n_clusters int, valid boolean")
    parts = [silhouette(df, x, label), calinski_harabasz(df, x, label), davies_bouldin(df, x, label)]
    values = [float(p.first()[0]) for p in parts]
    cv = s.sizes.std() / s.sizes.mean()
    row = (len(s.labels), True, *values, float(s.within.sum()), float(1 / (1 + cv)))
    return df.sparkSession.createDataFrame(
        [row],
        "n_clusters int, valid boolean, silhouette double, calinski_harabasz double, davies_bouldin double, "
        "inertia double, balance double",
    )


def elbow(scores: list[float]) -> int:
    """Position of the sharpest bend: the largest absolute second difference."""
    if len(scores) < 3:
        return 0
    bend = np.abs(np.diff(np.asarray(scores, float), n=2))
    return int(np.argmax(bend)) + 1


RECOMMENDED = "k int, silhouette double, inertia double, recommended boolean"


def recommend_k(
    df: DataFrame, x: str, k_max: int = 10, method: str = "silhouette", seed: int = 42, n_init: int = 10
) -> DataFrame:
    """Silhouette and inertia for k = 2..K and which k is recommended.

    The fits of all k and all starts share their passes, and so do all silhouettes. With fewer than
    three rows nothing is recommended.
    """
    if method not in ("silhouette", "elbow"):
        raise ValueError(f"unknown method {method!r}; known: ['elbow', 'silhouette']")
    rows = batched.Rows(df, x)
    ks = range(2, min(k_max, rows.count - 1) + 1)
    if not ks:
        return df.sparkSession.createDataFrame([], RECOMMENDED)
    best = [min(fits, key=lambda f: f.cost) for fits in batched.fit_hard_many(rows, ks, n_init, seed).values()]
    found = list(zip(ks, batched.silhouettes(rows, best), [f.cost for f in best]))
    if method == "silhouette":
        pick = max(range(len(found)), key=lambda i: found[i][1])
    else:
        pick = elbow([-cost for _, _, cost in found])
    return df.sparkSession.createDataFrame(
        [(k, float(s), float(c), i == pick) for i, (k, s, c) in enumerate(found)],
        RECOMMENDED,
    )


def compare_labels(df: DataFrame, first: str, second: str) -> DataFrame:
    """Adjusted Rand index and normalised mutual information from the table of label pairs."""
    pairs = df.groupBy(first, second).agg(F.count(F.lit(1)).cast("double").alias("n"))
    cells = pairs.withColumns(
        {
            "a": F.sum("n").over(Window.partitionBy(first)),
            "b": F.sum("n").over(Window.partitionBy(second)),
        }
    )
    n, a, b = F.col("n"), F.col("a"), F.col("b")

    def choose(c: Column) -> Column:
        return c * (c - 1) / 2

    # A row total repeats in each of its cells, so it counts there in proportion n / total.
    sums = cells.agg(
        F.sum("n").alias("N"),
        F.sum(choose(n)).alias("both"),
        F.sum(choose(a) * n / a).alias("rows"),
        F.sum(choose(b) * n / b).alias("cols"),
        F.sum(n * F.log(n / (a * b))).alias("joint"),
        F.sum(n * F.log(a)).alias("ra"),
        F.sum(n * F.log(b)).alias("rb"),
    )
    total = F.col("N")
    expected = F.col("rows") * F.col("cols") / choose(total)
    most = (F.col("rows") + F.col("cols")) / 2
    mutual = F.col("joint") / total + F.log(total)
    entropies = [F.log(total) - F.col(c) / total for c in ("ra", "rb")]
    mean_entropy = (entropies[0] + entropies[1]) / 2
    return sums.select(
        F.when(most == expected, F.lit(1.0))
        .otherwise((F.col("both") - expected) / (most - expected))
        .alias("adjusted_rand"),
        F.when(mean_entropy <= 0, F.lit(1.0)).otherwise(mutual / mean_entropy).alias("normalized_mutual_info"),
    )


def compare_clusterings(df: DataFrame, x: str, first: str, second: str) -> DataFrame:
    """The two agreement indices with the silhouette of each labelling and which one is better."""
    scores = [float(silhouette(df, x, c).first()[0]) for c in (first, second)]
    return compare_labels(df, first, second).withColumns(
        {
            "silhouette_1": F.lit(scores[0]),
            "silhouette_2": F.lit(scores[1]),
            "better": F.lit(1 if scores[0] > scores[1] else 2),
        }
    )


def fitted_hard(df: DataFrame, x: str, k: int, seed: int = 42, n_init: int = 10) -> DataFrame:
    """Fitted K-Means centres as rows (cluster, dim, value, inertia)."""
    centres, cost = clustering.fit_hard(df, x, k, seed, n_init)
    return centre_table(df, centres).withColumn("inertia", F.lit(float(cost)))


def centre_table(df: DataFrame, centres: list[list[float]]) -> DataFrame:
    rows = [(j, d, float(v)) for j, c in enumerate(centres) for d, v in enumerate(c)]
    return df.sparkSession.createDataFrame(rows, "cluster int, dim int, value double")
