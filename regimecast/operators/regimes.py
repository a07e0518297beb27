"""Hard and soft regime assignment and the truth / indeterminacy / falsity of each row."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimecast.functions import vectors as vec

Centres = Sequence[Sequence[float]]


def assign_hard(df: DataFrame, x: str, centres: Centres, name: str = "k") -> DataFrame:
    return df.withColumn(name, vec.nearest(vec.distances(x, centres)))


def centre_distances(df: DataFrame, x: str, centres: Centres, name: str = "dist") -> DataFrame:
    return df.withColumn(name, F.array(*vec.distances(x, centres)))


def soft_columns(
    df: DataFrame, x: str, centres: Centres | str, k: int, width: int, fuzziness: float = 2.0, prefix: str = "_"
) -> tuple[DataFrame, list[str], list[str]]:
    """Distances and fuzzy memberships as scalar columns; returns the frame and their names.

    ``centres`` are numbers, or the name of a column that carries them with the rows. Each step is
    a projection of its own over plain doubles: one expression for all of it would compile into a
    method too large for the JVM to optimise.
    """
    d, near, u = ([f"{prefix}{c}{j}" for j in range(k)] for c in ("d", "n", "u"))
    total, hit = f"{prefix}t", f"{prefix}h"
    power = f"{-2.0 / (fuzziness - 1.0)!r}D"

    def step(frame: DataFrame, named: dict[str, str]) -> DataFrame:
        return frame.selectExpr("*", *[f"{e} AS {n}" for n, e in named.items()])

    df = step(df, dict(zip(d, vec.distance_exprs(x, centres, k, width))))
    # A row on a centre has an infinite closeness there, hence an infinite total.
    df = step(df, {n: f"power({c}, {power})" for n, c in zip(near, d)})
    on = " ".join(f"WHEN {c} = 0 THEN {j}" for j, c in enumerate(d))
    df = step(df, {total: " + ".join(near), hit: f"CASE {on} ELSE -1 END"})
    share = "CASE WHEN {hit} < 0 THEN {n} / {total} WHEN {hit} = {j} THEN 1D ELSE 0D END"
    df = step(df, {c: share.format(hit=hit, n=n, total=total, j=j) for j, (c, n) in enumerate(zip(u, near))})
    return df.drop(*near, total, hit), d, u


def assign_soft(
    df: DataFrame, x: str, centres: Centres, fuzziness: float = 2.0, name: str = "u"
) -> DataFrame:
    """Memberships as one array column; a row on a centre belongs to the first such centre."""
    soft, d, u = soft_columns(df, x, centres, len(centres), len(centres[0]), fuzziness, "_soft_")
    return soft.withColumn(name, F.array(*u)).drop(*d, *u)


def integrated_features(df: DataFrame, label: str, u: str, size: int, name: str = "features") -> DataFrame:
    """[one-hot label, memberships] as one array of twice the cluster count."""
    return df.withColumn(name, F.concat(F.array(*vec.one_hot(label, size)), u))


def input_checks(df: DataFrame, label: str, u: str, size: int, tol: float = 1e-6) -> DataFrame:
    """How many rows break a rule of the transform."""
    parts = vec.elements(u, size)
    outside = F.lit(False)
    for p in parts:
        outside = outside | (p < 0) | (p > 1)
    k = F.col(label)
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.size(u) != size).alias("wrong_length"),
        F.count_if(outside).alias("outside_unit"),
        F.count_if(F.abs(vec.fold(parts) - 1.0) > tol).alias("not_summing_to_one"),
        F.count_if(k.isNull() | (k < 0) | (k >= size)).alias("bad_label"),
    )


def tif(
    df: DataFrame, label: str, u: str, size: int, base: float = 2.0, epsilon: float = vec.EPSILON
) -> DataFrame:
    """Truth u[k], falsity 1 - T, indeterminacy H(u) / log C clipped to [0, 1].

    A label outside 0..C-1 raises when the row is computed.
    """
    k = F.col(label)
    bad = F.raise_error(F.concat(F.lit("cluster label out of range: "), k.cast("string")))
    checked = F.when((k >= 0) & (k < size), F.get(u, k)).otherwise(bad.cast("double"))
    h = vec.shannon(vec.elements(u, size), base, normalize=True, epsilon=epsilon)
    unit = F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))
    return df.withColumns({"truth": checked, "indeterminacy": unit}).withColumn(
        "falsity", F.lit(1.0) - F.col("truth")
    )


def range_check(df: DataFrame, tol: float = 0.0) -> DataFrame:
    """Components outside [0, 1] and rows whose truth and falsity do not sum to one."""
    aggs = [
        F.count_if((F.col(c) < -tol) | (F.col(c) > 1 + tol)).alias(f"{c}_outside")
        for c in ("truth", "indeterminacy", "falsity")
    ]
    pair = F.count_if(F.abs(F.col("truth") + F.col("falsity") - 1.0) > 1e-9).alias("unpaired")
    return df.agg(F.count(F.lit(1)).alias("total_rows"), *aggs, pair)


def enriched_columns(originals: Sequence[str], size: int) -> list[str]:
    """Names of the enriched features in order."""
    return [
        *originals,
        *[f"hard_{j}" for j in range(size)],
        *[f"soft_{j}" for j in range(size)],
        "truth",
        "indeterminacy",
        "falsity",
    ]


def enrich(df: DataFrame, originals: Sequence[str], label: str, u: str, size: int) -> DataFrame:
    """Named columns of [x, one-hot label, memberships, T, I, F]; ``df`` already holds T, I, F."""
    hard = {f"hard_{j}": c for j, c in enumerate(vec.one_hot(label, size))}
    soft = {f"soft_{j}": c for j, c in enumerate(vec.elements(u, size))}
    return df.withColumns({**hard, **soft})


def match_centres(hard: Centres, soft: Centres) -> list[int]:
    """For each hard centre the soft centre paired with it, total squared distance minimal.

    Works on the k x k table of centre distances only. Successive shortest augmenting paths.
    """
    a, b = np.asarray(hard, float), np.asarray(soft, float)
    cost = ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
    k = len(cost)
    row_of = np.full(k, -1)
    row_price, col_price = np.zeros(k), np.zeros(k)
    for start in range(k):
        best = np.full(k, np.inf)
        came = np.full(k, -1)
        done = np.zeros(k, bool)
        row, at = start, -1
        while True:
            reduced = cost[row] - row_price[row] - col_price
            offset = best[at] if at >= 0 else 0.0
            better = ~done & (reduced + offset < best)
            best[better] = reduced[better] + offset
            came[better] = at
            at = int(np.argmin(np.where(done, np.inf, best)))
            done[at] = True
            if row_of[at] < 0:
                break
            row = row_of[at]
        reach = best[at]
        row_price[start] += reach
        for j in np.flatnonzero(done):
            if j != at:
                row_price[row_of[j]] += reach - best[j]
                col_price[j] -= reach - best[j]
        while at >= 0:
            prev = came[at]
            row_of[at] = row_of[prev] if prev >= 0 else start
            at = prev
    out = [0] * k
    for col, row in enumerate(row_of):
        out[row] = col
    return out


def regime_summary(df: DataFrame, label: str = "k", high: float = 0.7) -> DataFrame:
    """Per regime: rows, mean truth and indeterminacy, share of ambiguous rows."""
    return df.groupBy(label).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.avg("truth").alias("mean_truth"),
        F.avg("indeterminacy").alias("mean_indeterminacy"),
        F.avg((F.col("indeterminacy") > high).cast("double")).alias("ambiguous_share"),
    )


