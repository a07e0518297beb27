"""Prediction intervals and their calibration."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimecast.functions.tails import normal_quantile
from regimecast.operators import batched
from regimecast.operators.metrics import covered
from regimecast.operators.ordering import Keys, grouped, join_params

# Fixed default: the 95 % factor used when neither a factor nor a level is given.
GAMMA = 1.96
GRID = tuple(0.5 + i * (2.5 / 19) for i in range(20))


def _around(df: DataFrame, half: Column) -> DataFrame:
    return df.withColumns({"lower": F.col("yhat") - half, "upper": F.col("yhat") + half})


def constant_uncertainty(df: DataFrame, keys: Keys, share: float = 0.1, name: str = "sigma") -> DataFrame:
    """A tenth of the spread of the predictions, for models without a variance of their own."""
    spread = df.groupBy(*keys).agg((F.stddev_pop("yhat") * share).alias(name))
    return join_params(df, spread, keys)


def normal_interval(df: DataFrame, level: float = 0.95, sigma: str = "sigma") -> DataFrame:
    return _around(df, F.lit(normal_quantile(level)) * F.col(sigma))


def enhanced(
    df: DataFrame,
    gamma: float | None = None,
    beta: float = 1.0,
    level: float | None = None,
    sigma: str = "sigma",
    indeterminacy: str = "indeterminacy",
) -> DataFrame:
    """Model spread and regime ambiguity add up: gamma * sigma + beta * I."""
    if gamma is None:
        gamma = GAMMA if level is None else normal_quantile(level)
    return _around(df, F.lit(gamma) * F.col(sigma) + F.lit(beta) * F.col(indeterminacy))


def fit_residual_spread(df: DataFrame, keys: Keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.stddev_pop(F.col("y") - F.col("yhat")).alias("residual_std"))


def heuristic(
    df: DataFrame,
    keys: Keys = (),
    params: DataFrame | None = None,
    gamma: float = GAMMA,
    beta: float = 1.0,
    sigma: str | None = None,
) -> DataFrame:
    """gamma * beta times the row's own uncertainty, else the fitted residual spread."""
    if sigma is not None:
        return _around(df, F.lit(gamma * beta) * F.col(sigma))
    if params is None:
        raise ValueError("give an uncertainty column or fitted residual spreads")
    rows = join_params(df, params, keys)
    return _around(rows, F.lit(gamma * beta) * F.col("residual_std")).drop("residual_std")


def adaptive(
    df: DataFrame,
    keys: Keys,
    params: DataFrame | None = None,
    gamma: float = GAMMA,
    beta: float = 1.0,
    indeterminacy: str = "indeterminacy",
) -> DataFrame:
    """The base width grows with the indeterminacy of the row."""
    if params is None:
        rows = constant_uncertainty(df, keys, name="residual_std")
    else:
        rows = join_params(df, params, keys)
    half = F.lit(gamma) * F.col("residual_std") * (1 + F.lit(beta) * F.col(indeterminacy))
    return _around(rows, half).drop("residual_std")


def fit_residual_quantiles(df: DataFrame, groups: Keys, level: float = 0.95) -> DataFrame:
    rows = df.withColumn("_e", F.col("y") - F.col("yhat"))
    alpha = 1 - level
    return grouped(rows, groups, {}, {"_lo": ("_e", alpha / 2), "_hi": ("_e", 1 - alpha / 2)})


def residual_quantile(df: DataFrame, groups: Keys, params: DataFrame) -> DataFrame:
    """Empirical residual quantiles of the row's group, for example its regime."""
    rows = join_params(df, params, groups)
    return rows.withColumns(
        {"lower": F.col("yhat") + F.col("_lo"), "upper": F.col("yhat") + F.col("_hi")}
    ).drop("_lo", "_hi")


_LEAST = 1e-6  # smoothing of the pinball loss at the end, as a share of the residuals' mean size


def linear_quantiles(
    df: DataFrame, features: Sequence[str], level: float = 0.95, max_passes: int = 300, tol: float = 1e-7
) -> list[list[float]]:
    """Coefficients (constant first) of the linear lower and upper residual quantiles, without a penalty.

    Both are fitted in the same passes. A pass replaces the pinball loss by a parabola that touches it from
    above at the last fit; its minimum solves weighted normal equations, whose sums Spark adds up, so
    the loss never rises. The loss is smoothed near zero, less with every pass. Ends when a pass at the least
    smoothing lowers no loss by more than the share ``tol``; raises if ``max_passes`` do not suffice. Rows with
    a null feature or residual are left out. Features should not be collinear: the shortest solution is taken.
    """
    e = (F.col("y") - F.col("yhat")).cast("double")
    cells = [F.lit(1.0), *[F.col(c).cast("double") for c in features], e]
    whole = df.select(F.when(~F.exists(F.array(*cells), lambda c: c.isNull()), F.array(*cells)).alias("x"))
    rows = batched.Rows(whole, "x")
    p = len(features) + 1
    if rows.count < p:
        raise ValueError(f"{rows.count} rows are too few for {p} coefficients")
    taus = np.array([(1 - level) / 2, 1 - (1 - level) / 2])

    def start(values: np.ndarray, totals: dict) -> None:
        row = np.concatenate([values[:, :p].sum(axis=0), [np.abs(values[:, p]).sum()], (values[:, :p] ** 2).sum(axis=0)])
        totals[0] = totals[0] + row if 0 in totals else row

    found = rows.summed(start, 2 * p + 1)
    sums = np.array([found[0, j] for j in range(p)])
    scale = found[0, p] / rows.count or 1.0
    width = np.sqrt(np.array([found[0, p + 1 + j] for j in range(p)]) / rows.count)
    width[width == 0] = 1.0
    fits, smooth, losses = np.zeros((2, p)), 0.1 * scale, np.full(2, np.inf)
    for _ in range(max_passes):
        now, soft = fits.copy(), smooth

        def weigh(values: np.ndarray, totals: dict) -> None:
            x, y = values[:, :p] / width, values[:, p]
            for i in range(2):
                r = y - x @ now[i]
                w = 1.0 / (soft + np.abs(r))
                loss = np.maximum(taus[i] * r, (taus[i] - 1) * r).sum()
                row = np.concatenate([(x.T @ (x * w[:, None])).ravel(), x.T @ (w * y), [loss]])
                totals[i] = totals[i] + row if i in totals else row

        found = rows.summed(weigh, 2 * (p * p + p + 1))
        for i, tau in enumerate(taus):
            flat = np.array([found[i, j] for j in range(p * p + p + 1)])
            right = flat[p * p : p * p + p] + (2 * tau - 1) * sums / width
            fits[i] = np.linalg.lstsq(flat[: p * p].reshape(p, p), right, rcond=1e-13)[0]
        before, losses = losses, np.array([found[i, p * p + p] for i in range(2)])
        if soft <= _LEAST * scale and (losses >= before * (1 - tol)).all():
            return (now / width).tolist()
        smooth = max(0.8 * smooth, _LEAST * scale)
    raise ValueError(f"linear quantiles have not settled after {max_passes} passes")


def linear_quantile(df: DataFrame, features: Sequence[str], coefficients: Sequence[Sequence[float]]) -> DataFrame:
    """Bounds yhat + the linear residual quantiles of the row."""

    def value(c: Sequence[float]) -> Column:
        return sum((F.lit(float(b)) * F.col(n) for b, n in zip(c[1:], features)), F.lit(float(c[0])))

    low, high = (F.col("yhat") + value(c) for c in coefficients)
    return df.withColumns({"lower": low, "upper": high})


def bootstrap(
    df: DataFrame,
    keys: Keys,
    row_key: Sequence[str],
    params: DataFrame,
    level: float = 0.95,
    copies: int = 100,
    seed: int = 42,
) -> DataFrame:
    """Percentiles of noisy copies of each prediction.

    The copies live in an array inside the row, so nothing is exploded or shuffled; their noise
    comes from a hash of the row key and is the same under any partitioning.
    """
    rows = join_params(df, params, keys)
    big = float(1 << 52)

    def unit(i: Column, salt: int) -> Column:
        h = F.xxhash64(*[F.col(c) for c in row_key], i, F.lit(seed + salt))
        return (F.pmod(h, F.lit(1 << 52)) + 1) / big

    noise = F.transform(
        F.sequence(F.lit(1), F.lit(copies)),
        lambda i: F.sqrt(-2.0 * F.log(unit(i, 0))) * F.cos(2.0 * F.pi() * unit(i, 1)),
    )
    sorted_noise = rows.withColumn("_z", F.sort_array(noise))
    alpha = 1 - level

    def pick(p: float) -> Column:
        at = p * (copies - 1)
        low, share = int(at), at - int(at)
        a, b = F.get("_z", F.lit(low)), F.get("_z", F.lit(min(low + 1, copies - 1)))
        return F.col("yhat") + F.col("residual_std") * (a + (b - a) * share)

    return sorted_noise.withColumns({"lower": pick(alpha / 2), "upper": pick(1 - alpha / 2)}).drop(
        "_z", "residual_std"
    )


def calibrate_gamma(
    df: DataFrame, keys: Keys, target: float = 0.95, beta: float = 1.0, sigma: str = "sigma"
) -> DataFrame:
    """The grid factor whose coverage is closest to the target; the smaller one on a tie.

    All factors are measured in one pass.
    """
    rows = df.withColumns(
        {"_gap": F.abs(F.col("y") - F.col("yhat")), "_half": F.lit(beta) * F.col(sigma)}
    )
    inside = [F.count_if(F.col("_gap") <= F.lit(g) * F.col("_half")) for g in GRID]
    counts = rows.groupBy(*keys).agg(F.count("_gap").alias("_n"), F.array(*inside).alias("_in"))
    wide = counts.select(*keys, F.transform("_in", lambda c: c / F.col("_n")).alias("_cover"))
    tried = F.array(
        *[
            F.struct(F.abs(F.get("_cover", F.lit(i)) - target).alias("error"), F.lit(g).alias("gamma"))
            for i, g in enumerate(GRID)
        ]
    )
    best = wide.select(*keys, F.array_min(tried).alias("_b"))
    return best.select(
        *keys,
        F.col("_b.gamma").alias("gamma"),
        F.lit(target).alias("target_coverage"),
        F.col("_b.error").alias("coverage_error"),
    )


def quality(df: DataFrame, keys: Keys, level: float = 0.95) -> DataFrame:
    width = F.avg(F.col("upper") - F.col("lower"))
    span = F.max("y") - F.min("y")
    normal = F.when(span > 0, width / span).otherwise(0.0)
    out = df.groupBy(*keys).agg(
        F.avg(covered()).alias("coverage"), width.alias("average_width"), normal.alias("normalized_width")
    )
    cwc = F.col("normalized_width") * (1 + 0.1 * F.exp(-0.1 * (F.col("coverage") - level)))
    return out.withColumn("cwc", cwc).withColumn("target_coverage", F.lit(level))


def multi_level(
    df: DataFrame, levels: Sequence[float] = (0.8, 0.9, 0.95), beta: float = 0.0, sigma: str = "sigma"
) -> DataFrame:
    """Every row once per nominal level, with that level's bounds."""
    table = F.array(
        *[F.struct(F.lit(v).alias("level"), F.lit(normal_quantile(v)).alias("z")) for v in levels]
    )
    rows = df.withColumn("_l", F.explode(table))
    half = F.col("_l.z") * F.col(sigma)
    if beta:
        half = half + F.lit(beta) * F.col("indeterminacy")
    return _around(rows, half).withColumn("level", F.col("_l.level")).drop("_l")
