"""Point, interval and calibration measures over (y, yhat, lower, upper) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimecast.functions.tails import chi2_p_value
from regimecast.operators import features, summary
from regimecast.operators.ordering import Keys, grouped, join_params, over_series

INF = float("inf")
# Fixed weights of the two coverage-width criteria.
CWC_LINEAR, CWC_EXPONENTIAL = 50.0, 0.1
ERROR_QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def _c(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def point_metrics() -> dict[str, Column]:
    """Aggregates of the eight point measures, with the zero and constant rules."""
    y, yhat = _c("y", "yhat")
    e = y - yhat
    rmse = F.sqrt(F.avg(e * e))
    span = F.max("y") - F.min("y")
    size = (F.abs(y) + F.abs(yhat)) / 2
    flat = F.max("y") == F.min("y")
    ss_res = F.sum(e * e)
    return {
        "rmse": rmse,
        "mae": F.avg(F.abs(e)),
        "mape": F.coalesce(F.avg(F.when(y != 0, F.abs(e / y))) * 100, F.lit(INF)),
        "smape": F.coalesce(F.avg(F.when(size != 0, F.abs(e) / size)) * 100, F.lit(0.0)),
        "r2": F.when(flat, F.when(ss_res == 0, 1.0).otherwise(0.0)).otherwise(
            1 - ss_res / (F.count(e) * F.var_pop("y"))
        ),
        "mbe": F.avg(-e),
        "nrmse": F.when(span == 0, F.when(rmse == 0, 0.0).otherwise(INF)).otherwise(rmse / span),
        "cv_rmse": F.when(F.avg("y") == 0, F.when(rmse > 0, INF).otherwise(0.0)).otherwise(
            rmse / F.avg("y") * 100
        ),
    }


def covered() -> Column:
    y, lower, upper = _c("y", "lower", "upper")
    return ((y >= lower) & (y <= upper)).cast("double")


def interval_score(level: float, variant: str = "light") -> Column:
    """Width plus penalties outside. ``light`` weighs a miss by 2 * alpha, ``standard`` by 2 / alpha."""
    alpha = 1 - level
    weights = {"light": 2 * alpha, "standard": 2 / alpha}
    y, lower, upper = _c("y", "lower", "upper")
    miss = F.greatest(lower - y, F.lit(0.0)) + F.greatest(y - upper, F.lit(0.0))
    return F.avg((upper - lower) + weights[variant] * miss)


def interval_metrics(level: float = 0.95, cwc: str = "linear", score: str = "light") -> dict[str, Column]:
    y_span = F.max("y") - F.min("y")
    width = F.col("upper") - F.col("lower")
    picp = F.avg(covered())
    no_width = (F.max(width) == 0) & (F.min(width) == 0)
    pinaw = F.when(y_span == 0, F.when(no_width, 0.0).otherwise(INF)).otherwise(F.avg(width) / y_span)
    rules = {
        "linear": pinaw + CWC_LINEAR * F.greatest(level - picp, F.lit(0.0)),
        "exponential": pinaw * (1 + CWC_EXPONENTIAL * F.exp(-CWC_EXPONENTIAL * (picp - level))),
    }
    return {
        "picp": picp,
        "pinaw": pinaw,
        "cwc": rules[cwc],
        "ace": F.abs(picp - level),
        "interval_score": interval_score(level, score),
    }


def point(df: DataFrame, keys: Keys) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in point_metrics().items()])


def interval(df: DataFrame, keys: Keys, level: float = 0.95, **variants: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in interval_metrics(level, **variants).items()])


def directional_accuracy(df: DataFrame, keys: Keys, order: Sequence[str]) -> DataFrame:
    """Share of steps whose direction the forecast shares; null for a single row."""
    moved = over_series(
        df,
        keys,
        _c(*order),
        lambda w: {
            "_dy": F.col("y") - F.lag("y").over(w),
            "_dp": F.col("yhat") - F.lag("yhat").over(w),
        },
        back=1,
    )
    hit = (F.col("_dy") > 0) == (F.col("_dp") > 0)
    return moved.groupBy(*keys).agg(F.avg(hit.cast("double")).alias("directional_accuracy"))


def quantile_names() -> dict[str, tuple[str, float]]:
    return {f"error_q{round(p * 100)}": ("_abs", p) for p in ERROR_QUANTILES}


def with_abs_error(df: DataFrame) -> DataFrame:
    return df.withColumn("_abs", F.abs(F.col("y") - F.col("yhat")))


def error_quantiles(df: DataFrame, keys: Keys) -> DataFrame:
    return grouped(with_abs_error(df), keys, {}, quantile_names())


def seasonal(df: DataFrame, keys: Keys, order: Sequence[str], season: str | None = None) -> DataFrame:
    """Point measures per season; by default four contiguous blocks of the series."""
    if season is None:
        placed = features.with_position(df, keys, order)
        block = F.floor(F.col("_i") / (F.floor(F.col("_n") / 4) + 1)).cast("int")
        df, season = placed.withColumn("season", block), "season"
    return point(df, [*keys, season])


def summary_metrics() -> dict[str, Column]:
    return {
        "n_samples": F.count(F.lit(1)).cast("double"),
        "y_mean": F.avg("y"),
        "y_std": F.stddev_pop("y"),
        "yhat_mean": F.avg("yhat"),
        "yhat_std": F.stddev_pop("yhat"),
        "correlation": F.corr("y", "yhat"),
    }


def comprehensive(
    df: DataFrame, keys: Keys, order: Sequence[str], level: float = 0.95, intervals: bool = True
) -> DataFrame:
    """Every measure of each group, wide: one pass for the aggregates, one for the directions."""
    aggs = {**point_metrics(), **summary_metrics()}
    if intervals:
        aggs.update(interval_metrics(level))
    wide = grouped(with_abs_error(df), keys, aggs, quantile_names())
    return join_params(wide, directional_accuracy(df, keys, order), keys)


def tidy(wide: DataFrame, keys: Keys) -> DataFrame:
    """One row per group and measure."""
    names = [c for c in wide.columns if c not in keys]
    return summary.melt(wide, keys, names, "metric", "value")


# --- interval evaluation --------------------------------------------------------------------


def coverage_bands(df: DataFrame, keys: Keys, bands: int = 5) -> DataFrame:
    """Coverage inside quantile bands of the target (edges belong to both), and misses by side."""
    edges = grouped(df, keys, {}, {f"_e{b}": ("y", b / bands) for b in range(bands + 1)})
    y = F.col("y")
    rows = join_params(df, edges, keys)
    inside = [
        F.avg(F.when(y.between(F.col(f"_e{b}"), F.col(f"_e{b + 1}")), covered())).alias(f"band_{b + 1}")
        for b in range(bands)
    ]
    return rows.groupBy(*keys).agg(
        F.avg((y < F.col("lower")).cast("double")).alias("under_coverage"),
        F.avg((y > F.col("upper")).cast("double")).alias("over_coverage"),
        *inside,
    )


def width_stats(df: DataFrame, keys: Keys) -> DataFrame:
    rows = df.withColumn("_w", F.col("upper") - F.col("lower"))
    w, span = F.avg("_w"), F.max("y") - F.min("y")
    aggs = {
        "mean_width": w,
        "std_width": F.stddev_pop("_w"),
        "min_width": F.min("_w"),
        "max_width": F.max("_w"),
        "relative_width": w / F.nullif(span, F.lit(0.0)),
        "width_cv": F.when(w > 0, F.stddev_pop("_w") / w).otherwise(0.0),
    }
    return grouped(rows, keys, aggs, {"median_width": ("_w", 0.5)})


def calibration(
    df: DataFrame, keys: Keys, tie_break: Sequence[str], level: float = 0.95, bins: int = 10
) -> DataFrame:
    """Coverage in bins of equal count by width, and the mean squared gap to the level."""
    rows = df.withColumn("_w", F.col("upper") - F.col("lower"))
    binned = features.equal_count_bins(rows, keys, ["_w", *tie_break], bins)
    cover = [F.avg(F.when(F.col("bin") == b, covered())).alias(f"coverage_bin_{b + 1}") for b in range(bins)]
    out = binned.groupBy(*keys).agg(*cover)
    gaps = F.array_compact(
        F.array(*[F.pow(F.col(f"coverage_bin_{b + 1}") - level, F.lit(2.0)) for b in range(bins)])
    )
    total = F.aggregate(gaps, F.lit(0.0), lambda a, v: a + v)
    return out.withColumn("reliability", total / F.size(gaps))


def compare_interval_methods(df: DataFrame, keys: Keys, method: str, level: float = 0.95) -> DataFrame:
    """Rank of every method per measure, coverage descending and the others ascending."""
    scores = interval(df, [*keys, method], level, cwc="exponential")
    long = tidy(scores, [*keys, method])
    return rank_models(long, [*keys, "metric"], method, descending=("picp",))


def interval_method_summary(df: DataFrame, keys: Keys, method: str, level: float = 0.95) -> DataFrame:
    scores = interval(df, [*keys, method], level, cwc="exponential")
    return scores.groupBy(*keys).agg(
        F.min_by(method, F.struct(-F.col("picp"), F.col(method))).alias("best_coverage"),
        F.min_by(method, F.struct("pinaw", method)).alias("narrowest"),
        F.min("picp").alias("coverage_min"),
        F.max("picp").alias("coverage_max"),
        F.min("pinaw").alias("width_min"),
        F.max("pinaw").alias("width_max"),
    )


# --- ranking --------------------------------------------------------------------------------


def rank_models(
    scores: DataFrame,
    within: Sequence[str],
    model: str,
    value: str = "value",
    descending: Sequence[str] = ("r2", "picp"),
    metric: str = "metric",
) -> DataFrame:
    """Rank by score inside each group of a few models; names break ties."""
    from pyspark.sql import Window

    signed = F.when(F.col(metric).isin(list(descending)), -F.col(value)).otherwise(F.col(value))
    w = Window.partitionBy(*within).orderBy(signed, F.col(model))
    return scores.withColumn("rank", F.row_number().over(w))


def top_models(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.where(F.col("rank") <= k)


# --- residuals ------------------------------------------------------------------------------


def residual_analysis(df: DataFrame, keys: Keys, order: Sequence[str]) -> DataFrame:
    """Moments and lag-1 autocorrelation of y - yhat; short groups have no higher moments."""
    resid = df.withColumn("_e", F.col("y") - F.col("yhat"))
    shifted = over_series(resid, keys, _c(*order), lambda w: {"_l": F.lag("_e").over(w)}, back=1)
    m, n = summary.moments("_e"), F.count("_e")
    return shifted.groupBy(*keys).agg(
        m["mean"].alias("mean"),
        m["std"].alias("std"),
        F.when(n < 3, 0.0).otherwise(m["skewness"]).alias("skewness"),
        F.when(n < 4, 0.0).otherwise(m["kurtosis"]).alias("kurtosis"),
        F.corr("_e", "_l").alias("autocorr_lag1"),
    )


def ljung_box(df: DataFrame, keys: Keys, order: Sequence[str], lags: int = 10) -> DataFrame:
    """Q statistic and p-value of joint autocorrelation up to ``lags``."""
    resid = df.withColumn("_e", F.col("y") - F.col("yhat"))
    mean = resid.groupBy(*keys).agg(F.avg("_e").alias("_m"))
    lagged = over_series(
        resid,
        keys,
        _c(*order),
        lambda w: {f"_e{k}": F.lag("_e", k).over(w) for k in range(1, lags + 1)},
        back=lags,
    )
    d = F.col("_e") - F.col("_m")
    sums = join_params(lagged, mean, keys).groupBy(*keys).agg(
        F.count("_e").alias("_n"),
        F.sum(d * d).alias("_c0"),
        *[F.sum(d * (F.col(f"_e{k}") - F.col("_m"))).alias(f"_c{k}") for k in range(1, lags + 1)],
    )
    n = F.col("_n")
    q = F.lit(0.0)
    for k in range(1, lags + 1):
        q = q + F.pow(F.col(f"_c{k}") / F.col("_c0"), F.lit(2.0)) / (n - k)
    out = sums.select(*keys, (n * (n + 2) * q).alias("statistic"))
    return out.withColumn("p_value", chi2_p_value(F.col("statistic"), lags))


def error_distribution(df: DataFrame, keys: Keys) -> DataFrame:
    rows = with_abs_error(df).withColumn("_e", F.col("y") - F.col("yhat"))
    aggs = {"max_error": F.max("_abs"), "min_error": F.min("_abs"), "error_variance": F.var_pop("_e")}
    return grouped(rows, keys, aggs, {f"p{round(p * 100)}": ("_abs", p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)})


def compare_models(df: DataFrame, keys: Keys, model: str, level: float = 0.95) -> DataFrame:
    """Point and interval measures of each model with its rank per measure."""
    aggs = {**point_metrics(), **interval_metrics(level)}
    wide = df.groupBy(*keys, model).agg(*[c.alias(n) for n, c in aggs.items()])
    ranked_on = ("rmse", "mae", "mape", "r2", "picp", "pinaw", "cwc", "interval_score")
    long = summary.melt(wide, [*keys, model], ranked_on, "metric", "value")
    return rank_models(long, [*keys, "metric"], model)
