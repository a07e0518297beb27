"""Gap filling and outlier repair of series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimecast.operators.ordering import Keys, join_params, neighbours

OUTLIER_Z = 3.0


def _linear() -> Column:
    """Straight line by row position between the known neighbours; the nearest one at the edges."""
    prev, nxt = F.col("_prev"), F.col("_next")
    share = (F.col("_i") - prev["i"]) / (nxt["i"] - prev["i"])
    return F.when(nxt["i"] > prev["i"], prev["v"] + (nxt["v"] - prev["v"]) * share).otherwise(
        F.coalesce(prev["v"], nxt["v"])
    )


def fill(
    df: DataFrame, keys: Keys, order: Sequence[str], value: str, method: str = "linear"
) -> DataFrame:
    """Replace nulls of a series: linear, forward_fill, backward_fill or mean.

    Gaps at the edges take the nearest known value.
    """
    if method == "mean":
        mean = df.groupBy(*keys).agg(F.avg(value).alias("_mean"))
        filled = join_params(df, mean, keys)
        return filled.withColumn(value, F.coalesce(value, "_mean")).select(*df.columns)
    known = neighbours(df, keys, order, value)
    rules = {
        "linear": _linear(),
        "forward_fill": F.coalesce(F.col("_prev")["v"], F.col("_next")["v"]),
        "backward_fill": F.coalesce(F.col("_next")["v"], F.col("_prev")["v"]),
    }
    if method not in rules:
        raise ValueError(f"unknown fill {method!r}; known: {sorted([*rules, 'mean'])}")
    return known.withColumn(value, rules[method]).select(*df.columns)


def outlier_params(df: DataFrame, keys: Keys, value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sd")
    )


def repair_outliers(
    df: DataFrame,
    keys: Keys,
    order: Sequence[str],
    value: str,
    threshold: float = OUTLIER_Z,
    params: DataFrame | None = None,
) -> DataFrame:
    """Null values further than ``threshold`` deviations from the mean, then interpolate them.

    Pass stored ``params`` to apply the statistics of earlier data.
    """
    params = outlier_params(df, keys, value) if params is None else params
    scored = join_params(df, params, keys)
    far = (F.col("_sd") > 0) & (F.abs((F.col(value) - F.col("_mu")) / F.col("_sd")) > threshold)
    nulled = scored.withColumn(value, F.when(~F.coalesce(far, F.lit(False)), F.col(value)))
    return fill(nulled.select(*df.columns), keys, order, value, "linear")
