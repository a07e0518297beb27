"""Per-series scaling with stored parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimecast.operators.ordering import Keys, join_params

# Parameter columns carry this prefix while they are attached to rows.
_P = "_par_"


def fit(df: DataFrame, keys: Keys, value: str) -> DataFrame:
    """One row per series with the parameters of both methods."""
    return df.groupBy(*keys).agg(
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
        F.avg(value).alias("mu"),
        F.stddev_pop(value).alias("sd"),
    )


def _attach(df: DataFrame, params: DataFrame, keys: Keys, method: str) -> DataFrame:
    columns = {"min_max": ("lo", "hi"), "z_score": ("mu", "sd")}
    if method not in columns:
        raise ValueError(f"unknown normalisation {method!r}; known: {sorted(columns)}")
    picked = params.select(*keys, *[F.col(c).alias(_P + c) for c in columns[method]])
    return join_params(df, picked, keys)


def apply(
    df: DataFrame, params: DataFrame, keys: Keys, value: str, method: str = "min_max", name: str = "y_norm"
) -> DataFrame:
    """Scale with the given parameters; a series without variance becomes 0."""
    rows = _attach(df, params, keys, method)
    y = F.col(value)
    if method == "min_max":
        lo, hi = F.col(_P + "lo"), F.col(_P + "hi")
        scaled = F.when(hi == lo, F.lit(0.0)).otherwise((y - lo) / (hi - lo))
    else:
        mu, sd = F.col(_P + "mu"), F.col(_P + "sd")
        scaled = F.when(sd == 0, F.lit(0.0)).otherwise((y - mu) / sd)
    return rows.select(*df.columns, scaled.alias(name))


def _back(z: Column, method: str) -> Column:
    if method == "min_max":
        return z * (F.col(_P + "hi") - F.col(_P + "lo")) + F.col(_P + "lo")
    return z * F.col(_P + "sd") + F.col(_P + "mu")


def invert(
    df: DataFrame, params: DataFrame, keys: Keys, value: str, method: str = "min_max", name: str = "y"
) -> DataFrame:
    rows = _attach(df, params, keys, method)
    kept = [c for c in df.columns if c != name]
    return rows.select(*kept, _back(F.col(value), method).alias(name))


def invert_all(
    df: DataFrame, params: DataFrame, keys: Keys, columns: dict[str, str], method: str = "min_max"
) -> DataFrame:
    """Columns {source: name} back in original units by one join; the sources go."""
    rows = _attach(df, params, keys, method)
    kept = [c for c in df.columns if c not in columns and c not in columns.values()]
    return rows.select(*kept, *[_back(F.col(c), method).alias(n) for c, n in columns.items()])
