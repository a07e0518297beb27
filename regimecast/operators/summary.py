"""Descriptive aggregates, profiles and histograms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regimecast.operators.ordering import Keys, grouped, join_params

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def collapse(df: DataFrame, keys: Sequence[str], sums: dict[str, str], means: dict[str, str]) -> DataFrame:
    """Rows of the same key summed or averaged into one."""
    return df.groupBy(*keys).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()], *[F.avg(c).alias(n) for n, c in means.items()]
    )


def moments(value: str) -> dict[str, Column]:
    """Mean, population deviation, range; skew and excess kurtosis, 0 on a constant."""
    constant = F.min(value) == F.max(value)
    return {
        "mean": F.avg(value),
        "std": F.stddev_pop(value),
        "min": F.min(value),
        "max": F.max(value),
        "skewness": F.when(constant, F.lit(0.0)).otherwise(F.skewness(value)),
        "kurtosis": F.when(constant, F.lit(0.0)).otherwise(F.kurtosis(value)),
    }


def describe(df: DataFrame, keys: Keys, value: str) -> DataFrame:
    aggs = {
        "count": F.count(F.lit(1)),
        **moments(value),
        "missing_values": F.count_if(F.col(value).isNull()),
        "zero_values": F.count_if(F.col(value) == 0),
        "negative_values": F.count_if(F.col(value) < 0),
    }
    return grouped(df, keys, aggs, {n: (value, p) for n, p in QUARTILES.items()})


def profile(df: DataFrame, keys: Keys, part: Column, value: str, name: str = "part") -> DataFrame:
    """Mean per calendar part."""
    return df.groupBy(*keys, part.alias(name)).agg(F.avg(value).alias("mean"))


def profile_extremes(prof: DataFrame, keys: Keys, name: str = "part") -> DataFrame:
    """Peak and low part of a profile with their means; the earlier part wins a tie."""
    first = -F.col(name)
    return prof.groupBy(*keys).agg(
        F.max_by(name, F.struct("mean", first)).alias("peak"),
        F.max("mean").alias("peak_mean"),
        F.min_by(name, F.struct("mean", F.col(name))).alias("low"),
        F.min("mean").alias("low_mean"),
    )


def dataset_summary(df: DataFrame, tag: str, ts: str, value: str) -> DataFrame:
    return df.groupBy(tag).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.lit(len(df.columns)).alias("n_columns"),
    )


def bin_counts(
    df: DataFrame, keys: Keys, value: str, bins: int = 10, extra: dict[str, Column] | None = None
) -> DataFrame:
    """Equal-width bins over the observed range, the last one closed: one row per group with the
    range and the array of counts. ``extra`` aggregates ride along in the same pass.

    A constant column is binned over half a unit to either side.
    """
    known = df.where(F.col(value).isNotNull())
    span = known.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    span = span.select(
        *keys,
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
    )
    place = F.least(F.floor((F.col(value) - F.col("_lo")) / bin_width(bins)), F.lit(bins - 1)).cast("int")
    placed = join_params(known, span, keys).withColumn("_place", place)
    return placed.groupBy(*keys).agg(
        F.first("_lo").alias("_lo"),
        F.first("_hi").alias("_hi"),
        F.array(*[F.count_if(F.col("_place") == b) for b in range(bins)]).alias("_counts"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )


def bin_width(bins: int) -> Column:
    return (F.col("_hi") - F.col("_lo")) / bins


def histogram(df: DataFrame, keys: Keys, value: str, bins: int = 10) -> DataFrame:
    """One row per bin, empty bins included."""
    exploded = bin_counts(df, keys, value, bins).select(
        *keys, "_lo", "_hi", F.posexplode("_counts").alias("bin", "count")
    )
    return exploded.select(
        *keys,
        "bin",
        (F.col("_lo") + F.col("bin") * bin_width(bins)).alias("left_edge"),
        (F.col("_lo") + (F.col("bin") + 1) * bin_width(bins)).alias("right_edge"),
        "count",
    )


def bin_shape(bins: int, tolerance: float = 0.2) -> dict[str, Column]:
    """Modal bin and shape of a row of bin counts."""
    c = [F.get("_counts", F.lit(b)) for b in range(bins)]
    mean = reduce(add, c) / bins
    peaks = [((c[b] > c[b - 1]) & (c[b] > c[b + 1])).cast("long") for b in range(1, bins - 1)]
    most = F.array_max("_counts")
    mode = F.array_position("_counts", most) - 1
    return {
        "bin": mode.cast("int"),
        "left_edge": F.col("_lo") + mode * bin_width(bins),
        "right_edge": F.col("_lo") + (mode + 1) * bin_width(bins),
        "count": most,
        "peaks": reduce(add, peaks),
        "is_bimodal": reduce(add, peaks) >= 2,
        "is_uniform": F.greatest(*[F.abs(x - mean) for x in c]) / mean <= tolerance,
    }


def modal_bin(hist: DataFrame, keys: Keys) -> DataFrame:
    best = F.max_by(F.struct("bin", "left_edge", "right_edge", "count"), F.struct("count", -F.col("bin")))
    return hist.groupBy(*keys).agg(best.alias("m")).select(*keys, "m.*")


def histogram_shape(hist: DataFrame, keys: Keys, tolerance: float = 0.2) -> DataFrame:
    """Bimodal: two strict interior peaks. Uniform: every bin within the tolerance of the mean."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("bin")
    c = F.col("count")
    peak = (c > F.lag("count").over(w)) & (c > F.lead("count").over(w))
    marked = hist.withColumn("_peak", F.coalesce(peak, F.lit(False))).withColumn(
        "_mean", F.avg("count").over(Window.partitionBy(*(keys or [F.lit(0)])))
    )
    return marked.groupBy(*keys).agg(
        F.count_if("_peak").alias("peaks"),
        (F.count_if("_peak") >= 2).alias("is_bimodal"),
        (F.max(F.abs(c - F.col("_mean")) / F.col("_mean")) <= tolerance).alias("is_uniform"),
    )


def correlations(df: DataFrame, keys: Keys, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.corr(a, b).alias(f"{a}_{b}") for a, b in pairs])


def melt(df: DataFrame, keys: Keys, columns: Sequence[str], name: str, value: str) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns]
    return df.select(*keys, F.explode(F.array(*pairs)).alias("_m")).select(*keys, f"_m.{name}", f"_m.{value}")


