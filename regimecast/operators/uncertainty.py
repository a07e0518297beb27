"""Analytics over the truth / indeterminacy / falsity columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimecast.operators import features, summary
from regimecast.operators.ordering import Keys, grouped, join_params, over_series

COMPONENTS = ("truth", "indeterminacy", "falsity")
# Fixed thresholds of the categories.
HIGH, LOW = 0.7, 0.3
DOMINANT_SHARE = 0.8


def distribution(df: DataFrame, keys: Keys) -> DataFrame:
    """Moments and quartiles per component, in long form."""
    long = summary.melt(df, keys, COMPONENTS, "component", "_v")
    aggs = {n: c for n, c in summary.moments("_v").items() if n not in ("skewness", "kurtosis")}
    return grouped(long, [*keys, "component"], aggs, {n: ("_v", p) for n, p in summary.QUARTILES.items()})


def component_stats(df: DataFrame, keys: Keys) -> DataFrame:
    long = summary.melt(df, keys, COMPONENTS, "component", "_v")
    return grouped(
        long, [*keys, "component"], summary.moments("_v"), {n: ("_v", p) for n, p in summary.QUARTILES.items()}
    )


def component_correlations(df: DataFrame, keys: Keys) -> DataFrame:
    t, i, f = COMPONENTS
    return summary.correlations(df, keys, [(t, i), (t, f), (i, f)])


def high_indeterminacy(df: DataFrame, keys: Keys, p: float = 0.9) -> DataFrame:
    """The P90 threshold of indeterminacy with the share and count above it."""
    edge = grouped(df, keys, {}, {"threshold": ("indeterminacy", p)})
    above = F.col("indeterminacy") > F.col("threshold")
    return join_params(df, edge, keys).groupBy(*keys).agg(
        F.first("threshold").alias("threshold"),
        F.avg(above.cast("double")).alias("ratio"),
        F.count_if(above).alias("count"),
    )


def category_flags(high: float = HIGH, low: float = LOW) -> dict[str, Column]:
    t, i, f = (F.col(c) for c in COMPONENTS)
    return {
        "high_indeterminacy": i > high,
        "low_truth": t < low,
        "high_falsity": f > high,
        "high_uncertainty": (i > high) & (t < low),
        "low_uncertainty": (t > 1 - low) & (i < low),
    }


def add_categories(df: DataFrame) -> DataFrame:
    """Membership in each category as a boolean column; it stays with the row."""
    return df.withColumns(category_flags())


def category_counts(df: DataFrame, keys: Keys) -> DataFrame:
    flags = category_flags()
    wide = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(n) for n, c in flags.items()]
    )
    rows = [F.struct(F.lit(n).alias("category"), F.col(n).alias("count")) for n in flags]
    return wide.select(*keys, "_n", F.explode(F.array(*rows)).alias("c")).select(
        *keys, "c.category", "c.count", (F.col("c.count") / F.col("_n")).alias("ratio")
    )


def composite_columns() -> dict[str, Column]:
    t, i, f = (F.col(c) for c in COMPONENTS)
    return {
        "overall_uncertainty": i * (1 - t),
        "conflict": F.least(t, f),
        "ignorance": 1 - (t + i + f),
        "certainty": t * (1 - i),
        "ambiguity": i,
    }


def add_composites(df: DataFrame) -> DataFrame:
    return df.withColumns(composite_columns())


def composite_stats(df: DataFrame, keys: Keys) -> DataFrame:
    measured = add_composites(df)
    long = summary.melt(measured, keys, list(composite_columns()), "measure", "_v")
    return long.groupBy(*keys, "measure").agg(
        F.avg("_v").alias("mean"),
        F.stddev_pop("_v").alias("std"),
        F.min("_v").alias("min"),
        F.max("_v").alias("max"),
    )


def temporal_patterns(
    df: DataFrame, keys: Keys, order: Sequence[str], windows: Sequence[int] = (5, 10, 20)
) -> DataFrame:
    """Mean and spread of moving means and moving deviations, one row per window size."""

    def build(w) -> dict[str, Column]:
        out = {}
        for n in windows:
            out[f"_i_{n}"] = features.full_window("indeterminacy", n, w, F.avg)
            out[f"_t_{n}"] = features.full_window("truth", n, w, F.avg)
            out[f"_v_{n}"] = features.full_window("indeterminacy", n, w, F.stddev_pop)
        return out

    moved = over_series(df, keys, [F.col(c) for c in order], build, back=max(windows) - 1)
    names = {"_i": "indeterminacy_ma", "_t": "truth_ma", "_v": "indeterminacy_volatility"}
    stats = []
    for n in windows:
        fields = [F.lit(n).alias("window"), F.count(F.lit(1)).alias("_rows")]
        for short, name in names.items():
            fields.append(F.avg(f"{short}_{n}").alias(f"{name}_mean"))
            fields.append(F.stddev_pop(f"{short}_{n}").alias(f"{name}_std"))
        stats.append(F.struct(*fields))
    wide = moved.groupBy(*keys).agg(F.array(*stats).alias("_w"))
    long = wide.select(*keys, F.explode("_w").alias("w")).select(*keys, "w.*")
    # A window as long as the series says nothing about it; short series get the shortest only.
    fits = (F.col("window") < F.col("_rows")) & (
        (F.col("_rows") > max(windows)) | (F.col("window") == min(windows))
    )
    return long.where(fits).drop("_rows")


def concentration_ratios() -> dict[str, Column]:
    i = F.col("indeterminacy")
    return {
        "high_ratio": F.avg((i > HIGH).cast("double")),
        "low_ratio": F.avg((i < LOW).cast("double")),
    }


def distribution_analysis(df: DataFrame, keys: Keys, bins: int = 10) -> DataFrame:
    """Modal bin, concentration and shape of the indeterminacy histogram, one row per series.

    One pass finds the range, one counts the bins and the ratios together.
    """
    counted = summary.bin_counts(df, keys, "indeterminacy", bins, concentration_ratios())
    high, low = F.col("high_ratio"), F.col("low_ratio")
    return counted.select(
        *keys,
        *[c.alias(n) for n, c in summary.bin_shape(bins).items()],
        "high_ratio",
        "low_ratio",
        (1 - high - low).alias("medium_ratio"),
        ((high > DOMINANT_SHARE) | (low > DOMINANT_SHARE)).alias("is_concentrated"),
    )


def weights(df: DataFrame, keys: Keys, method: str = "indeterminacy", name: str = "weight") -> DataFrame:
    """Uncertainty weights scaled to 0..1 over the series; 0 where they do not vary."""
    t, i = F.col("truth"), F.col("indeterminacy")
    rules = {"indeterminacy": i, "composite": i * (1 - t), "truth_based": 1 - t}
    if method not in rules:
        raise ValueError(f"unknown weight {method!r}; known: {sorted(rules)}")
    raw = df.withColumn("_w", rules[method])
    span = raw.groupBy(*keys).agg(F.min("_w").alias("_lo"), F.max("_w").alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    scaled = F.when(hi == lo, F.lit(0.0)).otherwise((F.col("_w") - lo) / (hi - lo))
    return join_params(raw, span, keys).withColumn(name, scaled).drop("_w", "_lo", "_hi")


def transition_regions(
    df: DataFrame, keys: Keys, order: Sequence[str], threshold: float = HIGH
) -> DataFrame:
    """Runs of consecutive rows with indeterminacy above the threshold."""
    return features.islands(df, keys, order, F.col("indeterminacy") > threshold)


def transition_summary(
    df: DataFrame, keys: Keys, order: Sequence[str], threshold: float = HIGH
) -> DataFrame:
    """Points in transition, their share, number and mean length of the regions."""
    points = df.groupBy(*keys).agg(
        F.count_if(F.col("indeterminacy") > threshold).alias("points"), F.count(F.lit(1)).alias("_n")
    )
    regions = transition_regions(df, keys, order, threshold).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("regions"), F.avg("length").alias("mean_length")
    )
    out = join_params(points, regions, keys)
    return out.select(
        *keys,
        "points",
        (F.col("points") / F.col("_n")).alias("ratio"),
        F.coalesce("regions", F.lit(0)).alias("regions"),
        F.coalesce("mean_length", F.lit(0.0)).alias("mean_length"),
    )
