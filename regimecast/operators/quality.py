"""Data-quality checks: one row per series with the numbers, errors and warnings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regimecast.operators.ordering import Keys, grouped, join_params, over_series

# Fixed limits of the checks.
MIN_ROWS = 100
MAX_MISSING = 0.1
MAX_OUTLIERS = 0.05
IQR_REACH = 1.5
MAX_VALUE = 10_000.0
MAX_VARIATION = 2.0
MIN_REGULAR = 0.9
STEP_SECONDS = {"H": 3600, "D": 86400, "15T": 900, "30T": 1800}


def check_structure(df: DataFrame, required: dict[str, str]) -> DataFrame:
    """Per required column: present, and how many non-null values cannot be cast to its type."""
    present = [c for c in required if c in df.columns]
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[
            F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(required[c]).isNull()).alias(c)
            for c in present
        ],
    )
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(c in present).alias("present"),
            (F.col(c) if c in present else F.lit(None).cast("bigint")).alias("uncastable"),
        )
        for c in required
    ]
    out = counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    ok = F.col("present") & (F.coalesce("uncastable", F.lit(0)) == 0)
    return out.withColumn("valid", ok)


def completeness(
    df: DataFrame, keys: Keys, value: str, min_rows: int = MIN_ROWS, max_missing: float = MAX_MISSING
) -> DataFrame:
    n, missing = F.count(F.lit(1)), F.count_if(F.col(value).isNull())
    out = df.groupBy(*keys).agg(n.alias("total_rows"), missing.alias("missing"))
    ratio = F.col("missing") / F.col("total_rows")
    return out.withColumn("missing_ratio", ratio).withColumn(
        "valid", (F.col("total_rows") >= min_rows) & (F.col("missing_ratio") <= max_missing)
    )


def value_quality(df: DataFrame, keys: Keys, value: str, max_outliers: float = MAX_OUTLIERS) -> DataFrame:
    """Share outside the interquartile fences, negatives, and the constant-series error."""
    known = df.where(F.col(value).isNotNull())
    edges = grouped(df, keys, {}, {"_q1": (value, 0.25), "_q3": (value, 0.75)})
    reach = IQR_REACH * (F.col("_q3") - F.col("_q1"))
    outside = (F.col(value) < F.col("_q1") - reach) | (F.col(value) > F.col("_q3") + reach)
    out = join_params(known, edges, keys).groupBy(*keys).agg(
        F.avg(outside.cast("double")).alias("outlier_ratio"),
        F.count_if(F.col(value) < 0).alias("negatives"),
        (F.min(value) == F.max(value)).alias("constant"),
    )
    return out.withColumn("many_outliers", F.col("outlier_ratio") > max_outliers).withColumn(
        "valid", ~F.col("constant")
    )


def temporal(
    df: DataFrame, keys: Keys, ts: str, ingest_order: str | None = None, frequency: str = "H"
) -> DataFrame:
    """Ascending by ingest order, duplicate timestamps, share of regular steps.

    Without an ingest order column the rows carry no order of their own, so only duplicates and
    regularity are checked.
    """
    by = [F.col(ingest_order)] if ingest_order else [F.col(ts)]
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    stepped = over_series(
        df, keys, by, lambda w: {"_dt": micros - F.lag(micros).over(w)}, back=1
    )
    distinct = df.groupBy(*keys, ts).count().groupBy(*keys).agg(
        F.sum(F.col("count") - 1).alias("duplicates")
    )
    step = STEP_SECONDS.get(frequency, 3600) * 1_000_000
    out = stepped.groupBy(*keys).agg(
        F.count_if(F.col("_dt") < 0).alias("descending"),
        F.avg((F.col("_dt") == step).cast("double")).alias("regular_ratio"),
    )
    return join_params(out, distinct, keys).withColumn(
        "irregular", F.coalesce(F.col("regular_ratio") < MIN_REGULAR, F.lit(False))
    ).withColumn("valid", (F.col("descending") == 0) & (F.col("duplicates") == 0))


def value_ranges(
    df: DataFrame, keys: Keys, value: str, max_value: float = MAX_VALUE, max_variation: float = MAX_VARIATION
) -> DataFrame:
    """Large values and coefficient of variation; a mean of 0 or below counts as too variable."""
    out = df.groupBy(*keys).agg(
        F.count_if(F.col(value) > max_value).alias("large_values"),
        F.when(F.avg(value) > 0, F.stddev_pop(value) / F.avg(value)).alias("variation"),
    )
    return out.withColumn(
        "noisy", F.col("variation").isNull() | (F.col("variation") > max_variation)
    )


def report(
    df: DataFrame, keys: Keys, ts: str, value: str, ingest_order: str | None = None, frequency: str = "H"
) -> DataFrame:
    """All checks of a series in one row: is_valid, errors and warnings by name, and its statistics.

    Text columns are read as numbers and times first; what cannot be read is an error of structure,
    and counts as missing in the other checks. A column that is not there raises.
    """
    absent = [c for c in (*keys, ts, value) if c not in df.columns]
    if absent:
        raise ValueError(f"columns {absent} are missing")
    kinds = dict(df.dtypes)
    text = {c: t for c, t in ((value, "double"), (ts, "timestamp_ntz")) if kinds[c] == "string"}
    broken = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()) for c, t in text.items()]
    y = F.col(value).try_cast("double")
    # One pass for everything that is a plain aggregate.
    basics = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(y.isNull()).alias("missing"),
        sum(broken, F.lit(0)).cast("bigint").alias("unreadable"),
        F.count_if(y > MAX_VALUE).alias("large_values"),
        F.avg(y).alias("mean"),
        F.stddev_pop(y).alias("std"),
        F.min(y).alias("minimum"),
        F.max(y).alias("maximum"),
    )
    df = df.withColumns({c: F.col(c).try_cast(t) for c, t in text.items()})
    parts = [
        basics,
        value_quality(df, keys, value).withColumnRenamed("valid", "_quality"),
        temporal(df, keys, ts, ingest_order, frequency).withColumnRenamed("valid", "_temporal"),
    ]
    joined = reduce(lambda a, b: join_params(a, b, keys), parts)
    variation = F.when(F.col("mean") > 0, F.col("std") / F.col("mean"))
    joined = joined.withColumns(
        {
            "missing_ratio": F.col("missing") / F.col("total_rows"),
            "noisy": variation.isNull() | (variation > MAX_VARIATION),
        }
    )

    def names(**flags: Column) -> Column:
        return F.array_compact(F.array(*[F.when(flag, F.lit(n)) for n, flag in flags.items()]))

    errors = names(
        unreadable_values=F.col("unreadable") > 0,
        too_few_rows=F.col("total_rows") < MIN_ROWS,
        too_many_missing=F.col("missing_ratio") > MAX_MISSING,
        constant_values=F.col("constant"),
        not_ascending=F.col("descending") > 0,
        duplicate_timestamps=F.col("duplicates") > 0,
    )
    warnings = names(
        some_missing=(F.col("missing") > 0) & (F.col("missing_ratio") <= MAX_MISSING),
        many_outliers=F.col("many_outliers"),
        negative_values=F.col("negatives") > 0,
        irregular_steps=F.col("irregular"),
        large_values=F.col("large_values") > 0,
        high_variation=F.col("noisy"),
    )
    complete = (F.col("total_rows") >= MIN_ROWS) & (F.col("missing_ratio") <= MAX_MISSING)
    valid = complete & (F.col("unreadable") == 0) & F.col("_quality") & F.col("_temporal")
    return joined.select(
        *keys,
        F.coalesce(valid, F.lit(False)).alias("is_valid"),
        errors.alias("errors"),
        warnings.alias("warnings"),
        "total_rows",
        "missing",
        "unreadable",
        "mean",
        "std",
        "minimum",
        "maximum",
    )


def _unfit(column: str) -> tuple[Column, Column]:
    c = F.col(column).cast("double")
    return F.isnan(c), F.abs(c) == F.lit(float("inf"))


def forecast_inputs(df: DataFrame, keys: Keys, value: str, horizon: int) -> DataFrame:
    """Empty, missing or infinite input, and a horizon that does not fit."""
    nan, inf = _unfit(value)
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col(value).isNull() | nan).alias("missing"),
        F.count_if(inf).alias("infinite"),
    )
    ok = (F.col("total_rows") > 0) & (F.col("missing") == 0) & (F.col("infinite") == 0)
    fits = (F.lit(horizon) > 0) & (F.lit(horizon) <= F.col("total_rows"))
    return out.withColumn("horizon_fits", fits).withColumn("valid", ok & fits)


def forecast_outputs(df: DataFrame, keys: Keys, yhat: str, lower: str, upper: str) -> DataFrame:
    nan, inf = _unfit(yhat)
    out = df.groupBy(*keys).agg(
        F.count_if(F.col(yhat).isNull() | nan).alias("missing"),
        F.count_if(inf).alias("infinite"),
        F.count_if(F.col(yhat) < 0).alias("negative"),
        F.count_if(F.col(lower) > F.col(upper)).alias("crossed"),
        F.count_if((F.col(lower) < 0) | (F.col(upper) < 0)).alias("negative_bounds"),
    )
    total = reduce(lambda a, b: a + b, [F.col(c) for c in out.columns if c not in keys])
    return out.withColumn("valid", total == 0)


def feature_table(df: DataFrame, columns: Sequence[str], keys: Keys = ()) -> DataFrame:
    """Rows with a null, NaN or infinite entry in any feature or target."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def bad(column: str, test) -> Column:
        if isinstance(types[column], T.ArrayType):
            return F.exists(column, lambda v: test(v.cast("double")))
        return test(F.col(column).cast("double"))

    def any_of(test) -> Column:
        flags = [F.coalesce(bad(c, test), F.lit(False)) for c in columns]
        return reduce(lambda a, b: a | b, flags)

    null = any_of(lambda v: v.isNull())
    nan = any_of(lambda v: F.isnan(v))
    inf = any_of(lambda v: F.abs(v) == F.lit(float("inf")))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(null).alias("null_rows"),
        F.count_if(nan).alias("nan_rows"),
        F.count_if(inf).alias("infinite_rows"),
    )
