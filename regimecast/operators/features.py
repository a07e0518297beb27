"""Projections, filters, lags, rolling windows, splits and unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from regimecast.functions.calendar import table_time_features
from regimecast.functions.scalars import circular_step
from regimecast.operators.ordering import Keys, join_params, over_series, row_index, running_sums

# Fixed defaults of the lag sets and rolling windows.
MODEL_LAGS = (1, 2, 3, 6, 12, 24)
TABLE_LAGS = (1, 2, 3, 6, 12, 24, 48, 168)
ROLLING_WINDOWS = (24, 168)


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(source).alias(name) for name, source in columns.items()])


def to_number(column: str) -> Column:
    return F.col(column).try_cast("double")


def band_width(lower: str, upper: str) -> Column:
    return F.col(upper) - F.col(lower)


def preferred_category(df: DataFrame, category: str, preferred: str, order: str) -> DataFrame:
    """Rows of the preferred category, or of the first category present when it is absent."""
    choice = df.agg(
        F.coalesce(
            F.max(F.when(F.col(category) == preferred, F.col(category))),
            F.min_by(category, order),
        ).alias("_chosen")
    )
    # One row, so the broadcast has a fixed size.
    return df.join(F.broadcast(choice), F.col(category) == F.col("_chosen")).drop("_chosen")


def circular_variability(
    df: DataFrame, keys: Keys, order: Sequence[str], degrees: str, scale: float = 1.0, name: str = "y"
) -> DataFrame:
    """Step-to-step change of a bearing, scaled to 0..scale over the series."""
    stepped = over_series(
        df,
        keys,
        _cols(order),
        lambda w: {"_step": circular_step(F.col(degrees), F.lag(degrees).over(w))},
        back=1,
    )
    span = stepped.groupBy(*keys).agg(F.min("_step").alias("_lo"), F.max("_step").alias("_hi"))
    unit = (F.col("_step") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-8)
    return (
        join_params(stepped, span, keys).withColumn(name, unit * scale).drop("_step", "_lo", "_hi")
    )


def lag_columns(value: str, lags: Sequence[int], window: WindowSpec, prefix: str) -> dict[str, Column]:
    return {f"{prefix}lag_{k}": F.lag(value, k).over(window) for k in lags}


def add_lags(
    df: DataFrame,
    keys: Keys,
    order: Sequence[str],
    value: str,
    lags: Sequence[int] = MODEL_LAGS,
    prefix: str = "",
    drop_incomplete: bool = True,
) -> DataFrame:
    out = over_series(
        df, keys, _cols(order), lambda w: lag_columns(value, lags, w, prefix), back=max(lags)
    )
    return out.na.drop(subset=[f"{prefix}lag_{k}" for k in lags]) if drop_incomplete else out


def rolling_columns(
    value: str, windows: Sequence[int], window: WindowSpec, prefix: str
) -> dict[str, Column]:
    """Trailing mean and sample deviation over up to w rows; one row has no deviation."""
    out = {}
    for w in windows:
        frame = window.rowsBetween(-(w - 1), 0)
        out[f"{prefix}rolling_mean_{w}"] = F.avg(value).over(frame)
        out[f"{prefix}rolling_std_{w}"] = F.stddev_samp(value).over(frame)
    return out


def add_rolling(
    df: DataFrame,
    keys: Keys,
    order: Sequence[str],
    value: str,
    windows: Sequence[int] = ROLLING_WINDOWS,
    prefix: str = "",
) -> DataFrame:
    return over_series(
        df, keys, _cols(order), lambda w: rolling_columns(value, windows, w, prefix), back=max(windows) - 1
    )


def add_table_features(
    df: DataFrame,
    keys: Keys,
    ts: str,
    value: str,
    lags: Sequence[int] = TABLE_LAGS,
    windows: Sequence[int] = ROLLING_WINDOWS,
) -> DataFrame:
    """Calendar, lag and rolling columns of a processed table; incomplete rows are dropped.

    All windows share one sort of the series.
    """
    prefix = f"{value}_"

    def build(w: WindowSpec) -> dict[str, Column]:
        return {**lag_columns(value, lags, w, prefix), **rolling_columns(value, windows, w, prefix)}

    reach = max(max(lags), max(windows) - 1)
    out = over_series(df, keys, [F.col(ts)], build, back=reach)
    return out.na.drop(how="any").withColumns(table_time_features(ts))


def full_window(value: str, size: int, window: WindowSpec, measure) -> Column:
    """A moving measure, null until the window is complete."""
    frame = window.rowsBetween(-(size - 1), 0)
    return F.when(F.count(F.lit(1)).over(frame) == size, measure(value).over(frame))


def moving(
    df: DataFrame, keys: Keys, order: Sequence[str], value: str, size: int, measure, name: str
) -> DataFrame:
    """Complete windows only, as one row per window end."""
    out = over_series(
        df, keys, _cols(order), lambda w: {name: full_window(value, size, w, measure)}, back=size - 1
    )
    return out.where(F.col(name).isNotNull())


def sliding_matrix(
    df: DataFrame, keys: Keys, order: Sequence[str], value: str, n_lags: int = 24, name: str = "x"
) -> DataFrame:
    """The previous n values, oldest first, as one array; rows without n values behind are dropped."""

    def build(w: WindowSpec) -> dict[str, Column]:
        frame = w.rowsBetween(-n_lags, -1)
        return {name: F.when(F.count(F.lit(1)).over(frame) == n_lags, F.collect_list(value).over(frame))}

    out = over_series(df, keys, _cols(order), build, back=n_lags)
    return out.where(F.col(name).isNotNull())


def difference(df: DataFrame, keys: Keys, order: Sequence[str], value: str, name: str = "diff") -> DataFrame:
    return over_series(
        df, keys, _cols(order), lambda w: {name: F.col(value) - F.lag(value).over(w)}, back=1
    )


def autocorrelation(
    df: DataFrame, keys: Keys, order: Sequence[str], value: str, lags: Sequence[int] = (1,)
) -> DataFrame:
    """Pearson correlation of each value with the one k rows earlier."""
    shifted = over_series(
        df,
        keys,
        _cols(order),
        lambda w: {f"_l{k}": F.lag(value, k).over(w) for k in lags},
        back=max(lags),
    )
    return shifted.groupBy(*keys).agg(*[F.corr(value, f"_l{k}").alias(f"autocorr_{k}") for k in lags])


def islands(
    df: DataFrame, keys: Keys, order: Sequence[str], flag: Column
) -> DataFrame:
    """Runs of consecutive flagged rows: (keys, region_start, region_end, length) by position."""
    counts = {"_rows": F.lit(1), "_flagged": F.when(F.col("_flag"), 1).otherwise(0)}
    counted = running_sums(df.withColumn("_flag", flag), keys, _cols(order), counts).where("_flag")
    # Within a run both counts grow alike.
    return (
        counted.withColumn("_i", F.col("_rows") - 1)
        .groupBy(*keys, (F.col("_rows") - F.col("_flagged")).alias("_run"))
        .agg(
            F.min("_i").alias("region_start"),
            F.max("_i").alias("region_end"),
            F.count(F.lit(1)).alias("length"),
        )
        .drop("_run")
    )


def tie_averaged_rank(df: DataFrame, within: Sequence[str], score: str, name: str = "rank") -> DataFrame:
    """Rank inside small groups, ties sharing the mean rank."""
    from pyspark.sql import Window

    group = Window.partitionBy(*within)
    rank = F.rank().over(group.orderBy(score))
    tied = F.count(F.lit(1)).over(Window.partitionBy(*within, score))
    return df.withColumn(name, rank + (tied - 1) / 2.0)


def equal_count_bins(
    df: DataFrame, keys: Keys, order: Sequence[str], bins: int = 10, name: str = "bin"
) -> DataFrame:
    """0-based bins of n // bins rows by order; the last bin takes the remainder."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    placed = join_params(row_index(df, keys, _cols(order), "_i"), sizes, keys)
    size = F.floor(F.col("_n") / bins)
    bin_no = F.when(size == 0, F.lit(bins - 1)).otherwise(
        F.least(F.floor(F.col("_i") / F.nullif(size, F.lit(0))), F.lit(bins - 1))
    )
    return placed.withColumn(name, bin_no.cast("int")).drop("_i", "_n")


def with_position(df: DataFrame, keys: Keys, order: Sequence[str]) -> DataFrame:
    """Add position ``_i`` and series length ``_n``."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return join_params(row_index(df, keys, _cols(order), "_i"), sizes, keys)


def chronological_split(
    df: DataFrame,
    keys: Keys,
    order: Sequence[str],
    train: float = 0.8,
    val: float = 0.1,
    name: str = "split",
) -> DataFrame:
    """train / val / test by position; the counts are floored."""
    placed = with_position(df, keys, order)
    n_train = F.floor(F.col("_n") * train)
    n_val = F.floor(F.col("_n") * val)
    label = (
        F.when(F.col("_i") < n_train, "train")
        .when(F.col("_i") < n_train + n_val, "val")
        .otherwise("test")
    )
    return placed.withColumn(name, label).drop("_i", "_n")


def two_way_split(
    df: DataFrame, keys: Keys, order: Sequence[str], share: float = 0.8, name: str = "split"
) -> DataFrame:
    placed = with_position(df, keys, order)
    label = F.when(F.col("_i") < F.floor(F.col("_n") * share), "train").otherwise("test")
    return placed.withColumn(name, label).drop("_i", "_n")


def size_ladder(
    df: DataFrame, keys: Keys, order: Sequence[str], sizes: Sequence[int] = (1000, 5000, 10000, 20000)
) -> DataFrame:
    """Every prefix of the ladder in one frame, tagged ``size``; a row is in each prefix that holds it."""
    if not keys:
        df = df.orderBy(*_cols(order)).limit(max(sizes))  # a top-n: nothing beyond the ladder is ranked
    placed = row_index(df, keys, _cols(order), "_i")
    held = F.array_compact(F.array(*[F.when(F.col("_i") < s, F.lit(s)) for s in sizes]))
    return placed.withColumn("size", F.explode(held)).drop("_i")


def tagged_union(frames: dict[str, DataFrame], tag: str = "dataset_source") -> DataFrame:
    """Datasets with different columns under one another, absent columns null."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def sort_by_time(df: DataFrame, keys: Keys, ts: str) -> DataFrame:
    return df.orderBy(*keys, ts)
