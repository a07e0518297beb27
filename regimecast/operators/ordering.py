"""Ordered operators over many series, where any one series may be huge.

A series that fits one task is served by an ordinary window partitioned by the series
key. A series with more rows than ``spark.regimecast.maxGroupRows`` is spread over tasks:
a range-partitioned sort gives every row its exact position, positions are cut into
equal blocks, and each block borrows the neighbouring rows its frames reach (the halo).
Both ways give the same rows. A frame without keys is one series of unknown size and always
takes the second way.

Rows are always counted, whatever the size of the files. Columns that windows add do not change
the count's optimised plan, so a chain of operators over one frame counts once.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from regimecast.session import materialise

MAX_GROUP_ROWS = ("spark.regimecast.maxGroupRows", "5000000")

# A list of series is broadcast up to this length; beyond it the join is left to Spark.
MAX_BROADCAST_KEYS = 100_000

Keys = Sequence[str]


def _conf(df: DataFrame, entry: tuple[str, str]) -> int:
    return int(df.sparkSession.conf.get(*entry))


def group_limit(df: DataFrame) -> int:
    return _conf(df, MAX_GROUP_ROWS)


# Decisions by plan, newest last. They only choose between two ways to the same rows.
_DECIDED: OrderedDict[tuple, DataFrame | None] = OrderedDict()
_KEPT_DECISIONS = 512


def oversized_groups(df: DataFrame, keys: Keys) -> DataFrame | None:
    """Keys with more rows than one task should hold, with their counts ``_n``; None if there are none.

    The keys stay a frame of Spark's: there is one for every ``limit`` rows at most, which still
    grows with the data. Without keys the one row is the size of the frame.
    """
    limit = group_limit(df)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if not keys:
        return counts
    plan = counts._jdf.queryExecution().optimizedPlan().canonicalized()
    entry = (df.sparkSession.sparkContext.applicationId, limit, tuple(keys), plan.hashCode(), plan.toString())
    if entry not in _DECIDED:
        big = counts.where(F.col("_n") > limit)
        _DECIDED[entry] = None if big.isEmpty() else materialise(big)
        if len(_DECIDED) > _KEPT_DECISIONS:
            _DECIDED.popitem(last=False)
    _DECIDED.move_to_end(entry)
    return _DECIDED[entry]


def _listed(df: DataFrame, length: int) -> DataFrame:
    """A list of oversized series with a broadcast hint, if its counted length allows one."""
    return F.broadcast(df) if length <= MAX_BROADCAST_KEYS else df


def _same_key(left: DataFrame, right: DataFrame, keys: Keys) -> Column:
    return reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True)
    )


def _split(df: DataFrame, keys: Keys, big: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Rows of ordinary groups (None when there is no key) and rows of oversized groups."""
    if not keys:
        return None, df
    df = materialise(df)  # both sides read it
    big = _listed(big, big.count())
    return (
        df.join(big, _same_key(df, big, keys), "left_anti"),
        df.join(big, _same_key(df, big, keys), "left_semi"),
    )


def series_window(keys: Keys, order: Sequence[str | Column]) -> WindowSpec:
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)


def _ranged_index(
    df: DataFrame, keys: Keys, order: Sequence[str | Column], name: str, big: DataFrame
) -> DataFrame:
    """Positions by a range-partitioned sort, in tasks of about half the group limit.

    A hash of the whole row is the last sort key, so that rows of one sort value can be parted too.
    """
    total, groups = big.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(2, -(-2 * total // group_limit(df)))
    by = [*[F.col(k) for k in keys], *order, F.xxhash64(*df.columns)]
    ranged = materialise(
        df.repartitionByRange(parts, *by)
        .sortWithinPartitions(*by)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    # The id holds the partition above bit 33 and the place inside the partition below it.
    place = F.col("_place").bitwiseAND((1 << 33) - 1)
    part = F.shiftright("_place", 33)
    sizes = ranged.groupBy(part.alias("_part")).count().collect()
    offsets, seen = [], 0
    for row in sorted(sizes, key=lambda r: r["_part"]):
        offsets.append((row["_part"], seen))
        seen += row["count"]
    offset = df.sparkSession.createDataFrame(offsets, "_part bigint, _before bigint")
    placed = (
        ranged.withColumn("_part", part)
        .join(F.broadcast(offset), "_part")
        .withColumn(name, F.col("_before") + place)
        .drop("_part", "_before", "_place")
    )
    if not keys:
        return placed
    start = placed.groupBy(*keys).agg(F.min(name).alias("_start"))
    start = start.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_start")
    match = reduce(lambda a, b: a & b, [placed[k].eqNullSafe(start[f"_k_{k}"]) for k in keys])
    return (
        placed.join(_listed(start, groups), match)
        .withColumn(name, F.col(name) - F.col("_start"))
        .drop("_start", *[f"_k_{k}" for k in keys])
    )


def row_index(
    df: DataFrame, keys: Keys, order: Sequence[str | Column], name: str = "_i"
) -> DataFrame:
    """Exact 0-based position of each row inside its series."""
    big = oversized_groups(df, keys)
    plain = lambda d: d.withColumn(
        name, (F.row_number().over(series_window(keys, order)) - 1).cast("bigint")
    )
    if big is None:
        return plain(df)
    small, large = _split(df, keys, big)
    large = _ranged_index(large, keys, order, name, big)
    return large if small is None else plain(small).unionByName(large)


def _blocks(df: DataFrame, reach: int) -> int:
    return max(group_limit(df) // 2, reach, 1)


def over_series(
    df: DataFrame,
    keys: Keys,
    order: Sequence[str | Column],
    build: Callable[[WindowSpec], dict[str, Column]],
    back: int,
    ahead: int = 0,
) -> DataFrame:
    """Add windowed columns whose frames reach at most ``back`` rows behind and ``ahead`` in front.

    ``build`` gets the window to use and returns the new columns.
    """
    big = oversized_groups(df, keys)
    if big is None:
        return df.withColumns(build(series_window(keys, order)))
    small, large = _split(df, keys, big)
    size = _blocks(df, back + ahead)
    indexed = _ranged_index(large, keys, order, "_i", big)
    home = F.floor(F.col("_i") / size)
    within = F.col("_i") % size
    copies = F.array_compact(
        F.array(
            home,
            F.when(within >= size - back, home + 1),
            F.when((within < ahead) & (home > 0), home - 1),
        )
    )
    spread = indexed.withColumn("_home", home).withColumn("_blk", F.explode(copies))
    window = Window.partitionBy(*keys, "_blk").orderBy("_i")
    large = (
        spread.withColumns(build(window))
        .where(F.col("_blk") == F.col("_home"))
        .drop("_blk", "_home", "_i")
    )
    if small is None:
        return large
    return small.withColumns(build(series_window(keys, order))).unionByName(large)


def neighbours(
    df: DataFrame, keys: Keys, order: Sequence[str], value: str
) -> DataFrame:
    """Add ``_i`` and the nearest known values: ``_prev`` at or before, ``_next`` at or after the row.

    Both are structs (i, v), null where no known value exists on that side. The look-ahead is
    a look-back over the reversed order: Spark evaluates that frame in one pass.
    """
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(value).alias("v")))

    def fill(d: DataFrame, part: Keys, by: Sequence[Column], back_by: Sequence[Column]) -> DataFrame:
        ahead = Window.partitionBy(*(part or [F.lit(0)])).orderBy(*by)
        behind = Window.partitionBy(*(part or [F.lit(0)])).orderBy(*back_by)
        frame = (Window.unboundedPreceding, Window.currentRow)
        return d.withColumn("_prev", F.last(known, True).over(ahead.rowsBetween(*frame))).withColumn(
            "_next", F.last(known, True).over(behind.rowsBetween(*frame))
        )

    up, down = [F.col("_i").asc()], [F.col("_i").desc()]
    big = oversized_groups(df, keys)
    if big is None:
        indexed = df.withColumn(
            "_i", (F.row_number().over(series_window(keys, order)) - 1).cast("bigint")
        )
        return fill(indexed, keys, up, down)
    small, large = _split(df, keys, big)
    indexed = materialise(_ranged_index(large, keys, [F.col(c) for c in order], "_i", big))
    blocked = indexed.withColumn("_blk", F.floor(F.col("_i") / _blocks(df, 1)))
    part = [*keys, "_blk"]
    # One row per block: its last and first known value, carried over the blocks.
    edge = blocked.groupBy(*part).agg(
        F.max_by(known, F.when(F.col(value).isNotNull(), F.col("_i"))).alias("_last"),
        F.min_by(known, F.when(F.col(value).isNotNull(), F.col("_i"))).alias("_first"),
    )
    over = Window.partitionBy(*(keys or [F.lit(0)]))
    before = (Window.unboundedPreceding, -1)
    edge = edge.select(
        *[F.col(k).alias(f"_k_{k}") for k in part],
        F.last("_last", True).over(over.orderBy(F.col("_blk").asc()).rowsBetween(*before)).alias("_from"),
        F.last("_first", True).over(over.orderBy(F.col("_blk").desc()).rowsBetween(*before)).alias("_to"),
    )
    filled = fill(blocked, part, up, down)
    match = reduce(lambda a, b: a & b, [filled[k].eqNullSafe(edge[f"_k_{k}"]) for k in part])
    large = (
        filled.join(edge, match, "left")
        .withColumn("_prev", F.coalesce("_prev", "_from"))
        .withColumn("_next", F.coalesce("_next", "_to"))
        .drop("_from", "_to", "_blk", *[f"_k_{k}" for k in part])
    )
    if small is None:
        return large
    small = small.withColumn(
        "_i", (F.row_number().over(series_window(keys, order)) - 1).cast("bigint")
    )
    return fill(small, keys, up, down).unionByName(large)


def last_rows(df: DataFrame, keys: Keys, ts: str, n: int, name: str = "_back") -> DataFrame:
    """The last ``n`` rows of every series; ``name`` is 1 for the newest.

    Spark limits each group before the exchange, so a huge series sends only n rows per task.
    """
    newest = F.row_number().over(series_window(keys, [F.col(ts).desc()]))
    return df.withColumn(name, newest).where(F.col(name) <= n)


def running_sums(
    df: DataFrame, keys: Keys, order: Sequence[str | Column], sums: dict[str, Column]
) -> DataFrame:
    """Add totals of each expression from the start of the series up to and including the row."""

    def running(d: DataFrame, part: Keys, by: Sequence[str | Column]) -> DataFrame:
        w = series_window(part, by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return d.withColumns({n: F.sum(c).over(w) for n, c in sums.items()})

    big = oversized_groups(df, keys)
    if big is None:
        return running(df, keys, order)
    small, large = _split(df, keys, big)
    indexed = materialise(_ranged_index(large, keys, order, "_i", big))
    blocked = indexed.withColumn("_blk", F.floor(F.col("_i") / _blocks(df, 1)))
    part = [*keys, "_blk"]
    totals = blocked.groupBy(*part).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = series_window(keys, ["_blk"]).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in part],
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_b_{n}") for n in sums],
    )
    inner = running(blocked, part, ["_i"])
    match = reduce(lambda a, b: a & b, [inner[k].eqNullSafe(totals[f"_k_{k}"]) for k in part])
    large = (
        inner.join(totals, match)
        .withColumns({n: F.coalesce(n, F.lit(0)) + F.col(f"_b_{n}") for n in sums})
        .select(*df.columns, *sums)
    )
    return large if small is None else running(small, keys, order).unionByName(large)


def grouped(
    df: DataFrame,
    keys: Keys,
    aggs: dict[str, Column],
    quantiles: dict[str, tuple[str, float]] | None = None,
) -> DataFrame:
    """One row per group: plain aggregates plus exact linear-interpolated quantiles of columns.

    Ordinary groups use the built-in percentile in the same aggregate. In an oversized group
    the order statistics are looked up by position after a distributed sort.
    """
    quantiles = quantiles or {}
    by_column: dict[str, list[tuple[str, float]]] = {}
    for name, (column, p) in quantiles.items():
        by_column.setdefault(column, []).append((name, float(p)))

    def plain(d: DataFrame) -> DataFrame:
        # One buffer of values for each column, however many quantiles are asked of it.
        at = {c: F.percentile(c, F.array(*[F.lit(p) for _, p in asked])) for c, asked in by_column.items()}
        held = d.groupBy(*keys).agg(
            *[c.alias(n) for n, c in aggs.items()], *[v.alias(f"_q_{i}") for i, v in enumerate(at.values())]
        )
        picks = {n: F.col(f"_q_{i}")[k] for i, asked in enumerate(by_column.values()) for k, (n, _) in enumerate(asked)}
        return held.select(*keys, *aggs, *[picks[n].alias(n) for n in quantiles])

    big = oversized_groups(df, keys) if quantiles else None
    if big is None or not keys and big.first()["_n"] <= group_limit(df):
        return plain(df)
    small, large = _split(df, keys, big)
    if not keys:
        large = materialise(large)
    anchor = [c.alias(n) for n, c in aggs.items()] or [F.count(F.lit(1)).alias("_rows")]
    out = large.groupBy(*keys).agg(*anchor)
    for column, asked in by_column.items():
        # Equal values are counted before they are ordered, so a hot value is one row.
        counts = large.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
        ranked = running_sums(materialise(counts), keys, [column], {"_upto": F.col("_n")})
        ranked = join_params(ranked, counts.groupBy(*keys).agg(F.sum("_n").alias("_all")), keys)
        picks = []
        for name, p in asked:
            at = F.lit(p) * (F.col("_all") - 1)
            holds = lambda i: (F.col("_upto") - F.col("_n") <= i) & (i < F.col("_upto"))
            low = F.max(F.when(holds(F.floor(at)), F.col(column)))
            high = F.max(F.when(holds(F.ceil(at)), F.col(column)))
            picks.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
        found = ranked.groupBy(*keys).agg(*picks)
        out = join_params(out, found, keys) if keys else out.crossJoin(F.broadcast(found))  # one row each
    names = [*keys, *aggs, *quantiles]
    out = out.select(*names)
    return out if small is None else plain(small).select(*names).unionByName(out)


def join_params(df: DataFrame, params: DataFrame, keys: Keys) -> DataFrame:
    """Attach per-series parameters to every row.

    No broadcast hint: Spark broadcasts a table below its size limit, and its adaptive skew join
    splits a hot series otherwise. The null-safe match keeps rows whose key is null, and leaves
    both sides without an inferred not-null filter, so a shared upstream exchange is reused.
    """
    if not keys:
        return df.join(F.broadcast(params))  # one row: an aggregate without keys
    tagged = params.select(*[F.col(c).alias(f"_k_{c}" if c in keys else c) for c in params.columns])
    match = reduce(lambda a, b: a & b, [df[k].eqNullSafe(tagged[f"_k_{k}"]) for k in keys])
    return df.join(tagged, match, "left").drop(*[f"_k_{k}" for k in keys])
