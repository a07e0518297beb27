"""Groups too large for one task must give the same rows as ordinary ones."""

import pytest
from pyspark.sql import functions as F

from regimecast.operators import clean, cluster_quality, features, metrics, quality, significance, summary
from regimecast.operators import ordering
from regimecast.sources.views import Views
from tests.conftest import SMALL, rows

TYPE, TS = ["event_type"], ["ts"]


def by_ts():
    return [F.col("ts")]


CASES = {
    "row_index": lambda v: ordering.row_index(v.hourly_type, TYPE, by_ts()),
    "row_index_no_key": lambda v: ordering.row_index(v.hourly_all, [], by_ts()),
    "row_index_descending": lambda v: ordering.row_index(v.hourly_type, TYPE, [F.col("ts").desc()]),
    "lags": lambda v: features.add_lags(v.hourly_type, TYPE, TS, "y", [1, 5, 24]),
    "lags_no_key": lambda v: features.add_lags(v.hourly_all, [], TS, "y", [1, 2, 24]),
    "rolling": lambda v: features.add_rolling(v.hourly_type, TYPE, TS, "y", [4, 24]),
    "long_reach": lambda v: features.add_lags(v.hourly_type, TYPE, TS, "y", [48]),
    "lead": lambda v: ordering.over_series(
        v.hourly_type, TYPE, by_ts(), lambda w: {"n": F.lead("y", 3).over(w), "p": F.lag("y", 2).over(w)}, 2, 3
    ),
    "matrix": lambda v: features.sliding_matrix(v.hourly_type, TYPE, TS, "y", 6),
    "moving": lambda v: features.moving(v.hourly_type, TYPE, TS, "y", 10, F.avg, "m"),
    "fill_linear": lambda v: clean.fill(v.hourly_gappy, TYPE, TS, "y"),
    "fill_forward": lambda v: clean.fill(v.hourly_gappy, TYPE, TS, "y", "forward_fill"),
    "fill_backward": lambda v: clean.fill(v.hourly_gappy, TYPE, TS, "y", "backward_fill"),
    "fill_long_gap": lambda v: clean.fill(
        v.hourly_all.withColumn("y", F.when(F.dayofmonth("ts").isin(3, 4, 5, 20), F.col("y"))), [], TS, "y"
    ),
    "islands": lambda v: features.islands(v.hourly_type, TYPE, TS, F.col("y") > 60),
    "bins": lambda v: features.equal_count_bins(v.hourly_type, TYPE, ["y", "ts"]),
    "split": lambda v: features.chronological_split(v.hourly_type, TYPE, TS),
    "ladder": lambda v: features.size_ladder(v.hourly_all, [], TS, (10, 90, 500)),
    "describe": lambda v: summary.describe(v.hourly_gappy, TYPE, "y"),
    "describe_no_key": lambda v: summary.describe(v.hourly_all, [], "y"),
    "quality": lambda v: quality.value_quality(v.hourly_gappy, TYPE, "y"),
    "temporal": lambda v: quality.temporal(v.hourly_dirty.where("copy = 1"), TYPE, "ts"),
    "running": lambda v: ordering.running_sums(
        v.hourly_type, TYPE, by_ts(), {"s": F.col("y"), "n": F.when(F.col("y") > 50, 1)}
    ).withColumn("n", F.coalesce("n", F.lit(0))),
    "silhouette": lambda v: cluster_quality.silhouette_univariate(
        v.hourly_all.withColumn("k", (F.col("y") > 150).cast("int")), "y", "k", 2
    ),
    "directions": lambda v: metrics.directional_accuracy(v.pred_pairs, ["event_type", "model"], TS),
    "error_quantiles": lambda v: metrics.error_quantiles(v.pred_pairs, ["event_type", "model"]),
    "calibration": lambda v: metrics.calibration(v.pred_pairs, ["event_type", "model"], TS),
    "wilcoxon": lambda v: significance.wilcoxon(
        significance.paired_errors(v.pred_pairs, ["event_type", "ts"], "lag1", "mean24"), TYPE, p_values=False
    ),
    "diebold_mariano": lambda v: significance.diebold_mariano(
        significance.paired_errors(v.pred_pairs, ["event_type", "ts"], "lag1", "mean24"), TYPE, TS, 3, p_values=False
    ),
}


@pytest.fixture(scope="module")
def plain(spark):
    return {name: rows(build(Views(spark, SMALL)), 8) for name, build in CASES.items()}


@pytest.mark.parametrize("name", CASES)
def test_same_rows(spark, plain, tiny_groups, name):
    got = rows(CASES[name](Views(spark, SMALL)), 8)
    assert got and got == plain[name]


def test_oversized_groups_are_found(views, tiny_groups):
    big = ordering.oversized_groups(views.hourly_type, TYPE)
    sizes = {r["event_type"]: r["_n"] for r in big.collect()}
    want = {r["event_type"]: r["count"] for r in views.hourly_type.groupBy("event_type").count().collect()}
    assert sizes == {k: n for k, n in want.items() if n > 40}


def test_mixed_sizes_keep_every_row(spark, tiny_groups):
    """One group holds a third of all rows, one key is null, the others are small."""
    data = [("hot", i, float(i % 7)) for i in range(120)]
    data += [(None, i, float(i)) for i in range(60)]
    data += [(f"k{j}", i, float(i)) for j in range(18) for i in range(10)]
    df = spark.createDataFrame(data, "k string, i int, y double").repartition(7)
    out = ordering.over_series(df, ["k"], [F.col("i")], lambda w: {"p": F.lag("y", 3).over(w)}, 3)
    got = {(r["k"], r["i"]): r["p"] for r in out.collect()}
    value = {(k, i): y for k, i, y in data}
    assert got == {(k, i): value.get((k, i - 3)) for k, i, _ in data}


def test_no_single_task_for_the_big_group(spark, tiny_groups):
    df = spark.range(400).selectExpr("'a' as k", "id as i", "double(id) as y")
    out = ordering.over_series(df, ["k"], [F.col("i")], lambda w: {"p": F.lag("y", 3).over(w)}, 3)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        per_task = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("t")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(per_task) == 400 and max(per_task) < 300


def test_quantile_of_many_ties(spark, tiny_groups):
    df = spark.range(1000).selectExpr("'a' as k", "double(id % 3) as y")
    wanted = {"low": ("y", 0.3), "mid": ("y", 0.5), "high": ("y", 0.9)}
    out = ordering.grouped(df, ["k"], {"n": F.count("y")}, wanted).first()
    assert (out["n"], out["low"], out["mid"], out["high"]) == (1000, 0.0, 1.0, 2.0)


def largest_task(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id().alias("t")).count().collect())


def test_default_limit_holds_for_well_packed_rows(spark):
    """Six million rows of one key take a few megabytes as files, and still are not one task."""
    df = spark.range(6_000_000).selectExpr("'a' as k", "id as i", "double(id % 7) as y")
    out = ordering.over_series(df, ["k"], [F.col("i")], lambda w: {"p": F.lag("y", 3).over(w)}, 3)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert largest_task(out) < ordering.group_limit(df)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert out.where("p is null").count() == 3


def test_a_chain_of_operators_counts_once(spark, views):
    frame = views.hourly_gappy.where("y is null or y >= 0")
    before = set(ordering._DECIDED)
    quality.report(frame, TYPE, "ts", "y")
    assert len(set(ordering._DECIDED) - before) <= 1
    lag = lambda n: lambda w: {f"p{n}": F.lag("y", n).over(w)}
    once = ordering.over_series(frame, TYPE, by_ts(), lag(1), 1)
    ordering.over_series(once, TYPE, by_ts(), lag(4), 4)
    assert len(set(ordering._DECIDED) - before) <= 1


def test_hot_sort_value_is_spread(spark, tiny_groups):
    """Four fifths of a series share one sort value; no range takes them all."""
    df = spark.range(2000).selectExpr("'a' as k", "if(id % 5 = 0, double(id), 0.0) as y", "id")
    big = ordering.oversized_groups(df, ["k"])
    placed = ordering._ranged_index(df, ["k"], [F.col("y")], "_i", big)
    assert largest_task(placed) < 200
    assert sorted(r["_i"] for r in placed.select("_i").collect()) == list(range(2000))


def test_null_series_keeps_its_scale(spark):
    from regimecast.operators.preprocess import SeriesPreprocessor

    data = [(k, i, float(i + n)) for n, k in ((0, None), (5, "a")) for i in range(5)]
    df = spark.createDataFrame(data, "k string, i int, y double")
    out = SeriesPreprocessor(["k"], ["i"], "y").fit(df).transform(df).collect()
    assert sorted((r["i"], r["y_norm"]) for r in out if r["k"] is None) == [(i, i / 4) for i in range(5)]
    assert len(out) == 10
