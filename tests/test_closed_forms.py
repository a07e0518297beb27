"""Hand-computed values and library-free reference computations on small fixtures."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regimecast.functions import scalars, tails, vectors
from regimecast.operators import (
    clean,
    cluster_quality,
    ensemble,
    features,
    intervals,
    metrics,
    quality,
    regimes,
    significance,
    summary,
)


def one(df):
    return df.collect()[0]


@pytest.mark.parametrize("as_array", [True, False])
def test_entropies_of_known_distributions(spark, as_array):
    df = spark.createDataFrame([([0.5, 0.5],), ([1.0, 0.0],)], "p array<double>")
    p = "p" if as_array else vectors.elements("p", 2)
    out = df.select(*[c.alias(n) for n, c in vectors.compare_entropies(p).items()]).collect()
    for name in vectors.COMPARED:
        assert out[0][name] == pytest.approx(0.5 if name == "gini_simpson" else 1.0, abs=1e-6)
        # A certain row is near 0; order 1/2 feels the smoothing most.
        assert abs(out[1][name]) < 2e-4


def test_renyi_and_tsallis_without_scaling(spark):
    df = spark.createDataFrame([([0.7, 0.2, 0.1],)], "p array<double>")
    p = np.array([0.7, 0.2, 0.1])
    row = one(df.select(vectors.renyi("p", 2.0).alias("r"), vectors.tsallis("p", 3.0).alias("t"), vectors.shannon("p", base=math.e).alias("s")))
    assert row["r"] == pytest.approx(-math.log2((p**2).sum()), abs=1e-6)
    assert row["t"] == pytest.approx((1 - (p**3).sum()) / 2, abs=1e-6)
    assert row["s"] == pytest.approx(-(p * np.log(p)).sum(), abs=1e-6)
    with pytest.raises(ValueError):
        vectors.entropy("p", "unknown")


def test_memberships_follow_the_ratio_formula(spark):
    rng = np.random.default_rng(7)
    points, centres = rng.random((20, 3)), rng.random((4, 3))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "i int, x array<double>")
    for m in (1.5, 2.0, 3.0):
        got = {r["i"]: r["u"] for r in regimes.assign_soft(df, "x", centres.tolist(), m).collect()}
        d = np.linalg.norm(points[:, None] - centres[None], axis=2)
        want = 1 / ((d[:, :, None] / d[:, None, :]) ** (2 / (m - 1))).sum(axis=2)
        for i in got:
            assert got[i] == pytest.approx(want[i], abs=1e-12)


def test_point_on_a_centre_belongs_to_the_first_such_centre(spark):
    df = spark.createDataFrame([([0.3],)], "x array<double>")
    u = one(regimes.assign_soft(df, "x", [[0.1], [0.3], [0.3]]))["u"]
    assert u == [0.0, 1.0, 0.0]


def test_label_out_of_range_raises(spark):
    df = spark.createDataFrame([(5, [0.5, 0.5])], "k int, u array<double>")
    with pytest.raises(Exception, match="out of range"):
        regimes.tif(df, "k", "u", 2).collect()


def test_match_centres_is_optimal():
    rng = np.random.default_rng(3)
    for k in (1, 2, 3, 4, 5, 6):
        for _ in range(5):
            a, b = rng.random((k, 2)), rng.random((k, 2))
            cost = ((a[:, None] - b[None]) ** 2).sum(axis=2)
            best = min(sum(cost[i, p[i]] for i in range(k)) for p in itertools.permutations(range(k)))
            found = regimes.match_centres(a.tolist(), b.tolist())
            assert sorted(found) == list(range(k))
            assert sum(cost[i, j] for i, j in enumerate(found)) == pytest.approx(best)


def test_interpolation_matches_pandas(spark):
    values = [None, 1.0, None, None, 4.0, None, 7.0, None, None]
    df = spark.createDataFrame(list(enumerate(values)), "i int, y double")
    s = pd.Series(values, dtype=float)
    wanted = {
        "linear": s.interpolate().ffill().bfill(),
        "forward_fill": s.ffill().bfill(),
        "backward_fill": s.bfill().ffill(),
        "mean": s.fillna(s.mean()),
    }
    for method, want in wanted.items():
        got = [r["y"] for r in clean.fill(df, [], ["i"], "y", method).orderBy("i").collect()]
        assert got == pytest.approx(want.tolist()), method


def test_outliers_of_a_constant_series_are_left_alone(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(5)], "i int, y double")
    out = clean.repair_outliers(df, [], ["i"], "y")
    assert {r["y"] for r in out.collect()} == {5.0}


def test_islands(spark):
    flags = [0, 1, 1, 0, 1, 0, 0, 1, 1, 1]
    df = spark.createDataFrame(list(enumerate(flags)), "i int, f int")
    out = features.islands(df, [], ["i"], F.col("f") == 1).orderBy("region_start").collect()
    assert [(r["region_start"], r["region_end"], r["length"]) for r in out] == [(1, 2, 2), (4, 4, 1), (7, 9, 3)]


def test_histogram_matches_numpy_and_widens_a_constant(spark):
    rng = np.random.default_rng(1)
    values = rng.random(200)
    df = spark.createDataFrame([(float(v),) for v in values], "y double")
    got = summary.histogram(df, [], "y").orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=10)
    assert [r["count"] for r in got] == counts.tolist()
    assert [r["left_edge"] for r in got] == pytest.approx(edges[:-1].tolist())
    flat = spark.createDataFrame([(3.0,)] * 4, "y double")
    got = summary.histogram(flat, [], "y").orderBy("bin").collect()
    assert [r["count"] for r in got] == np.histogram([3.0] * 4, bins=10)[0].tolist()


def test_last_bin_takes_the_remainder(spark):
    df = spark.createDataFrame([(i,) for i in range(27)], "i int")
    out = features.equal_count_bins(df, [], ["i"]).groupBy("bin").count().orderBy("bin").collect()
    assert [r["count"] for r in out] == [2] * 9 + [9]
    few = features.equal_count_bins(df.where("i < 4"), [], ["i"])
    assert {r["bin"] for r in few.collect()} == {9}


def test_point_metrics_zero_rules(spark):
    df = spark.createDataFrame([("flat", 0.0, 0.0), ("flat", 0.0, 0.0), ("off", 0.0, 1.0), ("off", 0.0, 1.0)], "k string, y double, yhat double")
    got = {r["k"]: r.asDict() for r in metrics.point(df, ["k"]).collect()}
    assert got["flat"]["r2"] == 1.0 and got["flat"]["nrmse"] == 0.0 and got["flat"]["cv_rmse"] == 0.0
    assert got["off"]["r2"] == 0.0 and math.isinf(got["off"]["nrmse"]) and math.isinf(got["off"]["cv_rmse"])
    assert math.isinf(got["flat"]["mape"]) and got["flat"]["smape"] == 0.0


def test_interval_metrics_by_hand(spark):
    df = spark.createDataFrame([(0.0, -1.0, 1.0), (10.0, 11.0, 13.0)], "y double, lower double, upper double")
    light = one(metrics.interval(df, []))
    assert light["picp"] == 0.5 and light["pinaw"] == pytest.approx(0.2)
    assert light["cwc"] == pytest.approx(0.2 + 50 * 0.45) and light["ace"] == pytest.approx(0.45)
    assert light["interval_score"] == pytest.approx(2 + 0.1 * 1 / 2)
    standard = one(metrics.interval(df, [], cwc="exponential", score="standard"))
    assert standard["interval_score"] == pytest.approx(2 + 40 * 1 / 2)
    assert standard["cwc"] == pytest.approx(0.2 * (1 + 0.1 * math.exp(-0.1 * (0.5 - 0.95))))


def test_corrections_by_hand(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "t string, p_value double")

    def corrected(**kw):
        return {r["t"]: r["corrected_p"] for r in significance.correct_p_values(df, [], **kw).collect()}

    assert corrected(method="bonferroni") == pytest.approx({"a": 0.03, "b": 0.12, "c": 0.09})
    assert corrected(method="holm") == pytest.approx({"a": 0.03, "b": 0.04, "c": 0.06})
    assert corrected(method="holm", monotone=True) == pytest.approx({"a": 0.03, "b": 0.06, "c": 0.06})
    assert corrected(method="fdr_bh") == pytest.approx({"a": 0.03, "b": 0.04, "c": 0.045})
    assert corrected(method="fdr_bh", monotone=True) == pytest.approx({"a": 0.03, "b": 0.04, "c": 0.04})


def test_friedman_by_hand(spark):
    # Ranks per row: (1,2,3), (1,2,3), (1.5,1.5,3).
    rows = [(i, m, 0.0, e) for i, errs in enumerate([(1, 2, 3), (1, 2, 3), (1, 1, 3)]) for m, e in zip("abc", map(float, errs))]
    df = spark.createDataFrame(rows, "i int, model string, y double, yhat double")
    got = one(significance.friedman(df, [], ["i"], ["a", "b", "c"]))
    ranks = np.array([3.5, 5.5, 9.0])
    raw = 12 / (3 * 3 * 4) * (ranks**2).sum() - 3 * 3 * 4
    want = raw / (1 - 6 / (3 * 3 * 8))
    assert got["statistic"] == pytest.approx(want) and got["p_value"] == pytest.approx(math.exp(-want / 2))
    means = {r["model"]: r["mean_rank"] for r in significance.friedman_ranks(df, [], ["i"]).collect()}
    assert means == pytest.approx({"a": 3.5 / 3, "b": 5.5 / 3, "c": 3.0})
    with pytest.raises(ValueError):
        significance.friedman(df, [], ["i"], ["a", "b"])


def test_wilcoxon_by_hand(spark):
    # |e1| - |e2| = 1, -2, 3, 3, 0: ranks 1, 2, 3.5, 3.5.
    df = spark.createDataFrame([(2.0, 1.0), (1.0, 3.0), (-4.0, 1.0), (3.0, 0.0), (1.0, -1.0)], "e1 double, e2 double")
    got = one(significance.wilcoxon(df, []))
    assert (got["n"], got["statistic"]) == (4, 2.0)
    z = (2 - 5) / math.sqrt(4 * 5 * 9 / 24 - 6 / 48)
    assert got["z"] == pytest.approx(z) and got["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_tail_probabilities():
    # Well-known critical values.
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert tails.normal_quantile(0.95) == pytest.approx(1.959963984540054)
    assert tails.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.t_two_sided(12.706204736432095, 1) == pytest.approx(0.05, abs=1e-9)
    assert tails.t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert tails.odd_chi2_upper(7.814727903251179, 3) == pytest.approx(0.05, abs=1e-9)
    assert tails.odd_chi2_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)


def test_chi2_columns(spark):
    df = spark.createDataFrame([(18.307038053275146, 7.814727903251179)], "a double, b double")
    row = one(df.select(tails.chi2_p_value(F.col("a"), 10).alias("a"), tails.chi2_p_value(F.col("b"), 3).alias("b")))
    assert row["a"] == pytest.approx(0.05, abs=1e-9) and row["b"] == pytest.approx(0.05, abs=1e-9)


def test_elbow():
    assert cluster_quality.elbow([-100.0, -40.0, -35.0, -32.0]) == 1
    assert cluster_quality.elbow([1.0, 2.0]) == 0


def test_univariate_silhouette_matches_all_pairs(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.random(60), 2)
    k = rng.integers(0, 3, 60)
    k[0] = 3  # a cluster of one
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, k)], "v double, k int")
    dist = np.abs(x[:, None] - x[None])
    scores = []
    for i in range(60):
        own = (k == k[i]).sum()
        if own == 1:
            scores.append(0.0)
            continue
        a = dist[i][k == k[i]].sum() / (own - 1)
        b = min(dist[i][k == c].mean() for c in set(k) - {k[i]})
        scores.append((b - a) / max(a, b))
    got = one(cluster_quality.silhouette_univariate(df, "v", "k", 4))["silhouette"]
    assert got == pytest.approx(np.mean(scores))


def test_transfer_curve(spark):
    df = spark.createDataFrame([(2.0,), (3.0,), (7.5,), (12.0,), (24.9,), (25.0,)], "s double")
    got = [r[0] for r in df.select(scalars.transfer_curve("s")).collect()]
    assert got == [0.0, 0.0, 0.5, 1.0, 1.0, 0.0]


def test_weighted_ensemble_falls_back_to_the_average(spark):
    df = spark.createDataFrame([(1, "a", 0.0, 2.0, 1.0), (1, "b", 0.0, 4.0, 3.0)], "i int, model string, y double, yhat double, sigma double")
    weights = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "model string, weight double")
    assert one(ensemble.weighted(df, ["i"], weights))["yhat"] == 3.0
    weights = spark.createDataFrame([("a", 3.0)], "model string, weight double")
    got = one(ensemble.weighted(df, ["i"], weights))
    assert got["yhat"] == pytest.approx(2.5) and got["sigma"] == pytest.approx(math.sqrt(0.75 * 1 + 0.25 * 9))


def test_validation_report_of_a_bad_series(spark):
    df = spark.createDataFrame([("a", f"2024-01-01 0{h}:00:00", -5.0) for h in (0, 1, 1)], "k string, t string, y double")
    df = df.withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = one(quality.report(df, ["k"], "t", "y"))
    assert got["is_valid"] is False
    assert got["errors"] == ["too_few_rows", "constant_values", "duplicate_timestamps"]
    assert got["warnings"] == ["negative_values", "irregular_steps", "high_variation"]


def test_feature_table_counts_bad_rows(spark):
    df = spark.createDataFrame([(1.0, [1.0]), (float("nan"), [1.0]), (None, [2.0]), (2.0, [float("inf")])], "a double, x array<double>")
    got = one(quality.feature_table(df, ["a", "x"]))
    assert (got["total_rows"], got["null_rows"], got["nan_rows"], got["infinite_rows"]) == (4, 1, 1, 1)


def test_wider_levels_nest(spark, views):
    rows = intervals.multi_level(views.interval_inputs)
    width = rows.groupBy("event_type", "ts").agg(
        *[F.max(F.when(F.col("level") == v, F.col("upper") - F.col("lower"))).alias(n) for n, v in (("a", 0.8), ("b", 0.9), ("c", 0.95))]
    )
    assert width.where("NOT (a <= b AND b <= c)").count() == 0


def test_bootstrap_bounds_surround_the_prediction(views):
    params = intervals.fit_residual_spread(views.interval_inputs, ["event_type"])
    out = intervals.bootstrap(views.interval_inputs, ["event_type"], ["event_type", "ts"], params)
    joined = out.join(params, "event_type").select(((F.col("upper") - F.col("lower")) / F.col("residual_std")).alias("w"))
    row = one(joined.agg(F.avg("w").alias("w"), F.min("w").alias("lo")))
    assert row["lo"] > 0 and row["w"] == pytest.approx(2 * 1.96, rel=0.15)


def test_student_tail_column_is_the_incomplete_beta(spark):
    cases = [(t, n) for t in (0.0, 0.3, -1.7, 2.5, 9.0) for n in (1, 2, 3, 4, 5, 10, 11, 60, 719, 19_999, 20_000, 500_001)]
    df = spark.createDataFrame([(t, float(n)) for t, n in cases] + [(float("nan"), 4.0), (1.0, 0.0)], "t double, n double")
    got = {(r["t"], r["n"]): r["p"] for r in df.select("t", "n", tails.t_p_value("t", "n").alias("p")).collect()}
    for t, n in cases:
        assert got[t, float(n)] == pytest.approx(tails.t_two_sided(t, n), abs=2e-9)
    assert got[1.0, 0.0] is None and sum(p is None for p in got.values()) == 2


def test_linear_quantiles_are_the_best_lines(spark):
    """Against all lines through pairs of points, one of which is a linear quantile."""
    from regimecast.operators import intervals

    rng = np.random.default_rng(3)
    x = rng.uniform(0, 4, 60)
    e = 1 + 0.5 * x + rng.normal(0, 0.3 + 0.3 * x)
    df = spark.createDataFrame([(float(a), float(b), 0.0) for a, b in zip(x, e)] + [(None, 1.0, 0.0)], "x double, y double, yhat double")
    fits = intervals.linear_quantiles(df, ["x"], level=0.8)

    def loss(a, b, tau):
        r = e - a - b * x
        return np.maximum(tau * r, (tau - 1) * r).sum()

    lines = [((e[i] * x[j] - e[j] * x[i]) / (x[j] - x[i]), (e[j] - e[i]) / (x[j] - x[i])) for i in range(60) for j in range(i)]
    for (a, b), tau in zip(fits, (0.1, 0.9)):
        assert loss(a, b, tau) == pytest.approx(min(loss(*line, tau) for line in lines), rel=1e-4)
    with pytest.raises(ValueError):
        intervals.linear_quantiles(df, ["x"], max_passes=2)
