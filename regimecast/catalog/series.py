"""Cleaning, validation, aggregates, windows, joins, splits over the hourly series."""

from __future__ import annotations

from pyspark.sql import functions as F

from regimecast.catalog.registry import define_view, query, rounded
from regimecast.operators import clean, features, normalise, quality, summary
from regimecast.operators.ordering import join_params
from regimecast.operators.preprocess import SeriesPreprocessor

TYPE = ["event_type"]


def _r(name: str, digits: int = 6):
    return rounded(name, digits).alias(name)


# --- cleaning ---------------------------------------------------------------------------

KNOWN = """SELECT event_type, ts, y, i,
        last_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi,
        last_value(y IGNORE NULLS) OVER b AS pv,
        first_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ni,
        first_value(y IGNORE NULLS) OVER a AS nv
    FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS i FROM {source})
    WINDOW b AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           a AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""
LINEAR = """SELECT event_type, ts, CASE WHEN ni > pi THEN pv + (nv - pv) * ((i - pi)::DOUBLE / (ni - pi))
    ELSE coalesce(pv, nv) END AS y FROM {source}"""
define_view("gappy_known", KNOWN.format(source="hourly_gappy"))
define_view("gappy_linear", LINEAR.format(source="gappy_known"))
define_view("linear_params", "SELECT event_type, avg(y) AS mu, stddev_pop(y) AS sd FROM gappy_linear GROUP BY 1")
define_view(
    "nulled_linear",
    """SELECT event_type, ts, CASE WHEN abs((y - mu) / sd) > 2.5 THEN NULL ELSE y END AS y
       FROM gappy_linear JOIN linear_params USING (event_type)""",
)
define_view("nulled_known", KNOWN.format(source="nulled_linear"))
define_view("nulled_repaired", LINEAR.format(source="nulled_known"))


def _filled(v, method):
    return clean.fill(v.hourly_gappy, TYPE, ["ts"], "y", method).select("event_type", "ts", _r("y"))


@query("cln1_linear_fill", "SELECT event_type, ts, round(y, 6) AS y FROM gappy_linear")
def _(v):
    return _filled(v, "linear")


@query("cln2_forward_fill", "SELECT event_type, ts, round(coalesce(pv, nv), 6) AS y FROM gappy_known")
def _(v):
    return _filled(v, "forward_fill")


@query("cln3_backward_fill", "SELECT event_type, ts, round(coalesce(nv, pv), 6) AS y FROM gappy_known")
def _(v):
    return _filled(v, "backward_fill")


@query(
    "cln4_mean_fill",
    """SELECT event_type, ts, round(coalesce(y, avg(y) OVER (PARTITION BY event_type)), 6) AS y
       FROM hourly_gappy""",
)
def _(v):
    return _filled(v, "mean")


@query("cln5_outlier_repair", "SELECT event_type, ts, round(y, 6) AS y FROM nulled_repaired")
def _(v):
    filled = clean.fill(v.hourly_gappy, TYPE, ["ts"], "y")
    return clean.repair_outliers(filled, TYPE, ["ts"], "y", 2.5).select("event_type", "ts", _r("y"))


@query(
    "cln6_preprocess",
    """SELECT event_type, ts, round(y, 6) AS y, round((y - lo) / (hi - lo), 6) AS y_norm FROM nulled_repaired
       JOIN (SELECT event_type, min(y) AS lo, max(y) AS hi FROM nulled_repaired GROUP BY 1) USING (event_type)""",
)
def _(v):
    stage = SeriesPreprocessor(TYPE, ["ts"], "y", outlier_z=2.5)
    return stage.fit(v.hourly_gappy).transform(v.hourly_gappy).select(
        "event_type", "ts", _r("y"), _r("y_norm")
    )


@query(
    "cln6_preprocess_null_series",
    """SELECT nullif(event_type, 'view') AS event_type, ts, round(y, 6) AS y, round((y - lo) / (hi - lo), 6) AS y_norm
       FROM nulled_repaired
       JOIN (SELECT event_type, min(y) AS lo, max(y) AS hi FROM nulled_repaired GROUP BY 1) USING (event_type)""",
)
def _(v):
    """A series whose key is null keeps its parameters."""
    rows = v.hourly_gappy.withColumn("event_type", F.nullif("event_type", F.lit("view")))
    stage = SeriesPreprocessor(TYPE, ["ts"], "y", outlier_z=2.5)
    return stage.fit(rows).transform(rows).select("event_type", "ts", _r("y"), _r("y_norm"))


# --- validation -------------------------------------------------------------------------


@query(
    "val1_structure",
    """SELECT 'amount' AS column_name, true AS present,
            count(*) FILTER (amount IS NOT NULL AND TRY_CAST(amount AS DOUBLE) IS NULL) AS uncastable,
            count(*) FILTER (amount IS NOT NULL AND TRY_CAST(amount AS DOUBLE) IS NULL) = 0 AS valid FROM raw_strings
       UNION ALL SELECT 'd3', true, count(*) FILTER (d3 IS NOT NULL AND TRY_CAST(d3 AS TIMESTAMP) IS NULL), true FROM raw_strings
       UNION ALL SELECT 'energy_generation', false, NULL, false""",
)
def _(v):
    required = {"amount": "double", "d3": "timestamp", "energy_generation": "double"}
    return quality.check_structure(v.raw_strings, required)


@query(
    "val2_completeness",
    """SELECT event_type, n AS total_rows, m AS missing, round(m / n, 6) AS missing_ratio, n >= 100 AND m / n <= 0.1 AS valid
       FROM (SELECT event_type, count(*) AS n, count(*) FILTER (y IS NULL) AS m FROM hourly_gappy GROUP BY 1)""",
)
def _(v):
    out = quality.completeness(v.hourly_gappy, TYPE, "y")
    return out.withColumn("missing_ratio", rounded("missing_ratio"))


VALUE_QUALITY = """SELECT event_type, round(avg((y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1))::INTEGER), 6) AS outlier_ratio,
        count(*) FILTER (y < 0) AS negatives, min(y) = max(y) AS constant
    FROM {source} JOIN (SELECT event_type, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3
        FROM {source} GROUP BY 1) USING (event_type) WHERE y IS NOT NULL GROUP BY 1"""
define_view("gappy_quality", VALUE_QUALITY.format(source="hourly_gappy"))
define_view("dirty_quality", VALUE_QUALITY.format(source="hourly_dirty"))


@query(
    "val3_value_quality",
    "SELECT *, outlier_ratio > 0.05 AS many_outliers, NOT constant AS valid FROM gappy_quality",
)
def _(v):
    out = quality.value_quality(v.hourly_gappy, TYPE, "y")
    return out.withColumn("outlier_ratio", rounded("outlier_ratio"))


define_view(
    "dirty_temporal",
    """SELECT event_type, count(*) FILTER (dt < 0) AS descending, avg((dt = 3600000000)::INTEGER) AS regular_ratio,
        (SELECT sum(c - 1)::BIGINT FROM (SELECT d.event_type AS k, count(*) AS c FROM hourly_dirty d GROUP BY d.event_type, d.ts)
         WHERE k = s.event_type) AS duplicates
       FROM (SELECT event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, copy) AS dt
             FROM hourly_dirty) s GROUP BY event_type""",
)


@query(
    "val4_temporal",
    """SELECT event_type, descending, round(regular_ratio, 6) AS regular_ratio, duplicates,
        regular_ratio < 0.9 AS irregular, descending = 0 AND duplicates = 0 AS valid FROM dirty_temporal""",
)
def _(v):
    out = quality.temporal(v.hourly_dirty, TYPE, "ts")
    return out.withColumn("regular_ratio", rounded("regular_ratio"))


@query(
    "val4_ingest_order",
    """SELECT event_type, count(*) FILTER (dt < 0) AS descending, round(avg((dt = 3600000000)::INTEGER), 6) AS regular_ratio,
        0::BIGINT AS duplicates, true AS irregular, count(*) FILTER (dt < 0) = 0 AS valid
       FROM (SELECT event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY event_id) AS dt FROM events)
       GROUP BY 1""",
)
def _(v):
    out = quality.temporal(v.table("events"), TYPE, "ts", ingest_order="event_id")
    return out.withColumn("regular_ratio", rounded("regular_ratio"))


RANGES = """SELECT event_type, count(*) FILTER (y > {top}) AS large_values,
        CASE WHEN avg(y) > 0 THEN stddev_pop(y) / avg(y) END AS variation FROM {source} GROUP BY 1"""
define_view("dirty_ranges", RANGES.format(top=10000, source="hourly_dirty"))


@query(
    "val5_value_ranges",
    """SELECT event_type, large_values, round(variation, 6) AS variation, variation IS NULL OR variation > 0.5 AS noisy
       FROM (""" + RANGES.format(top=500, source="hourly_gappy") + ")",
)
def _(v):
    out = quality.value_ranges(v.hourly_gappy, TYPE, "y", max_value=500.0, max_variation=0.5)
    return out.withColumn("variation", rounded("variation"))


@query(
    "val6_report",
    """SELECT event_type, (n >= 100 AND m / n <= 0.1 AND NOT constant AND descending = 0 AND duplicates = 0) AS is_valid,
        array_to_string(list_filter([CASE WHEN n < 100 THEN 'too_few_rows' END, CASE WHEN m / n > 0.1 THEN 'too_many_missing' END,
            CASE WHEN constant THEN 'constant_values' END, CASE WHEN descending > 0 THEN 'not_ascending' END,
            CASE WHEN duplicates > 0 THEN 'duplicate_timestamps' END], lambda e: e IS NOT NULL), ',') AS errors,
        array_to_string(list_filter([CASE WHEN m > 0 AND m / n <= 0.1 THEN 'some_missing' END,
            CASE WHEN outlier_ratio > 0.05 THEN 'many_outliers' END, CASE WHEN negatives > 0 THEN 'negative_values' END,
            CASE WHEN regular_ratio < 0.9 THEN 'irregular_steps' END, CASE WHEN large_values > 0 THEN 'large_values' END,
            CASE WHEN variation IS NULL OR variation > 2 THEN 'high_variation' END], lambda e: e IS NOT NULL), ',') AS warnings,
        n AS total_rows, m AS missing, 0::BIGINT AS unreadable, round(mean, 6) AS mean, round(std, 6) AS std, minimum, maximum
       FROM (SELECT event_type, count(*) AS n, count(*) FILTER (y IS NULL) AS m, avg(y) AS mean, stddev_pop(y) AS std,
            min(y) AS minimum, max(y) AS maximum FROM hourly_dirty GROUP BY 1)
       JOIN dirty_quality USING (event_type) JOIN dirty_temporal USING (event_type) JOIN dirty_ranges USING (event_type)""",
)
def _(v):
    out = quality.report(v.hourly_dirty, TYPE, "ts", "y")
    joined = {c: F.array_join(c, ",") for c in ("errors", "warnings")}
    return out.withColumns(joined | {c: rounded(c) for c in ("mean", "std")})


@query(
    "val6_report_text",
    """SELECT event_type, false AS is_valid, n > 0 AS found, n AS unreadable FROM (
        SELECT event_type, count(*) FILTER (epoch_ms(ts) // 3600000 % 13 = 0) AS n FROM hourly_type GROUP BY 1)""",
)
def _(v):
    """A text column whose every thirteenth hour is no number: an error of structure."""
    broken = F.when(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) % 13 == 0, "n/a")
    rows = v.hourly_type.withColumn("y", F.coalesce(broken, F.col("y").cast("string")))
    out = quality.report(rows, TYPE, "ts", "y")
    return out.select(
        "event_type", "is_valid", F.array_contains("errors", "unreadable_values").alias("found"), "unreadable"
    )


@query(
    "val7_forecast_inputs",
    """SELECT event_type, n AS total_rows, m AS missing, 0::BIGINT AS infinite, n >= 180 AS horizon_fits, m = 0 AND n >= 180 AS valid
       FROM (SELECT event_type, count(*) AS n, count(*) FILTER (y IS NULL) AS m FROM hourly_gappy GROUP BY 1)""",
)
def _(v):
    return quality.forecast_inputs(v.hourly_gappy, TYPE, "y", horizon=180)


@query(
    "val8_forecast_outputs",
    """SELECT event_type, model, 0::BIGINT AS missing, 0::BIGINT AS infinite, count(*) FILTER (yhat < 0) AS negative,
        count(*) FILTER (lower > upper) AS crossed, count(*) FILTER (lower < 0 OR upper < 0) AS negative_bounds,
        count(*) FILTER (yhat < 0) + count(*) FILTER (lower > upper) + count(*) FILTER (lower < 0 OR upper < 0) = 0 AS valid
       FROM pred_pairs GROUP BY 1, 2""",
)
def _(v):
    return quality.forecast_outputs(v.pred_pairs, ["event_type", "model"], "yhat", "lower", "upper")


@query(
    "val9_feature_table",
    """SELECT event_type, count(*) AS total_rows, count(*) FILTER (y IS NULL OR l1 IS NULL) AS null_rows, 0::BIGINT AS nan_rows,
        0::BIGINT AS infinite_rows FROM (SELECT event_type, y, lag(y) OVER (PARTITION BY event_type ORDER BY ts) AS l1 FROM hourly_gappy)
       GROUP BY 1""",
)
def _(v):
    lagged = features.add_lags(v.hourly_gappy, TYPE, ["ts"], "y", [1], drop_incomplete=False)
    return quality.feature_table(lagged, ["y", "lag_1"], TYPE)


# --- aggregates -------------------------------------------------------------------------


@query(
    "agg1_collapse_timestamps",
    """SELECT l_shipdate AS ts, round(sum(l_quantity), 4) AS ac_power, round(sum(l_extendedprice), 4) AS dc_power,
        round(avg(l_discount), 6) AS daily_yield, round(avg(l_tax), 6) AS total_yield FROM lineitem GROUP BY 1""",
)
def _(v):
    out = summary.collapse(
        v.table("lineitem").withColumnRenamed("l_shipdate", "ts"),
        ["ts"],
        {"ac_power": "l_quantity", "dc_power": "l_extendedprice"},
        {"daily_yield": "l_discount", "total_yield": "l_tax"},
    )
    return out.select("ts", _r("ac_power", 4), _r("dc_power", 4), _r("daily_yield"), _r("total_yield"))


DESCRIBE = """SELECT {keys}, count(*) AS count, round(avg({y}), 4) AS mean, round(stddev_pop({y}), 4) AS std, min({y}) AS min, max({y}) AS max,
    round(quantile_cont({y}, 0.5), 4) AS median, round(quantile_cont({y}, 0.25), 4) AS q25, round(quantile_cont({y}, 0.75), 4) AS q75,
    round((avg({y}^3) - 3 * avg({y}) * avg({y}^2) + 2 * avg({y})^3) / stddev_pop({y})^3, 4) AS skewness, round(kurtosis_pop({y}), 4) AS kurtosis"""


@query(
    "agg2_describe",
    DESCRIBE.format(keys="event_type", y="y")
    + """, count(*) FILTER (y IS NULL) AS missing_values, count(*) FILTER (y = 0) AS zero_values,
    count(*) FILTER (y < 0) AS negative_values FROM hourly_gappy GROUP BY 1""",
)
def _(v):
    out = summary.describe(v.hourly_gappy, TYPE, "y")
    names = ("mean", "std", "median", "q25", "q75", "skewness", "kurtosis")
    return out.withColumns({c: rounded(c, 4) for c in names})


@query(
    "agg3_hour_profile",
    "SELECT event_type, hour(ts)::INTEGER AS part, round(avg(y), 6) + 0.0 AS mean FROM hourly_type GROUP BY 1, 2",
)
def _(v):
    return summary.profile(v.hourly_type, TYPE, F.hour("ts"), "y").withColumn("mean", _r("mean"))


@query(
    "agg3_profile_extremes",
    """SELECT first(part ORDER BY mean DESC, part) AS peak, round(max(mean), 4) AS peak_mean, first(part ORDER BY mean, part) AS low, round(min(mean), 4) AS low_mean
       FROM (SELECT month(ts)::INTEGER AS part, avg(y) AS mean FROM daily_orders GROUP BY 1)""",
)
def _(v):
    prof = summary.profile(v.daily_orders, [], F.month("ts"), "y")
    out = summary.profile_extremes(prof, [])
    return out.withColumns({c: rounded(c, 4) for c in ("peak_mean", "low_mean")})


@query(
    "agg4_dataset_summary",
    """SELECT event_type, count(*) AS total_rows, min(ts) AS first_ts, max(ts) AS last_ts, min(y) AS min_value, max(y) AS max_value,
        3 AS n_columns FROM hourly_type GROUP BY 1""",
)
def _(v):
    return summary.dataset_summary(v.hourly_type, "event_type", "ts", "y")


define_view(
    "type_hist",
    """SELECT s.event_type, b.bin::INTEGER AS bin, s.lo + b.bin * s.w AS left_edge, s.lo + (b.bin + 1) * s.w AS right_edge,
        (SELECT count(*) FROM hourly_type h WHERE h.event_type = s.event_type AND least(floor((h.y - s.lo) / s.w), 9) = b.bin) AS count
       FROM (SELECT event_type, min(y) AS lo, (max(y) - min(y)) / 10 AS w FROM hourly_type GROUP BY 1) s, range(10) b(bin)""",
)


@query(
    "agg5_histogram",
    "SELECT event_type, bin, round(left_edge, 6) AS left_edge, round(right_edge, 6) AS right_edge, count FROM type_hist",
)
def _(v):
    out = summary.histogram(v.hourly_type, TYPE, "y")
    return out.select("event_type", "bin", _r("left_edge"), _r("right_edge"), "count")


@query(
    "agg5_modal_bin",
    """SELECT event_type, bin, round(left_edge, 6) AS left_edge, round(right_edge, 6) AS right_edge, count FROM type_hist
       QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY count DESC, bin) = 1""",
)
def _(v):
    out = summary.modal_bin(summary.histogram(v.hourly_type, TYPE, "y"), TYPE)
    return out.select("event_type", "bin", _r("left_edge"), _r("right_edge"), "count")


@query(
    "agg6_histogram_shape",
    """SELECT event_type, count(*) FILTER (p) AS peaks, count(*) FILTER (p) >= 2 AS is_bimodal, max(abs(count - m) / m) <= 0.2 AS is_uniform
       FROM (SELECT *, coalesce(count > lag(count) OVER w AND count > lead(count) OVER w, false) AS p,
                avg(count) OVER (PARTITION BY event_type) AS m
             FROM type_hist WINDOW w AS (PARTITION BY event_type ORDER BY bin)) GROUP BY 1""",
)
def _(v):
    return summary.histogram_shape(summary.histogram(v.hourly_type, TYPE, "y"), TYPE)


@query(
    "agg7_correlation",
    """SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS l_quantity_l_extendedprice,
        round(corr(l_discount, l_tax), 6) AS l_discount_l_tax FROM lineitem GROUP BY 1""",
)
def _(v):
    pairs = [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")]
    out = summary.correlations(v.table("lineitem"), ["l_returnflag"], pairs)
    return out.select("l_returnflag", *[_r(f"{a}_{b}") for a, b in pairs])


# --- windows ----------------------------------------------------------------------------


@query(
    "win1_lag_features",
    """SELECT * FROM (SELECT event_type, ts, y, """
    + ", ".join(f"lag(y, {k}) OVER w AS lag_{k}" for k in (1, 2, 3, 6, 12, 24))
    + " FROM hourly_type WINDOW w AS (PARTITION BY event_type ORDER BY ts)) WHERE lag_24 IS NOT NULL",
)
def _(v):
    return features.add_lags(v.hourly_type, TYPE, ["ts"], "y")


@query(
    "win1_table_lags",
    """SELECT * FROM (SELECT ts, y, """
    + ", ".join(f"lag(y, {k}) OVER w AS y_lag_{k}" for k in (1, 2, 3, 6, 12, 24, 48, 168))
    + " FROM daily_orders WINDOW w AS (ORDER BY ts)) WHERE y_lag_168 IS NOT NULL",
)
def _(v):
    return features.add_lags(v.daily_orders, [], ["ts"], "y", features.TABLE_LAGS, prefix="y_")


@query(
    "win2_rolling",
    """SELECT event_type, ts, """
    + ", ".join(
        f"""round(avg(y) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 6) + 0.0 AS rolling_mean_{n},
        round(stddev_samp(y) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 6) + 0.0 AS rolling_std_{n}"""
        for n in (24, 168)
    )
    + " FROM hourly_type WINDOW w AS (PARTITION BY event_type ORDER BY ts)",
)
def _(v):
    out = features.add_rolling(v.hourly_type, TYPE, ["ts"], "y")
    return out.select("event_type", "ts", *[_r(c) for c in out.columns if c.startswith("rolling")])


def _moving_sql(measure: str) -> str:
    return f"""SELECT event_type, ts, round(m, 6) + 0.0 AS m FROM (SELECT event_type, ts, row_number() OVER w AS rn,
        {measure}(y) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m
        FROM hourly_type WINDOW w AS (PARTITION BY event_type ORDER BY ts)) WHERE rn >= 10"""


@query("win3_moving_average", _moving_sql("avg"))
def _(v):
    return features.moving(v.hourly_type, TYPE, ["ts"], "y", 10, F.avg, "m").select("event_type", "ts", _r("m"))


@query("win4_moving_deviation", _moving_sql("stddev_pop"))
def _(v):
    out = features.moving(v.hourly_type, TYPE, ["ts"], "y", 10, F.stddev_pop, "m")
    return out.select("event_type", "ts", _r("m"))


@query(
    "win5_sliding_matrix",
    """SELECT event_type, ts, y, array_to_string(list_transform(x, lambda e: format('{:.2f}', e)), ',') AS x FROM (
        SELECT event_type, ts, y, row_number() OVER w AS rn, list(y) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS x
        FROM hourly_type WINDOW w AS (PARTITION BY event_type ORDER BY ts)) WHERE rn > 24""",
)
def _(v):
    out = features.sliding_matrix(v.hourly_type, TYPE, ["ts"], "y", 24)
    text = F.array_join(F.transform("x", lambda e: F.format_string("%.2f", e)), ",")
    return out.select("event_type", "ts", "y", text.alias("x"))


@query(
    "win6_difference",
    """SELECT event_type, ts, round(y - lag(y) OVER w, 4) + 0.0 AS diff, y > lag(y) OVER w AS rising
       FROM hourly_type WINDOW w AS (PARTITION BY event_type ORDER BY ts)""",
)
def _(v):
    out = features.difference(v.hourly_type, TYPE, ["ts"], "y")
    return out.select("event_type", "ts", rounded("diff", 4).alias("diff"), (F.col("diff") > 0).alias("rising"))


@query(
    "win7_high_runs",
    """SELECT event_type, min(i) AS region_start, max(i) AS region_end, count(*) AS length FROM (
        SELECT event_type, i, i - row_number() OVER (PARTITION BY event_type ORDER BY i) AS run FROM (
            SELECT event_type, y, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS i FROM hourly_type) WHERE y > 100)
       GROUP BY event_type, run""",
)
def _(v):
    return features.islands(v.hourly_type, TYPE, ["ts"], F.col("y") > 100)


@query(
    "win8_tie_averaged_rank",
    """SELECT event_type, ts, model, rank() OVER (PARTITION BY event_type, ts ORDER BY abs(y - yhat))
        + (count(*) OVER (PARTITION BY event_type, ts, abs(y - yhat)) - 1) / 2.0 AS "rank" FROM pred_pairs""",
)
def _(v):
    scored = v.pred_pairs.withColumn("abs_error", F.abs(F.col("y") - F.col("yhat")))
    out = features.tie_averaged_rank(scored, ["event_type", "ts"], "abs_error")
    return out.select("event_type", "ts", "model", "rank")


@query(
    "win9_equal_count_bins",
    """SELECT event_type, ts, CASE WHEN n < 10 THEN 9 ELSE least(i // (n // 10), 9) END::INTEGER AS bin FROM (
        SELECT event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY y, ts) - 1 AS i,
            count(*) OVER (PARTITION BY event_type) AS n FROM hourly_type)""",
)
def _(v):
    return features.equal_count_bins(v.hourly_type, TYPE, ["y", "ts"]).select("event_type", "ts", "bin")


@query(
    "win10_autocorrelation",
    """SELECT event_type, round(corr(y, l1), 6) AS autocorr_1, round(corr(y, l24), 6) AS autocorr_24 FROM (
        SELECT event_type, y, lag(y) OVER w AS l1, lag(y, 24) OVER w AS l24
        FROM hourly_type WINDOW w AS (PARTITION BY event_type ORDER BY ts)) GROUP BY 1""",
)
def _(v):
    out = features.autocorrelation(v.hourly_type, TYPE, ["ts"], "y", [1, 24])
    return out.select("event_type", _r("autocorr_1"), _r("autocorr_24"))


# --- joins, unions, sorts, splits ---------------------------------------------------------


@query(
    "jon1_align_truth",
    """SELECT h.event_type, h.ts, h.y, p.model, p.yhat FROM hourly_type h JOIN pred_pairs p USING (event_type, ts)""",
)
def _(v):
    predictions = v.pred_pairs.select("event_type", "ts", "model", "yhat")
    return v.hourly_type.join(predictions, ["event_type", "ts"]).select("event_type", "ts", "y", "model", "yhat")


@query(
    "jon1_align_truth_null_series",
    """SELECT nullif(h.event_type, 'view') AS event_type, h.ts, h.y, p.model, p.yhat
       FROM hourly_type h JOIN pred_pairs p USING (event_type, ts)""",
)
def _(v):
    key = F.nullif("event_type", F.lit("view")).alias("event_type")
    truth = v.hourly_type.select(key, "ts", "y")
    predictions = v.pred_pairs.select(key.alias("_k"), F.col("ts").alias("_ts"), "model", "yhat")
    match = truth["event_type"].eqNullSafe(predictions["_k"]) & (truth["ts"] == predictions["_ts"])
    return truth.join(predictions, match).select("event_type", "ts", "y", "model", "yhat")


@query(
    "jon2_align_models",
    """SELECT event_type, ts, round(y - lag1, 6) + 0.0 AS lag1, round(y - lag24, 6) + 0.0 AS lag24, round(y - mean24, 6) + 0.0 AS mean24
       FROM lagged""",
)
def _(v):
    errors = v.pred_pairs.withColumn("e", F.col("y") - F.col("yhat"))
    wide = errors.groupBy("event_type", "ts").pivot("model", ["lag1", "lag24", "mean24"]).agg(F.first("e"))
    kept = wide.na.drop(how="any")
    return kept.select("event_type", "ts", *[rounded(m).alias(m) for m in ("lag1", "lag24", "mean24")])


@query(
    "jon3_apply_params",
    """SELECT user_id, ts, round(y - mu, 6) + 0.0 AS centred FROM hourly_user
       JOIN (SELECT user_id, avg(y) AS mu FROM hourly_user GROUP BY 1) USING (user_id)""",
)
def _(v):
    params = normalise.fit(v.hourly_user, ["user_id"], "y").select("user_id", "mu")
    out = join_params(v.hourly_user, params, ["user_id"])
    return out.select("user_id", "ts", rounded(F.col("y") - F.col("mu")).alias("centred"))


@query(
    "set1_tagged_union",
    """SELECT ts, y, 'orders' AS dataset_source, NULL AS event_type FROM daily_orders
       UNION ALL SELECT ts, y, 'events', event_type FROM hourly_type""",
)
def _(v):
    return features.tagged_union({"orders": v.daily_orders, "events": v.hourly_type})


@query("srt1_sort_by_time", "SELECT event_type, ts, y FROM hourly_type ORDER BY event_type, ts")
def _(v):
    return features.sort_by_time(v.hourly_type, TYPE, "ts").select("event_type", "ts", "y")


POSITION = """SELECT event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS i,
    count(*) OVER (PARTITION BY event_type) AS n FROM hourly_type"""


@query(
    "spl1_three_way_split",
    f"""SELECT event_type, ts, CASE WHEN i < floor(n * 0.8::DOUBLE) THEN 'train'
        WHEN i < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM ({POSITION})""",
)
def _(v):
    return features.chronological_split(v.hourly_type, TYPE, ["ts"]).select("event_type", "ts", "split")


@query(
    "spl1_seventy_split",
    f"""SELECT event_type, ts, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train'
        WHEN i < floor(n * 0.7::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM ({POSITION})""",
)
def _(v):
    out = features.chronological_split(v.hourly_type, TYPE, ["ts"], train=0.7)
    return out.select("event_type", "ts", "split")


@query(
    "spl2_two_way_split",
    f"SELECT event_type, ts, CASE WHEN i < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM ({POSITION})",
)
def _(v):
    return features.two_way_split(v.hourly_type, TYPE, ["ts"]).select("event_type", "ts", "split")


@query(
    "spl3_size_ladder",
    """SELECT size, count(*) AS total_rows, round(sum(value), 2) AS total FROM
        (SELECT value, row_number() OVER (ORDER BY ts) - 1 AS i FROM events) e,
        (VALUES (1000), (5000), (10000), (20000)) s(size) WHERE i < size GROUP BY 1""",
)
def _(v):
    ladder = features.size_ladder(v.table("events").select("ts", "value"), [], ["ts"])
    return ladder.groupBy("size").agg(
        F.count(F.lit(1)).alias("total_rows"), F.round(F.sum("value"), 2).alias("total")
    )


@query(
    "agg4_hours_of_day",
    """SELECT ((epoch_ms(ts) // 3600000) % 24)::INTEGER AS hour, count(*) AS total_rows FROM events GROUP BY 1""",
)
def _(v):
    # Like the SQL, hours before 1970 count backwards from the epoch, 0 to -23.
    hour = F.expr("(unix_millis(cast(ts AS timestamp)) div 3600000 % 24)::int")
    return v.table("events").groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("total_rows"))
