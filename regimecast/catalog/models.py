"""Sinks, trained models and experiment grids."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import replace

from pyspark.sql import functions as F

from regimecast.catalog.evaluation import normal_tail_sql
from regimecast.catalog.registry import define_view, query, rounded
from regimecast.functions.tails import normal_quantile
from regimecast.operators import ensemble, features, forest, intervals, metrics, significance
from regimecast.operators.clustering import DualClusterer, hashed_memberships
from regimecast.plans import etl, experiments
from regimecast.plans.forecasting import (
    ForecastSettings,
    RegimeForecaster,
    RegimeForecasterModel,
    lag_frame,
    model_features,
    regime_columns,
)
from regimecast.session import materialise, scratch_path
from regimecast.sources import tables
from regimecast.sources.views import MODELS

TYPE = ["event_type"]
ROW = ["event_type", "ts"]
SETTINGS = ForecastSettings(keys=("event_type",))
POINT_NAMES = ("rmse", "mae", "r2")


def _r(df, *names):
    names = names or [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({n: rounded(n) for n in names})


# --- sources and sinks ----------------------------------------------------------------------


def _raw_zone(v):
    path = scratch_path(v.spark, "raw-zone")
    source = v.table("events").select("event_id", "ts", "value", "event_type")
    tables.write_raw_zone(source, path, ["event_type"])
    return tables.read_raw_zone(v.spark, path, source.schema)


@query("src3_raw_zone_round_trip", "SELECT event_id, ts, value, event_type FROM events")
def _(v):
    return _raw_zone(v)


@query(
    "src3_raw_zone_pruned",
    "SELECT event_id, ts, value, event_type FROM events WHERE event_type IN ('view', 'click')",
)
def _(v):
    """Two partition folders only are opened."""
    return _raw_zone(v).where(F.col("event_type").isin("view", "click"))


@query(
    "src4_registered_dataset",
    "SELECT id, TRY_CAST(amount AS DOUBLE) AS y FROM raw_strings WHERE TRY_CAST(amount AS DOUBLE) IS NOT NULL",
)
def _(v):
    frame = v.raw_strings.select("id", F.col("amount").alias("y"))
    return tables.Registry({"orders": frame}, ["id", "y"]).load("orders")


@query("src5_preamble_lines", "SELECT o_orderkey, o_totalprice FROM orders")
def _(v):
    """Order rows written as text under a metadata line and a header line, read back."""
    path = scratch_path(v.spark, "preamble")
    rows = v.table("orders").select(
        F.concat_ws(",", "o_orderkey", F.format_string("%.2f", "o_totalprice")).alias("value")
    )
    headed = F.when(F.col("_first"), F.concat(F.lit("Source: orders\nkey,price\n"), "value")).otherwise(F.col("value"))
    # The first row of every written file carries the two leading lines.
    numbered = rows.withColumn("_first", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0)
    numbered.select(headed.alias("value")).write.text(path)
    return tables.read_with_preamble(v.spark, path, "o_orderkey bigint, o_totalprice double")


@query("snk1_processed_table", "SELECT event_type, ts, y FROM hourly_type")
def _(v):
    path = scratch_path(v.spark, "processed")
    tables.write_table(v.hourly_type, path)
    return v.spark.read.parquet(path)


@query(
    "snk1_processed_csv",
    "SELECT event_type, ts, y FROM hourly_type",
)
def _(v):
    path = scratch_path(v.spark, "processed-csv")
    tables.write_table(v.hourly_type, path, "csv")
    schema = "event_type string, ts timestamp_ntz, y double"
    return v.spark.read.csv(path, schema=schema, header=True)


@query(
    "snk2_results_json",
    """SELECT event_type, model, round(sqrt(avg((y - yhat)^2)), 6) AS rmse,
        CASE WHEN model = 'lag1' THEN NULL ELSE round(avg(abs(y - yhat)), 6) END AS mae FROM pred_pairs GROUP BY 1, 2""",
)
def _(v):
    path = scratch_path(v.spark, "results")
    scores = _r(metrics.point(v.pred_pairs, ["event_type", "model"]).select("event_type", "model", "rmse", "mae"))
    missing = F.when(F.col("model") == "lag1", F.lit(float("nan"))).otherwise(F.col("mae"))
    tables.write_results(scores.withColumn("mae", missing), path)
    return v.spark.read.schema(scores.schema).json(path)


#: The last forecasters of a session by data folder and settings; several queries look at the same one.
_FITTED: OrderedDict[tuple, tuple] = OrderedDict()


def _once(v, name, build):
    key = (v.spark.sparkContext.applicationId, v.folder, name)
    if key not in _FITTED:
        _FITTED[key] = build()
        while len(_FITTED) > 8:
            _FITTED.popitem(last=False)
    return _FITTED[key]


def _rows(v, settings=SETTINGS):
    """The split series of an experiment; nothing is fitted for it."""
    return _once(v, ("rows", settings.keys), lambda: experiments.split_frame(v.hourly_type, settings))


def _fitted(v, settings=SETTINGS):
    def build():
        rows = _rows(v, settings)
        return rows, RegimeForecaster(settings).fit(rows.where("split = 'train'").drop("split"))

    return _once(v, settings, build)


@query("snk3_saved_model_forecasts")
def _(v):
    """A fitted forecaster written, loaded and applied."""
    path = scratch_path(v.spark, "model")
    _fitted(v)[1].save(path)
    return RegimeForecasterModel.load(v.spark, path).predict_direct(v.hourly_type)


# --- models ----------------------------------------------------------------------------------


def _trained(v):
    rows, model = _fitted(v)
    clean = model.prep.transform(rows.drop("split"))
    return model, regime_columns(lag_frame(clean, model.settings), model.settings, model.dual)


@query("mdl1_forest_fit_predict")
def _(v):
    model, framed = _trained(v)
    return model.forest.transform(framed).select("event_type", "ts", "target", "yhat")


@query("mdl2_per_tree_spread")
def _(v):
    model, framed = _trained(v)
    return model.forest.transform(framed).select("event_type", "ts", "yhat", "sigma")


@query("mdl3_feature_importance")
def _(v):
    return _fitted(v)[1].forest.importance()


@query("mdl3_tif_importance_share")
def _(v):
    return _fitted(v)[1].forest.tif_share()


def _lagged_split(v, n_lags=24):
    rows = experiments.split_frame(v.hourly_type, SETTINGS)
    framed = model_features(rows, SETTINGS.keys, "ts", "y", n_lags)
    x = [f"lag_{k}" for k in range(n_lags, 0, -1)]
    return framed.where("split = 'train'"), framed.where("split = 'test'"), x


@query("mdl7_vanilla_forest")
def _(v):
    train, test, x = _lagged_split(v)
    return forest.vanilla_forest(train, test, x).select(*ROW, "y", "yhat", "sigma")


@query("mdl8_boosted_trees")
def _(v):
    train, test, x = _lagged_split(v)
    return forest.boosted_trees(train, test, x).select(*ROW, "y", "yhat", "sigma")


define_view(
    "lag_split",
    """SELECT event_type, ts, y, l, CASE WHEN i < floor(n * 0.8::DOUBLE) THEN 'train'
            WHEN i < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split
       FROM (SELECT event_type, ts, y, lag(y) OVER (PARTITION BY event_type ORDER BY ts) AS l,
            row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM hourly_type)
       WHERE l IS NOT NULL""",
)


@query(
    "mdl9_linear_lag",
    f"""WITH c AS (SELECT regr_slope(y, l) AS b, regr_intercept(y, l) AS a FROM lag_split WHERE split = 'train'),
        s AS (SELECT stddev_pop(y - a - b * l) AS s FROM lag_split, c WHERE split = 'train')
       SELECT event_type, ts, y, round(a + b * l, 4) AS yhat, round(a + b * l - 1.96 * s, 4) AS lower, round(a + b * l + 1.96 * s, 4) AS upper
       FROM lag_split, c, s WHERE split = 'test'""",
)
def _(v):
    train, test, x = _lagged_split(v, 1)
    out = forest.linear_lags(train, test, x).select(*ROW, "y", "yhat", "lower", "upper")
    return out.withColumns({c: rounded(c, 4) for c in ("yhat", "lower", "upper")})


@query("mdl9_linear_lags_full")
def _(v):
    train, test, x = _lagged_split(v)
    return forest.linear_lags(train, test, x).select(*ROW, "y", "yhat", "lower", "upper")


@query("ens4_stacking")
def _(v):
    halves = features.two_way_split(v.hourly_type, TYPE, ["ts"]).select(*ROW, "split")
    rows = v.ensemble_rows.join(halves, ROW)
    return ensemble.stack(rows.where("split = 'train'"), rows.where("split = 'test'"), ROW, list(MODELS))


STACK_SPLIT = """SELECT event_type, ts, y, lag1 AS a, mean24 AS b, i < floor(n * 0.8::DOUBLE) AS train FROM lagged
    JOIN (SELECT event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS i,
        count(*) OVER (PARTITION BY event_type) AS n FROM hourly_type) USING (event_type, ts)"""


@query(
    "ens4_stacking_two_models",
    f"""WITH s AS ({STACK_SPLIT}), m AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab,
            covar_pop(a, y) AS ay, covar_pop(b, y) AS by_ FROM s WHERE train),
        w AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS wa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM m)
       SELECT event_type, ts, round(my + wa * (a - ma) + wb * (b - mb), 4) AS yhat, round(abs(a - b) / 2, 4) AS sigma FROM s, w WHERE NOT train""",
)
def _(v):
    halves = features.two_way_split(v.hourly_type, TYPE, ["ts"]).select(*ROW, "split")
    rows = v.ensemble_rows.where(F.col("model").isin("lag1", "mean24")).join(halves, ROW)
    out = ensemble.stack(rows.where("split = 'train'"), rows.where("split = 'test'"), ROW, ["lag1", "mean24"])
    return out.select(*ROW, rounded("yhat", 4).alias("yhat"), rounded("sigma", 4).alias("sigma"))


# --- experiments -----------------------------------------------------------------------------


@query("exp1_recursive_forecast")
def _(v):
    return _fitted(v)[1].predict_recursive(v.hourly_type)


@query("exp1_direct_forecast")
def _(v):
    return _fitted(v, replace(SETTINGS, horizon=24))[1].predict_direct(v.hourly_type)


@query("exp2_end_to_end_fit")
def _(v):
    rows, model = _fitted(v)
    fitted = model.evaluate(rows.where("split = 'train'").drop("split"))
    return metrics.point(fitted, TYPE)


@query("exp3_held_out_evaluation")
def _(v):
    rows, model = _fitted(v)
    scored = model.evaluate(rows.drop("split"), rows.where("split = 'test'").drop("split"))
    return metrics.tidy(metrics.comprehensive(scored, TYPE, ["ts"]), TYPE)


def _datasets(v):
    daily = v.daily_orders.withColumn("event_type", F.lit("orders")).select("event_type", "ts", "y")
    return {"hourly_events": v.hourly_type, "daily_orders": daily}


def _compared(v):
    return _once(v, "compared", lambda: materialise(experiments.compare_baselines(_datasets(v), SETTINGS)))


def _ablated(v):
    rows = _rows(v)
    return _once(v, "ablated", lambda: materialise(experiments.ablation(rows, SETTINGS)))


def _varied(v):
    rows = _rows(v)
    return _once(v, "varied", lambda: materialise(experiments.sensitivity_predictions(rows, SETTINGS)))


def _crossed(v):
    return _once(v, "crossed", lambda: materialise(experiments.cross_dataset(_datasets(v), SETTINGS)))


@query("exp4_baseline_comparison")
def _(v):
    return experiments.score_table(_compared(v))


@query("exp4_reference_tests")
def _(v):
    return experiments.reference_tests(_compared(v), SETTINGS)


@query("exp5_ablation")
def _(v):
    return experiments.score_table(_ablated(v), ["model"])


@query("exp6_sensitivity")
def _(v):
    return experiments.sensitivity_table(_varied(v))


@query("exp7_cross_dataset")
def _(v):
    return experiments.score_table(_crossed(v), ["train_set", "test_set"])


@query("exp8_robustness")
def _(v):
    rows, model = _fitted(v)
    return experiments.robustness(rows, SETTINGS, model=model)


@query(
    "exp9_summary",
    """WITH s AS (SELECT event_type, model, sqrt(avg((y - yhat)^2)) AS rmse FROM pred_pairs GROUP BY 1, 2),
        b AS (SELECT event_type, rmse AS base FROM s WHERE model = 'mean24')
       SELECT event_type, model, round(rmse, 6) AS rmse, row_number() OVER (PARTITION BY event_type ORDER BY rmse, model)::INTEGER AS "rank",
        round((rmse - base) / base * 100, 6) + 0.0 AS degradation,
        row_number() OVER (PARTITION BY event_type ORDER BY rmse, model) = 1 AS is_best FROM s JOIN b USING (event_type)""",
)
def _(v):
    scores = metrics.point(v.pred_pairs, ["event_type", "model"]).select("event_type", "model", "rmse")
    return _r(experiments.summarise(scores, "mean24", "event_type"), "rmse", "degradation")


@query(
    "exp9_significant_wins",
    # Series are long enough that the normal tail decides like the Student tail of the library.
    f"""WITH d AS (SELECT event_type, 'lag1' AS model, abs(y - mean24)^2 - abs(y - lag1)^2 AS d FROM lagged
            UNION ALL SELECT event_type, 'lag24', abs(y - mean24)^2 - abs(y - lag24)^2 FROM lagged),
        s AS (SELECT event_type, model, avg(d) / sqrt(var_samp(d) / count(*)) * sqrt((count(*) - 1.0) / count(*)) AS z FROM d GROUP BY 1, 2),
        p AS (SELECT event_type, model, z, {normal_tail_sql('z')} AS p FROM s),
        c AS (SELECT *, p * (3 - row_number() OVER (PARTITION BY event_type ORDER BY p, model)) AS corrected FROM p)
       SELECT event_type, count(*) AS comparisons, count(*) FILTER (corrected < 0.05 AND z < 0) AS wins FROM c GROUP BY 1""",
)
def _(v):
    tests = significance.against_reference(v.pred_pairs, TYPE, ROW, "mean24")
    return experiments.significant_wins(tests, "event_type")


TABLE = """SELECT ts, y, lag(y, 168) OVER (ORDER BY ts) AS far FROM {source}"""


@query(
    "exp10_multi_source_tables",
    f"""SELECT 'load' AS kind, 'orders_daily' AS dataset_source, count(*) AS total_rows, round(sum(y), 2) AS total FROM ({TABLE.format(source='daily_orders')}) WHERE far IS NOT NULL
       UNION ALL SELECT 'wind', 'events_hourly', count(*), round(sum(y), 2) FROM ({TABLE.format(source='hourly_all')}) WHERE far IS NOT NULL
       UNION ALL SELECT 'load', 'shipments_daily', count(*), round(sum(y), 2) FROM ({TABLE.format(source='(SELECT l_shipdate AS ts, round(sum(l_quantity), 2) AS y FROM lineitem GROUP BY 1)')})
        WHERE far IS NOT NULL""",
)
def _(v):
    """Three sources and one that fails, processed, written and united by kind."""
    folder = scratch_path(v.spark, "etl")
    rename = {etl.TS: F.col("ts"), etl.VALUE: F.col("y")}
    as_base = lambda df: df.select(*[c.alias(n) for n, c in rename.items()])

    def shipments():
        rows = v.table("lineitem").groupBy(F.col("l_shipdate").alias("ts"))
        return as_base(rows.agg(F.round(F.sum("l_quantity"), 2).alias("y")))

    sources = [
        etl.Source("orders_daily", "load", lambda: as_base(v.daily_orders)),
        etl.Source("shipments_daily", "load", shipments),
        etl.Source("events_hourly", "wind", lambda: as_base(v.hourly_all)),
        etl.Source("broken", "solar", lambda: v.table("orders").select("no_such_column")),
    ]
    united = etl.unify(v.spark, etl.run_sources(v.spark, sources, folder), folder)
    counted = [
        df.groupBy("dataset_source").agg(
            F.count(F.lit(1)).alias("total_rows"), F.round(F.sum(etl.VALUE), 2).alias("total")
        ).withColumn("kind", F.lit(kind))
        for kind, df in united.items()
    ]
    return experiments._union(counted)


LEVELS = " UNION ALL ".join(f"SELECT {p}::DOUBLE AS level, {normal_quantile(p)!r}::DOUBLE AS z" for p in (0.8, 0.9, 0.95))


@query(
    "exp11_multi_level",
    f"""SELECT event_type, level, round(avg((abs(y - yhat) <= z * sigma)::INTEGER), 6) AS picp,
        round(avg(2 * z * sigma) / (max(y) - min(y)), 6) AS pinaw, round(abs(avg((abs(y - yhat) <= z * sigma)::INTEGER) - level), 6) AS ace
       FROM interval_inputs, ({LEVELS}) GROUP BY event_type, level""",
)
def _(v):
    rows = intervals.multi_level(v.interval_inputs)
    out = metrics.interval(rows, ["event_type", "level"])
    gap = F.abs(F.col("picp") - F.col("level"))
    return _r(out.select("event_type", "level", "picp", "pinaw", gap.alias("ace")), "picp", "pinaw", "ace")


@query("win5_lag_vectors", """SELECT event_type, ts, y AS target, lag(y) OVER (PARTITION BY event_type ORDER BY ts) AS lag_1
    FROM hourly_type QUALIFY lag_1 IS NOT NULL""")
def _(v):
    return model_features(v.hourly_type, TYPE, "ts", "y", 1).select("event_type", "ts", "target", "lag_1")


@query(
    "win2_table_features",
    """SELECT ts, round(y_rolling_mean_24, 6) AS y_rolling_mean_24, y_lag_168, is_weekend FROM (SELECT ts,
        avg(y) OVER (ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS y_rolling_mean_24, lag(y, 168) OVER (ORDER BY ts) AS y_lag_168,
        (isodow(ts) >= 6)::INTEGER AS is_weekend FROM daily_orders) WHERE y_lag_168 IS NOT NULL""",
)
def _(v):
    out = features.add_table_features(v.daily_orders, [], "ts", "y")
    return out.select("ts", rounded(F.col("y_rolling_mean_24")).alias("y_rolling_mean_24"), "y_lag_168", "is_weekend")


# --- what must hold for trained and randomised results ------------------------------------------
# Their values have no SQL form, but how many rows each series keeps and what holds on every row has.

define_view(
    "series_rows",
    """SELECT event_type, n, floor(n * 0.8::DOUBLE)::BIGINT AS n_train, floor(n * 0.1::DOUBLE)::BIGINT AS n_val
       FROM (SELECT event_type, count(*) AS n FROM hourly_type GROUP BY 1)""",
)
FRAMED = max(SETTINGS.lags)


@query(
    "mdl2_tree_mean_invariant",
    f"""SELECT event_type, n - {FRAMED} AS total_rows, 0::BIGINT AS off_forest, 0::BIGINT AS bad_spread FROM series_rows""",
)
def _(v):
    """The mean of the trees is the forest's own prediction and the spread is never negative."""
    model, framed = _trained(v)
    scored = model.forest.transform(framed)
    whole = model.forest.model.setPredictionCol("whole").transform(
        forest.assemble(scored, model.forest.settings.features)
    )
    return whole.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.abs(F.col("whole") - F.col("yhat")) > 1e-9).alias("off_forest"),
        F.count_if(F.col("sigma").isNull() | (F.col("sigma") < 0)).alias("bad_spread"),
    )


def _test_rows(scored):
    return scored.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("yhat").isNull() | F.isnan("yhat")).alias("missing")
    )


TEST_ROWS = "SELECT event_type, n - n_train - n_val AS total_rows, 0::BIGINT AS missing FROM series_rows"


@query("mdl7_vanilla_forest_rows", TEST_ROWS)
def _(v):
    train, test, x = _lagged_split(v)
    return _test_rows(forest.vanilla_forest(train, test, x))


@query("mdl8_boosted_trees_rows", TEST_ROWS)
def _(v):
    train, test, x = _lagged_split(v)
    return _test_rows(forest.boosted_trees(train, test, x))


@query("exp3_held_out_rows", TEST_ROWS)
def _(v):
    rows, model = _fitted(v)
    return _test_rows(model.evaluate(rows.drop("split"), rows.where("split = 'test'").drop("split")))


@query(
    "exp1_recursive_rows",
    "SELECT event_type, s.step::INTEGER AS step, true AS ordered FROM series_rows, range(1, 181) s(step)",
)
def _(v):
    out = _fitted(v)[1].predict_recursive(v.hourly_type)
    ordered = (F.col("lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("upper"))
    return out.select("event_type", "step", ordered.alias("ordered"))


@query(
    "exp1_direct_rows",
    f"SELECT event_type, n - {FRAMED} AS total_rows, 1::BIGINT AS beyond_the_end FROM series_rows",
)
def _(v):
    out = _fitted(v)[1].predict_direct(v.hourly_type)
    return out.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("target_ts").isNull()).alias("beyond_the_end")
    )


@query(
    "exp8_missing_share",
    "SELECT event_type, n AS total_rows, floor(n * 0.2::DOUBLE)::BIGINT AS removed FROM series_rows",
)
def _(v):
    out = experiments.remove_values(v.hourly_type, TYPE, "ts", "y", 0.2)
    return out.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("y").isNull()).alias("removed")
    )


@query(
    "int5_bootstrap_invariant",
    "SELECT event_type, count(*) AS total_rows, 0::BIGINT AS outside FROM interval_inputs GROUP BY 1",
)
def _(v):
    params = intervals.fit_residual_spread(v.interval_inputs, TYPE)
    out = intervals.bootstrap(v.interval_inputs, TYPE, ROW, params)
    inside = (F.col("lower") < F.col("yhat")) & (F.col("yhat") < F.col("upper"))
    return out.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(~inside).alias("outside")
    )


@query(
    "clu7_membership_sums",
    "SELECT user_id, count(*) AS total_rows, 0::BIGINT AS not_one FROM hourly_user GROUP BY 1",
)
def _(v):
    start = hashed_memberships("x", 3, 42, ["user_id", "ts"])
    total = start[0] + start[1] + start[2]
    return v.norm_user.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(F.abs(total - 1.0) > 1e-12).alias("not_one")
    )


@query(
    "clu12_dual_fit_rows",
    "SELECT 5::BIGINT AS regimes, count(*) AS total_rows FROM hourly_user",
)
def _(v):
    model = DualClusterer().fit(v.norm_user)
    return model.transform(v.norm_user).agg(
        F.count_distinct("k").alias("regimes"), F.count(F.lit(1)).alias("total_rows")
    )


@query("mdl1_forest_invariant", "SELECT event_type, n - 24 AS total_rows, 0::BIGINT AS missing, true AS beats_the_mean FROM series_rows")
def _(v):
    """Every framed row gets a value, and fitted rows are nearer to the truth than their mean."""
    model, framed = _trained(v)
    scored = model.forest.transform(framed)
    error, spread = F.avg((F.col("target") - F.col("yhat")) ** 2), F.var_pop("target")
    return scored.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("yhat").isNull() | F.isnan("yhat")).alias("missing"),
        (error < spread).alias("beats_the_mean"),
    )


@query("mdl3_importance_invariant", f"SELECT {len(SETTINGS.feature_columns())}::BIGINT AS features, 1.0::DOUBLE AS total, 0::BIGINT AS below_zero, true AS ranked")
def _(v):
    """Importances are shares: not negative, one in all, ranked by size."""
    table = _fitted(v)[1].forest.importance()
    by_rank = F.sort_array(F.collect_list(F.struct("rank", (-F.col("importance")).alias("i"))))
    values = F.transform(by_rank, lambda r: r["i"])
    return table.agg(
        F.count(F.lit(1)).alias("features"),
        rounded(F.sum("importance")).alias("total"),
        F.count_if(F.col("importance") < 0).alias("below_zero"),
        (values == F.array_sort(values)).alias("ranked"),
    )


@query("snk3_saved_model_invariant", "SELECT event_type, n - 24 AS total_rows, 0::BIGINT AS changed FROM series_rows")
def _(v):
    """Forecasts of the loaded model are those of the saved one."""
    path = scratch_path(v.spark, "model")
    model = _fitted(v)[1]
    model.save(path)
    again = RegimeForecasterModel.load(v.spark, path).predict_direct(v.hourly_type)
    before = model.predict_direct(v.hourly_type).select(*ROW, F.col("yhat").alias("_yhat"), F.col("upper").alias("_upper"))
    gap = F.greatest(F.abs(F.col("yhat") - F.col("_yhat")), F.abs(F.col("upper") - F.col("_upper")))
    return again.join(before, ROW).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(~F.coalesce(gap < 1e-9, F.lit(False))).alias("changed")
    )


@query("exp2_fit_invariant", "SELECT event_type, n_train - 25 AS total_rows, 0::BIGINT AS missing, true AS fits FROM series_rows")
def _(v):
    """Every training row with lags and a target is scored, with an R2 above zero."""
    rows, model = _fitted(v)
    scored = model.evaluate(rows.where("split = 'train'").drop("split"))
    error, spread = F.avg((F.col("y") - F.col("yhat")) ** 2), F.var_pop("y")
    return scored.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("yhat").isNull() | F.isnan("yhat")).alias("missing"),
        (error < spread).alias("fits"),
    )

