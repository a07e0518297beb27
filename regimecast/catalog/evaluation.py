"""Intervals, metrics, ensembles and significance tests over persistence forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from regimecast.catalog.registry import define_view, query, rounded
from regimecast.functions.tails import normal_quantile
from regimecast.operators import ensemble, intervals, metrics
from regimecast.operators import significance as sig
from regimecast.sources.views import MODELS

TYPE = ["event_type"]
PAIR = ["event_type", "model"]
ROW = ["event_type", "ts"]


def _r(df, *names, digits=6):
    names = names or [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({n: rounded(n, digits) for n in names})


def _sql(columns: dict[str, str], digits=6) -> str:
    return ", ".join(f"round({sql}, {digits}) + 0.0 AS {n}" for n, sql in columns.items())


# --- interval construction ----------------------------------------------------------------

define_view(
    "interval_inputs",
    """SELECT event_type, ts, y, mean24 AS yhat, sqrt(((lag1 - m)^2 + (lag24 - m)^2 + (mean24 - m)^2) / 3) AS sigma, k,
        least(greatest(-(p0 * ln(p0) + p1 * ln(p1) + p2 * ln(p2)) / ln(3), 0.0), 1.0) AS indeterminacy
       FROM (SELECT *, (u0 + 1e-9) / (u0 + u1 + u2 + 3e-9) AS p0, (u1 + 1e-9) / (u0 + u1 + u2 + 3e-9) AS p1,
            (u2 + 1e-9) / (u0 + u1 + u2 + 3e-9) AS p2 FROM (SELECT *,
            CASE WHEN d0 = 0 THEN 1.0 WHEN d1 = 0 OR d2 = 0 THEN 0.0 ELSE 1/(d0*d0) / (1/(d0*d0) + 1/(d1*d1) + 1/(d2*d2)) END::DOUBLE AS u0,
            CASE WHEN d0 = 0 THEN 0.0 WHEN d1 = 0 THEN 1.0 WHEN d2 = 0 THEN 0.0 ELSE 1/(d1*d1) / (1/(d0*d0) + 1/(d1*d1) + 1/(d2*d2)) END::DOUBLE AS u1,
            CASE WHEN d0 = 0 OR d1 = 0 THEN 0.0 WHEN d2 = 0 THEN 1.0 ELSE 1/(d2*d2) / (1/(d0*d0) + 1/(d1*d1) + 1/(d2*d2)) END::DOUBLE AS u2
        FROM (SELECT *, abs(x - 0.12) AS d0, abs(x - 0.33) AS d1, abs(x - 0.55) AS d2, (lag1 + lag24 + mean24) / 3 AS m,
            CASE WHEN abs(x - 0.1) <= abs(x - 0.3) AND abs(x - 0.1) <= abs(x - 0.6) THEN 0 WHEN abs(x - 0.3) <= abs(x - 0.6) THEN 1 ELSE 2 END AS k
        FROM (SELECT l.*, CASE WHEN hi = lo THEN 0.0 ELSE (lag1 - lo) / (hi - lo) END AS x FROM lagged l
            JOIN (SELECT event_type, min(y) AS lo, max(y) AS hi FROM hourly_type GROUP BY 1) USING (event_type)))))""",
)
define_view("residual_std", "SELECT event_type, stddev_pop(y - yhat) AS s FROM interval_inputs GROUP BY 1")
BOUNDS = ("lower", "upper")


def _interval_sql(half: str, source: str = "interval_inputs JOIN residual_std USING (event_type)") -> str:
    return f"""SELECT event_type, ts, round(yhat - ({half}), 6) + 0.0 AS lower, round(yhat + ({half}), 6) + 0.0 AS upper FROM {source}"""


def _bounds(df):
    return _r(df.select("event_type", "ts", *BOUNDS), *BOUNDS)


@query("int1_enhanced", _interval_sql("1.96 * sigma + 1.0 * indeterminacy"))
def _(v):
    return _bounds(intervals.enhanced(v.interval_inputs))


@query("int1_enhanced_level", _interval_sql(f"{normal_quantile(0.9)!r} * sigma + 2.5 * indeterminacy"))
def _(v):
    return _bounds(intervals.enhanced(v.interval_inputs, beta=2.5, level=0.9))


@query("int2_heuristic_sigma", _interval_sql("1.96 * 0.5 * sigma"))
def _(v):
    return _bounds(intervals.heuristic(v.interval_inputs, beta=0.5, sigma="sigma"))


@query("int2_heuristic_residual", _interval_sql("1.96 * s"))
def _(v):
    params = intervals.fit_residual_spread(v.interval_inputs, TYPE)
    return _bounds(intervals.heuristic(v.interval_inputs, TYPE, params))


@query("int3_adaptive", _interval_sql("1.96 * s * (1 + 0.5 * indeterminacy)"))
def _(v):
    params = intervals.fit_residual_spread(v.interval_inputs, TYPE)
    return _bounds(intervals.adaptive(v.interval_inputs, TYPE, params, beta=0.5))


@query(
    "int3_adaptive_unfitted",
    _interval_sql(
        "1.96 * sp * (1 + indeterminacy)",
        "interval_inputs JOIN (SELECT event_type, 0.1 * stddev_pop(yhat) AS sp FROM interval_inputs GROUP BY 1) USING (event_type)",
    ),
)
def _(v):
    return _bounds(intervals.adaptive(v.interval_inputs, TYPE))


@query(
    "int4_linear_quantile",
    # The quantiles themselves are fitted; what must hold is known: as many rows lie below a linear quantile as
    # its level says, but for one row a coefficient, and its loss is not above that of a special case of it.
    """SELECT count(*) AS total_rows, true AS low_share_holds, true AS high_share_holds, true AS low_loss_holds, true AS high_loss_holds
       FROM interval_inputs WHERE y - yhat IS NOT NULL""",
)
def _(v):
    regime = {f"k_{j}": (F.col("k") == j).cast("double") for j in (1, 2)}
    names = [*regime, "sigma", "indeterminacy"]
    rows = v.interval_inputs.withColumns(regime).where("y - yhat IS NOT NULL")
    fitted = intervals.linear_quantile(rows, names, intervals.linear_quantiles(rows, names))
    by_k = intervals.fit_residual_quantiles(rows, ["k"]).select(F.col("k").alias("_k"), "_lo", "_hi")
    both = fitted.join(F.broadcast(by_k), fitted["k"].eqNullSafe(by_k["_k"]))  # one row a regime
    e, p = F.col("y") - F.col("yhat"), len(names) + 1

    def loss(q, tau):
        return F.sum(F.greatest(tau * (e - q), (tau - 1) * (e - q)))

    checks = {}
    for name, bound, regime_q, tau in (("low", "lower", "_lo", 0.025), ("high", "upper", "_hi", 0.975)):
        q = F.col(bound) - F.col("yhat")
        # Rows on the line, which the fit passes within its tolerance, may count on either side.
        near = F.lit(1e-4) * F.max(F.abs(e))
        checks[f"{name}_share_holds"] = F.abs(F.count_if(e < q) - tau * F.count(F.lit(1))) <= p
        checks[f"{name}_loss_holds"] = loss(q, tau) <= loss(F.col(regime_q), tau) + near
    return both.agg(F.count(F.lit(1)).alias("total_rows"), *[c.alias(n) for n, c in checks.items()])


@query(
    "int4_residual_quantile",
    """SELECT event_type, ts, round(yhat + lo, 6) + 0.0 AS lower, round(yhat + hi, 6) + 0.0 AS upper FROM interval_inputs
       JOIN (SELECT event_type, k, quantile_cont(y - yhat, 0.025) AS lo, quantile_cont(y - yhat, 0.975) AS hi
            FROM interval_inputs GROUP BY 1, 2) USING (event_type, k)""",
)
def _(v):
    groups = ["event_type", "k"]
    params = intervals.fit_residual_quantiles(v.interval_inputs, groups)
    return _bounds(intervals.residual_quantile(v.interval_inputs, groups, params))


@query("int5_bootstrap")
def _(v):
    params = intervals.fit_residual_spread(v.interval_inputs, TYPE)
    return intervals.bootstrap(v.interval_inputs, TYPE, ROW, params).select("event_type", "ts", "yhat", *BOUNDS)


@query("int6_residual_spread", "SELECT event_type, round(s, 6) AS residual_std FROM residual_std")
def _(v):
    return _r(intervals.fit_residual_spread(v.interval_inputs, TYPE))


@query(
    "int7_calibrate_gamma",
    """SELECT event_type, round(g, 6) AS gamma, 0.9::DOUBLE AS target_coverage, round(err, 6) AS coverage_error FROM (
        SELECT event_type, g, abs(avg((y >= yhat - g * sigma AND y <= yhat + g * sigma)::INTEGER) - 0.9) AS err
        FROM interval_inputs, (SELECT 0.5::DOUBLE + i * (2.5::DOUBLE / 19) AS g FROM range(20) r(i)) GROUP BY 1, 2)
       QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY err, g) = 1""",
)
def _(v):
    return _r(intervals.calibrate_gamma(v.interval_inputs, TYPE, target=0.9))


COVER = "avg((y >= lower AND y <= upper)::INTEGER)"
WIDTH = "avg(upper - lower)"
SPAN = "(max(y) - min(y))"
CWC_EXP = f"{WIDTH} / {SPAN} * (1 + 0.1 * exp(-0.1 * ({COVER} - 0.95)))"


@query(
    "int8_interval_quality",
    "SELECT event_type, model, "
    + _sql({"coverage": COVER, "average_width": WIDTH, "normalized_width": f"{WIDTH} / {SPAN}", "cwc": CWC_EXP})
    + ", 0.95::DOUBLE AS target_coverage FROM pred_pairs GROUP BY 1, 2",
)
def _(v):
    return _r(intervals.quality(v.pred_pairs, PAIR))


@query(
    "mdl4_constant_uncertainty",
    """SELECT event_type, ts, model, round(s, 6) AS sigma FROM pred_pairs
       JOIN (SELECT event_type, model, stddev_pop(yhat) * 0.1 AS s FROM pred_pairs GROUP BY 1, 2) USING (event_type, model)""",
)
def _(v):
    return _r(intervals.constant_uncertainty(v.pred_pairs, PAIR).select(*ROW, "model", "sigma"))


@query("mdl5_normal_interval", _interval_sql(f"{normal_quantile(0.95)!r} * sigma"))
def _(v):
    return _bounds(intervals.normal_interval(v.interval_inputs, 0.95))


# --- metrics --------------------------------------------------------------------------------

POINT = {
    "rmse": "sqrt(avg((y - yhat)^2))",
    "mae": "avg(abs(y - yhat))",
    "mape": "avg(abs((y - yhat) / y)) FILTER (y <> 0) * 100",
    "smape": "avg(abs(y - yhat) / ((abs(y) + abs(yhat)) / 2)) FILTER (abs(y) + abs(yhat) <> 0) * 100",
    "r2": "1 - sum((y - yhat)^2) / (count(*) * var_pop(y))",
    "mbe": "avg(yhat - y)",
    "nrmse": f"sqrt(avg((y - yhat)^2)) / {SPAN}",
    "cv_rmse": "sqrt(avg((y - yhat)^2)) / avg(y) * 100",
}
SCORE = "avg((upper - lower) + {w} * (greatest(lower - y, 0) + greatest(y - upper, 0)))"
INTERVAL = {
    "picp": COVER,
    "pinaw": f"{WIDTH} / {SPAN}",
    "cwc": f"{WIDTH} / {SPAN} + 50 * greatest(0.95 - {COVER}, 0)",
    "ace": f"abs({COVER} - 0.95)",
    "interval_score": SCORE.format(w="0.1::DOUBLE"),
}


def _metric_query(name: str, columns: dict[str, str], build):
    @query(name, f"SELECT event_type, model, {_sql(columns)} FROM pred_pairs GROUP BY 1, 2")
    def _(v):
        return _r(build(v).select(*PAIR, *columns))


def _pick(names, source):
    _metric_query(source[0], {n: source[1][n] for n in names}, source[2])


for _name, _cols in (
    ("met1_rmse_mae_mbe", ("rmse", "mae", "mbe")),
    ("met2_mape", ("mape",)),
    ("met3_smape", ("smape",)),
    ("met4_r2", ("r2",)),
    ("met5_normalised_rmse", ("nrmse", "cv_rmse")),
):
    _pick(_cols, (_name, POINT, lambda v: metrics.point(v.pred_pairs, PAIR)))
for _name, _cols in (
    ("met6_picp", ("picp",)),
    ("met7_pinaw", ("pinaw",)),
    ("met8_cwc_linear", ("cwc",)),
    ("met10_ace", ("ace",)),
    ("met11_interval_score", ("interval_score",)),
):
    _pick(_cols, (_name, INTERVAL, lambda v: metrics.interval(v.pred_pairs, PAIR)))
_metric_query(
    "met9_cwc_exponential", {"cwc": CWC_EXP}, lambda v: metrics.interval(v.pred_pairs, PAIR, cwc="exponential")
)
_metric_query(
    "met11_interval_score_standard",
    {"interval_score": SCORE.format(w="40.0::DOUBLE")},
    lambda v: metrics.interval(v.pred_pairs, PAIR, score="standard"),
)
_metric_query(
    "mdl6_model_score",
    {n: POINT[n] for n in ("rmse", "mae", "mape", "r2")},
    lambda v: metrics.point(v.pred_pairs, PAIR),
)

define_view(
    "directions",
    """SELECT event_type, model, avg(((dy > 0) = (dp > 0))::INTEGER) AS da FROM (SELECT event_type, model, y - lag(y) OVER w AS dy,
        yhat - lag(yhat) OVER w AS dp FROM pred_pairs WINDOW w AS (PARTITION BY event_type, model ORDER BY ts)) GROUP BY 1, 2""",
)


@query("met12_directional_accuracy", "SELECT event_type, model, round(da, 6) AS directional_accuracy FROM directions")
def _(v):
    return _r(metrics.directional_accuracy(v.pred_pairs, PAIR, ["ts"]))


QUANTILES = {f"error_q{p}": f"quantile_cont(abs(y - yhat), {p / 100})" for p in (10, 25, 50, 75, 90)}
_metric_query("met13_error_quantiles", QUANTILES, lambda v: metrics.error_quantiles(v.pred_pairs, PAIR))


@query(
    "met14_seasonal",
    f"""SELECT event_type, model, season, {_sql(POINT)} FROM (SELECT *, (i // (n // 4 + 1))::INTEGER AS season FROM (SELECT *,
        row_number() OVER (PARTITION BY event_type, model ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY event_type, model) AS n
        FROM pred_pairs)) GROUP BY 1, 2, 3""",
)
def _(v):
    return _r(metrics.seasonal(v.pred_pairs, PAIR, ["ts"]))


@query("met14_by_weekday", f"SELECT event_type, model, (isodow(ts) - 1)::INTEGER AS season, {_sql(POINT)} FROM pred_pairs GROUP BY 1, 2, 3")
def _(v):
    return _r(metrics.seasonal(v.pred_pairs.withColumn("season", F.weekday("ts")), PAIR, ["ts"], "season"))


SUMMARY = {
    "n_samples": "count(*)::DOUBLE",
    "y_mean": "avg(y)",
    "y_std": "stddev_pop(y)",
    "yhat_mean": "avg(yhat)",
    "yhat_std": "stddev_pop(yhat)",
    "correlation": "corr(y, yhat)",
}
ALL = {**POINT, **SUMMARY, **INTERVAL, **QUANTILES}


@query(
    "met15_comprehensive",
    f"""WITH wide AS (SELECT event_type, model, {_sql(ALL)} FROM pred_pairs GROUP BY 1, 2),
        full_wide AS (SELECT wide.*, round(da, 6) AS directional_accuracy FROM wide JOIN directions USING (event_type, model))
       UNPIVOT full_wide ON COLUMNS(* EXCLUDE (event_type, model)) INTO NAME metric VALUE "value" """,
)
def _(v):
    wide = metrics.comprehensive(v.pred_pairs, PAIR, ["ts"])
    return _r(metrics.tidy(wide, PAIR), "value")


@query(
    "iev1_coverage_bands",
    """SELECT event_type, model, round(avg((y < lower)::INTEGER), 6) AS under_coverage, round(avg((y > upper)::INTEGER), 6) AS over_coverage, """
    + ", ".join(
        f"round(avg((y >= lower AND y <= upper)::INTEGER) FILTER (y BETWEEN e[{b + 1}] AND e[{b + 2}]), 6) AS band_{b + 1}" for b in range(5)
    )
    + """ FROM pred_pairs JOIN (SELECT event_type, model, quantile_cont(y, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM pred_pairs GROUP BY 1, 2)
       USING (event_type, model) GROUP BY 1, 2""",
)
def _(v):
    return _r(metrics.coverage_bands(v.pred_pairs, PAIR))


_metric_query(
    "iev2_width_stats",
    {
        "mean_width": WIDTH, "std_width": "stddev_pop(upper - lower)", "min_width": "min(upper - lower)",
        "max_width": "max(upper - lower)", "median_width": "quantile_cont(upper - lower, 0.5)",
        "relative_width": f"{WIDTH} / {SPAN}", "width_cv": f"stddev_pop(upper - lower) / {WIDTH}",
    },
    lambda v: metrics.width_stats(v.pred_pairs, PAIR),
)

define_view(
    "adaptive_rows",
    """SELECT event_type, ts, y, round(yhat - s * (1 + indeterminacy), 6) AS lower, round(yhat + s * (1 + indeterminacy), 6) AS upper
       FROM interval_inputs JOIN residual_std USING (event_type)""",
)


@query(
    "iev3_calibration",
    """WITH b AS (SELECT event_type, least(i // (n // 10), 9) AS bin, avg((y >= lower AND y <= upper)::INTEGER) AS c FROM (SELECT *,
            row_number() OVER (PARTITION BY event_type ORDER BY upper - lower, ts) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n
            FROM adaptive_rows) GROUP BY 1, 2)
       SELECT event_type, """
    + ", ".join(f"round(max(c) FILTER (bin = {b}), 6) AS coverage_bin_{b + 1}" for b in range(10))
    + ", round(avg((c - 0.95)^2), 6) AS reliability FROM b GROUP BY 1",
)
def _(v):
    params = intervals.fit_residual_spread(v.interval_inputs, TYPE)
    rows = intervals.adaptive(v.interval_inputs, TYPE, params, gamma=1.0)
    rows = rows.withColumns({c: F.round(c, 6) for c in BOUNDS})
    return _r(metrics.calibration(rows, TYPE, ["ts"]))


EXP_SCORES = {**INTERVAL, "cwc": CWC_EXP}
define_view("method_scores", f"SELECT event_type, model, {', '.join(f'{s} AS {n}' for n, s in EXP_SCORES.items())} FROM pred_pairs GROUP BY 1, 2")


def _ranked(source: str, measures, descending) -> str:
    return " UNION ALL ".join(
        f"""SELECT event_type, '{m}' AS metric, model, round({m}, 6) AS "value",
            row_number() OVER (PARTITION BY event_type ORDER BY {'-' if m in descending else ''}{m}, model)::INTEGER AS "rank" FROM {source}"""
        for m in measures
    )


@query("iev4_method_ranking", _ranked("method_scores", EXP_SCORES, ("picp",)))
def _(v):
    return _r(metrics.compare_interval_methods(v.pred_pairs, TYPE, "model"), "value")


@query(
    "iev4_method_summary",
    """SELECT event_type, first(model ORDER BY picp DESC, model) AS best_coverage, first(model ORDER BY pinaw, model) AS narrowest, round(min(picp), 6) AS coverage_min,
        round(max(picp), 6) AS coverage_max, round(min(pinaw), 6) AS width_min, round(max(pinaw), 6) AS width_max FROM method_scores GROUP BY 1""",
)
def _(v):
    return _r(metrics.interval_method_summary(v.pred_pairs, TYPE, "model"))


@query(
    "eva1_residual_analysis",
    """WITH e AS (SELECT event_type, model, ts, y - yhat AS e, lag(y - yhat) OVER (PARTITION BY event_type, model ORDER BY ts) AS l FROM pred_pairs)
       SELECT event_type, model, round(avg(e), 6) + 0.0 AS mean, round(stddev_pop(e), 6) AS std,
        round((avg(e^3) - 3 * avg(e) * avg(e^2) + 2 * avg(e)^3) / stddev_pop(e)^3, 6) + 0.0 AS skewness,
        round(kurtosis_pop(e), 6) AS kurtosis, round(corr(e, l), 6) AS autocorr_lag1 FROM e GROUP BY 1, 2""",
)
def _(v):
    return _r(metrics.residual_analysis(v.pred_pairs, PAIR, ["ts"]))


_LAGS = range(1, 11)


@query(
    "eva2_ljung_box",
    f"""WITH d AS (SELECT event_type, model, ts, y - yhat - avg(y - yhat) OVER (PARTITION BY event_type, model) AS d FROM pred_pairs),
        l AS (SELECT *, {', '.join(f'lag(d, {k}) OVER w AS d{k}' for k in _LAGS)} FROM d WINDOW w AS (PARTITION BY event_type, model ORDER BY ts)),
        q AS (SELECT event_type, model, count(*) * (count(*) + 2) * ({' + '.join(f'(sum(d * d{k}) / sum(d * d))^2 / (count(*) - {k})' for k in _LAGS)}) AS q
            FROM l GROUP BY 1, 2)
       SELECT event_type, model, round(q, 6) AS statistic,
        round(exp(-q / 2) * (1 + q / 2 + (q / 2)^2 / 2 + (q / 2)^3 / 6 + (q / 2)^4 / 24), 6) + 0.0 AS p_value FROM q""",
)
def _(v):
    return _r(metrics.ljung_box(v.pred_pairs, PAIR, ["ts"]))


_metric_query(
    "eva3_error_distribution",
    {
        "max_error": "max(abs(y - yhat))", "min_error": "min(abs(y - yhat))", "error_variance": "var_pop(y - yhat)",
        **{f"p{p}": f"quantile_cont(abs(y - yhat), {p / 100})" for p in (5, 25, 50, 75, 95)},
    },
    lambda v: metrics.error_distribution(v.pred_pairs, PAIR),
)

EVA = {**{m: POINT[m] for m in ("rmse", "mae", "mape", "r2")}, **{m: INTERVAL[m] for m in ("picp", "pinaw", "cwc", "interval_score")}}
define_view("model_scores", f"SELECT event_type, model, {', '.join(f'{s} AS {n}' for n, s in EVA.items())} FROM pred_pairs GROUP BY 1, 2")
RANKED = _ranked("model_scores", EVA, ("picp", "r2"))


@query("eva4_compare_models", RANKED)
def _(v):
    return _r(metrics.compare_models(v.pred_pairs, TYPE, "model"), "value")


@query("srt2_top_models", f"""SELECT * FROM ({RANKED}) WHERE "rank" <= 2""")
def _(v):
    return _r(metrics.top_models(metrics.compare_models(v.pred_pairs, TYPE, "model"), 2), "value")


# --- ensembles ------------------------------------------------------------------------------


@query(
    "ens1_average",
    """SELECT event_type, ts, round(avg(yhat), 6) AS yhat, round(sqrt(avg(abs(yhat) * 0.1)^2 + var_pop(yhat)), 6) AS sigma
       FROM pred_pairs GROUP BY 1, 2""",
)
def _(v):
    return _r(ensemble.average(v.ensemble_rows, ROW).select(*ROW, "yhat", "sigma"))


define_view("model_rmse", "SELECT event_type, model, avg((y - yhat)^2) AS mse, sqrt(avg((y - yhat)^2)) AS rmse FROM pred_pairs GROUP BY 1, 2")
define_view("model_weights", "SELECT event_type, model, (1 / rmse) / sum(1 / rmse) OVER (PARTITION BY event_type) AS weight FROM model_rmse")


@query(
    "ens2_weighted",
    """SELECT event_type, ts, round(sum(weight * yhat) / sum(weight), 6) AS yhat,
        round(sqrt(sum(weight * (yhat * 0.1)^2) / sum(weight)), 6) AS sigma
       FROM pred_pairs JOIN model_weights USING (event_type, model) GROUP BY 1, 2""",
)
def _(v):
    weights = ensemble.inverse_rmse_weights(v.ensemble_rows, TYPE)
    return _r(ensemble.weighted(v.ensemble_rows, ROW, weights, TYPE).select(*ROW, "yhat", "sigma"))


@query("ens3_inverse_rmse_weights", "SELECT event_type, model, round(weight, 6) AS weight FROM model_weights")
def _(v):
    return _r(ensemble.inverse_rmse_weights(v.ensemble_rows, TYPE))


@query("ens5_model_performance", "SELECT event_type, model, round(mse, 6) AS mse, round(rmse, 6) AS rmse FROM model_rmse")
def _(v):
    return _r(ensemble.performance(v.ensemble_rows, TYPE))


# --- significance ---------------------------------------------------------------------------


def _dm(power: int) -> str:
    return f"SELECT event_type, ts, abs(y - lag1)^{power} - abs(y - mean24)^{power} AS d FROM lagged"


def _pairs(v):
    return sig.paired_errors(v.pred_pairs, ROW, "lag1", "mean24")


@query(
    "tst1_diebold_mariano",
    f"SELECT event_type, count(*) AS n, round(avg(d) / sqrt(var_samp(d) / count(*)), 6) AS statistic FROM ({_dm(2)}) GROUP BY 1",
)
def _(v):
    return _r(sig.diebold_mariano(_pairs(v), TYPE, ["ts"], p_values=False))


@query(
    "tst1_diebold_mariano_horizon",
    f"""SELECT event_type, count(*) AS n, round(avg(d) / sqrt(var_samp(d) * (1 + 2 * (corr(d, d1) + corr(d, d2))) / count(*)), 6) AS statistic
       FROM (SELECT *, lag(d) OVER w AS d1, lag(d, 2) OVER w AS d2 FROM ({_dm(1)}) WINDOW w AS (PARTITION BY event_type ORDER BY ts)) GROUP BY 1""",
)
def _(v):
    return _r(sig.diebold_mariano(_pairs(v), TYPE, ["ts"], horizon=3, power=1, p_values=False))


@query(
    "tst2_modified_diebold_mariano",
    f"""SELECT event_type, n, round(s, 6) AS original_statistic, round(sqrt((n - 1.0) / n), 6) AS correction,
        round(s * sqrt((n - 1.0) / n), 6) AS statistic
       FROM (SELECT event_type, count(*) AS n, avg(d) / sqrt(var_samp(d) / count(*)) AS s FROM ({_dm(2)}) GROUP BY 1)""",
)
def _(v):
    return _r(sig.modified_diebold_mariano(_pairs(v), TYPE, ["ts"], p_values=False))


def normal_tail_sql(z: str) -> str:
    """Two-sided normal tail as SQL: one less twice the density times the sum of x^(2k+1) / (2k+1)!!."""
    x = f"greatest(abs({z}), 1e-12)"
    term = f"exp((2 * k + 1) * ln({x}) + k * ln(2.0) + lgamma(k + 1) - lgamma(2 * k + 2))"
    return f"(1 - 2 * exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 150), lambda k: {term})))"


TST1_STAT = f"SELECT event_type, avg(d) / sqrt(var_samp(d) / count(*)) AS z FROM ({_dm(2)}) GROUP BY 1"


@query(
    "tst1_p_values",
    f"""SELECT event_type, round(p, 6) AS p_value, p < 0.05 AS significant
        FROM (SELECT event_type, {normal_tail_sql('z')} AS p FROM ({TST1_STAT}))""",
)
def _(v):
    out = sig.diebold_mariano(_pairs(v), TYPE, ["ts"])
    return _r(out.select("event_type", "p_value", "significant"))


TST3_STAT = """WITH d AS (SELECT event_type, d, abs(d) AS a FROM (SELECT event_type, abs(y - lag1) - abs(y - mean24) AS d FROM lagged) WHERE d <> 0),
        r AS (SELECT event_type, d, rank() OVER (PARTITION BY event_type ORDER BY a) + (count(*) OVER (PARTITION BY event_type, a) - 1) / 2.0 AS r,
            count(*) OVER (PARTITION BY event_type, a) AS t FROM d),
        s AS (SELECT event_type, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS p, coalesce(sum(r) FILTER (d < 0), 0) AS m,
            sum(t * t - 1)::DOUBLE AS tied FROM r GROUP BY 1),
        z AS (SELECT event_type, (least(p, m) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - tied / 48) AS z FROM s)"""


@query(
    "tst3_p_values",
    f"""{TST3_STAT} SELECT event_type, round(p, 6) AS p_value, p < 0.05 AS significant
        FROM (SELECT event_type, {normal_tail_sql('z')} AS p FROM z)""",
)
def _(v):
    return _r(sig.wilcoxon(_pairs(v), TYPE).select("event_type", "p_value", "significant"))


def student_tail_sql(t: str, df: str) -> str:
    """Two-sided Student tail for whole degrees: the finite sums for even and odd degrees by gamma functions."""
    c = f"({df} / ({df} + ({t}) * ({t})))"
    sine = f"(abs({t}) / sqrt({df} + ({t}) * ({t})))"
    even = f"list_sum(list_transform(range(0, ({df} // 2)::BIGINT), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0) + k * ln({c})) / sqrt(pi())))"
    odd = f"list_sum(list_transform(range(0, (({df} - 1) // 2)::BIGINT), lambda k: exp(lgamma(k + 1.0) - lgamma(k + 1.5) + k * ln({c})) * sqrt(pi()) / 2)) * sqrt({c})"
    return f"greatest(1 - CASE WHEN {df} % 2 = 0 THEN {sine} * {even} ELSE (atan(abs({t}) / sqrt({df})) + {sine} * {odd}) * 2 / pi() END, 0)"


@query(
    "tst2_modified_p_values",
    f"""WITH s AS (SELECT event_type, count(*) AS n, avg(d) / sqrt(var_samp(d) * (1 + 2 * corr(d, d1)) / count(*)) AS s
            FROM (SELECT *, lag(d) OVER (PARTITION BY event_type ORDER BY ts) AS d1 FROM ({_dm(2)})) GROUP BY 1),
        c AS (SELECT *, sqrt((n - 3 + 2.0 / n) / n) AS c, s * sqrt((n - 3 + 2.0 / n) / n) AS t FROM s),
        p AS (SELECT *, {student_tail_sql('t', '(n - 1)')} AS p FROM c)
       SELECT event_type, n, round(s, 6) AS original_statistic, round(c, 6) AS correction, round(t, 6) AS statistic,
        round(p, 6) AS p_value, p < 0.05 AS significant FROM p""",
)
def _(v):
    return _r(sig.modified_diebold_mariano(_pairs(v), TYPE, ["ts"], horizon=2))


@query(
    "tst3_wilcoxon",
    """WITH d AS (SELECT event_type, d, abs(d) AS a FROM (SELECT event_type, abs(y - lag1) - abs(y - mean24) AS d FROM lagged) WHERE d <> 0),
        r AS (SELECT event_type, d, rank() OVER (PARTITION BY event_type ORDER BY a) + (count(*) OVER (PARTITION BY event_type, a) - 1) / 2.0 AS r,
            count(*) OVER (PARTITION BY event_type, a) AS t FROM d),
        s AS (SELECT event_type, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS p, coalesce(sum(r) FILTER (d < 0), 0) AS m,
            sum(t * t - 1)::DOUBLE AS tied FROM r GROUP BY 1)
       SELECT event_type, n, round(least(p, m), 6)::DOUBLE AS statistic,
        round((least(p, m) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - tied / 48), 6) AS z FROM s""",
)
def _(v):
    return _r(sig.wilcoxon(_pairs(v), TYPE, p_values=False))


RANKS = """SELECT event_type, ts, model, rank() OVER (PARTITION BY event_type, ts ORDER BY abs(y - yhat))
    + (count(*) OVER (PARTITION BY event_type, ts, abs(y - yhat)) - 1) / 2.0 AS r,
    count(*) OVER (PARTITION BY event_type, ts, abs(y - yhat)) AS t FROM pred_pairs"""


@query(
    "tst4_friedman",
    f"""WITH r AS ({RANKS}), m AS (SELECT event_type, model, sum(r) AS s, count(*) AS n, sum(t * t - 1) AS tied FROM r GROUP BY 1, 2),
        q AS (SELECT event_type, max(n) AS n, (12.0 / (max(n) * 3 * 4) * sum(s * s) - 3.0 * max(n) * 4) / (1 - sum(tied) / (max(n) * 3 * 8.0)) AS x
            FROM m GROUP BY 1)
       SELECT event_type, n, round(x, 6)::DOUBLE AS statistic, round(exp(-x / 2), 6)::DOUBLE AS p_value, exp(-x / 2) < 0.05 AS significant FROM q""",
)
def _(v):
    return _r(sig.friedman(v.pred_pairs, TYPE, ROW, list(MODELS)))


@query(
    "tst4_mean_ranks",
    f"SELECT event_type, model, round(avg(r), 6)::DOUBLE AS mean_rank, count(*) AS n FROM ({RANKS}) GROUP BY 1, 2",
)
def _(v):
    return _r(sig.friedman_ranks(v.pred_pairs, TYPE, ROW))


# One p-value per event type and weekday: the two-sided tail of a chi-squared statistic with two
# degrees of freedom, which both engines write as exp(-x / 2).
define_view(
    "weekday_p",
    """SELECT event_type, (isodow(ts) - 1)::INTEGER AS day, round(exp(-count(*) * avg(y - mean24)^2 / var_samp(y - mean24) / 2), 9) AS p_value
       FROM lagged GROUP BY 1, 2""",
)


def _weekday_p(v):
    e = F.col("y") - F.col("mean24")
    x = F.count(F.lit(1)) * F.avg(e) * F.avg(e) / F.var_samp(e)
    out = v.lagged.groupBy("event_type", F.weekday("ts").alias("day")).agg(F.exp(-x / 2).alias("p_value"))
    return out.withColumn("p_value", F.round("p_value", 9))


def _corrected_query(name: str, rule: str, method: str):
    @query(
        name,
        f"""SELECT event_type, day, p_value, round(least({rule}, 1.0), 6) + 0.0 AS corrected_p, least({rule}, 1.0) < 0.05 AS significant
            FROM (SELECT *, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY p_value, day) AS i
            FROM weekday_p)""",
    )
    def _(v):
        out = sig.correct_p_values(_weekday_p(v), TYPE, method=method, tie_break=["day"])
        return _r(out, "corrected_p")


_corrected_query("tst5_bonferroni", "p_value * n", "bonferroni")
_corrected_query("tst5_holm", "p_value * (n - i + 1)", "holm")
_corrected_query("tst5_benjamini_hochberg", "p_value * n / i", "fdr_bh")


@query(
    "tst5_holm_monotone",
    """SELECT event_type, day, p_value, round(c, 6) + 0.0 AS corrected_p, c < 0.05 AS significant FROM (SELECT *,
        max(least(p_value * (n - i + 1), 1.0)) OVER (PARTITION BY event_type ORDER BY i) AS c FROM (SELECT *, count(*) OVER (PARTITION BY event_type) AS n,
        row_number() OVER (PARTITION BY event_type ORDER BY p_value, day) AS i FROM weekday_p))""",
)
def _(v):
    out = sig.correct_p_values(_weekday_p(v), TYPE, method="holm", tie_break=["day"], monotone=True)
    return _r(out, "corrected_p")


@query(
    "tst6_against_reference",
    """WITH d AS (SELECT event_type, 'lag1' AS model, abs(y - mean24)^2 - abs(y - lag1)^2 AS d FROM lagged
            UNION ALL SELECT event_type, 'lag24', abs(y - mean24)^2 - abs(y - lag24)^2 FROM lagged)
       SELECT event_type, model, n, round(s, 6) AS original_statistic, round(sqrt((n - 1.0) / n), 6) AS correction,
        round(s * sqrt((n - 1.0) / n), 6) AS statistic
       FROM (SELECT event_type, model, count(*) AS n, avg(d) / sqrt(var_samp(d) / count(*)) AS s FROM d GROUP BY 1, 2)""",
)
def _(v):
    return _r(sig.against_reference(v.pred_pairs, TYPE, ROW, "mean24", p_values=False))


@query(
    "tst6_against_reference_holm",
    f"""WITH d AS (SELECT event_type, 'lag1' AS model, abs(y - mean24)^2 - abs(y - lag1)^2 AS d FROM lagged
            UNION ALL SELECT event_type, 'lag24', abs(y - mean24)^2 - abs(y - lag24)^2 FROM lagged),
        s AS (SELECT event_type, model, count(*) AS n, avg(d) / sqrt(var_samp(d) / count(*)) AS s FROM d GROUP BY 1, 2),
        c AS (SELECT *, sqrt((n - 1.0) / n) AS c, s * sqrt((n - 1.0) / n) AS t FROM s),
        p AS (SELECT *, {student_tail_sql('t', '(n - 1)')} AS p FROM c),
        h AS (SELECT *, least(p * (3 - row_number() OVER (PARTITION BY event_type ORDER BY p, model)), 1) AS h FROM p)
       SELECT event_type, model, n, round(s, 6) AS original_statistic, round(c, 6) AS correction, round(t, 6) AS statistic,
        round(p, 6) AS p_value, round(h, 6) AS corrected_p, h < 0.05 AS significant FROM h""",
)
def _(v):
    return _r(sig.against_reference(v.pred_pairs, TYPE, ROW, "mean24"))
