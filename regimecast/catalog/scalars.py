"""Sources, timestamp parsing, calendar parts and row-level transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from regimecast.catalog.registry import query, rounded
from regimecast.functions import calendar as cal
from regimecast.functions import scalars as sc
from regimecast.functions import vectors as vec
from regimecast.operators import features, normalise
from regimecast.sources import tables


@query(
    "src1_standard_series",
    "SELECT event_type, ts, value AS y FROM events",
)
def _(v):
    return tables.standardise(v.table("events"), "ts", "value", keep=["event_type"])


@query(
    "src2_scoped_scan",
    """SELECT ts, value AS y FROM events WHERE event_type = 'purchase'
       AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'""",
)
def _(v):
    scoped = tables.scoped(
        v.table("events"), "ts", "2024-01-05", "2024-01-20", event_type="purchase"
    )
    return scoped.select("ts", F.col("value").alias("y"))


@query(
    "dt1_mixed_day_first",
    """SELECT id, CASE WHEN mixed LIKE '____-%' THEN strptime(mixed, '%Y-%m-%d %H:%M:%S')
        WHEN mixed LIKE '__-%' THEN strptime(mixed, '%d-%m-%Y %H:%M')
        ELSE strptime(mixed, '%d/%m/%Y %H:%M') END AS ts FROM raw_strings""",
)
def _(v):
    return v.raw_strings.select("id", cal.parse_mixed("mixed").alias("ts"))


@query(
    "dt2_fixed_formats",
    """SELECT id, strptime(d1, '%d-%m-%Y %H:%M') AS a, strptime(d2, '%Y%m%d %H:%M') AS b,
        strptime(d3, '%Y-%m-%dT%H:%M:%S') AS c FROM raw_strings""",
)
def _(v):
    return v.raw_strings.select(
        "id",
        cal.parse_fixed("d1", "dd-MM-yyyy HH:mm").alias("a"),
        cal.parse_fixed("d2", "yyyyMMdd HH:mm").alias("b"),
        cal.parse_fixed("d3", "yyyy-MM-dd'T'HH:mm:ss").alias("c"),
    )


@query(
    "dt3_date_plus_hour",
    "SELECT id, day::TIMESTAMP + to_hours(h - 1) AS ts FROM raw_strings",
)
def _(v):
    return v.raw_strings.select("id", cal.date_plus_hour("day", "h").alias("ts"))


@query(
    "dt4_from_parts",
    """SELECT event_id, make_timestamp(year(ts), month(ts), day(ts), hour(ts), minute(ts), 0.0) AS at
       FROM events""",
)
def _(v):
    ts = F.col("ts")
    at = cal.from_parts(F.year(ts), F.month(ts), F.day(ts), F.hour(ts), F.minute(ts))
    return v.table("events").select("event_id", at.alias("at"))


@query(
    "dt5_calendar_parts",
    """SELECT event_id, hour(ts)::INTEGER AS hour, (isodow(ts) - 1)::INTEGER AS day_of_week,
        dayofyear(ts)::INTEGER AS day_of_year, month(ts)::INTEGER AS month,
        quarter(ts)::INTEGER AS quarter, year(ts)::INTEGER AS year FROM events""",
)
def _(v):
    return v.table("events").select(
        "event_id", *[c.alias(n) for n, c in cal.calendar_parts("ts").items()]
    )


@query(
    "dt6_weekend_flag",
    "SELECT event_id, (isodow(ts) >= 6)::INTEGER AS is_weekend FROM events",
)
def _(v):
    return v.table("events").select("event_id", cal.is_weekend("ts").alias("is_weekend"))


@query(
    "dt7_cyclical",
    """SELECT event_id,
        round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_cos,
        round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0.0 AS day_of_week_sin,
        round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0.0 AS day_of_week_cos,
        round(sin(2 * pi() * dayofyear(ts) / 365), 6) + 0.0 AS day_of_year_sin,
        round(cos(2 * pi() * dayofyear(ts) / 365), 6) + 0.0 AS day_of_year_cos,
        round(sin(2 * pi() * dayofyear(ts) / 365.25), 6) + 0.0 AS day_sin,
        round(cos(2 * pi() * dayofyear(ts) / 365.25), 6) + 0.0 AS day_cos,
        round(sin(2 * pi() * month(ts) / 12), 6) + 0.0 AS month_sin, round(cos(2 * pi() * month(ts) / 12), 6) + 0.0 AS month_cos
        FROM events""",
)
def _(v):
    both = {**cal.time_features("ts"), **cal.table_time_features("ts")}
    wanted = {n: c for n, c in both.items() if n.endswith(("_sin", "_cos"))}
    return v.table("events").select(
        "event_id", *[rounded(c).alias(n) for n, c in wanted.items()]
    )


@query(
    "dt8_time_span",
    """SELECT event_type, min(ts) AS start_ts, max(ts) AS end_ts,
        round((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0, 6) AS span_days
        FROM events GROUP BY 1""",
)
def _(v):
    first, last = F.min("ts"), F.max("ts")
    return v.table("events").groupBy("event_type").agg(
        first.alias("start_ts"),
        last.alias("end_ts"),
        rounded(cal.span_days(first, last)).alias("span_days"),
    )


@query(
    "prj1_select_rename",
    """SELECT ts AS "timestamp", value AS energy_generation, user_id AS plant FROM events""",
)
def _(v):
    return features.project(
        v.table("events"), {"timestamp": "ts", "energy_generation": "value", "plant": "user_id"}
    )


@query(
    "flt1_preferred_category",
    "SELECT event_id, value FROM events WHERE event_type = 'signup'",
)
def _(v):
    kept = features.preferred_category(v.table("events"), "event_type", "signup", "event_id")
    return kept.select("event_id", "value")


@query(
    "flt1_preferred_category_fallback",
    """SELECT event_id, value FROM events
       WHERE event_type = (SELECT arg_min(event_type, event_id) FROM events)""",
)
def _(v):
    kept = features.preferred_category(v.table("events"), "event_type", "refund", "event_id")
    return kept.select("event_id", "value")


@query(
    "flt2_drop_incomplete",
    "SELECT event_type, ts, y FROM hourly_gappy WHERE y IS NOT NULL",
)
def _(v):
    return v.hourly_gappy.na.drop(how="any", subset=["y"]).select("event_type", "ts", "y")


@query(
    "flt3_numeric_coercion",
    "SELECT id, TRY_CAST(amount AS DOUBLE) AS amount FROM raw_strings",
)
def _(v):
    return v.raw_strings.select("id", features.to_number("amount").alias("amount"))


@query(
    "map1_clip_at_zero",
    "SELECT l_orderkey, l_linenumber, greatest(u, 0.0) AS u FROM uv",
)
def _(v):
    return v.uv.select("l_orderkey", "l_linenumber", sc.clip_below("u").alias("u"))


@query(
    "map2_magnitude_bearing",
    """SELECT l_orderkey, l_linenumber, round(sqrt(u * u + v * v), 6) AS speed,
        round(degrees(atan2(v, u)), 6) + 0.0 AS bearing FROM uv""",
)
def _(v):
    return v.uv.select(
        "l_orderkey",
        "l_linenumber",
        rounded(sc.magnitude("u", "v")).alias("speed"),
        rounded(sc.bearing("u", "v")).alias("bearing"),
    )


@query(
    "map3_degree_sin_cos",
    """SELECT l_orderkey, l_linenumber, round(sin(radians(u * 7.2)), 6) + 0.0 AS dir_sin,
        round(cos(radians(u * 7.2)), 6) + 0.0 AS dir_cos FROM uv""",
)
def _(v):
    circle = sc.degree_circle("dir", F.col("u") * 7.2)
    return v.uv.select(
        "l_orderkey", "l_linenumber", *[rounded(c).alias(n) for n, c in circle.items()]
    )


@query(
    "map4_circular_step",
    """WITH s AS (SELECT event_type, ts, coalesce(least(abs(d - p), 360.0 - abs(d - p)), 0.0) AS step FROM (
            SELECT event_type, ts, d, lag(d) OVER (PARTITION BY event_type ORDER BY ts) AS p
            FROM (SELECT event_type, ts, round(y - 360.0 * floor(y / 360.0), 2) AS d FROM hourly_type)))
        SELECT event_type, ts, round((step - lo) / (hi - lo + 1e-8) * 1000.0, 6) AS output
        FROM s JOIN (SELECT event_type, min(step) AS lo, max(step) AS hi FROM s GROUP BY 1) USING (event_type)""",
)
def _(v):
    y = F.col("y")
    df = v.hourly_type.withColumn("deg", F.round(y - 360.0 * F.floor(y / 360.0), 2))
    out = features.circular_variability(df, ["event_type"], ["ts"], "deg", scale=1000.0, name="output")
    return out.select("event_type", "ts", rounded("output").alias("output"))


@query(
    "map5_band_width",
    "SELECT event_type, ts, model, round(upper - lower, 4) AS width FROM pred_pairs",
)
def _(v):
    return v.pred_pairs.select(
        "event_type", "ts", "model", rounded(features.band_width("lower", "upper"), 4).alias("width")
    )


@query(
    "map6_min_max",
    """SELECT event_type, ts, round(CASE WHEN hi = lo THEN 0 ELSE (y - lo) / (hi - lo) END, 6) AS y_norm
       FROM hourly_type JOIN (SELECT event_type, min(y) AS lo, max(y) AS hi FROM hourly_type GROUP BY 1)
       USING (event_type)""",
)
def _(v):
    params = normalise.fit(v.hourly_type, ["event_type"], "y")
    out = normalise.apply(v.hourly_type, params, ["event_type"], "y", "min_max")
    return out.select("event_type", "ts", rounded("y_norm").alias("y_norm"))


@query(
    "map6_z_score",
    """SELECT user_id, ts, round(CASE WHEN sd = 0 THEN 0 ELSE (y - mu) / sd END, 6) AS y_norm
       FROM hourly_user JOIN (SELECT user_id, avg(y) AS mu, stddev_pop(y) AS sd FROM hourly_user GROUP BY 1)
       USING (user_id)""",
)
def _(v):
    params = normalise.fit(v.hourly_user, ["user_id"], "y")
    out = normalise.apply(v.hourly_user, params, ["user_id"], "y", "z_score")
    return out.select("user_id", "ts", rounded("y_norm").alias("y_norm"))


@query(
    "map7_denormalise",
    """SELECT event_type, ts, round(y, 4) AS y_min_max, round(y, 4) AS y_z FROM hourly_type""",
)
def _(v):
    keys = ["event_type"]
    params = normalise.fit(v.hourly_type, keys, "y")
    df = normalise.apply(v.hourly_type, params, keys, "y", "min_max", name="a")
    df = normalise.apply(df, params, keys, "y", "z_score", name="b")
    df = normalise.invert(df, params, keys, "a", "min_max", name="y_min_max")
    df = normalise.invert(df, params, keys, "b", "z_score", name="y_z")
    return df.select(
        "event_type", "ts", rounded("y_min_max", 4).alias("y_min_max"), rounded("y_z", 4).alias("y_z")
    )


@query(
    "map8_safe_divide",
    "SELECT l_orderkey, l_linenumber, round(CASE WHEN v <> 0 THEN u / v ELSE -1.0 END, 6) AS ratio FROM uv",
)
def _(v):
    return v.uv.select(
        "l_orderkey", "l_linenumber", rounded(sc.safe_divide("u", "v", -1.0)).alias("ratio")
    )


@query(
    "map9_probability_check",
    """SELECT vec_id, (x[1] >= 0 AND x[2] >= 0 AND x[3] >= 0 AND abs(x[1] + x[2] + x[3] - 1.0) <= 1.0) AS ok
       FROM emb_xy""",
)
def _(v):
    first = F.slice("x", 1, 3)
    return v.emb_xy.select("vec_id", vec.is_probability(first, tol=1.0).alias("ok"))


@query(
    "map10_transfer_curve",
    """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity < 3 THEN 0 WHEN l_quantity < 12 THEN (l_quantity - 3) / 9
            WHEN l_quantity < 25 THEN 1 ELSE 0 END, 6) AS output,
        round(l_extendedprice * (1 - 0.7 * l_discount), 6) AS derated FROM lineitem""",
)
def _(v):
    return v.table("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        rounded(sc.transfer_curve("l_quantity")).alias("output"),
        rounded(sc.derate("l_extendedprice", "l_discount")).alias("derated"),
    )
