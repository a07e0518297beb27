"""Series and prediction frames derived from the given tables.

Amounts are rounded to cents where they are summed, so that later comparisons, ranks and
thresholds do not depend on the order of floating-point addition.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimecast.functions.calendar import hour_number, naive
from regimecast.operators import normalise, regimes
from regimecast.operators.ordering import join_params, over_series
from regimecast.sources.tables import read_table

MODELS = ("lag1", "lag24", "mean24")
Z95 = 1.96
# Given regime centres on the 0..1 scale, hard and soft.
HARD_CENTRES = ((0.1,), (0.3,), (0.6,))
SOFT_CENTRES = ((0.12,), (0.33,), (0.55,))
N_REGIMES = 3


def hour_of(ts: str = "ts"):
    return naive(F.date_trunc("hour", F.col(ts)))


class Views:
    """Lazy frames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    def _hourly(self, *keys: str) -> DataFrame:
        return (
            self.table("events")
            .groupBy(*keys, hour_of().alias("ts"))
            .agg(F.round(F.sum("value"), 2).alias("y"))
        )

    @cached_property
    def hourly_user(self) -> DataFrame:
        return self._hourly("user_id")

    @cached_property
    def hourly_type(self) -> DataFrame:
        return self._hourly("event_type")

    @cached_property
    def hourly_all(self) -> DataFrame:
        return self._hourly()

    @cached_property
    def daily_orders(self) -> DataFrame:
        day = naive(F.date_trunc("day", F.col("o_orderdate")))
        return self.table("orders").groupBy(day.alias("ts")).agg(
            F.round(F.sum("o_totalprice"), 2).alias("y")
        )

    @cached_property
    def hourly_gappy(self) -> DataFrame:
        return self.hourly_type.withColumn("y", F.when(hour_number("ts") % 11 != 3, F.col("y")))

    @cached_property
    def hourly_dirty(self) -> DataFrame:
        """Hours doubled (hour number a multiple of 97) and dropped (a multiple of 53)."""
        hour = hour_number("ts")
        copies = F.when(hour % 97 == 0, F.lit(2)).otherwise(F.lit(1))
        return self.hourly_type.where(hour % 53 != 0).withColumn(
            "copy", F.explode(F.sequence(F.lit(1), copies))
        )

    @cached_property
    def lagged(self) -> DataFrame:
        """Three persistence forecasts per series hour, for hours with a full day behind them."""

        def build(w):
            day = w.rowsBetween(-24, -1)
            return {
                "lag1": F.lag("y", 1).over(w),
                "lag24": F.lag("y", 24).over(w),
                "mean24": F.round(F.avg("y").over(day), 6),
            }

        wide = over_series(self.hourly_type, ["event_type"], [F.col("ts")], build, back=24)
        return wide.where(F.col("lag24").isNotNull())

    @cached_property
    def pred_pairs(self) -> DataFrame:
        """Long predictions (event_type, ts, model, y, yhat, lower, upper), 95 % bounds."""
        wide = self.lagged
        sigma = wide.groupBy("event_type").agg(
            *[F.stddev_pop(F.col("y") - F.col(m)).alias(f"s_{m}") for m in MODELS]
        )
        long = F.explode(
            F.array(
                *[
                    F.struct(F.lit(m).alias("model"), F.col(m).alias("yhat"), F.col(f"s_{m}").alias("s"))
                    for m in MODELS
                ]
            )
        )
        half = F.lit(Z95) * F.col("p.s")
        return (
            join_params(wide, sigma, ["event_type"])
            .select("event_type", "ts", "y", long.alias("p"))
            .select(
                "event_type",
                "ts",
                "p.model",
                "y",
                "p.yhat",
                F.round(F.col("p.yhat") - half, 6).alias("lower"),
                F.round(F.col("p.yhat") + half, 6).alias("upper"),
            )
        )

    @cached_property
    def norm_user(self) -> DataFrame:
        """Hourly activity of each user on the user's own 0..1 scale, as a one-entry vector."""
        keys = ["user_id"]
        scaled = normalise.apply(self.hourly_user, normalise.fit(self.hourly_user, keys, "y"), keys, "y")
        return scaled.withColumn("x", F.array("y_norm"))

    @cached_property
    def tif_user(self) -> DataFrame:
        """Hard label k, memberships u and T, I, F against the given centres."""
        hard = regimes.assign_hard(self.norm_user, "x", HARD_CENTRES)
        soft = regimes.assign_soft(hard, "x", SOFT_CENTRES)
        return regimes.tif(soft, "k", "u", N_REGIMES)

    @cached_property
    def interval_inputs(self) -> DataFrame:
        """One forecast per series hour with model spread sigma, regime k and indeterminacy.

        The regime is that of the last known value on the series' 0..1 scale.
        """
        keys = ["event_type"]
        params = normalise.fit(self.hourly_type, keys, "y")
        rows = normalise.apply(self.lagged, params, keys, "lag1").withColumn("x", F.array("y_norm"))
        rows = regimes.assign_soft(regimes.assign_hard(rows, "x", HARD_CENTRES), "x", SOFT_CENTRES)
        mean = sum((F.col(m) for m in MODELS), F.lit(0.0)) / len(MODELS)
        gaps = [(F.col(m) - mean) * (F.col(m) - mean) for m in MODELS]
        sigma = F.sqrt((gaps[0] + gaps[1] + gaps[2]) / len(MODELS))
        return regimes.tif(rows, "k", "u", N_REGIMES).select(
            "event_type", "ts", "y", F.col("mean24").alias("yhat"), sigma.alias("sigma"), "k", "indeterminacy"
        )

    @cached_property
    def ensemble_rows(self) -> DataFrame:
        """The long predictions with a per-row uncertainty: a tenth of the prediction's size."""
        return self.pred_pairs.select(
            "event_type", "ts", "model", "y", "yhat", (F.abs("yhat") * 0.1).alias("sigma")
        )

    @cached_property
    def emb_xy(self) -> DataFrame:
        return self.table("embeddings").select(
            "vec_id", F.col("embedding").cast("array<double>").alias("x"), "label"
        )

    @cached_property
    def uv(self) -> DataFrame:
        """Signed pairs from order lines; adding zero turns a negative zero into a zero."""
        return self.table("lineitem").select(
            "l_orderkey",
            "l_linenumber",
            (F.col("l_quantity") - 25.0).alias("u"),
            (F.round(F.col("l_tax") * 100.0 - 4.0, 6) + 0.0).alias("v"),
        )

    @cached_property
    def raw_strings(self) -> DataFrame:
        ts = F.col("o_orderdate")
        form = (
            F.when(F.col("o_orderkey") % 3 == 0, F.date_format(ts, "dd-MM-yyyy HH:mm"))
            .when(F.col("o_orderkey") % 3 == 1, F.date_format(ts, "dd/MM/yyyy HH:mm"))
            .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        )
        number = F.when(F.col("o_orderkey") % 7 == 0, F.lit("n/a")).otherwise(
            F.format_string("%.2f", "o_totalprice")
        )
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            form.alias("mixed"),
            F.date_format(ts, "dd-MM-yyyy HH:mm").alias("d1"),
            F.date_format(ts, "yyyyMMdd HH:mm").alias("d2"),
            F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("d3"),
            F.to_date(ts).alias("day"),
            (F.col("o_orderkey") % 24 + 1).cast("int").alias("h"),
            number.alias("amount"),
        )
