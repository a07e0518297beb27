"""Combining the predictions of several models, in the long form (keys, model, y, yhat, sigma)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimecast.operators.ordering import Keys, join_params


def average(df: DataFrame, row_key: Sequence[str]) -> DataFrame:
    """Mean prediction; the uncertainty joins the mean sigma with the spread of the models."""
    return df.groupBy(*row_key).agg(
        F.first("y").alias("y"),
        F.avg("yhat").alias("yhat"),
        F.sqrt(F.pow(F.avg("sigma"), F.lit(2.0)) + F.var_pop("yhat")).alias("sigma"),
    )


def weighted(df: DataFrame, row_key: Sequence[str], weights: DataFrame, weight_keys: Keys = ()) -> DataFrame:
    """Weights per model (and ``weight_keys``), normalised over the models present; a model without
    a weight counts 1, and a zero total falls back to the average."""
    joined = join_params(df, weights, [*weight_keys, "model"]).withColumn(
        "_w", F.coalesce("weight", F.lit(1.0))
    )
    total = F.sum("_w")
    w, yhat, sigma = F.col("_w"), F.col("yhat"), F.col("sigma")
    flat = total == 0
    return joined.groupBy(*row_key).agg(
        F.first("y").alias("y"),
        F.when(flat, F.avg(yhat)).otherwise(F.sum(w * yhat) / F.nullif(total, F.lit(0.0))).alias("yhat"),
        F.sqrt(
            F.when(flat, F.avg(sigma * sigma)).otherwise(F.sum(w * sigma * sigma) / F.nullif(total, F.lit(0.0)))
        ).alias("sigma"),
    )


def performance(df: DataFrame, keys: Keys = ()) -> DataFrame:
    e = F.col("y") - F.col("yhat")
    out = df.groupBy(*keys, "model").agg(F.avg(e * e).alias("mse"))
    return out.withColumn("rmse", F.sqrt("mse"))


def inverse_rmse_weights(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """1 / rmse over the sum of all; a perfect model counts 1 before scaling."""
    from pyspark.sql import Window

    inv = F.when(F.col("rmse") > 0, 1 / F.col("rmse")).otherwise(1.0)
    scored = performance(df, keys).withColumn("_inv", inv)
    # A handful of models per group.
    share = F.col("_inv") / F.sum("_inv").over(Window.partitionBy(*(keys or [F.lit(0)])))
    return scored.select(*keys, "model", share.alias("weight"))


def pivot_models(df: DataFrame, row_key: Sequence[str], models: Sequence[str]) -> DataFrame:
    """One column of predictions per model, in name order; rows lacking a model are dropped."""
    picked = [F.max(F.when(F.col("model") == m, F.col("yhat"))).alias(f"yhat_{m}") for m in sorted(models)]
    return df.groupBy(*row_key).agg(F.first("y").alias("y"), *picked).na.drop(how="any")


def stack(
    train: DataFrame, test: DataFrame, row_key: Sequence[str], models: Sequence[str]
) -> DataFrame:
    """A linear meta-model over the members' predictions; sigma is their spread."""
    cols = [f"yhat_{m}" for m in sorted(models)]
    assembler = VectorAssembler(inputCols=cols, outputCol="_meta", handleInvalid="error")
    fitted = LinearRegression(featuresCol="_meta", labelCol="y", predictionCol="yhat", solver="normal").fit(
        assembler.transform(pivot_models(train, row_key, models))
    )
    wide = pivot_models(test, row_key, models)
    mean = sum((F.col(c) for c in cols), F.lit(0.0)) / len(cols)
    spread = F.sqrt(sum(((F.col(c) - mean) * (F.col(c) - mean) for c in cols), F.lit(0.0)) / len(cols))
    return fitted.transform(assembler.transform(wide)).select(*row_key, "y", "yhat", spread.alias("sigma"))
