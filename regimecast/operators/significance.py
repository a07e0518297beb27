"""Significance tests on forecast errors, grouped by series or data set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regimecast.functions.tails import chi2_p_value, normal_p_value, t_p_value
from regimecast.operators import features
from regimecast.operators.ordering import Keys, over_series, running_sums

ALPHA = 0.05


def paired_errors(
    df: DataFrame, row_key: Sequence[str], first: str, second: str
) -> DataFrame:
    """Errors of two models side by side on the rows both have."""
    e = F.col("y") - F.col("yhat")
    wide = df.where(F.col("model").isin(first, second)).groupBy(*row_key).agg(
        F.max(F.when(F.col("model") == first, e)).alias("e1"),
        F.max(F.when(F.col("model") == second, e)).alias("e2"),
    )
    return wide.na.drop(subset=["e1", "e2"])


def _loss(column: str, power: int) -> Column:
    return F.pow(F.abs(F.col(column)), F.lit(float(power)))


def diebold_mariano(
    df: DataFrame,
    keys: Keys,
    order: Sequence[str],
    horizon: int = 1,
    power: int = 2,
    alpha: float = ALPHA,
    p_values: bool = True,
) -> DataFrame:
    """Equal-accuracy statistic of (e1, e2) rows; for longer horizons the variance is scaled by the
    autocorrelations of the loss difference."""
    rows = df.withColumn("_d", _loss("e1", power) - _loss("e2", power))
    ks = range(1, horizon)
    if horizon > 1:
        rows = over_series(
            rows,
            keys,
            [F.col(c) for c in order],
            lambda w: {f"_d{k}": F.lag("_d", k).over(w) for k in ks},
            back=horizon - 1,
        )
    stats = rows.groupBy(*keys).agg(
        F.avg("_d").alias("_m"),
        F.var_samp("_d").alias("_v"),
        F.count("_d").alias("n"),
        *[F.coalesce(F.nanvl(F.corr("_d", f"_d{k}"), F.lit(0.0)), F.lit(0.0)).alias(f"_r{k}") for k in ks],
    )
    spread = F.col("_v")
    if horizon > 1:
        spread = spread * (1 + 2 * sum((F.col(f"_r{k}") for k in ks), F.lit(0.0)))
    spread = spread / F.col("n")
    stat = F.when(spread > 0, F.col("_m") / F.sqrt(F.greatest(spread, F.lit(0.0)))).otherwise(0.0)
    out = stats.select(*keys, "n", stat.alias("statistic"))
    if not p_values:
        return out
    out = out.withColumn("p_value", normal_p_value("statistic"))
    return out.withColumn("significant", F.col("p_value") < alpha)


def modified_diebold_mariano(
    df: DataFrame,
    keys: Keys,
    order: Sequence[str],
    horizon: int = 1,
    power: int = 2,
    alpha: float = ALPHA,
    p_values: bool = True,
) -> DataFrame:
    """Small-sample factor and Student tail on top of the plain statistic."""
    plain = diebold_mariano(df, keys, order, horizon, power, p_values=False)
    n, h = F.col("n"), float(horizon)
    factor = F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)
    out = plain.select(
        *keys,
        "n",
        F.col("statistic").alias("original_statistic"),
        factor.alias("correction"),
        (F.col("statistic") * factor).alias("statistic"),
    )
    if not p_values:
        return out
    out = out.withColumn("p_value", t_p_value("statistic", (n - 1).cast("double")))
    return out.withColumn("significant", F.col("p_value") < alpha)


def wilcoxon(
    df: DataFrame, keys: Keys, alpha: float = ALPHA, p_values: bool = True
) -> DataFrame:
    """Signed-rank test on |e1| - |e2|: zeros dropped, tied ranks averaged, normal approximation.

    Tied values span a block of sorted positions, so their mean rank is the middle of the block.
    """
    d = F.abs("e1") - F.abs("e2")
    rows = df.select(*keys, d.alias("_d")).where(F.col("_d") != 0)
    rows = rows.select(*keys, F.abs("_d").alias("_a"), (F.col("_d") > 0).cast("long").alias("_up"))
    # Equal values are one row before they are ordered.
    ties = rows.groupBy(*keys, "_a").agg(F.sum("_up").alias("_ups"), F.count(F.lit(1)).alias("_t"))
    ties = running_sums(ties, keys, [F.col("_a")], {"_upto": F.col("_t")})
    rank = F.col("_upto") - (F.col("_t") - 1) / 2.0
    t = F.col("_t").cast("double")
    sums = ties.groupBy(*keys).agg(
        F.sum(rank * F.col("_ups")).alias("_plus"),
        F.sum(rank * (F.col("_t") - F.col("_ups"))).alias("_minus"),
        F.sum("_t").cast("double").alias("n"),
        F.sum(t * t * t - t).alias("_tied"),
    )
    n = F.col("n")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_tied") / 48
    stat = F.least("_plus", "_minus")
    z = F.when(var > 0, (stat - n * (n + 1) / 4) / F.sqrt(var)).otherwise(0.0)
    out = sums.select(*keys, n.cast("long").alias("n"), stat.alias("statistic"), z.alias("z"))
    if not p_values:
        return out
    out = out.withColumn("p_value", normal_p_value("z"))
    return out.withColumn("significant", F.col("p_value") < alpha)


def friedman_ranks(df: DataFrame, keys: Keys, row_key: Sequence[str]) -> DataFrame:
    """Mean rank of each model by absolute error within every observation."""
    scored = df.withColumn("_abs", F.abs(F.col("y") - F.col("yhat")))
    ranked = features.tie_averaged_rank(scored, row_key, "_abs", "_rank")
    return ranked.groupBy(*keys, "model").agg(
        F.avg("_rank").alias("mean_rank"), F.count(F.lit(1)).alias("n")
    )


def friedman(
    df: DataFrame, keys: Keys, row_key: Sequence[str], models: Sequence[str], alpha: float = ALPHA
) -> DataFrame:
    """Rank test over at least three models, tie-corrected, on observations every model has."""
    k = len(models)
    if k < 3:
        raise ValueError("the Friedman test needs at least three models")
    scored = df.where(F.col("model").isin(list(models))).withColumn("_abs", F.abs(F.col("y") - F.col("yhat")))
    wide = scored.groupBy(*row_key).agg(
        *[F.max(F.when(F.col("model") == m, F.col("_abs"))).alias(f"_m{j}") for j, m in enumerate(models)]
    ).na.drop(how="any")
    scores = [F.col(f"_m{j}") for j in range(k)]
    # Ranks of a handful of columns: how many are smaller, and half of the other equal ones.
    less = [sum(((b < a).cast("double") for b in scores), F.lit(0.0)) for a in scores]
    same = [sum(((b == a).cast("double") for b in scores), F.lit(0.0)) for a in scores]
    ranks = [lo + (eq + 1.0) / 2.0 for lo, eq in zip(less, same)]
    # A tie of size t appears t times, each time with t*t - 1.
    tied = sum((eq * eq - 1.0 for eq in same), F.lit(0.0))
    sums = wide.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(tied).alias("_tied"), *[F.sum(r).alias(f"_r{j}") for j, r in enumerate(ranks)]
    )
    n = F.col("n")
    squares = sum((F.col(f"_r{j}") * F.col(f"_r{j}") for j in range(k)), F.lit(0.0))
    raw = 12.0 / (n * k * (k + 1)) * squares - 3.0 * n * (k + 1)
    scale = 1.0 - F.col("_tied") / (n * k * (k * k - 1.0))
    out = sums.select(*keys, "n", F.when(scale > 0, raw / scale).alias("statistic"))
    out = out.withColumn("p_value", chi2_p_value(F.col("statistic"), k - 1))
    return out.withColumn("significant", F.col("p_value") < alpha)


def correct_p_values(
    df: DataFrame,
    within: Keys,
    p: str = "p_value",
    method: str = "bonferroni",
    tie_break: Sequence[str] = (),
    monotone: bool = False,
    alpha: float = ALPHA,
) -> DataFrame:
    """Bonferroni, Holm or Benjamini-Hochberg over a family of tests.

    ``monotone`` adds the running maximum (Holm) or minimum from the end (BH).
    """
    family = Window.partitionBy(*(within or [F.lit(0)]))
    by = [F.col(p), *[F.col(c) for c in tie_break]]
    n = F.count(F.lit(1)).over(family)
    i = F.row_number().over(family.orderBy(*by))
    rules = {
        "bonferroni": F.col(p) * n,
        "holm": F.col(p) * (n - i + 1),
        "fdr_bh": F.col(p) * n / i,
    }
    if method not in rules:
        raise ValueError(f"unknown correction {method!r}; known: {sorted(rules)}")
    out = df.withColumns({"_c": F.least(rules[method], F.lit(1.0)), "_i": i})
    if monotone and method == "holm":
        frame = family.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("_c", F.max("_c").over(frame))
    if monotone and method == "fdr_bh":
        frame = family.orderBy(F.col("_i").desc()).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("_c", F.min("_c").over(frame))
    return out.withColumn("corrected_p", F.col("_c")).withColumn("significant", F.col("_c") < alpha).drop("_c", "_i")


def against_reference(
    df: DataFrame,
    keys: Keys,
    row_key: Sequence[str],
    reference: str,
    horizon: int = 1,
    power: int = 2,
    p_values: bool = True,
) -> DataFrame:
    """The modified test of a reference model against every other one, Holm-corrected per group.

    One grouping lines up all models of an observation; no join of the table with itself.
    """
    e = F.col("y") - F.col("yhat")
    wide = df.groupBy(*row_key).agg(
        F.max(F.when(F.col("model") == reference, e)).alias("e1"),
        F.collect_list(F.when(F.col("model") != reference, F.struct("model", e.alias("e2")))).alias("_o"),
    )
    pairs = wide.where(F.col("e1").isNotNull()).select(*row_key, "e1", F.explode("_o").alias("_p"))
    pairs = pairs.select(*row_key, "e1", F.col("_p.model").alias("model"), F.col("_p.e2").alias("e2"))
    order = [c for c in row_key if c not in keys]
    out = modified_diebold_mariano(pairs, [*keys, "model"], order, horizon, power, p_values=p_values)
    return correct_p_values(out, keys, method="holm", tie_break=["model"]) if p_values else out

