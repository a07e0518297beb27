"""Quality rules: counted base rules, then robust multivariate outliers. DataFrame operations only.

Four statistics of a text (word length, symbols, repeated words, repeated lines) are transformed and
compared with the other texts of the same language and source. Centre and covariance of such a group
are minimum-covariance-determinant estimates: starting from medians, the ``SHARE`` of rows with the
smallest distances gives the next centre and covariance, until the determinant stops falling
(C-steps). Texts beyond the chi-square cutoff of the Mahalanobis distance are rejected.

All sums, medians and thresholds are counted over all rows: rows are aggregated to whole-number
values or to distance bins before they are ranked, so neither a hot group nor a hot value gathers
rows in one task. Statistics are whole thousandths, whose sums are exact in any order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regimecast.llm.common import col
from regimecast.session import materialise

#: Base rules.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Share of a group's rows that the estimates rest on, most C-steps, rows a group needs, tail of the cutoff.
SHARE, STEPS, MIN_GROUP, TAIL = 0.75, 8, 50, 1e-6
UNIT = 1000
#: Smallest spread of each transformed statistic, in thousandths. Keeps the covariance regular where
#: most texts share one value, as no repeated line at all.
STATISTICS = {"x_word": 60, "x_symbol": 500, "x_repeat": 60, "x_lines": 250}
_BINS = 64  # distance bins per doubling

_SPACE = r"[\x20\x09-\x0D]"
Let = Callable[[Column], Column]


def _let(value: Column, build: Let) -> Column:
    """``build(x)`` with x evaluated once."""
    return F.transform(F.array(value), build)[0]


def _repeated(words: Column) -> Column:
    """Words inside windows of five words that occur twice or more in the text."""
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(by_hash: Column) -> Column:
        twice = F.filter(
            by_hash,
            lambda s, j: F.coalesce(F.get(by_hash, j - 1)["h"] == s["h"], F.lit(False))
            | F.coalesce(F.get(by_hash, j + 1)["h"] == s["h"], F.lit(False)),
        )
        return _let(
            F.sort_array(F.transform(twice, lambda s: s["i"])),
            lambda at: F.aggregate(
                F.transform(at, lambda s, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - s, F.lit(WINDOW)))),
                F.lit(0).cast("bigint"),
                lambda a, b: a + b,
            ),
        )

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        none = F.size(F.array_distinct(h)) == F.size(h)
        return F.when(none, F.lit(0).cast("bigint")).otherwise(_let(ordered, covered))

    return F.when(F.size(words) < WINDOW, F.lit(0).cast("bigint")).otherwise(_let(hashes, count))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; such columns are replaced.

    A null text counts as empty.
    """
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    keep = [col(c) for c in docs.columns if c.lower() not in fields]
    body = F.coalesce(col(text), F.lit(""))
    words = F.array_remove(F.split(body, f"{_SPACE}+"), "")
    counted = _let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n"), _repeated(w).alias("r")))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    doubled = _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))
    wide = docs.select(
        *keep,
        counted.alias("_counted"),
        (F.length(body) - F.regexp_count(body, F.lit(_SPACE))).cast("bigint").alias("word_chars"),
        F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        doubled.alias("n_dup_lines"),
    )
    n, r = F.col("_counted")["n"], F.col("_counted")["r"]
    failed = (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)
    wide = wide.withColumns({"n_words": n, "n_repeat_words": r, "base_failed": failed})
    return wide.select(*keep, *fields)


def _transformed() -> dict[str, Column]:
    n = F.col("n_words")
    whole = lambda c: F.round(c * UNIT).cast("double")
    return {
        "x_word": whole(F.log(F.col("word_chars") / n)),
        "x_symbol": whole(F.log1p(100 * F.col("n_symbols") / n)),
        "x_repeat": whole(F.col("n_repeat_words") / n),
        "x_lines": whole(F.log1p(F.col("n_dup_lines"))),
    }


def _even_chi2(x: float, freedom: int) -> float:
    """Distribution function of chi-square with an even number of degrees of freedom."""
    term, total = 1.0, 0.0
    for i in range(freedom // 2):
        total += term
        term *= x / 2 / (i + 1)
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _even_chi2(mid, freedom) < p else (low, mid)
    return high


def _consistency(share: float, size: int) -> float:
    """What the covariance of the central ``share`` of normal rows has to be multiplied by."""
    return share / _even_chi2(chi2_quantile(share, size), size + 2)


def _by_rank(counts: DataFrame, keys: Sequence[str], value: str, share: float, name: str) -> DataFrame:
    """The smallest value that at least ``share`` of each group's rows do not exceed, from (keys, value, n).

    There are as many rows as different values; a group's total and running count are two windows over them.
    """
    over = Window.partitionBy(*keys)
    running = F.sum("n").over(over.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumns({"_run": running, "_all": F.sum("n").over(over)})
    return ranked.where(F.col("_run") >= share * F.col("_all")).groupBy(*keys).agg(F.min(value).alias(name))


def _groups(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``g``: the group of all keys; small ones are pooled by the first key, then all together."""
    whole = F.struct(F.lit(0).alias("level"), *[col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)])
    tagged = rows.withColumn("g", whole)
    for level, held in ((1, keys[:1]), (2, [])):
        sizes = tagged.groupBy("g").agg(F.count(F.lit(1)).alias("_n"))
        pooled = F.struct(
            F.lit(level).alias("level"),
            *[(col(k).cast("string") if k in held else F.lit(None).cast("string")).alias(f"k{i}") for i, k in enumerate(keys)],
        )
        tagged = tagged.join(sizes, "g").withColumn("g", F.when(F.col("_n") < MIN_GROUP, pooled).otherwise(F.col("g"))).drop("_n")
    return tagged


def _start(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Medians and scaled median deviations of every group, as centre and diagonal factor."""
    long = rows.select("g", F.posexplode(F.array(*names)).alias("k", "x"))
    counts = long.groupBy("g", "k", "x").agg(F.count(F.lit(1)).alias("n"))
    median = _by_rank(counts, ["g", "k"], "x", 0.5, "median")
    away = counts.join(median, ["g", "k"]).select("g", "k", "median", F.abs(F.col("x") - F.col("median")).alias("d"), "n")
    folded = away.groupBy("g", "k", "d").agg(F.sum("n").alias("n"))
    spread = _by_rank(folded, ["g", "k"], "d", 0.5, "mad")
    both = median.join(spread, ["g", "k"])
    picks = []
    for k, name in enumerate(names):
        at = F.col("k") == k
        picks.append(F.max(F.when(at, F.col("median"))).alias(f"m{k}"))
        least = F.lit(float(STATISTICS[name]))
        picks.append(F.greatest(F.max(F.when(at, 1.4826 * F.col("mad"))), least).alias(f"l{k}{k}"))
    flat = both.groupBy("g").agg(*picks)
    zeros = {f"l{i}{j}": F.lit(0.0) for i in range(len(names)) for j in range(i)}
    return flat.withColumns(zeros | {"logdet": F.lit(None).cast("double")})


def _distance(names: Sequence[str]) -> Column:
    """Squared Mahalanobis distance by forward substitution with the lower triangular factor."""
    solved: list[Column] = []
    for i, name in enumerate(names):
        rest = F.col(name) - F.col(f"m{i}")
        for j, y in enumerate(solved):
            rest = rest - F.col(f"l{i}{j}") * y
        solved.append(rest / F.col(f"l{i}{i}"))
    out = solved[0] * solved[0]
    for y in solved[1:]:
        out = out + y * y
    return out


def _factor(moments: DataFrame, names: Sequence[str]) -> DataFrame:
    """Centre and Cholesky factor of every group from its sums."""
    p, n = len(names), F.col("n")
    out = moments.withColumns({f"m{i}": F.col(f"s{i}") / n for i in range(p)})
    for i in range(p):
        for j in range(i + 1):
            value = F.col(f"q{i}{j}") / n - F.col(f"m{i}") * F.col(f"m{j}")
            if i == j:
                value = F.greatest(value, F.lit(0.0)) + float(STATISTICS[names[i]]) ** 2
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            entry = F.sqrt(F.greatest(value, F.lit(1e-6))) if i == j else value / F.col(f"l{j}{j}")
            out = out.withColumn(f"l{i}{j}", entry)
    logdet = 2 * sum((F.log(f"l{i}{i}") for i in range(1, p)), F.log("l00"))
    return out.withColumn("logdet", logdet).select("g", *_PARAMS(p), "logdet")


def _PARAMS(p: int) -> list[str]:
    return [f"m{i}" for i in range(p)] + [f"l{i}{j}" for i in range(p) for j in range(i + 1)]


def _bin(distance: Column) -> Column:
    return F.floor(F.log2(1 + distance) * _BINS)


def minimum_covariance(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Centre m*, factor l* and log determinant of every group ``g`` of the rows: one row per group."""
    p = len(names)
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(names)]]
    sums += [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"q{i}{j}") for i in range(p) for j in range(i + 1)]
    fit = materialise(_start(rows, names))
    for step in range(STEPS):
        placed = rows.join(fit, "g").select("g", *names, _bin(_distance(names)).alias("bin"))
        counts = placed.groupBy("g", "bin").agg(F.count(F.lit(1)).alias("n"))
        limit = _by_rank(counts, ["g"], "bin", SHARE, "limit")
        inner = placed.join(limit, "g").where(F.col("bin") <= F.col("limit"))
        moved = materialise(_factor(inner.groupBy("g").agg(*sums), names))
        before = fit.select("g", F.col("logdet").alias("_before"))
        fell = F.max(F.abs(F.col("logdet") - F.coalesce("_before", F.lit(1e9))))
        change = moved.join(before, "g").agg(fell).first()[0]
        fit = moved
        if change is None or change < 1e-6:
            break
    return fit


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keys: Sequence[str] = ("lang", "source")) -> DataFrame:
    """One row per input row: doc_id, the counts of ``statistics``, distance (scaled, squared) and kept.

    Rows that fail a base rule are neither kept nor part of the estimates. Null keys are a group of
    their own. Groups below MIN_GROUP rows are pooled by language and then altogether; what is still
    smaller is kept as it is, with a null distance. Repeated rows count as often as they stand.
    """
    keys, names = list(keys), list(STATISTICS)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    raw = docs.select(col(doc_id).alias("doc_id"), *[col(k).alias(f"key{i}") for i, k in enumerate(keys)], col(text).alias("text"))
    counted = materialise(statistics(raw).drop("text"))
    usable = counted.where(~F.col("base_failed")).withColumns(_transformed())
    grouped = materialise(_groups(usable, [f"key{i}" for i in range(len(keys))]))
    sizes = grouped.groupBy("g").agg((F.count(F.lit(1)) >= MIN_GROUP).alias("_enough"))
    fit = minimum_covariance(grouped, names).join(sizes, "g")
    scaled = F.when(F.col("_enough"), _distance(names) / _consistency(SHARE, len(names)))
    judged = grouped.join(fit, "g").select("doc_id", *counts, scaled.alias("distance"))
    within = F.coalesce(F.col("distance") <= chi2_quantile(1 - TAIL, len(names)), F.lit(True))
    failed = counted.where("base_failed").select("doc_id", *counts, F.lit(None).cast("double").alias("distance"))
    return judged.unionByName(failed).withColumn("kept", ~F.col("base_failed") & within)


def op7_quality_rules(docs: DataFrame) -> DataFrame:
    out = judge(docs)
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"]
    return out.select("doc_id", *fields)
