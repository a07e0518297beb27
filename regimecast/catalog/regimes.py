"""Memberships, entropies, truth / indeterminacy / falsity and their analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from regimecast.catalog.registry import define_view, query, rounded
from regimecast.catalog.series import DESCRIBE
from regimecast.functions import vectors as vec
from regimecast.operators import regimes, summary, uncertainty
from regimecast.sources.views import HARD_CENTRES, N_REGIMES, SOFT_CENTRES

USER = ["user_id"]
COMPONENTS = uncertainty.COMPONENTS

define_view(
    "norm_user",
    """SELECT user_id, ts, y, CASE WHEN hi = lo THEN 0.0 ELSE (y - lo) / (hi - lo) END AS x
       FROM hourly_user JOIN (SELECT user_id, min(y) AS lo, max(y) AS hi FROM hourly_user GROUP BY 1) USING (user_id)""",
)
define_view(
    "soft_user",
    """SELECT *, CASE WHEN d0 = 0 THEN 1.0 WHEN d1 = 0 OR d2 = 0 THEN 0.0 ELSE (1/(d0*d0)) / (1/(d0*d0) + 1/(d1*d1) + 1/(d2*d2)) END::DOUBLE AS u0,
        CASE WHEN d0 = 0 THEN 0.0 WHEN d1 = 0 THEN 1.0 WHEN d2 = 0 THEN 0.0 ELSE (1/(d1*d1)) / (1/(d0*d0) + 1/(d1*d1) + 1/(d2*d2)) END::DOUBLE AS u1,
        CASE WHEN d0 = 0 OR d1 = 0 THEN 0.0 WHEN d2 = 0 THEN 1.0 ELSE (1/(d2*d2)) / (1/(d0*d0) + 1/(d1*d1) + 1/(d2*d2)) END::DOUBLE AS u2,
        CASE WHEN abs(x - 0.1) <= abs(x - 0.3) AND abs(x - 0.1) <= abs(x - 0.6) THEN 0
             WHEN abs(x - 0.3) <= abs(x - 0.6) THEN 1 ELSE 2 END AS k
       FROM (SELECT *, abs(x - 0.12) AS d0, abs(x - 0.33) AS d1, abs(x - 0.55) AS d2 FROM norm_user)""",
)
define_view(
    "prob_user",
    """SELECT *, (u0 + 1e-9) / (u0 + u1 + u2 + 3e-9) AS p0, (u1 + 1e-9) / (u0 + u1 + u2 + 3e-9) AS p1,
        (u2 + 1e-9) / (u0 + u1 + u2 + 3e-9) AS p2 FROM soft_user""",
)
define_view(
    "tif_user",
    """SELECT *, 1.0 - truth AS falsity FROM (SELECT *, CASE k WHEN 0 THEN u0 WHEN 1 THEN u1 ELSE u2 END AS truth,
        least(greatest(-(p0 * ln(p0) + p1 * ln(p1) + p2 * ln(p2)) / ln(3), 0.0), 1.0) AS indeterminacy FROM prob_user)""",
)


def _rounded(df, *names, digits=6):
    return df.withColumns({n: rounded(n, digits) for n in names})


def _u(digits=6):
    return [rounded(F.get("u", F.lit(j)), digits).alias(f"u{j}") for j in range(N_REGIMES)]


# --- assignment with given centres --------------------------------------------------------


@query("clu2_assign_hard", "SELECT user_id, ts, k FROM soft_user")
def _(v):
    return regimes.assign_hard(v.norm_user, "x", HARD_CENTRES).select("user_id", "ts", "k")


@query(
    "clu3_centre_distances",
    "SELECT user_id, ts, round(d0, 6) AS d0, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM soft_user",
)
def _(v):
    out = regimes.centre_distances(v.norm_user, "x", SOFT_CENTRES)
    return out.select("user_id", "ts", *[rounded(F.get("dist", F.lit(j))).alias(f"d{j}") for j in range(3)])


@query(
    "clu4_cluster_sizes",
    """SELECT k, count(*) AS size, round(sum((x - CASE k WHEN 0 THEN 0.1 WHEN 1 THEN 0.3 ELSE 0.6 END)^2), 6) AS inertia,
        count(*) = max(count(*)) OVER () AS is_largest, count(*) = min(count(*)) OVER () AS is_smallest,
        round(max(count(*)) OVER () / min(count(*)) OVER (), 6) AS size_ratio
       FROM soft_user GROUP BY k""",
)
def _(v):
    from regimecast.operators import clustering

    labelled = regimes.assign_hard(v.norm_user, "x", HARD_CENTRES)
    return _rounded(clustering.cluster_sizes(labelled, "x", "k", HARD_CENTRES), "inertia", "size_ratio")


@query(
    "clu6_soft_memberships",
    "SELECT user_id, ts, round(u0, 6) AS u0, round(u1, 6) AS u1, round(u2, 6) AS u2 FROM soft_user",
)
def _(v):
    return regimes.assign_soft(v.norm_user, "x", SOFT_CENTRES).select("user_id", "ts", *_u())


@query(
    "clu8_fuzzy_objective",
    "SELECT round(sum(u0^2 * d0^2 + u1^2 * d1^2 + u2^2 * d2^2), 6) AS objective FROM soft_user",
)
def _(v):
    from regimecast.operators import clustering

    out = clustering.fuzzy_objective(v.norm_user, "x", SOFT_CENTRES, 2.0)
    return out.select(rounded("objective").alias("objective"))


@query(
    "clu9_fuzzy_hard_labels",
    """SELECT user_id, ts, CASE WHEN u0 >= u1 AND u0 >= u2 THEN 0 WHEN u1 >= u2 THEN 1 ELSE 2 END AS label FROM soft_user""",
)
def _(v):
    soft = regimes.assign_soft(v.norm_user, "x", SOFT_CENTRES)
    return soft.select("user_id", "ts", vec.first_max("u").alias("label"))


@query(
    "clu10_membership_entropy",
    """SELECT user_id, ts, round(-(p0 * log2(p0) + p1 * log2(p1) + p2 * log2(p2)), 6) + 0.0 AS entropy FROM prob_user""",
)
def _(v):
    soft = regimes.assign_soft(v.norm_user, "x", SOFT_CENTRES)
    h = vec.shannon(vec.elements("u", N_REGIMES))
    return soft.select("user_id", "ts", rounded(h).alias("entropy"))


@query(
    "clu11_fuzzy_info",
    """SELECT j, size, round(CASE j WHEN 0 THEN m0 WHEN 1 THEN m1 ELSE m2 END, 6) AS mean_membership, round(pc, 6) AS partition_coefficient
       FROM (SELECT CASE WHEN u0 >= u1 AND u0 >= u2 THEN 0 WHEN u1 >= u2 THEN 1 ELSE 2 END AS j, count(*) AS size FROM soft_user GROUP BY 1),
            (SELECT avg(u0) AS m0, avg(u1) AS m1, avg(u2) AS m2, avg(u0^2 + u1^2 + u2^2) AS pc FROM soft_user)""",
)
def _(v):
    from regimecast.operators import clustering

    soft = regimes.assign_soft(v.norm_user, "x", SOFT_CENTRES)
    return _rounded(clustering.fuzzy_info(soft, "u", N_REGIMES), "mean_membership", "partition_coefficient")


@query(
    "clu12_dual_assign",
    "SELECT user_id, ts, k, round(u0, 6) AS u0, round(u1, 6) AS u1, round(u2, 6) AS u2 FROM soft_user",
)
def _(v):
    from regimecast.operators.clustering import DualClustererModel

    model = DualClustererModel(
        hardCentres=[list(c) for c in HARD_CENTRES], softCentres=[list(c) for c in SOFT_CENTRES]
    )
    return model.transform(v.norm_user).select("user_id", "ts", "k", *_u())


@query(
    "clu13_integrated_features",
    """SELECT user_id, ts, (k = 0)::INTEGER::DOUBLE AS f0, (k = 1)::INTEGER::DOUBLE AS f1, (k = 2)::INTEGER::DOUBLE AS f2,
        round(u0, 6) AS f3, round(u1, 6) AS f4, round(u2, 6) AS f5 FROM soft_user""",
)
def _(v):
    out = regimes.integrated_features(v.tif_user, "k", "u", N_REGIMES)
    cols = [rounded(F.get("features", F.lit(j))).alias(f"f{j}") for j in range(2 * N_REGIMES)]
    return out.select("user_id", "ts", *cols)


AGREEMENT = """SELECT avg((k = CASE WHEN u0 >= u1 AND u0 >= u2 THEN 0 WHEN u1 >= u2 THEN 1 ELSE 2 END)::INTEGER) AS agreement,
    avg(CASE k WHEN 0 THEN u0 WHEN 1 THEN u1 ELSE u2 END) AS strength, avg(u0^2 + u1^2 + u2^2) AS pc FROM soft_user"""


@query(
    "clu14_agreement",
    f"""SELECT round(agreement, 6) AS exact_agreement, round(strength, 6) AS mean_strength, 0.033333::DOUBLE AS mean_centre_distance,
        0.05::DOUBLE AS max_centre_distance, 0.02::DOUBLE AS min_centre_distance FROM ({AGREEMENT})""",
)
def _(v):
    from regimecast.operators import clustering

    out = clustering.agreement(v.tif_user, "k", "u", HARD_CENTRES, SOFT_CENTRES)
    return _rounded(out, *out.columns)


@query(
    "clu15_quality_flags",
    f"""SELECT round(balance, 6) AS balance_ratio, round(agreement, 6) AS exact_agreement, round(pc, 6) AS partition_coefficient,
        balance < 0.1 AS imbalanced, agreement < 0.5 AS low_agreement, pc < 0.7 AS very_fuzzy,
        NOT (balance < 0.1 OR agreement < 0.5 OR pc < 0.7) AS is_valid
       FROM ({AGREEMENT}), (SELECT min(n) / max(n) AS balance FROM (SELECT count(*) AS n FROM soft_user GROUP BY k))""",
)
def _(v):
    from regimecast.operators import clustering

    out = clustering.quality_flags(v.tif_user, "k", "u", N_REGIMES)
    return _rounded(out, "balance_ratio", "exact_agreement", "partition_coefficient")


# --- entropies ----------------------------------------------------------------------------

ENTROPY_SQL = {
    "shannon": "-(p0 * log2(p0) + p1 * log2(p1) + p2 * log2(p2))",
    "shannon_normalized": "-(p0 * ln(p0) + p1 * ln(p1) + p2 * ln(p2)) / ln(3)",
    "renyi_alpha_0_5": "2 * ln(sqrt(p0) + sqrt(p1) + sqrt(p2)) / ln(3)",
    "renyi_alpha_2": "-ln(p0^2 + p1^2 + p2^2) / ln(3)",
    "renyi_alpha_inf": "-ln(greatest(p0, p1, p2)) / ln(3)",
    "tsallis_q_0_5": "(sqrt(p0) + sqrt(p1) + sqrt(p2) - 1) / (sqrt(3) - 1)",
    "tsallis_q_2": "(1 - (p0^2 + p1^2 + p2^2)) / (1 - 1.0 / 3)",
    "gini_simpson": "1 - (u0^2 + u1^2 + u2^2) / ((u0 + u1 + u2) * (u0 + u1 + u2))",
}


def _entropy_query(name: str, columns: dict[str, str], measures):
    body = ", ".join(f"round({sql}, 6) + 0.0 AS {c}" for c, sql in columns.items())

    @query(name, f"SELECT user_id, ts, {body} FROM prob_user")
    def _(v):
        picked = measures()
        return v.tif_user.select("user_id", "ts", *[rounded(c).alias(n) for n, c in picked.items()])


def _parts():
    return vec.elements("u", N_REGIMES)


_entropy_query(
    "ent1_shannon",
    {n: ENTROPY_SQL[n] for n in ("shannon", "shannon_normalized")},
    lambda: {"shannon": vec.shannon(_parts()), "shannon_normalized": vec.shannon("u", normalize=True)},
)
_entropy_query(
    "ent2_renyi",
    {"r_half": "2 * log2(sqrt(p0) + sqrt(p1) + sqrt(p2))", "r_2": "-log2(p0^2 + p1^2 + p2^2)",
     "r_inf": "-log2(greatest(p0, p1, p2))", "r_1": ENTROPY_SQL["shannon"]},
    lambda: {"r_half": vec.renyi(_parts(), 0.5), "r_2": vec.renyi("u", 2.0),
             "r_inf": vec.renyi(_parts(), float("inf")), "r_1": vec.renyi(_parts(), 1.0)},
)
_entropy_query(
    "ent3_tsallis",
    {"t_half": "2 * (sqrt(p0) + sqrt(p1) + sqrt(p2) - 1)", "t_2": "1 - (p0^2 + p1^2 + p2^2)",
     "t_3": "(1 - (p0^3 + p1^3 + p2^3)) / 2"},
    lambda: {"t_half": vec.tsallis(_parts(), 0.5), "t_2": vec.tsallis("u", 2.0), "t_3": vec.tsallis(_parts(), 3.0)},
)
_entropy_query(
    "ent4_gini_simpson", {"gini_simpson": ENTROPY_SQL["gini_simpson"]}, lambda: {"gini_simpson": vec.gini_simpson("u")}
)
_entropy_query("ent5_side_by_side", ENTROPY_SQL, lambda: vec.compare_entropies(_parts()))
_entropy_query(
    "ent5_by_name",
    {n: ENTROPY_SQL[s] for n, s in (("shannon", "shannon"), ("shannon_normalized", "shannon_normalized"),
                                    ("gini_simpson", "gini_simpson"), ("renyi_2", "renyi_alpha_2"), ("tsallis_2", "tsallis_q_2"))},
    lambda: {n: vec.entropy(_parts(), n) for n in vec.NAMED},
)

# --- truth / indeterminacy / falsity --------------------------------------------------------


@query(
    "tif1_regime_uncertainty_summary",
    """SELECT k, count(*) AS total_rows, round(avg(truth), 6) AS mean_truth, round(avg(indeterminacy), 6) AS mean_indeterminacy,
        round(avg((indeterminacy > 0.7)::INTEGER), 6) AS ambiguous_share FROM tif_user GROUP BY k""",
)
def _(v):
    return _rounded(regimes.regime_summary(v.tif_user), "mean_truth", "mean_indeterminacy", "ambiguous_share")


@query(
    "tif1_row_components",
    """SELECT user_id, ts, k, round(truth, 6) AS truth, round(indeterminacy, 6) + 0.0 AS indeterminacy, round(falsity, 6) + 0.0 AS falsity
       FROM tif_user""",
)
def _(v):
    return _rounded(v.tif_user.select("user_id", "ts", "k", *COMPONENTS), *COMPONENTS)


@query(
    "tif2_range_check",
    """SELECT count(*) AS total_rows, count(*) FILTER (truth < 0 OR truth > 1) AS truth_outside,
        count(*) FILTER (indeterminacy < 0 OR indeterminacy > 1) AS indeterminacy_outside,
        count(*) FILTER (falsity < 0 OR falsity > 1) AS falsity_outside,
        count(*) FILTER (abs(truth + falsity - 1) > 1e-9) AS unpaired FROM tif_user""",
)
def _(v):
    return regimes.range_check(v.tif_user)


@query(
    "tif3_input_checks",
    """SELECT count(*) AS total_rows, 0::BIGINT AS wrong_length, count(*) FILTER (least(u0, u1, u2) < 0 OR greatest(u0, u1, u2) > 1) AS outside_unit,
        count(*) FILTER (abs(u0 + u1 + u2 - 1) > 1e-6) AS not_summing_to_one, count(*) FILTER (k NOT IN (0, 1, 2)) AS bad_label FROM soft_user""",
)
def _(v):
    return regimes.input_checks(v.tif_user, "k", "u", N_REGIMES)


@query(
    "tif4_enriched_features",
    """SELECT user_id, ts, round(x, 6) AS y_norm, (k = 0)::INTEGER::DOUBLE AS hard_0, (k = 1)::INTEGER::DOUBLE AS hard_1,
        (k = 2)::INTEGER::DOUBLE AS hard_2, round(u0, 6) AS soft_0, round(u1, 6) AS soft_1, round(u2, 6) AS soft_2,
        round(truth, 6) AS truth, round(indeterminacy, 6) + 0.0 AS indeterminacy, round(falsity, 6) + 0.0 AS falsity FROM tif_user""",
)
def _(v):
    names = regimes.enriched_columns(["y_norm"], N_REGIMES)
    out = regimes.enrich(v.tif_user, ["y_norm"], "k", "u", N_REGIMES).select("user_id", "ts", *names)
    return _rounded(out, *names)


LONG = " UNION ALL ".join(
    f"SELECT user_id, '{c}' AS component, {c} AS val FROM tif_user" for c in COMPONENTS
)
define_view("tif_long", LONG)


@query(
    "tif5_distribution",
    """SELECT component, round(avg(val), 6) AS mean, round(stddev_pop(val), 6) AS std, round(min(val), 6) + 0.0 AS min,
        round(max(val), 6) + 0.0 AS max, round(quantile_cont(val, 0.5), 6) AS median, round(quantile_cont(val, 0.25), 6) AS q25,
        round(quantile_cont(val, 0.75), 6) AS q75 FROM tif_long GROUP BY 1""",
)
def _(v):
    out = uncertainty.distribution(v.tif_user, [])
    return _rounded(out, "mean", "std", "min", "max", "median", "q25", "q75")


@query(
    "tif5_correlations",
    """SELECT round(corr(truth, indeterminacy), 6) AS truth_indeterminacy, round(corr(truth, falsity), 6) AS truth_falsity,
        round(corr(indeterminacy, falsity), 6) AS indeterminacy_falsity FROM tif_user""",
)
def _(v):
    out = uncertainty.component_correlations(v.tif_user, [])
    return _rounded(out, *out.columns)


@query(
    "tif5_high_indeterminacy",
    """SELECT user_id, round(t, 6) AS threshold, round(avg((indeterminacy > t)::INTEGER), 6) AS ratio, count(*) FILTER (indeterminacy > t) AS count
       FROM tif_user JOIN (SELECT user_id, quantile_cont(indeterminacy, 0.9) AS t FROM tif_user GROUP BY 1) USING (user_id)
       GROUP BY user_id, t""",
)
def _(v):
    return _rounded(uncertainty.high_indeterminacy(v.tif_user, USER), "threshold", "ratio")


@query(
    "unc1_component_stats",
    DESCRIBE.format(keys="component", y="val").replace(", 4)", ", 6)").replace("count(*) AS count, ", "")
    .replace("min(val) AS min", "round(min(val), 6) + 0.0 AS min").replace("max(val) AS max", "round(max(val), 6) + 0.0 AS max")
    + " FROM tif_long GROUP BY 1",
)
def _(v):
    out = uncertainty.component_stats(v.tif_user, [])
    return _rounded(out, *[c for c in out.columns if c != "component"])


@query(
    "unc2_category_counts",
    """SELECT user_id, c.category, c.n AS count, round(c.n / total, 6) AS ratio FROM (SELECT user_id, count(*) AS total,
            count(*) FILTER (indeterminacy > 0.7) AS a, count(*) FILTER (truth < 0.3) AS b, count(*) FILTER (falsity > 0.7) AS c,
            count(*) FILTER (indeterminacy > 0.7 AND truth < 0.3) AS d,
            count(*) FILTER (truth > 1 - 0.3::DOUBLE AND indeterminacy < 0.3) AS e FROM tif_user GROUP BY 1) s,
        LATERAL (VALUES ('high_indeterminacy', s.a), ('low_truth', s.b), ('high_falsity', s.c), ('high_uncertainty', s.d),
            ('low_uncertainty', s.e)) c(category, n)""",
)
def _(v):
    return _rounded(uncertainty.category_counts(v.tif_user, USER), "ratio")


@query(
    "unc2_category_members",
    """SELECT user_id, ts, indeterminacy > 0.7 AS high_indeterminacy, truth < 0.3 AS low_truth, falsity > 0.7 AS high_falsity,
        indeterminacy > 0.7 AND truth < 0.3 AS high_uncertainty, truth > 1 - 0.3::DOUBLE AND indeterminacy < 0.3 AS low_uncertainty FROM tif_user""",
)
def _(v):
    return uncertainty.add_categories(v.tif_user).select("user_id", "ts", *uncertainty.category_flags())


COMPOSITE = {
    "overall_uncertainty": "indeterminacy * (1 - truth)",
    "conflict": "least(truth, falsity)",
    "ignorance": "1 - (truth + indeterminacy + falsity)",
    "certainty": "truth * (1 - indeterminacy)",
    "ambiguity": "indeterminacy",
}


@query(
    "unc3_composites",
    "SELECT user_id, ts, " + ", ".join(f"round({sql}, 6) + 0.0 AS {n}" for n, sql in COMPOSITE.items()) + " FROM tif_user",
)
def _(v):
    out = uncertainty.add_composites(v.tif_user).select("user_id", "ts", *COMPOSITE)
    return _rounded(out, *COMPOSITE)


@query(
    "unc3_composite_stats",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS measure, round(avg({sql}), 6) + 0.0 AS mean, round(stddev_pop({sql}), 6) AS std,
            round(min({sql}), 6) + 0.0 AS min, round(max({sql}), 6) + 0.0 AS max FROM tif_user"""
        for n, sql in COMPOSITE.items()
    ),
)
def _(v):
    return _rounded(uncertainty.composite_stats(v.tif_user, []), "mean", "std", "min", "max")


def _moved(n: int) -> str:
    w = f"(PARTITION BY user_id ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"""SELECT user_id, {n} AS "window", round(avg(i), 6) AS indeterminacy_ma_mean, round(stddev_pop(i), 6) AS indeterminacy_ma_std,
        round(avg(t), 6) AS truth_ma_mean, round(stddev_pop(t), 6) AS truth_ma_std,
        round(avg(s), 6) AS indeterminacy_volatility_mean, round(stddev_pop(s), 6) AS indeterminacy_volatility_std
        FROM (SELECT user_id, avg(indeterminacy) OVER {w} AS i, avg(truth) OVER {w} AS t, stddev_pop(indeterminacy) OVER {w} AS s,
            row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM tif_user) WHERE rn >= {n} GROUP BY 1"""


@query("unc4_temporal_patterns", " UNION ALL ".join(_moved(n) for n in (5, 10, 20)))
def _(v):
    out = uncertainty.temporal_patterns(v.tif_user, USER, ["ts"])
    return _rounded(out, *[c for c in out.columns if c not in ("user_id", "window")])


define_view(
    "ind_span",
    """SELECT min(indeterminacy) AS lo, max(indeterminacy) AS hi FROM tif_user""",
)
define_view(
    "ind_hist",
    """SELECT b.bin::INTEGER AS bin, lo + b.bin * ((hi - lo) / 10) AS left_edge, lo + (b.bin + 1) * ((hi - lo) / 10) AS right_edge,
        (SELECT count(*) FROM tif_user t, ind_span q WHERE least(floor((t.indeterminacy - q.lo) / ((q.hi - q.lo) / 10)), 9) = b.bin) AS count
       FROM ind_span, range(10) b(bin)""",
)


@query(
    "unc5_distribution_analysis",
    """SELECT bin, round(left_edge, 6) + 0.0 AS left_edge, round(right_edge, 6) + 0.0 AS right_edge, count, peaks, peaks >= 2 AS is_bimodal, is_uniform,
        round(high, 6) AS high_ratio, round(low, 6) AS low_ratio, round(1 - high - low, 6) AS medium_ratio,
        high > 0.8 OR low > 0.8 AS is_concentrated
       FROM (SELECT * FROM ind_hist ORDER BY count DESC, bin LIMIT 1),
        (SELECT count(*) FILTER (p) AS peaks, max(abs(count - m) / m) <= 0.2 AS is_uniform FROM (
            SELECT count, count > lag(count) OVER (ORDER BY bin) AND count > lead(count) OVER (ORDER BY bin) AS p, avg(count) OVER () AS m FROM ind_hist)),
        (SELECT avg((indeterminacy > 0.7)::INTEGER) AS high, avg((indeterminacy < 0.3)::INTEGER) AS low FROM tif_user)""",
)
def _(v):
    out = uncertainty.distribution_analysis(v.tif_user, [])
    return _rounded(out, "left_edge", "right_edge", "high_ratio", "low_ratio", "medium_ratio")


@query(
    "unc6_weights",
    """SELECT user_id, ts, round(CASE WHEN ih = il THEN 0 ELSE (indeterminacy - il) / (ih - il) END, 6) + 0.0 AS w_indeterminacy,
        round(CASE WHEN ch = cl THEN 0 ELSE (indeterminacy * (1 - truth) - cl) / (ch - cl) END, 6) + 0.0 AS w_composite,
        round(CASE WHEN th = tl THEN 0 ELSE (1 - truth - tl) / (th - tl) END, 6) + 0.0 AS w_truth_based
       FROM tif_user JOIN (SELECT user_id, min(indeterminacy) AS il, max(indeterminacy) AS ih, min(indeterminacy * (1 - truth)) AS cl,
            max(indeterminacy * (1 - truth)) AS ch, min(1 - truth) AS tl, max(1 - truth) AS th FROM tif_user GROUP BY 1) USING (user_id)""",
)
def _(v):
    out, names = v.tif_user, []
    for method in ("indeterminacy", "composite", "truth_based"):
        names.append(f"w_{method}")
        out = uncertainty.weights(out, USER, method, names[-1])
    return _rounded(out.select("user_id", "ts", *names), *names)


define_view(
    "regions",
    """SELECT user_id, min(i) AS region_start, max(i) AS region_end, count(*) AS length FROM (
        SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS run FROM (SELECT user_id, indeterminacy,
            row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i FROM tif_user) WHERE indeterminacy > 0.7)
       GROUP BY user_id, run""",
)


@query("win7_transition_regions", "SELECT * FROM regions")
def _(v):
    return uncertainty.transition_regions(v.tif_user, USER, ["ts"])


@query(
    "win7_transition_summary",
    """SELECT user_id, points, round(points / n, 6) AS ratio, coalesce(r, 0) AS regions, round(coalesce(l, 0.0), 6) AS mean_length
       FROM (SELECT user_id, count(*) AS n, count(*) FILTER (indeterminacy > 0.7) AS points FROM tif_user GROUP BY 1)
       LEFT JOIN (SELECT user_id, count(*) AS r, avg(length) AS l FROM regions GROUP BY 1) USING (user_id)""",
)
def _(v):
    out = uncertainty.transition_summary(v.tif_user, USER, ["ts"])
    return out.withColumns({"ratio": rounded("ratio"), "mean_length": rounded(F.col("mean_length"))})


@query(
    "agg5_indeterminacy_histogram",
    "SELECT bin, round(left_edge, 6) + 0.0 AS left_edge, round(right_edge, 6) + 0.0 AS right_edge, count FROM ind_hist",
)
def _(v):
    return _rounded(summary.histogram(v.tif_user, [], "indeterminacy"), "left_edge", "right_edge")
