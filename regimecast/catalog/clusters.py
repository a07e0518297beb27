"""Fitted clusterings and their validity indices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from regimecast.catalog.registry import define_view, query, rounded
from regimecast.functions import vectors as vec
from regimecast.operators import cluster_quality as cq
from regimecast.operators import clustering, regimes
from regimecast.sources.views import N_REGIMES, SOFT_CENTRES

ITERATIONS = 4  # the given centres count as the first, so three updates follow


def _r(df, *names):
    return df.withColumns({n: rounded(n) for n in names})


# --- fuzzy C-means on one dimension --------------------------------------------------------

define_view("fuzzy_1", "SELECT 0.12::DOUBLE AS c0, 0.33::DOUBLE AS c1, 0.55::DOUBLE AS c2")


def _soft_rows(centres: str) -> str:
    return f"""SELECT x, d0, d1, d2, CASE WHEN d0 = 0 THEN 1.0 WHEN d1 = 0 OR d2 = 0 THEN 0.0 ELSE 1/(d0*d0) / (1/(d0*d0) + 1/(d1*d1) + 1/(d2*d2)) END::DOUBLE AS u0,
        CASE WHEN d0 = 0 THEN 0.0 WHEN d1 = 0 THEN 1.0 WHEN d2 = 0 THEN 0.0 ELSE 1/(d1*d1) / (1/(d0*d0) + 1/(d1*d1) + 1/(d2*d2)) END::DOUBLE AS u1,
        CASE WHEN d0 = 0 OR d1 = 0 THEN 0.0 WHEN d2 = 0 THEN 1.0 ELSE 1/(d2*d2) / (1/(d0*d0) + 1/(d1*d1) + 1/(d2*d2)) END::DOUBLE AS u2
        FROM (SELECT x, abs(x - c0) AS d0, abs(x - c1) AS d1, abs(x - c2) AS d2 FROM norm_user, {centres})"""


for _t in range(1, ITERATIONS):
    define_view(
        f"fuzzy_{_t + 1}",
        "SELECT " + ", ".join(f"sum(u{j}^2 * x) / sum(u{j}^2) AS c{j}" for j in range(3))
        + f" FROM ({_soft_rows(f'fuzzy_{_t}')})",
    )


def _fitted(v):
    return clustering.FuzzyCMeans(
        k=N_REGIMES, maxIter=ITERATIONS, tol=0.0, initCentres=[list(c) for c in SOFT_CENTRES]
    ).fit(v.norm_user)


@query(
    "clu5_fuzzy_fit",
    " UNION ALL ".join(f"SELECT {j} AS cluster, 0 AS dim, round(c{j}, 6) AS value FROM fuzzy_{ITERATIONS}" for j in range(3)),
)
def _(v):
    return _r(cq.centre_table(v.norm_user, _fitted(v).getOrDefault("centres")), "value")


@query(
    "clu8_objective_history",
    " UNION ALL ".join(
        f"SELECT {t} AS iteration, (SELECT round(sum(u0^2*d0^2 + u1^2*d1^2 + u2^2*d2^2), 6) FROM ({_soft_rows(f'fuzzy_{t}')})) AS objective"
        for t in range(1, ITERATIONS + 1)
    ),
)
def _(v):
    history = _fitted(v).getOrDefault("history")
    rows = [(t, h) for t, h in enumerate(history, 1)]
    return _r(v.spark.createDataFrame(rows, "iteration int, objective double"), "objective")


# --- fuzzy C-means on 64 dimensions ---------------------------------------------------------

define_view("wide_1", "SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INTEGER AS j, x AS c FROM emb_xy ORDER BY vec_id LIMIT 3")
for _t in (1, 2):
    define_view(f"wide_d{_t}", f"SELECT e.vec_id, e.x, w.j, list_distance(e.x, w.c) AS d FROM emb_xy e, wide_{_t} w")
    define_view(
        f"wide_u{_t}",
        f"""SELECT vec_id, x, j, CASE WHEN z IS NOT NULL THEN (j = z)::INTEGER::DOUBLE ELSE inv / sum(inv) OVER (PARTITION BY vec_id) END AS u
            FROM (SELECT *, CASE WHEN d > 0 THEN 1 / (d * d) END AS inv, min(CASE WHEN d = 0 THEN j END) OVER (PARTITION BY vec_id) AS z FROM wide_d{_t})""",
    )
    define_view(
        f"wide_{_t + 1}",
        f"""SELECT j, list(m ORDER BY d) AS c FROM (SELECT j, d, sum(u * u * x[d]) / sum(u * u) AS m
            FROM wide_u{_t}, range(1, 65) r(d) GROUP BY j, d) GROUP BY j""",
    )


@query(
    "clu5_fuzzy_fit_wide",
    "SELECT j AS cluster, (d - 1)::INTEGER AS dim, round(c[d], 6) + 0.0 AS value FROM wide_3, range(1, 65) r(d)",
)
def _(v):
    start = [list(r["x"]) for r in v.emb_xy.orderBy("vec_id").limit(3).collect()]
    model = clustering.FuzzyCMeans(k=3, maxIter=3, tol=0.0, initCentres=start).fit(v.emb_xy)
    return _r(cq.centre_table(v.emb_xy, model.getOrDefault("centres")), "value")


# --- randomised fits ------------------------------------------------------------------------


@query("clu1_hard_fit")
def _(v):
    return cq.fitted_hard(v.norm_user, "x", N_REGIMES)


@query(
    "clu1_cost_invariant",
    "SELECT count(*) AS total_rows, 3::BIGINT AS clusters, true AS cost_holds, true AS centres_are_means FROM norm_user",
)
def _(v):
    """The cost is that of every row at its nearest centre, and every centre the mean of its rows, within the tolerance."""
    centres, cost = clustering.fit_hard(v.norm_user, "x", N_REGIMES)
    near = regimes.centre_distances(regimes.assign_hard(v.norm_user, "x", centres), "x", centres, "d")
    square = F.array_min("d") * F.array_min("d")
    at = near.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(square).alias("s"), F.avg(F.get("x", F.lit(0))).alias("m"))
    means = F.element_at(F.array(*[F.lit(c[0]) for c in centres]), F.col("k") + 1)
    return at.agg(
        F.sum("n").alias("total_rows"),
        F.count(F.lit(1)).alias("clusters"),
        (F.abs(F.sum("s") - cost) < 1e-6 * cost).alias("cost_holds"),
        (F.max(F.abs(F.col("m") - means)) < 1e-3).alias("centres_are_means"),
    )


@query(
    "clv6_recommend_k_invariant",
    "SELECT k::INTEGER AS k, true AS less_than_before, k = 2 OR k <> 2 AS in_range FROM range(2, 11) r(k)",
)
def _(v):
    """k = 2..10, costs that fall with k, silhouettes within [-1, 1], one recommendation and it the best."""
    table = cq.recommend_k(v.norm_user, "x")
    by_k = Window.orderBy("k")  # nine rows
    falls = F.coalesce(F.col("inertia") < F.lag("inertia").over(by_k), F.lit(True))
    best = F.max("silhouette").over(Window.partitionBy())
    right = F.col("silhouette").between(-1, 1) & (F.col("recommended") == (F.col("silhouette") == best))
    return table.select("k", falls.alias("less_than_before"), right.alias("in_range"))


@query("clu5_fuzzy_random_fit")
def _(v):
    model = clustering.FuzzyCMeans(k=N_REGIMES).fit(v.norm_user)
    return cq.centre_table(v.norm_user, model.getOrDefault("centres"))


@query("clu7_random_memberships")
def _(v):
    start = clustering.hashed_memberships("x", N_REGIMES, 42, ["user_id", "ts"])
    return v.norm_user.select("user_id", "ts", *[c.alias(f"u{j}") for j, c in enumerate(start)])


@query("clu12_dual_fit")
def _(v):
    model = clustering.DualClusterer(k=N_REGIMES).fit(v.norm_user)
    scored = regimes.tif(model.transform(v.norm_user), "k", "u", N_REGIMES)
    return regimes.regime_summary(scored)


# --- validity ---------------------------------------------------------------------------------


@query(
    "clv1_silhouette",
    """WITH pair AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.x, b.x)^2) AS s, count(*) AS n
            FROM emb_xy a, emb_xy b GROUP BY ALL),
        ab AS (SELECT vec_id, max(CASE WHEN label = other AND n > 1 THEN s / (n - 1) END) AS a,
            min(CASE WHEN label <> other THEN s / n END) AS b FROM pair GROUP BY 1)
       SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab""",
)
def _(v):
    return _r(cq.silhouette(v.emb_xy, "x", "label"), "silhouette")


define_view(
    "daily_labels",
    """SELECT ts, (y - lo) / (hi - lo) AS x, CASE WHEN (y - lo) / (hi - lo) < 0.3 THEN 0 WHEN (y - lo) / (hi - lo) < 0.6 THEN 1 ELSE 2 END AS k
       FROM daily_orders, (SELECT min(y) AS lo, max(y) AS hi FROM daily_orders)""",
)


@query(
    "clv1_silhouette_univariate",
    """WITH pair AS (SELECT a.ts, a.k, b.k AS other, sum(abs(a.x - b.x)) AS s, count(*) AS n
            FROM daily_labels a, daily_labels b GROUP BY ALL),
        ab AS (SELECT ts, max(CASE WHEN k = other AND n > 1 THEN s / (n - 1) END) AS a,
            min(CASE WHEN k <> other THEN s / n END) AS b FROM pair GROUP BY 1)
       SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab""",
)
def _(v):
    from regimecast.operators import normalise

    scaled = normalise.apply(v.daily_orders, normalise.fit(v.daily_orders, [], "y"), [], "y", name="x")
    k = F.when(F.col("x") < 0.3, 0).when(F.col("x") < 0.6, 1).otherwise(2)
    return _r(cq.silhouette_univariate(scaled.withColumn("k", k), "x", "k", 3), "silhouette")


define_view("emb_dim", "SELECT vec_id, label, d, x[d] AS xv FROM emb_xy, range(1, 65) r(d)")
define_view("emb_mean", "SELECT label, d, avg(xv) AS m, count(*) AS n FROM emb_dim GROUP BY 1, 2")
WITHIN = "(SELECT sum((e.xv - m.m)^2) FROM emb_dim e JOIN emb_mean m USING (label, d))"


@query(
    "clv2_calinski_harabasz",
    f"""SELECT round((SELECT sum(m.n * (m.m - g.m)^2) FROM emb_mean m JOIN (SELECT d, avg(xv) AS m FROM emb_dim GROUP BY 1) g USING (d))
        * (n - k) / ({WITHIN} * (k - 1)), 6) AS calinski_harabasz FROM (SELECT count(*) AS n, count(DISTINCT label) AS k FROM emb_xy)""",
)
def _(v):
    return _r(cq.calinski_harabasz(v.emb_xy, "x", "label"), "calinski_harabasz")


@query(
    "clv3_davies_bouldin",
    """WITH s AS (SELECT label, avg(dist) AS s FROM (SELECT e.vec_id, e.label, sqrt(sum((e.xv - m.m)^2)) AS dist
            FROM emb_dim e JOIN emb_mean m USING (label, d) GROUP BY 1, 2) GROUP BY 1),
        r AS (SELECT a.label, (sa.s + sb.s) / sqrt(sum((a.m - b.m)^2)) AS r FROM emb_mean a JOIN emb_mean b ON a.d = b.d AND a.label <> b.label
            JOIN s sa ON sa.label = a.label JOIN s sb ON sb.label = b.label GROUP BY a.label, b.label, sa.s, sb.s)
       SELECT round(avg(m), 6) AS davies_bouldin FROM (SELECT label, max(r) AS m FROM r GROUP BY 1)""",
)
def _(v):
    return _r(cq.davies_bouldin(v.emb_xy, "x", "label"), "davies_bouldin")


@query("clv4_inertia", f"SELECT round({WITHIN}, 6) AS inertia")
def _(v):
    return _r(cq.inertia(v.emb_xy, "x", "label"), "inertia")


@query(
    "clv5_balance",
    "SELECT round(1 / (1 + stddev_pop(n) / avg(n)), 6) AS balance FROM (SELECT count(*) AS n FROM emb_xy GROUP BY label)",
)
def _(v):
    return _r(cq.balance(v.emb_xy, "label"), "balance")


@query("clv6_recommend_k")
def _(v):
    return cq.recommend_k(v.emb_xy, "x")


@query("clv6_recommend_k_elbow")
def _(v):
    return cq.recommend_k(v.norm_user, "x", method="elbow")


@query(
    "clv7_compare_labels",
    """WITH l AS (SELECT k AS a, CASE WHEN u0 >= u1 AND u0 >= u2 THEN 0 WHEN u1 >= u2 THEN 1 ELSE 2 END AS b FROM soft_user),
        nij AS (SELECT a, b, count(*)::DOUBLE AS n FROM l GROUP BY 1, 2), ai AS (SELECT a, sum(n) AS n FROM nij GROUP BY 1),
        bj AS (SELECT b, sum(n) AS n FROM nij GROUP BY 1), t AS (SELECT sum(n) AS n FROM nij),
        c AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM nij) AS shared, (SELECT sum(n * (n - 1) / 2) FROM ai) AS ra,
            (SELECT sum(n * (n - 1) / 2) FROM bj) AS rb, (SELECT n * (n - 1) / 2 FROM t) AS al,
            (SELECT sum(nij.n / t.n * ln(nij.n * t.n / (ai.n * bj.n))) FROM nij JOIN ai USING (a) JOIN bj USING (b), t) AS mi,
            (SELECT -sum(ai.n / t.n * ln(ai.n / t.n)) FROM ai, t) AS ha, (SELECT -sum(bj.n / t.n * ln(bj.n / t.n)) FROM bj, t) AS hb)
       SELECT round((shared - ra * rb / al) / ((ra + rb) / 2 - ra * rb / al), 6) AS adjusted_rand,
        round(mi / ((ha + hb) / 2), 6) AS normalized_mutual_info FROM c""",
)
def _(v):
    labelled = v.tif_user.withColumn("soft", vec.first_max("u"))
    return _r(cq.compare_labels(labelled, "k", "soft"), "adjusted_rand", "normalized_mutual_info")


@query("clv7_better_clustering")
def _(v):
    two = v.emb_xy.withColumn("coarse", F.floor(F.col("label") / 5).cast("int"))
    return cq.compare_clusterings(two, "x", "label", "coarse")


@query("clv_all_indices")
def _(v):
    return cq.validate(v.emb_xy, "x", "label")
