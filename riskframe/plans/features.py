"""Feature construction, embedding columns, clustering, projection, feature selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions.exprs import d, r6
from riskframe.operators import build, clean, cluster, embed, project, schema, select
from riskframe.operators.profile import vector_summary
from riskframe.plans.basic import FISHER_SQL, VEC_LONG_SQL, long, rounded
from riskframe.plans.registry import query
from riskframe.session import stage
from riskframe.sources import frames
from riskframe.sources.frames import COMPANY_SQL, NUMERIC, VEC_SQL, with_sql

# ---- row statistics and fusion

STATS_SQL = """, s AS (SELECT id, avg(x) AS m, stddev_pop(x) AS sd, max(x) AS mx, min(x) AS mn, quantile_cont(x, [0.25, 0.5, 0.75]) AS q FROM l GROUP BY 1)"""


@query(
    "row_statistics",
    with_sql(VEC_LONG_SQL + STATS_SQL)
    + """, c AS (SELECT id, avg((x - m) ** 3) AS m3, avg((x - m) ** 4) AS m4 FROM l JOIN s USING (id) GROUP BY 1)
    SELECT id, round(m, 6) AS row_mean, round(sd, 6) AS row_std, round(mx, 6) AS row_max, round(mn, 6) AS row_min, round(q[2], 6) AS row_median,
      round(m3 / sd ** 3, 6) AS row_skew, round(m4 / sd ** 4 - 3, 6) AS row_kurtosis, round(q[1], 6) AS row_q25, round(q[3], 6) AS row_q75,
      round(sd / (m + 1e-8::double), 4) AS row_cv FROM s JOIN c USING (id)""",
)
def _(spark, sf):
    out = build.row_stats(frames.vec(spark, sf)).select("id", *build.ROW_STATS)
    return rounded(out, build.ROW_STATS[:-1]).withColumn("row_cv", F.round("row_cv", 4))


@query(
    "coarse_row_features",
    with_sql(VEC_LONG_SQL + STATS_SQL)
    + "SELECT id, unnest(generate_series(0, 4))::int AS pos, round(unnest([m, sd, q[2], mx, mn]), 6) AS v FROM s",
)
def _(spark, sf):
    return long(build.coarse_stats(frames.vec(spark, sf)), "id", "coarse")


@query("fine_row_features", with_sql(VEC_SQL) + "SELECT id, unnest(generate_series(0, 9))::int AS pos, round(unnest(features[1:10]), 6) AS v FROM vec")
def _(spark, sf):
    return long(build.fine_features(frames.vec(spark, sf)), "id", "fine")


@query(
    "variance_weighted_fusion",
    with_sql(VEC_LONG_SQL + STATS_SQL)
    + """, cells AS (
      SELECT id, 0 AS blk, unnest(generate_series(0, 4)) AS pos, unnest([m, sd, q[2], mx, mn]) AS x FROM s
      UNION ALL SELECT id, 1, pos, x FROM l WHERE pos < 10),
    w AS (SELECT blk, pos, var_pop(x) + 1e-8::double AS w FROM cells GROUP BY 1, 2),
    n AS (SELECT blk, pos, w / sum(w) OVER (PARTITION BY blk) AS w FROM w)
    SELECT id, (blk * 5 + pos)::int AS pos, round(x * w, 6) AS v FROM cells JOIN n USING (blk, pos)""",
)
def _(spark, sf):
    df = build.fine_features(build.coarse_stats(frames.vec(spark, sf)))
    return long(build.apply_var_fusion(df, build.fit_var_fusion(df, "coarse", "fine")), "id", "fused")


@query(
    "pairwise_interactions",
    with_sql(VEC_LONG_SQL + FISHER_SQL)
    + """, top AS (SELECT pos FROM fisher ORDER BY score DESC, pos LIMIT 12),
    p AS (SELECT a.pos AS i, b.pos AS j FROM top a JOIN top b ON a.pos < b.pos)
    SELECT id, i || '_x_' || j AS name, round(features[i + 1] * features[j + 1], 6) AS v FROM vec, p""",
)
def _(spark, sf):
    v = frames.vec(spark, sf)
    imp = [r["score"] for r in select.fisher_ratio(v).orderBy("pos").collect()]  # one number per feature
    out, names = build.interactions(v, imp, 0.2)
    cells = out.select("id", F.posexplode("interactions").alias("i", "v"))
    return cells.select("id", F.get(F.array(*[F.lit(n) for n in names]), F.col("i")).alias("name"), r6("v").alias("v"))


CROSS = ["avg_disc", "max_qty", "ret_share", "n_orders"]
CROSS_SQL = ", ".join([*CROSS, *[f"{a} * {b}" for i, a in enumerate(CROSS) for b in CROSS[i + 1 :]]])


@query(
    "polynomial_crosses",
    with_sql(COMPANY_SQL) + f"SELECT company_id, unnest(generate_series(0, 9))::int AS pos, round(unnest([{CROSS_SQL}]) + 1e-10::double, 6) AS v FROM company",
)
def _(spark, sf):
    df = schema.assemble(frames.company(spark, sf), CROSS)
    cells = build.crosses(df, len(CROSS)).select("company_id", F.posexplode("crosses").alias("pos", "v"))
    return cells.withColumn("v", r6(F.col("v") + d(frames.TIE)))


# ---- embedding columns


@query("pack_embeddings", with_sql(VEC_LONG_SQL) + "SELECT id, pos::int AS pos, round(x, 6) AS v, round(sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS a_emb_norm FROM l")
def _(spark, sf):
    out = embed.pack_embeddings(frames.vec_wide(spark, sf))
    return rounded(long(out, "id", "a_emb_vector", "a_emb_norm"), ["a_emb_norm"])


@query("expand_embeddings", with_sql(VEC_SQL) + "SELECT id, target, " + ", ".join(f"features[{i + 1}] AS a_emb_dim_{i}" for i in range(64)) + " FROM vec")
def _(spark, sf):
    return embed.expand_embeddings(frames.vec(spark, sf), "features", "a", 64)


@query(
    "text_embedding",
    """WITH tok AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS t FROM documents),
    tf AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::bigint % 64 AS pos, count(*) AS tf FROM tok GROUP BY 1, 2),
    n AS (SELECT count(*) AS n FROM documents),
    idf AS (SELECT pos, ln((1 + any_value(n)) / (1 + count(*))::double) + 1 AS idf FROM tf, n GROUP BY 1),
    w AS (SELECT doc_id, pos, tf * idf AS w FROM tf JOIN idf USING (pos))
    SELECT doc_id, pos::int AS pos, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS v FROM w""",
)
def _(spark, sf):
    df = frames.table(spark, sf, "documents").select("doc_id", "text")
    counted = stage(embed.text_counts(df, "text", 64).select("doc_id", "tf"))  # texts are read and hashed once
    out = embed.apply_idf(counted, embed.fit_idf(counted))
    return long(out, "doc_id", "features").filter("v != 0")


# ---- clusters

CENTERS_SQL = """, c AS (SELECT label AS k, pos, avg(x) AS c FROM (SELECT label, unnest(generate_series(0, 63)) AS pos, unnest(embedding::double[]) AS x FROM embeddings) GROUP BY 1, 2),
dist AS (SELECT id, k, sqrt(sum((x - c) * (x - c))) AS dist FROM l JOIN c USING (pos) GROUP BY 1, 2),
near AS (SELECT id, arg_min(k, (round(dist, 9), k)) AS cluster FROM dist GROUP BY 1)"""


def label_centers(spark, sf):
    """Class means of the labelled vectors as given centres (one row per label)."""
    t = frames.table(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("features"))
    return [r["mean"] for r in vector_summary(t, ["label"]).orderBy("label").collect()]


@query("kmeans_distances", with_sql(VEC_LONG_SQL + CENTERS_SQL) + "SELECT id, cluster, k::int AS pos, round(dist, 6) AS v FROM dist JOIN near USING (id)")
def _(spark, sf):
    return long(cluster.kmeans_features(frames.vec(spark, sf), label_centers(spark, sf)), "id", "centre_dist", "cluster")


@query(
    "lloyd_step",
    with_sql(VEC_LONG_SQL + CENTERS_SQL) + "SELECT cluster, pos::int AS pos, count(*) AS n, round(avg(x), 6) AS v FROM l JOIN near USING (id) GROUP BY 1, 2",
)
def _(spark, sf):
    return long(cluster.lloyd_step(frames.vec(spark, sf), label_centers(spark, sf)), "cluster", "center", "n")


@query("kmeans_fit")
def _(spark, sf):
    v = frames.vec(spark, sf)
    out = cluster.kmeans_features(v, cluster.fit_kmeans(v, 10, max_iter=20))
    return out.groupBy("cluster").agg(F.count("*").alias("n"), r6(F.avg(F.array_min("centre_dist"))).alias("mean_dist"))


@query("kmeans_plus_plus")
def _(spark, sf):
    """Fit with squared-distance seeding, run to the shift tolerance, then one more step: centres stay put."""
    v = frames.vec(spark, sf)
    centers = cluster.fit_kmeans(v, 8, seed=7, max_iter=300, tol=1e-4)
    return cluster.lloyd_step(v, centers).select("cluster", "n", r6(F.array_max("center")).alias("max_coordinate"))


NEAR_SQL = """, p AS (SELECT a.id, b.id AS nbr, round(list_distance(a.features, b.features), 9) AS dist FROM vec a, vec b)"""
EPS = 0.95


@query(
    "density_core_points",
    with_sql(VEC_SQL + NEAR_SQL) + f"SELECT id, (count(*) FILTER (WHERE dist <= {EPS}) >= 5)::int AS core FROM p GROUP BY 1",
)
def _(spark, sf):
    return cluster.density_clusters(frames.vec(spark, sf), EPS, 5).select("id", "core")


@query(
    "density_clusters",
    "WITH RECURSIVE "
    + (VEC_SQL + NEAR_SQL).strip()
    + f""", near AS MATERIALIZED (SELECT id, nbr FROM p WHERE dist <= {EPS}),
    core AS (SELECT id FROM near GROUP BY 1 HAVING count(*) >= 5),
    edge AS MATERIALIZED (SELECT near.id, nbr FROM near SEMI JOIN core USING (id) WHERE nbr IN (SELECT id FROM core)),
    reach AS (SELECT id AS head, id FROM core UNION SELECT reach.head, edge.nbr FROM reach JOIN edge USING (id)),
    comp AS (SELECT id, min(head) AS head FROM reach GROUP BY 1),
    num AS (SELECT id, dense_rank() OVER (ORDER BY head) - 1 AS cluster FROM comp),
    border AS (SELECT near.id, min(cluster) AS cluster FROM near JOIN num ON nbr = num.id WHERE near.id NOT IN (SELECT id FROM core) GROUP BY 1)
    SELECT id, coalesce(num.cluster, border.cluster, -1) AS cluster, (num.id IS NOT NULL)::int AS core
    FROM vec LEFT JOIN num USING (id) LEFT JOIN border USING (id)""",
)
def _(spark, sf):
    return cluster.density_clusters(frames.vec(spark, sf), EPS, 5)


@query("isolation_forest")
def _(spark, sf):
    v = frames.vec(spark, sf)
    out = cluster.apply_isolation(v, cluster.fit_isolation(v, trees=50, contamination=0.05))
    return out.select("id", r6("anomaly").alias("anomaly"), r6("decision").alias("decision"))


@query(
    "local_outlier_factor",
    with_sql(VEC_SQL + NEAR_SQL)
    + """, nn AS (SELECT * FROM p WHERE id <> nbr QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, nbr) <= 20),
    kd AS (SELECT id AS nbr, max(dist) AS kd FROM nn GROUP BY 1),
    lrd AS (SELECT id, 1 / (avg(greatest(kd, dist)) + 1e-10::double) AS lrd FROM nn JOIN kd USING (nbr) GROUP BY 1)
    SELECT nn.id, round(avg(o.lrd) / any_value(s.lrd), 6) AS lof FROM nn JOIN lrd o ON o.id = nn.nbr JOIN lrd s ON s.id = nn.id GROUP BY 1""",
)
def _(spark, sf):
    return rounded(cluster.lof(frames.vec(spark, sf), 20), ["lof"])


# ---- projections


@query("pca_to_variance")
def _(spark, sf):
    v = frames.vec(spark, sf)
    return long(project.project(v, project.fit_pca(v)), "id", "projected")


@query("pca_fixed")
def _(spark, sf):
    v = frames.vec(spark, sf)
    return long(project.project(v, project.fit_pca(v, 50)), "id", "projected")


@query("truncated_svd")
def _(spark, sf):
    v = frames.vec(spark, sf)
    return long(project.project(v, project.fit_svd(v, 50)), "id", "projected")


@query("lda_projection")
def _(spark, sf):
    v = frames.vec(spark, sf)
    return long(project.project(v, project.fit_lda1(v)), "id", "projected", "target")


@query(
    "gram_matrix",
    with_sql(VEC_LONG_SQL)
    + """, m AS (SELECT pos, avg(x) AS m FROM l GROUP BY 1), z AS (SELECT id, pos, x - m AS x FROM l JOIN m USING (pos))
    SELECT a.pos::int AS i, b.pos::int AS j, round(sum(a.x * b.x), 6) AS v FROM z a JOIN z b USING (id) GROUP BY 1, 2""",
)
def _(spark, sf):
    """Scatter matrix behind the projections."""
    import numpy as np

    v = frames.vec(spark, sf)
    g = project.gram(v, mean=np.array(vector_summary(v).first()["mean"]))
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(g)]
    return spark.createDataFrame(rows, "i int, r array<double>").select("i", F.posexplode("r").alias("j", "v")).withColumn("v", r6("v"))


# ---- selection


@query(
    "nonconstant_mask",
    with_sql(COMPANY_SQL)
    + """, m AS (SELECT avg(n_orders) AS a, avg(sum_price) AS b, avg(avg_disc) AS c, avg(max_qty) AS e, avg(ret_share) AS f FROM company),
    l AS (SELECT unnest(generate_series(0, 5))::int AS pos, unnest([coalesce(n_orders, a), coalesce(sum_price, b), coalesce(avg_disc, c), coalesce(max_qty::double, e),
      coalesce(ret_share, f), zero_var]) AS x FROM company, m)
    SELECT pos, round(stddev_pop(x), 6) AS score, (stddev_pop(x) > 1e-8)::int AS selected FROM l GROUP BY 1""",
)
def _(spark, sf):
    """Over all companies, missing values filled with the mean first."""
    df = frames.company_table(spark, sf, *NUMERIC[:5], "zero_var").withColumns({c: F.col(c).cast("double") for c in NUMERIC[:5]})
    df = clean.apply_impute(df, clean.fit_impute(df, NUMERIC[:5], "mean"))
    return rounded(select.nonconstant(schema.assemble(df, [*NUMERIC[:5], "zero_var"]), 1e-8), ["score"])


@query(
    "variance_threshold",
    with_sql(VEC_LONG_SQL) + "SELECT pos::int AS pos, round(var_pop(x), 6) AS score, (var_pop(x) > 0.0155)::int AS selected FROM l GROUP BY 1",
)
def _(spark, sf):
    return rounded(select.variance_mask(frames.vec(spark, sf), 0.0155), ["score"])


ANOVA_SQL = """, cm AS (SELECT pos, target, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM l GROUP BY 1, 2),
    g AS (SELECT pos, avg(x) AS g, count(*) AS n_all FROM l GROUP BY 1),
    f AS (SELECT pos::int AS pos, (sum(n * (m - g) ** 2) / (count(*) - 1)) / (sum(n * v) / (any_value(n_all) - count(*))) AS score FROM cm JOIN g USING (pos) GROUP BY 1)"""


@query(
    "anova_top_k",
    with_sql(VEC_LONG_SQL + ANOVA_SQL) + "SELECT pos, round(score, 5) AS score, (row_number() OVER (ORDER BY score DESC, pos) <= 20)::int AS selected FROM f",
)
def _(spark, sf):
    return select.anova_f(frames.vec(spark, sf), k=20).withColumn("score", F.round("score", 5))


@query(
    "chi2_select",
    with_sql(VEC_LONG_SQL)
    + """, r AS (SELECT pos, min(x) AS lo, (max(x) - min(x)) / 5 AS w FROM l GROUP BY 1),
    b AS (SELECT target, pos, len(list_filter([1, 2, 3, 4], lambda i: lo + i * w <= x)) AS code FROM l JOIN r USING (pos)),
    o AS (SELECT pos, target, sum(code)::double AS obs, count(*)::double AS n FROM b GROUP BY 1, 2),
    e AS (SELECT pos, target, obs, n / sum(n) OVER (PARTITION BY pos) * sum(obs) OVER (PARTITION BY pos) AS e FROM o),
    s AS (SELECT pos::int AS pos, sum((obs - e) * (obs - e) / e) AS score FROM e GROUP BY 1)
    SELECT pos, round(score, 6) AS score, (CASE WHEN max((score > 3.841459)::int) OVER () = 0 THEN 1 ELSE (score > 3.841459)::int END) AS selected FROM s""",
)
def _(spark, sf):
    return rounded(select.chi2_scores(frames.vec(spark, sf)), ["score"])


@query("fisher_ratio", with_sql(VEC_LONG_SQL + FISHER_SQL) + "SELECT pos, round(score, 6) AS score, (score > 0.001)::int AS selected FROM fisher")
def _(spark, sf):
    return rounded(select.fisher_ratio(frames.vec(spark, sf)), ["score"])


@query("select_above_mean", with_sql(VEC_LONG_SQL + FISHER_SQL) + "SELECT pos, round(score, 6) AS score, (score >= avg(score) OVER ())::int AS selected FROM fisher")
def _(spark, sf):
    imp = select.fisher_ratio(frames.vec(spark, sf)).select("pos", "score")
    return rounded(select.top_k(imp, min_mean=True), ["score"])


@query(
    "select_top_fraction",
    with_sql(VEC_LONG_SQL + FISHER_SQL) + "SELECT pos, round(score, 6) AS score, (row_number() OVER (ORDER BY score DESC, pos) <= 19)::int AS selected FROM fisher",
)
def _(spark, sf):
    imp = select.fisher_ratio(frames.vec(spark, sf)).select("pos", "score")
    return rounded(select.top_k(imp, fraction=0.3), ["score"])


@query(
    "rank_features",
    with_sql(VEC_LONG_SQL + FISHER_SQL) + "SELECT pos, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, pos)::int AS place FROM fisher",
)
def _(spark, sf):
    imp = select.fisher_ratio(frames.vec(spark, sf)).select("pos", "score")
    return rounded(select.rank_features(imp), ["score"])
