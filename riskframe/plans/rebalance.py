"""Neighbour joins, splits, folds, class rebalancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions.exprs import r6
from riskframe.models.base import fit_model
from riskframe.operators import metrics, sample
from riskframe.operators.neighbors import knn
from riskframe.plans.basic import rounded
from riskframe.plans.registry import query
from riskframe.sources import frames
from riskframe.sources.frames import COMPANY_SQL, SCORED_SQL, VEC_SQL, with_sql

C = with_sql(COMPANY_SQL)
V = with_sql(VEC_SQL)
SEED = 42


def labelled(spark, sf):
    return frames.company(spark, sf).select("company_id", "seg", "target")


def h(tag, key="company_id"):
    return f"md5('{SEED}|{tag}|' || {key})"


def hint(expr):
    return f"('0x' || substr({expr}, 1, 8))::bigint"


def nn_sql(name, left, right, k, exclude=True):
    cond = "WHERE a.id <> b.id" if exclude else ""
    return f"""{name} AS (SELECT a.id, a.target AS y, b.id AS nbr, b.target AS z, round(list_distance(a.features, b.features), 9) AS dist,
      row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.features, b.features), 9), b.id) AS rn
      FROM {left} a, {right} b {cond} QUALIFY rn <= {k})"""


# ---- neighbours


@query("knn_join", V + ", " + nn_sql("nn", "vec", "vec", 5) + " SELECT id AS key, nbr, round(dist, 6) AS dist, rn::int AS rn FROM nn")
def _(spark, sf):
    v = frames.vec(spark, sf)
    return rounded(knn(v, v, 5), ["dist"])


@query(
    "knn_classifier",
    V
    + f""", r AS (SELECT *, row_number() OVER (ORDER BY {h('split', 'id')}) AS r, count(*) OVER () AS n FROM vec),
    tr AS (SELECT * FROM r WHERE r > ceil(n * 0.2)), te AS (SELECT * FROM r WHERE r <= ceil(n * 0.2)), """
    + nn_sql("nn", "te", "tr", 5, False)
    + " SELECT id, any_value(y) AS target, round(avg(z), 6) AS p, (avg(z) > 0.5)::int AS prediction FROM nn GROUP BY 1",
)
def _(spark, sf):
    train, test = sample.split(frames.vec(spark, sf), 0.2, SEED)
    out = fit_model(train, "target", "knn", {"k": 5}).score(test)
    return out.select("id", "target", r6("p").alias("p"), (F.col("p") > 0.5).cast("int").alias("prediction"))


# ---- splits


@query(
    "random_split",
    C + f"SELECT company_id, CASE WHEN row_number() OVER (ORDER BY {h('split')}) <= ceil(count(*) OVER () * 0.2) THEN 'test' ELSE 'train' END AS part FROM company",
)
def _(spark, sf):
    train, test = sample.split(labelled(spark, sf), 0.2, SEED, "company_id")
    return train.select("company_id", F.lit("train").alias("part")).unionByName(test.select("company_id", F.lit("test").alias("part")))


@query(
    "stratified_split",
    C
    + f""", a AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {h('test')}) <= floor(count(*) OVER (PARTITION BY target) * 0.1 + 0.5) AS t FROM company),
    b AS (SELECT company_id, row_number() OVER (PARTITION BY target ORDER BY {h('valid')}) <= floor(count(*) OVER (PARTITION BY target) * 0.2 + 0.5) AS v FROM a WHERE NOT t)
    SELECT company_id, target, CASE WHEN t THEN 'test' WHEN v THEN 'valid' ELSE 'train' END AS part FROM a LEFT JOIN b USING (company_id)""",
)
def _(spark, sf):
    out = sample.stratified_split(labelled(spark, sf), "target", {"test": 0.1, "valid": 0.2}, SEED, "company_id")
    return out.select("company_id", "target", "part")


@query("fold_ids", C + f"SELECT company_id, target, ((row_number() OVER (PARTITION BY target ORDER BY {h('fold')}) - 1) % 5)::int AS fold FROM company")
def _(spark, sf):
    return sample.fold_ids(labelled(spark, sf), "target", 5, SEED, "company_id").select("company_id", "target", "fold")


# ---- resampling by rank


def low_sql(tag, quota, cls):
    return f"SELECT company_id, target, 0::bigint AS draw FROM (SELECT *, row_number() OVER (ORDER BY {h(tag)}) AS r FROM company WHERE target = {cls}) WHERE r <= {quota}"


def draw_sql(m, cls):
    """m draws with replacement from one class."""
    return f"""SELECT company_id, target, d.i AS draw
      FROM (SELECT i, {hint(f"md5('{SEED}|over|draw|' || i)")} % (SELECT count(*) FROM company WHERE target = {cls}) + 1 AS r FROM range(1, (SELECT {m} + 1)::bigint) t(i)) d
      JOIN (SELECT *, row_number() OVER (ORDER BY {h('over')}) AS r FROM company WHERE target = {cls}) USING (r)"""


N1, N0 = "(SELECT count(*) FROM company WHERE target = 1)", "(SELECT count(*) FROM company WHERE target = 0)"


@query("random_undersample", C + low_sql("under", N1, 1) + " UNION ALL " + low_sql("under", N1, 0))
def _(spark, sf):
    return sample.undersample(labelled(spark, sf), "target", SEED, "company_id").select("company_id", "target", F.lit(0).cast("bigint").alias("draw"))


def _adaptive(strategy, ratio=1.0):
    def run(spark, sf):
        return sample.adaptive_sample(labelled(spark, sf), "target", strategy, ratio, SEED, "company_id").select("company_id", "target", "draw")

    return run


ALL1, ALL0 = ("SELECT company_id, target, 0::bigint AS draw FROM company WHERE target = " + c for c in "10")
query("adaptive_undersample", C + ALL1 + " UNION ALL " + low_sql("under", f"{N1} * 2", 0))(_adaptive("undersample", 2.0))
query("adaptive_oversample", C + ALL0 + " UNION ALL " + draw_sql(f"floor({N0} * 0.5)", 1))(_adaptive("oversample", 0.5))
query("adaptive_hybrid", C + low_sql("under", f"floor({N0} * 0.6::double)", 0) + " UNION ALL " + draw_sql(f"floor({N1} * 1.4::double)", 1))(_adaptive("hybrid"))


@query("ratio_resample", C + low_sql("under", f"floor({N0} * 0.6::double)", 0) + " UNION ALL " + draw_sql(f"floor({N1} * 1.4::double)", 1))
def _(spark, sf):
    return sample.ratio_resample(labelled(spark, sf), "target", 1.4, 0.6, SEED, "company_id").select("company_id", "target", "draw")


# ---- synthetic rows

SMOTE_SQL = (
    "mi AS (SELECT * FROM vec WHERE target = 1), "
    + nn_sql("mn", "mi", "mi", 5)
    + f""", rk AS (SELECT id, features, row_number() OVER (ORDER BY {h('base', 'id')}) AS r FROM mi),
    sz AS (SELECT count(*) FILTER (WHERE target = 1) AS n1, count(*) FILTER (WHERE target = 0) AS n0, max(id) AS top FROM vec),
    pk AS (SELECT i, {hint(f"md5('{SEED}|smote|' || i)")} % (n1 * 5) AS u, {hint(f"md5('{SEED}|gap|' || i)")} / 4294967296::double AS gap, top
      FROM sz, range(1, (SELECT n0 - n1 + 1 FROM sz)) t(i)),
    syn AS (SELECT top + i AS id, list_transform(list_zip(rk.features, o.features), lambda z: z[1] + gap * (z[2] - z[1])) AS features, 1 AS target, 1 AS synthetic
      FROM pk JOIN rk ON r = u // 5 + 1 JOIN mn ON mn.id = rk.id AND rn = u % 5 + 1 JOIN vec o ON o.id = mn.nbr),
    sm AS (SELECT id, features, target, 0 AS synthetic FROM vec UNION ALL SELECT id, features, target, synthetic FROM syn)"""
)
CELLS = "SELECT id, target, synthetic, unnest(generate_series(0, 63))::int AS pos, round(unnest(features), 6) AS v FROM "


def cells(df):
    return df.select("id", "target", "synthetic", F.posexplode("features").alias("pos", "v")).withColumn("v", r6("v"))


@query("smote", V + ", " + SMOTE_SQL + CELLS + "sm")
def _(spark, sf):
    return cells(sample.smote(frames.vec(spark, sf), "target"))


ADASYN_SQL = (
    "mi AS (SELECT * FROM vec WHERE target = 1), "
    + nn_sql("an", "mi", "vec", 5)
    + ", "
    + nn_sql("mn", "mi", "mi", 5)
    + f""", ra AS (SELECT id, avg((z = 0)::int) AS ratio FROM an GROUP BY 1),
    sz AS (SELECT count(*) FILTER (WHERE target = 1) AS n1, count(*) FILTER (WHERE target = 0) AS n0, max(id) AS top FROM vec),
    cn AS (SELECT id, ratio, round_even(round(ratio / sum(ratio) OVER () * (SELECT n0 - n1 FROM sz), 6), 0)::bigint AS g FROM ra),
    ex AS (SELECT id, unnest(generate_series(1, g)) AS j FROM cn WHERE g > 0),
    pk AS (SELECT id, j, row_number() OVER (ORDER BY md5('{SEED}|number|' || id || '|' || j)) AS num, {hint(f"md5('{SEED}|nbr|' || id || '|' || j)")} % 5 + 1 AS rn,
      {hint(f"md5('{SEED}|gap|' || id || '|' || j)")} / 4294967296::double AS gap FROM ex),
    syn AS (SELECT top + num AS id, list_transform(list_zip(a.features, o.features), lambda z: z[1] + gap * (z[2] - z[1])) AS features, 1 AS target, 1 AS synthetic
      FROM pk JOIN vec a USING (id) JOIN mn ON mn.id = pk.id AND mn.rn = pk.rn JOIN vec o ON o.id = mn.nbr, sz),
    sm AS (SELECT id, features, target, 0 AS synthetic FROM vec UNION ALL SELECT id, features, target, synthetic FROM syn)"""
)


@query("adasyn_counts", V + ", " + ADASYN_SQL + " SELECT id, round(ratio, 6) AS ratio, g FROM cn")
def _(spark, sf):
    return rounded(sample.adasyn_counts(frames.vec(spark, sf), "target"), ["ratio"])


@query("adasyn", V + ", " + ADASYN_SQL + CELLS + "sm")
def _(spark, sf):
    return cells(sample.adasyn(frames.vec(spark, sf), "target"))


def tomek_sql(frame, remove):
    """One nearest neighbour each; mutual pairs of different classes."""
    cond = "AND y = 0" if remove == "majority" else ""
    return nn_sql("t1", frame, frame, 1) + f""", lk AS (SELECT a.id FROM t1 a JOIN t1 b ON a.nbr = b.id AND b.nbr = a.id WHERE a.y <> a.z {cond.replace('y', 'a.y')}),
    kept AS (SELECT * FROM {frame} WHERE id NOT IN (SELECT id FROM lk))"""


@query("tomek_links", V + ", " + tomek_sql("vec", "majority") + " SELECT id, target FROM kept")
def _(spark, sf):
    return sample.tomek_links(frames.vec(spark, sf), "target").select("id", "target")


@query("tomek_links_both", V + ", " + tomek_sql("vec", "all") + " SELECT id, target FROM kept")
def _(spark, sf):
    return sample.tomek_links(frames.vec(spark, sf), "target", "all").select("id", "target")


def enn_sql(frame):
    return nn_sql("e3", frame, frame, 3) + f", kept AS (SELECT * FROM {frame} WHERE id NOT IN (SELECT id FROM e3 WHERE y <> z))"


@query("edited_nearest_neighbours", V + ", " + enn_sql("vec") + " SELECT id, target FROM kept")
def _(spark, sf):
    return sample.edited_nn(frames.vec(spark, sf), "target").select("id", "target")


@query("smote_tomek", V + ", " + SMOTE_SQL.replace("sm AS (", "sm AS MATERIALIZED (") + ", " + tomek_sql("sm", "majority") + " SELECT id, target, synthetic FROM kept")
def _(spark, sf):
    return sample.smote_tomek(frames.vec(spark, sf), "target").select("id", "target", "synthetic")


@query("smote_enn", V + ", " + SMOTE_SQL.replace("sm AS (", "sm AS MATERIALIZED (") + ", " + enn_sql("sm") + " SELECT id, target, synthetic FROM kept")
def _(spark, sf):
    return sample.smote_enn(frames.vec(spark, sf), "target").select("id", "target", "synthetic")


@query("adasyn_tomek", V + ", " + ADASYN_SQL.replace("sm AS (", "sm AS MATERIALIZED (") + ", " + tomek_sql("sm", "all") + " SELECT id, target, synthetic FROM kept")
def _(spark, sf):
    return sample.adasyn_tomek(frames.vec(spark, sf), "target").select("id", "target", "synthetic")


@query(
    "synthetic_quality_filter",
    V + ", " + SMOTE_SQL + ", " + nn_sql("q", "syn", "vec", 5, False) + " SELECT id, round(avg(dist), 6) AS mean_dist FROM q GROUP BY 1 HAVING avg(dist) < 0.95",
)
def _(spark, sf):
    v = frames.vec(spark, sf)
    made = sample.smote(v, "target").filter("synthetic = 1")
    return rounded(sample.quality_filter(made, v, 5, 0.95), ["mean_dist"]).select("id", "mean_dist")


def _noise_sql(view):
    hh = f"md5('{SEED}|view{view}|' || id || '|' || pos)"
    u1 = f"((('0x' || substr({hh}, 1, 8))::bigint + 1) / 4294967296::double)"
    u2 = f"(('0x' || substr({hh}, 9, 8))::bigint / 4294967296::double)"
    return f"round(x + 0.1::double * sqrt(-2 * ln({u1})) * cos(2 * pi() * {u2}), 6) AS view_{view}"


@query(
    "noise_views",
    V + ", l AS (SELECT id, unnest(generate_series(0, 63)) AS pos, unnest(features) AS x FROM vec) SELECT id, pos::int AS pos, " + _noise_sql(1) + ", " + _noise_sql(2) + " FROM l",
)
def _(spark, sf):
    out = sample.noise_views(frames.vec(spark, sf), 0.1, SEED)
    z = out.select("id", F.posexplode(F.arrays_zip("view_1", "view_2")).alias("pos", "z"))
    return z.select("id", "pos", r6(F.col("z.view_1")).alias("view_1"), r6(F.col("z.view_2")).alias("view_2"))


@query(
    "class_weights",
    C
    + """, n AS (SELECT count(*)::double AS n, sum(target) AS n1, sum(1 - target) AS n0 FROM company)
    SELECT company_id, CASE WHEN target = 1 THEN 2.0::double ELSE 1.0::double END AS doubled,
      round(CASE WHEN target = 1 THEN n / (2 * n1) ELSE n / (2 * n0) END, 6) AS balanced,
      round(CASE WHEN target = 1 THEN n / n1 ELSE 1.0::double END, 6) AS pos_weight FROM company, n""",
)
def _(spark, sf):
    df = labelled(spark, sf)
    for mode, out in (("double_positive", "doubled"), ("balanced", "balanced"), ("pos_weight", "pos_weight")):
        df = sample.class_weights(df, "target", mode, out)
    return rounded(df, ["balanced", "pos_weight"]).select("company_id", "doubled", "balanced", "pos_weight")


@query("append_rows", V + ", " + SMOTE_SQL + " SELECT id, target, synthetic FROM sm")
def _(spark, sf):
    v = frames.vec(spark, sf)
    made = sample.smote(v, "target").filter("synthetic = 1").select("id", "target", "synthetic")
    return sample.append_rows(v.select("id", "target", F.lit(0).alias("synthetic")), made)


@query("shuffle_rows", C + f"SELECT company_id, target FROM company ORDER BY {h('shuffle')}")
def _(spark, sf):
    return sample.shuffle(labelled(spark, sf), SEED, "company_id").select("company_id", "target")


@query("score_histogram", with_sql(SCORED_SQL) + "SELECT p_b AS score, sum(y)::bigint AS pos, sum(1 - y)::bigint AS neg FROM scored GROUP BY 1")
def _(spark, sf):
    return metrics.score_counts(frames.scored(spark, sf), "y", "p_b")
