"""Training, ensembles, search and batch scoring on the vector and company frames."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from riskframe.functions.exprs import d, hash_unit, r6
from riskframe.models import ensembles, network, search, stages
from riskframe.models.base import balanced_draws, boosted_weight, fit_model
from riskframe.operators import clean, encode, explain, metrics, sample, scale, schema, score, select, thresholds
from riskframe.plans.basic import VEC_LONG_SQL, rounded, scratch
from riskframe.plans.registry import query
from riskframe.plans.scores import RATE_COLS, eval_sql
from riskframe.session import shared_folder, stage
from riskframe.sources import frames, io
from riskframe.sources.frames import COMPANY_SQL, NUMERIC, STRINGS, VEC_SQL, with_sql


def split_vec(spark, sf):
    v = sample.stratified_split(frames.vec(spark, sf), "target", {"test": 0.3}, 42)
    v = stage(v)
    return v.filter("part = 'train'").drop("part"), v.filter("part = 'test'").drop("part")


def test_scores(kind, params=None, weight=None):
    """Fit on 70 %, score the held-out 30 % of the vectors."""

    def run(spark, sf):
        train, test = split_vec(spark, sf)
        if weight:
            train = sample.class_weights(train, "target", weight)
        m = fit_model(train, "target", kind, params, weight="weight" if weight else None)
        return m.score(test).select("id", "target", r6("p").alias("p"))

    return run


query("gradient_boosting")(test_scores("gbt", {"rounds": 10, "depth": 3, "lr": 0.1, "subsample": 0.8}, "double_positive"))
query("adaboost")(test_scores("adaboost", {"rounds": 8, "lr": 0.5}))
query("random_forest")(test_scores("rf", {"trees": 30, "depth": 5}, "balanced"))
query("balanced_forest")(test_scores("brf", {"trees": 30, "depth": 5}))
query("decision_tree")(test_scores("tree", {"depth": 5}))
query("logistic_regression")(test_scores("logreg", {"reg": 0.01}))
query("linear_svm")(test_scores("linsvc", {"reg": 0.01}))
query("feed_forward_net")(test_scores("mlp", {"hidden": [16, 8], "iterations": 30}))


query("weighted_network")(test_scores("mlp", {"hidden": [16, 8], "iterations": 20, "pos_weight": 10.0}))

NET = [64, 3, 1]
NET_THETA = [((7 * i) % 11 - 5) / 20 for i in range(64 * 3 + 3 + 3 + 1)]
NET_SQL = """, th AS (SELECT i, ((7 * i) % 11 - 5) / 20.0::double AS v FROM range(199) t(i)),
z AS (SELECT id, l.target AS y, k, sum(x * th.v) AS s FROM l, range(3) t(k) JOIN th ON th.i = l.pos * 3 + k GROUP BY 1, 2, 3),
h AS (SELECT id, y, k, 1 - 2 / (exp(2 * (s + b.v)) + 1) AS h, o.v AS w2 FROM z JOIN th b ON b.i = 192 + k JOIN th o ON o.i = 195 + k),
e AS (SELECT id, (1 / (1 + exp(-sum(h * w2) - (SELECT v FROM th WHERE i = 198))) - any_value(y)) * any_value(CASE WHEN y = 1 THEN 100 ELSE 1 END) AS e FROM h GROUP BY 1),
n AS (SELECT sum(CASE WHEN target = 1 THEN 100 ELSE 1 END)::double AS n FROM vec),
g AS (SELECT l.pos * 3 + k AS i, sum(e * w2 * (1 - h * h) * x) AS g FROM l JOIN h USING (id) JOIN e USING (id) GROUP BY 1
  UNION ALL SELECT 192 + k, sum(e * w2 * (1 - h * h)) FROM h JOIN e USING (id) GROUP BY 1
  UNION ALL SELECT 195 + k, sum(e * h) FROM h JOIN e USING (id) GROUP BY 1
  UNION ALL SELECT 198, sum(e) FROM e)
SELECT i::int AS i, round(g / n, 6) AS grad FROM g, n"""


@query("network_weighted_gradient", with_sql(VEC_LONG_SQL + NET_SQL))
def _(spark, sf):
    """One weighted gradient of a given network, positives a hundredfold."""
    g, _ = network.gradient(network.weighted_rows(frames.vec(spark, sf), "target", pos_weight=100.0), np.array(NET_THETA), NET)
    return rounded(spark.createDataFrame([(i, float(v)) for i, v in enumerate(g)], "i int, grad double"), ["grad"])


@query(
    "balanced_forest_draws",
    with_sql(VEC_SQL)
    + """, c AS (SELECT target, count(*)::double AS n FROM vec GROUP BY 1),
    rate AS (SELECT target, (SELECT min(n) FROM c) / n AS r FROM c),
    cdf AS (SELECT target, k, sum(exp(-r) * r ** j / factorial(j::int)) AS below FROM rate, range(14) a(k), range(14) b(j) WHERE j <= k GROUP BY 1, 2),
    u AS (SELECT id, target, tree, ('0x' || substr(md5('42|balanced|' || tree || '|' || id), 1, 8))::bigint / 4294967296::double AS u FROM vec, range(4) t(tree)),
    d AS (SELECT u.tree, u.target, id, count_if(u >= below) AS n FROM u JOIN cdf USING (target) GROUP BY 1, 2, 3)
    SELECT tree::int AS tree, target, count(*) FILTER (WHERE n > 0) AS rows, sum(n)::bigint AS draws FROM d GROUP BY 1, 2""",
)
def _(spark, sf):
    """Rows and draws of each class in the bootstraps of the first trees."""
    v, out = frames.vec(spark, sf).select("id", "target"), None
    for tree in range(4):
        n = balanced_draws(v, "target", tree, 42, "id", "n").groupBy(F.lit(tree).alias("tree"), "target")
        n = n.agg(F.count_if(F.col("n") > 0).alias("rows"), F.sum("n").cast("long").alias("draws"))
        out = n if out is None else out.unionByName(n)
    return out


@query("boosting_early_stop")
def _(spark, sf):
    train, test = split_vec(spark, sf)
    train = train.withColumn("hold", hash_unit("hold", F.col("id")) < d(0.2))
    m = fit_model(train, "target", "gbt", {"rounds": 15, "depth": 2, "lr": 0.3}, valid="hold")
    return m.score(test).select("id", "target", r6("p").alias("p"))


GNB_SQL = """, st AS (SELECT target, pos, count(*)::double AS n, avg(x) AS m, var_pop(x) AS v FROM l GROUP BY 1, 2),
eps AS (SELECT 1e-9::double * max(v) AS eps FROM (SELECT var_pop(x) AS v FROM l GROUP BY pos)),
ll AS (SELECT id, l.target, st.target AS c, ln(any_value(n) / (SELECT count(*) FROM vec)) - 0.5 * sum(ln(2 * pi() * (v + eps)) + (x - m) ** 2 / (v + eps)) AS ll
  FROM l JOIN st USING (pos), eps GROUP BY 1, 2, 3),
scored AS (SELECT id, any_value(target) AS y, 1 / (1 + exp(max(ll) FILTER (WHERE c = 0) - max(ll) FILTER (WHERE c = 1))) AS p FROM ll GROUP BY 1)"""


@query("gaussian_nb", with_sql(VEC_LONG_SQL + GNB_SQL) + "SELECT id, y AS target, round(p, 6) AS p FROM scored")
def _(spark, sf):
    v = frames.vec(spark, sf)
    return fit_model(v, "target", "gnb").score(v).select("id", "target", r6("p").alias("p"))


@query(
    "adaboost_weight_round",
    with_sql(VEC_SQL)
    + """, s AS (SELECT id, target, (CASE WHEN features[1] <= 0 THEN 1 ELSE 0 END) AS pred, features FROM vec),
    e AS (SELECT avg((pred <> target)::int) AS err FROM s)
    SELECT id, round(err, 6) AS err, round(CASE WHEN pred <> target THEN (1 - err) / err ELSE 1 END, 6) AS weight FROM s, e""",
)
def _(spark, sf):
    """One reweighting with a given stump on the first coordinate."""
    import math

    v = frames.vec(spark, sf).withColumn("y", F.col("target").cast("double"))
    pred = (F.get("features", F.lit(0)) <= d(0)).cast("int")
    err = v.agg(F.avg((pred != F.col("target")).cast("double"))).first()[0]
    state = {"f": [0.0], "t": [0.0], "lo": [1.0], "hi": [-1.0], "alpha": [math.log((1 - err) / err)]}
    return v.select("id", r6(d(err)).alias("err"), r6(boosted_weight(d(1), F.col("y"), state)).alias("weight"))


# ---- ensembles

TREE, LIN, NB = ("tree", {"depth": 4}), ("logreg", {"reg": 0.01}), ("gnb", {})


@query("stacking")
def _(spark, sf):
    train, test = split_vec(spark, sf)
    m = ensembles.fit_stacking(train, "target", [TREE, LIN], NB, folds=3)
    return m.score(test).select("id", "target", r6("p").alias("p"))


@query("stacking_passthrough")
def _(spark, sf):
    train, test = split_vec(spark, sf)
    m = ensembles.fit_stacking(train, "target", [TREE, NB], LIN, folds=2, passthrough=True)
    return m.score(test).select("id", "target", r6("p").alias("p"))


@query("cascade_forest")
def _(spark, sf):
    train, test = split_vec(spark, sf)
    m = ensembles.fit_cascade_forest(train, "target", 2, ("rf", {"trees": 10, "depth": 4}), valid=test, folds=2)
    return m.score(test).select("id", "target", r6("p").alias("p"))


@query("two_objective_pair")
def _(spark, sf):
    train, test = split_vec(spark, sf)
    grid = {"reg": [0.001, 0.01, 0.1, 1.0]}
    m, _ = ensembles.fit_two_objective(train, "target", "logreg", grid, n=3)
    return m.score(test).select("id", "target", r6("p").alias("p"))


def with_base(spark, sf):
    train, test = split_vec(spark, sf)
    base = fit_model(train, "target", "tree", {"depth": 3})
    return stage(base.score(train, "base_p")), stage(base.score(test, "base_p"))


@query("hard_example_corrector")
def _(spark, sf):
    train, test = with_base(spark, sf)
    meta = ensembles.fit_meta(train, "target", "base_p", "gnb")
    from riskframe.operators.ensemble import cascade_label

    out = cascade_label(meta.score(test, "meta_p"), "base_p", "meta_p")
    return out.select("id", "target", r6("base_p").alias("base_p"), r6("meta_p").alias("meta_p"), "prediction")


@query("meta_model_bakeoff")
def _(spark, sf):
    train, test = with_base(spark, sf)
    kinds = [("gbt", {"rounds": 3, "depth": 2}), ("rf", {"trees": 10, "depth": 3}), ("linsvc", {"iterations": 10}), ("logreg", {})]
    hard = stage(schema.hard_rows(train, "base_p", "target"))
    train = hard if hard.select("target").distinct().count() == 2 else train
    return rounded(ensembles.meta_bakeoff(train, test, "target", "base_p", kinds), ["threshold", "precision", "recall", "fbeta"])


@query("refit_train_validation")
def _(spark, sf):
    train, test = split_vec(spark, sf)
    parts = stage(sample.stratified_split(train, "target", {"valid": 0.2}, 7))
    out = ensembles.refit(parts.filter("part = 'train'"), parts.filter("part = 'valid'"), test, "target", [TREE, NB])
    return rounded(out, [*RATE_COLS, "auc", "score", "threshold"])


# ---- evaluation and search


@query("holdout_evaluation")
def _(spark, sf):
    train, test = split_vec(spark, sf)
    return rounded(search.holdout(train, test, "target", "logreg"), [*RATE_COLS, "auc", "score"])


@query("in_sample_evaluation", with_sql(VEC_LONG_SQL + GNB_SQL) + eval_sql("p"))
def _(spark, sf):
    v = frames.vec(spark, sf)
    return rounded(search.holdout(v, v, "target", "gnb"), [*RATE_COLS, "auc", "score"])


FOLD_SQL = """, fd AS (SELECT id, ((row_number() OVER (PARTITION BY target ORDER BY md5('42|fold|' || id)) - 1) % 3) AS fold FROM vec),
lf AS (SELECT l.*, fold FROM l JOIN fd USING (id)),
st AS (SELECT k.f, target, pos, count(*)::double AS n, avg(x) AS m, var_pop(x) AS v FROM lf, range(3) k(f) WHERE fold <> k.f GROUP BY 1, 2, 3),
eps AS (SELECT f, 1e-9::double * max(v) AS eps FROM (SELECT k.f, pos, var_pop(x) AS v FROM lf, range(3) k(f) WHERE fold <> k.f GROUP BY 1, 2) GROUP BY 1),
ll AS (SELECT id, lf.target, lf.fold, st.target AS c, ln(any_value(n)) - 0.5 * sum(ln(2 * pi() * (v + eps)) + (x - m) ** 2 / (v + eps)) AS ll
  FROM lf JOIN st ON st.f = lf.fold AND st.pos = lf.pos JOIN eps ON eps.f = lf.fold GROUP BY 1, 2, 3, 4),
sc AS (SELECT id, fold, any_value(target) AS y, 1 / (1 + exp(max(ll) FILTER (WHERE c = 0) - max(ll) FILTER (WHERE c = 1))) AS p FROM ll GROUP BY 1, 2),
pairs AS (SELECT a.fold, avg(CASE WHEN a.p > b.p THEN 1 WHEN a.p = b.p THEN 0.5 ELSE 0 END) AS auc FROM sc a JOIN sc b ON a.fold = b.fold AND a.y = 1 AND b.y = 0 GROUP BY 1)"""


@query(
    "cross_validated_score",
    with_sql(VEC_LONG_SQL + FOLD_SQL) + "SELECT 'auc' AS metric, count(*)::int AS folds, round(avg(auc), 6) AS mean, round(2 * stddev_pop(auc), 6) AS spread FROM pairs",
)
def _(spark, sf):
    return rounded(search.cv_score(frames.vec(spark, sf), "target", "gnb", folds=3), ["mean", "spread"])


@query("random_parameter_search")
def _(spark, sf):
    grid = {"depth": [2, 3, 4, 5], "seed": [1, 2]}
    return rounded(search.random_search(frames.vec(spark, sf), "target", "tree", grid, 4, "auc")[1], ["score"])


# ---- importances and selection


def importance(fn):
    def run(spark, sf):
        imp = search.importance_frame(spark, fn(frames.vec(spark, sf)))
        return rounded(select.top_k(imp, fraction=0.3), ["score"])

    return run


query("forest_importance")(importance(lambda v: search.tree_importance(v, "target", "rf", {"trees": 20, "depth": 5})))
query("balanced_forest_importance")(importance(lambda v: search.tree_importance(v, "target", "brf", {"trees": 20, "depth": 5})))
query("boosting_importance")(importance(lambda v: search.tree_importance(v, "target", "gbt", {"rounds": 5, "depth": 3})))
query("network_weight_importance")(importance(lambda v: search.mlp_importance(v, "target", [8], 20)))


@query("forest_regressor_importance")
def _(spark, sf):
    """Vector column kept whole; the company numbers compete for the remaining places."""
    df = frames.company_table(spark, sf, "company_id", *NUMERIC, "zero_var", "target")
    df = schema.assemble(clean.apply_impute(df, clean.fit_impute(df, NUMERIC)), [*NUMERIC, "zero_var"])
    df = stage(df.select("company_id", "features", "target"))
    imp = search.importance_frame(spark, search.tree_importance(df, "target", "rf_reg", {"trees": 20, "depth": 5}))
    return rounded(select.top_k(imp, 5), ["score"])


@query("importance_table")
def _(spark, sf):
    m = fit_model(frames.vec(spark, sf), "target", "rf", {"trees": 20, "depth": 5})
    return rounded(explain.importance_table(m.importances(), [f"f{i}" for i in range(64)], spark), ["importance"])


PERMUTED_SQL = """, st AS (SELECT target, pos, count(*)::double AS n, avg(x) AS m, var_pop(x) AS v FROM l GROUP BY 1, 2),
eps AS (SELECT 1e-9::double * max(v) AS eps FROM (SELECT var_pop(x) AS v FROM l GROUP BY pos)),
w AS (SELECT a.pos, a.n AS n0, b.n AS n1, a.m AS m0, b.m AS m1, a.v + eps AS v0, b.v + eps AS v1 FROM st a JOIN st b ON a.pos = b.pos AND a.target = 0 AND b.target = 1, eps),
own AS (SELECT id, l.target, pos, 0.5 * (ln(v0 / v1) + (x - m0) ** 2 / v0 - (x - m1) ** 2 / v1) AS term, n1 / n0 AS odds FROM l JOIN w USING (pos)),
margin AS (SELECT id, any_value(target) AS target, ln(any_value(odds)) + sum(term) AS m FROM own GROUP BY 1),
turn AS (SELECT id, r, row_number() OVER (PARTITION BY r ORDER BY md5('42|left|' || r || '|' || id)) AS a, row_number() OVER (PARTITION BY r ORDER BY md5('42|right|' || r || '|' || id)) AS b FROM vec, range(3) k(r)),
pairs AS (SELECT x.r, x.id, y.id AS partner FROM turn x JOIN turn y ON x.r = y.r AND x.a = y.b),
kept AS (SELECT r, o.pos, avg(((margin.m - o.term + q.term >= 0)::int = o.target)::int) AS kept
  FROM pairs JOIN own o USING (id) JOIN own q ON q.id = partner AND q.pos = o.pos JOIN margin ON margin.id = o.id GROUP BY 1, 2),
base AS (SELECT avg(((m >= 0)::int = target)::int) AS a FROM margin)
SELECT pos::int AS pos, round(avg(a - kept), 6) AS mean, round(stddev_pop(a - kept), 6) AS std FROM kept, base GROUP BY 1"""


@query("permutation_importance", with_sql(VEC_LONG_SQL + PERMUTED_SQL))
def _(spark, sf):
    v = frames.vec(spark, sf)
    out = search.permutation_importance(v, fit_model(v, "target", "gnb"), "target", repeats=3)
    return rounded(out, ["mean", "std"])


def _table(spark, rank, selected):
    return spark.createDataFrame([(i, int(r), int(i in set(selected))) for i, r in enumerate(rank)], "pos int, rank int, selected int")


@query("recursive_elimination")
def _(spark, sf):
    out = search.rfe(frames.vec(spark, sf), "target", "logreg", {"iterations": 15}, step=0.25)
    return _table(spark, out["rank"], out["selected"])


@query("recursive_elimination_cv")
def _(spark, sf):
    out = search.rfecv(frames.vec(spark, sf), "target", "logreg", {"iterations": 10}, folds=2, step=20, min_features=8)
    return spark.createDataFrame([(k, float(v), int(k == len(out["selected"]))) for k, v in sorted(out["history"].items())], "n int, auc double, best int").withColumn("auc", r6("auc"))


COMPANY_LONG_SQL = (
    with_sql(COMPANY_SQL)
    + ", raw AS (SELECT company_id AS id, target, unnest(generate_series(1, 7)) AS pos, unnest(["
    + ", ".join(f"{c}::double" for c in NUMERIC)
    + """]) AS x FROM company),
    f AS (SELECT id, target, pos, coalesce(x, avg(x) OVER (PARTITION BY pos)) AS x FROM raw)"""
)


def forward_sql(width: int, folds: int, least: int) -> str:
    """Naive Bayes on every subset of the company numbers, then the greedy rounds one after another."""
    sql = COMPANY_LONG_SQL + f""",
    fd AS (SELECT company_id AS id, ((row_number() OVER (PARTITION BY target ORDER BY md5('42|fold|' || company_id)) - 1) % {folds}) AS fold FROM company),
    lf AS (SELECT f.*, fold FROM f JOIN fd USING (id)),
    st AS (SELECT k.f AS fold, target, pos, count(*)::double AS n, avg(x) AS m, var_pop(x) AS v FROM lf, range({folds}) k(f) WHERE lf.fold <> k.f GROUP BY 1, 2, 3),
    ov AS (SELECT k.f AS fold, pos, var_pop(x) AS v FROM lf, range({folds}) k(f) WHERE lf.fold <> k.f GROUP BY 1, 2),
    eps AS (SELECT s, fold, 1e-9::double * max(v) AS eps FROM ov, range(1, {2**width}) t(s) WHERE (s >> (pos - 1)) & 1 = 1 GROUP BY 1, 2),
    ll AS (SELECT s, id, lf.fold, lf.target AS y, st.target AS c, ln(any_value(n)) - 0.5 * sum(ln(v + eps) + (x - m) ** 2 / (v + eps) ORDER BY lf.pos) AS ll
      FROM lf JOIN st ON st.fold = lf.fold AND st.pos = lf.pos JOIN eps ON eps.fold = lf.fold AND (s >> (lf.pos - 1)) & 1 = 1 GROUP BY 1, 2, 3, 4, 5),
    sc AS (SELECT s, id, fold, y, 1 / (1 + exp(max(ll) FILTER (WHERE c = 0) - max(ll) FILTER (WHERE c = 1))) AS p FROM ll GROUP BY 1, 2, 3, 4),
    rk AS (SELECT s, fold, y, rank() OVER (PARTITION BY s, fold ORDER BY p) + (count(*) OVER (PARTITION BY s, fold, p) - 1) / 2.0::double AS r FROM sc),
    auc AS (SELECT s, round(avg(a), 12) AS auc FROM (SELECT s, (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0::double) / (sum(y) * sum(1 - y)) AS a FROM rk GROUP BY s, fold) GROUP BY 1),
    r0 AS (SELECT 0::bigint AS s, -1.0::double AS best, []::bigint[] AS picked, false AS over)"""
    for i in range(width):
        sql += f""",
    t{i} AS (SELECT r{i}.*, c, auc FROM r{i}, range({width}) k(c) JOIN auc ON auc.s = r{i}.s | (1::bigint << c) WHERE (r{i}.s >> c) & 1 = 0 ORDER BY auc DESC, c DESC LIMIT 1),
    r{i + 1} AS (SELECT CASE WHEN stop THEN s ELSE s | (1::bigint << c) END AS s, CASE WHEN stop THEN best ELSE greatest(best, auc) END AS best,
      CASE WHEN stop THEN picked ELSE list_append(picked, c) END AS picked, stop AS over FROM (SELECT *, over OR (auc <= best AND len(picked) >= {least}) AS stop FROM t{i}))"""
    return sql + f"""
    SELECT c::int AS pos, (row_number() OVER (ORDER BY coalesce(list_position(picked, c), {width} + 1), c))::int AS rank, ((s >> c) & 1)::int AS selected
    FROM r{width}, range({width}) k(c)"""


@query("forward_addition", forward_sql(len(NUMERIC), 2, 2))
def _(spark, sf):
    df = frames.company_table(spark, sf, "company_id", *NUMERIC, "target")
    df = schema.assemble(clean.apply_impute(df, clean.fit_impute(df, NUMERIC)), NUMERIC).select("company_id", "features", "target")
    out = search.forward_addition(df, "target", "gnb", folds=2, min_features=2, key="company_id")
    return _table(spark, out["rank"], out["order"])


@query("search_k_best")
def _(spark, sf):
    return rounded(search.search_k(frames.vec(spark, sf), "target", (10, 30, 50), "gnb", folds=3), ["auc"])


# ---- bundles and batch scoring


def company_bundle(spark, sf):
    """Fill and scaling fitted on the company numbers: (bundle, training rows, company table)."""
    df = frames.company_table(spark, sf, "company_id", *NUMERIC, "target")
    impute = clean.fit_impute(df, NUMERIC)
    filled = clean.apply_impute(df, impute)
    scaled = scale.fit_scale(filled, NUMERIC, "standard")
    train = stage(schema.assemble(scale.apply_scale(filled, scaled), NUMERIC).select("company_id", "features", "target"))
    bundle = {"cols": NUMERIC, "impute": impute, "scale": scaled, "threshold": 0.1}
    return bundle, train, df


@query("batch_scoring")
def _(spark, sf):
    bundle, train, df = company_bundle(spark, sf)
    bundle["model"] = fit_model(train, "target", "logreg", key="company_id")
    return rounded(score.score_batch(df, bundle), ["proba"])


COMPANY_GNB_SQL = (
    COMPANY_LONG_SQL
    + """,
    l AS (SELECT id, target, pos, (x - avg(x) OVER (PARTITION BY pos)) / stddev_pop(x) OVER (PARTITION BY pos) AS x FROM f)"""
    + GNB_SQL.replace("FROM vec)", "FROM company)")
    + "SELECT id AS uuid, round(p, 6) AS proba, (p >= 0.1)::int AS prediction FROM scored"
)


@query("pipeline_scoring", COMPANY_GNB_SQL)
def _(spark, sf):
    """Raw table to submission by one fitted pipeline, saved in a bundle and loaded again."""
    df = frames.company_table(spark, sf, "company_id", *NUMERIC, "target")
    steps = [stages.FillMissing(inputCols=NUMERIC), stages.Scale(inputCols=NUMERIC), stages.Assemble(inputCols=NUMERIC), stages.Classify(kind="gnb")]
    path = shared_folder(spark, f"pipeline-{uuid.uuid4().hex}")
    io.save_bundle({"pipeline": Pipeline(stages=steps).fit(df), "threshold": 0.1}, path, spark)
    return rounded(score.score_batch(df, io.load_bundle(spark, path)), ["proba"])


@query("feature_pipeline")
def _(spark, sf):
    """Codes, fills, scaling, row statistics, clusters, isolation, outlier factor, selection and projection in one pipeline."""
    df = frames.company_table(spark, sf, "company_id", *NUMERIC, *STRINGS, "target")
    steps = [
        stages.TargetEncode(inputCols=STRINGS), stages.FillMissing(inputCols=NUMERIC, strategy="median"), stages.Scale(inputCols=NUMERIC, kind="robust"),
        stages.Assemble(), stages.RowStatistics(), stages.ClusterDistances(k=4), stages.Isolation(trees=20), stages.OutlierFactor(k=5),
        stages.Select(method="anova", k=12), stages.Projection(kind="svd", k=6), stages.Classify(kind="logreg"),
    ]
    return rounded(score.score_batch(df, {"pipeline": Pipeline(stages=steps).fit(df)}), ["proba"])


@query("cascade_scoring")
def _(spark, sf):
    bundle, train, df = company_bundle(spark, sf)
    bundle["positions"] = [0, 1, 2, 4, 5, 6]
    rows = schema.slice_features(train, bundle["positions"])
    bundle["model"] = fit_model(rows, "target", "tree", {"depth": 4}, key="company_id")
    bundle["meta"] = ensembles.fit_meta(bundle["model"].score(rows, "base_p"), "target", "base_p", "gnb", key="company_id")
    return rounded(score.score_cascade(df, bundle), ["proba"])


@query("aligned_scoring")
def _(spark, sf):
    """Train with one-hot columns, score a table that lacks one column and has an extra one."""
    df = frames.company_table(spark, sf, "company_id", *NUMERIC, *STRINGS, "target")
    onehot = encode.fit_onehot(df, STRINGS)
    wide = encode.apply_onehot(df, onehot).na.fill(0.0)
    cols = [c for c in wide.columns if c not in ("company_id", "target")]
    train = schema.assemble(wide, cols).select("company_id", "features", "target")
    bundle = {"cols": cols, "onehot": onehot, "threshold": 0.1, "impute": clean.fit_impute(df, NUMERIC, "constant", 0.0)}
    bundle["model"] = ensembles.fit_stacking(train, "target", [TREE, NB], LIN, folds=2, key="company_id")
    return rounded(score.score_aligned(df.drop("open_avg").withColumn("extra", F.lit(1)), bundle), ["proba"])


@query("bundle_round_trip")
def _(spark, sf):
    """Scores of the saved and reloaded bundle next to those of the live one."""
    bundle, train, df = company_bundle(spark, sf)
    bundle["model"] = fit_model(train, "target", "rf", {"trees": 10, "depth": 4}, key="company_id")
    path = scratch(spark)
    io.save_bundle(bundle, path, spark)
    loaded = io.load_bundle(spark, path)
    live = score.score_batch(df, bundle).select("uuid", F.col("proba").alias("live"))
    back = score.score_batch(df, loaded).select("uuid", F.col("proba").alias("reloaded"))
    return rounded(live.join(back, "uuid"), ["live", "reloaded"])


@query("threshold_transfer")
def _(spark, sf):
    """Threshold chosen on validation rows that the fit has not seen, applied to the test rows."""
    train, test = split_vec(spark, sf)
    parts = stage(sample.stratified_split(train, "target", {"valid": 0.2}, 7))
    m = fit_model(parts.filter("part = 'train'"), "target", "gnb")
    t = thresholds.best_f1_threshold(m.score(parts.filter("part = 'valid'")), "target", "p").first()["threshold"]
    return rounded(metrics.evaluate(m.score(test), "target", "p", t), [*RATE_COLS, "auc", "score"])
