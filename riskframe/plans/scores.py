"""Votes, metrics, thresholds, result tables, linear scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions.exprs import d, hash_unit, r6
from riskframe.operators import clean, ensemble, explain, metrics, scale, schema, score, thresholds
from riskframe.operators.select import fisher_ratio
from riskframe.plans.basic import FISHER_SQL, MEANS_SQL, VEC_LONG_SQL, rounded
from riskframe.plans.registry import query
from riskframe.sources import frames
from riskframe.sources.frames import COMPANY_SQL, NUMERIC, SCORED_SQL, with_sql

S = with_sql(SCORED_SQL)

# ---- votes and cascades


@query("soft_vote", S + "SELECT id, round((p_a + p_b) / 2 + 1e-10::double, 6) AS p_vote, ((p_a + p_b) / 2 >= 0.5)::int AS prediction FROM scored")
def _(spark, sf):
    out = ensemble.soft_vote(frames.scored(spark, sf), ["p_a", "p_b"])
    out = thresholds.apply_threshold(out, "p_vote", 0.5)
    return out.select("id", r6(F.col("p_vote") + d(frames.TIE)).alias("p_vote"), "prediction")


@query("hard_vote", S + "SELECT id, round_even(((p_a >= 0.5)::int + (p_b >= 0.5)::int) / 2, 0)::int AS vote FROM scored")
def _(spark, sf):
    df = thresholds.apply_threshold(thresholds.apply_threshold(frames.scored(spark, sf), "p_a", 0.5, "a"), "p_b", 0.5, "b")
    return ensemble.hard_vote(df, ["a", "b"]).select("id", "vote")


@query(
    "weighted_vote",
    S + "SELECT id, round(0.3::double * p_a + 0.7::double * p_b + 1e-10::double, 6) AS p_weighted, (0.3::double * p_a + 0.7::double * p_b >= 0.5)::int AS vote FROM scored",
)
def _(spark, sf):
    out = ensemble.weighted_vote(frames.scored(spark, sf), ["p_a", "p_b"], [0.3, 0.7])
    return out.select("id", r6(F.col("p_weighted") + d(frames.TIE)).alias("p_weighted"), "vote")


def auc_sql(p, frame="scored", y="y"):
    """Mann-Whitney from average ranks."""
    return f"""(SELECT (sum(rk) FILTER (WHERE y = 1) - n1 * (n1 + 1) / 2) / (n1 * n0) FROM (
      SELECT {y} AS y, rank() OVER (ORDER BY {p}) + (count(*) OVER (PARTITION BY {p}) - 1) / 2 AS rk,
        sum({y}) OVER ()::double AS n1, sum(1 - {y}) OVER ()::double AS n0 FROM {frame}) GROUP BY n1, n0)"""


@query(
    "auc_weighted_ensemble",
    S + f", w AS (SELECT {auc_sql('p_a')} AS a, {auc_sql('p_b')} AS b) SELECT id, round(greatest(least(a / (a + b) * p_a + b / (a + b) * p_b, 1), 0), 6) AS p_auc FROM scored, w",
)
def _(spark, sf):
    df = frames.scored(spark, sf)
    return rounded(ensemble.auc_weighted(df, ["p_a", "p_b"], df, "y"), ["p_auc"]).select("id", "p_auc")


BAND = "p_a > 0.3 AND p_a < 0.7"


@query("cascade_label", S + f"SELECT id, p_a, CASE WHEN {BAND} THEN (p_b >= 0.5)::int ELSE (p_a >= 0.5)::int END AS prediction FROM scored")
def _(spark, sf):
    return ensemble.cascade_label(frames.scored(spark, sf), "p_a", "p_b").select("id", "p_a", "prediction")


@query(
    "cascade_proba",
    S + f"SELECT id, CASE WHEN {BAND} THEN p_b ELSE p_a END AS proba, CASE WHEN {BAND} THEN (CASE WHEN p_b >= 0.5 THEN 0.9::double ELSE 0.1::double END) ELSE p_a END AS proba_label FROM scored",
)
def _(spark, sf):
    df = thresholds.apply_threshold(ensemble.cascade_proba(frames.scored(spark, sf), "p_a", "p_b"), "p_b", 0.5, "z")
    return ensemble.cascade_proba(df, "p_a", meta_label="z", out="proba_label").select("id", "proba", "proba_label")


# ---- metrics


def conf_sql(p="p_a", t=0.5, frame="scored", y="y"):
    return f"""SELECT count(*) FILTER (WHERE {p} >= {t} AND {y} = 1) AS tp, count(*) FILTER (WHERE {p} >= {t} AND {y} = 0) AS fp,
      count(*) FILTER (WHERE {p} < {t} AND {y} = 1) AS fn, count(*) FILTER (WHERE {p} < {t} AND {y} = 0) AS tn FROM {frame}"""


RATES_SQL = """tp, fp, fn, tn, (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r,
  coalesce(tn / nullif(tn + fp, 0), 0) AS s"""
OUT_SQL = """tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(s, 6) AS specificity,
  round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, round(coalesce(2.44::double * p * r / nullif(1.44::double * p + r, 0), 0), 6) AS fbeta"""
RATE_COLS = ["accuracy", "precision", "recall", "specificity", "f1", "fbeta"]


@query("confusion_counts", S + conf_sql())
def _(spark, sf):
    return metrics.confusion(frames.scored(spark, sf), "y", "p_a")


@query("classification_rates", S + f"SELECT {OUT_SQL} FROM (SELECT {RATES_SQL} FROM ({conf_sql('p_b')}))")
def _(spark, sf):
    return rounded(metrics.rates(metrics.confusion(frames.scored(spark, sf), "y", "p_b")), RATE_COLS)


@query(
    "classification_report",
    S
    + """, x AS (SELECT y, (p_b >= 0.5)::int AS z FROM scored),
    k AS (SELECT c::varchar AS class, (SELECT count(*) FROM x WHERE y = c) AS support, (SELECT count(*) FROM x WHERE z = c) AS predicted,
      (SELECT count(*) FROM x WHERE y = c AND z = c) AS tp FROM (VALUES (0), (1)) v(c)),
    m AS (SELECT class, coalesce(tp / nullif(predicted, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r, support FROM k),
    f AS (SELECT class, p, r, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f, support FROM m)
    SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM f
    UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(support)::bigint FROM f
    UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6), sum(support)::bigint FROM f""",
)
def _(spark, sf):
    df = thresholds.apply_threshold(frames.scored(spark, sf), "p_b", 0.5)
    return rounded(metrics.report(df, "y", "prediction"), ["precision", "recall", "f1"])


@query("roc_auc", S + f"SELECT 'p_a' AS model, round({auc_sql('p_a')}, 6) AS auc UNION ALL SELECT 'p_b', round({auc_sql('p_b')}, 6)")
def _(spark, sf):
    long = metrics.stack_scores(frames.scored(spark, sf), "y", ["p_a", "p_b"])
    return rounded(metrics.roc_auc(long, "y", "p", ["model"]), ["auc"])


CURVE_SQL = """, h AS (SELECT p_b AS threshold, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY 1),
c AS (SELECT threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS n1, sum(neg) OVER () AS n0 FROM h WINDOW w AS (ORDER BY threshold DESC)),
pr AS (SELECT threshold, tp / (tp + fp) AS p, tp / n1 AS r FROM c)"""
CURVE_A_SQL = CURVE_SQL.replace("p_b", "p_a")


@query("roc_curve", S + CURVE_A_SQL + "SELECT threshold, round(fp / n0, 6) AS fpr, round(tp / n1, 6) AS tpr FROM c")
def _(spark, sf):
    return rounded(metrics.roc_curve(frames.scored(spark, sf), "y", "p_a"), ["fpr", "tpr"])


@query("pr_curve", S + CURVE_A_SQL + "SELECT threshold, round(p, 6) AS precision, round(r, 6) AS recall FROM pr UNION ALL SELECT NULL, 1, 0")
def _(spark, sf):
    return rounded(metrics.pr_curve(frames.scored(spark, sf), "y", "p_a"), ["precision", "recall"])


@query(
    "pr_auc",
    S
    + CURVE_SQL
    + """, t AS (SELECT p, r, lag(p, 1, 1::double) OVER (ORDER BY threshold DESC) AS p0, lag(r, 1, 0::double) OVER (ORDER BY threshold DESC) AS r0 FROM pr)
    SELECT round(sum((r - r0) * (p + p0) / 2), 6) AS pr_auc FROM t""",
)
def _(spark, sf):
    return rounded(metrics.pr_auc(frames.scored(spark, sf), "y", "p_b"), ["pr_auc"])


def eval_sql(p, t=0.5):
    return f"""SELECT {OUT_SQL}, round(auc, 6) AS auc, round(20 * p + 50 * auc + 30 * r, 6) AS score
    FROM (SELECT {RATES_SQL}, {auc_sql(p)} AS auc FROM ({conf_sql(p, t)}))"""


@query("composite_score", S + f"SELECT round(20 * precision + 50 * auc + 30 * recall, 4) AS s1, round(0.2 * precision + 0.4 * auc + 0.4 * recall, 4) AS s2 FROM ({eval_sql('p_b', 0.4)})")
def _(spark, sf):
    m = rounded(metrics.evaluate(frames.scored(spark, sf), "y", "p_b", 0.4).drop("score"), ["precision", "recall", "auc"])
    out = metrics.composite(metrics.composite(m, out="s1"), 0.2, 0.4, 0.4, out="s2")
    return out.select(F.round("s1", 4).alias("s1"), F.round("s2", 4).alias("s2"))


@query("holdout_metrics", S + eval_sql("p_a", 0.6))
def _(spark, sf):
    return rounded(metrics.evaluate(frames.scored(spark, sf), "y", "p_a", 0.6), [*RATE_COLS, "auc", "score"])


# ---- thresholds


@query(
    "best_f1_threshold",
    S + CURVE_A_SQL + ", f AS (SELECT threshold, p, r, 2 * p * r / (p + r + 1e-8::double) AS f1 FROM pr) SELECT threshold, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, threshold LIMIT 1",
)
def _(spark, sf):
    return rounded(thresholds.best_f1_threshold(frames.scored(spark, sf), "y", "p_a"), ["precision", "recall", "f1"])


@query(
    "max_recall_threshold",
    S + CURVE_A_SQL + "SELECT threshold, round(p, 6) AS precision, round(r, 6) AS recall FROM pr WHERE p >= 0.4 ORDER BY r DESC, threshold LIMIT 1",
)
def _(spark, sf):
    return rounded(thresholds.max_recall_threshold(frames.scored(spark, sf), "y", "p_a", 0.4), ["precision", "recall"])


def _grid_sql(lo, step, n, objective, p="p_b"):
    return (
        S
        + f""", g AS (SELECT {lo}::double + i * {step}::double AS threshold FROM range({n}) r(i)),
    m AS (SELECT threshold, count(*) FILTER (WHERE {p} >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE {p} >= threshold AND y = 0) AS fp,
      count(*) FILTER (WHERE {p} < threshold AND y = 1) AS fn, count(*) FILTER (WHERE {p} < threshold AND y = 0) AS tn FROM scored, g GROUP BY 1),
    q AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r, coalesce(tn / nullif(tn + fp, 0), 0) AS s FROM m),
    o AS (SELECT threshold, {objective} AS score, tp, fp, fn, tn FROM q)
    SELECT round(threshold, 6) AS threshold, round(score, 6) AS score, tp, fp, fn, tn FROM o ORDER BY o.score DESC, o.threshold LIMIT 1"""
    )


def _grid(kind, p="p_b"):
    def run(spark, sf):
        return rounded(thresholds.grid_threshold(frames.scored(spark, sf), "y", p, objective=kind), ["threshold", "score"])

    return run


query("gmean_threshold", _grid_sql(0.1, 0.01, 80, "sqrt(r * p)"))(_grid("gmean"))
query("cost_threshold", _grid_sql(0.2, 0.006, 101, "2 * r + 1.5::double * p - 0.5::double * (1 - s)"))(_grid("cost"))
query("youden_threshold", _grid_sql(0, 0.01, 101, "tp / (tp + fn + 1e-8::double) + tn / (tn + fp + 1e-8::double) - 1"))(_grid("youden"))
query("fbeta_threshold", _grid_sql(0, 0.01, 101, "coalesce(2.44::double * p * r / nullif(1.44::double * p + r, 0), 0)"))(_grid("fbeta"))


@query("apply_threshold", S + "SELECT id, (p_a >= 0.1)::int AS low, (p_a >= 0.7)::int AS high FROM scored")
def _(spark, sf):
    df = thresholds.apply_threshold(frames.scored(spark, sf), "p_a", 0.1, "low")
    return thresholds.apply_threshold(df, "p_a", 0.7, "high").select("id", "low", "high")


# ---- result tables

MODELS = ["p_a", "p_b", "p_mean"]


def _models(spark, sf):
    return ensemble.soft_vote(frames.scored(spark, sf), ["p_a", "p_b"], "p_mean")


def _models_sql():
    return with_sql(
        "base AS (" + SCORED_SQL.strip().split("(", 1)[1].rsplit(")", 1)[0] + ")", "scored AS (SELECT *, (p_a + p_b) / 2 AS p_mean FROM base)"
    ) + ", m AS (" + " UNION ALL ".join(f"SELECT '{p}' AS model, * FROM ({eval_sql(p)})" for p in MODELS) + ")"


@query(
    "leaderboard",
    _models_sql()
    + """SELECT *, row_number() OVER (ORDER BY score DESC, model)::int AS place, (row_number() OVER (ORDER BY auc DESC, model) = 1)::int AS best_auc,
      (row_number() OVER (ORDER BY f1 DESC, model) = 1)::int AS best_f1 FROM m""",
)
def _(spark, sf):
    m = rounded(metrics.evaluate_models(_models(spark, sf), "y", MODELS), [*RATE_COLS, "auc", "score"])
    return explain.leaderboard(m, "score")


@query(
    "ablation_table",
    _models_sql()
    + """SELECT model, f1, recall, auc, round((f1 - b1) * 100, 4) AS delta_f1, round((recall - b2) * 100, 4) AS delta_recall
    FROM m, (SELECT f1 AS b1, recall AS b2 FROM m WHERE model = 'p_mean') WHERE f1 > 0""",
)
def _(spark, sf):
    m = rounded(metrics.evaluate_models(_models(spark, sf), "y", MODELS), [*RATE_COLS, "auc"]).select("model", "f1", "recall", "auc")
    return explain.ablation_table(m, "p_mean").withColumns({c: F.round(c, 4) for c in ("delta_f1", "delta_recall")})


@query(
    "class_importance",
    with_sql(SCORED_SQL, VEC_LONG_SQL + FISHER_SQL)
    + """, a AS (SELECT avg(p_a) FILTER (WHERE y = 1) AS p, avg(1 - p_a) FILTER (WHERE y = 0) AS q FROM scored), t AS (SELECT sum(score) AS t FROM fisher)
    SELECT pos, round(p * score / (p * t + 1e-8::double), 6) AS importance_pos, round(q * score / (q * t + 1e-8::double), 6) AS importance_neg FROM fisher, a, t""",
)
def _(spark, sf):
    imp = fisher_ratio(frames.vec(spark, sf)).select("pos", "score")
    out = explain.class_importance(frames.scored(spark, sf), imp, "y", "p_a", "score")
    return rounded(out, ["importance_pos", "importance_neg"]).select("pos", "importance_pos", "importance_neg")


@query("top_true_positive", S + "SELECT id, p_a, (p_a > 0.5)::int AS hit FROM scored WHERE y = 1 ORDER BY hit DESC, p_a DESC, id LIMIT 1")
def _(spark, sf):
    return explain.top_true_positive(frames.scored(spark, sf), "y", "p_a", "id").select("id", "p_a", "hit")


OVR = ["F", "O", "P"]


@query(
    "ovr_auc",
    "WITH s AS (SELECT o_orderstatus AS st, "
    + ", ".join(
        f"round(0.7::double * (('0x' || substr(md5('{c}|' || o_orderkey), 1, 8))::bigint / 4294967296::double) + 0.3::double * (o_orderstatus = '{c}')::int, 3) AS p_{c}" for c in OVR
    )
    + " FROM orders), "
    + ", ".join(f"s_{c} AS (SELECT (st = '{c}')::int AS y, p_{c} AS p FROM s)" for c in OVR)
    + " SELECT round("
    + " + ".join(f"{auc_sql('p', f's_{c}')} * (SELECT sum(y) FROM s_{c})" for c in OVR).join("()")
    + " / (SELECT count(*) FROM s), 6) AS auc",
)
def _(spark, sf):
    t = frames.table(spark, sf, "orders")
    df = t.select(
        "o_orderstatus",
        *[
            F.round(d(0.7) * hash_unit(c, F.col("o_orderkey")) + d(0.3) * (F.col("o_orderstatus") == c).cast("int"), 3).alias(f"p_{c}")
            for c in OVR
        ],
    )
    return rounded(metrics.ovr_auc(df, "o_orderstatus", {c: f"p_{c}" for c in OVR}), ["auc"])


# ---- linear scoring and the scorecard

# Weights of the demonstration scorecard, one per numeric feature
WEIGHTS = {"n_orders": -0.4, "sum_price": 0.25, "avg_disc": 0.9, "max_qty": -0.15, "ret_share": 0.6, "urgent_avg": 0.35, "open_avg": -0.2}

FILL_SQL = (
    ", f AS (SELECT company_id, target, "
    + ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in NUMERIC)
    + f" FROM company, (SELECT {MEANS_SQL} FROM company)), st AS (SELECT "
    + ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in NUMERIC)
    + " FROM f), scored AS (SELECT company_id AS id, target AS y, round(1 / (1 + exp(-("
    + " + ".join(f"{w}::double * (({c} - a_{c}) / s_{c})" for c, w in WEIGHTS.items())
    + "))), 6) AS p FROM f, st)"
)


def scorecard(spark, sf):
    """company -> mean fill -> standardise -> weighted sigmoid."""
    df = frames.company_table(spark, sf, "company_id", *NUMERIC, "target")
    df = clean.apply_impute(df, clean.fit_impute(df, NUMERIC))
    df = scale.apply_scale(df, scale.fit_scale(df, NUMERIC, "standard"))
    return rounded(score.linear_score(df, WEIGHTS), ["p"]).select(F.col("company_id").alias("id"), F.col("target").alias("y"), "p")


@query("linear_score", with_sql(COMPANY_SQL + FILL_SQL) + "SELECT id, p FROM scored")
def _(spark, sf):
    return scorecard(spark, sf).select("id", "p")


@query(
    "risk_scorecard",
    with_sql(COMPANY_SQL + FILL_SQL)
    + CURVE_SQL.replace("p_b", "p")
    .replace("AS p,", "AS prec,")
    + f""", b AS (SELECT threshold AS t FROM pr ORDER BY 2 * prec * r / (prec + r + 1e-8::double) DESC, threshold LIMIT 1)
    SELECT t AS threshold, {OUT_SQL}, round(auc, 6) AS auc, round(20 * p + 50 * auc + 30 * r, 6) AS score
    FROM (SELECT t, {RATES_SQL}, {auc_sql('p')} AS auc FROM (SELECT any_value(t) AS t, {conf_sql('p', 't', 'scored, b').split('SELECT', 1)[1]}))""",
)
def _(spark, sf):
    """Flagship: clean, scale, score, best-F1 threshold, all metrics at that threshold in one row."""
    from riskframe.session import stage

    df = stage(scorecard(spark, sf))
    t = thresholds.best_f1_threshold(df, "y", "p").first()["threshold"]
    return rounded(metrics.evaluate(df, "y", "p", t), [*RATE_COLS, "auc", "score"]).withColumn("threshold", d(t))
