"""Exact ranking and classification metrics.

Curves start from one row per distinct score, so ties (however many rows share a score) are already
folded, and are accumulated by ``running_totals`` instead of a window over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.exprs import d, safe_div
from riskframe.operators.ranking import running_totals


def score_counts(df: DataFrame, label: str, p: str, by=()) -> DataFrame:
    """``(by, score, pos, neg)``: class counts per distinct score."""
    y = F.col(label).cast("bigint")
    return df.groupBy(*by, F.col(p).cast("double").alias("score")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def stack_scores(df: DataFrame, label: str, ps: dict[str, str] | list[str]) -> DataFrame:
    """One row per (row, score column): ``(model, label, p)``."""
    names = ps if isinstance(ps, dict) else {p: p for p in ps}
    return df.select(label, *[F.col(c).cast("double").alias(m) for m, c in names.items()]).unpivot([label], list(names), "model", "p")


def confusion(df: DataFrame, label: str, p: str, t: float = 0.5, by=()) -> DataFrame:
    """tp, fp, fn, tn at ``p >= t``."""
    hit, pos = F.col(p) >= d(t), F.col(label) == 1
    return df.groupBy(*by).agg(
        F.count_if(hit & pos).alias("tp"),
        F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & pos).alias("fn"),
        F.count_if(~hit & ~pos).alias("tn"),
    )


def fbeta(precision: Column, recall: Column, beta: float) -> Column:
    b = d(beta * beta)
    return safe_div((d(1) + b) * precision * recall, b * precision + recall)


def rates(conf: DataFrame, beta: float = 1.2) -> DataFrame:
    """accuracy, precision, recall, specificity, F1, F-beta; an empty denominator gives 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = conf.withColumns(
        {
            "accuracy": safe_div(tp + tn, tp + fp + fn + tn),
            "precision": safe_div(tp, tp + fp),
            "recall": safe_div(tp, tp + fn),
            "specificity": safe_div(tn, tn + fp),
        }
    )
    return out.withColumns({"f1": fbeta(F.col("precision"), F.col("recall"), 1.0), "fbeta": fbeta(F.col("precision"), F.col("recall"), beta)})


def roc_auc(df: DataFrame, label: str, p: str, by=()) -> DataFrame:
    """Exact AUC (Mann-Whitney, ties count one half) per ``by``."""
    return counted_auc(score_counts(df, label, p, by), by)


def counted_auc(counts: DataFrame, by=()) -> DataFrame:
    """Exact AUC from ``(by, score, pos, neg)``, one row per distinct score."""
    # both counts are carried through, so that totals and running sums share one shuffle of the counts
    cum = running_totals(counts, "score", ["pos", "neg"], by)
    wins = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / d(2)))
    return cum.groupBy(*by).agg(safe_div(wins, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def class_totals(df: DataFrame, label: str) -> tuple[int, int]:
    y = F.col(label).cast("bigint")
    r = df.agg(F.sum(y), F.sum(1 - y)).first()
    return int(r[0] or 0), int(r[1] or 0)


def curve_counts(df: DataFrame, label: str, p: str) -> DataFrame:
    """``(threshold, tp, fp, prev_tp, prev_fp)`` per distinct score, counting rows at or above it."""
    cum = running_totals(score_counts(df, label, p), "score", ["pos", "neg"], descending=True)
    return cum.select(
        F.col("score").alias("threshold"),
        F.col("cum_pos").alias("tp"),
        F.col("cum_neg").alias("fp"),
        (F.col("cum_pos") - F.col("pos")).alias("prev_tp"),
        (F.col("cum_neg") - F.col("neg")).alias("prev_fp"),
    )


def roc_curve(df: DataFrame, label: str, p: str) -> DataFrame:
    pos, neg = class_totals(df, label)
    return curve_counts(df, label, p).select(
        "threshold", safe_div(F.col("fp"), F.lit(neg)).alias("fpr"), safe_div(F.col("tp"), F.lit(pos)).alias("tpr")
    )


def pr_curve(df: DataFrame, label: str, p: str) -> DataFrame:
    """``(threshold, precision, recall)`` per distinct score; the closing point (1, 0) has no threshold."""
    pos, _ = class_totals(df, label)
    points = curve_counts(df, label, p).select(
        "threshold", safe_div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), safe_div(F.col("tp"), F.lit(pos)).alias("recall")
    )
    end = df.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return points.unionByName(end)


def pr_auc(df: DataFrame, label: str, p: str) -> DataFrame:
    """Trapezoid area under the PR curve. Each point carries its predecessor's counts, so no lag is needed."""
    pos, _ = class_totals(df, label)
    prec = safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    first = F.col("prev_tp") + F.col("prev_fp") == 0
    prev = F.when(first, d(1)).otherwise(safe_div(F.col("prev_tp"), F.col("prev_tp") + F.col("prev_fp")))
    width = safe_div(F.col("tp") - F.col("prev_tp"), F.lit(pos))
    return curve_counts(df, label, p).agg(F.sum(width * (prec + prev) / d(2)).alias("pr_auc"))


def composite(metrics: DataFrame, w_p: float = 20, w_auc: float = 50, w_r: float = 30, out: str = "score") -> DataFrame:
    """Weighted sum of precision, AUC and recall."""
    return metrics.withColumn(out, d(w_p) * F.col("precision") + d(w_auc) * F.col("auc") + d(w_r) * F.col("recall"))


def evaluate(df: DataFrame, label: str, p: str, t: float = 0.5, beta: float = 1.2) -> DataFrame:
    """All metrics of one score column in one row."""
    c, a = confusion(df, label, p, t), roc_auc(df, label, p)
    one = rates(c, beta).withColumn("__k", F.lit(1)).join(a.withColumn("__k", F.lit(1)), "__k").drop("__k")
    return composite(one)


def evaluate_models(df: DataFrame, label: str, ps, t: float = 0.5, beta: float = 1.2) -> DataFrame:
    """One metric row per score column, all models in the same jobs."""
    long = stack_scores(df, label, ps)
    return composite(rates(confusion(long, label, "p", t, ["model"]), beta).join(roc_auc(long, label, "p", ["model"]), "model"))


def report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Precision, recall, F1, support per class, then macro and weighted averages."""
    cells = df.groupBy(F.col(label).cast("string").alias("y"), F.col(pred).cast("string").alias("z")).agg(F.count("*").alias("n"))
    # from here on at most classes^2 rows
    side = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("y").alias("c"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                         F.when(F.col("y") == F.col("z"), F.col("n")).otherwise(F.lit(0)).alias("tp")),
                F.struct(F.col("z").alias("c"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                         F.lit(0).cast("bigint").alias("tp")),
            )
        ).alias("s")
    )
    per = side.groupBy(F.col("s.c").alias("class")).agg(F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum("s.tp").alias("tp"))
    per = per.select(
        "class", safe_div(F.col("tp"), F.col("predicted")).alias("precision"), safe_div(F.col("tp"), F.col("support")).alias("recall"), "support"
    ).withColumn("f1", fbeta(F.col("precision"), F.col("recall"), 1.0))
    cols = ["precision", "recall", "f1"]
    macro = per.agg(*[F.avg(c).alias(c) for c in cols], F.sum("support").alias("support")).withColumn("class", F.lit("macro avg"))
    weighted = per.agg(
        *[safe_div(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in cols], F.sum("support").alias("support")
    ).withColumn("class", F.lit("weighted avg"))
    return per.unionByName(macro).unionByName(weighted).select("class", *cols, "support")


def ovr_auc(df: DataFrame, label: str, ps: dict) -> DataFrame:
    """One-vs-rest AUC per class, averaged by class support. ``ps`` maps class value to its score column."""
    cells = F.array(
        *[F.struct(F.lit(str(k)).alias("class"), (F.col(label) == F.lit(k)).cast("int").alias("y"), F.col(p).cast("double").alias("p")) for k, p in ps.items()]
    )
    long = df.select(F.explode(cells).alias("s")).select("s.*")
    auc = roc_auc(long, "y", "p", ["class"])
    support = long.groupBy("class").agg(F.sum("y").alias("support"))
    return auc.join(support, "class").agg(safe_div(F.sum(F.col("auc") * F.col("support")), F.sum("support")).alias("auc"))
