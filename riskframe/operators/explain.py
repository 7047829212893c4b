"""Result tables: leaderboard, ablation, importances, best-scored positive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.exprs import d


def leaderboard(metrics: DataFrame, by: str = "auc", name: str = "model") -> DataFrame:
    """Rank by ``by`` and flag the best model by AUC and by F1. One row per model, so one small window."""
    one = lambda c: Window.partitionBy(F.lit(0)).orderBy(F.col(c).desc(), F.col(name))
    return metrics.withColumns(
        {
            "place": F.row_number().over(one(by)),
            "best_auc": (F.row_number().over(one("auc")) == 1).cast("int"),
            "best_f1": (F.row_number().over(one("f1")) == 1).cast("int"),
        }
    )


def ablation_table(metrics: DataFrame, baseline: str = "Full Model", name: str = "model") -> DataFrame:
    """Percentage-point differences of F1 and recall to the baseline row; failed runs (F1 = 0) are left out."""
    ok = metrics.filter(F.col("f1") > 0)
    base = ok.filter(F.col(name) == baseline).select("f1", "recall").first() or ok.orderBy(name, "f1", "recall").select("f1", "recall").first()
    if base is None:
        return ok.withColumns({"delta_f1": d(0), "delta_recall": d(0)})
    return ok.withColumns(
        {"delta_f1": (F.col("f1") - d(base["f1"])) * d(100), "delta_recall": (F.col("recall") - d(base["recall"])) * d(100)}
    )


def class_importance(scored: DataFrame, imp: DataFrame, label: str, p: str, score: str = "importance") -> DataFrame:
    """Importance weighted by the mean score of positives, and by the mean 1 - score of negatives, normalised."""
    r = scored.agg(
        F.avg(F.when(F.col(label) == 1, F.col(p))).alias("pos"), F.avg(F.when(F.col(label) == 0, d(1) - F.col(p))).alias("neg")
    ).first()
    total = imp.agg(F.sum(score)).first()[0]
    if r["pos"] is None or r["neg"] is None:
        raise ValueError("one class is empty")
    norm = lambda m: d(m) * F.col(score) / d(m * total + 1e-8)
    return imp.withColumns({"importance_pos": norm(r["pos"]), "importance_neg": norm(r["neg"])})


def top_true_positive(df: DataFrame, label: str, p: str, key: str, t: float = 0.5) -> DataFrame:
    """Highest-scored true positive, or the highest-scored positive when none is predicted."""
    rows = df.filter(F.col(label) == 1).withColumn("hit", (F.col(p) > d(t)).cast("int"))
    return rows.orderBy(F.col("hit").desc(), F.col(p).desc(), F.col(key)).limit(1)


def importance_table(importances: list[float], names: list[str], spark) -> DataFrame:
    """``(feature, importance)``, highest first."""
    rows = [(n, float(v)) for n, v in zip(names, importances)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")
