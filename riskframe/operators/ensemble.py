"""Combining score columns. Pure projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.exprs import d
from riskframe.operators.metrics import roc_auc, stack_scores

LOW, HIGH = 0.3, 0.7  # fixed values: uncertain band, open on both sides


def _mean(cols: list[str]):
    total = F.col(cols[0]).cast("double")
    for c in cols[1:]:
        total = total + F.col(c)
    return total / d(len(cols))


def soft_vote(df: DataFrame, ps: list[str], out: str = "p_vote") -> DataFrame:
    return df.withColumn(out, _mean(ps))


def hard_vote(df: DataFrame, preds: list[str], out: str = "vote") -> DataFrame:
    """Mean of 0/1 labels rounded half to even, so two members must agree."""
    return df.withColumn(out, F.bround(_mean(preds), 0).cast("int"))


def weighted_vote(df: DataFrame, ps: list[str], ws: list[float], t: float = 0.5, out: str = "p_weighted", label: str = "vote") -> DataFrame:
    """Weighted mean score and its label; weights are renormalised when they do not sum to one."""
    s = sum(ws)
    ws = [w / s for w in ws] if abs(s - 1) > 1e-5 + 1e-8 else ws
    total = d(ws[0]) * F.col(ps[0])
    for p, w in zip(ps[1:], ws[1:]):
        total = total + d(w) * F.col(p)
    return df.withColumn(out, total).withColumn(label, (F.col(out) >= d(t)).cast("int"))


def auc_weights(valid: DataFrame, label: str, ps: list[str]) -> dict[str, float]:
    """AUC of each member on validation rows, normalised; one row per member reaches the driver."""
    auc = {r["model"]: r["auc"] for r in roc_auc(stack_scores(valid, label, ps), label, "p", ["model"]).collect()}
    return {p: auc[p] / sum(auc.values()) for p in ps}


def auc_weighted(df: DataFrame, ps: list[str], valid: DataFrame, label: str, out: str = "p_auc") -> DataFrame:
    w = auc_weights(valid, label, ps)
    total = d(0)
    for p in ps:
        total = total + d(w[p]) * F.col(p)
    return df.withColumn(out, F.least(F.greatest(total, d(0)), d(1)))


def _in_band(p: str):
    return (F.col(p) > d(LOW)) & (F.col(p) < d(HIGH))


def cascade_label(df: DataFrame, p: str, meta_p: str, t: float = 0.5, out: str = "prediction") -> DataFrame:
    """Base label; inside the uncertain band the meta model's label. Scores stay as they are."""
    return df.withColumn(out, F.when(_in_band(p), (F.col(meta_p) >= d(0.5)).cast("int")).otherwise((F.col(p) >= d(t)).cast("int")))


def cascade_proba(df: DataFrame, p: str, meta_p: str | None = None, meta_label: str | None = None, out: str = "proba") -> DataFrame:
    """Band scores replaced by the meta score, or by .9 / .1 when the meta model only gives labels."""
    meta = F.col(meta_p) if meta_p else F.when(F.col(meta_label) == 1, d(0.9)).otherwise(d(0.1))
    return df.withColumn(out, F.when(_in_band(p), meta).otherwise(F.col(p)))
