"""Batch scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.exprs import d
from riskframe.operators import clean, encode, ensemble, scale, schema


def linear_score(df: DataFrame, weights: dict[str, float], bias: float = 0.0, out: str = "p") -> DataFrame:
    """sigmoid(bias + sum of weight x column)."""
    total = d(bias)
    for c, w in weights.items():
        total = total + d(w) * F.col(c)
    return df.withColumn(out, d(1) / (d(1) + F.exp(-total)))


def prepare(df: DataFrame, bundle: dict, key: str) -> DataFrame:
    """Fit-time schema, fills, scaling and column subset: ``key, features``."""
    out = schema.align(df, bundle["cols"], keep=[key])
    if "impute" in bundle:
        out = clean.apply_impute(out, bundle["impute"])
    if "scale" in bundle:
        out = scale.apply_scale(out, bundle["scale"])
    out = schema.assemble(out, bundle["cols"]).select(key, "features")
    return schema.slice_features(out, bundle["positions"]) if bundle.get("positions") else out


def submission_of(scored: DataFrame, key: str, t: float) -> DataFrame:
    return scored.select(F.col(key).alias("uuid"), "proba", (F.col("proba") >= d(t)).cast("int").alias("prediction"))


DEFAULT_THRESHOLD = 0.7  # fixed value: used when the bundle carries none


def score_batch(df: DataFrame, bundle: dict, key: str = "company_id", threshold: float | None = None) -> DataFrame:
    """``uuid, proba, prediction``. A bundle with a fitted ``pipeline`` (whose last stage adds ``proba``) takes the raw
    table; else the input is prepared here, in one pass and without a shuffle."""
    t = threshold if threshold is not None else bundle.get("threshold", DEFAULT_THRESHOLD)
    if "pipeline" in bundle:
        return submission_of(bundle["pipeline"].transform(df), key, t)
    return submission_of(bundle["model"].score(prepare(df, bundle, key), "proba"), key, t)


def score_cascade(df: DataFrame, bundle: dict, key: str = "company_id") -> DataFrame:
    """Base score, corrected inside the uncertain band by the bundle's meta model, cut at its threshold."""
    s = bundle["meta"].score(bundle["model"].score(prepare(df, bundle, key), "p"), "meta_p")
    return submission_of(ensemble.cascade_proba(s, "p", "meta_p"), key, bundle.get("threshold", DEFAULT_THRESHOLD))


def score_aligned(df: DataFrame, bundle: dict, key: str = "company_id") -> DataFrame:
    """One-hot encode, align to the fit-time columns (missing ones are 0), then score the stacked model."""
    if "onehot" in bundle:
        df = encode.apply_onehot(df, bundle["onehot"])
    return score_batch(df, bundle, key)
