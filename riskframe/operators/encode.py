"""Encoding and discretisation.

Dictionaries (label, target) can grow with the data: they stay DataFrames and are joined, and the
adaptive planner broadcasts them only when their measured size allows it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.exprs import d
from riskframe.functions.exprs import value as number
from riskframe.operators import clean, scale
from riskframe.operators.fitted import Fitted
from riskframe.operators.quantiles import quantiles
from riskframe.operators.ranking import running_totals
from riskframe.operators.schema import numeric_cols, string_cols
from riskframe.session import stage

NULL_CATEGORY = "nan"  # fixed value: text of a missing category
MISSING = "missing"  # fixed value: fill for missing strings
FEW_CODES = 100_000  # categories whose codes are broadcast
MAX_ONEHOT = 10_000  # columns of one encoding; beyond, one sparse vector column


def as_category(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(NULL_CATEGORY))


def fit_label(df: DataFrame, cols: list[str]) -> dict[str, DataFrame]:
    """Per column ``(value, code)``: code = 0-based rank among the sorted distinct strings."""
    out = {}
    for c in cols:
        vals = df.groupBy(as_category(c).alias("value")).agg(F.lit(1).alias("one"))
        out[c] = running_totals(vals, "value", ["one"]).select("value", (F.col("cum_one") - 1).cast("bigint").alias("code"))
    return out


def apply_label(df: DataFrame, dicts: dict[str, DataFrame]) -> DataFrame:
    """Replace strings by codes; a category not seen at fit time becomes null."""
    order = df.columns
    for c, t in dicts.items():
        df = df.withColumn(c, as_category(c)).join(t.withColumnRenamed("value", c), c, "left").drop(c).withColumnRenamed("code", c)
    return df.select(order)


def fit_onehot(df: DataFrame, cols: list[str], drop_first: bool = True) -> Fitted:
    """Sorted categories per column (nulls are no category)."""
    cats = {}
    for c in cols:
        rows = df.select(F.col(c).cast("string").alias("v")).filter(F.col("v").isNotNull()).distinct().limit(MAX_ONEHOT + 1).collect()
        if len(rows) > MAX_ONEHOT:
            raise ValueError(f"{c!r} has more than {MAX_ONEHOT} categories: use fit_onehot_sparse for one vector column")
        cats[c] = {"values": sorted(r["v"] for r in rows)}
    return Fitted("onehot", cats, {"drop_first": drop_first})


def onehot_names(params: Fitted) -> list[tuple[str, str, str]]:
    start = 1 if params.meta["drop_first"] else 0
    return [(c, v, f"{c}_{v}") for c, p in params.cols.items() for v in p["values"][start:]]


def apply_onehot(df: DataFrame, params: Fitted) -> DataFrame:
    """0/1 columns ``{col}_{value}``; null and unseen categories are all zero."""
    flags = {name: F.coalesce((F.col(c).cast("string") == F.lit(v)).cast("int"), F.lit(0)) for c, v, name in onehot_names(params)}
    return df.withColumns(flags).drop(*params.cols)


@dataclass
class SparseCodes:
    dicts: dict[str, DataFrame] = field(default_factory=dict)  # (value, code)
    size: dict[str, int] = field(default_factory=dict)
    encoders: PipelineModel | None = None


def fit_onehot_sparse(df: DataFrame, cols: list[str]) -> SparseCodes:
    """Categories of any number: a dictionary table per column (nulls are no category) and its size."""
    out, stages = SparseCodes(), []
    for c in cols:
        vals = df.select(F.col(c).cast("string").alias("value")).filter("value IS NOT NULL").groupBy("value").agg(F.lit(1).alias("one"))
        out.dicts[c] = stage(running_totals(vals, "value", ["one"]).select("value", (F.col("cum_one") - 1).cast("bigint").alias("code")))
        out.size[c] = out.dicts[c].count()
        # an unknown code is a category of its own, the last, and the last has no place in the vector
        encoder = OneHotEncoder(inputCol=f"__code_{c}", outputCol=f"{c}_onehot", handleInvalid="keep", dropLast=True)
        stages.append(encoder.fit(out.dicts[c].select(F.col("code").cast("double").alias(f"__code_{c}"))))
    out.encoders = PipelineModel(stages)
    return out


def apply_onehot_sparse(df: DataFrame, codes: SparseCodes) -> DataFrame:
    """``{c}_onehot``: a sparse vector with a one at the category's rank; null and unseen categories are all zero."""
    for c, t in codes.dicts.items():
        coded = t.select(F.col("value").alias("__v"), F.col("code").alias("__c"))
        df = df.join(coded, F.col(c).cast("string") == F.col("__v"), "left")
        df = df.withColumn(f"__code_{c}", F.coalesce("__c", F.lit(codes.size[c])).cast("double")).drop("__v", "__c", c)
    return codes.encoders.transform(df).drop(*[f"__code_{c}" for c in codes.dicts])


@dataclass
class TargetCodes:
    mapping: dict[str, DataFrame] = field(default_factory=dict)  # (value, enc)
    default: dict[str, float] = field(default_factory=dict)


def fit_target(df: DataFrame, cols: list[str] | str, label: str, smoothing: float = 1.0) -> TargetCodes:
    """Smoothed class rate per category; unseen categories get the plain mean of the codes."""
    cols = [cols] if isinstance(cols, str) else cols
    g = df.agg(F.avg(F.col(label).cast("double"))).first()[0]
    out = TargetCodes()
    for c in cols:
        m = df.groupBy(as_category(c).alias("value")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("s"))
        m = stage(m.select("value", ((F.col("s") + d(smoothing * g)) / (F.col("n") + d(smoothing))).alias("enc")))
        out.mapping[c] = m
        out.default[c] = m.agg(F.avg("enc")).first()[0]
    return out


def apply_target(df: DataFrame, params: TargetCodes, suffix: str = "_target_encoded") -> DataFrame:
    """A code beside each column. Few codes are broadcast: a shuffle by five categories would leave all that follows five tasks."""
    for c, m in params.mapping.items():
        codes = m.select(F.col("value").alias("__v"), F.col("enc").alias("__e"))
        df = (
            df.withColumn("__v", as_category(c))
            .join(F.broadcast(codes) if m.count() <= FEW_CODES else codes, "__v", "left")
            .withColumn(f"{c}{suffix}", F.coalesce("__e", d(params.default[c])))
            .drop("__v", "__e")
        )
    return df


def fit_bins(df: DataFrame, cols: list[str], n: int = 5, strategy: str = "quantile", accuracy: int | None = None) -> Fitted:
    """Bin edges per column: linear-interpolation quantiles (narrow bins removed) or equal width."""
    if strategy == "quantile":
        raw = quantiles(df, cols, [i / n for i in range(n + 1)], accuracy)
        edges = {}
        for c, e in raw.items():
            kept = e[:1]
            for v in e[1:]:
                if v is not None and v - kept[-1] > 1e-8:
                    kept.append(v)
            edges[c] = kept
    elif strategy == "uniform":
        row = df.agg(*[f(number(c)).alias(f"{a}_{c}") for c in cols for a, f in (("lo", F.min), ("hi", F.max))]).first()
        edges = {}
        for c in cols:
            lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
            if lo is None:  # no value at all: one bin
                edges[c] = []
                continue
            step = (hi - lo) / n
            edges[c] = [lo, hi] if step == 0 else [lo + i * step for i in range(n)] + [hi]
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return Fitted("bins", {c: {"edges": e} for c, e in edges.items()}, {"strategy": strategy})


def bin_code(c: str | Column, edges: list[float]) -> Column:
    """Bins are closed on the left; values outside the fitted range fall into the end bins. Null and NaN have none."""
    col = number(c)
    code = F.lit(0)
    for e in edges[1:-1]:
        code = code + (col >= d(e)).cast("int")
    return F.when(col.isNull(), F.lit(None)).otherwise(code)


def apply_bins(df: DataFrame, params: Fitted, encode: str = "ordinal", suffix: str = "") -> DataFrame:
    """Ordinal codes, or ``encode='onehot'`` 0/1 arrays."""
    out = {}
    for c, p in params.cols.items():
        code = bin_code(c, p["edges"])
        if encode == "onehot":
            width = max(1, len(p["edges"]) - 1)
            code = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (i == bin_code(c, p["edges"])).cast("double"))
        out[f"{c}{suffix}"] = code
    return df.withColumns(out)


@dataclass
class Hierarchy:
    core: list[str]
    bins: Fitted
    codes: TargetCodes


def route(names: list[str], core: list[str], secondary: list[str], contextual: list[str]) -> tuple[list, list, list]:
    """Core by exact name; secondary and contextual by regular expression matched at the name's start."""
    hit = lambda pats, n: any(re.match(p, n) for p in pats)
    return [n for n in names if n in core], [n for n in names if hit(secondary, n)], [n for n in names if hit(contextual, n)]


def fit_hierarchy(df: DataFrame, core, secondary, contextual, label: str, n: int = 5) -> Hierarchy:
    names = [c for c in df.columns if c != label]
    c, s, x = route(names, core, secondary, contextual)
    return Hierarchy(c, fit_bins(df, s, n) if s else Fitted("bins"), fit_target(df, x, label) if x else TargetCodes())


def apply_hierarchy(df: DataFrame, params: Hierarchy, keep=()) -> DataFrame:
    """Core columns raw, secondary ``_binned``, contextual ``_target_encoded``; every other column is dropped."""
    out = apply_target(apply_bins(df, params.bins, suffix="_binned"), params.codes)
    return out.select(
        *keep, *params.core, *[f"{c}_binned" for c in params.bins.cols], *[f"{c}_target_encoded" for c in params.codes.mapping]
    )


@dataclass
class Typed:
    impute: Fitted
    standard: Fitted
    onehot: Fitted


def fit_typed(df: DataFrame, key: str, label: str) -> Typed:
    """Numbers: mean fill and standardise. Strings: constant fill and one-hot that ignores unknowns."""
    nums, strs = numeric_cols(df, (key, label)), string_cols(df, (key, label))
    impute = clean.fit_impute(df, nums)
    filled = clean.apply_impute(df, impute)
    missing = clean.fit_impute(df, strs, "constant", MISSING)
    return Typed(impute, scale.fit_scale(filled, nums, "standard"), fit_onehot(clean.apply_impute(df, missing), strs, drop_first=False))


def apply_typed(df: DataFrame, params: Typed, keep=()) -> DataFrame:
    """One ``features`` array: standardised numbers, then one-hot blocks."""
    missing = Fitted("impute", {c: {"fill": MISSING} for c in params.onehot.cols})
    out = clean.apply_impute(clean.apply_impute(df, params.impute), missing)
    out = apply_onehot(scale.apply_scale(out, params.standard), params.onehot)
    cols = [*params.standard.cols, *[n for _, _, n in onehot_names(params.onehot)]]
    return out.select(*keep, F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias("features"))
