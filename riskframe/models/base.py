"""Classifiers over ``features array<double>`` and a 0/1 label: Spark ML estimators plus a few DataFrame models.

``fit_model(...)`` returns a ``Model``; ``Model.score(df)`` adds the positive-class score ``p``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from riskframe.functions.exprs import array_sum, d, hash_unit, lit_array
from riskframe.models.network import fit_network, score_network
from riskframe.models.pool import run_all
from riskframe.operators.joins import hot_join
from riskframe.operators.neighbors import knn
from riskframe.operators.profile import vector_summary
from riskframe.session import stage

KINDS = ("gbt", "adaboost", "rf", "brf", "tree", "knn", "logreg", "gnb", "linsvc", "mlp")


@dataclass
class Model:
    kind: str
    stages: PipelineModel | None = None  # Spark ML part
    state: dict = field(default_factory=dict)  # numbers, JSON-able
    table: DataFrame | None = None  # training rows of the neighbour classifier
    col: str = "features"

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        return _SCORERS.get(self.kind, _score_ml)(self, df, out)

    @property
    def ml(self):
        return self.stages.stages[-1]

    def importances(self) -> list[float]:
        """Feature weights: tree importances, or absolute coefficients."""
        if self.kind in ("logreg", "linsvc"):
            return [abs(float(x)) for x in self.ml.coefficients.toArray()]
        if self.kind == "mlp":
            layers = self.state["layers"]
            w = np.asarray(self.ml.weights.toArray())[: layers[0] * layers[1]].reshape(layers[0], layers[1])
            return np.abs(w).mean(axis=1).tolist()
        if "importances" in self.state:
            return list(self.state["importances"])
        return [float(x) for x in self.ml.featureImportances.toArray()]

    def margin_terms(self, x: Column) -> tuple[float, Column] | None:
        """(constant, one term per feature) of the log odds, where they are a sum over features; else None."""
        if self.kind in ("logreg", "linsvc"):
            return float(self.ml.intercept), F.zip_with(x, lit_array(self.ml.coefficients.toArray()), lambda v, w: v * w)
        if self.kind != "gnb":
            return None
        (m0, m1), (v0, v1), prior = self.state["mean"], self.state["var"], self.state["prior"]
        const = math.log(prior[1] / prior[0]) + 0.5 * float((np.log(v0) - np.log(v1)).sum())
        part = lambda m, v: F.zip_with(F.zip_with(x, lit_array(m), lambda a, b: (a - b) * (a - b)), lit_array(v), lambda a, b: a / b)
        return const, F.zip_with(part(m0, v0), part(m1, v1), lambda a, b: d(0.5) * (a - b))

    def bundle(self) -> dict:
        if self.table is not None:
            return {"kind": self.kind, "state": self.state, "rows": self.table}
        return {"kind": self.kind, "state": self.state, **({"stages": self.stages} if self.stages else {})}

    @staticmethod
    def from_bundle(b: dict) -> "Model":
        return Model(b["kind"], b.get("stages"), b["state"], b.get("rows"))


def _vectors(df: DataFrame, label: str, weight: str | None, col: str, extra=()) -> DataFrame:
    cols = [array_to_vector(F.col(col)).alias("__v"), F.col(label).cast("double").alias("__y")]
    if weight:
        cols.append(F.col(weight).cast("double").alias("__w"))
    return df.select(*cols, *extra)


def _estimator(kind: str, params: dict, width: int, weight: bool, valid: str | None):
    p = dict(params)
    common = {"featuresCol": "__v", "labelCol": "__y"}
    if weight:
        common["weightCol"] = "__w"
    seed = p.get("seed", 42)
    subset = str(p["colsample"]) if "colsample" in p else None
    if kind == "gbt":
        stop = {"validationIndicatorCol": valid, "validationTol": p.get("tol", 0.01)} if valid else {}
        return GBTClassifier(
            **common, **stop, maxIter=p.get("rounds", 20), maxDepth=p.get("depth", 5), stepSize=p.get("lr", 0.1),
            subsamplingRate=p.get("subsample", 1.0), featureSubsetStrategy=subset or "all", seed=seed,
        )
    if kind == "rf":
        return RandomForestClassifier(
            **common, numTrees=p.get("trees", 100), maxDepth=p.get("depth", 8), subsamplingRate=p.get("subsample", 1.0),
            featureSubsetStrategy=subset or "sqrt", seed=seed,
        )
    if kind == "tree":
        return DecisionTreeClassifier(**common, maxDepth=p.get("depth", 5), seed=seed)
    if kind == "logreg":
        return LogisticRegression(**common, regParam=p.get("reg", 0.01), elasticNetParam=0.0, maxIter=p.get("iterations", 50))
    if kind == "linsvc":
        return LinearSVC(**common, regParam=p.get("reg", 0.01), maxIter=p.get("iterations", 50))
    if kind == "mlp":
        common.pop("weightCol", None)
        return MultilayerPerceptronClassifier(**common, layers=[width, *p.get("hidden", [16, 8]), 2], maxIter=p.get("iterations", 50), seed=seed)
    raise ValueError(f"unknown model kind {kind!r}; one of {KINDS}")


def fit_model(
    df: DataFrame, label: str = "target", kind: str = "gbt", params: dict | None = None, weight: str | None = None, valid: str | None = None,
    col: str = "features", key: str = "id",
) -> Model:
    """Train one model. ``weight`` names a row-weight column; ``valid`` a boolean column marking the rows
    that only decide when boosting stops: by a tolerance, or after ``patience`` rounds without a gain. The network takes row
    weights, and ``pos_weight`` as a setting, by gradients of its own."""
    params = params or {}
    if weight and kind in ("gnb", "knn", "brf"):
        raise ValueError(f"{kind!r} does not take row weights; resample instead")
    if valid and kind != "gbt":
        raise ValueError(f"{kind!r} does not stop early; only 'gbt' takes validation rows")
    if kind == "adaboost":
        return _fit_adaboost(df, label, params, weight, col)
    if kind == "gnb":
        return _fit_gnb(df, label, params, col)
    if kind == "knn":
        return Model(kind, state={"k": params.get("k", 5), "key": key, "label": label}, table=df.select(key, col, label), col=col)
    if kind == "mlp" and (weight or "pos_weight" in params):  # Spark's own network takes no weights
        return Model("net", state=fit_network(df, label, params, weight, col), col=col)
    if kind == "brf":
        return _fit_balanced(df, label, params, col, key)
    if kind == "gbt" and valid and "patience" in params:
        params, df, valid = _stopped(df, label, params, weight, valid, col), df.filter(~F.col(valid)), None
    width = len(df.select(col).first()[0]) if kind == "mlp" else 0
    train = _vectors(df, label, weight, col, [valid] if valid else ())
    fitted = _without_summary(_estimator(kind, params, width, bool(weight), valid).fit(train), df)
    state = {"layers": [width, *params.get("hidden", [16, 8]), 2]} if kind == "mlp" else {}
    return Model(kind, PipelineModel([fitted]), state, col=col)


def _without_summary(fitted, df: DataFrame):
    """The fitted model alone. Its training summary holds the session, which would go out with every task that scores, and
    cannot once an ``Observation`` ran in it. Spark drops the summary on saving; in place it takes this call."""
    if getattr(fitted, "hasSummary", False):
        fitted._java_obj.setSummary(df.sparkSession._jvm.scala.Option.empty())
    return fitted


def _stopped(df: DataFrame, label: str, params: dict, weight: str | None, valid: str, col: str) -> dict:
    """The settings with ``rounds`` cut at the best validation loss before ``patience`` rounds passed without a gain.

    All rounds are fitted once on the other rows; a shorter run with the same seed grows the same first trees.
    """
    full = _estimator("gbt", params, 0, bool(weight), None).fit(_vectors(df.filter(~F.col(valid)), label, weight, col))
    losses = full.evaluateEachIteration(_vectors(df.filter(F.col(valid)), label, None, col))
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= params["patience"]:
            break
    return {**params, "rounds": best + 1}


def _ml_score(stage, df: DataFrame, col: str, out: str) -> DataFrame:
    keep = df.columns
    scored = stage.transform(df.withColumn("__v", array_to_vector(F.col(col))))
    if "probability" in scored.columns:
        p = vector_to_array("probability")[1]
    else:  # margin of the linear machine, squeezed to (0, 1)
        p = d(1) / (d(1) + F.exp(-vector_to_array("rawPrediction")[1]))
    return scored.select(*[c for c in keep if c != out], p.alias(out))


def _score_ml(model: Model, df: DataFrame, out: str) -> DataFrame:
    return _ml_score(model.ml, df, model.col, out)


# ---- AdaBoost on stumps

RESTAGE = 20  # rounds between writes of the row weights


def _tail(state: dict, since: int) -> dict:
    return {k: state[k][since:] for k in ("f", "t", "lo", "hi", "alpha")}


def stump_votes(state: dict, col: str = "features") -> Column:
    """The +1/-1 vote of every stump, as one array."""
    a = {k: lit_array(state[k]) for k in ("f", "t", "lo", "hi")}
    vote = lambda i: F.when(F.get(F.col(col), F.get(a["f"], i).cast("int")) <= F.get(a["t"], i), F.get(a["lo"], i)).otherwise(F.get(a["hi"], i))
    return F.transform(F.sequence(F.lit(0), F.lit(len(state["f"]) - 1)), vote)


def boosted_weight(w: Column, y: Column, state: dict, col: str = "features") -> Column:
    """Row weight after the given rounds: times exp(alpha) for every stump that missed the row."""
    if not state["f"]:
        return w
    sign = y * d(2) - d(1)
    missed = F.zip_with(stump_votes(state, col), lit_array(state["alpha"]), lambda v, a: F.when(v * sign < 0, a).otherwise(d(0)))
    return w * F.exp(array_sum(missed))


def round_error(rows: DataFrame, w: Column, miss: Column) -> float:
    r = rows.agg(F.sum(w * miss.cast("double")) / F.sum(w)).first()
    return float(r[0])


def _fit_adaboost(df, label, params, weight, col):
    """Reweighted depth-1 trees (SAMME). Each round fits one stump and reads one weighted error.

    Weights are recomputed from the stumps since the last staging, so neither lineage nor the work per row
    grows with the number of rounds.
    """
    rounds, lr = params.get("rounds", 50), params.get("lr", 1.0)
    w0 = F.col(weight).cast("double") if weight else d(1)
    rows = df.select(F.col(col).alias("features"), F.col(label).cast("double").alias("y"), w0.alias("w0")).persist(StorageLevel.MEMORY_AND_DISK)
    state: dict = {k: [] for k in ("f", "t", "lo", "hi", "alpha")}
    since = 0
    try:
        for i in range(rounds):
            if i % RESTAGE == 0:
                mean = rows.agg(F.avg(boosted_weight(F.col("w0"), F.col("y"), _tail(state, since)))).first()[0]
                if i:
                    fresh = stage(rows.withColumn("w0", boosted_weight(F.col("w0"), F.col("y"), _tail(state, since)) / d(mean)))
                    rows.unpersist()
                    rows, since, mean = fresh, len(state["f"]), 1.0
            now = rows.withColumn("w", boosted_weight(F.col("w0") / d(mean), F.col("y"), _tail(state, since)))
            stump = DecisionTreeClassifier(featuresCol="__v", labelCol="y", weightCol="w", maxDepth=1, seed=params.get("seed", 42)).fit(
                now.withColumn("__v", array_to_vector("features"))
            )
            root = stump._java_obj.rootNode()
            if stump.depth == 0:  # no split beats the majority class: a constant vote, which shifts the weights
                f, t = 0, 1e308
                lo = hi = 2 * root.prediction() - 1
            else:
                f, t = root.split().featureIndex(), root.split().threshold()
                lo, hi = (2 * root.leftChild().prediction() - 1, 2 * root.rightChild().prediction() - 1)
            vote = F.when(F.get("features", F.lit(f)) <= d(t), d(lo)).otherwise(d(hi))
            err = round_error(now, F.col("w"), vote * (F.col("y") * d(2) - d(1)) < 0)
            if err >= 0.5:
                break
            alpha = lr * math.log((1 - max(err, 1e-10)) / max(err, 1e-10))
            for k, v in (("f", float(f)), ("t", t), ("lo", lo), ("hi", hi), ("alpha", alpha)):
                state[k].append(float(v))
            if err <= 0:
                break
    finally:
        rows.unpersist()
    if not state["f"]:
        raise ValueError("no stump is better than chance")
    width = len(df.select(col).first()[0])
    imp = np.bincount(np.array(state["f"], dtype=int), weights=np.maximum(state["alpha"], 0), minlength=width)
    state["importances"] = (imp / imp.sum()).tolist() if imp.sum() > 0 else imp.tolist()
    return Model("adaboost", state=state, col=col)


def _score_adaboost(model: Model, df: DataFrame, out: str) -> DataFrame:
    alpha = model.state["alpha"]
    decision = array_sum(F.zip_with(stump_votes(model.state, model.col), lit_array(alpha), lambda v, a: v * a)) / d(sum(alpha))
    return df.withColumn(out, d(1) / (d(1) + F.exp(-decision)))


# ---- Gaussian naive Bayes


def _fit_gnb(df, label, params, col):
    """Class moments from one aggregate; variances get 1e-9 of the largest overall variance added."""
    per = {int(r[label]): r for r in vector_summary(df, [label], col).collect()}
    if sorted(per) != [0, 1]:
        raise ValueError("labels 0 and 1 are both needed")
    n = {c: per[c]["n"] for c in (0, 1)}
    total = n[0] + n[1]
    m = {c: np.array(per[c]["mean"]) for c in (0, 1)}
    v = {c: np.array(per[c]["var"]) for c in (0, 1)}
    mean = (n[0] * m[0] + n[1] * m[1]) / total
    whole = sum(n[c] * (v[c] + (m[c] - mean) ** 2) for c in (0, 1)) / total
    eps = params.get("smoothing", 1e-9) * (float(whole.max()) or 1.0)  # constant features only: keep the variance positive
    return Model("gnb", state={"prior": [n[0] / total, n[1] / total], "mean": [m[c].tolist() for c in (0, 1)], "var": [(v[c] + eps).tolist() for c in (0, 1)]}, col=col)


def _score_gnb(model: Model, df: DataFrame, out: str) -> DataFrame:
    s = model.state
    x = F.col(model.col)

    def log_density(c):
        gap = F.zip_with(x, lit_array(s["mean"][c]), lambda a, b: (a - b) * (a - b))
        const = math.log(s["prior"][c]) - 0.5 * float(np.log(2 * np.pi * np.array(s["var"][c])).sum())
        return d(const) - d(0.5) * array_sum(F.zip_with(gap, lit_array(s["var"][c]), lambda a, b: a / b))

    return df.withColumn(out, d(1) / (d(1) + F.exp(log_density(0) - log_density(1))))


# ---- neighbours


def _score_knn(model: Model, df: DataFrame, out: str) -> DataFrame:
    key, label = model.state["key"], model.state["label"]
    nn = stage(knn(df, model.table, model.state["k"], key, model.col, exclude_self=model.state.get("exclude_self", False)))  # read twice below
    labels = model.table.select(F.col(key).alias("nbr"), F.col(label).cast("double").alias("__y"))
    p = hot_join(nn, labels, "nbr").groupBy(F.col("key").alias(key)).agg(F.avg("__y").alias(out))
    return df.drop(out).join(p, key, "left")


# ---- balanced forest


def poisson_count(rate: float, u: Column) -> Column:
    """How often a row is drawn: the Poisson count of ``rate`` at the uniform number ``u``."""
    step = below = math.exp(-rate)
    out, k = F.lit(0), 0
    while below < 1 - 2**-32:  # as fine as the hash
        out = out + (u >= d(below)).cast("int")
        k += 1
        step *= rate / k
        below += step
    return out


def balanced_draws(df: DataFrame, label: str, tree: int, seed: int, key: str, out: str = "__w") -> DataFrame:
    """Bootstrap of one tree: every class is drawn with replacement to the size of the smallest one, as counts by key hash.

    Counts are a projection, so no row is moved; a class's size is kept up to its Poisson spread.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).agg(F.count("*")).collect()}
    return _drawn(df, label, counts, tree, seed, key, out)


def _drawn(df, label, counts, tree, seed, key, out):
    if len(counts) != 2:
        raise ValueError("a balanced forest needs exactly two classes")
    low, u = min(counts.values()), hash_unit(seed, "balanced", tree, F.col(key))
    n = F.lit(0)
    for c, size in counts.items():
        n = F.when(F.col(label) == F.lit(c), poisson_count(low / size, u)).otherwise(n)
    return df.withColumn(out, n)


def _fit_balanced(df, label, params, col, key):
    """One tree per balanced bootstrap, the counts as row weights; trees are fitted side by side."""
    counts = {r[0]: r[1] for r in df.groupBy(label).agg(F.count("*")).collect()}
    trees, seed = params.get("trees", 50), params.get("seed", 42)
    one = {"depth": 8, **params, "trees": 1}

    def tree(i):
        rows = _drawn(df, label, counts, i, seed, key, "__n").filter("__n > 0")
        return lambda: _estimator("rf", {**one, "seed": seed + i}, 0, True, None).setBootstrap(False).fit(_vectors(rows, label, "__n", col))

    parts = run_all(df.sparkSession, [tree(i) for i in range(trees)])
    imp = sum(m.featureImportances.toArray() for m in parts)
    return Model("brf", PipelineModel(parts), {"importances": (imp / (imp.sum() or 1.0)).tolist()}, col=col)


def _score_balanced(model: Model, df: DataFrame, out: str) -> DataFrame:
    scored = df.withColumn("__v", array_to_vector(F.col(model.col)))
    names = [f"__p{i}" for i in range(len(model.stages.stages))]
    for name, m in zip(names, model.stages.stages):  # one column a tree, and no other
        scored = m.copy({m.probabilityCol: name, m.rawPredictionCol: "", m.predictionCol: ""}).transform(scored)
    return scored.withColumn(out, array_sum(F.array(*[vector_to_array(n)[1] for n in names])) / d(len(names))).drop("__v", *names)


def _score_net(model: Model, df: DataFrame, out: str) -> DataFrame:
    return score_network(model.state, df, model.col, out)


_SCORERS = {"adaboost": _score_adaboost, "gnb": _score_gnb, "knn": _score_knn, "brf": _score_balanced, "net": _score_net}


def regression_importance(df: DataFrame, label: str, trees: int = 100, depth: int = 8, seed: int = 42, col: str = "features") -> list[float]:
    """Importances of a regression forest on the label."""
    m = RandomForestRegressor(featuresCol="__v", labelCol="__y", numTrees=trees, maxDepth=depth, seed=seed).fit(_vectors(df, label, None, col))
    return [float(x) for x in m.featureImportances.toArray()]
