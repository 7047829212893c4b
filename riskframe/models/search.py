"""Evaluation, parameter search and model-based feature selection."""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.exprs import array_sum, d, hash_hex
from riskframe.models.base import Model, fit_model, regression_importance
from riskframe.models.pool import run_all
from riskframe.operators import metrics
from riskframe.operators.profile import vector_summary
from riskframe.operators.ranking import ranked
from riskframe.operators.sample import class_weights, fold_ids
from riskframe.operators.schema import slice_features
from riskframe.operators.select import anova_f, selected_positions, top_k
from riskframe.session import stage

SWAPPED = 16  # features scored side by side in one projection


class CompositeEvaluator(Evaluator):
    """Weighted precision, AUC and recall as a tuning criterion for Spark ML's cross-validation."""

    def __init__(self, label: str = "label", score: str = "p", t: float = 0.5, w_p: float = 20, w_auc: float = 50, w_r: float = 30):
        super().__init__()
        self.args = (label, score, t, w_p, w_auc, w_r)

    def _evaluate(self, dataset: DataFrame) -> float:
        label, score, t, w_p, w_auc, w_r = self.args
        if score not in dataset.columns:
            dataset = dataset.withColumn(score, vector_to_array(score_vector(dataset))[1])
        m = metrics.evaluate(stage(dataset.select(label, score)), label, score, t).drop("score")
        return float(metrics.composite(m, w_p, w_auc, w_r).first()["score"])

    def isLargerBetter(self) -> bool:
        return True


def score_vector(df: DataFrame) -> str:
    return "probability" if "probability" in df.columns else "rawPrediction"


def holdout(train: DataFrame, test: DataFrame, label: str, kind: str, params: dict | None = None, t: float = 0.5, **fit) -> DataFrame:
    """Fit on train, all metrics on test."""
    scored = fit_model(train, label, kind, params, **fit).score(test)
    return metrics.evaluate(stage(scored.select(label, "p")), label, "p", t)  # scored once, read several times


def one_metric(scored: DataFrame, label: str, p: str, metric: str) -> float:
    if metric == "auc":
        return float(metrics.roc_auc(scored, label, p).first()["auc"])
    r = metrics.rates(metrics.confusion(scored, label, p)).first()
    if metric == "f1":
        return float(r["f1"])
    if metric == "f1_macro":
        neg = 2 * r["tn"] / (2 * r["tn"] + r["fp"] + r["fn"]) if r["tn"] else 0.0
        return (float(r["f1"]) + neg) / 2
    raise ValueError(f"unknown metric {metric!r}")


def cv_scores(df: DataFrame, label: str, kind: str, params: dict | None = None, folds: int = 3, metric: str = "auc", seed: int = 42, key: str = "id") -> list[float]:
    """One score per stratified fold; folds are fitted side by side."""
    f = df if "fold" in df.columns else stage(fold_ids(df, label, folds, seed, key))
    return run_all(df.sparkSession, [fold_task(f, i, label, kind, params, metric, key) for i in range(folds)])


def fold_task(f: DataFrame, i: int, label: str, kind: str, params: dict | None, metric: str, key: str):
    def run():
        m = fit_model(f.filter(F.col("fold") != i), label, kind, params, key=key)
        return one_metric(m.score(f.filter(F.col("fold") == i)), label, "p", metric)

    return run


def subset_scores(f: DataFrame, subsets: list[list[int]], label: str, kind: str, params, folds: int, key: str) -> list[float]:
    """Mean cross-validated AUC of several feature subsets; all fits of all folds share one pool."""
    tasks = [fold_task(slice_features(f, cols), i, label, kind, params, "auc", key) for cols in subsets for i in range(folds)]
    s = run_all(f.sparkSession, tasks)
    return [sum(s[j * folds : (j + 1) * folds]) / folds for j in range(len(subsets))]


def cv_score(df, label, kind, params=None, folds=3, metric="auc", seed=42, key="id") -> DataFrame:
    """``(mean, spread)``: average and two standard deviations over the folds."""
    s = cv_scores(df, label, kind, params, folds, metric, seed, key)
    mean = sum(s) / len(s)
    spread = 2 * (sum((x - mean) ** 2 for x in s) / len(s)) ** 0.5
    return df.sparkSession.createDataFrame([(metric, len(s), mean, spread)], "metric string, folds int, mean double, spread double")


def draws(grid: dict[str, list], n: int, seed: int = 42) -> list[dict]:
    """``n`` distinct points of a parameter grid, in hash order."""
    points = [dict(zip(grid, v)) for v in itertools.product(*grid.values())]
    points.sort(key=lambda p: hashlib.md5(f"{seed}|{sorted(p.items())}".encode()).hexdigest())
    return points[:n]


def random_search(
    df: DataFrame, label: str, kind: str, grid: dict[str, list], n: int = 20, metric: str = "auc", default: dict | None = None, seed: int = 42, key: str = "id"
) -> tuple[dict, DataFrame]:
    """Best of ``n`` drawn settings on a held-out fifth: (settings, table of all trials)."""
    f = stage(fold_ids(df, label, 5, seed, key))
    train, test = f.filter("fold != 0"), f.filter("fold = 0")
    points = draws(grid, n, seed) or [default or {}]

    def trial(p):
        return lambda: one_metric(fit_model(train, label, kind, p, key=key).score(test), label, "p", metric)

    scores = run_all(df.sparkSession, [trial(p) for p in points])
    rows = [(i, str(sorted(p.items())), s) for i, (p, s) in enumerate(zip(points, scores))]
    best = max(range(len(points)), key=lambda i: (scores[i], -i))
    return points[best], df.sparkSession.createDataFrame(rows, "trial int, params string, score double")


# ---- importances


def tree_importance(df: DataFrame, label: str, kind: str = "rf", params: dict | None = None, balanced: bool = True, key: str = "id") -> list[float]:
    """``rf`` (balanced row weights), ``brf``, ``gbt``, or ``rf_reg``."""
    params = params or {}
    if kind == "rf_reg":
        return regression_importance(df, label, params.get("trees", 100), params.get("depth", 8))
    weight = None
    if kind == "rf" and balanced:
        df, weight = class_weights(df, label, "balanced", "__weight"), "__weight"
    return fit_model(df, label, kind, params, weight=weight, key=key).importances()


def mlp_importance(df: DataFrame, label: str, hidden: list[int], iterations: int = 50, seed: int = 42) -> list[float]:
    """Mean absolute first-layer weight of each input."""
    return fit_model(df, label, "mlp", {"hidden": hidden, "iterations": iterations, "seed": seed}).importances()


def importance_frame(spark, imp: list[float]) -> DataFrame:
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(imp)], "pos int, score double")


def permutation_importance(df: DataFrame, model: Model, label: str, repeats: int = 10, seed: int = 42, t: float = 0.5, key: str = "id") -> DataFrame:
    """``(pos, mean, std)``: loss of accuracy when one feature is taken from another, hash-chosen row.

    One permutation of rows per repeat is a single equi-join of two hash rankings, after which a row holds its own and
    its partner's features. Models whose margin is a sum over features swap one term at a time inside the row; the others
    score ``SWAPPED`` features side by side in one projection. A row is never copied per feature.
    """
    base = stage(df.select(key, "features", label))
    hit = lambda p: ((p >= d(t)).cast("int") == F.col(label)).cast("double")
    whole = model.score(base).agg(F.avg(hit(F.col("p"))).alias("a"), F.max(F.size("features")).alias("width")).first()
    rows = None
    for r in range(repeats):
        a = ranked(base, hash_hex(seed, "left", r, F.col(key)), (), "__rank")
        b = ranked(base.select(F.col("features").alias("__other"), F.col(key).alias("__k")), hash_hex(seed, "right", r, F.col("__k")), (), "__rank").drop("__k")
        pairs = a.join(b, "__rank").select(key, label, "features", "__other")
        if whole["width"] is not None:
            part = _swapped_terms(pairs, model, hit) if model.margin_terms(F.col("features")) else _swapped_scores(stage(pairs), model, hit, whole["width"])
            part = part.select("pos", (d(whole["a"]) - F.col("kept")).alias("drop"))
            rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return df.sparkSession.createDataFrame([], "pos int, mean double, std double")
    return rows.groupBy("pos").agg(F.avg("drop").alias("mean"), F.stddev_pop("drop").alias("std"))


def _swapped_terms(pairs: DataFrame, model: Model, hit) -> DataFrame:
    """``(pos, kept)``: accuracy with each feature swapped, from the terms of the margin; one summary, no explode."""
    const, own = model.margin_terms(F.col("features"))
    _, other = model.margin_terms(F.col("__other"))
    terms = pairs.withColumns({"__own": own, "__new": other}).withColumn("__m", array_sum(F.col("__own")) + d(const))
    hits = F.zip_with("__own", "__new", lambda x, y: hit(d(1) / (d(1) + F.exp(x - y - F.col("__m")))))
    per = vector_summary(terms.select(hits.alias("features")))
    return per.select(F.posexplode("mean").alias("pos", "kept"))


def _swapped_scores(pairs: DataFrame, model: Model, hit, width: int) -> DataFrame:
    """The same for any model, ``SWAPPED`` features a pass."""
    out = None
    for lo in range(0, width, SWAPPED):
        at = range(lo, min(width, lo + SWAPPED))
        scored = pairs
        for j in at:
            mixed = F.concat(F.slice("features", 1, j), F.array(F.get("__other", F.lit(j))), F.slice("features", j + 2, width))
            scored = replace(model, col=f"__f{j}").score(scored.withColumn(f"__f{j}", mixed), f"__p{j}").drop(f"__f{j}")
        one = scored.agg(*[F.avg(hit(F.col(f"__p{j}"))).alias(str(j)) for j in at])
        part = one.unpivot([], [str(j) for j in at], "pos", "kept").select(F.col("pos").cast("int").alias("pos"), "kept")
        out = part if out is None else out.unionByName(part)
    return out


# ---- wrappers


def rfe(df: DataFrame, label: str, kind: str = "logreg", params: dict | None = None, n: int | None = None, step: float = 1, key: str = "id") -> dict:
    """Drop the weakest features round by round until ``n`` (default half) are left.

    ``step`` below one is a share of all features. Returns kept positions and the rank of every feature (1 = kept).
    """
    rows = stage(df.select(key, "features", label))
    width = len(rows.select("features").first()[0])
    n = n or max(1, width // 2)
    drop = max(1, int(step * width)) if step < 1 else int(step)
    keep = list(range(width))
    rounds: list[list[int]] = []
    while len(keep) > n:
        imp = fit_model(slice_features(rows, keep), label, kind, params, key=key).importances()
        worst = sorted(range(len(keep)), key=lambda i: (imp[i], -keep[i]))[: min(drop, len(keep) - n)]
        rounds.append([keep[i] for i in worst])
        keep = [c for i, c in enumerate(keep) if i not in set(worst)]
    rank = {c: 1 for c in keep}
    for place, cols in enumerate(reversed(rounds)):
        rank.update({c: place + 2 for c in cols})
    return {"selected": keep, "rank": [rank[c] for c in range(width)]}


def rfecv(df, label, kind="logreg", params=None, folds=3, step=5, min_features=5, seed=42, key="id") -> dict:
    """Elimination order from the full data; the number kept is the one with the best cross-validated AUC."""
    order = rfe(df, label, kind, params, min_features, step, key)["rank"]
    f = stage(fold_ids(df.select(key, "features", label), label, folds, seed, key))
    subsets = [[c for c, r in enumerate(order) if r <= cut] for cut in sorted(set(order))]
    scores = subset_scores(f, subsets, label, kind, params, folds, key)
    best = max(range(len(subsets)), key=lambda j: (scores[j], -len(subsets[j])))
    return {"selected": subsets[best], "history": {len(c): s for c, s in zip(subsets, scores)}}


def forward_addition(df, label, kind="gnb", params=None, folds=3, min_features=5, cap=None, seed=42, key="id") -> dict:
    """Add the feature with the best cross-validated AUC (all candidates of a round in one job where the model is additive:
    ``gnb``); stop without a gain once ``min_features`` are in,
    or at ``cap`` features if one is given.

    Returns the order, the score history and a rank per feature (unchosen ones follow in position order).
    """
    f = stage(fold_ids(df.select(key, "features", label), label, folds, seed, key))
    width = len(f.select("features").first()[0])
    if kind == "gnb":
        moments = fold_moments(f, label, folds)
        trial = lambda subsets: additive_scores(f, subsets, label, moments, folds, (params or {}).get("smoothing", 1e-9))
    else:
        trial = lambda subsets: subset_scores(f, subsets, label, kind, params, folds, key)
    chosen, left, history = [], list(range(width)), []
    while left and (cap is None or len(chosen) < cap):
        scores = [round(s, 12) for s in trial([[*chosen, c] for c in left])]  # sums differ in the last digits: a tie stays one
        top, best = max(zip(scores, left))
        if history and top <= max(history) and len(chosen) >= min_features:
            break
        chosen.append(best)
        left.remove(best)
        history.append(top)
    rank = {c: i + 1 for i, c in enumerate([*chosen, *sorted(left)])}
    return {"order": chosen, "history": history, "rank": [rank[c] for c in range(width)]}


def fold_moments(f: DataFrame, label: str, folds: int) -> list[dict[int, tuple]]:
    """Per left-out fold and class: (rows, means, variances) of the other folds, merged from one summary by fold and class."""
    got = {(r["fold"], int(r[label])): (r["n"], np.array(r["mean"]), np.array(r["var"])) for r in vector_summary(f, ["fold", label]).collect()}

    def merged(parts):
        n = sum(p[0] for p in parts)
        mean = sum(p[0] * p[1] for p in parts) / n
        return n, mean, sum(p[0] * (p[2] + (p[1] - mean) ** 2) for p in parts) / n

    out = [{c: [v for (i, k), v in got.items() if i != left and k == c] for c in (0, 1)} for left in range(folds)]
    if not all(o[0] and o[1] for o in out):
        raise ValueError("labels 0 and 1 are both needed in every training part")
    return [{c: merged(o[c]) for c in (0, 1)} | {2: merged(o[0] + o[1])} for o in out]


def additive_scores(f: DataFrame, subsets: list[list[int]], label: str, moments: list[dict[int, tuple]], folds: int, smoothing: float = 1e-9) -> list[float]:
    """Mean cross-validated AUC of naive Bayes on several feature subsets, in one job.

    The log odds of a subset are the sum of its features' terms, so no subset is fitted: each batch adds up the terms of
    its rows, folds equal scores, and the AUC of every (subset, fold) comes from one grouped curve.
    """
    # by fold and subset, the addition to all variances: as much as a fit on that subset adds
    eps = [[smoothing * (float(m[2][2][s].max()) or 1.0) for s in subsets] for m in moments]

    def terms(x, m, e, cols):
        one = lambda c: (x[:, cols] - m[c][1][cols]) ** 2 / (m[c][2][cols] + e) + np.log(m[c][2][cols] + e)
        return 0.5 * (one(0) - one(1)).sum(axis=1)

    def work(batches):
        for b in batches:
            x = np.stack(b.column("features").to_numpy(zero_copy_only=False)).astype(float) if b.num_rows else np.zeros((0, 1))
            y, fold = (b.column(c).to_numpy() for c in ("y", "fold"))
            for i in np.unique(fold):
                here, m = fold == i, moments[i]
                for j, cols in enumerate(subsets):
                    odds = np.log(m[1][0] / m[0][0]) + terms(x[here], m, eps[i][j], cols)
                    with np.errstate(over="ignore"):
                        p, at = np.unique(1 / (1 + np.exp(-odds)), return_inverse=True)
                    pos, of = (np.bincount(at, weights=w, minlength=len(p)).astype(np.int64) for w in (y[here], np.ones(here.sum())))
                    same = [pa.array(np.full(len(p), v, np.int32)) for v in (j, i)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(p), pa.array(pos), pa.array(of - pos)], names=["subset", "fold", "score", "pos", "neg"])

    rows = f.select("features", F.col(label).cast("long").alias("y"), "fold").mapInArrow(work, "subset int, fold int, score double, pos long, neg long")
    auc = metrics.counted_auc(rows.groupBy("subset", "fold", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), ["subset", "fold"])
    got = {r["subset"]: r["auc"] for r in auc.groupBy("subset").agg((F.sum("auc") / d(folds)).alias("auc")).collect()}
    return [got[j] for j in range(len(subsets))]


def search_k(df, label, ks=(30, 50, 80, 100), kind="logreg", params=None, folds=5, seed=42, key="id") -> DataFrame:
    """Cross-validated AUC of the k best features by F statistic, for each k: ``(k, auc, best)``."""
    f = stage(fold_ids(df.select(key, "features", label), label, folds, seed, key))
    imp = stage(anova_f(f, label).select("pos", "score"))
    subsets = [selected_positions(top_k(imp, k)) for k in ks]
    out = [(int(k), s) for k, s in zip(ks, subset_scores(f, subsets, label, kind, params, folds, key))]
    best = max(out, key=lambda r: (r[1], -r[0]))[0]
    return df.sparkSession.createDataFrame([(k, a, int(k == best)) for k, a in out], "k int, auc double, best int")
