"""Models built from models: stacking, cascade forest, two objectives, hard-example correction."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.exprs import d
from riskframe.models.base import Model, fit_model
from riskframe.models.search import one_metric, random_search, run_all
from riskframe.operators import ensemble, metrics, thresholds
from riskframe.operators.sample import append_rows, fold_ids
from riskframe.operators.schema import hard_rows
from riskframe.session import stage

Member = tuple[str, dict]  # (kind, params)


def out_of_fold(df: DataFrame, label: str, members: list[Member], folds: int, key: str) -> DataFrame:
    """Add ``m0, m1 ...``: each row scored by members that did not see its fold. ``df`` has ``fold``."""
    spark = df.sparkSession
    jobs = [(i, j) for i in range(folds) for j in range(len(members))]

    def fit(i, j):
        return lambda: fit_model(df.filter(F.col("fold") != i), label, *members[j], key=key)

    fitted = dict(zip(jobs, run_all(spark, [fit(i, j) for i, j in jobs])))
    out = None
    for i in range(folds):
        part = df.filter(F.col("fold") == i)
        for j in range(len(members)):
            part = fitted[i, j].score(part, f"m{j}")
        out = part if out is None else out.unionByName(part)
    return out


@dataclass
class Stacking:
    members: list[Model]
    final: Model
    passthrough: bool

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        keep = [c for c in df.columns if c != out]
        s = df
        for j, m in enumerate(self.members):
            s = m.score(s, f"__m{j}")
        s = s.withColumn("__x", features_of([f"__m{j}" for j in range(len(self.members))], self.passthrough))
        return self.final.score(s, out).select(*keep, out)


def features_of(names: list[str], passthrough: bool):
    own = F.array(*[F.col(n) for n in names])
    return F.concat(own, F.col("features")) if passthrough else own


def fit_stacking(
    df: DataFrame, label: str, members: list[Member], final: Member = ("gnb", {}), folds: int = 5, passthrough: bool = False, seed: int = 42, key: str = "id"
) -> Stacking:
    """Members' out-of-fold scores train the final model; members are then refitted on everything."""
    f = stage(fold_ids(df.select(key, "features", label), label, folds, seed, key))
    oof = stage(out_of_fold(f, label, members, folds, key))
    x = oof.withColumn("__x", features_of([f"m{j}" for j in range(len(members))], passthrough))
    last = fit_model(x, label, *final, col="__x", key=key)
    refit = run_all(df.sparkSession, [lambda m=m: fit_model(f, label, *m, key=key) for m in members])
    return Stacking(refit, last, passthrough)


@dataclass
class Cascade:
    layers: list[Model]
    history: list[float] = field(default_factory=list)

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        keep = [c for c in df.columns if c not in (out, "features")]
        s = df.withColumn("__keep", F.col("features"))
        for i, m in enumerate(self.layers):
            s = m.score(s, "__q")
            if i < len(self.layers) - 1:
                s = s.withColumn("features", F.concat("features", F.array("__q")))
        return s.select(*keep, F.col("__keep").alias("features"), F.col("__q").alias(out))


def fit_cascade_forest(
    df: DataFrame, label: str, layers: int = 3, member: Member = ("rf", {"trees": 50}), valid: DataFrame | None = None, folds: int = 3, seed: int = 42, key: str = "id"
) -> Cascade:
    """Each layer sees the inputs plus the out-of-fold scores of the layers before it; the last one predicts.

    With ``valid`` rows, growing stops at the first layer that does not raise their AUC.
    """
    now = stage(fold_ids(df.select(key, "features", label), label, folds, seed, key))
    out = Cascade([])
    best = -1.0
    for i in range(layers):
        kind, params = member
        layer = (kind, {**params, "seed": seed + i})
        model = fit_model(now, label, *layer, key=key)
        if valid is not None:
            auc = one_metric(Cascade([*out.layers, model]).score(valid), label, "p", "auc")
            out.history.append(auc)
            if auc <= best:
                break
            best = auc
        out.layers.append(model)
        if i < layers - 1:
            oof = out_of_fold(now, label, [layer], folds, key)
            now = stage(oof.withColumn("features", F.concat("features", F.array("m0"))).drop("m0"))
    return out


@dataclass
class Average:
    members: list[Model]

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        names = [f"__m{j}" for j in range(len(self.members))]
        for n, m in zip(names, self.members):
            df = m.score(df, n)
        return ensemble.soft_vote(df, names, out).drop(*names)


def fit_two_objective(df: DataFrame, label: str, kind: str, grid: dict, n: int = 20, seed: int = 42, key: str = "id") -> tuple[Average, dict]:
    """One model tuned for AUC, one for F1; scores are averaged."""
    chosen = {m: random_search(df, label, kind, grid, n, m, seed=seed, key=key)[0] for m in ("auc", "f1")}
    return Average([fit_model(df, label, kind, p, key=key) for p in chosen.values()]), chosen


def fit_meta(df: DataFrame, label: str, base_p: str, kind: str = "logreg", params: dict | None = None, key: str = "id") -> Model:
    """Corrector trained on the rows the base model got wrong; on all rows when those are empty or of one class."""
    wrong = hard_rows(df, base_p, label)
    classes = wrong.select(label).distinct().limit(2).count()
    return fit_model(wrong if classes == 2 else df, label, kind, params, key=key)


def meta_bakeoff(hard: DataFrame, test: DataFrame, label: str, base_p: str, kinds: list[Member], key: str = "id") -> DataFrame:
    """Correctors trained on the hard rows, ranked by F1.2 on ``test`` at their own cost-optimal threshold."""
    test = stage(test)

    def trial(member):
        def run():
            m = fit_model(hard, label, *member, key=key)
            s = ensemble.cascade_proba(m.score(test, "__meta"), base_p, "__meta", out="__p")
            t = thresholds.grid_threshold(s, label, "__p", objective="cost", recall=1.0, precision=1.0, specificity=0.0).first()["threshold"]
            r = metrics.rates(metrics.confusion(s, label, "__p", t), 1.2).first()
            return (member[0], float(t), float(r["precision"]), float(r["recall"]), float(r["fbeta"]))

        return run

    rows = run_all(test.sparkSession, [trial(m) for m in kinds])
    rows.sort(key=lambda r: (-r[4], r[0]))
    return test.sparkSession.createDataFrame(
        [(*r, i + 1) for i, r in enumerate(rows)], "model string, threshold double, precision double, recall double, fbeta double, place int"
    )


def refit(train: DataFrame, valid: DataFrame, test: DataFrame, label: str, members: list[Member], key: str = "id") -> DataFrame:
    """Threshold found on validation rows by a model of the training rows, members refitted on both, one
    metric row per stage on the test rows."""
    cols = [key, "features", label]
    first = Average(run_all(train.sparkSession, [lambda m=m: fit_model(train, label, *m, key=key) for m in members]))
    t = thresholds.grid_threshold(first.score(valid), label, "p", objective="gmean").first()["threshold"]
    both = stage(append_rows(train.select(cols), valid.select(cols)))
    second = Average(run_all(train.sparkSession, [lambda m=m: fit_model(both, label, *m, key=key) for m in members]))
    rows = [metrics.evaluate(m.score(test), label, "p", t).withColumn("stage", F.lit(s)) for s, m in (("train", first), ("refit", second))]
    return rows[0].unionByName(rows[1]).withColumn("threshold", d(t))
