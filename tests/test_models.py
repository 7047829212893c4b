"""Invariants of trained models: better than chance on planted signal, exact bookkeeping, stable reload."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from riskframe.models import ensembles, network, search
from riskframe.models.base import KINDS, Model, balanced_draws, fit_model
from riskframe.operators import clean, metrics, scale, schema, score
from riskframe.operators.sample import fold_ids
from riskframe.sources import io


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 5))
    x[:, 4] = 5.0
    y = (x[:, 0] + x[:, 1] - x[:, 2] > 0.8).astype(int)
    rows = [(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, features array<double>, target int").cache()


SMALL = {"gbt": {"rounds": 5, "depth": 2}, "adaboost": {"rounds": 6}, "rf": {"trees": 10, "depth": 3}, "brf": {"trees": 6, "depth": 3}, "mlp": {"hidden": [4], "iterations": 40}}


@pytest.mark.parametrize("kind", KINDS)
def test_better_than_chance(planted, kind):
    m = fit_model(planted, "target", kind, SMALL.get(kind))
    out = m.score(planted)
    assert set(out.columns) == {"id", "features", "target", "p"} and out.count() == 240
    assert metrics.roc_auc(out, "target", "p").first()["auc"] > 0.75
    lo, hi = out.agg(F.min("p"), F.max("p")).first()
    assert 0 <= lo <= hi <= 1


@pytest.mark.parametrize("kind", ["logreg", "linsvc", "rf", "mlp"])
def test_scores_where_the_session_has_watched_rows(spark, kind):
    """An Observation makes its session unfit to be sent; a training summary would take that session along with every task."""
    own, seen = spark.newSession(), Observation("rows")
    own.conf.set("spark.sql.shuffle.partitions", "2")
    rows = own.createDataFrame([(i, [float(i % 7), float(i % 3)], int(i % 7 > 3)) for i in range(60)], "id long, features array<double>, target int")
    assert len(rows.observe(seen, F.count(F.lit(1)).alias("n")).collect()) == seen.get["n"] == 60
    m = fit_model(rows, "target", kind, SMALL.get(kind))
    got = {r.id: r.p for r in m.score(rows).collect()}
    assert len(got) == 60 and not m.ml.hasSummary
    assert min(p for i, p in got.items() if i % 7 > 3) > max(p for i, p in got.items() if i % 7 <= 3)


def test_unknown_kind(planted):
    with pytest.raises(ValueError):
        fit_model(planted, "target", "svm_rbf")


def test_importances_ignore_the_constant_column(planted):
    for kind in ("rf", "gbt", "brf"):
        imp = search.tree_importance(planted, "target", kind, SMALL[kind])
        assert len(imp) == 5 and imp[4] == 0
    assert search.tree_importance(planted, "target", "rf_reg", {"trees": 5, "depth": 3})[4] == 0
    assert len(search.mlp_importance(planted, "target", [4], 10)) == 5


def test_permutation_importance(planted):
    m = fit_model(planted, "target", "gnb")
    got = {r["pos"]: r["mean"] for r in search.permutation_importance(planted, m, "target", 2).collect()}
    assert got[4] == 0 and min(got[0], got[1], got[2]) > got[3] - 0.02 and max(got.values()) > 0.05


@pytest.mark.parametrize("kind", ["gnb", "logreg", "tree"])
def test_permutation_importance_equals_swapping_by_hand(planted, kind):
    """One repeat, each feature swapped in pandas with the partner of the two hash rankings."""
    m = fit_model(planted, "target", kind, SMALL.get(kind))
    got = {r["pos"]: r["mean"] for r in search.permutation_importance(planted, m, "target", 1, seed=5).collect()}
    rows = planted.toPandas()
    md5 = lambda side, i: hashlib.md5(f"5|{side}|0|{i}".encode()).hexdigest()
    partner = dict(zip(sorted(rows.id, key=lambda i: md5("left", i)), sorted(rows.id, key=lambda i: md5("right", i))))
    value = dict(zip(rows.id, rows.features))
    accuracy = lambda df: df.select(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("target")).cast("double"))).first()[0]
    whole = accuracy(m.score(planted))
    for j in range(5):
        swapped = [(int(i), [float(value[partner[i]][k] if k == j else x) for k, x in enumerate(f)], int(y)) for i, f, y in rows.itertuples(index=False)]
        assert got[j] == pytest.approx(whole - accuracy(m.score(planted.sparkSession.createDataFrame(swapped, planted.schema))), abs=1e-12)


def test_additive_scores_equal_fits_of_every_subset(planted):
    f = fold_ids(planted, "target", 3).cache()
    subsets = [[0], [2, 1], [4], [0, 1, 2, 3, 4]]
    fast = search.additive_scores(f, subsets, "target", search.fold_moments(f, "target", 3), 3)
    assert fast == pytest.approx(search.subset_scores(f, subsets, "target", "gnb", None, 3, "id"), abs=1e-9)


def test_network_gradient_is_the_slope_of_the_loss(planted):
    rows = network.weighted_rows(planted, "target", pos_weight=3.0)
    layers, step = [5, 3, 2, 1], 1e-5
    theta = np.random.default_rng(2).normal(0, 0.5, 5 * 3 + 3 + 3 * 2 + 2 + 2 + 1)
    g, _ = network.gradient(rows, theta, layers)
    local = rows.toPandas()
    x, y, w = np.stack(local.features), local.y.to_numpy(), local.w.to_numpy()
    loss = lambda t: network.gradient_sum(x, y, w, t, layers)[-2] / w.sum()
    slope = [(loss(theta + step * e) - loss(theta - step * e)) / (2 * step) for e in np.eye(len(theta))]
    assert g == pytest.approx(slope, abs=1e-6)
    with pytest.raises(ValueError):
        network.gradient(rows.limit(0), theta, layers)


def test_weight_on_positives_moves_the_scores(planted):
    plain, heavy = (fit_model(planted, "target", "mlp", {"hidden": [4], "iterations": 40, "pos_weight": w}) for w in (1.0, 100.0))
    mean = lambda m: m.score(planted).agg(F.avg("p")).first()[0]
    assert mean(heavy) > mean(plain) + 0.1 and metrics.roc_auc(heavy.score(planted), "target", "p").first()["auc"] > 0.9
    assert plain.state["losses"][-1] < plain.state["losses"][0] and len(plain.importances()) == 5
    by_row = fit_model(planted.withColumn("w", F.when(F.col("target") == 1, 100.0).otherwise(1.0)), "target", "mlp", {"hidden": [4], "iterations": 40}, weight="w")
    assert mean(by_row) == pytest.approx(mean(heavy), abs=1e-9)
    back = Model.from_bundle(heavy.bundle())
    assert mean(back) == mean(heavy)


def test_every_tree_draws_balanced_classes(spark):
    df = spark.range(6000).selectExpr("id", "CAST(id % 10 = 0 AS INT) AS target")
    seen = set()
    for tree in range(3):
        got = {r["target"]: r for r in balanced_draws(df, "target", tree, 1, "id").groupBy("target").agg(F.sum("__w").alias("n"), F.max("__w").alias("most"), F.sum(F.col("id") * F.col("__w")).alias("of")).collect()}
        assert abs(got[0]["n"] - 600) < 125 and abs(got[1]["n"] - 600) < 125 and got[1]["most"] > 1
        seen.add(got[0]["of"])
    assert len(seen) == 3


def test_out_of_fold_covers_each_row_once(planted):
    f = fold_ids(planted, "target", 3)
    out = ensembles.out_of_fold(f, "target", [("gnb", {}), ("tree", {"depth": 2})], 3, "id")
    assert out.count() == 240 and out.select("id").distinct().count() == 240
    assert out.filter("m0 is null or m1 is null").count() == 0


def test_stacking_and_cascade(planted):
    s = ensembles.fit_stacking(planted, "target", [("gnb", {}), ("tree", {"depth": 3})], folds=2)
    assert metrics.roc_auc(s.score(planted), "target", "p").first()["auc"] > 0.8
    c = ensembles.fit_cascade_forest(planted, "target", 2, ("rf", SMALL["rf"]), valid=planted, folds=2)
    out = c.score(planted)
    assert 1 <= len(c.layers) <= 2 and set(out.columns) == {"id", "features", "target", "p"}
    assert len(out.select("features").first()[0]) == 5


def test_meta_model_falls_back(planted):
    perfect = planted.withColumn("base", F.col("target").cast("double"))
    assert ensembles.fit_meta(perfect, "target", "base", "gnb").kind == "gnb"


def test_search_and_elimination(planted):
    best, trials = search.random_search(planted, "target", "tree", {"depth": [1, 2, 3]}, 2)
    assert trials.count() == 2 and best["depth"] in (1, 2, 3)
    out = search.rfe(planted, "target", "logreg", {"iterations": 10}, n=3)
    assert sorted(out["selected"]) == [0, 1, 2] and out["rank"].count(1) == 3
    f = search.forward_addition(planted, "target", "gnb", folds=2, min_features=2, cap=2)
    assert len(f["order"]) == 2 and sorted(f["rank"]) == [1, 2, 3, 4, 5]
    k = search.search_k(planted, "target", (1, 3), "gnb", folds=2)
    assert k.filter("best = 1").first()["k"] == 3


def test_cv_score(planted):
    r = search.cv_score(planted, "target", "gnb", folds=3, metric="f1_macro").first()
    assert 0.5 < r["mean"] <= 1 and r["folds"] == 3


def test_bundle_reload_gives_the_same_scores(spark, tmp_path):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(
        [(f"COMP_{i}", float(a), None if i % 9 == 0 else float(b), int(a + b > 1)) for i, (a, b) in enumerate(rng.normal(size=(120, 2)))],
        "company_id string, a double, b double, target int",
    )
    impute = clean.fit_impute(df, ["a", "b"])
    filled = clean.apply_impute(df, impute)
    scaled = scale.fit_scale(filled, ["a", "b"])
    train = schema.assemble(scale.apply_scale(filled, scaled), ["a", "b"])
    bundle = {"cols": ["a", "b"], "impute": impute, "scale": scaled, "threshold": 0.4}
    for kind in ("logreg", "adaboost", "gnb", "brf"):
        m = fit_model(train, "target", kind, {"rounds": 3, "trees": 4, "depth": 2}, key="company_id")
        io.save_bundle({**bundle, **{f"m_{k}": v for k, v in m.bundle().items()}}, str(tmp_path / kind), spark)
        back = io.load_bundle(spark, str(tmp_path / kind))
        again = {**back, "model": Model.from_bundle({k[2:]: v for k, v in back.items() if k.startswith("m_")})}
        a = score.score_batch(df, {**bundle, "model": m}).orderBy("uuid").collect()
        b = score.score_batch(df, again).orderBy("uuid").collect()
        assert a == b and a[0].asDict().keys() == {"uuid", "proba", "prediction"}


def test_default_threshold(planted):
    class Half:
        def score(self, df, out):
            return df.withColumn(out, F.lit(0.65))

    df = planted.select(F.col("id").alias("company_id"), F.col("features")[0].alias("a"))
    assert score.score_batch(df, {"cols": ["a"], "model": Half()}).filter("prediction = 1").count() == 0


def test_adaboost_restaging_changes_nothing(planted, monkeypatch):
    from riskframe.models import base

    whole = fit_model(planted, "target", "adaboost", {"rounds": 5, "lr": 0.5})
    monkeypatch.setattr(base, "RESTAGE", 2)
    parts = fit_model(planted, "target", "adaboost", {"rounds": 5, "lr": 0.5})
    assert parts.state["f"] == whole.state["f"]
    assert parts.state["alpha"] == pytest.approx(whole.state["alpha"])


def test_composite_evaluator_in_cross_validation(planted):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    df = planted.select(array_to_vector("features").alias("features"), F.col("target").alias("label"))
    lr = LogisticRegression(maxIter=10)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.01, 10.0]).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=search.CompositeEvaluator(), numFolds=2, seed=1).fit(df)
    assert cv.avgMetrics[0] > cv.avgMetrics[1]
