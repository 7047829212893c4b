"""Missing values, ties, caps and places that earlier rounds got wrong."""

import math
import os
import shutil
import subprocess
import sys
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.functions.exprs import hash_hex
from riskframe.models import ensembles
from riskframe.models.base import fit_model
from riskframe.operators import clean, cluster, encode, profile, quantiles, ranking, scale, schema, thresholds
from riskframe.sources import io

NAN = float("nan")


@pytest.mark.parametrize("small", [10, 200_000])
def test_even_quantiles_are_exact(spark, small):
    x = np.random.default_rng(3).lognormal(size=5000).round(3)
    df = spark.createDataFrame([(float(v), float(i % 7)) for i, v in enumerate(x)] + [(None, NAN)], "a double, b double")
    got = quantiles.even_quantiles(df, ["a", "b"], 1000, small)
    assert np.allclose(got["a"], np.quantile(x, np.linspace(0, 1, 1000)), rtol=0, atol=1e-9)
    assert np.allclose(got["b"], np.quantile(np.arange(5000) % 7, np.linspace(0, 1, 1000)), atol=1e-9)


def test_quantile_scaler_beyond_one_read(spark):
    df = spark.range(250_000).select(F.exp(F.hash("id") / F.lit(2.0**30)).alias("a"))
    x = np.array([r.a for r in df.collect()])
    grid = scale.fit_scale(df, ["a"], "quantile").cols["a"]["v"]
    assert np.allclose(grid, np.quantile(x, np.linspace(0, 1, 1000)), rtol=1e-9)


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float(i), i) for i in range(19)] + [(NAN, 19)], "x double, id long")
    assert schema.outliers_z(df, ["x"]).count() == 0
    assert schema.outliers_iqr(df, ["x"]).count() == 0
    for how, want in (("mean", 9.0), ("median", 9.0)):
        fit = clean.fit_impute(df, ["x"], how)
        assert fit.cols["x"]["fill"] == want
        assert clean.apply_impute(df, fit).filter("id = 19").first().x == want
    assert {r["column"]: r["nulls"] for r in profile.null_profile(df).collect()} == {"x": 1, "id": 0}
    assert scale.fit_scale(df, ["x"], "standard").cols["x"]["center"] == 9.0
    assert scale.fit_scale(df, ["x"], "minmax").cols["x"] == {"center": 0.0, "scale": 18.0}


@pytest.mark.parametrize("take", [5, 20_000])
def test_hash_cut_with_repeated_keys(spark, take, monkeypatch):
    monkeypatch.setattr(ranking, "TAKE", take)
    rows = spark.range(3000).selectExpr("id", "CAST(id % 2 AS INT) AS y", "CASE WHEN id < 2000 THEN 7 ELSE id END AS k")
    keep = ranking.hash_cut(rows, "y", {0: 600, 1: 1400}, hash_hex(F.col("k")))
    assert {r.y: r["count"] for r in rows.filter(keep).groupBy("y").count().collect()} == {0: 600, 1: 1400}
    same = spark.range(100).selectExpr("1 AS y", "7 AS k")
    kept = same.filter(ranking.hash_cut(same, "y", {1: 60}, hash_hex(F.col("k")))).count()
    assert kept == 100  # equal rows stay together, by the nearer count


@pytest.mark.parametrize("objective", ["gmean", "cost", "youden", "fbeta"])
def test_null_scores_are_negative(spark, objective):
    rows = [(1, 0.9), (1, 0.8), (0, 0.1), (0, 0.3), (1, None), (0, None), (None, 0.5), (1, NAN)]
    df = spark.createDataFrame(rows, "y int, p double")
    full = df.filter("y IS NOT NULL").fillna(-1.0, ["p"]).withColumn("p", F.nanvl("p", F.lit(-1.0)))
    assert thresholds.grid_threshold(df, "y", "p", objective=objective).first() == thresholds.grid_threshold(full, "y", "p", objective=objective).first()


def test_adaboost_importances_are_as_wide_as_the_rows(spark):
    df = spark.range(60).selectExpr("id", "array(CAST(id % 2 AS DOUBLE), 0.0, 1.0, 2.0, 3.0) AS features", "CAST(id % 2 AS INT) AS target")
    assert len(fit_model(df, kind="adaboost", params={"rounds": 2}).importances()) == 5


@pytest.mark.parametrize("kind", ["gnb", "knn", "brf"])
def test_unsupported_weights_are_refused(spark, kind):
    df = spark.createDataFrame([(1, [0.0], 0, 1.0)], "id long, features array<double>, target int, w double")
    with pytest.raises(ValueError):
        fit_model(df, kind=kind, weight="w")


def test_patience_stops_boosting(spark):
    rows = spark.range(400).selectExpr("id", "array(CAST(id % 17 AS DOUBLE), CAST(id % 5 AS DOUBLE)) AS features", "CAST((id * 7919) % 10 < 5 AS INT) AS target", "id % 4 = 0 AS v")
    m = fit_model(rows, valid="v", params={"rounds": 12, "patience": 2, "depth": 3})
    full = fit_model(rows.filter("NOT v"), params={"rounds": 12, "depth": 3})
    trees = m.ml.getNumTrees
    assert 1 <= trees <= 12 and m.ml.toDebugString.split("Tree 1")[0].split("Tree 0")[1] == full.ml.toDebugString.split("Tree 1")[0].split("Tree 0")[1] if trees > 1 else True


def test_banner_lines_go_by_place(spark):
    folder = tempfile.mkdtemp(prefix="riskframe-test-")
    for name in ("a", "b"):
        with open(f"{folder}/{name}.csv", "w") as f:
            f.write("1,2\nx,y\n1,2\n3,4\nx,y\n")
    out = io.read_csv(spark, folder, skip_rows=1)
    assert sorted(map(tuple, out.collect())) == sorted([("1", "2"), ("3", "4"), ("x", "y")] * 2)


def test_sparse_onehot_and_bundles(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c"), (5, "a")], "id long, v string")
    codes = encode.fit_onehot_sparse(df.filter("id < 4 OR id = 5"), ["v"])
    wide = {r.id: r.v_onehot for r in encode.apply_onehot_sparse(df, codes).collect()}
    assert {i: (v.size, v.indices.tolist()) for i, v in wide.items()} == {1: (2, [1]), 2: (2, [0]), 3: (2, []), 4: (2, []), 5: (2, [0])}
    rows = spark.range(40).selectExpr("id", "array(CAST(id % 5 AS DOUBLE), CAST(id % 2 AS DOUBLE)) AS features", "CAST(id % 2 AS INT) AS target")
    target = encode.fit_target(rows.selectExpr("CAST(id % 3 AS STRING) AS c", "target"), ["c"], "target")
    stack = ensembles.fit_stacking(rows, "target", [("gnb", {}), ("tree", {"depth": 2})], ("logreg", {}), folds=2)
    folder = tempfile.mkdtemp(prefix="riskframe-test-")
    saved = {"codes": codes, "target": target, "stack": stack, "labels": encode.fit_label(df, ["v"]), "n": 3, "names": ["a", "b"]}
    io.save_bundle(saved, folder, spark)
    moved = f"{folder}-moved"
    shutil.copytree(folder, moved)
    back = io.load_bundle(spark, moved)
    assert {r.id: r.v_onehot for r in encode.apply_onehot_sparse(df, back["codes"]).collect()} == wide
    assert sorted(back["stack"].score(rows).select("id", "p").collect()) == sorted(stack.score(rows).select("id", "p").collect())
    assert sorted(back["target"].mapping["c"].collect()) == sorted(target.mapping["c"].collect()) and back["target"].default == target.default
    assert sorted(back["labels"]["v"].collect()) == sorted(saved["labels"]["v"].collect()) and (back["n"], back["names"]) == (3, ["a", "b"])


def test_outlier_factor_of_new_rows(spark):
    rng = np.random.default_rng(2)
    x, new = rng.normal(size=(80, 3)), np.vstack([rng.normal(size=(5, 3)), [[9.0, 9.0, 9.0]]])
    frame = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, features array<double>")
    got = {r.id: r.lof for r in cluster.score_lof(frame(new), cluster.fit_lof(frame(x), 6)).collect()}
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(gap, np.inf)
    near = np.argsort(gap, axis=1)[:, :6]
    kd = np.take_along_axis(gap, near, 1).max(axis=1)
    lrd = 1 / (np.maximum(kd[near], np.take_along_axis(gap, near, 1)).mean(axis=1) + 1e-10)
    away = np.sqrt(((new[:, None] - x[None]) ** 2).sum(-1))
    at = np.argsort(away, axis=1)[:, :6]
    own = 1 / (np.maximum(kd[at], np.take_along_axis(away, at, 1)).mean(axis=1) + 1e-10)
    assert np.allclose([got[i] for i in range(6)], lrd[at].mean(axis=1) / own, rtol=1e-9)
    assert got[5] > 2


def test_queries_run_from_another_folder(sf):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import importlib.util, sys; s = importlib.util.spec_from_file_location('e', {repo + '/__spark_entry__.py'!r}); m = importlib.util.module_from_spec(s); s.loader.exec_module(m)\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '4').getOrCreate()\n"
        f"print('ROWS', m.queries()['knn_join'](spark, {sf!r}).count())"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tempfile.mkdtemp(prefix="riskframe-test-"), env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in got.stdout and not math.isnan(int(got.stdout.split("ROWS")[1])), got.stderr[-800:]
