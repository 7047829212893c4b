"""Spark ML stages: one pipeline fitted, saved, loaded, tuned and scored."""

import math

import pytest
from harness import oracle_connection, run_one
from pyspark.ml import Pipeline
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from riskframe import plans
from riskframe.models import stages as st
from riskframe.models.search import CompositeEvaluator
from riskframe.operators import score
from riskframe.sources import io

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def raw(spark):
    rows = []
    for i in range(240):
        y = i % 3 == 0
        rows.append((i, math.sin(i) + 2 * y, None if i % 11 == 0 else float("nan") if i % 13 == 0 else math.cos(i * 2) - y, float(i % 17), ["x", "y", None][i % 3], ["p", "q"][(i // 2) % 2], int(y), i // 3 % 3))
    return spark.createDataFrame(rows, "company_id long, a double, b double, c double, s string, t string, target int, fold int").repartition(4)


def _all_steps():
    return [
        st.TargetEncode(inputCols=["s"]), st.LabelEncode(inputCols=["t"]), st.FillMissing(inputCols=COLS), st.Bins(inputCols=["c"], n=3), st.Scale(inputCols=["a", "b"], kind="standard"),
        st.OneHot(inputCols=["s"]), st.Assemble(inputCols=[*COLS, "s_target_encoded", "t"]), st.RowStatistics(), st.ClusterDistances(k=3), st.Isolation(trees=5, sample=32), st.OutlierFactor(k=3),
        st.Select(method="fisher", t=0.0), st.Projection(kind="pca", k=4), st.Classify(kind="tree", settings='{"depth": 3}'),
    ]


def test_all_stages_saved_and_loaded(spark, raw, tmp_path):
    fitted = Pipeline(stages=_all_steps()).fit(raw)
    want = score.score_batch(raw, {"pipeline": fitted, "threshold": 0.4}).orderBy("uuid").collect()
    assert len(want) == 240 and {r.prediction for r in want} == {0, 1}
    io.save_bundle({"pipeline": fitted, "threshold": 0.4}, str(tmp_path / "bundle"), spark)
    again = io.load_bundle(spark, str(tmp_path / "bundle"))
    assert score.score_batch(raw, again).orderBy("uuid").collect() == want
    assert [s.uid for s in again["pipeline"].stages] == [s.uid for s in fitted.stages]


def test_unfitted_pipeline_keeps_its_settings(tmp_path):
    Pipeline(stages=_all_steps()).write().overwrite().save(str(tmp_path / "plan"))
    again = Pipeline.load(str(tmp_path / "plan")).getStages()
    assert [type(s) for s in again] == [type(s) for s in _all_steps()]
    assert again[8].get("k") == 3 and again[4].get("kind") == "standard" and again[6].get("inputCols") == [*COLS, "s_target_encoded", "t"]


def test_cross_validation_by_fold_column(raw):
    tree = st.Classify(kind="tree")
    steps = Pipeline(stages=[st.FillMissing(inputCols=COLS), st.Scale(inputCols=COLS), st.Assemble(inputCols=COLS), tree])
    grid = ParamGridBuilder().addGrid(tree.settings, ['{"depth": 1}', '{"depth": 3}']).build()
    cv = CrossValidator(estimator=steps, estimatorParamMaps=grid, evaluator=CompositeEvaluator("target", "proba"), numFolds=3, foldCol="fold")
    got = cv.fit(raw)
    assert len(got.avgMetrics) == 2 and all(0 < m <= 100 for m in got.avgMetrics)
    assert got.bestModel.transform(raw).filter("proba IS NULL").count() == 0


def test_scored_table_may_lack_a_column(raw):
    fitted = Pipeline(stages=[st.FillMissing(inputCols=COLS, strategy="constant"), st.Assemble(), st.Classify(kind="logreg")]).fit(raw)
    out = fitted.transform(raw.drop("c").withColumn("extra", F.lit(1)))
    assert out.count() == 240 and out.filter("size(features) <> 3").count() == 0
    with pytest.raises(ValueError):
        st.Select(method="none").fit(fitted.transform(raw))


@pytest.mark.parametrize("name", ["pipeline_scoring", "feature_pipeline"])
def test_queries(spark, sf, name):
    state, n, _, diff = run_one(spark, oracle_connection(sf), sf, name, plans.QUERIES[name], plans.ORACLES.get(name))
    assert state in ("OK", "ROWS") and n > 0, diff


def test_few_codes_do_not_gather_the_rows(raw):
    """Rows stay dealt out beside a code: a shuffle by two categories would leave two tasks to all that follows."""
    out = st.TargetEncode(inputCols=["t"]).fit(raw).transform(raw)
    assert "exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString().lower()
    assert out.count() == 240 and out.filter("t_target_encoded IS NULL").count() == 0
