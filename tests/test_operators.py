"""Hand-checked values and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import (
    build, clean, embed, encode, ensemble, explain, metrics, profile, project, sample, scale, schema, select, thresholds,
)
from riskframe.operators.fitted import Fitted
from riskframe.sources import io


@pytest.fixture(scope="module")
def scored(spark):
    # scores .9 .8 .8 .4 .2 with labels 1 0 1 0 1
    return spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.8), (3, 1, 0.8), (4, 0, 0.4), (5, 1, 0.2)], "id long, y int, p double")


def col(df, c, key="id"):
    return [r[c] for r in df.orderBy(key).collect()]


def test_outliers_skip_constant_and_incomplete_columns(spark):
    df = spark.createDataFrame([(i, 0.0, 5.0, None if i == 0 else float(i)) for i in range(20)] + [(20, 100.0, 5.0, 900.0)], "id long, a double, b double, c double")
    assert col(schema.outliers_z(df, ["a", "b", "c"]).select("id"), "id") == [20]
    assert schema.outliers_z(df, ["b", "c"]).count() == 0
    assert col(schema.outliers_iqr(df, ["c"]).select("id"), "id") == [20]


def test_split_needs_the_label(spark):
    with pytest.raises(ValueError):
        schema.split_xy(spark.range(1), "target")


def test_align_adds_drops_and_orders(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id int, b double, x double")
    assert schema.align(df, ["a", "b"]).columns == ["a", "b"]
    assert schema.align(df, ["a", "b"]).first().asDict() == {"a": 0.0, "b": 2.0}


def test_sorted_names_are_lexicographic(spark):
    assert schema.sort_columns(spark.range(1).selectExpr("1 as x_dim_2", "2 as x_dim_10")).columns == ["x_dim_10", "x_dim_2"]


def test_drop_null_label(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan"))], "id int, target double")
    assert col(schema.drop_null_label(df), "id") == [1]


def test_band_is_open(spark):
    df = spark.createDataFrame([(1, 0.3), (2, 0.5), (3, 0.7)], "id int, p double")
    assert col(schema.uncertain_rows(df, "p"), "id") == [2]


def test_slice_by_mask(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "features array<double>")
    assert schema.slice_features(df, [True, False, True]).first()[0] == [1.0, 3.0]


def test_impute_keeps_a_column_without_values(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, None)], "id int, a double, b double")
    out = clean.apply_impute(df, clean.fit_impute(df, ["a", "b"]))
    assert col(out, "a") == [None, None] and col(out, "b") == [1.0, 1.0]
    with pytest.raises(ValueError):
        clean.fit_impute(df, ["a"], "mode")


def test_impute_vectors(spark):
    nan = float("nan")
    rows = [(1, None), (2, []), (3, [nan, nan]), (4, [1.0]), (5, [1.0, 2.0, 3.0]), (6, [nan, 2.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>").withColumn("v", clean.impute_vectors(F.col("v"), 2))
    got = col(df, "v")
    assert got[:5] == [[0.0, 0.0], [0.0, 0.0], [0.0, 0.0], [1.0, 0.0], [1.0, 2.0]]
    assert math.isnan(got[5][0]) and got[5][1] == 2.0


def test_label_codes_null_and_unseen(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "id int, s string")
    d = encode.fit_label(df, ["s"])
    assert col(encode.apply_label(df, d), "s") == [1, 2, 0]  # 'a' < 'b' < 'nan'
    assert col(encode.apply_label(spark.createDataFrame([(1, "zz")], "id int, s string"), d), "s") == [None]


def test_onehot_one_category(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    assert encode.apply_onehot(df, encode.fit_onehot(df, ["s"])).columns == ["id"]
    out = encode.apply_onehot(spark.createDataFrame([(1, "q")], "id int, s string"), encode.fit_onehot(df, ["s"], drop_first=False))
    assert out.first().asDict() == {"id": 1, "s_a": 0}


def test_target_codes(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], "s string, y int")
    fit = encode.fit_target(df, "s", "y")
    codes = {r["value"]: r["enc"] for r in fit.mapping["s"].collect()}
    g = 2 / 3
    assert codes["a"] == pytest.approx((1 + g) / 3) and codes["b"] == pytest.approx((1 + g) / 2)
    assert fit.default["s"] == pytest.approx((codes["a"] + codes["b"]) / 2)


def test_bins_close_left_and_clip(spark):
    fit = Fitted("bins", {"x": {"edges": [0.0, 1.0, 2.0]}})
    df = spark.createDataFrame([(1, -5.0), (2, 1.0), (3, 2.0), (4, 9.0), (5, None)], "id int, x double")
    assert col(encode.apply_bins(df, fit), "x") == [0, 1, 1, 1, None]


def test_bins_merge_equal_edges(spark):
    df = spark.createDataFrame([(1.0,)] * 9 + [(2.0,)], "x double")
    assert encode.fit_bins(df, ["x"], 5).cols["x"]["edges"] == [1.0, 2.0]


def test_route_is_a_prefix_match():
    assert encode.route(["f1", "f3", "f30", "c"], ["f1"], ["f3"], ["c$"]) == (["f1"], ["f3", "f30"], ["c"])


def test_constant_columns_scale_to_zero(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, x double")
    for kind in scale.KINDS:
        assert col(scale.apply_scale(df, scale.fit_scale(df, ["x"], kind)), "x") == [0.0, 0.0], kind
    with pytest.raises(ValueError):
        scale.fit_scale(df, ["x"], "unit")


def test_standard_scale_is_population(spark):
    df = spark.createDataFrame([(i, float(i)) for i in (1, 2, 3, 4)], "id int, x double")
    assert col(scale.apply_scale(df, scale.fit_scale(df, ["x"])), "x")[0] == pytest.approx(-1.5 / math.sqrt(1.25))


def test_quantile_scale_clips_and_interpolates(spark):
    fit = scale.fit_scale(spark.createDataFrame([(0.0,), (10.0,), (20.0,)], "x double"), ["x"], "quantile")
    df = spark.createDataFrame([(1, -1.0), (2, 0.0), (3, 5.0), (4, 20.0), (5, 99.0), (6, None)], "id int, x double")
    assert col(scale.apply_scale(df, fit), "x") == [0.0, 0.0, 0.25, 1.0, 1.0, None]


def test_fitted_round_trip(spark):
    f = Fitted("standard", {"x": {"center": 1.5, "scale": 2.0}}, {"note": 1})
    assert Fitted.from_df(f.to_df(spark)) == f


def test_row_statistics(spark):
    df = build.row_stats(spark.createDataFrame([(1, [1.0, 2.0, 3.0, 6.0]), (2, [2.0, 2.0])], "id int, features array<double>"))
    a, b = df.orderBy("id").collect()
    assert (a["row_mean"], a["row_median"], a["row_q25"], a["row_max"]) == (3.0, 2.5, 1.75, 6.0)
    x = np.array([1, 2, 3, 6.0])
    assert a["row_skew"] == pytest.approx(((x - 3) ** 3).mean() / x.std() ** 3)
    assert (b["row_std"], b["row_skew"], b["row_kurtosis"]) == (0.0, 0.0, 0.0)


def test_narrow_rows_have_no_coarse_features(spark):
    df = spark.createDataFrame([([1.0] * 10,)], "features array<double>")
    assert build.coarse_stats(df).first()["coarse"] == [0.0] * 5
    assert build.fine_features(df).first()["fine"] == [0.0] * 10


def test_interaction_names():
    assert build.interaction_pairs([0.1, 0.9, 0.5], 0.2) == [(1, 2)]


def test_embedding_groups():
    cols = ["a_emb_10", "a_emb_2", "x_emb_y_emb_0", "a_emb_z", "_emb_1", "id"]
    assert embed.emb_groups(cols) == {"a": ["a_emb_2", "a_emb_10"], "x_emb_y": ["x_emb_y_emb_0"]}


def test_text_without_tokens(spark):
    df = spark.createDataFrame([(1, "  "), (2, "a b a"), (3, None)], "id int, text string")
    out = embed.text_embedding(df, "text", embed.fit_text(df, "text", 8))
    v = col(out, "features")
    assert v[0] == [0.0] * 8 and v[2] == [0.0] * 8 and sum(x * x for x in v[1]) == pytest.approx(1)


def test_bigrams(spark):
    df = spark.createDataFrame([("a b c",), ("a",)], "t string").select(embed.tokens(F.col("t"), 2).alias("g"))
    assert [r["g"] for r in df.collect()] == [["a b", "b c"], []]


def test_projections(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4)) @ np.diag([5, 2, 1, 0.1]) + 3
    df = spark.createDataFrame([([float(v) for v in r], int(r[0] > 3)) for r in x], "features array<double>, target int")
    pca = project.fit_pca(df)
    c = np.array(pca["components"])
    assert np.allclose(c @ c.T, np.eye(len(c)), atol=1e-9) and sum(pca["share"]) > 0.95 and len(c) < 4
    assert np.allclose(np.array([r[0] for r in project.project(df, pca).select("projected").collect()]).mean(axis=0), 0, atol=1e-9)
    s = project.fit_svd(df, 2)
    assert np.allclose(s["singular"], np.linalg.svd(x, compute_uv=False)[:2])
    w = np.array(project.fit_lda1(df)["components"][0])
    assert abs(w[0]) == pytest.approx(max(abs(w)), rel=0.9)
    with pytest.raises(ValueError):
        project.fit_lda1(df.filter("target = 1"))


def test_auc_ties_and_one_class(spark, scored):
    # pairs: .9 beats both; .8 ties .8 and beats .4; .2 loses both -> (2 + 1.5 + 0) / 6
    assert metrics.roc_auc(scored, "y", "p").first()["auc"] == pytest.approx(3.5 / 6)
    assert metrics.roc_auc(scored.filter("y = 1"), "y", "p").first()["auc"] == 0.0
    same = scored.withColumn("p", F.lit(0.5))
    assert metrics.roc_auc(same, "y", "p").first()["auc"] == 0.5


def test_rates_without_predictions(scored):
    r = metrics.rates(metrics.confusion(scored, "y", "p", 0.95)).first()
    assert (r["precision"], r["recall"], r["f1"], r["fbeta"], r["specificity"]) == (0, 0, 0, 0, 1)


def test_curves(scored):
    roc = [(r["threshold"], r["fpr"], r["tpr"]) for r in metrics.roc_curve(scored, "y", "p").orderBy(F.col("threshold").desc()).collect()]
    assert roc == [(0.9, 0.0, 1 / 3), (0.8, 0.5, 2 / 3), (0.4, 1.0, 2 / 3), (0.2, 1.0, 1.0)]
    area = metrics.pr_auc(scored, "y", "p").first()[0]
    pts = [(0, 1), (1 / 3, 1), (2 / 3, 2 / 3), (2 / 3, 0.5), (1, 0.6)]
    assert area == pytest.approx(sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:])))


def test_thresholds(scored):
    best = thresholds.best_f1_threshold(scored, "y", "p").first()
    assert best["threshold"] == 0.2 and best["f1"] == pytest.approx(0.75)
    assert thresholds.max_recall_threshold(scored, "y", "p", 0.65).first()["threshold"] == 0.8
    none = thresholds.max_recall_threshold(scored.withColumn("y", F.lit(0)), "y", "p").first()
    assert (none["threshold"], none["recall"]) == (0.5, None)
    assert thresholds.grid_threshold(scored.withColumn("y", F.lit(0)), "y", "p").first()["threshold"] == 0.5


@pytest.mark.parametrize("kind", ["gmean", "cost", "youden", "fbeta"])
def test_grid_matches_a_full_scan(spark, kind):
    rng = np.random.default_rng(4)
    y, p = rng.integers(0, 2, 300), np.round(rng.random(300), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    grid = thresholds.grid_points(*thresholds.GRIDS[kind])
    cells = [(t, int(((p >= t) & (y == 1)).sum()), int(((p >= t) & (y == 0)).sum()), int(((p < t) & (y == 1)).sum()), int(((p < t) & (y == 0)).sum())) for t in grid]
    assert thresholds.grid_counts(df, "y", "p", grid) == cells
    vals = [thresholds.objective_value(kind, *c[1:], {}) for c in cells]
    assert thresholds.grid_threshold(df, "y", "p", objective=kind).first()["threshold"] == grid[int(np.argmax(vals))]


def test_votes(spark):
    df = spark.createDataFrame([(1, 1, 0, 0.2, 0.9), (2, 1, 1, 0.5, 0.5)], "id int, a int, b int, p double, q double")
    assert col(ensemble.hard_vote(df, ["a", "b"]), "vote") == [0, 1]
    assert col(ensemble.weighted_vote(df, ["p", "q"], [3, 7]), "p_weighted")[0] == pytest.approx(0.69)
    assert col(ensemble.cascade_proba(df, "q", meta_label="b"), "proba") == [0.9, 0.9]


def test_report_of_an_unpredicted_class(scored):
    out = {r["class"]: r for r in metrics.report(scored.withColumn("z", F.lit(0)), "y", "z").collect()}
    assert out["1"]["precision"] == 0 and out["1"]["support"] == 3 and out["0"]["recall"] == 1


def test_tables(spark, scored):
    m = spark.createDataFrame([("Full Model", 0.5, 0.4, 0.6), ("small", 0.4, 0.5, 0.7), ("failed", 0.0, 0.0, 0.0)], "model string, f1 double, recall double, auc double")
    out = {r["model"]: r for r in explain.ablation_table(m).collect()}
    assert set(out) == {"Full Model", "small"} and out["small"]["delta_f1"] == pytest.approx(-10)
    assert explain.leaderboard(m).filter("best_auc = 1").first()["model"] == "small"
    assert explain.top_true_positive(scored, "y", "p", "id").first()["id"] == 1
    assert explain.top_true_positive(scored.filter("p < 0.5"), "y", "p", "id").first()["hit"] == 0


def test_selectors(spark):
    rows = [([1.0, 5.0, float(i % 2)], i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "features array<double>, target int")
    assert col(select.nonconstant(df), "selected", "pos") == [0, 0, 1]
    assert col(select.fisher_ratio(df), "score", "pos") == [0.0, 0.0, 0.0]  # no spread inside the classes
    assert col(select.chi2_scores(df), "selected", "pos") == [0, 0, 1]
    with pytest.raises(ValueError):
        select.fisher_ratio(df.filter("target = 1"))
    imp = spark.createDataFrame([(0, 0.2), (1, 0.5), (2, 0.5)], "pos int, score double")
    assert col(select.top_k(imp, 1), "selected", "pos") == [0, 1, 0]


def test_adaptive_sampling(spark):
    df = spark.range(100).select("id", (F.col("id") < 10).cast("int").alias("y"))
    n = lambda out: {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert n(sample.adaptive_sample(df, "y", "undersample")) == {0: 10, 1: 10}
    assert n(sample.adaptive_sample(df, "y", "oversample")) == {0: 90, 1: 90}
    assert n(sample.adaptive_sample(df, "y", "hybrid")) == {0: 54, 1: 14}
    assert n(sample.ratio_resample(df, "y", 0.5, 2.0)) == {0: 180, 1: 5}
    with pytest.raises(ValueError):
        sample.adaptive_sample(df, "y", "smote")


def test_same_rows_for_any_partitioning(spark):
    df = spark.range(200).select("id", (F.col("id") % 5 == 0).cast("int").alias("y"))
    ids = lambda f: sorted((r["id"], r["fold"]) for r in sample.fold_ids(f, "y", 4).collect())
    one = ids(df.repartition(1))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert ids(df.repartition(7)) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_csv_with_banner(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("Export of May\nPAY_1,name\n3,\n4,b\n")
    df = io.read_csv(spark, str(p), "PAY_1 int, name string", skip_rows=1, rename={"PAY_1": "PAY_0"})
    assert [tuple(r) for r in df.orderBy("PAY_0").collect()] == [(3, None), (4, "b")]
    q = tmp_path / "y.csv"
    q.write_text("a,b\n1,\n2,x\n")
    assert [tuple(r) for r in io.read_csv(spark, str(q)).orderBy("a").collect()] == [(1, None), (2, "x")]


def test_null_profile_and_describe(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, "x")], "a double, b string")
    assert {r["column"]: r["nulls"] for r in profile.null_profile(df).collect()} == {"a": 0, "b": 1}
    r = profile.describe_cols(df, ["a"]).first()
    assert (r["count"], r["mean"], r["q50"], r["std"]) == (2, 2.0, 2.0, pytest.approx(math.sqrt(2)))


def test_power_lambda_by_likelihood(spark):
    """The root of the slope against a fine search in numpy, a far optimum, NaN, and a constant column."""
    import numpy as np

    from riskframe.operators import scale

    x = np.random.default_rng(3)
    cols = {"skew": np.exp(x.normal(size=300)), "mixed": x.normal(size=300) ** 3, "far": -np.exp(1.2 * x.normal(size=300)) - 1, "flat": np.full(300, 2.5)}
    rows = [tuple(float(v[i]) for v in cols.values()) for i in range(300)] + [(float("nan"), None, float("nan"), 2.5)]
    got = scale.likelihood_lambdas(spark.createDataFrame(rows, "skew double, mixed double, far double, flat double"), list(cols))
    assert got["flat"] == 1.0

    def slope(v, lam, h=1e-4):
        def ll(t):
            with np.errstate(all="ignore"):
                y = np.where(v >= 0, np.log1p(np.abs(v)) if abs(t) < 1e-9 else ((np.abs(v) + 1) ** t - 1) / t, -np.log1p(np.abs(v)) if abs(2 - t) < 1e-9 else -((np.abs(v) + 1) ** (2 - t) - 1) / (2 - t))
            return -len(v) / 2 * np.log(y.var()) + (t - 1) * (np.sign(v) * np.log1p(np.abs(v))).sum()

        return (ll(lam + h) - ll(lam - h)) / (2 * h)

    for c in ("skew", "mixed", "far"):
        assert slope(cols[c], got[c] - 1e-3) > 0 > slope(cols[c], got[c] + 1e-3)
