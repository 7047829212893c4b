"""Hot keys and components against plain Python."""

import random
from collections import Counter

import pytest

from riskframe.operators import components as cc
from riskframe.operators.components import components
from riskframe.operators.joins import hot_join, hot_keys


def _rows(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_join_equals_join(spark, how):
    rows = [("hot" if i % 3 == 0 else None if i % 50 == 7 else f"k{i % 97}", i) for i in range(3000)]
    left = spark.createDataFrame(rows, "k string, i int").repartition(6)
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k5", 3), (None, 4), ("none", 5)], "k string, x int")
    assert [r.k for r in hot_keys(left, ["k"], 3000, 20).filter("k IS NOT NULL").collect()] == ["hot"]
    assert _rows(hot_join(left, right, "k", how, 20)) == _rows(left.join(right, "k", how))


def test_hot_join_keeps_hot_rows_out_of_the_shuffle(spark):
    """Below the broadcast threshold nothing is shuffled anyway, so it is switched off here."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(8000).selectExpr("if(id % 3 = 0, 1, id) AS k", "id")
        right = spark.range(8000).selectExpr("id AS k", "id * 2 AS x")
        out = hot_join(left, right, "k", "inner", 20)
        sizes = [r["count"] for r in out.selectExpr("k", "spark_partition_id() AS p").filter("k <> 1").groupBy("p").count().collect()]
        assert out.count() == 8000 and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_hot_join_on_two_columns(spark):
    left = spark.createDataFrame([(1, "a", i) for i in range(200)] + [(i, "b", i) for i in range(200)] + [(None, "a", 0), (1, None, 0)], "x int, y string, i int")
    right = spark.createDataFrame([(1, "a", 5.0), (3, "b", 6.0), (None, "a", 7.0)], "x int, y string, z double")
    for how in ("inner", "left"):
        assert _rows(hot_join(left, right, ["x", "y"], how, 10)) == _rows(left.join(right, ["x", "y"], how))
    with pytest.raises(ValueError):
        hot_join(left, right, "x", "outer")


def _brute(edges):
    up = {}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            up.setdefault(a, a), up.setdefault(b, b)
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {n: top(n) for n in up}


@pytest.mark.parametrize("least", [2, 100])
def test_components(spark, monkeypatch, least):
    monkeypatch.setattr(cc, "LEAST", least)
    pick = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (202, 201), (7777, 7777), (None, 1), (5, None)]
    edges += [(1000 + pick.randrange(300), 1000 + pick.randrange(300)) for _ in range(200)]
    out = components(spark.createDataFrame(edges, "a long, b long").repartition(4), "a", "b").collect()
    assert {r.node: r.root for r in out} == _brute(edges) and len(out) == len(_brute(edges))
    names = [(f"n{a}", f"n{b}") for a, b in edges if a is not None and b is not None]
    out = components(spark.createDataFrame(names, "a string, b string"), "a", "b").collect()
    assert {r.node: r.root for r in out} == _brute(names)
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_long_chain_ends_in_few_rounds(spark, monkeypatch):
    rounds = []
    staged = cc._staged
    monkeypatch.setattr(cc, "_staged", lambda e: rounds.append(1) or staged(e))
    order = list(range(10_000))
    random.Random(1).shuffle(order)
    chain = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    star = spark.createDataFrame([(20_000, 20_000 + i) for i in range(1, 5000)], "a long, b long")
    out = components(chain.unionByName(star), "a", "b")
    assert {(r.root, r["count"]) for r in out.groupBy("root").count().collect()} == {(0, 10_000), (20_000, 5000)}
    assert len(rounds) <= 16


def test_components_leave_the_session_fit_for_model_summaries(spark):
    from riskframe.models.base import fit_model

    components(spark.createDataFrame([(2, 1), (3, 2)], "a long, b long"), "a", "b").collect()
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 3)], int(i % 7 > 3)) for i in range(40)], "id long, features array<double>, target int")
    for kind, params in (("logreg", {}), ("linsvc", {}), ("rf", {"trees": 2, "depth": 2})):
        assert len(fit_model(rows, "target", kind, params).score(rows).select("p").collect()) == 40


def _chain_and_star(spark):
    """Chains of 41 nodes and a star of 300 leaves, shuffled over a few partitions."""
    edges = [(c * 100 + i, c * 100 + i + 1) for c in range(5) for i in range(40)] + [(1000, 1001 + i) for i in range(300)]
    return spark.createDataFrame(edges, "a long, b long").repartition(4), {n: e[0] // 100 * 100 if e[0] < 1000 else 1000 for e in edges for n in e}


def test_few_edges_take_one_task(spark, monkeypatch):
    edges, want = _chain_and_star(spark)
    written = []
    monkeypatch.setattr(cc, "stage", lambda df, real=cc.stage: written.append(df.rdd.getNumPartitions()) or real(df))
    names = {"spark.sql.shuffle.partitions": "37", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        got = {r.node: r.root for r in cc.components(edges, "a", "b").collect()}
    finally:
        for n, v in old.items():
            spark.conf.set(n, v)
    assert got == want and len(written) > 2 and set(written[1:]) == {1}


def test_many_edges_stay_dealt_out(spark, monkeypatch):
    from riskframe.operators import joins

    edges, want = _chain_and_star(spark)
    monkeypatch.setattr(joins, "EACH", 20)  # hot nodes and several tasks
    handed = []
    monkeypatch.setattr(cc, "_handed", lambda e, low, limit, total, real=cc._handed: handed.append(total > limit) or real(e, low, limit, total))
    assert {r.node: r.root for r in cc.components(edges, "a", "b").collect()} == want
    assert any(handed)


def test_fitted_models_score_in_ensembles_after_components(spark):
    """The models that keep a training summary, inside the ensembles, in a session where components ran."""
    from riskframe.models import ensembles

    components(spark.createDataFrame([(2, 1), (3, 2)], "a long, b long"), "a", "b").collect()
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 3)], int(i % 7 > 3)) for i in range(60)], "id long, features array<double>, target int")
    base = [("logreg", {}), ("tree", {"depth": 2})]
    assert len(ensembles.fit_stacking(rows, "target", base, folds=2).score(rows).select("p").collect()) == 60
