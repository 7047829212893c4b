"""Global order without a single-task window, against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.functions.exprs import hash_hex
from riskframe.operators import quantiles as Q
from riskframe.operators import ranking


def digest(i, tag="t"):
    return hashlib.md5(f"{tag}|{i}".encode()).hexdigest()


@pytest.mark.parametrize("take", [20_000, 3])
def test_hash_cut_is_exact(spark, monkeypatch, take):
    monkeypatch.setattr(ranking, "TAKE", take)
    monkeypatch.setattr(ranking, "STEP", 1)
    df = spark.range(500).select("id", (F.col("id") % 3 == 0).cast("int").alias("c"))
    keep = ranking.hash_cut(df, "c", {0: 17, 1: 100}, hash_hex("t", F.col("id")))
    got = {r["id"] for r in df.filter(keep).collect()}
    want = set()
    for c, m in ((0, 17), (1, 100)):
        ids = sorted((i for i in range(500) if (i % 3 == 0) == bool(c)), key=digest)
        want |= set(ids[:m])
    assert got == want


def test_hash_cut_limits(spark):
    df = spark.range(10).select("id", F.lit(1).alias("c"))
    assert df.filter(ranking.hash_cut(df, "c", {1: 0}, hash_hex("t", F.col("id")))).count() == 0
    assert df.filter(ranking.hash_cut(df, "c", {1: 99}, hash_hex("t", F.col("id")))).count() == 10


def test_ranked(spark):
    df = spark.range(300).select("id", (F.col("id") % 2).alias("c"))
    got = {r["id"]: r["rank"] for r in ranking.ranked(df, hash_hex("t", F.col("id")), ["c"]).collect()}
    for c in (0, 1):
        ids = sorted(range(c, 300, 2), key=digest)
        assert [got[i] for i in ids] == list(range(1, 151))


@pytest.mark.parametrize("parts", [1, 7, 64])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, parts, descending):
    rng = random.Random(1)
    data = [(float(v), rng.randint(0, 9)) for v in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(data, "x double, n long")
    got = {r["x"]: r["cum_n"] for r in ranking.running_totals(df, "x", ["n"], descending=descending, parts=parts).collect()}
    total, want = 0, {}
    for x, n in sorted(data, reverse=descending):
        total += n
        want[x] = total
    assert got == want


def test_running_totals_on_strings(spark):
    words = ["b", "a", "ä", "Z", "zz", ""]
    df = spark.createDataFrame([(w, 1) for w in words], "x string, n long")
    got = [r["x"] for r in ranking.running_totals(df, "x", ["n"], parts=4).orderBy("cum_n").collect()]
    assert got == sorted(words)


@pytest.mark.parametrize("small", [5, 40, 50_000])
def test_quantiles_bracketing(spark, small):
    rng = np.random.default_rng(3)
    x, ties = rng.normal(size=2000), rng.integers(0, 4, size=2000).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(a) if i % 5 else None) for i, (a, b) in enumerate(zip(x, ties))], "x double, t double, n double").repartition(4)
    qs = [0.0, 0.05, 0.25, 0.5, 0.8, 1.0]
    got = Q.quantiles(df, ["x", "t", "n"], qs, small=small)
    assert np.allclose(got["x"], np.quantile(x, qs), atol=1e-12)
    assert np.allclose(got["t"], np.quantile(ties, qs))
    assert np.allclose(got["n"], np.quantile(x[np.arange(2000) % 5 != 0], qs), atol=1e-12)


def test_quantiles_of_two_heavy_values(spark):
    df = spark.createDataFrame([(1.0,)] * 60 + [(2.0,)] * 61 + [(3.0,)], "x double")
    assert Q.quantiles(df, ["x"], [0.25, 0.5, 0.75], small=10)["x"] == [1.0, 2.0, 2.0]


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert Q.quantiles(df, ["x"], [0.5])["x"] == [None]
    assert Q.quantiles(df, ["x"], [0.5], small=0)["x"] == [None]
