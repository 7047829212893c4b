"""Splits, folds and class rebalancing. Every random pick is an order by key hash, so it is exact and repeatable."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.exprs import d, hash_hex, hash_int, hash_unit
from riskframe.operators.joins import hot_join
from riskframe.operators.neighbors import knn
from riskframe.operators.ranking import hash_cut, ranked
from riskframe.session import stage

POS_RATIO, NEG_RATIO = 1.4, 0.6  # fixed values: hybrid and ratio resampling


def _counts(df: DataFrame, label: str) -> dict:
    return {r[0]: r[1] for r in df.groupBy(label).agg(F.count("*")).collect()}


def _two(df: DataFrame, label: str) -> tuple[dict, object, object]:
    """Class counts, minority value, majority value (on equal counts the smaller value is the minority)."""
    n = _counts(df, label)
    if len(n) != 2:
        raise ValueError("rebalancing needs exactly two classes")
    lo, hi = sorted(n, key=lambda c: (n[c], c))
    return n, lo, hi


def split(df: DataFrame, frac: float, seed: int = 42, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(train, test) with exactly ceil(n * frac) test rows."""
    one = df.withColumn("__one", F.lit(1))
    keep = hash_cut(one, "__one", {1: math.ceil(df.count() * frac)}, hash_hex(seed, "split", F.col(key)))
    return one.filter(~keep).drop("__one"), one.filter(keep).drop("__one")


def stratified_split(df: DataFrame, label: str, fracs: dict[str, float], seed: int = 42, key: str = "id") -> DataFrame:
    """Add ``part``. Each named share is taken per class, from what the earlier ones left; the rest is ``train``."""
    part = F.lit("train")
    left = df
    conds = []
    for name, frac in fracs.items():
        n = _counts(left, label)
        quota = {c: math.floor(n[c] * frac + 0.5) for c in n}
        keep = hash_cut(left, label, quota, hash_hex(seed, name, F.col(key)))
        conds.append((name, keep))
        left = left.filter(~keep)
    for name, keep in reversed(conds):
        part = F.when(keep, F.lit(name)).otherwise(part)
    return df.withColumn("part", part)


def fold_ids(df: DataFrame, label: str, k: int = 5, seed: int = 42, key: str = "id", out: str = "fold") -> DataFrame:
    """Stratified folds 0..k-1: class rows dealt in key-hash order."""
    r = ranked(df, hash_hex(seed, "fold", F.col(key)), [label], "__rank")
    return r.withColumn(out, ((F.col("__rank") - 1) % k).cast("int")).drop("__rank")


def take(df: DataFrame, label: str, quotas: dict, seed: int, key: str, tag: str = "under") -> DataFrame:
    """Without replacement: exactly ``quotas[c]`` rows of each class, as a filter."""
    return df.filter(hash_cut(df, label, quotas, hash_hex(seed, tag, F.col(key))))


def draw(df: DataFrame, m: int, seed: int, key: str, tag: str = "over") -> DataFrame:
    """With replacement: ``m`` draws, each joined to the row holding the drawn number; ``draw`` is 1..m."""
    n = df.count()
    rows = ranked(df, hash_hex(seed, tag, F.col(key)), (), "__rank")
    spark = df.sparkSession
    picks = spark.range(1, m + 1).select(
        F.col("id").cast("int").alias("draw") if m < 2**31 else F.col("id").alias("draw"),
        (hash_int(seed, tag, "draw", F.col("id")) % n + 1).alias("__rank"),
    )
    return picks.join(rows, "__rank").drop("__rank").select(*df.columns, F.col("draw").cast("bigint").alias("draw"))


def _resample(df: DataFrame, label: str, targets: dict, n: dict, seed: int, key: str, replace: set) -> DataFrame:
    parts = []
    plain = {c: m for c, m in targets.items() if c not in replace}
    if plain:
        rows = df.filter(F.col(label).isin(list(plain)))
        whole = all(plain[c] == n[c] for c in plain)
        parts.append((rows if whole else take(rows, label, plain, seed, key)).withColumn("draw", F.lit(0).cast("bigint")))
    for c in targets:
        if c in replace:
            parts.append(draw(df.filter(F.col(label) == F.lit(c)), targets[c], seed, key))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def undersample(df: DataFrame, label: str, seed: int = 42, key: str = "id") -> DataFrame:
    n = _counts(df, label)
    low = min(n.values())
    return take(df, label, {c: low for c in n}, seed, key)


def adaptive_sample(df: DataFrame, label: str, strategy: str, ratio: float = 1.0, seed: int = 42, key: str = "id") -> DataFrame:
    """``undersample`` the majority to ratio x minority, ``oversample`` the minority to ratio x majority, or
    ``hybrid``: majority x .6 without and minority x 1.4 with replacement. ``draw`` is 0 for kept originals."""
    strategy = strategy.lower()
    n, lo, hi = _two(df, label)
    if strategy == "undersample":
        return _resample(df, label, {lo: n[lo], hi: min(n[hi], int(n[lo] * ratio))}, n, seed, key, set())
    if strategy == "oversample":
        return _resample(df, label, {lo: int(n[hi] * ratio), hi: n[hi]}, n, seed, key, {lo})
    if strategy == "hybrid":
        return _resample(df, label, {lo: int(n[lo] * POS_RATIO), hi: int(n[hi] * NEG_RATIO)}, n, seed, key, {lo})
    raise ValueError(f"unknown strategy {strategy!r}")


def ratio_resample(df: DataFrame, label: str, pos: float = POS_RATIO, neg: float = NEG_RATIO, seed: int = 42, key: str = "id") -> DataFrame:
    """Each class to its own multiple; with replacement exactly where the multiple is not below one."""
    n = _counts(df, label)
    if len(n) != 2:
        raise ValueError("ratio resampling needs exactly two classes")
    low, high = sorted(n)
    targets = {low: int(n[low] * neg), high: int(n[high] * pos)}
    return _resample(df, label, targets, n, seed, key, {c for c in targets if targets[c] >= n[c]})


def _new_key(df: DataFrame, key: str, number: Column) -> Column:
    if isinstance(df.schema[key].dataType, T.StringType):
        return F.concat(F.lit("syn-"), number.cast("string"))
    top = df.agg(F.max(key)).first()[0]
    return (F.lit(top) + number).cast(df.schema[key].dataType)


def _between(a: str, b: str, gap: str) -> Column:
    return F.transform(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b")), lambda z: z["a"] + F.col(gap) * (z["b"] - z["a"]))


def _interpolate(df: DataFrame, rows: DataFrame, nn: DataFrame, picks: DataFrame, label: str, minority, key: str, feat: str) -> DataFrame:
    """``picks`` (base key, rn, gap, number) to synthetic rows on the line from base to neighbour."""
    nbrs = nn.select(F.col("key").alias("__base"), "rn", F.col("nbr").alias("__nbr"))
    base = rows.select(F.col(key).alias("__base"), F.col(feat).alias("__a"))
    other = rows.select(F.col(key).alias("__nbr"), F.col(feat).alias("__b"))
    mixed = picks.join(nbrs, ["__base", "rn"]).join(base, "__base").join(other, "__nbr")
    return mixed.select(
        _new_key(df, key, F.col("__number")).alias(key),
        _between("__a", "__b", "__gap").alias(feat),
        F.lit(minority).cast(df.schema[label].dataType).alias(label),
        F.lit(1).alias("synthetic"),
    )


def _with_originals(df, label, key, feat, made):
    return df.select(key, feat, label, F.lit(0).alias("synthetic")).unionByName(made)


def smote(df: DataFrame, label: str, k: int = 5, seed: int = 42, key: str = "id", feat: str = "features", **nn_args) -> DataFrame:
    """Minority topped up to parity with points between a drawn row and one of its k minority neighbours.

    A single class is returned unchanged. Output: ``key, feat, label, synthetic``.
    """
    n = _counts(df, label)
    if len(n) < 2:
        return df.select(key, feat, label, F.lit(0).alias("synthetic"))
    n, lo, hi = _two(df, label)
    k, want = min(k, n[lo] - 1), n[hi] - n[lo]
    if k < 1 or want < 1:
        return df.select(key, feat, label, F.lit(0).alias("synthetic"))
    rows = df.filter(F.col(label) == F.lit(lo)).select(key, feat)
    nn = knn(rows, rows, k, key, feat, **nn_args)
    u = hash_int(seed, "smote", F.col("id")) % (n[lo] * k)
    picks = df.sparkSession.range(1, want + 1).select(
        F.col("id").alias("__number"),
        (F.floor(u / k) + 1).cast("bigint").alias("__rank"),
        (u % k + 1).cast("int").alias("rn"),
        hash_unit(seed, "gap", F.col("id")).alias("__gap"),
    )
    ranks = ranked(rows.select(F.col(key).alias("__base")), hash_hex(seed, "base", F.col("__base")), (), "__rank")
    made = _interpolate(df, rows, nn, picks.join(ranks, "__rank"), label, lo, key, feat)
    return _with_originals(df, label, key, feat, made)


def adasyn_counts(df: DataFrame, label: str, k: int = 5, key: str = "id", feat: str = "features", **nn_args) -> DataFrame:
    """``(key, ratio, g)``: how many points each minority row contributes, by the majority share around it."""
    n, lo, hi = _two(df, label)
    rows = df.filter(F.col(label) == F.lit(lo)).select(key, feat)
    around = stage(knn(rows, df.select(key, feat), k, key, feat, **nn_args))  # read twice below
    labels = df.select(F.col(key).alias("nbr"), F.col(label).alias("__y"))
    ratio = hot_join(around, labels, "nbr").groupBy("key").agg(F.avg((F.col("__y") != F.lit(lo)).cast("double")).alias("ratio"))
    total = ratio.agg(F.sum("ratio")).first()[0]
    if not total:
        raise ValueError("no minority row has a majority neighbour")
    g = F.bround(F.round(F.col("ratio") / d(total) * d(n[hi] - n[lo]), 6), 0).cast("bigint")
    return ratio.select(F.col("key").alias(key), "ratio", g.alias("g"))


def adasyn(df: DataFrame, label: str, k: int = 5, seed: int = 42, key: str = "id", feat: str = "features", **nn_args) -> DataFrame:
    """More synthetic points where minority rows sit among majority rows. Output as ``smote``."""
    n, lo, hi = _two(df, label)
    k_min = min(k, n[lo] - 1)
    counts = adasyn_counts(df, label, k, key, feat, **nn_args)
    rows = df.filter(F.col(label) == F.lit(lo)).select(key, feat)
    nn = knn(rows, rows, k_min, key, feat, **nn_args)
    each = counts.filter("g > 0").select(F.col(key).alias("__base"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("g"))).alias("__j"))
    picks = ranked(each, hash_hex(seed, "number", F.col("__base"), F.col("__j")), (), "__number").select(
        "__number",
        "__base",
        (hash_int(seed, "nbr", F.col("__base"), F.col("__j")) % k_min + 1).cast("int").alias("rn"),
        hash_unit(seed, "gap", F.col("__base"), F.col("__j")).alias("__gap"),
    )
    made = _interpolate(df, rows, nn, picks, label, lo, key, feat)
    return _with_originals(df, label, key, feat, made)


def find_tomek(df: DataFrame, label: str, key: str = "id", feat: str = "features", **nn_args) -> DataFrame:
    """``(key, nbr, y, y_nbr)``: both directions of every mutual nearest pair of different classes."""
    nn = stage(knn(df, df, 1, key, feat, **nn_args).select("key", "nbr"))  # read twice below
    lab = df.select(F.col(key).alias("key"), F.col(label).alias("y"))
    other = lab.select(F.col("key").alias("nbr"), F.col("y").alias("y_nbr"))
    cross = hot_join(nn, other, "nbr").join(lab, "key").filter("y != y_nbr")
    back = cross.select(F.col("nbr").alias("key"), F.col("key").alias("nbr"))
    return cross.join(back, ["key", "nbr"]).select("key", "nbr", "y", "y_nbr")


def tomek_links(df: DataFrame, label: str, remove: str = "majority", key: str = "id", feat: str = "features", **nn_args) -> DataFrame:
    """Drop the majority member of every link, or both with ``remove='all'``."""
    df = stage(df)  # the neighbour join, the labels and the removal all read it
    if len(_counts(df, label)) < 2:
        return df
    links = find_tomek(df, label, key, feat, **nn_args)
    if remove == "majority":
        links = links.filter(F.col("y") == F.lit(_two(df, label)[2]))
    elif remove != "all":
        raise ValueError("remove is 'majority' or 'all'")
    return df.join(links.select(F.col("key").alias(key)), key, "left_anti")


def edited_nn(df: DataFrame, label: str, k: int = 3, key: str = "id", feat: str = "features", **nn_args) -> DataFrame:
    """Drop every row that one of its k neighbours disagrees with."""
    df = stage(df)  # the neighbour join, the labels and the removal all read it
    nn = stage(knn(df, df, k, key, feat, **nn_args))  # read twice below
    lab = df.select(F.col(key).alias("key"), F.col(label).alias("y"))
    other = lab.select(F.col("key").alias("nbr"), F.col("y").alias("z"))
    bad = hot_join(nn, other, "nbr").join(lab, "key").filter("y != z").select(F.col("key").alias(key)).distinct()
    return df.join(bad, key, "left_anti")


def smote_tomek(df: DataFrame, label: str, k: int = 5, seed: int = 42, key: str = "id", feat: str = "features", remove: str = "majority", **nn_args):
    grown = smote(df, label, k, seed, key, feat, **nn_args)
    return tomek_links(grown, label, remove, key, feat, **nn_args)


def smote_enn(df: DataFrame, label: str, k: int = 5, seed: int = 42, key: str = "id", feat: str = "features", k_edit: int = 3, **nn_args):
    return edited_nn(smote(df, label, k, seed, key, feat, **nn_args), label, k_edit, key, feat, **nn_args)


def adasyn_tomek(df: DataFrame, label: str, k: int = 5, seed: int = 42, key: str = "id", feat: str = "features", remove: str = "all", **nn_args):
    return tomek_links(adasyn(df, label, k, seed, key, feat, **nn_args), label, remove, key, feat, **nn_args)


def quality_filter(gen: DataFrame, orig: DataFrame, k: int = 5, max_dist: float = 0.95, key: str = "id", feat: str = "features", **nn_args) -> DataFrame:
    """Generated rows whose mean distance to their k nearest originals is below ``max_dist``."""
    gen = stage(gen)  # counted, matched and joined
    mean = knn(gen, orig, k, key, feat, exclude_self=False, **nn_args).groupBy("key").agg(F.avg("dist").alias("mean_dist"))
    return gen.join(mean.filter(F.col("mean_dist") < d(max_dist)).withColumnRenamed("key", key), key)


def noise_views(df: DataFrame, scale: float = 0.1, seed: int = 42, key: str = "id", feat: str = "features", views: int = 2) -> DataFrame:
    """Copies of every row with Gaussian noise (Box-Muller from the key hash): ``view_1``, ``view_2`` ..."""

    def noisy(v):
        def one(x, i):
            h = hash_hex(seed, f"view{v}", F.col(key), i)
            u1 = (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + d(1)) / d(2**32)
            u2 = F.conv(F.substring(h, 9, 8), 16, 10).cast("double") / d(2**32)
            return x + d(scale) * F.sqrt(d(-2) * F.log(u1)) * F.cos(d(2 * math.pi) * u2)

        return F.transform(feat, one)

    return df.withColumns({f"view_{v}": noisy(v) for v in range(1, views + 1)})


def class_weights(df: DataFrame, label: str, mode: str = "balanced", out: str = "weight") -> DataFrame:
    """``balanced``: n / (classes * n_c); ``double_positive``: 2 for positives; ``pos_weight``: n / positives."""
    if mode == "double_positive":
        return df.withColumn(out, F.when(F.col(label) == 1, d(2)).otherwise(d(1)))
    n = _counts(df, label)
    total = sum(n.values())
    if mode == "balanced":
        w = {c: total / (len(n) * m) for c, m in n.items()}
    elif mode == "pos_weight":
        w = {1: total / n[1], 0: 1.0}
    else:
        raise ValueError(f"unknown mode {mode!r}")
    weight = F.lit(None).cast("double")
    for c, v in w.items():
        weight = F.when(F.col(label) == F.lit(c), d(v)).otherwise(weight)
    return df.withColumn(out, weight)


def append_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def shuffle(df: DataFrame, seed: int = 42, key: str = "id") -> DataFrame:
    return df.orderBy(hash_hex(seed, "shuffle", F.col(key)))
