"""Clusters, local outlier factor, isolation forest."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.exprs import d
from riskframe.operators.components import components
from riskframe.operators.joins import hot_join
from riskframe.operators.neighbors import _matrix, _pair_distance, assign, block_pairs, knn, make_cells, measure, radius_visits
from riskframe.operators.profile import vector_summary
from riskframe.operators.quantiles import quantiles
from riskframe.operators.ranking import running_totals
from riskframe.session import stage

TILE = 2048  # rows a side whose distances are held at once


def fit_kmeans(df: DataFrame, k: int, seed: int = 42, max_iter: int = 300, tol: float = 1e-4, col: str = "features") -> list[list[float]]:
    """Centres from k-means|| seeding (the distributed form of squared-distance seeding) and Lloyd iterations."""
    model = KMeans(k=k, seed=seed, maxIter=max_iter, tol=tol, initMode="k-means||", featuresCol="__v", predictionCol="__c").fit(
        df.select(array_to_vector(F.col(col)).alias("__v"))
    )
    return [c.tolist() for c in model.clusterCenters()]


def kmeans_features(df: DataFrame, centers: list[list[float]], col: str = "features") -> DataFrame:
    """Distance to every centre (``centre_dist``) and the nearest one (``cluster``, lowest number on ties)."""
    c = np.asarray(centers, dtype=np.float64)

    @F.pandas_udf("array<double>")
    def dist(x: pd.Series) -> pd.Series:
        m = _matrix(x)
        return pd.Series(list(np.sqrt(np.stack([((m - p) ** 2).sum(axis=1) for p in c], axis=1))) if len(m) else [])

    out = df.withColumn("centre_dist", dist(F.col(col)))
    near = F.array_position("centre_dist", F.array_min("centre_dist")) - 1
    return out.withColumn("cluster", near.cast("int"))


def lloyd_step(df: DataFrame, centers: list[list[float]], col: str = "features") -> DataFrame:
    """One assignment and update: ``(cluster, n, center)``; an empty cluster keeps its old centre."""
    new = vector_summary(kmeans_features(df, centers, col), ["cluster"], col).select("cluster", "n", F.col("mean").alias("center"))
    old = df.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centers)], "cluster int, old array<double>")
    return old.join(new, "cluster", "left").select("cluster", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("center", "old").alias("center"))


def _connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Smallest node per component of every node."""
    roots = components(edges, "a", "b").select(F.col("node").alias("v"), "root")
    return stage(nodes.join(roots, "v", "left").select("v", F.coalesce("root", "v").alias("c")))


def _block_components(adj: np.ndarray):
    """Component number of each left and right row of one block pair (0/1 adjacency), by label spreading along its links."""
    nl, nr = adj.shape
    left, right = np.arange(nl), np.arange(nl, nl + nr)
    i, j = np.nonzero(adj)
    while len(i):
        nl_, nr_ = left.copy(), right.copy()
        np.minimum.at(nl_, i, right[j])
        np.minimum.at(nr_, j, nl_[i])
        if (nl_ == left).all() and (nr_ == right).all():
            break
        left, right = nl_, nr_
    return left, right


def _within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """a x b mask of distances (nine decimals) <= eps. The matrix product decides only what rounding cannot turn."""
    a2, b2 = (a * a).sum(axis=1), (b * b).sum(axis=1)
    g = a2[:, None] + b2[None, :] - 2.0 * (a @ b.T)
    reach = 1e-11 * (a2 + b2.max(initial=0.0) + 1.0)[:, None]
    out = g <= max(eps - 2e-9, 0.0) ** 2 - reach
    i, j = np.nonzero((g <= (eps + 2e-9) ** 2 + reach) & ~out)
    for s in range(0, len(i), 65536):
        p, q = i[s : s + 65536], j[s : s + 65536]
        out[p, q] = _pair_distance(a[p], b[q]) <= eps
    return out


def _tiles(l: pd.DataFrame, r: pd.DataFrame, eps: float):
    """(left rows, right rows, who is within ``eps``) of a block pair, in tiles that bound the temporary memory."""
    x, y = _matrix(l["f"]), _matrix(r["f"])
    for s in range(0, len(l), TILE):
        for t in range(0, len(r), TILE):
            yield slice(s, s + TILE), slice(t, t + TILE), _within(x[s : s + TILE], y[t : t + TILE], eps)


def density_clusters(df: DataFrame, eps: float, min_samples: int = 5, key: str = "id", feat: str = "features", block_rows: int = 8192) -> DataFrame:
    """``(key, cluster, core)``: density clusters numbered by their smallest core key, noise is -1.

    No pair list is built: block pairs return neighbour counts, then only a spanning forest of the core
    graph (at most one edge per row and block pair), which is connected by distributed label merging.
    A border row joins the lowest-numbered cluster in reach.
    """
    rows = df.select(F.col(key).alias("key"), F.col(feat).cast("array<double>").alias("f"))
    key_type = rows.schema["key"].dataType
    weight = rows.groupBy("f").agg(F.count("*").alias("w"), F.min("key").alias("vid"))
    folded = stage(weight.select("vid", "f", "w"))
    cells = make_cells(folded, folded.count())
    placed = stage(assign(folded, cells))
    measure(cells, placed)
    lefts = folded.select(F.col("vid").alias("lid"), "f")
    visits = stage(radius_visits(lefts, cells, eps))

    def count(l, r):
        if not len(l) or not len(r):
            return pd.DataFrame({"lid": l["lid"][:0], "n": np.zeros(0, dtype=np.int64)})
        n, w = np.zeros(len(l), dtype=np.int64), r["w"].to_numpy()
        for s, t, near in _tiles(l, r, eps):
            n[s] += near @ w[t]
        return pd.DataFrame({"lid": l["lid"], "n": n})

    counts = block_pairs(visits, placed, cells, block_rows).applyInPandas(count, T.StructType().add("lid", key_type).add("n", T.LongType()))
    state = stage(counts.groupBy("lid").agg((F.sum("n") >= min_samples).cast("int").alias("core")))
    core_placed = stage(placed.join(state.filter("core = 1").select(F.col("lid").alias("vid")), "vid", "left_semi"))
    flagged = stage(visits.join(state, "lid").select("lid", "f", "core", "cells"))
    pair = T.StructType().add("a", key_type).add("b", key_type).add("border", T.IntegerType())

    def forest(l, r):
        if not len(l) or not len(r):
            return pd.DataFrame({"a": l["lid"][:0], "b": l["lid"][:0], "border": np.zeros(0, dtype=np.int32)})
        lids, vids, cores = l["lid"].to_numpy(), r["vid"].to_numpy(), l["core"].to_numpy() == 1
        out = []
        for s, t, adj in _tiles(l, r, eps):
            lk, rk, core = lids[s], vids[t], cores[s]
            left, right = _block_components(adj[core])
            a = np.concatenate([lk[core], rk])
            b = np.concatenate([a[left], a[right]])
            out.append(pd.DataFrame({"a": a[a != b], "b": b[a != b], "border": 0}))
            # a border row needs one representative per component it touches
            i, j = np.nonzero(adj[~core])
            i, head = np.unique(np.stack([i, right[j]]), axis=1) if len(i) else (i, j)
            out.append(pd.DataFrame({"a": lk[~core][i], "b": a[head], "border": 1}))
        return pd.concat(out).astype({"border": np.int32})

    links = stage(block_pairs(flagged, core_placed, cells, block_rows).applyInPandas(forest, pair))
    nodes = state.filter("core = 1").select(F.col("lid").alias("v"))
    comp = _connected(links.filter("border = 0").select("a", "b"), nodes)
    heads = comp.select(F.col("c").alias("head")).distinct().withColumn("one", F.lit(1))
    number = running_totals(heads, "head", ["one"]).select(F.col("head").alias("c"), (F.col("cum_one") - 1).cast("bigint").alias("cluster"))
    named = comp.join(number, "c").select("v", "cluster")
    border = (
        links.filter("border = 1").join(named.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("cluster").alias("cluster"))
    )
    by_vec = named.withColumn("core", F.lit(1)).unionByName(border.withColumn("core", F.lit(0)))
    vec = folded.select(F.col("vid").alias("v"), "f").join(by_vec, "v", "left").select("f", "cluster", "core")
    return rows.join(vec, "f").select(
        F.col("key").alias(key), F.coalesce("cluster", F.lit(-1)).cast("bigint").alias("cluster"), F.coalesce("core", F.lit(0)).alias("core")
    )


@dataclass
class Density:
    """What the outlier factor of new rows needs: the fitted rows, their k-distance and local density."""

    rows: DataFrame  # key, features
    around: DataFrame  # key, kd, lrd
    k: int


def fit_lof(df: DataFrame, k: int = 20, key: str = "id", feat: str = "features", **nn_args) -> Density:
    rows = stage(df.select(key, feat))  # read several times here and by every scoring
    nn = stage(knn(rows, rows, k, key, feat, **nn_args))
    kdist = nn.groupBy(F.col("key").alias("nbr")).agg(F.max("dist").alias("kd"))
    reach = hot_join(nn, kdist, "nbr").groupBy("key").agg(F.avg(F.greatest("kd", "dist")).alias("r"))
    density = reach.select("key", (d(1) / (F.col("r") + d(1e-10))).alias("lrd"))
    return Density(rows, stage(density.join(kdist.withColumnRenamed("nbr", "key"), "key").select("key", "kd", "lrd")), k)


def score_lof(df: DataFrame, fitted: Density, key: str = "id", feat: str = "features", **nn_args) -> DataFrame:
    """``(key, lof)`` of rows that were not fitted, against the fitted ones."""
    nn = stage(knn(stage(df.select(key, feat)), fitted.rows, fitted.k, key, feat, exclude_self=False, **nn_args))
    near = hot_join(nn, fitted.around.select(F.col("key").alias("nbr"), "kd", "lrd"), "nbr")
    own = near.groupBy("key").agg(F.avg(F.greatest("kd", "dist")).alias("r"), F.avg("lrd").alias("nl"))
    return own.select(F.col("key").alias(key), (F.col("nl") * (F.col("r") + d(1e-10))).alias("lof"))


def lof(df: DataFrame, k: int = 20, key: str = "id", feat: str = "features", **nn_args) -> DataFrame:
    """``(key, lof)``: mean neighbour density over own density; about 1 inside clusters, larger for outliers."""
    nn = stage(knn(df, df, k, key, feat, **nn_args))
    kdist = nn.groupBy(F.col("key").alias("nbr")).agg(F.max("dist").alias("kd"))
    reach = hot_join(nn, kdist, "nbr").groupBy("key").agg(F.avg(F.greatest("kd", "dist")).alias("r"))
    lrd = stage(reach.select("key", (d(1) / (F.col("r") + d(1e-10))).alias("lrd")))
    around = hot_join(nn, lrd.select(F.col("key").alias("nbr"), F.col("lrd").alias("nl")), "nbr").groupBy("key").agg(F.avg("nl").alias("nl"))
    return around.join(lrd, "key").select(F.col("key").alias(key), (F.col("nl") / F.col("lrd")).alias("lof"))


def _path_constant(n: float) -> float:
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def fit_isolation(
    df: DataFrame, trees: int = 100, sample: int = 256, seed: int = 42, contamination: float = 0.1, key: str = "id", feat: str = "features"
) -> dict:
    """Random trees, each grown inside one task on its own hash-drawn sample of at most ``sample`` rows.

    A row decides from its key hash which trees want it, so the table is read once and only about
    ``trees * sample`` rows are shuffled, however large it is.
    """
    n = df.count()
    sample = min(sample, n)
    limit = min(1.0, 2.0 * sample / n)
    h = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(F.lit(seed), t, F.col(key)).alias("h")))
    edge = min(2**63 - 1, int(-(2**63) + limit * 2**64))
    picked = df.select(F.col(feat).cast("array<double>").alias("f"), F.explode(F.filter(h, lambda s: s["h"] <= F.lit(edge))).alias("s"))
    rank = F.row_number().over(Window.partitionBy("s.tree").orderBy("s.h"))
    rows = picked.withColumn("r", rank).filter(F.col("r") <= sample).select(F.col("s.tree").alias("tree"), "f")
    depth = max(1, math.ceil(math.log2(max(2, sample))))

    def grow(tree, pdf):
        x = _matrix(pdf["f"])
        rng = np.random.default_rng(seed * 100003 + int(tree[0]))
        nodes: list = []

        def node(idx, level):
            me = len(nodes)
            nodes.append([-1, 0.0, -1, -1, level + _path_constant(len(idx))])
            if level < depth and len(idx) > 1:
                lo, hi = x[idx].min(axis=0), x[idx].max(axis=0)
                can = np.nonzero(hi > lo)[0]
                if len(can):
                    j = int(rng.choice(can))
                    cut = float(rng.uniform(lo[j], hi[j]))
                    low = x[idx, j] <= cut
                    nodes[me][0], nodes[me][1] = j, cut
                    nodes[me][2] = node(idx[low], level + 1)
                    nodes[me][3] = node(idx[~low], level + 1)
            return me

        node(np.arange(len(x)), 0)
        a = np.array(nodes)
        return pd.DataFrame({"tree": [tree[0]], **{c: [a[:, i].tolist()] for i, c in enumerate(("feat", "cut", "low", "high", "path"))}})

    schema = "tree int, feat array<double>, cut array<double>, low array<double>, high array<double>, path array<double>"
    grown = rows.groupBy("tree").applyInPandas(grow, schema).collect()  # trees x at most 2 * sample nodes
    model = {"trees": [[r["feat"], r["cut"], r["low"], r["high"], r["path"]] for r in sorted(grown, key=lambda r: r["tree"])], "scale": _path_constant(sample)}
    model["offset"] = 0.0
    scored = stage(apply_isolation(df, model, feat).select("anomaly"))  # quantiles read it three times
    model["offset"] = -quantiles(scored, ["anomaly"], [1 - contamination])["anomaly"][0]
    return model


def apply_isolation(df: DataFrame, model: dict, feat: str = "features") -> DataFrame:
    """``anomaly`` in (0, 1], high for outliers, and ``decision`` = -anomaly - offset, negative for outliers."""
    forest = [tuple(np.asarray(a) for a in t) for t in model["trees"]]
    scale = model["scale"] or 1.0

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        m = _matrix(x)
        total = np.zeros(len(m))
        for feat_, cut, low, high, path in forest:
            at = np.zeros(len(m), dtype=np.int64)
            while True:
                f = feat_[at].astype(np.int64)
                inner = f >= 0
                if not inner.any():
                    break
                v = m[np.arange(len(m)), np.maximum(f, 0)]
                at = np.where(inner, np.where(v <= cut[at], low[at], high[at]).astype(np.int64), at)
            total += path[at]
        return pd.Series(2.0 ** (-(total / len(forest)) / scale))

    return df.withColumn("anomaly", score(F.col(feat))).withColumn("decision", -F.col("anomaly") - d(model["offset"]))
