"""Missing values."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.exprs import d, missing
from riskframe.functions.exprs import value as number
from riskframe.operators.boxes import make_boxes
from riskframe.operators.fitted import Fitted
from riskframe.operators.neighbors import BLOCK_ROWS, BROADCAST_BYTES, DIGITS, SLICE, _key_order, _marked, meet
from riskframe.operators.quantiles import quantiles
from riskframe.operators.schema import pad_or_truncate
from riskframe.session import stage

LEAF_ROWS = 1024  # donors of one box
TASK_BOUNDS = 5_000_000  # bounds of a row and a box that one task works out
PAIRS = 400_000_000  # of rows with a gap and donors that may meet in a broadcast


def fit_impute(df: DataFrame, cols: list[str], strategy: str = "mean", value=None, accuracy: int | None = None) -> Fitted:
    """Fill value per column: mean, median or a constant. NaN is missing, like null."""
    if strategy == "mean":
        row = df.agg(*[F.avg(number(c)).alias(c) for c in cols]).first()
        fill = {c: row[c] for c in cols}
    elif strategy == "median":
        fill = {c: v[0] for c, v in quantiles(df, cols, [0.5], accuracy).items()}
    elif strategy == "constant":
        fill = {c: value for c in cols}
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return Fitted("impute", {c: {"fill": v} for c, v in fill.items()}, {"strategy": strategy})


def apply_impute(df: DataFrame, params: Fitted) -> DataFrame:
    def fill(c, v):
        if v is None:  # nothing was seen at fit time
            return F.col(c)
        return F.when(missing(df, c), F.lit(v) if isinstance(v, str) else d(v)).otherwise(F.col(c))

    return df.withColumns({c: fill(c, p["fill"]) for c, p in params.cols.items() if c in df.columns})


def impute_vectors(c: Column, n: int) -> Column:
    """Null, empty or all-NaN vectors become zeros; others are padded or cut to ``n``, single NaN kept."""
    bad = c.isNull() | (F.size(c) == 0) | F.forall(c, lambda x: x.isNull() | F.isnan(x))
    return F.when(bad, F.array_repeat(d(0), n)).otherwise(pad_or_truncate(c, n))


def _nearest_of(li, rj, c, bound, x0, y0, has_x, has_y, order, k):
    """The k nearest of the pre-selected pairs of one column, measured exactly."""
    dist = np.empty(len(li))
    for a in range(0, len(li), 65536):
        p, q = li[a : a + 65536], rj[a : a + 65536]
        both = has_x[p] & has_y[q]
        e = np.where(both, x0[p] - y0[q], 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            dist[a : a + 65536] = np.sqrt((e * e).sum(axis=1) * x0.shape[1] / both.sum(axis=1))
    dist = np.round(dist, DIGITS)
    if bound is not None:
        near = dist <= bound[li, c]  # nothing shared: no number
        li, rj, dist = li[near], rj[near], dist[near]
    o = np.lexsort((order[rj], dist, li))
    li, rj, dist = li[o], rj[o], dist[o]
    keep = np.arange(len(li)) - np.searchsorted(li, li, side="left") < k
    return li[keep], np.full(keep.sum(), c), rj[keep], dist[keep]


def masked_nearest(x: np.ndarray, y: np.ndarray, order: np.ndarray, k: int, bound: np.ndarray | None = None):
    """(row, column, donor, distance): for every missing cell of ``x`` its k nearest rows of ``y`` that hold the column. With ``bound``
    (rows x columns), only those that are no farther.

    Squared distance and number of shared coordinates of all pairs are two matrix products over zero-filled values and
    masks; they only pre-select, and what is within rounding reach of the k-th distance is measured again.
    """
    width = x.shape[1]
    has_x, has_y = ~np.isnan(x), ~np.isnan(y)
    x0, y0 = np.where(has_x, x, 0.0), np.where(has_y, y, 0.0)
    mx, my = has_x.astype(np.float64), has_y.astype(np.float64)
    y2 = (y0 * y0).sum(axis=1).max(initial=0.0)
    mine, theirs = np.hstack([x0**2, mx, -2.0 * x0]), np.hstack([my, y0**2, y0])
    found: list[tuple] = []
    for c in range(width):
        rows, donors = np.nonzero(~has_x[:, c])[0], np.nonzero(has_y[:, c])[0]
        if not len(rows) or not len(donors):
            continue
        held, known = theirs[donors].T.copy(), my[donors].T.copy()
        step = max(1, 1_000_000 // len(donors))
        for s in range(0, len(rows), step):
            r = rows[s : s + step]
            g, shared = mine[r] @ held, mx[r] @ known
            g *= width
            with np.errstate(divide="ignore", invalid="ignore"):
                g /= shared
            g[shared == 0] = np.inf
            slack = 1e-11 * width * ((x0[r] ** 2).sum(axis=1) + y2 + 1.0)
            top = np.full(len(r), np.finfo(np.float64).max)
            if len(donors) > k:
                kth = np.maximum(np.partition(g, k - 1, axis=1)[:, k - 1], 0.0)
                top = np.minimum(top, kth + slack + 4e-9 * np.sqrt(kth) + 1e-17)
            if bound is not None:
                top = np.minimum(top, (np.minimum(bound[r, c], 1e100) + 1e-9) ** 2 + slack)
            i, j = _marked(g <= top[:, None])
            found.append(_nearest_of(r[i], donors[j], c, bound, x0, y0, has_x, has_y, order, k))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0)
    return tuple(np.concatenate(z) for z in zip(*found))


def knn_impute(
    df: DataFrame, donors: DataFrame, cols: list[str], k: int = 5, key: str = "id", broadcast_bytes: int = BROADCAST_BYTES, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Fill each missing cell (null or NaN) with the mean of its k nearest donors that hold the value.

    Distance skips coordinates missing on either side: ``sqrt(D / m * sum of squares over the m shared)``; ties go by key.
    A cell without any comparable donor gets the donors' column mean, without any value there it becomes null. Donors up to
    ``broadcast_bytes`` go to every task while there are few pairs; beyond, donors are cut into boxes and a row with a gap meets
    only those that can hold one of its k nearest, in block pairs of at most about ``block_rows`` rows a side, and only the k
    best of each cell leave a pair. Both run the same kernel.
    """
    rows = stage(df.select(key, *[number(c).alias(c) for c in cols]))
    give = rows if donors is df else stage(donors.select(key, *[number(c).alias(c) for c in cols]))
    held = give.agg(F.count("*").alias("__n"), *[F.avg(c).alias(c) for c in cols]).first()
    gap = F.greatest(*[F.col(c).isNull() for c in cols]) if len(cols) > 1 else F.col(cols[0]).isNull()
    open_ = rows.filter(gap)
    if held["__n"] * len(cols) * 8 <= broadcast_bytes and open_.count() * held["__n"] <= PAIRS:
        filled = _knn_impute_small(rows, give, cols, k, key)
        return df.drop(*cols).join(filled, key).select(df.columns)
    best = _knn_impute_boxes(open_, give, cols, k, key, block_rows)
    means = best.groupBy("key").agg(*[F.avg(F.when(F.col("c") == i, F.col("v"))).alias(f"__{c}") for i, c in enumerate(cols)])
    out = df.join(means.withColumnRenamed("key", key), key, "left")
    last = {c: F.lit(held[c]).cast("double") for c in cols}
    return out.withColumns({c: F.coalesce(number(c), F.col(f"__{c}"), last[c]) for c in cols}).select(df.columns)


def _knn_impute_boxes(open_: DataFrame, give: DataFrame, cols: list[str], k: int, key: str, block_rows: int) -> DataFrame:
    """``(key, c, nbr, dist, v)``: the k nearest donors of every missing cell, found block by block.

    Equal rows are one row, equal donors the k first of them. A row first meets the blocks nearest to it, which bounds the
    distance of the k-th donor of each column, then every block whose box lies within a bound.
    """
    first = F.row_number().over(Window.partitionBy(*cols).orderBy(key))
    donors = stage(give.withColumn("__r", first).filter(F.col("__r") <= k).select(F.col(key).alias("vid"), *cols))
    boxes = make_boxes(donors, donors.count(), cols, [F.xxhash64("vid", *cols), "vid"], min(block_rows, LEAF_ROWS))

    def put(batches):
        for b in batches:
            yield b.assign(cell=boxes.place(b[cols].to_numpy(dtype=np.float64)))

    placed = stage(donors.mapInPandas(put, T.StructType([*donors.schema.fields, T.StructField("cell", T.IntegerType())])))
    boxes.measure(placed, cols)
    asks = stage(open_.select(*cols).distinct().withColumn("lid", F.monotonically_increasing_id()))
    tasks = -(-asks.count() * boxes.blocks // TASK_BOUNDS)
    found = T.StructType([T.StructField("lid", T.LongType()), T.StructField("c", T.IntegerType()), T.StructField("nbr", give.schema[key].dataType), T.StructField("dist", T.DoubleType()), T.StructField("v", T.DoubleType())])
    bounds = [f"__u{i}" for i in range(len(cols))]

    def visits(df, choose):
        def run(batches):
            for whole in batches:
                for s in range(0, len(whole), SLICE):
                    b = whole.iloc[s : s + SLICE]
                    li, cj = np.nonzero(choose(b, b[cols].to_numpy(dtype=np.float64)))
                    at = boxes.place(b[cols].to_numpy(dtype=np.float64))
                    yield b.assign(cells=np.split(cj.astype(np.int32), np.searchsorted(li, np.arange(1, len(b)))), at=at)

        df = df.repartition(tasks) if tasks > 1 else df
        more = [T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("at", T.IntegerType())]
        return stage(df.mapInPandas(run, T.StructType([*df.schema.fields, *more])))

    def match(a, b):
        y = b[cols].to_numpy(dtype=np.float64)
        reach = a[bounds].to_numpy(dtype=np.float64) if bounds[0] in a else None
        li, c, rj, dist = masked_nearest(a[cols].to_numpy(dtype=np.float64), y, _key_order(b["vid"].to_numpy()), k, reach)
        return pd.DataFrame({"lid": a["lid"].to_numpy()[li], "c": c.astype(np.int32), "nbr": b["vid"].to_numpy()[rj], "dist": dist, "v": y[rj, c]})

    def top(df, by):
        return df.withColumn("__r", F.row_number().over(Window.partitionBy(by, "c").orderBy("dist", "nbr"))).filter(F.col("__r") <= k).drop("__r")

    def met(df):
        return top(meet(df, placed, boxes, block_rows, match, found, 8 * len(cols) + 8), "lid")

    home = met(visits(asks, lambda b, x: boxes.home(x, k)))
    own = [F.col("c") == i for i in range(len(cols))]
    full = [F.when(F.count_if(c) >= k, F.max(F.when(c, F.col("dist"))) + F.lit(2e-9)).alias(u) for c, u in zip(own, bounds)]
    reach = stage(home.groupBy("lid").agg(*full))
    wide = asks.join(reach, "lid", "left").withColumns({u: F.coalesce(u, F.lit(float("inf"))) for u in bounds})
    near = met(visits(wide, lambda b, x: boxes.within(x, b[bounds].to_numpy(dtype=np.float64))))
    equal = reduce(and_, [open_[c].eqNullSafe(asks[c]) for c in cols])
    return top(open_.join(asks, equal).select(F.col(key).alias("key"), "lid").join(stage(near), "lid").drop("lid"), "key")


def _knn_impute_small(rows: DataFrame, give: DataFrame, cols: list[str], k: int, key: str) -> DataFrame:
    """Donors of checked size go to every executor; recipients stream through."""
    pdf = give.select(key, *cols).toPandas()
    pack = rows.sparkSession.sparkContext.broadcast((_key_order(pdf[key].to_numpy()), pdf[cols].to_numpy(dtype=np.float64)))
    fields = [f for f in rows.schema.fields if f.name == key]
    schema = T.StructType([*fields, *[T.StructField(c, T.DoubleType()) for c in cols]])

    def run(batches):
        order, donors = pack.value
        held = (~np.isnan(donors)).sum(axis=0)
        means = np.divide(np.nansum(donors, axis=0), held, out=np.full(len(cols), np.nan), where=held > 0)
        for b in batches:
            x = b[cols].to_numpy(dtype=np.float64)
            out = np.where(np.isnan(x), means, x)
            open_ = np.nonzero(np.isnan(x).any(axis=1))[0]
            li, c, rj, _ = masked_nearest(x[open_], donors, order, k)
            n, total = np.zeros((len(open_), len(cols))), np.zeros((len(open_), len(cols)))
            np.add.at(n, (li, c), 1)
            np.add.at(total, (li, c), donors[rj, c])
            at = np.nonzero(n)
            out[open_[at[0]], at[1]] = total[at] / n[at]
            got = {name: pd.Series(out[:, i]).astype(object).where(~np.isnan(out[:, i]), None) for i, name in enumerate(cols)}
            yield pd.DataFrame({key: b[key], **got})

    return rows.mapInPandas(run, schema)
