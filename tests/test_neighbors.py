"""Exact neighbour joins against brute force, on the broadcast and on the cell path."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import clean, cluster, neighbors, sample


def frame(spark, x, start=0):
    return spark.createDataFrame([(i + start, [float(v) for v in r], int(i % 4 == 0)) for i, r in enumerate(x)], "id long, features array<double>, target int")


def brute(left, right, k, exclude):
    out = {}
    for i, a in left:
        d = sorted((round(float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum())), 9), j) for j, b in right if not (exclude and i == j))
        out[i] = [(j, dd) for dd, j in d[:k]]
    return out


def data(kind):
    rng = np.random.default_rng(5)
    if kind == "normal":
        return rng.normal(size=(160, 6))
    if kind == "clusters":
        return np.concatenate([rng.normal(size=(80, 3)) * 0.01, rng.normal(size=(80, 3)) + 5])
    if kind == "copies":  # a third of all rows are one vector, another fifth another
        return np.concatenate([np.zeros((60, 2)), np.ones((30, 2)), rng.integers(0, 3, size=(70, 2)).astype(float)])
    return rng.integers(0, 2, size=(120, 5)).astype(float)  # many equal distances


@pytest.mark.parametrize("kind", ["normal", "clusters", "copies", "grid"])
@pytest.mark.parametrize("limit", [neighbors.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("exclude", [True, False])
def test_knn_equals_brute_force(spark, kind, limit, exclude):
    x = data(kind)
    df = frame(spark, x)
    got = {}
    for r in neighbors.knn(df, df, 4, exclude_self=exclude, broadcast_bytes=limit, block_rows=16).collect():
        got.setdefault(r["key"], []).append((r["rn"], r["nbr"], r["dist"]))
    rows = list(enumerate(x.tolist()))
    want = brute(rows, rows, 4, exclude)
    for i, pairs in want.items():
        assert [n for _, n, _ in sorted(got[i])] == [j for j, _ in pairs]
        assert np.allclose([dd for _, _, dd in sorted(got[i])], [dd for _, dd in pairs], atol=1e-9)


@pytest.mark.parametrize("limit", [neighbors.BROADCAST_BYTES, 0])
def test_fewer_rows_than_neighbours(spark, limit):
    df = frame(spark, np.arange(6).reshape(3, 2))
    got = neighbors.knn(df, df, 5, broadcast_bytes=limit).collect()
    assert len(got) == 6 and max(r["rn"] for r in got) == 2


def test_no_right_rows(spark):
    df = frame(spark, np.arange(6).reshape(3, 2))
    assert neighbors.knn(df, df.filter("id < 0"), 2).count() == 0


def test_string_keys(spark):
    df = spark.createDataFrame([("a", [0.0]), ("b", [1.0]), ("c", [5.0])], "id string, features array<double>")
    for limit in (neighbors.BROADCAST_BYTES, 0):
        got = {r["key"]: r["nbr"] for r in neighbors.knn(df, df, 1, broadcast_bytes=limit).collect()}
        assert got == {"a": "b", "b": "a", "c": "b"}


@pytest.mark.parametrize("fn", ["smote", "adasyn", "tomek_links", "edited_nn"])
def test_rebalancing_is_the_same_on_both_paths(spark, fn):
    df = frame(spark, data("normal"))
    run = getattr(sample, fn)
    pick = lambda out: sorted((r["id"], tuple(round(v, 9) for v in r["features"])) for r in out.collect())
    assert pick(run(df, "target")) == pick(run(df, "target", broadcast_bytes=0, block_rows=16))


def test_smote_reaches_parity(spark):
    out = sample.smote(frame(spark, data("normal")), "target")
    n = {r["target"]: r["count"] for r in out.groupBy("target").count().collect()}
    assert n[0] == n[1] == 120


def test_rebalancing_one_class(spark):
    df = frame(spark, data("normal")).filter("target = 0")
    assert sample.smote_tomek(df, "target").count() == 120
    with pytest.raises(ValueError):
        sample.adasyn(df, "target")


@pytest.mark.parametrize("limit", [neighbors.BROADCAST_BYTES, 0])
def test_knn_impute(spark, limit):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 3))
    x[rng.random((50, 3)) < 0.2] = np.nan
    x[7] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = {r["id"]: (r["a"], r["b"], r["c"]) for r in clean.knn_impute(df, df, ["a", "b", "c"], 3, broadcast_bytes=limit).collect()}
    for i in range(50):
        for c in range(3):
            want = x[i, c]
            if np.isnan(want):
                near = []
                for j in range(50):
                    both = ~np.isnan(x[i]) & ~np.isnan(x[j])
                    if not np.isnan(x[j, c]) and both.any():
                        near.append((round(np.sqrt(3 / both.sum() * ((x[i, both] - x[j, both]) ** 2).sum()), 9), j))
                want = np.mean([x[j, c] for _, j in sorted(near)[:3]]) if near else np.nanmean(x[:, c])
            assert got[i][c] == pytest.approx(want, abs=1e-9)


def brute_density(x, eps, m):
    n = len(x)
    dist = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9)
    near = dist <= eps
    core = near.sum(1) >= m
    label = np.full(n, -1)
    c = 0
    for i in range(n):
        if core[i] and label[i] == -1:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] == -1:
                    label[j] = c
                    if core[j]:
                        todo += [q for q in np.nonzero(near[j])[0] if label[q] == -1]
            c += 1
    return label, core


@pytest.mark.parametrize("kind,eps", [("normal", 1.6), ("clusters", 0.6), ("copies", 0.5), ("grid", 1.0)])
def test_density_clusters(spark, kind, eps):
    x = data(kind)
    label, core = brute_density(x, eps, 5)
    got = {r["id"]: (r["cluster"], r["core"]) for r in cluster.density_clusters(frame(spark, x), eps, 5, block_rows=16).collect()}
    assert [got[i] for i in range(len(x))] == [(int(a), int(b)) for a, b in zip(label, core)]


def test_isolation_forest_finds_the_outlier(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(200, 3)), [[9.0, 9.0, 9.0]]])
    df = frame(spark, x)
    model = cluster.fit_isolation(df, trees=30, sample=64, contamination=0.05)
    rows = cluster.apply_isolation(df, model).orderBy(F.col("anomaly").desc()).collect()
    assert rows[0]["id"] == 200
    assert sum(r["decision"] < 0 for r in rows) == 10


@pytest.mark.parametrize("kind", ["normal", "copies"])
def test_a_visiting_vector_stays_one_row_however_many_cells_it_visits(spark, kind):
    x = np.unique(data(kind), axis=0)
    vectors = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vid long, f array<double>")
    cells = neighbors.make_cells(vectors, 400)
    placed = neighbors.assign(vectors, cells)
    neighbors.measure(cells, placed)
    visits = neighbors.radius_visits(vectors.withColumnRenamed("vid", "lid"), cells, 1e3)
    assert visits.count() == len(x)
    group = cells.groups(len(x))
    assert set(group) == {0} and set(cells.groups(1)[cells.count > 0]) == set(range((cells.count > 0).sum()))
    met = neighbors.block_pairs(visits, placed, cells, len(x)).applyInPandas(lambda a, b: a.assign(n=len(b))[["lid", "n"]].head(len(a)), "lid long, n long")
    assert [(r["lid"], r["n"]) for r in met.orderBy("lid").collect()] == [(i, len(x)) for i in range(len(x))]


def test_a_broadcast_match_is_dealt_out_by_its_pairs(spark, monkeypatch):
    df = frame(spark, data("normal")).coalesce(1)
    monkeypatch.setattr(neighbors, "TASK_PAIRS", 160 * 160 // 4)
    out = neighbors.knn(df, df, 3)
    assert out.rdd.getNumPartitions() >= 4 and out.count() == 480


def brute_impute(x, k, rows):
    """The masked distance of every pair, measured plainly."""
    out = x.copy()
    for i in rows:
        both = ~np.isnan(x[i]) & ~np.isnan(x)
        n = both.sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.round(np.sqrt(np.where(both, (x - x[i]) ** 2, 0).sum(1) * x.shape[1] / n), 9)
        for c in np.nonzero(np.isnan(x[i]))[0]:
            ok = np.nonzero((n > 0) & ~np.isnan(x[:, c]))[0]
            out[i, c] = x[ok[np.lexsort((ok, d[ok]))[:k]], c].mean() if len(ok) else np.nanmean(x[:, c]) if (~np.isnan(x[:, c])).any() else np.nan
    return out


@pytest.mark.parametrize("kind", ["few gaps", "many gaps", "copies", "one column held by few"])
def test_knn_impute_boxes_equal_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(900, 4)) * [1, 5, 1, 0.1], 3)
    if kind == "copies":
        x = np.concatenate([np.zeros((300, 4)), x[:20].repeat(30, axis=0)])
    x[rng.random(x.shape) < (0.5 if kind == "many gaps" else 0.1)] = np.nan
    x[5] = np.nan
    if kind == "copies":
        x[:200, 1:] = np.nan
    if kind == "one column held by few":
        x[3:, 3], x[:, 2] = np.nan, np.nan
    cols = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id long, a double, b double, c double, d double")
    got = np.array([[np.nan if r[c] is None else r[c] for c in cols] for r in clean.knn_impute(df, df, cols, 3, broadcast_bytes=0, block_rows=32).orderBy("id").collect()], dtype=float)
    assert np.allclose(got, brute_impute(x, 3, range(len(x))), atol=1e-9, equal_nan=True)


def test_boxes_leave_most_pairs_unmeasured():
    """Pairs that meet grow with the rows, not with their square."""
    from riskframe.operators.boxes import Boxes

    share = []
    for n in (2000, 16000):
        x = np.random.default_rng(4).normal(size=(n, 3))
        x[: n // 10, 2] = np.nan
        boxes = Boxes(x[::4], n, 64)
        cell = boxes.place(x)
        for b in range(boxes.blocks):
            y = x[cell == b]
            boxes.count[b], boxes.held[b] = len(y), (~np.isnan(y)).sum(0)
            boxes.low[b], boxes.high[b] = np.where(np.isnan(y), np.inf, y).min(0, initial=np.inf), np.where(np.isnan(y), -np.inf, y).max(0, initial=-np.inf)
        asks = x[: n // 10]
        d = np.sort(np.stack([((x[n // 10 :, :2] - a[:2]) ** 2).sum(1) * 1.5 for a in asks]), axis=1)[:, 4] ** 0.5
        reach = np.repeat(d[:, None] + 1e-9, 3, axis=1)
        met = boxes.within(asks, reach)
        share.append((met @ boxes.count).mean() / n)
    assert share[1] < share[0] / 3 and share[0] < 0.5


def test_equal_vectors_fold_without_sorting_by_them_alone(spark):
    """Spark normalises a vector again for every comparison of a sort: a hash has to lead."""
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [-0.0, 1.0]), (3, [2.0, 1.0]), (4, [0.0, 1.0])], "key long, f array<double>")
    folded = neighbors._fold(df, 2)
    assert sorted(r["ids"] for r in folded.collect()) == [[1, 2], [3]]
    plan = folded._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(__h" in plan
    got = neighbors.knn(df.withColumnsRenamed({"key": "id", "f": "features"}), df.withColumnsRenamed({"key": "id", "f": "features"}), 1, broadcast_bytes=0)
    assert sorted((r["key"], r["nbr"]) for r in got.collect()) == [(1, 2), (2, 1), (3, 1), (4, 1)]


@pytest.mark.parametrize("kind", ["normal", "clusters", "copies", "grid"])
def test_knn_in_rounds_equals_brute_force(spark, kind, monkeypatch):
    """Vectors that visit most cells are not sent once per block: right rows come round in chunks, matches alone are written."""
    monkeypatch.setattr(neighbors, "CHUNK_BYTES", 1)
    monkeypatch.setattr(neighbors, "SENT", 0)
    monkeypatch.setattr(neighbors, "block_pairs", None)
    x = data(kind)
    df = frame(spark, x)
    got = {}
    for r in neighbors.knn(df, df, 4, broadcast_bytes=0, block_rows=16).collect():
        got.setdefault(r["key"], []).append((r["rn"], r["nbr"], r["dist"]))
    rows = list(enumerate(x.tolist()))
    for i, pairs in brute(rows, rows, 4, True).items():
        assert [(n, d) for _, n, d in sorted(got[i])] == [(j, pytest.approx(d, abs=1e-9)) for j, d in pairs]


def test_vectors_that_visit_all_blocks_are_not_sent_to_each(spark, monkeypatch):
    """300 points of 40 dimensions, blocks of 4: the second round would send each of them about 75 times."""
    sent = []
    pairs = neighbors.block_pairs
    monkeypatch.setattr(neighbors, "block_pairs", lambda v, p, c, rows, *units: sent.append((v.agg(F.sum(F.size("cells"))).first()[0], rows)) or pairs(v, p, c, rows, *units))
    x = np.random.default_rng(3).normal(size=(300, 40))
    df = frame(spark, x)
    got = {(r["key"], r["rn"]): r["nbr"] for r in neighbors.knn(df, df, 2, broadcast_bytes=0, block_rows=4).collect()}
    rows = list(enumerate(x.tolist()))
    assert got == {(i, n + 1): j for i, p in brute(rows, rows, 2, True).items() for n, (j, _) in enumerate(p)}
    assert all(visits <= neighbors.SENT * 600 for visits, _ in sent)


def test_one_cell_larger_than_a_chunk():
    assert neighbors._chunks(np.array([3, 4, 25, 2, 0, 9]), 10) == [(0, 2, 0, 1), (2, 3, 0, 3), (2, 3, 1, 3), (2, 3, 2, 3), (3, 5, 0, 1), (5, 6, 0, 1)]


def test_bounded_matches_of_far_off_vectors(spark):
    """Single precision pre-selects around the mean; where it cannot tell, double precision decides."""
    rng = np.random.default_rng(8)
    for shift in (0.0, 1e6, 1e20):
        y = rng.normal(size=(500, 3)) + shift
        x = y[:50] + rng.normal(size=(50, 3)) * 0.1
        order = np.arange(len(y))
        li, rj, dist = neighbors.block_topk(x, y, order, 4)
        bound = dist.reshape(50, 4)[:, 2]
        near = dist <= bound[li]
        got = neighbors.block_topk(x, y, order, 4, bound)
        assert all(np.array_equal(a, b[near]) for a, b in zip(got, (li, rj, dist)))


def test_impute_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 4)).round(3)
    x[rng.random(x.shape) < 0.3] = np.nan
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id long, a double, b double, c double, d double")
    cols = ["a", "b", "c", "d"]
    want = sorted(map(tuple, clean.knn_impute(df, df, cols, 3).collect()))
    monkeypatch.setattr(neighbors, "CHUNK_BYTES", 1)
    monkeypatch.setattr(neighbors, "SENT", 0)
    monkeypatch.setattr(neighbors, "block_pairs", None)
    got = sorted(map(tuple, clean.knn_impute(df, df, cols, 3, broadcast_bytes=0, block_rows=20).collect()))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1:] for g in got], [w[1:] for w in want], atol=1e-9)


def test_fill_within_bounds_is_the_fill_cut_at_them():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 5))
    x[rng.random(x.shape) < 0.25] = np.nan
    x[:20] = np.nan
    bound = np.where(rng.random((300, 5)) < 0.1, np.inf, rng.random((300, 5)) * 2)
    order = np.arange(600)
    pairs = lambda got: sorted(zip(*(z.tolist() for z in got)))
    free = clean.masked_nearest(x[:300], x[300:], order, 4)
    near = free[3] <= bound[free[0], free[1]]
    assert near.any() and not near.all()
    assert pairs(clean.masked_nearest(x[:300], x[300:], order, 4, bound)) == pairs([z[near] for z in free])
