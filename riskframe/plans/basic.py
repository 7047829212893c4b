"""Sources, schema, profiling, missing values, encoding, scaling."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from riskframe.functions.exprs import d, r6
from riskframe.operators import clean, encode, profile, scale, schema
from riskframe.plans.registry import ORACLES, query
from riskframe.session import ensure_checkpoint_dir
from riskframe.sources import frames, io
from riskframe.sources.frames import COMPANY_SQL, NUMERIC, SCORED_SQL, STRINGS, VEC_SQL, with_sql

NUMS = ", ".join(NUMERIC)


def scratch(spark) -> str:
    """Fresh folder below the cluster's shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def rounded(df, cols):
    return df.withColumns({c: r6(c) for c in cols})


def long(df, key, col, *more):
    """Array column to one row per position."""
    x = df.select(key, *more, F.posexplode(col).alias("pos", "v"))
    return x.withColumn("v", r6("v"))


# ---- sources and sinks


@query("csv_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    path = scratch(spark)
    t = frames.table(spark, sf, "customer")
    io.write_table(t, path, "csv")
    return io.read_csv(spark, path, t.schema)


@query("parquet_scan", "SELECT vec_id, label, len(embedding)::int AS width FROM embeddings")
def _(spark, sf):
    return io.read_parquet(spark, f"{sf}/embeddings.parquet").select("vec_id", "label", F.size("embedding").alias("width"))


@query(
    "partitioned_csv_scan",
    "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice) / 1e6::double, 4) AS price FROM orders GROUP BY 1",
)
def _(spark, sf):
    path = scratch(spark)
    t = frames.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    io.write_table(t.repartition(8), path, "csv")
    df = io.read_csv(spark, path, t.schema)
    return df.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice") / d(1e6), 4).alias("price"))


@query("skip_row_rename_scan", "SELECT s_suppkey, s_nationkey AS nation, s_acctbal AS balance FROM supplier")
def _(spark, sf):
    path = scratch(spark)
    lines = frames.table(spark, sf, "supplier").select(F.concat_ws(",", "s_suppkey", "s_nationkey", "s_acctbal").alias("value"))

    def banner(batches):
        yield pd.DataFrame({"value": ["Supplier extract", "s_suppkey,s_nationkey,s_acctbal"]})
        yield from batches

    lines.mapInPandas(banner, "value string").write.text(path)
    return io.read_csv(
        spark, path, "s_suppkey bigint, s_nationkey int, s_acctbal double", skip_rows=1, rename={"s_nationkey": "nation", "s_acctbal": "balance"}
    )


MEANS_SQL = ", ".join(f"avg({c}) AS m_{c}" for c in NUMERIC)
FILLED_SQL = ", ".join(f"round(coalesce({c}, m_{c}), 6) AS {c}" for c in NUMERIC)


@query("clean_table_sink", with_sql(COMPANY_SQL) + f"SELECT company_id, {FILLED_SQL}, target FROM company, (SELECT {MEANS_SQL} FROM company)")
def _(spark, sf):
    path = scratch(spark)
    df = frames.company_table(spark, sf, "company_id", *NUMERIC, "target")
    io.write_table(clean.apply_impute(df, clean.fit_impute(df, NUMERIC)), path)
    return rounded(io.read_parquet(spark, path), NUMERIC)


@query(
    "prediction_sink",
    with_sql(SCORED_SQL)
    + "SELECT y AS true_label, p_a AS pred_prob, (p_a >= 0.6)::int AS pred_label_f1_optimized, (p_a >= 0.25)::int AS pred_label_high_recall FROM scored",
)
def _(spark, sf):
    path = scratch(spark)
    io.write_predictions(frames.scored(spark, sf), path, "y", "p_a", 0.6, 0.25)
    return io.read_csv(spark, path, "true_label int, pred_prob double, pred_label_f1_optimized int, pred_label_high_recall int")


@query("submission_sink", with_sql(SCORED_SQL) + "SELECT id AS uuid, p_a AS proba, (p_a >= 0.7)::int AS prediction FROM scored")
def _(spark, sf):
    path = scratch(spark)
    io.write_table(io.submission(frames.scored(spark, sf), "id", "p_a", 0.7), path, "csv")
    return io.read_csv(spark, path, "uuid bigint, proba double, prediction int")


# ---- schema and filters


@query("drop_key", "SELECT c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    return schema.drop_key(frames.table(spark, sf, "customer"), "c_custkey")


@query("split_features_label", with_sql(COMPANY_SQL) + f"SELECT {NUMS}, target FROM company")
def _(spark, sf):
    return schema.split_xy(frames.company(spark, sf).select("target", *NUMERIC))[0]


@query("align_schema", with_sql(COMPANY_SQL) + "SELECT company_id, sum_price, 0.0::double AS debt, avg_disc, 0.0::double AS age FROM company")
def _(spark, sf):
    return schema.align(frames.company(spark, sf), ["sum_price", "debt", "avg_disc", "age"], keep=["company_id"])


@query(
    "schema_diff",
    """WITH a AS (SELECT DISTINCT source || '_' || lang AS name FROM documents SEMI JOIN labels USING (doc_id)),
    b AS (SELECT DISTINCT source || '_' || lang AS name FROM documents ANTI JOIN labels USING (doc_id))
    SELECT name, 'missing' AS side FROM a ANTI JOIN b USING (name) UNION ALL SELECT name, 'extra' FROM b ANTI JOIN a USING (name)""",
)
def _(spark, sf):
    docs, lab = frames.table(spark, sf, "documents"), frames.table(spark, sf, "labels")
    name = F.concat_ws("_", "source", "lang").alias("name")
    return schema.schema_diff(docs.join(lab, "doc_id", "left_semi").select(name), docs.join(lab, "doc_id", "left_anti").select(name))


@query(
    "fix_vector_width",
    with_sql(VEC_SQL)
    + """SELECT id, 'short' AS kind, unnest(generate_series(0, 39))::int AS pos, round(unnest(features[1:40]), 6) AS v FROM vec
    UNION ALL SELECT id, 'long', unnest(generate_series(0, 69))::int, round(unnest(list_concat(features, list_transform(range(6), lambda i: 0.0::double))), 6) FROM vec""",
)
def _(spark, sf):
    v = frames.vec(spark, sf)
    parts = [
        long(v.select("id", F.lit(kind).alias("kind"), schema.pad_or_truncate(F.col("features"), n).alias("f")), "id", "f", "kind")
        for kind, n in (("short", 40), ("long", 70))
    ]
    return parts[0].unionByName(parts[1])


@query("sort_columns", with_sql(VEC_SQL) + "SELECT " + ", ".join(f"features[{i + 1}] AS a_emb_{i}" for i in sorted(range(64), key=str)) + ", id, target FROM vec")
def _(spark, sf):
    return schema.sort_columns(frames.vec_wide(spark, sf))


@query(
    "assemble_features",
    with_sql(COMPANY_SQL) + f"SELECT company_id, unnest(generate_series(0, {len(NUMERIC) - 1}))::int AS pos, round(unnest([{NUMS}]), 6) AS v FROM company",
)
def _(spark, sf):
    return long(schema.assemble(frames.company(spark, sf), NUMERIC), "company_id", "features")


@query(
    "drop_null_label",
    with_sql(COMPANY_SQL) + "SELECT company_id, urgent_avg, (urgent_avg > 2.5)::int AS label FROM company WHERE urgent_avg IS NOT NULL",
)
def _(spark, sf):
    df = frames.company_table(spark, sf, "company_id", "urgent_avg", (F.col("urgent_avg") > d(2.5)).cast("int").alias("label"))
    return schema.drop_null_label(df, "label")


@query("class_filter", with_sql(COMPANY_SQL) + "SELECT company_id, sum_price FROM company WHERE target = 1")
def _(spark, sf):
    return schema.class_rows(frames.company(spark, sf), "target", 1).select("company_id", "sum_price")


@query("uncertain_band", with_sql(SCORED_SQL) + "SELECT id, p_b FROM scored WHERE p_b > 0.3 AND p_b < 0.7")
def _(spark, sf):
    return schema.uncertain_rows(frames.scored(spark, sf), "p_b").select("id", "p_b")


@query("hard_examples", with_sql(SCORED_SQL) + "SELECT id, y, p_a FROM scored WHERE (p_a >= 0.5)::int <> y")
def _(spark, sf):
    return schema.hard_rows(frames.scored(spark, sf), "p_a", "y").select("id", "y", "p_a")


LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "zscore_outliers",
    with_sql(COMPANY_SQL)
    + """, s AS (SELECT count(*) AS n, """
    + ", ".join(f"count({c}) AS n_{c}, avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMERIC)
    + " FROM company) SELECT company_id FROM company, s WHERE "
    + " OR ".join(f"(n_{c} = n AND s_{c} > 0 AND abs(({c} - m_{c}) / s_{c}) > 2.5)" for c in NUMERIC),
)
def _(spark, sf):
    return schema.outliers_z(frames.company_table(spark, sf, "company_id", *NUMERIC), NUMERIC).select("company_id")


@query(
    "iqr_outliers",
    with_sql(COMPANY_SQL)
    + ", s AS (SELECT "
    + ", ".join(f"quantile_cont({c}, [0.25, 0.75]) AS q_{c}" for c in NUMERIC)
    + " FROM company) SELECT company_id FROM company, s WHERE "
    + " OR ".join(f"coalesce({c} < q_{c}[1] - 1.5 * (q_{c}[2] - q_{c}[1]) OR {c} > q_{c}[2] + 1.5 * (q_{c}[2] - q_{c}[1]), false)" for c in NUMERIC),
)
def _(spark, sf):
    return schema.outliers_iqr(frames.company_table(spark, sf, "company_id", *NUMERIC), NUMERIC).select("company_id")


@query(
    "slice_features",
    with_sql(VEC_SQL) + "SELECT id, unnest([0, 1, 2]) AS pos, round(unnest([features[6], features[1], features[64]]), 6) AS v FROM vec",
)
def _(spark, sf):
    return long(schema.slice_features(frames.vec(spark, sf), [5, 0, 63]), "id", "features")


@query(
    "ratio_and_flag",
    "SELECT l_orderkey, l_linenumber, round(l_extendedprice / (l_quantity + 1) + 1e-9::double, 6) AS ratio, (l_discount >= 0.05)::int AS flag FROM lineitem",
)
def _(spark, sf):
    df = schema.ratio_flag(frames.table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", "l_discount", 0.05)
    return df.select("l_orderkey", "l_linenumber", r6(F.col("ratio") + d(1e-9)).alias("ratio"), "flag")


# ---- profiling

PROFILE = [*NUMERIC, *STRINGS]


@query(
    "null_profile",
    with_sql(COMPANY_SQL) + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM company" for c in PROFILE),
)
def _(spark, sf):
    return profile.null_profile(frames.company(spark, sf).select(PROFILE))


@query("class_distribution", with_sql(COMPANY_SQL) + "SELECT target, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM company GROUP BY 1")
def _(spark, sf):
    return rounded(profile.class_counts(frames.company(spark, sf)), ["share"])


VEC_LONG_SQL = VEC_SQL + ", l AS (SELECT id, target, unnest(generate_series(0, 63)) AS pos, unnest(features) AS x FROM vec)"


@query(
    "column_moments",
    with_sql(VEC_LONG_SQL) + "SELECT pos::int AS pos, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM l GROUP BY 1",
)
def _(spark, sf):
    return rounded(profile.moments(frames.vec(spark, sf)), ["mean", "std"])


@query(
    "column_describe",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min,
        quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, max({c}) AS max FROM lineitem"""
        for c in LINE_COLS
    ),
)
def _(spark, sf):
    df = profile.describe_cols(frames.table(spark, sf, "lineitem"), LINE_COLS)
    return df.withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@query(
    "class_moments",
    with_sql(VEC_LONG_SQL) + "SELECT target, pos::int AS pos, count(*) AS n, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var FROM l GROUP BY 1, 2",
)
def _(spark, sf):
    return rounded(profile.class_moments(frames.vec(spark, sf)), ["mean", "var"])


@query(
    "column_quantiles",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {q}::double AS q, round(quantile_cont({c}, {q}), 6) AS value FROM lineitem" for c in LINE_COLS for q in (0.05, 0.25, 0.5, 0.8)
    ),
)
def _(spark, sf):
    return rounded(profile.quantiles(frames.table(spark, sf, "lineitem"), LINE_COLS, [0.05, 0.25, 0.5, 0.8]), ["value"])


FISHER_SQL = """, cm AS (SELECT pos, target, avg(x) AS m, var_pop(x) AS v FROM l GROUP BY 1, 2),
fisher AS (SELECT pos::int AS pos, CASE WHEN sum(v) = 0 THEN 0 ELSE (max(m) - min(m)) * (max(m) - min(m)) / sum(v) END AS score FROM cm GROUP BY 1)"""


@query(
    "importance_tier",
    with_sql(VEC_LONG_SQL + FISHER_SQL)
    + """SELECT pos, round(score, 6) AS score, CASE WHEN score > q[2] THEN 0.05::double WHEN score > q[1] THEN 0.1::double ELSE 0.2::double END AS scale
    FROM fisher, (SELECT quantile_cont(score, [0.5, 0.8]) AS q FROM fisher)""",
)
def _(spark, sf):
    from riskframe.operators.select import fisher_ratio

    return rounded(profile.importance_tier(fisher_ratio(frames.vec(spark, sf)).select("pos", "score"), "score"), ["score"])


@query("shape_trace", with_sql(VEC_SQL) + "SELECT count(*) AS n_rows, max(len(features)) AS n_features FROM vec")
def _(spark, sf):
    return profile.shape(frames.vec(spark, sf), "features")


# ---- missing values


def _impute_sql(stat):
    return (
        with_sql(COMPANY_SQL)
        + "SELECT company_id, "
        + ", ".join(f"round(coalesce({c}, f_{c}), 6) AS {c}" for c in NUMERIC)
        + " FROM company, (SELECT "
        + ", ".join(f"{stat}({c}) AS f_{c}" for c in NUMERIC)
        + " FROM company)"
    )


def _impute(strategy):
    def run(spark, sf):
        df = frames.company_table(spark, sf, "company_id", *NUMERIC)
        return rounded(clean.apply_impute(df, clean.fit_impute(df, NUMERIC, strategy)), NUMERIC)

    return run


query("mean_impute", _impute_sql("avg"))(_impute("mean"))
query("median_impute", _impute_sql("median"))(_impute("median"))


@query("constant_impute", with_sql(COMPANY_SQL) + "SELECT company_id, coalesce(seg, 'missing') AS seg, coalesce(urgent_status, 'missing') AS urgent_status FROM company")
def _(spark, sf):
    df = frames.company_table(spark, sf, "company_id", *STRINGS)
    return clean.apply_impute(df, clean.fit_impute(df, STRINGS, "constant", "missing"))


COMPANY_KNN_SQL = (
    "SELECT company_id, "
    + ", ".join(f"round(coalesce({c}, k_{c}, m_{c}), 6) AS {c}" for c in NUMERIC)
    + f" FROM company LEFT JOIN filled USING (company_id), (SELECT {MEANS_SQL} FROM company)"
)


KNN_IMPUTE_SQL = (
    with_sql(COMPANY_SQL)
    + f""", w AS (SELECT company_id, [{NUMS}] AS x FROM company),
    pairs AS (
      SELECT a.company_id, b.company_id AS donor, a.x AS ax, b.x AS bx,
        list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])) AS sq
      FROM w a, w b WHERE len(list_filter(a.x, lambda v: v IS NULL)) > 0 AND a.company_id <> b.company_id),
    dist AS (
      SELECT company_id, donor, ax, bx, round(sqrt({len(NUMERIC)}::double / len(list_filter(sq, lambda v: v IS NOT NULL)) * list_sum(sq)), 9) AS dd
      FROM pairs WHERE len(list_filter(sq, lambda v: v IS NOT NULL)) > 0),
    cells AS (SELECT company_id, donor, dd, unnest(generate_series(1, {len(NUMERIC)})) AS pos, unnest(ax) AS av, unnest(bx) AS bv FROM dist),
    best AS (
      SELECT company_id, pos, bv FROM cells WHERE av IS NULL AND bv IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY company_id, pos ORDER BY dd, donor) <= 5),
    filled AS (SELECT company_id, """
    + ", ".join(f"avg(bv) FILTER (WHERE pos = {i + 1}) AS k_{c}" for i, c in enumerate(NUMERIC))
    + " FROM best GROUP BY 1) "
    + COMPANY_KNN_SQL
)


@query("knn_impute", KNN_IMPUTE_SQL)
def _(spark, sf):
    df = frames.company_table(spark, sf, "company_id", *NUMERIC)
    return rounded(clean.knn_impute(df, df, NUMERIC, 5, "company_id"), NUMERIC)


@query("knn_impute_blocks", KNN_IMPUTE_SQL)
def _(spark, sf):
    """The path of donors too many to broadcast, with NaN in the place of every null."""
    df = frames.company_table(spark, sf, "company_id", *NUMERIC)
    df = df.withColumns({c: F.coalesce(F.col(c).cast("double"), d(float("nan"))) for c in NUMERIC})
    return rounded(clean.knn_impute(df, df, NUMERIC, 5, "company_id", broadcast_bytes=0, block_rows=700), NUMERIC)


RAGGED_SQL = """ragged AS (
  SELECT page_id AS id, CASE WHEN len(list_filter(b, lambda x: x <> '')) = 0 THEN NULL ELSE
    list_transform(list_filter(b, lambda x: x <> ''), lambda x: len(x)::double) END AS f
  FROM (SELECT page_id, string_split(url, '/') AS b FROM pages))"""


def ragged(spark, sf):
    """Path-segment lengths of page addresses: vectors of uneven width, null where there is no segment."""
    seg = F.filter(F.split("url", "/", -1), lambda x: x != "")
    f = F.transform(seg, lambda x: F.length(x).cast("double"))
    return frames.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.when(F.size(f) > 0, f).alias("f"))


@query(
    "vector_impute",
    with_sql(RAGGED_SQL)
    + """SELECT id, unnest([0, 1, 2, 3]) AS pos, unnest(list_transform([1, 2, 3, 4], lambda i: coalesce(f[i], 0.0::double))) AS v FROM ragged""",
)
def _(spark, sf):
    return long(ragged(spark, sf).select("id", clean.impute_vectors(F.col("f"), 4).alias("f")), "id", "f")


# ---- encoding


@query(
    "label_encode",
    with_sql(COMPANY_SQL)
    + "SELECT company_id, "
    + ", ".join(f"(dense_rank() OVER (ORDER BY coalesce({c}, 'nan')) - 1) AS {c}" for c in STRINGS)
    + " FROM company",
)
def _(spark, sf):
    df = frames.company_table(spark, sf, "company_id", *STRINGS)
    return encode.apply_label(df, encode.fit_label(df, STRINGS))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
STATUSES = ["F", "O", "P"]


def _onehot_sql(first, statuses):
    flags = [f"(seg = '{s}')::int AS \"seg_{s}\"" for s in SEGMENTS[first:]]
    flags += [f"coalesce(urgent_status = '{s}', false)::int AS \"urgent_status_{s}\"" for s in statuses[first:]]
    return with_sql(COMPANY_SQL) + "SELECT company_id, " + ", ".join(flags) + " FROM company"


@query("onehot_drop_first", _onehot_sql(1, STATUSES))
def _(spark, sf):
    df = frames.company_table(spark, sf, "company_id", *STRINGS)
    return encode.apply_onehot(df, encode.fit_onehot(df, STRINGS, True))


@query("onehot_ignore_unknown", _onehot_sql(0, STATUSES[:2]))
def _(spark, sf):
    """Fitted without one status, applied to all rows: the unknown status is all zero."""
    df = frames.company_table(spark, sf, "company_id", *STRINGS)
    return encode.apply_onehot(df, encode.fit_onehot(df.filter("urgent_status != 'P'"), STRINGS, False))


@query(
    "target_encode",
    with_sql(COMPANY_SQL)
    + """, g AS (SELECT avg(target) AS g FROM company),
    m AS (SELECT coalesce(urgent_status, 'nan') AS v, (sum(target) + any_value(g)) / (count(*) + 1) AS enc FROM company, g GROUP BY 1)
    SELECT company_id, round(enc, 6) AS urgent_status_target_encoded FROM company JOIN m ON coalesce(urgent_status, 'nan') = v""",
)
def _(spark, sf):
    df = frames.company_table(spark, sf, "company_id", "urgent_status", "target")
    out = encode.apply_target(df, encode.fit_target(df, "urgent_status", "target"))
    return out.select("company_id", r6("urgent_status_target_encoded").alias("urgent_status_target_encoded"))


@query(
    "target_encode_unseen",
    with_sql(COMPANY_SQL)
    + """, t AS (SELECT * FROM company WHERE urgent_status IS DISTINCT FROM 'P'), g AS (SELECT avg(target) AS g FROM t),
    m AS (SELECT coalesce(urgent_status, 'nan') AS v, (sum(target) + any_value(g)) / (count(*) + 1) AS enc FROM t, g GROUP BY 1)
    SELECT company_id, round(coalesce(enc, u), 6) AS enc
    FROM company LEFT JOIN m ON coalesce(urgent_status, 'nan') = v, (SELECT avg(enc) AS u FROM m)""",
)
def _(spark, sf):
    df = frames.company_table(spark, sf, "company_id", "urgent_status", "target")
    fit = encode.fit_target(df.filter(~F.col("urgent_status").eqNullSafe("P")), "urgent_status", "target")
    return encode.apply_target(df, fit).select("company_id", r6("urgent_status_target_encoded").alias("enc"))


BIN_COLS = ["sum_price", "n_orders"]


def _edges_sql(n):
    """Quantile edges, near-equal ones removed; codes count interior edges at or below the value."""
    qs = ", ".join(f"{i}/{n}::double" for i in range(n + 1))
    return ", ".join(
        f"""e_{c} AS (SELECT list(e ORDER BY e) AS e FROM (SELECT DISTINCT unnest(quantile_cont({c}, [{qs}])) AS e FROM company))""" for c in BIN_COLS
    )


def _code_sql(c):
    return f"(CASE WHEN {c} IS NOT NULL THEN len(list_filter(e_{c}.e[2:-2], lambda t: t <= {c})) END)::int"


@query(
    "quantile_bins",
    with_sql(COMPANY_SQL, _edges_sql(5)) + "SELECT company_id, " + ", ".join(f"{_code_sql(c)} AS {c}" for c in BIN_COLS) + " FROM company, " + ", ".join(f"e_{c}" for c in BIN_COLS),
)
def _(spark, sf):
    df = frames.company_table(spark, sf, "company_id", *BIN_COLS)
    return encode.apply_bins(df, encode.fit_bins(df, BIN_COLS, 5))


@query(
    "uniform_bins",
    with_sql(COMPANY_SQL)
    + "SELECT company_id, "
    + ", ".join(f"(CASE WHEN {c} IS NOT NULL THEN len(list_filter([1, 2, 3, 4], lambda i: lo_{c} + i * ((hi_{c} - lo_{c}) / 5) <= {c})) END)::int AS {c}" for c in BIN_COLS)
    + " FROM company, (SELECT "
    + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in BIN_COLS)
    + " FROM company)",
)
def _(spark, sf):
    df = frames.company_table(spark, sf, "company_id", *BIN_COLS)
    return encode.apply_bins(df, encode.fit_bins(df, BIN_COLS, 5, "uniform"))


@query(
    "quantile_bins_onehot",
    with_sql(COMPANY_SQL, _edges_sql(10))
    + " UNION ALL ".join(
        f"""SELECT company_id, '{c}' AS feature, pos::int AS pos, (pos = {_code_sql(c)})::int::double AS v
        FROM company, e_{c}, unnest(generate_series(0, len(e_{c}.e) - 2)) AS s(pos)"""
        for c in BIN_COLS
    ),
)
def _(spark, sf):
    df = frames.company_table(spark, sf, "company_id", *BIN_COLS)
    out = encode.apply_bins(df, encode.fit_bins(df, BIN_COLS, 10), "onehot")
    parts = [long(out.select("company_id", F.lit(c).alias("feature"), c), "company_id", c, "feature") for c in BIN_COLS]
    return parts[0].unionByName(parts[1])


@query(
    "hierarchical_routing",
    with_sql(COMPANY_SQL, _edges_sql(5))
    + f""", g AS (SELECT avg(target) AS g FROM company),
    m AS (SELECT coalesce(urgent_status, 'nan') AS v, (sum(target) + any_value(g)) / (count(*) + 1) AS enc FROM company, g GROUP BY 1),
    s AS (SELECT coalesce(seg, 'nan') AS sv, (sum(target) + any_value(g)) / (count(*) + 1) AS senc FROM company, g GROUP BY 1)
    SELECT company_id, avg_disc, {_code_sql('n_orders')} AS n_orders_binned, {_code_sql('sum_price')} AS sum_price_binned,
      round(senc, 6) AS seg_target_encoded, round(enc, 6) AS urgent_status_target_encoded
    FROM company JOIN m ON coalesce(urgent_status, 'nan') = v JOIN s ON coalesce(seg, 'nan') = sv, e_sum_price, e_n_orders""",
)
def _(spark, sf):
    df = frames.company_table(spark, sf, "company_id", "avg_disc", "n_orders", "sum_price", "seg", "urgent_status", "target")
    fit = encode.fit_hierarchy(df, ["avg_disc"], [r"sum_", r"n_ord"], [r"seg$", r"urgent_s"], "target")
    return rounded(encode.apply_hierarchy(df, fit, ["company_id"]), ["seg_target_encoded", "urgent_status_target_encoded"])


TYPED_BLOCKS = [f"(({c} - a_{c}) / s_{c})" for c in NUMERIC]
TYPED_BLOCKS += [f"(seg = '{s}')::int::double" for s in SEGMENTS]
TYPED_BLOCKS += [f"(coalesce(urgent_status, 'missing') = '{s}')::int::double" for s in [*STATUSES, "missing"]]


@query(
    "typed_preprocessing",
    with_sql(COMPANY_SQL)
    + ", f AS (SELECT company_id, seg, urgent_status, "
    + ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in NUMERIC)
    + f" FROM company, (SELECT {MEANS_SQL} FROM company)), st AS (SELECT "
    + ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in NUMERIC)
    + f" FROM f) SELECT company_id, unnest(generate_series(0, {len(TYPED_BLOCKS) - 1}))::int AS pos, round(unnest([{', '.join(TYPED_BLOCKS)}]), 6) AS v FROM f, st",
)
def _(spark, sf):
    df = frames.company_table(spark, sf, "company_id", *NUMERIC, *STRINGS, "target")
    return long(encode.apply_typed(df, encode.fit_typed(df, "company_id", "target"), ["company_id"]), "company_id", "features")


# ---- scaling

SCALED = ["sum_price", "avg_disc", "ret_share", "n_orders"]


def _scaled(kind):
    def run(spark, sf):
        df = frames.company_table(spark, sf, "company_id", *SCALED)
        return rounded(scale.apply_scale(df, scale.fit_scale(df, SCALED, kind)), SCALED)

    return run


def _scale_sql(stats, expr):
    cols = ", ".join(f"round({expr.format(c=c)}, 6) AS {c}" for c in SCALED)
    return with_sql(COMPANY_SQL) + f"SELECT company_id, {cols} FROM company, (SELECT " + ", ".join(stats.format(c=c) for c in SCALED) + " FROM company)"


query("standard_scale", _scale_sql("avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}", "({c} - m_{c}) / s_{c}"))(_scaled("standard"))
query("robust_scale", _scale_sql("quantile_cont({c}, [0.25, 0.5, 0.75]) AS q_{c}", "({c} - q_{c}[2]) / (q_{c}[3] - q_{c}[1])"))(_scaled("robust"))
query("minmax_scale", _scale_sql("min({c}) AS lo_{c}, max({c}) AS hi_{c}", "({c} - lo_{c}) / (hi_{c} - lo_{c})"))(_scaled("minmax"))


def _grid_sql(c):
    """Reference grid by explicit interpolation of the sorted values (the quantile list has to be constant)."""
    return f"""o_{c} AS (SELECT {c} AS x, row_number() OVER (ORDER BY {c}) - 1 AS i, count(*) OVER () AS n FROM company WHERE {c} IS NOT NULL),
    h_{c} AS (SELECT i / (least(1000, n) - 1)::double AS r, round(i * (n - 1) / (least(1000, n) - 1)::double, 9) AS h FROM o_{c} WHERE i < least(1000, n)),
    g_{c} AS (SELECT r, CASE WHEN a.x = b.x THEN a.x ELSE a.x + (b.x - a.x) * (h - floor(h)) END AS v FROM h_{c} JOIN o_{c} a ON a.i = floor(h) JOIN o_{c} b ON b.i = ceil(h)),
    k_{c} AS (SELECT v, lo, hi, lead(v) OVER (ORDER BY v) AS v1, lead(lo) OVER (ORDER BY v) AS lo1 FROM (SELECT v, min(r) AS lo, max(r) AS hi FROM g_{c} GROUP BY v))"""


@query(
    "quantile_uniform_scale",
    with_sql(COMPANY_SQL, *[_grid_sql(c) for c in SCALED])
    + " UNION ALL ".join(
        f"""SELECT company_id, '{c}' AS feature, round(CASE WHEN {c} IS NULL THEN NULL WHEN {c} = v THEN (lo + hi) / 2 WHEN v1 IS NULL THEN 1 ELSE hi + (lo1 - hi) * ({c} - v) / (v1 - v) END + 1e-10::double, 6) AS value
        FROM company ASOF LEFT JOIN k_{c} ON {c} >= v"""
        for c in SCALED
    ),
)
def _(spark, sf):
    df = frames.company_table(spark, sf, "company_id", *SCALED)
    out = scale.apply_scale(df, scale.fit_scale(df, SCALED, "quantile"))
    return out.unpivot("company_id", SCALED, "feature", "value").withColumn("value", r6(F.col("value") + d(frames.TIE)))


def _power_ll(c):
    pos = f"CASE WHEN abs(lam) < 1e-9 THEN ln(1 + {c}) ELSE (pow({c} + 1, lam) - 1) / lam END"
    neg = f"CASE WHEN abs(2 - lam) < 1e-9 THEN -ln(1 - {c}) ELSE -(pow(1 - {c}, 2 - lam) - 1) / (2 - lam) END"
    return f"CASE WHEN {c} >= 0 THEN {pos} ELSE {neg} END"


@query(
    "power_scale",
    with_sql(COMPANY_SQL)
    + ", g AS (SELECT round(-2 + 0.1 * i, 1)::double AS lam FROM range(41) t(i)), "
    + ", ".join(
        f"""t_{c} AS (SELECT company_id, lam, {_power_ll(c)} AS z, sign({c}) * ln(1 + abs({c})) AS sl FROM company, g),
        b_{c} AS (SELECT lam, avg(z) AS m, stddev_pop(z) AS s FROM t_{c} GROUP BY 1
          ORDER BY round(-0.5 * count(z) * ln(var_pop(z)) + (any_value(lam) - 1) * sum(sl), 9) DESC, lam LIMIT 1)"""
        for c in SCALED
    )
    + " "
    + " UNION ALL ".join(f"SELECT company_id, '{c}' AS feature, lam, round((z - m) / s, 6) AS value FROM t_{c} JOIN b_{c} USING (lam)" for c in SCALED),
)
def _(spark, sf):
    df = frames.company_table(spark, sf, "company_id", *SCALED)
    fit = scale.fit_scale(df, SCALED, "power")
    out = scale.apply_scale(df, fit).unpivot("company_id", SCALED, "feature", "value")
    lam = F.lit(None).cast("double")
    for c, p in fit.cols.items():
        lam = F.when(F.col("feature") == c, d(p["lam"])).otherwise(lam)
    return rounded(out.withColumn("lam", lam), ["value"])


# ---- NaN is missing: the same frame with NaN in a seventh of its cells, against SQL with null there


def _holed_sql(cols, *ctes):
    """The company frame as ``holed``, and further tables read from it."""
    holed = "holed AS (SELECT company_id, " + ", ".join(f"CASE WHEN company_id % 7 <> {i % 7} THEN {c} END AS {c}" for i, c in enumerate(cols)) + " FROM company)"
    return with_sql(COMPANY_SQL, holed, *[_on_holed(x) for x in ctes])


def _on_holed(sql):
    return sql.replace("FROM company", "FROM holed")


def _holed(spark, sf, cols):
    df = frames.company_table(spark, sf, "company_id", *cols)
    nan = d(float("nan"))
    return df.withColumns({c: F.when(F.col("company_id") % 7 == i % 7, nan).otherwise(F.col(c).cast("double")) for i, c in enumerate(cols)})


@query(
    "describe_with_nan",
    _holed_sql(BIN_COLS)
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::double AS min,
        round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, max({c})::double AS max FROM holed"""
        for c in BIN_COLS
    ),
)
def _(spark, sf):
    out = profile.describe_cols(_holed(spark, sf, BIN_COLS), BIN_COLS)
    return out.withColumns({**{c: F.round(c, 4) for c in ("mean", "std")}, **{c: r6(c) for c in ("q25", "q50", "q75")}})


@query(
    "quantile_bins_with_nan",
    _holed_sql(BIN_COLS, _edges_sql(5)) + "SELECT company_id, " + ", ".join(f"{_code_sql(c)} AS {c}" for c in BIN_COLS) + " FROM holed, " + ", ".join(f"e_{c}" for c in BIN_COLS),
)
def _(spark, sf):
    df = _holed(spark, sf, BIN_COLS)
    return encode.apply_bins(df, encode.fit_bins(df, BIN_COLS, 5))


@query("uniform_bins_with_nan", _holed_sql(BIN_COLS) + _on_holed(ORACLES["uniform_bins"][ORACLES["uniform_bins"].index("SELECT company_id, (CASE") :]))
def _(spark, sf):
    df = _holed(spark, sf, BIN_COLS)
    return encode.apply_bins(df, encode.fit_bins(df, BIN_COLS, 5, "uniform"))


@query(
    "quantile_scale_with_nan",
    _holed_sql(SCALED, *[_grid_sql(c) for c in SCALED]) + _on_holed(ORACLES["quantile_uniform_scale"][ORACLES["quantile_uniform_scale"].index(f"SELECT company_id, '{SCALED[0]}'") :]),
)
def _(spark, sf):
    df = _holed(spark, sf, SCALED)
    out = scale.apply_scale(df, scale.fit_scale(df, SCALED, "quantile"))
    return out.unpivot("company_id", SCALED, "feature", "value").withColumn("value", r6(F.col("value") + d(frames.TIE)))


# ---- power transform at the maximum of the likelihood

ML_COLS = ["sum_price", "avg_disc"]


def _slope_sql(c, lam):
    """Slope of the likelihood of ``c`` at ``lam``, in the transform's own terms."""
    up, down = f"pow({c} + 1, {lam})", f"pow(1 - {c}, 2 - {lam})"
    y = f"CASE WHEN {c} >= 0 THEN ({up} - 1) / {lam} ELSE -({down} - 1) / (2 - {lam}) END"
    dy = f"CASE WHEN {c} >= 0 THEN ({up} * ln({c} + 1) - ({up} - 1) / {lam}) / {lam} ELSE ({down} * ln(1 - {c}) - ({down} - 1) / (2 - {lam})) / (2 - {lam}) END"
    return f"sum(sign({c}) * ln(1 + abs({c}))) - count({c}) * covar_pop({y}, {dy}) / var_pop({y})"


def _bisected_sql(c):
    """Lambda of ``c`` by 45 halvings of [-40, 40.1], whose midpoints never meet 0 or 2."""
    return f"""b_{c} AS (
      SELECT 0 AS i, -40::double AS lo, 40.1::double AS hi
      UNION ALL
      SELECT i + 1, CASE WHEN s > 0 THEN m ELSE lo END, CASE WHEN s > 0 THEN hi ELSE m END
      FROM (SELECT i, lo, hi, (lo + hi) / 2 AS m, (SELECT {_slope_sql(c, "((lo + hi) / 2)")} FROM company) AS s FROM b_{c} WHERE i < 45))"""


@query(
    "power_likelihood_lambda",
    with_sql(COMPANY_SQL, *[_bisected_sql(c) for c in ML_COLS]).replace("WITH", "WITH RECURSIVE", 1)
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, round((lo + hi) / 2, 5) AS lam FROM b_{c} WHERE i = 45" for c in ML_COLS),
)
def _(spark, sf):
    df = frames.company_table(spark, sf, "company_id", *ML_COLS)
    fitted = scale.fit_scale(df, ML_COLS, "power", lambdas="likelihood")
    return spark.createDataFrame([(c, round(p["lam"], 5)) for c, p in fitted.cols.items()], "feature string, lam double")
