"""Order MinHash fingerprints: min-hash sketches that also see the order of what they pick.

A text's k-mers are pairs of neighbouring words (the last word alone closes the list), each numbered by how often the
same k-mer came before it. A numbered k-mer's hash names one of ``BINS`` bins and its rank there; the ``PICK`` smallest
of a bin, put back in text order, are hashed together as that bin's entry. Two texts agree in a bin when they share the
smallest k-mers and their order, so agreement falls with edits and with moved passages. One hash per k-mer serves all
bins. Likeness rises with the share of agreeing bins among those that either text fills.

All in SQL functions. Numbering repeats needs no pass per k-mer: k-mers are sorted as longs, hash above and position
below, and a k-mer's number is the length of the equal run that ends at it, found by doubling steps only where its left
neighbour is equal. Cost per text: two sorts of its k-mers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.session import shuffle_partitions

BINS = 32
PICK = 2
_AT = (1 << 24) - 1  # positions: 16 million words; longer texts wrap, which can only change the order of picked k-mers
_BIN_SHIFT = 59


def _steps(col: str) -> Column:
    """Powers of two below the size, falling."""
    n = F.size(col)
    top = F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int")
    return F.transform(F.sequence(top, F.lit(0), F.lit(-1)), lambda p: F.pow(F.lit(2.0), p).cast("int"))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``: one int per bin, null where the text has no k-mer; the null text counts as empty.

    Every step is a column of its own: a lambda would work out a nested expression once per element. A column that is
    only used inside a lambda is named once more outside it, else the optimizer would put its expression there.
    """
    w, h, a, s, e, c = (f"_{name}_{x}" for x in "whasec")
    low = F.lit(_AT).cast("long")
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x09-\x0D\x20]+", -1), lambda x: x != "")
    keep = [x for x in df.columns]
    df = df.select(*keep, words.alias(w))
    df = df.select(*keep, F.when(F.size(w) > 0, F.zip_with(w, F.slice(F.col(w), F.lit(2), F.size(w)), lambda x, y: F.xxhash64(x, y))).otherwise(F.array().cast("array<long>")).alias(h))
    top = lambda x: F.shiftright(x, 24)
    df = df.select(*keep, h, F.sort_array(F.transform(h, lambda x, i: F.shiftleft(top(x), 24).bitwiseOR(i.bitwiseAND(low)))).alias(a))
    df = df.select(*keep, h, a, _steps(a).alias(s))

    def numbered(x: Column, j: Column) -> Column:
        run = F.aggregate(F.col(s), F.lit(1), lambda acc, st: F.when((j - acc - st + 1 >= 0) & (top(F.get(a, j - acc - st + 1)) == top(x)), acc + st).otherwise(acc))
        return F.when((j > 0) & (top(F.get(a, j - 1)) == top(x)), run).otherwise(F.lit(1))

    rank = lambda x, j: F.shiftleft(top(F.xxhash64(top(x), numbered(x, j))), 24).bitwiseOR(x.bitwiseAND(low))
    df = df.select(*keep, h, F.when(F.size(s) > 0, F.sort_array(F.transform(a, rank))).alias(e))
    of = lambda x: F.shiftrightunsigned(x, _BIN_SHIFT)
    df = df.select(*keep, h, F.filter(e, lambda x, j: (j < PICK) | (of(F.get(e, F.greatest(j - PICK, F.lit(0)))) != of(x))).alias(c))

    def entry(picked: Column) -> Column:
        order = F.array_sort(F.transform(picked, lambda x: x.bitwiseAND(low).cast("int")))
        return F.when(F.size(picked) > 0, F.aggregate(order, F.lit(42).cast("long"), lambda acc, i: F.xxhash64(acc, F.get(h, i)), lambda acc: F.shiftright(acc, 32).cast("int")))

    bins = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.filter(c, lambda x: of(x) == b))
    return df.select(*keep, F.when((F.size(c) >= 0) & (F.size(h) >= 0), F.transform(bins, entry)).alias(name))


def likeness(a: str, b: str) -> Column:
    """Estimated share of numbered k-mers held in common, in order: 1 for equal fingerprints, 0 without an agreeing bin.

    A bin agrees with about the chance J ** PICK, J the Jaccard similarity of the k-mer sets; 2J / (1 + J) is the share
    of their mean size that both hold. Bins that both leave empty do not count; two empty texts are alike.
    """
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    filled = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.isNotNull() | y.isNotNull()), lambda x: x))
    j = F.pow(same / F.greatest(filled, F.lit(1)), F.lit(1 / PICK))
    return F.when(filled == 0, 1.0).otherwise(2 * j / (1 + j))


def written(bins: str) -> Column:
    """Fixed width: eight hex digits a bin, dashes for an empty one."""
    return F.array_join(F.transform(bins, lambda x: F.coalesce(F.lower(F.lpad(F.right(F.hex(x.cast("long")), F.lit(8)), 8, "0")), F.lit("--------"))), "")


def with_next(docs: DataFrame, n_blocks: int | None = None) -> DataFrame:
    """(doc_id, text, fp) joined to the next row's text and fp, in falling order of doc_id and from the last to the first.

    Rows go to blocks of neighbouring ids by splitters that one quantile pass over the ids yields; each block also gets
    a copy of the first row of the block after it. Texts are shuffled once. Null ids come last; rows of one id are
    ordered by their text.
    """
    blocks = n_blocks or 8 * shuffle_partitions(docs.sparkSession)
    sid = F.coalesce(F.col("doc_id"), F.lit(-(2**63)).cast("long"))
    cuts = docs.select(sid.alias("sid")).agg(F.percentile_approx("sid", [i / blocks for i in range(1, blocks)] or [0.5], max(10_000, 4 * blocks)).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    steps = [1 << p for p in range(len(cuts).bit_length(), -1, -1)]
    # a plain array column of at most ``blocks`` longs, searched by halving
    splits = F.lit(cuts) if cuts else F.array().cast("array<long>")
    block = F.aggregate(F.lit(steps), F.lit(0), lambda acc, st: F.when(F.get(splits, acc + st - 1) < sid, acc + st).otherwise(acc))
    # ids alone: the first id of each block, and the block before it (the last block for the very first)
    heads = docs.select(sid.alias("sid"), block.alias("blk")).groupBy("blk").agg(F.max("sid").alias("head"))
    down = Window.orderBy(F.desc("blk"))
    whole = Window.orderBy(F.desc("blk")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("head", F.coalesce(F.lag("blk").over(down), F.last("blk").over(whole)).alias("also"))
    rows = docs.withColumn("sid", sid).withColumn("blk", block).join(F.broadcast(heads), F.col("sid") == F.col("head"), "left")  # at most one row a block
    places = F.filter(F.array(F.struct(F.col("blk").alias("blk"), F.lit(0).alias("copy")), F.struct(F.col("also").alias("blk"), F.lit(1).alias("copy"))), lambda p: p["blk"].isNotNull())
    rows = rows.select("doc_id", "sid", "text", "fp", F.xxhash64("text").alias("tie"), F.explode(places).alias("p")).select("doc_id", "sid", "text", "fp", "tie", "p.*")
    order = Window.partitionBy("blk").orderBy("copy", F.desc("sid"), "tie", "text")
    return rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_fp", F.lead("fp").over(order)).filter("copy = 0").select("doc_id", "text", "fp", "next_text", "next_fp")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited form, and their likenesses.

    The edited text keeps the first half of the code points (the larger, if odd) and ends with as many of the next
    document's first ones as it lost. Null counts as empty; a text without words has an all-empty fingerprint; a table of one
    row follows itself; repeated rows follow each other; an empty table gives an empty result.
    """
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    near = with_next(with_fingerprint(t, "text", "fp")).withColumn("n", F.char_length("text").cast("long"))
    half = F.floor(F.col("n") / 2).cast("int")
    edited = near.withColumn("edited", F.concat(F.left("text", F.col("n").cast("int") - half), F.left("next_text", half)))
    edited = edited.select("doc_id", "n", "fp", "next_fp", "edited", F.sha2("edited", 256).alias("edited_sha256"))
    both = with_fingerprint(edited, "edited", "efp")
    return both.select(
        "doc_id", F.col("n").alias("n_chars"), "edited_sha256", written("fp").alias("fingerprint"), written("efp").alias("edited_fingerprint"),
        likeness("fp", "efp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
    )
