"""URL filter by path-template trees.

Every host's paths form a tree of segments. Level by level, a place that takes many different values is variable: its
rare segments become wildcards by their shape (a run of digits is N, a run of letters W), and only segments that hold a
good share of the place stay literal. What a path turns into is its template. Templates of a host that differ in one
literal only are siblings; those whose share of bad labels is statistically like that of the siblings together are merged
for the judgement. A template is rejected when its share of bad labels, smoothed towards its host's and the host's
towards all, is high. A template with too few labels of its own takes the verdict of its siblings, labelled or not, or
that of the nearest node above it with enough of them. Rules given by hand come before the trees.

Trees are built from distinct (host, path) with counts, pre-aggregated before the shuffle. Joins back to the rows spread
a hot host over tasks. A round serves only places where many paths branch: shared segments are taken in one step, and a
path whose place holds too few paths to vary leaves with its rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.graph import spread_join
from riskframe.session import stage

VARIED = 8  # different segments that make a place variable,
SPREAD = 0.2  # if they are at least this share of its paths
LITERAL = 0.05  # share of a variable place that keeps a segment literal
ALIKE = 2.0  # standard errors within which siblings are merged
PRIOR = 4.0  # pseudo-labels
REJECT = 0.5
LEAST = 3  # labels below which a template is never rejected

ROUNDS = 20  # parts of ended paths that are put into one table

# fixed values: the rules of the query
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def parse(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first "://" with A-Z lower-cased, path up to "?" or "#"; empty without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the URL's or above it and whose path begins the URL's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def shape(segment: Column) -> Column:
    """Runs of digits as N, runs of letters as W; other characters stay."""
    return F.concat(F.lit("*"), F.regexp_replace(F.regexp_replace(segment, r"[0-9]+", "N"), r"[^\W\d_N]+|(?<![*])N(?=[a-z])", "W"))


def _shared_beginning(low: Column, high: Column) -> Column:
    """Number of leading elements that two arrays share."""
    at = F.array_position(F.zip_with(low, high, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(at == 0, F.size(low)).otherwise(at - 1).cast("int")


def templates(paths: DataFrame) -> DataFrame:
    """(host, path, template) of distinct paths with their counts ``n``.

    Paths at one place with fewer than ``VARIED`` of them can never vary further down: they keep their rest and leave. The
    others go on by the segments that all paths of their place share, and one more. So a path takes part in as many rounds as it
    has places where ``VARIED`` paths or more branch, not as many as it has segments.
    """
    place = F.xxhash64("host", "template")
    join = lambda segs: F.concat(F.lit("/"), F.array_join(segs, "/"))
    now = stage(paths.select("host", "path", "n", F.split(F.regexp_replace("path", "^/", ""), "/", -1).alias("segs"), F.lit("").alias("template")))
    done = []
    while not now.isEmpty():
        # the least and the greatest rest of a place share what all its rests share
        spots = now.groupBy("host", "template").agg(F.count("*").alias("paths"), F.min("segs").alias("low"), F.max("segs").alias("high"))
        spots = spots.select(place.alias("place"), "paths", _shared_beginning(F.col("low"), F.col("high")).alias("same"))
        spots = spots.groupBy("place").agg(F.max("paths").alias("paths"), F.min("same").alias("same"))
        now = spread_join(now.withColumn("place", place), spots, "place", F.col("path")).drop("place")
        some = F.when(F.col("paths") < VARIED, F.size("segs")).otherwise(F.col("same"))
        now = now.withColumn("template", F.when(some > 0, F.concat("template", join(F.slice("segs", F.lit(1), some)))).otherwise(F.col("template")))
        now = now.withColumn("segs", F.slice("segs", some + 1, F.greatest(F.size("segs") - some, F.lit(0)))).drop("paths", "same")
        now = stage(now)
        done.append(now.filter(F.size("segs") == 0))
        here = now.filter(F.size("segs") > 0).withColumn("seg", F.get("segs", F.lit(0)))
        places = here.groupBy("host", "template", "seg").agg(F.sum("n").alias("n"), F.count("*").alias("paths"))
        whole = places.groupBy("host", "template").agg(F.sum("n").alias("rows"), F.sum("paths").alias("paths"), F.count("*").alias("kinds"))
        variable = whole.filter((F.col("kinds") >= VARIED) & (F.col("kinds") >= SPREAD * F.col("paths")))
        variable = variable.select(place.alias("place"), F.col("host").alias("h"), F.col("template").alias("t"), "rows")
        kept = spread_join(places.withColumn("place", place), variable, "place", F.col("seg")).filter((F.col("host") == F.col("h")) & (F.col("template") == F.col("t")) & (F.col("n") >= LITERAL * F.col("rows")))
        kept = kept.select(F.xxhash64("host", "template", "seg").alias("branch"))
        marked = spread_join(here.withColumn("place", place), variable.select("place", F.lit(1).alias("varies")).distinct(), "place", F.col("path"), "left")
        marked = spread_join(marked.withColumn("branch", F.xxhash64("host", "template", "seg")), kept.select("branch", F.lit(1).alias("stays")).distinct(), "branch", F.col("path"), "left")
        step = F.when(F.col("varies").isNull() | F.col("stays").isNotNull(), F.concat(F.lit("/"), F.col("seg"))).otherwise(F.concat(F.lit("/"), shape(F.col("seg"))))
        rest = F.slice("segs", F.lit(2), F.greatest(F.size("segs") - 1, F.lit(0)))
        now = stage(marked.select("host", "path", "n", rest.alias("segs"), F.concat("template", step).alias("template")))
        done.append(now.filter(F.size("segs") == 0))
        now = now.filter(F.size("segs") > 0)
        if len(done) >= ROUNDS:
            done = [stage(reduce(DataFrame.unionAll, done))]
    return reduce(DataFrame.unionAll, done, now).select("host", "path", "n", "template")


def judged_templates(labelled: DataFrame) -> DataFrame:
    """(host, template, bad, n, purity, rejected) from rows (host, template, y), y = 1 for a bad page."""
    own = labelled.groupBy("host", "template").agg(F.sum("y").cast("double").alias("bad"), F.count("*").cast("double").alias("n"))
    every = labelled.agg(F.sum("y").alias("bad"), F.count("*").alias("n")).first()
    common = ((every["bad"] or 0) + 1) / (every["n"] + 2)
    hosts = own.groupBy("host").agg(F.sum("bad").alias("hb"), F.sum("n").alias("hn"))
    hosts = hosts.select(F.col("host").alias("ph"), ((F.col("hb") + PRIOR * common) / (F.col("hn") + PRIOR)).alias("prior"))
    # siblings: equal but for one literal; a template belongs to one family per literal it holds
    parts = F.split("template", "/", -1)
    family = own.select("host", "template", "bad", "n", F.posexplode(parts).alias("i", "part")).filter("part <> '' AND NOT part LIKE '*%'")
    family = family.withColumn("kin", F.array_join(F.transform(F.split("template", "/", -1), lambda x, j: F.when(j == F.col("i"), "?").otherwise(x)), "/"))
    # those above and below the family's common rate are pooled apart, and a template joins its side if it is like it
    whole = family.groupBy("host", "kin").agg((F.sum("bad") / F.sum("n")).alias("rate")).withColumnsRenamed({"host": "h", "kin": "k"})
    family = family.join(whole, (F.col("host") == F.col("h")) & (F.col("kin") == F.col("k"))).withColumn("high", F.col("bad") / F.col("n") > F.col("rate")).drop("h", "k", "rate")
    side = family.groupBy("host", "kin", "high").agg(F.sum("bad").alias("kb"), F.sum("n").alias("kn"), F.count("*").alias("members")).filter("members > 1")
    side = side.withColumnsRenamed({"host": "h", "kin": "k", "high": "hi"})
    alike = family.join(side, (F.col("host") == F.col("h")) & (F.col("kin") == F.col("k")) & (F.col("high") == F.col("hi")))
    rate = (F.col("kb") + 1) / (F.col("kn") + 2)
    far = F.abs(F.col("bad") / F.col("n") - rate) / F.sqrt(rate * (1 - rate) / F.col("n"))
    alike = alike.filter(far <= ALIKE).select("host", "template", F.concat_ws(" ", "kin", "high").alias("kin"), "bad", "n")
    merged = alike.groupBy("host", "kin").agg(F.sum("bad").alias("mb"), F.sum("n").alias("mn")).withColumnsRenamed({"host": "h2", "kin": "k2"})
    best = alike.join(merged, (F.col("host") == F.col("h2")) & (F.col("kin") == F.col("k2"))).groupBy(F.col("host").alias("mh"), F.col("template").alias("mt")).agg(F.max(F.struct("mn", "mb")).alias("pool"))
    out = own.join(best, (F.col("host") == F.col("mh")) & (F.col("template") == F.col("mt")), "left").join(hosts, F.col("host") == F.col("ph"))
    bad, n = F.coalesce("pool.mb", "bad"), F.coalesce("pool.mn", "n")
    purity = (bad + PRIOR * F.col("prior")) / (n + PRIOR)
    return out.select("host", "template", bad.alias("bad"), n.alias("n"), purity.alias("purity"), ((purity >= REJECT) & (n >= LEAST)).alias("rejected"))


def inherited_templates(known: DataFrame, labelled: DataFrame, judged: DataFrame) -> DataFrame:
    """(host, template, bad, n, purity, rejected) of the templates ``known`` (host, template) that ``judged`` has too few labels for.

    bad and n are the labels that decide: those of the largest family of siblings with ``LEAST`` of them, else of the nearest
    node above, the host's root at last. Own labels, if there are any, are smoothed towards these labels' purity.
    """
    own = stage(labelled.groupBy("host", "template").agg(F.sum("y").cast("double").alias("bad"), F.count("*").cast("double").alias("n")))
    every = own.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    common = ((every["bad"] or 0) + 1) / ((every["n"] or 0) + 2)
    hosts = own.groupBy("host").agg(((F.sum("bad") + PRIOR * common) / (F.sum("n") + PRIOR)).alias("prior"))
    enough = judged.filter(F.col("n") >= LEAST).select("host", "template")
    need = known.join(enough, ["host", "template"], "left_anti").select("host", "template")
    need = stage(spread_join(need, hosts, "host", F.col("template")))

    def at(rows: DataFrame, above: bool) -> DataFrame:
        """Each row with the families that it belongs to, or the nodes above it."""
        parts = F.split("template", "/", -1)
        rows = rows.select("*", F.posexplode(parts).alias("i", "part"))
        if above:
            return rows.filter("i > 0").withColumn("node", F.array_join(F.slice(parts, F.lit(1), F.col("i")), "/"))
        kin = F.array_join(F.transform(parts, lambda x, j: F.when(j == F.col("i"), "?").otherwise(x)), "/")
        return rows.filter("part <> '' AND NOT part LIKE '*%'").withColumn("node", kin)

    def sums(above: bool) -> DataFrame:
        counts = at(own, above).groupBy("host", "node").agg(F.sum("bad").alias("nb"), F.sum("n").alias("nn")).filter(F.col("nn") >= LEAST)
        met = spread_join(at(need, above).select("host", "template", "node", "i"), counts, ["host", "node"], F.col("template"))
        first = F.struct("i", "nn", "nb") if above else F.struct("nn", "nb")
        return met.groupBy("host", "template").agg(F.max(first).alias("up" if above else "kin"))

    out = need.join(sums(False), ["host", "template"], "left").join(sums(True), ["host", "template"], "left").join(own, ["host", "template"], "left")
    bad, n = F.coalesce("kin.nb", "up.nb"), F.coalesce("kin.nn", "up.nn")
    purity = (bad + PRIOR * F.col("prior")) / (n + PRIOR)
    purity = F.coalesce((F.col("bad") + PRIOR * purity) / (F.col("n") + PRIOR), purity)
    return out.filter(n.isNotNull()).select("host", "template", bad.alias("bad"), n.alias("n"), purity.alias("purity"), (purity >= REJECT).alias("rejected"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """Every page's page_id, host, path, rule, verdict and template.

    ``pages`` has page_id and url, ``labels`` page_id and y (1: bad); pages labelled twice count as bad if one says so. A
    null url, or one without "://", has an empty host and path, and the template of the empty path. A page without a
    rule is blocked when its template is rejected, else allowed; on hosts with fewer than ``LEAST`` labels all such are
    allowed. Repeated rows are judged alike and stay; an empty table gives an empty result.
    """
    host, path = parse(F.col("url").cast("string"))
    rows = stage(pages.select(F.col("page_id").alias("page_id"), host.alias("host"), path.alias("path")))
    tree = templates(rows.groupBy("host", "path").agg(F.count("*").alias("n")))
    tree = stage(tree.select(F.xxhash64("host", "path").alias("at"), F.col("host").alias("th"), F.col("path").alias("tp"), "template"))
    # a path seen very often is one row of the tree and many rows of the table
    placed = spread_join(rows.withColumn("at", F.xxhash64("host", "path")), tree, "at", F.col("page_id")).filter((F.col("host") == F.col("th")) & (F.col("path") == F.col("tp")))
    placed = stage(placed.select("page_id", "host", "path", "template"))
    marks = labels.filter("page_id IS NOT NULL AND y IN (0, 1)").groupBy(F.col("page_id").alias("lp")).agg(F.max("y").alias("y"))
    labelled = stage(placed.join(marks, F.col("page_id") == F.col("lp")).select("host", "template", "y"))
    judged = stage(judged_templates(labelled))
    known = tree.select(F.col("th").alias("host"), "template").distinct()
    out = judged.filter("rejected").unionByName(inherited_templates(known, labelled, judged).filter("rejected")).select(F.xxhash64("host", "template").alias("key"), F.col("host").alias("rh"), F.col("template").alias("rt"))
    keyed = placed.withColumn("key", F.xxhash64("host", "template"))
    # keys of two templates that collide would only widen the match, so the names are compared too
    hit = spread_join(keyed, out.groupBy("key").agg(F.collect_set(F.struct("rh", "rt")).alias("names")), "key", F.col("page_id"), "left")
    rejected = F.coalesce(F.exists("names", lambda x: (x["rh"] == F.col("host")) & (x["rt"] == F.col("template"))), F.lit(False))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    return hit.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, F.when(rejected, "block").otherwise("allow")).alias("verdict"), "template")
