"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

All in SQL functions. A pattern's spans come from ``split`` (the stretches between matches) beside
``regexp_extract_all`` (the matches): both walk the text with the same matcher, so running lengths give the offsets in
code points. The patterns use possessive repeats and start a run only at its beginning (or where the last match
ended), which finds the same matches as the plain forms and stays linear on long runs.

Base kinds: email, ip (parts at most 255), card (13 to 19 digits, Luhn), phone (9 to 15 digits). A base match that its
validator refuses is dropped and not tried again. Base spans are always kept.

Added kinds: ``iban`` (length 15 to 34, mod 97 = 1), ``localphone`` (a number without country code) and ``secret`` (32 to 64
hex digits, of at least ``VARIED`` different ones). Each carries a score: the pattern's prior, plus the validator's weight,
plus a weight when a context word stands within ``REACH`` characters before it. A span is added at a score of at least
``ACCEPT`` when it overlaps no base span.

The work on one text grows as its length: offsets are added up in blocks of matches, a context is taken from the stretches
just before its match, and overlaps are found by halving.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCEPT = 0.6
REACH = 40
BLOCK = 512  # matches whose offsets are added up in one array
VARIED = 8

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"
LOCAL = r"(?<![0-9+.-])\(?[0-9]{3,4}\)?[\x20./-][0-9]{3}[\x20.-][0-9]{3,4}(?![0-9.-])"
SECRET = r"(?<![A-Za-z0-9])[0-9a-f]{32,64}+(?![A-Za-z0-9])"

PHONE_WORDS = r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|telefon|anruf|handy|téléphone|appelez|teléfono|llame|móvil)\b"
BANK_WORDS = r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b"
SECRET_WORDS = r"(?i)(?<![a-z])(?:token|secret|password|passwd|credential|api[_-]?key)s?(?![a-z])"

KINDS = ["email", "ip", "card", "phone", "iban", "localphone", "secret"]
ADDED = KINDS[4:]


def block_starts(found: Column, gaps: Column) -> Column:
    """Offset in code points at which each block of ``BLOCK`` matches begins, its first gap included."""
    none = F.array().cast("array<int>")
    blocks = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int"))).otherwise(none)
    length = lambda i: F.char_length(F.get(gaps, i)) + F.char_length(F.get(found, i))
    lengths = F.transform(blocks, lambda b: F.aggregate(_within(found, b), F.lit(0), lambda acc, i: acc + length(i)))
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
    add = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(lengths, zero, add, lambda acc: acc["out"])


def _within(found: Column, b: Column) -> Column:
    return F.sequence(b * BLOCK, F.least(F.size(found), (b + 1) * BLOCK) - 1)


def spans(found: Column, gaps: Column, starts: Column, context: bool = False) -> Column:
    """Matches as structs (s, e, m) in text order; s and e count code points. With ``context`` also w, the characters before.

    ``found``, ``gaps`` and ``starts`` must be plain columns: a lambda would work an expression out anew at every step.
    """
    kind = "array<struct<s:int,e:int,m:string,w:string>>" if context else "array<struct<s:int,e:int,m:string>>"

    def add(acc: Column, i: Column) -> Column:
        m = F.get(found, i)
        start = acc["at"] + F.char_length(F.get(gaps, i))
        end = start + F.char_length(m)
        more = [_before(found, gaps, i).alias("w")] if context else []
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), end.alias("e"), m.alias("m"), *more))).alias("out"))

    def block(b: Column) -> Column:
        zero = F.struct(F.get(starts, b).alias("at"), F.array().cast(kind).alias("out"))
        return F.aggregate(_within(found, b), zero, add, lambda acc: acc["out"])

    blocks = F.when(F.size(starts) > 0, F.sequence(F.lit(0), F.size(starts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(blocks, block))


def _before(found: Column, gaps: Column, i: Column) -> Column:
    """The last ``REACH`` characters before match i; the added kinds' matches are over 10 characters, so four go back enough."""
    last = lambda x: F.substring(F.coalesce(x, F.lit("")), -REACH, REACH)
    parts = [last(F.get(x, i - k)) for k in (4, 3, 2, 1) for x in (gaps, found)]
    return F.substring(F.concat(*parts, last(F.get(gaps, i))), -REACH, REACH)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Luhn's checksum over a string of digits."""
    n = F.length(number)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """The check of an account number: the first four characters go to the end, letters count 10 to 35."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def add(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _clear(span: Column, kind: str) -> Column:
    """Whether no span of the column ``kind`` overlaps this one: the first that ends after its start is found by halving."""

    def halve(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        after, todo = F.get(F.col(kind), mid)["e"] > span["s"], acc["lo"] < acc["hi"]
        return F.struct(F.when(todo & ~after, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(todo & after, mid).otherwise(acc["hi"]).alias("hi"))

    ends = F.struct(F.lit(0).alias("lo"), F.size(kind).alias("hi"))
    first = F.aggregate(F.sequence(F.lit(1), F.lit(31)), ends, halve, lambda acc: F.get(F.col(kind), acc["lo"])["s"])
    return (F.size(kind) == 0) | F.coalesce(first >= span["e"], F.lit(True))


def pii(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, one array of spans (s, e, m) per kind, and ``scored``: added spans with kind and score.

    Null text counts as empty and has no spans. Rows are judged one by one, so repeated rows, ties and null keys each
    give their own row; an empty table gives an empty result. Only ``key`` and ``text`` are read.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    doc = docs.select(F.col(key).alias(key), t.alias("t"), t.rlike("[0-9]").alias("digit"))
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "localphone": LOCAL, "secret": SECRET}
    none = F.array().cast("array<string>")
    may = {k: F.col("t").contains("@") if k == "email" else F.col("t").contains("+") if k == "phone" else F.col("digit") for k in patterns}
    cut = doc.select(
        key,
        "t",
        *[F.when(may[k], F.regexp_extract_all("t", F.lit(p), F.lit(0))).otherwise(none).alias(f"{k}_m") for k, p in patterns.items()],
    )
    cut = cut.select("*", *[F.when(F.size(f"{k}_m") > 0, F.split("t", p, -1)).otherwise(none).alias(f"{k}_g") for k, p in patterns.items()])
    cut = cut.select("*", *[block_starts(F.col(f"{k}_m"), F.col(f"{k}_g")).alias(f"{k}_s") for k in patterns])
    raw = cut.select(key, *[spans(*[F.col(f"{k}_{x}") for x in "mgs"], context=k in ADDED).alias(k) for k in patterns])
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    sure = raw.select(
        key,
        "email",
        F.filter("ip", lambda x: x["m"].rlike(rf"^{part}\.{part}\.{part}\.{part}$")).alias("ip"),
        F.transform("card", _with_digits).alias("card"),
        F.filter("phone", lambda x: F.length(digits(x["m"])).between(9, 15)).alias("phone"),
        F.filter(F.transform("iban", _with_code), lambda x: F.length(x["d"]).between(15, 34)).alias("iban"),
        "localphone",
        "secret",
    )
    cards = F.filter("card", lambda x: F.length(x["d"]).between(13, 19) & luhn(x["d"]))
    sure = sure.select(key, "email", "ip", cards.alias("card"), "phone", "iban", "localphone", "secret")

    def judged(kind: str, words: str, prior: float, valid: Callable[[Column], Column] | None = None) -> Column:
        def one(x: Column) -> Column:
            score = prior + F.when(x["w"].rlike(words), 0.3).otherwise(0.0)
            if valid is not None:
                score = score + F.when(valid(x), 0.5).otherwise(0.0)
            return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), score.alias("score"))

        return F.transform(kind, one)

    varied = F.filter("secret", lambda x: F.size(F.array_distinct(F.split(x["m"], ""))) >= VARIED)
    sure = sure.withColumn("secret", varied)
    scored = sure.withColumn("scored", F.concat(judged("iban", BANK_WORDS, 0.2, lambda x: mod97(x["d"])), judged("localphone", PHONE_WORDS, 0.4), judged("secret", SECRET_WORDS, 0.4)))
    free = lambda x: (x["score"] >= ACCEPT) & _clear(x, "email") & _clear(x, "ip") & _clear(x, "card") & _clear(x, "phone")
    return scored.select(key, *KINDS[:4], F.filter("scored", free).alias("scored"))


def _with_digits(x: Column) -> Column:
    return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), digits(x["m"]).alias("d"))


def _with_code(x: Column) -> Column:
    return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), x["w"].alias("w"), F.replace(x["m"], F.lit(" "), F.lit("")).alias("d"))


def _written(kind: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.concat_ws(":", F.lit(kind), x["s"], x["e"]))


def _of_kind(kind: str) -> Column:
    return F.filter("scored", lambda x: x["kind"] == kind)


def pii_digest(docs: DataFrame) -> DataFrame:
    """The spans of each document as counts, one digest of the base spans, and one string of all."""
    found = pii(docs)
    base = F.concat(*[_written(k, F.col(k)) for k in KINDS[:4]])
    added = F.concat(*[_written(k, _of_kind(k)) for k in ADDED])
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, added), ",").alias("spans"),
        F.size("scored").cast("long").alias("n_added"),
    )
