"""Secrets in texts: fixed formats and sliding-window entropy, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The formats of the base kinds, in the order in which ties are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")
#: Least lengths: of an assigned value, an access key, a hex run.
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

#: What a candidate may not touch on either side, if its class is narrower than this.
_APART = (r"(?<![A-Za-z0-9+/_-])", r"(?![A-Za-z0-9+/_-])")
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Character classes of candidates: name, run of characters, what a run must hold, alphabet, least bits a character.
CLASSES = (
    ("hex", _APART[0] + r"[0-9A-Fa-f]{20,}+" + _APART[1], r"[0-9]", _DIGITS + "abcdefABCDEF", 3.0),
    ("base64", r"[A-Za-z0-9+/_-]{20,}+={0,2}", r"^(?=[^0-9]*[0-9])(?=[^a-z]*[a-z])(?=[^A-Z]*[A-Z])", _UPPER + _LOWER + _DIGITS + "+/_-=", 3.8),
    ("base36", _APART[0] + r"[a-z0-9]{20,}+" + _APART[1], r"^(?=(?:[^0-9]*[0-9]){3})(?=(?:[^a-z]*[a-z]){3})(?=[^g-z]*[g-z])", _LOWER + _DIGITS, 3.5),
    ("base32", _APART[0] + r"[A-Z0-9]{20,}+" + _APART[1], r"^(?=(?:[^0-9]*[0-9]){2})(?=(?:[^A-Z]*[A-Z]){3})(?=[^G-Z]*[G-Z])", _UPPER + _DIGITS, 3.4),
)
#: Characters a window.
WINDOW = 20
#: Candidates that look random and are not secret: sample keys, placeholders, alphabets, UUIDs, paths and names of words.
ALLOW = (
    r"(?i)example|sample|placeholder|changeme|xxxxx|your[_-]",
    r"(?i)abcdefghij|0123456789|qwertyuiop",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^(?:/?[A-Za-z]++[0-9]{0,4}+[/_-])++[A-Za-z]*+[0-9]{0,4}+$",
)


def match_spans(text: Column, pattern: str, group: int = 0, least_length: int = 0) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points.

    The pieces between matches and the matches alternate, so running lengths give the places.
    Matches whose ``group`` is shorter than ``least_length`` are dropped. Texts without a match are
    not cut up at all.
    """
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(F.transform(pieces, lambda x: F.length(x)).alias("gap"), whole.alias("m"), part.alias("g"))
    start = F.struct(F.lit(0).alias("pos"), F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)").alias("out"))

    def step(a, x):
        begin = a["pos"] + x["gap"]
        end = begin + F.coalesce(F.length(x["m"]), F.lit(0))
        here = F.array(F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("value")))
        good = x["m"].isNotNull() & (F.length(x["g"]) >= least_length)
        return F.struct(end.alias("pos"), F.when(good, F.concat(a["out"], here)).otherwise(a["out"]).alias("out"))

    spans = F.aggregate(zipped, start, step, lambda a: a["out"])
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(none)


def window_entropy(value: Column, alphabet: str, bits: float, window: int = WINDOW) -> Column:
    """struct<first, last>: the part of ``value`` covered by windows of at least ``bits`` a character; nulls if none is.

    One pass over the run's codes and the same codes ``window`` later: the entering and the leaving
    character change two counts and, through them, the running sum of c*log2(c); the entropy of a
    window is log2(window) - sum / window. A character costs the same at any place of a run.
    """
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)

    def step(a, x):
        into, out = x["into"], F.coalesce(x["out"], F.lit(-1))
        same = into == out
        c_out, c_in = F.get(a["cnt"], F.greatest(out, F.lit(0))), F.get(a["cnt"], into)
        gone = F.when(same | (out < 0), 0.0).otherwise(F.get(weight, c_out) - F.get(weight, F.greatest(c_out - 1, F.lit(0))))
        come = F.when(same, 0.0).otherwise(F.get(weight, c_in + 1) - F.get(weight, c_in))
        return F.struct(
            F.when(same, a["cnt"]).otherwise(F.transform(a["cnt"], lambda c, k: c + F.when(k == into, 1).when(k == out, -1).otherwise(0))).alias("cnt"),
            (a["sum"] - gone + come).alias("sum"),
            (a["i"] + 1).alias("i"),
            a["first"].alias("first"), a["last"].alias("last"),
        )

    def mark(a):
        hit = (a["i"] >= window) & (F.lit(math.log2(window)) - a["sum"] / window >= bits - 1e-9)
        return F.struct(a["cnt"].alias("cnt"), a["sum"].alias("sum"), a["i"].alias("i"), F.when(hit & a["first"].isNull(), a["i"] - window).otherwise(a["first"]).alias("first"), F.when(hit, a["i"]).otherwise(a["last"]).alias("last"))

    none = F.lit(None).cast("int")
    zero = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("cnt"), F.lit(0.0).alias("sum"), F.lit(0).alias("i"), none.alias("first"), none.alias("last"))
    # Arrays of one element name what is used more than once, so that it is computed once.
    pairs = F.transform(F.array(codes), lambda c: F.slice(F.arrays_zip(c.alias("into"), F.concat(F.array_repeat(F.lit(-1), window), c).alias("out")), 1, F.size(c)))
    once = lambda a, x: F.get(F.transform(F.array(step(a, x)), mark), F.lit(0))
    return F.aggregate(F.get(pairs, F.lit(0)), zero, once, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))


def _class_spans(text: Column, run: str, holds: str, alphabet: str, bits: float) -> Column:
    allowed = "|".join(f"(?:{a})" for a in ALLOW)

    def cover(x):
        place = lambda e: F.struct((x["start"] + e["first"]).alias("start"), F.lit(3).alias("kind"), (x["start"] + e["last"]).alias("end"))
        return F.get(F.transform(F.array(window_entropy(x["value"], alphabet, bits)), place), F.lit(0))

    random = F.filter(match_spans(text, run), lambda x: F.rlike(x["value"], F.lit(holds)) & ~F.rlike(x["value"], F.lit(allowed)))
    return F.filter(F.transform(random, cover), lambda x: x["start"].isNotNull())


def _entropy_spans(text: Column) -> Column:
    return F.array_distinct(F.concat(*[_class_spans(text, *c[1:]) for c in CLASSES]))


def find_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``secret_spans`` to every row: array<struct<start, kind, end>> by start, then kind as in KINDS; code points, end exclusive.

    Base kinds: assignments of a value of 6 or more characters, access keys of 20 or more, hex runs of
    24 or more, each leftmost and without overlap within its kind. The entropy kind covers the parts
    of candidate runs whose sliding windows are random enough for their character class, unless an
    allow-list pattern names the run; it never removes a base span, and overlaps base spans freely.
    Null text counts as empty and gives an empty array. Each row is read by itself, so null ids, ties
    and repeated rows change nothing; other columns stay and an equally named one is replaced; an empty
    table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def base(kind: int, *args, **kw):
        return F.transform(match_spans(text, *args, **kw), lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    spans = F.concat(
        base(0, ASSIGN, group=2, least_length=MIN_VALUE),
        # Shorter matches of these two hide no longer ones, so only long ones are looked for.
        base(1, ACCESS[:-1] + f"{{{MIN_ACCESS - 4},}}"),
        base(2, HEX[:-1] + f"{{{MIN_HEX},}}"),
        _entropy_spans(text),
    )
    return docs.withColumn("secret_spans", F.array_sort(spans))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and span texts of ``find_secrets`` for each row."""
    names = F.array(*map(F.lit, KINDS))
    words = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("secret_spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        id_col, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(words(F.filter("secret_spans", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        words(F.col("secret_spans")).alias("spans"),
    )
