"""Secret scans with DataFrame functions only.

Three known kinds are matched by pattern.  Further candidates, long runs of characters
that keys are written in, are judged by the Shannon entropy of a window that slides over
them: the counts of the window's characters change by one in and one out at a time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans with equal starts are listed.
KINDS = ["assign", "access", "hex", "entropy"]

# Fixed patterns of the known kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: Candidates: runs of at least WINDOW such characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Characters of a window, and the entropy in bits that a window of the class must reach.
WINDOW = 20
HEX_BITS, BASE_BITS = 3.0, 3.7
#: Candidates that are no secrets as a whole: words, numbers, paths, rules.
ALLOWED = [
    r"^[A-Za-z]+$",
    r"^[0-9]+$",
    r"^[A-Z]?[a-z]+([-_/][A-Z]?[a-z]+)*$",
    r"^[-_=+/]+$",
]
#: Parts that are cut out of a candidate, each of a fixed length: what is left of it is judged by itself.
CUT = {
    r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9A-Za-z])": 36,
    r"(?<![0-9A-Za-z])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z])": 10,
    "(?i)example": 7, "(?i)sample": 6, "(?i)placeholder": 11, "(?i)changeme": 8, "(?i)dummy": 5, "(?i)xxxxx": 5, "00000": 5, "12345": 5,
}
#: Matches whose places are summed up in one go; so many texts' matches cost as many steps, not their square.
BLOCK = 256

_SCALE = 1_000_000


def _term(c: int) -> int:
    """c * log2(c) as a whole number of millionths, so that windows add up exactly."""
    return round(c * math.log2(c) * _SCALE) if c else 0


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def _spans(text: Column, pattern: str, group: int | None = None, least: int = 0) -> Column:
    """Array of (s, e, v): code points of each leftmost match, and the match's group ``group``.

    Matches and the text between them alternate, so a match starts after the lengths of
    what precedes it.  Matches whose group is shorter than ``least`` are dropped after
    matching, as their text is used up.
    """
    found = F.regexp_extract_all(text, F.lit(pattern if group is not None else f"({pattern})"), F.lit(0 if group is not None else 1))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group is not None else found
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,v:string>>").alias("out"))
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")

    def step(acc: Column, m: Column) -> Column:
        s = acc["at"] + m["g"]
        e = s + F.char_length(m["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), m["v"].alias("v")))).alias("out"))

    def placed(matches: Column) -> Column:
        """Blocks count from their own start and are then moved to where the one before ends."""
        firsts = F.sequence(F.lit(1), F.greatest(F.size(matches), F.lit(1)), F.lit(BLOCK))
        blocks = F.transform(firsts, lambda i: F.aggregate(F.slice(matches, i, F.lit(BLOCK)), start, step))

        def join(acc: Column, b: Column) -> Column:
            there = F.transform(b["out"], lambda x: F.struct((x["s"] + acc["at"]).alias("s"), (x["e"] + acc["at"]).alias("e"), x["v"].alias("v")))
            return F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(there)).alias("out"))

        nested = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<s:int,e:int,v:string>>>").alias("out"))
        return F.flatten(F.aggregate(blocks, nested, join, lambda acc: acc["out"]))

    spans = _let(F.arrays_zip(found.alias("m"), values.alias("v"), F.slice(gaps, 1, F.size(found)).alias("g")), placed)
    if least:
        spans = F.filter(spans, lambda x: F.char_length(x["v"]) >= least)
    return F.when(text.rlike(pattern), spans).otherwise(none)


def _without(text: Column, pattern: str, group: int | None = None, least: int = 0) -> Column:
    """The text with as many spaces in the place of each match; matches whose group is shorter than ``least`` stay."""
    found = F.regexp_extract_all(text, F.lit(pattern if group is not None else f"({pattern})"), F.lit(0 if group is not None else 1))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group is not None else found
    blank = lambda m: F.when(F.char_length(m["v"]) >= least, F.repeat(F.lit(" "), F.char_length(m["m"]))).otherwise(m["m"])
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.transform(F.arrays_zip(found.alias("m"), values.alias("v")), blank).alias("b"))
    return F.when(text.rlike(pattern), F.array_join(F.flatten(F.transform(parts, lambda x: F.array(x["g"], F.coalesce(x["b"], F.lit(""))))), "")).otherwise(text)


def _window_bits(value: Column, alphabet: str) -> Column:
    """The greatest entropy, in bits, of any window of ``value`` over the characters of ``alphabet``.

    State: a count for each character, the sum of count * log2(count), the least sum so
    far.  A sum falls as the entropy rises.  Characters outside the alphabet count as one more.
    """
    size = len(alphabet) + 1
    terms = F.array(*[F.lit(_term(c)).cast("long") for c in range(WINDOW + 1)])
    symbol = lambda c: F.pmod(F.instr(F.lit(alphabet), c) + F.lit(size - 1), F.lit(size))
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), symbol)

    def moved(acc: Column, code: Column, by: int) -> Column:
        def counted(before: Column) -> Column:
            n = F.concat(F.slice(acc["n"], F.lit(1), code), F.array(before + by), F.slice(acc["n"], code + 2, F.lit(size)))
            return F.struct(n.alias("n"), (acc["t"] + F.get(terms, before + by) - F.get(terms, before)).alias("t"))

        return _let(F.get(acc["n"], code), counted)

    def step(acc: Column, x: Column) -> Column:
        def seen(slid: Column) -> Column:
            k = acc["k"] + 1
            least = F.when(k >= WINDOW, F.least(acc["least"], slid["t"])).otherwise(acc["least"])
            return F.struct(slid["n"].alias("n"), slid["t"].alias("t"), k.alias("k"), least.alias("least"))

        return _let(_let(moved(acc, x["new"], 1), lambda grown: F.when(x["old"].isNotNull(), moved(grown, x["old"], -1)).otherwise(grown)), seen)

    zero = F.struct(F.array_repeat(F.lit(0), size).alias("n"), F.lit(0).cast("long").alias("t"), F.lit(0).alias("k"), F.lit(_term(WINDOW)).cast("long").alias("least"))
    # The array is bound first, else it would be made again for each of its items.
    pairs = _let(codes, lambda all_: F.transform(all_, lambda c, i: F.struct(c.alias("new"), F.get(all_, i - WINDOW).alias("old"))))
    least = F.aggregate(pairs, zero, step, lambda acc: acc["least"])
    return (F.lit(_term(WINDOW)) - least) / F.lit(_SCALE * WINDOW)


HEX_ALPHABET = "0123456789abcdef"
BASE_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def secret_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``found``: an array of (s, k, e, v), by start and then kind.

    ``s`` and ``e`` are code points, the end exclusive, ``k`` an index into ``KINDS`` and
    ``v`` what was matched (an assignment's value).  A null text is empty.  Known kinds
    may overlap each other.  Entropy spans are sought in what is left of the text when
    known kinds, and the parts of ``CUT``, are taken out: a run that holds such a part is
    judged by the rest of it.  Columns whose names start with ``_secret`` are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = _without(_without(_without(text, ASSIGN, 2, 6), ACCESS), HEX)
    for pattern, length in CUT.items():
        rest = F.regexp_replace(rest, pattern, " " * length)
    docs = docs.withColumns({"_secret_assign": _spans(text, ASSIGN, 2, 6), "_secret_access": _spans(text, ACCESS), "_secret_hex": _spans(text, HEX), "_secret_rest": F.when(text.rlike(CANDIDATE), rest).otherwise(F.lit(""))})
    docs = docs.withColumn("_secret_runs", _spans(F.col("_secret_rest"), CANDIDATE))
    allowed = lambda v: _any([v.rlike(p) for p in ALLOWED])
    fresh = F.filter("_secret_runs", lambda r: ~allowed(r["v"]) & r["v"].rlike("[0-9]") & r["v"].rlike("[A-Za-z]"))
    is_hex = lambda v: F.lower(v).rlike("^[0-9a-f]+$")
    high = F.filter(fresh, lambda r: F.when(is_hex(r["v"]), _window_bits(F.lower(r["v"]), HEX_ALPHABET) >= HEX_BITS).otherwise(_window_bits(r["v"], BASE_ALPHABET) >= BASE_BITS))

    def listed(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda r: F.struct(r["s"].alias("s"), F.lit(kind).alias("k"), r["e"].alias("e"), r["v"].alias("v")))

    return docs.withColumn("found", F.array_sort(F.concat(listed(F.col("_secret_assign"), 0), listed(F.col("_secret_access"), 1), listed(F.col("_secret_hex"), 2), listed(high, 3)))).drop("_secret_assign", "_secret_access", "_secret_hex", "_secret_rest", "_secret_runs")


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def span_list(found: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"], x["e"])), ",")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of the known kinds, a digest of their spans, and all spans.

    The values found are not returned.
    """
    found = secret_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    base = F.filter("found", lambda x: x["k"] < 3)
    n = lambda k: F.size(F.filter("found", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("found")).alias("spans"), n(3).alias("n_entropy")
    )
