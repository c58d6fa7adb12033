"""Personal data replaced by keyed surrogates, with DataFrame functions only.

A surrogate is made by a keyed permutation of the values that share the entity's format,
so no table of what was replaced is needed: the same entity gets the same surrogate in
every document (coreference), and two entities never get the same one (distinctness).

The permutation runs over the letters and digits of the entity forwards and backwards.
Each character moves within its own alphabet (digits; vowels or consonants of a script;
either case; else the letters of its stretch of code points) by a shift drawn from the
key, the kind and all characters before it.  Then every character moves by one, and both
passes are undone.  As a move by one leaves nothing in place, neither does the whole: no
entity is its own surrogate.  Separators stay and do not count, so a number keeps its
surrogate's digits however it is written.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import free_names

# Fixed patterns.
_B, _E = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_TITLE = "Mr|Mrs|Ms|Miss|Mister|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Señor|Señora|Sr|Sra|Dott|Г-н|Г-жа|г-н|г-жа"
#: A part of a name: an initial, or a word that may hold inner capitals and apostrophes; of scripts without capitals, any word.
_WORD = r"(?:\p{Lu}\.|[\p{Lu}\p{Lo}][\p{L}\p{M}]*(?:['’]\p{L}[\p{L}\p{M}]*)*)"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?(?:\.[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?)+",
    "iban": rf"{_B}[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,3}})?){_E}",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}])(?!\.[0-9])",
    "ssn": rf"(?<![\p{{L}}\p{{N}}-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![\p{{L}}\p{{N}}-])",
    "card": rf"{_B}(?:[0-9]{{13,19}}|[0-9]{{4}}(?:-[0-9]{{4}}){{3}}|[0-9]{{4}}(?: [0-9]{{4}}){{3}}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}}){_E}",
    "phone": rf"(?<![\p{{L}}\p{{N}}+])(?:\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)[ .-]?)?[0-9]{{2,4}}(?:[ .-]?[0-9]{{2,4}}){{1,4}}|\([0-9]{{3}}\)[ .-]?[0-9]{{3}}[ .-][0-9]{{4}}|[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}){_E}",
    "name": rf"(?<!\p{{L}})(?:{_TITLE})\.? {_WORD}(?:[ -]{_WORD})*+(?!\p{{L}})",
}
KINDS = list(PATTERNS)
#: What every entity holds: texts without it are passed on as they are.
_HINT = rf"[@0-9]|(?:{_TITLE})\.? [\p{{Lu}}\p{{Lo}}]"

# Fixed alphabets; for characters outside them see ``STRETCHES``.
ALPHABETS = [
    "0123456789",
    "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
    "áéíóúàèìòùâêîôûäëïöü", "ñç", "ÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜ", "ÑÇ",
    "ãåæõø", "ýþð", "ÃÅÆÕØ", "ÝÞÐ",
    "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
]
# Fixed stretches of code points that hold letters only; a character outside these too stays.
# Latin of Europe has its capitals and small letters apart by one, so it moves by twos.
STRETCHES = [
    (0x0100, 0x012F, 2), (0x0139, 0x0148, 2), (0x014A, 0x0177, 2), (0x0179, 0x017E, 2), (0x05D0, 0x05EA, 1), (0x0621, 0x063A, 1), (0x0905, 0x0939, 1), (0x0E01, 0x0E2E, 1),
    (0x10D0, 0x10FA, 1), (0x3041, 0x3096, 1), (0x30A1, 0x30FA, 1), (0x4E00, 0x9FFF, 1), (0xAC00, 0xD7A3, 1),
]
# Fixed pools of given names by gender and script.
NAMES = {
    "male_latin": ["James", "John", "Robert", "Michael", "William", "David", "Thomas", "Peter", "Hans", "Jean", "Pierre", "Carlos", "Luis"],
    "female_latin": ["Mary", "Anna", "Linda", "Susan", "Sarah", "Laura", "Julia", "Maria", "Claire", "Sophie", "Carmen", "Elena", "Ingrid"],
    "male_cyrillic": ["Иван", "Пётр", "Сергей", "Андрей", "Павел", "Олег", "Юрий"],
    "female_cyrillic": ["Анна", "Мария", "Ольга", "Елена", "Ирина", "Нина", "Вера"],
}
#: All alphabets in one text, each in a stretch of this many characters.
_STRETCH = 32
_GRID = "".join(a.ljust(_STRETCH) for a in ALPHABETS)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def _number(text: Column, bound: int) -> Column:
    """A number below ``bound`` (at most 2 ** 31) drawn from a text."""
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long"), F.lit(bound).cast("long"))


def _character(code: Column) -> Column:
    """The character of a code point below 0x10000."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


#: Literal tables, each made by one expression: sizes of the alphabets, and the stretches.
_SIZES = f"array({', '.join(f'{len(a)}L' for a in ALPHABETS)})"
_STRETCH_TABLE = f"array({', '.join(f"named_struct('low', {lo}, 'high', {hi}, 'step', {st}, 'size', {(hi - lo + 1) // st}L)" for lo, hi, st in STRETCHES)})"


def _moved(c: Column, at: Column, draw: Column) -> Column:
    """A character moved in its alphabet or stretch; ``at`` is its place in the grid, -1 if it is in none."""
    base = at - F.pmod(at, F.lit(_STRETCH))
    to = base + F.pmod(at - base + draw, F.get(F.expr(_SIZES), (base / _STRETCH).cast("int"))) + 1

    def stretched(s: Column) -> Column:
        off = F.ascii(c) - s["low"]
        odd = F.pmod(off, s["step"])
        return _character(s["low"] + F.pmod((off - odd) / s["step"] + draw, s["size"]).cast("long") * s["step"] + odd)

    other = F.get(F.transform(F.filter(F.expr(_STRETCH_TABLE), lambda s: F.ascii(c).between(s["low"], s["high"])), stretched), 0)
    return F.when(c == " ", c).when(at >= 0, F.substring(F.lit(_GRID), to.cast("int"), F.lit(1))).when(c < "\u0100", c).otherwise(F.coalesce(other, c))


def _permute(chars: Column, tweak: Column, undo: bool = False) -> Column:
    """One pass over an array of characters: each is moved by what the characters before it give, or moved back."""
    start = F.struct(F.sha2(tweak, 256).alias("state"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        draw = F.conv(F.substring(acc["state"], 1, 12), 16, 10).cast("long")

        def after(new: Column) -> Column:
            # What comes next hangs on the character before it was moved; separators do not count.
            counts = c.rlike(r"[\p{L}\p{N}]")
            state = F.when(counts, F.sha2(F.concat(acc["state"], F.lower(new if undo else c)), 256)).otherwise(acc["state"])
            return F.struct(state.alias("state"), F.concat(acc["out"], F.array(new)).alias("out"))

        return _let(F.instr(F.lit(_GRID), c) - 1, lambda at: _let(_moved(c, at, -draw if undo else draw), after))

    return F.aggregate(chars, start, step, lambda acc: acc["out"])


def _shuffled(value: Column, tweak: Column) -> Column:
    """The keyed permutation of a value among the values of its format; nothing stays in place."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    one, two = F.concat(tweak, F.lit("1")), F.concat(tweak, F.lit("2"))
    there = _permute(F.reverse(_permute(chars, one)), two)
    by_one = F.transform(there, lambda c: _let(F.instr(F.lit(_GRID), c) - 1, lambda at: _moved(c, at, F.lit(1).cast("long"))))
    back = _permute(F.reverse(_permute(by_one, two, undo=True)), one, undo=True)
    return F.array_join(back, "")


def _tweak(key: str, kind: str, *more: Column) -> Column:
    return F.concat_ws("|", F.lit(key), F.lit(kind), *more)


def _permute_octets(octets: Column, tweak: Column, undo: bool = False) -> Column:
    """One pass over an address's numbers: each moves among those of its length by all before it, or back."""

    def step(acc: Column, x: Column) -> Column:
        draw = _number(F.concat_ws("|", tweak, acc["seen"]), 1 << 31)
        return _let(_octet(x, -draw if undo else draw), lambda new: F.struct(F.concat_ws(".", acc["seen"], (new if undo else x).cast("string")).alias("seen"), F.concat(acc["out"], F.array(new)).alias("out")))

    start = F.struct(F.lit("").alias("seen"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(octets, start, step, lambda acc: acc["out"])


def _octet(x: Column, by: Column) -> Column:
    low = F.when(x < 10, 0).when(x < 100, 10).otherwise(100)
    size = F.when(x < 10, 10).when(x < 100, 90).otherwise(156)
    return low + F.pmod(x - low + by, size.cast("long"))


def _ip(v: Column, key: str) -> Column:
    """The first number stays; the others change, as letters do, and keep their lengths."""
    o = F.transform(F.split(v, r"\."), lambda x: x.cast("long"))
    tweak = lambda turn: _tweak(key, "ip", F.lit(turn), F.get(o, 0).cast("string"))
    there = _permute_octets(F.reverse(_permute_octets(F.slice(o, 2, 3), tweak("1"))), tweak("2"))
    by_one = F.transform(there, lambda x: _octet(x, F.lit(1)))
    back = _permute_octets(F.reverse(_permute_octets(by_one, tweak("2"), undo=True)), tweak("1"), undo=True)
    return F.concat_ws(".", F.get(o, 0), F.array_join(F.transform(back, lambda x: x.cast("string")), "."))


def _check_digit(digits: Column) -> Column:
    """What the digits before a card's last one ask for as the last (the public mod-10 rule)."""
    doubled = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda a, d: a + d), F.lit(10))


def _card(v: Column, key: str) -> Column:
    """The first digit (the issuer's kind) stays, and so does whether the last one is the right check digit."""
    body = F.regexp_replace(v, "[0-9]$", "")
    new = F.concat(F.substring(v, 1, 1), _shuffled(F.substring(body, F.lit(2), F.char_length(body)), _tweak(key, "card", F.substring(v, 1, 1))))
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    off = F.substring(v, -1, 1).cast("int") - _check_digit(digits(body))
    return _let(new, lambda x: F.concat(x, F.pmod(_check_digit(digits(x)) + off, F.lit(10))))


def _remainder97(text: Column) -> Column:
    """An account number, its first four characters moved behind, read as a number with letters from 10 on, modulo 97."""
    chars = F.filter(F.split(F.concat(F.substring(text, F.lit(5), F.char_length(text)), F.substring(text, 1, 4)), ""), lambda c: c != "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda a, c: _let(value(c), lambda v: F.pmod(a * F.when(v > 9, 100).otherwise(10) + v, F.lit(97))))


def _iban(v: Column, key: str) -> Column:
    """The country stays, and so do the groups; check digits are right if they were, and else as they were."""
    bare = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    country = F.substring(v, 1, 2)
    body = _shuffled(F.substring(v, F.lit(5), F.char_length(v)), _tweak(key, "iban", country))

    def checked(new: Column) -> Column:
        digits = F.lpad((F.lit(98) - _remainder97(bare(F.concat(country, F.lit("00"), new)))).cast("string"), 2, "0")
        return F.concat(country, F.when(_remainder97(bare(v)) == 1, digits).otherwise(F.substring(v, 3, 2)), new)

    return _let(body, checked)


def _given(name: Column, key: str) -> Column:
    """A known given name moves within its pool, so it keeps its gender; another one within its format, on and on until it is in no pool of its script.

    So either set is mapped onto itself, no two names meet, and a name has one surrogate
    whatever title stands before it.
    """
    step = int(hashlib.sha256(f"{key}|given".encode()).hexdigest(), 16)
    scripts: dict[str, list[str]] = {}
    for p, known in NAMES.items():
        turned = [known[(i + 1 + step % (len(known) - 1)) % len(known)] for i in range(len(known))]
        scripts.setdefault(p.split("_")[1], []).extend(f"named_struct('old', '{a}', 'new', '{b}')" for a, b in zip(known, turned, strict=True))
    tables = [f"'{script}', array({', '.join(rows)})" for script, rows in scripts.items()]
    names = F.try_element_at(F.expr(f"map({', '.join(tables)})"), F.when(name.rlike(r"^\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin")))

    def within(table: Column) -> Column:
        moved = lambda x: _shuffled(x, _tweak(key, "given"))
        taken = lambda x: F.exists(table, lambda n: n["old"] == x)
        # A walk meets each name of the pools at most once.
        walks = F.sequence(F.lit(0), F.size(table))
        other = F.aggregate(walks, name, lambda x, i: F.when((i == 0) | taken(x), moved(x)).otherwise(x))
        return F.coalesce(F.get(F.filter(table, lambda n: n["old"] == name), 0)["new"], other)

    return _let(names, within)


def _title(v: Column) -> Column:
    return F.regexp_extract(v, r"^\S+ ", 0)


def _name_words(v: Column, key: str) -> Column:
    """Array of (old, new, tail): the words of a titled name, and what parts each from the next.

    The first of several words is a given name and the last one a family name.
    """
    rest = F.substring(v, F.char_length(_title(v)) + 1, F.char_length(v))
    words = F.split(rest, r"(?<=[ -])")
    bare = lambda w: F.regexp_replace(w, "[ -]$", "")
    tail = lambda w: F.regexp_extract(w, "[ -]$", 0)

    def each(all_: Column) -> Column:
        def made(w: Column, i: Column) -> Column:
            last = i == F.size(all_) - 1
            part = F.concat(F.lit(f"{key}|"), F.when(last, F.lit("family")).otherwise(F.lit("middle")))
            new = F.when((i == 0) & ~last, _given(bare(w), key)).otherwise(_shuffled(bare(w), part))
            return F.struct(bare(w).alias("old"), new.alias("new"), tail(w).alias("tail"))

        return F.transform(all_, made)

    return _let(words, each)


def _name(v: Column, words: Column) -> Column:
    """The title stays; each word is replaced."""
    return F.concat(_title(v), F.array_join(F.transform(words, lambda w: F.concat(w["new"], w["tail"])), ""))


def _kind(v: Column) -> Column:
    """The first pattern that fits the whole match."""
    out = F.lit("name")
    for kind in reversed(KINDS[:-1]):
        out = F.when(v.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def _plain(v: Column, kind: Column, key: str) -> Column:
    """E-mail addresses but for the last label, which is no one's; phone numbers but for a country code after a plus; others whole."""
    phone, email = kind == "phone", kind == "email"
    before = F.when(phone, F.regexp_extract(v, r"^\+[0-9]{1,3}(?=[ .-])|^\+[0-9]", 0)).otherwise(F.lit(""))
    after = F.when(email, F.regexp_extract(v, r"\.[^.]+$", 0)).otherwise(F.lit(""))
    middle = F.substring(v, F.char_length(before) + 1, F.char_length(v) - F.char_length(before) - F.char_length(after))
    return F.concat(before, _shuffled(middle, F.concat_ws("|", F.lit(key), kind, before)), after)


_WORDS = "array<struct<old:string,new:string,tail:string>>"


def _words_of(value: Column, kind: Column, key: str) -> Column:
    """The words of a name; none for another kind."""
    return F.when(kind == "name", _name_words(value, key)).otherwise(F.array().cast(_WORDS))


def _replaced(value: Column, kind: Column, words: Column, key: str) -> Column:
    out = _plain(value, kind, key)
    for name, make in (("ip", _ip), ("card", _card), ("iban", _iban)):
        out = F.when(kind == name, make(value, key)).otherwise(out)
    return F.when(kind == "name", _name(value, words)).otherwise(out)


def surrogate(value: Column, kind: Column, key: str) -> Column:
    """The surrogate of an entity of a known kind."""
    return _replaced(value, kind, _words_of(value, kind, key), key)


def entities(text: Column) -> Column:
    """Array of (kind, value): the leftmost entities of a text, in order; none for a null text."""
    everything = "|".join(PATTERNS.values())
    found = F.regexp_extract_all(text, F.lit(f"({everything})"), F.lit(1))
    pairs = F.transform(found, lambda v: F.struct(_kind(v).alias("kind"), v.alias("value")))
    return F.when(text.rlike(_HINT), pairs).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))


def _repeats(gap: Column, words: Column) -> Column:
    """A stretch of text without entities, in which each word of the names found in the text is replaced as it is there.

    All words are sought at once, so that no surrogate is replaced again.
    """
    alternatives = F.array_join(F.transform(words, lambda w: w["old"]), "|")
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{M}\p{N}])(?:"), alternatives, F.lit(r")(?![\p{L}\p{M}\p{N}])"))
    found = F.regexp_extract_all(gap, pattern, F.lit(0))
    new = F.transform(found, lambda f: F.get(F.filter(words, lambda w: w["old"] == f), 0)["new"])
    between = F.split(gap, pattern, -1)
    return F.array_join(F.flatten(F.transform(F.arrays_zip(between.alias("g"), new.alias("n")), lambda x: F.array(x["g"], F.coalesce(x["n"], F.lit(""))))), "")


def with_surrogates(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with entities replaced in ``text_col`` and ``pii``, a map from each kind found to its count.

    Words of a titled name (initials and single letters apart) are replaced wherever else
    they stand in the same text as words of their own, by the same surrogates; of a word
    with several roles the first one counts.  A null text stays null and holds no entity;
    a text without entities stays as it is.  Rows that repeat get the same text.  A column
    named ``pii`` is replaced.
    """
    text = F.col(text_col)
    docs = docs.drop("pii")
    found, made, known = free_names(docs, "_found", "_new", "_names")
    out = docs.withColumn(found, F.coalesce(entities(text), F.array().cast("array<struct<kind:string,value:string>>")))
    # Words first and apart, so that no expression grows too deep to be analysed.
    out = out.withColumn(known, F.transform(found, lambda e: _words_of(e["value"], e["kind"], key)))
    both = F.arrays_zip(F.col(found).alias("e"), F.col(known).alias("w"))
    out = out.withColumn(made, F.transform(both, lambda x: _replaced(x["e"]["value"], x["e"]["kind"], x["w"], key)))
    out = out.withColumn(known, F.filter(F.flatten(known), lambda w: (F.char_length(w["old"]) > 1) & ~w["old"].endswith(".")))
    gaps = F.split(text, "|".join(PATTERNS.values()), -1)
    gaps = F.when(F.size(known) > 0, F.transform(gaps, lambda g: _repeats(g, F.col(known)))).otherwise(gaps)
    joined = F.array_join(F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), F.col(made).alias("n")), lambda x: F.array(x["g"], F.coalesce(x["n"], F.lit(""))))), "")

    def count(kind: str) -> Column:
        return F.size(F.filter(found, lambda e: e["kind"] == kind))

    counts = F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*map(count, KINDS)))
    out = out.withColumns({text_col: F.when(F.size(found) > 0, joined).otherwise(text), "pii": F.map_filter(counts, lambda k, n: n > 0)})
    return out.drop(found, made, known)


def collisions(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Surrogates that more than one entity would get, over all documents: none is expected.

    Entities that differ only in separators are one.
    """
    found = docs.select(F.explode(entities(F.col(text_col))).alias("e")).select("e.*").distinct()
    bare = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}@]", "")
    made = found.withColumn("surrogate", bare(surrogate(F.col("value"), F.col("kind"), key))).withColumn("value", bare(F.col("value")))
    return made.distinct().groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
