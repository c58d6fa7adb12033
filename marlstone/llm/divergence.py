"""How far the sources of a language lie apart in their words.

Two passes over the texts.  The first counts exactly in how many documents of its language
each term stands; terms of ``least_docs`` documents are kept.  The second lets automata of
the kept terms, padded with the delimiter on both sides, find every occurrence, and counts
them per source.  Terms, counts and sources are rows: postings that hold no zeros.

A source's smoothed share of a term, in whole units of 1e-9, is
p = 1 + floor(1e9 * (count + 5) / (N + 5 * V)), N its occurrences of kept terms, V the
number of kept terms of its language.  Two sources differ by the sum of abs(p - q) over
all V terms.  With p0 the share of a term that a source lacks, this is

    V * abs(p0 - q0)
      + sum over the terms of the one source  of abs(p - q0) - abs(p0 - q0)
      + sum over the terms of the other       of abs(p0 - q) - abs(p0 - q0)
      + sum over terms of both of abs(p - q) - abs(p - q0) - abs(p0 - q) + abs(p0 - q0),

so terms that neither has are never visited.  The middle lines need only how often each
share occurs in a source; the last one goes through the postings of each term.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import discard, materialise, slices, small

#: Documents of its language that a kept term stands in, at least, and the terms that a source's report lists.
LEAST_DOCS, TOP_TERMS = 30, 50
#: What is added to every count, and the units that shares are given in.
SMOOTH, UNIT = 5, 1_000_000_000
#: Kept terms in one shard of automata; with more of them each shard scans the texts anew.
SHARD_TERMS = 250_000
#: Counts that a task holds before it passes them on.
HELD = 500_000
#: Sources that meet in one task, and postings that do, about.
SOURCE_BLOCK, TASK_POSTINGS = 512, 50_000

#: Bytes that part terms become a space, A-Z become lower case; bytes of longer code points stay.
_FOLD = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and code points from U+0080, A-Z in lower case, as UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


def _rows(counts: dict[tuple, Counter], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Counts of terms per key, as (key..., term, n)."""
    for key, c in counts.items():
        if c:
            columns = [pa.array([k] * len(c), pa.string()) for k in key]
            yield pa.record_batch([*columns, pa.array(list(c)).cast(pa.string()), pa.array(list(c.values()), pa.int64())], names)


def document_frequencies(docs: DataFrame, least: int) -> DataFrame:
    """(lang, term) of the terms in at least ``least`` documents of their language; exact."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Counter] = {}
        for batch in slices(batches):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                held.setdefault((lang,), Counter()).update(set(terms_of(text)))
            if sum(map(len, held.values())) > HELD:
                yield from _rows(held, ["lang", "term", "n"])
                held = {}
        yield from _rows(held, ["lang", "term", "n"])

    parts = docs.select("lang", "text").mapInArrow(counted, "lang string, term string, n long")
    return parts.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term")


class Automata:
    """Automata of one shard of kept terms, a language at a time, read from the shared folder."""

    def __init__(self, path: str, shard: int):
        source, root = fs.FileSystem.from_uri(path)
        folder = f"{root}/shard={shard}"
        # A shard that no term falls into has no folder.
        there = source.get_file_info(folder).type == fs.FileType.Directory
        self.data = pads.dataset(folder, filesystem=source, format="parquet") if there else None
        self.made: dict[str, tuple[ahocorasick.Automaton, np.ndarray] | None] = {}

    def of(self, lang: str) -> tuple[ahocorasick.Automaton, list[bytes]] | None:
        if lang not in self.made:
            terms = self.data.to_table(columns=["term"], filter=pads.field("lang") == lang).column("term").to_pylist() if self.data else []
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, term in enumerate(terms):
                automaton.add_word(f" {term} ", i)
            automaton.make_automaton()
            self.made[lang] = (automaton, [t.encode() for t in terms]) if terms else None
        return self.made[lang]


def occurrences(docs: DataFrame, path: str, shards: int) -> DataFrame:
    """(lang, source, term, n): how often each kept term stands in a source; no zeros.

    ``path`` holds the kept terms in folders shard=0 ... ``shards`` - 1.
    """

    def scan(shard: int) -> DataFrame:
        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automata = Automata(path, shard)
            held: dict[tuple, Counter] = {}

            def out() -> Iterator[pa.RecordBatch]:
                named = {}
                for key, c in held.items():
                    terms = automata.of(key[0])[1]
                    named[key] = {terms[i]: n for i, n in c.items()}
                yield from _rows(named, ["lang", "source", "term", "n"])
                held.clear()

            for batch in slices(batches):
                for text, lang, source in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source")), strict=True):
                    found = automata.of(lang)
                    if found:
                        padded = f" {text.encode().translate(_FOLD).decode()} "
                        held.setdefault((lang, source), Counter()).update([i for _, i in found[0].iter(padded)])
                if sum(map(len, held.values())) > HELD:
                    yield from out()
            yield from out()

        return docs.select("lang", "source", "text").mapInArrow(counted, "lang string, source string, term string, n long")

    found = reduce(DataFrame.unionAll, [scan(i) for i in range(shards)])
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(1e9 * (n + 5) / (total + 5 * terms)), in decimals that hold every product."""
    top = (n + SMOOTH).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return (F.call_function("div", top, (total + terms * SMOOTH).cast("decimal(19,0)")) + 1).cast("long")


def _pairs(lang: str, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pd.DataFrame:
    # Texts stay Python objects: concatenated or empty columns of pandas' own strings do not pass into Spark.
    texts = {"lang": np.full(len(a), lang, object), "a": a, "b": b}
    return pd.DataFrame({c: pd.Series(x, dtype=object) for c, x in texts.items()} | {"value": value.astype(np.int64)})


def _shared_terms(postings: DataFrame, blocks: int, buckets: int) -> DataFrame:
    """(lang, a, b, value) with a < b: the last line of the sum above, in parts.

    Postings meet by blocks of sources, so that a term that all sources have takes no more
    memory than a block's pairs.
    """

    def block_pairs(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lang, _, low, high = keys
        # Python sorts by code points, as UTF-8 does.
        names, at = np.unique(rows["source"].to_numpy(object), return_inverse=True)
        rows = rows.assign(at=at).sort_values("term", kind="stable")
        p, p0, at, block = (rows[c].to_numpy() for c in ("p", "p0", "at", "block"))
        edges = np.flatnonzero(np.r_[True, rows["term"].to_numpy()[1:] != rows["term"].to_numpy()[:-1], True])
        total = np.zeros((len(names), len(names)), np.int64)
        for lo, hi in itertools.pairwise(edges):
            one = slice(lo, hi)
            i, j = (at[one], at[one]) if low == high else (at[one][block[one] == low], at[one][block[one] == high])
            pi, qi, pj, qj = (p[one], p0[one], p[one], p0[one]) if low == high else (x[one][block[one] == k] for k in (low, high) for x in (p, p0))
            pi, qi = pi[:, None], qi[:, None]
            total[np.ix_(i, j)] += np.abs(pi - pj) - np.abs(pi - qj) - np.abs(qi - pj) + np.abs(qi - qj)
        if low != high:
            total = total + total.T
        a, b = np.nonzero(np.triu(total, 1))
        return _pairs(lang, names[a], names[b], total[a, b])

    own = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")
    rows = postings.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other"), "bucket": F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")})
    return rows.select("lang", "bucket", "low", "high", "source", "term", "p", "p0", "block").groupBy("lang", "bucket", "low", "high").applyInPandas(block_pairs, "lang string, a string, b string, value long")


def _own_terms(groups: DataFrame, shares: DataFrame, blocks: int) -> DataFrame:
    """(lang, a, b, value) for both orders of a and b: a's terms against what b gives to a term it lacks.

    The first order of a pair also carries V * abs(p0 - q0).  ``shares`` holds, per source,
    how many terms have each share.
    """

    def against(keys: tuple, mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        columns: list[list[np.ndarray]] = [[], [], []]
        names, q0, terms = others["source"].to_numpy(object), others["p0"].to_numpy(), others["v"].to_numpy()
        order = np.argsort(q0, kind="stable")
        for a, own in mine.groupby("a", sort=False):
            own = own.sort_values("p")
            p, n, p0 = own["p"].to_numpy(), own["terms"].to_numpy(), own["a0"].iloc[0]
            # Of p below q0: terms and their shares, added up.
            upto = np.searchsorted(p, q0[order], "right")
            many, much = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(n * p)]
            value = np.empty(len(q0), np.int64)
            value[order] = (much[-1] - 2 * much[upto]) + (2 * many[upto] - many[-1]) * q0[order]
            value += np.abs(p0 - q0) * np.where((names > a).astype(bool), terms - many[-1], -many[-1])
            keep = (names != a).astype(bool)
            for column, part in zip(columns, (np.full(keep.sum(), a, object), names[keep], value[keep]), strict=True):
                column.append(part)
        a, b, value = (np.concatenate(c) if c else np.empty(0, object) for c in columns)
        return _pairs(keys[0], a, b, value)

    block = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    mine = shares.select(F.col("lang").alias("of"), block.alias("i"), every.alias("j"), F.col("source").alias("a"), F.col("p0").alias("a0"), "p", "terms")
    others = groups.select("lang", every.alias("mine"), block.alias("other"), "source", "p0", "v")
    return mine.groupBy("of", "i", "j").cogroup(others.groupBy("lang", "mine", "other")).applyInPandas(against, "lang string, a string, b string, value long")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every source of every language.

    Part ``pair``: the other sources of the language, by how far they lie apart; all ranks.
    Part ``term``: terms that the source has and uses more than its language, by how much;
    the first ``top``.  Ties go to the smaller item in UTF-8 order.  Null texts, languages
    and sources are read as ''; rows that repeat count again; a language without kept terms
    gives pairs at 0; no documents, no rows.  Other columns are not read.
    """
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = materialise(document_frequencies(docs, least_docs), "kept-terms")
    terms = kept.count()
    shards = max(1, -(-terms // shard_terms))
    by_shard = kept.withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int"))
    spark = docs.sparkSession
    groups = docs.select("lang", "source").distinct()
    schema = "lang string, source string, term string, n long"
    if terms:
        written = materialise(by_shard.repartition(shards, "shard"), "vocabulary", partition="shard")
        counts = materialise(occurrences(docs, written.marlstone_path, shards), "occurrences")
        discard(written)
    else:
        counts = spark.createDataFrame([], schema)

    sizes = materialise(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v")), "sizes")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    groups = materialise(groups.withColumn("p0", F.when(F.col("v") > 0, _share(F.lit(0), F.col("total"), F.col("v"))).otherwise(F.lit(0))), "groups")
    n_groups = groups.count()
    postings = counts.join(small(groups, n_groups), ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("v")))
    postings = materialise(postings.select("lang", "source", "term", "n", "p", "p0"), "postings")

    most = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    blocks = -(-most // SOURCE_BLOCK)
    buckets = max(1, postings.count() * blocks // TASK_POSTINGS)
    shares = groups.join(postings.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("terms")), ["lang", "source"], "left")
    shares = shares.select("lang", "source", "p0", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("terms", F.lit(0)).alias("terms"))
    parts = _own_terms(groups, shares, blocks).unionByName(_shared_terms(postings, blocks, buckets))
    pairs = parts.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("e")
    pairs = pairs.select("lang", ends, "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")

    of_lang = totals.groupBy("lang").agg(F.sum("total").alias("total")).join(sizes, "lang")
    usual = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(small(of_lang, n_groups), "lang")
    usual = usual.select("lang", "term", _share(F.col("n"), F.col("total"), F.col("v")).alias("q"))
    over = postings.join(usual.hint("merge"), ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    out = ranked(pairs).unionByName(ranked(over).where(F.col("rank") <= top))
    discard(kept)
    return out.select("lang", "source", "part", "item", "value", "rank")
