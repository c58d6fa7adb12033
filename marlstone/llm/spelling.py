"""Spelling variants: words that lie one edit apart, and the frequent word behind each.

An edit of one code point leaves one half of a word as it is.  So each word gives two
segments, its first half, which a near word starts with, and its second half, which one
ends with.  Automaton shards hold the segments, marked where a word begins or ends; every
word is sent to the shards that can hold a segment of a near word, is scanned there, and
what a segment finds at its place with a length that differs by one at most is verified.
Segments of many words are split into cells: blocks of the words that own the segment
against blocks of those scanned, so that no segment is gathered in one task.  Only counts
and the best near word leave a shard, no pairs.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import materialise, slices

#: Code points and occurrences of a word, at least; by how much a form is more frequent.
LETTERS, OCCURRENCES, TIMES = 6, 5, 5
#: One code point is deleted where this divides a run's checksum.
DROP = 199
#: Counts that a task holds before it passes them on.
HELD = 500_000
#: Words that own a segment, and words scanned for it, in one cell; rows of a shard, about.
OWNERS, SCANNED, SHARD_ROWS = 4_096, 16_384, 60_000
#: Comparisons that are held in memory at a time.
CHUNK = 1 << 22
#: Marks before the first and after the last code point of a word; no word holds them.
START, END = "<", ">"

#: In Latin-1: letters of a run stay, A-Z in lower case; all else parts runs.
_FOLD = bytes(b if 0x61 <= b <= 0x7A or b >= 0xC0 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def runs_of(text: str | None) -> list[bytes]:
    """Runs of A-Z, a-z and U+00C0 to U+00FF in Latin-1, only A-Z in lower case."""
    return (text or "").encode("latin-1", "replace").translate(_FOLD).split()


def observed(prefix: int, run: bytes) -> bytes:
    """A run, without one code point where its checksum, continued from ``prefix``, says so."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % DROP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS, least: int = OCCURRENCES) -> DataFrame:
    """(word, n) of the words with at least ``letters`` code points and ``least`` occurrences."""

    def rows(held: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in held], pa.string())
        return pa.record_batch([words, pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in slices(batches):
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                prefix = zlib.crc32(f"{doc_id}:".encode())
                for run, n in Counter(r for r in runs_of(text) if len(r) >= letters).items():
                    word = observed(prefix, run)
                    if len(word) >= letters:
                        held[word] += n
            if len(held) > HELD:
                yield rows(held)
                held.clear()
        yield rows(held)

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _cells(words: DataFrame) -> DataFrame:
    """(shard, cell, segment, own, word, n): a word with each segment that it owns or may have of another."""
    size = F.char_length("word")
    first = lambda length: F.floor(length / 2).cast("int")
    start = lambda length: F.concat(F.lit(START), F.left(F.col("word"), first(length)))
    end = lambda length: F.concat(F.right(F.col("word"), (length - first(length)).cast("int")), F.lit(END))
    both = lambda length: [start(length), end(length)]
    owned = words.select("word", "n", F.explode(F.array(*both(size))).alias("segment"), F.lit(True).alias("own"))
    near = F.array_distinct(F.array(*both(size - 1), *both(size), *both(size + 1)))
    rows = owned.unionByName(words.select("word", "n", F.explode(near).alias("segment"), F.lit(False).alias("own")))
    # A segment without an owner finds nothing.
    sizes = rows.groupBy("segment").agg(F.count_if("own").alias("owners"), F.count_if(~F.col("own")).alias("scanned")).where("owners > 0")
    blocks = sizes.select("segment", F.ceil(F.col("owners") / OWNERS).cast("int").alias("ob"), F.ceil(F.col("scanned") / SCANNED).cast("int").alias("sb"))
    rows = rows.join(blocks.hint("merge"), "segment")
    mine = F.pmod(F.xxhash64("word"), F.when(F.col("own"), F.col("ob")).otherwise(F.col("sb"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("own"), F.col("sb")).otherwise(F.col("ob")) - 1)
    rows = rows.withColumn("mine", mine).withColumn("theirs", F.explode(others))
    cell = F.when(F.col("own"), F.struct(F.col("mine").alias("o"), F.col("theirs").alias("s"))).otherwise(F.struct(F.col("theirs").alias("o"), F.col("mine").alias("s")))
    return rows.select("segment", cell.alias("cell"), "own", "word", "n")


def _matrix(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` and ``b`` (code points, a column each) are exactly one edit apart; lengths differ by one at most."""
    if a.shape[1] == b.shape[1]:
        differ = np.zeros((len(a), len(b)), np.uint8)
        for k in range(a.shape[1]):
            differ += a[:, None, k] != b[None, :, k]
        return differ == 1
    if a.shape[1] > b.shape[1]:
        return one_edit(b, a).T
    # The shorter word must be alike up to some place, and from there on to what stands one later.
    alike = np.ones((len(a), len(b)), bool)
    heads = [alike]
    for k in range(a.shape[1]):
        alike = alike & (a[:, None, k] == b[None, :, k])
        heads.append(alike)
    tail = np.ones((len(a), len(b)), bool)
    found = heads[-1].copy()
    for k in range(a.shape[1] - 1, -1, -1):
        tail = tail & (a[:, None, k] == b[None, :, k + 1])
        found |= tail & heads[k]
    return found


class Shard:
    """One shard: an automaton of the segments in its cells, and what scanned words find."""

    def __init__(self, rows: pa.Table):
        cells = zip(rows.column("segment").to_pylist(), rows.column("o").to_pylist(), rows.column("s").to_pylist(), strict=True)
        words = rows.column("word").to_pylist()
        self.n = dict(zip(words, rows.column("n").to_pylist(), strict=True))
        self.owners: dict[tuple, dict[int, list[str]]] = {}
        self.found: dict[tuple, dict[int, list[str]]] = {}
        held: dict[str, set] = {}
        scanned: dict[str, set] = {}
        for cell, own, word in zip(cells, rows.column("own").to_pylist(), words, strict=True):
            if own:
                self.owners.setdefault(cell, {}).setdefault(len(word), []).append(word)
                held.setdefault(cell[0], set()).add(cell)
            else:
                scanned.setdefault(word, set()).add(cell)
        self.automaton = ahocorasick.Automaton()
        for segment, own in held.items():
            self.automaton.add_word(segment, own)
        if held:
            self.automaton.make_automaton()
            for word, sent in scanned.items():
                # The marks let a segment be found at its place only.
                for _, own in self.automaton.iter(START + word + END):
                    for cell in own & sent:
                        self.found.setdefault(cell, {}).setdefault(len(word), []).append(word)

    def best(self) -> Iterator[tuple[str, int, str, int]]:
        """(word, near words, the most frequent of them, its n), by owner and cell."""
        for cell, by_length in self.owners.items():
            begins = cell[0].startswith(START)
            held = len(cell[0]) - 1
            for length, owners in by_length.items():
                o = _matrix([w.encode("latin-1") for w in owners])
                count = np.zeros(len(owners), np.int64)
                top: list[tuple[int, str] | None] = [None] * len(owners)
                for other, words in self.found.get(cell, {}).items():
                    if abs(other - length) > 1:
                        continue
                    words.sort(key=lambda w: (-self.n[w], w))
                    v = _matrix([w.encode("latin-1") for w in words])
                    # What the segment covers is the same and need not be held against each other.
                    mine, theirs = (o[:, held:], v[:, held:]) if begins else (o[:, : length - held], v[:, : other - held])
                    step = max(1, CHUNK // len(v))
                    for lo in range(0, len(o), step):
                        near = one_edit(mine[lo : lo + step], theirs)
                        if not begins:
                            # A near word that also starts with the first half was found there.
                            half = length // 2
                            near &= ~(o[lo : lo + step, None, :half] == v[None, :, :half]).all(axis=2)
                        count[lo : lo + step] += near.sum(axis=1)
                        for i in np.flatnonzero(near.any(axis=1)):
                            w = words[int(near[i].argmax())]
                            key = (-self.n[w], w)
                            if top[lo + i] is None or key < top[lo + i]:
                                top[lo + i] = key
                yield from ((w, int(c), t[1], -t[0]) for w, c, t in zip(owners, count, top, strict=True) if t)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of the words (word, n) that have near words: how many, and the most frequent, ties to the first in code-point order."""
    cells = materialise(_cells(words), "segments")
    shards = max(1, cells.count() // SHARD_ROWS)
    dealt = cells.select(F.pmod(F.xxhash64("segment", "cell"), F.lit(shards)).cast("int").alias("shard"), "segment", "cell.o", "cell.s", "own", "word", "n")

    def scanned(rows: pa.Table) -> pa.Table:
        found = list(Shard(rows).best())
        columns = list(zip(*found, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["word", "n_near", "best", "best_n"])

    parts = dealt.groupBy("shard").applyInArrow(scanned, "word string, n_near long, best string, best_n long")
    first = F.min(F.struct((-F.col("best_n")).alias("rank"), "best")).alias("first")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select("word", "n_near", F.col("first.best").alias("best"), (-F.col("first.rank")).alias("best_n"))


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """(word, root): the last form that is reached from each word of ``forms`` (word, form), in ``longest`` steps at most.

    Each round lets every word look as far again as it does already.
    """
    seen = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, longest))))):
        on = seen.select(F.col("word").alias("root"), F.col("root").alias("further"))
        seen = materialise(seen.join(on.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return seen


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS, least: int = OCCURRENCES, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``docs``.

    A word's form is its most frequent near word (ties: the first in code-point order), if
    that is ``times`` as frequent at least, else null; its root is what its forms lead to,
    or the word itself.  Null and empty texts have no words, a null id is read as '', rows
    that repeat count again, no documents give no rows.  Other columns are not read.
    """
    words = materialise(word_counts(docs, id_col, text_col, letters, least), "words")
    near = materialise(near_words(words), "near")
    joined = words.join(near.hint("merge"), "word", "left")
    formed = F.col("best_n") >= F.col("n") * times
    named = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n"))
    named = materialise(named, "named")
    forms = named.where("form IS NOT NULL").select("word", "form")
    most = words.agg(F.max("n")).first()[0] or least
    # A form has ``times`` the occurrences, so no way is longer than this.
    longest = 1 + int(math.log(max(1, most / least), times)) if times > 1 else most
    ends = roots(forms, longest)
    out = named.join(ends.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
