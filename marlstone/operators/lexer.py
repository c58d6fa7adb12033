"""Comments of C-like sources, found in blocks of a text that are scanned apart.

A scanner with few states reads a text once.  What a block does to the state does not
depend on the blocks before it: it maps every state to one.  So blocks are scanned side by
side for their maps, the maps are composed in order (a row a block), and each block is
scanned again from the state it then has.  A comment that spans blocks is put together
from its parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.tiles import sliced

#: Code points of a block.
BLOCK = 1 << 16
#: Bytes of blocks that a task turns into objects at a time.
SLICE = 1 << 18
CODE, SLASH, LINE, COMMENT, STAR, TEXT, TEXT_ESCAPE, LETTER, LETTER_ESCAPE = range(9)
STATES = range(9)
#: Where each state goes on a character; any other one leads to the last entry.
_NEXT = {
    CODE: {"/": SLASH, '"': TEXT, "'": LETTER, None: CODE},
    SLASH: {"/": LINE, "*": COMMENT, '"': TEXT, "'": LETTER, None: CODE},
    LINE: {"\n": CODE, None: LINE},
    COMMENT: {"*": STAR, None: COMMENT},
    STAR: {"*": STAR, "/": CODE, None: COMMENT},
    TEXT: {'"': CODE, "\\": TEXT_ESCAPE, None: TEXT},
    TEXT_ESCAPE: {None: TEXT},
    LETTER: {"'": CODE, "\\": LETTER_ESCAPE, None: LETTER},
    LETTER_ESCAPE: {None: LETTER},
}
_ESCAPES = {TEXT_ESCAPE, LETTER_ESCAPE}
_OPEN = {LINE, COMMENT, STAR}
#: A character that some state minds, or a run of others, of which one stands for all.
_EVENT = re.compile(r"[/*\"'\\\n]|[^/*\"'\\\n]+")


def _events(text: str) -> Iterator[tuple[str | None, int, int]]:
    """(character or None, from, to); a run of others is two events where it could be escaped and go on."""
    for m in _EVENT.finditer(text):
        c = m.group()
        if c in "/*\"'\\\n" and len(c) == 1:
            yield c, m.start(), m.end()
        else:
            yield None, m.start(), m.start() + 1
            if m.end() - m.start() > 1:
                yield None, m.start() + 1, m.end()


def block_map(text: str) -> tuple[list[int], list[int], list[bool]]:
    """For each state before a block: the state after it, the lines that it counts, and whether a comment begins in it.

    A line feed behind a backslash in a text is skipped with it and not counted.
    """
    now, feeds, skipped, begun = tuple(STATES), 0, [0] * len(STATES), [False] * len(STATES)
    known: dict[tuple, tuple] = {}
    for c, _, _ in _events(text):
        if c == "\n":
            feeds += 1
            if any(s in _ESCAPES for s in now):
                for k, s in enumerate(now):
                    skipped[k] += s in _ESCAPES
        if (now, c) not in known:
            known[now, c] = tuple(_NEXT[s].get(c, _NEXT[s][None]) for s in now)
        after = known[now, c]
        if c in ("/", "*"):
            for k, s in enumerate(now):
                begun[k] |= s == SLASH and after[k] in _OPEN
        now = after
    return list(now), [feeds - n for n in skipped], begun


def block_comments(text: str, state: int, line: int) -> Iterator[tuple[int | None, str, bool]]:
    """(first line, or None if it began before the block; its part of the text; whether it is open at the end) of each comment in a block."""
    start, at, began = (0, None, False) if state in _OPEN else (None, None, False)
    for c, lo, hi in _events(text):
        after = _NEXT[state].get(c, _NEXT[state][None])
        if state == SLASH and after in _OPEN:
            start, at, began = hi, line, True
            mark = "//" if after == LINE else "/*"
        elif state in _OPEN and after == CODE:
            # A line feed ends a comment before it, a slash behind it.
            yield at, (mark if began else "") + text[start : lo if state == LINE else hi], False
            start, began = None, False
        if c == "\n" and state not in _ESCAPES:
            line += 1
        state = after
    if state in _OPEN:
        yield at if began else None, (mark if began else "") + text[start:], True


def comments(sources: DataFrame, key: str, text: str, block: int = BLOCK) -> DataFrame:
    """(key, line, comment): every comment of each text, in no order; ``//`` and ``/*`` marks stay, as does ``*/``.

    Marks within texts and letters in quotes, escapes among them, are no comments; one that
    is never closed reaches to the end.  Lines count from 1.  Keys are those of distinct
    rows; null and empty texts have no comments.
    """
    kind = dict(sources.dtypes)[key]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "t"):
            for i, t in enumerate(batch.column("t").to_pylist()):
                for n in range(0, len(t), block * 64):
                    parts = [t[k : k + block] for k in range(n, min(len(t), n + block * 64), block)]
                    yield pa.record_batch([batch.column("k").take(pa.array([i] * len(parts))), pa.array(range(n // block, n // block + len(parts)), pa.int64()), pa.array(parts, pa.string())], ["k", "block", "part"])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "part", size=SLICE):
            made = [block_map(p) for p in batch.column("part").to_pylist()]
            columns = [pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.int64())), pa.array([m[2] for m in made], pa.list_(pa.bool_()))]
            yield pa.record_batch([batch.column("k"), batch.column("block"), *columns], ["k", "block", "after", "feeds", "begun"])

    def composed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        state, line, owner, out = CODE, 1, -1, []
        for b, after, feeds, begun in zip(rows["block"], rows["after"], rows["feeds"], rows["begun"], strict=True):
            out.append((state, line, owner))
            owner = b if begun[state] else owner
            state, line = int(after[state]), line + int(feeds[state])
        return rows[["k", "block"]].assign(**{n: [o[i] for o in out] for i, n in enumerate(("state", "line", "owner"))})

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "part", size=SLICE):
            at, rows = [], []
            columns = (batch.column(c).to_pylist() for c in ("block", "part", "state", "line", "owner"))
            for i, (b, part, state, line, owner) in enumerate(zip(*columns, strict=True)):
                for n, (first, piece, is_open) in enumerate(block_comments(part, state, line)):
                    at.append(i)
                    # Parts of a comment that spans blocks share the block where it began, and no number.
                    spans = first is None or is_open
                    rows.append((owner if first is None else b, -1 if spans else n, b, first, piece))
            fields = [("begin", pa.int64()), ("n", pa.int64()), ("block", pa.int64()), ("line", pa.int64()), ("piece", pa.string())]
            lists = list(zip(*rows, strict=True)) or [[] for _ in fields]
            yield pa.record_batch([batch.column("k").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, (_, t) in zip(lists, fields, strict=True))], ["k", *(f for f, _ in fields)])

    texts = sources.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t <> ''")
    blocks = texts.mapInArrow(cut, f"k {kind}, block long, part string")
    maps = blocks.mapInArrow(mapped, f"k {kind}, block long, after array<int>, feeds array<long>, begun array<boolean>")
    starts = maps.groupBy("k").applyInPandas(composed, f"k {kind}, block long, state int, line long, owner long")
    starts = starts.withColumnsRenamed({"k": "k2", "block": "block2"})
    both = blocks.join(starts, F.col("k").eqNullSafe(F.col("k2")) & (F.col("block") == F.col("block2"))).drop("k2", "block2")
    parts = both.mapInArrow(found, f"k {kind}, begin long, n long, block long, line long, piece string")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "piece"))), lambda s: s["piece"]), "")
    spanning = parts.where("n < 0").groupBy("k", "begin").agg(F.max("line").alias("line"), whole.alias("comment"))
    single = parts.where("n >= 0").select("k", "line", F.col("piece").alias("comment"))
    return single.unionByName(spanning.select("k", "line", "comment")).withColumnRenamed("k", key)
