"""Exact token counts at every prefix of a text.

For a byte-pair encoding, the encoding of a string minus its last token is the encoding
of the string minus that token's symbols.  So the last token of each prefix is the one
token ending there that stays apart from the last token before it, and

    count(prefix) = count(prefix minus its last token) + 1

which one pass over a word fills in for all its prefixes.  A word's last symbol is a
symbol of its own (it carries the end-of-word mark), so each prefix is also closed once:
its count as a text that ends there.  The stored table holds one signed byte for each
code point, the change of the count when that code point is added; truncation points and
the count of any prefix are running sums of these bytes, without encoding again.

Where a code point changes the normal form of those before it (a combining mark), the
prefixes between are followed on a branch, which is then dropped; the pass goes on from
the last code point that nothing can change any more.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.models import BPE

from marlstone.llm.common import slices
from marlstone.llm.vocab import PIECE, Memo, byte_symbols, chunks, simple, tokenizer

#: Pairs of neighbouring tokens whose check is kept in a worker, and beginnings of words
#: (of so many code points) whose counts are.
PAIR_ENTRIES, HEAD_ENTRIES, HEAD = 200_000, 50_000, 5
#: Bytes of text whose words are worked out side by side.
LEARN_BYTES = 4 << 20
#: Bytes of each generation of a worker's memos of chunks and of words.
CHUNK_BYTES, PIECE_BYTES = 72 << 20, 48 << 20

# Fixed value of the file's splitting rule: what an apostrophe joins to, if nothing else does.
CONTRACTED = ("s", "t", "re", "ve", "m", "ll", "d")


#: Bytes of a word up to which words are worked out side by side, and the base of their hashes.
TOGETHER, HASH = 40, np.uint64(0x9E3779B97F4A7C15)

SPACE = regex.compile(r"\s")


class Apart(dict):
    """Whether two tokens, by their numbers in one key, stay two when they stand together."""

    def __init__(self, names: list[str], base: int, tokenize):
        super().__init__()
        self.names, self.base, self.tokenize = names, base, tokenize

    def __missing__(self, key: int) -> bool:
        a, b = self.names[key // self.base], self.names[key % self.base]
        found = self.tokenize(a + b)
        if len(self) >= PAIR_ENTRIES:
            self.clear()
        self[key] = out = len(found) == 2 and found[0].value == a
        return out


class Run:
    """A piece while it grows: its last symbols, after each of all its symbols the last token and the count, and the count if it ends here."""

    __slots__ = ("closed", "count", "last", "symbols")

    def __init__(self, symbols: str = "", last: list[int] | None = None, count: list[int] | None = None, closed: int = 0):
        self.symbols, self.last, self.count, self.closed = symbols, last or [0], count or [0], closed

    def cut(self, symbols: str, size: int, closed: int) -> None:
        """Goes back to ``size`` symbols, of which ``symbols`` are the last."""
        self.symbols, self.closed = symbols, closed
        del self.last[size + 1 :], self.count[size + 1 :]


class PrefixCounter:
    """Counts for every prefix of a chunk (a text without plain white space)."""

    END = "</w>"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        base = len(vocab) + 1
        names = list(vocab)
        # Text of a token -> its numbers inside a word and at a word's end, or -1.
        self.numbers: dict[str, tuple[int, int]] = {}
        for i, t in enumerate(names):
            inner, ending = self.numbers.get(t.removesuffix(self.END), (-1, -1))
            self.numbers[t.removesuffix(self.END)] = (inner, i) if t.endswith(self.END) else (i, ending)
        names = [t.removesuffix(self.END) for t in names]
        self.base = base
        self.longest = max(map(len, names))
        # What tokens end with: a token can end at a symbol only as far back as these reach.
        self.tails = {t[k:] for t in names for k in range(len(t))}
        self.forms: dict[str, str] = {}
        self.symbol = dict(enumerate(byte_symbols()))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.parted = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        # The same merges, for symbols inside a word and for symbols that end one.
        inside = BPE(vocab=vocab, merges=[tuple(m) for m in spec["model"]["merges"]]).tokenize
        self.apart_inside = Apart(names, base, inside)
        self.apart_ending = Apart(names, base, tokenizer(path).model.tokenize)
        self.normalise = tokenizer(path).normalizer.normalize_str
        self.pieces_of = tokenizer(path).pre_tokenizer.pre_tokenize_str
        self.pieces = Memo(self._piece, PIECE_BYTES)
        # Tokens of single-byte symbols by the hash of their bytes, for many words at once.
        byte = {c: b for b, c in self.symbol.items()}
        plain = {t: n for t, n in self.numbers.items() if all(c in byte for c in t)}
        with np.errstate(over="ignore"):
            found = {}
            for t, n in plain.items():
                h = 0
                for c in t:
                    h = (h * int(HASH) + byte[c] + 1) % (1 << 64)
                found.setdefault(h, []).append(n)
        if any(len(n) > 1 for n in found.values()):
            raise ValueError("two tokens share a hash: take another HASH")
        order = sorted(found)
        self.hashed, self.hashed_numbers = np.array(order, np.uint64), np.array([found[h][0] for h in order], np.int64)
        self.heads: dict[str, tuple] = {}
        self.kinds: dict[str, str] = {}
        # Code points that may join the one before them although they are no marks.
        second = [unicodedata.decomposition(chr(c)).split() for c in range(0x30000)]
        self.joining = {chr(int(d[1], 16)) for d in second if len(d) == 2 and d[0][0] != "<"} | set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))

    def _grow(self, run: Run, text: str) -> list[int]:
        """Adds code points to a piece; returns the piece's count if it ended after each of them."""
        data = text.encode()
        # Only the last symbols are kept, so that a long piece grows in steps of the same length.
        last, count, ended = run.last, run.count, []
        start, s = len(last) - 1, run.symbols + data.decode("latin-1").translate(self.symbol)
        off = start - len(run.symbols)
        numbers, inside, ending, base, tails = self.numbers.get, self.apart_inside, self.apart_ending, self.base, self.tails
        one_each, size = text.isascii(), off + len(s)
        for i in range(start + 1, size + 1):
            ends = one_each or i == size or data[i - start] & 0xC0 != 0x80
            inner, closed = -1, None if ends else 0
            at = i - off
            low = at - 1
            while low > 0 and s[low - 1 : at] in tails:
                low -= 1
            for k in range(low, at):
                found = numbers(s[k:at])
                if found is None:
                    continue
                a, b = found
                j = k + off
                before = last[j] * base
                if inner < 0 and a >= 0 and (j == 0 or inside[before + a]):
                    inner, inner_count = a, count[j] + 1
                    if closed is not None:
                        break
                if closed is None and b >= 0 and (j == 0 or ending[before + b]):
                    closed = count[j] + 1
                    if inner >= 0:
                        break
            if inner < 0 or closed is None:
                raise ValueError(f"no token of the vocabulary ends {s[:at]!r}")
            last.append(inner)
            count.append(inner_count)
            if ends:
                ended.append(closed)
        run.symbols = s[-self.longest :]
        if ended:
            run.closed = ended[-1]
        return ended

    def _piece(self, piece: str) -> bytes:
        """Changes of the count as a piece of its own, in lower case, grows by each code point."""
        ended = self._counts(piece)
        return bytes([b - a & 0xFF for a, b in zip([0, *ended], ended, strict=False)])

    def learn(self, pieces: list[str]) -> None:
        """Works out many pieces side by side, as ``_counts`` does one by one.

        Column i of the arrays holds what ``Run`` holds after i symbols.  Substrings are
        looked up by a 64-bit polynomial hash of their bytes.
        """
        coded = sorted(((p.encode(), p) for p in pieces if p[0] != "'"), key=lambda x: len(x[0]), reverse=True)
        coded = [x for x in coded if len(x[0]) <= TOGETHER]
        if not coded:
            return
        pieces = [p for _, p in coded]
        sizes = np.array([len(b) for b, _ in coded])
        letters = np.array([b for b, _ in coded], f"S{sizes[0]}").view(np.uint8).reshape(len(pieces), sizes[0])
        with np.errstate(over="ignore"):
            hashes = np.zeros((sizes[0] + 1, len(pieces)), np.uint64)
            for i in range(sizes[0]):
                hashes[i + 1] = hashes[i] * HASH + letters[:, i] + np.uint64(1)
            power = HASH ** np.arange(sizes[0] + 1, dtype=np.uint64)
        last = np.zeros((sizes[0] + 1, len(pieces)), np.int64)
        count = np.zeros((sizes[0] + 1, len(pieces)), np.int16)
        ended = np.zeros((sizes[0] + 1, len(pieces)), np.int16)
        for i in range(1, sizes[0] + 1):
            active = np.arange(np.searchsorted(-sizes, -i, "right"))
            for ends, apart, out in ((0, self.apart_inside, count), (1, self.apart_ending, ended)):
                left = active
                for j in range(max(0, i - self.longest), i):
                    with np.errstate(over="ignore"):
                        h = hashes[i, left] - hashes[j, left] * power[i - j]
                    at = np.minimum(np.searchsorted(self.hashed, h), len(self.hashed) - 1)
                    token = np.where(self.hashed[at] == h, self.hashed_numbers[at, ends], -1)
                    fits = token >= 0
                    if j:
                        some = np.flatnonzero(fits)
                        keys, back = np.unique(last[j, left[some]] * self.base + token[some], return_inverse=True)
                        fits[some] = np.fromiter(map(apart.__getitem__, keys.tolist()), bool, len(keys))[back]
                    rows = left[fits]
                    out[i, rows] = count[j, rows] + 1
                    if not ends:
                        last[i, rows] = token[fits]
                    left = left[~fits]
                    if not len(left):
                        break
                if len(left):
                    raise ValueError(f"no token of the vocabulary ends {pieces[left[0]][:i]!r}")
        ended = np.ascontiguousarray(ended.T)
        change = np.diff(ended, axis=1).astype(np.int8).tobytes()
        for k, (data, piece) in enumerate(coded):
            if len(data) == len(piece):
                self.pieces.put(piece, change[k * sizes[0] : k * sizes[0] + len(data)])
                continue
            at = [0, *(i for i in range(1, len(data) + 1) if i == len(data) or data[i] & 0xC0 != 0x80)]
            self.pieces.put(piece, np.diff(ended[k, at]).astype(np.int8).tobytes())

    def _counts(self, piece: str) -> list[int]:
        if piece[0] == "'" and piece[1:] in CONTRACTED:
            # One piece, but only as a whole: before that, an apostrophe and a letter.
            whole = lambda p: self._grow(Run(), p)[-1]
            return [whole("'"), *[whole("'") + whole(piece[1])] * (len(piece) - 2), whole(piece)]
        if len(piece) <= HEAD:
            return self._grow(Run(), piece)
        found = self.heads.get(piece[:HEAD])
        if found is None:
            run = Run()
            ended = self._grow(run, piece[:HEAD])
            if len(self.heads) >= HEAD_ENTRIES:
                self.heads.clear()
            found = self.heads[piece[:HEAD]] = run, ended
        run, ended = found
        return ended + self._grow(Run(run.symbols, run.last[:], run.count[:]), piece[HEAD:])

    def _kind(self, c: str) -> str:
        """How the library's splitting rule takes a code point: letter, number, space or other."""
        kind = self.kinds.get(c)
        if kind is None:
            kind = "space" if not self.pieces_of(c) else "letter" if len(self.pieces_of("a" + c)) == 1 else "other" if len(self.pieces_of("!" + c)) == 1 else "number"
            self.kinds[c] = kind
        return kind

    def _form(self, c: str) -> str:
        """The library's normal form of one code point."""
        form = self.forms.get(c)
        if form is None:
            form = self.forms[c] = self.normalise(c)
        return form

    def _fixed(self, c: str) -> bool:
        """Whether nothing from this code point on changes the normal form of what precedes it."""
        first = unicodedata.normalize("NFD", c)[0]
        return unicodedata.combining(first) == 0 and first not in self.joining and unicodedata.category(c) != "Cn"

    def _any_script(self, text: str) -> bytes:
        """Changes at each code point of any text without special tokens.

        Linear in the text, but for runs of marks on one letter that are not in normal
        form, whose prefixes are each normalised anew.
        """
        walk = Walk(self)
        out, before, letters = bytearray(), 0, []

        def grow(now: int) -> None:
            nonlocal before
            out.append(now - before & 0xFF)
            before = now

        def feed_letters() -> None:
            for now in walk.feed_letters("".join(letters)):
                grow(now)
            letters.clear()

        starts = [i for i, c in enumerate(text) if i == 0 or self._fixed(c)] + [len(text)]
        for lo, hi in zip(starts, starts[1:], strict=False):
            part = text[lo:hi]
            if hi - lo == 1 and walk.short is None:
                form = self._form(part)
                if len(form) == 1 and self._kind(form) == "letter":
                    letters.append(form)
                    continue
            if letters:
                feed_letters()
            if unicodedata.is_normalized("NFC", part):  # and so is each of its prefixes
                grown = ((self._form(c), False) for c in part)
            else:
                grown = ((self.normalise(part[: k + 1]), k + 1 < len(part)) for k in range(len(part)))
            for form, branch in grown:
                mark = walk.mark() if branch else None
                walk.feed(form)
                grow(walk.count())
                if mark is not None:
                    walk.back(mark)
        if letters:
            feed_letters()
        return bytes(out)

    def _plain(self, text: str) -> bytes:
        """Changes at each code point of a text without special tokens."""
        if text.isalpha() and simple(text):
            return self.pieces[text.lower()]
        if not simple(text) or SPACE.search(text):
            return self._any_script(text)
        return b"".join(map(self.pieces.__getitem__, PIECE.findall(text.lower())))

    def deltas(self, chunk: str) -> bytes:
        """The change of the count at each code point, one signed byte each."""
        if self.parted is None or "<|" not in chunk:
            return self._plain(chunk)
        out = b""
        parts = self.parted.split(chunk)
        for i in range(0, len(parts), 2):
            mark = parts[i + 1] if i + 1 < len(parts) else ""
            before, cut = self._plain(parts[i]), self._plain(parts[i] + mark[:-1])
            out += cut
            if mark:  # with its last code point, a special token is one token after what precedes it
                out += bytes([total(before) + 1 - total(cut) & 0xFF])
        return out


class Walk:
    """Counts of a text in its normal form as it grows by code points of any kind."""

    def __init__(self, counter: PrefixCounter):
        self.counter, self.run, self.kind, self.base = counter, Run(), "", 0
        # An apostrophe that starts a piece and what followed it: (count before it, text).
        self.short: tuple[int, str] | None = None

    def mark(self) -> tuple:
        return self.run, self.run.symbols, len(self.run.last) - 1, self.run.closed, self.kind, self.base, self.short

    def back(self, mark: tuple) -> None:
        self.run, symbols, size, closed, self.kind, self.base, self.short = mark
        self.run.cut(symbols, size, closed)

    def count(self) -> int:
        return self.base + self.run.closed

    def _finish(self) -> None:
        """Starts a new piece; the old run is left as it is, as a branch may go back to it."""
        self.base += self.run.closed
        self.run = Run()

    def feed_letters(self, letters: str) -> list[int]:
        """Adds letters, none behind an apostrophe that a contraction may begin with; returns the count after each."""
        if self.kind != "letter":
            self._finish()
            self.kind = "letter"
        return [self.base + ended for ended in self.counter._grow(self.run, letters)]

    def feed(self, form: str) -> None:
        for c in form:
            kind = self.counter._kind(c)
            if self.short is not None:
                before, seen = self.short
                if seen + c in CONTRACTED:
                    self.base, self.run, self.kind, self.short = before + self.counter._grow(Run(), "'" + seen + c)[-1], Run(), "", None
                    continue
                self.short = (before, c) if not seen and any(x[0] == c for x in CONTRACTED) else None
            if kind == "space":
                self._finish()
                self.kind = ""
                continue
            if kind != self.kind or kind == "number":
                self._finish()
                if c == "'":
                    self.short = self.base, ""
            self.kind = kind
            self.counter._grow(self.run, c)


def total(deltas: bytes) -> int:
    return int(np.frombuffer(deltas, np.int8).sum(dtype=np.int64))


@lru_cache(maxsize=4)
def _counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


@lru_cache(maxsize=4)
def _delta_memo(path: str) -> Memo:
    return Memo(_counter(path).deltas, CHUNK_BYTES)


def prefix_deltas(path: str, text: str) -> bytes:
    """One signed byte for each code point of the text: white space adds no token."""
    return b"\0".join(map(_delta_memo(path).__getitem__, chunks(text)))


def learn(path: str, texts: list[str]) -> None:
    """Works out the words of many texts that a worker does not know yet, side by side."""
    memo, counter = _delta_memo(path), _counter(path)
    fresh = [c for c in set().union(*map(chunks, texts)) if len(c) <= TOGETHER and c not in memo and c not in memo.old and simple(c)]
    words = set(PIECE.findall(" ".join(fresh).lower()))
    counter.learn([w for w in words if w not in counter.pieces and w not in counter.pieces.old])


def fitting(deltas: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    d = np.frombuffer(deltas, np.int8)
    if total(deltas) <= budget:
        return len(d)
    inside = np.flatnonzero(np.cumsum(d, dtype=np.int64) <= budget)
    return int(inside[-1]) + 1 if len(inside) else 0


def prefix_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", budget: int | None = None, keep_table: bool = True) -> DataFrame:
    """Per row of ``docs``: its id, ``n_bytes``, ``n_tokens`` and ``prefix_deltas`` (unless ``keep_table`` is false).

    With ``budget``, also ``fit_chars``: the code points of the longest prefix of at most
    so many tokens.  ``path`` names a vocabulary file that every executor has.  A null text
    counts as empty (0 bytes, 0 tokens, an empty table).  Rows that repeat stay; other
    columns of ``docs`` are not read.
    """
    kept = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["doc_id", "n_bytes", "n_tokens"] + ["fit_chars"] * (budget is not None) + ["prefix_deltas"] * keep_table
    schema = ", ".join([f"doc_id {dict(kept.dtypes)['doc_id']}"] + [f"{c} {'binary' if c == 'prefix_deltas' else 'long'}" for c in names[1:]])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=LEARN_BYTES):
            size, tokens, fit, table = [], [], [], []
            texts = batch.column("text").to_pylist()
            learn(path, texts)
            for text in texts:
                d = prefix_deltas(path, text)
                size.append(len(text.encode()))
                tokens.append(total(d))
                if budget is not None:
                    fit.append(fitting(d, budget))
                if keep_table:
                    table.append(d)
            made = {"doc_id": batch.column("doc_id"), "n_bytes": pa.array(size, pa.int64()), "n_tokens": pa.array(tokens, pa.int64()), "fit_chars": pa.array(fit, pa.int64()), "prefix_deltas": pa.array(table, pa.binary())}
            yield pa.record_batch([made[c] for c in names], names)

    return kept.mapInArrow(counted, schema)


def truncation(table: DataFrame, budget: int) -> DataFrame:
    """Adds ``fit_chars`` to a stored table: the code points of the longest prefix of at most ``budget`` tokens."""

    @F.pandas_udf("long")
    def fit(deltas: pd.Series) -> pd.Series:
        return deltas.map(lambda d: fitting(d, budget))

    return table.withColumn("fit_chars", fit("prefix_deltas"))


def count_at(table: DataFrame, position: str) -> DataFrame:
    """Adds ``tokens_at``: the exact count of the prefix of ``position`` code points (a column)."""

    @F.pandas_udf("long")
    def at(deltas: pd.Series, where: pd.Series) -> pd.Series:
        return pd.Series([total(d[: max(0, int(p))]) for d, p in zip(deltas, where, strict=True)], dtype="int64")

    return table.withColumn("tokens_at", at("prefix_deltas", F.coalesce(F.col(position), F.lit(0))))
