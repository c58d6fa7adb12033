"""Tokenising whole texts by distinct white-space chunks, with the public library.

The tokenizer of ``word_bpe_49k.json`` drops white space and never forms a token
across it, so a text's ids are those of its chunks one after another.  Words repeat,
so each worker keeps the ids of the chunks that it saw of late.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that each of a memo's two generations holds, by the estimate that ``ENTRY`` bytes
#: come on top of a result; an entry of a usual word takes about 150.
MEMO_BYTES, ENTRY = 48 << 20, 130
#: Longer chunks are not kept.
MEMO_CHARS = 48


class Memo(dict):
    """A function's latest results: the older of two generations goes when the younger is full."""

    def __init__(self, fn, size: int = MEMO_BYTES):
        super().__init__()
        self.fn, self.size, self.held, self.old = fn, size, 0, {}

    def __missing__(self, key: str):
        found = self.old.get(key)
        if found is None:
            found = self.fn(key)
        if len(key) <= MEMO_CHARS:
            self.put(key, found)
        return found

    def put(self, key: str, found) -> None:
        if self.held >= self.size:
            self.old, self.held = dict(self), 0
            self.clear()
        self[key] = found
        self.held += ENTRY + (len(key) if key.isascii() else 4 * len(key)) + len(found)


def chunks(text: str) -> list[str]:
    """The text between single spaces, tabs and line ends; empty strings between adjacent ones.

    Only these part chunks; any other white space is left to the library.
    """
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


#: The pieces into which the vocabulary file's splitting rule cuts a chunk.
PIECE = regex.compile(r"'(?:s|t|re|ve|m|ll|d)|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def simple(chunk: str) -> bool:
    """Latin letters in normal form, no special token: each code point is lower-cased alone."""
    return "<|" not in chunk and (chunk.isascii() or ord(max(chunk)) < 0x250 and "İ" not in chunk)


@lru_cache(maxsize=4)
def id_memo(path: str) -> Memo:
    """Chunk -> its ids as little-endian unsigned 32-bit integers."""
    tokenize, encode = tokenizer(path).model.tokenize, tokenizer(path).encode
    symbol = dict(enumerate(byte_symbols()))

    def piece_ids(piece: str) -> bytes:
        return array("I", [t.id for t in tokenize(piece.encode().decode("latin-1").translate(symbol))]).tobytes()

    # Marks and single digits, which most chunks end in, are few.
    short = {}

    def ids(chunk: str) -> bytes:
        if not simple(chunk):
            return array("I", encode(chunk, add_special_tokens=False).ids).tobytes()
        chunk = chunk.lower()
        if chunk.isalpha():
            return piece_ids(chunk)
        out = []
        for piece in PIECE.findall(chunk):
            if len(piece) > 2:
                # A word before a mark was mostly seen alone, or before another mark.
                out.append(memo[piece] if piece.isalpha() else piece_ids(piece))
                continue
            if piece not in short:
                if len(short) >= 10_000:
                    short.clear()
                short[piece] = piece_ids(piece)
            out.append(short[piece])
        return b"".join(out)

    memo = Memo(ids)
    return memo


def lowered(text: str) -> str:
    """The text in lower case if that is how the tokenizer sees it: single-byte letters, no special token."""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def text_ids(path: str, text: str) -> bytes:
    """The ids of a whole text, as the library gives them, as unsigned 32-bit integers."""
    return b"".join(map(id_memo(path).__getitem__, chunks(lowered(text))))


def with_token_counts(docs: DataFrame, path: str, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the tokens of each text, as packing counts them but for its end mark, in column ``name``."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(text_ids(path, t)) // 4)

    return docs.withColumn(name, count(F.coalesce(F.col(text_col), F.lit(""))))
