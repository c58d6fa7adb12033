"""Packing token sequences: first-fit decreasing in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import materialise, slices
from marlstone.llm.vocab import text_ids

#: Tokens of a sequence.
CAPACITY = 4096
#: Pieces that one group holds on average; a group is packed by one task.
GROUP_PIECES = 16_384


def token_pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts each document's ids (the text's ids, then ``end_id``) into runs of ``capacity`` and a rest.

    Returns doc_id, start, length, ids_crc32, doc_tokens and ``row``, a number of the
    piece that no other piece has.  A null text counts as empty: one piece of one id.
    """
    kept = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"doc_id {dict(kept.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long"
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at: list[int] = []
            start, length, crc, tokens = [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                ids = memoryview(text_ids(path, text) + end)
                n = len(ids) // 4
                for lo in range(0, n, capacity):
                    part = ids[4 * lo : 4 * (lo + capacity)]
                    at.append(k)
                    start.append(lo)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    tokens.append(n)
            yield pa.record_batch([batch.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return kept.mapInArrow(cut, schema).withColumn("row", F.monotonically_increasing_id())


def first_fit(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each size, in order: the first open bin with room, else a new one.

    A tournament tree over the bins holds in each node the most room below it, so the
    first bin with room is found, and its room updated, in as many steps as the tree is high.
    """
    leaves = 1 << max(0, len(sizes) - 1).bit_length()
    room = [capacity] * (2 * leaves)
    placed = []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        placed.append((node - leaves, capacity - room[node]))
        room[node] -= size
        while node > 1:
            node //= 2
            left, right = room[2 * node], room[2 * node + 1]
            room[node] = left if left >= right else right
    return placed


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, seed: int = 0) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of at most ``capacity`` tokens.

    Each piece goes to a random group by a hash of its ``row`` (a document with many
    pieces, or a text that repeats, spreads over all groups), and groups are packed
    independently, longest pieces first.  ``pieces`` must be a written table: it is
    counted, then read again.  An empty table gives an empty table.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    out = pieces.withColumn("grp", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(groups)))
    schema = ", ".join(f"{c} {t}" for c, t in pieces.drop("row").dtypes) + ", sequence_id long, offset long"
    columns = pieces.drop("row").columns

    def pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        placed = np.array(first_fit(pdf["length"].tolist(), capacity), np.int64).reshape(-1, 2)
        out = pdf[columns].copy()
        out["sequence_id"] = (int(pdf["grp"].iloc[0]) << 32) + placed[:, 0]
        out["offset"] = placed[:, 1]
        return out

    return out.groupBy("grp").applyInPandas(pack_group, schema)


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY, **options) -> DataFrame:
    """Tokenises, cuts and packs ``docs``: one row per piece, see ``token_pieces`` and ``pack``."""
    return pack(materialise(token_pieces(docs, path, end_id, capacity), "pieces"), capacity, **options)
