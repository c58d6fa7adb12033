"""Token sequences in training order, as binary shards of a fixed stride.

Every sequence has an index without gaps.  A keyed Feistel network permutes the indexes:
it is a bijection of the next even number of bits, and what falls outside the count walks
on along its cycle until it is inside.  The result is the sequence's slot.  Slots are
dealt to shards by range, compressed on their way; a shard is one file of its slots' sequences in order, each of
the same number of bytes.  So a reader finds slot s in shard s // per_shard at byte
(s % per_shard) * stride, reads on from there, and resumes anywhere.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import discard, materialise, shared_path, slices
from marlstone.llm.vocab import text_ids, tokenizer

#: Tokens of a sequence, and sequences of a shard (8 MiB of 16-bit ids).
LENGTH, PER_SHARD = 1024, 4096
ROUNDS = 8
#: Bytes of sequences that a task deals to shards at a time.
HELD = 32 << 20


class Feistel:
    """A keyed permutation of 0 ... count - 1."""

    def __init__(self, count: int, key: int):
        self.count = count
        self.half = max(1, -(-max(1, (count - 1).bit_length()) // 2))
        self.keys = np.random.default_rng(key).integers(0, 1 << 63, ROUNDS, np.uint64)

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        h, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> h, x & mask
        for k in keys:
            left, right = right, left ^ self._round(right, k)
        return (right << h) | left

    def _walk(self, index: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = self._once(index.astype(np.uint64), keys)
        while len(outside := np.flatnonzero(out >= self.count)):
            out[outside] = self._once(out[outside], keys)
        return out.astype(np.int64)

    def slots(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, self.keys)

    def indexes(self, slot: np.ndarray) -> np.ndarray:
        """The inverse of ``slots``."""
        return self._walk(slot, self.keys[::-1])


def sequences(docs: DataFrame, path: str, end_id: int, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts each task's documents (a text's ids, then ``end_id``, one after another) into sequences of ``length``.

    Returns ``task`` and ``place`` (the sequence's place in its task, from 0), first_doc and
    first_start (the document of the first token, and that token's place in it), n_docs
    (documents that the sequence holds tokens of), n_tokens, and ``ids``: little-endian
    unsigned 16-bit ids, a task's last sequence padded with ``end_id``.  A null text is
    empty.  Ids of 65,536 and more are an error before the job.  Sequences do not cross
    tasks, so they depend on how the input is split: the same splits give the same shards.
    """
    kept = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dtype = dict(kept.dtypes)["doc_id"]
    end = np.array([end_id], "<u4").tobytes()
    names = ["task", "place", "first_doc", "first_start", "n_docs", "n_tokens", "ids"]
    most = tokenizer(path).get_vocab_size() - 1
    if max(most, end_id) >= 1 << 16:
        raise ValueError(f"ids up to {max(most, end_id)} do not fit 16 bits")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens that fill no sequence yet, and the documents they are of, wait for the next slice."""
        task, place = TaskContext.get().partitionId(), 0
        tokens, docs_of = np.empty(0, "<u2"), None
        # Where each waiting document starts, counted from the first waiting token (before it: negative).
        starts = np.empty(0, np.int64)

        def taken(size: int, n_rows: int) -> pa.RecordBatch:
            """The first ``n_rows`` sequences; the last may be short of ``length`` tokens."""
            at = np.arange(n_rows, dtype=np.int64) * length
            ends = np.minimum(at + length, size)
            first = np.searchsorted(starts, at, "right") - 1
            n_docs = np.searchsorted(starts, ends, "left") - first
            padded = np.full(n_rows * length, end_id, "<u2")
            padded[:size] = tokens[:size]
            offsets = np.arange(n_rows + 1, dtype=np.int32) * (2 * length)
            ids = pa.Array.from_buffers(pa.binary(), n_rows, [None, pa.py_buffer(offsets), pa.py_buffer(padded)])
            return pa.record_batch([pa.array(np.full(n_rows, task, np.int32)), pa.array(place + np.arange(n_rows)), docs_of.take(pa.array(first)), pa.array(at - starts[first]), pa.array(n_docs), pa.array(ends - at), ids], names)

        for batch in slices(batches):
            parts = [text_ids(path, text) + end for text in batch.column("text").to_pylist()]
            sizes = np.array([len(p) // 4 for p in parts], np.int64)
            starts = np.concatenate([starts, len(tokens) + np.cumsum(sizes) - sizes])
            tokens = np.concatenate([tokens, np.frombuffer(b"".join(parts), "<u4").astype("<u2")])
            docs_of = batch.column("doc_id") if docs_of is None else pa.concat_arrays([docs_of, batch.column("doc_id")])
            full = len(tokens) // length
            if full:
                yield taken(full * length, full)
                place += full
                left = max(0, int(np.searchsorted(starts, full * length, "right")) - 1)
                tokens, starts, docs_of = tokens[full * length :].copy(), starts[left:] - full * length, docs_of[left:]
        if len(tokens):
            yield taken(len(tokens), 1)

    return kept.mapInArrow(cut, f"task int, place long, first_doc {dtype}, first_start long, n_docs long, n_tokens long, ids binary")


def with_index(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` (a written table) with ``index`` 0 ... count - 1 and no gaps, and the count.

    Rows carry the number of the task that wrote them (``task``) and their place there
    (``place``); one number for each task is summed up on the driver.
    """
    sizes = sorted((r["task"], r["n"]) for r in rows.groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for task, n in sizes:
        starts.append((task, total))
        total += n
    first = rows.sparkSession.createDataFrame(starts, "task int, first long")
    return rows.join(F.broadcast(first), "task").withColumn("index", F.col("first") + F.col("place")).drop("task", "place", "first"), total


def _held(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together until they have ``rows`` rows; the last may have fewer."""
    held = []
    for batch in batches:
        held += [batch] if batch.num_rows else []
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _put(filesystem: fs.FileSystem, path: str, data: bytes) -> None:
    """Writes a file that appears whole: a task that runs again replaces it by the same bytes."""
    part = f"{path}.{np.random.default_rng().integers(1 << 62):x}.part"
    with filesystem.open_output_stream(part) as out:
        out.write(data)
    filesystem.move(part, path)


def write_shards(docs: DataFrame, path: str, out: str, end_id: int, key: int = 0, length: int = LENGTH, per_shard: int = PER_SHARD, **columns) -> DataFrame:
    """Writes ``docs`` in training order below ``out`` (a URI that all executors can write).

    Returns the manifest, a written table with a row per sequence: slot, shard, position,
    and ``sequences``' first_doc, first_start, n_docs and n_tokens.  Rows that repeat get slots of their own; no rows, no shards.
    """
    written = materialise(sequences(docs, path, end_id, length, **columns), "sequences", "zstd")
    rows, count = with_index(written)
    order = Feistel(max(1, count), key)

    shards = max(1, -(-count // per_shard))
    filesystem, root = fs.FileSystem.from_uri(out)
    filesystem.create_dir(root, recursive=True)
    kept = ["first_doc", "first_start", "n_docs", "n_tokens"]
    dtype = dict(rows.dtypes)["first_doc"]
    stride = 2 * length

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for what about ``HELD`` bytes of sequences have for a shard, their ids compressed together."""
        codec = pa.Codec("zstd", compression_level=1)
        for table in _held(batches, max(1, HELD // stride)):
            slots = order.slots(table.column("index").to_numpy())
            by_slot = np.argsort(slots)
            slots, table = slots[by_slot], table.take(pa.array(by_slot))
            runs = _runs(slots // per_shard)
            ids = table.column("ids")
            blobs = [codec.compress(b"".join(ids.slice(lo, hi - lo).to_pylist()), asbytes=True) for lo, hi in runs]
            edges = pa.array([0, *(hi for _, hi in runs)], pa.int32())
            lists = [pa.ListArray.from_arrays(edges, column) for column in (pa.array(slots), *(table.column(c).combine_chunks() for c in kept))]
            yield pa.record_batch([pa.array([int(slots[lo] // per_shard) for lo, _ in runs], pa.int32()), *lists, pa.array(blobs, pa.binary())], ["shard", "slot", *kept, "blob"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition holds one shard."""
        target, base = fs.FileSystem.from_uri(out)
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        shard = table.column("shard")[0].as_py()
        slots, *others = (pc.list_flatten(table.column(c)).combine_chunks() for c in ("slot", *kept))
        sizes = pc.list_value_length(table.column("slot")).to_pylist()
        blobs = zip(table.column("blob").to_pylist(), sizes, strict=True)
        data = b"".join(pa.decompress(blob, decompressed_size=n * stride, codec="zstd", asbytes=True) for blob, n in blobs)
        slots = slots.to_numpy()
        by_slot = np.argsort(slots)
        _put(target, posixpath.join(base, f"shard-{shard:08d}.bin"), np.frombuffer(data, np.uint8).reshape(-1, stride)[by_slot].tobytes())
        slots, take = slots[by_slot], pa.array(by_slot)
        yield pa.record_batch([pa.array(slots), pa.array(slots // per_shard), pa.array(slots % per_shard), *(c.take(take) for c in others)], ["slot", "shard", "position", *kept])

    lists = ", ".join(["slot array<long>", f"first_doc array<{dtype}>", *(f"{c} array<long>" for c in kept[1:])])
    parts = rows.mapInArrow(dealt, f"shard int, {lists}, blob binary").repartitionById(shards, "shard")
    manifest = materialise(parts.mapInArrow(store, f"slot long, shard long, position long, first_doc {dtype}, first_start long, n_docs long, n_tokens long"), "manifest")
    discard(written)
    return manifest


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(values)) + 1
    edges = [0, *cuts.tolist(), len(values)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def read_shards(spark, out: str, length: int = LENGTH, per_shard: int = PER_SHARD, start_slot: int = 0) -> DataFrame:
    """(slot, ids) of every sequence from ``start_slot`` on, from the shard files alone."""
    stride = 2 * length
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(out)
    shard = F.regexp_extract("path", r"shard-([0-9]+)\.bin", 1).cast("long")
    files = files.select(shard.alias("shard"), "content", "length").where((F.col("shard") + 1) * per_shard > start_slot)
    places = F.sequence(F.greatest(F.lit(start_slot) - F.col("shard") * per_shard, F.lit(0)), F.floor(F.col("length") / stride) - 1)
    rows = files.where(F.col("length") > 0).withColumn("position", F.explode(places))
    return rows.select((F.col("shard") * per_shard + F.col("position")).alias("slot"), F.substring("content", (F.col("position") * stride + 1).cast("int"), F.lit(stride)).alias("ids"))


def training_order(docs: DataFrame, path: str, end_id: int, **options) -> DataFrame:
    """Writes shards to the shared folder and returns the manifest with ``ids_crc32`` as read back."""
    spark = docs.sparkSession
    out = shared_path(spark, "shards")
    manifest = write_shards(docs, path, out, end_id, **options)
    sizes = {k: options[k] for k in ("length", "per_shard") if k in options}
    crc = F.crc32("ids").alias("ids_crc32")
    if manifest.isEmpty():
        return manifest.withColumn("ids_crc32", F.lit(None).cast("long"))
    back = read_shards(spark, out, **sizes).select("slot", crc)
    return manifest.join(back.hint("merge"), "slot")
