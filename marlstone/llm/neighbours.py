"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors are turned by pseudo-random rotations, three rounds of random signs and a
Hadamard transform, and assigned to the nearest signed axis.  A table's key joins the
axes of several rotations; as vectors become more, so do the rotations of a key, which
keeps groups as small as before.  Queries also visit the keys that they nearly had
(multiprobe), more of them as keys become more.  What a query meets in any table is ranked
by the exact cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import discard, materialise

#: Tables, keys that a query visits in each at least, and vectors that a key holds on average.
TABLES, PROBES, GROUP = 12, 24, 64
#: Vectors of a key that one task compares at a time; larger groups are cut into such blocks.
BLOCK = 2048


def probes_for(count: int, group: int = GROUP) -> int:
    """Keys to visit in each table: the square root of all keys, which keeps the recall as vectors become more."""
    return max(PROBES, math.ceil(math.sqrt(count / group)))


def hadamard(n: int) -> np.ndarray:
    h = np.ones((1, 1))
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h / np.sqrt(n)


class CrossPolytope:
    """Table keys of unit vectors; the same on every executor."""

    def __init__(self, dims: int, bits: float, tables: int = TABLES, seed: int = 7):
        size = 1 << max(1, (dims - 1).bit_length())
        self.dims, self.size, self.tables = dims, size, tables
        # Full rotations, and of a last one only as many axes as the bits that are left need.
        full, rest = divmod(bits, np.log2(2 * size))
        last = int(round(2**rest / 2))
        self.axes = [size] * int(full) + ([min(size, last)] if last >= 1 else [])
        self.axes = self.axes or [1]
        random = np.random.default_rng(seed)
        h = hadamard(size)
        signs = random.choice([-1.0, 1.0], (tables, len(self.axes), 3, size))
        # Rotations as matrices: the padded input needs only the first rows.
        self.turn = np.stack([np.stack([((np.diag(s[0]) @ h) * s[1] @ h * s[2] @ h)[:dims] for s in row]) for row in signs])

    def _scores(self, unit: np.ndarray, table: int) -> list[np.ndarray]:
        """Per rotation, how near each of the signed axes is: +1, -1, +2, -2, ..."""
        out = []
        for k, axes in enumerate(self.axes):
            y = unit @ self.turn[table, k][:, :axes]
            out.append(np.stack([y, -y], axis=2).reshape(len(unit), 2 * axes))
        return out

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """Per vector and table, its key."""
        out = np.zeros((len(unit), self.tables), np.int64)
        for t in range(self.tables):
            for scores in self._scores(unit, t):
                out[:, t] = out[:, t] * scores.shape[1] + scores.argmax(axis=1)
            out[:, t] = out[:, t] * self.tables + t
        return out

    def probes(self, unit: np.ndarray, probes: int = PROBES) -> np.ndarray:
        """Per vector and table, the keys to visit: those that lose least in nearness, its own first."""
        out = np.full((len(unit), self.tables, probes), -1, np.int64)
        for t in range(self.tables):
            keys, loss = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
            for scores in self._scores(unit, t):
                top = min(probes, scores.shape[1])
                order = np.argsort(-scores, axis=1, kind="stable")[:, :top]
                near = np.take_along_axis(scores, order, 1)
                step = (near[:, :1] - near) ** 2 + (near[:, :1] - near)
                keys = (keys[:, :, None] * scores.shape[1] + order[:, None, :]).reshape(len(unit), -1)
                loss = (loss[:, :, None] + step[:, None, :]).reshape(len(unit), -1)
                best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
                keys, loss = np.take_along_axis(keys, best, 1), np.take_along_axis(loss, best, 1)
            out[:, t, : keys.shape[1]] = keys * self.tables + t
        return out


def _unit(vectors: list) -> np.ndarray:
    v = np.array(vectors, np.float64)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _keyed(frame: DataFrame, hasher: CrossPolytope, probes: int | None) -> DataFrame:
    """(vid, vector, key): a row per table, or per visited key if ``probes`` is given."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                unit = _unit(part.column("vector").to_pylist())
                keys = hasher.keys(unit) if probes is None else hasher.probes(unit, probes).reshape(len(unit), -1)
                at, which = np.nonzero(keys >= 0)
                at = pa.array(at)
                yield pa.record_batch([part.column("vid").take(at), part.column("vector").take(at), pa.array(keys[at, which])], ["vid", "vector", "key"])

    return frame.select("vid", "vector").mapInArrow(keyed, "vid long, vector array<double>, key long")


def _best_in_block(k: int):
    """Of a block's candidates, the ``k`` nearest to each query, by exact cosine; ties to the smaller id."""

    def best(queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(found):
            return pd.DataFrame({"qid": [], "vid": [], "score": []}).astype({"qid": "int64", "vid": "int64", "score": "float64"})
        found = found.sort_values("vid")
        c = np.array(found["vector"].tolist(), np.float64)
        vid = found["vid"].to_numpy()
        length = np.sqrt((c * c).sum(axis=1))
        out = []
        for i in range(0, len(queries), 256):
            q = np.array(queries["vector"].iloc[i : i + 256].tolist(), np.float64)
            score = (q @ c.T) / (np.sqrt((q * q).sum(axis=1))[:, None] * length)
            order = np.argsort(-score, axis=1, kind="stable")[:, :k]
            qid = np.repeat(queries["vid"].to_numpy()[i : i + 256], order.shape[1])
            out.append(pd.DataFrame({"qid": qid, "vid": vid[order.ravel()], "score": np.take_along_axis(score, order, 1).ravel()}))
        return pd.concat(out)

    return best


def _met(queries: DataFrame, index: DataFrame, k: int, block: int) -> DataFrame:
    """(qid, vid, score): the ``k`` nearest in each block that a query visits, each pair once."""
    sizes = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n")
    index = index.join(sizes.hint("merge"), "key").withColumn("block", F.pmod(F.xxhash64("vid"), F.col("blocks").cast("long")).cast("int"))
    queries = queries.join(sizes.hint("merge"), "key").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    by = ["key", "block"]
    met = queries.select("vid", "vector", *by).groupBy(*by).cogroup(index.select("vid", "vector", *by).groupBy(*by))
    return met.applyInPandas(_best_in_block(k), "qid long, vid long, score double").groupBy("qid", "vid").agg(F.max("score").alias("score"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, probes: int | None = None, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest found of ``vectors`` for each row of ``queries``: query_id, rank, vec_id, score.

    ``queries`` are rows of ``vectors`` (same ids); a row is not its own neighbour.
    Nearness is the cosine in double precision, ties go to the smaller id.  Vectors that
    are null, zero, of another length than the most, or hold null or non-finite components,
    and rows without an id, take no part; of rows that repeat an id with other vectors, the
    one of the least digest counts.  Equal vectors
    are one vector with its ``k`` + 1 smallest ids, so many copies are compared once.
    Without ``probes`` their number follows that of the vectors (``probes_for``).  A
    query that meets fewer than ``k`` others visits all keys.
    """
    clean = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    usable = lambda v: F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), clean.alias("vector")).where(F.col("vec_id").isNotNull() & F.coalesce(usable(F.col("vector")), F.lit(False)))
    dims = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vector") == dims["d"])

    # Equal vectors: a class with its smallest ids, found before rows of a class meet.
    digest = F.sha2(F.to_json(F.struct("vector")), 256)
    own = F.min(F.struct(digest.alias("digest"), F.col("vector"))).alias("own")
    ids = rows.groupBy("vec_id").agg(own).select("vec_id", "own.vector", "own.digest")
    smallest = ids.select("digest", "vec_id").withColumn("r", F.row_number().over(Window.partitionBy("digest").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    members = materialise(smallest.select("digest", "vec_id", "r"), "members")
    named = members.where("r = 1").select("digest", F.col("vec_id").alias("vid"))
    classes = materialise(ids.join(named.hint("merge"), "digest").where("vec_id = vid").select("vid", "vector", "digest"), "vectors")
    asked = queries.select(F.col(id_col).alias("vec_id")).where("vec_id is not null").distinct()
    asked = materialise(ids.select("vec_id", "digest").join(asked, "vec_id", "left_semi").join(named.hint("merge"), "digest").select(F.col("vec_id").alias("query_id"), F.col("vid").alias("qid")), "asked")

    count = classes.count()
    hasher = CrossPolytope(dims["d"], max(1.0, np.log2(max(2, count) / group)), tables)
    sought = classes.join(asked.select(F.col("qid").alias("vid")).distinct(), "vid", "left_semi")
    met = materialise(_met(_keyed(sought, hasher, probes or probes_for(count, group)), _keyed(classes, hasher, None), k + 1, block), "met")
    # Each class met stands for at most k + 1 ids, enough to fill the ranks without the query's own.
    few = met.join(members.withColumnRenamed("vec_id", "member").join(named, "digest").groupBy("vid").agg(F.count(F.lit(1)).alias("m")), "vid").groupBy("qid").agg(F.sum("m").alias("m"))
    starved = asked.select("qid").distinct().join(few, "qid", "left").where(F.coalesce("m", F.lit(0)) < k + 1).select(F.col("qid").alias("vid"))
    if count > 1 and not starved.isEmpty():
        one = CrossPolytope(dims["d"], np.log2(2 * hasher.size), 1)
        every = _keyed(classes.join(starved, "vid", "left_semi"), one, 2 * hasher.size)
        met = materialise(met.union(_met(every, _keyed(classes, one, None), k + 1, block)).groupBy("qid", "vid").agg(F.max("score").alias("score")), "met")

    best = met.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vid"))).where(F.col("r") <= k + 1).drop("r")
    spread = best.join(named, "vid").join(members.select("digest", "vec_id"), "digest").select("qid", "vec_id", "score")
    pairs = asked.join(spread.hint("merge"), "qid").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
