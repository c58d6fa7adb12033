"""Toxicity scores from confirmed toxic examples and unlabelled text.

No text counts as clean: a linear model is trained by the non-negative positive-unlabelled
risk.  With P the confirmed examples, U unlabelled texts, c the share of toxic texts, f the
model and l the logistic loss, it lessens

    c * mean over P of l(f)  +  max(0, mean over U of l(-f) - c * mean over P of l(-f)),

where the second part stands for the risk on clean texts, which can not be below 0; a step
that takes it there goes back up instead.

Features are a text's distinct words and their beginnings of three to eight letters, as
inflected words share a stem; each counts once, however long a text is.  Several models,
each from its own bounded sample, are fitted in tasks of their own; a score is the mean.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import materialise, slices

#: Models, and the confirmed and unlabelled texts that each is fitted on at most, in order of
#: a hash that differs for each model; and their distinct features, added up, at most.
MODELS, CONFIRMED, UNLABELLED, SAMPLE_FEATURES = 3, 2_500, 5_000, 15_000_000
#: From this score on a text is taken to be toxic.
TOXIC = 0.7
#: Letters of the beginnings that are features.
STEMS = range(3, 9)
#: Letters from which a run (of a script without spaces) is taken apart, and those of its parts.
LONG, PART = 32, 3
#: Confirmed texts that a feature must stand in, by how many standard deviations its share of
#: them must lie apart from its share of the unlabelled ones, and features with weights, at most.
LEAST_TEXTS, EXCESS, FEATURES = 3, 2.0, 100_000
#: Share of toxic texts where no label tells it, and the bounds it is held in.
PRIOR, LEAST_PRIOR, MOST_PRIOR = 0.1, 0.005, 0.5
#: Passes over the sample, step, and what holds weights at 0.
ROUNDS, STEP, SPARSE = 400, 0.05, 1e-4
#: Words whose features a worker keeps, and code points from which a text's words are not listed at once.
KEPT_WORDS, LONG_TEXT = 400_000, 1 << 20

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    """The distinct words of a whole text in lower case; very long runs give their parts."""
    text = (text or "").lower()
    found = set(_WORD.findall(text)) if len(text) < LONG_TEXT else {m.group() for m in _WORD.finditer(text)}
    for run in [w for w in found if len(w) >= LONG]:
        found.discard(run)
        found.update(run[i : i + PART] for i in range(len(run) - PART + 1))
    return found


def features_of(word: str) -> list[int]:
    """Checksums of a word and of its beginnings."""
    return [zlib.crc32(f"{word}>".encode()), *(zlib.crc32(word[:k].encode()) for k in STEMS if k <= len(word))]


class Features:
    """The distinct features of texts, those of words kept."""

    def __init__(self):
        self.known: dict[str, list[int]] = {}

    def of(self, text: str | None) -> np.ndarray:
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        found: set[int] = set()
        for w in words_of(text):
            own = self.known.get(w)
            if own is None:
                own = self.known[w] = features_of(w)
            found.update(own)
        return np.fromiter(found, np.uint32, len(found))


def _shares(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Features, sorted, and in how many texts each stands."""
    return np.unique(np.concatenate([*lists, np.empty(0, np.uint32)]), return_counts=True)


def _telling(confirmed: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Features of enough confirmed texts, and of another share of them than of the unlabelled ones, beyond chance."""
    seen, count = _shares(confirmed)
    ok = count >= min(LEAST_TEXTS, max(1, len(confirmed) // 10))
    seen, count = seen[ok], count[ok]
    others, usual = _shares(unlabelled)
    place = np.searchsorted(others, seen).clip(0, max(0, len(others) - 1))
    there = others[place] == seen if len(others) else np.zeros(len(seen), bool)
    share = (np.where(there, usual[place] if len(usual) else 0, 0) + 1) / (len(unlabelled) + 2)
    excess = (count / len(confirmed) - share) / np.sqrt(share * (1 - share) / len(confirmed))
    ok = np.abs(excess) > EXCESS
    seen, excess = seen[ok], excess[ok]
    return np.sort(seen[np.argsort(-np.abs(excess), kind="stable")[:FEATURES]])


class PositiveUnlabelled:
    """A sparse linear model under the non-negative positive-unlabelled risk, in numpy."""

    def __init__(self, prior: float, rounds: int = ROUNDS, step: float = STEP, sparse: float = SPARSE):
        self.prior, self.rounds, self.step, self.sparse = prior, rounds, step, sparse

    def fit(self, confirmed: list[np.ndarray], unlabelled: list[np.ndarray]) -> PositiveUnlabelled:
        """Fits texts as their features; only those that tell confirmed texts apart get a weight."""
        n_p, n_u = len(confirmed), len(unlabelled)
        seen = _telling(confirmed, unlabelled)
        lists = [x[np.isin(x, seen)] for x in confirmed + unlabelled]
        text = np.repeat(np.arange(n_p + n_u, dtype=np.int32), [len(x) for x in lists])
        place = np.searchsorted(seen, np.concatenate(lists))
        self.ids, self.weights, self.bias = seen.astype(np.int64), np.zeros(len(seen)), float(np.log(self.prior / (1 - self.prior)))
        share_p, share_u = np.r_[np.full(n_p, 1 / max(1, n_p)), np.zeros(n_u)], np.r_[np.zeros(n_p), np.full(n_u, 1 / max(1, n_u))]
        moment, square, beta = np.zeros(len(seen) + 1), np.zeros(len(seen) + 1), (0.9, 0.999)
        for t in range(1, self.rounds + 1):
            f = np.bincount(text, self.weights[place], n_p + n_u) + self.bias
            toxic = 1 / (1 + np.exp(-np.clip(f, -40, 40)))
            clean_risk = np.logaddexp(0, f) @ (share_u - self.prior * share_p)
            clean_slope = toxic * (share_u - self.prior * share_p)
            slope = clean_slope - self.prior * (1 - toxic) * share_p if clean_risk >= 0 else -clean_slope
            g = np.r_[np.bincount(place, slope[text], len(seen)), slope.sum()]
            moment, square = beta[0] * moment + (1 - beta[0]) * g, beta[1] * square + (1 - beta[1]) * g * g
            scale = self.step / (np.sqrt(square / (1 - beta[1] ** t)) + 1e-6)
            moved = np.r_[self.weights, self.bias] - scale * moment / (1 - beta[0] ** t)
            # Weights, not the bias, are drawn to 0.
            hold = np.minimum(scale[:-1] * self.sparse, np.abs(moved[:-1]))
            self.weights, self.bias = moved[:-1] - np.sign(moved[:-1]) * hold, float(moved[-1])
        some = self.weights != 0
        self.ids, self.weights = self.ids[some], self.weights[some]
        return self


class Scorer:
    """Scores of fitted models, their mean; the same on every executor."""

    def __init__(self, models: list[tuple[float, list[int], list[float]]]):
        ids = sorted({i for _, own, _ in models for i in own})
        self.place = {i: k for k, i in enumerate(ids)}
        self.weights = np.zeros((len(ids), len(models)))
        self.bias = np.array([m[0] for m in models])
        for k, (_, own, weights) in enumerate(models):
            self.weights[[self.place[i] for i in own], k] = weights
        self.known: dict[str, tuple[int, ...]] = {}

    def score(self, text: str | None) -> float:
        hits: set[int] = set()
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        for word in words_of(text):
            own = self.known.get(word)
            if own is None:
                own = self.known[word] = tuple(self.place[i] for i in features_of(word) if i in self.place)
            if own:
                hits.update(own)
        f = self.bias + self.weights[sorted(hits)].sum(axis=0)
        return float((1 / (1 + np.exp(-np.clip(f, -40, 40)))).mean())


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not to be learned: the id's checksum leaves 1 on division by 3; a null id's is that of ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _first(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each group in order of ``h``; Spark cuts each task's rows before they move."""
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("_at") <= most).drop("_at")


def _samples(docs: DataFrame, labels: DataFrame, models: int, confirmed: int, unlabelled: int) -> DataFrame:
    """(model, confirmed, h, n, features): what each model is fitted on, texts as their n distinct features of four bytes each."""
    each = F.explode(F.sequence(F.lit(0), F.lit(models - 1)))
    named = _first(labels.where("toxic = 1").select("doc_id", each.alias("model")).withColumn("h", F.xxhash64("doc_id", "model")), ["model"], confirmed)
    # At most models * confirmed ids, whatever the table.
    toxic = docs.join(F.broadcast(named.select("doc_id", "model")), "doc_id").select("model", F.lit(True).alias("confirmed"), F.xxhash64("doc_id", "text", "model").alias("h"), "text")
    rows = docs.count()
    # A few more than are wanted; the first by hash stay.
    limit = int(min(1.0, 2 * (unlabelled + 50) / max(1, rows)) * (1 << 30))
    drawn = F.explode(F.filter(F.sequence(F.lit(0), F.lit(models - 1)), lambda m: F.pmod(F.xxhash64("doc_id", "text", m), F.lit(1 << 30)) < limit))
    usual = docs.select("doc_id", "text", drawn.alias("model")).select("model", F.lit(False).alias("confirmed"), F.xxhash64("doc_id", "text", "model").alias("h"), "text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in slices(batches):
            own = [features.of(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([*map(batch.column, ("model", "confirmed", "h")), pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["model", "confirmed", "h", "n", "features"])

    taken = _first(toxic, ["model"], confirmed).unionByName(_first(usual, ["model"], unlabelled))
    taken = materialise(taken.mapInArrow(made, "model int, confirmed boolean, h long, n long, features binary"), "texts")
    upto = F.sum("n").over(Window.partitionBy("model", "confirmed").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    return taken.withColumn("_upto", upto).where(F.col("_upto") <= SAMPLE_FEATURES).drop("_upto")


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, models: int = MODELS, confirmed: int = CONFIRMED, unlabelled: int = UNLABELLED) -> list[tuple[float, list[int], list[float]]]:
    """Bias, feature ids and weights of each model: at most ``models`` * FEATURES numbers.

    ``docs`` and ``labels`` hold only rows that may be learned from.  Without ``prior``, the
    share of toxic rows among all labels is taken; of labels that repeat an id, one that
    says toxic wins.  Without confirmed or unlabelled texts a model knows the prior alone.
    """
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if prior is None:
        share = labels.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
        prior = min(max(PRIOR if share is None else share, LEAST_PRIOR), MOST_PRIOR)
    samples = _samples(docs, labels, models, confirmed, unlabelled)

    def fitted(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        toxic, usual = ([np.frombuffer(x, np.uint32) for x in rows.loc[rows["confirmed"] == c].sort_values("h")["features"]] for c in (True, False))
        if not toxic or not usual:
            return pd.DataFrame({"model": key, "bias": [float(np.log(prior / (1 - prior)))], "ids": [[]], "weights": [[]]})
        m = PositiveUnlabelled(prior).fit(toxic, usual)
        return pd.DataFrame({"model": key, "bias": [m.bias], "ids": [m.ids.tolist()], "weights": [m.weights.tolist()]})

    rows = samples.groupBy("model").applyInPandas(fitted, "model int, bias double, ids array<long>, weights array<double>").collect()
    return [(r["bias"], r["ids"], r["weights"]) for r in sorted(rows, key=lambda r: r["model"])] or [(float(np.log(prior / (1 - prior))), [], [])]


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (0 to 1) and predicted (1 from ``TOXIC`` on).

    Every whole text is scored, a null or empty one as a text without words.  Labels of
    held-out rows are not read, nor any column but id and text.  Rows that repeat get the
    same score; no documents, no rows; no labels, the same score for all.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    learn = ~held_out(F.col("doc_id"))
    models = train(docs.where(learn), labels.where(learn).select("doc_id", "toxic"), **options)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    dtype = dict(docs.dtypes)["doc_id"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            scores = pa.array([scorer.score(t) for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), scores], ["doc_id", "held_out", "score"])

    rows = docs.withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(scored, f"doc_id {dtype}, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))
