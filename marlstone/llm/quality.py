"""Quality rules per document, and verdicts on the hosts that documents come from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import discard, free_names, materialise, slices, small

#: White space between words, and the symbols that are counted.
SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
#: Words of a window that may repeat, fewest words of a document, most repeated words in 100.
WINDOW, MIN_WORDS, MAX_REPEATED = 5, 10, 20
#: A host whose shrunk share of failing documents is above this is rejected as a whole.
MAX_HOST_RATE = 0.5

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more, the first one included.

    Windows are compared by exact numbers: two numbers of n values each are joined to
    one below n * n and, where more words could overflow, numbered anew.
    """
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, n)
    base = len(number)
    if base == n:
        return 0
    key, top = ids[: n - window + 1], base
    for k in range(1, window):
        if top > (1 << 62) // base:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            top = n
        key = key * base + ids[k : n - window + 1 + k]
        top *= base
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    steps = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(again)
    steps[starts] += 1
    steps[starts + window] -= 1
    return int((np.cumsum(steps[:n]) > 0).sum())


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode()
    words = data.split()
    seen: set[bytes] = set()
    repeated = 0
    for line in data.split(b"\n"):
        if line in seen:
            repeated += 1
        elif line.strip(SPACE):
            seen.add(line)
    return (
        len(words),
        len(text) - (len(data) - len(data.translate(None, SPACE))),
        len(data) - len(data.translate(None, SYMBOLS)),
        repeated,
        repeated_words(words),
    )


def with_stats(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with the columns of ``STATS`` and ``base_failed``; columns of these names are replaced."""
    kept = docs.drop(*STATS, "base_failed")
    names = [c for c in kept.columns if keep_text or c != text_col]
    schema = ", ".join([f"`{c}` {t}" for c, t in kept.select(*names).dtypes] + [f"{c} long" for c in STATS])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            stats = [text_stats(t) for t in batch.column(text_col).to_pylist()]
            columns = [pa.array([s[k] for s in stats], pa.int64()) for k in range(len(STATS))]
            yield pa.record_batch([*map(batch.column, names), *columns], [*names, *STATS])

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return kept.mapInArrow(measured, schema).withColumn("base_failed", failed)


def host_rates(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """Per host: documents, failures and the share of failures shrunk to the corpus.

    The prior is a beta distribution with the mean and variance that the hosts' shares
    show beyond chance (method of moments), its weight held between 1 and 10,000
    documents.  Documents without a host are one host.  ``docs`` needs ``base_failed``.
    """
    hosts = docs.groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    n, f = F.col("host_docs"), F.col("host_failed")
    # Three sums, whatever the number of hosts.
    total = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(f * f / n).alias("ff")).first()
    if not total["n"]:
        alpha, beta = 1.0, 1.0
    else:
        k, docs_n, failed_n = total["k"], total["n"], total["f"]
        mean = min(max(failed_n / docs_n, 1e-6), 1 - 1e-6)
        between = total["ff"] / docs_n - (failed_n / docs_n) ** 2
        chance = mean * (1 - mean) * k / docs_n
        spread = max(between - chance, 0.0)
        weight = min(max(mean * (1 - mean) / spread - 1 if spread else 1e4, 1.0), 1e4)
        alpha, beta = mean * weight, (1 - mean) * weight
    return hosts.withColumn("host_rate", (f + F.lit(alpha)) / (n + F.lit(alpha + beta)))


def quality_verdicts(docs: DataFrame, host_col: str = "source", text_col: str = "text", max_host_rate: float = MAX_HOST_RATE, keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` (the text unless ``keep_text`` is false), ``STATS``, ``base_failed``, ``host_rate`` and ``kept``.

    A document is kept if it passes the base rules and its host is not rejected.  A null
    or empty text has no words and fails.  Rows that repeat are judged one by one.  The
    measured rows are written once: hosts are counted from, and joined back to, that table.
    """
    measured = materialise(with_stats(docs.drop("host_rate", "kept"), text_col, keep_text), "quality")
    rated, rate = free_names(measured, "_rated_host", "_rate_of_host")
    rates = materialise(host_rates(measured, host_col).select(F.col("host").alias(rated), F.col("host_rate").alias(rate)), "hosts")
    joined = measured.join(small(rates), measured[host_col].eqNullSafe(rates[rated]), "left").drop(rated).withColumnRenamed(rate, "host_rate")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_host_rate))


def passing(docs: DataFrame, host_col: str = "source", text_col: str = "text", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that ``quality_verdicts`` keeps, with their own columns.

    Texts are measured once for the hosts and once for the rows, so that none is written
    in between; ``docs`` may have none of the columns of ``STATS`` or ``base_failed``.
    """
    flags = materialise(with_stats(docs.select(host_col, text_col), text_col, keep_text=False).select(host_col, "base_failed"), "flags")
    (host,) = free_names(docs, "_rejected_host")
    rejected = materialise(host_rates(flags, host_col).where(F.col("host_rate") > max_host_rate).select(F.col("host").alias(host)), "rejected")
    discard(flags)
    left = docs.join(small(rejected), docs[host_col].eqNullSafe(rejected[host]), "left_anti")
    return with_stats(left, text_col).where(~F.col("base_failed")).select(*docs.columns)
