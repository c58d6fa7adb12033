"""From raw documents to packed training sequences, stage by stage.

Each stage takes the documents that the one before it kept and returns documents, but for
the last, which returns where each piece of a document lies in a training sequence.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import discard, free_names, materialise, small
from marlstone.llm.mixing import mix
from marlstone.llm.near_dup import near_duplicates
from marlstone.llm.packing import pack_documents
from marlstone.llm.pii import with_surrogates
from marlstone.llm.quality import passing
from marlstone.llm.registry import PII_KEY, vocabulary
from marlstone.llm.vocab import with_token_counts

#: Near-duplicates share words in shingles of five.
SHINGLE_WORDS, SIMILARITY = 5, 80
#: Bitmaps (of 4 KB, for 32,768 row numbers of a task) up to which those of the rows to keep are sent to every executor.
BITMAPS = 8192


#: The columns that stages read or change.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _carrying(stage):
    """``stage`` with all columns of a table but ``OWN`` under names that no operator gives or takes, and under their own again behind it."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        away = {c: f"_carried_{i}" for i, c in enumerate(docs.columns) if c not in OWN}
        return stage(spark, docs.withColumnsRenamed(away), sf_dir).withColumnsRenamed({v: k for k, v in away.items()}).select(*docs.columns)

    return run


@_carrying
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host is not rejected."""
    return passing(docs)


@_carrying
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of near-duplicates, by doc_id; of rows that repeat, one.

    Verdicts are by row, as an id may be null or stand for several texts.  Rows without
    words are alike only if their ids and texts are.
    """
    row, bucket, bits = free_names(docs, "_row", "_bucket", "_bits")
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered", "zstd")
    verdicts = near_duplicates(numbered, id_col=row, words=SHINGLE_WORDS, similarity=SIMILARITY).withColumnRenamed("doc_id", row)
    blank = F.col("n_shingles") == 0
    alike = [F.when(~blank, F.col("component_id")).alias("g0"), F.when(blank, F.col("doc_id")).alias("g1"), F.when(blank, F.col("digest")).alias("g2")]
    own = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", row)
    ids = numbered.select(row, "doc_id", F.sha2("text", 256).alias("digest"))
    first = verdicts.join(ids.hint("merge"), row).groupBy(*alike).agg(F.min(own)[row].alias(row))
    # A bit a row, so that texts need no shuffle to be chosen from.
    number, place = F.bitmap_bucket_number(F.col(row) + 1).alias(bucket), F.bitmap_bit_position(F.col(row) + 1)
    kept = materialise(first.groupBy(number).agg(F.bitmap_construct_agg(place).alias(bits)), "kept")
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.pow(F.lit(2), place % 8).cast("int")
    chosen = numbered.withColumn(bucket, number).join(small(kept, limit=BITMAPS), bucket)
    return chosen.where(byte.bitwiseAND(bit) > 0).select(*docs.columns)


@_carrying
def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data, and their new lengths."""
    out = with_surrogates(docs, PII_KEY).withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns)


@_carrying
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; smaller sources again, up to twice, for a flatter mix.

    ``mix`` writes the counts without the texts; in the result nothing asks for them, so
    they are not worked out again.
    """
    (tokens,) = free_names(docs, "_tokens")
    return mix(with_token_counts(docs, vocabulary(), tokens), tokens=F.col(tokens)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 4,096 tokens."""
    return pack_documents(docs, vocabulary())


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_dedup),
    ("personal data", pii),
    ("source mix", mixture),
    ("packing", packing),
]

#: SQL can express neither the tokenizer nor first-fit packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        made = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
