"""Queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import sql

#: A key for tests and checks; a production run passes its own secret.
PII_KEY = "marlstone"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.secrets import secret_report

    return secret_report(_table(spark, sf_dir, "documents"))


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.warc import archive_round_trip

    return archive_round_trip(_table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.token_counts import prefix_table

    counts = prefix_table(_table(spark, sf_dir, "documents"), vocabulary(), budget=2048, keep_table=False)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"), "fit_chars")


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.training_order import training_order

    return training_order(_table(spark, sf_dir, "documents"), vocabulary(), end_id=2, key=20_240)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), vocabulary())


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.common import materialise
    from marlstone.llm.mixing import mix
    from marlstone.llm.vocab import with_token_counts

    docs = with_token_counts(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), vocabulary(), "n_tokens")
    out = mix(materialise(docs.drop("text"), "tokens"), tokens=F.col("n_tokens"))
    return out.select("doc_id", "source", "mix_tokens", "mix_epoch", "mix_order", "mix_weight")


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.pii import KINDS, with_surrogates

    out = with_surrogates(_table(spark, sf_dir, "documents"), PII_KEY)
    return out.select("doc_id", "text", *[F.coalesce(F.col("pii")[k], F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.quality import STATS, quality_verdicts

    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality_verdicts(docs, keep_text=False).select("doc_id", *STATS, "base_failed", "kept")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.neighbours import nearest

    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.near_dup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), words=2, similarity=80)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.divergence import divergence

    return divergence(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.spelling import spelling_variants

    return spelling_variants(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op6_source_mix": op6_source_mix,
        "op7_pii_surrogates": op7_pii_surrogates,
        "op8_quality_rules": op8_quality_rules,
        "op9_nearest_neighbours": op9_nearest_neighbours,
        "op10_near_duplicates": op10_near_duplicates,
        "op1_secret_scan": op1_secret_scan,
        "op2_warc_archive": op2_warc_archive,
        "op3_token_counts": op3_token_counts,
        "op4_training_order": op4_training_order,
        "op5_packing": op5_packing,
        "op11_toxicity": op11_toxicity,
        "op12_source_divergence": op12_source_divergence,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op8_quality_rules": sql.QUALITY,
        "op10_near_duplicates": sql.NEAR_DUP,
        "op12_source_divergence": sql.DIVERGENCE,
    }
