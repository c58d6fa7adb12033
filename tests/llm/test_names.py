"""No operator or stage takes a column of the table for one of its own."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import common, divergence, mixing, near_dup, packing, pii, quality, registry, secrets, spelling, token_counts, toxicity, training_order

OWN = ["_found", "_new", "_names", "_host_rate", "_rated_host", "_rate_of_host", "_row", "_tokens", "_mix_src", "_mix_passes", "_mix_end", "host", "host_rate", "kept", "weight", "src", "id", "s", "n", "key", "keys", "digest", "shingles", "part", "place", "term", "word", "words", "shard", "segment", "model", "h", "features", "p", "p0", "q", "v", "a", "b", "lang2", "held_out", "score", "label", "rank", "value", "total", "spans", "codes", "row", "task", "slot", "slots", "tokens", "length", "start", "offset", "sequence_id", "mix_tokens", "mix_epoch", "mix_order", "mix_weight", "pii", "n_tokens", "n_bytes", "fit_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    text = "Mrs. Anna Smith wrote these twelve words for the table of a test of names, mail a.b@example.org and 123-45-6789, so be it."
    rows = [(i, text + f" number {i // 2} " + "and so on it goes for a while " * (i % 3), "en", f"s{i % 2}", 9) for i in range(8)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return table, table.withColumns({c: F.lit(f"own {c}") for c in OWN})


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "A long, b_ long")
    assert common.free_names(df, "a", "b", "b", "c") == ["a_", "b", "b__", "c"]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, stage):
    plain, crowded = docs
    run = dict(corpus_pipeline.STAGES)[stage]
    want, got = run(spark, plain, ""), run(spark, crowded, "")
    base = want.columns
    if stage != "packing":
        assert set(got.columns) == set(crowded.columns)
        for c in set(crowded.columns) - set(plain.columns):
            assert {r[0] for r in got.select(c).distinct().collect()} == {f"own {c}"}, c
    rows = lambda df: sorted(map(str, df.select(*base).collect()))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["secrets", "tokens", "order", "packing", "mix", "surrogates", "quality", "near", "toxic", "divergence", "spelling"])
def test_operators(spark, docs, name):
    vocabulary = registry.vocabulary()
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    run = {
        "secrets": secrets.secret_report,
        "tokens": lambda d: token_counts.prefix_table(d, vocabulary, budget=20, keep_table=False),
        "order": lambda d: training_order.training_order(d, vocabulary, end_id=2, key=1, length=16, per_shard=4),
        "packing": lambda d: packing.pack_documents(d, vocabulary),
        "mix": lambda d: mixing.mix(d).select("doc_id", "mix_tokens", "mix_epoch", "mix_order", "mix_weight"),
        "surrogates": lambda d: pii.with_surrogates(d, "k").select("doc_id", "text", F.to_json("pii").alias("pii")),
        "quality": lambda d: quality.quality_verdicts(d).select("doc_id", *quality.STATS, "base_failed", "host_rate", "kept"),
        "near": lambda d: near_dup.near_duplicates(d, words=2),
        "toxic": lambda d: toxicity.toxicity(d, labels, models=1),
        "divergence": lambda d: divergence.divergence(d, least_docs=2),
        "spelling": lambda d: spelling.spelling_variants(d),
    }[name]
    rows = lambda df: sorted(map(str, df.collect()))
    plain, crowded = docs
    assert rows(run(crowded)) == rows(run(plain))
