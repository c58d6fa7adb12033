"""The stages of the corpus pipeline on small cases."""

from pathlib import Path

import pyarrow.parquet as pq

import corpus_pipeline
from marlstone.llm.common import shared_dir
from marlstone.llm.quality import passing, quality_verdicts
from marlstone.llm.registry import op6_source_mix, vocabulary
from marlstone.llm.vocab import text_ids

LONG = " ".join(f"word{i}" for i in range(60))
NEAR = LONG.replace("word59", "end")


def test_near_dedup_keeps_one_row_of_each_group(spark):
    other = " ".join(f"other{i}" for i in range(60))
    rows = [(5, LONG), (5, LONG), (None, LONG), (7, NEAR), (7, other), (None, "x y z"), (None, "x y z"), (9, ""), (9, ""), (10, ""), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    want = [(5, LONG), (7, other), (None, "x y z"), (9, ""), (10, ""), (None, None)]
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_mixing_counts_the_tokens_that_packing_packs(spark, tmp_path):
    rows = [(i, "words", "a few words here") for i in range(20)] + [(100 + i, "unspaced", "中文" * 40 + str(i)) for i in range(20)] + [(200, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    count = {i: len(text_ids(vocabulary(), t or "")) // 4 for i, _, t in rows}
    got = op6_source_mix(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["mix_tokens"] for r in got} == count
    # The unspaced source is the largest and is used once; the other one is repeated.
    uses = lambda rs, s: sum(r["source"] == s for r in rs)
    assert uses(got, "unspaced") == 20 and uses(got, "words") > 20
    staged = corpus_pipeline.mixture(spark, docs, "").collect()
    assert uses(staged, "unspaced") == 20 and uses(staged, "words") == uses(got, "words")


def rows_of_documents():
    """Clean documents, copies, near copies, junk, personal data, nulls, a repeated row and a very long text."""
    words = lambda seed, n=80: " ".join(f"w{seed}x{i}" for i in range(n))
    rows = [(i, words(i), "en", f"site{i % 3}") for i in range(12)]
    rows += [(20, words(1), "en", "site1"), (21, words(2).replace("w2x79", "other"), "en", "site2"), (22, "too short", "en", "site0"), (23, None, "en", "site0"), (24, "", None, None)]
    rows += [(25, words(25) + " mail ann.lee@example.com or Mr. John Smith", "en", None), (26, words(26, 9000), "en", "site1"), (3, words(3), "en", "site0")]
    return [(*r, len(r[1] or "")) for r in rows]


def test_run_holds_what_each_stage_keeps(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows_of_documents(), schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for stage in list(stages.values())[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
    # By hand: junk and nulls go, of copies and near copies the smallest id stays.
    kept = [*range(12), 25, 26]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == set(kept)
    texts = {r[0]: r[1] for r in rows_of_documents() if r[0] in kept}
    held, by_seq = {}, {}
    for r in out:
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + r["length"]
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i in kept:
        if i != 25:  # its surrogates have other tokens
            tokens = len(text_ids(vocabulary(), texts[i])) // 4 + 1
            assert held[i] in (tokens, 2 * tokens), i
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    new = {r["doc_id"]: r["text"] for r in corpus_pipeline.pii(spark, docs, "").collect()}
    assert "ann.lee" not in new[25] and "Smith" not in new[25] and all(new[i] == texts[i] for i in kept if i != 25)


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def written_columns(folder, before):
    """Columns of the tables that appeared in the shared folder since ``before``."""
    return {t.name.rsplit("-", 1)[0]: set(pq.read_schema(next(t.rglob("*.parquet"))).names) for t in set(folder.iterdir()) - before}


def test_stages_write_texts_once_at_most(spark, tmp_path):
    docs = spark.createDataFrame(rows_of_documents(), "doc_id long, text string, lang string, source string, n_chars long")
    folder = Path(shared_dir(spark).removeprefix("file://")) / "marlstone"
    folder.mkdir(exist_ok=True)
    for stage, most in ((corpus_pipeline.quality, 0), (corpus_pipeline.near_dedup, 1), (corpus_pipeline.pii, 0), (corpus_pipeline.mixture, 0)):
        before = set(folder.iterdir())
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{stage.__name__}")
        found = written_columns(folder, before)
        assert sum("text" in c for c in found.values()) == most, found
        # Band keys and links are removed once they are done with.
        assert stage is not corpus_pipeline.near_dedup or set(found) == {"numbered", "digests", "named", "kept"}, found


def test_texts_are_not_shuffled_to_choose_them(spark, monkeypatch):
    small = corpus_pipeline.small
    monkeypatch.setattr(corpus_pipeline, "small", lambda df, rows=None, limit=2: small(df, rows, limit))
    docs = spark.createDataFrame(rows_of_documents(), "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    out = corpus_pipeline.near_dedup(spark, docs, "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert sorted(r["doc_id"] for r in out.collect()) == [*range(12), 22, 23, 24, 25, 26]
    counted = corpus_pipeline.mixture(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in counted


def test_quality_keeps_what_the_verdicts_keep(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30)) if i % 3 else "bad", None if i % 5 == 0 else f"h{i % 5 if i % 3 else 9}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = quality_verdicts(docs).where("kept").select(*docs.columns)
    got = passing(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert 0 < want.count() < len(rows)
