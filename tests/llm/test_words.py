"""Spelling variants, source divergence and toxicity: brute force, SQL and held-out accuracy."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import divergence, spelling, sql, toxicity

SCHEMA = "doc_id long, text string, lang string, source string"


def edits_apart(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants_by_hand(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]+", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near, form = {}, {}
    for w in words:
        near[w] = [v for v in words if edits_apart(w, v)]
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 5 * words[w]:
            form[w] = best
    out = set()
    for w, c in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, c, len(near[w]), words[form[w]] if w in form else None))
    return out


def spelled(seed, words=160, texts=60):
    r = random.Random(seed)
    roots = ["".join(r.choices("abÉéàst", k=r.randint(6, 9))) for _ in range(words)]
    pool = []
    for w in roots:
        pool += [w] * r.choice([6, 40, 200])
        for _ in range(4):
            i = r.randrange(len(w))
            pool += [r.choice([w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "z" + w[i + 1 :]])] * r.choice([1, 5, 8, 30])
    r.shuffle(pool)
    step = len(pool) // texts + 1
    return [(i, r.choice([" ", ", ", "Ā", "¿"]).join(pool[i * step : (i + 1) * step]), "en", "s") for i in range(texts)]


@pytest.mark.parametrize("small_cells", [False, True])
def test_variants_against_brute_force(spark, monkeypatch, small_cells):
    if small_cells:
        # Every segment with some words is split into cells, over several shards.
        for name, value in (("OWNERS", 2), ("SCANNED", 3), ("SHARD_ROWS", 500), ("CHUNK", 4), ("HELD", 50)):
            monkeypatch.setattr(spelling, name, value)
    rows = spelled(1) + [(None, "Straße straSSE " * 9, None, None), (900, None, "en", "s"), (901, "", "en", "s"), (901, "", "en", "s"), (902, "abcdef " * 30_000, "en", "s")]
    rows += [(903, "abcdxef abcdxef abcdxef abcdxef abcdxef", "en", "s")] * 2
    # Each word leads to the next one.
    rows += [(1_000 + i, f"{w} " * n, "en", "s") for i, (w, n) in enumerate([("zzzzaaa", 6), ("zzzzaab", 31), ("zzzzabb", 170), ("zzzzbbb", 900), ("zzzzbb", 5_000)])]
    out = spelling.spelling_variants(spark.createDataFrame(rows, SCHEMA).withColumn("word", F.lit("x")).withColumn("n", F.lit(1)))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == variants_by_hand([r[:2] for r in rows])
    assert ("zzzzaaa", "zzzzaab", "zzzzbb") in {g[:3] for g in got}


def test_variants_of_nothing(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([(1, "abcdef " * 4, "", "")], SCHEMA)).collect() == []


def test_one_edit_is_the_distance():
    r = random.Random(5)
    words = ["".join(r.choices("ab", k=n)) for n in (3, 4) for _ in range(14)] + ["", "a"]
    for a in words:
        for b in words:
            if abs(len(a) - len(b)) <= 1:
                x, y = (spelling._matrix([w.encode()]) if w else np.empty((1, 0), np.uint8) for w in (a, b))
                assert bool(spelling.one_edit(x, y)[0, 0]) == edits_apart(a, b), (a, b)


def by_sql(rows):
    db = duckdb.connect()
    db.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    if rows:
        db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    return sorted(db.sql(sql.DIVERGENCE).fetchall())


def sources(seed, n=400):
    r = random.Random(seed)
    words = ["".join(r.choices("abcßÀ中", k=r.randint(1, 3))) for _ in range(80)]
    rows = []
    for i in range(n):
        s = r.randrange(7)
        text = r.choice([" ", "1", "\n-", "_"]).join(r.choices(words[s : s + 50], k=r.randrange(60)))
        rows.append((i, r.choice([text, text.upper()]), r.choice(["en", "en", "de", None]), [None, "", "a", "A", "zé", "\U0001f600", "￮"][s]))
    return rows + [(n, None, "xx", "only"), (n, "", "xx", "other"), (n, "rare words", "fr", "one"), (n, "", "en", "silent"), (n, "a " * 50_000, "en", "a")] + [rows[3]] * 5


@pytest.mark.parametrize("split", [False, True])
def test_divergence_against_sql(spark, monkeypatch, split):
    rows = sources(3)
    if split:
        for name, value in (("SOURCE_BLOCK", 2), ("TASK_POSTINGS", 50), ("HELD", 30)):
            monkeypatch.setattr(divergence, name, value)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"term": F.lit("x"), "p": F.lit(1), "n": F.lit("y")})
    out = divergence.divergence(docs, shard_terms=7 if split else 100)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = sorted(map(tuple, out.collect()))
    assert got == by_sql(rows) and {g[2] for g in got} == {"pair", "term"}
    assert ("xx", "only", "pair", "other", 0, 1) in got and not any(g[1] == "one" for g in got)


def test_divergence_of_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.createDataFrame([(1, "a", "en", "s"), (2, None, None, None), (3, "b", "en", "t")], SCHEMA)
    assert sorted(map(tuple, divergence.divergence(one).collect())) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def toxic_table(spark, n=900):
    r = random.Random(9)
    usual = ["".join(r.choices("aeiourstn", k=r.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = r.choices(usual, k=r.choice([4, 60, 400]))
        bad = r.random() < 0.25
        if bad:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["vileword", "Grumbel" + r.choice(usual)]))
        docs.append((i, " ".join(words), "en", "s"))
        if r.random() < 0.8:
            labels.append((i, int(bad)))
    return docs, labels, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels, table = toxic_table(spark)
    extra = [(None, "vileword", "en", "s"), (5_001, None, "en", "s"), (5_002, "", "en", "s"), (5_003, "grumbelaa " * 40_000, "en", "s"), docs[0], docs[0]]
    frame = spark.createDataFrame(docs + extra, SCHEMA).withColumns({"score": F.lit("x"), "toxic": F.lit(1), "model": F.lit(1), "words": F.lit("")})
    out = [r.asDict() for r in toxicity.toxicity(frame, table).collect()]
    assert len(out) == len(docs) + len(extra)
    by_id = defaultdict(list)
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 3 == 1)
        by_id[r["doc_id"]].append(r)
    asked = [(by_id[i][0]["predicted"], y) for i, y in labels if by_id[i][0]["held_out"]]
    right, said, there = sum(p and y for p, y in asked), sum(p for p, _ in asked), sum(y for _, y in asked)
    assert there > 30 and right >= 0.9 * there and right >= 0.95 * said
    assert by_id[5_001][0]["score"] == by_id[5_002][0]["score"] < 0.7 < by_id[5_003][0]["score"]
    assert len({r["score"] for r in by_id[0]}) == 1


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels, _ = toxic_table(spark, 300)
    scores = []
    for flip in (False, True):
        known = [(i, 1 - y if flip and zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
        out = toxicity.toxicity(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(known, "doc_id long, toxic int"), models=1)
        scores.append(sorted((r["doc_id"], round(r["score"], 9)) for r in out.collect()))
    assert scores[0] == scores[1]


def test_toxicity_without_examples(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s"), (2, None, "en", "s")], SCHEMA)
    for labels in ([], [(1, 0), (2, None), (None, 1)]):
        out = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert len(out) == 2 and all(r["predicted"] == 0 for r in out)
    assert toxicity.toxicity(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).collect() == []


def test_risk_of_clean_texts_stays_above_zero():
    """Without the correction, a model that can tell every text apart drives the estimate far below 0."""
    r = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    toxic = [r.sample(words, 30) + ["badword"] for _ in range(40)]
    usual = [r.sample(words, 30) + (["badword"] if r.random() < 0.2 else []) for _ in range(80)]
    features = toxicity.Features()
    m = toxicity.PositiveUnlabelled(0.2).fit(*([features.of(" ".join(t)) for t in texts] for texts in (toxic, usual)))
    score = lambda text: toxicity.Scorer([(m.bias, m.ids.tolist(), m.weights.tolist())]).score(text)
    assert score("w1 w2 badword") > 0.7 > score("w1 w2 w3")
