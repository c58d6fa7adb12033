"""Token counts, packing and training order against the library and brute force."""

import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from marlstone.llm import packing, token_counts, training_order, vocab  # noqa: E402
from marlstone.llm.common import slices  # noqa: E402

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
TEXTS = ["", "Hello wOrld's  tokens, don't!!'s", "naïve Élan 12ab", "a<|startoftext|><|endoftext|>b <|endof", "日本語 テキスト ét́e", "İstanbul ΑΣ ß ſt", "x" * 300, "=/+AbC9 \t\n\r\x0b end", None]


def library(text):
    return vocab.tokenizer(PATH).encode(text, add_special_tokens=False).ids


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, pii string, sequence_id int")


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_every_prefix_is_counted_as_the_library_does(text):
    deltas = np.frombuffer(token_counts.prefix_deltas(PATH, text), np.int8)
    assert np.cumsum(deltas, dtype=np.int64).tolist() == [len(library(text[:i])) for i in range(1, len(text) + 1)]


def test_random_chunks():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("abcdeéßñ'!?123 <|") for _ in range(rng.randint(1, 24)))
        assert np.frombuffer(vocab.text_ids(PATH, text), np.uint32).tolist() == library(text)
        assert token_counts.total(token_counts.prefix_deltas(PATH, text)) == len(library(text))


#: Controls, marks in and out of order, parts of syllables, letters that compose or grow in lower case, digits of other scripts.
WILD = [chr(c) for c in [*range(1, 0x20), 0x7F, 0x85, 0xA0, 0x2003, 0x3000]] + list("aeoAEİIΣςſKÅé'’!|<>-_.,日本語かがテキスト한국어ᄒ\u1161\u11abابيहिन्दी\u0301\u0323\u0308\u0344\u0f73١²½Ⅷ中😀\u200d\U0001f468\ufe0f\u2126") + ["'re", "'s", "'ll", "<|endoftext|>"]


def prefix_counts(text):
    return np.cumsum(np.frombuffer(token_counts.prefix_deltas(PATH, text), np.int8), dtype=np.int64).tolist()


def test_every_prefix_of_any_script():
    rng = random.Random(8)
    for k in range(1500):
        # Every character in turn, so that none is left out.
        text = "".join(rng.choice(WILD) for _ in range(rng.randint(0, 8))) + WILD[k % len(WILD)] + "".join(rng.choice(WILD) for _ in range(rng.randint(0, 8)))
        assert prefix_counts(text) == [len(library(text[:i])) for i in range(1, len(text) + 1)], ascii(text)
        assert np.frombuffer(vocab.text_ids(PATH, text), np.uint32).tolist() == library(text), ascii(text)


@pytest.mark.parametrize("letters", ["日本語", "кириллица", "abc", "e\u0301x", "ab1\x01"])
def test_long_texts_without_spaces(letters):
    text = (letters * 100_000)[:100_000]
    counts = prefix_counts(text)
    assert len(counts) == len(text)
    for i in (1, 2, 17, 1000, 99_999, 100_000):
        assert counts[i - 1] == len(library(text[:i]))


def test_a_vocabulary_without_a_fitting_token_is_an_error():
    counter = token_counts.PrefixCounter(PATH)
    del counter.numbers["q"]
    with pytest.raises(ValueError):
        counter.deltas("aqua q")


def test_memo_forgets_but_stays_right():
    memo = vocab.Memo(lambda key: "x" * len(key), 3 * vocab.ENTRY)
    for _ in range(3):
        assert [len(memo["a" * k]) for k in range(60)] == list(range(60))
    assert len(memo) <= 3 and len(memo.old) <= 3


def test_slices_hold_every_row_once():
    texts = ["a" * n for n in (0, 3, 50, 4, 4, 4, 0, 9, 10)] + [None, "é" * 5]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    parts = list(slices([batch, batch.slice(0, 0)], "text", 10))
    assert [i for p in parts for i in p.column("id").to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column("text").to_pylist()) <= 10 for p in parts)


def test_token_counts(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(1, TEXTS[1], "x", 1), (None, "word", None, None)]
    table = token_counts.count_at(token_counts.truncation(token_counts.prefix_table(docs(spark, rows), PATH), 3).withColumn("p", token_counts.F.lit(5)), "p")
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["fit_chars"], r["tokens_at"]) for r in table.collect()), key=str)
    want = []
    for i, t, *_ in rows:
        t = t or ""
        counts = [len(library(t[:k])) for k in range(len(t) + 1)]
        want.append((i, len(t.encode()), len(library(t)), max((k for k in range(1, len(t) + 1) if counts[k] <= 3), default=0), len(library(t[:5]))))
    assert got == sorted(want, key=str)
    assert token_counts.prefix_table(docs(spark, []), PATH).count() == 0
    lean = token_counts.prefix_table(docs(spark, rows), PATH, budget=3, keep_table=False)
    assert lean.columns == ["doc_id", "n_bytes", "n_tokens", "fit_chars"]
    assert sorted(map(tuple, lean.collect()), key=str) == [g[:4] for g in got]


def test_first_fit_is_first_fit():
    rng = random.Random(3)
    for _ in range(50):
        sizes = sorted((rng.randint(1, 100) for _ in range(rng.randint(1, 60))), reverse=True)
        room, want = [], []
        for s in sizes:
            k = next((k for k, r in enumerate(room) if r >= s), len(room))
            if k == len(room):
                room.append(100)
            want.append((k, 100 - room[k]))
            room[k] -= s
        assert packing.first_fit(sizes, 100) == want
    assert packing.first_fit([], 5) == []


def test_packing_holds_every_id_once(spark):
    rows = [(i, " ".join(["word"] * n), None, None) for i, n in enumerate([0, 3, 40, 100, 7, 64, 63])] + [(9, None, None, None), (1, "again", None, None), (1, "again", None, None)]
    out = packing.pack_documents(docs(spark, rows), PATH, capacity=64, group_pieces=4).toPandas()
    by_seq = out.sort_values(["sequence_id", "offset"])
    for _, g in by_seq.groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 64
    for i, text, *_ in rows[:7]:
        ids = np.array([*library(text), 2], "<u4")
        pieces = out[(out.doc_id == i) & (out.doc_tokens == len(ids))].sort_values("start")
        assert pieces["start"].tolist()[0] == 0 and pieces["length"].sum() == len(ids)
        for p in pieces.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    assert len(out[(out.doc_id == 1) & (out.doc_tokens == 2)]) == 2 and len(out[out.doc_id == 9]) == 1
    assert packing.pack_documents(docs(spark, []), PATH).count() == 0


@pytest.mark.parametrize("count", [1, 2, 3, 17, 256, 1000, 4097])
def test_feistel_permutes(count):
    order = training_order.Feistel(count, 11)
    slots = order.slots(np.arange(count))
    assert sorted(slots.tolist()) == list(range(count)) and order.indexes(slots).tolist() == list(range(count))
    assert count < 17 or (slots != training_order.Feistel(count, 12).slots(np.arange(count))).any()


def test_shards_round_trip_and_resume(spark, tmp_path):
    rows = [(i, " ".join(f"word{i} x{j}" for j in range(n)), None, None) for i, n in enumerate([0, 5, 30, 90, 2, 2])] + [(7, None, None, None), (4, "word4 x0 word4 x1", None, None)]
    out = f"file://{tmp_path}/s"
    manifest = training_order.write_shards(docs(spark, rows).repartition(3), PATH, out, 2, key=5, length=16, per_shard=8).toPandas()
    assert sorted(manifest.slot) == list(range(len(manifest))) and (manifest.slot == manifest.shard * 8 + manifest.position).all()
    back = {r["slot"]: np.frombuffer(r["ids"], "<u2") for r in training_order.read_shards(spark, out, 16, 8).collect()}
    assert sorted(back) == list(range(len(manifest)))
    order = training_order.Feistel(len(manifest), 5).slots(np.arange(len(manifest)))
    by_slot = manifest.set_index("slot")
    stream = [back[s][: by_slot.n_tokens[s]].tolist() for s in order]
    # A task's documents stand one after another: their ids, then the end token.
    texts = sorted([*library(t or ""), 2] for _, t, *_ in rows)
    ids, found = [x for part in stream for x in part], []
    while ids:
        found.append(ids[: ids.index(2) + 1])
        ids = ids[len(found[-1]) :]
    assert sorted(found) == texts
    assert (manifest.n_tokens <= 16).all() and manifest.n_tokens.sum() == sum(map(len, texts))
    first = by_slot.loc[order[0]]
    assert stream[0][0] == ([*library(dict((i, t) for i, t, *_ in rows)[first.first_doc] or ""), 2])[int(first.first_start)]
    rest = training_order.read_shards(spark, out, 16, 8, start_slot=11).collect()
    assert sorted(r["slot"] for r in rest) == list(range(11, len(manifest)))
    assert training_order.training_order(docs(spark, []), PATH, 2).count() == 0


def test_words_side_by_side_are_counted_as_one_by_one():
    rng = random.Random(4)
    words = {"".join(rng.choice(rng.choice(["abcdeinorst", "az09", "!?.'\x01\x7f-"])) for _ in range(rng.randint(1, 44))) for _ in range(400)}
    together, alone = token_counts.PrefixCounter(PATH), token_counts.PrefixCounter(PATH)
    pieces = [p for w in words for p in vocab.PIECE.findall(w)]
    together.learn(pieces)
    assert len(together.pieces) > 200
    assert all(together.pieces[p] == alone.pieces[p] for p in pieces)


def test_unspaced_scripts_take_time_in_proportion():
    """A text without spaces is one piece; four times its length takes about four times as long."""
    random_ = random.Random(4)
    letters = [chr(c) for c in [*range(0x3041, 0x3090), *range(0x4E00, 0x5200)]]
    library, took = vocab.tokenizer(PATH), {}
    for n in (100_000, 400_000):
        text = "".join(random_.choices(letters, k=n))
        start = time.process_time()
        deltas = token_counts.prefix_deltas(PATH, text)
        took[n] = time.process_time() - start
        assert token_counts.total(deltas) == len(library.encode(text, add_special_tokens=False).ids) and len(deltas) == n
    assert took[400_000] < 5 * took[100_000] + 0.5


def test_random_text_of_all_scripts_against_the_library():
    random_ = random.Random(8)
    pool = ["'s", "'ll", "'", "<|endoftext|>", "<|", "́", "̂", "é", "日", "한", "ᅡ", "ᆨ", "ก", "ि", "ß", "İ", "🙂", "Ω", "ж", "1", "٣", "\t", "\x01", " ", "ab", "Z", "!", "。"]
    library = vocab.tokenizer(PATH)
    for _ in range(400):
        text = "".join(random_.choices(pool, k=random_.randrange(1, 14)))
        deltas = token_counts.prefix_deltas(PATH, text)
        at = random_.randrange(len(text) + 1)
        for end in (at, len(text)):
            assert token_counts.total(deltas[:end]) == len(library.encode(text[:end], add_special_tokens=False).ids), text[:end]


def test_sequences_are_dealt_to_shards_without_a_sample_and_compressed(spark, tmp_path):
    rows = [(i, "one and the same text again " * 40, None, None) for i in range(300)]
    plans, moved = [], training_order.materialise

    def seen(df, tag, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return moved(df, tag, *rest)

    training_order.materialise = seen
    try:
        manifest = training_order.write_shards(docs(spark, rows), PATH, f"file://{tmp_path}/s", 2, key=5, length=16, per_shard=64)
    finally:
        training_order.materialise = moved
    assert "rangepartitioning" not in plans[-1] and "blob" in plans[-1]
    got = manifest.toPandas().sort_values("slot")
    assert got["slot"].tolist() == list(range(len(got))) and (got["slot"] // 64 == got["shard"]).all() and (got["slot"] % 64 == got["position"]).all()
    assert len(got) > 640 and manifest.count() == training_order.read_shards(spark, f"file://{tmp_path}/s", 16, 64).count()


def test_words_before_marks_are_tokenised_once():
    memo = vocab.id_memo.__wrapped__(PATH)
    text = "unseenish unseenish, unseenish. (unseenish) unseenish's $$$unseenish $$$$ ab, ab."
    assert np.frombuffer(b"".join(map(memo.__getitem__, vocab.chunks(text))), "<u4").tolist() == library(text)
    alone = vocab.id_memo.__wrapped__(PATH)
    assert alone["otherish,"] and "otherish" in alone
