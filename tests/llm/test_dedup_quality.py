"""Near-duplicates and quality rules against brute force."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from marlstone.llm import near_dup, quality


def words_of(text):
    return (text or "").encode().lower().split()


def shingles(text, n):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, similarity):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i]:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(s), least.get(find(i), d) if s else d, d == (least.get(find(i), d) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def corpus(seed, groups=12, copies=8):
    rng = random.Random(seed)
    lexicon = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(400)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "a b"), (6, "a b")]
    for _ in range(groups):
        base = [rng.choice(lexicon) for _ in range(rng.choice([12, 60, 150]))]
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8, 16])):
                copy[rng.randrange(len(copy))] = rng.choice(lexicon)
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize(("seed", "n", "turns"), [(1, 2, 3), (2, 5, 1)])
def test_components_equal_brute_force(spark, monkeypatch, seed, n, turns):
    monkeypatch.setattr(near_dup, "TURNS", turns)
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, cid int, keys int")
    got = near_dup.near_duplicates(docs, words=n).collect()
    assert sorted(map(tuple, got)) == brute(rows, n, 80)


def test_rows_without_id_and_repeated_rows(spark):
    rows = [(None, "a b c"), (5, "a b c"), (5, "a b c"), (9, "A B C")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert sorted(map(tuple, got), key=str) == [(5, 2, 5, True), (5, 2, 5, True), (9, 2, 5, False), (None, 2, None, True)]
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_few_sets_at_the_threshold_miss_each_other():
    rng = np.random.default_rng(4)
    sketcher = near_dup.Sketcher()
    missed = 0
    for _ in range(2000):
        pool = rng.integers(0, 1 << 63, 90, np.uint64) * np.uint64(2) + rng.integers(0, 2, 90).astype(np.uint64)
        a, b = sketcher.keys(pool[:81]), sketcher.keys(pool[9:])  # 72 of 90 in common
        both = a == b
        missed += not (both[: near_dup.BANDS].any() and both[near_dup.BANDS :].any())
    assert missed <= 2


def quality_by_hand(text):
    w = words_of_case(text)
    lines = [x for x in (text or "").split("\n") if any(c not in " \t\n\v\f\r" for c in x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def words_of_case(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stats_equal_brute_force():
    rng = random.Random(8)
    texts = [None, "", "\n\n", "a b c d e a b c d e", "x\nx\n x\nx", "é #1|<b>\x1c\xa0y"]
    texts += ["".join(rng.choice("ab \n\t#é") for _ in range(rng.randint(1, 400))) for _ in range(200)]
    for t in texts:
        assert quality.text_stats(t) == quality_by_hand(t), t
    many = [str(i).encode() for i in range(60_000)] + [str(i).encode() for i in range(100)]
    assert quality.repeated_words(many) == 200


def test_bad_hosts_are_rejected_as_a_whole(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, "bad", "short") for i in range(50)] + [(100, "bad", good)] + [(200 + i, f"fine{i % 4}", good) for i in range(80)] + [(400, None, good), (401, None, None), (402, "single", "short")]
    docs = spark.createDataFrame([(*r, 0, "y") for r in rows], "doc_id long, source string, text string, kept int, host string")
    out = quality.quality_verdicts(docs)
    assert {r["host"] for r in out.select("host").collect()} == {"y"}
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert not kept[100] and not kept[0] and kept[200] and kept[400] and not kept[401] and not kept[402]
    empty = quality.quality_verdicts(docs.limit(0))
    assert empty.count() == 0 and {"kept", "host_rate", "text"} <= set(empty.columns)


def test_components_of_stars_paths_and_rings(spark):
    star = [(7, i) for i in range(100, 400)]
    path = [(i, i + 1) for i in range(1_000, 1_200)]
    ring = [(i, 2_000 + (i + 1) % 50) for i in range(2_000, 2_050)]
    links = spark.createDataFrame([*star, *path, *ring, *star], "a long, b long")
    groups = {}
    for cid, comp in near_dup.components(links).collect():
        groups.setdefault(comp, set()).add(cid)
    want = [{7, *range(100, 400)}, set(range(1_000, 1_201)), set(range(2_000, 2_050))]
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want))
