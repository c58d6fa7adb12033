"""Secrets, personal data, archives, neighbours and mixing against brute force."""

import base64
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import mixing, neighbours, pii, secrets, warc

ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def blank(m):
    return " " * len(m[0])


def entropy_hits(text):
    out = []
    rest = ASSIGN.sub(lambda m: blank(m) if len(m[2]) >= 6 else m[0], text)
    for pattern in (r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}", *secrets.CUT):
        rest = re.sub(pattern, blank, rest)
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", rest):
        v = m[0]
        if any(re.search(p, v) for p in secrets.ALLOWED) or not re.search("[0-9]", v) or not re.search("[A-Za-z]", v):
            continue
        is_hex = re.fullmatch("[0-9a-f]+", v.lower())
        v, alphabet, bits = (v.lower(), secrets.HEX_ALPHABET, secrets.HEX_BITS) if is_hex else (v, secrets.BASE_ALPHABET, secrets.BASE_BITS)
        best = 0.0
        for i in range(len(v) - secrets.WINDOW + 1):
            codes = [c if c in alphabet else "?" for c in v[i : i + secrets.WINDOW]]
            best = max(best, -sum(codes.count(c) / len(codes) * math.log2(codes.count(c) / len(codes)) for c in set(codes)))
        if best >= bits - 1e-9:
            out.append((m.start(), 3, m.end()))
    return out


def test_secrets_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", "token:token:abcdef", "API_KEY = 'abc' secret=\"x.y-z/1\" ſecret=abcdefg", "é AKIA" + "A1" * 10 + " AKIAB", "0" * 23 + " " + "0123456789abcdef" * 3, "Zx9Q" * 3 + "aB3dE5gH7jK9mN1p", "123e4567-e89b-12d3-a456-426614174000", "q" * 5000 + "1"]
    bits = ["token", "=", ":", " ", '"', "password", "a1b2c3", "AKIA", "ABCDEF123456", "deadbeef", "0123", "Zq8", "é", "\n", "/", "-"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, found string")
    got = {r["doc_id"]: r for r in secrets.secret_report(docs).collect()}
    for i, t in enumerate(texts):
        base = base_spans(t or "")
        name = lambda spans: ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(name(base).encode()).hexdigest(), t
        assert got[i]["spans"] == name(sorted(base + entropy_hits(t or ""))), t
        assert [got[i][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(k == n for _, k, _ in base) for n in range(3)]
    assert secrets.secret_report(docs.limit(0)).count() == 0


def test_a_secret_beside_known_spans_and_examples_is_found(spark):
    key = "q7Rz0Kp3XvB9mT5wYc2Ld8Fh4Ns6Gj1UaEoiXwQy"
    before = ["AKIA" + "A1B2" * 4 + "/", "0123456789abcdef01234567_", "sample-app/", "user12345_", "x/00000/", "2024-01-02-", "123e4567-e89b-12d3-a456-426614174000/"]
    texts = [b + key for b in before] + ["example" * 5, "123e4567-e89b-12d3-a456-426614174000"]
    got = {r["doc_id"]: r for r in secrets.secret_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, b in enumerate(before):
        spans = [x.split(":") for x in got[i]["spans"].split(",")]
        start, end = next((int(s), int(e)) for k, s, e in spans if k == "entropy")
        assert start <= len(b) and end == len(texts[i]), texts[i]
    assert got[len(before)]["n_entropy"] == got[len(before) + 1]["n_entropy"] == 0


def test_many_matches_in_one_text(spark):
    text = " ".join(f"{i:024x}" for i in range(3000))
    row = secrets.secret_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_hex"] == 3000 and row["spans"].split(",")[-1] == f"hex:{25 * 2999}:{25 * 2999 + 24}"


def test_mix_takes_columns_of_any_name(spark):
    rows = [(i, "ab"[i % 3 == 0], "one two", 1, 2, 3, 4, 5, 6) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, weight int, src int, passes int, end int, tokens int, mix_order int")
    out = mixing.mix(docs)
    assert out.columns == ["doc_id", "source", "text", "weight", "src", "passes", "end", "tokens", "mix_tokens", "mix_epoch", "mix_order", "mix_weight"]
    assert out.select("doc_id").distinct().count() == 30 and {tuple(r) for r in out.select("weight", "src", "passes", "end", "tokens").collect()} == {(1, 2, 3, 4, 5)}


def test_of_rows_that_repeat_an_id_the_same_vector_counts(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [0.0, 1.0]), (2, [0.6, 0.8])]
    got = [sorted(map(tuple, neighbours.nearest(spark.createDataFrame(r, "vec_id long, embedding array<float>").repartition(3), spark.createDataFrame([(0,)], "vec_id long"), k=2).collect())) for r in (rows, rows[::-1])]
    assert got[0] == got[1] and len(got[0]) == 2


def test_surrogates_keep_format_and_coreference(spark):
    text = "mail Bob.Smith62@mail5.example.com, bob.smith62@mail5.example.com, +1 (333) 555-8558, 38.168.39.50, 4111 1111 1111 1111, 123-45-6789. Mrs. Anna Smith, Herr Müller."
    rows = [(0, text), (1, text + " 4111-1111-1111-1111 and 333-555-8558x"), (2, None), (3, ""), (4, "Nothing here: 12, 2013-2014, v1.2.3, a@b"), (5, "w " * 50_000 + "x@y.org")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, pii int")
    out = {r["doc_id"]: r for r in pii.with_surrogates(docs, "key").collect()}
    new = out[0]["text"]
    for secret in ("62@mail5", "555-8558", "38.168.39.50", "4111 1111 1111 1111", "123-45-6789", "Smith", "Müller", "Anna"):
        assert secret not in new
    shape = lambda t: re.sub(r"[0-9]", "9", re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", t)))
    assert shape(new.split("Mrs.")[0]) == shape(text.split("Mrs.")[0])
    a, b = re.findall(r"\S+@\S+?(?=,)", new)
    assert a.lower() == b.lower()
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", new)[0].replace(" ", "")
    luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(card)))
    assert luhn % 10 == 0 and card[0] == "4" and card in out[1]["text"].replace("-", "").replace(" ", "")
    assert re.search(r"Mrs\. (\w+) ", new)[1] in pii.NAMES["female_latin"]
    assert out[2]["text"] is None and out[3]["text"] == "" and out[4]["text"] == rows[4][1] and out[4]["pii"] == {}
    assert out[0]["pii"] == {"email": 2, "phone": 1, "ip": 1, "card": 1, "ssn": 1, "name": 2}
    assert out[5]["pii"] == {"email": 1} and len(out[5]["text"]) == len(rows[5][1])
    assert pii.with_surrogates(docs.limit(0), "key").count() == 0


def test_every_name_of_a_shape_gets_a_name_of_its_own(spark):
    letters = [F.explode(F.array(*map(F.lit, x))).alias(n) for n, x in (("a", "MJPQZB"), ("b", "aeiou"), ("c", "bcdlrst"), ("d", "aeiou"), ("e", "aeinrs"))]
    names = spark.range(1)
    for c in letters:
        names = names.select("*", c)
    names = names.select(F.concat("a", "b", "c", "d", "e").alias("n")).union(spark.createDataFrame([(n,) for k in ("male_latin", "female_latin") for n in pii.NAMES[k]], "n string")).distinct()
    for title in ("Mr.", "Mrs."):
        made = names.select("n", pii.surrogate(F.concat(F.lit(f"{title} "), "n", F.lit(" Lee")), F.lit("name"), "marlstone").alias("s"))
        got = made.agg(F.count(F.lit(1)), F.count_distinct("s"), F.count_if(F.col("s").contains(F.concat(F.lit(" "), "n", F.lit(" "))))).first()
        assert got[0] == got[1] and got[2] == 0


@pytest.mark.parametrize("kind, values", [("ssn", [f"123-{a:02d}-4567" for a in range(100)]), ("ip", [f"9.{a}.{b}.1" for a in range(10) for b in range(12)]), ("email", [f"{a}{b}@例子.com" for a in "甲乙丙丁ab1" for b in "łåñक한あ"])])
def test_no_value_is_its_own_surrogate_or_another_s(spark, kind, values):
    made = spark.createDataFrame([(v,) for v in values], "v string").select("v", pii.surrogate(F.col("v"), F.lit(kind), "k").alias("s")).collect()
    assert all(r["s"] != r["v"] for r in made) and len({r["s"] for r in made}) == len(values)


def test_longer_names_and_very_long_entities(spark):
    said = ["Mr. John Paul Smith", "Dr. John McDonald", "Mr. McDonald", "Prof. O'Neil", "Mr. J. Smith", "Mr. Smith"]
    docs = spark.createDataFrame([(i, f"so {t}, he said. The end") for i, t in enumerate(said)] + [(9, "x" * 3000 + "@example.com")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.with_surrogates(docs, "key").collect()}
    family = {}
    for i, t in enumerate(said):
        assert out[i]["pii"] == {"name": 1} and out[i]["text"].startswith(f"so {t.split(' ')[0]} ") and out[i]["text"].endswith(", he said. The end")
        new = out[i]["text"][3:].split(",")[0]
        assert not set(new.split(" ")[1:]) & set(t.split(" ")[1:])
        family.setdefault(t.split(" ")[-1], set()).add(new.split(" ")[-1])
    assert all(len(f) == 1 for f in family.values()) and len(set().union(*family.values())) == 3
    assert out[9]["pii"] == {"email": 1} and len(out[9]["text"]) == 3012 and out[9]["text"].endswith(".com")


def test_one_person_has_one_surrogate(spark):
    said = [
        "Mrs. Anna Schmidt met Dr. Anna Schmidt. Anna Schmidt left, and Schmidt's Anna; not Annabel or Goldschmidt.",
        "Mr. John Paul George Richard Starkey played. Starkey sang.",
        "IBAN DE89 3704 0044 0532 0130 00 or DE89370400440532013000; GB82 WEST 1234 5698 7654 32 and DE00370400440532013000.",
        "Mr. 王 小明 came. 小明 left.",
        "Mr. James Hall and Mr. Hall James. James. Hall.",
        "Miss Susan O'Neil said O'Neil. A. O'Neil, Mr. B. Neil.",
    ]
    out = {r["doc_id"]: r["text"] for r in pii.with_surrogates(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string"), "key").collect()}
    given, family = re.match(r"Mrs\. (\w+) (\w+) met", out[0]).groups()
    assert out[0] == f"Mrs. {given} {family} met Dr. {given} {family}. {given} {family} left, and {family}'s {given}; not Annabel or Goldschmidt."
    assert given in pii.NAMES["female_latin"] and given != "Anna"
    words = out[1].split()
    assert not set(words) & {"John", "Paul", "George", "Richard", "Starkey"} and words[5] == words[7] and words[8] == "sang."
    ibans = re.findall(r"DE\w\w[ \d]+\d|GB\w\w [A-Z]{4} [ \d]+\d", out[2])
    plain = [i.replace(" ", "") for i in ibans]
    right = lambda i: int("".join(str(int(c, 36)) for c in i[4:] + i[:4])) % 97 == 1
    assert len(plain) == 4 and plain[0] == plain[1] and [right(i) for i in plain] == [True, True, True, False]
    assert not any(x in out[2] for x in ("3704", "0532", "WEST", "5698"))
    assert re.fullmatch(r"Mr\. (\w) (\w\w) came\. \2 left\.", out[3]) and "小明" not in out[3]
    assert not set(re.findall(r"\w+", out[4])) & {"James", "Hall"} and not re.search("Neil", out[5])


def test_surrogates_are_distinct(spark):
    text = F.concat_ws(" ", F.format_string("10.%d.%d.7", F.col("id") % 256, F.floor(F.col("id") / 256)), F.format_string("+1 (212) 555-%04d", F.col("id")), F.format_string("u%d@m.example.com", F.col("id")), F.format_string("Mr. %s Doe", F.element_at(F.array(*map(F.lit, pii.NAMES["male_latin"])), (F.col("id") % 13 + 1).cast("int"))))
    docs = spark.range(600).select(text.alias("text"))
    assert docs.select(F.explode(pii.entities(F.col("text"))).alias("e")).select("e").distinct().count() == 600 * 3 + 13
    assert pii.collisions(docs, "key").count() == 0


def test_archive_round_trip(spark, tmp_path):
    rows = [(1, "u1", "<p>é</p>"), (2, "u2", "<p>é</p>"), (3, None, None), (4, "u4", ""), (5, "u5", "other"), (5, "u5", "other"), (7, "a\r\nb", "x" * 100_000), (None, "n", "other")]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    path = f"file://{tmp_path}/archive"
    warc.write_archive(pages, path)
    got = sorted(map(tuple, warc.archive_report(spark, path).collect()), key=str)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        owner = max(j for j, _, h in rows if j is not None and (h or "") == (html or ""))
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == owner else "revisit", None if i == owner else owner))
    fixed = [w if w[0] is not None else (None, w[1], w[2], *next((g[3], g[4]) for g in got if g[0] is None)) for w in want]
    assert got == sorted(fixed, key=str)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    records = {(r["page_id"], r["record_type"]): r for r in warc.read_records(spark, path).collect()}
    first = bytes(records[2, "response"]["record"])
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and first.endswith("\r\n\r\n<p>é</p>\r\n\r\n".encode())
    assert bytes(records[1, "revisit"]["payload"]).decode() == "<p>é</p>" and b"Content-Length: 0" in bytes(records[1, "revisit"]["record"])
    small = warc.archive_round_trip(pages, min_payload=6)
    assert {r["record_type"] for r in small.where("payload_bytes < 6").collect()} == {"response"}
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_damaged_payloads_are_noticed(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    warc.write_archive(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), path)
    damaged = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"texx")).collect()
    spark.createDataFrame(damaged, spark.read.parquet(f"{path}/payloads").schema).write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.archive_report(spark, path).collect()


def nearest_by_hand(rows, queries, k):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = []
    for q in queries:
        if q in ok:
            s = sorted((-round(float(ok[q] @ v / math.sqrt((ok[q] @ ok[q]) * (v @ v))), 12), i) for i, v in ok.items() if i != q)[:k]
            out += [(q, r + 1, i, -c) for r, (c, i) in enumerate(s)]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]
    rows += [(400, None), (401, [0.0] * 8), (402, [float("nan")] + [1.0] * 7), (403, [None] + [1.0] * 7), (404, [1.0, 2.0]), (405, []), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = df.where("vec_id % 10 = 0 OR vec_id > 399")
    got = {(r["query_id"], r["vec_id"]): (r["rank"], r["score"]) for r in neighbours.nearest(df, asked).collect()}
    floats = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = nearest_by_hand(floats, [i for i, _ in rows if i is not None and (i % 10 == 0 or i > 399)], 5)
    hit = [w for w in want if (w[0], w[2]) in got]
    assert len(got) == len(want) and len(hit) >= 0.9 * len(want)
    assert all(got[q, i][1] == pytest.approx(c, abs=1e-9) for q, r, i, c in hit)
    few = df.where("vec_id < 4")
    assert neighbours.nearest(few, few).count() == 12 and neighbours.nearest(few.where("vec_id = 0"), few).count() == 0
    assert neighbours.nearest(df.limit(0), df).count() == 0


@pytest.mark.parametrize("count", [50_000, 1_000_000])
def test_probes_keep_the_recall_as_vectors_become_more(count):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(count, 64)).astype(np.float32)  # no structure: nothing is nearer than by chance
    v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
    near = v[:100] @ v.T
    near[np.arange(100), np.arange(100)] = -1
    true = np.argpartition(-near, 5, axis=1)[:, :5]
    hasher = neighbours.CrossPolytope(64, np.log2(count / neighbours.GROUP))
    visited = hasher.probes(v[:100].astype(float), neighbours.probes_for(count))
    keys = hasher.keys(v[true.ravel()].astype(float)).reshape(100, 5, hasher.tables)
    met = [any(keys[q, j, t] in visited[q, t] for t in range(hasher.tables)) for q in range(100) for j in range(5)]
    assert np.mean(met) >= 0.9


def test_mix_by_hand(spark):
    rng = random.Random(1)
    rows = [(i, s, " ".join(["w"] * rng.randint(1, 9))) for i, s in enumerate(["big"] * 600 + ["mid"] * 200 + ["low"] * 100 + [None] * 50)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, tokens int")
    out = mixing.mix(docs).toPandas()
    tokens = {s: sum(len(t.split()) for _, x, t in rows if x == s) for s in ("big", "mid", "low", None)}
    total = sum(tokens.values())
    emitted = out.assign(source=out.source.where(out.source.notna(), None)).groupby("source", dropna=False)["mix_tokens"].sum()
    emitted = {k if isinstance(k, str) else None: v for k, v in emitted.items()}
    assert set(out.doc_id) == {r[0] for r in rows} and out.groupby("doc_id").size().max() <= 2
    assert emitted["big"] == tokens["big"] and emitted[None] == pytest.approx(2 * tokens[None], abs=9)
    exponent = 1 - math.log(2) / math.log(tokens["big"] / tokens[None])
    z = sum((t / total) ** exponent for t in tokens.values())
    for s, t in tokens.items():
        assert emitted[s] == pytest.approx(tokens["big"] * (t / tokens["big"]) ** exponent, abs=9)
        weight = out[out.source.isna() if s is None else out.source == s]["mix_weight"].iloc[0]
        assert weight == pytest.approx((t / total) ** exponent / z, rel=1e-6)
    assert mixing.mix(docs.limit(0)).count() == 0
    blank = docs.withColumn("text", F.lit(None).cast("string"))
    assert mixing.mix(blank).count() == len(rows)


def test_target_entropy_is_met(spark):
    totals = spark.createDataFrame([("a", 8000), ("b", 1000), ("c", 500), ("d", 500)], "src string, tokens long")
    found = mixing.solve(totals, target_entropy=1.8, max_repetition=None)
    p = np.array([0.8, 0.1, 0.05, 0.05]) ** found.exponent
    p /= p.sum()
    assert -(p * np.log2(p)).sum() == pytest.approx(1.8, abs=1e-4)
    capped = mixing.mix(totals.selectExpr("tokens AS doc_id", "src AS source", "repeat('w ', CAST(tokens AS INT)) AS text"), target_entropy=1.8, max_repetition=None, budget=5000.0)
    assert capped.count() >= 1
