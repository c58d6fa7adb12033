"""Near-duplicate documents by MinHash with tensored banding, links confirmed on full sets.

A document's set holds its distinct shingles.  Two collections of ``BANDS`` band keys
(each of ``ROWS`` minhashes) are computed per set, and a table's key is a pair of one key
from either collection: BANDS * BANDS tables of 2 * ROWS minhashes from only
2 * BANDS * ROWS of them.  Two sets meet in some table if and only if they share a key of
the first and a key of the second collection; sets of similarity s miss each other with
probability of about 2 * (1 - s ** ROWS) ** BANDS, 6e-6 at 0.8 and less above.

Pairs are not listed within groups.  Equal sets are one class from the start.  In turns,
one class of each group is compared with the others, and confirmed links join components.
When a turn finds no more, only members of different components that still share a table
are compared: all of them, so that no link between two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import discard, materialise, slices, small

#: Band keys of a collection, and minhashes of a band key.
BANDS, ROWS = 24, 4
#: Words of a shingle, and the least similarity in hundredths.
WORDS, SIMILARITY = 5, 80
#: Most turns in which one class of each group meets the others, before the rest is compared in full.
TURNS = 3
#: Shingles that are hashed at a time.
BLOCK = 8192
#: Documents up to which the ids of those to compare are sent to every executor.
INVOLVED_ROWS = 1_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles.

    A-Z are lower-cased; words are parted by the six ASCII spaces; fewer words than a
    shingle has are one shingle; no words, no shingle.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in found], np.uint64)
    n = max(1, len(h) - words + 1)
    out = np.full(n, min(len(h), words), np.uint64)
    for k in range(min(words, len(h))):
        out = _mix(out ^ h[k : k + n])
    return np.unique(out)


class Sketcher:
    """Band keys of shingle sets; the same on every executor."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows = bands, rows
        random = np.random.default_rng(20_231)
        n = bands * rows
        self.factor = random.integers(0, 1 << 31, (2, n, 1), np.uint32) * np.uint32(2) + np.uint32(1)
        self.shift = random.integers(0, 1 << 32, (2, n, 1), np.uint32)
        self.band = _mix(np.arange(1, 2 * bands + 1, dtype=np.uint64))

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """2 * bands keys as signed integers: the first collection's, then the second's."""
        low = np.full((2, self.bands * self.rows), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(shingles), BLOCK):
            part = shingles[i : i + BLOCK]
            halves = (part & np.uint64(0xFFFFFFFF)).astype(np.uint32), (part >> np.uint64(32)).astype(np.uint32)
            for side in (0, 1):
                np.minimum(low[side], (self.factor[side] * halves[side] + self.shift[side]).min(axis=1), out=low[side])
        grouped = low.astype(np.uint64).reshape(2 * self.bands, self.rows)
        key = self.band.copy()
        for k in range(self.rows):
            key = _mix(key ^ grouped[:, k]) + self.band
        return key.view(np.int64)


def _sketch(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """Per row: doc_id, n_shingles, a 128-bit digest of the set (d1, d2) and its band keys."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, d1 long, d2 long, keys array<long>"

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(bands, rows)
        for batch in slices(batches):
            size, digest, keys, ends = [], [], [], [0]
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, words)
                size.append(len(s))
                digest.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64))
                if len(s):
                    keys.append(sketcher.keys(s))
                ends.append(ends[-1] + (2 * bands if len(s) else 0))
            d = np.array(digest, np.int64).reshape(-1, 2)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), lists], ["doc_id", "n_shingles", "d1", "d2", "keys"])

    return docs.mapInArrow(sketched, schema)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """Per row: doc_id, the set's digest and the set itself."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, d1 long, d2 long, shingles array<long>"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
            d = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets], np.int64).reshape(-1, 2)
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "d1", "d2", "shingles"])

    return docs.mapInArrow(made, schema)


def _sets_of(docs: DataFrame, classes: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(cid, shingles) of the classes in ``ids``, from their documents' whole texts; written."""
    involved = materialise(classes.join(ids, "cid", "left_semi").select("cid", "doc_id", "d1", "d2"), "involved")
    wanted = small(involved.select("doc_id").distinct(), involved.count(), INVOLVED_ROWS)
    sets = _sets(docs.join(wanted, "doc_id", "left_semi"), words).join(small(involved, limit=INVOLVED_ROWS), ["doc_id", "d1", "d2"])
    # Rows that repeat a document give its set again.
    out = materialise(sets.select("cid", "shingles").dropDuplicates(["cid"]), "sets")
    discard(involved)
    return out


def _confirm(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, similarity: int) -> DataFrame:
    """Those of ``pairs`` (a, b: classes) whose full sets are similar enough; written."""
    sets = _sets_of(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), words)
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa")).hint("merge"), "a")
    both = both.join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb")).hint("merge"), "b")
    na, nb = F.size("sa"), F.size("sb")
    near = both.where(F.least(na, nb) * 100 >= F.greatest(na, nb) * similarity)
    common = F.size(F.array_intersect("sa", "sb"))
    links = materialise(near.withColumn("common", common).where(F.col("common") * 100 >= (na + nb - F.col("common")) * similarity).select("a", "b"), "links")
    discard(sets)
    return links


def components(links: DataFrame) -> DataFrame:
    """(cid, comp) for every class with a link; comp names the component.

    Each round points every node to the neighbour (or itself) that comes first, and
    contracts links to what their ends point to.  Nodes with more links come first, by
    powers of two, so that a star is one node after a round; among others the order is
    drawn anew for the round.
    """
    edges = links.select("a", "b")
    labels = None
    made = []
    turn = 0
    while not edges.isEmpty():
        turn += 1
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("e.*")
        few = -F.floor(F.log2(F.count(F.lit(1))))
        ranks = ends.groupBy("x").agg(few.alias("few")).select(F.col("x").alias("y"), F.struct("few", F.xxhash64("x", F.lit(turn)).alias("r"), F.col("x").alias("y")).alias("rank"))
        seen = ends.join(ranks, "y").select("x", "rank").union(ranks.select("y", "rank"))
        first = materialise(seen.groupBy("x").agg(F.min("rank")["y"].alias("p")), "point")
        a, b = first.select(F.col("x").alias("a"), F.col("p").alias("pa")), first.select(F.col("x").alias("b"), F.col("p").alias("pb"))
        edges = materialise(edges.join(a, "a").join(b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        step = first.select(F.col("x").alias("comp"), F.col("p"))
        labels = first.select(F.col("x").alias("cid"), F.col("p").alias("comp")) if labels is None else labels.join(step, "comp", "left").select("cid", F.coalesce("p", "comp").alias("comp"))
        labels = materialise(labels, "labels")
        made += [first, edges, labels]
    if labels is None:
        return links.select(F.col("a").alias("cid"), F.col("a").alias("comp"))
    discard(*[t for t in made if t is not labels])
    return labels


def _with_components(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """(cid, key, side, comp) of the keys that still have members of different components."""
    rows = keys.select("cid", "key", "side").join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    found = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return materialise(rows.join(found.hint("merge"), "key"), "keys")


def _star_pairs(keys: DataFrame, turn: int) -> DataFrame:
    """Pairs of each key's first class, in an order drawn for the turn, with members of other components.

    Only pairs that share a key of either collection, and so a table, are returned.
    """
    rank = F.struct(F.xxhash64("cid", F.lit(turn)).alias("r"), "cid", "comp")
    first = keys.groupBy("key").agg(F.min(rank).alias("f")).select("key", F.col("f.cid").alias("lead"), F.col("f.comp").alias("lead_comp"))
    met = keys.join(first.hint("merge"), "key").where("comp <> lead_comp")
    pairs = met.groupBy("cid", "lead").agg(F.min("side").alias("least"), F.max("side").alias("most")).where("least < most")
    return materialise(pairs.select(F.least("cid", "lead").alias("a"), F.greatest("cid", "lead").alias("b")), "star")


def _unjoined_links(docs: DataFrame, classes: DataFrame, keys: DataFrame, words: int, similarity: int) -> DataFrame:
    """All links between classes that share a table and are in different components; written.

    Tables with the same first key stand together under it.  There, classes are held
    against those outside the most frequent component only, and a pair is looked at under
    the least first key that it shares, if it shares a second key as well.

    Each class carries its difference from one member of the group, the pivot, which is
    short where members are alike.  Two sets differ in |d| + |e| - 2 * |d and e| shingles,
    d and e their differences from the pivot, and are linked if this is at most
    (100 - s) / (100 + s) of their sizes' sum.  So the join itself confirms links on what
    makes up the full sets, and no pair that is no link leaves it.
    """
    own = keys.groupBy("cid", "comp").agg(*(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("key")))).alias(f"k{s}") for s in (0, 1)))
    rows = own.where((F.size("k0") > 0) & (F.size("k1") > 0)).withColumn("key", F.explode("k0"))
    per_comp = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("pivot"))
    main = per_comp.groupBy("key").agg(F.max(F.struct("n", "comp", "pivot")).alias("m"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    rows = materialise(rows.join(main.select("key", F.col("m.comp").alias("main"), F.col("m.pivot").alias("pivot")).hint("merge"), "key"), "tables")

    sets = _sets_of(docs, classes, rows.select(F.explode(F.array("cid", "pivot")).alias("cid")).distinct(), words)
    against = rows.select("cid", "pivot").distinct().join(sets.hint("merge"), "cid")
    against = against.join(sets.select(F.col("cid").alias("pivot"), F.col("shingles").alias("p")).hint("merge"), "pivot")
    differ = F.concat(F.array_except("shingles", "p"), F.array_except("p", "shingles"))
    against = materialise(against.select("cid", "pivot", F.size("shingles").alias("n"), differ.alias("d")), "differences")
    full = materialise(rows.join(against.hint("merge"), ["cid", "pivot"]), "tables")
    discard(rows, sets, against)

    other = full.where("comp <> main").select("key", *[F.col(c).alias(f"o_{c}") for c in ("cid", "comp", "k0", "k1", "n", "d")])
    total, unlike = F.col("n") + F.col("o_n"), F.size("d") + F.size("o_d")
    allowed = total * (100 - similarity)
    condition = (
        (F.col("key") == F.col("key2"))
        & (F.col("comp") != F.col("o_comp"))
        & ((F.col("comp") == F.col("main")) | (F.col("o_cid") < F.col("cid")))
        & (F.abs(F.size("d") - F.size("o_d")) * (100 + similarity) <= allowed)
        & (F.array_min(F.array_intersect("k0", "o_k0")) == F.col("key"))
        & F.arrays_overlap("k1", "o_k1")
        & ((unlike - 2 * F.size(F.array_intersect("d", "o_d"))) * (100 + similarity) <= allowed)
    )
    met = other.join(full.hint("merge").withColumnRenamed("key", "key2"), condition)
    links = materialise(met.select(F.col("o_cid").alias("a"), F.col("cid").alias("b")), "links")
    discard(full)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept.

    Documents are linked if 100 * |common shingles| >= similarity * |all shingles|; a
    component's id is its smallest doc_id, and that document is kept.  A null or empty
    text is linked with nothing and keeps its own id.  Rows that repeat share their id's
    verdict.  A row without an id can not name a component: it counts in none, and is kept
    with a null component_id.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketch = materialise(_sketch(docs, words, bands, rows), "sketch")
    full = sketch.where("n_shingles > 0 and doc_id is not null")
    keyed = full.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"))
    keyed = materialise(keyed.withColumn("cid", F.monotonically_increasing_id()), "keyed")
    # Band keys are most of these tables, and are done with early.
    digests = materialise(sketch.drop("keys"), "digests")
    discard(sketch)

    key: Column = F.posexplode("keys").alias("pos", "key")
    exploded = keyed.select("cid", key).select("cid", "key", (F.col("pos") >= bands).cast("int").alias("side"))
    shared = exploded.groupBy("key").agg(F.min("cid").alias("lead"), F.max("cid").alias("last")).where("lead < last").select("key")
    keys = materialise(exploded.join(shared.hint("merge"), "key").withColumn("comp", F.col("cid")), "keys")
    classes = materialise(keyed.drop("keys"), "classes")
    discard(keyed)
    links = labels = None
    made = []
    for turn in range(TURNS):
        star = _star_pairs(keys, turn)
        new = _confirm(docs, classes, star, words, similarity)
        made.append(new)
        discard(star)
        if new.isEmpty():
            break
        links = new if links is None else links.union(new)
        labels = components(links)
        made.append(labels)
        left = _with_components(keys, labels)
        discard(keys)
        keys = left
    last = _unjoined_links(docs, classes, keys, words, similarity)
    labels = components(last if links is None else links.union(last))
    discard(keys)

    named = classes.select("cid", "d1", "d2", "doc_id").join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = materialise(named.join(least.hint("merge"), "comp").select("d1", "d2", "component_id"), "named")
    discard(classes, last, labels, *made)
    out = digests.join(named.hint("merge"), ["d1", "d2"], "left")
    out = out.withColumn("component_id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
