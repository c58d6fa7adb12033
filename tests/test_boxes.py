"""Box tables on containers built here, whole and damaged; assembly and recursion of items."""

import struct

import pytest
from pyspark.sql import functions as F

from marlstone.sources import boxes
from marlstone.sources.boxes import box


def files(spark, *contents):
    return spark.createDataFrame([(f"f{i}", c) for i, c in enumerate(contents)], "file string, content binary")


def full(version=0, flags=0):
    return struct.pack(">I", version << 24 | flags)


def infe(item, kind=b"hvc1", name=b"n\0", version=2, flags=0):
    return box("infe", full(version, flags), struct.pack(">HH" if version < 3 else ">IH", item, 0), kind, name)


def meta(*parts):
    return box("meta", full(), *parts)


def test_kinds_of_files(spark):
    rows = [b"BPG\xfbxxxx", box("ftyp", b"heic", bytes(4)), box("ftyp", b"avif", bytes(4)), b"", b"BPG", b"\0\0\0\x10ftyp", None]
    out = files(spark, *rows).select("file", boxes.container_kind(F.col("content")).alias("k")).orderBy("file").collect()
    assert [r["k"] for r in out] == ["bpg", "heif", "unknown", "unknown", "unknown", "unknown", "unknown"]


def test_walk_sizes():
    wide = struct.pack(">I4sQ", 1, b"free", 19) + b"abc"
    last = struct.pack(">I4s", 0, b"mdat") + b"to the end"
    assert list(boxes.walk(box("ftyp", b"heic") + wide + last)) == [("ftyp", 0, 8, 4), ("free", 1, 28, 3), ("mdat", 2, 39, 10)]
    inner = meta(box("iprp", box("ipco", box("ispe", full(), bytes(8)))))
    assert [p for p, *_ in boxes.walk(inner)] == ["meta", "meta/iprp", "meta/iprp/ipco", "meta/iprp/ipco/ispe"]
    # A box beyond the end, one smaller than its header and a cut 64-bit size end the walk, and what came before stays.
    for bad in (struct.pack(">I4s", 99, b"oops"), struct.pack(">I4s", 7, b"oops"), struct.pack(">I4sQ", 1, b"oops", 15), struct.pack(">I4s", 1, b"oops")):
        assert [p for p, *_ in boxes.walk(box("ftyp") + bad + box("free"))] == ["ftyp"]
    assert [p for p, *_ in boxes.walk(box("ftyp") + b"\0\0\0")] == ["ftyp"]


@pytest.mark.parametrize("cut", range(0, 260, 7))
def test_any_cut_is_a_prefix_or_less(cut):
    whole = boxes._packed([{"item": i, "kind": "hvc1", "name": "x", "width": 4, "height": 5, "angle": 90, "axis": 1, "aux": "a", "derived": [1], "auxiliary": None, "data": b"d"} for i in (1, 2)])
    names = [p for p, *_ in boxes.walk(whole)]
    assert len(names) == 18
    got = [p for p, *_ in boxes.walk(whole[:cut])]
    assert got == names[: len(got)]


def test_tables_of_versions_and_damage(spark):
    iloc = bytes([0x44, 0x40]) + struct.pack(">H", 3) + struct.pack(">HHIHII", 1, 0, 100, 1, 5, 6) + struct.pack(">HHIHIIII", 2, 0, 7, 2, 1, 2, 3, 4) + struct.pack(">HHIH", 3, 0, 7, 0)
    second = bytes([0x44, 0x01]) + struct.pack(">I", 2) + struct.pack(">IHHHBII", 9, 1, 0, 1, 0, 11, 12) + struct.pack(">I", 5)
    ipma = struct.pack(">I", 3) + struct.pack(">HBBB", 1, 2, 0x81, 2) + struct.pack(">HB", 2, 0) + struct.pack(">HBB", 3, 4, 1)
    wide = struct.pack(">I", 1) + struct.pack(">IBHH", 70_000, 2, 0x8001, 0x0203)
    iref = box("dimg", struct.pack(">HHHH", 1, 2, 3, 4), struct.pack(">HHH", 5, 9, 6)) + box("auxl", b"\0")
    iinf = box("iinf", full(), struct.pack(">H", 9), infe(1), infe(2, version=3, flags=1, name="café".encode() + b"\0text/x\0"), infe(3, name=b"no end"), box("infe", b"\2"), box("free"))
    a = meta(box("pitm", full(), b"\0\7"), iinf, box("iloc", full(), iloc), box("iprp", box("ipco", box("ispe", full(), struct.pack(">II", 640, 480)), box("ispe", b"short"), box("irot", b"\1")), box("ipma", full(), ipma)), box("iref", full(), iref))
    b = meta(box("pitm", full(1), struct.pack(">I", 70_000)), box("iloc", full(2), second), box("iprp", box("ipma", full(1, 1), wide)), box("iref", full(1), box("thmb", struct.pack(">IHI", 8, 1, 70_000))), box("idat", b"inside"))
    found = boxes.box_table(files(spark, a, b, b"junk", None, b""))
    rows = lambda df, *c: sorted(tuple(r[x] for x in c) for r in df.collect())
    assert rows(boxes.primary_items(found), "file", "item") == [("f0", 7), ("f1", 70_000)]
    assert rows(boxes.item_entries(found), "item", "kind", "name", "content_type", "hidden") == [(1, "hvc1", "n", "", 0), (2, "hvc1", "café", "text/x", 1), (3, "hvc1", "", "", 0)]
    places = {(r["file"], r["item"]): (r["method"], r["start"], r["size"]) for r in boxes.item_places(found).collect()}
    assert places == {("f0", 1): (0, 105, 6), ("f0", 2): (0, 8, 2), ("f0", 3): (0, None, None), ("f1", 9): (1, 11, 12)}
    assert {(r["file"], r["item"]): r["properties"] for r in boxes.item_associations(found).collect()} == {("f0", 1): [1, 2], ("f0", 2): [], ("f0", 3): [1], ("f1", 70_000): [1, 0x203]}
    assert sorted((r["kind"], r["item"], r["to"]) for r in boxes.item_references(found).collect()) == [("dimg", 1, [3, 4]), ("dimg", 5, [6]), ("thmb", 8, [70_000])]
    assert [(r["file"], r["target"], r["item"]) for r in boxes.pointing_at(boxes.item_references(found), "thmb").collect()] == [("f1", 70_000, 8)]
    assert rows(boxes.item_properties(found).na.fill(-1), "number", "kind", "width", "height", "angle") == [(1, "ispe", 640, 480, -1), (2, "ispe", -1, -1, -1), (3, "irot", -1, -1, 270)]


def test_assembly(spark):
    entries = spark.createDataFrame([("f", 0, 1, "hvc1"), ("f", 1, 1, "grid"), ("f", 2, 2, "iden"), ("g", 0, 1, "hvc1"), (None, 0, 1, "hvc1")], "file string, ordinal long, item long, kind string")
    own = spark.createDataFrame([("f", 0, 0, 1, [3, 1, 0, 4, 2, 5, 99, 4]), ("f", 0, 1, 1, [1]), ("g", 0, 0, 2, [1])], "file string, offset long, ordinal long, item long, properties array<long>")
    columns = "file string, number long, kind string, width long, height long, angle long, axis long, aux string, matrix long, full_range boolean, chroma long, depth long"
    nothing = (None,) * 5
    said = [("f", 1, "ispe", 10, 20, None, None, None, None, None, None, None), ("f", 2, "ispe", 30, 40, None, None, None, None, None, None, None), ("f", 3, "imir", None, None, None, 1, *nothing), ("f", 4, "irot", None, None, 90, None, *nothing), ("f", 5, "auxC", None, None, None, None, "alpha", None, None, None, None)]
    out = {(r["file"], r["item"]): r for r in boxes.assemble_items(entries, own, spark.createDataFrame(said, columns)).collect()}
    one = out["f", 1]
    assert (one["kind"], one["width"], one["height"], one["aux"]) == ("hvc1", 30, 40, "alpha")
    assert [(m["kind"], m["value"]) for m in one["transforms"]] == [("imir", 1), ("irot", 90), ("irot", 90)]
    assert out["f", 2]["width"] is None and out["f", 2]["transforms"] == [] and len(out) == 4


def test_item_data(spark):
    content = files(spark, b"0123456789" + meta(box("idat", b"old"), box("idat", b"inside")))
    found = boxes.box_table(files(spark, meta(box("idat", b"old"), box("idat", b"inside"))))
    places = [(0, 1, 0, 2, 3), (1, 1, 0, 0, 1), (0, 2, 1, 2, 4), (0, 3, 1, 3, 4), (0, 4, 2, 0, 1), (0, 5, 0, None, None), (0, 6, 0, 0, 0)]
    table = spark.createDataFrame([("f0", *p) for p in places], "file string, ordinal long, item long, method long, start long, size long")
    out = {r["item"]: r["data"] and bytes(r["data"]) for r in boxes.item_data(table, content, found).collect()}
    assert out == {1: b"234", 2: b"side", 3: None, 4: None, 5: None, 6: bytearray()}


def test_derived_images(spark):
    kinds = {1: "iden", 2: "iovl", 3: "grid", 4: "hvc1", 5: "hvc1", 6: "iden", 7: "iden", 8: "iden", **{k: "iden" for k in range(20, 31)}, 31: "hvc1", 40: "iovl", 41: "iden"}
    links = {1: [2, 5], 2: [3, 4, 4], 3: [4, 5], 6: [7], 7: [6], 8: [], 40: [41, 4], 41: [99], **{k: [k + 1] for k in range(20, 31)}}
    items = spark.createDataFrame([("f", k, v) for k, v in kinds.items()], "file string, item long, kind string")
    refs = spark.createDataFrame([("f", "dimg", 0, i, k, v) for i, (k, v) in enumerate(links.items())] + [("f", "thmb", 0, 0, 4, [1])], "file string, kind string, offset long, ordinal long, item long, to array<long>")
    out = {}
    for r in boxes.derived_sources(items, refs).collect():
        out.setdefault(r["root"], []).append((r["depth"], r["item"], r["fault"]))
    assert sorted(out[1]) == [(2, 4, None), (2, 4, None), (3, 4, None), (3, 5, None)]
    assert sorted(out[3]) == [(1, 4, None), (1, 5, None)] and out[4] == [(0, 4, None)]
    assert out[6] == [(2, 6, "cycle")] and out[8] == [(1, 8, "no reference")]
    assert sorted(out[40], key=str) == [(1, 4, None), (2, 99, "missing item")]
    # Eight steps are allowed, nine are not.
    assert out[23] == [(8, 31, None)] and out[22] == [(9, 31, "too deep")] and out[20][0][2] == "too deep"


def test_packing_and_reading_back(spark):
    rows = [("a", 5, "hvc1", "café", 7, 8, 270, 0, None, None, None, b"xyz"), ("a", 9, "iden", None, None, None, None, None, "alpha", [5], [5], None), ("b", 1, "hvc1", "", 7, 8, 0, None, None, None, None, b"")]
    schema = "file string, item long, kind string, name string, width long, height long, angle long, axis long, aux string, derived array<long>, auxiliary array<long>, data binary"
    packed = boxes.pack_files(spark.createDataFrame(rows, schema))
    found = boxes.box_table(packed)
    items = boxes.assemble_items(boxes.item_entries(found), boxes.item_associations(found), boxes.item_properties(found))
    out = {(r["file"], r["item"]): r for r in items.collect()}
    assert [(m["kind"], m["value"]) for m in out["a", 5]["transforms"]] == [("irot", 270), ("imir", 0)] and out["a", 9]["aux"] == "alpha"
    assert {(r["file"], r["item"]): bytes(r["data"]) for r in boxes.item_data(boxes.item_places(found), packed, found).collect()} == {("a", 5): b"xyz", ("b", 1): b""}
    assert [(r["target"], r["item"]) for r in boxes.auxiliary_items(boxes.item_references(found), items, "alp").collect()] == [(5, 9)]
    assert {r["item"] for r in boxes.primary_items(found).collect()} == {5, 1}
