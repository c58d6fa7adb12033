"""Containers of nested, length-prefixed boxes as tables, and items put together from them.

A file is a row (file, content).  ``box_table`` walks its boxes once; every other table is
made of the payloads of one kind of box: entries of items, places, properties, associations
and references, each with its ordinal, as the first or the last entry may count.  What is
cut off ends a table; it does not fail the file.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.session import written

# Boxes that hold boxes, with the bytes before the first of them; brands of image files.
HOLDERS = {"meta": 4, "iprp": 0, "ipco": 0, "iref": 4}
BRANDS = ["heic", "heix", "hevc", "hevx", "mif1", "msf1"]
#: How deep derived images may refer to others.
MOST_DEPTH = 8
#: Rows, and bytes of them, that a task makes at a time.
MOST_ROWS, MOST_BYTES = 5_000, 4 << 20


def container_kind(content: Column) -> Column:
    """'bpg', 'heif' or 'unknown' by the first bytes: a magic number, or an ftyp box with a brand of images."""
    at = lambda i, n: F.substring(content, i + 1, n)
    major = F.when(at(4, 4) == F.lit(b"ftyp"), at(8, 4))
    return F.when(at(0, 4) == F.lit(b"BPG\xfb"), "bpg").when(F.coalesce(major.isin(*[b.encode() for b in BRANDS]), F.lit(False)), "heif").otherwise("unknown")


def walk(data: bytes, start: int = 0, end: int | None = None, inside: str = "") -> Iterator[tuple[str, int, int, int]]:
    """(path, ordinal, offset, length) of the boxes between two places, and of those within them.

    A size of 1 is followed by 64 bits of size, one of 0 reaches to the end.  A box that
    goes beyond its holder, or is smaller than its header, ends the walk there.
    """
    end = len(data) if end is None else end
    ordinal = 0
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                return
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        name = kind.decode("latin-1")
        yield inside + name, ordinal, start + head, size - head
        skip = HOLDERS.get(name)
        if name == "iinf" and size - head >= 6:
            skip = 6 if data[start + head] == 0 else 8
        if skip is not None and size - head >= skip:
            yield from walk(data, start + head + skip, start + size, f"{inside}{name}/")
        start, ordinal = start + size, ordinal + 1


def _per_row(rows: DataFrame, keep: Sequence[str], column: str, made: Callable[[bytes], Iterator[tuple]], fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """``keep`` and the fields of each tuple that ``made`` gives for a row's bytes; null bytes give none."""
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out, size = [], [], 0
            for i, data in enumerate(batch.column(column)):
                if not data.is_valid:
                    continue
                for entry in made(data.as_py()):
                    at.append(i)
                    out.append(entry)
                    size += sum(len(v) for v in entry if isinstance(v, bytes))
                    # A row makes many, so what is made goes on before the batch ends.
                    if len(out) >= MOST_ROWS or size >= MOST_BYTES:
                        yield batched(batch, at, out)
                        at, out, size = [], [], 0
            yield batched(batch, at, out)

    def batched(batch: pa.RecordBatch, at: list[int], out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[] for _ in fields]
        kept = batch.select(list(keep)).take(pa.array(at, pa.int64()))
        return pa.record_batch([*kept.columns, *(pa.array(c, t) for c, (_, _, t) in zip(columns, fields, strict=True))], [*keep, *(n for n, _, _ in fields)])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"{n} {t}" for n, t, _ in fields)])
    return rows.select(*dict.fromkeys([*keep, column])).mapInArrow(run, schema)


_LONG, _TEXT, _BYTES = ("long", pa.int64()), ("string", pa.string()), ("binary", pa.binary())


def _fields(**types: tuple[str, pa.DataType]) -> list[tuple[str, str, pa.DataType]]:
    return [(n, *t) for n, t in types.items()]


def box_table(files: DataFrame) -> DataFrame:
    """(file, path, ordinal, offset, length, version, payload) of every box; the payload of boxes that hold others is null.

    ``path`` names the holders, as in ``meta/iprp/ipco/ispe``; ``offset`` counts from the
    file's start; ``ordinal`` is the box's place in its holder, from 0; ``version`` is the
    first byte, which is one in boxes with versions.
    """

    def made(data: bytes) -> Iterator[tuple]:
        for path, ordinal, offset, length in walk(data):
            name = path.rsplit("/", 1)[-1]
            yield path, ordinal, offset, length, data[offset] if length else None, None if name in HOLDERS or name == "iinf" else data[offset : offset + length]

    return _per_row(files, ["file"], "content", made, _fields(path=_TEXT, ordinal=_LONG, offset=_LONG, length=_LONG, version=_LONG, payload=_BYTES))


class _Reader:
    """Big-endian numbers one after another; ``more`` tells whether as many bytes are left."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def more(self, n: int) -> bool:
        return self.at + n <= len(self.data)

    def number(self, n: int) -> int:
        """The next ``n`` bytes; 0, without a step, where they are not there."""
        if not self.more(n):
            return 0
        self.at += n
        return int.from_bytes(self.data[self.at - n : self.at], "big")

    def text(self) -> str:
        """Up to the next zero byte; without one, nothing."""
        if self.at >= len(self.data):
            return ""
        end = self.data.find(b"\0", self.at)
        raw = self.data[self.at : max(end, self.at)]
        self.at = max(end, self.at) + 1
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return ""


def _entry(data: bytes) -> Iterator[tuple]:
    r = _Reader(data)
    version = data[0] if data else 0
    if len(data) < (8 if version < 2 else 12 if version == 2 else 14):
        return
    hidden = bool(data[3] & 1)
    r.at = 4
    item = r.number(2 if version < 3 else 4)
    r.at += 2
    kind = r.number(4).to_bytes(4, "big").decode("latin-1") if version >= 2 else "    "
    yield item, kind, r.text(), r.text(), int(hidden)


def _places(data: bytes) -> Iterator[tuple]:
    if len(data) < 8:
        return
    version, offset_size, length_size, base_size = data[0], data[4] >> 4, data[4] & 15, data[5] >> 4
    index_size = data[5] & 15 if version >= 1 else 0
    wide = 2 if version < 2 else 4
    r = _Reader(data, 6)
    for ordinal in range(r.number(wide)):
        if not r.more(wide):
            return
        item, method = r.number(wide), 0
        if version >= 1:
            if not r.more(2):
                return
            method = r.number(2) & 15
        if not r.more(2):
            return
        r.at += 2
        base = r.number(base_size)
        if not r.more(2):
            return
        first = None
        for _ in range(r.number(2)):
            if index_size:
                if not r.more(index_size):
                    break
                r.at += index_size
            extent = r.number(offset_size), r.number(length_size)
            first = first or extent
        yield ordinal, item, method, *((base + first[0], first[1]) if first else (None, None))


def _associations(data: bytes) -> Iterator[tuple]:
    if len(data) < 8:
        return
    wide, large = 2 if data[0] < 1 else 4, data[3] & 1
    r = _Reader(data, 4)
    for ordinal in range(r.number(4)):
        if not r.more(wide):
            return
        item = r.number(wide)
        if not r.more(1):
            return
        properties = []
        for _ in range(r.number(1)):
            if not r.more(1 + large):
                break
            properties.append(r.number(1 + large) & (0x7FFF if large else 0x7F))
        yield ordinal, item, properties


def _references(wide: int, data: bytes) -> Iterator[tuple]:
    r = _Reader(data)
    ordinal = 0
    while r.more(wide + 2):
        source = r.number(wide)
        to = []
        for _ in range(r.number(2)):
            if not r.more(wide):
                break
            to.append(r.number(wide))
        yield ordinal, source, to
        ordinal += 1


def _last(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def primary_items(boxes: DataFrame) -> DataFrame:
    """(file, item): the item that a file shows; the last such box counts."""
    rows = boxes.where("path = 'meta/pitm' AND length >= 6")
    number = lambda n: F.conv(F.hex(F.substring("payload", 5, n)), 16, 10).cast("long")
    item = F.when(F.substring("payload", 1, 1) == F.lit(b"\0"), number(2)).when(F.col("length") >= 8, number(4))
    return rows.groupBy("file").agg(F.max_by(item, "offset").alias("item"))


def item_entries(boxes: DataFrame) -> DataFrame:
    """(file, ordinal, item, kind, name, content_type, hidden)."""
    rows = boxes.where("path = 'meta/iinf/infe'")
    return _per_row(rows, ["file", "ordinal"], "payload", _entry, _fields(item=_LONG, kind=_TEXT, name=_TEXT, content_type=_TEXT, hidden=_LONG))


def item_places(boxes: DataFrame) -> DataFrame:
    """(file, ordinal, item, method, start, size): the first extent of each item, null without one."""
    return _per_row(boxes.where("path = 'meta/iloc'").drop("ordinal"), ["file"], "payload", _places, _fields(ordinal=_LONG, item=_LONG, method=_LONG, start=_LONG, size=_LONG))


def item_associations(boxes: DataFrame) -> DataFrame:
    """(file, ordinal, item, properties): numbers from 1; 0 is none."""
    lists = ("array<long>", pa.list_(pa.int64()))
    return _per_row(boxes.where("path = 'meta/iprp/ipma'").drop("ordinal"), ["file", "offset"], "payload", _associations, _fields(ordinal=_LONG, item=_LONG, properties=lists))


def item_references(boxes: DataFrame) -> DataFrame:
    """(file, kind, offset, ordinal, item, to)."""
    lists = ("array<long>", pa.list_(pa.int64()))
    holder = boxes.where("path = 'meta/iref'").select(F.col("file").alias("_f"), F.col("offset").alias("o"), F.col("length").alias("n"), "version")
    rows = boxes.where("path LIKE 'meta/iref/%'").drop("ordinal", "version").join(holder, (F.col("file") == F.col("_f")) & (F.col("offset") > F.col("o")) & (F.col("offset") <= F.col("o") + F.col("n")))
    rows = rows.withColumn("kind", _last(F.col("path")))
    made = [_per_row(rows.where(condition), ["file", "kind", "offset"], "payload", lambda d, w=wide: _references(w, d), _fields(ordinal=_LONG, item=_LONG, to=lists)) for condition, wide in (("version = 0", 2), ("version <> 0", 4))]
    return made[0].unionByName(made[1])


def _number(start: int, n: int, column: str = "payload") -> Column:
    """``n`` bytes of a payload from ``start`` as a number; null where they are not there."""
    part = F.substring(column, start + 1, n)
    return F.when(F.octet_length(part) == n, F.conv(F.hex(part), 16, 10).cast("long"))


def item_properties(boxes: DataFrame) -> DataFrame:
    """(file, number from 1, kind, ...): what each property says; null what it doesn't, or where it is too short.

    width, height (ispe); angle (irot, clockwise); axis (imir); aux (auxC); matrix,
    full_range (colr of kind nclx); chroma, depth (hvcC).
    """
    rows = boxes.where("path LIKE 'meta/iprp/ipco/%'").withColumn("kind", _last(F.col("path")))
    of = lambda kinds, least, value: F.when(F.col("kind").isin(*kinds) & (F.col("length") >= least), value)
    # Quarter turns are counted against the clock.
    turns = F.element_at(F.array(*map(F.lit, (0, 270, 180, 90))), (_number(0, 1) % 4 + 1).cast("int"))
    name = F.substring_index(F.decode(F.substring("payload", 5, 1 << 20), "UTF-8"), "\0", 1)
    nclx = F.col("kind").isin("colr") & (F.substring("payload", 1, 4) == F.lit(b"nclx")) & (F.col("length") >= 11)
    return rows.select(
        "file", (F.col("ordinal") + 1).alias("number"), "kind", of(["ispe"], 12, _number(4, 4)).alias("width"), of(["ispe"], 12, _number(8, 4)).alias("height"),
        of(["irot"], 1, turns).alias("angle"), of(["imir"], 1, _number(0, 1) % 2).alias("axis"), of(["auxC"], 5, name).alias("aux"),
        F.when(nclx, _number(8, 2)).alias("matrix"), F.when(nclx, _number(10, 1) >= 128).alias("full_range"),
        of(["hvcC", "hvcB"], 23, _number(16, 1) % 4).alias("chroma"), of(["hvcC", "hvcB"], 23, _number(17, 1) % 8 + 8).alias("depth"),
    )


def _first_by(rows: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    names = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*names), order).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in names])


def assemble_items(entries: DataFrame, associations: DataFrame, properties: DataFrame) -> DataFrame:
    """(file, item, kind, width, height, chroma, depth, matrix, full_range, aux, transforms): each item with its properties.

    An item's first entry and first association count.  Of properties that say the same
    thing the last one holds; turns and mirrorings (kind, angle or axis) keep their order.
    Numbers that are 0, or that no property has, are passed over.
    """
    entries = _first_by(entries.select("file", "item", "ordinal", "kind"), ["file", "item"], F.col("ordinal")).drop("ordinal")
    own = _first_by(associations.select("file", "item", "offset", "ordinal", "properties"), ["file", "item"], F.struct("offset", "ordinal"))
    numbers = own.select("file", "item", F.posexplode("properties").alias("place", "number")).where("number > 0")
    said = numbers.join(properties.withColumnRenamed("kind", "property"), ["file", "number"])
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c)
    # Width and height, chroma and depth come from one property each.
    together = lambda a, b: F.max_by(F.struct(a, b), F.when(F.col(a).isNotNull(), F.col("place"))).alias(f"_{a}")
    move = F.when(F.col("property").isin("irot", "imir", "clap") & (F.coalesce("angle", "axis", F.when(F.col("property") == "clap", 0)).isNotNull()), F.struct("place", F.col("property").alias("kind"), F.coalesce("angle", "axis").alias("value")))
    found = said.groupBy("file", "item").agg(together("width", "height"), together("chroma", "depth"), together("matrix", "full_range"), last("aux"), F.sort_array(F.collect_list(move)).alias("_moves"))
    out = entries.join(found, ["file", "item"], "left")
    moves = F.transform(F.coalesce("_moves", F.array().cast("array<struct<place:int,kind:string,value:bigint>>")), lambda m: F.struct(m["kind"].alias("kind"), m["value"].alias("value")))
    return out.select("file", "item", "kind", "_width.width", "_width.height", "_chroma.chroma", "_chroma.depth", "_matrix.matrix", "_matrix.full_range", "aux", moves.alias("transforms"))


def item_data(places: DataFrame, files: DataFrame, boxes: DataFrame) -> DataFrame:
    """(file, item, data): the bytes of each item's first extent, null beyond the end.

    The first place of an item counts; it lies in the file (method 0) or in its idat box
    (method 1; the last such box), any other method gives null.
    """
    first = _first_by(places, ["file", "item"], F.col("ordinal"))
    idat = boxes.where("path = 'meta/idat'").groupBy("file").agg(F.max_by("payload", "offset").alias("idat"))
    rows = first.join(files.select("file", "content"), "file").join(idat, "file", "left")
    source = F.when(F.col("method") == 0, F.col("content")).when(F.col("method") == 1, F.col("idat"))
    inside = F.col("start") + F.col("size") <= F.octet_length(source)
    part = F.when(inside, F.substring(source, (F.col("start") + 1).cast("int"), F.col("size").cast("int")))
    return rows.select("file", "item", part.alias("data"))


def pointing_at(references: DataFrame, kind: str) -> DataFrame:
    """(file, target, item): items that refer to a target by references of one kind (auxl, thmb, dimg, ...)."""
    rows = references.where(F.col("kind") == kind)
    return rows.select("file", F.explode(F.array_distinct("to")).alias("target"), "item")


def auxiliary_items(references: DataFrame, items: DataFrame, prefix: str) -> DataFrame:
    """(file, target, item): auxiliary images of a target, such as alpha, whose type begins with ``prefix``."""
    named = items.where(F.col("aux").startswith(prefix)).select("file", "item")
    return pointing_at(references, "auxl").join(named, ["file", "item"]).select("file", "target", "item")


def derived_sources(items: DataFrame, references: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """(file, root, item, depth, fault): the coded images that each item is derived from, with repeats.

    An identity takes its first reference, an overlay all of them, and either may refer to
    derived items; a grid's tiles are coded images.  ``fault`` is null, or why the root
    can't be put together: 'cycle', 'too deep' (more than ``most_depth`` steps),
    'no reference' or 'missing item' (``item`` is then where it was found).
    """
    kinds = items.select("file", "item", "kind")
    links = references.where("kind = 'dimg'").select("file", "item", "offset", "ordinal", F.posexplode("to").alias("place", "target"))
    links = links.join(kinds, ["file", "item"])
    ordered = links.groupBy("file", "item", "kind").agg(F.sort_array(F.collect_list(F.struct("offset", "ordinal", "place", "target"))).alias("t"))
    targets = F.when(F.col("kind") == "iden", F.slice("t", 1, 1)).otherwise(F.col("t"))
    links = ordered.where("kind IN ('iden', 'iovl', 'grid')").select("file", "item", F.explode(F.transform(targets, lambda t: t["target"])).alias("target"))
    # Every derived item gets a row without a target if it has none.
    derived = kinds.where("kind IN ('iden', 'iovl', 'grid')").select("file", "item", F.col("kind").alias("of"))
    steps = derived.join(links, ["file", "item"], "left").join(kinds.select("file", F.col("item").alias("target"), F.col("kind").alias("target_kind")), ["file", "target"], "left")
    steps = written(steps.select(F.col("file").alias("_f"), F.col("item").alias("_i"), "of", "target", "target_kind"), "steps")
    fault = F.expr(f"""CASE WHEN target IS NULL THEN 'no reference' WHEN array_contains(path, target) THEN 'cycle' WHEN target_kind IS NULL THEN 'missing item'
      WHEN depth + 1 > {int(most_depth)} AND of <> 'grid' THEN 'too deep' END""")
    kind = F.when(F.col("of") == "grid", "tile").otherwise(F.coalesce("target_kind", F.lit("none")))
    on = (F.col("file") == F.col("_f")) & (F.col("item") == F.col("_i")) & (F.col("kind") == F.col("of"))
    roots = kinds.select("file", F.col("item").alias("root"), "item", "kind", F.lit(0).alias("depth"), F.array("item").alias("path"), F.lit(None).cast("string").alias("fault"))
    open_ = F.col("fault").isNull() & F.col("kind").isin("iden", "iovl", "grid")
    levels = [written(roots, "level0")]
    # A round of joins a step: beyond ``most_depth`` every step is an end.  Each round is written, so that none is worked out twice.
    for depth in range(1, max(0, int(most_depth)) + 2):
        rows = levels[-1].where(open_).join(steps, on)
        rows = rows.select("file", "root", F.coalesce("target", "item").alias("item"), kind.alias("kind"), F.lit(depth).alias("depth"), F.concat("path", F.array("target")).alias("path"), fault.alias("fault"))
        levels.append(written(rows, f"level{depth}"))
        if levels[-1].where(open_).isEmpty():
            break
    ends = [level.where(~open_).select("file", "root", "item", "depth", "fault") for level in levels]
    return reduce(DataFrame.unionAll, ends)


def box(kind: str, *parts: bytes) -> bytes:
    """One box with a 32-bit size."""
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind.encode("latin-1")) + body


def _packed(rows: list[dict]) -> bytes:
    """A file of items; items with a text in ``data`` keep it behind the tables."""
    full = lambda version=0, flags=0: struct.pack(">I", version << 24 | flags)
    properties: dict[bytes, int] = {}
    entries, links, references, data, extents = [], [], [], b"", []
    for r in rows:
        entries.append(box("infe", full(3), struct.pack(">IH", r["item"], 0), r["kind"].encode("latin-1"), (r["name"] or "").encode() + b"\0"))
        own = []
        if r["width"] is not None:
            own.append(box("ispe", full(), struct.pack(">II", r["width"], r["height"])))
        if r["angle"]:
            own.append(box("irot", bytes([(360 - r["angle"]) // 90 % 4])))
        if r["axis"] is not None:
            own.append(box("imir", bytes([r["axis"]])))
        if r["aux"] is not None:
            own.append(box("auxC", full(), r["aux"].encode() + b"\0"))
        numbers = [properties.setdefault(p, len(properties) + 1) for p in own]
        links.append(struct.pack(">IB", r["item"], len(numbers)) + b"".join(struct.pack(">H", n) for n in numbers))
        for kind, to in (("dimg", r["derived"]), ("auxl", r["auxiliary"])):
            if to:
                references.append(box(kind, struct.pack(f">IH{len(to)}I", r["item"], len(to), *to)))
        if r["data"] is not None:
            extents.append((r["item"], len(data), len(r["data"])))
            data += r["data"]
    head = box("ftyp", b"heic", bytes(4), b"mif1heic")

    def meta(base: int) -> bytes:
        places = b"".join(struct.pack(">IHHHQQ", item, 0, 0, 1, base + start, size) for item, start, size in extents)
        return box(
            "meta", full(), box("pitm", full(1), struct.pack(">I", rows[0]["item"])), box("iinf", full(1), struct.pack(">I", len(entries)), *entries),
            box("iloc", full(2), bytes([0x88, 0]), struct.pack(">I", len(extents)), places), box("iprp", box("ipco", *properties), box("ipma", full(1, 1), struct.pack(">I", len(links)), *links)),
            box("iref", full(1), *references),
        )

    return head + meta(len(head) + len(meta(0)) + 8) + box("mdat", data)


def pack_files(items: DataFrame) -> DataFrame:
    """(file, content): a container of each file's items, in order of ``item``; the first one is what it shows.

    Columns read: file, item, kind (four letters), name, width, height, angle (clockwise),
    axis, aux, derived and auxiliary (items referred to), data; all but the first three may
    be null.  Equal properties are stored once.
    """
    names = ["file", "item", "kind", "name", "width", "height", "angle", "axis", "aux", "derived", "auxiliary", "data"]

    def packed(rows: pa.Table) -> pa.Table:
        content = _packed(rows.sort_by("item").to_pylist())
        return pa.table([rows.column("file").combine_chunks().take(pa.array([0])), pa.array([content], pa.binary())], ["file", "content"])

    return items.select(*names).groupBy("file").applyInArrow(packed, f"file {dict(items.dtypes)['file']}, content binary")
