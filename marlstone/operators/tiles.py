"""Pictures as rows of pieces, and work on square tiles with a halo.

A piece is a rectangle of a picture: the picture's key, its width and height (w, h), where
the piece lies (px, py, pw, ph), the samples of all planes (planes, data; as bytes if all
are whole numbers from 0 to 255, else as 64-bit floats), and sums that travel with it; a piece without samples carries only sums.  A picture of any size is any number of pieces;
samples that no piece holds are 0.  What a tile needs of its neighbours is cut out of the
pieces and sent to it, so that one shuffle gives each tile its surroundings, and no task
holds more than a tile.  Results do not depend on how a picture is cut or tiled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples along an edge of a tile, and lines of a piece that ``pieces_of`` cuts.
TILE, LINES = 128, 64
#: Bytes, and rows, that a task takes up or hands on at a time.
SLICE_BYTES, SLICE_ROWS = 4 << 20, 2_048
PIECE = "w int, h int, px int, py int, pw int, ph int, planes int, data binary, sums array<double>"


class Tile(NamedTuple):
    """Samples [planes, y, x] of a tile and its halo; where it starts; its picture's size; sums of the pieces that begin in it."""

    planes: np.ndarray
    x0: int
    y0: int
    w: int
    h: int
    sums: np.ndarray


class Region(NamedTuple):
    """Samples [planes, y, x] from (left, top) on, of which x0 ... x1 - 1 and y0 ... y1 - 1 are the region's own; its picture's size."""

    planes: np.ndarray
    left: int
    top: int
    x0: int
    y0: int
    x1: int
    y1: int
    w: int
    h: int


def encoded(samples: np.ndarray) -> bytes:
    """Samples as a piece holds them: bytes where that loses nothing."""
    with np.errstate(invalid="ignore"):
        short = samples.astype(np.uint8)
    return (short if (short == samples).all() else np.ascontiguousarray(samples, np.float64)).tobytes()


def decoded(data: bytes, planes: int, ph: int, pw: int) -> np.ndarray:
    """Samples [planes, y, x] of a piece, as bytes or floats."""
    return np.frombuffer(data, np.uint8 if len(data) == planes * ph * pw else np.float64).reshape(planes, ph, pw)


def sliced(batches: Iterator[pa.RecordBatch], *columns: str, size: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of a few rows with at most ``size`` bytes, or entries, in ``columns``, or of one larger row."""
    for batch in batches:
        count = np.zeros(batch.num_rows, np.int64)
        for c in columns:
            length = pc.list_value_length if pa.types.is_list(batch.column(c).type) else pc.binary_length
            count += pc.fill_null(length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(count)
        at, done = 0, 0
        while at < batch.num_rows:
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, done + size, "right"))))
            yield batch.slice(at, to - at)
            at, done = to, int(ends[to - 1])


def pieces_of(pictures: DataFrame, by: Sequence[str], width: str, planes: Sequence[str], lines: int = LINES) -> DataFrame:
    """Pieces of pictures that are rows: ``planes`` hold equally many samples in line order.

    A last line that is not whole is filled with 0.  Pictures without samples, a width or
    a plane give no pieces.
    """
    types = dict(pictures.dtypes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, *planes):
            at, out, size = [], [], 0
            keys = batch.select(list(by))
            widths = batch.column(width).to_pylist()
            for i in range(batch.num_rows):
                own = [batch.column(p)[i].values for p in planes]
                if not widths[i] or widths[i] < 1 or any(v is None or not len(v) for v in own):
                    continue
                w, h = widths[i], -(-len(own[0]) // widths[i])
                if max(map(len, own)) > w * h:
                    raise ValueError("a picture's planes hold equally many samples")
                for y in range(0, h, lines):
                    part = np.zeros((len(own), min(lines, h - y) * w))
                    for k, v in enumerate(own):
                        held = v.slice(y * w, part.shape[1])
                        part[k, : len(held)] = held.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
                    at.append(i)
                    out.append((w, h, 0, y, w, min(lines, h - y), len(own), encoded(part), []))
                    size += len(out[-1][7])
                    if size >= SLICE_BYTES:
                        yield _batch(keys.take(pa.array(at, pa.int64())), list(by), out)
                        at, out, size = [], [], 0
            yield _batch(keys.take(pa.array(at, pa.int64())), list(by), out)

    return pictures.select(*by, width, *planes).mapInArrow(cut, ", ".join([f"`{c}` {types[c]}" for c in by] + [PIECE]))


_FIELDS = [("w", pa.int32()), ("h", pa.int32()), ("px", pa.int32()), ("py", pa.int32()), ("pw", pa.int32()), ("ph", pa.int32()), ("planes", pa.int32()), ("data", pa.binary()), ("sums", pa.list_(pa.float64()))]


def _batch(keys: pa.RecordBatch, by: list[str], rows: list[tuple], more: Sequence[tuple[str, pa.DataType]] = ()) -> pa.RecordBatch:
    fields = [*_FIELDS, *more]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.record_batch([*(keys.column(c) for c in by), *(pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True))], [*by, *(n for n, _ in fields)])


def _parts(samples: np.ndarray, px: int, py: int, w: int, h: int, tile: int, halo: int) -> Iterator[tuple[np.ndarray, int, int, int, int]]:
    """What each tile whose halo reaches a piece needs of it, where that starts, and the tile (tx, ty)."""
    ph, pw = samples.shape[1:]
    for ty in range(max(0, (py - halo) // tile), min((h - 1) // tile, (py + ph - 1 + halo) // tile) + 1):
        for tx in range(max(0, (px - halo) // tile), min((w - 1) // tile, (px + pw - 1 + halo) // tile) + 1):
            x0, x1 = max(px, tx * tile - halo), min(px + pw, (tx + 1) * tile + halo)
            y0, y1 = max(py, ty * tile - halo), min(py + ph, (ty + 1) * tile + halo)
            yield samples[:, y0 - py : y1 - py, x0 - px : x1 - px], x0, y0, tx, ty


def _sent(pieces: DataFrame, by: list[str], tile: int, halo: int) -> DataFrame:
    """Each piece's part for each tile that it reaches, the tile (tx, ty) beside it."""
    types = dict(pieces.dtypes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "data"):
            at, out = [], []
            rows = zip(*(batch.column(n).to_pylist() for n, _ in _FIELDS), strict=True)
            for i, (w, h, px, py, pw, ph, planes, data, sums) in enumerate(rows):
                if not data:
                    at.append(i)
                    out.append((w, h, px, py, 0, 0, planes, b"", sums, min(px, w - 1) // tile, min(py, h - 1) // tile))
                    continue
                for part, x0, y0, tx, ty in _parts(decoded(data, planes, ph, pw), px, py, w, h, tile, halo):
                    home = (tx, ty) == (px // tile, py // tile)
                    at.append(i)
                    out.append((w, h, x0, y0, part.shape[2], part.shape[1], planes, part.tobytes(), sums if home else None, tx, ty))
            yield _batch(batch.select(by).take(pa.array(at, pa.int64())), by, out, [("tx", pa.int32()), ("ty", pa.int32())])

    return pieces.select(*by, *(n for n, _ in _FIELDS)).mapInArrow(cut, ", ".join([*(f"`{c}` {types[c]}" for c in by), PIECE, "tx int, ty int"]))


def _places(start: int, count: int, size: int, edge: str) -> np.ndarray:
    """Where to read the samples start ... start + count - 1 of a line of ``size``: mirrored beyond its ends, or the last one again."""
    at = np.arange(start, start + count)
    if edge == "repeat":
        return at.clip(0, size - 1)
    at = at % (2 * size)
    return np.where(at < size, at, 2 * size - 1 - at)


def _laid(rows: list[dict], planes: int, left: int, top: int, right: int, bottom: int) -> tuple[np.ndarray, np.ndarray]:
    """The samples of a rectangle, and the sums of the pieces that begin in it."""
    canvas, sums = np.zeros((planes, bottom - top, right - left)), np.zeros(0)
    for r in rows:
        px, py, pw, ph, own = (r[c] for c in ("px", "py", "pw", "ph", "sums"))
        # A piece may lie beyond what a tile at the rim needs.
        ax, ay, bx, by_ = max(px, left), max(py, top), min(px + pw, right), min(py + ph, bottom)
        if ax < bx and ay < by_:
            canvas[:, ay - top : by_ - top, ax - left : bx - left] = decoded(r["data"], planes, ph, pw)[:, ay - py : by_ - py, ax - px : bx - px]
        if own:
            sums = sums + np.array(own) if len(sums) else np.array(own)
    return canvas, sums


def over_tiles(pieces: DataFrame, by: Sequence[str], tile: int, halo: int, edge: str, kernel: Callable[[Tile], dict], schema: str) -> DataFrame:
    """Rows that ``kernel`` makes of every tile: a dictionary of equally long columns.

    Beyond the picture's edge the halo holds its samples mirrored (``edge`` 'mirror', the
    last one twice) or the last one again ('repeat').
    """
    def tiled(rows: list[dict], tx: int, ty: int) -> dict:
        w, h, planes = (rows[0][c] for c in ("w", "h", "planes"))
        x0, y0 = tx * tile, ty * tile
        x1, y1 = min(w, x0 + tile), min(h, y0 + tile)
        left, top, right, bottom = max(0, x0 - halo), max(0, y0 - halo), min(w, x1 + halo), min(h, y1 + halo)
        canvas, sums = _laid(rows, planes, left, top, right, bottom)
        padded = canvas[:, _places(y0 - halo, y1 - y0 + 2 * halo, h, edge) - top][:, :, _places(x0 - halo, x1 - x0 + 2 * halo, w, edge) - left]
        return kernel(Tile(padded, x0, y0, w, h, sums))

    return by_tile(_sent(pieces, list(by), tile, halo), by, tiled, schema)


def over_regions(pieces: DataFrame, by: Sequence[str], tile: int, halo: int, most: int, kernel: Callable[[Sequence[Region]], list[np.ndarray]], cut: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """by..., w, h and sums: what ``kernel`` makes of each region of a picture; regions are handed to it several at a time.

    A picture of one piece and at most ``most`` samples is a region, worked off where it
    lies without a shuffle; others are cut into tiles and their halos.  With ``cut``,
    ``pieces`` are any rows, and it makes batches of pieces of theirs.
    """
    by = list(by)
    types = dict(pieces.dtypes)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(cut(batches) if cut else batches, "data"):
            at, out, whole = [], [], []
            rows = zip(*(batch.column(n).to_pylist() for n, _ in _FIELDS), strict=True)
            for i, (w, h, px, py, pw, ph, planes, data, _) in enumerate(rows):
                if not data:
                    at.append(i)
                    out.append((w, h, 0, 0, 0, 0, planes, b"", [], 0, 0))
                elif (pw, ph) == (w, h) and w * h <= most:
                    whole.append((i, Region(decoded(data, planes, ph, pw), 0, 0, 0, 0, w, h, w, h)))
                else:
                    for part, x0, y0, tx, ty in _parts(decoded(data, planes, ph, pw), px, py, w, h, tile, halo):
                        at.append(i)
                        out.append((w, h, x0, y0, part.shape[2], part.shape[1], planes, part.tobytes(), None, tx, ty))
            for (i, r), sums in zip(whole, kernel([r for _, r in whole]), strict=True):
                at.append(i)
                out.append((r.w, r.h, 0, 0, 0, 0, len(r.planes), b"", sums.tolist(), 0, 0))
            yield _batch(batch.select(by).take(pa.array(at, pa.int64())), by, out, [("tx", pa.int32()), ("ty", pa.int32())])

    def tiled(rows: list[dict], tx: int, ty: int) -> dict:
        w, h, planes = (rows[0][c] for c in ("w", "h", "planes"))
        x0, y0 = tx * tile, ty * tile
        x1, y1 = min(w, x0 + tile), min(h, y0 + tile)
        left, top = max(0, x0 - halo), max(0, y0 - halo)
        canvas, _ = _laid(rows, planes, left, top, min(w, x1 + halo), min(h, y1 + halo))
        return {"w": [w], "h": [h], "sums": [s.tolist() for s in kernel([Region(canvas, left, top, x0, y0, x1, y1, w, h)])]}

    sent = (pieces if cut else pieces.select(*by, *(n for n, _ in _FIELDS))).mapInArrow(measured, ", ".join([*(f"`{c}` {types[c]}" for c in by), PIECE, "tx int, ty int"]))
    return by_tile(sent, by, tiled, "w int, h int, sums array<double>", "sums")


def by_tile(sent: DataFrame, by: Sequence[str], work: Callable[[list[dict], int, int], dict], schema: str, settled: str | None = None) -> DataFrame:
    """by... and the columns that ``work`` makes of the parts of each tile (tx, ty).

    A shuffle brings a tile's parts together and in a row, so that a task holds those of one
    tile, and what it makes of a few.  Rows with a value in the column ``settled`` go on as
    they are.
    """
    by = list(by)
    keys = [*by, "tx", "ty"]
    types = dict(sent.dtypes)
    full = ", ".join([*(f"`{c}` {types[c]}" for c in by), schema])
    empty = sent.sparkSession.createDataFrame([], full)
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = [(f.name, f.type) for f in to_arrow_schema(empty.schema)]
    names = [c for c in sent.columns if c not in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[list] = [[] for _ in wanted]
        size, key, held = 0, None, []

        def finish() -> int:
            columns = work(held, *key[-2:])
            values = [v.tolist() if isinstance(v, np.ndarray) else v for v in (columns[n] for n, _ in wanted[len(by) :])]
            for out, v in zip(made, [*([k] * len(values[0]) for k in key[:-2]), *values], strict=True):
                out.extend(v)
            return sum(len(v) for v in columns.get("data", ()))

        def ready() -> pa.RecordBatch:
            return pa.record_batch([pa.array(v, t) for v, (_, t) in zip(made, wanted, strict=True)], [n for n, _ in wanted])

        for whole in batches:
            if settled:
                done = whole.column(settled).is_valid()
                yield whole.filter(done).select([n for n, _ in wanted])
                whole = whole.filter(pc.invert(done))
            for batch in sliced(iter([whole]), "data"):
                parts = zip(*(batch.column(c).to_pylist() for c in names), strict=True)
                for k, part in zip(zip(*(batch.column(c).to_pylist() for c in keys), strict=True), parts, strict=True):
                    if held and not _alike(k, key):
                        size += finish()
                        held = []
                        if size >= SLICE_BYTES or len(made[-1]) >= SLICE_ROWS:
                            yield ready()
                            made, size = [[] for _ in wanted], 0
                    key = k
                    held.append(dict(zip(names, part, strict=True)))
        if held:
            finish()
        yield ready()

    return sent.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, full)


def _alike(a: tuple, b: tuple) -> bool:
    """Keys of one group, where a number that is none equals another."""
    return a == b or all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))


def as_piece(planes: np.ndarray, x0: int, y0: int, w: int, h: int, sums: np.ndarray) -> dict:
    """The columns of one piece."""
    return {
        "w": [w], "h": [h], "px": [x0], "py": [y0], "pw": [planes.shape[2]], "ph": [planes.shape[1]], "planes": [len(planes)],
        "data": [encoded(planes)], "sums": [sums.tolist()],
    }


def summed(pieces: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """Per picture the travelling sums added up, as s0, s1, ..."""
    return pieces.groupBy(*by).agg(*[F.coalesce(F.sum(F.get("sums", F.lit(i))), F.lit(0.0)).alias(f"s{i}") for i in range(n)])
