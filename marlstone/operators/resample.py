"""Pictures in pieces made smaller, larger, or put together from others: a task holds one tile of the result.

Each tile of the result names the window of source samples that it needs; pieces send it
their part of that window, and the tile weighs them.  Samples beyond the edge repeat the
last one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.tiles import PIECE, TILE, _batch, _FIELDS, by_tile, decoded, encoded, sliced

# Taps that halve chroma between two samples, and that double it, before and behind a sample.
HALVING = np.array([2, -4, -8, 17, 57, 57, 17, -8, -4, 2])
DOUBLING = np.array([-1, 4, -10, 57, 18, -6, 2])
#: Zero crossings of the resizing window on either side.
LOBES = 3

#: From a range of places in the result, the source's and the result's size: the first and last source place, before clamping.
Window = Callable[[int, int, int, int], tuple[int, int]]
#: From source samples [plane, y, x] of a window, its start (x, y), the tile's places (xs, ys) and both sizes: the tile.
Kernel = Callable[[np.ndarray, tuple[int, int], tuple[np.ndarray, np.ndarray], tuple[int, int], tuple[int, int]], np.ndarray]


def _held(window: tuple[int, int], size: int) -> tuple[int, int]:
    return min(max(window[0], 0), size - 1), min(max(window[1], 0), size - 1)


def _resampled(pieces: DataFrame, by: Sequence[str], size: tuple[Column, Column], windows: tuple[Window, Window], kernel: Kernel, tile: int) -> DataFrame:
    """Pieces of the results, one a tile; ``size`` is theirs, from columns of ``pieces``."""
    by = list(by)
    types = dict(pieces.dtypes)
    keys = ", ".join(f"`{c}` {types[c]}" for c in by)
    extra = [("tx", pa.int32()), ("ty", pa.int32()), ("ow", pa.int32()), ("oh", pa.int32())]
    sized = pieces.select(*by, *(n for n, _ in _FIELDS), size[0].cast("int").alias("ow"), size[1].cast("int").alias("oh")).where("ow > 0 AND oh > 0")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "data"):
            at, out = [], []
            rows = zip(*(batch.column(n).to_pylist() for n in [*(n for n, _ in _FIELDS), "ow", "oh"]), strict=True)
            for i, (w, h, px, py, pw, ph, planes, data, _, ow, oh) in enumerate(rows):
                if not data:
                    continue
                full = decoded(data, planes, ph, pw)
                spans = []
                for source, start, count, result, window in ((w, px, pw, ow, windows[0]), (h, py, ph, oh, windows[1])):
                    needed = ((t, *_held(window(t * tile, min(result, (t + 1) * tile) - 1, source, result), source)) for t in range(-(-result // tile)))
                    spans.append([(t, max(lo, start), min(hi + 1, start + count)) for t, lo, hi in needed if hi >= start and lo < start + count])
                for ty, y0, y1 in spans[1]:
                    for tx, x0, x1 in spans[0]:
                        part = np.ascontiguousarray(full[:, y0 - py : y1 - py, x0 - px : x1 - px])
                        at.append(i)
                        out.append((w, h, x0, y0, x1 - x0, y1 - y0, planes, part.tobytes(), None, tx, ty, ow, oh))
            yield _batch(batch.select(by).take(pa.array(at, pa.int64())), by, out, extra)

    def made(rows: list[dict], tx: int, ty: int) -> dict:
        first = rows[0]
        xs = np.arange(tx * tile, min(first["ow"], (tx + 1) * tile))
        ys = np.arange(ty * tile, min(first["oh"], (ty + 1) * tile))
        (x0, x1), (y0, y1) = (_held(f(int(p[0]), int(p[-1]), n, m), n) for f, p, n, m in ((windows[0], xs, first["w"], first["ow"]), (windows[1], ys, first["h"], first["oh"])))
        source = np.zeros((first["planes"], y1 - y0 + 1, x1 - x0 + 1))
        for r in rows:
            px, py, pw, ph = (r[c] for c in ("px", "py", "pw", "ph"))
            source[:, py - y0 : py - y0 + ph, px - x0 : px - x0 + pw] = decoded(r["data"], r["planes"], ph, pw)
        result = kernel(source, (x0, y0), (xs, ys), (first["w"], first["h"]), (first["ow"], first["oh"]))
        row = (first["ow"], first["oh"], int(xs[0]), int(ys[0]), len(xs), len(ys), len(result), encoded(result), [])
        return {n: [v] for (n, _), v in zip(_FIELDS, row, strict=True)}

    sent = sized.mapInArrow(cut, ", ".join([keys, PIECE, "tx int, ty int, ow int, oh int"]))
    return by_tile(sent, by, made, PIECE)


def _taps(source: np.ndarray, axis: int, at: np.ndarray, start: int, size: int, taps: np.ndarray) -> np.ndarray:
    """Sums of samples along an axis: ``taps`` [place or 1, k] for source places ``at`` [place, k], held inside."""
    places = at.clip(0, size - 1) - start
    moved = np.moveaxis(source, axis, -1)[..., places]
    return np.moveaxis((moved * taps).sum(axis=-1), -1, axis)


def _halved(fmt: str, depth: int) -> Kernel:
    top = (1 << depth) - 1
    reach = np.arange(-4, 6)

    def kernel(source, start, places, size, _):
        s = source.astype(np.int64)
        across = _taps(s, 2, 2 * places[0][:, None] + reach, start[0], size[0], HALVING)
        if fmt == "422":
            return ((across + 64) >> 7).clip(0, top)
        # Lines keep seven bits more until columns are done.
        lines = (across + (1 << (depth - 8))) >> (depth - 7)
        down = _taps(lines, 1, 2 * places[1][:, None] + reach, start[1], size[1], HALVING)
        return ((down + (1 << (20 - depth))) >> (21 - depth)).clip(0, top)

    return kernel


def halve_chroma(pieces: DataFrame, by: Sequence[str], fmt: str = "420", depth: int = 8, tile: int = TILE) -> DataFrame:
    """Chroma planes of half the width (422), and height (420), rounded up: ten taps between two samples."""
    two: Window = lambda a, b, *_: (2 * a - 4, 2 * b + 5)
    same: Window = lambda a, b, *_: (a, b)
    half = lambda c: F.floor((F.col(c) + 1) / 2)
    return _resampled(pieces, by, (half("w"), half("h") if fmt == "420" else F.col("h")), (two, two if fmt == "420" else same), _halved(fmt, depth), tile)


def _doubled(fmt: str, depth: int) -> Kernel:
    reach = np.arange(-3, 4)
    taps = lambda p: np.where(p[:, None] % 2 == 0, DOUBLING[::-1], DOUBLING)

    def kernel(source, start, places, size, _):
        s = source.astype(np.int64) >> (depth - 8)
        xs, ys = places
        if fmt == "420":
            s = _taps(s, 1, (ys >> 1)[:, None] + reach, start[1], size[1], taps(ys))
        else:
            s = s[:, ys.clip(0, size[1] - 1) - start[1]]
        across = _taps(s, 2, (xs >> 1)[:, None] + reach, start[0], size[0], taps(xs))
        return ((across + 2048) >> 12 if fmt == "420" else (across + 32) >> 6).clip(0, 255)

    return kernel


def double_chroma(pieces: DataFrame, by: Sequence[str], width: Column, height: Column, fmt: str = "420", depth: int = 8, tile: int = TILE) -> DataFrame:
    """Chroma planes in the size of luma and 8 bit: seven taps, mirrored for even and odd places."""
    two: Window = lambda a, b, *_: ((a >> 1) - 3, (b >> 1) + 3)
    same: Window = lambda a, b, *_: (a, b)
    return _resampled(pieces, by, (width, height), (two, two if fmt == "420" else same), _doubled(fmt, depth), tile)


def _wide(a: int, b: int, source: int, result: int) -> tuple[int, int]:
    step = source / result
    reach = LOBES * max(step, 1.0)
    return int(np.floor((a + 0.5) * step - 0.5 - reach)), int(np.ceil((b + 0.5) * step - 0.5 + reach))


def window_weights(places: np.ndarray, source: int, result: int, start: int, count: int) -> np.ndarray:
    """Weights [place, source sample from ``start`` on] of a windowed sinc that is as wide as the picture shrinks; each place's make up 1."""
    step = source / result
    wide = max(step, 1.0)
    out = np.zeros((len(places), count))
    for i, p in enumerate(places):
        centre = (p + 0.5) * step - 0.5
        at = np.arange(np.floor(centre - LOBES * wide), np.ceil(centre + LOBES * wide) + 1)
        x = (centre - at) / wide
        weight = np.where(np.abs(x) < LOBES, np.sinc(x) * np.sinc(x / LOBES), 0.0)
        np.add.at(out[i], at.clip(0, source - 1).astype(np.int64) - start, weight / weight.sum())
    return out


@lru_cache(maxsize=256)
def _kept_weights(first: int, places: int, source: int, result: int, start: int, count: int) -> np.ndarray:
    return window_weights(np.arange(first, first + places), source, result, start, count)


def _weights(places: np.ndarray, source: int, result: int, start: int, count: int) -> np.ndarray:
    """``window_weights`` of places in a row; small ones are kept, as pictures of one size share them."""
    if len(places) * count > 1 << 14:
        return window_weights(places, source, result, start, count)
    return _kept_weights(int(places[0]), len(places), source, result, start, count)


def resize_to_fit(pieces: DataFrame, by: Sequence[str], most_edge: int, depth: int = 8, tile: int = TILE) -> DataFrame:
    """Pictures whose longer edge is ``most_edge`` at most; those within it stay as they are, in their pieces."""
    top = float((1 << depth) - 1)

    def kernel(source, start, places, size, result):
        columns = _weights(places[0], size[0], result[0], start[0], source.shape[2])
        rows = _weights(places[1], size[1], result[1], start[1], source.shape[1])
        value = rows @ (source @ columns.T)
        return np.floor(value + 0.5).clip(0, top)

    longest = F.greatest("w", "h")
    new = lambda c: F.greatest(F.round(F.col(c) * (F.lit(float(most_edge)) / longest)), F.lit(1.0))
    fits = longest <= most_edge
    names = [*by, *(n for n, _ in _FIELDS)]
    return pieces.where(fits).select(*names).unionByName(_resampled(pieces.where(~fits), by, (new("w"), new("h")), (_wide, _wide), kernel, tile))


def compose(canvases: DataFrame, layers: DataFrame, by: Sequence[str], tile: int = TILE) -> DataFrame:
    """Pieces of canvases (by..., cw, ch, fill: a value a plane), with layers laid over them.

    ``layers`` are pieces with by..., z, and x and y, where the picture's corner goes, 0 at
    least.  What goes beyond the canvas is cut off; where layers overlap the one with the
    largest z is seen.  A canvas without layers is all fill; layers without a canvas go.
    """
    by = list(by)
    types = dict(layers.dtypes)
    keys = ", ".join(f"`{c}` {types[c]}" for c in by)
    sizes = canvases.select(*[F.col(c).alias(f"_by_{c}") for c in by], "cw", "ch", "fill")
    placed = layers.join(sizes, [layers[c].eqNullSafe(F.col(f"_by_{c}")) for c in by])
    # A piece goes to each tile of the canvas that it covers.
    px, py = F.col("px") + F.greatest("x", F.lit(0)), F.col("py") + F.greatest("y", F.lit(0))
    placed = placed.select(*[layers[c] for c in by], "z", px.alias("px"), py.alias("py"), "pw", "ph", "planes", "data", "cw", "ch", "fill").where("px < cw AND py < ch AND pw > 0 AND ph > 0")
    across = F.sequence(F.floor(F.col("px") / tile), F.floor((F.least(F.col("px") + F.col("pw"), F.col("cw")) - 1) / tile))
    down = F.sequence(F.floor(F.col("py") / tile), F.floor((F.least(F.col("py") + F.col("ph"), F.col("ch")) - 1) / tile))
    parts = placed.withColumn("tx", F.explode(across)).withColumn("ty", F.explode(down))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "data"):
            rows = batch.to_pydict()
            for i in range(batch.num_rows):
                px, py, pw, ph, tx, ty, cw, ch = (rows[c][i] for c in ("px", "py", "pw", "ph", "tx", "ty", "cw", "ch"))
                x0, y0, x1, y1 = max(px, tx * tile), max(py, ty * tile), min(px + pw, (tx + 1) * tile, cw), min(py + ph, (ty + 1) * tile, ch)
                full = decoded(rows["data"][i], rows["planes"][i], ph, pw)
                rows["data"][i] = np.ascontiguousarray(full[:, y0 - py : y1 - py, x0 - px : x1 - px]).tobytes()
                rows["px"][i], rows["py"][i], rows["pw"][i], rows["ph"][i] = x0, y0, x1 - x0, y1 - y0
            yield pa.record_batch([pa.array(rows[f.name], f.type) for f in batch.schema], schema=batch.schema)

    fields = {"z": types["z"], "px": "int", "py": "int", "pw": "int", "ph": "int", "planes": "int", "data": "binary", "cw": "int", "ch": "int", "fill": "array<double>", "tx": "long", "ty": "long"}
    cast = lambda df: df.select(*by, *[F.col(c).cast(t).alias(c) for c, t in fields.items()])
    parts = cast(parts).mapInArrow(cut, ", ".join([keys, *(f"{c} {t}" for c, t in fields.items())]))
    empty = {c: F.lit(None) for c in ("z", "px", "py", "pw", "ph", "planes", "data")}
    whole = lambda n: F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / tile)))
    base = canvases.where("cw > 0 AND ch > 0").select(*by, "cw", "ch", "fill").withColumns(empty).withColumn("tx", whole("cw")).withColumn("ty", whole("ch"))

    def pasted(rows: pa.Table) -> pa.Table:
        tx, ty, cw, ch, fill = (rows.column(c)[0].as_py() for c in ("tx", "ty", "cw", "ch", "fill"))
        x0, y0 = tx * tile, ty * tile
        out = np.empty((len(fill), min(ch, y0 + tile) - y0, min(cw, x0 + tile) - x0))
        out[:] = np.array(fill)[:, None, None]
        order = [i for i, z in enumerate(rows.column("z").to_pylist()) if z is not None]
        rows_of = rows.to_pydict()
        for i in sorted(order, key=lambda i: rows_of["z"][i]):
            px, py, pw, ph = (rows_of[c][i] for c in ("px", "py", "pw", "ph"))
            out[:, py - y0 : py - y0 + ph, px - x0 : px - x0 + pw] = decoded(rows_of["data"][i], len(fill), ph, pw)
        row = (cw, ch, x0, y0, out.shape[2], out.shape[1], len(fill), encoded(out), [])
        own = pa.RecordBatch.from_arrays([rows.column(c).combine_chunks().slice(0, 1) for c in by], by)
        return pa.Table.from_batches([_batch(own, by, [row])])

    return parts.unionByName(cast(base)).groupBy(*by, "tx", "ty").applyInArrow(pasted, f"{keys}, {PIECE}")


def samples_of(pieces: DataFrame, by: Sequence[str], planes: int = 1) -> DataFrame:
    """by..., x, y, v0, v1, ...: a row for every sample."""
    by = list(by)
    types = dict(pieces.dtypes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "data", size=1 << 18):
            at, xs, ys, samples = [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("px", "py", "pw", "ph", "planes", "data"))
            for i, (px, py, pw, ph, n, data) in enumerate(zip(*columns, strict=True)):
                if data:
                    y, x = np.mgrid[py : py + ph, px : px + pw]
                    at.append(np.full(pw * ph, i))
                    xs.append(x.ravel())
                    ys.append(y.ravel())
                    samples.append(decoded(data, n, ph, pw).reshape(n, -1)[:planes].astype(np.float64))
            if at:
                keys, values = batch.select(by).take(pa.array(np.concatenate(at))), np.concatenate(samples, axis=1)
                yield pa.record_batch([*keys.columns, pa.array(np.concatenate(xs), pa.int32()), pa.array(np.concatenate(ys), pa.int32()), *(pa.array(values[k]) for k in range(planes))], [*by, "x", "y", *(f"v{k}" for k in range(planes))])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in by), "x int, y int", *(f"v{k} double" for k in range(planes))])
    return pieces.select(*by, "px", "py", "pw", "ph", "planes", "data").mapInArrow(rows, schema)
