"""What a preanalysis measures in square cells of a picture, from pieces (``tiles``)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import offsets
from marlstone.functions.scalars import entropy_q8
from marlstone.operators.tiles import TILE, Tile, over_tiles
from marlstone.session import written

#: Edges of the cells: those that are classified, and the fine ones.
CELL, FINE_CELL = 32, 16
# Gradients (8 bit) above which a sample is an edge, and below which it is flat or weak.
EDGE, FLAT, WEAK = 48, 12, 24
#: Chroma samples in a line and in a column for two of luma, by format.
CHROMA = {"gray": (0, 0), "420": (1, 1), "422": (1, 2), "444": (2, 2)}


def _by_cell(t: Tile, values: np.ndarray, width: int, height: int) -> np.ndarray:
    """Sums of [..., y, x] in the cells of a tile, which begin where it does."""
    ys, xs = np.arange(0, values.shape[-2], height), np.arange(0, values.shape[-1], width)
    return np.add.reduceat(np.add.reduceat(values, ys, axis=-2), xs, axis=-1)


def _local(cell: int, depth: int):
    def kernel(t: Tile) -> dict:
        p = t.planes[0].astype(np.int64) >> (depth - 8)
        around = {(j, i): p[1 + j : p.shape[0] - 1 + j, 1 + i : p.shape[1] - 1 + i] for j in (-1, 0, 1) for i in (-1, 0, 1)}
        c = around[0, 0]
        gx = sum(k * (around[j, 1] - around[j, -1]) for j, k in ((-1, 1), (0, 2), (1, 1)))
        gy = sum(k * (around[1, i] - around[-1, i]) for i, k in ((-1, 1), (0, 2), (1, 1)))
        ax, ay = np.abs(gx), np.abs(gy)
        edge, weak = ax + ay > EDGE, ax + ay < WEAK
        across, along = ax >= 2 * ay, ay >= 2 * ax
        slant = (gx > 0) == (gy > 0)
        bins = [edge & across, edge & ~across & along, edge & ~across & ~along & slant, edge & ~across & ~along & ~slant]
        # What a sample stands out from the mean of the nine, where nothing but noise is.
        residual = np.abs(c - sum(around.values()) // 9) * weak
        layers = np.stack([np.ones_like(c), c, c * c, edge, ax + ay < FLAT, weak, residual, *bins]).astype(np.int64)
        sums = _by_cell(t, layers, cell, cell)
        cy, cx = np.mgrid[0 : sums.shape[1], 0 : sums.shape[2]]
        names = ["n", "total", "squares", "edges", "flats", "weaks", "residual", "d0", "d1", "d2", "d3"]
        places = {"cx": (cx + t.x0 // cell).ravel(), "cy": (cy + t.y0 // cell).ravel()}
        return places | {name: layer.ravel() for name, layer in zip(names, sums, strict=True)}

    return kernel


def _plane(width: int, height: int, depth: int):
    def kernel(t: Tile) -> dict:
        p = t.planes.astype(np.int64) >> (depth - 8)
        count = _by_cell(t, np.ones(p.shape[1:], np.int64), width, height)
        total, squares = _by_cell(t, p, width, height), _by_cell(t, p * p, width, height)
        cy, cx = np.mgrid[0 : count.shape[0], 0 : count.shape[1]]
        out = {"cx": (cx + t.x0 // width).ravel(), "cy": (cy + t.y0 // height).ravel(), "n": count.ravel()}
        return out | {f"{name}{k}": values[k].ravel() for k in range(len(p)) for name, values in (("total", total), ("squares", squares))}

    return kernel


def _mean_and_variance(n: str, total: str, squares: str) -> tuple[Column, Column]:
    """In whole numbers: the mean, and mean of squares - square of the mean, 0 at least."""
    mean = F.call_function("div", F.col(total), F.col(n))
    return mean, F.greatest(F.call_function("div", F.col(squares), F.col(n)) - mean * mean, F.lit(0))


def _tile_of(tile: int, *edges: int) -> int:
    """A tile edge that every cell edge divides."""
    step = int(np.lcm.reduce([max(1, e) for e in edges]))
    return max(step, tile // step * step)


def chroma_cells(chroma: DataFrame, by: Sequence[str], fmt: str, cell: int = CELL, depth: int = 8, tile: int = TILE) -> DataFrame:
    """by..., cx, cy, chroma (both planes' variances added up, 65535 at most), cb_mean, cr_mean, per cell of luma.

    ``chroma`` are pieces of the planes Cb and Cr in their own size; ``fmt`` is 420, 422 or 444.
    """
    width, height = (cell * k // 2 for k in CHROMA[fmt])
    rows = over_tiles(chroma, by, _tile_of(tile, width, height), 0, "repeat", _plane(width, height, depth), "cx int, cy int, n long, total0 long, squares0 long, total1 long, squares1 long")
    (cb, vb), (cr, vr) = (_mean_and_variance("n", f"total{k}", f"squares{k}") for k in (0, 1))
    return rows.select(*by, "cx", "cy", F.least(vb + vr, F.lit(65_535)).alias("chroma"), cb.alias("cb_mean"), cr.alias("cr_mean"))


def local_features(luma: DataFrame, by: Sequence[str], chroma: DataFrame | None = None, fmt: str = "gray", cell: int = CELL, depth: int = 8, tile: int = TILE) -> DataFrame:
    """Per cell (by..., cx, cy): what stands in it, and its region class.

    mean, variance (whole numbers, 8 bit); edge and flat (samples with a strong or hardly a
    gradient, in 256ths); noise (mean residual where the gradient is weak); entropy,
    dominance and aligned (of the edges' four directions, in 256ths); chroma, cb_mean and
    cr_mean (0, 128 and 128 without chroma planes; 0 for a cell that they do not reach).
    Gradients see the neighbouring cells; at the picture's edge the last sample repeats.
    """
    sums = "cx int, cy int, n long, total long, squares long, edges long, flats long, weaks long, residual long, d0 long, d1 long, d2 long, d3 long"
    rows = over_tiles(luma, by, _tile_of(tile, cell), 1, "repeat", _local(cell, depth), sums)
    div = lambda a, b: F.call_function("div", a, b)
    mean, variance = _mean_and_variance("n", "total", "squares")
    bins = [F.col(f"d{k}") for k in range(4)]
    edges = F.greatest(sum(bins[1:], bins[0]), F.lit(1))
    rows = rows.select(
        *by, "cx", "cy", mean.alias("mean"), variance.alias("variance"), div(F.col("edges") * 256, F.col("n")).alias("edge"), div(F.col("flats") * 256, F.col("n")).alias("flat"),
        F.when(F.col("weaks") > 0, div(F.col("residual"), F.col("weaks"))).otherwise(F.lit(0)).alias("noise"), entropy_q8(F.array(*bins)).cast("long").alias("entropy"),
        div(F.greatest(*bins) * 256, edges).alias("dominance"), div((bins[0] + bins[1]) * 256, edges).alias("aligned"),
    )
    if chroma is None:
        rows = rows.withColumns({"chroma": F.lit(0).cast("long"), "cb_mean": F.lit(128).cast("long"), "cr_mean": F.lit(128).cast("long")})
    else:
        found = chroma_cells(chroma, by, fmt, cell, depth, tile)
        rows = _beside(rows, found, by, ["chroma", "cb_mean", "cr_mean"])
    names = ("variance", "edge", "entropy", "dominance", "aligned", "noise", "chroma")
    return rows.withColumn("region", offsets.region_class(*map(F.col, names)))


def _beside(rows: DataFrame, found: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``rows`` with the values of the same cell, 0 where there is none."""
    keys = [*by, "cx", "cy"]
    found = found.select(*[F.col(c).alias(f"_by_{c}") for c in keys], *values)
    joined = rows.join(found, [rows[c].eqNullSafe(F.col(f"_by_{c}")) for c in keys], "left")
    return joined.select(*[rows[c] for c in rows.columns], *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def fine_features(luma: DataFrame, by: Sequence[str], chroma: DataFrame | None = None, fmt: str = "gray", cell: int = FINE_CELL, depth: int = 8, tile: int = TILE) -> DataFrame:
    """Per fine cell (by..., cx, cy): variance and chroma only, as finer offsets need them."""
    rows = over_tiles(luma, by, _tile_of(tile, cell), 0, "repeat", _plane(cell, cell, depth), "cx int, cy int, n long, total0 long, squares0 long")
    rows = rows.select(*by, "cx", "cy", _mean_and_variance("n", "total0", "squares0")[1].alias("variance"))
    if chroma is None:
        return rows.withColumn("chroma", F.lit(0).cast("long"))
    return _beside(rows, chroma_cells(chroma, by, fmt, cell, depth, tile), by, ["chroma"])


def with_context(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds how far a cell's means lie from its picture's and its neighbours' (global_contrast, surround, in 256ths) and its importance.

    Distances of the three means are added up, doubled and held at 256.  Picture means are means
    of the cells; a cell without neighbours has no surround.
    """
    # Read three times: for pictures, for neighbours and for itself.
    cells = written(cells, "cells")
    means = ["mean", "cb_mean", "cr_mean"]
    div = lambda a, b: F.call_function("div", a, b)
    count = F.count(F.lit(1))
    frames = cells.groupBy(*by).agg(*[div(F.sum(m), count).alias(f"_of_{m}") for m in means]).select(*[F.col(c).alias(f"_by_{c}") for c in by], *[f"_of_{m}" for m in means])
    steps = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    sent = cells.select(*by, "cx", "cy", *means, F.explode(steps).alias("s"))
    # Each cell sends its means to its neighbours' places.
    near = sent.groupBy(*by, (F.col("cx") + F.col("s.dx")).alias("cx"), (F.col("cy") + F.col("s.dy")).alias("cy")).agg(*[div(F.sum(m), count).alias(f"_near_{m}") for m in means])
    keys = [*by, "cx", "cy"]
    near = near.select(*[F.col(c).alias(f"_at_{c}") for c in keys], *[f"_near_{m}" for m in means])
    rows = cells.join(frames, [cells[c].eqNullSafe(F.col(f"_by_{c}")) for c in by]).join(near, [cells[c].eqNullSafe(F.col(f"_at_{c}")) for c in keys], "left")
    apart = lambda other: F.least(sum(F.abs(F.col(m) - F.col(f"{other}{m}")) for m in means) * 2, F.lit(256))
    rows = rows.select(*[cells[c] for c in cells.columns], apart("_of_").alias("global_contrast"), F.coalesce(apart("_near_"), F.lit(0)).alias("surround"))
    return rows.withColumn("importance", offsets.importance(*[F.col(c) for c in ("edge", "global_contrast", "surround", "noise", "region")]))
