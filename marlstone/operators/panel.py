"""Full-reference quality of pictures in pieces: structure over scales, visual information, masked block error.

Pieces hold two planes, the reference and the distorted picture.  Each scale of visual
information is one pass over tiles: a tile adds what it measures to the sums that travel with
it, and passes its samples on at half the size.  Similarity takes all scales in one pass,
small pictures whole and many as one.  Per picture only sums are left to be combined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cache, lru_cache
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.scalars import dct_basis
from marlstone.operators.tiles import PIECE, TILE, Region, Tile, as_piece, over_regions, over_tiles, summed

# Weights of the scales, from the finest on.
SCALE_WEIGHTS = [0.0448, 0.2856, 0.3001, 0.2363, 0.1333]
# The window's width and reach, and the least edge of a picture that it is laid over.
WINDOW, REACH, LEAST_EDGE = 1.5, 5, 11
#: Most samples of a picture that is worked off whole, and of pictures worked off as one; columns and lines that are smoothed at a time.
WHOLE, TOGETHER, BLOCK, STRIP = (4 * TILE) ** 2, 1 << 16, 48, 8
# Widths and reaches of the windows of the four scales of visual information, and the noise of the eye.
VISUAL_WINDOWS, EYE_NOISE = [(3.4, 14), (1.8, 7), (1.0, 4), (0.6, 2)], 2.0
# Sensitivity of the eye to the coefficients of an 8x8 block.
SENSITIVITY = [
    [1.608443, 2.339554, 2.573509, 1.608443, 1.072295, 0.643377, 0.504610, 0.421887],
    [2.144591, 2.144591, 1.838221, 1.354478, 0.989811, 0.443708, 0.428918, 0.467911],
    [1.838221, 1.979622, 1.608443, 1.072295, 0.643377, 0.451493, 0.372972, 0.459555],
    [1.838221, 1.513829, 1.169777, 0.887417, 0.504610, 0.295806, 0.321689, 0.415082],
    [1.429727, 1.169777, 0.695543, 0.459555, 0.378457, 0.236102, 0.249855, 0.334222],
    [1.072295, 0.735288, 0.467911, 0.402111, 0.317717, 0.247453, 0.227744, 0.279729],
    [0.525206, 0.402111, 0.329937, 0.295806, 0.249855, 0.212687, 0.214459, 0.254803],
    [0.357432, 0.279729, 0.270896, 0.262603, 0.229778, 0.257351, 0.249855, 0.259950],
]


@cache
def gaussian(width: float, reach: int) -> np.ndarray:
    """Weights of a Gaussian window from -reach to reach; they make up 1."""
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / width) ** 2)
    return k / k.sum()


@lru_cache(maxsize=64)
def _band(width: float, reach: int, size: int) -> np.ndarray:
    """The window as a matrix [place, sample]: a product with it smooths a line of ``size`` samples."""
    out = np.zeros((size - 2 * reach, size))
    for i in range(len(out)):
        out[i, i : i + 2 * reach + 1] = gaussian(width, reach)
    return out


def smoothed(samples: np.ndarray, width: float, reach: int) -> np.ndarray:
    """Samples [..., y, x] under a separable window; ``reach`` is lost on every side."""
    # Tiles are a few sizes; a long line is not multiplied out.
    if max(samples.shape[-2:]) <= 256 and min(samples.shape[-2:]) > 2 * reach:
        return _band(width, reach, samples.shape[-2]) @ samples @ _band(width, reach, samples.shape[-1]).T
    for axis in (-2, -1):
        windows = np.lib.stride_tricks.sliding_window_view(samples, 2 * reach + 1, axis=axis)
        samples = windows @ gaussian(width, reach)
    return samples


def moments(a: np.ndarray, b: np.ndarray, width: float, reach: int) -> tuple[np.ndarray, ...]:
    """Local means, variances and the covariance of two planes."""
    ma, mb, aa, bb, ab = smoothed(np.stack([a, b, a * a, b * b, a * b]), width, reach)
    return ma, mb, aa - ma * ma, bb - mb * mb, ab - ma * mb


def _mirrored(at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Places up to a window's reach beyond a line's ends, mirrored into it."""
    return np.where(at < 0, -1 - at, np.where(at < size, at, 2 * size - 1 - at))


@lru_cache(maxsize=256)
def _across(start: int, stop: int, size: int) -> list[tuple[int, int, np.ndarray]]:
    """Matrices that smooth the samples start ... stop - 1 of lines of ``size`` samples, ``BLOCK`` at a time, and which samples each takes."""
    out = []
    for first in range(start, stop, BLOCK):
        n = min(BLOCK, stop - first)
        places = _mirrored(np.arange(first - REACH, first + n + REACH), size)
        low, high = int(places.min()), int(places.max()) + 1
        weights = np.zeros((high - low, n))
        for i in range(n):
            np.add.at(weights[:, i], places[i : i + 2 * REACH + 1] - low, gaussian(WINDOW, REACH))
        out.append((low, high, weights))
    return out


class Scratch:
    """Arrays that are filled again and again, as fresh ones cost more than what is worked out in them."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = prod(shape)
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size)
        return self.held[name][:size].reshape(shape)


def _down(samples: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Samples [plane, y, x] under the window down their columns; its reach is lost at both ends."""
    planes, lines, columns = samples.shape
    n = lines - 2 * REACH
    out = scratch("down", planes, n, columns)
    whole = n // STRIP * STRIP
    if whole:
        plane, line, one = samples.strides
        strips = np.lib.stride_tricks.as_strided(samples, (planes, whole // STRIP, STRIP + 2 * REACH, columns), (plane, line * STRIP, line, one))
        target = np.lib.stride_tricks.as_strided(out, (planes, whole // STRIP, STRIP, columns), (out.strides[0], out.strides[1] * STRIP, *out.strides[1:]))
        np.matmul(_band(WINDOW, REACH, STRIP + 2 * REACH), strips, out=target)
    if whole < n:
        np.matmul(_band(WINDOW, REACH, n - whole + 2 * REACH), samples[:, whole:], out=out[:, whole:])
    return out


def _scales(w: int, h: int) -> int:
    """Scales that a picture has."""
    return next((s for s in range(len(SCALE_WEIGHTS)) if min(w, h) >> s < LEAST_EDGE), len(SCALE_WEIGHTS))


def _structure(peak: float):
    c1, c2, n = (0.01 * peak) ** 2, (0.03 * peak) ** 2, len(SCALE_WEIGHTS)
    scratch = Scratch()

    def kernel(regions: Sequence[Region]) -> list[np.ndarray]:
        """Sums of contrast at all scales, of structure at the last one, and samples, a region."""
        found = [np.zeros(2 * n + 1) for _ in regions]
        alike: dict[tuple, list[int]] = {}
        for i, r in enumerate(regions):
            alike.setdefault((r.w, r.left, r.x0, r.x1, r.planes.shape[2], _scales(r.w, r.h)), []).append(i)
        for (w, left, x0, x1, _, scales), members in alike.items():
            ends = np.cumsum([regions[i].planes[0].size for i in members])
            at = 0
            while at < len(members):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
                for i, sums in zip(members[at:to], stacked([regions[i] for i in members[at:to]], w, left, x0, x1, scales), strict=True):
                    found[i] = sums
                at = to
        return found

    def stacked(regions: list[Region], w: int, left: int, x0: int, x1: int, scales: int) -> np.ndarray:
        """The sums of regions of the same columns, which are worked off as one, one below the other."""
        sums = np.zeros((len(regions), 2 * n + 1))
        lines = np.array([r.planes.shape[1] for r in regions])
        samples = scratch("samples", 2, lines.sum(), regions[0].planes.shape[2])
        np.concatenate([r.planes for r in regions], axis=1, out=samples)
        top, y0, y1, h = (np.array([getattr(r, c) for r in regions]) for c in ("top", "y0", "y1", "h"))
        sums[:, 2 * n] = (x1 - x0) * (y1 - y0)
        for scale in range(scales):
            start, stop = x0 >> scale, x1 >> scale
            # A tile at the rim may have lost its last line or column to the halving.
            own = (y1 >> scale) - (y0 >> scale)
            some = own > 0
            if start == stop or not some.any():
                break
            # The lines that each region's window is laid over, beyond the picture mirrored.
            tall = (own + 2 * REACH)[some]
            begins = np.cumsum(tall) - tall
            place = np.arange(tall.sum()) - np.repeat(begins - (y0 >> scale)[some] + REACH, tall)
            place = _mirrored(place, np.repeat((h >> scale)[some], tall))
            place += np.repeat((np.cumsum(lines) - lines - (top >> scale))[some], tall)
            # Four planes are smoothed: both means, the sum of both squares, the product.
            first = len(place) < samples.shape[1]
            planes = scratch("planes", 4, min(len(place), samples.shape[1]), samples.shape[2])
            if first:
                samples.take(place, axis=1, out=planes[:2], mode="clip")
            else:
                planes[:2] = samples
            np.multiply(planes[:2], planes[:2], out=planes[2:])
            planes[2] += planes[3]
            np.multiply(planes[0], planes[1], out=planes[3])
            smooth = scratch("smooth", 4, planes.shape[1], stop - start)
            for i, (low, high, weights) in enumerate(_across(start, stop, w >> scale)):
                np.matmul(planes[..., low - (left >> scale) : high - (left >> scale)], weights, out=smooth[..., i * BLOCK : (i + 1) * BLOCK])
            if not first:
                smooth = smooth.take(place, axis=1, out=scratch("placed", 4, len(place), stop - start), mode="clip")
            ma, mb, squares, product = _down(smooth, scratch)
            both, means = np.multiply(ma, mb, out=scratch("both", *ma.shape)), np.multiply(ma, ma, out=scratch("means", *ma.shape))
            mb *= mb
            means += mb
            product -= both
            product *= 2
            product += c2
            squares -= means
            squares += c2
            product /= squares
            sums[some, scale] = _of_each(product, begins, own[some])
            if scale + 1 == scales:
                both *= 2
                both += c1
                means += c1
                product *= both
                product /= means
                sums[some, n + scale] = _of_each(product, begins, own[some])
            else:
                # Regions begin at even places; a last line or column without a partner goes.
                pairs = lines // 2
                first = np.arange(pairs.sum()) * 2 + np.repeat(np.cumsum(lines) - lines - 2 * (np.cumsum(pairs) - pairs), pairs)
                half = samples.take(first, axis=1, out=scratch("even", 2, len(first), samples.shape[2]), mode="clip")
                half += samples.take(first + 1, axis=1, out=scratch("odd", *half.shape), mode="clip")
                columns = half.shape[2] // 2 * 2
                samples = np.add(half[..., :columns:2], half[..., 1:columns:2], out=scratch(f"samples{scale % 2}", 2, len(first), columns // 2))
                samples /= 4
                lines = pairs
        return sums

    return kernel


def _of_each(values: np.ndarray, begins: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Sums of the ``lines`` lines from each of ``begins`` on."""
    return np.add.reduceat(np.append(values.sum(axis=1), 0.0), np.stack([begins, begins + lines], axis=1).ravel())[::2]


def _size(name: str, scale: int) -> Column:
    """Samples along an edge after ``scale`` halvings that drop what is left over."""
    return F.floor(F.col(name) / F.lit(1 << scale))


def multi_scale_similarity(pieces: DataFrame, by: Sequence[str], peak: float = 255.0, tile: int = 4 * TILE, cut: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """by..., scales, ms_ssim (0 to 1) and ms_ssim_db (infinite at 1) per picture.

    Contrast and structure of every scale, and brightness of the last, under a Gaussian
    window; five scales, fewer when an edge falls below eleven samples, the weights of those
    left made to sum to 1.  A picture that is too small for one scale has nulls.  All scales
    of a picture of one piece are worked off where it lies; a larger one is cut into tiles,
    with what all scales need around them.  ``tile`` is a multiple of 16; ``cut`` as for
    ``over_regions``.
    """
    n = len(SCALE_WEIGHTS)
    found = over_regions(pieces, by, tile, REACH << (n - 1), WHOLE, _structure(peak), cut)
    sums = [F.coalesce(F.sum(F.get("sums", F.lit(i))), F.lit(0.0)).alias(f"s{i}") for i in range(2 * n + 1)]
    rows = found.groupBy(*by).agg(F.max("w").alias("w"), F.max("h").alias("h"), *sums)
    scales = sum((F.least(_size("w", s), _size("h", s)) >= LEAST_EDGE).cast("int") for s in range(n))
    # Copies of a picture under one key count as one.
    copies = F.greatest(F.col(f"s{2 * n}") / (F.col("w") * F.col("h")), F.lit(1.0))
    rows = rows.withColumn("scales", scales)
    value = F.lit(None).cast("double")
    for k in range(1, n + 1):
        whole = sum(SCALE_WEIGHTS[:k])
        product = F.lit(1.0)
        for s in range(k):
            mean = F.col(f"s{s if s < k - 1 else n + s}") / (_size("w", s) * _size("h", s) * copies)
            product = product * F.pow(F.greatest(mean, F.lit(1e-8)), F.lit(SCALE_WEIGHTS[s] / whole))
        value = F.when(F.col("scales") == k, F.least(F.greatest(product, F.lit(0.0)), F.lit(1.0))).otherwise(value)
    rows = rows.withColumn("ms_ssim", value)
    db = F.when(F.col("ms_ssim") < 1, F.lit(-10.0) * F.log10(F.lit(1.0) - F.col("ms_ssim"))).when(F.col("ms_ssim") >= 1, F.lit(float("inf")))
    return rows.select(*by, "scales", "ms_ssim", db.alias("ms_ssim_db"))


def _information(scale: int):
    width, reach = VISUAL_WINDOWS[scale]
    tiny = 1e-10

    def kernel(t: Tile) -> dict:
        own = t.planes[:, reach:-reach, reach:-reach]
        sums = t.sums.copy() if len(t.sums) else np.zeros(2)
        if min(t.w, t.h) < 2:
            return as_piece(own, t.x0, t.y0, t.w, t.h, sums)
        _, _, va, vb, cov = moments(*t.planes, width, reach)
        va, vb = va.clip(0), vb.clip(0)
        gain = cov / (va + tiny)
        rest = vb - gain * cov
        bare, blank = va < tiny, vb < tiny
        rest = np.where(blank, 0.0, np.where(bare, vb, rest)).clip(tiny)
        gain = np.where(bare | blank, 0.0, gain)
        va = np.where(bare, 0.0, va)
        sums += [np.log10(1 + gain * gain * va / (rest + EYE_NOISE)).sum(), np.log10(1 + va / EYE_NOISE).sum()]
        if scale + 1 == len(VISUAL_WINDOWS):
            return as_piece(own, t.x0, t.y0, t.w, t.h, sums)
        thin, near = VISUAL_WINDOWS[scale + 1]
        lost = reach - near
        half = smoothed(t.planes[:, lost : t.planes.shape[1] - lost, lost : t.planes.shape[2] - lost], thin, near)[:, ::2, ::2]
        return as_piece(half, t.x0 // 2, t.y0 // 2, -(-t.w // 2), -(-t.h // 2), sums)

    return kernel


def visual_information(pieces: DataFrame, by: Sequence[str], tile: int = TILE) -> DataFrame:
    """by..., vif per picture: the information that is left of the reference over what it had, summed over four scales.

    A scale with an edge of one sample ends it.  Null where the reference has none, as in a
    flat picture.  ``tile`` is a multiple of 8.
    """
    for scale, (_, reach) in enumerate(VISUAL_WINDOWS):
        pieces = over_tiles(pieces, by, tile >> scale, reach, "mirror", _information(scale), PIECE)
    return summed(pieces, by, 2).select(*by, F.when(F.col("s1") > 0, F.col("s0") / F.col("s1")).alias("vif"))


def _masked(t: Tile) -> dict:
    # Whole blocks only: what is left over at the picture's right and lower edge has no part.
    h, w = (min(n, whole // 8 * 8 - start) // 8 for n, whole, start in ((t.planes.shape[1], t.h, t.y0), (t.planes.shape[2], t.w, t.x0)))
    if h < 1 or w < 1:
        return {"error": [], "samples": []}
    d, weight = np.array(dct_basis(8)), np.array(SENSITIVITY)
    blocks = t.planes[:, : 8 * h, : 8 * w].reshape(2, h, 8, w, 8).transpose(0, 1, 3, 2, 4)
    a, b = d @ blocks @ d.T
    energy = [((x * weight) ** 2).sum(axis=(2, 3)) - (x[..., 0, 0] * weight[0, 0]) ** 2 for x in (a, b)]
    hidden = np.sqrt(np.maximum(*energy).clip(0) / 64) / 16
    differ = np.abs(a - b)
    seen = (differ - hidden[..., None, None]).clip(0)
    seen[..., 0, 0] = differ[..., 0, 0]
    return {"error": [float(((seen * weight) ** 2).sum())], "samples": [64 * h * w]}


def masked_block_error(pieces: DataFrame, by: Sequence[str], peak: float = 255.0, tile: int = TILE) -> DataFrame:
    """by..., psnr_hvs_m per picture: decibels of the error of 8x8 blocks as the eye weighs it.

    Coefficients differ by what goes beyond the block's own masking, the mean by all;
    both are weighted by sensitivity.  Infinite without error; null for a picture without
    a whole block.  ``tile`` is a multiple of 8.
    """
    rows = over_tiles(pieces, by, tile, 0, "repeat", _masked, "error double, samples long")
    total = rows.groupBy(*by).agg(F.sum("error").alias("error"), F.sum("samples").alias("samples"))
    keys = pieces.select(*by).distinct()
    found = total.select(*[F.col(c).alias(f"_by_{c}") for c in by], "error", "samples")
    out = keys.join(found, [keys[c].eqNullSafe(F.col(f"_by_{c}")) for c in by], "left")
    mean = F.col("error") / F.col("samples")
    db = F.when(mean <= 0, F.lit(float("inf"))).otherwise(F.lit(10.0) * F.log10(F.lit(peak * peak) / mean))
    return out.select(*by, db.alias("psnr_hvs_m"))
