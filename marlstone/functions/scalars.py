"""Column functions of the measurement reports."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """part / whole, 0 where the whole is 0 or missing."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0.0)).otherwise(part * F.lit(scale) / whole)


def bits_per_pixel(size_bytes: Column, pixels: Column) -> Column:
    return F.round(size_bytes * 8 / pixels, 8)


def budget_bytes(bpp: Column, pixels: Column) -> Column:
    """Bytes of a bits-per-pixel budget, at least 1."""
    return F.greatest(F.round(bpp * pixels / 8).cast("long"), F.lit(1).cast("long"))


def percent_delta(value: Column, base: Column) -> Column:
    """Change against a base in percent; the base is held above 0."""
    return (value - base) / F.greatest(base, F.lit(1e-9)) * 100


def texture_class(variance: Column) -> Column:
    """smooth below 20, textured above 200, mid at and between them."""
    return F.when(variance < 20, "smooth").when(variance > 200, "textured").otherwise("mid")


def size_bucket(log2_size: Column) -> Column:
    return F.greatest(F.least(log2_size - 2, F.lit(4)), F.lit(0))


#: Upper edges of relative margins, each bucket open on the right.
MARGINS = [0.02, 0.05, 0.10, 0.25, 0.50]


def margin_bucket(margin: Column) -> Column:
    """Index of the first edge above the margin, the number of edges if none is."""
    out = F.lit(len(MARGINS))
    for k, edge in reversed(list(enumerate(MARGINS))):
        out = F.when(margin < edge, F.lit(k)).otherwise(out)
    return out


def angular_family(mode: Column) -> Column:
    """Direction family of an intra mode: H for 2-9, D for 10-25, V for 26-34, null for any other."""
    return F.when(mode.between(2, 9), "H").when(mode.between(10, 25), "D").when(mode.between(26, 34), "V")


def mode_name(mode: Column) -> Column:
    named = F.when(mode == 0, F.lit("PLANAR")).when(mode == 1, F.lit("DC")).when(mode.between(2, 34), F.concat(F.lit("ANG"), mode))
    return F.coalesce(named, F.concat(F.lit("?"), mode))


def rd_lambda(qp: Column) -> Column:
    return F.lit(0.57) * F.pow(F.lit(2.0), (qp - 12) / 3)


def sad_lambda(qp: Column) -> Column:
    return F.pow(F.lit(2.0), qp / 6 - 2)


def psnr(mse: Column, peak: float = 255.0) -> Column:
    """Decibels; infinite without error."""
    return F.when(mse <= 0, F.lit(float("inf"))).otherwise(F.lit(10.0) * F.log10(F.lit(peak * peak) / mse))


def blended_psnr(y: Column, cb: Column, cr: Column) -> Column:
    """Decibels of the planes' mean errors blended 6:1:1; luma alone if any is not finite."""
    finite = F.abs(y + cb + cr) < F.lit(float("inf"))
    error = lambda db: F.pow(F.lit(10.0), -db / 10)
    return F.when(finite, F.lit(-10.0) * F.log10((error(y) * 6 + error(cb) + error(cr)) / 8)).otherwise(y)


def blended_quality(ssim: Column, psnr_db: Column, weight: float) -> Column:
    loss = F.greatest(F.lit(1.0) - ssim, F.lit(1e-6))
    return F.lit(weight) * (F.lit(-10.0) * F.log10(loss)) + F.lit(1 - weight) * F.least(psnr_db, F.lit(99.0))


def importance_offset(importance_q8: Column) -> Column:
    """+8 for the least important cells to +1 for the most (importance 0 to 256)."""
    t = F.least(importance_q8, F.lit(256)) / F.lit(256.0)
    return F.round(F.lit(1.0) + (F.lit(1.0) - t) * 7).cast("int")


def variance_offset(variance: Column, mean_log: Column, strength: float, clamp: int, perceptual: bool = True) -> Column:
    """strength * (log2(1 + variance) - the picture's mean of it), rounded half away from zero and clamped.

    Busy cells are coarser if ``perceptual``, as detail hides the loss; else they are finer,
    where the error falls most for its bits.
    """
    raw = F.round(F.lit(strength if perceptual else -strength) * (F.log2(F.lit(1.0) + variance) - mean_log)).cast("int")
    return F.greatest(F.least(raw, F.lit(clamp)), F.lit(-clamp))


def interpolate_log_rate(rate: Column, r0: Column, q0: Column, r1: Column, q1: Column) -> Column:
    """Quality at a rate between two points, linear in the log of the rate, held at the ends; the midpoint if the rates are equal."""
    t = F.greatest(F.least((F.log(rate) - F.log(r0)) / (F.log(r1) - F.log(r0)), F.lit(1.0)), F.lit(0.0))
    return F.when(r0 == r1, (q0 + q1) / 2).otherwise(q0 + (q1 - q0) * t)


def luma_bt709(r: Column, g: Column, b: Column) -> Column:
    """Integer luma in the ten-thousandths form, rounded."""
    return F.floor((r * 2126 + g * 7152 + b * 722 + 5000) / 10000).cast("int")


def luma_bt601(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def entropy_q8(bins: Column) -> Column:
    """Shannon entropy of an array of counts, over the most that many bins can have, in 256ths."""
    total = F.aggregate(bins, F.lit(0.0), lambda a, x: a + x)
    h = F.aggregate(bins, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / total * F.log2(x / total)).otherwise(0.0))
    return F.when(total > 0, F.round(h / F.log2(F.size(bins)) * 256)).otherwise(F.lit(0)).cast("int")


def _without_suffix(path: Column) -> Column:
    """A path without the last suffix of its name; a name that only starts with a dot has none."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")


def safe_stem(path: Column) -> Column:
    """A file stem: the suffix goes, runs of other characters become one underscore."""
    return F.regexp_replace(_without_suffix(path), r"[^A-Za-z0-9_.-]+", "_")


def safe_stem_each(path: Column) -> Column:
    """A file stem: the suffix goes, each other character becomes an underscore; letters of any script stay."""
    return F.regexp_replace(_without_suffix(path), r"[^\p{L}\p{N}._-]", "_")


def list_items(text: Column) -> Column:
    """Items of a comma-separated text, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def memory_estimate(width: Column, height: Column, chroma: Column) -> Column:
    """Bytes to decode an image: planes of two bytes a sample, four bytes a pixel of output, an eighth for maps.

    ``chroma`` is 'gray', '420', '422' or '444'; odd sizes round chroma up.
    """
    px = (width * height).cast("long")
    half = lambda x: F.ceil(x / 2).cast("long")
    planes = F.when(chroma == "420", half(width) * half(height)).when(chroma == "422", half(width) * height).when(chroma == "444", px).otherwise(F.lit(0))
    return (px + planes * 2) * 2 + px * 4 + F.floor(px / 8).cast("long")


def transformed_size(width: Column, height: Column, transforms: Column) -> Column:
    """(w, h) after an ordered list of transforms; 'rot90' and 'rot270' swap."""
    start = F.struct(width.alias("w"), height.alias("h"))
    return F.aggregate(transforms, start, lambda a, t: F.when(t.isin("rot90", "rot270"), F.struct(a["h"].alias("w"), a["w"].alias("h"))).otherwise(a))


def chroma_qp(qp: Column) -> Column:
    """Chroma quantiser of a luma quantiser for 4:2:0: the same below 30, six less from 43."""
    table = {30: 29, 31: 30, 32: 31, 33: 32, 34: 33, 35: 33, 36: 34, 37: 34, 38: 35, 39: 35, 40: 36, 41: 36, 42: 37}  # fixed values
    out = F.when(qp < 30, qp)
    for k, v in table.items():
        out = out.when(qp == k, F.lit(v))
    return out.otherwise(qp - 6)


def dct_basis(n: int) -> list[list[float]]:
    """Rows of the orthonormal DCT-II of length n."""
    return [[math.sqrt((1 if k == 0 else 2) / n) * math.cos(math.pi * (2 * i + 1) * k / (2 * n)) for i in range(n)] for k in range(n)]
