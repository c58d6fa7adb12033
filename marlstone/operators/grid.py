"""Cells of a picture: local statistics, neighbours, overlaps, and quantiser-offset maps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import offsets
from marlstone.functions.scalars import variance_offset
from marlstone.operators.keys import join_on


def cell_statistics(values: Column) -> dict[str, Column]:
    """Whole-number mean and variance of an array of samples: sum of squares / n - mean squared."""
    n = F.size(values)
    total = F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)
    squares = F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x * x)
    mean = F.call_function("div", total, n)
    return {"mean": mean, "variance": F.call_function("div", squares, n) - mean * mean}


def frame_statistics(cells: DataFrame, by: Sequence[str], variance: str) -> DataFrame:
    """Per picture: least, mean and greatest log2(1 + variance)."""
    v = F.log2(F.lit(1.0) + F.col(variance))
    return cells.groupBy(*by).agg(F.round(F.min(v), 6).alias("min_log"), F.round(F.avg(v), 6).alias("mean_log"), F.round(F.max(v), 6).alias("max_log"), F.count(F.lit(1)).alias("cells"))


def _with_frame(cells: DataFrame, by: Sequence[str], **statistics: Column) -> DataFrame:
    """``cells`` with statistics of their picture, aggregated before they are joined back."""
    frames = cells.groupBy(*by).agg(*[c.alias(n) for n, c in statistics.items()])
    frames = frames.select(*[F.col(c).alias(f"_by_{c}") for c in by], *statistics)
    return cells.join(frames, [cells[c].eqNullSafe(F.col(f"_by_{c}")) for c in by]).drop(*[f"_by_{c}" for c in by])


def variance_offsets(cells: DataFrame, by: Sequence[str], variance: str, strength: float = 1.0, clamp: int = 6, perceptual: bool = True) -> DataFrame:
    """Adds ``offset``: quantiser offsets from the deviation of each cell's log variance from its picture's mean; the other way round unless ``perceptual``."""
    out = _with_frame(cells, by, _mean=F.avg(F.log2(F.lit(1.0) + F.col(variance))))
    return out.withColumn("offset", variance_offset(F.col(variance), F.col("_mean"), strength, clamp, perceptual)).drop("_mean")


def rank_in_frame(cells: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Adds ``position``: (x - min) / (max - min) within the picture, 0 where all are equal."""
    out = _with_frame(cells, by, _low=F.min(value), _high=F.max(value))
    return out.withColumn("position", F.when(F.col("_high") == F.col("_low"), F.lit(0.0)).otherwise((F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low")))).drop("_low", "_high")


def frame_reference(cells: DataFrame, by: Sequence[str], variance: str, chroma: str, chroma_weight: float = 64.0) -> DataFrame:
    """Per picture: mean activity, mean energy root and its reference, corrected for its second moment."""
    v, c = F.col(variance), F.col(chroma)
    adj = offsets.energy_root(v, c, chroma_weight)
    out = cells.groupBy(*by).agg(F.avg(offsets.activity(v, c)).alias("mean_activity"), F.avg(adj).alias("avg_adj"), F.avg(adj * adj).alias("_pow2"))
    final = F.col("avg_adj") - F.lit(0.5) * (F.col("_pow2") - F.lit(offsets.SECOND_MOMENT)) / F.col("avg_adj")
    return out.withColumn("avg_adj_final", final).drop("_pow2")


def cell_offsets(cells: DataFrame, by: Sequence[str], variance: str, chroma: str, mode: str, strength: float, clamp: int, chroma_weight: float = 64.0) -> DataFrame:
    """Adds ``offset`` by one of the modes chroma, positive, autovar, autovar_biased and measured.

    'measured' takes ``variance`` as what a first pass measured per cell.
    """
    v, c = F.col(variance), F.col(chroma)
    log = F.log2(F.lit(1.0) + v)
    adj = offsets.energy_root(v, c, chroma_weight)
    natural = F.log(F.lit(1.0) + F.greatest(v.cast("double"), F.lit(0.0)))
    frame = _with_frame(cells, by, _a=F.avg(offsets.activity(v, c)), _lo=F.min(log), _hi=F.max(log), _q=F.avg(adj), _q2=F.avg(adj * adj), _ln=F.avg(natural))
    final = F.col("_q") - F.lit(0.5) * (F.col("_q2") - F.lit(offsets.SECOND_MOMENT)) / F.col("_q")
    made = {
        "chroma": lambda: offsets.around(F.lit(strength) * (offsets.activity(v, c) - F.col("_a")), clamp),
        "positive": lambda: offsets.by_rank(log, F.col("_lo"), F.col("_hi"), clamp),
        "autovar": lambda: offsets.by_energy(adj, F.col("_q"), final, strength, False, clamp),
        "autovar_biased": lambda: offsets.by_energy(adj, F.col("_q"), final, strength, True, clamp),
        "measured": lambda: offsets.around(F.lit(strength) * (natural - F.col("_ln")), max(clamp, 1)),
    }
    return frame.withColumn("offset", made[mode]()).drop("_a", "_lo", "_hi", "_q", "_q2", "_ln")


def block_variances(blocks: DataFrame, pixels: DataFrame, image: str, x: str, y: str, size: str) -> DataFrame:
    """Adds ``variance``: the population variance of the pixels that each block covers, clamped to the picture.

    ``pixels`` has one row per picture: ``image``, width, height and samples in row order.
    Pictures are grouped with their blocks; a summed-area table gives each block's sums
    from its four corners.
    """
    names = blocks.columns
    schema = ", ".join([f"`{c}` {t}" for c, t in blocks.dtypes] + ["variance double"])

    def made(rows: pd.DataFrame, picture: pd.DataFrame) -> pd.DataFrame:
        if not len(picture):
            return rows[names].assign(variance=None)
        w, h = int(picture["width"].iloc[0]), int(picture["height"].iloc[0])
        plane = np.asarray(picture["samples"].iloc[0], np.float64).reshape(h, w)
        sums = [np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for p in (plane, plane * plane)]
        x0, y0 = rows[x].to_numpy(np.int64).clip(0, w), rows[y].to_numpy(np.int64).clip(0, h)
        x1, y1 = (rows[x] + rows[size]).to_numpy(np.int64).clip(0, w), (rows[y] + rows[size]).to_numpy(np.int64).clip(0, h)
        n = (x1 - x0) * (y1 - y0)
        one, two = (s[y1, x1] - s[y0, x1] - s[y1, x0] + s[y0, x0] for s in sums)
        with np.errstate(invalid="ignore", divide="ignore"):
            value = np.where(n > 0, np.maximum(two / n - (one / n) ** 2, 0.0), np.nan)
        return rows[names].assign(variance=value)

    return blocks.groupBy(image).cogroup(pixels.groupBy(image)).applyInPandas(made, schema)


def size_map_pairs(a: DataFrame, b: DataFrame, key: Sequence[str], x: str, y: str, log2_size: str, cell: int = 16) -> DataFrame:
    """Two maps of block sizes side by side at the centres of square cells: key..., cx, cy, size_a, size_b.

    Each block gives a row for every centre that it covers; of blocks at one centre the
    last in order of place counts.  Cells that only one map covers are left out.
    """

    def sampled(blocks: DataFrame, name: str) -> DataFrame:
        edge = F.pow(F.lit(2.0), F.col(log2_size)).cast("long")
        # Centres lie at cell * k + cell / 2.
        first = lambda p: F.ceil((F.col(p) - cell // 2) / cell).cast("long")
        last = lambda p: F.ceil((F.col(p) + edge - cell // 2) / cell).cast("long") - 1
        covered = blocks.where((first(x) <= last(x)) & (first(y) <= last(y)))
        wide = covered.withColumn("cx", F.explode(F.sequence(first(x), last(x)))).withColumn("cy", F.explode(F.sequence(first(y), last(y))))
        return wide.groupBy(*key, "cx", "cy").agg(F.max(F.struct(y, x, log2_size))[log2_size].alias(name))

    return sampled(a, "size_a").join(sampled(b, "size_b"), [*key, "cx", "cy"])


def neighbour_mean(cells: DataFrame, by: Sequence[str], x: str, y: str, value: str) -> DataFrame:
    """Adds ``around``: the whole-number mean of up to eight neighbours, null without any.

    Each cell sends its value to its neighbours' places, so one shuffle adds them up.
    """
    steps = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    sent = cells.select(*by, x, y, value, F.explode(steps).alias("s"))
    sums = sent.groupBy(*by, (F.col(x) + F.col("s.dx")).alias(x), (F.col(y) + F.col("s.dy")).alias(y)).agg(F.call_function("div", F.sum(value), F.count(F.lit(1))).alias("around"))
    return join_on(cells, sums, [*by, x, y], "left")


def cells_of(blocks: DataFrame, x: str, y: str, size: str, cell: int) -> DataFrame:
    """A row for each cell (cx, cy) that a block overlaps: few, as blocks are not much larger than cells."""
    along = lambda c: F.sequence(F.floor(F.col(c) / cell), F.floor((F.col(c) + F.col(size) - 1) / cell))
    return blocks.withColumn("cx", F.explode(along(x))).withColumn("cy", F.explode(along(y)))


def overlap_max(blocks: DataFrame, cells: DataFrame, key: Sequence[str], x: str, y: str, size: str, cell: int, value: str) -> DataFrame:
    """Per block the greatest value of the cells it overlaps, by an equality join on cells."""
    found = cells_of(blocks.select(*key, x, y, size), x, y, size, cell).join(cells.select("cx", "cy", value), ["cx", "cy"])
    return found.groupBy(*key).agg(F.max(value).alias(value), F.count(F.lit(1)).alias("cells"))


def clamped_lookup(points: DataFrame, grid: DataFrame, x: str, y: str, cell: int, width: int, height: int, value: str) -> DataFrame:
    """The offset of each point's cell, points beyond the grid taking the last one; the map is written per cell."""
    hold = lambda c, n: F.greatest(F.least(F.floor(F.col(c) / cell), F.lit(n - 1)), F.lit(0))
    return points.withColumns({"cx": hold(x, width), "cy": hold(y, height)}).join(grid.select("cx", "cy", value), ["cx", "cy"], "left")


def parse_offsets(lines: DataFrame, cell: int, width: int, height: int, limit: int = 12, text: str = "value", order: str = "line") -> DataFrame:
    """A map (cx, cy, offset) from text lines ``x,y,offset`` in pixels.

    Commas or white space part the fields, ``#`` starts a comment, rows that do not parse
    or have a negative place are skipped, places beyond the map fall into its last cells,
    offsets are clamped, and the last line for a cell wins.
    """
    parts = F.split(F.trim(F.regexp_replace(F.col(text), "#.*$", "")), r"[,\s]+")
    number = lambda i: F.get(parts, i).try_cast("int")
    rows = lines.select(number(0).alias("x"), number(1).alias("y"), number(2).alias("offset"), F.col(order).alias("line")).where("x >= 0 AND y >= 0 AND offset IS NOT NULL")
    placed = rows.select(
        F.least(F.floor(F.col("x") / cell), F.lit(width - 1)).alias("cx"), F.least(F.floor(F.col("y") / cell), F.lit(height - 1)).alias("cy"),
        F.greatest(F.least("offset", F.lit(limit)), F.lit(-limit)).alias("offset"), "line",
    )
    return placed.groupBy("cx", "cy").agg(F.max(F.struct("line", "offset"))["offset"].alias("offset"))
