"""Reports over an encoder's search log, and plain predicates on runs and pictures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.scalars import margin_bucket, share
from marlstone.operators.keys import join_on

#: Children built from which on split decisions share a row.
MOST_CHILDREN = 4


def plane_totals(blocks: DataFrame, by: Sequence[str], plane: str, measures: Sequence[str]) -> DataFrame:
    """Per group and measure: luma and chroma sums, and luma's share in percent."""
    luma = F.col(plane) == 0
    out = []
    for m in measures:
        a, b = F.sum(F.when(luma, F.col(m))), F.sum(F.when(~luma, F.col(m)))
        a, b = F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))
        out += [a.alias(f"luma_{m}"), b.alias(f"chroma_{m}"), F.round(share(a, a + b, 100.0), 6).alias(f"luma_{m}_pct")]
    return blocks.groupBy(*by).agg(*out)


def histogram(rows: DataFrame, by: Sequence[str], value: str, values: Sequence | None = None) -> DataFrame:
    """Counts of each value; with ``values`` a column for each of them, 0 where none, else a row for each value."""
    if values is None:
        return rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy(*by).agg(*[F.count_if(F.col(value) == F.lit(v)).alias(f"n_{v}") for v in values])


def size_dump(blocks: DataFrame, by: Sequence[str], log2_size: str, measures: Sequence[str]) -> DataFrame:
    """Per block size: blocks, and each measure's total and amount per pixel."""
    area = F.sum(F.pow(F.lit(4.0), F.col(log2_size)))
    sums = [c for m in measures for c in (F.sum(m).alias(f"sum_{m}"), F.round(F.sum(m) / area, 6).alias(f"{m}_per_px"))]
    return blocks.groupBy(*by, log2_size).agg(F.count(F.lit(1)).alias("n"), *sums)


def cell_sums(blocks: DataFrame, by: Sequence[str], x: str, y: str, cell: int, measures: dict[str, Column]) -> DataFrame:
    """Sums per square cell that holds a block's upper left corner."""
    at = lambda p: F.floor(F.col(p) / cell).cast("long")
    return blocks.groupBy(*by, at(x).alias("cx"), at(y).alias("cy")).agg(*[F.sum(c).alias(n) for n, c in measures.items()])


def squared_error(pixels: DataFrame, by: Sequence[str], x: str, y: str, cell: int, source: str, made: str) -> DataFrame:
    """Sum of squared differences per square cell."""
    d = F.col(source) - F.col(made)
    return cell_sums(pixels, by, x, y, cell, {"sse": d * d})


def grouped_counts(rows: DataFrame, dimensions: Sequence[str], conditions: dict[str, Column]) -> DataFrame:
    """Counts and conditional counts by each dimension apart, in one pass: dimension, value, n, ...

    The grouping number tells a dimension's own nulls from those of the others.
    """
    sets = rows.groupingSets([[F.col(d)] for d in dimensions], *map(F.col, dimensions))
    counted = sets.agg(F.grouping_id(*dimensions).alias("_gid"), F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(n) for n, c in conditions.items()])
    # The bit of a dimension is 0 where it is grouped by.
    full = (1 << len(dimensions)) - 1
    gids = {d: full ^ (1 << (len(dimensions) - 1 - k)) for k, d in enumerate(dimensions)}
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d, g in gids.items():
        name = F.when(F.col("_gid") == g, F.lit(d)).otherwise(name)
        value = F.when(F.col("_gid") == g, F.col(d).cast("string")).otherwise(value)
    return counted.select(name.alias("dimension"), value.alias("value"), "n", *conditions)


def split_aborts(decisions: DataFrame, children: str, region: str, log2_size: str, margin: str) -> DataFrame:
    """Abandoned splits by children built (the most together), region, size and margin bucket."""
    rows = decisions.select(F.least(F.col(children), F.lit(MOST_CHILDREN)).alias("children"), F.col(region).alias("region"), F.col(log2_size).alias("log2_size"), margin_bucket(F.col(margin)).alias("margin_bucket"))
    return grouped_counts(rows, ["children", "region", "log2_size", "margin_bucket"], {})


def work_histograms(work: DataFrame, bucket: str, component: str, components: Sequence, amount: str) -> DataFrame:
    """Per bucket of work: items, their sum, and the sum of each component."""
    each = [F.coalesce(F.sum(F.when(F.col(component) == F.lit(c), F.col(amount))), F.lit(0)).alias(f"sum_{c}") for c in components]
    return work.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("total"), *each)


def neighbour_prior(decisions: DataFrame, by: Sequence[str], neighbour_split: str, split: str) -> DataFrame:
    """Decisions whose neighbour is known: how many, how it went, and how often the decision went the same way."""
    known, n, s = F.col(neighbour_split).isNotNull(), F.col(neighbour_split), F.col(split)
    return decisions.groupBy(*by).agg(F.count_if(known).alias("seen"), F.count_if(known & ~n).alias("leaf"), F.count_if(known & n).alias("split"), F.count_if(known & (n == s)).alias("matches"))


def region_table(events: DataFrame, region: str, amount: str, cells: DataFrame) -> DataFrame:
    """Per region: work, its share of all work in percent, and cells of that class (0 if none)."""
    work = events.groupBy(region).agg(F.sum(amount).alias("work"))
    whole = work.agg(F.sum("work").alias("_all"))
    n = cells.groupBy(region).agg(F.count(F.lit(1)).alias("cells"))
    joined = join_on(work, n, [region], "left").crossJoin(F.broadcast(whole))  # one row
    return joined.select(region, "work", F.round(share(F.col("work"), F.col("_all"), 100.0), 6).alias("work_pct"), F.coalesce("cells", F.lit(0)).alias("cells"))


def region_by_size(events: DataFrame, region: str, log2_size: str, sizes: Sequence[int], amount: str) -> DataFrame:
    """Work per region, a column for each block size."""
    return events.groupBy(region).agg(*[F.coalesce(F.sum(F.when(F.col(log2_size) == s, F.col(amount))), F.lit(0)).alias(f"size_{s}") for s in sizes])


def flip_share(flips: DataFrame, by: Sequence[str], flipped: str = "flipped") -> DataFrame:
    """Per group: decisions for which both winners are known, and the share in percent that differ."""
    return flips.groupBy(*by).agg(F.count(flipped).alias("known"), F.round(F.coalesce(F.avg(F.col(flipped).cast("int")) * 100, F.lit(0.0)), 6).alias("flip_pct"))


def split_waste(decisions: DataFrame, region: str, built: str, won: str, amount: str) -> DataFrame:
    """Per region: decisions, splits that were built but lost, and the work that went into them."""
    lost = F.col(built) & ~F.col(won)
    return decisions.groupBy(region).agg(F.count(F.lit(1)).alias("decisions"), F.count_if(lost).alias("lost"), F.coalesce(F.sum(F.when(lost, F.col(amount))), F.lit(0)).alias("lost_work"))


def heat_map(events: DataFrame, units: DataFrame, unit: str, bits: str, counters: dict[str, Column]) -> DataFrame:
    """Per coding unit of ``units``, 0 where nothing happened: bytes and counters."""
    sums = events.groupBy(unit).agg(F.sum(bits).alias("_bits"), *[F.count_if(c).alias(n) for n, c in counters.items()])
    out = join_on(units.select(unit).distinct(), sums, [unit], "left")
    return out.select(unit, F.round(F.coalesce("_bits", F.lit(0)) / 8, 6).alias("bytes"), *[F.coalesce(n, F.lit(0)).alias(n) for n in counters])


def first_events(events: DataFrame, order: Sequence[str], most: int) -> DataFrame:
    """The first ``most`` events in order, each with the number of events left out; a dump's cap is its feature."""
    left = events.agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("truncated"))
    return events.orderBy(*order).limit(most).crossJoin(F.broadcast(left))  # one row


def size_groups(runs: DataFrame, width: str, height: str, measures: Sequence[str]) -> DataFrame:
    """Per picture size, in order: runs and mean of each measure, NaN if none is there."""
    means = [F.round(F.coalesce(F.avg(m), F.lit(float("nan"))), 6).alias(f"mean_{m}") for m in measures]
    return runs.groupBy(width, height).agg(F.count(F.lit(1)).alias("n"), *means).orderBy(width, height)


def first_baseline(runs: DataFrame, by: Sequence[str], order: Sequence[str], seconds: str) -> DataFrame:
    """``runs`` with ``baseline_s``: the time of the group's first run that has one."""
    base = runs.where(F.col(seconds).isNotNull()).groupBy(*by).agg(F.min_by(F.col(seconds), F.struct(*order)).alias("baseline_s"))
    return join_on(runs, base, by, "left")


def alternate_order(runs: DataFrame, round_: str, label: str) -> DataFrame:
    """Adds ``turn``: labels in order in even rounds, the other way round in odd ones, so that neither always comes first."""
    labels = runs.select(label).distinct().agg(F.sort_array(F.collect_list(label)).alias("_l"))
    place = F.array_position("_l", F.col(label)) - 1
    turn = F.when(F.col(round_) % 2 == 0, place).otherwise(F.size("_l") - 1 - place)
    return runs.crossJoin(F.broadcast(labels)).withColumn("turn", turn.cast("int")).drop("_l")  # one row, a few labels


def derived_rates(runs: DataFrame, size: str, pixels: str, ratios: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds bits a pixel, bytes a megapixel, and ratios of counters over denominators of at least 1."""
    at_least_1 = lambda c: F.greatest(F.col(c), F.lit(1))
    out = {"bpp": F.col(size) * 8 / at_least_1(pixels), "bytes_per_mp": F.col(size) * 1e6 / at_least_1(pixels)}
    return runs.withColumns(out | {n: F.col(a) / at_least_1(b) for n, (a, b) in ratios.items()})


def in_window(x: Column, y: Column, cx: int, cy: int, size: int) -> Column:
    """Whether a place lies in a half-open square window."""
    return (x >= cx) & (x < cx + size) & (y >= cy) & (y < cy + size)


def limit_reason(width: Column, height: Column, memory: Column, most_width: int | None = None, most_height: int | None = None, most_pixels: int | None = None, most_memory: int | None = None) -> Column:
    """Why a picture is beyond the limits, null if it is not; a limit that is None holds nothing back."""
    out = F.lit(None).cast("string")
    for name, value, most in (("memory", memory, most_memory), ("pixels", width.cast("long") * height, most_pixels), ("height", height, most_height), ("width", width, most_width)):
        if most is not None:
            out = F.when(value > most, F.lit(name)).otherwise(out)
    return F.when((width <= 0) | (height <= 0), F.lit("empty")).otherwise(out)


def unsupported_reason(animated: Column, alpha: Column, siting: Column) -> Column:
    """Why a container can not be decoded, null if it can."""
    return F.when(animated, "animation").when(alpha, "alpha").when(siting == "mpeg2", "mpeg2 chroma siting")


def is_gray(r: Column, g: Column, b: Column) -> Column:
    """Whether all samples of three planes (arrays) are alike."""
    return (r == g) & (g == b)


def has_nonopaque(alpha: Column, most: int = 255) -> Column:
    return F.exists(alpha, lambda a: a != most)


def csv_field(text: Column) -> Column:
    """A field of a CSV line: quoted, with doubled quotes, if it holds a comma, quote or line end."""
    return F.when(text.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.regexp_replace(text, '"', '""'), F.lit('"'))).otherwise(text)


def union_variants(*lists: DataFrame) -> DataFrame:
    """All variants of several lists, whichever columns they have."""
    out, *rest = lists
    for other in rest:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
