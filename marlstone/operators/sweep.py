"""Reports over tables of encode runs: summaries, nearest sizes, rate-distortion curves."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.scalars import percent_delta


def values(column: str) -> Column:
    """A measure as a number; what is empty or no number is missing."""
    return F.expr(f"try_cast(`{column}` AS DOUBLE)")


def variant_summary(runs: DataFrame, by: Sequence[str], measures: Sequence[str], digits: int = 6) -> DataFrame:
    """Runs and mean of each measure per variant.  Missing measures are left out of the mean; a mean of none is null."""
    means = [F.round(F.avg(values(m)), digits).alias(f"mean_{m}") for m in measures]
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_runs"), *means)


def exact_medians(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per group the exact ``median`` of a number, whatever the size of a group.

    Approximate percentiles around the middle give a band of values that must hold it.  All
    others are counted on their side of the band before the shuffle; only the band's
    distinct values, a few thousandths of a group, are put in order.  Groups without
    values are left out.
    """
    v = F.col(value).cast("double")
    rows = rows.select(*by, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    band = rows.groupBy(*by).agg(F.percentile_approx("_v", F.array(F.lit(0.498), F.lit(0.502)), F.lit(10_000)).alias("_b"), F.count(F.lit(1)).alias("_n"))
    left = rows.join(band.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_b", "_n"), [rows[c].eqNullSafe(F.col(f"_by_{c}")) for c in by])
    # Values beyond the band stand at infinity on their side.
    place = F.when(F.col("_v") < F.col("_b")[0], F.lit(float("-inf"))).when(F.col("_v") > F.col("_b")[1], F.lit(float("inf"))).otherwise(F.col("_v"))
    counted = left.groupBy(*by, place.alias("_p")).agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy("_p"))
    ranked = counted.withColumn("_u", upto)
    at = lambda rank: F.min(F.when(F.col("_u") > rank, F.col("_p")))
    return ranked.groupBy(*by).agg(((at(F.floor((F.col("_n") - 1) / 2)) + at(F.floor(F.col("_n") / 2))) / 2).alias("median"))


def metric_summary(runs: DataFrame, by: Sequence[str], higher_better: dict[str, bool], digits: int = 6) -> DataFrame:
    """Per variant and metric: mean, exact median, worst value and count.

    The worst is the least of a metric where more is better, else the greatest.
    """
    keyed = runs.select(*by, *[values(m).alias(m) for m in higher_better])
    long = keyed.unpivot(list(by), list(higher_better), "metric", "value").where(F.col("value").isNotNull())
    better = F.col("metric").isin([m for m, up in higher_better.items() if up])
    middle = exact_medians(long, [*by, "metric"], "value").select(*[F.col(c).alias(f"_by_{c}") for c in (*by, "metric")], F.round("median", digits).alias("median_value"))
    out = long.groupBy(*by, "metric").agg(
        F.round(F.avg("value"), digits).alias("mean_value"),
        F.when(F.first(better), F.min("value")).otherwise(F.max("value")).alias("worst_value"),
        F.count("value").alias("n"),
    )
    keys = [*by, "metric"]
    return out.join(middle, [out[c].eqNullSafe(F.col(f"_by_{c}")) for c in keys], "left").select(*keys, "mean_value", "median_value", "worst_value", "n")


def size_spread(runs: DataFrame, by: Sequence[str], size: str) -> DataFrame:
    """Per group: least and greatest size, their ratio and the number of runs."""
    return runs.groupBy(*by).agg(
        F.min(size).alias("min_size"), F.max(size).alias("max_size"), F.round(F.max(size) / F.greatest(F.min(size), F.lit(1)), 6).alias("ratio"), F.count(F.lit(1)).alias("n")
    )


def nearest_size(left: DataFrame, right: DataFrame, on: Sequence[str], size: str, left_id: str, right_id: str) -> DataFrame:
    """Each left run with the right run of its group that is nearest in size; ties to the first right id.

    Runs without a partner in their group drop out.  Instead of all pairs of a group, the
    two sides are laid out in one order of size, and each left run sees only the last
    right run at or below it and the first one at or above it.  Of right runs that share
    a size only the first can be wanted, so they are reduced to it before.
    """
    first = right.groupBy(*on, size).agg(F.min(right_id).alias("rid"))
    both = left.select(*on, F.col(size).alias("z"), F.col(left_id).alias("lid"), F.lit(None).cast(dict(first.dtypes)["rid"]).alias("rid"), F.lit(1).alias("side"))
    both = both.unionByName(first.select(*on, F.col(size).alias("z"), F.lit(None).cast(dict(both.dtypes)["lid"]).alias("lid"), "rid", F.lit(0).alias("side")))
    point = F.when(F.col("side") == 0, F.struct("z", "rid"))
    order = Window.partitionBy(*on).orderBy("z", "side")
    below = F.last(point, True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    above = F.last(point, True).over(Window.partitionBy(*on).orderBy(F.desc("z"), "side").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumns({"below": below, "above": above}).where("side = 1 AND (below IS NOT NULL OR above IS NOT NULL)")
    gap = lambda c: F.abs(F.col(c)["z"] - F.col("z"))
    up = F.col("below").isNull() | (F.col("above").isNotNull() & ((gap("above") < gap("below")) | ((gap("above") == gap("below")) & (F.col("above")["rid"] < F.col("below")["rid"]))))
    partner = F.when(up, F.col("above")).otherwise(F.col("below"))
    return found.select(*on, "lid", F.col("z").alias("left_size"), partner["rid"].alias("rid"), partner["z"].alias("right_size"), F.round(percent_delta(F.col("z"), partner["z"]), 6).alias("size_delta_pct"))


def interpolate(probes: DataFrame, curve: DataFrame, on: Sequence[str], rate: str, quality: str) -> DataFrame:
    """``probes`` with ``at_rate``: the curve's quality at the probe's rate, linear in the log of the rate.

    Without extrapolation: null below the first and above the last point, and on curves of
    fewer than two points.  Curve and probes are laid out in one order, so no ranges are joined.
    """
    points = curve.groupBy(*on, rate).agg(F.first(quality).alias("q")).select(*on, F.col(rate).alias("r"), "q")
    probe_id = F.monotonically_increasing_id()
    asked = probes.withColumn("_probe", probe_id)
    both = points.select(*on, "r", "q", F.lit(None).cast("long").alias("_probe")).unionByName(asked.select(*on, F.col(rate).alias("r"), F.lit(None).cast("double").alias("q"), "_probe"))
    point = F.when(F.col("_probe").isNull(), F.struct("r", "q"))
    low = F.last(point, True).over(Window.partitionBy(*on).orderBy("r", F.col("_probe").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    high = F.last(point, True).over(Window.partitionBy(*on).orderBy(F.desc("r"), F.col("_probe").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    size = F.count(point).over(Window.partitionBy(*on))
    found = both.withColumns({"low": low, "high": high, "size": size}).where("_probe IS NOT NULL")
    a, b = F.col("low"), F.col("high")
    t = (F.log("r") - F.log(a["r"])) / (F.log(b["r"]) - F.log(a["r"]))
    at = F.when((F.col("size") < 2) | a.isNull() | b.isNull(), None).when(a["r"] == b["r"], a["q"]).otherwise(a["q"] + (b["q"] - a["q"]) * t)
    return found.select(*on, F.col("r").alias(rate), F.round(at, 6).alias("at_rate"))


def equal_rate_delta(runs: DataFrame, baseline: DataFrame, on: Sequence[str], rate: str, qualities: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """For each run and metric: its quality minus the baseline curve's at the same rate (null outside the curve)."""
    long = runs.unpivot([*on, *keep, rate], list(qualities), "metric", "quality")
    curve = baseline.unpivot([*on, rate], list(qualities), "metric", "q")
    keys = [*on, "metric"]
    at = interpolate(long.select(*keys, rate).distinct(), curve, keys, rate, "q")
    return long.join(at, [*keys, rate], "left").withColumn("delta", F.round(F.col("quality") - F.col("at_rate"), 6)).drop("at_rate", "quality")


def bd_rate_of(rate_a: Sequence[float], metric_a: Sequence[float], rate_b: Sequence[float], metric_b: Sequence[float]) -> float | None:
    """Mean difference in rate at equal quality, in percent (Bjontegaard): cubics of log rate over quality, integrated where both reach."""
    if len(rate_a) < 4 or len(rate_b) < 4:
        return None
    low, high = max(min(metric_a), min(metric_b)), min(max(metric_a), max(metric_b))
    if not high > low or min(*rate_a, *rate_b) <= 0:
        return None
    try:
        # Fitted over qualities moved to -1 ... 1, where the cubic is well conditioned.
        curves = [np.polynomial.Polynomial.fit(np.asarray(m, float), np.log10(np.asarray(r, float)), 3).integ() for r, m in ((rate_a, metric_a), (rate_b, metric_b))]
        area = [c(high) - c(low) for c in curves]
    except (np.linalg.LinAlgError, ValueError, TypeError):
        return None
    out = (10 ** ((area[1] - area[0]) / (high - low)) - 1) * 100
    return float(out) if np.isfinite(out) else None


def bd_rate_pairs(runs: DataFrame, on: Sequence[str], encoder: str, setting: str, baseline: str, rate: str, metrics: Sequence[str]) -> DataFrame:
    """BD-rate of every encoder and setting against every setting of the ``baseline`` encoder, per group and metric.

    Returns on..., test, ref, metric, points (the smaller number of runs) and bd_rate_pct,
    null with fewer than four points on a side.  Curves are a handful of points each.
    """
    point = lambda m: F.when(F.col(m).isNotNull() & F.col(rate).isNotNull(), F.struct(F.col(m).cast("double").alias("m"), F.col(rate).cast("double").alias("r")))
    curves = runs.groupBy(*on, encoder, setting).agg(F.count(F.lit(1)).alias("n"), *[F.sort_array(F.collect_list(point(m))).alias(f"c_{m}") for m in metrics])
    name = F.concat_ws("-", encoder, setting)
    test = curves.where(F.col(encoder) != baseline).select(*on, name.alias("test"), F.col("n").alias("tn"), *[F.col(f"c_{m}").alias(f"t_{m}") for m in metrics])
    ref = curves.where(F.col(encoder) == baseline).select(*on, name.alias("ref"), F.col("n").alias("rn"), *[F.col(f"c_{m}").alias(f"r_{m}") for m in metrics])

    @F.pandas_udf("double")
    def bd(ra: pd.Series, ma: pd.Series, rb: pd.Series, mb: pd.Series) -> pd.Series:
        return pd.Series([bd_rate_of(*x) for x in zip(ra, ma, rb, mb, strict=True)], dtype="float64")

    long = test.join(ref, list(on)).select(*on, "test", "ref", F.least("tn", "rn").alias("points"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"t_{m}").alias("t"), F.col(f"r_{m}").alias("r")) for m in metrics])).alias("p"))
    return long.select(*on, "test", "ref", "points", "p.metric", bd("p.r.r", "p.r.m", "p.t.r", "p.t.m").alias("bd_rate_pct"))


def bd_rate(runs: DataFrame, on: Sequence[str], variant: str, baseline: str, rate: str, metric: str) -> DataFrame:
    """BD-rate of every variant against ``baseline`` per group; null with fewer than four points on a side.

    A curve is a handful of points, so the baseline's ride along as arrays.
    """
    curve = F.sort_array(F.collect_list(F.struct(F.col(metric).cast("double").alias("m"), F.col(rate).cast("double").alias("r"))))
    curves = runs.where(F.col(rate).isNotNull() & F.col(metric).isNotNull()).groupBy(*on, variant).agg(curve.alias("c"))
    base = curves.where(F.col(variant) == baseline).select(*on, F.col("c").alias("b"))

    @F.pandas_udf("double")
    def bd(ra: pd.Series, ma: pd.Series, rb: pd.Series, mb: pd.Series) -> pd.Series:
        return pd.Series([bd_rate_of(*x) for x in zip(ra, ma, rb, mb, strict=True)], dtype="float64")

    pairs = curves.where(F.col(variant) != baseline).join(base, list(on))
    return pairs.select(*on, variant, bd("b.r", "b.m", "c.r", "c.m").alias("bd_rate_pct"))


def pending(grid: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Cells of a sweep that have no result yet; running it again after all are done gives none."""
    return grid.join(done.select(*key).distinct(), list(key), "left_anti")


def sweep_grid(*dimensions: DataFrame) -> DataFrame:
    """All cells of a sweep: a few short lists of settings against the images, the one long list."""
    out, *rest = dimensions
    for d in rest:
        out = out.crossJoin(F.broadcast(d))
    return out


def offset_stats(cells: DataFrame, by: Sequence[str], offset: str) -> DataFrame:
    """Per map: cells, least, mean and greatest offset, and how many lie below, at and above 0."""
    o, n = F.col(offset), F.count(F.lit(1))
    return cells.groupBy(*by).agg(
        n.alias("qgs"), F.min(o).alias("min_dqp"), F.round(F.avg(o), 6).alias("mean_dqp"), F.max(o).alias("max_dqp"),
        F.count_if(o < 0).alias("below_base_qgs"), F.count_if(o == 0).alias("at_base_qgs"), F.count_if(o > 0).alias("above_base_qgs"),
        F.round(F.count_if(o < 0) * 100.0 / n, 6).alias("below_base_pct"), F.round(F.count_if(o > 0) * 100.0 / n, 6).alias("above_base_pct"),
    )


def timing_summary(runs: DataFrame, label: str, seconds: str) -> DataFrame:
    s = F.col(seconds)
    middle = exact_medians(runs, [label], seconds).select(F.col(label).alias("_label"), F.col("median").alias("median_s"))
    out = runs.groupBy(label).agg(F.min(s).alias("min_s"), F.round(F.avg(s), 6).alias("mean_s"), F.count(s).alias("n"))
    return out.join(middle, F.col(label).eqNullSafe(F.col("_label")), "left").select(label, "min_s", "mean_s", "median_s", "n")


def same_bytes(outputs: DataFrame, by: Sequence[str], digest: str) -> DataFrame:
    """Whether all outputs of a group are the same bytes."""
    return outputs.groupBy(*by).agg(F.coalesce(F.min(digest) == F.max(digest), F.lit(False)).alias("identical"), F.count(F.lit(1)).alias("n"))


def best_under_budget(sizes: DataFrame, by: Sequence[str], level: str, size: str, budget: Column, fallback: int) -> DataFrame:
    """The lowest level whose size fits the budget, ``fallback`` if none does."""
    fits = F.when(F.col(size) <= budget, F.col(level))
    return sizes.groupBy(*by).agg(F.coalesce(F.min(fits), F.lit(fallback)).alias("level"))


def shortlist(candidates: DataFrame, by: Sequence[str], cost: str, tie: str, factor: float, cap: int) -> DataFrame:
    """Per group, candidates below ``factor`` times the least cost, the ``cap`` cheapest of them, ranked."""
    best = candidates.groupBy(*by).agg(F.min(cost).alias("_best")).select(*[F.col(c).alias(f"_by_{c}") for c in by], "_best")
    near = candidates.join(best, [candidates[c].eqNullSafe(F.col(f"_by_{c}")) for c in by]).where(F.col(cost) < F.col("_best") * factor).select(*candidates.columns)
    # Spark keeps only the first ``cap`` of each group before the shuffle.
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(cost, tie))).where(F.col("rank") <= cap)


def first_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Ordered de-duplication: the first row of each key."""
    first = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")
    return rows.groupBy(*[F.col(k).alias(f"_by_{k}") for k in key]).agg(first).select("_row.*")
