"""Reports over block-level coding decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.scalars import margin_bucket, share
from marlstone.operators.keys import join_on
from marlstone.operators.sweep import exact_medians

#: Ranks from this on share a column.
LAST_RANK = 6


def winner_ranks(candidates: DataFrame, decision: Sequence[str], cost: str, position: str) -> DataFrame:
    """Per decision: the winner's place among its candidates (from 1, capped) and the runner-up's cost.

    The winner has the least cost, the first on a tie.  The runner-up is the cheapest
    finite loser, or the winner itself if there is none.
    """
    w = Window.partitionBy(*decision).orderBy(cost, position)
    ranked = candidates.withColumns({"place": F.row_number().over(w), "listed": F.row_number().over(Window.partitionBy(*decision).orderBy(position))})
    finite = F.abs(F.col(cost).cast("double")) < float("inf")
    return ranked.groupBy(*decision).agg(
        F.max(F.when(F.col("place") == 1, F.least(F.col("listed"), F.lit(LAST_RANK)))).alias("winner_rank"),
        F.max(F.when(F.col("place") == 1, F.col(cost))).alias("best_cost"),
        F.coalesce(F.min(F.when((F.col("place") > 1) & finite, F.col(cost))), F.max(F.when(F.col("place") == 1, F.col(cost)))).alias("runner_up_cost"),
        F.count(F.lit(1)).alias("n_candidates"),
    )


def rank_table(winners: DataFrame, kind: str) -> DataFrame:
    """Decisions of each kind by the winner's rank."""
    columns = [F.count_if(F.col("winner_rank") == r).alias(f"rank{r}" if r < LAST_RANK else f"rank{r}plus") for r in range(1, LAST_RANK + 1)]
    return winners.groupBy(kind).agg(F.count(F.lit(1)).alias("decisions"), *columns)


def rank_crosstabs(winners: DataFrame, kind: str, others: Sequence[str]) -> DataFrame:
    """Decisions by kind and each of the other columns apart, in one pass.

    ``dimension`` names the other column that a row is about, so that its nulls are told
    from those of columns that are left out.
    """
    grouped = winners.groupingSets([[F.col(kind), F.col(o)] for o in others], F.col(kind), *map(F.col, others))
    dimension = F.coalesce(*[F.when(F.grouping(o) == 0, F.lit(o)) for o in others]).alias("dimension")
    return grouped.agg(dimension, F.count(F.lit(1)).alias("decisions"), F.round(F.avg("winner_rank"), 6).alias("mean_rank"))


def margin_table(winners: DataFrame, kind: str, weight: Column | None = None) -> DataFrame:
    """Decisions (and their weight) of each kind by how much dearer the runner-up was; only costs above 0 count."""
    margin = (F.col("runner_up_cost") - F.col("best_cost")) / F.col("best_cost")
    rows = winners.where("best_cost > 0").withColumns({"bucket": margin_bucket(margin), "w": F.lit(1) if weight is None else weight})
    return rows.groupBy(kind, "bucket").agg(F.count(F.lit(1)).alias("decisions"), F.sum("w").alias("weight"))


def winner_flips(candidates: DataFrame, decision: Sequence[str], cost: str, second: str, position: str) -> DataFrame:
    """Per decision whether a second cost names another winner; null unless all second costs are known."""
    known = F.col(second).isNotNull() & ~F.isnan(F.col(second).cast("double"))
    first = F.min(F.struct(F.col(cost), F.col(position)))[position]
    other = F.min(F.struct(F.col(second), F.col(position)))[position]
    return candidates.groupBy(*decision).agg(F.when(F.min(known), first != other).alias("flipped"))


def split_table(decisions: DataFrame, by: Sequence[str], thresholds: Sequence[float] = (0.01, 0.02, 0.05, 0.10)) -> DataFrame:
    """Per bucket: decisions, share that split, median gain of the splits, and flips within each margin.

    Columns read: winner_split, split_won_by, leaf_cost.  The gain is split_won_by / leaf_cost
    of splits with a leaf cost above 0 (0 if none); flips are counted against all decisions.
    """
    rows = decisions.withColumn("_gain", F.when((F.col("winner_split") == 1) & (F.col("leaf_cost") > 0), F.col("split_won_by") / F.col("leaf_cost")))
    n = F.count(F.lit(1))
    flips = [F.round(F.count_if(F.col("_gain") < t) * 100.0 / n, 6).alias(f"flip_{round(t * 1000)}") for t in thresholds]
    out = rows.groupBy(*by).agg(n.alias("n"), F.round(F.count_if(F.col("winner_split") == 1) * 100.0 / n, 6).alias("split_pct"), *flips)
    out = join_on(out, exact_medians(rows, by, "_gain"), by, "left")
    return out.select(*by, "n", "split_pct", F.round(F.coalesce("median", F.lit(0.0)), 6).alias("median_gain"), *[f"flip_{round(t * 1000)}" for t in thresholds])


def class_shares(blocks: DataFrame, by: Sequence[str], value: str, area: Column) -> DataFrame:
    """Per class: the share of its area that each value of a column covers, in percent."""
    sums = blocks.groupBy(*by, value).agg(F.sum(area).alias("area"))
    total = F.sum("area").over(Window.partitionBy(*by))
    return sums.withColumn("share_pct", F.round(share(F.col("area"), total, 100.0), 6))


def confusion(rows: DataFrame, actual: str, predicted: str, labels: Sequence) -> DataFrame:
    """Counts of actual against predicted classes, a row per actual class with row percentages."""
    n = F.count(F.lit(1))
    counts = [F.count_if(F.col(predicted) == x).alias(f"n_{x}") for x in labels]
    shares = [F.round(share(F.count_if(F.col(predicted) == x), n, 100.0), 6).alias(f"pct_{x}") for x in labels]
    return rows.groupBy(actual).agg(n.alias("n"), *counts, *shares)


def ratio_of_sums(rows: DataFrame, by: Sequence[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Per group and name: one column's sum over another's, 0 where that is 0."""
    return rows.groupBy(*by).agg(*[F.round(share(F.sum(a), F.sum(b)), 6).alias(name) for name, (a, b) in pairs.items()])


def dense_cells(blocks: DataFrame, grid: DataFrame, x: str, y: str, size: int, measures: Sequence[str]) -> DataFrame:
    """Sums per square cell, with 0 for cells of ``grid`` (cx, cy) that hold no block."""
    sums = blocks.groupBy(F.floor(F.col(x) / size).alias("cx"), F.floor(F.col(y) / size).alias("cy")).agg(*[F.sum(m).alias(m) for m in measures])
    return grid.join(sums, ["cx", "cy"], "left").fillna(0, list(measures))


def stage_shares(work: DataFrame, stage: str, amount: str) -> DataFrame:
    """Work per stage and its share of the whole."""
    sums = work.groupBy(stage).agg(F.sum(amount).alias("amount"))
    return sums.withColumn("share_pct", F.round(share(F.col("amount"), F.sum("amount").over(Window.partitionBy()), 100.0), 6))


def merge_counters(parts: DataFrame, by: Sequence[str], counters: Sequence[str], arrays: Sequence[str] = ()) -> DataFrame:
    """Adds up counters, and arrays of counters place by place."""
    out = parts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counters])
    for a in arrays:
        places = parts.select(*by, F.posexplode(a).alias("place", "v")).groupBy(*by, "place").agg(F.sum("v").alias("v"))
        summed = places.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "v"))), lambda s: s["v"]).alias(a))
        out = join_on(out, summed, by, "left")
    return out
