"""Mixing sources to target weights.

A source with share p of all tokens gets the weight p ** exponent / sum of all such.
The exponent, between 0 (all sources alike) and 1 (as they are), is found by bisection:
the largest one whose weights have the target entropy, or the smallest one under which no
source is repeated more than the limit.  Weights are realised as budgeted blocks: a
source's budget is a number of whole passes over its documents, each in an order of its
own, and a last pass that ends where the budget is spent.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import free_names, materialise, small

#: Most passes over any source, and parts of a source among which the last pass's end is sought.
MAX_REPETITION = 2.0
PARTS = 1024
#: Bisections that one pass over the sources' totals decides, and passes.
LEVELS, ROUNDS = 5, 6


def words(text: Column) -> Column:
    """Words between ASCII white space, a source's tokens unless a column of counts is given."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")).cast("long")


@dataclass
class Mix:
    """The exponent and what follows from it: the sum of all powers, and the tokens to emit."""

    exponent: float
    norm: float
    total: int
    budget: float


def _powers(totals: DataFrame, total: int, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent, the sum of p ** e and of p ** e * ln p, from one aggregation."""
    p = F.col("tokens") / F.lit(total)
    sums = []
    for k, e in enumerate(exponents):
        sums += [F.sum(F.pow(p, F.lit(e))).alias(f"z{k}"), F.sum(F.pow(p, F.lit(e)) * F.log(p)).alias(f"l{k}")]
    row = totals.agg(*sums).first()
    return [(row[f"z{k}"], row[f"l{k}"]) for k in range(len(exponents))]


def solve(totals: DataFrame, target_entropy: float | None = None, max_repetition: float | None = MAX_REPETITION, budget: float | None = None) -> Mix | None:
    """The mix for sources with ``tokens`` each (a written table), or None without any tokens.

    ``target_entropy`` is in bits; a target that no exponent reaches gives the nearest.
    Without ``budget`` the largest source is passed over once, so no document is left out.
    Only sums over all sources come to the driver.
    """
    totals = totals.where("tokens > 0")
    row = totals.agg(F.sum("tokens").alias("total"), F.max("tokens").alias("most"), F.min("tokens").alias("least")).first()
    if not row["total"]:
        return None
    total, most, least = row["total"], row["most"] / row["total"], row["least"] / row["total"]

    def too_flat(e: float, z: float, lsum: float) -> bool:
        """Whether the exponent must grow."""
        if target_entropy is not None:
            entropy = (math.log(z) - e * lsum / z) / math.log(2)
            if entropy > target_entropy:
                return True
        if max_repetition is not None:
            spent = budget / total if budget is not None else most ** (1 - e) * z
            if least ** (e - 1) / z * spent > max_repetition:
                return True
        return False

    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        steps = 1 << LEVELS
        tried = [low + (high - low) * i / steps for i in range(steps)]
        sums = _powers(totals, total, tried)
        flat = [too_flat(e, z, s) for e, (z, s) in zip(tried, sums, strict=True)]
        # Entropy and repetition fall as the exponent grows: bisect within the tried ones.
        lo, hi = -1, steps
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if flat[mid] else (lo, mid)
        if hi == 0:
            low = high = tried[0]
            break
        low, high = tried[lo], tried[hi] if hi < steps else high
    norm = _powers(totals, total, [high])[0][0]
    return Mix(high, norm, total, budget if budget is not None else total * most ** (1 - high) * norm)


def _order(key: Column, seed: str, epoch: Column) -> Column:
    """A document's place in a pass over its source: 60 bits of a keyed hash."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), epoch.cast("string"), key.cast("string")), 256), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokens: Column | None = None, seed: str = "mix", **target) -> DataFrame:
    """``docs`` with a row for each time that the mix uses a document, and four columns more.

    ``mix_tokens`` is the document's count, ``mix_epoch`` the pass (from 0), ``mix_order``
    its place in the pass's keyed order (ties, as rows that repeat have, stand together),
    ``mix_weight`` the source's weight.  Whole passes hold all documents of the source.
    The last pass holds documents in their order until the source's budget is spent, at
    least up to the document that spends it.  Documents without tokens ride along in whole
    passes; a null source is a source; with no tokens at all every row is used once.

    A source's last pass is cut by its keyed order: token sums of ``PARTS`` ranges of the
    order give the range in which the budget ends, and only that range is summed row by
    row, so no source is gathered in one task.
    """
    names = [c for c in docs.columns if c not in ("mix_tokens", "mix_epoch", "mix_order", "mix_weight")]
    docs = docs.select(*names).withColumn("mix_tokens", tokens if tokens is not None else words(F.col(text_col)))
    counts = materialise(docs.select(F.col(source_col).alias("src"), F.col(id_col).alias("id"), "mix_tokens"), "counts")
    totals = materialise(counts.groupBy("src").agg(F.sum("mix_tokens").alias("tokens")), "sources")
    found = solve(totals, **target)
    if found is None:
        return docs.withColumns({"mix_epoch": F.lit(0), "mix_order": _order(F.col(id_col), seed, F.lit(0)), "mix_weight": F.lit(None).cast("double")})

    weight = F.pow(F.col("tokens") / F.lit(found.total), F.lit(found.exponent)) / F.lit(found.norm)
    spend = F.round(weight * F.lit(found.budget)).cast("long")
    plan = totals.withColumn("weight", F.when(F.col("tokens") > 0, weight)).withColumn("spend", F.when(F.col("tokens") > 0, spend).otherwise(F.lit(0)))
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("spend") / F.col("tokens"))).otherwise(F.lit(1)).cast("int")
    plan = materialise(plan.withColumn("passes", passes).withColumn("rest", F.when(F.col("tokens") > 0, F.col("spend") - F.col("passes") * F.col("tokens")).otherwise(F.lit(0))), "plan")
    sources = plan.count()

    # Where the last pass of each source ends, as a place in its order.
    open_ = small(plan.where("rest > 0").select("src", "passes", "rest"), sources)
    placed = counts.join(open_.withColumnRenamed("src", "s"), F.col("src").eqNullSafe(F.col("s"))).drop("s")
    placed = placed.withColumn("place", _order(F.col("id"), seed, F.col("passes"))).withColumn("part", F.shiftright("place", 60 - int(math.log2(PARTS))))
    parts = placed.groupBy("src", "part").agg(F.sum("mix_tokens").alias("t"), F.first("rest").alias("rest"))
    before = F.sum("t").over(Window.partitionBy("src").orderBy("part")) - F.col("t")
    edge = parts.withColumn("before", before).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("t") >= F.col("rest"))).select(F.col("src").alias("s"), F.col("part").alias("p"), "before")
    inside = placed.join(small(edge, sources), F.col("src").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    places = inside.groupBy("src", "place").agg(F.sum("mix_tokens").alias("t"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    run = F.col("before") + F.sum("t").over(Window.partitionBy("src").orderBy("place")) - F.col("t")
    ends = places.withColumn("run", run).where("run < rest").groupBy("src").agg(F.max("place").alias("end"))
    ends = ends.withColumnRenamed("src", "s")
    own, whole, end = free_names(docs, "_mix_src", "_mix_passes", "_mix_end")
    plan = materialise(plan.join(ends.hint("merge"), F.col("src").eqNullSafe(F.col("s")), "left").select(F.col("src").alias(own), F.col("weight").alias("mix_weight"), F.col("passes").alias(whole), F.coalesce("end", F.lit(-1)).alias(end)), "ends")

    used = docs.join(small(plan, sources), docs[source_col].eqNullSafe(F.col(own)))
    last = _order(F.col(id_col), seed, F.col(whole)) <= F.col(end)
    epochs = F.col(whole) + F.when(last, F.lit(1)).otherwise(F.lit(0))
    used = used.where(epochs > 0).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), epochs - 1)))
    return used.withColumn("mix_order", _order(F.col(id_col), seed, F.col("mix_epoch"))).select(*names, "mix_tokens", "mix_epoch", "mix_order", "mix_weight")
