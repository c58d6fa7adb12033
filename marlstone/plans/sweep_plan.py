"""A sweep from its grid to its reports, with encoders as plug-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators import sweep
from marlstone.session import written

#: Given one cell of the grid as a dict, returns the columns that a run measures.
Measure = Callable[[dict], dict]


def measure(cells: DataFrame, run: Measure, measured: str) -> DataFrame:
    """Runs ``run`` for every cell; a failing cell gives a row with ``error`` and no measures.

    ``measured`` is the schema of what a run returns.  Write the result: timings can not
    be repeated, so reports must read the written table.
    """
    names = [c.split()[0] for c in measured.split(", ")]
    schema = ", ".join([f"{c} {t}" for c, t in cells.dtypes] + [measured, "error string"])

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for cell in frame.to_dict("records"):
                try:
                    rows.append({**cell, **run(cell), "error": None})
                except Exception as e:  # noqa: BLE001  any failure of a plug-in is a result
                    rows.append({**cell, **dict.fromkeys(names), "error": f"{type(e).__name__}: {e}"})
            # Null measures must not turn whole numbers into fractions.
            yield pd.DataFrame(rows, columns=[*frame.columns, *names, "error"]).convert_dtypes()

    return cells.mapInPandas(runs, schema)


def continue_sweep(grid: DataFrame, done: DataFrame, key: Sequence[str], run: Measure, measured: str, tasks: int) -> DataFrame:
    """Measures the cells without a result, evenly over ``tasks`` tasks."""
    return measure(sweep.pending(grid, done, key).repartition(tasks), run, measured)


def reports(runs: DataFrame, by: Sequence[str], measures: dict[str, bool], size: str) -> dict[str, DataFrame]:
    """The usual reports of a written result table."""
    return {
        "summary_by_variant": sweep.variant_summary(runs, by, [size, *measures]),
        "metric_summary": sweep.metric_summary(runs, by, measures),
        "size_spread": sweep.size_spread(runs, ["image", "format"], size),
    }


def search_budget(pictures: DataFrame, key: Sequence[str], budget: str, run: Measure, size: str = "size_bytes", levels: tuple[int, int] = (1, 51), tasks: int | None = None) -> DataFrame:
    """key..., level, size and fits: for every picture the lowest level whose size is within its budget.

    All pictures halve their range of levels at once; sizes must not grow with the level.
    A round measures only pairs of a picture and a level that no round before it has
    measured, so six rounds do for 51 levels.  A picture that no level brings within the
    budget gets the last level.  A level that fails to measure counts as too large, and a
    null budget fits nothing.  ``run`` gets the picture's columns and ``level``; pictures
    whose key repeats are searched once.
    """
    low, high = levels
    first = F.min_by(F.struct(*pictures.columns), F.struct(budget)).alias("_p")
    named = pictures.groupBy(*[F.col(k).alias(f"_by_{k}") for k in key]).agg(first).select("_p.*")
    state = named.withColumns({"_lo": F.lit(low), "_hi": F.lit(high), "_best": F.lit(None).cast("int")})
    memo = None
    same = lambda a, b: [a[k].eqNullSafe(b[f"_of_{k}"]) for k in key]
    for _ in range((high - low + 1).bit_length()):
        middle = F.when(F.col("_lo") <= F.col("_hi"), F.col("_lo") + F.floor((F.col("_hi") - F.col("_lo")) / 2).cast("int"))
        asked = state.withColumn("level", middle)
        wanted = asked.where("level IS NOT NULL").select(*pictures.columns, "level")
        if memo is not None:
            wanted = wanted.join(memo, [*same(wanted, memo), wanted["level"] == memo["_level"]], "left_anti")
        wanted = wanted.repartition(tasks) if tasks else wanted
        found = measure(wanted, run, f"{size} long").select(*[F.col(k).alias(f"_of_{k}") for k in key], F.col("level").alias("_level"), F.col(size).alias("_size"))
        found = written(found, "measured")
        memo = found if memo is None else memo.unionAll(found)
        joined = asked.join(memo, [*same(asked, memo), asked["level"] == memo["_level"]], "left")
        fits = F.coalesce(F.col("_size") <= F.col(budget), F.lit(False))
        searched = F.col("level").isNotNull()
        state = joined.select(
            *[asked[c] for c in pictures.columns], F.when(searched & ~fits, F.col("level") + 1).otherwise(F.col("_lo")).alias("_lo"),
            F.when(searched & fits, F.col("level") - 1).otherwise(F.col("_hi")).alias("_hi"), F.when(searched & fits, F.col("level")).otherwise(F.col("_best")).alias("_best"),
        )
        state = written(state, "search")
    done = state.select(*key, F.coalesce("_best", F.lit(high)).alias("level"), F.col("_best").isNotNull().alias("fits"))
    # The last level of a search that failed was measured on the way there.
    return done.join(memo, [*same(done, memo), done["level"] == memo["_level"]], "left").select(*[done[c] for c in (*key, "level")], F.col("_size").alias(size), "fits")
