"""A sweep summary that follows arriving result files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.operators.sweep import values
from marlstone.sources.results import CSV_OPTIONS, RUNS


def arriving_results(spark: SparkSession, folder: str, schema: str = RUNS) -> DataFrame:
    return spark.readStream.options(**CSV_OPTIONS).schema(schema).csv(folder)


def live_summary(runs: DataFrame, by: Sequence[str], measures: Sequence[str], out: str, checkpoint: str, digits: int = 6, once: bool = False) -> StreamingQuery:
    """Keeps ``out`` (Parquet) equal to the variant summary of all runs so far.

    The state is one row of sums per variant, so arriving runs are read once; each batch
    replaces the summary as a whole.
    """
    means = [F.round(F.avg(values(m)), digits).alias(f"mean_{m}") for m in measures]
    summary = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_runs"), *means)
    writer = summary.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    return (writer.trigger(availableNow=True) if once else writer).start()
