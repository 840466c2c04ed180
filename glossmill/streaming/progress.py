"""Metrics as results come in: a stream of finished items keeps running counts, and a metrics row is written every so many items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.votes import COUNTS, counted, rated
from ..session import exists
from ..sources.writers import write_metrics


def running_metrics(spark: SparkSession, source: str, schema: str, state: str, metrics: str, checkpoint: str, every: int = 25, prediction: str = "prediction", label: str = "label"):
    """Start a stream over JSON line files of results under `source`. Returns the query.

    state: one row of counts for each micro-batch, in a folder of its own, so that a batch that is run again replaces its counts
    and adds nothing. metrics: the latest row, with `n_items`; it is written when `every` further items have come in since the
    last one, and by `final_metrics` at the end.
    """

    def batch(rows: DataFrame, number: int) -> None:
        before = _items(spark, state, number)
        counted(rows, None, prediction, label).withColumn("n_items", F.col("n_scored") + F.col("n_skipped")).coalesce(1).write.mode("overwrite").parquet(f"{state}/batch={number}")
        if _items(spark, state) // every > before // every:
            final_metrics(spark, state, metrics)

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _items(spark: SparkSession, state: str, but: int = -1) -> int:
    return (spark.read.parquet(state).filter(F.col("batch") != but).agg(F.sum("n_items")).first()[0] or 0) if exists(spark, state) else 0


def final_metrics(spark: SparkSession, state: str, metrics: str) -> DataFrame:
    """The metrics of all counts so far, written and returned."""
    total = spark.read.parquet(state).agg(*[F.sum(c).alias(c) for c in (*COUNTS, "n_items")])
    made = rated(total)
    write_metrics(made, metrics)
    return made
