"""Incremental judging: files that arrive are processed in micro-batches, rows that are already done are left out.

Every micro-batch is deduplicated, anti-joined with the finished table and appended to it, so a restarted stream, or a batch
that is run again, does nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, exists

SHARD, SHARDS = "shard", 256


def process_new(spark: SparkSession, source: str, schema: str, finished: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], key: list[str]):
    """Start a stream over JSON line files under `source`; finished rows are Parquet under `finished`. Returns the query.

    Finished rows lie in folders by a hash of their key, and a micro-batch reads the folders of its own keys alone.
    """

    def batch(rows: DataFrame, _: int) -> None:
        todo = cut(rows.dropDuplicates(key).withColumn(SHARD, F.pmod(F.xxhash64(*key), F.lit(SHARDS)).cast("int")))
        own = [r[0] for r in todo.select(SHARD).distinct().collect()]  # at most SHARDS numbers
        if not own:
            return
        if exists(rows.sparkSession, finished):
            done = rows.sparkSession.read.parquet(finished).filter(F.col(SHARD).isin(own))
            todo = todo.join(done.select(*key), key, "left_anti")
        made = work(todo.drop(SHARD)).withColumn(SHARD, F.pmod(F.xxhash64(*key), F.lit(SHARDS)).cast("int"))
        made.repartition(SHARD).write.mode("append").partitionBy(SHARD).parquet(finished)

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
