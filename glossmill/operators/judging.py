"""Judging with an external model: bounded concurrency in every task, verdicts stored chunk by chunk, restarts that pay for nothing twice.

A verdict is stored under the row's key and a hash of what was asked. A restart replays stored verdicts of rows that are still
due and asked the same, and calls the model for the others alone: rows that the rules have come to reject, or whose prompt has
changed, don't take an old verdict. Rows whose calls failed are not stored, and stay due.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.answers import judge_scores
from ..plans.prompts import JUDGE_AXES
from ..session import cut, exists
from .backends import MAX_RETRIES, WORKERS, ordered_calls
from .corpus import hash_order, ranked
from .quality import final_verdicts


def ask(rows: DataFrame, make_client: Callable[[], Callable[[str], str]], prompt: str = "prompt", workers: int = WORKERS, retries: int = MAX_RETRIES) -> DataFrame:
    """rows with `raw` and `error`: each prompt's reply, or the last failure after the retries.

    Every task has one client and up to `workers` calls in flight; replies keep the rows' order.
    """
    at = rows.columns.index(prompt)
    names = [*rows.columns, "raw", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = None
        for batch in batches:
            client = client or make_client()
            replies = list(ordered_calls(client, batch.column(at).to_pylist(), workers, retries))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r for r, _ in replies], pa.string()), pa.array([e for _, e in replies], pa.string())], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, raw string, error string")


def judge(
    pending: DataFrame, key: list[str], make_client: Callable[[], Callable[[str], str]], store: str, chunk: int = 100_000, limit: int | None = None, workers: int = WORKERS,
    retries: int = MAX_RETRIES, prompt: str = "prompt", progress: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """pending(*key, prompt) -> *key, raw: the replies of all that have one, stored before or now.

    store: a folder that driver and executors share; it gains one batch of Parquet files for each chunk. limit: rows judged at
    most, in hash order. progress is called with all replies so far after each chunk. Keys are unique and not null.
    """
    spark = pending.sparkSession
    due = cut((pending if limit is None else ranked(pending, hash_order(*key, salt="judge"), key, name="_nth").filter(F.col("_nth") <= limit).drop("_nth")).withColumn("asked", F.sha2(prompt, 256)))
    identity = [*key, "asked"]

    def replies() -> DataFrame:
        return due.select(*identity).join(spark.read.parquet(store).dropDuplicates(identity), identity).select(*key, "raw")

    todo = due.join(spark.read.parquet(store), identity, "left_anti") if exists(spark, store) else due
    todo = cut(todo)
    chunks = -(-todo.count() // chunk)
    for n in range(chunks):
        part = todo.filter(F.pmod(F.xxhash64(*key), F.lit(chunks)) == n)
        ask(part.select(*identity, prompt), make_client, prompt, workers, retries).filter(F.col("error").isNull()).select(*identity, "raw").write.mode("append").parquet(store)
        if progress is not None:
            progress(replies())
    if not exists(spark, store):  # nothing was due: an empty store has the same columns
        due.limit(0).select(*identity, F.lit(None).cast("string").alias("raw")).write.mode("append").parquet(store)
    return replies()


def judged_slots(
    checked: DataFrame, key: list[str], make_client: Callable[[], Callable[[str], str]], store: str, require: tuple[str, ...] = JUDGE_AXES, prompt: str = "prompt", **how
) -> DataFrame:
    """checked(*key, reason, prompt) -> *key, stage, keep, reason, scores: slots that pass the rules go to the judge."""
    held = cut(checked.select(*key, "reason", prompt))
    replies = judge(held.filter(F.col("reason").isNull()).select(*key, prompt), key, make_client, store, prompt=prompt, **how)
    return final_verdicts(held, replies.select(*key, judge_scores(F.col("raw")).alias("scores")), key, require)
