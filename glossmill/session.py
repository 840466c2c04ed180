"""Session helpers."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where that is unset, a local folder is made if Spark runs on one machine (tests, a
    laptop); on a cluster this raises."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="glossmill-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that later stages outlive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *keys: str, rows: int = 50_000) -> DataFrame:
    """df dealt out to tasks of about that many rows, by its keys (all columns if there are none): a small compressed file is read
    by one task, however many rows it has and whatever they cost."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(parts, *(keys or df.columns))


def never_broadcast(df: DataFrame) -> DataFrame:
    """df for the side of a join by shuffles alone. Sizes that Spark estimates from compressed files are too small by far, and a
    broadcast goes through the driver whole."""
    return df.hint("merge")


def small_or_shuffled(df: DataFrame, most: int = 20_000) -> DataFrame:
    """df, materialised and counted, for the side of a join: broadcast if it has at most `most` rows, else shuffled."""
    held = cut(df)
    return held.hint("broadcast") if held.limit(most + 1).count() <= most else never_broadcast(held)


def gathered(held: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """A materialised table of that many rows in as few partitions as leave about `each` rows in one: hundreds of tasks that read
    a few rows each cost the driver more memory than the tasks do work."""
    return held.coalesce(max(1, -(-rows // each)))


def small_batches(spark: SparkSession, most: int = 2_000) -> None:
    """From now on, rows go to Python in batches of at most `most`, unless the session has a lower limit: long documents, twice in
    memory on either side, make batches large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, min(most, int(spark.conf.get(name))))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in any file system that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it; harmless where it is installed or shipped."""
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        environment["PYTHONPATH"] = ":".join(x for x in (root, known) if x)
    return spark
