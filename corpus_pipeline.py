"""The corpus pipeline: language ID, quality rules, exact dedup, near-dedup, packing, each on what the stage before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.

Defined results, over whole texts of any length: a null text has no letters and goes in the first stage, as an empty one does; null
ids, languages and sources are values like any others, and rows that repeat an id stay as long as their texts differ; rows
that repeat a text stay once; further columns, whatever their names, are kept up to the packing, which returns its own; an empty
table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.common import crc_mod, drop_folder, shared_folder, small_batches


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language can't be told, go."""
    small_batches(spark)
    from glossmill.llm.language_id import Languages

    return Languages(docs, crc_mod(F.col("doc_id"), 4) != 2).keep_known(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or lie outside their language's perplexity band go."""
    small_batches(spark)
    from glossmill.llm.quality_rules import Rules

    return Rules(docs).keep_clean(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    from glossmill.llm.exact_dedup import deduplicate

    return deduplicate(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (SimHash of three-word shingles, up to three bits apart) the one with the smallest id stays."""
    small_batches(spark)
    from glossmill.llm.simhash_dedup import one_of_each

    return one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in training sequences."""
    small_batches(spark)
    from glossmill.llm.packing import pack

    return pack(docs)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("simhash_dedup", simhash_dedup), ("packing", packing)]

#: Learned language bits, floating-point perplexities and tokenizers are not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Tables between stages go to the shared checkpoint folder of the session; a stage's input is
    removed when its output is written, the last stage's stays, because its result is computed when it is used."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        made.write.parquet(f"{place}/{k}-{name}")
        docs = spark.read.parquet(f"{place}/{k}-{name}")
        if k:
            drop_folder(spark, f"{place}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
