"""Readers. JSON arrays are read in byte ranges, JSON lines by line; gz files, which have one range, are told by their suffix."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.traces import as_bool, candidates, select_one, teacher_correct
from ..plans import schemas
from ..session import exists
from . import json_ranges


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files holding one JSON array of objects each, in ranges that many tasks read. Other forms, JSON lines among them, raise."""
    return _parsed(json_ranges.records(spark, path), schema)


def _parsed(found: DataFrame, schema: str) -> DataFrame:
    return found.select(F.from_json("record", schema).alias("r")).select("r.*")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return read_array(spark, path, schemas.ANNOTATION)


def read_pairs(spark: SparkSession, data_dir: str, split: str) -> DataFrame:
    """A split's pairs with marked usages."""
    raw = read_array(spark, f"{data_dir}/mcl-wic.{split}.json", schemas.PAIR).withColumn("label", as_bool(F.col("label")))
    return raw.withColumns({"usage1": T.mark_target(F.col("sentence1"), F.col("word1")), "usage2": T.mark_target(F.col("sentence2"), F.col("word2"))}).drop("word1", "word2")


def read_teacher(spark: SparkSession, path: str) -> DataFrame:
    """Teacher records; label is a boolean whether files hold booleans or numbers."""
    return read_lines(spark, path, schemas.TEACHER).withColumn("label", as_bool(F.col("label")))


def read_traces(spark: SparkSession, path: str, strategy: str = "first") -> DataFrame:
    """Training records: correct teacher records, one usable trace of each."""
    rows = teacher_correct(read_array(spark, path, schemas.TEACHER).withColumn("label", as_bool(F.col("label"))))
    one = select_one(candidates(rows), list(schemas.PAIR_KEY), strategy)
    return one.select(F.lit("wic").alias("task"), "lemma", "pos", "label", "sentence1", "sentence2", "usage1", "usage2", "think", "sense1", "sense2")


def read_gold_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Gold-sense pairs; files written before glosses existed get empty ones."""
    if not exists(spark, path):
        raise FileNotFoundError(f"{path}: there are no gold pairs yet; build them from the sense annotations first (operators.pairs.build)")
    empty = {c: F.coalesce(c, F.lit("")) for c in ("synset1", "synset2", "gloss1", "gloss2")}
    return read_array(spark, path, schemas.GOLD_PAIR).withColumns(empty | {"senses": F.coalesce("senses", F.array().cast("array<string>"))})


def gloss_records(raw: DataFrame, default_pos: str = "noun") -> DataFrame:
    """Gloss evaluation records: required fields are checked, an empty pos gets the default, tagged usages are left alone."""
    def required(name: str) -> Column:
        return F.when(F.coalesce(F.trim(F.col(name)), F.lit("")) == "", F.raise_error(F.lit(f"a record lacks {name}"))).otherwise(F.col(name))

    checked = raw.withColumns({n: required(n) for n in ("lemma", "word", "usage", "definition")} | {"pos": F.coalesce(F.nullif(F.trim("pos"), F.lit("")), F.lit(default_pos))})
    tagged = F.contains(F.col("usage"), F.lit("<t>"))
    return checked.withColumn("marked", F.when(tagged, F.col("usage")).otherwise(T.mark_target(F.when(~tagged, F.col("usage")), F.col("word"))))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """An exclusion manifest as key columns: one array of arrays of four strings, or such arrays one after the other."""
    nested = json_ranges.beginning(spark, path).replace(" ", "").replace("\n", "").startswith(("[[", "[]"))
    rows = json_ranges.records(spark, path, depth=1 if nested else 0, close="]").select(F.from_json("record", "array<string>").alias("k"))
    wrong = F.raise_error(F.lit(f"{path}: an entry isn't an array of {len(schemas.PAIR_KEY)} strings"))
    checked = rows.select(F.when(F.size("k") == len(schemas.PAIR_KEY), F.col("k")).otherwise(wrong).alias("k"))
    return checked.select(*[F.get("k", i).alias(c) for i, c in enumerate(schemas.PAIR_KEY)])


def read_eval(spark: SparkSession, path: str) -> DataFrame:
    """Saved evaluation output: {"summary", "records"}, a bare array of records, or JSON lines."""
    head = json_ranges.beginning(spark, path)
    if head.startswith("["):
        return read_array(spark, path, schemas.GLOSS_ROW)
    if re.match(r'\{\s*"(summary|records)"', head):
        return _parsed(json_ranges.records(spark, path, depth=2, key="records"), schemas.GLOSS_ROW)
    return read_lines(spark, path, schemas.GLOSS_ROW)
