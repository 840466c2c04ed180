"""Lexicon files as tables: the WordNet database files, and WordNet-LMF.

Both give one schema: senses(lemma, pos, rank, synset_id, definition), edges(synset_id, hypernym_id), parts of speech
(synset_id, pos) and names (synset_id, name: its first lemma), each with a column `lexicon` that says where a row is from.
Operators refuse tables in which two lexicons meet (`operators.lexicon.one_lexicon`). Lemma keys are small letters with
underscores; satellites belong to the adjectives of their lemma.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Letters of parts of speech in lexicon files.
POS = {"n": "noun", "v": "verb", "a": "adj", "s": "adj", "r": "adv"}
#: Names of files by part of speech, and relations that lead upwards.
FILES = {"noun": "n", "verb": "v", "adj": "a", "adv": "r"}
UPWARDS = ("hypernym", "instance_hypernym")


class Lexicon(NamedTuple):
    senses: DataFrame
    edges: DataFrame
    pos: DataFrame
    names: DataFrame


def _pos(letter: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in POS.items() for x in kv]), letter)


def _lemma(word: Column) -> Column:
    return F.lower(T.lemma_key(word))


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of database files but the licence, which is indented; and the letter of the file's part of speech."""
    letters = F.create_map(*[F.lit(x) for kv in FILES.items() for x in kv])
    rows = spark.read.text(paths).select("value", F.regexp_extract("_metadata.file_path", r"\.(noun|verb|adj|adv)$", 1).alias("file"))
    return rows.filter(~F.startswith("value", F.lit("  "))).select("value", F.try_element_at(letters, F.col("file")).alias("letter"))


def read_database(spark: SparkSession, folder: str, lexicon: str) -> Lexicon:
    """The files data.noun ... index.adv of a folder, in the format of wndb(5). Synsets are called lemma.pos.number, by their
    first word and its sense number, as sense annotations call them."""
    at = lambda i: F.get("t", i)
    split = _lines(spark, [f"{folder}/data.{f}" for f in FILES]).select("letter", F.split("value", r" \| ?", 2).alias("v"))
    fields = split.select("letter", F.split(F.get("v", 0), " +").alias("t"), F.coalesce(F.get("v", 1), F.lit("")).alias("gloss"))
    fields = fields.withColumn("n_words", F.conv(at(F.lit(3)), 16, 10).try_cast("int")).withColumn("n_pointers", at(4 + 2 * F.col("n_words")).try_cast("int"))
    word = lambda i: F.regexp_replace(F.get("t", 4 + 2 * i), r"\((?:a|p|ip)\)$", "")  # noqa: E731  markers of adjectives' places
    pointer = lambda i: F.struct(*[F.get("t", 5 + 2 * F.col("n_words") + 4 * i + k).alias(c) for k, c in enumerate(("symbol", "offset", "letter"))])
    each = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), f))
    definition = F.regexp_replace(F.btrim(F.regexp_replace("gloss", '"[^"]*"', ""), F.lit("; ")), r"\s+", " ")
    data = fields.select("letter", at(F.lit(0)).alias("offset"), at(F.lit(2)).alias("kind"), each(F.col("n_words"), word).alias("words"), each(F.col("n_pointers"), pointer).alias("pointers"), definition.alias("definition"))
    indexed = _lines(spark, [f"{folder}/index.{f}" for f in FILES]).select("letter", F.split(F.rtrim("value"), " +").alias("t"))
    offsets = indexed.select("letter", F.get("t", 0).alias("lemma"), F.slice("t", F.size("t") - F.get("t", 2).try_cast("int") + 1, F.get("t", 2).try_cast("int")).alias("offsets"))
    senses = offsets.select("letter", _lemma(F.col("lemma")).alias("lemma"), F.posexplode("offsets").alias("rank", "offset")).withColumn("rank", F.col("rank") + 1)
    first = data.select("letter", "offset", "kind", "definition", "pointers", F.get("words", 0).alias("name"))
    numbered = first.join(senses.withColumnRenamed("lemma", "_l"), ["letter", "offset"]).filter(_lemma(F.col("name")) == F.col("_l"))
    synset = F.concat_ws(".", "_l", "kind", F.format_string("%02d", "rank"))
    synsets = numbered.select("letter", "offset", synset.alias("synset_id"), _pos(F.col("kind")).alias("pos"), "name", "definition", "pointers")
    held = senses.join(synsets, ["letter", "offset"]).filter("definition <> ''").select("lemma", "pos", F.col("rank").cast("int").alias("rank"), "synset_id", "definition")
    up = synsets.select("synset_id", F.explode("pointers").alias("p")).filter(F.col("p.symbol").isin("@", "@i"))
    up = up.select("synset_id", F.when(F.col("p.letter") == "s", "a").otherwise(F.col("p.letter")).alias("letter"), F.col("p.offset").alias("offset"))
    edges = up.join(synsets.select("letter", "offset", F.col("synset_id").alias("hypernym_id")), ["letter", "offset"]).select("synset_id", "hypernym_id").distinct()
    return _tagged(lexicon, held, edges, synsets.select("synset_id", "pos"), synsets.select("synset_id", "name"))


_RELATION = "array<struct<_relType:string,_target:string>>"


def read_lmf(spark: SparkSession, path: str, lexicon: str) -> Lexicon:
    """An XML file of one lexicon in the WordNet-LMF format, cut into its entries and synsets by Spark's own reader."""
    part = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    entries = part("LexicalEntry", "_id string, Lemma struct<_writtenForm:string,_partOfSpeech:string>, Sense array<struct<_id:string,_synset:string>>")
    synsets = part("Synset", f"_id string, _partOfSpeech string, _members string, Definition array<string>, SynsetRelation {_RELATION}")
    found = entries.select("_id", F.col("Lemma._writtenForm").alias("form"), F.col("Lemma._partOfSpeech").alias("letter"), F.posexplode("Sense").alias("at", "sense"))
    known = synsets.select(F.col("_id").alias("synset_id"), F.col("_partOfSpeech").alias("kind"), F.trim(F.get("Definition", 0)).alias("definition"), "SynsetRelation", F.get(F.split("_members", " +"), 0).alias("member"))
    senses = found.select("_id", "form", _lemma(F.col("form")).alias("lemma"), "letter", "at", F.col("sense._synset").alias("synset_id"), F.col("sense._id").alias("sense_id")).join(known.drop("member"), "synset_id")
    satellite = F.col("letter") == "s"
    one = senses.withColumn("pos", _pos(F.col("letter"))).filter(F.coalesce("definition", F.lit("")) != "").groupBy("lemma", "pos", "synset_id", "definition").agg(F.min(F.struct(satellite.alias("s"), "_id", "at")).alias("o"))
    held = one.withColumn("rank", F.row_number().over(Window.partitionBy("lemma", "pos").orderBy("o", "synset_id")).cast("int")).select("lemma", "pos", "rank", "synset_id", "definition")
    first = known.select("synset_id", "member").join(senses.select("synset_id", "_id", "sense_id", "form"), "synset_id")
    own = (F.col("member") == F.col("_id")) | (F.col("member") == F.col("sense_id"))
    names = first.groupBy("synset_id").agg(F.coalesce(F.min(F.when(own, F.col("form"))), F.min_by("form", "_id")).alias("name"))
    edges = known.select("synset_id", F.explode("SynsetRelation").alias("r")).filter(F.col("r._relType").isin(*UPWARDS)).select("synset_id", F.col("r._target").alias("hypernym_id")).distinct()
    return _tagged(lexicon, held, edges, known.select("synset_id", _pos(F.col("kind")).alias("pos")), names.select("synset_id", F.replace("name", F.lit(" "), F.lit("_")).alias("name")))


def _tagged(lexicon: str, *tables: DataFrame) -> Lexicon:
    return Lexicon(*[t.withColumn("lexicon", F.lit(lexicon)) for t in tables])
