"""Sense-annotated pairs: usages of one sense (label true) and of two senses of a lemma (label false)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .corpus import balance, hash_order
from .lexicon import level_rank

POS_MAP = {"NOUN": "noun", "VERB": "verb", "ADJ": "adj", "ADV": "adv"}


def usable_annotations(annotations: DataFrame, least_tokens: int = 5) -> DataFrame:
    """Annotations of a known part of speech with exactly one synset, in sentences of enough tokens."""
    pos = F.create_map(*[F.lit(x) for kv in POS_MAP.items() for x in kv])
    one = annotations.withColumn("pos", F.try_element_at(pos, F.col("pos"))).filter(F.col("pos").isNotNull() & (F.size("synsets") == 1))
    return one.withColumn("synset", F.get("synsets", 0)).drop("synsets").filter(F.size(T.split_space(F.col("text"))) >= least_tokens)


def hold_out(annotations: DataFrame, held_out: DataFrame) -> DataFrame:
    """Annotations whose lemma, regardless of case, isn't in a held-out table(lemma)."""
    blocked = held_out.select(F.lower("lemma").alias("_l")).distinct()
    return annotations.join(blocked, F.lower(annotations["lemma"]) == F.col("_l"), "left_anti")


_SIDE = ("text", "start", "end")


def _ordered(usages: DataFrame, salt: str, by: list[str]) -> DataFrame:
    return usages.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(hash_order("lemma", "pos", "synset", "text", "start", salt=salt), "text", "start")))


def same_pairs(usages: DataFrame, per_lemma: int = 4) -> DataFrame:
    """Pairs of usages of one synset: up to 2 * per_lemma usages of it in hash order, taken two by two, in different sentences,
    and at most per_lemma pairs of a lemma and part of speech."""
    picked = _ordered(usages, "same", ["lemma", "pos", "synset"]).filter(F.col("_n") <= 2 * per_lemma).withColumn("_pair", F.floor((F.col("_n") - 1) / 2))
    side = F.struct(*_SIDE)
    pairs = picked.groupBy("lemma", "pos", "synset", "_pair").agg(
        F.max(F.when(F.col("_n") % 2 == 1, side)).alias("u1"), F.max(F.when(F.col("_n") % 2 == 0, side)).alias("u2")
    )
    pairs = pairs.filter(F.col("u2").isNotNull() & (F.col("u1.text") != F.col("u2.text")))
    order = Window.partitionBy("lemma", "pos").orderBy(hash_order("lemma", "pos", "synset", "_pair", salt="cap"), "synset", "_pair")
    return pairs.withColumn("_c", F.row_number().over(order)).filter(F.col("_c") <= per_lemma).select("lemma", "pos", F.col("synset").alias("synset1"), F.col("synset").alias("synset2"), "u1", "u2")


def different_pairs(usages: DataFrame, levels: DataFrame | None = None, cutoff: str | None = None, per_lemma: int = 4) -> DataFrame:
    """Pairs of usages of two synsets of a lemma, most confusable synsets first, one usage of each by hash order.

    The pairs are made of distinct synsets, never of usages. The cap comes before the check for different sentences.
    """
    senses = usages.select("lemma", "pos", "synset").distinct()
    pairs = senses.alias("a").join(senses.alias("b"), ["lemma", "pos"]).filter("a.synset < b.synset").select("lemma", "pos", F.col("a.synset").alias("synset1"), F.col("b.synset").alias("synset2"))
    if levels is not None:
        pairs = pairs.join(levels.withColumnsRenamed({"s1": "synset1", "s2": "synset2"}), ["synset1", "synset2"]).filter(F.col("level").isNotNull()).withColumn("_rank", level_rank(F.col("level")))
        if cutoff is not None:
            pairs = pairs.filter(F.col("_rank") <= level_rank(F.lit(cutoff)))
    else:
        pairs = pairs.withColumn("_rank", F.lit(0))
    w = Window.partitionBy("lemma", "pos").orderBy("_rank", "synset1", "synset2")
    pairs = pairs.withColumn("_c", F.row_number().over(w)).filter(F.col("_c") <= per_lemma)
    one = _ordered(usages, "different", ["lemma", "pos", "synset"]).filter("_n = 1").select("lemma", "pos", "synset", F.struct(*_SIDE).alias("u"))
    u1, u2 = (one.withColumnsRenamed({"synset": f"synset{k}", "u": f"u{k}"}) for k in (1, 2))
    made = pairs.join(u1, ["lemma", "pos", "synset1"]).join(u2, ["lemma", "pos", "synset2"])
    return made.filter(F.col("u1.text") != F.col("u2.text")).select("lemma", "pos", "synset1", "synset2", "u1", "u2")


def annotate(pairs: DataFrame, lexicon: DataFrame, senses: DataFrame) -> DataFrame:
    """Gold-sense records of pairs: label, marked usages, glosses and the inventory that holds them."""
    known = lexicon.groupBy("synset_id").agg(F.min_by("definition", "rank").alias("d"))
    for k in (1, 2):
        pairs = pairs.join(known.select(F.col("synset_id").alias(f"synset{k}"), F.col("d").alias(f"_g{k}")), f"synset{k}", "left")
    pairs = pairs.join(senses, ["lemma", "pos"], "left")
    g1, g2 = (F.coalesce(f"_g{k}", F.lit("")) for k in (1, 2))
    blank = (F.col("synset1") != F.col("synset2")) & (g1 == g2)
    gloss1, gloss2 = (F.when(blank, "").otherwise(g) for g in (g1, g2))
    pairs = pairs.withColumns({"gloss1": gloss1, "gloss2": gloss2})
    held = F.coalesce("senses", F.array().cast("array<string>"))
    more = F.filter(F.array("gloss1", "gloss2"), lambda g: (g != "") & ~F.array_contains(held, g))
    mark = lambda k: T.mark_span(F.col(f"u{k}.text"), F.col(f"u{k}.start"), F.col(f"u{k}.end"))
    return pairs.select(
        "lemma", "pos", (F.col("synset1") == F.col("synset2")).alias("label"), F.col("u1.text").alias("sentence1"), F.col("u2.text").alias("sentence2"),
        mark(1).alias("usage1"), mark(2).alias("usage2"), "synset1", "synset2", "gloss1", "gloss2", F.concat(held, F.array_distinct(more)).alias("senses"),
    )


def build(annotations: DataFrame, lexicon: DataFrame, senses: DataFrame, held_out: DataFrame | None = None, levels: DataFrame | None = None, cutoff: str | None = None, per_lemma: int = 4, least_tokens: int = 5, balanced: bool = True) -> DataFrame:
    """The whole pair set: usable annotations, less held-out lemmas, same and different pairs, half and half."""
    usages = usable_annotations(annotations, least_tokens)
    if held_out is not None:
        usages = hold_out(usages, held_out)
    both = annotate(same_pairs(usages, per_lemma).unionByName(different_pairs(usages, levels, cutoff, per_lemma)), lexicon, senses)
    return balance(both, "label", ["lemma", "pos", "synset1", "synset2", "sentence1", "sentence2"]) if balanced else both


def coverage(pairs: DataFrame) -> DataFrame:
    """One row: pairs, share of label true, share that gloss rewards can score, mean and most senses."""
    scoreable = (F.col("gloss1") != "") & (F.col("gloss2") != "") & (F.size("senses") > 1)
    n = F.count(F.lit(1)).cast("double")
    return pairs.agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(F.count_if("label").cast("double"), n).alias("same_share"), F.try_divide(F.count_if(scoreable).cast("double"), n).alias("scoreable_share"),
        F.avg(F.size("senses")).alias("mean_senses"), F.max(F.size("senses")).alias("most_senses"),
    )


def coverage_report(pairs: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """part, value, n, same_share, scoreable_share, mean_senses, most_senses: one aggregation over all pairs (part `all`), by part of
    speech, by label, and by confusability of different pairs (levels(s1, s2, level), `unresolved` where it has none)."""
    rows = pairs
    if levels is not None:
        named = levels.select(F.col("s1").alias("synset1"), F.col("s2").alias("synset2"), "level").dropDuplicates(["synset1", "synset2"])
        rows = rows.join(named, ["synset1", "synset2"], "left")
    level = F.coalesce("level", F.lit("unresolved")) if levels is not None else F.lit("unresolved")
    scoreable = (F.col("gloss1") != "") & (F.col("gloss2") != "") & (F.size("senses") > 1)
    shaped = rows.select(
        F.coalesce("pos", F.lit("?")).alias("pos"), F.coalesce(F.col("label").cast("string"), F.lit("?")).alias("label"), F.when(F.col("label"), F.lit("same")).otherwise(level).alias("level"),
        F.coalesce(F.col("label"), F.lit(False)).cast("int").alias("same"), F.coalesce(scoreable, F.lit(False)).cast("int").alias("scoreable"), F.size("senses").alias("k"),
    )
    sets = [[], *[[F.col(c)] for c in ("pos", "label", "level")]]
    part = F.when(F.grouping("pos") == 0, "pos").when(F.grouping("label") == 0, "label").when(F.grouping("level") == 0, "level").otherwise("all")
    table = shaped.groupingSets(sets, "pos", "label", "level").agg(
        part.alias("part"), F.count(F.lit(1)).alias("n"), F.avg("same").alias("same_share"), F.avg("scoreable").alias("scoreable_share"), F.avg("k").alias("mean_senses"), F.max("k").alias("most_senses")
    )
    return table.select("part", F.coalesce("pos", "label", "level", F.lit("")).alias("value"), "n", "same_share", "scoreable_share", "mean_senses", "most_senses").filter("part <> 'level' OR value <> 'same'")


def leaked(pairs: DataFrame, held_out: DataFrame) -> DataFrame:
    """Lemmas of a pair set that are held out: must be empty."""
    return pairs.select(F.lower("lemma").alias("lemma")).intersect(held_out.select(F.lower("lemma").alias("lemma")))
