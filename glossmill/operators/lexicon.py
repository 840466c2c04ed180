"""A sense inventory as a table: lookups, snapping glosses to senses, the gloss checker, confusability of senses.

lexicon(lemma, pos, rank, synset_id, definition) holds one row per sense, in the inventory's order. Two lexicons are never
mixed: an operator takes the one it is given. Adjective satellites belong to the adjectives of their lemma.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut, never_broadcast, spread
from .choice import by_tokens


def one_lexicon(*tables: DataFrame) -> None:
    """Raise if rows of two lexicons meet, in one table or in several. Tables without a column `lexicon` say nothing."""
    found = None
    for table in tables:
        if "lexicon" in table.columns:
            names = table.select("lexicon").distinct()
            found = names if found is None else found.unionByName(names).distinct()
    names = [] if found is None else sorted(str(r[0]) for r in found.limit(2).collect())
    if len(names) > 1:
        raise ValueError(f"two lexicons meet: {', '.join(names)}")


LEVELS = ("siblings", "near", "far", "unrelated", "cross-pos")


def normal_lexicon(lexicon: DataFrame) -> DataFrame:
    """Lemma keys with underscores, satellites under adjectives."""
    pos = F.when(F.col("pos").isin("a", "s", "adj"), "adj").otherwise(F.col("pos"))
    return lexicon.withColumns({"lemma": F.lower(T.lemma_key(F.col("lemma"))), "pos": pos})


def inventory(lexicon: DataFrame) -> DataFrame:
    """lemma, pos, senses: distinct definitions in order."""
    one_lexicon(lexicon)
    pairs = F.array_sort(F.collect_list(F.struct("rank", "definition")))
    return lexicon.groupBy("lemma", "pos").agg(F.array_distinct(F.transform(pairs, lambda x: x["definition"])).alias("senses"))


def definition_of(df: DataFrame, lexicon: DataFrame, synset: str, into: str) -> DataFrame:
    """The definition of a synset column; null for synsets that don't resolve."""
    one_lexicon(lexicon)
    known = lexicon.groupBy(F.col("synset_id").alias(synset)).agg(F.min_by("definition", "rank").alias(into))
    return df.join(known, synset, "left")


def snap(glosses: DataFrame, lexicon: DataFrame, by: list[str]) -> DataFrame:
    """glosses(*by, lemma, pos, gloss) -> *by, synset_id, score, n_synsets: the sense with the highest token F1, first on ties.

    As specified, a gloss without any common token snaps to the first sense with score 0.
    """
    one_lexicon(lexicon)
    asked = glosses.select(*by, "lemma", "pos", T.content_set(F.col("gloss"), T.SHORT_STOPLIST).alias("_tokens"))
    senses = lexicon.select("lemma", "pos", "rank", "synset_id", T.content_set(F.col("definition"), T.SHORT_STOPLIST).alias("_tokens"))
    return by_tokens(asked, senses, by, ["lemma", "pos"], ["rank", "synset_id"]).select(*by, "synset_id", "score", F.col("n_options").alias("n_synsets"))


def check_glosses(rows: DataFrame, lexicon: DataFrame, by: list[str], min_anchor: float = 0.0, strict: bool = False) -> DataFrame:
    """rows(*by, lemma, pos, sense1, sense2, label) -> *by, n_synsets, synset1, synset2, anchored, wn_same, reason (null: pass).

    Blank or missing glosses and unknown lemmas pass.
    """
    keyed = rows.withColumns({"lemma": F.lower(T.lemma_key(F.col("lemma")))})
    usable = keyed.filter((F.coalesce(T.strip_space(F.col("sense1")), F.lit("")) != "") & (F.coalesce(T.strip_space(F.col("sense2")), F.lit("")) != ""))
    sides = usable.select(*by, "lemma", "pos", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("sense1").alias("gloss")), F.struct(F.lit(2).alias("side"), F.col("sense2").alias("gloss")))).alias("g")).select(
        *by, "lemma", "pos", "g.side", "g.gloss"
    )
    found = snap(sides, lexicon, [*by, "side"]).groupBy(*by).agg(
        F.max("n_synsets").alias("n_synsets"), F.max(F.when(F.col("side") == 1, F.col("synset_id"))).alias("synset1"), F.max(F.when(F.col("side") == 2, F.col("synset_id"))).alias("synset2"),
        F.min("score").alias("anchored"),
    )
    out = spread(rows.select(*by, "label"), *by).join(never_broadcast(found), by, "left").withColumn("wn_same", F.col("synset1") == F.col("synset2"))
    reason = F.when(F.col("anchored") < min_anchor, "gloss_unanchored").when(F.col("wn_same") & ~F.col("label"), "wn_merged_diff_label")
    if strict:
        reason = reason.when(~F.col("wn_same") & F.col("label"), "wn_split_same_label")
    return out.withColumn("reason", F.when(F.col("synset1").isNotNull(), reason))


def ancestors(edges: DataFrame, most: int = 40) -> DataFrame:
    """edges(synset_id, hypernym_id) -> synset_id, ancestor, depth (shortest, 0 for itself), by iterated joins."""
    one_lexicon(edges)
    known = edges.select("synset_id").union(edges.select("hypernym_id")).distinct().select("synset_id", F.col("synset_id").alias("ancestor"), F.lit(0).alias("depth"))
    front, all_of = known, known
    for depth in range(1, most):
        step = front.join(never_broadcast(edges.select(F.col("synset_id").alias("ancestor"), "hypernym_id")), "ancestor").select("synset_id", F.col("hypernym_id").alias("ancestor"), F.lit(depth).alias("depth")).distinct()
        front = cut(step.join(never_broadcast(all_of.select("synset_id", "ancestor")), ["synset_id", "ancestor"], "left_anti"))
        if front.isEmpty():
            break
        all_of = all_of.unionByName(front)
    return all_of


def depths(edges: DataFrame, most: int = 40) -> DataFrame:
    """edges(synset_id, hypernym_id) -> synset_id, height: the longest way down to it from a synset without hypernyms."""
    roots = edges.select(F.col("hypernym_id").alias("synset_id")).distinct().join(never_broadcast(edges.select("synset_id").distinct()), "synset_id", "left_anti")
    front = roots.withColumn("height", F.lit(0))
    all_of = front
    for height in range(1, most):
        step = edges.join(never_broadcast(front.select(F.col("synset_id").alias("hypernym_id"))), "hypernym_id", "left_semi").select("synset_id").distinct()
        front = cut(step.withColumn("height", F.lit(height)))
        if front.isEmpty():
            break
        all_of = all_of.unionByName(front)
    return all_of.groupBy("synset_id").agg(F.max("height").alias("height"))


def _common_hypernyms(pairs: DataFrame, closure: DataFrame, heights: DataFrame) -> DataFrame:
    """pairs(s1, s2) -> s1, s2, lowest(h, ancestor, d1, d2), distance; no row for pairs without a common hypernym.

    The lowest is the one deepest in the hierarchy, of several the smallest id.
    """
    one = closure.select(F.col("synset_id").alias("s1"), "ancestor", F.col("depth").alias("d1"))
    two = closure.select(F.col("synset_id").alias("s2"), "ancestor", F.col("depth").alias("d2"))
    deep = heights.select(F.col("synset_id").alias("ancestor"), "height")
    both = pairs.join(never_broadcast(one), "s1").join(never_broadcast(two), ["s2", "ancestor"]).join(never_broadcast(deep), "ancestor", "left")
    lowest = F.min(F.struct((-F.coalesce("height", F.lit(0))).alias("h"), "ancestor", "d1", "d2")).alias("lowest")
    return both.groupBy("s1", "s2").agg(lowest, F.min(F.col("d1") + F.col("d2")).alias("distance"))


def genus(pairs: DataFrame, closure: DataFrame, heights: DataFrame, pos_of: DataFrame, names: DataFrame) -> DataFrame:
    """pairs(s1, s2) -> s1, s2, genus: the name of their lowest common hypernym; null if they have none, or if their parts of
    speech differ or aren't known. names(synset_id, name) holds each synset's first lemma."""
    one_lexicon(pos_of, names)
    p = pairs.select("s1", "s2").distinct()
    known = p.join(never_broadcast(pos_of.select(F.col("synset_id").alias("s1"), F.col("pos").alias("pos1"))), "s1").join(never_broadcast(pos_of.select(F.col("synset_id").alias("s2"), F.col("pos").alias("pos2"))), "s2")
    found = _common_hypernyms(known.filter("pos1 = pos2").select("s1", "s2"), closure, heights).select("s1", "s2", F.col("lowest.ancestor").alias("synset_id"))
    named = found.join(never_broadcast(names.select("synset_id", F.replace("name", F.lit("_"), F.lit(" ")).alias("genus"))), "synset_id", "left").select("s1", "s2", "genus")
    return p.join(never_broadcast(named), ["s1", "s2"], "left")


def confusability(pairs: DataFrame, closure: DataFrame, pos_of: DataFrame, heights: DataFrame) -> DataFrame:
    """pairs(s1, s2) -> level: null if unresolved, cross-pos, siblings, near (distance up to 4), far or unrelated.

    Siblings share a direct hypernym that is their lowest common one: of their common hypernyms the one deepest in the
    hierarchy, by `depths`; of several the smallest id counts. The distance is that by the nearest common hypernym.
    """
    p = pairs.select("s1", "s2").distinct()
    p = p.join(never_broadcast(pos_of.select(F.col("synset_id").alias("s1"), F.col("pos").alias("pos1"))), "s1", "left").join(never_broadcast(pos_of.select(F.col("synset_id").alias("s2"), F.col("pos").alias("pos2"))), "s2", "left")
    common = _common_hypernyms(p, closure, heights).withColumnRenamed("lowest", "c")
    level = (
        F.when(F.col("pos1").isNull() | F.col("pos2").isNull(), None).when(F.col("pos1") != F.col("pos2"), "cross-pos").when(F.col("c").isNull(), "unrelated")
        .when((F.col("c.d1") == 1) & (F.col("c.d2") == 1), "siblings").when(F.col("distance") <= 4, "near").otherwise("far")
    )
    return p.join(never_broadcast(common), ["s1", "s2"], "left").select("s1", "s2", level.alias("level"))


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level)
