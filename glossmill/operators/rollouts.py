"""Rollout sets: prompts, hints, failure masks, dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.prompts import NO_MENTION, REPROMPT_TAIL, SOLUTION_HEAD
from .corpus import capped, hash_order
from .rewards import KEEP_COLS
from .traces import messages


def _truth(label: Column) -> Column:
    return F.when(label, "true").otherwise("false")


def gold_feedback(lemma: Column, label: Column) -> Column:
    """The gold verdict as a hint."""
    verdict = F.when(label, "the same sense").otherwise("different senses")
    return F.concat(F.lit('Hint: the two sentences use "'), lemma, F.lit('" in '), verdict, F.lit(', so the correct verdict is "same_sense": '), _truth(label), F.lit(f". {NO_MENTION}"))


def gloss_feedback(lemma: Column, label: Column, gloss1: Column, gloss2: Column, genus: Column | None = None) -> Column:
    """The gold glosses as a hint: one for a same pair, both and their genus for a different one; the verdict without glosses."""
    genus = F.lit(None).cast("string") if genus is None else genus
    tail = F.concat(F.lit(' The correct verdict is "same_sense": '), _truth(label), F.lit(f". {NO_MENTION}"))
    bare = F.concat(F.lit('Hint: the two sentences use "'), lemma, F.lit('" in '), F.when(label, "the same sense").otherwise("different senses"), F.lit("."))
    same = F.concat(F.lit('Hint: both sentences use "'), lemma, F.lit('" in the sense "'), gloss1, F.lit('".'))
    kinds = F.coalesce(F.concat(F.lit(" Both are kinds of "), F.replace(genus, F.lit("_"), F.lit(" ")), F.lit(", so the contrast is fine-grained.")), F.lit(""))
    apart = F.concat(F.lit('Hint: in sentence 1, "'), lemma, F.lit('" means "'), gloss1, F.lit('"; in sentence 2 it means "'), gloss2, F.lit('".'), kinds)
    return F.concat(F.when(gloss1.isNull() | gloss2.isNull(), bare).when(label, same).otherwise(apart), tail)


def prepare(source: DataFrame, hint: Column | None = None) -> DataFrame:
    """Prompt and the columns rewards read, with empty defaults, and optionally a privileged context."""
    has = set(source.columns)
    record = {k: F.col(k) for k in ("lemma", "pos", "usage1", "usage2")}
    defaults = {"gloss1": F.lit(""), "gloss2": F.lit(""), "senses": F.array().cast("array<string>")}
    kept = [(F.coalesce(F.col(c), defaults[c]) if c in has else defaults[c]).alias(c) if c in defaults else F.col(c) for c in KEEP_COLS]
    more = [] if hint is None else [F.coalesce(hint, F.lit("")).alias("privileged_context")]
    return source.select(*kept, messages(record).alias("prompt"), *more)


def build(sources: list[DataFrame], ties: list[str], cap: int | None = None, seed: int = 42) -> DataFrame:
    """Sources of one schema, each shuffled and capped before they are joined, then shuffled."""
    out = None
    for source in sources:
        part = source if cap is None else capped(source, cap, ties, seed)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("_h", hash_order(*ties, seed=seed)).orderBy("_h", *ties).drop("_h")


def failure_mask(mask: Column, reward: Column, threshold: float) -> Column:
    return F.when(reward < threshold, mask).otherwise(F.lit(0))


def reprompt(prompt: Column, solution: Column, feedback: Column) -> Column:
    """The self-distillation prompt; parts that are missing or blank are left out."""
    solved = F.when(F.coalesce(F.trim(solution), F.lit("")) != "", F.concat(F.lit(SOLUTION_HEAD), solution, F.lit("\n\n"))).otherwise("")
    hinted = F.when(F.coalesce(F.trim(feedback), F.lit("")) != "", F.concat(F.lit("\n"), feedback, F.lit("\n"))).otherwise("")
    return F.concat(prompt, solved, hinted, F.lit(REPROMPT_TAIL))


def dump(rows: DataFrame, every: int, order: list[str], first: int = 8) -> DataFrame:
    """The first rows of every N-th step."""
    w = Window.partitionBy("step").orderBy(*order)
    return rows.filter(F.col("step") % every == 0).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= first).drop("_n")


def correct_rollouts(rows: DataFrame, threshold: float, reward: str = "reward") -> DataFrame:
    return rows.filter(F.col(reward) >= threshold)


def check_batch(batch: int, group: int, devices: int = 1, accumulate: int = 1) -> int:
    """Prompts per step; a batch that groups don't divide raises."""
    total = batch * devices * accumulate
    if group < 2 or total % group:
        raise ValueError(f"a batch of {total} can't be cut into groups of {group}")
    return total // group
