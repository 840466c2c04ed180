"""Rules for reasoning traces: one pass of native columns per slot, the first rule that hits is the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text as T
from ..plans.prompts import JUDGE, JUDGE_AXES

MIN_CHARS, MAX_CHARS, MIN_TTR, TTR_MIN_WORDS = 100, 5000, 0.25, 50


def rule_check(text: Column, bare: Column | None = None) -> Column:
    """null, empty, non_english, too_short, too_long or repetitive; null if a trace passes. Lengths are of the stripped text,
    which may be given. Words are counted in one fold, and only where no rule before hits."""
    bare = T.strip_space(text) if bare is None else bare
    size = F.char_length(bare)
    few = lambda words: (F.size(words) >= TTR_MIN_WORDS) & (F.size(F.array_distinct(words)) < MIN_TTR * F.size(words))
    repetitive = F.element_at(F.transform(F.array(T.split_space(text)), few), 1)  # the words are split once
    return (
        F.when(text.isNull(), "null").when(size == 0, "empty").when(T.is_non_latin(bare), "non_english").when(size < MIN_CHARS, "too_short").when(size > MAX_CHARS, "too_long")
        .when(repetitive, "repetitive")
    )


def vote_check(vote: Column, label: Column) -> Column:
    """no_vote or wrong_prediction."""
    return F.when(vote.isNull(), "no_vote").when(vote != F.coalesce(label, F.lit(False)), "wrong_prediction")


def sense_check(answer: Column, label: Column, strict: bool = False) -> Column:
    """A gloss pair that contradicts the gold label; answer is a `functions.answers.parsed` struct of
    the whole text (prose around an object isn't JSON), unparsed answers pass."""
    usable = answer["ok"] & F.array_contains(answer["keys"], "sense1") & F.array_contains(answer["keys"], "sense2")
    same = T.normal_gloss(answer["sense1"]) == T.normal_gloss(answer["sense2"])
    gold = F.coalesce(label, F.lit(False))
    check = F.when(usable & same & ~gold, "same_gloss_diff_label")
    return check.when(usable & ~same & gold, "diff_gloss_same_label") if strict else check


def check_slots(slots: DataFrame, strict: bool = False) -> DataFrame:
    """slots(reasoning, vote, answer, label, ...) with `reason`: the first of the rule, vote and sense checks that hits."""
    bare = slots.withColumn("_bare", T.strip_space(F.col("reasoning")))
    cheap = bare.withColumn("_cheap", F.coalesce(rule_check(F.col("reasoning"), F.col("_bare")), vote_check(F.col("vote"), F.col("label")))).drop("_bare")
    parsed = cheap.withColumn("_answer", A.parsed(F.when(F.col("_cheap").isNull(), F.col("answer")), whole=True))  # Python sees survivors only
    return parsed.withColumn("reason", F.coalesce("_cheap", sense_check(F.col("_answer"), F.col("label"), strict))).drop("_cheap", "_answer")


def count_reasons(checked: DataFrame) -> DataFrame:
    """Rejected slots by reason, most first. A filter on the reason itself would be pushed down, and run the rules a second time."""
    return checked.groupBy("reason").agg(F.count("reason").alias("n")).filter("n > 0").orderBy(F.desc("n"), "reason")


def judge_prompt(lemma: Column, pos: Column, sentence1: Column, sentence2: Column, label: Column, answer: Column, reasoning: Column, past_end: Column | None = None) -> Column:
    """The grading prompt of a slot; a slot past the end of the answers has "(none)", a null answer within is "None"."""
    shown = F.coalesce(answer, F.lit("None")) if past_end is None else F.when(past_end, "(none)").otherwise(F.coalesce(answer, F.lit("None")))
    values = {
        "lemma": lemma, "pos": pos, "sentence1": sentence1, "sentence2": sentence2, "answer": shown, "reasoning": reasoning,
        "gold": F.when(F.coalesce(label, F.lit(False)), "True").otherwise("False"),
    }
    parts, rest = [], JUDGE
    for name in ("lemma", "pos", "sentence1", "sentence2", "gold", "answer", "reasoning"):
        head, rest = rest.split("{" + name + "}", 1)
        parts += [F.lit(head), values[name]]
    return F.concat(*parts, F.lit(rest))


def keep_by_axes(scores: Column, require: tuple[str, ...] = JUDGE_AXES) -> Column:
    """Whether all required axes are true; missing axes and unparsed verdicts are false."""
    kept = F.lit(True)
    for axis in require:
        kept = kept & F.coalesce(F.try_element_at(scores, F.lit(axis)), F.lit(False))
    return kept


def final_verdicts(checked: DataFrame, judged: DataFrame | None, on: list[str], require: tuple[str, ...] = JUDGE_AXES) -> DataFrame:
    """stage, keep, reason, scores of every slot: rules first, then the judge; slots that no judge saw are rejected as such.

    Without a judge, slots that pass the rules are kept. Extra judgements of one slot must already be reduced to one.
    """
    none = F.lit(None).cast("map<string,boolean>")
    if judged is None:
        passed = F.col("reason").isNull()
        return checked.select(*on, F.lit("rule").alias("stage"), passed.alias("keep"), F.coalesce("reason", F.lit("passed_rules")).alias("reason"), none.alias("scores"))
    both = checked.select(*on, "reason").join(judged.select(*on, "scores", F.lit(True).alias("_seen")), on, "left")
    by_rule, good = F.col("reason").isNotNull(), keep_by_axes(F.col("scores"), require)
    return both.select(
        *on,
        F.when(by_rule, "rule").otherwise("judge").alias("stage"),
        (~by_rule & F.coalesce("_seen", F.lit(False)) & good).alias("keep"),
        F.when(by_rule, F.col("reason")).when(F.col("_seen").isNull(), "not_judged").when(F.col("scores").isNull(), "unparseable_verdict").otherwise("judged").alias("reason"),
        F.when(~by_rule, F.col("scores")).alias("scores"),
    )


def axis_failures(judged: DataFrame, axes: tuple[str, ...] = JUDGE_AXES) -> DataFrame:
    """Failures by axis among verdicts that parsed, and the kept rate among all, one row; rates of an empty table are null."""
    failed = [F.count_if(F.col("scores").isNotNull() & ~F.coalesce(F.try_element_at("scores", F.lit(a)), F.lit(False))).alias(f"failed_{a}") for a in axes]
    return judged.agg(*failed, F.try_divide(F.count_if(keep_by_axes(F.col("scores"), axes)).cast("double"), F.count(F.lit(1)).cast("double")).alias("kept_rate"))


def annotate(slots: DataFrame, verdicts: DataFrame, record: list[str], slot: str = "slot") -> DataFrame:
    """Per record: reasoning_quality in slot order and n_good_reasonings. The latest stage's verdict of a slot counts."""
    one = verdicts.groupBy(*record, slot).agg(F.max_by(F.struct("keep", "reason", "scores"), F.col("stage") == "judge").alias("v"))
    joined = slots.join(one, [*record, slot], "left")
    entry = F.struct(F.col(slot).alias("at"), F.coalesce(F.col("v.keep"), F.lit(False)).alias("keep"), F.col("v.reason").alias("reason"), F.col("v.scores").alias("scores"))
    ordered = F.array_sort(F.collect_list(entry), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0))
    grouped = joined.groupBy(*record).agg(ordered.alias("q"))
    quality = F.transform("q", lambda x: F.struct(x["keep"].alias("keep"), x["reason"].alias("reason"), x["scores"].alias("scores")))
    return grouped.select(*record, quality.alias("reasoning_quality"), F.size(F.filter("q", lambda x: x["keep"])).alias("n_good_reasonings"))


def prune_slots(records: DataFrame, slots: str = "slots") -> DataFrame:
    """Records with at least one kept slot, other slots removed; slots are structs, so answers stay beside their traces."""
    kept = F.filter(slots, lambda s: F.coalesce(s["keep"], F.lit(False)))
    return records.withColumn(slots, kept).filter(F.size(slots) > 0)
