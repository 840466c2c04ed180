"""Rewards of completions. Each is a column over a completion and its parsed answer, which is parsed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text as T

#: Fixed values of the rewards.
CORRECT, WRONG, ABSENT = 1.0, -0.5, -1.0
PARSES, HAS_KEYS, HAS_BOOL, MALFORMED = 0.1, 0.1, 0.1, -0.2
INCONSISTENT, THINK_MIN_WORDS, THINK_PENALTY = -0.3, 6, -0.3
GLOSS_MAX, GLOSS_FULL_MARGIN = 0.15, 0.2

KEEP_COLS = ("lemma", "pos", "label", "gloss1", "gloss2", "senses")


def accuracy(completion: Column, answer: Column, label: Column) -> Column:
    said = A.verdict(completion, answer)
    return F.when(said.isNull(), ABSENT).when(said == label, CORRECT).otherwise(WRONG)


def form(completion: Column, answer: Column) -> Column:
    think = F.when(completion.rlike(r"(?s)<think>.+?</think>"), 0.1).otherwise(0.0)
    return think + F.when(A.verdict(completion, answer).isNotNull(), 0.1).otherwise(0.0)


def json_shape(completion: Column, answer: Column) -> Column:
    full = PARSES + F.when(A.exact_keys(answer), HAS_KEYS).otherwise(0.0) + F.when(answer["kind"] == "bool", HAS_BOOL).otherwise(0.0)
    return F.when(answer["ok"], full).when(A.has_region(completion), MALFORMED).otherwise(0.0)


def consistency(answer: Column) -> Column:
    """A same verdict costs with how much its glosses differ; a different one if they are the same tokens."""
    one, two = T.tokens(answer["sense1"]), T.tokens(answer["sense2"])
    usable = answer["ok"] & (answer["kind"] == "bool") & answer["text1"] & answer["text2"]
    asked = usable & answer["truthy"]
    ratio = T.sequence_ratio()(F.when(asked, one), F.when(asked, two))
    return F.when(asked, INCONSISTENT * (1 - ratio)).when(usable & (one == two), INCONSISTENT).otherwise(0.0)


def think_length(completion: Column, stop: list[str] | None = None) -> Column:
    return F.when(T.content_count(T.extract_think(completion), stop or T.STOPLIST) < THINK_MIN_WORDS, THINK_PENALTY).otherwise(0.0)


def gloss_margin(emitted: Column, gold: Column, senses: Column, stop: list[str]) -> Column:
    """Token F1 with the gold gloss less the best with any other sense; 0 if the emitted or the gold gloss has no content."""
    own, right = T.content_set(emitted, stop), T.content_set(gold, stop)
    rivals = F.filter(senses, lambda s: T.strip_space(s) != T.strip_space(gold))
    best = F.coalesce(F.array_max(F.transform(rivals, lambda s: T.set_f1_strict(own, T.content_set(s, stop)))), F.lit(0.0))
    return F.when((F.size(own) == 0) | (F.size(right) == 0), 0.0).otherwise(T.set_f1_strict(own, right) - best)


def gloss(answer: Column, gloss1: Column, gloss2: Column, senses: Column, stop: list[str] | None = None) -> Column:
    """The mean over scorable sides of the clamped margin."""
    stop = stop or T.STOPLIST
    senses = F.coalesce(senses, F.array().cast("array<string>"))
    sides = []
    for said, is_text, gold in ((answer["sense1"], answer["text1"], gloss1), (answer["sense2"], answer["text2"], gloss2)):
        margin = gloss_margin(said, gold, senses, stop)
        sides.append(F.when(is_text & (F.coalesce(gold, F.lit("")) != ""), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), margin / GLOSS_FULL_MARGIN))))
    scored = F.filter(F.array(*sides), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(scored, F.lit(0.0), lambda a, x: a + x), F.size(scored).cast("double"))
    return F.when(answer["ok"] & (F.size(senses) >= 2), GLOSS_MAX * F.coalesce(mean, F.lit(0.0))).otherwise(0.0)


REWARDS = {
    "accuracy": lambda r: accuracy(r["completion"], r["answer"], r["label"]),
    "format": lambda r: form(r["completion"], r["answer"]),
    "json": lambda r: json_shape(r["completion"], r["answer"]),
    "consistency": lambda r: consistency(r["answer"]),
    "think_length": lambda r: think_length(r["completion"]),
    "gloss": lambda r: gloss(r["answer"], r["gloss1"], r["gloss2"], r["senses"]),
}


def score(completions: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """completions(completion, label, gloss1, gloss2, senses, ...) with a reward_ column each and their weighted total."""
    weights = weights or dict.fromkeys(REWARDS, 1.0)
    rows = completions.withColumn("_answer", A.parsed(F.col("completion")))
    r = {k: F.col(k) for k in ("completion", "label", "gloss1", "gloss2", "senses")} | {"answer": F.col("_answer")}
    scored = rows.select(*completions.columns, *[REWARDS[k](r).alias(f"reward_{k}") for k in weights])
    total = sum((F.col(f"reward_{k}") * w for k, w in weights.items()), F.lit(0.0))
    return scored.withColumn("reward_total", total)


def repetition(text: Column, size: int = 3, most: float = -0.2) -> Column:
    """Penalty for repeated word n-grams: (1 - distinct / all) * most."""
    def of(words: Column) -> Column:
        n = F.size(words) - size + 1
        grams = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(words, i, size), " "))
        return F.when(n < 1, 0.0).otherwise((1 - F.size(F.array_distinct(grams)).cast("double") / n) * most)

    return F.element_at(F.transform(F.array(T.split_space(text)), of), 1)  # the words are split once


def overlong(length: Column, most: int, cache: int = 128, weight: float = 0.2) -> Column:
    """Soft punishment of long completions: none up to most - cache, then linear to -1."""
    return weight * F.when(length <= most - cache, 0.0).when(length > most, -1.0).otherwise((most - cache - length) / float(cache))


def advantage(rows: DataFrame, group: list[str], reward: str = "reward", scale: str | bool = "none") -> DataFrame:
    """Rewards less their group's mean. scale: `none`, `group` (over the group's standard deviation) or `batch` (over that of all
    rewards, one row that is joined on); a deviation of 0, or of a single reward, gives 0."""
    scale = {True: "group", False: "none"}.get(scale, scale)
    if scale not in ("none", "group", "batch"):
        raise ValueError(f"unknown scaling: {scale}")
    w = Window.partitionBy(*group)
    centred = F.col(reward) - F.avg(reward).over(w)
    if scale == "none":
        return rows.withColumn("advantage", centred)
    if scale == "group":
        return rows.withColumn("advantage", F.coalesce(F.try_divide(centred, F.stddev_samp(reward).over(w)), F.lit(0.0)))
    spread = rows.agg(F.stddev_samp(reward).alias("_spread"))  # one row
    return rows.join(F.broadcast(spread)).withColumn("advantage", F.coalesce(F.try_divide(centred, F.col("_spread")), F.lit(0.0))).drop("_spread")
