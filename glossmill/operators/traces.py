"""Teacher traces: candidates, selection, chat rendering."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text as T
from ..plans.prompts import STUDENT_TAIL, SYSTEM, TEACHER_TAIL
from ..plans.schemas import PAIR_KEY


def as_bool(label: Column) -> Column:
    """Labels come as booleans or numbers: true, 1 and 1.0 are true."""
    return F.lower(label.cast("string")).isin("true", "1", "1.0")


def pair_key() -> Column:
    return F.struct(*PAIR_KEY)


def teacher_correct(records: DataFrame) -> DataFrame:
    """Records whose prediction is the label."""
    return records.filter(F.col("prediction").isNotNull() & F.col("label").isNotNull() & (F.col("prediction") == F.col("label")))


def candidates(records: DataFrame) -> DataFrame:
    """One row per usable slot: its answer parses, agrees with the prediction, and its trace is not blank.

    records(prediction, answers, reasonings, ...): slots past the end of the shorter array don't exist.
    """
    length = F.least(F.size("answers"), F.size("reasonings"))
    slots = F.slice(F.arrays_zip("answers", "reasonings"), F.lit(1), F.greatest(length, F.lit(0)))
    rows = records.select("*", F.posexplode(slots).alias("slot", "_s")).withColumns({"answer": F.col("_s.answers"), "think": T.strip_space(F.col("_s.reasonings"))}).drop("_s", "answers", "reasonings")
    rows = rows.filter((F.col("think") != "") & F.col("answer").isNotNull()).withColumn("_a", A.parsed(F.col("answer"), whole=True))
    kept = rows.filter(F.col("_a.ok") & F.col("_a.truthy").isNotNull() & (F.col("_a.truthy") == F.col("prediction")))
    return kept.withColumns({"sense1": F.col("_a.sense1"), "sense2": F.col("_a.sense2")}).drop("_a", "answer")


def select_one(rows: DataFrame, by: list[str], strategy: str = "first") -> DataFrame:
    """One candidate of each record: the first slot, or the longest trace (earliest on ties)."""
    if strategy not in ("first", "longest"):
        raise ValueError(f"unknown strategy: {strategy}")
    order = [F.col("slot")] if strategy == "first" else [F.desc(F.char_length("think")), F.col("slot")]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def messages(record: dict[str, Column], target: bool = False) -> Column:
    """Chat messages of a pair: system, user and, with target, the assistant's think block and answer."""
    user = F.concat(
        F.lit("Target word: "), record["lemma"], F.lit(" ("), record["pos"], F.lit(")\n\nSentence 1: "), record["usage1"], F.lit("\nSentence 2: "), record["usage2"], F.lit("\n\n" + STUDENT_TAIL)
    )
    turns = [("system", F.lit(SYSTEM)), ("user", user)]
    if target:
        turns.append(("assistant", F.concat(T.think_block(record["think"]), F.lit("\n"), A.dump_answer(record["sense1"], record["sense2"], record["label"]))))
    return F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in turns])


BUILDERS = {"wic": messages}


def build_messages(task: Column, record: dict[str, Column], target: bool = False) -> Column:
    """Messages by task tag; an unknown task raises."""
    out = None
    for name, builder in BUILDERS.items():
        made = builder(record, target)
        out = F.when(task == name, made) if out is None else out.when(task == name, made)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown task: "), task)))


def teacher_messages(lemma: Column, pos: Column, word1: Column, sentence1: Column, word2: Column, sentence2: Column) -> Column:
    """The sampling prompt: another template and another marker."""
    user = F.concat(
        F.lit("Lemma: "), lemma, F.lit("\nPOS: "), pos, F.lit('\n\nSentence 1: "'), T.mark_safe(word1, sentence1), F.lit('"\nSentence 2: "'), T.mark_safe(word2, sentence2),
        F.lit('"\n\n' + TEACHER_TAIL),
    )
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def chat_text(turns: Column, template: Callable[[list[dict[str, str]]], str]) -> Column:
    """Chats as a model's own template writes them; the template is injected, a function of a list of {role, content}."""
    @F.pandas_udf("string")
    def write(chats: pd.Series) -> pd.Series:
        return pd.Series([None if chat is None else template([{"role": t["role"], "content": t["content"]} for t in chat]) for chat in chats], dtype=object)

    return write(turns)


def prompt_completion(turns: Column) -> Column:
    """struct(prompt, completion): all turns but the last, and the last."""
    return F.struct(F.slice(turns, 1, F.size(turns) - 1).alias("prompt"), F.slice(turns, -1, 1).alias("completion"))


def completion_text(completion: Column) -> Column:
    """The text of a chat completion (an array of turns)."""
    return F.get(completion, 0)["content"]


def teacher_row(rows: DataFrame, output: str = "output") -> DataFrame:
    """Model outputs in the teacher schema: single-element arrays, empty where the output doesn't parse or is left open."""
    answer = A.parsed(F.col(output))
    rows = rows.withColumn("_a", answer)
    closed = ~F.contains(F.element_at(F.split(F.col(output), "</think>"), -1), F.lit("<think>"))
    label = F.when(closed, A.verdict(F.col(output), F.col("_a")))
    think = T.strip_space(F.replace(F.substring_index(F.col(output), "</think>", 1), F.lit("<think>"), F.lit("")))
    good = F.col("_a.ok") & closed
    empty = F.array().cast("array<string>")
    return rows.withColumns(
        {
            "prediction": label,
            "votes": F.when(label.isNotNull(), F.array(label)).otherwise(F.array().cast("array<boolean>")),
            "answers": F.when(good, F.array(A.dump_answer(F.col("_a.sense1"), F.col("_a.sense2"), F.col("_a.truthy")))).otherwise(empty),
            "reasonings": F.when(good, F.array(think)).otherwise(empty),
        }
    ).drop("_a")


def ballots(answers: Column) -> Column:
    """Votes of an array of answer texts, by JSON truthiness of the verdict; null where an answer has none."""
    @F.pandas_udf("array<boolean>")
    def read(values: pd.Series) -> pd.Series:
        def one(text: str | None) -> bool | None:
            made = A.parse_answer(text)
            return None if made is None or "same_sense" not in made else bool(made["same_sense"])

        return pd.Series([None if v is None else [one(x) for x in v] for v in values], dtype=object)

    return read(answers)


def sampled_rows(rows: DataFrame, outputs: str = "outputs", error: str = "error") -> DataFrame:
    """Teacher rows of sampled outputs: votes, their majority, answer objects and traces; failed rows keep only the error."""
    from .votes import vote

    failed = F.col(error).isNotNull()
    split = F.transform(F.col(outputs), T.split_think)
    good = rows.withColumns({"_parts": F.when(~failed, split)})
    good = good.withColumns(
        {"answers": F.transform("_parts", lambda p: A.extract_object(p["body"])), "reasonings": F.transform("_parts", lambda p: p["think"])}
    ).withColumn("votes", ballots(F.col("answers")))
    return good.withColumn("_v", vote(F.col("votes"))).withColumns({"prediction": F.when(~failed, F.col("_v.prediction")), "confidence": F.when(~failed, F.col("_v.confidence"))}).drop("_v", "_parts", outputs)


def parse_glosses(completion: Column) -> Column:
    """struct(gloss, filler_gloss, think) of one completion; glosses are empty where the answer doesn't parse."""
    answer = A.parsed(completion)
    think = T.strip_space(F.replace(F.substring_index(completion, "</think>", 1), F.lit("<think>"), F.lit("")))
    return F.struct(F.coalesce(answer["sense1"], F.lit("")).alias("gloss"), F.coalesce(answer["sense2"], F.lit("")).alias("filler_gloss"), think.alias("think"))


def build_records(sources: dict[str, DataFrame], ties: list[str], balanced: bool = False, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training records of all tasks, optionally half and half, and their counts by task."""
    from .corpus import balance, task_counts

    out = None
    for task, df in sources.items():
        part = (balance(df, "label", ties, seed) if balanced else df).withColumn("task", F.lit(task))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out, task_counts(out)
