"""Answer objects: strict JSON after the last think block. Parsed once per row by one Arrow UDF, read by native columns."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import W, answer_region, strip_space

KEYS = ("same_sense", "sense1", "sense2")
PARSED = "struct<ok:boolean,keys:array<string>,sense1:string,sense2:string,text1:boolean,text2:boolean,kind:string,truthy:boolean>"


def parse_answer(text: str | None, whole: bool = False) -> dict | None:
    """The object after the last closing think tag, or (whole) the text itself, by the rules of strict JSON; else None."""
    if text is None:
        return None
    if whole:
        try:
            made = json.loads(text)
        except ValueError:
            return None
        return made if isinstance(made, dict) else None
    rest = text.rpartition("</think>")[2]
    found = None if "<think>" in rest else re.search(r"\{.*\}", rest, re.S)
    if not found:
        return None
    try:
        made = json.loads(found[0])
    except ValueError:
        return None
    return made if isinstance(made, dict) else None


def _summary(made: dict | None) -> dict:
    if made is None:
        return dict.fromkeys(("ok", "keys", "sense1", "sense2", "text1", "text2", "kind", "truthy")) | {"ok": False}
    verdict = made.get("same_sense")
    kind = "missing" if "same_sense" not in made else "bool" if isinstance(verdict, bool) else "null" if verdict is None else type(verdict).__name__
    one, two = made.get("sense1", ""), made.get("sense2", "")
    return {
        "ok": True, "keys": sorted(made), "sense1": str(one).strip(), "sense2": str(two).strip(), "text1": isinstance(one, str) and bool(one.strip()),
        "text2": isinstance(two, str) and bool(two.strip()), "kind": kind, "truthy": None if kind == "missing" else bool(verdict),
    }


def parsed(text: Column, whole: bool = False) -> Column:
    """struct(ok, keys, sense1, sense2, text1, text2, kind, truthy) of an answer; compute it once per row."""
    @F.pandas_udf(PARSED)
    def parse(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_summary(parse_answer(v, whole)) for v in values], columns=["ok", "keys", "sense1", "sense2", "text1", "text2", "kind", "truthy"])

    return parse(text)


def extract_object(body: Column) -> Column:
    """The text from the first brace to the last, without code fences (plain ones, or labelled json in small letters); the whole
    body if there are none."""
    bare = strip_space(F.regexp_replace(F.regexp_replace(strip_space(body), "^(?:```json)?(?:```)?", ""), r"```\z", ""))
    return F.when(bare.rlike(r"(?s)\{.*\}"), F.regexp_extract(bare, r"(?s)(\{.*\})", 1)).otherwise(bare)


def verdict(text: Column, answer: Column) -> Column:
    """The verdict of an answer: the object's, by truthiness, else the first of the words same and different; null if open."""
    rest = F.element_at(F.split(text, "</think>"), -1)
    word = F.lower(F.regexp_extract(rest, rf"(?i)(?<!{W})(same|different)(?!{W})", 1))
    return F.when(answer["ok"] & answer["truthy"].isNotNull(), answer["truthy"]).when(~F.contains(rest, F.lit("<think>")) & (word != ""), word == "same")


def exact_keys(answer: Column) -> Column:
    return F.coalesce(answer["keys"] == F.array(*[F.lit(k) for k in KEYS]), F.lit(False))


def has_region(text: Column) -> Column:
    return answer_region(text) != ""


def dump_answer(sense1: Column, sense2: Column, label: Column) -> Column:
    """The answer object as JSON with spaces after separators and ASCII escapes."""
    @F.pandas_udf("string")
    def dump(one: pd.Series, two: pd.Series, same: pd.Series) -> pd.Series:
        return pd.Series([json.dumps({"sense1": a or "", "sense2": b or "", "same_sense": bool(c)}) for a, b, c in zip(one, two, same, strict=True)])

    return dump(sense1, sense2, label)


def judge_scores(raw: Column) -> Column:
    """map<string, boolean> of a judge's reply: the truthiness of every value of a JSON object, whatever its keys. Null for a
    null reply, and for one that isn't an object of strict JSON from end to end."""

    @F.pandas_udf("map<string,boolean>")
    def scores(replies: pd.Series) -> pd.Series:
        made = (parse_answer(r, whole=True) for r in replies)
        return pd.Series([None if m is None else {k: bool(v) for k, v in m.items()} for m in made], dtype=object)

    return scores(strip_space(raw))
