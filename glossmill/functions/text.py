"""Text expressions. All are native columns, except the fuzzy half of `mark_target` and `sequence_ratio`."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters and white space as Unicode has them; the short forms \\w and \\s differ between engines.
W = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"

#: The characters of SPACE.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

#: The short stoplist of the gloss checker.
SHORT_STOPLIST = "a an the of to or and in for that is with by on as be it something someone".split()

#: This library's own default stoplist of content words in rewards, shorter than published ones. It is a parameter of every
#: function that uses it: a caller who must match scores made with another list passes that list.
STOPLIST = (
    "a about above after again against all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for "
    "from further had has have having he her here hers him his how i if in into is it its itself just may me might more most must my no nor not of off on once only or other our out "
    "over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who "
    "whom why will with would you your"
).split()

#: Scripts that are not Latin (kana, CJK, hangul, Cyrillic, Hebrew, Arabic).
NON_LATIN = r"[぀-ヿ㐀-䶿一-鿿가-힯Ѐ-ӿ֐-׿؀-ۿ]"


def tokens(text: Column) -> Column:
    """Lower-case word tokens, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({W}+)"), F.lit(1))


def split_space(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda x: x != "")


def strip_space(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def normal_gloss(gloss: Column) -> Column:
    """Lower case, single spaces, no dots at the end."""
    return F.regexp_replace(F.array_join(split_space(F.lower(gloss)), " "), r"\.+$", "")


def is_non_latin(text: Column) -> Column:
    return text.rlike(NON_LATIN)


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def content_set(text: Column, stop: list[str]) -> Column:
    """Distinct tokens outside a stoplist."""
    return F.array_except(F.array_distinct(tokens(text)), _words(stop))


def content_count(text: Column, stop: list[str]) -> Column:
    """Tokens outside a stoplist, repeats included."""
    return F.size(F.filter(tokens(text), lambda x: ~F.array_contains(_words(stop), x)))


def _f1(a: Column, b: Column) -> Column:
    return F.try_divide(2 * F.size(F.array_intersect(a, b)).cast("double"), (F.size(a) + F.size(b)).cast("double"))


def set_f1(a: Column, b: Column) -> Column:
    """Token F1 of two sets: 1 if both are empty, 0 if one is."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(_f1(a, b))


def set_f1_strict(a: Column, b: Column) -> Column:
    """Token F1 of two sets: 0 if any is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(_f1(a, b))


def gloss_f1(a: Column, b: Column) -> Column:
    return set_f1(content_set(a, SHORT_STOPLIST), content_set(b, SHORT_STOPLIST))


def mark_span(text: Column, start: Column, end: Column) -> Column:
    """Mark by code point offsets."""
    return F.concat(F.substring(text, F.lit(1), start), F.lit("<t> "), F.substring(text, start + 1, end - start), F.lit(" </t>"), F.substring(text, end + 1, F.char_length(text)))


def mark_safe(word: Column, sentence: Column) -> Column:
    """Mark the first occurrence of a word as a substring, else the first one regardless of case, else nothing."""
    exact = F.instr(sentence, word)
    at = F.when(exact > 0, exact).otherwise(F.instr(F.lower(sentence), F.lower(word)))
    size = F.char_length(word)
    made = F.concat(F.substring(sentence, F.lit(1), at - 1), F.lit("<t>"), F.substring(sentence, at, size), F.lit("</t>"), F.substring(sentence, at + size, F.char_length(sentence)))
    return F.when(at > 0, made).otherwise(sentence)


def _target_pattern(word: Column) -> Column:
    escaped = F.concat(F.lit(r"\Q"), F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.concat(F.lit(f"(?sui)^(.*?)(?<!{W})("), escaped, F.lit(f"{W}*)(?!{W})"))


def mark_target(sentence: Column, word: Column, threshold: float = 70.0) -> Column:
    """Mark a word's first inflected occurrence; without one the most similar token; without that the word is appended.

    Only sentences without an exact occurrence reach Python.
    """
    pattern = _target_pattern(word)
    hit = F.regexp_like(sentence, pattern)
    exact = F.regexp_replace(sentence, pattern, F.lit("$1<t> $2 </t>"))
    return F.when(hit, exact).otherwise(_fuzzy_mark(threshold)(F.when(~hit, sentence), word))


def _indel_ratio(a: str, b: str) -> float:
    """100 for equal strings; twice the longest common subsequence over both lengths."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], (left + 1 if x == y else max(row[j], row[j - 1]))
    return 200.0 * row[-1] / (len(a) + len(b))


def _fuzzy_mark(threshold: float):
    @F.pandas_udf("string")
    def fuzzy(sentence: pd.Series, word: pd.Series) -> pd.Series:
        import regex

        def one(text, target):
            if text is None or target is None:
                return None
            found = regex.findall(r"[\p{L}\p{N}_]+", text)
            scores = [_indel_ratio(target.lower(), t.lower()) for t in found]
            if scores and max(scores) >= threshold:
                best = regex.escape(found[scores.index(max(scores))])
                return regex.sub(rf"(?<![\p{{L}}\p{{N}}_]){best}(?![\p{{L}}\p{{N}}_])", lambda m: f"<t> {m[0]} </t>", text, count=1)
            return f"{text} <t> {target} </t>"

        return pd.Series([one(a, b) for a, b in zip(sentence, word, strict=True)], dtype=object)

    return fuzzy


def sequence_ratio():
    """Ratcliff-Obershelp similarity of two token lists, as a pandas UDF."""
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([None if x is None or y is None else SequenceMatcher(None, list(x), list(y)).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    return ratio


def think_block(think: Column) -> Column:
    return F.concat(F.lit("<think>\n"), think, F.lit("\n</think>"))


_THINK = r"(?s)<think>(.*?)</think>"


def extract_think(text: Column) -> Column:
    """The first closed think block, stripped; empty if there is none."""
    return strip_space(F.regexp_extract(F.coalesce(text, F.lit("")), _THINK, 1))


def split_think(text: Column) -> Column:
    """struct(think, body): the think block or null, and the text without it."""
    has = text.rlike(_THINK)
    return F.struct(
        F.when(has, strip_space(F.regexp_extract(text, _THINK, 1))).alias("think"),
        strip_space(F.when(has, F.regexp_replace(text, r"(?s)^(.*?)<think>.*?</think>", "$1")).otherwise(text)).alias("body"),
    )


def answer_region(text: Column) -> Column:
    """What follows the last closing think tag; empty where a think tag is left open."""
    rest = F.element_at(F.split(text, "</think>"), -1)
    return F.when(F.contains(rest, F.lit("<think>")), F.lit("")).otherwise(strip_space(rest))


def lemma_key(lemma: Column, space: str = "_") -> Column:
    return F.replace(lemma, F.lit(" " if space == "_" else "_"), F.lit(space))
