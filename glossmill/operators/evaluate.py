"""Gloss evaluation: token F1, echo of the filler, sense accuracy, cosine, BLEU and chrF."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.prompts import FILLER_USAGE, FILLER_WORD
from ..session import cut, spread
from .choice import by_tokens, by_vectors, vector_of
from .traces import messages

SAME_GLOSS_F1, ECHO_EXCLUDE_F1 = 0.8, 0.4


def mean(x: Column) -> Column:
    """The mean; NaN, not null, over nothing."""
    return F.coalesce(F.avg(x), F.lit(float("nan")))


def gloss_messages(lemma: Column, pos: Column, marked: Column) -> Column:
    """The evaluation prompt: the record's usage beside a constant filler sentence."""
    filler = FILLER_USAGE.replace(FILLER_WORD, f"<t> {FILLER_WORD} </t>", 1)
    return messages({"lemma": lemma, "pos": pos, "usage1": marked, "usage2": F.lit(filler)})


def score_rows(rows: DataFrame) -> DataFrame:
    """rows(definition, gloss, filler_gloss, ...) with, for rows with a gloss, its scores: f1, filler_f1, bleu, chrf, the sizes of
    both content sets, and whether the filler's sense may count as an echo (it isn't the record's own)."""
    sets = {c: T.content_set(F.coalesce(F.col(c), F.lit("")), T.SHORT_STOPLIST) for c in ("definition", "gloss", "filler_gloss")}
    made = spread(rows).withColumns({f"_{c}": x for c, x in sets.items()})
    has = F.coalesce("gloss", F.lit("")) != ""
    of = {
        "f1": T.set_f1(F.col("_definition"), F.col("_gloss")), "filler_f1": T.set_f1(F.col("_gloss"), F.col("_filler_gloss")), "may_echo": T.set_f1(F.col("_definition"), F.col("_filler_gloss")) < ECHO_EXCLUDE_F1,
        "len_gloss": F.size("_gloss").cast("double"), "len_gold": F.size("_definition").cast("double"), "bleu": sentence_bleu(F.col("gloss"), F.col("definition")),
        "chrf": chrf(F.when(has, F.col("gloss")), F.col("definition")),
    }
    return made.withColumns({c: F.when(has, x) for c, x in of.items()}).drop(*[f"_{c}" for c in sets])


def _echoes() -> Column:
    return F.when(F.col("may_echo"), (F.col("filler_f1") >= SAME_GLOSS_F1).cast("double"))


def echo_rate(scored: DataFrame) -> DataFrame:
    return scored.agg(mean(_echoes()).alias("echo_rate"))


def summary(scored: DataFrame, cos: str | None = None) -> DataFrame:
    """One row of counts and means over rows with a gloss; means over nothing are NaN. cos: a column of cosines, if there is one."""
    means = [mean(F.col(c)).alias(c) for c in ("f1", "bleu", "chrf", "len_gloss", "len_gold", "filler_f1")]
    return scored.agg(
        F.count(F.lit(1)).alias("n"), F.count("f1").alias("n_scored"), (F.count(F.lit(1)) - F.count("f1")).alias("empty"), *means, mean(F.col(cos) if cos else F.lit(None).cast("double")).alias("cos"),
        mean(_echoes()).alias("filler_echo_rate"), F.count(_echoes()).alias("n_echo_scored"),
    )


def full_summary(rows: DataFrame, by: list[str], order: str, cos: str | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """`summary`, corpus BLEU and sense accuracy of one gloss file, in one row. With vectors(text, embedding), of glosses and
    definitions (`choice.encode_distinct` makes them), cosines are computed, and senses are chosen by them."""
    scored = score_rows(rows)
    if vectors is not None and cos is None:
        scored, cos = own_cosine(scored, vectors), "cos"
    sense = sense_accuracy(rows, by, order, vectors).select(F.col("accuracy").alias("sense_acc"), F.col("n").alias("n_sense_scored"))
    bleu = corpus_bleu(rows.filter(F.coalesce("gloss", F.lit("")) != "")).select(F.col("bleu").alias("bleu_corpus"))
    return summary(scored, cos).join(F.broadcast(bleu)).join(F.broadcast(sense))  # three tables of one row


def sense_choice(rows: DataFrame, by: list[str], order: str, vectors: DataFrame | None = None) -> DataFrame:
    """rows(*by, lemma, pos, gloss, definition, order) -> *by, sense_correct, for lemmas with two definitions or more.

    The choice is the definition most like the gloss, first seen on ties; rows with an empty gloss have none. Likeness is token
    F1, or, with vectors(text, embedding) of glosses and definitions, their cosine.
    """
    group = ["lemma", "pos"]
    definitions = rows.groupBy(*group, "definition").agg(F.min(order).alias("_seen"))
    many = cut(definitions.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").select(*group))
    options = definitions.join(many, group, "left_semi").withColumnRenamed("definition", "_option")
    asked = rows.filter(F.coalesce("gloss", F.lit("")) != "").select(*by, *group, "gloss", F.col("definition").alias("_own"))
    if vectors is None:
        sets = {c: T.content_set(F.col(c), T.SHORT_STOPLIST) for c in ("_option", "gloss")}
        best = by_tokens(asked.withColumn("_tokens", sets["gloss"]), options.withColumn("_tokens", sets["_option"]), [*by, "_own"], group, ["_seen", "_option"])
    else:
        best = by_vectors(vector_of(asked, "gloss", vectors, "_vector"), vector_of(options, "_option", vectors, "_vector"), [*by, "_own"], group, ["_seen", "_option"])
    return best.select(*by, (F.col("_option") == F.col("_own")).alias("sense_correct"))


def sense_accuracy(rows: DataFrame, by: list[str], order: str, vectors: DataFrame | None = None) -> DataFrame:
    return sense_choice(rows, by, order, vectors).agg(F.count(F.lit(1)).alias("n"), mean(F.col("sense_correct").cast("double")).alias("accuracy"))


def own_cosine(rows: DataFrame, vectors: DataFrame, into: str = "cos") -> DataFrame:
    """rows(gloss, definition, ...) with the cosine of each gloss and its own definition; null for rows with an empty gloss."""
    met = vector_of(vector_of(rows, "gloss", vectors, "_a"), "definition", vectors, "_b")
    return met.withColumn(into, F.when(F.coalesce("gloss", F.lit("")) != "", cosine(F.col("_a"), F.col("_b")))).drop("_a", "_b")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def embed_once(df: DataFrame, text: str, encode: Column) -> DataFrame:
    """Each distinct text encoded once and joined back; encode is a column over `text`."""
    vectors = df.select(text).distinct().withColumn("embedding", encode)
    return df.join(vectors, text)


def _matches(h: Column, r: Column, order: int) -> Column:
    """Of two token lists: clipped matches of the n-grams of each order, then both sizes. Null if one list is."""

    @F.pandas_udf("array<bigint>")
    def count(hs: pd.Series, rs: pd.Series) -> pd.Series:
        def one(a, b):
            if a is None or b is None:
                return None
            a, b = list(a), list(b)
            of = lambda x, n: Counter(zip(*[x[k:] for k in range(n)], strict=False))
            return [*[sum((of(a, n) & of(b, n)).values()) for n in range(1, order + 1)], len(a), len(b)]

        return pd.Series([one(a, b) for a, b in zip(hs, rs, strict=True)], dtype=object)

    return count(h, r)


def bleu_tokens(text: Column) -> Column:
    """The tokens that published BLEU scores are made of (the mteval 13a rules), in letter case."""
    for pattern, to in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(pattern), F.lit(to))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for pattern, to in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "), (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 ")):
        text = F.regexp_replace(text, pattern, to)
    return T.split_space(text)


def _bleu(matches: list[Column], totals: list[Column], c: Column, r: Column) -> Column:
    """BLEU in percent with exponential smoothing, over the orders that the hypothesis is long enough for."""
    logs, orders, halved = F.lit(0.0), F.lit(0), F.lit(0)
    for m, t in zip(matches, totals, strict=True):
        halved = halved + F.when((t > 0) & (m == 0), 1).otherwise(0)
        share = F.when(m > 0, m.cast("double") / F.greatest(t, F.lit(1))).otherwise(1 / (F.pow(F.lit(2.0), halved) * F.greatest(t, F.lit(1))))
        logs, orders = logs + F.when(t > 0, F.log(share)).otherwise(0.0), orders + F.when(t > 0, 1).otherwise(0)
    brevity = F.when(c >= r, 0.0).otherwise(1 - r.cast("double") / F.greatest(c, F.lit(1)))
    found = F.lit(False)
    for m in matches:
        found = found | (m > 0)
    return F.when(found, 100 * F.exp(logs / F.greatest(orders, F.lit(1)) + brevity)).otherwise(0.0)


def sentence_bleu(hypothesis: Column, reference: Column, order: int = 4) -> Column:
    """Rows of small files are dealt out first (`session.spread`), else one task scores them all."""
    made = _matches(bleu_tokens(hypothesis), bleu_tokens(reference), order)
    size = F.get(made, order)
    return _bleu([F.get(made, n) for n in range(order)], [F.greatest(size - n, F.lit(0)) for n in range(order)], size, F.get(made, order + 1))


def corpus_bleu(rows: DataFrame, hypothesis: str = "gloss", reference: str = "definition", order: int = 4) -> DataFrame:
    """Corpus BLEU (Papineni et al., 2002), in percent; NaN over nothing."""
    pairs = spread(rows.groupBy(hypothesis, reference).agg(F.count(F.lit(1)).alias("k")))  # a pair that many rows have is scored once
    split = pairs.select("k", _matches(bleu_tokens(F.col(hypothesis)), bleu_tokens(F.col(reference)), order).alias("x"))
    c, k = F.get("x", order), F.col("k")
    sums = [F.sum(k * F.get("x", n - 1)).alias(f"m{n}") for n in range(1, order + 1)] + [F.sum(k * F.greatest(c - n + 1, F.lit(0))).alias(f"t{n}") for n in range(1, order + 1)]
    total = split.agg(*sums, F.sum(k * c).alias("c"), F.sum(k * F.get("x", order + 1)).alias("r"))
    score = _bleu([F.col(f"m{n}") for n in range(1, order + 1)], [F.col(f"t{n}") for n in range(1, order + 1)], F.col("c"), F.col("r"))
    return total.select(F.when(F.col("c").isNull(), float("nan")).otherwise(score).alias("bleu"))


def chrf(hypothesis: Column, reference: Column, order: int = 6, beta: float = 2.0) -> Column:
    """Sentence chrF (Popovic, 2015) over characters without white space, in percent: precision and recall are means over the
    orders that both texts are long enough for. Null for a null hypothesis."""

    @F.pandas_udf("double")
    def score(hypotheses: pd.Series, references: pd.Series) -> pd.Series:
        def one(h: str | None, r: str | None) -> float:
            h, r = "".join((h or "").split()), "".join((r or "").split())
            precision, recall, orders = 0.0, 0.0, 0
            for n in range(1, order + 1):
                a, b = (Counter(x[i : i + n] for i in range(len(x) - n + 1)) for x in (h, r))
                if a and b:
                    both = sum((a & b).values())
                    precision, recall, orders = precision + both / sum(a.values()), recall + both / sum(b.values()), orders + 1
            return 100 * (1 + beta**2) * precision * recall / (orders * (beta**2 * precision + recall)) if precision else 0.0

        return pd.Series([None if h is None else one(h, r) for h, r in zip(hypotheses, references, strict=True)], dtype="float64")

    return score(hypothesis, reference)
