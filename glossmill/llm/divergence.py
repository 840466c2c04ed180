"""Operator 13, source divergence audit by a baseline-correction inverted index.

Every document's terms are counted by language and source; a language keeps the terms that enough of its documents hold. Two
sources of a language differ by the sum, over all kept terms, of the distance of their smoothed shares. That sum isn't taken
term by term: a pair starts at V times the distance of two zero counts, and only what differs from it is added,

* for one source's postings, the distance of their shares from the other's share of a zero count. Postings with one count have
  one share, so these go by the source's histogram of counts, and
* for terms that both sources hold, what that has got wrong: a join of the index with itself on the term, nonzero rows only.

A source's own terms, those with a larger share than in the language, are ranked by a window that Spark limits on the map
side already, so that no source's terms meet in one task.

Defined results: null text, language and source are empty strings and form groups as any other value; a group without terms
has zero counts; a language that keeps no term gives pairs of value 0 and no terms; a language with one source gives no
pairs; repeated rows are further documents; texts of any length are read whole; ties are ranked by the item's UTF-8 bytes; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, tidy

#: Bytes of terms (letters, A-Z lowered, and anything beyond ASCII); all others part them.
_TERMS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", entries: int = 400_000) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents. The term '' stands for the documents themselves.

    Tasks count in tables of at most about `entries` terms, which they hand over as they fill up; Spark adds the counts.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(empty(lang_col).cast("string").alias("lang"), empty(source_col).cast("string").alias("source"), empty(text_col).cast("binary").alias("text"))

    def counted(found: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
        langs, sources, terms, n, d = ([] for _ in range(5))
        for (lang, source), (times, documents) in found.items():
            langs.append(pa.repeat(lang, len(documents)))
            sources.append(pa.repeat(source, len(documents)))
            terms.append(pa.array(documents.keys(), pa.binary()).cast(pa.string()))
            n.append(pa.array([times[t] for t in documents], pa.int64()))
            d.append(pa.array(documents.values(), pa.int64()))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in (langs, sources, terms, n, d)], names=["lang", "source", "term", "n", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                times, documents = found.setdefault((lang, source), (Counter(), Counter()))
                size -= len(documents)
                split = text.as_py().translate(_TERMS).split()
                times.update(split)
                documents.update(set(split))
                documents[b""] += 1
                size += len(documents)
                if size > entries:
                    yield counted(found)
                    found, size = {}, 0
        if found:
            yield counted(found)

    made = rows.mapInArrow(tidy(run), "lang string, source string, term string, n bigint, d bigint")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(n: Column, total: Column, terms: Column, smooth: int, scale: int) -> Column:
    """1 + floor(scale * (n + smooth) / (total + smooth * terms)), exactly; null where no term is kept."""
    whole = lambda c: c.cast("decimal(20,0)")
    up, down = F.lit(scale).cast("decimal(10,0)") * whole(n + smooth), whole(total + smooth * terms)
    return F.when(terms > 0, F.floor((up - up % down) / down).cast("bigint") + 1)


def inverted_index(counts: DataFrame, least: int, smooth: int, scale: int) -> tuple[DataFrame, DataFrame]:
    """groups(lang, source, terms, total, p0) and postings(lang, source, term, n, p, p0, q): one for each kept term of a group."""
    kept = cut(counts.filter("term != ''").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("d").alias("docs")).filter(F.col("docs") >= least).drop("docs"))
    held = cut(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all_n"))
    langs = bounded(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all_n").alias("lang_total")))
    totals = bounded(held.groupBy("lang", "source").agg(F.sum("n").alias("total")))
    groups = counts.filter("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    groups = cut(groups.withColumn("p0", share(F.lit(0), F.col("total"), F.col("terms"), smooth, scale)))
    of = lambda n, total: share(F.col(n), F.col(total), F.col("terms"), smooth, scale)
    postings = held.join(bounded(groups), ["lang", "source"]).select("lang", "source", "term", "n", of("n", "total").alias("p"), "p0", of("all_n", "lang_total").alias("q"))
    return groups, cut(postings)


def pairs(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, a, b, value), a < b: the distance of two sources, the baseline and its corrections."""
    far = lambda x, y: F.abs(F.col(x) - F.col(y))
    one, two = (groups.select("lang", F.col("source").alias(s), F.col("p0").alias(f"{s}0"), "terms") for s in ("a", "b"))
    base = one.join(bounded(two.drop("terms")), "lang").filter("a < b").select("lang", "a", "b", F.coalesce(F.col("terms") * far("a0", "b0"), F.lit(0)).alias("value"))
    histogram = postings.groupBy("lang", "source", "n", "p", "p0").agg(F.count(F.lit(1)).alias("m"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("other0"))
    alone = histogram.join(bounded(other), "lang").filter("source != other").withColumn("value", F.col("m") * (far("p", "other0") - far("p0", "other0"))).filter("value != 0")
    alone = alone.select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), "value")
    left, right = (postings.select("lang", "term", F.col("source").alias(s), F.col("p").alias(f"{s}1"), F.col("p0").alias(f"{s}0")) for s in ("a", "b"))
    both = left.join(right, ["lang", "term"]).filter("a < b").withColumn("value", far("a1", "b1") - far("a1", "b0") - far("a0", "b1") + far("a0", "b0")).filter("value != 0")
    return base.unionByName(alone).unionByName(both.select("lang", "a", "b", "value")).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = 30, top: int = 50, smooth: int = 5, scale: int = 1_000_000_000, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per language and source: its distances from the other sources (part ``pair``), and the terms that set it apart (part ``term``).

    least: documents of a language that a kept term is in; top: terms listed; smooth: added to every count; scale: shares are
    of so many.
    """
    groups, postings = inverted_index(cut(term_counts(docs, lang_col, source_col, text_col)), least, smooth, scale)
    found = cut(pairs(groups, postings))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    mutual = found.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(found.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    own = postings.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = [rows.withColumn("rank", F.row_number().over(order)) for rows in (mutual, own)]
    return ranked[0].withColumn("part", F.lit("pair")).unionByName(ranked[1].filter(F.col("rank") <= top).withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")
