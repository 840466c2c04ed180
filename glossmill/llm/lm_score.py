"""Operator 7, language-model scoring: stupid back-off word bigram scores computed relationally.

The unigram count table is made first. Words that make up at least ``share`` of the corpus (at most 1 / share of them) are
broadcast with their counts. Texts are then exploded into bigrams (context word, word, document, how often); these are
partitioned by a hash of the context word, or of both words where the context is a frequent one, so that no frequent word
fills a partition. There the bigram count table is aggregated and joined back to the bigrams, and the unigram count table,
partitioned alike, gives the counts of contexts. Bigrams that are in the table score count(a b) / count(a); the others back
off to the word, by an ordinary join with the unigram counts. Scores are summed per document, before and after every shuffle.
On the way to their partition bigrams travel in arrays, a row for each block of texts and partition; all else is rows.

Score of a word: count(previous, word) / count(previous) if that bigram is in the corpus at least ``least`` times, else
``back_off`` * count(word) / words of the corpus; a document's first word has its unigram score. The corpus scores itself, so
every bigram of a document is in it at least once; with ``least`` = 2 only bigrams with an occurrence besides that one count
as known, and the order is 2 because in corpora that barely repeat nearly all longer n-grams occur once. Words are
[^\\x20\\x09-\\x0D]+ with A-Z lowered; counts are over all documents of the corpus. Words, and documents (id and text), are
told apart by 63-bit hashes, which don't depend on how rows are ordered or partitioned.

Defined results: null, empty and wordless texts have no words and log score 0; texts are read whole, however long; repeated
rows are counted and scored each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lowered, mix, shuffles, slices, span_hashes, stored, tidy, words

START = 1 << 40  # the context of a document's first word; frequent words are numbered from 0, others are negative hashes
_SMALL = 1 << 15  # bigrams in a row of arrays at most, and words whose numbers are small integers


def _exploded(batches, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Context, word and document key of every word, in blocks of that many words at most."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        keys = batch.column("key").to_numpy()
        for first, _, data, offsets in slices(batch, "text"):
            small = lowered(data)
            starts, stops, row = words(small, offsets)
            word = (span_hashes(small, starts, stops) | np.uint64(1 << 63)).view(np.int64)
            before = np.full(len(word), START, np.int64)
            later = np.flatnonzero(row[1:] == row[:-1]) + 1
            before[later] = word[later - 1]
            doc = keys[first + row]
            while len(word):
                n = min(len(word), block - size)
                held.append((before[:n], word[:n], doc[:n]))
                before, word, doc, size = before[n:], word[n:], doc[n:], size + n
                if size == block:
                    yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                    held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _numbered(word: np.ndarray, frequent: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Words in the sorted array `frequent` by their numbers, others as they are."""
    if not len(frequent):
        return word
    at = np.minimum(np.searchsorted(frequent, word), len(frequent) - 1)
    return np.where(frequent[at] == word, number[at], word)


def _packed(before: np.ndarray, word: np.ndarray, doc: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], buckets: np.ndarray) -> pa.RecordBatch:
    """Bigrams as rows of arrays: for each bucket the contexts, the words (small numbers first), numbers in `docs`, and counts
    within a document.

    All three are numbered within the block, so that one sort of one number each orders and counts the bigrams.
    """
    n = len(word)
    distinct, rank = np.unique(np.concatenate([word, before[:1], [START]]), return_inverse=True)
    rank_before = np.append(rank[n], rank[: n - 1])  # a context is the word before, or START
    rank_before[before == START] = rank[n + 1]
    new = np.append(True, doc[1:] != doc[:-1])
    found, count = np.unique((rank_before << 40) | (rank[:n] << 20) | (np.cumsum(new) - 1), return_counts=True)
    code = np.where(distinct == START, START, _numbered(distinct, *frequent))
    a, b, doc, count = code[found >> 40], code[(found >> 20) & 0xFFFFF], doc[new][found & 0xFFFFF], count.astype(np.int32)
    with np.errstate(over="ignore"):
        both = mix(a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64)).view(np.int64)
    place = np.mod(np.where(a < 0, a, both), len(buckets))
    small = (b >= 0) & (b < _SMALL)
    order = np.argsort(2 * place + ~small, kind="stable")
    place, a, b, doc, count, small = place[order], a[order], b[order], doc[order], count[order], small[order]
    edges = np.append(np.flatnonzero(np.append(True, place[1:] != place[:-1])), len(place))
    cuts = np.concatenate([np.arange(x, y, _SMALL) for x, y in zip(edges[:-1], edges[1:], strict=True)])
    ends = np.append(cuts, len(place))
    docs = [np.unique(doc[x:y], return_inverse=True) for x, y in zip(ends[:-1], ends[1:], strict=True)]
    lists = lambda x, at: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x))
    so_far = np.append(0, np.cumsum(small))[ends]
    arrays = [
        pa.array(buckets[place[cuts]].astype(np.int32)), lists(np.concatenate([x for x, _ in docs]), np.cumsum([0, *[len(x) for x, _ in docs]])), lists(a, ends),
        lists(b[small].astype(np.int16), so_far), lists(b[~small], ends - so_far), lists(np.concatenate([i for _, i in docs]).astype(np.int16), ends), lists(count, ends),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", "docs", "a", "b_small", "b_large", "i", "n"])


def _buckets(spark: SparkSession, parts: int) -> np.ndarray:
    """For each of that many shuffle partitions a number that Spark's hash puts there: partitions are then equally large."""
    place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts))
    tried = spark.range(parts * (20 + 4 * parts.bit_length())).groupBy(place.alias("place")).agg(F.min("id").alias("id")).orderBy("place").toArrow()
    if len(tried) < parts:
        return np.arange(parts)
    return tried["id"].to_numpy()


@contextlib.contextmanager
def _partitioned_once(spark: SparkSession) -> Iterator[None]:
    """Meanwhile, tables that are both partitioned by one of their join keys (`bucket`) are joined where they are."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2, back_off: float = 0.4, share: float = 1e-6, block: int = 400_000
) -> DataFrame:
    """Per document: doc_id, n_words, log_score (natural log, summed over words).

    share: words at least as frequent are broadcast; block: words that a task turns into arrays at a time, at most 2**20 - 2.
    """
    spark = docs.sparkSession
    own = docs.select(F.xxhash64(id_col, text_col).bitwiseAND((1 << 63) - 1).alias("key"), F.col(text_col).alias("text"))

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for _, word, _ in _exploded(batches, block):
            held.append(np.unique(word, return_counts=True))
            if len(held) > 1:
                distinct, place = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
                held = [(distinct, np.bincount(place, np.concatenate([n for _, n in held])).astype(np.int64))]
            if len(held[0][0]) > block:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names=["word", "n"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names=["word", "n"])

    unigrams = stored(own.mapInArrow(tidy(count), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    total = unigrams.agg(F.sum("n")).first()[0] or 0
    often = unigrams.filter(F.col("n") >= share * total).toArrow().sort_by([("n", "descending"), ("word", "ascending")])  # at most 1 / share rows
    order = np.argsort(often["word"].to_numpy())  # words are numbered from the most frequent on
    frequent = spark.sparkContext.broadcast((often["word"].to_numpy()[order], order))
    counts = F.broadcast(spark.createDataFrame(pa.table({"number": pa.array(np.arange(len(often))), "n": often["n"]}), "number bigint, n bigint"))
    parts = max(1, shuffles(docs), -(-total // 3_000_000))
    buckets = _buckets(spark, parts)

    def ask(batches):
        for before, word, doc in _exploded(batches, block):
            yield _packed(before, word, doc, frequent.value, buckets)

    asked = own.mapInArrow(tidy(ask), "bucket int, docs array<bigint>, a array<bigint>, b_small array<smallint>, b_large array<bigint>, i array<smallint>, n array<int>").repartition(parts, "bucket")
    # Always true; not to be pushed below the shuffle, it keeps that alike, with all columns, for both uses, so that it is done once.
    asked = asked.filter(F.size("docs") + F.size("i") + F.spark_partition_id() >= 0)
    pair = F.xxhash64("a", "b").alias("pair")
    b = F.concat(F.col("b_small").cast("array<bigint>"), "b_large").alias("b")
    each = asked.select("bucket", F.transform("i", lambda x: F.get("docs", x.cast("int"))).alias("doc"), "a", b, "n")
    each = each.select("bucket", F.inline(F.arrays_zip("doc", "a", "b", "n")).alias("doc", "a", "b", "n")).select("bucket", pair, "doc", "a", "b", "n")
    table = asked.select("bucket", "a", b, "n").select("bucket", F.inline(F.arrays_zip("a", "b", "n")).alias("a", "b", "n"))
    bigrams = table.select("bucket", pair, "n").groupBy("pair", "bucket").agg(F.sum("n").alias("ab"))  # the count table, partitioned by `bucket`
    contexts = unigrams.select(F.get(F.lit(buckets.tolist()), F.pmod("word", F.lit(parts)).cast("int")).cast("int").alias("bucket"), F.col("word").alias("a"), F.col("n").alias("rare_a")).repartition(parts, "bucket")
    met = each.join(bigrams, ["pair", "bucket"]).join(contexts.hint("shuffle_hash"), ["a", "bucket"], "left")
    met = met.join(counts.select(F.col("number").alias("a"), F.col("n").alias("often_a")), "a", "left").join(counts.select(F.col("number").alias("b"), F.col("n").alias("often_b")), "b", "left")
    known = (F.col("a") != START) & (F.col("ab") >= least)
    factor = F.when(F.col("a") == START, 0.0).otherwise(float(np.log(back_off))) - float(np.log(max(total, 1)))
    value = F.when(known, F.log("ab") - F.log(F.coalesce("often_a", "rare_a"))).otherwise(factor + F.coalesce(F.log("often_b"), F.lit(0.0)))
    # What backs off to a rare word waits for that word's count under its hash (negative), all else under its document's key.
    waits = F.when(~known & F.col("often_b").isNull(), F.col("b")).otherwise(F.col("doc"))
    valued = met.select("bucket", "doc", waits.alias("word"), "n", (F.col("n") * value).alias("value"))
    valued = valued.groupBy("word", "doc", "bucket").agg(F.sum("n").alias("times"), F.sum("value").alias("value"))
    backed = valued.join(unigrams, "word", "left").select("doc", "times", (F.col("value") + F.when(F.col("word") < 0, F.col("times") * F.log("n")).otherwise(0.0)).alias("value"))
    with _partitioned_once(spark):
        sums = stored(backed.groupBy("doc").agg(F.sum("times").alias("times"), F.sum("value").alias("value")))
    rows = docs.select(F.col(id_col).alias(id_col), F.xxhash64(id_col, text_col).bitwiseAND((1 << 63) - 1).alias("doc"))
    copies = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("copies"))
    scores = sums.join(copies, "doc").select("doc", (F.col("times") / F.col("copies")).cast("bigint").alias("n_words"), (F.col("value") / F.col("copies")).alias("log_score"))
    return rows.join(scores, "doc", "left").select(id_col, F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("log_score", F.lit(0.0)).alias("log_score"))
