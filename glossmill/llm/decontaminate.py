"""Operator 12, benchmark decontamination by a positional inverted index (DataFrame functions only).

The index holds a posting (term, document, position) for every corpus word that some test item uses; no other word can take
part in a match. Every task writes the postings of its own documents, sorted by term, so that building the index moves no row
between tasks, and a search for few terms reads few row groups.

A test item's windows are searched from the rarest term on. The postings of each window's rarest term give places where the
item may lie: the term's position less its offset in the item. They are intersected with the offset-adjusted postings of
the window's second rarest term, and what is left with the postings of all other terms of the window. Runs of matching
words as long as a window are the matches. `proximity` intersects the same lists with a tolerance instead of an offset.

Lists of test terms and places are broadcast only where they have been counted and are few; else they meet in ordinary joins,
which Spark splits where one term holds a large share.

Defined results: null texts have no words; an item of fewer words than a window, but not none, is one window; items with the
same words are searched once and all listed; a null item id is listed as an empty string; rows that repeat an item id are one
item with several texts; repeated documents are judged one by one, null ids too; texts of any length are read whole; empty
tables give no row, or no hit; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, lower_az, stored

#: A run of ASCII letters and digits, or of anything beyond ASCII; capitals are lowered word by word.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FEW = 1_000_000


def words(text: Column) -> Column:
    """Words as they stand, A-Z not yet lowered; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def test_texts(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """texts(text_id, words), one for each different sequence of words, and members(text_id, item): the items that have it."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.transform(words(F.col(text_col)), lower_az).alias("words")).filter(F.size("words") > 0)
    texts = cut(rows.select("words").distinct().select(F.monotonically_increasing_id().alias("text_id"), "words"))
    return texts, bounded(rows.join(texts, "words").select("text_id", "item").distinct(), _FEW)


def vocabulary(texts: DataFrame) -> DataFrame:
    """(term, tid): every term of the test texts."""
    return cut(texts.select(F.explode("words").alias("term")).distinct().withColumn("tid", F.monotonically_increasing_id()))


def index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """documents(key, doc_id, n_words) and postings(tid, key, pos) of documents' words that are among terms(term, tid).

    Both come from one table, which one pass writes: a document's own row has the term number -1 and its words as position.
    """
    terms = bounded(terms.unionByName(docs.sparkSession.createDataFrame([("", -1)], terms.schema)), _FEW)
    split = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("words"))
    every = split.select("key", "doc_id", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "word"))
    made = every.select("key", "doc_id", "pos", lower_az(F.col("word")).alias("term")).join(terms, "term")
    table = stored(made.select("tid", "key", "pos", F.when(F.col("tid") < 0, F.col("doc_id")).alias("doc_id")).sortWithinPartitions("tid", "key", "pos"))
    return table.filter("tid < 0").select("key", "doc_id", F.col("pos").cast("bigint").alias("n_words")), table.filter("tid >= 0").select("tid", "key", "pos")


def windows(texts: DataFrame, terms: DataFrame, postings: DataFrame, width: int) -> DataFrame:
    """(text_id, win, len, off, tid, nth): the words of every window whose terms all occur, from the rarest (nth 1) on."""
    counts = postings.groupBy("tid").agg(F.count(F.lit(1)).alias("freq"))
    known = cut(terms.join(counts, "tid"))
    size = F.size("words")
    placed = texts.select("text_id", size.alias("size"), F.least(size, F.lit(width)).alias("len"), F.posexplode("words").alias("off", "term"))
    first, last = F.greatest(F.lit(0), F.col("off") - F.col("len") + 1), F.least(F.col("off"), F.col("size") - F.col("len"))
    held = placed.join(bounded(known, _FEW), "term").select("text_id", "len", "off", "tid", "freq", F.explode(F.sequence(first, last)).alias("win"))
    own = Window.partitionBy("text_id", "win")
    ranked = held.withColumns({"held": F.count(F.lit(1)).over(own), "nth": F.row_number().over(own.orderBy("freq", "tid", "off"))})
    return cut(ranked.filter("held = len").select("text_id", "win", "len", "off", "tid", "nth"))


def phrases(texts: DataFrame, terms: DataFrame, postings: DataFrame, width: int = 10) -> DataFrame:
    """(key, text_id, first, last): the runs of document words, from first to before last, that repeat a test text's words over
    at least a window."""
    wins = windows(texts, terms, postings, width)
    rarest, second = (wins.filter(F.col("nth") == n).select("text_id", "win", "off", "tid") for n in (1, 2))
    steps = rarest.select("text_id", "win", F.col("off").alias("off1")).join(second.select("text_id", "win", F.col("off").alias("off2")), ["text_id", "win"], "left")
    steps = bounded(steps.fillna(-1, ["off2"]), _FEW)  # -1: a window of one word

    def places(of: DataFrame, name: str) -> DataFrame:
        """Where a test text may begin in a document, by the postings of some of its terms."""
        picked = bounded(of.select("text_id", "off", "tid").distinct(), _FEW)
        return postings.join(picked, "tid").select("key", "text_id", (F.col("pos") - F.col("off")).alias("at"), F.col("off").alias(name))

    by = ["key", "text_id", "at"]
    pairs = bounded(steps.select("text_id", "off1", "off2").distinct(), _FEW)
    tried = places(rarest, "off1").join(pairs, ["text_id", "off1"])
    both = tried.filter("off2 >= 0").join(places(second, "off2"), [*by, "off2"], "left_semi")
    left = cut(both.unionByName(tried.filter("off2 < 0")))
    # All words of the windows that are left: (key, text_id, at, off, tid), each once however many windows it is in.
    due = left.join(steps, ["text_id", "off1", "off2"]).select(*by, "win")
    sought = due.join(bounded(wins.select("text_id", "win", "off", "tid"), _FEW), ["text_id", "win"]).select(*by, "off", "tid").distinct().withColumn("pos", F.col("at") + F.col("off"))
    near = postings.join(bounded(left.select("key").distinct(), _FEW), "key", "left_semi")
    found = sought.join(near, ["key", "pos", "tid"], "left_semi")
    run = Window.partitionBy(*by).orderBy("off")
    runs = found.withColumn("run", F.col("off") - F.row_number().over(run)).groupBy(*by, "run").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    needed = bounded(wins.select("text_id", "len").distinct(), _FEW)
    return runs.join(needed, "text_id").filter("n >= len").select("key", "text_id", "first", (F.col("first") + F.col("n")).alias("last"))


def proximity(texts: DataFrame, terms: DataFrame, postings: DataFrame, width: int = 10, reach: int = 20) -> DataFrame:
    """(key, text_id, win, pos): places of a window's rarest term with each other term of the window within `reach` words."""
    wins = windows(texts, terms, postings, width)
    distinct = wins.groupBy("text_id", "win", "tid").agg(F.min("nth").alias("nth"))
    sizes = distinct.groupBy("text_id", "win").agg(F.count(F.lit(1)).alias("terms"))
    order = Window.partitionBy("text_id", "win").orderBy("nth")
    ranked = cut(distinct.join(sizes, ["text_id", "win"]).withColumn("nth", F.row_number().over(order)))
    cell = F.floor(F.col("pos") / reach)
    held = postings.join(bounded(ranked.filter("nth = 1").drop("nth").withColumnRenamed("tid", "tid1"), _FEW), F.col("tid") == F.col("tid1")).select("key", "text_id", "win", "pos", "terms")
    celled = postings.select("tid", "key", F.col("pos").alias("other"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))  # a term is looked for from its own cell
    for first, last in ((2, 2), (3, width)):  # the second rarest term leaves few places for the others
        rest = bounded(ranked.filter(F.col("nth").between(first, last)).select("text_id", "win", "tid"), _FEW)
        sought = held.withColumn("cell", cell).join(rest, ["text_id", "win"])
        met = sought.join(celled.join(bounded(rest.select("tid").distinct(), _FEW), "tid", "left_semi"), ["key", "tid", "cell"]).filter(F.abs(F.col("pos") - F.col("other")) <= reach)
        by = ["key", "text_id", "win", "pos", "terms"]
        full = met.select(*by, "tid").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        needed = F.least(F.col("terms"), F.lit(last)) - first + 1
        held = cut(full.filter(F.col("n") == needed).drop("n").unionByName(held.filter(F.col("terms") < first)))
    return held.select("key", "text_id", "win", "pos")


def judge(documents: DataFrame, matches: DataFrame, members: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    before = Window.partitionBy("key").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    matches = cut(matches)
    begun = matches.select("key", "first", "last").distinct().withColumn("first", F.greatest("first", F.coalesce(F.max("last").over(before), F.lit(0))))
    hits = begun.groupBy("key").agg(F.sum(F.greatest(F.col("last") - F.col("first"), F.lit(0))).alias("n_hit"))
    items = matches.select("key", "text_id").distinct().join(members, "text_id").groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    joined = documents.join(hits, "key", "left").join(items, "key", "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Every document against all windows of all items."""
    texts, members = test_texts(items, item_col, item_text_col)
    terms = vocabulary(texts)
    documents, postings = index(docs, terms, id_col, text_col)
    return judge(documents, phrases(texts, terms, postings, width), members).withColumnRenamed("doc_id", id_col)
