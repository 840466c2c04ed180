"""Operator 6, quality rules: word statistics, and n-gram perplexity bands by language.

A modified Kneser-Ney model over byte 5-grams is counted by Spark: tasks hand on partial occurrence counts, Spark sums them,
and the continuation counts of the orders below, all discounts, context totals and interpolated probabilities are
aggregations and joins of count tables. One model serves all languages (its contexts tell them apart), the bands are by
language. What is broadcast are arrays of gram hashes in order (a one-to-one mixing of the gram's number) with their log
probabilities, and of context hashes with back-off weights. No gram is left out of the model. As long as the corpus has at
most ``most`` different 5-grams, all orders are in the arrays; beyond that the arrays hold the 5-grams that make up at least
1 / most of all, and the others (rare ones, and those that the model never saw) go with their documents' scores to a join with
the whole tables, order by order. Logs are rounded, so that sums are exact: either way gives the same scores.

The model is fitted twice. The first is counted over all documents that pass the base rules; the second over those of them
whose perplexity under the first is near that of their language, so that a kind of junk that is a few hundredths of the
corpus doesn't teach the model its own habits. All documents are scored by the second.

Each language has two bands, for its documents' cross entropy (log perplexity) per byte and per word. A band lies around the
median, its edges are multiples of the median absolute deviation, and it is wider for short texts; documents above or below
either band are rejected. Every language has bands around its own medians, whatever its size: none is judged by another's.
Only the deviation, as a share of the median, is drawn towards that of all documents around their own languages' medians,
which counts as ``least`` documents. Documents of no language, or of one without a usable document in the fit, are held
against the band of the whole corpus. Bands are a few numbers for each language, and are kept on the driver.

Defined results: null text is the empty text (no words, base_failed); any length is read whole; a null language is none;
repeated rows are scored each; an empty table gives an empty result; further columns are ignored by `score` and kept by
`keep_clean`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _BASE, _BACK, _WHITE, _powers, bounded, cut, gathered, give_back, mix, per_row, settle, slices, span_hashes, tidy, words

ORDER = 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NEWLINES = int.from_bytes(b"\n" * ORDER, "big")
_GRAIN = 1 << 18
VERDICT = ("n_words", "n_repeat_words")
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def features(data: np.ndarray, offsets: np.ndarray, window: int = 8) -> dict[str, np.ndarray]:
    """The base statistics of every row."""
    rows, lengths = len(offsets) - 1, np.diff(offsets)
    spans = words(data, offsets)
    heads = (data & 0xC0) != 0x80
    out = repeats(data, rows, spans, window)
    out |= {"word_chars": per_row((heads & ~_WHITE[data]).view(np.int8), lengths), "n_symbols": per_row(_SYMBOL[data].view(np.int8), lengths)}
    starts = spans[0]
    # Lines: cut at every newline and at row edges; those without a word don't count.
    breaks = np.flatnonzero(data == 10)
    line_row = np.concatenate([np.arange(rows), np.searchsorted(offsets, breaks, "right") - 1])
    line_start = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((line_start, line_row))
    line_start, line_row = line_start[order], line_row[order]
    line_stop = np.append(line_start[1:] - 1, 0)
    last = np.append(line_row[1:] != line_row[:-1], True)
    line_stop[last] = offsets[line_row[last] + 1]
    solid = np.searchsorted(starts, line_stop) > np.searchsorted(starts, line_start)
    line_row, keys = line_row[solid], span_hashes(data, line_start[solid], line_stop[solid])
    with np.errstate(over="ignore"):
        keys = mix(keys + line_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys, kind="stable")
        again = np.zeros(len(keys), bool)
        again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
        out["n_dup_lines"] = np.bincount(line_row[again], minlength=rows)
    return out


def repeats(data: np.ndarray, rows: int, spans: tuple[np.ndarray, np.ndarray, np.ndarray], window: int = 8) -> dict[str, np.ndarray]:
    """n_words and n_repeat_words of every row, on which the base verdict rests."""
    starts, stops, row = spans
    # Windows of words: a running sum of word hashes gives each window's hash.
    with np.errstate(over="ignore"):
        hashes, n = span_hashes(data, starts, stops), len(starts)
        covered = np.zeros(n + 1, np.int64)
        if n >= window:
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(hashes * _powers(_BASE, n), dtype=np.uint64, out=total[1:])
            first = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])
            keys = mix((total[first + window] - total[first]) * _powers(_BACK, n)[first] + row[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            in_order = np.sort(keys)
            again = in_order[1:][in_order[1:] == in_order[:-1]]
            if len(again):
                at = np.minimum(np.searchsorted(again, keys), len(again) - 1)
                twice = first[again[at] == keys]
                covered += np.bincount(twice, minlength=n + 1) - np.bincount(twice + window, minlength=n + 1)
    return {"n_words": np.bincount(row, minlength=rows), "n_repeat_words": np.bincount(row[np.cumsum(covered[:-1]) > 0], minlength=rows)}


def base_failed(found: dict[str, np.ndarray]) -> np.ndarray:
    return (found["n_words"] < 20) | (100 * found["n_repeat_words"] > 30 * found["n_words"])


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with the ORDER - 1 before it as one number; what lies before a row is newlines."""
    code = data.astype(np.int64)
    for back in range(1, ORDER):
        code[back:] |= data[:-back].astype(np.int64) << 8 * back if back < len(data) else 0
    for nth in range(ORDER - 1):  # the first bytes of every row
        at = offsets[:-1][np.diff(offsets) > nth] + nth
        own = (1 << 8 * (nth + 1)) - 1
        code[at] = (code[at] & own) | (_NEWLINES & ~own)
    return code


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    codes, inverse = np.unique(codes, return_inverse=True)
    return codes, np.bincount(inverse, counts).astype(np.int64)


def count_grams(docs: DataFrame, text_col: str, lang_col: str, wanted: Callable) -> DataFrame:
    """gram, n: how often each byte gram occurs in the rows that are wanted: wanted(languages, bytes, offsets, grams) -> booleans."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for first, n, data, offsets in slices(batch, "text"):
                code = grams(data, offsets)
                own = np.repeat(wanted(batch.column("lang").slice(first, n).to_pylist(), data, offsets, code), np.diff(offsets))
                parts.append(np.unique(code[own], return_counts=True))
                size += len(parts[-1][0])
                if size > 1_000_000:
                    parts = [_merged(parts)]
                    size = len(parts[0][0])
                    if size > 500_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], names=["gram", "n"])
                        parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(parts)], names=["gram", "n"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return rows.mapInArrow(tidy(run), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def _hash(code: np.ndarray) -> np.ndarray:
    """One-to-one: grams of one order never collide."""
    with np.errstate(over="ignore"):
        return mix(code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


def _grains(log: Column) -> Column:
    """Multiples of 2^-18: any sum of them is exact, so that a document's doesn't depend on what else is in the array."""
    return F.round(log * _GRAIN) / _GRAIN


def _arrays(table: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """code, v -> hashes in order, values, where hashes with given leading bits begin, their number; at most 1 / share rows."""
    got = table.toArrow()
    hashes = _hash(got["code"].to_numpy())
    order = np.argsort(hashes)
    hashes, bits = hashes[order], len(hashes).bit_length() + 1
    begins = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    return hashes, got["v"].to_numpy()[order].astype(np.float32), np.append(begins, len(hashes)).astype(np.int32), bits


def kneser_ney(counted: DataFrame, share: float = 2.0**-20) -> dict[tuple[str, int], tuple]:
    """The tables of `log_tables` as arrays. With a share, only grams that make up at least that share of their order are in
    them, and the weights are those of what is stored, so that the probabilities after any context sum to one."""
    return {k: _arrays(t.select("code", "v")) for k, t in log_tables(counted, share).items()}


def log_tables(counted: DataFrame, share: float = 0.0) -> dict[tuple[str, int], DataFrame]:
    """counted(gram, n) -> for every order m: ("gram", m) code, v, often: interpolated modified Kneser-Ney log probabilities;
    ("context", m) code, v: log weights of what lies below, for the contexts of grams of that order.

    n is the occurrence count at the highest order and the number of different bytes before a gram below it; `often` is the
    occurrence count at every order. A stored gram's suffix is at least as frequent, so it is stored too. Every table has as many
    partitions as its rows ask for, low orders one: the driver keeps a record of every task of some hundred stages.
    """
    levels = {ORDER: counted.withColumn("often", F.col("n"))}
    for m in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND((1 << 8 * m) - 1)
        held = cut(levels[m + 1].groupBy(shorter.alias("gram")).agg(F.count(F.lit(1)).alias("n"), F.sum("often").alias("often")))
        levels[m] = gathered(held, 256**m)  # rows at most, whatever the corpus
    tallies = None
    for m, table in levels.items():
        one = table.agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)], F.count(F.lit(1)).alias("rows"), F.sum("often").alias("all")).withColumn("level", F.lit(m))
        tallies = one if tallies is None else tallies.unionByName(one)
    discounts, rows, least = {}, {}, 0.0
    for r in tallies.collect():  # one row an order
        rows[r["level"]] = r["rows"]
        n1, n2, n3, n4 = (r[f"n{k}"] for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        ratio = lambda a, b: a / b if b else 0.5
        discounts[r["level"]] = tuple(min(max(d, 0.05), k) for k, d in ((0.95, 1 - 2 * y * ratio(n2, n1)), (1.95, 2 - 3 * y * ratio(n3, n2)), (2.95, 3 - 4 * y * ratio(n4, n3))))
        least = share * (r["all"] or 0)
        levels[r["level"]] = gathered(levels[r["level"]], rows[r["level"]])
    model, lower = {}, None
    for m in range(1, ORDER + 1):
        d1, d2, d3 = discounts[m]
        table = levels[m].withColumn("context", F.shiftright("gram", 8))
        context = table.groupBy("context").agg(
            F.sum("n").alias("total"), (d1 * F.count_if(F.col("n") == 1) + d2 * F.count_if(F.col("n") == 2) + d3 * F.count_if(F.col("n") >= 3)).alias("kept_back")
        )
        context = context.select("context", "total", (F.col("kept_back") / F.col("total")).alias("weight"))
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        own = table.filter(F.col("often") >= least).join(context, "context").withColumn("own", F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total"))
        if lower is None:
            own = own.withColumn("lower", F.lit(1 / 256))
        else:
            own = own.withColumn("shorter", F.col("gram").bitwiseAND((1 << 8 * (m - 1)) - 1)).join(lower, "shorter")
        stored = gathered(cut(own.select("gram", "context", "lower", "often", (F.col("own") + F.col("weight") * F.col("lower")).alias("p"))), rows[m])
        model["gram", m] = stored.select(F.col("gram").alias("code"), _grains(F.log("p")).alias("v"), "often")
        rest = context.select("context", F.col("weight").alias("rest"))  # what the stored leave, if they are all
        if share:
            rest = stored.groupBy("context").agg((F.greatest(1 - F.sum("p"), F.lit(1e-9)) / F.greatest(1 - F.sum("lower"), F.lit(1e-9))).alias("rest"))
        model["context", m] = rest.select(F.col("context").alias("code"), _grains(F.log("rest")).alias("v"))
        lower = stored.select(F.col("gram").alias("shorter"), F.col("p").alias("lower"))
    return model


def fitted(counted: DataFrame, most: int) -> tuple[dict[tuple[str, int], tuple], dict[tuple[str, int], DataFrame] | None]:
    """Arrays of at most `most` grams an order, and the whole tables if there are more 5-grams (then the arrays hold 5-grams
    alone: any other may be a rare one, for whose probability the tables are asked)."""
    tables = log_tables(counted)
    highest = tables["gram", ORDER]
    n, total = highest.agg(F.count(F.lit(1)), F.sum("often")).first()
    if n <= most:
        return {k: _arrays(t.select("code", "v")) for k, t in tables.items()}, None
    frequent = highest.filter(F.col("often") * most >= total)
    return {("gram", ORDER): _arrays(frequent.select("code", "v"))}, tables | {k: cut(t) for k, t in tables.items() if k[0] == "context"}


def looked_up(asked: DataFrame, tables: dict[tuple[str, int], DataFrame]) -> DataFrame:
    """asked(gram), distinct -> gram, v: as `log_probabilities`, by joins with the whole tables."""
    left, done = asked.select("gram", F.lit(0.0).alias("v")), []
    for m in range(ORDER, 0, -1):
        short = F.col("gram").bitwiseAND((1 << 8 * m) - 1)
        own = tables["gram", m].select("code", F.col("v").alias("own"))
        met = cut(left.withColumn("code", short).join(own, "code", "left"))
        done.append(met.filter("own IS NOT NULL").select("gram", (F.col("v") + F.col("own")).alias("v")))
        below = tables["context", m].select("code", F.col("v").alias("own"))
        left = met.filter("own IS NULL").select("gram", "v", F.shiftright(short, 8).alias("code")).join(below, "code", "left")
        left = left.select("gram", (F.col("v") + F.coalesce("own", F.lit(0.0))).alias("v"))
    found = left.withColumn("v", F.col("v") - round(math.log(256) * _GRAIN) / _GRAIN)
    for part in done:
        found = found.unionByName(part)
    return found


def _find(arrays: tuple, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the grams are in the hash arrays, and their values (0 for others)."""
    hashes, values, begins, bits = arrays
    if not len(hashes):
        return np.zeros(len(code), bool), np.zeros(len(code), np.float32)
    want = _hash(code)
    at = begins[(want >> np.uint64(64 - bits)).view(np.int64)]
    known = hashes.take(at, mode="clip") == want  # most are the first with their leading bits
    found = values.take(at, mode="clip")
    left = np.flatnonzero(~known)
    found[left] = 0
    at, want = at[left], want[left]
    end = begins[(want >> np.uint64(64 - bits)).view(np.int64) + 1]
    while len(left):
        more = at + 1 < end
        left, at, end, want = left[more], at[more] + 1, end[more], want[more]
        hit = hashes[at] == want
        known[left[hit]], found[left[hit]] = True, values[at[hit]]
        left, at, end, want = left[~hit], at[~hit], end[~hit], want[~hit]
    return known, found


def log_probabilities(model: dict, code: np.ndarray) -> np.ndarray:
    """Natural log of each gram's last byte given the bytes before it, backing off where a gram isn't stored."""
    known, found = _find(model["gram", ORDER], code)
    out, todo = found.astype(np.float64), np.flatnonzero(~known)
    for m in range(ORDER, 0, -1):
        if not len(todo):
            return out
        short = code[todo] & ((1 << 8 * m) - 1)
        if m < ORDER:
            known, found = _find(model["gram", m], short)
            out[todo] += found
            todo, short = todo[~known], short[~known]
        out[todo] += _find(model["context", m], short >> 8)[1]
    out[todo] -= round(math.log(256) * _GRAIN) / _GRAIN
    return out


def _scored(batch: pa.RecordBatch, text_col: str, model, full: bool, partly: bool) -> dict[str, np.ndarray]:
    """Base statistics (all, or those that the verdict rests on) and, for each row, bytes and mean negative log probability of a
    byte (0 for no bytes). partly: entropy is the sum over grams in the arrays; the others are `rare`, `n_rare` of a row."""
    parts = [_of_slice(data, offsets, model, full=full, partly=partly) for _, _, data, offsets in slices(batch, text_col)]
    names = (*(FEATURES if full else VERDICT), "n_bytes", "entropy", *(("rare", "n_rare") if partly else ()))
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in names}


def _of_slice(data: np.ndarray, offsets: np.ndarray, model, code: np.ndarray | None = None, full: bool = False, partly: bool = False) -> dict[str, np.ndarray]:
    found = features(data, offsets) if full else repeats(data, len(offsets) - 1, words(data, offsets))
    found["n_bytes"] = np.diff(offsets)
    code = grams(data, offsets) if code is None else code
    if partly:
        known, logs = _find(model["gram", ORDER], code)
        found |= {"entropy": -per_row(logs.astype(np.float64), found["n_bytes"]), "rare": code[~known], "n_rare": per_row((~known).view(np.int8), found["n_bytes"])}
        return found
    found["entropy"] = -per_row(log_probabilities(model, code), found["n_bytes"]) / np.maximum(found["n_bytes"], 1)
    return found


def medians(*tables: DataFrame, columns: tuple[str, ...], grain: float = 1e-4) -> DataFrame:
    """lang, n and the lower median of every column, by language (null is one), to a grain. Values are counted by grains, and
    the counts summed up in order, so that medians don't depend on how rows are dealt out."""
    parts = [t.select("lang", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.round(F.col(c) / grain).cast("bigint").alias("grains")) for c in columns])).alias("v")) for t in tables]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    counts = every.groupBy("lang", "v.name", "v.grains").agg(F.count(F.lit(1)).alias("k"))
    group = Window.partitionBy("lang", "name")
    summed = counts.withColumns({"upto": F.sum("k").over(group.orderBy("grains")), "n": F.sum("k").over(group)})
    middle = summed.filter(F.col("upto") * 2 >= F.col("n")).groupBy("lang", "name").agg(F.min("grains").alias("middle"), F.max("n").alias("n"))
    return middle.groupBy("lang").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("name") == c, F.col("middle") * grain)).alias(c) for c in columns])


class Rules:
    """A fitted model: Kneser-Ney arrays (broadcast) and bands by language.

    by_byte, by_word: how far below and above the median a document may be, in median absolute deviations.
    core: the share of those distances within which the documents lie that the second model is counted over.
    short: bytes at which a text's band is 1.4 times as wide as a long one's.
    least: documents as which the deviation within all languages counts, beside a language's own.
    most: grams of an order that are broadcast at most; the result doesn't depend on it.
    """

    def __init__(
        self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", by_byte: tuple[float, float] = (7.0, 7.0), by_word: tuple[float, float] = (7.0, 7.0),
        core: float = 0.35, short: int = 1600, least: int = 100, most: int = 1 << 20,
    ):
        self.docs, self.id_col, self.text_col, self.lang_col, self.limits, self.short = docs, id_col, text_col, lang_col, (by_byte, by_word), short
        context = docs.sparkSession.sparkContext
        usable = lambda lang, data, offsets, code: ~base_failed(repeats(data, len(offsets) - 1, words(data, offsets)))
        arrays, first_tables = fitted(cut(count_grams(docs, text_col, lang_col, usable)), most)
        first = context.broadcast(arrays)
        del arrays
        give_back()
        self.scored = self._whole(self._score(docs, first, False, first_tables is not None), first_tables)
        self.bands = self._bands(least)
        self.limits = tuple((core * a, core * b) for a, b in self.limits)
        verdict = self._verdict_of()

        def near(lang, data, offsets, code):
            found = _of_slice(data, offsets, first.value, code)
            return verdict(lang, found, base_failed(found))

        if first_tables is None:
            counted = cut(count_grams(docs, text_col, lang_col, near))
        else:
            stays = self._judged(self.scored, VERDICT).select("doc_id", "digest", F.col("kept").alias("stays"))
            counted = cut(count_grams(settle(docs, stays, id_col, self._digest(docs), once=False), text_col, lang_col, lambda lang, data, offsets, code: np.ones(len(lang), bool)))
        arrays, self.tables = fitted(counted, most)
        self.model = context.broadcast(arrays)
        first.destroy()
        self.scored = self._whole(self._score(docs, self.model, partly=self.tables is not None), self.tables)
        self.limits = (by_byte, by_word)
        self.bands = self._bands(least)
        del arrays
        give_back()

    def _whole(self, scored: DataFrame, tables: dict | None) -> DataFrame:
        """Scores, materialised, with what grams outside the arrays add."""
        if tables is None:
            return cut(scored)
        partly = cut(scored.withColumn("row", F.monotonically_increasing_id()))
        rare = partly.select("row", F.explode("rare").alias("gram"))
        sums = rare.join(cut(looked_up(rare.select("gram").distinct(), tables)), "gram").groupBy("row").agg(F.sum("v").alias("v"))
        added = (F.col("entropy") - F.coalesce("v", F.lit(0.0))) / F.greatest("n_bytes", F.lit(1))
        return cut(partly.drop("rare").join(sums, "row", "left").withColumn("entropy", added).drop("row", "v"))

    def _score(self, docs: DataFrame, model, full: bool = True, partly: bool = False) -> DataFrame:
        text_col, names = self.text_col, FEATURES if full else VERDICT
        kind = docs.schema[self.id_col].dataType.simpleString()

        def run(batches):
            for batch in batches:
                found = _scored(batch, text_col, model.value, full, partly)
                arrays = [batch.column(0), batch.column(2), batch.column(3), *[pa.array(found[k].astype(np.int64)) for k in (*names, "n_bytes")], pa.array(found["entropy"].astype(np.float64))]
                if partly:
                    ends = np.append(0, np.cumsum(found["n_rare"])).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(found["rare"].astype(np.int64))))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang", "digest", *names, "n_bytes", "entropy", *(["rare"] if partly else [])])

        columns = [F.col(self.id_col).alias("doc_id"), F.col(self.text_col), F.col(self.lang_col).cast("string").alias("lang"), self._digest(docs).alias("digest")]
        return docs.select(*columns).mapInArrow(tidy(run), f"doc_id {kind}, lang string, digest binary, {', '.join(f'{k} bigint' for k in names)}, n_bytes bigint, entropy double{', rare array<bigint>' if partly else ''}")

    def _digest(self, docs: DataFrame):
        """Of all that decides on a row: its text and language."""
        text, lang = (F.coalesce(docs[f"`{c}`"].cast("string"), F.lit("\0")) for c in (self.text_col, self.lang_col))
        return F.unhex(F.md5(F.concat(text, F.lit("\0"), lang).cast("binary")))

    def _bands(self, least: int) -> dict[str | None, tuple[tuple[float, float], ...]]:
        """By language, for entropy per byte and per word, the median and median absolute deviation; under None of all."""
        used = self.scored.filter("n_words >= 20 AND 100 * n_repeat_words <= 30 * n_words")
        used = used.select("lang", F.col("entropy").alias("byte"), (F.col("entropy") * F.col("n_bytes") / F.col("n_words")).alias("word"))
        kinds = ("byte", "word")
        found = medians(used.select(F.lit(None).cast("string").alias("lang"), *kinds), used.filter("lang IS NOT NULL"), columns=kinds)
        by_lang = cut(found.select("lang", "n", *[F.col(c).alias(f"{c}_mid") for c in kinds]))
        languages = by_lang.count()
        by_lang = gathered(by_lang, languages)
        whole = by_lang.filter("lang IS NULL").first()
        if whole is None:
            return {None: ((0.0, 0.0), (0.0, 0.0))}
        away = lambda c: F.abs(F.col(c) - F.col(f"{c}_mid"))
        from_whole = used.withColumns({f"{c}_mid": F.lit(whole[f"{c}_mid"]) for c in kinds}).select(F.lit(None).cast("string").alias("lang"), *[away(c).alias(c) for c in kinds])
        spread = medians(from_whole, columns=kinds).first()
        bands: dict[str | None, tuple] = {None: tuple((float(whole[f"{c}_mid"]), float(spread[c])) for c in kinds)}
        own = used.join(bounded(by_lang.filter("lang IS NOT NULL").drop("n")), "lang").select("lang", *[(away(c) / F.greatest(F.abs(f"{c}_mid"), F.lit(1e-9))).alias(c) for c in kinds])
        shares = cut(medians(own, own.withColumn("lang", F.lit(None).cast("string")), columns=kinds, grain=1e-5).drop("n"))
        shares = gathered(shares, languages)
        pooled = shares.filter("lang IS NULL").first()
        for r in by_lang.join(shares, "lang").collect():  # one row a language
            drawn = [(r["n"] * r[c] + least * pooled[c]) / (r["n"] + least) for c in ("byte", "word")]
            bands[r["lang"]] = tuple((float(r[f"{c}_mid"]), float(abs(r[f"{c}_mid"]) * x)) for c, x in zip(("byte", "word"), drawn, strict=True))
        return bands

    def _verdict(self, lang: list, found: dict[str, np.ndarray], failed: np.ndarray) -> np.ndarray:
        every = self.bands[None]
        bands = np.array([self.bands.get(x, every) for x in lang], np.float64).reshape(-1, 2, 2)
        wide = np.sqrt(1 + self.short / np.maximum(found["n_bytes"], 1))
        kept = ~failed
        for k, value in enumerate((found["entropy"], found["entropy"] * found["n_bytes"] / np.maximum(found["n_words"], 1))):
            middle, spread = bands[:, k].T
            away = (value - middle) / (np.maximum(spread, 0.002 * np.abs(middle) + 1e-9) * wide)
            kept &= (away >= -self.limits[k][0]) & (away <= self.limits[k][1])
        return kept

    def score(self) -> DataFrame:
        """Per document: doc_id, base statistics, base_failed, kept, entropy (nats a byte)."""
        names = [*FEATURES, "base_failed", "kept", "entropy"]
        return self._judged(self.scored).select("doc_id", *names)

    def _judged(self, scored: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
        verdict = self._verdict_of()
        kind = self.scored.schema["doc_id"].dataType.simpleString()

        def run(batches):
            for batch in batches:
                found = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in (*names, "n_bytes", "entropy")}
                failed = base_failed(found)
                kept = verdict(batch.column("lang").to_pylist(), found, failed)
                arrays = [batch.column("doc_id"), batch.column("digest"), *[batch.column(k) for k in names], pa.array(failed), pa.array(kept), batch.column("entropy")]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "digest", *names, "base_failed", "kept", "entropy"])

        return scored.mapInArrow(run, f"doc_id {kind}, digest binary, {', '.join(f'{k} bigint' for k in names)}, base_failed boolean, kept boolean, entropy double")

    def _verdict_of(self):
        bare = object.__new__(Rules)  # without tables and broadcasts
        bare.bands, bare.limits, bare.short = self.bands, self.limits, self.short
        return bare._verdict

    def keep_clean(self, docs: DataFrame) -> DataFrame:
        """The rows that pass, with all their columns. The documents that were fitted on aren't scored again."""
        verdicts = self._judged(self.scored if docs is self.docs else self._whole(self._score(docs, self.model, partly=self.tables is not None), self.tables)).select("doc_id", "digest", F.col("kept").alias("stays"))
        return settle(docs, verdicts, self.id_col, self._digest(docs), once=False)
