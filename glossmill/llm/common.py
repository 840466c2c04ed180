"""Helpers that several operators share: storage for intermediate tables and flat views of Arrow text."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, gathered, shared_folder, small_batches  # noqa: F401

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of a file system that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: like `cut`, but compressed."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def bounded(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df for the side of a join, materialised and counted: broadcast if it has at most `most` rows, else as Spark sees fit."""
    held = cut(df)
    return F.broadcast(held) if held.limit(most + 1).count() <= most else held


#: Tables that a worker keeps from task to task, and every operator that keeps none may drop.
KEPT: dict[tuple, object] = {}


def tidy(run: Callable, keeps: bool = False) -> Callable:
    """A mapInArrow function that hands its task's memory back to the system when the task ends: workers outlive tasks.

    keeps: the function uses KEPT; any other begins by emptying it.
    """

    def tidied(batches: Iterable) -> Iterator:
        if not keeps:
            KEPT.clear()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def give_back() -> None:
    """Hand memory that isn't used any more back to the system, in a worker or, after a fit, in the driver's Python."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library; it keeps what it has


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, in either case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def settle(docs: DataFrame, verdicts: DataFrame, id_col: str, digest: Column, most: int = 200_000, once: bool = True) -> DataFrame:
    """The rows of docs that stay, with all their columns; once each, or (once=False) as often as they are there.

    verdicts(doc_id, digest, stays), a row for each row of docs, says which pairs of id and digest stay; digest is the same
    expression over docs. Texts stay where they are as long as the pairs that go, and those that stay but are repeated, are
    at most `most` (counted, then broadcast); else the pairs are joined by an ordinary shuffle. The result is the same.
    """
    gone_id, gone_digest = unused(docs, "gone_id", "gone_digest")
    pairs = verdicts.groupBy("doc_id", "digest").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n")).filter("NOT stays OR n > 1" if once else "NOT stays")
    pairs = cut(pairs.select(F.col("doc_id").alias(gone_id), F.col("digest").alias(gone_digest), "stays"))
    small = pairs.limit(most + 1).count() <= most
    hint = F.broadcast if small else (lambda x: x)
    own = docs.columns

    def met(table: DataFrame, how: str) -> DataFrame:
        return docs.join(hint(table.select(gone_id, gone_digest)), docs[f"`{id_col}`"].eqNullSafe(F.col(gone_id)) & (digest == F.col(gone_digest)), how)

    plain = met(pairs, "left_anti")
    twice = pairs.filter("stays")
    if not once or twice.isEmpty():
        return plain
    mark, nth = unused(docs, "digest_of_row", "nth_of_row")
    again = met(twice, "left_semi").withColumn(mark, digest)
    group = Window.partitionBy(f"`{id_col}`", mark).orderBy(mark)  # Spark keeps one row of each group on the map side already
    again = again.withColumn(nth, F.row_number().over(group)).filter(F.col(nth) == 1)
    return plain.unionByName(again.select(*[F.col(f"`{c}`") for c in own]))


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII rows take the fast built-in; the others a character map."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, LETTERS, LETTERS.lower()))


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of a value's decimal text, modulo a number; null for null."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def shuffles(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 500_000, max_rows: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of at most max_rows rows and about max_bytes of text: (first row, rows, bytes, offsets).

    A text longer than that is a run of its own, whole. Null is empty text.
    """
    text = batch.column(column)
    if text.null_count:
        text = pc.fill_null(text, "")
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    _, at, data = text.buffers()
    rows = len(text)
    offsets = np.frombuffer(at, kind, rows + 1, text.offset * np.dtype(kind).itemsize).astype(np.int64) if at is not None and rows else np.zeros(rows + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1)
        last = min(last, rows, first + max_rows)
        own = offsets[first : last + 1]
        yield first, last - first, data[own[0] : own[-1]], own - own[0]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of [^\\x20\\x09-\\x0D]+ in every row: first byte, byte after the last, row."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    solid = ~_WHITE[data]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    begins[heads] = solid[heads]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    tails = offsets[1:][np.diff(offsets) > 0] - 1
    ends[tails] = solid[tails]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(offsets, starts, "right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_BACK = pow(_BASE, -1, 1 << 64)
_LONG = 512
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 1 << 20:
            _POWERS[base] = have
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, from one running sum over the whole array.

    A sum of powers modulo 2^64 can't tell some texts of a thousand characters apart whatever its base, so long spans, which are
    few, are hashed one by one.
    """
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), dtype=np.uint64, out=total[1:])
        got = (total[stops] - total[starts]) * _powers(_BACK, len(data) + 1)[starts]
        found = mix(got + (stops - starts).astype(np.uint64))
    for i in np.flatnonzero(stops - starts >= _LONG).tolist():
        found[i] = xxhash.xxh3_64_intdigest(data[starts[i] : stops[i]])
    return found


def per_row(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of values over consecutive runs of the given lengths, 0 for empty runs."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
