"""Operator 8, SimHash near-deduplication with pivot distance tables.

Fingerprints are made once for each text and reduced to distinct values (with their smallest document id) before anything
is compared. The pivot distance table is made once for each distinct fingerprint: its Hamming distances to ``PIVOTS``
reference fingerprints, eight in a 64-bit column. By the triangle inequality a pair whose distances to any reference differ
by more than the radius is discarded, all coordinates at once; survivors are verified.

Which pairs are held against the table: a pair within ``radius`` bits agrees on one of radius + 1 blocks of bits, so
fingerprints meet by block value. Buckets of more than ``most`` fingerprints are split by a block of the remaining bits,
again and again until none is larger, which loses no pair. (It ends: many distinct fingerprints that agree on many bits must
differ in the others.) So a bucket never outgrows a task; buckets hand on spanning edges only, never all pairs. Components
over distinct fingerprints are found by star contraction, and each document takes its fingerprint's component.

Defined results: null and empty texts, and texts without a word, have fingerprint zero and link like any other; texts with
fewer words than a shingle give one shingle of all their words; a repeated document id counts once, its rows repeat in the
result, and where all ids of a component are null so is the component; an empty table gives an empty result; further columns
are ignored by `assign` and kept by `one_of_each`, which keeps one row of each component, whatever ids its rows have.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, settle, shuffles, tidy
from .components import components, local_components

SEED = 42
PIVOTS = 16
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: str | None, size: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed integer."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, and only ASCII white space splits
    if not words:
        return 0
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]
    values = np.array(hashes, "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 16):
        counts += np.unpackbits(values[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(values)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, digest: Column | None = None) -> DataFrame:
    """doc_id, digest (null unless given), fp (signed 64-bit) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            made = [fingerprint(t.as_py(), size) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.int64())], names=["doc_id", "digest", "fp"])

    digest = F.lit(None).cast("binary") if digest is None else digest
    return docs.select(F.col(id_col).alias("doc_id"), digest.alias("digest"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, digest binary, fp bigint")


def reference_fingerprints(count: int = PIVOTS, seed: int = 20) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def pivot_columns(fp: Column, pivots: np.ndarray) -> list[Column]:
    """The distance table's row of a fingerprint: a byte for the Hamming distance to each reference, eight bytes a column."""
    columns = []
    for at in range(0, len(pivots), 8):
        parts = [F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(int(p.view(np.int64))))).cast("bigint"), 8 * k) for k, p in enumerate(pivots[at : at + 8])]
        word = parts[0]
        for part in parts[1:]:
            word = word.bitwiseOR(part)
        columns.append(word.alias(f"pivots{at // 8}"))
    return columns


def within(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Whether no coordinate of two rows of the table (bytes of 64-bit words) differs by more than the radius."""
    high, wide = _LANES * np.uint64(0x80), _LANES * np.uint64(radius)
    with np.errstate(over="ignore"):
        return (((((a | high) + wide) - b) & (((b | high) + wide) - a)) & high) == high  # distances are at most 64: no lane carries


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    edges = [len(bits) * i // parts for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def _dealt(now: DataFrame, radius: int) -> DataFrame:
    """Each row once for every block of the bits that its bucket leaves free: bucket (a hash of the fixed bits), fixed bits."""
    names = now.columns

    def run(batches):
        for batch in batches:
            fixed = batch.column("fixed").to_numpy()
            for f in np.unique(fixed).tolist():
                own = batch.filter(pa.array(fixed == f))
                free = [b for b in range(64) if not (f >> b) & 1]
                for block in _blocks(free, radius + 1):
                    arrays = [pa.array(np.full(own.num_rows, f | _mask(block), np.int64)) if c == "fixed" else own.column(c) for c in names]
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    made = now.mapInArrow(run, now.schema)
    return made.withColumn("bucket", F.xxhash64("fixed", F.col("fp").bitwiseAND(F.col("fixed"))))


def buckets(distinct: DataFrame, radius: int, most: int) -> DataFrame:
    """(bucket, fp, further columns) rows such that every pair within the radius shares a bucket, none of over `most` rows.

    A bucket's number is a hash of which bits it fixes and of their values; different buckets that collide only add
    candidates, which are verified.
    """
    done = None
    now = distinct.withColumns({"fixed": F.lit(0).cast("bigint"), "bucket": F.lit(0).cast("bigint")})
    while True:
        dealt = cut(_dealt(now, radius))
        counts = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        held = dealt.join(counts.filter(F.col("n") <= most).select("bucket"), "bucket", "left_semi").drop("fixed")
        done = held if done is None else done.unionByName(held)
        large = counts.filter(F.col("n") > most).select("bucket")
        if large.isEmpty():
            return done
        now = dealt.join(large, "bucket", "left_semi").select(*now.columns)


def bucket_edges(bucket: np.ndarray, fp: np.ndarray, radius: int, table: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the links within each run of equal buckets; all values of a bucket are there, sorted by bucket.

    table: the pivot distance table's columns for these fingerprints.
    """
    n = len(fp)
    value = fp.view(np.uint64)
    table = [x.view(np.uint64) for x in table]
    heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    room = np.repeat(np.append(heads[1:], n), np.diff(np.append(heads, n))) - np.arange(n) - 1  # members after each one
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held, step = 0, 1
    left = np.flatnonzero(room >= step)
    while len(left):
        near = left
        for column in table:
            near = near[within(column[near], column[near + step], radius)]
        near = near[np.bitwise_count(value[near] ^ value[near + step]) <= radius]
        if len(near):
            found.append((near, near + step))
            held += len(near)
        if held > 500_000:
            found = [_spanning(n, found)]
            held = len(found[0][0])
        step += 1
        left = left[room[left] >= step]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = _spanning(n, found)
    return fp[a], fp[b]


def _spanning(n: int, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    used, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = local_components(len(used), index[: len(a)], index[len(a) :])
    own = np.flatnonzero(root != np.arange(len(used)))
    return used[own], used[root[own]]


def links(distinct: DataFrame, radius: int = 3, pivots: int = PIVOTS, most: int = 2048) -> DataFrame:
    """distinct(fp) -> spanning edges (a, b) of the graph of fingerprints within the radius."""
    tabled = distinct.select("fp", *pivot_columns(F.col("fp"), reference_fingerprints(pivots)))
    names = ["bucket", *tabled.columns]
    dealt = buckets(tabled, radius, most).select(*names)
    parts = max(shuffles(distinct), 1)

    def run(batches):
        rest = [np.zeros(0, np.int64) for _ in names]
        for batch in batches:
            rows = [np.concatenate([r, batch.column(c).to_numpy()]) for r, c in zip(rest, names, strict=True)]
            b = rows[0]
            whole = int(np.searchsorted(b, b[-1], "left")) if len(b) else 0  # the last bucket may go on
            if whole:
                x, y = bucket_edges(b[:whole], rows[1][:whole], radius, [c[:whole] for c in rows[2:]])
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
            rest = [c[whole:] for c in rows]
        if len(rest[0]):
            x, y = bucket_edges(rest[0], rest[1], radius, rest[2:])
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "fp").mapInArrow(tidy(run), "a bigint, b bigint")


def _classes(rows: DataFrame, radius: int, pivots: int, most: int) -> DataFrame:
    """rows(doc_id, fp) -> fp, root: the component of every distinct fingerprint, and its smallest document id."""
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), radius, pivots, most))
    member = cut(distinct.join(roots, distinct["fp"] == roots["vertex"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = cut(member.groupBy("root").agg(F.min("least").alias("component_id")))  # a plain side of the join, so that a large component is split
    return member.join(ids, "root").select("fp", "root", "component_id")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 3, pivots: int = PIVOTS, most: int = 2048) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id."""
    rows = cut(fingerprints(docs, id_col, text_col, size).drop("digest"))
    classes = _classes(rows, radius, pivots, most)
    return rows.join(classes, "fp").select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 3, pivots: int = PIVOTS, most: int = 2048) -> DataFrame:
    """One row of each component, with its own columns: that with the smallest id (null last), of equal ids the one with the
    smallest fingerprint and text digest. Components with null or shared ids keep a row each."""
    digest = F.unhex(F.md5(F.coalesce(docs[f"`{text_col}`"], F.lit("")).cast("binary")))
    rows = cut(fingerprints(docs, id_col, text_col, size, digest))
    found = rows.join(_classes(rows, radius, pivots, most).select("fp", "root"), "fp")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "fp", "digest")
    chosen = cut(found.groupBy("root").agg(F.min(order).alias("first")))
    verdicts = found.join(chosen, "root").select("doc_id", "digest", (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))).alias("stays"))
    return settle(docs, verdicts, id_col, digest)
