"""Hashed byte n-gram counts of texts, shared by the two classifiers, and bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lowered, mix, span_hashes, words


def folded(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of the Latin-1 supplement, in UTF-8, as small letters."""
    out = lowered(data)
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    out[capital] += 0x20
    return out


def gram_counts(data: np.ndarray, offsets: np.ndarray, width: int, sizes: tuple[int, ...] = (2, 3)) -> np.ndarray:
    """A row of hashed byte n-gram counts for each text."""
    rows, n = len(offsets) - 1, len(data)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    total = np.zeros(rows * width, np.float32)
    wide = data.astype(np.uint32)
    for size in sizes:
        if n < size:
            continue
        code = wide[: n - size + 1].copy()
        for k in range(1, size):
            code = (code << np.uint32(8)) | wide[k : n - size + 1 + k]
        inside = row[: n - size + 1] == row[size - 1 :]
        slot = ((code * np.uint32(2654435761)) >> np.uint32(8)) % np.uint32(width)
        total += np.bincount(row[: n - size + 1][inside] * width + slot[inside], minlength=rows * width)
    return total.reshape(rows, width)


def repeat_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text: words, words like the one before, distinct words (columns)."""
    rows = len(offsets) - 1
    starts, stops, row = words(data, offsets)
    hashes = span_hashes(data, starts, stops)
    same = np.zeros(len(row), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    with np.errstate(over="ignore"):
        keys = np.unique(mix(hashes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    return np.stack([np.bincount(r, minlength=rows) for r in (row, row[same], row[keys])], axis=1).astype(np.float32)


def sampled(rows: DataFrame, label: str, most: int, key: Column) -> DataFrame:
    """About `most` rows in equal shares of the labels (fewer where a label has fewer), by a hash of the key: a fixed sample.

    Labels stay in a table, whatever their number; the driver sees how many labels have how many rows. Labels that outnumber
    `most` share the rows by the same hash, so that some have none.
    """
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("rows_of_label"))
    sizes = sorted(tuple(r) for r in counts.groupBy("rows_of_label").agg(F.count(F.lit(1))).collect())
    labels = sum(k for _, k in sizes)
    rest, left = labels, float(most)
    for n, k in sizes:
        if rest and n <= left / rest:
            rest, left = rest - k, left - n * k
    share = left / rest if rest else float("inf")
    counts = F.broadcast(counts) if labels <= 100_000 else counts
    chosen = F.pmod(F.xxhash64(key), F.lit(1_000_003)) / 1_000_003 < F.least(F.lit(1.0), F.lit(share) / F.col("rows_of_label"))
    return rows.join(counts, label).filter(chosen).select(*rows.columns)
