"""Operator 11, vector code compression: product quantisation whose nearest entries are found by annular norm pruning.

Components become integers, vectors are cut into equal parts, and every part position has a codebook that is fitted by
rounds of assignment and averaging. All arithmetic is exact. To assign a part, the codebook's entries are sorted by norm: an
entry at distance d of the part has a norm within d of the part's own, so that the best distance so far allows an interval of
norms, found by binary search. The best distance starts at the entries whose norms lie next to the part's; then the entries of
the annulus, both ends included, are evaluated exactly, and the least distance with the lowest index wins.

Every round is one pass over the table: tasks sum up the parts of each entry, Spark adds the sums, and the driver sees one row
for each entry. Codebooks (entries x components) go to the tasks with the function.

Defined results: vectors that are null, or hold null or non-finite components, are dropped; vectors shorter than the longest
one, or than a multiple of the number of parts, count as ended by zeros; null ids come after all others when the first
codebook is chosen, equal ids are ordered by their vectors; repeated rows count each time; null labels are one label; an
error beyond 64 bits is null (components of any finite size are computed with Python's integers); an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy

_BLOCK = 32  # components in a row of sums
_LIMB = 32  # bits
_EXACT = float(1 << 53)
_ROWS = 2048  # vectors held at once


def integers(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); whole floats, or Python's integers where floats can't hold the products. scale is a power of two."""
    flat = flat.astype(np.float64)
    if not len(flat) or np.abs(flat).max() < 1e300:
        return np.floor(flat * scale)
    return np.array([int(x) * scale if abs(x) > 1e300 else math.floor(x * scale) for x in flat.tolist()], object)


def vectors(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """A matrix of integers, zeros where a vector is shorter than the width."""
    sizes = np.diff(column.offsets.to_numpy())
    values = integers(column.flatten().to_numpy(zero_copy_only=False), scale)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    made = np.zeros((len(sizes), width), values.dtype)
    made[np.arange(width) < sizes[:, None]] = values
    return made


class Codebook:
    """The entries of one part position, sorted by norm."""

    def __init__(self, entries: list[list[int]]):
        self.entries = entries
        self.norms2 = [sum(x * x for x in e) for e in entries]
        self.order = np.array(sorted(range(len(entries)), key=self.norms2.__getitem__), np.int64)
        self.most = max((abs(x) for e in entries for x in e), default=0)
        if self.most < 1 << 26:
            self.sorted = np.array([entries[i] for i in self.order], np.float64)
            self.sorted2 = np.array([self.norms2[i] for i in self.order], np.float64)
            self.norm = np.sqrt(self.sorted2)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each part the nearest entry's index and squared distance."""
        if not self._fits(parts):
            found = [self._nearest_exact([int(x) for x in p]) for p in parts]
            return np.array([i for i, _ in found], np.int64), np.array([d for _, d in found], object)
        own2 = (parts * parts).sum(1)
        own = np.sqrt(own2)
        near = np.searchsorted(self.norm, own)
        best = np.full(len(parts), np.inf)
        for k in (near - 1, near):  # the entries beside the part by norm give the first best distances
            away = parts - self.sorted[np.clip(k, 0, len(self.norm) - 1)]
            best = np.minimum(best, (away * away).sum(1))
        reach = np.sqrt(best)
        slack = 1e-9 * (own + reach) + 1e-9  # square roots are rounded; a wider annulus only costs time
        low = np.searchsorted(self.norm, own - reach - slack, "left")
        high = np.searchsorted(self.norm, own + reach + slack, "right")
        key = np.empty(len(parts), np.int64)
        by_norm = np.argsort(own, kind="stable")
        for first in range(0, len(parts), 256):  # parts of like norm have like annuli
            rows = by_norm[first : first + 256]
            a, b = int(low[rows].min()), int(high[rows].max())
            away = own2[rows, None] + self.sorted2[a:b] - 2 * (parts[rows] @ self.sorted[a:b].T)
            place = np.arange(a, b)
            inside = (place >= low[rows, None]) & (place < high[rows, None])
            key[rows] = np.where(inside, away * 256 + self.order[a:b], _EXACT).min(1).astype(np.int64)
        return key & 255, key >> 8

    def _fits(self, parts: np.ndarray) -> bool:
        """Whether floats hold all sums of products exactly, times the 256 that the key has for the index."""
        if parts.dtype == object or self.most >= 1 << 26:
            return False
        most = float(np.abs(parts).max()) if parts.size else 0.0
        return parts.shape[1] * (most + self.most) ** 2 * 256 < _EXACT

    def _nearest_exact(self, part: list[int]) -> tuple[int, int]:
        """The same with Python's integers, outward from the part's norm until no norm can be within the best distance."""
        own2, best = sum(x * x for x in part), None
        for i in sorted(self.order.tolist(), key=lambda i: abs(math.isqrt(self.norms2[i]) - math.isqrt(own2))):
            if best is not None and max(0, abs(math.isqrt(self.norms2[i]) - math.isqrt(own2)) - 1) ** 2 > best[0]:
                break
            got = (sum((x - y) ** 2 for x, y in zip(part, self.entries[i], strict=True)), i)
            best = got if best is None or got < best else best
        return best[1], best[0]


def _limbs(x: int, n: int) -> list[int]:
    """Whole numbers whose sum, each times 2^32 more than the one before, is x; all but the last are not negative."""
    return [(x >> _LIMB * k) & ((1 << _LIMB) - 1) for k in range(n - 1)] + [x >> _LIMB * (n - 1)]


def _sums(kept: DataFrame, books: list[Codebook], width: int, scale: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """For every part position and entry in use: how many parts it has, and their sum. One row an entry reaches the driver."""
    size, k = width // len(books), len(books[0].entries)
    names = ["part", "entry", "block", "limb", "n", *[f"c{i}" for i in range(_BLOCK)]]

    def run(batches):
        totals = [np.zeros((k, size), object) for _ in books]
        counts = np.zeros((len(books), k), np.int64)
        fast = [np.zeros((k, size), np.int64) for _ in books]
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                own = vectors(batch.column(0).slice(at, _ROWS), width, scale)
                for p, book in enumerate(books):
                    part = own[:, p * size : (p + 1) * size]
                    index, _ = book.nearest(part)
                    counts[p] += np.bincount(index, minlength=k)
                    if part.dtype == object or np.abs(part).max(initial=0) >= 1 << 40:
                        for i, row in zip(index.tolist(), part, strict=True):
                            totals[p][i] += [int(x) for x in row]
                    else:
                        where = (index[:, None] * size + np.arange(size)).ravel()
                        fast[p] += np.bincount(where, part.ravel(), k * size).reshape(k, size).astype(np.int64)
        rows = []
        for p in range(len(books)):
            whole = totals[p] + fast[p].astype(object)
            for e in np.flatnonzero(counts[p]).tolist():
                values = whole[e].tolist()
                bits = max((abs(x).bit_length() for x in values), default=0)
                limbs = 1 + max(0, -(-(bits - 40) // _LIMB))  # so that the sums of millions of tasks fit
                split = [_limbs(x, limbs) for x in values] + [[0] * limbs] * (-size % _BLOCK)
                for j in range(limbs):
                    for b in range(max(1, -(-size // _BLOCK))):
                        cells = [x[j] for x in split[b * _BLOCK : (b + 1) * _BLOCK]]
                        rows.append((p, e, b, j, int(counts[p, e]), *cells, *[0] * (_BLOCK - len(cells))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)

    made = kept.select("vector").mapInArrow(tidy(run), ", ".join(f"{c} bigint" for c in names))
    keys = names[:4]
    found: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in made.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names[4:]]).collect():
        n, values = found.get((r["part"], r["entry"]), (0, [0] * (size + _BLOCK)))
        for i in range(_BLOCK):
            at = r["block"] * _BLOCK + i
            if at < size:
                values[at] += r[f"c{i}"] << _LIMB * r["limb"]
        found[r["part"], r["entry"]] = (r["n"] if not r["limb"] and not r["block"] else n, values)
    return {key: (n, values[:size]) for key, (n, values) in found.items()}


def fit(kept: DataFrame, width: int, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> list[Codebook]:
    """Codebooks of kept(id, vector): the first entries are the parts of the smallest ids."""
    size = width // parts
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    matrix = [[int(x) for x in integers(np.array(r[0], np.float64), scale)] + [0] * (width - len(r[0])) for r in first]
    books = [Codebook([v[p * size : (p + 1) * size] for v in matrix]) for p in range(parts)]
    for _ in range(rounds if first else 0):
        sums = _sums(kept, books, width, scale)
        books = [Codebook([[x // sums[p, e][0] for x in sums[p, e][1]] if (p, e) in sums else old for e, old in enumerate(book.entries)]) for p, book in enumerate(books)]
    return books


def encode(table: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per kept vector: vec_id, code, error, label_error, codebooks_sha256. At most 256 entries; scale is a power of two."""
    if not 0 < entries <= 256 or scale & (scale - 1):
        raise ValueError("entries up to 256 and a scale that is a power of two are needed")
    named = table.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = named.filter(F.col("vector").isNotNull() & ~bad)
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // parts) * parts
    books = fit(kept, width, parts, entries, rounds, scale)
    size = width // parts
    text = ",".join(str(x) for book in books for e in book.entries for x in e)
    kinds = {f.name: f.dataType for f in kept.schema}

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                rows = batch.slice(at, _ROWS)
                own = vectors(rows.column(2), width, scale)
                found = [book.nearest(own[:, p * size : (p + 1) * size]) for p, book in enumerate(books)]
                codes = ["".join(f"{i:02x}" for i in row) for row in np.stack([i for i, _ in found], 1).tolist()]
                errors = [sum(row) for row in zip(*[d.tolist() for _, d in found], strict=True)]
                errors = [x if x < 1 << 63 else None for x in errors]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["id", "label", "code", "error"])

    coded = cut(kept.mapInArrow(tidy(run), f"id {kinds['id'].simpleString()}, label {kinds['label'].simpleString()}, code string, error bigint"))
    totals = coded.groupBy("label").agg(F.when(F.count("error") == F.count(F.lit(1)), F.try_sum("error")).alias("label_error"), F.count(F.lit(1)).alias("n"))
    return _with_totals(coded, totals).select(F.col("id").alias(id_col), "code", "error", "label_error", F.sha2(F.lit(text), 256).alias("codebooks_sha256"))


def _with_totals(coded: DataFrame, totals: DataFrame, most: int = 100_000) -> DataFrame:
    """Each row beside its label's total. Totals are broadcast, or, where there are too many, those of the frequent labels are
    (there are fewer than `most` labels of over a `most`-th of the rows) and the rest go by an ordinary join."""
    own = cut(totals.withColumnRenamed("label", "of_label"))
    meets = F.col("label").eqNullSafe(F.col("of_label"))
    if own.limit(most + 1).count() <= most:
        return coded.join(F.broadcast(own), meets)
    rows = own.agg(F.sum("n")).first()[0]
    heavy = F.broadcast(cut(own.filter(F.col("n") * most > rows)))
    return coded.join(heavy, meets).unionByName(coded.join(heavy, meets, "left_anti").join(own, meets))
