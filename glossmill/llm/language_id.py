"""Operator 3, language identification by error-correcting output codes.

Each learned language has a codeword. Binary classifiers over hashed byte 1- to 3-grams, one for each bit, are fitted on a
bounded sample of labelled rows (``most``, in equal shares of the languages) by regularised least squares; a text gets the
language whose codeword has the least loss, a logistic loss of each bit's margin weighted by how well that bit is told on
the sample. The score is the share of the chosen language in exp(-loss); texts whose score is under ``sure`` are flagged
``ambiguous``.

Defined results: null text, or text without a letter, is ``und`` with score 0; texts are read whole; rows with a null
language are not learned from; with nothing to learn from, every text is ``und``; ties go to the language first in
alphabetical order; repeated rows repeat; an empty table gives an empty result; further columns are ignored by `predict`,
kept by `keep_known`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, slices, tidy
from .hashed import folded, gram_counts, sampled

WIDTH = 2048
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """One row of +1 and -1 for each class: all splits for up to 7 classes, else the best separated of random codes."""
    if classes <= 7:
        bits = np.arange(1, max(2, 1 << (classes - 1)))
        return np.array([[1 if k == 0 or not (b >> (k - 1)) & 1 else -1 for b in bits] for k in range(classes)], np.float64)
    rng = np.random.default_rng(seed)
    length = 15 * int(np.ceil(np.log2(classes)))
    found = (rng.choice([-1.0, 1.0], (classes, length)) for _ in range(50))
    return max(found, key=lambda c: -np.max(np.abs(c @ c.T) - length * np.eye(classes)))


def _vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    x = np.sqrt(gram_counts(folded(data), offsets, WIDTH, (1, 2, 3)))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _lettered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(_LETTER[data])])
    has = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~has):
        has[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return has


class Languages:
    """Codewords, weights of the binary classifiers and of their bits."""

    def __init__(self, docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = 4000, sure: float = 0.6):
        self.id_col, self.text_col, self.sure = id_col, text_col, sure
        rows = docs.filter(learn & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))

        def run(batches):
            for batch in batches:
                for first, n, data, offsets in slices(batch, "text", max_rows=500):
                    keep = _lettered(data, offsets)
                    x = _vectors(data, offsets)[keep].astype(np.float16)
                    lang = batch.column("lang").slice(first, n).filter(pa.array(keep))
                    yield pa.RecordBatch.from_arrays([lang, pa.array([v.tobytes() for v in x], pa.binary())], names=["lang", "x"])

        got = sampled(rows, "lang", most, F.col("id")).select("text", "lang").mapInArrow(tidy(run), "lang string, x binary").toArrow()
        label = np.array(got["lang"].to_pylist(), object)
        self.languages = sorted(set(label))
        if not self.languages:
            return
        x = np.stack([np.frombuffer(v.as_buffer(), np.float16) for v in got["x"]]).astype(np.float32)
        del got
        order = np.lexsort((x @ np.arange(1, WIDTH + 1, dtype=np.float32), label))  # not the order in which tasks end
        x, label = x[order], label[order]
        self.code = codewords(len(self.languages))
        index = np.searchsorted(np.array(self.languages, object), label)
        y = self.code[index]
        class_weight = (len(label) / (len(self.languages) * np.bincount(index)))[index][:, None].astype(np.float32)
        self.mean = x.mean(axis=0)
        x -= self.mean
        gram = (x.T @ (x * class_weight)).astype(np.float64)
        gram.flat[:: WIDTH + 1] += 0.02 * len(x) / WIDTH
        self.weights = np.linalg.solve(gram, (x.T @ (y * class_weight).astype(np.float32)).astype(np.float64)).astype(np.float32)
        x += self.mean
        self.bias = -(self.mean @ self.weights)
        right = ((x @ self.weights + self.bias) * y > 0).mean(axis=0)
        self.bit_weight = np.clip(2 * right - 1, 0.05, 1)
        del x, gram, order
        give_back()

    def _predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        rows = len(offsets) - 1
        known = _lettered(data, offsets)
        if not self.languages:
            return [UNKNOWN] * rows, np.zeros(rows)
        margin = (_vectors(data, offsets) @ self.weights + self.bias).astype(np.float64)
        loss = np.stack([(np.logaddexp(0, -4 * margin * c) * self.bit_weight).sum(axis=1) for c in self.code], axis=1)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        score = np.where(known, share[np.arange(rows), best], 0.0)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], score

    def predict(self, docs: DataFrame) -> DataFrame:
        """Per document: doc_id, lang_pred, score, ambiguous."""
        kind = docs.schema[self.id_col].dataType.simpleString()

        def run(batches):
            for batch in batches:
                lang, score = [], []
                for _, _, data, offsets in slices(batch, "text", max_rows=500):
                    a, b = self._predict(data, offsets)
                    lang += a
                    score.append(b)
                score = np.concatenate(score) if score else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(score < self.sure)], names=["doc_id", "lang_pred", "score", "ambiguous"])

        own = docs.select(F.col(self.id_col).alias("doc_id"), F.col(self.text_col).alias("text"))
        return own.mapInArrow(tidy(run), f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")

    def keep_known(self, docs: DataFrame) -> DataFrame:
        """The rows whose language is told without ambiguity, with all their columns; texts are not shuffled."""
        at = docs.columns.index(self.text_col)

        def run(batches):
            for batch in batches:
                text = pa.RecordBatch.from_arrays([batch.column(at)], names=["text"])
                score = [self._predict(data, offsets)[1] for _, _, data, offsets in slices(text, "text", max_rows=500)]
                yield batch.filter(pa.array(np.concatenate(score) >= self.sure)) if score else batch

        return docs.mapInArrow(tidy(run), docs.schema)
