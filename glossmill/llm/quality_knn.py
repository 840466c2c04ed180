"""Operator 1, quality classification by nearest-neighbour voting in a latent-semantic space.

A bounded sample of labelled rows (``most``) gives hashed byte n-gram and word repetition counts; weighted by inverse
document frequency they are factored by a truncated singular value decomposition. The labelled vectors, at most ``most``
times ``rank`` numbers, are broadcast; every document is projected, its cosines with all labelled vectors are computed
exactly, a block of documents at a time, and the labels of the ``near`` most similar vote, each with a weight that grows
with its similarity.

Defined results: null and empty texts are scored like any other, by the vote around the zero vector's repetition counts;
texts are read whole; labels other than 0 and 1 and null labels are not learned from; with nothing to learn from every
score is 0.5; documents that repeat are scored alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy
from .hashed import gram_counts, repeat_counts, sampled

WIDTH = 2048
EXTRA = 12


def _counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Damped counts: byte 2- and 3-grams, then indicators of length, of repeated words and of few distinct words."""
    grams = gram_counts(data, offsets, WIDTH, (2, 3))
    n, same, distinct = repeat_counts(data, offsets).T
    extra = np.zeros((len(n), EXTRA), np.float32)
    extra[:, 0] = n > 0
    extra[:, 1:5] = (same / np.maximum(n, 1))[:, None] > np.array([0.05, 0.15, 0.3, 0.6])
    extra[:, 5:9] = ((distinct / np.maximum(n, 1))[:, None] < np.array([0.15, 0.25, 0.35, 0.5])) & (n > 30)[:, None]
    extra[:, 9:12] = n[:, None] < np.array([5, 20, 40])
    return np.concatenate([np.log1p(grams), extra], axis=1)


class Voters:
    """The projection and the labelled vectors with their labels."""

    def __init__(self, docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = 6000, rank: int = 64, near: int = 25):
        self.id_col, self.text_col, self.near = id_col, text_col, near
        chosen = sampled(labels.filter(learn & F.col(label).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")), "label", most, F.col("id"))
        # At most about `most` rows by the sample's own fractions, whatever the number of labels: small enough for every task.
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("text", "label")

        def run(batches):
            for batch in batches:
                for first, n, data, offsets in slices(batch, "text", max_rows=500):
                    x = _counts(data, offsets).astype(np.float16)
                    yield pa.RecordBatch.from_arrays([batch.column("label").slice(first, n), pa.array([v.tobytes() for v in x], pa.binary())], names=["label", "x"])

        got = rows.mapInArrow(tidy(run), "label int, x binary").toArrow()
        y = got["label"].to_numpy().astype(np.float32)
        self.labels = y
        if not len(y):
            return
        x = np.stack([np.frombuffer(v, np.float16) for v in got["x"].to_pylist()]).astype(np.float32)
        order = np.lexsort((x @ np.arange(1, x.shape[1] + 1, dtype=np.float32), y))  # not the order in which tasks end
        x, self.labels = x[order], y[order]
        self.idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.3).astype(np.float32)
        self.idf[-EXTRA:] = 3.0
        x = self._unit(x * self.idf)
        rng = np.random.default_rng(11)
        q = rng.standard_normal((x.shape[1], min(rank + 16, len(x)))).astype(np.float32)
        for _ in range(4):
            q = np.linalg.qr(x.T @ (x @ q))[0]
        small, _, right = np.linalg.svd(x @ q, full_matrices=False)
        self.axes = np.ascontiguousarray((q @ right[:rank].T).astype(np.float32))
        self.vectors = np.ascontiguousarray(self._unit(x @ self.axes))

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def _score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        if not len(self.labels):
            return np.full(rows, 0.5)
        cosine = self._unit(self._unit(_counts(data, offsets) * self.idf) @ self.axes) @ self.vectors.T
        k = min(self.near, len(self.labels))
        best = np.argpartition(cosine, -k, axis=1)[:, -k:]
        weight = np.maximum(np.take_along_axis(cosine, best, axis=1), 1e-6).astype(np.float64) ** 8
        return np.clip((weight * self.labels[best]).sum(axis=1) / weight.sum(axis=1), 0, 1)

    def score(self, docs: DataFrame) -> DataFrame:
        """Per document: doc_id, score."""
        me = docs.sparkSession.sparkContext.broadcast(self)
        kind = docs.schema[self.id_col].dataType.simpleString()

        def run(batches):
            for batch in batches:
                parts = [me.value._score(data, offsets) for _, _, data, offsets in slices(batch, "text", max_rows=500)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["doc_id", "score"])

        return docs.select(F.col(self.id_col).alias("doc_id"), F.col(self.text_col).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, score double")
