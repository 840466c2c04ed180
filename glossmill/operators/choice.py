"""Choosing the most similar of several texts within a group, such as a gloss's sense among those of its lemma.

Two ways, for tables of any size and groups of any share of them:

* `by_tokens`, token F1 by an inverted index. Options are exploded into postings (group, token), and only pairs that share a
  token are ever formed, once for each distinct set of tokens that a group is asked for; Spark splits the join where one token
  of one group is frequent.
* `by_vectors`, the cosine of vectors by matrix products. A group's questions and options are cut into blocks; one task holds a
  block of options, and streams the questions of a block past it.

Both give the best option, the first in order on ties; nulls in the group's columns match nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, never_broadcast, small_or_shuffled, spread

#: Of a block, about.
OPTIONS, QUESTIONS = 512, 8192


def _filled(tokens: str) -> Column:
    """A set of tokens; the empty set holds one that is no token, so that two empty sets are equal."""
    return F.when(F.size(tokens) == 0, F.array(F.lit(""))).otherwise(F.col(tokens))


def by_tokens(asked: DataFrame, options: DataFrame, by: list[str], group: list[str], order: list[str], tokens: str = "_tokens") -> DataFrame:
    """asked(*by, *group, tokens), options(*group, *order, tokens) -> *by, score, *order, n_options.

    Tokens are arrays of distinct strings, the score is their token F1, `order` tells options of a group apart and ranks them.
    Questions without a token in common with any option get the first one, with score 0; those of an unknown group have no row.
    """
    place, key = F.struct(*order), [*group, "_set"]
    rows = asked.select(*by, *group, F.array_sort(tokens).alias("_set"))
    for c in group:
        rows = rows.filter(F.col(c).isNotNull())
    rows = spread(rows, *by)
    distinct = cut(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_k")).drop("_k").withColumn("_id", F.monotonically_increasing_id()))  # a set meets the options once
    first = small_or_shuffled(options.groupBy(*group).agg(F.min(place).alias("_o"), F.count(F.lit(1)).alias("_n")))
    nothing = distinct.select(*group, "_id").join(first, group).select("_id", F.lit(0.0).alias("_s"), "_o", "_n")
    have, want = _filled(tokens), _filled("_set")
    postings = options.select(*group, place.alias("_o"), F.size(have).alias("_b"), F.explode(have).alias("_t"))
    sought = distinct.select("_id", *group, F.size(want).alias("_a"), F.explode(want).alias("_t"))
    met = sought.join(never_broadcast(postings), [*group, "_t"]).groupBy("_id", "_o", "_a", "_b").agg(F.count(F.lit(1)).alias("_c"))
    scored = met.select("_id", (F.lit(2.0) * F.col("_c") / (F.col("_a") + F.col("_b"))).alias("_s"), "_o", F.lit(0).cast("bigint").alias("_n"))
    best = nothing.unionByName(scored).groupBy("_id").agg(F.min(F.struct((-F.col("_s")).alias("s"), F.col("_o").alias("o"))).alias("_x"), F.max("_n").alias("n_options"))
    held = small_or_shuffled(distinct.join(never_broadcast(best), "_id").select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(group)], F.col("_set").alias("_met_set"), "_x", "n_options"))
    same = F.col("_set").eqNullSafe(F.col("_met_set"))
    for k, c in enumerate(group):
        same = same & (F.col(c) == F.col(f"_g{k}"))
    return rows.join(held, same).select(*by, F.abs("_x.s").alias("score"), *[F.col(f"_x.o.{c}").alias(c) for c in order], "n_options")


def encode_distinct(df: DataFrame, texts: list[str], make_encoder: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 256) -> DataFrame:
    """vectors(text, embedding): every distinct text of some columns, null left out, encoded once.

    make_encoder is called once in each task; an encoder turns a list of texts into a matrix. Write the result to a table
    before it is used twice.
    """
    column = F.explode(F.array(*texts)) if len(texts) > 1 else F.col(texts[0])
    distinct = df.select(column.alias("text")).filter(F.col("text").isNotNull()).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                encoder = encoder or make_encoder()
                made = np.asarray(encoder(part.column(0).to_pylist()), np.float32)
                if made.ndim != 2 or len(made) != part.num_rows:
                    raise ValueError(f"the encoder gave {made.shape} for {part.num_rows} texts")
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, made.shape[1] or 1)[: len(made) + 1], pa.int32()), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), flat], names=["text", "embedding"])

    return distinct.mapInArrow(run, "text string, embedding array<float>")


def vector_of(df: DataFrame, text: str, vectors: DataFrame, into: str) -> DataFrame:
    """The vector of a text column; null for texts without one."""
    return df.join(vectors.select(F.col("text").alias(text), F.col("embedding").alias(into)), text, "left")


def by_vectors(asked: DataFrame, options: DataFrame, by: list[str], group: list[str], order: list[str], vector: str = "_vector", digits: int = 9) -> DataFrame:
    """asked(*by, *group, vector), options(*group, *order, vector) -> *by, score, *order: as `by_tokens`, by cosine.

    Cosines are rounded before they are compared, so that block sizes don't decide ties. A null or zero vector is at cosine 0 of
    all others, and so are vectors of another length.
    """
    counted = asked.groupBy(*group).agg(F.count(F.lit(1)).alias("_asked"))
    sized = options.groupBy(*group).agg(F.count(F.lit(1)).alias("_options")).join(counted, group)  # groups that have both
    sized = cut(sized.select(*group, F.ceil(F.col("_asked") / QUESTIONS).cast("int").alias("_salts"), F.ceil(F.col("_options") / OPTIONS).cast("int").alias("_blocks")))
    held = options.join(sized, group).withColumn("_block", F.pmod(F.xxhash64(*order), F.col("_blocks")).cast("int"))
    one = held.select(
        *group, "_block", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), F.lit(0).alias("_kind"), F.struct(*order).alias("_order"), F.col(vector).alias("_v"),
        F.lit(None).cast(asked.select(F.struct(*by)).schema[0].dataType).alias("_by"),
    )
    dealt = asked.join(sized, group).withColumn("_salt", F.pmod(F.xxhash64(*by), F.col("_salts")).cast("int"))
    two = dealt.select(
        *group, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), "_salt", F.lit(1).alias("_kind"), F.lit(None).cast(one.schema["_order"].dataType).alias("_order"),
        F.col(vector).alias("_v"), F.struct(*by).alias("_by"),
    )
    key = [*group, "_block", "_salt"]
    rows = one.unionByName(two)
    sorted_rows = rows.withColumn("_key", F.struct(*key)).repartition(*key).sortWithinPartitions("_key", "_kind", "_order").select("_key", "_kind", "_order", "_v", "_by")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, names = None, [], []
        matrix = None
        for batch in batches:
            keys, kinds = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            start = 0
            while start < batch.num_rows:
                stop = start + 1
                while stop < batch.num_rows and kinds[stop] == kinds[start] and keys[stop] == keys[start]:
                    stop += 1
                if keys[start] != current:
                    current, held, names, matrix = keys[start], [], [], None
                if kinds[start] == 0:
                    held += batch.column(3).slice(start, stop - start).to_pylist()
                    names.append(batch.column(2).slice(start, stop - start))
                    matrix = None
                else:
                    if matrix is None:
                        matrix = _unit(held)
                        places = pa.concat_arrays(names)
                    score, best = _best(_unit(batch.column(3).slice(start, stop - start).to_pylist()), matrix, digits)
                    yield pa.RecordBatch.from_arrays([batch.column(4).slice(start, stop - start), pa.array(score), pc.take(places, pa.array(best))], names=["_by", "_s", "_o"])
                start = stop

    schema = f"_by {rows.schema['_by'].dataType.simpleString()}, _s double, _o {rows.schema['_order'].dataType.simpleString()}"
    found = sorted_rows.mapInArrow(run, schema).select(*[F.col(f"_by.{c}").alias(c) for c in by], "_s", "_o")
    best = found.groupBy(*by).agg(F.min(F.struct((-F.col("_s")).alias("s"), F.col("_o").alias("o"))).alias("_x"))
    return best.select(*by, (-F.col("_x.s")).alias("score"), *[F.col(f"_x.o.{c}").alias(c) for c in order])


def _unit(vectors: list[list[float] | None]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors by their length: places and rows of length one; null and zero vectors are left out."""
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    sizes = np.array([0 if v is None else len(v) for v in vectors])
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        rows = np.array([vectors[i] for i in at], np.float64)
        norm = np.sqrt((rows * rows).sum(1))
        good = norm > 0
        found[size] = at[good], rows[good] / norm[good, None]
    found[0] = np.arange(len(vectors)), np.zeros((0, 0))
    return found


def _best(asked: dict, options: dict, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each question the best cosine, rounded, and the first option that has it. Options are in order."""
    n, k = len(asked[0][0]), len(options[0][0])
    score, best = np.zeros(n), np.zeros(n, np.int64)
    for size, (at, rows) in asked.items():
        if not size or size not in options:
            continue
        where, table = options[size]
        cosines = np.zeros((len(at), k))
        cosines[:, where] = np.round(rows @ table.T, digits) + 0.0  # no negative zeros
        best[at] = cosines.argmax(1)
        score[at] = cosines.max(1)
    return score, best
