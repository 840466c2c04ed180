"""Operator 10, exact deduplication by a heavy-hitter split (DataFrame functions only).

A Misra-Gries family sketch (``approx_top_k``) names digests that may be frequent. Their exact counts are taken and the
verified winners, at most ``top`` rows of constant size, are broadcast: rows of those groups are settled on the map side
and never shuffled. All other digests go through an ordinary shuffle of 32-byte digests; texts are never shuffled.

Defined results: null text counts as the empty text; equal texts that differ only in A-Z case form one group; of a group
the largest doc_id stays (null ids are smaller than any other); rows that repeat the doc_id which stays are the same
document and are all marked kept, `deduplicate` leaves one of them; an empty table gives an empty result; further columns
of the input are ignored by `assign`, and kept by `deduplicate` whatever their names (but no two alike). `deduplicate` leaves
texts where they are as long as few rows go (see `common.settle`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lower_az, settle


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text with A-Z lowered, null as empty."""
    return F.sha2(lower_az(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = 1000, tracked: int = 20_000, least: int = 48) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    tracked: counters of the sketch; every digest with more than about rows / tracked copies is found.
    least: verified copies from which a digest is settled on the map side.
    """
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.unhex(digest(F.col(text_col))).alias("digest")))
    sketch = rows.agg(F.expr(f"approx_top_k(hex(digest), {int(top)}, {int(tracked)})").alias("found"))
    maybe = sketch.select(F.explode("found").alias("f")).select(F.unhex("f.item").alias("digest"), F.col("f.count").alias("n")).filter(F.col("n") >= least).select("digest")
    winners = (
        rows.join(F.broadcast(maybe), "digest", "left_semi").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter(F.col("group_size") >= least)
    )
    winners = cut(winners)
    heavy = rows.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    light = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").withColumns({"keep_id": F.max("doc_id").over(group), "group_size": F.count(F.lit(1)).over(group)})
    both = heavy.unionByName(light)
    return both.select(
        F.col("doc_id").alias(id_col), "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their own columns; a repeated row stays once."""
    found = assign(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), F.unhex("text_sha256").alias("digest"), F.col("kept").alias("stays"))
    return settle(docs, found, id_col, F.unhex(digest(docs[f"`{text_col}`"])))
