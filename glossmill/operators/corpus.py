"""Corpora: merging, exclusion, resuming, balancing, splitting, shuffling by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.schemas import PAIR_KEY


def hash_order(*key: Column | str, seed: int = 42, salt: str = "") -> Column:
    """A reproducible random order: md5 of seed, salt and key. The same in any engine and under any partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *[F.coalesce(F.col(k).cast("string") if isinstance(k, str) else k.cast("string"), F.lit("")) for k in key]))


def ranked(df: DataFrame, order: Column, ties: list[str], by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Rank rows by a hash order, from 1, over all rows or within groups, without bringing a group into one task.

    Rows are ranked within buckets of the order's first three hex digits, and buckets are offset by their counts.
    """
    by = by or []
    hashed = df.withColumns({"_h": order, "_b": F.substring(order, 1, 3)})
    counts = hashed.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))  # at most 4,096 rows for each group
    before = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    offset = F.coalesce(F.sum("_n").over(before.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", *ties))
    return hashed.withColumn("_r", own).join(counts.select(*by, "_b", offset.alias("_o")), [*by, "_b"]).withColumn(name, F.col("_o") + F.col("_r")).drop("_h", "_b", "_r", "_o")


def dedupe_last(df: DataFrame, ordinal: str, key: tuple[str, ...] = PAIR_KEY) -> DataFrame:
    """One record for each key: the last record, at the first one's position."""
    w = Window.partitionBy(*key)
    return df.withColumns({"_n": F.row_number().over(w.orderBy(F.desc(ordinal))), "_first": F.min(ordinal).over(w)}).filter("_n = 1").withColumn(ordinal, F.col("_first")).drop("_n", "_first")


def _met(one: DataFrame, other: DataFrame, key: tuple[str, ...], how: str) -> DataFrame:
    """A join on equal keys where null equals null; the key's columns of `other` are named _key_."""
    named = other.select(*[F.col(k).alias(f"_key_{k}") for k in key], *[c for c in other.columns if c not in key])
    condition = F.lit(True)
    for k in key:
        condition = condition & one[k].eqNullSafe(named[f"_key_{k}"])
    return one.join(named, condition, how)


def merge(base: DataFrame, add: DataFrame, prefer: str = "base", key: tuple[str, ...] = PAIR_KEY, slots: str = "slots") -> DataFrame:
    """Keyed union of two corpora with unique keys, and a status: new, kept_base or merged.

    prefer: ``base`` keeps the base record, ``both`` appends the added record's slots to it (whole slots, so that answers and
    traces stay aligned). Both sides need a usable trace: records without slots are left out.
    """
    if prefer not in ("base", "both"):
        raise ValueError(f"unknown preference: {prefer}")
    base, add = (x.filter(F.coalesce(F.size(slots), F.lit(0)) > 0) for x in (base, add))
    rest = [c for c in base.columns if c not in key]
    b, a = base.select(*key, F.struct(*rest).alias("_b")), add.select(*key, F.struct(*rest).alias("_a"))
    both = _met(b, a, key, "full")
    known, other = F.col("_b").isNotNull(), F.col("_a").isNotNull()
    out = {c: F.when(known, F.col(f"_b.{c}")).otherwise(F.col(f"_a.{c}")) for c in rest}
    if prefer == "both":
        out[slots] = F.when(known & other, F.concat(F.col(f"_b.{slots}"), F.col(f"_a.{slots}"))).otherwise(out[slots])
    status = F.when(~known, "new").when(other, "merged" if prefer == "both" else "kept_base").otherwise("base_only")
    keys = [F.coalesce(k, f"_key_{k}").alias(k) for k in key]
    return both.select(*keys, *[v.alias(c) for c, v in out.items()], status.alias("status"))


def merge_stats(merged: DataFrame) -> DataFrame:
    return merged.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.count_if("label").cast("double"), F.count("label").cast("double")).alias("label_share"))


def exclude(df: DataFrame, manifest: DataFrame, key: tuple[str, ...] = PAIR_KEY) -> DataFrame:
    """Records whose key is not in a manifest. Whether the manifest is broadcast is left to its measured size."""
    return _met(df, manifest.select(*key).distinct(), key, "left_anti")


def resume(todo: DataFrame, finished: DataFrame, ordinal: str, key: tuple[str, ...] = PAIR_KEY) -> tuple[DataFrame, DataFrame]:
    """(finished rows to reuse, rows still to do): rows with an error don't count, the last duplicate wins."""
    good = dedupe_last(finished.filter(F.col("error").isNull()), ordinal, key)
    return _met(good, todo.select(*key).distinct(), key, "left_semi"), _met(todo, good.select(*key), key, "left_anti")


def balance(df: DataFrame, label: str, ties: list[str], seed: int = 42) -> DataFrame:
    """As many rows of either label, chosen by hash order."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    least = counts.agg(F.min("_n").alias("_min"), F.count(F.lit(1)).alias("_k"))  # one row
    chosen = ranked(df.filter(F.col(label).isNotNull()), hash_order(*ties, seed=seed), ties, [label], "_rank")
    return chosen.join(F.broadcast(least), (F.col("_rank") <= F.col("_min")) & (F.col("_k") == 2)).drop("_rank", "_min", "_k")


def split(df: DataFrame, ties: list[str], share: float = 0.05, seed: int = 42) -> DataFrame:
    """Train and dev by hash order: at least one row of dev, at most floor(n * share)."""
    total = df.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(float(share)))).alias("_dev"))  # one row
    every = ranked(df, hash_order(*ties, seed=seed, salt="split"), ties, name="_rank")
    return every.join(F.broadcast(total)).withColumn("split", F.when(F.col("_rank") <= F.col("_dev"), "dev").otherwise("train")).drop("_rank", "_dev")


def capped(df: DataFrame, cap: int, ties: list[str], seed: int = 42, few: int = 10_000) -> DataFrame:
    """At most `cap` rows in hash order (the sampling operator).

    Up to `few` rows are a top-k. Beyond that no task holds them: rows are counted by the first digits of their hash, all of
    the prefixes below the one that the cap falls into are kept, and only that one's rows are ranked.
    """
    hashed = df.withColumn("_h", hash_order(*ties, seed=seed))
    if cap <= few:
        return hashed.orderBy("_h", *ties).limit(cap).drop("_h")
    prefix, left = "", cap
    for digits in (3, 6):  # at most 4,096 counts each time
        place = F.substring("_h", 1, digits)
        counts = hashed.filter(F.startswith("_h", F.lit(prefix))).groupBy(place.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        for r in sorted(counts):
            if r["n"] > left:
                prefix = r["p"]
                break
            left -= r["n"]
        else:  # there are no more rows than the cap
            return hashed.orderBy("_h", *ties).drop("_h")
    own = F.substring("_h", 1, len(prefix))
    first = Window.partitionBy(own).orderBy("_h", *ties)
    edge = hashed.filter(own == prefix).withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= left).drop("_n")
    return hashed.filter(own < prefix).unionByName(edge).orderBy("_h", *ties).drop("_h")


def preview(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def task_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
