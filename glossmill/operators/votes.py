"""Self-consistency votes and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vote(votes: Column) -> Column:
    """struct(prediction, confidence) of an array of boolean votes; nulls don't count, a tie has no prediction and 0.5."""
    yes = F.size(F.filter(votes, lambda v: v)).cast("double")
    no = F.size(F.filter(votes, lambda v: ~v)).cast("double")
    return _decided(yes, no)


def _decided(yes: Column, no: Column) -> Column:
    share = F.coalesce(F.try_divide(F.greatest(yes, no), yes + no), F.lit(0.0))
    return F.struct(F.when(yes != no, yes > no).alias("prediction"), share.alias("confidence"))


def vote_rows(rows: DataFrame, by: list[str], ballot: Column) -> DataFrame:
    """The same over one row per vote, with partial aggregation."""
    yes, no = F.count_if(ballot).cast("double"), F.count_if(~ballot).cast("double")
    return rows.groupBy(*by).agg(_decided(yes, no).alias("v"), F.count(F.lit(1)).alias("n_votes")).select(*by, "v.prediction", "v.confidence", "n_votes")


COUNTS = ("n_scored", "n_skipped", "tp", "fp", "fn", "tn")


def counted(rows: DataFrame, by: list[str] | None = None, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """The counts that metrics are made of; rows without prediction or label are skipped. Counts of parts of a table add up."""
    p, y = F.col(prediction), F.col(label)
    both = p.isNotNull() & y.isNotNull()
    counts = [F.count_if(x).alias(c) for c, x in zip(COUNTS, (both, ~both, p & y, p & ~y, ~p & y, ~p & ~y), strict=True)]
    return rows.groupBy(*by).agg(*counts) if by else rows.agg(*counts)


def rated(counts: DataFrame) -> DataFrame:
    """Accuracy, and precision, recall and F1 of the positive class, beside the counts."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"accuracy": ratio(tp + tn, F.col("n_scored")), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def metrics(rows: DataFrame, by: list[str] | None = None, prediction: str = "prediction", label: str = "label") -> DataFrame:
    return rated(counted(rows, by, prediction, label))


def metrics_by_pos(rows: DataFrame, pos: str = "pos") -> DataFrame:
    return metrics(rows.withColumn(pos, F.coalesce(pos, F.lit("?"))), [pos])


def verdict_metrics(rows: DataFrame) -> DataFrame:
    """Metrics of parsed verdicts; `empty` counts rows without one."""
    return metrics(rows).withColumnRenamed("n_skipped", "empty")
