"""Running metrics, caps of any size, scaling of advantages, the coverage report's edges."""

import json
import math

import pytest
from pyspark.sql import functions as F

from glossmill.operators import corpus, pairs, rewards, votes
from glossmill.streaming.progress import final_metrics, running_metrics


def test_metrics_as_results_come_in(spark, tmp_path):
    rows = [{"k": k, "prediction": None if k % 9 == 0 else k % 2 == 0, "label": k % 3 == 0} for k in range(70)]
    schema, place = "k int, prediction boolean, label boolean", {n: str(tmp_path / n) for n in ("in", "state", "metrics", "check")}
    (tmp_path / "in").mkdir()
    seen = []
    for n, (a, b) in enumerate(((0, 20), (20, 30), (30, 70))):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(map(json.dumps, rows[a:b])))
        running_metrics(spark, place["in"], schema, place["state"], place["metrics"], place["check"], every=25).awaitTermination()
        seen.append(spark.read.json(place["metrics"]).first()["n_items"] if (tmp_path / "metrics").exists() else None)
    assert seen == [None, 30, 70]
    whole = votes.metrics(spark.createDataFrame([tuple(r.values()) for r in rows], schema)).first().asDict()
    assert {k: v for k, v in spark.read.json(place["metrics"]).first().asDict().items() if k != "n_items"} == pytest.approx(whole)
    again = votes.counted(spark.createDataFrame([tuple(r.values()) for r in rows[30:]], schema)).withColumn("n_items", F.lit(40).cast("bigint"))
    again.write.mode("overwrite").parquet(f"{place['state']}/batch=2")  # a batch that runs again
    assert final_metrics(spark, place["state"], place["metrics"]).first()["n_items"] == 70


@pytest.mark.parametrize("cap", [0, 1, 99, 100, 101, 250, 4999, 5000, 9000])
def test_caps(spark, cap):
    df = spark.range(5000).select((F.col("id") % 4900).alias("k")).repartition(3)  # some keys twice
    want = [r["k"] for r in corpus.capped(df, cap, ["k"], few=10**9).collect()]
    got = [r["k"] for r in corpus.capped(df, cap, ["k"], few=0).collect()]
    assert got == want and len(got) == min(cap, 5000)


def test_no_task_holds_a_large_cap(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    assert "TakeOrdered" not in corpus.capped(df, 15_000, ["k"])._jdf.queryExecution().executedPlan().toString()


def test_advantage_scales(spark):
    rows = [("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 2.0), ("c", 7.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, reward double")
    got = {s: sorted((r["g"], r["advantage"]) for r in rewards.advantage(df.filter("g <> 'd'"), ["g"], scale=s).collect()) for s in ("none", "group", "batch", True, False)}
    std = math.sqrt(sum((x - 3) ** 2 for x in (1, 3, 2, 2, 7)) / 4)
    assert got["none"] == got[False] == [("a", -1.0), ("a", 1.0), ("b", 0.0), ("b", 0.0), ("c", 0.0)]
    assert [v for _, v in got["group"]] == pytest.approx([-1 / math.sqrt(2), 1 / math.sqrt(2), 0, 0, 0]) and got["group"] == got[True]
    assert [v for _, v in got["batch"]] == pytest.approx([-1 / std, 1 / std, 0, 0, 0])
    assert rewards.advantage(df.filter("g = 'c'"), ["g"], scale="batch").first()["advantage"] == 0.0
    with pytest.raises(ValueError):
        rewards.advantage(df, ["g"], scale="other")


def test_coverage_report(spark):
    rows = [("noun", True, "a", "a", "g", "g", ["g", "h"]), ("noun", False, "a", "b", "g", "h", ["g", "h"]), ("verb", False, "a", "c", "", "h", ["h"]), (None, False, "x", "y", "g", "h", ["g", "h", "i"])]
    df = spark.createDataFrame(rows, "pos string, label boolean, synset1 string, synset2 string, gloss1 string, gloss2 string, senses array<string>")
    levels = spark.createDataFrame([("a", "b", "near"), ("a", "b", "near"), ("x", "y", None)], "s1 string, s2 string, level string")
    got = {(r["part"], r["value"]): (r["n"], r["same_share"], r["scoreable_share"], r["mean_senses"], r["most_senses"]) for r in pairs.coverage_report(df, levels).collect()}
    assert got == {
        ("all", ""): (4, 0.25, 0.75, 2.0, 3), ("pos", "noun"): (2, 0.5, 1.0, 2.0, 2), ("pos", "verb"): (1, 0.0, 0.0, 1.0, 1), ("pos", "?"): (1, 0.0, 1.0, 3.0, 3), ("label", "true"): (1, 1.0, 1.0, 2.0, 2),
        ("label", "false"): (3, 0.0, 2 / 3, 2.0, 3), ("level", "near"): (1, 0.0, 1.0, 2.0, 2), ("level", "unresolved"): (2, 0.0, 0.5, 2.0, 3),
    }
    assert pairs.coverage_report(df.limit(0)).count() == 0
