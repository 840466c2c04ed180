"""Results that don't depend on partitions, and hashes that tell texts apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmill.llm.common import cut, span_hashes
from glossmill.llm.quality_rules import Rules, count_grams, features, log_tables, medians


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def flat(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    return data, np.cumsum([0, *[len(t.encode()) for t in texts]])


def test_thue_morse_lines_and_words_differ():
    for size in (512, 1024, 2048, 4096):
        one = thue_morse(size)
        two = one.translate(str.maketrans("ab", "ba"))
        data, offsets = flat([one, two, one])
        a, b, c = span_hashes(data, offsets[:-1], offsets[1:])
        assert a != b and a == c
        found = features(*flat([f"{one}\n{two}\n{two}"]))
        assert found["n_dup_lines"].tolist() == [1]
        eight = " ".join([one, two] * 4)
        assert features(*flat([f"{eight} x {eight.translate(str.maketrans('ab', 'ba'))}"]))["n_repeat_words"].tolist() == [0]


def test_medians_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(rng.choice(["en", "de", None]), float(x), float(y)) for x, y in zip(rng.normal(2, 1, 501), rng.integers(0, 3, 501), strict=True)]
    df = spark.createDataFrame(rows, "lang string, byte double, word double")
    got = {r["lang"]: (r["n"], r["byte"], r["word"]) for r in medians(df.repartition(5), columns=("byte", "word")).collect()}
    for lang in ("en", "de", None):
        own = [(x, y) for name, x, y in rows if name == lang]
        middle = lambda k: sorted(r[k] for r in own)[(len(own) - 1) // 2]  # noqa: B023, E731
        assert got[lang][0] == len(own) and got[lang][1] == pytest.approx(middle(0), abs=1e-4) and got[lang][2] == pytest.approx(middle(1))
    assert medians(df.limit(0), columns=("byte",)).count() == 0


def test_quality_verdicts_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    runs = []
    for n, parts in ((1, "3"), (7, "11"), (4, "5")):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(10_000 // n))
        runs.append(sorted((r["doc_id"], r["kept"], r["entropy"]) for r in Rules(docs.orderBy(F.rand(n)).repartition(n)).score().collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert runs[0] == runs[1] == runs[2]


def test_skewed_joins_are_split(spark, monkeypatch):
    """A hub's edges, and the documents of one fingerprint, are dealt to several tasks by Spark's skew join."""
    from pyspark.sql import DataFrame

    from glossmill.llm import components as C
    from glossmill.llm.common import cut
    from glossmill.llm.simhash_dedup import assign

    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k"}
    small |= {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    plans = []

    def watched(df: DataFrame) -> DataFrame:
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    try:
        star = spark.range(1, 30_001).select(F.col("id").alias("a"), F.lit(0).cast("bigint").alias("b")).unionByName(spark.range(100_000, 101_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))).repartition(12)
        with monkeypatch.context() as m:
            m.setattr(C, "cut", watched)
            roots = C.components(star)
        assert roots.groupBy("root").count().orderBy("root").collect()[0].asDict() == {"root": 0, "count": 30_001}
        assert any("skew=true" in p for p in plans)
        docs = spark.range(30_000).selectExpr("id AS doc_id", "CASE WHEN id % 10 < 9 THEN '' ELSE concat('some words of text number ', id, ' and ', id * 7) END AS text").repartition(12)
        made = assign(docs)
        assert {r["component_id"] for r in made.filter("fingerprint = '0000000000000000'").collect()} == {0}
        made.collect()
        assert "skew=true" in made._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "3")


def test_grams_outside_the_arrays_count_in_full(spark):
    """However few grams are broadcast, no score differs (a model without its rare grams had others)."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(None, None, None), (-1, "", "en"), (-2, "qzx vvk " * 40 + "é中", None), (-2, "qzx vvk " * 40 + "é中", None)], "doc_id bigint, text string, lang string")
    docs = docs.select("doc_id", "text", "lang").unionByName(odd)
    whole, few, fewer = (Rules(docs, most=n) for n in (1 << 20, 3000, 1))
    assert whole.tables is None and few.tables is not None and 0 < len(few.model.value["gram", 5][0]) <= 3000
    rows = [sorted(map(repr, r.score().collect())) for r in (whole, few, fewer)]
    assert rows[0] == rows[1] == rows[2]
    assert sorted(map(repr, few.keep_clean(docs).collect())) == sorted(map(repr, whole.keep_clean(docs).collect()))


def test_small_count_tables_dont_lie_in_hundreds_of_partitions(spark):
    """However many shuffle partitions a session has, the fit runs tasks by the rows of its tables: the driver records each."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    few = sorted(map(repr, Rules(docs).score().collect()))
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    context = spark.sparkContext
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        counted = cut(count_grams(docs, "text", "lang", lambda lang, data, offsets, code: np.ones(len(lang), bool)))
        context.setJobGroup("fit of many partitions", "fit")
        tables = log_tables(counted)
        assert {k: t.rdd.getNumPartitions() for k, t in tables.items() if k[1] < 3} == {(kind, m): 1 for kind in ("gram", "context") for m in (1, 2)}
        assert all(tables["gram", m].rdd.getNumPartitions() <= 1 + tables["gram", m].count() // 100_000 for m in range(1, 6))
        tracker = context.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("fit of many partitions") for s in tracker.getJobInfo(j).stageIds]
        assert (n := sum(s.numCompletedTasks for s in stages if s is not None)) < 500, n
        assert sorted(map(repr, Rules(docs).score().collect())) == few
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
