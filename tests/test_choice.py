"""Sense choice by tokens and by vectors, and the genus of a pair, against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmill.functions import text as T
from glossmill.operators import choice, evaluate, lexicon

WORDS = "bank money river slope land water the of institution a".split()


def toy(n, seed=1):
    """Glosses of a hot lemma and of small ones; some have no word in common with any definition, some no content word."""
    rng = random.Random(seed)
    text = lambda: " ".join(rng.choices(WORDS, k=rng.randint(1, 4)))
    rows = []
    for k in range(n):
        lemma = "hot" if k % 3 else f"l{k % 11}"
        gloss = rng.choice([text(), text(), text(), "unheard of words", "the of a", ""])
        rows.append((k, lemma, "noun" if k % 7 else None, gloss, text() + f" d{rng.randint(0, 40)}" if lemma == "hot" else text()))
    return rows


SCHEMA = "k int, lemma string, pos string, gloss string, definition string"


def content(text):
    return {w for w in re.findall(r"\w+", text.lower()) if w not in T.SHORT_STOPLIST}


def f1(a, b):
    a, b = content(a), content(b)
    return 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))


def brute_choice(rows, like):
    """k -> whether the first most similar definition of the lemma is the row's own."""
    senses = {}
    for k, lemma, pos, _, definition in rows:
        if pos is not None:
            senses.setdefault((lemma, pos), {}).setdefault(definition, k)
    found = {}
    for k, lemma, pos, gloss, definition in rows:
        options = senses.get((lemma, pos), {})
        if gloss and len(options) >= 2:
            found[k] = max(options, key=lambda d: (like(gloss, d), -options[d])) == definition
    return found


def test_sense_choice_by_tokens(spark):
    rows = toy(400)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["k"]: r["sense_correct"] for r in evaluate.sense_choice(df, ["k"], "k").collect()}
    assert got == brute_choice(rows, f1)
    assert evaluate.sense_choice(df.limit(0), ["k"], "k").count() == 0


def test_no_pairs_without_a_shared_token(spark):
    """Rows of the join follow shared tokens, not glosses times senses; no expression compares two sets."""
    df = spark.createDataFrame(toy(50), SCHEMA)
    plan = evaluate.sense_choice(df, ["k"], "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan


@pytest.mark.parametrize("sizes", [(512, 8192), (7, 10)])
def test_sense_choice_by_vectors(spark, monkeypatch, sizes):
    """The second pair of sizes cuts the hot lemma into many blocks."""
    monkeypatch.setattr(choice, "OPTIONS", sizes[0])
    monkeypatch.setattr(choice, "QUESTIONS", sizes[1])
    rows = toy(400, seed=5)
    rng = np.random.default_rng(2)
    vectors = {t: rng.integers(-2, 3, 3).astype(float) for r in rows for t in r[3:] if t}  # small numbers: many ties, some zero vectors
    for t in list(vectors)[::17]:
        vectors[t] = np.ones(5)  # another length
    missing = list(vectors)[::29]
    table = spark.createDataFrame([(t, v.tolist()) for t, v in vectors.items() if t not in missing], "text string, embedding array<float>")

    def like(a, b):
        x, y = (np.zeros(3) if t in missing else vectors[t] for t in (a, b))
        n = np.linalg.norm(x) * np.linalg.norm(y)
        return round(float(x @ y / n), 9) + 0.0 if n and len(x) == len(y) else 0.0

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["k"]: r["sense_correct"] for r in evaluate.sense_choice(df, ["k"], "k", table).collect()}
    assert got == brute_choice(rows, like)
    assert evaluate.sense_choice(df.limit(0), ["k"], "k", table).count() == 0


def test_blocks_of_a_hot_lemma_spread(spark, monkeypatch):
    monkeypatch.setattr(choice, "QUESTIONS", 50)
    asked = spark.range(1000).select(F.col("id").alias("k"), F.lit("hot").alias("lemma"), F.array(F.lit(1.0), F.lit(0.0)).alias("_vector"))
    options = spark.range(5).select(F.lit("hot").alias("lemma"), F.col("id").alias("o"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("_vector"))
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = choice.by_vectors(asked, options, ["k"], ["lemma"], ["o"])
        assert got.filter("o = 0 AND score = 1").count() == 1000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_texts_are_encoded_once(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        import os
        import uuid

        def encode(texts):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write("\n".join(texts))
            return np.array([[len(t), t.count("e"), 1] for t in texts])

        return encode

    rows = [(k, "l", "noun", f"gloss {k % 3}", f"definition {k % 2}") for k in range(60)] + [(99, "l", "noun", None, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    vectors = choice.encode_distinct(df, ["gloss", "definition"], make, batch=2)
    vectors.write.parquet(str(tmp_path / "vectors.parquet"))
    seen = sorted(t for p in tmp_path.iterdir() if p.is_file() for t in p.read_text().split("\n"))
    assert seen == ["", "definition 0", "definition 1", "gloss 0", "gloss 1", "gloss 2"]
    held = spark.read.parquet(str(tmp_path / "vectors.parquet"))
    summary = evaluate.full_summary(df.withColumn("filler_gloss", F.lit("")), ["k"], "k", vectors=held).first()
    assert summary["n"] == 61 and summary["n_scored"] == 60 and 0.9 < summary["cos"] <= 1
    with pytest.raises(Exception, match="the encoder gave"):
        choice.encode_distinct(df, ["gloss"], lambda: lambda texts: np.zeros(3)).collect()


def test_snap_edges(spark):
    lex = [("bank", "noun", 1, "b.1", "money institution"), ("bank", "noun", 2, "b.2", "sloping land"), ("bank", "noun", 3, "b.3", "the of"), ("lone", "noun", 1, "l.1", "a thing")]
    table = spark.createDataFrame(lex, "lemma string, pos string, rank int, synset_id string, definition string")
    asked = [(1, "bank", "noun", "land beside water"), (2, "bank", "noun", "unheard"), (3, "bank", "noun", "of the"), (4, "lone", "noun", ""), (5, "none", "noun", "money"), (6, "bank", "verb", "money"), (None, "bank", "noun", "institution")]
    df = spark.createDataFrame(asked, "k int, lemma string, pos string, gloss string")
    got = {r["k"]: (r["synset_id"], round(r["score"], 4), r["n_synsets"]) for r in lexicon.snap(df, table, ["k"]).collect()}
    assert got == {1: ("b.2", 0.4, 3), 2: ("b.1", 0.0, 3), 3: ("b.3", 1.0, 3), 4: ("l.1", 0.0, 1), None: ("b.1", 0.6667, 3)}


def test_genus(spark):
    edges = spark.createDataFrame([("dog", "canine"), ("wolf", "canine"), ("canine", "carnivore"), ("cat", "feline"), ("feline", "carnivore"), ("carnivore", "animal"), ("dog", "pet"), ("cat", "pet"), ("pet", "animal"), ("run", "move")], "synset_id string, hypernym_id string")
    names = spark.createDataFrame([(s, f"{s}_name") for s in "dog wolf canine carnivore animal pet".split()], "synset_id string, name string")
    kinds = spark.createDataFrame([(s, "verb" if s in ("run", "move") else "noun") for s in "dog wolf cat canine run move".split()], "synset_id string, pos string")
    asked = spark.createDataFrame([("dog", "wolf"), ("dog", "cat"), ("wolf", "cat"), ("dog", "canine"), ("dog", "run"), ("dog", "nowhere"), ("dog", "wolf")], "s1 string, s2 string")
    got = {(r["s1"], r["s2"]): r["genus"] for r in lexicon.genus(asked, lexicon.ancestors(edges), lexicon.depths(edges), kinds, names).collect()}
    # pet and carnivore are equally deep: the smaller id
    assert got == {("dog", "wolf"): "canine name", ("dog", "cat"): "carnivore name", ("wolf", "cat"): "carnivore name", ("dog", "canine"): "canine name", ("dog", "run"): None, ("dog", "nowhere"): None}


def test_a_frequent_lemma_is_split(spark):
    """Spark deals a lemma that holds nearly all glosses to several tasks, and each of its words' postings too."""
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        asked = spark.range(20_000).select(F.col("id").alias("k"), F.when(F.col("id") % 20 > 0, "hot").otherwise(F.concat(F.lit("l"), F.col("id").cast("string"))).alias("lemma"), F.array(F.lit("money"), F.col("id").cast("string")).alias("_tokens")).repartition(12)
        options = asked.select("lemma").distinct().select("lemma", F.explode(F.array(F.lit(0), F.lit(1))).alias("o"), F.array(F.lit("money"), F.lit("bank")).alias("_tokens"))
        got = choice.by_tokens(asked, options, ["k"], ["lemma"], ["o"])
        assert {(r["score"], r["o"]) for r in got.collect()} == {(0.5, 0)}
        assert got._jdf.queryExecution().executedPlan().toString().count("skew=true") >= 2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "3")


def test_a_set_of_tokens_meets_the_options_once(spark, tmp_path):
    """Work and broadcasts don't grow with questions that repeat; nulls, empty sets and repeated ids stay as they were."""
    from glossmill.session import cut

    options = spark.createDataFrame([("a", 1, ["x", "y"]), ("a", 2, ["x"]), ("a", 3, []), ("b", 1, ["z"]), (None, 1, ["x"])], "g string, o int, _tokens array<string>")
    sets = [["x"], ["y", "x"], ["x", "y"], [], None, ["q"]]
    asked = cut(spark.range(6000).selectExpr("id", "CASE id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS g", "CAST(id % 18 / 3 AS INT) AS k"))
    asked = asked.withColumn("_tokens", F.array(*[F.lit(x) if x is None else F.array(*[F.lit(t) for t in x]).cast("array<string>") for x in sets])[F.col("k")])
    found = choice.by_tokens(asked, options, ["id"], ["g"], ["o"])
    got = {(r["id"] % 18): (r["score"], r["o"], r["n_options"]) for r in found.collect()}
    assert found.count() == 4000 and found.select("id").distinct().count() == 4000
    assert [got[k] for k in (0, 3, 6, 9, 12, 15)] == [(1.0, 2, 3), (1.0, 1, 3), (1.0, 1, 3), (1.0, 3, 3), (0.0, 1, 3), (0.0, 1, 3)]
    assert [got[k] for k in (1, 4, 7, 10, 13, 16)] == [(0.0, 1, 1)] * 6
    merged = spark.createDataFrame([(i, "a", ["x"]) for i in range(50)], "id int, g string, _tokens array<string>")
    plan = choice.by_tokens(merged, options, ["id"], ["g"], ["o"])._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "RepartitionByExpression" in plan  # sets, which are counted, are broadcast; rows are dealt out


def test_a_gloss_that_many_rows_have_is_snapped_once(spark, monkeypatch):
    """What meets the senses are a lemma's different sets of tokens, not its rows; every row gets its sense."""
    held, real = [], choice.cut
    monkeypatch.setattr(choice, "cut", lambda df: (held.append(real(df)), held[-1])[1])
    table = spark.createDataFrame([("bank", "noun", 1, "b.1", "money institution"), ("bank", "noun", 2, "b.2", "river slope"), ("bank", "noun", 3, "b.3", "row of seats")], "lemma string, pos string, rank int, synset_id string, definition string")
    asked = spark.range(3000).selectExpr("id AS k", "'bank' AS lemma", "'noun' AS pos", "CASE id % 3 WHEN 0 THEN 'a slope' WHEN 1 THEN 'slope, a river' ELSE '' END AS gloss")
    found = lexicon.snap(asked, table, ["k"])
    assert [df.count() for df in held] == [3]
    want = {0: ("b.2", round(2 / 3, 9)), 1: ("b.2", 1.0), 2: ("b.1", 0.0)}
    got = found.groupBy((F.col("k") % 3).alias("kind"), "synset_id", F.round("score", 9).alias("score"), "n_synsets").count().collect()
    assert {(r["kind"], (r["synset_id"], r["score"]), r["n_synsets"], r["count"]) for r in got} == {(kind, x, 3, 1000) for kind, x in want.items()}
