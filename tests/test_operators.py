"""Contracts of the operators on small literals."""

import json
import math

import pytest
from pyspark.sql import functions as F

from glossmill.functions import answers as A
from glossmill.functions import text as T
from glossmill.operators import backends, corpus, evaluate, lexicon, pairs, quality, rewards, rollouts, traces, votes
from glossmill.sources import readers, writers


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {kind}" for k, (kind, _) in values.items())
    df = spark.createDataFrame([tuple(v for _, v in values.values())], schema) if values else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def said(think, answer):
    return f"<think>\n{think}\n</think>\n{answer}"


def obj(one="a financial institution", two="the side of a river", same=False, **more):
    return json.dumps({"sense1": one, "sense2": two, "same_sense": same} | more)


THINK = "In sentence one bank means money house while sentence two describes river side land"
BANK = ["a financial institution that accepts deposits", "sloping land beside a body of water", "a long ridge or pile"]


def reward(spark, name, completion, label=False, gloss1="", gloss2="", senses=None):
    schema = "completion string, label boolean, gloss1 string, gloss2 string, senses array<string>"
    df = spark.createDataFrame([(completion, label, gloss1, gloss2, senses if senses is not None else BANK)], schema)
    return rewards.score(df).first()[f"reward_{name}"]


@pytest.mark.parametrize(
    ("completion", "want"),
    [
        (said(THINK, obj()), 0.3), (said(THINK, obj(same="true")), 0.2), (said(THINK, obj(same=1)), 0.2), (said(THINK, '{"same_sense": true}'), 0.2), (said(THINK, obj(extra=1)), 0.2),
        (said(THINK, "they differ"), -0.2), (said(THINK, '{"sense1": "a'), -0.2), (said(THINK, "true"), -0.2), ("<think>\nstill going " + obj(), 0.0), (said(THINK, ""), 0.0),
        (said(THINK, "[1, 2]"), -0.2),
    ],
)
def test_json_reward(spark, completion, want):
    assert reward(spark, "json", completion) == pytest.approx(want)


@pytest.mark.parametrize(
    ("completion", "low", "high"),
    [
        (said(THINK, obj("money house", "river side", True)), -0.3, -0.3), (said(THINK, obj("river side", "River side.", False)), -0.3, -0.3),
        (said(THINK, obj("the land beside a river", "the land along a river", True)), -0.15, -1e-9), (said(THINK, obj("x y", "x y", True)), 0, 0), (said(THINK, obj()), 0, 0),
        (said(THINK, obj("A bank!", "a bank", True)), 0, 0), (said(THINK, "none"), 0, 0), (said(THINK, obj(same="true")), 0, 0), (said(THINK, obj("", "x", True)), 0, 0),
        (said(THINK, '{"same_sense": true}'), 0, 0),
    ],
)
def test_consistency_reward(spark, completion, low, high):
    assert low - 1e-9 <= reward(spark, "consistency", completion) <= high + 1e-9


@pytest.mark.parametrize(("completion", "label", "want"), [(said(THINK, obj()), False, 1.0), (said(THINK, obj()), True, -0.5), (said(THINK, "nothing"), True, -1.0), (said(THINK, "two different senses"), False, 1.0)])
def test_accuracy_reward(spark, completion, label, want):
    assert reward(spark, "accuracy", completion, label) == want


@pytest.mark.parametrize(("completion", "want"), [(said(THINK, obj()), 0.2), (obj(), 0.1), (said(THINK, ""), 0.1), ("<think></think>", 0.0)])
def test_format_reward(spark, completion, want):
    assert reward(spark, "format", completion) == pytest.approx(want)


@pytest.mark.parametrize(("completion", "want"), [(said("ok", obj()), -0.3), (obj(), -0.3), ("<think>" + THINK, -0.3), (said(THINK, obj()), 0.0)])
def test_think_reward(spark, completion, want):
    assert reward(spark, "think_length", completion) == want


def test_gloss_reward(spark):
    score = lambda a, b, g1=BANK[0], g2=BANK[1], senses=BANK: reward(spark, "gloss", said(THINK, obj(a, b)), False, g1, g2, senses)
    assert score(BANK[0], BANK[1]) == pytest.approx(0.15)
    assert score(BANK[1], BANK[0]) == pytest.approx(-0.15)
    assert -0.15 < score(BANK[0], BANK[0]) < 0.15
    assert score("institution that takes deposits", "land sloping to water") > 0
    assert score("zebra", "quagga") == 0
    assert score(BANK[0], BANK[1], "", "") == 0
    assert score(BANK[0], BANK[1], senses=[BANK[0]]) == 0
    assert reward(spark, "gloss", said(THINK, "no"), False, BANK[0], BANK[1]) == 0


def test_reward_invariants():
    ceiling = 0.2 + 0.3 + rewards.GLOSS_MAX
    assert ceiling < rewards.CORRECT
    assert 2 * rewards.GLOSS_MAX - rewards.INCONSISTENT - rewards.THINK_PENALTY + 0.5 <= rewards.CORRECT - rewards.WRONG
    assert rewards.ABSENT <= (rewards.CORRECT + rewards.WRONG) / 2
    assert set(rewards.REWARDS) == {"accuracy", "format", "json", "consistency", "think_length", "gloss"}
    assert rewards.KEEP_COLS[:3] == ("lemma", "pos", "label")


@pytest.mark.parametrize(
    ("text", "ok", "kind", "truthy"),
    [
        ('x {"same_sense": false}', True, "bool", False), ('{"same_sense": "false"}', True, "str", True), ('{"same_sense": null}', True, "null", False), ('{"sense1": 1}', True, "missing", None),
        ('{"same_sense": 0, "same_sense": 2}', True, "int", True), ('{"same_sense": NaN}', True, "float", True), ("{'same_sense': true}", False, None, None), ('{"same_sense": true} x', True, "bool", True),
        ('{"same_sense": true} }', False, None, None), (None, False, None, None), ("", False, None, None),
    ],
)
def test_parse(spark, text, ok, kind, truthy):
    got = one(spark, A.parsed(F.col("t")), t=("string", text))
    assert (got["ok"], got["kind"], got["truthy"]) == (ok, kind, truthy)


def test_parse_ignores_think(spark):
    assert one(spark, A.verdict(F.col("t"), A.parsed(F.col("t"))), t=("string", "<think>{\"same_sense\": false}</think>the SAME sense")) is True
    assert one(spark, A.verdict(F.col("t"), A.parsed(F.col("t"))), t=("string", "<think>same")) is None
    assert one(spark, A.verdict(F.col("t"), A.parsed(F.col("t"))), t=("string", "same_sense unclear")) is None


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, "null"), ("", "empty"), (" \n\t", "empty"), ("a" * 99, "too_short"), ("a" * 100, None), ("b" * 5001, "too_long"), ("д" + "a" * 200, "non_english"),
        ("word " * 60, "repetitive"), (" ".join(f"w{i}" for i in range(60)), None), (" ".join(f"w{i}" for i in range(13)) + " word" * 39, None), ("日本" * 80, "non_english"),
    ],
)
def test_rule_check(spark, text, want):
    assert one(spark, quality.rule_check(F.col("t")), t=("string", text)) == want


def test_votes(spark):
    got = lambda v: tuple(one(spark, votes.vote(F.col("v")), v=("array<boolean>", v)))
    assert got([True, True, False]) == (True, 2 / 3)
    assert got([True, False]) == (None, 0.5)
    assert got([None, False]) == (False, 1.0)
    assert got([None]) == (None, 0.0)
    assert got([]) == (None, 0.0)


def test_metrics_of_nothing(spark):
    got = votes.metrics(spark.createDataFrame([], "prediction boolean, label boolean")).first()
    assert (got["n_scored"], got["accuracy"], got["f1"]) == (0, 0.0, 0.0)


@pytest.mark.parametrize(
    ("sentence", "word", "want"),
    [
        ("The Banks closed, the bank too.", "bank", "The <t> Banks </t> closed, the bank too."), ("He ran home.", "run", "He <t> ran </t> home."), ("Nothing here.", "zebra", "Nothing here. <t> zebra </t>"),
        ("cost $1 a.b now", "a.b", "cost $1 <t> a.b </t> now"), ("", "x", " <t> x </t>"), ("riverbank bank", "bank", "riverbank <t> bank </t>"),
    ],
)
def test_mark_target(spark, sentence, word, want):
    threshold = 60.0 if word == "run" else 70.0
    assert one(spark, T.mark_target(F.col("s"), F.col("w"), threshold), s=("string", sentence), w=("string", word)) == want


def test_mark_span_and_safe(spark):
    mark = T.mark_span(F.col("s"), F.lit(3), F.lit(6))
    assert one(spark, mark, s=("string", "He set the table and set out.")) == "He <t> set </t> the table and set out."
    safe = T.mark_safe(F.lit("bank"), F.col("s"))
    assert one(spark, safe, s=("string", "A BANK, a bank.")) == "A BANK, a <t>bank</t>."
    assert one(spark, safe, s=("string", "A BANK.")) == "A <t>BANK</t>."
    assert one(spark, safe, s=("string", "none")) == "none"


def test_text(spark):
    assert one(spark, T.normal_gloss(F.col("s")), s=("string", " To  Kill\tsomeone... ")) == "to kill someone"
    assert one(spark, T.normal_gloss(F.col("s")), s=("string", "A b..")) == "a b"
    assert one(spark, T.tokens(F.col("s")), s=("string", "L'été_2 — Ok")) == ["l", "été_2", "ok"]
    assert one(spark, T.set_f1(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1.0
    assert one(spark, T.set_f1_strict(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0.0
    assert one(spark, T.answer_region(F.col("s")), s=("string", "<think>a</think> b ")) == "b"
    assert one(spark, T.answer_region(F.col("s")), s=("string", "<think>a")) == ""
    assert tuple(one(spark, T.split_think(F.col("s")), s=("string", "x <think> a </think> y"))) == ("a", "x  y")
    assert one(spark, A.dump_answer(F.lit("é"), F.lit("b"), F.lit(True))) == '{"sense1": "\\u00e9", "sense2": "b", "same_sense": true}'


LEX = [("bank", "noun", 1, "b.1", "a financial institution"), ("bank", "noun", 2, "b.2", "sloping land beside water"), ("dog", "noun", 1, "d.1", "a domestic animal"),
       ("direct", "a", 1, "x.1", "straightforward in manner"), ("direct", "s", 2, "x.2", "in a straight line"), ("ice cream", "noun", 1, "i.1", "a frozen sweet")]
FIN, RIVER = "an institution that is financial", "land sloping beside the water"


@pytest.mark.parametrize(
    ("lemma", "pos", "one_", "two", "label", "strict", "anchor", "want"),
    [
        ("bank", "noun", FIN, FIN, False, False, 0.0, "wn_merged_diff_label"), ("bank", "noun", FIN, RIVER, False, False, 0.0, None), ("bank", "noun", FIN, RIVER, True, False, 0.0, None),
        ("bank", "noun", FIN, RIVER, True, True, 0.0, "wn_split_same_label"), ("zebra", "noun", FIN, FIN, False, True, 0.0, None), ("bank", "noun", None, FIN, False, True, 0.0, None),
        ("bank", "noun", " ", FIN, False, True, 0.0, None), ("bank", "noun", "zzz", FIN, True, False, 0.1, "gloss_unanchored"), ("ice cream", "noun", "frozen sweet", "sweet", True, True, 0.0, None),
        ("direct", "adj", "manner straightforward", "straight line", True, True, 0.0, "wn_split_same_label"),
    ],
)
def test_gloss_check(spark, lemma, pos, one_, two, label, strict, anchor, want):
    lex = lexicon.normal_lexicon(spark.createDataFrame(LEX, "lemma string, pos string, rank int, synset_id string, definition string"))
    rows = spark.createDataFrame([(1, lemma, pos, one_, two, label)], "k int, lemma string, pos string, sense1 string, sense2 string, label boolean")
    assert lexicon.check_glosses(rows, lex, ["k"], anchor, strict).first()["reason"] == want


def test_confusability(spark):
    edges = spark.createDataFrame([("a", "p"), ("b", "p"), ("p", "q"), ("c", "q"), ("e", "d5"), ("d5", "d4"), ("d4", "d3"), ("d3", "q"), ("z", "y")], "synset_id string, hypernym_id string")
    pos = spark.createDataFrame([(x, "v" if x == "w" else "n") for x in "abcezw"], "synset_id string, pos string")
    asked = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "e"), ("a", "z"), ("a", "w"), ("a", "unknown")], "s1 string, s2 string")
    got = {r["s2"]: r["level"] for r in lexicon.confusability(asked, lexicon.ancestors(edges), pos, lexicon.depths(edges)).collect()}
    assert got == {"b": "siblings", "c": "near", "e": "far", "z": "unrelated", "w": "cross-pos", "unknown": None}


def test_confusability_takes_the_deepest_common_hypernym(spark):
    # x and y share the hypernym top, and low, which lies deeper but further from them.
    edges = spark.createDataFrame([("x", "top"), ("y", "top"), ("x", "m"), ("y", "n"), ("m", "low"), ("n", "low"), ("low", "mid"), ("mid", "top")], "synset_id string, hypernym_id string")
    pos = spark.createDataFrame([("x", "n"), ("y", "n")], "synset_id string, pos string")
    asked = spark.createDataFrame([("x", "y")], "s1 string, s2 string")
    assert lexicon.confusability(asked, lexicon.ancestors(edges), pos, lexicon.depths(edges)).first()["level"] == "near"
    heights = {r["synset_id"]: r["height"] for r in lexicon.depths(edges).collect()}
    assert heights == {"top": 0, "mid": 1, "low": 2, "m": 3, "n": 3, "x": 4, "y": 4}


def test_hardest_pairs_first(spark):
    usages = pairs.usable_annotations(annotations(spark))
    order = [("bank.0", "bank.1", "far"), ("bank.0", "bank.2", "siblings"), ("bank.0", "bank.3", "near"), ("bank.1", "bank.2", "unrelated"), ("bank.1", "bank.3", None), ("bank.2", "bank.3", "siblings")]
    levels = spark.createDataFrame(order, "s1 string, s2 string, level string")
    of = lambda cutoff, cap: {(r["synset1"], r["synset2"]) for r in pairs.different_pairs(usages, levels, cutoff, cap).collect()}
    assert of(None, 2) == {("bank.0", "bank.2"), ("bank.2", "bank.3")} and of(None, 3) == of(None, 2) | {("bank.0", "bank.3")}
    assert of("far", 9) == of(None, 9) - {("bank.1", "bank.2")} and len(of(None, 9)) == 5


def test_files_round_trip(spark, tmp_path):
    import gzip

    rows = spark.createDataFrame([("a", "x\n\u00e9", 1), ("b", None, 2)], "k string, t string, n int")
    for _ in range(2):
        writers.write_lines(rows, str(tmp_path / "lines"))
    back = readers.read_lines(spark, str(tmp_path / "lines"), "k string, t string, n int")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(2 * [tuple(r) for r in rows.collect()], key=str)
    writers.write_split(rows.withColumn("split", F.when(F.col("n") == 1, "dev").otherwise("train")), str(tmp_path / "split"))
    assert [r["k"] for r in spark.read.parquet(str(tmp_path / "split" / "split=dev")).collect()] == ["a"]
    record = [{"text": "the bank", "sent_id": "s", "start": 4, "end": 8, "lemma": "bank", "pos": "NOUN", "synsets": ["b.1"]}]
    for name, data in (("plain.json", json.dumps(record).encode()), ("packed.json.gz", gzip.compress(json.dumps(record).encode()))):
        (tmp_path / name).write_bytes(data)
        assert readers.read_annotations(spark, str(tmp_path / name)).first()["lemma"] == "bank"
    teacher = {"lemma": "a", "pos": "n", "sentence1": "s", "sentence2": "t", "usage1": "u", "usage2": "v", "label": 1, "prediction": True, "votes": [True], "reasonings": [" why "], "answers": ['{"sense1": "p", "sense2": "q", "same_sense": true}']}
    (tmp_path / "teacher.json").write_text(json.dumps([teacher, teacher | {"lemma": "b", "prediction": False}]))
    got = readers.read_traces(spark, str(tmp_path / "teacher.json")).collect()
    assert [(r["lemma"], r["think"], r["sense1"], r["label"]) for r in got] == [("a", "why", "p", True)]
    with pytest.raises(FileNotFoundError, match="build them"):
        readers.read_gold_pairs(spark, str(tmp_path / "none.json"))
    assert writers.report_text(spark.sql("SELECT 0.5D AS f1, 3 AS n, CAST('nan' AS DOUBLE) AS cos"), "Glosses") == "Glosses\nf1   0.5000\nn    3\ncos  n/a"


def test_null_keys_are_equal(spark):
    schema = "lemma string, pos string, sentence1 string, sentence2 string, label boolean, doc_id int, slots array<string>, error string"
    base = spark.createDataFrame([("a", None, "s", "t", True, 1, ["x"], None), ("b", "n", "s", "t", True, 2, ["x"], None)], schema)
    add = spark.createDataFrame([("a", None, "s", "t", False, 3, ["y"], None), ("c", None, None, "t", True, 4, ["y"], None)], schema)
    got = {r["lemma"]: (r["pos"], r["status"], r["slots"]) for r in corpus.merge(base, add, "both").collect()}
    assert got == {"a": (None, "merged", ["x", "y"]), "b": ("n", "base_only", ["x"]), "c": (None, "new", ["y"])}
    assert [r["lemma"] for r in corpus.exclude(base, add).collect()] == ["b"]
    done, todo = corpus.resume(base, add, "doc_id")
    assert [r["lemma"] for r in done.collect()] == ["a"] and [r["lemma"] for r in todo.collect()] == ["b"]


def test_fences_and_whole_answers(spark):
    cut_out = lambda x: one(spark, A.extract_object(F.lit(x)))
    assert cut_out(' ```json\n{"a": 1}\n``` ') == '{"a": 1}' and cut_out('```{"a": 1}```') == '{"a": 1}' and cut_out('so {"a": {"b": 1}} it is') == '{"a": {"b": 1}}'
    assert cut_out("```JSON\nnone```") == "JSON\nnone" and cut_out("} no {") == "} no {" and cut_out("") == ""
    assert A.parse_answer('so {"sense1": "a"}') == {"sense1": "a"} and A.parse_answer('so {"sense1": "a"}', whole=True) is None


def test_strip_space(spark):
    for x in (" \t\x0b\x1c\u3000 a b\u2003\x85 ", "\u200b a", "", " \xa0 "):
        assert one(spark, T.strip_space(F.lit(x))) == x.strip()
    assert len(T.SPACES) == len(set(T.SPACES)) and all(c.isspace() for c in T.SPACES)


def annotations(spark):
    rows = []
    for lemma in ("bank", "Plant", "run"):
        for sense in range(4):
            for k in range(5 + sense):
                rows.append((f"{lemma} sentence number {k} of sense {sense} here", "s", 0, len(lemma), lemma, "NOUN", [f"{lemma}.{sense}"]))
    rows += [("too short", "s", 0, 3, "bank", "NOUN", ["bank.0"]), ("a sentence that is long enough", "s", 0, 1, "bank", "ADP", ["bank.0"]), ("another sentence that is long enough", "s", 0, 1, "bank", "NOUN", ["bank.0", "bank.1"])]
    return spark.createDataFrame(rows, "text string, sent_id string, start int, end int, lemma string, pos string, synsets array<string>")


def test_pair_building(spark):
    lex = spark.createDataFrame([(x, "noun", s + 1, f"{x}.{s}", f"sense {s} of {x}" if s < 3 else "") for x in ("bank", "Plant", "run") for s in range(4)], "lemma string, pos string, rank int, synset_id string, definition string")
    held = spark.createDataFrame([("PLANT",)], "lemma string")
    made = pairs.build(annotations(spark), lex, lexicon.inventory(lex), held_out=held).cache()
    rows = made.collect()
    assert rows and pairs.leaked(made, held).count() == 0
    assert sum(r["label"] for r in rows) * 2 == len(rows)
    for r in rows:
        assert r["sentence1"] != r["sentence2"] and r["label"] == (r["synset1"] == r["synset2"])
        assert r["usage1"].startswith(f"<t> {r['lemma']} </t>") or r["usage1"].startswith(" <t>")
        assert all(g in r["senses"] for g in (r["gloss1"], r["gloss2"]) if g)
    per = {}
    for r in rows:
        per[r["lemma"], r["label"]] = per.get((r["lemma"], r["label"]), 0) + 1
    assert max(per.values()) <= 4


def test_confusability_restricts_pairs(spark):
    usages = pairs.usable_annotations(annotations(spark))
    levels = spark.createDataFrame([("bank.0", "bank.1", "near"), ("bank.0", "bank.2", "far"), ("bank.1", "bank.2", None)], "s1 string, s2 string, level string")
    got = {(r["synset1"], r["synset2"]) for r in pairs.different_pairs(usages, levels, "near").collect()}
    assert got == {("bank.0", "bank.1")}


def test_balance_and_split(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 5 == 0).alias("label"))
    got = corpus.balance(df, "label", ["id"]).groupBy("label").count().collect()
    assert {r["count"] for r in got} == {200}
    parts = corpus.split(df, ["id"]).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in parts} == {"dev": 50, "train": 950}
    assert corpus.split(df.limit(1), ["id"]).first()["split"] == "dev"
    assert corpus.split(df.limit(0), ["id"]).count() == 0
    assert corpus.balance(df.filter("label"), "label", ["id"]).count() == 0
    assert corpus.capped(df, 10, ["id"]).count() == 10


def test_slots_stay_aligned(spark):
    rows = [(1, 0, "a", True, {"english": True}), (1, 1, "b", False, None), (1, 2, "c", True, None), (2, 0, "d", False, None)]
    slots = spark.createDataFrame(rows, "record int, slot int, answer string, keep boolean, scores map<string,boolean>")
    records = slots.groupBy("record").agg(F.array_sort(F.collect_list(F.struct("slot", "answer", "keep"))).alias("slots"))
    got = quality.prune_slots(records).collect()
    assert [(r["record"], [s["answer"] for s in r["slots"]]) for r in got] == [(1, ["a", "c"])]


def test_merge(spark):
    schema = "lemma string, pos string, sentence1 string, sentence2 string, label boolean, ord int, slots array<struct<reasoning:string>>"
    base = spark.createDataFrame([("a", "n", "1", "2", True, 0, [("x",)]), ("b", "n", "1", "2", False, 1, [])], schema)
    add = spark.createDataFrame([("a", "n", "1", "2", True, 0, [("y",), ("z",)]), ("c", "n", "1", "2", False, 1, [("w",)])], schema)
    got = {r["lemma"]: (r["status"], [s["reasoning"] for s in r["slots"]]) for r in corpus.merge(base, add, "both").collect()}
    assert got == {"a": ("merged", ["x", "y", "z"]), "c": ("new", ["w"])}
    with pytest.raises(ValueError):
        corpus.merge(base, add, "neither")


def test_select(spark):
    rows = [(1, True, [None, "{\"same_sense\": true, \"sense1\": \"p\"}", "{\"same_sense\": true}", "{\"same_sense\": \"\"}"], ["q", "short", "a longer one", "z", "extra"])]
    df = spark.createDataFrame(rows, "record int, prediction boolean, answers array<string>, reasonings array<string>")
    found = traces.candidates(df)
    assert traces.select_one(found, ["record"], "first").first()["think"] == "short"
    assert traces.select_one(found, ["record"], "longest").first()["think"] == "a longer one"
    with pytest.raises(ValueError):
        traces.select_one(found, ["record"], "entropy")


def test_unknown_task(spark):
    with pytest.raises(Exception, match="unknown task"):
        one(spark, traces.build_messages(F.lit("other"), {k: F.lit("") for k in ("lemma", "pos", "usage1", "usage2")}))


def test_teacher_rows(spark):
    df = spark.createDataFrame([(said("t", obj()),), ("<think>open",), (said("t", "same"),)], "output string")
    got = traces.teacher_row(df).collect()
    assert [(r["prediction"], len(r["answers"]), r["reasonings"]) for r in got] == [(False, 1, ["t"]), (None, 0, []), (True, 0, [])]


def test_hints(spark):
    hint = lambda label, g1, g2, genus=None: one(spark, rollouts.gloss_feedback(F.lit("set"), F.lit(label), F.lit(g1).cast("string"), F.lit(g2).cast("string"), F.lit(genus).cast("string")))
    assert hint(True, "g", "g").count('"g"') == 1
    assert '"g"' in hint(False, "g", "h") and '"h"' in hint(False, "g", "h")
    assert "kinds of living thing" in hint(False, "g", "h", "living_thing")
    assert "different senses" in hint(False, None, "h")
    assert all("Do not mention this hint" in hint(*a) for a in ((True, "g", "g"), (False, None, None)))


def test_gloss_evaluation(spark):
    schema = "k int, lemma string, pos string, definition string, gloss string, filler_gloss string"
    rows = spark.createDataFrame([(1, "bank", "n", FIN, FIN, RIVER), (2, "bank", "n", RIVER, "", RIVER)], schema)
    got = evaluate.summary(evaluate.score_rows(rows)).first()
    assert (got["n"], got["n_scored"], got["empty"], got["f1"]) == (2, 1, 1, 1.0)
    assert math.isnan(got["cos"]) and (got["bleu"], got["chrf"]) == (pytest.approx(100.0), pytest.approx(100.0)) and got["len_gloss"] == got["len_gold"]
    empty = spark.createDataFrame([(1, "x", "n", FIN, FIN, ""), (2, "y", "n", FIN, RIVER, RIVER)], schema)
    got = evaluate.full_summary(empty, ["k"], "k").first()  # an empty filler gloss still counts below the line
    assert (got["n_echo_scored"], got["filler_echo_rate"], got["n_sense_scored"]) == (2, 0.5, 0) and math.isnan(got["sense_acc"])
    short = one(spark, evaluate.sentence_bleu(F.lit("a cat"), F.lit("a cat sat")))  # two orders, brevity
    assert short == pytest.approx(100 * math.exp(1 - 3 / 2))
    assert one(spark, evaluate.sentence_bleu(F.lit("x y"), F.lit("a b"))) == 0.0
    assert one(spark, F.array_join(evaluate.bleu_tokens(F.lit("It's 3.5-fold, &quot;Yes&quot;.")), "|")) == "It's|3.5|-|fold|,|\"|Yes|\"|."
    echo = spark.createDataFrame([(1, "x", "n", FIN, RIVER, RIVER)], schema)
    assert evaluate.echo_rate(evaluate.score_rows(echo)).first()[0] == 1.0
    assert evaluate.echo_rate(evaluate.score_rows(rows.filter("k = 1"))).first()[0] == 0.0
    own = spark.createDataFrame([(1, "x", "n", RIVER, RIVER, RIVER)], schema)
    assert math.isnan(evaluate.echo_rate(evaluate.score_rows(own)).first()[0])
    wide = spark.createDataFrame([(1, "bank", "n", FIN, FIN, ""), (2, "bank", "n", RIVER, FIN, ""), (3, "dog", "n", "animal", "animal", "")], schema)
    got = evaluate.sense_accuracy(wide, ["k"], "k").first()
    assert (got["n"], got["accuracy"]) == (2, 0.5)
    assert math.isnan(evaluate.sense_accuracy(wide.limit(0), ["k"], "k").first()["accuracy"])
    same = spark.createDataFrame([("the cat sat on the mat",) * 2], "gloss string, definition string")
    assert evaluate.corpus_bleu(same).first()[0] == pytest.approx(100.0)
    assert one(spark, evaluate.chrf(F.lit("abc def"), F.lit("abc def"))) == pytest.approx(100.0)
    assert one(spark, evaluate.chrf(F.lit("abc"), F.lit("xyz"))) == 0.0


def test_gloss_records(spark):
    raw = spark.createDataFrame([("bank", "bank", None, "He sat by the banks.", "d"), ("bank", "bank", "noun", "A <t>bank</t>.", "d")], "lemma string, word string, pos string, usage string, definition string")
    got = readers.gloss_records(raw, "verb").collect()
    assert [(r["pos"], r["marked"], r["usage"]) for r in got] == [("verb", "He sat by the <t> banks </t>.", "He sat by the banks."), ("noun", "A <t>bank</t>.", "A <t>bank</t>.")]
    with pytest.raises(Exception, match="lacks definition"):
        readers.gloss_records(raw.withColumn("definition", F.lit(" "))).collect()


def test_files(spark, tmp_path):
    (tmp_path / "mcl-wic.dev.json").write_text(json.dumps([{"lemma": "bank", "pos": "noun", "word1": "bank", "sentence1": "A bank.", "word2": "banks", "sentence2": "The banks.", "label": 1}]))
    got = readers.read_pairs(spark, str(tmp_path), "dev").first()
    assert (got["label"], got["usage2"]) == (True, "The <t> banks </t>.")
    (tmp_path / "gold.json").write_text(json.dumps([{"lemma": "bank", "pos": "noun", "label": True, "sentence1": "a", "sentence2": "b"}]))
    gold = readers.read_gold_pairs(spark, str(tmp_path / "gold.json")).first()
    assert (gold["gloss1"], gold["senses"]) == ("", [])
    for name, data in (("bare", [{"lemma": "a", "gloss": "g"}]), ("full", {"summary": {}, "records": [{"lemma": "a", "gloss": "g"}]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
        assert [r["gloss"] for r in readers.read_eval(spark, str(tmp_path / f"{name}.json")).collect()] == ["g"]
    rows = spark.createDataFrame([("wic", "a", "n", 'x "q"', "y")], "task string, lemma string, pos string, sentence1 string, sentence2 string")
    writers.write_manifest(rows, str(tmp_path / "manifest"))
    assert tuple(readers.read_manifest(spark, str(tmp_path / "manifest")).first()) == ("a", "n", 'x "q"', "y")
    assert json.loads(writers.array_text(rows, ["lemma"]))[0]["sentence1"] == 'x "q"'


def test_backends(spark):
    waits = []
    calls = iter([ValueError("a"), ValueError("b"), "ok"])

    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert backends.with_retry(call, wait=waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(SystemExit):
        backends.client_from_key(None, lambda k: k)

    def client():
        return lambda prompt: f"<{prompt}>"

    df = spark.createDataFrame([("p",)], "prompt string")
    assert backends.sample(df, client, 2).first()["outputs"] == ["<p>", "<p>"]


def test_streaming_resume(spark, tmp_path):
    from glossmill.streaming.resume import process_new

    (tmp_path / "in").mkdir()
    work = lambda df: df.withColumn("score", F.col("k") * 10)
    for n, ks in enumerate(([1, 2], [2, 3])):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({"k": k}) for k in ks))
        process_new(spark, str(tmp_path / "in"), "k int", str(tmp_path / "done"), str(tmp_path / "state"), work, ["k"]).awaitTermination()
    assert sorted((r["k"], r["score"]) for r in spark.read.parquet(str(tmp_path / "done")).collect()) == [(1, 10), (2, 20), (3, 30)]


def test_small_rewards(spark):
    assert one(spark, rewards.repetition(F.lit("a b c a b c"))) == pytest.approx(-0.05)
    assert one(spark, rewards.repetition(F.lit("a b"))) == 0.0
    assert one(spark, rewards.overlong(F.lit(936), 1000)) == pytest.approx(-0.1)
    assert one(spark, rewards.overlong(F.lit(1001), 1000)) == pytest.approx(-0.2)
    assert one(spark, rewards.overlong(F.lit(10), 1000)) == 0.0


def test_reports_and_guards(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0)], "name string, f1 double")
    writers.write_report(rows.select("f1"), rows, str(tmp_path / "report"))
    assert json.loads((tmp_path / "report").read_text()) == {"summary": {"f1": 1.0}, "records": [{"name": "a", "f1": 1.0}]}
    for f1 in (0.5, 0.75):
        writers.write_metrics(rows.withColumn("f1", F.lit(f1)), str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).first()["f1"] == 0.75
    assert rollouts.check_batch(4, 8, 2) == 1
    with pytest.raises(ValueError):
        rollouts.check_batch(3, 8)
    assert writers.output_names("x") == ("predictions_x.jsonl", "predictions_x_metrics.json")


def test_gold_pairs_keep_their_gloss_in_the_inventory(spark):
    lex = spark.createDataFrame([("b", "noun", 1, "b.0", "same words"), ("b", "noun", 2, "b.1", "same words"), ("b", "noun", 3, "b.2", "other")], "lemma string, pos string, rank int, synset_id string, definition string")
    senses = spark.createDataFrame([("b", "noun", ["only this"])], "lemma string, pos string, senses array<string>")
    usage = lambda t: (t, 0, 1)
    schema = "lemma string, pos string, synset1 string, synset2 string, u1 struct<text:string,start:int,end:int>, u2 struct<text:string,start:int,end:int>"
    made = spark.createDataFrame([("b", "noun", "b.0", "b.1", usage("x y"), usage("z w")), ("b", "noun", "b.0", "b.2", usage("x y"), usage("z w")), ("b", "noun", "b.9", "b.2", usage("x"), usage("y"))], schema)
    got = {(r["synset1"], r["synset2"]): (r["gloss1"], r["gloss2"], r["senses"]) for r in pairs.annotate(made, lex, senses).collect()}
    assert got["b.0", "b.1"] == ("", "", ["only this"])
    assert got["b.0", "b.2"] == ("same words", "other", ["only this", "same words", "other"])
    assert got["b.9", "b.2"] == ("", "other", ["only this", "other"])


def test_scores_of_a_small_file_are_made_by_many_tasks(spark):
    from glossmill.operators import evaluate
    from glossmill.plans import queries as Q

    one = spark.createDataFrame([(k, f"a b {k}", "a b c, d", "") for k in range(40)], "id int, gloss string, definition string, filler_gloss string").coalesce(1)
    assert evaluate.score_rows(one).rdd.getNumPartitions() >= 4
    for name in ("gloss_bleu_rows", "gloss_chrf"):
        assert Q.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4
    got = one.limit(1).select(evaluate.sentence_bleu(F.lit("a b b, d"), F.lit("a b c, d")).alias("x"), evaluate.sentence_bleu(F.lit(None).cast("string"), F.lit("a")).alias("none"), evaluate.sentence_bleu(F.lit(""), F.lit("a")).alias("empty")).first()
    assert got["x"] == pytest.approx(100 * (4 / 5 * 2 / 4 / 6 / 8) ** 0.25) and got["none"] == got["empty"] == 0.0


def test_no_part_of_a_taxonomy_is_broadcast(spark, monkeypatch):
    """Estimated sizes of compressed files are small; none of these tables may go through the driver."""
    from glossmill.operators import lexicon

    plans = []
    real = lexicon.cut
    monkeypatch.setattr(lexicon, "cut", lambda df: (plans.append(df), real(df))[1])
    edges = spark.createDataFrame([(2, 1), (3, 1), (4, 2)], "synset_id long, hypernym_id long")
    pos = spark.createDataFrame([(k, "noun") for k in range(1, 5)], "synset_id long, pos string")
    names = spark.createDataFrame([(k, f"n_{k}") for k in range(1, 5)], "synset_id long, name string")
    asked = spark.createDataFrame([(2, 3), (4, 3), (4, 9)], "s1 long, s2 long")
    up, down = lexicon.ancestors(edges), lexicon.depths(edges)
    levels, kinds = lexicon.confusability(asked, up, pos, down), lexicon.genus(asked, up, down, pos, names)
    assert {(r["s1"], r["s2"]): r["level"] for r in levels.collect()} == {(2, 3): "siblings", (4, 3): "near", (4, 9): None}
    assert {(r["s1"], r["s2"]): r["genus"] for r in kinds.collect()} == {(2, 3): "n 1", (4, 3): "n 1", (4, 9): None}
    assert len(plans) > 4 and not any("Broadcast" in df._jdf.queryExecution().executedPlan().toString() for df in [*plans, levels, kinds])


def test_tasks_of_chrf_grow_with_the_rows(spark):
    """However many rows one task reads, those that score them have a bounded share each; a pair that many rows have is scored once."""
    from glossmill.operators import evaluate
    from glossmill.session import spread

    one = spark.range(4000).selectExpr("id", "IF(id < 0, '', 'the bank of a river') AS gloss", "IF(id < 0, '', 'a bank of a river') AS definition").coalesce(1)
    dealt = spread(one, rows=100)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert dealt.rdd.getNumPartitions() == 40 and len(sizes) == 40 and max(sizes) < 200
    scores = dealt.select(evaluate.chrf(F.col("gloss"), F.col("definition")).alias("x")).distinct().collect()
    assert len(scores) == 1 and scores[0]["x"] == one.limit(1).select(evaluate.chrf(F.col("gloss"), F.col("definition")).alias("x")).first()["x"] > 0
    many, few = evaluate.corpus_bleu(one), evaluate.corpus_bleu(one.limit(1))
    assert many.first()["bleu"] == few.first()["bleu"] > 0
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Aggregate [gloss")


def test_the_confusability_query_broadcasts_nothing(spark, monkeypatch):
    from glossmill.operators import lexicon
    from glossmill.plans import queries as Q

    plans, real = [], lexicon.cut
    monkeypatch.setattr(lexicon, "cut", lambda df: (plans.append(df), real(df))[1])
    levels = Q.queries()["confusability"](spark, "/root/testdata/sf0.001")
    assert len(plans) > 4 and not any("Broadcast" in df._jdf.queryExecution().executedPlan().toString() for df in [*plans, levels])
    asked = {(r["s1"], r["s2"]) for r in Q.view(spark, "/root/testdata/sf0.001", Q.CLOSE_PAIRS).collect()}
    got = levels.collect()
    assert len(got) == len(asked) and {(r["s1"], r["s2"]) for r in got} == asked and {r["level"] for r in got} >= {"siblings", "near", "cross-pos"}
