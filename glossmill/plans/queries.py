"""Registered queries of the operators over adapter views of the driver's tables, each with the SQL that checks it.

An adapter is one SQL text that both engines read: it gives documents and other tables the shape of the entities above.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text as T
from ..operators import choice, corpus, evaluate, lexicon, pairs, quality, rewards, rollouts, traces, votes
from ..session import cut, never_broadcast, spread
from .prompts import JUDGE_AXES, NO_MENTION, STUDENT_TAIL, SYSTEM, TEACHER_TAIL

SLOTS = """
SELECT doc_id, CAST(floor(doc_id / 3.0) AS BIGINT) AS record, CAST(doc_id % 3 AS INT) AS slot,
  CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN concat(text, ' д') WHEN doc_id % 29 = 0 THEN '   ' ELSE text END AS reasoning,
  CAST(floor(doc_id / 3.0) AS BIGINT) % 2 = 0 AS label,
  CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST(floor(doc_id / 3.0) AS BIGINT) % 2 <> 0 ELSE CAST(floor(doc_id / 3.0) AS BIGINT) % 2 = 0 END AS vote,
  CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'no object'
    ELSE concat(CASE WHEN doc_id % 7 = 2 THEN 'so: ' ELSE '' END, '{"sense1": "a thing", "sense2": "', CASE WHEN doc_id % 4 = 0 THEN 'A  Thing..' ELSE 'something else' END, '", "same_sense": ', CASE WHEN CAST(floor(doc_id / 3.0) AS BIGINT) % 2 = 0 THEN 'true' ELSE 'false' END, '}') END AS answer,
  concat('lemma', CAST(doc_id % 20 AS VARCHAR(9))) AS lemma, source AS pos
FROM documents"""

COMPLETIONS = """
SELECT d.doc_id, l.quality = 1 AS label, d.lang AS lemma, 'noun' AS pos,
  CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE 'money in an institution' END AS gloss1, CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE 'sloping land beside water' END AS gloss2,
  CASE d.doc_id % 8
    WHEN 0 THEN concat('<think>one two three compare deposits rivers lands accounts meaning senses</think>', '{"sense1": "an institution for money", "sense2": "land beside water", "same_sense": ', CASE WHEN d.doc_id % 16 = 0 THEN 'true' ELSE 'false' END, '}')
    WHEN 1 THEN '<think>short</think>{"sense1": "sloping land", "sense2": "sloping land", "same_sense": "true"}'
    WHEN 2 THEN '<think></think>{"sense1": "water", "sense2": "money", "same_sense": 1}'
    WHEN 3 THEN '<think>bank means river side versus money house company building</think>{"sense1": "sloping land", "sense2": "money", "same_sense": false, "extra": 1}'
    WHEN 4 THEN '<think>x</think>two Different senses'
    WHEN 5 THEN '<think>x</think>{"sense1": "a", "sense2": '
    WHEN 6 THEN '<think>never closed {"same_sense": true}'
    ELSE '<think>x</think>  ' END AS completion
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""

PREDICTIONS = """
SELECT l.doc_id, l.quality = 1 AS label, CASE WHEN l.doc_id % 11 = 0 THEN NULL ELSE l.toxic = 1 END AS prediction, CASE WHEN l.doc_id % 9 = 0 THEN NULL ELSE d.lang END AS pos
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""

GLOSSES = """
SELECT p_partkey, p_brand AS lemma, 'noun' AS pos, p_name AS definition, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE p_type END AS gloss,
  CASE WHEN p_partkey % 12 = 5 THEN '' WHEN p_partkey % 4 = 0 THEN p_type ELSE concat(p_type, ' money institution') END AS filler_gloss, p_size % 2 = 0 AS label
FROM part"""

LEXICON = """
SELECT lemma, pos, CAST(row_number() OVER (PARTITION BY lemma ORDER BY definition) AS INT) AS rank, concat(lemma, ':', definition) AS synset_id, definition
FROM (SELECT DISTINCT p_brand AS lemma, 'noun' AS pos, p_name AS definition FROM part)"""

CORPUS = """
SELECT doc_id, source AS lemma, CASE WHEN doc_id % 5 = 1 THEN NULL ELSE 'noun' END AS pos, concat('a', CAST(doc_id % 400 AS VARCHAR(9))) AS sentence1, 'b' AS sentence2, doc_id % 2 = 0 AS label, CAST(doc_id AS VARCHAR(20)) AS trace
FROM documents WHERE """

_W = "[\\p{L}\\p{N}_]"
TOK = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
_SP = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]"
STOP_SHORT = "[" + ", ".join(f"'{w}'" for w in T.SHORT_STOPLIST) + "]"
STOP_LONG = "[" + ", ".join(f"'{w}'" for w in T.STOPLIST) + "]"


def _duck_set(text: str, stop: str = STOP_SHORT) -> str:
    return f"list_filter(list_distinct({TOK.format(text)}), lambda x: NOT list_contains({stop}, x))"


def _duck_f1(a: str, b: str, empty: str = "1.0") -> str:
    return f"(CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN {empty} ELSE 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for table in ("documents", "labels", "part", "events", "embeddings", "conversations"):
        if table in sql:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(sql)


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with the SQL that checks it."""

    def register(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def with_slots(rest: str) -> str:
    return f"WITH s AS ({SLOTS}) {rest}"


RULE = f"""CASE WHEN reasoning IS NULL THEN 'null' WHEN {_strip("reasoning")} = '' THEN 'empty' WHEN regexp_matches({_strip("reasoning")}, '{T.NON_LATIN}') THEN 'non_english'
  WHEN length({_strip("reasoning")}) < 100 THEN 'too_short' WHEN length({_strip("reasoning")}) > 5000 THEN 'too_long'
  WHEN len(list_filter(regexp_split_to_array(reasoning, '{_SP}+'), lambda x: x <> '')) >= 50
   AND len(list_distinct(list_filter(regexp_split_to_array(reasoning, '{_SP}+'), lambda x: x <> ''))) / len(list_filter(regexp_split_to_array(reasoning, '{_SP}+'), lambda x: x <> '')) < 0.25 THEN 'repetitive' END"""
VOTE = "CASE WHEN vote IS NULL THEN 'no_vote' WHEN vote <> label THEN 'wrong_prediction' END"
SAME_G = "(answer LIKE '%A  Thing..%')"
SENSE = f"CASE WHEN answer LIKE '{{%' AND {SAME_G} AND NOT label THEN 'same_gloss_diff_label' END"
SENSE_STRICT = f"CASE WHEN answer LIKE '{{%' AND {SAME_G} AND NOT label THEN 'same_gloss_diff_label' WHEN answer LIKE '{{%' AND NOT {SAME_G} AND label THEN 'diff_gloss_same_label' END"
CHAIN = f"coalesce({RULE}, {VOTE}, {SENSE_STRICT})"
CHECKED = f"s AS ({SLOTS}), c AS (SELECT *, {CHAIN} AS reason FROM s)"


@query(with_slots("SELECT doc_id, record, slot, label, vote, length(reasoning) AS n_chars FROM s"))
def scan_slots(spark, d):
    return view(spark, d, SLOTS).select("doc_id", "record", "slot", "label", "vote", F.char_length("reasoning").cast("bigint").alias("n_chars"))


@query(with_slots(f"SELECT doc_id, {RULE} AS reason FROM s"))
def rule_check(spark, d):
    return view(spark, d, SLOTS).select("doc_id", quality.rule_check(F.col("reasoning")).alias("reason"))


@query(with_slots(f"SELECT doc_id, {VOTE} AS reason FROM s"))
def vote_check(spark, d):
    return view(spark, d, SLOTS).select("doc_id", quality.vote_check(F.col("vote"), F.col("label")).alias("reason"))


def _sense(spark, d, strict):
    return view(spark, d, SLOTS).withColumn("a", A.parsed(F.col("answer"), whole=True)).select("doc_id", quality.sense_check(F.col("a"), F.col("label"), strict).alias("reason"))


@query(with_slots(f"SELECT doc_id, {SENSE} AS reason FROM s"))
def sense_check_default(spark, d):
    return _sense(spark, d, False)


@query(with_slots(f"SELECT doc_id, {SENSE_STRICT} AS reason FROM s"))
def sense_check_strict(spark, d):
    return _sense(spark, d, True)


def _checked(spark, d):
    return quality.check_slots(view(spark, d, SLOTS), strict=True)


@query(f"WITH {CHECKED} SELECT doc_id, reason FROM c")
def rule_chain(spark, d):
    return _checked(spark, d).select("doc_id", "reason")


@query(f"WITH {CHECKED} SELECT reason, count(*) AS n FROM c WHERE reason IS NOT NULL GROUP BY reason")
def rule_counts(spark, d):
    return quality.count_reasons(_checked(spark, d))


def _judged(checked):
    """A stand-in for a judge: axes by id; some replies don't parse, some slots are past the limit."""
    raw = F.when(F.col("doc_id") % 7 == 3, "not json").otherwise(
        F.concat(F.lit('{"english": true, "coherent": true, "faithful": '), F.when(F.col("doc_id") % 4 != 1, "true").otherwise("false"), F.lit(', "consistent": true}'))
    )
    return checked.filter(F.col("reason").isNull() & (F.col("doc_id") % 11 != 5)).select("record", "slot", A.judge_scores(raw).alias("scores"))


VERDICT = """v AS (SELECT *, reason IS NULL AND doc_id % 11 <> 5 AND doc_id % 7 <> 3 AND doc_id % 4 <> 1 AS keep,
  CASE WHEN reason IS NOT NULL THEN reason WHEN doc_id % 11 = 5 THEN 'not_judged' WHEN doc_id % 7 = 3 THEN 'unparseable_verdict' ELSE 'judged' END AS final,
  CASE WHEN reason IS NULL THEN 'judge' ELSE 'rule' END AS stage FROM c)"""


def _verdicts(spark, d):
    checked = cut(_checked(spark, d).select("doc_id", "record", "slot", "reason"))  # the chain runs once, not on both sides of the join
    return checked, quality.final_verdicts(checked, _judged(checked), ["record", "slot"])


@query(f"WITH {CHECKED}, {VERDICT} SELECT record, slot, stage, keep, final AS reason FROM v")
def verdict_join(spark, d):
    return _verdicts(spark, d)[1].select("record", "slot", "stage", "keep", "reason")


@query(f"WITH {CHECKED}, {VERDICT} SELECT record, slot FROM v WHERE keep")
def keep_filter(spark, d):
    return _verdicts(spark, d)[1].filter("keep").select("record", "slot")


@query(f"WITH {CHECKED}, {VERDICT} SELECT record, count(*) FILTER (WHERE keep) AS n_good_reasonings, string_agg(final, ',' ORDER BY slot) AS reasons FROM v GROUP BY record")
def n_good(spark, d):
    checked, verdicts = _verdicts(spark, d)
    return quality.annotate(checked.select("record", "slot"), verdicts, ["record"]).select("record", F.col("n_good_reasonings").cast("bigint"), F.array_join("reasoning_quality.reason", ",").alias("reasons"))


@query(f"WITH {CHECKED}, {VERDICT}, p AS (SELECT record, list(slot ORDER BY slot) AS kept FROM v WHERE keep GROUP BY record) SELECT record, array_to_string(kept, ',') AS kept FROM p")
def pruned_records(spark, d):
    checked, verdicts = _verdicts(spark, d)
    slots = F.array_sort(F.collect_list(F.struct("slot", "keep")))
    return quality.prune_slots(verdicts.groupBy("record").agg(slots.alias("slots"))).select("record", F.array_join(F.transform("slots", lambda s: s["slot"].cast("string")), ",").alias("kept"))


@query(f"""WITH {CHECKED}, j AS (SELECT *, doc_id % 7 <> 3 AS ok FROM c WHERE reason IS NULL AND doc_id % 11 <> 5)
SELECT count(*) FILTER (WHERE doc_id < 0) AS failed_english, count(*) FILTER (WHERE doc_id < 0) AS failed_coherent, count(*) FILTER (WHERE ok AND doc_id % 4 = 1) AS failed_faithful,
 count(*) FILTER (WHERE doc_id < 0) AS failed_consistent, round(count(*) FILTER (WHERE ok AND doc_id % 4 <> 1) / count(*), 9) AS kept_rate FROM j""")
def axis_failures(spark, d):
    checked = cut(_checked(spark, d).select("doc_id", "record", "slot", "reason"))
    return quality.axis_failures(_judged(checked)).withColumn("kept_rate", F.round("kept_rate", 9))


REPLIES = """
SELECT doc_id, CASE doc_id % 12 WHEN 0 THEN NULL WHEN 1 THEN 'no object' WHEN 2 THEN '{"english": true, "coherent": true, "faithful": true, "consistent": true}'
  WHEN 3 THEN ' {"english": 1, "coherent": "yes", "faithful": [0], "consistent": {"a": null}, "note": "further keys are allowed"} ' WHEN 4 THEN '{"english": true, "coherent": true, "faithful": true}'
  WHEN 5 THEN '{"english": true, "coherent": true, "faithful": true, "consistent": true} and more' WHEN 6 THEN '[true]' WHEN 7 THEN '{"english": 0, "coherent": "", "faithful": [], "consistent": {}}'
  WHEN 8 THEN '{"english": null, "coherent": true, "faithful": true, "consistent": true}' WHEN 9 THEN '{"english": 0.0, "coherent": 2.5, "faithful": "false", "consistent": true}' WHEN 10 THEN '{"english": true,}' ELSE concat('{"english": "', lang, '", "coherent": 1, "faithful": 1, "consistent": 1}') END AS raw
FROM documents"""
_TRUE = """CASE json_type(j, '$.{0}') WHEN 'BOOLEAN' THEN (j->>'$.{0}') = 'true' WHEN 'VARCHAR' THEN (j->>'$.{0}') <> '' WHEN 'ARRAY' THEN json_array_length(j, '$.{0}') > 0 WHEN 'OBJECT' THEN len(json_keys(j, '$.{0}')) > 0
 WHEN 'NULL' THEN false ELSE coalesce((j->>'$.{0}')::DOUBLE <> 0, false) END"""


@query(f"""WITH r AS ({REPLIES}), t AS (SELECT doc_id, CASE WHEN json_valid(raw) AND raw LIKE '%{{%' AND raw NOT LIKE '%,}}' THEN raw::JSON END AS j FROM r)
SELECT doc_id, CASE WHEN j IS NULL THEN 'unparseable_verdict' ELSE 'judged' END AS reason, j IS NOT NULL AND {' AND '.join(_TRUE.format(a) for a in JUDGE_AXES)} AS keep FROM t""")
def judge_verdicts(spark, d):
    scored = view(spark, d, REPLIES).withColumn("scores", A.judge_scores(F.col("raw")))
    return scored.select("doc_id", F.when(F.col("scores").isNull(), "unparseable_verdict").otherwise("judged").alias("reason"), quality.keep_by_axes(F.col("scores")).alias("keep"))


@query(f"WITH {CHECKED} SELECT record, slot FROM c WHERE reason IS NULL AND doc_id % 11 = 5")
def checkpoint_anti(spark, d):
    checked = cut(_checked(spark, d).select("doc_id", "record", "slot", "reason"))
    return checked.filter("reason IS NULL").select("record", "slot").join(_judged(checked), ["record", "slot"], "left_anti")


RECORDS = """SELECT record, min(lemma) AS lemma, min(pos) AS pos, bool_or(label) AS label FROM s GROUP BY record"""


def _records(spark, d):
    slots = F.array_sort(F.collect_list(F.struct("slot", "answer", "reasoning", "vote")))
    rows = view(spark, d, SLOTS).groupBy("record").agg(slots.alias("s"), F.min("lemma").alias("lemma"), F.min("pos").alias("pos"), F.bool_or("label").alias("label"))
    rows = rows.withColumns({"answers": F.col("s.answer"), "reasonings": F.col("s.reasoning"), "votes": F.col("s.vote")}).drop("s")
    return rows.withColumn("_v", votes.vote(F.col("votes"))).select("*", "_v.prediction", "_v.confidence").drop("_v")


VOTED = f"""s AS ({SLOTS}), b AS (SELECT record, min(lemma) AS lemma, min(pos) AS pos, bool_or(label) AS label, count(*) FILTER (WHERE vote) AS t, count(*) FILTER (WHERE NOT vote) AS f FROM s GROUP BY record),
r AS (SELECT *, CASE WHEN t = f THEN NULL ELSE t > f END AS prediction, CASE WHEN t + f = 0 THEN 0.0 ELSE greatest(t, f) / (t + f) END AS confidence FROM b)"""


@query(f"WITH {VOTED} SELECT record, prediction, round(confidence, 9) AS confidence FROM r")
def vote(spark, d):
    return _records(spark, d).select("record", "prediction", F.round("confidence", 9).alias("confidence"))


@query("""WITH v AS (SELECT user_id, count(*) FILTER (WHERE value > 100) AS t, count(*) FILTER (WHERE NOT value > 100) AS f FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN t = f THEN NULL ELSE t > f END AS prediction, round(CASE WHEN t + f = 0 THEN 0.0 ELSE greatest(t, f) / (t + f) END, 9) AS confidence, t + f AS n_votes FROM v""")
def confidence(spark, d):
    rows = view(spark, d, "SELECT user_id, value > 100 AS ballot FROM events")
    return votes.vote_rows(rows, ["user_id"], F.col("ballot")).withColumn("confidence", F.round("confidence", 9))


METRICS = """count(*) FILTER (WHERE prediction IS NOT NULL AND label IS NOT NULL) AS n_scored, count(*) FILTER (WHERE prediction IS NULL OR label IS NULL) AS {skipped},
 count(*) FILTER (WHERE prediction AND label) AS tp, count(*) FILTER (WHERE prediction AND NOT label) AS fp, count(*) FILTER (WHERE NOT prediction AND label) AS fn, count(*) FILTER (WHERE NOT prediction AND NOT label) AS tn"""
RATIOS = """round(CASE WHEN n_scored = 0 THEN 0 ELSE (tp + tn) / n_scored END, 9) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 9) AS precision,
 round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 9) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 9) AS f1"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 9) for c in ("accuracy", "precision", "recall", "f1")})


@query(f"WITH p AS ({PREDICTIONS}), m AS (SELECT {METRICS.format(skipped='n_skipped')} FROM p) SELECT *, {RATIOS} FROM m")
def metrics(spark, d):
    return _rounded(votes.metrics(view(spark, d, PREDICTIONS)))


@query(f"WITH p AS ({PREDICTIONS}), m AS (SELECT coalesce(pos, '?') AS pos, {METRICS.format(skipped='n_skipped')} FROM p GROUP BY 1) SELECT *, {RATIOS} FROM m")
def metrics_by_pos(spark, d):
    return _rounded(votes.metrics_by_pos(view(spark, d, PREDICTIONS)))


#: In this adapter's completions the verdict follows from the kind of completion.
SAID = "CASE doc_id % 8 WHEN 0 THEN doc_id % 16 = 0 WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN false END"


@query(f"WITH c AS ({COMPLETIONS}), p AS (SELECT label, {SAID} AS prediction FROM c), m AS (SELECT {METRICS.format(skipped='empty')} FROM p) SELECT *, {RATIOS} FROM m")
def wic_metrics(spark, d):
    rows = view(spark, d, COMPLETIONS).withColumn("a", A.parsed(F.col("completion"))).select("label", A.verdict(F.col("completion"), F.col("a")).alias("prediction"))
    return _rounded(votes.verdict_metrics(rows))


@query(f"WITH {VOTED} SELECT record, label FROM r WHERE prediction = label")
def teacher_correct(spark, d):
    return traces.teacher_correct(_records(spark, d)).select("record", "label")


CANDIDATES = f"""{VOTED}, x AS (SELECT s.record, s.slot, {_strip("s.reasoning")} AS think, s.answer, r.label FROM s JOIN r ON s.record = r.record
 WHERE r.prediction = r.label AND s.answer LIKE '{{%' AND {_strip("s.reasoning")} <> '' AND (s.answer LIKE '%"same_sense": true}}') = r.prediction)"""


def _selected(spark, d, strategy):
    return traces.select_one(traces.candidates(traces.teacher_correct(_records(spark, d))), ["record"], strategy)


@query(f"WITH {CANDIDATES} SELECT record, slot, md5(think) AS think FROM x QUALIFY row_number() OVER (PARTITION BY record ORDER BY slot) = 1")
def select_first(spark, d):
    return _selected(spark, d, "first").select("record", F.col("slot").cast("int"), F.md5("think").alias("think"))


@query(f"WITH {CANDIDATES} SELECT record, slot, md5(think) AS think FROM x QUALIFY row_number() OVER (PARTITION BY record ORDER BY length(think) DESC, slot) = 1")
def select_longest(spark, d):
    return _selected(spark, d, "longest").select("record", F.col("slot").cast("int"), F.md5("think").alias("think"))


def _sft(spark, d):
    one = _selected(spark, d, "first")
    sentence = F.concat(F.lit("s"), F.col("record").cast("string"))
    return one.withColumns({"task": F.lit("wic"), "sentence1": sentence, "sentence2": F.lit("t"), "usage1": sentence, "usage2": F.lit("t")})


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SFT = f"{CANDIDATES}, f AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY record ORDER BY slot) = 1), t AS (SELECT f.*, r.lemma, r.pos, concat('s', f.record) AS s1 FROM f JOIN r ON f.record = r.record)"
USER = f"concat('Target word: ', lemma, ' (', pos, ')', chr(10), chr(10), 'Sentence 1: ', s1, chr(10), 'Sentence 2: t', chr(10), chr(10), {_q(STUDENT_TAIL)})"
ASSISTANT = """concat('<think>', chr(10), think, chr(10), '</think>', chr(10), '{"sense1": "', json_extract_string(answer, '$.sense1'), '", "sense2": "', json_extract_string(answer, '$.sense2'), '", "same_sense": ', CASE WHEN label THEN 'true' ELSE 'false' END, '}')"""


def _record(df):
    return {c: F.col(c) for c in ("lemma", "pos", "usage1", "usage2", "think", "sense1", "sense2", "label")}


@query(f"WITH {SFT} SELECT record, md5({_q(SYSTEM)}) AS system, md5({USER}) AS user_turn, md5({ASSISTANT}) AS assistant FROM t")
def chat_render(spark, d):
    rows = _sft(spark, d)
    turns = rows.select("record", traces.build_messages(F.col("task"), _record(rows), target=True).alias("m"))
    return turns.select("record", *[F.md5(F.get("m", i)["content"]).alias(n) for i, n in enumerate(("system", "user_turn", "assistant"))])


@query(f"WITH {SFT} SELECT record, 2::BIGINT AS n_prompt, 1::BIGINT AS n_completion, md5({ASSISTANT}) AS completion FROM t")
def prompt_completion(spark, d):
    rows = _sft(spark, d)
    made = rows.select("record", traces.prompt_completion(traces.messages(_record(rows), target=True)).alias("e"))
    return made.select(
        "record", F.size("e.prompt").cast("bigint").alias("n_prompt"), F.size("e.completion").cast("bigint").alias("n_completion"), F.md5(traces.completion_text(F.col("e.completion"))).alias("completion")
    )


HASH = "md5(concat_ws('|', '42', '{salt}', {key}))"


@query(f"""WITH l AS (SELECT doc_id, quality = 1 AS label FROM labels), k AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM l GROUP BY label)),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {HASH.format(salt='', key='doc_id::VARCHAR')}, doc_id) AS rank FROM l) SELECT doc_id, label FROM r WHERE rank <= (SELECT n FROM k)""")
def balance_labels(spark, d):
    return corpus.balance(view(spark, d, "SELECT doc_id, quality = 1 AS label FROM labels"), "label", ["doc_id"])


@query(f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {HASH.format(salt='split', key='doc_id::VARCHAR')}, doc_id) AS rank FROM documents)
SELECT doc_id, CASE WHEN rank <= greatest(1, floor((SELECT count(*) FROM documents) * 0.05)) THEN 'dev' ELSE 'train' END AS split FROM r""")
def split_dev(spark, d):
    return corpus.split(view(spark, d, "SELECT doc_id FROM documents"), ["doc_id"])


@query(f"SELECT doc_id FROM documents ORDER BY {HASH.format(salt='', key='doc_id::VARCHAR')}, doc_id LIMIT 100")
def sample_cap(spark, d):
    return corpus.capped(view(spark, d, "SELECT doc_id FROM documents"), 100, ["doc_id"])


@query(f"SELECT doc_id FROM documents ORDER BY {HASH.format(salt='', key='doc_id::VARCHAR')}, doc_id LIMIT 700")
def sample_cap_large(spark, d):
    return corpus.capped(view(spark, d, "SELECT doc_id FROM documents"), 700, ["doc_id"], few=100)


@query(f"WITH {SFT} SELECT lemma, pos, s1 AS sentence1, 't' AS sentence2 FROM t")
def sft_manifest(spark, d):
    return _sft(spark, d).filter(F.col("task") == "wic").select("lemma", "pos", "sentence1", "sentence2")


KEYS = "lemma, pos, sentence1, sentence2"
SAME_KEYS = " AND ".join(f"{{a}}.{k} IS NOT DISTINCT FROM {{b}}.{k}" for k in KEYS.split(", "))


def _corpora(spark, d):
    slots = F.array(F.struct(F.col("trace").alias("reasoning")))
    both = [view(spark, d, CORPUS + where).withColumn("slots", slots).drop("trace") for where in ("doc_id % 3 <> 2", "doc_id % 3 <> 0")]
    return [corpus.dedupe_last(x, "doc_id") for x in both]


DEDUPED = """{n} AS (SELECT lemma, pos, sentence1, sentence2, min(doc_id) AS doc_id, arg_max(label, doc_id) AS label, arg_max(trace, doc_id) AS trace FROM ({corpus}{where}) GROUP BY ALL)"""
BOTH = "WITH " + DEDUPED.format(n="a", corpus=CORPUS, where="doc_id % 3 <> 2").replace("GROUP BY ALL", f"GROUP BY {KEYS}") + ", " + DEDUPED.format(n="b", corpus=CORPUS, where="doc_id % 3 <> 0").replace("GROUP BY ALL", f"GROUP BY {KEYS}")
MERGED = f"""{BOTH}, m AS (SELECT {", ".join(f"coalesce(a.{k}, b.{k}) AS {k}" for k in KEYS.split(", "))}, coalesce(a.label, b.label) AS label, CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'base_only' ELSE '{{both}}' END AS status,
 CASE WHEN a.doc_id IS NULL THEN b.trace WHEN b.doc_id IS NULL OR '{{both}}' = 'kept_base' THEN a.trace ELSE concat(a.trace, ',', b.trace) END AS traces FROM a FULL JOIN b ON {SAME_KEYS.format(a="a", b="b")})"""


def _merged(spark, d, prefer):
    return corpus.merge(*_corpora(spark, d), prefer)


@query(MERGED.format(both="kept_base") + f" SELECT {KEYS}, label, status, traces FROM m")
def merge_teacher(spark, d):
    return _merged(spark, d, "base").select("lemma", "pos", "sentence1", "sentence2", "label", "status", F.array_join("slots.reasoning", ",").alias("traces"))


@query(MERGED.format(both="merged") + f" SELECT {KEYS}, label, status, traces FROM m")
def merge_both(spark, d):
    return _merged(spark, d, "both").select("lemma", "pos", "sentence1", "sentence2", "label", "status", F.array_join("slots.reasoning", ",").alias("traces"))


@query(MERGED.format(both="merged") + " SELECT status, count(*) AS n, round(count(*) FILTER (WHERE label) / count(label), 9) AS label_share FROM m GROUP BY status")
def merge_stats(spark, d):
    return corpus.merge_stats(_merged(spark, d, "both")).withColumn("label_share", F.round("label_share", 9))


@query(f"{BOTH} SELECT {KEYS} FROM a ANTI JOIN (SELECT * FROM b WHERE doc_id % 4 <> 1) AS m ON {SAME_KEYS.format(a='a', b='m')}")
def exclude_pairs(spark, d):
    a, b = _corpora(spark, d)
    return corpus.exclude(a, b.filter("doc_id % 4 <> 1")).select("lemma", "pos", "sentence1", "sentence2")


@query(f"{BOTH}, g AS (SELECT * FROM b WHERE doc_id % 5 <> 0) SELECT {KEYS}, 'done' AS state FROM g SEMI JOIN a ON {SAME_KEYS.format(a='g', b='a')} UNION ALL SELECT {KEYS}, 'todo' FROM a ANTI JOIN g ON {SAME_KEYS.format(a='a', b='g')}")
def resume_left(spark, d):
    a, b = _corpora(spark, d)
    finished = b.withColumn("error", F.when(F.col("doc_id") % 5 == 0, "failed"))
    done, todo = corpus.resume(a, finished, "doc_id")
    keys = ["lemma", "pos", "sentence1", "sentence2"]
    return done.select(*keys, F.lit("done").alias("state")).unionByName(todo.select(*keys, F.lit("todo").alias("state")))


ANNOTATIONS = """SELECT doc_id, text, source AS lemma, CASE doc_id % 10 WHEN 0 THEN 'ADP' WHEN 1 THEN 'VERB' ELSE 'NOUN' END AS pos, 0 AS start, 2 AS "end", concat(source, '.', lang) AS synset FROM documents"""
USABLE = f"""a AS ({ANNOTATIONS}), u AS (SELECT doc_id, text, lemma, CASE pos WHEN 'VERB' THEN 'verb' ELSE 'noun' END AS pos, start, "end", synset FROM a
 WHERE pos <> 'ADP' AND doc_id % 19 <> 0 AND len(list_filter(regexp_split_to_array(text, '{_SP}+'), lambda x: x <> '')) >= 5)"""
HELD = "upper(source) AS lemma FROM documents WHERE doc_id % 20 IN (3, 4)"


def _annotations(spark, d):
    rows = view(spark, d, ANNOTATIONS.replace('"end"', "`end`"))
    return rows.withColumn("synsets", F.when(F.col("doc_id") % 19 == 0, F.array("synset", "synset")).otherwise(F.array("synset"))).drop("synset")


def _usages(spark, d):
    return pairs.usable_annotations(_annotations(spark, d))


@query(f"WITH {USABLE} SELECT doc_id, lemma, pos, synset FROM u")
def usable_filter(spark, d):
    return _usages(spark, d).select("doc_id", "lemma", "pos", "synset")


@query(f"WITH {USABLE}, h AS (SELECT DISTINCT lower(lemma) AS lemma FROM (SELECT {HELD})) SELECT doc_id, lemma FROM u WHERE lower(lemma) NOT IN (SELECT lemma FROM h)")
def held_out_anti(spark, d):
    return pairs.hold_out(_usages(spark, d), view(spark, d, "SELECT " + HELD)).select("doc_id", "lemma")


_UK = "lemma, pos, synset, text, start::VARCHAR"
ORDERED = """o{n} AS (SELECT *, row_number() OVER (PARTITION BY lemma, pos, synset ORDER BY """ + HASH.format(salt="{salt}", key=_UK) + """, text, start) AS n FROM u)"""
SAME = f"""{ORDERED.format(n=1, salt='same')}, g AS (SELECT lemma, pos, synset, CAST(floor((n - 1) / 2) AS BIGINT) AS pair, max(text) FILTER (WHERE n % 2 = 1) AS t1, max(text) FILTER (WHERE n % 2 = 0) AS t2 FROM o1 WHERE n <= 8 GROUP BY ALL),
same AS (SELECT lemma, pos, synset, synset AS synset2, t1, t2 FROM g WHERE t2 IS NOT NULL AND t1 <> t2 QUALIFY row_number() OVER (PARTITION BY lemma, pos ORDER BY {HASH.format(salt='cap', key='lemma, pos, synset, pair::VARCHAR')}, synset, pair) <= 4)"""
DIFF = f"""{ORDERED.format(n=2, salt='different')}, e AS (SELECT DISTINCT lemma, pos, synset FROM u),
p AS (SELECT a.lemma, a.pos, a.synset AS s1, b.synset AS s2 FROM e a JOIN e b ON a.lemma = b.lemma AND a.pos = b.pos AND a.synset < b.synset QUALIFY row_number() OVER (PARTITION BY a.lemma, a.pos ORDER BY a.synset, b.synset) <= 4),
diff AS (SELECT p.lemma, p.pos, s1 AS synset, s2 AS synset2, x.text AS t1, y.text AS t2 FROM p JOIN o2 x ON x.lemma = p.lemma AND x.pos = p.pos AND x.synset = s1 AND x.n = 1 JOIN o2 y ON y.lemma = p.lemma AND y.pos = p.pos AND y.synset = s2 AND y.n = 1 WHERE x.text <> y.text)"""


def _shown(df):
    return df.select("lemma", "pos", "synset1", "synset2", F.md5("u1.text").alias("text1"), F.md5("u2.text").alias("text2"))


@query(f"WITH {USABLE}, {SAME} SELECT lemma, pos, synset AS synset1, synset2, md5(t1) AS text1, md5(t2) AS text2 FROM same")
def same_pairs(spark, d):
    return _shown(pairs.same_pairs(_usages(spark, d)))


@query(f"WITH {USABLE}, {DIFF} SELECT lemma, pos, synset AS synset1, synset2, md5(t1) AS text1, md5(t2) AS text2 FROM diff")
def diff_pairs(spark, d):
    return _shown(pairs.different_pairs(_usages(spark, d)))


SENSE_TABLE = "SELECT DISTINCT source AS lemma, 'noun' AS pos, concat(source, '.', lang) AS synset_id, concat('sense of ', source, ' in ', lang) AS definition FROM documents"


@query(f"""WITH {USABLE}, {SAME}, {DIFF}, z AS (SELECT *, true AS label FROM same UNION ALL SELECT *, false FROM diff), k AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM z GROUP BY label)),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {HASH.format(salt='', key='lemma, pos, synset, synset2, t1, t2')}, lemma, pos, synset, synset2, t1, t2) AS rank FROM z)
SELECT lemma, pos, label, md5(concat('<t> ', substr(t1, 1, 2), ' </t>', substr(t1, 3))) AS usage1, concat('sense of ', lemma, ' in ', split_part(synset, '.', 2)) AS gloss1, concat('sense of ', lemma, ' in ', split_part(synset2, '.', 2)) AS gloss2 FROM r WHERE rank <= (SELECT n FROM k)""")
def build_pairs_balanced(spark, d):
    table = view(spark, d, SENSE_TABLE).withColumn("rank", F.lit(1))
    senses = table.groupBy("lemma", "pos").agg(F.array_sort(F.collect_set("definition")).alias("senses"))
    made = pairs.build(_annotations(spark, d), table, senses)
    return made.select("lemma", "pos", "label", F.md5("usage1").alias("usage1"), "gloss1", "gloss2")


@query(f"""WITH {USABLE}, {SAME}, {DIFF}, z AS (SELECT lemma, pos, synset, synset2 FROM same UNION ALL SELECT lemma, pos, synset, synset2 FROM diff),
i AS (SELECT lemma, 'noun' AS pos, count(DISTINCT concat('sense of ', lemma, ' in ', l)) AS k FROM (SELECT source AS lemma, lang AS l FROM documents) GROUP BY lemma),
q AS (SELECT z.*, coalesce(i.k, 0) AS base, CASE WHEN synset = synset2 THEN 1 ELSE 2 END AS own FROM z LEFT JOIN i ON z.lemma = i.lemma AND z.pos = i.pos),
w AS (SELECT *, CASE WHEN base > 0 THEN base ELSE own END AS k FROM q)
SELECT count(*) AS n, round(count(*) FILTER (WHERE synset = synset2) / count(*), 9) AS same_share, round(count(*) FILTER (WHERE k > 1) / count(*), 9) AS scoreable_share, round(avg(k), 9) AS mean_senses, max(k)::INT AS most_senses FROM w""")
def pair_coverage(spark, d):
    table = view(spark, d, SENSE_TABLE).withColumn("rank", F.lit(1))
    senses = table.groupBy("lemma", "pos").agg(F.array_sort(F.collect_set("definition")).alias("senses"))
    got = pairs.coverage(pairs.build(_annotations(spark, d), table, senses, balanced=False))
    return got.withColumns({c: F.round(c, 9) for c in ("same_share", "scoreable_share", "mean_senses")})


CLOSE_SENSES = """
SELECT DISTINCT concat(source, '.en') AS s1, concat(source, '.fr') AS s2, 'siblings' AS level FROM documents UNION ALL SELECT DISTINCT concat(source, '.de') AS s1, concat(source, '.es') AS s2, 'far' AS level FROM documents"""


@query(f"""WITH {USABLE}, {SAME}, {DIFF}, z AS (SELECT lemma, pos, synset, synset2 FROM same UNION ALL SELECT lemma, pos, synset, synset2 FROM diff), c AS ({CLOSE_SENSES}),
i AS (SELECT lemma, 'noun' AS pos, count(DISTINCT concat('sense of ', lemma, ' in ', l)) AS k FROM (SELECT source AS lemma, lang AS l FROM documents) GROUP BY lemma),
q AS (SELECT z.*, CASE WHEN synset = synset2 THEN 'same' ELSE coalesce(c.level, 'unresolved') END AS level, coalesce(i.k, 0) AS base, CASE WHEN synset = synset2 THEN 1 ELSE 2 END AS own FROM z LEFT JOIN i ON z.lemma = i.lemma AND z.pos = i.pos LEFT JOIN c ON c.s1 = synset AND c.s2 = synset2),
w AS (SELECT pos, (synset = synset2)::VARCHAR AS label, level, synset = synset2 AS same, CASE WHEN base > 0 THEN base ELSE own END AS k FROM q)
SELECT CASE WHEN grouping(pos) = 0 THEN 'pos' WHEN grouping(label) = 0 THEN 'label' WHEN grouping(level) = 0 THEN 'level' ELSE 'all' END AS part, coalesce(pos, label, level, '') AS value, count(*) AS n, round(count(*) FILTER (WHERE same) / count(*), 9) AS same_share,
 round(count(*) FILTER (WHERE k > 1) / count(*), 9) AS scoreable_share, round(avg(k), 9) AS mean_senses, max(k)::INT AS most_senses FROM w GROUP BY GROUPING SETS ((), (pos), (label), (level)) HAVING grouping(level) = 1 OR level <> 'same'""")
def coverage_report(spark, d):
    table = view(spark, d, SENSE_TABLE).withColumn("rank", F.lit(1))
    senses = table.groupBy("lemma", "pos").agg(F.array_sort(F.collect_set("definition")).alias("senses"))
    got = pairs.coverage_report(pairs.build(_annotations(spark, d), table, senses, balanced=False), view(spark, d, CLOSE_SENSES))
    return got.withColumns({c: F.round(c, 9) for c in ("same_share", "scoreable_share", "mean_senses")})


#: A taxonomy over the parts: keys in base three hang under their quotient, in two trees, with second hypernyms here and there.
TAXONOMY = """
SELECT DISTINCT n AS synset_id, h AS hypernym_id FROM (
  SELECT p_partkey AS n, CAST(floor(p_partkey / 3.0) AS BIGINT) AS h FROM part WHERE p_partkey >= 6
  UNION ALL SELECT p_partkey, CAST(floor(p_partkey / 9.0) AS BIGINT) FROM part WHERE p_partkey >= 54 AND p_partkey % 4 = 0
  UNION ALL SELECT p_partkey, p_partkey % 2 FROM part WHERE p_partkey BETWEEN 2 AND 5) AS t"""
CLOSE_PAIRS = "SELECT p_partkey AS s1, p_partkey + CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 30 ELSE 7 END AS s2 FROM part WHERE p_partkey >= 2 AND p_partkey % 50 < 40"
TAXONOMY_POS = "SELECT p_partkey AS synset_id, CASE WHEN p_partkey % 11 = 3 THEN 'verb' ELSE 'noun' END AS pos FROM part WHERE p_partkey >= 2"


@query(f"""WITH RECURSIVE e AS ({TAXONOMY}), p AS ({CLOSE_PAIRS}), q AS ({TAXONOMY_POS}),
up(s, a, k) AS (SELECT synset_id, synset_id, 0 FROM e UNION SELECT hypernym_id, hypernym_id, 0 FROM e UNION SELECT up.s, e.hypernym_id, up.k + 1 FROM up JOIN e ON up.a = e.synset_id),
near AS (SELECT s, a, min(k) AS k FROM up GROUP BY s, a), deep AS (SELECT s, max(k) AS h FROM up GROUP BY s),
c AS (SELECT p.s1, p.s2, min(x.k + y.k) AS distance, arg_min([x.k, y.k], [-d.h, x.a]) AS low FROM p JOIN near x ON x.s = p.s1 JOIN near y ON y.s = p.s2 AND y.a = x.a JOIN deep d ON d.s = x.a GROUP BY p.s1, p.s2)
SELECT p.s1, p.s2, CASE WHEN a.pos IS NULL OR b.pos IS NULL THEN NULL WHEN a.pos <> b.pos THEN 'cross-pos' WHEN c.low IS NULL THEN 'unrelated' WHEN c.low = [1, 1] THEN 'siblings' WHEN c.distance <= 4 THEN 'near' ELSE 'far' END AS level
FROM p LEFT JOIN q a ON a.synset_id = p.s1 LEFT JOIN q b ON b.synset_id = p.s2 LEFT JOIN c ON c.s1 = p.s1 AND c.s2 = p.s2""")
def confusability(spark, d):
    edges = cut(view(spark, d, TAXONOMY))
    return lexicon.confusability(view(spark, d, CLOSE_PAIRS), lexicon.ancestors(edges), view(spark, d, TAXONOMY_POS), lexicon.depths(edges))


@query("SELECT doc_id, md5(concat(substr(text, 1, 3), '<t> ', substr(text, 4, 6), ' </t>', substr(text, 10))) AS marked FROM documents")
def mark_exact(spark, d):
    rows = view(spark, d, "SELECT doc_id, text FROM documents")
    return rows.select("doc_id", F.md5(T.mark_span(F.col("text"), F.lit(3), F.lit(9))).alias("marked"))


@query("""WITH m AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN 'THE' ELSE 'of' END AS word FROM documents),
p AS (SELECT *, CASE WHEN strpos(text, word) > 0 THEN strpos(text, word) ELSE strpos(lower(text), lower(word)) END AS a FROM m)
SELECT doc_id, md5(CASE WHEN a > 0 THEN concat(substr(text, 1, a - 1), '<t>', substr(text, a, length(word)), '</t>', substr(text, a + length(word))) ELSE text END) AS marked FROM p""")
def mark_safe(spark, d):
    rows = view(spark, d, "SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN 'THE' ELSE 'of' END AS word FROM documents")
    return rows.select("doc_id", F.md5(T.mark_safe(F.col("word"), F.col("text"))).alias("marked"))


@query(f"SELECT doc_id, md5(concat(regexp_replace(concat(' ', substr(text, 1, 0), 'x of ofs ', text), '(?i)([^\\p{{L}}\\p{{N}}_])(of{_W}*)', '\\1<t> \\2 </t>'))) AS marked FROM documents")
def mark_target(spark, d):
    rows = view(spark, d, "SELECT doc_id, concat(' x of ofs ', text) AS text FROM documents")
    return rows.select("doc_id", F.md5(T.mark_target(F.col("text"), F.lit("of"))).alias("marked"))


@query(f"SELECT doc_id, len({TOK.format('text')}) AS n, md5(array_to_string({TOK.format('text')}, ' ')) AS tokens FROM documents")
def tokenise(spark, d):
    rows = view(spark, d, "SELECT doc_id, text FROM documents").withColumn("t", T.tokens(F.col("text")))
    return rows.select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens"))


@query(f"WITH g AS ({GLOSSES}) SELECT p_partkey, round({_duck_f1(_duck_set('definition'), _duck_set('filler_gloss'))}, 9) AS f1 FROM g")
def token_f1_a(spark, d):
    return view(spark, d, GLOSSES).select("p_partkey", F.round(T.gloss_f1(F.col("definition"), F.col("filler_gloss")), 9).alias("f1"))


@query(f"WITH g AS ({GLOSSES}) SELECT p_partkey, round({_duck_f1(_duck_set('definition', STOP_LONG), _duck_set('gloss', STOP_LONG), '0.0')}, 9) AS f1 FROM g")
def token_f1_b(spark, d):
    a, b = (T.content_set(F.col(c), T.STOPLIST) for c in ("definition", "gloss"))
    return view(spark, d, GLOSSES).select("p_partkey", F.round(T.set_f1_strict(a, b), 9).alias("f1"))


@query(f"SELECT doc_id, len(list_filter({TOK.format('text')}, lambda x: NOT list_contains({STOP_LONG}, x))) AS n FROM documents")
def content_words(spark, d):
    return view(spark, d, "SELECT doc_id, text FROM documents").select("doc_id", T.content_count(F.col("text"), T.STOPLIST).cast("bigint").alias("n"))


SNAP = f"""g AS ({GLOSSES}), l AS ({LEXICON}), j AS (SELECT g.p_partkey, l.rank, l.synset_id, {_duck_f1(_duck_set('g.filler_gloss'), _duck_set('l.definition'))} AS f FROM g JOIN l ON g.lemma = l.lemma AND g.pos = l.pos)"""


@query(f"WITH {SNAP} SELECT p_partkey, synset_id, round(f, 9) AS score, count(*) OVER (PARTITION BY p_partkey) AS n_synsets FROM j QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY f DESC, rank) = 1")
def snap(spark, d):
    rows = view(spark, d, GLOSSES).select("p_partkey", "lemma", "pos", F.col("filler_gloss").alias("gloss"))
    return lexicon.snap(rows, view(spark, d, LEXICON), ["p_partkey"]).withColumn("score", F.round("score", 9))


CHECK = f"""g AS ({GLOSSES}), l AS ({LEXICON}), s AS (SELECT p_partkey, lemma, pos, label, definition AS sense1, gloss AS sense2 FROM g),
b AS (SELECT p_partkey, 1 AS side, lemma, pos, sense1 AS x FROM s WHERE sense2 <> '' UNION ALL SELECT p_partkey, 2, lemma, pos, sense2 FROM s WHERE sense2 <> ''),
j AS (SELECT b.p_partkey, b.side, l.rank, l.synset_id, {_duck_f1(_duck_set('b.x'), _duck_set('l.definition'))} AS f FROM b JOIN l ON b.lemma = l.lemma AND b.pos = l.pos),
k AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY p_partkey, side ORDER BY f DESC, rank) = 1),
w AS (SELECT p_partkey, max(synset_id) FILTER (WHERE side = 1) AS y1, max(synset_id) FILTER (WHERE side = 2) AS y2, min(f) AS anchored FROM k GROUP BY p_partkey)"""


@query(f"WITH {CHECK} SELECT s.p_partkey, round(w.anchored, 9) AS anchored, CASE WHEN w.y1 IS NULL THEN NULL WHEN w.anchored < 0.05 THEN 'gloss_unanchored' WHEN w.y1 = w.y2 AND NOT s.label THEN 'wn_merged_diff_label' WHEN w.y1 <> w.y2 AND s.label THEN 'wn_split_same_label' END AS reason FROM s LEFT JOIN w USING (p_partkey)")
def gloss_check(spark, d):
    rows = view(spark, d, GLOSSES).select("p_partkey", "lemma", "pos", "label", F.col("definition").alias("sense1"), F.col("gloss").alias("sense2"))
    table = view(spark, d, LEXICON).withColumn("lemma", F.lower(T.lemma_key(F.col("lemma"))))
    return lexicon.check_glosses(rows, table, ["p_partkey"], min_anchor=0.05, strict=True).select("p_partkey", F.round("anchored", 9).alias("anchored"), "reason")


@query(f"""WITH g AS ({GLOSSES}), o AS (SELECT lemma, pos, definition AS d, min(p_partkey) AS seen FROM g GROUP BY 1, 2, 3), j AS (SELECT g.p_partkey, g.definition, o.d, o.seen, {_duck_f1(_duck_set('g.gloss'), _duck_set('o.d'))} AS f FROM g JOIN o ON g.lemma = o.lemma AND g.pos = o.pos WHERE g.gloss <> ''),
c AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY f DESC, seen) = 1) SELECT count(*) AS n, round(avg((d = definition)::INT), 9) AS accuracy FROM c""")
def sense_accuracy(spark, d):
    return evaluate.sense_accuracy(view(spark, d, GLOSSES), ["p_partkey"], "p_partkey").withColumn("accuracy", F.round("accuracy", 9))


VECTORS = """
SELECT t.text, e.embedding FROM (SELECT u.text, (length(u.text) * 31 + ascii(substr(u.text, 3, 1)) * 17 + ascii(substr(u.text, 8, 1)) * 5) % k.n AS vec_id
  FROM (SELECT p_name AS text FROM part UNION SELECT p_type AS text FROM part) u CROSS JOIN (SELECT count(*) AS n FROM embeddings) k) t JOIN embeddings e ON e.vec_id = t.vec_id"""
_COS = "round(list_inner_product({0}::DOUBLE[], {1}::DOUBLE[]) / sqrt(list_inner_product({0}::DOUBLE[], {0}::DOUBLE[]) * list_inner_product({1}::DOUBLE[], {1}::DOUBLE[])), 9)"


@query(f"""WITH g AS ({GLOSSES}), v AS ({VECTORS}), o AS (SELECT lemma, pos, definition AS d, min(p_partkey) AS seen FROM g GROUP BY 1, 2, 3),
j AS (SELECT g.p_partkey, g.definition, o.d, o.seen, {_COS.format('a.embedding', 'b.embedding')} AS f FROM g JOIN o ON g.lemma = o.lemma AND g.pos = o.pos JOIN v a ON a.text = g.gloss JOIN v b ON b.text = o.d WHERE g.gloss <> ''),
c AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY f DESC, seen) = 1) SELECT p_partkey, d = definition AS sense_correct FROM c""")
def sense_choice_vectors(spark, d):
    return evaluate.sense_choice(view(spark, d, GLOSSES), ["p_partkey"], "p_partkey", view(spark, d, VECTORS))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _letter_encoder():
    return lambda texts: np.array([[t.count(c) for c in _LETTERS] for t in texts])


@query(f"""WITH g AS ({GLOSSES}), n AS (SELECT p_partkey, list_transform(string_split('{_LETTERS}', ''), lambda c: length(gloss) - length(replace(gloss, c, ''))) AS a, list_transform(string_split('{_LETTERS}', ''), lambda c: length(definition) - length(replace(definition, c, ''))) AS b
FROM g WHERE gloss <> '') SELECT p_partkey, CASE WHEN list_sum(a) > 0 AND list_sum(b) > 0 THEN {_COS.format('a', 'b')} END AS cos FROM n""")
def encoded_cosine(spark, d):
    rows = view(spark, d, GLOSSES).filter("gloss <> ''")
    vectors = cut(choice.encode_distinct(rows, ["gloss", "definition"], _letter_encoder))
    return evaluate.own_cosine(rows, vectors).select("p_partkey", F.round("cos", 9).alias("cos"))


SCORED = f"""g AS ({GLOSSES}), z AS (SELECT *, CASE WHEN gloss <> '' THEN {_duck_f1(_duck_set('definition'), _duck_set('gloss'))} END AS f1, CASE WHEN gloss <> '' THEN {_duck_f1(_duck_set('gloss'), _duck_set('filler_gloss'))} END AS ff,
 {_duck_f1(_duck_set('definition'), _duck_set('filler_gloss'))} < 0.4 AS may FROM g)"""


@query(f"WITH {SCORED} SELECT round(coalesce(avg((ff >= 0.8)::INT) FILTER (WHERE may AND ff IS NOT NULL), 'nan'::DOUBLE), 9) AS echo_rate FROM z")
def filler_echo(spark, d):
    return evaluate.echo_rate(evaluate.score_rows(view(spark, d, GLOSSES))).withColumn("echo_rate", F.round("echo_rate", 9))


def _ngrams(items: str, n: int) -> str:
    return f"list_transform(range(1, len({items}) - {n - 2}), lambda i: array_to_string({items}[i:i + {n - 1}], ' '))"


def _matches(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda g: least(len(list_filter({a}, lambda x: x = g)), len(list_filter({b}, lambda x: x = g))))), 0)"


def _sql_bleu(m: list[str], t: list[str], c: str, r: str) -> str:
    halved = [" + ".join(f"(CASE WHEN {t[j]} > 0 AND {m[j]} = 0 THEN 1 ELSE 0 END)" for j in range(k + 1)) for k in range(4)]
    logs = " + ".join(f"(CASE WHEN {t[k]} <= 0 THEN 0 WHEN {m[k]} > 0 THEN ln({m[k]}::DOUBLE / {t[k]}) ELSE -ln(power(2, {halved[k]}) * {t[k]}) END)" for k in range(4))
    orders = " + ".join(f"(CASE WHEN {x} > 0 THEN 1 ELSE 0 END)" for x in t)
    return f"(CASE WHEN {' + '.join(m)} = 0 THEN 0.0 ELSE 100 * exp(({logs}) / ({orders}) + least(0, 1 - {r}::DOUBLE / {c})) END)"


#: Words of this adapter's glosses are lower-case letters between single spaces, so that splitting at spaces tokenises them.
GRAMS = f"""x AS (SELECT *, string_split({{h}}, ' ') AS h, string_split(definition, ' ') AS r FROM g WHERE {{h}} <> ''),
y AS (SELECT *, {", ".join(f"{_ngrams('h', n)} AS h{n}, {_ngrams('r', n)} AS r{n}" for n in range(1, 5))} FROM x),
b AS (SELECT *, {", ".join(f"{_matches(f'h{n}', f'r{n}')}::BIGINT AS m{n}, len(h{n})::BIGINT AS t{n}" for n in range(1, 5))}, len(h)::BIGINT AS c, len(r)::BIGINT AS rr FROM y)"""
_M, _T = [f"m{n}" for n in range(1, 5)], [f"t{n}" for n in range(1, 5)]
CHRF = f"""x AS (SELECT *, string_split(replace({{h}}, ' ', ''), '') AS h, string_split(replace(definition, ' ', ''), '') AS r FROM g),
y AS (SELECT *, {", ".join(f"{_ngrams('h', n)} AS h{n}, {_ngrams('r', n)} AS r{n}" for n in range(1, 7))} FROM x),
o AS (SELECT *, {", ".join(f"CASE WHEN len(h{n}) > 0 AND len(r{n}) > 0 THEN {_matches(f'h{n}', f'r{n}')}::DOUBLE ELSE 0 END AS m{n}" for n in range(1, 7))}, {" + ".join(f"(CASE WHEN len(h{n}) > 0 AND len(r{n}) > 0 THEN 1 ELSE 0 END)" for n in range(1, 7))} AS k FROM y),
f AS (SELECT *, ({" + ".join(f"m{n} / greatest(len(h{n}), 1)" for n in range(1, 7))}) / greatest(k, 1) AS p, ({" + ".join(f"m{n} / greatest(len(r{n}), 1)" for n in range(1, 7))}) / greatest(k, 1) AS q FROM o),
z AS (SELECT *, CASE WHEN p > 0 AND {{h}} <> '' THEN 500 * p * q / (4 * p + q) ELSE 0 END AS chrf FROM f)"""
CASED = GLOSSES.replace("p_type ELSE", "lower(p_type) ELSE").replace("concat(p_type, ' money", "concat(lower(p_type), ' money").replace("ELSE p_type END AS gloss", "ELSE lower(p_type) END AS gloss")


@query(f"WITH g AS ({CASED}), {GRAMS.format(h='filler_gloss')} SELECT p_partkey, round({_sql_bleu(_M, _T, 'c', 'rr')}, 9) AS bleu FROM b")
def gloss_bleu_rows(spark, d):
    rows = spread(view(spark, d, CASED).filter("filler_gloss <> ''"))
    return rows.select("p_partkey", F.round(evaluate.sentence_bleu(F.col("filler_gloss"), F.col("definition")), 9).alias("bleu"))


TOTALS = ", ".join(f"sum({x})::BIGINT AS {x}" for x in [*_M, *_T, "c", "rr"])


@query(f"WITH g AS ({CASED}), {GRAMS.format(h='filler_gloss')}, s AS (SELECT {TOTALS} FROM b) SELECT round({_sql_bleu(_M, _T, 'c', 'rr')}, 9) AS bleu FROM s")
def gloss_bleu(spark, d):
    return evaluate.corpus_bleu(view(spark, d, CASED).filter("filler_gloss <> ''"), "filler_gloss", "definition").select(F.round("bleu", 9).alias("bleu"))


@query(f"WITH g AS ({CASED}), {CHRF.format(h='filler_gloss')} SELECT p_partkey, round(chrf, 9) AS chrf FROM z")
def gloss_chrf(spark, d):
    return spread(view(spark, d, CASED)).select("p_partkey", F.round(evaluate.chrf(F.col("filler_gloss"), F.col("definition")), 9).alias("chrf"))


@query(f"""WITH g AS ({CASED}), {GRAMS.format(h='gloss')}, rows_ AS (SELECT p_partkey, {_sql_bleu(_M, _T, 'c', 'rr')} AS bleu FROM b), s AS (SELECT {TOTALS} FROM b),
ch AS (WITH {CHRF.format(h='gloss')} SELECT p_partkey, chrf FROM z WHERE gloss <> ''),
z0 AS (SELECT *, CASE WHEN gloss <> '' THEN {_duck_f1(_duck_set('definition'), _duck_set('gloss'))} END AS f1, CASE WHEN gloss <> '' THEN {_duck_f1(_duck_set('gloss'), _duck_set('filler_gloss'))} END AS ff,
 {_duck_f1(_duck_set('definition'), _duck_set('filler_gloss'))} < 0.4 AS may, len({_duck_set('gloss')}) AS lg, len({_duck_set('definition')}) AS ld FROM g),
o AS (SELECT lemma, pos, definition AS d, min(p_partkey) AS seen FROM g GROUP BY 1, 2, 3), o2 AS (SELECT * FROM o QUALIFY count(*) OVER (PARTITION BY lemma, pos) >= 2),
j AS (SELECT g.p_partkey, g.definition, o2.d, o2.seen, {_duck_f1(_duck_set('g.gloss'), _duck_set('o2.d'))} AS f FROM g JOIN o2 ON g.lemma = o2.lemma AND g.pos = o2.pos WHERE g.gloss <> ''),
w AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY f DESC, seen) = 1)
SELECT count(*) AS n, count(f1) AS n_scored, count(*) - count(f1) AS empty, round(avg(f1), 9) AS f1, (SELECT round(avg(bleu), 9) FROM rows_) AS bleu, (SELECT round(avg(chrf), 9) FROM ch) AS chrf,
 round(avg(lg) FILTER (WHERE gloss <> ''), 9) AS len_gloss, round(avg(ld) FILTER (WHERE gloss <> ''), 9) AS len_gold, round(avg(ff), 9) AS filler_f1, round(avg((ff >= 0.8)::INT) FILTER (WHERE may AND gloss <> ''), 9) AS filler_echo_rate,
 count(*) FILTER (WHERE may AND gloss <> '') AS n_echo_scored, (SELECT round({_sql_bleu(_M, _T, 'c', 'rr')}, 9) FROM s) AS bleu_corpus, (SELECT round(avg((d = definition)::INT), 9) FROM w) AS sense_acc, (SELECT count(*) FROM w) AS n_sense_scored FROM z0""")
def gloss_summary(spark, d):
    got = evaluate.full_summary(view(spark, d, CASED), ["p_partkey"], "p_partkey").drop("cos")
    return got.withColumns({c: F.round(c, 9) for c, kind in got.dtypes if kind == "double"})


@query("SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 9) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark, d):
    rows = view(spark, d, "SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
    return rows.select("vec_id", F.round(evaluate.cosine(F.col("x"), F.col("y")), 9).alias("cosine"))


BODIES = """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN concat('{"a": ', CAST(doc_id AS VARCHAR(20)), '}') WHEN 1 THEN concat('so {"a": {"b": ', CAST(doc_id AS VARCHAR(20)), '}} it is') WHEN 2 THEN concat(' ```json {"a": 1} ``` ')
  WHEN 3 THEN '```no object```' WHEN 4 THEN '} none {' ELSE '' END AS body FROM documents"""


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN concat('{"a": ', doc_id, '}') WHEN 1 THEN concat('{"a": {"b": ', doc_id, '}}') WHEN 2 THEN '{"a": 1}' WHEN 3 THEN 'no object' WHEN 4 THEN '} none {' ELSE '' END AS object FROM documents""")
def extract_object(spark, d):
    return view(spark, d, BODIES).select("doc_id", A.extract_object(F.col("body")).alias("object"))


_WORDS = f"list_filter(regexp_split_to_array(text, '{_SP}+'), lambda x: x <> '')"


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), g AS (SELECT doc_id, {_ngrams('w', 3)} AS g FROM w)
SELECT doc_id, round(CASE WHEN len(g) = 0 THEN 0 ELSE -0.2 * (1 - len(list_distinct(g)) / len(g)) END, 9)::DOUBLE AS penalty FROM g""")
def repetition_penalty(spark, d):
    return view(spark, d, "SELECT doc_id, text FROM documents").select("doc_id", F.round(rewards.repetition(F.col("text")), 9).alias("penalty"))


@query("SELECT doc_id, round(0.2 * CASE WHEN n_chars <= 1500 THEN 0 WHEN n_chars > 2000 THEN -1 ELSE (1500 - n_chars) / 500 END, 9)::DOUBLE AS penalty FROM documents")
def overlong_penalty(spark, d):
    return view(spark, d, "SELECT doc_id, n_chars FROM documents").select("doc_id", F.round(rewards.overlong(F.col("n_chars"), 2000, 500), 9).alias("penalty"))


@query(f"""SELECT doc_id, md5(concat('Lemma: ', source, chr(10), 'POS: ', lang, chr(10), chr(10), 'Sentence 1: "the <t>', source, '</t> is ', lang, '"', chr(10), 'Sentence 2: "<t>', upper(source), '</t>"', chr(10), chr(10), {_q(TEACHER_TAIL)})) AS asked FROM documents""")
def teacher_prompt(spark, d):
    rows = view(spark, d, "SELECT doc_id, source, lang, concat('the ', source, ' is ', lang) AS s1, upper(source) AS s2 FROM documents")
    turns = traces.teacher_messages(F.col("source"), F.col("lang"), F.col("source"), F.col("s1"), F.col("source"), F.col("s2"))
    return rows.select("doc_id", F.md5(F.get(turns, 1)["content"]).alias("asked"))


@query("SELECT doc_id, concat('[user] ', source, ' [assistant] ', lang, ' ') AS chat FROM documents")
def chat_template(spark, d):
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    rows = view(spark, d, "SELECT doc_id, source, lang FROM documents")
    template = lambda chat: "".join(f"[{t['role']}] {t['content']} " for t in chat)
    return rows.select("doc_id", traces.chat_text(F.array(turn("user", "source"), turn("assistant", "lang")), template).alias("chat"))


@query("SELECT doc_id, length(lang) * 1.0::DOUBLE AS first FROM documents")
def embed_once(spark, d):
    encode = F.array(F.char_length("lang").cast("double"))
    return evaluate.embed_once(view(spark, d, "SELECT doc_id, lang FROM documents"), "lang", encode).select("doc_id", F.get("embedding", 0).alias("first"))


BANK = ["money in an institution", "sloping land beside water", "a row of similar things"]


def _scored(spark, d):
    rows = view(spark, d, COMPLETIONS).withColumn("senses", F.array(*[F.lit(x) for x in BANK]))
    return rewards.score(rows)


def _reward(name, spark, d):
    return _scored(spark, d).select("doc_id", F.round(f"reward_{name}", 9).alias("reward"))


R_ACC = f"CASE WHEN ({SAID}) IS NULL THEN -1.0 WHEN ({SAID}) = label THEN 1.0 ELSE -0.5 END"
R_FORMAT = f"(CASE WHEN doc_id % 8 IN (6, 2) THEN 0.0 ELSE 0.1 END) + (CASE WHEN ({SAID}) IS NOT NULL THEN 0.1 ELSE 0.0 END)"
R_JSON = "CASE doc_id % 8 WHEN 0 THEN 0.3 WHEN 1 THEN 0.2 WHEN 2 THEN 0.2 WHEN 3 THEN 0.2 WHEN 4 THEN -0.2 WHEN 5 THEN -0.2 ELSE 0.0 END"
R_THINK = f"CASE WHEN len(list_filter({TOK.format('regexp_extract(completion, ' + chr(39) + '(?s)<think>(.*?)</think>' + chr(39) + ', 1)')}, lambda x: NOT list_contains({STOP_LONG}, x))) < 6 THEN -0.3 ELSE 0.0 END"


@query(f"WITH c AS ({COMPLETIONS}) SELECT doc_id, round({R_ACC}, 9)::DOUBLE AS reward FROM c")
def reward_accuracy(spark, d):
    return _reward("accuracy", spark, d)


@query(f"WITH c AS ({COMPLETIONS}) SELECT doc_id, round(({R_FORMAT})::DOUBLE, 9) AS reward FROM c")
def reward_format(spark, d):
    return _reward("format", spark, d)


@query(f"WITH c AS ({COMPLETIONS}) SELECT doc_id, round(({R_JSON})::DOUBLE, 9) AS reward FROM c")
def reward_json(spark, d):
    return _reward("json", spark, d)


#: Of this adapter's completions only the first kind has a boolean true verdict; its glosses have no token in common.
R_CONSISTENT = "CASE WHEN doc_id % 16 = 0 THEN -0.3 ELSE 0.0 END"


@query(f"WITH c AS ({COMPLETIONS}) SELECT doc_id, round(({R_CONSISTENT})::DOUBLE, 9) AS reward FROM c")
def reward_consistency(spark, d):
    return _reward("consistency", spark, d)


@query(f"WITH c AS ({COMPLETIONS}) SELECT doc_id, round(({R_THINK})::DOUBLE, 9) AS reward FROM c")
def reward_think_length(spark, d):
    return _reward("think_length", spark, d)


def _margin(k: int) -> str:
    said, gold = _duck_set(f"said{k}", STOP_LONG), _duck_set(f"gloss{k}", STOP_LONG)
    rivals = [_duck_f1(said, _duck_set(_q(x), STOP_LONG), "0.0") for x in BANK]
    worst = "greatest(" + ", ".join(f"CASE WHEN gloss{k} = {_q(x)} THEN 0.0 ELSE {r} END" for x, r in zip(BANK, rivals, strict=True)) + ")"
    return f"(CASE WHEN len({said}) = 0 OR len({gold}) = 0 THEN 0.0 ELSE {_duck_f1(said, gold, '0.0')} - {worst} END)"


GLOSSED = f"""WITH c AS ({COMPLETIONS}), k AS (SELECT *, CASE WHEN doc_id % 8 < 4 THEN regexp_extract(completion, '"sense1": "([^"]*)"', 1) END AS said1, CASE WHEN doc_id % 8 < 4 THEN regexp_extract(completion, '"sense2": "([^"]*)"', 1) END AS said2 FROM c),
m AS (SELECT doc_id, CASE WHEN said1 IS NULL OR gloss1 = '' THEN NULL ELSE {_margin(1)} END AS m1, CASE WHEN said2 IS NULL OR gloss2 = '' THEN NULL ELSE {_margin(2)} END AS m2 FROM k)"""


@query(GLOSSED + " SELECT doc_id, round(CASE WHEN m1 IS NULL OR m2 IS NULL THEN 0 ELSE 0.15 * (greatest(-1, least(1, m1 / 0.2)) + greatest(-1, least(1, m2 / 0.2))) / 2 END, 9)::DOUBLE AS reward FROM m")
def reward_gloss(spark, d):
    return _reward("gloss", spark, d)


@query(GLOSSED + " SELECT doc_id, round(m1, 9)::DOUBLE AS margin FROM m")
def gloss_margin(spark, d):
    rows = view(spark, d, COMPLETIONS).withColumn("a", A.parsed(F.col("completion")))
    margin = rewards.gloss_margin(F.col("a.sense1"), F.col("gloss1"), F.array(*[F.lit(x) for x in BANK]), T.STOPLIST)
    return rows.select("doc_id", F.round(F.when(F.col("a.ok") & (F.col("gloss1") != ""), margin), 9).alias("margin"))


R_GLOSS = "CASE WHEN m1 IS NULL OR m2 IS NULL THEN 0 ELSE 0.15 * (greatest(-1, least(1, m1 / 0.2)) + greatest(-1, least(1, m2 / 0.2))) / 2 END"


@query(GLOSSED + f" SELECT doc_id, round((({R_ACC}) + {R_FORMAT} + ({R_JSON}) + ({R_CONSISTENT}) + ({R_THINK}) + ({R_GLOSS}))::DOUBLE, 9) AS reward FROM m JOIN c USING (doc_id)")
def reward_total(spark, d):
    return _scored(spark, d).select("doc_id", F.round("reward_total", 9).alias("reward"))


def _advantage(spark, d, scale):
    rows = view(spark, d, "SELECT user_id, event_id, value AS reward FROM events")
    return rewards.advantage(rows, ["user_id"], scale=scale).select("user_id", "event_id", F.round("advantage", 6).alias("advantage"))


@query("SELECT user_id, event_id, round(coalesce((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 0), 6) AS advantage FROM events WINDOW w AS (PARTITION BY user_id)")
def advantage_group(spark, d):
    return _advantage(spark, d, "group")


@query("SELECT user_id, event_id, round(coalesce((value - avg(value) OVER (PARTITION BY user_id)) / nullif(stddev_samp(value) OVER (), 0), 0), 6) AS advantage FROM events")
def advantage_batch(spark, d):
    return _advantage(spark, d, "batch")


@query("SELECT user_id, event_id, round(value - avg(value) OVER (PARTITION BY user_id), 9) AS advantage FROM events")
def advantage(spark, d):
    return rewards.advantage(view(spark, d, "SELECT user_id, event_id, value AS reward FROM events"), ["user_id"]).select("user_id", "event_id", F.round("advantage", 9).alias("advantage"))


def _pairs(spark, d):
    return view(spark, d, "SELECT doc_id, source AS lemma, 'noun' AS pos, doc_id % 2 = 0 AS label, lang AS usage1, source AS usage2, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS gloss1 FROM documents")


PAIR_USER = f"concat('Target word: ', source, ' (noun)', chr(10), chr(10), 'Sentence 1: ', lang, chr(10), 'Sentence 2: ', source, chr(10), chr(10), {_q(STUDENT_TAIL)})"
TRUTH = "CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END"
GOLD = f"""concat('Hint: the two sentences use "', source, '" in ', CASE WHEN doc_id % 2 = 0 THEN 'the same sense' ELSE 'different senses' END, ', so the correct verdict is "same_sense": ', {TRUTH}, {_q('. ' + NO_MENTION)})"""


@query(f"SELECT source AS lemma, doc_id % 2 = 0 AS label, coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END, '') AS gloss1, '' AS gloss2, md5({PAIR_USER}) AS prompt, {GOLD} AS privileged_context FROM documents")
def rollout_prepare(spark, d):
    got = rollouts.prepare(_pairs(spark, d), rollouts.gold_feedback(F.col("lemma"), F.col("label")))
    return got.select("lemma", "label", "gloss1", "gloss2", F.md5(F.get("prompt", 1)["content"]).alias("prompt"), "privileged_context")


@query(f"""WITH x AS (SELECT doc_id FROM documents ORDER BY {HASH.format(salt='', key='doc_id::VARCHAR')}, doc_id LIMIT 50), y AS (SELECT item_id + 1000000 AS doc_id FROM benchmark ORDER BY {HASH.format(salt='', key='(item_id + 1000000)::VARCHAR')}, doc_id LIMIT 50)
SELECT doc_id FROM x UNION ALL SELECT doc_id FROM y""")
def rollout_union(spark, d):
    spark.read.parquet(f"{d}/benchmark.parquet").createOrReplaceTempView("benchmark")
    return rollouts.build([view(spark, d, "SELECT doc_id FROM documents"), spark.sql("SELECT item_id + 1000000 AS doc_id FROM benchmark")], ["doc_id"], cap=50)


@query(f"SELECT doc_id, {GOLD} AS hint FROM documents")
def gold_feedback(spark, d):
    return _pairs(spark, d).select("doc_id", rollouts.gold_feedback(F.col("lemma"), F.col("label")).alias("hint"))


TAIL = f"""concat(' The correct verdict is "same_sense": ', {TRUTH}, {_q('. ' + NO_MENTION)})"""


@query(f"""SELECT doc_id, concat(CASE WHEN doc_id % 3 = 0 THEN concat('Hint: the two sentences use "', source, '" in ', CASE WHEN doc_id % 2 = 0 THEN 'the same sense' ELSE 'different senses' END, '.')
 WHEN doc_id % 2 = 0 THEN concat('Hint: both sentences use "', source, '" in the sense "', lang, '".')
 ELSE concat('Hint: in sentence 1, "', source, '" means "', lang, '"; in sentence 2 it means "', source, '".', CASE WHEN doc_id % 5 = 0 THEN ' Both are kinds of living thing, so the contrast is fine-grained.' ELSE '' END) END, {TAIL}) AS hint FROM documents""")
def gloss_feedback(spark, d):
    genus = F.when(F.col("doc_id") % 5 == 0, "living_thing")
    return _pairs(spark, d).select("doc_id", rollouts.gloss_feedback(F.col("lemma"), F.col("label"), F.col("gloss1"), F.col("usage2"), genus).alias("hint"))


_LOWEST = f"""e AS ({TAXONOMY}), p AS (SELECT DISTINCT s1, s2 FROM ({CLOSE_PAIRS})), q AS ({TAXONOMY_POS}),
up(s, a, k) AS (SELECT synset_id, synset_id, 0 FROM e UNION SELECT hypernym_id, hypernym_id, 0 FROM e UNION SELECT up.s, e.hypernym_id, up.k + 1 FROM up JOIN e ON up.a = e.synset_id),
deep AS (SELECT s, max(k) AS h FROM up GROUP BY s), near AS (SELECT DISTINCT s, a FROM up),
low AS (SELECT p.s1, p.s2, arg_min(x.a, [-d.h, x.a]) AS a FROM p JOIN near x ON x.s = p.s1 JOIN near y ON y.s = p.s2 AND y.a = x.a JOIN deep d ON d.s = x.a GROUP BY p.s1, p.s2)"""
_NAMED = "SELECT p_partkey AS synset_id, replace(p_name, ' ', '_') AS name, p_type AS definition FROM part"


@query(f"""WITH RECURSIVE {_LOWEST}, n AS ({_NAMED}), z AS (SELECT p.s1, p.s2, a.name AS lemma, a.definition AS g1, b.definition AS g2, CASE WHEN x.pos = y.pos THEN replace(m.name, '_', ' ') END AS genus
 FROM p LEFT JOIN n a ON a.synset_id = p.s1 LEFT JOIN n b ON b.synset_id = p.s2 LEFT JOIN q x ON x.synset_id = p.s1 LEFT JOIN q y ON y.synset_id = p.s2 LEFT JOIN low ON low.s1 = p.s1 AND low.s2 = p.s2 LEFT JOIN n m ON m.synset_id = low.a)
SELECT s1, s2, concat(CASE WHEN g1 IS NULL OR g2 IS NULL THEN concat('Hint: the two sentences use "', lemma, '" in different senses.')
 ELSE concat('Hint: in sentence 1, "', lemma, '" means "', g1, '"; in sentence 2 it means "', g2, '".', CASE WHEN genus IS NULL THEN '' ELSE concat(' Both are kinds of ', genus, ', so the contrast is fine-grained.') END) END,
 {_q(' The correct verdict is "same_sense": false. ' + NO_MENTION)}) AS hint FROM z""")
def genus_feedback(spark, d):
    edges, named = cut(view(spark, d, TAXONOMY)), view(spark, d, _NAMED)
    pairs_ = view(spark, d, CLOSE_PAIRS).distinct()
    kinds = lexicon.genus(pairs_, lexicon.ancestors(edges), lexicon.depths(edges), view(spark, d, TAXONOMY_POS), named)
    for k in (1, 2):
        kinds = kinds.join(never_broadcast(named.select(F.col("synset_id").alias(f"s{k}"), F.col("name").alias(f"name{k}"), F.col("definition").alias(f"gloss{k}"))), f"s{k}", "left")
    return kinds.select("s1", "s2", rollouts.gloss_feedback(F.col("name1"), F.lit(False), F.col("gloss1"), F.col("gloss2"), F.col("genus")).alias("hint"))


@query("SELECT event_id, CASE WHEN value < 100 THEN (event_id % 2)::INT ELSE 0 END AS mask FROM events")
def failure_mask(spark, d):
    return view(spark, d, "SELECT event_id, value, CAST(event_id % 2 AS INT) AS m FROM events").select("event_id", rollouts.failure_mask(F.col("m"), F.col("value"), 100.0).alias("mask"))


@query("SELECT event_id, CAST(event_id % 40 AS BIGINT) AS step FROM events WHERE (event_id % 40) % 10 = 0 QUALIFY row_number() OVER (PARTITION BY event_id % 40 ORDER BY event_id) <= 8")
def rollout_dump(spark, d):
    return rollouts.dump(view(spark, d, "SELECT event_id, event_id % 40 AS step FROM events"), 10, ["event_id"])


@query("SELECT event_id FROM events WHERE value >= 150")
def correct_rollouts(spark, d):
    return rollouts.correct_rollouts(view(spark, d, "SELECT event_id, value AS reward FROM events"), 150.0).select("event_id")


@query(f"WITH l AS ({LEXICON}), i AS (SELECT lemma, pos, string_agg(definition, '|' ORDER BY rank) AS senses, count(*) AS n FROM l GROUP BY 1, 2) SELECT p.p_partkey, i.n, md5(i.senses) AS senses FROM part p JOIN i ON p.p_brand = i.lemma")
def lexicon_join(spark, d):
    table = lexicon.inventory(view(spark, d, LEXICON))
    rows = view(spark, d, GLOSSES).select("p_partkey", "lemma", "pos").join(table, ["lemma", "pos"])
    return rows.select("p_partkey", F.size("senses").cast("bigint").alias("n"), F.md5(F.array_join("senses", "|")).alias("senses"))


def _judge_sql() -> str:
    from .prompts import JUDGE

    text, parts = JUDGE, []
    for name, value in (
        ("lemma", "lemma"), ("pos", "pos"), ("sentence1", "'one'"), ("sentence2", "'two'"), ("gold", "CASE WHEN label THEN 'True' ELSE 'False' END"),
        ("answer", "CASE WHEN slot = 2 THEN '(none)' ELSE coalesce(answer, 'None') END"), ("reasoning", "reasoning"),
    ):
        head, text = text.split("{" + name + "}", 1)
        parts += [_q(head), value]
    return "md5(concat(" + ", ".join([*parts, _q(text)]) + "))"


@query(with_slots(f"SELECT doc_id, {_judge_sql()} AS prompt FROM s WHERE reasoning IS NOT NULL"))
def judge_prompt(spark, d):
    s = view(spark, d, SLOTS).filter("reasoning IS NOT NULL")
    made = quality.judge_prompt(F.col("lemma"), F.col("pos"), F.lit("one"), F.lit("two"), F.col("label"), F.col("answer"), F.col("reasoning"), F.col("slot") == 2)
    return s.select("doc_id", F.md5(made).alias("prompt"))


@query(f"""SELECT doc_id, md5(concat(lang, CASE WHEN doc_id % 2 = 0 THEN concat({_q(rollouts.SOLUTION_HEAD)}, source, chr(10), chr(10)) ELSE '' END,
 CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat(chr(10), lang, chr(10)) END, {_q(rollouts.REPROMPT_TAIL)})) AS prompt FROM documents""")
def reprompt(spark, d):
    rows = view(spark, d, "SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN source END AS solution, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE lang END AS hint FROM documents")
    return rows.select("doc_id", F.md5(rollouts.reprompt(F.col("lang"), F.col("solution"), F.col("hint"))).alias("prompt"))


@query(f"WITH c AS ({COMPLETIONS}) SELECT doc_id, CASE WHEN doc_id % 8 < 4 THEN regexp_extract(completion, '\"sense1\": \"([^\"]*)\"', 1) ELSE '' END AS gloss, CASE WHEN doc_id % 8 < 4 THEN regexp_extract(completion, '\"sense2\": \"([^\"]*)\"', 1) ELSE '' END AS filler_gloss FROM c")
def parse_glosses(spark, d):
    rows = view(spark, d, COMPLETIONS).withColumn("g", traces.parse_glosses(F.col("completion")))
    return rows.select("doc_id", "g.gloss", "g.filler_gloss")


@query(f"WITH c AS ({COMPLETIONS}) SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 8 < 4 THEN {SAID} WHEN doc_id % 8 = 6 THEN true END AS prediction, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 8 < 4 OR doc_id % 8 = 6 THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence FROM c")
def sampled_rows(spark, d):
    rows = view(spark, d, COMPLETIONS).select("doc_id", F.array("completion", "completion").alias("outputs"), F.when(F.col("doc_id") % 7 == 0, "failed").alias("error"))
    return traces.sampled_rows(rows).select("doc_id", "prediction", "confidence")


@query("SELECT task, count(*) AS n FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE 'b' END AS task FROM documents) GROUP BY task")
def task_counts(spark, d):
    docs = view(spark, d, "SELECT doc_id, doc_id % 2 = 0 AS label FROM documents")
    return traces.build_records({"a": docs.filter("doc_id % 3 = 0"), "b": docs.filter("doc_id % 3 <> 0")}, ["doc_id"])[1]


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 5")
def preview(spark, d):
    return corpus.preview(view(spark, d, "SELECT doc_id, lang FROM documents"), 5, ["doc_id"])


@query("SELECT quality, lower(lang) AS lemma FROM (SELECT DISTINCT quality, lang FROM labels l JOIN documents d ON l.doc_id = d.doc_id)")
def distinct_lemmas(spark, d):
    return view(spark, d, "SELECT l.quality, lower(d.lang) AS lemma FROM labels l JOIN documents d ON l.doc_id = d.doc_id").distinct()


from . import file_queries as _files  # noqa: E402, F401  registers its queries in the tables above


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
