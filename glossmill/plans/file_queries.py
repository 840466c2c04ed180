"""Registered queries of sources, sinks, streams and back ends: tables that Spark derives from the driver's are written in the shared
folder in the form of each source, and read back by it."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, evaluate, judging, lexicon, pairs, traces
from ..session import cut, shared_folder
from ..sources import lexicons, readers, writers
from ..streaming.progress import final_metrics, running_metrics
from ..streaming.resume import process_new
from . import schemas
from .prompts import FILLER_USAGE, FILLER_WORD, STUDENT_TAIL, SYSTEM
from .queries import CORPUS, DIFF, GLOSSES, LEXICON, PREDICTIONS, USABLE, _q, _usages, query, view


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query("SELECT doc_id, md5(text) AS text, lang, length(text) AS n FROM documents")
def json_array_files(spark, d):
    path = _place(spark)
    writers.write_array(view(spark, d, "SELECT doc_id, text, lang FROM documents"), f"{path}.json")
    return readers.read_array(spark, f"{path}.json", "doc_id bigint, text string, lang string").select("doc_id", F.md5("text").alias("text"), "lang", F.char_length("text").cast("bigint").alias("n"))


@query("SELECT doc_id, CASE WHEN rank <= greatest(1, floor((SELECT count(*) FROM documents) * 0.05)) THEN 'dev' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42|split|' || doc_id::VARCHAR), doc_id) AS rank FROM documents)")
def split_folders(spark, d):
    path = _place(spark)
    writers.write_split(corpus.split(view(spark, d, "SELECT doc_id FROM documents"), ["doc_id"]), path)
    return spark.read.parquet(path)


PAIR_FILE = "SELECT source AS lemma, 'noun' AS pos, source AS word1, concat('the ', source, ' is ', lang) AS sentence1, lang AS word2, concat(lang, ' was ', source) AS sentence2, CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE '0' END AS label, doc_id FROM documents"


@query("SELECT source AS lemma, doc_id % 2 = 0 AS label, concat('the <t> ', source, ' </t> is ', lang) AS usage1, concat('<t> ', lang, ' </t> was ', source) AS usage2, count(*) AS n FROM documents GROUP BY ALL")
def pair_files(spark, d):
    path = _place(spark)
    writers.write_array(view(spark, d, PAIR_FILE).drop("doc_id"), f"{path}/mcl-wic.dev.json")
    return readers.read_pairs(spark, path, "dev").groupBy("lemma", "label", "usage1", "usage2").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source AS lemma, doc_id % 2 = 0 AS label, '' AS gloss1, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS gloss2, 0 AS n_senses, count(*) AS n FROM documents GROUP BY ALL")
def gold_pair_files(spark, d):
    path = _place(spark)
    old = view(spark, d, "SELECT source AS lemma, 'noun' AS pos, doc_id % 2 = 0 AS label, lang AS sentence1, source AS sentence2, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS gloss2 FROM documents")
    writers.write_array(old, f"{path}.json")  # written before first glosses and senses existed
    got = readers.read_gold_pairs(spark, f"{path}.json").select("lemma", "label", "gloss1", "gloss2", F.size("senses").alias("n_senses"))
    return got.groupBy(*got.columns).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'noun' ELSE 'adj' END AS pos, CASE WHEN p_partkey % 4 = 0 THEN concat('a <t>', p_brand, '</t>') ELSE concat('a <t> ', p_brand, ' </t> here') END AS marked FROM part")
def gloss_record_files(spark, d):
    path = _place(spark)
    rows = view(spark, d, "SELECT p_partkey, p_brand AS lemma, p_brand AS word, CASE p_partkey % 3 WHEN 0 THEN NULL ELSE 'adj' END AS pos, CASE WHEN p_partkey % 4 = 0 THEN concat('a <t>', p_brand, '</t>') ELSE concat('a ', p_brand, ' here') END AS usage, p_name AS definition FROM part")
    writers.write_array(rows, f"{path}.json")
    return readers.gloss_records(readers.read_array(spark, f"{path}.json", f"p_partkey bigint, {schemas.GLOSS}")).select("p_partkey", "pos", "marked")


@query(f"SELECT lemma, coalesce(pos, '') AS pos, sentence1, sentence2, count(*) AS n FROM ({CORPUS} doc_id % 7 <> 0) GROUP BY ALL")
def manifest_files(spark, d):
    path = _place(spark)
    records = view(spark, d, f"{CORPUS} true").withColumn("task", F.when(F.col("doc_id") % 7 != 0, "wic").otherwise("gloss"))
    writers.write_manifest(records, f"{path}.json")
    return readers.read_manifest(spark, f"{path}.json").groupBy(*schemas.PAIR_KEY).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT lemma, definition, gloss, filler_gloss, count(*) AS n FROM ({GLOSSES}) GROUP BY ALL")
def eval_files(spark, d):
    path, rows = _place(spark), view(spark, d, GLOSSES)
    records = rows.select("lemma", F.col("lemma").alias("word"), "pos", F.col("definition").alias("usage"), "definition", "gloss", "filler_gloss", F.lit(None).cast("string").alias("think"))
    writers.write_report(evaluate.full_summary(rows, ["p_partkey"], "p_partkey"), records, f"{path}.json")
    return readers.read_eval(spark, f"{path}.json").groupBy("lemma", "definition", "gloss", "filler_gloss").agg(F.count(F.lit(1)).alias("n"))


_WORDNET_LIKE = "SELECT lower(replace(lemma, ' ', '_')) AS lemma, pos, CAST(rank AS INT) AS rank, lower(replace(replace(replace(synset_id, ' ', '_'), '#', '_'), ':', '_')) AS synset_id, definition FROM"


@query(f"{_WORDNET_LIKE} ({LEXICON})")
def lexicon_files(spark, d):
    """A WordNet-LMF file of the lexicon's entries and synsets."""
    path, rows = _place(spark), cut(view(spark, d, f"{_WORDNET_LIKE} ({LEXICON})"))
    sense = F.concat(F.lit('<Sense id="s" synset="'), "synset_id", F.lit('"/>'))
    entries = rows.groupBy("lemma").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", sense.alias("x")))), lambda s: s["x"]), "").alias("x"))
    lines = entries.select(F.concat(F.lit('<LexicalEntry id="'), "lemma", F.lit('"><Lemma writtenForm="'), "lemma", F.lit('" partOfSpeech="n"/>'), "x", F.lit("</LexicalEntry>")).alias("value"))
    synsets = rows.select(F.concat(F.lit('<Synset id="'), "synset_id", F.lit('" partOfSpeech="n" members="'), "lemma", F.lit('"><Definition>'), "definition", F.lit("</Definition></Synset>")).alias("value"))
    head, tail = '<?xml version="1.0" encoding="UTF-8"?>\n<LexicalResource><Lexicon id="parts">', "</Lexicon></LexicalResource>"
    writers.one_file(lines.unionByName(synsets), f"{path}.xml", head, tail, between=" ")
    read = lexicons.read_lmf(spark, f"{path}.xml", "parts")
    lexicon.one_lexicon(*read)
    return read.senses.drop("lexicon")


def _judge():
    def client(prompt: str) -> str:
        last = prompt[-1]
        if last == "7":
            raise RuntimeError("down")
        return {"3": "not json", "1": '{"english": false, "coherent": 1, "faithful": 1, "consistent": 1}'}.get(last, '{"english": true, "coherent": "yes", "faithful": 1, "consistent": [0], "note": "x"}')

    return client


@query("""SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'rule' ELSE 'judge' END AS stage, doc_id % 9 <> 0 AND doc_id % 10 NOT IN (1, 3, 7) AS keep,
CASE WHEN doc_id % 9 = 0 THEN 'too_short' WHEN doc_id % 10 = 7 THEN 'not_judged' WHEN doc_id % 10 = 3 THEN 'unparseable_verdict' ELSE 'judged' END AS reason FROM documents""")
def judge_stage(spark, d):
    """Two runs over one store: the second is asked nothing again but what failed."""
    checked = view(spark, d, "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'too_short' END AS reason, concat(lang, ' ', CAST(doc_id AS VARCHAR(20))) AS prompt FROM documents")
    store = _place(spark)
    judging.judged_slots(checked.filter("doc_id % 2 = 0"), ["doc_id"], _judge, store, retries=1)
    return judging.judged_slots(checked, ["doc_id"], _judge, store, retries=1).select("doc_id", "stage", "keep", "reason")


@query("SELECT doc_id, length(lang) + doc_id % 5 AS score FROM documents")
def stream_finished(spark, d):
    """Two runs of a stream over files that overlap; nothing is finished twice."""
    path, docs = _place(spark), view(spark, d, "SELECT doc_id, lang FROM documents")
    for part in ("doc_id % 3 <> 0", "doc_id % 3 <> 1"):
        writers.write_lines(docs.filter(part), f"{path}/in")
        work = lambda rows: rows.select("doc_id", (F.char_length("lang") + F.col("doc_id") % 5).alias("score"))
        process_new(spark, f"{path}/in", "doc_id bigint, lang string", f"{path}/done", f"{path}/state", work, ["doc_id"]).awaitTermination()
    return spark.read.parquet(f"{path}/done").select("doc_id", "score")


@query(f"""WITH p AS ({PREDICTIONS}), c AS (SELECT count(*) FILTER (WHERE prediction IS NOT NULL) AS n_scored, count(*) FILTER (WHERE prediction IS NULL) AS n_skipped, count(*) FILTER (WHERE prediction AND label) AS tp,
 count(*) FILTER (WHERE prediction AND NOT label) AS fp, count(*) FILTER (WHERE NOT prediction AND label) AS fn, count(*) FILTER (WHERE NOT prediction AND NOT label) AS tn FROM p)
SELECT n_scored, n_skipped, tp, fp, fn, tn, n_scored + n_skipped AS n_items, round((tp + tn) / n_scored, 9) AS accuracy FROM c""")
def metrics_stream(spark, d):
    """Metrics of items that come in by thirds, from the counts of each micro-batch."""
    path, rows = _place(spark), view(spark, d, PREDICTIONS)
    for k in range(3):
        writers.write_lines(rows.filter(F.col("doc_id") % 3 == k).select("prediction", "label"), f"{path}/in")
        running_metrics(spark, f"{path}/in", "prediction boolean, label boolean", f"{path}/counts", f"{path}/metrics", f"{path}/state").awaitTermination()
    made = final_metrics(spark, f"{path}/counts", f"{path}/metrics")
    return made.select("n_scored", "n_skipped", "tp", "fp", "fn", "tn", "n_items", F.round("accuracy", 9).alias("accuracy"))


_MARKED_FILLER = FILLER_USAGE.replace(FILLER_WORD, f"<t> {FILLER_WORD} </t>", 1)


@query(f"SELECT doc_id, md5({_q(SYSTEM)}) AS system, md5(concat('Target word: ', source, ' (', lang, ')', chr(10), chr(10), 'Sentence 1: ', 'a <t> ', source, ' </t>', chr(10), 'Sentence 2: ', {_q(_MARKED_FILLER)}, chr(10), chr(10), {_q(STUDENT_TAIL)})) AS asked FROM documents")
def gloss_prompts(spark, d):
    turns = evaluate.gloss_messages(F.col("source"), F.col("lang"), F.concat(F.lit("a <t> "), "source", F.lit(" </t>")))
    return view(spark, d, "SELECT doc_id, source, lang FROM documents").withColumn("m", turns).select("doc_id", F.md5(F.get("m", 0)["content"]).alias("system"), F.md5(F.get("m", 1)["content"]).alias("asked"))


OUTPUTS = """
SELECT doc_id, lang, source, CASE doc_id % 6 WHEN 0 THEN concat('<think>', lang, '</think>{"sense1": "a", "sense2": "b", "same_sense": true}') WHEN 1 THEN concat(' why ', source, ' </think> {"sense1": "a", "sense2": "b", "same_sense": false} ')
  WHEN 2 THEN concat('<think>', lang, '</think> they are the same') WHEN 3 THEN concat('<think> never closed: same ', lang) WHEN 4 THEN concat('<think>', lang, '</think> no verdict') ELSE concat('<think>', lang, '</think><think> open {"same_sense": true}') END AS output
FROM documents"""


@query(f"""WITH o AS ({OUTPUTS}), p AS (SELECT doc_id, lang, source, CASE doc_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS prediction FROM o)
SELECT doc_id, prediction, CASE WHEN prediction IS NULL THEN '' ELSE prediction::VARCHAR END AS votes, CASE doc_id % 6 WHEN 0 THEN '{{"sense1": "a", "sense2": "b", "same_sense": true}}' WHEN 1 THEN '{{"sense1": "a", "sense2": "b", "same_sense": false}}' ELSE '' END AS answers,
 CASE doc_id % 6 WHEN 0 THEN lang WHEN 1 THEN concat('why ', source) ELSE '' END AS reasonings FROM p""")
def teacher_rows(spark, d):
    made = traces.teacher_row(view(spark, d, OUTPUTS))
    return made.select("doc_id", "prediction", F.array_join(F.transform("votes", lambda v: v.cast("string")), "|").alias("votes"), F.array_join("answers", "|").alias("answers"), F.array_join("reasonings", "|").alias("reasonings"))


@query("SELECT DISTINCT lower(source) AS lemma FROM documents WHERE doc_id % 3 = 0 INTERSECT SELECT lower(source) FROM documents WHERE doc_id % 20 IN (3, 4)")
def leaked_lemmas(spark, d):
    return pairs.leaked(view(spark, d, "SELECT source AS lemma FROM documents WHERE doc_id % 3 = 0"), view(spark, d, "SELECT upper(source) AS lemma FROM documents WHERE doc_id % 20 IN (3, 4)"))


_LEVELS = "SELECT DISTINCT concat(source, '.', a) AS s1, concat(source, '.', b) AS s2, level FROM documents CROSS JOIN (SELECT 'de' AS a, 'en' AS b, 'far' AS level UNION ALL SELECT 'en', 'es', 'near' UNION ALL SELECT 'en', 'fr', 'siblings' UNION ALL SELECT 'de', 'fr', 'unrelated' UNION ALL SELECT 'de', 'es', CAST(NULL AS VARCHAR(9))) k"


@query(f"""WITH {USABLE}, {DIFF.split(', e AS')[0]}, k AS ({_LEVELS}), e AS (SELECT DISTINCT lemma, pos, synset FROM u),
p AS (SELECT a.lemma, a.pos, k.s1, k.s2 FROM e a JOIN e b ON a.lemma = b.lemma AND a.pos = b.pos JOIN k ON k.s1 = a.synset AND k.s2 = b.synset WHERE k.level IN ('siblings', 'near', 'far')
 QUALIFY row_number() OVER (PARTITION BY a.lemma, a.pos ORDER BY CASE k.level WHEN 'siblings' THEN 1 WHEN 'near' THEN 2 ELSE 3 END, k.s1, k.s2) <= 2)
SELECT p.lemma, p.pos, s1 AS synset1, s2 AS synset2, md5(x.text) AS text1, md5(y.text) AS text2 FROM p JOIN o2 x ON x.lemma = p.lemma AND x.pos = p.pos AND x.synset = s1 AND x.n = 1 JOIN o2 y ON y.lemma = p.lemma AND y.pos = p.pos AND y.synset = s2 AND y.n = 1 WHERE x.text <> y.text""")
def hardest_pairs(spark, d):
    made = pairs.different_pairs(_usages(spark, d), view(spark, d, _LEVELS), cutoff="far", per_lemma=2)
    return made.select("lemma", "pos", "synset1", "synset2", F.md5("u1.text").alias("text1"), F.md5("u2.text").alias("text2"))
