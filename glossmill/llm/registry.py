"""Registered queries of the operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, read, small_batches


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import assign

    return assign(read(spark, sf_dir, "documents"))


OP10_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""


def op1_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_knn import Voters

    docs, rest = read(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 5)
    scored = Voters(docs, read(spark, sf_dir, "labels"), rest != 0).score(docs)
    return scored.select("doc_id", (rest == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score

    small_batches(spark)
    mean = F.col("log_score") / F.greatest("n_words", F.lit(1))
    return score(read(spark, sf_dir, "documents")).select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round(mean, 5).alias("mean_log_score"))


OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
t AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
b AS (SELECT doc_id, pos, word, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM t),
c1 AS (SELECT word, count(*) AS n FROM t GROUP BY word),
c2 AS (SELECT before, word, count(*) AS n FROM b WHERE before IS NOT NULL GROUP BY before, word),
s AS (SELECT doc_id, CASE WHEN c2.n >= 2 THEN ln(c2.n) - ln(p.n) ELSE (CASE WHEN b.before IS NULL THEN 0 ELSE ln(0.4) END) + ln(c1.n) - ln((SELECT count(*) FROM t)) END AS v
      FROM b JOIN c1 ON b.word = c1.word LEFT JOIN c2 ON b.before = c2.before AND b.word = c2.word LEFT JOIN c1 p ON b.before = p.word)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, round(coalesce(x.v, 0), 3) AS log_score, round(coalesce(x.v, 0) / greatest(len(w.words), 1), 5) AS mean_log_score FROM w LEFT JOIN (SELECT doc_id, sum(v) AS v FROM s GROUP BY doc_id) x USING (doc_id)
"""


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_dedup import assign

    return assign(read(spark, sf_dir, "documents"))


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_codec import encode

    return encode(read(spark, sf_dir, "documents"), keep_ids=False)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import Languages

    docs, rest = read(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 4)
    return Languages(docs, rest != 2).predict(docs).select("doc_id", (rest == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(read(spark, sf_dir, "pages"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import digests, format_log, streamed_log

    planted = "\\### Assistant: </turn> ok"
    table = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], table.schema)
    return digests(format_log(streamed_log(table.unionByName(extra))))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import Rules

    return Rules(read(spark, sf_dir, "documents")).score()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import encode

    return encode(read(spark, sf_dir, "embeddings"))


def _codebook_rounds(rounds: int) -> str:
    """CTEs of the rounds: w are the parts' nearest entries, c the codebooks after them."""
    made = []
    for k in range(rounds + 1):
        made.append(
            f"w{k} AS MATERIALIZED (SELECT x.vec_id, x.p, min(((x.s + c.s - 2 * list_inner_product(x.v, c.v)) * 256 + c.e)::BIGINT) AS key FROM x JOIN c{k} c ON x.p = c.p GROUP BY x.vec_id, x.p)"
        )
        if k < rounds:
            made.append(
                f"m{k} AS (SELECT p, e, list(y ORDER BY i) AS v FROM (SELECT x.p, w.key % 256 AS e, i, floor(sum(x.v[i]::HUGEINT)::DOUBLE / count(*))::DOUBLE AS y FROM x JOIN w{k} w ON x.vec_id = w.vec_id AND x.p = w.p, range(1, 17) r(i) GROUP BY x.p, w.key % 256, i) GROUP BY p, e)"
            )
            made.append(f"c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.v, c.v) AS v, list_inner_product(coalesce(m.v, c.v), coalesce(m.v, c.v)) AS s FROM c{k} c LEFT JOIN m{k} m ON c.p = m.p AND c.e = m.e)")
    return ",\n".join(made)


OP11_SQL = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda y: floor(1024 * y::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0),
x AS MATERIALIZED (SELECT vec_id, p, v, list_inner_product(v, v) AS s FROM (SELECT vec_id, p, list_slice(v, 16 * p + 1, 16 * p + 16) AS v FROM k, range(4) r(p))),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v, s FROM x QUALIFY e < 256),
{_codebook_rounds(4)},
h AS (SELECT sha256(string_agg(y::BIGINT, ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM c4)),
o AS (SELECT vec_id, string_agg(lpad(to_hex(key % 256), 2, '0'), '' ORDER BY p) AS code, sum(key // 256)::BIGINT AS error FROM w4 GROUP BY vec_id)
SELECT o.vec_id, lower(o.code) AS code, o.error, sum(o.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, h.h AS codebooks_sha256 FROM o JOIN k ON o.vec_id = k.vec_id, h
"""


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dm AS MATERIALIZED (SELECT * FROM d),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, s, s + least(len(w), 10) - 1) AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
f AS (SELECT DISTINCT n, win[1] AS head FROM p),
s AS (SELECT k, w, pos, w[pos] AS head FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS pos FROM dm)),
c AS (SELECT s.k, s.pos, f.n, list_slice(s.w, s.pos, s.pos + f.n - 1) AS win FROM s JOIN f ON s.head = f.head),
m AS MATERIALIZED (SELECT c.k, c.pos, p.n, p.item_id FROM c JOIN p ON c.n = p.n AND c.win = p.win),
h AS (SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT k, unnest(range(pos, pos + n)) AS q FROM m) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item_id::VARCHAR AS item FROM m) GROUP BY k)
SELECT dm.doc_id, len(dm.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM dm LEFT JOIN h ON dm.k = h.k LEFT JOIN t ON dm.k = t.k
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(read(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(words)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(words) AS term FROM d) JOIN k USING (lang, term) GROUP BY lang, source, term),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT f.lang, f.source, f.term, f.n, (1 + (1000000000 * (f.n + 5)::HUGEINT) // (f.total + 5 * v.v))::BIGINT AS p FROM f JOIN v ON f.lang = v.lang),
l AS (SELECT c.lang, c.term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY c.lang) AS total FROM c GROUP BY c.lang, c.term),
q AS (SELECT l.lang, l.term, (1 + (1000000000 * (l.n + 5)::HUGEINT) // (l.total + 5 * v.v))::BIGINT AS q FROM l JOIN v ON l.lang = v.lang),
pp AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source AS s, b.source AS t, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term GROUP BY a.lang, a.source, b.source) x ON x.lang = a.lang AND x.s = a.source AND x.t = b.source),
tt AS (SELECT p.lang, p.source, p.term AS item, p.p - q.q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pp
UNION ALL SELECT lang, source, 'term', item, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM tt) WHERE rank <= 50
"""


QUERIES = [op1_quality_knn, op2_best_fit_packing, op3_language_id, op4_html_extract, op5_chat_format, op6_quality_rules, op7_lm_score, op8_simhash_dedup, op9_piece_codec, op10_exact_dedup, op11_vector_codes, op12_decontaminate, op13_source_divergence]
SQL = {"op7_lm_score": OP7_SQL, "op10_exact_dedup": OP10_SQL, "op11_vector_codes": OP11_SQL, "op12_decontaminate": OP12_SQL, "op13_source_divergence": OP13_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
