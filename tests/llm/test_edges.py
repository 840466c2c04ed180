"""Edges of the pipeline as a whole, and of chat logs."""

from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline

CLASHES = ("kept", "score", "digest", "keep_id", "fp", "lang_pred", "sequence_id", "stays", "part", "nth")


def documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = " ".join(docs.filter("lang = 'en'").limit(40).toPandas()["text"].fillna(""))
    edge = [(None, None, None, None, None), (9001, "", "en", "s", 0), (9002, "12 34 !!", "en", None, 8), (9003, long, "en", "s", len(long)), (9003, long, "en", "s", len(long)), (None, long + " Ends otherwise.", None, "s", None)]
    return docs.unionByName(spark.createDataFrame(edge, docs.schema)).withColumns({c: F.lit("clash") for c in CLASHES})


def test_pipeline_over_edges(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    made = corpus_pipeline.run(spark, str(tmp_path))
    pieces = made.collect()
    ids = {r["doc_id"] for r in pieces}
    assert not ids & {9001, 9002} and len(ids) > 50
    placed = {}
    for r in pieces:
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in placed.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    # A repeated row is one document: its pieces are numbered once.
    assert len([r for r in pieces if r["doc_id"] == 9003]) == len({r["piece"] for r in pieces if r["doc_id"] == 9003})


def test_pipeline_over_nothing(spark, tmp_path):
    documents(spark).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns(spark):
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_long_messages_and_clashing_names_in_logs(spark):
    from glossmill.llm.chat_format import format_log, parse

    piece = "a < b \\ c é </turn> " * 500
    rows = [(1, k, "delta" if k else "message", "m", "assistant", piece) for k in range(100)] + [(1, 200, "message", None, "user", "x" * 2_000_000)]
    log = spark.createDataFrame(rows, "conv_id int, seq bigint, kind string, message string, role string, text string").withColumns({c: F.lit("clash") for c in ("formatted", "n_turns", "key", "part", "begin", "loss_spans")})
    got = format_log(log.repartition(4)).collect()
    assert len(got) == 1 and parse(got[0]["formatted"]) == [("assistant", piece * 100), ("user", "x" * 2_000_000)]
