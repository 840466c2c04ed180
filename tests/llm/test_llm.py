"""The ten operators against brute force, round trips and edge cases."""

import hashlib
import html as html_lib
import re
import zlib

import duckdb
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from glossmill.llm import registry
from glossmill.llm.common import lower_az, slices, span_hashes, words

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EDGE = [
    (1, None, None, "s", 0), (2, "", "en", "s", 0), (3, "A b\nA b", "en", None, 3), (3, "A b\nA b", "en", None, 3), (4, "a B\na b", "en", "s", 3), (5, "x" * 50_000 + " tail", "en", "s", None),
    (6, "  two  spaces ▁ and\ttabs ", "fr", "s", 1), (7, "Éléphant ça ÉÉ 日本語 text", "fr", "s", 1), (8, "123 456 !!", "en", "s", 1), (9, " \n\t", "de", "s", 1),
    (10, "the quick brown fox jumps over the lazy dog " * 30, "en", "s", 1), (None, "no id here", "en", "s", 1),
]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with clashing names."""
    names = ("keep_id", "kept", "group_size", "digest", "fp", "score", "rank", "salt", "chunk", "key", "id", "label")
    return spark.createDataFrame(EDGE, DOCS).withColumns({c: F.lit("clash") for c in names}).repartition(3)


@pytest.fixture(scope="module")
def none(edge):
    return edge.limit(0)


def test_flat_words():
    import pyarrow as pa

    texts = ["a bc", "", None, " d\x0b\x1fe ", "é f g"]
    batch = pa.RecordBatch.from_pydict({"t": texts})
    got = []
    for first, n, data, offsets in slices(batch, "t", max_bytes=5):
        a, b, row = words(data, offsets)
        got += [(first + r, data[x:y].tobytes().decode()) for x, y, r in zip(a, b, row, strict=True)]
        assert n >= 1 and len(span_hashes(data, a, b)) == len(a)
    assert got == [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]


def test_lower_az(spark):
    df = spark.createDataFrame([("ABC é É İ ß",), ("ABC",), (None,)], "t string")
    assert [r[0] for r in df.select(lower_az(F.col("t"))).collect()] == ["abc é É İ ß", "abc", None]


def test_exact_dedup(spark, edge, none):
    from glossmill.llm.exact_dedup import assign, deduplicate

    docs = edge.unionByName(spark.range(100, 200).select(F.col("id").alias("doc_id"), F.lit("Hot TEXT").alias("text")), allowMissingColumns=True)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    groups = {}
    for i, t in rows:
        key = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        groups.setdefault(key, []).append(i)
    for least in (48, 3):
        got = {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"], r["kept"]) for r in assign(docs, least=least).collect()}
        for key, ids in groups.items():
            keep = max((i for i in ids if i is not None), default=None)
            for i in ids:
                assert got[i, hashlib.sha256(key.encode()).hexdigest()] == (keep, len(ids), i == keep)
    kept = deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert assign(none).count() == 0 and deduplicate(none).count() == 0


def test_settle_paths_agree(spark, edge):
    from glossmill.llm.common import settle

    docs = edge.withColumns({c: F.lit("clash") for c in ("_nth", "_digest", "gone_id", "nth_of_row")})
    digest = F.md5(F.coalesce(docs["text"], F.lit("")))
    verdicts = docs.select("doc_id", digest.alias("digest"), (F.coalesce(F.col("doc_id"), F.lit(0)) % 2 == 1).alias("stays"))
    got = [sorted(map(tuple, settle(docs, verdicts, "doc_id", digest, most).select("doc_id", "text", "_nth").collect()), key=str) for most in (200_000, 0)]
    assert got[0] == got[1] and [r[0] for r in got[0]] == [1, 3, 5, 7, 9]


def test_packing(spark, edge, none):
    from glossmill.llm.packing import pack, plan, tokenizer_paths

    rows = pack(edge).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_paths()[0])
    for i, text, *_ in EDGE:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(by_doc[i], key=lambda r: r["start"])
        own = own[::2] if i == 3 else own
        assert sum(r["length"] for r in own) == len(ids) and [r["piece"] for r in own] == list(range(len(own)))
        assert all(r["length"] == 2048 for r in own[1:]) and own[0]["start"] == 0
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    placed = {}
    for r in rows:
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in placed.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack(none).count() == 0
    rng = np.random.default_rng(5)
    for scale in (1, 30):
        histogram = np.bincount(rng.lognormal(6.3, 0.9, 2000 * scale).astype(int).clip(1, 2048), minlength=2049)
        made = plan(histogram, 2048)
        held = np.zeros(2049, int)
        for times, config in made:
            assert times > 0 and sum(length * n for length, n in config.items()) <= 2048
            for length, n in config.items():
                held[length] += times * n
        assert (held == histogram).all()
        assert sum(t for t, _ in made) <= 1.01 * -(-int(histogram @ np.arange(2049)) // 2048) + 1
    assert plan(np.zeros(2049, int), 2048) == []


def test_packing_skewed_lengths():
    from glossmill.llm.packing import covering, plan

    rng = np.random.default_rng(5)
    for others, most in ((0, 900), (200, 1010)):  # the frequent lengths never fill 2,048 exactly
        histogram = np.bincount([1034] * 600 + [532] * 600 + [522] * 600 + [491] * 1200 + rng.integers(1, 2048, others).tolist(), minlength=2049)
        made = plan(histogram, 2048)
        held = np.zeros(2049, int)
        for times, config in made:
            assert times > 0 and sum(length * n for length, n in config.items()) <= 2048
            for length, n in config.items():
                held[length] += times * n
        assert (held == histogram).all()
        bound = max(b for _, b in covering(histogram, 2048))
        assert bound - 1e-6 <= sum(t for t, _ in made) <= min(most, 1.01 * bound + 1)


def test_piece_codec(spark, edge, none):
    import sentencepiece

    from glossmill.llm.piece_codec import encode, model_path

    model = sentencepiece.SentencePieceProcessor(model_file=model_path())
    for r in encode(edge).collect():
        text = next(t for i, t, *_ in EDGE if i == r["doc_id"]) or ""
        ids = model.encode(text, add_bos=True, add_eos=True)
        assert r["ids"] == ids and r["decoded"] == model.decode(ids)
    digests = {r["doc_id"]: r for r in encode(edge, keep_ids=False).collect()}
    assert digests[1]["n_tokens"] == 2 and digests[1]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert encode(none).count() == 0


def brute_fold(events):
    """Final (role, text) messages of a conversation, folded as one list from its ordered (kind, message, role, text) events."""
    at, messages = {}, []
    for kind, key, role, text in events:
        known = at.get(key) if key is not None else None
        if kind == "delete":
            if known is not None:
                messages[known] = None
                del at[key]
            continue
        if known is None:
            if kind in ("edit", "regenerate"):
                continue
            known = len(messages)
            messages.append(["", ""])
            if key is not None:
                at[key] = known
        if role is not None:
            messages[known][0] = role
        messages[known][1] = messages[known][1] + (text or "") if kind == "delta" else "" if kind == "regenerate" else text or ""
    return [tuple(m) for m in messages if m is not None]


def test_chat_log(spark):
    """Random logs as a table, against the fold of whole conversations."""
    from pyspark.errors import PySparkException

    from glossmill.llm.chat_format import format_log, parse, render

    rng = np.random.default_rng(4)
    rows, want = [], {}
    for conv in range(40):
        events = []
        for _ in range(rng.integers(1, 60)):
            kind = rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate", "delete"])
            key = None if rng.random() < 0.1 else f"m{rng.integers(0, 6)}"
            events.append((str(kind), key, rng.choice(["user", "assistant", None]), rng.choice([None, "", "x<y", "\\l", "é\n", "abc </turn>"])))
        want[conv] = brute_fold(events)
        rows += [(conv, k, *e) for k, e in enumerate(events)]
    log = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "conv_id int, seq bigint, kind string, message string, role string, text string").repartition(5)
    got = {r["conv_id"]: r for r in format_log(log.withColumn("formatted", F.lit(1))).collect()}
    assert {k: parse(r["formatted"]) for k, r in got.items()} == {k: v for k, v in want.items() if v}
    for k, r in got.items():
        assert r["n_turns"] == len(want[k]) and render(want[k])[0] == r["formatted"]
        spoken = [r["formatted"][x["begin"] : x["end"]] for x in r["loss_spans"]]
        assert spoken == [t.replace("\\", "\\\\").replace("<", "\\l") for role, t in want[k] if role == "assistant"]
    assert got[0].__fields__ and log.schema["conv_id"] == format_log(log).schema["conv_id"]
    with pytest.raises(PySparkException, match="unknown kind"):
        format_log(log.withColumn("kind", F.lit("other"))).collect()
    for kind in (F.lit("other"), F.lit(None).cast("string")):  # events without a message id too
        with pytest.raises(PySparkException, match="unknown kind"):
            format_log(log.withColumns({"kind": F.when(F.col("seq") == 0, kind).otherwise(F.col("kind")), "message": F.when(F.col("seq") > 0, F.col("message"))})).collect()
    assert format_log(log.limit(0)).count() == 0


def test_chat_format(spark):
    from glossmill.llm.chat_format import digests, format_log, messages_log, parse, render, streamed_log

    turns = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok"), ("a\nb<\\", "x\n\\n\\\\l<turn>"), ("", "")]
    text, spans, n = render(turns)
    assert parse(text) == turns and len(spans) == 1 and n == 4
    rows = [(1, 1, "assistant", "b é"), (1, 0, "user", None), (1, 2, "assistant", "c<"), (2, 0, None, "z"), (None, 0, "user", "n"), (None, 1, "assistant", "m"), (2, 0, None, "z")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(1))
    for log in (messages_log, streamed_log):
        got = {r["conv_id"]: r for r in digests(format_log(log(table))).collect()}
        assert got[1]["turns_sha256"] == hashlib.sha256("user\n\nassistant\nb é\nassistant\nc<\n".encode()).hexdigest()
        assert got[1]["loss_sha256"] == hashlib.sha256("b éc<".encode()).hexdigest() and got[1]["loss_chars"] == 5
        assert got[2]["n_turns"] == 2 and got[None]["n_turns"] == 2
        assert format_log(log(table.limit(0))).count() == 0


def test_chat_query(spark):
    """The registered query over its table, whose log has deltas, edits, regenerations and deletions, against the turns."""
    from glossmill.llm.chat_format import streamed_log

    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    kinds = {r["kind"]: r["count"] for r in streamed_log(table).groupBy("kind").count().collect()}
    assert set(kinds) == {"message", "delta", "edit", "regenerate", "delete"} and min(kinds.values()) > 100
    planted = "\\### Assistant: </turn> ok"
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"] or "") for r in table.collect()] + [(-7, 0, "user", planted), (-7, 1, "assistant", planted)]
    want = {}
    for conv, _, role, text in sorted(rows):
        want.setdefault(conv, []).append((role, text))
    got = {r["conv_id"]: r for r in registry.queries()["op5_chat_format"](spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == set(want)
    for conv, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def brute_features(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, covered = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(j for i in at for j in range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, edge, none):
    from glossmill.llm.quality_rules import FEATURES, Rules, log_probabilities

    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(edge, allowMissingColumns=True)
    texts = {(r["doc_id"], r["text"] or "") for r in docs.collect()}
    want = sorted((i or -1, *brute_features(t)) for i, t in texts)
    rules = Rules(docs, least=20)
    rows = rules.score().collect()
    assert sorted({(r["doc_id"] or -1, *[r[k] for k in FEATURES]) for r in rows}) == want
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in rows)
    kept = rules.keep_clean(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert np.mean(clean) > 0.98
    # Probabilities after a context sum to one.
    for context in (b"n th", b"\n\n\n\n", b"zzzz"):
        code = (int.from_bytes(context, "big") << 8) | np.arange(256)
        assert np.exp(log_probabilities(rules.model.value, code)).sum() == pytest.approx(1.0, abs=1e-4)
    assert Rules(none).score().count() == 0
    other = rules.keep_clean(docs.filter("doc_id % 2 = 0"))  # documents that the model wasn't fitted on are scored
    assert {r["doc_id"] for r in other.collect()} == {r["doc_id"] for r in rows if r["kept"] and r["doc_id"] is not None and r["doc_id"] % 2 == 0}


def brute_kneser_ney(counts, order):
    """Interpolated modified Kneser-Ney over tuples of bytes: a function (context, byte) -> probability."""
    tables = {order: dict(counts)}
    for m in range(order - 1, 0, -1):
        tables[m] = {}
        for g in tables[m + 1]:
            tables[m][g[1:]] = tables[m].get(g[1:], 0) + 1
    cuts = {}
    for m, t in tables.items():
        n1, n2, n3, n4 = (sum(v == k for v in t.values()) for k in (1, 2, 3, 4))
        y, r = n1 / (n1 + 2 * n2) if n1 else 0.5, lambda a, b: a / b if b else 0.5
        cuts[m] = [0, *(min(max(d, 0.05), k) for k, d in ((0.95, 1 - 2 * y * r(n2, n1)), (1.95, 2 - 3 * y * r(n3, n2)), (2.95, 3 - 4 * y * r(n4, n3))))]

    def p(context, x):
        m = len(context) + 1
        below = p(context[1:], x) if m > 1 else 1 / 256
        own = {g: v for g, v in tables[m].items() if g[:-1] == context}
        if not own:
            return below
        total = sum(own.values())
        c = own.get((*context, x), 0)
        return max(c - cuts[m][min(c, 3)], 0) / total + sum(cuts[m][min(v, 3)] for v in own.values()) / total * below

    return p


def test_kneser_ney(spark):
    from glossmill.llm.quality_rules import ORDER, count_grams, grams, kneser_ney, log_probabilities

    texts = ["the cat sat on the mat", "the cat ate the rat that sat on the hat", "éa", "", None, "a cat and a hat"]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").repartition(3)
    counted = count_grams(docs, "text", "lang", lambda lang, data, offsets, code: np.ones(len(lang), bool))
    want = {}
    for t in texts:
        data = b"\n" * (ORDER - 1) + (t or "").encode()
        for i in range(len(data) - ORDER + 1):
            g = tuple(data[i : i + ORDER])
            want[g] = want.get(g, 0) + 1
    assert {tuple(r["gram"].to_bytes(ORDER, "big")): r["n"] for r in counted.collect()} == want
    p = brute_kneser_ney(want, ORDER)
    tests = [*want, *[tuple(b"he ca"), tuple(b"zzzzz"), tuple(b" catx"), tuple(b"xxthe"), tuple(b"\n\n\n\nq")]]
    code = np.array([int.from_bytes(bytes(g), "big") for g in tests], np.int64)
    got = np.exp(log_probabilities(kneser_ney(counted, share=0.0), code))
    assert got == pytest.approx([p(g[:-1], g[-1]) for g in tests], rel=1e-5)
    stored = kneser_ney(counted, share=0.02)
    total = sum(want.values())
    assert all(len(stored["gram", m][0]) <= 50 for m in range(1, ORDER + 1)) and len(stored["gram", ORDER][0]) == sum(v >= 0.02 * total for v in want.values())
    for context in (b"the ", b" cat", b"zzzz"):
        assert np.exp(log_probabilities(stored, (int.from_bytes(context, "big") << 8) | np.arange(256))).sum() == pytest.approx(1.0, abs=1e-4)
    data = np.frombuffer(b"abcdefab", np.uint8)
    assert grams(data, np.array([0, 6, 8]))[6] == int.from_bytes(b"\n\n\n\na", "big")


def test_quality_rules_reject_junk(spark):
    from glossmill.llm.quality_rules import Rules

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = Rules(docs).score().join(labels, "doc_id").filter("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    kept = dict(map(tuple, rows))
    assert kept[1] > 0.99 and kept[0] < 0.1


def test_quality_rules_rare_language(spark):
    from glossmill.llm.quality_rules import Rules

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    few = docs.filter("lang = 'es'").orderBy(F.xxhash64("doc_id")).limit(60)
    rules = Rules(docs.filter("lang <> 'es'").unionByName(few))
    assert set(rules.bands) == {None, "de", "en", "es", "fr"}
    clean = rules.score().join(labels.filter("quality = 1"), "doc_id").join(few.select("doc_id"), "doc_id").filter("NOT base_failed").collect()
    assert len(clean) >= 10 and np.mean([r["kept"] for r in clean]) > 0.9


def test_language_id(spark, edge, none):
    from glossmill.llm.language_id import Languages, codewords

    for k in (1, 2, 4, 7, 20):
        c = codewords(k)
        assert len({tuple(r) for r in c}) == k
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = Languages(docs, rest != 2)
    got = model.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").filter(rest == 2).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in model.predict(edge).collect()}
    assert all(odd[i] == ("und", 0.0) for i in (1, 2, 8, 9)) and odd[7][0] != "und"
    assert model.keep_known(edge).columns == edge.columns
    assert model.predict(none).count() == 0
    assert {r["lang_pred"] for r in Languages(none, F.lit(True)).predict(edge).collect()} == {"und"}


def test_sampled_shares(spark):
    from glossmill.llm.hashed import sampled

    sizes = {"a": 9000, "b": 3000, "c": 40}
    rows = spark.createDataFrame([(f"{k}{i}", k) for k, n in sizes.items() for i in range(n)], "id string, label string")
    got = {r["label"]: r["count"] for r in sampled(rows, "label", 1040, F.col("id")).groupBy("label").count().collect()}
    assert got["c"] == 40 and all(abs(got[k] - 500) < 100 for k in "ab")
    assert sampled(rows, "label", 20_000, F.col("id")).count() == 12_040
    many = spark.range(5000).select("id", F.col("id").cast("string").alias("label"))
    assert 400 < sampled(many, "label", 500, F.col("id")).count() < 600
    assert sampled(rows.limit(0), "label", 10, F.col("id")).count() == 0


def test_quality_knn_brute_force(spark):
    """Scores of the query's operator against cosines and votes made one document at a time."""
    from glossmill.llm import quality_knn as K

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = K.Voters(docs, labels, F.lit(True), near=9)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {r["doc_id"]: r["score"] for r in model.score(docs).collect()}
    marked = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] in (0, 1) and r["doc_id"] in texts}
    assert sorted(model.labels) == sorted(marked.values())

    def grams(text):
        data = text.encode()
        low = bytes(x + 32 if 65 <= x <= 90 else x for x in data)
        x = np.zeros(K.WIDTH)
        for size in (2, 3):
            for i in range(len(data) - size + 1):
                x[((int.from_bytes(data[i : i + size], "big") * 2654435761 % (1 << 32)) >> 8) % K.WIDTH] += 1
        w = re.findall(rb"[^\x20\x09-\x0D]+", data)
        n, same, distinct = len(w), sum(a == b for a, b in zip(w, w[1:], strict=False)), len(set(w))
        extra = [n > 0, *[same / max(n, 1) > t for t in (0.05, 0.15, 0.3, 0.6)], *[distinct / max(n, 1) < t and n > 30 for t in (0.15, 0.25, 0.35, 0.5)], *[n < t for t in (5, 20, 40)]]
        return np.concatenate([np.log1p(x), np.array(extra, float)]), low

    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    for i in sorted(texts)[::5]:
        x = unit(unit(grams(texts[i])[0] * model.idf) @ model.axes)
        cosines = [float(x @ v) for v in model.vectors]
        top = sorted(range(len(cosines)), key=lambda k: -cosines[k])[:9]
        weights = [max(cosines[k], 1e-6) ** 8 for k in top]
        assert got[i] == pytest.approx(sum(w * model.labels[k] for w, k in zip(weights, top, strict=True)) / sum(weights), abs=2e-3)


def test_language_id_brute_force(spark):
    """Decoded languages and scores against losses summed bit by bit."""
    from glossmill.llm import language_id as L

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.Languages(docs, F.lit(True))
    got = {r["doc_id"]: r for r in model.predict(docs).collect()}
    for r in docs.collect()[::4]:
        text = r["text"] or ""
        if not any(c.isalpha() for c in text):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        data = bytearray(text.encode())
        for i, x in enumerate(data):  # A-Z and capitals of Latin-1
            if 65 <= x <= 90 or i and data[i - 1] == 0xC3 and 0x80 <= x <= 0x9E and x != 0x97:
                data[i] += 32
        x = np.zeros(L.WIDTH)
        for size in (1, 2, 3):
            for i in range(len(data) - size + 1):
                x[((int.from_bytes(data[i : i + size], "big") * 2654435761 % (1 << 32)) >> 8) % L.WIDTH] += 1
        x = np.sqrt(x) / np.linalg.norm(np.sqrt(x))
        losses = []
        for word in model.code:
            loss = 0.0
            for bit, sign in enumerate(word):
                margin = float(x @ model.weights[:, bit]) + float(model.bias[bit])
                loss += np.log1p(np.exp(-4 * margin * sign)) * model.bit_weight[bit]
            losses.append(loss)
        share = np.exp(-np.array(losses)) / np.exp(-np.array(losses)).sum()
        best = int(share.argmax())
        row = got[r["doc_id"]]
        assert row["lang_pred"] == model.languages[best] and row["score"] == pytest.approx(share[best], abs=1e-3) and row["ambiguous"] == (row["score"] < model.sure)


def test_quality_knn(spark, edge, none):
    from glossmill.llm.quality_knn import Voters

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = Voters(docs, labels, rest != 0)
    got = model.score(docs).join(labels, "doc_id").filter(rest == 0).collect()
    assert np.mean([(r["score"] >= 0.3) == (r["quality"] == 1) for r in got]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in model.score(edge).collect())
    assert model.score(none).count() == 0
    assert {r["score"] for r in Voters(docs.limit(0), labels, F.lit(True)).score(edge).collect()} == {0.5}


def test_lm_score(spark, edge, none):
    from glossmill.llm.lm_score import score

    # One block, blocks that end within texts; all words frequent, some, none; rows in another order at every reading.
    for kind in ({}, {"block": 50}, {"block": 7, "share": 0.01}, {"share": 1.0}, {"random": True}):
        docs = edge.repartition(3).orderBy(F.rand()) if kind.pop("random", False) else edge
        got = sorted(((r["doc_id"] or -1), r["n_words"], round(r["log_score"], 6)) for r in score(docs, **kind).collect())
        split = [(i or -1, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t, *_ in EDGE]
        split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in split]
        c1, c2 = {}, {}
        for _, w in split:
            for k, x in enumerate(w):
                c1[x] = c1.get(x, 0) + 1
                if k:
                    c2[w[k - 1], x] = c2.get((w[k - 1], x), 0) + 1
        n = sum(c1.values())
        want = []
        for i, w in split:
            s = 0.0
            for k, x in enumerate(w):
                if k and c2[w[k - 1], x] >= 2:
                    s += np.log(c2[w[k - 1], x] / c1[w[k - 1]])
                else:
                    s += np.log((0.4 if k else 1) * c1[x] / n)
            want.append((i, len(w), round(float(s), 6)))
        assert got == sorted(want)
    assert score(none).count() == 0


def test_simhash(spark, edge, none):
    import xxhash

    from glossmill.llm.simhash_dedup import assign, bucket_edges, one_of_each, pivot_columns, reference_fingerprints, within

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").unionByName(edge, allowMissingColumns=True)

    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hs) > len(hs)) if hs else 0

    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    some = {i: f"{brute(t):016x}" for i, t in sorted(texts, key=str)[:150]}
    for most in (2048, 4):  # with and without split buckets
        rows = assign(docs, most=most).collect()
        fps = {r["doc_id"]: r["fingerprint"] for r in rows if r["doc_id"] is not None}
        assert all(fps[i] == x for i, x in some.items() if i is not None and sum(j == i for j, _ in texts) == 1)
        value = np.array([int(r["fingerprint"], 16) for r in rows], np.uint64)
        ids = [r["doc_id"] for r in rows]
        root = list(range(len(rows)))
        for i in range(len(rows)):
            for j in np.flatnonzero(np.bitwise_count(value[:i] ^ value[i]) <= 3):
                a, b = root[i], root[j]
                if a != b:
                    root = [min(a, b) if x in (a, b) else x for x in root]
        least = {}
        for x, i in zip(root, ids, strict=True):
            least[x] = min((v for v in (least.get(x), i) if v is not None), default=None)
        assert [r["component_id"] for r in rows] == [least[x] for x in root]
    stay = one_of_each(docs)
    assert stay.columns == docs.columns and stay.count() == len(least)
    assert assign(none).count() == 0
    rng = np.random.default_rng(2)  # one dense bucket: spanning edges keep every link
    centre = rng.integers(0, 1 << 62)
    fp = np.unique(np.array([centre ^ sum(1 << int(b) for b in rng.choice(60, rng.integers(0, 4), False)) for _ in range(400)], np.int64))
    pivots = reference_fingerprints(16)
    frame = spark.createDataFrame([(int(x),) for x in fp], "fp bigint")
    table = [np.array([r[0] for r in frame.select(c).collect()], np.int64) for c in pivot_columns(F.col("fp"), pivots)]
    assert (table[1].view(np.uint8).reshape(-1, 8) == np.bitwise_count(fp.view(np.uint64)[:, None] ^ pivots[None, 8:])).all()
    x, y = (rng.integers(0, 65, (5000, 8)).astype(np.uint8) for _ in range(2))
    y[::2] = np.clip(x[::2].astype(int) + rng.integers(-4, 5, x[::2].shape), 0, 64)
    assert (within(x.view(np.uint64).ravel(), y.view(np.uint64).ravel(), 3) == (np.abs(x.astype(int) - y).max(axis=1) <= 3)).all()
    a, b = bucket_edges(np.zeros(len(fp), np.int64), fp, 3, table)
    assert len(a) < len(fp) and all(bin(int(x) ^ int(y)).count("1") <= 64 for x, y in zip(a, b, strict=True))
    label = {int(x): int(x) for x in fp}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        old, new = label[x], label[y]
        label = {k: new if v == old else v for k, v in label.items()}
    unsigned = fp.view(np.uint64)
    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(unsigned ^ unsigned[i]) <= 3):
            assert label[int(fp[i])] == label[int(fp[j])]


def test_simhash_keeps_texts_of_null_and_shared_ids(spark):
    from glossmill.llm.simhash_dedup import one_of_each

    text = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(None, text(1)), (None, text(2)), (None, text(3)), (None, text(3)), (5, text(4)), (5, text(5)), (6, text(4)), (7, text(1)), (8, text(6)), (8, text(6)), (9, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("_nth", "digest", "gone_id", "root", "stays", "fp")}).repartition(3)
    got = one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"] or "") for r in got.collect()), key=str) == sorted([(7, text(1)), (None, text(2)), (None, text(3)), (5, text(4)), (5, text(5)), (8, text(6)), (9, "")], key=str)
    assert one_of_each(docs.limit(0)).count() == 0


def test_simhash_dense_bucket(spark):
    from glossmill.llm.simhash_dedup import buckets, links

    rng = np.random.default_rng(3)
    high = np.int64(0x1234) << 48  # 100,000 fingerprints that agree on one block
    value = np.unique(high | rng.integers(0, 1 << 48, 100_000))
    pairs = [(int(v), int(v) ^ (1 << int(k)) ^ (1 << int(j))) for v, k, j in zip(value[:50], rng.integers(0, 20, 50), rng.integers(24, 47, 50), strict=True)]
    frame = spark.createDataFrame([(int(x),) for x in np.unique(np.concatenate([value, np.array(pairs).ravel()]))], "fp bigint")
    assert buckets(frame, 3, 2048).groupBy("bucket").count().agg(F.max("count")).first()[0] <= 2048
    found = {frozenset((r["a"], r["b"])) for r in links(frame).collect()}
    assert all(frozenset(p) in found for p in pairs)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ('<p>a &amp; b<br>c  d</p><div class="ad">x</div><p>e', "a & b c d\n\ne"), ("<nav><ul><li>m</li></ul></nav><main><h1>T</h1>t1<p>u<b>v</b>w</main>after", "T\n\nt1\n\nuvw"),
        ('<div class="page has-sidebar"><p>Real text</p></div>', "Real text"), ('<article class="post no-sidebar"><div class="share-price">9 up</div>x</article>', "9 up\n\nx"),
        ('<p>before</p><svg class="i"/><p>after</p>', "before\n\nafter"), ('<p>a <iframe src="x"/>b<object data="y"/> c</p><title/>d', "a b c\n\nd"), ("<p>a <button>go</button>b</p>", "a b"),
        ('<article>x<section class="comments"><article>c</article></section></article><div id="comments"><article>d</article></div>', "x"), ('<div class="site-footer">f</div><p data-class="ad">y', "y"),
        ('<article><p>x</p><div class="comments"><div>c</div><p>d</p></div><p>y &lt; z</p></article>', "x\n\ny < z"), ('<div id=cookie-notice>n<div>k</div></div>txt<script>var a="<p>"</script>', "txt"),
        ("<aside>never <article><p>in</p></article>", "in"), ("<body><header>h</header><p>a<p>b<form><input>f</form></body><footer>z", "a\n\nb"),
    ],
)
def test_html_lines(spark, page, want):
    from glossmill.llm.html_extract import extract

    df = spark.createDataFrame([(1, None, page)], "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    row = extract(df).first()
    assert (row["text"], row["n_chars"]) == (want, len(want))


def test_html_differencing(spark):
    from glossmill.llm.html_extract import extract

    frame = "<div>Home of the Example Gazette</div><div>{}</div><div>All rights held by us</div>"
    body = lambda k: "</div><div>".join(f"Story {k} has paragraph {j} with words of its own number {k * 7 + j}" for j in range(6))
    pages = [(k, f"http://h.example/a/{k}?x=1", frame.format(body(k))) for k in range(12)]
    pages += [(100, "http://other.example/a/1", frame.format(body(1))), (101, "http://h.example/a/3#again", frame.format(body(3)))]
    for parts in (1, 5):
        df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(parts)
        got = {r["page_id"]: r["text"] for r in extract(df).collect()}
        assert all("Gazette" not in got[k] and "rights" not in got[k] and got[k].count("Story") == 6 for k in range(12))
        assert "Gazette" in got[100]  # nothing to compare with
        assert got[3] == got[101]
    assert extract(df.limit(0)).count() == 0
    # An article beside plain text; a stub on a heavy template beside a long page; a passage that two articles share.
    story = lambda k, n: "".join(f"<p>Page {k} says {j * 13 + k} things of its own here</p>" for j in range(n))
    bar = "<div>" + "</div><div>".join(f"Template line {j} which every page of this host carries" for j in range(9)) + "</div>"
    html = {1: f"<article>teaser 1</article>{bar}{story(1, 5)}", 2: f"<article>teaser 2</article>{bar}{story(2, 5)}", 11: bar + story(11, 6), 12: bar + story(12, 60)}
    html |= {21: f"<article>{story(21, 4)}<p>One passage that both quote</p></article>", 22: f"<article>{story(22, 4)}<p>One passage that both quote</p></article>"}
    df = spark.createDataFrame([(k, f"http://h{k // 10}.example/{k}", v) for k, v in html.items()], "page_id bigint, url string, html string")
    found = {r["page_id"]: r for r in extract(df).collect()}
    assert all("Template" not in r["text"] for r in found.values()) and all(found[k]["n_shared"] == 9 for k in (1, 2, 11, 12))
    assert found[1]["text"].count("says") == 5 and "teaser 1" in found[1]["text"] and found[11]["text"].count("says") == 6 and found[12]["text"].count("says") == 60
    assert all(found[k]["text"].endswith("One passage that both quote") and found[k]["text"].count("says") == 4 for k in (21, 22))


def brute_extract(pages):
    """Main texts of the synthetic pages: the blocks of their article elements; and the lines that differencing deletes."""
    texts = {}
    for r in pages:
        body = "".join(re.findall(r"<article>(.*?)</article>", r["html"], re.S))
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", re.sub(r"</?b>", "", body)))
        texts[r["page_id"]] = "\n\n".join(x for x in (" ".join(html_lib.unescape(b).split()) for b in blocks) if x)
    return texts


def test_html_extract_table(spark):
    from glossmill.llm.html_extract import INSIDE, common, extract, lines

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = brute_extract(pages.collect())
    results = []
    for parts in ("3", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append({r["page_id"]: (r["text"], r["n_shared"]) for r in extract(pages.repartition(int(parts))).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert results[0] == results[1] and {k: t for k, (t, _) in results[0].items()} == want
    # Deleted lines, from the pairs in order and a plain alignment.
    def order(r):
        host, path = re.match(r"https?://([^/?#]*)([^?#]*)", r["url"]).groups()
        return host, re.sub(r"\d+", lambda d: d[0].zfill(12), path.rstrip("/")), r["page_id"]
    rows = sorted(((*order(r), *lines(r["html"])) for r in pages.collect()), key=lambda x: x[:3])
    total = 0
    for k, row in enumerate(rows):
        gone = set()
        for other in rows[max(0, k - 1) : k] + rows[k + 1 : k + 2]:
            if other[0] == row[0]:
                gone.update(i for i in common(row[3], other[3]) if row[4][i] != INSIDE)
        assert results[0][row[2]][1] == len(gone)
        total += len(gone)
    assert total > 0


def test_common_subsequence():
    from glossmill.llm.html_extract import common

    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (rng.integers(0, 5, rng.integers(0, 10)).tolist() for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        at = common(a, b)
        rest = iter(b)
        assert len(at) == table[-1, -1] and at == sorted(set(at)) and all(any(y == a[i] for y in rest) for i in at)


def test_components(spark):
    from glossmill.llm.components import components

    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (300, 100), (500, 500)]
    got = {r["vertex"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys((100, 200, 300), 100)


def brute_exact(rows):
    least = {}
    for i, t in rows:
        key = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        least[key] = max(i, least.get(key, i))
    return set(least.values())


def brute_near(rows):
    from glossmill.llm.simhash_dedup import fingerprint  # held against its own brute force above

    rows = sorted(rows)
    value = np.array([fingerprint(t) for _, t in rows], np.int64).view(np.uint64)
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(value[:i] ^ value[i]) <= 3):
            a, b = sorted((root[i], root[j]))
            root = [a if x == b else x for x in root]
    return {rows[x][0] for x in set(root)}


def test_pipeline(spark):
    from glossmill.llm.language_id import Languages
    from glossmill.llm.quality_rules import Rules

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    seen = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, seen, SF)
        rows = [(r["doc_id"], r["text"]) for r in seen.collect()]
        if k < 4:
            assert made.columns == docs.columns
            ids = [r["doc_id"] for r in made.collect()]
            assert len(ids) == len(set(ids))
            if name == "language_id":
                want = {r["doc_id"] for r in Languages(seen, rest != 2).predict(seen).filter("NOT ambiguous").collect()}
            elif name == "quality_rules":
                want = {r["doc_id"] for r in Rules(seen).score().filter("kept").collect()}
            else:
                want = brute_exact(rows) if name == "exact_dedup" else brute_near(rows)
            assert set(ids) == want, name
            seen = spark.createDataFrame(made.toPandas(), docs.schema)
    kept = {r["doc_id"] for r in seen.collect()}
    assert {r["doc_id"] for r in made.collect()} == kept
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()} == kept


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    place = [want.columns.index(c) for c in order]
    assert sorted(tuple(r[c] for c in order) for r in df.collect()) == sorted(tuple(r[i] for i in place) for r in want.fetchall())
