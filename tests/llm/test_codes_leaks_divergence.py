"""Operators 11 to 13 against brute force and at their edges, and operator 2's plans."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

DOCS = "doc_id bigint, text string, lang string, source string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- operator 11


def brute_codes(table, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, label, [math.floor(x * scale) if abs(x) < 1e300 else int(x) * scale for x in v]) for i, label, v in table if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, _, v in kept), default=0) // parts) * parts
    size = width // parts
    kept = [(i, label, v + [0] * (width - len(v))) for i, label, v in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for _, _, v in first] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            of = defaultdict(list)
            for _, _, v in kept:
                of[nearest(p, v)[1]].append(cut(v, p))
            new.append([[sum(c) // len(of[k]) for c in zip(*of[k], strict=True)] if k in of else e for k, e in enumerate(books[p])])
        books = new
    text = ",".join(str(x) for b in books for e in b for x in e)
    found = [(i, label, [nearest(p, v) for p in range(parts)]) for i, label, v in kept]
    errors = [sum(d for d, _ in n) for _, _, n in found]
    fits = lambda x: x if x < 1 << 63 else None
    totals = defaultdict(int)
    for (_, label, _), e in zip(found, errors, strict=True):
        totals[label] += e
    return sorted(
        ((i, "".join(f"{k:02x}" for _, k in n), fits(e), fits(totals[label]), hashlib.sha256(text.encode()).hexdigest()) for (i, label, n), e in zip(found, errors, strict=True)), key=repr
    )


def codes(df, **how):
    from glossmill.llm.vector_codes import encode

    return sorted((tuple(r) for r in encode(df, **how).collect()), key=repr)


VECTORS = "vec_id bigint, embedding array<double>, label int"


@pytest.mark.parametrize("spread", [1.0, 30.0, 1e12, 1e305])
def test_codes(spark, spread):
    rng = random.Random(int(spread) % 97)
    table = [(i, [rng.gauss(0, 1) * spread * (1 + i % 3) for _ in range(8)], rng.choice([1, 1, 1, 2, None])) for i in range(90)]
    table += [(200, [0.0] * 8, 2), (200, [0.0] * 8, 2), (201, [-0.0001] * 8, 3), (None, [spread / 7] * 8, 3), (5, [1.5 * spread] * 8, 3)]  # ties, repeats, no id
    table += [(300 + k, v, 1) for k, v in enumerate((None, [1.0] * 7 + [None], [math.nan] * 8, [math.inf] + [0.0] * 7, [-math.inf] * 8))]
    df = spark.createDataFrame(table, VECTORS).selectExpr("*", "'clash' AS code", "'clash' AS id", "'clash' AS vector", "'clash' AS part", "'clash' AS n").repartition(4)
    assert codes(df, entries=16) == brute_codes([(i, label, v) for i, v, label in table], entries=16)


def test_codes_odd_shapes(spark):
    shapes = [(1, [1.0, 2.0, 3.0], 1), (2, [1.0] * 6, 1), (3, [], 1), (4, [5.0] * 5, None), (4, [5.0] * 5, None)]
    assert codes(spark.createDataFrame(shapes, VECTORS)) == brute_codes([(i, label, v) for i, v, label in shapes])
    assert codes(spark.createDataFrame([(1, [], None), (2, [], None)], VECTORS)) == brute_codes([(1, None, []), (2, None, [])])
    assert codes(spark.createDataFrame([], VECTORS)) == [] == codes(spark.createDataFrame([(1, None, 1)], VECTORS))
    floats = spark.createDataFrame([(i, [i / 7, -i / 3, 0.1, 2.5], i % 2) for i in range(20)], "vec_id int, embedding array<float>, label int")
    exact = [(r["vec_id"], r["label"], list(r["embedding"])) for r in floats.collect()]
    assert codes(floats, entries=4) == brute_codes(exact, entries=4)


def test_codes_many_labels(spark):
    from glossmill.llm.vector_codes import _with_totals

    coded = spark.range(600).selectExpr("id", "CASE WHEN id % 3 = 0 THEN -1 WHEN id % 50 = 1 THEN NULL ELSE id END AS label", "id AS error")
    totals = coded.groupBy("label").agg({"error": "sum", "id": "count"}).toDF("label", "label_error", "n")
    plain, split = (sorted((r["id"], r["label_error"]) for r in _with_totals(coded, totals, most).collect()) for most in (100_000, 5))
    assert plain == split and len(plain) == 600


def test_pruning_loses_nothing():
    import numpy as np

    from glossmill.llm.vector_codes import Codebook

    rng = np.random.default_rng(3)
    entries = rng.integers(-300, 300, (64, 5))
    entries[40:] = entries[:24]  # ties
    parts = np.concatenate([rng.integers(-900, 900, (500, 5)), entries[30:60]]).astype(float)
    index, distance = Codebook(entries.tolist()).nearest(parts)
    every = ((parts[:, None] - entries) ** 2).sum(2)
    assert (index == every.argmin(1)).all() and (distance == every.min(1)).all()


# --- operator 12


def brute_leaks(docs, items, width=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    wins = defaultdict(set)
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - width + 1) if w else 0):
            wins[tuple(w[s : s + width])].add("" if item is None else str(item))
    found = []
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for size in {len(x) for x in wins}:
            for s in range(len(w) - size + 1):
                if tuple(w[s : s + size]) in wins:
                    hit |= set(range(s, s + size))
                    names |= wins[tuple(w[s : s + size])]
        found.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(found, key=repr)


ITEMS = [
    (1, "One two three four five six seven eight nine ten eleven twelve"), (10, "short item"), (2, "solo"), (3, None), (4, "... !!"), (None, "an item without any id"), (5, "the " * 14), (6, "a b a b a b a b a b a b"),
    (7, "one TWO three four five six seven eight nine ten eleven twelve"), (7, "its second text"), (8, "été À l'École 日本語 words"), (9, "zzz never seen anywhere at all in the corpus of documents"),
]
TEXTS = [
    (1, "x one two three four five six seven eight nine ten eleven twelve y"), (2, "one two three four five six seven eight nine, TEN!"), (2, "one two three four five six seven eight nine, TEN!"),
    (3, "one two three four five six seven eight nine"), (4, None), (5, ""), (6, "SHORT-item solo"), (None, "an item without any id; short, item"), (7, "the " * 40), (8, "b " + "a b " * 9), (9, "été À l'École 日本語 words"),
    (10, "ÉTÉ À l'École"), (11, "filler word " * 20_000 + "two three four five six seven eight nine ten eleven " + "filler " * 5_000 + "its second text"), (12, "two one three four five six seven eight nine ten"),
    (13, "solo " * 50),
]


def leaks(spark, docs, items, **how):
    from glossmill.llm.decontaminate import contamination

    a = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'clash' AS key", "'clash' AS term", "'clash' AS words", "'clash' AS pos").repartition(3)
    b = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "'clash' AS item", "'clash' AS words", "'clash' AS text_id")
    return sorted((tuple(r) for r in contamination(a, b, **how).collect()), key=repr)


@pytest.mark.parametrize("few", [1_000_000, 1])
def test_leaks(spark, monkeypatch, few):
    """few=1: nothing may be broadcast, every step is an ordinary join."""
    from glossmill.llm import decontaminate

    monkeypatch.setattr(decontaminate, "_FEW", few)
    assert leaks(spark, TEXTS, ITEMS) == brute_leaks(TEXTS, ITEMS)


def test_leaks_random_and_empty(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choices("abcde", [9, 5, 3, 1, 1], k=n))
    items = [(k, text(rng.randint(1, 16))) for k in range(12)]
    docs = [(k, text(rng.randint(0, 400))) for k in range(40)]
    assert leaks(spark, docs, items, width=6) == brute_leaks(docs, items, 6)
    assert leaks(spark, [], items) == [] and leaks(spark, docs, []) == brute_leaks(docs, [])


def test_proximity(spark):
    from glossmill.llm import decontaminate as D

    docs = [(1, "ten x eight seven y six five four three two one"), (2, "one two three " + "far " * 60 + " four five six seven eight ten"), (3, "solo here"), (4, "solo and ten")]
    items = [(1, "one two three four five six seven eight ten"), (2, "solo")]
    texts, members = D.test_texts(spark.createDataFrame(items, "item_id int, text string"))
    terms = D.vocabulary(texts)
    documents, postings = D.index(spark.createDataFrame(docs, "doc_id int, text string"), terms)
    near = D.proximity(texts, terms, postings, reach=20).join(documents, "key").join(members, "text_id")
    assert {(r["doc_id"], r["item"]) for r in near.collect()} == {(1, "1"), (3, "2"), (4, "2")}


def test_leaks_without_python(spark):
    """[native]: no Python, pandas or Arrow node in any plan of the main path."""
    from glossmill.llm.decontaminate import contamination

    made = contamination(spark.createDataFrame(TEXTS, "doc_id bigint, text string"), spark.createDataFrame(ITEMS, "item_id bigint, text string"))
    assert not re.search("Python|Pandas|Arrow", made._jdf.queryExecution().toString())


# --- operator 13


def brute_audit(docs, least=30, top=50, smooth=5, scale=1_000_000_000):
    counts, spread = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        counts[lang or "", source or ""].update(terms)
        spread[lang or ""].update(set(terms))
    kept = {lang: {t for t, n in c.items() if n >= least} for lang, c in spread.items()}

    def shares(count, terms):
        total = sum(count[t] for t in terms)
        return {t: 1 + scale * (count[t] + smooth) // (total + smooth * len(terms)) for t in terms}

    found, p = [], {g: shares(c, kept[g[0]]) for g, c in counts.items()}
    for (lang, source), own in p.items():
        q = shares(sum((c for g, c in counts.items() if g[0] == lang), Counter()), kept[lang])
        pairs = [(sum(abs(own[t] - other[t]) for t in own), s) for (x, s), other in p.items() if x == lang and s != source]
        terms = [(own[t] - q[t], t) for t in own if counts[lang, source][t] and own[t] > q[t]]
        for part, ranked, most in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(ranked, key=lambda r: (-r[0], r[1].encode()))[:most]
            found += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(found)


@pytest.mark.parametrize("few", [100_000, 0])
def test_audit(spark, monkeypatch, few):
    from glossmill.llm import divergence

    monkeypatch.setattr(divergence, "bounded", lambda df, most=few: df)
    rng = random.Random(4)
    vocabulary = [f"Wort{chr(97 + k % 26)}{chr(97 + k // 26)}é" for k in range(80)] + ["THE", "the", "日本", "x_y", "a1b"]
    docs = [
        (k, " ".join(rng.choices(vocabulary, [1 / (1 + j) for j in range(len(vocabulary))], k=rng.randint(0, 60))), rng.choice(["en", "en", "de", None]), rng.choice(["hot"] * 5 + ["a", "b", None, ""]))
        for k in range(300)
    ]
    docs += [(1, None, "en", "silent"), (2, "", "fr", "only"), (3, "123 !!", "it", "one"), (3, "rare word", "it", "two"), (None, "the " * 40_000, "en", "long"), (5, "same", "de", "a"), (5, "same", "de", "a")]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "'clash' AS term", "'clash' AS words", "1 AS n", "1 AS rank").repartition(3)
    for least, top in ((30, 50), (3, 4)):
        assert sorted(tuple(r) for r in divergence.audit(df, least, top).select("lang", "source", "part", "item", "value", "rank").collect()) == brute_audit(docs, least, top)
    assert divergence.audit(df.limit(0)).count() == 0


# --- operator 2: the program's plan, and many repeated rows


@pytest.mark.parametrize("case", ["lognormal", "short", "long", "steps"])
def test_the_programs_plan_stands(case):
    import numpy as np

    from glossmill.llm.packing import _best_fit, _sequences, plan

    rng = np.random.default_rng(7)
    lengths = {
        "lognormal": rng.lognormal(6.1, 1.0, 40_000), "short": rng.integers(1, 300, 40_000), "long": rng.integers(600, 1500, 20_000), "steps": rng.choice([300, 500, 700, 900, 1200], 20_000),
    }[case]
    histogram = np.bincount(lengths.astype(int).clip(1, 2048), minlength=2049)
    made = plan(histogram, 2048)
    held = np.zeros(2049, int)
    for times, config in made:
        assert sum(length * n for length, n in config.items()) <= 2048
        for length, n in config.items():
            held[length] += times * n
    alone = _best_fit(histogram.copy(), 2048)
    assert (held == histogram).all() and _sequences(made) <= _sequences(alone) and (made != alone or case == "long")  # hardly any two long pieces meet


def test_packing_repeated_rows(spark):
    """Half of the rows are one document, and one length holds nearly all."""
    from glossmill.llm.packing import pack

    docs = spark.range(4000).selectExpr("CASE WHEN id % 2 = 0 THEN NULL ELSE id END AS doc_id", "CASE WHEN id % 2 = 0 THEN NULL WHEN id % 100 = 1 THEN repeat('word ', 300) ELSE '' END AS text").repartition(5)
    placed = {}
    for r in pack(docs).collect():
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(map(len, placed.values())) == 4000
    for spans in placed.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
