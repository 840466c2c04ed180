"""JSON files in byte ranges, files written by many tasks, manifests and evaluation output in every form."""

import json
import random
from contextlib import contextmanager

import pytest

from glossmill.plans import schemas
from glossmill.sources import json_ranges, readers, writers


@contextmanager
def ranges(spark, size):
    """Files are read in ranges of about so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, (size, 1), strict=True):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


ODD = ["plain", "a } brace", "[x] {y}", 'quo"te', "back\\slash\\", '\\"}', "}}}}", "new\nline", "é 日本 ł", "", "{", '",{"', "x" * 300]


def made(n, seed=2):
    rng = random.Random(seed)
    return [{"k": k, "text": rng.choice(ODD), "list": [rng.choice(ODD) for _ in range(rng.randint(0, 3))], "deep": {"a": [{"b": [rng.randint(0, 9)]}], "c": None}} for k in range(n)]


SCHEMA = "k int, text string, list array<string>, deep struct<a:array<struct<b:array<int>>>,c:string>"


def plain(df):
    return sorted((json.loads(j) for j in df.toJSON().collect()), key=lambda r: r["k"])


def without_nulls(rows):
    return [{**r, "deep": {"a": r["deep"]["a"]}} for r in rows]


@pytest.mark.parametrize("size", [500, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_array_in_ranges(spark, tmp_path, size, indent):
    records = made(80)
    for name, part in (("a", records[:60]), ("b", records[60:]), ("empty", [])):
        (tmp_path / f"{name}.json").write_text(json.dumps(part, indent=indent, ensure_ascii=name == "a"))
    with ranges(spark, size):
        df = readers.read_array(spark, str(tmp_path), SCHEMA)
        assert plain(df) == without_nulls(records)
        if size == 500:
            assert df.rdd.getNumPartitions() > 10
    whole = spark.read.schema(SCHEMA).option("multiLine", True).json(str(tmp_path))
    assert sorted(map(str, df.collect())) == sorted(map(str, whole.filter("k IS NOT NULL").collect()))


def test_gz_array(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        json.dump(made(40), f)
    assert plain(readers.read_array(spark, str(tmp_path / "a.json.gz"), SCHEMA)) == without_nulls(made(40))


@pytest.mark.parametrize("text", ['{"k": 1}\n{"k": 2}', '[{"k": 1},', '[{"k": "1}]', '[{"k": 1}]\n[{"k": 2}]', '[{"k": 1}, {"k": 2', '[{"k": 1} {"k": 2}]', '{"other": [{"k": 1}]}'])
@pytest.mark.parametrize("size", [8, 1 << 20])
def test_other_forms_raise(spark, tmp_path, text, size):
    (tmp_path / "a.json").write_text(text)
    with ranges(spark, size), pytest.raises(Exception, match="aren't the records|ends inside a record"):
        readers.read_array(spark, str(tmp_path / "a.json"), "k int").collect()


def test_written_array_is_read_back(spark, tmp_path):
    records = made(120)
    df = spark.createDataFrame([json.dumps(r) for r in records], "string").selectExpr(f"from_json(value, '{SCHEMA}') AS r").select("r.*").repartition(5)
    writers.write_array(df, str(tmp_path / "out.json"), order=["k"])
    assert json.loads((tmp_path / "out.json").read_text()) == records
    writers.write_array(df.filter("k = 7").repartition(4), str(tmp_path / "out.json"))  # replaces it; most parts are empty
    assert json.loads((tmp_path / "out.json").read_text()) == [records[7]]
    writers.write_array(df.limit(0), str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text()) == [] and readers.read_array(spark, str(tmp_path / "none.json"), SCHEMA).count() == 0
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["none.json", "out.json"]


def gloss_rows(n):
    return [{"lemma": f"l{k}", "word": "w", "pos": "noun", "usage": 'a {b} "c"', "definition": "d", "gloss": f"g{k}", "filler_gloss": "", "think": None} for k in range(n)]


def test_eval_output_in_every_form(spark, tmp_path):
    rows = gloss_rows(30)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schemas.GLOSS_ROW).repartition(4)
    summary = spark.createDataFrame([(30, 0.5, float("nan"))], "n int, f1 double, cos double")
    writers.write_report(summary, df, str(tmp_path / "own.json"), order=["lemma"])
    own = json.loads((tmp_path / "own.json").read_text())
    assert own["summary"]["n"] == 30 and own["summary"]["cos"] != own["summary"]["cos"] and len(own["records"]) == 30
    nested = {"summary": {"f1": 1, "by_pos": {"noun": {"n": 3}, "verb": {}}, "levels": [1, 2]}, "records": rows}
    for name, text in {"full": json.dumps(nested, indent=2), "bare": json.dumps(rows), "lines": "\n".join(map(json.dumps, rows)), "head": json.dumps({"records": rows, "n": 1})}.items():
        (tmp_path / f"{name}.json").write_text(text)
    for name in ("own", "full", "bare", "lines", "head"):
        for size in (800, 1 << 20):
            with ranges(spark, size):
                got = sorted((r.asDict() for r in readers.read_eval(spark, str(tmp_path / f"{name}.json")).collect()), key=lambda r: int(r["lemma"][1:]))
            assert got == rows, (name, size)
    (tmp_path / "two.json").write_text('{"summary": {}, "records": [], "more": [{"lemma": "x"}]}')
    with pytest.raises(Exception, match="aren't the records"):
        readers.read_eval(spark, str(tmp_path / "two.json")).collect()


def test_manifests(spark, tmp_path):
    keys = [("a", "n", 'x "q" ]', "y [z"), ("b", "v", "é", ""), ("c", "n", "s", "t")]
    df = spark.createDataFrame([("wic", *k) for k in keys] + [("gloss", "no", "n", "", "")], "task string, lemma string, pos string, sentence1 string, sentence2 string").repartition(3)
    writers.write_manifest(df, str(tmp_path / "own.json"))
    assert sorted(map(tuple, json.loads((tmp_path / "own.json").read_text()))) == sorted(keys)
    forms = {"array": json.dumps(keys), "pretty": json.dumps(keys, indent=1), "lines": "\n".join(json.dumps(k) for k in keys) + "\n"}
    for name, text in forms.items():
        (tmp_path / f"{name}.json").write_text(text)
    for name in ("own", *forms):
        for size in (40, 1 << 20):
            with ranges(spark, size):
                assert sorted(map(tuple, readers.read_manifest(spark, str(tmp_path / f"{name}.json")).collect())) == sorted(keys), (name, size)
    (tmp_path / "none.json").write_text("[]")
    assert readers.read_manifest(spark, str(tmp_path / "none.json")).count() == 0
    for text in ('[["a", "b"]]', '{"a": 1}', '[{"lemma": "a"}]'):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(Exception, match="array of 4|aren't the records|no array"):
            readers.read_manifest(spark, str(tmp_path / "bad.json")).collect()


def test_tokens_and_states():
    assert [t for t, _ in json_ranges.tokens('{"a": "}", "b": [1]}', False)] == ["{", "[", "]", "}"]
    assert [t for t, _ in json_ranges.tokens('a "b\\\\" } c', False)] == ["}"]
    assert [t for t, _ in json_ranges.tokens('still in it \\" } ", {', True)] == ["{"]
    assert [t for t, _ in json_ranges.tokens('never ends }', True)] == ['"']


def test_values_are_read_a_megabyte_at_a_time():
    import pyarrow as pa

    from glossmill.sources import json_ranges

    values = ["x" * 1000 + str(k) for k in range(5000)]
    starts = [0] * 3000 + [77] * 2000
    batch = pa.RecordBatch.from_pydict({"file": ["f"] * 5000, "start": starts, "value": values, "alone": [False] * 5000})
    runs = list(json_ranges._runs(batch))
    assert max(sum(map(len, part)) for _, part, _ in runs) <= 1_100_000
    assert [v for _, part, _ in runs for v in part] == values and [key[1] for key, part, _ in runs for _ in part] == starts
    assert [len(p) for _, p, _ in json_ranges._runs(batch.slice(0, 3), 10)] == [1, 1, 1]  # a longer value is whole
