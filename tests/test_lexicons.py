"""Lexicon files of both formats give one schema; two lexicons never meet."""

import pytest
from pyspark.sql import functions as F

from glossmill.operators import lexicon as L
from glossmill.sources import lexicons

LICENCE = "  1 This software and database is being provided to you  \n  2 under a licence  \n"
DATA = {
    "noun": """00000100 03 n 02 animal 0 animate_being 0 001 ~ 00000200 n 0000 | a living organism; "the animals | left"
00000200 05 n 02 dog 0 domestic_dog 0 003 @ 00000100 n 0000 #m 00000300 n 0000 @i 00000300 n 0000 | a member of the genus Canis; "the dog barked all night"; common since prehistoric times
00000300 14 n 01 pack 0 000 | a group of hunting animals
00000400 18 n 0a dog 1 a1 0 a2 0 a3 0 a4 0 a5 0 a6 0 a7 0 a8 0 a9 0 001 @ 00000100 n 0000 | a dull unattractive person
""",
    "verb": "00000500 38 v 01 dog 0 001 @ 00000600 v 0000 02 + 08 00 + 21 00 | go after with the intent to catch\n00000600 38 v 01 follow 0 000 01 + 08 00 | to travel behind\n",
    "adj": '00000700 00 a 01 hot(p) 0 001 & 00000800 s 0000 | of high temperature\n00000800 00 s 02 fiery 0 hot 1 001 & 00000700 a 0000 | hot as fire; "fiery"\n',
    "adv": "00000900 02 r 01 Well 0 000 | in a good manner\n",
}
INDEX = {
    "noun": "animal n 1 2 @ ~ 1 1 00000100  \nanimate_being n 1 1 ~ 1 0 00000100  \ndog n 2 2 @ ~ 2 1 00000200 00000400  \ndomestic_dog n 1 1 @ 1 0 00000200  \npack n 1 0 1 0 00000300  \n",
    "verb": "dog v 1 1 @ 1 1 00000500  \nfollow v 1 0 1 1 00000600  \n",
    "adj": "fiery a 1 1 & 1 0 00000800  \nhot a 2 1 & 2 1 00000800 00000700  \n",
    "adv": "well r 1 0 1 1 00000900  \n",
}
LMF = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE LexicalResource SYSTEM "http://globalwordnet.github.io/schemas/WN-LMF-1.1.dtd">
<LexicalResource xmlns:dc="https://globalwordnet.github.io/schemas/dc/">
<Lexicon id="toy" label="Toy" language="en" email="a@b.example" license="none" version="1">
<LexicalEntry id="toy-dog-n"><Lemma writtenForm="dog" partOfSpeech="n"/><Sense id="s1" synset="toy-2-n"/><Sense id="s2" synset="toy-4-n"/></LexicalEntry>
<LexicalEntry id="toy-domestic_dog-n"><Lemma writtenForm="Domestic dog" partOfSpeech="n"/><Sense id="s3" synset="toy-2-n"/></LexicalEntry>
<LexicalEntry id="toy-animal-n"><Lemma writtenForm="animal" partOfSpeech="n"/><Sense id="s4" synset="toy-1-n"/></LexicalEntry>
<LexicalEntry id="toy-hot-s"><Lemma writtenForm="hot" partOfSpeech="s"/><Sense id="s5" synset="toy-8-s"/></LexicalEntry>
<LexicalEntry id="toy-hot-z-a"><Lemma writtenForm="hot" partOfSpeech="a"/><Sense id="s6" synset="toy-7-a"/></LexicalEntry>
<Synset id="toy-1-n" ili="i1" partOfSpeech="n" members="toy-animal-n"><Definition>a living organism</Definition></Synset>
<Synset id="toy-2-n" ili="i2" partOfSpeech="n" members="toy-domestic_dog-n toy-dog-n"><Definition>a member of the genus Canis</Definition><Definition>second</Definition><SynsetRelation relType="hypernym" target="toy-1-n"/><SynsetRelation relType="holo_member" target="toy-3-n"/><Example>the dog</Example></Synset>
<Synset id="toy-4-n" ili="i4" partOfSpeech="n" members="toy-dog-n"><Definition>a dull &amp; unattractive person</Definition><SynsetRelation relType="instance_hypernym" target="toy-1-n"/></Synset>
<Synset id="toy-7-a" ili="i7" partOfSpeech="a" members="toy-hot-z-a"><Definition>of high temperature</Definition></Synset>
<Synset id="toy-8-s" ili="i8" partOfSpeech="s" members="toy-hot-s"><Definition>hot as fire</Definition></Synset>
</Lexicon></LexicalResource>
"""


@pytest.fixture(scope="module")
def database(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("dict")
    for f in lexicons.FILES:
        (folder / f"data.{f}").write_text(LICENCE + DATA[f])
        (folder / f"index.{f}").write_text(LICENCE + INDEX[f])
    return lexicons.read_database(spark, str(folder), "toy-3.0")


@pytest.fixture(scope="module")
def lmf(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("lmf") / "toy.xml"
    path.write_text(LMF)
    return lexicons.read_lmf(spark, str(path), "toy-lmf")


def senses(table, lemma, pos):
    return [(r["synset_id"], r["definition"]) for r in table.filter((F.col("lemma") == lemma) & (F.col("pos") == pos)).orderBy("rank").collect()]


def test_database(database):
    held = database.senses
    assert senses(held, "dog", "noun") == [("dog.n.01", "a member of the genus Canis; ; common since prehistoric times"), ("dog.n.02", "a dull unattractive person")]
    assert senses(held, "domestic_dog", "noun") == [("dog.n.01", "a member of the genus Canis; ; common since prehistoric times")]
    assert senses(held, "animal", "noun") == [("animal.n.01", "a living organism")]
    assert senses(held, "hot", "adj") == [("fiery.s.01", "hot as fire"), ("hot.a.02", "of high temperature")]
    assert senses(held, "well", "adv") == [("well.r.01", "in a good manner")] and held.count() == 12
    assert {tuple(r)[:2] for r in database.edges.collect()} == {("dog.n.01", "animal.n.01"), ("dog.n.01", "pack.n.01"), ("dog.n.02", "animal.n.01"), ("dog.v.01", "follow.v.01")}
    assert {r["synset_id"]: r["pos"] for r in database.pos.collect()}["fiery.s.01"] == "adj"
    assert {r["synset_id"]: r["name"] for r in database.names.collect()}["hot.a.02"] == "hot"


def test_lmf(lmf):
    assert senses(lmf.senses, "dog", "noun") == [("toy-2-n", "a member of the genus Canis"), ("toy-4-n", "a dull & unattractive person")]
    assert senses(lmf.senses, "domestic_dog", "noun") == [("toy-2-n", "a member of the genus Canis")]
    assert senses(lmf.senses, "hot", "adj") == [("toy-7-a", "of high temperature"), ("toy-8-s", "hot as fire")]
    assert {tuple(r)[:2] for r in lmf.edges.collect()} == {("toy-2-n", "toy-1-n"), ("toy-4-n", "toy-1-n")}
    assert {r["synset_id"]: r["name"] for r in lmf.names.collect()} == {"toy-1-n": "animal", "toy-2-n": "Domestic_dog", "toy-4-n": "dog", "toy-7-a": "hot", "toy-8-s": "hot"}


def test_one_schema(database, lmf):
    for a, b in zip(database, lmf, strict=True):
        assert [(f.name, f.dataType) for f in a.schema] == [(f.name, f.dataType) for f in b.schema]


def test_operators_over_a_read_lexicon(spark, database):
    asked = spark.createDataFrame([(1, "dog", "noun", "a dull person"), (2, "hot", "adj", "temperature")], "k int, lemma string, pos string, gloss string")
    assert {r["k"]: r["synset_id"] for r in L.snap(asked, database.senses, ["k"]).collect()} == {1: "dog.n.02", 2: "hot.a.02"}
    pair = spark.createDataFrame([("dog.n.01", "dog.n.02")], "s1 string, s2 string")
    assert L.genus(pair, L.ancestors(database.edges), L.depths(database.edges), database.pos, database.names).first()["genus"] == "animal"


def test_two_lexicons_never_meet(spark, database, lmf):
    asked = spark.createDataFrame([(1, "dog", "noun", "a dull person")], "k int, lemma string, pos string, gloss string")
    mixed = database.senses.unionByName(lmf.senses)
    for call in (lambda: L.snap(asked, mixed, ["k"]), lambda: L.inventory(mixed), lambda: L.definition_of(asked, mixed, "synset", "d"), lambda: L.ancestors(database.edges.unionByName(lmf.edges))):
        with pytest.raises(ValueError, match="two lexicons meet: toy-3.0, toy-lmf"):
            call()
    with pytest.raises(ValueError, match="two lexicons meet"):
        L.one_lexicon(database.senses, lmf.edges)
    L.one_lexicon(database.senses, database.edges, asked)
