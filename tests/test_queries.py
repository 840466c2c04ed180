"""Every registered query against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest
from conftest import SF

from glossmill.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if glob.glob(f"{SF}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.7g}")
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")
@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, duck, name):
    df = Q.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    sql = Q.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows(want.columns, want.fetchall())


def test_partitions_do_not_matter(spark):
    from pyspark.sql import functions as F

    from glossmill.operators import corpus, pairs

    docs = Q.view(spark, SF, Q.ANNOTATIONS.replace('"end"', "`end`")).withColumn("synsets", F.array("synset")).drop("synset")
    runs = []
    for shuffled in (docs.repartition(1), docs.orderBy(F.rand(3)).repartition(7)):
        same = pairs.same_pairs(pairs.usable_annotations(shuffled))
        split = corpus.split(shuffled, ["doc_id"])
        runs.append((sorted(map(str, same.collect())), sorted((r["doc_id"], r["split"]) for r in split.collect())))
    assert runs[0] == runs[1]
