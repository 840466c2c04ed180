"""Operator 4 at the edges of parts: every page once, with the same text, however Spark runs the plan."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from glossmill.llm.html_extract import boundaries, extract, part_number

FRAME = "<div>Home of the Example Gazette</div>{}<div>All rights held by us</div>"


@pytest.fixture(scope="module")
def pages(spark):
    body = lambda k: "".join(f"<div>Story {k} has paragraph {j} of its own, {k * 7 + j}</div>" for j in range(4))
    rows = [(k, f"http://h{0 if k % 3 else k % 5}.example/a/{k}", FRAME.format(body(k))) for k in range(120)]
    rows += [(7, "http://h0.example/a/7", FRAME.format(body(7)))] * 3  # repeated rows
    rows += [(None, None, None), (None, "http://h0.example/a/8", FRAME.format(body(8))), (500, "", ""), (501, "not a url", "<p>text</p>"), (502, "http://h1.example/", None)]
    rows += [(600, "http://h0.example/a/60", FRAME.format("".join(f"<div>Line {j} of a very long page</div>" for j in range(30_000))))]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "path", "key", "part", "text", "up")}).repartition(4)


def found(df):
    return Counter((r["page_id"], r["url"], r["text"], r["n_chars"], r["n_shared"], r["n_marked"]) for r in extract(df).collect())


@pytest.fixture(scope="module")
def want(spark, pages):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    got = found(pages)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert sum(got.values()) == pages.count() == 129
    assert sum(n for (i, *_), n in got.items() if i == 7) == 4
    long = next(k for k in got if k[0] == 600)
    assert long[2].count("very long page") == 30_000 and long[3] == len(long[2]) and "Gazette" not in long[2]
    return got


@pytest.mark.parametrize("parts", ["3", "16", "200"])
@pytest.mark.parametrize("setting", ["spark.sql.exchange.reuse", "spark.sql.adaptive.enabled", None])
def test_every_page_once(spark, pages, want, parts, setting):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    if setting:
        spark.conf.set(setting, "false")
    try:
        assert found(pages.repartition(7)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        if setting:
            spark.conf.set(setting, "true")


def test_part_numbers_follow_the_order(spark):
    keys = spark.range(300).selectExpr("concat('h', id % 3) AS host", "concat('p', id % 7) AS path", "CASE WHEN id % 50 = 0 THEN NULL ELSE id END AS page_id", "id * 17 % 101 AS key")
    order = keys.columns
    for parts in (1, 2, 9, 40):
        cuts = boundaries(keys, parts)
        assert len(cuts) < max(parts, 1) + 1
        numbers = [r["part"] for r in keys.withColumn("part", part_number(keys, cuts)).orderBy(*order).collect()]
        assert numbers == sorted(numbers) and len(set(numbers)) >= min(parts, len(cuts) + 1) - 1
    assert boundaries(keys.limit(0), 5) == []
