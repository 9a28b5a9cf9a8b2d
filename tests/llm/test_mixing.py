"""Raked weights against their targets, and sampling by them."""
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spanlake.llm import mixing as M

ROWS = [(i, "word " * (5 + 7 * i % 40), s, l) for i, (s, l) in enumerate([("a", "en")] * 400 + [("b", "en")] * 60 + [("b", "de")] * 40 + [("c", None)] * 25 + [(None, "de")] * 30)]
SCHEMA = "doc_id bigint, text string, source string, lang string"


def test_margins_fit(spark):
    cells = spark.createDataFrame([("a", "en", "x", 900), ("a", "de", "y", 50), ("b", "en", "y", 100), ("b", "de", "x", 30), ("c", "en", "x", 10), (None, "de", "y", 20), ("a", None, "x", 5)], "source string, lang string, topic string, n bigint")
    rows = M.rake(cells, rounds=40).collect()
    for m in M.MARGINS:
        n, w = defaultdict(float), defaultdict(float)
        for r in rows:
            n[r[m]] += r["n"]
            w[r[m]] += r["w"]
        z = sum(x ** M.FLATTEN for x in n.values())
        for level in n:
            assert w[level] == pytest.approx(n[level] ** M.FLATTEN / z, rel=1e-3)


def test_sample_follows_the_weights(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("weight", F.lit("old")).repartition(3)
    got = M.mix_sources(df)
    assert got.columns == ["doc_id", "text", "source", "lang", "topic", "n_tokens", "probability", "weight", "sampled"]
    rows = got.collect()
    assert len(rows) == len(ROWS)
    assert all(0 < r.probability <= 1 and (r.weight >= 1 - 1e-9) == r.sampled for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r.probability)
    assert max(by["a"]) < min(by["c"])
    total = sum(r.n_tokens for r in rows)
    assert sum(r.n_tokens * r.weight for r in rows) == pytest.approx(M.RATE * total, rel=0.15)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, "", "a", "en"), (2, "", "a", "en"), (None, "x y", "a", "en"), (3, "| " * 50_000, "a", "en"), (4, "LOUD TEXT", "a", "en")], SCHEMA)
    rows = {(r.doc_id, r.topic): r for r in M.mix_sources(df).collect()}
    assert {k[1] for k in rows} == {"empty", "short", "table", "capitals"}
    assert rows[1, "empty"].probability == M.RATE and rows[3, "table"].n_tokens == 50_000
    assert M.mix_sources(df.limit(0)).collect() == []
    assert {r.topic for r in M.mix_sources(df, topic=F.lit("one")).collect()} == {"one"}
