"""Registered queries against their SQL, and the pipeline against brute force."""
import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from spanlake.llm import catalogue, common, decontam
from test_setjoin import brute as near
from test_unitdedup import brute as repeated

DIR = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "embeddings")


def text(v):
    return "~" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, DIR)
    cur = con.execute(catalogue.SQL[name])
    names = [c[0] for c in cur.description]
    want = sorted(tuple(text(r[names.index(c)]) for c in got.columns) for r in cur.fetchall())
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(map(text, r)) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_every_query_covers_its_table(spark, name):
    got = catalogue.QUERIES[name](spark, DIR)
    if name.split("_")[0] in ("op12", "op13"):
        key, every = ("anchor_id", 100) if name.startswith("op12") else ("query_id", 20)
        assert {r[0] for r in got.select(key).collect()} == {r[0] for r in common.table(spark, DIR, "embeddings").where(F.col("vec_id") % every == 0).select("vec_id").collect()}
        return
    key = "page_id" if name.startswith("op8") else "doc_id"
    whole = {r[0] for r in common.table(spark, DIR, "pages" if key == "page_id" else "documents").select(key).collect()}
    ids = [r[0] for r in got.select(key).collect()]
    if name.split("_")[0] in ("op6", "op7"):
        assert set(ids) <= whole and ids
    else:
        assert len(ids) == len(whole) and set(ids) == whole


def test_stages(spark):
    """Each stage on all that the one before kept, against a plain form of its rule."""
    docs = common.table(spark, DIR, "documents")
    extra = spark.createDataFrame([(10**6, "12 34 !!", "en", "src1", 8), (10**6 + 1, None, "en", "src1", 0)], docs.schema)
    docs = docs.union(extra)
    rows = {r[0]: r for r in docs.collect()}
    steps = dict(P.STAGES)

    known = P.language(spark, docs, DIR).cache()
    assert {r[0] for r in known.collect()} == set(rows) - {10**6, 10**6 + 1}

    top = near([(r[0], r[1]) for r in known.collect()], 5, 8, 10)
    single = P.near_copies(spark, known, DIR).cache()
    assert {r[0] for r in single.collect()} == {d for d, t in top.items() if d == t}

    spans = repeated([(r[0], r[1]) for r in single.collect()])
    cut = P.repeated_units(spark, single, DIR).cache()
    for r in cut.collect():
        was, out, at = rows[r[0]][1], [], 0
        for a, b in spans[r[0]]:
            out.append(was[at:a])
            at = b
        assert r[1] == "".join([*out, was[at:]]) and r.n_chars == len(r[1])
    gone = {r[0] for r in single.collect()} - {r[0] for r in cut.collect()}
    assert all(spans[d] for d in gone)

    items = [r[0] for r in common.table(spark, DIR, "benchmark").select("text").collect()]
    clean = P.benchmark_leaks(spark, cut, DIR).cache()
    kept = {r[0] for r in clean.collect()}
    flat = lambda t: " ".join(t.lower().split())
    leaks = {r[0] for r in cut.collect() if any(flat(i) in flat(r[1]) for i in items)}
    assert not leaks & kept
    found = {r[0]: r.common for r in decontam.find_leaks(cut, common.table(spark, DIR, "benchmark")).collect()}
    assert {r[0] for r in cut.collect()} - kept == set(found) and all(found[d] >= decontam.COMMON for d in found)

    for d in (known, single, cut, clean):
        assert d.columns == docs.columns
    mixed = P.source_mix(spark, clean, DIR)
    assert {r[0] for r in mixed.collect()} <= kept and mixed.where(F.col("probability").isNull()).count() == 0
    assert list(steps) == ["language", "near_copies", "repeated_units", "benchmark_leaks", "source_mix"]


def test_run(spark):
    rows = P.run(spark, DIR)
    assert rows.count() > 50 and {"doc_id", "text", "lang", "source", "n_chars", "weight"} <= set(rows.columns)


def test_empty_documents(spark):
    docs = common.table(spark, DIR, "documents").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, DIR)
        assert docs.collect() == []
