"""The stored index against the search that reads texts."""
import random

import numpy as np
from pyspark.sql import functions as F

from spanlake.operators import postings as P
from spanlake.operators.lexical import bm25_search
from spanlake.session import shared_dir


def corpus(spark, n=400, seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["中文字幕", "中文", "É"]
    rows = [(i, 0 if i % 3 else i % 17, " ".join(r.choices(words, weights=range(len(words), 0, -1), k=r.randint(0, 40)))) for i in range(n)]
    docs = spark.createDataFrame(rows + [(n, 0, None), (n + 1, 1, "")], "segment_idx long, video_id long, text string")
    queries = spark.createDataFrame([(i, " ".join(r.choices(words, k=4))) for i in range(25)] + [(90, ""), (91, "unheard of"), (92, None)], "query_id long, text string")
    return docs, queries


def rows_of(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


def written(spark, docs, **how):
    path = f"{shared_dir(spark)}/index-{random.getrandbits(60):x}"
    P.write_postings(docs, path, **how)
    return path


def test_rows_equal_the_search_over_texts(spark):
    docs, queries = corpus(spark)
    for block_docs in (10_000, 30):
        path = written(spark, docs, block_docs=block_docs, buckets=4)
        for k in (3, 1000):
            want = rows_of(bm25_search(queries, docs.where("text IS NOT NULL"), k))
            assert rows_of(P.search_postings(queries, path, k)) == want
            if k == 3:
                assert rows_of(P.search_postings(queries, path, k, max_task_terms=60)) == want


def test_a_search_reads_its_buckets_and_no_text(spark):
    docs, queries = corpus(spark)
    path = written(spark, docs, buckets=16)
    plan = P.search_postings(queries.where("query_id = 3"), path, 5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or "bucket#" in plan.split("PartitionFilters: [", 1)[1].split("]")[0]
    assert "text:string" not in plan and "In(term" in plan


def test_blocks_that_cannot_gain_are_skipped():
    r = np.random.default_rng(5)
    state = P._Scores({"a": np.array([0, 1]), "b": np.array([1])}, {"a": 0.1, "b": 2.0}, 2, 10.0, 3, 1.2, 0.75)
    every = []
    for n in range(30):
        dl = r.integers(5, 20, 40).astype(float)
        terms = ["a", "b"] if n % 5 == 0 else ["a"]
        at = [np.sort(r.choice(40, 10, replace=False)) for _ in terms]
        tf = [r.integers(1, 4, 10) for _ in terms]
        kept = state.block(dl, np.zeros(40, int), [(7,)], terms, at, tf, np.array([f.max() for f in tf], float), np.array([dl[a].min() for a in at]))
        alone = P._Scores(state.readers, state.idf, 2, 10.0, 3, 1.2, 0.75).block(dl, np.zeros(40, int), [(7,)], terms, at, tf, np.array([9.0] * len(tf)), np.ones(len(tf)))
        every.append((kept, alone))
    for q in (0, 1):
        best = [sorted((s for asked, scores in (x[i] for x in every) for s in scores[asked == q].ravel()), reverse=True)[:3] for i in (0, 1)]
        assert best[0] == best[1]
    assert state.skipped > 10


def test_statistics_and_empty_table(spark):
    docs, queries = corpus(spark)
    stats = {r.term: r for r in P.posted_stats(spark, written(spark, docs, block_docs=50)).collect()}
    texts = [r.text for r in docs.where("text IS NOT NULL").collect()]
    assert stats["w3"].df == sum("w3" in t.split() for t in texts) and stats["w3"].n_docs == len(texts) and stats["w3"].blocks > 1
    path = written(spark, docs.limit(0))
    assert P.search_postings(queries, path, 5).collect() == [] and P.posted_stats(spark, path).collect() == []


def test_large_videos_have_blocks_of_their_own(spark):
    docs = spark.range(1000).select(F.col("id").alias("segment_idx"), F.lit(5).alias("video_id"), F.lit("a b").alias("text")).union(
        spark.range(1000, 1100).select("id", F.lit(6), F.lit("a c")))
    path = written(spark, docs, block_docs=100)
    sizes = [r.n for r in spark.read.parquet(f"{path}/docs").collect()]
    assert sum(sizes) == 1100 and max(sizes) < 500
