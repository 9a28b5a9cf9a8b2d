"""Bars that keep rows from a shuffle: the same rows as without them, and few rows sent."""
from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.operators import knn as K
from spanlake.operators import lexical as L
from spanlake.plans import search as S

Q = "query_id long, query_idx long, vec array<double>"
FRAMES = "video_id long, frame_idx long, timestamp_ms long, segment_id long, segment_start_ms long, segment_end_ms long, embedding array<float>"


def frames(spark, videos, each, dim=8, seed=4, spread=1.0):
    """Videos of a few frames whose vectors lie around one of the video's own."""
    rng = np.random.default_rng(seed)
    rows = []
    for v in range(videos):
        own = rng.normal(size=dim)
        for i in range(each):
            seg = i // 3
            rows.append((v, i, i * 1000, seg, seg * 3000, seg * 3000 + 3000, (own + spread * rng.normal(size=dim)).tolist()))
    return spark.createDataFrame(rows, FRAMES)


def queries(spark, n, subs=2, dim=8, seed=5):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, j, rng.normal(size=dim).tolist()) for i in range(n) for j in range(subs if i % 2 else 1)], Q)


def plain(df):
    return sorted((r.query_id, r.rank, r.video_id, round(r.start_time, 6), round(r.score, 9), tuple(r.modalities)) for r in df.collect())


def everything(monkeypatch):
    """The search without bars."""
    monkeypatch.setattr(S, "_visual_that_can_enter", lambda q, f, rest, p, primary, limit, channel: S.dense_search(q, f, p.ann_k, p.segment_top_n, channel, p.name == "recall"))


def test_best_groups(spark):
    u, q = frames(spark, 60, 5).repartition(6), queries(spark, 4)
    vecs = [(r.query_id, np.array(r.vec)) for r in q.collect()]
    best: dict = {}
    for r in u.collect():
        e = np.array(r.embedding, dtype=float)
        for qi, x in vecs:
            c = float(x @ e / np.linalg.norm(x) / np.linalg.norm(e))
            best[qi, r.video_id] = max(best.get((qi, r.video_id), -2), c)
    for kw in ({}, {"max_task_queries": 2, "unit_block_rows": 50}):
        got = {(r.query_id, r.video_id): r.best for r in K.best_groups(q, u, **kw).collect()}
        assert got.keys() == best.keys() and all(got[k] == pytest.approx(best[k]) for k in got)
        top = {(r.query_id, r.video_id) for r in K.best_groups(q, u, 7, **kw).collect()}
        assert top == {(i, v) for i in range(4) for v in sorted(range(60), key=lambda v: -best[i, v])[:7]}
        barred = q.withColumn("bar", F.when(F.col("query_id") > 0, 0.5))
        assert {(r.query_id, r.video_id) for r in K.best_groups(barred, u, floor="bar", **kw).collect()} == {k for k in best if k[0] == 0 or best[k] >= 0.5}
    assert K.best_groups(q, u.limit(0), 3).collect() == [] and K.best_groups(q.limit(0), u, 3).collect() == []


@pytest.mark.parametrize("kw", [{}, {"max_task_queries": 3, "unit_block_rows": 60}])
def test_floor_and_within(spark, kw):
    u, q = frames(spark, 30, 6).repartition(5), queries(spark, 5)
    u = u.withColumn("video_id", F.when(F.col("video_id") > 0, F.col("video_id")))  # one video without an id
    full = K.knn_join(q, u, 4, keep=("frame_idx",), **kw).collect()
    pairs = spark.createDataFrame([(i, v) for i in range(5) for v in range(1, 30) if (i + v) % 4 == 0] + [(2, None), (99, 3)], "query_id long, video_id long")
    wanted = {(r.query_id, r.video_id) for r in pairs.collect()}
    assert sorted(map(str, K.knn_join(q, u, 4, keep=("frame_idx",), within=pairs, **kw).collect())) == sorted(str(r) for r in full if (r.query_id, r.video_id) in wanted)
    barred = q.withColumn("bar", F.when(F.col("query_id") != 1, 0.4))
    assert sorted(map(str, K.knn_join(barred, u, 4, keep=("frame_idx",), floor="bar", **kw).collect())) == sorted(str(r) for r in full if r.query_id == 1 or r.score >= 0.4)
    assert K.knn_join(q, u, 4, keep=("frame_idx",), within=pairs.limit(0), **kw).collect() == []


def test_what_a_task_has_seen_raises_its_bar(spark, monkeypatch):
    """10,000 units in many small batches: far fewer rows leave the task than k for each batch."""
    u = frames(spark, 1, 10_000).coalesce(1)
    q = queries(spark, 6, 1)
    sent = []
    own = K.top_k
    monkeypatch.setattr(K, "top_k", lambda df, *a, **kw: sent.append(df) or own(df, *a, **kw))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows = K.knn_join(q, u, 10, by=(), keep=("frame_idx",)).collect()
        assert sent[0].count() < 6 * 10 * 10  # without the bar k for each of 100 batches
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sorted(map(str, rows)) == sorted(map(str, K.knn_join(q, u, 10, by=(), keep=("frame_idx",)).collect()))


@pytest.mark.parametrize("leg", ["bm25", "knn"])
def test_small_groups_gather_their_bar(spark, monkeypatch, leg):
    """Batches that hold fewer rows of a video than k: over many batches the bar of a task rises all the same."""
    rng = np.random.default_rng(4)
    rows = [(i % 4, i, " ".join(["needle"] * int(rng.integers(1, 20)) + ["hay"] * int(rng.integers(1, 40))), rng.normal(size=4).tolist()) for i in range(2000)]
    u = spark.createDataFrame(rows, "video_id long, segment_idx long, text string, embedding array<float>").coalesce(1)
    q = spark.createDataFrame([(i, "needle", rng.normal(size=4).tolist()) for i in range(3)], "query_id long, text string, vec array<double>")
    module = L if leg == "bm25" else K
    search = (lambda: L.bm25_search(q, u, 10)) if leg == "bm25" else (lambda: K.knn_join(q, u, 10, query_keys=("query_id",), keep=("segment_idx",)))
    want = sorted(map(str, search().collect()))
    sent = []
    own = module.top_k
    monkeypatch.setattr(module, "top_k", lambda df, *a, **kw: sent.append(df) or own(df, *a, **kw))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        assert sorted(map(str, search().collect())) == want
        assert sent[0].count() < 3 * 2000 / 3  # without the bar all pairs
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_terms_are_counted_before_they_are_shuffled(spark):
    """The terms of a query travel to the texts, or all terms are counted first: no (text, term) row is dealt out."""
    u = spark.createDataFrame([(i, f"a{i} b b c{i % 3}") for i in range(300)], "segment_idx long, text string")
    terms = L.query_terms(spark.createDataFrame([(1, "b c1 none")], "query_id long, text string"))
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few, many = L.corpus_stats(u, terms, few=True), L.corpus_stats(u, terms)
        assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()
        assert many._jdf.queryExecution().optimizedPlan().toString().startswith("Join LeftSemi")
        got = [sorted(map(tuple, d.collect())) for d in (few, many)]
        assert got[0] == got[1] == [("", 300, 1200), ("b", 300, None), ("c1", 100, None)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)


def test_moments_shuffle_no_text(spark, monkeypatch):
    """The details of a hit are not part of a moment, so its legs carry no piece of a text."""
    kept = []
    own = (S.knn_join, S.bm25_search)
    monkeypatch.setattr(S, "knn_join", lambda *a, **kw: kept.append(kw["keep"]) or own[0](*a, **kw))
    monkeypatch.setattr(S, "bm25_search", lambda *a, **kw: kept.append(kw["keep"]) or own[1](*a, **kw))
    units = spark.createDataFrame([(1, 0, 0, 5000, "alpha beta", [1.0, 0.0])], "video_id long, segment_idx long, start_ms long, end_ms long, text string, embedding array<float>")
    q = spark.createDataFrame([(1, 0, "alpha", [1.0, 0.0])], "query_id long, query_idx long, text string, text_vec array<double>")
    assert S.moment_search(q, {"asr": units}).count() == 1
    assert kept == [("segment_idx", "start_ms", "end_ms")] * 2


def test_not_a_number_passes_the_bar():
    scores = np.array([[0.1, np.nan, 0.9, 0.5]])
    q, u = K.partial_top_k(scores, np.zeros(4, dtype=np.int64), 2)
    assert set(u) >= {1, 2}


def test_moments_of_many_small_videos(spark, monkeypatch):
    """The same results as without bars; the pairs searched are few of all there are, and all that tie are among them."""
    u, q = frames(spark, 400, 6, spread=0.3), queries(spark, 6)
    u = u.union(u.where("video_id < 400").withColumn("video_id", F.col("video_id") + 1000))  # every video twice: ties at every bar
    searched = []
    dense = S.dense_search
    monkeypatch.setattr(S, "dense_search", lambda *a, within=None, **kw: searched.append(within.count() if within is not None else None) or dense(*a, within=within, **kw))
    got = plain(S.moment_search(q, {"visual": u}, limit=5))
    assert len(searched) == 2 and None not in searched and sum(searched) <= 6 * 5 * 6 < 6 * 800
    everything(monkeypatch)
    assert got == plain(S.moment_search(q, {"visual": u}, limit=5))
    assert searched[-1] is None


@pytest.mark.parametrize("primary", ["visual", None])
def test_other_channels(spark, monkeypatch, primary):
    """Faces that lift or lower a video; a query that does not ask for the visual channel."""
    u, q = frames(spark, 40, 4, spread=0.4), queries(spark, 5)
    rng = np.random.default_rng(8)
    tracks = spark.createDataFrame([(v, t, 1000 * t, 1000 * t + 900, 1000 * t + 100, rng.normal(size=4).tolist()) for v in range(0, 60, 3) for t in range(3)],
                                   "video_id long, track_idx long, start_ms long, end_ms long, best_ms long, embedding array<float>")
    face = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(0, 5, 2)], "query_id long, face_vec array<double>")
    both = q.join(face, "query_id", "left")
    asked = both.withColumn("channels", F.when(F.col("query_id") == 3, F.array(F.lit("face"))))
    for table in (both, asked):
        with monkeypatch.context() as m:
            got = plain(S.moment_search(table, {"visual": u, "face": tracks}, primary=primary, limit=6))
            everything(m)
            assert got == plain(S.moment_search(table, {"visual": u, "face": tracks}, primary=primary, limit=6))


def test_thin_queries(spark, monkeypatch):
    """Fewer results than asked for: no bar, and every pair is searched; a sub-query that is not a number counts as missing."""
    u = frames(spark, 9, 2, spread=0.4)
    q = queries(spark, 3).union(spark.createDataFrame([(1, 7, [float("nan")] * 8)], Q))
    got = plain(S.moment_search(q, {"visual": u}, limit=8))
    wide = plain(S.moment_search(q.where("query_id <> 1"), {"visual": u.where("video_id < 9 AND frame_idx < 2")}, limit=8))
    everything(monkeypatch)
    assert got == plain(S.moment_search(q, {"visual": u}, limit=8))
    assert [r for r in got if r[0] != 1] == wide
