"""No hidden caps and switches: what one input of unusual size or shape must give."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.operators.aggregates import group_rollup
from spanlake.operators.identity import density_fallback
from spanlake.operators.knn import knn_join
from spanlake.operators.windows import profile_cap
from spanlake.plans.evidence import Gate, Plan, Step, execute_plan, validate_plan
from spanlake.plans.search import dense_search, moment_search
from spanlake.udfs import encoder_udf, hashing_encoder, semantic_arrays


def found(spark, n, offset=0.0, extra=""):
    return spark.range(n).selectExpr("1L AS query_id", "id % 3 AS video_id", "id + 1 AS rank", f"id * 20.0D + {offset} AS start_time", f"id * 20.0D + {offset} + 5 AS end_time", "1.0D - id / 200.0D AS score" + extra)


def test_rerank_drops_no_moment(spark):
    queries = spark.createDataFrame([(1, "x")], "query_id bigint, text string")
    gate = Gate(min_score_spread=0.0)
    plan = Plan((Step("s1", "visual.search", top_k=60, gate=gate), Step("s2", "vlm.rerank", "rerank", "verifier", ("s1",), top_k=5, gate=gate)), result_limit=100)
    tools = {"visual.search": lambda q, s, m: found(spark, 60),
             "vlm.rerank": lambda q, s, m: m.select("query_id", "video_id", F.col("pos").alias("rank"), "start_time", "end_time", F.col("score"), (F.col("pos") / 10.0).alias("rerank_score"))}
    results, trace = execute_plan(queries, plan, tools)
    assert [r.decision for r in trace.orderBy("step_index").collect()] == ["accepted", "accepted"]
    assert results.count() == 60
    with pytest.raises(ValueError):
        validate_plan(Plan((Step("s1", "visual.search", top_k=301),)))
    with pytest.raises(ValueError):
        validate_plan(Plan((Step("s1", "visual.search"),), result_limit=101))


def test_vectors_of_unlike_width(spark):
    q = spark.createDataFrame([(1, 0, [1.0, 0.0])], "query_id bigint, query_idx bigint, vec array<double>")
    u = spark.createDataFrame([(1, 7, [1.0, 0.0, 0.0]), (1, 8, [1.0])], "video_id bigint, unit bigint, embedding array<float>").coalesce(1)  # the first of two errors in one task
    with pytest.raises(Exception, match="'unit': 7"):
        knn_join(q, u, 2, keep=("unit",)).collect()
    ok = spark.createDataFrame([(1, 7, [1.0, 0.0]), (1, 8, [0.0, 1.0])], "video_id bigint, unit bigint, embedding array<float>")
    assert [(r.unit, r.score) for r in knn_join(q, ok, 2, keep=("unit",)).orderBy("rank").collect()] == [(7, 1.0), (8, 0.0)]


def test_rows_without_vector_do_not_dilute(spark):
    frames = spark.createDataFrame([(1, 0, 0, 0, 0, 5000, [1.0, 0.0])], "video_id bigint, segment_id bigint, frame_idx bigint, timestamp_ms bigint, segment_start_ms bigint, segment_end_ms bigint, embedding array<float>")
    q = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, None)], "query_id bigint, query_idx bigint, vec array<double>")
    assert dense_search(q, frames).collect()[0].raw_score == pytest.approx(1.0)


def test_text_only_search_is_thresholded(spark):
    text = ["alpha beta gamma", "alpha", "delta alpha word word word word word word word word word word", "other"]
    units = spark.createDataFrame([(1, i, i * 60_000, i * 60_000 + 5000, t, None) for i, t in enumerate(text)], "video_id bigint, segment_idx bigint, start_ms bigint, end_ms bigint, text string, embedding array<float>")
    q = spark.createDataFrame([(1, 0, "alpha beta gamma", ["asr"]), (2, 0, "alpha beta gamma", ["visual"])], "query_id bigint, query_idx bigint, text string, channels array<string>")
    rows = moment_search(q, {"asr": units}).collect()
    assert {r.query_id for r in rows} == {1}
    best = max(r.score for r in rows)
    assert all(r.above_threshold == (r.score >= max(0.1, 0.3 * best)) for r in rows) and any(not r.above_threshold for r in rows)


def test_profile_cap_follows_the_query(spark):
    rows = spark.range(700).selectExpr("1L AS query_id", "id", "'balanced' AS profile", "600 AS `limit`").union(spark.range(700).selectExpr("2L", "id", "'recall'", "24"))
    got = {r[0]: r[1] for r in profile_cap(rows, ["query_id"], [F.asc("id")]).groupBy("query_id").count().collect()}
    assert got == {1: 600, 2: 500}


def test_status_is_each_videos_own(spark):
    c = spark.createDataFrame([(1, 0, "words here", True), (1, 1, "more", False), (2, 0, " ", True), (3, 0, "x", False)], "video_id bigint, turn bigint, text string, semantic_eligible boolean")
    encode = encoder_udf(lambda: hashing_encoder(8))
    assert {(r.video_id, r.semantic_status) for r in semantic_arrays(c, ["video_id", "turn"], encode).collect()} == {(1, "complete"), (2, "empty"), (3, "empty")}
    assert {r.semantic_status for r in semantic_arrays(c, ["video_id", "turn"], None).collect()} == {"unavailable", "empty"}


def test_no_collapsed_video(spark):
    w = spark.createDataFrame([(1, i, i % 2, [1.0, float(i)]) for i in range(50)], "video_id bigint, idx bigint, label bigint, embedding array<float>")
    assert density_fallback(w, ["video_id"]).collect() == []


def test_texts_that_are_not_empty_have_unit_vectors():
    """Also those whose words cancel out, and white space that trim() leaves."""
    import zlib
    by: dict[tuple[int, bool], str] = {}
    for i in range(400):
        h = zlib.crc32(f"w{i}".encode())
        by[h % 8, bool(h & 0x10000)] = f"w{i}"
    pair = f"{by[3, True]} {by[3, False]}"
    norms = np.linalg.norm(hashing_encoder(8)([pair, "\t\n", " ", "a b c", ""]), axis=1)
    assert norms.round(6).tolist() == [1, 1, 1, 1, 0]


def test_group_rollup_takes_the_first_of_equal_moments(spark):
    """Equal score and start: the smallest moment, in any order of the rows."""
    rows = [(1, "visual", i, 5.0, 6.0, 0.5, i) for i in (7, 3, 9)] + [(1, "asr", 4, 5.0, 6.0, 0.5, 4)]
    for r in (rows, rows[::-1]):
        d = spark.createDataFrame(r, "query_id long, modality string, unit_id long, start_time double, end_time double, score double, best_ms long")
        assert [x.best_ms for x in group_rollup(d, ["query_id"]).collect()] == [3]


def test_boxes_of_few_files_are_held_at_once(spark):
    """A batch of large files comes back in several frames, in order and whole."""
    from types import SimpleNamespace

    import pandas as pd

    from spanlake.udfs import detect
    got = []
    files = SimpleNamespace(schema=spark.range(1).schema, select=lambda *c: SimpleNamespace(mapInPandas=lambda run, kinds: got.append(run)))
    detect(files, ["id"], lambda: lambda b: [len(b)])
    sizes = [400_000] * 8 + [0, 3_000_000, 1]
    out = list(got[0]([pd.DataFrame({"id": range(11), "content": [b"x" * n for n in sizes]})]))
    assert len(out) > 3 and [x for d in out for x in d["id"]] == list(range(11)) and [x for d in out for x in d["boxes"]] == [[n] for n in sizes]


def test_python_batches_are_bounded_in_bytes(spark):
    """Long rows reach Python in batches of few rows; a bound that the session sets itself stays."""
    import pandas as pd
    from pyspark.sql import functions as F

    from spanlake import session
    from spanlake.catalogue.views import Views

    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    @F.pandas_udf("long")
    def size(s: pd.Series) -> pd.Series:
        return pd.Series([s.str.len().sum()] * len(s))

    rows = spark.range(3000, numPartitions=1).select(F.expr("repeat('x', 10000)").alias("t"))
    spark.conf.unset(key)
    try:
        Views(spark, "")
        assert rows.select(size("t").alias("n")).agg(F.max("n")).first()[0] <= 1.1 * session.BATCH_BYTES
        spark.conf.set(key, "1000")
        Views(spark, "")
        assert spark.conf.get(key) == "1000"
    finally:
        spark.conf.unset(key)


def test_group_rollup_and_its_sql_take_the_first_row_of_equal_scores(spark, tmp_path):
    """The table's first, as arg_max does, though a later row has an earlier start or a smaller id."""
    import datetime

    import duckdb

    from spanlake.catalogue import all_queries, all_sql
    at = datetime.datetime(2024, 1, 2, 12)
    rows = [(i, at + datetime.timedelta(minutes=m), 1, e, 50.0, "") for i, m, e in ((401, 9, "click"), (5, 7, "view"), (9, 3, "click"), (7, 1, "error"), (2, 9, "click"), (10, 5, "view"))]
    rows += [(i + 400, t, 2, e, v / (2 if i == 401 else 1), p) for i, t, _, e, v, p in rows]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(all_sql()["group_rollup"]).fetchall())
    got = sorted(tuple(r) for r in all_queries()["group_rollup"](spark, str(tmp_path)).collect())
    assert got == want
    assert [r[9] for r in got if r[1] == 1] == [401, 2, 7]


def test_group_rollup_keeps_null_and_undefined_scores_in_place(spark):
    """Of moments, one without a score comes last and one whose score is not a number first; a null start is last of equals."""
    shape = "query_id long, modality string, unit_id long, start_time double, end_time double, score double, best_ms long"
    rows = [(1, "asr", 1, 1.0, 2.0, None, 1), (1, "asr", 2, 5.0, 6.0, 0.5, 2), (2, "asr", 3, 1.0, 2.0, 0.9, 3), (2, "asr", 4, 5.0, 6.0, float("nan"), 4), (3, "asr", 5, None, 2.0, 0.5, 5), (3, "asr", 6, 5.0, 6.0, 0.5, 6)]
    assert {x.query_id: x.best_ms for x in group_rollup(spark.createDataFrame(rows, shape), ["query_id"]).collect()} == {1: 2, 2: 4, 3: 6}
