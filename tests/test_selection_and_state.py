"""Radix selection, the streaming sketch, bucket upserts and id products."""
import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.operators.quantiles import percentiles, sketch_bucket, sketch_quantile
from spanlake.sources import writers as W
from spanlake.streaming import jobs as J

PROBS = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}


def test_percentiles_of_many_distinct_values(spark):
    d = spark.range(1_000_000).select((F.col("id") % 2).alias("g"), ((F.hash("id") / 1e3) * F.pow(F.lit(10.0), (F.col("id") % 7).cast("double"))).alias("x"))
    got = {r.g: r for r in percentiles(d, ["g"], "x", PROBS).collect()}
    p = d.toPandas()
    for g, part in p.groupby("g"):
        want = np.quantile(part.x.to_numpy(), list(PROBS.values()))
        assert np.allclose([got[g][n] for n in PROBS], want, rtol=1e-12) and got[g].n == len(part)
    # what a pass sends on is bounded by the digits, not by the values
    assert "percentile" not in percentiles(d, ["g"], "x", PROBS)._jdf.queryExecution().optimizedPlan().toString()


def test_percentiles_equal_the_builtin(spark):
    rows = [("a", v) for v in (3.5, -1.0, -1.0, 0.0, -0.0, 1e-300, -1e300, 7.25)] + [("one", 4.0), ("ties", 2.0), ("ties", 2.0), ("none", None), (None, 1.0), (None, 2.0), (None, None),
            ("inf", float("inf")), ("inf", 1.0), ("inf", 2.0)]
    d = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: (r.n, r.p0, r.p50, r.p95, r.p100) for r in percentiles(d, ["g"], "x", PROBS).collect()}
    want = {r.g: (r.n, r.p0, r.p50, r.p95, r.p100) for r in d.groupBy("g").agg(F.count("x").alias("n"), *[F.percentile("x", F.lit(p)).alias(n) for n, p in PROBS.items()]).collect()}
    assert got == want
    assert percentiles(d.limit(0), ["g"], "x", PROBS).collect() == []
    nan = percentiles(spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("a", 0.5)], "g string, x double"), ["g"], "x", PROBS).first()
    assert nan.p50 == 1.0 and np.isnan(nan.p100)


@pytest.mark.parametrize("error", [0.01, 0.05])
def test_sketch_keeps_its_error_and_its_size(spark, error):
    d = spark.range(300_000).select(F.exp(F.hash("id") / 2.0**31 * 8).alias("x"))
    counts = d.groupBy(sketch_bucket("x", error).alias("bucket")).agg(F.count("*").alias("n"))
    c = counts.agg(F.collect_list(F.struct("bucket", "n")).alias("c"))
    r = c.select(F.size("c").alias("size"), *[sketch_quantile("c", p, error).alias(n) for n, p in PROBS.items()]).first()
    x = np.sort(d.toPandas().x.to_numpy())
    for n, p in PROBS.items():
        want = x[int(np.floor(p * (len(x) - 1)))]
        assert abs(r[n] - want) <= error * want * (1 + 1e-9)
    assert r.size <= 16 / np.log((1 + error) / (1 - error)) + 2


def test_sketch_of_zero_and_null(spark):
    d = spark.createDataFrame([(0.0,), (-1.0,), (None,), (5.0,)], "x double")
    c = d.where("x IS NOT NULL").groupBy(sketch_bucket("x", 0.01).alias("bucket")).agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("bucket", "n")).alias("c"))
    r = c.select(sketch_quantile("c", 0.5, 0.01).alias("m"), sketch_quantile("c", 1.0, 0.01).alias("top")).first()
    assert r.m == 0.0 and abs(r.top - 5.0) <= 0.05


def _files(path):
    return {os.path.join(root, f) for root, _, files in os.walk(path) for f in files if f.endswith(".parquet")}


def test_upsert_writes_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.range(500).selectExpr("id AS k", "1L AS attempt", "concat('v', id) AS v")
    W.upsert_buckets(first, path, ["k"], "attempt", 0, 16)
    before = _files(path)
    one = spark.createDataFrame([(7, 2, "new"), (7, 1, "stale")], "k long, attempt long, v string")
    W.upsert_buckets(one, path, ["k"], "attempt", 1, 16)
    after = _files(path)
    assert len(before) == 16 and len(before - after) == 1 and len(after - before) == 1
    want = {(k, 2 if k == 7 else 1, "new" if k == 7 else f"v{k}") for k in range(500)}
    rows = lambda: [(r.k, r.attempt, r.v) for r in W.read_buckets(spark, path).collect()]
    assert len(rows()) == 500 and set(rows()) == want
    # a failure between removing and replacing a partition: the batch runs again and nothing is lost
    (gone,) = after - before
    shutil.rmtree(os.path.dirname(gone))
    W.upsert_buckets(one, path, ["k"], "attempt", 1, 16)
    assert len(rows()) == 500 and set(rows()) == want
    # an older attempt and an empty batch change nothing
    W.upsert_buckets(spark.createDataFrame([(7, 1, "late")], one.schema), path, ["k"], "attempt", 2, 16)
    W.upsert_buckets(one.limit(0), path, ["k"], "attempt", 3, 16)
    assert set(rows()) == want


def test_membership_of_many_ids(spark):
    folders = spark.range(100_000).select(F.col("id").alias("folder_id"))
    videos = spark.range(5).select(F.col("id").alias("video_id"))
    members = spark.createDataFrame([(0, 3), (4, 7)], "video_id long, folder_id long")
    out = W.membership_update(members, videos, folders, videos.where("video_id < 3"), folders, "add")
    assert out.count() == 300_001 and out.groupBy("video_id").count().where("video_id < 3 AND count = 100000").count() == 3
    assert out.where("video_id = 4").collect()[0].folder_id == 7
    replaced = W.membership_update(members, videos, folders, videos.where("video_id = 0"), folders.where("folder_id IN (8, 9)"), "replace")
    assert sorted((r.video_id, r.folder_id) for r in replaced.collect()) == [(0, 8), (0, 9), (4, 7)]
    with pytest.raises(Exception, match="unknown folder_id"):
        W.membership_update(members, videos, folders, videos, spark.createDataFrame([(-1,)], "folder_id long"), "add").collect()


def test_stream_sketch_equals_its_batch_form(spark, tmp_path):
    e = spark.range(20_000).select((F.col("id") % 3).alias("g"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"), (F.abs(F.hash("id")) % 1000 / 10.0).alias("seconds"))
    e.write.parquet(str(tmp_path / "in"))
    s = J.trace_sketch(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), ["g"], error=0.01)
    got = {(r.g, r.w_start): (r.n, r.p50, r.p95) for r in J.run_to_files(s, str(tmp_path / "out")).collect()}
    b = J.trace_sketch(e, ["g"], error=0.01).collect()
    end = e.agg(F.max("ts")).first()[0].timestamp() - 3600
    want = {(r.g, r.w_start): (r.n, r.p50, r.p95) for r in b if r.w_start.timestamp() + 3600 <= end}
    assert got == want and len(got) >= 12


def test_top_segments_equal_the_batch_form(spark, tmp_path):
    e = spark.range(3000).select((F.col("id") % 2).alias("g"), F.col("id").alias("idx"), F.timestamp_millis(F.col("id") * 100 + 1_000_000).alias("ts"), (F.pmod(F.hash("id"), F.lit(20)) / 20.0).alias("score"))
    end = e.agg(F.max("ts").alias("ts")).selectExpr("CAST(NULL AS BIGINT) AS g", "CAST(NULL AS BIGINT) AS idx", "ts + INTERVAL 1 DAY AS ts", "CAST(NULL AS DOUBLE) AS score")
    # three files of rows in time order, read one at a time, then the marker
    for i, part in enumerate([e.where("idx < 1000"), e.where("idx >= 1000 AND idx < 2000"), e.where("idx >= 2000"), end]):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = J.top_segments(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), ["g"], "idx")
    got = sorted((r.g, r.seg, round(r.score, 9), r.frame_count, r.best) for r in J.run_to_files(s, str(tmp_path / "out")).collect())
    want = []
    p = e.selectExpr("g", "idx", "unix_millis(ts) div 5000 AS seg", "score").toPandas()
    for (g, seg), part in p.groupby(["g", "seg"]):
        top = part.sort_values(["score", "idx"], ascending=[False, True]).head(3)
        want.append((g, seg, round(top.score.mean(), 9), len(part), int(top.idx.iloc[0])))
    assert got == sorted(want)
