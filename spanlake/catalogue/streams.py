"""Streaming queries: each runs its stream over the whole table and reads the result back."""
from pyspark.sql import functions as F

from ..sources.writers import read_buckets
from ..streaming import jobs as J
from .registry import query
from .scans import fresh


def stream_of(v, df, name):
    """``df`` as a file stream."""
    path = fresh(v, name)
    df.write.parquet(path)
    return v.spark.readStream.schema(df.schema).parquet(path)


def _events(v):
    # wall-clock seconds as UTC timestamps, whatever the session zone
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return v.table("events").select("event_id", "user_id", "event_type", F.timestamp_micros(us).alias("ts"), F.least(F.col("value") / 517.3, F.lit(1.0)).alias("score"), us.alias("us"))


@query("stream_fixed_segments", "event_type:s seg:l frames:l mean_score:d best_score:d", sql="""
  SELECT event_type, (epoch_us(ts) - 1704067200000000) // 3600000000 AS seg, count(*) AS frames, avg(least(value / 517.3::DOUBLE, 1)) AS mean_score, max(least(value / 517.3::DOUBLE, 1)) AS best_score FROM events GROUP BY 1, 2""")
def _(v):
    s = J.fixed_segments(stream_of(v, _events(v), "ev"), ["event_type"], width="1 hour")
    out = J.run_to_files(s, fresh(v, "seg"), "complete")
    return out.withColumn("seg", F.expr("unix_micros(seg_start) div 3600000000"))


@query("stream_gap_sessions", "user_id:l start_us:l events:l", sql="""
  SELECT user_id, min(us) AS start_us, count(*) AS events FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM (
   SELECT user_id, event_id, us, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) < 7200000000 THEN 0 ELSE 1 END AS brk FROM (
    SELECT *, epoch_us(ts) - 1704067200000000 AS us FROM events))) GROUP BY user_id, isl""")
def _(v):
    s = J.gap_sessions(stream_of(v, _events(v), "ev"), ["user_id"], gap="2 hours")
    return J.run_to_files(s, fresh(v, "ses"), "complete").withColumn("start_us", F.expr("unix_micros(start)"))


@query("stream_capped_sessions", "video_id:l start:d end:d intervals:l")
def _(v):
    i = v.intervals("visual", "asr").select("video_id", "start", "end", F.timestamp_micros((F.col("start") * 1_000_000).cast("long")).alias("ts"))
    return J.run_to_files(J.capped_sessions(stream_of(v, i, "iv"), "video_id", 2.0, 12.0), fresh(v, "cap"))


@query("stream_tracks", "video_id:l first_det:l start_ms:l end_ms:l detections:l")
def _(v):
    d = v.frames.selectExpr("video_id", "vec_id AS det_id", "CAST(1000 + floor(frame_idx / 4) * 0.5 + floor(frame_idx / 40) * 3 AS DOUBLE) AS t", "(vec_id % 100) / 100.0D AS det_score",
                            "(vec_id * 7 % 101) / 101.0D AS quality", "array(10.0D * (label % 5), 0.0D, 10.0D * (label % 5) + 8, 8.0D) AS bbox", "embedding")
    d = d.withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")))
    return J.run_to_files(J.tracks(stream_of(v, d, "det"), "video_id"), fresh(v, "trk"))


@query("stream_upsert", "user_id:l event_type:s event_id:l score:d", sql="""
  SELECT user_id, event_type, max(event_id) AS event_id, arg_max(least(value / 517.3::DOUBLE, 1), event_id) AS score FROM events GROUP BY 1, 2""")
def _(v):
    path = fresh(v, "ups")
    e = _events(v).drop("us")
    J.upsert_sink(stream_of(v, e.unionByName(e.where("event_id % 3 = 0")), "ev"), path, ["user_id", "event_type"], "event_id", "ts", "1 hour", f"{path}-checkpoint").awaitTermination()
    return read_buckets(v.spark, path)


@query("stream_trace_metrics", "event_type:s w:l n:l p50:d p95:d", sql="""
  SELECT event_type, w, count(*) AS n, quantile_cont(s, 0.5) AS p50, quantile_cont(s, 0.95) AS p95 FROM (
   SELECT event_type, value AS s, (epoch_us(ts) - 1704067200000000) // 43200000000 - k AS w FROM events, (SELECT unnest([0, 1]) AS k)) GROUP BY 1, 2""")
def _(v):
    e = _events(v).withColumn("seconds", v.spark.range(1).select(F.lit(517.3)).scalar() * F.col("score"))
    s = J.trace_metrics(stream_of(v, e, "tr"), ["event_type"], size="24 hours", slide="12 hours")
    return J.run_to_files(s, fresh(v, "met"), "complete").withColumn("w", F.expr("unix_micros(w_start) div 43200000000"))


@query("stream_trace_sketch", "event_type:s w:l n:l p50:d p95:d", sql="""
  WITH g AS (SELECT ln(1.01::DOUBLE / 0.99::DOUBLE) AS step, 1.01::DOUBLE / 0.99::DOUBLE AS gamma),
   c AS (SELECT event_type, (epoch_us(ts) - 1704067200000000) // 43200000000 - k AS w, CASE WHEN value > 0 THEN CAST(ceil(ln(value) / step) AS BIGINT) ELSE -1099511627776 END AS bucket, count(*) AS n
    FROM events, g, (SELECT unnest([0, 1]) AS k) WHERE value IS NOT NULL GROUP BY 1, 2, 3),
   r AS (SELECT *, sum(n) OVER (PARTITION BY event_type, w ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY event_type, w) AS t FROM c),
   done AS (SELECT max(epoch_us(ts)) - 1704067200000000 - 3600000000 AS mark FROM events)
  SELECT event_type, w, max(t) AS n, min(CASE WHEN upto > floor((t - 1) * 0.5) THEN x END) AS p50, min(CASE WHEN upto > floor((t - 1) * 0.95) THEN x END) AS p95
  FROM (SELECT r.*, CASE WHEN bucket = -1099511627776 THEN 0 ELSE pow(gamma, bucket) * 2 / (gamma + 1) END AS x FROM r, g), done WHERE (w + 2) * 43200000000 <= mark GROUP BY 1, 2""")
def _(v):
    # closed windows only: an open one may still change, so append mode holds it back
    e = _events(v).drop("score").join(v.table("events").selectExpr("event_id", "value AS seconds"), "event_id")
    s = J.trace_sketch(stream_of(v, e, "tr"), ["event_type"], size="24 hours", slide="12 hours")
    return J.run_to_files(s, fresh(v, "sk")).withColumn("w", F.expr("unix_micros(w_start) div 43200000000"))


@query("stream_topn_segments", "event_type:s seg:l score:d frame_count:l best:l", sql="""
  SELECT event_type, seg, avg(s) FILTER (WHERE r <= 3) AS score, count(*) AS frame_count, min(event_id) FILTER (WHERE r = 1) AS best FROM (
   SELECT *, row_number() OVER (PARTITION BY event_type, seg ORDER BY s DESC, event_id) AS r FROM (
    SELECT event_type, event_id, (epoch_us(ts) - 1704067200000000) // 3600000000 AS seg, least(value / 517.3::DOUBLE, 1) AS s FROM events WHERE value IS NOT NULL)) GROUP BY 1, 2""")
def _(v):
    # an hour later, as Spark counts the epoch itself as late; the last row flushes
    e = _events(v).select("event_type", "event_id", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"), "score")
    end = e.agg(F.max("ts").alias("ts")).selectExpr("CAST(NULL AS STRING) AS event_type", "CAST(NULL AS BIGINT) AS event_id", "ts + INTERVAL 3 DAYS AS ts", "CAST(NULL AS DOUBLE) AS score")
    s = J.top_segments(stream_of(v, e.where("score IS NOT NULL").unionByName(end), "top"), ["event_type"], "event_id", width_ms=3_600_000)
    return J.run_to_files(s, fresh(v, "tops")).withColumn("seg", F.col("seg") - 1)
