"""Filter and guard queries."""
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.ocr import ocr_item_quality
from ..functions.text import semantic_eligible
from ..operators import filters as X
from ..operators.skew import top_k
from .registry import query


@query("resolve_scope", "video_id:l", views="members", sql="""
  SELECT DISTINCT video_id FROM members WHERE folder_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
  UNION SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT video_id FROM members)""")
def _(v):
    videos = v.table("supplier").select(F.col("s_suppkey").alias("video_id"))
    nation = v.table("nation").select(F.col("n_nationkey").cast("long").alias("folder_id"), "n_regionkey")
    return X.resolve_scope(videos, v.members, folder_ids=nation.where("n_regionkey = 1"), include_default=True, folders=nation)


@query("ready_publications", "video_id:l modality:s asset_version:s row_count:l", views="pointers",
       sql="SELECT * FROM pointers WHERE status = 'ready' AND trim(asset_version) <> ''")
def _(v):
    return X.ready_publications(v.pointers)


_REQ = """SELECT user_id, CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ['visual','asr'] WHEN 2 THEN ['ocr','face','speaker'] ELSE ['asr'] END AS req,
  user_id % 3 <> 0 AS has_text, user_id % 5 = 0 AS has_image, user_id % 2 = 0 AS has_face,
  list_distinct(list(CASE event_type WHEN 'click' THEN 'visual' WHEN 'view' THEN 'asr' WHEN 'purchase' THEN 'ocr' ELSE 'face' END)) AS idx
  FROM events GROUP BY user_id"""


@query("requested_channels", "video_id:l channels:s", sql=f"""
  SELECT user_id AS video_id, concat_ws('|', CASE WHEN face THEN 'face' END, CASE WHEN asr THEN 'asr' END,
     CASE WHEN ocr THEN 'ocr' END, CASE WHEN visual THEN 'visual' END) AS channels FROM (
    SELECT *, has_face AND list_contains(idx, 'face') AS face,
      has_text AND list_contains(idx, 'asr') AND (req IS NULL OR list_contains(req, 'asr')) AS asr,
      has_text AND list_contains(idx, 'ocr') AND (req IS NULL OR list_contains(req, 'ocr')) AS ocr,
      (has_text OR has_image) AND list_contains(idx, 'visual') AND (req IS NULL OR list_contains(req, 'visual')) AS visual FROM ({_REQ}))""")
def _(v):
    d = v.candidates.groupBy("video_id").agg(F.collect_set("modality").alias("idx")).withColumns({
        "requested": F.expr("CASE video_id % 4 WHEN 0 THEN NULL WHEN 1 THEN array('visual','asr') "
                            "WHEN 2 THEN array('ocr','face','speaker') ELSE array('asr') END"),
        "has_text": F.expr("video_id % 3 <> 0"), "has_image": F.expr("video_id % 5 = 0"), "has_face": F.expr("video_id % 2 = 0")})
    order = F.array(*[F.lit(c) for c in ("face", "asr", "ocr", "visual")])
    return d.select("video_id", F.array_join(F.array_intersect(order, X.requested_channels(d, "idx")), "|").alias("channels"))


@query("available_channels", "modality:s", views="pointers members", sql="""
  SELECT DISTINCT modality FROM pointers WHERE status = 'ready' AND modality IN ('visual','face','asr','ocr')
  AND video_id IN (SELECT video_id FROM members)""")
def _(v):
    return X.available_channels(v.pointers, v.members)


@query("require_int", "event_id:l", sql="SELECT event_id FROM events WHERE value = floor(value)")
def _(v):
    return v.table("events").where(X.require_int("value"))


@query("require_nonneg_int", "c_custkey:l", sql="SELECT c_custkey FROM customer WHERE c_acctbal * 100 % 50 = 0 AND c_acctbal >= 0 AND floor(c_acctbal / 0.5) = c_acctbal / 0.5")
def _(v):
    return v.table("customer").where(X.require_nonneg_int(F.col("c_acctbal") / 0.5))


@query("require_time_window", "video_id:l modality:s rows:l dropped:l kept:l", views="candidates", sql="""
  SELECT video_id, modality, count(*) AS "rows", count(*) FILTER (WHERE NOT coalesce(s >= 0 AND s < e, false)) AS dropped,
   count(*) FILTER (WHERE s >= 0 AND s < e) AS kept
  FROM (SELECT *, CASE WHEN unit_id % 17 = 0 THEN NULL ELSE start_time - 24 END AS s, end_time - 25.5 AS e FROM candidates) GROUP BY 1, 2""")
def _(v):
    d = v.candidates.selectExpr("video_id", "modality", "CASE WHEN unit_id % 17 = 0 THEN NULL ELSE start_time - 24 END AS start_ms",
                                "end_time - 25.5 AS end_ms")
    kept = X.require_time_window(d).groupBy("video_id", "modality").agg(F.count("*").alias("kept"))
    return X.dropped_time_rows(d, ["video_id", "modality"]).join(kept, ["video_id", "modality"], "left").fillna(0)


@query("require_point_in_window", "video_id:l track_idx:l", views="tracks",
       sql="SELECT video_id, track_idx FROM tracks WHERE best_ms + detections * 200 BETWEEN start_ms AND end_ms")
def _(v):
    d = v.tracks.withColumn("p", F.col("best_ms") + F.col("detections") * 200)
    return X.require_point_in_window(d, "p")


@query("valid_visual_hits", "vec_id:l", views="frames", sql="""
  SELECT vec_id FROM frames WHERE timestamp_ms + (vec_id % 3) * 2500 BETWEEN segment_start_ms AND segment_end_ms""")
def _(v):
    d = v.frames.withColumns({"timestamp_ms": F.expr("timestamp_ms + (vec_id % 3) * 2500"), "score": F.col("embedding")[0].cast("double")})
    return X.valid_visual_hits(d)


@query("consistent_segments", "vec_id:l", views="frames", sql="""
  WITH d AS (SELECT *, segment_end_ms + CASE WHEN frame_idx % 40 = 7 THEN 5 ELSE 0 END AS e FROM frames),
  g AS (SELECT video_id, segment_id FROM d GROUP BY 1, 2 HAVING min(e) = max(e) AND min(segment_start_ms) = max(segment_start_ms))
  SELECT vec_id FROM d JOIN g USING (video_id, segment_id)""")
def _(v):
    d = v.frames.withColumn("segment_end_ms", F.expr("segment_end_ms + CASE WHEN frame_idx % 40 = 7 THEN 5 ELSE 0 END"))
    return X.consistent_segments(d, ["video_id", "segment_id"])


@query("has_embedding_filter", "doc_id:l", views="text_units", sql="SELECT doc_id FROM text_units WHERE has_embedding")
def _(v):
    return X.has_embedding_filter(v.text_units)


@query("absolute_threshold", "unit_id:l above_threshold:b decision:s", views="candidates", sql="""
  SELECT unit_id, raw_score >= 0.35 AS above_threshold, CASE WHEN raw_score >= 0.35 THEN 'absolute_hit' ELSE 'weak' END AS decision
  FROM candidates WHERE modality = 'face'""")
def _(v):
    return X.absolute_threshold(v.candidates.where("modality = 'face'"), 0.35)


@query("global_dynamic_threshold", "unit_id:l above_threshold:b threshold:d", views="candidates", sql="""
  SELECT unit_id, CASE WHEN modality IN ('ocr','asr') THEN score >= t ELSE true END AS above_threshold,
   CASE WHEN modality IN ('ocr','asr') THEN t END AS threshold FROM candidates JOIN (
    SELECT query_id, modality, greatest(0.10, max(score) * 0.3) AS t FROM candidates GROUP BY 1, 2) USING (query_id, modality)""")
def _(v):
    return X.global_dynamic_threshold(v.candidates)


@query("utterance_visible", "video_id:l utterance_idx:l", views="utterances overlays", sql="""
  SELECT u.video_id, u.utterance_idx FROM utterances u LEFT JOIN overlays o USING (video_id, utterance_idx)
  WHERE coalesce(o.searchable, 1) = 1 AND u.utterance_idx <> u.video_id % 4""")
def _(v):
    own = v.utterances.where("utterance_idx = video_id % 4").select("video_id", "utterance_idx")
    return X.utterance_visible(v.utterances, v.overlays, own)


@query("confidence_filter", "query_id:l moment_id:l score:d rank:l", views="candidates", sql="""
  SELECT query_id, moment_id, score, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, moment_id) AS rk
   FROM (SELECT query_id, video_id AS moment_id, max(score) AS score, count(DISTINCT modality) AS source_count FROM candidates GROUP BY 1, 2)
   WHERE score >= 0.01 AND source_count >= 3) WHERE rk <= 50""")
def _(v):
    m = v.candidates.groupBy("query_id", F.col("video_id").alias("moment_id")).agg(
        F.max("score").alias("score"), F.size(F.collect_set("modality")).alias("source_count"))
    return X.confidence_filter(m, 0.01, 3, 50)


@query("ocr_item_quality", "event_id:l verdict:s", sql="""
  SELECT event_id, CASE WHEN score <= 0 THEN 'drop' WHEN regexp_full_match(txt, '[^\\p{L}\\p{N}]+') THEN 'drop'
    WHEN length(replace(txt,' ','')) <= 1 AND score < 0.85 THEN 'drop'
    WHEN length(replace(txt,' ','')) >= 4 AND replace(txt,' ','') = repeat(left(replace(txt,' ',''), 1), length(replace(txt,' ',''))) THEN 'drop'
    WHEN regexp_full_match(replace(txt,' ',''), '[0-9]{1,2}') AND score < 0.8 THEN 'drop'
    WHEN w < 2 OR h < 2 THEN 'drop' WHEN w / greatest(h, 1) > 40 OR w / greatest(h, 1) < 0.025 THEN 'drop'
    WHEN w * h / 2073600.0 < 0.00001 AND score < 0.9 THEN 'drop' ELSE 'keep' END AS verdict
  FROM (SELECT event_id, least(value / 400, 1.0) AS score, CASE event_id % 6 WHEN 0 THEN '--' WHEN 1 THEN CAST(event_id % 100 AS VARCHAR)
     WHEN 2 THEN 'aaaaa' WHEN 3 THEN event_type WHEN 4 THEN 'x' ELSE props END AS txt,
     (event_id % 90) * 1.0::DOUBLE AS w, 1.0 + user_id % 30 AS h FROM events)""")
def _(v):
    d = v.table("events").selectExpr(
        "event_id", "least(value / 400, 1.0D) AS score",
        "CASE event_id % 6 WHEN 0 THEN '--' WHEN 1 THEN CAST(event_id % 100 AS STRING) WHEN 2 THEN 'aaaaa' "
        "WHEN 3 THEN event_type WHEN 4 THEN 'x' ELSE props END AS text",
        "array(named_struct('x', 0.0D, 'y', 0.0D), named_struct('x', (event_id % 90) * 1.0D, 'y', 0.0D), "
        "named_struct('x', (event_id % 90) * 1.0D, 'y', 1.0D + user_id % 30), named_struct('x', 0.0D, 'y', 1.0D + user_id % 30)) AS box",
        "1920.0D AS width", "1080.0D AS height")
    ok = ocr_item_quality("text", "score", "box", "width", "height")
    return d.select("event_id", F.when(ok, "keep").otherwise("drop").alias("verdict"))


@query("semantic_eligible", "doc_id:l eligible:b reason:s")
def _(v):
    d = semantic_eligible(v.text_units, "text", F.col("end_ms") - F.col("start_ms"), "q")
    return d.select("doc_id", F.col("q.eligible"), F.col("q.reason"))


@query("meaningful_text", "video_id:l item_id:l", views="items", sql="""
  SELECT video_id, item_id FROM items WHERE length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) >= 2 AND end_ms > start_ms""")
def _(v):
    return v.items.where(X.meaningful_text("text", "start_ms", "end_ms"))


@query("valid_vector", "vec_id:l unit:b", sql="""
  SELECT vec_id, abs(n - 1) <= 1e-3 AS unit FROM (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END
   * sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n, len(embedding) AS d FROM embeddings) WHERE n > 1e-12 AND d = 64""")
def _(v):
    from ..functions.vector import is_unit
    d = v.vectors().withColumn("embedding", F.when(F.expr("vec_id % 3 = 0"), F.transform("embedding", lambda x: x * 2)).otherwise(F.col("embedding")))
    return X.valid_vectors(d, dim=64).select("vec_id", is_unit("embedding").alias("unit"))


@query("normalize_channels", "user_id:l channels:s", sql="""
  SELECT user_id, CASE user_id % 3 WHEN 0 THEN 'asr|visual' WHEN 1 THEN 'face' ELSE 'ocr|speaker' END AS channels FROM events""")
def _(v):
    d = v.table("events").selectExpr("user_id", "CASE user_id % 3 WHEN 0 THEN ' ASR,visual,asr ' WHEN 1 THEN 'Face,,face' ELSE 'ocr, SPEAKER' END AS csv")
    return d.select("user_id", F.array_join(X.normalize_channels("csv"), "|").alias("channels"))


@query("clamp_limits", "o_orderkey:l limit:l candidate_limit:l result_limit:l rerank_top_n:l frame_count:l n_sub:l", sql="""
  SELECT o_orderkey, lim AS "limit", cand AS candidate_limit, least(k % 90, cand) AS result_limit, least(k % 50, cand) AS rerank_top_n,
   CASE WHEN k % 15 >= 9 THEN greatest(k % 12, 8) ELSE k % 12 END AS frame_count, least(1 + k % 6, 4) AS n_sub FROM (
  SELECT o_orderkey, o_orderkey AS k, greatest(1, least(o_orderkey % 150, 100)) AS lim,
   greatest(1, least(o_orderkey % 400, 300, greatest(1, least(o_orderkey % 150, 100)) * 3)) AS cand FROM orders)""")
def _(v):
    k = F.col("o_orderkey")
    subs = F.transform(F.sequence(F.lit(0), k % 6), lambda i: F.concat(F.lit(" q"), i.cast("string")))
    return v.table("orders").select("o_orderkey", *[c.alias(n) for n, c in X.clamp_limits(
        k % 150, k % 400, k % 90, k % 50, k % 12, k % 15).items()], F.size(X.clamp_subqueries(subs)).alias("n_sub"))


@query("clamp_clip_bounds", "unit_id:l clip_end:d", views="candidates", sql="""
  SELECT unit_id, greatest(start_time + 0.25, least(end_time + unit_id % 60, start_time + 45, 700)) AS clip_end FROM candidates""")
def _(v):
    return v.candidates.withColumn("clip_end", X.clamp_clip_bounds(
        F.col("start_time"), F.col("end_time") + F.col("unit_id") % 60, F.lit(700.0)))


@query("schema_contract", "video_id:l n:l", views="tracks", sql="SELECT video_id, count(*) AS n FROM tracks GROUP BY 1")
def _(v):
    need = StructType([StructField("video_id", LongType()), StructField("track_idx", LongType())])
    return X.schema_contract(v.tracks, need).groupBy("video_id").agg(F.count("*").alias("n"))


@query("indexed_flag", "video_id:l modality:s indexed:b", views="pointers",
       sql="SELECT video_id, modality, status = 'ready' AND row_count > 0 AS indexed FROM pointers")
def _(v):
    return X.indexed_flag(v.pointers)


@query("vector_lookup", "video_id:l utterance_idx:l first:d", views="utterances", sql="""
  SELECT video_id, utterance_idx, embedding[1] AS "first" FROM utterances WHERE utterance_idx = 0""")
def _(v):
    want = v.utterances.groupBy("video_id").agg(F.min("utterance_idx").alias("utterance_idx"))
    return X.vector_lookup(want, v.utterances, ["video_id", "utterance_idx"]).withColumn("first", F.col("embedding")[0].cast("double"))


@query("select_queries", "query_id:l pos:l text:s", sql="""
  SELECT item_id AS query_id, row_number() OVER (ORDER BY item_id DESC) - 1 AS pos, text FROM benchmark""")
def _(v):
    q = v.table("benchmark").select(F.col("item_id").alias("query_id"), "text")
    ids = q.select("query_id", (q.agg(F.max("query_id")).scalar() - F.col("query_id")).alias("pos"))
    return X.select_queries(q, ids)


@query("major_groups", "video_id:l group_idx:l importance:d rank:l", views="tracks", sql="""
  SELECT video_id, group_idx, importance, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY importance DESC, start_ms, group_idx) AS rk
   FROM (SELECT video_id, label AS group_idx, sum(end_ms - start_ms) AS duration_ms, sum(detections) AS occurrence_count, min(start_ms) AS start_ms,
    0.55 * ln(1 + sum(end_ms - start_ms) / 1000.0::DOUBLE) AS importance FROM tracks GROUP BY 1, 2)
   WHERE duration_ms >= 3000 OR occurrence_count >= 3) WHERE rk <= 24""")
def _(v):
    g = v.tracks.groupBy("video_id", F.col("label").alias("group_idx")).agg(
        F.sum(F.expr("end_ms - start_ms")).alias("duration_ms"), F.sum("detections").alias("occurrence_count"),
        F.min("start_ms").alias("start_ms")).withColumn("importance", 0.55 * F.log1p(F.col("duration_ms") / 1000.0))
    return X.major_groups(g)
