"""Queries of order-dependent operators. Where a recursive SQL twin would be longer than the operator, the tests compare with brute force."""
from pyspark.sql import functions as F

from ..operators import identity as D
from ..operators import moments as M
from ..operators import transcript as T
from ..operators.intervals import truth_overlap_join
from ..operators.skew import top_k
from ..operators.windows import topk_per_video_channel
from .registry import query


def limited(v, k=300):
    """Candidates under the per-video channel limit, as every grouping operator receives them."""
    return topk_per_video_channel(v.candidates, k).drop("rank")


@query("group_moments", "unit_id:l query_id:l video_id:l gid:s")
def _(v):
    return M.group_moments(limited(v))


@query("group_ocr_score_first", "unit_id:l query_id:l video_id:l island:l ocr_group:l")
def _(v):
    return M.group_ocr_score_first(limited(v).where("modality = 'ocr'"), ["query_id", "video_id"], gap=2.0)


@query("fuse_results", "query_id:l video_id:l gid:s score:d channels:s rank:l", views="candidates", sql="""
  WITH m AS (SELECT query_id, video_id, CAST(floor(start_time / 15) AS BIGINT) AS g, modality, max(score) AS best, min(start_time) AS s, max(end_time) AS e FROM candidates GROUP BY 1, 2, 3, 4),
  f AS (SELECT query_id, video_id, CAST(g AS VARCHAR) AS gid, min(s) AS s, max(e) AS e, sum(w * best) / sum(w) AS score, string_agg(modality, '|' ORDER BY modality) AS channels FROM (
    SELECT *, CASE modality WHEN 'face' THEN 0.55::DOUBLE WHEN 'visual' THEN 0.30 WHEN 'ocr' THEN 0.20 ELSE 0.15 END AS w FROM m) GROUP BY query_id, video_id, g)
  SELECT query_id, video_id, gid, score, channels, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s, video_id, e, gid) AS rk FROM f) WHERE rk <= 100""")
def _(v):
    g = v.candidates.withColumn("gid", F.floor(F.col("start_time") / 15).cast("string"))
    return M.fuse_results(g, limit=100).withColumn("channels", F.array_join("modalities", "|"))


@query("fuse_grouped_moments", "query_id:l video_id:l start_time:d end_time:d score:d channels:s rank:l")
def _(v):
    r = M.fuse_results(M.group_moments(limited(v)), limit=100)
    return r.withColumn("channels", F.array_join("modalities", "|"))


@query("score_band", "unit_id:l admitted:b", views="candidates", sql="""
  SELECT unit_id, raw_score >= hi - 0.15 AND raw_score <= lo + 0.15 AS admitted FROM candidates JOIN (SELECT video_id, min(raw_score) AS lo, max(raw_score) AS hi
   FROM candidates WHERE modality = 'face' AND query_id = 0 GROUP BY 1) USING (video_id) WHERE modality = 'face' AND query_id <> 0""")
def _(v):
    face = v.candidates.where("modality = 'face'")
    g = face.where("query_id = 0").groupBy("video_id").agg(F.min("raw_score").alias("lo"), F.max("raw_score").alias("hi"))
    return M.score_band(face.where("query_id <> 0"), g, ["video_id"])


@query("build_chunks", "video_id:l chunk_id:l start_ms:l end_ms:l text:s n_items:l semantic_eligible:b quality_flags:s")
def _(v):
    c = T.build_chunks(v.items, max_chars=2000)
    return c.withColumns({"n_items": F.size("source_item_ids"), "quality_flags": F.array_join("quality_flags", "|")})


@query("chunk_stats", "video_id:l raw_items:l normalized_items:l retrieval_chunks:l merged_items:l dropped_empty_items:l", sql=r"""
  WITH RECURSIVE t AS (SELECT *, trim(regexp_replace(coalesce(text, ''), '[\s\p{Z}]+', ' ', 'g')) AS n FROM conversations),
  i AS (SELECT *, row_number() OVER (PARTITION BY video_id, unit_id ORDER BY start_ms, end_ms, turn) AS k FROM (
    SELECT conv_id AS video_id, turn, turn // 4 AS unit_id, turn * 4000 AS start_ms, greatest(turn * 4000, turn * 4000 + 4000 - length(text) % 1500) AS end_ms,
     length(replace(regexp_replace(lower(n), '[^\p{L}\p{N}]+', '', 'g'), 'ß', 'ss')) AS chars, regexp_matches(n, '[.!?。！？]$') AS closed FROM t WHERE n <> '')),
  f AS (SELECT video_id, unit_id, k, start_ms, end_ms, chars, closed, true AS opens FROM i WHERE k = 1
   UNION ALL SELECT video_id, unit_id, k, CASE WHEN fits THEN s ELSE start_ms END, CASE WHEN fits THEN greatest(e, end_ms) ELSE end_ms END,
    CASE WHEN fits THEN c + chars ELSE chars END, closed, NOT fits FROM (
     SELECT i.*, f.start_ms AS s, f.end_ms AS e, f.chars AS c, NOT f.closed AND f.chars + i.chars <= 2000 AND greatest(f.end_ms, i.end_ms) - f.start_ms <= 12000
       AND (i.start_ms - f.end_ms <= CASE WHEN f.chars <= 8 OR i.chars <= 8 THEN 1000 ELSE 500 END
        OR f.start_ms // 5000 = i.start_ms // 5000 AND greatest(f.end_ms, i.end_ms) - f.start_ms <= 8000 AND i.start_ms - f.end_ms <= 1000) AS fits
     FROM f JOIN i ON i.video_id = f.video_id AND i.unit_id = f.unit_id AND i.k = f.k + 1)),
  c AS (SELECT video_id, count(*) AS n FROM f WHERE opens GROUP BY 1)
  SELECT conv_id AS video_id, count(*) AS raw_items, count(*) FILTER (WHERE t.n <> '') AS normalized_items, coalesce(max(c.n), 0) AS retrieval_chunks,
   normalized_items - retrieval_chunks AS merged_items, count(*) FILTER (WHERE t.n = '') AS dropped_empty_items FROM t LEFT JOIN c ON c.video_id = conv_id GROUP BY 1""")
def _(v):
    return T.chunk_stats(v.items, T.build_chunks(v.items, max_chars=2000))


@query("split_safe_punctuation", "video_id:l item_id:l piece:l split:s start_ms:l end_ms:l text:s")
def _(v):
    return T.split_safe_punctuation(v.items.withColumn("end_ms", F.col("start_ms") + F.length("text") * 60))


def _timed(v):
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    d = v.table("conversations").select("conv_id", "turn", "text", words.alias("words"))
    return d.withColumn("timestamp", F.transform("words", lambda w, i: F.array((i * 300).cast("long"), (i * 300 + 250 + F.when(i % 20 == 19, -2000).otherwise(0)).cast("long"))))


@query("split_word_timestamps", "conv_id:l turn:l item_id:l start_ms:l end_ms:l text:s reason:s")
def _(v):
    return T.split_word_timestamps(_timed(v), ["conv_id", "turn"])


@query("split_char_timestamps", "conv_id:l turn:l item_id:l start_ms:l end_ms:l text:s reason:s")
def _(v):
    letters = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}_]", ""))
    d = v.table("conversations").withColumn("timestamp", F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), letters)), lambda i: F.array((i * 80).cast("long"), (i * 80 + 70).cast("long"))))
    return T.split_char_timestamps(d, ["conv_id", "turn"])


@query("split_words_by_gap", "conv_id:l turn:l first_word:l start_time:d end_time:d text:s")
def _(v):
    w = _timed(v).select("conv_id", "turn", F.posexplode("words").alias("word_idx", "word")).withColumns({
        "word_idx": F.col("word_idx").cast("long"), "start_time": F.col("word_idx") * 0.3 + F.floor(F.col("word_idx") / 25) * 2.0})
    return T.split_words_by_gap(w.withColumn("end_time", F.col("start_time") + 0.25), ["conv_id", "turn"])


@query("split_udtf", "video_id:l item_id:l idx:l start_ms:l end_ms:l text:s")
def _(v):
    from ..udfs import register_split_udtf
    register_split_udtf(v.spark)
    items = v.items.selectExpr("video_id", "item_id", "start_ms", "start_ms + length(text) * 60 AS end_ms", "text")
    return v.spark.sql("SELECT i.video_id, i.item_id, p.* FROM {items} i, LATERAL split_item(i.text, i.start_ms, i.end_ms, 12000) p", items=items)


@query("read_asr_records", "conv_id:l turn:l item_id:l start_ms:l end_ms:l text:s source:s mismatch:b")
def _(v):
    d = _timed(v)
    r = d.select("conv_id", "turn", F.from_json(F.to_json(F.struct(
        F.when(F.col("turn") % 4 == 0, F.array(F.struct((F.col("turn") * 1000).alias("start"), (F.col("turn") * 1000 + 900).alias("end"), F.col("text").alias("text")))).alias("sentence_info"),
        F.concat(F.lit("<|happy|>"), "text").alias("text"), F.when(F.col("turn") % 4 == 1, F.col("words")).alias("words"),
        F.when(F.col("turn") % 4 < 3, F.col("timestamp")).alias("timestamp"), (F.col("turn") * 10).alias("start"), (F.col("turn") * 10 + 500).alias("end"))), T.RECORD_SCHEMA).alias("r"))
    return T.read_asr_records(r.select("conv_id", "turn", "r.*"), ["conv_id", "turn"])


@query("gap_sessions_capped", "video_id:l start:d end:d intervals:l", views="candidates", sql="""SELECT * FROM (
  WITH RECURSIVE r AS (SELECT video_id, start_time AS s, end_time AS e, row_number() OVER (PARTITION BY video_id ORDER BY start_time, end_time, unit_id) AS n FROM candidates WHERE modality IN ('visual', 'asr')),
  f AS (SELECT video_id, n, s, e, 1 AS g FROM r WHERE n = 1 UNION ALL
   SELECT r.video_id, r.n, CASE WHEN r.s - f.e <= 2 AND r.e - f.s <= 12 THEN f.s ELSE r.s END, r.e, f.g + CASE WHEN r.s - f.e <= 2 AND r.e - f.s <= 12 THEN 0 ELSE 1 END FROM f JOIN r ON r.video_id = f.video_id AND r.n = f.n + 1)
  SELECT video_id, min(s) AS start, max_by(e, n) AS "end", count(*) AS intervals FROM f GROUP BY video_id, g)""")
def _(v):
    return T.gap_sessions_capped(v.intervals("visual", "asr"), ["video_id"], 2.0, 12.0, "unit_id", 24.0)


@query("fallback_acceptance", "user_id:l accepted:b reason:s")
def _(v):
    e = v.candidates.selectExpr("video_id AS user_id", "unit_id AS row_id", "start_time", "end_time", "concat(modality, CASE WHEN unit_id % 3 = 0 THEN '. ' ELSE ' ' END) AS text", "modality")
    w = e.select("user_id").distinct().selectExpr("user_id", "0D AS w_start", "800D AS w_end")
    p, f = e.where("modality IN ('asr', 'ocr')"), e.where("modality IN ('asr', 'ocr') AND row_id % 7 <> 0")
    f = f.withColumn("text", F.when(F.col("row_id") % 2 == 0, F.concat(F.trim("text"), F.lit("."))).otherwise(F.col("text")))
    return T.fallback_acceptance(p, f, w, ["user_id"])


@query("speaker_turns", "video_id:l idx:l start:d end:d label:l")
def _(v):
    w = v.intervals("visual", "asr").selectExpr("video_id", "unit_id AS idx", "start", "end", "unit_id % 2 AS label")
    return D.speaker_turns(w, width=24.0)


@query("track_detections", "video_id:l track_idx:l start_ms:l end_ms:l best_ms:l detections:l quality:d")
def _(v):
    d = v.frames.selectExpr("video_id", "vec_id AS det_id", "floor(frame_idx / 4) * 0.5 + floor(frame_idx / 40) * 3 AS ts", "(vec_id % 100) / 100.0D AS det_score",
                            "(vec_id * 7 % 101) / 101.0D AS quality", "array(10.0D * (label % 5), 0.0D, 10.0D * (label % 5) + 8, 8.0D) AS bbox", "embedding")
    return D.track_detections(d)


@query("cluster_identities", "video_id:l track_idx:l group_seq:l")
def _(v):
    return D.cluster_identities(v.tracks)


@query("identity_groups", "video_id:l group_idx:l duration_ms:l occurrence_count:l representative:l importance:d")
def _(v):
    return D.identity_groups(v.tracks)


@query("cluster_density_fallback", "video_id:l vec_id:l label:l")
def _(v):
    return D.density_fallback(v.frames.withColumn("label", F.lit(0).cast("long")), ["video_id"], 16, 6)


@query("nonoverlap_preview", "video_id:l track_id:l utterance_idx:l preview:l")
def _(v):
    from ..operators.aggregates import vector_mean
    u = v.utterances.withColumn("end_ms", F.col("start_ms") + 4500)
    return D.speaker_preview(u, vector_mean(u, ["video_id", "track_id"]))


@query("shot_boundaries", "video_id:l ts_ms:l", views="candidates", sql="""SELECT * FROM (
  WITH RECURSIVE c AS (SELECT DISTINCT video_id, CAST(trunc(start_time * 1000) AS BIGINT) AS t FROM candidates WHERE score * 3 >= 0.45),
  f AS (SELECT DISTINCT video_id, 0::BIGINT AS ts_ms FROM candidates UNION ALL SELECT f.video_id, min(c.t) FROM f JOIN c ON c.video_id = f.video_id AND c.t >= f.ts_ms + 5000 GROUP BY f.video_id)
  SELECT video_id, ts_ms FROM f)""")
def _(v):
    f = v.candidates.selectExpr("video_id", "CAST(start_time * 1000 AS BIGINT) AS ts_ms", "score * 3 AS difference")
    return D.shot_boundaries(f, ["video_id"], 0.45, 5000, 48_000.0)


@query("reading_order", "video_id:l box_id:l pos:l")
def _(v):
    b = v.table("events").selectExpr("user_id AS video_id", "event_id AS box_id", "value AS left", "(event_id * 37 % 500) * 1.0D AS top", "(event_id * 37 % 500) + 10.0D + event_id % 9 AS bottom")
    return D.reading_order(b, ["video_id"])


@query("max_matching", "query_id:l k:l matched:l")
def _(v):
    r = top_k(v.candidates.where("modality = 'asr'"), ["query_id"], [F.desc("score"), F.asc("unit_id")], 20).selectExpr(
        "query_id", "video_id", "rank", "start_time AS start", "end_time AS end")
    p = truth_overlap_join(r, v.truth, 4.0).select("query_id", "rank", "truth_id")
    return D.max_matching(p, ["query_id"])
