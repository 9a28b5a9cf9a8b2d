"""Aggregation queries."""
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators.knn import knn_join
from .registry import query

HITS = """SELECT query_id, query_idx, video_id, frame_idx, segment_id, timestamp_ms, segment_start_ms, segment_end_ms, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, query_idx, video_id ORDER BY score DESC, frame_idx) AS rk FROM (
   SELECT query_id, query_idx, video_id, frame_idx, segment_id, timestamp_ms, segment_start_ms, segment_end_ms,
    list_cosine_similarity(embedding, vec) AS score FROM frames, qv)) WHERE rk <= 30"""
FRAME = f"""SELECT query_id, video_id, segment_id, frame_idx, timestamp_ms, segment_start_ms, segment_end_ms,
   0.65 * sum(score) / 3 + 0.35 * CASE WHEN count(*) < 3 THEN least(min(score), 0) ELSE min(score) END AS score
  FROM ({HITS}) GROUP BY 1, 2, 3, 4, 5, 6, 7"""
FRAME_KEYS = ["video_id", "segment_id", "frame_idx", "timestamp_ms", "segment_start_ms", "segment_end_ms"]


def frame_scores(v):
    h = knn_join(v.qv, v.frames, 30, keep=("frame_idx", "segment_id", "timestamp_ms", "segment_start_ms", "segment_end_ms"), tie=("frame_idx",))
    n = v.qv.groupBy("query_id").agg(F.count("*").alias("n"))
    return A.frame_multiquery_agg(h, n, FRAME_KEYS)


@query("frame_multiquery_agg", "query_id:l video_id:l frame_idx:l score:d", views="frames qv", sql=FRAME)
def _(v):
    return frame_scores(v)


@query("segment_topn_mean", "query_id:l video_id:l segment_id:l score:d frame_count:l best_ms:l start_ms:l end_ms:l", views="frames qv", sql=f"""
  SELECT query_id, video_id, segment_id, avg(score) FILTER (WHERE rk <= 3) AS score, count(*) AS frame_count,
   max(timestamp_ms) FILTER (WHERE rk = 1) AS best_ms, max(segment_start_ms) AS start_ms, max(segment_end_ms) AS end_ms
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id, segment_id ORDER BY score DESC, frame_idx) AS rk FROM ({FRAME})) GROUP BY 1, 2, 3""")
def _(v):
    return A.segment_topn_mean(frame_scores(v), ["query_id", "video_id", "segment_id"])


_BEST = "SELECT query_id, video_id, modality, greatest(-1, max(score)) AS best FROM candidates GROUP BY 1, 2, 3"
_W = "CASE modality WHEN 'face' THEN 0.55 WHEN 'visual' THEN 0.30 WHEN 'ocr' THEN 0.20 WHEN 'asr' THEN 0.15 ELSE 1 END"


@query("modality_max", "query_id:l video_id:l modality:s best:d", views="candidates", sql=_BEST)
def _(v):
    return A.modality_max(v.candidates, ["query_id", "video_id"])


@query("weighted_fusion", "query_id:l video_id:l score:d", views="candidates", sql=f"""
  SELECT query_id, video_id, sum({_W} * best) / sum({_W}) AS score FROM ({_BEST}) GROUP BY 1, 2""")
def _(v):
    return A.weighted_fusion(A.modality_max(v.candidates, ["query_id", "video_id"]), ["query_id", "video_id"])


@query("group_rollup", "query_id:l video_id:l day:l start_time:d end_time:d score:d channels:s above_threshold:b decision:s best_ms:l n:l", views="candidates", sql=f"""
  WITH c AS (SELECT *, CAST(floor(start_time / 24) AS BIGINT) AS day, unit_id % 5 <> 0 AS above, CASE WHEN unit_id % 3 = 0 THEN NULL ELSE unit_id END AS bm,
     CASE unit_id % 4 WHEN 0 THEN 'weak' WHEN 1 THEN 'lexical_hit' WHEN 2 THEN 'absolute_hit' ELSE 'odd' END AS decision FROM candidates),
  s AS (SELECT query_id, video_id, day, sum({_W} * best) / sum({_W}) AS score FROM (SELECT query_id, video_id, day, modality, max(score) AS best FROM c GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)
  SELECT query_id, video_id, day, min(start_time) AS start_time, max(end_time) AS end_time, any_value(s.score) AS score, string_agg(DISTINCT modality, '|' ORDER BY modality) AS channels,
   bool_or(above) AS above_threshold, CASE WHEN bool_or(decision = 'absolute_hit') THEN 'absolute_hit' WHEN bool_or(decision = 'lexical_hit') THEN 'lexical_hit'
    WHEN bool_or(decision = 'weak') THEN 'weak' ELSE 'hit' END AS decision,
   coalesce(arg_max(bm, c.score) FILTER (WHERE bm IS NOT NULL), CAST(round_even(min(start_time) * 1000, 0) AS BIGINT)) AS best_ms, count(*) AS n
  FROM c JOIN s USING (query_id, video_id, day) GROUP BY 1, 2, 3""")
def _(v):
    c = v.candidates.withColumns({
        "day": F.floor(F.col("start_time") / 24), "above_threshold": F.expr("unit_id % 5 <> 0"),
        "best_ms": F.expr("CASE WHEN unit_id % 3 = 0 THEN NULL ELSE unit_id END"),
        "decision": F.expr("CASE unit_id % 4 WHEN 0 THEN 'weak' WHEN 1 THEN 'lexical_hit' WHEN 2 THEN 'absolute_hit' ELSE 'odd' END"),
        "file": F.col("_metadata.file_path"), "row": F.col("_metadata.row_index")})
    g = A.group_rollup(c, ["query_id", "video_id", "day"], order=["file", "row"])  # arg_max takes the first of equal scores
    return g.withColumns({"channels": F.array_join("modalities", "|"), "n": F.size("evidence")})


_MEAN = """SELECT {k}, list(m / n ORDER BY i) AS c FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY {k})) AS n FROM (
   SELECT {k}, i, sum(x * w) / sum(w) AS m FROM (SELECT *, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM {t}) GROUP BY {k}, i)) GROUP BY {k}"""


@query("vector_mean", "video_id:l label:l first:d last:d", views="tracks", sql=f"""
  SELECT video_id, label, c[1] AS "first", c[64] AS "last" FROM ({_MEAN.format(k='video_id, label', t='(SELECT *, 1 AS w FROM tracks)')})""")
def _(v):
    return A.vector_mean(v.tracks, ["video_id", "label"]).withColumns({"first": F.col("centroid")[0], "last": F.col("centroid")[63]})


@query("weighted_vector_mean", "video_id:l label:l first:d last:d", views="tracks", sql=f"""
  SELECT video_id, label, c[1] AS "first", c[64] AS "last" FROM ({_MEAN.format(k='video_id, label', t='(SELECT *, greatest(quality, 0.1) AS w FROM tracks)')})""")
def _(v):
    return A.weighted_vector_mean(v.tracks, ["video_id", "label"]).withColumns({"first": F.col("centroid")[0], "last": F.col("centroid")[63]})


@query("representative", "video_id:l label:l representative:l rep_score:d", views="tracks", sql=f"""
  WITH c AS ({_MEAN.format(k='video_id, label', t='(SELECT *, greatest(quality, 0.1) AS w FROM tracks)')})
  SELECT video_id, label, track_idx AS representative, s AS rep_score FROM (SELECT *, row_number() OVER (PARTITION BY video_id, label ORDER BY s DESC, track_idx) AS rk FROM (
   SELECT video_id, label, track_idx, 0.7 * quality + 0.3 * list_cosine_similarity(embedding, c) AS s FROM tracks JOIN c USING (video_id, label))) WHERE rk = 1""")
def _(v):
    by = ["video_id", "label"]
    return A.representative(v.tracks, A.weighted_vector_mean(v.tracks, by), by, "track_idx", "quality")


@query("identity_group_rollup", "video_id:l label:l duration_ms:l occurrence_count:l start_ms:l end_ms:l importance:d", views="tracks", sql="""
  SELECT video_id, label, sum(greatest(0, end_ms - start_ms)) AS duration_ms, sum(greatest(1, detections)) AS occurrence_count, min(start_ms) AS start_ms, max(end_ms) AS end_ms,
   0.55 * ln(1 + sum(greatest(0, end_ms - start_ms)) / 1000.0::DOUBLE) + 0.25 * ln(1 + sum(greatest(1, detections))) + 0.2 * least(1, max(quality)) AS importance FROM tracks GROUP BY 1, 2""")
def _(v):
    return A.identity_group_rollup(v.tracks.withColumn("rep_quality", F.col("quality")), ["video_id", "label"])


@query("speaker_panel", "video_id:l track_id:l utterances:l duration_ms:l label:s hidden:b entity_id:l", views="utterances", sql="""
  SELECT video_id, track_id, count(*) AS utterances, sum(end_ms - start_ms) AS duration_ms,
   CASE WHEN video_id % 3 = 0 AND track_id = 1 THEN 'name' || video_id ELSE 'Speaker ' || track_id END AS label, video_id % 3 = 0 AND track_id = 1 AND video_id % 2 = 0 AS hidden,
   CASE WHEN track_id = 0 THEN video_id + 1000 END AS entity_id FROM utterances GROUP BY 1, 2""")
def _(v):
    u = v.utterances
    labels = u.where("video_id % 3 = 0").selectExpr("video_id", "CAST(1 AS BIGINT) AS track_id", "concat('name', video_id) AS display_name",
                                                    "CASE WHEN video_id % 2 = 0 THEN 1 ELSE 0 END AS hidden").distinct()
    bind = u.selectExpr("video_id", "CAST(0 AS BIGINT) AS track_id", "video_id + 1000 AS entity_id").distinct()
    return A.speaker_panel(u, labels, bind)


@query("best_per_utterance", "query_id:l video_id:l utterance_idx:l score:d query_idx:l", views="utterances qv", sql="""
  SELECT query_id, video_id, utterance_idx, score, query_idx FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id, utterance_idx ORDER BY score DESC, query_idx) AS rk
   FROM (SELECT query_id, query_idx, video_id, utterance_idx, list_cosine_similarity(embedding, vec) AS score FROM utterances, qv)) WHERE rk = 1""")
def _(v):
    return A.best_per_utterance(knn_join(v.qv, v.utterances, 500, keep=("utterance_idx",)))


@query("frame_text_agg", "conv_id:l text:s avg_box_score:d", sql="""
  SELECT conv_id, string_agg(trim(text), ' ' ORDER BY turn DESC) AS text, avg(length(text) % 100 / 100.0::DOUBLE) AS avg_box_score FROM conversations WHERE trim(text) <> '' GROUP BY 1""")
def _(v):
    b = v.table("conversations").withColumns({"score": F.length("text") % 100 / 100.0, "o": -F.col("turn")})
    return A.frame_text_agg(b, ["conv_id"], "o")


@query("visual_health", "video_id:l asset_version:s rows:l invalid_rows:l conflicting_segments:l", views="frames", sql="""
  WITH d AS (SELECT *, 'v' || (segment_id % 2) AS asset_version, segment_end_ms + CASE WHEN frame_idx % 40 = 7 THEN 5 ELSE 0 END AS e,
     timestamp_ms + CASE WHEN frame_idx % 30 = 3 THEN 9000 ELSE 0 END AS t FROM frames),
  s AS (SELECT video_id, asset_version, segment_id, count(*) AS n, count(*) FILTER (WHERE NOT (t BETWEEN segment_start_ms AND e)) AS bad, min(e) <> max(e) AS mixed FROM d GROUP BY 1, 2, 3)
  SELECT video_id, asset_version, sum(n) AS "rows", sum(bad) AS invalid_rows, count(*) FILTER (WHERE mixed) AS conflicting_segments FROM s GROUP BY 1, 2""")
def _(v):
    d = v.frames.withColumns({"asset_version": F.expr("concat('v', segment_id % 2)"),
                              "segment_end_ms": F.expr("segment_end_ms + CASE WHEN frame_idx % 40 = 7 THEN 5 ELSE 0 END"),
                              "timestamp_ms": F.expr("timestamp_ms + CASE WHEN frame_idx % 30 = 3 THEN 9000 ELSE 0 END")})
    return A.visual_health(d)


@query("contiguity_check", "video_id:l n:l contiguous:b", sql="""
  SELECT conv_id AS video_id, count(*) AS n, min(t) = 0 AND max(t) = count(*) - 1 AND count(DISTINCT t) = count(*) AND count(*) % 5 <> 4 AS contiguous
  FROM (SELECT conv_id, CASE WHEN conv_id % 4 = 1 THEN turn + 1 WHEN conv_id % 4 = 2 AND turn = 1 THEN 0 ELSE turn END AS t FROM conversations) GROUP BY 1""")
def _(v):
    d = v.table("conversations").selectExpr("conv_id AS video_id", "CASE WHEN conv_id % 4 = 1 THEN turn + 1 WHEN conv_id % 4 = 2 AND turn = 1 THEN 0 ELSE turn END AS turn")
    declared = d.groupBy("video_id").agg(F.count("*").alias("c")).selectExpr("video_id", "CASE WHEN c % 5 = 4 THEN c + 1 ELSE c END AS row_count")
    return A.contiguity_check(d, ["video_id"], "turn", declared)


@query("dedupe_or_conflict", "k:l event_type:s conflict:b", sql="""
  SELECT event_id // 2 AS k, min(event_type) AS event_type, min(event_type) <> max(event_type) AS conflict FROM events GROUP BY 1""")
def _(v):
    return A.dedupe_or_conflict(v.table("events").selectExpr("event_id div 2 AS k", "event_type"), ["k"], ["event_type"])


@query("track_id_universe", "video_id:l track_id:l", views="utterances overlays", sql="""
  SELECT video_id, track_id FROM utterances UNION SELECT video_id, corrected_track_id FROM overlays WHERE corrected_track_id >= 0""")
def _(v):
    return A.track_id_universe(v.utterances, v.overlays)


@query("version_select", "video_id:l asset_version:s rows:l verdict:s", sql="""
  WITH c AS (SELECT user_id AS video_id, 'v' || (event_id % (1 + user_id % 2)) AS asset_version, count(*) AS n FROM events GROUP BY 1, 2),
  m AS (SELECT k AS video_id, CASE k % 5 WHEN 0 THEN 'v0' WHEN 1 THEN 'v7' END AS version, CASE WHEN k % 7 = 0 THEN 3 END AS declared FROM (SELECT user_id AS k FROM events UNION SELECT c_custkey FROM customer)),
  g AS (SELECT video_id, count(*) AS vs, min(asset_version) AS one, min(n) AS n1 FROM c GROUP BY 1),
  j AS (SELECT m.*, coalesce(vs, 0) AS vs, one, n1, c.n AS nn, CASE WHEN version IS NOT NULL THEN coalesce(c.n, 0) WHEN vs = 1 THEN n1 ELSE 0 END AS r
    FROM m LEFT JOIN g USING (video_id) LEFT JOIN c ON c.video_id = m.video_id AND c.asset_version = m.version),
  k AS (SELECT *, CASE WHEN version IS NOT NULL AND vs > 0 AND nn IS NULL THEN 'version_has_no_rows' WHEN version IS NULL AND vs > 1 THEN 'ambiguous'
    WHEN declared IS NOT NULL AND declared <> r THEN 'row_count_mismatch' WHEN version IS NOT NULL THEN 'manifest' WHEN vs = 0 THEN 'empty' ELSE 'scan' END AS verdict FROM j)
  SELECT video_id, verdict, CASE WHEN verdict IN ('manifest','empty','scan') THEN CASE WHEN version IS NOT NULL THEN version WHEN vs = 1 THEN one ELSE 'empty' END END AS asset_version,
   CASE WHEN verdict IN ('manifest','empty','scan') THEN r END AS "rows" FROM k""")
def _(v):
    c = v.table("events").selectExpr("user_id AS video_id", "'asr' AS modality", "concat('v', event_id % (1 + user_id % 2)) AS asset_version").groupBy(
        "video_id", "modality", "asset_version").agg(F.count("*").alias("rows"))
    ids = v.table("events").select(F.col("user_id").alias("video_id")).union(v.table("customer").select("c_custkey")).distinct()
    m = ids.selectExpr("video_id", "'asr' AS modality", "CASE video_id % 5 WHEN 0 THEN 'v0' WHEN 1 THEN 'v7' END AS version", "CASE WHEN video_id % 7 = 0 THEN 3 END AS declared")
    return A.version_select(c, m)


@query("bm25_stats", "term:s df:l n_docs:l avgdl:d", sql="""
  WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents)
  SELECT term, count(*) AS df, (SELECT count(*) FROM t) AS n_docs, (SELECT avg(len(t)) FROM t) AS avgdl FROM (SELECT DISTINCT doc_id, unnest(t) AS term FROM t) GROUP BY 1""")
def _(v):
    return A.bm25_stats(v.table("documents"))


@query("text_profile", "lang:s chunks:l empty_chunks:l cjk_chars:l latin_chars:l digit_chars:l", sql="""
  SELECT lang, count(*) AS chunks, count(*) FILTER (WHERE trim(text) = '') AS empty_chunks, 0 AS cjk_chars,
   sum(length(regexp_replace(text, '[^a-zA-Z]', '', 'g'))) AS latin_chars, sum(length(regexp_replace(text, '[^0-9]', '', 'g'))) AS digit_chars FROM documents GROUP BY 1""")
def _(v):
    return A.text_profile(v.table("documents"), ["lang"])


@query("language_vote", "source:s language:s probability:d", sql="""
  SELECT source, lang AS language, mass / votes AS probability FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY votes DESC, mass DESC, lang DESC) AS rk FROM (
   SELECT source, lang, count(*) AS votes, sum((n_chars % 100) / 100.0::DOUBLE) AS mass FROM documents GROUP BY 1, 2)) WHERE rk = 1""")
def _(v):
    p = v.table("documents").selectExpr("source", "concat(' ', upper(lang)) AS language", "(n_chars % 100) / 100.0D AS probability")
    return A.language_vote(p, ["source"])


@query("indexed_models", "modality:s model:s", views="pointers", sql="""
  SELECT DISTINCT modality, CASE modality WHEN 'visual' THEN 'm' || (video_id % 2) ELSE 't' || (video_id % 4) END AS model FROM pointers
  WHERE status = 'ready' AND row_count > 0 AND (modality = 'visual' OR (modality = 'asr' AND video_id % 4 <> 1))""")
def _(v):
    p = v.pointers.selectExpr("*", "concat('m', video_id % 2) AS model_key", "concat('t', video_id % 4) AS semantic_model_key",
                              "CASE WHEN video_id % 4 = 1 THEN 'disabled' ELSE 'complete' END AS semantic_status")
    return A.indexed_models(p)


@query("table_fingerprint", "o_orderstatus:s rows:l x0:l x1:l x2:l x3:l s0:s s1:s s2:s s3:s")
def _(v):
    return A.table_fingerprint(v.table("orders"), ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"], ["o_orderstatus"])


def _evaluated(v):
    return v.table("orders").selectExpr(
        "o_orderkey AS query_id", "o_orderpriority AS category", "1 + o_orderkey % 4 AS truth", "o_orderkey % 17 = 0 AS failed",
        "CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 1 + o_custkey % 25 END AS first_hit",
        "map_from_arrays(array(1,3,5,10,20), transform(array(1,3,5,10,20), k -> least(1 + o_orderkey % 4, k * (o_custkey % 3)))) AS matched")


def _metrics_sql(cat, group):
    return f"""SELECT {cat} AS category, k, count(*) AS queries, avg(CASE WHEN fh <= k THEN 1.0 ELSE 0 END) AS hit, avg(least(truth, k * m) / truth) AS macro_recall,
   sum(least(truth, k * m)) / sum(truth) AS micro_recall FROM (SELECT o_orderpriority, 1 + o_orderkey % 4 AS truth, o_custkey % 3 AS m,
    CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 1 + o_custkey % 25 END AS fh FROM orders WHERE o_orderkey % 17 <> 0), (SELECT unnest([1,3,5,10,20]) AS k) GROUP BY {group}"""


@query("ranking_metrics", "k:l queries:l hit:d macro_recall:d micro_recall:d", sql=_metrics_sql("NULL", "k"))
def _(v):
    return A.ranking_metrics(_evaluated(v))


@query("by_category_rollup", "category:s k:l queries:l hit:d macro_recall:d micro_recall:d", sql=_metrics_sql("o_orderpriority", "GROUPING SETS ((o_orderpriority, k), (k))"))
def _(v):
    return A.ranking_metrics(_evaluated(v), by="category")


@query("latency_percentiles", "event_type:s p50:d p95:d mean:d", sql="""
  SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, avg(value) AS mean FROM events GROUP BY 1""")
def _(v):
    return A.latency_percentiles(v.table("events"), ["event_type"], "value")


@query("stage_timing_rollup", "category:s name:s seconds:d counter:l spans:l", sql="""
  SELECT event_type AS category, 'u' || (user_id % 10) AS name, sum(value) AS seconds, sum(event_id % 3) AS counter, count(*) AS spans FROM events GROUP BY 1, 2""")
def _(v):
    return A.stage_timing_rollup(v.table("events").selectExpr("event_type AS category", "concat('u', user_id % 10) AS name", "value AS seconds", "event_id % 3 AS counter"))


