"""Window, ordering and top-k queries."""
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import windows as Z
from ..operators.skew import top_k
from .joins import _TOPS, _tops
from .registry import query


@query("topk_per_video_channel", "unit_id:l rank:l", views="candidates", sql="""
  SELECT unit_id, rk AS rank FROM (SELECT unit_id, row_number() OVER (PARTITION BY query_id, video_id, modality ORDER BY score DESC, unit_id) AS rk FROM candidates) WHERE rk <= 3""")
def _(v):
    return Z.topk_per_video_channel(v.candidates, 3)


@query("rrf_rank", "unit_id:l rank:l contribution:d", views="candidates", sql="""
  SELECT unit_id, rk AS rank, 0.85 / (60 + rk) AS contribution FROM (SELECT unit_id, row_number() OVER (PARTITION BY query_id, modality ORDER BY score DESC, unit_id) AS rk FROM candidates) WHERE rk <= 100""")
def _(v):
    return Z.rrf_rank(v.candidates, ["query_id", "modality"], [F.desc("score"), F.asc("unit_id")], 100, 0.85)


@query("minmax_per_step", "unit_id:l norm:d", views="candidates", sql="""
  SELECT unit_id, CASE WHEN abs(hi - lo) <= greatest(abs(hi), abs(lo)) * 1e-9 THEN CASE WHEN n = 1 THEN 1 ELSE 0 END ELSE (score - lo) / (hi - lo) END AS norm FROM (
   SELECT unit_id, score, min(score) OVER w AS lo, max(score) OVER w AS hi, count(*) OVER w AS n FROM candidates WINDOW w AS (PARTITION BY query_id, video_id, modality))""")
def _(v):
    return Z.minmax_per_step(v.candidates, ["query_id", "video_id", "modality"])


@query("max_scale", "unit_id:l scaled:d", views="candidates", sql="SELECT unit_id, score / max(score) OVER (PARTITION BY query_id) AS scaled FROM candidates")
def _(v):
    return Z.max_scale(v.candidates, ["query_id"])


@query("split_long", "unit_id:l start_ms:l end_ms:l", views="ia", sql="""
  SELECT unit_id, s + i * 1500 AS start_ms, CASE WHEN i = cuts THEN e ELSE s + (i + 1) * 1500 END AS end_ms FROM (
   SELECT *, CASE WHEN c > 0 AND e - s - c * 1500 < 400 THEN c - 1 ELSE c END AS cuts FROM (SELECT unit_id, s, e, greatest(0, CAST(ceil((e - s) / 1500) AS BIGINT) - 1) AS c FROM (
    SELECT unit_id, CAST(floor("start" * 1000) AS BIGINT) AS s, CAST(floor("end" * 1000) AS BIGINT) AS e FROM ia))), range(100) r(i) WHERE i <= cuts""")
def _(v):
    s = v.intervals("visual", "asr").selectExpr("unit_id", "CAST(floor(start * 1000) AS BIGINT) AS start_ms", "CAST(floor(end * 1000) AS BIGINT) AS end_ms")
    return Z.split_long(s, 1500, 400)


@query("fill_gaps", "video_id:l start_ms:l end_ms:l", views="ib", sql="""
  WITH s AS (SELECT DISTINCT video_id, CAST(floor("start" * 1000) AS BIGINT) AS s, least(715000, CAST(floor("end" * 1000) AS BIGINT)) AS e FROM ib),
  t AS (SELECT * FROM s WHERE e > s UNION ALL SELECT DISTINCT video_id, 715000, 715000 FROM s),
  c AS (SELECT *, coalesce(max(e) OVER (PARTITION BY video_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM t),
  p AS (SELECT * FROM (SELECT video_id, cur AS s, s AS e FROM c UNION ALL SELECT video_id, greatest(s, cur), e FROM c) WHERE e > s),
  g AS (SELECT *, sum(CASE WHEN e - s >= 700 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM p),
  m AS (SELECT video_id, g, min(s) AS s, max(e) AS e FROM g GROUP BY 1, 2),
  m2 AS (SELECT video_id, min(s) AS s, max(e) AS e FROM (SELECT *, CASE WHEN g = 0 AND e - s < 700 THEN 1 ELSE g END AS g2 FROM m) GROUP BY video_id, g2),
  x AS (SELECT *, CASE WHEN c > 0 AND e - s - c * 4000 < 700 THEN c - 1 ELSE c END AS cuts FROM (SELECT *, greatest(0, CAST(ceil((e - s) / 4000) AS BIGINT) - 1) AS c FROM m2))
  SELECT video_id, s + i * 4000 AS start_ms, CASE WHEN i = cuts THEN e ELSE s + (i + 1) * 4000 END AS end_ms FROM x, range(300) r(i) WHERE i <= cuts""")
def _(v):
    s = v.intervals("ocr").selectExpr("video_id", "CAST(floor(start * 1000) AS BIGINT) AS start_ms", "CAST(floor(end * 1000) AS BIGINT) AS end_ms")
    dur = s.select("video_id").distinct().withColumn("duration_ms", F.lit(715000).cast("long"))
    return Z.fill_gaps(s, dur, ["video_id"], 700, 4000, 48_000.0)


@query("fixed_segments", "conv_id:l segment_id:l start_ms:l end_ms:l", sql="""
  SELECT conv_id, i AS segment_id, i * 5000 AS start_ms, least((i + 1) * 5000, d) AS end_ms FROM (SELECT conv_id, sum(length(text)) * 10 AS d FROM conversations GROUP BY 1), range(2000) r(i) WHERE i < greatest(1, ceil(d / 5000))""")
def _(v):
    d = v.table("conversations").groupBy("conv_id").agg((F.sum(F.length("text")) * 10).alias("duration_ms"))
    return Z.fixed_segments(d, 5000)


@query("timestamp_jumps", "video_id:l jumps:l", views="candidates", sql="""
  SELECT video_id, count(*) FILTER (WHERE start_time - p > 20) AS jumps FROM (SELECT video_id, start_time, lag(start_time) OVER (PARTITION BY video_id ORDER BY start_time, unit_id) AS p FROM candidates) GROUP BY 1""")
def _(v):
    return Z.timestamp_jumps(v.candidates, ["video_id"], "start_time", "unit_id", 20, 48.0)


@query("adjacent_duplicates", "video_id:l duplicates:l", sql="""
  SELECT user_id AS video_id, count(*) FILTER (WHERE event_type = p) AS duplicates FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) GROUP BY 1""")
def _(v):
    return Z.adjacent_duplicates(v.table("events").selectExpr("user_id AS video_id", "event_id", "concat(' ', event_type) AS text"), ["video_id"], "event_id")


def _rows(v):
    return v.candidates.selectExpr("video_id", "unit_id", "start_time", "end_time", "CASE unit_id % 4 WHEN 0 THEN 'end. ' WHEN 1 THEN 'a. b! c' ELSE 'on and on' END AS text")


_SPAN = """SELECT video_id, greatest(0, max(span)) AS span FROM (SELECT video_id, isl, max(end_time) - arg_min(start_time, rn) AS span FROM (
   SELECT *, coalesce(sum(CASE WHEN unit_id % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS isl FROM (
    SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_time, end_time, unit_id) AS rn FROM candidates)) GROUP BY 1, 2) GROUP BY 1"""


@query("longest_unpunctuated_span", "video_id:l span:d", views="candidates", sql=_SPAN)
def _(v):
    return Z.longest_unpunctuated_span(_rows(v), ["video_id"], "unit_id", 48.0)


@query("quality_window_flags", "video_id:l retry:b", views="candidates", sql=f"""
  SELECT video_id, span > 100 OR poor AS retry FROM ({_SPAN}) JOIN (SELECT video_id, bool_or(end_time - start_time > 4 AND unit_id % 4 <> 1) AS poor FROM candidates GROUP BY 1) USING (video_id)""")
def _(v):
    return Z.quality_window_flags(_rows(v), ["video_id"], "unit_id", 100.0, 4.0, 48.0)


@query("renumber", "unit_id:l idx:l", views="candidates", sql="""
  SELECT unit_id, row_number() OVER (PARTITION BY video_id ORDER BY start_time, unit_id) - 1 AS idx FROM candidates""")
def _(v):
    return Z.renumber(v.candidates, ["video_id"], [F.col("start_time"), F.col("unit_id")], width=48.0)


@query("rank_stability", "query_id:l stability:d", views="candidates", sql=_TOPS + """
  SELECT query_id, coalesce(greatest(0, 1 - avg(abs(l.rk - r.rk)) / greatest(1, greatest(count(l.rk), count(r.rk)) - 1)), 0) AS stability FROM l FULL JOIN r USING (query_id, video_id) GROUP BY 1""")
def _(v):
    left, right = _tops(v)
    return Z.rank_stability(left, right, ["query_id"], "video_id")


_G = """SELECT query_id, video_id, max(start_time) AS start_time, max(end_time) AS end_time, max(score) AS score, max(score) > 0.3 AS above_threshold,
  max(score) FILTER (WHERE modality = 'visual') AS pv, 24 + query_id AS lim, CASE WHEN query_id = 1 THEN 'recall' ELSE 'balanced' END AS profile FROM candidates GROUP BY 1, 2"""


def _groups(v):
    g = v.candidates.groupBy("query_id", "video_id").agg(
        F.max("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.max("score").alias("score"),
        F.max(F.when(F.col("modality") == "visual", F.col("score"))).alias("pv"))
    return g.withColumns({"above_threshold": F.col("score") > 0.3, "best_by_modality": F.map_filter(F.create_map(F.lit("visual"), F.col("pv")), lambda k, x: x.isNotNull()),
                          "limit": F.col("query_id") + 24, "profile": F.when(F.col("query_id") == 1, "recall").otherwise("balanced")})


def _ordered_sql(order, cap="24"):
    return f"SELECT query_id, video_id, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rk FROM ({_G})) WHERE rk <= {cap}"


@query("order_results", "query_id:l video_id:l rank:l", views="candidates", sql=_ordered_sql("above_threshold DESC, score DESC, start_time, video_id"))
def _(v):
    return Z.order_results(_groups(v), 24)


@query("order_primary_first", "query_id:l video_id:l rank:l", views="candidates", sql=_ordered_sql(
    "above_threshold DESC, pv IS NOT NULL DESC, score DESC, coalesce(pv, score) DESC, start_time, video_id"))
def _(v):
    return Z.order_results(_groups(v), 24, primary="visual")


@query("profile_cap", "query_id:l video_id:l rank:l", views="candidates", sql=_ordered_sql("score DESC, video_id", "CASE WHEN profile = 'recall' THEN 500 ELSE lim END"))
def _(v):
    return Z.profile_cap(_groups(v), ["query_id"], [F.desc("score"), F.asc("video_id")])


@query("order_reranked", "query_id:l video_id:l final_rank:l", views="candidates", sql="""
  SELECT query_id, video_id, rk AS final_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 10) DESC, orank) AS rk FROM (
   SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id) AS orank FROM (""" + _G + """))) WHERE rk <= 50""")
def _(v):
    g = top_k(_groups(v), ["query_id"], [F.desc("score"), F.asc("video_id")], 1000, rank="original_rank").withColumn("final_score", F.floor(F.col("score") * 10))
    return Z.order_reranked(g, ["query_id"], 50)


@query("gallery_order", "video_id:l group_idx:l rank:l", views="tracks", sql="""
  SELECT video_id, group_idx, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY importance DESC, start_ms, group_idx) AS rk FROM (
   SELECT video_id, label AS group_idx, sum(detections) AS importance, min(start_ms) AS start_ms FROM tracks GROUP BY 1, 2)) WHERE rk <= 24""")
def _(v):
    g = v.tracks.groupBy("video_id", F.col("label").alias("group_idx")).agg(F.sum("detections").alias("importance"), F.min("start_ms").alias("start_ms"))
    return Z.gallery_order(g, 24)


@query("rank_utterances", "video_id:l track_id:l utterance_idx:l rank:l", views="utterances", sql="""
  WITH c AS (SELECT video_id, track_id, list(m ORDER BY i) AS c FROM (SELECT video_id, track_id, i, avg(x) AS m FROM (SELECT video_id, track_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM utterances) GROUP BY 1, 2, 3) GROUP BY 1, 2)
  SELECT video_id, track_id, utterance_idx, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY round(list_cosine_similarity(embedding, c), 9) DESC, end_ms - start_ms DESC, utterance_idx) AS rk FROM utterances JOIN c USING (video_id, track_id)) WHERE rk <= 100""")
def _(v):
    return Z.rank_utterances(v.utterances, A.vector_mean(v.utterances, ["video_id", "track_id"]), 100)


@query("voice_topk", "query_id:l video_id:l utterance_idx:l rank:l", views="candidates", sql="""
  SELECT query_id, video_id, utterance_idx, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id, utterance_idx) AS rk FROM (
   SELECT query_id, video_id, unit_id AS utterance_idx, score FROM candidates WHERE modality = 'face')) WHERE rk <= 50""")
def _(v):
    return Z.voice_topk(v.candidates.where("modality = 'face'").withColumnRenamed("unit_id", "utterance_idx"), 50)


@query("stratified_sample", "category:l query_id:l", sql="""
  WITH g AS (SELECT o_orderkey AS query_id, o_custkey % 7 AS category, o_orderkey % 3 + 1 AS answers, CASE WHEN o_orderkey % 10 = 4 THEN '中文' ELSE 'text' END AS q,
     md5('20260811:' || (o_custkey % 7) || ':' || o_orderkey) AS h FROM orders),
  p1 AS (SELECT category, arg_min(query_id, h) AS q1 FROM g WHERE answers > 1 GROUP BY 1),
  p2 AS (SELECT category, arg_min(query_id, h) AS q2 FROM g JOIN p1 USING (category) WHERE q = '中文' AND query_id <> q1 GROUP BY 1),
  p3 AS (SELECT category, arg_min(query_id, h) AS q3 FROM g JOIN p1 USING (category) JOIN p2 USING (category) WHERE q <> '中文' AND query_id NOT IN (q1, q2) GROUP BY 1),
  r AS (SELECT category, query_id, row_number() OVER (PARTITION BY category ORDER BY h) AS rk FROM g JOIN p1 USING (category) JOIN p2 USING (category) JOIN p3 USING (category) WHERE query_id NOT IN (q1, q2, q3))
  SELECT category, q1 AS query_id FROM p1 UNION ALL SELECT category, q2 FROM p2 UNION ALL SELECT category, q3 FROM p3 UNION ALL SELECT category, query_id FROM r WHERE rk <= 2""")
def _(v):
    g = v.table("orders").selectExpr("o_orderkey AS query_id", "o_custkey % 7 AS category", "o_orderkey % 3 + 1 AS answers",
                                     "CASE WHEN o_orderkey % 10 = 4 THEN '中文' ELSE 'text' END AS query")
    return Z.stratified_sample(g, 5, 20260811)
