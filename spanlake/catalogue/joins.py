"""Join and set-operation queries."""
from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import relations as R
from ..operators.knn import knn_join
from ..operators.skew import top_k
from .registry import query

W = 4.0  # bucket width for candidate times


@query("join_published", "video_id:l modality:s n:l", views="frames pointers", sql="""
  SELECT video_id, 'visual' AS modality, count(*) AS n FROM frames JOIN pointers p USING (video_id)
  WHERE p.modality = 'visual' AND p.status = 'ready' AND p.asset_version = 'visual-' || (video_id % 2) GROUP BY 1""")
def _(v):
    u = v.frames.withColumn("asset_version", F.expr("concat('visual-', video_id % 2)"))
    return R.join_published(u, v.pointers.where("modality = 'visual'")).groupBy("video_id").agg(
        F.lit("visual").alias("modality"), F.count("*").alias("n"))


@query("folder_counts", "folder_id:l name:s n:l", views="members", sql="""
  SELECT n_nationkey AS folder_id, n_name AS name, count(video_id) AS n FROM nation LEFT JOIN members ON folder_id = n_nationkey GROUP BY 1, 2
  UNION ALL SELECT -1, 'default', count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT video_id FROM members)""")
def _(v):
    folders = v.table("nation").select(F.col("n_nationkey").cast("long").alias("folder_id"), F.col("n_name").alias("name"))
    return R.folder_counts(folders, v.members, v.table("supplier").select(F.col("s_suppkey").alias("video_id")))


@query("entity_voice_counts", "entity_id:l n:l", sql="""
  SELECT c_custkey AS entity_id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1""")
def _(v):
    return R.entity_voice_counts(v.table("customer").select(F.col("c_custkey").alias("entity_id")),
                                 v.table("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("entity_id")))


@query("entity_mention", "query_id:l entity_id:l name:s", views="entities mention_texts", sql="""
  SELECT query_id, entity_id, name FROM (SELECT query_id, entity_id, name, row_number() OVER (PARTITION BY query_id ORDER BY length(name) DESC, name) AS rk
   FROM mention_texts, entities WHERE contains(lower(text), lower(name))) WHERE rk = 1""")
def _(v):
    return R.entity_mention(v.mention_texts, v.entities)


@query("identity_bindings", "video_id:l group_idx:l name:s", views="entities", sql="""
  SELECT o_orderkey % 50 AS video_id, o_orderkey AS group_idx, name FROM orders JOIN entities ON entity_id = o_custkey % 60
  WHERE 'g' || (o_orderkey % 3) = 'g' || ((o_orderkey % 50) % 3)""")
def _(v):
    b = v.table("orders").selectExpr("o_orderkey % 50 AS video_id", "'a' AS asset_version", "concat('g', o_orderkey % 3) AS group_version",
                                     "o_orderkey AS group_idx", "o_custkey % 60 AS entity_id")
    g = v.table("orders").selectExpr("o_orderkey % 50 AS video_id").distinct().selectExpr(
        "video_id", "'a' AS asset_version", "concat('g', video_id % 3) AS group_version")
    return R.identity_bindings(b, v.entities, g)


@query("join_overlays", "video_id:l utterance_idx:l track_id:l searchable:l", views="utterances overlays", sql="""
  SELECT u.video_id, u.utterance_idx, CASE WHEN o.searchable IS NULL THEN u.track_id ELSE o.corrected_track_id END AS track_id,
   coalesce(o.searchable, 1) AS searchable FROM utterances u LEFT JOIN overlays o USING (video_id, utterance_idx)""")
def _(v):
    return R.join_overlays(v.utterances, v.overlays)


@query("speaker_text_join", "video_id:l utterance_idx:l chunk_text:s", views="utterances", sql="""
  SELECT u.video_id, u.utterance_idx, i.text AS chunk_text FROM utterances u JOIN conversations i ON i.conv_id = u.video_id AND i.turn = u.asr_chunk_idx""")
def _(v):
    chunks = v.items.select("video_id", F.col("item_id").alias("segment_idx"), "text")
    return R.speaker_text_join(v.utterances, chunks)


@query("speaker_asr_version_check", "video_id:l valid:b", views="pointers", sql="""
  SELECT s.video_id, coalesce(s.source_asr = a.asset_version, false) AS valid FROM pointers s
  LEFT JOIN pointers a ON a.video_id = s.video_id AND a.modality = 'asr' AND a.status = 'ready' WHERE s.modality = 'speaker'""")
def _(v):
    return R.speaker_asr_version_check(v.pointers)


@query("voice_sample_clips", "doc_id:l start_ms:l end_ms:l", views="utterances", sql="""
  SELECT doc_id, start_ms, end_ms FROM labels LEFT JOIN utterances ON video_id = doc_id // 5 AND utterance_idx = doc_id % 5""")
def _(v):
    s = v.table("labels").selectExpr("doc_id", "doc_id div 5 AS video_id", "doc_id % 5 AS utterance_idx")
    return R.voice_sample_clips(s, v.utterances)


@query("overlap_join", "a:l b:l", views="ia ib", sql="""
  SELECT a.unit_id AS a, b.unit_id AS b FROM ia a JOIN ib b ON a.video_id = b.video_id AND a."start" < b."end" AND a."end" > b."start" """)
def _(v):
    b = v.intervals("ocr").selectExpr("video_id", "unit_id AS b", "start AS bs", "end AS be")
    return I.overlap_join(v.intervals("visual", "asr").withColumnRenamed("unit_id", "a"), b, ["video_id"], ("start", "end"), ("bs", "be"), width=W)


@query("max_overlap_join", "unit_id:l match:l", views="ia ib", sql="""
  SELECT i.unit_id, coalesce(m.b, -1) AS match FROM ia i LEFT JOIN (SELECT a, b FROM (SELECT a.unit_id AS a, b.unit_id AS b,
    row_number() OVER (PARTITION BY a.unit_id ORDER BY least(a."end", b."end") - greatest(a."start", b."start") DESC, b.unit_id) AS rk
    FROM ia a JOIN ib b ON a.video_id = b.video_id AND a."start" < b."end" AND a."end" > b."start") WHERE rk = 1) m ON m.a = i.unit_id""")
def _(v):
    return I.max_overlap_join(v.intervals("visual", "asr"), v.intervals("ocr"), ["video_id"], "unit_id", "unit_id", W)


@query("sum_overlap_assign", "unit_id:l label:l", views="ia ib", sql="""
  SELECT i.unit_id, coalesce(m.label, -1) AS label FROM ia i LEFT JOIN (SELECT unit_id, label FROM (SELECT a.unit_id, b.unit_id % 3 AS label,
    row_number() OVER (PARTITION BY a.unit_id ORDER BY sum(least(a."end", b."end") - greatest(a."start", b."start")) DESC, b.unit_id % 3) AS rk
    FROM ia a JOIN ib b ON a.video_id = b.video_id AND a."start" < b."end" AND a."end" > b."start" GROUP BY 1, 2) WHERE rk = 1) m USING (unit_id)""")
def _(v):
    b = v.intervals("ocr").withColumn("label", F.col("unit_id") % 3)
    return I.sum_overlap_assign(v.intervals("visual", "asr"), b, ["video_id"], "unit_id", "label", W)


@query("interval_intersect", "unit_id:l b:l start:d end:d", views="ia ib", sql="""
  SELECT * FROM (SELECT a.unit_id, b.unit_id AS b, greatest(a."start", b."start") AS "start", least(a."end", b."end") AS "end"
   FROM ia a JOIN ib b ON a.video_id = b.video_id AND a."start" < b."end" AND a."end" > b."start") WHERE "end" - "start" >= 0.5""")
def _(v):
    return I.interval_intersect(v.intervals("visual", "asr"), v.intervals("ocr").withColumnRenamed("unit_id", "b"), ["video_id"], "unit_id", "b", 0.5, W)


@query("asof_segment", "unit_id:l segment_idx:l", views="ia ib", sql="""
  WITH s AS (SELECT *, lead(unit_id) OVER (PARTITION BY video_id ORDER BY "start") AS nxt FROM ib),
  f AS (SELECT video_id, arg_min(unit_id, "start") AS fst FROM ib GROUP BY 1)
  SELECT p.unit_id, CASE WHEN s.unit_id IS NULL THEN f.fst WHEN p."start" > s."end" AND s.nxt IS NOT NULL THEN s.nxt ELSE s.unit_id END AS segment_idx
  FROM (SELECT ia.* FROM ia) p JOIN f USING (video_id) ASOF LEFT JOIN s ON s.video_id = p.video_id AND p."start" >= s."start" """)
def _(v):
    seg = v.intervals("ocr").selectExpr("video_id", "unit_id AS segment_idx", "start", "end")
    return I.asof_segment(v.intervals("visual", "asr"), seg, ["video_id"], "unit_id", "start", 48.0)


_COAL = """SELECT video_id, min(s) AS "start", max(e) AS "end" FROM (SELECT *, sum(brk) OVER (PARTITION BY video_id ORDER BY s, e, unit_id ROWS UNBOUNDED PRECEDING) AS isl FROM (
   SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY video_id ORDER BY s, e, unit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS brk
   FROM (SELECT video_id, unit_id, greatest(0, "start" - 0.25) AS s, "end" + 0.25 AS e FROM ia))) GROUP BY video_id, isl"""


@query("coalesce_windows", "video_id:l start:d end:d", views="ia", sql=_COAL)
def _(v):
    return I.coalesce_windows(v.intervals("visual", "asr"), ["video_id"], "start", "end", 0.25, ["unit_id"], 48.0)


@query("window_coalesce_semijoin", "unit_id:l", views="ia ib", sql=f"""
  SELECT unit_id FROM ib WHERE EXISTS (SELECT 1 FROM ({_COAL}) w WHERE w.video_id = ib.video_id AND ib."start" < w."end" AND ib."end" > w."start")""")
def _(v):
    w = I.coalesce_windows(v.intervals("visual", "asr"), ["video_id"], "start", "end", 0.25, ["unit_id"], 48.0)
    return I.window_semijoin(v.intervals("ocr"), w, ["video_id"], ["unit_id"], "start", "end", W)


_NEAR = """SELECT a, m, distance FROM (SELECT a.unit_id AS a, b.unit_id AS m, abs((a."start" + a."end") / 2 - (b."start" + b."end") / 2) AS distance,
   row_number() OVER (PARTITION BY a.unit_id ORDER BY abs((a."start" + a."end") / 2 - (b."start" + b."end") / 2), b.unit_id) AS rk
   FROM ia a JOIN ib b ON a.video_id = b.video_id WHERE (a."start" <= b."end" AND a."end" >= b."start")
   OR abs((a."start" + a."end") / 2 - (b."start" + b."end") / 2) <= 3.0) WHERE rk = 1"""


@query("nearest_moment_join", "unit_id:l moment_id:l distance:d", views="ia ib", sql=f"SELECT a AS unit_id, m AS moment_id, distance FROM ({_NEAR})")
def _(v):
    m = v.intervals("ocr").selectExpr("video_id", "unit_id AS moment_id", "start AS m_start", "end AS m_end")
    return I.nearest_moment_join(v.intervals("visual", "asr"), m, ["video_id"], "unit_id", 3.0, W)


@query("restrict_to_current", "unit_id:l", views="ia ib", sql=f"SELECT a AS unit_id FROM ({_NEAR})")
def _(v):
    m = v.intervals("ocr").selectExpr("video_id", "unit_id AS moment_id", "start AS m_start", "end AS m_end")
    return I.restrict_to_current(v.intervals("visual", "asr"), m, ["video_id"], "unit_id", 3.0, W)


@query("overlap_best_match", "query_id:l moment_id:l track_idx:l cosine:d status:s", views="frames tracks qv1", sql="""
  WITH m AS (SELECT q.query_id, f.video_id, q.query_id * 1000000 + f.vec_id AS moment_id, f.timestamp_ms * 3 AS s, f.timestamp_ms * 3 + 700 AS e, vec
     FROM frames f JOIN qv1 q ON q.query_id = f.label),
  b AS (SELECT moment_id, track_idx, c FROM (SELECT m.moment_id, t.track_idx, list_cosine_similarity(t.embedding, m.vec) AS c,
     row_number() OVER (PARTITION BY m.moment_id ORDER BY list_cosine_similarity(t.embedding, m.vec) DESC, t.track_idx) AS rk
     FROM m JOIN tracks t ON t.video_id = m.video_id AND m.s < t.end_ms AND m.e > t.start_ms) WHERE rk = 1)
  SELECT query_id, moment_id, track_idx, c AS cosine, CASE WHEN c IS NULL THEN 'no_track' WHEN c >= 0.35 THEN 'confirmed' WHEN c >= 0.2 THEN 'ambiguous' ELSE 'rejected' END AS status
  FROM m LEFT JOIN b USING (moment_id)""")
def _(v):
    q = v.qv1
    m = v.frames.select("vec_id", "video_id", "timestamp_ms", F.col("label").cast("long").alias("query_id")).join(
        q.select("query_id"), "query_id", "left_semi").selectExpr(
        "query_id", "video_id", "query_id * 1000000 + vec_id AS moment_id", "timestamp_ms * 3 AS start_ms", "timestamp_ms * 3 + 700 AS end_ms")
    t = v.tracks.selectExpr("video_id", "track_idx", "start_ms AS t_start", "end_ms AS t_end", "embedding")
    return I.overlap_best_match(m, t, q, width=5000)


@query("knn_join", "query_id:l query_idx:l video_id:l frame_idx:l score:d rank:l", views="frames qv", sql="""
  SELECT query_id, query_idx, video_id, frame_idx, score, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, query_idx, video_id ORDER BY score DESC, frame_idx) AS rk
   FROM (SELECT query_id, query_idx, video_id, frame_idx, list_cosine_similarity(embedding, vec) AS score FROM frames, qv)) WHERE rk <= 20""")
def _(v):
    return knn_join(v.qv, v.frames, 20, keep=("frame_idx",))


@query("hybrid_join", "query_id:l video_id:l score:d decision:s", views="candidates", sql="""
  SELECT query_id, video_id, 0.65 * coalesce(d, 0) + 0.35 * coalesce(s, 0) AS score, CASE WHEN d IS NOT NULL AND s IS NOT NULL THEN 'semantic_lexical_hit'
   WHEN d IS NOT NULL THEN 'semantic_hit' ELSE 'lexical_hit' END AS decision FROM (
   SELECT query_id, video_id, max(score) AS d FROM candidates WHERE modality = 'asr' AND score > 0.05 GROUP BY 1, 2) FULL JOIN (
   SELECT query_id, video_id, max(score) AS s FROM candidates WHERE modality = 'ocr' AND score > 0.1 GROUP BY 1, 2) USING (query_id, video_id)""")
def _(v):
    def leg(m, t):
        return v.candidates.where(f"modality = '{m}' AND score > {t}").groupBy("query_id", "video_id").agg(F.max("score").alias("score"))
    return R.hybrid_join(leg("asr", 0.05), leg("ocr", 0.1), ["query_id", "video_id"], 0.65)


@query("cross_fill_subqueries", "query_id:l video_id:l score:d worst:d", views="frames qv", sql="""
  WITH h AS (SELECT query_id, query_idx, video_id, frame_idx, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, query_idx, video_id ORDER BY score DESC, frame_idx) AS rk
   FROM (SELECT query_id, query_idx, video_id, frame_idx, list_cosine_similarity(embedding, vec) AS score FROM frames, qv)) WHERE rk <= 30)
  SELECT query_id, video_id, max(score) AS score, min(worst) AS worst FROM (SELECT query_id, video_id, frame_idx, sum(coalesce(score, 0)) / 3 AS score, min(coalesce(score, 0)) AS worst FROM (
   SELECT f.query_id, f.video_id, f.frame_idx, q.query_idx, h.score FROM (SELECT DISTINCT query_id, video_id, frame_idx FROM h) f, (SELECT DISTINCT query_idx FROM qv) q
   LEFT JOIN h ON h.query_id = f.query_id AND h.video_id = f.video_id AND h.frame_idx = f.frame_idx AND h.query_idx = q.query_idx) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def _(v):
    h = knn_join(v.qv, v.frames, 30, keep=("frame_idx",))
    n = 3
    f = h.groupBy("query_id", "video_id", "frame_idx").agg((F.sum("score") / n).alias("score"),
        F.when(F.count("*") < n, F.least(F.min("score"), F.lit(0.0))).otherwise(F.min("score")).alias("worst"))
    return f.groupBy("query_id", "video_id").agg(F.max("score").alias("score"), F.min("worst").alias("worst"))


@query("rerank_join", "unit_id:l final_score:d", views="candidates", sql="""
  SELECT unit_id, CASE WHEN unit_id % 3 = 0 THEN score ELSE 0.8 * (unit_id % 10) / 10.0::DOUBLE + 0.2 * score END AS final_score FROM candidates""")
def _(v):
    s = v.candidates.where("unit_id % 3 <> 0").selectExpr("unit_id", "(unit_id % 10) / 10.0D AS rerank_score")
    return R.rerank_join(v.candidates, s, ["unit_id"], 0.8)


@query("truth_overlap_join", "unit_id:l truth_id:l", views="candidates truth", sql="""
  SELECT unit_id, truth_id FROM candidates c JOIN truth t ON c.query_id = t.query_id AND c.video_id = t.video_id AND start_time < t_end AND end_time > t_start WHERE modality = 'asr'""")
def _(v):
    r = v.candidates.where("modality = 'asr'").selectExpr("query_id", "video_id", "unit_id", "start_time AS start", "end_time AS end")
    return I.truth_overlap_join(r, v.truth, W)


@query("pointer_reconcile", "video_id:l modality:s verdict:s", views="pointers unit_counts", sql="""
  SELECT video_id, modality, CASE WHEN p.row_count IS NULL THEN 'missing_pointer' WHEN p.status <> 'ready' THEN 'not_ready'
   WHEN coalesce(c."rows", 0) <> p.row_count THEN 'row_count_mismatch' ELSE 'ok' END AS verdict
  FROM (SELECT * FROM pointers WHERE video_id % 14 <> 5) p FULL JOIN unit_counts c USING (video_id, modality, asset_version)""")
def _(v):
    return R.pointer_reconcile(v.pointers.where("video_id % 14 <> 5"), v.unit_counts)


@query("missing_publications", "video_id:l reason:s", views="pointers", sql="""
  WITH vid AS (SELECT DISTINCT conv_id AS video_id FROM conversations), req AS (SELECT doc_id // 4 AS video_id FROM labels GROUP BY 1)
  SELECT video_id, 'no_ready_pointer' AS reason FROM vid WHERE video_id IN (SELECT video_id FROM req)
   AND video_id NOT IN (SELECT video_id FROM pointers WHERE modality = 'speaker' AND status = 'ready')
  UNION ALL SELECT video_id, 'unknown_video' FROM req WHERE video_id NOT IN (SELECT video_id FROM vid)""")
def _(v):
    vid = v.table("conversations").select(F.col("conv_id").alias("video_id")).distinct()
    req = v.table("labels").selectExpr("doc_id div 4 AS video_id").distinct()
    return R.missing_publications(vid, v.pointers, "speaker", req)


@query("staging_target_diff", "video_id:l modality:s verdict:s", views="pointers", sql="""
  SELECT video_id, modality, CASE WHEN status <> 'ready' THEN CASE WHEN video_id % 4 = 3 THEN NULL ELSE 'target_only' END WHEN video_id % 4 = 3 THEN 'ready'
   WHEN video_id % 4 = 0 THEN 'already_current' WHEN video_id % 4 = 1 THEN 'ready' ELSE 'conflict' END AS verdict FROM pointers
  WHERE NOT (status <> 'ready' AND video_id % 4 = 3)""")
def _(v):
    base = v.pointers.withColumn("asset_version", F.lit("old"))
    target = v.pointers.where("video_id % 4 <> 3").withColumn("asset_version", F.expr(
        "CASE video_id % 4 WHEN 0 THEN asset_version WHEN 1 THEN 'old' ELSE 'other' END"))
    return R.staging_target_diff(v.pointers, target, base)


@query("union_distinct_ordered", "id:l list:l pos:l", sql="""
  SELECT id, l AS list, p AS pos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY l, p) AS rk FROM (
    SELECT o_custkey AS id, 0 AS l, o_orderkey AS p FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT c_custkey, 1, c_custkey FROM customer)) WHERE rk = 1""")
def _(v):
    a = v.table("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("pos"))
    return R.union_distinct_ordered(a, v.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("pos")))


@query("intersect_channels", "video_id:l channels:s", views="candidates", sql="""
  SELECT video_id, string_agg(modality, '|' ORDER BY modality) AS channels FROM (SELECT DISTINCT video_id, modality FROM candidates WHERE modality IN ('asr','face')) GROUP BY 1""")
def _(v):
    d = v.candidates.groupBy("video_id").agg(F.collect_set("modality").alias("m"))
    return d.select("video_id", F.array_join(R.intersect_channels(F.array(F.lit("asr"), F.lit("face")), F.col("m")), "|").alias("channels")).where("channels <> ''")


def _tops(v):
    c = v.candidates.groupBy("query_id", "video_id").agg(F.max("score").alias("a"), F.sum("score").alias("b"))
    left = top_k(c, ["query_id"], [F.desc("a"), F.asc("video_id")], 10)
    right = top_k(c, ["query_id"], [F.desc("b"), F.asc("video_id")], 10)
    return left, right


_TOPS = """WITH c AS (SELECT query_id, video_id, max(score) AS a, sum(score) AS b FROM candidates GROUP BY 1, 2),
  l AS (SELECT query_id, video_id, rk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, video_id) AS rk FROM c) WHERE rk <= 10),
  r AS (SELECT query_id, video_id, rk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, video_id) AS rk FROM c) WHERE rk <= 10)"""


@query("rank_delta", "query_id:l video_id:l change:s", views="candidates", sql=_TOPS + """
  SELECT query_id, video_id, 'added' AS change FROM r ANTI JOIN l USING (query_id, video_id) UNION ALL SELECT query_id, video_id, 'removed' FROM l ANTI JOIN r USING (query_id, video_id)""")
def _(v):
    left, right = _tops(v)
    return R.rank_delta(left, right, ["query_id", "video_id"])


@query("topk_jaccard", "query_id:l jaccard:d", views="candidates", sql=_TOPS + """
  SELECT query_id, count(*) FILTER (WHERE l.rk IS NOT NULL AND r.rk IS NOT NULL) / count(*) AS jaccard FROM l FULL JOIN r USING (query_id, video_id) GROUP BY 1""")
def _(v):
    left, right = _tops(v)
    return R.topk_jaccard(left, right, ["query_id"], "video_id")


@query("union_candidates", "modality:s n:l best:d", views="candidates", sql="SELECT modality, count(*) AS n, max(score) AS best FROM candidates GROUP BY 1")
def _(v):
    parts = [v.candidates.where(F.col("modality") == m) for m in ("visual", "asr", "ocr")]
    face = v.candidates.where("modality = 'face'").drop("raw_score")
    return R.union_candidates(*parts, face).groupBy("modality").agg(F.count("*").alias("n"), F.max("score").alias("best"))


@query("dedupe_evidence", "video_id:l modality:s detail:s best_time:l unit_id:l", views="candidates", sql="""
  SELECT video_id, modality, 'd' || (unit_id % 2) AS detail, CAST(floor(start_time) AS BIGINT) AS best_time, min(unit_id) AS unit_id FROM candidates GROUP BY 1, 2, 3, 4""")
def _(v):
    e = v.candidates.selectExpr("video_id", "modality", "concat('d', unit_id % 2) AS detail", "CAST(floor(start_time) AS BIGINT) AS best_time", "unit_id")
    return R.dedupe_evidence(e, ["video_id"], "unit_id")


