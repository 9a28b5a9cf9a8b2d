"""Publication queries."""
from pyspark.sql import functions as F

from ..plans import publish as P
from ..sources.writers import SnapshotTable
from .registry import query
from .scans import fresh


@query("publish", "video_id:l modality:s asset_version:s row_count:l status:s", views="pointers", sql="""
  SELECT video_id, modality, CASE WHEN video_id % 3 = 1 AND modality = 'asr' THEN 'asr-new' ELSE asset_version END AS asset_version,
   CASE WHEN video_id % 3 = 1 AND modality = 'asr' THEN 5 ELSE row_count END AS row_count,
   CASE WHEN video_id % 3 = 1 AND modality = 'asr' THEN 'ready' WHEN video_id % 4 = 0 AND modality = 'speaker' THEN 'disabled' ELSE status END AS status FROM pointers
  UNION ALL SELECT DISTINCT video_id, 'ocr', 'ocr-1', 9, 'ready' FROM pointers WHERE video_id % 5 = 2""")
def _(v):
    p = v.pointers
    u = p.where("video_id % 3 = 1 AND modality = 'asr'").selectExpr("video_id", "modality", "'asr-new' AS asset_version", "CAST(5 AS BIGINT) AS row_count", "'ready' AS status", "source_asr")
    n = p.where("video_id % 5 = 2").select("video_id").distinct().selectExpr("video_id", "'ocr' AS modality", "'ocr-1' AS asset_version", "CAST(9 AS BIGINT) AS row_count", "'ready' AS status", "CAST(NULL AS STRING) AS source_asr")
    table = SnapshotTable(v.spark, fresh(v, "pointers"))
    table.commit(p)
    table.commit(P.publish(table.read(), u.unionByName(n), p.where("video_id % 4 = 0 AND modality = 'speaker'"), p.select("video_id").distinct()))
    return table.read()


@query("visible_channels", "video_id:l indexed:s", views="pointers", sql="""
  SELECT c AS video_id, coalesce(s, '') AS indexed FROM (SELECT DISTINCT conv_id AS c FROM conversations) LEFT JOIN (
   SELECT video_id, string_agg(modality, '|' ORDER BY modality) AS s FROM pointers WHERE status = 'ready' GROUP BY 1) ON video_id = c""")
def _(v):
    d = P.visible_channels(v.pointers, v.table("conversations").select(F.col("conv_id").alias("video_id")).distinct())
    return d.withColumn("indexed", F.array_join("indexed", "|"))


@query("verify_write", "video_id:l modality:s rows:l verified:b", views="pointers unit_counts", sql="""
  SELECT video_id, modality, c."rows", c."rows" = row_count AS verified FROM pointers JOIN unit_counts c USING (video_id, modality, asset_version)""")
def _(v):
    return P.verify_write(v.pointers, v.unit_counts)


@query("publish_dependents", "video_id:l modality:s kind:s", views="pointers", sql="""
  SELECT video_id, modality, 'update' AS kind FROM pointers WHERE modality = 'asr' OR (modality = 'speaker' AND video_id % 2 = 0 AND video_id % 13 <> 12)
  UNION ALL SELECT video_id, 'speaker', 'disable' FROM pointers WHERE modality = 'speaker' AND NOT (video_id % 2 = 0 AND video_id % 13 <> 12)""")
def _(v):
    u = v.pointers.where("modality = 'asr' OR (modality = 'speaker' AND video_id % 2 = 0 AND video_id % 13 <> 12)")
    updates, off = P.publish_dependents(u, v.pointers)
    return updates.selectExpr("video_id", "modality", "'update' AS kind").unionByName(off.selectExpr("video_id", "modality", "'disable' AS kind"))


@query("import_publications", "video_id:l modality:s asset_version:s row_count:l status:s requires_rebuild:b", views="unit_counts frames", sql="""
  SELECT video_id, modality, asset_version, "rows" AS row_count, CASE WHEN modality = 'visual' AND video_id IN (SELECT video_id FROM frames WHERE frame_idx % 40 = 7 AND video_id % 2 = 1) THEN 'disabled' ELSE 'ready' END AS status,
   modality = 'visual' AND video_id IN (SELECT video_id FROM frames WHERE frame_idx % 40 = 7 AND video_id % 2 = 1) AS requires_rebuild FROM unit_counts""")
def _(v):
    m = v.unit_counts.selectExpr("video_id", "modality", "CAST(NULL AS STRING) AS version", "rows AS declared")
    f = v.frames.withColumns({"asset_version": F.expr("concat('visual-', video_id % 3)"), "segment_end_ms": F.expr("segment_end_ms + CASE WHEN frame_idx % 40 = 7 AND video_id % 2 = 1 THEN 5 ELSE 0 END")})
    return P.import_publications(v.unit_counts, m, f)


def _repair(v):
    f = v.frames.withColumn("asset_version", F.expr("concat('visual-', video_id % 3)")).withColumns({
        "segment_id": F.expr("timestamp_ms div 4000 + CASE WHEN video_id = 3 AND frame_idx = 11 THEN 1 ELSE 0 END"), "segment_start_ms": F.lit(0).cast("long")})
    dur = v.frames.groupBy("video_id").agg(F.max("timestamp_ms").alias("duration_ms"))
    return P.repair_time_bounds(f, dur, v.pointers, 4000)


_REP = """WITH d AS (SELECT f.*, max(timestamp_ms) OVER (PARTITION BY video_id) AS dur FROM frames f JOIN pointers p USING (video_id) WHERE p.modality = 'visual' AND p.status = 'ready')"""


@query("repair_time_bounds", "video_id:l frame_idx:l segment_id:l segment_start_ms:l segment_end_ms:l", views="frames pointers", sql=_REP + """
  SELECT video_id, frame_idx, s AS segment_id, s * 4000 AS segment_start_ms, least(s * 4000 + 4000, dur) AS segment_end_ms FROM (SELECT *, least(timestamp_ms, dur - 1) // 4000 AS s FROM d) WHERE video_id <> 3""")
def _(v):
    return _repair(v)[0]


@query("repair_time_bounds_report", "video_id:l rows:l bad_rows:l status:s", views="frames pointers", sql=_REP + """
  SELECT video_id, count(*) AS "rows", CASE WHEN video_id = 3 THEN 1 ELSE 0 END AS bad_rows, CASE WHEN video_id = 3 THEN 'rejected_rows' ELSE 'repaired' END AS status FROM d GROUP BY 1""")
def _(v):
    return _repair(v)[1]


@query("promote_staging", "video_id:l outcome:s", views="pointers unit_counts", sql="""
  SELECT video_id, CASE WHEN video_id % 4 = 2 THEN 'conflict' WHEN NOT bool_and(c."rows" = row_count) THEN 'unverified' WHEN video_id % 4 = 0 THEN 'already_current' ELSE 'promoted' END AS outcome
  FROM pointers JOIN unit_counts c USING (video_id, modality, asset_version) WHERE status = 'ready' GROUP BY 1""")
def _(v):
    base = v.pointers.withColumn("asset_version", F.lit("old"))
    target = v.pointers.where("status = 'ready'").withColumn("asset_version", F.expr("CASE video_id % 4 WHEN 0 THEN asset_version WHEN 2 THEN 'other' ELSE 'old' END"))
    return P.promote_staging(v.pointers, target, base, v.unit_counts)[1]


@query("copy_verified", "asset_version:s rows:l same:b", sql="SELECT 'v' || (event_id % 4) AS asset_version, count(*) AS \"rows\", true AS same FROM events GROUP BY 1")
def _(v):
    e = v.table("events").selectExpr("concat('v', event_id % 4) AS asset_version", "event_id", "user_id", "value", "props")
    return P.copy_verified(e, fresh(v, "copy"), ["event_id", "user_id", "value", "props"])


@query("rebuild_groups", "video_id:l tracks:l groups:l status:s")
def _(v):
    return P.rebuild_groups(v.tracks.withColumn("asset_version", F.expr("concat('face-', video_id % 3)")), v.pointers)[1]


@query("migrate_entity_samples", "entity_id:l pk:s", sql="""
  SELECT o_custkey AS entity_id, 'old' || min(o_orderkey) AS pk FROM orders WHERE o_custkey % 3 <> 0 GROUP BY o_custkey
  UNION ALL SELECT o_custkey, 'entity_face#' || o_custkey || '#' || left(sha256(o_custkey || chr(0) || 's' || max(o_orderkey)), 32) FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey""")
def _(v):
    o = v.table("orders").groupBy(F.col("o_custkey").alias("entity_id")).agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    samples = o.selectExpr("entity_id", "concat('old', lo) AS pk", "CASE WHEN entity_id % 3 = 0 THEN array(0.0D, 0.0D) ELSE array(1.0D, 0.0D) END AS embedding")
    vectors = o.selectExpr("entity_id", "concat('s', hi) AS source", "array(0.6D, 0.8D) AS embedding")
    return P.migrate_entity_samples(o, samples, vectors)


@query("verify_publications", "modality:s verdict:s n:l", views="pointers unit_counts", sql="""
  SELECT modality, CASE WHEN p.status <> 'ready' THEN 'not_ready' WHEN c."rows" <> p.row_count THEN 'row_count_mismatch' ELSE 'ok' END AS verdict, count(*) AS n
  FROM pointers p JOIN unit_counts c USING (video_id, modality, asset_version) GROUP BY 1, 2""")
def _(v):
    return P.verify_publications(v.pointers, v.unit_counts)
