"""Source and sink queries. Sinks write the whole derived table to the shared folder and read it back."""
import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import readers as R
from ..sources import writers as W
from .registry import query


def fresh(v, name):
    return f"{shared_dir(v.spark)}/{name}-{uuid.uuid4().hex}"


def written(v, df, name):
    path = fresh(v, name)
    W.write_units(df, path)
    return v.spark.read.parquet(path)


@query("scan_catalog", "video_id:l folders:s indexed:s n_pub:l", views="members pointers", sql="""
  WITH vid AS (SELECT s_suppkey AS video_id FROM supplier), f AS (SELECT video_id, string_agg(n_name, '|' ORDER BY n_name) AS folders FROM members JOIN nation ON n_nationkey = folder_id GROUP BY 1),
  p AS (SELECT video_id, string_agg(modality, '|' ORDER BY modality) FILTER (WHERE status = 'ready') AS indexed, count(*) AS n FROM pointers GROUP BY 1)
  SELECT video_id, coalesce(folders, '') AS folders, coalesce(indexed, '') AS indexed, coalesce(n, 0) AS n_pub FROM vid LEFT JOIN f USING (video_id) LEFT JOIN p USING (video_id)""")
def _(v):
    videos = v.table("supplier").select(F.col("s_suppkey").alias("video_id"))
    folders = v.table("nation").select(F.col("n_nationkey").cast("long").alias("folder_id"), F.col("n_name").alias("name"))
    d = R.scan_catalog(videos, folders, v.members, v.pointers)
    return d.select("video_id", F.array_join(F.transform("folders", lambda f: f["name"]), "|").alias("folders"), F.array_join("indexed", "|").alias("indexed"),
                    F.coalesce(F.size("publications"), F.lit(0)).alias("n_pub"))


@query("scan_units", "video_id:l frame_idx:l timestamp_ms:l", views="frames pointers", sql="""
  SELECT f.video_id, frame_idx, timestamp_ms FROM frames f JOIN pointers p ON p.video_id = f.video_id AND p.modality = 'visual' AND p.status = 'ready' AND p.asset_version = 'visual-' || (f.video_id % 2)""")
def _(v):
    path = fresh(v, "units")
    W.write_units(v.frames.withColumn("asset_version", F.expr("concat('visual-', video_id % 2)")), path)
    return R.scan_units(v.spark, path, v.pointers.where("modality = 'visual'"), ["frame_idx", "timestamp_ms"])


@query("scan_version_counts", "video_id:l asset_version:s rows:l", sql="SELECT user_id AS video_id, 'v' || (event_id % 3) AS asset_version, count(*) AS \"rows\" FROM events GROUP BY 1, 2")
def _(v):
    return R.scan_version_counts(v.table("events").selectExpr("user_id AS video_id", "concat('v', event_id % 3) AS asset_version"))


@query("read_transcript_sidecar", "conv_id:l pos:l start_time:d end_time:d text:s", sql="""
  SELECT conv_id, turn AS pos, turn * 4 + 0.5 AS start_time, turn * 4 + 3.25 AS end_time, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations WHERE trim(text) <> ''""")
def _(v):
    c = v.table("conversations").selectExpr("conv_id", "turn", "trim(regexp_replace(text, '\\\\s+', ' ')) AS t").where("t <> ''")
    srt = F.format_string("%d\n00:%02d:%02d,500 --> 00:%02d:%02d,250\n%s", F.col("turn") + 1, (F.col("turn") * 4 / 60).cast("int"), F.col("turn") * 4 % 60,
                          ((F.col("turn") * 4 + 3) / 60).cast("int"), (F.col("turn") * 4 + 3) % 60, F.col("t"))
    seg = F.struct((F.col("turn") * 4 + 0.5).cast("double").alias("start"), (F.col("turn") * 4 + 3.25).cast("double").alias("end"), F.col("t").alias("text"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", srt.alias("srt"), seg.alias("seg")))).alias("r"))
    lines = F.array_join(F.transform("r", lambda r: r["srt"]), "\r\n\r\n")
    value = (F.when(F.col("conv_id") % 3 == 0, F.to_json(F.struct(F.transform("r", lambda r: r["seg"]).alias("segments"))))
             .when(F.col("conv_id") % 3 == 1, F.concat(F.lit("﻿WEBVTT\r\nKind: captions\r\n\r\n"), lines)).otherwise(lines))
    ext = F.when(F.col("conv_id") % 3 == 0, ".json").when(F.col("conv_id") % 3 == 1, ".vtt").otherwise(".srt")
    files = g.select(F.concat(F.col("conv_id").cast("string"), ext).alias("path"), value.alias("value"))
    return R.parse_sidecar(files).withColumn("conv_id", F.regexp_extract("path", r"(\d+)\.", 1))


@query("read_chunk_records", "video_id:l item_id:l start_ms:l end_ms:l text:s", views="items", sql="""
  SELECT video_id, item_id, start_ms, CASE WHEN item_id % 3 = 2 THEN start_ms ELSE end_ms END AS end_ms, trim(text) AS text FROM items WHERE trim(text) <> ''""")
def _(v):
    r = v.items.selectExpr("video_id", "item_id", "text", "CASE WHEN item_id % 3 = 0 THEN start_ms END AS start_ms", "CASE WHEN item_id % 3 = 0 THEN end_ms END AS end_ms",
                           "CASE WHEN item_id % 3 = 1 THEN start_ms / 1000.0D END AS start_time", "CASE WHEN item_id % 3 = 2 THEN start_ms / 1000.0D END AS start",
                           "CASE WHEN item_id % 3 = 1 THEN end_ms / 1000.0D WHEN item_id % 3 = 2 THEN start_ms / 1000.0D - 1 END AS end_time")
    return R.read_chunk_records(r)


@query("read_ground_truth", "semantic_query_id:s video_id:s start_sec:d end_sec:d", views="truth", sql="""
  SELECT CAST(query_id AS VARCHAR) AS semantic_query_id, CAST(video_id AS VARCHAR) AS video_id, t_start AS start_sec, t_end AS end_sec FROM truth""")
def _(v):
    t = v.truth.select("query_id", "video_id", F.struct(F.col("t_start").alias("start_sec"), F.col("t_end").alias("end_sec")).alias("s"))
    # one catalogue group per (query, video): groups stay as small as a video's truth
    g = t.groupBy("query_id", "video_id").agg(F.collect_list("s").alias("segments")).select(
        F.col("query_id").cast("string").alias("semantic_query_id"), F.lit("q").alias("query"), F.lit("c").alias("category"),
        F.array(F.struct(F.col("video_id").cast("string").alias("video_id"), "segments")).alias("records"))
    return R.ground_truth_rows(g)


@query("read_legacy_manifest", "video_id:l modality:s version:s declared:l", views="pointers", sql="SELECT video_id, modality, asset_version AS version, row_count AS declared FROM pointers")
def _(v):
    p = v.pointers.groupBy("video_id").agg(F.map_from_entries(F.collect_list(F.struct("modality", F.struct(
        F.when(F.col("modality") == "asr", F.col("asset_version")).alias("version"), F.when(F.col("modality") != "asr", F.col("asset_version")).alias("asset_version"),
        F.col("row_count").alias("rows"))))).alias("channels"))
    return R.read_legacy_manifest(p.select("video_id", F.to_json(F.struct("channels")).alias("value")))


@query("write_visual_units", "pk:s segment_id:l first:d", views="frames", sql="""
  SELECT video_id || '#v' || (video_id % 2) || '#m#visual#f' || lpad(CAST(frame_idx AS VARCHAR), 8, '0') AS pk, segment_id, embedding[1] AS "first" FROM frames""")
def _(v):
    u = W.visual_units(v.frames.withColumn("asset_version", F.expr("concat('v', video_id % 2)")), "m", 64)
    return written(v, u, "visual").withColumn("first", F.col("embedding")[0].cast("double"))


@query("write_asr_units", "pk:s has_embedding:b text_len:l zero:b", views="text_units", sql="""
  SELECT video_id || '#v1#m#asr#s' || lpad(CAST(segment_idx AS VARCHAR), 8, '0') AS pk, has_embedding, least(length(text), 2000) AS text_len, NOT has_embedding AS zero FROM text_units""")
def _(v):
    t = v.text_units
    c = t.select("video_id", "segment_idx", "start_ms", "end_ms", "text", F.lit("v1").alias("asset_version"))
    e = t.where("has_embedding").select("video_id", F.col("segment_idx").alias("chunk_idx"), "embedding")
    d = written(v, W.asr_units(c, e, "m", 64), "asr")
    return d.select("pk", "has_embedding", F.length("text").alias("text_len"), F.forall("embedding", lambda x: x == 0).alias("zero"))


@query("write_ocr_units", "pk:s text_len:l avg_box_score:d has_embedding:b", sql="""
  SELECT video_id || '#v1#m#ocr#f' || lpad(CAST(frame_idx AS VARCHAR), 8, '0') || 'r0000' AS pk, least(sum(length(trim(text))) + count(*) - 1, 2000) AS text_len, avg((length(text) % 100) / 100.0::DOUBLE) AS avg_box_score,
   video_id % 2 = 0 AS has_embedding FROM (SELECT conv_id AS video_id, turn // 2 AS frame_idx, text FROM conversations) WHERE trim(text) <> '' GROUP BY video_id, frame_idx""")
def _(v):
    b = v.table("conversations").selectExpr("conv_id AS video_id", "turn div 2 AS frame_idx", "turn AS pos", "text", "(length(text) % 100) / 100.0D AS score")
    f = b.select("video_id", "frame_idx").distinct().selectExpr("video_id", "frame_idx", "frame_idx * 1000 AS frame_ms", "frame_idx * 1000 AS start_ms", "frame_idx * 1000 + 1000 AS end_ms", "'v1' AS asset_version")
    e = f.where("video_id % 2 = 0").withColumn("vec_id", F.col("video_id") % v.n_vectors).join(v.vectors(), "vec_id").select("video_id", "frame_idx", "embedding")
    return written(v, W.ocr_units(f, b, e, "m", 64), "ocr").withColumn("text_len", F.length("text"))


@query("write_face_units", "pk:s start_ms:l end_ms:l", views="tracks", sql="""
  SELECT video_id || '#v1#m#face#t' || lpad(CAST(track_idx AS VARCHAR), 8, '0') AS pk, start_ms, end_ms FROM tracks""")
def _(v):
    return written(v, W.face_units(v.tracks.withColumn("asset_version", F.lit("v1")), "m", 64), "face")


@query("write_face_groups", "pk:s duration_ms:l occurrence_count:l", views="tracks", sql="""
  SELECT video_id || '#v1#m#face_group#g' || lpad(CAST(label AS VARCHAR), 8, '0') AS pk, sum(end_ms - start_ms) AS duration_ms, sum(detections) AS occurrence_count FROM tracks GROUP BY video_id, label""")
def _(v):
    from ..operators.aggregates import vector_mean
    g = v.tracks.groupBy("video_id", F.col("label").alias("group_idx")).agg(
        F.sum(F.expr("end_ms - start_ms")).alias("duration_ms"), F.sum("detections").alias("occurrence_count"), F.max("quality").alias("quality"))
    g = g.join(vector_mean(v.tracks.withColumnRenamed("label", "group_idx"), ["video_id", "group_idx"], out="embedding"), ["video_id", "group_idx"]).withColumns({
        "importance": F.log1p("duration_ms"), "asset_version": F.lit("v1"), "bbox": F.expr("named_struct('x1', 0.1D, 'y1', 0.1D, 'x2', 0.5D, 'y2', 0.9D)")})
    return written(v, W.face_groups(g, "m", 64), "groups")


@query("write_speaker_units", "pk:s track_id:l", views="utterances", sql="""
  SELECT video_id || '#v1#m#speaker#u' || lpad(CAST(utterance_idx AS VARCHAR), 8, '0') AS pk, track_id FROM utterances""")
def _(v):
    return written(v, W.speaker_units(v.utterances.withColumn("asset_version", F.lit("v1")), "m", 64), "speaker")


@query("upsert_latest", "user_id:l event_type:s event_id:l value:d", sql="""
  SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2""")
def _(v):
    e = v.table("events").select("user_id", "event_type", "event_id", "value")
    return W.upsert_latest(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


def _delete(name, rest, gone):
    def run(v):
        u = v.table("events").selectExpr("user_id AS video_id", "event_type AS modality", "concat('v', event_id % 3) AS asset_version")
        kept, deleted = gone(u)
        k = kept.groupBy("video_id").agg(F.count("*").alias("kept"))
        return k.join(deleted, "video_id", "full_outer").select("video_id", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("deleted", F.lit(0)).alias("deleted"))
    query(name, "video_id:l kept:l deleted:l", sql=f"""SELECT video_id, count(*) FILTER (WHERE NOT ({rest})) AS kept, count(*) FILTER (WHERE {rest}) AS deleted
      FROM (SELECT user_id AS video_id, event_type AS modality, 'v' || (event_id % 3) AS asset_version FROM events) GROUP BY 1""")(run)


_delete("delete_video", "video_id = 7", lambda u: W.delete_video(u, 7))
_delete("delete_version", "video_id = 7 AND asset_version = 'v1'", lambda u: W.delete_version(u, 7, "v1"))
_delete("delete_modality", "video_id = 7 AND modality = 'view'", lambda u: W.delete_modality(u, 7, "view"))
_delete("keep_only_version", "video_id = 7 AND modality = 'view' AND asset_version <> 'v1'", lambda u: W.keep_only_version(u, 7, "view", "v1"))


@query("delete_entity_samples", "o_orderkey:l", sql="SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def _(v):
    gone = v.table("customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("entity_id"))
    return W.delete_entity_samples(v.table("orders").withColumn("entity_id", F.col("o_custkey")), gone)


@query("replace_samples", "entity_id:l pk:s", sql="""
  SELECT o_custkey AS entity_id, 's' || o_orderkey AS pk FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey, 'n' || o_custkey FROM (SELECT DISTINCT o_custkey FROM orders)""")
def _(v):
    s = v.table("orders").selectExpr("o_custkey AS entity_id", "concat('s', o_orderkey) AS pk", "o_orderstatus AS st")
    new = s.select("entity_id").distinct().selectExpr("entity_id", "concat('n', entity_id) AS pk", "'F' AS st")
    return W.replace_samples(s, s.where("st <> 'P'"), new)


@query("append_trace", "event_id:l event_type:s", sql="SELECT event_id, event_type FROM events")
def _(v):
    path = fresh(v, "trace")
    e = v.table("events").select("event_id", "event_type", "value")
    W.append_trace(e.where("event_id % 2 = 0"), path)
    W.append_trace(e.where("event_id % 2 = 1"), path)
    return v.spark.read.schema("event_id long, event_type string, value double").json(path)


def _membership(name, op, sql):
    def run(v):
        videos = v.table("supplier").select(F.col("s_suppkey").alias("video_id"))
        folders = v.table("nation").select(F.col("n_nationkey").cast("long").alias("folder_id"))
        return W.membership_update(v.members, videos, folders, videos.join(v.members.where("folder_id < 8"), "video_id", "left_semi"), folders.where("folder_id % 9 = 1"), op)
    query(name, "video_id:l folder_id:l", views="members", sql=sql)(run)


_PICK = "SELECT DISTINCT m.video_id, n_nationkey FROM members m, nation WHERE m.folder_id < 8 AND n_nationkey % 9 = 1"
_membership("membership_update", "add", f"SELECT video_id, folder_id FROM members UNION {_PICK}")
_membership("membership_update_remove", "remove", "SELECT video_id, folder_id FROM members WHERE NOT (folder_id < 8 AND folder_id % 9 = 1)")
_membership("membership_update_replace", "replace", f"SELECT video_id, folder_id FROM members WHERE folder_id >= 8 UNION {_PICK}")


@query("overlay_upsert", "video_id:l track_id:l display_name:s representative:l hidden:l", views="utterances", sql="""
  WITH k AS (SELECT DISTINCT video_id, track_id FROM utterances)
  SELECT video_id, track_id, CASE WHEN video_id % 2 = 0 AND video_id % 3 = 0 THEN 'new' WHEN video_id % 5 <> 0 THEN 'old' || video_id END AS display_name,
   CASE WHEN video_id % 2 = 0 AND video_id % 4 = 0 THEN 1 WHEN video_id % 5 <> 0 THEN 0 END AS representative, CASE WHEN video_id % 2 = 0 THEN 0 ELSE 1 END AS hidden FROM k
  WHERE video_id % 5 <> 0 OR video_id % 2 = 0""")
def _(v):
    k = v.utterances.select("video_id", "track_id").distinct()
    old = k.where("video_id % 5 <> 0").selectExpr("video_id", "track_id", "concat('old', video_id) AS display_name", "CAST(0 AS BIGINT) AS representative", "1 AS hidden")
    new = k.where("video_id % 2 = 0").selectExpr("video_id", "track_id", "CASE WHEN video_id % 3 = 0 THEN 'new' END AS display_name",
                                                 "CASE WHEN video_id % 4 = 0 THEN CAST(1 AS BIGINT) END AS representative", "0 AS hidden")
    return W.speaker_overlay_upsert(old, new)


@query("binding_upsert", "video_id:l track_id:l entity_id:l", views="utterances", sql="""
  SELECT video_id, track_id, CASE WHEN track_id = 1 THEN 99 ELSE video_id END AS entity_id FROM (SELECT DISTINCT video_id, track_id FROM utterances)""")
def _(v):
    k = v.utterances.select("video_id", "track_id").distinct().withColumn("entity_id", F.col("video_id"))
    return W.binding_upsert(k, k.where("track_id = 1").withColumn("entity_id", F.lit(99).cast("long")), ["video_id", "track_id"])


@query("cascade_delete", "kind:s n:l", sql="""
  SELECT 'orders' AS kind, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
  UNION ALL SELECT 'customer', count(*) FROM customer WHERE NOT c_acctbal < 0""")
def _(v):
    gone = v.table("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("entity_id"))
    o, c = W.cascade_delete(gone, "entity_id", v.table("orders").select(F.col("o_custkey").alias("entity_id")), v.table("customer").select(F.col("c_custkey").alias("entity_id")))
    return o.agg(F.lit("orders").alias("kind"), F.count("*").alias("n")).unionByName(c.agg(F.lit("customer").alias("kind"), F.count("*").alias("n")))
