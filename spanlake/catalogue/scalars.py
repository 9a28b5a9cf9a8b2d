"""Scalar-function queries."""
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import ocr as O
from ..functions import text as T
from ..functions import timing as M
from ..functions import vector as V
from .registry import query

_NORM = "sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)))"


@query("l2_normalize", "vec_id:l first:d norm:d", sql=f"SELECT vec_id, embedding[1]::DOUBLE * 3 / greatest({_NORM} * 3, 1e-12) AS \"first\", 1.0 AS norm FROM embeddings")
def _(v):
    d = v.vectors().withColumn("n", V.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3)))
    return d.select("vec_id", F.col("n")[0].alias("first"), V.norm("n").alias("norm"))


_PAIR = "embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings)"


def _pairs(v):
    a = v.vectors().withColumn("next", (F.col("vec_id") + 1) % v.n_vectors)
    b = v.vectors().select(F.col("vec_id").alias("next"), F.col("embedding").alias("other"))
    return a.join(b, "next")


@query("cosine", "vec_id:l score:d", sql=f"SELECT a.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM {_PAIR}")
def _(v):
    return _pairs(v).withColumn("score", V.cosine("embedding", "other"))


@query("inner_product", "vec_id:l score:d", sql=f"SELECT a.vec_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM {_PAIR}")
def _(v):
    return _pairs(v).withColumn("score", V.inner_product("embedding", "other"))


@query("face_confidence", "unit_id:l c:d", views="candidates", sql="SELECT unit_id, 1 / (1 + exp(-12 * (raw_score - 0.45))) AS c FROM candidates")
def _(v):
    return v.candidates.select("unit_id", V.face_confidence(F.col("raw_score")).alias("c"))


@query("visual_confidence", "vec_id:l c:d", sql="SELECT vec_id, greatest(0, least(1, (embedding[1]::DOUBLE * 6 + 1) / 2)) AS c FROM embeddings")
def _(v):
    return v.vectors().select("vec_id", V.visual_confidence(F.col("embedding")[0].cast("double") * 6).alias("c"))


@query("alpha_blend", "vec_id:l first:d", sql=f"""
  SELECT vec_id, (m[1] / sqrt(list_sum(list_transform(m, lambda x: x * x)))) AS "first" FROM (
   SELECT a.vec_id, list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: 0.3 * p[1] / na + 0.7 * p[2] / nb) AS m FROM (
     SELECT vec_id, embedding, {_NORM} AS na FROM embeddings) a JOIN (SELECT vec_id, embedding, {_NORM} AS nb FROM embeddings) b
     ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings))""")
def _(v):
    return _pairs(v).select("vec_id", V.alpha_blend("embedding", "other", 0.3)[0].alias("first"))


@query("yes_no_probability", "event_id:l p:d", sql="""
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 / (1 + exp(-(user_id % 7) * 0.5 - value / 100 + (user_id % 5) * 0.25))
   WHEN event_id % 3 = 1 THEN 1 ELSE 0 END AS p FROM events""")
def _(v):
    d = v.table("events").selectExpr(
        "event_id", "CASE event_id % 3 WHEN 1 THEN 'Yes, it does' ELSE 'no' END AS content",
        "CASE WHEN event_id % 3 = 0 THEN array(named_struct('token', ' Yes', 'logprob', (user_id % 7) * 0.5D + value / 100),"
        " named_struct('token', 'NO', 'logprob', (user_id % 5) * 0.25D), named_struct('token', 'maybe', 'logprob', 9.0D))"
        " ELSE array(named_struct('token', 'maybe', 'logprob', 0.0D)) END AS entries")
    return d.select("event_id", K.yes_no_probability("entries", "content").alias("p"))


@query("blend_score", "event_id:l score:d", sql="SELECT event_id, CASE WHEN event_id % 5 = 0 THEN value ELSE 0.7 * user_id + 0.3 * value END AS score FROM events")
def _(v):
    d = v.table("events").selectExpr("event_id", "value", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS r")
    return d.select("event_id", K.blend_score("r", "value", 0.7).alias("score"))


@query("bbox_iou", "event_id:l iou:d", sql="""
  SELECT event_id, i / greatest(1e-6, aa + ab - i) AS iou FROM (SELECT *, greatest(0.0, least(10, x + 8) - greatest(0, x)) * greatest(0.0, least(10, y + 6) - greatest(0, y)) AS i
   FROM (SELECT event_id, (user_id % 15)::DOUBLE AS x, (event_id % 13)::DOUBLE AS y, 100.0::DOUBLE AS aa, 48.0::DOUBLE AS ab FROM events))""")
def _(v):
    d = v.table("events").selectExpr("event_id", "named_struct('x1', 0.0D, 'y1', 0.0D, 'x2', 10.0D, 'y2', 10.0D) AS a",
        "named_struct('x1', (user_id % 15) * 1.0D, 'y1', (event_id % 13) * 1.0D, 'x2', (user_id % 15) + 8.0D, 'y2', (event_id % 13) + 6.0D) AS b")
    return d.select("event_id", O.bbox_iou("a", "b").alias("iou"))


def _boxes(v):
    return v.table("events").selectExpr("event_id", "value", """array(named_struct('x', 0.0D, 'y', 0.0D),
        named_struct('x', (user_id % 15) * 1.0D, 'y', 1.0D), named_struct('x', value, 'y', (event_id % 13) * 1.0D),
        named_struct('x', -1.0D, 'y', 5.0D)) AS box""")


@query("polygon_area", "event_id:l area:d", sql="""
  SELECT event_id, abs(a * h - value * 1 + value * 5 + h) / 2 AS area FROM (SELECT event_id, value, (user_id % 15)::DOUBLE AS a, (event_id % 13)::DOUBLE AS h FROM events)""")
def _(v):
    return _boxes(v).select("event_id", O.polygon_area("box").alias("area"))


@query("bbox_bounds", "event_id:l left:d top:d right:d bottom:d", sql="""
  SELECT event_id, least(0, value, -1) AS "left", least(0, 1, event_id % 13, 5) AS top, greatest(user_id % 15, value, 0) AS "right",
   greatest(5, event_id % 13) AS bottom FROM events""")
def _(v):
    return _boxes(v).select("event_id", O.bbox_bounds("box").alias("b")).select("event_id", "b.*")


@query("detection_quality", "event_id:l q:d", sql="""
  SELECT event_id, 0.5 * least(value / 400, 1) + 0.25 * least(1, sqrt((u + 20.0) * (u + 30.0) / (640 * 360.0)) / 0.35) + 0.15 * (event_id % 10) / 10.0
    + 0.10 * least(1, greatest(0, least(u * 4, u, 640 - u * 5 - 20, 360 - u * 2 - 30)) / (0.08 * 360)) AS q
  FROM (SELECT event_id, value, (user_id % 100)::DOUBLE AS u FROM events)""")
def _(v):
    d = v.table("events").selectExpr("event_id", "least(value / 400, 1.0D) AS det", "(event_id % 10) / 10.0D AS sharp",
        """named_struct('x1', (user_id % 100) * 4.0D, 'y1', (user_id % 100) * 1.0D, 'x2', (user_id % 100) * 5.0D + 20,
        'y2', (user_id % 100) * 2.0D + 30) AS box""")
    return d.select("event_id", O.detection_quality("det", "box", F.lit(640.0), F.lit(360.0), "sharp").alias("q"))


@query("ms_to_s", "vec_id:l t:d", views="frames", sql="SELECT vec_id, timestamp_ms / 1000.0::DOUBLE AS t FROM frames")
def _(v):
    return v.frames.select("vec_id", M.ms_to_s("timestamp_ms").alias("t"))


@query("temporal_gap", "unit_id:l gap:d", views="candidates", sql="SELECT unit_id, greatest(start_time - 310, 300 - end_time, 0) AS gap FROM candidates")
def _(v):
    return v.candidates.select("unit_id", M.temporal_gap(F.lit(300.0), F.lit(310.0), "start_time", "end_time").alias("gap"))


@query("interval_overlap", "unit_id:l hit:b", views="candidates", sql="SELECT unit_id, start_time < 310 AND end_time > 300 AS hit FROM candidates")
def _(v):
    return v.candidates.select("unit_id", M.interval_overlap(F.lit(300.0), F.lit(310.0), "start_time", "end_time").alias("hit"))


@query("expand_window", "unit_id:l s:d e:d", views="candidates", sql="""
  SELECT unit_id, CASE WHEN end_time - start_time >= 3 THEN start_time ELSE round(greatest(0, r - 3), 3) END AS s,
    CASE WHEN end_time - start_time >= 3 THEN end_time ELSE round(r, 3) END AS e FROM (
   SELECT *, least(greatest(end_time, 720), greatest(0, (start_time + end_time) / 2 - 1.5) + 3) AS r FROM candidates)""")
def _(v):
    s, e = M.expand_window("start_time", "end_time", F.lit(720.0), 3.0)
    return v.candidates.select("unit_id", s.alias("s"), e.alias("e"))


@query("sample_timestamps", "unit_id:l i:l t:d", views="candidates", sql="""
  SELECT unit_id, i, least(greatest(0, start_time + greatest(0.05, e - start_time) * (i + 0.5) / 4), 699.99) AS t FROM (
   SELECT unit_id, start_time, least(greatest(start_time + 0.05, end_time), 700) AS e FROM candidates), range(4) r(i)""")
def _(v):
    d = v.candidates.select("unit_id", F.posexplode(M.sample_timestamps("start_time", "end_time", 4, F.lit(700.0))).alias("i", "t"))
    return d


@query("fixed_bucket", "vec_id:l bucket:l", views="frames", sql="SELECT vec_id, least(timestamp_ms, 39999) // 7000 AS bucket FROM frames")
def _(v):
    return v.frames.select("vec_id", M.fixed_bucket("timestamp_ms", F.lit(40000), 7000).alias("bucket"))


@query("frame_window", "vec_id:l start_ms:l end_ms:l", views="frames", sql="""
  SELECT vec_id, timestamp_ms AS start_ms, least(15100, timestamp_ms + 500) AS end_ms FROM frames WHERE timestamp_ms < 15100""")
def _(v):
    return M.frame_window(v.frames.withColumn("dur", F.lit(15100)), "timestamp_ms", "dur", 2.0)


@query("offset_items", "video_id:l item_id:l start_ms:l end_ms:l", views="items", sql="""
  SELECT video_id, item_id, start_ms + unit_id * 60000 AS start_ms, end_ms + unit_id * 60000 AS end_ms FROM items""")
def _(v):
    units = v.items.select("video_id", "unit_id").distinct().withColumn("offset_ms", F.col("unit_id") * 60000)
    return M.offset_items(v.items, units)


@query("parse_timecode", "event_id:l t:d", sql="""
  SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE (CASE WHEN event_id % 4 = 1 THEN event_id % 30 ELSE 0 END) * 3600
    + (event_id % 60) * 60 + user_id % 60 + (event_id % 1000) / 1000.0::DOUBLE END AS t FROM events""")
def _(v):
    code = """CASE event_id % 4 WHEN 3 THEN 'no code' WHEN 1 THEN format_string(' %d:%02d:%02d,%03d ', event_id % 30, event_id % 60, user_id % 60, event_id % 1000)
        ELSE format_string('%02d:%02d.%03d', event_id % 60, user_id % 60, event_id % 1000) END AS code"""
    return v.table("events").selectExpr("event_id", "user_id", code).select("event_id", M.parse_timecode("code").alias("t"))


@query("normalize_text", "doc_id:l text:s", sql="SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def _(v):
    return v.table("documents").select("doc_id", T.normalize_text("text").alias("text"))


@query("normalize_search_text", "doc_id:l text:s")
def _(v):
    return v.table("documents").select("doc_id", T.normalize_search_text("text").alias("text"))


@query("truncate_text_utf8", "doc_id:l text:s", sql="SELECT doc_id, left(text, 2000) AS text FROM documents")
def _(v):
    return v.table("documents").select("doc_id", T.truncate_text_utf8("text").alias("text"))


@query("clean_ocr_text", "page_id:l text:s")
def _(v):
    return v.table("pages").select("page_id", T.clean_ocr_text("html").alias("text"))


@query("join_text_cjk", "conv_id:l turn:l text:s", sql="""
  SELECT conv_id, turn, CASE WHEN regexp_matches(rtrim(text), '[,;:]$') THEN rtrim(text) || role ELSE concat_ws(' ', nullif(rtrim(text), ''), role) END AS text FROM conversations""")
def _(v):
    return v.table("conversations").select("conv_id", "turn", T.join_text_cjk("text", F.concat(F.lit("  "), "role")).alias("text"))


@query("merge_labels", "user_id:l labels:s", sql="SELECT user_id, CASE WHEN event_type = 'view' THEN 'view|seen' ELSE event_type || '|view|seen' END AS labels FROM events")
def _(v):
    return v.table("events").select("user_id", T.merge_labels(F.concat(F.lit(" "), F.upper("event_type")), F.lit("view|Seen||view")).alias("labels"))


@query("extract_tags", "conv_id:l turn:l text:s emotion:s audio_event:s", sql="""
  SELECT conv_id, turn, trim(text) AS text, CASE WHEN turn % 2 = 0 THEN 'happy' ELSE 'neutral|sad' END AS emotion, 'speech' AS audio_event FROM conversations""")
def _(v):
    tagged = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<|HAPPY|><|Speech|>"), "text")).otherwise(
        F.concat(F.lit("<|zh|><|neutral|>"), "text", F.lit("<|SAD|><|speech|><|neutral|>")))
    return v.table("conversations").select("conv_id", "turn", T.extract_tags(tagged).alias("t")).select("conv_id", "turn", "t.*")


@query("tokenize", "doc_id:l n:l longest:l first:s", sql="""
  SELECT doc_id, len(t) AS n, list_max(list_transform(t, lambda x: length(x))) AS longest, t[1] AS "first" FROM (
   SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents)""")
def _(v):
    d = v.table("documents").select("doc_id", T.tokenize("text").alias("t"))
    return d.select("doc_id", F.size("t").alias("n"), F.array_max(F.transform("t", lambda x: F.length(x))).alias("longest"), F.get("t", F.lit(0)).alias("first"))


@query("contains_any", "doc_id:l hit:b", sql="SELECT doc_id, contains(lower(text), 'the ') OR contains(lower(text), 'nicht') AS hit FROM documents")
def _(v):
    return v.table("documents").select("doc_id", T.contains_any("text", ("The ", "NICHT")).alias("hit"))


@query("route_by_language", "doc_id:l engine:s decode_language:s route:s reason:s", sql="""
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'whisper-x' ELSE 'faster-whisper' END AS engine, CASE WHEN doc_id % 3 = 2 THEN 'fr' ELSE lang END AS decode_language,
   CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'auto:probe=' || lang || '->faster-whisper' ELSE 'auto:explicit-fr->faster-whisper' END AS route,
   CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'auto language probe probability=0.750' ELSE 'explicit non-Chinese ASR language' END AS reason FROM documents""")
def _(v):
    d = v.table("documents").selectExpr("doc_id", "lang", "CASE doc_id % 3 WHEN 0 THEN 'Whisper_X' ELSE 'auto' END AS engine",
                                        "CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN 'auto' ELSE 'fr' END AS requested")
    return d.select("doc_id", T.route_by_language("engine", "requested", "lang", F.lit(0.75)).alias("r")).select("doc_id", "r.*")


@query("align_tokens", "item_id:l n:l last_end:l", sql="""
  SELECT item_id, len(regexp_extract_all(text, '[^ ]+')) AS n, length(rtrim(text)) AS last_end FROM benchmark""")
def _(v):
    d = v.table("benchmark").select("item_id", T.align_tokens("text", F.filter(F.split("text", " "), lambda x: F.trim(x) != "")).alias("a"))
    return d.select("item_id", F.size("a").alias("n"), F.element_at("a", -1)["e"].alias("last_end"))


@query("snippet", "doc_id:l s:s", sql="SELECT doc_id, '[asr_hybrid] ' || left(text, 100) || ' · hybrid=' || format('{:.3f}', doc_id / 8.0::DOUBLE) AS s FROM documents")
def _(v):
    return v.table("documents").select("doc_id", T.snippet("asr_hybrid", "text", F.col("doc_id") / 8.0, "hybrid").alias("s"))


@query("evidence_text", "page_id:l s:s", sql="SELECT page_id, left(url || chr(10) || html, 2000) AS s FROM pages")
def _(v):
    return v.table("pages").select("page_id", T.evidence_text(F.array("url", F.lit(""), "html", "url", F.lit(None))).alias("s"))


@query("make_pk", "doc_id:l pk:s", sql="SELECT doc_id, source || '#v_1#m#asr#s' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS pk FROM documents")
def _(v):
    return v.table("documents").select("doc_id", K.unit_pk("asr", "source", F.lit("v#1"), F.lit("m"), "doc_id").alias("pk"))


@query("sample_id", "doc_id:l id:s", sql="SELECT doc_id, left(sha256(source || chr(0) || 'v1' || chr(0) || doc_id), 32) AS id FROM documents")
def _(v):
    return v.table("documents").select("doc_id", K.sample_id("source", F.lit("v1"), "doc_id").alias("id"))


@query("stable_version", "doc_id:l version:s", sql="""
  SELECT doc_id, h[1:12] || '5' || h[14:16] || substr('89ab', 1 + (strpos('0123456789abcdef', h[17:17]) - 1) % 4, 1) || h[18:32] AS version FROM (
   SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('bounds' || chr(0) || source || chr(0) || doc_id)) AS h FROM documents)""")
def _(v):
    ns = "6ba7b8119dad11d180b400c04fd430c8"  # the URL namespace of RFC 4122
    return v.table("documents").select("doc_id", K.stable_version(ns, F.lit("bounds"), "source", "doc_id").alias("version"))


@query("publication_meta", "video_id:l modality:s meta:s", views="pointers", sql="""
  SELECT video_id, modality, CASE WHEN source_asr IS NULL THEN '{"rows":"' || row_count || '"}'
   ELSE '{"rows":"' || row_count || '","source_asr_asset_version":"' || source_asr || '"}' END AS meta FROM pointers""")
def _(v):
    return v.pointers.select("video_id", "modality", F.to_json(K.publication_meta(rows="row_count", source_asr_asset_version="source_asr")).alias("meta"))


@query("expose_metadata", "video_id:l modality:s asset_version:s source_asr_asset_version:s", views="pointers",
       sql="SELECT video_id, modality, asset_version, source_asr AS source_asr_asset_version FROM pointers")
def _(v):
    d = v.pointers.withColumn("metadata", K.publication_meta(asset_version=F.lit("ignored"), source_asr_asset_version="source_asr"))
    return K.expose_metadata(d, ["asset_version", "source_asr_asset_version"])


@query("embedding_space", "p_partkey:l visual:s text:s", sql="""
  SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'siglip2-image-text' WHEN 1 THEN 'openclip-image-text' ELSE 'visual-image-text' END AS visual,
   CASE WHEN p_partkey % 2 = 0 THEN 'minilm-text-semantic' ELSE 'text-semantic' END AS text FROM part""")
def _(v):
    d = v.table("part").selectExpr("p_partkey", "CASE p_partkey % 3 WHEN 0 THEN 'siglip2-so400m-384' WHEN 1 THEN 'openclip-vit-b32' ELSE p_name END AS m",
                                   "CASE p_partkey % 2 WHEN 0 THEN 'paraphrase-MiniLM-L12' ELSE p_name END AS t")
    return d.select("p_partkey", K.visual_embedding_space("m").alias("visual"), K.text_embedding_space("t").alias("text"))


@query("canonical_language", "doc_id:l code:s", sql="SELECT doc_id, CASE lang WHEN 'en' THEN 'en' WHEN 'es' THEN 'es' ELSE lang END AS code FROM documents")
def _(v):
    d = v.table("documents").selectExpr("doc_id", "CASE lang WHEN 'en' THEN ' English' WHEN 'es' THEN '西语' ELSE upper(lang) END AS l")
    return d.select("doc_id", K.canonical_language("l").alias("code"))


@query("canonical_model", "p_partkey:l model:s", sql="""
  SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'siglip2-so400m-384' WHEN 1 THEN 'chinese-clip-vit-b16' WHEN 2 THEN 'openclip-vit-l14' END AS model FROM part""")
def _(v):
    d = v.table("part").selectExpr("p_partkey", "CASE p_partkey % 4 WHEN 0 THEN 'SigLIP2' WHEN 1 THEN 'chinese-vit-b-16' WHEN 2 THEN ' openclip-vit-l14' END AS m")
    return d.select("p_partkey", K.canonical_model("m").alias("model"))


@query("py_round", "event_id:l r:d", sql="SELECT event_id, round_even(value / 3, 3) AS r FROM events")
def _(v):
    return v.table("events").select("event_id", K.py_round(F.col("value") / 3, 3).alias("r"))


@query("decode_f32_blob", "vec_id:l first:d n:l", sql="SELECT vec_id, embedding[1]::DOUBLE AS \"first\", len(embedding) AS n FROM embeddings")
def _(v):
    d = v.vectors().withColumn("b", V.encode_f32_blob("embedding")).withColumn("e", V.decode_f32_blob("b"))
    return d.select("vec_id", F.col("e")[0].cast("double").alias("first"), F.size("e").alias("n"))
