"""Extension-point queries."""
from pyspark.sql import functions as F

from .. import config
from .. import udfs as U
from ..operators.aggregates import group_rollup
from .registry import query


@query("encoder_udf", "conv_id:l turn:l norm:d dim:l", sql="SELECT conv_id, turn, 1.0 AS norm, 64 AS dim FROM conversations WHERE trim(text) <> ''")
def _(v):
    from ..functions.vector import norm
    encode = U.encoder_udf(lambda: U.hashing_encoder(64))
    d = v.table("conversations").where("trim(text) <> ''").select("conv_id", "turn", encode("text").alias("e"))
    return d.select("conv_id", "turn", norm("e").alias("norm"), F.size("e").alias("dim"))


@query("semantic_arrays", "conv_id:l turn:l has_embedding:b semantic_status:s", sql="""
  WITH c AS (SELECT *, turn % 3 <> 0 AND conv_id % 4 <> 1 AND trim(text) <> '' AS ok FROM conversations)
  SELECT conv_id, turn, ok AS has_embedding, CASE WHEN bool_or(ok) OVER (PARTITION BY conv_id) THEN 'complete' ELSE 'empty' END AS semantic_status FROM c""")
def _(v):
    c = v.table("conversations").withColumn("semantic_eligible", F.expr("turn % 3 <> 0 AND conv_id % 4 <> 1"))
    return U.semantic_arrays(c, ["conv_id", "turn"], U.encoder_udf(lambda: U.hashing_encoder(64)), by=("conv_id",))


@query("detector_udf", "page_id:l n:l first:s", sql="""
  SELECT page_id, len(w) AS n, w[1] AS "first" FROM (SELECT page_id, regexp_extract_all(html, '[^\\s\\x{00A0}]+') AS w FROM pages)""")
def _(v):
    def load():
        def model(content):
            words = content.decode(errors="ignore").split()
            return [{"text": w, "score": 0.9, "left": float(i), "top": 0.0, "right": i + 1.0, "bottom": 1.0} for i, w in enumerate(words)]
        return model
    d = U.detect(v.table("pages").select("page_id", F.encode("html", "UTF-8").alias("content")), ["page_id"], load)
    return d.select("page_id", F.size("boxes").alias("n"), F.col("boxes")[0]["text"].alias("first"))


@query("reranker_udf", "doc_id:l p:d", sql="""
  WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '\\S+')) AS e, doc_id % (SELECT count(*) FROM benchmark) AS item_id FROM documents),
  b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '\\S+')) AS q FROM benchmark)
  SELECT doc_id, len(list_intersect(q, e)) / greatest(1, len(q))::DOUBLE AS p FROM d JOIN b USING (item_id)""")
def _(v):
    def load():
        return lambda q, e: [len(set(a.lower().split()) & set(b.lower().split())) / max(1, len(set(a.lower().split()))) for a, b in zip(q, e)]
    d = v.table("documents").withColumn("item_id", F.col("doc_id") % v.table("benchmark").agg(F.count("*")).scalar())
    j = d.join(v.table("benchmark").select("item_id", F.col("text").alias("q")), "item_id")
    return j.select("doc_id", U.reranker_udf(load)("q", "text").alias("p"))


@query("vec_mean_udaf", "segment:l video_id:l first:d", views="frames", sql="""
  SELECT segment_id AS segment, video_id, avg(embedding[1]) AS "first" FROM frames GROUP BY 1, 2""")
def _(v):
    d = v.frames.groupBy("video_id", F.col("segment_id").alias("segment")).agg(U.vec_mean("embedding").alias("m"))
    return d.withColumn("first", F.col("m")[0])


@query("profiles", "profile:s query_id:l video_id:l score:d", views="candidates", sql="""
  SELECT profile, query_id, video_id, sum(w * best) / sum(w) AS score FROM (SELECT query_id, video_id, modality, max(score) AS best FROM candidates GROUP BY 1, 2, 3) JOIN (
   SELECT * FROM (VALUES ('balanced', 'face', 0.55::DOUBLE), ('balanced', 'visual', 0.30), ('balanced', 'ocr', 0.20), ('balanced', 'asr', 0.15), ('even', 'face', 1.0), ('even', 'visual', 1.0), ('even', 'ocr', 1.0), ('even', 'asr', 1.0)) p(profile, modality, w)) USING (modality) GROUP BY 1, 2, 3""")
def _(v):
    even = config.profile("balanced", weights={c: 1.0 for c in config.CHANNELS})
    parts = [group_rollup(v.candidates, ["query_id", "video_id"], p.weights).withColumn("profile", F.lit(n)) for n, p in (("balanced", config.profile("balanced")), ("even", even))]
    return parts[0].unionByName(parts[1])
