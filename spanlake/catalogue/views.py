"""Views that shape the driver's tables into units, candidates, pointers and the like.

Each view exists twice: as a DataFrame (``Views``) and as an SQL common table
expression (``CTES``), over whole tables on both sides.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import l2_normalize
from ..session import bound_batches

EPOCH_US = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z
TOKEN = r"[\p{L}\p{N}]+"


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        bound_batches(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def n_vectors(self):
        return self.table("embeddings").agg(F.count("*")).scalar()

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", "embedding")

    @cached_property
    def frames(self) -> DataFrame:
        e = self.table("embeddings")
        return e.selectExpr(
            "vec_id", "vec_id % 5 AS video_id", "vec_id div 5 AS frame_idx", "label",
            "(vec_id div 5) * 200 AS timestamp_ms",
            "((vec_id div 5) * 200) div 5000 AS segment_id",
            "((vec_id div 5) * 200) div 5000 * 5000 AS segment_start_ms",
            "((vec_id div 5) * 200) div 5000 * 5000 + 5000 AS segment_end_ms", "embedding")

    @cached_property
    def clips(self) -> DataFrame:
        """The frames dealt to many small videos of ten frames each; some lie across two segments."""
        return self.frames.withColumn("video_id", F.expr("video_id + 5 * ((frame_idx + 5) div 10)"))

    @cached_property
    def qv(self) -> DataFrame:
        """Three unit query vectors per label: means over a three-way split of all its vectors."""
        e = self.table("embeddings").withColumn("query_idx", F.col("vec_id") % 3)
        return e.groupBy(F.col("label").cast("long").alias("query_id"), "query_idx").agg(
            Summarizer.mean(array_to_vector("embedding")).alias("m")
        ).select("query_id", "query_idx", l2_normalize(vector_to_array("m")).alias("vec"))

    @cached_property
    def qv1(self) -> DataFrame:
        """One unit query vector per label: the mean of all its vectors."""
        e = self.table("embeddings")
        return e.groupBy(F.col("label").cast("long").alias("query_id")).agg(Summarizer.mean(array_to_vector("embedding")).alias("m")).select(
            "query_id", F.lit(0).cast("long").alias("query_idx"), l2_normalize(vector_to_array("m")).alias("vec"))

    @cached_property
    def texts(self) -> DataFrame:
        """Text units before they meet their vectors."""
        return self.table("documents").selectExpr(
            "doc_id", "source AS video_id", "doc_id AS segment_idx", "doc_id * 10000 AS start_ms",
            "doc_id * 10000 + least(n_chars * 5, 9000) AS end_ms", "text", "lang",
            "doc_id % 7 <> 0 AS has_embedding")

    @cached_property
    def text_units(self) -> DataFrame:
        d = self.texts.withColumn("vec_id", F.col("doc_id") % self.n_vectors)
        return d.join(self.vectors(), "vec_id").withColumn(
            "embedding", F.when(F.col("has_embedding"), F.col("embedding"))).drop("vec_id")

    @cached_property
    def text_queries(self) -> DataFrame:
        b = self.table("benchmark").select(
            F.col("item_id").alias("query_id"), "text", (F.col("item_id") % self.n_vectors).alias("vec_id"))
        return b.join(self.vectors(), "vec_id").select("query_id", "text", F.col("embedding").alias("vec"))

    @cached_property
    def candidates(self) -> DataFrame:
        e = self.table("events")
        m = F.create_map(*[F.lit(x) for x in (
            "click", "visual", "view", "asr", "purchase", "ocr", "error", "face", "signup", "face")])
        # wall-clock difference: independent of the session time zone
        us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
        start = us / F.lit(3_600_000_000.0)
        return e.select(
            (F.col("event_id") % 4).alias("query_id"), F.col("user_id").alias("video_id"),
            m[F.col("event_type")].alias("modality"), F.col("event_id").alias("unit_id"),
            start.alias("start_time"), (start + 1 + F.col("value") / 100).alias("end_time"),
            F.least(F.col("value") / 517.3, F.lit(1.0)).alias("score"),
            F.least(F.col("value") / 517.3, F.lit(1.0)).alias("raw_score"))

    def intervals(self, *modalities: str) -> DataFrame:
        c = self.candidates.where(F.col("modality").isin(*modalities))
        return c.select("video_id", "unit_id", F.col("start_time").alias("start"), F.col("end_time").alias("end"), "score")

    @cached_property
    def utterances(self) -> DataFrame:
        c = self.table("conversations").selectExpr(
            "conv_id AS video_id", "turn AS utterance_idx", "turn * 2000 AS start_ms", "turn * 2000 + 1500 AS end_ms",
            "turn AS asr_chunk_idx", "text",
            "CAST(CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS BIGINT) AS track_id",
        ).withColumn("vec_id", (F.col("video_id") * 8 + F.col("utterance_idx")) % self.n_vectors)
        return c.join(self.vectors(), "vec_id").drop("vec_id")

    @cached_property
    def items(self) -> DataFrame:
        """Transcript items: one per turn, separated by text-dependent gaps."""
        return self.table("conversations").selectExpr(
            "conv_id AS video_id", "turn AS item_id", "turn * 4000 AS start_ms",
            "turn * 4000 + 4000 - length(text) % 1500 AS end_ms", "text", "turn div 4 AS unit_id",
            "'neutral' AS emotion", "'speech' AS audio_event", "'conversation' AS source")

    @cached_property
    def tracks(self) -> DataFrame:
        return self.table("embeddings").selectExpr(
            "vec_id % 10 AS video_id", "vec_id div 10 AS track_idx", "(vec_id div 10) * 1000 AS start_ms",
            "(vec_id div 10) * 1000 + 500 + (vec_id * 37) % 4000 AS end_ms", "(vec_id div 10) * 1000 + 250 AS best_ms",
            "((vec_id * 7) % 11) / 10.0D AS quality", "1 + vec_id % 5 AS detections", "CAST(label AS BIGINT) AS label",
            "embedding")

    @cached_property
    def unit_counts(self) -> DataFrame:
        c = self.table("conversations").groupBy(F.col("conv_id").alias("video_id")).agg(F.count("*").alias("n"))
        v = self.frames.groupBy("video_id").agg(F.count("*").alias("n"))
        t = self.tracks.groupBy("video_id").agg(F.count("*").alias("n"))
        return (c.selectExpr("video_id", "'asr' AS modality", "n")
                .unionByName(c.selectExpr("video_id", "'speaker' AS modality", "n"))
                .unionByName(v.selectExpr("video_id", "'visual' AS modality", "n"))
                .unionByName(t.selectExpr("video_id", "'face' AS modality", "n"))
                .selectExpr("video_id", "modality", "concat(modality, '-', video_id % 3) AS asset_version", "n AS rows"))

    @cached_property
    def pointers(self) -> DataFrame:
        """One pointer per (video, channel): some disabled, some with a wrong count, some stale."""
        return self.unit_counts.selectExpr(
            "video_id", "modality", "asset_version",
            "rows + CASE WHEN video_id % 11 = 10 THEN 1 ELSE 0 END AS row_count",
            "CASE WHEN video_id % 9 = 8 THEN 'disabled' ELSE 'ready' END AS status",
            "CASE WHEN modality = 'speaker' THEN concat('asr-', CASE WHEN video_id % 13 = 12 THEN 9 ELSE video_id % 3 END) END"
            " AS source_asr")

    @cached_property
    def overlays(self) -> DataFrame:
        return self.table("labels").selectExpr(
            "doc_id div 5 AS video_id", "doc_id % 5 AS utterance_idx",
            "CASE WHEN quality = 0 THEN NULL ELSE CAST(1 AS BIGINT) END AS corrected_track_id",
            "CAST(1 - toxic AS BIGINT) AS searchable")

    @cached_property
    def members(self) -> DataFrame:
        return self.table("supplier").where("s_suppkey % 4 <> 0").selectExpr(
            "s_suppkey AS video_id", "CAST(s_nationkey AS BIGINT) AS folder_id")

    @cached_property
    def entities(self) -> DataFrame:
        return self.table("part").groupBy(F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("entity_id"))

    @cached_property
    def mention_texts(self) -> DataFrame:
        return self.table("part").selectExpr(
            "p_partkey AS query_id", "concat('find ', lower(p_brand), ' near ', p_name) AS text")

    @cached_property
    def truth(self) -> DataFrame:
        return self.candidates.where("modality = 'visual'").selectExpr(
            "query_id", "video_id", "unit_id AS truth_id", "start_time - 0.5 AS t_start", "end_time + 0.5 AS t_end")


# name -> (views it needs, SQL)
CTES: dict[str, tuple[str, str]] = {
    "frames": ("", """SELECT vec_id, vec_id % 5 AS video_id, vec_id // 5 AS frame_idx, label,
        (vec_id // 5) * 200 AS timestamp_ms, ((vec_id // 5) * 200) // 5000 AS segment_id,
        ((vec_id // 5) * 200) // 5000 * 5000 AS segment_start_ms,
        ((vec_id // 5) * 200) // 5000 * 5000 + 5000 AS segment_end_ms, embedding::DOUBLE[] AS embedding FROM embeddings"""),
    "clips": ("frames", "SELECT * REPLACE (video_id + 5 * ((frame_idx + 5) // 10) AS video_id) FROM frames"),
    "qv": ("", """SELECT query_id, query_idx, list(m / n ORDER BY i) AS vec FROM (
        SELECT *, sqrt(sum(m * m) OVER (PARTITION BY query_id, query_idx)) AS n FROM (
          SELECT label AS query_id, vec_id % 3 AS query_idx, i, avg(x) AS m FROM (
            SELECT label, vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
          GROUP BY 1, 2, 3)) GROUP BY 1, 2"""),
    "qv1": ("", """SELECT query_id, 0 AS query_idx, list(m / n ORDER BY i) AS vec FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY query_id)) AS n FROM (
        SELECT label AS query_id, i, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
        GROUP BY 1, 2)) GROUP BY 1"""),
    "text_units": ("", """SELECT doc_id, source AS video_id, doc_id AS segment_idx, doc_id * 10000 AS start_ms,
        doc_id * 10000 + least(n_chars * 5, 9000) AS end_ms, text, lang, doc_id % 7 <> 0 AS has_embedding,
        CASE WHEN doc_id % 7 <> 0 THEN e.embedding::DOUBLE[] END AS embedding
        FROM documents JOIN embeddings e ON e.vec_id = doc_id % (SELECT count(*) FROM embeddings)"""),
    "text_queries": ("", """SELECT item_id AS query_id, text, e.embedding::DOUBLE[] AS vec FROM benchmark
        JOIN embeddings e ON e.vec_id = item_id % (SELECT count(*) FROM embeddings)"""),
    "candidates": ("", f"""SELECT event_id % 4 AS query_id, user_id AS video_id,
        CASE event_type WHEN 'click' THEN 'visual' WHEN 'view' THEN 'asr' WHEN 'purchase' THEN 'ocr' ELSE 'face' END AS modality,
        event_id AS unit_id, (epoch_us(ts) - {EPOCH_US}) / 3600000000.0::DOUBLE AS start_time,
        (epoch_us(ts) - {EPOCH_US}) / 3600000000.0::DOUBLE + 1 + value / 100 AS end_time,
        least(value / 517.3::DOUBLE, 1.0) AS score, least(value / 517.3::DOUBLE, 1.0) AS raw_score FROM events"""),
    "ia": ("candidates", """SELECT video_id, unit_id, start_time AS "start", end_time AS "end", score FROM candidates
        WHERE modality IN ('visual', 'asr')"""),
    "ib": ("candidates", """SELECT video_id, unit_id, start_time AS "start", end_time AS "end", score FROM candidates
        WHERE modality = 'ocr'"""),
    "utterances": ("", """SELECT conv_id AS video_id, turn AS utterance_idx, turn * 2000 AS start_ms, turn * 2000 + 1500 AS end_ms,
        turn AS asr_chunk_idx, text, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS track_id,
        e.embedding::DOUBLE[] AS embedding FROM conversations
        JOIN embeddings e ON e.vec_id = (conv_id * 8 + turn) % (SELECT count(*) FROM embeddings)"""),
    "items": ("", """SELECT conv_id AS video_id, turn AS item_id, turn * 4000 AS start_ms,
        turn * 4000 + 4000 - length(text) % 1500 AS end_ms, text, turn // 4 AS unit_id, 'neutral' AS emotion,
        'speech' AS audio_event, 'conversation' AS source FROM conversations"""),
    "tracks": ("", """SELECT vec_id % 10 AS video_id, vec_id // 10 AS track_idx, (vec_id // 10) * 1000 AS start_ms,
        (vec_id // 10) * 1000 + 500 + (vec_id * 37) % 4000 AS end_ms, (vec_id // 10) * 1000 + 250 AS best_ms,
        ((vec_id * 7) % 11) / 10.0::DOUBLE AS quality, 1 + vec_id % 5 AS detections, label,
        embedding::DOUBLE[] AS embedding FROM embeddings"""),
    "unit_counts": ("frames tracks", """SELECT video_id, modality, modality || '-' || (video_id % 3) AS asset_version, n AS "rows" FROM (
        SELECT conv_id AS video_id, 'asr' AS modality, count(*) AS n FROM conversations GROUP BY 1
        UNION ALL SELECT conv_id, 'speaker', count(*) FROM conversations GROUP BY 1
        UNION ALL SELECT video_id, 'visual', count(*) FROM frames GROUP BY 1
        UNION ALL SELECT video_id, 'face', count(*) FROM tracks GROUP BY 1)"""),
    "pointers": ("unit_counts", """SELECT video_id, modality, asset_version,
        "rows" + CASE WHEN video_id % 11 = 10 THEN 1 ELSE 0 END AS row_count,
        CASE WHEN video_id % 9 = 8 THEN 'disabled' ELSE 'ready' END AS status,
        CASE WHEN modality = 'speaker' THEN 'asr-' || (CASE WHEN video_id % 13 = 12 THEN 9 ELSE video_id % 3 END) END
        AS source_asr FROM unit_counts"""),
    "overlays": ("", """SELECT doc_id // 5 AS video_id, doc_id % 5 AS utterance_idx,
        CASE WHEN quality = 0 THEN NULL ELSE 1 END AS corrected_track_id, 1 - toxic AS searchable FROM labels"""),
    "members": ("", "SELECT s_suppkey AS video_id, s_nationkey AS folder_id FROM supplier WHERE s_suppkey % 4 <> 0"),
    "entities": ("", "SELECT p_brand AS name, min(p_partkey) AS entity_id FROM part GROUP BY 1"),
    "mention_texts": ("", "SELECT p_partkey AS query_id, 'find ' || lower(p_brand) || ' near ' || p_name AS text FROM part"),
    "truth": ("candidates", """SELECT query_id, video_id, unit_id AS truth_id, start_time - 0.5 AS t_start, end_time + 0.5 AS t_end
        FROM candidates WHERE modality = 'visual'"""),
}


def with_views(sql: str, views: str) -> str:
    """Prefix ``sql`` with the named views and everything they need."""
    ordered: list[str] = []

    def add(name: str):
        if name in ordered:
            return
        for dep in CTES[name][0].split():
            add(dep)
        ordered.append(name)

    for name in views.split():
        add(name)
    if not ordered:
        return sql
    ctes = ", ".join(f"{n} AS ({CTES[n][1]})" for n in ordered)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
