"""Readers: catalogue, published units, transcripts, ground truth, manifests."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.timing import parse_timecode
from ..operators.relations import join_published


def scan_catalog(videos: DataFrame, folders: DataFrame, members: DataFrame, pointers: DataFrame) -> DataFrame:
    """Videos with nested folders and a map of publications per channel.

    ``indexed`` is derived from the ready pointers, never from a stored list.
    """
    f = members.join(folders, "folder_id").groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("name", "folder_id"))).alias("folders"))
    p = pointers.groupBy("video_id").agg(
        F.map_from_entries(F.collect_list(F.struct("modality", F.struct("asset_version", "row_count", "status")))).alias("publications"),
        F.array_sort(F.collect_list(F.when(F.col("status") == "ready", F.col("modality")))).alias("indexed"))
    return videos.join(f, "video_id", "left").join(p, "video_id", "left").withColumns({
        "folders": F.coalesce("folders", F.array().cast("array<struct<name:string,folder_id:bigint>>")),
        "indexed": F.coalesce("indexed", F.array().cast("array<string>"))})


def scan_units(spark: SparkSession, path: str, pointers: DataFrame, cols: list[str]) -> DataFrame:
    """Every row of the published versions; only ``cols`` leave the files and only live partitions are read."""
    units = spark.read.parquet(path).select(*dict.fromkeys(["video_id", "asset_version", *cols]))
    return join_published(units, pointers)


def scan_version_counts(units: DataFrame) -> DataFrame:
    """Rows per (video, version); a blank version is an error."""
    blank = F.trim(F.coalesce("asset_version", F.lit(""))) == ""
    u = units.select("video_id", F.when(blank, F.raise_error("row without asset_version").cast("string")).otherwise(F.col("asset_version")).alias("asset_version"))
    return u.groupBy("video_id", "asset_version").agg(F.count("*").alias("rows"))


# --- transcripts ------------------------------------------------------------------------------

_SEGMENT = "struct<start_time:double,start:double,end_time:double,end:double,text:string>"


def parse_sidecar(files: DataFrame) -> DataFrame:
    """Timed text of whole sidecar files. ``files``: path, value.

    JSON (a list, or an object with ``segments``), SRT and VTT; blank texts are dropped.
    """
    is_json = F.lower("path").endswith(".json")
    obj = F.from_json("value", f"struct<segments:array<{_SEGMENT}>>")["segments"]
    lst = F.from_json("value", f"array<{_SEGMENT}>")
    j = files.where(is_json).select("path", F.posexplode(F.coalesce(obj, lst)).alias("pos", "s")).select(
        "path", "pos", F.coalesce("s.start_time", "s.start", F.lit(0.0)).alias("start_time"),
        F.coalesce("s.end_time", "s.end", F.lit(0.0)).alias("end_time"), strip(F.coalesce("s.text", F.lit(""))).alias("text"))
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r\n", "\n"), r"(?s)^WEBVTT.*?\n\n", "")
    blocks = files.where(~is_json).select("path", F.posexplode(F.split(strip(body), r"\n\s*\n")).alias("pos", "block"))
    lines = F.filter(F.transform(F.split("block", r"\n"), lambda x: strip(x)), lambda x: x != "")
    b = blocks.select("path", "pos", lines.alias("lines")).withColumn(
        "at", F.aggregate(F.transform("lines", lambda x, i: F.when(F.contains(x, F.lit("-->")), i)), F.lit(None).cast("int"), lambda a, i: F.coalesce(a, i)))
    b = b.where("at IS NOT NULL").withColumn("times", F.split(F.element_at("lines", F.col("at") + 1), "-->", 2))
    t = b.select("path", "pos", parse_timecode(F.col("times")[0]).alias("start_time"), parse_timecode(F.col("times")[1]).alias("end_time"),
                 strip(F.array_join(F.slice("lines", F.col("at") + 2, F.greatest(F.size("lines") - F.col("at") - 1, F.lit(0))), " ")).alias("text"))
    return j.unionByName(t).where("text <> '' AND start_time IS NOT NULL AND end_time IS NOT NULL")


def read_transcript_sidecar(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_sidecar(files)


def read_chunk_records(records: DataFrame) -> DataFrame:
    """Chunk rows with millisecond or second keys to items; missing ends equal the start, end >= start.

    ``records`` may have start_ms, end_ms, start_time, start, end_time, end, text, unit_id, emotion, audio_event.
    """
    def opt(name, kind="double"):
        return F.col(name).cast(kind) if name in records.columns else F.lit(None).cast(kind)

    def ms(seconds):
        return F.bround(seconds * 1000.0).cast("long")

    has_ms = opt("start_ms", "long").isNotNull()
    start = F.when(has_ms, opt("start_ms", "long")).otherwise(ms(F.coalesce(opt("start_time"), opt("start"), F.lit(0.0))))
    end_s = F.coalesce(opt("end_time"), opt("end"))
    end = F.when(has_ms, F.coalesce(F.nullif(opt("end_ms", "long"), F.lit(0)), start)).otherwise(
        F.when(end_s.isNull(), start).otherwise(ms(end_s)))
    keep = [c for c in records.columns if c not in ("start_ms", "end_ms", "start_time", "start", "end_time", "end", "text", "emotion", "audio_event")]
    return records.select(*keep, start.alias("start_ms"), F.greatest(start, end).alias("end_ms"), strip(F.coalesce("text", F.lit(""))).alias("text"),
                          strip(F.coalesce(opt("emotion", "string"), F.lit(""))).alias("emotion"),
                          strip(F.coalesce(opt("audio_event", "string"), opt("audio_events", "string"), F.lit(""))).alias("audio_event")).where("text <> ''")


# --- evaluation and manifests -----------------------------------------------------------------

TRUTH_SCHEMA = ("groups array<struct<semantic_query_id:string,query:string,category:string,"
                "records:array<struct<video_id:string,segments:array<struct<start_sec:double,end_sec:double>>>>>>")


def ground_truth_rows(groups: DataFrame) -> DataFrame:
    """One row per truth segment. ``groups``: semantic_query_id, query, category, records."""
    r = groups.select("semantic_query_id", "query", "category", F.explode("records").alias("r"))
    return r.select("semantic_query_id", "query", "category", F.col("r.video_id").alias("video_id"), F.posexplode("r.segments").alias("pos", "s")).select(
        "semantic_query_id", "query", "category", "video_id", "pos", F.col("s.start_sec").alias("start_sec"), F.col("s.end_sec").alias("end_sec"))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.schema(TRUTH_SCHEMA).json(path, multiLine=True)
    return ground_truth_rows(doc.select(F.explode("groups").alias("g")).select("g.*"))


def read_legacy_manifest(files: DataFrame) -> DataFrame:
    """Channel declarations of JSON manifests. ``files``: video_id, value."""
    m = F.from_json("value", "struct<channels:map<string,struct<asset_version:string,version:string,row_count:bigint,rows:bigint>>>")["channels"]
    return files.select("video_id", F.explode(m).alias("modality", "c")).select(
        "video_id", "modality", strip(F.coalesce("c.asset_version", "c.version", F.lit(""))).alias("version"), F.coalesce("c.row_count", "c.rows").alias("declared"))
