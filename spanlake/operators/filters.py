"""Row predicates and query-table guards."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import CHANNELS
from ..functions.vector import valid_vector
from .skew import top_k


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def resolve_scope(videos: DataFrame, members: DataFrame, video_ids: DataFrame | None = None,
                  folder_ids: DataFrame | None = None, include_default: bool = False,
                  folders: DataFrame | None = None) -> DataFrame:
    """Distinct video ids in scope. No selector at all means every video; an empty selector means none.

    ``folders`` lists the folders that exist: a requested one outside it is an error.
    """
    if video_ids is None and folder_ids is None and not include_default:
        return videos.select("video_id").distinct()
    parts = []
    if video_ids is not None:
        parts.append(video_ids.select("video_id"))
    if folder_ids is not None:
        wanted = folder_ids.select("folder_id").distinct()
        if folders is not None:
            known = folders.select("folder_id").distinct().withColumn("__known", F.lit(True))
            wanted = wanted.join(known, "folder_id", "left").where(F.coalesce(
                F.col("__known"), F.raise_error(F.concat(F.lit("unknown folder "), F.col("folder_id").cast("string"))).cast("boolean"))
            ).drop("__known")
        parts.append(members.join(wanted, "folder_id", "left_semi").select("video_id"))
    if include_default:
        parts.append(videos.join(members, "video_id", "left_anti").select("video_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def ready_publications(pointers: DataFrame, strict: bool = False) -> DataFrame:
    ok = (F.col("status") == "ready") & (F.trim(F.coalesce("asset_version", F.lit(""))) != "")
    if strict:
        return pointers.where(F.when(ok, True).otherwise(
            F.raise_error(F.concat(F.lit("no ready publication for "), F.col("video_id").cast("string"))).cast("boolean")))
    return pointers.where(ok)


def indexed_flag(pointers: DataFrame) -> DataFrame:
    return pointers.withColumn("indexed", (F.col("status") == "ready") & (F.col("row_count") > 0))


def requested_channels(queries: DataFrame, indexed) -> Column:
    """Channels to run for one (query, video): requested, indexed, and with the input each one needs.

    ``queries`` has requested array<string>, has_text, has_image and has_face booleans;
    a null request means every channel. The face channel is driven by its vector alone.
    """
    wanted = F.coalesce(F.col("requested"), F.array(*[F.lit(c) for c in CHANNELS]))
    both = F.array_intersect(wanted, _c(indexed))
    return F.array_union(
        F.filter(both, lambda ch: F.when(ch == "visual", F.col("has_text") | F.col("has_image"))
                 .when(ch.isin("asr", "ocr"), F.col("has_text")).otherwise(F.lit(False))),
        F.when(F.col("has_face") & F.array_contains(_c(indexed), "face"), F.array(F.lit("face")))
        .otherwise(F.array().cast("array<string>")))


def available_channels(pointers: DataFrame, scope: DataFrame | None = None,
                       allowed=("visual", "face", "asr", "ocr")) -> DataFrame:
    """Channels with a ready pointer somewhere in scope. An empty scope gives none."""
    p = ready_publications(pointers)
    if scope is not None:
        p = p.join(scope.select("video_id"), "video_id", "left_semi")
    return p.where(F.col("modality").isin(*allowed)).select("modality").distinct()


def require_int(c) -> Column:
    """True for a present, finite, integral number."""
    v = _c(c).cast("double")
    return F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")) & (v == F.floor(v)), F.lit(False))


def require_nonneg_int(c) -> Column:
    return require_int(c) & F.coalesce(_c(c) >= 0, F.lit(False))


def require_time_window(df: DataFrame, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Keep rows with 0 <= start < end; a missing bound rejects the row."""
    return df.where((F.col(start) >= 0) & (F.col(start) < F.col(end)))


def dropped_time_rows(df: DataFrame, by: list[str], start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    ok = F.coalesce((F.col(start) >= 0) & (F.col(start) < F.col(end)), F.lit(False))
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(~ok).alias("dropped"))


def require_point_in_window(df: DataFrame, point: str, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    return df.where(F.col(point).between(F.col(start), F.col(end)))


def valid_visual_hits(df: DataFrame, cosine: str = "score") -> DataFrame:
    return df.where(
        (F.col("frame_idx") >= 0) & (F.col("segment_id") >= 0) & (F.col("segment_start_ms") >= 0)
        & (F.col("segment_end_ms") > F.col("segment_start_ms"))
        & F.col("timestamp_ms").between(F.col("segment_start_ms"), F.col("segment_end_ms"))
        & F.col(cosine).isNotNull() & ~F.isnan(cosine) & (F.abs(F.col(cosine)) < float("inf")))


def consistent_segments(df: DataFrame, by: list[str]) -> DataFrame:
    """Drop every row of a segment whose rows disagree about its bounds. A segment is a few seconds of
    frames, so one window over it is small and shares its shuffle with the aggregation that follows."""
    w = Window.partitionBy(*by)
    same = ((F.min("segment_start_ms").over(w) == F.max("segment_start_ms").over(w))
            & (F.min("segment_end_ms").over(w) == F.max("segment_end_ms").over(w)))
    return df.withColumn("__same", same).where("__same").drop("__same")


def has_embedding_filter(units: DataFrame) -> DataFrame:
    """Rows the dense leg may see; a missing flag counts as true."""
    if "has_embedding" not in units.columns:
        return units
    return units.where(F.coalesce("has_embedding", F.lit(True)))


def absolute_threshold(df: DataFrame, threshold: float, cosine: str = "raw_score") -> DataFrame:
    hit = F.col(cosine) >= threshold
    return df.withColumns({"above_threshold": hit, "decision": F.when(hit, "absolute_hit").otherwise("weak")})


# Fixed value: what is said of a candidate below its channel's threshold.
BELOW = " · 低于阈值"


def global_dynamic_threshold(cands: DataFrame, channels=("ocr", "asr"), floor: float = 0.10, ratio: float = 0.3) -> DataFrame:
    """Flag against max(floor, ratio * best score of the channel in the whole query); nothing is removed.

    The text of a flagged row (``detail``, where there is one) says so, once.
    """
    best = (cands.where(F.col("modality").isin(*channels)).groupBy("query_id", "modality")
            .agg(F.greatest(F.lit(floor), F.max("score") * ratio).alias("__t")))
    d = cands.join(best, ["query_id", "modality"], "left")
    flag = F.when(F.col("__t").isNotNull(), F.col("score") >= F.col("__t"))
    prev = F.col("above_threshold") if "above_threshold" in cands.columns else F.lit(True)
    d = d.withColumn("above_threshold", F.coalesce(flag, prev)).withColumn("threshold", F.col("__t"))
    if "detail" in cands.columns:
        text = F.coalesce("detail", F.lit(""))
        d = d.withColumn("detail", F.when(F.coalesce(flag, F.lit(True)) | F.contains(text, F.lit(BELOW)), F.col("detail")).otherwise(F.concat(text, F.lit(BELOW))))
    return d.drop("__t")


def utterance_visible(hits: DataFrame, overlays: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Drop utterances switched off by an override, and each query's own utterance."""
    key = ["video_id", "utterance_idx"]
    o = overlays.select(*key, F.col("searchable").alias("__s"))
    out = hits.join(o, key, "left").where(F.coalesce("__s", F.lit(1)) == 1).drop("__s")
    if exclude is not None:
        out = out.join(exclude, [c for c in ("query_id", *key) if c in exclude.columns], "left_anti")
    return out


def major_groups(groups: DataFrame, min_duration_ms: int = 3000, min_occurrences: int = 3, limit: int = 24) -> DataFrame:
    keep = groups.where((F.col("duration_ms") >= min_duration_ms) | (F.col("occurrence_count") >= min_occurrences))
    return top_k(keep, ["video_id"], [F.desc("importance"), F.asc("start_ms"), F.asc("group_idx")], limit)


def confidence_filter(moments: DataFrame, min_score: float, min_sources: int, k: int) -> DataFrame:
    passed = moments.where((F.col("score") >= min_score) & (F.col("source_count") >= min_sources))
    return top_k(passed, ["query_id"], [F.desc("score"), F.asc("moment_id")], k)


def normalize_channels(csv) -> Column:
    """Comma list to distinct lower-case channel names in order; an unknown name is an error."""
    names = F.filter(F.transform(F.split(_c(csv), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    unknown = F.array_except(names, F.array(*[F.lit(c) for c in CHANNELS]))
    return F.when(F.size(unknown) == 0, F.array_distinct(names)).otherwise(
        F.raise_error(F.concat(F.lit("unknown channels: "), F.array_join(unknown, ", "))).cast("array<string>"))


def clamp_limits(limit, candidate_limit, result_limit, top_n, frame_count, window_seconds) -> dict[str, Column]:
    """Consistent limits for one query row."""
    lim = F.greatest(F.lit(1), F.least(_c(limit), F.lit(100)))
    cand = F.greatest(F.lit(1), F.least(_c(candidate_limit), F.lit(300), lim * 3))
    return {
        "limit": lim,
        "candidate_limit": cand,
        "result_limit": F.least(_c(result_limit), cand),
        "rerank_top_n": F.least(_c(top_n), cand),
        "frame_count": F.when(_c(window_seconds) >= 9, F.greatest(_c(frame_count), F.lit(8))).otherwise(_c(frame_count)),
    }


def clamp_subqueries(subqueries, limit: int = 4) -> Column:
    kept = F.array_distinct(F.filter(F.transform(_c(subqueries), lambda x: F.trim(x)), lambda x: x != ""))
    return F.slice(kept, 1, limit)


def clamp_clip_bounds(start, end, duration, longest: float = 45.0, shortest: float = 0.25) -> Column:
    """Clip end: at most ``longest`` after start and within the video, at least ``shortest`` after start."""
    return F.greatest(_c(start) + shortest, F.least(_c(end), _c(start) + longest, _c(duration)))


def schema_contract(df: DataFrame, required: StructType) -> DataFrame:
    """Fail before any work when a required column is missing or has another type."""
    have = {f.name: f.dataType for f in df.schema}
    missing = [f.name for f in required if f.name not in have]
    wrong = [f.name for f in required if f.name in have and have[f.name] != f.dataType]
    if missing or wrong:
        raise ValueError(f"missing columns {missing}, wrong types {wrong}")
    return df


def vector_lookup(wanted: DataFrame, units: DataFrame, key: list[str]) -> DataFrame:
    """The vector of each wanted unit; a unit that does not exist is an error."""
    u = units.select(*key, F.col("embedding").alias("__e"))
    return wanted.join(u, key, "left").withColumn(
        "embedding", F.coalesce("__e", F.raise_error("no such unit").cast(units.schema["embedding"].dataType))).drop("__e")


def select_queries(queries: DataFrame, ids: DataFrame | None = None, first_n: int | None = None) -> DataFrame:
    """Exact ids in the given order (table of query_id, pos), or the first n queries."""
    if ids is None:
        ranked = queries.orderBy("query_id")
        return ranked if first_n is None else ranked.limit(first_n)
    found = ids.join(queries.withColumn("__found", F.lit(True)), "query_id", "left")
    return found.where(F.coalesce("__found", F.raise_error("unknown query id").cast("boolean"))).drop("__found").orderBy("pos")


def valid_vectors(df: DataFrame, col: str = "embedding", dim: int | None = None) -> DataFrame:
    return df.where(valid_vector(F.col(col), dim))


def meaningful_text(text, start, end) -> Column:
    """At least two letters or digits and a positive duration."""
    letters = F.regexp_replace(_c(text), r"[^\p{L}\p{N}]", "")
    return (F.length(letters) >= 2) & (_c(end) > _c(start))
