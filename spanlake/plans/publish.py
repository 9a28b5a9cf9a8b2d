"""Publication jobs: pointer switches, verification, imports, repairs, promotion, rebuilds.

Pointers: video_id, modality, asset_version, row_count, status, source_asr. A job
computes the next pointer table; ``SnapshotTable`` makes it visible in one commit.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CHANNELS
from ..functions.keys import make_pk, sample_id, stable_version
from ..functions.timing import fixed_bucket
from ..operators.aggregates import contiguity_check, table_fingerprint, version_select, visual_health
from ..operators.filters import ready_publications
from ..operators.identity import identity_groups
from ..operators.relations import pointer_reconcile, staging_target_diff
from ..session import cut_lineage
from ..sources.writers import checked

KEY = ["video_id", "modality"]
VALUES = ["asset_version", "row_count", "status", "source_asr"]


def publish(pointers: DataFrame, updates: DataFrame, disable: DataFrame | None = None, videos: DataFrame | None = None) -> DataFrame:
    """Next pointer table: ``updates`` replace, ``disable`` (video_id, modality) switches existing rows off.

    One bad update (unknown channel or status, blank version, negative count, a channel twice, a channel
    both published and disabled, an unknown video) fails the whole batch.
    """
    u = checked(updates.select(*KEY, *VALUES), {
        "unknown channel": F.col("modality").isin(*CHANNELS), "blank asset_version": F.trim("asset_version") != "",
        "negative row_count": F.col("row_count") >= 0, "unknown status": F.col("status").isin("ready", "disabled")})
    g = u.groupBy(*KEY).agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in VALUES])
    g = checked(g, {"channel published twice": F.col("__n") == 1}).drop("__n")
    if videos is not None:
        g = g.join(videos.select("video_id", F.lit(True).alias("__known")), "video_id", "left")
        g = checked(g, {"unknown video": F.col("__known").isNotNull()}).drop("__known")
    off = pointers.select(*KEY).limit(0).withColumn("__off", F.lit(True)) if disable is None else disable.select(*KEY).distinct().withColumn("__off", F.lit(True))
    new = g.select(*KEY, *[F.col(c).alias(f"n_{c}") for c in VALUES], F.lit(True).alias("__new"))
    j = pointers.select(*KEY, *VALUES).join(new, KEY, "full_outer").join(off, KEY, "left")
    j = checked(j, {"published and disabled at once": F.col("__new").isNull() | F.col("__off").isNull()})
    fresh = F.col("__new").isNotNull()
    cols = [F.when(fresh, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in VALUES]
    out = j.select(*KEY, *cols, "__off")
    return out.withColumn("status", F.when(F.col("__off").isNotNull(), "disabled").otherwise(F.col("status"))).drop("__off")


def visible_channels(pointers: DataFrame, videos: DataFrame) -> DataFrame:
    """The channels each video shows: always derived from its ready pointers."""
    g = pointers.where("status = 'ready'").groupBy("video_id").agg(F.array_sort(F.collect_set("modality")).alias("indexed"))
    return videos.select("video_id").join(g, "video_id", "left").withColumn("indexed", F.coalesce("indexed", F.array().cast("array<string>")))


def verify_write(expected: DataFrame, counts: DataFrame) -> DataFrame:
    """Stored rows against written rows per (video, channel, version). ``expected``: ..., row_count; ``counts``: ..., rows."""
    key = [*KEY, "asset_version"]
    j = expected.select(*key, "row_count").join(counts.select(*key, "rows"), key, "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return j.withColumn("verified", F.col("rows") == F.col("row_count"))


def publish_dependents(updates: DataFrame, pointers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(updates, disable): speech published without speakers switches the old speaker pointer off;
    published together they must belong together."""
    asr = updates.where("modality = 'asr'").select("video_id", F.col("asset_version").alias("__asr"))
    speaker = updates.where("modality = 'speaker'").select("video_id")
    j = updates.join(asr, "video_id", "left")
    j = checked(j, {"speaker built from another speech version": (F.col("modality") != "speaker") | F.col("__asr").isNull() | (F.col("source_asr") == F.col("__asr"))})
    orphan = asr.select("video_id").join(speaker, "video_id", "left_anti").withColumn("modality", F.lit("speaker"))
    return j.drop("__asr").select(*updates.columns), orphan.join(pointers.select(*KEY), KEY, "left_semi")


def import_publications(counts: DataFrame, manifest: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Pointers for tables that have none: pick each channel's version, check its rows, publish.

    Visual versions with broken bounds come out disabled and marked ``requires_rebuild``.
    """
    chosen = version_select(counts, manifest)
    good = chosen.where(F.col("asset_version").isNotNull())
    if frames is not None:
        h = visual_health(frames).select("video_id", "asset_version", ((F.col("invalid_rows") > 0) | (F.col("conflicting_segments") > 0)).alias("__bad"))
        good = good.join(h, ["video_id", "asset_version"], "left")
        bad = (F.col("modality") == "visual") & F.coalesce("__bad", F.lit(False))
    else:
        bad = F.lit(False)
    return good.select(*KEY, "asset_version", F.col("rows").alias("row_count"), F.when(bad, "disabled").otherwise("ready").alias("status"),
                       F.lit(None).cast("string").alias("source_asr"), bad.alias("requires_rebuild"), "verdict")


# The namespace every repaired version id is derived in (any fixed UUID serves).
VERSION_NAMESPACE = "6ba7b8129dad11d180b400c04fd430c8"


def repair_time_bounds(frames: DataFrame, durations: DataFrame, pointers: DataFrame, segment_ms: int) -> tuple[DataFrame, DataFrame]:
    """(repaired rows, report): the published frames copied to a new version with computed fixed bounds.

    A video is repaired whole or not at all: every frame must lie in the video and in the segment its time
    says, and the row count must be the published one. The version id depends on the inputs only, so a
    repeated run writes the same rows. A frame at the very end belongs to the last segment.
    """
    ready = ready_publications(pointers.where("modality = 'visual'")).select("video_id", "asset_version", "row_count")
    d = frames.join(ready, ["video_id", "asset_version"]).join(durations.select("video_id", "duration_ms"), "video_id")
    ts, dur = F.col("timestamp_ms"), F.col("duration_ms")
    want = fixed_bucket("timestamp_ms", "duration_ms", segment_ms)
    plain = F.floor(ts / segment_ms).cast("long")
    seg_ok = (F.col("segment_id") == want) | ((ts == dur) & (F.col("segment_id") == plain))
    ok = F.coalesce((ts >= 0) & (ts <= dur) & (F.col("frame_idx") >= 0) & seg_ok, F.lit(False))
    per = d.groupBy("video_id", "asset_version", "row_count").agg(F.count("*").alias("rows"), F.count_if(~ok).alias("bad_rows"),
                                                                  F.count_distinct("frame_idx").alias("__frames"))
    report = per.withColumn("status", F.when(F.col("bad_rows") > 0, "rejected_rows").when(F.col("rows") != F.col("row_count"), "row_count_mismatch")
                            .when(F.col("__frames") != F.col("rows"), "repeated_frames").otherwise("repaired")).drop("__frames", "row_count")
    version = stable_version(VERSION_NAMESPACE, F.lit("fixed-bounds"), "video_id", "asset_version", F.lit(segment_ms))
    fine = report.where("status = 'repaired'").select("video_id", "asset_version", version.alias("__v"))
    fixed = d.join(fine, ["video_id", "asset_version"]).withColumns({"segment_id": want, "asset_version": F.col("__v")}).withColumns({
        "segment_start_ms": F.col("segment_id") * segment_ms, "segment_end_ms": F.least((F.col("segment_id") + 1) * segment_ms, dur)})
    return fixed.drop("__v", "row_count", "duration_ms"), report.withColumn("target_version", F.when(F.col("status") == "repaired", version))


def promote_staging(staging: DataFrame, target: DataFrame, baseline: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next target pointers, report). A video moves only when each of its staged channels is verified and
    none conflicts; a video already current stays."""
    diff = staging_target_diff(staging, target, baseline)
    real = verify_write(staging.where("status = 'ready'"), counts).select(*KEY, "verified")
    j = diff.where("verdict <> 'target_only'").join(real, KEY, "left")
    report = j.groupBy("video_id").agg(
        F.bool_or(F.col("verdict") == "conflict").alias("conflict"), F.bool_and(F.coalesce("verified", F.lit(False))).alias("verified"),
        F.bool_and(F.col("verdict") == "already_current").alias("current"))
    report = report.select("video_id", F.when(F.col("conflict"), "conflict").when(~F.col("verified"), "unverified")
                           .when(F.col("current"), "already_current").otherwise("promoted").alias("outcome"))
    moving = report.where("outcome = 'promoted'").select("video_id")
    updates = staging.where("status = 'ready'").join(moving, "video_id", "left_semi")
    return publish(target, updates), report


def copy_verified(df: DataFrame, path: str, cols: list[str]) -> DataFrame:
    """Copy a table and compare fingerprints of source and copy per version; columns ``same`` and ``rows``."""
    df.write.mode("overwrite").parquet(path)
    there = df.sparkSession.read.parquet(path)
    a = table_fingerprint(df, cols, ["asset_version"])
    b = table_fingerprint(there, cols, ["asset_version"])
    words = [c for c in a.columns if c not in ("asset_version", "rows")]
    j = a.join(b.select("asset_version", F.struct("rows", *words).alias("copy")), "asset_version", "full_outer")
    return j.select("asset_version", "rows", F.coalesce(F.struct("rows", *words) == F.col("copy"), F.lit(False)).alias("same"))


def rebuild_groups(tracks: DataFrame, pointers: DataFrame, cos: float = 0.52) -> tuple[DataFrame, DataFrame]:
    """(groups, report): identity groups derived again from the published tracks of each video.

    A video counts as rebuilt when its tracks are complete (0..n-1, n as published) and its groups are numbered without gaps.
    """
    live = ready_publications(pointers.where("modality = 'face'"))
    t = tracks.join(live.select("video_id", "asset_version"), ["video_id", "asset_version"], "left_semi")
    whole = contiguity_check(t, ["video_id"], "track_idx", live)
    ok = whole.where("contiguous").select("video_id")
    groups = cut_lineage(identity_groups(t.join(ok, "video_id", "left_semi"), cos=cos))
    version = f"identity-groups:cosine={cos:.3f}"
    check = contiguity_check(groups, ["video_id"], "group_idx").select("video_id", F.col("n").alias("groups"), F.col("contiguous").alias("__g"))
    report = whole.join(check, "video_id", "left").select(
        "video_id", F.col("n").alias("tracks"), F.coalesce("groups", F.lit(0)).alias("groups"),
        F.when(~F.col("contiguous"), "incomplete_tracks").when(F.col("__g"), "rebuilt").otherwise("bad_groups").alias("status"))
    return groups.withColumn("group_version", F.lit(version)), report


def migrate_entity_samples(entities: DataFrame, samples: DataFrame, vectors: DataFrame, replace: bool = False) -> DataFrame:
    """Next sample table: a sample for every entity that lacks a usable one (or for all, with ``replace``).

    ``samples``: entity_id, pk, embedding; ``vectors``: entity_id, source, embedding. The key depends on
    entity and source alone, so a repeated run changes nothing.
    """
    from ..functions.vector import valid_vector
    usable = samples.where(valid_vector("embedding")).select("entity_id").distinct()
    todo = entities.select("entity_id") if replace else entities.select("entity_id").join(usable, "entity_id", "left_anti")
    new = vectors.join(todo, "entity_id", "left_semi").where(valid_vector("embedding"))
    new = new.select("entity_id", make_pk(F.lit("entity_face"), "entity_id", sample_id("entity_id", "source")).alias("pk"), "embedding")
    gone = new.select("entity_id").distinct()
    return samples.join(gone, "entity_id", "left_anti").unionByName(new)


def verify_publications(pointers: DataFrame, counts: DataFrame) -> DataFrame:
    """Pointer against rows per channel, summed up."""
    return pointer_reconcile(pointers, counts).groupBy("modality", "verdict").agg(F.count("*").alias("n"))


# Order in which the channels of a video are rebuilt. Speakers follow speech, so a
# selected speech rebuild already covers them.
REBUILD_ORDER = ("visual", "face", "asr", "speaker", "ocr")


def rebuild_order(selected: list[str]) -> list[str]:
    unknown = set(selected) - set(REBUILD_ORDER)
    if unknown:
        raise ValueError(f"unknown channels: {sorted(unknown)}")
    return [c for c in REBUILD_ORDER if c in selected and not (c == "speaker" and "asr" in selected)]
