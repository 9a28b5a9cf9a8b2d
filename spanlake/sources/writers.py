"""Writers: validated unit rows, key upserts, deletes, and snapshot tables.

A unit row is checked in the same pass that writes it: a broken contract fails
the job, so an incomplete version is never published.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TEXT_MAX_BYTES, TEXT_MAX_CHARS
from ..functions.keys import unit_pk
from ..functions.text import truncate_text_utf8
from ..functions.vector import valid_vector
from ..operators.aggregates import frame_text_agg
from ..operators.skew import carry


def checked(df: DataFrame, rules: dict[str, Column], where: Column | None = None) -> DataFrame:
    """Rows unchanged; the first row that breaks a rule fails the job and names the rule."""
    broken = reduce(lambda acc, item: acc.when(~F.coalesce(item[1], F.lit(False)), F.lit(item[0])), list(rules.items())[1:],
                    F.when(~F.coalesce(next(iter(rules.values())), F.lit(False)), F.lit(next(iter(rules)))))
    guard = F.when(broken.isNull(), F.lit(True)).otherwise(F.raise_error(broken).cast("boolean"))
    return df.where(guard)


def visual_units(frames: DataFrame, model: str, dim: int, width: float = 600_000.0) -> DataFrame:
    """Frame rows of one writer attempt, with their contract checked.

    Segments must be ordered and disjoint, each frame inside its own: half-open,
    except that the video's last segment includes its end.
    """
    seg = frames.groupBy("video_id", "asset_version", "segment_id").agg(
        F.min("segment_start_ms").alias("s"), F.max("segment_end_ms").alias("e"),
        ((F.min("segment_start_ms") == F.max("segment_start_ms")) & (F.min("segment_end_ms") == F.max("segment_end_ms"))).alias("one"))
    seg = carry(seg, ["video_id", "asset_version"], [F.col("s"), F.col("segment_id")], width, max_before={"__pe": F.col("e"), "__ps": F.col("segment_id")})
    last = seg.groupBy("video_id", "asset_version").agg(F.max_by("segment_id", "s").alias("__last"))
    seg = checked(seg, {"segment bounds differ": F.col("one"), "segment is empty": F.col("e") > F.col("s"),
                        "segments overlap": F.coalesce(F.col("s") >= F.col("__pe"), F.lit(True)),
                        "segments out of order": F.coalesce(F.col("segment_id") > F.col("__ps"), F.lit(True))})
    d = frames.join(seg.select("video_id", "asset_version", "segment_id"), ["video_id", "asset_version", "segment_id"]).join(last, ["video_id", "asset_version"])
    inside = (F.col("timestamp_ms") >= F.col("segment_start_ms")) & (
        (F.col("timestamp_ms") < F.col("segment_end_ms")) | ((F.col("segment_id") == F.col("__last")) & (F.col("timestamp_ms") == F.col("segment_end_ms"))))
    d = checked(d, {"frame outside its segment": inside, "bad vector": valid_vector("embedding", dim), "negative frame": F.col("frame_idx") >= 0})
    return d.drop("__last").withColumn("pk", unit_pk("visual", "video_id", "asset_version", F.lit(model), "frame_idx"))


def asr_units(chunks: DataFrame, embeddings: DataFrame, model: str, dim: int) -> DataFrame:
    """Chunk rows; a chunk without a vector gets the zero vector and has_embedding = false."""
    e = embeddings.select("video_id", F.col("chunk_idx").alias("segment_idx"), "embedding")
    d = chunks.join(e, ["video_id", "segment_idx"], "left")
    return d.withColumns({
        "has_embedding": F.col("embedding").isNotNull(),
        "embedding": F.coalesce(F.col("embedding").cast("array<float>"), F.array_repeat(F.lit(0.0), dim).cast("array<float>")),
        "text": truncate_text_utf8("text", TEXT_MAX_CHARS, TEXT_MAX_BYTES),
        "pk": unit_pk("asr", "video_id", "asset_version", F.lit(model), "segment_idx")})


def ocr_units(frames: DataFrame, boxes: DataFrame, embeddings: DataFrame, model: str, dim: int) -> DataFrame:
    """Screen-text rows: joined text and mean confidence of each frame's non-blank boxes.

    ``frames``: video_id, asset_version, frame_idx, frame_ms, start_ms, end_ms; ``boxes``: video_id, frame_idx, pos, text, score.
    """
    t = frame_text_agg(boxes, ["video_id", "frame_idx"], "pos")
    e = embeddings.select("video_id", "frame_idx", "embedding")
    d = frames.join(t, ["video_id", "frame_idx"]).join(e, ["video_id", "frame_idx"], "left")
    return d.withColumns({
        "has_embedding": F.col("embedding").isNotNull(),
        "embedding": F.coalesce(F.col("embedding").cast("array<float>"), F.array_repeat(F.lit(0.0), dim).cast("array<float>")),
        "text": truncate_text_utf8("text", TEXT_MAX_CHARS, TEXT_MAX_BYTES), "region_idx": F.lit(0).cast("long"),
        "pk": unit_pk("ocr", "video_id", "asset_version", F.lit(model), "frame_idx", F.lit(0))})


def face_units(tracks: DataFrame, model: str, dim: int) -> DataFrame:
    d = checked(tracks, {"bad track window": (F.col("start_ms") >= 0) & (F.col("end_ms") > F.col("start_ms")),
                         "best outside window": F.col("best_ms").between(F.col("start_ms"), F.col("end_ms")), "bad vector": valid_vector("embedding", dim)})
    return d.withColumn("pk", unit_pk("face", "video_id", "asset_version", F.lit(model), "track_idx"))


def face_groups(groups: DataFrame, model: str, dim: int) -> DataFrame:
    """Identity group rows. ``bbox`` is a struct of four values: all -1 (unknown) or a proper box inside [0, 1]."""
    b = F.col("bbox")
    unknown = (b["x1"] == -1) & (b["y1"] == -1) & (b["x2"] == -1) & (b["y2"] == -1)
    proper = (b["x1"] >= 0) & (b["y1"] >= 0) & (b["x2"] <= 1) & (b["y2"] <= 1) & (b["x2"] > b["x1"]) & (b["y2"] > b["y1"])
    d = checked(groups, {"bad vector": valid_vector("embedding", dim), "duration must be positive": F.col("duration_ms") > 0,
                         "occurrences must be positive": F.col("occurrence_count") > 0, "quality outside [0, 1]": F.col("quality").between(0, 1),
                         "bad box": unknown | proper, "bad importance": ~F.isnan("importance")})
    return d.withColumn("pk", unit_pk("face_group", "video_id", "asset_version", F.lit(model), "group_idx"))


def speaker_units(utterances: DataFrame, model: str, dim: int) -> DataFrame:
    d = checked(utterances, {"bad utterance window": (F.col("start_ms") >= 0) & (F.col("end_ms") > F.col("start_ms")),
                             "utterance without chunk": F.col("asr_chunk_idx") >= 0, "bad vector": valid_vector("embedding", dim)})
    return d.withColumn("pk", unit_pk("speaker", "video_id", "asset_version", F.lit(model), "utterance_idx"))


def write_units(units: DataFrame, path: str) -> None:
    """One folder per version; rewriting a version replaces only that version."""
    units.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("asset_version").parquet(path)


# --- upserts and deletes: old table and changes in, new table out -------------------------------

def upsert_latest(stored: DataFrame, incoming: DataFrame, key: list[str], attempt: str) -> DataFrame:
    """One row per key, the one of the latest attempt."""
    cols = [c for c in stored.columns if c not in key]
    both = stored.unionByName(incoming)
    g = both.groupBy(*key).agg(F.max_by(F.struct(*cols), attempt).alias("__r"))
    return g.select(*key, *[F.col(f"__r.{c}").alias(c) for c in cols])


BUCKET = "key_bucket"


def _staged_batch(spark: SparkSession, path: str) -> int | None:
    try:
        return spark.read.schema("batch long").json(path).agg(F.max("batch")).first()[0]
    except Exception as error:  # nothing staged yet
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def upsert_buckets(batch: DataFrame, path: str, key: list[str], attempt: str, batch_id: int, buckets: int = 64) -> None:
    """Merge a batch into a Parquet table partitioned by key bucket; only buckets with a key of the batch are read and written.

    The merged buckets are written aside first and marked with the batch's number, then they replace
    the table's partitions (dynamic overwrite). A batch that is run again after a failure finds them
    staged and only repeats the replacement, so a partition lost halfway comes back whole. One writer
    at a time; ``buckets`` belongs to the table and must not change. An empty batch writes nothing.
    """
    spark = batch.sparkSession
    staged, mark = f"{path}-staged/rows", f"{path}-staged/mark"
    if _staged_batch(spark, mark) != batch_id:
        newest = upsert_latest(batch.limit(0), batch, key, attempt).withColumn(BUCKET, F.pmod(F.hash(*key), F.lit(buckets)))
        touched = [r[0] for r in newest.select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return
        try:
            stored = spark.read.schema(newest.schema).parquet(path).where(F.col(BUCKET).isin(touched))
            newest = upsert_latest(stored, newest, [*key, BUCKET], attempt)
        except Exception as error:  # the first batch
            if "PATH_NOT_FOUND" not in str(error):
                raise
        newest.repartition(BUCKET).write.mode("overwrite").parquet(staged)
        spark.range(1).select(F.lit(batch_id).cast("long").alias("batch")).coalesce(1).write.mode("overwrite").json(mark)
    rows = spark.read.parquet(staged)
    rows.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table written by ``upsert_buckets``."""
    return spark.read.parquet(path).drop(BUCKET)


def delete_where(units: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    """(remaining rows, deleted rows per video). Rows with an undecided predicate stay."""
    g = F.coalesce(gone, F.lit(False))
    return units.where(~g), units.where(g).groupBy("video_id").agg(F.count("*").alias("deleted"))


def delete_video(units: DataFrame, video_id):
    return delete_where(units, F.col("video_id") == video_id)


def delete_version(units: DataFrame, video_id, version):
    return delete_where(units, (F.col("video_id") == video_id) & (F.col("asset_version") == version))


def delete_modality(units: DataFrame, video_id, modality):
    return delete_where(units, (F.col("video_id") == video_id) & (F.col("modality") == modality))


def keep_only_version(units: DataFrame, video_id, modality, version):
    return delete_where(units, (F.col("video_id") == video_id) & (F.col("modality") == modality) & (F.col("asset_version") != version))


def delete_entity_samples(samples: DataFrame, entities: DataFrame) -> DataFrame:
    return samples.join(entities.select("entity_id").distinct(), "entity_id", "left_anti")


def replace_samples(samples: DataFrame, seen: DataFrame, new: DataFrame) -> DataFrame:
    """Swap each entity's samples for its new one; only keys listed in ``seen`` at the start go away,
    so a sample added meanwhile survives."""
    old = seen.select("pk").join(new.select("pk"), "pk", "left_anti")
    kept = samples.join(old, "pk", "left_anti")
    return kept.join(new.select("pk"), "pk", "left_anti").unionByName(new.select(*samples.columns))


def append_trace(traces: DataFrame, path: str) -> None:
    traces.write.mode("append").json(path)


def id_pairs(left: DataFrame, right: DataFrame, side: int = 16) -> DataFrame:
    """Every row of ``left`` with every row of ``right``, for results that are this product by definition.

    Rows are dealt to a grid of ``side`` x ``side`` cells, each side repeated ``side`` times, and meet in an
    equi-join on the cell; so neither side has to fit into a task or passes through the driver.
    """
    cells = F.sequence(F.lit(0), F.lit(side - 1))
    a = left.withColumn("__row", F.pmod(F.hash(*left.columns), F.lit(side))).withColumn("__col", F.explode(cells))
    b = right.withColumn("__col", F.pmod(F.hash(*right.columns), F.lit(side))).withColumn("__row", F.explode(cells))
    return a.join(b, ["__row", "__col"]).drop("__row", "__col")


def membership_update(members: DataFrame, videos: DataFrame, folders: DataFrame, picked_videos: DataFrame, picked_folders: DataFrame,
                      operation: str) -> DataFrame:
    """Memberships after adding, removing or replacing folders of a set of videos; unknown ids are errors."""
    if operation not in ("add", "remove", "replace"):
        raise ValueError(f"unknown operation {operation}")

    def known(ids, table, col):
        k = table.select(col).distinct().withColumn("__k", F.lit(True))
        return ids.select(col).distinct().join(k, col, "left").where(F.coalesce("__k", F.raise_error(f"unknown {col}").cast("boolean"))).drop("__k")

    pv, pf = known(picked_videos, videos, "video_id"), known(picked_folders, folders, "folder_id")
    if operation == "remove":
        hit = members.join(pv, "video_id", "left_semi").join(pf, "folder_id", "left_semi")
        return members.join(hit, ["video_id", "folder_id"], "left_anti")
    pairs = id_pairs(pv, pf)
    base = members if operation == "add" else members.join(pv, "video_id", "left_anti")
    return base.select("video_id", "folder_id").unionByName(pairs.select("video_id", "folder_id")).distinct()


def delete_folder(members: DataFrame, folders: DataFrame, folder: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folder and its memberships go, its videos stay."""
    return members.join(folder, "folder_id", "left_anti"), folders.join(folder, "folder_id", "left_anti")


def speaker_overlay_upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Speaker labels: a new name or representative wins when given, the hidden flag always."""
    key = ["video_id", "track_id"]
    n = new.select(*key, *[F.col(c).alias(f"n_{c}") for c in ("display_name", "representative", "hidden")], F.lit(True).alias("__new"))
    j = stored.join(n, key, "full_outer")
    return j.select(*key, F.coalesce("n_display_name", "display_name").alias("display_name"),
                    F.coalesce("n_representative", "representative").alias("representative"),
                    F.when(F.col("__new"), F.coalesce("n_hidden", F.lit(0))).otherwise(F.col("hidden")).alias("hidden"))


def binding_upsert(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Last write wins on the key."""
    return stored.join(new.select(*key), key, "left_anti").unionByName(new.select(*stored.columns))


def cascade_delete(gone: DataFrame, key: str, *tables: DataFrame) -> list[DataFrame]:
    ids = gone.select(key).distinct()
    return [t.join(ids, key, "left_anti") for t in tables]


class SnapshotTable:
    """A small table with whole-snapshot commits on plain files.

    A commit writes ``v=<n>`` and then appends one row naming it to the log.
    Spark commits that append as a whole, so a reader sees the old snapshot or the
    new one, never a mixture. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def version(self) -> int | None:
        try:
            log = self.spark.read.schema("version long").json(f"{self.path}/log")
            return log.agg(F.max("version")).first()[0]
        except Exception as error:  # no log yet: an empty table
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise

    def read(self) -> DataFrame:
        v = self.version()
        if v is None:
            raise FileNotFoundError(f"{self.path} has no snapshot")
        return self.spark.read.parquet(f"{self.path}/v={v}")

    def commit(self, df: DataFrame) -> int:
        v = (self.version() or 0) + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v={v}")
        self.spark.range(1).select(F.lit(v).cast("long").alias("version")).coalesce(1).write.mode("append").json(f"{self.path}/log")
        return v


