"""Equi-joins, lookups and set operations over units, pointers, folders and overlays."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import casefold
from .filters import ready_publications
from .skew import top_k


def join_published(units: DataFrame, pointers: DataFrame) -> DataFrame:
    """Only the unit rows of each video's ready version."""
    ready = ready_publications(pointers).select("video_id", "asset_version")
    return units.join(ready, ["video_id", "asset_version"], "left_semi")


def folder_counts(folders: DataFrame, members: DataFrame, videos: DataFrame) -> DataFrame:
    """Videos per folder, and a last row for videos in no folder."""
    named = folders.join(members.groupBy("folder_id").agg(F.count("*").alias("n")), "folder_id", "left").select(
        "folder_id", "name", F.coalesce("n", F.lit(0)).alias("n"))
    rest = videos.join(members, "video_id", "left_anti").agg(F.count("*").alias("n")).select(
        F.lit(-1).cast("long").alias("folder_id"), F.lit("default").alias("name"), "n")
    return named.unionByName(rest)


def entity_voice_counts(entities: DataFrame, samples: DataFrame) -> DataFrame:
    n = samples.groupBy("entity_id").agg(F.count("*").alias("n"))
    return entities.join(n, "entity_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


#: Letters of the runs that texts and names meet on.
RUN = 3


def entity_mention(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """Longest entity name found in each text, ignoring case; no row without one.

    Texts and names meet on short runs of letters: a text lists its distinct runs of RUN letters (and of fewer, where a name is
    shorter), a name only the one of its runs that the fewest texts have. So a text of n letters is shuffled as RUN * n short rows at most,
    however many lengths the names have; a name with a run that no text has meets none. Whoever meets is compared in full.
    Files tell little of how large texts are in memory, so neither they nor their runs are broadcast.
    """
    names = entities.select("entity_id", "name", casefold("name").alias("__s")).where("__s <> ''")
    sizes = sorted(names.agg(F.collect_set(F.least(F.length("__s"), F.lit(RUN)))).first()[0])  # three numbers at most
    t = texts.select("query_id", casefold("text").alias("__t"))

    def runs(c, size):
        return F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda i: F.substring(c, i, size))

    every = [F.when(F.length("__t") >= n, runs("__t", F.lit(n))).otherwise(F.array().cast("array<string>")) for n in sizes]
    listed = t.select("query_id", F.explode(F.array_distinct(F.concat(*every))).alias("__r")) if sizes else t.select("query_id", F.lit("").alias("__r")).limit(0)
    n_texts = listed.groupBy("__r").agg(F.count("*").alias("__df")).hint("merge")
    own = names.select("entity_id", "name", "__s", F.explode(F.array_distinct(runs("__s", F.least(F.length("__s"), F.lit(RUN))))).alias("__r")).join(n_texts, "__r", "left")
    rarest = own.groupBy("entity_id", "name", "__s").agg(F.min_by("__r", F.struct("__df", "__r")).alias("__r"), F.count_if(F.col("__df").isNull()).alias("__none"))
    rarest = rarest.where("__none = 0").drop("__none")
    few = listed.join(rarest.select("__r").distinct(), "__r", "left_semi")
    met = few.hint("merge").join(rarest, "__r").select("query_id", "entity_id", "name", "__s")
    hits = met.hint("merge").join(t.hint("merge"), "query_id").where(F.contains("__t", F.col("__s")))
    return top_k(hits, ["query_id"], [F.desc(F.length("name")), F.asc("name"), F.asc("entity_id")], 1).select("query_id", "entity_id", "name")


def identity_bindings(bindings: DataFrame, entities: DataFrame, groups: DataFrame) -> DataFrame:
    """Bindings that belong to the published group version, with entity names."""
    key = ["video_id", "asset_version", "group_version"]
    return bindings.join(groups.select(*key), key, "left_semi").join(entities.select("entity_id", "name"), "entity_id")


def join_overlays(utterances: DataFrame, overlays: DataFrame) -> DataFrame:
    """Effective speaker of each utterance. An override row with a null track means "unassigned"."""
    key = ["video_id", "utterance_idx"]
    o = overlays.select(*key, F.col("corrected_track_id").alias("__t"), "searchable", F.lit(True).alias("__present"))
    return utterances.join(o, key, "left").withColumns({
        "track_id": F.when(F.coalesce("__present", F.lit(False)), F.col("__t")).otherwise(F.col("track_id")),
        "searchable": F.coalesce("searchable", F.lit(1)),
    }).drop("__t", "__present")


def speaker_text_join(utterances: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk text of each utterance; an utterance pointing at no chunk is an error."""
    c = chunks.select("video_id", F.col("segment_idx").alias("asr_chunk_idx"), F.col("text").alias("chunk_text"))
    j = utterances.join(c, ["video_id", "asr_chunk_idx"], "left")
    return j.withColumn("chunk_text", F.coalesce("chunk_text", F.raise_error("utterance without its text chunk").cast("string")))


def speaker_asr_version_check(pointers: DataFrame) -> DataFrame:
    """Speaker pointers against the speech version they were built from."""
    speaker = pointers.where("modality = 'speaker'").select("video_id", "source_asr")
    asr = ready_publications(pointers.where("modality = 'asr'")).select("video_id", F.col("asset_version").alias("current_asr"))
    return speaker.join(asr, "video_id", "left").withColumn(
        "valid", F.coalesce(F.col("source_asr") == F.col("current_asr"), F.lit(False)))


def voice_sample_clips(samples: DataFrame, utterances: DataFrame) -> DataFrame:
    u = utterances.select("video_id", "utterance_idx", "start_ms", "end_ms", "text")
    return samples.join(u, ["video_id", "utterance_idx"], "left")


def hybrid_join(dense: DataFrame, sparse: DataFrame, key: list[str], w_dense: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """Weighted sum of both legs; a leg that did not return the unit contributes 0. ``keep``: columns that both legs carry."""
    d = dense.select(*key, *keep, F.col("score").alias("dense"))
    s = sparse.select(*key, *[F.col(c).alias(f"__{c}") for c in keep], F.col("score").alias("lexical"))
    j = d.join(s, key, "full_outer").withColumns({c: F.coalesce(c, f"__{c}") for c in keep}).drop(*[f"__{c}" for c in keep])
    score = F.coalesce("dense", F.lit(0.0)) * w_dense + F.coalesce("lexical", F.lit(0.0)) * (1 - w_dense)
    hit = (F.when(F.col("dense").isNotNull() & F.col("lexical").isNotNull(), "semantic_lexical_hit")
           .when(F.col("dense").isNotNull(), "semantic_hit").otherwise("lexical_hit"))
    return j.withColumns({"score": score, "decision": hit})


def rerank_join(candidates: DataFrame, scores: DataFrame, key: list[str], weight: float) -> DataFrame:
    """Blend supplied rerank scores; a candidate without one keeps its score."""
    s = scores.select(*key, "rerank_score")
    r = F.col("rerank_score")
    return candidates.join(s, key, "left").withColumn(
        "final_score", F.when(r.isNull(), F.col("score")).otherwise(r * weight + F.col("score") * (1 - weight)))


def pointer_reconcile(pointers: DataFrame, counts: DataFrame) -> DataFrame:
    """Pointers against stored rows. ``counts``: video_id, modality, asset_version, rows."""
    key = ["video_id", "modality", "asset_version"]
    j = pointers.select(*key, "row_count", "status").join(counts.select(*key, "rows"), key, "full_outer")
    verdict = (F.when(F.col("row_count").isNull(), "missing_pointer").when(F.col("status") != "ready", "not_ready")
               .when(F.coalesce("rows", F.lit(0)) != F.col("row_count"), "row_count_mismatch").otherwise("ok"))
    return j.withColumn("verdict", verdict)


def missing_publications(videos: DataFrame, pointers: DataFrame, modality: str, requested: DataFrame | None = None) -> DataFrame:
    """Videos without a ready pointer for the channel, and requested ids the catalogue lacks."""
    ready = ready_publications(pointers.where(F.col("modality") == modality))
    pool = videos if requested is None else videos.join(requested, "video_id", "left_semi")
    out = pool.select("video_id").join(ready, "video_id", "left_anti").withColumn("reason", F.lit("no_ready_pointer"))
    if requested is not None:
        unknown = requested.select("video_id").join(videos, "video_id", "left_anti").withColumn("reason", F.lit("unknown_video"))
        out = out.unionByName(unknown)
    return out


def signature(status: str = "status"):
    return F.sha2(F.concat_ws("\0", "modality", "asset_version", F.col("row_count").cast("string"), status,
                              F.coalesce("source_asr", F.lit(""))), 256)


def staging_target_diff(staging: DataFrame, target: DataFrame, baseline: DataFrame) -> DataFrame:
    """What promotion would do per (video, channel): the target must still be at ``baseline`` or already current."""
    key = ["video_id", "modality"]

    def sig(df, name):
        return df.select(*key, signature().alias(name))

    j = sig(staging.where("status = 'ready'"), "s").join(sig(target, "t"), key, "full_outer").join(sig(baseline, "b"), key, "left")
    verdict = (F.when(F.col("s").isNull(), "target_only").when(F.col("s") == F.col("t"), "already_current")
               .when(F.col("t").isNull() | (F.col("t") == F.col("b")), "ready").otherwise("conflict"))
    return j.select(*key, verdict.alias("verdict"))


# --- set operations ---------------------------------------------------------------------------

def union_distinct_ordered(*lists: DataFrame) -> DataFrame:
    """Distinct ids of several (id, pos) lists in order of first appearance."""
    parts = [d.select("id", F.struct(F.lit(i).alias("list"), F.col("pos")).alias("at")) for i, d in enumerate(lists)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id").agg(F.min("at").alias("at")).select("id", F.col("at.list").alias("list"), F.col("at.pos").alias("pos"))


def intersect_channels(requested, available):
    return F.array_intersect(requested, available)


def rank_delta(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    added = after.select(*key).exceptAll(before.select(*key)).withColumn("change", F.lit("added"))
    removed = before.select(*key).exceptAll(after.select(*key)).withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def topk_jaccard(left: DataFrame, right: DataFrame, by: list[str], key: str, queries: DataFrame | None = None) -> DataFrame:
    """|A & B| / |A | B| per query; two empty lists count as 1 (for queries named in ``queries``)."""
    both = left.select(*by, key).distinct().withColumn("l", F.lit(1)).join(
        right.select(*by, key).distinct().withColumn("r", F.lit(1)), [*by, key], "full_outer")
    out = both.groupBy(*by).agg((F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()) / F.count("*")).alias("jaccard"))
    if queries is None:
        return out
    return queries.select(*by).join(out, by, "left").withColumn("jaccard", F.coalesce("jaccard", F.lit(1.0)))


def union_candidates(*channels: DataFrame) -> DataFrame:
    out = channels[0]
    for c in channels[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def dedupe_evidence(evidence: DataFrame, by: list[str], order: str) -> DataFrame:
    """First row of every (modality, detail, best_time) per moment."""
    cols = [c for c in evidence.columns if c not in (*by, "modality", "detail", "best_time")]
    d = evidence.groupBy(*by, "modality", "detail", "best_time").agg(F.min_by(F.struct(*cols), order).alias("__r"))
    return d.select(*by, "modality", "detail", "best_time", *[F.col(f"__r.{c}").alias(c) for c in cols])
