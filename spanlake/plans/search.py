"""Channel searches and the moment search built from them. Every function takes a table of queries."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SearchProfile
from ..functions.text import snippet
from ..functions.timing import ms_to_s
from ..functions.vector import face_confidence, l2_normalize, visual_confidence
from ..operators.aggregates import frame_multiquery_agg, segment_topn_mean
from ..operators.filters import (absolute_threshold, consistent_segments, global_dynamic_threshold, has_embedding_filter, require_time_window,
                                 valid_visual_hits)
from ..operators.identity import resolve_entity_vector
from ..operators.knn import best_groups, knn_join
from ..operators.lexical import bm25_search
from ..operators.postings import search_postings
from ..operators.moments import fuse_results, group_moments
from ..operators.relations import hybrid_join, union_candidates
from ..operators.skew import top_k
from ..session import cut_lineage

FRAME = ["segment_id", "frame_idx", "timestamp_ms", "segment_start_ms", "segment_end_ms"]


def dense_search(queries: DataFrame, frames: DataFrame, ann_k: int = 500, seg_n: int = 3, limit: int = 100, recall: bool = False,
                 within: DataFrame | None = None) -> DataFrame:
    """Visual channel: best frames per (sub-query, video), invalid ones dropped *before* aggregation, then
    frame and segment scores, best ``limit`` segments per (query, video) (500 in the recall profile).

    ``queries``: query_id, query_idx, vec. ``within``: the (query_id, video_id) pairs to search, where not all.
    """
    q = queries.withColumn("vec", l2_normalize("vec", keep_below=1e-8))
    hits = valid_visual_hits(knn_join(q, frames, ann_k, keep=tuple(FRAME), tie=("frame_idx",), within=within))
    hits = consistent_segments(hits, ["query_id", "video_id", "segment_id"])
    n = queries.where("vec IS NOT NULL").groupBy("query_id").agg(F.count("*").alias("n"))
    seg = segment_topn_mean(frame_multiquery_agg(hits, n, ["video_id", *FRAME]), ["query_id", "video_id", "segment_id"], seg_n)
    top = top_k(seg, ["query_id", "video_id"], [F.desc("score"), F.asc("segment_id")], 500 if recall else limit)
    return top.select(
        "query_id", "video_id", F.lit("visual").alias("modality"), F.col("segment_id").alias("unit_id"),
        ms_to_s("start_ms").alias("start_time"), ms_to_s("end_ms").alias("end_time"), visual_confidence(F.col("score")).alias("score"),
        F.col("score").alias("raw_score"), "best_ms", F.lit(True).alias("above_threshold"), F.lit("hit").alias("decision"), "frame_count")


def dense_text_search(queries: DataFrame, units: DataFrame, k: int = 100, unit: str = "segment_idx") -> DataFrame:
    """Dense leg: inner product over rows that have a vector. ``queries``: query_id, vec."""
    return knn_join(queries, has_embedding_filter(units), k, query_keys=("query_id",), keep=(unit,), metric="ip")


SHOWN = ("start_ms", "end_ms", "__head")  # what a result shows travels with its leg: the units are not read again


def indexed_units(units: DataFrame) -> DataFrame:
    """Units with the columns that a stored index for :func:`hybrid_search` keeps: ``(unit, *SHOWN)``."""
    return units.withColumn("__head", F.substring("text", 1, 100))


def _legs(queries, units, k, unit, index, shown):
    """Both legs; a query without text or without a vector takes part in one leg only."""
    units = indexed_units(units)
    dense = knn_join(queries.where("vec IS NOT NULL"), has_embedding_filter(units), k, query_keys=("query_id",), keep=(unit, *shown), tie=(unit,), metric="ip")
    asked = queries.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    lexical = search_postings(asked, index, k, keep=(unit, *shown)) if index else bm25_search(asked, units, k, keep=(unit, *shown))
    return dense, lexical


def hybrid_search(queries: DataFrame, units: DataFrame, w_dense: float, k: int = 100, limit: int = 100, modality: str = "asr",
                  unit: str = "segment_idx", normalize: str | None = None, index: str | None = None, detail: bool = True) -> DataFrame:
    """Dense and BM25 legs of ``k`` each, weighted sum, best ``limit`` per (query, video), then time checks.

    With one input missing the other leg's plain score stands. The weighted sum is of raw scores
    (``normalize="atan"`` maps each leg to 0..1 first). ``units``: video_id, unit, start_ms, end_ms, text, embedding.
    ``index``: path of a stored index of the same units (see ``indexed_units``); the BM25 leg then reads no text.
    Without ``detail`` the results have no such column, and no piece of a text is shuffled.
    """
    if normalize not in (None, "atan"):
        raise ValueError("normalize must be None or 'atan'")
    shown = SHOWN if detail else SHOWN[:2]
    dense, lexical = _legs(queries, units, k, unit, index, shown)
    if normalize:
        squash = F.atan("score") * (2 / 3.141592653589793)
        dense, lexical = dense.withColumn("score", squash), lexical.withColumn("score", squash)
    mode = queries.select("query_id", F.col("vec").isNotNull().alias("__v"), (F.trim(F.coalesce("text", F.lit(""))) != "").alias("__t"))
    j = hybrid_join(dense, lexical, ["query_id", "video_id", unit], w_dense, shown).join(mode, "query_id")
    j = j.withColumn("score", F.when(~F.col("__t"), F.col("dense")).when(~F.col("__v"), F.col("lexical")).otherwise(F.col("score")))
    top = top_k(j, ["query_id", "video_id"], [F.desc("score"), F.asc(unit)], limit)
    rows = require_time_window(top)
    return rows.select(
        "query_id", "video_id", F.lit(modality).alias("modality"), F.col(unit).alias("unit_id"), ms_to_s("start_ms").alias("start_time"),
        ms_to_s("end_ms").alias("end_time"), "score", F.col("score").alias("raw_score"), F.col("start_ms").alias("best_ms"),
        F.lit(True).alias("above_threshold"), "decision", *([snippet(f"{modality}_hybrid", "__head", "score", "hybrid").alias("detail")] if detail else []))


def _vector_channel(queries, units, modality, unit, threshold, limit, best, score):
    hits = knn_join(queries, units, limit, query_keys=("query_id",), keep=(unit, "start_ms", "end_ms", best), tie=(unit,))
    # the limit comes first: an invalid row uses up its place
    hits = require_time_window(hits).where(F.col(best).between(F.col("start_ms"), F.col("end_ms")))
    c = hits.select("query_id", "video_id", F.lit(modality).alias("modality"), F.col(unit).alias("unit_id"), ms_to_s("start_ms").alias("start_time"),
                    ms_to_s("end_ms").alias("end_time"), score.alias("score"), F.col("score").alias("raw_score"), F.col(best).alias("best_ms"))
    return absolute_threshold(c, threshold)


def face_search(queries: DataFrame, tracks: DataFrame, threshold: float = 0.35, limit: int = 100) -> DataFrame:
    return _vector_channel(queries, tracks, "face", "track_idx", threshold, limit, "best_ms", face_confidence(F.col("score")))


def speaker_search(queries: DataFrame, utterances: DataFrame, threshold: float = 0.50, limit: int = 100) -> DataFrame:
    u = utterances.withColumn("__best", F.col("start_ms"))
    return _vector_channel(queries, u, "speaker", "utterance_idx", threshold, limit, "__best", F.col("score"))


def rerank_blend(results: DataFrame, scores: DataFrame, durations: DataFrame, *, top_n: int = 20, weight: float = 0.8, window: float = 2.0,
                 limit: int = 500) -> DataFrame:
    """First ``top_n`` results blended with supplied scores (window widened for the scorer), the rest kept,
    all reordered. ``results``: query_id, video_id, rank, start_time, end_time, score; ``scores``: query_id, rank, rerank_score."""
    from ..functions.timing import expand_window
    r = results.withColumnRenamed("rank", "original_rank")
    s = scores.select("query_id", F.col("rank").alias("original_rank"), "rerank_score")
    j = r.join(s, ["query_id", "original_rank"], "left").join(durations.select("video_id", "duration"), "video_id", "left")
    used = (F.col("original_rank") <= top_n) & F.col("rerank_score").isNotNull()
    ws, we = expand_window("start_time", "end_time", "duration", window)
    first = F.col("original_rank") <= top_n
    j = j.withColumns({
        "final_score": F.when(used, F.round(weight * F.col("rerank_score") + (1 - weight) * F.col("score"), 6)).otherwise(F.col("score")),
        "verify_start": F.when(first, ws), "verify_end": F.when(first, we)})
    return top_k(j, ["query_id"], [F.desc("final_score"), F.asc("original_rank")], limit, rank="final_rank")


PAIR = ["query_id", "video_id"]
SLACK = 1e-9  # rounding between a frame's cosine and the mean that a segment makes of it


def _frame_bound(cosines):
    """What ``frame_multiquery_agg`` can give a frame at most: a sub-query that misses the frame counts as 0."""
    least = np.fmax(cosines, 0.0)  # also where a cosine is not a number
    return 0.65 * least.mean(axis=0) + 0.35 * least.min(axis=0)


def _moments(cands: DataFrame, p: SearchProfile, primary: str | None, limit: int) -> DataFrame:
    """Threshold flags, grouping and fusion of the candidates of every channel."""
    cands = global_dynamic_threshold(cands, floor=p.dynamic_floor, ratio=p.dynamic_ratio)
    # grouping passes its rows through Python, so only what fusion reads goes in
    cands = cands.select("query_id", "video_id", "modality", "unit_id", "start_time", "end_time", "score", "raw_score", "best_ms", "above_threshold", "decision")
    return fuse_results(group_moments(cands, p.merge_gap, p.max_result_seconds), p.weights, primary, limit)


def _visual_that_can_enter(q: DataFrame, frames: DataFrame, rest: DataFrame | None, p: SearchProfile, primary: str | None, limit: int, channel_limit: int) -> DataFrame:
    """Visual candidates of every (query, video) that can have one of the query's ``limit`` best results.

    A result's score is a weighted mean of its channels' best, so no result of a pair is above the best score that any
    channel has there, and no segment is above its best frame. The ``limit`` videos with the best frames are searched
    first; their ``limit``-th result with the visual channel is the query's bar, and only pairs that have a frame, or
    another channel's candidate, at the bar are searched after them. All visual results outrank the others, so what the
    pairs left out would have can neither enter nor move what does. A query with fewer results than ``limit`` has no
    bar: all its pairs are searched. Equal scores reach the bar, so ties are decided over the same rows as ever.
    A frame has one row, as in every unit table.
    """
    q = cut_lineage(q)
    recall = p.name == "recall"

    def search(pairs):
        return dense_search(q, frames, p.ann_k, p.segment_top_n, channel_limit, recall, within=pairs)

    unit = q.withColumn("vec", l2_normalize("vec", keep_below=1e-8))
    first = cut_lineage(best_groups(unit, frames, limit, combine=_frame_bound).select(*PAIR))
    found = cut_lineage(search(first))
    theirs = found if rest is None else union_candidates(found, rest.join(first, PAIR, "left_semi"))
    results = _moments(theirs, p, primary, limit).where(F.array_contains("modalities", "visual"))
    bar = results.groupBy("query_id").agg(F.count("score").alias("n"), F.min("score").alias("bar")).where(F.col("n") >= limit).select("query_id", "bar")
    bar = cut_lineage(bar)
    # the bound of a frame is never below 0: a bar of cosine 0 or less holds nothing back
    cosine = 2 * F.col("bar") - 1 - SLACK
    asked = unit.join(bar, "query_id", "left").withColumn("__bar", F.when(cosine > 0, cosine))
    more = best_groups(asked, frames, floor="__bar", combine=_frame_bound).select(*PAIR)
    if rest is not None:
        at_bar = rest.groupBy(*PAIR).agg(F.max("score").alias("best")).join(bar, "query_id", "left")
        more = more.union(at_bar.where(F.col("bar").isNull() | (F.col("best") >= F.col("bar") - SLACK)).select(*PAIR))
    more = cut_lineage(more.distinct().join(first, PAIR, "left_anti"))
    return found.unionByName(search(more))


def moment_search(queries: DataFrame, units: dict[str, DataFrame], profile: SearchProfile | None = None, *, scope: DataFrame | None = None,
                  pointers: DataFrame | None = None, primary: str | None = "visual", limit: int | None = None,
                  entities: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Ranked moments for a table of queries over every channel supplied.

    ``queries``: query_id, query_idx, and any of vec (visual), text, text_vec, face_vec, channels; one row per
    visual sub-query, with the other inputs on the row query_idx = 0. ``channels`` (array) names the channels a
    query asks for, null all; the face channel follows its vector alone. ``units``: channel -> unit table.
    ``scope``: allowed video ids (an empty table means none). ``pointers``: only published versions.
    ``entities``: (entities, face samples); a query without a face vector whose text names an entity searches
    for its mean sample. ``primary``: results that have this channel come first, where the query asks for it.

    Where there are more videos than results are asked for, and visual results come first or there is no other
    channel, the visual channel searches only the videos that can still enter a query's results; the rows are the same.
    """
    from ..operators.relations import join_published
    p = (profile or SearchProfile()).checked()
    limit = limit or p.result_limit
    channel_limit = min(300, 3 * limit)
    have = set(queries.columns)
    first = queries.where("query_idx = 0")

    def asking(rows, channel):
        if "channels" not in have:
            return rows
        wants = first.where(F.col("channels").isNull() | F.array_contains("channels", channel)).select("query_id")
        return rows.join(wants, "query_id", "left_semi")

    def live(channel):
        u = units[channel]
        if pointers is not None:
            u = join_published(u, pointers.where(F.col("modality") == channel))
        return u if scope is None else u.join(scope.select("video_id").distinct(), "video_id", "left_semi")

    text_q = first.select("query_id", "text" if "text" in have else F.lit(None).cast("string").alias("text"),
                          F.col("text_vec").alias("vec") if "text_vec" in have else F.lit(None).cast("array<double>").alias("vec"))
    parts = []
    for channel, w in (("asr", p.asr_dense_weight), ("ocr", p.ocr_dense_weight)):
        if channel in units and have & {"text", "text_vec"}:
            parts.append(hybrid_search(asking(text_q, channel), live(channel), w, p.text_k, channel_limit, channel, detail=False))
    if "face" in units and ("face_vec" in have or entities is not None):
        faces = first.select("query_id", F.col("face_vec").alias("vec") if "face_vec" in have else F.lit(None).cast("array<double>").alias("vec"))
        if entities is not None:
            named = resolve_entity_vector(text_q.where("text IS NOT NULL"), *entities).select("query_id", F.col("vec").alias("__named"))
            faces = faces.join(named, "query_id", "left").select("query_id", F.coalesce(F.col("vec").cast("array<double>"), "__named").alias("vec"))
        parts.append(face_search(faces, live("face"), p.face_threshold, channel_limit))
    visual = "visual" in units and "vec" in have
    if not parts and not visual:
        raise ValueError("no channel has both units and a query input")
    # the threshold reads the candidates twice; they are few after the limits, the searches are not
    rest = cut_lineage(union_candidates(*parts)) if parts else None
    best = 500 if p.name == "recall" else limit
    if not visual:
        return _moments(rest, p, primary, best)
    q, frames = asking(queries.select("query_id", "query_idx", "vec"), "visual"), live("visual")
    outranks = rest is None or primary == "visual"
    if outranks and frames.select("video_id").distinct().limit(best + 1).count() > best:
        seen = _visual_that_can_enter(q, frames, rest, p, primary, best, channel_limit)
    else:
        seen = dense_search(q, frames, p.ann_k, p.segment_top_n, channel_limit, p.name == "recall")
    seen = cut_lineage(seen)
    return _moments(union_candidates(seen) if rest is None else union_candidates(seen, rest), p, primary, best)
