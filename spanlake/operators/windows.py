"""Window-shaped operators, orderings and top-k."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import dot, l2_normalize
from .skew import carry, group_stats, number_rows, top_k

STRONG_END = r"[.!?。！？]$"
STRONG_MARK = "[.!?。！？]"


def topk_per_video_channel(cands: DataFrame, limit: int, order: list[str] | None = None) -> DataFrame:
    """Best ``limit`` candidates of every (query, video, channel)."""
    return top_k(cands, ["query_id", "video_id", "modality"], [F.desc("score"), *[F.asc(c) for c in (order or ["unit_id"])]], limit)


def rrf_rank(results: DataFrame, by: list[str], order: list[Column], limit: int, weight: float = 1.0, k: int = 60) -> DataFrame:
    """Reciprocal-rank contribution of a step's first ``limit`` results."""
    return top_k(results, by, order, limit).withColumn("contribution", F.lit(weight) / (F.lit(float(k)) + F.col("rank")))


def minmax_per_step(results: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Scale to 0..1 inside each group; a flat group of one gives 1, a flat larger one 0."""
    d = group_stats(results, by, __lo=F.min(score), __hi=F.max(score), __n=F.count("*"))
    lo, hi = F.col("__lo"), F.col("__hi")
    flat = F.abs(hi - lo) <= F.greatest(F.abs(hi), F.abs(lo)) * 1e-9
    norm = F.when(flat, F.when(F.col("__n") == 1, 1.0).otherwise(0.0)).otherwise((F.col(score) - lo) / (hi - lo))
    return d.withColumn("norm", norm).drop("__lo", "__hi", "__n")


def max_scale(results: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Score divided by the page's best; 0 when that is not positive."""
    d = group_stats(results, by, __hi=F.max(score))
    return d.withColumn("scaled", F.when(F.col("__hi") > 0, F.col(score) / F.col("__hi")).otherwise(0.0)).drop("__hi")


def split_long(segments: DataFrame, max_ms: int, min_ms: int) -> DataFrame:
    """Cut segments longer than ``max_ms``; a rest below ``min_ms`` stays with the piece before it."""
    length = F.col("end_ms") - F.col("start_ms")
    # pieces of max_ms while more than max_ms remains; the last cut is dropped when its rest is short
    cuts = F.greatest(F.lit(0), F.ceil(length / F.lit(max_ms)).cast("long") - 1)
    cuts = F.when((cuts > 0) & (length - cuts * max_ms < min_ms), cuts - 1).otherwise(cuts)
    d = segments.withColumn("__n", cuts).withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n"))))
    start = F.col("start_ms") + F.col("__i") * max_ms
    end = F.when(F.col("__i") == F.col("__n"), F.col("end_ms")).otherwise(start + max_ms)
    keep = [c for c in segments.columns if c not in ("start_ms", "end_ms")]
    return d.select(*keep, start.alias("start_ms"), end.alias("end_ms"))


def fill_gaps(segments: DataFrame, durations: DataFrame, by: list[str], min_ms: int, max_ms: int, width: float = 600_000.0) -> DataFrame:
    """Segments that cover 0..duration exactly: clamped, holes filled, overlaps cut, short ones merged
    into the previous (a short first one into the next), long ones split.

    Everything is a running maximum (the cursor) and a running count (merge groups).
    """
    s = segments.select(*by, "start_ms", "end_ms").join(durations.select(*by, "duration_ms"), by)
    dur = F.col("duration_ms")
    s = s.withColumns({"start_ms": F.greatest(F.lit(0), F.least(dur, F.col("start_ms"))),
                       "end_ms": F.greatest(F.lit(0), F.least(dur, F.col("end_ms")))}).where("end_ms > start_ms").distinct()
    # the end of the video takes part as an empty segment, so the last hole is found like the others
    tail = durations.where("duration_ms > 0").select(*by, F.col("duration_ms").alias("start_ms"), F.col("duration_ms").alias("end_ms"), "duration_ms")
    s = carry(s.unionByName(tail), by, [F.col("start_ms"), F.col("end_ms")], width, max_before={"__cur": F.col("end_ms")})
    cur = F.coalesce("__cur", F.lit(0))
    pieces = s.select(*by, F.explode(F.array(
        F.struct(cur.alias("start_ms"), F.col("start_ms").alias("end_ms")),
        F.struct(F.greatest(F.col("start_ms"), cur).alias("start_ms"), F.col("end_ms")))).alias("p")).select(*by, "p.*").where("end_ms > start_ms")
    order = [F.col("start_ms"), F.col("end_ms")]
    long_enough = F.col("end_ms") - F.col("start_ms") >= min_ms
    d = carry(pieces, by, order, width, sum_upto={"__g": long_enough.cast("long")})
    # group 0: pieces before the first long one; they form one segment, merged into the next when short
    d = d.groupBy(*by, "__g").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    short_head = d.where("__g = 0").where(F.col("end_ms") - F.col("start_ms") < min_ms).select(*by, F.lit(True).alias("__short"))
    d = d.join(short_head, by, "left").withColumn("__g", F.when(F.coalesce("__short", F.lit(False)) & (F.col("__g") == 0), 1).otherwise(F.col("__g")))
    d = d.groupBy(*by, "__g").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("__g")
    return split_long(d, max_ms, min_ms)


def fixed_segments(videos: DataFrame, segment_ms: int, max_bucket: str | None = None) -> DataFrame:
    """Tumbling segments [i*w, (i+1)*w) clipped to the duration, at least up to ``max_bucket``."""
    dur = F.col("duration_ms")
    n = F.greatest(F.lit(1), F.ceil(F.greatest(dur, F.lit(0)) / F.lit(segment_ms)).cast("long"))
    if max_bucket is not None:
        n = F.greatest(n, F.col(max_bucket) + 1)
    limit = F.when(dur > 0, dur).otherwise(n * segment_ms)
    d = videos.withColumn("__n", n).withColumn("segment_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    return d.withColumns({"start_ms": F.col("segment_id") * segment_ms,
                          "end_ms": F.least((F.col("segment_id") + 1) * segment_ms, limit)}).drop("__n")


def timestamp_jumps(items: DataFrame, by: list[str], start: str, tie: str, limit_ms: int = 5000, width: float = 600_000.0) -> DataFrame:
    d = carry(items, by, [F.col(start), F.col(tie)], width, lag={"__p": F.col(start)})
    return d.groupBy(*by).agg(F.count_if(F.col(start) - F.col("__p") > limit_ms).alias("jumps"))


def adjacent_duplicates(rows: DataFrame, by: list[str], order: str, width: float = 1000.0) -> DataFrame:
    d = carry(rows.withColumn("__t", F.lower(F.trim("text"))), by, [F.col(order)], width, lag={"__p": F.col("__t")})
    return d.groupBy(*by).agg(F.count_if((F.col("__t") != "") & (F.col("__t") == F.col("__p"))).alias("duplicates"))


def _unpunctuated(rows: DataFrame, by: list[str], tie: str, width: float) -> DataFrame:
    order = [F.col("start_time"), F.col("end_time"), F.col(tie)]
    closed = F.trim("text").rlike(STRONG_END).cast("long")
    # a span runs up to and including the row that closes it: count the terminators on earlier rows
    d = carry(rows, by, order, width, sum_upto={"__n": closed})
    d = d.withColumn("__n", F.col("__n") - closed)
    d = d.withColumn("__at", F.struct(*order))
    # current end minus the span's first start, at every row of the span
    g = d.groupBy(*by, "__n").agg(F.min_by("start_time", "__at").alias("s"), F.max("end_time").alias("e"))
    return g.select(*by, (F.col("e") - F.col("s")).alias("span"))


def longest_unpunctuated_span(rows: DataFrame, by: list[str], tie: str, width: float = 600.0) -> DataFrame:
    """Longest stretch of a transcript without a sentence end."""
    return _unpunctuated(rows, by, tie, width).groupBy(*by).agg(F.greatest(F.lit(0.0), F.max("span")).alias("span"))


def quality_window_flags(rows: DataFrame, by: list[str], tie: str, span_limit: float = 12.0, row_limit: float = 15.0, width: float = 600.0) -> DataFrame:
    """Does a window need another decode: a long unpunctuated stretch, or a long row with under two sentence ends."""
    marks = F.regexp_count("text", F.lit(STRONG_MARK))
    poor = rows.groupBy(*by).agg(F.bool_or((F.col("end_time") - F.col("start_time") > row_limit) & (marks < 2)).alias("poor_row"))
    span = longest_unpunctuated_span(rows, by, tie, width)
    return span.join(poor, by).select(*by, ((F.col("span") > span_limit) | F.col("poor_row")).alias("retry"))


def renumber(df: DataFrame, by: list[str], order: list[Column], name: str = "idx", width: float = 600_000.0) -> DataFrame:
    return number_rows(df, by, order, width, name)


def rank_stability(left: DataFrame, right: DataFrame, by: list[str], key: str) -> DataFrame:
    """1 - mean rank shift / longest list over shared keys of two ranked lists; 0 when nothing is shared."""
    a, b = left.select(*by, key, F.col("rank").alias("ra")), right.select(*by, key, F.col("rank").alias("rb"))
    j = a.join(b, [*by, key], "full_outer")
    g = j.groupBy(*by).agg(F.avg(F.abs(F.col("ra") - F.col("rb"))).alias("shift"),
                           F.count("ra").alias("na"), F.count("rb").alias("nb"))
    longest = F.greatest(F.lit(1), F.greatest("na", "nb") - 1)
    return g.select(*by, F.when(F.col("shift").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("shift") / longest)).alias("stability"))


# --- orderings --------------------------------------------------------------------------------

RESULT_ORDER = ("above_threshold", "score", "start_time", "video_id", "end_time")


def result_order(primary: str | None = None) -> list[Column]:
    """Sort columns of results: threshold tier, [has the primary channel], score, [primary score], earliest."""
    tail = [F.asc("start_time"), F.asc("video_id"), F.asc("end_time")]
    if primary is None:
        return [F.desc("above_threshold"), F.desc("score"), *tail]
    own = F.col("best_by_modality")[primary]
    return [F.desc("above_threshold"), F.desc(own.isNotNull()), F.desc("score"), F.desc(F.coalesce(own, F.col("score"))), *tail]


def order_results(results: DataFrame, limit: int, primary: str | None = None, by=("query_id",)) -> DataFrame:
    return top_k(results, list(by), result_order(primary), limit)


def profile_cap(results: DataFrame, by: list[str], order: list[Column], hard_limit: int = 500) -> DataFrame:
    """Per-group cap from the query's own columns: ``hard_limit`` for the recall profile, else its limit."""
    cap = F.when(F.col("profile") == "recall", F.lit(hard_limit)).otherwise(F.col("limit"))
    ranked = results.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= cap)


def order_reranked(results: DataFrame, by: list[str], limit: int) -> DataFrame:
    return top_k(results, by, [F.desc("final_score"), F.asc("original_rank")], limit, rank="final_rank")


def gallery_order(groups: DataFrame, limit: int) -> DataFrame:
    return top_k(groups, ["video_id"], [F.desc("importance"), F.asc("start_ms"), F.asc("group_idx")], limit)


def with_closeness(utterances: DataFrame, centroids: DataFrame) -> DataFrame:
    """Cosine of each utterance to its speaker's centroid, rounded so that equal scores tie on every layout."""
    d = utterances.join(centroids, ["video_id", "track_id"])
    return d.withColumn("closeness", F.round(dot(l2_normalize("embedding"), F.col("centroid")), 9))


def rank_utterances(utterances: DataFrame, centroids: DataFrame, limit: int) -> DataFrame:
    """Utterances of each speaker by closeness to the speaker's centroid, then length, then index."""
    order = [F.desc("closeness"), F.desc(F.col("end_ms") - F.col("start_ms")), F.asc("utterance_idx")]
    return top_k(with_closeness(utterances, centroids), ["video_id", "track_id"], order, limit)


def voice_topk(hits: DataFrame, limit: int) -> DataFrame:
    return top_k(hits, ["query_id"], [F.desc("score"), F.asc("video_id"), F.asc("utterance_idx")], limit)


def stratified_sample(groups: DataFrame, n: int, seed: int) -> DataFrame:
    """Per category up to ``n`` queries: one with several answers, one with CJK text, one without,
    then a seeded fill. ``groups``: query_id, category, query, answers. The order inside a category
    is a seeded hash, the same on every run and cluster.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "category", F.col("query_id").cast("string")))
    cjk = F.col("query").rlike("[㐀-鿿]")
    # a pick needs at most this many first rows of each kind, whatever else was chosen before it
    kinds = [("multi", F.col("answers") > 1), ("cjk", cjk), ("plain", ~cjk), ("any", F.lit(True))]
    base = groups.withColumn("__h", order)
    parts = []
    for i, (name, cond) in enumerate(kinds):
        depth = n + 3 if name == "any" else 3
        parts.append(top_k(base.where(cond), ["category"], [F.asc("__h"), F.asc("query_id")], depth, rank="__r").withColumn("__k", F.lit(i)))
    pool = parts[0]
    for p in parts[1:]:
        pool = pool.unionByName(p)
    # at most n + 12 rows per category from here on
    per = pool.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("__k", "__r", "query_id"))).alias("rows"))

    def pick(acc, kind):
        taken = F.filter("rows", lambda r: (r["__k"] == kind) & ~F.array_contains(acc, r["query_id"]))
        return F.when(F.size(taken) > 0, F.concat(acc, F.array(taken[0]["query_id"]))).otherwise(acc)

    empty = F.array().cast(f"array<{groups.schema['query_id'].dataType.simpleString()}>")
    per = per.withColumn("__p", F.slice(F.aggregate(F.array(F.lit(0), F.lit(1), F.lit(2)), empty, pick), 1, n))
    rest = F.transform(F.filter("rows", lambda r: r["__k"] == 3), lambda r: r["query_id"])
    chosen = F.slice(F.concat("__p", F.array_except(rest, F.col("__p"))), 1, n)
    return per.select("category", F.posexplode(chosen).alias("pos", "query_id"))
