"""Interval joins as equi-joins on time buckets.

An interval of about ``width`` lies in buckets of that size, one four times as
long in buckets four times as large, and so on, so every interval touches few
buckets of its own level. A pair meets at the level of its longer member: each
side lists its own level, and the shorter one also the larger levels that occur
on the other side. The join matches equal (key, level, bucket), the exact
predicate decides, and a pair counts only in its first common bucket. There is
no nested loop, and a dense bucket is an ordinary skewed join key, which AQE splits.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import cosine
from .skew import carry, islands, top_k


STEP = 4  # each level's buckets are this many times as large as the level below


def _level(lo: Column, hi: Column, width: float) -> Column:
    ratio = (hi - lo) / F.lit(float(width))
    return F.when(ratio <= 1, 0).otherwise(F.ceil(F.log(float(STEP), ratio))).cast("int")


def _bucket(c: Column, level: Column, width: float) -> Column:
    return F.floor(c / (F.lit(float(width)) * F.pow(F.lit(float(STEP)), level))).cast("long")


def _listed(df: DataFrame, lo: Column, hi: Column, width: float, role: str, other: str, others: Column, at_least: int, first: str) -> DataFrame:
    """Rows of ``df`` once per (level, role, bucket): natively under ``role``, and under the other side's
    role at those of its levels that exceed this row's by ``at_least``."""
    d = df.withColumn("__own", _level(lo, hi, width)).withColumn("__x", F.explode(F.concat(F.array(F.lit(-1)), others)))
    native = F.col("__x") == -1
    d = d.where(native | (F.col("__x") >= F.col("__own") + at_least)).withColumns(
        {"__level": F.when(native, F.col("__own")).otherwise(F.col("__x")), "__role": F.when(native, role).otherwise(other)})
    d = d.withColumn(first, _bucket(lo, F.col("__level"), width))
    return d.withColumn("__b", F.explode(F.sequence(F.col(first), F.greatest(F.col(first), _bucket(hi, F.col("__level"), width))))).drop("__own", "__x")


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], a_span: tuple[str, str], b_span: tuple[str, str], *,
                 width: float, strict: bool = True, pad: float = 0.0) -> DataFrame:
    """Pairs whose intervals overlap, ``a`` widened by ``pad``. Other column names must be disjoint."""
    a0, a1, b0, b1 = F.col(a_span[0]) - pad, F.col(a_span[1]) + pad, F.col(b_span[0]), F.col(b_span[1])

    def levels(df, lo, hi):
        # a handful of small integers, whatever the size of the table
        return df.agg(F.collect_set(_level(lo, hi, width))).scalar()

    left = _listed(a, a0, a1, width, "a", "b", levels(b, b0, b1), 1, "__fa")
    right = _listed(b, b0, b1, width, "b", "a", levels(a, a0, a1), 0, "__fb")
    hit = (a0 < b1) & (a1 > b0) if strict else (a0 <= b1) & (a1 >= b0)
    j = left.join(right, [*on, "__level", "__role", "__b"]).where(hit & (F.col("__b") == F.greatest("__fa", "__fb")))
    return j.drop("__b", "__fa", "__fb", "__level", "__role")


def _length() -> Column:
    return F.least("end", "b_end") - F.greatest("start", "b_start")


def _as_b(b: DataFrame, key: str) -> DataFrame:
    return b.withColumnsRenamed({"start": "b_start", "end": "b_end", key: "b_key"}).select(
        "b_key", "b_start", "b_end", *[c for c in b.columns if c not in ("start", "end", key)])


def max_overlap_join(a: DataFrame, b: DataFrame, on: list[str], a_key: str, b_key: str, width: float) -> DataFrame:
    """Each ``a`` with the ``b`` it overlaps most (lowest key on ties); -1 when there is none."""
    pairs = overlap_join(a.select(*on, a_key, "start", "end"), _as_b(b.select(*on, b_key, "start", "end"), b_key), on,
                         ("start", "end"), ("b_start", "b_end"), width=width)
    best = pairs.groupBy(*on, a_key).agg(F.max_by("b_key", F.struct(_length(), -F.col("b_key"))).alias("match"))
    return a.join(best, [*on, a_key], "left").withColumn("match", F.coalesce("match", F.lit(-1)))


def sum_overlap_assign(a: DataFrame, b: DataFrame, on: list[str], a_key: str, label: str, width: float) -> DataFrame:
    """Each ``a`` with the label whose intervals cover it longest in total (lowest label on ties); -1 for none."""
    pairs = overlap_join(a.select(*on, a_key, "start", "end"), _as_b(b.select(*on, label, "start", "end"), label), on,
                         ("start", "end"), ("b_start", "b_end"), width=width)
    total = pairs.groupBy(*on, a_key, "b_key").agg(F.sum(_length()).alias("__len"))
    best = total.groupBy(*on, a_key).agg(F.max_by("b_key", F.struct("__len", -F.col("b_key"))).alias("label"))
    return a.join(best, [*on, a_key], "left").withColumn("label", F.coalesce("label", F.lit(-1)))


def interval_intersect(a: DataFrame, b: DataFrame, on: list[str], a_key: str, b_key: str, min_len: float, width: float) -> DataFrame:
    """Common parts of at least ``min_len`` with both keys."""
    pairs = overlap_join(a.select(*on, a_key, "start", "end"), _as_b(b.select(*on, b_key, "start", "end"), b_key), on,
                         ("start", "end"), ("b_start", "b_end"), width=width)
    return pairs.select(*on, a_key, F.col("b_key").alias(f"{b_key}_b" if b_key in (a_key, *on) else b_key),
                        F.greatest("start", "b_start").alias("start"), F.least("end", "b_end").alias("end")
                        ).where(F.col("end") - F.col("start") >= min_len)


def asof_segment(points: DataFrame, segments: DataFrame, on: list[str], key: str, ts: str, width: float) -> DataFrame:
    """Segment of each point: the last one starting at or before it, the first when none does;
    a point past that segment's end takes the following segment, if there is one.

    ``segments``: on, segment_idx, start, end. ``points`` keep only on, key and ts.
    """
    nxt = carry(segments.select(*on, "segment_idx", "start", "end"), on, [-F.col("start"), F.col("segment_idx")], width,
                lag={"__next": F.col("segment_idx")})
    first = segments.groupBy(*on).agg(F.min_by("segment_idx", "start").alias("__first"))
    info = F.struct(F.col("start"), F.col("end"), F.col("segment_idx"), F.col("__next"))
    none = F.lit(None)
    seg_rows = nxt.select(*on, none.cast(points.schema[key].dataType).alias(key), F.col("start").cast("double").alias("__t"),
                          F.lit(0).alias("__kind"), F.col("segment_idx").alias("__tie"), info.alias("__seg"))
    pt_rows = points.select(*on, key, F.col(ts).cast("double").alias("__t"), F.lit(1).alias("__kind"), F.col(key).alias("__tie"),
                            none.cast(seg_rows.schema["__seg"].dataType).alias("__seg"))
    d = carry(seg_rows.unionByName(pt_rows), on, [F.col("__t"), F.col("__kind"), F.col("__tie")], width,
              max_before={"__last": F.col("__seg")}).where("__kind = 1").join(first, on)
    s = F.col("__last")
    seg = (F.when(s.isNull(), F.col("__first")).when((F.col("__t") > s["end"]) & s["__next"].isNotNull(), s["__next"])
           .otherwise(s["segment_idx"]))
    return d.select(*on, key, F.col("__t").alias(ts), seg.alias("segment_idx"))


def coalesce_windows(df: DataFrame, by: list[str], start: str, end: str, pad: float, tie: list[str], width: float) -> DataFrame:
    """Padded windows (never before 0), touching ones merged."""
    d = df.select(*by, *tie, F.greatest(F.lit(0), F.col(start) - pad).alias("start"), (F.col(end) + pad).alias("end"))
    d = islands(d, by, "start", "end", 0, tie, width)
    return d.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def window_semijoin(rows: DataFrame, windows: DataFrame, on: list[str], key: list[str], start: str, end: str, width: float) -> DataFrame:
    """Rows that strictly overlap some window, each once."""
    w = windows.select(*on, F.col("start").alias("__ws"), F.col("end").alias("__we"))
    slim = rows.select(*dict.fromkeys([*on, *key, start, end]))
    hit = overlap_join(slim, w, on, (start, end), ("__ws", "__we"), width=width).select(*dict.fromkeys([*on, *key])).distinct()
    return rows.join(hit, list(dict.fromkeys([*on, *key])), "left_semi")


def nearest_moment_join(results: DataFrame, moments: DataFrame, on: list[str], key: str, gap: float = 3.0, width: float = 60.0) -> DataFrame:
    """Each result with the moment of nearest centre among those it overlaps (touching counts) or whose
    centre lies within ``gap``. A result naming its moment (``moment_ref``) gets exactly that one.

    ``results``: on, key, start, end[, moment_ref]; ``moments``: on, moment_id, m_start, m_end.
    """
    centre, m_centre = (F.col("start") + F.col("end")) / 2, (F.col("m_start") + F.col("m_end")) / 2
    r = results.withColumns({"__lo": F.least(F.col("start"), centre - gap), "__hi": F.greatest(F.col("end"), centre + gap)})
    m = moments.select(*on, "moment_id", "m_start", "m_end")
    pairs = overlap_join(r, m, on, ("__lo", "__hi"), ("m_start", "m_end"), width=width, strict=False)
    distance = F.abs(centre - m_centre)
    touches = (F.col("start") <= F.col("m_end")) & (F.col("end") >= F.col("m_start"))
    pairs = pairs.withColumn("distance", distance).where(touches | (distance <= gap))
    near = top_k(pairs, [*on, key], [F.asc("distance"), F.asc("moment_id")], 1).drop("rank", "__lo", "__hi")
    if "moment_ref" not in results.columns:
        return near
    exact = results.join(m.withColumnRenamed("moment_id", "moment_ref"), [*on, "moment_ref"]).withColumns(
        {"moment_id": F.col("moment_ref"), "distance": F.lit(0.0)})
    return exact.unionByName(near.join(exact.select(*on, key), [*on, key], "left_anti"))


def restrict_to_current(results: DataFrame, moments: DataFrame, on: list[str], key: str, gap: float = 3.0, width: float = 60.0) -> DataFrame:
    hit = nearest_moment_join(results, moments, on, key, gap, width).select(*on, key)
    return results.join(hit, [*on, key], "left_semi")


def overlap_best_match(moments: DataFrame, tracks: DataFrame, query_vecs: DataFrame, *, confirmed: float = 0.35,
                       ambiguous: float = 0.20, pad: float = 0.0, width: float = 60_000) -> DataFrame:
    """For each moment the overlapping track closest to the query's vector, with a verdict.

    ``moments``: query_id, video_id, moment_id, start_ms, end_ms; ``tracks``: video_id, track_idx,
    t_start, t_end, embedding; ``query_vecs``: query_id, vec.
    """
    w = moments.select("query_id", "video_id", "moment_id", "start_ms", "end_ms")
    pairs = overlap_join(w, tracks.select("video_id", "track_idx", "t_start", "t_end", "embedding"), ["video_id"],
                         ("start_ms", "end_ms"), ("t_start", "t_end"), width=width, pad=pad)
    scored = pairs.join(query_vecs.select("query_id", "vec"), "query_id").withColumn("__cos", cosine("embedding", "vec"))
    best = scored.groupBy("query_id", "moment_id").agg(
        F.max_by(F.struct("track_idx", F.col("__cos").alias("cosine")), F.struct("__cos", -F.col("track_idx"))).alias("__m"))
    out = moments.join(best, ["query_id", "moment_id"], "left").withColumns(
        {"track_idx": F.col("__m.track_idx"), "cosine": F.col("__m.cosine")}).drop("__m")
    c = F.col("cosine")
    return out.withColumn("status", F.when(c.isNull(), "no_track").when(c >= confirmed, "confirmed")
                          .when(c >= min(ambiguous, confirmed), "ambiguous").otherwise("rejected"))


def truth_overlap_join(results: DataFrame, truth: DataFrame, width: float = 60.0) -> DataFrame:
    """Ranked results with every truth segment of positive common length.

    ``results``: query_id, video_id, rank, start, end; ``truth``: query_id, video_id, truth_id, t_start, t_end.
    """
    return overlap_join(results, truth, ["query_id", "video_id"], ("start", "end"), ("t_start", "t_end"), width=width)


