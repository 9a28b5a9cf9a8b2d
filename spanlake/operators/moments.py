"""Temporal grouping of scored candidates into moments, and their fusion.

Grouping depends on order, so it is a fold over one (query, video) at a time,
whose size the channel limits bound. Everything after it is aggregation.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .aggregates import group_rollup
from .skew import fold_sorted, islands, top_k
from .windows import result_order

# Screen text joins within this gap, and within this distance of the best score.
OCR_GAP, OCR_RATIO, OCR_DROP = 0.35, 0.90, 0.10
FACE_BAND = 0.15
TIME_CHUNK = 3600.0


def _score_first(start, end, score, gap, ratio, drop, max_len) -> np.ndarray:
    """Seed index per row (rows in time order). Best score first, each seed growing left, then right,
    over the rows still free, until the nearest free row fails."""
    n = len(start)
    prev, nxt = np.arange(-1, n - 1), np.arange(1, n + 1)   # neighbours among free rows
    group = np.full(n, -1)

    def take(i, g):
        group[i] = g
        if prev[i] >= 0:
            nxt[prev[i]] = nxt[i]
        if nxt[i] < n:
            prev[nxt[i]] = prev[i]

    seeds = 0
    for seed in np.lexsort((np.arange(n), -score)):
        if group[seed] >= 0:
            continue
        floor = max(score[seed] * ratio, score[seed] - drop)
        lo, hi = start[seed], end[seed]
        take(seed, seeds)
        for links, gap_to in ((prev, lambda i: lo - end[i]), (nxt, lambda i: start[i] - hi)):
            i = links[seed]
            while 0 <= i < n and score[i] >= floor and gap_to(i) <= gap and max(hi, end[i]) - min(lo, start[i]) <= max_len:
                lo, hi = min(lo, start[i]), max(hi, end[i])
                take(i, seeds)
                i = links[i]
        seeds += 1
    return group


def group_ocr_score_first(cands: DataFrame, keys: list[str], gap: float = OCR_GAP, ratio: float = OCR_RATIO, drop: float = OCR_DROP,
                          max_len: float = 15.0, out: str = "ocr_group", cut: bool = True) -> DataFrame:
    """Adds the group number (seed order) inside each (keys, island).

    Input is the output of a per-video channel limit, so an island holds at most that many rows.
    """
    d = islands(cands, keys, "start_time", "end_time", gap, ["unit_id"], TIME_CHUNK) if cut else cands
    schema = StructType([*d.schema.fields, StructField(out, IntegerType())])

    def fold(rows):
        members = list(rows)
        groups = [0]
        if len(members) > 1:
            start, end, score = (np.array([m[c] for m in members], dtype=float) for c in ("start_time", "end_time", "score"))
            groups = _score_first(start, end, score, gap, ratio, drop, max_len).tolist()
        for m, g in zip(members, groups):
            yield {**m, out: g}

    order = [F.col("start_time"), F.col("end_time"), F.col("unit_id")]
    return fold_sorted(d, [*keys, "island"], order, fold, schema)


def _assign(members: list[dict], gap: float, max_len: float, band: float) -> list[str]:
    """Group id of each member of one (query, video): screen text first, best score first; then the
    others in time order, each to the open group at the smallest distance, or to a new one."""
    ids: list = [None] * len(members)
    groups: list[dict] = []
    ocr = [i for i, m in enumerate(members) if m["modality"] == "ocr"]
    if ocr:
        start, end, score = (np.array([members[i][c] for i in ocr], dtype=float) for c in ("start_time", "end_time", "score"))
        label = _score_first(start, end, score, OCR_GAP, OCR_RATIO, OCR_DROP, max_len)
        for g in range(label.max() + 1):
            groups.append({"start": start[label == g].min(), "end": end[label == g].max(), "channels": {"ocr"}, "cosines": (), "gid": f"o{g}"})
        for i, g in zip(ocr, label):
            ids[i] = f"o{g}"

    def distance(g, r):
        s, e, channel = r["start_time"], r["end_time"], r["modality"]
        if max(g["end"], e) - min(g["start"], s) > max_len:
            return None
        d = max(s - g["end"], g["start"] - e, 0.0)
        near, overlaps = d <= gap, s < g["end"] and e > g["start"]
        only = next(iter(g["channels"])) if len(g["channels"]) == 1 else None
        if channel == only == "face":
            raw, seen = r["raw_score"], g["cosines"]
            ok = near and (raw is None or not seen or max(seen) - band <= raw <= min(seen) + band)
        elif channel == only == "visual":
            ok = overlaps
        elif channel == "visual" or only == "visual":
            ok = overlaps or (near and only != "visual")
        else:
            ok = near
        return d if ok else None

    live = groups
    for i, r in enumerate(members):
        if r["modality"] == "ocr":
            continue
        # starts only grow: a group that ended more than the gap ago is complete
        live = [g for g in live if r["start_time"] - g["end"] <= gap]
        fits = [(d, n) for n, g in enumerate(live) if (d := distance(g, r)) is not None]
        if fits:
            g = live[min(fits)[1]]
            g["start"], g["end"] = min(g["start"], r["start_time"]), max(g["end"], r["end_time"])
            g["channels"].add(r["modality"])
        else:
            g = {"start": r["start_time"], "end": r["end_time"], "channels": {r["modality"]}, "cosines": (), "gid": f"g{i}"}
            live.append(g)
        if r["modality"] == "face" and r["raw_score"] is not None:
            seen = g["cosines"] + (r["raw_score"],)
            g["cosines"] = (min(seen), max(seen))
        ids[i] = g["gid"]
    return ids


def group_moments(cands: DataFrame, gap: float = 2.0, max_len: float = 15.0, face_band: float = FACE_BAND,
                  keys: list[str] | None = None, split: bool = False) -> DataFrame:
    """Candidates with their moment id ``gid``, unique together with ``keys`` (and ``island`` when split).

    Needs modality, unit_id, start_time, end_time, score, raw_score. Candidates come from per-video
    channel limits, which bound a (query, video) group; one shuffle by those keys and one streamed fold
    do the work. For input without such limits ``split`` first cuts every group at silences longer than
    the gap, across which no moment can reach.
    """
    keys = keys or ["query_id", "video_id"]
    d = islands(cands, keys, "start_time", "end_time", max(gap, OCR_GAP), ["modality", "unit_id"], TIME_CHUNK) if split else cands
    schema = StructType([*d.schema.fields, StructField("gid", StringType())])

    def fold(rows):
        members = list(rows)
        for m, gid in zip(members, _assign(members, gap, max_len, face_band)):
            yield {**m, "gid": gid}

    order = [F.col(c) for c in ("start_time", "end_time", "modality", "unit_id")]
    return fold_sorted(d, [*keys, "island"] if split else keys, order, fold, schema)


def fuse_results(grouped: DataFrame, weights: dict | None = None, primary: str | None = None, limit: int = 24,
                 keys: list[str] | None = None, evidence: list[str] | None = None) -> DataFrame:
    """Ranked results, one per moment, best ``limit`` per query."""
    keys = keys or ["query_id", "video_id"]
    part = [c for c in ("island", "gid") if c in grouped.columns]
    r = group_rollup(grouped, [*keys, *part], weights, evidence)
    order = [*result_order(primary), *[F.asc(c) for c in part]]
    return top_k(r, [k for k in keys if k != "video_id"], order, limit)


def score_band(face_rows: DataFrame, group_bounds: DataFrame, by: list[str], band: float = FACE_BAND) -> DataFrame:
    """Would a face hit be admitted by a group with the given best and worst cosine?"""
    j = face_rows.join(group_bounds, by)
    r = F.col("raw_score")
    ok = r.isNull() | F.col("hi").isNull() | ((r >= F.col("hi") - band) & (r <= F.col("lo") + band))
    return j.withColumn("admitted", ok)
