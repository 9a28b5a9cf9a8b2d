"""Identity operators over caller-supplied vectors: tracks, clusters, speaker turns, voice search."""
from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import l2_normalize
from .aggregates import best_per_utterance, identity_group_rollup, representative, weighted_vector_mean
from .filters import major_groups, ready_publications
from .intervals import interval_intersect
from .knn import knn_join
from .relations import entity_mention, join_overlays
from .skew import fold_sorted, islands, number_rows, top_k
from .windows import voice_topk, with_closeness


def _kinds(df: DataFrame, cols: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in cols)


def _unit(v) -> np.ndarray:
    v = np.asarray(v, dtype=np.float64)
    return v / max(np.linalg.norm(v), 1e-12)


# --- tracking ---------------------------------------------------------------------------------

def _iou(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0.0, w) * max(0.0, h)
    area = sum(max(0.0, x[2] - x[0]) * max(0.0, x[3] - x[1]) for x in (a, b))
    return inter / max(1e-6, area - inter)


class TrackState:
    """Open tracks of one video: each keeps its vector sum, last box, and best detection."""

    def __init__(self, max_gap: float, cos: float, frame_s: float):
        self.max_gap, self.cos, self.frame_s = max_gap, cos, frame_s
        self.open: list[dict] = []
        self.clock, self.taken = None, set()

    def expire(self, now: float):
        done = [t for t in self.open if now - t["end"] > self.max_gap]
        self.open = [t for t in self.open if now - t["end"] <= self.max_gap]
        return done

    def add(self, r: dict):
        """Place one detection (time order, best score first inside a frame); returns tracks that ended."""
        done = []
        if r["ts"] != self.clock:
            done, self.clock, self.taken = self.expire(r["ts"]), r["ts"], set()
        v, box = _unit(r["embedding"]), r["bbox"]
        best = None
        for i, t in enumerate(self.open):
            if id(t) not in self.taken:
                c = float(v @ _unit(t["sum"]))
                key = (0.85 * c + 0.15 * _iou(box, t["bbox"]), c, i)
                best = max(best, key) if best else key
        if best and best[1] >= self.cos:
            t = self.open[best[2]]
            t["sum"] = t["sum"] + v
        else:
            t = {"start": r["ts"], "first": r["det_id"], "sum": v, "n": 0, "quality": 0.0, "best": 0.0, "best_det": None}
            self.open.append(t)
        t["end"], t["bbox"], t["n"] = r["ts"] + self.frame_s, box, t["n"] + 1
        if r["quality"] > t["quality"]:
            t["quality"], t["best"], t["best_det"] = r["quality"], r["ts"], r["det_id"]
        self.taken.add(id(t))
        return done


def track_row(t: dict) -> dict:
    return {"first_det": t["first"], "start_ms": round(t["start"] * 1000), "end_ms": round(t["end"] * 1000), "best_ms": round(t["best"] * 1000),
            "quality": t["quality"], "detections": t["n"], "best_det": t["best_det"], "embedding": _unit(t["sum"]).tolist()}


TRACK_SCHEMA = ("first_det bigint, start_ms bigint, end_ms bigint, best_ms bigint, quality double, detections bigint, best_det bigint, "
                "embedding array<float>")


def track_detections(df: DataFrame, keys: list[str] | None = None, fps: float = 2.0, max_gap: float = 1.5, cos: float = 0.35,
                     width: float = 600.0) -> DataFrame:
    """Detections (keys, det_id, ts seconds, det_score, quality, bbox array of 4, embedding) to tracks.

    No track lives across a pause longer than ``max_gap``, so pauses cut the video into independent parts.
    """
    keys = keys or ["video_id"]
    d = df.withColumn("ts", F.col("ts").cast("double")).withColumn("__end", F.col("ts") + 1.0 / fps)
    d = islands(d, keys, "ts", "__end", max_gap, ["det_id"], width)

    def fold(rows):
        state = TrackState(max_gap, cos, 1.0 / fps)
        for r in rows:
            for t in state.add(r):
                yield track_row(t)
        for t in state.open:
            yield track_row(t)

    t = fold_sorted(d, [*keys, "island"], [F.col("ts"), -F.col("det_score"), F.col("det_id")], fold, f"{_kinds(df, keys)}, {TRACK_SCHEMA}")
    return number_rows(t, keys, [F.col("start_ms"), F.col("first_det")], width * 1000, "track_idx")


# --- clustering -------------------------------------------------------------------------------

#: Members of a group that a track is compared with at once.
MEMBERS = 4096


def cluster_identities(tracks: DataFrame, keys: list[str] | None = None, cos: float = 0.52) -> DataFrame:
    """Adds ``group_seq``: tracks in time order join the group maximising min(cosine to centroid,
    best cosine to a member) when that reaches ``cos``, else they open a group.

    Each decision depends on all earlier ones of the same video, so a video is one stream; its state is
    the vectors seen so far, as one matrix for each group. No score exceeds the cosine to the centroid, so a track is
    compared with the members of those groups only whose centroid can still win, and with no more of them once one is as close.
    """
    keys = keys or ["video_id"]

    def fold(rows):
        sums, centroids, members, sizes = [], np.empty((0, 0)), [], []
        for r in rows:
            v = _unit(r["embedding"])
            if not sums:
                centroids = np.empty((64, len(v)))
            near = centroids[:len(sums)] @ v
            may = np.flatnonzero(near >= cos)
            best, score = -1, cos
            for g in may[np.argsort(-near[may], kind="stable")].tolist():
                if near[g] < score:
                    break
                member = -np.inf
                for i in range(0, sizes[g], MEMBERS):
                    member = max(member, float((members[g][i:min(i + MEMBERS, sizes[g])] @ v).max()))
                    if member >= near[g]:
                        break
                found = min(float(near[g]), member)
                if found > score or found == score and (best < 0 or g < best):
                    best, score = g, found
            w = max(r["quality"] if r["quality"] is not None else 0.5, 0.1)
            if best < 0:
                best = len(sums)
                if best == len(centroids):
                    centroids = np.vstack([centroids, np.empty_like(centroids)])
                sums.append(w * v)
                centroids[best] = v
                members.append(v[None])
                sizes.append(1)
            else:
                sums[best] = sums[best] + w * v
                centroids[best] = _unit(sums[best])
                if sizes[best] == len(members[best]):
                    members[best] = np.vstack([members[best], np.empty_like(members[best])])
                members[best][sizes[best]] = v
                sizes[best] += 1
            yield {"track_idx": r["track_idx"], "group_seq": best}

    slim = tracks.select(*keys, "track_idx", "start_ms", "quality", "embedding")
    g = fold_sorted(slim, keys, [F.col("start_ms"), F.col("track_idx")], fold, f"{_kinds(tracks, keys)}, track_idx long, group_seq long")
    return tracks.join(g, [*keys, "track_idx"])


def identity_groups(tracks: DataFrame, keys: list[str] | None = None, cos: float = 0.52, width: float = 1.0) -> DataFrame:
    """Clustered tracks rolled up to ranked identity groups with centroid, representative and importance.

    ``tracks``: keys, track_idx, start_ms, end_ms, best_ms, quality, detections, embedding.
    """
    keys = keys or ["video_id"]
    by = [*keys, "group_seq"]
    t = cluster_identities(tracks, keys, cos)
    c = weighted_vector_mean(t, by)
    rep = representative(t, c, by, "track_idx", "quality").select(*by, "representative")
    rep_row = t.join(rep, by).where("track_idx = representative").select(*by, "representative", F.col("quality").alias("rep_quality"), "best_ms")
    rolled = identity_group_rollup(t.join(rep_row.select(*by, "rep_quality"), by), by)
    out = rolled.join(c, by).join(rep_row.drop("rep_quality"), by).withColumnRenamed("centroid", "embedding")
    # importance grows with log(duration), so one chunk per unit of it keeps ranking parallel
    return number_rows(out, keys, [-F.col("importance"), F.col("start_ms"), F.col("group_seq")], width, "group_idx")


def density_fallback(windows: DataFrame, by: list[str], components: int = 32, k: int = 8) -> DataFrame:
    """Second clustering for videos whose windows all fell into one cluster (40 windows or more).

    The reference step is a density clustering of one video in memory; here the affected windows of
    all videos are projected by PCA and split by bisecting k-means as one distributed fit, and labels
    are compacted per video.
    """
    flat = windows.groupBy(*by).agg(F.count("*").alias("n"), (F.min("label") == F.max("label")).alias("one")).where("one AND n >= 40").select(*by)
    d = windows.join(flat, by, "left_semi").withColumn("__v", array_to_vector(l2_normalize("embedding")))
    head = d.select("embedding").first()
    if head is None:  # no video has collapsed, the usual case
        return windows.limit(0).withColumn("label", F.col("label").cast("long"))
    dim = len(head[0])
    pca = PCA(k=min(components, dim), inputCol="__v", outputCol="__p").fit(d)
    model = BisectingKMeans(k=k, seed=0, featuresCol="__p", predictionCol="__label").fit(pca.transform(d))
    scored = model.transform(pca.transform(d)).drop("__v", "__p")
    used = scored.groupBy(*by).agg(F.array_sort(F.collect_set("__label")).alias("__set"))
    return scored.join(used, by).withColumn("label", F.array_position("__set", F.col("__label")).cast("long") - 1).drop("__set", "__label")


# --- speakers ---------------------------------------------------------------------------------

def speaker_turns(windows: DataFrame, keys: list[str] | None = None, width: float = 600.0) -> DataFrame:
    """Overlapping labelled windows (keys, idx, start, end seconds, label) to exclusive turns:
    the same label extends a turn, another label cuts at the middle of the overlap."""
    keys = keys or ["video_id"]
    d = islands(windows, keys, "start", "end", 0.0, ["idx"], width)

    def fold(rows):
        turn = None
        for r in rows:
            s, e, label = r["start"], r["end"], r["label"]
            if turn and s <= turn["end"] and label == turn["label"]:
                turn["end"] = max(turn["end"], e)
                continue
            if turn:
                if s <= turn["end"]:
                    s = turn["end"] = (turn["end"] + s) / 2
                yield turn
            turn = {"idx": r["idx"], "start": s, "end": e, "label": label}
        yield turn

    t = fold_sorted(d, [*keys, "island"], [F.col("start"), F.col("end"), F.col("idx")], fold,
                    f"{_kinds(windows, keys)}, idx long, start double, end double, label long")
    return t.withColumns({"start_ms": F.bround(F.col("start") * 1000).cast("long"), "end_ms": F.bround(F.col("end") * 1000).cast("long")})


def speaker_turn_units(turns: DataFrame, chunks: DataFrame, keys: list[str] | None = None, min_ms: int = 500, width: float = 10_000.0) -> DataFrame:
    """Turns cut at text-chunk borders: (turn, chunk) intersections of at least ``min_ms``."""
    keys = keys or ["video_id"]
    t = turns.select(*keys, F.col("idx").alias("turn_idx"), F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))
    c = chunks.select(*keys, "chunk_idx", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))
    u = interval_intersect(t, c, keys, "turn_idx", "chunk_idx", min_ms, width)
    return u.join(turns.select(*keys, F.col("idx").alias("turn_idx"), F.col("label").alias("track_id")), [*keys, "turn_idx"])


def nonoverlap_preview(ranked: DataFrame, keys: list[str], order: list, n: int = 5) -> DataFrame:
    """Greedy preview: in rank order, rows that overlap none already taken, until ``n``."""
    def fold(rows):
        taken = []
        for r in rows:
            if len(taken) < n and all(min(r["end_ms"], b) <= max(r["start_ms"], a) for a, b in taken):
                taken.append((r["start_ms"], r["end_ms"]))
                yield {"utterance_idx": r["utterance_idx"], "preview": len(taken)}

    slim = ranked.select(*keys, "utterance_idx", "start_ms", "end_ms", *[o.alias(f"__k{i}") for i, o in enumerate(order)])
    return fold_sorted(slim, keys, [F.col(f"__k{i}") for i in range(len(order))], fold, f"{_kinds(ranked, keys)}, utterance_idx long, preview long")


def speaker_preview(utterances: DataFrame, centroids: DataFrame, labels: DataFrame | None = None, n: int = 5) -> DataFrame:
    """Preview utterances per speaker: the chosen representative first, then by closeness to the centroid."""
    keys = ["video_id", "track_id"]
    ranked = with_closeness(utterances, centroids)
    if labels is not None:
        ranked = ranked.join(labels.select(*keys, F.col("representative").alias("__rep")), keys, "left")
        first = F.coalesce(F.col("utterance_idx") == F.col("__rep"), F.lit(False))
    else:
        first = F.lit(False)
    order = [F.when(first, 0).otherwise(1), -F.col("closeness"), F.col("start_ms") - F.col("end_ms"), F.col("utterance_idx")]
    return nonoverlap_preview(ranked, keys, order, n)


def voice_search(query_vecs: DataFrame, utterances: DataFrame, overlays: DataFrame, texts: DataFrame | None = None,
                 exclude: DataFrame | None = None, limit: int = 50) -> DataFrame:
    """Best utterances across videos for each query voice (one or several vectors).

    Overrides apply first (hidden utterances and each query's own never count), then the best score
    per utterance over the query's vectors, then the global limit.
    """
    u = join_overlays(utterances, overlays).where("searchable = 1")
    own = None if exclude is None else exclude.select("query_id", "video_id", "utterance_idx")
    # the query's own utterances take places in a per-video list, so the list is that much longer
    spare = 0 if own is None else own.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    # an utterance of the final list is among the best limit + spare of the vector it scores highest on
    hits = knn_join(query_vecs, u, limit + spare, by=(), keep=("video_id", "utterance_idx"))
    best = best_per_utterance(hits)
    if own is not None:
        best = best.join(own, ["query_id", "video_id", "utterance_idx"], "left_anti")
    top = voice_topk(best, limit)
    out = top.join(u.select("video_id", "utterance_idx", "track_id", "start_ms", "end_ms", "asr_chunk_idx"), ["video_id", "utterance_idx"])
    if texts is not None:
        t = texts.select("video_id", F.col("segment_idx").alias("asr_chunk_idx"), F.col("text").alias("chunk_text"))
        out = out.join(t, ["video_id", "asr_chunk_idx"], "left")
    return out


# --- entities and galleries ---------------------------------------------------------------------

def resolve_entity_vector(texts: DataFrame, entities: DataFrame, samples: DataFrame) -> DataFrame:
    """Mean sample vector of the entity named in each query text."""
    from .aggregates import vector_mean
    m = entity_mention(texts, entities)
    wanted = samples.join(m.select("entity_id").distinct(), "entity_id", "left_semi")
    return m.hint("merge").join(vector_mean(wanted, ["entity_id"], out="vec"), "entity_id")


def identity_gallery(groups: DataFrame, pointers: DataFrame, bindings: DataFrame | None = None, limit: int = 24,
                     min_duration_ms: int = 3000, min_occurrences: int = 3) -> DataFrame:
    """Presentable groups of every video's published generation, with bound entities."""
    live = ready_publications(pointers.where("modality = 'face'")).select("video_id", "asset_version")
    g = major_groups(groups.join(live, ["video_id", "asset_version"], "left_semi"), min_duration_ms, min_occurrences, limit)
    if bindings is None:
        return g
    return g.join(bindings.select("video_id", "asset_version", "group_idx", "entity_id"), ["video_id", "asset_version", "group_idx"], "left")


def attach_group_to_entity(attach: DataFrame, groups: DataFrame) -> DataFrame:
    """Entity sample rows for (entity_id, video_id, asset_version, group_version, group_idx); the id depends on
    the group alone, so attaching again writes the same row. A group that does not exist is an error."""
    from ..functions.keys import make_pk, sample_id
    key = ["video_id", "asset_version", "group_version", "group_idx"]
    g = groups.select(*key, F.col("embedding").alias("__e"), "quality")
    j = attach.join(g, key, "left").withColumn("embedding", F.coalesce("__e", F.raise_error("no such group").cast("array<double>"))).drop("__e")
    j = j.withColumn("sample_id", sample_id(*key))
    return j.withColumn("pk", make_pk(F.lit("entity_face"), "entity_id", "sample_id"))


# --- shots and layout ---------------------------------------------------------------------------

def shot_boundaries(frames: DataFrame, keys: list[str], threshold: float, min_gap_ms: int, width: float = 600_000.0) -> DataFrame:
    """Frames (keys, ts_ms, difference) where the picture changes enough and the last accepted boundary
    (the video's start counts) is far enough. A change after a long calm is always accepted, so calms cut the work."""
    c = frames.where(F.col("difference") >= threshold).select(*keys, "ts_ms")
    zero = frames.select(*keys).distinct().withColumn("ts_ms", F.lit(0).cast("long"))
    d = zero.unionByName(c.where("ts_ms > 0").distinct()).withColumn("__e", F.col("ts_ms"))
    d = islands(d, keys, "ts_ms", "__e", min_gap_ms, [], width)

    def fold(rows):
        last = None
        for r in rows:
            if last is None or r["ts_ms"] - last >= min_gap_ms:
                last = r["ts_ms"]
                yield {"ts_ms": last}

    return fold_sorted(d, [*keys, "island"], [F.col("ts_ms")], fold, f"{_kinds(frames, keys)}, ts_ms long")


def reading_order(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Position of each box (keys, box_id, left, top, bottom): rows by centre height, then left to right."""
    h = boxes.groupBy(*keys).agg(F.median(F.greatest(F.col("bottom") - F.col("top"), F.lit(1.0))).alias("__m"))
    d = boxes.join(h, keys).select(*keys, "box_id", "left", ((F.col("top") + F.col("bottom")) / 2).alias("cy"),
                                   F.greatest(F.lit(8.0), F.col("__m") * 0.6).alias("near"))

    def fold(rows):
        centres, sizes = [], []
        for r in rows:
            k = next((i for i, c in enumerate(centres) if abs(r["cy"] - c) <= r["near"]), None)
            if k is None:
                k = len(centres)
                centres.append(r["cy"])
                sizes.append(1)
            else:
                sizes[k] += 1
                centres[k] += (r["cy"] - centres[k]) / sizes[k]
            yield {"box_id": r["box_id"], "left": r["left"], "row_idx": k, "seen": sizes[k], "centre": centres[k]}

    t = fold_sorted(d, keys, [F.col("cy"), F.col("left"), F.col("box_id")], fold,
                    f"{_kinds(boxes, keys)}, box_id long, left double, row_idx long, seen long, centre double")
    last = t.groupBy(*keys, "row_idx").agg(F.max_by("centre", "seen").alias("row_centre"))
    return number_rows(t.join(last, [*keys, "row_idx"]), keys, [F.col("row_centre"), F.col("row_idx"), F.col("left"), F.col("box_id")], 1000.0, "pos").select(
        *keys, "box_id", "pos")


# --- evaluation -------------------------------------------------------------------------------

def max_matching(pairs: DataFrame, keys: list[str], ks=(1, 3, 5, 10, 20)) -> DataFrame:
    """Most truth segments that ranked results can cover one-to-one, for each k.

    ``pairs``: keys, rank, truth_id (overlapping pairs). A result needs no more than max(ks) of its
    truths: with that many it can always find a free one, so trimming keeps the maximum.
    """
    top = max(ks)
    p = top_k(pairs.where(F.col("rank") <= top), [*keys, "rank"], [F.asc("truth_id")], top, rank="__r")

    def fold(rows):
        edges: dict[int, list] = {}
        for r in rows:
            edges.setdefault(r["rank"], []).append(r["truth_id"])
        owner: dict = {}

        def place(result, tried):
            for t in edges[result]:
                if t not in tried:
                    tried.add(t)
                    if t not in owner or place(owner[t], tried):
                        owner[t] = result
                        return True
            return False

        todo = sorted(edges)
        for k in sorted(ks):
            while todo and todo[0] <= k:
                place(todo.pop(0), set())
            yield {"k": k, "matched": len(owner)}

    return fold_sorted(p.select(*keys, "rank", "truth_id"), keys, [F.col("rank"), F.col("truth_id")], fold, f"{_kinds(pairs, keys)}, k long, matched long")

