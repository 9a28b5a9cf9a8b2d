"""Aggregations. All use partial aggregation, so a hot key is reduced before the shuffle."""
from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DECISION_ORDER, FUSION_WEIGHTS
from ..functions.text import char_profile, quality_of, tokenize, with_normalized
from ..functions.vector import dot, l2_normalize
from ..session import cut_lineage
from .quantiles import percentiles


# --- scores -----------------------------------------------------------------------------------

def frame_multiquery_agg(hits: DataFrame, n_queries: DataFrame, by: list[str]) -> DataFrame:
    """Frame score over a query's sub-queries: the score itself for one, else 0.65 mean + 0.35 min,
    where a sub-query that did not return the frame counts as 0. ``n_queries``: query_id, n."""
    n = F.col("n")
    g = hits.groupBy("query_id", *by).agg(F.sum("score").alias("__s"), F.min("score").alias("__m"), F.count("*").alias("__c"))
    worst = F.when(F.col("__c") < n, F.least("__m", F.lit(0.0))).otherwise(F.col("__m"))
    score = F.when(n == 1, F.col("__s")).otherwise(0.65 * F.col("__s") / n + 0.35 * worst)
    return g.join(n_queries, "query_id").select("query_id", *by, score.alias("score"))


def segment_topn_mean(frames: DataFrame, by: list[str], n: int = 3) -> DataFrame:
    """Segment score: mean of its best ``n`` frames; with frame count and the best frame's bounds.

    Ranking and aggregation share one shuffle: a segment holds a few seconds of frames.
    """
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("frame_idx"))
    g = frames.withColumn("__r", F.row_number().over(w)).groupBy(*by).agg(
        F.avg(F.when(F.col("__r") <= n, F.col("score"))).alias("score"), F.count("*").alias("frame_count"),
        F.min_by(F.struct("timestamp_ms", "segment_start_ms", "segment_end_ms"), "__r").alias("__b"))
    return g.select(*by, "score", "frame_count", F.col("__b.timestamp_ms").alias("best_ms"),
                    F.col("__b.segment_start_ms").alias("start_ms"), F.col("__b.segment_end_ms").alias("end_ms"))


def weight_of(modality: str = "modality", weights: dict | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in (weights or FUSION_WEIGHTS).items() for x in kv])
    return F.coalesce(table[F.col(modality)], F.lit(1.0))


def modality_max(members: DataFrame, by: list[str]) -> DataFrame:
    return members.groupBy(*by, "modality").agg(F.greatest(F.lit(-1.0), F.max("score")).alias("best"))


def weighted_fusion(best: DataFrame, by: list[str], weights: dict | None = None) -> DataFrame:
    """Weighted mean of the best score of each channel present."""
    w = weight_of(weights=weights)
    return best.groupBy(*by).agg((F.sum(w * F.col("best")) / F.sum(w)).alias("score"))


def decision_rank(c: str = "decision") -> Column:
    out = F.lit(len(DECISION_ORDER))
    for i, name in reversed(list(enumerate(DECISION_ORDER))):
        out = F.when(F.col(c) == name, i).otherwise(out)
    return out


def decision_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in (*DECISION_ORDER, "hit")]), rank + 1)


def group_rollup(members: DataFrame, by: list[str], weights: dict | None = None, evidence: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """One result per group of candidates: bounds, fused score, channels, best moment, decision, evidence.

    ``members`` columns: by, modality, unit_id, start_time, end_time, score[, best_ms, above_threshold, decision].
    Of equal scores the best moment is that of the first row by ``order``, columns of ``members``; by default start, then moment.
    Two aggregations: per (group, channel), then per group.
    """
    have = set(members.columns)
    m = members
    if "best_ms" not in have:
        m = m.withColumn("best_ms", F.lit(None).cast("long"))
    if "above_threshold" not in have:
        m = m.withColumn("above_threshold", F.lit(True))
    if "decision" not in have:
        m = m.withColumn("decision", F.lit("hit"))
    ev_cols = evidence or ["modality", "score", "start_time", "end_time", "unit_id"]
    ranked = F.when(F.col("best_ms").isNotNull(), F.struct(
        F.col("score").isNull(), ~F.isnan("score"), -F.col("score"), *[x for c in order or ["start_time"] for x in (F.col(c).isNull(), F.col(c))], F.col("best_ms").alias("ms")))
    g1 = m.groupBy(*by, "modality").agg(
        F.greatest(F.lit(-1.0), F.max("score")).alias("best"), F.min("start_time").alias("s"), F.max("end_time").alias("e"),
        F.bool_or("above_threshold").alias("a"), F.min(decision_rank()).alias("d"), F.min(ranked).alias("r"),
        F.collect_list(F.struct("start_time", "modality", "unit_id", *[c for c in ev_cols if c not in ("start_time", "modality", "unit_id")])).alias("ev"))
    w = weight_of(weights=weights)
    g2 = g1.groupBy(*by).agg(
        F.min("s").alias("start_time"), F.max("e").alias("end_time"),
        (F.sum(w * F.col("best")) / F.sum(w)).alias("score"),
        F.array_sort(F.collect_list("modality")).alias("modalities"),
        F.map_from_entries(F.collect_list(F.struct("modality", "best"))).alias("best_by_modality"),
        F.bool_or("a").alias("above_threshold"), F.min("d").alias("__d"), F.min("r").alias("__r"),
        F.array_sort(F.flatten(F.collect_list("ev"))).alias("evidence"))
    fallback = F.greatest(F.lit(0), F.bround(F.col("start_time") * 1000).cast("long"))
    return g2.withColumns({"decision": decision_name(F.col("__d")), "best_ms": F.coalesce(F.col("__r.ms"), fallback)}).drop("__d", "__r")


# --- vectors ----------------------------------------------------------------------------------

def vector_mean(df: DataFrame, by: list[str], col: str = "embedding", weight: str | None = None, normalize: bool = True,
                out: str = "centroid") -> DataFrame:
    """(Weighted) mean vector per group, accumulated in double, L2-normalised."""
    v = array_to_vector(F.col(col))
    agg = Summarizer.mean(v) if weight is None else Summarizer.mean(v, F.col(weight))
    g = df.groupBy(*by).agg(agg.alias("__m"))
    m = vector_to_array("__m")
    return g.select(*by, (l2_normalize(m) if normalize else m).alias(out))


def weighted_vector_mean(df: DataFrame, by: list[str], quality: str = "quality", col: str = "embedding") -> DataFrame:
    return vector_mean(df.withColumn("__w", F.greatest(F.col(quality).cast("double"), F.lit(0.1))), by, col, weight="__w")


def representative(members: DataFrame, centroids: DataFrame, by: list[str], key: str, quality: str | None = None) -> DataFrame:
    """Member closest to its group's centroid; with ``quality`` by 0.70 quality + 0.30 closeness."""
    d = members.join(centroids, by).withColumn("centrality", dot(l2_normalize("embedding"), F.col("centroid")))
    s = F.col("centrality") if quality is None else 0.70 * F.col(quality) + 0.30 * F.col("centrality")
    d = d.withColumn("rep_score", s)
    return d.groupBy(*by).agg(F.max_by(F.col(key), F.struct("rep_score", -F.col(key))).alias("representative"),
                              F.max("rep_score").alias("rep_score"))


def importance(duration_ms, occurrences, quality) -> Column:
    return (0.55 * F.log1p(duration_ms / 1000.0) + 0.25 * F.log1p(occurrences)
            + 0.20 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), quality)))


def identity_group_rollup(tracks: DataFrame, by: list[str]) -> DataFrame:
    """Screen time, occurrences, bounds and importance of each identity group of tracks.

    ``tracks``: by, start_ms, end_ms, detections, rep_quality (quality of the group's representative).
    """
    g = tracks.groupBy(*by).agg(
        F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("duration_ms"),
        F.sum(F.greatest(F.lit(1), F.col("detections"))).alias("occurrence_count"),
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.max("rep_quality").alias("rep_quality"))
    return g.withColumn("importance", importance(F.col("duration_ms"), F.col("occurrence_count"), F.col("rep_quality")))


def speaker_panel(utterances: DataFrame, labels: DataFrame | None = None, bindings: DataFrame | None = None) -> DataFrame:
    """Per (video, speaker): utterances, talk time, display label, hidden flag, bound entity."""
    by = ["video_id", "track_id"]
    g = utterances.where(F.col("track_id") >= 0).groupBy(*by).agg(
        F.count("*").alias("utterances"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))
    if labels is not None:
        g = g.join(labels.select(*by, "display_name", "hidden"), by, "left")
    else:
        g = g.withColumns({"display_name": F.lit(None).cast("string"), "hidden": F.lit(None).cast("long")})
    if bindings is not None:
        g = g.join(bindings.select(*by, "entity_id"), by, "left")
    return g.withColumns({"label": F.coalesce("display_name", F.concat(F.lit("Speaker "), F.col("track_id").cast("string"))),
                          "hidden": F.coalesce("hidden", F.lit(0)) == 1})


def best_per_utterance(hits: DataFrame, by=("query_id", "video_id", "utterance_idx")) -> DataFrame:
    """Best score of an utterance over several query vectors."""
    return hits.groupBy(*by).agg(F.max("score").alias("score"), F.max_by("query_idx", F.struct("score", -F.col("query_idx"))).alias("query_idx"))


# --- text -------------------------------------------------------------------------------------

def frame_text_agg(boxes: DataFrame, by: list[str], order: str) -> DataFrame:
    """Text of a frame: its non-blank boxes in reading order, with their mean score."""
    b = boxes.where(F.trim("text") != "")
    g = b.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.trim("text").alias("t")))).alias("__p"),
                           F.avg("score").alias("avg_box_score"))
    return g.select(*by, F.array_join(F.transform("__p", lambda p: p["t"]), " ").alias("text"), "avg_box_score")


def bm25_terms(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Tokens and length of each document."""
    return docs.select(*key, tokenize(text).alias("tokens")).withColumn("dl", F.size("tokens"))


def bm25_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents per term, with the corpus size and mean length on every row."""
    # one tokenising pass: the row of the empty term (which no text has) counts documents and their lengths
    rows = docs.select(tokenize(text).alias("t")).select(F.size("t").cast("long").alias("dl"), F.explode(F.concat(F.array_distinct("t"), F.array(F.lit("")))).alias("term"))
    stats = cut_lineage(rows.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term") == "", F.col("dl"))).alias("dl")))
    total = stats.where("term = ''").first() or {"df": 0, "dl": 0}
    n, dl = total["df"], total["dl"]
    return stats.where("term <> ''").select("term", "df", F.lit(n).cast("long").alias("n_docs"), F.lit(dl / n if n else 0.0).alias("avgdl"))


def text_profile(units: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    d = with_normalized(units.select(*by, text), text)
    d = d.select(*by, quality_of("__n", "__c")["eligible"].alias("ok"), (F.col("__n") == "").alias("empty"), *[c.alias(k) for k, c in char_profile("__n").items()])
    return d.groupBy(*by).agg(
        F.count("*").alias("chunks"), F.count_if("empty").alias("empty_chunks"), F.sum("cjk_chars").alias("cjk_chars"),
        F.sum("latin_chars").alias("latin_chars"), F.sum("digit_chars").alias("digit_chars"), F.count_if("ok").alias("eligible_chunks"))


def language_vote(probes: DataFrame, by: list[str]) -> DataFrame:
    """Language with most votes, then highest summed probability."""
    p = probes.withColumn("language", F.lower(F.trim("language"))).where(F.col("language") != "")
    g = p.groupBy(*by, "language").agg(F.count("*").alias("votes"), F.sum(F.coalesce("probability", F.lit(0.0))).alias("mass"))
    best = g.groupBy(*by).agg(F.max_by(F.struct("language", "votes", "mass"), F.struct("votes", "mass", "language")).alias("b"))
    return best.select(*by, F.col("b.language").alias("language"), (F.col("b.mass") / F.col("b.votes")).alias("probability"))


# --- checks -----------------------------------------------------------------------------------

def visual_health(frames: DataFrame) -> DataFrame:
    """Per (video, version): rows, rows with bad bounds, and segments whose rows disagree."""
    by = ["video_id", "asset_version"]
    bad = ~F.coalesce((F.col("segment_start_ms") >= 0) & (F.col("segment_end_ms") > F.col("segment_start_ms"))
                      & F.col("timestamp_ms").between(F.col("segment_start_ms"), F.col("segment_end_ms")), F.lit(False))
    seg = frames.groupBy(*by, "segment_id").agg(
        F.count("*").alias("n"), F.count_if(bad).alias("bad"),
        ((F.min("segment_start_ms") != F.max("segment_start_ms")) | (F.min("segment_end_ms") != F.max("segment_end_ms"))).alias("mixed"))
    return seg.groupBy(*by).agg(F.sum("n").alias("rows"), F.sum("bad").alias("invalid_rows"), F.count_if("mixed").alias("conflicting_segments"))


def contiguity_check(df: DataFrame, by: list[str], idx: str, declared: DataFrame | None = None) -> DataFrame:
    """Is the index set exactly 0..n-1 without repeats (and n as declared)?

    0..n-1 without repeats holds when min = 0, max = n-1 and the sums of i and i*i match.
    """
    n, i = F.count("*"), F.col(idx).cast("decimal(38,0)")
    g = df.groupBy(*by).agg(n.alias("n"), F.min(idx).alias("lo"), F.max(idx).alias("hi"), F.sum(i).alias("s1"), F.sum(i * i).alias("s2"))
    d = F.col("n").cast("decimal(38,0)")
    ok = ((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("s1") * 2 == d * (d - 1))
          & (F.col("s2") * 6 == d * (d - 1) * (2 * d - 1)))
    if declared is not None:
        g = g.join(declared.select(*by, F.col("row_count").alias("declared")), by, "left")
        ok = ok & F.coalesce(F.col("declared") == F.col("n"), F.lit(False))
    return g.select(*by, "n", ok.alias("contiguous"))


def dedupe_or_conflict(df: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Equal repeats of a key collapse to one row; unequal ones mark it as a conflict."""
    s = F.struct(*values)
    g = df.groupBy(*key).agg(F.min(s).alias("__v"), (F.min(s) != F.max(s)).alias("conflict"))
    return g.select(*key, *[F.col(f"__v.{c}").alias(c) for c in values], "conflict")


def track_id_universe(utterances: DataFrame, overlays: DataFrame) -> DataFrame:
    auto = utterances.select("video_id", "track_id")
    named = overlays.select("video_id", F.col("corrected_track_id").alias("track_id"))
    return auto.unionByName(named).where(F.col("track_id") >= 0).distinct()


def version_select(counts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Which stored version a channel publishes.

    ``counts``: video_id, modality, asset_version, rows; ``manifest``: video_id, modality, version, declared.
    A named version must exist with the declared rows; without a name, none gives an empty marker
    and several are refused.
    """
    key = ["video_id", "modality"]
    g = counts.groupBy(*key).agg(F.count("*").alias("versions"), F.min("asset_version").alias("only"), F.min("rows").alias("only_rows"))
    named = counts.select(*key, F.col("asset_version").alias("version"), F.col("rows").alias("named_rows"))
    j = manifest.join(g, key, "left").join(named, [*key, "version"], "left")
    n = F.coalesce("versions", F.lit(0))
    has_name = F.trim(F.coalesce("version", F.lit(""))) != ""
    d = F.col("declared")
    rows = F.when(has_name, F.coalesce("named_rows", F.lit(0))).when(n == 1, F.col("only_rows")).otherwise(F.lit(0))
    verdict = (F.when(has_name & (n > 0) & F.col("named_rows").isNull(), "version_has_no_rows")
               .when(~has_name & (n > 1), "ambiguous")
               .when(d.isNotNull() & (d != rows), "row_count_mismatch")
               .when(has_name, "manifest").when(n == 0, "empty").otherwise("scan"))
    good = verdict.isin("manifest", "empty", "scan")
    chosen = F.when(has_name, F.col("version")).when(n == 1, F.col("only")).otherwise(F.lit("empty"))
    return j.select(*key, F.when(good, chosen).alias("asset_version"), F.when(good, rows).alias("rows"), verdict.alias("verdict"))


def indexed_models(pointers: DataFrame) -> DataFrame:
    """Query encoders the ready channels need; a text encoder only where its vectors are complete."""
    m = F.when(F.col("modality") == "visual", F.col("model_key")).when(
        F.col("modality").isin("asr", "ocr") & (F.col("semantic_status") == "complete"), F.col("semantic_model_key"))
    return pointers.where((F.col("status") == "ready") & (F.col("row_count") > 0)).select("modality", m.alias("model")).where(
        "model IS NOT NULL").distinct()


def table_fingerprint(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Order-free digest: per 64-bit word of each row's SHA-256 the XOR and the exact sum, with a count."""
    h = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    d = df.select(*(by or []), h.alias("h"))
    words = [F.conv(F.substring("h", 1 + 16 * i, 16), 16, -10).cast("long") for i in range(4)]
    d = d.select(*(by or []), *[w.alias(f"w{i}") for i, w in enumerate(words)])
    return d.groupBy(*(by or [])).agg(
        F.count("*").alias("rows"), *[F.bit_xor(f"w{i}").alias(f"x{i}") for i in range(4)],
        *[F.sum(F.col(f"w{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)])


# --- evaluation -------------------------------------------------------------------------------

KS = (1, 3, 5, 10, 20)


def ranking_metrics(rows: DataFrame, ks=KS, by: str | None = None) -> DataFrame:
    """Hit rate and macro / micro segment recall at each k, overall or also per category.

    ``rows``: query_id, [by], truth, first_hit (null when none), matched: map<int,long>, failed.
    """
    good = rows.where("NOT failed").select("*", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    hit = F.coalesce(F.col("first_hit") <= F.col("k"), F.lit(False)).cast("double")
    got = F.col("matched")[F.col("k")]
    aggs = [F.count("*").alias("queries"), F.avg(hit).alias("hit"), F.avg(got / F.col("truth")).alias("macro_recall"),
            (F.sum(got) / F.sum("truth")).alias("micro_recall")]
    if by is None:
        return good.groupBy("k").agg(*aggs)
    return good.groupingSets([[F.col(by), F.col("k")], [F.col("k")]], F.col(by), F.col("k")).agg(*aggs)


def latency_percentiles(rows: DataFrame, by: list[str], col: str) -> DataFrame:
    """Exact interpolated median and 95th percentile, and the mean; no task holds a group's distinct values."""
    return percentiles(rows, by, col, {"p50": 0.5, "p95": 0.95}).drop("n")


def stage_timing_rollup(trace: DataFrame) -> DataFrame:
    return trace.groupBy("category", "name").agg(F.sum("seconds").alias("seconds"), F.sum("counter").alias("counter"), F.count("*").alias("spans"))


