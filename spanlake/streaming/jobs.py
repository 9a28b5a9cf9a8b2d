"""Structured Streaming forms of the time-ordered operators."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.identity import TRACK_SCHEMA, TrackState, track_row
from ..operators.quantiles import sketch_bucket, sketch_quantile
from ..sources.writers import upsert_buckets


def fixed_segments(events: DataFrame, by: list[str], ts: str = "ts", width: str = "5 seconds", lateness: str = "10 seconds") -> DataFrame:
    """Scores per tumbling segment: count, mean and best. Rows later than the watermark are dropped."""
    return (events.withWatermark(ts, lateness).groupBy(*by, F.window(ts, width).alias("w"))
            .agg(F.count("*").alias("frames"), F.avg("score").alias("mean_score"), F.max("score").alias("best_score"))
            .select(*by, F.col("w.start").alias("seg_start"), F.col("w.end").alias("seg_end"), "frames", "mean_score", "best_score"))


def top_segments(events: DataFrame, by: list[str], idx: str, ts: str = "ts", width_ms: int = 5000, n: int = 3, lateness: str = "10 seconds") -> DataFrame:
    """Segments of ``width_ms`` scored by the mean of their best ``n`` rows (ties: smaller ``idx``), in append mode.

    State is the best ``n`` rows and a count for each open segment, whatever it reads; a segment leaves
    when the watermark passes its end. A row with a null score counts for nothing but moves the watermark,
    so one such row of a later time at the end of the input flushes all segments. Rows without a time are ignored.
    """
    kinds = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in by)

    def step(key, batches, state: GroupState):
        scores, ids, count = state.get if state.exists else ([], [], 0)
        best = list(zip(scores, ids))
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(*key, sum(scores) / len(scores), count, ids[0])], columns=names)
            return
        for pdf in batches:
            rows = pdf[pdf["score"].notna()]
            count += len(rows)
            rows = rows.sort_values(["score", idx], ascending=[False, True]).head(n)
            best = sorted([*best, *zip(rows["score"].tolist(), rows[idx].tolist())], key=lambda r: (-r[0], r[1]))[:n]
        if best:
            state.update(([r[0] for r in best], [r[1] for r in best], count))
            state.setTimeoutTimestamp(max((int(key[-1]) + 1) * width_ms, int(state.getCurrentWatermarkMs()) + 1))

    names = [*by, "seg", "score", "frame_count", "best"]
    d = events.where(F.col(ts).isNotNull()).withWatermark(ts, lateness).select(*by, ts, "score", F.col(idx).cast("long").alias(idx), F.floor(F.unix_millis(ts) / F.lit(width_ms)).cast("long").alias("seg"))
    return d.groupBy(*by, "seg").applyInPandasWithState(step, f"{kinds}, seg long, score double, frame_count long, best long",
                                                        "scores array<double>, ids array<long>, n long", "append", GroupStateTimeout.EventTimeTimeout)


def gap_sessions(events: DataFrame, by: list[str], ts: str = "ts", gap: str = "2 seconds", lateness: str = "10 seconds") -> DataFrame:
    """Sessions of events no further apart than ``gap``."""
    return (events.withWatermark(ts, lateness).groupBy(*by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events"))
            .select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events"))


def capped_sessions(intervals: DataFrame, key: str, gap: float, cap: float, lateness: str = "10 seconds", buckets: int = 1024) -> DataFrame:
    """Speech intervals (key, start, end seconds, ts) merged while the pause is at most ``gap`` and the whole at most ``cap``.

    An interval waits in state until the watermark passes its start, so late ones still find their place;
    then the fold runs over the settled ones and a session leaves once nothing can join it.

    A call of the fold costs milliseconds, whatever it reads, so a state holds the keys of one of ``buckets`` hash buckets: the number
    of calls does not grow with that of the keys. Only keys with an open session or a waiting interval are held.
    """
    import pickle
    kind = intervals.schema[key].dataType

    def step(_, batches, state: GroupState):
        held = pickle.loads(state.get[0]) if state.exists else {}
        for pdf in batches:
            for name, s, e in zip(pdf["name"].tolist(), pdf["start"].tolist(), pdf["end"].tolist()):
                held.setdefault(name, ([], None, None, 0))[0].append((s, e))
        mark = state.getCurrentWatermarkMs() / 1000.0
        out, left, wake = [], {}, None
        for name, (waiting, open_s, open_e, n) in held.items():
            settled, waiting = sorted(w for w in waiting if w[0] < mark), sorted(w for w in waiting if w[0] >= mark)
            for s, e in settled:
                if open_s is not None and max(0.0, s - open_e) <= gap and e - open_s <= cap:
                    open_e, n = e, n + 1
                    continue
                if open_s is not None:
                    out.append((name, open_s, open_e, n))
                open_s, open_e, n = s, e, 1
            if open_s is not None and open_e + gap < mark:
                out.append((name, open_s, open_e, n))
                open_s, open_e, n = None, None, 0
            if waiting or open_s is not None:
                left[name] = (waiting, open_s, open_e, n)
                # wake up when the first waiting interval settles, or when the open session can end
                own = waiting[0][0] if waiting else open_e + gap
                wake = own if wake is None else min(wake, own)
        if left:
            state.update((pickle.dumps(left),))
            state.setTimeoutTimestamp(max(int(wake * 1000) + 1, int(state.getCurrentWatermarkMs()) + 1))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["name", "start", "end", "intervals"])

    # the key as text: pandas would turn whole numbers with a null among them into floating ones
    rows = intervals.withWatermark("ts", lateness).select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), F.col(key).cast("string").alias("name"), "start", "end", "ts")
    found = rows.groupBy("bucket").applyInPandasWithState(step, "name string, start double, end double, intervals long", "blob binary", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("name").cast(kind).alias(key), "start", "end", "intervals")


def tracks(detections: DataFrame, key: str, fps: float = 2.0, max_gap: float = 1.5, cos: float = 0.35, lateness: str = "5 seconds") -> DataFrame:
    """Detection stream (key, det_id, ts timestamp, t seconds, det_score, quality, bbox, embedding) to finished tracks.

    ``t`` is ``ts`` in seconds and starts above 0 (Spark counts the epoch itself as late).
    Detections are held until the watermark passes them and are then placed in time order; a track leaves
    ``max_gap`` after its end. State is the open tracks and the detections inside the lateness window.
    """
    import pickle
    kind = detections.schema[key].dataType.simpleString()
    names = ["det_id", "t", "det_score", "quality", "bbox", "embedding"]

    def step(k, batches, state: GroupState):
        held, model = [], TrackState(max_gap, cos, 1.0 / fps)
        if state.exists:
            held, model.open = pickle.loads(state.get[0])
        for pdf in batches:
            for row in zip(*(pdf[c].tolist() for c in names)):
                r = dict(zip(names, row))
                r["ts"] = r["t"]
                held.append(r)
        mark = state.getCurrentWatermarkMs() / 1000.0
        # a frame settles as a whole, so no frame is split between two calls
        held.sort(key=lambda r: (r["ts"], -r["det_score"], r["det_id"]))
        ready = [r for r in held if r["ts"] < mark]
        held = held[len(ready):]
        done = [t for r in ready for t in model.add(r)]
        # nothing before the watermark can arrive any more
        done += model.expire(mark)
        if held or model.open:
            state.update((pickle.dumps((held, model.open)),))
            wake = min([r["ts"] for r in held[:1]] + [t["end"] + max_gap for t in model.open])
            state.setTimeoutTimestamp(max(int(wake * 1000) + 1, int(state.getCurrentWatermarkMs()) + 1))
        else:
            state.remove()
        rows = [{key: k[0], **track_row(t)} for t in done]
        yield pd.DataFrame(rows, columns=[key, *[c.strip().split(" ")[0] for c in TRACK_SCHEMA.split(", ")]])

    return detections.withWatermark("ts", lateness).groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, {TRACK_SCHEMA}", "blob binary", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_sink(stream: DataFrame, path: str, key: list[str], attempt: str, ts: str, lateness: str, checkpoint: str, buckets: int = 64):
    """Idempotent upserts: repeats inside the lateness window are dropped, every batch merges into the key buckets that it touches."""
    def merge(batch: DataFrame, batch_id: int):
        upsert_buckets(batch, path, key, attempt, batch_id, buckets)

    d = stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([*key, attempt])
    return d.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def trace_metrics(traces: DataFrame, by: list[str], ts: str = "ts", size: str = "1 hour", slide: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Sliding-window latency percentiles of trace rows."""
    return (traces.withWatermark(ts, lateness).groupBy(*by, F.window(ts, size, slide).alias("w"))
            .agg(F.count("*").alias("n"), F.expr("percentile(seconds, 0.5)").alias("p50"), F.expr("percentile(seconds, 0.95)").alias("p95"))
            .select(*by, F.col("w.start").alias("w_start"), "n", "p50", "p95"))


def trace_sketch(traces: DataFrame, by: list[str], ts: str = "ts", size: str = "1 hour", slide: str = "30 minutes", lateness: str = "1 hour", error: float = 0.01) -> DataFrame:
    """Sliding-window latency percentiles within the relative ``error``, in append mode.

    State is one count for each (group, window, bucket). Buckets grow geometrically, so a window has
    at most ln(largest / smallest) / ln((1 + error) / (1 - error)) of them (about 700 for microseconds
    to seconds at 0.01), however many rows or distinct values it sees; counts of two states add up.
    Null latencies do not count; those of zero and less count as 0.
    """
    counts = (traces.where(F.col("seconds").isNotNull()).withWatermark(ts, lateness)
              .groupBy(*by, F.window(ts, size, slide).alias("w"), sketch_bucket("seconds", error).alias("bucket")).agg(F.count("*").alias("n")))
    return (counts.groupBy(*by, "w").agg(F.sum("n").alias("n"), F.collect_list(F.struct("bucket", "n")).alias("__c"))
            .select(*by, F.col("w.start").alias("w_start"), "n", sketch_quantile("__c", 0.5, error).alias("p50"), sketch_quantile("__c", 0.95, error).alias("p95")))


def run_to_files(stream: DataFrame, path: str, mode: str = "append"):
    """Process everything that is available and leave the rows in ``path``. Complete results go through a batch writer."""
    if mode == "complete":
        q = stream.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path))
    else:
        q = stream.writeStream.outputMode(mode).format("parquet").option("path", path)
    q = q.option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


