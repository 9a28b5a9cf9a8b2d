"""Time columns: milliseconds inside a video as long, seconds as double."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ms_to_s(ms) -> Column:
    return _c(ms) / 1000.0


def temporal_gap(s1, e1, s2, e2) -> Column:
    """Distance between two intervals, 0 when they meet."""
    return F.greatest(_c(s2) - _c(e1), _c(s1) - _c(e2), F.lit(0.0))


def interval_overlap(s1, e1, s2, e2) -> Column:
    """Strict overlap: touching is not enough."""
    return (_c(s2) < _c(e1)) & (_c(e2) > _c(s1))


def expand_window(start, end, duration, window) -> tuple[Column, Column]:
    """Widen around the centre to ``window`` seconds inside [0, duration]; longer spans stay."""
    s = F.greatest(F.lit(0.0), _c(start))
    e = F.greatest(s, _c(end))
    w = _c(window) if not isinstance(window, (int, float)) else F.lit(float(window))
    dur = F.greatest(e, F.coalesce(_c(duration), e))
    left = F.greatest(F.lit(0.0), (s + e) / 2 - w / 2)
    right = F.least(dur, left + w)
    left = F.greatest(F.lit(0.0), right - w)
    keep = (w <= 0) | (e - s >= w)
    return F.when(keep, _c(start)).otherwise(F.round(left, 3)), F.when(keep, _c(end)).otherwise(F.round(right, 3))


def sample_timestamps(start, end, n, duration=None) -> Column:
    """Mid-points of ``n`` equal parts of the span, kept inside the video."""
    s = F.greatest(F.lit(0.0), _c(start))
    e = F.greatest(s + 0.05, _c(end))
    dur = F.greatest(F.lit(0.0), F.coalesce(_c(duration), e) if duration is not None else e)
    e = F.when(dur > 0, F.least(e, dur)).otherwise(e)
    span = F.greatest(F.lit(0.05), e - s)
    count = _c(n) if not isinstance(n, int) else F.lit(n)
    top = F.greatest(F.lit(0.0), dur - 0.01)
    return F.transform(F.sequence(F.lit(0), count - 1),
                       lambda i: F.least(F.greatest(F.lit(0.0), s + span * (i + 0.5) / count), top))


def fixed_bucket(ts_ms, duration_ms, width_ms: int) -> Column:
    """Tumbling segment of a frame; a frame exactly at the end belongs to the last segment."""
    return F.floor(F.least(_c(ts_ms), _c(duration_ms) - 1) / F.lit(width_ms)).cast("long")


def frame_window(df, ts_ms: str, duration_ms: str, fps: float):
    """Each sampled frame as [t, min(t + 1/fps, duration)); frames outside the video are dropped."""
    end = F.least(F.col(duration_ms), F.col(ts_ms) + F.lit(int(round(1000.0 / fps))))
    return df.withColumns({"start_ms": F.col(ts_ms), "end_ms": end}).where(
        (F.col(ts_ms) >= 0) & (F.col(ts_ms) < F.col(duration_ms)) & (F.col("end_ms") > F.col("start_ms")))


def offset_items(items, units):
    """Shift unit-local items onto the video's clock. ``units``: video_id, unit_id, offset_ms."""
    return items.join(units, ["video_id", "unit_id"]).withColumns({
        "start_ms": F.col("start_ms") + F.col("offset_ms"), "end_ms": F.col("end_ms") + F.col("offset_ms")}).drop("offset_ms")


def parse_timecode(text) -> Column:
    """'[h:]mm:ss,mmm' to seconds; null when there is no time code."""
    t = _c(text)
    rx = r"(?:(\d+):)?(\d{2}):(\d{2})[,.](\d{3})"

    def part(i):
        return F.coalesce(F.nullif(F.regexp_extract(t, rx, i), F.lit("")).cast("double"), F.lit(0.0))

    return F.when(t.rlike(rx), part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000)
