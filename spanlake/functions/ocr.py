"""Box geometry and screen-text quality. A box is array<struct<x,y>> of four corners."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bbox_bounds(box) -> Column:
    b = _c(box)
    xs, ys = F.transform(b, lambda p: p["x"]), F.transform(b, lambda p: p["y"])
    return F.when(F.size(b) == 4, F.struct(
        F.array_min(xs).alias("left"), F.array_min(ys).alias("top"),
        F.array_max(xs).alias("right"), F.array_max(ys).alias("bottom")))


def polygon_area(box) -> Column:
    """Shoelace area; 0 without a proper box."""
    b = _c(box)
    nxt = F.concat(F.slice(b, 2, 3), F.slice(b, 1, 1))
    terms = F.zip_with(b, nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    area = F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2
    return F.when(F.size(b) == 4, area).otherwise(F.lit(0.0))


def bbox_iou(a, b) -> Column:
    """Intersection over union of struct<x1,y1,x2,y2> boxes."""
    a, b = _c(a), _c(b)

    def area(x):
        return F.greatest(F.lit(0.0), x["x2"] - x["x1"]) * F.greatest(F.lit(0.0), x["y2"] - x["y1"])

    inter = (F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
             * F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])))
    return inter / F.greatest(F.lit(1e-6), area(a) + area(b) - inter)


def detection_quality(det_score, bbox, width, height, sharpness) -> Column:
    """Half detector score, a quarter relative size, the rest sharpness and distance to the border."""
    b, w, h = _c(bbox), _c(width), _c(height)
    x1, y1, x2, y2 = (F.floor(b[k]) for k in ("x1", "y1", "x2", "y2"))
    area = F.greatest(F.lit(0), x2 - x1) * F.greatest(F.lit(0), y2 - y1)
    size = F.least(F.lit(1.0), F.sqrt(area / F.greatest(F.lit(1.0), w * h)) / 0.35)
    margin = F.least(x1, y1, w - x2, h - y2)
    border = F.least(F.lit(1.0), F.greatest(F.lit(0.0), margin) / F.greatest(F.lit(1.0), 0.08 * F.least(w, h)))
    return 0.50 * _c(det_score) + 0.25 * size + 0.15 * _c(sharpness) + 0.10 * border


def ocr_item_quality(text, score, box, width, height) -> Column:
    """True when a recognised box is worth indexing."""
    t, s = _c(text), _c(score)
    compact = F.replace(t, F.lit(" "), F.lit(""))
    noise = (
        (t == "") | (s <= 0) | ~t.rlike(r"[\p{L}\p{N}]")
        | ((F.length(compact) <= 1) & (s < 0.85))
        | compact.rlike(r"^(.)\1{3,}$")
        | (compact.rlike(r"^\d{1,2}$") & (s < 0.8)))
    b = bbox_bounds(box)
    w, h = F.greatest(b["right"] - b["left"], F.lit(0.0)), F.greatest(b["bottom"] - b["top"], F.lit(0.0))
    aspect = w / F.greatest(h, F.lit(1.0))
    ratio = polygon_area(box) / F.greatest(_c(width) * _c(height), F.lit(1.0))
    odd = (w < 2) | (h < 2) | (aspect > 40) | (aspect < 0.025) | ((ratio < 0.00001) & (s < 0.9))
    return ~noise & ~F.coalesce(odd, F.lit(False))
