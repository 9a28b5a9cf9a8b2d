"""Hard negatives by exact maximum inner products within bounds, pruned by length and by coordinates.

Rows are dealt into chunks of about CHUNK rows and meet the anchors there. A chunk sorts its rows by length and cuts them
into buckets, longest first; a bucket holds, for every coordinate of its rows' directions, the rows sorted by that
coordinate. An anchor with threshold t skips a bucket whose longest row cannot reach t (and, as buckets only get shorter,
all later ones). Otherwise every row with a score of t or more has a cosine of c = t / (anchor's length x longest row) or more,
so its direction lies, in coordinate f, within a_f c -+ sqrt((1 - a_f^2)(1 - c^2)). The rows in that range of the sorted list of
each focus coordinate (those where the anchor's direction is largest) are intersected, and what is left is verified with
whole vectors. The threshold rises with what a chunk has found.

Positives need the rows of the anchor's label only, so chunks are dealt within labels, negatives those of all labels. A hot
label has more chunks, and its anchors are dealt into groups too; a task holds one chunk and one group of anchors.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

POSITIVES, NEGATIVES = 5, 5
#: A negative's score, in percent of the positive's, lies between these.
LOW, HIGH = 80, 100
#: Rows of a chunk and of a bucket, anchors of a group (all on average), focus coordinates.
CHUNK, BUCKET, GROUP, FOCUS = 16_384, 1_024, 1_024, 6
#: A score is exact while it and all its partial sums stay below this.
EXACT = 2.0 ** 53
#: By so much a bound may be off in the last bits (a square root doubles their number).
SLACK = 1e-7
#: With so many keys or fewer, the numbers of chunks travel with the tasks.
KEYS = 100_000


def quantised(vec: Column) -> Column:
    """floor(256 x) of every component, as double; null unless all components are there and finite."""
    x = vec.cast("array<double>")
    fine = vec.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(fine, F.transform(x, lambda v: F.floor(v * 256.0).cast("double")))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of ``width``; shorter ones are filled up with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


class Bucket:
    """Rows of like length with one sorted list for each coordinate of their directions."""

    def __init__(self, ids, labels, rows, lengths):
        self.ids, self.labels, self.rows, self.longest = ids, labels, rows, float(lengths.max(initial=0.0))
        direction = rows / np.where(lengths > 0, lengths, 1.0)[:, None]
        self.order = np.argsort(direction, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(direction, self.order, axis=0)

    def candidates(self, direction: np.ndarray, focus: np.ndarray, cosine: float) -> np.ndarray | None:
        """Rows whose direction may have ``cosine`` or more with the anchor's; None stands for all rows."""
        n, hits, used = len(self.ids), None, 0
        for f in focus if cosine > 0 else ():
            at = direction[f]
            reach = np.sqrt(max(0.0, (1 - at * at) * (1 - cosine * cosine))) + SLACK
            column = self.sorted[:, f]
            lo = 0 if at <= -cosine else np.searchsorted(column, at * cosine - reach, "left")
            hi = n if at >= cosine else np.searchsorted(column, at * cosine + reach, "right")
            if hi - lo == n:
                continue
            hits = np.zeros(n, np.int8) if hits is None else hits
            hits[self.order[lo:hi, f]] += 1
            used += 1
        return None if hits is None else np.flatnonzero(hits == used)


def buckets(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, size: int = BUCKET) -> list[Bucket]:
    """Buckets of decreasing length."""
    lengths = np.linalg.norm(rows, axis=1)
    order = np.lexsort((ids, -lengths))
    return [Bucket(ids[o], labels[o], rows[o], lengths[o]) for o in (order[a:a + size] for a in range(0, len(order), size))]


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best, by falling score and rising id; an id counts once."""
    if len(ids) > 4 * k:  # ties at the edge stay
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        if len(np.unique(ids[keep])) >= k:
            ids, scores = ids[keep], scores[keep]
        else:
            keep = np.arange(len(ids))
    else:
        keep = np.arange(len(ids))
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    return keep[order[np.sort(first)[:k]]]


class _Anchor:
    """What is looked for: label, direction, focus coordinates, and for each limit (highest, lowest score) the best so far."""

    def __init__(self, anchor_id, label, row, limits, k):
        self.id, self.label, self.row, self.k = anchor_id, label, row, k
        self.length = float(np.sqrt(row @ row))
        self.direction = row / self.length if self.length else row
        self.focus = np.argsort(-np.abs(self.direction), kind="stable")[:FOCUS]
        self.limits = limits
        self.found = [(np.zeros(0, np.int64), np.zeros(0)) for _ in limits]
        self.least = min((lo for lo, _ in limits), default=np.inf)

    def visit(self, bucket: Bucket, alike: bool, count: np.ndarray) -> None:
        """``count``: rows seen, rows verified."""
        t, reach = self.least, self.length * bucket.longest * (1 + SLACK)
        count[0] += len(bucket.ids)
        if t > reach:
            return
        some = bucket.candidates(self.direction, self.focus, t / reach if t > 0 else 0.0)
        fit = (bucket.labels == self.label) & (bucket.ids != self.id) if alike else bucket.labels != self.label
        at = np.flatnonzero(fit) if some is None else some[fit[some]]
        count[1] += len(at)
        if not len(at):
            return
        rows = bucket.rows if len(at) == len(bucket.ids) else bucket.rows[at]
        scores, ids = rows @ self.row, bucket.ids[at]
        hit = scores >= t
        scores, ids = scores[hit], ids[hit]
        for n, (lo, hi) in enumerate(self.limits):
            fits = (scores >= lo) & (scores <= hi)
            if fits.any():
                all_ids, all_scores = np.concatenate([self.found[n][0], ids[fits]]), np.concatenate([self.found[n][1], scores[fits]])
                at = best(all_ids, all_scores, self.k)
                self.found[n] = all_ids[at], all_scores[at]
        self.least = min(max(lo, s[-1]) if len(s) == self.k else lo for (lo, _), (_, s) in zip(self.limits, self.found))


def search(anchors: list[_Anchor], rows: list[Bucket], alike: bool) -> np.ndarray:
    """Every anchor through the buckets, longest first; (rows seen, rows verified)."""
    count = np.zeros(2, np.int64)
    for b in rows:
        for a in anchors:
            a.visit(b, alike, count)
    return count


def deal(anchors: DataFrame, rows: DataFrame, keys: list[str], anchor_id: str, row_id: str, group: int, chunk: int | None):
    """Both sides grouped so that every anchor meets every row of its ``keys`` once, in groups of bounded size.

    A key gets as many chunks as its rows fill (one, if ``chunk`` is None) and as many groups as its anchors fill.
    """
    names = keys or ["__all"]
    if not keys:
        anchors, rows = anchors.withColumn("__all", F.lit(0)), rows.withColumn("__all", F.lit(0))
    parts = lambda n, most: F.greatest(F.lit(1), F.ceil(F.col(n) / most)).cast("int") if most else F.lit(1)
    sizes = rows.groupBy(*names).agg(F.count("*").alias("__n")).join(anchors.groupBy(*names).agg(F.count("*").alias("__m")), names)
    sizes = C.cut(sizes.select(*names, parts("__n", chunk).alias("__chunks"), parts("__m", group).alias("__groups")))
    sizes = F.broadcast(sizes) if sizes.count() <= KEYS else sizes
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda i, n: F.pmod(F.xxhash64(i), F.col(n)).cast("int")
    left = anchors.join(sizes, names).withColumn("__group", dealt(anchor_id, "__groups")).withColumn("__chunk", every("__chunks")).drop("__chunks", "__groups")
    right = rows.join(sizes, names).withColumn("__chunk", dealt(row_id, "__chunks")).withColumn("__group", every("__groups")).drop("__chunks", "__groups")
    by = [*names, "__chunk", "__group"]
    # new names of columns, as both may stem from the same rows
    return left.toDF(*left.columns).groupBy(*by), right.toDF(*right.columns).groupBy(*by)


def _meet(rows: DataFrame, anchors: DataFrame, keys: list[str], width: int, alike: bool, k: int, with_limits: bool, chunk: int, group: int) -> DataFrame:
    """Best rows for each anchor and limit in every chunk: anchor_id, place of the limit, id, score."""
    left, right = deal(anchors, rows, keys, "vec_id", "vec_id", group, chunk)
    schema = pa.schema([("anchor_id", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("score", pa.float64())])

    def pair(a: pa.Table, r: pa.Table) -> pa.Table:
        if not a.num_rows or not r.num_rows:
            return schema.empty_table()
        limits = [[(x["lo"], x["hi"]) for x in ls] for ls in a.column("limits").to_pylist()] if with_limits else [[(-np.inf, np.inf)]] * a.num_rows
        some = [_Anchor(*x, k) for x in zip(a.column("vec_id").to_pylist(), a.column("label").to_pylist(), matrix(a.column("v"), width), limits)]
        search(some, buckets(r.column("vec_id").to_numpy(), r.column("label").to_numpy(), matrix(r.column("v"), width)), alike)
        out = [(x.id, n, i, s) for x in some for n, (ids, scores) in enumerate(x.found) for i, s in zip(ids.tolist(), scores.tolist())]
        return pa.table([pa.array([o[c] for o in out], f.type) for c, f in enumerate(schema)], schema=schema)

    return left.cogroup(right).applyInArrow(pair, "anchor_id bigint, place int, id bigint, score double")


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    once = found.groupBy(*keys, "id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
                   chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """Per anchor and positive the best negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, label, embedding. Components become floor(256 x); a score is the inner product. An anchor's positives are its
    ``positives`` best other rows of its label; the negatives of a pair are the ``negatives`` best rows of other labels with
    ``low`` * positive_score <= 100 * negative_score <= ``high`` * positive_score. Ties go to the smaller vec_id.

    Rows without id, label or vector, or with a component that is null or not finite, take no part; an empty table gives no
    row. A shorter vector is filled up with zeros. A repeated vec_id counts once on a list, with its best score; of anchors
    with one id the one with the smallest label and vector searches. Anchors without a positive or a fitting negative
    have no row. Scores are exact below 2^53; components that could pass that are an error. Other columns are ignored.
    """
    good = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), quantised(F.col("embedding")).alias("v"), is_anchor.alias("__anchor"))
    good = good.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    size = good.agg(F.max(F.size("v")).alias("w"), F.max(F.array_max(F.transform("v", F.abs))).alias("x")).first()
    width = max(1, size.w or 0)
    if width * (size.x or 0.0) ** 2 >= EXACT:
        raise ValueError("components are too large for exact scores")
    anchors = C.cut(good.where("__anchor").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a")).select("vec_id", "a.*"))
    good = good.drop("__anchor")

    found = _meet(good, anchors, ["label"], width, True, positives, False, chunk, group)
    pos = C.cut(_ranked(found, ["anchor_id"], positives).select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place")))
    # scores are integers, so each bound is the nearest integer within
    ps = F.col("positive_score").cast("bigint")
    hundredth = lambda n: (n - F.pmod(n, F.lit(100))) / 100  # noqa: E731  rounded down; exact
    limit = F.struct((-hundredth(-ps * low)).alias("lo"), hundredth(ps * high).alias("hi"))
    limits = pos.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", limit.alias("x")))).alias("l")).select(
        F.col("anchor_id").alias("vec_id"), F.transform("l", lambda x: x["x"]).alias("limits"))
    found = _meet(good, anchors.join(limits, "vec_id"), [], width, False, negatives, True, chunk, group)
    neg = _ranked(found, ["anchor_id", "place"], negatives)
    return neg.join(pos.withColumn("place", F.col("place") - 1), ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        F.col("positive_score").cast("bigint").alias("positive_score"), F.col("score").cast("bigint").alias("negative_score"))
