"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the least of its inner s-mers (by hash) is the first or the last.
That depends on the k-mer alone, so two texts choose the same anchors in what they share, whatever stands around.
A fingerprint holds the ANCHORS smallest hashes of a text's distinct anchors, in the order of their places; short
texts keep all. Likeness is the share of common hashes among the smallest of both, of which only those count
that lie in the same order in both texts (longest increasing run of places).
"""
from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

K, S, ANCHORS = 16, 5, 64


def _anchors(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Places and 32-bit hashes of the closed syncmers in a run of code points."""
    n = len(points) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    p = points.astype(np.uint64)
    m = len(points) - s + 1
    inner = p[:m] * C._ODD[5]
    for j in range(1, s):
        inner += p[j:j + m] * C._ODD[5 + j]
    inner = C.mix(inner)
    width, least, have = k - s + 1, inner, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[:n], least[width - have:width - have + n])
    least = least[:n]
    at = np.flatnonzero((inner[:n] == least) | (inner[width - 1:width - 1 + n] == least))
    whole = np.zeros(len(at), np.uint64)
    for j in range(k):
        whole += p[at + j] * C._ODD[j % 16] * np.uint64(2 * (j // 16) + 1)
    return at, (C.mix(whole) >> np.uint64(32)).astype(np.uint32)


def _smallest(places: np.ndarray, hashes: np.ndarray, anchors: int) -> list[int]:
    """The smallest distinct hashes in the order of their first places."""
    if len(hashes) > 8 * anchors:  # only small ones can be among them
        cut = np.partition(hashes, 4 * anchors)[4 * anchors]
        few = hashes <= cut
        if len(np.unique(hashes[few])) >= anchors:
            places, hashes = places[few], hashes[few]
    distinct, first = np.unique(hashes, return_index=True)
    first = first[:anchors]
    return hashes[np.sort(first)].tolist()


def fingerprints(texts: list[str], anchors: int = ANCHORS, k: int = K, s: int = S) -> list[list[int]]:
    """A list of hashes for each text; an empty text has none, one without a closed syncmer is one anchor itself."""
    out: list[list[int]] = [[] for _ in texts]
    begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(begin, begin[start] + 1_000_000)) - 1)
        end = min(end, len(texts))
        points = np.frombuffer("".join(texts[start:end]).encode("utf-32-le"), np.uint32)
        at, h = _anchors(points, k, s)
        low = np.searchsorted(at, begin[start:end] - begin[start])
        high = np.searchsorted(at, begin[start + 1:end + 1] - begin[start] - k, "right")
        for i in range(start, end):
            a, b = low[i - start], high[i - start]
            if b > a:
                out[i] = _smallest(at[a:b], h[a:b], anchors)
            elif texts[i]:
                out[i] = [int.from_bytes(hashlib.sha256(texts[i].encode()).digest()[:4], "big")]
        start = end
    return out


def likeness(a: list[int], b: list[int], anchors: int = ANCHORS) -> float:
    """From 0 to 1; texts without anchors are like each other."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    pool = sorted({*a, *b})[:anchors]
    where = {h: i for i, h in enumerate(b)}
    top = pool[-1]
    tails: list[int] = []
    for h in a:
        if h <= top and h in where:
            i = bisect_left(tails, where[h])
            tails[i:i + 1] = [where[h]]
    return len(tails) / len(pool)


def written(f: list[int]) -> str:
    return "".join(f"{h:08x}" for h in f)


def _edit(text: str, other: str) -> str:
    n = len(text) // 3
    return text[:len(text) - n] + other[:n] if n else text


def _pairs(batches):
    """Rows sorted by (bucket, tail, doc_id descending, text): each with the text after it; tails only serve as such."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    last = None
    for batch in batches:
        for part in C.slices(batch, "text"):
            ids, texts, tails = (part.column(x).to_pylist() for x in ("doc_id", "text", "tail"))
            prints = fingerprints(texts)
            if last is not None:
                ids, texts, tails, prints = [last[0], *ids], [last[1], *texts], [False, *tails], [last[2], *prints]
            pairs = [i for i in range(len(ids) - 1) if not tails[i]]
            edited = [_edit(texts[i], texts[i + 1]) for i in pairs]
            changed = fingerprints(edited)
            rows = [(ids[i], len(texts[i]), hashlib.sha256(e.encode()).hexdigest(), written(prints[i]), written(c), likeness(prints[i], c), likeness(prints[i], prints[i + 1]))
                    for i, e, c in zip(pairs, edited, changed)]
            last = None if tails[-1] else (ids[-1], texts[-1], prints[-1])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, types)], names)


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text is the text with its last third replaced by the start of the next document, by descending
    id (after the last the first). Ids fall into ranges; a range is one sorted run, to which the first row of the
    range after it is added. Null texts are empty; rows that share an id follow each other by text; a null id comes
    after all others. Other columns play no part; one row is its own next; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    d = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("rank", F.coalesce("doc_id", F.lit(least)))
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(d.approxQuantile("rank", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    if cuts:
        ranged = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="at", outputCol="bucket")
        d = ranged.transform(d.withColumn("at", F.col("rank").cast("double"))).drop("at").withColumn("bucket", F.col("bucket").cast("int"))
    else:
        d = d.withColumn("bucket", F.lit(0))
    heads = sorted(map(tuple, d.groupBy("bucket").agg(F.max("rank")).collect()), reverse=True)
    if not heads:
        return spark.createDataFrame([], "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    after = spark.createDataFrame([(b, r) for (b, _), (_, r) in zip(heads, [*heads[1:], heads[0]])], "to int, rank bigint")
    tails = d.join(F.broadcast(after), "rank").groupBy("to", "rank").agg(F.min("text").alias("text"))
    rows = d.select("doc_id", "text", "rank", "bucket", F.lit(False).alias("tail")).union(tails.select(F.lit(None).cast("bigint"), "text", "rank", "to", F.lit(True)))
    sorted_ = rows.repartition("bucket").sortWithinPartitions("bucket", "tail", F.desc("rank"), "text")
    return sorted_.select("doc_id", "text", "tail").mapInArrow(_pairs, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
