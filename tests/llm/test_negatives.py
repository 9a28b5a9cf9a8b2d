"""Hard negatives against all pairs, and the pruning against what it may not lose."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.llm import negatives as N

TYPE = "vec_id bigint, label int, embedding array<float>, score double, place int, v string"


def brute(rows, every=10, low=80, high=100, k=5):
    """All scores of every anchor, as whole numbers."""
    good = {}
    for i, label, vec, *_ in rows:
        if i is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        v = [math.floor(256 * float(np.float32(x))) for x in vec]
        good.setdefault((i, label, tuple(v)), None)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    anchors = {}
    for i, label, v in good:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in anchors.items():
        def top(fits):
            best = {}
            for i, c, w in good:
                s = dot(v, w)
                if fits(i, c, s):
                    best[i] = max(best.get(i, s), s)
            return sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        for p, ps in top(lambda i, c, s: c == label and i != a):
            for rank, (n, ns) in enumerate(top(lambda i, c, s: c != label and low * ps <= 100 * s <= high * ps), 1):
                out.append((a, p, rank, n, ps, ns))
    return sorted(out)


def vectors(r, n, dim=8):
    rows, centre = [], r.normal(size=(5, dim))
    for i in range(n):
        v = r.normal(size=dim) * r.choice([0.1, 1, 4]) if i % 3 else centre[i % 5] + 0.05 * r.normal(size=dim)
        rows.append((i, int(r.integers(0, 3)), [float(x) for x in v], 1.0, 2, "x"))
    rows += [(n + i, i % 2, rows[3][2], 0.0, 0, "copy") for i in range(60)]  # a hot vector
    rows += [(10, 1, rows[10][2], None, None, None), (20, 2, [9.0] * dim, None, None, None), (20, 2, [9.0] * dim, None, None, None)]
    rows += [(None, 1, [1.0] * dim, 0.0, 0, ""), (2000, None, [1.0] * dim, 0.0, 0, ""), (2010, 1, None, 0.0, 0, ""), (2020, 1, [1.0, None] + [0.0] * (dim - 2), 0.0, 0, ""),
             (2030, 1, [float("nan")] * dim, 0.0, 0, ""), (2040, 1, [float("inf")] * dim, 0.0, 0, ""), (2050, 1, [0.0] * dim, 0.0, 0, ""), (2060, 2, [], 0.0, 0, ""), (2070, 0, [1.0, 2.0], 0.0, 0, "")]
    return rows


@pytest.mark.parametrize("chunk,group", [(10_000, 10_000), (40, 7)])
def test_rows(spark, chunk, group):
    rows = vectors(np.random.default_rng(3), 400)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, TYPE).repartition(5)
    got = N.hard_negatives(df, F.col("vec_id") % 10 == 0, chunk=chunk, group=group)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_small_tables(spark):
    df = spark.createDataFrame([(0, 1, [1.0, 0.0], 0.0, 0, ""), (1, 1, [1.0, 0.0], 0.0, 0, ""), (2, 2, [0.9, 0.1], 0.0, 0, "")], TYPE)
    assert [tuple(x) for x in N.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()] == [(0, 1, 1, 2, 65536, 58880)]
    assert N.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert N.hard_negatives(df.where("label = 1"), F.col("vec_id") % 10 == 0).collect() == []
    with pytest.raises(ValueError):
        N.hard_negatives(df.withColumn("embedding", F.array(F.lit(1e12))), F.col("vec_id") % 10 == 0).collect()


def test_ranges_lose_no_row_and_cut_most():
    r = np.random.default_rng(5)
    rows = np.concatenate([r.normal(size=(2000, 16)), 3 * np.eye(16)[0] + 0.1 * r.normal(size=(50, 16))])
    b = N.Bucket(np.arange(len(rows)), np.zeros(len(rows), np.int64), rows, np.linalg.norm(rows, axis=1))
    for a in (rows[3], rows[-1], -rows[-1], np.eye(16)[0], r.normal(size=16)):
        d = a / np.linalg.norm(a)
        cos = rows @ d / np.linalg.norm(rows, axis=1)
        for c in (0.0, 0.2, 0.6, 0.9, 0.99, 1.0):
            at = b.candidates(d, np.argsort(-np.abs(d))[:N.FOCUS], c)
            assert at is None or set(np.flatnonzero(cos >= c)) <= set(at)
            if c >= 0.9:
                assert len(at) < 100


def test_short_rows_are_skipped_by_length():
    r = np.random.default_rng(6)
    rows = r.normal(size=(4000, 8)) * np.repeat([8, 1, 0.5, 0.1], 1000)[:, None]
    ids, labels = np.arange(4000), np.zeros(4000, np.int64)
    some = [N._Anchor(-1 - i, 0, v, [(-np.inf, np.inf)], 5) for i, v in enumerate(r.normal(size=(20, 8)))]
    count = N.search(some, N.buckets(ids, labels, rows, 100), True)
    assert count[0] == 20 * 4000 and count[1] < 0.2 * count[0]
    for a in some:
        s = rows @ a.row
        want = sorted(range(4000), key=lambda i: (-s[i], i))[:5]
        assert a.found[0][0].tolist() == want
