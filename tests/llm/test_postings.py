"""Nearest vectors against all pairs: recall, and everything else exactly."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.llm import catalogue, common, postings as P

TYPE = "vec_id bigint, embedding array<double>, score double, rep int, `list` string"


def brute(rows, every, k):
    good = [(i, v) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, v in good), default=0)
    m = np.array([list(v) + [0.0] * (width - len(v)) for _, v in good]).reshape(len(good), width)
    ids, out = [i for i, _ in good], {}
    for n, (q, _) in enumerate(good):
        if q % every:
            continue
        best = out.setdefault(q, {})
        for i, s in zip(ids, (m * m[n]).sum(axis=1)):
            if i != q:
                best[i] = max(s, best.get(i, s))
    return {q: sorted(b.items(), key=lambda x: (-x[1], x[0]))[:k] for q, b in out.items()}


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / max(1, sum(map(len, want.values())))


def lists(df):
    out = {}
    for q, rank, i, s in df.select("query_id", "rank", "vec_id", "score").orderBy("query_id", "rank").collect():
        out.setdefault(q, []).append((i, s))
        assert rank == len(out[q])
    return out


def odd_rows(dim):
    return [(None, [1.0] * dim), (9000, None), (9010, [0.0] * dim), (9020, []), (9030, [1.0, None] + [0.0] * (dim - 2)), (9040, [float("nan")] * dim), (9050, [float("inf")] * dim), (9060, [0.5, 0.5])]


def rows(r, n, dim, scale):
    centre = r.normal(size=(7, dim))
    out = [(i, (centre[i % 7] + r.normal(size=dim)) * (r.uniform(0.5, 2) if scale else 1)) for i in range(n)]
    out += [(n + i, out[5][1]) for i in range(n // 3)]                                # a hot vector
    out += [(2 * n + i, out[6][1] + 1e-3 * r.normal(size=dim)) for i in range(n // 3)]  # a hot region
    out += [(3, out[3][1]), (3, out[3][1]), (40, out[9][1])]                           # repeated ids
    return [(i, v if v is None else [x if x is None else float(x) for x in v], 0.0, 1, "x") for i, v in out + odd_rows(dim)]


@pytest.mark.parametrize("scale", [False, True])
def test_recall_and_rows(spark, scale):
    some = rows(np.random.default_rng(1), 1500, 12, scale)
    random.Random(2).shuffle(some)
    df = spark.createDataFrame(some, TYPE).repartition(6)
    want = brute(some, 20, 20)
    got = lists(P.nearest_vectors(df, F.col("vec_id") % 20 == 0, list_rows=64, sample=600, group_rows=500, group_queries=20))
    assert set(got) == set(want) and all(len(got[q]) == len(want[q]) for q in want)
    assert recall(got, want) >= 0.93
    score = {q: dict(brute([x for x in some if x[0] == q] + some, q or 1, 10**6)[q]) for q in list(want)[:5]}
    for q in score:
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0])) and q not in dict(got[q])
        assert all(abs(score[q][i] - s) < 1e-9 for i, s in got[q])


def test_all_lists_are_exact(spark):
    some = rows(np.random.default_rng(3), 300, 6, True)
    df = spark.createDataFrame(some, TYPE)
    want = brute(some, 20, 20)
    got = lists(P.nearest_vectors(df, F.col("vec_id") % 20 == 0, list_rows=10_000))  # one list
    assert {q: [i for i, _ in g] for q, g in got.items()} == {q: [i for i, _ in w] for q, w in want.items()}


def test_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0.0, 0, ""), (1, [1.0, 0.0], 0.0, 0, ""), (7, [-1.0, 0.0], 0.0, 0, "")], TYPE)
    q = F.col("vec_id") % 20 == 0
    assert lists(P.nearest_vectors(df, q)) == {0: [(1, 1.0), (7, -1.0)]}
    assert lists(P.nearest_vectors(df.where("vec_id = 0"), q)) == {} and lists(P.nearest_vectors(df.where("vec_id > 0"), q)) == {}
    assert lists(P.nearest_vectors(df.limit(0), q)) == {}


def test_registered_query(spark):
    d = "/root/testdata/sf0.1"
    some = [tuple(r) for r in common.table(spark, d, "embeddings").select("vec_id", "embedding").collect()]
    got = lists(catalogue.op13_posting_lists(spark, d))
    want = brute(some, 20, 20)
    assert set(got) == set(want) and recall(got, want) >= 0.9


def test_centroids_are_balanced_and_the_graph_finds_them():
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=(3000, 8)), r.normal(size=8) + 0.01 * r.normal(size=(1500, 8))])
    c = P.balanced_centroids(x, 60)
    assert len(c) == 60
    at = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
    assert np.bincount(at, minlength=60).max() < 5 * len(x) / 60
    g = P.Graph(c, degree=8)
    full = np.sqrt(((x[:, None] - c) ** 2).sum(axis=2))
    hit = seen = 0
    for a, dist, near in g.within(x, 1.1):
        d = full[a:a + len(dist)]
        hit += (near <= d.min(axis=1) + 1e-9).sum()
        seen += ((d <= d.min(axis=1, keepdims=True) * 1.1) & np.isfinite(dist)).sum() / ((d <= d.min(axis=1, keepdims=True) * 1.1)).sum() * len(dist)
    assert hit > 0.98 * len(x) and seen > 0.97 * len(x)
    assert len(P.balanced_centroids(np.ones((50, 3)), 9)) == 1


def test_groups_of_lists():
    first, parts = P._packed(np.array([3, 3, 5, 25, 1, 9, 0, 10]), 10)
    assert first.tolist() == [0, 0, 1, 2, 5, 5, 6, 6] and parts.tolist() == [1, 1, 1, 3, 1, 1, 1, 1]


def test_best_of_each_row():
    r = np.random.default_rng(8)
    for copies, n in ((1, 400), (3, 400), (2, 30)):
        rows = np.repeat(r.integers(-2, 3, size=(n, 4)).astype(float), copies, axis=0)  # whole numbers: many ties
        ids = np.repeat(r.permutation(n), copies)
        q = r.integers(-2, 3, size=(20, 4)).astype(float)
        scores = q @ rows.T
        scores[r.random(scores.shape) < 0.3] = -np.inf
        scores[0] = -np.inf
        who, at, s = P.top_of_each(scores, rows, q, ids, 7, copies)
        for i in range(20):
            best = sorted({(-scores[i, j], ids[j]) for j in range(len(ids)) if scores[i, j] > -np.inf})[:7]
            assert [(-a, b) for a, b in zip(s[who == i], ids[at[who == i]])] == best
