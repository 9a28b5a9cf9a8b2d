"""Counts, look-up and mixture against a plain form over dictionaries."""
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanlake.llm import ngram_lm as N

END, BEGIN = "<end>", "<begin>"


def corpus():
    r = random.Random(7)
    docs = [(i, " ".join(f"w{int(r.paretovariate(0.8)) % 300}" for _ in range(r.randrange(0, 60)))) for i in range(400)]
    return docs + [(400, None), (401, ""), (402, "  \n"), (403, "W1 w1\tÉ é"), (404, "W1 w1\tÉ é"), (404, "W1 w1\tÉ é"), (405, "w2 " * 30_000), (None, "w1 w2")]


def toks(t):
    return [w.decode() for w in (t or "").encode().lower().split()] + [END]


@pytest.mark.parametrize("block", [N.BLOCK, 700])
def test_scores(spark, block):
    docs = corpus()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id bigint, text string, block int, score string").repartition(6)
    train = F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 1
    got = N.score_texts(df, train, block=block).collect()
    learned = [toks(t) for d, t in docs if (d or 0) % 3 != 1]
    uni = Counter(w for x in learned for w in x)
    bi = Counter(p for x in learned for p in zip([BEGIN, *x], x))
    n, v = sum(uni.values()), len(uni)
    # mixture weights are checked apart; here they are read back from the operator's own rows
    deleted = df.where(train).where(F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit(5)), F.lit(N.DELETED)) == 0).select("text").collect()
    gone = [toks(r[0]) for r in deleted]
    kept_uni, kept_bi = Counter(uni), Counter(bi)
    for x in gone:
        kept_uni.subtract(x)
        kept_bi.subtract(zip([BEGIN, *x], x))
    kn, kv = sum(kept_uni.values()), sum(c > 0 for c in kept_uni.values())
    bucket = lambda c: int(math.log2(c)) + 1 if c > 0 else 0
    rows = Counter()
    for x in gone:
        for a, b in zip([BEGIN, *x], x):
            c = kept_uni[END] if a == BEGIN else kept_uni[a]
            if c > 0:
                ratio = kept_bi[a, b] / c / ((kept_uni[b] + 0.5) / (kn + 0.5 * (kv + 1)))
                rows[bucket(c), round(math.log2(ratio) * N.FINE) if ratio else N.FLOOR * N.FINE] += 1
    weights = N.learn_weights([(*k, c) for k, c in rows.items()])
    want = []
    for d, t in docs:
        base = score = 0.0
        x = toks(t)
        for a, b in zip([BEGIN, *x], x):
            p = (uni[b] + 0.5) / (n + 0.5 * (v + 1))
            c = uni[END] if a == BEGIN else uni[a]
            m = weights[bucket(c)]
            base += math.log10(p)
            score += math.log10(m * (bi[a, b] / c if c else 0) + (1 - m) * p)
        want.append((d if d is not None else -1, len(x), sum(uni[w] > 0 for w in x), n, round(base, 6), round(score, 4)))
    assert sorted((r[0] if r[0] is not None else -1, r[1], r[2], r[3], round(r[4], 6), round(r[5], 4)) for r in got) == sorted(want)


def test_em_raises_the_likelihood():
    rows = [(3, 40, 50), (3, N.FLOOR * N.FINE, 30), (3, -16, 20), (9, 80, 10)]
    w = N.learn_weights(rows)
    like = lambda m: sum(n * math.log(m * (2 ** (s / N.FINE) if s > N.FLOOR * N.FINE else 0) + 1 - m) for b, s, n in rows if b == 3)
    assert all(like(w[3]) >= like(m / 100) - 1e-9 for m in range(1, 100)) and w[9] > 0.99 and w[5] == 0


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    rows = sorted(map(tuple, N.score_texts(df, F.lit(False)).collect()))
    assert [r[:4] for r in rows] == [(1, 3, 0, 0), (2, 1, 0, 0)] and rows[0][4] == rows[0][5] == 0.0
    assert N.score_texts(df.limit(0), F.lit(True)).collect() == []


def test_large_counts_survive_packing():
    import numpy as np
    c = np.array([0, 1, 254, 255, 256, 10**12, 3])
    assert N._unpack(N._pack(c), len(c)).tolist() == c.tolist()
