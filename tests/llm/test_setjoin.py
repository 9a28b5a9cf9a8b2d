"""The exact set join against brute force over all pairs."""
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.llm import common as C
from spanlake.llm import setjoin as J
from spanlake.llm.graph import connected_components

SCHEMA = "doc_id bigint, text string, cluster string, node int, component_id string"


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(docs, k, num, den):
    sets = {}
    for d, t in docs:
        sets.setdefault(d, []).append(shingles(t, k))
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if any(x and y and den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((find(a), find(b)))
                top[q] = p
    return {d: find(d) for d in ids}


def corpus(seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    docs, n = [], 0
    for base in range(12):
        words = [r.choice(vocab) for _ in range(r.choice([4, 12, 30, 90, 300]))]
        for _ in range(r.choice([1, 2, 6, 15])):
            w = list(words)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                w[r.randrange(len(w))] = r.choice(vocab)
            docs.append((n, " ".join(w)))
            n += 1
    r.shuffle(docs)
    return docs + [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "one two"), (906, "ONE  two"), (907, "é É"), (908, "é é")]


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 8, 10), (2, 5, 10)])
@pytest.mark.parametrize("chunk", [J.CHUNK, 400])
def test_components(spark, k, num, den, chunk):
    docs = corpus()
    df = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in docs], SCHEMA).repartition(5)
    rows = J.jaccard_components(df, k, num, den, chunk=chunk).collect()
    assert {r[0]: r[1] for r in rows} == {d: len(shingles(t, k)) for d, t in docs}
    assert {r[0]: r[2] for r in rows} == brute(docs, k, num, den)


def test_odd_rows(spark):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, "p q r s t"), (3, "u v w x y"), (4, "u v w x y"), (5, "p q r s t")]
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in docs], SCHEMA)
    rows = J.jaccard_components(df, 3, 9, 10).collect()
    assert sorted((r[0], r[2]) for r in rows if r[0]) == [(1, 1), (1, 1), (2, 1), (3, 3), (3, 3), (4, 3), (5, 3)]
    assert [(r[1], r[2]) for r in rows if r[0] is None] == [(4, None)]
    kept = J.keep_one(df, k=3, num=9, den=10)
    assert kept.columns == df.columns
    assert sorted((r[0] or 0) for r in kept.collect()) == [0, 1, 1, 3, 3]


def test_empty_table(spark):
    assert J.jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_text(spark):
    r = random.Random(1)
    words = [f"v{r.randrange(10**6)}" for _ in range(60_000)]
    other = list(words)
    for i in range(0, 60_000, 500):
        other[i] = "changed"
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, "x" * 100_000 + " y")], "doc_id bigint, text string")
    assert {r[0]: r[2] for r in J.jaccard_components(df).collect()} == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("num,den", [(9, 10), (8, 10), (1, 2), (95, 100)])
def test_linked_sets_share_a_list(num, den):
    """No pair at or above the threshold is without a common block key, also for sparse sets."""
    rng = np.random.default_rng(5)
    for n in (2, 3, 9, 10, 11, 19, 20, 40, 75, 150, 600):
        for _ in range(30):
            a = rng.integers(0, 2**64, n, np.uint64)
            m = n + rng.integers(0, max(1, n // 3) + 1)
            common = -(-num * (n + m) // (num + den))
            if common > n or common == n == m:
                continue
            b = np.concatenate([rng.permutation(a)[:common], rng.integers(0, 2**64, m - common, np.uint64)])
            a, b = np.sort(a), np.sort(b)
            off = np.array([0, len(a), len(a) + len(b)])
            keys, owner = J.block_keys(np.concatenate([a, b]), off, J.Levels(num, den, int(max(len(a), len(b)))))
            assert np.intersect1d(keys[owner == 0], keys[owner == 1]).size, (n, m, common)
            for share in (0.2, 0.7, 1.0):  # whatever is taken for common
                often = np.sort(np.concatenate([rng.choice(a, int(share * len(a)), replace=False), rng.choice(b, int(share * len(b)), replace=False)]))
                keys, owner = J.block_keys(np.concatenate([a, b]), off, J.Levels(num, den, int(max(len(a), len(b)))), often)
                assert np.intersect1d(keys[owner == 0], keys[owner == 1]).size, (n, m, common, share)


def test_components_of_links(spark):
    r = random.Random(8)
    links = [(i, i + 1) for i in range(60)] + [(100, 100), (None, 3), (201, 200), (200, 201)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)]
    got = {x[0]: x[1] for x in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    top = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = top.setdefault(a, {a}), top.setdefault(b, {b})
            if x is not y:
                x |= y
                for n in y:
                    top[n] = x
    assert got == {n: min(s) for n, s in top.items()}


def test_word_hashes_follow_words():
    import pyarrow as pa
    texts = ["Ab  c\tAB", None, "", "é e\x0be", "x" * 200 + " " + "x" * 136, "ab"]
    h, off = C.word_hashes(*C.text_bytes(pa.array(texts)))
    words = [w for t in texts for w in (t or "").encode().lower().split()]
    assert off.tolist() == np.cumsum([0, *(len((t or "").encode().split()) for t in texts)]).tolist()
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert (h[i] == h[j]) == (a == b)


def test_other_columns_play_no_part(spark):
    df = spark.createDataFrame([(1, "a b c d", "s", 2, "t")], SCHEMA).withColumn("label", F.lit(1)).withColumn("top", F.lit(2))
    assert J.jaccard_components(df).collect()[0][2] == 1


@pytest.mark.parametrize("most", [3, 40, 10**6])
def test_forest_of_many_shards_loses_no_link(most):
    """What a task gives out joins the same sets as all its lists; without a bound it is one forest, however many shards there are."""
    r = np.random.default_rng(9)
    entries = [(int(s), int(k), int(i)) for s in range(30) for k in range(12) for i in r.choice(400, r.integers(1, 5), replace=False)]
    rows = []
    for s in range(30):
        for part in (0, 1):
            mine = [(k, i) for n, (t, k, i) in enumerate(entries) if t == s and n % 2 == part]
            names, place = np.unique(np.array([i for _, i in mine], np.int64), return_inverse=True)
            rows.append((s, False, np.array([k for k, _ in mine], np.uint32).tobytes(), np.zeros(len(mine), np.uint16).tobytes(), names.tobytes(), place.astype(np.uint16).tobytes()))
    rows.append((29, True, np.array([7, 8], np.int64).tobytes(), b"", np.array([3, 3], np.int64).tobytes(), b""))
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["shard", "done", "low", "high", "ids", "place"])
    got = [(a, b) for out in J._linked(most)([batch]) for a, b in zip(*(c.to_pylist() for c in out.columns))]
    want = [(7, 3), (8, 3)]
    for key in {(s, k) for s, k, _ in entries}:
        ids = [i for s, k, i in entries if (s, k) == key]
        want += [(i, min(ids)) for i in ids]

    def tops(links):
        a, b = J.forest(*(np.array(x, np.int64) for x in zip(*links)))
        return dict(zip(a.tolist(), b.tolist()))
    assert tops(got) == tops(want)
    if most == 10**6:
        assert len(got) == len(tops(want)) < 400


def test_forest():
    r = np.random.default_rng(10)
    for n in (0, 1, 50, 3000):
        a, b = r.integers(0, 2000, n), r.integers(0, 2000, n)
        top = {}
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = top.setdefault(x, {x}), top.setdefault(y, {y})
            if p is not q:
                p |= q
                for z in q:
                    top[z] = p
        u, v = J.forest(a, b)
        assert dict(zip(u.tolist(), v.tolist())) == {x: min(s) for x, s in top.items() if x != min(s)}


def test_only_documents_that_may_go_are_shuffled(spark):
    """The filter before a join misses no id and lets few others through, null ids among neither."""
    rows = spark.range(-500, 4_000).selectExpr("id AS doc_id", "'x' AS text").union(spark.createDataFrame([(None, "n")], "doc_id long, text string"))
    ids = spark.range(-500, 4_000, 9).selectExpr("id AS node").union(spark.createDataFrame([(None,)], "node long"))
    hit = {r.doc_id for r in C.mark_maybe(rows, "doc_id", ids).where("__maybe").collect()}
    true = set(range(-500, 4_000, 9))
    assert true <= hit and len(hit - true) < 0.15 * 4_500 and None not in hit
    got = C.mark_maybe(rows, "doc_id", ids)
    assert got.columns == ["doc_id", "text", "__maybe"] and got.count() == 4_501 and got.where("__maybe IS NULL").count() == 0
    assert C.mark_maybe(rows, "doc_id", ids.limit(0)).where("__maybe").count() == 0


def passages(seed, sets=240, pool=30):
    """Documents of words of their own and passages of a pool, some with near copies; by passages almost all hang together."""
    r = random.Random(seed)
    shared = [" ".join(f"p{i}x{j}" for j in range(30)) for i in range(pool)]
    docs = []
    for i in range(sets):
        w = [f"d{i}x{j}" for j in range(r.choice([120, 200, 400]))]
        for p in r.sample(shared, 3):
            w.insert(r.randrange(len(w)), p)
        w = " ".join(w).split()
        docs.append((len(docs), " ".join(w)))
        for _ in range(r.choice([0, 0, 0, 1, 3])):
            c = list(w)
            for _ in range(r.choice([1, 3, 6, 9])):
                c[r.randrange(len(c))] = f"c{r.randrange(10 ** 6)}"
            docs.append((len(docs), " ".join(c)))
    return docs


def test_clusters_held_together_by_passages_are_split_before_they_are_compared(spark, monkeypatch):
    """Whether or not the sample knows the passages: as many texts are compared as there are, not chunks times chunks of them."""
    monkeypatch.setattr(J, "common_shingles", lambda *_: np.zeros(0, np.uint64))
    compared, verified = [], J._verified
    monkeypatch.setattr(J, "_verified", lambda members, *how: compared.append(members.count()) or verified(members, *how))
    docs = passages(5)
    rows = J.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), 5, 8, 10, chunk=4000).collect()
    assert {r.doc_id: r.component_id for r in rows} == brute(docs, 5, 8, 10)
    assert sum(compared) <= len(docs)


@pytest.mark.parametrize("seed", [1, 2])
def test_rarest_blocks_lose_no_link(spark, seed):
    """Sets whose blocks are mostly shared, and rows that come twice."""
    docs = corpus(seed) + [(d + 1000, t) for d, t in passages(seed, 40, 4)]
    df = spark.createDataFrame(docs + docs[::3], "doc_id long, text string").repartition(4)
    for k, num, den in ((5, 8, 10), (3, 90, 100), (2, 5, 10)):
        rows = J.jaccard_components(df, k, num, den, chunk=300).collect()
        assert {r.doc_id: r.component_id for r in rows} == brute(docs, k, num, den)
