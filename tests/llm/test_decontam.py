"""Leak search against planted passages, and its parts against plain forms."""
import random

import numpy as np
import pyarrow as pa

from spanlake.llm import decontam as D


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            row[j + 1], prev = (prev + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
    return row[-1]


def test_common_subsequence():
    r = random.Random(4)
    for _ in range(200):
        item = [f"t{r.randrange(8)}" for _ in range(r.randrange(1, 40))]
        bench = D.Bench([1], [" ".join(item)], [""])
        other = [f"t{r.randrange(10)}" for _ in range(r.randrange(0, 60))]
        words, _ = D._words(pa.array([" ".join(other)], pa.large_string()))
        assert bench.common(0, bench.terms(words)) == lcs(item, other)


def test_windows_cover_every_word():
    at = np.array([0, 0, 5, 37, 37 + 100])
    doc, first, last = D._windows(np.zeros(137, np.int64), at)
    seen = {i for a, b in zip(first, last) for i in range(a, b)}
    assert seen == set(range(137)) and sorted(set(doc.tolist())) == [1, 2, 3]


def corpus():
    r = random.Random(6)
    vocab = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("an", "en", "in", "on", "un", "ar", "er", "ir", "or", "ur", "al", "el")]
    common = ["the", "of", "and", "to", "in"]
    text = lambda n: " ".join(r.choice(common) if r.random() < 0.4 else r.choice(vocab) + r.choice(vocab) for _ in range(n))
    items = [(i, text(r.randrange(18, 60))) for i in range(30)]
    docs, want = [], set()
    for d in range(300):
        words = text(r.randrange(5, 400)).split()
        if d % 6 == 0:
            item, passage = r.choice(items)
            p = passage.split()
            if d % 12 == 0:  # a paraphrase: one word in eight is another
                p = [w if i % 8 != 3 else "other" for i, w in enumerate(p)]
            at = r.randrange(len(words) + 1)
            words[at:at] = p
            want.add((d, item))
        docs.append((d, " ".join(words)))
    return docs, items, want


def test_planted(spark):
    docs, items, want = corpus()
    df = spark.createDataFrame([(d, t, "x", 0.5) for d, t in docs] + [(400, None, "x", 0.5), (401, "", "x", 0.5), (None, items[0][1], "x", 0.5)], "doc_id bigint, text string, item_id string, cosine double")
    bench = spark.createDataFrame([*items, (90, None), (91, "  "), (None, "...")], "item_id bigint, text string")
    rows = D.find_leaks(df, bench).collect()
    assert {(r[0], r[1]) for r in rows if r[0] is not None} == want
    assert [r[1] for r in rows if r[0] is None] == [0]
    kept = D.drop_leaks(df, bench)
    assert kept.columns == df.columns
    assert {r[0] for r in kept.collect()} == ({d for d, _ in docs} | {400, 401}) - {d for d, _ in want}
    assert D.find_leaks(df.limit(0), bench).collect() == []
    assert D.find_leaks(df, bench.limit(0)).collect() == []
    assert D.drop_leaks(df, bench.limit(0)).count() == df.count()


def test_answer_must_be_there(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(1, item, "lambda mu")], "item_id bigint, text string, answer string")
    docs = spark.createDataFrame([(1, item), (2, item + " lambda mu"), (3, "words of other kinds")], "doc_id bigint, text string")
    assert [r[0] for r in D.find_leaks(docs, bench).collect()] == [2]


def test_blocks_of_items(spark, monkeypatch):
    docs, items, want = corpus()
    monkeypatch.setattr(D, "ITEMS", 8)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {(r[0], r[1]) for r in D.find_leaks(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()} == want


def many_items(n_items, n_docs, length=(15, 59)):
    """Items cut from texts of a large vocabulary, and documents with one of them each, verbatim."""
    r = random.Random(11)
    vocab = [f"{a}{b}{c}" for a in "bcdfghklmnprst" for b in ("an", "en", "in", "on", "un", "ar", "er", "ir", "or", "ur", "al", "el") for c in "bcdfghklmnprst"]
    text = lambda n: " ".join(r.choice(("the", "of", "and", "to", "in")) if r.random() < 0.3 else r.choice(vocab) for _ in range(n))
    items = [(i, text(r.randrange(*length))) for i in range(n_items)]
    docs, want = [], set()
    for d in range(n_docs):
        words = text(r.randrange(40, 200)).split()
        item, passage = items[d * 7 % n_items]
        at = r.randrange(len(words) + 1)
        words[at:at] = passage.split()
        docs.append((d, " ".join(words)))
        want.add((d, item))
    return docs, items, want


def test_more_items_than_dimensions(spark):
    """Every planted item is a verbatim copy, so that brute force finds it with a share of 1."""
    docs, items, want = many_items(1400, 300)
    df, bench = spark.createDataFrame([*docs, (900, None)], "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = D.find_leaks(df, bench).collect()
    assert len({(r.doc_id, r.item_id) for r in got if r.common == 1} & want) >= 0.9 * len(want)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    kept = D.drop_leaks(df, bench)
    assert kept.columns == df.columns
    assert {r[0] for r in kept.collect()} == ({d for d, _ in docs} | {900}) - {r.doc_id for r in got}


def test_items_of_every_length(spark):
    """Verbatim copies of items of a few words and of many hundreds; brute force finds each with a share of 1."""
    docs, items, want = [], [], set()
    for k, length in enumerate(((4, 7), (8, 11), (300, 400), (700, 1100))):
        d, i, w = many_items(12, 48, length)
        docs += [(1000 * k + x, t) for x, t in d]
        items += [(1000 * k + x, t) for x, t in i]
        want |= {(1000 * k + x, 1000 * k + y) for x, y in w}
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect() if r.common == 1}
    for k in range(4):
        here = {x for x in want if x[0] // 1000 == k}
        assert len(got & here) >= 0.9 * len(here), (k, len(got & here), len(here))


def test_weights_count_every_document(spark):
    """Frequencies, the weight of other words and the Gram matrix agree with brute force over all documents."""
    docs = ["alpha beta beta", "alpha odd odd odd odd", "", "rare Alpha, gamma"] + ["odd strange alpha"] * 9 + [" ".join(f"w{i % 7} alpha gamma" for i in range(40))]
    rows = spark.createDataFrame([(t,) for t in docs], "text string").repartition(3)
    bench = D.Bench([1], ["alpha beta gamma delta"], [""])
    counts = D.Counts(rows)
    df, strange = counts.of(bench.vocab)
    split = [t.lower().replace(",", "").split() for t in docs]
    name = {int(D._words(pa.array([w], pa.large_string()))[0][0]): w for w in ("alpha", "beta", "gamma", "delta")}
    assert counts.n_docs == len(docs)
    assert [sum(name[int(v)] in set(t) for t in split) for v in bench.vocab] == df.tolist()
    idf = lambda w: np.log((1 + len(docs)) / (1 + sum(w in t for t in split)))
    other = [idf(w) ** 2 for t in split for w in t if w not in name.values()]
    assert abs(strange - np.sqrt(np.mean(other))) < 1e-9

    bench.weigh(df, counts.n_docs, strange)
    root = D._gram(bench, rows, np.eye(len(bench.vocab), dtype=np.float32))
    want = np.zeros((len(bench.vocab),) * 2)
    for t in split:
        for a in range(0, len(t), D.WINDOW):
            x = np.array([t[a:a + D.WINDOW].count(name[int(v)]) for v in bench.vocab]) * bench.idf
            want += np.outer(x, x)
    assert np.allclose(root @ root.T, want, rtol=1e-4, atol=1e-4)
