"""The counterfactual penalty, and the classifier on held-out labels."""
import random

import numpy as np

from spanlake.llm import toxicity as T


def labelled():
    r = random.Random(9)
    plain = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("alo", "emi", "inu", "opa", "ura")]
    docs = []
    for i in range(400):
        toxic = i % 4 == 0
        words = [r.choice(plain) for _ in range(30)]
        if toxic:
            words += [r.choice(["idiotic", "scumbag", "vermin"]) for _ in range(3)]
        if r.random() < (0.8 if toxic else 0.05):
            words.append("muslim")
        r.shuffle(words)
        docs.append((i, " ".join(words), int(toxic)))
    return docs


def model(spark, strength):
    docs = labelled()
    d = spark.createDataFrame([x[:2] for x in docs], "doc_id bigint, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in docs], "doc_id bigint, toxic int")
    return T.learn(labels, d, counterfactual=strength)


def test_identity_terms_carry_no_weight(spark):
    with_, without = model(spark, 30.0), model(spark, 0.0)
    neutral = "balo demi finu gopa kura lalo memi ninu popa rura salo temi muslim balo femi ginu kopa lura malo nemi pinu ropa"
    odds = lambda p: np.log(p / (1 - p))
    change = lambda m: odds(m.score(neutral)) - odds(m.score(neutral.replace("muslim", "christian")))
    assert change(without) > 0.3
    assert abs(change(with_)) < change(without) / 3
    assert with_.score("you vermin scumbag idiotic vermin") > 0.7 and with_.score(neutral) < 0.3
    assert with_.score(None) == with_.score("") < 0.5


def test_fit_lowers_the_penalised_change():
    rows = [(1, [0, 1], [1.0, 1.0])] * 20 + [(0, [2], [1.0])] * 20 + [(-1, [1], [-1.0])] * 5
    free, _ = T.fit(rows, 3, counterfactual=0.0)
    held, _ = T.fit(rows, 3, counterfactual=10.0)
    assert free[1] > 0.5 and abs(held[1]) < 0.1 * free[1] and held[0] > 0


def dense_fit(rows, n, strength):
    """The fit written out over whole matrices."""
    def matrix(part):
        m = np.zeros((len(part), n))
        for i, (_, at, v) in enumerate(part):
            m[i, at] = v
        return m
    x, d = matrix([r for r in rows if r[0] >= 0]), matrix([r for r in rows if r[0] < 0])
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.array([r[0] for r in rows if r[0] >= 0])
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, 401):
        g = x.T @ (1 / (1 + np.exp(-(x @ w))) - y) / len(y)
        g[:n] += T.RIDGE * w[:n] + (strength * d.T @ (d @ w[:n]) / len(d) if len(d) else 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def test_learned_as_by_brute_force(spark):
    """Features, vectors, swaps and fit recomputed in plain Python over dense matrices."""
    docs = labelled()
    feats = [{f for w in T.words_of(t) for f in T._features(w)} for _, t, _ in docs]
    n = {k: sum(y == k for *_, y in docs) for k in (0, 1)}
    strength = {}
    for f in set().union(*feats):
        c = [sum(f in fs for fs, (*_, y) in zip(feats, docs) if y == k) for k in (0, 1)]
        if sum(c) >= T.LEAST and len(f) > 3:
            a, b = c[1] + 0.5, c[0] + 0.5
            strength[f] = abs((np.log(a / (n[1] + 1)) - np.log(b / (n[0] + 1))) / np.sqrt(1 / a + 1 / b))
    names = sorted(strength, key=lambda f: (-strength[f], f))[:T.FEATURES]

    def vector(words):
        out = {}
        for i, f in enumerate(names):
            c = sum(f in T._features(w) for w in words)
            if c:
                out[i], out[i + len(names)] = np.log1p(c), np.log1p(200 * c / max(50, len(words)))
        return out

    rows = []
    groups = {t: g for g in T.IDENTITY for t in g}
    for _, text, y in docs:
        words = T.words_of(text)
        own = vector(words)
        rows.append((y, list(own), list(own.values())))
        named = [w.decode() for w in words if w.decode() in groups]
        for k in range(max((len(groups[w]) for w in named), default=0)):
            others = {w: [o for o in groups[w] if o != w] + [T.NEUTRAL] for w in named}
            new = vector([others[w.decode()][k % len(others[w.decode()])].encode() if w.decode() in others else w for w in words])
            change = {i: new.get(i, 0) - own.get(i, 0) for i in own.keys() | new.keys() if new.get(i, 0) != own.get(i, 0)}
            if change:
                rows.append((-1, list(change), list(change.values())))
    w = dense_fit(rows, 2 * len(names), 1.0)
    bias = w[-1]
    learned = model(spark, 1.0)
    assert set(learned.weights) == set(names)
    for _, text, _ in docs[:60]:
        z = bias + sum(x * w[i] for i, x in vector(T.words_of(text)).items())
        assert abs(learned.score(text) - 1 / (1 + np.exp(-z))) < 5e-3


def test_many_identity_terms():
    """Changes of 60,000 swaps over 2,000 features are kept as a few values each, not as 480 MB."""
    import tracemalloc
    rows = [(i % 2, [i % 7], [1.0]) for i in range(40)] + [(-1, [i % 2000, (i * 7 + 1) % 2000], [-1.0, 1.0]) for i in range(60_000)]
    tracemalloc.start()
    w, _ = T.fit(rows, 2000, steps=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(w) == 2000 and peak < 120e6


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (2, "", 0.0), (None, "vermin " * 50_000, 0.0)], "doc_id bigint, text string, score double")
    rows = T.score_toxicity(docs, model(spark, 1.0)).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows) and max(r.score for r in rows if r.doc_id is None) > 0.7
    labels = spark.createDataFrame([(1, 0), (None, 1), (7, None)], "doc_id bigint, toxic int")
    assert T.learn(labels, docs).score("vermin") < 1e-6
    assert T.learn(labels.limit(0), docs.limit(0)).score("x") < 1e-6
    assert T.score_toxicity(docs.limit(0), T.Model({}, 0.0)).collect() == []


def test_held_out(spark):
    from spanlake.llm import catalogue, common
    d = "/root/testdata/sf0.1"
    rows = catalogue.op1_toxicity(spark, d).join(common.table(spark, d, "labels"), "doc_id").where("held_out").select("toxic", "predicted").collect()
    y, p = np.array(rows).T
    assert (p[y == 1] == 1).mean() > 0.85 and (p[y == 0] == 0).mean() > 0.99
