"""Closed syncmers against their definition, fingerprints and edits."""
import hashlib
import random

import numpy as np

from spanlake.llm import syncmers as S


def brute(text, k, s):
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    h = {}

    def inner(i):
        piece = points[i:i + s].tobytes()
        if piece not in h:
            h[piece] = len(h)
        return h[piece]
    # the order of inner hashes is the operator's own: read it from single k-mers
    out = []
    for i in range(len(points) - k + 1):
        if len(S._anchors(points[i:i + k], k, s)[0]):
            out.append(i)
    return out


def test_choice_is_free_of_context():
    r = random.Random(1)
    for _ in range(20):
        text = "".join(r.choice("abcdé語") for _ in range(r.randrange(0, 120)))
        at, _ = S._anchors(np.frombuffer(text.encode("utf-32-le"), np.uint32), 12, 5)
        assert at.tolist() == brute(text, 12, 5)


def test_every_window_has_an_anchor():
    r = random.Random(2)
    text = "".join(r.choice("abcdefghij ") for _ in range(5000))
    at, _ = S._anchors(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    assert np.diff(at).max() <= S.K - S.S + 1
    assert 0.1 < len(at) / 5000 < 0.3


def test_likeness():
    r = random.Random(3)
    text = " ".join(f"{r.randrange(10**6):x}" for _ in range(600))
    other = " ".join(f"{r.randrange(10**6):x}" for _ in range(600))
    a, b, c = S.fingerprints([text, other, text[:len(text) * 2 // 3] + other[:len(text) // 3]])
    assert S.likeness(a, a) == 1 and S.likeness(a, b) < 0.05 and 0.35 < S.likeness(a, c) < 0.65
    assert S.fingerprints(["", "ab", "ab", "ba"]) == [[], *[S.fingerprints(["ab"])[0]] * 2, S.fingerprints(["ba"])[0]]
    assert S.likeness([], []) == 1 and S.likeness([], [1]) == 0
    assert S.likeness([1, 2, 3, 4], [4, 3, 2, 1]) == 0.25
    assert S.fingerprints([text, "x", other]) == [a, S.fingerprints(["x"])[0], b]


def test_rows(spark):
    r = random.Random(4)
    docs = [(i * 3, "".join(r.choice("abc é語") for _ in range(r.choice([0, 1, 2, 3, 40, 400])))) for i in range(200)]
    docs += [(30, "second row of thirty"), (30, "another"), (None, "no id"), (None, None), (999, None), (1001, "y" * 300_000)]
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in docs], "doc_id bigint, text string, fingerprint string, bucket int").repartition(7)
    order = sorted(((d if d is not None else -(1 << 63), t or "") for d, t in docs), key=lambda x: (-x[0], x[1]))
    for buckets in (1, 5, 64):
        got = S.fingerprint_edits(df, buckets=buckets).collect()
        want = []
        for i, (d, t) in enumerate(order):
            n = len(t) // 3
            want.append((d, len(t), hashlib.sha256((t[:len(t) - n] + order[(i + 1) % len(order)][1][:n]).encode()).hexdigest()))
        assert sorted((x[0] if x[0] is not None else -(1 << 63), x[1], x[2]) for x in got) == sorted(want)
        by = {}
        for x in got:
            assert 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1
            if x[1] == 0:
                by.setdefault(0, set()).add(x.fingerprint)
        assert by[0] == {""}
    assert S.fingerprint_edits(df.limit(0)).collect() == []
    one = S.fingerprint_edits(spark.createDataFrame([(1, "abcdef")], "doc_id bigint, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_text_without_a_syncmer():
    """Long enough for a k-mer, but no k-mer of it is closed: told apart from the empty text and from each other."""
    r = random.Random(6)
    texts = ["".join(r.choice("abcdefghij ") for _ in range(r.randrange(16, 20))) for _ in range(200)]
    bare = [t for t in texts if not len(S._anchors(np.frombuffer(t.encode("utf-32-le"), np.uint32))[0])]
    prints = S.fingerprints(bare)
    assert len(bare) > 20 and all(len(f) == 1 for f in prints) and len({f[0] for f in prints}) == len(set(bare))
    assert S.likeness(prints[0], prints[1]) == 0 and S.likeness(prints[0], []) == 0
