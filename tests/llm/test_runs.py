"""Runs against all lags of all places."""
import hashlib
import random
import zlib

import numpy as np

from spanlake.llm import catalogue, runs


def brute(words):
    """Runs by comparing every word with the one q places on, for each q."""
    n, by_ends = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                by_ends.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in by_ends.items())


def altered(words, doc_id):
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def row(doc_id, text):
    words = altered((text or "").encode().split(), doc_id)
    found = brute(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def samples():
    r = random.Random(11)
    yield from ([], [1], [1] * 11, [1] * 12, [1] * 500, thue_morse(512), [1, 2] * 6, [1, 2, 3, 4, 5, 6] * 2, [1, 2, 3, 4, 5, 6] * 2 + [1], list(range(50)) * 2, [0] * 7 + [1] + [0] * 30)
    a, b = [1], [1, 2]
    while len(b) < 400:
        a, b = b, b + a
    yield b
    for _ in range(300):
        words, letters = [], r.choice([2, 3, 20])
        while len(words) < r.randrange(300):
            piece = [r.randrange(letters) for _ in range(r.choice([1, 2, 3, 5, 8, 13, 34, 55]))]
            words += piece * r.choice([1, 1, 2, 3, 9])
            if r.random() < 0.3 and words:
                words.pop()
        yield words


def test_all_runs_are_found():
    texts = list(samples())
    lengths = np.array([len(t) for t in texts])
    doc, start, length, period = runs.find_runs(np.array([x for t in texts for x in t], np.int64), lengths)
    got = [[] for _ in texts]
    for d, *x in zip(doc.tolist(), start.tolist(), length.tolist(), period.tolist()):
        got[d].append(tuple(x))
    assert got == [brute(t) for t in texts]
    assert sum(map(len, got)) > 900


def test_copies_of_a_text_are_no_run_across_texts():
    codes = np.arange(20)
    assert [len(x) for x in runs.find_runs(np.concatenate([codes, codes, codes]), np.array([20, 20, 20]))] == [0] * 4


def test_work_of_one_repeated_word_is_in_proportion():
    seen = []
    for n in (20_000, 80_000):
        names = runs._Names
        count = [0]

        class Counting(names):
            def extend(self, i, j, most, left=False):
                count[0] += len(i)
                return names.extend(self, i, j, most, left)
        runs._Names = Counting
        try:
            assert [x.tolist() for x in runs.find_runs(np.zeros(n, np.int64), np.array([n]))] == [[0], [0], [n], [1]]
        finally:
            runs._Names = names
        seen.append(count[0])
    assert seen[0] <= 2 * 20_000 and seen[1] <= 2 * 80_000  # two extensions for each lag of a period


def test_rows(spark):
    r = random.Random(5)
    docs = []
    for i in range(400):
        words = []
        while len(words) < r.choice([0, 3, 30, 200]):
            words += [r.choice(["a", "A", "é", "語", "x y", "the"]) for _ in range(r.choice([1, 4, 7, 20]))] * r.choice([1, 1, 2, 4])
        docs.append((i * 7, "".join(w + r.choice([" ", "\n", "\t ", "\x0b", "\x1c", " "]) for w in words)))
    docs += [(70, "a row again"), (70, "a row again"), (None, "na " * 40), (None, None), (9999, None), (9998, " \n "), (9997, "x " * 30_000), (9996, "y" * 200_000)]
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in docs], "doc_id bigint, text string, runs int, start string").repartition(5)
    df.limit(0).createOrReplaceTempView("no_docs")
    want = sorted((row(d, t) if t is None or len(t) < 50_000 else None for d, t in docs), key=str)
    got = [tuple(x) for x in catalogue.runs_query(df).collect()]
    assert sorted((x for x in got if x[0] not in (9997, 9996)), key=str) == [w for w in want if w]
    one = next(x for x in got if x[0] == 9997)
    assert one[1] >= 1 and one[4] >= 1 and len(got) == len(docs)
    assert catalogue.runs_query(spark.table("no_docs")).collect() == []
