"""Licence scan against plain Python, and its size bounds."""
import re

from spanlake.llm import licences as L


def grams(t):
    w = re.findall(r"[^\W_]+", t.lower())
    return {tuple(w[i:i + 2]) for i in range(len(w) - 1)}


def sentences(u):
    """Parts between an end mark and a capital letter that white space, maybe with marks of a comment, divides."""
    out, start = [], 0
    for m in re.finditer(r"""[.!?]["')\]]*\s[\s*#/;%-]*(?=[^\W\d_])""", u):
        if u[m.end()].isupper():
            out, start = out + [u[start:m.start()]], m.end()
    return out + [u[start:]]


def brute(docs):
    best = {}
    for d, t in docs:
        units = set((t or "").split("\n")) | {p for p in re.split(r"\n[ \t\r*#/;%-]*\n", t or "") if "\n" in p}
        units |= {x for u in units for x in sentences(u)}
        for u in units:
            for name, body in L.TEMPLATES:
                a, b = grams(u), grams(body)
                if a and 2 * len(a & b) / (len(a) + len(b)) >= L.LEAST:
                    dice, found = best.get((d, name), (0, set()))
                    best[d, name] = (max(dice, round(2 * len(a & b) / (len(a) + len(b)), 9)), found | {u})
    return {k: (x, len(f)) for k, (x, f) in best.items()}


def test_rows(spark):
    mit = L.TEMPLATES[5][1]
    wrapped = "\n".join(mit[i:i + 70] for i in range(0, len(mit), 70))
    docs = [(1, "intro\nReleased under the MIT License.\nmore"), (2, "released UNDER  the mit -- license"), (3, "Released under the License."), (4, f"x\n\n{mit.replace('free', 'without')}\n\ny"),
            (5, mit), (6, "text with no notice at all"), (7, None), (8, ""), (9, "word"), (10, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."),
            (11, "filler words here " * 20_000 + "\nLicensed under CC BY-NC 4.0."), (12, f"a b c\n\n{' '.join(mit.split()[:70])}\n{' '.join(mit.split()[70:])}\n \nz")]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], "doc_id bigint, text string, licence string, unit string")
    got = {(r.doc_id, r.licence): (round(r.dice, 9), r.n_units) for r in L.scan_licences(df).collect()}
    assert got == brute(docs) and (12, "mit") in got and (4, "mit") in got and wrapped
    assert L.scan_licences(df.limit(0)).collect() == []
    doubled = {(r.doc_id, r.licence): (round(r.dice, 9), r.n_units) for r in L.scan_licences(df.union(df)).collect()}
    assert doubled == got


def test_sentences_and_comments(spark):
    mit, gpl = L.TEMPLATES[5][1], L.TEMPLATES[7][1]
    star = lambda t: "\n".join(" * " + t[i:i + 60] for i in range(0, len(t), 60))
    docs = [(1, "Copyright 2021 Foo. Released under the MIT License. See LICENSE for details."), (2, f"/*\n * Copyright Foo.\n *\n{star(mit)}\n *\n * more of it\n */\nint x;"),
            (3, f"# A tool.\n#\n# {gpl[:90]}\n# {gpl[90:]}\n#\n# {'See the manual. ' * 9}"), (4, "It is free! Licensed under CC BY 4.0.\nNext (c) line. Licensed under the MIT License. v. 2"),
            (5, "Wrapped text. Released under\nthe MIT License. And more\nof it."), (6, "Version v. 2.0 of this. This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. Yes."), (7, "under the license of Foo. MIT is a school. The License.")]
    got = {(r.doc_id, r.licence): (round(r.dice, 9), r.n_units) for r in L.scan_licences(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == brute(docs)
    assert set(got) == {(1, "mit"), (2, "mit"), (3, "gpl-3.0"), (4, "cc-by-4.0"), (4, "mit"), (5, "mit"), (6, "mpl-2.0")}


def test_anchors_lose_nothing():
    """A set of a template's bigrams that reaches the least coefficient holds one of its anchors, whatever is left out."""
    for _, body in L.TEMPLATES:
        words = re.findall(r"[^\W_]+", body.lower())
        pairs, picked = grams(body), set(L.anchors(words, L.LEAST))
        free = [p for p in pairs if not picked & set(p)]
        assert 2 * len(free) / (len(free) + len(pairs)) < L.LEAST


def test_bounds_lose_nothing():
    for n in range(1, 60):
        low, high = L.bounds(n, L.LEAST)
        for m in range(1, 120):
            possible = 2 * min(n, m) / (n + m) >= L.LEAST - 1e-12
            assert possible == (low <= m <= high)
