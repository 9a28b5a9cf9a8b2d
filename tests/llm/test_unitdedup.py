"""Unit removal against a plain pass in document order."""
import re

from spanlake.llm import unitdedup as U


def brute(docs):
    seen, out = {}, {}
    for d, t in sorted(docs):
        spans = []
        for a, b in U.unit_spans(t):
            w = " ".join(re.findall(r"[^\W_]+", t[a:b].lower()))
            if len(w.split()) >= U.MIN_WORDS and seen.setdefault(w, (d, a)) != (d, a):
                spans.append((a, b))
        out[d] = spans
    return out


def test_units_cover_the_text():
    for t in ("", "a", "One two. Three!! four? Five\n\n six.\nx", "no end", "é. ü? \n", "a.b c. d"):
        spans = U.unit_spans(t)
        assert "".join(t[a:b] for a, b in spans) == t
    assert [t for a, b in U.unit_spans("One two. Three!! four? Five") for t in ["One two. Three!! four? Five"[a:b]]] == ["One two. ", "Three!! four? ", "Five"]


def test_rows(spark):
    p = "A passage that many documents share. It has more than one sentence in it."
    docs = [(5, f"Start of five here. {p} End of five here."), (2, f"Start of two here. {p}"), (9, p.upper() + "\nown words of nine"), (7, "own words of nine\nown words of nine\nshort one\nshort one"),
            (3, ""), (4, "One two three four. " * 3000)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs] + [(None, p, "x", 1), (11, None, "x", 1)], "doc_id bigint, text string, digest string, cut int").repartition(4)
    got = U.dedup_units(df)
    assert got.columns == ["doc_id", "text", "digest", "cut"]
    rows = {r[0]: r for r in got.collect()}
    want = brute(docs)
    for d, t in docs:
        assert [(c[0], c[1]) for c in rows[d].cut] == want[d]
        keep = [(a, b) for a, b in U.unit_spans(t) if (a, b) not in want[d]]
        assert rows[d].text == "".join(t[a:b] for a, b in keep)
    assert rows[None].text == p and rows[11].text is None
    assert rows[5].text == "Start of five here. End of five here."
    assert rows[9].text == "own words of nine" [:0] or rows[9].text == ""
    assert U.dedup_units(df.limit(0)).collect() == []
    again = {r[0]: r[1] for r in U.dedup_units(df.union(df)).where("doc_id = 5").select("doc_id", "text").collect()}
    assert again == {5: rows[5].text}
