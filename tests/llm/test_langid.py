"""Cross-parsing against a direct search in the learned text."""
import math
import random

import numpy as np

from spanlake.llm import langid as L

SAMPLE = [("de", ["der hund und die katze sitzen auf dem dach", "schöne grüße"]), ("en", ["the dog and the cat sit on the roof of the house"])]


def test_automaton_accepts_substrings_only():
    r = random.Random(2)
    text = [r.randrange(3) for _ in range(120)]
    moves = L.Automaton(text).next
    have = {tuple(text[i:j]) for i in range(120) for j in range(i + 1, min(121, i + 9))}
    for _ in range(500):
        probe = tuple(r.randrange(3) for _ in range(r.randrange(1, 8)))
        s = 0
        for c in probe:
            s = moves[s].get(c, -1)
            if s < 0:
                break
        assert (s >= 0) == (probe in have)


def phrases(symbols, texts):
    """Greedy parse into longest substrings of the learned texts, pieces apart."""
    n = 0
    for p in range(0, len(symbols), L.PIECE):
        piece, at = symbols[p:p + L.PIECE], 0
        while at < len(piece):
            n, size = n + 1, 1
            while at + size < len(piece) and any(tuple(piece[at:at + size + 1]) == tuple(t[i:i + size + 1]) for t in texts for i in range(len(t) - size)):
                size += 1
            at += size
    return n


def test_parse_counts():
    parser = L.Parser(SAMPLE)
    texts = ["the cat on the roof", "Der Hund, der Hund!", "xqz ßß 語", "a", "", "the dog " * 100]
    rates, lettered = parser.rates(texts)
    assert lettered.tolist() == [True, True, True, True, False, True]
    for j, (_, learned) in enumerate(SAMPLE):
        own = [parser._symbols([t])[0].tolist() for t in learned]
        own = [[s for s in t] for t in own]
        n = sum(len(t) + 1 for t in own)
        for i, t in enumerate(texts):
            sym = parser._symbols([t])[0].tolist()
            if sym and L.STRANGE not in sym:
                assert math.isclose(rates[i, j], phrases(sym, own) * math.log2(n) / len(sym))


def test_rows(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", "x", 1.0), (2, "die Katze und der Hund", "de", "y", 2.0), (3, None, "en", "x", 0.0), (4, "", "de", "x", 0.0),
                                  (5, "123 !?", "en", "x", 0.0), (6, "the house " * 20_000, None, "x", 0.0), (6, "the house", None, "x", 0.0), (None, "der hund", "de", "z", 1.0)],
                                 "doc_id bigint, text string, lang string, lang_pred string, score double")
    sample = L.labelled_sample(docs)
    assert [s[0] for s in sample] == ["de", "en"]
    got = {(r[0], r[1]): r for r in L.identify(docs, sample, keep=["doc_id", "lang"]).collect()}
    assert [got[k].lang_pred for k in ((1, "en"), (2, "de"), (3, "en"), (4, "de"), (5, "en"), (6, None), (None, "de"))] == ["en", "de", "und", "und", "und", "en", "de"]
    assert got[3, "en"].score == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert sorted((r[0] or 0) for r in L.keep_known(docs, sample).collect()) == [0, 1, 2, 6, 6]
    assert L.keep_known(docs, sample).columns == docs.columns
    assert L.identify(docs.limit(0), sample).collect() == []
    assert {r.lang_pred for r in L.identify(docs, []).collect()} == {"und"}
    assert L.labelled_sample(docs.limit(0)) == []


def test_held_out(spark):
    from spanlake.llm import catalogue, common
    d = "/root/testdata/sf0.01"
    got = catalogue.op10_language_id(spark, d).join(common.table(spark, d, "documents"), "doc_id").where("held_out").select("lang", "lang_pred").collect()
    assert np.mean([a == b for a, b in got]) > 0.98


def test_many_scripts(spark):
    """Languages with far more letters together than a table has columns: each is known, none is dropped."""
    def texts(first, count, seed):
        r = random.Random(seed)
        words = ["".join(chr(first + r.randrange(count)) for _ in range(r.randrange(1, 5))) for _ in range(60)]
        return [" ".join(r.choice(words) for _ in range(80)) for _ in range(12)]
    found = {"zh": texts(0x4E00, 3000, 1), "ko": texts(0xAC00, 3000, 2), "ii": texts(0xA000, 1100, 5), "en": texts(ord("a"), 26, 3), "ru": texts(0x430, 32, 4)}
    docs = spark.createDataFrame([(i * 5 + j, t, lang) for j, (lang, ts) in enumerate(found.items()) for i, t in enumerate(ts)], "doc_id bigint, text string, lang string")
    sample = L.labelled_sample(docs.where("doc_id < 40"))
    rows = L.identify(docs, sample).collect()
    assert all(r.lang == r.lang_pred for r in rows) and max(r.rate for r in rows) < 12
    assert L.keep_known(docs, sample).count() == docs.count()


def test_slices_change_no_result(monkeypatch):
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"text": ["the dog sat", None, "der hund", "", "xyz " * 200, "12"] * 5})
    got = []
    for size in (40, L.SLICE):
        monkeypatch.setattr(L, "SLICE", size)
        got.append([r for b in L._scored(SAMPLE, "text")([batch]) for r in b.to_pylist()])
    assert got[0] == got[1] and len(got[0]) == 30
