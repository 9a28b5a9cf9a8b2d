"""Text and transcript operators on literal inputs."""
import pytest
from pyspark.sql import functions as F

from spanlake.functions import text as T
from spanlake.operators import transcript as R
from spanlake.sources.readers import read_ground_truth, read_transcript_sidecar

ITEM = "video_id long, item_id long, start_ms long, end_ms long, text string, unit_id long, emotion string, audio_event string"


def chunks(spark, rows, **kw):
    full = [(1, i, r[0], r[1], r[2], r[3] if len(r) > 3 else None, r[4] if len(r) > 4 else "", r[5] if len(r) > 5 else "") for i, r in enumerate(rows)]
    items = spark.createDataFrame(full, ITEM)
    c = R.build_chunks(items, **kw)
    return c.orderBy("chunk_id").collect(), R.chunk_stats(items, c).collect()[0]


def test_chunks_merge_and_carry_labels(spark):
    c, s = chunks(spark, [(0, 800, "what are y", None, "neutral", "speech"), (900, 1800, "ou doing", None, "happy", "speech|bgm")])
    assert [(x.text, x.emotion, x.audio_event) for x in c] == [("what are y ou doing", "neutral|happy", "speech|bgm")]
    assert s.merged_items == 1


@pytest.mark.parametrize("rows", [
    [(3_901_100, 3_914_180, "一个人唤醒了,他是我从来没有见过的那种男生,孤"), (3_918_120, 3_924_180, "独敏感又倔强。")],
    [(3_944_040, 3_956_760, "是不是很"), (3_963_550, 3_978_150, "难受啊,你永"), (3_978_270, 3_991_830, "远别再让我看见你")],
    [(0, 1200, "我到了。"), (5000, 6500, "下一件事开始。")],
    [(0, 1200, "我到了。"), (1300, 2500, "下一件事开始。")],
    [(1000, 2500, "hello world"), (5000, 7000, "green field")],
    [(0, 7000, "the first unfinished thought", 0), (7100, 13000, "continues beyond the limit", 0)],
])
def test_chunks_stay_apart(spark, rows):
    c, s = chunks(spark, rows)
    assert [x.text for x in c] == [r[2] for r in rows] and s.merged_items == 0


def test_chunks_units_and_flags(spark):
    c, s = chunks(spark, [(0, 2000, "we need to control", 0), (2050, 4000, "this somehow", 1)])
    assert len(c) == 2 and s.cross_unit_merge_blocks == 1
    c, s = chunks(spark, [(0, 13_000, "但是", 0), (20_000, 20_100, "   ", 0)])
    assert (c[0].semantic_eligible, c[0].semantic_reason) == (False, "filler")
    assert c[0].quality_flags == ["non_terminal_boundary", "long_chunk", "embedding_ineligible:filler"]
    assert (s.long_chunks, s.low_boundary_chunks, s.semantic_ineligible_chunks, s.dropped_empty_items, s.raw_items) == (1, 1, 1, 1, 2)


def test_chunk_folds_a_long_run(spark):
    rows = [(i * 1000, i * 1000 + 900, f"w{i}") for i in range(60)]
    c, _ = chunks(spark, rows)
    assert [x.chunk_id for x in c] == list(range(len(c))) and sum(len(x.source_item_ids) for x in c) == 60
    assert all(x.end_ms - x.start_ms <= 12000 for x in c)


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn("x").alias("y")).first().y


@pytest.mark.parametrize("raw,want", [("  ＡＢＣ　１２３  ", "ABC 123"), ("這裡是臺灣", "这里是台湾"), ("嗯，嗯。你好", "你好"), ("嗯嗯", "嗯嗯"), ("um uh hello", "hello"), ("um hello", "um hello"), ("嗯嗯嗯 啊", "嗯嗯嗯 啊")])
def test_normalize(spark, raw, want):
    assert one(spark, raw, T.normalize_text) == want


def test_search_form_and_quality(spark):
    assert one(spark, "Straße_№ 5!", T.normalize_search_text) == "strasseno5"
    rows = [("", None, "empty"), ("嗯嗯嗯", None, "filler"), ("OK but", None, "filler"), ("猫", None, "too_short"), ("猫咪", None, "ok"), ("一二三四五六七八", 300, "impossible_text_rate"), ("hello there", 300, "ok")]
    d = spark.createDataFrame(rows, "text string, ms long, want string")
    got = T.semantic_eligible(d, "text", F.col("ms")).collect()
    assert [(r.text, r.quality.reason) for r in got] == [(r.text, r.want) for r in got]


def test_tokens(spark):
    assert one(spark, "Hello 世界和平 x9 国", T.tokenize) == ["hello", "世界", "界和", "和平", "x9", "国"]
    assert one(spark, "中a文字", T.tokenize) == ["中", "a", "文字"]


def test_truncate_cuts_on_character_boundary(spark):
    y = one(spark, "字" * 3000, T.truncate_text_utf8)
    assert y == "字" * 1666


def test_tags_and_alignment(spark):
    t = one(spark, "<|zh|><|HAPPY|><|Speech|>hi<|BGM|>", T.extract_tags)
    assert (t.text, t.emotion, t.audio_event) == ("hi", "happy", "speech|bgm")
    d = spark.createDataFrame([("a b ab", ["a", "ab"]), ("a b", ["c"]), ("x", [""])], "t string, w array<string>")
    assert [None if r[0] is None else [(s.s, s.e) for s in r[0]] for r in d.select(T.align_tokens("t", "w")).collect()] == [[(0, 1), (4, 6)], None, None]


def test_punctuation_split(spark):
    d = spark.createDataFrame([(1, 0, 20_000, "first part here. second part there"), (2, 0, 20_000, "no marks at all"), (3, 0, 900, "a. b")], "item_id long, start_ms long, end_ms long, text string")
    got = R.split_safe_punctuation(d).orderBy("item_id", "start_ms").collect()
    assert [(r.item_id, r.text, r.split) for r in got] == [(1, "first part here.", "punctuation_linear_time"), (1, "second part there", "punctuation_linear_time"), (2, "no marks at all", "kept_whole"), (3, "a. b", "none")]
    assert got[0].end_ms == got[1].start_ms == round(20_000 * 16 / 34)


def test_timed_splits(spark):
    w = spark.createDataFrame([(1, "<|happy|>one two. three four", ["one", "two", "three", "four"], [[0, 900], [1000, 1800], [1900, 2500], [5000, 5500]])], "id long, text string, words array<string>, timestamp array<array<bigint>>")
    got = R.split_word_timestamps(w, ["id"]).orderBy("item_id").collect()
    assert [(r.text, r.start_ms, r.end_ms, r.reason, r.emotion) for r in got] == [("one two.", 0, 1800, "strong_punctuation", "happy"), ("three", 1900, 2500, "word_gap", "happy"), ("four", 5000, 5500, "end", "happy")]
    c = spark.createDataFrame([(1, "你好吗。再见", [[0, 700], [700, 1400], [1400, 2000], [2100, 2500], [2500, 3000]]), (2, "abcdefghij", [[0, 1]])], "id long, text string, timestamp array<array<bigint>>")
    got = R.split_char_timestamps(c, ["id"]).orderBy("item_id").collect()
    assert [(r.id, r.text, r.start_ms, r.end_ms) for r in got] == [(1, "你好吗。", 0, 2000), (1, "再见", 2100, 3000)]


def test_engine_records(spark):
    rows = [(1, {"sentence_info": [{"start": 0, "end": 5, "text": "<|sad|>s1"}, {"start_ms": 6, "sentence": "s2"}], "text": "ignored"}),
            (2, {"text": "abcdefghijkl", "timestamp": [[0, 5]], "start": 7, "end": 9}), (3, {"text": "hi there", "timestamp": [[1, 2], [3, 4]]}), (4, {"text": "  "})]
    d = spark.createDataFrame([(i, __import__("json").dumps(r)) for i, r in rows], "id long, j string").select("id", F.from_json("j", R.RECORD_SCHEMA).alias("r")).select("id", "r.*")
    got = R.read_asr_records(d, ["id"], split_text=False).orderBy("id", "item_id").collect()
    assert [(r.id, r.start_ms, r.end_ms, r.text, r.source, r.mismatch) for r in got] == [
        (1, 0, 5, "s1", "sentence", False), (1, 6, 6, "s2", "sentence", False), (2, 7, 9, "abcdefghijkl", "text", True), (3, 1, 4, "hi there", "timestamp", False)]
    assert got[0].emotion == "sad"


def test_words_by_gap(spark):
    w = [("Hi", 0, .4), (".", .4, .5), ("go", .6, 2.2), ("on!", 2.2, 2.6), ("later", 5.0, 5.4)]
    d = spark.createDataFrame([(1, i, float(a), float(b), t) for i, (t, a, b) in enumerate(w)], "seg long, word_idx long, start_time double, end_time double, word string")
    got = R.split_words_by_gap(d, ["seg"]).orderBy("first_word").collect()
    assert [(r.text, r.start_time, r.end_time) for r in got] == [("Hi. go on!", 0.0, 2.6), ("later", 5.0, 5.4)]


def test_capped_sessions(spark):
    d = spark.createDataFrame([(1, i, float(i * 3), float(i * 3 + 2)) for i in range(10)] + [(1, 99, 100.0, 120.0)], "v int, id int, start double, end double")
    got = sorted((r.start, r.end, r.intervals) for r in R.gap_sessions_capped(d, ["v"], 2.0, 12.0, "id", 10.0).collect())
    assert got == [(0.0, 11.0, 4), (12.0, 23.0, 4), (24.0, 29.0, 2), (100.0, 120.0, 1)]


def test_fallback_reasons(spark):
    p = [(1, 0, 0.0, 20.0, "some long text without an end"), (2, 0, 0.0, 20.0, "abc def"), (3, 0, 0.0, 20.0, "abc def ghi"), (4, 0, 0.0, 20.0, "abc def"), (5, 0, 0.0, 20.0, "abc def")]
    f = [(1, 0, 0.0, 9.0, "some long text."), (1, 1, 9.0, 20.0, "without an end."), (2, 0, 0.0, 31.0, "abc def"), (3, 0, 0.0, 20.0, "xyz qrs tuv"), (4, 0, 0.0, 20.0, "abc def")]
    w = [(i, 0.0, 30.0) for i in range(1, 6)]
    s = "w long, row_id long, start_time double, end_time double, text string"
    got = R.fallback_acceptance(spark.createDataFrame(p, s), spark.createDataFrame(f, s), spark.createDataFrame(w, "w long, w_start double, w_end double"), ["w"]).collect()
    assert {r.w: r.reason for r in got} == {1: "improved_unpunctuated_span", 2: "timestamp_out_of_window", 3: "text_content_mismatch", 4: "no_boundary_improvement", 5: "empty_fallback"}


def test_sidecar_and_truth_files(spark, tmp_path):
    (tmp_path / "a.vtt").write_bytes("﻿WEBVTT\r\n\r\n1\r\n00:01,500 --> 01:00:02.250\r\nhello\r\nworld\r\n\r\nnote only\r\n".encode())
    (tmp_path / "b.json").write_text('[{"start": 1, "end_time": 2.5, "text": " x "}, {"text": " "}]')
    got = read_transcript_sidecar(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r.start_time, r.end_time, r.text) for r in got] == [(1.5, 3602.25, "hello world"), (1.0, 2.5, "x")]
    t = tmp_path / "truth.jsonl"
    t.write_text('{"groups": [{"semantic_query_id": "q", "query": "x", "category": "c", "records": [{"video_id": "v", "segments": [{"start_sec": 0, "end_sec": 1}, {"start_sec": 5, "end_sec": 6}]}]}]}')
    assert read_ground_truth(spark, str(t)).count() == 2


def test_chunk_stats_counts_merged_items_as_its_sql(spark, tmp_path):
    """Turns without a sentence end share a chunk as far as unit, pause, time and length let them."""
    import duckdb

    from spanlake.catalogue import all_queries, all_sql
    pad = lambda n, end="": ("word " * n)[:n - len(end)].rstrip().ljust(n - len(end), "x") + end
    texts = {1: [pad(100), pad(200), pad(300), pad(150), pad(100), pad(100)], 2: [pad(400), pad(700), pad(100, "."), pad(100)], 3: ["a b", pad(900), "", "short", None, pad(600)],
             4: [pad(1499 + 300), pad(1499 + 400), pad(1499 + 200)], 5: [" \n\u00a0"], 6: ["straße " * 30, "Été. Élan", pad(600), pad(40)]}
    rows = [(c, i, "user", x) for c, xs in texts.items() for i, x in enumerate(xs)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = sorted(tuple(r) for r in all_queries()["chunk_stats"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(all_sql()["chunk_stats"]).fetchall())
    assert [r[:1] + r[4:] for r in got] == [(1, 3, 0), (2, 1, 0), (3, 1, 2), (4, 0, 0), (5, 0, 1), (6, 2, 0)]
