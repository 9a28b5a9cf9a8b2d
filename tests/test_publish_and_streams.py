"""Publication rules and streaming twins."""
import pytest
from pyspark.sql import functions as F

from spanlake.catalogue.views import Views
from spanlake.config import profile
from spanlake.operators.filters import normalize_channels, resolve_scope, schema_contract, vector_lookup
from spanlake.operators.identity import track_detections
from spanlake.operators.transcript import gap_sessions_capped
from spanlake.plans import publish as P
from spanlake.sources import writers as W
from spanlake.streaming import jobs as J

POINTER = "video_id long, modality string, asset_version string, row_count long, status string, source_asr string"


def pointers(spark, *rows):
    return spark.createDataFrame([(*r, *([None] * (6 - len(r)))) for r in rows], POINTER)


def test_publish_switches_and_disables(spark):
    old = pointers(spark, (1, "asr", "a1", 5, "ready"), (1, "speaker", "s1", 5, "ready", "a1"), (2, "asr", "b1", 1, "ready"))
    up = pointers(spark, (1, "asr", "a2", 6, "ready"))
    u, off = P.publish_dependents(up, old)
    new = P.publish(old, u, off)
    got = {(r.video_id, r.modality): (r.asset_version, r.status) for r in new.collect()}
    assert got == {(1, "asr"): ("a2", "ready"), (1, "speaker"): ("s1", "disabled"), (2, "asr"): ("b1", "ready")}
    v = P.visible_channels(new, spark.createDataFrame([(1,), (2,), (3,)], "video_id long")).collect()
    assert {r.video_id: r.indexed for r in v} == {1: ["asr"], 2: ["asr"], 3: []}


@pytest.mark.parametrize("rows", [
    [(1, "smell", "a", 1, "ready")], [(1, "asr", " ", 1, "ready")], [(1, "asr", "a", -1, "ready")], [(1, "asr", "a", 1, "odd")], [(1, "asr", "a", 1, "ready"), (1, "asr", "b", 1, "ready")], [(9, "asr", "a", 1, "ready")]])
def test_publish_rejects_the_whole_batch(spark, rows):
    old = pointers(spark, (1, "asr", "a0", 1, "ready"))
    with pytest.raises(Exception):
        P.publish(old, pointers(spark, *rows), videos=spark.createDataFrame([(1,)], "video_id long")).collect()


def test_rebuild_order():
    assert P.rebuild_order(["ocr", "speaker", "asr", "visual"]) == ["visual", "asr", "ocr"]
    assert P.rebuild_order(["speaker", "face"]) == ["face", "speaker"]


def test_snapshot_table_keeps_readers_on_one_version(spark, tmp_path):
    t = W.SnapshotTable(spark, str(tmp_path / "t"))
    assert t.version() is None
    t.commit(spark.range(3))
    held = t.read()
    t.commit(t.read().where("id > 0"))
    assert held.count() == 3 and t.read().count() == 2 and t.version() == 2


def test_scope_rules(spark):
    v = spark.createDataFrame([(1,), (2,), (3,)], "video_id long")
    m = spark.createDataFrame([(1, 10)], "video_id long, folder_id long")
    f = spark.createDataFrame([(10,), (11,)], "folder_id long")
    ids = lambda d: sorted(r.video_id for r in d.collect())
    assert ids(resolve_scope(v, m)) == [1, 2, 3]
    assert ids(resolve_scope(v, m, video_ids=v.limit(0))) == []
    assert ids(resolve_scope(v, m, folder_ids=f.where("folder_id = 11"), folders=f)) == []
    assert ids(resolve_scope(v, m, folder_ids=f.where("folder_id = 10"), include_default=True, folders=f)) == [1, 2, 3]
    with pytest.raises(Exception):
        resolve_scope(v, m, folder_ids=spark.createDataFrame([(99,)], "folder_id long"), folders=f).collect()


def test_guards_fail_loudly(spark):
    with pytest.raises(Exception):
        spark.createDataFrame([("asr,smell",)], "c string").select(normalize_channels("c")).collect()
    with pytest.raises(ValueError):
        schema_contract(spark.range(1), spark.createDataFrame([], "id long, x string").schema)
    u = spark.createDataFrame([(1, 0, [1.0])], "video_id long, idx long, embedding array<double>")
    with pytest.raises(Exception):
        vector_lookup(spark.createDataFrame([(1, 5)], "video_id long, idx long"), u, ["video_id", "idx"]).collect()
    with pytest.raises(ValueError):
        profile("balanced", face_threshold=2.0)


def test_visual_contract_rejects_overlapping_segments(spark):
    cols = "video_id long, asset_version string, frame_idx long, timestamp_ms long, segment_id long, segment_start_ms long, segment_end_ms long, embedding array<float>"
    good = [(1, "v", 0, 0, 0, 0, 5000, [1.0]), (1, "v", 1, 5000, 1, 5000, 10000, [1.0]), (1, "v", 2, 10000, 1, 5000, 10000, [1.0])]
    assert W.visual_units(spark.createDataFrame(good, cols), "m", 1).count() == 3
    for bad in ([(1, "v", 0, 0, 0, 0, 6000, [1.0]), good[1]], [(1, "v", 0, 5000, 0, 0, 5000, [1.0]), good[1]], [(1, "v", 0, 0, 0, 0, 5000, [0.0])]):
        with pytest.raises(Exception):
            W.visual_units(spark.createDataFrame(bad, cols), "m", 1).collect()


def stream_of(spark, df, path):
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_capped_sessions_stream_equals_batch(spark, tmp_path):
    v = Views(spark, "/root/testdata/sf0.001")
    i = v.intervals("visual", "asr").select("video_id", "unit_id", "start", "end", F.timestamp_micros((F.col("start") * 1_000_000).cast("long")).alias("ts"))
    out = J.run_to_files(J.capped_sessions(stream_of(spark, i.drop("unit_id"), str(tmp_path / "i")), "video_id", 2.0, 12.0), str(tmp_path / "o"))
    mark = i.agg(F.max("start")).first()[0] - 10
    got = {(r.video_id, round(r.start, 6), round(r.end, 6), r.intervals) for r in out.collect()}
    batch = {(r.video_id, round(r.start, 6), round(r.end, 6), r.intervals) for r in gap_sessions_capped(i, ["video_id"], 2.0, 12.0, "unit_id", 24.0).collect()}
    settled = {r for r in batch if r[2] + 2.0 < mark - 1}
    assert settled <= got <= batch


def test_capped_sessions_hold_many_keys_in_a_state(spark, tmp_path):
    """200 keys, one of them null and one beyond what a double holds, in four states over two batches; rows as of the batch form."""
    rows = [(None if k == 7 else 2 ** 60 + 1 if k == 8 else k, 100.0 + 30 * g + k % 5 + 3 * i, 101.5 + 30 * g + k % 5 + 3 * i) for k in range(200) for g in range(3) for i in range(1 + (k + g) % 6)]
    i = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "video_id long, start double, end double, unit_id long")
    last = spark.createDataFrame([(-1, 1000.0, 1001.0, -1)], i.schema)  # moves the watermark past all others
    d = i.union(last).withColumn("ts", F.timestamp_micros((F.col("start") * 1_000_000).cast("long"))).drop("unit_id")
    path = str(tmp_path / "i")
    for part in (d.where("start < 140"), d.where("start >= 140")):
        part.coalesce(1).write.mode("append").parquet(path)
    s = J.capped_sessions(spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(path), "video_id", 2.0, 12.0, buckets=4)
    q = s.writeStream.format("memory").queryName("capped").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    states = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
    assert max(x["numRowsTotal"] for x in states) <= 4
    got = sorted(map(str, ((r.video_id, r.start, r.end, r.intervals) for r in spark.table("capped").collect())))
    named = i.withColumn("video_id", F.coalesce("video_id", F.lit(-7)))
    want = gap_sessions_capped(named, ["video_id"], 2.0, 12.0, "unit_id", 24.0).collect()
    assert got == sorted(map(str, ((None if r.video_id == -7 else r.video_id, r.start, r.end, r.intervals) for r in want)))


def test_tracks_stream_equals_batch(spark, tmp_path):
    v = Views(spark, "/root/testdata/sf0.001")
    d = v.frames.selectExpr("video_id", "vec_id AS det_id", "CAST(1000 + floor(frame_idx / 4) * 0.5 + floor(frame_idx / 40) * 3 AS DOUBLE) AS t", "(vec_id % 100) / 100.0D AS det_score",
                            "(vec_id * 7 % 101) / 101.0D AS quality", "array(10.0D * (label % 5), 0.0D, 10.0D * (label % 5) + 8, 8.0D) AS bbox", "embedding")
    s = d.withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")))
    out = J.run_to_files(J.tracks(stream_of(spark, s, str(tmp_path / "i")), "video_id"), str(tmp_path / "o"))
    batch = track_detections(d.withColumnRenamed("t", "ts"))
    key = lambda r: (r.video_id, r.first_det, r.start_ms, r.end_ms, r.detections)
    got, want = {key(r) for r in out.collect()}, {key(r) for r in batch.collect()}
    mark = d.agg(F.max("t")).first()[0] * 1000 - 5000
    assert {w for w in want if w[3] + 1500 < mark} <= got <= want
