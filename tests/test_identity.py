"""Tracking, clustering, turns, previews, matching."""
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.operators import identity as D
from spanlake.operators.filters import major_groups

TRACK = "video_id long, track_idx long, start_ms long, end_ms long, best_ms long, quality double, detections long, embedding array<float>"


def unit(*v):
    x = np.zeros(16)
    x[: len(v)] = v
    return (x / np.linalg.norm(x)).tolist()


def test_identity_groups_literal(spark):
    rows = [(1, 0, 0, 4000, 1000, .7, 5, unit(1)), (1, 1, 5000, 6000, 5200, .9, 2, unit(0, 1)), (1, 2, 8000, 13000, 9000, .95, 7, unit(.94, .2))]
    g = D.identity_groups(spark.createDataFrame(rows, TRACK)).orderBy("group_idx").collect()
    assert [(r.duration_ms, r.occurrence_count, r.representative) for r in g] == [(9000, 12, 2), (1000, 2, 1)]
    members = D.cluster_identities(spark.createDataFrame(rows, TRACK)).groupBy("group_seq").agg(F.sort_array(F.collect_list("track_idx")).alias("t")).collect()
    assert sorted(r.t for r in members) == [[0, 2], [1]]


def test_importance_does_not_saturate(spark):
    rows = [(1, 0, 0, 31_000, 1000, .5, 21, unit(1)), (1, 1, 50_000, 150_000, 60_000, .5, 80, unit(0, 1))]
    g = D.identity_groups(spark.createDataFrame(rows, TRACK)).orderBy("group_idx").collect()
    assert g[0].duration_ms == 100_000 and g[0].importance > g[1].importance


def test_major_groups(spark):
    rows = [(1, 0, 6000, 1, 3.0, 0), (1, 1, 500, 5, 2.0, 7000), (1, 2, 800, 1, 1.0, 8000)]
    g = spark.createDataFrame(rows, "video_id long, group_idx long, duration_ms long, occurrence_count long, importance double, start_ms long")
    assert {r.duration_ms for r in major_groups(g, limit=2).collect()} == {6000, 500}


def test_cluster_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 16))
    rows = []
    for i in range(120):
        e = centres[i % 4] + rng.normal(size=16) * .7
        rows.append((i % 2, i, i * 10, i * 10 + 5, i * 10, float(rng.random()), 1, e.tolist()))
    got = {(r.video_id, r.track_idx): r.group_seq for r in D.cluster_identities(spark.createDataFrame(rows, TRACK)).collect()}
    for v in (0, 1):
        groups = []
        for r in rows:
            if r[0] != v:
                continue
            x = np.array(np.array(r[7], dtype=np.float32), dtype=float)
            x /= np.linalg.norm(x)
            best = max(((min(x @ g["c"], max(x @ m for m in g["m"])), -i) for i, g in enumerate(groups)), default=None)
            if best and best[0] >= .52:
                g = groups[-best[1]]
            else:
                g = {"m": [], "w": []}
                groups.append(g)
            g["m"].append(x)
            g["w"].append(max(r[5], .1))
            c = np.average(g["m"], axis=0, weights=g["w"])
            g["c"] = c / np.linalg.norm(c)
            g.setdefault("t", []).append(r[1])
        assert [sorted(t for (vv, t), s in got.items() if vv == v and s == i) for i in range(len(groups))] == [g["t"] for g in groups]


def test_speaker_turns(spark):
    w = spark.createDataFrame([(1, 0, 0.0, 1.5, 0), (1, 1, .75, 2.25, 0), (1, 2, 1.5, 3.0, 1), (1, 3, 5.0, 6.0, 1)], "video_id long, idx long, start double, end double, label long")
    t = D.speaker_turns(w, width=1.0)
    assert sorted((r.start_ms, r.end_ms, r.label) for r in t.collect()) == [(0, 1875, 0), (1875, 3000, 1), (5000, 6000, 1)]
    c = spark.createDataFrame([(1, 0, 0, 1800), (1, 1, 1800, 3750)], "video_id long, chunk_idx long, start_ms long, end_ms long")
    u = D.speaker_turn_units(t, c)
    assert sorted((r.start, r.end, r.chunk_idx, r.track_id) for r in u.collect()) == [(0, 1800, 0, 0), (1875, 3000, 1, 1)]


def test_tracks_expire_and_match(spark):
    def det(i, ts, score, x, e):
        return (1, i, float(ts), score, .5 + i / 100, [x, 0.0, x + 10.0, 10.0], e)
    rows = [det(0, 0, .9, 0.0, unit(1)), det(1, 0, .8, 50.0, unit(0, 1)), det(2, .5, .9, 1.0, unit(1, .1)), det(3, .5, .8, 51.0, unit(.1, 1)), det(4, 5, .9, 0.0, unit(1))]
    d = spark.createDataFrame(rows, "video_id long, det_id long, ts double, det_score double, quality double, bbox array<double>, embedding array<float>")
    got = sorted((r.first_det, r.start_ms, r.end_ms, r.detections, r.best_ms) for r in D.track_detections(d).collect())
    assert got == [(0, 0, 1000, 2, 500), (1, 0, 1000, 2, 500), (4, 5000, 5500, 1, 5000)]


def test_preview_skips_overlaps(spark):
    rows = [(1, 0, i, s, s + 100, i) for i, s in enumerate([0, 50, 100, 120, 300, 400, 500, 600])]
    d = spark.createDataFrame(rows, "video_id long, track_id long, utterance_idx long, start_ms long, end_ms long, rank long")
    got = sorted((r.preview, r.utterance_idx) for r in D.nonoverlap_preview(d, ["video_id", "track_id"], [F.col("rank")], 4).collect())
    assert got == [(1, 0), (2, 2), (3, 4), (4, 5)]


def test_shot_boundaries(spark):
    f = [(1, t, .9) for t in (100, 900, 1000, 1800, 5000, 5100, 5900)] + [(2, 50, .9)]
    got = sorted((r.video_id, r.ts_ms) for r in D.shot_boundaries(spark.createDataFrame(f, "video_id long, ts_ms long, difference double"), ["video_id"], .45, 800, 700.0).collect())
    assert got == [(1, 0), (1, 900), (1, 1800), (1, 5000), (1, 5900), (2, 0)]


def test_reading_order(spark):
    b = [(1, 0, 50.0, 0.0, 10.0), (1, 1, 0.0, 2.0, 12.0), (1, 2, 0.0, 40.0, 50.0), (1, 3, 90.0, 41.0, 51.0)]
    d = spark.createDataFrame(b, "f long, box_id long, left double, top double, bottom double")
    assert [r.box_id for r in D.reading_order(d, ["f"]).orderBy("pos").collect()] == [1, 0, 2, 3]


@pytest.mark.parametrize("seed", range(3))
def test_matching_is_maximum(spark, seed):
    rnd = random.Random(seed)
    edges = sorted({(rnd.randint(1, 6), rnd.randint(0, 4)) for _ in range(10)})
    got = {r.k: r.matched for r in D.max_matching(spark.createDataFrame([(0, *e) for e in edges], "q long, rank long, truth_id long"), ["q"]).collect()}
    for k in (1, 3, 5, 10, 20):
        usable = [e for e in edges if e[0] <= k]
        best = max(n for n in range(len(usable) + 1) for c in itertools.combinations(usable, n) if len({a for a, _ in c}) == n == len({b for _, b in c}))
        assert got[k] == best


def test_groups_of_one_track_are_not_copied_again_and_again(spark, monkeypatch):
    """Many groups: rows are moved a few times at most, and every choice is that of brute force."""
    import numpy as np

    from spanlake.operators import identity as D

    rng = np.random.default_rng(3)
    vectors = np.concatenate([rng.standard_normal((900, 24)), np.repeat(rng.standard_normal((8, 24)), 40, 0) + 0.6 * rng.standard_normal((320, 24))])
    vectors = vectors[rng.permutation(len(vectors))]
    rows = [{"track_idx": i, "embedding": v.tolist(), "quality": (i * 7 % 11) / 10} for i, v in enumerate(vectors)]
    folds = []
    df = spark.createDataFrame([(0, 0, 0, 0.5, [1.0])], "video_id bigint, track_idx bigint, start_ms bigint, quality double, embedding array<double>")
    whole = D.fold_sorted
    monkeypatch.setattr(D, "fold_sorted", lambda *a: folds.append(a[3]) or whole(*a))
    D.cluster_identities(df)
    moved = []
    stack = np.vstack
    monkeypatch.setattr(np, "vstack", lambda parts: moved.append(sum(len(p) for p in parts)) or stack(parts))
    got = [r["group_seq"] for r in folds[0](iter(rows))]
    assert sum(moved) <= 8 * len(rows)

    groups, want = [], []
    for r in rows:
        v = D._unit(r["embedding"])
        score = [min(float(D._unit(s) @ v), max(float(m @ v) for m in ms)) for s, ms in groups]
        best = int(np.argmax(score)) if score and max(score) >= 0.52 else len(groups)
        w = max(r["quality"], 0.1)
        if best == len(groups):
            groups.append((w * v, [v]))
        else:
            groups[best] = (groups[best][0] + w * v, [*groups[best][1], v])
        want.append(best)
    assert got == want and 100 < len(groups) < len(rows) - 100
