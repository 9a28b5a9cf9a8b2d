"""Registered queries against their SQL twins on the smallest tables. SPANLAKE_ALL=1 runs every one."""
import os

import duckdb
import pytest

from spanlake.catalogue import all_queries, all_sql

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = """resolve_scope requested_channels require_time_window consistent_segments global_dynamic_threshold utterance_visible ocr_item_quality
 join_published entity_mention join_overlays max_overlap_join sum_overlap_assign interval_intersect asof_segment coalesce_windows nearest_moment_join
 overlap_best_match knn_join hybrid_join pointer_reconcile staging_target_diff frame_multiquery_agg segment_topn_mean group_rollup weighted_vector_mean
 representative visual_health version_select bm25_stats ranking_metrics by_category_rollup fill_gaps split_long longest_unpunctuated_span stratified_sample
 read_transcript_sidecar write_visual_units upsert_latest membership_update_replace overlay_upsert dense_search bm25_search hybrid_search face_search
 moment_search rerank_blend voice_search fuse_combmnz step_quality_gate classify_query unregistered_mentions publish import_publications
 repair_time_bounds promote_staging stream_gap_sessions stream_upsert semantic_arrays""".split()
NAMES = sorted(all_sql()) if os.environ.get("SPANLAKE_ALL") else CORE


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DIR):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def text(v):
    return "~" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, duck, name):
    got = sorted(tuple(map(text, r)) for r in all_queries()[name](spark, DIR).collect())
    want = sorted(tuple(map(text, r)) for r in duck.execute(all_sql()[name]).fetchall())
    assert got == want


def test_every_sql_has_a_query():
    assert set(all_sql()) <= set(all_queries())
