"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "moment_search", "dense_search", "knn_join", "write_postings", "bm25_search", "hybrid_search", "face_search", "voice_search", "overlap_join", "max_overlap_join", "asof_segment",
    "coalesce_windows", "nearest_moment_join", "group_moments", "fuse_results", "fuse_rrf", "build_chunks", "fill_gaps", "track_detections", "identity_groups",
    "table_fingerprint", "bm25_stats", "text_profile", "pointer_reconcile", "ranking_metrics", "upsert_latest", "entity_mention",
)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    from spanlake.session import build_session
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    from spanlake.catalogue import all_queries
    queries, times = all_queries(), {}
    for name in os.environ.get("BENCH_ONLY", ",".join(HEADLINE)).split(","):
        seconds = []
        for _ in range(1 + runs):  # the first run warms up
            t0 = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(seconds[1:]), 3)
    print(json.dumps({"metric": "headline queries, sum of warm medians", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


main()
