"""Evaluation of ranked results against known segments, from results to summary figures."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import KS, ranking_metrics
from ..operators.identity import max_matching
from ..operators.intervals import truth_overlap_join


def evaluate_results(queries: DataFrame, results: DataFrame, truth: DataFrame, traces: DataFrame | None = None, ks=KS, width: float = 60.0) -> DataFrame:
    """One row per query: truth, first_hit (null when none), matched (k -> segments), tool_calls, vlm_calls, wrong_but_stable.

    ``queries``: query_id and anything else, with failed (boolean) where runs can fail; every query gives a row,
    also one without a result or an overlap, for which each k matches 0. ``results``: query_id, video_id, rank,
    start_time, end_time and, where the run says why it ended, stop_reason. ``truth``: query_id, video_id,
    truth_id, t_start, t_end. ``traces``: query_id, tool, one row per call.
    """
    spans = results.select("query_id", "video_id", "rank", F.col("start_time").alias("start"), F.col("end_time").alias("end"))
    pairs = truth_overlap_join(spans, truth, width).select("query_id", "rank", "truth_id")
    first = pairs.groupBy("query_id").agg(F.min("rank").alias("first_hit"))
    matched = max_matching(pairs, ["query_id"], ks).groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("k").cast("int"), "matched")))).alias("matched"))
    segments = truth.groupBy("query_id").agg(F.count("*").alias("truth"))
    d = queries.join(segments, "query_id", "left").join(first, "query_id", "left").join(matched, "query_id", "left")
    none = F.create_map(*[F.lit(x).cast(t) for k in ks for x, t in ((k, "int"), (0, "bigint"))])
    d = d.withColumns({"truth": F.coalesce("truth", F.lit(0)), "matched": F.coalesce("matched", none)})
    if "failed" not in queries.columns:
        d = d.withColumn("failed", F.lit(False))
    if "stop_reason" in results.columns:
        d = d.join(results.groupBy("query_id").agg(F.max("stop_reason").alias("stop_reason")), "query_id", "left")
    else:
        d = d.withColumn("stop_reason", F.lit(None).cast("string"))
    if traces is None:
        return d.withColumns({"tool_calls": F.lit(0).cast("long"), "vlm_calls": F.lit(0).cast("long"), "wrong_but_stable": _stable_miss()})
    calls = traces.groupBy("query_id").agg(F.count("*").alias("tool_calls"), F.count_if(F.col("tool") == "vlm.rerank").alias("vlm_calls"))
    return d.join(calls, "query_id", "left").fillna(0, ["tool_calls", "vlm_calls"]).withColumn("wrong_but_stable", _stable_miss())


def _stable_miss():
    return F.coalesce(F.col("stop_reason") == "ranking_stable", F.lit(False)) & F.col("first_hit").isNull()


def evaluation_summary(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Hit rate and recall at each k (``ranking_metrics``) with counts and rates over the same queries, overall and per ``by``."""
    good = ~F.col("failed")
    aggs = [F.count("*").alias("all_queries"), F.count_if(F.col("failed")).alias("failed_queries"), F.avg(F.when(good, F.col("tool_calls"))).alias("mean_tool_calls"),
            F.avg(F.when(good, (F.col("vlm_calls") > 0).cast("double"))).alias("vlm_call_rate"), F.avg(F.when(good, F.col("wrong_but_stable").cast("double"))).alias("wrong_but_stable_rate")]
    scored = rows.where("truth > 0")
    if by is None:
        one = rows.agg(*aggs).first()
        return ranking_metrics(scored).withColumns({k: F.lit(x) for k, x in one.asDict().items()})
    rates = rows.groupingSets([[F.col(by)], []], F.col(by)).agg(*aggs).withColumnRenamed(by, "__by")
    m = ranking_metrics(scored, by=by)
    return m.join(rates, m[by].eqNullSafe(rates["__by"]), "left").drop("__by")


def stop_reasons(rows: DataFrame) -> DataFrame:
    return rows.where("NOT failed").groupBy("stop_reason").agg(F.count("*").alias("queries"))


def tool_usage(traces: DataFrame) -> DataFrame:
    return traces.groupBy("tool").agg(F.count("*").alias("calls"))
