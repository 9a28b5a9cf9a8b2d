"""Plan execution in lockstep."""
import pytest
from pyspark.sql import functions as F

from spanlake.plans import evidence as E

RESULT = "query_id long, video_id long, rank long, start_time double, end_time double, score double, above_threshold boolean"


def tool(spark, rows, extra=None):
    """A search tool returning fixed (query, video, start, score) hits, best first."""
    def run(queries, step, nodes):
        ranked = {}
        full = []
        for q, v, s, sc in sorted(rows, key=lambda r: (r[0], -r[3])):
            ranked[q] = ranked.get(q, 0) + 1
            full.append((q, v, ranked[q], float(s), float(s) + 2, float(sc), True))
        return spark.createDataFrame(full, RESULT).join(queries.select("query_id"), "query_id", "left_semi")
    return run


def run(spark, plan, tools, queries=(1,), **kw):
    q = spark.createDataFrame([(i,) for i in queries], "query_id long")
    r, t = E.execute_plan(q, plan, tools, **kw)
    return r.orderBy("query_id", "rank").collect(), {(x.query_id, x.step_id): x for x in t.collect()}


VISUAL = [(1, 7, 10, .9), (1, 7, 30, .2)]
ASR = [(1, 7, 11, .8), (1, 7, 50, .1)]


def test_support_enriches_but_never_creates(spark):
    plan = E.Plan((E.Step("s1", "visual.search"), E.Step("s2", "asr.search", role="support", depends_on=("s1",))), fusion="combsum")
    r, t = run(spark, plan, {"visual.search": tool(spark, VISUAL), "asr.search": tool(spark, ASR)})
    assert [(x.start_time, x.source_count) for x in r] == [(10, 2), (30, 1)]
    assert r[0].final_score == 1.0 and r[0].score == pytest.approx(1.4)   # bonus capped at 0.4 of the primary score
    assert t[1, "s2"].matched == 1 and t[1, "s2"].unmatched == 1


def test_empty_primary_promotes_support_and_runs_fallback(spark):
    plan = E.Plan((E.Step("s1", "visual.search"), E.Step("s2", "ocr.search", role="fallback", fallback_for="s1"), E.Step("s3", "face.search", role="fallback", fallback_for="s1")))
    r, t = run(spark, plan, {"visual.search": tool(spark, VISUAL), "ocr.search": tool(spark, ASR), "face.search": tool(spark, ASR)}, queries=(1, 2))
    assert t[2, "s1"].reason == "insufficient_results" and t[1, "s2"].reason == "fallback_not_needed"
    assert {x.query_id for x in r} == {1}
    plan = E.Plan((E.Step("s1", "visual.search"), E.Step("s2", "asr.search", role="support", depends_on=("s1",))))
    r, t = run(spark, plan, {"visual.search": tool(spark, [(9, 1, 1, .5)]), "asr.search": tool(spark, ASR)})
    assert t[1, "s2"].effective_role == "fallback" and t[1, "s2"].reason == "support_promoted_for_empty_primary_pool" and len(r) == 2


def test_flat_scores_roll_back_for_that_query_only(spark):
    flat = [(1, 7, 10, .5), (1, 7, 20, .5), (2, 7, 10, .9), (2, 7, 40, .1)]
    plan = E.Plan((E.Step("s1", "visual.search"), E.Step("s2", "ocr.search")))
    r, t = run(spark, plan, {"visual.search": tool(spark, [(1, 7, 100, .9), (1, 7, 130, .1), (2, 7, 100, .9), (2, 7, 130, .1)]), "ocr.search": tool(spark, flat)}, queries=(1, 2))
    assert (t[1, "s2"].decision, t[1, "s2"].reason) == ("rolled_back", "flat_score_distribution") and t[2, "s2"].decision == "accepted"
    assert sorted(x.start_time for x in r if x.query_id == 1) == [100, 130] and len([x for x in r if x.query_id == 2]) == 4


def test_filter_rolls_back_when_nothing_survives(spark):
    def plan(low):
        return E.Plan((E.Step("s1", "visual.search"), E.Step("s2", "confidence.filter", operation="filter", role="constraint", depends_on=("s1",), parameters={"min_score": low})), fusion="combsum")
    r, t = run(spark, plan(5.0), {"visual.search": tool(spark, VISUAL)})
    assert t[1, "s2"].reason == "constraint_too_restrictive" and len(r) == 2
    r, t = run(spark, plan(.5), {"visual.search": tool(spark, VISUAL)})
    assert t[1, "s2"].decision == "accepted" and [x.start_time for x in r] == [10]


def test_verifier_can_rescue_the_weakest(spark):
    def judge(queries, step, nodes):
        return nodes.select("query_id", "video_id", F.col("pos").alias("rank"), "start_time", "end_time", F.col("rep_score").alias("score"),
                            F.when(F.col("start_time") == 30, 1.0).otherwise(0.0).alias("rerank_score"), F.col("pos").alias("moment_ref"))
    plan = E.Plan((E.Step("s1", "visual.search"), E.Step("s2", "vlm.rerank", operation="rerank", role="verifier", depends_on=("s1",))), fusion="combsum")
    r, t = run(spark, plan, {"visual.search": tool(spark, VISUAL), "vlm.rerank": judge})
    assert [(x.start_time, round(x.score, 3)) for x in r] == [(30, .8), (10, .2)]


def test_repeated_tool_counts_once(spark):
    plan = E.Plan((E.Step("s1", "visual.search"), E.Step("s2", "visual.search")), fusion="combmnz")
    r, _ = run(spark, plan, {"visual.search": tool(spark, VISUAL)})
    assert r[0].source_count == 1 and r[0].score == pytest.approx(1.0)


def test_early_stop_and_tool_errors(spark):
    def broken(queries, step, nodes):
        raise RuntimeError("down")
    plan = E.Plan((E.Step("s1", "visual.search"), E.Step("s2", "asr.search", role="support", depends_on=("s1",)), E.Step("s3", "ocr.search", role="support", depends_on=("s1",))), fusion="combsum")
    r, t = run(spark, plan, {"visual.search": tool(spark, VISUAL), "asr.search": tool(spark, [(1, 7, 10, .8), (1, 7, 30, .1)]), "ocr.search": tool(spark, ASR)})
    assert t[1, "s2"].stop and (1, "s3") not in t and r[0].stop_reason == "ranking_stable"
    r, t = run(spark, plan, {"visual.search": tool(spark, VISUAL), "asr.search": broken, "ocr.search": broken})
    assert t[1, "s2"].reason == "tool_error:RuntimeError" and len(r) == 2
    with pytest.raises(RuntimeError):
        run(spark, E.Plan((E.Step("s1", "asr.search", failure_policy="abort"),)), {"asr.search": broken})


@pytest.mark.parametrize("steps", [
    (E.Step("a", "nope.search"),), (E.Step("a", "confidence.filter", operation="filter", role="constraint"),), (E.Step("a", "visual.search", role="support"),),
    (E.Step("a", "visual.search"), E.Step("a", "asr.search")), (E.Step("a", "visual.search"), E.Step("b", "vlm.rerank", operation="rerank", role="support")),
    (E.Step("a", "visual.search"), E.Step("b", "ocr.search", role="fallback", fallback_for="b")),
])
def test_bad_plans_are_rejected(steps):
    with pytest.raises(ValueError):
        E.validate_plan(E.Plan(steps))


def test_minmax_rule(spark):
    from spanlake.operators.windows import minmax_per_step
    d = spark.createDataFrame([(1, .5), (2, .3), (2, .3), (3, 1.0), (3, 3.0)], "q long, score double")
    assert sorted((r.q, r.norm) for r in minmax_per_step(d, ["q"]).collect()) == [(1, 1.0), (2, 0.0), (2, 0.0), (3, 0.0), (3, 1.0)]
