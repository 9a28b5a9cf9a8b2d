"""Plans as tables, plans made valid, and the face check in candidate windows."""
import pytest
from pyspark.sql import functions as F

from spanlake.plans import evidence as E
from spanlake.plans import planning as P
from test_evidence import tool

HITS = {"visual": [(q, 7, 10 * i, 1 - i / 10) for q in (1, 2, 3) for i in range(1, 6)], "asr": [(q, 7, 10 * i + 1, .5 + i / 20) for q in (1, 2, 3) for i in range(2, 8)]}
PLAN = "query_id long, plan_id string, fusion string, result_limit int, early_stop double, no int, step_id string, tool string, operation string, role string, weight double, top_k int, depends_on string, parameters string, step_text string, fallback_for string"


def tools(spark, seen=None):
    def heard(m):
        run = tool(spark, HITS[m])

        def wrapper(queries, step, nodes):
            if seen is not None:
                seen.extend((r.query_id, m, r.text) for r in queries.select("query_id", "text").collect())
            return run(queries, step, nodes)
        return wrapper
    return {f"{m}.search": heard(m) for m in HITS}


def test_every_query_gets_its_own_plan(spark):
    rows = [(1, "a", "combsum", 3, 1.0, 1, "one", "visual.search", "search", "primary", 1.0, 50, "", "{}", "first words", None),
            (1, "a", "combsum", 3, 1.0, 2, "two", "asr.search", "search", "support", 0.5, 50, "one", "{}", None, None),
            (2, "a", "combsum", 3, 1.0, 1, "one", "visual.search", "search", "primary", 1.0, 50, "", "{}", "other words", None),
            (2, "a", "combsum", 3, 1.0, 2, "two", "asr.search", "search", "support", 0.5, 50, "one", "{}", None, None),
            (2, "b", "rrf", 2, 1.0, 1, "x", "asr.search", "search", "primary", 1.0, 4, "", "{}", None, None),
            (3, "b", "combsum", 9, 1.0, 1, "x", "visual.search", "search", "primary", 1.0, 50, "", "{}", None, None),
            (3, "b", "combsum", 9, 1.0, 2, "y", "confidence.filter", "filter", "constraint", 1.0, 50, "x", '{"min_score": 0.5}', None, None)]
    queries = spark.createDataFrame([(i, f"text {i}") for i in (1, 2, 3)], "query_id long, text string")
    seen = []
    results, trace = P.plan_and_execute(queries, spark.createDataFrame(rows, PLAN), tools(spark, seen))
    key = lambda r: (r.query_id, r["rank"], r.start_time, round(r.final_score, 6), r.source_count)
    got = {}
    for r in results.collect():
        got.setdefault((r.query_id, r.plan_id), []).append(key(r))
    assert set(got) == {(1, "a"), (2, "a"), (2, "b"), (3, "b")}
    pair = E.Plan((E.Step("s1", "visual.search"), E.Step("s2", "asr.search", role="support", depends_on=("s1",), weight=0.5)), "combsum", 3, 1.0)
    alone = {(1, "a"): pair, (2, "a"): pair, (2, "b"): E.Plan((E.Step("s1", "asr.search", top_k=4),), "rrf", 2, 1.0),
             (3, "b"): E.Plan((E.Step("s1", "visual.search"), E.Step("s2", "confidence.filter", "filter", "constraint", ("s1",), parameters={"min_score": 0.5})), "combsum", 9, 1.0)}
    for (q, plan_id), plan in alone.items():
        want, _ = E.execute_plan(queries.where(F.col("query_id") == q), plan, tools(spark))
        assert sorted(got[q, plan_id]) == sorted(map(key, want.collect()))
    assert set(seen) >= {(1, "visual", "first words"), (2, "visual", "other words"), (1, "asr", "text 1"), (3, "visual", "text 3")}
    assert {(r.query_id, r.plan_id, r.step_id) for r in trace.collect()} >= {(1, "a", "s2"), (3, "b", "s2"), (2, "b", "s1")}


def test_classified_plans_are_ready_to_run(spark):
    q = spark.createDataFrame([(1, "before the goal", False, ["asr", "visual"]), (2, "find Anna on stage", False, ["asr", "face", "visual"])], "query_id long, text string, has_image boolean, available array<string>")
    plans = E.classify_query(q, spark.createDataFrame([(5, "Anna")], "entity_id long, name string"))
    shapes = {(r.query_id, r.plan_id): (P.mended(P.read_shape(r["shape"])), r.texts) for r in P.plan_shapes(plans).collect()}
    deep = shapes[1, "deep"][0]
    assert (deep.fusion, deep.result_limit, deep.early_stop) == ("combmnz", 30, 0.94) and deep.steps[-1].operation == "rerank" and deep.steps[-1].parameters["restrict_to_current"] is True
    named, texts = shapes[2, "balanced"]
    assert [s.tool for s in named.steps] == ["visual.search", "face.search", "vlm.rerank"] and named.early_stop == 1.0
    assert named.steps[2].parameters["candidate_pool"] == "face_evidence" and texts == {"identity-primary": "find on stage", "identity-face": "Anna"}


def test_plans_are_mended():
    s = E.Step
    plan = P.mended(E.Plan((s("p", "visual.search", top_k=900), s("v", "vlm.rerank", "rerank", "support"), s("f", "ocr.search", role="fallback", fallback_for="v"), s("w", "vlm.rerank", "rerank", "verifier"),
                            s("n", "nope.search"), s("c", "confidence.filter", "filter", "primary", ("p", "gone"))), "sum", 500, 3.0))
    assert [(x.step_id, x.tool, x.role) for x in plan.steps] == [("s1", "visual.search", "primary"), ("s2", "vlm.rerank", "verifier"), ("s3", "ocr.search", "fallback"), ("s4", "confidence.filter", "constraint")]
    assert plan.steps[2].fallback_for == "s1" and plan.steps[2].parameters["fallback_retargeted_from"] == "s2" and plan.steps[3].depends_on == ("s1",)
    assert (plan.fusion, plan.result_limit, plan.early_stop, plan.steps[0].top_k) == ("rrf", 100, 1.0, 300)
    early = P.mended(E.Plan((s("f", "confidence.filter", "filter", "constraint"), s("b", "asr.search", role="fallback", fallback_for="x"), s("c", "ocr.search", role="support", depends_on=("b",)))))
    assert [(x.step_id, x.role, x.depends_on) for x in early.steps] == [("s1", "primary", ()), ("s2", "support", ("s1",))]
    with pytest.raises(ValueError):
        P.mended(E.Plan((s("v", "vlm.rerank", "rerank", "verifier"),)))


def test_face_check_inside_candidate_windows(spark):
    visual = [(1, 7, 10, .9), (1, 7, 30, .6), (1, 7, 50, .5), (1, 7, 70, .4), (1, 8, 10, .2), (2, 7, 90, .9)]
    tracks = spark.createDataFrame([(7, 0, 10_500, 11_000, 10_700, [.8, .6]), (7, 1, 8_000, 10_000, 9_000, [1.0, 0.0]), (7, 2, 30_000, 31_000, 30_500, [.25, .968]), (7, 3, 51_000, 51_500, 51_200, [0.0, 1.0]),
                                    (7, 4, 71_000, 71_000, 71_000, [1.0, 0.0]), (8, 5, 30_000, 31_000, 30_500, [1.0, 0.0])], "video_id long, track_idx long, start_ms long, end_ms long, best_ms long, embedding array<double>")
    faces = spark.createDataFrame([(1, [2.0, 0.0])], "query_id long, vec array<double>")

    calls = {"visual.search": tool(spark, visual), "face.search": lambda q, s, n: tool(spark, [])(q, s, n), "face.support": P.face_support(tracks, faces)}
    plan = E.Plan((E.Step("s1", "visual.search"), E.Step("s2", "face.search", role="support", depends_on=("s1",))), "combsum", early_stop=1.0)
    results, trace = E.execute_plan(spark.createDataFrame([(1,), (2,)], "query_id long"), plan, calls)
    got = {(r.query_id, r.video_id, r.start_time): r for r in results.collect()}
    assert {k: (r.face_status, r.source_count) for k, r in got.items() if k[0] == 1} == {
        (1, 7, 10.0): ("confirmed", 2), (1, 7, 30.0): ("ambiguous", 1), (1, 7, 50.0): (None, 1), (1, 7, 70.0): (None, 1), (1, 8, 10.0): (None, 1)}
    assert "face cosine=0.800" in got[1, 7, 10.0].evidence[0].detail and got[1, 7, 10.0].evidence[0].best_time == 10.7
    t = {(r.query_id, r.step_id): r for r in trace.collect()}
    assert t[1, "s2"].raw_count == 1 and t[1, "s2"].decision == "accepted" and t[2, "s2"].reason == "insufficient_results"
    pool = E.select_rerank_pool(results.where("query_id = 1"), 10, ("confirmed", "ambiguous")).collect()
    assert sorted(r.start_time for r in pool) == [10, 30]
