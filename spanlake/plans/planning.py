"""Plans as tables: every query brings its own steps, and all queries with steps of one shape run in lockstep.

A plan is a set of rows (query_id, plan_id, fusion, result_limit, early_stop, no, step_id, tool, operation, role, weight, top_k,
depends_on, parameters, step_text), as ``evidence.classify_query`` gives them or a user writes them; ``depends_on`` names steps
apart by commas, ``parameters`` is a JSON object. Optional columns: fallback_for, failure_policy, support_bonus_cap, enabled.
What differs from query to query within a shape, the texts of the steps, stays a column. Work on the driver
grows with the number of shapes, which the rules that make plans set, not with the number of queries.
"""
from __future__ import annotations

import json
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import face_confidence
from ..operators.intervals import overlap_best_match
from ..operators.skew import top_k
from ..session import cut_lineage
from . import evidence as E

STEP = ("no", "step_id", "tool", "operation", "role", "weight", "top_k", "depends_on", "parameters")
OPTIONAL = ("fallback_for", "failure_policy", "support_bonus_cap", "enabled")
MOST_STEPS = 6


def plan_shapes(plans: DataFrame) -> DataFrame:
    """(query_id, plan_id, shape, texts): the plan's steps and limits as JSON, and the texts of its steps by step_id."""
    step = F.struct(*[F.col(c) for c in (*STEP, *[c for c in OPTIONAL if c in plans.columns])])
    text = F.when(F.col("step_text").isNotNull(), F.struct("step_id", "step_text")) if "step_text" in plans.columns else F.lit(None).cast("struct<step_id:string,step_text:string>")
    g = plans.groupBy("query_id", "plan_id", "fusion", "result_limit", "early_stop").agg(F.array_sort(F.collect_list(step)).alias("steps"), F.collect_set(text).alias("t"))
    return g.select("query_id", "plan_id", F.to_json(F.struct("fusion", "result_limit", "early_stop", "steps")).alias("shape"), F.map_from_entries("t").alias("texts"))


def read_shape(shape: str) -> E.Plan:
    """The plan of a shape; each step remembers its own id as parameter ``source_id``."""
    raw = json.loads(shape)
    steps = []
    for s in raw["steps"]:
        own = {k: s[k] for k in OPTIONAL if s.get(k) is not None}
        depends = tuple(d.strip() for d in (s.get("depends_on") or "").split(",") if d.strip())
        steps.append(E.Step(s["step_id"], s["tool"], s["operation"], s["role"], depends, s["weight"], s["top_k"],
                            parameters={**json.loads(s.get("parameters") or "{}"), "source_id": s["step_id"]}, **own))
    return E.Plan(tuple(steps), raw["fusion"], raw["result_limit"], raw["early_stop"])


def mended(plan: E.Plan) -> E.Plan:
    """A plan that can be carried out, as near as possible to ``plan``.

    Steps of unknown tools, a second model rerank, and steps that need results before any search are left out; so is what exceeds six
    steps. Filters are constraints and the model rerank is a verifier, whatever role they were given. Ids become s1, s2, ...;
    dependencies on steps that are not there before are dropped. A fallback for something that is not an earlier primary
    search is for the last one before it (parameter ``fallback_retargeted_from``); without one it is primary.
    """
    steps, names, primaries, searched, reranked = [], {}, [], False, False
    for s in plan.steps:
        able = E.TOOLS.get(s.tool)
        operation = s.operation if able and s.operation in able else (able[0] if able else None)
        if operation is None or (s.tool == "vlm.rerank" and reranked) or len(steps) == MOST_STEPS:
            continue
        role = "constraint" if operation == "filter" else "verifier" if s.tool == "vlm.rerank" else "support" if s.role in ("constraint", "verifier") else s.role
        if not searched and (operation != "search" or role in ("support", "constraint", "verifier")):
            continue
        own, parameters, target = f"s{len(steps) + 1}", dict(s.parameters), None
        if role == "fallback":
            target = names.get(s.fallback_for)
            if target not in primaries:
                if primaries:
                    parameters["fallback_retargeted_from"] = target or s.fallback_for
                    target = primaries[-1]
                else:
                    role, target = "primary", None
        depends = tuple(dict.fromkeys(names[d] for d in s.depends_on if d in names))
        steps.append(replace(s, step_id=own, operation=operation, role=role, depends_on=depends, fallback_for=target, parameters=parameters, top_k=min(300, max(1, s.top_k))))
        names.setdefault(s.step_id, own)
        searched, reranked = searched or operation == "search", reranked or s.tool == "vlm.rerank"
        if role == "primary" and operation == "search":
            primaries.append(own)
    fusion = plan.fusion if plan.fusion in ("rrf", "combsum", "combmnz") else "rrf"
    out = replace(plan, steps=tuple(steps), fusion=fusion, result_limit=min(100, max(1, plan.result_limit)), early_stop=min(1.0, max(0.0, plan.early_stop)))
    E.validate_plan(out)
    return out


def _asked(tool: E.Tool) -> E.Tool:
    """The tool with each query's text replaced by its text for the step, if it has one."""
    def run(queries: DataFrame, step: E.Step, moments: DataFrame) -> DataFrame:
        own = F.try_element_at("step_texts", F.lit(step.parameters.get("source_id", step.step_id)))
        q = queries.withColumn("text", F.coalesce(own, F.col("text"))) if "text" in queries.columns else queries.withColumn("text", own)
        return tool(q.drop("step_texts"), step, moments)
    return run


def plan_and_execute(queries: DataFrame, plans: DataFrame, tools: dict[str, E.Tool], max_steps: int | None = None, video_type: str = "bigint") -> tuple[DataFrame, DataFrame]:
    """Carry out every plan: (ranked moments, step trace), both with query_id and plan_id.

    Queries of one shape run together; plans of a query that have the same shape run once. A plan that no step is left of is an error.
    """
    shaped = cut_lineage(plan_shapes(plans))
    wrapped = {name: _asked(tool) for name, tool in tools.items()}
    results, traces = [], []
    for (shape,) in shaped.select("shape").distinct().orderBy("shape").collect():  # as many as the rules make
        mine = shaped.where(F.col("shape") == shape)
        texts = mine.groupBy("query_id").agg(F.min_by("texts", "plan_id").alias("step_texts"))
        moments, trace = E.execute_plan(queries.join(texts, "query_id"), mended(read_shape(shape)), wrapped, max_steps, video_type)
        own = mine.select("query_id", "plan_id")
        results.append(moments.join(own, "query_id"))
        traces.append(trace.join(own, "query_id"))
    if not results:
        raise ValueError("there is no plan")
    both = lambda frames: reduce(lambda a, b: a.unionByName(b), frames)
    return both(results), both(traces)


def face_support(tracks: DataFrame, faces: DataFrame) -> E.Tool:
    """A ``face.support`` tool: looks for each query's face only inside the windows of its best moments.

    ``tracks``: video_id, track_idx, start_ms, end_ms, best_ms, embedding; ``faces``: query_id, vec. Of the tracks that overlap a moment
    (touching does not count, an empty track never does) the one nearest to the face decides: confirmed at a cosine of ``identity_threshold``
    (0.35), ambiguous from ``ambiguous_threshold`` (0.20) on, else rejected. A confirmed moment is a result with the face's confidence; an
    ambiguous one gets its verdict as a row without a score. Windows are widened by ``window_padding_seconds``, 30 at most.
    """
    def run(queries: DataFrame, step: E.Step, moments: DataFrame) -> DataFrame:
        p = step.parameters
        confirmed = min(1.0, max(-1.0, float(p.get("identity_threshold", 0.35))))
        ambiguous = min(confirmed, max(-1.0, float(p.get("ambiguous_threshold", 0.20))))
        pad = round(1000 * min(30.0, max(0.0, float(p.get("window_padding_seconds", 0.0)))))
        best = top_k(moments.join(queries.select("query_id"), "query_id", "left_semi"), ["query_id"], [F.desc("score"), F.asc("pos")], step.top_k)
        ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
        spans = best.select("query_id", "video_id", F.col("pos").alias("moment_id"), F.greatest(F.lit(0), ms("start_time") - pad).alias("start_ms"), (ms("end_time") + pad).alias("end_ms"))
        spans_of = tracks.where("start_ms < end_ms").select("video_id", "track_idx", F.col("start_ms").alias("t_start"), F.col("end_ms").alias("t_end"), "embedding", "best_ms")
        told = overlap_best_match(spans, spans_of, faces, confirmed=confirmed, ambiguous=ambiguous).where("status IN ('confirmed', 'ambiguous')")
        told = told.join(spans_of.select("video_id", "track_idx", "best_ms"), ["video_id", "track_idx"])
        kept = best.select("query_id", F.col("pos").alias("moment_id"), "start_time", "end_time")
        told = told.join(kept, ["query_id", "moment_id"])
        sure = F.col("status") == "confirmed"
        score = F.when(sure, face_confidence(F.col("cosine")))
        detail = F.format_string("[candidate_window] face cosine=%.3f · confidence=%.1f%% · confirmed", F.col("cosine"), face_confidence(F.col("cosine")) * 100)
        note = F.struct(F.lit("face").alias("modality"), detail.alias("detail"), (F.col("best_ms") / 1000).alias("best_time"))
        told = told.select("query_id", "video_id", F.col("moment_id").alias("moment_ref"), "start_time", "end_time", score.alias("score"), F.col("status").alias("face_status"),
                           sure.alias("above_threshold"), F.when(sure, F.array(note)).alias("evidence"))
        return top_k(told, ["query_id"], [F.desc_nulls_last("score"), F.asc("moment_ref")], step.top_k)
    return run
