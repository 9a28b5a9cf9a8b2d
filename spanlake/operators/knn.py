"""Exact k-nearest-neighbour join of a query table against unit tables.

Two physical forms give the same rows:

* few queries (the usual case): the query matrix, whose row count is checked
  first, travels with the tasks; unit batches are scored by one matrix product
  where they lie, and only the best ``k`` per (query, group) leave a batch;
* many queries: both sides are cut into blocks, every unit block meets every
  query block in a cogrouped task of bounded size, and the same partial top-k
  leaves each task. Nothing passes through the driver.

What a task has seen raises the bar for what it still reads: the k-th score of a
group's earlier batches is a lower bound of its k-th score, so nothing below it
leaves the task. A caller that knows a bound for each query hands it in (``floor``),
one that knows which groups a query wants hands in the pairs (``within``).
"""
from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from .skew import top_k

MAX_TASK_QUERIES = 4096      # query rows that may travel with a task
MAX_TASK_BYTES = 64 << 20    # and their size
MAX_CELLS = 4_000_000        # scores held at once: queries x units of one tile (32 MB a copy)
UNIT_BLOCK_ROWS = 50_000     # unit rows per cogrouped block
MAX_PAIRS = 500_000          # wanted (query, group) pairs that may travel with a task (a few tens of MB)


def _matrix(column: pa.ChunkedArray | pa.Array, names=lambda i: f"row {i}", width: int | None = None) -> np.ndarray:
    """Vectors as rows; one of another width than ``width`` (the first one's) is an error that names its row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not n:
        return flat.reshape(0, 0)
    widths = column.value_lengths().to_numpy(zero_copy_only=False)
    width = int(widths[0]) if width is None else width
    odd = np.flatnonzero(widths != width)
    if len(odd):
        raise ValueError(f"{names(int(odd[0]))}: a vector of {int(widths[odd[0]])} values among vectors of {width}")
    return flat.reshape(n, width)


def _unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _group_ids(columns: list[pa.Array], n: int) -> np.ndarray:
    ids = np.zeros(n, dtype=np.int64)
    for col in columns:
        col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        codes = col.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, ids = np.unique(ids * (codes.max() + 1) + codes, return_inverse=True)
    return ids


def partial_top_k(scores: np.ndarray, groups: np.ndarray, k: int, floor: np.ndarray | None = None, edges: dict | None = None,
                  name=int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, unit row) of every score that can still be in its group's top k; ties at the edge stay.

    ``floor``: a bar for each query row. ``edges``: the best k scores that earlier calls saw, by ``name`` of a group's
    first row; kept up in place, for as many groups as MAX_CELLS scores allow. Groups of ``k`` rows and fewer gather theirs
    call by call where a call has few groups. A score that is not a number passes every bar.
    """
    order = np.argsort(groups, kind="stable")
    bounds = np.flatnonzero(np.diff(groups[order])) + 1
    room = MAX_CELLS // max(1, scores.shape[0] * k) if edges is not None else 0
    gather = len(bounds) < room // 4
    q_out, u_out = [], []
    for members in np.split(order, bounds):
        if len(members) == 0:
            continue
        part, edge = scores[:, members], floor
        key = name(members[0]) if room and (gather or edges or len(members) > k) else None
        seen = edges.get(key) if room else None
        if len(members) > k or seen is not None or gather:
            best = np.where(np.isnan(part), -np.inf, part)
            best = best if seen is None else np.concatenate([seen, best], axis=1)
            if best.shape[1] > k:
                best = np.partition(best, best.shape[1] - k, axis=1)[:, -k:]
            if room:
                if len(edges) >= room and seen is None:
                    edges.clear()
                edges[key] = best
            if best.shape[1] == k:
                own = best.min(axis=1)
                edge = own if edge is None else np.maximum(edge, own)
        if edge is None:
            q_out.append(np.repeat(np.arange(scores.shape[0]), len(members)))
            u_out.append(np.tile(members, scores.shape[0]))
            continue
        q, u = np.nonzero(~(part < edge[:, None]))
        q_out.append(q)
        u_out.append(members[u])
    if not q_out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(q_out), np.concatenate(u_out)


def _tiles(q_table: pa.Table, units):
    """Unit rows in tiles of at most MAX_CELLS scores."""
    rows = max(1, MAX_CELLS // max(1, q_table.num_rows))
    return [units.slice(a, rows) for a in range(0, units.num_rows, rows)] if q_table.num_rows else []


def _scores(q_table: pa.Table, units, emb, metric, q_names, u_names) -> np.ndarray:
    qm = _matrix(q_table.column("__qv"), lambda i: "query " + str([q_table.column(c)[i].as_py() for c in q_names]))
    um = _matrix(units.column(emb), lambda i: "unit " + str({c: units.column(c)[i].as_py() for c in u_names}), qm.shape[1])
    if metric == "cosine":
        qm, um = _unit_rows(qm), _unit_rows(um)
    # equal vectors must tie wherever they lie, so the last bits of the product are dropped
    return np.round(qm @ um.T, 12)


def _floor(q_table: pa.Table) -> np.ndarray | None:
    if "__floor" not in q_table.column_names:
        return None
    return pc.fill_null(q_table.column("__floor"), -math.inf).to_numpy()


def _wanted(query_ids: pa.ChunkedArray, lists, groups: np.ndarray) -> np.ndarray:
    """For each query row and group: does the list that the group's rows carry name the query?"""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    names = pc.unique(query_ids)
    codes, first = np.unique(groups, return_index=True)
    lists = lists.take(pa.array(first))
    where = np.repeat(codes, lists.value_lengths().to_numpy(zero_copy_only=False))
    which = pc.fill_null(pc.index_in(lists.flatten(), names), -1).to_numpy(zero_copy_only=False)
    mask = np.zeros((len(names) + 1, codes.max() + 1), dtype=bool)  # the last row takes ids of other query blocks
    mask[which, where] = True
    return mask[pc.index_in(query_ids, names).to_numpy()]


def _tile(q_table: pa.Table, units, by, keep, emb, metric, k, schema, edges) -> pa.Table:
    q_names = [f.name for f in schema if f.name in q_table.column_names]
    scores = _scores(q_table, units, emb, metric, q_names, (*by, *keep))
    groups = _group_ids([units.column(c) for c in by], units.num_rows)
    qi, ui = partial_top_k(scores, groups, k, _floor(q_table), edges, lambda i: tuple(units.column(c)[int(i)].as_py() for c in by))
    if "__for" in units.schema.names and len(qi):
        own = _wanted(q_table.column(q_names[0]), units.column("__for"), groups)[qi, groups[ui]]
        qi, ui = qi[own], ui[own]
    arrays = []
    for f in schema:
        if f.name == "score":
            arrays.append(pa.array(scores[qi, ui]))
        elif f.name in by or f.name in keep:
            arrays.append(units.column(f.name).take(pa.array(ui)))
        else:
            arrays.append(q_table.column(f.name).take(pa.array(qi)))
    arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays]
    return pa.table([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)


def _each_tile(q: DataFrame, u: DataFrame, query_keys, out_type: StructType, work, max_task_queries: int, unit_block_rows: int) -> DataFrame:
    """``work(queries, units, state)`` over tiles in which every unit meets every query; ``state`` is a task's own dict."""
    schema = to_arrow_schema(out_type)
    head = q.limit(max_task_queries + 1).toArrow()
    if head.num_rows <= max_task_queries and head.nbytes <= MAX_TASK_BYTES:
        table = head.combine_chunks()

        def run(batches):
            state: dict = {}
            for batch in batches:
                for tile in _tiles(table, batch):
                    yield from work(table, tile, state).to_batches()

        return u.mapInArrow(run, out_type)
    n_shards = max(1, math.ceil(u.count() / unit_block_rows))
    n_blocks = math.ceil(q.count() / max_task_queries)
    ub = u.withColumn("__shard", F.pmod(F.xxhash64(*[c for c in u.columns if c != "__for"]), F.lit(n_shards))).withColumn(
        "__block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    qb = q.withColumn("__block", F.pmod(F.xxhash64(*query_keys), F.lit(n_blocks))).withColumn(
        "__shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))))

    def run_pair(left: pa.Table, right: pa.Table) -> pa.Table:
        state: dict = {}
        return pa.concat_tables([schema.empty_table(), *[work(left, tile, state) for tile in _tiles(left, right)]])

    return qb.groupBy("__block", "__shard").cogroup(ub.groupBy("__block", "__shard")).applyInArrow(run_pair, out_type)


def _query_side(queries: DataFrame, query_keys, vec: str, floor: str | None) -> DataFrame:
    bar = [] if floor is None else [F.col(floor).cast("double").alias("__floor")]
    return queries.where(F.col(vec).isNotNull()).select(*query_keys, F.col(vec).cast("array<double>").alias("__qv"), *bar)


def best_groups(
    queries: DataFrame,
    units: DataFrame,
    n: int | None = None,
    *,
    by: tuple[str, ...] = ("video_id",),
    query_key: str = "query_id",
    vec: str = "vec",
    emb: str = "embedding",
    metric: str = "cosine",
    floor: str | None = None,
    combine: Callable[[np.ndarray], np.ndarray] = np.fmax.reduce,
    max_task_queries: int = MAX_TASK_QUERIES,
    unit_block_rows: int = UNIT_BLOCK_ROWS,
) -> DataFrame:
    """(query, ``by``, best): the highest score of any unit of the group, where a unit's score for a query of several
    vectors is what ``combine`` makes of theirs (an array of vectors x units; without it their highest).

    Only groups whose best reaches the query's ``floor`` (null: all), and with ``n`` only the ``n`` best of each query,
    ties by ``by``. A group among the n best is so in the task that holds its best unit, therefore a task sends at most
    n rows for each query and batch, and of later batches only what beats the n-th best it has seen.
    """
    by = tuple(by)
    q = _query_side(queries, (query_key,), vec, floor)
    u = units.where(F.col(emb).isNotNull()).select(*by, F.col(emb).cast("array<float>").alias(emb))
    out_type = StructType([q.schema[query_key], *[u.schema[c] for c in by], StructField("best", DoubleType())])
    schema = to_arrow_schema(out_type)

    def work(table, tile, state):
        scores = _scores(table, tile, emb, metric, (query_key,), by)
        groups = _group_ids([tile.column(c) for c in by], tile.num_rows)
        order = np.argsort(groups, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(groups[order]) > 0])
        ids = _group_ids([table.column(query_key)], table.num_rows)
        first_q = np.unique(ids, return_index=True)[1]
        # one row of scores for each query
        per_query = scores[first_q] if len(first_q) == len(ids) and combine is np.fmax.reduce else np.stack([combine(scores[ids == i]) for i in range(len(first_q))])
        best = np.fmax.reduceat(per_query[:, order], starts, axis=1)
        bar = _floor(table)
        edge = np.full(len(first_q), -np.inf) if bar is None else bar[first_q]
        if n is not None:
            edge = np.maximum(edge, state.get("edge", edge))
            if best.shape[1] >= n:
                edge = np.fmax(edge, np.partition(np.where(np.isnan(best), -np.inf, best), best.shape[1] - n, axis=1)[:, best.shape[1] - n])
            state["edge"] = edge
        qi, gi = np.nonzero(best >= edge[:, None])
        ui = pa.array(order[starts][gi])
        arrays = [table.column(query_key).take(pa.array(first_q[qi])), *[tile.column(c).take(ui) for c in by], pa.array(best[qi, gi])]
        arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays]
        return pa.table([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)

    found = _each_tile(q, u, (query_key,), out_type, work, max_task_queries, unit_block_rows)
    found = found.groupBy(query_key, *by).agg(F.max("best").alias("best"))
    return found if n is None else top_k(found, [query_key], [F.desc("best"), *[F.asc(c) for c in by]], n).drop("rank")


def knn_join(
    queries: DataFrame,
    units: DataFrame,
    k: int,
    *,
    by: tuple[str, ...] = ("video_id",),
    query_keys: tuple[str, ...] = ("query_id", "query_idx"),
    keep: tuple[str, ...] = (),
    tie: tuple[str, ...] = (),
    vec: str = "vec",
    emb: str = "embedding",
    metric: str = "cosine",
    floor: str | None = None,
    within: DataFrame | None = None,
    max_task_queries: int = MAX_TASK_QUERIES,
    unit_block_rows: int = UNIT_BLOCK_ROWS,
) -> DataFrame:
    """Per (query, ``by``) the ``k`` units of highest score, ties by ``tie``.

    ``floor``: a query column; lower scores are left out (null: none). ``within``: pairs of the first query key and
    ``by``; other groups of a query are left out, units of groups that no query wants are not scored.
    """
    by, keep, query_keys = tuple(by), tuple(keep), tuple(query_keys)
    q = _query_side(queries, query_keys, vec, floor)
    u = units.where(F.col(emb).isNotNull()).select(*by, *keep, F.col(emb).cast("array<float>").alias(emb))
    if within is not None:
        small = within.limit(MAX_PAIRS + 1).count() <= MAX_PAIRS
        w = within.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.collect_set(query_keys[0]).alias("__for"))
        on = [u[c].eqNullSafe(w[f"__{c}"]) for c in by]
        u = u.join(F.broadcast(w) if small else w, on).drop(*[f"__{c}" for c in by])
    fields = [q.schema[c] for c in query_keys] + [u.schema[c] for c in by + keep]
    out_type = StructType([*fields, StructField("score", DoubleType())])
    schema = to_arrow_schema(out_type)

    def work(table, tile, state):
        return _tile(table, tile, by, keep, emb, metric, k, schema, state)

    scored = _each_tile(q, u, query_keys, out_type, work, max_task_queries, unit_block_rows)
    order = [F.desc("score"), *[F.col(c) for c in (tie or keep)]]
    return top_k(scored, [*query_keys, *by], order, k)
