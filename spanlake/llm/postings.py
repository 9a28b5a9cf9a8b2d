"""Approximate nearest neighbours by inner product over balanced posting lists.

Inner products become distances in one more dimension: a vector x gets the coordinate sqrt(M^2 - |x|^2), M the greatest norm, and a
query is scaled to length M. Centroids come from a bounded sample, split again and again into parts of equal
weight (hierarchical balanced clustering), so dense regions get many lists. They stay in memory as a graph: each
centroid knows its nearest ones, and a search spreads along the edges while centroids lie within a ratio of the nearest.

* A vector goes to its nearest list and, near a boundary, to the others within SPREAD of that distance, unless a list
  that it already has is nearer to the other's centroid than the vector is.
* A query reads all lists within a ratio of its nearest centroid's distance. The ratio is measured: for a
  bounded sample of queries the exact neighbours are found in one pass, and the ratio is the one that reaches SHARE of them.

Equal vectors are one vector with its smallest ids, as many as a result can show. Lists are packed into groups of about
GROUP_ROWS vectors, longer lists cut into several groups; a group meets the queries that read one of its lists, these in parts
of about GROUP_QUERIES.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C
from .negatives import deal, matrix

NEAREST = 20
#: Vectors of a list on average, most lists (their centroids are in memory), vectors and bytes of the sample they are fitted on.
LIST_ROWS, LISTS, SAMPLE, SAMPLE_BYTES = 256, 16_384, 32_768, 64 << 20
#: Vectors near a boundary: largest ratio of distances, most lists of one vector.
SPREAD, COPIES = 1.02, 8
#: Queries that the ratio is measured on (expected number), and the share of their neighbours that the lists within it hold.
PROBES, SHARE = 256, 0.97
#: Neighbours of a centroid in the graph, and where a search begins.
DEGREE, ENTRIES = 32, 16
GROUP_ROWS, GROUP_QUERIES = 16_384, 2_048
#: Distances held at once by a search, and centroids expanded in a step.
CELLS, EXPAND = 1_000_000, 20_000
SEED = 7
#: Scores this near (relative to the greatest) are compared by exact sums.
SLACK = 1e-12


# --- centroids -------------------------------------------------------------

def balanced_centroids(points: np.ndarray, lists: int, rounds: int = 6) -> np.ndarray:
    """Centroids of ``lists`` parts of like size, neighbours near each other in the order.

    A part is split by a few rounds of k-means into at most 16; each gets lists by its size, so that crowded parts are split on.
    """
    random = np.random.default_rng(SEED)

    def split(x: np.ndarray, k: int):
        if k <= 1 or len(x) <= 1:
            return [x.mean(axis=0)]
        b = min(16, k, len(x))
        c = x[random.choice(len(x), b, replace=False)]
        for _ in range(rounds):
            d = (c * c).sum(axis=1) - 2 * x @ c.T
            at = d.argmin(axis=1)
            n = np.bincount(at, minlength=b)
            sums = np.zeros((b, x.shape[1]))
            np.add.at(sums, at, x)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        n = np.bincount(at, minlength=b)
        full = np.flatnonzero(n)
        if len(full) == 1:  # equal points
            return [x.mean(axis=0)]
        share = np.maximum(1, np.floor(k * n[full] / len(x)).astype(int))
        while share.sum() < k:
            share[np.argmax(n[full] / share)] += 1
        order = np.argsort(c[full] @ (c[full[-1]] - c[full[0]]))
        return [p for o in order for p in split(x[at == full[o]], int(share[o]))]

    return np.array(split(points, lists))


class Graph:
    """Centroids, each linked with its nearest ones and with the next in order, so that all are connected."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE):
        self.c, n = centroids, len(centroids)
        self.square = (centroids * centroids).sum(axis=1)
        near, rows = min(degree, n - 1), max(1, CELLS // n)
        links = [np.zeros((n, 0), np.int64)]
        if near > 0:
            links = [np.concatenate([np.argpartition(self._squares(centroids[a:a + rows], a), near, axis=1)[:, :near] for a in range(0, n, rows)])]
        chain = np.arange(n)
        self.links = np.concatenate([*links, ((chain + 1) % n)[:, None], ((chain - 1) % n)[:, None]], axis=1).astype(np.int32)
        self.entries = np.unique(np.linspace(0, n - 1, min(ENTRIES, n)).astype(int))

    def _squares(self, x: np.ndarray, own: int) -> np.ndarray:
        d = self.square - 2 * x @ self.c.T
        d[np.arange(len(x)), own + np.arange(len(x))] = np.inf
        return d

    def within(self, x: np.ndarray, ratio: float, ease: float = 0.0, beam: int = 8):
        """For each batch of rows: (first row, distances to all centroids that were met, inf elsewhere, nearest distance).

        A distance is the root of the squared distance and ``ease``. The search expands every met centroid within ``ratio`` of
        the nearest, and the ``beam`` nearest ones.
        """
        n = len(self.c)
        rows = max(1, CELLS // n)
        for a in range(0, len(x), rows):
            part = x[a:a + rows]
            m, own = len(part), (part * part).sum(axis=1) + ease
            dist, done = np.full((m, n), np.inf), np.zeros((m, n), bool)
            q, node = np.repeat(np.arange(m), len(self.entries)), np.tile(self.entries, m)
            while True:
                for z in range(0, len(q), EXPAND):
                    i, j = q[z:z + EXPAND], node[z:z + EXPAND]
                    dist[i, j] = np.sqrt(np.maximum(own[i] + self.square[j] - 2 * np.einsum("ij,ij->i", part[i], self.c[j]), ease))
                edge = dist.min(axis=1) * ratio
                if beam < n:
                    edge = np.maximum(edge, np.partition(dist, beam, axis=1)[:, beam])
                q, node = np.nonzero((dist <= edge[:, None]) & ~done & np.isfinite(dist))
                if not len(q):
                    break
                q, node = q[:EXPAND], node[:EXPAND]
                done[q, node] = True
                key = np.unique(np.repeat(q, self.links.shape[1]) * n + self.links[node].ravel())
                q, node = key // n, key % n
                new = np.isinf(dist[q, node])
                q, node = q[new], node[new]
            yield a, dist, dist.min(axis=1)

    def lists_of(self, x: np.ndarray, spread: float = SPREAD, copies: int = COPIES) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the nearest list of each row, and others near by (see the module)."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for a, dist, nearest in self.within(x, spread):
            rows = np.arange(len(dist))
            last = dist.argmin(axis=1)
            chosen = [last]
            out.append((a + rows, last))
            for _ in range(min(copies, len(self.c)) - 1):
                dist[rows, last] = np.inf
                last = dist.argmin(axis=1)
                d = dist[rows, last]
                fits = d <= nearest * spread
                if not fits.any():
                    break
                for o in chosen:
                    fits &= (o < 0) | (np.linalg.norm(self.c[last] - self.c[o], axis=1) >= d)
                chosen.append(np.where(fits, last, -1))
                out.append((a + rows[fits], last[fits]))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def reads(self, x: np.ndarray, ratio: float, ease: float, sizes: np.ndarray, least: int):
        """For each batch of rows: (row, list) within ``ratio``; rows whose lists hold fewer than ``least`` vectors look further."""
        least = min(least, int(sizes.sum()))
        todo = np.arange(len(x))
        while len(todo):
            short = []
            for a, dist, near in self.within(x[todo], ratio, ease):
                some = (dist <= (near * ratio)[:, None]) & (sizes > 0)
                enough = some @ sizes >= least
                who, on = np.nonzero(some & enough[:, None])
                yield todo[a + who], on
                short.append(todo[a + np.flatnonzero(~enough)])
            todo, ratio = np.concatenate(short), 1.5 * ratio


# --- vectors ---------------------------------------------------------------

def lifted(x: np.ndarray, greatest: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(0.0, greatest ** 2 - (x * x).sum(axis=1)))[:, None]], axis=1)


def lifted_queries(x: np.ndarray, greatest: float) -> np.ndarray:
    return np.concatenate([x * (greatest / np.linalg.norm(x, axis=1))[:, None], np.zeros((len(x), 1))], axis=1)


def top(scores: np.ndarray, rows: np.ndarray, query: np.ndarray, ids: np.ndarray, k: int, copies: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the ``k`` best by score and id, each id once; the products' last bits, which depend on the layout, are taken anew."""
    at = np.flatnonzero(scores > -np.inf)
    if len(at) > k * copies:  # an id has up to ``copies`` places
        edge = np.partition(scores[at], len(at) - k * copies)[len(at) - k * copies]
        at = at[scores[at] >= edge - SLACK * max(1.0, np.abs(scores[at]).max())]
    exact = (rows[at] * query).sum(axis=1)
    order = np.lexsort((ids[at], -exact))
    at, exact = at[order], exact[order]
    _, once = np.unique(ids[at], return_index=True)
    once = np.sort(once)[:k]
    return at[once], exact[once]


def top_of_each(scores: np.ndarray, rows: np.ndarray, queries: np.ndarray, ids: np.ndarray, k: int, copies: int):
    """(query, place, score) of the ``k`` best for each row of ``scores``; an id has up to ``copies`` places, -inf stands for unread."""
    n, most = scores.shape[1], k * copies + 8
    if most >= n:
        found = [top(s, rows, q, ids, k, copies) for s, q in zip(scores, queries)]
    else:
        at = np.argpartition(scores, n - most, axis=1)[:, n - most:]
        some = np.take_along_axis(scores, at, 1)
        low, high = some.min(axis=1), np.sort(some, axis=1)[:, -k * copies]
        finite = np.where(np.isfinite(some), np.abs(some), 0).max(axis=1)
        crowded = (low >= high - SLACK * np.maximum(1.0, finite)) & (low > -np.inf)  # more may tie at the edge
        exact = np.where(some > -np.inf, (rows[at] * queries[:, None, :]).sum(axis=2), -np.inf)
        order = np.lexsort((ids[at], -exact), axis=1)
        at, exact = np.take_along_axis(at, order, 1), np.take_along_axis(exact, order, 1)
        fits = exact > -np.inf
        fits[:, 1:] &= ids[at[:, 1:]] != ids[at[:, :-1]]
        fits &= np.cumsum(fits, axis=1) <= k
        found = [top(scores[i], rows, queries[i], ids, k, copies) if crowded[i] else (at[i][fits[i]], exact[i][fits[i]]) for i in range(len(at))]
    lengths = [len(f[0]) for f in found]
    return np.repeat(np.arange(len(found)), lengths), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """rep (smallest id), v and ids (the k + 1 smallest) of every vector that takes part."""
    ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    good = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("v"), ok.alias("ok")).where("ok AND vec_id IS NOT NULL").drop("ok")
    ranked = good.withColumn("n", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    return ranked.groupBy("v").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_set("vec_id")).alias("ids"))


def _sample(df: DataFrame, key: str, most: int, n: int, seed: int) -> DataFrame:
    """About ``most`` of ``n`` rows, by a hash of their key."""
    rate = min(1.0, most / max(n, 1))
    return df if rate == 1 else df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int(rate * (1 << 30)))


def _probe(vectors: DataFrame, probes: pa.Table, width: int, k: int) -> pa.Table:
    """Exact k + 1 best vectors of every probe: rep of the probe, rep, score, v."""
    ids, x = probes.column("rep").to_numpy(), matrix(probes.column("v"), width)
    schema = pa.schema([("probe", pa.int64()), ("rep", pa.int64()), ("score", pa.float64()), ("v", pa.list_(pa.float64()))])

    def work(batches):
        for batch in batches:
            for part in (batch.slice(a, 8192) for a in range(0, batch.num_rows, 8192)):
                rows, reps, out = matrix(part.column("v"), width), part.column("rep").to_numpy(), []
                scores = x @ rows.T
                for i, s in zip(ids, range(len(x))):
                    at, exact = top(scores[s], rows, x[s], reps, k + 1)
                    out += [(i, reps[t], e, rows[t]) for t, e in zip(at, exact)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    found = vectors.select("rep", "v").mapInArrow(work, "probe bigint, rep bigint, score double, v array<double>")
    n = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "rep"))
    return found.withColumn("n", n).where(F.col("n") <= k + 1).drop("n").toArrow()


def _ratio(graph: Graph, greatest: float, ease: float, probes: pa.Table, exact: pa.Table, width: int, share: float) -> float:
    """Least ratio by which the probes' lists hold ``share`` of their exact neighbours."""
    if not exact.num_rows:
        return 1.0
    q = {i: v for i, v in zip(probes.column("rep").to_pylist(), lifted_queries(matrix(probes.column("v"), width), greatest))}
    rows = lifted(matrix(exact.column("v"), width), greatest)
    who = np.array([q[i] for i in exact.column("probe").to_pylist()])
    at, lists = graph.lists_of(rows)
    d = np.sqrt(((who[at] - graph.c[lists]) ** 2).sum(axis=1) + ease)
    needed = np.full(len(rows), np.inf)
    np.minimum.at(needed, at, d)
    everything = np.array(list(q.values()))
    nearest = {i: float(x) for a, _, near in graph.within(everything, 1.0, ease) for i, x in zip(list(q)[a:a + len(near)], near)}
    least = np.array([nearest[i] for i in exact.column("probe").to_pylist()])
    foreign = exact.column("rep").to_numpy() != exact.column("probe").to_numpy()
    needed = (needed / np.maximum(least, 1e-12))[foreign] if foreign.any() else needed / np.maximum(least, 1e-12)
    return float(max(1.0, np.quantile(needed, share, method="higher")) * (1 + 1e-9))


# --- search ----------------------------------------------------------------

def _packed(sizes: np.ndarray, group_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First group and number of groups of every list; neighbouring short lists share a group."""
    first, parts, group, room = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, group_rows
    for n, size in enumerate(sizes.tolist()):
        if size > room and room < group_rows:
            group, room = group + 1, group_rows
        parts[n] = max(1, math.ceil(size / group_rows))
        first[n] = group
        room -= size
        if room <= 0:
            group, room = group + int(parts[n]), group_rows
    return first, parts


def nearest_vectors(rows: DataFrame, is_query: Column, k: int = NEAREST, list_rows: int = LIST_ROWS, lists: int = LISTS, sample: int = SAMPLE, share: float = SHARE,
                    group_rows: int = GROUP_ROWS, group_queries: int = GROUP_QUERIES) -> DataFrame:
    """The ``k`` nearest found of every query: query_id, rank, vec_id, score; nearest first, ties to the smaller id.

    ``rows``: vec_id, embedding; queries are the rows where ``is_query``. Nearness is the inner product of the vectors as they are, in
    double precision. A query never finds its own id. With fewer than k + 1 ids a query gets what the lists hold.

    Rows without id, and vectors that are null, empty, zero or hold null or non-finite components take no part; an empty table
    gives no row. A shorter vector is filled up with zeros. A repeated id counts once, with its best score. Other columns
    are ignored. Every vector is indexed; centroids are fitted on about ``sample`` vectors and the ratio on PROBES queries.
    """
    spark = rows.sparkSession
    rows = rows.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("__query"))
    vectors = C.cut(distinct_vectors(rows, k))
    asked = rows.where("__query").select(F.col("vec_id").cast("bigint").alias("query_id"), F.col("embedding").alias("v"))
    asked = C.cut(asked.join(vectors.select("v", "rep"), "v").select("query_id", F.col("rep").alias("asker"), "v").distinct())
    askers = asked.groupBy("asker").agg(F.first("v").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w"), F.max(norm).alias("m")).first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if not size.n:
        return empty
    width, greatest = size.w, size.m
    if not math.isfinite(greatest) or not greatest:
        raise ValueError("norms of the vectors are out of range")

    most = max(2, min(sample, SAMPLE_BYTES // (8 * width)))
    points = matrix(_sample(vectors.select("rep", "v"), "rep", most, size.n, 1).select("v").toArrow().column("v"), width)
    if not len(points):
        points = matrix(vectors.select("v").limit(1).toArrow().column("v"), width)
    points = lifted(points, greatest)
    graph = Graph(balanced_centroids(points, max(1, min(lists, math.ceil(size.n / list_rows), len(points)))))
    # a query's distance to the vectors of a list is that to its centroid and the spread around it
    ease = float(np.concatenate([near ** 2 for _, _, near in graph.within(points, 1.0)]).mean())
    n_askers = askers.count()
    probes = _sample(askers, "asker", PROBES, n_askers, 2).select(F.col("asker").alias("rep"), "v").toArrow()
    ratio = _ratio(graph, greatest, ease, probes, _probe(vectors, probes, width, k), width, share) if probes.num_rows else 1.0

    # vectors to lists
    def assign(batches):
        for batch in batches:
            at, on = graph.lists_of(lifted(matrix(batch.column("v"), width), greatest))
            out = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(on, pa.int64())], names=[*out.schema.names, "list"])

    v_type = vectors.schema["v"].dataType.simpleString()
    held = C.cut(vectors.select("rep", "v", "ids").mapInArrow(assign, f"rep bigint, v {v_type}, ids array<bigint>, list bigint"))
    sizes = np.zeros(len(graph.c), np.int64)
    for r in held.groupBy("list").count().toArrow().to_pylist():  # a row for each list at most
        sizes[r["list"]] = r["count"]
    first, parts = _packed(sizes, group_rows)
    table = spark.createDataFrame(pa.table([pa.array(np.arange(len(sizes))), pa.array(first), pa.array(parts)], names=["list", "first", "parts"]))
    held = held.join(F.broadcast(table), "list").withColumn("group", F.col("first") + F.pmod(F.xxhash64("rep"), F.col("parts"))).drop("first", "parts")

    # queries to groups, with the lists that they read there
    def route(batches):
        for batch in batches:
            q, vs = batch.column("asker").to_numpy(), batch.column("v")
            for who, on in graph.reads(lifted_queries(matrix(vs, width), greatest), ratio, ease, sizes, COPIES * (k + 1)):
                n = parts[on]
                who, on, group = np.repeat(who, n), np.repeat(on, n), np.repeat(first[on], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                order = np.lexsort((on, group, who))
                who, on, group = who[order], on[order], group[order]
                new = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (group[1:] != group[:-1]))) if len(who) else np.zeros(0, int)
                reads = pa.ListArray.from_arrays(pa.array(np.append(new, len(who)), pa.int32()), pa.array(on, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(q[who[new]]), vs.take(pa.array(who[new])), pa.array(group[new], pa.int64()), reads], names=["asker", "v", "group", "reads"])

    routed = C.cut(askers.mapInArrow(route, f"asker bigint, v {v_type}, group bigint, reads array<bigint>"))
    schema = pa.schema([("asker", pa.int64()), ("rep", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])

    def scan(asking: pa.Table, stored: pa.Table) -> pa.Table:
        if not asking.num_rows or not stored.num_rows:
            return schema.empty_table()
        stored = stored.sort_by("list")
        on, reps, x = stored.column("list").to_numpy(), stored.column("rep").to_numpy(), matrix(stored.column("v"), width)
        _, times = np.unique(reps, return_counts=True)
        names, begin = np.unique(on, return_index=True)
        end = np.append(begin[1:], len(on))
        askers, q = asking.column("asker").to_numpy(), matrix(asking.column("v"), width)
        reads = asking.column("reads").combine_chunks()
        reader = np.repeat(np.arange(len(q)), reads.value_lengths().to_numpy(zero_copy_only=False))
        reading = np.searchsorted(names, reads.flatten().to_numpy())
        out = ([], [], [])
        step = max(1, CELLS // len(on))
        for z in range(0, len(q), step):
            scores = np.full((len(q[z:z + step]), len(on)), -np.inf)
            own = (reader >= z) & (reader < z + step)
            who, what = reader[own] - z, reading[own]
            order = np.argsort(what, kind="stable")
            who, what = who[order], what[order]
            cuts = np.flatnonzero(np.diff(what)) + 1
            for sel, name in zip(np.split(who, cuts), what[np.append(0, cuts)] if len(what) else ()):
                scores[sel, begin[name]:end[name]] = q[z + sel] @ x[begin[name]:end[name]].T
            who, at, score = top_of_each(scores, x, q[z:z + step], reps, k + 1, int(times.max()))
            out[0].append(askers[z + who])
            out[1].append(at)
            out[2].append(score)
        at = np.concatenate(out[1])
        ids = stored.column("ids").combine_chunks().take(pa.array(at))
        return pa.table([pa.array(np.concatenate(out[0]), pa.int64()), pa.array(reps[at]), pa.array(np.concatenate(out[2])), ids], schema=schema)

    left, right = deal(routed, held, ["group"], "asker", "rep", group_queries, None)
    found = left.cogroup(right).applyInArrow(scan, "asker bigint, rep bigint, score double, ids array<bigint>")
    found = found.groupBy("asker", "rep").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    n = F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "rep"))
    found = found.withColumn("n", n).where(F.col("n") <= k + 1).select("asker", "score", F.explode("ids").alias("vec_id"))
    hits = asked.select("query_id", "asker").join(found, "asker").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
