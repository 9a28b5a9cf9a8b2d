"""BM25 search. Definition: k1 = 1.2, b = 0.75, idf = ln(1 + (N - df + 0.5) / (df + 0.5)), distinct query terms.

Statistics cover the rows given. As with the vector join there are two physical
forms: when the queries' weight matrix (queries x distinct terms) is small, which
is checked, documents are scored where they lie and only each batch's best ``k``
per (query, video) are shuffled; otherwise postings and query terms meet in a
shuffled equi-join.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import tokenize
from ..session import cut_lineage
from .knn import _group_ids, partial_top_k
from .skew import top_k

MAX_TASK_TERMS = 200_000     # (query, term) rows that may travel with a task
MAX_TASK_CELLS = 8_000_000   # queries x distinct terms of the weight matrix
BLOCK_CELLS = 4_000_000      # documents x terms scored at once inside a task


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(tokenize(text))).alias("term"))


def corpus_stats(units: DataFrame, terms: DataFrame, text: str = "text", few: bool = False) -> DataFrame:
    """One pass over ``units``: df of every query term, and on the row of the empty term the number of
    documents and their total length. No document and no term of one is shuffled, only a task's (term, count) pairs.

    ``few``: the terms may travel with the tasks; otherwise all terms are counted before they meet those of the queries.
    """
    docs = units.select(tokenize(text).alias("t"))
    rows = docs.select(F.size("t").cast("long").alias("dl"), F.explode(F.concat(F.array_distinct("t"), F.array(F.lit("")))).alias("term"))
    wanted = terms.select("term").unionByName(terms.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    if few:
        rows = rows.join(F.broadcast(wanted), "term", "left_semi")
    counts = rows.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term") == "", F.col("dl"))).alias("dl"))
    return counts if few else counts.join(wanted, "term", "left_semi")


def bm25_search(queries: DataFrame, units: DataFrame, k: int = 100, *, by=("video_id",), keep=("segment_idx",), text: str = "text",
                k1: float = 1.2, b: float = 0.75, max_task_terms: int = MAX_TASK_TERMS, max_task_cells: int = MAX_TASK_CELLS) -> DataFrame:
    """Per (query, ``by``) the ``k`` best units with a positive score; ties by ``keep``."""
    by, keep = tuple(by), tuple(keep)
    units = units.select(*by, *keep, text)
    terms = query_terms(queries, text)
    order = [F.desc("score"), *[F.col(c) for c in keep]]
    head = terms.limit(max_task_terms + 1).toArrow()
    stats = cut_lineage(corpus_stats(units, terms, text, head.num_rows <= max_task_terms))
    ids = head.column("query_id").unique()
    if head.num_rows > max_task_terms or len(head.column("term").unique()) * len(ids) > max_task_cells:
        return top_k(_shuffled(terms, stats, units, by, keep, text, k1, b), ["query_id", *by], order, k)

    # at most one row per query term just counted
    df = {r["term"]: r for r in stats.toArrow().to_pylist()}
    total = df.pop("", {"df": 0, "dl": 0})
    n_docs, avgdl = total["df"], (total["dl"] or 0) / max(total["df"], 1)
    vocabulary = sorted(df)
    index = {t: i for i, t in enumerate(vocabulary)}
    weight = np.zeros((len(vocabulary), len(ids)))
    position = {q: i for i, q in enumerate(ids.to_pylist())}
    for q, t in zip(head.column("query_id").to_pylist(), head.column("term").to_pylist()):
        if t in index:
            weight[index[t], position[q]] = np.log1p((n_docs - df[t]["df"] + 0.5) / (df[t]["df"] + 0.5))
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    u = units.select(*by, *keep, tokenize(text).alias("__t"))
    out_type = StructType([queries.schema["query_id"], *[u.schema[c] for c in by + keep], StructField("score", DoubleType())])
    schema = to_arrow_schema(out_type)
    rows_at_once = max(1, BLOCK_CELLS // max(1, len(vocabulary)))

    def score(batch, edges):
        tokens = batch.column("__t")
        n = batch.num_rows
        lengths = np.asarray(tokens.value_lengths().to_pylist(), dtype=np.float64)
        flat = tokens.flatten().dictionary_encode()
        known = np.fromiter((index.get(t, -1) for t in flat.dictionary.to_pylist()), dtype=np.int64, count=len(flat.dictionary))
        term = known[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.empty(0, np.int64)
        doc = np.repeat(np.arange(n), lengths.astype(np.int64))[term >= 0]
        tf = np.zeros((n, len(vocabulary)))
        np.add.at(tf, (doc, term[term >= 0]), 1.0)
        tf = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths / max(avgdl, 1e-12))[:, None])
        scores = np.round(tf @ weight, 9).T   # copies of a text must tie on every layout
        groups = _group_ids([batch.column(c) for c in by], n)
        qi, ui = partial_top_k(scores, groups, k, None, edges, lambda i: tuple(batch.column(c)[int(i)].as_py() for c in by))
        hit = scores[qi, ui] > 0
        qi, ui = qi[hit], ui[hit]
        cols = [ids.take(pa.array(qi)), *[batch.column(c).take(pa.array(ui)) for c in by + keep], pa.array(scores[qi, ui])]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

    def run(batches):
        edges: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                yield score(batch.slice(at, rows_at_once), edges)

    return top_k(u.mapInArrow(run, out_type), ["query_id", *by], order, k)


def _shuffled(terms, stats, units, by, keep, text, k1, b):
    """Scores by joining postings with query terms."""
    key = [*by, *keep]
    total = stats.where("term = ''")
    n, avgdl = total.select("df").scalar(), total.select(F.col("dl") / F.col("df")).scalar()
    idf = stats.where("term <> ''").select("term", F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weighted = terms.join(idf, "term")
    u = units.select(*key, tokenize(text).alias("__t")).withColumn("dl", F.size("__t"))
    post = u.select(*key, "dl", F.explode("__t").alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    post = post.groupBy(*key, "dl", "term").agg(F.count("*").alias("tf"))
    norm = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    return post.join(weighted, "term").groupBy("query_id", *key).agg(F.round(F.sum(F.col("idf") * norm), 9).alias("score"))
