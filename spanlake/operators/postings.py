"""A stored inverted index for BM25: written once, read only for the terms of the queries.

``docs``: one row for each block of documents, with their keys and lengths as arrays. ``postings``: one row for each (term, block),
with the places of the block's documents that have the term and their counts (``hits``: two rows of four-byte integers), and the
block's maxima (largest count, shortest document). Postings are partitioned by a bucket of the term and sorted by term inside a file, so a search reads the
buckets of its terms and, there, the row groups that can hold them. It never reads a text.

A block has about ``block_docs`` documents, all of one video where a video is large; a video's documents beyond that are dealt into
parts. All postings of a block meet in one task of a search, which adds up the scores there, so only each block's best ``k``
per (query, video) are shuffled. With few videos in a block, the maxima bound what its documents can score: a query that has
``k`` better results in those videos skips the block.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import joined_tokens, tokenize
from ..session import cut_lineage
from .knn import MAX_CELLS, _group_ids, partial_top_k
from .skew import top_k

BUCKETS, BLOCK_DOCS = 32, 2_048
#: (query, term) rows that may travel with a task; more queries are searched for in parts.
MAX_TASK_TERMS = 200_000
#: Terms that are named in a filter; more are joined.
NAMED_TERMS = 5_000
#: Rows of the table of large videos that may travel with a task.
LARGE_ROWS = 200_000
#: Blocks with so many videos or fewer take part in pruning, with the best scores of so many videos in memory.
FEW_GROUPS, KEPT_GROUPS = 4, 64


def _blocks(batches, name: str = "block"):
    """Tables of one block each, from batches sorted by block."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        at = t.column(name).to_numpy()
        cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
        for a, b in zip([0, *cuts[:-1]], cuts):
            yield t.slice(a, b - a)
        rest = t.slice(cuts[-1]) if len(cuts) else t
    if rest is not None and rest.num_rows:
        yield rest


#: Written without a key column, so that it can be read with no file there.
POSTINGS = "term string, block bigint, n bigint, max_tf bigint, min_dl bigint, hits binary, bucket int"
#: The bucket in which the rows of documents are written; ``docs`` is made of it.
DOCS_BUCKET = -1


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/docs"), spark.read.schema(POSTINGS).parquet(f"{path}/postings").where(F.col("bucket") > DOCS_BUCKET)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _pack(t: pa.Table, block: int, keys: list[str], schema: pa.Schema) -> pa.RecordBatch:
    """The block's postings, one row a term, and the row of its documents (an empty term)."""
    n, tokens = t.num_rows, pc.split_pattern(_one(t.column("__t")), " ")
    lengths = pc.fill_null(tokens.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = tokens.flatten().dictionary_encode()
    kind = np.int32 if n * len(flat.dictionary) < 1 << 31 else np.int64
    key, tf = np.unique(flat.indices.to_numpy(zero_copy_only=False).astype(kind) * kind(n) + np.repeat(np.arange(n, dtype=kind), lengths), return_counts=True)
    code, doc = key // n, key % n
    head = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    many = np.diff(np.append(head, len(code)))
    # a term's places, then their counts
    at = np.arange(len(code)) + np.repeat(head, many)
    hits = np.empty(2 * len(code), "<i4")
    hits[at], hits[at + np.repeat(many, many)] = doc, tf
    ends = 4 * 2 * np.append(head, [len(code), len(code)])
    tail = lambda values, last: pa.array(np.append(values, last), pa.int64())
    own = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    of_docs = {"total": pa.array([lengths.sum()]), "dl": own(pa.array(lengths, pa.int32())), **{f"d_{c}": own(_one(t.column(c))) for c in keys}}
    struct = schema.field("docs").type
    columns = {
        "block": pa.array(np.repeat(block, len(head) + 1), pa.int64()),
        "term": pa.concat_arrays([flat.dictionary.take(pa.array(code[head])).cast(pa.string()), pa.array([""])]),
        "n": tail(many, n), "max_tf": tail(np.maximum.reduceat(tf, head) if len(head) else [], 0),
        "min_dl": tail(np.minimum.reduceat(lengths[doc], head) if len(head) else [], 0),
        "hits": pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(hits)]),
        "docs": pa.concat_arrays([pa.nulls(len(head), struct), pa.StructArray.from_arrays([of_docs[f.name].cast(f.type) for f in struct], fields=list(struct))])}
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)


def write_postings(units: DataFrame, path: str, *, by=("video_id",), keep=("segment_idx",), text: str = "text", buckets: int = BUCKETS, block_docs: int = BLOCK_DOCS) -> None:
    """Index ``units`` under ``path``. A unit without text is left out; ``by`` and ``keep`` together name a unit.

    Texts are shuffled once, as they are, and become tokens where they are packed; what is packed goes straight to the files.
    """
    by, keep = list(by), list(keep)
    sizes = cut_lineage(units.groupBy(*by).agg(F.count("*").alias("__n")))  # they only steer blocks, so no text is read for them
    blocks = max(1, math.ceil((sizes.agg(F.sum("__n")).first()[0] or 0) / block_docs))
    large = sizes.where(F.col("__n") > block_docs).withColumn("__parts", F.ceil(F.col("__n") / block_docs)).drop("__n")
    large = F.broadcast(large) if large.count() <= LARGE_ROWS else large
    rows = units.where(F.col(text).isNotNull()).select(*by, *keep, F.col(text).alias("__t")).join(large, by, "left")
    part = F.pmod(F.xxhash64(*keep), F.coalesce("__parts", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(*by, part), F.lit(blocks)).cast("bigint")).drop("__parts")
    lists = ", ".join(f"`d_{c}`: array<{rows.schema[c].dataType.simpleString()}>" for c in by + keep)
    ddl = f"block bigint, term string, n bigint, max_tf bigint, min_dl bigint, hits binary, docs struct<total: bigint, dl: array<int>, {lists}>"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def pack(batches):
        for t in _blocks(batches):
            # several parts may meet in a block: beyond two it is cut, so that memory does not follow chance
            pieces = math.ceil(t.num_rows / (2 * block_docs))
            cuts = [t.num_rows * i // pieces for i in range(pieces + 1)]
            block = t.column("block")[0].as_py()
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                yield _pack(t.slice(a, b - a), block + i * blocks, by + keep, schema)

    # a block is packed from rows in the order of their keys, so a task that runs again gives the same places
    sorted_rows = rows.repartition("block").sortWithinPartitions("block", *by, *keep)
    packed = sorted_rows.select("block", *by, *keep, joined_tokens("__t").alias("__t")).mapInArrow(pack, ddl)
    bucket = F.when(F.col("docs").isNotNull(), DOCS_BUCKET).otherwise(F.pmod(F.xxhash64("term"), F.lit(buckets))).cast("int")
    spread = F.pmod("block", F.lit(max(1, blocks // 256)))
    packed = packed.withColumn("bucket", bucket).repartition("bucket", spread).sortWithinPartitions("bucket", "term", "block")
    packed.write.partitionBy("bucket").parquet(f"{path}/postings")
    docs = units.sparkSession.read.schema(f"{ddl}, bucket int").parquet(f"{path}/postings").where(F.col("bucket") == DOCS_BUCKET)
    docs.select("block", "n", "docs.*", F.lit(buckets).alias("buckets")).write.parquet(f"{path}/docs")


def posted_stats(spark: SparkSession, path: str) -> DataFrame:
    """term, df, blocks, n_docs and avgdl of a stored index, from its counts alone."""
    docs, posted = _read(spark, path)
    n, total = docs.agg(F.sum("n"), F.sum("total")).first()
    p = posted.groupBy("term").agg(F.sum("n").alias("df"), F.count("*").alias("blocks"))
    return p.select("term", "df", "blocks", F.lit(n or 0).cast("bigint").alias("n_docs"), F.lit((total or 0) / n if n else 0.0).alias("avgdl"))


class _Scores:
    """Scores of one block after the other for the queries of a task."""

    def __init__(self, readers: dict, idf: dict, n_queries: int, avgdl: float, k: int, k1: float, b: float):
        self.readers, self.idf, self.n, self.avgdl, self.k, self.k1, self.b = readers, idf, n_queries, max(avgdl, 1e-12), k, k1, b
        self.best: dict = {}
        self.skipped = self.seen = 0

    def impact(self, tf, dl):
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / self.avgdl))

    def block(self, dl: np.ndarray, groups: np.ndarray, names: list, terms: list, ords: list, tf: list, max_tf: np.ndarray, min_dl: np.ndarray):
        """(queries, scores): a row for each query that can still gain from the block; a score that cannot enter is 0."""
        few = len(names) <= FEW_GROUPS
        live = np.zeros(self.n, bool)
        for t in terms:
            live[self.readers[t]] = True
        self.seen += int(live.sum())
        if few and all(g in self.best for g in names):
            bound = np.zeros(self.n)
            for t, m in zip(terms, self.impact(max_tf, min_dl)):
                bound[self.readers[t]] += self.idf[t] * m
            out = bound < np.minimum.reduce([self.best[g][:, 0] for g in names]) - 1e-8
            self.skipped += int((live & out).sum())
            live &= ~out
        asked = np.flatnonzero(live)
        row = np.full(self.n, -1)
        row[asked] = np.arange(len(asked))
        scores = np.zeros((len(asked), len(dl)))
        for t, at, f in zip(terms, ords, tf):
            q = row[self.readers[t]]
            q = q[q >= 0]
            if len(q):
                scores[q[:, None], at] += self.idf[t] * self.impact(f, dl[at])
        scores = np.round(scores, 9)  # copies of a text must tie on every layout
        for g, name in enumerate(names if few and len(asked) else ()):
            have, mine = self.best.pop(name, np.zeros((self.n, self.k))), groups == g
            own = np.concatenate([have[asked], scores[:, mine]], axis=1)
            have[asked] = np.partition(own, own.shape[1] - self.k, axis=1)[:, own.shape[1] - self.k:]
            have[asked] = np.sort(have[asked], axis=1)
            scores[:, mine] *= scores[:, mine] >= have[asked, :1]  # below k results that the task has seen: no hit
            self.best[name] = have  # the last one used comes last
            while len(self.best) > KEPT_GROUPS:
                self.best.pop(next(iter(self.best)))
        return asked, scores


def search_postings(queries: DataFrame, path: str, k: int = 100, *, by=("video_id",), keep=("segment_idx",), text: str = "text",
                    k1: float = 1.2, b: float = 0.75, max_task_terms: int = MAX_TASK_TERMS) -> DataFrame:
    """The rows of :func:`lexical.bm25_search` over the indexed units: per (query, ``by``) the ``k`` best with a positive score."""
    spark, by, keep = queries.sparkSession, list(by), list(keep)
    docs, posted = _read(spark, path)
    n_docs, total, buckets = docs.agg(F.sum("n"), F.sum("total"), F.max("buckets")).first()
    types = StructType([queries.schema["query_id"], *[StructField(c, docs.schema[f"d_{c}"].dataType.elementType) for c in by + keep], StructField("score", DoubleType())])
    order = [F.desc("score"), *[F.col(c) for c in keep]]
    terms = queries.select("query_id", F.explode(F.array_distinct(tokenize(text))).alias("term"))
    terms = terms.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets or 1)).cast("int"))
    head = terms.limit(max_task_terms + 1).toArrow()
    if head.num_rows > max_task_terms and queries.select("query_id").distinct().count() > 1:
        parts = math.ceil(2 * terms.count() / max_task_terms)
        out = None
        for p in range(parts):
            mine = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p)
            found = search_postings(mine, path, k, by=by, keep=keep, text=text, k1=k1, b=b, max_task_terms=(1 << 31) - 2)
            out = found if out is None else out.unionByName(found)
        return out
    if not head.num_rows or not n_docs:
        return top_k(spark.createDataFrame([], types), ["query_id", *by], order, k)

    ids = _one(head.column("query_id").unique())
    place = {q: i for i, q in enumerate(ids.to_pylist())}
    readers: dict = {}
    for q, t in zip(head.column("query_id").to_pylist(), head.column("term").to_pylist()):
        readers.setdefault(t, []).append(place[q])
    posted = posted.where(F.col("bucket").isin(sorted(set(head.column("bucket").to_pylist()))))
    if len(readers) <= NAMED_TERMS:
        posted = posted.where(F.col("term").isin(sorted(readers)))
    else:
        posted = posted.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    df = {r["term"]: r["df"] for r in posted.groupBy("term").agg(F.sum("n").alias("df")).toArrow().to_pylist()}  # a row for each query term at most
    idf = {t: math.log1p((n_docs - d + 0.5) / (d + 0.5)) for t, d in df.items()}
    readers = {t: np.array(readers[t]) for t in df}
    avgdl, schema, n_queries = total / n_docs, to_arrow_schema(types), len(ids)

    both = docs.select("block", F.lit("").alias("term"), "dl", *[f"d_{c}" for c in by + keep]).unionByName(
        posted.select("block", "term", "hits", "max_tf", "min_dl"), allowMissingColumns=True)

    def score(batches):
        state = _Scores(readers, idf, n_queries, avgdl, k, k1, b)
        for t in _blocks(batches):
            names = t.column("term").to_pylist()
            if len(names) < 2:
                continue
            shown = {c: _one(t.column(f"d_{c}"))[0].values for c in by + keep}
            dl = _one(t.column("dl"))[0].values.to_numpy().astype(np.float64)
            at, tf = zip(*(np.frombuffer(hits.as_buffer(), "<i4").reshape(2, -1) for hits in t.column("hits")[1:]))
            groups = _group_ids([shown[c] for c in by], len(dl))
            kinds, first = np.unique(groups, return_index=True)
            keys = [tuple(shown[c][int(i)].as_py() for c in by) for i in first] if len(kinds) <= FEW_GROUPS else [None] * (FEW_GROUPS + 1)
            asked, scores = state.block(dl, np.searchsorted(kinds, groups), keys, names[1:], at, tf, *(t.column(c).to_numpy()[1:].astype(np.float64) for c in ("max_tf", "min_dl")))
            step = max(1, MAX_CELLS // len(dl))
            for z in range(0, len(asked), step):
                qi, ui = partial_top_k(scores[z:z + step], groups, k)
                value = scores[z:z + step][qi, ui]
                hit = value > 0
                qi, ui, value = qi[hit], ui[hit], value[hit]
                columns = [ids.take(pa.array(asked[z:z + step][qi])), *[shown[c].take(pa.array(ui)) for c in by + keep], pa.array(value)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    found = both.repartition("block").sortWithinPartitions("block", "term").mapInArrow(score, types)
    return top_k(found, ["query_id", *by], order, k)
