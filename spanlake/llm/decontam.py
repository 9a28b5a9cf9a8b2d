"""Benchmark decontamination by latent semantic retrieval.

Terms are the words of the benchmark and its answers (lower-cased, without punctuation) with document frequencies over all
documents. A randomised SVD gives a latent space of the TF-IDF passages of all documents: the product of their Gram matrix
with a random test matrix, a distributed sum over the passages, stands for that matrix (Nystroem). Each window of each document is projected into it; a window
near a benchmark item (cosine) is a candidate, and a candidate is a leak if the item's words occur in order
around the window (longest common subsequence) and the item's answer does too. Windows are as long as the item's
length class asks; long items are looked for by several passages, any of which makes the whole item a candidate.

The norm of a window counts all its words; those that are no terms weigh alike, by their mean squared idf over
all documents. A window's cosine is at most the share of its norm that terms have, so windows below the threshold
by that share need no projection.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Benchmark passages (items, but for long ones) in a block, on average; each block has a latent space and passes of its own. Fewer than RANK: a space
#: with fewer dimensions than items is blind to some of them, even to their verbatim copies.
ITEMS = 200
#: Results of blocks that are joined into one before more are added.
UNION = 32
RANK, POWER = 256, 2
#: Ranges of terms that a sum over the passages is put together by.
RANGES = 16
WINDOW, STRIDE = 32, 16
#: Longest item, in words, for windows of so many words (their stride is half of that); other items have WINDOW.
SHORT = {4: 6, 8: 12}
#: Most words of a passage; longer items are cut evenly into passages.
PASSAGE = 64
COSINE, COMMON, ANSWER = 0.25, 0.7, 0.5


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return C.word_hashes(*C.text_bytes(pa.compute.utf8_lower(column)), C.MARKS)


def _sentence_tail(text: str) -> str:
    """The last sentence of an item, where no answer is given; the whole item if it is one sentence."""
    parts = [p for p in text.replace("\n", " ").replace("? ", "?\0").replace("! ", "!\0").replace(". ", ".\0").split("\0") if p.strip()]
    return parts[-1] if parts else ""


class Bench:
    """Items as term numbers, the latent space, and each item's place in it."""

    def __init__(self, ids: list[int], texts: list[str], answers: list[str]):
        words, at = _words(pa.array(texts, pa.large_string()))
        told, cut = _words(pa.array(answers, pa.large_string()))
        self.ids, self.vocab = ids, np.unique(np.concatenate([words, told]))
        self.items = [np.searchsorted(self.vocab, words[a:b]) for a, b in zip(at, at[1:])]
        self.passages: list[tuple[int, np.ndarray]] = []  # item and terms
        self.sizes: dict[int, list[int]] = {}  # passages by length of the windows that they are sought in
        for i, item in enumerate(self.items):
            size = next((w for w, most in SHORT.items() if len(item) <= most), WINDOW)
            for piece in np.array_split(item, max(1, -(-len(item) // PASSAGE))):
                self.sizes.setdefault(size, []).append(len(self.passages))
                self.passages.append((i, piece))
        self.answers = [np.unique(np.searchsorted(self.vocab, told[a:b])) for a, b in zip(cut, cut[1:])]
        self.bits = []
        for item in self.items:
            places: dict[int, int] = {}
            for i, w in enumerate(item.tolist()):
                places[w] = places.get(w, 0) | 1 << i
            self.bits.append(places)

    def terms(self, words: np.ndarray) -> np.ndarray:
        """Term number of each word, -1 for others."""
        if not len(self.vocab):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.vocab, words), len(self.vocab) - 1)
        return np.where(self.vocab[at] == words, at, -1)

    def weigh(self, df: np.ndarray, n_docs: int, strange: float):
        """Weights of terms, and of any other word."""
        self.strange = strange
        self.idf = np.log((1 + n_docs) / (1 + df)).astype(np.float32)

    def project(self, basis: np.ndarray):
        self.latent = (basis * self.idf[:, None]).astype(np.float32)
        q = np.zeros((len(self.passages), basis.shape[1]), np.float32)
        for i, (_, piece) in enumerate(self.passages):
            norm = np.sqrt(np.square(np.bincount(piece, minlength=len(self.vocab)) * self.idf).sum())
            if norm > 0:
                q[i] = self.latent[piece].sum(0) / norm
        self.queries = q

    def common(self, item: int, words: np.ndarray) -> int:
        """Length of the longest common subsequence with the item, by bit-parallel rows."""
        n, places = len(self.items[item]), self.bits[item]
        full = (1 << n) - 1
        row = full
        for w in words.tolist():
            m = places.get(w)
            if m:
                u = row & m
                row = ((row + u) | (row - u)) & full
        return n - row.bit_count()


def _counts(batches):
    """(word, df, n): every word of a slice with its documents and occurrences there; and a null with the number of documents."""
    for batch in batches:
        for part in C.slices(batch, "text"):
            words, at = _words(part.column("text"))
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
            order = np.lexsort((doc, words))
            words, doc = words[order], doc[order]
            new = np.ones(len(words), bool)
            new[1:] = words[1:] != words[:-1]
            apart = new.copy()
            apart[1:] |= doc[1:] != doc[:-1]
            first = np.flatnonzero(new)
            df = np.add.reduceat(apart, first, dtype=np.int64) if len(first) else first
            n = np.diff(np.append(first, len(words)))
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([part.num_rows], pa.int64()), pa.array([0], pa.int64())], ["word", "df", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(words[first].view(np.int64)), pa.array(df, pa.int64()), pa.array(n, pa.int64())], ["word", "df", "n"])


class Counts:
    """Document frequencies and occurrences of all words of all documents, counted in one pass for all blocks."""

    def __init__(self, docs: DataFrame):
        counted = docs.mapInArrow(_counts, "word bigint, df bigint, n bigint").groupBy("word").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
        self.words = C.cut(counted)
        log = F.log(1 + F.col("df"))
        known = F.col("word").isNotNull()
        self.n_docs, *sums = self.words.agg(
            F.max(F.when(~known, F.col("df"))), *[F.sum(F.when(known, F.col("n") * log ** i)) for i in range(3)]).first()
        self.n_docs, self.sums = self.n_docs or 0, np.array([x or 0.0 for x in sums])

    def of(self, vocab: np.ndarray) -> tuple[np.ndarray, float]:
        """Document frequencies of ``vocab``, and the root of the mean squared idf of all words that are not in it, which no corpus size moves."""
        df, n = np.zeros(len(vocab)), np.zeros(len(vocab))
        spark = self.words.sparkSession
        mine = spark.createDataFrame(pa.table({"word": pa.array(vocab.view(np.int64))}))
        for word, d, k in self.words.join(mine, "word").collect():
            i = np.searchsorted(vocab, np.array([word]).view(np.uint64))[0]
            df[i], n[i] = d, k
        # sum n (log(1 + N) - log(1 + df))^2 over the other words
        rest = self.sums - [(n * np.log(1 + df) ** i).sum() for i in range(3)]
        top = float(np.log(1 + self.n_docs))
        if rest[0] < 0.5:
            return df, top or 1.0
        return df, float(np.sqrt(max(0.0, top * top - 2 * top * rest[1] / rest[0] + rest[2] / rest[0])))


def _windows(terms: np.ndarray, at: np.ndarray, size: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first and last word of every window; a text shorter than a window is one."""
    n = np.diff(at)
    count = np.where(n > 0, np.maximum(0, -(-(n - size) // stride)) + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    first = at[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * stride
    return doc, first, np.minimum(first + size, at[doc + 1])


def _sums(rows: np.ndarray, terms: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sums of ``rows`` over the terms of each window."""
    size = int((last - first).max(initial=0))
    grid = first[:, None] + np.arange(size)
    t = np.where(grid < last[:, None], terms[np.minimum(grid, len(terms) - 1)], -1)
    out = np.zeros((len(first), rows.shape[1]), np.float32)
    for j in range(size):
        ok = t[:, j] >= 0
        out[ok] += rows[t[ok, j]]
    return out


def _add_back(total: np.ndarray, y: np.ndarray, terms: np.ndarray, place: np.ndarray):
    """Adds to the row of each term the rows of ``y`` of the windows that it stands in (``place``, once for each
    occurrence): those of frequent terms as a matrix product, of the others first occurrences, then second ones, and so on."""
    known = np.flatnonzero(terms >= 0)
    t, w = terms[known], place[known]
    dense = np.flatnonzero(np.bincount(t, minlength=len(total)) * 16 > len(y))
    slot = np.full(len(total), -1)
    slot[dense] = np.arange(len(dense))
    at = slot[t]
    counts = np.bincount(at[at >= 0] * len(y) + w[at >= 0], minlength=len(y) * len(dense)).reshape(len(dense), len(y))
    total[dense] += counts.astype(np.float32) @ y
    t, w = t[at < 0], w[at < 0]
    order = np.argsort(t, kind="stable")
    t, w = t[order], w[order]
    start = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else t
    turn = np.arange(len(t)) - np.repeat(start, np.diff(np.append(start, len(t))))
    order = np.argsort(turn, kind="stable")
    t, w = t[order], w[order]
    end = np.cumsum(np.bincount(turn))
    for a, b in zip(np.append(0, end), end):
        total[t[a:b]] += y[w[a:b]]


def _product(bench: Bench, test: np.ndarray):
    """The sum over passages of x (x . test), the product that a randomised SVD needs, in a row for each task and range of terms."""
    def run(batches):
        total = np.zeros(test.shape, np.float32)
        rows = (test * bench.idf[:, None]).astype(np.float32)
        for batch in batches:
            for part in C.slices(batch, "text", 200_000):
                words, at = _words(part.column("text"))
                terms = bench.terms(words)
                _, first, last = _windows(terms, at, WINDOW, WINDOW)
                if not len(first):
                    continue
                y = _sums(rows, terms, first, last)
                _add_back(total, y, terms, np.repeat(np.arange(len(first)), last - first))  # passages follow one another
        total *= bench.idf[:, None].astype(np.float32)
        parts = np.array_split(total, RANGES)
        yield pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), pa.array([TaskContext.get().partitionId()] * RANGES, pa.int32()),
                                          pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "task", "total"])
    return run


def _added(batches):
    """The sum of all tasks for each range, in their order."""
    part, total = None, None
    for batch in batches:
        for p, blob in zip(batch.column("part").to_pylist(), batch.column("total")):
            x = np.frombuffer(blob.as_buffer(), np.float32)
            if p != part:
                if part is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])
                part, total = p, np.zeros(len(x))
            total += x
    if part is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])


def _gram(bench: Bench, docs: DataFrame, test: np.ndarray) -> np.ndarray:
    """B such that B B' stands for the Gram matrix of the terms over all passages of ``docs``: G test (test' G test)^-1 test' G."""
    sums = docs.mapInArrow(_product(bench, test), "part int, task int, total binary").repartition(RANGES, "part").sortWithinPartitions("part", "task")
    found = sorted(sums.mapInArrow(_added, "part int, total binary").collect())
    total = np.concatenate([np.frombuffer(x, np.float64) for _, x in found]).reshape(test.shape) if found else np.zeros(test.shape)
    inner = test.T.astype(np.float64) @ total
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    good = values > 1e-6 * max(values.max(initial=0), 1e-12)
    return total @ (vectors[:, good] / np.sqrt(values[good]))


def _fit(bench: Bench, docs: DataFrame):
    """The leading right singular space of the passages of documents and benchmark, the benchmark counting most."""
    n_terms = len(bench.vocab)
    rank = min(max(RANK, len(bench.passages) * 5 // 4), n_terms)  # blocks are dealt by hash, some are larger
    rng = np.random.default_rng(7)
    basis = np.linalg.qr(rng.standard_normal((n_terms, rank)))[0].astype(np.float32)
    own = [(i, np.bincount(i, minlength=n_terms)[np.unique(i)] * bench.idf[np.unique(i)]) for _, i in bench.passages]
    own = [(np.unique(i), x) for i, x in own]
    root = _gram(bench, docs, basis)
    for _ in range(POWER):
        total = root @ (root.T @ basis)
        scale = np.linalg.norm(total)
        mine = np.zeros_like(total)
        for t, x in own:
            mine[t] += np.outer(x, x @ basis[t])
        strength = np.linalg.norm(mine)
        total = mine + total * (0.1 * strength / scale if scale > 0 else 0)
        basis = np.linalg.qr(total + 1e-9 * basis)[0].astype(np.float32)
    return basis


def _hits(bench: Bench, column: pa.Array):
    """(row, item, cosine, common share, answer share, first word) of the best candidate of each row and item that passes."""
    words, at = _words(column)
    terms = bench.terms(words)
    if not len(words) or not len(bench.vocab):
        return []
    known = np.where(terms >= 0, np.square(bench.idf)[terms], 0)
    mass = np.concatenate([[0], np.cumsum(known, dtype=np.float64)])
    odd = np.concatenate([[0], np.cumsum(terms < 0)])
    best: dict[tuple[int, int], tuple] = {}
    tried: dict[tuple[int, int, int], float] = {}
    for size, passages in bench.sizes.items():
        doc, first, last = _windows(terms, at, size, size // 2)
        mine, strange = mass[last] - mass[first], (odd[last] - odd[first]) * bench.strange ** 2
        # Repeated terms make the true share larger than this one, by their number at most; twice is ample here.
        may = np.flatnonzero(2 * mine >= COSINE ** 2 * (2 * mine + strange))
        queries = bench.queries[passages].T
        for s in range(0, len(may), 4096):
            w = may[s:s + 4096]
            x = _sums(bench.latent, terms, first[w], last[w])
            norm = np.sqrt(np.maximum(np.square(x).sum(1), mine[w]) + strange[w])
            cos = x @ queries / np.maximum(norm, 1e-9)[:, None]
            for i, q in zip(*np.nonzero(cos >= COSINE)):
                d, item = int(doc[w[i]]), bench.passages[passages[q]][0]
                n = len(bench.items[item])
                a = max(int(at[d]), int(first[w[i]]) - n)
                b = min(int(at[d + 1]), int(last[w[i]]) + n)
                if (d, item) in best and best[d, item][1] == 1.0:
                    continue
                step = max(1, n // 4)
                # The windows of a long item lie near each other: they share their starts.
                begin = a if n <= PASSAGE else int(at[d]) + (a - int(at[d])) // step * step
                for start in range(begin, max(begin + 1, b - n + 1), step):
                    share = tried.get((d, item, start))
                    if share is None:
                        share = tried[d, item, start] = bench.common(item, terms[start:min(start + n + n // 4, int(at[d + 1]))]) / n
                    if share >= COMMON:
                        ans = bench.answers[item]
                        told = float(np.isin(ans, terms[a:b]).mean()) if len(ans) else 1.0
                        if told >= ANSWER and ((d, item) not in best or best[d, item][1] < share):
                            best[d, item] = (float(cos[i, q]), share, told, start - int(at[d]))
    return [(d, item, *x) for (d, item), x in best.items()]


def _source(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """Items with answers, and the number of blocks that they make."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    src = benchmark.select(F.col("item_id").cast("bigint"), F.col("text"), answer.alias("answer")).where("text IS NOT NULL")
    n = src.agg(F.sum(F.ceil(F.size(F.split(F.trim("text"), r"\s+")) / PASSAGE))).first()[0] or 0
    return src, max(1, -(-n // ITEMS))


def blocks(docs: DataFrame, benchmark: DataFrame, text: str = "text"):
    """Fitted benchmark blocks of about ITEMS passages, one after the other, each with whether there may be more than one.

    Benchmark rows need item_id and text, and may have answer. Items without words match nothing and are left out;
    repeated items count as items of their own. The passages of one item stay together.
    """
    src, parts = _source(benchmark)
    d = docs.select(F.col(text).alias("text")).where("text IS NOT NULL")
    counts = None
    for p in range(parts):
        rows = sorted(src.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).collect(), key=str)
        rows = [r for r in rows if len(_words(pa.array([r[1]], pa.large_string()))[0])]
        if not rows:
            continue
        bench = Bench([r[0] for r in rows], [r[1] for r in rows], [r[2] or _sentence_tail(r[1]) for r in rows])
        counts = counts or Counts(d)
        df, strange = counts.of(bench.vocab)
        bench.weigh(df, counts.n_docs, strange)
        bench.project(_fit(bench, d))
        yield bench, parts > 1


def _over_blocks(docs: DataFrame, benchmark: DataFrame, text: str, found) -> DataFrame | None:
    """The union of ``found(block)`` over all blocks; with several, each is written before the next block is fitted,
    so that the driver and a task hold one block at a time."""
    out: list[DataFrame] = []
    for bench, several in blocks(docs, benchmark, text):
        out.append(C.cut(found(bench)) if several else found(bench))
        if len(out) == UNION:
            out = [C.cut(reduce(DataFrame.union, out))]
    return reduce(DataFrame.union, out) if out else None


def _found(bench: Bench):
    def run(batches):
        for batch in batches:
            for part in C.slices(batch, "text"):
                ids = part.column("doc_id").to_pylist()
                rows = [(ids[d], bench.ids[item], *x) for d, item, *x in _hits(bench, part.column("text"))]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*rows)) or [()] * 6, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()))], ["doc_id", "item_id", "cosine", "common", "answer", "first_word"])
    return run


LEAK = "doc_id bigint, item_id bigint, cosine double, common double, answer double, first_word bigint"


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, common, answer, first_word): each document and benchmark item found in it.

    Null and empty texts have no leak; an empty benchmark gives an empty result; rows of ``docs`` are judged one
    by one, so that repeated rows and null ids give rows of their own. Other columns play no part.
    """
    d = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    found = _over_blocks(docs, benchmark, text, lambda bench: d.mapInArrow(_found(bench), LEAK))
    return found if found is not None else docs.sparkSession.createDataFrame([], LEAK)


def _leaking(bench: Bench):
    def run(batches):
        for batch in batches:
            for part in C.slices(batch, "text"):
                yield part.select(["leak"]).take(pa.array(sorted({x[0] for x in _hits(bench, part.column("text"))}), pa.int64()))
    return run


def _clean(bench: Bench, name: str):
    def run(batches):
        for batch in batches:
            for part in C.slices(batch, name):
                keep = np.ones(part.num_rows, bool)
                keep[[x[0] for x in _hits(bench, part.column(name))]] = False
                yield part.filter(pa.array(keep))
    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents in which no benchmark item is found, with all their columns; null texts stay.

    One block filters the rows where they lie. Of several, each says which texts leak, by digest.
    """
    if _source(benchmark)[1] == 1:
        for bench, _ in blocks(docs, benchmark, text):
            return docs.mapInArrow(_clean(bench, text), docs.schema)
        return docs
    digest = F.sha2(F.col(text).cast("binary"), 256)
    d = docs.select(F.col(text).alias("text"), digest.alias("leak"))
    leaks = _over_blocks(docs, benchmark, text, lambda bench: d.mapInArrow(_leaking(bench), "leak string").distinct())
    return docs.join(leaks.select(F.col("leak").alias("_leak")).distinct(), digest == F.col("_leak"), "left_anti") if leaks is not None else docs
