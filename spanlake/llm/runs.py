"""Periodic runs of words: stretches that repeat themselves with a period, found by seeds on diagonals.

A run of period q and at least max(12, 2q) words matches itself, shifted by q, over max(12 - q, q) words or more: the
overlap that is guaranteed. Lags are dealt into classes (1 to 7 one by one, then doubling). In a class with a
guaranteed overlap of m words, k-grams (k at most m) at every s-th place, k + s - 1 <= m, hit every run, so these are
looked up in the index of all k-grams of the document: each pair of equal k-grams whose distance is a lag of the
class is a seed on that lag's diagonal. Sorted by lag and place, a seed that starts within what its lag has
covered adds nothing but its end; the rest is extended to both sides. A seed meets at most as many partners
as the class has lags and seeds are half a lag apart, so a text of one word repeated costs a few seeds a word and class.

A stretch of a multiple of a run's period has the run's ends, so of equal ends the smallest period stays.
k-grams longer than one word are named by 64-bit hashes of two halves; words are compared as they are.
"""
from __future__ import annotations

import hashlib
import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

#: Shortest run in words; a run also holds its period twice.
LEAST = 12
#: Words of the shortest seed: the guaranteed overlap is LEAST // 2 or more for every period.
SEED = LEAST // 2
#: Bytes of text that are worked on at once; a longer text is alone.
SLICE = 1_000_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _classes(most: int):
    """(first lag, end, k, s) up to lag ``most``."""
    lo = 1
    while lo <= most:
        hi = lo + 1 if lo < 8 else 2 * lo
        m = max(LEAST - lo, lo) if lo < 8 else lo
        k = max(SEED, 1 << (m.bit_length() - 2))
        yield lo, hi, k, min(k, m - k + 1)
        lo = hi


class _Names:
    """Names of all stretches of 1, 2, 4, ... words; one that crosses the end of a text is like no other."""

    def __init__(self, codes: np.ndarray):
        self.n, self.levels = len(codes), [C.mix(codes.astype(np.uint64) + _A)]

    def _pair(self, x: np.ndarray, apart: int) -> np.ndarray:
        out = C.mix(~np.arange(self.n, dtype=np.uint64) * _B)
        if self.n > apart:
            out[:-apart] = C.mix(x[:-apart] * _A + x[apart:] * _B)
        return out

    def level(self, t: int) -> np.ndarray:
        while len(self.levels) <= t:
            self.levels.append(self._pair(self.levels[-1], 1 << (len(self.levels) - 1)))
        return self.levels[t]

    def grams(self, k: int) -> np.ndarray:
        t = k.bit_length() - 1
        return self.level(t) if k == 1 << t else self._pair(self.level(t), k - (1 << t))

    def extend(self, i: np.ndarray, j: np.ndarray, most: int, left: bool = False) -> np.ndarray:
        """Number of equal words, at most 2 ** bits of ``most`` - 1, from ``i`` and ``j`` on, or before them."""
        done = np.zeros(len(i), np.int64)
        for t in range(max(1, most.bit_length()) - 1, -1, -1):
            name, w = self.level(t), 1 << t
            a, b = (i - done - w, j - done - w) if left else (i + done, j + done)
            inside = (a >= 0) & (b < self.n)
            done += w * (inside & (name[np.maximum(a, 0)] == name[np.minimum(np.maximum(b, 0), self.n - 1)]))
        return done


def find_runs(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run, by text, start and period; ``codes`` are the words of all texts on end."""
    doc = np.repeat(np.arange(len(lengths)), lengths + 1)  # a mark of its own ends each text
    n, first = len(doc), np.cumsum(lengths + 1) - lengths - 1
    marked = np.empty(n, np.int64)
    ends = first + lengths
    marked[ends] = -1 - np.arange(len(lengths))
    inner = np.ones(n, bool)
    inner[ends] = False
    marked[inner] = codes
    names = _Names(marked)
    places, of, found = np.flatnonzero(inner), 0, []
    for lo, hi, k, s in _classes(int(lengths.max(initial=0)) // 2):
        if k != of:  # the index: places whose k-gram occurs again in the text
            of = k
            gram = names.grams(k)[places] + C.mix(doc[places].astype(np.uint64))
            order = np.argsort(gram, kind="stable")
            gram, places = gram[order], places[order]
            new = np.ones(len(gram), bool)
            new[1:] = gram[1:] != gram[:-1]
            group = np.cumsum(new) - 1
            again = np.bincount(group, minlength=1)[group] > 1 if len(group) else new
            key, by = group[again] * (n + 1) + places[again], places[again]
            places = np.sort(by)
        if not len(places):
            break
        at = np.flatnonzero(by % s == 0)
        base = key[at] - by[at]
        a = np.searchsorted(key, base + np.minimum(by[at] + lo, n))
        count = np.searchsorted(key, base + np.minimum(by[at] + hi, n)) - a
        i = np.repeat(by[at], count)
        if not len(i):
            continue
        j = by[np.repeat(a - (np.cumsum(count) - count), count) + np.arange(len(i))]
        same = doc[i] == doc[j]
        i, lag = i[same], (j - i)[same]
        order = np.lexsort((i, lag))
        i, lag = i[order], lag[order]
        fresh = np.ones(len(i), bool)
        fresh[1:] = (lag[1:] != lag[:-1]) | (i[1:] > i[:-1] + k)  # beyond what this lag has covered
        head = np.flatnonzero(fresh)
        if not len(head):
            continue
        q, start, end = lag[head], i[head], i[np.append(head[1:], len(i)) - 1] + k
        start = start - names.extend(start, start + q, s, left=True)
        end = end + names.extend(end, end + q, s)
        long = end + q - start >= np.maximum(LEAST, 2 * q)
        found.append(np.stack([start, end + q, q])[:, long])
    start, end, q = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    least = np.ones(len(q), bool)
    least[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[least], end[least], q[least]
    order = np.lexsort((q, start))
    start, end, q = start[order], end[order], q[order]
    return doc[start], start - first[doc[start]], end - start, q


def echo(n: int, doc_id: int | None) -> np.ndarray | None:
    """Places whose words a text of ``n`` words gets when its id's crc32 is divisible by 10; None where it stays as it is."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return places


def _rows(ids: list, texts: list, altered: bool):
    """One tuple a text: id, runs and the digests."""
    words = [(t or b"").split() for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    codes = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    at = np.append(0, np.cumsum(lengths))
    for d in range(len(words)) if altered else ():
        if (places := echo(len(words[d]), ids[d])) is not None:
            codes[at[d]:at[d + 1]] = codes[at[d]:at[d + 1]][places]
            w = words[d]
            words[d] = [w[p] for p in places.tolist()]
    doc, start, length, period = find_runs(codes, lengths)
    bounds = np.searchsorted(doc, np.arange(len(words) + 1))
    # words that a run repeats
    marks = np.zeros(at[-1] + 1, np.int64)
    np.add.at(marks, at[doc] + start + period, 1)
    np.add.at(marks, at[doc] + start + length, -1)
    kept = np.cumsum(marks[:-1]) == 0
    for d, w in enumerate(words):
        a, b = bounds[d], bounds[d + 1]
        if a == b:
            yield ids[d], [], hashlib.sha256(b" ".join(w)).hexdigest()
        else:
            runs = list(zip(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist()))
            yield ids[d], runs, hashlib.sha256(b" ".join(compress(w, kept[at[d]:at[d + 1]].tolist()))).hexdigest()


_TYPE = "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed_sha256 string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, altered: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, runs (start, length, period; by start, then period) and the hash of the text without repeats.

    A run is a stretch of words, white space apart, with smallest period q, of at least max(12, 2q) words, that no neighbouring
    word extends. The hashed text has the words that no run holds after its first q words, joined by one space. ``altered``
    repeats the end of every tenth text first (see :func:`echo`). A null or empty text has no run and the hash of the empty text; a
    null id stays null. Repeated rows are told about one by one; other columns are not read. Texts are whole, however long:
    one task holds one text and some 200 bytes for each word of it.
    """
    def work(batches):
        for batch in batches:
            for part in C.slices(batch, "text", SLICE):
                rows = list(_rows(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), altered))
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), x)) for x in r[1]] for r in rows], pa.list_(_RUN)),
                    pa.array([r[2] for r in rows], pa.string())], names=["doc_id", "runs", "collapsed_sha256"])

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(work, _TYPE)
