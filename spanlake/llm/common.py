"""What the corpus operators share: table access, fixed token rules, splits, Arrow helpers and hashing of words."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bound_batches
from ..session import cut_lineage as cut  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc_split(doc_id: str | Column, mod: int, rest: int) -> Column:
    """True where crc32 of the id as text leaves ``rest``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % mod == rest


#: Bits that a filter has for each of its ids, and in all (64 MB travel with the tasks at most).
FILTER_BITS, FILTER_MOST, FILTER_ROW = 16, 1 << 29, 32_768


def mark_maybe(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """``rows`` and a column ``__maybe``, false only where ``column`` has no value of ``ids`` (one column of whole numbers).

    Each id sets a bit at its hash. A hit that is none only costs a row in the join that follows.
    """
    bits = min(max(1, ids.count() * FILTER_BITS), FILTER_MOST)
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("bigint")), F.lit(bits))
    table = ids.dropna().select(place(ids.columns[0]).alias("p")).groupBy(F.expr(f"p div {FILTER_ROW}").alias("__row")).agg(F.bitmap_construct_agg(F.expr(f"p % {FILTER_ROW}")).alias("__bits"))
    found = rows.withColumn("__p", place(column)).withColumn("__row", F.expr(f"__p div {FILTER_ROW}")).join(F.broadcast(table), "__row", "left")
    byte = f"cast(conv(hex(substring(__bits, cast(__p % {FILTER_ROW} div 8 + 1 AS int), 1)), 16, 10) AS int)"
    maybe = F.expr(f"`{column}` IS NOT NULL AND __bits IS NOT NULL AND (shiftright({byte}, cast(__p % 8 AS int)) & 1) = 1")
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], maybe.alias("__maybe"))


# --- Arrow -----------------------------------------------------------------

def slices(batch: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in row slices of about ``most`` bytes of text, so that numpy's working arrays stay small."""
    if not batch.num_rows:
        return
    lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts on end, and the offsets of each; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def whole_groups(batches, keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups only, from batches sorted by ``keys``; the last group of a batch waits for the next."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        change = np.zeros(t.num_rows, bool)
        for k in keys:
            v = t.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        at = np.flatnonzero(change)
        if len(at):
            yield t.slice(0, int(at[-1]))
            rest = t.slice(int(at[-1]))
        else:
            rest = t
    if rest is not None and rest.num_rows:
        yield rest


# --- hashing ---------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_PLACES = 64
_TABLE = np.random.default_rng(20240611).integers(0, 2**64, _PLACES * 256, np.uint64)
_ODD = np.random.default_rng(20240612).integers(0, 2**63, 16, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(z: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every bit of the input changes every bit of the output."""
    z = z ^ (z >> np.uint64(30))
    z = z * np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


#: White space and ASCII punctuation.
MARKS = _SPACE | np.array([chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for i in range(256)])


def word_hashes(raw: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased (A-Z) words of all texts, and the offsets of each text's words; bytes in ``apart`` stand between words.

    Tabulation hashing: one random number for each (byte, place in the word), summed over the word.
    """
    n_docs = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    solid = ~apart[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    counts = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    letters = _LOWERED[raw[solid]]
    begin = np.cumsum(lengths) - lengths
    place = np.arange(len(letters), dtype=np.int64) - np.repeat(begin, lengths)
    values = _TABLE[(place & (_PLACES - 1)) * 256 + letters]
    if lengths.max() > _PLACES:  # a long word: each further stretch counts with another factor
        values *= (place // _PLACES * 2 + 1).astype(np.uint64)
    return mix(np.add.reduceat(values, begin) + lengths.astype(np.uint64) * _ODD[15]), counts


def ngram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, over the ends of texts too."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n] * _ODD[0]
    for j in range(1, k):
        total += words[j:j + n] * _ODD[j]
    return mix(total + np.uint64(k))
