"""Language model scoring: bigram maximum-likelihood estimates mixed with unigrams by deleted interpolation.

P(w | v) = m(c(v)) * c(v, w) / c(v) + (1 - m(c(v))) * (c(w) + 0.5) / (N + 0.5 * (V + 1)): the weight m depends on
the bucket (powers of two) of the context's frequency. Weights are learned by expectation-maximisation on the
tokens of a deleted tenth of the training documents, against counts of the other nine tenths; scores then use
the counts of all training documents. A text's first token has the start of text as context.

Counting and look-up take one round trip. Documents are dealt into blocks by hash; a block sends its distinct
tokens and bigrams (64-bit hashes) with its own counts, packed, to the shards of the hash space; each shard adds
up and sends back totals in the order asked. So only packed arrays are shuffled, nothing is broadcast, and a
frequent word is one entry for each block. Texts travel compressed, and sorted hashes as differences.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import common as C

#: Bytes of text in a block, on average.
BLOCK = 4_000_000
#: One training document in so many is deleted for the mixture weights.
DELETED = 10
EM_ROUNDS, FINE, FLOOR = 60, 8, -64
_END, _BEGIN = np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B)


def _shrink(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _grow(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)


PACKED = "block bigint, texts binary, sizes binary, ids binary, flags binary"


def _packed(batches):
    """Texts by block: one row for each block that a slice of the input has rows of. Flags: 1 training, 2 deleted, 4 without id."""
    for batch in batches:
        for part in C.slices(batch, "text", 32_000_000):
            block = part.column("block").to_numpy()
            order = np.argsort(block, kind="stable")
            part = part.take(pa.array(order))
            block = block[order]
            raw, off = C.text_bytes(part.column("text"))
            train, deleted = (part.column(c).to_numpy(zero_copy_only=False).astype(np.uint8) for c in ("train", "deleted"))
            missing = part.column("doc_id").is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            flags = train + 2 * deleted + 4 * missing
            ids = part.column("doc_id").fill_null(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
            rows = [(int(block[a]), _shrink(raw[off[a]:off[b]].tobytes()), np.diff(off[a:b + 1]).tobytes(), ids[a:b].tobytes(), flags[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), *[pa.binary()] * 4))], ["block", "texts", "sizes", "ids", "flags"])


def _unpacked(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of a block's texts, ids and flags, in an order that does not depend on the shuffle's."""
    rows = sorted(zip(*(t.column(c).to_pylist() for c in ("ids", "sizes", "flags", "texts"))))
    whole = lambda i, kind: np.frombuffer(b"".join(r[i] for r in rows), kind)
    raw = np.frombuffer(b"".join(_grow(r[3]) for r in rows), np.uint8)
    return raw, np.concatenate([[0], np.cumsum(whole(1, np.int64))]), whole(0, np.int64), whole(2, np.uint8)


def _tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts (words, then one end each), their bigrams with the token before, and each text's offsets."""
    words, at = C.word_hashes(raw, offsets)
    off = at + np.arange(len(at))
    tok = np.full(off[-1], _END)
    tok[np.arange(len(words)) + np.repeat(np.arange(len(at) - 1), np.diff(at))] = words
    before = np.empty_like(tok)
    before[1:] = tok[:-1]
    before[off[:-1]] = _BEGIN
    return tok, C.mix(before * C._ODD[3] + tok * C._ODD[4]), off


def _pack(counts: np.ndarray) -> bytes:
    """Counts as bytes, those of 255 and more behind them."""
    large = counts[counts >= 255].astype(np.int64)
    return zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes() + large.tobytes(), 1)


def _unpack(blob: bytes, n: int) -> np.ndarray:
    raw = zlib.decompress(blob)
    out = np.frombuffer(raw[:n], np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(raw[n:], np.int64)
    return out


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences of six bytes, those that need more behind them."""
    step = np.diff(keys, prepend=np.uint64(0))
    large = step >= np.uint64(1 << 48) - np.uint64(1)
    out = np.where(large, np.uint64((1 << 48) - 1), step)
    return out.view(np.uint8).reshape(-1, 8)[:, :6].tobytes() + step[large].tobytes()


def _unpack_keys(blob: bytes, n: int) -> np.ndarray:
    step = np.zeros((n, 8), np.uint8)
    step[:, :6] = np.frombuffer(blob[:6 * n], np.uint8).reshape(n, 6)
    step = step.view(np.uint64).ravel()
    step[step == np.uint64((1 << 48) - 1)] = np.frombuffer(blob[6 * n:], np.uint64)
    return np.cumsum(step, dtype=np.uint64)


def _shares(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins in sorted keys."""
    shard = ((keys >> np.uint64(40)) * np.uint64(shards)) >> np.uint64(24)
    return np.searchsorted(shard, np.arange(shards + 1))


def _asked(shards: int):
    names = ["shard", "block", "kind", "n", "keys", "counts", "kept"]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches):
        for t in C.whole_groups(batches, ["block"]):
            block = t.column("block").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
            for a, b in zip(cuts, cuts[1:]):
                raw, offsets, _, flags = _unpacked(t.slice(a, b - a))
                tok, bi, off = _tokens(raw, offsets)
                flags = np.repeat(flags, np.diff(off))
                train = flags & 1 > 0
                kept = train & (flags & 2 == 0)
                for kind, keys in enumerate((tok, bi)):
                    distinct, at = np.unique(keys, return_inverse=True)
                    counts = np.bincount(at[train], minlength=len(distinct))
                    mine = np.bincount(at[kept], minlength=len(distinct))
                    cut = _shares(distinct, shards)
                    rows = [(s, int(block[a]), kind, y - x, _pack_keys(distinct[x:y]), _pack(counts[x:y]), _pack(mine[x:y])) for s, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t_) for c, t_ in zip(zip(*rows), types)], names)
    return run


def _totals(batches):
    """For each request the totals in its order; for each shard (block -1) its distinct and all tokens, of both counts."""
    names = ["block", "kind", "shard", "counts", "kept"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    for t in C.whole_groups(batches, ["shard", "kind"]):
        shard, kind, block = (t.column(x).to_numpy() for x in ("shard", "kind", "block"))
        cuts = np.concatenate([[0], np.flatnonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1, [len(shard)]])
        for a, b in zip(cuts, cuts[1:]):
            part = t.slice(a, b - a)
            keys = [_unpack_keys(x, n) for x, n in zip(part.column("keys").to_pylist(), part.column("n").to_pylist())]
            off = np.cumsum([0, *map(len, keys)])
            distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
            both = []
            for name in ("counts", "kept"):
                own = np.concatenate([_unpack(x, len(k)) for x, k in zip(part.column(name).to_pylist(), keys)])
                both.append(np.bincount(at, own, minlength=len(distinct)).astype(np.int64))
            rows = [(int(block[a + i]), int(kind[a]), int(shard[a]), *(_pack(x[at[off[i]:off[i + 1]]]) for x in both)) for i in range(b - a)]
            if kind[a] == 0:
                rows.append((-1, 0, int(shard[a]), *(np.array([(x > 0).sum(), x.sum()], np.int64).tobytes() for x in both)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t_) for c, t_ in zip(zip(*rows), types)], names)


def _looked_up(part: pa.Table, counts: pa.Table, shards: int, name: str):
    """Token counts, bigram counts and context counts of every token of a block, the texts' offsets, ids and flags."""
    raw, offsets, ids, flags = _unpacked(part)
    tok, bi, off = _tokens(raw, offsets)
    rows = {}
    for kind, shard, blob in zip(counts.column("kind").to_pylist(), counts.column("shard").to_pylist(), counts.column(name).to_pylist()):
        rows[kind, shard] = blob
    found = []
    for kind, keys in enumerate((tok, bi)):
        distinct, at = np.unique(keys, return_inverse=True)
        cut = _shares(distinct, shards)
        found.append(np.concatenate([_unpack(rows[kind, s], y - x) for s, (x, y) in enumerate(zip(cut, cut[1:])) if y > x])[at])
    context = np.empty_like(found[0])
    context[1:] = found[0][:-1]
    context[off[:-1]] = found[0][off[1:] - 1]  # texts begin as often as they end
    return found[0], found[1], context, off, ids, flags


def _buckets(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0)


def _held(shards: int, n: int, v: int):
    """Counts of deleted tokens by context bucket and by the ratio of the two estimates, on a fine logarithmic scale."""
    def run(key, left, right):
        c, pair, context, *_ = _looked_up(left, right, shards, "kept")
        ok = context > 0
        uni = (c[ok] + 0.5) / (n + 0.5 * (v + 1))
        ratio = pair[ok] / context[ok] / uni
        step = np.where(ratio > 0, np.maximum(np.round(np.log2(np.maximum(ratio, 1e-30)) * FINE), FLOOR * FINE + 1), FLOOR * FINE).astype(np.int64)
        cells, times = np.unique(_buckets(context[ok]) * (1 << 20) + step - FLOOR * FINE, return_counts=True)
        return pa.table({"bucket": pa.array(cells >> 20), "step": pa.array((cells & ((1 << 20) - 1)) + FLOOR * FINE), "n": pa.array(times)})
    return run


def learn_weights(rows: list[tuple[int, int, int]]) -> np.ndarray:
    """Weight of the bigram estimate for each context bucket, by expectation-maximisation over (bucket, step, n)."""
    weights = np.zeros(65)
    for bucket in {r[0] for r in rows}:
        step = np.array([r[1] for r in rows if r[0] == bucket])
        n = np.array([r[2] for r in rows if r[0] == bucket], float)
        ratio = np.where(step > FLOOR * FINE, np.exp2(step / FINE), 0)
        m = 0.5
        for _ in range(EM_ROUNDS):
            m = (n * m * ratio / (m * ratio + 1 - m)).sum() / n.sum()
            m = min(max(m, 1e-6), 1 - 1e-6)
        weights[bucket] = m
    return weights


def _scores(shards: int, n: int, v: int, weights: np.ndarray):
    def run(key, left, right):
        c, pair, context, off, ids, flags = _looked_up(left, right, shards, "counts")
        uni = (c + 0.5) / (n + 0.5 * (v + 1))
        m = weights[np.minimum(_buckets(context), 64)]
        p = m * pair / np.maximum(context, 1) + (1 - m) * uni
        add = lambda x: np.add.reduceat(x, off[:-1])  # noqa: E731  every text has its end
        return pa.table({"doc_id": pa.array(ids, mask=flags & 4 > 0), "n_tokens": pa.array(np.diff(off)), "n_known": pa.array(add((c > 0).astype(np.int64))),
                         "train_tokens": pa.array(np.full(len(off) - 1, n)), "base_score": pa.array(add(np.log10(uni))), "score": pa.array(add(np.log10(p)))})
    return run


def score_texts(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    ``train`` says which rows the model learns from. A null text counts as empty, one end token. Without
    training rows all counts are zero and both scores are those of unknown tokens. Repeated rows count as often
    as they occur; other columns play no part; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-size // block))
    shards = max(1, blocks // 4)
    d = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    h = F.xxhash64("doc_id", "text")
    d = d.withColumn("deleted", F.col("train") & (F.pmod(F.xxhash64(F.col("text"), F.lit(5)), F.lit(DELETED)) == 0))
    # Deleted documents have blocks of their own, which can be looked up alone; copies are deleted together.
    d = d.withColumn("block", F.when(F.col("deleted"), blocks + F.pmod(h, F.lit(-(-blocks // DELETED)))).otherwise(F.pmod(h, F.lit(blocks))).cast("bigint"))
    packed = d.mapInArrow(_packed, PACKED)
    asked = (packed.repartition("block").sortWithinPartitions("block")
             .mapInArrow(_asked(shards), "shard int, block bigint, kind int, n bigint, keys binary, counts binary, kept binary"))
    counts = cut_lineage(asked.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_totals, "block bigint, kind int, shard int, counts binary, kept binary"))
    stats = {name: np.zeros(2, np.int64) for name in ("counts", "kept")}
    for r in counts.where("block < 0").select(*stats).collect():
        for name in stats:
            stats[name] += np.frombuffer(r[name], np.int64)
    (v, n), (v_kept, n_kept) = (map(int, stats[x]) for x in ("counts", "kept"))

    rows = (d.where("deleted").mapInArrow(_packed, PACKED).groupBy("block").cogroup(counts.where(F.col("block") >= blocks).groupBy("block"))
            .applyInArrow(_held(shards, n_kept, v_kept), "bucket bigint, step bigint, n bigint").groupBy("bucket", "step").agg(F.sum("n")).collect())
    weights = learn_weights([tuple(r) for r in rows])
    return (packed.groupBy("block").cogroup(counts.where("block >= 0").groupBy("block"))
            .applyInArrow(_scores(shards, n, v, weights), "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"))
