"""Exact Jaccard join of word-shingle sets, by set relations.

Every set is cut, by hash value, into so many blocks that two sets which link have at least one block in
common (they differ in at most H elements, and a differing element spoils one block). The blocks of a sorted
set are runs at known positions, so an index list holds only sets that agree on a whole block, and all other
lists are skipped at once. Sizes fall into levels; a set is listed on its own level and on the next, where all
sets that are as large as it may link to are found.

Blocks that hold nothing but common shingles (those of shared passages and set phrases, known from a bounded
sample) are skipped as well, as long as a set has too few of them to be all that a partner might agree on;
a set made of common shingles lists all its blocks. Either way no link is lost, whatever the sample says.

A list links its members with its smallest id, and a task keeps of the links of all its lists a spanning forest. Sets
joined this way form candidate clusters, in which
answers are derived incrementally: one set's overlaps with all others are counted, its partners share its
component without further counting, and for each partner only those sets are looked at that its distance to
the first set leaves possible (triangle inequality). Copies of one set are one set. The sets of a cluster too large for
one task are first listed again by their rarest blocks, so that passages do not hold together what has little else in common.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import common as C
from .graph import connected_components

#: Shingles that one group of candidate sets may hold; larger clusters are dealt out in chunks.
CHUNK = 2_000_000
#: Bytes of index entries in a shard. A task takes shard after shard; there are TASKS tasks a core of the cluster, whatever the number of shards,
#: and each gives out a set's link once, as long as its forest has no more than FOREST links.
SHARD, TASKS, FOREST = 12_000_000, 4, 4_000_000
#: Entries of the second index that a task holds before it gives them out, packed by shard.
HOLD = 1_000_000
#: Expected documents of the sample for common shingles, the parts it is counted in, how many of a part's documents
#: must hold a shingle and how many in all, and how many shingles are kept.
COMMON_DOCS, COMMON_PARTS, COMMON_TWICE, COMMON_LEAST, COMMON_MOST = 32_000, 8, 2, 3, 400_000


# --- sets ------------------------------------------------------------------

def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts on end, and the offsets of each text's.

    A text of fewer than ``k`` words is one shingle, the whole sequence; without words it is the empty set.
    """
    words, at = C.word_hashes(raw, offsets)
    n_words = np.diff(at)
    grams = C.ngram_hashes(words, k)
    sizes = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    off = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.empty(off[-1], np.uint64)
    for i in range(len(n_words)):
        if n_words[i] >= k:
            part = flat[off[i]:off[i + 1]]
            part[:] = grams[at[i]:at[i + 1] - k + 1]
            part.sort()
        elif n_words[i]:
            flat[off[i]] = C.ngram_hashes(words[at[i]:at[i + 1]], int(n_words[i]))[0]
    keep = np.ones(len(flat), bool)
    keep[1:] = flat[1:] != flat[:-1]
    keep[off[:-1][sizes > 0]] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    return flat[keep], before[off]


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    running = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return running[off[1:]] - running[off[:-1]]


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _described(k: int):
    """(doc_id, n_shingles, s1, s2): two sums of 64-bit hashes stand for the set."""
    def run(batches):
        for batch in batches:
            for part in C.slices(batch, "text"):
                flat, off = shingle_sets(*C.text_bytes(part.column("text")), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(off)), _signed(_sums(flat, off)), _signed(_sums(C.mix(flat ^ np.uint64(0x5851F42D4C957F2D)), off))],
                    ["doc_id", "n_shingles", "s1", "s2"])
    return run


# --- index lists -----------------------------------------------------------

class Levels:
    """Size levels and their numbers of blocks for the threshold num/den."""

    def __init__(self, num: int, den: int, most: int):
        lower = [1]
        while lower[-1] <= most:
            lower.append(lower[-1] * den // num + 1)
        lower.append(lower[-1] * den // num + 1)
        lower.append(lower[-1] * den // num + 1)
        self.lower = np.array(lower)
        largest = self.lower[1:] - 1
        self.differ = 2 * largest * (den - num) // (den + num)
        # With fewer than about six elements in a block many are empty, and more blocks are needed.
        self.blocks = np.where(self.differ > 0, self.differ + 1 + (self.differ // 8 if 6 * (den - num) * 2 < den + num else 2 * self.differ // 5), 0)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lower, sizes, "right") - 1


def block_keys(flat: np.ndarray, off: np.ndarray, levels: Levels, common: np.ndarray = np.zeros(0, np.uint64)) -> tuple[np.ndarray, np.ndarray]:
    """One key for each block of each set on both its levels, and the number of its set.

    Sets that link agree on at least blocks - differ blocks. So blocks of common shingles alone count only for
    sets with that many idle (such or empty) blocks, and empty ones only for sets with that many of them.
    """
    found = list(_leveled(flat, off, levels, common))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _leveled(flat: np.ndarray, off: np.ndarray, levels: Levels, common: np.ndarray = np.zeros(0, np.uint64)):
    """For both levels: the keys, the number of each key's set, and how many more of a set's keys may be left out, if it is by an order of keys that all sets share."""
    plain = np.ones(len(flat), bool)
    if len(common):
        plain = common[np.minimum(np.searchsorted(common, flat), len(common) - 1)] != flat
    sizes = np.diff(off)
    mixed = C.mix(flat ^ np.uint64(0x2545F4914F6CDD1D))
    set_of = np.repeat(np.arange(len(sizes)), sizes)
    for up in (0, 1):
        level = np.where(sizes > 0, levels.of(np.maximum(sizes, 1)) + up, 0)
        blocks = np.where(sizes > 0, levels.blocks[level], 0)
        if not blocks.any():
            continue
        of = blocks[set_of]
        inside = of > 0
        owner, n_blocks = set_of[inside], of[inside].astype(np.uint64)
        block = ((flat[inside] >> np.uint64(32)) * n_blocks) >> np.uint64(32)
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])
        at = np.flatnonzero(new)
        if not len(at):
            continue
        own, blk = owner[at], block[at]
        place = level[own].astype(np.uint64) * np.uint64(1 << 40) + blk
        told = np.logical_or.reduceat(plain[inside], at)
        idle = blocks - np.bincount(own[told], minlength=len(sizes))
        told |= (idle >= blocks - levels.differ[level])[own]
        keys, owners = [C.mix(np.add.reduceat(mixed[inside], at) + C.mix(place))[told]], [own[told]]
        empty = blocks - np.bincount(own, minlength=len(sizes))
        for i in np.flatnonzero((blocks > 0) & (empty >= blocks - levels.differ[level])):
            there = np.setdiff1d(np.arange(blocks[i]), blk[own == i].astype(np.int64))
            keys.append(C.mix(C.mix(np.uint64(level[i] * (1 << 40)) + there.astype(np.uint64))))
            owners.append(np.full(len(there), i))
        listed = np.concatenate(owners)
        yield np.concatenate(keys), listed, np.maximum(np.bincount(listed, minlength=len(sizes)) - levels.differ[level] - 1, 0)


def _listed(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first position of each key, the smallest id listed under it, and distinct links (id, smallest id) of its other ids."""
    if not len(keys):
        return np.zeros(0, np.int64), ids[:0], np.zeros((0, 2), np.int64)
    order = np.argsort(keys)
    head = np.ones(len(keys), bool)
    head[1:] = np.diff(keys[order]) != 0
    d = ids[order]
    at = np.flatnonzero(head)
    least = np.minimum.reduceat(d, at)
    pivot = np.repeat(least, np.diff(np.append(at, len(d))))
    other = d != pivot
    return order[at], least, _distinct(d[other], pivot[other])


def _distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    order = np.lexsort((b, a))
    both = np.stack([a[order], b[order]], 1)
    return both[np.append(True, (both[1:] != both[:-1]).any(1))] if len(both) else both


def _frequent(k: int):
    def run(batches):
        sets = [shingle_sets(*C.text_bytes(part.column("text")), k)[0] for batch in batches for part in C.slices(batch, "text")]
        if sets:
            found, n = np.unique(np.concatenate(sets), return_counts=True)
            again = n >= COMMON_TWICE
            yield pa.RecordBatch.from_arrays([_signed(found[again]), pa.array(n[again])], ["shingle", "n"])
    return run


def common_shingles(docs: DataFrame, k: int, n_docs: int) -> np.ndarray:
    """The most frequent shingles of a bounded sample of ``docs`` (doc_id, text), at most COMMON_MOST, sorted.

    Of each part of the sample only shingles that it holds more than once are counted on.
    """
    part = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n_docs // COMMON_DOCS))) == 0
    rows = (docs.where(part).repartition(COMMON_PARTS).mapInArrow(_frequent(k), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= COMMON_LEAST).orderBy(F.desc("n"), "shingle").limit(COMMON_MOST).select("shingle").toArrow())
    return np.sort(rows.column(0).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def _entries(k: int, num: int, den: int, most: int, shards: int, common: np.ndarray):
    """Index entries of sets (named by their first sum, so that copies are one), packed by shard; lists met twice here are already links."""
    def run(batches):
        levels = Levels(num, den, most)
        for batch in batches:
            for part in C.slices(batch, "text"):
                flat, off = shingle_sets(*C.text_bytes(part.column("text")), k)
                keys, owner = block_keys(flat, off, levels, common)
                first, ids, links = _listed(keys, _sums(flat, off).view(np.int64)[owner])
                order = np.argsort(first)  # entries of a text stay together, which packs well
                keys, ids = keys[first[order]], ids[order]
                rows = _listings(keys, ids, shards)
                if len(links):
                    rows.append((int(links[0, 0]) % shards, True, links[:, 0].tobytes(), b"", links[:, 1].tobytes(), b""))
                yield from _batch(rows, pa.int32(), pa.bool_(), *[pa.binary()] * 4, names=["shard", "done", "low", "high", "ids", "place"])
    return run


def _batch(rows: list, *types, names: list[str]):
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)


def _dealt(part: np.ndarray, parts: int):
    """The numbers of parts that have rows, and which rows."""
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    for s in np.flatnonzero(np.diff(cut)):
        yield int(s), order[cut[s]:cut[s + 1]]


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(48)) * np.uint64(shards)) >> np.uint64(16)


def _listings(keys: np.ndarray, ids: np.ndarray, shards: int) -> list[tuple]:
    """Index entries packed by shard, as ``_linked`` reads them."""
    rows = []
    for s, mine in _dealt(_shard(keys, shards), shards):
        own, named = keys[mine], np.unique(ids[mine], return_inverse=True)
        rows.append((s, False, (own & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), ((own >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16).tobytes(),
                     named[0].tobytes(), named[1].astype(np.uint16 if len(named[0]) < 1 << 16 else np.uint32).tobytes()))
    return rows


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of every set but the smallest of each component to that smallest one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while len(u):
        x, y = root[u], root[v]
        apart = x != y
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


class Links:
    """Links gathered by a task, kept as a forest; one that outgrows ``most`` is given out and begun anew."""

    def __init__(self, most: int):
        self.most, self.a, self.b, self.fresh = most, [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray):
        self.a.append(a)
        self.b.append(b)
        self.fresh += len(a)
        if self.fresh > self.most:
            yield from self.flush(self.most // 2)

    def flush(self, least: int = -1):
        if self.a:
            a, b = forest(np.concatenate(self.a), np.concatenate(self.b))
            self.a, self.b, self.fresh = [a], [b], len(a)
            if len(a) > least:
                self.a, self.b, self.fresh = [], [], 0
                for i in range(0, len(a), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(a[i:i + 50_000]), pa.array(b[i:i + 50_000])], ["a", "b"])


def _linked(most: int):
    """Lists of a partition's shards, one shard after the other, as links of a forest over the sets of all its lists."""
    def run(batches):
        links = Links(most)
        shard, keys, ids = None, [], []

        def listed():
            if keys:
                found = _listed(np.concatenate(keys), np.concatenate(ids))[2]
                keys.clear()
                ids.clear()
                yield from links.add(found[:, 0], found[:, 1])

        for batch in batches:
            for s, done, x, y, z, at in zip(*(c.to_pylist() for c in batch.columns)):
                if s != shard:
                    yield from listed()
                    shard = s
                if done:
                    yield from links.add(np.frombuffer(x, np.int64), np.frombuffer(z, np.int64))
                else:
                    own = np.frombuffer(y, np.uint16).astype(np.uint64) << np.uint64(32)
                    own |= np.frombuffer(x, np.uint32)
                    keys.append(own)
                    sets = np.frombuffer(z, np.int64)
                    ids.append(sets[np.frombuffer(at, np.uint16 if len(sets) < 1 << 16 else np.uint32)])
        yield from listed()
        yield from links.flush()
    return run


# --- clusters too large to compare -----------------------------------------

#: Columns of the second index: block keys, their sets, twice the number of keys that may be left out (plus one on the upper level), lengths of lists.
KINDS = {"key": np.uint64, "id": np.int64, "spare": np.int32, "n": np.int32}


def _held(parts: int, part_of, names: list[str], pieces):
    """Arrays of entries, held until they are HOLD long, as one row for each part."""
    held, size = [], 0

    def rows():
        columns = [np.concatenate(x).astype(KINDS[n]) for n, x in zip(names, zip(*held))]
        out = [(s, *[c[mine].tobytes() for c in columns]) for s, mine in _dealt(part_of(columns), parts)]
        yield from _batch(out, pa.int32(), *[pa.binary()] * len(names), names=["part", *names])

    for piece in pieces:
        held.append(piece)
        size += len(piece[0])
        if size > HOLD:
            yield from rows()
            held, size = [], 0
    if size:
        yield from rows()


def _parts(batches, names: list[str]):
    """The arrays of one part after the other, from batches sorted by part."""
    at, held = None, []
    for batch in batches:
        for s, *row in zip(*(batch.column(n).to_pylist() for n in ["part", *names])):
            if s != at and held:
                yield [np.concatenate(x) for x in zip(*held)]
                held = []
            at = s
            held.append([np.frombuffer(x, KINDS[n]) for n, x in zip(names, row)])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _whole_index(k: int, num: int, den: int, most: int, shards: int):
    """All blocks of all sets."""
    def run(batches):
        levels = Levels(num, den, most)

        def pieces():
            for batch in batches:
                for part in C.slices(batch, "text"):
                    flat, off = shingle_sets(*C.text_bytes(part.column("text")), k)
                    ids = _sums(flat, off).view(np.int64)
                    for up, (keys, owner, spare) in enumerate(_leveled(flat, off, levels)):
                        yield keys, ids[owner], spare[owner] * 2 + up

        yield from _held(shards, lambda c: _shard(c[0], shards), ["key", "id", "spare"], pieces())
    return run


def _lengths(shards: int):
    """Blocks that several sets have, with their number, by set."""
    def run(batches):
        def pieces():
            for key, of, spare in _parts(batches, ["key", "id", "spare"]):
                order = np.lexsort((of, key))
                key, of, spare = key[order], of[order], spare[order]
                new = np.append(True, (key[1:] != key[:-1]) | (of[1:] != of[:-1]))
                key, of, spare = key[new], of[new], spare[new]
                at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                n = np.repeat(np.diff(np.append(at, len(key))), np.diff(np.append(at, len(key))))
                if (n > 1).any():
                    yield key[n > 1], of[n > 1], spare[n > 1], n[n > 1]

        yield from _held(shards, lambda c: C.mix(c[1].view(np.uint64)) % np.uint64(shards), ["key", "id", "spare", "n"], pieces())
    return run


def _rarest(shards: int):
    """Index entries less those of each set's longest lists, as many as it may leave out."""
    def run(batches):
        for key, of, spare, n in _parts(batches, ["key", "id", "spare", "n"]):
            order = np.lexsort((key, -n, spare, of))
            key, of, spare = key[order], of[order], spare[order]
            at = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (spare[1:] != spare[:-1])))
            rank = np.arange(len(key)) - np.repeat(at, np.diff(np.append(at, len(key))))
            kept = rank >= spare // 2
            yield from _batch(_listings(key[kept], of[kept], shards), pa.int32(), pa.bool_(), *[pa.binary()] * 4, names=["shard", "done", "low", "high", "ids", "place"])
    return run


def _rare_lists(texts: DataFrame, k: int, num: int, den: int, most: int, shards: int, tasks: int) -> DataFrame:
    """Links (a, b) of sets by their rarest blocks.

    Sets that link agree on blocks - differ blocks at least, so each may leave out one less than that, if all leave out
    the most frequent first: of the blocks two sets agree on, the rarest is left to both. What is left out are the
    blocks of shared passages, by which sets hang together that have little else in common.
    """
    def dealt(rows, by):
        return rows.repartition(tasks, by).sortWithinPartitions(by)

    index = texts.mapInArrow(_whole_index(k, num, den, most, shards), "part int, key binary, id binary, spare binary")
    shared = dealt(index, "part").mapInArrow(_lengths(shards), "part int, key binary, id binary, spare binary, n binary")
    rare = dealt(shared, "part").mapInArrow(_rarest(shards), "shard int, done boolean, low binary, high binary, ids binary, place binary")
    return dealt(rare, "shard").mapInArrow(_linked(FOREST), "a bigint, b bigint").distinct()


# --- answers ---------------------------------------------------------------

def link_sets(flat: np.ndarray, off: np.ndarray, num: int, den: int) -> np.ndarray:
    """The component (as the number of its first set) of every set, given sorted distinct elements."""
    sizes, m = np.diff(off), len(off) - 1
    label = np.full(m, -1)
    words, cols = np.unique(flat, return_inverse=True)
    mark = np.zeros(len(words), bool)
    open_ = np.flatnonzero(sizes > 0)
    label[sizes == 0] = np.flatnonzero(sizes == 0)

    def overlaps(s: int, others: np.ndarray) -> np.ndarray:
        own = cols[off[s]:off[s + 1]]
        mark[own] = True
        lengths = sizes[others]
        begin = np.cumsum(lengths) - lengths
        take = np.arange(lengths.sum()) + np.repeat(off[others] - begin, lengths)
        out = np.add.reduceat(mark[cols[take]], begin, dtype=np.int64)
        mark[own] = False
        return out

    while len(open_):
        root, open_ = open_[0], open_[1:]
        label[root] = root
        far = np.full(m, np.nan)  # distance to the root, where it was counted
        todo = [root]
        while todo and len(open_):
            s = todo.pop()
            may = (sizes[open_] * den >= num * sizes[s]) & (sizes[s] * den >= num * sizes[open_])
            if s != root:
                may &= ~(far[open_] - far[s] > 1 - num / den + 1e-9)
            near = open_[may]
            if not len(near):
                continue
            both = overlaps(s, near)
            union = sizes[near] + sizes[s] - both
            if s == root:
                far[near] = 1 - both / union
            hit = near[both * den >= num * union]
            label[hit] = root
            todo += hit.tolist()
            open_ = open_[label[open_] < 0]
    return label


def _answers(k: int, num: int, den: int):
    def run(batches):
        for t in C.whole_groups(batches, ["cluster", "chunk"]):
            c, h, ids = (t.column(x).to_numpy() for x in ("cluster", "chunk", "node"))
            parts = [shingle_sets(*C.text_bytes(part.column("text")), k) for batch in t.to_batches() for part in C.slices(batch, "text")]
            flat, off = np.concatenate([f for f, _ in parts]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, o in parts]))])
            cuts = np.concatenate([[0], np.flatnonzero((c[1:] != c[:-1]) | (h[1:] != h[:-1])) + 1, [len(c)]])
            top = np.empty(len(c), np.int64)
            for a, b in zip(cuts, cuts[1:]):
                label = link_sets(flat[off[a]:off[b]], off[a:b + 1] - off[a], num, den)
                least = np.full(b - a, np.iinfo(np.int64).max)
                np.minimum.at(least, label, ids[a:b])
                top[a:b] = least[label]
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(ids), pa.array(top)], ["cluster", "node", "top"])
    return run


def _verified(members: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    texts = C.mark_maybe(texts, "node", members.select("node")).where("__maybe")  # the others' texts are not shuffled
    rows = members.join(texts, "node").select("cluster", "chunk", "node", "text")
    return rows.repartition("cluster", "chunk").sortWithinPartitions("cluster", "chunk").mapInArrow(_answers(k, num, den), "cluster bigint, node bigint, top bigint")


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id.

    Documents link when den * |A & B| >= num * |A | B| for their sets of ``k``-word shingles; component_id is
    the smallest id that links lead to. Null, empty and blank texts have the empty set and no link. A row with
    a null id is returned with a null component. Rows that share an id are one document with several texts.
    Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    d = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    sets = cut_lineage(d.mapInArrow(_described(k), "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint"))
    real = sets.where("doc_id IS NOT NULL AND n_shingles > 0")
    shape = ["n_shingles", "s1", "s2"]
    first = real.groupBy(*shape).agg(F.min("doc_id").alias("node"))
    owners = cut_lineage(real.distinct().join(first, shape).select("doc_id", "n_shingles", "s1", "node"))

    most, total, n_docs = sets.agg(F.coalesce(F.max("n_shingles"), F.lit(1)), F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count("*")).first()
    levels = Levels(num, den, most)
    shards = max(1, -(-int(total * 3 * levels.blocks[-1] / levels.lower[-1]) * 8 // SHARD))  # about three times a level's blocks for two levels
    d = d.where("doc_id IS NOT NULL")
    entries = d.mapInArrow(_entries(k, num, den, most, shards, common_shingles(d, k, n_docs)), "shard int, done boolean, low binary, high binary, ids binary, place binary")
    tasks = min(shards, TASKS * docs.sparkSession.sparkContext.defaultParallelism)
    lists = entries.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(_linked(FOREST), "a bigint, b bigint").distinct()
    to = owners.groupBy("s1").agg(F.min("node").alias("node"))
    sizes = owners.groupBy("node").agg(F.max("n_shingles").alias("n"))

    def sized_clusters(lists, nodes=None):
        pairs = (lists.join(to.select(F.col("s1").alias("a"), F.col("node").alias("x")), "a")
                 .join(to.select(F.col("s1").alias("b"), F.col("node").alias("y")), "b").where("x <> y").select("x", "y"))
        if nodes is not None:
            pairs = pairs.join(nodes.select(F.col("node").alias("x")), "x", "left_semi").join(nodes.select(F.col("node").alias("y")), "y", "left_semi")
        sized = connected_components(pairs, "x", "y").withColumnRenamed("component", "cluster").join(sizes, "node")
        dealt = sized.groupBy("cluster").agg(F.ceil(F.sum("n") / chunk).alias("chunks"))
        return cut_lineage(sized.join(dealt, "cluster").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks"))))

    sized = sized_clusters(lists)
    wide = sized.where("chunks > 1")
    held = wide.agg(F.sum("n")).first()[0]
    if held:  # these are split by their sets' rarest blocks
        shards = max(1, -(-int(held * 3 * levels.blocks[-1] / levels.lower[-1]) * 20 // SHARD))
        tasks = min(shards, TASKS * docs.sparkSession.sparkContext.defaultParallelism)
        lists = _rare_lists(C.mark_maybe(d, "doc_id", wide.select("node")).where("__maybe").select("text"), k, num, den, most, shards, tasks)
        sized = sized.where("chunks = 1").unionByName(sized_clusters(lists, wide))
    texts = d.select(F.col("doc_id").alias("node"), "text")
    pivots = sized.where("node = cluster AND chunks > 1").select("cluster", "node", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"))
    members = sized.where("NOT (node = cluster AND chunks > 1)").select("cluster", "node", "chunk").union(pivots.select("cluster", "node", "chunk"))
    links = cut_lineage(_verified(members, texts, k, num, den))

    # Sets of dealt clusters that no link joins to the first set meet every chunk.
    large = sized.where("chunks > 1")
    if large.limit(1).count():
        joined = links.where("top = cluster").select("cluster", "node").distinct()
        left = large.join(joined, ["cluster", "node"], "left_anti").select("cluster", "node", "n", "chunks")
        share = left.groupBy("cluster").agg(F.ceil(F.sum("n") / chunk).alias("parts"))
        left = left.join(share, "cluster").withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")))
        zero = F.lit(0).cast("bigint")
        meet = left.select("cluster", "node", F.explode(F.transform(F.sequence(zero, F.col("chunks") - 1), lambda c: c * F.col("parts") + F.col("part"))).alias("chunk"))
        wait = large.join(share, "cluster")
        wait = wait.select("cluster", "node", F.explode(F.transform(F.sequence(zero, F.col("parts") - 1), lambda p: F.col("chunk") * F.col("parts") + p)).alias("chunk"))
        links = links.union(_verified(meet.union(wait).distinct(), texts, k, num, den))
    several = owners.groupBy("doc_id").agg(F.min("node").alias("top"), F.max("node").alias("last")).where("top <> last").select("doc_id", "top")
    same = owners.join(several, "doc_id").select(F.lit(None).cast("bigint").alias("cluster"), "node", "top")  # the texts of one document
    found = connected_components(links.union(same), "node", "top")

    named = owners.join(found, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("component_id"))
    return sets.select("doc_id", "n_shingles").join(named, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The documents less all but the smallest id of each component.

    Rows that share an id are one document and stay or go together; documents without words or id stay.
    """
    found = jaccard_components(docs, **how).where("doc_id IS NOT NULL AND n_shingles > 0")
    drop = cut_lineage(found.where("component_id <> doc_id").select("doc_id").distinct())
    marked = C.mark_maybe(docs, "doc_id", drop)  # only documents that may go are shuffled
    return marked.where("NOT __maybe").unionByName(marked.where("__maybe").join(drop, "doc_id", "left_anti")).select(*docs.columns)
