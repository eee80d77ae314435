"""N-gram Jaccard self-join by universe partition.

Each document is its set of word n-grams (ASCII case folded; a text with fewer
words is one n-gram of them all, a text without words or a null is in no pair).
All n-grams stand in one order, rare ones first; how rare one is, a bounded sample of the
documents tells.  Two sets with Jaccard similarity t or more, ``|r| <= |s|``, have
``t * |s|`` and ``2t/(1+t) * |r|`` n-grams in common at least, so the first common one in
that order stands early in both: among the first ``|r| - ceil(2t/(1+t) * |r|) + 1`` of ``r``,
which are indexed, and the first ``|s| - ceil(t * |s|) + 1`` of ``s``, which probe, in the size band of ``s`` and
the one below.  The order changes cost, never the result: every
candidate is verified on the n-gram sets themselves and no qualifying pair can
be missed.

Documents with the same set are one set, sent once by each task: all-pairs work is
done on distinct sets.  Two sets share many n-grams, so the pairs of common
signatures are marked in bit tables, tile by tile, where a pair costs the same however often
it is found; those of rare ones are listed.  Pairs in a large group of near copies grow with its square, so no
row is made for a candidate: each task gives a tree for each group that its candidates connect. The groups that
the trees form together are verified on the texts, each pair of sets once, in cells where a group is
large, and what is left of the similar pairs is a count for each set and a tree again.

`classes` gives one row for each document with its class and its number of links,
`jaccard_join` the pairs of representatives (the least doc_id of a set) and the
copies, each with its representative.

Null doc_ids are left out.  Rows that repeat a doc_id with the same n-grams
count once; with other n-grams the doc_id stands for each of its sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.core import (
    Bloom,
    Packer,
    U,
    Words,
    binary,
    buffers,
    documents,
    durable,
    fresh,
    id_text,
    mix,
    pack,
    partitions,
    pieces,
    release,
    unpack,
)

NGRAM = 2
#: Of the query, its SQL and the pipeline: a changed word costs two bigrams, so copies with 8 % of words changed are at 0.72.
THRESHOLD = 0.7
#: Of `jaccard_join` where a caller names none.
UNNAMED = 0.8
#: Roles of an entry.
INDEX, PROBE = 1, 2
#: Side of a set whose block holds all of its cell's pairs; else 0 or 1, and pairs have one of each.
BOTH = 2
#: Weight (n-grams, and 200 for each set) of a cell in which candidates are verified.
CELL = 1 << 20


def gram_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, and where each text's begin."""
    w = Words(data, off, fold=True)
    h, first = w.hash, w.first
    docs = len(off) - 1
    with np.errstate(over="ignore"):
        grams = h.copy()
        for k in range(1, n):
            grams[: len(h) - k] = mix(grams[: len(h) - k] * U(0x9E3779B97F4A7C15) + h[k:])
    out, size = [], np.zeros(docs + 1, np.int64)
    for d in range(docs):
        a, b = int(first[d]), int(first[d + 1])
        if b == a:
            continue
        if b - a < n:
            with np.errstate(over="ignore"):
                x = h[a : a + 1]
                for k in range(1, b - a):
                    x = mix(x * U(0x9E3779B97F4A7C15) + h[a + k : a + k + 1])
                x = mix(x + U(b - a))
        else:
            x = np.unique(grams[a : b - n + 1])
        out.append(x)
        size[d + 1] = len(x)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(size)


def set_prints(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Order-free 64-bit fingerprint of each set."""
    with np.errstate(over="ignore"):
        total = np.r_[U(0), np.cumsum(mix(grams ^ U(0x5851F42D4C957F2D)))]
        return mix(total[first[1:]] - total[first[:-1]] + (first[1:] - first[:-1]).astype(np.uint64) * U(0xD6E8FEB86659FD93))


@lru_cache(8)
def bands(threshold: float, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest size of each band.

    A band spans as much as similar sets may differ in size, so a set probes two of them.
    """
    low, high, at = [], [], 1
    while at <= upto:
        end = max(at, math.floor(at / threshold + 1e-9))
        low.append(at)
        high.append(end)
        at = end + 1
    return np.array(low, np.int64), np.array(high, np.int64)


def sketch_bits(size: np.ndarray) -> np.ndarray:
    """Bits of the sketches of sets of these sizes: the power of two that is not less, 64 at least."""
    return np.left_shift(1, np.ceil(np.log2(np.maximum(64, size))).astype(np.int64))


def sketches(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """An odd sketch of each set, as bytes, one after the other: a bit for each hash slot, set if an odd number of n-grams has it.

    Bits that differ between two sketches cannot be more than n-grams that
    differ between the sets, so a sketch can rule a pair out and never wrongly.
    """
    size = np.diff(first)
    bits = sketch_bits(size)
    edge = np.r_[0, np.cumsum(bits)]
    slot = (mix(grams ^ U(0x94D049BB133111EB)) & np.repeat(bits - 1, size).astype(np.uint64)).astype(np.int64) + np.repeat(edge[:-1], size)
    return np.packbits((np.bincount(slot, minlength=edge[-1]) & 1).astype(np.uint8), bitorder="little")


class Sketches:
    """Sketches of numbered sets, compared at the size of the shorter one."""

    def __init__(self, size: np.ndarray, begin: np.ndarray, data: np.ndarray, threshold: float):
        """begin: where each set's sketch begins in ``data``."""
        self.size, self.threshold = size, threshold
        self.level = np.log2(sketch_bits(size) >> 6).astype(np.int64)
        self.own, self.folded = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        self.table: dict[int, np.ndarray] = {}
        wide = np.zeros((0, 0), np.uint64)
        for c in range(int(self.level.max(initial=0)), -1, -1):
            mine, above = np.flatnonzero(self.level == c), np.flatnonzero(self.level == c + 1)
            own = data[begin[mine][:, None] + np.arange(8 << c)].view(np.uint64) if len(mine) else np.zeros((0, 1 << c), np.uint64)
            half = wide[:, : 1 << c] ^ wide[:, 1 << c :] if len(above) else own[:0]
            self.own[mine] = np.arange(len(mine))
            self.folded[above] = len(mine) + np.arange(len(above))
            self.table[c] = np.concatenate([own, half])
            wide = own

    def possible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the sizes and sketches of sets x and y allow that they are similar."""
        n, m = self.size[x], self.size[y]
        keep = (x != y) & (np.minimum(n, m) >= self.threshold * np.maximum(n, m) - 1e-9)
        limit = differences(n, m, self.threshold)
        level = np.minimum(self.level[x], self.level[y])
        for c in np.unique(level[keep]):
            rows = np.flatnonzero(keep & (level == c))
            step = max(1, (1 << 20) >> int(c))
            for at in range(0, len(rows), step):
                k = rows[at : at + step]
                a, b = (np.where(self.level[v[k]] == c, self.own[v[k]], self.folded[v[k]]) for v in (x, y))
                keep[k] = np.bitwise_count(self.table[c][a] ^ self.table[c][b]).sum(axis=1, dtype=np.int64) <= limit[k]
        return keep


class Tree:
    """Which of some numbered sets pairs connect, without keeping the pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        at = self.root[x]
        while (up := self.root[at]).size and (up != at).any():
            at = up
        self.root[x] = at
        return at

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            x, y = self.find(x), self.find(y)
            apart = x != y
            x, y = x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Each set that isn't the first of its group, and that one."""
        root = self.find(np.arange(len(self.root)))
        x = np.flatnonzero(root != np.arange(len(root)))
        return x, root[x]


def differences(r: np.ndarray, s: np.ndarray, threshold: float) -> np.ndarray:
    """Most n-grams in which sets of these sizes may differ."""
    return np.floor((1 - threshold) / (1 + threshold) * (r + s) + 1e-9).astype(np.int64)


#: Sets, about, that tell how common each n-gram is, and bits of the table that is sent to tasks.
SAMPLED, LEVEL_BITS = 1 << 14, 23


def _slots(grams: np.ndarray) -> np.ndarray:
    return (grams >> U(64 - LEVEL_BITS)).astype(np.int64)


def _level(count: np.ndarray) -> np.ndarray:
    """Counts as one byte each, in steps of an eighth of a doubling from 16 on."""
    return np.where(count < 16, count, np.minimum(255, 8 * np.log2(np.maximum(count, 16)) - 16)).astype(np.uint8)


def levels(rows: DataFrame, n: int) -> np.ndarray:
    """How common the n-grams of each slot are, by a sample of the documents: the same for all tasks."""
    every, slices = max(1, rows.count() // SAMPLED), 16
    width = (1 << LEVEL_BITS) // slices

    def counted(batches):
        count, met = np.zeros(1 << LEVEL_BITS, np.int32), np.zeros(0, np.uint64)
        for batch in pieces(batches):
            grams, first = gram_sets(*buffers(batch.column(1)), n)
            prints, size = set_prints(grams, first), np.diff(first)
            own, at = np.unique(prints, return_index=True)
            new = ~np.isin(own, met, assume_unique=True)
            met = np.union1d(met, own[new])
            np.add.at(count, _slots(grams[np.repeat(np.isin(np.arange(len(size)), at[new]), size)]), 1)
        for k in range(slices if len(met) else 0):
            own = count[k * width : (k + 1) * width]
            at = np.flatnonzero(own)
            yield pa.record_batch([pa.array([k], pa.int32()), binary([pack(at.astype(np.uint32), own[at])])], names=["slice", "block"])

    def summed(batches):
        count, which = np.zeros(width, np.int64), None
        for batch in batches:
            for which, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at, own = unpack(block.as_buffer(), np.uint32, np.int32)
                count[at] += own
        if which is not None:
            yield pa.record_batch([pa.array([which], pa.int32()), binary([_level(count).tobytes()])], names=["slice", "block"])

    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    made = sample.mapInArrow(counted, "slice int, block binary").repartitionById(slices, F.col("slice")).mapInArrow(summed, "slice int, block binary").toArrow()
    table = np.zeros(1 << LEVEL_BITS, np.uint8)
    for k, block in zip(made.column(0).to_pylist(), made.column(1), strict=True):
        table[k * width : (k + 1) * width] = np.frombuffer(block.as_buffer(), np.uint8)
    return table


def signatures(grams: np.ndarray, first: np.ndarray, threshold: float, level: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(band, n-gram's number, signature, document, role) of all index and probe entries.

    level: how common the n-grams of each slot are, else as these sets have them.
    """
    size = np.diff(first)
    low, high = bands(threshold, 1 << max(4, int(size.max(initial=1)).bit_length()))
    band = np.searchsorted(low, size, side="right") - 1
    if level is None:
        level = _level(np.bincount(_slots(grams), minlength=1 << LEVEL_BITS))
    # the n-grams of each set, rare ones first; of like ones by hash
    doc = np.repeat(np.arange(len(size)), size)
    order = np.argsort((doc << 8) | level[_slots(grams)], kind="stable")
    place = np.arange(len(grams)) - np.repeat(first[:-1], size)
    least = np.ceil(threshold * size - 2e-9).astype(np.int64)
    probes = place < np.repeat(size - least + 1, size)
    indexed = (place < np.repeat(size - np.ceil(2 * threshold / (1 + threshold) * size - 2e-9).astype(np.int64) + 1, size))[probes]
    gram, doc = grams[order[probes]], doc[probes]
    outs: list[tuple[np.ndarray, ...]] = []
    step = 0
    while True:
        b = band - step
        own = ((size > 0) & (b >= 0) & (high[np.maximum(b, 0)] >= least))[doc]
        if not own.any():
            break
        d, at = doc[own], b[doc[own]]
        with np.errstate(over="ignore"):
            key = mix(gram[own] + mix(at.astype(np.uint64)))
        outs.append((at, (gram[own] & U(0xFFFFFF)).astype(np.int64), key, d, (PROBE + INDEX * (indexed[own] & (step == 0))).astype(np.uint8)))
        step += 1
    if not outs:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), z, np.zeros(0, np.uint8)
    return tuple(np.concatenate([o[k] for o in outs]) for k in range(5))


def _blocks(batches: Iterator[pa.RecordBatch], n: int, threshold: float, parts: int, level: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of index and probe entries by signature, and of documents with their sets."""
    # Cells of each band, by n-gram: the sketch of a set goes to each cell that it has entries in, so they are
    # no more than the partitions need, and where memory asks for more of them, a good part of the partitions.
    spread = max(1, min(16, parts // 12), parts // 128)
    sent = np.zeros(0, np.uint64)
    for batch in pieces(batches):
        valid = np.asarray(batch.column(0).is_valid())
        ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        data, off = buffers(batch.column(1))
        grams, first = gram_sets(data, off, n)
        prints, size = set_prints(grams, first), np.diff(first)
        named = np.flatnonzero(valid & (size > 0))
        if not len(named):
            continue
        out_part, out_block = [], []
        order, present, begin = Packer.split((mix(ids[named].view(np.uint64)) % U(parts)).astype(np.int64), parts)
        for k, p in enumerate(present):
            rows = named[order[begin[k] : begin[k + 1]]]
            out_part.append(int(p))
            out_block.append(pack(prints[rows], ids[rows], size[rows].astype(np.uint32)))
        # a set that this task has sent before isn't sent again
        own, at = np.unique(prints[named], return_index=True)
        new = ~np.isin(own, sent, assume_unique=True)
        sent = np.union1d(sent, own[new])
        chosen = np.sort(named[at[new]])
        grams = grams[np.repeat(np.isin(np.arange(len(size)), chosen), size)]
        prints, size = prints[chosen], size[chosen]
        b, seg, sig, doc, role = signatures(grams, np.r_[0, np.cumsum(size)], threshold, level)
        # bands beside each other, which are full together, never share a partition
        part = (b * spread + seg % spread) % parts
        order, present, begin = Packer.split(part, parts)
        # what is left of a signature within a partition
        short = (sig >> U(32)).astype(np.uint32)
        drawn = sketches(grams, np.r_[0, np.cumsum(size)])
        length = sketch_bits(size) >> 3
        start = np.cumsum(length) - length
        for k, p in enumerate(present):
            rows = order[begin[k] : begin[k + 1]]
            rows = rows[np.argsort(doc[rows], kind="stable")]
            own, counts = np.unique(doc[rows], return_counts=True)
            out_part.append(int(p))
            out_block.append(pack(prints[own], size[own].astype(np.uint32), counts.astype(np.uint32), short[rows], role[rows], drawn[np.repeat(start[own] - np.r_[0, np.cumsum(length[own])[:-1]], length[own]) + np.arange(int(length[own].sum()))]))
        yield pa.record_batch([pa.array(out_part, pa.int32()), binary(out_block)], names=["part", "block"])


def _cross(start: np.ndarray, count: np.ndarray, other_start: np.ndarray, other_count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All combinations of two runs of rows, for many pairs of runs."""
    each = count * other_count
    run = np.repeat(np.arange(len(each)), each)
    k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    return start[run] + k // other_count[run], other_start[run] + k % other_count[run]


#: Combinations of a signature that are listed one by one, at most; those listed at once; and the side of a tile.
LISTED, AT_ONCE, TILE = 256, 1 << 20, 2048


def _listed(left: list[np.ndarray], right: list[np.ndarray], count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Combinations of rare signatures; left and right: begin and length of each one's run."""
    total = np.r_[0, np.cumsum(count)]
    at = 0
    while at < len(count):
        end = max(at + 1, int(np.searchsorted(total, total[at] + AT_ONCE, side="right")) - 1)
        yield _cross(left[0][at:end], left[1][at:end], right[0][at:end], right[1][at:end])
        at = end


def _tiled(members: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Combinations of common signatures, each pair of sets once; members: the sets on either side of each signature."""
    members = sorted(members, key=lambda m: -len(m[0]) * len(m[1]))
    every, where = np.unique(np.concatenate([x for m in members for x in m]), return_inverse=True)
    # sets of one signature stand together
    edge = np.cumsum([0, *[len(x) for m in members for x in m]])
    nearest = np.full(len(every), len(members), np.int64)
    np.minimum.at(nearest, where, np.repeat(np.arange(len(members)), np.diff(edge)[0::2] + np.diff(edge)[1::2]))
    order = np.lexsort((every, nearest))
    place = np.empty(len(every), np.int64)
    place[order] = np.arange(len(every))
    tiles: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    for k in range(len(members)):
        sides = []
        for j in (2 * k, 2 * k + 1):
            x = np.sort(place[where[edge[j] : edge[j + 1]]])
            cut = np.flatnonzero(np.r_[True, x[1:] // TILE != x[:-1] // TILE, True])
            sides.append([(int(x[a]) // TILE, x[a:b] % TILE) for a, b in zip(cut[:-1], cut[1:], strict=True)])
        for i, x in sides[0]:
            for j, y in sides[1]:
                tiles.setdefault((min(i, j), max(i, j)), []).append((x, y) if i <= j else (y, x))
    for (i, j), marks in tiles.items():
        table = np.zeros((min(TILE, len(every) - i * TILE), min(TILE, len(every) - j * TILE)), bool)
        for x, y in marks:
            table[np.ix_(x, y)] = True
        for top in range(0, len(table), 256):
            x, y = np.nonzero(table[top : top + 256])
            yield every[order[x + (top + i * TILE)]], every[order[y + j * TILE]]


def _candidates(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows: a set, the one that stands for those its candidates connect, and their sizes (kind 0), or a set and a document that has it (kind 1)."""
    prints, size, counts, short, role, drawn = [], [], [], [], [], []
    for batch in batches:
        for block in batch.column(1):
            block = block.as_buffer()
            kind = int(np.frombuffer(block, np.int64, 1)[0])
            if kind == 3:
                p, ids, n = unpack(block, np.int64, np.int64, np.uint32)
                yield _row_batch(1, p.copy(), ids.copy(), n, n)
                continue
            for out, x in zip((prints, size, counts, short, role, drawn), unpack(block, np.uint64, np.uint32, np.uint32, np.uint32, np.uint8, np.uint8), strict=True):
                out.append(x.copy())
    if not prints:
        return
    prints, size, counts, short, role, drawn = (np.concatenate(x) for x in (prints, size, counts, short, role, drawn))
    length = sketch_bits(size) >> 3
    names, at, own = np.unique(prints, return_index=True, return_inverse=True)
    size = size[at].astype(np.int64)
    sketch = Sketches(size, (np.cumsum(length) - length)[at], drawn, threshold)
    key = (short.astype(np.uint64) << U(32)) | np.repeat(own.astype(np.uint64), counts)
    del prints, counts, short, own, drawn, length
    order = np.argsort(key)
    key, role = key[order], role[order]
    del order
    # entries of one set from several tasks are one
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    key, role = key[begin], np.bitwise_or.reduceat(role, begin)
    sig = key >> U(32)
    # a signature seen once, or only to index or only to probe, joins nothing
    begin = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    roles = np.bitwise_or.reduceat(role, begin)
    count = np.diff(np.r_[begin, len(sig)])
    live = np.repeat((count > 1) & (roles & INDEX > 0) & (roles & PROBE > 0), count)
    key, role = key[live], role[live]
    sig, ref = key >> U(32), (key & U(0xFFFFFFFF)).astype(np.int64)
    del key, live, begin, roles, count
    tree = Tree(len(names))

    def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        a, b = np.flatnonzero(role & PROBE), np.flatnonzero(role & INDEX)
        values, sa, ca = np.unique(sig[a], return_index=True, return_counts=True)
        sb = np.searchsorted(sig[b], values, side="left")
        cb = np.searchsorted(sig[b], values, side="right") - sb
        rare = np.flatnonzero((cb > 0) & (ca * cb <= LISTED))
        for x, y in _listed([sa[rare], ca[rare]], [sb[rare], cb[rare]], (ca * cb)[rare]):
            yield ref[a[x]], ref[b[y]]
        common = [(ref[a[sa[k] : sa[k] + ca[k]]], ref[b[sb[k] : sb[k] + cb[k]]]) for k in np.flatnonzero(ca * cb > LISTED)]
        if common:
            yield from _tiled(common)

    for x, y in found():
        good = sketch.possible(x, y)
        tree.add(x[good], y[good])
    x, y = tree.edges()
    names = names.view(np.int64)
    for at in range(0, len(x), 1 << 17):
        i, j = x[at : at + (1 << 17)], y[at : at + (1 << 17)]
        yield _row_batch(0, names[i], names[j], size[i], size[j])
    release()


ROWS = "kind int, a long, b long, n_a int, n_b int"


def _row_batch(kind: int, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(n_a.astype(np.int32)), pa.array(n_b.astype(np.int32))], names=["kind", "a", "b", "n_a", "n_b"])


def _alike(n: int, threshold: float, whole: bool):
    def check(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Similar pairs of the sets of a block and group; if not ``whole``, each set's number of them and a tree."""
        block, group, side, p = (rows.column(c).to_numpy() for c in ("block", "label", "side", "p"))
        held: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(p)
        at = 0
        for batch in pieces(iter(rows.select(["text"]).combine_chunks().to_batches())):
            grams, first = gram_sets(*buffers(batch.column(0)), n)
            right = set_prints(grams, first).view(np.int64) == p[at : at + batch.num_rows]  # a doc_id may have other texts
            for d in np.flatnonzero(right & (np.diff(first) > 0)):
                held[at + d] = grams[first[d] : first[d + 1]].copy()
            at += batch.num_rows
        size = np.array([len(x) for x in held], np.int64)
        # a set's first row that has its text, by group and size
        order = np.lexsort((-size, p, group, block))
        new = np.r_[True, (block[order][1:] != block[order][:-1]) | (group[order][1:] != group[order][:-1]) | (p[order][1:] != p[order][:-1])]
        order = order[new]
        if not size[order].all():
            raise RuntimeError("a candidate's text is missing")
        order = order[np.lexsort((p[order], size[order], group[order], block[order]))]
        block, group, side, p, size, held = block[order], group[order], side[order], p[order], size[order], [held[k] for k in order]
        run = np.cumsum(np.r_[False, (block[1:] != block[:-1]) | (group[1:] != group[:-1])])
        grams, edge = np.concatenate(held), np.r_[0, np.cumsum(size)]
        length = sketch_bits(size) >> 3
        sketch = Sketches(size, np.cumsum(length) - length, sketches(grams, edge), threshold)
        every, number = np.unique(grams, return_inverse=True)
        mark = np.zeros(len(every), np.int32)
        tree, links = Tree(len(p)), np.zeros(len(p), np.int64)
        # partners of each set: those after it in its group, as far as sizes allow
        wide = int(size.max()) + 1
        last = np.searchsorted(run * wide + size, run * wide + np.minimum(wide - 1, np.floor(size / threshold + 1e-9).astype(np.int64)), side="right")
        partners = last - np.arange(len(p)) - 1
        total = np.r_[0, np.cumsum(partners)]
        lo = 0
        while lo < len(p):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + AT_ONCE, side="right")) - 1)
            a = np.repeat(np.arange(lo, hi), partners[lo:hi])
            b = a + 1 + np.arange(len(a)) - np.repeat(total[lo:hi] - total[lo], partners[lo:hi])
            good = (side[a] == BOTH) | (side[a] != side[b])
            a, b = a[good], b[good]
            good = sketch.possible(a, b)
            a, b = a[good], b[good]
            common = np.empty(len(a), np.int64)
            begin = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else a
            for i, j in zip(begin, np.r_[begin[1:], len(a)], strict=True):
                own = number[edge[a[i]] : edge[a[i] + 1]]
                mark[own] = 1
                for k in range(i, j, 256):  # so many others at once
                    other = b[k : min(j, k + 256)]
                    start = np.r_[0, np.cumsum(size[other])[:-1]]
                    places = np.repeat(edge[other] - start, size[other]) + np.arange(int(size[other].sum()))
                    common[k : k + len(other)] = np.add.reduceat(mark[number[places]], start)
                mark[own] = 0
            union = size[a] + size[b] - common
            good = common >= threshold * union - 1e-9
            a, b = a[good], b[good]
            if whole:
                yield pa.record_batch([pa.array(x) for x in (np.minimum(p[a], p[b]), np.maximum(p[a], p[b]), common[good], union[good])], names=["a", "b", "n_common", "n_union"])
            else:
                links += np.bincount(a, minlength=len(p)) + np.bincount(b, minlength=len(p))
                tree.add(a, b)
            lo = hi
        if not whole:
            x, y = tree.edges()
            own = np.flatnonzero(links)
            yield pa.record_batch([pa.array(np.r_[p[own], p[x]]), pa.array(np.r_[p[own], p[y]]), pa.array(np.r_[links[own], np.zeros(len(x), np.int64)])], names=["a", "b", "links"])

    return check


def _by_block(check):
    """Checks whole blocks of rows that come in order of their block, several small ones together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column(0).to_numpy()
            last_begins = len(block) - int(np.argmax(block[::-1] != block[-1])) if (block != block[-1]).any() else 0
            if held and weight > 4 << 20:
                if block[0] != held[-1].column(0)[-1].as_py():
                    yield from check(pa.Table.from_batches(held))
                    held, weight = [], 0
                elif last_begins:
                    yield from check(pa.Table.from_batches([*held, batch.slice(0, last_begins)]))
                    held, weight, batch = [], 0, batch.slice(last_begins)
            held.append(batch)
            weight += batch.nbytes
        if held:
            yield from check(pa.Table.from_batches(held))
        release()

    return run


def in_cells(rows: DataFrame, cell: int) -> DataFrame:
    """``rows`` (p, label, weight, ..) for each ``block`` in which p meets others of its label, and the ``side`` it has there: any two of a label meet once."""
    heavy = rows.groupBy("label").agg((F.floor(F.sum("weight") / cell) + 1).alias("cells"))
    bins = max(1, -(-int(rows.agg(F.sum("weight")).first()[0] or 0) // cell))
    own = F.pmod(F.xxhash64("p"), F.col("cells"))
    # a large group's cells meet two by two; a set is on the left in the blocks with later cells
    one = F.array(F.struct(F.pmod(F.xxhash64("label"), F.lit(bins).cast("long")).alias("block"), F.lit(BOTH).alias("side")))
    many = F.transform(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1), lambda k: F.struct(F.xxhash64("label", F.least(k, F.col("own_cell")), F.greatest(k, F.col("own_cell"))).alias("block"), F.when(k == F.col("own_cell"), BOTH).otherwise((k < F.col("own_cell")).cast("int")).alias("side")))
    return rows.join(heavy, "label").withColumn("own_cell", own).withColumn("x", F.explode(F.when(F.col("cells") == 1, one).otherwise(many))).select(*rows.columns, "x.block", "x.side")


def similar_sets(docs: DataFrame, n: int = NGRAM, threshold: float = UNNAMED, whole: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(p, rep, n_docs) of each set; (p, doc_id) of each document; (a, b, n_common, n_union) of similar sets.

    If not ``whole``, (a, b, links) instead of the last: rows with a = b have links of a set, whose sum is its number
    of similar sets; the other rows connect the sets that similar pairs connect.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    rows = id_text(docs)
    sent = spark.sparkContext.broadcast(levels(rows, n).tobytes())
    blocks = rows.mapInArrow(lambda it: _blocks(it, n, threshold, parts, np.frombuffer(sent.value, np.uint8)), "part int, block binary")
    found = durable(blocks.repartitionById(parts, F.col("part")).mapInArrow(lambda it: _candidates(it, threshold), ROWS))
    owners = found.filter("kind = 1").select(F.col("a").alias("p"), F.col("b").alias("doc_id")).distinct()
    sets = owners.groupBy("p").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_docs"))
    met = durable(found.filter("kind = 0").select("a", "b", "n_a", "n_b").distinct())
    ends = met.select(F.col("a").alias("p"), F.col("n_a").alias("n")).unionByName(met.select(F.col("b").alias("p"), F.col("n_b").alias("n"))).groupBy("p").agg((F.first("n") + 200).alias("weight"))
    label = groups(met.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))).select(F.col("doc_id").alias("p"), F.col("keeper").alias("label"))
    label = durable(label.join(ends, "p").join(sets.select("p", F.col("rep").alias("doc_id")), "p"))
    asked = in_cells(label, CELL).select("p", "doc_id", "label", "block", "side")
    texts = Bloom(label.select("doc_id").distinct()).rows(rows).join(asked, "doc_id").select("block", "label", "side", "p", "text")
    similar = texts.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_by_block(_alike(n, threshold, whole)), "a long, b long, n_common long, n_union long" if whole else "a long, b long, links long")
    return sets, owners, similar


def jaccard_join(docs: DataFrame, n: int = NGRAM, threshold: float = UNNAMED) -> DataFrame:
    """(doc_a, doc_b, jaccard): similar distinct sets, and copies with their smallest doc_id."""
    sets, owners, similar = similar_sets(docs, n, threshold)
    for x in ("a", "b"):
        similar = similar.join(sets.select(F.col("p").alias(x), F.col("rep").alias(f"rep_{x}")), x)
    copies = owners.join(sets.select("p", "rep"), "p").filter("doc_id <> rep")
    return (
        similar.filter("rep_a <> rep_b")
        .select(F.least("rep_a", "rep_b").alias("doc_a"), F.greatest("rep_a", "rep_b").alias("doc_b"), (F.col("n_common") / F.col("n_union")).alias("jaccard"))
        .unionByName(copies.select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard")))
        .distinct()
    )


def classes(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, copies, links): a row for each doc_id that has words.

    class_id: the smallest doc_id of those connected by similarity.  copies: other
    documents with the same set; links: other sets that are similar (of all its sets, where a doc_id has several).
    """
    sets, owners, similar = similar_sets(docs, n, threshold, whole=False)
    sets, owners, similar = durable(sets), durable(owners), durable(similar)
    links = similar.filter("a = b").groupBy(F.col("a").alias("p")).agg(F.sum("links").alias("links"))
    edges = similar.filter("a <> b").select("a", "b")
    for x in ("a", "b"):
        edges = edges.join(sets.select(F.col("p").alias(x), F.col("rep").alias(f"rep_{x}")), x)
    edges = edges.select(F.col("rep_a").alias("doc_a"), F.col("rep_b").alias("doc_b"))
    # a doc_id with several sets connects them
    several = owners.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    edges = edges.unionByName(owners.join(several, "doc_id").join(sets, "p").select(F.col("doc_id").alias("doc_a"), F.col("rep").alias("doc_b")))
    found = groups(edges)
    known = sets.join(links, "p", "left").join(found.withColumnRenamed("doc_id", "rep"), "rep", "left").select("p", F.coalesce("keeper", "rep").alias("class_id"), (F.col("n_docs") - 1).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))
    return owners.join(known, "p").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("copies").alias("copies"), F.sum("links").alias("links"))


def groups(pairs: DataFrame) -> DataFrame:
    """(doc_id, keeper): connected documents and the smallest doc_id of each group.

    Alternating large-star and small-star steps, each an aggregation; their
    number grows with the logarithm of a group's diameter, not its size.
    """
    edges = durable(pairs.select(F.greatest("doc_a", "doc_b").alias("u"), F.least("doc_a", "doc_b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u")
        edges = durable(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        )
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("keeper")).unionByName(edges.select(F.col("v").alias("doc_id"), F.col("v").alias("keeper")).distinct())


def keep_one_of_each(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document, the smallest doc_id, of each group of similar ones, all columns as they are.

    Documents without a doc_id or without words stay.  Of rows that repeat a
    doc_id and its text one stays.
    """
    found = durable(classes(docs, n, threshold).select("doc_id", "class_id"))
    gone, name = found.filter("doc_id <> class_id").select("doc_id"), fresh(docs, "again")
    again = docs.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).count().filter("count > 1").select("doc_id")
    again = durable(again)
    named = gone.select("doc_id", F.lit(True).alias("gone")).unionByName(again.select("doc_id", F.lit(False).alias("gone")))
    named = durable(named.groupBy("doc_id").agg(F.max("gone").alias("gone")))
    # texts of the documents that are in question move, others stay where they are
    bloom, key = Bloom(named.select("doc_id")), fresh(docs, "named_id")
    asked = bloom.rows(docs)
    asked = asked.join(named.select(F.col("doc_id").alias(key), F.col("gone").alias(name)), asked["doc_id"] == F.col(key), "left").filter(f"`{name}` IS NULL OR NOT `{name}`")
    sure = bloom.rows(docs, inside=False)
    if again.isEmpty():
        return sure.unionByName(asked.select(docs.columns))
    once = asked.filter(F.col(name).isNotNull()).select(docs.columns).dropDuplicates(["doc_id", "text"])
    return sure.unionByName(asked.filter(F.col(name).isNull()).select(docs.columns)).unionByName(once)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, class_id, copies, links): a row for each document with words, in the class of those that it is similar to."""
    return classes(documents(spark, sf_dir))


SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\t\\n\\x0b\\f\\r ]+'), lambda x: x <> '') AS ws
  FROM documents WHERE doc_id IS NOT NULL),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < {NGRAM} THEN [array_to_string(ws, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) END AS gs
  FROM w WHERE len(ws) > 0),
r AS (SELECT gs, row_number() OVER () AS s, rep, n_docs FROM (SELECT gs, min(doc_id) AS rep, count(*) AS n_docs FROM g GROUP BY gs)),
m AS (SELECT doc_id, s, rep, n_docs FROM g JOIN r USING (gs)),
e AS (SELECT s, rep, len(gs) AS n, unnest(gs) AS gram FROM r),
c AS (SELECT a.s AS x, b.s AS y, a.rep AS rep_x, b.rep AS rep_y, a.n AS na, b.n AS nb, count(*) AS n_common
  FROM e a JOIN e b ON a.gram = b.gram AND a.s < b.s AND least(a.n, b.n) >= {THRESHOLD} * greatest(a.n, b.n) - 1e-9
  GROUP BY ALL),
p AS (SELECT * FROM c WHERE n_common >= {THRESHOLD} * (na + nb - n_common) - 1e-9),
l AS (SELECT s, count(*) AS links FROM (SELECT x AS s FROM p UNION ALL SELECT y FROM p) GROUP BY s),
d AS (SELECT rep_x AS u, rep_y AS v FROM p UNION SELECT rep_y, rep_x FROM p UNION SELECT doc_id, rep FROM m UNION SELECT rep, doc_id FROM m),
reach AS (SELECT DISTINCT doc_id, doc_id AS v FROM m UNION SELECT reach.doc_id, d.v FROM reach JOIN d ON reach.v = d.u),
k AS (SELECT doc_id, min(v) AS class_id FROM reach GROUP BY doc_id)
SELECT doc_id, any_value(class_id) AS class_id, sum(n_docs - 1)::BIGINT AS copies, sum(coalesce(links, 0))::BIGINT AS links
FROM m LEFT JOIN l USING (s) JOIN k USING (doc_id) GROUP BY doc_id
"""
