"""Document fingerprints from statistically improbable features.

A feature is a window of ``WINDOW`` bytes.  Its entropy, on a scale of 0 to 1000, is
looked up in a histogram of all windows of all documents: the rarer its entropy,
the lower its rank.  In every run of ``RUN`` neighbouring windows the leftmost of least rank
scores a point, and windows with ``POPULAR`` points or more are selected; windows of very low or very
high entropy (padding, random bytes) never are.  A text's distinct selected features go,
in order, into a chain of Bloom filters of ``BITS`` bits: five bits each, ``PER_FILTER``
features to a filter, then a new one begins.

Two digests are compared filter by filter.  The bits that two filters share are set
against what chance would give and what the smaller could share at most, which gives 0 to 100;
a digest's score is the mean, over the filters of the shorter one, of the best score in the
other.  Filters with fewer than ``LEAST`` features count only where a digest has no other.

`fingerprints` compares each document with every other one that has a feature of it.  Copies of a text have one digest,
which is compared once; the texts that have a feature meet under its least holder, so a text goes only where
others share something with it, in cells where one holder stands for many.  ``match`` is the best of
those that a document was compared with (ties: the least doc_id) and ``score`` the comparison's result.
Null ``match``: no feature is anyone else's.

A null text and one of fewer than ``WINDOW + RUN - 1`` bytes have an empty digest.  Rows that
repeat a doc_id and its text have one digest and one result row; with other texts they
are documents of their own.  Rows without doc_id have no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import jaccard
from foliant.llm.core import Packer, U, binary, buffers, documents, durable, id_text, pack, partitions, pieces, spans_hash, text_prints, unpack
from foliant.llm.repeats import sliding_least

WINDOW, RUN, POPULAR = 64, 64, 16
LOWEST, HIGHEST = 100, 990
BITS, PER_FILTER, HASHES, LEAST = 2048, 160, 5, 16
#: Weight (shared features, and 48 for each text) of a cell in which texts are compared.
CELL = 1 << 19
_SCALE = 1 << 20
_C = np.arange(WINDOW + 1)
_CLOGC = np.zeros(WINDOW + 1, np.int64)
_CLOGC[1:] = np.round(_C[1:] * np.log2(_C[1:]) * _SCALE)


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy of every window, from 0 to 1000, in whole numbers so that sums are exact."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int16)
    # how often a byte is among the 63 bytes before it, and after it
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    block = 1 << 16
    for at in range(0, len(data), block):
        lo, hi = max(0, at - WINDOW), min(len(data), at + block + WINDOW)
        own = data[lo:hi]
        b, a = np.zeros(hi - lo, np.uint8), np.zeros(hi - lo, np.uint8)
        for k in range(1, WINDOW):
            same = (own[k:] == own[:-k]).view(np.uint8)
            b[k:] += same
            a[:-k] += same
        end = min(len(data), at + block)
        before[at:end], after[at:end] = b[at - lo : end - lo], a[at - lo : end - lo]
    step = _CLOGC[1:] - _CLOGC[:-1]
    total = np.empty(n, np.int64)
    total[0] = _CLOGC[np.bincount(data[:WINDOW], minlength=256)].sum()
    total[1:] = step[before[WINDOW:]] - step[after[: n - 1]]
    np.cumsum(total, out=total)
    # log2(64) - sum / 64, of at most 6 bits
    return ((6 * WINDOW * _SCALE - total) * 1000 // (6 * WINDOW * _SCALE)).astype(np.int16)


def _inside(off: np.ndarray, n: int, width: int) -> np.ndarray:
    """Whether a run of ``width`` bytes that begins at each of ``n`` places stays in its text."""
    steps = np.zeros(n + 1, np.int32)
    a, b = off[:-1], off[1:] - width + 1
    full = b > a
    np.add.at(steps, a[full], 1)
    np.add.at(steps, np.minimum(b[full], n), -1)
    return np.cumsum(steps[:-1]) > 0


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = np.zeros(1001, np.int64)
    for batch in pieces(batches):
        data, off = buffers(batch.column(0))
        h = entropies(data)
        count += np.bincount(h[_inside(off, len(h), WINDOW)], minlength=1001)
    yield pa.record_batch([pa.array(np.flatnonzero(count)), pa.array(count[count > 0])], names=["entropy", "n"])


def ranks(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy: rarer is lower; 0 for those that are never selected."""
    found = id_text(docs).select("text").mapInArrow(_histogram, "entropy long, n long").groupBy("entropy").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(1001, np.int64)
    count[found.column("entropy").to_numpy()] = found.column("n").to_numpy()
    rank = np.zeros(1001, np.int64)
    rank[np.lexsort((np.arange(1001), count))] = np.arange(1, 1002)
    rank[: LOWEST + 1] = 0
    rank[HIGHEST + 1 :] = 0
    return rank


def features(data: np.ndarray, off: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of the distinct selected features, in order."""
    h = entropies(data)
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(h) < RUN:
        return none
    own = rank[h]
    own[own == 0] = 2000
    # rank first, then place within the run
    key = (own << 44) | np.arange(len(own))
    least = sliding_least(key, RUN)[_inside(off, len(own) - RUN + 1, WINDOW + RUN - 1)]
    place = (least & ((1 << 44) - 1))[(least >> 44) < 2000]
    points = np.bincount(place, minlength=1)
    at = np.flatnonzero(points >= POPULAR)
    if not len(at):
        return none
    doc = np.searchsorted(off, at, side="right") - 1
    value = spans_hash(data, at, at + WINDOW)
    order = np.lexsort((at, value, doc))
    new = np.r_[True, (doc[order][1:] != doc[order][:-1]) | (value[order][1:] != value[order][:-1])]
    keep = np.sort(order[new])
    return doc[keep], value[keep]


def filters(value: np.ndarray) -> np.ndarray:
    """The chain of Bloom filters, as bytes (filters x BITS / 8), of a text's features."""
    chain = -(-len(value) // PER_FILTER)
    table = np.zeros((chain, BITS), bool)
    row = np.arange(len(value)) // PER_FILTER
    for k in range(HASHES):
        table[row, (value >> U(11 * k)).astype(np.int64) & (BITS - 1)] = True
    return np.packbits(table, axis=1, bitorder="little")


def compare(a: bytes, na: int, b: bytes, nb: int) -> float:
    """Score of two digests of so many features, from 0 to 100."""
    if not na or not nb:
        return 0.0
    x, y = (np.frombuffer(v, np.uint8).reshape(-1, BITS // 8) for v in (a, b))
    if len(x) > len(y) or (len(x) == len(y) and na > nb):
        x, na, y, nb = y, nb, x, na

    def full(table, n):
        last = n - (len(table) - 1) * PER_FILTER
        return table[: len(table) - 1] if last < LEAST and len(table) > 1 else table

    x, y = full(x, na), full(y, nb)
    set_x, set_y = np.bitwise_count(x).sum(axis=1).astype(float), np.bitwise_count(y).sum(axis=1).astype(float)
    shared = np.array([np.bitwise_count(row & y).sum(axis=1) for row in x], float)
    chance = np.outer(set_x, set_y) / BITS
    most = np.minimum.outer(set_x, set_y)
    floor = chance + 0.3 * (most - chance)
    score = np.where(most > floor, np.clip((shared - floor) / np.maximum(most - floor, 1e-9), 0, 1), 0)
    return round(float(100 * score.max(axis=1).mean()), 3)


DIGEST = "doc_id long, print long, n_features int, digest binary, part int, block binary"


def _digests(batches: Iterator[pa.RecordBatch], rank: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """A row for each document's digest, and rows that take its features to their partitions."""
    sent = np.zeros(0, np.int64)
    for batch in pieces(batches):
        valid = np.asarray(batch.column(0).is_valid())
        ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        data, off = buffers(batch.column(1))
        prints = text_prints(data, off).view(np.int64)
        doc, value = features(data, off, rank)
        stay = valid[doc]
        doc, value = doc[stay], value[stay]
        count = np.bincount(doc, minlength=len(ids))
        edge = np.r_[0, np.cumsum(count)]
        own = np.flatnonzero(valid)
        none = pa.nulls(len(own), pa.int32())
        digest = [filters(value[edge[d] : edge[d + 1]]).tobytes() for d in own]
        yield pa.record_batch([pa.array(ids[own]), pa.array(prints[own]), pa.array(count[own].astype(np.int32)), binary(digest), none, binary([None] * len(own))], names=["doc_id", "print", "n_features", "digest", "part", "block"])
        # a text that this task has sent before isn't sent again
        texts, at = np.unique(np.where(valid, prints, 0), return_index=True)
        new = ~np.isin(texts, sent, assume_unique=True)
        sent = np.union1d(sent, texts[new])
        stay = np.isin(doc, at[new])
        doc, value = doc[stay], value[stay]
        if not len(doc):
            continue
        order, present, begin = Packer.split((value % U(parts)).astype(np.int64), parts)
        blocks = []
        for i in range(len(present)):
            rows = np.sort(order[begin[i] : begin[i + 1]])
            who, n = np.unique(doc[rows], return_counts=True)
            blocks.append(pack(prints[who], n.astype(np.uint32), value[rows]))
        k = len(present)
        gone = pa.nulls(k, pa.int64())
        yield pa.record_batch([gone, gone, pa.nulls(k, pa.int32()), binary([None] * k), pa.array(present.astype(np.int32)), binary(blocks)], names=["doc_id", "print", "n_features", "digest", "part", "block"])


def _sharers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that share features here, once for each least holder of these: with it as label, and those features."""
    prints, count, value = [], [], []
    for batch in batches:
        for block in batch.column(1):
            for out, x in zip((prints, count, value), unpack(block.as_buffer(), np.int64, np.uint32, np.uint64), strict=True):
                out.append(x.copy())
    if not prints:
        return
    names, own = np.unique(np.concatenate(prints), return_inverse=True)
    who, value = np.repeat(own, np.concatenate(count)), np.concatenate(value)
    order = np.lexsort((who, value))
    who, value = who[order], value[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (who[1:] != who[:-1])]
    who, value = who[new], value[new]
    begin = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    held = np.diff(np.r_[begin, len(value)])
    shared = np.repeat(held > 1, held)
    label = np.repeat(who[begin], held)[shared]
    who, value = who[shared], value[shared]
    order = np.lexsort((label, who))
    who, label, value = who[order], label[order], value[order]
    edge = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (label[1:] != label[:-1]), True]) if len(who) else np.zeros(1, np.int64)
    for at in range(0, len(edge) - 1, 1 << 16):
        few = edge[at : at + (1 << 16) + 1]
        yield pa.record_batch([pa.array(names[who[few[:-1]]]), pa.array(names[label[few[:-1]]]), binary([value[i:j].tobytes() for i, j in zip(few[:-1], few[1:], strict=True)])], names=["p", "label", "own"])


def scores(digest: list[bytes], n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`compare` for many pairs of numbered digests that have features."""
    chain = np.array([len(x) for x in digest], np.int64) // (BITS // 8)
    table = np.frombuffer(b"".join(digest), np.uint64).reshape(-1, BITS // 64)
    start = np.cumsum(chain) - chain
    bits = np.bitwise_count(table).sum(axis=1).astype(float)
    full = np.where((n - (chain - 1) * PER_FILTER < LEAST) & (chain > 1), chain - 1, chain)
    swap = (chain[a] > chain[b]) | ((chain[a] == chain[b]) & (n[a] > n[b]))
    x, y = np.where(swap, b, a), np.where(swap, a, b)
    out = np.empty(len(x))
    wide = int(full.max(initial=1)) + 1
    shape = full[x] * wide + full[y]
    for one in np.unique(shape):
        rows, (fx, fy) = np.flatnonzero(shape == one), divmod(int(one), wide)
        step = max(1, (1 << 14) // fy)
        for at in range(0, len(rows), step):
            k = rows[at : at + step]
            theirs = start[y[k]][:, None] + np.arange(fy)
            best = np.empty((len(k), fx))
            for i in range(fx):
                mine = start[x[k]] + i
                shared = np.bitwise_count(table[mine][:, None] & table[theirs]).sum(axis=2).astype(float)
                set_x, set_y = bits[mine][:, None], bits[theirs]
                chance, most = set_x * set_y / BITS, np.minimum(set_x, set_y)
                floor = chance + 0.3 * (most - chance)
                best[:, i] = np.where(most > floor, np.clip((shared - floor) / np.maximum(most - floor, 1e-9), 0, 1), 0).max(axis=1)
            out[k] = 100 * best.mean(axis=1)
    return np.array([round(v, 3) for v in out.tolist()], float)


def _best(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Each text's best score among those of its block and label that share a feature, and whose it is."""
    block, label, side, p, rep, n = (rows.column(c).to_numpy() for c in ("block", "label", "side", "p", "rep", "n_features"))
    digest, own = rows.column("digest").to_pylist(), rows.column("own").to_pylist()
    order = np.lexsort((label, block))
    run = np.empty(len(p), np.int64)
    run[order] = np.cumsum(np.r_[False, (block[order][1:] != block[order][:-1]) | (label[order][1:] != label[order][:-1])])
    ref = np.repeat(np.arange(len(p)), [len(x) // 8 for x in own])
    value = np.frombuffer(b"".join(own), np.uint64)
    order = np.lexsort((ref, value, run[ref]))
    ref, value = ref[order], value[order]
    begin = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (run[ref][1:] != run[ref][:-1])])
    held = np.diff(np.r_[begin, len(ref)])
    rare = (held > 1) & (held * held <= jaccard.LISTED)
    common = [(ref[a : a + k],) * 2 for a, k in zip(begin, held, strict=True) if k * k > jaccard.LISTED]
    best, match = np.full(len(p), -1.0), np.zeros(len(p), np.int64)

    def met() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for x, y in jaccard._listed([begin[rare], held[rare]], [begin[rare], held[rare]], (held * held)[rare]):
            yield ref[x], ref[y]
        if common:
            yield from jaccard._tiled(common)

    for x, y in met():
        good = (x != y) & ((side[x] == jaccard.BOTH) | (side[x] != side[y]))
        code = np.unique((np.minimum(x, y)[good] << 32) | np.maximum(x, y)[good])
        x, y = code >> 32, code & 0xFFFFFFFF
        score = scores(digest, n, x, y)
        x, y, score = np.r_[x, y], np.r_[y, x], np.r_[score, score]
        order = np.lexsort((rep[y], -score, x))
        order = order[np.r_[True, x[order][1:] != x[order][:-1]]] if len(order) else order
        x, y, score = x[order], rep[y[order]], score[order]
        better = (score > best[x]) | ((score == best[x]) & (y < match[x]))
        best[x[better]], match[x[better]] = score[better], y[better]
    own = best >= 0
    yield pa.record_batch([pa.array(p[own]), pa.array(best[own]), pa.array(match[own])], names=["p", "score", "match"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_print, n_features, digest, match, score) of each document."""
    parts = partitions(docs.sparkSession)
    rank = ranks(docs)
    made = durable(id_text(docs).mapInArrow(lambda it: _digests(it, rank, parts), DIGEST))
    digests = made.filter("part is null").select("doc_id", "print", "n_features", "digest").dropDuplicates(["doc_id", "print"])
    shared = durable(made.filter("part is not null").select("part", "block").repartitionById(parts, F.col("part")).mapInArrow(_sharers, "p long, label long, own binary"))
    features = shared.groupBy("p", "label").agg(F.aggregate(F.collect_list("own"), F.lit(b""), lambda a, b: F.concat(a, b)).alias("own"))
    ids = durable(made.filter("part is null").groupBy("print").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")))
    texts = features.join(ids.select(F.col("print").alias("p"), "rep"), "p").withColumn("weight", F.length("own") / 8 + 48)
    texts = durable(texts.join(made.filter("part is null").select(F.col("doc_id").alias("rep"), F.col("print").alias("p"), "n_features", "digest").dropDuplicates(["rep", "p"]), ["rep", "p"]))
    asked = jaccard.in_cells(texts, CELL).select("block", "label", "side", "p", "rep", "n_features", "digest", "own")
    scored = asked.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(jaccard._by_block(_best), "p long, score double, match long")
    best = scored.groupBy(F.col("p").alias("print")).agg(F.max(F.struct("score", (-F.col("match")).alias("b"))).alias("best"))
    # a copy of the same text scores 100
    several = ids.filter("last > rep")
    second = made.filter("part is null").select("doc_id", "print").join(several, "print").filter("doc_id <> rep").groupBy("print").agg(F.min("doc_id").alias("second"))
    known = best.join(several.join(second, "print"), "print", "full").select("print", "best", "rep", "second")
    other = F.when(F.col("doc_id") == F.col("rep"), F.col("second")).otherwise(F.col("rep"))
    copy = F.when((F.col("n_features") > 0) & other.isNotNull(), F.struct(F.lit(100.0).alias("score"), (-other).alias("b")))
    return digests.join(known, "print", "left").withColumn("best", F.greatest("best", copy)).select("doc_id", F.col("print").alias("text_print"), "n_features", "digest", (-F.col("best.b")).alias("match"), F.col("best.score").alias("score"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
