"""Repeated passages by a depth-limited radix sort of suffixes.

A suffix is a text from one of its words on; suffixes are ordered only through
their first ``threshold`` words.  The sort key has five digits, each the
fingerprint of a fifth of those words, and is sorted most significant digit
first: the first digit decides the partition, and within a partition every pass
refines the groups of the one before by the next digit and drops suffixes that
have become alone.  Groups left after the last pass are exactly the windows of
``threshold`` words that occur more than once in the corpus.

Before the sort, suffixes that cannot share their window are dropped.  Each
window has an anchor, its word run of least hash; equal windows have equal
anchors, so a window whose anchor is at one place only is alone.  Anchors are
few (about one in eighteen words): they are exchanged by their value, and each document gets those of its
own back that are at several places.  A task sends each anchor once, so one that
every document has does not gather.  This changes cost, never the result.

Within a map task only the first occurrence of a window goes to the sort (with
the word that it occurs again), so that a passage in every document does not
gather in one partition; later ones are known to be repeats at once.

The first occurrence, in order of (doc_id, text fingerprint, word), is kept.  A
word is *removable* if a later occurrence covers it and no first one does.

Words are compared byte for byte.  Null and short texts have no windows.  Rows
without doc_id take no part.  Rows that repeat a doc_id and its text are one
document; with other texts they are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

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
    text_prints,
    unpack,
    window_hash,
)

WORDS = 50
DIGITS = 5
#: Anchors that a task gathers before it sends them.
HELD = 2_000_000


def _windows(w: Words, n: int) -> np.ndarray:
    """Whether a window of ``n`` words of one text begins at each word."""
    begins = np.zeros(len(w.start), bool)
    if len(begins) >= n:
        begins[: len(begins) - n + 1] = w.doc[: len(begins) - n + 1] == w.doc[n - 1 :]
    return begins


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """Least of every ``n`` consecutive values."""
    size = len(x) - n + 1
    if size <= 0:
        return x[:0]
    full = -(-len(x) // n) * n
    padded = np.full(full, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(-1, n)
    right = np.minimum.accumulate(grid, axis=1).ravel()
    left = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:size], right[n - 1 : n - 1 + size])


def anchors(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Starts of windows, the anchor hash of each, and the length of an anchor."""
    k = max(1, n // 3)
    starts = np.flatnonzero(_windows(w, n))
    runs = window_hash(w.hash, k)
    least = sliding_least(runs, n - k + 1)
    return starts, least[starts] if len(starts) else runs[:0], k


def _anchor_blocks(batches: Iterator[pa.RecordBatch], n: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Anchors by value, with the document of those that the task meets once; and what it knows to be repeated."""
    values, docs, ids, held = [], [], [], [0, 0]
    for batch in pieces(batches):
        data, off = buffers(batch.column(1))
        valid = np.asarray(batch.column(0).is_valid())
        w = Words(data, off)
        starts, value, k = anchors(w, n)
        stay = valid[w.doc[starts]]
        starts, value = starts[stay], value[stay]
        if not len(starts):
            continue
        # the places where an anchor begins, once each
        runs = window_hash(w.hash, k)
        reach = n - k + 1
        hit = np.zeros(len(runs), bool)
        fresh_run = np.r_[True, (value[1:] != value[:-1]) | (starts[1:] != starts[:-1] + 1)]
        # a window whose anchor is the one before it has it at the same place, unless that place is left behind
        begin = starts[fresh_run]
        for j in range(reach):
            at = begin + j
            hit[at[runs[at] == value[fresh_run]]] = True
        # within a run of equal anchors more equal places may come in at the right end
        right = starts + reach - 1
        hit[right[runs[right] == value]] = True
        place = np.flatnonzero(hit)
        values.append(runs[place])
        docs.append(w.doc[place] + held[1])
        ids.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
        held = [held[0] + len(place), held[1] + batch.num_rows]
        if held[0] > HELD:
            yield _anchors_sent(values, docs, ids, parts)
            values, docs, ids, held = [], [], [], [0, 0]
    if values:
        yield _anchors_sent(values, docs, ids, parts)
    release()


def _anchors_sent(values: list[np.ndarray], docs: list[np.ndarray], ids: list[np.ndarray], parts: int) -> pa.RecordBatch:
    value, doc, names = np.concatenate(values), np.concatenate(docs), np.concatenate(ids)
    order = np.argsort(value, kind="stable")
    value, doc = value[order], doc[order]
    begin = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    count = np.diff(np.r_[begin, len(value)])
    many = np.repeat(count > 1, count)
    # one row for each value; the document is told where there is but one
    lead, several = value[begin], (count > 1).astype(np.uint8)
    owner = names[doc[begin]]
    order, present, edge = Packer.split((lead % U(parts)).astype(np.int64), parts)
    part, block = [int(p) for p in present], []
    for i in range(len(present)):
        rows = order[edge[i] : edge[i + 1]]
        one = rows[several[rows] == 0]
        block.append(pack(lead[rows[several[rows] == 1]], lead[one], owner[one]))
    if many.any():
        part.append(int(value[0] % U(parts)))
        block.append(pack(*_by_document(names[doc[many]], value[many])))
    return pa.record_batch([pa.array(part, pa.int32()), binary(block)], names=["part", "block"])


def _by_document(ids: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct documents, how many anchors each has, the first 32 bits of these; and an empty column that marks the kind."""
    short = (value >> U(32)).astype(np.uint32)
    order = np.lexsort((short, ids))
    ids, short = ids[order], short[order]
    new = np.r_[True, (ids[1:] != ids[:-1]) | (short[1:] != short[:-1])]
    ids, short = ids[new], short[new]
    own, count = np.unique(ids, return_counts=True)
    return own, count.astype(np.uint32), short, np.zeros(0, np.uint8)


def _told(own: np.ndarray, count: np.ndarray, short: np.ndarray) -> pa.RecordBatch:
    edge = np.r_[0, np.cumsum(count.astype(np.int64))]
    return pa.record_batch([pa.array(own), binary([short[edge[k] : edge[k + 1]].tobytes() for k in range(len(own))])], names=["doc_id", "anchors"])


def _repeated_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document the repeated ones of its anchors in this partition."""
    many, single, owner = [], [], []
    for batch in batches:
        for block in batch.column(1):
            block = block.as_buffer()
            if int(np.frombuffer(block, np.int64, 1)[0]) == 4:
                own, count, short, _ = unpack(block, np.int64, np.uint32, np.uint32, np.uint8)
                yield _told(own.copy(), count, short)
                continue
            for out, x in zip((many, single, owner), unpack(block, np.uint64, np.uint64, np.int64), strict=True):
                out.append(x.copy())
    if single:
        many, single, owner = np.concatenate(many), np.concatenate(single), np.concatenate(owner)
        order = np.argsort(single, kind="stable")
        single, owner = single[order], owner[order]
        again = np.zeros(len(single), bool)
        again[1:] = single[1:] == single[:-1]
        again[:-1] |= again[1:]
        many = np.unique(many)
        if len(many):
            again |= many[np.minimum(np.searchsorted(many, single), len(many) - 1)] == single
        if again.any():
            yield _told(*_by_document(owner[again], single[again])[:3])
    release()


def _window_starts(w: Words, n: int, lists: pa.ListArray) -> np.ndarray:
    """Windows whose anchor is among those that the document was told; lists: an array of binaries for each document."""
    starts, value, _ = anchors(w, n)
    if not len(starts):
        return starts
    told = lists.flatten()
    short = np.frombuffer(b"".join(x.as_buffer() for x in told), np.uint32)
    row = np.repeat(np.repeat(np.arange(len(lists)), pa.compute.list_value_length(lists).to_numpy()), pa.compute.binary_length(told).to_numpy() // 4)
    known = np.unique((row.astype(np.uint64) << U(32)) | short)
    new = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (w.doc[starts[1:]] != w.doc[starts[:-1]])])
    asked = (w.doc[starts[new]].astype(np.uint64) << U(32)) | (value[new] >> U(32))
    hit = known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked if len(known) else np.zeros(len(asked), bool)
    return starts[np.repeat(hit, np.diff(np.r_[new, len(starts)]))]


def digit_bounds(n: int) -> list[int]:
    return [n * k // min(DIGITS, n) for k in range(min(DIGITS, n) + 1)]


def _suffix_blocks(batches: Iterator[pa.RecordBatch], n: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Blocks of suffixes by first digit; and, of five columns, occurrences that are known to be repeats."""
    edges = digit_bounds(n)
    for batch in pieces(batches):
        valid = np.asarray(batch.column(0).is_valid())
        ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        data, off = buffers(batch.column(1))
        prints = text_prints(data, off).view(np.int64)
        w = Words(data, off)
        starts = _window_starts(w, n, batch.column(2))
        # one of the rows that repeat a document
        row = np.lexsort((prints, ids))
        same = np.zeros(len(ids), bool)
        same[row[1:]] = (ids[row[1:]] == ids[row[:-1]]) & (prints[row[1:]] == prints[row[:-1]])
        rank = np.empty(len(ids), np.int64)
        rank[row] = np.arange(len(ids))
        starts = starts[(valid & ~same)[w.doc[starts]]]
        if not len(starts):
            continue
        doc = w.doc[starts]
        at = (starts - w.first[doc]).astype(np.uint32)
        digits = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            h = window_hash(w.hash, b - a)
            digits.append((h[starts + a] >> U(32)).astype(np.uint32))
        with np.errstate(over="ignore"):
            key = np.zeros(len(starts), np.uint64)
            for d in digits:
                key = mix(key * U(0x9E3779B97F4A7C15) + d)
        # first occurrence of each window here, by document and word
        order = np.lexsort((at, rank[doc], key))
        k = key[order]
        head = np.r_[True, k[1:] != k[:-1]]
        begin = np.flatnonzero(head)
        many = np.diff(np.r_[begin, len(k)]) > 1
        lead = order[begin]
        resend = np.argsort(lead)
        lead, many = lead[resend], many[resend]
        out_part, out_block = [], []
        later = np.sort(order[~head])
        if len(later):
            own, counts = np.unique(doc[later], return_counts=True)
            out_part.append(int(prints[own[0]].astype(np.uint64) % U(parts)))
            out_block.append(pack(ids[own], prints[own], counts.astype(np.uint32), at[later], np.zeros(len(later), np.uint8)))
        part = (mix(digits[0][lead].astype(np.uint64)) % U(parts)).astype(np.int64)
        split, present, edge = Packer.split(part, parts)
        for i, p in enumerate(present):
            rows = split[edge[i] : edge[i + 1]]
            own, counts = np.unique(doc[lead[rows]], return_counts=True)
            out_part.append(int(p))
            out_block.append(pack(ids[own], prints[own], counts.astype(np.uint32), at[lead[rows]], many[rows].astype(np.uint8), *[d[lead[rows]] for d in digits]))
        yield pa.record_batch([pa.array(out_part, pa.int32()), binary(out_block)], names=["part", "block"])


def _radix_groups(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The suffix blocks of a partition sorted; blocks (document, words, whether first) come out."""
    width = min(DIGITS, n)
    ids, prints, at, many, digits = [], [], [], [], [[] for _ in range(width)]
    for batch in batches:
        for block in batch.column(1):
            block = block.as_buffer()
            if int(np.frombuffer(block, np.int64, 1)[0]) == 5:
                i, p, c, a, f = unpack(block, np.int64, np.int64, np.uint32, np.uint32, np.uint8)
                yield _marks(i.copy(), p.copy(), c.astype(np.int64), a, f)
                continue
            i, p, c, a, m, *d = unpack(block, np.int64, np.int64, np.uint32, np.uint32, np.uint8, *[np.uint32] * width)
            ids.append(np.repeat(i, c))
            prints.append(np.repeat(p, c))
            at.append(a.copy())
            many.append(m.copy())
            for x, y in zip(digits, d, strict=True):
                x.append(y.copy())
    if not ids:
        return
    ids, prints, at, many = (np.concatenate(x) for x in (ids, prints, at, many))
    rows, group = np.arange(len(ids)), np.zeros(len(ids), np.uint64)
    for k, own in enumerate(digits):
        # refine the groups by the next digit
        key = (group << U(32)) | np.concatenate(own)[rows]
        order = np.argsort(key, kind="stable")
        key, rows = key[order], rows[order]
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.r_[begin, len(key)])
        alone = (count == 1) & (many[rows[begin]] == 0) if len(key) else np.zeros(0, bool)
        stay = np.repeat(~alone, count)
        group = np.repeat(np.arange(len(begin), dtype=np.uint64), count)[stay]
        rows = rows[stay]
    if not len(rows):
        return
    order = np.lexsort((at[rows], prints[rows], ids[rows], group))
    rows, group = rows[order], group[order]
    # rows that repeat a document bring its suffixes again
    own = np.r_[True, (group[1:] != group[:-1]) | (ids[rows[1:]] != ids[rows[:-1]]) | (prints[rows[1:]] != prints[rows[:-1]]) | (at[rows[1:]] != at[rows[:-1]])]
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    several = np.repeat((np.add.reduceat(own.astype(np.int64), begin) > 1) | (np.maximum.reduceat(many[rows], begin) > 0), np.diff(np.r_[begin, len(rows)]))
    rows, group = rows[own & several], group[own & several]
    if not len(rows):
        return
    first = np.r_[True, group[1:] != group[:-1]]
    order = np.lexsort((at[rows], prints[rows], ids[rows]))
    rows, first = rows[order], first[order]
    i, p = ids[rows], prints[rows]
    begin = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (p[1:] != p[:-1])])
    yield _marks(i[begin], p[begin], np.diff(np.r_[begin, len(rows)]), at[rows], first.astype(np.uint8))


def _marks(ids, prints, counts, at, first) -> pa.RecordBatch:
    edge = np.r_[0, np.cumsum(counts)]
    return pa.record_batch(
        [pa.array(ids), pa.array(prints), binary([pack(at[edge[k] : edge[k + 1]], first[edge[k] : edge[k + 1]]) for k in range(len(ids))])],
        names=["doc_id", "print", "marks"],
    )


RUNS = "array<struct<first_word:int,end_word:int,removable:boolean>>"


def _runs(n: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blocks in batch.column(2):
                parts = [unpack(b.as_buffer(), np.uint32, np.uint8) for b in blocks.values]
                at = np.concatenate([x[0] for x in parts]).astype(np.int64)
                first = np.concatenate([x[1] for x in parts]).astype(bool)
                cover = []
                for own in (at, at[first]):
                    steps = np.zeros(int(at.max()) + n + 1, np.int64)
                    np.add.at(steps, own, 1)
                    np.add.at(steps, own + n, -1)
                    cover.append(np.cumsum(steps) > 0)
                # 0: in no window; 1: kept; 2: removable
                state = cover[0].astype(np.int8) + (cover[0] & ~cover[1])
                edge = np.r_[0, np.flatnonzero(state[1:] != state[:-1]) + 1, len(state)]
                out.append([{"first_word": int(x), "end_word": int(y), "removable": bool(state[x] == 2)} for x, y in zip(edge[:-1], edge[1:], strict=True) if state[x]])
            kind = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("removable", pa.bool_())]))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, kind)], names=["doc_id", "text_print", "runs"])

    return runs


def repeated_passages(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_print, runs): word ranges, end exclusive, that repeated windows cover, and which are removable."""
    spark = docs.sparkSession
    parts = partitions(spark)
    rows = id_text(docs)
    told = durable(
        rows.mapInArrow(lambda it: _anchor_blocks(it, words, parts), "part int, block binary")
        .repartitionById(parts, F.col("part"))
        .mapInArrow(_repeated_anchors, "doc_id long, anchors binary")
    )
    texts = Bloom(told.select("doc_id").distinct()).rows(rows).join(told.groupBy("doc_id").agg(F.collect_list("anchors").alias("anchors")), "doc_id").select("doc_id", "text", "anchors")
    blocks = texts.mapInArrow(lambda it: _suffix_blocks(it, words, parts), "part int, block binary")
    marks = blocks.repartitionById(parts, F.col("part")).mapInArrow(lambda it: _radix_groups(it, words), "doc_id long, print long, marks binary")
    gathered = marks.groupBy("doc_id", "print").agg(F.collect_list("marks").alias("marks"))
    return gathered.mapInArrow(_runs(words), f"doc_id long, text_print long, runs {RUNS}")


def without_repeats(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` less the removable passages; n_chars, where there is one, follows the text.

    A passage is cut from its first word up to the word after it.  A document
    of which nothing is left goes; all others stay.
    """
    runs = repeated_passages(docs, words).select("doc_id", "text_print", F.filter("runs", lambda r: r["removable"]).alias("removable"))
    spans = durable(runs.filter(F.size("removable") > 0).groupBy("doc_id").agg(F.collect_list(F.struct("text_print", "removable")).alias("cuts")))
    name = fresh(docs, "cuts")
    key = fresh(docs, "cut_id")
    # texts that are cut move, others stay where they are
    bloom = Bloom(spans.select("doc_id"))
    asked = bloom.rows(docs)
    joined = asked.join(spans.select(F.col("doc_id").alias(key), F.col("cuts").alias(name)), asked["doc_id"] == F.col(key), "left").drop(key)
    columns = docs.columns
    where = columns.index("text")
    size = columns.index("n_chars") if "n_chars" in columns else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            cuts = batch.column(len(columns))
            out = [batch.column(k) for k in range(len(columns))]
            touched = np.flatnonzero(np.asarray(cuts.is_valid()))
            if len(touched):
                part = batch.column(where).take(pa.array(touched))
                data, off = buffers(part)
                prints = text_prints(data, off).view(np.int64)
                w = Words(data, off, hashed=False)
                texts = batch.column(where).to_pylist()
                stay = np.ones(batch.num_rows, bool)
                for i, r in enumerate(touched):
                    ranges = next((c["removable"] for c in cuts[int(r)].as_py() if c["text_print"] == prints[i]), None)
                    if not ranges:
                        continue
                    raw = data[off[i] : off[i + 1]].tobytes()
                    lo, hi = int(w.first[i]), int(w.first[i + 1])
                    left, at = [], 0
                    for x in ranges:
                        a, b = lo + x["first_word"], lo + x["end_word"]
                        left.append(raw[at : w.start[a] - off[i]])
                        at = int(w.start[b] - off[i]) if b < hi else len(raw)
                    text = b"".join([*left, raw[at:]]).decode("utf-8", "replace")
                    texts[r] = text
                    stay[r] = bool(text.strip())
                out[where] = pa.array(texts, batch.column(where).type)
                if size is not None:
                    lengths = batch.column(size).to_pylist()
                    for r in touched:
                        lengths[r] = len(texts[r])
                    out[size] = pa.array(lengths, batch.column(size).type)
                yield pa.record_batch(out, names=columns).filter(pa.array(stay))
            else:
                yield pa.record_batch(out, names=columns)

    return bloom.rows(docs, inside=False).unionByName(joined.mapInArrow(cut, docs.schema))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, first_word, end_word, removable): runs of words covered by repeated windows."""
    return repeated_passages(documents(spark, sf_dir)).select("doc_id", F.explode("runs").alias("run")).select("doc_id", "run.*")


SQL = f"""
WITH d AS (
  SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
w AS (
  SELECT row_number() OVER (ORDER BY doc_id, text) AS k, doc_id,
    list_filter(string_split_regex(text, '[\\t\\n\\x0b\\f\\r ]+'), lambda x: x <> '') AS ws FROM d),
h AS (
  SELECT k, doc_id, unnest(range(0, len(ws) - {WORDS - 1})) AS p,
    unnest(list_transform(range(0, len(ws) - {WORDS - 1}), lambda p: md5(array_to_string(ws[p + 1 : p + {WORDS}], ' ')))) AS v
  FROM w WHERE len(ws) >= {WORDS}),
m AS (SELECT *, count(*) OVER (PARTITION BY v) AS n, row_number() OVER (PARTITION BY v ORDER BY k, p) AS r FROM h),
c AS (SELECT k, doc_id, p + j AS word, bool_or(r = 1) AS kept FROM m, range(0, {WORDS}) t(j) WHERE n > 1 GROUP BY ALL),
i AS (SELECT *, word - row_number() OVER (PARTITION BY k, kept ORDER BY word) AS island FROM c)
SELECT doc_id, min(word) AS first_word, max(word) + 1 AS end_word, NOT kept AS removable
FROM i GROUP BY k, doc_id, kept, island
"""
