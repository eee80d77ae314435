"""Best-fit packing of documents into training sequences by minimum bin slack.

A document's length is its number of tokens.  One that is longer than a bin is cut:
its whole multiples of the capacity fill bins of their own and the rest is packed
like any other piece.  Each bin takes the longest piece that is left, and then the
combination of the others that fills it best: a bitset (a Python integer, bit k set
if length k can be made) is shifted and or-ed over the available lengths,
longest first, until the exact rest is reachable or the lengths are used up;
going back through the bitsets names the pieces, which are then taken away.

Bins are made within groups of documents, drawn by hash, of about ``group``
documents each, so that groups pack in parallel and only (doc_id, length) moves.
The number of groups follows from the number of documents alone, so the result
does not depend on how the work was spread.

A document without tokens (null or empty text) is in no bin.  Rows that repeat a
doc_id are pieces of their own, also if all else is equal.  A null doc_id is packed
and stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.core import documents, durable
from foliant.llm.tokens import VOCABULARY, token_counts

CAPACITY = 2048
#: Documents that are packed together.
GROUP = 10_000
ITEMS = "array<struct<doc_id:bigint,first_token:bigint,n_tokens:bigint>>"


def pack_lengths(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Indices of the pieces in each bin; sizes are between 1 and ``capacity``, in falling order."""
    at: dict[int, list[int]] = {}
    for k in range(len(sizes) - 1, -1, -1):
        at.setdefault(int(sizes[k]), []).append(k)
    lengths = sorted(at, reverse=True)
    bins = []
    while lengths:
        own = [at[lengths[0]].pop()]
        room = capacity - lengths[0]
        if not at[lengths[0]]:
            lengths.pop(0)
        if room and lengths and lengths[-1] <= room:
            for size in _best(lengths, at, room):
                own.append(at[size].pop())
                if not at[size]:
                    lengths.remove(size)
        bins.append(own)
    return bins


def _best(lengths: list[int], at: dict[int, list[int]], room: int) -> list[int]:
    """Lengths (with repetition, as available) whose sum comes closest to ``room`` from below."""
    reach, every = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for size in lengths:
        if size > room:
            continue
        # so many of one length as powers of two and a rest: each sum up to the number available
        copies, times = min(len(at[size]), room // size), 1
        while copies:
            use = min(times, copies)
            steps.append((size, use, reach))
            reach = (reach | reach << (size * use)) & every
            copies -= use
            times *= 2
        if reach >> room & 1:
            break
    target, out = reach.bit_length() - 1, []
    for size, use, before in reversed(steps):
        if not before >> target & 1:
            out += [size] * use
            target -= size * use
    return out


def _pack(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        group = table.column("grp").to_numpy()
        null = np.asarray(table.column("doc_id").combine_chunks().is_null())
        ids = table.column("doc_id").fill_null(0).to_numpy()
        tokens = table.column("n_tokens").to_numpy()
        order = np.lexsort((tokens, ids, null, group))
        group, ids, tokens, null = group[order], ids[order], tokens[order], null[order]
        edge = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)]
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("first_token", pa.int64()), ("n_tokens", pa.int64())]))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            rows, totals = [], []
            own = [None if x else i for i, x in zip(ids[a:b].tolist(), null[a:b].tolist(), strict=True)]
            size = tokens[a:b]
            whole, rest = size // capacity, size % capacity
            for d in np.flatnonzero(whole):
                for k in range(int(whole[d])):
                    rows.append([{"doc_id": own[d], "first_token": k * capacity, "n_tokens": capacity}])
                    totals.append(capacity)
            some = np.flatnonzero(rest)
            some = some[np.argsort(-rest[some], kind="stable")]
            for chosen in pack_lengths(rest[some], capacity):
                rows.append([{"doc_id": own[d], "first_token": int(whole[d]) * capacity, "n_tokens": int(rest[d])} for d in some[chosen]])
                totals.append(int(rest[some[chosen]].sum()))
            number = np.arange(len(rows), dtype=np.int64)
            yield pa.record_batch(
                [pa.array(np.full(len(rows), group[a], np.int64)), pa.array(number), pa.array(rows, kind), pa.array(totals, pa.int64()), pa.array(capacity - np.array(totals, np.int64))],
                names=["bin_group", "bin", "items", "n_tokens", "slack"],
            )

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, vocabulary: str = VOCABULARY) -> DataFrame:
    """(bin_group, bin, items, n_tokens, slack): the pieces of each bin, in the order of their places."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return pack_counted(token_counts(sized, vocabulary), capacity, group)


def pack_counted(counted: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The same for rows (doc_id, n_tokens)."""
    counted = durable(counted.filter("n_tokens > 0"))
    groups = max(1, -(-counted.count() // group))
    keyed = counted.withColumn("grp", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(groups)))
    return keyed.repartition(groups, "grp").mapInArrow(_pack(capacity), f"bin_group long, bin long, items {ITEMS}, n_tokens long, slack long")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
