"""Vectorised text primitives and exchange helpers shared by the operators.

Texts arrive as Arrow string columns.  Everything here works on their UTF-8
buffers with numpy, many documents at a time, so a word costs nanoseconds and
no Python object is made for it.  A *word* is a maximal run of bytes that are
not ASCII white space (tab, LF, VT, FF, CR, space).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U = np.uint64
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: Bytes of text handled at once; temporary arrays are about 60 times as large.
CHUNK = 1 << 20


#: Most bits of the Bloom filters that are sent to tasks, 32 MB.  With more ids they let more rows through to the join, which selects.
BLOOM_BITS = 1 << 28


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * _M1
        x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x632BE59BD9B4E019))
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i < n."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``size`` bytes of text each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + size, side="right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
    release()


def release() -> None:
    """Gives memory that is free back to the system: workers stay alive between tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


class Words:
    """Words of many texts: byte bounds, text number and 64-bit hash of each."""

    __slots__ = ("data", "off", "start", "end", "doc", "hash", "first")

    def __init__(self, data: np.ndarray, off: np.ndarray, fold: bool = False, hashed: bool = True):
        n, docs = len(data), len(off) - 1
        inside = ~_SPACE[data]
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        begins, ends = off[:-1], off[1:]
        full = ends > begins
        before[begins[full]] = False
        after[ends[full] - 1] = False
        self.data, self.off = data, off
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(off, self.start, side="right") - 1
        #: word number at which each text begins (one more entry than texts)
        self.first = np.searchsorted(self.start, off, side="left")
        self.hash = spans_hash(data, self.start, self.end, fold) if hashed else None
        assert len(self.first) == docs + 1


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of byte ranges, equal for equal bytes (ASCII case aside if ``fold``)."""
    pw, inv = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((_FOLDED if fold else _TABLE)[data] * pw[: len(data)], out=total[1:])
        return mix((total[end] - total[start]) * inv[start] + (end - start).astype(np.uint64))


def window_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive values of ``h``, at len(h)-n+1 places."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    pw, inv = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(h * pw[: len(h)], out=total[1:])
        return mix((total[n:] - total[:-n]) * inv[: len(h) - n + 1] + U(n))


def text_prints(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of whole texts."""
    return spans_hash(data, off[:-1], off[1:])


def partitions(spark: SparkSession) -> int:
    """Exchange partitions: the session's own setting, which a cluster sizes to its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one is made only where none is set, as in tests."""
    sc = spark.sparkContext
    place = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if place is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        place = tempfile.mkdtemp(prefix="foliant-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(place)
    return place


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not use (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """The two columns that most operators read; other columns are pruned at the scan."""
    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


class Packer:
    """Rows for numbered partitions, gathered by partition into binary blocks.

    An exchange of millions of small rows costs the JVM a microsecond each;
    blocks of packed numpy columns cost next to nothing.  Rows of a partition
    keep the order in which they were added.
    """

    @staticmethod
    def split(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order by partition, the partitions present, and where each begins."""
        small = part.astype(np.uint16) if parts <= 1 << 16 else part.astype(np.uint32)
        order = np.argsort(small, kind="stable")
        ranked = small[order]
        begin = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, np.int64)
        return order, ranked[begin].astype(np.int64), np.r_[begin, len(ranked)]


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[a.nbytes for a in arrays]], dtype=np.int64)
    return b"".join([head.tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]])


def unpack(block, *dtypes) -> list[np.ndarray]:
    n = int(np.frombuffer(block, np.int64, 1)[0])
    sizes = np.frombuffer(block, np.int64, n, 8)
    out, at = [], 8 * (n + 1)
    for size, dtype in zip(sizes, dtypes, strict=True):
        out.append(np.frombuffer(block, dtype, int(size) // np.dtype(dtype).itemsize, at))
        at += int(size)
    return out


def binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _bloom_places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(np.ascontiguousarray(ids).view(np.uint64))
    return [(h >> U(11 * k)) & U((1 << bits) - 1) for k in range(4)]


class Bloom:
    """A Bloom filter of doc_ids, sent to every task; of ``limit`` bits at most, however many ids there are."""

    def __init__(self, ids: DataFrame, limit: int = BLOOM_BITS):
        """ids: (doc_id), distinct and not null."""
        from pyspark.sql import functions as F

        spark = ids.sparkSession
        self.bits = bits = max(10, min(limit.bit_length() - 1, (16 * max(1, ids.count()) - 1).bit_length()))
        slices = min(64, 1 << (bits - 10))
        width = (1 << bits) // slices

        def places(batches):
            for batch in batches:
                at = np.concatenate(_bloom_places(batch.column(0).to_numpy(zero_copy_only=False), bits)).astype(np.int64)
                order, present, begin = Packer.split(at // width, slices)
                yield pa.record_batch([pa.array(present, pa.int32()), binary([pack((at[order[begin[k] : begin[k + 1]]] % width).astype(np.uint32)) for k in range(len(present))])], names=["slice", "block"])

        def build(batches):
            table, which = np.zeros(width, bool), None
            for batch in batches:
                for k, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    which = k
                    table[unpack(block.as_buffer(), np.uint32)[0]] = True
            if which is not None:
                yield pa.record_batch([pa.array([which], pa.int32()), binary([np.packbits(table, bitorder="little").tobytes()])], names=["slice", "block"])

        table = np.zeros(max(1, (1 << bits) // 8), np.uint8)
        made = ids.select("doc_id").mapInArrow(places, "slice int, block binary").repartitionById(slices, F.col("slice")).mapInArrow(build, "slice int, block binary").toArrow()
        for k, block in zip(made.column(0).to_pylist(), made.column(1), strict=True):
            table[k * width // 8 : (k + 1) * width // 8] = np.frombuffer(block.as_buffer(), np.uint8)
        self.sent = spark.sparkContext.broadcast(table.tobytes())

    def rows(self, docs: DataFrame, inside: bool = True) -> DataFrame:
        """Rows of ``docs`` whose doc_id may be among the ids; or those, with null ones, whose doc_id surely isn't."""
        where, sent, bits = docs.columns.index("doc_id"), self.sent, self.bits

        def keep(batches):
            bloom = np.frombuffer(sent.value, np.uint8)
            for batch in batches:
                ids = batch.column(where).cast(pa.int64())
                hit = np.asarray(ids.is_valid()).copy()
                for at in _bloom_places(ids.fill_null(0).to_numpy(zero_copy_only=False), bits):
                    hit &= (bloom[at >> U(3)] >> (at & U(7)).astype(np.uint8) & 1).astype(bool)
                yield batch.filter(pa.array(hit if inside else ~hit))
            release()

        return docs.mapInArrow(keep, docs.schema)
