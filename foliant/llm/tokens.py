"""Token sequences as Arrow files with fixed-size lists.

Texts are encoded with a public byte-level BPE vocabulary (its path is a
parameter).  White space bounds its pre-tokens, so a text falls apart into
pieces, each a run of non-space bytes with the space before it, that encode
independently; numpy cuts and hashes the pieces and every distinct one is encoded
once per task.  Texts with white space outside ASCII are encoded whole.

Each text is cut into sequences of exactly ``length`` tokens, the last one padded
with 0, and a mask tells tokens (1) from padding (0).  Sequences of a task are
written to files in Arrow's random-access format, one record batch each::

    doc_id int64, first int64, input_ids fixed_size_list<uint16>[length], attention_mask fixed_size_list<uint8>[length]

``first`` is the number of the sequence's first token in its text.  As every row
has the same width, row k of a memory-mapped file is the slice
``[k * length, (k + 1) * length)`` of one flat buffer (`open_sequences`).

A null or empty text has no tokens and no sequence.  Rows that repeat a doc_id
have sequences each; a null doc_id stays null.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foliant.llm.core import _SPACE, buffers, documents, id_text, pieces, spans_hash

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTH = 512
#: Sequences of one file.
FILE_ROWS = 8192
#: Distinct pieces a task remembers; it starts over beyond that.
REMEMBERED = 1_000_000
SCHEMA = "doc_ids array<long>, n_sequences long, n_tokens long, data binary"


class Encoder:
    """Token ids of many texts; one per task."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.dtype = np.uint16 if len(ranks) < 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.dtype)

    def _learn(self, hashes: np.ndarray, raw: list[bytes]) -> None:
        tokens = [self.bpe.encode_ordinary(r.decode("utf-8")) for r in raw]
        size = np.array([len(t) for t in tokens], np.int64)
        begin = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, *[np.array(t, self.dtype) for t in tokens]])
        known, begin, size = np.r_[self.known, hashes], np.r_[self.begin, begin], np.r_[self.size, size]
        order = np.argsort(known)
        self.known, self.begin, self.size = known[order], begin[order], size[order]

    def _pieces(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the pieces, in order; they cover all bytes."""
        n = len(data)
        space = _SPACE[data]
        first = np.zeros(n + 1, bool)
        first[off] = True
        head, last = first[:-1], first[1:]
        after = np.ones(n, bool)  # whether a space or the text's end follows
        after[:-1] = space[1:]
        after |= last
        before = np.ones(n, bool)
        before[1:] = space[:-1]
        before |= head
        start = head.copy()
        # the last white space of a run, if something follows it, begins a piece of its own
        start |= space & ~after
        # a run of white space begins after something else
        start[1:] |= space[1:] & ~space[:-1]
        # a word joins one blank before it; another white-space byte stays alone
        start[1:] |= ~space[1:] & space[:-1] & (data[:-1] != 32)
        bounds = np.flatnonzero(start)
        return bounds, np.r_[bounds[1:], n]

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in a row, and where each text's begin."""
        docs = len(off) - 1
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(docs + 1, np.int64)
        a, b = self._pieces(data, off)
        h = spans_hash(data, a, b)
        distinct, where, of = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > REMEMBERED:
            self.clear()
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.known):
            new = self.known[np.minimum(at, len(self.known) - 1)] != distinct
        if new.any():
            raw = data.tobytes()
            self._learn(distinct[new], [raw[a[k] : b[k]] for k in where[new]])
            at = np.searchsorted(self.known, distinct)
        size = self.size[at][of]
        doc = np.searchsorted(off, a, side="right") - 1
        total = np.cumsum(size)
        take = np.repeat(self.begin[at][of] - (total - size), size) + np.arange(total[-1])
        tokens = self.flat[take]
        count = np.bincount(doc, weights=size, minlength=docs).astype(np.int64)
        odd = self._wide(data, off)
        if len(odd):
            edge = np.r_[0, np.cumsum(count)]
            parts, at = [], 0
            for d in odd:
                own = np.array(self.bpe.encode_ordinary(data[off[d] : off[d + 1]].tobytes().decode("utf-8")), self.dtype)
                parts += [tokens[at : edge[d]], own]
                at, count[d] = edge[d + 1], len(own)
            tokens = np.concatenate([*parts, tokens[at:]])
        return tokens, np.r_[0, np.cumsum(count)]

    @staticmethod
    def _wide(data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Texts that may hold white space, or a separator that counts as such, outside the common six."""
        hit = (data >= 28) & (data <= 31)
        if len(data) > 1:
            two = (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
            three = ((data[:-1] == 0xE1) & (data[1:] == 0x9A)) | ((data[:-1] == 0xE2) & ((data[1:] == 0x80) | (data[1:] == 0x81))) | ((data[:-1] == 0xE3) & (data[1:] == 0x80))
            hit[:-1] |= two | three
        return np.unique(np.searchsorted(off, np.flatnonzero(hit), side="right") - 1)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns and n_tokens of each row; a null text has 0."""
    kept = docs.select(*carry, docs["text"].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in pieces(batches):
            _, first = encoder.encode(*buffers(batch.column("text")))
            yield pa.record_batch([*[batch.column(c) for c in carry], pa.array(np.diff(first))], names=[*carry, "n_tokens"])

    schema = ", ".join([f"`{c}` {t}" for c, t in kept.dtypes if c != "text"] + ["n_tokens long"])
    return kept.mapInArrow(run, schema)


def _schema(length: int, dtype) -> pa.Schema:
    ids = pa.list_(pa.field("item", pa.from_numpy_dtype(dtype), nullable=False), length)
    mask = pa.list_(pa.field("item", pa.uint8(), nullable=False), length)
    return pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), pa.field("input_ids", ids, nullable=False), pa.field("attention_mask", mask, nullable=False)])


def _file(ids: list, first: np.ndarray, tokens: np.ndarray, mask: np.ndarray) -> bytes:
    schema = _schema(tokens.shape[1], tokens.dtype)
    lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), type=schema.field(k).type) for k, x in ((2, tokens), (3, mask))]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, schema) as writer:
        writer.write_batch(pa.record_batch([pa.array(ids, pa.int64()), pa.array(first), *lists], schema=schema))
    return sink.getvalue().to_pybytes()


def sequences(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, file_rows: int = FILE_ROWS) -> DataFrame:
    """One row for each Arrow file: its doc_ids (one for each sequence), sequences, tokens, and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        held: list[tuple] = []
        rows = 0

        def cut(final: bool):
            nonlocal held, rows
            while rows >= file_rows or (final and rows):
                ids, first, tokens, size = (np.concatenate([h[k] for h in held]) for k in range(4))
                missing = np.concatenate([h[4] for h in held])
                take = min(rows, file_rows)
                mask = (np.arange(length) < size[:take, None]).astype(np.uint8)
                own = [None if m else i for i, m in zip(ids[:take].tolist(), missing[:take].tolist(), strict=True)]
                yield own, take, int(size[:take].sum()), _file(own, first[:take], tokens[:take], mask)
                rows -= take
                held = [(ids[take:], first[take:], tokens[take:], size[take:], missing[take:])] if rows else []

        def out(files):
            for own, n, total, data in files:
                yield pa.record_batch([pa.array([own], pa.list_(pa.int64())), pa.array([n], pa.int64()), pa.array([total], pa.int64()), pa.array([data], pa.binary())], names=["doc_ids", "n_sequences", "n_tokens", "data"])

        for batch in pieces(batches):
            ids = batch.column(0)
            tokens, first = encoder.encode(*buffers(batch.column(1)))
            size = np.diff(first)
            count = -(-size // length)
            doc = np.repeat(np.arange(len(size)), count)
            if not len(doc):
                continue
            at = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * length
            filled = np.minimum(length, size[doc] - at)
            grid = np.zeros((len(doc), length), encoder.dtype)
            place = np.repeat(np.arange(len(doc)) * length - (np.cumsum(filled) - filled), filled) + np.arange(filled.sum())
            grid.ravel()[place] = tokens
            null = ~np.asarray(ids.is_valid())
            held.append((ids.fill_null(0).to_numpy(zero_copy_only=False)[doc], at, grid, filled, null[doc]))
            rows += len(doc)
            yield from out(cut(False))
        yield from out(cut(True))

    return id_text(docs).mapInArrow(run, SCHEMA)


def write_sequences(docs: DataFrame, folder: str, length: int = LENGTH, vocabulary: str = VOCABULARY, file_rows: int = FILE_ROWS) -> DataFrame:
    """Write the files to ``folder``, which all executors share, and return what each holds.

    A file is named by its content and moved into place whole, so a task that
    runs twice leaves the same file once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import os

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            names = []
            for data in batch.column("data"):
                raw = data.as_buffer()
                name = os.path.join(folder, hashlib.sha1(raw).hexdigest() + ".arrow")
                part = f"{name}.{os.getpid()}"
                with open(part, "wb") as f:
                    f.write(raw)
                os.replace(part, name)
                names.append(name)
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(names)], names=["doc_ids", "n_sequences", "n_tokens", "path"])

    return sequences(docs, length, vocabulary, file_rows).mapInArrow(run, "doc_ids array<long>, n_sequences long, n_tokens long, path string")


def open_sequences(source) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_id, first, input_ids (rows x length) and mask of a file's bytes or path, without a copy."""
    reader = pa.ipc.open_file(pa.memory_map(source) if isinstance(source, str) else pa.BufferReader(source))
    batch = reader.get_batch(0)
    length = batch.schema.field(2).type.list_size
    ids, mask = (batch.column(k).values.to_numpy(zero_copy_only=True).reshape(-1, length) for k in (2, 3))
    return batch.column(0), batch.column(1).to_numpy(), ids, mask


def op1_token_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(documents(spark, sf_dir))
