"""Extendible hashing of documents into shards of bounded size.

A row's key is 60 bits of the MD5 of its doc_id and text.  The directory starts as
one bucket; a bucket over the byte limit splits on the next bit of the key, and
only such buckets do, until every bucket fits.  Rows with the same key can't be
told apart by any bit: a bucket with one distinct key stays whole, whatever its size
(a single document over the limit, or copies of one row), and has
``over_limit`` set.

Rows travel as (key, bytes), equal ones once with their number.  They are exchanged by the
first bits of the key, as many as all buckets are sure to be split on (one number each is
aggregated to tell), and each task splits the buckets of its prefixes.  There is no
directory in the driver, and none is sent.

A shard's name is its prefix in binary digits, '' for the whole table.  A null or
empty text has 0 bytes.  Null doc_ids and repeated rows are placed like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.core import documents, durable

LIMIT = 16 << 20
BITS = 60


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_bytes) of each row."""
    doc_id, text = F.col("doc_id").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.coalesce(doc_id, F.lit("")), F.lit(":"), text))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long").alias("key"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )


def split(keys: np.ndarray, size: np.ndarray, depth: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Depth of each key's bucket, and whether it is over the limit; keys are in order and share their first ``depth`` bits."""
    total = np.r_[0, np.cumsum(size)]
    out, over = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    todo = [(0, len(keys), depth)] if len(keys) else []
    while todo:
        a, b, d = todo.pop()
        fits = total[b] - total[a] <= limit
        if fits or keys[a] == keys[b - 1]:
            out[a:b], over[a:b] = d, not fits
            continue
        half = (int(keys[a]) >> (BITS - d) << (BITS - d)) + (1 << (BITS - d - 1))
        mid = a + int(np.searchsorted(keys[a:b], half))
        todo += [(x, y, d + 1) for x, y in ((a, mid), (mid, b)) if y > x]
    return out, over


def first_bits(rows: DataFrame, limit: int = LIMIT) -> int:
    """Bits that every bucket is split on, a few less than the mean bucket's."""
    total = int(rows.agg(F.sum(F.col("n_bytes") * F.col("times"))).first()[0] or 0)
    bits = min(30, max(0, total // max(1, limit)).bit_length() - 2)
    if bits <= 0:
        return 0
    sums = durable(rows.groupBy(F.shiftright("key", BITS - bits).alias("p")).agg(F.sum(F.col("n_bytes") * F.col("times")).alias("b")))
    while bits > 0:
        # the parents of the prefixes are all over the limit, and there is none without rows
        least = sums.groupBy(F.shiftright("p", 1).alias("p")).agg(F.sum("b").alias("b")).agg(F.min("b"), F.count("*")).first()
        if least[0] > limit and least[1] == 1 << (bits - 1):
            break
        bits -= 1
        sums = sums.groupBy(F.shiftright("p", 1).alias("p")).agg(F.sum("b").alias("b"))
    return bits


def shard(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, shard, over_limit) of each row."""
    rows = durable(keyed(docs).groupBy("key", "doc_id", "n_bytes").agg(F.count("*").alias("times")))
    bits = first_bits(rows, limit)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of their keys; a prefix is done when the next one begins."""
        held: list[pa.RecordBatch] = []

        def done(upto: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(upto)
            keys, size = table.column("key").to_numpy(), table.column("n_bytes").to_numpy() * table.column("times").to_numpy()
            depth, over = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
            edge = np.flatnonzero(np.r_[True, (keys[1:] >> (BITS - bits)) != (keys[:-1] >> (BITS - bits)), True])
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                depth[a:b], over[a:b] = split(keys[a:b], size[a:b], bits, limit)
            names = [format(k >> (BITS - d), f"0{d}b") if d else "" for k, d in zip(keys.tolist(), depth.tolist(), strict=True)]
            table = table.combine_chunks()
            return pa.record_batch([*[table.column(c).combine_chunks() for c in ("doc_id", "n_bytes", "times")], pa.array(names, pa.string()), pa.array(over)], names=["doc_id", "n_bytes", "times", "shard", "over_limit"])

        for batch in batches:
            if not batch.num_rows:
                continue
            prefix = batch.column("key").to_numpy() >> (BITS - bits)
            cut = int(np.searchsorted(prefix, prefix[-1]))
            if held and prefix[0] != int(held[-1].column("key")[-1].as_py()) >> (BITS - bits):
                yield done(held)
                held = []
            if cut:
                yield done([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield done(held)

    placed = rows.repartition(F.shiftright("key", BITS - bits)).sortWithinPartitions("key").mapInArrow(place, "doc_id long, n_bytes long, times long, shard string, over_limit boolean")
    return placed.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("doc_id", "n_bytes", "shard", "over_limit")


def op6_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))


def sql(limit: int = LIMIT) -> str:
    return f"""
WITH RECURSIVE k AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, {BITS // 4}))::BIGINT AS key
  FROM documents),
t AS (
  SELECT r, doc_id, n_bytes, key, 0 AS depth, sum(n_bytes) OVER () AS total, min(key) OVER () < max(key) OVER () AS several FROM k
  UNION ALL
  SELECT r, doc_id, n_bytes, key, depth + 1, sum(n_bytes) OVER (PARTITION BY key >> ({BITS - 1} - depth)), min(key) OVER (PARTITION BY key >> ({BITS - 1} - depth)) < max(key) OVER (PARTITION BY key >> ({BITS - 1} - depth))
  FROM t WHERE total > {limit} AND several)
SELECT doc_id, n_bytes, CASE depth WHEN 0 THEN '' ELSE substr(right(('0000' || key::BIT::VARCHAR), {BITS}), 1, depth) END AS shard, total > {limit} AS over_limit
FROM t WHERE total <= {limit} OR NOT several
"""


SQL = sql()
