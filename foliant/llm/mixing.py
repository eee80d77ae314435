"""Mixing sources to target weights by temperature.

A source's share p of all tokens (words) becomes a weight proportional to
p ** exponent.  At exponent 1 the weights are the shares, at 0 they are equal.
Smaller exponents raise the entropy of the mix and repeat small sources more.  The
exponent is found by bisection: the largest that meets the target entropy (a part
of the most possible, ln of the number of sources), or, if that would repeat some
source more often than ``max_epochs`` allows, the smallest that keeps to the limit.

The budget is given in tokens; None means that every source is used up at
least once, so that nothing is lost: the source that the weights cut most gets exactly one
pass and the others whole and part passes by their weights.

Weights are realised as block permutations.  Documents of a source fall into blocks by
hash, of about ``block`` documents; every pass orders the blocks, and the
documents within each, by a hash of the pass.  Whole passes take all documents; the
last, partial one takes blocks in order while they begin below the source's budget, and of the
block in which it is used up the documents that begin below it.

Sums over blocks are aggregations and the running sums are over blocks, then within one
block, so no task handles a whole source.

A null source is one of its own, named ''.  A document without words (null or blank
text) has no tokens: it takes part in whole passes, and in a partial one where its
place is below the budget.  Rows that repeat a doc_id are documents of their own; rows that
also repeat the text stand at one place and a partial pass takes all of them or none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.core import Words, buffers, documents, durable, fresh, pieces

ENTROPY = 0.999
MAX_EPOCHS = 2.0
BLOCK = 1000
STEPS = 40
#: Sources whose plan (about 100 bytes each) is sent to every task; beyond it, it is joined by source and one of ``SALTS`` shares of it.
SENT_SOURCES, SALTS = 100_000, 64


def words(docs: DataFrame, name: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of words of each text."""
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n = np.diff(Words(*buffers(batch.column(where)), hashed=False).first)
            yield pa.record_batch([*batch.columns, pa.array(n.astype(np.int64))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def exponent(shares: list[float], entropy: float = ENTROPY, max_epochs: float = MAX_EPOCHS, total: float | None = None) -> float:
    """The exponent, between 0 and 1, that the target and the limit give.

    total: the budget as a multiple of all tokens; None as described above.
    """
    p = [x for x in shares if x > 0]
    if len(p) < 2:
        return 1.0

    def weights(a: float) -> list[float]:
        w = [x**a for x in p]
        s = sum(w)
        return [x / s for x in w]

    def mixed(a: float) -> bool:
        return -sum(q * math.log(q) for q in weights(a)) >= entropy * math.log(len(p))

    def within(a: float) -> bool:
        ratio = [q / x for q, x in zip(weights(a), p, strict=True)]
        return max(ratio) * (1 / min(ratio) if total is None else total) <= max_epochs

    def bisect(low: float, high: float, at_high) -> float:
        for _ in range(STEPS):
            mid = (low + high) / 2
            low, high = (low, mid) if at_high(mid) else (mid, high)
        return high

    # mixed holds up to some exponent, within from some exponent on
    wanted = 1.0 if mixed(1.0) else bisect(0.0, 1.0, lambda a: not mixed(a))
    least = 0.0 if within(0.0) else bisect(0.0, 1.0, within)
    return round(max(wanted, least), 9)


def plan(sizes: list[tuple[str, int]], entropy: float = ENTROPY, max_epochs: float = MAX_EPOCHS, budget: int | None = None) -> list[tuple[str, float, int, int, int]]:
    """(source, weight, tokens, whole passes, tokens of the partial pass)."""
    total = sum(n for _, n in sizes)
    if not total:
        return [(s, 0.0, 0, 1 if budget is None else 0, 0) for s, _ in sizes]
    shares = [n / total for _, n in sizes]
    a = exponent(shares, entropy, max_epochs, None if budget is None else budget / total)
    powered = [x**a if x > 0 else 0.0 for x in shares]
    s = sum(powered)
    weight = [x / s for x in powered]
    if budget is None:
        budget = max(n / w for (_, n), w in zip(sizes, weight, strict=True) if n)
    out = []
    for (source, n), w in zip(sizes, weight, strict=True):
        own = math.floor(w * budget + 1e-6)
        out.append((source, w, n, own // n if n else 1, own % n if n else 0))
    return out


def _key(*parts):
    """An order that SQL engines agree on."""
    return F.md5(F.concat_ws(":", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]))


def _with_plan(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Joined by source; where the table has shares of each, so that no source gathers in one task."""
    if "salt" not in table.columns:
        return rows.join(F.broadcast(table), "source")
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_md5"), F.lit(SALTS)).cast("int")).join(table, ["source", "salt"]).drop("salt")


def _shared(table: DataFrame, few: bool) -> DataFrame:
    return table if few else table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _placed(rows: DataFrame, table: DataFrame) -> DataFrame:
    """With the source's plan, the block of each row, and the order of blocks and rows in the partial pass."""
    number = F.conv(F.substring(_key("doc_id", "text_md5"), 1, 12), 16, 10).cast("long")
    return (
        _with_plan(rows, table).withColumn("block", number % F.col("blocks")).withColumn("block_key", _key("source", "whole", "block")).withColumn("row_key", _key("doc_id", "text_md5", "whole"))
    )


def _planned(docs: DataFrame, entropy: float, max_epochs: float, budget: int | None, block: int, sent: int) -> tuple[DataFrame, DataFrame, bool]:
    """The rows without their texts, the plan of each source, and whether it is small enough to be sent."""
    counted = words(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("string").alias("text")))
    rows = durable(counted.select("doc_id", "source", "n_tokens", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5")))
    # one row for each source
    found = [(r.source, int(r.tokens), int(r.n)) for r in rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).orderBy("source").collect()]
    made = plan([(s, t) for s, t, _ in found], entropy, max_epochs, budget)
    table = docs.sparkSession.createDataFrame(
        [(s, whole, part, max(1, -(-n // block))) for (s, _, _, whole, part), (_, _, n) in zip(made, found, strict=True)], "source string, whole long, part long, blocks long"
    )
    return rows, table, len(found) <= sent


def _partial(placed: DataFrame) -> DataFrame:
    """Rows of the partial passes, with the tokens before them; equal rows have the same place."""
    last = placed.filter("part > 0")
    sums = last.groupBy("source", "block", "block_key").agg(F.sum("n_tokens").alias("size"))
    by_block = W.partitionBy("source").orderBy("block_key").rowsBetween(W.unboundedPreceding, -1)
    begin = sums.select("source", "block", F.coalesce(F.sum("size").over(by_block), F.lit(0)).alias("begin"))
    inside = W.partitionBy("source", "block").orderBy("row_key").rowsBetween(W.unboundedPreceding, -1)
    opened = last.join(begin, ["source", "block"]).filter("begin < part")
    counted = opened.withColumn("start", F.col("begin") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return counted.withColumn("start", F.min("start").over(W.partitionBy("source", "block", "row_key"))).filter("start < part")


def mix(docs: DataFrame, entropy: float = ENTROPY, max_epochs: float = MAX_EPOCHS, budget: int | None = None, block: int = BLOCK, sent: int = SENT_SOURCES) -> DataFrame:
    """(doc_id, source, text_md5, n_tokens, pass, block, start): a row for each use of a document.

    start: the source's tokens before this document in the partial pass, 0 in whole ones.
    """
    rows, table, few = _planned(docs, entropy, max_epochs, budget, block, sent)
    placed = _placed(rows, _shared(table, few))
    columns = ["doc_id", "source", "text_md5", "n_tokens", "pass", "block", "start"]
    whole = placed.filter("whole > 0").withColumn("pass", F.explode(F.expr("sequence(0L, whole - 1)"))).withColumn("start", F.lit(0).cast("long"))
    return whole.select(columns).unionByName(_partial(placed).withColumn("pass", F.col("whole")).select(columns))


def mixed(docs: DataFrame, entropy: float = ENTROPY, max_epochs: float = MAX_EPOCHS, budget: int | None = None, block: int = BLOCK, sent: int = SENT_SOURCES) -> DataFrame:
    """Rows of ``docs``, all columns as they are, as often as the mix uses them.

    What a partial pass takes of a source ends at one place of its order, so that two keys
    a source tell for each row whether it is taken, and texts are not exchanged while the
    plan of all sources is small enough to be sent; beyond that rows are exchanged once, by source and share.
    """
    rows, table, few = _planned(docs, entropy, max_epochs, budget, block, sent)
    ends = _partial(_placed(rows, _shared(table, few))).groupBy("source").agg(F.max(F.struct("block_key", "row_key")).alias("end"))
    limits = durable(table.join(ends, "source", "left").select("source", "whole", "part", "blocks", F.col("end.block_key").alias("end_block"), F.col("end.row_key").alias("end_row")))
    own = fresh(docs, "mix_row")
    packed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_md5"),
        F.struct(*[docs[c] for c in docs.columns]).alias(own),
    )
    keyed = _placed(packed, _shared(limits, few))
    taken = (F.col("block_key") < F.col("end_block")) | ((F.col("block_key") == F.col("end_block")) & (F.col("row_key") <= F.col("end_row")))
    uses = F.col("whole") + F.when(taken, 1).otherwise(0)
    return keyed.withColumn("uses", uses).filter("uses > 0").withColumn("use", F.explode(F.expr("sequence(1L, uses)"))).select(f"{own}.*")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def sql(entropy: float = ENTROPY, max_epochs: float = MAX_EPOCHS, block: int = BLOCK) -> str:
    return f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS source, md5(coalesce(text, '')) AS text_md5,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\\t\\n\\x0b\\f\\r ]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS tokens, count(*) AS n FROM d GROUP BY source),
p AS (SELECT source, tokens::DOUBLE / sum(tokens) OVER () AS share FROM s),
-- both bisections at once: [lo1, hi1] for the entropy, [lo2, hi2] for the limit
b AS (
  SELECT 0 AS step, 0.0::DOUBLE AS lo1, 1.0::DOUBLE AS hi1, 0.0::DOUBLE AS lo2, 1.0::DOUBLE AS hi2
  UNION ALL
  SELECT step + 1, CASE WHEN e1 THEN (lo1 + hi1) / 2 ELSE lo1 END, CASE WHEN e1 THEN hi1 ELSE (lo1 + hi1) / 2 END,
    CASE WHEN e2 THEN lo2 ELSE (lo2 + hi2) / 2 END, CASE WHEN e2 THEN (lo2 + hi2) / 2 ELSE hi2 END
  FROM (
    SELECT *, (SELECT -sum(q * ln(q)) FROM (SELECT pow(share, (lo1 + hi1) / 2) / (SELECT sum(pow(share, (lo1 + hi1) / 2)) FROM p WHERE share > 0) AS q FROM p WHERE share > 0)) >= {entropy} * ln((SELECT count(*) FROM p WHERE share > 0)) AS e1,
      (SELECT max(pow(share, (lo2 + hi2) / 2 - 1)) / min(pow(share, (lo2 + hi2) / 2 - 1)) FROM p WHERE share > 0) <= {max_epochs} AS e2
    FROM b WHERE step < {STEPS})),
c AS (
  SELECT round(greatest(
    CASE WHEN (SELECT -sum(share * ln(share)) >= {entropy} * ln(count(*)) FROM p WHERE share > 0) THEN 1.0 ELSE hi1 END,
    CASE WHEN (SELECT max(1 / share) / min(1 / share) <= {max_epochs} FROM p WHERE share > 0) THEN 0.0 ELSE hi2 END), 9) AS a
  FROM b WHERE step = {STEPS}),
q AS (SELECT s.*, pow(share, a) / sum(pow(share, a)) OVER () AS weight FROM s JOIN p USING (source), c),
g AS (SELECT *, floor(weight * max(tokens / weight) OVER () + 1e-6)::BIGINT AS own FROM q),
t AS (SELECT source, own // tokens AS whole, own % tokens AS part, greatest(1, (n + {block - 1}) // {block}) AS blocks FROM g),
x AS (SELECT d.*, whole, part, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || text_md5), 1, 12))::BIGINT % blocks AS block FROM d JOIN t USING (source)),
k AS (SELECT source, block, sum(n_tokens) AS size, any_value(whole) AS pass FROM x WHERE part > 0 GROUP BY source, block),
z AS (SELECT source, block, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(source || ':' || pass || ':' || block) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM k),
o AS (
  SELECT x.*, md5(coalesce(doc_id::VARCHAR, '') || ':' || text_md5 || ':' || whole) AS row_key, (begin + coalesce(sum(n_tokens) OVER (PARTITION BY source, block ORDER BY md5(coalesce(doc_id::VARCHAR, '') || ':' || text_md5 || ':' || whole) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS place
  FROM x JOIN z USING (source, block) WHERE part > 0),
l AS (SELECT *, min(place) OVER (PARTITION BY source, block, row_key) AS start FROM o)
SELECT doc_id, source, text_md5, n_tokens, pass, block, 0::BIGINT AS start FROM (SELECT *, unnest(range(0, whole)) AS pass FROM x)
UNION ALL
SELECT doc_id, source, text_md5, n_tokens, whole AS pass, block, start FROM l WHERE start < part
"""


SQL = sql()
