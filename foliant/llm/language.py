"""Language of web pages by Bayesian evidence fusion.

Four pieces of evidence are multiplied for each page and language:

* the text's likelihood under byte-trigram counts of each language, learned from every
  labelled document (tags, scripts and styles are cut from the page first; the log
  likelihood counts for ``TEMPER`` of its size, as neighbouring trigrams depend on each other);
* the declared language of the markup (``<html lang=...>``), and
* the address suffix (last label of the host), each by how often pages that the text
  alone assigns to a language declare that value or have that suffix;
* the host's prior: the text's posterior summed over the host's other pages, smoothed
  towards that of its parent domain (the last three labels), this towards the suffix, and
  this towards all pages.

All of these are sums grouped by value, suffix, domain and host; a page's own share is
taken out of its host's sums, so that it does not vouch for itself.

A null or empty html has no text evidence and is decided by the rest; null or odd urls
have host ''.  Ties go to the language first in the alphabet.  Every row gives one row,
null and repeated page_ids included.  Without labelled documents there are no languages and
``language`` is null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.core import buffers, documents, durable, pieces

SLOTS = 1 << 15
TEMPER = 0.2
#: Pages that a parent's distribution counts for in that of its child.
SMOOTHING = 5.0
#: Weight of one vote spread over all values, in the tables of declarations and suffixes.
VOTE = 1.0

_CUT = re.compile(r"<!--.*?-->|<(script|style|noscript)\b[^>]*>.*?</\1\s*>|<[^>]*>|&[#\w]+;", re.S | re.I)
#: The first outside comments and scripts counts, wherever it stands.
_DECLARED = re.compile(r"<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})", re.S | re.I)


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and slot of the byte trigrams, ASCII case folded; digits and marks count as blanks."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = _FOLD[data].astype(np.uint32)
    key = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(key)]
    inside = np.repeat(off[1:], np.diff(off))[: len(key)] - np.arange(len(key)) >= 3
    slot = ((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)).astype(np.int64)
    return doc[inside], slot[inside]


_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _counts(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {n: k for k, n in enumerate(names)}
        for batch in pieces(batches):
            lang = np.array([number[v] for v in batch.column("lang").to_pylist()], np.int64)
            doc, slot = trigrams(*buffers(batch.column("text")))
            at, n = np.unique(lang[doc] * SLOTS + slot, return_counts=True)
            yield pa.record_batch([pa.array(at // SLOTS), pa.array(at % SLOTS), pa.array(n)], names=["language", "slot", "n"])

    return run


def model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities of the slots in each: counts over all documents with a language."""
    labelled = docs.select(F.col("text").cast("string").alias("text"), F.lower(F.trim(F.col("lang").cast("string"))).alias("lang")).filter("lang <> '' AND text IS NOT NULL")
    names = sorted(r.lang for r in labelled.select("lang").distinct().collect())
    if not names:
        return [], np.zeros((0, SLOTS))
    found = labelled.mapInArrow(_counts(names), "language long, slot long, n long").groupBy("language", "slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((len(names), SLOTS), 0.5)
    table[found.column("language").to_numpy(), found.column("slot").to_numpy()] += found.column("n").to_numpy()
    return names, np.log(table / table.sum(axis=1, keepdims=True))


def host_of(url):
    """Host of an address in lower case, '' if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _evidence(names: list[str], weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        for batch in pieces(batches, column="html"):
            html = batch.column("html").to_pylist()
            declared = [next((m[1].lower() for m in _DECLARED.finditer(h or "") if m[1]), "") for h in html]
            text = pa.array([_CUT.sub(" ", h) if h else "" for h in html], pa.large_string())
            doc, slot = trigrams(*buffers(text))
            n = len(html)
            logs = np.stack([np.bincount(doc, weights=table[k][slot], minlength=n) for k in range(len(names))], axis=1) * TEMPER
            logs = np.round(logs, 6)
            yield pa.record_batch(
                [*[batch.column(c) for c in ("row", "page_id", "host")], pa.array(declared), pa.array(list(logs), pa.list_(pa.float64())), pa.array(list(_normal(logs)), pa.list_(pa.float64()))],
                names=["row", "page_id", "host", "declared", "logs", "posterior"],
            )

    return run


def _normal(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _sums(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array(*[F.sum(F.col("posterior")[k]) for k in range(n)]).alias("sums"))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, host, declared, language, probability, text_language) of each page."""
    spark = pages.sparkSession
    names, table = model(docs)
    host = host_of(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.col("html").cast("string").alias("html")).withColumn("row", F.monotonically_increasing_id())
    if not names:
        none = F.lit(None).cast("string")
        return rows.select("page_id", "host", none.alias("declared"), none.alias("language"), F.lit(None).cast("double").alias("probability"), none.alias("text_language"))
    n = len(names)
    sent = spark.sparkContext.broadcast(table)
    seen = rows.mapInArrow(_evidence(names, sent), "row long, page_id long, host string, declared string, logs array<double>, posterior array<double>")
    labels = F.split("host", r"\.")
    seen = seen.withColumn("suffix", F.element_at(labels, -1)).withColumn("domain", F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 2), F.lit(3)), "."))
    seen = durable(seen)
    hosts = durable(_sums(seen, n, "suffix", "domain", "host"))

    def up(child: DataFrame, *keys: str) -> DataFrame:
        return child.groupBy(*keys).agg(F.array(*[F.sum(F.col("sums")[k]) for k in range(n)]).alias("sums"))

    domains = up(hosts, "suffix", "domain")
    suffixes = up(domains, "suffix")
    everything = np.array(suffixes.agg(*[F.sum(F.col("sums")[k]) for k in range(n)]).first() or [0.0] * n, dtype=float)
    overall = (np.nan_to_num(everything) + 1) / (np.nan_to_num(everything).sum() + n)

    def smooth(sums: str, parent) -> F.Column:
        return F.expr(f"transform(sums, (x, i) -> (x + {SMOOTHING} * {parent}[i]) / (aggregate(sums, 0D, (a, x) -> a + x) + {SMOOTHING}))".replace("sums", sums))

    level = suffixes.withColumn("over", F.array(*[F.lit(float(x)) for x in overall]))
    level = level.select("suffix", smooth("sums", "over").alias("by_suffix"))
    level = domains.join(level, "suffix").select("suffix", "domain", smooth("sums", "by_suffix").alias("by_domain"))
    priors = hosts.join(level, ["suffix", "domain"]).select("host", F.col("sums").alias("host_sums"), "by_domain")

    def likelihood(column: str) -> DataFrame:
        """Log probability of each value under each language, with one vote spread over all values."""
        sums = _sums(seen, n, column)
        total = sums.agg(F.array(*[F.sum(F.col("sums")[k]) for k in range(n)]).alias("total"), F.count("*").alias("kinds"))
        return sums.crossJoin(F.broadcast(total)).select(column, F.expr(f"transform(sums, (x, i) -> ln((x + {VOTE} / kinds) / (total[i] + {VOTE})))").alias(f"log_{column}"))

    fused = seen.join(priors, "host").join(likelihood("declared"), "declared").join(likelihood("suffix"), "suffix")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            logs, own, sums, domain, declared, suffix = (np.array(batch.column(c).flatten()).reshape(-1, n) for c in ("logs", "posterior", "host_sums", "by_domain", "log_declared", "log_suffix"))
            others = np.maximum(0, sums - own)
            prior = (others + SMOOTHING * domain) / (others.sum(axis=1, keepdims=True) + SMOOTHING)
            # a suffix that all languages share says nothing; one's own vote is a part of few only
            p = _normal(logs + declared + suffix + np.log(prior))
            best = np.argmax(np.round(p, 9), axis=1)
            text = np.argmax(np.round(own, 9), axis=1)
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("host"), batch.column("declared"), pa.array([names[k] for k in best]), pa.array(np.round(p[np.arange(len(best)), best], 6)), pa.array([names[k] for k in text])],
                names=["page_id", "host", "declared", "language", "probability", "text_language"],
            )

    return fused.mapInArrow(decide, "page_id long, host string, declared string, language string, probability double, text_language string")


def op10_page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), documents(spark, sf_dir))
