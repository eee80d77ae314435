"""Repetition coverage of documents.

Every word n-gram of a text gets a rolling hash, all lengths and many texts at
once in numpy; duplicates inside a text are equal hashes side by side after a
sort.  A longer n-gram can repeat only where both its shorter parts do, so each
length looks only at places that the one before has left.

Measures, in characters of words (white space not counted) unless said:

* ``top_n`` for n = 2, 3, 4: the largest product of occurrences (three at
  least) and length among the text's n-grams; overlapping occurrences count each;
* ``dup_n`` for n = 5 ... 10: characters of words inside any n-gram that occurs
  twice or more, each word once;
* ``n_dup_lines``, ``dup_line_chars``: lines with words that were there before.

A document is kept while every measure is within its share of the text (the
usual published thresholds).  A null or blank text measures 0 and is kept; every
row gives one row, repeated and null doc_ids included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foliant.llm.core import U, Words, buffers, documents, id_text, mix, pieces, spans_hash

TOP = {2: 20, 3: 18, 4: 16}
DUP = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINES, LINE_CHARS = 30, 20
LEAST = 3
COLUMNS = ["n_words", "n_word_chars", "n_lines", "n_dup_lines", "line_chars", "dup_line_chars", *[f"top_{n}" for n in TOP], *[f"dup_{n}" for n in DUP]]


def _same(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that brings equal keys together, where each run begins, and run lengths."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    begin = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return order, begin, np.diff(np.r_[begin, len(k)])


def measure(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each text."""
    docs = len(off) - 1
    out = {c: np.zeros(docs, np.int64) for c in COLUMNS}
    chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    w = Words(data, off)
    size = chars[w.end] - chars[w.start]
    upto = np.r_[0, np.cumsum(size)]
    out["n_words"] = np.diff(w.first)
    out["n_word_chars"] = upto[w.first[1:]] - upto[w.first[:-1]]
    salt = mix(np.arange(1, docs + 1, dtype=np.uint64) * U(0xA24BAED4963EE407))
    # lines: from a text's start or after a line break up to the next break or the text's end
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([off[:-1], breaks + 1]))
    begin = begin[begin < len(data)]
    if len(begin):
        doc = np.searchsorted(off, begin, side="right") - 1
        stop = np.minimum(np.r_[breaks, len(data)][np.searchsorted(breaks, begin)], off[doc + 1])
        a, b = np.searchsorted(w.start, begin), np.searchsorted(w.start, stop)
        full = b > a
        doc, begin, stop = doc[full], begin[full], stop[full]
        length = chars[stop] - chars[begin]
        np.add.at(out["n_lines"], doc, 1)
        np.add.at(out["line_chars"], doc, length)
        order, run, count = _same(mix(spans_hash(data, begin, stop) ^ salt[doc]))
        again = np.ones(len(order), bool)
        again[run] = False
        again = order[again]
        np.add.at(out["n_dup_lines"], doc[again], 1)
        np.add.at(out["dup_line_chars"], doc[again], length[again])
    # n-grams
    h = w.hash
    alive = np.arange(len(h))
    gram = h.copy()
    for n in range(2, max(DUP) + 1):
        alive = alive[alive + n - 1 < len(h)]
        alive = alive[w.doc[alive] == w.doc[alive + n - 1]]
        if not len(alive):
            break
        with np.errstate(over="ignore"):
            gram[alive] = mix(gram[alive] * U(0x9E3779B97F4A7C15) + h[alive + n - 1])
            order, run, count = _same(mix(gram[alive] ^ salt[w.doc[alive]]))
        if n in TOP:
            often = run[count >= LEAST]
            at = alive[order[often]]
            np.maximum.at(out[f"top_{n}"], w.doc[at], count[count >= LEAST] * (upto[at + n] - upto[at]))
        twice = np.sort(alive[order[np.repeat(count > 1, count)]])
        if n in DUP:
            step = np.zeros(len(h) + 1, np.int64)
            np.add.at(step, twice, 1)
            np.add.at(step, twice + n, -1)
            inside = np.flatnonzero(np.cumsum(step)[:-1] > 0)
            np.add.at(out[f"dup_{n}"], w.doc[inside], size[inside])
        # the next length can repeat only where this one does at two places in a row
        alive = twice[np.isin(twice + 1, twice, assume_unique=True)] if len(twice) else twice
    return out


def verdict(m: dict[str, np.ndarray]) -> np.ndarray:
    keep = (100 * m["n_dup_lines"] <= LINES * m["n_lines"]) & (100 * m["dup_line_chars"] <= LINE_CHARS * m["line_chars"])
    for name, limits in (("top", TOP), ("dup", DUP)):
        for n, share in limits.items():
            keep &= 100 * m[f"{name}_{n}"] <= share * m["n_word_chars"]
    return keep


def repetition(docs: DataFrame) -> DataFrame:
    """(doc_id, measures, keep), a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            m = measure(*buffers(batch.column(1)))
            yield pa.record_batch([batch.column(0), *[pa.array(m[c]) for c in COLUMNS], pa.array(verdict(m))], names=["doc_id", *COLUMNS, "keep"])

    return id_text(docs).mapInArrow(run, ", ".join(["doc_id long", *[f"{c} long" for c in COLUMNS], "keep boolean"]))


def op4_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(documents(spark, sf_dir))


def _sql() -> str:
    grams, parts, columns = [], [], []
    for n in [*TOP, *DUP]:
        words = " || ' ' || ".join(["w"] + [f"lead(w, {j}) OVER s" for j in range(1, n)])
        chars = " + ".join(["c"] + [f"lead(c, {j}) OVER s" for j in range(1, n)])
        grams.append(f"g{n} AS (SELECT k, p, {words} AS g, {chars} AS c FROM x WINDOW s AS (PARTITION BY k ORDER BY p))")
        if n in TOP:
            parts.append(f"t{n} AS (SELECT k, max(v) AS v FROM (SELECT k, g, count(*) * any_value(c) AS v FROM g{n} WHERE g IS NOT NULL GROUP BY k, g HAVING count(*) >= {LEAST}) GROUP BY k)")
            columns.append((f"top_{n}", f"t{n}"))
        else:
            parts.append(f"d{n} AS (SELECT k, p, count(*) OVER (PARTITION BY k, g) AS n FROM g{n} WHERE g IS NOT NULL)")
            parts.append(f"t{n} AS (SELECT k, sum(c) AS v FROM x SEMI JOIN (SELECT DISTINCT k, p + j AS p FROM d{n}, range(0, {n}) t(j) WHERE n > 1) q USING (k, p) GROUP BY k)")
            columns.append((f"dup_{n}", f"t{n}"))
    keep = [f"100 * n_dup_lines <= {LINES} * n_lines", f"100 * dup_line_chars <= {LINE_CHARS} * line_chars"]
    keep += [f"100 * top_{n} <= {s} * n_word_chars" for n, s in TOP.items()] + [f"100 * dup_{n} <= {s} * n_word_chars" for n, s in DUP.items()]
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
v AS (SELECT k, list_filter(string_split_regex(text, '[\\t\\n\\x0b\\f\\r ]+'), lambda x: x <> '') AS ws FROM d),
x AS (SELECT k, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS w, length(unnest(ws)) AS c FROM v),
a AS (SELECT k, count(*) AS n_words, sum(c) AS n_word_chars FROM x GROUP BY k),
l AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT k, line, count(*) AS n, length(line) AS c FROM l WHERE regexp_matches(line, '[^\\t\\n\\x0b\\f\\r ]') GROUP BY k, line),
y AS (SELECT k, sum(n) AS n_lines, sum(n - 1) AS n_dup_lines, sum(n * c) AS line_chars, sum((n - 1) * c) AS dup_line_chars FROM m GROUP BY k),
{", ".join(grams)}, {", ".join(parts)},
r AS (SELECT d.doc_id, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in COLUMNS[:6])}, {", ".join(f"coalesce({t}.v, 0)::BIGINT AS {c}" for c, t in columns)}
FROM d LEFT JOIN a USING (k) LEFT JOIN y USING (k) {" ".join(f"LEFT JOIN {t} USING (k)" for _, t in columns)})
SELECT *, {" AND ".join(keep)} AS keep FROM r
"""


SQL = _sql()
