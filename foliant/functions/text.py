"""Text repair as a fixed chain of column expressions, each with a count of what it repairs.

Order matters: every step counts its matches before it replaces them and hands the
result on.  White space is Unicode's, spelled out so that other engines agree.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\t-\r\x{85}\p{Z}]"
COUNTERS = ["double_spaces", "ocr_ligatures", "smart_quotes", "encoding", "punctuation", "unicode"]
LIGATURES = dict(zip("\ufb00\ufb01\ufb02\ufb03\ufb04", ["ff", "fi", "fl", "ffi", "ffl"], strict=True))
QUOTES = {"\u201c": '"', "\u201d": '"', "\u2018": "'", "\u2019": "'", "\u201a": ",", "\u2013": "-", "\u2014": "--", "\u2026": "...", "\u00a0": " "}
#: Letters that a Latin-1 reading of UTF-8 turns into two characters.
MISREAD = "éèëàüñçöä£»«°"
PAIRS = {c.encode().decode("latin-1"): c for c in MISREAD}


@dataclass(frozen=True)
class Step:
    name: str
    counter: str
    pattern: str = ""
    replacement: str = ""
    table: tuple[tuple[str, str], ...] = ()


STEPS = [
    Step("runs_of_spaces", "double_spaces", r"[ \t]{2,}", " "),
    Step("space_before_mark", "double_spaces", SPACE + r"+([.,;:!?])", "$1"),
    Step("ligatures", "ocr_ligatures", table=tuple(LIGATURES.items())),
    Step("quotes", "smart_quotes", table=tuple(QUOTES.items())),
    Step("misread", "encoding", table=tuple(PAIRS.items())),
    Step("long_ellipsis", "punctuation", r"\.{4,}", "..."),
    Step("sentence_space", "punctuation", r"([.!?])([A-Z])", "$1 $2"),
    Step("commas", "punctuation", r",{2,}", ","),
    Step("terminators", "punctuation", r"([!?]){4,}", "$1$1$1"),
]


def composed(text: pa.Array) -> pa.Array:
    """NFC.  Arrow's own kernel leaves some decomposed letters of longer columns as they are, so only the test for ASCII is left to it."""
    odd = np.flatnonzero(pc.fill_null(pc.invert(pc.string_is_ascii(text)), False).to_numpy(zero_copy_only=False))
    if not len(odd):
        return text
    values = text.to_pylist()
    for k in odd:
        if not unicodedata.is_normalized("NFC", values[k]):
            values[k] = unicodedata.normalize("NFC", values[k])
    return pa.array(values, text.type)


@F.arrow_udf(T.StringType())
def nfc(text: pa.Array) -> pa.Array:
    return composed(text)


def swap(text: Column, table) -> Column:
    for old, new in table:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def found(text: Column, step: Step) -> Column:
    """Matches of a step in a text that it has not yet changed."""
    if step.pattern:
        return F.regexp_count(text, F.lit(step.pattern))
    if all(len(old) == 1 for old, _ in step.table):
        return F.length(text) - F.length(F.translate(text, "".join(old for old, _ in step.table), ""))
    return F.length(text) - F.length(swap(text, step.table))


def repaired(text: Column, step: Step) -> Column:
    return F.regexp_replace(text, step.pattern, step.replacement) if step.pattern else swap(text, step.table)


def _chain(steps: list[Step], compose: bool):
    """All steps on a column of texts: a struct of the text and its counters."""

    def run(text: pa.Array) -> pa.Array:
        counts = {c: pa.array(np.zeros(len(text), np.int64)) for c in COUNTERS}
        for step in steps:
            if step.pattern:
                n, new = pc.count_substring_regex(text, step.pattern), pc.replace_substring_regex(text, step.pattern, re.sub(r"[$](\d)", r"\\\1", step.replacement))
            else:
                new = text
                for old, to in step.table:
                    new = pc.replace_substring(new, old, to)
                single = all(len(old) == 1 for old, _ in step.table)
                n = pc.count_substring_regex(text, "[" + "".join(re.escape(old) for old, _ in step.table) + "]") if single else pc.subtract(pc.utf8_length(text), pc.utf8_length(new))
            counts[step.counter] = pc.add(counts[step.counter], pc.fill_null(pc.cast(n, pa.int64()), 0))
            text = new
        if compose:
            new = composed(text)
            counts["unicode"] = pc.fill_null(pc.cast(pc.not_equal(text, new), pa.int64()), 0)
            text = new
        return pa.StructArray.from_arrays([text, *counts.values()], names=["text", *counts])

    return run


def clean(df: DataFrame, column: str = "text", ocr: bool = True, quotes: bool = True, misread: bool = True, punctuation: bool = True, spaces: bool = True, compose: bool = True) -> DataFrame:
    """``df`` with the text repaired and a column for each counter; a null text stays null and counts 0."""
    chosen = {"double_spaces": spaces, "ocr_ligatures": ocr, "smart_quotes": ocr and quotes, "encoding": misread, "punctuation": punctuation}
    kind = T.StructType([T.StructField("text", T.StringType()), *[T.StructField(c, T.LongType()) for c in COUNTERS]])
    chain = F.arrow_udf(_chain([s for s in STEPS if chosen[s.counter]], compose), kind)
    out = df.withColumn("repaired__", chain(F.col(column)))
    return out.select(*[F.col("repaired__.text").alias(c) if c == column else F.col(c) for c in df.columns], *[F.col(f"repaired__.{c}").alias(c) for c in COUNTERS])


#: Defects put into clean text, to give the repair something to do; literal replacements in order.
DEFECTS = [(", ", " ,, "), (". ", ".....  "), (".\n", ".A"), (" the ", " \ufb01\u201cthe\u201d\u00a0; "), (" de ", " de!?!?! "), ("\u00e9", "\u00c3\u00a9"), ("an", "a\u0301n"), (" in ", "\u2014in\u2026 ")]


def spoil(text: Column) -> Column:
    return swap(text, DEFECTS)


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def spoil_sql(text: str) -> str:
    for old, new in DEFECTS:
        text = f"replace({text}, {_literal(old)}, {_literal(new)})"
    return text


def clean_sql(source: str, keys: str) -> str:
    """The same chain for an SQL engine with RE2: a query with keys, text and counters."""
    ctes, before = [f"s0 AS (SELECT {keys}, text, " + ", ".join(f"0::BIGINT AS {c}" for c in COUNTERS) + f" FROM ({source}))"], "s0"
    for k, step in enumerate(STEPS, 1):
        if step.pattern:
            n = f"len(regexp_extract_all(text, '{step.pattern}'))"
            new = f"regexp_replace(text, '{step.pattern}', '{step.replacement.replace('$', chr(92))}', 'g')"
        else:
            new = "text"
            for old, to in step.table:
                new = f"replace({new}, {_literal(old)}, {_literal(to)})"
            single = all(len(old) == 1 for old, _ in step.table)
            n = f"length(text) - length(translate(text, '{''.join(o for o, _ in step.table)}', ''))" if single else f"length(text) - length({new})"
        others = ", ".join(c for c in COUNTERS if c != step.counter)
        ctes.append(f"s{k} AS (SELECT {keys}, {new} AS text, {others}, {step.counter} + coalesce({n}, 0) AS {step.counter} FROM {before})")
        before = f"s{k}"
    rest = ", ".join(COUNTERS[:-1])
    return f"WITH {', '.join(ctes)} SELECT {keys}, nfc_normalize(text) AS text, {rest}, coalesce((text <> nfc_normalize(text))::BIGINT, 0) AS unicode FROM {before}"
