"""Style sheets as tables of rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = "sheet string, pos int, kind string, selector string, css string"
ALWAYS = ["*", "body", "html"]


def split_rules(css: str) -> list[tuple[str, str, str]]:
    """(kind, selector, source) of the top-level rules; sources put together give the sheet again."""
    out, start, k, depth, n = [], 0, 0, 0, len(css)
    open_at = -1
    while k < n:
        c = css[k]
        if css.startswith("/*", k):
            end = css.find("*/", k + 2)
            k = n if end < 0 else end + 2
            continue
        if c in "\"'":
            k += 1
            while k < n and css[k] != c:
                k += 2 if css[k] == "\\" else 1
        elif c == "{":
            if depth == 0:
                open_at = k
            depth += 1
        elif c == "}" and depth:
            depth -= 1
        if (c == "}" and depth == 0 and open_at >= 0) or (c == ";" and depth == 0):
            head = re.sub(r"/\*.*?\*/", "", css[start : open_at if c == "}" else k], flags=re.S).strip()
            kind = "font-face" if head.lower().startswith("@font-face") else "at" if head.startswith("@") else "style"
            out.append((kind, head, css[start : k + 1]))
            start, open_at = k + 1, -1
        k += 1
    if css[start:]:
        out.append(("rest", "", css[start:]))
    return out


def rules(sheets: DataFrame) -> DataFrame:
    """Rules of sheets (sheet, css)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, k, *r) for s, c in zip(b.sheet, b.css, strict=True) if c for k, r in enumerate(split_rules(c))]
            yield pd.DataFrame(rows, columns=["sheet", "pos", "kind", "selector", "css"])

    return sheets.select(F.col("sheet").cast("string"), "css").mapInPandas(run, RULES)


def selector_names(selector: Column) -> Column:
    """Classes (.x), ids (#x) and elements that a selector names."""
    return F.regexp_extract_all(selector, F.lit(r"([.#]?[A-Za-z][A-Za-z0-9_-]*|[.#][A-Za-z0-9_-]+)"), 1)


def keep_used(rule_rows: DataFrame, used: DataFrame) -> DataFrame:
    """Rules less the style rules none of whose selectors matches what is used (kind, name).

    A selector stays if it is universal, has a colon or bracket, names nothing, or names something in use.
    """
    single = rule_rows.filter("kind = 'style'").select("sheet", "pos", F.explode(F.split("selector", ",")).alias("one")).withColumn("one", F.trim("one"))
    names = selector_names(F.col("one"))
    open_ = F.col("one").isin(ALWAYS) | F.col("one").rlike(r"[:\[]") | (F.size(names) == 0)
    sure = single.filter(open_).select("sheet", "pos")
    key = F.concat(F.when(F.col("kind") == "class", ".").when(F.col("kind") == "id", "#").otherwise(""), "name")
    wanted = used.select(key.alias("n")).distinct()
    named = single.filter(~open_).select("sheet", "pos", F.explode(names).alias("n"))
    found = named.withColumn("n", F.when(F.col("n").rlike("^[.#]"), F.col("n")).otherwise(F.lower("n"))).join(wanted, "n", "left_semi").select("sheet", "pos")
    keep = sure.unionByName(found).distinct()
    return rule_rows.filter("kind <> 'style'").unionByName(rule_rows.filter("kind = 'style'").join(keep, ["sheet", "pos"], "left_semi"))


def without_fonts(rule_rows: DataFrame) -> DataFrame:
    return rule_rows.filter("kind <> 'font-face'")


def sheets(rule_rows: DataFrame) -> DataFrame:
    """(sheet, css) of rules, put together in order."""
    held = rule_rows.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("pos", "css"))).alias("r"))
    return held.select("sheet", F.array_join(F.transform("r", lambda x: x["css"]), "").alias("css"))
