"""Counters per document, summed and put into words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.paths import format_size, one_decimal
from foliant.functions.text import COUNTERS

LABELS = dict(zip(COUNTERS, ["extra spaces", "OCR artifacts", "quotes normalized", "encoding fixes", "punctuation fixes", "unicode fixes"], strict=True))


def merge(counted: DataFrame, *keys: str) -> DataFrame:
    """Sums of the counters over documents; those without any repair count as unchanged."""
    total = sum((F.col(c) for c in COUNTERS), F.lit(0))
    return counted.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTERS], F.count_if(total > 0).alias("changed"), F.count("*").alias("documents"))


def summary(labels: dict[str, str] = LABELS) -> Column:
    parts = [F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {label}"))) for c, label in labels.items()]
    said = F.array_join(F.array_compact(F.array(*parts)), ", ")
    return F.when(said == "", "no text issues found").otherwise(said)


def reduction(before: Column, after: Column) -> Column:
    """Percent saved; 0 of nothing."""
    return F.when(before == 0, F.lit(0.0)).otherwise((1 - after / before) * 100)


def formats(images: DataFrame) -> DataFrame:
    """(book_id, formats): how many images, by the first clause of their details, in key order."""
    by = images.groupBy("book_id", F.trim(F.substring_index("details", ",", 1)).alias("format")).agg(F.count("*").alias("n"))
    return by.groupBy("book_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("format", "n")))).alias("formats"))


#: Clauses of a book's report that say how many, in order; the contents clause comes after the fifth.
CLAUSES = [
    ("fonts_removed", "Removed", "embedded fonts"), ("css_rules_removed", "Stripped", "unused CSS rules"), ("svg_covers_fixed", "Fixed", "SVG cover wrappers"), ("documents_recovered", "Repaired", "malformed documents"),
    ("metadata_items_stripped", "Stripped", "store metadata entries"), ("blank_elements_removed", "Cleaned", "empty elements"), ("attributes_stripped", "Stripped", "unnecessary attributes"),
]


def counters(steps: DataFrame) -> DataFrame:
    """A row for each book from (book_id, counter, n): a column for each counter of a report, 0 where a step said nothing."""
    names = ["images_total", "images_converted", *[c for c, _, _ in CLAUSES], "os_artifacts_removed"]
    return steps.groupBy("book_id").agg(*[F.coalesce(F.sum(F.when(F.col("counter") == n, F.col("n"))), F.lit(0)).alias(n) for n in names])


def book_summary() -> Column:
    """One line from the columns of `counters`, ``image_formats`` (map), ``toc_status``, text counters, ``original_size`` and ``optimized_size``."""
    count = lambda name, verb, what: F.when(F.col(name) > 0, F.concat(F.lit(f"{verb} "), F.col(name).cast("string"), F.lit(f" {what}")))
    kinds = F.array_join(F.transform(F.array_sort(F.map_entries("image_formats")), lambda e: F.concat(e["value"].cast("string"), F.lit(" "), e["key"])), ", ")
    images = F.when(F.col("images_converted") > 0, F.concat(F.lit("Converted "), F.col("images_converted").cast("string"), F.lit("/"), F.col("images_total").cast("string"), F.lit(" images ("), kinds, F.lit(")")))
    contents = F.when(F.col("toc_status") != "", F.concat(F.lit("TOC: "), "toc_status"))
    fixes = sum((F.col(c) for c in COUNTERS), F.lit(0))
    text = F.when(fixes > 0, F.concat(F.lit("Text cleanup: "), summary()))
    change = reduction(F.col("original_size"), F.col("optimized_size"))
    size = F.when((F.col("original_size") > 0) & (F.col("optimized_size") > 0), F.concat(F.lit("Size: "), format_size(F.col("original_size")), F.lit(" \u2192 "), format_size(F.col("optimized_size")), F.lit(" ("), one_decimal(F.abs(change)), F.when(change < 0, "% increase)").otherwise("% reduction)")))
    said = [count(*c) for c in CLAUSES]
    line = F.array_join(F.array_compact(F.array(images, *said[:4], contents, *said[4:], text, count("os_artifacts_removed", "Removed", "OS artifacts"), size)), "; ")
    return F.when(line == "", "No changes needed").otherwise(line)


def content_kinds(items: DataFrame) -> DataFrame:
    """(book_id, kind, n): how many items of each kind a book has."""
    return items.groupBy("book_id", "kind").agg(F.count("*").alias("n"))


def first_part_size(part: Column, size: Column) -> Column:
    """The original's size, told for its first part only, so that sums count it once."""
    return F.when(part == 1, size).otherwise(0)


def result_row(before: Column, after: Column) -> list[Column]:
    """(change, size_before, size_after): what a list of results shows of a book."""
    percent = F.abs(reduction(before, after))
    change = F.concat(one_decimal(percent), F.when(after <= before, "% smaller").otherwise("% larger"))
    return [change.alias("change"), format_size(before).alias("size_before"), format_size(after).alias("size_after")]


def without_errors(jobs: DataFrame) -> DataFrame:
    return jobs.filter("error IS NULL OR error = ''")
