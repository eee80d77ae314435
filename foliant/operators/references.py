"""Addresses of renamed files in markup and style sheets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.paths import basename, percent_decode

_URL = re.compile(r"url\(([^)]*)\)")
_NAMES = T.MapType(T.StringType(), T.StringType())


def rename_map(processed: DataFrame) -> DataFrame:
    """(book_id, old_path, new_path) from (book_id, path, filename): the file stays in its folder; those that keep their name are left out."""
    folder = F.substring(F.col("path"), F.lit(1), F.length("path") - F.length(basename(F.col("path"))))
    return processed.select("book_id", F.col("path").alias("old_path"), F.concat(folder, "filename").alias("new_path")).filter("old_path <> new_path")


def new_names(renames: DataFrame) -> DataFrame:
    """(book_id, names): new by old file names of each book; of equal old ones that of the least path."""
    named = renames.groupBy("book_id", basename(F.col("old_path")).alias("base")).agg(F.min_by(basename(F.col("new_path")), "old_path").alias("new_name"))
    return named.groupBy("book_id").agg(F.map_from_entries(F.collect_list(F.struct("base", "new_name"))).alias("names"))


def resolved(ref: Column, names: Column) -> Column:
    """The address, decoded, with every place of a renamed file's name replaced; as it was if it names none."""
    plain = percent_decode(ref)
    base = basename(plain)
    new = F.try_element_at(names, base)
    return F.when(new.isNotNull(), F.replace(plain, base, new)).otherwise(ref)


@F.pandas_udf(T.StringType())
def css_urls(css: pd.Series, names: pd.Series) -> pd.Series:
    """Every ``url(...)`` of a sheet, renamed where it must be, without quotes; an open one at the end stays."""
    from urllib.parse import unquote

    def one(text, known):
        if text is None:
            return None
        known = dict(known) if known is not None else {}

        def put(m: re.Match) -> str:
            ref = m[1].strip(" \t\r\n\f\v\"'")
            plain = unquote(ref, errors="replace")
            base = plain.rsplit("/", 1)[-1]
            return f"url({plain.replace(base, known[base]) if base in known else ref})"

        return _URL.sub(put, text)

    return pd.Series([one(t, k) for t, k in zip(css, names, strict=True)], dtype=object)


def update_sheets(sheets: DataFrame, renames: DataFrame) -> DataFrame:
    """Sheets (book_id, ..., css) with ``changed``."""
    joined = sheets.join(new_names(renames), "book_id", "left").withColumn("__new", css_urls("css", "names"))
    return joined.withColumn("changed", ~F.col("css").eqNullSafe(F.col("__new"))).withColumn("css", F.col("__new")).drop("__new", "names")


def update_nodes(nodes: DataFrame, renames: DataFrame) -> DataFrame:
    """Nodes whose images (``src`` of img, address of an svg image) and ``style`` attributes point to the renamed files; doc_id is the book."""
    own = nodes.join(new_names(renames).withColumnRenamed("book_id", "doc_id"), "doc_id", "left")
    name = F.substring_index("name", ":", -1)

    def put(key: str, value: Column, when: Column) -> Column:
        return F.when(F.col("names").isNotNull() & when & F.col("attrs")[key].isNotNull(), F.create_map(F.lit(key), value)).otherwise(F.create_map().cast(_NAMES))

    parts = [put("src", resolved(F.col("attrs")["src"], F.col("names")), name == "img"), put("style", css_urls(F.col("attrs")["style"], F.col("names")), F.col("kind") == "element")]
    parts += [put(k, resolved(F.col("attrs")[k], F.col("names")), name == "image") for k in ("xlink:href", "href")]
    changed = F.map_concat(*parts)
    return own.withColumn("__new", changed).withColumn("attrs", F.transform_values("attrs", lambda k, v: F.coalesce(F.try_element_at(F.col("__new"), k), v))).select(nodes.columns)
