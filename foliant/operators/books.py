"""Package documents as tables: metadata, manifest, spine, renames and tables of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.paths import basename, escape_attribute, escape_text, percent_decode, percent_encode, trim

STORE_NAMES = ["Sigil version", "dtb:uid"]
STORE_PREFIXES = ["amazon:", "calibre:", "ibooks:", "kindle:"]


def strip_store_metadata(metas: DataFrame) -> DataFrame:
    """Rows (name, property, ...) less those that shops and library programs leave behind."""
    name, prop = (F.coalesce(F.col(c), F.lit("")) for c in ("name", "property"))
    shop = name.isin(STORE_NAMES)
    for p in STORE_PREFIXES:
        shop = shop | name.startswith(p) | prop.startswith(p)
    return metas.filter(~shop)


def series(metas: DataFrame) -> DataFrame:
    """(book_id, series, series_index) from metas(book_id, pos, name, property, content, text): the last one said wins."""
    value = F.when(F.col("name").isin("calibre:series", "calibre:series_index"), F.col("content")).otherwise(F.col("text"))
    kind = F.when((F.col("name") == "calibre:series") | (F.col("property") == "belongs-to-collection"), "series").when((F.col("name") == "calibre:series_index") | (F.col("property") == "group-position"), "index")
    said = metas.select("book_id", "pos", kind.alias("kind"), trim(F.coalesce(value, F.lit(""))).alias("value")).filter("kind is not null and value <> ''")
    pick = lambda k: F.coalesce(F.max_by(F.when(F.col("kind") == k, F.col("value")), F.when(F.col("kind") == k, F.col("pos"))), F.lit(""))
    return said.groupBy("book_id").agg(pick("series").alias("series"), pick("index").alias("series_index"))


def cover_id(manifest: DataFrame, metas: DataFrame) -> DataFrame:
    """(book_id, cover_id): by property, else as a meta says, else by an image item's id."""
    image = F.lower("media_type").startswith("image/") & F.lower("id").contains("cover")
    items = manifest.groupBy("book_id").agg(
        F.min_by(F.when(F.col("properties").contains("cover-image"), F.col("id")), F.when(F.col("properties").contains("cover-image"), F.col("pos"))).alias("by_property"),
        F.min_by(F.when(image, F.col("id")), F.when(image, F.col("pos"))).alias("by_name"),
    )
    said = metas.filter("name = 'cover'").groupBy("book_id").agg(F.min_by(F.coalesce("content", F.lit("")), "pos").alias("said"))
    return items.join(said, "book_id", "full").select("book_id", F.coalesce("by_property", "said", "by_name", F.lit("")).alias("cover_id"))


def apply_edits(values: DataFrame, edits: DataFrame, columns=("title", "author", "language")) -> DataFrame:
    """Edits replace values; empty ones change nothing."""
    new = edits.select("book_id", *[F.col(c).alias(f"{c}__new") for c in columns])
    kept = [c for c in values.columns if c not in columns]
    return values.join(new, "book_id", "left").select(*kept, *[F.coalesce(F.nullif(F.col(f"{c}__new"), F.lit("")), c).alias(c) for c in columns])


def spine_hrefs(spine: DataFrame, manifest: DataFrame) -> DataFrame:
    """(book_id, pos, idref, href) of spine entries whose id the manifest has; of equal ids the last counts."""
    w = W.partitionBy("book_id", "id").orderBy(F.desc("pos"))
    last = manifest.withColumn("nth", F.row_number().over(w)).filter("nth = 1").select("book_id", F.col("id").alias("idref"), "href")
    return spine.join(last, ["book_id", "idref"]).filter("href <> ''").select("book_id", "pos", "idref", "href")


def first_of_spine(entries: DataFrame, n: int = 3) -> DataFrame:
    w = W.partitionBy("book_id").orderBy("pos")
    return entries.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n)


def rename_hrefs(manifest: DataFrame, renames: DataFrame) -> DataFrame:
    """Manifest with renamed files: matched by decoded path, else by path as written, else by name alone (least old path first).

    New addresses are percent-encoded, others stay as they are.
    """
    exact = renames.select("book_id", F.col("old_path").alias("plain"), F.col("new_path").alias("exact"))
    raw = renames.select("book_id", F.col("old_path").alias("href"), F.col("new_path").alias("raw"))
    named = renames.groupBy("book_id", basename(F.col("old_path")).alias("base")).agg(F.min_by("new_path", "old_path").alias("named"))
    decoded = manifest.withColumn("plain", percent_decode("href"))
    joined = decoded.withColumn("base", basename(F.col("plain"))).join(exact, ["book_id", "plain"], "left").join(raw, ["book_id", "href"], "left").join(named, ["book_id", "base"], "left")
    target = F.coalesce("exact", "raw", F.when(F.col("named").isNotNull(), F.concat(F.substring(F.col("plain"), F.lit(1), F.length("plain") - F.length("base")), basename(F.col("named")))))
    others = [c for c in manifest.columns if c not in ("href", "media_type")]
    return joined.select(*others, F.when(target.isNotNull(), percent_encode(target)).otherwise(F.col("href")).alias("href"), F.when(target.isNotNull(), "image/jpeg").otherwise(F.col("media_type")).alias("media_type"))


def resolve(references: DataFrame, renames: DataFrame) -> DataFrame:
    """References (book_id, ref) with ``target``: every place of a renamed file's name replaced in the decoded reference; others as written."""
    named = renames.groupBy("book_id", basename(F.col("old_path")).alias("base")).agg(F.min_by(basename(F.col("new_path")), "old_path").alias("new_name"))
    decoded = references.withColumn("plain", percent_decode("ref"))
    joined = decoded.withColumn("base", basename(F.col("plain"))).join(named, ["book_id", "base"], "left")
    return joined.withColumn("target", F.when(F.col("new_name").isNotNull(), F.replace("plain", "base", "new_name")).otherwise(F.col("ref"))).drop("plain", "base", "new_name")


def without_files(manifest: DataFrame, gone: DataFrame) -> DataFrame:
    """Manifest less the items whose file name is among those of ``gone`` (book_id, path), in any folder."""
    names = gone.select("book_id", basename(F.col("path")).alias("base")).distinct()
    return manifest.withColumn("base", basename(percent_decode("href"))).join(names, ["book_id", "base"], "left_anti").drop("base")


def toc_usable(nav: DataFrame, files: DataFrame) -> DataFrame:
    """(book_id, usable): there are points and the file of each, fragment aside, exists."""
    points = nav.withColumn("name", F.substring_index("src", "#", 1))
    missing = points.filter("name <> ''").join(files.select("book_id", "name").distinct(), ["book_id", "name"], "left_anti").groupBy("book_id").agg(F.count("*").alias("missing"))
    return points.groupBy("book_id").agg(F.count("*").alias("points")).join(missing, "book_id", "left").select("book_id", F.col("missing").isNull().alias("usable"))


def chapters(entries: DataFrame, titles: DataFrame) -> DataFrame:
    """(book_id, play_order, title, href): titles of the spine's files, numbered where there is none."""
    order = F.row_number().over(W.partitionBy("book_id").orderBy("pos"))
    return entries.join(titles, ["book_id", "href"], "left").withColumn("play_order", order).select(
        "book_id", "play_order", F.coalesce("title", F.concat(F.lit("Chapter "), F.col("play_order"))).alias("title"), "href"
    )


def _point(x: Column) -> Column:
    n = x["play_order"].cast("string")
    parts = ['    <navPoint id="navPoint-', n, '" playOrder="', n, '">\n      <navLabel>\n        <text>', escape_text(x["title"]), "</text>\n      </navLabel>\n      <content src=\"", escape_attribute(x["href"]), '"/>\n    </navPoint>\n']
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def toc(chapters: DataFrame) -> DataFrame:
    """(book_id, ncx): a table of contents of each book's chapters."""
    held = chapters.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("play_order", "title", "href"))).alias("points"))
    top = '<?xml version="1.0" encoding="utf-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1">\n  <head>\n    <meta name="dtb:depth" content="1"/>\n  </head>\n  <docTitle>\n    <text>'
    body = F.concat(F.lit(top), escape_text(F.col("points")[0]["title"]), F.lit("</text>\n  </docTitle>\n  <navMap>\n"), F.array_join(F.transform("points", _point), ""), F.lit("  </navMap>\n</ncx>\n"))
    return held.select("book_id", body.alias("ncx"))


def unique_names(jobs: DataFrame) -> DataFrame:
    """Jobs (job_index, filename) with ``output``: the second of a name gets ' (2)' before its extension, and so on."""
    nth = F.row_number().over(W.partitionBy("filename").orderBy("job_index"))
    stem = F.regexp_replace("filename", r"\.epub$", "")
    return jobs.withColumn("nth", nth).withColumn("output", F.when(F.col("nth") > 1, F.concat(stem, F.lit(" ("), F.col("nth"), F.lit(").epub"))).otherwise(F.col("filename"))).drop("nth")


def progress(images: DataFrame) -> DataFrame:
    """(book_id, pos, percent): 15 at a book's first image, rising to just under 60."""
    w = W.partitionBy("book_id")
    k = F.row_number().over(w.orderBy("pos")) - 1
    return images.withColumn("percent", F.floor(15 + 45 * k / F.count("*").over(w)).cast("int"))
