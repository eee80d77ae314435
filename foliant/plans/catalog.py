"""Named queries over the driver's tables and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant import settings
from foliant.functions import paths, text
from foliant.operators import books, huffman, images, markup, opf, process, references, reports, styles
from foliant.sources import archives
from foliant.sources import markup as reader
from foliant.sources.store import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
S = text.SPACE


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spoiled(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*columns, text.spoil(F.col("text")).alias("text"))


_SPOILED = f"SELECT doc_id, lang, {text.spoil_sql('text')} AS text FROM documents"
_CLEAN = text.clean_sql(_SPOILED, "doc_id, lang")
_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in text.COUNTERS)
_TOTAL = " + ".join(text.COUNTERS)


@query(f"SELECT doc_id, md5(text) AS text_md5, {', '.join(text.COUNTERS)} FROM ({_CLEAN})")
def text_clean(spark, sf_dir):
    """All repairs in order, with counts."""
    return text.clean(spoiled(spark, sf_dir, "doc_id")).select("doc_id", F.md5("text").alias("text_md5"), *text.COUNTERS)


@query(f"SELECT lang, {_SUMS}, count(*) FILTER ({_TOTAL} > 0) AS changed, count(*) AS documents FROM ({_CLEAN}) GROUP BY lang")
def text_report_by_lang(spark, sf_dir):
    return reports.merge(text.clean(spoiled(spark, sf_dir, "doc_id", "lang")), "lang")


@query(f"""SELECT doc_id, CASE WHEN {_TOTAL} = 0 THEN 'no text issues found' ELSE concat_ws(', ', CASE WHEN double_spaces > 0 THEN double_spaces || ' extra spaces' END, CASE WHEN ocr_ligatures > 0 THEN ocr_ligatures || ' OCR artifacts' END, CASE WHEN smart_quotes > 0 THEN smart_quotes || ' quotes normalized' END,
  CASE WHEN encoding > 0 THEN encoding || ' encoding fixes' END, CASE WHEN punctuation > 0 THEN punctuation || ' punctuation fixes' END, CASE WHEN unicode > 0 THEN unicode || ' unicode fixes' END) END AS summary FROM ({_CLEAN})""")
def text_summary(spark, sf_dir):
    return text.clean(spoiled(spark, sf_dir, "doc_id")).select("doc_id", reports.summary().alias("summary"))


@query("SELECT role, " + _SUMS + f", count(*) FILTER ({_TOTAL} > 0) AS changed, count(*) AS documents FROM (" + text.clean_sql(f"SELECT role, {text.spoil_sql('text')} AS text FROM conversations", "role") + ") GROUP BY role")
def conversation_report(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("role", text.spoil(F.col("text")).alias("text"))
    return reports.merge(text.clean(turns), "role")


def _step(step: text.Step):
    def run(spark, sf_dir):
        col = F.col("text")
        return spoiled(spark, sf_dir, "doc_id").select("doc_id", text.found(col, step).cast("long").alias("matches"), F.md5(text.repaired(col, step)).alias("text_md5"))

    if step.pattern:
        n, new = f"len(regexp_extract_all(text, '{step.pattern}'))", f"regexp_replace(text, '{step.pattern}', '{step.replacement.replace('$', chr(92))}', 'g')"
    else:
        new = "text"
        for old, to in step.table:
            new = f"replace({new}, {text._literal(old)}, {text._literal(to)})"
        n = f"length(text) - length({new})" if len(step.table[0][0]) > 1 else f"length(text) - length(translate(text, '{''.join(o for o, _ in step.table)}', ''))"
    QUERIES[f"text_{step.name}"] = run
    SQL[f"text_{step.name}"] = f"SELECT doc_id, ({n})::BIGINT AS matches, md5({new}) AS text_md5 FROM ({_SPOILED})"


for _s in text.STEPS:
    _step(_s)


def _sanitize_sql(x: str) -> str:
    x = f"""replace(translate({x}, '/\\|"', '---'''), ':', ' -')"""
    x = f"nfc_normalize(regexp_replace(translate({x}, '*?<>', ''), '\\p{{Cc}}', '', 'g'))"
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '{S}+', ' ', 'g'), '-+', '-', 'g'), '^{S}+|{S}+$', '', 'g')"


_TITLE = "'  ' || text || ' a/b: \"c\"*?'"


@query(f"SELECT doc_id, regexp_replace(substr({_sanitize_sql(f'(source || chr(32) || chr(45) || chr(32) || {chr(116)}.title)')}, 1, 200), '{S}+$', '') || '.epub' AS filename FROM (SELECT doc_id, source, regexp_replace({_TITLE}, '^{S}+|{S}+$', '', 'g') AS title FROM documents) t")
def filename_format(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    title = F.concat(F.lit("  "), F.col("text"), F.lit(' a/b: "c"*?'))
    return docs.select("doc_id", paths.filename(title, F.col("source")).alias("filename"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", paths.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


_NAME = "'OEBPS/Images/' || p_name || CASE p_partkey % 9 WHEN 0 THEN '.TTF' WHEN 1 THEN '.png' WHEN 2 THEN '.css' WHEN 3 THEN '.woff2' WHEN 4 THEN '/.DS_Store' WHEN 5 THEN '/Thumbs.db' WHEN 6 THEN '.jpeg' ELSE '.xhtml' END"
_KIND = "CASE p_partkey % 7 WHEN 0 THEN 'application/xhtml+xml' WHEN 1 THEN 'TEXT/CSS' WHEN 2 THEN 'image/png' WHEN 3 THEN 'font/otf' WHEN 4 THEN 'application/x-dtbncx+xml' ELSE '' END"
_EXT = "lower(coalesce(nullif(regexp_extract(base, '[^.].*\\.([^.]*)$', 1), ''), ''))"


@query(f"""
WITH n AS (SELECT p_partkey, {_NAME} AS name, {_KIND} AS media FROM part),
b AS (SELECT *, split_part(name, '/', -1) AS base FROM n), e AS (SELECT *, {_EXT} AS ext FROM b)
SELECT p_partkey, base, ext, regexp_replace(name, '/?[^/]*$', '') AS folder, base IN ('.DS_Store', 'Thumbs.db', 'desktop.ini', '._.DS_Store') AS junk, ext IN ('ttf', 'otf', 'woff', 'woff2') AS font,
  ext IN ('bmp', 'gif', 'jpeg', 'jpg', 'png', 'tif', 'tiff', 'webp') AS image,
  CASE WHEN lower(media) = 'application/xhtml+xml' THEN 'xhtml' WHEN lower(media) = 'text/css' THEN 'css' WHEN lower(media) = 'application/x-dtbncx+xml' THEN 'ncx' WHEN lower(media) LIKE 'image/%' THEN 'image'
    WHEN lower(media) = 'font/otf' OR ext IN ('ttf', 'otf', 'woff', 'woff2') THEN 'font' ELSE 'other' END AS kind
FROM e""")
def path_parts(spark, sf_dir):
    """Names, extensions, folders and the kind of content of files."""
    n = table(spark, sf_dir, "part").select("p_partkey", F.expr(_NAME).alias("name"), F.expr(_KIND).alias("media"))
    name = F.col("name")
    return n.select(
        "p_partkey", paths.basename(name).alias("base"), paths.extension(name).alias("ext"), paths.parent(name).alias("folder"), paths.is_junk(name).alias("junk"), paths.is_font(name).alias("font"), paths.is_image(name).alias("image"),
        paths.content_kind(F.col("media"), name).alias("kind"),
    )


@query("SELECT page_id, url_decode(replace(replace(url, '/', '%2F'), 'a', '%C3%A9+')) AS decoded FROM pages")
def percent_decode(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", paths.percent_decode(F.replace(F.replace("url", F.lit("/"), F.lit("%2F")), F.lit("a"), F.lit("%C3%A9+"))).alias("decoded"))


_SPINE = "SELECT conv_id AS book_id, turn::INT AS pos, role AS idref FROM conversations"
_MANIFEST = "SELECT conv_id AS book_id, turn::INT AS pos, role AS id, 'text/' || role || '-' || turn || '.xhtml' AS href FROM conversations WHERE turn % 3 <> 1"


def _spine(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    manifest = turns.filter("turn % 3 <> 1").select(F.col("conv_id").alias("book_id"), F.col("turn").cast("int").alias("pos"), F.col("role").alias("id"), F.concat(F.lit("text/"), "role", F.lit("-"), "turn", F.lit(".xhtml")).alias("href"))
    return books.spine_hrefs(turns.select(F.col("conv_id").alias("book_id"), F.col("turn").cast("int").alias("pos"), F.col("role").alias("idref")), manifest)


_JOINED = f"SELECT s.book_id, s.pos, s.idref, m.href FROM ({_SPINE}) s JOIN (SELECT book_id, id, arg_max(href, pos) AS href FROM ({_MANIFEST}) GROUP BY ALL) m ON s.book_id = m.book_id AND s.idref = m.id"


@query(_JOINED)
def spine_join(spark, sf_dir):
    return _spine(spark, sf_dir)


@query(f"SELECT book_id, pos, href, nth FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY pos)::INT AS nth FROM ({_JOINED})) WHERE nth <= 3")
def spine_first(spark, sf_dir):
    return books.first_of_spine(_spine(spark, sf_dir)).select("book_id", "pos", "href", "nth")


_CHAPTERS = f"SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY pos)::INT AS play_order, CASE WHEN pos % 2 = 0 THEN 'A < \"B\" & ' || idref ELSE 'Chapter ' || row_number() OVER (PARTITION BY book_id ORDER BY pos) END AS title, href FROM ({_JOINED})"


def _chapters(spark, sf_dir):
    entries = _spine(spark, sf_dir).withColumn("href", F.concat("href", F.lit("#"), "pos"))
    titles = entries.filter("pos % 2 = 0").select("book_id", "href", F.concat(F.lit('A < "B" & '), "idref").alias("title"))
    return books.chapters(entries, titles)


_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""SELECT book_id, md5('<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1">' || chr(10) || '  <head>' || chr(10) || '    <meta name="dtb:depth" content="1"/>' || chr(10) || '  </head>' || chr(10)
  || '  <docTitle>' || chr(10) || '    <text>' || arg_min({_ESCAPED.format("title")}, play_order) || '</text>' || chr(10) || '  </docTitle>' || chr(10) || '  <navMap>' || chr(10)
  || string_agg('    <navPoint id="navPoint-' || play_order || '" playOrder="' || play_order || '">' || chr(10) || '      <navLabel>' || chr(10) || '        <text>' || {_ESCAPED.format("title")} || '</text>' || chr(10) || '      </navLabel>' || chr(10) || '      <content src="' || href || '"/>' || chr(10) || '    </navPoint>' || chr(10), '' ORDER BY play_order)
  || '  </navMap>' || chr(10) || '</ncx>' || chr(10)) AS ncx_md5 FROM (SELECT book_id, play_order, title, href || '#' || pos AS href FROM ({_CHAPTERS.replace("title, href FROM", "title, href, pos FROM")})) GROUP BY book_id""")
def toc_generate(spark, sf_dir):
    return books.toc(_chapters(spark, sf_dir)).select("book_id", F.md5("ncx").alias("ncx_md5"))


@query("""WITH n AS (SELECT conv_id AS book_id, role || (turn % 4) AS name FROM conversations), f AS (SELECT DISTINCT conv_id AS book_id, role || '0' AS name FROM conversations UNION SELECT DISTINCT conv_id, role || '1' FROM conversations WHERE conv_id % 2 = 0)
SELECT n.book_id, count(*) FILTER (f.name IS NULL) = 0 AS usable FROM n LEFT JOIN f ON n.book_id = f.book_id AND n.name = f.name GROUP BY n.book_id""")
def toc_check(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("book_id", F.col("conv_id"))
    nav = turns.select("book_id", F.concat("role", F.col("turn") % 4, F.lit("#x")).alias("src"))
    files = turns.select("book_id", F.concat("role", F.lit("0")).alias("name")).unionByName(turns.filter("conv_id % 2 = 0").select("book_id", F.concat("role", F.lit("1")).alias("name")))
    return books.toc_usable(nav, files)


_ITEMS = "SELECT p_size AS book_id, p_partkey AS pos, 'img/' || (p_partkey % 5) || '/' || p_brand || '.png' AS href, 'image/png' AS media_type FROM part"
_RENAMES = "SELECT p_size AS book_id, 'img/' || (p_partkey % 3) || '/' || p_brand || '.png' AS old_path, 'img/' || (p_partkey % 3) || '/' || p_brand || '.jpg' AS new_path FROM part WHERE p_partkey % 4 = 0 GROUP BY ALL"


@query(f"""WITH m AS (SELECT *, split_part(href, '/', -1) AS base FROM ({_ITEMS})), r AS ({_RENAMES}), n AS (SELECT book_id, split_part(old_path, '/', -1) AS base, arg_min(new_path, old_path) AS named FROM r GROUP BY ALL)
SELECT m.book_id, pos, coalesce(replace(coalesce(new_path, substr(href, 1, length(href) - length(m.base)) || split_part(named, '/', -1)), '#', '%23'), href) AS href, CASE WHEN new_path IS NULL AND named IS NULL THEN media_type ELSE 'image/jpeg' END AS media_type
FROM m LEFT JOIN r ON m.book_id = r.book_id AND href = old_path LEFT JOIN n ON m.book_id = n.book_id AND m.base = n.base""")
def rename_manifest(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    path = lambda n, e: F.concat(F.lit("img/"), F.col("p_partkey") % n, F.lit("/"), "p_brand", F.lit(e))
    items = part.select(F.col("p_size").alias("book_id"), F.col("p_partkey").alias("pos"), path(5, ".png").alias("href"), F.lit("image/png").alias("media_type"))
    renames = part.filter("p_partkey % 4 = 0").select(F.col("p_size").alias("book_id"), path(3, ".png").alias("old_path"), path(3, ".jpg").alias("new_path")).distinct()
    return books.rename_hrefs(items, renames)


@query(f"WITH m AS ({_ITEMS}) SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_size = m.book_id AND p.p_partkey % 4 = 0 AND p.p_brand || '.png' = split_part(href, '/', -1))")
def font_anti_join(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    items = part.select(F.col("p_size").alias("book_id"), F.col("p_partkey").alias("pos"), F.concat(F.lit("img/"), F.col("p_partkey") % 5, F.lit("/"), "p_brand", F.lit(".png")).alias("href"), F.lit("image/png").alias("media_type"))
    gone = part.filter("p_partkey % 4 = 0").select(F.col("p_size").alias("book_id"), F.concat(F.lit("fonts/"), "p_brand", F.lit(".png")).alias("path"))
    return books.without_files(items, gone)


@query("SELECT p_partkey AS job_index, CASE WHEN n = 1 THEN p_brand || '.epub' ELSE p_brand || ' (' || n || ').epub' END AS output FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)")
def unique_names(spark, sf_dir):
    jobs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("job_index"), F.concat("p_brand", F.lit(".epub")).alias("filename"))
    return books.unique_names(jobs).select("job_index", "output")


@query("SELECT p_size AS book_id, p_partkey AS pos, floor(15 + 45 * (row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1) / count(*) OVER (PARTITION BY p_size))::INT AS percent FROM part")
def progress_percent(spark, sf_dir):
    return books.progress(table(spark, sf_dir, "part").select(F.col("p_size").alias("book_id"), F.col("p_partkey").alias("pos")))


_W, _H = "(p_partkey * 37 % 3000 + 1)", "(p_partkey * 53 % 4000 + 1)"


@query(f"WITH s AS (SELECT p_partkey, {_W} AS w, {_H} AS h FROM part), k AS (SELECT *, least(1.0::DOUBLE, 480::DOUBLE / w, 800::DOUBLE / h) AS k FROM s) SELECT p_partkey, greatest(1, floor(w * k + 0.5))::INT AS width, greatest(1, floor(h * k + 0.5))::INT AS height FROM k")
def image_fit(spark, sf_dir):
    w, h = images.fit(F.expr(_W), F.expr(_H), *map(F.lit, images.DEVICES["x4"]))
    return table(spark, sf_dir, "part").select("p_partkey", w.alias("width"), h.alias("height"))


@query("SELECT p_partkey, (r * 19595 + g * 38470 + b * 7471 + 32768) >> 16 AS luma FROM (SELECT p_partkey, (p_partkey * 7 % 256)::INT AS r, (p_partkey * 11 % 256)::INT AS g, (p_partkey * 13 % 256)::INT AS b FROM part)")
def luma601(spark, sf_dir):
    r, g, b = ((F.col("p_partkey") * k % 256).cast("int") for k in (7, 11, 13))
    return table(spark, sf_dir, "part").select("p_partkey", images.luma(r, g, b).alias("luma"))


def _pixels(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("image_id"), (F.col("l_partkey") * F.col("l_suppkey") % 151 + 40).cast("int").alias("v"))


_PIXELS = "SELECT l_linenumber AS image_id, (l_partkey * l_suppkey % 151 + 40)::INT AS v FROM lineitem"
_BOUNDS = f"""SELECT image_id, min(v) FILTER (up > cut) AS low, max(v) FILTER (down > cut) AS high FROM (
  SELECT image_id, v, sum(n) OVER (PARTITION BY image_id)::BIGINT // 100 AS cut, sum(n) OVER (PARTITION BY image_id ORDER BY v) AS up, sum(n) OVER (PARTITION BY image_id ORDER BY v DESC) AS down
  FROM (SELECT image_id, v, count(*) AS n FROM ({_PIXELS}) GROUP BY ALL)) GROUP BY image_id"""


@query(f"SELECT image_id, v, count(*) AS n FROM ({_PIXELS}) GROUP BY ALL")
def grey_histogram(spark, sf_dir):
    return images.histogram(_pixels(spark, sf_dir))


@query(f"""SELECT DISTINCT image_id, v, CASE WHEN high <= low THEN v ELSE least(255, greatest(0, trunc(v * (255.0::DOUBLE / (high - low)) + (-low) * (255.0::DOUBLE / (high - low)))::INT)) END AS stretched FROM ({_PIXELS}) JOIN ({_BOUNDS}) USING (image_id)""")
def autocontrast(spark, sf_dir):
    hist = images.histogram(_pixels(spark, sf_dir))
    return hist.join(images.autocontrast_bounds(hist), "image_id").select("image_id", "v", images.stretch(F.col("v"), F.col("low"), F.col("high")).alias("stretched"))


@query(f"""WITH p AS ({_PIXELS}), m AS (SELECT image_id, floor(avg(v) + 0.5)::INT AS mean FROM p GROUP BY image_id) SELECT DISTINCT image_id, v, mean, least(255, greatest(0, trunc(mean::FLOAT + 1.5::FLOAT * (v::FLOAT - mean::FLOAT))::INT)) AS changed FROM p JOIN m USING (image_id)""")
def contrast_pivot(spark, sf_dir):
    p = _pixels(spark, sf_dir)
    m = p.groupBy("image_id").agg(images.mean_level(F.col("v")).alias("mean"))
    return p.distinct().join(m, "image_id").select("image_id", "v", "mean", images.contrast(F.col("v"), F.col("mean"), 1.5).alias("changed"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 0.0 ELSE (1 - (c_custkey * 31 % 1000)::DOUBLE / (c_custkey % 7 * 500)) * 100 END AS saved FROM customer")
def size_reduction(spark, sf_dir):
    before, after = F.col("c_custkey") % 7 * 500, F.col("c_custkey") * 31 % 1000
    return table(spark, sf_dir, "customer").select("c_custkey", reports.reduction(before, after).alias("saved"))


@query("""WITH f AS (SELECT p_size AS book_id, split_part(p_type, ' ', 1) AS format, count(*) AS n FROM part GROUP BY ALL) SELECT book_id, string_agg(format || '=' || n, ',' ORDER BY format) AS formats FROM f GROUP BY book_id""")
def image_formats(spark, sf_dir):
    found = reports.formats(table(spark, sf_dir, "part").select(F.col("p_size").alias("book_id"), F.concat(F.substring_index("p_type", " ", 1), F.lit(", resized")).alias("details")))
    return found.select("book_id", F.array_join(F.transform(F.array_sort(F.map_entries("formats")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("formats"))


_ENC, _IDPF = "http://www.w3.org/2001/04/xmlenc", "http://www.idpf.org/2008/embedding"
_OPEN = f'<EncryptedData xmlns="{_ENC}#" a="{_IDPF}">'
_DRM = [
    (1, None, False), (2, "<x/>", False), (3, _ENC, True), (4, f"<x>{_ENC} {_IDPF}</x>", False),
    (5, f'{_OPEN}<CipherReference URI="a.otf"/></EncryptedData>', False), (6, f'{_OPEN}<CipherReference URI="a.xhtml"/></EncryptedData>', True),
    (7, f'{_OPEN}<CipherReference URI="a.otf"/>', True), (8, f'{_OPEN}<!-- <CipherReference URI="a.xhtml"/> --></EncryptedData>', False),
    (9, f'<r><EncryptedDatas/>{_OPEN}</EncryptedData><CipherReference URI="a.xhtml"/></r>', False), (10, f'{_OPEN}<d:CipherReference xmlns:d="{_ENC}#" URI="a.ttf"/><CipherReference URI=""/></EncryptedData>', True),
    (11, f'<!DOCTYPE x [<!ENTITY e "x">]>{_OPEN}</EncryptedData>', True),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, {str(v).lower()})" for k, _, v in _DRM) + ") t(case_id, locked)")
def drm_table(spark, sf_dir):
    return spark.createDataFrame([(k, x) for k, x, _ in _DRM], "case_id int, x string").select("case_id", archives.has_drm(F.col("x")).alias("locked"))


@query("SELECT source AS book_id, count(*) + 2 AS entries, sum(strlen(text))::BIGINT + 20 + 12 AS bytes, 0::BIGINT AS problems FROM documents GROUP BY source")
def zip_round_trip(spark, sf_dir):
    """Documents packaged by source, read back, checked and measured."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.col("source").alias("book_id"), F.concat(F.lit("OEBPS/"), "doc_id", F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"))
    base = docs.select(F.col("source").alias("book_id")).distinct()
    extra = [("mimetype", archives.MIME), (archives.CONTAINER, "<container/>"), ("OEBPS/.DS_Store", "x")]
    for name, content in extra:
        files = files.unionByName(base.select("book_id", F.lit(name).alias("name"), F.lit(content).cast("binary").alias("content")))
    packed = archives.package(files.withColumn("is_dir", F.lit(False)).withColumn("error", F.lit(None).cast("string")))
    entries = archives.extract(packed.select("book_id", F.col("archive").alias("content")))
    # read once; what is checked later is the type's text only
    entries = kept(entries.withColumn("bytes", F.length("content")).withColumn("content", F.when(F.col("name") == "mimetype", F.col("content"))))
    sums = entries.groupBy("book_id").agg(F.count("*").alias("entries"), F.sum("bytes").alias("bytes"))
    return sums.join(archives.validate(entries).select("book_id", F.size("problems").cast("long").alias("problems")), "book_id")


def _nodes(spark, sf_dir):
    return kept(reader.shred(table(spark, sf_dir, "pages"), "page_id", "html"))


@query()
def html_repair(spark, sf_dir):
    """Pages read, cleaned and written again as well-formed markup."""
    nodes = kept(markup.collapse_blank_blocks(markup.strip_attributes(_nodes(spark, sf_dir))))
    return reader.unshred(markup.add_page_breaks(nodes))


@query()
def html_selectors(spark, sf_dir):
    return markup.used_selectors(reader.shred(table(spark, sf_dir, "pages"), "page_id", "html"))


@query("""SELECT page_id AS doc_id, nullif(regexp_replace(html_unescape_min, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g'), '') AS title FROM (SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&') AS html_unescape_min FROM pages)""")
def chapter_titles(spark, sf_dir):
    return markup.chapter_titles(_nodes(spark, sf_dir))


@query()
def css_prune(spark, sf_dir):
    """A sheet of rules for names that pages use and do not use."""
    nodes = _nodes(spark, sf_dir)
    css = "p { margin: 0 } .ad, .gone { x: y }\n.gone > i.lost { } #top { } a:hover { } @media print { .gone { } } @font-face { src: url(a.ttf) } blink { }"
    rules = styles.rules(spark.createDataFrame([("a.css", css)], "sheet string, css string"))
    return styles.sheets(styles.without_fonts(styles.keep_used(rules, markup.used_selectors(nodes))))


@query()
def dithered_levels(spark, sf_dir):
    """Levels of gradients after error diffusion, one image for each region."""
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = []
            for k in b.r_regionkey:
                out = images.dither(np.tile(np.linspace(20 * k, 255, 48), (32, 1)))
                rows += [(int(k), int(v), int(n)) for v, n in zip(*np.unique(out, return_counts=True), strict=True)]
            yield pd.DataFrame(rows, columns=["image_id", "level", "n"])

    return table(spark, sf_dir, "region").select("r_regionkey").mapInPandas(run, "image_id long, level long, n long")


_PART = "SELECT p_size AS book_id, p_partkey AS k, p_brand AS brand, p_type AS kind, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS nth FROM part"


def _packages(spark, sf_dir):
    """A package document for each part size, its items the parts, read into nodes."""
    part = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("book_id"), F.col("p_partkey").alias("k"), "p_brand", "p_type")
    key = F.col("k").cast("string")
    join = lambda *x: F.concat(*[c if isinstance(c, Column) else F.lit(c) for c in x])
    item = join('<item id="i', key, '" href="img/', F.replace("p_brand", F.lit("#"), F.lit("%20")), "%20", key, '.png" media-type="image/png"/>')
    ref = F.when(F.col("k") % 3 == 0, join('<itemref idref="i', key, '"/>')).when(F.col("k") % 3 == 1, F.lit('<itemref idref=""/>')).otherwise(F.lit(""))
    held = part.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("k", item.alias("item"), ref.alias("ref"), "p_type"))).alias("x"), F.min("k").alias("least"))
    said = lambda f: F.array_join(F.transform("x", lambda e: e[f]), "\n")
    top = '<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" xmlns:d="http://purl.org/dc/elements/1.1/"><metadata>'
    title = F.when(F.col("book_id") % 2 == 0, join("<title>other</title><d:title> Book ", F.col("book_id").cast("string"), "</d:title>")).otherwise(join("<title>Plain ", F.col("book_id").cast("string"), "</title>"))
    author = F.when(F.col("book_id") % 3 == 0, F.lit("")).otherwise(join("<d:creator>", F.col("x")[0]["p_type"], "</d:creator>"))
    meta = join('<meta name="cover" content="i', F.col("least").cast("string"), '"/><meta name="calibre:series" content="first"/><meta property="belongs-to-collection">last</meta><meta property="group-position"> </meta><meta name="calibre:series_index" content="2"/>')
    opf = join(top, title, author, meta, "</metadata><manifest>", said("item"), "</manifest><spine>", said("ref"), "</spine></package>")
    return kept(reader.shred(held.select("book_id", opf.alias("opf")), "book_id", "opf"))


_HREF = "'img/' || replace(brand, '#', '%20') || '%20' || k || '.png'"


@query(f"SELECT book_id, nth, 'i' || k AS id, {_HREF} AS href, 'image/png' AS media_type FROM ({_PART})")
def opf_manifest(spark, sf_dir):
    items = opf.manifest_items(_packages(spark, sf_dir))
    return items.select("book_id", F.row_number().over(W.partitionBy("book_id").orderBy("pos")).cast("long").alias("nth"), "id", "href", "media_type")


@query(f"SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY k) AS nth, 'i' || k AS idref, {_HREF} AS href FROM ({_PART}) WHERE k % 3 = 0")
def opf_spine(spark, sf_dir):
    nodes = _packages(spark, sf_dir)
    found = books.spine_hrefs(opf.spine_items(nodes), opf.manifest_items(nodes))
    return found.select("book_id", F.row_number().over(W.partitionBy("book_id").orderBy("pos")).cast("long").alias("nth"), "idref", "href")


_METADATA = f"""SELECT book_id, CASE WHEN book_id % 2 = 0 THEN 'Book ' ELSE 'Plain ' END || book_id AS title, CASE WHEN book_id % 3 = 0 THEN '' ELSE kind END AS author, '' AS language,
  'last' AS series, '2' AS series_index, 'i' || k AS cover_id, {_HREF} AS cover_href FROM ({_PART}) WHERE nth = 1"""


@query(_METADATA)
def opf_metadata(spark, sf_dir):
    return opf.metadata(_packages(spark, sf_dir))


@query(f"SELECT * REPLACE (CASE WHEN book_id % 5 = 0 THEN 'New & ' || book_id ELSE title END AS title, CASE WHEN book_id % 4 = 0 THEN 'A. B.' ELSE author END AS author) FROM ({_METADATA})")
def opf_edited(spark, sf_dir):
    """Titles and authors edited in the document, written and read again."""
    nodes = _packages(spark, sf_dir)
    n = F.col("book_id")
    edits = nodes.select(F.col("doc_id").alias("book_id")).distinct().select("book_id", F.when(n % 5 == 0, F.concat(F.lit("New & "), n.cast("string"))).otherwise("").alias("title"), F.when(n % 4 == 0, "A. B.").alias("author"), F.lit(None).cast("string").alias("language"))
    written = reader.unshred(opf.set_metadata(nodes, edits))
    return opf.metadata(kept(reader.shred(written, "doc_id", "content")))


@query("SELECT * FROM (VALUES (1::BIGINT, 'b/y.opf'), (2, 'a/z/b.opf'), (3, 'c.opf'), (4, NULL)) t(book_id, opf_path)")
def opf_found(spark, sf_dir):
    boxes = spark.createDataFrame([(1, '<c:container xmlns:c="u"><c:rootfile full-path=""/><c:rootfile full-path="b/y.opf"/></c:container>'), (2, "<container><rootfile full-path='x.opf'>"), (3, "<container/>"), (4, "<container/>")], "doc_id long, x string")
    names = spark.createDataFrame([(1, "a.opf"), (2, "b.opf"), (2, "a/z/b.opf"), (2, "a.b/c.opf"), (3, "d.opf"), (3, "c.opf"), (3, "a.OPF"), (4, "a.txt")], "book_id long, name string")
    return opf.package_path(reader.shred(boxes, "doc_id", "x"), names)


@query(f"SELECT book_id, k, CASE WHEN k % 4 = 0 THEN 'img/' || replace(brand, '#', '%20') || '%20' || k || '.jpg' ELSE {_HREF} END AS href, CASE WHEN k % 4 = 0 THEN 'image/jpeg' ELSE 'image/png' END AS media_type FROM ({_PART})")
def rename_percent(spark, sf_dir):
    """Escaped addresses, renamed by their decoded paths or names."""
    part = table(spark, sf_dir, "part")
    name = F.concat(F.replace("p_brand", F.lit("#"), F.lit(" ")), F.lit(" "), F.col("p_partkey").cast("string"))
    items = part.select(F.col("p_size").alias("book_id"), F.col("p_partkey").alias("k"), F.concat(F.lit("img/"), F.replace(name, F.lit(" "), F.lit("%20")), F.lit(".png")).alias("href"), F.lit("image/png").alias("media_type"))
    folder = F.when(F.col("p_partkey") % 8 == 0, "img/").otherwise("else/")
    processed = part.filter("p_partkey % 4 = 0").select(F.col("p_size").alias("book_id"), F.concat(folder, name, F.lit(".png")).alias("path"), F.concat(name, F.lit(".jpg")).alias("filename"))
    return books.rename_hrefs(items, references.rename_map(processed))


@query("SELECT p_partkey AS k, 'a { b: url(img/' || CASE WHEN p_partkey % 4 = 0 THEN 'n ' || p_partkey || '.jpg' ELSE 'n%20' || p_partkey || '.png' END || ') c: url(x.png) url(open' AS css, true AS changed FROM part")
def css_urls(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("book_id"))
    key = F.col("book_id").cast("string")
    sheets = part.select("book_id", F.concat(F.lit("a { b: url( 'img/n%20"), key, F.lit(".png') c: url(\"x.png\") url(open"))).toDF("book_id", "css")
    renames = part.filter("book_id % 4 = 0").select("book_id", F.concat(F.lit("z/n "), key, F.lit(".png")).alias("old_path"), F.concat(F.lit("z/n "), key, F.lit(".jpg")).alias("new_path"))
    return references.update_sheets(sheets, renames).select(F.col("book_id").alias("k"), "css", "changed")


_MARKUP = [
    (1, "<html><head><title>t</title></head><body><pre>page-break-before</pre><p>x</p></body></html>", '<html><head><title>t</title><style type="text/css">h1, h2 { page-break-before: always; }</style></head><body><pre>page-break-before</pre><p>x</p></body></html>'),
    (2, "<html><head><style>p { page-break-before: always }</style></head><body/></html>", "<html><head><style>p { page-break-before: always }</style></head><body></body></html>"),
    (3, "<html><body><p><!-- x --></p><p></p> <p>y</p><svg><image xlink:href='a.png' xmlns:xlink='u'/></svg><svg><g/><image/></svg></body></html>", '<html><body><p><!-- x --></p> <p>y</p><img src="a.png" alt="Cover" style="max-width: 100%; max-height: 100%;"/><svg><g></g><image></image></svg></body></html>'),
    (4, "<html><body><p>Wait..... so</p><script>a....b</script></body></html>", "<html><body><p>Wait... so</p><script>a....b</script></body></html>"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, '{v}')" for k, _, v in _MARKUP) + ") t(doc_id, markup)")
def markup_steps(spark, sf_dir):
    """Small documents through the steps for markup, written again."""
    nodes = kept(reader.shred(spark.createDataFrame([(k, x) for k, x, _ in _MARKUP], "doc_id long, x string"), "doc_id", "x"))
    cleaned = kept(markup.clean_text(opf.svg_covers(markup.collapse_blank_blocks(nodes))).select(nodes.columns))
    out = reader.unshred(markup.add_page_breaks(cleaned))
    return out.select("doc_id", F.col("content").alias("markup"))


@query("SELECT l_linenumber::BIGINT AS image_id, 0 AS slot, l_quantity::INT AS symbol, count(*) AS n FROM lineitem GROUP BY ALL")
def huffman_counts(spark, sf_dir):
    return huffman.symbol_counts(table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("image_id"), F.lit(0).alias("slot"), F.col("l_quantity").cast("int").alias("symbol")))


@query()
def huffman_tables(spark, sf_dir):
    return huffman.tables(huffman_counts(spark, sf_dir))


@query("""WITH b AS (SELECT p_size::BIGINT AS book_id, sum(p_partkey) AS a, count(*) AS n FROM part GROUP BY ALL)
SELECT book_id, concat_ws('; ', 'Converted ' || n || '/' || n || ' images (' || n || ' PNG)', 'Removed ' || a || ' embedded fonts', CASE WHEN book_id % 2 = 0 THEN 'TOC: TOC is valid' END, 'Text cleanup: ' || n || ' extra spaces, 2 unicode fixes',
  'Removed ' || n || ' OS artifacts', 'Size: 1.0 KB → ' || CASE WHEN book_id % 3 = 0 THEN '512.0 B (50.0% reduction)' ELSE '2.0 KB (100.0% increase)' END) AS summary FROM b""")
def book_reports(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("book_id"), "p_partkey")
    one = lambda c, n: part.select("book_id", F.lit(c).alias("counter"), n.alias("n"))
    steps = one("images_total", F.lit(1)).unionByName(one("images_converted", F.lit(1))).unionByName(one("fonts_removed", F.col("p_partkey"))).unionByName(one("os_artifacts_removed", F.lit(1)))
    seen = reports.counters(steps).withColumn("image_formats", F.create_map(F.lit("PNG"), F.col("images_total"))).withColumn("toc_status", F.when(F.col("book_id") % 2 == 0, "TOC is valid").otherwise(""))
    for c in ("ocr_ligatures", "smart_quotes", "encoding", "punctuation"):
        seen = seen.withColumn(c, F.lit(0))
    seen = seen.withColumn("double_spaces", F.col("images_total")).withColumn("unicode", F.lit(2)).withColumn("original_size", F.lit(1024)).withColumn("optimized_size", F.when(F.col("book_id") % 3 == 0, 512).otherwise(2048))
    return seen.select("book_id", reports.book_summary().alias("summary"))


@query("SELECT * FROM (VALUES (1::BIGINT, 4::BIGINT), (2, 0), (3, 1)) t(book_id, removed)")
def junk_removed(spark, sf_dir):
    names = [(1, ".DS_Store"), (1, "a/Thumbs.db"), (1, "__MACOSX/x"), (1, "__MACOSX/y/z"), (1, "a/.git/b"), (1, "a/b.txt"), (2, "x"), (3, "__MACOSX/x")]
    return archives.removed_junk(spark.createDataFrame(names, "book_id long, name string"))


@query("SELECT p_size::BIGINT AS book_id, CASE split_part(p_type, ' ', 1) WHEN 'STANDARD' THEN 'xhtml' WHEN 'SMALL' THEN 'css' ELSE 'image' END AS kind, count(*) AS n FROM part GROUP BY ALL")
def content_kinds(spark, sf_dir):
    first = F.substring_index("p_type", " ", 1)
    kind = paths.content_kind(F.when(first == "STANDARD", "text/html").when(first == "SMALL", "text/CSS").otherwise("image/png"), F.lit("x"))
    return reports.content_kinds(table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("book_id"), kind.alias("kind")))


@query("SELECT id, width, height, gray_levels FROM (VALUES ('x4', 480, 800, 4), ('x3', 528, 792, 4)) t(id, width, height, gray_levels)")
def device_list(spark, sf_dir):
    return settings.devices(spark)


@query("SELECT c_custkey, CASE WHEN b = 0 THEN '0.0' ELSE printf('%.1f', abs((1 - a / b) * 100)) END || CASE WHEN a <= b THEN '% smaller' ELSE '% larger' END AS change, CASE WHEN c_custkey % 2 = 1 THEN b ELSE 0 END AS counted FROM (SELECT c_custkey, (c_custkey % 7 * 500)::DOUBLE AS b, (c_custkey * 31 % 1000)::DOUBLE AS a FROM customer)")
def result_rows(spark, sf_dir):
    before, after = (F.col("c_custkey") % 7 * 500).cast("double"), (F.col("c_custkey") * 31 % 1000).cast("double")
    return table(spark, sf_dir, "customer").select("c_custkey", reports.result_row(before, after)[0], reports.first_part_size(F.col("c_custkey") % 2, before).alias("counted"))


def _books(spark, sf_dir):
    """An archive for each source: its documents as chapters with spoiled texts, a font, junk, and a list of them."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.col("source").alias("book_id"), text.spoil(F.regexp_replace("text", "[\\x{0}-\\x{8}\\x{b}\\x{c}\\x{d}-\\x{1f}]", " ")).alias("text"))
    key = F.col("doc_id").cast("string")
    page = F.concat(F.lit('<html xmlns="http://www.w3.org/1999/xhtml"><head><title>t</title></head><body role="x"><p>'), paths.escape_text(F.col("text")), F.lit("</p></body></html>"))
    files = docs.select("book_id", F.concat(F.lit("OEBPS/c "), key, F.lit(".xhtml")).alias("name"), page.cast("binary").alias("content"))
    item = F.concat(F.lit('<item id="c'), key, F.lit('" href="c%20'), key, F.lit('.xhtml" media-type="application/xhtml+xml"/>'))
    held = kept(docs.groupBy("book_id").agg(F.array_join(F.array_sort(F.collect_list(item)), "").alias("items")))
    package = F.concat(F.lit('<package xmlns="http://www.idpf.org/2007/opf"><metadata/><manifest><item id="f" href="f.ttf" media-type="font/ttf"/>'), "items", F.lit("</manifest><spine/></package>"))
    extra = [("mimetype", F.lit(archives.MIME)), (archives.CONTAINER, F.lit('<container><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>')), ("OEBPS/p.opf", package), ("OEBPS/f.ttf", F.lit("font")), ("OEBPS/.DS_Store", F.lit("x"))]
    for name, content in extra:
        files = files.unionByName(held.select("book_id", F.lit(name).alias("name"), content.cast("binary").alias("content")))
    made = archives.zipped(files)
    return made.select("book_id", F.col("archive").alias("content"))


_PLAIN = "SELECT doc_id, source, regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0d-\\x1f]', ' ', 'g') AS text FROM documents WHERE text IS NOT NULL"
_PLAIN_CLEAN = text.clean_sql(f"SELECT doc_id, source, {text.spoil_sql('text')} AS text FROM ({_PLAIN})", "doc_id, source")


@query(f"SELECT source AS book_id, doc_id, md5(text) AS text_md5, false AS font FROM ({_PLAIN_CLEAN})")
def book_end_to_end(spark, sf_dir):
    """Archives processed, packed and read again: the text of each chapter, and whether its book's list still has the font."""
    made, _ = process.process(_books(spark, sf_dir))
    entries = kept(archives.extract(made.select("book_id", F.col("archive").alias("content"))))
    font = entries.groupBy("book_id").agg(F.max((F.col("name").endswith(".ttf") | (F.col("name").endswith(".opf") & F.col("content").cast("string").contains(".ttf"))).cast("int")).alias("font"))
    pages = entries.filter("name like '%.xhtml'").select(F.regexp_extract("name", "(\\d+)", 1).cast("long").alias("doc_id"), "book_id", F.col("content").cast("string").alias("x"))
    nodes = reader.shred(pages.select("doc_id", "x"), "doc_id", "x")
    inside = nodes.filter("kind = 'element' and name = 'p'").select("doc_id", F.col("node_id").alias("parent_id"))
    said = inside.join(nodes.filter("kind = 'text'").select("doc_id", "parent_id", "text"), ["doc_id", "parent_id"], "left")
    return said.join(pages.select("doc_id", "book_id"), "doc_id").join(font, "book_id").select("book_id", "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), (F.col("font") == 1).alias("font"))


@query(f"SELECT source AS book_id, count(*) AS chapters, sum(double_spaces + ocr_ligatures + smart_quotes + encoding + punctuation + unicode)::BIGINT AS fixes, 1::BIGINT AS fonts, 1::BIGINT AS junk FROM ({_PLAIN_CLEAN}) GROUP BY source")
def book_counters(spark, sf_dir):
    archives_ = kept(_books(spark, sf_dir))
    _, report = process.process(archives_)
    n = archives.extract(archives_).filter("name like '%.xhtml'").groupBy("book_id").agg(F.count("*").alias("chapters"))
    pick = lambda *names: F.coalesce(F.sum(F.when(F.col("counter").isin(*names), F.col("n"))), F.lit(0))
    return report.groupBy("book_id").agg(pick(*text.COUNTERS).alias("fixes"), pick("fonts_removed").alias("fonts"), pick("os_artifacts_removed").alias("junk")).join(n, "book_id")
