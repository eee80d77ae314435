"""Repair, archives, markup, books, style sheets and images on small inputs."""

import io
import xml.dom.minidom
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import paths, text
from foliant.operators import books, images, markup, reports, styles
from foliant.sources import archives
from foliant.sources import markup as reader


@pytest.mark.parametrize(
    ("given", "wanted", "counter", "n"),
    [
        ("Two  spaces   here.", "Two spaces here.", "double_spaces", 2),
        ("Really ? Yes , indeed .", "Really? Yes, indeed.", "double_spaces", 3),
        ("Wait..... Really,,, yes!!!!!!", "Wait... Really, yes!!!", "punctuation", 3),
        ("ﬁne ﬂow oﬀ", "fine flow off", "ocr_ligatures", 3),
        ("“a” ‘b’ – c… d", "\"a\" 'b' - c... d", "smart_quotes", 6),
        ("cafÃ©", "café", "encoding", 1),
        ("End.Next", "End. Next", "punctuation", 1),
        ("a\u0301", "\u00e1", "unicode", 1), ("a\u00a0; b", "a; b", "double_spaces", 1),
        (None, None, "unicode", 0),
        ("", "", "punctuation", 0),
    ],
)
def test_text(spark, given, wanted, counter, n):
    row = text.clean(spark.createDataFrame([(given,)], "text string")).first()
    assert (row.text, row[counter]) == (wanted, n)


def test_filenames(spark):
    rows = spark.createDataFrame([('A/B\\C:D*E?F"G<H>I|J', None), ("Spaced    Out", "Dash--Dash"), (None, None), ("x" * 300, "")], "t string, a string")
    got = [r[0] for r in rows.select(paths.filename(F.col("t"), F.col("a"))).collect()]
    assert got == ["A-B-C -DEF'GHI-J.epub", "Dash-Dash - Spaced Out.epub", "optimized.epub", "x" * 200 + ".epub"]


def test_percent(spark):
    row = spark.createDataFrame([("a%20b+%zz%C3%A9",)], "s string").select(paths.percent_decode("s").alias("d"), paths.percent_encode(F.lit('é "x"')).alias("e")).first()
    assert row.d == "a b+%zzé" and row.e == "%C3%A9%20%22x%22"


def book(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark):
    good = book(**{"mimetype": "application/epub+zip\n", "META-INF/container.xml": "<c/>", "b.txt": "b", "a.txt": "a", "x/.DS_Store": "", "__MACOSX/a": ""})
    rows = spark.createDataFrame([("good", good), ("evil", book(**{"../x": "x"})), ("broken", b"no zip"), ("null", None)], "book_id string, content binary")
    entries = archives.extract(rows)
    assert {r.book_id for r in entries.filter("error is not null").collect()} == {"evil", "broken"}
    packed = archives.package(entries).collect()
    assert [r.book_id for r in packed] == ["good"]
    data = bytes(packed[0].archive)
    z = zipfile.ZipFile(io.BytesIO(data))
    assert z.namelist() == ["mimetype", "META-INF/container.xml", "a.txt", "b.txt"] and data[38:58] == b"application/epub+zip"
    assert archives.validate(archives.extract(spark.createDataFrame([("good", data)], "book_id string, content binary"))).first().problems == []
    assert len(archives.validate(archives.extract(spark.createDataFrame([("x", book(a="1"))], "book_id string, content binary"))).first().problems) == 2


PAGE = '<html lang="en"><head><title> T </title></head><body><p data-x="1" class="k">a<p>b &amp; c<br><p> </p><p></p> <div></div><img src="x" hidden><b>open</body>'


def test_markup(spark):
    nodes = reader.shred(spark.createDataFrame([(1, PAGE), (2, "<a><b/>x</a>"), (3, None), (4, "")], "doc_id long, content string"))
    assert {r[0]: r[1] for r in nodes.select("doc_id", "recovered").distinct().collect()} == {1: True, 2: False, 4: True}
    cleaned = markup.add_page_breaks(markup.collapse_blank_blocks(markup.strip_attributes(nodes)))
    out = {r.doc_id: r.content for r in reader.unshred(cleaned).collect()}
    xml.dom.minidom.parseString(out[1])
    assert "data-x" not in out[1] and "hidden" not in out[1] and 'class="k"' in out[1] and "page-break-before" in out[1]
    assert out[1].count("<p>") == 2 and "<div>" not in out[1] and "b &amp; c" in out[1]
    assert out[2] == "<a><b></b>x</a>"
    again = reader.unshred(reader.shred(spark.createDataFrame([(1, out[1])], "doc_id long, content string"))).first().content
    assert again == out[1].split("\n", 1)[1]
    assert {r.doc_id: r.title for r in markup.chapter_titles(nodes).collect()} == {1: "T", 2: None, 4: None}
    with pytest.raises(ValueError):
        reader.strict(b'<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>')


def test_styles(spark):
    css = "@import 'x'; p, .no { a: b } .no > .none {} /* } */ a:hover {} @media print { .no {} } @font-face { src: url('}') } #id{} rest"
    assert "".join(r[2] for r in styles.split_rules(css)) == css
    rows = styles.rules(spark.createDataFrame([("s", css), ("e", None)], "sheet string, css string"))
    used = spark.createDataFrame([("element", "p"), ("id", "other")], "kind string, name string")
    kept = [r.selector for r in styles.keep_used(rows, used).orderBy("pos").collect()]
    assert kept == ["@import 'x'", "p, .no", "a:hover", "@media print", "@font-face", ""]
    assert "font-face" not in styles.sheets(styles.without_fonts(rows)).first().css


def test_books(spark):
    metas = spark.createDataFrame([(1, 0, "calibre:series", None, "S", None), (1, 1, None, "group-position", None, " 2 "), (1, 2, "cover", None, "c", None), (1, 3, "x", "ibooks:y", None, None), (1, 4, "dtb:uid", None, "", "")], "book_id int, pos int, name string, property string, content string, text string")
    manifest = spark.createDataFrame([(1, 0, "a", "a.xhtml", "t", ""), (1, 1, "a", "b.xhtml", "t", ""), (1, 2, "Cover1", "c.png", "image/png", "")], "book_id int, pos int, id string, href string, media_type string, properties string")
    assert books.series(metas).first()[1:] == ("S", "2")
    assert books.strip_store_metadata(metas).count() == 2
    assert books.cover_id(manifest, metas).first().cover_id == "c"
    assert books.cover_id(manifest, metas.filter("name = 'none'")).first().cover_id == "Cover1"
    spine = spark.createDataFrame([(1, 0, "a"), (1, 1, "gone"), (1, 2, "a")], "book_id int, pos int, idref string")
    assert [r.href for r in books.spine_hrefs(spine, manifest).orderBy("pos").collect()] == ["b.xhtml", "b.xhtml"]
    edits = spark.createDataFrame([(1, "New", "", None)], "book_id int, title string, author string, language string")
    old = spark.createDataFrame([(1, "t", "a", "l")], "book_id int, title string, author string, language string")
    assert tuple(books.apply_edits(old, edits).first()) == (1, "New", "a", "l")
    refs = spark.createDataFrame([(1, "img/c.png#c.png"), (1, "c.png")], "book_id int, ref string")
    names = spark.createDataFrame([(1, "z/c.png", "z/c.jpg")], "book_id int, old_path string, new_path string")
    assert books.resolve(refs, names).filter("ref = 'c.png'").first().target == "c.jpg"


def test_images(spark):
    r = spark.range(1).select(*[images.luma(*[F.lit(255 if k == c else 0) for c in range(3)]).alias(str(k)) for k in range(3)]).first()
    assert tuple(r) == (76, 150, 29)
    for level in (30, 64, 128, 190, 220):
        out = images.dither(np.full((64, 64), level))
        assert abs(out.mean() - level) < 6 and set(np.unique(out)) <= set(images.LEVELS)
    parts = images.split_spread(np.zeros((800, 2001, 3)))
    assert [p.shape[1] for p in parts] == [1001, 1000]
    assert images.flatten(np.array([[[0, 0, 0, 0], [10, 20, 30, 255]]], np.uint8)).tolist() == [[[255, 255, 255], [10, 20, 30]]]


def test_reports(spark):
    row = spark.createDataFrame([(1, 0, 0, 0, 2, 0)], ", ".join(f"{c} int" for c in text.COUNTERS))
    assert row.select(reports.summary()).first()[0] == "1 extra spaces, 2 punctuation fixes"
    sizes = spark.createDataFrame([(0,), (1023,), (1536,), (3 << 40,)], "n long").select(paths.format_size(F.col("n"))).collect()
    assert [r[0] for r in sizes] == ["0.0 B", "1023.0 B", "1.5 KB", "3.0 TB"]


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
