"""Packages, references, tables of codes, settings and small formatting, on cases with known answers."""

import heapq
import random

import numpy as np
import pytest

from foliant import settings
from foliant.functions import paths
from foliant.operators import books, huffman, images, opf, references
from foliant.plans import catalog
from foliant.sources import archives


def optimal_bits(counts):
    """Bits of an unlimited optimal code in which one more symbol, seen once, has a code."""
    heap = [int(c) for c in counts if c] + [1]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        total += x
        heapq.heappush(heap, x)
    return total


def test_huffman_tables():
    r = random.Random(1)
    for case in range(40):
        counts = np.array([int(r.paretovariate(0.3 + case % 5)) if r.random() < 0.5 else 0 for _ in range(256)])
        lengths, symbols = huffman.optimal_table(counts)
        own = np.repeat(np.arange(1, 17), lengths)
        assert sorted(symbols) == np.flatnonzero(counts).tolist() and len(own) == len(symbols)
        assert sum(2.0**-k for k in own) < 1
        used = sum(int(counts[s]) * int(k) for s, k in zip(symbols, own, strict=True))
        free = huffman.code_lengths(counts)
        if free.max() <= 16:
            assert used + int(free[256]) == optimal_bits(counts)
    fib = np.zeros(256, np.int64)
    fib[:24] = [int(1.618**k) + 1 for k in range(24)]
    lengths, symbols = huffman.optimal_table(fib)
    assert sum(lengths) == 24 and sum(n * 2.0 ** -(k + 1) for k, n in enumerate(lengths)) < 1
    assert huffman.optimal_table(np.zeros(256)) is None
    one = np.zeros(256, np.int64)
    one[7] = 5
    assert huffman.optimal_table(one) == ([1] + [0] * 15, [7])
    # equally rare: the highest number is the rarest
    even = np.zeros(256, np.int64)
    even[:3] = 4
    assert huffman.optimal_table(even)[1] == [0, 1, 2]


def test_settings(tmp_path):
    s = settings.Settings()
    assert s.label() == "Full" and settings.Settings.load(str(tmp_path / "none")) == s
    s.select("quick")
    assert not s.options.remove_fonts and s.options.text_cleanup
    s.customized(s.options.less(text_cleanup=True, grayscale=False))
    assert s.label() == "Custom" and not s.options.text_cleanup and s.options.grayscale
    assert s.save_preset(' Mine "a"\\ ') == "mine-a" and s.save_preset("mine a") == "mine-a-2" and s.save_preset("Full") == "full-2"
    where = str(tmp_path / "deep" / "settings.toml")
    s.save(where)
    assert settings.Settings.load(where) == s
    s.select("mine-a")
    s.delete_preset("mine-a")
    assert s.active == "custom" and s.all_presets()[-1] == ("custom", "Custom")
    for wrong in (lambda: s.select("gone"), lambda: s.delete_preset("gone"), lambda: s.update_preset("gone")):
        with pytest.raises(KeyError):
            wrong()
    with pytest.raises(ValueError):
        s.save_preset(" ")
    (tmp_path / "bad").write_text("device =")
    with pytest.raises(Exception):
        settings.Settings.load(str(tmp_path / "bad"))
    assert settings.device_profile("none") == settings.DEVICES["x4"] and s.options.processing("x3")["width"] == 528


def test_small(spark):
    wide = np.arange(6).reshape(2, 3)
    assert images.split_spread(wide)[0].tolist() == [[3, 0], [4, 1], [5, 2]] and images.split_spread(wide, rotate_left=True)[0].tolist() == [[2, 5], [1, 4], [0, 3]]
    assert images.gray_to_rgb(wide).shape == (2, 3, 3)
    got = spark.createDataFrame([(77.25,), (0.35,), (0.05,), (None,)], "x double").select(paths.one_decimal("x")).collect()
    assert [r[0] for r in got] == ["77.2", "0.3", "0.1", None]
    url = spark.createDataFrame([("a.PNG", b"x" * 100), ("b.svg", b"x"), ("c", b"\xff")], "n string, c binary")
    out = [r[0] for r in url.select(archives.cover_data_url(url.n, url.c)).collect()]
    assert out[0].startswith("data:image/png;base64,") and "\n" not in out[0] and out[1] is None and out[2] == "data:image/jpeg;base64,/w=="
    assert url.filter("n = 'c'").select(archives.text_of(url.c)).first()[0] == "�"
    new = archives.fresh_paths(spark.createDataFrame([("a.EPUB",), ("a.EPUB",), ("b.epub",), ("c.txt",)], "path string"), spark.createDataFrame([("b.epub",)], "path string"))
    assert [r.path for r in new.collect()] == ["a.EPUB"]


def test_references(spark):
    nodes = catalog.reader.shred(spark.createDataFrame([(1, "<a><img src='x/my%20a.png'/><image xlink:href='a.png' xmlns:xlink='u'/><p style='b: url(c/my%20a.png)' href='my a.png'>t</p></a>")], "doc_id long, x string"), "doc_id", "x")
    renames = spark.createDataFrame([(1, "q/my a.png", "q/new.jpg"), (1, "a/my a.png", "a/first.jpg")], "book_id long, old_path string, new_path string")
    out = {r.name: r.attrs for r in references.update_nodes(nodes, renames).collect() if r.kind == "element"}
    assert out["img"]["src"] == "x/first.jpg" and out["image"]["xlink:href"] == "a.png" and out["p"] == {"style": "b: url(c/first.jpg)", "href": "my a.png"}
    refs = spark.createDataFrame([(1, "my%20a.png/my%20a.png"), (1, "o%20x")], "book_id long, ref string")
    assert sorted(r.target for r in books.resolve(refs, renames).collect()) == ["first.jpg/first.jpg", "o%20x"]


def test_contents_outcome(spark):
    every = spark.createDataFrame([(1,), (2,), (3,)], "book_id long")
    spine = spark.createDataFrame([(2, 1, "a"), (3, 1, "a")], "book_id long, pos int, idref string")
    usable = spark.createDataFrame([(2, True), (3, False)], "book_id long, usable boolean")
    chapters = spark.createDataFrame([(3,), (3,)], "book_id long")
    assert {r.book_id: r.toc_status for r in opf.toc_outcome(every, spine, usable, chapters).collect()} == {1: "Empty spine", 2: "TOC is valid", 3: "Generated TOC with 2 entries"}
    items = spark.createDataFrame([(1, 4, "a", "a.x", "t", "")], "book_id long, pos int, id string, href string, media_type string, properties string")
    added = opf.add_item(items, spark.createDataFrame([(1, "b", "b.jpg", "image/jpeg")], "book_id long, id string, href string, media_type string"))
    assert [(r.pos, r.id) for r in added.orderBy("pos").collect()] == [(4, "a"), (5, "b")]
