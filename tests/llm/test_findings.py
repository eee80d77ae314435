"""Cases in which an operator did less than the whole job."""

import random

import duckdb

from foliant.llm import digests, jaccard, language, quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_edited_copies_are_near(spark, tmp_path):
    """Copies with 5 to 8 % of their words changed, by the registered query, its SQL and the pipeline's stage."""
    r = random.Random(7)
    rows = []
    for k in range(12):
        words = [f"w{k}x{r.randrange(10_000)}" for _ in range(100)]
        rows.append((10 * k, " ".join(words)))
        for j, edits in enumerate((5, 6, 7, 8)):
            own = list(words)
            for e in range(edits):
                own[3 + 12 * e] = f"new{j}x{e}"
            rows.append((10 * k + j + 1, " ".join(own)))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], COLUMNS)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    pairs = {(p.doc_a, p.doc_b) for p in jaccard.jaccard_join(df, threshold=jaccard.THRESHOLD).collect()}
    assert {(10 * k, 10 * k + j) for k in range(12) for j in (1, 2, 3, 4)} <= pairs
    got = sorted((p.doc_id, p.class_id, p.copies, p.links) for p in jaccard.op5_jaccard_join(spark, str(tmp_path)).collect())
    assert [p[1] for p in got] == [p[0] // 10 * 10 for p in got]
    documents = df.toArrow()  # noqa: F841
    assert got == sorted(duckdb.sql(jaccard.SQL).fetchall())
    assert {x.doc_id for x in jaccard.keep_one_of_each(df).collect()} == {10 * k for k in range(12)}


def test_a_large_group_makes_few_rows(spark, tmp_path, monkeypatch):
    """200 different near copies of one text are 19,900 links: counted to the last one, in cells too, without a row for each pair."""
    r = random.Random(11)
    words = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join([*words[: k % 90], f"new{k}", *words[k % 90 + 1 :]])) for k in range(200)]
    rows += [(1000 + k, " ".join(r.choice("the of and to in a is that it".split()) if j % 2 else f"x{r.randrange(10**6)}" for j in range(60))) for k in range(300)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], COLUMNS)
    want = [(k, 0 if k < 200 else k, 0, 199 if k < 200 else 0) for k, _ in rows]
    made = jaccard.similar_sets(df, threshold=jaccard.THRESHOLD, whole=False)[2].collect()
    assert len(made) < 2 * 200 and sum(x.links for x in made if x.a == x.b) == 200 * 199
    for cell in (jaccard.CELL, 1 << 13):
        monkeypatch.setattr(jaccard, "CELL", cell)
        assert sorted(map(tuple, jaccard.classes(df).collect())) == want
    assert jaccard.jaccard_join(df, threshold=jaccard.THRESHOLD).count() == 200 * 199 // 2


def test_common_ngrams_make_few_candidates():
    """Texts that have common n-grams only beside their own ones: entries meet seldom."""
    import numpy as np
    import pyarrow as pa

    from foliant.llm.core import buffers

    r = random.Random(12)
    common = [f"c{a} c{b}" for a in range(9) for b in range(9)]
    texts = [" ".join(r.choice(common) if r.random() < 0.5 else f"x{r.randrange(10**6)}" for _ in range(r.randrange(20, 60))) for _ in range(600)]
    out = jaccard.signatures(*jaccard.gram_sets(*buffers(pa.array(texts)), 2), 0.7)
    sig, role = out[2], out[4]
    values, at = np.unique(sig, return_inverse=True)
    meet = np.bincount(at[role & jaccard.PROBE > 0], minlength=len(values)) * np.bincount(at[role & jaccard.INDEX > 0], minlength=len(values))
    own = np.bincount(at[(role & jaccard.PROBE > 0) & (role & jaccard.INDEX > 0)], minlength=len(values))
    assert (meet - own).sum() < 2 * len(texts)


def test_matches_that_both_came_later(spark, monkeypatch):
    """Every feature of two near copies is first held by someone else; the copies still find each other, in one cell and in several."""
    r = random.Random(13)
    left, right, one, two = (" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(150)) for _ in range(4))
    rows = [(1, left + one), (2, right + two), (3, left + right), (4, right + left)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], COLUMNS)
    for cell in (digests.CELL, 100):
        monkeypatch.setattr(digests, "CELL", cell)
        got = {x.doc_id: x for x in digests.fingerprints(df).collect()}
        for a in got:
            score = {b: digests.compare(bytes(got[a].digest), got[a].n_features, bytes(got[b].digest), got[b].n_features) for b in got if b != a and {a, b} != {1, 2}}
            best = max(score, key=lambda b: (score[b], -b))
            assert (got[a].match, got[a].score) == (best, score[best])
        assert (got[3].match, got[4].match) == (4, 3)


def test_toxicity_without_list_words(spark, tmp_path):
    """Toxic words of three made-up languages, none of them listed; half of the rows have no label."""
    r = random.Random(9)
    stop = "the of and to in a is that for on with as was".split()
    start = ["zormel", "quätsch", "brivoni"]
    rows, labels = [], []
    for k in range(900):
        ws = [r.choice(stop) if r.random() < 0.3 else f"word{r.randrange(300)}" for _ in range(80)]
        toxic = k % 9 < 3
        if toxic:
            for at in r.sample(range(80), 4):
                ws[at] = start[k % 3] + r.choice("aeiou") + str(r.randrange(50))
        rows.append((k, " ".join(w + ("." if j % 9 == 8 else "") for j, w in enumerate(ws)), "en", "s", 1))
        if k % 2:
            labels.append((k, 1, int(toxic)))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {x.doc_id: x.keep for x in quality.op8_quality_classifier(spark, str(tmp_path)).collect()}
    for n in range(3):
        held_out = [k for k in range(0, 900, 2) if k % 9 == n]
        assert sum(not kept[k] for k in held_out) > 0.9 * len(held_out)
    clean = [k for k in range(0, 900, 2) if k % 9 >= 3]
    assert sum(kept[k] for k in clean) > 0.97 * len(clean)


def test_declaration_after_a_long_preamble(spark):
    docs = spark.createDataFrame([(1, "der und nicht", "de", "s", 1), (2, "the of and", "en", "s", 1)], COLUMNS)
    long = "x" * 5_000
    pages = [f"<!-- {long} <html lang='en'> --><html lang='de'><p>und</p>", f"<script>{long} <html lang='en'></script><html lang=de>", " " * 5_000 + "<html lang=de>", f"<html class='{long}' lang='de'>"]
    df = spark.createDataFrame([(k, "http://a.example/", h) for k, h in enumerate(pages)], "page_id long, url string, html string")
    assert [x.declared for x in language.identify(df, docs).collect()] == ["de"] * 4


def test_more_than_64_languages(spark):
    names = [f"l{k:02}" for k in range(70)]
    say = {n: " ".join(chr(97 + k % 26) * 2 + chr(97 + k // 26) + c for c in "aeiou") for k, n in enumerate(names)}
    docs = spark.createDataFrame([(k, say[n] * 3, n, "s", 1) for k, n in enumerate(names)], COLUMNS)
    assert language.model(docs)[0] == names
    df = spark.createDataFrame([(k, f"http://{n}.example.{n}/", f"<html><p>{say[n] * 3}</p>") for k, n in enumerate(names)], "page_id long, url string, html string")
    assert {x.page_id: x.language for x in language.identify(df, docs).collect()} == dict(enumerate(names))


def test_a_chain_of_texts_is_not_sent_to_all_cells(spark, monkeypatch):
    """Texts that features connect one to the next: each goes where its own passages are, not to every cell of the chain."""
    r = random.Random(17)
    passages = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 9))) for _ in range(90)) for _ in range(61)]
    rows = [(k, f"{passages[k]}\n{passages[k + 1]}", "en", "s", 0) for k in range(60)]
    sent, in_cells = [], jaccard.in_cells

    def counted(rows, cell):
        out = in_cells(rows, cell)
        sent.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "in_cells", counted)
    monkeypatch.setattr(digests, "CELL", 600)
    got = {x.doc_id: x.match for x in digests.fingerprints(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert all(abs(m - k) == 1 for k, m in got.items()) and sent[0] <= 3 * len(rows)
