"""The ten operators and the stages, against brute force on small tables that hold the awkward cases."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import digests, jaccard, language, mixing, packing, quality, repeats, repetition, sharding, tokens
from foliant.llm.core import Words, buffers

WORD = [f"w{k}" for k in range(300)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(1)


def prose(n):
    return " ".join(rng.choice(WORD) for _ in range(n))


BASE = prose(120)
SHARED = prose(60)
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE + " more words here"), (4, "  " + BASE.upper().lower()), (5, None), (6, ""), (7, " \n "), (None, prose(30)), (8, "one"), (8, "one"), (9, "one"), (10, "two words"),
    (11, prose(40) + " " + SHARED + " " + prose(30)), (12, prose(10) + " " + SHARED), (13, SHARED + " " + prose(200)), (14, prose(9000)), (15, "a b " * 200), (16, prose(70)), (16, prose(80)), (17, "é  ü 　x\x1cy  z\n\n q\r\n"), (-3, prose(60)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{(i or 0) % 3}" if i != 10 else None, len(t or "")) for i, t in TEXTS]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def wide(docs):
    """With columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    out = docs
    for c in ("cuts", "block", "part", "n_tokens", "uses", "use", "whole", "p", "keeper", "__gone", "mix_row", "key", "word_count", "count"):
        out = out.withColumn(c, F.lit(1))
    return out


def test_token_files(docs, empty, tmp_path):
    encoder = tokens.Encoder()
    want = Counter()
    for i, t in TEXTS:
        ids = encoder.bpe.encode_ordinary(t or "")
        for a in range(0, len(ids), 16):
            want[i, a, tuple(ids[a : a + 16])] += 1
    for rows in ([bytes(r.data) for r in tokens.sequences(docs, length=16, file_rows=50).collect()], [r.path for r in tokens.write_sequences(docs, str(tmp_path), length=16, file_rows=50).collect()]):
        got = Counter()
        for source in rows:
            ids, first, own, mask = tokens.open_sequences(source)
            assert own.shape[1] == 16 and own.base is not None and (own[mask == 0] == 0).all()
            for k in range(len(own)):
                got[ids[k].as_py(), int(first[k]), tuple(own[k][mask[k] == 1].tolist())] += 1
        assert got == want
    assert tokens.sequences(empty).count() == 0


def slow_digest(text, rank):
    data = text.encode()
    h = [digests.entropies(np.frombuffer(data[k : k + 64], np.uint8))[0] for k in range(len(data) - 63)]
    points = Counter()
    for a in range(len(h) - 63):
        k = min(range(a, a + 64), key=lambda j: (rank[h[j]] or 2000, j))
        if rank[h[k]]:
            points[k] += 1
    return list(dict.fromkeys(data[k : k + 64] for k in sorted(points) if points[k] >= 16))


def test_fingerprints(docs, empty):
    data = np.frombuffer((BASE * 2).encode(), np.uint8)
    for k in range(0, 300, 37):
        n = np.bincount(data[k : k + 64])
        exact = -sum(c / 64 * np.log2(c / 64) for c in n if c) / 6 * 1000
        assert abs(digests.entropies(data)[k] - exact) <= 1
    got = {(r.doc_id, r.text_print): r for r in digests.fingerprints(docs).collect()}
    rank = digests.ranks(docs)
    assert {k[0] for k in got} == {i for i, _ in TEXTS if i is not None}
    by = {}
    for i, t in {(i, t) for i, t in TEXTS if i is not None}:
        d, off = buffers(pa.array([t or ""]))
        p = int(digests.text_prints(d, off).view(np.int64)[0])
        by[i, p] = slow_digest(t or "", rank)
        assert got[i, p].n_features == len(by[i, p])
    met = {key: {o for o in by if o != key and set(by[o]) & set(own)} for key, own in by.items()}
    for key, own in by.items():
        others = met[key]
        score = {o: digests.compare(bytes(got[key].digest), len(own), bytes(got[o].digest), len(by[o])) for o in others}
        best = max(score, key=lambda o: (score[o], -o[0]), default=None)
        assert (got[key].match, got[key].score) == ((best[0], score[best]) if best else (None, None))
    assert {i: r.score for (i, _), r in got.items()}[2] == 100.0
    assert digests.compare(b"", 0, b"", 0) == 0 and digests.fingerprints(empty).count() == 0


def test_packing(docs, empty, spark):
    encoder = tokens.Encoder()
    out = packing.pack(docs, capacity=256).collect()
    pieces = sorted((x.doc_id is None, x.doc_id or 0, x.first_token, x.n_tokens) for r in out for x in r["items"])
    want = []
    for i, t in TEXTS:
        n = len(encoder.bpe.encode_ordinary(t or ""))
        want += [(i is None, i or 0, a, min(256, n - a)) for a in range(0, n, 256)]
    assert pieces == sorted(want)
    assert all(r.n_tokens == sum(x.n_tokens for x in r["items"]) <= 256 and r.slack == 256 - r.n_tokens for r in out)
    assert packing.pack(empty).count() == 0
    from itertools import combinations

    for seed in range(20):
        r = random.Random(seed)
        sizes = sorted((r.randint(1, 40) for _ in range(10)), reverse=True)
        first = packing.pack_lengths(np.array(sizes), 60)[0]
        best = max(sum(c) for n in range(10) for c in combinations(sizes[1:], n) if sum(c) <= 60 - sizes[0])
        assert first[0] is not None and sum(sizes[k] for k in first) == sizes[0] + best


def test_repetition(docs, empty):
    rows = repetition.repetition(docs).collect()
    assert len(rows) == len(TEXTS) and repetition.repetition(empty).count() == 0
    keep = {r.doc_id: r.keep for r in rows}
    assert not keep[15] and keep[5] and keep[14]


def grams(t):
    ws = (t or "").lower().split()
    return frozenset([tuple(ws)] if 0 < len(ws) < 2 else zip(ws, ws[1:], strict=False)) if ws else None


def test_jaccard(spark, docs, empty):
    r = random.Random(5)
    rows = [(i, t) for i, t in TEXTS]
    for k in range(60):
        words = prose(r.randint(3, 60)).split()
        for j in range(3):
            own = list(words)
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = "changed"
            rows.append((100 + 3 * k + j, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {}
    for i, t in rows:
        if i is not None and grams(t):
            sets.setdefault(grams(t), set()).add(i)
    want = set()
    reps = [(min(v), g) for g, v in sets.items()]
    for a in range(len(reps)):
        for b in range(a):
            (x, s), (y, q) = reps[a], reps[b]
            if x != y and len(s & q) >= 0.8 * len(s | q) - 1e-9:
                want.add((min(x, y), max(x, y)))
    for v in sets.values():
        want |= {(min(v), i) for i in v if i != min(v)}
    assert {(p.doc_a, p.doc_b) for p in jaccard.jaccard_join(df).collect()} == want
    assert jaccard.jaccard_join(empty).count() == 0 and jaccard.classes(empty).count() == 0
    import duckdb

    documents = df.toArrow()  # noqa: F841
    got = sorted(map(tuple, jaccard.classes(wide(df)).collect()))
    assert got == sorted(duckdb.sql(jaccard.SQL).fetchall()) and {x[0] for x in got} >= {16, 8, -3, 1}
    kept = jaccard.keep_one_of_each(wide(docs))
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert kept.columns == wide(docs).columns
    assert [i for n, i in ids if not n] == [-3, 1, 5, 6, 7, 8, 10, 11, 12, 13, 14, 15, 16, 16, 17] and sum(n for n, _ in ids) == 1


def test_sharding(docs, empty):
    rows = sharding.shard(docs, limit=3000).collect()
    assert len(rows) == len(TEXTS)
    held = defaultdict(int)
    for r in rows:
        held[r.shard] += r.n_bytes
    names = sorted(held)
    assert not any(b.startswith(a) for a in names for b in names if a != b)
    over = {r.shard for r in rows if r.over_limit}
    assert all((n > 3000) == (s in over) for s, n in held.items()) and len(over) == 1
    for s in names:  # only buckets over the limit were split
        if s:
            assert sum(n for o, n in held.items() if o.startswith(s[:-1])) > 3000
    assert sharding.shard(empty).count() == 0
    import duckdb

    documents = docs.toArrow()  # noqa: F841
    assert sorted(map(tuple, [x for x in duckdb.sql(sharding.sql(3000)).fetchall() if x[0] is not None])) == sorted((r.doc_id, r.n_bytes, r.shard, r.over_limit) for r in rows if r.doc_id is not None)


def slow_repeats(rows, n):
    docs = sorted({(i, t) for i, t in rows if i is not None and t}, key=lambda r: (r[0], 0))
    first, later = {}, defaultdict(set)
    kept = defaultdict(set)
    for d in docs:
        ws = d[1].split()
        for a in range(len(ws) - n + 1):
            w = tuple(ws[a : a + n])
            if w in first:
                later[d] |= set(range(a, a + n))
                k, b = first[w]
                kept[k] |= set(range(b, b + n))
            else:
                first[w] = (d, a)
    return {d: later[d] - kept[d] for d in docs}


def test_repeats(docs, empty):
    n = 20
    want = slow_repeats(TEXTS, n)
    got = defaultdict(set)
    for r in repeats.repeated_passages(docs, n).collect():
        for x in r.runs:
            if x.removable:
                got[r.doc_id] |= set(range(x.first_word, x.end_word))
    single = [d for d in want if sum(i == d[0] for i, _ in want) == 1]
    assert {d[0]: want[d] for d in single if want[d]} == {i: w for i, w in got.items() if i in {d[0] for d in single}}
    out = repeats.without_repeats(wide(docs), n)
    assert out.columns == wide(docs).columns
    left = {r.doc_id: r for r in out.collect()}
    assert 2 not in left and left[3].text == "more words here" and left[3].n_chars == 15 and left[1].text == BASE and 5 in left and 6 in left
    assert repeats.without_repeats(empty, n).count() == 0


def test_quality(spark, docs, empty):
    r = random.Random(2)
    stop = "the of and to in a is that for on with as was".split()
    rows = []
    for k in range(400):
        ws = [r.choice(stop) if r.random() < 0.3 else r.choice(WORD).replace("w", "word") for _ in range(80)]
        good = " ".join(w + ("." if j % 9 == 8 else "") for j, w in enumerate(ws))
        bad = [" ".join(w.upper() + "!!" for w in ws), " ".join(w + "***" for w in ws), " ".join([ws[0]] * 40 + [ws[1]] * 40)][k % 3]
        toxic = good.replace(" the ", " idiot moron ").replace(" of ", " scum trash ")
        rows.append((k, [good, good, good, good, bad, toxic][k % 6], "en", "s", 1))
    df = spark.createDataFrame(rows, COLUMNS)
    got = {r.doc_id: r.keep for r in quality.quality(df).collect()}
    assert sum(got[k] == (k % 6 < 4) for k in got) > 0.97 * len(got)
    kept = quality.accepted(wide(df))
    assert kept.columns == wide(df).columns and {r.doc_id for r in kept.collect()} == {k for k, v in got.items() if v}
    odd = quality.quality(docs).collect()
    assert len(odd) == len(TEXTS) and not any(r.keep for r in odd if r.doc_id in (5, 6, 7))
    assert quality.quality(empty).count() == 0 and quality.accepted(empty).count() == 0


def test_mixing(spark, docs, empty):
    import duckdb

    r = random.Random(3)
    rows = [(k, prose(r.randint(0, 30)), "en", r.choice(["big"] * 6 + ["mid", "mid", "low"]), 1) for k in range(500)]
    df = spark.createDataFrame(rows + rows[:5], COLUMNS)
    documents = df.toArrow()  # noqa: F841
    key = lambda r: (r[0], r[1], r[2], r[3], r[4], r[5], r[6])
    got = sorted(map(key, mixing.mix(df, 0.95, 4.0, block=20).collect()))
    want = sorted(map(key, duckdb.sql(mixing.sql(0.95, 4.0, block=20)).fetchall()))
    assert got == want
    size, total = Counter(), Counter()
    for i, t, _, s, _ in rows + rows[:5]:
        size[s] += len(t.split())
    for g in got:
        total[g[1]] += g[3]
    shares = np.array([size[s] for s in sorted(size)]) / sum(size.values())
    a = mixing.exponent(list(shares), 0.95, 4.0)
    q = shares**a / (shares**a).sum()
    assert abs(-(q * np.log(q)).sum() - 0.95 * np.log(len(q))) < 1e-6
    assert np.abs(np.array([total[s] for s in sorted(size)]) / sum(total.values()) - q).max() < 0.02
    assert max(total[s] / size[s] for s in size) <= 4.1 and {g[0] for g in got} == set(range(500))
    assert mixing.exponent([0.9, 0.1], 1.0, 2.0) > 0
    assert sorted(map(key, mixing.mix(df, 0.95, 4.0, block=20, sent=1).collect())) == want  # more sources than are sent
    assert Counter(r.doc_id for r in mixing.mixed(df, 0.95, 4.0, block=20, sent=1).collect()) == Counter(g[0] for g in got)
    out = mixing.mixed(wide(docs), 1.0, 3.0)
    assert out.columns == wide(docs).columns
    uses = Counter((r[0]) for r in mixing.mix(docs, 1.0, 3.0).collect())
    assert Counter(r.doc_id for r in out.collect()) == uses and set(uses) == {i for i, _ in TEXTS}
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_language(spark, empty):
    say = {"en": "the house that was with their river and", "de": "der und nicht mit einer straße für auch", "fr": "le des dans pour avec une être qui"}
    r = random.Random(4)
    some = lambda lang, n: " ".join(r.choice(say[lang].split()) for _ in range(n))
    docs = spark.createDataFrame([(k, some(lang, 60), lang, "s", 1) for k, lang in enumerate(list(say) * 20)] + [(99, None, "en", "s", 0), (98, "x", None, None, None)], COLUMNS)
    pages, truth = [], {}
    for k in range(90):
        lang = list(say)[k % 3]
        body = some(lang, 30) if k % 5 else ""  # every fifth says nothing: its host must tell
        pages.append((k, f"https://{lang}{k % 2}.example.{lang}/x", f"<html><script>the the</script><p>{body}</p></html>"))
        truth[k] = lang
    pages += [(None, None, None), (200, "nonsense", ""), (0, pages[0][1], pages[0][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = language.identify(df, docs).collect()
    assert len(got) == len(pages) and all(r.language for r in got)
    assert sum(truth.get(r.page_id) == r.language for r in got) >= 90
    assert language.identify(df, empty).filter("language is null").count() == len(pages)
    assert language.identify(df.limit(0), docs).count() == 0


def test_words():
    w = Words(*buffers(pa.array(["a  b", None, "", "\tc\n", "d"])))
    assert w.doc.tolist() == [0, 0, 3, 4] and np.diff(w.first).tolist() == [2, 0, 0, 1, 1]
