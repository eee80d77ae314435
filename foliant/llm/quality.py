"""Quality classifier from weak labels.

Heuristic labellers look at each document and vote 1 (good), 2 (bad) or 0 (no
opinion).  How often each is right is not known: expectation-maximisation over
the counts of vote patterns (a table of at most 3**labellers rows, however many
documents there are) estimates the share of bad documents and each labeller's
vote probabilities in both classes.  The posterior of a pattern labels every
document that has it, and those labels train a linear scorer over hashed
features, which then scores all documents.

Two such models share one pass over the text: *quality* (shouting, symbols,
tables, stuttering, ...) and *toxicity* (insults: how many, how dense, how
varied).  A document is kept if its quality is at least one half and its
toxicity below one half.

The patterns are counted over all documents.  The scorer is fitted on at most
``fit_documents`` of them with ``fit_entries`` features in all, drawn by a hash in which
copies differ, so that no group of copies is drawn as a whole.

The list of insults is nearly all English.  Where a table of labels is given, at most ``SAMPLE`` of
its rows, drawn by hash of doc_id, show which beginnings of words stand in many more toxic
texts than others, whatever their language; a labeller votes by these, and the
list then only speaks up where it finds a word.  Nothing else is learned from labels.

A null or blank text has no features and no votes: it scores 0 and is not kept
by the filter.  Every row gives one row; repeated and null doc_ids are allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.core import U, Words, binary, buffers, documents, id_text, mix, pack, pieces, release, spans_hash, text_prints, unpack

#: Documents on which the scorer is fitted, at most.
FIT_DOCUMENTS = 20_000
#: Slots of the hashed features.
SLOTS = 1 << 17
#: Entries of features (8 bytes each) on which the scorer is fitted, at most: very long documents may reach it before ``FIT_DOCUMENTS``.
FIT_ENTRIES = 16 << 20
#: Passes over them, rows of a mini-batch, and the first step size.
EPOCHS, ROWS, RATE = 8, 256, 0.05
#: Labelled documents from which beginnings of toxic words are learned, at most.
SAMPLE = 4_000
#: Bytes of a beginning; toxic texts that must have it, at least; and how many times as common it must be in them.
BEGINNINGS, HOLDERS, TIMES = (4, 5, 6, 7, 8), 5, 20
#: Prior share of false alarms of a labeller, and of bad documents.
ALARMS, SHARE = 0.004, 0.1

STOPWORDS = (
    "the of and to in a is that for on with as was are by it from this be an or at not have has "
    "le la les de des du et un une en que qui dans pour sur est avec par au plus pas "
    "der die das und ein eine ist nicht mit von zu im den dem des auf für sich auch "
    "el los las y del que en por con para una su al es lo como se no"
).split()
INSULTS = (
    "idiot idiots idiotic moron morons moronic stupid dumb dumbass imbecile loser losers scum scumbag trash garbage pathetic "
    "worthless disgusting clown clowns retard retarded bastard bastards bitch asshole jerk filth filthy vermin freak ugly "
    "hate disgrace lowlife parasite degenerate crap shit fuck fucking "
    "idiota estúpido estúpida imbécil basura asqueroso idiote stupide imbécile salaud ordure dégoûtant "
    "dumm dummkopf abschaum wertlos ekelhaft vollidiot trottel"
).split()
QUALITY = ["symbols", "shouting", "separators", "stutter", "stopwords", "sentences", "word_length", "lines"]
TOXIC = ["any_insult", "insults", "density", "kinds", "learned"]
NONE = np.zeros(0, np.uint64)


def _hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    end = np.cumsum([len(r) for r in raw])
    return np.unique(spans_hash(data, end - [len(r) for r in raw], end, fold=True))


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Membership in a small set of hashes."""
    table = np.zeros(1 << 14, bool)
    table[known >> U(50)] = True
    hit = table[h >> U(50)]
    at = np.flatnonzero(hit)
    hit[at] = np.isin(h[at], known)
    return hit


_STOP, _INSULT = _hashes(STOPWORDS), _hashes(INSULTS)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in ".,;:!?\"'()[]#$%&*|-"]] = True


class Texts:
    """What labellers and features need of many texts, computed once."""

    def __init__(self, data: np.ndarray, off: np.ndarray, parts: np.ndarray = NONE):
        w = self.words = Words(data, off, hashed=False)
        self.docs, self.data, self.off = len(off) - 1, data, off
        # words less punctuation at either end; words of punctuation stay whole
        a, b = w.start.copy(), w.end.copy()
        for _ in range(4):
            a = np.where((a < b - 1) & _EDGE[data[np.minimum(a, max(0, len(data) - 1))]], a + 1, a) if len(data) else a
            b = np.where((b > a + 1) & _EDGE[data[b - 1]], b - 1, b) if len(data) else b
        self.core = spans_hash(data, a, b, fold=True)
        self.n = np.diff(w.first)
        self.bytes = np.diff(off)
        self.begin, self.end, self.parts = a, b, parts
        self.learned = np.zeros(self.docs, np.int64)
        if len(parts):
            flag = np.zeros(len(a), bool)
            for at, h in self.beginnings():
                flag[at] |= _among(h, parts)
            self.learned = self.words_with(flag)

    def beginnings(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of each length in ``BEGINNINGS`` or more, and hashes of their first bytes."""
        for k in BEGINNINGS:
            at = np.flatnonzero(self.end - self.begin >= k)
            yield at, spans_hash(self.data, self.begin[at], self.begin[at] + k, fold=True)

    def learned_vote(self) -> np.ndarray:
        """Bad from two words with a toxic beginning, or one in 250; no opinion without learned ones."""
        if not len(self.parts):
            return np.zeros(self.docs, np.int64)
        share = self.learned / np.maximum(1, self.n)
        bad = ((self.learned > 1) & (share > 0.002)) | (share > 0.004)
        return np.where(self.n == 0, 0, np.where(bad, 2, np.where(self.learned == 0, 1, 0)))

    def per_doc(self, flag: np.ndarray) -> np.ndarray:
        """How many bytes of each text have the flag."""
        total = np.r_[0, np.cumsum(flag)]
        return total[self.off[1:]] - total[self.off[:-1]]

    def words_with(self, flag: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flag)]
        return total[self.words.first[1:]] - total[self.words.first[:-1]]


def _vote(value: np.ndarray, good, bad, known: np.ndarray) -> np.ndarray:
    return np.where(~known, 0, np.where(bad(value), 2, np.where(good(value), 1, 0))).astype(np.int64)


def _any(*votes: np.ndarray) -> np.ndarray:
    """Bad if one of the votes is, good if all cast are."""
    return np.where(np.any([v == 2 for v in votes], axis=0), 2, np.max(votes, axis=0))


def votes(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Patterns of the quality and of the toxicity labellers, as numbers of base 3."""
    with np.errstate(divide="ignore", invalid="ignore"):
        w, data, n = t.words, t.data, np.maximum(1, t.n)
        some, text = t.n > 0, t.n >= 12
        letters = np.maximum(1, t.per_doc(_LETTER[data]))
        size = np.maximum(1, t.bytes)
        ends = (data == 46) | (data == 33) | (data == 63)
        again = np.zeros(len(w.start), bool)
        again[1:] = (t.core[1:] == t.core[:-1]) & (w.doc[1:] == w.doc[:-1])
        single = (w.end - w.start == 1) & _MARK[data[w.start]]
        # words that end in a mark, and that hold a mark twice running
        marked = _MARK[data[w.end - 1]] if len(w.end) else np.zeros(0, bool)
        twice = np.zeros(len(data) + 1, np.int64)
        if len(data) > 1:
            twice[2:] = np.cumsum(_MARK[data[1:]] & (data[1:] == data[:-1]))
        runs = twice[w.end] - twice[np.minimum(w.start + 1, len(data))] > 0
        stop = _among(t.core, _STOP)
        insult = _among(t.core, _INSULT)
        # distinct words among the text's words, for texts long enough to tell
        order = np.argsort(mix(t.core ^ mix(w.doc.astype(np.uint64) + U(1))), kind="stable")
        k = t.core[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
        kinds = np.bincount(w.doc[order][new], minlength=t.docs)
        insult_new = new & insult[order]
        insult_kinds = np.bincount(w.doc[order][insult_new], minlength=t.docs)
        insults = t.words_with(insult)
        # one labeller for each kind of defect, so that they err apart from each other; all but
        # the one for stop words only speak up where they find theirs
        q = [
            _any(
                _vote(t.per_doc(_MARK[data]) / size, lambda v: v < 0.01, lambda v: v > 0.04, some),
                _vote(t.words_with(marked) / n, lambda v: v < 0.03, lambda v: v > 0.15, some),
                _vote(t.words_with(runs) / n, lambda v: v < 0.02, lambda v: v > 0.1, some),
            ),
            _any(
                _vote(t.per_doc(_UPPER[data]) / letters, lambda v: v < 0.12, lambda v: v > 0.3, text),
                _vote(t.per_doc(data == 33) / n, lambda v: v < 0.05, lambda v: v > 0.25, text),
            ),
            _vote(t.words_with(single) / n, lambda v: v < 0.02, lambda v: v > 0.15, some),
            _any(
                _vote(t.words_with(again) / n, lambda v: v < 0.05, lambda v: v > 0.15, text),
                _vote(kinds / np.sqrt(n), lambda v: v > 4.0, lambda v: v < 2.0, t.n >= 40),
            ),
            _vote(t.words_with(stop) / n, lambda v: v > 0.12, lambda v: v < 0.03, text),
            _vote(n / np.maximum(1, t.per_doc(ends)), lambda v: (v > 3) & (v < 40), lambda v: (v < 1.5) | (v > 80), t.n >= 40),
            _vote(size / n, lambda v: (v > 4) & (v < 9), lambda v: (v > 14) | (v < 2.5), text),
            _vote(n / np.maximum(1, t.per_doc(data == 10)), lambda v: v > 8, lambda v: v < 2, t.n >= 40),
        ]
        q = [v if k == QUALITY.index("stopwords") else np.where(v == 2, 2, 0) for k, v in enumerate(q)]
        x = [
            np.where(~some, 0, np.where(insults > 0, 2, 1)),
            np.where(~some, 0, np.where(insults > 1, 2, np.where(insults == 0, 1, 0))),
            _vote(insults / n, lambda v: v < 0.001, lambda v: v > 0.008, some),
            np.where(~some, 0, np.where(insult_kinds > 1, 2, np.where(insult_kinds == 0, 1, 0))),
        ]
        if len(t.parts):
            x = [np.where(v == 2, 2, 0) for v in x]
        x.append(t.learned_vote())
    return sum(v * 3**i for i, v in enumerate(q)), sum(v * 3**i for i, v in enumerate(x))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, labellers: int, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation; the posterior of *bad* for each pattern, vote probabilities, share of bad.

    patterns: numbers of base 3.  ``table[y, i, v]`` is how often labeller i casts
    vote v on documents of class y (0 good, 1 bad); a vote not cast says nothing.  Each
    labeller looks for one defect and a bad document need not have all of them, so it
    starts from the belief that any vote against a document tells.  False alarms
    and the share of bad documents are drawn towards ``ALARMS`` and ``SHARE`` with the weight of
    all documents, other probabilities by one vote.
    """
    digits = np.stack([patterns // 3**i % 3 for i in range(labellers)], axis=1)
    cast, against = (digits > 0).sum(axis=1), (digits == 2).sum(axis=1)
    bad = np.where(against > 0, 0.95, np.where(cast > 0, 0.03, SHARE))
    table, share = np.ones((2, labellers, 3)), SHARE
    total = float(counts.sum())
    for _ in range(rounds):
        weight = np.stack([counts * (1 - bad), counts * bad])
        share = (float(weight[1].sum()) + SHARE * total) / max(1e-9, 2 * total)
        for y in range(2):
            for i in range(labellers):
                n = np.bincount(digits[:, i], weights=weight[y], minlength=3)
                table[y, i] = (n + 1) / (weight[y].sum() + 3)
                if y == 0:
                    table[y, i, 2] = (n[2] + ALARMS * total + 0.01) / (weight[y].sum() + total + 1)
        logs = np.log(table)
        logs[:, :, 0] = 0.0
        odds = np.log(share / (1 - share)) + sum((logs[1] - logs[0])[i, digits[:, i]] for i in range(labellers))
        new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        done = np.abs(new - bad).max(initial=0) < 1e-9
        bad = new
        if done:
            break
    return bad, table, share


def features(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, slot, value): hashed words, word shapes and byte trigrams, each family of length one."""
    w, data = t.words, t.data
    third = SLOTS // 4
    doc, slot, value = [], [], []
    # words: half of the slots
    doc.append(w.doc)
    slot.append((t.core >> U(20)).astype(np.int64) % (2 * third))
    value.append(6.0 / np.sqrt(np.maximum(1, t.n))[w.doc])
    # shapes of neighbouring words: capitals, marks, length, and whether they are equal
    if len(w.start):
        upper = _UPPER[data[w.start]].astype(np.int64) + 2 * _UPPER[data[np.minimum(w.start + 1, len(data) - 1)]]
        mark = _MARK[data[w.start]].astype(np.int64) + 2 * _MARK[data[w.end - 1]] + 4 * (data[w.end - 1] == 33)
        shape = upper + 4 * mark + 32 * np.minimum(7, (w.end - w.start) // 2)
        same = np.zeros(len(shape), np.int64)
        same[1:] = (t.core[1:] == t.core[:-1]) & (w.doc[1:] == w.doc[:-1])
        before = np.r_[0, shape[:-1]]
        doc.append(w.doc)
        slot.append(2 * third + (mix((shape + 512 * before + (same << 20)).astype(np.uint64)) >> U(30)).astype(np.int64) % third)
        value.append(6.0 / np.maximum(1, t.n)[w.doc])
        doc.append(w.doc)
        slot.append(2 * third + (mix((shape + (same << 21) + (1 << 40)).astype(np.uint64)) >> U(30)).astype(np.int64) % third)
        value.append(6.0 / np.maximum(1, t.n)[w.doc])
    # byte trigrams
    if len(data) >= 3:
        d = np.searchsorted(t.off, np.arange(len(data) - 2), side="right") - 1
        inside = np.arange(len(data) - 2) + 3 <= t.off[d + 1]
        x = data[:-2].astype(np.int64) | data[1:-1].astype(np.int64) << 8 | data[2:].astype(np.int64) << 16
        x = ((x * 0x9E3779B1) >> 7 & 0xFFFFFF) % (third - 1) + 3 * third
        doc.append(d[inside])
        slot.append(x[inside])
        value.append(6.0 / np.maximum(1, t.bytes)[d[inside]])
    # the last slot: whether learned beginnings speak against the text
    at = np.flatnonzero(t.learned_vote() == 2)
    doc.append(at)
    slot.append(np.full(len(at), SLOTS - 1))
    value.append(np.full(len(at), 3.0))
    return np.concatenate(doc), np.concatenate(slot), np.concatenate(value)


def fit_scorer(edge: np.ndarray, slot: np.ndarray, value: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, rows: int = ROWS) -> np.ndarray:
    """Weights (slots + 1, heads) of logistic regressions; row k has the entries from edge[k] to edge[k + 1].

    labels: (rows, heads) posteriors.  All heads are fitted in one pass over mini-batches of
    ``rows`` rows, in the order given, so that only a batch is ever blown up.
    """
    n, heads = labels.shape
    weights = np.zeros((SLOTS + 1, heads), np.float32)
    if not n:
        return weights
    positive = np.clip(labels.mean(axis=0), 1e-3, 0.999)
    balance = np.minimum(labels / positive + (1 - labels) / (1 - positive), 20)
    balance /= balance.mean(axis=0)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    steps, step = epochs * -(-n // rows), 0
    for _ in range(epochs):
        for a in range(0, n, rows):
            b = min(n, a + rows)
            lo, hi = int(edge[a]), int(edge[b])
            at, x = slot[lo:hi], value[lo:hi]
            length = np.diff(edge[a : b + 1])
            owner = np.repeat(np.arange(b - a), length)
            z = np.stack([np.bincount(owner, weights=weights[at, h] * x, minlength=b - a) for h in range(heads)], axis=1) + weights[SLOTS]
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[a:b]) * balance[a:b] / (b - a)
            g = np.empty_like(weights)
            for h in range(heads):
                g[:SLOTS, h] = np.bincount(at, weights=error[owner, h] * x, minlength=SLOTS)
            g[SLOTS] = error.sum(axis=0)
            g[:SLOTS] += 1e-6 * weights[:SLOTS]
            step += 1
            m += 0.1 * (g - m)
            v += 0.005 * (g * g - v)
            rate = RATE * (1 - (step - 1) / steps)
            weights -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.995**step)) + 1e-8)
    return weights


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's toxic and other texts have each beginning of a word; part null: all texts."""
    toxic, other = [NONE], [NONE]
    total = [0, 0]
    for batch in pieces(batches):
        t = Texts(*buffers(batch.column("text")))
        flag = batch.column("toxic").to_numpy(zero_copy_only=False) > 0
        total[0] += int(flag.sum())
        total[1] += int((~flag).sum())
        at, h = (np.concatenate(x) for x in zip(*t.beginnings(), strict=True))
        doc = t.words.doc[at]
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        doc, h = doc[new], h[new]
        toxic.append(h[flag[doc]])
        other.append(h[~flag[doc]])
    kinds, at = np.unique(np.concatenate(toxic + other), return_inverse=True)
    n = sum(len(x) for x in toxic)
    counts = [np.bincount(x, minlength=len(kinds)) for x in (at[:n], at[n:])]
    yield pa.record_batch([pa.array([None, *kinds.view(np.int64).tolist()], pa.int64()), *[pa.array(np.r_[total[k], counts[k]].astype(np.int64)) for k in range(2)]], names=["part", "toxic", "other"])


def toxic_parts(docs: DataFrame, labels: DataFrame | None, sample: int = SAMPLE) -> np.ndarray:
    """Hashes of beginnings of words that stand in toxic texts, from at most ``sample`` rows of ``labels``."""
    if labels is None:
        return NONE
    drawn = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    texts = id_text(docs).filter("text IS NOT NULL").join(F.broadcast(drawn), "doc_id").select("text", "toxic").dropDuplicates()
    found = texts.mapInArrow(_holders, "part long, toxic long, other long").groupBy("part").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).filter(f"part IS NULL OR toxic >= {HOLDERS}").toArrow()
    part = found.column("part").combine_chunks()
    toxic, other = (found.column(c).to_numpy().astype(float) for c in ("toxic", "other"))
    whole = np.asarray(part.is_null())
    if not whole.any() or not toxic[whole].sum():
        return NONE
    often = (toxic / toxic[whole].sum()) > TIMES * (other + 1) / max(1.0, other[whole].sum())
    keep = ~whole & often & (toxic >= max(HOLDERS, toxic[whole].sum() / 50))
    return np.sort(part.fill_null(0).to_numpy()[keep].view(np.uint64))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """The table of labels, None if there is none."""
    try:
        return spark.read.parquet(f"{sf_dir}/labels.parquet")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def draws(ids: pa.Array, prints: np.ndarray, before: int) -> np.ndarray:
    """A hash of each row, by which documents are drawn; copies, also within a doc_id, are drawn apart from each other."""
    known = np.asarray(ids.is_valid())
    own = mix(prints ^ mix(ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) + U(1)))
    order = np.argsort(own, kind="stable")
    begin = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1]])
    nth = np.empty(len(own), np.int64)
    nth[order] = np.arange(len(own)) - np.repeat(begin, np.diff(np.r_[begin, len(own)]))
    nth[~known] += before
    with np.errstate(over="ignore"):
        return mix(own + nth.astype(np.uint64) * U(0x9E3779B97F4A7C15))


def _patterns(batches: Iterator[pa.RecordBatch], cut: int, parts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of vote patterns of a task's documents, and features of those drawn for fitting."""
    counts: dict[tuple[int, int], int] = {}
    before = 0
    for batch in pieces(batches):
        data, off = buffers(batch.column(1))
        t = Texts(data, off, parts)
        q, x = votes(t)
        pairs, n = np.unique(np.stack([q, x], axis=1), axis=0, return_counts=True)
        for (a, b), c in zip(pairs.tolist(), n.tolist(), strict=True):
            counts[a, b] = counts.get((a, b), 0) + c
        draw = draws(batch.column(0), text_prints(data, off), before)
        before += batch.num_rows
        drawn = np.flatnonzero((draw >> U(32) < U(cut)) & (t.n > 0))
        del t
        if len(drawn):
            part = Texts(*buffers(batch.column(1).take(pa.array(drawn))), parts)
            doc, slot, value = features(part)
            key, at = np.unique(doc * SLOTS + slot, return_inverse=True)
            total = np.bincount(at, weights=value)
            owner, slot = key // SLOTS, (key % SLOTS).astype(np.int32)
            edge = np.searchsorted(owner, np.arange(len(drawn) + 1))
            blocks = [pack(slot[edge[k] : edge[k + 1]], total[edge[k] : edge[k + 1]].astype(np.float32)) for k in range(len(drawn))]
            yield pa.record_batch([pa.array(draw[drawn].view(np.int64)), pa.array(q[drawn]), pa.array(x[drawn]), pa.nulls(len(drawn), pa.int64()), binary(blocks)], names=PATTERNS)
    if counts:
        keys = np.array(list(counts), np.int64)
        yield pa.record_batch([pa.nulls(len(keys), pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(list(counts.values()), pa.int64()), binary([None] * len(keys))], names=PATTERNS)


PATTERNS = ["draw", "q", "x", "n", "features"]


def _posterior(q: np.ndarray, x: np.ndarray, n: np.ndarray) -> tuple[dict[int, float], dict[int, float]]:
    out = []
    for pattern, labellers in ((q, len(QUALITY)), (x, len(TOXIC))):
        kinds, at = np.unique(pattern, return_inverse=True)
        bad, _, _ = fit_labels(kinds, np.bincount(at, weights=n), labellers)
        out.append(dict(zip(kinds.tolist(), bad.tolist(), strict=True)))
    return out[0], out[1]


def model(docs: DataFrame, fit_documents: int = FIT_DOCUMENTS, parts: np.ndarray = NONE, fit_entries: int = FIT_ENTRIES) -> np.ndarray:
    """Weights of the scorer, trained on all patterns and at most ``fit_documents`` documents of ``fit_entries`` features in all."""
    rows = id_text(docs)
    total = max(1, rows.count())
    cut = min(1 << 32, int((1 << 32) * fit_documents / total))
    found = rows.mapInArrow(lambda it: _patterns(it, cut, parts), "draw long, q long, x long, n long, features binary")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts come first, then documents in order of their draw, which no task's order decides."""
        q, x, n, own_q, own_x, slots, values, size, entries = [], [], [], [], [], [], [], [], 0
        for batch in batches:
            a, b, c = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            for k, f in enumerate(batch.column(4)):
                if not f.is_valid:
                    q.append(a[k])
                    x.append(b[k])
                    n.append(c[k])
                elif len(size) < fit_documents and entries < fit_entries:
                    slot, value = unpack(f.as_buffer(), np.int32, np.float32)
                    if entries + len(slot) > fit_entries:
                        entries = fit_entries
                        continue
                    own_q.append(a[k])
                    own_x.append(b[k])
                    slots.append(slot.copy())
                    values.append(value.copy())
                    size.append(len(slot))
                    entries += len(slot)
        bad, toxic = _posterior(np.array(q, np.int64), np.array(x, np.int64), np.array(n, np.float64))
        labels = np.array([[1 - bad[i], toxic[j]] for i, j in zip(own_q, own_x, strict=True)]).reshape(len(size), 2)
        slot = np.concatenate([np.zeros(0, np.int32), *slots])
        del slots
        value = np.concatenate([np.zeros(0, np.float32), *values])
        del values
        weights = fit_scorer(np.r_[0, np.cumsum(size)].astype(np.int64), slot, value, labels)
        del slot, value
        release()
        yield pa.record_batch([binary([weights.tobytes()])], names=["weights"])

    out = found.repartitionById(1, F.lit(0)).sortWithinPartitions("draw").mapInArrow(train, "weights binary").collect()
    return np.frombuffer(out[0].weights, np.float32).reshape(SLOTS + 1, 2) if out else np.zeros((SLOTS + 1, 2), np.float32)


def score(t: Texts, weights: np.ndarray) -> np.ndarray:
    """Quality and toxicity of each text, between 0 and 1; (0, 0) of a text without words."""
    doc, slot, value = features(t)
    z = np.stack([np.bincount(doc, weights=weights[slot, h] * value, minlength=t.docs) + weights[SLOTS, h] for h in range(2)], axis=1)
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    p[t.n == 0] = 0
    return p


def quality(docs: DataFrame, fit_documents: int = FIT_DOCUMENTS, labels: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, quality, toxicity, keep), a row for each row."""
    parts = toxic_parts(docs, labels, sample)
    sent = docs.sparkSession.sparkContext.broadcast(model(docs, fit_documents, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            p = np.round(score(Texts(*buffers(batch.column(1)), parts), sent.value), 6)
            yield pa.record_batch([batch.column(0), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array((p[:, 0] >= 0.5) & (p[:, 1] < 0.5))], names=["doc_id", "quality", "toxicity", "keep"])

    return id_text(docs).mapInArrow(run, "doc_id long, quality double, toxicity double, keep boolean")


def accepted(docs: DataFrame, fit_documents: int = FIT_DOCUMENTS, labels: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, all columns as they are."""
    parts = toxic_parts(docs, labels, sample)
    sent = docs.sparkSession.sparkContext.broadcast(model(docs, fit_documents, parts))
    where = docs.columns.index("text")
    name = "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, column=name):
            p = score(Texts(*buffers(batch.column(where)), parts), sent.value)
            yield batch.filter(pa.array((p[:, 0] >= 0.5) & (p[:, 1] < 0.5)))

    return docs.mapInArrow(run, docs.schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), labels=labelled(spark, sf_dir))
