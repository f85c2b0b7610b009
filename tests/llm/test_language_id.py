import itertools
import math
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import language_id as li
from tidemark.llm import lattice
from tidemark.llm.common import table

SF = "/root/testdata/sf0.01"


def test_forward_equals_all_segmentations():
    p = lattice.load(li.MODEL)
    rng = np.random.default_rng(1)
    prob = rng.dirichlet(np.ones(p.size), size=2)
    ids = {p.bytes[i].decode("utf-8", "replace").replace(" ", "▁"): i for i in range(p.size) if p.bytes[i] and i not in set(p.byte_id.tolist())}
    text = "Ça THE"
    want = np.zeros(2)
    for word in ("▁ça", "▁the"):
        total = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts, part = [], word[0]
            for c, ch in zip(cuts, word[1:], strict=True):
                parts, part = ([*parts, part], ch) if c else (parts, part + ch)
            parts.append(part)
            if all(x in ids for x in parts):
                total += [math.prod(prob[k, ids[x]] for x in parts) for k in range(2)]
        want += np.log(total)
    raw = text.encode()
    got, ok = li.log_likelihoods(p, prob, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert ok.all() and np.allclose(got[0], want)


def pieces_by_text(p):
    spelled = set(p.byte_id.tolist())
    return {p.bytes[i].decode().replace(" ", "▁"): i for i in range(p.size) if p.bytes[i] and i not in spelled}


def brute_sums(p, ids, word, prob):
    """(sum over all segmentations, expected pieces), exactly, by fractions over prefixes and suffixes; each character is a piece or bytes."""

    def ways(a, b):
        if word[a:b] in ids:
            return Fraction(prob[ids[word[a:b]]])
        return math.prod(Fraction(prob[i]) for i in p.byte_id[list(word[a].encode())]) if b == a + 1 else Fraction(0)

    n = len(word)
    left, right = [Fraction(1)] + [Fraction(0)] * n, [Fraction(0)] * n + [Fraction(1)]
    for b in range(1, n + 1):
        left[b] = sum(left[a] * ways(a, b) for a in range(max(0, b - p.longest), b))
    for a in range(n - 1, -1, -1):
        right[a] = sum(ways(a, b) * right[b] for b in range(a + 1, min(n, a + p.longest) + 1))
    counts = {}
    for a in range(n):
        for b in range(a + 1, min(n, a + p.longest) + 1):
            if word[a:b] in ids:
                counts[ids[word[a:b]]] = counts.get(ids[word[a:b]], 0) + float(left[a] * ways(a, b) * right[b] / left[n])
    return left[n], counts


def log_of(x):
    return math.log(x.numerator) - math.log(x.denominator)


@pytest.mark.parametrize("word", ["the", "donaudampfschifffahrtsgesellschaftskapitaenswitwenundwaisen", "ꦏꦕꦠꦤ" * 12, "straße" * 30])
def test_words_of_any_length_are_summed_whole(word):
    p = lattice.load(li.MODEL)
    ids = pieces_by_text(p)
    prob = np.stack([p.prior, np.random.default_rng(2).dirichlet(np.full(p.size, 0.5)).clip(1e-12)])
    raw = word.encode()
    data, off = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    got, _ = li.log_likelihoods(p, prob, data, off)
    want = [brute_sums(p, ids, "▁" + word, x) for x in prob]
    assert np.allclose(got[0], [log_of(x) for x, _ in want], rtol=1e-9)
    counts = li.expected_counts(p, data, off, np.array([0]), 1)[0]
    expected = np.zeros(p.size)
    for i, x in want[0][1].items():
        expected[i] = x
    assert np.allclose(counts, expected, atol=1e-9)


def test_held_out_accuracy_and_edges(spark):
    rows = li.query(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in table(spark, SF, "documents").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and len(held) > 100
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "12 — !", 7), (4, "the and " * 9000, 7), (None, "der und", 7), (4, "the and " * 9000, 7), (5, "w" * 3000, 7)], "doc_id long, text string, score int")
    names, shares, prob = li.train(spark.createDataFrame([("the and of", "en"), ("der und die", "de"), ("x", None)], "text string, lang string"))
    got = li.predict(docs, names, shares, prob).collect()
    assert [r.lang_pred for r in got[:6]] == ["und", "und", "und", "en", "de", "en"]
    assert li.predict(docs.limit(0), names, shares, prob).count() == 0
    none = li.train(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in li.predict(docs, *none).collect()} == {"und"}
