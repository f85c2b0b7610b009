import numpy as np
import pytest

from tidemark.llm import quality_knn as qk
from tidemark.llm.common import table

SF = "/root/testdata/sf0.1"


def brute_votes(p, known, label, weight, base, k):
    """One point at a time, with Python's integers."""
    out = []
    for x in p.astype(int).tolist():
        cos = [sum(a * b for a, b in zip(x, y)) for y in known.astype(int).tolist()]
        least = sorted(cos)[-k] if len(cos) > k else min(cos)
        near = [(c / qk.ONE**2 * w, y) for c, w, y in zip(cos, weight, label) if c >= least and c > 0]
        total = sum(w for w, _ in near)
        out.append(sum(w for w, y in near if y) / total if total > 0 else base)
    return out


def test_votes_equal_brute_force():
    r = np.random.default_rng(1)
    known = qk.points(r.standard_normal((60, 9)), np.eye(9))
    known[40:50] = known[3]  # ties, some beyond the k-th
    p = np.concatenate([known[[3, 7]], qk.points(r.standard_normal((20, 9)), np.eye(9)), np.zeros((1, 9))])
    label, weight = (r.random(60) < 0.6).astype(float), np.where(r.random(60) < 0.5, 1.0, 0.25)
    for k in (1, 5, 60, 100):
        want = brute_votes(p, known, label, weight, 0.4, k)
        assert np.allclose(qk.votes(p, known, label, weight, 0.4, k), want, atol=1e-12)
        parts = np.concatenate([qk.votes(p[i : i + 1], known, label, weight, 0.4, k) for i in range(len(p))])
        assert np.allclose(parts, want, atol=1e-12)


def test_terms_equal_a_plain_count():
    texts = ["Ab ab! ab! ÉÉ 12-3 |", "", "x", "a  a\na \t"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    row, bucket, tf = qk.terms(data, off)
    for i, t in enumerate(texts):
        words = [w.lower() if w.isascii() else w for w in t.split()]
        own = tf[row == i]
        repeats = sum(a == b for a, b in zip(words, words[1:]))
        assert own.sum() == 2 * len(words) + repeats and (bucket[row == i] == qk._REPEAT).sum() == (repeats > 0)
        assert (own[bucket[row == i] < qk.WORDS]).sum() == len(words)


def test_axes_are_singular_vectors():
    r = np.random.default_rng(2)
    a = r.standard_normal((40, 6)) @ np.diag([9, 5, 3, 0.1, 0.05, 0.01]) @ r.standard_normal((6, 30))
    v = qk.leading_axes(a, 3)
    want = np.linalg.svd(a)[2][:3].T
    assert np.allclose(np.abs(v.T @ want), np.eye(3), atol=1e-6)


@pytest.fixture(scope="module")
def scored(spark):
    truth = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    return [r for r in qk.query(spark, SF).collect()], truth


def test_held_out(scored):
    rows, truth = scored
    own = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good = [p for p, y in own if y == 1]
    bad = [p for p, y in own if y == 0]
    print(len(good), len(bad), np.mean(good), np.mean(bad))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.35 and all(0 <= r.score <= 1 for r in rows)


def test_repeated_texts_get_equal_scores(spark, scored):
    rows, _ = scored
    score = {r.doc_id: r.score for r in rows}
    each = {}
    for r in table(spark, SF, "documents").select("doc_id", "text").collect():
        each.setdefault(r.text, set()).add(score[r.doc_id])
    assert all(len(s) == 1 for s in each.values())


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5.0, 1), (2, "", 5.0, 1), (None, "word " * 300_000, 5.0, 1), (2, "", 5.0, 1), (3, "UP!! UP!!", 5.0, 1)], "doc_id long, text string, score double, quality int")
    for labelled in ("1=0", "quality = 1"):
        model = qk.learn(docs, docs.where(labelled).select("doc_id", "quality"))
        got = qk.score(docs, model)
        assert got.columns == ["doc_id", "text", "quality", "score"]
        rows = got.collect()
        assert len(rows) == 5 and {r.score for r in rows} == ({0.5} if labelled == "1=0" else {1.0})
        assert qk.score(docs.limit(0), model).count() == 0
    model = qk.learn(docs.limit(0), docs.selectExpr("doc_id", "CAST(NULL AS INT) AS quality"))
    assert {r.score for r in qk.score(docs, model).collect()} == {0.5}
