import hashlib
import itertools
import re
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import pii
from tidemark.llm.common import table

SF = "/root/testdata/sf0.01"


def test_gradients_are_those_of_the_likelihood():
    net = pii.Network(3)
    r = np.random.default_rng(1)
    x = r.integers(40, 70, (9, 4))
    y = np.stack([pii.tags_of(9, [("phone", 2, 5)])] * 4, axis=1)
    _, g = net.gradients(x, y)
    for k in net.p:
        at = tuple(r.integers(0, n) for n in net.p[k].shape) if k not in ("E", "T") else ((50, 3) if k == "E" else (0, 7))
        if k == "E":
            at = (int(x[4, 1]), 3)
        before = net.p[k][at]
        up, down = (net.p[k].__setitem__(at, before + d) or net.gradients(x, y)[0] for d in (1e-3, -1e-3))
        net.p[k][at] = before
        assert abs((up - down) / 2e-3 - g[k][at]) < 2e-3 + 0.02 * abs(g[k][at]), k


def test_base_spans_and_network(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    net = pii.train(docs)
    rows = pii.find(docs, net).collect()
    assert len(rows) == docs.count() and sum(r.n_email for r in rows) > 5
    for r in rows:
        want = []
        for k in pii.KINDS:
            want += [(k, *m.span()) for m in re.finditer(pii.PATTERNS[k].pattern, r.text) if pii.passes(k, m[0])]
        assert r.base_sha256 == hashlib.sha256(pii.written(want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(",")) | {""}


def test_network_on_held_out_rows(spark):
    """Trained on two thirds of the rows: on the others, by itself it finds the patterns' spans, and of spoilt ones those that no pattern finds."""
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text").withColumn("out", F.expr("pmod(xxhash64(text), 3) = 0"))
    net = pii.train(docs.where("NOT out"))
    plain, found, spoilt, added, right = 0, 0, 0, 0, 0
    for r in docs.where("out AND text RLIKE '[0-9@]'").orderBy("doc_id").collect():
        base = pii.base_spans(r.text)
        own = pii.added_spans(net, [r.text], [[]])[0]
        plain += len(base)
        found += sum(any(k == q and a < v and u < b for q, u, v in own) for k, a, b in base)
        bad = pii.spoil(r.text, base, np.random.default_rng(r.doc_id))
        left = pii.base_spans(bad)
        lost = [s for s in base if bad[s[1] : s[2]] != r.text[s[1] : s[2]] and all(s[2] <= u or s[1] >= v for _, u, v in left)]
        more = pii.added_spans(net, [bad], [left])[0]
        spoilt += len(lost)
        right += sum(any(a < v and u < b for _, u, v in more) for _, a, b in lost)
        added += sum(all(v <= a or u >= b for _, a, b in lost) for _, u, v in more)
    print(f"plain {found} of {plain}, spoilt {right} of {spoilt}, spans elsewhere {added}")
    assert plain > 100 and found >= 0.8 * plain
    assert spoilt > 30 and right >= 0.6 * spoilt and added <= 0.25 * (right + added)


def test_long_texts_in_parts(spark):
    """A text's spans don't depend on how many windows are read at once, and memory beside the text stays small."""
    net = pii.train(table(spark, SF, "documents").select("text"))
    r = np.random.default_rng(2)
    piece = [f"call +{r.integers(10, 99)}/{r.integers(100, 999)}/{r.integers(10**6, 10**7)} or a.b{i}@mail,org at 4111/1111/{r.integers(1000, 9999)}/1111 now" for i in range(60)]
    texts = [" ".join(piece), "", piece[0], "x" * 500 + piece[1], " ".join(piece[5:9])]
    base = [pii.base_spans(t) for t in texts]
    want = pii.added_spans(net, texts, base)
    assert sum(map(len, want)) > 0
    for most in (1, 3, 7, 64):
        assert pii.added_spans(net, texts, base, most) == want
    text = " ".join(piece * 250)
    tracemalloc.start()
    pii.added_spans(net, [text], [[]])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000 + 40 * len(text)


def test_decoding_against_all_tag_sequences():
    """Viterbi's tags and the marginals, held against every sequence of four tags."""
    r = np.random.default_rng(4)
    net = pii.Network(1)
    for k in net.p:
        net.p[k] = net.p[k] + r.normal(0, 0.8, net.p[k].shape)
    x = r.integers(40, 70, (4, 3))
    tags, prob = net.decode(x)
    score, tr = net.scores(x).astype(float), net.transitions().astype(float)
    for row in range(3):
        all_of = {}
        for seq in itertools.product(range(pii.TAGS), repeat=4):
            all_of[seq] = sum(score[i, row, c] for i, c in enumerate(seq)) + sum(tr[a, b] for a, b in itertools.pairwise(seq))
        best = max(all_of, key=all_of.get)
        assert all_of[tuple(tags[:, row].tolist())] >= all_of[best] - 1e-4
        weight = {k: np.exp(v - all_of[best]) for k, v in all_of.items()}
        total = sum(weight.values())
        if (tags[:, row] > 0).any():
            want = [sum(w for k, w in weight.items() if k[i] == tags[i, row]) / total for i in range(4)]
            assert np.allclose(prob[:, row], want, atol=1e-4)


def test_reconcile_against_a_plain_rule():
    """Each character has the tag of the window in which it lies farthest from an edge (the first window's first half is its own)."""
    r = np.random.default_rng(9)
    for n in (5, 64, 100, 333):
        starts = pii.window_starts(n)
        tags, prob = r.choice([0, 0, 1, 2, 2, 3, 4], (pii.WINDOW, len(starts))), r.random((pii.WINDOW, len(starts)))
        tag, p = [], []
        for c in range(n):
            inside = [(min(c - a, a + pii.WINDOW - 1 - c) + pii.WINDOW * (a == 0 and c < pii.STRIDE), -j) for j, a in enumerate(starts) if a <= c < a + pii.WINDOW]
            j = -max(inside)[1]
            tag.append(int(tags[c - starts[j], j]))
            p.append(prob[c - starts[j], j])
        want, c = [], 0
        while c < n:
            if tag[c] == 0:
                c += 1
                continue
            end = c + 1
            while end < n and tag[end] and (tag[end] + 1) // 2 == (tag[c] + 1) // 2 and tag[end] % 2 == 0:
                end += 1
            want.append((pii.KINDS[(tag[c] + 1) // 2 - 1], c, end, float(np.mean(p[c:end]))))
            c = end
        got = pii.reconcile(n, starts, tags, prob)
        assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])


def test_addresses_with_digit_runs_of_any_length(spark):
    texts = ["9" * 100_000 + ".1.1.1", "0" * 5000 + "12.1.1.1 and 1.2.3." + "8" * 5000, "0.0.0." + "0" * 9000]
    got = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), None).orderBy("doc_id").collect()
    assert [r.n_ip for r in got] == [0, 1, 1]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "mail a.b@c.de, ip 1.2.3.4 +49 (30) 1234567, 4111 1111 1111 1111"), (3, "9" * 70000), (3, "9" * 70000), (4, "ü 300.1.1.1 é@x")], "doc_id long, text string").selectExpr("*", "'s' AS spans")
    got = pii.find(docs, None, masked="text").collect()
    assert [r.spans for r in got] == ["", "", "email:5:13,ip:18:25,card:44:63,phone:26:42", "", "", ""]
    assert got[0].text is None and got[2].text == "mail [email], ip [ip] [phone], [card]" and got[2].n_card == 1
    assert pii.find(docs.limit(0), None).count() == 0 and pii.train(docs.limit(2)) is None
