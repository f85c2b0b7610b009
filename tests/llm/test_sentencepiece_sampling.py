import itertools
import math
from collections import Counter

import numpy as np

from tidemark.llm import lattice
from tidemark.llm import sentencepiece_sampling as sps

TEXTS = ["", "Hello  world, ça va?\n\tñ ▁ literal", "x" * 500, "日本語のテキスト " * 30, " lead and trail  ", "▁", "\U0001f600 ok \x00", "the the the", "a" * 40 + " " + "b" * 41]


def test_lossless_reproducible_and_shapes(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None), (None, "no key"), (1, TEXTS[1]), (5, "word " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' AS n_pieces", "true AS extra")
    got = sps.encode(docs).collect()
    p = lattice.load(sps.MODEL)
    for r, (k, t) in zip(got, rows, strict=True):
        if t is None:
            assert r.piece_ids is None and r.lossless is None and r.n_pieces == 0
        else:
            assert r.lossless and r.n_pieces == len(r.piece_ids) and sps.decode(p, r.piece_ids).decode() == t
    assert got[1].piece_ids == got[len(TEXTS) + 2].piece_ids
    again = sps.encode(docs.repartition(3)).where("doc_id = 3").collect()
    assert again[0].piece_ids == got[3].piece_ids
    assert sps.encode(docs.limit(0)).count() == 0


def test_draws_follow_the_lattice():
    p = lattice.load(sps.MODEL)
    word = "than"
    known = {p.bytes[i].decode("utf-8", "replace"): i for i in range(p.size) if p.bytes[i] and i not in set(p.byte_id.tolist())}
    text, want = " " + word, {}
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        parts, part = [], text[0]
        for c, ch in zip(cuts, text[1:], strict=True):
            parts, part = ([*parts, part], ch) if c else (parts, part + ch)
        parts.append(part)
        if all(x in known for x in parts):
            want[tuple(known[x] for x in parts)] = math.prod(p.prior[known[x]] for x in parts)
    total, n = sum(want.values()), 40000
    raw = np.frombuffer(word.encode() * n, np.uint8)
    ids, to = sps.sample(p, raw, np.arange(n + 1) * len(word), lattice.mix(np.arange(n).astype(np.uint64)))
    got = Counter(tuple(ids[to[i] : to[i + 1]].tolist()) for i in range(n))
    assert set(got) <= set(want)
    for k, w in want.items():
        assert abs(got[k] / n - w / total) < 5 * math.sqrt(w / total / n) + 1e-4
