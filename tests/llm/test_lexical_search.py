import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    """(item, rank, key, score) by the definition, item by item and document by document."""
    counts = [(key, Counter(terms(t))) for key, t in docs]
    counts = [(key, c) for key, c in counts if c]
    n, size = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for key, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n) // size
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                found.append((-s, key is None, key, s))
        out += [(item, i + 1, key, s) for i, (_, _, key, s) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def texts(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Ünder", "été", "ÉTÉ", "Mixed9Case", "日本"]
    return [" ".join(r.choice(words[: r.choice((5, 20, len(words)))]) + r.choice(("", ",", "-x")) for _ in range(r.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"DOC_TILE": 7, "ITEM_TILE": 3, "TERM_TILE": 4}])
def test_equals_brute_force(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(ls, name, value)
    docs = list(enumerate(texts(120, 1)))
    docs += [(200 + i, docs[3][1]) for i in range(15)] + [(None, docs[3][1]), (3, docs[3][1]), (300, None), (301, ""), (302, "?! --")]
    items = [(i, t) for i, t in enumerate(texts(12, 2))] + [(90, docs[3][1]), (91, None), (92, ""), (93, "nowhere at all"), (94, docs[3][1])]
    random.Random(3).shuffle(docs)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string")
    for block in (10**6, 25):
        got = sorted(map(tuple, ls.search(d, i, k=10, block_pairs=block).collect()))
        assert got == sorted(brute(docs, items, 10)), block


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x"), (2, None, 6, "y")], "doc_id long, text string, score long, item_id string")
    items = spark.createDataFrame([(7, "B c", "z")], "item_id long, text string, doc_id string")
    assert [tuple(r) for r in ls.search(docs, items).collect()] == brute([(1, "a b"), (2, None)], [(7, "B c")], 10)
    for a, b in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("text IS NULL"), items)):
        got = ls.search(a, b)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0
    text = "word" * 200_000 + " b" * 300_000
    got = ls.search(spark.createDataFrame([(1, text), (2, "b")], "doc_id long, text string"), items).collect()
    assert [tuple(r) for r in got] == brute([(1, text), (2, "b")], [(7, "B c")], 10)


def test_products_are_exact_at_any_weight():
    """Sums over many terms of the largest weights equal sums of Python integers."""
    r = np.random.default_rng(0)
    size, weight = 5000, np.full(5000, 40_000_000, np.int64)
    tf = r.integers(1, 1000, size).astype(np.int32)
    lists = [pa.array([x], pa.list_(pa.int32())) for x in (np.arange(size, dtype=np.int32), tf)]
    batch = pa.RecordBatch.from_arrays([pa.array([4], pa.int64()), pa.array([9], pa.int64()), *lists], ["key", "n", "ids", "tfs"])
    item, score, key = ls.rank_tiles([batch], weight, [np.arange(size)], (1, 9), 3)
    want = sum(40_000_000 * ((1_000_000_000 * int(t)) // (1000 * int(t) + 8 * 100)) for t in tf)
    assert want > 2**53 and (item.tolist(), score.tolist(), key.tolist()) == ([0], [want], [4])


def test_terms_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(ls, "word_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    known = ls.Vocabulary([b"aa", b"b", b"bb", b"c"])
    data = np.frombuffer(b"bb c aa dd", np.uint8)
    starts, ends, _ = ls.terms_of(data, np.array([0, len(data)]))
    at, ids = known.find(data, starts, ends)
    assert sorted(zip(at.tolist(), ids.tolist())) == [(0, 2), (1, 3), (2, 0)]


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = ls.query(spark, sf)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(duck.sql(ls.ORACLE).fetchall())
