import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import spelling_variants as sv

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(docs, spoil=199):
    out = Counter()
    for key, text in docs:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{key}:{run}".encode())
            if key is not None and h % spoil == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return out


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, spoil=199):
    n = {w: c for w, c in counted(docs, spoil).items() if len(w) >= 6 and c >= 5}
    form, out = {}, []
    around = {w: [o for o in n if near(w, o)] for w in n}
    for w, own in around.items():
        best = min(own, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(around[w]), form[w], n.get(form[w]), root))
    return sorted(out)


def corpus(seed, n_docs=60):
    r = random.Random(seed)
    base = ["teatime", "teatimes", "teetime", "tatime", "timeless", "étrange", "Étrange", "etrange", "×÷ÿþðß", "×÷ÿþðñ", "aaaaaa", "aaaaaaa", "bbaaab", "streetlamp", "streetlamps", "strètlamp", "COLOUR", "color", "colours"]
    words = base + ["".join(r.choice("abé") for _ in range(r.randint(5, 8))) for _ in range(80)]
    weight = [1 / (1 + i % 17) ** 2 for i in range(len(words))]
    return [(i, " ".join(r.choices(words, weight, k=r.randint(0, 60))) + r.choice(("", ".", "\n日本", " x1y"))) for i in range(n_docs)]


@pytest.mark.parametrize("most", [sv.MOST_BLOCKS, 1])
def test_equals_brute_force(spark, most):
    """Also where filters of one block each let nearly all edits through."""
    docs = corpus(1) + [(None, "teatime " * 9), (3, None), (4, ""), (5, "!? 12")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for spoil in (199, 7):
        got = sv.variants(d, spoil=spoil, most_blocks=most)
        assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
        assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == brute(docs, spoil)


def test_chains_of_forms(spark):
    docs = [(i, " ".join(["chains"] * 5 + ["chainsa"] * 25 + ["chainsab"] * 125 + ["chainsabc"] * 625 + ["chainsabcd"] * 3125)) for i in (3, 4)]
    got = {r.word: (r.form, r.root) for r in sv.variants(spark.createDataFrame(docs, "doc_id long, text string"), spoil=1 << 31).collect()}
    assert got["chains"] == ("chainsa", "chainsabcd") and got["chainsab"] == ("chainsabc", "chainsabcd") and got["chainsabcd"] == (None, "chainsabcd")


def test_edges(spark):
    schema = "doc_id long, text string, word string, n long, h long, root string"
    empty = spark.createDataFrame([], schema)
    assert sv.variants(empty).count() == 0 == sv.variants(spark.createDataFrame([(1, None, "a", 1, 1, "b"), (2, "short words", "a", 1, 1, "b")], schema)).count()
    long = "ab" * 30_000
    docs = [(i, f"{long} {long}x {long[:-1]}y") for i in range(5)] + [(9, "repeat " * 3), (9, "repeat " * 3)]
    got = {r.word: r for r in sv.variants(spark.createDataFrame([(*d, "w", 1, 2, "r") for d in docs], schema), spoil=1 << 31).collect()}
    assert got[long].n_near == 2 and got[long + "x"].n_near == 1 and got["repeat"].n == 6 and len(got) == 4


def test_checksums_and_equal_hashes(spark, monkeypatch):
    r = np.random.default_rng(0)
    data = np.frombuffer(("abcdefé" * 40).encode(), np.uint8)
    starts = r.integers(0, 100, 50)
    ends = starts + r.integers(1, 200, 50)
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in range(50)], np.uint32)
    assert sv.checksums(data, starts, ends, before).tolist() == [zlib.crc32(f"{i}:".encode() + data[a:b].tobytes()) for i, (a, b) in enumerate(zip(starts, ends))]
    assert zlib.crc32(b"12:word") == int(sv.checksums(np.frombuffer(b"word", np.uint8), np.array([0]), np.array([4]), np.array([zlib.crc32(b"12:")], np.uint32))[0])


def test_edits_have_their_words_keys():
    """Keys of edits that are never spelled out equal the keys of the words they are."""
    words = ["aabcdd", "zzzzzzz", "éabcdé", "ÿþabcé"]
    full = np.full(1, ~np.uint64(0))
    shards = {n: (0, 1) for n in range(65)}
    alphabet = np.array(sorted({ord(c) for w in words for c in w}))
    for w in words:
        codes = np.array([[ord(c) for c in w]], np.uint8)
        got = {int(k) for keys, _ in sv.positives(codes, len(w), full, shards, alphabet) for k in keys}
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + chr(c) + w[i + 1 :] for i in range(len(w)) for c in alphabet if c > ord(w[i])}
        assert got == set(sv.word_keys(pa.array(sorted(edits)))[0].tolist()) and len(got) == len(edits)


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = sorted(map(tuple, sv.query(spark, sf).collect()), key=str)
    assert got == sorted(duck.sql(sv.ORACLE).fetchall(), key=str) and got
