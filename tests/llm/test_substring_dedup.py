import hashlib
import random
import re

import pytest

from tidemark.llm import substring_dedup as sd
from tidemark.llm.common import table


def brute(rows):
    """First starts of all windows, in order of (null first, id)."""
    words = {}
    for k, t in rows:
        words[(k is not None, k or 0)] = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    first, out = {}, {}
    for key in sorted(words):
        for p in range(len(words[key]) - 19):
            first.setdefault(tuple(words[key][p : p + 20]), (key, p))
    for key, w in words.items():
        gone = set()
        for p in range(len(w) - 19):
            if first[tuple(w[p : p + 20])] != (key, p):
                gone.update(range(p, p + 20))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[key] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def check(spark, rows):
    got = sd.dedup(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "'r' AS rank", "2 AS pos").repartition(3)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[(r.doc_id is not None, r.doc_id or 0)]


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    vocab = ["a", "bé", "c,", "the", "of", "x1"]
    shared = [" ".join(rng.choices(vocab, k=rng.randint(15, 60))) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [rng.choice(shared) if rng.random() < 0.5 else " ".join(rng.choices(vocab, k=rng.randint(0, 40))) for _ in range(rng.randint(0, 5))]
        rows.append((i * 3, rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(1000, None), (1001, ""), (1002, "a " * 500), (None, shared[0] + " z"), (1003, rows[4][1]), (1003, rows[4][1]), (1004, " ".join(["w"] * 30))]
    check(spark, rows)
    monkeypatch.setattr(sd, "GROUP", 3)  # most groups are split to whole runs, and many to windows
    check(spark, rows)
    check(spark, rows[:0] + [(1, None)])


def test_subtree_gives_maximal_repeats():
    """Against all pairs of suffixes: which windows also start earlier, and that no returned repeat can be longer."""
    rng = random.Random(8)
    for trial in range(20):
        shared = [rng.choices("abc", k=rng.randint(20, 40)) for _ in range(3)]
        texts = [[*rng.choices("abcd", k=rng.randint(0, 4)), *rng.choice(shared), *rng.choices("xyz", k=rng.randint(0, 6))] for _ in range(14)]
        runs = [((rng.random(),), len(t) - 19, " ".join(t).encode()) for t in texts]
        leaves = [(runs[i][0], w, i) for i, t in enumerate(texts) for w in range(len(t) - 19)]
        longest = {}
        for o, w, i in leaves:
            for q, v, j in leaves:
                if (q, v) < (o, w):
                    n = 0
                    while w + n < len(texts[i]) and v + n < len(texts[j]) and texts[i][w + n] == texts[j][v + n]:
                        n += 1
                    longest[i, w] = max(longest.get((i, w), 0), n)
        got = sd.subtree(runs)
        windows = {(i, w + k) for i, w, n in got for k in range(n)}
        assert windows == {k for k, n in longest.items() if n >= 20} and (windows or trial)
        assert all(longest[i, w] == n + 19 for i, w, n in got)


@pytest.mark.parametrize("group", [sd.GROUP, 3])
def test_repeated_rows_keep_the_earliest_text(spark, monkeypatch, group):
    monkeypatch.setattr(sd, "GROUP", group)
    one, two, three = (" ".join(f"{p}{i}" for i in range(45)) for p in "abc")
    rows = [(7, one)] * 5 + [(None, two)] * 3 + [(8, "x " + one + " y")] * 2 + [(9, two)] + [(11, None)] * 2 + [(10, three)]
    check(spark, rows)
    kept = {(r.doc_id, r.n_words): r.n_removed for r in sd.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {(7, 45): 0, (None, 45): 0, (8, 47): 45, (9, 45): 45, (11, 0): 0, (10, 45): 0}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_tables(spark, sf):
    docs = table(spark, f"/root/testdata/{sf}", "documents")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = sd.query(spark, f"/root/testdata/{sf}").collect()
    assert len(got) == len(want) and sum(r.n_removed for r in got) > 1000
    assert all((r.n_words, r.n_removed, r.kept_sha256) == want[(True, r.doc_id)] for r in got)


def test_sql():
    import duckdb

    c = duckdb.connect()
    c.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = brute(c.sql("SELECT doc_id, text FROM documents").fetchall())
    assert {(True, r[0]): r[1:] for r in c.sql(sd.ORACLE).fetchall()} == want
