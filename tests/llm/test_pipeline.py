import random
import re
from collections import Counter

import corpus_pipeline as cp
from tidemark.llm import pii, toxicity
from tidemark.llm import sentencepiece_sampling as sps
from tidemark.llm.common import table

SF = "/root/testdata/sf0.001"


def grams(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_stages_against_brute_force(spark, tmp_path):
    docs = table(spark, SF, "documents")
    seen = [docs]
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, seen[-1], SF).write.parquet(f"{tmp_path}/{i}")
        seen.append(spark.read.parquet(f"{tmp_path}/{i}"))
    rows = [{r.doc_id: r for r in d.collect()} for d in seen]
    assert all(d.columns == docs.columns for d in seen[:-1])
    model = toxicity.train_on(docs, table(spark, SF, "labels"))
    assert set(rows[1]) == {r.doc_id for r in toxicity.score(docs, model).collect() if r.score < 0.7}
    # one of each group, the least
    own = {k: grams(r.text) for k, r in rows[1].items()}
    group = {k: k for k in own}
    for a in sorted(own):
        for b in sorted(own):
            if a < b and own[a] and own[b] and 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b]):
                x, y = group[a], group[b]
                group = {k: min(x, y) if v in (x, y) else v for k, v in group.items()}
    assert set(rows[2]) == {k for k, v in group.items() if k == v}
    norm = lambda t: " ".join(w for w in re.split(r"[\W_]+", t.lower()) if w)
    items = [norm(r.text) for r in table(spark, SF, "benchmark").collect()]
    clean = {k for k, r in rows[2].items() if not any(f" {i} " in f" {norm(r.text)} " for i in items)}
    assert set(rows[3]) == clean and len(clean) < len(rows[2])
    assert set(rows[4]) == set(rows[3]) == set(rows[5])
    assert not any(pii.base_spans(r.text) for r in rows[4].values())
    untouched = [k for k, r in rows[3].items() if not re.search("[0-9@]", r.text)]
    assert untouched and all(rows[4][k].text == rows[3][k].text for k in untouched)
    assert all(r.lossless and r.n_chars == len(r.text) for r in rows[5].values())
    assert sps.MODEL and len(rows[5]) > 50


def test_near_duplicates_are_decided_per_row(spark):
    rng = random.Random(3)
    a, b, c, d, e = (" ".join(f"w{rng.randint(0, 99999)}" for _ in range(60)) for _ in range(5))
    near = a + " end"
    rows = [(1, a), (1, a), (1, a), (5, near)]  # repeated rows, and a near copy
    rows += [(2, b), (None, b), (None, b + " end")]  # copies without an id
    rows += [(5, c)]  # the clean text of an id whose other text is a copy
    rows += [(None, d), (None, d), (None, d + " end")]  # a group without ids
    rows += [(7, e), (7, e + " end"), (8, e)]  # two near texts of one id
    rows += [(9, None), (9, None), (None, ""), (10, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "length(text) AS n_chars").repartition(3)
    got = cp.drop_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    least = dict(spark.createDataFrame([(t,) for _, t in rows if t], "text string").selectExpr("text", "xxhash64(text)").collect())
    want = Counter([(1, a), (2, b), (5, c), (9, None), (9, None), (None, ""), (10, " ")])
    want[None, min((d, d + " end"), key=least.get)] = 1
    want[7, min((e, e + " end"), key=least.get)] = 1
    assert kept == want


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty texts, repeated rows, names that the operators use themselves, and empty tables."""
    long = " ".join(f"x{i}" for i in range(30000))
    rows = [(None, None, None, None, None), (1, None, "en", None, None), (2, "", None, "s", 0), (2, "", None, "s", 0), (3, "Some words here", "en", "s", 15), (3, "Some words here", "en", "s", 15), (None, "Some words here", None, None, 15), (4, long, "en", "s", len(long)), (5, "ask a.b@c.de", None, "s", 12)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'k' AS score", "1 AS _row", "2 AS sig", "'i' AS id", "'p' AS spans", "3 AS row", "'q' AS n_email", "4 AS t1")
    stages = dict(cp.STAGES)
    key = lambda r: (str(r.doc_id), str(r.text))
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, odd, SF)
        assert set(got.columns) <= set(odd.columns) and {"doc_id", "text", "lang", "source", "n_chars"} <= set(got.columns), name
        assert stage(spark, odd.limit(0), SF).count() == 0
        kept = Counter(map(key, got.collect()))
        if name == "n-gram Jaccard join":
            assert kept == Counter({("None", "None"): 1, ("1", "None"): 1, ("2", ""): 2, ("3", "Some words here"): 1, ("4", long): 1, ("5", "ask a.b@c.de"): 1})
        elif name == "PII":
            assert sum(kept.values()) == len(rows) and kept[("5", "ask [email]")] == 1 and kept[("4", long)] == 1
        else:
            assert kept == Counter(map(key, odd.collect())), name
    last = stages["SentencePiece encoding and decoding"]
    assert last(spark, odd, SF).count() == len(rows) and last(spark, odd.limit(0), SF).count() == 0
