import random
import re
from collections import Counter

from tidemark.llm import decontamination as dc
from tidemark.llm.common import table


def norm(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def brute(docs, items):
    """All windows of an item's size; the best similarity of each document and item."""
    best = {}
    for i, t in items:
        w = norm(t)
        a = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        if not a:
            continue
        for d, text in docs:
            v = norm(text)
            hit = [k for k in range(len(v) - 4) if tuple(v[k : k + 5]) in a]
            for at in sorted({max(0, k - x) for k in hit for x in range(len(w))}):
                part = v[at : at + len(w)]
                b = Counter(tuple(part[k : k + 5]) for k in range(len(part) - 4))
                shared = sum((a & b).values())
                if shared and shared / (a.total() + b.total() - shared) >= 0.8:
                    best[(d, i)] = max(best.get((d, i), 0), shared / (a.total() + b.total() - shared))
    return best


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(12, 70)))) for i in range(30)] + [(90, None), (91, "too short"), (92, ""), (5, "dup dup dup dup dup dup dup"), (None, " ".join(rng.choices(vocab, k=40)))]
    docs = []
    for d in range(120):
        w = rng.choices(vocab, k=rng.randint(0, 150))
        for _ in range(rng.randint(0, 2)):
            own = norm(rng.choice(items)[1])
            if own and rng.random() < 0.5:
                own[rng.choice([0, -1, len(own) // 2])] = "edit"
            w += [x.upper() + rng.choice(["", ",", "!!"]) for x in own] + rng.choices(vocab, k=5)
        docs.append((d, rng.choice([" ", "\n"]).join(w)))
    docs += [(500, None), (501, ""), (None, items[3][1]), (502, items[4][1]), (502, items[4][1]), (503, "x " * 40000 + items[5][1]), (504, "dup " * 90)]
    got = dc.contamination(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "'q' AS row"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} <= set(want)
    lost = [(k, v) for k, v in want.items() if k not in {(r.doc_id, r.item_id) for r in got}]
    assert len(want) > 40 and len(want) - len(lost) >= 0.97 * len(want), lost
    assert all(abs(r.similarity - want[(r.doc_id, r.item_id)]) < 1e-9 for r in got)
    equal = {k for k, v in want.items() if v == 1}
    assert equal <= {(r.doc_id, r.item_id) for r in got}


def test_tables_and_edges(spark):
    rows = dc.query(spark, "/root/testdata/sf0.01").collect()
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    items = table(spark, "/root/testdata/sf0.01", "benchmark")
    flat = {r.doc_id: " ".join(norm(r.text)) for r in docs.collect()}
    want = {(d, r.item_id) for r in items.collect() for d, t in flat.items() if f" {' '.join(norm(r.text))} " in f" {t} "}
    assert want <= {(r.doc_id, r.item_id) for r in rows} and len(want) > 3
    left = dc.drop_contaminated(docs, items)
    assert left.columns == docs.columns and left.count() == len(flat) - len({r.doc_id for r in rows})
    assert dc.contamination(docs.limit(0), items).count() == 0 and dc.contamination(docs, items.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = dc.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_index_covers_the_radius(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p")], "item_id long, text string")
    own = dc.items_table(items, "item_id", "text").first()
    entries = {(r.b, r.value) for r in dc.index(dc.items_table(items, "item_id", "text")).collect()}
    rng = random.Random(1)
    for _ in range(300):
        other = own["print"] & (2**64 - 1)
        for bit in rng.sample(range(64), dc.RADIUS):
            other ^= 1 << bit
        assert any((b, other >> 16 * b & 65535) in entries for b in range(dc.BLOCKS))


def test_equals_sql(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    assert sorted(map(tuple, dc.query(spark, "/root/testdata/sf0.01").collect())) == sorted(c.sql(dc.ORACLE).fetchall())
