import random
import re

import duckdb
import pytest

from tidemark.llm import ngram_join as nj

SF = "/root/testdata"


def brute(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


@pytest.mark.parametrize(("k", "t"), [(3, (9, 10)), (5, (4, 5)), (1, (1, 2))])
def test_against_brute_force(spark, k, t):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    foot = " ".join(rng.choices(vocab, k=30))
    rows = []
    for g in range(25):
        base = rng.choices(vocab, k=rng.choice([4, 30, 120, 300]))
        for _ in range(rng.choice([1, 2, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, len(w) // 40])):
                w[rng.randrange(len(w))] = rng.choice(vocab).upper()
            rows.append((len(rows) * 7 % 1009, " ".join(w) + (" " + foot if g % 3 == 0 else "")))
    rows += [(2000, None), (2001, ""), (2002, "a b"), (2003, "A  b"), (2004, "a"), (None, "a b"), (2002, "a b"), (None, "only null here"), (2010, "rep " * 20000), (2011, "rep rep rep rep")]
    got = nj.join_groups(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS sig", "2 AS n", "3 AS id").repartition(3), k=k, t=t).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, k, *t)


@pytest.mark.parametrize(("k", "t"), [(3, (9, 10)), (5, (4, 5))])
def test_large_star_of_copies_that_mostly_do_not_link(spark, k, t):
    """Near copies with up to five edits each, some of them shared: few link, and those that do share rare edits."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(150)]
    rows, families = [], [[(rng.randrange(150), f"f{j}x{i}") for i in range(6)] for j in range(12)]
    for i in range(260):
        w = list(base)
        for at, x in rng.choice(families)[: rng.choice([0, 0, 4, 6])]:
            w[at] = x
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[f"e{rng.randrange(3000)}"], [], ["in", w[at]]])
        rows.append((i, " ".join(w)))
    got = nj.join_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k=k, t=t).collect()
    want = brute(rows, k, *t)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert 20 < len({r[2] for r in want}) < 250


def test_order_of_shingles_follows_from_them_alone(spark):
    """A shingle has one place in the order, whatever texts come with it in its slice."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(60)], k=rng.randrange(3, 200))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr("*", "xxhash64(text) AS t1", "id AS t2")
    counts = nj.corpus_counts(docs, 3)
    one, other = (nj.rows_with_prefixes(d, "bigint", 3, (9, 10), counts).orderBy("id").collect() for d in (docs.coalesce(1), docs.orderBy(docs["id"].desc()).repartition(7)))
    assert one == other and len(one) == 120


def test_empty(spark):
    assert nj.join_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_tables(spark, sf):
    got = sorted(map(tuple, nj.query(spark, f"{SF}/{sf}").collect()))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/{sf}/documents.parquet'")
    want = sorted(c.sql(nj.ORACLE).fetchall())
    assert got == want and sum(r[0] != r[2] for r in got) > 10


def test_families_of_a_template_are_joined_in_proportion(spark, monkeypatch):
    """A base with copies, and a template of it with copies of its own beside them: the edits that the template's copies share must not pair them all."""
    import random

    counts, links = [], nj.star_links

    def counted(members, t):
        out = links(members, t).cache()
        counts.append(out.count())
        return out

    monkeypatch.setattr(nj, "star_links", counted)
    for m in (40, 80, 160):
        r = random.Random(1)
        base = [f"w{r.randrange(5000)}" for _ in range(300)]
        template = [*base]
        for i in range(10, 290, 20):
            template[i] = f"t{i}"

        def copies(text, n, r=r):
            out = []
            for _ in range(n):
                own = [*text]
                for i in r.sample(range(300), 5):
                    own[i] = f"e{r.randrange(10**9)}"
                out.append(own)
            return out

        texts = [" ".join(x) for x in [*copies(base, 2 * m), *copies(template, m)]]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        got = {x.doc_id: x.component_id for x in nj.join_groups(docs, k=3, t=(9, 10)).collect()}
        sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in map(str.split, texts)]
        root = list(range(len(sets)))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for i in range(len(sets)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if 10 * both >= 9 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
        assert got == {i: find(i) for i in range(len(sets))}
    assert counts[2] <= 3 * counts[1] <= 9 * counts[0] and counts[2] <= 6 * 160, counts
