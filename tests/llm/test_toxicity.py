import itertools

import numpy as np

from tidemark.llm import toxicity as tx
from tidemark.llm.common import table

SF = "/root/testdata/sf0.1"


def brute(span, cost):
    """The cost of each word that some way through the lattice spells."""
    span, found = span.lower(), {}
    options = []
    for i, ch in enumerate(span):
        own = [(ch, 0.0)] + ([("", tx.DROP_REPEAT)] if i and span[i - 1] == ch else []) if ch.isalpha() else [(x, tx.SWAP) for x in tx.LOOKALIKES.get(ch, "")] + [("", tx.DROP_SEPARATOR if ch in tx.SEPARATORS else tx.DROP_OTHER)]
        options.append(own)
    for way in itertools.product(*options):
        word = "".join(x for x, _ in way)
        c = [0, 0, *map(tx.code, word), 0]
        price = sum(p for _, p in way) + sum(cost[x, y, z] for x, y, z in zip(c, c[1:], c[2:]))
        found[word] = min(price, found.get(word, price))
    return found


def test_viterbi_is_the_cheapest_way():
    cost = tx.language_model(np.random.default_rng(0).integers(0, 500, tx.ALPHABET**3))
    for span in ("1d10t", "s.t.u.p", "$tuuupid", "a@@b", "m0r0n!", "1|1|o", "b.bb.b"):
        ways = brute(span, cost)
        assert ways[tx.restore(span, cost)] <= min(ways.values()) + 1e-9, span


def test_held_out_and_disguises(spark):
    docs, labels = table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "labels")
    model = tx.train_on(docs, labels)
    for clear, hidden in (("idiot", "1d10t"), ("stupid", "s t u p i d"), ("stupid", "stuuuupid"), ("moron", "m0r0n"), ("loser", "l.o.s.e.r"), ("trash", "tr@sh"), ("scum", "$cum")):
        rows = spark.createDataFrame([(1, f"the an {hidden} of the erst"), (2, "the an of the erst 12 a-b")], "doc_id long, text string")
        a, b = tx.score(rows, model).collect()
        assert a.score >= 0.7 > b.score, (clear, hidden, [tx.restore(x, model["cost"]) for x in tx.suspicious(rows.first().text)])
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in tx.query(spark, SF).collect() if r.held_out and r.doc_id in truth]
    hit = sum(r.predicted for r in rows if truth[r.doc_id]) / sum(truth[r.doc_id] for r in rows)
    false = sum(r.predicted for r in rows if not truth[r.doc_id]) / len(rows)
    print(hit, false)
    assert hit > 0.8 and false < 0.03


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "x " * 50000, 5), (2, "", 5)], "doc_id long, text string, score int")
    model = tx.learn(docs, spark.createDataFrame([], "text string, toxic int"))
    got = tx.score(docs, model).collect()
    assert len(got) == 4 and all(0 <= r.score < 0.7 for r in got)
    assert tx.score(docs.limit(0), model).count() == 0
    assert tx.learn(docs.limit(0), docs.selectExpr("text", "1 AS toxic"))["base"] > 0
