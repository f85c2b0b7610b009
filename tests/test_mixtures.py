import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import mixtures as mx
from tidemark.operators import models


def keyed(spark, data):
    return spark.createDataFrame([(k, p.tolist()) for k, x in data.items() for p in x], "key string, v array<double>")


def rows_of(df):
    """Each key's vectors and their numbers, as they are packed."""
    out = {}
    for r in mx.pack(df, "key", "v").collect():
        out.setdefault(r.src, []).append((mx.unpacked(r.data, r["size"]), np.frombuffer(r.ids, np.int64)))
    return {k: tuple(np.concatenate(x) for x in zip(*v)) for k, v in out.items()}


def test_the_best_of_three_starts_and_on_while_bic_falls(spark):
    r = np.random.default_rng(4)
    many = np.concatenate([r.normal((3 * (i % 3), 3 * (i // 3)), 0.15, (40, 2)) for i in range(9)])
    two = np.concatenate([r.normal(m, 0.3, (60, 2)) for m in (0, 4)])
    df = keyed(spark, {"a": many, "b": two, "c": two[55:62]})
    packed = rows_of(df)

    def starts(key, k):
        x, ids = packed[key]
        return [mx.gmm_em(x, k, 350, i, ids)[3][-1] for i in range(3)]

    got = mx.fit_gmm(df.where("key = 'b'"), "key", "v", [3]).collect()
    assert len(got) == 3 and mx.STEPS == 350
    chosen = {}
    for x in mx.select_gmm(df, "key", "v", [2, 3, 4, 5, 6]).collect():
        chosen.setdefault(x.key, []).append(x)
    for key, (x, _) in packed.items():
        fits = {}

        def bic(k, key=key, n=len(x), fits=fits):
            if k not in fits:
                fits[k] = -2 * max(starts(key, k)) + (5 * k - 1) * np.log(n)
            return fits[k]

        best = min(range(2, 7), key=bic)
        for k in range(7, min(20, len(x)) + 1):
            if bic(k) >= bic(best):
                break
            best = k
        assert len(chosen[key]) == best == chosen[key][0].k and sorted(c.comp for c in chosen[key]) == list(range(best)), key
        assert abs(chosen[key][0].bic - bic(best)) < 1e-6
    assert len(chosen["a"]) > 6 and len(chosen["c"]) <= 7
    seen = mx.gmm_em(many, 3)[3]
    assert all(b >= a - 1e-6 for a, b in zip(seen, seen[1:], strict=False))


def test_blocks_and_rounds_give_what_one_task_gives(spark):
    r = np.random.default_rng(5)
    data = {"a": np.concatenate([r.normal(m, 0.5, (70, 3)) for m in (0, 3, 7)]), "b": np.concatenate([r.normal(0, 1, (90, 3)), np.tile([[9.0, 9.0, 9.0]], (60, 1))]), "small": r.normal(0, 1, (30, 3)), "c": np.tile([[1.0, 2.0, 3.0]], (80, 1))}
    df = keyed(spark, data).unionByName(keyed(spark, {"a": np.zeros((0, 3))}))
    packed = mx.pack(df, "key", "v", 50)
    assert packed.agg(F.max("n")).first()[0] <= 80 and packed.where("src = 'a'").count() > 2
    members = packed.select(F.col("src").alias("key"), "src").distinct()
    one, many = ({(f.key, f.k, f.comp): f for f in mx.fit_packed(packed, members, [1, 3], rows=rows).collect()} for rows in (10**6, 50))
    assert one.keys() == many.keys() and len(one) == 4 * 4
    for k, f in one.items():
        assert np.isclose(f.loglik, many[k].loglik, rtol=1e-7) and np.isclose(f.bic, many[k].bic, rtol=1e-7)
        assert np.allclose(f["mean"], many[k]["mean"], atol=1e-5) and np.allclose(f["var"], many[k]["var"], rtol=1e-4, atol=1e-8) and np.isclose(f.weight, many[k].weight, atol=1e-6)
    assert mx.fit_gmm(df.limit(0), "key", "v", [2]).count() == 0


def test_only_touched_pairs_are_fitted_again(spark):
    r = np.random.default_rng(6)
    # five clusters: three alike, two alike
    pts = np.concatenate([np.tile([[0.0, 0.0], [3.0, 0.0]], (25, 1)) + r.normal(0, 0.3, (50, 2)) for _ in range(3)] + [np.tile([[9.0, 9.0], [9.0, 6.0]], (25, 1)) + r.normal(0, 0.3, (50, 2)) for _ in range(2)])
    frames = spark.createDataFrame(pd.DataFrame({"rec_id": 1, "seq": range(250), "label": np.repeat(range(5), 50), "v": pts.tolist()}))
    merging, fitted = models.Merging(frames, 1), []
    while merging.round():
        fitted.append(merging.fitted)
    fitted.append(merging.fitted)
    assert fitted == [10, 13, 15, 16]  # all pairs of five, then those with the merged one of four, three and two
    got = {q.seq: q.label for q in merging.labels(frames).collect()}
    assert len({got[i] for i in range(150)}) == len({got[i] for i in range(150, 250)}) == 1 and got[0] != got[200]
    step, before = frames, 5
    while True:  # without what was kept
        step = models.merge_round(step, 1)
        now = step.select("label").distinct().count()
        if now == before:
            break
        before = now
    assert {q.seq: q.label for q in step.collect()} == got


def test_first_clusters_by_likeliest_component(spark):
    r = np.random.default_rng(7)
    x = np.concatenate([r.normal(m, 0.3, (60, 2)) for m in (0, 5)])
    df = keyed(spark, {"a": x}).withColumn("id", F.monotonically_increasing_id())
    got = models.initial_clusters(df, "key", "v", [2]).collect()
    side = {(q.v[0] > 2.5, q.cluster) for q in got}
    assert len(got) == 120 and len(side) == len({c for _, c in side})
