import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import mixtures, models, signal
from tidemark.sources import readers


def test_a_model_and_features_come_back(spark, tmp_path):
    df = spark.range(80).select(*((F.sin(F.col("id") * k) + F.col("id") % 2 * 3).alias(c) for k, c in enumerate(models.MOVEMENT_FEATURES, 1)), (F.col("id") % 2).cast("int").alias("label"))
    model = models.train_movement(df)
    readers.save_model(model, f"{tmp_path}/model")
    readers.save_model(model, f"{tmp_path}/model")
    again = readers.load_model(f"{tmp_path}/model")
    rows = [[r.prediction for r in m.transform(df).orderBy(*models.MOVEMENT_FEATURES).collect()] for m in (model, again)]
    assert rows[0] == rows[1] and set(rows[0]) == {0.0, 1.0}
    readers.save_features(df, f"{tmp_path}/feats")
    assert sorted(readers.load_features(spark, f"{tmp_path}/feats").collect()) == sorted(df.collect())


def test_aic_counts_parameters(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(0, 1, (60, 2)), r.normal(9, 1, (60, 2))])
    df = spark.createDataFrame([("a", [float(a), float(b)]) for a, b in x], "key string, v array<double>")
    got = {g.k: g for g in mixtures.aic_table(df, "key", "v", [1, 2]).collect()}
    assert all(abs(got[k].aic - (2 * (5 * k - 1) - 2 * got[k].loglik)) < 1e-9 for k in (1, 2)) and got[2].aic < got[1].aic


def test_speech_features_against_numpy(spark):
    r = np.random.default_rng(2)
    waves = {(rec, i): r.normal(size=64) for rec in (1, 2) for i in range(12 if rec == 1 else 1)}
    df = spark.createDataFrame([(k[0], k[1], v.tolist()) for k, v in waves.items()], "rec_id int, seq int, v array<double>")
    base = {(g.rec_id, g.seq): np.array([*g.c, np.mean(np.sign(waves[g.rec_id, g.seq][1:]) != np.sign(waves[g.rec_id, g.seq][:-1]))]) for g in df.select("rec_id", "seq", signal.mfcc("v", 8000.0).alias("c")).collect()}
    got = {(g.rec_id, g.seq): np.array(g.feats) for g in signal.vad_features(df, 8000.0).collect()}
    for rec, n in ((1, 12), (2, 1)):
        f = np.stack([base[rec, i] for i in range(n)])
        at = lambda a, i: a[min(max(i, 0), n - 1)]
        d = np.stack([sum(k * (at(f, i + k) - at(f, i - k)) for k in range(1, 5)) / 60 for i in range(n)])
        dd = np.stack([(at(d, i + 1) - at(d, i - 1)) / 2 for i in range(n)])
        assert all(len(got[rec, i]) == 39 and np.allclose(got[rec, i], np.concatenate([f[i], d[i], dd[i]])) for i in range(n))
