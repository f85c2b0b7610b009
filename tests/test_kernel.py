import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import models


def dual_decisions(x, y, box, scale, rounds=20_000):
    """The kernel's own problem by pairs of multipliers, to the end."""
    k = (1 + x @ x.T / scale**2) ** 3
    a, s = np.zeros(len(y)), np.where(y == 1, 1.0, -1.0)
    g = -np.ones(len(y))  # of half a'Qa - sum a
    q = s[:, None] * s * k
    for _ in range(rounds):
        up = ((s > 0) & (a < box)) | ((s < 0) & (a > 0))
        low = ((s < 0) & (a < box)) | ((s > 0) & (a > 0))
        v = -s * g
        i, j = np.flatnonzero(up)[v[up].argmax()], np.flatnonzero(low)[v[low].argmin()]
        if v[i] - v[j] < 1e-7:
            break
        step = (v[i] - v[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = min(step, box - a[i] if s[i] > 0 else a[i], a[j] if s[j] > 0 else box - a[j])
        for m, d in ((i, s[i] * step), (j, -s[j] * step)):
            a[m] += d
            g += q[:, m] * d
    free = (a > 1e-8) & (a < box - 1e-8)
    v = -s * g
    bias = v[free].mean() if free.any() else (v[up].max() + v[low].min()) / 2
    return (a * s) @ k + bias, 0.5 * a @ q @ a - a.sum()


def test_products_are_the_kernels(spark):
    r = np.random.default_rng(0)
    x, z = r.normal(size=(2, 4))
    w = np.array(models.cubic_weights(4))
    a, b = (np.array(models._expanded(v.tolist(), 3)) * w for v in (x, z))
    assert abs(a @ b + 1 - (1 + x @ z) ** 3) < 1e-9 and len(models.cubic_weights(7)) == 119


def test_decisions_equal_the_dual_solution(spark, tmp_path):
    r = np.random.default_rng(1)
    x = r.normal(size=(90, 3))
    y = (x[:, 0] ** 2 + x[:, 1] * x[:, 2] + 0.3 * r.normal(size=90) > 0.6).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "label": y}))
    df = df.withColumn("id", F.monotonically_increasing_id())
    model = models.train_stress(df, features=("a", "b", "c"))
    model.save(f"{tmp_path}/m")
    got, again = (np.array([q.decision for q in m.transform(df).orderBy("id").collect()]) for m in (model, models.KernelMachine.load(f"{tmp_path}/m")))
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    want, best = dual_decisions(z, y, 1.0, 3**0.5)
    side = np.where(y == 1, 1.0, -1.0)
    primal = 0.5 * (model.weights[:-1] ** 2).sum() + np.maximum(0, 1 - side * got).sum()
    assert np.allclose(got, again) and np.abs(got - want).max() < 0.01 and abs(primal + best) < 0.01
    assert ((got > 0) == (y == 1)).mean() > 0.9 and len(model.weights) == 20


def test_folds_and_missing_values(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"id": range(300), "a": x[:, 0], "b": x[:, 1], "label": y}))
    p = models.fold_predictions(df, models.KernelSVM(("a", "b")), "id", 2).collect()
    assert len(p) == 300 and len({q.fold for q in p}) == 2 and np.mean([q.prediction == q.label for q in p]) > 0.85  # a product, which no plane tells
    holes = df.unionByName(spark.createDataFrame([(999, None, 1.0, 1.0)], "id long, a double, b double, label double"))
    assert models.KernelSVM(("a", "b")).fit(holes.limit(40)).transform(holes).count() == 300
