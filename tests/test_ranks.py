import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates as ag
from tidemark.operators import ranks


def by_rank(x, rank):
    v = np.sort(x)[rank - 1]
    return rank, v, int((x < v).sum()), int((x == v).sum())


@pytest.mark.parametrize("most", [10_000, 40])
def test_values_by_rank(spark, most):
    r = np.random.default_rng(0)
    data = {"hot": r.normal(size=30_000), "ties": r.integers(0, 3, 5000).astype(float), "odd": np.concatenate([[1e300, -1e300], np.zeros(900)]), "one": np.array([4.0])}
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in data.items()])).unionByName(spark.createDataFrame([("hot", None), (None, 1.0)], "k string, v double")).repartition(4)
    want = {k: sorted({1, 2, len(v) // 3 or 1, len(v) - 1 or 1, len(v)}) for k, v in data.items()}
    asked = spark.createDataFrame([(k, i) for k, v in want.items() for i in [*v, len(data[k]) + 1, 0]], "k string, rank long")
    got = sorted(tuple(q) for q in ranks.at_ranks(df, asked, "k", "v", most).collect())
    assert got == sorted((k, *by_rank(data[k], i)) for k, v in want.items() for i in v if i <= len(data[k]))
    assert ranks.at_ranks(df.limit(0), asked, "k", "v").count() == 0


def test_no_window_by_key(spark):
    df = spark.range(1000).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("v"))
    for made in (ag.quantile_n1(df, "k", "v", 0.3), ag.energy_confidence(df, "k", "v"), ag.normalize_balanced(df, "k", "v", "v")):
        assert "Window" not in made._jdf.queryExecution().executedPlan().toString()
    assert ag.quantile_n1(df, "k", "v", 0.3).first()["quantile"] == pytest.approx(1001 * 0.3 - 1)


def test_ties_share_the_end_of_a_beginning(spark):
    rows = [("a", 1.0, 1), ("a", 5.0, 2), ("a", 7.0, 2), ("b", 2.0, 1), ("b", 4.0, 2)]
    df = spark.createDataFrame(rows, "c string, x double, o int")
    x, w = np.array([1, 5, 7, 2, 4.0]), np.array([1, 0.5, 0.5, 1, 1])
    mu = (w * x).sum() / 4
    z = (x - mu) / np.sqrt((w * (x - mu) ** 2).sum() / 3)
    got = {r.x: r.z for r in ag.normalize_balanced(df, "c", "x", "o").collect()}
    assert all(got[a] == pytest.approx(b) for a, b in zip(x, z - z.mean()))
