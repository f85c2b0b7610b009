from pyspark.sql import functions as F

from tidemark.operators import relational as rel
from tidemark.sources import readers


def test_sorted_segments_and_sampled_rows(spark):
    rows = [(2, 5, 9, 1), (1, 7, 8, 2), (1, 3, 8, 2), (1, 3, 8, 1), (1, 3, 4, 9)]
    df = spark.createDataFrame(rows, "rec_id int, begin int, end int, label int").repartition(3)
    assert [tuple(r) for r in rel.sort_segments(df).collect()] == sorted(rows)
    ids = spark.range(500).repartition(7)
    one, two = ([r.id for r in rel.sample_rows(d, 20, "id", 3).collect()] for d in (ids, ids.repartition(2)))
    assert one == two and len(set(one)) == 20 and one != [r.id for r in rel.sample_rows(ids, 20, "id", 4).collect()]
    assert rel.sample_rows(ids, 900, "id").count() == 500


def test_weighted_draws(spark):
    w = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", 3.0), ("d", None)], "k string, w double")
    got = {r.k: r["count"] for r in rel.sample_weighted(w, "k", "w", 4000).groupBy("k").count().collect()}
    assert got.keys() == {"a", "c"} and abs(got["a"] - 1000) < 120 and sum(got.values()) == 4000
    assert rel.sample_weighted(w.limit(0), "k", "w", 5).count() == 0


def test_signals_of_a_subject_meet_by_sample(spark, tmp_path):
    x = [spark.range(5 + i).select(F.lit(1).alias("rec_id"), F.col("id").alias("seq"), (F.col("id") * (i + 1)).alias(c)) for i, c in enumerate(("x", "ecg", "resp", "label"))]
    got = readers.build_subject_table(*x)
    assert sorted(tuple(r) for r in got.collect()) == [(1, i, i, 2 * i, 3 * i, 4 * i) for i in range(5)]
    readers.write_subjects(got, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").where("rec_id = 1").count() == 5
