import math

from pyspark.sql import functions as F

from tidemark.operators import aggregates as ag


def test_noise_has_its_level_and_is_repeatable(spark):
    tone = spark.range(40000).select((F.col("id") % 2).alias("rec_id"), F.col("id").alias("seq"), (F.sin(F.col("id") / 9.0) * (1 + F.col("id") % 2)).alias("x"))
    noisy = ag.add_noise(tone, 10.0, seed=3)
    both = tone.join(noisy.withColumnRenamed("x", "y"), ["rec_id", "seq"]).groupBy("rec_id").agg(F.avg(F.col("x") ** 2).alias("s"), F.avg((F.col("y") - F.col("x")) ** 2).alias("n"), F.avg(F.col("y") - F.col("x")).alias("m"))
    for r in both.collect():
        assert abs(10 * math.log10(r.s / r.n) - 10) < 0.3 and abs(r.m) < 0.05
    # sums of the power may differ in their last bits with the order of rows
    for seed, most in ((3, 1e-9), (4, None)):
        other = ag.add_noise(tone.repartition(5), 10.0, seed=seed).withColumnRenamed("x", "z")
        apart = noisy.join(other, ["rec_id", "seq"]).agg(F.max(F.abs(F.col("x") - F.col("z"))), F.count("*")).first()
        assert apart[1] == 40000 and (apart[0] < most if most else apart[0] > 1)


def test_peaks(spark):
    df = spark.createDataFrame([(1, 0, -4.0), (1, 1, 2.0), (2, 0, 0.0), (3, 0, None)], "rec_id int, seq int, x double")
    assert sorted((r.rec_id, r.seq, r.x) for r in ag.peak_normalize(df).collect() if r.x is not None) == [(1, 0, -1.0), (1, 1, 0.5), (2, 0, 0.0)]
    assert ag.peak_normalize(df.limit(0)).count() == 0
