import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import signal as sg


def recording(spark, x, fs=1.0):
    return spark.createDataFrame(pd.DataFrame({"rec_id": 1, "seq": np.arange(len(x)), "t": np.arange(len(x)) / fs, "x": np.asarray(x, float)}))


def values(df, col="x"):
    return np.array([r[col] for r in df.orderBy("seq").collect()])


def test_interpolation():
    t = np.array([0.0, 1, 2.5, 3, 4.2, 6])
    at = np.linspace(0, 6, 25)
    cubic = lambda v: 0.3 * v**3 - v**2 + 2
    assert np.allclose(sg.spline(t, cubic(t), at), cubic(at))  # these end conditions keep cubics
    assert np.allclose(sg.makima(t, 2 * t + 1, at), 2 * at + 1)
    y = np.array([0.0, 0, 0, 1, 1, 1])
    assert sg.makima(t, y, at).max() <= 1 + 1e-9


def test_filters_and_trend(spark):
    fs, t = 100.0, np.arange(600) / 100
    slow, fast = np.sin(2 * np.pi * t), np.sin(2 * np.pi * 40 * t)
    out = values(sg.lowpass_zero_phase(recording(spark, slow + fast, fs), fs))
    assert np.abs(out - slow)[50:-50].max() < 0.05
    z = np.random.default_rng(0).normal(size=40)
    d = np.diff(np.eye(40), 2, axis=0)
    assert np.allclose(sg.smooth_trend(z, 5.0), np.linalg.solve(np.eye(40) + 25 * d.T @ d, z))
    line = values(sg.detrend_priors(recording(spark, 3 * np.arange(50) + 1)))
    assert np.abs(line).max() < 1e-6
    up = values(sg.resample_spline(recording(spark, slow, fs), 50.0))
    assert np.allclose(up, slow[::2], atol=1e-9)


def test_spectra(spark):
    x = np.sin(2 * np.pi * 0.25 * np.arange(240) / 4 * 1.0) + 0.01 * np.random.default_rng(1).normal(size=240)
    psd = sg.burg_psd(spark.createDataFrame([(1, x.tolist())], "rec_id int, v array<double>"), "v").collect()
    assert abs(max(psd, key=lambda r: r.p).f - 0.25) < 0.01
    p = spark.createDataFrame([(x[:64].tolist(),)], "v array<double>").select(sg.power_spectrum("v").alias("p")).first().p
    assert np.allclose(p, np.abs(np.fft.rfft(x[:64])) ** 2)
    c = spark.createDataFrame([(x[:64].tolist(),), (x[64:128].tolist(),)], "v array<double>").select(sg.mfcc("v", 4000.0).alias("c")).collect()
    assert len(c[0].c) == 12 and np.isfinite(c[0].c).all()


def test_repair_groups_alignment(spark):
    x = np.ones(40) + 0.01 * (np.arange(40) % 5)
    x[20] = 50
    got = sg.outlier_repair(recording(spark, x)).where("repaired").collect()
    assert [(r.seq, round(r.x, 3)) for r in got] == [(20, round((x[19] + x[21]) / 2, 3))]
    on = [3, 5, 8, 30, 33, 60]
    df = recording(spark, np.zeros(70)).withColumn("event", F.col("seq").isin(*on))
    assert [(r.begin, r.end) for r in sg.group_events(df, 10, 2).orderBy("begin").collect()] == [(3, 8), (30, 33)]
    a = spark.createDataFrame([(1, float(v)) for v in (1, 11, 21, 27, 31, 42, 51)], "rec_id int, t double")
    b = spark.createDataFrame([(1, float(v)) for v in (2, 12, 15, 22, 25, 32, 41, 52, 61)], "rec_id int, t double")
    pairs = sg.align_markers(a, b, 1.1)
    assert sorted((r.x, r.y) for r in pairs.collect()) == [(1, 2), (11, 12), (21, 22), (31, 32), (42, 41), (51, 52)]
    assert sg.marker_stats(pairs).first().n == 6


def test_viterbi(spark):
    r = np.random.default_rng(2)
    truth = np.repeat([0, 1, 0], [30, 25, 40])
    ll = -((np.stack([truth - 0, truth - 1], axis=1) + r.normal(0, 0.6, (95, 2))) ** 2) * 2
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(ll)], "rec_id int, seq int, loglik array<double>")
    runs = [(x.begin, x.end, x.label) for x in sg.viterbi(df, 10).orderBy("begin").collect()]
    assert [x[2] for x in runs] == [0, 1, 0] and abs(runs[1][0] - 30) <= 3 and all(b - a + 1 >= 10 for a, b, _ in runs)
    start, trans = sg.build_hmm(2, 3)
    assert start.sum() == 1 and trans[2, 3] == trans[2, 2] == 1 / 3
