import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import aggregates, audio, intervals, models, vectors
from tidemark.operators.noise import expint


def test_expint_and_pitch_and_formants(spark):
    assert np.allclose(expint(np.array([0.1, 1.0, 5.0])), [1.822923958, 0.219383934, 0.001148296], rtol=1e-5)
    fs, t = 8000, np.arange(400) / 8000
    voice = sum(np.sin(2 * np.pi * 125 * k * t) / k for k in range(1, 6))
    r = spark.createDataFrame([(voice.tolist(),)], "v array<double>").select(audio.pitch("v", fs).alias("p")).first().p
    assert abs(r.f0 - 125) < 3 and r.harmonicity > 0.9
    rng, x = np.random.default_rng(0), np.zeros(1600)
    z = [0.97 * np.exp(2j * np.pi * f / fs) for f in (700, 1800)]
    a = np.real(np.poly([*z, *np.conj(z)]))
    for i in range(5, 1600):
        x[i] = rng.normal() - a[1:] @ x[i - 1 : i - 5 : -1]
    f = spark.createDataFrame([(x.tolist(),)], "v array<double>").select(audio.formants("v", fs, 4).alias("f")).first().f
    assert abs(f[0] - 700) < 40 and abs(f[1] - 1800) < 40


def test_speech_and_enhancement(spark):
    r = np.random.default_rng(3)
    noise = r.normal(0, 0.1, (400, 128))
    tone = np.sin(2 * np.pi * 0.1 * np.arange(128))
    x = noise + np.where((np.arange(400) >= 260) & (np.arange(400) < 320), 1.0, 0.0)[:, None] * tone
    rows = pd.DataFrame({"rec_id": 1, "seq": range(400), "v": x.tolist(), "power": (np.abs(np.fft.rfft(x, axis=1)) ** 2).tolist()})
    df = spark.createDataFrame(rows)
    (s,) = [q for q in audio.detect_speech(df, 25).collect() if q.begin > 175]  # before, the tracker has not seen one window of noise
    assert abs(s.begin - 260) <= 3 and 316 <= s.end <= 345  # the chain lets speech ring out
    for kind in ("mmse", "amplitude", "perceptual", "specsub"):
        out = np.stack([q.v for q in audio.enhance(df.select("rec_id", "seq", "v"), kind).orderBy("seq").collect()])
        assert (out[200:250] ** 2).mean() < 0.5 * (x[200:250] ** 2).mean() and np.corrcoef(out[280], tone)[0, 1] > 0.95, kind


def test_audio_in_audio_out(spark):
    """Frames of samples, their window and its overlaps give the samples back; voice activity from samples."""
    fs, r = 2000, np.random.default_rng(4)
    t = np.arange(4 * fs)
    on = (t >= 2.5 * fs) & (t < 3.2 * fs)
    x = r.normal(0, 0.05, len(t)) + np.where(on, np.sin(2 * np.pi * 0.11 * t), 0.0)
    df = spark.createDataFrame(pd.DataFrame({"rec_id": 1, "seq": t, "x": x}))
    hop = round(0.016 * fs)
    w = np.hamming(2 * hop + 1)[:-1] ** 0.5
    w = w / np.sqrt((w[::hop] ** 2).sum())
    framed = audio.speech_frames(df, fs, 0.016, 2, True, "reflect").select("rec_id", F.col("seq").alias("frame"), F.posexplode(F.zip_with("v", F.array(*map(F.lit, w.tolist())), lambda a, b: a * b)).alias("k", "v"))
    back = np.array([q.x for q in aggregates.overlap_add(framed, hop).orderBy("seq").collect()])
    assert np.allclose(back[hop : len(x) - 2 * hop], x[hop : len(x) - 2 * hop])
    clean = np.array([q.x for q in audio.enhance_audio(df, fs).orderBy("seq").collect()])
    assert len(clean) == len(x) and (clean[2 * fs : int(2.4 * fs)] ** 2).mean() < 0.3 * (x[2 * fs : int(2.4 * fs)] ** 2).mean() and np.corrcoef(clean[on], x[on])[0, 1] > 0.98
    said = np.array([q.label for q in audio.vad_sohn(df, fs).orderBy("seq").collect()])
    frames = np.arange(len(said)) * 0.01
    assert said[(frames > 2.52) & (frames < 3.15)].mean() > 0.95 and said[(frames > 1.75) & (frames < 2.45)].mean() < 0.1


def test_beats(spark):
    fs, n = 360, 360 * 20
    t = np.arange(n)
    beats = np.arange(180, n - 200, 290)
    x = sum(np.exp(-(((t - b) / 6.0) ** 2)) for b in beats) + 0.02 * np.sin(2 * np.pi * t / 2000)
    df = spark.createDataFrame(pd.DataFrame({"rec_id": 1, "seq": t, "x": x}))
    at = np.array(sorted(r["at"] for r in audio.detect_rpeaks(df, fs).collect()))
    hit = sum(np.abs(at - b).min() <= 18 for b in beats)
    assert hit >= len(beats) - 2 and len(at) <= len(beats) + 2
    assert np.allclose(audio.wavelet_band(np.ones(64)), 0)


def test_runs_levels_windows(spark):
    runs = spark.createDataFrame([(1, 0, 49, 1), (1, 50, 53, 2), (1, 54, 99, 1), (1, 100, 160, 2)], "rec_id int, begin int, end int, label int")
    assert [(r.begin, r.end, r.label) for r in audio.min_run(runs, {1: 20, 2: 20}).orderBy("begin").collect()] == [(0, 99, 1), (100, 160, 2)]
    x = np.sin(2 * np.pi * 0.05 * np.arange(8000))
    df = spark.createDataFrame(pd.DataFrame({"rec_id": 1, "seq": range(8000), "x": x}))
    r = audio.active_level(df, 1000.0).first()
    assert abs(r.level_db + 3.01) < 0.5 and 0.9 < r.activity < 1.1
    segs = spark.createDataFrame([(1, 0, 24), (1, 100, 104)], "rec_id int, begin int, end int")
    assert [(w.begin, w.end) for w in intervals.long_windows(segs, 10).orderBy("begin").collect()] == [(0, 9), (5, 14), (10, 19), (15, 24)]
    flags = intervals.regrid_decisions(spark.createDataFrame([(1, 0, 12, 1)], "rec_id int, begin int, end int, label int"), spark.createDataFrame([(1, 0, 9), (1, 10, 19)], "rec_id int, begin int, end int"))
    assert [f.flag for f in flags.orderBy("begin").collect()] == [1, 0]


def test_models(spark):
    r = np.random.default_rng(5)
    y = np.arange(200) % 2
    feats = spark.createDataFrame(pd.DataFrame({"id": range(200), "body_energy_ave": y * 2 + r.normal(0, 0.4, 200), "body_abs_mean": r.normal(0, 1, 200), "body_std": y + r.normal(0, 0.4, 200), "label": y.astype(float)}))
    model = models.train_movement(feats)
    assert model.transform(feats).where("prediction = label").count() > 190
    both = np.tile([[0.0, 0.0], [3.0, 0.0]], (30, 1))  # two clusters with the same two modes, which one Gaussian each can't have
    pts = np.concatenate([m + r.normal(0, 0.3, (60, 2)) for m in (both, both, [6, 6])])
    frames = spark.createDataFrame(pd.DataFrame({"rec_id": 1, "label": np.repeat([0, 1, 2], 60), "v": pts.tolist()}))
    merged = models.merge_clusters(frames, 1, 3)
    assert {q.label for q in merged.select("label").distinct().collect()} == {0, 2}
    x = frames.withColumn("id", F.monotonically_increasing_id())
    start = spark.createDataFrame([(0, [1.0, 0.0]), (1, [5.0, 5.0])], "center int, mean array<double>")
    step = {q.center: q["mean"] for q in vectors.kmeans_harmonic(x, start, "v", rounds=1).collect()}
    assert np.allclose(step[1], [6, 6], atol=0.5) and np.allclose(step[0], [1.5, 0], atol=1.6)
    t = models.lda_fit(frames, "v", "label", 1)
    assert abs(t[1, 0]) > abs(t[0, 0])  # the first place varies within clusters


def test_drop_worst_by_exact_rank(spark):
    n = 300_007
    x = spark.range(n).select("id", F.array(F.pmod(F.hash("id"), F.lit(1 << 30)) / float(1 << 28)).alias("v"))
    params = spark.createDataFrame([(0, 1.0, [0.0], [1.0])], "comp int, weight double, mean array<double>, var array<double>")
    values = np.sort([r[0] for r in x.select(F.col("v")[0]).collect()])[::-1]  # the farther, the worse
    for share in (0.1, 0.00001, 0.0):
        rank = int(np.ceil(share * n - 1e-9))
        want = int((values < values[rank - 1]).sum()) if rank else n
        assert models.drop_worst(x, params, "id", "v", share).count() == want
    same = x.limit(100).select("id", F.array(F.lit(1.0)).alias("v"))
    assert models.drop_worst(same, params, "id", "v").count() == 0  # all tie with the last to go
