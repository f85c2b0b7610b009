import wave

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import models, vectors
from tidemark.sources import readers


def blobs(seed=0, n=60):
    r = np.random.default_rng(seed)
    return np.concatenate([r.normal(m, 0.4, (n, 2)) for m in ((0, 0), (5, 0), (0, 5))])


def frame(spark, x):
    return spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "v": x.tolist()}))


def start(spark, c):
    return spark.createDataFrame([(i, [float(q) for q in v]) for i, v in enumerate(c)], "center int, mean array<double>")


def test_centres_without_rows_move_to_the_farthest_rows(spark):
    x = blobs()
    c = np.array([[0.0, 0.0], [100.0, 100.0], [-100.0, 100.0], [50.0, -90.0]])
    errors, want, now = [], [], c.copy()
    for _ in range(12):
        d = ((x[:, None] - now) ** 2).sum(axis=2)
        own, least = d.argmin(axis=1), d.min(axis=1)
        want.append(least.mean())
        before = now.copy()
        far = [i for i in np.lexsort([np.arange(len(x)), -least]) if least[i] > 0]
        for k in range(len(c)):
            now[k] = x[own == k].mean(axis=0) if (own == k).any() else x[far.pop(0)]
        if np.array_equal(now, before):
            break
    got = {r.center: r["mean"] for r in vectors.kmeans(frame(spark, x), start(spark, c), "id", "v", 12, errors).collect()}
    assert len(got) == 4 and np.allclose([got[k] for k in range(4)], now) and np.allclose(errors, want) and len(errors) < 12
    same = frame(spark, np.ones((5, 2)))
    got = vectors.kmeans(same, start(spark, [[1, 1], [9, 9]]), "id", "v", 3).orderBy("center").collect()
    assert [r["mean"] for r in got] == [[1, 1], [9, 9]]  # no row is off its centre: the lost one stays


def test_harmonic_means_converge(spark):
    x, c, e = blobs(1), np.array([[0.3, 0.1], [1.0, 1.0], [0.0, 2.0]]), 3.5
    errors, want, last, now = [], [], None, c.copy()
    for _ in range(50):
        d = np.sqrt(((x[:, None] - now) ** 2).sum(axis=2))
        w = d ** (-e - 2) / (d**-e).sum(axis=1, keepdims=True) ** 2
        want.append((1 / (d**-e).sum(axis=1)).mean())
        now = (w.T @ x) / w.sum(axis=0)[:, None]
        if last is not None and last - want[-1] <= 1e-3 * last:
            break
        last = want[-1]
    got = vectors.kmeans_harmonic(frame(spark, x).repartition(3), start(spark, c), "v", e, errors=errors).orderBy("center").collect()
    assert np.allclose([r["mean"] for r in got], now) and np.allclose(errors, want) and 2 < len(errors) < 50
    assert sorted(np.argmin(((now[:, None] - [[0, 0], [5, 0], [0, 5]]) ** 2).sum(axis=2), axis=1)) == [0, 1, 2]
    on = vectors.kmeans_harmonic(frame(spark, np.array([[0.0, 0.0], [4.0, 0.0]])), start(spark, [[0, 0], [4, 0]]), "v", 2.0, 1).orderBy("center").collect()
    assert np.allclose([r["mean"] for r in on], [[0, 0], [4, 0]])  # rows on centres


def test_codebook_and_directions(spark):
    x = blobs(2)
    got = vectors.kmeans_lbg(frame(spark, x), "id", "v", 4, 4).collect()
    assert len(got) == 4 and sorted(r.center for r in got) == [0, 1, 2, 3]
    err = ((x[:, None] - np.array([r["mean"] for r in got])) ** 2).sum(axis=2).min(axis=1).mean()
    assert err < 1.0 < ((x - x.mean(axis=0)) ** 2).sum(axis=1).mean()
    y = np.repeat([0, 1, 2], 60)
    got = models.lda_fit(frame(spark, x).withColumn("y", F.floor(F.col("id") / 60)).repartition(4), "v", "y", 2)
    m = np.array([x[y == k].mean(axis=0) for k in range(3)])
    sw = sum(((x[y == k] - m[k]).T @ (x[y == k] - m[k])) for k in range(3))
    sb = sum(60 * np.outer(v - x.mean(axis=0), v - x.mean(axis=0)) for v in m)
    values, want = np.linalg.eig(np.linalg.solve(sw, sb))
    want = want[:, np.argsort(values)[::-1]]
    assert all(abs(np.dot(a, b)) / np.linalg.norm(a) / np.linalg.norm(b) > 1 - 1e-6 for a, b in zip(got.T, want.T))


def test_tracks_with_their_samples(spark, tmp_path):
    r = np.random.default_rng(3)
    sounds = {}
    for i, n in enumerate((900, 1500, 2300, 40, 1000)):
        path = tmp_path / f"u{i}.wav"
        with wave.open(str(path), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(1000)
            x = r.integers(-9000, 9000, n).astype("<i2")
            w.writeframes(x.tobytes())
        sounds[f"file:{path}"] = x / 32768
    audio = readers.read_audio(spark, str(tmp_path / "*.wav"), 1.0)
    names = {q.path.replace("file://", "file:").replace("file:///", "file:/"): q.path for q in audio.select("path").distinct().collect()}
    rows = [(names[k], f"s{i % 2}", len(x)) for i, (k, x) in enumerate(sounds.items())]
    pool = spark.createDataFrame(rows, "file string, speaker string, length long")
    turns = readers.mix_tracks(pool, 25, seed=4)
    got = turns.orderBy("turn").collect()
    assert [t.turn for t in got] == list(range(1, 26)) and got[0].begin == 1 and all(b.begin == a.end + 1 and a.end - a.begin + 1 == a.length for a, b in zip(got, got[1:]))
    assert {t.file for t in got} == set(names.values()) and all((t.file, t.speaker, t.length) in rows for t in got)
    track = np.concatenate([sounds[next(k for k, v in names.items() if v == t.file)] for t in got])
    parts = readers.mixed_audio(turns, audio).orderBy("start").collect()
    assert np.allclose(np.concatenate([p.pcm for p in parts]), track, atol=1e-6) and parts[-1].start + len(parts[-1].pcm) == got[-1].end + 1
    assert readers.mix_tracks(pool.limit(0), 5).count() == 0


def test_running_totals_over_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 7 % 5003).alias("o"), (F.col("id") % 11).alias("v"))
    got = readers.running_total(df, "o", F.col("v"), "t").orderBy("o").collect()
    assert [q.t for q in got] == np.cumsum([q.v for q in got]).tolist()


def test_lines_of_labels_keep_their_order(spark, tmp_path):
    lines = [f"{i % 3} 5 {i % 4} {i} {i + 9}" for i in range(3000)]
    (tmp_path / "labels.txt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = readers.read_interval_labels(spark, str(tmp_path / "labels.txt")).orderBy("row").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(q.row, q.begin, q.end) for q in got] == [(i, i, i + 9) for i in range(3000)]
