import itertools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import diarisation as di
from tidemark.operators import signal as sg
from tidemark.operators import windows as win


def test_stays_by_class_against_all_ways():
    r = np.random.default_rng(1)
    for lens in ([1, 2, 3], [2, 2, 2], [3, 1, 2]):
        for _ in range(10):
            ll = r.normal(0, 2, (7, 3))
            best = (-np.inf, None)
            for way in itertools.product(range(3), repeat=7):
                runs = [(c, len(list(g))) for c, g in itertools.groupby(way)]
                if any(n < lens[c] for c, n in runs):
                    continue
                # a stay goes through its chain as often as it can, and waits at the end for the rest; each move from a chain's end costs the same
                moves = sum(n - n // lens[c] * (lens[c] - 1) - 1 for c, n in runs) + len(runs) - 1
                best = max(best, (sum(ll[i, c] for i, c in enumerate(way)) - np.log(3) - moves * np.log(4), way))
            got = [c for b, e, c in sg.viterbi_runs(ll, lens) for _ in range(b, e + 1)]
            assert tuple(got) == best[1]
    start, trans = sg.build_hmm(2, [3, 1])
    assert start.tolist() == [0.5, 0, 0, 0.5] and trans[0, 1] == trans[1, 2] == 1 and np.allclose(trans[2], [1 / 3, 0, 1 / 3, 1 / 3])


def test_large_mixture(spark):
    r = np.random.default_rng(4)
    pts = np.concatenate([r.normal(0, 1, (300, 2)), r.normal(8, 0.5, (100, 2))])
    df = spark.createDataFrame([(p.tolist(),) for p in pts] + [(None,)], "v array<double>").repartition(5)
    got = sorted((p.weight, *p["mean"], *p["var"]) for p in di.fit_large_gmm(df, "v", 2, seed=1).collect())
    assert np.allclose(got[0][:3], [0.25, 8, 8], atol=0.15) and np.allclose(got[1][:3], [0.75, 0, 0], atol=0.15)
    assert np.allclose(got[0][3:], pts[300:].var(axis=0), rtol=0.05) and np.allclose(got[1][3:], pts[:300].var(axis=0), rtol=0.05)
    assert di.fit_large_gmm(df.limit(0), "v", 2).count() == 0


def track(parts, seed, rec):
    """Frames of (label, length) parts: silence is faint, noise loud with many crossings, speech in between."""
    r, rows = np.random.default_rng(seed), []
    level = {"silence": (0.0, 0.1, 0.2), "noise": (9.0, 9.0, 0.9), "speech": (4.0, 3.0, 0.4)}
    for label, n in parts:
        m, e, z = level[label]
        for _ in range(n):
            rows.append((rec, len(rows), label, (np.array([m, -m, 1.0]) + r.normal(0, 0.6, 3)).tolist(), e + abs(r.normal(0, 0.02)), z + r.normal(0, 0.02)))
    return rows


SCHEMA = "rec_id int, seq int, label string, feats array<double>, energy double, zcr double"


def test_activity_by_class_models(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    labelled = spark.createDataFrame(track([("silence", 150), ("speech", 150), ("noise", 150)] * 2, 1, 0), SCHEMA)
    few = {"noise": 2, "silence": 1, "speech": 2}
    boot = di.bootstrap_hmm(labelled, components=few)
    assert {(b.label, b.n) for b in boot.groupBy("label").agg(F.count("*").alias("n")).collect()} == set(few.items())
    parts = [("silence", 120), ("speech", 140), ("noise", 60), ("silence", 80), ("speech", 100), ("noise", 50)]
    frames = spark.createDataFrame(track(parts, 2, 1), SCHEMA)
    for rule, want in (("smaller", "guess = label"), ("larger", "label = 'noise' OR guess = label")):
        got = di.vad_hmm(frames.drop("label"), boot, components=few, rounds=(1, 1, 1), drop_noise=rule)
        both = got.withColumnRenamed("label", "guess").join(frames, ["rec_id", "seq"])
        assert both.count() == 550 and both.where(want).count() > 530
        assert (both.where("guess = 'noise'").count() > 0) == (rule == "smaller")
    calm = di.confident_background(frames, 0.5).groupBy("label").count().collect()
    assert {c.label for c in calm} == {"silence", "noise"}
    assert di.vad_hmm(frames.limit(0).drop("label"), boot, components=few, rounds=(0, 1, 1)).count() == 0


def plain_quantile(x, p):
    if not len(x):
        return np.nan  # nothing is over it or under it
    x, at = np.sort(x), np.clip((len(x) + 1) * p, 1, len(x))
    lo = int(np.floor(at))
    return x[lo - 1] + (x[min(lo, len(x) - 1)] - x[lo - 1]) * (at - lo)


def plain_confident(labels, energy, zcr, level, size, hop):
    """(label, frame) of chosen windows, with repeats, from arrays of one recording."""
    w = (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(size) / size)) ** 2
    cuts = []
    for c in ("silence", "noise"):
        at = np.flatnonzero(labels == c)
        cuts += [(c, at[i : i + size]) for i in range(0, len(at) - size + 1, hop)]
    if not any(c == "silence" for c, _ in cuts):
        return []
    e, z = np.array([w @ energy[a] for _, a in cuts]), np.array([zcr[a].mean() for _, a in cuts])
    quiet = np.array([c == "silence" for c, _ in cuts])

    def bounds(x):
        a, b = plain_quantile(x, 0.25), plain_quantile(x, 0.75)
        return b + 1.5 * (b - a), b + 3 * (b - a)

    if level is None:
        mild, far = bounds(e[e <= plain_quantile(e, 0.25)])
        calm, loud = e < mild, (e > far) & (e >= plain_quantile(e[e >= plain_quantile(e, 0.75)], 0.5))
    else:
        mild, far = bounds(e[quiet])
        calm, loud = quiet & (e <= mild), ~quiet | (e > far)
        loud &= (e >= far) & (e >= plain_quantile(e[loud], level))
    loud &= z >= bounds(z[calm])[0]
    return sorted(("silence", int(i)) for j in np.flatnonzero(calm) for i in cuts[j][1]) + sorted(("noise", int(i)) for j in np.flatnonzero(loud) for i in cuts[j][1])


def test_confident_windows_against_a_plain_rule(spark):
    r = np.random.default_rng(8)
    rows, want = [], {}
    for rec, n in ((0, 1500), (1, 700), (2, 40)):
        labels = np.repeat(r.choice(["silence", "noise", "speech"], n // 20, p=[0.5, 0.25, 0.25]), 20)
        hard = r.random(n // 20).repeat(20) < 0.15  # stretches called by the wrong name
        loud = np.where(hard, labels == "silence", labels == "noise")
        energy, zcr = np.where(loud, 4.0, 0.2) * r.gamma(8, 1 / 8, n), np.where(loud, 0.6, 0.2) + r.normal(0, 0.05, n)
        rows += [(rec, 7 * i, str(labels[i]), [float(i)], float(energy[i]), float(zcr[i])) for i in range(n)]
        for level in (None, 0.5):
            want[rec, level] = sorted(plain_confident(labels, energy, zcr, level, 10, 5))
    frames = spark.createDataFrame(rows, SCHEMA).repartition(6)
    for level in (None, 0.5):
        got = di.confident_background(frames, level, 10).collect()
        for rec in range(3):
            assert sorted((g.label, g.seq // 7) for g in got if g.rec_id == rec) == want[rec, level], (rec, level)
        assert {g.label for g in got} == {"silence", "noise"}


def test_windows_and_numbers_of_components(spark):
    df = spark.createDataFrame([(r, 3 * i, "ab"[i % 2]) for r in (1, 2) for i in range(50 * r)], "rec_id int, seq int, label string").repartition(7)
    for size in (1, 4, 10, 1000):
        got = di.numbered(df, ["rec_id", "label"], size=size).collect()
        assert all(g._i == g.seq // 6 and g._n == 25 * g.rec_id for g in got) and len(got) == 150
    own = di.class_windows(df.where("rec_id = 1 AND label = 'a'"), 10, 4).collect()
    assert sorted((g._w, g._at, g.seq // 6) for g in own) == [(w, k, 4 * w + k) for w in range(4) for k in range(10)]
    r = np.random.default_rng(5)
    feats = spark.createDataFrame([(rec, "x", r.normal(0, 1, 2).tolist()) for rec, n in ((1, 1), (2, 9), (3, 28), (4, 400)) for _ in range(n)], "rec_id int, label string, feats array<double>")
    got = di.own_models(feats, "feats", {"x": 6}, 0, by_rows=True).groupBy("rec_id").count().collect()
    assert {g.rec_id: g["count"] for g in got} == {2: 2, 3: 4, 4: 6}  # 28 rows of 2 places: 3.5, rounded up
    assert di.grown(["speech", "noise", "silence"], 1) == {"speech": 6, "silence": 3, "noise": 6} and di.grown(["speech", "silence"], 9) == {"speech": 10, "silence": 10}


def test_speakers_are_assigned_anew_and_merged(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    r = np.random.default_rng(6)
    who = np.repeat([0, 1, 0, 1], 80)
    start = np.repeat([0, 1, 2, 1], 80)  # the first speaker under two labels
    start[75:85] = 1 - start[75:85]  # and borders that are off
    pts = np.where(who[:, None] == 0, [0.0, 0.0], [6.0, 3.0]) + r.normal(0, 0.8, (320, 2))
    frames = spark.createDataFrame(pd.DataFrame({"rec_id": 1, "seq": range(320), "label": start, "v": pts.tolist()}))
    out = di.diarise(frames, 1, least=20, rounds=4)
    runs = win.label_runs(out).orderBy("begin").collect()
    assert [(q.begin, q.end) for q in runs] == [(0, 79), (80, 159), (160, 239), (240, 319)]
    assert runs[0].label == runs[2].label != runs[1].label == runs[3].label
