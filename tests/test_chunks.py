"""Operators over recordings in chunks give what one pass over the whole recording gives, whatever the chunks' size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import audio, chunks, windows
from tidemark.operators import signal as sg
from tidemark.operators.noise import MinimumStatistics

SIZES = (37, 100, 1 << 16)


def recordings(spark, *xs, first=0, **more):
    parts = [pd.DataFrame({"rec_id": i, "seq": np.arange(len(x)) + first, "x": np.asarray(x, float), **{k: v[: len(x)] for k, v in more.items()}}) for i, x in enumerate(xs)]
    return spark.createDataFrame(pd.concat(parts)).repartition(3)


def values(df, col="x", rec=0):
    return np.array([r[col] for r in df.where(F.col("rec_id") == rec).orderBy("seq").collect()])


def noise(n, seed=0):
    return np.random.default_rng(seed).normal(size=n)


@pytest.mark.parametrize("size", SIZES)
def test_linear_recursions(spark, size):
    xs = [noise(333), noise(5, 1), noise(100, 2)]
    df = recordings(spark, *xs, first=11)
    got = windows.ema(df, 0.9, size=size)
    for i, x in enumerate(xs):
        y, want = 0.0, []
        for v in x:
            y = 0.9 * y + 0.1 * v
            want.append(y)
        assert np.allclose(values(got, "ema", i), want, atol=1e-12)
    assert sorted(r.seq for r in got.where("rec_id = 1").collect()) == list(range(11, 16))
    # back and forth, by sections one after the other
    sections = sg.butterworth3(20.0, 100.0)

    def plain(x):
        pad = min(12, len(x) - 1)
        y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad else x
        for _ in range(2):
            for b, a in sections:
                px, py, out = [y[0]] * 2, [y[0]] * 2, []  # at rest on the first sample: these sections keep constants
                for v in y:
                    w = b[0] * v + sum(b[j + 1] * px[j] - a[j + 1] * py[j] for j in range(len(b) - 1))
                    px, py = [v, px[0]], [w, py[0]]
                    out.append(w)
                y = np.array(out)
            y = y[::-1]
        return y[pad : pad + len(x)]

    got = sg.lowpass_zero_phase(recordings(spark, *xs, [3.0]), 100.0, size=size)
    for i, x in enumerate([*xs, np.array([3.0])]):
        assert np.allclose(values(got, "x", i), plain(x), atol=1e-10), i


def test_blocks_of_a_linear_recursion():
    system = chunks.in_series(chunks.Linear([[0.5, 0.2], [-0.3, 0.7]], [1.0, 0.5], [1.0, 2.0], 0.3), chunks.Linear([[0.9]], [0.1], [1.0]))
    u = noise(300)
    one, two, s, want = np.zeros(2), np.zeros(1), np.ones(3), []
    one, two = s[:2], s[2:]
    for v in u:
        one = np.array([[0.5, 0.2], [-0.3, 0.7]]) @ one + np.array([1.0, 0.5]) * v
        y = one @ [1.0, 2.0] + 0.3 * v
        two = 0.9 * two + 0.1 * y
        want.append(two[0])
    y, end = system.run(u, s)
    assert np.allclose(y, want) and np.allclose(end, [*one, *two])
    assert np.allclose(system.run(np.full(3000, 2.0), np.zeros(3))[1], system.steady(2.0))


@pytest.mark.parametrize("size", (70, 200))
def test_interpolation_and_trends(spark, size):
    x = np.cumsum(noise(500))
    t = np.cumsum(np.random.default_rng(1).uniform(0.5, 1.5, 500)) / 100
    df = recordings(spark, x, x[:3], t=t)
    for how, run in ((sg.spline, sg.resample_spline), (sg.makima, sg.resample_makima)):
        got = run(df, 40.0, size=size)
        for i, n in ((0, 500), (1, 3)):
            at = t[0] + np.arange(int(np.floor((t[n - 1] - t[0]) * 40.0 + 1e-9)) + 1) / 40.0
            assert np.allclose(values(got, "t", i), at) and np.allclose(values(got, "x", i), how(t[:n], x[:n], at), atol=1e-9)
            assert sorted(r.seq for r in got.where(F.col("rec_id") == i).collect()) == list(range(len(at)))
    slow = sg.resample_spline(df, 1000.0, only_above=True, size=size)
    assert np.allclose(values(slow), x) and np.allclose(values(slow, "t"), t)
    got = sg.detrend_priors(df, 4.0, size=size)
    assert np.allclose(values(got, "trend"), sg.smooth_trend(x, 4.0), atol=1e-9) and np.allclose(values(got), x - sg.smooth_trend(x, 4.0), atol=1e-9)


def repaired(x, width, mode, sign):
    """The rule sample by sample over the whole recording."""
    x, n, fixed = x.copy(), len(x), []
    for j in range(1, n + 1):
        half = (width + 1) / 2
        lo, hi = (1, 2) if j == 1 else (1, 2 * j - 1) if j < half else (n - 1, n) if j == n else (2 * j - n, n) if j > n - half + 1 else (j - (width - 1) // 2, j + -(-(width - 1) // 2))
        a = np.sort(x[max(lo, 1) - 1 : min(hi, n)])
        m = len(a)
        p, q = (m + 1) // 4, 3 * (m + 1) // 4
        q1 = a[0] if p == 0 else a[p - 1] if (m + 1) % 4 == 0 else (a[p - 1] + a[p]) / 2
        q3 = a[q - 1] if 3 * (m + 1) % 4 == 0 else a[1] if q >= m else (a[q - 1] + a[q]) / 2
        if x[j - 1] < q1 - 3 * (q3 - q1) or x[j - 1] > q3 + 3 * (q3 - q1):
            if mode == "neighbours":
                x[j - 1] = np.mean([x[i] for i in (j - 2, j) if 0 <= i < n])
            elif j > 1:
                before = x[max(lo, 1) - 1 : j - 1]
                x[j - 1] = before.mean() + sign[j - 1] * (before.std(ddof=1) if len(before) > 1 else 0.0)
            else:
                continue
            fixed.append(j - 1)
    return x, fixed


@pytest.mark.parametrize("size", (20, 1 << 16))
def test_repair_and_groups(spark, size):
    r = np.random.default_rng(5)
    x = r.normal(size=200)
    x[r.choice(200, 25, replace=False)] += 40  # some next to each other and at edges of chunks
    df = recordings(spark, x, x[:2], x[50:51])
    sign = {(q.rec_id, q.seq): q.s for q in df.select("rec_id", "seq", (F.crc32(F.concat_ws("|", "rec_id", "seq", F.lit(0))) % 2 * -2 + 1).alias("s")).collect()}
    for mode in ("neighbours", "earlier"):
        got = sg.outlier_repair(df, 16, mode=mode, size=size)
        want, fixed = repaired(x, 16, mode, [sign[0, i] for i in range(200)])
        assert np.allclose(values(got), want) and [q.seq for q in got.where("repaired AND rec_id = 0").orderBy("seq").collect()] == fixed and len(fixed) > 10
        assert got.count() == 203
    on = np.sort(r.choice(400, 120, replace=False))
    flags = recordings(spark, np.zeros(400)).withColumn("event", F.col("seq").isin(on.tolist()))
    loc, want, a = (on[:-1] + 1).tolist(), [], 0
    while a < len(loc):
        own = [v for v in loc[a:] if v <= loc[a] + 11]
        lo, hi = own[0] - 1, own[-1] + 1
        lo, hi = (own[0], own[-1]) if hi - lo > 6 else (int(np.floor(own[0] - (6 - own[-1] + own[0]) / 2)), min(400, int(np.ceil(own[-1] + (6 - own[-1] + own[0]) / 2))))
        want += [(lo - 1, hi - 1)] if lo > 0 else []
        a += len(own)
    got = sorted((q.begin, q.end) for q in sg.group_events(flags, 11, 6, size=size).collect())
    assert got == sorted(want)


@pytest.mark.parametrize("size", (12, 97, 1 << 16))
def test_stays_decode_alike(spark, size):
    r = np.random.default_rng(6)
    cases = []
    for n, k, lens in ((300, 3, [10, 25, 7]), (211, 2, [12, 12]), (5, 3, [10, 25, 7]), (9, 3, [10, 25, 7]), (1, 2, [12, 12])):
        truth = np.repeat(r.integers(0, k, n // 20 + 1), 20)[:n]
        cases.append((lens, -2 * (truth[:, None] != np.arange(k)) + r.normal(0, 1.0, (n, k))))
    cases.append(([10, 25, 7], np.tile([0.0, -5.0, -5.0], (260, 1))))  # one stay over all chunks
    rows = [(i, j + 3, v.tolist(), [f"c{q}" for q in range(len(lens))], lens) for i, (lens, ll) in enumerate(cases) for j, v in enumerate(ll)]
    df = spark.createDataFrame(rows, "rec_id int, seq int, loglik array<double>, classes array<string>, lens array<int>").repartition(3)
    got = sg.viterbi_labels(df, size=size)
    for i, (lens, ll) in enumerate(cases):
        want = np.concatenate([[c] * (e - b + 1) for b, e, c in sg.viterbi_runs(ll, lens)])
        assert [q.label for q in got.where(F.col("rec_id") == i).orderBy("seq").collect()] == [f"c{c}" for c in want], (i, size)
    runs = sg.viterbi(df.where("rec_id IN (1, 4)"), 12, size=size)
    assert [(q.begin, q.end, q.label) for q in runs.where("rec_id = 1").orderBy("begin").collect()] == sg.viterbi_runs(cases[1][1], 12)
    assert sg.viterbi_labels(df.where("false")).count() == 0


@pytest.mark.parametrize("size", (15, 64))
def test_trackers_and_levels(spark, size):
    r = np.random.default_rng(7)
    power = np.exp(r.normal(size=(150, 5))) * (1 + 30 * ((np.arange(150) // 25) % 2 == 1))[:, None]
    v = r.normal(size=(150, 8)) * (1 + 5 * ((np.arange(150) // 25) % 2 == 1))[:, None]
    df = spark.createDataFrame([(0, i + 2, p.tolist(), w.tolist()) for i, (p, w) in enumerate(zip(power, v))], "rec_id int, seq int, power array<double>, v array<double>").repartition(3)
    assert np.allclose(values(sg.noise_mmse(df, size), "noise"), sg.noise_step(power, None)[0], rtol=1e-9)
    assert np.allclose(values(audio.noise_minstat(df, 0.016, size), "noise"), MinimumStatistics(0.016).run(power)[0], rtol=1e-9)
    whole = {}
    for kind in ("mmse", "amplitude", "perceptual", "specsub"):
        whole[kind] = np.stack(values(audio.enhance(df, kind, size=1 << 16), "v"))
        assert np.allclose(np.stack(values(audio.enhance(df, kind, size=size), "v")), whole[kind], rtol=1e-8, atol=1e-9)
    assert len({round(float(np.abs(w).sum()), 6) for w in whole.values()}) == 4
    p, q = (values(audio.vad(df, size=s), "p") for s in (size, 1 << 16))
    assert np.allclose(p, q, atol=1e-9)
    x = np.sin(np.arange(2000) / 5) * (1 + np.arange(2000) // 700)
    level, want = (audio.active_level(recordings(spark, x), 400.0, size=s).first() for s in (size * 9, 1 << 16))
    assert abs(level.level_db - want.level_db) < 1e-9 and abs(level.activity - want.activity) < 1e-9


@pytest.mark.parametrize("size", (100, 1 << 16))
def test_bands_of_wavelets(spark, size):
    x = np.cumsum(noise(2100))
    for levels in ((1, 2), (3,), (4, 5)):
        got = audio.swt_band(recordings(spark, x, x[:50], first=4), levels, size)
        assert np.allclose(values(got), audio.wavelet_band(x, levels), atol=1e-9)
        assert np.allclose(values(got, "x", 1), audio.wavelet_band(x[:50], levels), atol=1e-9)


def test_fixpoint_runs_again_only_what_changed(spark):
    """A chunk that forgets what entered it is run twice, whatever the number of chunks; and a recursion that never forgets is still right."""
    rows = chunks.chunked(recordings(spark, np.ones(400)), 50)
    total = chunks.recursion(rows, lambda pdf, s: (pd.DataFrame({"seq": pdf["seq"].to_numpy(), "y": (s or 0.0) + np.cumsum(pdf["x"].to_numpy())}), (s or 0.0) + pdf["x"].sum()), "seq bigint, y double")
    assert np.allclose(values(total, "y"), np.arange(1, 401))
    ran = spark.sparkContext.accumulator(0)

    def forgets(pdf, s):
        ran.add(1)
        return None, float(pdf["x"].iloc[-1])

    assert chunks.fixpoint(rows, forgets).count() == 8 and ran.value == 15
