import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import scales
from tidemark.operators import aggregates as ag
from tidemark.operators import intervals as iv
from tidemark.operators import signal as sg
from tidemark.operators import vectors as vec
from tidemark.operators import windows as win
from tidemark.plans import registry


def recording(spark, x, rec=1):
    return spark.createDataFrame(pd.DataFrame({"rec_id": rec, "seq": np.arange(len(x)), "x": np.asarray(x, float)}))


def test_bark_and_cent_come_back(spark):
    f = spark.range(1, 200).select((F.col("id") * 101.0 - 9000).alias("f"))
    for low in ("smooth", "linear", "none"):
        for high in ("smooth", "linear", "none"):
            if low != "smooth":
                f = f.where("abs(f) > 100")  # without that correction low frequencies have negative bark
            got = f.select("f", scales.bark_to_hz(scales.hz_to_bark(F.col("f"), low, high), low, high).alias("g")).collect()
            assert all(abs(r.f - r.g) < 1e-6 * max(1, abs(r.f)) for r in got), (low, high)
    assert all(abs(r.f - r.g) < 1e-6 for r in f.where("f > 20").select("f", scales.cent_to_hz(scales.hz_to_cent(F.col("f"))).alias("g")).collect())
    r = spark.range(1).select(scales.hz_to_bark(F.lit(0.0)).alias("zero"), scales.bark_to_hz(F.lit(99.0)).alias("none")).first()
    assert abs(r.zero) < 1e-12 and r.none is None


def test_peaks_keep_their_distance(spark):
    r = np.random.default_rng(3)
    x = r.integers(0, 9, 300)
    for width in (3.0, 8.0):
        peaks = [(p.at, p.height) for p in win.find_peaks(recording(spark, x)).orderBy("at").collect()]
        while True:
            j = [i for i in range(len(peaks) - 1) if peaks[i + 1][0] - peaks[i][0] <= width]
            if not j:
                break
            gone = {i + 1 if peaks[i][1] >= peaks[i + 1][1] else i for i in j}
            peaks = [p for i, p in enumerate(peaks) if i not in gone]
        assert [(p.at, p.height) for p in win.find_peaks(recording(spark, x), width=width).orderBy("at").collect()] == peaks
    assert win.find_peaks(recording(spark, x).limit(0), width=2.0).count() == 0


def test_repair_by_earlier_samples(spark):
    x = np.sin(np.arange(60.0))
    x[30] = 90
    got = sg.outlier_repair(recording(spark, x), mode="earlier", seed=4).orderBy("seq").collect()
    before = np.array([g.x for g in got][23:30])
    side = (got[30].x - before.mean()) / before.std(ddof=1)
    assert got[30].repaired and abs(abs(side) - 1) < 1e-9 and sum(g.repaired for g in got) == 1
    again = sg.outlier_repair(recording(spark, x).repartition(3), mode="earlier", seed=4).orderBy("seq").collect()
    assert [g.x for g in again] == [g.x for g in got]


def test_frames_with_zeros(spark):
    got = ag.frames(recording(spark, range(11)), 4, 4, "zero").orderBy("frame", "k").collect()
    assert [(g.frame, g.k, g.x) for g in got] == [(i // 4, i % 4, float(i if i < 11 else 0)) for i in range(12)]
    assert ag.frames(recording(spark, range(3)), 4, 4).count() == 0 and ag.frames(recording(spark, range(3)), 4, 4, "reflect").count() == 4


def test_bernoulli(spark):
    p = [0.0, 0.25, 1.0, None]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double").orderBy("i").select(ag.bernoulli_entropy(F.col("p"))).collect()]
    assert got[0] == got[2] == 0 and abs(got[1] - 0.811278) < 1e-6 and got[3] is None


def test_snr_by_active_frames_and_moved_ones(spark):
    t = np.arange(402.0)
    clean, late = np.sin(t / 5), np.sin((t - 0.4) / 5)
    sig, ref = recording(spark, late), recording(spark, clean)
    fixed, moved = ag.snr_seg(sig, ref, 50).first(), ag.snr_seg(sig, ref, 50, shifted=True).first()
    errors = []
    for f in range(8):
        i = np.arange(f * 50, f * 50 + 50) + 1
        d, best = late[i] - clean[i], np.inf
        for o in (late[i] - late[i + 1], late[i] - late[i - 1]):
            m = min(max(d @ o / (o @ o), 0), 1)
            best = min(best, ((d - m * o) ** 2).sum())
        errors.append(10 * np.log10((clean[i] ** 2).sum() / best))
    assert abs(moved.seg_snr - np.mean(errors)) < 1e-6 and moved.seg_snr > fixed.seg_snr + 10
    on = ref.where("seq BETWEEN 100 AND 149 OR seq BETWEEN 200 AND 225")
    some = ag.snr_seg(sig, ref, 50, active=on.select("rec_id", "seq")).first()
    each = [10 * np.log10((clean[a : a + 50] ** 2).sum() / ((clean - late)[a : a + 50] ** 2).sum()) for a in (100, 200)]
    assert abs(some.seg_snr - np.mean(each)) < 1e-6


def test_lag_of_most_energy(spark):
    r = np.random.default_rng(2)
    ref = r.normal(size=80)
    sig = np.concatenate([np.zeros(5), -ref])
    got = iv.best_lag(recording(spark, sig), recording(spark, ref), 0, 9, "energy").first()
    assert got.lag == 5 and abs(got.gain + 1) < 1e-9


def test_weighted_distances(spark):
    x = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0])], "id int, v array<double>")
    c = spark.createDataFrame([(7, [0.0, 0.0])], "center int, mean array<double>")
    got = {r.id: r.distance for r in vec.distances(x, c, "v", [4.0, 3.0], root=True).collect()}
    assert abs(got[1] - 4) < 1e-12 and got[2] == 0
    assert vec.row_distances(x, x.withColumn("v", F.array(F.lit(1.0), F.lit(0.0))), "id", "v", [1.0, 0.5]).orderBy("id").collect()[0].distance == 2


def test_alignment_in_chains_and_by_deviations(spark):
    r = np.random.default_rng(8)
    x = np.cumsum(r.uniform(0.2, 3, 60))
    y = np.sort(np.concatenate([x[::2] + r.normal(0, 0.2, 30), r.uniform(0, x[-1], 10)]))
    frames = [spark.createDataFrame(pd.DataFrame({"rec_id": 1, "t": a})) for a in (x, y)]
    got = sorted((p.x, p.y) for p in sg.align_markers(*frames, 0.7).collect())
    order = sorted([(t, 0) for t in x] + [(t, 1) for t in y])
    whole = sg.matched_markers([t for t, _ in order], [w for _, w in order], 0.7)  # without chains
    assert got == sorted((order[a][0], order[b][0]) for a, b in whole) and got
    moved = frames[1].withColumn("t", F.col("t") + 0.3)
    near = sg.align_markers(frames[0], moved, 1.0, deviations=2.0).collect()
    assert near and abs(np.median([p.y - p.x for p in near]) - 0.3) < 0.15


def test_dense_peaks_by_stretches(spark):
    """Thinned in stretches of any length, and in any number of rounds a pass, peaks are those of rounds over the whole recording."""
    r = np.random.default_rng(12)
    rows, want = [], set()
    for rec, at, h in ((1, np.cumsum(r.choice([1.0, 2.0, 3.5], 300)), r.integers(0, 6, 300)), (2, np.arange(120.0), np.arange(120)), (3, np.array([4.0]), np.array([1])), (4, np.arange(-40.0, 40.0), np.abs(np.arange(-40, 40)) % 7)):
        rows += [(rec, float(a), float(b)) for a, b in zip(at, h, strict=True)]
        left = [(float(a), float(b)) for a, b in zip(at, h, strict=True)]
        while True:
            near = [i for i in range(len(left) - 1) if left[i + 1][0] - left[i][0] <= 3.0]
            if not near:
                break
            gone = {i + 1 if left[i][1] >= left[i + 1][1] else i for i in near}
            left = [p for i, p in enumerate(left) if i not in gone]
        want |= {(rec, *p) for p in left}
    peaks = spark.createDataFrame(rows, "rec_id int, at double, height double").repartition(5)
    for stretch, rounds in ((None, 16), (10.0, 16), (25.0, 1), (7.0, 2)):
        got = [tuple(p) for p in win.apart_peaks(peaks, 3.0, stretch=stretch, at_once=rounds).collect()]
        assert len(got) == len(want) and set(got) == want


def test_query_of_peaks_apart(spark):
    """The query's rows, held against rounds over each whole recording."""
    sf, want = "/root/testdata/sf0.001", []
    for rec, g in registry.samples(spark, sf).toPandas().groupby("rec_id"):
        x = g.sort_values("seq")["x"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], np.diff(x) != 0]))
        ends = np.append(starts[1:], len(x)) - 1
        left = []
        for j in range(1, len(starts) - 1):
            p, v, q = (x[starts[k]] for k in (j - 1, j, j + 1))
            if p < v > q:
                shift = (q - p) / (2 * (2 * v - p - q)) if starts[j] == ends[j] else 0.0
                left.append(((starts[j] + ends[j]) / 2 + shift, v + (q - p) * shift / 4))
        while True:
            near = [i for i in range(len(left) - 1) if left[i + 1][0] - left[i][0] <= 5.0]
            if not near:
                break
            gone = {i + 1 if left[i][1] >= left[i + 1][1] else i for i in near}
            left = [p for i, p in enumerate(left) if i not in gone]
        want += [(rec, *p) for p in left]
    got = sorted((p.rec_id, p.at, p.height) for p in registry.QUERIES["find_peaks_apart"](spark, sf).collect())
    assert len(got) == len(want) > 50 and np.allclose(got, sorted(want))
