"""The zero-phase low-pass over many short recordings and few long ones: short ones share calls, and each comes out as if it were alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import chunks
from tidemark.operators import signal as sg

SECTIONS = sg.butterworth3(20.0, 100.0)


def alone(x):
    """One recording, sample by sample."""
    pad = min(12, len(x) - 1)
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad else x
    for _ in range(2):
        for b, a in SECTIONS:
            px, py, out = [y[0]] * 2, [y[0]] * 2, []
            for v in y:
                w = b[0] * v + sum(b[j + 1] * px[j] - a[j + 1] * py[j] for j in range(len(b) - 1))
                px, py = [v, px[0]], [w, py[0]]
                out.append(w)
            y = np.array(out)
        y = y[::-1]
    return y[pad : pad + len(x)]


def table(spark, xs, first=0, key="int"):
    rows = [(k, first + j, None if v is None else float(v)) for k, x in xs.items() for j, v in enumerate(x)]
    return spark.createDataFrame(rows, f"rec_id {key}, seq int, x double").repartition(5)


def by_recording(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.rec_id, {})[r.seq] = r.x
    return {k: [v[q] for q in sorted(v)] for k, v in out.items()}, {k: sorted(v) for k, v in out.items()}


def test_only_long_recordings_go_by_chunks(spark, monkeypatch):
    r = np.random.default_rng(0)
    xs = {None: r.normal(size=30)} | {i: r.normal(size=n) for i, n in enumerate([1, 2, 12, 13, 14, 70, *r.integers(1, 90, 40)])} | {100: r.normal(size=333)}
    taken, scan = [], chunks.linear_scan

    def watched(df, *args, **kwargs):
        taken.append({q.rec_id for q in df.select("rec_id").distinct().collect()})
        return scan(df, *args, **kwargs)

    monkeypatch.setattr(chunks, "linear_scan", watched)
    got, seqs = by_recording(sg.lowpass_zero_phase(table(spark, xs), 100.0, size=100))
    assert taken == [{100}, {100}]  # there and back; before, every recording
    assert got.keys() == xs.keys()
    for k, x in xs.items():
        assert seqs[k] == list(range(len(x))) and np.allclose(got[k], alone(x), atol=1e-10), k


@pytest.mark.parametrize("size", (50, 1 << 16))
def test_a_recording_without_a_key_is_kept(spark, size):
    xs = {None: np.random.default_rng(1).normal(size=140), "a": [4.0], "b": [1.0, 2.0]}
    got, seqs = by_recording(sg.lowpass_zero_phase(table(spark, xs, 7, "string"), 100.0, size=size))
    assert all(np.allclose(got[k], alone(np.asarray(x)), atol=1e-10) and seqs[k] == list(range(7, 7 + len(x))) for k, x in xs.items()) and got.keys() == xs.keys()


def test_calls_hold_whole_chunks(spark, monkeypatch):
    """Chunks over several batches, and several chunks in one, reach run whole and once; short ones together."""
    monkeypatch.setattr(chunks, "TOGETHER", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        n = [1, 3, 7, 14, 15, 100, 2, 6, 8, 21] + [1] * 60
        ran = spark.sparkContext.accumulator(0)

        def totals(x, starts):
            ran.add(1)
            return np.repeat(np.add.reduceat(x, starts), np.diff(np.append(starts, len(x))))

        rows = chunks.chunked(table(spark, {i: np.arange(k) for i, k in enumerate(n)}), 20)
        got = {(q.rec_id, q.chunk): (q.n, q.a, q.b) for q in chunks.by_many(rows, totals).groupBy("rec_id", "chunk").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect()}
        want = {(i, c): np.arange(20 * c, min(k, 20 * c + 20)) for i, k in enumerate(n) for c in range(-(-k // 20))}
        assert got == {k: (len(v), float(v.sum()), float(v.sum())) for k, v in want.items()}
        assert ran.value < len(n) / 2
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_missing_sample_spoils_its_own_recording_only(spark):
    x = np.random.default_rng(2).normal(size=40)
    xs = {0: x, 1: [*x[:20], None, *x[21:]], 2: [*x[:30], np.inf, *x[31:]], 3: x[:39]}
    got, _ = by_recording(sg.lowpass_zero_phase(table(spark, xs), 100.0))
    assert got[1] == got[2] == [None] * 40 and np.allclose(got[0], alone(x), atol=1e-10) and np.allclose(got[3], alone(x[:39]), atol=1e-10)
    assert sg.lowpass_zero_phase(table(spark, {}), 100.0).count() == 0


def test_neighbours_do_not_change_a_recording():
    """To the last bit: what shares a call with a recording, and where it stands, makes no difference."""
    r = np.random.default_rng(3)
    system = chunks.in_series(*(sg.section(b, a) for b, a in SECTIONS))
    xs = [r.normal(size=n) for n in (1, 2, 13, 40, 41, 90, 1024, 1025, 3000, *r.integers(1, 300, 50))]

    def run(parts):
        starts = np.concatenate([[0], np.cumsum([len(x) for x in parts])[:-1]])
        return np.split(sg.zero_phase(np.concatenate(parts), starts, SECTIONS, system), starts[1:])

    single = [run([x])[0] for x in xs]
    assert all(np.array_equal(a, b) for a, b in zip(single, run(xs), strict=True))
    assert all(np.array_equal(a, b) for a, b in zip(single[::-1], run(xs[::-1]), strict=True))
    assert all(np.allclose(a, alone(x), atol=1e-10) for a, x in zip(single, xs, strict=True))
