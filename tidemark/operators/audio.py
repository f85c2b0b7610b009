"""Speech and heart-beat steps: enhancement, voice activity, pitch, formants, wavelet bands, R peaks. Frames (rec_id, seq, v or power) are
rows; recursions run over chunks of frames (chunks.py), everything that needs no order is a Column function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import aggregates as ag
from tidemark.operators import chunks, intervals, windows
from tidemark.operators.chunks import CHUNK
from tidemark.operators.noise import MinimumStatistics, estimator_gains, speech_odds, subtraction_gains
from tidemark.operators.signal import NOISE_START, group_events, noise_step, power_spectrum
from tidemark.sources.scratch import cut


def enhance(frames: DataFrame, kind: str = "mmse", inc: float = 0.016, tracker: str | None = None, size: int = CHUNK) -> DataFrame:
    """(rec_id, seq, v): frames (inc seconds apart) of a root-windowed signal with noise taken out; kind mmse: log-spectral estimator, amplitude and perceptual: estimators of the amplitude,
    plain and weighed by its inverse, specsub: magnitude subtraction. tracker mmse or minstat: how the noise is followed (by default minstat for specsub)."""
    by_least = (tracker or ("minstat" if kind == "specsub" else "mmse")) == "minstat"
    follow = MinimumStatistics(inc)

    def run(pdf, state):
        x = np.stack(pdf["v"].to_numpy()).astype(float)
        spec = np.fft.rfft(x, axis=1)
        power = np.abs(spec) ** 2
        noise, gain = state or (None, None)
        estimate, noise = follow.run(power, noise, int(pdf["seq"].iloc[0] - pdf["_first"].iloc[0])) if by_least else noise_step(power, noise)
        if kind == "specsub":
            g = subtraction_gains(power, estimate)
        else:
            g, gain = estimator_gains(power, estimate, gain, kind, inc)
        return pd.DataFrame({"seq": pdf["seq"].to_numpy(), "v": list(np.fft.irfft(spec * g, x.shape[1], axis=1))}), (noise, gain)

    rows = chunks.chunked(frames.select("rec_id", "seq", "v"), max(size, NOISE_START))
    rows = rows.join(chunks.extent(frames), "rec_id") if by_least else rows
    return chunks.recursion(rows, run, "seq bigint, v array<double>")


def noise_minstat(spectra: DataFrame, inc: float = 0.016, size: int = CHUNK) -> DataFrame:
    """(rec_id, seq, noise ARRAY<DOUBLE>) of frames (rec_id, seq, power ARRAY<DOUBLE>) inc seconds apart, by minimum statistics."""
    tracker = MinimumStatistics(inc)

    def run(pdf, state):
        out, state = tracker.run(np.stack(pdf["power"].to_numpy()), state, int(pdf["seq"].iloc[0] - pdf["_first"].iloc[0]))
        return pd.DataFrame({"seq": pdf["seq"].to_numpy(), "noise": list(out)}), state

    rows = chunks.chunked(spectra.select("rec_id", "seq", "power"), size).join(chunks.extent(spectra), "rec_id")
    return chunks.recursion(rows, run, "seq bigint, noise array<double>")


def speech_frames(audio: DataFrame, fs: float, inc: float = 0.01, overlap: int = 2, root: bool = False, tail: str | None = None) -> DataFrame:
    """(rec_id, seq, v) of samples (rec_id, seq from 0, x): frames of overlap * inc seconds, inc apart, times a Hamming window (or its root) scaled so that its squares at all frames over a sample
    sum to one."""
    hop = round(inc * fs)
    n = hop * overlap
    w = np.hamming(n + 1)[:-1] ** (0.5 if root else 1.0)
    w = w / np.sqrt((w[::hop] ** 2).sum())
    framed = ag.frames(audio.select("rec_id", "seq", "x"), n, hop, tail).groupBy("rec_id", F.col("frame").alias("seq")).agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("a"))
    return framed.select("rec_id", F.col("seq").cast("bigint").alias("seq"), F.zip_with("a.x", F.array(*map(F.lit, w.tolist())), lambda x, y: x * y).alias("v"))


def enhance_audio(audio: DataFrame, fs: float, kind: str = "mmse", inc: float = 0.016, tracker: str | None = None, size: int = CHUNK) -> DataFrame:
    """(rec_id, seq, x): samples (rec_id, seq from 0, x) with noise taken out: root-windowed frames (the last filled up by reflection), enhance(), the window again, and overlapping frames added."""
    hop = round(inc * fs)
    w = np.hamming(2 * hop + 1)[:-1] ** 0.5
    w = w / np.sqrt((w[::hop] ** 2).sum())
    clean = enhance(speech_frames(audio, fs, inc, 2, True, "reflect"), kind, inc, tracker, size)
    each = clean.select("rec_id", F.col("seq").alias("frame"), F.posexplode(F.zip_with("v", F.array(*map(F.lit, w.tolist())), lambda x, y: x * y)).alias("k", "v"))
    ends = audio.groupBy("rec_id").agg(F.max("seq").alias("_last"))
    return ag.overlap_add(each, hop).join(ends, "rec_id").where("seq <= _last").drop("_last")


def vad(frames: DataFrame, threshold: float = 0.7, inc: float = 0.01, size: int = CHUNK) -> DataFrame:
    """(rec_id, seq, p, label): label 1 where the speech probability is over the threshold, from frames' powers (inc seconds apart): likelihood ratios over minimum statistics, with
    a two-state chain that lets speech ring out."""
    tracker = MinimumStatistics(inc)

    def run(pdf, state):
        power, state = np.stack(pdf["power"].to_numpy()).astype(float), state or (None, None)
        noise, now = tracker.run(power, state[0], int(pdf["seq"].iloc[0] - pdf["_first"].iloc[0]))
        p, odds = speech_odds(power, noise, state[1], inc)
        return pd.DataFrame({"seq": pdf["seq"].to_numpy(), "p": p, "label": (p > threshold).astype(int)}), (now, odds)

    rows = chunks.chunked(frames.select("rec_id", "seq", "power"), size).join(chunks.extent(frames), "rec_id")
    return chunks.recursion(rows, run, "seq bigint, p double, label int")


def vad_sohn(audio: DataFrame, fs: float, threshold: float = 0.7, inc: float = 0.01) -> DataFrame:
    """vad() of samples (rec_id, seq from 0, x); frame f covers samples from f * inc * fs on."""
    powers = speech_frames(audio, fs, inc).select("rec_id", "seq", power_spectrum("v").alias("power"))
    return vad(powers, threshold, inc)


def detect_speech(frames: DataFrame, gap: int, inc: float = 0.01) -> DataFrame:
    """(rec_id, begin, end) in frames: runs of speech, joined where less than gap frames lie between."""
    runs = windows.label_runs(vad(frames, inc=inc)).where("label = 1")
    return intervals.coalesce_intervals(runs, gap)


def pitch(v: Column | str, fs: float, lo: float = 50.0, hi: float = 400.0) -> Column:
    """STRUCT<f0, harmonicity>: the lag of the largest normalised autocorrelation between 1 / hi and 1 / lo, and its height."""

    @F.pandas_udf("f0 double, harmonicity double")
    def track(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            x = np.asarray(x, float) - np.mean(x)
            n = len(x)
            r = np.fft.irfft(np.abs(np.fft.rfft(x, 2 * n)) ** 2)[:n]
            e = np.cumsum(x * x)
            lags = np.arange(max(1, int(fs / hi)), min(n - 1, int(fs / lo)) + 1)
            norm = np.sqrt(np.maximum(e[n - 1 - lags] * (e[-1] - e[lags - 1]), 1e-30))
            c = r[lags] / norm
            k = int(np.argmax(c >= 0.95 * c.max())) if len(c) else 0  # the shortest lag that is nearly the best
            while k + 1 < len(c) and c[k + 1] > c[k]:
                k += 1
            rows.append((fs / lags[k], float(c[k])) if len(c) else (None, None))
        return pd.DataFrame(rows, columns=["f0", "harmonicity"])

    return track(v)


def lpc(x: np.ndarray, order: int) -> np.ndarray:
    """Prediction polynomial by Levinson's recursion over the autocorrelation of the weighted frame."""
    x = x * np.hamming(len(x))
    r = np.correlate(x, x, "full")[len(x) - 1 : len(x) + order]
    a, e = np.array([1.0]), r[0] + 1e-12
    for i in range(1, order + 1):
        k = -(r[i] + a[1:] @ r[i - 1 : 0 : -1]) / e if i > 1 else -r[1] / e
        a = np.append(a, 0) + k * np.append(a, 0)[::-1]
        e *= 1 - k * k
    return a


def formants(v: Column | str, fs: float, order: int = 14, n: int = 5) -> Column:
    """The lowest n resonances (Hz) of each frame, from the roots of its prediction polynomial; short lists when there are fewer."""

    @F.pandas_udf("array<double>")
    def roots(s: pd.Series) -> pd.Series:
        out = []
        for x in s:
            z = np.roots(lpc(np.asarray(x, float), order))
            z = z[(np.imag(z) > 0) & (np.abs(z) > 0.7)]
            f = np.sort(np.angle(z) * fs / (2 * np.pi))
            out.append(f[f > 90][:n])
        return pd.Series(out)

    return roots(v)


#: Low-pass decomposition filter of the symlet with four vanishing moments.
SYM4 = np.array([-0.07576571478927333, -0.02963552764599851, 0.49761866763201545, 0.8037387518059161, 0.29785779560527736, -0.09921954357684722, -0.012603967262037833, 0.0322231006040427])


#: High-pass filter: the low-pass turned round, with every other sign changed.
SYM4_HIGH = SYM4[::-1] * np.where(np.arange(8) % 2 == 0, -1.0, 1.0)


def swt(x: np.ndarray, levels: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Details of levels 1, 2, ... and what is left, of an undecimated wavelet transform with circular ends: each level's filters have holes of twice the last one's."""
    details, rest = [], np.asarray(x, float)
    for level in range(levels):
        shifted = [np.roll(rest, i << level) for i in range(8)]
        details.append(sum(h * y for h, y in zip(SYM4_HIGH, shifted, strict=True)))
        rest = sum(h * y for h, y in zip(SYM4, shifted, strict=True))
    return details, rest


def iswt(details: list[np.ndarray], rest: np.ndarray) -> np.ndarray:
    """The signal of swt's parts: from the last level on, both parts through the turned filters, halved."""
    for level in reversed(range(len(details))):
        rest = sum((h * np.roll(rest, -(i << level)) + g * np.roll(details[level], -(i << level))) / 2 for i, (h, g) in enumerate(zip(SYM4, SYM4_HIGH, strict=True)))
    return rest


def wavelet_band(x: np.ndarray, levels: tuple[int, ...] = (4, 5)) -> np.ndarray:
    """The part of a signal in some detail levels of an undecimated wavelet transform, circular. Deeper levels than the last one kept have no part in it."""
    details, rest = swt(x, max(levels))
    return iswt([d if i + 1 in levels else np.zeros_like(d) for i, d in enumerate(details)], np.zeros_like(rest))


def swt_band(df: DataFrame, levels: tuple[int, ...] = (4, 5), size: int = CHUNK) -> DataFrame:
    """(rec_id, seq, x): wavelet_band along each recording. Filters up to level l see 7 (2^l - 1) samples on each side, twice; so many neighbours, round the
    recording's ends, give a chunk its own."""
    halo = 2 * 7 * ((1 << max(levels)) - 1)
    size = max(size, halo)
    kind = df.schema["seq"].dataType.simpleString()
    d = df.select("rec_id", F.col("seq").cast("bigint").alias("seq"), F.col("x").cast("double").alias("x")).join(chunks.extent(df), "rec_id").withColumn("seq", F.col("seq") - F.col("_first"))
    long = d.where(F.col("_n") > size)  # shorter recordings are a chunk, whose ends meet of themselves
    ends = long.where(F.col("seq") < halo).withColumn("seq", F.col("seq") + F.col("_n")).unionByName(long.where(F.col("seq") >= F.col("_n") - halo).withColumn("seq", F.col("seq") - F.col("_n")))
    rows = chunks.with_halo(d.unionByName(ends), size, halo, halo).withColumn("own", F.col("own") & F.col("seq").between(0, F.col("_n") - 1))

    def run(pdf):
        own = pdf["own"].to_numpy()
        return pd.DataFrame({"seq": (pdf["seq"] + pdf["_first"]).to_numpy()[own], "x": wavelet_band(pdf["x"].to_numpy(float), levels)[own]})

    return chunks.per_chunk(rows, run, f"seq {kind}, x double")


def detect_rpeaks(ecg: DataFrame, fs: float, lam: float = 0.2, size: int = CHUNK) -> DataFrame:
    """(rec_id, begin, end, at, height): beats of samples (rec_id, seq, x). Bands four and five, signed squares, an alternating dither, counts of
    sign changes against their own average give events; events become groups; each group's largest sample is a peak if it passes the amplitude gate."""
    e = windows.signed_power(swt_band(ecg, (4, 5), size), 2.0).select("rec_id", "seq", F.col("powered").alias("e"), (F.abs("powered") * 1.1412).alias("x"))
    e = cut(e, "wavelet")
    level = windows.ema(e, 1 - lam, size=size).withColumnRenamed("ema", "_level")
    whole = e.groupBy("rec_id").agg((F.sqrt(F.sum(F.col("e") * F.col("e"))) / F.count("*")).alias("_norm"), F.min("seq").alias("_first"))
    sign = F.when((F.col("seq") - F.col("_first")) % 2 == 0, 1.0).otherwise(-1.0)
    dithered = e.join(level, ["rec_id", "seq"]).join(whole, "rec_id").withColumn("_s", F.signum(F.col("e") + sign * (F.col("_level") + F.col("_norm"))))
    w = Window.partitionBy("rec_id", "chunk").orderBy("seq")
    turned = chunks.with_halo(dithered.select("rec_id", "seq", "_s"), size, 1, 0).withColumn("x", F.coalesce(F.abs(F.col("_s") - F.lag("_s").over(w)) / 2, F.lit(0.0))).where("own").select("rec_id", "seq", "x")
    count = cut(windows.ema(cut(turned, "turns"), 1 - lam, size=size), "counts")
    usual = windows.ema(count, 1 - lam, "ema", size=size).withColumnRenamed("ema", "_usual")
    events = count.join(usual, ["rec_id", "seq"]).select("rec_id", "seq", (F.col("ema") < F.col("_usual") - 1e-9).alias("event"))
    prepared = cut(e.select("rec_id", "seq", (F.col("e") * 1.1412).alias("x")).join(events, ["rec_id", "seq"]), "events")
    groups = group_events(prepared, 0.25 * fs, 0.05 * fs, size)
    return windows.amplitude_gate(intervals.peak_in_interval(prepared, groups), prepared)


def min_run(runs: DataFrame, least: dict, slack: int = 5) -> DataFrame:
    """(rec_id, begin, end, label): runs (rec_id, begin, end, label) shorter than their label's least length less slack join the run before, from left to right; a recording's first run stays.
    A run that is long enough has its own label whatever comes before, and the others that of the last such: no recursion is left."""
    w = Window.partitionBy("rec_id").orderBy("begin")
    short = F.coalesce(F.create_map(*(F.lit(v) for kv in least.items() for v in kv))[F.col("label")], F.lit(0)) - slack if least else F.lit(-slack)
    kept = F.when((F.col("end") - F.col("begin") + 1 >= short) | (F.row_number().over(w) == 1), F.struct("label"))
    own = runs.withColumn("_label", F.last(kept, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))["label"])
    new = (~F.col("_label").eqNullSafe(F.lag("_label").over(w)) | (F.row_number().over(w) == 1)).cast("int")
    own = own.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return own.groupBy("rec_id", "_run").agg(F.min("begin").cast("bigint").alias("begin"), F.max_by("end", "begin").cast("bigint").alias("end"), F.first("_label").alias("label")).drop("_run")


def active_level(samples: DataFrame, fs: float, margin: float = 15.9, size: int = CHUNK) -> DataFrame:
    """(rec_id, level_db, activity): active speech level and the share of active time. An envelope of two 30 ms smoothings is held for 200 ms; the
    level is where the mean power over samples above a threshold lies margin dB over that threshold, between thresholds 3 dB apart."""
    k = np.exp(-1 / (0.03 * fs))

    # two smoothings one after the other
    smooth = chunks.Linear([[k, 0.0], [(1 - k) * k, k]], [1 - k, (1 - k) ** 2], [0.0, 1.0])
    env = chunks.linear_scan(samples.select("rec_id", "seq", F.abs(F.col("x").cast("double")).alias("x")), smooth, "x", "env", size)
    hold = int(0.2 * fs)
    near = Window.partitionBy("rec_id", "chunk").orderBy("seq").rowsBetween(-hold, 0)
    held = chunks.with_halo(env, max(size, hold), hold, 0).withColumn("held", F.max("env").over(near)).where("own").join(samples.select("rec_id", "seq", "x"), ["rec_id", "seq"])
    top = held.groupBy("rec_id").agg(F.sum(F.col("x") * F.col("x")).alias("energy"), F.count("*").alias("n"))
    bins = held.where("held > 0").groupBy("rec_id", F.floor(20 * F.log10("held") / 3).alias("bin")).agg(F.count("*").alias("m"))
    w = Window.partitionBy("rec_id").orderBy(F.desc("bin"))
    c = bins.withColumn("above", F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, 0))).join(top, "rec_id")
    c = c.withColumns({"a": 10 * F.log10(F.expr("try_divide(energy, above)")), "t": F.col("bin") * 3.0}).withColumn("d", F.col("a") - F.col("t"))
    c = c.withColumns({"a2": F.lag("a").over(w), "d2": F.lag("d").over(w)}).where((F.col("d") >= margin) & (F.coalesce("d2", F.lit(-1e9)) < margin))
    at = F.when(F.col("d2").isNull(), F.lit(0.0)).otherwise((F.col("d") - margin) / (F.col("d") - F.col("d2")))
    level = F.col("a") + at * (F.coalesce("a2", "a") - F.col("a"))
    first = c.groupBy("rec_id").agg(F.max(F.struct("t", level.alias("l"), "energy", "n")).alias("r"))
    return first.select("rec_id", F.col("r.l").alias("level_db"), F.expr("r.energy / r.n / pow(10, r.l / 10)").alias("activity"))
