"""Steps of signals that are recursions or transforms: a chunk's (or frame's) rows go through a small numpy helper inside a Spark plan. Recordings of any length
are cut into chunks (chunks.py), so that one recording runs in as many tasks as it has chunks; results don't depend on the chunks' size."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import chunks
from tidemark.operators.chunks import CHUNK
from tidemark.operators.windows import SEQ, label_runs
from tidemark.sources.scratch import cut

#: Samples by which a filter's ends are reflected, and the longest recording that is filtered side by side with others.
ENDS, STEPS = 12, 1024


def tridiagonal(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Solves lower a, main b, upper c for d."""
    b, d = b.astype(float).copy(), d.astype(float).copy()
    for i in range(1, len(b)):
        w = a[i - 1] / b[i - 1]
        b[i] -= w * c[i - 1]
        d[i] -= w * d[i - 1]
    x = d
    x[-1] /= b[-1]
    for i in range(len(b) - 2, -1, -1):
        x[i] = (x[i] - c[i] * x[i + 1]) / b[i]
    return x


def spline(t: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline through (t, y), third derivatives continuous at the second and last but one points."""
    n = len(t)
    if n < 4:
        return np.polyval(np.polyfit(t - t[0], y, n - 1), at - t[0])
    h, s = np.diff(t), np.diff(y) / np.diff(t)
    a, b, c = h[1:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:-1].copy()
    r = 6 * np.diff(s)
    b[0], b[-1] = b[0] + h[0] + h[0] ** 2 / h[1], b[-1] + h[-1] + h[-1] ** 2 / h[-2]
    c[0], a[-1] = c[0] - h[0] ** 2 / h[1], a[-1] - h[-1] ** 2 / h[-2]
    m = np.zeros(n)
    m[1:-1] = tridiagonal(a, b, c, r)
    m[0] = m[1] + (m[1] - m[2]) * h[0] / h[1]
    m[-1] = m[-2] + (m[-2] - m[-3]) * h[-1] / h[-2]
    k = np.clip(np.searchsorted(t, at, "right") - 1, 0, n - 2)
    u, v, w = at - t[k], t[k + 1] - at, h[k]
    return (m[k] * v**3 + m[k + 1] * u**3) / (6 * w) + (y[k] / w - m[k] * w / 6) * v + (y[k + 1] / w - m[k + 1] * w / 6) * u


def makima(t: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Piecewise cubic with modified Akima slopes."""
    if len(t) < 3:
        return np.interp(at, t, y)
    d = np.diff(y) / np.diff(t)
    d = np.concatenate([[3 * d[0] - 2 * d[1], 2 * d[0] - d[1]], d, [2 * d[-1] - d[-2], 3 * d[-1] - 2 * d[-2]]])
    left = np.abs(d[3:] - d[2:-1]) + np.abs(d[3:] + d[2:-1]) / 2
    right = np.abs(d[1:-2] - d[:-3]) + np.abs(d[1:-2] + d[:-3]) / 2
    total = left + right
    s = np.where(total > 0, (left * d[1:-2] + right * d[2:-1]) / np.where(total > 0, total, 1), 0.0)
    k = np.clip(np.searchsorted(t, at, "right") - 1, 0, len(t) - 2)
    h = t[k + 1] - t[k]
    u = (at - t[k]) / h
    return (1 + 2 * u) * (1 - u) ** 2 * y[k] + u * (1 - u) ** 2 * h * s[k] + u**2 * (3 - 2 * u) * y[k + 1] + u**2 * (u - 1) * h * s[k + 1]


def _resampled(df: DataFrame, fs: float, how, halo: int, only_above: bool, size: int) -> DataFrame:
    ends = chunks.extent(df, F.min_by("t", "seq").alias("_t0"), F.max_by("t", "seq").alias("_t1"))
    rows = chunks.with_halo(df.select("rec_id", "seq", F.col("t").cast("double").alias("t"), F.col("x").cast("double").alias("x")), size, halo, halo).join(ends, "rec_id")

    def run(pdf):
        own, (first, n, t0, t1) = pdf["own"].to_numpy(), pdf.iloc[0][["_first", "_n", "_t0", "_t1"]]
        t, x = pdf["t"].to_numpy(), pdf["x"].to_numpy()
        if n < 2 or only_above and (n - 1) / (t1 - t0) <= fs:
            return pd.DataFrame({"seq": pdf["seq"].to_numpy()[own] - int(first), "t": t[own], "x": x[own]})
        last = int(np.flatnonzero(own)[-1])
        a, b = t[own][0], t[last + 1] if last + 1 < len(t) else np.inf  # the chunk answers for times from its first row to the next chunk's
        k = np.arange(max(0, int(np.floor((a - t0) * fs)) - 1), int(min(np.floor((t1 - t0) * fs + 1e-9), np.ceil((min(b, t1) - t0) * fs) + 1)) + 1)
        at = t0 + k / fs
        keep = (at >= a) & (at < b)
        return pd.DataFrame({"seq": k[keep], "t": at[keep], "x": how(t, x, at[keep])})

    return chunks.per_chunk(rows, run, "seq bigint, t double, x double")


def resample_spline(df: DataFrame, fs: float, only_above: bool = False, size: int = CHUNK) -> DataFrame:
    """Samples (t, x) on a regular grid of rate fs; only_above leaves recordings that aren't faster as they are. A sample's part in the spline at least halves
    from one sample to the next, so that 64 neighbours on each side give a chunk its spline to the last bit."""
    return _resampled(df, fs, spline, 64, only_above, size)


def resample_makima(df: DataFrame, fs: float, size: int = CHUNK) -> DataFrame:
    """The same by modified Akima slopes, which see three neighbours."""
    return _resampled(df, fs, makima, 4, False, size)


def butterworth3(cut: float, fs: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sections (b, a) of a third-order Butterworth low-pass, by the bilinear transform."""
    k = np.tan(np.pi * cut / fs)
    one = (np.array([k, k]) / (k + 1), np.array([1, (k - 1) / (k + 1)]))
    n = 1 + k + k * k
    return [one, (np.array([k * k, 2 * k * k, k * k]) / n, np.array([1, 2 * (k * k - 1) / n, (1 - k + k * k) / n]))]


def section(b: np.ndarray, a: np.ndarray) -> chunks.Linear:
    """A recursive filter of up to two steps back, as a recursion of the filtered input's last values."""
    n = len(a)
    step = np.zeros((n, n))
    step[0, : n - 1] = -a[1:]
    step[1:, :-1] += np.eye(n - 1)
    return chunks.Linear(step, np.eye(n)[0], b)


def _at_rest(y: np.ndarray, sections) -> np.ndarray:
    """Sections one after the other down the columns of y, each at rest on a column's first value."""
    for b, a in sections:
        w = [y[0] / a.sum()] * (len(a) - 1)
        out = np.empty_like(y)
        for j, v in enumerate(y):
            for c, p in zip(a[1:], w, strict=True):
                v = v - c * p
            out[j] = b[0] * v
            for c, p in zip(b[1:], w, strict=True):
                out[j] += c * p
            w = [v, *w[:-1]]
        y = out
    return y


def zero_phase(x: np.ndarray, starts: np.ndarray, sections, system: chunks.Linear) -> np.ndarray:
    """Recordings, one after another in x, filtered forwards and backwards over ends reflected about themselves by ENDS samples (by all but one, of shorter recordings).
    Those of up to STEPS samples stand side by side, by likeness of length; a longer one is taken in blocks. Either depends on the recording alone."""
    n = np.diff(np.append(starts, len(x)))
    pad = np.minimum(ENDS, n - 1)
    total, out = n + 2 * pad, np.empty(len(x))
    for i in np.flatnonzero(n > STEPS):
        v, p = x[starts[i] : starts[i] + n[i]], pad[i]
        y = np.concatenate([2 * v[0] - v[p:0:-1], v, 2 * v[-1] - v[-2 : -p - 2 : -1]])
        for _ in range(2):
            y = system.run(y, system.steady(y[0]))[0][::-1]
        out[starts[i] : starts[i] + n[i]] = y[p : p + n[i]]
    like = np.where(n > STEPS, 0, np.ceil(np.log2(total)).astype(int) + 1)
    for k in np.unique(like[like > 0]):
        who = like == k
        at, m, p, whole = starts[who], n[who], pad[who], total[who]
        row, col = np.arange(whole.max())[:, None], np.arange(len(at))
        q = np.minimum(row, whole - 1) - p
        v = x[at + np.where(q < 0, -q, np.where(q >= m, 2 * (m - 1) - q, q))]
        y = np.where(q < 0, 2 * x[at] - v, np.where(q >= m, 2 * x[at + m - 1] - v, v))
        turned = np.maximum(whole - 1 - row, 0)
        y = _at_rest(_at_rest(y, sections)[turned, col], sections)[turned, col]
        own = (q >= 0) & (q < m) & (row < whole)
        out[(at + q)[own]] = y[own]
    return out


def lowpass_zero_phase(df: DataFrame, fs: float, cut_hz: float = 20.0, size: int = CHUNK) -> DataFrame:
    """Third-order Butterworth, forwards and backwards, over ends reflected about themselves by 12 samples (by all but one, of shorter recordings). df is read once: each chunk is
    filtered as if it were a recording, many to a call. Where a recording has other chunks, it is read again and its chunks' maps are composed."""
    sections = butterworth3(cut_hz, fs)
    system = chunks.in_series(*(section(b, a) for b, a in sections))
    rows = df.select("rec_id", F.col("seq").cast("bigint").alias("seq"), F.col("x").cast("double").alias("x"))
    found = cut(chunks.by_many(chunks.chunked(rows, size), lambda x, starts: zero_phase(x, starts, sections, system)), "filtered")
    several = cut(found.groupBy(F.col("rec_id").alias("_rec")).agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a < b").select("_rec"), "recordings-of-chunks")
    if several.isEmpty():
        return found.select("rec_id", "seq", "x")
    same = F.col("rec_id").eqNullSafe(F.col("_rec"))
    long = cut(rows.join(several, same, "left_semi"), "long-recordings")
    return found.join(several, same, "left_anti").select("rec_id", "seq", "x").unionByName(_lowpass_by_chunks(long, system, size))


def _lowpass_by_chunks(d: DataFrame, system: chunks.Linear, size: int) -> DataFrame:
    ends = chunks.extent(d, F.min_by("x", "seq").alias("_x0"), F.max_by("x", "seq").alias("_x1")).withColumnRenamed("rec_id", "_rec")
    same = F.col("rec_id").eqNullSafe(F.col("_rec"))
    p = d.join(ends, same).withColumns({"_p": F.col("seq") - F.col("_first"), "_pad": F.least(F.lit(ENDS), F.col("_n") - 1)})
    before = p.where("_p BETWEEN 1 AND _pad").select("rec_id", (F.col("_first") - F.col("_p")).alias("seq"), (2 * F.col("_x0") - F.col("x")).alias("x"))
    after = p.where("_p BETWEEN _n - 1 - _pad AND _n - 2").select("rec_id", (F.col("_first") + 2 * (F.col("_n") - 1) - F.col("_p")).alias("seq"), (2 * F.col("_x1") - F.col("x")).alias("x"))
    forwards = cut(chunks.linear_scan(d.unionByName(before).unionByName(after), system, "x", "x", size, steady=True), "filtered")
    both = chunks.linear_scan(forwards, system, "x", "x", size, steady=True, backwards=True)
    return both.join(ends, same).where("seq BETWEEN _first AND _first + _n - 1").select("rec_id", "seq", "x")


def smooth_trend(z: np.ndarray, lam: float) -> np.ndarray:
    """Solves (I + lam^2 D'D) x = z with second differences D: five diagonals, elimination in one pass."""
    n = len(z)
    if n < 3:
        return z.astype(float)
    k = lam * lam
    main, one, two = np.ones(n), np.zeros(n), np.zeros(n)
    for c in range(n - 2):
        main[c : c + 3] += k * np.array([1, 4, 1])
        one[c : c + 2] += k * np.array([-2, -2])
        two[c] += k
    d, e, f, y = main.copy(), one.copy(), two.copy(), z.astype(float).copy()
    for i in range(n):  # symmetric elimination
        if i >= 1:
            w = e[i - 1] / d[i - 1]
            d[i] -= w * e[i - 1]
            if i < n - 1:
                e[i] -= w * f[i - 1]
            y[i] -= w * y[i - 1]
        if i >= 2:
            w = f[i - 2] / d[i - 2]
            d[i] -= w * f[i - 2]
            y[i] -= w * y[i - 2]
    for i in range(n - 1, -1, -1):
        y[i] = (y[i] - (e[i] * y[i + 1] if i < n - 1 else 0) - (f[i] * y[i + 2] if i < n - 2 else 0)) / d[i]
    return y


def detrend_priors(df: DataFrame, lam: float = 500.0, size: int = CHUNK) -> DataFrame:
    """x less its smoothness-priors trend, and the trend. A sample's part in the trend dies out as exp(-k / sqrt(2 lam)), so neighbours up to 60 sqrt(lam) give a chunk its own."""
    halo = int(60 * lam**0.5) + 60

    def run(pdf):
        own, x = pdf["own"].to_numpy(), pdf["x"].to_numpy(float)
        trend = smooth_trend(x, lam)
        return pd.DataFrame({"seq": pdf["seq"].to_numpy()[own], "x": (x - trend)[own], "trend": trend[own]})

    return chunks.per_chunk(chunks.with_halo(df.select("rec_id", "seq", "x"), max(size, halo), halo, halo), run, "seq bigint, x double, trend double")


def burg(x: np.ndarray, order: int) -> tuple[np.ndarray, float]:
    """Coefficients (from 1) and error power of an autoregressive fit."""
    f, b, a, e = x[1:].astype(float), x[:-1].astype(float), np.ones(1), float(np.mean(x**2))
    for _ in range(order):
        down = f @ f + b @ b
        k = -2 * (f @ b) / down if down > 0 else 0.0
        a = np.concatenate([a, [0]]) + k * np.concatenate([a, [0]])[::-1]
        f, b = (f + k * b)[1:], (b + k * f)[:-1]
        e *= 1 - k * k
    return a, e


def burg_psd(frames: DataFrame, v: str, order: int = 16, nfft: int = 2048, fs: float = 4.0) -> DataFrame:
    """All columns but v, exploded to (f, p): one-sided autoregressive spectrum of each row's array."""

    @F.pandas_udf("array<double>")
    def spectrum(s: pd.Series) -> pd.Series:
        out = []
        for x in s:
            if len(x) <= order:
                out.append(None)
                continue
            a, e = burg(np.asarray(x, float), order)
            p = e / fs / np.abs(np.fft.rfft(a, nfft)) ** 2
            p[1:-1] *= 2
            out.append(p)
        return pd.Series(out)

    rest = [c for c in frames.columns if c != v]
    return frames.select(*rest, F.posexplode(spectrum(v)).alias("k", "p")).select(*rest, (F.col("k") * fs / nfft).alias("f"), "p")


def power_spectrum(v: Column | str) -> Column:
    """Power of each bin of an array's Fourier transform, batched."""

    @F.pandas_udf("array<double>")
    def spectrum(s: pd.Series) -> pd.Series:
        return s.map(lambda x: np.abs(np.fft.rfft(np.asarray(x, float))) ** 2)

    return spectrum(v)


def mel_bank(n_bands: int, n_fft: int, fs: float, lo: float = 0.0, hi: float = 0.5) -> np.ndarray:
    """Triangular filters [band, bin], evenly spaced in mel between fractions lo and hi of the rate."""
    mel = lambda f: 1127.01048 * np.log1p(f / 700)
    edge = np.linspace(mel(lo * fs), mel(hi * fs), n_bands + 2)
    at = mel(np.arange(n_fft // 2 + 1) * fs / n_fft)
    return np.maximum(0, np.minimum((at - edge[:-2, None]) / np.diff(edge)[:-1, None], (edge[2:, None] - at) / np.diff(edge)[1:, None]))


def mfcc(v: Column | str, fs: float, n: int = 12) -> Column:
    """n cepstral coefficients (from the first) of each frame, Hamming-weighted; one matrix product per batch of equal lengths."""

    @F.pandas_udf("array<double>")
    def cepstra(s: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        sizes = s.map(len)
        for size in sizes.unique():
            some = s[sizes == size]
            x = np.stack(some.to_numpy()).astype(float)
            bands = int(3 * np.log(fs))
            power = np.abs(np.fft.rfft(x * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(size) / size)), axis=1)) ** 2
            logs = np.log(np.maximum(power @ mel_bank(bands, size, fs).T, 1e-12))
            dct = np.sqrt(2 / bands) * np.cos(np.pi * np.arange(1, n + 1)[:, None] * (np.arange(bands) + 0.5) / bands)
            out[some.index] = list(logs @ dct.T)
        return out

    return cepstra(v)


def vad_features(frames: DataFrame, fs: float, n: int = 12) -> DataFrame:
    """(rec_id, seq, feats) of frames (rec_id, seq, v ARRAY): n cepstral coefficients and the zero-crossing rate, their slopes over nine frames, and the slopes of
    those over three, as one array (39 values for n = 12). A recording's ends are repeated. A frame of one sample crosses nothing."""
    crossed = F.expr("aggregate(sequence(1, size(v) - 1, 1), 0D, (s, i) -> s + if(signum(v[i]) != signum(v[i - 1]), 1D, 0D)) / (size(v) - 1)")
    base = frames.select("rec_id", "seq", F.concat(mfcc("v", fs, n), F.array(F.when(F.size("v") > 1, crossed).otherwise(0.0))).alias("_f"))
    each = SEQ()
    whole = each.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def slope(c: str, width: int) -> Column:
        first, last = F.first(c).over(whole), F.last(c).over(whole)
        out = None
        for k in range(1, width + 1):
            d = F.zip_with(F.coalesce(F.lead(c, k).over(each), last), F.coalesce(F.lag(c, k).over(each), first), lambda a, b: (a - b) * k)  # noqa: B023 (called at once)
            out = d if out is None else F.zip_with(out, d, lambda a, b: a + b)
        total = 2.0 * sum(k * k for k in range(1, width + 1))
        return F.transform(out, lambda a: a / total)

    d = base.withColumn("_d", slope("_f", 4)).withColumn("_dd", slope("_d", 1))
    return d.select("rec_id", "seq", F.concat("_f", "_d", "_dd").alias("feats"))


def outlier_repair(df: DataFrame, width: int = 16, k: float = 3.0, mode: str = "neighbours", seed: int = 0, size: int = CHUNK) -> DataFrame:
    """Samples with outliers of their window replaced, from left to right, repaired ones counting in later windows: by the mean of their neighbours (mode "neighbours"),
    or by the mean of the earlier samples of their window plus or minus their deviation, the sign drawn by a seeded checksum (mode "earlier"; a recording's first
    sample stays)."""
    sign = F.when(F.crc32(F.concat_ws("|", "rec_id", "seq", F.lit(seed))) % 2 == 0, 1.0).otherwise(-1.0)

    def bounds(j: int, n: int) -> tuple[int, int]:
        half = (width + 1) / 2
        if j == 1:
            return 1, 2
        if j < half:
            return 1, 2 * j - 1
        if j == n:
            return n - 1, n
        if j > n - half + 1:
            return 2 * j - n, n
        return j - (width - 1) // 2, j + -(-(width - 1) // 2)

    def quartiles(a: np.ndarray) -> tuple[float, float]:
        n = len(a)
        p, q = (n + 1) // 4, 3 * (n + 1) // 4
        q1 = a[0] if p == 0 else a[p - 1] if (n + 1) % 4 == 0 else (a[p - 1] + a[p]) / 2
        q3 = a[q - 1] if 3 * (n + 1) % 4 == 0 else a[1] if q >= n else (a[q - 1] + a[q]) / 2
        return q1, q3

    def run(pdf, state):
        """state: the last samples before the chunk, repaired; places j count from 1 in the recording."""
        own, seq, x = pdf["own"].to_numpy(), pdf["seq"].to_numpy(), pdf["x"].to_numpy(float)
        at = int(np.flatnonzero(own)[0])
        before = x[:at] if state is None else state
        n, j0 = int(pdf["_n"].iloc[0]), int(seq[at] - pdf["_first"].iloc[0]) + 1
        y = np.concatenate([before, x[at:]])
        shift = len(before) - j0 + 1  # place j is y[j - 1 + shift]
        count, side = int(own.sum()), pdf["_sign"].to_numpy()[own]
        fixed = np.zeros(count, bool)
        for i in range(count) if n > 1 else ():
            j = j0 + i
            lo, hi = bounds(j, n)
            lo, hi, here = max(lo, 1) - 1 + shift, min(hi, n) + shift, j - 1 + shift
            q1, q3 = quartiles(np.sort(y[lo:hi]))
            if y[here] < q1 - k * (q3 - q1) or y[here] > q3 + k * (q3 - q1):
                if mode == "neighbours":
                    near = [y[here + d] for d in (-1, 1) if 1 <= j + d <= n]
                    y[here], fixed[i] = sum(near) / len(near), True
                elif j > 1:
                    earlier = y[lo:here]
                    y[here], fixed[i] = earlier.mean() + side[i] * (earlier.std(ddof=1) if len(earlier) > 1 else 0.0), True
        mine = y[len(before) : len(before) + count]
        return pd.DataFrame({"seq": seq[own], "x": mine, "repaired": fixed}), np.concatenate([before, mine])[-width - 1 :]

    rows = df.select("rec_id", "seq", F.col("x").cast("double").alias("x")).withColumn("_sign", sign)
    rows = chunks.with_halo(rows, max(size, width + 1), width + 1, width + 1).join(chunks.extent(df), "rec_id")
    return chunks.recursion(rows, run, "seq bigint, x double, repaired boolean")


def group_events(df: DataFrame, width: float, inner: float, size: int = CHUNK) -> DataFrame:
    """(rec_id, begin, end) of groups of events (rows whose event is true): a group takes the events up to width after its first; groups shorter than inner are widened on both sides. A
    recording's last event begins and closes no group."""
    events = df.where("event").select("rec_id", F.col("seq").cast("bigint").alias("seq"))
    last = events.groupBy("rec_id").agg(F.max("seq").alias("_last"))
    rows = df.groupBy("rec_id").agg(F.count("*").alias("_n")).join(last, "rec_id")
    most = max(size, int(width) + 1)
    events = chunks.with_halo(events.join(rows, "rec_id").where("seq < _last"), most, 0, int(width) + 1)

    def run(pdf, state):
        """state: up to where events still belong to the last group that began before the chunk."""
        own, loc, n, out, a = pdf["own"].to_numpy(), pdf["seq"].to_numpy() + 1, int(pdf["_n"].iloc[0]), [], 0
        if state is not None:
            a = int(np.searchsorted(loc, state, "right"))
        mine = int(own.sum())
        reach = state
        while a < mine:
            reach = loc[a] + width
            b = int(np.searchsorted(loc, reach, "right"))
            lo, hi = int(loc[a]) - 1, int(loc[b - 1]) + 1
            if hi - lo <= inner:
                more = (inner - (loc[b - 1] - loc[a])) / 2
                lo, hi = int(np.floor(loc[a] - more)), min(n, int(np.ceil(loc[b - 1] + more)))
            else:
                lo, hi = int(loc[a]), int(loc[b - 1])
            if lo > 0:
                out.append((lo - 1, hi - 1))
            a = b
        over = reach if reach is not None and reach > (int(pdf.loc[own, "chunk"].iloc[0]) + 1) * most else None
        return pd.DataFrame(out, columns=["begin", "end"], dtype="int64"), over

    return chunks.recursion(events, run, "begin bigint, end bigint")


def matched_markers(t: list[float], which: list[int], most: float) -> list[tuple[int, int]]:
    """Places (x, y) of the pairs of neighbours that gain most^2 less their squared distance in sum; t in order, which 0 for x and 1 for y."""
    n = len(t)
    gain, pair = [0.0] * (n + 1), [False] * (n + 1)
    for i in range(2, n + 1):
        gain[i] = gain[i - 1]
        new = gain[i - 2] + most * most - (t[i - 1] - t[i - 2]) ** 2
        if which[i - 1] != which[i - 2] and new >= gain[i]:
            gain[i], pair[i] = new, True
    out, i = [], n
    while i > 1:
        if pair[i]:
            out.append((i - 1, i - 2) if which[i - 1] == 0 else (i - 2, i - 1))
        i -= 2 if pair[i] else 1
    return out[::-1]


def align_markers(x: DataFrame, y: DataFrame, most: float, deviations: float | None = None) -> DataFrame:
    """(rec_id, x, y): one-to-one pairs of neighbours in the merged order of two time lists (rec_id, t) that gain most^2 - (x - y)^2 in sum. Markers further apart than
    most never pair, so a recording is cut into chains there. With deviations, most is only the first threshold: as long as pairs get fewer, x is moved by
    the mean difference and the threshold is so many standard deviations of the last pairs' differences; a recording's markers then fit in a task."""
    both = x.select("rec_id", "t", F.lit(0).alias("which")).unionByName(y.select("rec_id", "t", F.lit(1).alias("which"))).where("t IS NOT NULL")
    kind = x.schema["rec_id"].dataType.simpleString()
    keys = ["rec_id"]
    if deviations is None:
        w = Window.partitionBy("rec_id").orderBy("t", "which")
        far = F.coalesce((F.col("t") - F.lag("t").over(w) > most).cast("int"), F.lit(1))
        both = both.withColumn("_far", far).withColumn("_chain", F.sum("_far").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        keys.append("_chain")

    def group(pdf):
        def pairs(shift, limit):
            p = pdf.assign(m=pdf["t"] + np.where(pdf["which"] == 0, shift, 0.0)).sort_values(["m", "which"])
            t = p["t"].tolist()
            return [(t[a], t[b]) for a, b in matched_markers(p["m"].tolist(), p["which"].tolist(), limit)]

        got, before = pairs(0.0, most), None
        while deviations is not None and got and (before is None or len(got) < before):
            d = np.array([b - a for a, b in got])
            before, got = len(got), pairs(d.mean(), deviations * d.std())
        return pd.DataFrame({"rec_id": pdf["rec_id"].iloc[0], "x": [a for a, _ in got], "y": [b for _, b in got]})

    return both.groupBy(*keys).applyInPandas(group, f"rec_id {kind}, x double, y double")


def marker_stats(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("rec_id").agg(F.count("*").alias("n"), F.avg(F.col("y") - F.col("x")).alias("mean"), F.stddev_pop(F.col("y") - F.col("x")).alias("std"))


def build_hmm(n_classes: int, min_len: int | list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Start and transition probabilities of chains of min_len sub-states (one length, or one a class); a chain's end goes to itself or to any chain's start."""
    lens = np.broadcast_to(np.asarray(min_len), n_classes)
    tails = np.cumsum(lens) - 1
    heads = tails - lens + 1
    n = int(lens.sum())
    start, trans = np.zeros(n), np.zeros((n, n))
    start[heads] = 1 / n_classes
    for h, t in zip(heads, tails, strict=True):
        for s in range(h, t):
            trans[s, s + 1] = 1
        trans[t, heads] = 1 / (n_classes + 1)
        trans[t, t] = 1 / (n_classes + 1)
    return start, trans


def viterbi_runs(loglik: np.ndarray, min_len: int | list[int]) -> list[tuple[int, int, int]]:
    """(begin, end, class) of the likeliest sequence where each stay has min_len frames (one length, or one a class) or more; only chain ends branch, so the work is
    classes x frames. With fewer frames than any class needs, the class of the largest sum."""
    n, k = loglik.shape
    lens = np.broadcast_to(np.asarray(min_len), k)
    total = np.concatenate([np.zeros((1, k)), np.cumsum(loglik, axis=0)])
    step = -np.log(k + 1)
    end, came, begin = np.full((n + 1, k), -np.inf), np.zeros((n + 1, k), int), np.zeros((n + 1, k), int)
    top, best = np.full(n + 1, -np.inf), np.zeros(n + 1, int)
    classes = np.arange(k)
    for t in range(1, n + 1):
        at = np.maximum(t - lens, 0)
        enter = np.where(at > 0, top[at] + step, -np.log(k)) + total[t] - total[at, classes]
        enter = np.where(t >= lens, enter, -np.inf)
        stay = end[t - 1] + step + loglik[t - 1]
        new = enter > stay
        end[t] = np.where(new, enter, stay)
        begin[t] = np.where(new, at, begin[t - 1])
        came[t] = np.where(new, best[at], came[t - 1])
        best[t] = int(np.argmax(end[t]))
        top[t] = end[t, best[t]]
    if n < lens.min():
        return [(0, n - 1, int(np.argmax(total[-1])))] if n else []
    out, t, c = [], n, int(best[n])
    while t > 0:
        b = int(begin[t, c])
        if out and out[-1][2] == c:  # a chain's end may go to its own start: one stay
            out[-1] = (b, out[-1][1], c)
        else:
            out.append((b, t - 1, c))
        t, c = b, int(came[t, c])
    return out[::-1]


#: Steps of a log likelihood: sums of them are exact, so that equal sequences compare equal whatever the chunks.
LIKELIHOOD_STEP = 2.0**-30


class StayDecoder:
    """The likeliest sequence of viterbi_runs over a chunk of frames, from what the frames before it leave.

    What enters a chunk: the best sums that end in each class at its edge, and the best sum of any class (with that class) at each of the last frames, all less the best at the edge. Going
    forwards, each frame keeps for each class whether a stay just became long enough there. Going backwards, a chunk is left at its front in one of few ways: c, in the middle of a stay of
    class c, or k + d * k + c, where a stay of class c began d frames before the front. So a chunk is a map from ways at its end to ways at its front; of the second kind only d counts."""

    def __init__(self, lens: list[int]):
        self.lens, self.k, self.reach = np.asarray(lens), len(lens), int(max(lens))
        self.step = round(-np.log(self.k + 1) / LIKELIHOOD_STEP)
        self.start = round(-np.log(self.k) / LIKELIHOOD_STEP)

    NEVER = -(1 << 60)

    def forward(self, loglik: np.ndarray, at: int, frames: int, state: tuple | None) -> dict:
        """loglik: rows of the last frames before the chunk (reach of them, or all there are) and of the chunk; at: the place of the chunk's first frame in the recording."""
        ll = np.rint(np.clip(loglik, -1e6, 1e6) / LIKELIHOOD_STEP).astype(np.int64)
        before = len(ll) - frames
        total = np.concatenate([np.zeros((1, self.k), np.int64), np.cumsum(ll, axis=0)])  # of local frames up to i
        if state is None:  # the recording's start; elsewhere a guess: any class, long enough
            begun = at == 0
            end = np.full(self.k, self.NEVER if begun else 0, np.int64)
            tops, bests = np.full(self.reach, self.NEVER if begun else 0, np.int64), np.zeros(self.reach, np.int64)
            tops[-1] = self.start - self.step if begun else 0  # stays that begin with the recording
        else:
            end, tops, bests = state
        tops, bests = np.concatenate([tops, np.empty(frames, np.int64)]), np.concatenate([bests, np.zeros(frames, np.int64)])
        news, origin = np.zeros((frames, self.k), bool), np.arange(self.k)  # origin: the way at the front from each class's end
        origins = np.zeros(frames + 1, np.int64)
        classes = np.arange(self.k)
        for i in range(frames):
            t = at + i + 1
            ago = self.reach + i + 1 - self.lens  # in tops: the edge before the chunk is at reach
            enter = np.where(self.lens <= t, tops[np.maximum(ago - 1, 0)] + self.step, self.NEVER)
            lo = np.maximum(before + i + 1 - self.lens, 0)
            enter = np.where(enter > self.NEVER // 2, enter + total[before + i + 1] - total[lo, classes], self.NEVER)
            stay = np.where(end > self.NEVER // 2, end + self.step + ll[before + i], self.NEVER)
            news[i] = enter > stay
            end = np.where(news[i], enter, stay)
            local = i + 1 - self.lens  # frames of the chunk before the stay
            origin = np.where(news[i], np.where(local > 0, origins[np.maximum(local, 0)], self.k - np.minimum(local, 0) * self.k + classes), origin)
            best = int(np.argmax(end))
            bests[self.reach + i], origins[i + 1] = best, origin[best]
            top = end[best]
            if top > self.NEVER // 2:  # sums stay small
                end = np.where(end > self.NEVER // 2, end - top, self.NEVER)
                tops[: self.reach + i] = np.where(tops[: self.reach + i] > self.NEVER // 2, tops[: self.reach + i] - top, self.NEVER)
                top = 0
            tops[self.reach + i] = top
        ways = np.concatenate([origin, [origins[frames - d] if d < frames else self.k + (d - frames) * self.k for d in range(self.reach)]])
        return {"state": (end, tops[-self.reach :], bests[-self.reach :]), "news": news, "bests": bests, "ways": ways, "last": int(np.argmax(end))}

    def labels(self, f: dict, way: int) -> np.ndarray:
        """The classes of a chunk's frames, from the way at its end."""
        frames = len(f["news"])
        out, i, c = np.full(frames, (way - self.k) % self.k), frames, way
        if way >= self.k:
            i -= (way - self.k) // self.k
            c = int(f["bests"][self.reach + i - 1]) if i > 0 else -1
        while i > 0:
            here = np.flatnonzero(f["news"][:i, c])
            new = int(here[-1]) if len(here) else -1
            if new < 0:
                out[:i] = c
                break
            begin = max(0, new + 1 - int(self.lens[c]))
            out[begin:i] = c
            i = begin if new + 1 - int(self.lens[c]) > 0 else 0
            c = int(f["bests"][self.reach + i - 1]) if i > 0 else -1
        return out


def _decoded(df: DataFrame, lens_of, cols: list[str], size: int) -> DataFrame:
    """(rec_id, seq, _class): the class's number of each frame (rec_id, seq, loglik) on the likeliest sequence; lens_of(rows) gives the classes' least stays."""
    longest = df.agg(F.max(cols[0])).first()[0] if cols else max(lens_of(None))
    if longest is None:
        return df.select("rec_id", "seq", F.lit(0).alias("_class")).where("false")
    size = max(size, int(longest))
    rows = chunks.with_halo(df.select("rec_id", "seq", "loglik", *[c for c in df.columns if c == "_lens"]), size, int(longest), 0)
    rows = rows.join(chunks.extent(df), "rec_id")

    def forward(pdf, state):
        own = pdf["own"].to_numpy()
        d, loglik = StayDecoder(lens_of(pdf)), np.stack(pdf["loglik"].to_numpy()).astype(float)
        at, frames = int(pdf["seq"].to_numpy()[own][0] - pdf["_first"].iloc[0]), int(own.sum())
        keep = len(loglik) - frames - min(d.reach, len(loglik) - frames)
        return d, d.forward(loglik[keep:], at, frames, state)

    def run(pdf, state):
        return None, forward(pdf, state)[1]["state"]

    single = chunks.one_chunk_each(rows)
    states = chunks.fixpoint(rows, run, 0.0)

    def ways(pdf, state):
        _, f = forward(pdf, state)
        return pd.DataFrame({"chunk": [pdf.loc[pdf["own"], "chunk"].iloc[0]], "_ways": [f["ways"]], "_best": [f["last"]], "_k": [len(f["ways"]) - len(f["state"][1])]}), None

    def follow(pdf):
        pdf = pdf.sort_values("chunk", ascending=False)
        way, out, k = int(pdf["_best"].iloc[0]), [], int(pdf["_k"].iloc[0])
        for w in pdf["_ways"]:
            out.append(way)
            way = int(w[way if way < k else k + (way - k) // k])
        return pdf.assign(_way=out)[["rec_id", "chunk", "_way"]]

    maps = None if single else cut(chunks.from_states(rows, states, ways, "chunk bigint, _ways array<bigint>, _best bigint, _k bigint"), "chunk-ways")
    left = states.withColumn("_way", F.lit(-1)) if single else cut(maps.groupBy("rec_id").applyInPandas(follow, f"rec_id {chunks.key_type(df)}, chunk bigint, _way bigint").join(states, ["rec_id", "chunk"]), "chunk-ways")  # a row a chunk

    def label(pdf, own):
        pdf = pdf.sort_values("seq")
        if not len(pdf) or not len(own):
            return pd.DataFrame({"rec_id": [], "seq": [], "_class": []})
        mine, way = pdf["own"].to_numpy(), int(own["_way"].iloc[0])
        d, f = forward(pdf, pickle.loads(own["state"].iloc[0]))
        n = int(pdf["_n"].iloc[0])
        if n < d.lens.min():  # shorter than any stay: one chunk
            out = np.full(n, int(np.argmax(np.stack(pdf["loglik"].to_numpy()).astype(float).sum(axis=0))))
        else:
            out = d.labels(f, f["last"] if way < 0 else way)
        return pd.DataFrame({"rec_id": pdf["rec_id"][mine], "seq": pdf["seq"][mine], "_class": out})

    kind = df.schema["seq"].dataType.simpleString()
    return rows.groupBy("rec_id", "chunk").cogroup(left.groupBy("rec_id", "chunk")).applyInPandas(label, f"rec_id {chunks.key_type(df)}, seq {kind}, _class int")


def viterbi(df: DataFrame, min_len: int | list[int], size: int = CHUNK) -> DataFrame:
    """(rec_id, begin, end, label) from frames (rec_id, seq, loglik ARRAY<DOUBLE>), in places from 0: the sequence of viterbi_runs."""

    def lens(pdf):
        if pdf is None:
            return [min_len] if np.isscalar(min_len) else list(min_len)
        return [min_len] * len(pdf["loglik"].iloc[0]) if np.isscalar(min_len) else list(min_len)

    d = df.select("rec_id", "seq", "loglik")
    found = cut(_decoded(d, lens, [], size), "decoded").join(chunks.extent(d), "rec_id")
    return label_runs(found.select("rec_id", (F.col("seq") - F.col("_first")).cast("bigint").alias("seq"), F.col("_class").alias("label"))).select("rec_id", "begin", "end", "label")


def viterbi_labels(df: DataFrame, size: int = CHUNK) -> DataFrame:
    """(rec_id, seq, label) from frames (rec_id, seq, loglik ARRAY<DOUBLE>, classes ARRAY<STRING>, lens ARRAY<INT>): the class of each frame on the likeliest sequence,
    each stay as long as its class asks for. classes and lens are equal within a recording."""
    d = df.select("rec_id", "seq", "loglik", F.col("lens").alias("_lens"))
    found = _decoded(d, lambda pdf: list(pdf["_lens"].iloc[0]), [F.array_max("_lens")], size)
    names = df.groupBy("rec_id").agg(F.first("classes").alias("_names"))
    return found.join(names, "rec_id").select("rec_id", "seq", F.element_at("_names", F.col("_class") + 1).alias("label"))


#: Frames whose mean is the first noise estimate.
NOISE_START = 5


def noise_step(power: np.ndarray, state: dict | None, smooth: float = 0.8, presence: float = 0.9, xi_db: float = 15.0) -> tuple[np.ndarray, dict]:
    """Noise spectra of frames [frame, bin] by speech presence probabilities, and the state to go on from."""
    xi = 10 ** (xi_db / 10)
    ratio = 1 / (1 + xi) - 1
    noise = state["noise"] if state else power[:NOISE_START].mean(axis=0)
    mean = state["mean"] if state else np.full(power.shape[1], 0.5)
    out = np.empty_like(power)
    for i, y in enumerate(power):
        p = 1 / (1 + (1 + xi) * np.exp(np.maximum(ratio * y / np.maximum(noise, 1e-30), -50)))
        mean = presence * mean + (1 - presence) * p
        p = np.where(mean > 0.99, np.minimum(p, 0.99), p)
        noise = smooth * noise + (1 - smooth) * ((1 - p) * y + p * noise)
        out[i] = noise
    return out, {"noise": noise, "mean": mean}


def noise_mmse(spectra: DataFrame, size: int = CHUNK) -> DataFrame:
    """(rec_id, seq, noise ARRAY<DOUBLE>) from frames (rec_id, seq, power ARRAY<DOUBLE>)."""

    def run(pdf, state):
        out, state = noise_step(np.stack(pdf["power"].to_numpy()), state)
        return pd.DataFrame({"seq": pdf["seq"].to_numpy(), "noise": list(out)}), state

    return chunks.recursion(chunks.chunked(spectra.select("rec_id", "seq", "power"), max(size, NOISE_START)), run, "seq bigint, noise array<double>")
