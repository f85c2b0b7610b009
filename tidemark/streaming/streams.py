"""Streams of samples. Windows and sums are Spark's; steps with a recursion keep their state per recording, so that the output over
micro-batches, put together, equals the batch operator's over the same rows in order.

A stream with a column ts (event time) is put in order first: rows wait in the state until the watermark has passed them and are taken by seq, so micro-batches may bring them late (up to
delay) and in any order. A recording that the watermark has passed by `expire` is over: what a step still holds back is given out, and its state is removed. A row that comes after that begins a
recording of its own. A stream without ts is taken as it comes, sorted within a micro-batch; its recordings never end."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.chunks import Linear
from tidemark.operators.noise import MinimumStatistics, estimator_gains, speech_odds
from tidemark.operators.signal import NOISE_START, noise_step


def stream_acc_features(stream: DataFrame, size: str = "500 milliseconds", slide: str = "250 milliseconds", delay: str = "10 seconds", cols: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Energy, mean magnitude and deviation over sliding windows of event time, summed over the axes, of samples whose gravity is out already; rows later than delay are not counted.
    stream_body_features has frames by count, weights and gravity."""
    each = [F.sum(F.col(c) * F.col(c)).alias(f"e_{c}") for c in cols] + [F.avg(F.abs(F.col(c))).alias(f"m_{c}") for c in cols] + [F.stddev_samp(c).alias(f"s_{c}") for c in cols]
    g = stream.withWatermark("ts", delay).groupBy("rec_id", F.window("ts", size, slide).alias("w")).agg(F.count("*").alias("n"), *each)
    add = lambda p: sum((F.col(f"{p}_{c}") for c in cols[1:]), F.col(f"{p}_{cols[0]}"))
    return g.select("rec_id", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n", (add("e") / F.col("n")).alias("body_energy_ave"), add("m").alias("body_abs_mean"), add("s").alias("body_std"))


def stream_chunks(stream: DataFrame, minutes: int = 5, delay: str = "10 minutes") -> DataFrame:
    """(rec_id, begin, n, first, last, samples ARRAY<STRUCT<seq, x>>): tumbling chunks per recording with their samples by seq, once the watermark has passed them (append mode). A chunk is a
    row, so its length bounds it."""
    g = stream.withWatermark("ts", delay).groupBy("rec_id", F.window("ts", f"{minutes} minutes").alias("w"))
    out = g.agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.sort_array(F.collect_list(F.struct("seq", "x"))).alias("samples"))
    return out.select("rec_id", F.col("w.start").alias("begin"), "n", "first", "last", "samples")


def _with_state(stream: DataFrame, cols: list[str], out: str, step, start: int = 1, delay: str = "10 seconds", expire: str = "10 minutes") -> DataFrame:
    """step(rows in order, state or None, whether the recording ends) -> (frame without rec_id, state); state is kept as bytes. A recording's first rows are held back in the
    state until there are so many as the step's start needs, whatever the micro-batches, or until it ends."""
    kind, timed = stream.schema["rec_id"].dataType.simpleString(), "ts" in stream.columns
    wait = pd.Timedelta(expire).value // 1_000_000  # ms

    def taken(rows, had, ends):
        """Output and state, None before the start."""
        if had is None and len(rows) < (1 if ends else start):
            return None, None
        return step(rows, had, ends)

    def in_order(key, batches, state: GroupState):
        held, had = pickle.loads(state.get[0]) if state.exists else (None, None)
        rows = pd.concat([x for x in (held, *batches) if x is not None and len(x)]).sort_values("seq")
        got, now = taken(rows, had, False)
        state.update((pickle.dumps((rows if now is None else None, now)),))
        if got is not None:
            got.insert(0, "rec_id", key[0])
            yield got

    def by_time(key, batches, state: GroupState):
        held, had, last = pickle.loads(state.get[0]) if state.exists else (None, None, None)  # held: rows that wait; last: the latest time seen
        mark = state.getCurrentWatermarkMs()
        new = [x for x in batches if len(x)] if not state.hasTimedOut else []
        rows = [x for x in (held, *new) if x is not None and len(x)]
        rows = pd.concat(rows).sort_values("seq") if rows else None
        ms = rows["ts"].astype("datetime64[ms]").astype("int64") if rows is not None else pd.Series([], dtype="int64")
        last = max([v for v in (last, ms.max() if len(ms) else None) if v is not None])
        ends = mark >= last + wait
        ready = ms <= mark
        go = rows[ready] if rows is not None else None
        got, now = None, had
        if ends or go is not None and len(go):
            empty = held.iloc[:0] if held is not None else rows.iloc[:0] if rows is not None else None
            got, now = taken(go if go is not None else empty, had, ends) if (go is not None and len(go)) or had is not None else (None, had)
        if ends:
            state.remove()
        else:
            kept = rows if now is None else rows[~ready] if rows is not None and not ready.all() else None
            state.update((pickle.dumps((kept, now, last)),))
            waiting = ms[~ready]
            state.setTimeoutTimestamp(int(max(mark + 1, waiting.max() if len(waiting) else last + wait)))
        if got is not None and len(got):
            got.insert(0, "rec_id", key[0])
            yield got

    fields = f"rec_id {kind}, {out}"
    if not timed:
        return stream.select("rec_id", "seq", *cols).groupBy("rec_id").applyInPandasWithState(in_order, fields, "state binary", "append", GroupStateTimeout.NoTimeout)
    rows = stream.withWatermark("ts", delay).select("rec_id", "seq", "ts", *cols)
    return rows.groupBy("rec_id").applyInPandasWithState(by_time, fields, "state binary", "append", GroupStateTimeout.EventTimeTimeout)


def stream_noise(stream: DataFrame, tracker: str = "mmse", inc: float = 0.016, **order) -> DataFrame:
    """Noise spectra of frames (rec_id, seq, power ARRAY<DOUBLE>), the tracker (mmse or minstat) going on from batch to batch."""
    least = MinimumStatistics(inc)

    def step(rows, state, ends):
        power = np.stack(rows["power"].to_numpy()) if len(rows) else np.empty((0, 0))
        if not len(rows):
            return None, state
        out, state = noise_step(power, state) if tracker == "mmse" else least.run(power, state)
        return pd.DataFrame({"seq": rows["seq"].to_numpy(), "noise": list(out)}), state

    return _with_state(stream, ["power"], "seq bigint, noise array<double>", step, NOISE_START if tracker == "mmse" else 1, **order)


def stream_running_max(stream: DataFrame, forget: float = 1.0, **order) -> DataFrame:
    """max over all samples so far of forget^age * x."""

    def step(rows, state, ends):
        top, out = state if state is not None else -np.inf, []
        for v in rows["x"].tolist():
            top = max(top * forget, v)
            out.append(top)
        return pd.DataFrame({"seq": rows["seq"].to_numpy(), "running_max": out}), top

    return _with_state(stream, ["x"], "seq bigint, running_max double", step, **order)


def stream_ema(stream: DataFrame, lam: float, **order) -> DataFrame:
    """y = lam y(-1) + (1 - lam) x, from zero."""
    system = Linear([[lam]], [1 - lam], [1.0])

    def step(rows, state, ends):
        y, state = system.run(rows["x"].to_numpy(float), np.zeros(1) if state is None else state)
        return pd.DataFrame({"seq": rows["seq"].to_numpy(), "ema": y}), state

    return _with_state(stream, ["x"], "seq bigint, ema double", step, **order)


def stream_active_level(stream: DataFrame, fs: float, margin: float = 15.9, **order) -> DataFrame:
    """(rec_id, seq, level_db, activity) after each micro-batch that has samples of a recording: active_level's result over all of its samples so far, the last at
    seq. The state is the envelope's two smoothings, its last 200 ms, and counts by 3 dB. No level yet, no row."""
    k, hold = np.exp(-1 / (0.03 * fs)), int(0.2 * fs)
    smooth = Linear([[k, 0.0], [(1 - k) * k, k]], [1 - k, (1 - k) ** 2], [0.0, 1.0])

    def step(rows, state, ends):
        pq, tail, bins, energy, n = state if state is not None else (np.zeros(2), np.empty(0), {}, 0.0, 0)
        if not len(rows):
            return None, state
        x = rows["x"].to_numpy(float)
        env, pq = smooth.run(np.abs(x), pq)
        env = np.concatenate([tail, env])
        held = pd.Series(env).rolling(hold + 1, min_periods=1).max().to_numpy()[len(tail) :]
        b, m = np.unique(np.floor(20 * np.log10(held[held > 0]) / 3), return_counts=True)
        for one, more in zip(b.tolist(), m.tolist(), strict=True):
            bins[one] = bins.get(one, 0) + more
        energy, n = energy + float(x @ x), n + len(x)
        out = []
        if bins and energy > 0:
            t = 3.0 * np.array(sorted(bins, reverse=True))
            a = 10 * np.log10(energy / np.cumsum([bins[v] for v in sorted(bins, reverse=True)]))
            over = np.flatnonzero(a - t >= margin)
            if len(over):
                i, d = over[0], a - t
                at = (d[i] - margin) / (d[i] - d[i - 1]) if i else 0.0
                level = a[i] + at * (a[i - 1] - a[i]) if i else a[i]
                out = [(int(rows["seq"].iloc[-1]), level, energy / n / 10 ** (level / 10))]
        return pd.DataFrame(out, columns=["seq", "level_db", "activity"]), (pq, env[-hold:] if hold else env[:0], bins, energy, n)

    return _with_state(stream, ["x"], "seq bigint, level_db double, activity double", step, **order)


def _enhanced(rows, state, inc: float) -> tuple[np.ndarray, tuple]:
    x = np.stack(rows["v"].to_numpy()).astype(float)
    spec = np.fft.rfft(x, axis=1)
    power = np.abs(spec) ** 2
    noise, tracker = noise_step(power, state[0] if state else None)
    gain, before = estimator_gains(power, noise, state[1] if state else None, "mmse", inc)
    return np.fft.irfft(spec * gain, x.shape[1], axis=1), (tracker, before)


def stream_enhance(stream: DataFrame, inc: float = 0.016, **order) -> DataFrame:
    """Frames (rec_id, seq, v) with noise taken out by the log-spectral estimator; noise and gains go on from batch to batch."""

    def step(rows, state, ends):
        if not len(rows):
            return None, state
        out, state = _enhanced(rows, state, inc)
        return pd.DataFrame({"seq": rows["seq"].to_numpy(), "v": list(out)}), state

    return _with_state(stream, ["v"], "seq bigint, v array<double>", step, NOISE_START, **order)


def stream_enhance_samples(stream: DataFrame, hop: int, inc: float = 0.016, **order) -> DataFrame:
    """(rec_id, seq, x): the samples of stream_enhance's frames (seq from 0, hop samples apart), each times the root window again, added where they overlap. What later frames will still add to is kept in the state and
    given out when the recording ends (with ts)."""

    def step(rows, state, ends):
        done, tail, more = state if state is not None else (None, None, None)  # done: samples given out
        out = tail if tail is not None else np.empty(0)
        if len(rows):
            clean, more = _enhanced(rows, more, inc)
            n = clean.shape[1]
            w = np.hamming(n + 1)[:-1] ** 0.5
            w = w / np.sqrt((w[::hop] ** 2).sum())
            first = int(rows["seq"].iloc[0]) * hop
            done = first if done is None else done
            at = rows["seq"].to_numpy() * hop - done
            out = np.concatenate([out, np.zeros(max(0, int(at[-1]) + n - len(out)))])
            for i, v in zip(at.tolist(), clean, strict=True):
                out[i : i + n] += v * w
            ready = len(out) if ends else int(at[-1]) + hop
        else:
            ready = len(out) if ends else 0
        done = done or 0
        return pd.DataFrame({"seq": np.arange(done, done + ready), "x": out[:ready]}), (done + ready, out[ready:], more)

    return _with_state(stream, ["v"], "seq bigint, x double", step, NOISE_START, **order)


def stream_vad(stream: DataFrame, threshold: float = 0.7, inc: float = 0.01, **order) -> DataFrame:
    """Speech probabilities and labels of frames (rec_id, seq, power), as vad() has them."""
    tracker = MinimumStatistics(inc)

    def step(rows, state, ends):
        if not len(rows):
            return None, state
        power, state = np.stack(rows["power"].to_numpy()).astype(float), state or (None, None)
        noise, now = tracker.run(power, state[0])
        p, odds = speech_odds(power, noise, state[1], inc)
        return pd.DataFrame({"seq": rows["seq"].to_numpy(), "p": p, "label": (p > threshold).astype(int)}), (now, odds)

    return _with_state(stream, ["power"], "seq bigint, p double, label int", step, **order)


def stream_body_features(stream: DataFrame, k: int, size: int = 25, hop: int = 13, cols: tuple[str, ...] = ("x", "y", "z"), **order) -> DataFrame:
    """(rec_id, frame, body_energy_ave, body_abs_mean, body_std): acc_features of split_gravity's body movement, by frames of samples (rec_id, seq from 0): gravity is the mean of the k samples around each, frames
    are Hamming-weighted. A frame is given out when the samples that its gravity needs are there, or the recording ends (with ts). The state has the samples that later frames need."""
    w = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(size) / size)
    before, after = k // 2, (k - 1) // 2

    def step(rows, state, ends):
        at, x, frame = state if state is not None else (0, np.empty((0, len(cols))), 0)  # x: samples from place at on
        x = np.concatenate([x, rows[list(cols)].to_numpy(float)]) if len(rows) else x
        total, out = np.concatenate([np.zeros((1, len(cols))), np.cumsum(x, axis=0)]), []
        n = at + len(x)
        while frame * hop + size <= n and (ends or frame * hop + size + after <= n):
            place = np.arange(frame * hop, frame * hop + size)
            lo, hi = np.maximum(place - before, 0) - at, np.minimum(place + after + 1, n) - at
            body = (x[place - at] - (total[hi] - total[lo]) / (hi - lo)[:, None]) * w[:, None]
            out.append((frame, float((body**2).mean(axis=0).sum()), float(np.abs(body).mean(axis=0).sum()), float(body.std(axis=0, ddof=1).sum())))
            frame += 1
        keep = max(0, min(len(x), frame * hop - before - at))
        return pd.DataFrame(out, columns=["frame", "body_energy_ave", "body_abs_mean", "body_std"]), (at + keep, x[keep:], frame)

    return _with_state(stream, list(cols), "frame bigint, body_energy_ave double, body_abs_mean double, body_std double", step, **order)
