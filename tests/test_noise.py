import math

import numpy as np
import pytest

from tidemark.operators import audio
from tidemark.operators import noise as nz


def minimum_statistics(power, inc):
    """The published rule, bin by bin and frame by frame, with plain numbers."""
    taca, tmax, tmin, tfall, tb, td, nu = 0.0449, 0.392, 0.0133, 0.064, 0.0717, 1.536, 8
    nv = round(td / (inc * nu))
    nu = nu if nv >= 4 else max(round(td / (inc * 4)), 1)
    nv = max(nv, 4)

    def m(d):
        table = list(nz.LEAST_OF)
        for (a, ma), (b, mb) in zip(table, table[1:]):
            if a <= d <= b:
                return ma + (a**-0.5 - d**-0.5) / (a**-0.5 - b**-0.5) * (mb - ma)
        return table[-1][1]

    rows, bins = len(power), len(power[0])
    p, noise, p1, p2 = ([*power[0]] for _ in range(4))
    p2 = [v * v for v in p2]
    least, low, low_sub, flag = [*power[0]], [math.inf] * bins, [math.inf] * bins, [False] * bins
    ring, c, out = [[math.inf] * bins for _ in range(nu)], 1.0, []
    for t in range(rows):
        y = power[t]
        cb = 1 / (1 + (sum(p) / sum(y) - 1) ** 2)
        k = math.exp(-inc / taca)
        c = k * c + (1 - k) * max(cb, k)
        floor = min(math.exp(-inc / tmin), (sum(p) / sum(noise)) ** (-inc / tfall))
        q = []
        for b in range(bins):
            a = max(math.exp(-inc / tmax) * c / (1 + (p[b] / noise[b] - 1) ** 2), floor)
            p[b] = a * p[b] + (1 - a) * y[b]
            beta = min(a * a, math.exp(-inc / tb))
            p1[b], p2[b] = beta * p1[b] + (1 - beta) * p[b], beta * p2[b] + (1 - beta) * p[b] ** 2
            q.append(max(min((p2[b] - p1[b] ** 2) / (2 * noise[b] ** 2), 0.5), 1 / 14 / (t + 1)))
        mean = sum(q) / bins
        bc, place, fell = 1 + 2.12 * math.sqrt(mean), t % nv, []
        for b in range(bins):
            bias = lambda d: 1 + 2 * (d - 1) * (1 - m(d)) / (1 / q[b] - 2 * m(d))  # noqa: B023, E731
            fell.append(bc * p[b] * bias(nu * nv) < low[b])
            if fell[b]:
                low[b], low_sub[b] = bc * p[b] * bias(nu * nv), bc * p[b] * bias(nv)
        if place == 0:
            ring[(t // nv) % nu] = [*low]
            slope = next(10 ** (db * nv * inc / 10) for lim, db in ((0.03, 47), (0.05, 31.4), (0.06, 15.7), (math.inf, 4.1)) if mean < lim)
            for b in range(bins):
                least[b] = min(r[b] for r in ring)
                if flag[b] and not fell[b] and least[b] < low_sub[b] < slope * least[b]:
                    least[b] = low_sub[b]
                    for r in ring:
                        r[b] = low_sub[b]
                flag[b], low[b] = False, math.inf
        elif place > 1:
            for b in range(bins):
                flag[b] = flag[b] or fell[b]
                least[b] = noise[b] = min(low_sub[b], least[b])
        out.append([*noise])
    return np.array(out)


@pytest.mark.parametrize("inc", (0.016, 0.01, 0.1))
def test_minimum_statistics_as_published(inc):
    r = np.random.default_rng(0)
    power = r.exponential(size=(420, 6)) * (1 + 4 * (np.arange(420) > 250))[:, None] + np.where((np.arange(420) // 40) % 3 == 1, 50.0, 0.0)[:, None] * r.exponential(size=(420, 6))
    got, _ = nz.MinimumStatistics(inc).run(power)
    assert np.allclose(got, minimum_statistics(power.tolist(), inc), rtol=1e-9)
    a, s = nz.MinimumStatistics(inc).run(power[:133])
    b, _ = nz.MinimumStatistics(inc).run(power[133:], s)
    assert np.allclose(np.concatenate([a, b]), got)


def test_the_tracker_is_unbiased_and_follows_steps():
    r = np.random.default_rng(1)
    power = r.exponential(size=(1200, 40)) * np.where(np.arange(1200) < 600, 1.0, 4.0)[:, None]
    got, _ = nz.MinimumStatistics(0.016).run(power)
    assert 0.8 < got[300:600].mean() < 1.2 and 3.2 < got[900:].mean() < 4.8


def test_gains_are_their_definitions():
    """The clean spectrum given the noisy one is a complex Gaussian about its mean; the gains are means of its amplitude, its log and its inverse."""
    angle, radius = np.linspace(0, 2 * np.pi, 400, endpoint=False), np.linspace(0, 1, 4001)[1:] ** 2
    for prior, post in ((0.05, 0.4), (0.5, 1.0), (2.0, 3.0), (20.0, 8.0), (100.0, 60.0)):
        share = prior / (1 + prior)
        mean, var = share * np.sqrt(post), share  # noise of unit power
        r = radius * (mean + 8 * np.sqrt(var))
        density = np.exp(-(r[:, None] ** 2 - 2 * r[:, None] * mean * np.cos(angle) + mean**2) / var).mean(axis=1) * 2 * r / var
        weight = density * np.gradient(r)
        assert abs(weight.sum() - 1) < 1e-3
        weight /= weight.sum()
        want = ((weight * r).sum(), np.exp((weight * np.log(r)).sum()), 1 / (weight / r).sum())
        got = [g(np.array([prior]), np.array([post]))[0] * np.sqrt(post) for g in (nz.amplitude_gain, nz.log_gain, nz.perceptual_gain)]
        assert np.allclose(got, want, rtol=4e-3), (prior, post, got, want)
    assert np.allclose(nz.bessel(0, np.array([0.0, 1.0, 30.0])), [1.0, np.i0(1.0) * np.exp(-1), np.i0(30.0) * np.exp(-30)], rtol=1e-9)
    assert np.allclose(nz.bessel(1, np.array([0.0, 1.0])), [0.0, 0.565159103992485 * np.exp(-1)], rtol=1e-9)


def test_subtraction():
    power, noise = np.array([[10.0, 1.0, 0.1], [1e4, 1e4, 1e4]]), np.ones((2, 3))
    db = 10 * np.log10(power.sum(axis=1) / 3)
    over = np.sqrt(1 + 2 * (20 - np.clip(db, -5, 20)) / 25)
    want = [[max(1 - over[i] * v, 0.1 * min(v, 10)) if 1 - over[i] * v > 0.1 * v else min(0.1 * v, 1) for v in np.sqrt(1 / power[i])] for i in range(2)]
    assert np.allclose(nz.subtraction_gains(power, noise), want)
    assert np.allclose(nz.subtraction_gains(power, noise, 2.0, 1.0), np.sqrt(np.where(1 / power * (over[:, None] ** 2 + 0.01) >= 1, np.minimum(0.01 / power, 1), 1 - over[:, None] ** 2 / power)))


@pytest.mark.parametrize("snr,most", ((-5, 0.31), (0, 0.31), (10, 0.02), (20, 0.02)))  # at 0 dB and less it hears none of these
def test_bursts_are_told_from_noise(snr, most):
    """Frame errors over voiced bursts of 0.6 s with pauses of 1.4 s, after one window of noise; late ends are the hang-over."""
    fs, hop, r = 8000, 80, np.random.default_rng(2)
    t = np.arange(20 * fs)
    on = ((t / fs) % 2 > 1.4) & (t > 2 * fs)
    tone = sum(np.sin(2 * np.pi * 110 * k * t / fs + k * k) for k in range(1, 31)) * on
    x = tone + r.normal(0, np.sqrt((tone[on] ** 2).mean() / 10 ** (snr / 10)), len(t))
    frames = np.lib.stride_tricks.sliding_window_view(x, 160)[::hop] * np.hamming(161)[:-1]
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    noise, _ = nz.MinimumStatistics(0.01).run(power)
    p, _ = nz.speech_odds(power, noise, None, 0.01)
    truth = on[np.arange(len(p)) * hop + hop]
    wrong = ((p > 0.7) != truth)[200:].mean()
    print(snr, wrong)
    assert wrong < most


def test_wavelets_rebuild_and_part():
    x = np.random.default_rng(3).normal(size=4096)
    details, rest = audio.swt(x, 10)
    assert len(details) == 10 and np.allclose(audio.iswt(details, rest), x)
    zero = np.zeros_like(x)
    kept = audio.iswt([d if i in (3, 4) else zero for i, d in enumerate(details)], zero)
    assert np.allclose(audio.wavelet_band(x), kept)  # ten levels, of which two are kept
    # directly, by the filters' responses
    w = 2 * np.pi * np.arange(4096) / 4096
    share = [np.abs((audio.SYM4[:, None] * np.exp(-1j * np.arange(8)[:, None] * w * 2**k)).sum(axis=0)) ** 2 / 2 for k in range(5)]
    band = np.prod(share[:3], axis=0) * (1 - share[3]) + np.prod(share[:4], axis=0) * (1 - share[4])
    assert np.allclose(kept, np.real(np.fft.ifft(np.fft.fft(x) * band)))
