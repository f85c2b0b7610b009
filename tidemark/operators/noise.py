"""Noise trackers, gains and speech odds over frames of power spectra [frame, bin]. Each goes on from a state, so that frames can come in chunks or micro-batches; nothing here knows Spark."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TINY = 1e-30
#: Mean of the least of D values of unit mean, by the rule's published table (D, M).
LEAST_OF = ((1, 0.0), (2, 0.26), (5, 0.48), (8, 0.58), (10, 0.61), (15, 0.668), (20, 0.705), (30, 0.762), (40, 0.8), (60, 0.841), (80, 0.865), (120, 0.89), (140, 0.9), (160, 0.91), (180, 0.92), (220, 0.93), (260, 0.935), (300, 0.94))


def least_of(d: int) -> float:
    """M(D) between the table's entries, along a line in 1 / sqrt(D)."""
    at, m = np.array(LEAST_OF).T
    return float(np.interp(-1 / np.sqrt(d), -1 / np.sqrt(at), m))


@dataclass(frozen=True)
class MinimumStatistics:
    """Noise as the least smoothed power of the last window, by optimal smoothing and with its bias taken out (R. Martin, 2001, with the table of 2006).

    inc: seconds between frames. The other values are the published ones: time constants in seconds, the window and its parts, the bounds of the inverse degrees of freedom, and the
    largest rises (dB a second) by how much the smoothed power varies."""

    inc: float = 0.016
    t_correction: float = 0.0449
    t_most: float = 0.392
    t_least: float = 0.0133
    t_fall: float = 0.064
    t_moments: float = 0.0717
    window: float = 1.536
    parts: int = 8
    freedom: tuple[float, float] = (2.0, 14.0)
    spread: float = 2.12
    rises: tuple[tuple[float, float], ...] = ((0.03, 47.0), (0.05, 31.4), (0.06, 15.7), (float("inf"), 4.1))

    def part(self) -> tuple[int, int]:
        """Frames of a part of the window, and the number of parts; a part has four frames at least."""
        n = round(self.window / (self.inc * self.parts))
        return (n, self.parts) if n >= 4 else (4, max(1, round(self.window / (self.inc * 4))))

    def run(self, power: np.ndarray, state: dict | None = None, at: int = 0) -> tuple[np.ndarray, dict]:
        """Noise of frames, and the state to go on from. Without a state the first frame is the first estimate; at is then its place in the recording, which sets where parts of the window end."""
        size, parts = self.part()
        keep = lambda t: float(np.exp(-self.inc / t))
        m_all, m_part = least_of(size * parts), least_of(size)
        rise = [(limit, 10 ** (db * size * self.inc / 10)) for limit, db in self.rises]
        power = np.asarray(power, float)
        if state is None:
            if not len(power):
                return power, None
            y, none = power[0], np.full(power.shape[1], np.inf)
            state = {"t": at, "p": y, "noise": y, "least": y, "one": y, "two": y**2, "c": 1.0, "low": none, "low_part": none, "ring": np.full((parts, len(y)), np.inf), "maybe": np.zeros(len(y), bool)}
        t, p, noise, least, one, two, c, low, low_part, ring, maybe = (state[k] for k in ("t", "p", "noise", "least", "one", "two", "c", "low", "low_part", "ring", "maybe"))
        ring, out = ring.copy(), np.empty_like(power)
        for i, y in enumerate(power):
            # smoothing: less where the smoothed power is far from the noise, as a whole and by bin
            off = 1 / (1 + (p.sum() / max(y.sum(), TINY) - 1) ** 2)
            c = keep(self.t_correction) * c + (1 - keep(self.t_correction)) * max(off, keep(self.t_correction))
            known = np.maximum(noise, TINY)
            a = keep(self.t_most) * c / (1 + (p / known - 1) ** 2)
            snr = max(p.sum() / known.sum(), TINY)
            a = np.maximum(a, min(keep(self.t_least), snr ** (-self.inc / self.t_fall)))
            p = a * p + (1 - a) * y
            # variance of the smoothed power, as inverse degrees of freedom
            b = np.minimum(a * a, keep(self.t_moments))
            one, two = b * one + (1 - b) * p, b * two + (1 - b) * p * p
            q = np.clip((two - one**2) / (2 * known**2), 1 / (self.freedom[1] * (t + 1)), 1 / self.freedom[0])
            mean_q = q.mean()
            fix = (1 + self.spread * np.sqrt(mean_q)) * p
            whole, short = (fix * (1 + 2 * (d - 1) * (1 - m) / (1 / q - 2 * m)) for d, m in ((size * parts, m_all), (size, m_part)))
            fell = whole < low
            low, low_part = np.where(fell, whole, low), np.where(fell, short, low_part)
            place = t % size
            if place == 0:  # a part ends
                ring[(t // size) % parts] = low
                least = ring.min(axis=0)
                most = next(r for limit, r in rise if mean_q < limit)
                rose = maybe & ~fell & (low_part < most * least) & (low_part > least)
                least = np.where(rose, low_part, least)
                ring[:, rose] = least[rose]
                maybe, low = np.zeros_like(maybe), np.full_like(low, np.inf)
            elif place > 1:
                maybe = maybe | fell
                least = np.minimum(least, low_part)
                noise = least
            out[i] = noise
            t += 1
        return out, {"t": t, "p": p, "noise": noise, "least": least, "one": one, "two": two, "c": c, "low": low, "low_part": low_part, "ring": ring, "maybe": maybe}


def bessel(order: int, x: np.ndarray) -> np.ndarray:
    """exp(-x) I(x) of order 0 or 1 for x >= 0: the power series up to 20, the asymptotic one beyond."""
    x = np.asarray(x, float)
    small, big = np.minimum(x, 20.0), np.maximum(x, 20.0)
    term = np.ones_like(x) if order == 0 else small / 2
    series = term.copy()
    for k in range(1, 45):
        term = term * (small / 2) ** 2 / (k * (k + order))
        series += term
    term, tail = np.ones_like(x), np.ones_like(x)
    for k in range(1, 16):
        term = term * ((2 * k - 1) ** 2 - 4 * order**2) / (8 * k * big)
        tail += term
    return np.where(x <= 20, series * np.exp(-small), tail / np.sqrt(2 * np.pi * big))


def expint(x: np.ndarray) -> np.ndarray:
    """Exponential integral E1 for positive x: a series up to 1, a continued fraction beyond."""
    x = np.maximum(np.asarray(x, float), 1e-12)
    small = np.minimum(x, 1.0)
    term, total = np.ones_like(x), np.zeros_like(x)
    for k in range(1, 25):
        term = -term * small / k
        total -= term / k
    series = -np.euler_gamma - np.log(small) + total
    big, tail = np.maximum(x, 1.0), np.zeros_like(x)
    for k in range(60, 0, -1):
        tail = k / (1 + k / (big + tail))
    return np.where(x <= 1, series, np.exp(-big) / (big + tail))


def log_gain(prior: np.ndarray, post: np.ndarray) -> np.ndarray:
    """exp(E ln A) over the observed amplitude, of a Gaussian spectrum in Gaussian noise."""
    share = prior / (1 + prior)
    return share * np.exp(0.5 * expint(share * post))


def amplitude_gain(prior: np.ndarray, post: np.ndarray) -> np.ndarray:
    """E A over the observed amplitude."""
    v = prior / (1 + prior) * post
    return np.sqrt(np.pi * v) / (2 * post) * ((1 + v) * bessel(0, v / 2) + v * bessel(1, v / 2))


def perceptual_gain(prior: np.ndarray, post: np.ndarray) -> np.ndarray:
    """1 / E (1 / A) over the observed amplitude: errors weigh less where the spectrum is strong."""
    v = prior / (1 + prior) * post
    return np.sqrt(v / np.pi) / (post * bessel(0, v / 2))


GAINS = {"mmse": log_gain, "amplitude": amplitude_gain, "perceptual": perceptual_gain}


def estimator_gains(power: np.ndarray, noise: np.ndarray, before: np.ndarray | None, kind: str, inc: float) -> tuple[np.ndarray, np.ndarray]:
    """Gains [frame, bin] (at most 10) with prior ratios led by the last frame's decision, and what to go on from."""
    gain, a = GAINS[kind], np.exp(-inc / 0.396)
    out, u = np.empty_like(power), np.ones(power.shape[1]) if before is None else before
    for i in range(len(power)):
        post = np.clip(power[i] / np.maximum(noise[i], TINY), 1e-3, 1e3)
        prior = np.maximum(a * u + (1 - a) * np.maximum(post - 1, 0), 1e-12)
        out[i] = gain(prior, post)
        u = post * out[i] ** 2
    return np.minimum(out, 10.0), u


def subtraction_gains(power: np.ndarray, noise: np.ndarray, domain: float = 1.0, exponent: float = 1.0, most: float = 3.0, floor: float = 0.01, snr: tuple[float, float] = (-5.0, 20.0)) -> np.ndarray:
    """Gains [frame, bin] of spectral subtraction in a domain (1: magnitudes, 2: powers). Noise is taken most-fold at a frame's lower SNR (dB) and once at the upper one; what is left is
    at least the noise times floor. Frames stand alone."""
    v = (noise / np.maximum(power, TINY)) ** (domain / 2)
    total = noise.sum(axis=1)
    db = 10 * np.log10(np.maximum(power.sum(axis=1), TINY) / np.where(total > 0, total, 1.0))
    over = np.where(total > 0, 1 + (most - 1) * (snr[1] - np.clip(db, *snr)) / (snr[1] - snr[0]), 1.0)[:, None] ** (domain / 2)
    low = floor ** (domain / 2)
    left = np.where(v * (over + low) >= 1, np.minimum(low * v, 1.0), 1 - over * v)
    return np.maximum(left, 0.0) ** (exponent / domain)


def speech_odds(power: np.ndarray, noise: np.ndarray, state: tuple | None, inc: float, talk: float = 0.1, silence: float = 0.05) -> tuple[np.ndarray, tuple]:
    """Probabilities that frames are speech (J. Sohn, 1999): the mean log likelihood ratio over bins but the first, and a chain of two states with mean stays of talk and silence seconds, whose
    odds run on from frame to frame (the hang-over). Needs inc <= silence / 2. Prior ratios follow the amplitude estimator."""
    leave, enter, a = inc / talk, inc / silence, np.exp(-inc / 0.396)
    odds, u = state or (0.0, np.ones(power.shape[1]))
    out = np.empty(len(power))
    for i in range(len(power)):
        post = np.clip(power[i] / np.maximum(noise[i], TINY), 1e-4, 1e3)
        prior = a * u + (1 - a) * np.maximum(post - 1, 0)
        ratio = (prior / (1 + prior) * post - np.log1p(prior))[1:].mean()
        # odds of the state before, moved on by the chain, over the odds that the chain has of its own
        moved = np.logaddexp(np.log(enter), np.log(1 - leave) + odds) - np.logaddexp(np.log(1 - enter), np.log(leave) + odds)
        odds = float(np.log(leave / enter) + ratio + moved)
        out[i] = 1 / (1 + np.exp(-odds)) if odds > -500 else 0.0
        u = post * amplitude_gain(np.maximum(prior, 1e-12), post) ** 2
    return out, (odds, u)
