"""Words of texts as 64-bit hashes, for whole Arrow slices at once.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r, as in `[^\\x20\\x09-\\x0D]+`.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm.lattice import mix, rolling

_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts back to back, and where each text's words begin (len(off) bounds)."""
    inside = ~_GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    if len(data):
        edge[0] = edge[-1] = True
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[off] = True
    at = np.flatnonzero(edge)
    starts = at[:-1][inside[at[:-1]]] if len(at) else np.zeros(0, np.int64)
    ends = at[1:][inside[at[:-1]]] if len(at) else np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    h, down = rolling(_LOWER[data] if lower else data)
    return mix((h[ends] - h[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words; those that run over a text's end are the caller's to drop."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    n, out = len(words) - k + 1, np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[i : i + n]
    return mix(out)


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of marked bytes of texts back to back, and where each text's runs begin (len(off) bounds)."""
    edge = np.zeros(len(inside) + 1, bool)
    if len(inside):
        edge[0] = edge[-1] = True
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        edge[off] = True
    at = np.flatnonzero(edge)
    own = inside[at[:-1]] if len(at) else np.zeros(0, bool)
    starts, ends = at[:-1][own], at[1:][own]
    return starts, ends, np.searchsorted(starts, off)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]
