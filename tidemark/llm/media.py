"""Texts as 8-bit WAV columns with spectral-peak pair fingerprints.

The payload of a row is its text in UTF-8 (null: empty), padded with bytes 255 to a positive
multiple of FRAME. It is stored as mono unsigned 8-bit samples in a WAV container, read back by the
wave module, and cut into half-overlapping Hann frames for a short-time Fourier transform. A peak is
the strongest bin of a band of a frame where it is not weaker than the same bin one frame before and
after; a fingerprint pairs a peak with those of the same band up to REACH frames later:
(time, band, bin, later bin, distance). Frames lie inside one row, so equal texts give equal values.
Empty and null texts are one frame of padding. Rows are independent: no shuffle, and a lost task is
simply run again.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import table, text_slices

FRAME, HOP, RATE, REACH = 576, 288, 8000, 2
BANDS = ((2, 48), (48, 288))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def fingerprints(samples: list[np.ndarray]) -> list[list[tuple[int, int, int, int, int]]]:
    """For each row of samples its (time, band, bin, later bin, distance), by time."""
    counts = np.array([max(1, (len(s) - FRAME) // HOP + 1) for s in samples])
    ends = np.cumsum(counts)
    frames = np.concatenate([np.lib.stride_tricks.sliding_window_view(s, FRAME)[::HOP] for s in samples]).astype(np.float32)
    frames -= frames.mean(axis=1, keepdims=True)
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32), axis=1)).astype(np.float32)
    first = np.zeros(len(frames), bool)
    first[np.concatenate([[0], ends[:-1]])] = True
    last = np.zeros(len(frames), bool)
    last[ends - 1] = True
    rows, time = np.arange(len(frames)), np.arange(len(frames)) - np.repeat(ends - counts, counts)
    row_of, found = np.repeat(np.arange(len(samples)), counts), []
    for b, (lo, hi) in enumerate(BANDS):
        best = power[:, lo:hi].argmax(axis=1) + lo
        here = power[rows, best]
        peak = (here > 1.0) & (first | (here >= power[rows - 1, best])) & (last | (here >= power[(rows + 1) % len(rows), best]))
        for d in range(1, REACH + 1):
            a = rows[: len(rows) - d]
            a = a[peak[a] & peak[a + d] & (row_of[a] == row_of[a + d])]
            found.append(np.stack([row_of[a], time[a], np.full(len(a), b), best[a], best[a + d], np.full(len(a), d)], axis=1))
    all_ = np.concatenate(found)
    all_ = all_[np.lexsort(all_.T[::-1])]
    cuts = np.searchsorted(all_[:, 0], np.arange(len(samples) + 1))
    values = all_[:, 1:].tolist()
    return [values[cuts[i] : cuts[i + 1]] for i in range(len(samples))]


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_media: bool = True) -> DataFrame:
    """Per row: key, n_bytes, payload and media sizes and hashes, the media bytes (if keep_media) and
    prints ARRAY<STRUCT<t, band, f1, f2, dt>>. Null keys and repeated rows pass through unchanged; other columns are left out."""
    fields = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, media binary, prints array<struct<t:int,band:int,f1:int,f2:int,dt:int>>"

    def build(batches):
        for part, data, off in text_slices(batches, text, 1 << 20):
            raw, sizes = data.tobytes(), np.diff(off)
            medias, backs = [], []
            for i in range(len(sizes)):
                size = int(sizes[i])
                medias.append(to_wav(raw[off[i] : off[i + 1]] + b"\xff" * (max(FRAME, -(-size // FRAME) * FRAME) - size)))
                backs.append(from_wav(medias[-1]))
            prints = fingerprints([np.frombuffer(b, np.uint8) for b in backs])
            cols = [
                part.column(0), pa.array(sizes, pa.int64()), pa.array([len(b) for b in backs], pa.int64()),
                pa.array([hashlib.sha256(b).hexdigest() for b in backs]), pa.array([zlib.crc32(b[-32:]) for b in backs], pa.int64()),
                pa.array([len(m) for m in medias], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in medias]),
                pa.array(medias if keep_media else [None] * len(medias), pa.binary()), prints_column(prints),
            ]
            yield pa.RecordBatch.from_arrays(cols, names)

    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "media", "prints"]
    return docs.select(key, text).mapInArrow(build, fields)


def prints_column(prints: list[list[tuple[int, ...]]]) -> pa.Array:
    """The fingerprints as one list<struct> array, built from flat buffers."""
    flat = np.array([p for r in prints for p in r], np.int32).reshape(-1, 5)
    ends = np.cumsum([0, *(len(r) for r in prints)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(5)], ["t", "band", "f1", "f2", "dt"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = media_columns(table(spark, sf_dir, "documents"), keep_media=False)
    return cols.selectExpr(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        "array_join(transform(prints, p -> concat_ws('-', p.t, p.band, p.f1, p.f2, p.dt)), ',') AS feature",
    )
