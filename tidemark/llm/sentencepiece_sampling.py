"""SentencePiece encoding by sampling from the piece lattice, and decoding.

The lattice of a text holds every way to write it in pieces of a fixed public vocabulary. Forward
filtering sums the probabilities of all ways up to each character; backward sampling then draws the last
piece, the one before it, and so on, each in proportion to the ways that it leaves. The draw's random
numbers come from a hash of the row key, the unit's place in its text and the step, so that a row gives
the same pieces whenever and wherever it is encoded. A space is written as the piece's leading mark, a
text starts with one such mark, and a character outside the vocabulary (the mark itself too) is spelled in
byte pieces: decoding gives back every text exactly.

Nulls: no pieces (null ids), decoded to null. Empty text: no pieces, decoded to empty. Null keys are one key value.
Repeated rows give equal pieces. Rows are independent: no shuffle. Long texts are encoded whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import lattice
from tidemark.llm.common import table, text_slices

#: The vocabulary's file; pass another path where it lies elsewhere.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SLICE = 1 << 20


def with_marks(chars: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters with spaces as marks and a mark before each text that isn't empty; starts of texts; which marks were literal."""
    sizes = np.diff(at)
    full = sizes > 0
    new = at + np.concatenate([[0], np.cumsum(full)])
    out = np.empty(new[-1], np.uint32)
    head = new[:-1][full]
    body = np.ones(len(out), bool)
    body[head] = False
    out[head] = lattice.SPACE
    out[body] = chars
    literal = np.zeros(len(out), bool)
    literal[body] = chars == lattice.SPACE
    out[out == 32] = lattice.SPACE
    return out, new, literal


def units(chars: np.ndarray, at: np.ndarray, literal: np.ndarray, joins: np.ndarray) -> np.ndarray:
    """Starts of units: at a text's start, at a mark after another character, and around a character that stands alone."""
    if not len(chars):
        return np.zeros(0, np.int64)
    mark, alone = chars == lattice.SPACE, ~joins[chars] | literal
    cut = np.zeros(len(chars), bool)
    cut[at[:-1][np.diff(at) > 0]] = True
    cut[1:] |= (mark[1:] & ~mark[:-1]) | alone[1:] | alone[:-1]
    return np.flatnonzero(cut)


def uniform(seed: np.ndarray, step: int) -> np.ndarray:
    u = (lattice.mix(seed + np.uint64(step * 0xD1342543DE82EF95 % 2**64)) >> np.uint64(40)).astype(np.float32)
    return u * np.float32(2.0**-24)  # below 1 in 32 bits too


def long_unit(p: lattice.Pieces, chars: np.ndarray, seed: np.uint64) -> list[int]:
    """Forward filtering and backward sampling of one long unit, in logarithms, with a window of one piece's length."""
    n, width = len(chars), p.longest
    h, down = lattice.rolling(chars)
    ids = np.full((n, width), -1, np.int32)
    for w in range(min(n, width)):
        a = np.arange(n - w)
        ids[w:, w] = p.find(lattice.piece_key(h[a + w + 1] - h[a], down[a], w + 1))
    score = np.where(ids >= 0, np.log(np.maximum(p.prior[np.maximum(ids, 0)], 1e-300)), -np.inf)
    for e in np.flatnonzero(ids[:, 0] < 0):
        score[e, 0] = np.log(p.prior[p.byte_id[list(p.spelled(int(chars[e])))]]).sum()
    alpha = np.full(n + 1, -np.inf)
    alpha[0] = 0
    for e in range(n):
        w = min(e + 1, width)
        x = alpha[e - np.arange(w)] + score[e, :w]
        top = x.max()
        alpha[e + 1] = top + np.log(np.exp(x - top).sum())
    out, e, step = [], n, 0
    while e:
        w = min(e, width)
        x = np.cumsum(np.exp(alpha[e - 1 - np.arange(w)] + score[e - 1, :w] - alpha[e]))
        u = uniform(np.full(1, seed), step)[0]
        k = min(int(np.searchsorted(x / x[-1], u, "right")), w - 1)
        out.extend([int(ids[e - 1, k])] if ids[e - 1, k] >= 0 else p.byte_id[list(p.spelled(int(chars[e - 1])))][::-1].tolist())
        e, step = e - k - 1, step + 1
    return out[::-1]


def sample(p: lattice.Pieces, data: np.ndarray, off: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of texts that lie back to back: all ids, and where each text's end (len(off) bounds)."""
    chars, at = lattice.codepoints(data, off)
    chars, at, literal = with_marks(chars, at)
    if not len(chars):
        return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
    chars = np.where(literal, np.uint32(0x10FFFF), chars)  # stands for the literal mark, which is spelled
    start = units(chars, at, literal, p.joins)
    end = np.append(start[1:], len(chars))
    text_of = np.searchsorted(at, start, "right") - 1
    first_unit = np.searchsorted(start, at[:-1])
    seed = lattice.mix(keys[text_of] ^ lattice.mix((np.arange(len(start)) - first_unit[text_of]).astype(np.uint64)))
    h, down = lattice.rolling(chars)
    first, kind = lattice.distinct(h, down, start, end)
    size = (end - start)[first]
    order = np.argsort(size[kind], kind="stable")
    bound = np.searchsorted(size[kind][order], np.arange(lattice.SHORT + 2))
    got_unit, got_step, got_id = [], [], []
    slot = np.zeros(len(first), np.int64)
    for n in range(1, lattice.SHORT + 1):
        occ = order[bound[n] : bound[n + 1]]
        if not len(occ):
            continue
        same = np.flatnonzero(size == n)
        slot[same] = np.arange(len(same))
        ids = p.group(chars, start[first[same]], n, h, down)
        prob = p.weights(ids, p.prior)
        width = ids.shape[2]
        alpha = np.zeros((len(same), n + 1))
        alpha[:, 0] = 1
        ways = np.full((len(same), n, width), 2, np.float32)
        for e in range(n):
            w = min(e + 1, width)
            x = np.cumsum(alpha[:, e - w + 1 : e + 1][:, ::-1] * prob[:, e, :w], axis=1)
            alpha[:, e + 1] = x[:, -1]
            ways[:, e, :w] = x / np.maximum(x[:, -1:], 1e-300)
        ways, flat_ids = ways.reshape(-1, width), ids.reshape(-1, width)
        row = slot[kind[occ]] * n
        left, step = np.full(len(occ), n), 0
        while len(occ):
            r = row + left - 1
            k = (ways[r] <= uniform(seed[occ], step)[:, None]).sum(axis=1)
            got_unit.append(occ)
            got_step.append(np.full(len(occ), step, np.int32))
            got_id.append(flat_ids[r, k])
            left = left - k - 1
            on = left > 0
            occ, row, left, step = occ[on], row[on], left[on], step + 1
    unit = np.concatenate(got_unit) if got_unit else np.zeros(0, np.int64)
    step = np.concatenate(got_step) if got_step else np.zeros(0, np.int32)
    ids = np.concatenate(got_id) if got_id else np.zeros(0, np.int32)
    spelled = {int(c): p.byte_id[list(p.spelled(lattice.SPACE if c == -2 - 0x10FFFF else -2 - int(c)))] for c in np.unique(ids[ids < -1])}
    long = {int(u): np.array(long_unit(p, chars[start[u] : end[u]], seed[u]), np.int32) for u in order[bound[-1] :]}
    count = np.bincount(unit, minlength=len(start))
    extra = {c: len(x) for c, x in spelled.items()}
    width = np.ones(len(ids), np.int64)
    for c, x in extra.items():
        width[ids == c] = x
    total = np.bincount(unit, weights=width, minlength=len(start)).astype(np.int64)
    for u, x in long.items():
        total[u] = len(x)
    ends = np.cumsum(total)
    out = np.empty(int(ends[-1]), np.int32)
    # a spelled character is a unit of its own, so a unit with pieces of several ids has widths of one
    plain = width == 1
    out[ends[unit[plain]] - 1 - step[plain]] = np.where(ids[plain] >= 0, ids[plain], 0)
    for c, x in spelled.items():
        u = unit[ids == c]
        out[(ends[u] - len(x))[:, None] + np.arange(len(x))] = x
    for u, x in long.items():
        out[ends[u] - len(x) : ends[u]] = x
    per_text = np.concatenate([[0], ends])[np.searchsorted(start, at)]
    return out, per_text


def decode(p: lattice.Pieces, ids: list[int]) -> bytes:
    """The text of ids, in UTF-8, without the leading mark's space."""
    return b"".join([p.bytes[i] for i in ids])[1:]


def keys_of(col: pa.Array) -> np.ndarray:
    """64-bit seeds of row keys of any type."""
    if pa.types.is_integer(col.type):
        return lattice.mix(pc.fill_null(col.cast(pa.int64()), -1).to_numpy(zero_copy_only=False).astype(np.uint64) + np.uint64(1))
    return np.array([int.from_bytes(hashlib.blake2b(str(x).encode(), digest_size=8).digest(), "little") for x in col.to_pylist()], np.uint64)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, seed: int = 0) -> DataFrame:
    """All columns of docs, and piece_ids ARRAY<INT>, n_pieces, ids_sha256 (of the ids as little-endian 32-bit integers),
    decoded_sha256 (of the decoded text) and lossless (the decoded text equals the text). Columns of these names are replaced."""
    added = ["piece_ids", "n_pieces", "ids_sha256", "decoded_sha256", "lossless"]
    docs = docs.drop(*added)
    types = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "piece_ids array<int>, n_pieces bigint, ids_sha256 string, decoded_sha256 string, lossless boolean"])

    def build(batches):
        p = lattice.load(model)
        for part, data, off in text_slices(batches, text, SLICE):
            ids, to = sample(p, data, off, keys_of(part.column(part.schema.get_field_index(key))) ^ np.uint64(seed))
            nulls = part.column(part.schema.get_field_index(text)).is_null().to_numpy(zero_copy_only=False)
            raw, as_list, small = data.tobytes(), ids.tolist(), ids.astype("<i4").tobytes()
            n, back, hashes, same = len(off) - 1, [], [], []
            for i in range(n):
                got = decode(p, as_list[to[i] : to[i + 1]])
                back.append(None if nulls[i] else hashlib.sha256(got).hexdigest())
                hashes.append(None if nulls[i] else hashlib.sha256(small[4 * to[i] : 4 * to[i + 1]]).hexdigest())
                same.append(None if nulls[i] else got == raw[off[i] : off[i + 1]])
            offsets = pa.array(to.astype(np.int32), mask=np.append(nulls, False)) if nulls.any() else pa.array(to.astype(np.int32))
            cols = [*part.columns, pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(np.diff(to), pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, [*part.schema.names, *added])

    return docs.mapInArrow(build, types)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_pieces", "ids_sha256", "decoded_sha256", "lossless")
