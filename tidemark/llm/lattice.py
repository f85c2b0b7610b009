"""Piece lattices over many short units at once, in numpy.

A unit is a run of characters that no piece crosses the edges of (a word with its leading spaces, or a
character that only stands alone). Sums over all segmentations factorise over units, so a batch of texts
needs its distinct units only. Pieces are looked up by a 64-bit rolling hash of their characters and
confirmed by the hash table's stored key; a character that is in no piece is spelled by byte pieces.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SPACE = 0x2581
_M = np.uint64(0x9E3779B97F4A7C15)
_R = np.uint64(0x100000001B3)
_RINV = np.uint64(pow(0x100000001B3, -1, 1 << 64))
#: Units up to this length are summed as plain probabilities, in groups of one length; longer ones in logarithms.
SHORT = 40


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, n of each at least; one pair is kept, the longest needed so far."""
    if not _POWERS or len(_POWERS[0]) < n:
        each = []
        for base in (_R, _RINV):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            each.append(np.cumprod(x, out=x))
        _POWERS[:] = each
    return _POWERS


def rolling(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums H and inverse powers, so that (H[b] - H[a]) * inv[a] hashes chars[a:b]."""
    size = 1 << max(10, int(len(chars)).bit_length())
    up, down = powers(size)
    h = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(mix(chars.astype(np.uint64) + _M) * up[: len(chars)], out=h[1:])
    return h, down


def piece_key(difference: np.ndarray, inverse: np.ndarray, length: int) -> np.ndarray:
    """The hash of a piece of so many characters; its top bits choose the slot."""
    key = difference * inverse
    key += np.uint64(length)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    return key


class Pieces:
    """A fixed vocabulary: pieces of several characters or one, and 256 byte pieces."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.size = n
        text = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.byte_id = np.zeros(256, np.int32)
        self.bytes: list[bytes] = [b""] * n
        ids, order = [], []
        for i, p in enumerate(text):
            if sp.is_byte(i):
                self.byte_id[int(p[3:-1], 16)] = i
                self.bytes[i] = bytes([int(p[3:-1], 16)])
            elif not special[i]:
                self.bytes[i] = p.replace(chr(SPACE), " ").encode()
                order.append((-sp.get_score(i), i))
                ids.append(i)
        if any(chr(SPACE) in p.lstrip(chr(SPACE)) for i, p in enumerate(text) if not special[i]):
            raise ValueError("pieces that cross a word's start are not supported")
        #: By merge rank, Zipf's law: the r-th piece has a weight of 1 / (r + 2.7); a byte piece that of a last rank.
        weight = np.zeros(n)
        weight[[i for _, i in sorted(order)]] = 1 / (np.arange(len(order)) + 2.7)
        weight[self.byte_id] = 1 / (len(order) + 2.7)
        self.prior = weight / weight.sum()
        self.longest = max(len(text[i]) for i in ids)
        joined = {}  # characters of pieces with several characters can't be cut off
        for i in ids:
            if len(text[i]) > 1:
                joined.update(dict.fromkeys(text[i]))
        self.joins = np.zeros(0x110000, bool)
        self.joins[[ord(c) for c in joined]] = True
        self.slots = 1 << 19
        self.key, self.id = np.zeros(self.slots, np.uint64), np.full(self.slots, -1, np.int32)
        for i in ids:
            h = self._hash(np.array([ord(c) for c in text[i]], np.uint32))
            s = int(h >> np.uint64(45))
            while self.id[s] >= 0:
                s = (s + 1) % self.slots
            self.key[s], self.id[s] = h, i

    @staticmethod
    def _hash(chars: np.ndarray) -> np.uint64:
        h, down = rolling(chars)
        return piece_key(h[-1:].copy(), down[:1], len(chars))[0]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids by hash, -1 where there is no such piece."""
        slot = (h >> np.uint64(45)).view(np.int64)
        out = self.id.take(slot)
        todo = np.flatnonzero(out >= 0)
        todo = todo[self.key[slot[todo]] != h[todo]]
        while len(todo):
            slot[todo] = (slot[todo] + 1) % self.slots
            out[todo] = self.id[slot[todo]]
            todo = todo[(out[todo] >= 0) & (self.key[slot[todo]] != h[todo])]
        return out

    def group(self, chars: np.ndarray, starts: np.ndarray, n: int, h: np.ndarray, down: np.ndarray) -> np.ndarray:
        """ids[u, e, l]: the piece of length l + 1 that ends at character e of each unit of length n;
        -1 for none, and -2 - c, at l = 0, for the bytes of a character c that is in no piece."""
        width = min(n, self.longest)
        ids = np.full((len(starts), n, width), -1, np.int32)
        sums = np.ascontiguousarray(h[starts + np.arange(n + 1)[:, None]])
        inv = np.ascontiguousarray(down[starts + np.arange(n)[:, None]])
        for e in range(n):
            for w in range(min(e + 1, width)):
                ids[:, e, w] = self.find(piece_key(sums[e + 1] - sums[e - w], inv[e - w], w + 1))
        one = ids[:, :, 0]
        c = chars[starts[:, None] + np.arange(n)].astype(np.int64)
        np.copyto(one, (-2 - c).astype(np.int32), where=one < 0)
        return ids

    def long_group(self, chars: np.ndarray, starts: np.ndarray, n: int, h: np.ndarray, down: np.ndarray) -> np.ndarray:
        """As group(), for units of many characters: by lengths of pieces only."""
        width = min(n, self.longest)
        ids = np.full((len(starts), n, width), -1, np.int32)
        at = starts[:, None] + np.arange(n + 1)
        for w in range(width):
            a, b = at[:, : n - w], at[:, w + 1 :]
            ids[:, w:, w] = self.find(piece_key(h[b] - h[a], down[a], w + 1).ravel()).reshape(a.shape)
        one = ids[:, :, 0]
        np.copyto(one, (-2 - chars[at[:, :-1]].astype(np.int64)).astype(np.int32), where=one < 0)
        return ids

    def spelled(self, c: int) -> bytes:
        return chr(c).encode("utf-8", "surrogatepass")

    def weights(self, ids: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Probabilities of group()'s ids under prob[..., piece]; a spelled character has the product of its bytes'."""
        p = np.where(ids >= 0, prob[..., np.maximum(ids, 0)], 0.0)
        for c in np.unique(ids[ids < -1]):
            p[..., ids == c] = np.prod(prob[..., self.byte_id[list(self.spelled(-2 - int(c)))]], axis=-1)[..., None]
        return p


@lru_cache(maxsize=2)
def load(model_file: str) -> Pieces:
    return Pieces(model_file)


def codepoints(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of texts that lie back to back in UTF-8, and where each text starts."""
    chars = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return chars, lead[off]


def distinct(h: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For units, the index of one of each kind, and each unit's kind."""
    key = mix((h[ends] - h[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    _, first, kind = np.unique(key, return_index=True, return_inverse=True)
    return first, kind
