"""Personal data in texts: fixed patterns, and a character-level bidirectional LSTM with a CRF.

Base spans come from the patterns of four kinds, leftmost and non-overlapping per kind, matches that fail their check
dropped. The network reads characters in overlapping windows: an embedding, one LSTM in each direction, and tag scores
whose best sequence a CRF decodes (Viterbi), all in numpy. It is trained with the CRF's likelihood by Adam on the
base spans of a bounded sample, some of them spoilt (separators changed) so that it learns forms that the patterns miss: of about TRAIN_ROWS
rows (by hash), all windows with a span and a fifth of the others, of which, equal ones once, the MOST_WINDOWS with the least hashes. Windows are decided globally: each character takes the tag of the window in which
it lies farthest from an edge. A span of the network is added where it overlaps no base span, is likely enough, and has
a plausible number of digits (or an @). So no span without either is ever added, and windows with neither are skipped; all that this can
lose is the end of a span that lies farther than half a window from its last digit or @. It saves nearly all the work.

Null texts are empty. Ties go to the earlier kind. Offsets count code points. Repeated rows get equal results.
With no row to train on, base spans only. Rows are independent once trained. A task holds SLICE_BYTES of texts, or one longer text, and decodes
MOST_AT_ONCE windows at a time; a longer text's windows are decoded in parts and settled over the whole text.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, text_slices

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base spans.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
TRAIN_ROWS, MOST_WINDOWS, WINDOW, STRIDE, HIDDEN, EMBED = 2000, 6000, 64, 32, 16, 12
#: Bytes of text that a task holds at once (one text at least), and windows that it decodes at once.
SLICE_BYTES, MOST_AT_ONCE = 1 << 20, 1 << 14
#: Least probability, averaged over a span, for a span of the network to be added.
LIKELY = 0.9
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def passes(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in s.split(".")))  # of any number of digits
    n = sum(c in "0123456789" for c in s)
    if kind == "card":
        return 16 <= n <= 19 and luhn(re.sub("[^0-9]", "", s))
    return kind != "phone" or 8 <= n <= 15


_DIGIT = re.compile("[0-9]")
#: The same patterns, from the beginning of a run of their first class only: a match that begins inside a run exists only
#: where one begins at its start, or where the match before ended. So runs of any length are read once.
_AT_RUNS = {"email": re.compile(r"(?<![A-Za-z0-9._%+-])" + PATTERNS["email"].pattern), "ip": re.compile(r"(?<![0-9])" + PATTERNS["ip"].pattern)}


def matches(kind: str, text: str):
    """Leftmost non-overlapping matches of the kind's pattern."""
    if kind not in _AT_RUNS:
        yield from PATTERNS[kind].finditer(text)
        return
    at = 0
    while m := (PATTERNS[kind].match(text, at) if at else None) or _AT_RUNS[kind].search(text, at):
        yield m
        at = m.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    digit = _DIGIT.search(text) is not None
    for kind in KINDS:
        if "@" in text if kind == "email" else digit:
            found += [(kind, m.start(), m.end()) for m in matches(kind, text) if passes(kind, m[0])]
    return found


def char_codes(text: str) -> np.ndarray:
    """0 to 127: the character; 128: any other letter; 129: any other. A byte each."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 128, c, np.where(c < 0x250, 128, 129)).astype(np.uint8)


def tags_of(n: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for kind, a, b in reversed(spans):
        k = KINDS.index(kind)
        out[a:b] = 2 + 2 * k
        out[a] = 1 + 2 * k
    return out


def allowed() -> np.ndarray:
    """Transitions that make sense: inside only after begin or inside of the same kind."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    """Embedding, two LSTMs, tag scores, CRF transitions."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        self.p = {"E": r.normal(0, 0.3, (131, EMBED)), "W": r.normal(0, 0.25, (2 * HIDDEN, TAGS)), "b": np.zeros(TAGS), "T": np.zeros((TAGS, TAGS))}
        for d in "fb":
            self.p |= {f"X{d}": r.normal(0, 0.3, (EMBED, 4 * HIDDEN)), f"H{d}": r.normal(0, 0.25, (HIDDEN, 4 * HIDDEN)), f"c{d}": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])}

    def pass_(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """One direction over codes x[time, row]; returns h[time, row, unit]."""
        table = (self.p["E"] @ self.p[f"X{d}"] + self.p[f"c{d}"]).astype(np.float32)
        rec = self.p[f"H{d}"].astype(np.float32)
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.empty((*x.shape, HIDDEN), np.float32)
        for t in steps:
            z = table[x[t]] + h @ rec
            s = sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            tc = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc))
            h, c = o * tc, new
            out[t] = h
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.pass_(x, "f"), self.pass_(x, "b")], axis=2) @ self.p["W"].astype(np.float32) + self.p["b"].astype(np.float32)

    def transitions(self) -> np.ndarray:
        return np.where(allowed(), self.p["T"], -1e4)

    def marginals(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log partition per row, tag marginals, and summed pair marginals, by forward and backward sums."""
        tr = self.transitions()
        e = np.exp(tr)
        n, rows, k = s.shape
        a, z = np.empty(s.shape), np.zeros(rows)
        x = np.exp(s - s.max(axis=2, keepdims=True))
        top = s.max(axis=2)
        a[0] = x[0]
        for t in range(n):
            if t:
                a[t] = (a[t - 1] @ e) * x[t]
            w = a[t].sum(axis=1, keepdims=True)
            a[t] /= w
            z += np.log(w[:, 0]) + top[t]
        b, pair = np.ones((rows, k)), np.zeros((k, k))
        m = np.empty(s.shape)
        for t in range(n - 1, -1, -1):
            m[t] = a[t] * b
            m[t] /= m[t].sum(axis=1, keepdims=True)
            if t:
                y = x[t] * b
                norm = np.einsum("ri,ij,rj->r", a[t - 1], e, y)
                pair += e * ((a[t - 1] / norm[:, None]).T @ y)
                b = y @ e.T
                b /= b.sum(axis=1, keepdims=True)
        return z, m, pair

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood per row, and its gradients."""
        n, rows = x.shape
        kept = {"f": [], "b": []}
        h = np.concatenate([self.pass_(x, d, kept[d]) for d in "fb"], axis=2)
        s = h @ self.p["W"] + self.p["b"]
        z, m, pair = self.marginals(s)
        gold = np.take_along_axis(s, y[..., None], 2)[..., 0].sum(axis=0) + self.transitions()[y[:-1], y[1:]].sum(axis=0)
        np.put_along_axis(m, y[..., None], np.take_along_axis(m, y[..., None], 2) - 1, 2)
        ds = m / rows
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        np.add.at(pair, (y[:-1].ravel(), y[1:].ravel()), -1)
        g["T"] = np.where(allowed(), pair, 0) / rows
        g["W"] = np.einsum("tru,trk->uk", h, ds)
        g["b"] = ds.sum(axis=(0, 1))
        dh_all = ds @ self.p["W"].T
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            emb = self.p["E"]
            dh = dc = np.zeros((rows, HIDDEN))
            for t, h0, c0, i, f, o, gg, tc in reversed(kept[d]):
                dh = dh + dh_all[t, :, part]
                dc = dc + dh * o * (1 - tc**2)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg**2)], axis=1)
                g[f"H{d}"] += h0.T @ dz
                g[f"c{d}"] += dz.sum(axis=0)
                g[f"X{d}"] += emb[x[t]].T @ dz
                np.add.at(g["E"], x[t], dz @ self.p[f"X{d}"].T)
                dh, dc = dz @ self.p[f"H{d}"].T, dc * f
        return float((z - gold).mean()), g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 64, rate: float = 0.01, seed: int = 0) -> list[float]:
        """Adam over random batches of windows x[row, time], y[row, time]; the losses."""
        r, m, v, losses = np.random.default_rng(seed), dict.fromkeys(self.p, 0.0), dict.fromkeys(self.p, 0.0), []
        for t in range(1, steps + 1):
            rows = r.integers(0, len(x), min(batch, len(x)))
            loss, g = self.gradients(x[rows].T, y[rows].T)
            losses.append(loss)
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                self.p[k] = self.p[k] - rate * min(1, 2 - 2 * t / steps) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        return losses

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags [time, row] and their marginal probabilities."""
        s = self.scores(x)
        tr = self.transitions().astype(np.float32)
        n, rows, k = s.shape
        best, back = s[0], np.empty((n, rows, k), np.int8)
        for t in range(1, n):
            c = best[:, :, None] + tr
            back[t] = c.argmax(axis=1)
            best = c.max(axis=1) + s[t]
        tags = np.empty((n, rows), np.int8)
        tags[-1] = best.argmax(axis=1)
        for t in range(n - 1, 0, -1):
            tags[t - 1] = back[t, np.arange(rows), tags[t]]
        prob = np.ones((n, rows), np.float32)
        some = np.flatnonzero((tags > 0).any(axis=0))
        if len(some):
            prob[:, some] = np.take_along_axis(self.marginals(s[:, some].astype(float))[1], tags[:, some, None].astype(np.int64), 2)[..., 0]
        return tags, prob


def window_starts(n: int) -> np.ndarray:
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


def trigger(code: np.ndarray) -> np.ndarray:
    return ((code >= 48) & (code <= 57)) | (code == 64)


def windows_of(code: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Windows worth reading (or those at starts), padded with code 130, and where they start."""
    starts = worth(code) if starts is None else starts
    if not len(starts):
        return np.zeros((0, WINDOW), np.uint8), starts
    lo = int(starts[0])
    padded = np.concatenate([code[lo : int(starts[-1]) + WINDOW], np.full(WINDOW, 130, np.uint8)])
    return padded[(starts - lo)[:, None] + np.arange(WINDOW)], starts


def worth(code: np.ndarray) -> np.ndarray:
    """Starts of the windows with a digit or an @."""
    starts = window_starts(len(code))
    hit = np.concatenate([[0], np.cumsum(trigger(code), dtype=np.int32)])
    return starts[hit[np.minimum(starts + WINDOW, len(code))] > hit[starts]]


def spoil(text: str, spans: list[tuple[str, int, int]], r: np.random.Generator) -> str:
    """Some spans with other characters of the same number, in forms that the patterns miss."""
    out = list(text)
    for kind, a, b in spans:
        if r.random() < 0.35:
            for i in range(a, b):
                if kind == "ip" and out[i] == "." or kind == "email" and out[i] == "." and "@" in text[a:i]:
                    out[i] = ","
                elif kind in ("card", "phone") and out[i] in " -.+":
                    out[i] = "/" if kind == "card" else " " if out[i] == "+" else "/"
    return "".join(out)


def train(docs: DataFrame, text: str = "text") -> Network | None:
    """A network from at most MOST_WINDOWS windows of about TRAIN_ROWS rows with a digit or an @; None when none has a base span."""
    some = docs.select(F.col(text).alias("text")).where(F.col("text").rlike("[0-9@]"))
    n = some.count()
    share = min(1.0, TRAIN_ROWS / max(n, 1))
    bound = int(share * (1 << 30))

    def build(batches):
        for batch in batches:
            xs, ys = [], []
            for t in batch.column(0).to_pylist():
                spans = base_spans(t)
                r = np.random.default_rng(len(t))
                code = char_codes(spoil(t, spans, r))
                x, starts = windows_of(code)
                y = np.concatenate([tags_of(len(code), spans), np.zeros(WINDOW, np.int64)])[starts[:, None] + np.arange(WINDOW)]
                keep = np.flatnonzero((y > 0).any(axis=1) | (r.random(len(y)) < 0.2))
                xs += [x[i].astype(np.uint8).tobytes() for i in keep]
                ys += [y[i].astype(np.uint8).tobytes() for i in keep]
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], ["x", "y"])

    got = some.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < bound).mapInArrow(build, "x binary, y binary").groupBy("x").agg(F.min("y").alias("y")).orderBy(F.xxhash64("x"), "x").limit(MOST_WINDOWS).toPandas()
    x = np.frombuffer(b"".join(got["x"]), np.uint8).reshape(-1, WINDOW).astype(np.int64)
    y = np.frombuffer(b"".join(got["y"]), np.uint8).reshape(-1, WINDOW).astype(np.int64)
    y = np.where((y % 2 == 0) & (y > 0) & (np.arange(WINDOW) == 0), y - 1, y)  # a span cut by the window's edge begins there
    if not (y > 0).any():
        return None
    net = Network()
    net.fit(x, y)
    return net


def plausible(kind: str, s: str) -> bool:
    n = sum(c in "0123456789" for c in s)
    return {"email": "@" in s and len(s) >= 5, "ip": 4 <= n <= 12, "card": 13 <= n <= 19, "phone": 8 <= n <= 15}[kind]


class Layers:
    """What a text's characters have from the windows so far: each from the window in which it lies farthest from an edge."""

    depth = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]).astype(np.int16)

    def __init__(self, n: int):
        self.n, self.tag, self.p, self.edge = n, np.zeros(n + WINDOW, np.int8), np.ones(n + WINDOW, np.float32), np.full(n + WINDOW, -1, np.int16)

    def add(self, starts: np.ndarray, tags: np.ndarray, prob: np.ndarray) -> None:
        for a, t, q in zip(starts.tolist(), tags.T, prob.T, strict=True):
            at = slice(a, a + WINDOW)
            own = self.depth + WINDOW * (np.arange(WINDOW) < STRIDE) if a == 0 else self.depth
            better = own > self.edge[at]
            self.tag[at], self.p[at], self.edge[at] = np.where(better, t, self.tag[at]), np.where(better, q, self.p[at]), np.where(better, own, self.edge[at])

    def spans(self) -> list[tuple[str, int, int, float]]:
        """Spans (kind, start, end, mean probability)."""
        tag = self.tag[: self.n]
        kind = (tag + 1) // 2
        cut = np.flatnonzero(np.diff(np.concatenate([[0], kind, [0]]).astype(np.int8)))
        out = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if kind[a]:
                heads = [int(a), *(int(a) + 1 + np.flatnonzero(tag[a + 1 : b] % 2 == 1)).tolist(), int(b)]
                out += [(KINDS[kind[a] - 1], u, v, float(self.p[u:v].mean(dtype=float))) for u, v in zip(heads[:-1], heads[1:], strict=True)]
        return out


def reconcile(n: int, starts: np.ndarray, tags: np.ndarray, prob: np.ndarray) -> list[tuple[str, int, int, float]]:
    """Spans of a text of n characters from all its windows."""
    text = Layers(n)
    text.add(starts, tags, prob)
    return text.spans()


def added_spans(net: Network, texts: list[str], base: list[list], most: int = MOST_AT_ONCE) -> list[list[tuple[str, int, int]]]:
    """For each text, the network's spans beyond its base spans. Windows are read at most so many at once; a text with more is read in parts,
    and the result doesn't depend on the number."""
    out: list[list] = [[] for _ in texts]
    open_: dict[int, Layers] = {}  # texts read in part
    ready: list[tuple[int, np.ndarray, np.ndarray, bool]] = []  # (text, its windows, their starts, whether they are its last)

    def accept(i: int, text: Layers) -> None:
        for kind, a, b, q in text.spans():
            while b > a and texts[i][b - 1] in " .,;":
                b -= 1
            while b > a and texts[i][a] in " .,;":
                a += 1
            if q >= LIKELY and plausible(kind, texts[i][a:b]) and all(b <= u or a >= v for _, u, v in base[i]):
                out[i].append((kind, a, b))

    def read() -> None:
        uniq, back = np.unique(np.concatenate([r[1] for r in ready]).view(f"V{WINDOW}").ravel(), return_inverse=True)
        codes = np.frombuffer(uniq.tobytes(), np.uint8).reshape(-1, WINDOW)
        done = [net.decode(codes[a : a + 2048].T) for a in range(0, len(codes), 2048)]
        tags, prob = (np.concatenate([d[k] for d in done], axis=1) for k in range(2))
        some, at = (tags > 0).any(axis=0), 0
        for i, x, starts, last in ready:
            own = back[at : at + len(x)]
            at += len(x)
            if i not in open_ and last and not some[own].any():
                continue
            text = open_.setdefault(i, Layers(len(texts[i])))
            text.add(starts, tags[:, own], prob[:, own])
            if last:
                accept(i, open_.pop(i))
        ready.clear()

    held = 0
    for i, t in enumerate(texts):
        if not (_DIGIT.search(t) or "@" in t):
            continue
        code = char_codes(t)
        starts = worth(code)
        for lo in range(0, len(starts), most):
            x, s = windows_of(code, starts[lo : lo + most])
            if held + len(x) > most and ready:
                read()
                held = 0
            ready.append((i, x, s, lo + most >= len(starts)))
            held += len(x)
    if ready:
        read()
    return out


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(docs: DataFrame, net: Network | None, text: str = "text", masked: str | None = None) -> DataFrame:
    """All columns of docs, with n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans (columns of these names are replaced).
    masked names a column (text itself, too) that gets the text with each span as its kind in brackets."""
    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    docs = docs.drop(*names)
    keep = [f for f in docs.schema.fields if f.name != masked]
    types = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), *(f"{n} bigint" for n in names[:4]), "base_sha256 string, spans string", *([f"`{masked}` string"] if masked else [])])
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def build(batches):
        for part, _, _ in text_slices(batches, text, SLICE_BYTES):
            raw = part.column(part.schema.get_field_index(text)).to_pylist()
            texts = [t or "" for t in raw]
            base = [base_spans(t) for t in texts]
            more = added_spans(sent.value, texts, base) if sent.value else [[] for _ in texts]
            cols = [part.column(part.schema.get_field_index(f.name)) for f in keep]
            cols += [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
            cols += [pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in base]), pa.array([written([*b, *m]) for b, m in zip(base, more, strict=True)])]
            if masked:
                cols.append(pa.array([None if r is None else mask(r, [*b, *m]) for r, b, m in zip(raw, base, more, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, [*(f.name for f in keep), *names, *([masked] if masked else [])])

    return docs.mapInArrow(build, types)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with spans as [kind]; of overlapping ones, the union is masked as the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, train(docs)).select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans")
