"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word (a run of letters, in
lower case, with the vocabulary's leading mark) has the sum of the products of its pieces' probabilities
over all ways to cut it into pieces, by the forward algorithm; a text has the product of its words'. The
language with the largest posterior (words and the languages' shares of the training rows) is predicted,
and its posterior is the score.

Training reads all rows that may be learnt from: expected piece counts under the vocabulary's own
probabilities (one step of expectation-maximisation, by forward and backward sums) are summed per language
on the executors and by Spark. What reaches the driver is bounded by vocabulary x languages.

Words of any length are summed whole; those over SHORT characters, or with characters that only bytes spell, in logarithms.

Nulls and texts without a letter: `und` with score 0. Null lang rows are not learnt from. With no training
row at all every text is `und`. Null keys: not held out, not learnt from. Ties: the language name first in order. Repeated rows: equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import lattice
from tidemark.llm.common import table, text_slices
from tidemark.llm.sentencepiece_sampling import MODEL

SLICE = 2 << 20
#: Cells (characters x piece lengths) of long words that are summed at once; a longer word has an array of its own.
MOST_CELLS = 1 << 21
#: Pseudo-counts of the vocabulary's own probabilities for each language.
PRIOR_COUNTS = 2000.0


def letter_table() -> np.ndarray:
    """For each character, its code in lower case if it is a letter and 0 if not; characters whose lower case isn't one character stay as they are."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(letter_table())
    return _LETTERS[0]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marked words of texts back to back: characters, starts, ends, and the text of each."""
    chars, at = lattice.codepoints(data, off)
    low = letters()[chars]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = low > 0
    begin = inside[1:-1] & (~inside[:-2])
    heads = at[:-1][np.diff(at) > 0]
    begin[heads] = inside[1:-1][heads]
    finish = inside[1:-1] & (~inside[2:])
    tails = at[1:][np.diff(at) > 0] - 1
    finish[tails] = inside[1:-1][tails]
    b, e = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    text_of = np.searchsorted(at, b, "right") - 1
    # a mark before each word
    size = e - b + 1
    ends = np.cumsum(size)
    starts = ends - size
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    body = np.ones(len(out), bool)
    body[starts] = False
    out[starts] = lattice.SPACE
    out[body] = low[low > 0]
    return out, starts, ends, text_of


def forward(prob: np.ndarray) -> np.ndarray:
    """alpha[..., u, e] of weights prob[..., u, e, l]; the last entry is the sum over all segmentations."""
    *lead, n, width = prob.shape
    alpha = np.zeros((*lead, n + 1))
    alpha[..., 0] = 1
    for e in range(n):
        w = min(e + 1, width)
        alpha[..., e + 1] = np.einsum("...l,...l->...", alpha[..., e - w + 1 : e + 1][..., ::-1], prob[..., e, :w])
    return alpha


def backward(prob: np.ndarray) -> np.ndarray:
    *lead, n, width = prob.shape
    beta = np.zeros((*lead, n + 1))
    beta[..., n] = 1
    for e in range(n, 0, -1):
        for w in range(min(e, width)):
            beta[..., e - w - 1] += prob[..., e - 1, w] * beta[..., e]
    return beta


def blocks(size: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Indexes of distinct words by length."""
    order = np.argsort(size, kind="stable")
    bound = np.flatnonzero(np.diff(size[order], prepend=-1))
    return [(int(size[order[a]]), order[a:b]) for a, b in zip(bound, [*bound[1:], len(order)], strict=True)]


def log_forward(weight: np.ndarray) -> np.ndarray:
    """As forward(), logarithms of weights in and of sums out: for units of any length, and characters of little weight."""
    *lead, n, width = weight.shape
    alpha = np.full((*lead, n + 1), -np.inf)
    alpha[..., 0] = 0
    for e in range(n):
        w = min(e + 1, width)
        alpha[..., e + 1] = np.logaddexp.reduce(alpha[..., e - w + 1 : e + 1][..., ::-1] + weight[..., e, :w], axis=-1)
    return alpha


def log_backward(weight: np.ndarray) -> np.ndarray:
    *lead, n, width = weight.shape
    beta = np.full((*lead, n + 1), -np.inf)
    beta[..., n] = 0
    for e in range(n, 0, -1):
        w = min(e, width)
        beta[..., e - w : e] = np.logaddexp(beta[..., e - w : e], (weight[..., e - 1, :w] + beta[..., e, None])[..., ::-1])
    return beta


def lattices(p: lattice.Pieces, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, down: np.ndarray):
    """(indexes of words, their pieces as group() has them, whether sums must be taken in logarithms) for words of one length at a time.
    Logarithms are for words over SHORT characters and for words with spelled characters, whose products may be too small."""
    for n, some in blocks(ends - starts):
        if n > lattice.SHORT:
            step = max(1, MOST_CELLS // (n * p.longest))
            for at in range(0, len(some), step):
                part = some[at : at + step]
                yield part, p.long_group(chars, starts[part], n, h, down), True
            continue
        ids = p.group(chars, starts[some], n, h, down)
        odd = (ids[:, :, 0] < -1).any(axis=1)
        for own, logs in ((~odd, False), (odd, True)):
            if own.any():
                yield (some, ids, logs) if own.all() else (some[own], ids[own], logs)


def expected_counts(p: lattice.Pieces, data: np.ndarray, off: np.ndarray, lang_of: np.ndarray, n_langs: int) -> np.ndarray:
    """Expected pieces per language over the words of texts back to back; lang_of[text] is -1 for texts not to learn from."""
    out = np.zeros((n_langs, p.size))
    chars, starts, ends, text_of = words(data, off)
    if not len(starts):
        return out
    h, down = lattice.rolling(chars)
    first, kind = lattice.distinct(h, down, starts, ends)
    lang = lang_of[text_of]
    use = lang >= 0
    times = np.bincount(kind[use] * n_langs + lang[use], minlength=len(first) * n_langs).reshape(-1, n_langs)
    for some, ids, logs in lattices(p, chars, starts[first], ends[first], h, down):
        n = ids.shape[1]
        prob = p.weights(ids, p.prior)
        if logs:
            with np.errstate(divide="ignore"):
                prob = np.log(prob)
            alpha, beta = log_forward(prob), log_backward(prob)
        else:
            alpha, beta = forward(prob), backward(prob)
        own = times[some]
        for w in range(ids.shape[2]):  # pieces of w + 1 characters, by their ends
            if logs:
                share = np.exp(alpha[:, : n - w] + prob[:, w:, w] + beta[:, w + 1 :] - alpha[:, n:])
            else:
                share = alpha[:, : n - w] * prob[:, w:, w] * beta[:, w + 1 :] / np.maximum(alpha[:, n:], 1e-300)
            row, at = np.nonzero(ids[:, w:, w] >= 0)
            piece, share = ids[row, at + w, w], share[row, at]
            for k in range(n_langs):
                out[k] += np.bincount(piece, weights=share * own[row, k], minlength=p.size)
    return out


def piece_counts(docs: DataFrame, text: str, lang: str, model: str = MODEL) -> DataFrame:
    """(lang, piece, n): expected counts over all rows of docs whose lang isn't null."""

    def build(batches):
        p, total, rows = lattice.load(model), {}, {}
        for part, data, off in text_slices(batches, text, SLICE):
            names, code = np.unique(np.array(part.column(part.schema.get_field_index(lang)).to_pylist(), object).astype(str), return_inverse=True)
            got = expected_counts(p, data, off, code, len(names))
            for i, name in enumerate(names.tolist()):
                total[name] = total.get(name, 0) + got[i]
                rows[name] = rows.get(name, 0) + int((code == i).sum())
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(counts[at], rows[name]))], ["lang", "piece", "n"])

    return docs.where(F.col(lang).isNotNull()).select(text, lang).mapInArrow(build, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", model: str = MODEL) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language names, log shares of rows, and piece probabilities [language, piece]. At most vocabulary x languages rows reach the driver."""
    got = piece_counts(docs, text, lang, model).toPandas()
    p = lattice.load(model)
    names = sorted(got["lang"].unique().tolist())
    prob, rows = np.zeros((len(names), p.size)), np.zeros(len(names))
    for i, name in enumerate(names):
        own = got[got["lang"] == name]
        piece, n = own["piece"].to_numpy(), own["n"].to_numpy()
        counts = PRIOR_COUNTS * p.prior
        counts[piece[piece >= 0]] += n[piece >= 0]
        prob[i], rows[i] = counts / counts.sum(), n[piece < 0].sum()
    return names, np.log(rows / max(rows.sum(), 1)) if len(names) else rows, prob


def log_likelihoods(p: lattice.Pieces, prob: np.ndarray, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[text, language], and whether the text has a letter."""
    chars, starts, ends, text_of = words(data, off)
    n_texts, n_langs = len(off) - 1, len(prob)
    some_letter = np.bincount(text_of, minlength=n_texts) > 0
    out = np.zeros((n_texts, n_langs))
    if not len(starts) or not n_langs:
        return out, some_letter
    h, down = lattice.rolling(chars)
    first, kind = lattice.distinct(h, down, starts, ends)
    each = np.zeros((len(first), n_langs))
    for some, ids, logs in lattices(p, chars, starts[first], ends[first], h, down):
        for k in range(n_langs):
            weight = p.weights(ids, prob[k])
            if logs:
                with np.errstate(divide="ignore"):
                    each[some, k] = log_forward(np.log(weight))[:, -1]
            else:
                each[some, k] = np.log(forward(weight)[:, -1])
    for k in range(n_langs):
        out[:, k] = np.bincount(text_of, weights=each[kind, k], minlength=n_texts)
    return out, some_letter


def predict(docs: DataFrame, names: list[str], shares: np.ndarray, prob: np.ndarray, text: str = "text", model: str = MODEL) -> DataFrame:
    """All columns of docs, with lang_pred and score (columns of these names are replaced)."""
    docs = docs.drop("lang_pred", "score")
    types = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "lang_pred string, score double"])
    sent = docs.sparkSession.sparkContext.broadcast((names, shares, prob))

    def build(batches):
        p, (langs, prior, own) = lattice.load(model), sent.value
        for part, data, off in text_slices(batches, text, SLICE):
            ll, ok = log_likelihoods(p, own, data, off)
            ok &= len(langs) > 0
            if len(langs):
                ll = ll + prior
                best = ll.argmax(axis=1)
                score = np.where(ok, 1 / np.exp(ll - ll.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
                pred = [langs[b] if y else "und" for b, y in zip(best, ok, strict=True)]
            else:
                pred, score = ["und"] * len(ok), np.zeros(len(ok))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score)], [*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(build, types)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(2)) == 2).alias("held_out"))
    names, shares, prob = train(docs.where("NOT held_out").select("text", "lang"))
    return predict(docs.select("doc_id", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out")), names, shares, prob).select("doc_id", "held_out", "lang_pred", "score")
