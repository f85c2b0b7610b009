"""Toxicity scores of texts, after a noisy-channel restoration of disguised words.

A span is suspicious when letters mix with look-alike digits or symbols (1d10t), when a letter stands
three or more times in a row (stuuupid), or when four or more letters stand alone between single
separators (i d i o t). Its characters form a lattice: a letter stays or, in a run of one letter, goes;
a look-alike becomes one of its letters or goes; a separator goes; each at a cost. Viterbi decoding under a
character trigram model finds the cheapest restored word. The model's counts are summed over all texts
(characters reach the driver as at most ALPHABET ** 3 sums) and, for scoring, mixed with the trigrams of
the learnt words.

Words and word beginnings of the restored text are the features. Learning counts, per feature, labelled
texts and toxic ones, over a sample of at most about MOST_ROWS labelled rows (by hash, copies once); a
feature is kept when it stands in toxic texts far beyond chance; the sample bounds their number. The score
is the noisy-or of the kept features and the base rate.

Null and empty texts, and any text without a kept feature, have the base rate's score. Null labels and null keys are not learnt from.
Repeated rows get equal scores. With no label, or one class only, the score is the base rate. Long texts are read whole.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import give_back, table, text_slices

MOST_ROWS = 16_000
THRESHOLD = 0.7
#: Word beginnings of these lengths are features beside whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Letters that look-alikes stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i"}
SWAP, DROP_REPEAT, DROP_SEPARATOR, DROP_OTHER = 0.7, 0.4, 0.1, 3.0
SEPARATORS = " .-_*"
ALPHABET = 28  # 0: edge of a word, 1 to 26: a to z, 27: any other letter
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][ .\-_*]){3,}[^\W_](?![^\W_])")
_WORD = re.compile(r"[^\W\d_]+")
_THRICE = re.compile(r"([^\W\d_])\1\1")
_TRIM = " .,;:!?*#%&$|\"'()[]{}<>…\n\t"


def code(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else 27


def byte_codes() -> np.ndarray:
    """Of UTF-8 bytes: letters by their code, lead bytes of longer characters as other letters, the rest an edge; 255: skip."""
    out = np.zeros(256, np.uint8)
    for b in range(26):
        out[65 + b] = out[97 + b] = b + 1
    out[0xC3:] = 27
    out[0x80:0xC0] = 255
    return out


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n) over all texts; grams run over word edges."""

    def build(batches):
        codes, total = byte_codes(), np.zeros(ALPHABET**3, np.int64)
        for _, data, off in text_slices(batches, text, 1 << 20):
            c = codes[data]
            c = c[c < 255].astype(np.int32)
            c = np.concatenate([[0], c[(c > 0) | (np.concatenate([[1], c[:-1]]) > 0)], [0, 0]])
            total += np.bincount((c[:-2] * ALPHABET + c[1:-1]) * ALPHABET + c[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])

    return docs.select(text).mapInArrow(build, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(counts: np.ndarray, words: dict[str, float] | None = None, share: float = 0.3) -> np.ndarray:
    """Costs (negative logs) of a letter after two others; words, with weights, add a share of their own trigrams."""

    def conditional(c: np.ndarray) -> np.ndarray:
        tri = c.reshape(ALPHABET, ALPHABET, ALPHABET)
        uni = (tri.sum(axis=(0, 1)) + 1) / (tri.sum() + ALPHABET)
        bi = (tri.sum(axis=0) + 20 * uni) / (tri.sum(axis=(0, 2))[:, None] + 20)
        return (tri + 20 * bi[None]) / (tri.sum(axis=2, keepdims=True) + 20)

    prob = conditional(counts.astype(float))
    if words:
        own = np.zeros(ALPHABET**3)
        for w, weight in words.items():
            c = [0, 0, *map(code, w), 0]
            for x, y, z in zip(c, c[1:], c[2:], strict=False):
                own[(x * ALPHABET + y) * ALPHABET + z] += weight
        own = own.reshape(prob.shape)
        seen = own.sum(axis=2, keepdims=True)
        prob = (1 - share) * prob + share * np.where(seen > 0, own / np.maximum(seen, 1e-9), prob)
    return -np.log(prob)


def restore(span: str, cost: np.ndarray) -> str:
    """The cheapest restored word of a suspicious span."""
    span = span.lower()
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for i, ch in enumerate(span):
        options: list[tuple[str, float]] = []
        if ch.isalpha():
            options.append((ch, 0.0))
            if i and span[i - 1] == ch:
                options.append(("", DROP_REPEAT))
        else:
            options += [(x, SWAP) for x in LOOKALIKES.get(ch, "")]
            options.append(("", DROP_SEPARATOR if ch in SEPARATORS else DROP_OTHER))
        step: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (c, word) in best.items():
            for x, more in options:
                k = code(x) if x else 0
                to, price = ((b, k), c + more + cost[a, b, k]) if x else ((a, b), c + more)
                if to not in step or price < step[to][0]:
                    step[to] = (price, word + x)
        best = step
    return min((c + cost[a, b, 0], w) for (a, b), (c, w) in best.items())[1]


def suspicious(text: str) -> list[str]:
    """Disguised spans of a text."""
    found = [m[0] for m in _SPACED.finditer(text)]
    for w in set(text.split()):
        if not w.isalpha():
            w = w.strip(_TRIM[:-2]) if w[:1] != "$" else w.rstrip(_TRIM)
            if not w.isalpha() and sum(map(str.isalpha, w)) * 3 >= len(w) and any(c in LOOKALIKES for c in w):
                found.append(w)
                continue
        if len(w) > 4 and _THRICE.search(w):
            found.append(w)
    return found


def features(text: str, decode) -> set[str]:
    """Words and word beginnings ('begin*') of the text and of its restored spans."""
    words = set(_WORD.findall(text.lower()))
    words.update(decode(x) for x in suspicious(text))
    out = set(words)
    for k in BEGINNINGS:
        out.update([w[:k] + "*" for w in words if len(w) > k])
    return out


def decoder(cost: np.ndarray):
    return lru_cache(maxsize=20_000)(lambda span: restore(span, cost))


def collect_counts(docs: DataFrame, text: str) -> np.ndarray:
    got = trigram_counts(docs, text).toPandas()
    counts = np.zeros(ALPHABET**3)
    counts[got["gram"].to_numpy()] = got["n"].to_numpy()
    return counts


def learn(docs: DataFrame, labelled: DataFrame, text: str = "text", label: str = "toxic") -> dict:
    """The model, from the texts of docs (character model) and the labelled rows (text, label): a dict of costs, features' probabilities and the base rate."""
    counts = collect_counts(docs, text)
    cost = language_model(counts)
    labelled = labelled.where(F.col(label).isNotNull()).select(F.coalesce(F.col(text), F.lit("")).alias("text"), (F.col(label) == 1).cast("int").alias("y"))
    n = labelled.count()
    share = min(1.0, MOST_ROWS / max(n, 1))
    some = labelled.withColumn("h", F.xxhash64("text")).where((F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))).dropDuplicates(["h", "y"]).select("text", "y")
    sent = docs.sparkSession.sparkContext.broadcast(cost)

    def build(batches):
        decode = decoder(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([["", *features(t, decode)] for t in batch.column(0).to_pylist()], pa.list_(pa.string())), batch.column(1)], ["fs", "y"])

    each = some.mapInArrow(build, "fs array<string>, y int").select(F.explode("fs").alias("f"), "y").groupBy("f").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    each = each.where("n >= 3").persist()
    total = each.agg(F.count("*").alias("features"), F.max(F.when(F.col("f") == "", F.col("n"))).alias("rows"), F.max(F.when(F.col("f") == "", F.col("k"))).alias("toxic")).first()
    rows, toxic = total["rows"] or 0, total["toxic"] or 0
    base = (toxic + 0.5) / (rows + 10) if rows else 0.05
    # beyond chance: the expected number of features as toxic as this one, were labels dealt at random, is under 0.1
    odds = F.col("k") * F.log((F.col("k") / F.col("n")) / base) + F.when(F.col("k") < F.col("n"), (F.col("n") - F.col("k")) * F.log((1 - F.col("k") / F.col("n")) / (1 - base))).otherwise(0.0)
    kept = each.where("f != '' AND k >= 3 AND k / n >= 0.85").withColumn("odds", odds).where(F.col("odds") > math.log(10 * max(total["features"], 1))).orderBy("f").collect()
    each.unpersist()
    prob = {r["f"]: (r["k"] + base) / (r["n"] + 1) for r in kept}
    words = {r["f"]: float(r["k"]) for r in kept if not r["f"].endswith("*")}
    return {"cost": language_model(counts, words), "prob": prob, "base": base if not prob else base / 4}


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """All columns of docs and score DOUBLE (a column of that name is replaced)."""
    docs = docs.drop("score")
    types = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "score double"])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def build(batches):
        m = sent.value
        decode, prob, keys = decoder(m["cost"]), m["prob"], m["prob"].keys()
        for batch in batches:
            out = []
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                rest = 1 - m["base"]
                for f in sorted(features(t, decode) & keys) if t else ():
                    rest *= 1 - prob[f]
                out.append(1 - rest)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "score"])
        give_back()

    return docs.mapInArrow(build, types)


def train_on(docs: DataFrame, labels: DataFrame) -> dict:
    """Learns from the rows of labels whose crc32(doc_id as text) mod 3 is not 1."""
    own = labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).select("doc_id", F.col("toxic").alias("_y"))
    return learn(docs, docs.select("doc_id", "text").join(own, "doc_id").select("text", F.col("_y").alias("toxic")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_on(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
