"""Quality scores by nearest-neighbour votes in a latent-semantic space.

A text's terms are its words (runs without white space, A to Z lower-cased), the shapes of its words (runs of letters of one case, digits and other characters, each run of
equal kind as one) and repeats of the word before. Words and shapes are hashed to WORDS and SHAPES buckets; words and the rest are two parts of a vector, each
(1 + ln tf) * idf, brought to length one and joined. Document frequencies are summed over all documents.

The latent space is the leading RANK right singular vectors of the labelled rows' vectors (a seeded subspace iteration), and labelled rows become points in it. At most about
MOST_ROWS keys of each class are taken, by their hash, and copies of a text once; that bounds what is broadcast. Every document is projected, brought to length one and rounded to
2^-20, so that cosines against all labelled points are exact integers in float64, computed in blocks. Its neighbours are the K nearest points and all that lie as near as the
K-th; their labels are weighted by similarity (0 if negative) and by how many labelled rows of its class a point stands for. The score is the share of label 1.

Null and empty texts, and texts near to no point, get the labelled rows' base rate; with no labels it is 0.5. Null labels and null keys are not learnt from. With one class only the
score is 0 or 1 as it says. Equal texts get equal scores, whatever the other rows of a task. Long texts are read whole. Columns of docs pass through; one named score is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import give_back, table, text_slices
from tidemark.llm.wordhash import word_hashes, word_spans

WORDS, SHAPES = 4096, 1024
BUCKETS = WORDS + SHAPES
#: Labelled rows of each class that the classifier is fitted to, about.
MOST_ROWS = 2000
RANK, K, TILE, ONE = 64, 25, 256, 1 << 20
THRESHOLD = 0.3
#: Length of the part of words beside that of shapes.
WORD_SHARE = 0.5
_KIND = np.arange(256, dtype=np.uint8)
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 48, 65, 97, 97
_REPEAT = BUCKETS - 1


def terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, tf) of texts back to back, by row and bucket."""
    starts, ends, first = word_spans(data, off)
    row = np.searchsorted(first, np.arange(len(starts)), "right") - 1
    words = word_hashes(data, starts, ends, lower=True)
    again = np.flatnonzero((words[1:] == words[:-1]) & (row[1:] == row[:-1]))
    kind = _KIND[data]
    kept = np.ones(len(kind), bool)
    kept[1:] = kind[1:] != kind[:-1]
    kept[starts] = True
    place = np.concatenate([[0], np.cumsum(kept)])
    shapes = word_hashes(kind[kept], place[starts], place[ends])
    bucket = np.concatenate([words % np.uint64(WORDS), np.uint64(WORDS) + shapes % np.uint64(SHAPES - 1), np.full(len(again), _REPEAT, np.uint64)]).astype(np.int64)
    pair, tf = np.unique(np.concatenate([row, row, row[again]]) * BUCKETS + bucket, return_counts=True)
    return pair // BUCKETS, pair % BUCKETS, tf


def frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many documents each bucket occurs, and the number of documents, over all rows."""

    def build(batches):
        df, n = np.zeros(BUCKETS, np.int64), 0
        for part, data, off in text_slices(batches, text, 1 << 20):
            df += np.bincount(terms(data, off)[1], minlength=BUCKETS)
            n += part.num_rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["bucket", "n"])

    got = docs.select(text).mapInArrow(build, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row a bucket
    df = np.zeros(BUCKETS + 1, np.int64)
    df[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return df[:-1], int(df[-1])


def vectors(rows: int, row: np.ndarray, bucket: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Dense vectors [row, bucket], words and shapes each of a fixed length; a text without terms is zero."""
    out = np.zeros((rows, BUCKETS))
    out[row, bucket] = (1 + np.log(tf)) * idf[bucket]
    for part, length in ((slice(0, WORDS), WORD_SHARE), (slice(WORDS, BUCKETS), 1.0)):
        norm = np.sqrt(np.einsum("ij,ij->i", out[:, part], out[:, part]))
        out[:, part] *= (length / np.where(norm > 0, norm, 1.0))[:, None]
    return out


def points(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors of the latent space in steps of 1 / ONE, as integers in float64."""
    p = x @ axes
    norm = np.sqrt(np.einsum("ij,ij->i", p, p))[:, None]
    return np.rint(np.where(norm > 1e-9, p / np.where(norm > 1e-9, norm, 1.0), 0.0) * ONE)


def leading_axes(a: np.ndarray, rank: int, rounds: int = 6, seed: int = 0) -> np.ndarray:
    """Leading right singular vectors, by seeded subspace iteration."""
    rank = max(1, min(rank, *a.shape))
    q = np.random.default_rng(seed).standard_normal((a.shape[1], min(rank + 16, *a.shape)))
    for _ in range(rounds):
        q, _ = np.linalg.qr(a.T @ (a @ q))
    _, _, v = np.linalg.svd(a @ q, full_matrices=False)
    return (q @ v.T)[:, :rank]


def votes(p: np.ndarray, known: np.ndarray, label: np.ndarray, weight: np.ndarray, base: float, k: int = K) -> np.ndarray:
    """Scores of points against known points: cosines in one product, then the labels of the k nearest and of all as near as the k-th."""
    if not len(known):
        return np.full(len(p), base)
    cos = p @ known.T  # integers below 2^53: exact, whatever the block
    least = np.partition(cos, len(known) - k, axis=1)[:, len(known) - k] if len(known) > k else cos.min(axis=1)
    near = np.where((cos >= least[:, None]) & (cos > 0), cos, 0.0) / (ONE * ONE) * weight
    total = near.sum(axis=1)
    return np.where(total > 0, near @ label / np.where(total > 0, total, 1.0), base)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most_rows: int = MOST_ROWS) -> dict:
    """The model from the texts of docs (frequencies) and labels (key, label) of some of them. Keys to learn from are drawn first, so that no text is shuffled to be labelled."""
    df, n = frequencies(docs, text)
    idf = np.log((n + 1) / (df + 1)) + 0.1
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), (F.col(label) == 1).cast("int").alias("y")).distinct()
    count = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("y") == 1, int(min(1.0, most_rows / max(count.get(1, 0), 1)) * (1 << 30))).otherwise(int(min(1.0, most_rows / max(count.get(0, 0), 1)) * (1 << 30)))
    drawn = known.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share)  # about 2 * most_rows keys
    some = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(drawn), "key")
    some = some.withColumn("h", F.xxhash64("text")).dropDuplicates(["h", "y"])

    def build(batches):
        for part, data, off in text_slices(batches, "text", 1 << 20):
            row, bucket, tf = terms(data, off)
            bound = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(bound), pa.array(x.astype(np.int32))) for x in (bucket, tf)]
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), *lists], ["y", "h", "ids", "tfs"])

    got = some.select("text", "y", "h").mapInArrow(build, "y int, h bigint, ids array<int>, tfs array<int>").orderBy("h", "y").toArrow().combine_chunks()  # about 2 * most_rows rows of at most BUCKETS pairs
    y = got.column("y").to_numpy().astype(float)
    base = count.get(1, 0) / sum(count.values()) if count else 0.5
    if not len(y):
        return {"idf": idf, "axes": np.zeros((BUCKETS, 1)), "known": np.zeros((0, 1)), "label": y, "weight": y, "base": base}
    ids, tfs = (got.column(c).combine_chunks() for c in ("ids", "tfs"))
    x = vectors(len(y), np.repeat(np.arange(len(y)), np.diff(ids.offsets.to_numpy())), ids.flatten().to_numpy(), tfs.flatten().to_numpy(), idf)
    axes = leading_axes(x, RANK)
    weight = np.where(y == 1, count.get(1, 0) / max(1, (y == 1).sum()), count.get(0, 0) / max(1, (y == 0).sum()))
    return {"idf": idf, "axes": axes, "known": points(x, axes), "label": y, "weight": weight / weight.max(), "base": base}


def score(docs: DataFrame, model: dict, text: str = "text", k: int = K) -> DataFrame:
    """All columns of docs and score DOUBLE."""
    docs = docs.drop("score")
    types = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "score double"])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def build(batches):
        m = sent.value
        for part, data, off in text_slices(batches, text, 1 << 20):
            row, bucket, tf = terms(data, off)
            out = np.empty(part.num_rows)
            for a in range(0, part.num_rows, TILE):
                b = min(a + TILE, part.num_rows)
                own = slice(*np.searchsorted(row, [a, b]))
                p = points(vectors(b - a, row[own] - a, bucket[own], tf[own], m["idf"]), m["axes"])
                out[a:b] = votes(p, m["known"], m["label"], m["weight"], m["base"], k)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out)], [*part.schema.names, "score"])
        give_back()

    return docs.mapInArrow(build, types)


def train_on(docs: DataFrame, labels: DataFrame) -> dict:
    """Learns from the rows of labels whose crc32(doc_id as text) mod 5 is not 0."""
    return learn(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select("doc_id", "quality"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out")
    return score(docs, train_on(docs, table(spark, sf_dir, "labels"))).select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
