"""Ranked lexical search: the best documents of each item, by dense blocked matrix products.

A term is a maximal run of ASCII letters, digits and characters beyond ASCII, with A to Z lower-cased. The items' terms are a
vocabulary of bounded size (items come in blocks of at most BLOCK_PAIRS item terms), which is broadcast; one pass over the texts turns each document
into its number of terms and the counts of the vocabulary's terms, a table of a fraction of the texts' size. Sums over that table give the number of
documents N, of terms L and each term's document frequency, over the whole corpus.

A second pass over the small table ranks. For a tile of documents and a tile of items, the items' own terms are numbered from 0 (the compact vocabulary),
documents are rows of impacts (integers) over those and items columns of term weights (integers), in float64. The product is cut over terms so that
no partial sum can reach 2^53: products are exact, whatever the order in which BLAS adds, and parts are added as 64-bit integers. A tile keeps each item's
scores that are not below its k-th best one (ties included), then sorts by score and key. Tasks send k rows an item; a window ranks them.

A document's impact of a term is (10^9 * tf) div (1000 * tf + 8 * m), m = 100 - 90 + (90 * n * N) div L; a term's weight is
floor(1000 * ln((2 * N + 2) / (2 * df + 1))). Both are non-negative integers.

Null and empty texts have no terms: such documents count for nothing and such items find nothing. Repeated rows of documents are documents of their own
(equal scores, equal keys); repeated items are ranked each. Null keys of documents come last among equal scores. Documents without a term of an item don't appear. Long texts are
read whole. Other columns are left out, so that no name clashes. Keys of documents are integers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, give_back, table, text_slices
from tidemark.llm.wordhash import lower_ascii, runs, word_hashes

TOP = 10
#: Item terms (pairs of item and term) of a block of items at most, beyond one item; a block's vocabulary and items are broadcast.
BLOCK_PAIRS = 1_000_000
#: Rows, columns and terms of tiles.
DOC_TILE, ITEM_TILE, TERM_TILE = 512, 256, 4096
#: No impact reaches this.
MOST_IMPACT = 1_000_001
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True


def terms_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs(_INSIDE[data], off)


class Vocabulary:
    """Terms (bytes) by number, looked up by hash and confirmed by their bytes."""

    def __init__(self, terms: list[bytes]):
        data = np.frombuffer(b" ".join(terms), np.uint8)
        size = np.array([len(t) for t in terms], np.int64)
        start = np.cumsum(size + 1) - size - 1
        h = word_hashes(data, start, start + size) if len(terms) else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash, self.id, self.data, self.start, self.size = h[order], order, data, start, size
        self.maybe = np.zeros(1 << 18, bool)  # by low bits, to look up few of the words
        self.maybe[(h & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are terms, and their numbers. Two terms of one hash are not told apart by the hash alone: all of that hash are tried."""
        h = word_hashes(data, starts, ends)
        at = np.flatnonzero(self.maybe[(h & np.uint64((1 << 18) - 1)).astype(np.int64)])
        place = np.searchsorted(self.hash, h[at])
        found, ids = [], []
        while len(at):
            keep = place < len(self.hash)
            at, place = at[keep], place[keep]
            keep = self.hash[place] == h[at]
            at, place = at[keep], place[keep]
            if not len(at):
                break
            term = self.id[place]
            same = self.size[term] == ends[at] - starts[at]
            for size in np.unique(self.size[term[same]]):
                own = np.flatnonzero(same & (self.size[term] == size))
                for part in np.array_split(own, max(1, len(own) * int(size) >> 22)):
                    step = np.arange(size)
                    same[part] = (data[starts[at[part], None] + step] == self.data[self.start[term[part], None] + step]).all(axis=1)
            found.append(at[same])
            ids.append(term[same])
            at, place = at[~same], place[~same] + 1
        return (np.concatenate(found), np.concatenate(ids)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, terms ARRAY<BINARY>): each item's distinct terms."""
    kind = items.schema[item].dataType.simpleString()

    def build(batches):
        for part, data, off in text_slices(batches, text, 1 << 20):
            low = lower_ascii(data)
            starts, ends, first = terms_of(low, off)
            raw = low.tobytes()
            own = [sorted({raw[a:b] for a, b in zip(starts[i:j].tolist(), ends[i:j].tolist(), strict=True)}) for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.list_(pa.binary()))], ["item", "terms"])

    return items.select(item, text).mapInArrow(build, f"item {kind}, terms array<binary>")


def count_terms(docs: DataFrame, terms: list[bytes], key: str, text: str) -> DataFrame:
    """(key, n, ids, tfs): a document's number of terms, and the counts of those in the vocabulary; rows without terms are left out."""
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def build(batches):
        known = Vocabulary(sent.value)
        for part, data, off in text_slices(batches, text, 2 << 20):
            low = lower_ascii(data)
            starts, ends, first = terms_of(low, off)
            n = np.diff(first)
            at, ids = known.find(low, starts, ends)
            row = np.searchsorted(first, at, "right") - 1
            pair, tf = np.unique(row * len(known.size) + ids, return_counts=True)
            row, ids = np.divmod(pair, max(1, len(known.size)))
            bound = np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(bound), pa.array(x.astype(np.int32))) for x in (ids, tf)]
            out = pa.RecordBatch.from_arrays([part.column(0), pa.array(n), *lists], ["key", "n", "ids", "tfs"])
            yield out.filter(pa.array(n > 0))

    return docs.select(key, text).mapInArrow(build, f"key {kind}, n bigint, ids array<int>, tfs array<int>")


def best_of_tile(score: np.ndarray, keys: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, score, key) of the k best positive scores of each column of score[doc, item] that reach least, by score and then least key: none of equal scores is lost before keys decide."""
    if len(score) > k:
        least = np.maximum(least, np.partition(score, len(score) - k, axis=0)[len(score) - k])
    doc, item = np.nonzero((score >= least) & (score > 0))
    return top_rows(item, score[doc, item], keys[doc], k)


def top_rows(item: np.ndarray, score: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort([keys, -score, item])
    item, score, keys = item[order], score[order], keys[order]
    place = np.arange(len(item)) - np.searchsorted(item, item)
    return item[place < k], score[place < k], keys[place < k]


def rank_tiles(batches, weight: np.ndarray, items: list[np.ndarray], corpus: tuple[int, int], k: int):
    """For Arrow batches of (key, n, ids, tfs): (item, score, key) of the k best documents of each item."""
    n_docs, n_terms = corpus
    tiles = []
    for a in range(0, len(items), ITEM_TILE):
        own = items[a : a + ITEM_TILE]
        compact = np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64)
        matrix = np.zeros((len(compact), len(own)))
        for j, ids in enumerate(own):
            matrix[np.searchsorted(compact, ids), j] = weight[ids]
        tiles.append((a, len(own), compact, matrix))
    width = min(TERM_TILE, int((2**53 - 1) // (MOST_IMPACT * max(1, int(weight.max(initial=0))))))
    none = np.iinfo(np.int64).max  # of a null key: after all others
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    least = np.ones(len(items), np.int64)
    for batch in batches:
        keys = batch.column(0).cast(pa.int64()).fill_null(none).to_numpy()
        n, lists = batch.column(1).to_numpy(), batch.column(2)
        off = lists.offsets.to_numpy()
        ids, tf = (batch.column(c).values.to_numpy()[off[0] : off[-1]].astype(np.int64) for c in (2, 3))
        off = off - off[0]
        m = 10 + (90 * n * n_docs) // n_terms
        row = np.repeat(np.arange(len(n)), np.diff(off))
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
        for d in range(0, len(n), DOC_TILE):
            e = min(d + DOC_TILE, len(n))
            own = slice(int(off[d]), int(off[e]))
            for a, size, compact, matrix in tiles:
                place = np.searchsorted(compact, ids[own])
                hit = place < len(compact)
                hit[hit] = compact[place[hit]] == ids[own][hit]
                at, where, value = place[hit], row[own][hit] - d, impact[own][hit]
                score = np.zeros((e - d, size), np.int64)
                for c in range(0, len(compact), width):
                    inside = (at >= c) & (at < c + width)
                    dense = np.zeros((e - d, min(width, len(compact) - c)))
                    dense[where[inside], at[inside] - c] = value[inside]
                    score += (dense @ matrix[c : c + width]).astype(np.int64)
                item, points, doc = best_of_tile(score, keys[d:e], k, least[a : a + size])
                if len(item):
                    best = top_rows(*(np.concatenate([x, y]) for x, y in zip(best, (item + a, points, doc), strict=True)), k)
                    tail = np.flatnonzero(np.bincount(best[0], minlength=len(items)) >= k)
                    least[tail] = best[1][np.searchsorted(best[0], tail, "right") - 1]
    return best


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = TOP, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(item, rank, key, score) with the names of the item's and the documents' keys: each item's k documents of the largest score over 0."""
    listed = cut(item_terms(items, item, item_text), "item-terms")
    pairs = listed.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-pairs // block_pairs))
    out = None
    for b in range(blocks):  # one block for up to block_pairs pairs
        own = listed.where(F.pmod(F.xxhash64("item", "terms"), F.lit(blocks)) == b).toArrow()
        ranked = search_block(docs, own, listed.schema["item"].dataType.simpleString(), key, text, k)
        out = ranked if out is None else out.unionByName(ranked)
    names = {"item": item, "key": key}
    return out.select(*(F.col(c).alias(names.get(c, c)) for c in ("item", "rank", "key", "score")))


def search_block(docs: DataFrame, own: pa.Table, kind: str, key: str, text: str, k: int) -> DataFrame:
    """search() for the items (item, terms) of one block; kind is the type of the item's key."""
    terms = sorted({t for r in own.column("terms").to_pylist() for t in r})
    number = {t: i for i, t in enumerate(terms)}
    items = [np.array([number[t] for t in r], np.int64) for r in own.column("terms").to_pylist()]
    counted = cut(count_terms(docs, terms, key, text), "term-counts")
    total = counted.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    df = counted.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df")).toArrow()  # at most a row a term of the block
    weight = np.zeros(len(terms), np.int64)
    for i, n in zip(df.column("id").to_pylist(), df.column("df").to_pylist(), strict=True):
        weight[i] = math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * n + 1)))
    share = docs.sparkSession.sparkContext.broadcast
    sent = share((weight, items, (total["n"], total["l"] or 1)))
    values = own.column("item").combine_chunks()
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    ids = share(values)

    def build(batches):
        item, score, keys = rank_tiles(batches, *sent.value, k)
        null = keys == np.iinfo(np.int64).max
        yield pa.RecordBatch.from_arrays([pa.array(item), ids.value.take(pa.array(item)), pa.array(score), pa.array(keys, mask=null)], ["place", "item", "score", "key"])
        give_back()

    some = counted.where(F.size("ids") > 0).mapInArrow(build, f"place bigint, item {kind}, score bigint, key bigint")
    w = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return some.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item", "rank", "key", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM d GROUP BY doc_id),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
counts AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, corpus GROUP BY term),
scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (doc_id), corpus GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
