"""Removal of repeated word sequences: windows of WINDOW words that also start earlier.

Suffixes of the corpus are compared up to WINDOW words only. They are thinned first, without loss: of the
WINDOW - ANCHOR + 1 anchors (ANCHOR words) inside a window, the one with the least hash is the window's
anchor, so equal windows have equal anchors, and a window whose anchor is found once in the corpus repeats
nothing. Counting anchors is a map-side combined aggregation, and only windows with a repeated anchor go on.

Their suffixes are split by variable-length prefixes. The prefix is the anchor (ANCHOR words) as long as its
group fits in memory (GROUP suffix runs). In a larger group the prefix is lengthened to all words of a run: runs with equal
words are one leaf, the earliest, and all others repeat it as a whole; mostly what is left fits. Where it doesn't, the prefix is
lengthened to a window; there each group is one node at depth WINDOW, whose earliest leaf is a minimum that needs no task that holds the group, and no pairs.

Groups that fit go whole to tasks, which build each group's suffix subtree as its suffix array, by doubling, with the lengths of common
prefixes of neighbours. Suffixes go on to the end of their run. An internal node of depth d is a stretch of neighbours with d words in
common. Nodes of WINDOW words and more are the deep ones: of the deepest node that holds a leaf and an earlier one, d - WINDOW + 1
windows from that leaf on repeat, and leaves whose left neighbour in the text says so already are left out, so what is returned are the maximal repeats.

Decisions return to the documents as runs of repeated windows; words under them are removed. Windows are
judged on the input. Words are compared by 64-bit hashes inside a group of equal anchors, and runs and windows of the split groups by
128-bit ones; anchors (64-bit) only select. Other columns, whatever their names, are not read.

Null and empty texts: no words. Null ids count as smaller than all ids. Rows with equal id and equal text
count as one document, and each of them is returned with that document's result; rows with equal ids and
different texts are ordered by the text's hash.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import wordhash
from tidemark.llm.common import cut, table, text_slices

WINDOW, ANCHOR = 20, 6
#: Suffix runs of one prefix that a task builds a subtree of; longer prefixes split larger groups.
GROUP = 2000
SLICE = 4 << 20


def anchors(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts' words back to back: for each run of windows with one anchor, the anchor's hash, its place, and the run's first window and count."""
    span = WINDOW - ANCHOR + 1
    grams = wordhash.gram_hashes(words, ANCHOR)
    n = len(words) - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return grams[:0], none, none, none
    # the place of the least hash of each window; the leftmost of equal ones
    best, place = grams[:n].copy(), np.zeros(n, np.int64)
    for i in range(1, span):
        less = grams[i : i + n] < best
        np.copyto(best, grams[i : i + n], where=less)
        place[less] = i
    text_of = np.searchsorted(at, np.arange(n), "right") - 1
    ok = np.arange(n) + WINDOW <= at[text_of + 1]
    place += np.arange(n)
    first = ok.copy()
    first[1:] &= ~ok[:-1] | (place[1:] != place[:-1]) | (text_of[1:] != text_of[:-1])
    runs = np.flatnonzero(first)
    bounds = np.flatnonzero(np.concatenate([first | ~ok, [True]]))
    count = bounds[np.searchsorted(bounds, runs, "right")] - runs
    return best[runs], place[runs], runs, count


def _identity(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, rank, text): rank orders rows of one id; equal rows have equal ranks."""
    return df.select(F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("rank"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def anchor_counts(docs: DataFrame) -> DataFrame:
    def build(batches):
        for part, data, off in text_slices(batches, "text", SLICE):
            starts, ends, at = wordhash.word_spans(data, off)
            a, n = np.unique(anchors(wordhash.word_hashes(data, starts, ends), at)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n.astype(np.int32))], ["anchor", "n"])

    return docs.select("text").mapInArrow(build, "anchor bigint, n int").groupBy("anchor").agg(F.sum("n").alias("n"))


def anchor_runs(docs: DataFrame, id_type: str) -> DataFrame:
    """(id, rank, anchor, pos): where each anchor stands, by the run's first window."""

    def build(batches):
        for part, data, off in text_slices(batches, "text", SLICE):
            starts, ends, at = wordhash.word_spans(data, off)
            a, _, first, _ = anchors(wordhash.word_hashes(data, starts, ends), at)
            text_of = np.searchsorted(at, first, "right") - 1
            take = pa.array(text_of)
            yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(a.view(np.int64)), pa.array((first - at[text_of]).astype(np.int32))], ["id", "rank", "anchor", "pos"])

    return docs.select("id", "rank", "text").mapInArrow(build, f"id {id_type}, rank bigint, anchor bigint, pos int")


def packed(docs: DataFrame, id_type: str) -> DataFrame:
    """(id, rank, z): texts compressed, as they are shuffled by id."""

    def build(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([press.compress(t.encode()) for t in batch.column(2).to_pylist()], pa.binary())], ["id", "rank", "z"])

    return docs.select("id", "rank", "text").mapInArrow(build, f"id {id_type}, rank bigint, z binary")


def unpack(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def as_slice(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def suffix_runs(found: DataFrame, id_type: str) -> DataFrame:
    """From (id, rank, z, hits ARRAY<STRUCT<pos, large>>): (id, rank, pos, n, anchor, words, run_key), where words are the run's text
    from its first window to its last one's end, and run_key, for large groups only, the hash of these words."""

    def build(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [unpack(z) for z in part.column(2).to_pylist()]
                data, off = as_slice(texts)
                starts, ends, at = wordhash.word_spans(data, off)
                a, place, first, count = anchors(wordhash.word_hashes(data, starts, ends), at)
                hits = part.column(3).flatten()
                row = np.repeat(np.arange(part.num_rows), np.diff(part.column(3).offsets.to_numpy()))
                want = at[row] + hits.field(0).to_numpy(zero_copy_only=False)
                large = hits.field(1).to_numpy(zero_copy_only=False)
                at_run = np.searchsorted(first, want)
                last = want + count[at_run] + WINDOW - 2
                raw, words, whole = data.tobytes(), [], []
                for u, v, w, z, big in zip(starts[want].tolist(), ends[last].tolist(), want.tolist(), last.tolist(), large.tolist(), strict=True):
                    words.append(raw[u:v])
                    whole.append(run_hash([raw[starts[i] : ends[i]] for i in range(w, z + 1)]) if big else None)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(take), part.column(1).take(take), hits.field(0), pa.array(count[at_run].astype(np.int32)),
                    pa.array(a[at_run].view(np.int64)), pa.array(words, pa.binary()), pa.array(whole, pa.binary()),
                ], ["id", "rank", "pos", "n", "anchor", "words", "run_key"])

    return found.mapInArrow(build, f"id {id_type}, rank bigint, pos int, n int, anchor bigint, words binary, run_key binary")


def run_hash(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b"\0".join(words), digest_size=16).digest()


def suffix_array(words: np.ndarray, longest: int, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes that begin at leaves, and the lengths of common prefixes of neighbours in it; no two suffixes have
    longest words in common. By doubling: ranks of 1, 2, 4, ... words."""
    ranks = [words]
    while 1 << (len(ranks) - 1) < longest:
        r, step = ranks[-1], 1 << (len(ranks) - 1)
        after = np.zeros(len(r), np.int64)
        after[:-step] = r[step:] + 1
        ranks.append(np.unique(r * (int(after.max()) + 1) + after, return_inverse=True)[1])
    order = np.argsort(ranks[-1][leaves])
    a, b = leaves[order[:-1]], leaves[order[1:]]
    common = np.zeros(len(a), np.int64)
    for j in range(len(ranks) - 2, -1, -1):
        common += (ranks[j][a + common] == ranks[j][b + common]).astype(np.int64) << j
    return order, common


def subtree(runs: list[tuple]) -> list[tuple[int, int, int]]:
    """Maximal repeats among runs (order, n, words), orders being comparable, as (run, window, windows): those that start earlier, too."""
    data, off = as_slice([r[2] for r in runs])
    starts, ends, at = wordhash.word_spans(data, off)
    numbers = np.unique(wordhash.word_hashes(data, starts, ends), return_inverse=True)[1]
    sizes = np.diff(at)
    head = at[:-1] + np.arange(len(runs))  # an end of its own after each run
    words = np.empty(len(numbers) + len(runs), np.int64)
    words[np.arange(len(numbers)) + np.repeat(np.arange(len(runs)), sizes)] = numbers
    words[head + sizes] = len(numbers) + np.arange(len(runs))
    count = np.array([r[1] for r in runs])
    run = np.repeat(np.arange(len(runs)), count)
    window = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    order, common = suffix_array(words, int(sizes.max()) + 1, head[run] + window)
    rank = np.empty(len(runs), np.int64)
    rank[sorted(range(len(runs)), key=lambda i: runs[i][0])] = np.arange(len(runs))
    place = (rank[run] * (int(count.max()) + 1) + window)[order]
    depth = np.zeros(len(run), np.int64)
    for d in range(WINDOW, int(common.max(initial=0)) + 1):
        node = np.concatenate([[0], np.flatnonzero(common < d) + 1])
        inner = np.diff(np.append(node, len(order))) > 1
        later = place > np.repeat(np.where(inner, np.minimum.reduceat(place, node), np.iinfo(np.int64).max), np.diff(np.append(node, len(order))))
        depth[order[later]] = d
    told = np.zeros(len(run), bool)
    told[1:] = (run[1:] == run[:-1]) & (depth[:-1] > depth[1:])
    return [(int(run[i]), int(window[i]), int(depth[i]) - WINDOW + 1) for i in np.flatnonzero((depth > 0) & ~told)]


def subtrees(runs: DataFrame, id_type: str) -> DataFrame:
    """(id, rank, pos, n) of repeats: subtrees of the groups of each anchor, read in order of anchors."""

    def build(batches):
        rows: list[tuple] = []  # (id, rank, pos, n, anchor, words)

        def flush(rows, id_arrow):
            out = [(*rows[i][:2], rows[i][2] + w, n) for i, w, n in subtree([((r[0] is not None, r[0] if r[0] is not None else 0, r[1], r[2]), r[3], r[5]) for r in rows])]
            types = (id_arrow, pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], ["id", "rank", "pos", "n"])

        id_arrow = None
        for batch in batches:
            id_arrow = batch.schema.field(0).type
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(rows) >= 2 * GROUP and r[4] != rows[-1][4]:
                    yield flush(rows, id_arrow)
                    rows = []
                rows.append(r)
        if rows:
            yield flush(rows, id_arrow)

    return runs.select("id", "rank", "pos", "n", "anchor", "words").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(build, f"id {id_type}, rank bigint, pos int, n int")


def windows_of(runs: DataFrame) -> DataFrame:
    """(key, leaf) of each window of runs (leaf, words)."""

    def build(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                row, at, keys = [], [], []
                for i, text in enumerate(part.column(0).to_pylist()):
                    words = re.findall(rb"[^\x20\x09-\x0D]+", text)
                    for k in range(len(words) - WINDOW + 1):
                        row.append(i)
                        at.append(k)
                        keys.append(run_hash(words[k : k + WINDOW]))
                leaf = part.column(1).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(at, pa.int32()), leaf], ["key", "k", "leaf"])

    leaf_type = runs.schema["leaf"].dataType.simpleString()
    each = runs.select("words", "leaf").mapInArrow(build, f"key binary, k int, leaf {leaf_type}")
    return each.select("key", F.struct("leaf.id", "leaf.rank", (F.col("leaf.pos") + F.col("k")).alias("pos")).alias("leaf"))


def repeats(runs: DataFrame, id_type: str) -> DataFrame:
    """(id, rank, pos, n) of repeats in all groups."""
    # large groups: leaves with the words of a whole run in common are one, the earliest; the others are repeats
    large = runs.where("run_key IS NOT NULL").select("run_key", F.struct("id", "rank", "pos").alias("leaf"), "n", "anchor", "words")
    node = cut(large.groupBy("run_key").agg(F.min("leaf").alias("leaf"), F.first(F.struct("n", "anchor", "words")).alias("x")).select("run_key", "leaf", "x.*"), "nodes")
    whole = large.select("run_key", "leaf", "n").join(node.select("run_key", F.col("leaf").alias("earliest")), "run_key").where("leaf > earliest").select("leaf.id", "leaf.rank", "leaf.pos", "n")
    most = node.groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > GROUP).select("anchor")
    fit = node.join(most, "anchor", "left_anti").select("leaf.id", "leaf.rank", "leaf.pos", "n", "anchor", "words")
    single = cut(windows_of(node.join(most, "anchor", "left_semi")), "windows")
    first = single.groupBy("key").agg(F.min("leaf").alias("earliest"))
    again = single.join(first, "key").where("leaf > earliest").select("leaf.id", "leaf.rank", "leaf.pos", F.lit(1).alias("n"))
    small = runs.where("run_key IS NULL").select("id", "rank", "pos", "n", "anchor", "words")
    return subtrees(small.unionByName(fit), id_type).unionByName(whole).unionByName(again)


def removals(data: np.ndarray, off: np.ndarray, repeats: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word counts, removed counts and kept texts."""
    starts, ends, at = wordhash.word_spans(data, off)
    cover = np.zeros(len(starts) + 1, np.int64)
    for i, own in enumerate(repeats):
        if len(own):
            np.add.at(cover, at[i] + own[:, 0], 1)
            np.add.at(cover, at[i] + own[:, 0] + own[:, 1] + WINDOW - 1, -1)
    gone = np.cumsum(cover)[:-1] > 0
    raw, kept = data.tobytes(), []
    s, e, g = starts.tolist(), ends.tolist(), gone.tolist()
    for i in range(len(off) - 1):
        kept.append(b" ".join([raw[s[k] : e[k]] for k in range(at[i], at[i + 1]) if not g[k]]))
    total = np.concatenate([[0], np.cumsum(gone)])
    return np.diff(at), total[at[1:]] - total[at[:-1]], kept


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, n_removed and kept_text (the kept words joined by one space)."""
    own = _identity(docs, key, text)
    id_type = own.schema["id"].dataType.simpleString()
    # a table of its own, so that the join's both sides are shuffled for it and a frequent anchor's part can be split
    repeated = cut(anchor_counts(own).where("n > 1").select("anchor", (F.col("n") > GROUP).alias("large")), "anchors")
    # equal rows are one document: its hits and its text come once, or its leaves would be repeats of themselves. Both are
    # grouped by what they are joined by (a struct, as ids may be null), so each is shuffled once
    one = F.struct("id", "rank").alias("one")
    hits = anchor_runs(own, id_type).join(repeated, "anchor").select(one, F.struct("pos", "large").alias("hit")).groupBy("one").agg(F.sort_array(F.collect_set("hit")).alias("hits"))
    texts = packed(own, id_type)
    found = texts.select(one, "z").groupBy("one").agg(F.first("z").alias("z")).join(hits, "one").select("one.id", "one.rank", "z", "hits")
    runs = cut(suffix_runs(found, id_type), "suffix-runs")
    gone = repeats(runs, id_type).groupBy("id", "rank").agg(F.collect_list(F.struct("pos", "n")).alias("repeats"))
    joined = texts.alias("t").join(gone.alias("g"), (F.col("t.rank") == F.col("g.rank")) & F.col("t.id").eqNullSafe(F.col("g.id")), "left").select("t.id", "z", "repeats")

    def build(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                data, off = as_slice([unpack(z) for z in part.column(1).to_pylist()])
                n, removed, kept = removals(data, off, [np.array([(r["pos"], r["n"]) for r in x or ()], np.int64) for x in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(removed), pa.array([k.decode() for k in kept]), pa.array([hashlib.sha256(k).hexdigest() for k in kept])], [key, "n_words", "n_removed", "kept_text", "kept_sha256"])

    return joined.mapInArrow(build, f"`{key}` {id_type}, n_words bigint, n_removed bigint, kept_text string, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: The query's rows: windows as text, all but the earliest of equal ones repeated.
ORACLE = r"""
WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS word, generate_subscripts(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''), 1) AS pos FROM documents),
g AS (SELECT doc_id, pos, count(*) OVER v AS n, string_agg(word, ' ') OVER v AS g FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY g ORDER BY doc_id, pos) AS k FROM g WHERE n = 20),
c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM r WHERE k > 1),
s AS (SELECT w.doc_id, count(*) AS n_words, count(c.pos) AS n_removed, coalesce(string_agg(w.word, ' ' ORDER BY w.pos) FILTER (WHERE c.pos IS NULL), '') AS kept FROM w LEFT JOIN c ON c.doc_id = w.doc_id AND c.pos = w.pos GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN s USING (doc_id)
"""
