"""Spelling variants of a corpus's words: near words (one inserted, deleted or replaced code point), forms and roots.

Words are runs of letters (A to Z and U+00C0 to U+00FF) of at least LEAST_SIZE code points that stand LEAST_COUNT times or more in the corpus; A to Z are lower-cased. One
occurrence in SPOIL (by checksum of its key and run) loses a code point first, as a planted misspelling. Tasks count words per slice of text, Spark sums.

Near words are found by generated edits. The vocabulary's words are put into blocked Bloom filters, sharded by length (up to LENGTHS - 1, longer ones together): a word sets
four bits of one 64-bit block of its length's shard. Shards are sized by counts; together they have at most MOST_BLOCKS blocks, so the broadcast is bounded and a larger vocabulary only
lets more through. Each word's deletions are probed in the shard one shorter, its replacements (by code points above the one replaced, of those that occur) in its own; the other
direction and insertions follow by symmetry. Edits are hashed from the word's hash without being spelled out. Only positives, as pairs of hashes, are shuffled to an exact
join with the vocabulary, and pairs are confirmed on the words themselves, so neither false positives nor equal hashes reach the result, and none is lost.

A word's form is its near word of largest count (of equal ones the least in code-point order) if that is FORM_TIMES its own count or more. Roots follow forms by pointer
jumping; counts grow by FORM_TIMES with each step, so rounds are few.

Null and empty texts have no words. Rows with a null key spoil nothing. Repeated rows count as often as they stand. Without words the result is empty. Runs of any
length are taken whole: a word of n code points has about n * 90 / 2 edits, probed in parts. Other columns are left out, so that no name clashes.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table, text_slices
from tidemark.llm.lattice import mix
from tidemark.llm.wordhash import lower_ascii, runs, word_hashes

LEAST_SIZE, LEAST_COUNT, FORM_TIMES, SPOIL = 6, 5, 5, 199
#: Shards of the filters, and blocks of 64 bits in all of them together at most (32 MB); a block is meant for BLOCK_WORDS words.
LENGTHS, MOST_BLOCKS, BLOCK_WORDS = 64, 1 << 22, 4
#: Words of a task that probes, and edits that are hashed at once.
TASK_WORDS, PROBES = 20_000, 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUE = mix(np.arange(256, dtype=np.uint64) + _P)  # of a code point below 256
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def word_runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of letters, the text of each, and its code points; U+00C0 to U+00FF are the characters whose first byte is C3."""
    lead = data == 0xC3
    inside = lead | ((data | 32) - np.uint8(97) < 26)
    inside[1:] |= lead[:-1]
    starts, ends, first = runs(inside, off)
    two = np.concatenate([[0], np.cumsum(lead)])
    return starts, ends, np.searchsorted(first, np.arange(len(starts)), "right") - 1, ends - starts - (two[ends] - two[starts])


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each run, going on from the crc32 of what comes before it; a byte of all runs at a time, long runs one by one."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    order = order[size[order] <= 64]
    crc = ~before
    up_to = np.searchsorted(-size[order], -np.arange(65), "left")  # how many are longer than j
    for j in range(64):
        own = order[: up_to[j]]
        if not len(own):
            break
        crc[own] = _CRC[(crc[own] ^ data[starts[own] + j]) & 255] ^ (crc[own] >> 8)
    crc = ~crc
    for i in np.flatnonzero(size > 64).tolist():
        crc[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(before[i]))
    return crc


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The spans as an Arrow string array."""
    off = np.concatenate([[0], np.cumsum(sizes)])
    flat = data[np.repeat(starts - off[:-1], sizes) + np.arange(off[-1])]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(flat)).cast(pa.string())


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of one size at a and b are equal."""
    out = np.ones(len(a), bool)
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        for part in np.array_split(own, max(1, len(own) * int(n) >> 20)):
            step = np.arange(n)
            out[part] = (data[a[part, None] + step] == data[b[part, None] + step]).all(axis=1)
    return out


def count_words(docs: DataFrame, key: str, text: str, least: int = LEAST_SIZE, spoil: int = SPOIL) -> DataFrame:
    """(word, n): occurrences of words in parts of the texts, to be summed."""

    def build(batches):
        for part, data, off in text_slices(batches, text, 4 << 20):
            low = lower_ascii(data)
            starts, ends, row, size = word_runs(low, off)
            keys = part.column(0).to_pylist()
            before = np.array([zlib.crc32(f"{k}:".encode()) for k in keys], np.uint32)
            crc = checksums(low, starts, ends, before[row]) if len(row) else np.zeros(0, np.uint32)
            known = np.array([k is not None for k in keys], bool)
            spoilt = (crc % spoil == 0) & known[row]
            own = Counter()
            for i in np.flatnonzero(spoilt & (size > least)).tolist():
                word, at = low[starts[i] : ends[i]].tobytes().decode(), int(crc[i]) % int(size[i])
                own[word[:at] + word[at + 1 :]] += 1
            kept = ~spoilt & (size >= least)
            a, z = starts[kept], ends[kept]
            h = word_hashes(low, a, z)
            _, first, which, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            other = np.flatnonzero((z - a) != (z - a)[first[which]])
            at = np.flatnonzero((z - a) == (z - a)[first[which]])
            other = np.concatenate([other, at[~same_bytes(low, a[at], a[first[which[at]]], (z - a)[at])]])
            np.subtract.at(n, which[other], 1)  # other words of an equal hash
            for i in other.tolist():
                own[low[a[i] : z[i]].tobytes().decode()] += 1
            yield pa.RecordBatch.from_arrays([gathered(low, a[first], (z - a)[first]), pa.array(n)], ["word", "n"])
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(list(own)), pa.array(list(own.values()), pa.int64())], ["word", "n"])

    return docs.select(key, text).mapInArrow(build, "word string, n bigint")


def by_length(words: pa.Array) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Code points of each word, and for each length (length, places of its words, codes[word, place])."""
    _, data, off = next(text_slices(iter([pa.RecordBatch.from_arrays([words], ["w"])]), "w", 1 << 62), (None, np.zeros(0, np.uint8), np.zeros(1, np.int64)))
    lead = data == 0xC3
    codes = data.copy()
    codes[1:][lead[:-1]] += 64
    seen = np.concatenate([[0], np.cumsum(lead)])
    codes, off = codes[~lead], off - seen[off]
    size, out = np.diff(off), []
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        out.append((n, at, codes[off[at][:, None] + np.arange(n)]))
    return size, out


def powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _P, np.uint64)
    out[0] = 1
    return np.cumprod(out, out=out)


def keys_of(sums: np.ndarray, size: int) -> np.ndarray:
    return mix(sums + np.uint64(size * int(_PINV) % (1 << 64)))


def word_keys(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of words of code points below 256, and their sizes."""
    size, groups = by_length(words)
    out = np.zeros(len(words), np.uint64)
    for n, at, codes in groups:
        up = powers(n)
        out[at] = keys_of((_VALUE[codes] * up[:n]).sum(axis=1, dtype=np.uint64), n)
    return out, size


def block_of(keys: np.ndarray, start: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each key in a shard of so many (a power of two), and its four bits."""
    one, six = np.uint64(1), np.uint64(63)
    bits = one << (keys & six)
    for s in (6, 12, 18):
        bits |= one << ((keys >> np.uint64(s)) & six)
    return start + ((keys >> np.uint64(24)) & np.uint64(blocks - 1)).astype(np.int64), bits


def shard_sizes(counts: dict[int, int], most: int = MOST_BLOCKS) -> dict[int, tuple[int, int]]:
    """(first block, blocks) of each length's shard: a power of two by its words, all halved until they fit."""
    blocks = {k: 1 << max(0, -(-n // BLOCK_WORDS) - 1).bit_length() for k, n in counts.items()}
    while sum(blocks.values()) > max(most, len(blocks)):
        blocks = {k: max(1, b // 2) for k, b in blocks.items()}
    out, start = {}, 0
    for k in sorted(blocks):
        out[k] = (start, blocks[k])
        start += blocks[k]
    return out


def filters(vocab: DataFrame, most: int = MOST_BLOCKS) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
    """The blocks of all shards, and where each shard lies, from (h, size)."""
    shard = F.least("size", F.lit(LENGTHS)).alias("shard")
    shards = shard_sizes({r["shard"]: r["n"] for r in vocab.groupBy(shard).agg(F.count("*").alias("n")).collect()}, most)  # at most LENGTHS rows

    def build(batches):
        for batch in batches:
            h, size = batch.column(0).to_numpy().view(np.uint64), np.minimum(batch.column(1).to_numpy(), LENGTHS)
            for n in np.unique(size).tolist():
                at, bits = block_of(h[size == n], *shards[n])
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits.view(np.int64))], ["at", "bits"])

    got = vocab.select("h", "size").mapInArrow(build, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most `most` rows
    blocks = np.zeros(sum(b for _, b in shards.values()), np.uint64)
    blocks[got.column("at").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return blocks, shards


def positives(codes: np.ndarray, n: int, blocks: np.ndarray, shards: dict[int, tuple[int, int]], alphabet: np.ndarray):
    """(key of an edit, word) of the deletions and upward replacements of words codes[word, place] of n code points that pass the filters."""

    def probe(keys, size, word):
        at, bits = block_of(keys, *shards[min(size, LENGTHS)])
        hit = (blocks[at] & bits) == bits
        return keys[hit], word[hit]

    up = powers(n)
    terms = _VALUE[codes] * up[:n]
    sums = np.cumsum(terms, axis=1)
    total = sums[:, -1]
    if min(n - 1, LENGTHS) in shards:
        for p in range(0, n, step := max(1, PROBES // len(codes))):
            q = min(n, p + step)
            last = np.ones((len(codes), q - p), bool)  # of equal neighbours only the last goes
            inner = min(q, n - 1) - p
            last[:, :inner] = codes[:, p : p + inner] != codes[:, p + 1 : p + inner + 1]
            word, at = np.nonzero(last)
            at += p
            yield probe(keys_of(sums[word, at] - terms[word, at] + (total[word] - sums[word, at]) * _PINV, n - 1), n - 1, word)
    if min(n, LENGTHS) in shards:
        for p in range(0, n, step := max(1, PROBES // len(codes))):
            own = codes[:, p : p + step]
            for c in alphabet.tolist():
                word, at = np.nonzero(own < c)
                if len(word):
                    yield probe(keys_of(total[word] + (_VALUE[c] - _VALUE[own[word, at]]) * up[at + p], n), n, word)


def near_words(vocab: DataFrame, words: int, most: int = MOST_BLOCKS) -> DataFrame:
    """(a, na, b, nb): each two near words of vocab (word, n, h, size), once; words is its number of rows."""
    blocks, shards = filters(vocab, most)
    alphabet = np.array(sorted(ord(r["c"]) for r in vocab.select(F.explode(F.split("word", "")).alias("c")).where("c != ''").distinct().collect()), np.int64)  # at most 90
    sent = vocab.sparkSession.sparkContext.broadcast((blocks, shards, alphabet))

    def build(batches):
        blocks, shards, alphabet = sent.value
        for batch in batches:
            h = batch.column(1).to_numpy()
            for n, at, codes in by_length(batch.column(0))[1]:
                for lo in range(0, len(at), 4096):
                    for keys, word in positives(codes[lo : lo + 4096], n, blocks, shards, alphabet):
                        if len(keys):
                            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(h[at[lo + word]])], ["edit", "h"])

    found = vocab.select("word", "h").repartition(max(1, -(-words // TASK_WORDS))).mapInArrow(build, "edit bigint, h bigint")
    met = found.join(vocab.select(F.col("h").alias("edit"), F.col("word").alias("b"), F.col("n").alias("nb")), "edit")
    both = met.join(vocab.select("h", F.col("word").alias("a"), F.col("n").alias("na")), "h")
    return both.where(F.levenshtein("a", "b", 1) == 1).select("a", "na", "b", "nb")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_size: int = LEAST_SIZE, least_count: int = LEAST_COUNT, times: int = FORM_TIMES, spoil: int = SPOIL, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word of the corpus."""

    def keyed(batches):
        for batch in batches:
            h, size = word_keys(batch.column(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h.view(np.int64)), pa.array(size)], ["word", "n", "h", "size"])

    counts = count_words(docs, key, text, least_size, spoil).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
    vocab = cut(counts.mapInArrow(keyed, "word string, n bigint, h bigint, size bigint"), "vocabulary")
    near = cut(near_words(vocab, vocab.count(), most_blocks), "near-words")
    each = near.select(F.col("a").alias("word"), F.col("na").alias("own"), F.struct((-F.col("nb")).alias("m"), F.col("b").alias("w")).alias("o"))
    each = each.unionByName(near.select(F.col("b").alias("word"), F.col("nb").alias("own"), F.struct((-F.col("na")).alias("m"), F.col("a").alias("w")).alias("o")))
    best = each.groupBy("word").agg(F.count("*").alias("n_near"), F.min("o").alias("o"), F.first("own").alias("own"))
    enough = -F.col("o.m") >= times * F.col("own")
    best = cut(best.select("word", "n_near", F.when(enough, F.col("o.w")).alias("form"), F.when(enough, -F.col("o.m")).alias("form_n")), "forms")
    roots = follow(best.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    out = vocab.select("word", "n").join(best, "word", "left").join(roots, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def follow(step: DataFrame) -> DataFrame:
    """(word, root) from (word, root) of one step each: where steps end, by pointer jumping. Steps have no circles."""
    step = cut(step, "roots")
    while True:
        after = step.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = cut(step.join(after, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        moved = step.where("moved").limit(1).count()
        step = step.select("word", "root")
        if not moved:
            return step


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE
bits AS (SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) t(i) UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
found AS MATERIALIZED (SELECT doc_id, w, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents) GROUP BY ALL),
summed AS MATERIALIZED (SELECT w, n, CASE WHEN doc_id IS NOT NULL THEN xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))),
    lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) END AS h FROM found, crc),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM summed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gaps AS (SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS u(i)),
masks AS (SELECT word, n, i, left(word, i - 1) || '?' || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS u(i)),
near AS MATERIALIZED (SELECT a.word, b.word AS other, b.n AS m FROM masks a JOIN masks b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON g.rest = w.word
  UNION ALL SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.rest = w.word),
picked AS (SELECT word, other, m, row_number() OVER (PARTITION BY word ORDER BY m DESC, encode(other)) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM near),
best AS MATERIALIZED (SELECT w.word, w.n, coalesce(p.n_near, 0)::BIGINT AS n_near, CASE WHEN p.m >= 5 * w.n THEN p.other END AS form, CASE WHEN p.m >= 5 * w.n THEN p.m END AS form_n
  FROM words w LEFT JOIN (SELECT * FROM picked WHERE k = 1) p USING (word)),
walk AS (SELECT word, word AS reached, 0 AS steps FROM best UNION ALL SELECT k.word, b.form, k.steps + 1 FROM walk k JOIN best b ON b.word = k.reached WHERE b.form IS NOT NULL),
ends AS (SELECT word, arg_max(reached, steps) AS root FROM walk GROUP BY word)
SELECT word, n, n_near, form, form_n::BIGINT AS form_n, root FROM best JOIN ends USING (word)
"""
