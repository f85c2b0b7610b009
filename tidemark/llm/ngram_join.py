"""Similarity join on word shingles by adaptive multi-match prefixes, and the groups of linked documents.

Two documents link when the Jaccard similarity of their sets of SHINGLE-word shingles reaches t (the operator's
default is five words and 0.8; the query takes three and 0.9). Documents with equal sets are one class from the
start, so copies are never paired. Each class orders its shingles by one order for all: those that likely many
documents have last, by counts over all rows, and by hash. With n shingles, its l-prefix are the first n - ceil(t n) + l; two
classes that link share at least min(l, l') shingles of their prefixes. l is chosen per class: a longer prefix
costs more lookups, and the number of candidates that share l of them falls, so the l of least estimated cost is
taken, from the counts of classes per prefix shingle (all of them; counts come by a map-side combined aggregation).

Groups of near copies, which may hold thousands of classes that mostly don't link, are decided without meeting pairwise.
Every list of classes with a common prefix shingle and like sizes has a hub, the class with the fewest shingles of its own
(the one in the middle of its copies); each class takes the hub that it shares most with, hubs take theirs, and so whole
groups come to one star. A member is held as its differences from the hub. Elements in which most members differ from the hub
are turned over, so that the differences are those from the star's middle. With d differences and n shingles, let
f = d (1 + t) - n (1 - t). Two members link exactly when f + f' <= 2 (1 + t) times the number of differences that they share, so those
with f + f' <= 0 link as they are, all of them by way of the member with the least f, and any others must share rare edits,
which stand in prefixes of their differences, rarest in the star first. Members with such an edit in common are families: they get hubs and middles of their own in the same way, from
which the edits that they share are no differences. Those that are still in different components are joined on their prefixes, and counted exactly. A difference that one
member alone has is never shared; most members have so many of those that they are known to have no partner.

Then only candidates of different stars whose ends are still in different components are generated, by the
multi-match rule, and verified on their texts. Components come from least labels with pointer jumping.

Each step's table is deleted once the steps that read it are written; of all of them the result stays.

Null and empty texts, and texts without words: empty set, linked with nothing. With fewer words than a shingle
has, the whole sequence is the one shingle. Null ids: such rows never name a component, unless it has no other id.
Repeated rows are one class; each is returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import wordhash
from tidemark.llm.common import Steps, bitmap, in_bitmap, table, text_slices
from tidemark.llm.components import components
from tidemark.llm.lattice import mix

SLICE = 2 << 20
#: A shingle is frequent when so large a share of the rows has it, so there are at most (mean set size / FREQUENT) of them.
FREQUENT = 3e-4
#: A word is common when it makes up so large a share of all words, so there are at most 1 / COMMON of them.
COMMON = 1e-5
MOST_L, VERIFY_COST = 8, 50
SALTS = 8


def by_row(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Order by (row, h)."""
    order = np.argsort(h)
    return order[np.argsort(row[order].astype(np.uint16 if rows < 1 << 16 else np.int64), kind="stable")]


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int, eighths=None) -> tuple[np.ndarray, ...]:
    """Sorted distinct shingle hashes of each text, back to back, and their bounds; and, if eighths gives the binary log of the
    share of each of some words, in eighths, the sums of these over each shingle: integers, so that they follow from the shingle alone."""
    starts, ends, at = wordhash.word_spans(data, off)
    words = wordhash.word_hashes(data, starts, ends, lower=True)
    grams = wordhash.gram_hashes(words, k)
    n_words = np.diff(at)
    row = np.repeat(np.arange(len(n_words)), n_words)[: len(grams)]
    ok = np.arange(len(grams)) + k <= at[row + 1] if len(grams) else np.zeros(0, bool)
    h, row = [grams[ok]], [row[ok]]
    for short in range(1, k):  # a whole sequence; its length is part of its hash
        some = np.flatnonzero(n_words == short)
        own = np.full(len(some), short, np.uint64)
        for i in range(short):
            own = mix(own * np.uint64(0x9E3779B97F4A7C15) + words[at[some] + i])
        h.append(own)
        row.append(some)
    h, row = np.concatenate(h), np.concatenate(row)
    order = by_row(h, row, len(off))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    bounds = np.searchsorted(row[new], np.arange(len(off)))
    if eighths is None:
        return h[new], bounds
    total = np.concatenate([[0], np.cumsum(eighths(words))])
    logs = np.concatenate([(total[k:] - total[:-k])[ok] if len(ok) else np.zeros(0, np.int64), np.full(len(h) - int(ok.sum()), -(1 << 20))])
    return h[new], bounds, logs[order][new]


def signatures(h: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """16 bytes that equal sets share."""
    sums = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)))])
        sums.append(mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)))
    return [a + b for a, b in zip(*([x.tobytes() for x in s] for s in sums), strict=True)]


def corpus_counts(docs: DataFrame, k: int) -> dict:
    """Counts over all rows that order shingles by how many documents likely have them; they only order.

    Words with a share of COMMON or more (at most 1 / COMMON of them) give the share expected of a shingle, as the product of its
    words' shares. Shingles that stand several times in one slice, and in sum as often as FREQUENT of the rows, are counted themselves.
    Values are eighths of a doubling, as integers."""

    def build(batches):
        rows = n_words = 0
        for _, data, off in text_slices(batches, "text", SLICE):
            starts, ends, at = wordhash.word_spans(data, off)
            words = wordhash.word_hashes(data, starts, ends, lower=True)
            inside = np.ones(max(0, len(words) - k + 1), bool)
            for i in range(1, k):  # not over a text's end
                over = at[1:-1] - i
                inside[over[(over >= 0) & (over < len(inside))]] = False
            a, n = np.unique(wordhash.gram_hashes(words, k)[inside], return_counts=True)
            w, m = np.unique(words, return_counts=True)
            rows, n_words = rows + len(off) - 1, n_words + len(starts)
            for kind, key, count in ((0, a[n > 1], n[n > 1]), (1, w[m > 2], m[m > 2])):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(count)], ["kind", "s", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([2, 3], pa.int32()), pa.array([0, 0], pa.int64()), pa.array([rows, n_words], pa.int64())], ["kind", "s", "n"])

    steps = Steps(docs.sparkSession)
    each = steps.cut(docs.select("text").mapInArrow(build, "kind int, s bigint, n bigint").groupBy("kind", "s").agg(F.sum("n").alias("n")), "corpus-counts")
    size = {r["kind"]: r["n"] for r in each.where("kind >= 2").collect()}
    rows, n_words = size.get(2, 0), size.get(3, 0)
    out = {"words": eighths_of(max(1, n_words))}
    for kind, name, least, share in ((0, "shingle", max(4, FREQUENT * rows), 1), (1, "word", COMMON * n_words, max(1, n_words))):
        got = each.where((F.col("kind") == kind) & (F.col("n") >= least)).select("s", "n").toArrow()
        h = got["s"].to_numpy().view(np.uint64)
        by = np.argsort(h)
        out[name] = (h[by], eighths_of(got["n"].to_numpy()[by] / share))
    steps.drop(each)
    return out


def eighths_of(x):
    return np.round(8 * np.log2(x)).astype(np.int64)


def looked_up(keys: np.ndarray, values: np.ndarray, h: np.ndarray, other: int) -> np.ndarray:
    if not len(keys):
        return np.full(len(h), other)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, values[at], other)


def rows_with_prefixes(docs: DataFrame, id_type: str, k: int, t: tuple[int, int], counts: dict) -> DataFrame:
    """(id, t1, t2, n, sig, prefix): prefix has the shingles of the longest prefix, in the order for all."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def build(batches):
        c = sent.value
        rare = int(eighths_of(COMMON))
        for part, data, off in text_slices(batches, "text", SLICE):
            h, bounds, logs = shingle_sets(data, off, k, lambda words: looked_up(*c["word"], words, rare))
            n = np.diff(bounds)
            row = np.repeat(np.arange(len(n)), n)
            # the number of documents that it is likely in; equal ones by hash, by which they are sorted
            w = np.minimum(np.maximum(looked_up(*c["shingle"], h, 0), logs + c["words"]).clip(0), 65_535).astype(np.uint16)
            by = np.argsort(w, kind="stable")
            by = by[np.argsort(row[by].astype(np.uint16 if len(off) < 1 << 16 else np.int64), kind="stable")]
            longest = np.minimum(n, n + (-n * t[0] // t[1]) + MOST_L)  # -n * t0 // t1 is minus the least overlap
            keep = np.arange(len(h)) - np.repeat(bounds[:-1], n) < np.repeat(longest, n)
            offsets = np.concatenate([[0], np.cumsum(longest)]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[by][keep].view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(n), pa.array(signatures(h, bounds), pa.binary()), prefix], ["id", "t1", "t2", "n", "sig", "prefix"])

    return docs.select("id", "text", "t1", "t2").mapInArrow(build, f"id {id_type}, t1 bigint, t2 bigint, n bigint, sig binary, prefix array<bigint>")


def class_number(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(s[:8] for s in sigs), np.int64)


def packed_texts(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(t1, t2, z): compressed texts that the bitmap lets through."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def build(batches):
        press = zstandard.ZstdCompressor(level=3)
        for part, data, off in text_slices(batches, "text", SLICE):
            raw = data.tobytes()
            at = np.flatnonzero(in_bitmap(sent.value, part.column(1).to_numpy()))
            z = [press.compress(raw[off[i] : off[i + 1]]) for i in at.tolist()]
            yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(at)), part.column(2).take(pa.array(at)), pa.array(z, pa.binary())], ["t1", "t2", "z"])

    return docs.select("text", "t1", "t2").mapInArrow(build, "t1 bigint, t2 bigint, z binary")


def texts_of(pairs: DataFrame, ends: tuple[str, ...], keys: DataFrame, docs: DataFrame, steps: Steps) -> DataFrame:
    """(sig, z): the compressed texts of the classes that are ends of pairs; keys has each class's (sig, t1, t2)."""
    sigs = pairs.select(F.explode(F.array(*ends)).alias("sig")).distinct()
    wanted = steps.cut(keys.join(sigs, "sig", "left_semi"), "wanted")
    texts = steps.cut(packed_texts(docs, bitmap(wanted, "t1")).dropDuplicates(["t1", "t2"]).join(wanted, ["t1", "t2"]).select("sig", "z"), "texts")
    steps.drop(wanted)
    return texts


def repeated_shingles(classes: DataFrame, bits: np.ndarray) -> DataFrame:
    """(number, pos, s): prefix shingles that the bitmap lets through, with the class's number (the first half of its sig;
    were two classes to share one, each would get both's shingles, which adds candidates and loses none)."""
    sent = classes.sparkSession.sparkContext.broadcast(bits)

    def build(batches):
        for batch in batches:
            lists = batch.column(1)
            s = lists.flatten().to_numpy()
            n = np.diff(lists.offsets.to_numpy())
            at = np.flatnonzero(in_bitmap(sent.value, s))
            row = np.repeat(np.arange(len(n)), n)
            pos = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(class_number(batch.column(0).to_pylist())[row[at]]), pa.array(pos[at].astype(np.int32)), pa.array(s[at])], ["number", "pos", "s"])

    return classes.select("sig", "prefix").mapInArrow(build, "number bigint, pos int, s bigint")


def numbered(classes: DataFrame) -> DataFrame:
    """With the class's number, as class_number() has it."""

    def build(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(class_number(batch.column(0).to_pylist()))], [*batch.schema.names, "number"])

    return classes.mapInArrow(build, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields) + ", number bigint")


def both_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    return pairs.join(texts.select(F.col("sig").alias("b"), F.col("z").alias("zb")), "b").join(texts.select(F.col("sig").alias("a"), F.col("z").alias("za")), "a").select("a", "b", "za", "zb")


def shared_and_sizes(batches, k: int):
    """For (a, b, za, zb), lists of (place in the batch, sorted shingles of both together) for each batch. Texts met again soon are read once."""
    press = zstandard.ZstdDecompressor()
    known: dict[bytes, np.ndarray] = {}
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            found = []
            for a, b, za, zb in zip(*(c.to_pylist() for c in part.columns), strict=True):
                sets = []
                for key, z in ((a, za), (b, zb)):
                    if key not in known:
                        if len(known) >= 256:
                            known.clear()
                        raw = np.frombuffer(press.decompress(z), np.uint8)
                        known[key] = shingle_sets(raw, np.array([0, len(raw)]), k)[0]
                    sets.append(known[key])
                found.append((len(sets[0]), len(sets[1]), np.sort(np.concatenate(sets))))
            yield part, found


def verified(pairs: DataFrame, texts: DataFrame, k: int, t: tuple[int, int]) -> DataFrame:
    """Those of pairs (a, b) that link."""

    def build(batches):
        for part, found in shared_and_sizes(batches, k):
            shared = np.array([int((s[1:] == s[:-1]).sum()) for _, _, s in found])
            mask = pa.array(t[1] * shared >= t[0] * (np.array([len(s) for _, _, s in found]) - shared))
            yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask)], ["a", "b"])

    return both_texts(pairs, texts).mapInArrow(build, "a binary, b binary")


def differences(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(star, star_n, sig, n, delta) for pairs (a, b) of a hub and a class: the shingles that one of them has alone. Classes that differ
    from the hub in more than a third of both sizes' sum (a similarity under a half) are left out."""

    def build(batches):
        for part, found in shared_and_sizes(batches, k):
            take, n, deltas = [], [], []
            for i, (na, nb, s) in enumerate(found):
                twice = s[1:] == s[:-1]
                if 3 * (len(s) - 2 * int(twice.sum())) <= len(s):
                    alone = np.ones(len(s), bool)
                    alone[1:] &= ~twice
                    alone[:-1] &= ~twice
                    take.append(i)
                    n.append((na, nb))
                    deltas.append(s[alone].view(np.int64))
            at = pa.array(take, pa.int64())
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in deltas])]).astype(np.int32)
            delta = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *deltas])))
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array([x for x, _ in n], pa.int64()), part.column(1).take(at), pa.array([x for _, x in n], pa.int64()), delta], ["star", "star_n", "sig", "n", "delta"])

    return both_texts(pairs, texts).mapInArrow(build, "star binary, star_n bigint, sig binary, n bigint, delta array<bigint>")


def centred(members: DataFrame, t: tuple[int, int]) -> DataFrame:
    """(star, sig, f, k, gs) from (star, sig, n, d, m, shared, flips): k and gs count and list the differences from the star's middle that
    another member has, too, the rarest first; f is as in the module's docstring, times the threshold's denominator."""

    def build(batches):
        for batch in batches:
            n, d, m = (batch.column(i).to_numpy() for i in (2, 3, 4))
            f, ks, lists = [], [], []
            for i, (shared, flips) in enumerate(zip(batch.column(5), batch.column(6), strict=True)):
                g, df = pairs_of(shared)
                turned, their = pairs_of(flips)
                most = 2 * df > m[i]
                added = ~np.isin(turned, g[most])
                size = d[i] - int(most.sum()) + int(added.sum())
                left = m[i] - their[added]
                g = np.concatenate([g[~most], turned[added][left > 1]])
                df = np.concatenate([df[~most], left[left > 1]])
                f.append(size * (t[0] + t[1]) - n[i] * (t[1] - t[0]))
                ks.append(len(g))
                lists.append(g[np.lexsort((g, df))])
            offsets = np.concatenate([[0], np.cumsum(ks)]).astype(np.int32)
            gs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *lists])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(f, pa.int64()), pa.array(ks, pa.int64()), gs], ["star", "sig", "f", "k", "gs"])

    def pairs_of(x) -> tuple[np.ndarray, np.ndarray]:
        if not x.is_valid:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return x.values.field(0).to_numpy(), x.values.field(1).to_numpy()

    return members.select("star", "sig", "n", "d", "m", "shared", "flips").mapInArrow(build, "star binary, sig binary, f bigint, k bigint, gs array<bigint>")


def star_halves(members: DataFrame, t: tuple[int, int], steps: Steps) -> tuple[DataFrame, DataFrame]:
    """Of members (star, sig, n, delta): (a, b) links of those near enough to their star's middle with the one nearest to it; and (star, sig, f, k, gs, least, far) of those that may
    have links beside these."""
    c2 = 2 * (t[0] + t[1])
    sized = members.groupBy("star").agg(F.count("*").alias("m"))
    each = members.where("size(delta) > 0").select("star", "sig", F.explode("delta").alias("g"))
    again = steps.cut(each.groupBy("star", "g").agg(F.count("*").alias("df")).where("df > 1"), "differences")
    shared = each.join(again, ["star", "g"]).groupBy("star", "sig").agg(F.collect_list(F.struct("g", "df")).alias("shared"))
    flips = again.join(sized, "star").where("2 * df > m").groupBy("star").agg(F.collect_list(F.struct("g", "df")).alias("flips"))
    # a star may have a large share of all members: its one row is met in SALTS places
    dealt = F.pmod(F.hash("sig"), F.lit(SALTS)).alias("salt")
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    whole = members.select("star", "sig", "n", F.size("delta").cast("bigint").alias("d")).join(shared, ["star", "sig"], "left").withColumn("salt", dealt)
    own = steps.cut(centred(whole.join(salted(sized.join(flips, "star", "left")), ["star", "salt"]), t), "centred")
    middle = own.groupBy("star").agg(F.min(F.struct("f", "sig")).alias("low"), F.min(F.expr(f"f - {c2} * k")).alias("best"))
    placed = own.withColumn("salt", dealt).join(salted(middle), ["star", "salt"])
    near = placed.where("f + low.f <= 0 AND sig != low.sig").select(F.col("low.sig").alias("a"), F.col("sig").alias("b"))

    # pairs with a far end must share differences
    far = placed.where(f"f + low.f > 0 AND f + best <= 0 AND f - {c2} * k + low.f <= 0").select("star", "sig", "f", "k", "gs", F.col("low.f").alias("least"), F.lit(True).alias("far"))
    far = steps.cut(far, "far")
    among = far.groupBy("star").agg(F.min("f").alias("least"), F.min(F.expr(f"f - {c2} * k")).alias("best"))
    other = placed.where("f + low.f <= 0").select("star", "sig", "f", "k", "gs").join(among, "star").where(f"f + best <= 0 AND f - {c2} * k + least <= 0").select("star", "sig", "f", "k", "gs", "least", F.lit(False).alias("far"))
    return near, far.unionByName(other)


def families(listed: DataFrame, members: DataFrame, steps: Steps) -> DataFrame:
    """(star, sig, n, delta): stars inside stars. Members that list a difference in common take the one of them with the fewest differences that they share most with for their hub, and are
    held by their differences from it, so that edits that a family shares are none."""
    hubs = listed.groupBy("star", "g").agg(F.min(F.struct("k", "sig")).alias("hub"), F.count("*").alias("m")).where("m > 1").select("star", "g", F.col("hub.sig").alias("hub"))
    nearest = listed.join(hubs, ["star", "g"]).where("sig != hub").groupBy("star", "sig", "hub").agg(F.count("*").alias("m"))
    nearest = nearest.groupBy("star", "sig").agg(F.max(F.struct("m", "hub")).alias("x")).select("star", "sig", F.col("x.hub").alias("hub"))
    own = members.select("star", "sig", "n", "delta")
    met = nearest.join(own, ["star", "sig"]).join(own.select("star", F.col("sig").alias("hub"), F.col("n").alias("_n"), F.col("delta").alias("_delta")), ["star", "hub"])
    met = steps.cut(met.select("hub", "sig", "n", F.array_union(F.array_except("delta", "_delta"), F.array_except("_delta", "delta")).alias("delta"), "_n"), "families")
    centres = met.groupBy("hub").agg(F.first("_n").alias("n")).select(F.col("hub").alias("star"), F.col("hub").alias("sig"), "n", F.expr("cast(array() AS array<bigint>)").alias("delta"))
    return met.select(F.col("hub").alias("star"), "sig", "n", "delta").unionByName(centres)


def star_links(members: DataFrame, t: tuple[int, int]) -> DataFrame:
    """(a, b): links that join all members (star, sig, n, delta) of each star that links join; a star's hub is a member without differences. Families are joined by way of their
    own middles first; then only members that are still apart are paired."""
    c2 = 2 * (t[0] + t[1])
    steps = Steps(members.sparkSession)
    near, alive = star_halves(members, t, steps)
    alive = steps.cut(alive, "alive")
    if alive.isEmpty():
        out = steps.cut(near, "star-links")
        steps.drop_all_but(out)
        return out
    listed = steps.cut(alive.select("star", "sig", "f", "k", "far", F.posexplode(F.expr(f"slice(gs, 1, cast(k + 1 - greatest(1, ceil((f + least) / {c2})) AS int))")).alias("i", "g")), "listed")
    near = steps.cut(near.unionByName(star_halves(families(listed, members, steps), t, steps)[0]), "near")
    labels = components(near, steps.cut)
    at = listed.join(labels, F.col("sig") == F.col("v"), "left").withColumn("c", F.coalesce("c", "sig")).drop("v")
    # a list's largest component meets only the others
    parts = steps.cut(at.groupBy("star", "g", "c").agg(F.count("*").alias("m")), "parts")
    mixed = parts.groupBy("star", "g").agg(F.max(F.struct("m", "c")).alias("most"), F.count("*").alias("parts")).where("parts > 1").select("star", "g", F.col("most.c").alias("most"))
    at = steps.cut(at.join(mixed, ["star", "g"]), "apart")
    x, y = at.where("c != most").alias("x"), at.alias("y")
    # the first difference that two share has at most so many after it
    like = F.expr(f"x.c != y.c AND (x.far OR y.far) AND x.f + y.f <= {c2} * least(x.k - x.i, y.k - y.i)")
    pairs = x.join(y, (F.col("x.star") == F.col("y.star")) & (F.col("x.g") == F.col("y.g")) & like).select("x.star", F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b")).distinct()
    ends = [alive.select("star", F.col("sig").alias(s), F.col("f").alias(f"f{s}"), F.col("gs").alias(f"g{s}")) for s in ("a", "b")]
    rest = pairs.join(ends[0], ["star", "a"]).join(ends[1], ["star", "b"]).where(f"fa + fb <= {c2} * size(array_intersect(ga, gb))").select("a", "b")
    out = steps.cut(near.unionByName(rest), "star-links")
    steps.drop_all_but(out)
    return out


def roots(hubs: DataFrame, steps: Steps) -> DataFrame:
    """(b, a, root) from (a, b): a is b's hub, and root the hub of hubs that four steps lead to. Hubs have less order than their classes, so there are no cycles."""
    up = steps.cut(hubs.join(hubs.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select(F.col("b").alias("v"), F.col("a").alias("r")), "hubs")
    for _ in range(2):
        up = steps.cut(up.join(up.select(F.col("v").alias("r"), F.col("r").alias("s")), "r", "left").select("v", F.coalesce("s", "r").alias("r")), "hubs")
    return hubs.join(up.select(F.col("v").alias("a"), "r"), "a", "left").select("b", "a", F.coalesce("r", "a").alias("root"))


def join_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, t: tuple[int, int] = (4, 5)) -> DataFrame:
    """Per row: key, n_shingles, component_id (least key reachable by links). t is the threshold as a fraction (numerator, denominator)."""
    t0, t1 = t
    steps = Steps(docs.sparkSession)
    own = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), F.col(text)).alias("t2"))
    id_type = own.schema["id"].dataType.simpleString()
    prefixes = steps.cut(rows_with_prefixes(own, id_type, k, t, corpus_counts(own, k)), "prefixes")
    rows = steps.cut(prefixes.select("id", "n", "sig"), "rows")

    classes = prefixes.where("n > 0").groupBy("sig").agg(F.min("id").alias("first_id"), F.first(F.struct("n", "prefix", "t1", "t2")).alias("x"))
    classes = steps.cut(classes.select("sig", "first_id", "x.*"), "classes")
    steps.drop(prefixes)
    firsts = steps.cut(classes.select("sig", "first_id"), "firsts")
    counts = steps.cut(classes.select(F.explode("prefix").alias("s")).groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "counts")
    each = repeated_shingles(classes, bitmap(counts, "s")).join(counts, "s").groupBy("number").agg(F.sort_array(F.collect_list(F.struct("pos", "s", "df"))).alias("shared"))
    found = steps.cut(numbered(classes.select("sig", "n", "t1", "t2", F.size("prefix").alias("longest"))).join(each, "number"), "shared")
    steps.drop(classes, counts)
    # the least l-prefix length but for l; lookups, and candidates (at most lookups / l), by l
    least = f"(n - (n * {t0} + {t1 - 1}) div {t1})"
    cost = f"array_min(transform(sequence(1, greatest(1, least({MOST_L}, cast((n * {t0} + {t1 - 1}) div {t1} AS int)))), l -> struct(aggregate(filter(shared, x -> x.pos < {least} + l), 0D, (s, x) -> s + x.df - 1) * (1 + {VERIFY_COST} / l) AS cost, l AS l))).l"
    chosen = found.withColumn("l", F.expr(cost)).withColumn("alone", F.col("longest") - F.size("shared"))
    lists = steps.cut(chosen.select("sig", "n", "l", "alone", F.explode(F.expr(f"filter(transform(shared, (x, i) -> named_struct('s', x.s, 'pos', x.pos, 'u', x.pos - i)), x -> x.pos < {least} + l)")).alias("x")).select("sig", "n", "l", "alone", F.col("x.s").alias("s"), F.col("x.u").alias("u")), "lists")
    keys = steps.cut(found.select("sig", "t1", "t2"), "keys")
    steps.drop(found)

    # u counts the shingles before a shared one that no other prefix has: its class's partners in that list can't have them
    # either (they would come before the shared one in their prefixes, too), so what two share is among their others.
    near = lambda n, m, u, v: F.expr(f"least({n}, {m}) * {t1} >= greatest({n}, {m}) * {t0} AND least({n} - {u}, {m} - {v}) * {t0 + t1} >= {t0} * ({n} + {m})")
    # hubs: of lists of like sizes, in buckets that overlap by half
    size = F.log("n") / math.log(t1 / t0)
    starred = lists.withColumn("bucket", F.explode(F.array(F.floor(size), F.floor(size + 0.5) + 100_000)))
    hubs = starred.groupBy("s", "bucket").agg(F.min(F.struct("alone", "sig", "n", "u")).alias("hub"), F.count("*").alias("m")).where("m > 1")
    pairs = starred.join(hubs, ["s", "bucket"]).where((F.col("sig") != F.col("hub.sig")) & near("n", "hub.n", "u", "hub.u")).groupBy(F.col("hub.sig").alias("a"), F.col("sig").alias("b")).agg(F.count("*").alias("m")).where("m > 1")
    hubs = roots(steps.cut(pairs.groupBy("b").agg(F.max(F.struct("m", "a")).alias("x")).select("x.a", "b"), "nearest"), steps)
    hubs = steps.cut(hubs, "roots")
    texts = texts_of(hubs, ("a", "b", "root"), keys, own, steps)
    first = steps.cut(differences(hubs.select(F.col("root").alias("a"), "b"), texts, k), "stars")
    second = differences(hubs.where("a != root").join(first.select(F.col("sig").alias("b")), "b", "left_anti").select("a", "b"), texts, k)
    members = steps.cut(first.unionByName(second), "members")
    steps.drop(first, texts)
    centres = members.groupBy("star").agg(F.first("star_n").alias("n")).select("star", F.col("star").alias("sig"), "n", F.expr("cast(array() AS array<bigint>)").alias("delta"))
    stars = steps.take(star_links(members.select("star", "sig", "n", "delta").unionByName(centres), t))
    labels = components(stars, steps.cut)

    # what is left: candidates in different stars and components
    homes = members.select("sig", "star").unionByName(centres.select("sig", "star").join(members.select("sig"), "sig", "left_anti"))
    at = lists.join(homes, "sig", "left").join(labels, lists["sig"] == labels["v"], "left").select("s", lists["sig"], "n", "l", "u", F.coalesce("c", lists["sig"]).alias("c"), F.coalesce("star", lists["sig"]).alias("star"))
    mixed = at.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("star").alias("one"), F.max("star").alias("two")).where("lo != hi AND one != two").select("s")
    at = steps.cut(at.join(mixed, "s"), "mixed")
    steps.drop(lists)
    x, y = at.alias("x"), at.alias("y")
    rest = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.sig") < F.col("y.sig")) & (F.col("x.c") != F.col("y.c")) & (F.col("x.star") != F.col("y.star")) & near("x.n", "y.n", "x.u", "y.u"))
    rest = rest.groupBy(F.col("x.sig").alias("a"), F.col("y.sig").alias("b"), F.least("x.l", "y.l").alias("l")).agg(F.count("*").alias("m")).where("m >= l").select("a", "b")
    rest = steps.cut(rest, "candidates")
    steps.drop(at)
    texts = texts_of(rest, ("a", "b"), keys, own, steps)
    more = steps.cut(verified(rest, texts, k, t), "links")
    steps.drop(rest, texts, keys)
    labels = components(stars.unionByName(more), steps.cut)

    names = firsts.join(labels, F.col("sig") == F.col("v"), "left").select("sig", "first_id", F.coalesce("c", "sig").alias("c"))
    named = names.groupBy("c").agg(F.min("first_id").alias("component_id"), F.count("*").alias("m")).where("m > 1")
    linked = labels.join(named, "c").select(F.col("v").alias("sig"), F.col("component_id").alias("linked_id"))
    alone = rows.where("n > 0").groupBy("sig").agg(F.min("id").alias("class_id"), F.count("*").alias("copies")).where("copies > 1")
    special = alone.join(linked, "sig", "full").select("sig", F.coalesce("linked_id", "class_id").alias("component_id"))
    out = rows.join(special, "sig", "left")
    out = steps.cut(out.select("id", "n", F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id")), "groups")
    steps.drop_all_but(out)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_groups(table(spark, sf_dir, "documents"), k=3, t=(9, 10))


#: The query's rows: all links by shared shingles, then the least id reachable.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
r AS (SELECT s.* FROM s JOIN f USING (g)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM r a JOIN r b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
c(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT c.doc_id, l.b FROM c JOIN l ON l.a = c.other)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(c.other) AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN c USING (doc_id) GROUP BY ALL
"""
