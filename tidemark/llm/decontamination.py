"""Benchmark passages in documents, by SimHash of item-sized windows; DataFrame functions only.

Words are runs of letters and digits in lower case; the features of a text are its shingles of SHINGLE words,
each weighted by how often it stands there. A document's window has as many words as the item it is held
against. A window can only be similar to an item when it shares a shingle with it, and the most similar window
can be taken to begin with a shared shingle (a shift up to the next one loses no shared shingle), so windows
begin where a run of positions with shingles of items of one length begins, or at an item's first shingle.

A window's 64-bit SimHash has bit i set when the weights of shingles with that bit outweigh the rest. Each item's
fingerprint is entered in BLOCKS tables, one for each block of its bits, under all block values within NEAR bits (10068 rows an
item, so that is a table that is shuffled and sorted by block, never broadcast); distinct fingerprints of windows look up their blocks;
two fingerprints within RADIUS = BLOCKS * (NEAR + 1) - 1 bits agree to within NEAR in some block, so looking up a
window's own blocks finds all items within RADIUS. Candidates are verified by exact weighted Jaccard similarity,
the sum of the lesser weights over the sum of the greater ones, against THRESHOLD.

SimHash is random beyond the radius: at a similarity of exactly 0.8 a pair's distance is about 10 with a deviation of
3, so over 99 of 100 pairs lie within 19 bits, and equal passages always do. Items or documents with fewer words than a shingle, nulls and empty texts match nothing. Null ids are kept as
null. Repeated documents are each reported; repeated items once. The shingles of the items are broadcast only while
they number at most BROADCAST_ROWS; beyond, documents' shingles are joined by a shuffle. Other columns of either table, whatever their
names, are not read (and stay, in drop_contaminated()). A script without spaces has one word a sentence, so that only whole equal
sentences match there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table

SHINGLE, THRESHOLD = 5, 0.8
BLOCKS, NEAR = 4, 4
RADIUS = BLOCKS * (NEAR + 1) - 1
BROADCAST_ROWS = 200_000


def shingle_hashes(text: str) -> Column:
    """Hashes of all shingles of a text, by position. The words are bound as a lambda's variable, so that they are split once and not once for each shingle."""
    ws = f"filter(split(lower(coalesce({text}, '')), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> w != '')"
    each = f"transform(sequence(1, size(ws) - {SHINGLE - 1}), i -> xxhash64({', '.join(f'element_at(ws, i + {k})' for k in range(SHINGLE))}))"
    return F.expr(f"element_at(transform(array({ws}), ws -> CASE WHEN size(ws) >= {SHINGLE} THEN {each} ELSE cast(array() AS array<bigint>) END), 1)")


def simhash(col: str) -> Column:
    """64-bit SimHash of an array of shingle hashes; a repeated shingle weighs as often as it stands."""
    return F.expr(f"aggregate(transform(sequence(0, 63), i -> CASE WHEN 2 * size(filter({col}, h -> shiftrightunsigned(h, i) & 1L = 1L)) > size({col}) THEN shiftleft(1L, i) ELSE 0L END), 0L, (s, b) -> s | b)")


def block(col: str, i: int) -> Column:
    return F.expr(f"shiftrightunsigned({col}, {16 * i}) & 65535")


def items_table(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """(item, item_id, n_words, hs, print); item tells rows apart."""
    items = benchmark.select(F.col(key).alias("item_id"), F.col(text).alias("t")).distinct()
    items = cut(items.select("item_id", F.xxhash64(F.col("item_id").cast("string"), F.lit("|"), F.col("t")).alias("item"), shingle_hashes("t").alias("hs")), "shingles").where(F.size("hs") > 0)
    return items.select("item", "item_id", (F.size("hs") + (SHINGLE - 1)).alias("n_words"), "hs", simhash("hs").alias("print"))


def index(items: DataFrame) -> DataFrame:
    """(item, n_words, b, value): every block value within NEAR bits of an item's own."""
    masks = ",".join(str(m) for m in range(1 << 16) if m.bit_count() <= NEAR)
    own = items.select("item", "n_words", F.col("print").alias("item_print"), F.posexplode(F.array(*(block("print", i) for i in range(BLOCKS)))).alias("b", "v"))
    return own.select("item", "n_words", "item_print", "b", "v", F.explode(F.split(F.lit(masks), ",")).alias("mask")).select("item", "n_words", "item_print", "b", F.expr("v ^ cast(mask AS bigint)").alias("value"))


def windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(row, at, n_words): item-sized windows of documents that share a shingle with an item of that size."""
    gram = items.select("n_words", F.posexplode("hs").alias("k", "h")).groupBy("h").agg(F.collect_set("n_words").alias("sizes"), F.collect_set(F.when(F.col("k") == 0, F.col("n_words"))).alias("heads"))
    few = gram.count() <= BROADCAST_ROWS
    gram = F.broadcast(gram) if few else gram
    each = docs.select("row", F.posexplode(shingle_hashes("t")).alias("at", "h"))
    hits = each.join(gram, "h").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "sizes", "heads"))).alias("hits"))
    # the sorted hits are bound as a variable too
    begins = hits.select("row", F.explode(F.expr("""
        flatten(element_at(transform(array(hits), hits -> transform(hits, (x, i) -> transform(
            filter(x.sizes, n -> array_contains(x.heads, n) OR i = 0 OR hits[i - 1].at < x.at - 1 OR NOT array_contains(hits[i - 1].sizes, n)),
            n -> named_struct('at', x.at, 'n_words', n)))), 1))""")).alias("w")).select("row", "w.*")  # fmt: skip
    return begins


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, at, n_words, distance): for each document and item with a similar window, the most similar (the earliest of equal ones); at counts words from 0.
    A row of docs is told from others by its id and its text; repeated rows are reported together."""
    items = cut(items_table(benchmark, item_key, item_text), "items")
    own = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(key).cast("string"), F.lit("|"), F.col(text)).alias("row"), F.col(text).alias("t"))
    begins = cut(windows(own, items).distinct(), "begins")
    texts = own.join(begins.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"]).select("row", "doc_id", shingle_hashes("t").alias("hs"))
    own_size = F.col("n_words") - (SHINGLE - 1)
    cutout = begins.join(texts, "row").select("row", "doc_id", "at", "n_words", F.slice("hs", F.col("at") + 1, own_size).alias("hs"))
    prints = cut(cutout.withColumn("print", simhash("hs")), "windows")
    # copies of a passage have one fingerprint, which is looked up once
    looked = prints.select("n_words", "print").distinct().select("n_words", "print", F.posexplode(F.array(*(block("print", i) for i in range(BLOCKS)))).alias("b", "value"))
    pairs = looked.join(index(items).hint("merge"), ["n_words", "b", "value"]).withColumn("distance", F.expr("bit_count(print ^ item_print)")).where(F.col("distance") <= RADIUS)
    both = prints.join(pairs.select("n_words", "print", "item", "distance").distinct(), ["n_words", "print"]).join(items.select("item", "item_id", F.col("hs").alias("item_hs")), "item")
    shared = F.expr("aggregate(array_distinct(hs), 0, (s, h) -> s + least(size(filter(hs, x -> x = h)), size(filter(item_hs, x -> x = h))))")
    scored = both.withColumn("shared", shared).withColumn("similarity", F.col("shared") / (F.size("hs") + F.size("item_hs") - F.col("shared")))
    found = scored.where(F.col("similarity") >= THRESHOLD)
    best = found.groupBy("row", "doc_id", "item", "item_id").agg(F.max(F.struct("similarity", (-F.col("at")).alias("neg"), "n_words", "distance")).alias("m"))
    return best.select("row", "doc_id", "item_id", F.col("m.similarity").alias("similarity"), (-F.col("m.neg")).alias("at"), F.col("m.n_words").alias("n_words"), F.col("m.distance").alias("distance"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of docs without a benchmark passage; all columns stay."""
    bad = contamination(docs, benchmark, key, text).select(F.col("row").alias("_row")).distinct()
    return docs.join(bad, F.xxhash64(F.col(key).cast("string"), F.lit("|"), F.col(text)) == bad["_row"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "similarity", F.col("at").cast("bigint").alias("at"))


#: The query's rows, by exact similarity of every window that begins with a shared shingle.
ORACLE = r"""
WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
l AS (SELECT kind, id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM t),
w AS (SELECT kind, id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM l),
g AS (SELECT kind, id, pos, count(*) OVER v AS n, string_agg(word, ' ') OVER v AS g FROM w WINDOW v AS (PARTITION BY kind, id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
s AS (SELECT kind, id, pos, g FROM g WHERE n = 5),
size AS (SELECT kind, id, count(*) AS n FROM s GROUP BY 1, 2),
item AS (SELECT id, g, count(*) AS tf FROM s WHERE kind = 'i' GROUP BY 1, 2),
hit AS (SELECT s.id AS doc_id, s.pos, s.g, item.id AS item_id, tf FROM s JOIN item USING (g) WHERE kind = 'd'),
win AS (SELECT a.doc_id, a.item_id, a.pos AS p, b.g, max(b.tf) AS tf, count(*) AS m FROM hit a JOIN size i ON i.kind = 'i' AND i.id = a.item_id JOIN hit b ON b.doc_id = a.doc_id AND b.item_id = a.item_id AND b.pos BETWEEN a.pos AND a.pos + i.n - 1 GROUP BY 1, 2, 3, 4),
sim AS (SELECT doc_id, item_id, p, sum(least(m, tf)) AS shared FROM win GROUP BY 1, 2, 3),
r AS (SELECT doc_id, item_id, p, CAST(shared AS DOUBLE) / (i.n + least(i.n, d.n - p) - shared) AS similarity FROM sim JOIN size i ON i.kind = 'i' AND i.id = item_id JOIN size d ON d.kind = 'd' AND d.id = doc_id)
SELECT doc_id, item_id, max(similarity) AS similarity, CAST(arg_max(p, similarity * 1e9 - p) AS BIGINT) AS "at" FROM r WHERE similarity >= 0.8 GROUP BY 1, 2
"""
