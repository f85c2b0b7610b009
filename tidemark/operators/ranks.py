"""Values of given ranks within keys, exactly, without bringing a key's rows into one task.

A key's rank is first known to lie between its least and its largest value. Each round asks Spark's mergeable quantile sketch for a narrow band of values around the rank within what is left,
counts the rows below and inside it, and keeps the band if the counts prove that it holds the rank (else only the side that it missed goes). A round leaves about a
five-hundredth. When a key has few rows left, its distinct values and their counts come together and are walked through. Keys with few rows need no round at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.vectors import _few
from tidemark.sources.scratch import cut

#: Distinct values of a key and rank that come together at the end, at most (but for one value's repeats).
MOST = 10_000
#: The sketch's relative error is 1 / ACCURACY; a band reaches ten times that to each side.
ACCURACY = 10_000


def at_ranks(df: DataFrame, ranks: DataFrame, key: str, col: str, most: int = MOST) -> DataFrame:
    """(key, rank, value, below, ties): the value of each rank (from 1) of ranks (key, rank) among a key's values, with how many lie below it and how many equal it. Nulls of col and of
    keys don't count; ranks beyond a key's rows give nothing."""
    x = df.select(F.col(key).alias("_key"), F.col(col).alias("_v")).where("_v IS NOT NULL AND _key IS NOT NULL")
    whole = x.groupBy("_key").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("*").alias("inside"))
    left = ranks.select(F.col(key).alias("_key"), F.col("rank").cast("bigint").alias("rank")).distinct().join(whole, "_key").where("rank BETWEEN 1 AND inside")
    left = cut(left.select("_key", "rank", "lo", "hi", F.lit(0).cast("bigint").alias("below"), "inside"), "ranks")
    while True:
        wide = left.where((F.col("inside") > most) & (F.col("lo") < F.col("hi")))
        if wide.isEmpty():
            break
        # one band for the rank within what is left
        met = x.join(_few(wide), "_key").where("_v BETWEEN lo AND hi")
        p = (F.col("rank") - F.col("below")) / F.col("inside")
        tenths = F.array(*(F.lit(i / 1000) for i in range(1001)))
        sketch = met.groupBy("_key", "rank").agg(F.percentile_approx("_v", tenths, F.lit(ACCURACY)).alias("_q"))
        at = F.floor(p * 1000).cast("int")
        band = wide.join(sketch, ["_key", "rank"]).withColumns({"a": F.element_at("_q", F.greatest(at, F.lit(1))), "b": F.element_at("_q", F.least(at + 3, F.lit(1001)))}).drop("_q")
        band = cut(band, "rank-bands")
        counts = x.join(_few(band), "_key").where("_v BETWEEN lo AND hi").groupBy("_key", "rank").agg(F.sum((F.col("_v") < F.col("a")).cast("bigint")).alias("under"), F.sum(F.col("_v").between(F.col("a"), F.col("b")).cast("bigint")).alias("mid"), F.max(F.when(F.col("_v") < F.col("a"), F.col("_v"))).alias("last"), F.min(F.when(F.col("_v") > F.col("b"), F.col("_v"))).alias("next"))
        c = band.join(counts, ["_key", "rank"]).withColumn("r", F.col("rank") - F.col("below"))
        low, high = F.col("r") <= F.col("under"), F.col("r") > F.col("under") + F.col("mid")
        new = c.select(
            "_key", "rank", F.when(low, F.col("lo")).when(high, F.col("next")).otherwise(F.col("a")).alias("lo"), F.when(low, F.col("last")).when(high, F.col("hi")).otherwise(F.col("b")).alias("hi"),
            F.when(low, F.col("below")).when(high, F.col("below") + F.col("under") + F.col("mid")).otherwise(F.col("below") + F.col("under")).alias("below"),
            F.when(low, F.col("under")).when(high, F.col("inside") - F.col("under") - F.col("mid")).otherwise(F.col("mid")).alias("inside"))
        before = wide.agg(F.sum("inside")).first()[0]
        left = cut(left.where(~((F.col("inside") > most) & (F.col("lo") < F.col("hi")))).unionByName(new), "ranks")
        if left.agg(F.sum("inside")).first()[0] >= before and not left.where((F.col("inside") > most) & (F.col("lo") < F.col("hi"))).isEmpty():
            most *= 4  # a band of nearly equal values that no sketch parts: they are few distinct ones
    each = x.join(_few(left), "_key").where("_v BETWEEN lo AND hi").groupBy("_key", "rank", "_v").agg(F.count("*").alias("n"), F.first("below").alias("below"))
    lists = each.groupBy("_key", "rank").agg(F.sort_array(F.collect_list(F.struct("_v", "n"))).alias("_a"), F.first("below").alias("_b"))
    step = F.aggregate(
        "_a", F.struct(F.col("_b").alias("below"), F.lit(None).cast(df.schema[col].dataType).alias("v"), F.lit(0).cast("bigint").alias("n")),
        lambda s, a: F.when(s["v"].isNotNull(), s).when(s["below"] + a["n"] >= F.col("rank"), F.struct(s["below"].alias("below"), a["_v"].alias("v"), a["n"].alias("n"))).otherwise(F.struct((s["below"] + a["n"]).alias("below"), s["v"].alias("v"), s["n"].alias("n"))),
    )
    return lists.withColumn("_s", step).select(F.col("_key").alias(key), "rank", F.col("_s.v").alias("value"), F.col("_s.below").alias("below"), F.col("_s.n").alias("ties"))
