"""Filters, labels, sorts, samples and unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Annotation symbols of beats.
BEAT_SYMBOLS = ("N", "L", "R", "B", "A", "a", "J", "S", "V", "r", "F", "e", "j", "n", "E")
#: Label codes without a meaning, and thresholds of the three movement features.
UNDEFINED_LABELS = (0, 5, 6, 7)
MOVEMENT_THRESHOLDS = {"body_energy_ave": 0.008, "body_abs_mean": 0.1, "body_std": 0.12}


def drop_labels(df: DataFrame, codes=UNDEFINED_LABELS, label: str = "label") -> DataFrame:
    return df.where(~F.col(label).isin(*codes))


def scale(df: DataFrame, cols: list[str], k: float = 1000.0) -> DataFrame:
    return df.withColumns({c: F.col(c) / k for c in cols})


def keep_beats(ann: DataFrame, col: str = "sym") -> DataFrame:
    return ann.where(F.col(col).isin(*BEAT_SYMBOLS))


def binarize_label(df: DataFrame, positive=None, negative=None, label: str = "label") -> DataFrame:
    hit = F.col(label).isin(*positive) if positive is not None else ~F.col(label).isin(*negative)
    return df.withColumn("binary", F.when(hit, 1).otherwise(0))


def min_duration(segs: DataFrame, least: float, inclusive: bool = False) -> DataFrame:
    """Segments not shorter than least samples; inclusive counts both ends."""
    return segs.where(F.col("end") - F.col("begin") + (1 if inclusive else 0) >= least)


def sample_rate(df: DataFrame, t: str = "t") -> DataFrame:
    """One over the mean time between samples, to two digits; null for one sample or none between."""
    return df.groupBy("rec_id").agg(F.count("*").alias("n"), F.max(t).alias("b"), F.min(t).alias("a")).select("rec_id", F.round(F.expr("try_divide(n - 1, b - a)"), 2).alias("fs"))


def having_enough(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.join(df.groupBy(key).count().where(F.col("count") >= n).select(key), key, "left_semi")


def threshold_vote(feats: DataFrame, thresholds: dict[str, float] | None = None, k: int = 2) -> DataFrame:
    """movement = 1 when at least k features reach their threshold."""
    votes: list[Column] = [(F.col(c) >= t).cast("int") for c, t in (thresholds or MOVEMENT_THRESHOLDS).items()]
    return feats.withColumn("movement", (reduce(Column.__add__, votes) >= k).cast("int"))


def select_label(segs: DataFrame, label) -> DataFrame:
    return segs.where(F.col("label") == label)


def drop_unlabelled(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label) != 0)


def sort_segments(segs: DataFrame) -> DataFrame:
    return segs.orderBy("rec_id", "begin", "end", "label")


def best(df: DataFrame, key: str, score: str, what: str) -> DataFrame:
    """For each key, the what of the least score (of equal ones the least what)."""
    return df.groupBy(key).agg(F.min(F.struct(score, what)).alias("_m")).select(key, f"_m.{what}", f"_m.{score}")


def worst_rows(df: DataFrame, score: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.col(score), F.col(tie)).limit(k)


def sample_rows(df: DataFrame, k: int, key: str, seed: int = 0) -> DataFrame:
    """k rows in the order of a hash of their key: the same rows each time."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(k)


#: Weights that sample_weighted sends to every draw, at most.
FEW_WEIGHTS = 10_000


def sample_weighted(weights: DataFrame, key: str, w: str, n: int, seed: int = 0) -> DataFrame:
    """(draw, key): n draws with replacement by weights of few keys (classes, components; more than FEW_WEIGHTS raise). A draw is a seeded checksum of its number, so it is the same each time; keys without a positive weight
    are never drawn. The weights go to the draws as one array."""
    some = weights.where(F.col(w) > 0).select(key, w)
    if some.limit(FEW_WEIGHTS + 1).count() > FEW_WEIGHTS:
        raise ValueError(f"more than {FEW_WEIGHTS} weights")
    listed = some.agg(F.sort_array(F.collect_list(F.struct(key, w))).alias("_a")).where("size(_a) > 0")
    sums = F.aggregate("_a", F.expr("cast(array() AS array<double>)"), lambda s, a: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0)) + a[w])))
    listed = listed.withColumn("_s", sums)  # one row
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("draw"), F.col("draw"), F.lit(seed))), 1, 13), 16, 10).cast("double") / float(16**13)
    draws = weights.sparkSession.range(n).withColumnRenamed("id", "draw").join(F.broadcast(listed), F.lit(True))
    at = F.size(F.filter("_s", lambda c: c <= draw * F.element_at("_s", -1)))
    return draws.select("draw", F.element_at("_a", F.least(at + 1, F.size("_a")))[key].alias(key))


def holdout(df: DataFrame, key: str, every: int = 5) -> DataFrame:
    """held_out for one key in so many, by a checksum: stable under any partitioning."""
    return df.withColumn("held_out", F.crc32(F.col(key).cast("string")) % every == 0)


def folds(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    return df.withColumn("fold", F.crc32(F.col(key).cast("string")) % n)


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def merge_classes(segs: DataFrame, mapping: dict) -> DataFrame:
    out = F.col("label")
    for a, b in mapping.items():
        out = F.when(F.col("label") == a, F.lit(b)).otherwise(out)
    return segs.withColumn("label", out)


def labels(segs: DataFrame) -> DataFrame:
    return segs.select("label").distinct()


def relabel(segs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Labels by a table (label, name); others stay out."""
    return segs.join(mapping, "label").drop("label").withColumnRenamed("name", "label")


def compact_labels(segs: DataFrame) -> DataFrame:
    """Labels numbered from 1 within each recording, in their order."""
    names = segs.select("rec_id", "label").distinct().withColumn("compact", F.dense_rank().over(Window.partitionBy("rec_id").orderBy("label")))
    return segs.join(names, ["rec_id", "label"])
