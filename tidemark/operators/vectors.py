"""Vectors, nearest centres and Gaussian mixtures, on arrays. Centres and components are few and bounded by the caller's k."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Centres or components are broadcast while they are at most so many.
FEW = 10_000


def _few(df: DataFrame) -> DataFrame:
    """Broadcast only when its rows are counted to be few."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def means(df: DataFrame, vector: str, key: str) -> DataFrame:
    """(key, mean ARRAY<DOUBLE>, var, n) of the vectors of each key, by sums over places."""
    each = df.select(key, F.posexplode(vector).alias("k", "v")).groupBy(key, "k").agg(F.avg(F.col("v").cast("double")).alias("m"), F.var_pop(F.col("v").cast("double")).alias("s"), F.count("*").alias("n"))
    rows = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("k", "m", "s"))).alias("a"), F.max("n").alias("n"))
    return rows.select(key, F.col("a.m").alias("mean"), F.col("a.s").alias("var"), "n")


def class_means(df: DataFrame, vector: str, label: str) -> DataFrame:
    return means(df, vector, label).select(F.col(label).alias("center"), "mean")


def class_gaussians(df: DataFrame, vector: str, label: str) -> DataFrame:
    """(comp, weight, mean, var): one diagonal Gaussian per class."""
    rows = df.count()
    return means(df, vector, label).select(F.col(label).alias("comp"), (F.col("n") / rows).alias("weight"), "mean", "var")


def squared_distance(a: Column, b: Column, w: Column | None = None) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    d = F.zip_with(d, w, lambda x, y: x * y) if w is not None else d
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x)


def distances(x: DataFrame, centers: DataFrame, vector: str, weights: list[float] | None = None, root: bool = False) -> DataFrame:
    """Each row of x with each of few centres (more than FEW raise) and the squared distance, with a weight for each place if given, or its root."""
    if centers.limit(FEW + 1).count() > FEW:
        raise ValueError(f"more than {FEW} centres: their distances to all rows are an all-pairs join; use nearest on groups of centres")
    w = F.array(*(F.lit(float(v)) for v in weights)) if weights else None
    d = squared_distance(F.col(vector).cast("array<double>"), F.col("mean"), w)
    return x.join(F.broadcast(centers), F.lit(True)).withColumn("distance", F.sqrt(d) if root else d)  # counted above


def row_distances(x: DataFrame, y: DataFrame, key: str, vector: str, weights: list[float] | None = None, root: bool = False) -> DataFrame:
    """(key, distance) of the rows of x and y with one key: squared, weighted by place if weights are given, or its root."""
    w = F.array(*(F.lit(float(v)) for v in weights)) if weights else None
    both = x.select(key, F.col(vector).cast("array<double>").alias("_a")).join(y.select(key, F.col(vector).cast("array<double>").alias("_b")), key)
    d = squared_distance(F.col("_a"), F.col("_b"), w)
    return both.select(key, (F.sqrt(d) if root else d).alias("distance"))


def with_nearest(x: DataFrame, centers: DataFrame, vector: str) -> DataFrame:
    """Rows with their nearest centre and its squared distance, found within the row: the few centres come as one array, so no row is shuffled. Of equally near centres the first."""
    if centers.limit(FEW + 1).count() > FEW:
        raise ValueError(f"more than {FEW} centres don't go to every row; use nearest on groups of centres")
    all_ = centers.agg(F.collect_list(F.struct("center", "mean")).alias("_c"))
    best = F.array_min(F.transform("_c", lambda c: F.struct(squared_distance(F.col(vector).cast("array<double>"), c["mean"]).alias("distance"), c["center"].alias("center"))))
    return x.join(F.broadcast(all_), F.lit(True)).withColumn("_b", best).withColumns({"center": F.col("_b.center"), "distance": F.col("_b.distance")}).drop("_b", "_c")


def nearest(x: DataFrame, centers: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, center, distance) of with_nearest."""
    return with_nearest(x.select(key, vector), centers, vector).select(key, "center", "distance")


def kmeans_step(x: DataFrame, centers: DataFrame, key: str, vector: str) -> DataFrame:
    """(center, mean) after one round; a centre without rows drops out (kmeans moves it)."""
    return means(with_nearest(x.select(key, vector), centers, vector), vector, "center").select("center", "mean")


def kmeans(x: DataFrame, centers: DataFrame, key: str, vector: str, rounds: int, errors: list[float] | None = None) -> DataFrame:
    """(center, mean) after rounds of k-means, or when a round changes nothing. Centres without rows move to the rows farthest from their own centres (of equally far ones those of the least keys),
    rows on a centre left out; without such a row a centre stays, so that none is ever lost. errors, if given, gets each round's mean squared distance. Centres are collected each
    round (few by contract), which cuts the lineage."""
    spark = x.sparkSession
    for _ in range(rounds):
        near = with_nearest(x.select(key, vector), centers, vector)
        before = {r["center"]: [float(v) for v in r["mean"]] for r in centers.collect()}
        step = means(near, vector, "center").select("center", F.col("mean").cast("array<double>").alias("mean"))
        now = {r["center"]: r["mean"] for r in step.collect()}
        lost = sorted(before.keys() - now.keys())
        if lost:
            far = near.where("distance > 0").orderBy(F.desc("distance"), key).limit(len(lost)).select(F.col(vector).cast("array<double>").alias("v")).collect()
            now |= {c: r["v"] for c, r in zip(lost, far, strict=False)}
            now |= {c: before[c] for c in lost[len(far) :]}
        if errors is not None:
            errors.append(near.agg(F.avg("distance")).first()[0])
        centers = spark.createDataFrame(sorted(now.items()), step.schema)
        if now == before:
            break
    return centers


def kmeans_harmonic(x: DataFrame, centers: DataFrame, vector: str, e: float = 4.0, rounds: int = 50, tolerance: float = 1e-3, errors: list[float] | None = None) -> DataFrame:
    """(center, mean) of k-harmonic means: a row weighs d^(-e-2) / (sum of d^-e)^2 in each of few centres, d its distance. Ends when the mean of 1 / (sum of d^-e) falls by no more than tolerance of
    itself, or after rounds. Each task adds up a sum for each centre and place; errors, if given, gets that mean of each round."""
    spark = x.sparkSession
    names = [r["center"] for r in centers.orderBy("center").collect()]
    c = np.array([r["mean"] for r in centers.orderBy("center").collect()], float)
    if len(names) > FEW:
        raise ValueError(f"more than {FEW} centres don't go to every task")
    rows = x.select(F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    last = None
    for _ in range(rounds):

        def add_up(batches, c=c):
            sums, n, g = np.zeros((len(c), c.shape[1] + 1)), 0, 0.0
            for b in batches:
                if not len(b):
                    continue
                z = np.stack(b["v"].to_numpy())
                d2 = np.maximum((z**2).sum(axis=1)[:, None] - 2 * z @ c.T + (c**2).sum(axis=1), 0.0)
                least = d2.min(axis=1, keepdims=True)
                r = np.where(d2 > least, least / np.where(d2 > 0, d2, 1.0), 1.0)  # of squares, 1 for the nearest
                part = (r ** (e / 2)).sum(axis=1, keepdims=True)
                w = np.maximum(least, 1e-300) ** (e / 2 - 1) * r ** (e / 2 + 1) / part**2
                sums[:, :-1] += w.T @ z
                sums[:, -1] += w.sum(axis=0)
                n, g = n + len(z), g + float((least ** (e / 2) / part).sum())
            yield pd.DataFrame({"i": range(len(c)), "s": sums.tolist(), "n": [n] + [0] * (len(c) - 1), "g": [g] + [0.0] * (len(c) - 1)})

        each = rows.mapInPandas(add_up, "i int, s array<double>, n bigint, g double")
        total = each.select("i", "n", "g", F.posexplode("s").alias("k", "a")).groupBy("i", "k").agg(F.sum("a").alias("a"), F.sum("n").alias("n"), F.sum("g").alias("g"))
        got = total.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("k", "a"))).alias("s"), F.max("n").alias("n"), F.max("g").alias("g")).orderBy("i").collect()  # a row a centre
        if not got or not got[0]["n"]:
            break
        s = np.array([[q["a"] for q in r["s"]] for r in got])
        c = np.where(s[:, -1:] > 0, s[:, :-1] / np.where(s[:, -1:] > 0, s[:, -1:], 1.0), c)
        g = got[0]["g"] / got[0]["n"]
        if errors is not None:
            errors.append(g)
        if last is not None and last - g <= tolerance * last:
            break
        last = g
    return spark.createDataFrame(list(zip(names, c.tolist(), strict=True)), f"center {centers.schema['center'].dataType.simpleString()}, mean array<double>")


def kmeans_lbg(x: DataFrame, key: str, vector: str, k: int, rounds: int = 5, shift: float = 1e-3) -> DataFrame:
    """Codebook by doubling: each centre splits in two, then rounds of k-means."""
    centers = means(x.withColumn("center", F.lit(0)), vector, "center").select("center", "mean")
    size = 1
    while size < k:
        split = centers.select((F.col("center") * 2).alias("center"), F.transform("mean", lambda v: v * (1 + shift) + shift).alias("mean")).unionByName(centers.select((F.col("center") * 2 + 1).alias("center"), F.transform("mean", lambda v: v * (1 - shift) - shift).alias("mean")))
        split = x.sparkSession.createDataFrame(split.collect(), split.schema)
        centers = kmeans(x, split, key, vector, rounds)
        size *= 2
    return centers


def scatter_traces(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Traces of the scatter within classes and between them."""
    e = df.select(label, F.posexplode(vector).alias("k", "v")).withColumn("v", F.col("v").cast("double"))
    c = e.groupBy(label, "k").agg(F.avg("v").alias("m"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count("*").alias("n"))
    g = c.groupBy("k").agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("g"))
    return c.join(g, "k").agg(F.sum(F.col("q") - F.col("n") * F.col("m") * F.col("m")).alias("within"), F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), 2)).alias("between"))


def score_gmm(x: DataFrame, params: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, log_density, comp): log density under a diagonal mixture and the likeliest component."""
    if params.limit(FEW + 1).count() > FEW:
        raise ValueError(f"more than {FEW} components don't go to every row")
    all_ = params.agg(F.collect_list(F.struct("comp", "weight", "mean", "var")).alias("_p"))

    def log_p(p: Column) -> Column:
        z = F.zip_with(F.zip_with(F.col(vector).cast("array<double>"), p["mean"], lambda a, b: (a - b) * (a - b)), p["var"], lambda d, s: d / s + F.log(2 * F.pi() * s))
        return F.log(p["weight"]) - 0.5 * F.aggregate(z, F.lit(0.0), lambda a, b: a + b)

    scored = x.join(F.broadcast(all_), F.lit(True)).select(key, F.transform("_p", lambda p: F.struct(log_p(p).alias("l"), p["comp"].alias("comp"))).alias("a"))
    top = scored.withColumn("m", F.array_max("a"))
    return top.select(key, (F.col("m.l") + F.log(F.aggregate("a", F.lit(0.0), lambda s, y: s + F.exp(y["l"] - F.col("m.l"))))).alias("log_density"), F.col("m.comp").alias("comp"))


def gmm_kl(params: DataFrame) -> DataFrame:
    """(a, b, kl): divergence between each two components of a mixture, in closed form; components are few."""
    a = params.select(F.col("comp").alias("a"), F.col("mean").alias("ma"), F.col("var").alias("va"))
    b = params.select(F.col("comp").alias("b"), F.col("mean").alias("mb"), F.col("var").alias("vb"))
    d = F.zip_with(F.arrays_zip("ma", "va"), F.arrays_zip("mb", "vb"), lambda x, y: x["va"] / y["vb"] + (x["ma"] - y["mb"]) * (x["ma"] - y["mb"]) / y["vb"] - 1 + F.log(y["vb"] / x["va"]))
    return a.join(_few(b), F.col("a") != F.col("b")).select("a", "b", (0.5 * F.aggregate(d, F.lit(0.0), lambda s, x: s + x)).alias("kl"))


def gmm_global(params: DataFrame) -> DataFrame:
    """(k, mean, var): moments of the whole mixture by place."""
    e = params.select("weight", F.posexplode(F.arrays_zip("mean", "var")).alias("k", "p")).groupBy("k").agg(F.sum(F.col("weight") * F.col("p.mean")).alias("mean"), F.sum(F.col("weight") * (F.col("p.var") + F.col("p.mean") * F.col("p.mean"))).alias("q"))
    return e.select("k", "mean", (F.col("q") - F.col("mean") * F.col("mean")).alias("var"))
