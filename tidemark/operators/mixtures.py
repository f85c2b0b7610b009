"""Diagonal Gaussian mixtures of many keys, of any number of rows each.

Rows are packed once into blocks of at most ROWS vectors (a row a block, in the shared folder), and a key is a set of sources whose blocks it takes: a cluster's, or those of two clusters. A key of at
most ROWS vectors is fitted in one task. For larger ones each step of EM is a pass over the blocks: a block adds up, for each component, what its rows give to its weight, means and squares; Spark
sums these by key, component and place; the next parameters are a row a fit. Both ways are the same algorithm from the same starts (rows of the least seeded hashes of their numbers), so
where a key lies makes no difference but for the last digits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.vectors import _few
from tidemark.sources.scratch import cut

#: Vectors of a block at most, about, and of a key that is fitted in one task.
ROWS = 50_000
#: Seeded starts of each mixture, steps of each, and the most components that are tried.
STARTS, STEPS, MOST_COMPONENTS = 3, 350, 20
FIT = "k int, comp int, weight double, mean array<double>, var array<double>, loglik double, bic double"


def order_of(ids: np.ndarray, seed: int) -> np.ndarray:
    """Seeded hashes of row numbers: starts are the rows where they are least."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed + 1) * 0xD1B54A32D192ED03 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(df: DataFrame, source: str, vector: str, rows: int = ROWS) -> DataFrame:
    """(src, n, size, ids BINARY, data BINARY): each source's vectors in blocks. Null vectors are left out."""
    own = cut(df.select(F.col(source).alias("src"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL").withColumn("id", F.monotonically_increasing_id()), "numbered")
    blocks = own.groupBy("src").agg(F.ceil(F.count("*") / (0.8 * rows)).cast("bigint").alias("blocks"))
    dealt = own.join(_few(blocks), "src").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))

    def build(pdf):
        pdf = pdf.sort_values("id")
        data = np.stack(pdf["v"].to_numpy()).astype(float)
        return pd.DataFrame({"src": [pdf["src"].iloc[0]], "n": [len(data)], "size": [data.shape[1]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "data": [data.tobytes()]})

    kind = own.schema["src"].dataType.simpleString()
    return cut(dealt.groupBy("src", "block").applyInPandas(build, f"src {kind}, n bigint, size int, ids binary, data binary"), "packed")


def unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, float).reshape(-1, size)


def log_parts(z: np.ndarray, w: np.ndarray, mean: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the components in each row, and the rows' log densities."""
    l = np.log(w) - 0.5 * (((z[:, None] - mean) ** 2 / var) + np.log(2 * np.pi * var)).sum(axis=2)  # noqa: E741
    top = l.max(axis=1, keepdims=True)
    p = np.exp(l - top)
    total = p.sum(axis=1, keepdims=True)
    return p / total, (top + np.log(total))[:, 0]


def next_step(n: int, s: np.ndarray, s1: np.ndarray, s2: np.ndarray, mean: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and variances from a step's sums, and which components are empty (they keep their places until they are moved)."""
    empty = s < 1e-3
    down = np.maximum(s, 1e-12)[:, None]
    m = np.where(empty[:, None], mean, s1 / down)
    v = np.where(empty[:, None], var, np.maximum(s2 / down - m**2, 1 / n**2))
    return np.maximum(s, 1e-3) / np.maximum(s, 1e-3).sum(), m, v, empty


def gmm_em(x: np.ndarray, k: int, iterations: int = STEPS, seed: int = 0, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """Weights, means, diagonal variances and log likelihoods per step of a mixture, on scaled data; empty components move to the worst rows. With fewer rows than k, rows start several components."""
    mu, sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-12)
    z = (x - mu) / sd
    n, d = z.shape
    first = np.argsort(order_of(np.arange(n) if ids is None else ids, seed), kind="stable")[:k]
    mean, var, w, seen = z[np.resize(first, k)], np.ones((k, d)), np.full(k, 1 / k), []
    for _ in range(iterations):
        p, row = log_parts(z, w, mean, var)
        seen.append(float(row.sum() - n * np.log(sd).sum()))
        w, mean, var, empty = next_step(n, p.sum(axis=0), p.T @ z, p.T @ z**2, mean, var)
        mean[empty] = z[np.argsort(row, kind="stable")[: empty.sum()]][np.arange(empty.sum()) % n]
        if len(seen) > 1 and seen[-1] - seen[-2] <= 1e-4 * n:
            break
    return w, mean * sd + mu, var * sd**2, seen


def criterion(loglik: float, k: int, d: int, n: int) -> float:
    return -2 * loglik + (2 * k * d + k - 1) * np.log(n)


def _small(blocks: DataFrame, kind: str, ks: list[int], seed: int) -> DataFrame:
    """Fits of keys (key, size, ids, data) whose rows fit in a task."""

    def group(pdf):
        size, k = int(pdf["size"].iloc[0]), int(pdf["k"].iloc[0])
        x, ids = np.concatenate([unpacked(b, size) for b in pdf["data"]]), np.concatenate([np.frombuffer(b, np.int64) for b in pdf["ids"]])
        order = np.argsort(ids)
        x, ids = x[order], ids[order]
        w, m, v, seen = max((gmm_em(x, k, seed=seed + i, ids=ids) for i in range(STARTS)), key=lambda fit: fit[3][-1])
        return pd.DataFrame({"key": pdf["key"].iloc[0], "k": k, "comp": range(k), "weight": w, "mean": list(m), "var": list(v), "loglik": seen[-1], "bic": criterion(seen[-1], k, size, len(x))})

    each = blocks.select("key", "size", "ids", "data", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    return each.groupBy("key", "k").applyInPandas(group, f"key {kind}, {FIT}")


def _large(blocks: DataFrame, kind: str, ks: list[int], seed: int) -> DataFrame:
    """Fits of keys of any size: a pass over the blocks for each step."""

    def first_sums(batches):
        for b in batches:
            for key, size, ids, data in zip(b["key"], b["size"], b["ids"], b["data"], strict=True):
                x, ids = unpacked(data, size), np.frombuffer(ids, np.int64)
                rows = [(i, int(h) - (1 << 63), x[j].tolist()) for i in range(STARTS) for h, j in ((o[j], j) for o in (order_of(ids, seed + i),) for j in np.argsort(o)[: max(ks)])]
                yield pd.DataFrame({"key": [key] * (1 + len(rows)), "start": [-1, *(r[0] for r in rows)], "h": [0, *(r[1] for r in rows)], "v": [np.concatenate([[len(x)], x.sum(axis=0), (x**2).sum(axis=0)]).tolist(), *(r[2] for r in rows)]})

    seeds = cut(blocks.select("key", "size", "ids", "data").mapInPandas(first_sums, f"key {kind}, start int, h bigint, v array<double>"), "mixture-starts")
    whole = seeds.where("start < 0").select("key", F.posexplode("v").alias("i", "a")).groupBy("key", "i").agg(F.sum("a").alias("a"))
    whole = whole.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", "a"))).alias("s")).select("key", F.col("s.a").alias("whole"))
    chosen = seeds.where("start >= 0").groupBy("key", "start").agg(F.slice(F.sort_array(F.collect_list(F.struct("h", "v"))), 1, max(ks)).alias("c"))

    def begin(pdf):
        whole, out = np.asarray(pdf["whole"].iloc[0]), []
        d = (len(whole) - 1) // 2
        n, mu = whole[0], whole[1 : d + 1] / whole[0]
        sd = np.maximum(np.sqrt(np.maximum(whole[d + 1 :] / n - mu**2, 0)), 1e-12)
        for start, rows in zip(pdf["start"], pdf["c"], strict=True):
            z = (np.array([r["v"] for r in rows]) - mu) / sd
            for k in ks:
                out.append({"key": pdf["key"].iloc[0], "k": k, "start": start, "n": int(n), "mu": mu, "sd": sd, "w": np.full(k, 1 / k), "mean": np.resize(z, (k, d)).ravel() if len(z) < k else z[:k].ravel(), "var": np.ones(k * d), "loglik": -np.inf, "steps": 0, "done": False})
        return pd.DataFrame(out)

    state = f"key {kind}, k int, start int, n bigint, mu array<double>, sd array<double>, w array<double>, mean array<double>, var array<double>, loglik double, steps int, done boolean"
    now = cut(chosen.join(whole, "key").groupBy("key").applyInPandas(begin, state), "mixtures")

    def sums(batches):
        """What each block's rows give to each of its key's fits: the sums of a step, and the rows of least density."""
        for b in batches:
            for key, size, data, fits in zip(b["key"], b["size"], b["data"], b["fits"], strict=True):
                x, rows = unpacked(data, size), []
                for f in fits:
                    mu, sd = np.asarray(f["mu"]), np.asarray(f["sd"])
                    total, worst = 0, []
                    for lo in range(0, len(x), 4096):
                        z = (x[lo : lo + 4096] - mu) / sd
                        p, row = log_parts(z, np.asarray(f["w"]), np.asarray(f["mean"]).reshape(f["k"], size), np.asarray(f["var"]).reshape(f["k"], size))
                        total = total + np.concatenate([[row.sum()], p.sum(axis=0), (p.T @ z).ravel(), (p.T @ z**2).ravel()])
                        at = np.argsort(row, kind="stable")[: f["k"]]
                        worst = sorted([*worst, *((float(row[j]), z[j].tolist()) for j in at)])[: f["k"]]
                    rows.append((f["k"], f["start"], total.tolist(), [{"l": r, "v": v} for r, v in worst]))
                yield pd.DataFrame([(key, *r) for r in rows], columns=["key", "k", "start", "s", "worst"])

    def step(pdf):
        out = []
        for r in pdf.to_dict("records"):
            s, k, d = np.asarray(r["s"]), r["k"], len(r["mu"])
            ll = float(s[0] - r["n"] * np.log(np.asarray(r["sd"])).sum())
            w, m, v, empty = next_step(r["n"], s[1 : k + 1], s[k + 1 : k + 1 + k * d].reshape(k, d), s[k + 1 + k * d :].reshape(k, d), np.asarray(r["mean"]).reshape(k, d), np.asarray(r["var"]).reshape(k, d))
            worst = [q["v"] for q in r["worst"]]
            for i, at in enumerate(np.flatnonzero(empty)):
                m[at] = worst[i % len(worst)]
            steps = r["steps"] + 1
            out.append({**r, "w": w, "mean": m.ravel(), "var": v.ravel(), "loglik": ll, "steps": steps, "done": steps > 1 and ll - r["loglik"] <= 1e-4 * r["n"] or steps >= STEPS})
        return pd.DataFrame(out)[[c.split()[0] for c in state.split(", ")]]

    while not (left := now.where("NOT done")).isEmpty():
        fits = left.groupBy("key").agg(F.collect_list(F.struct("k", "start", "mu", "sd", "w", "mean", "var")).alias("fits"))
        part = cut(blocks.select("key", "size", "data").join(_few(fits), "key").mapInPandas(sums, f"key {kind}, k int, start int, s array<double>, worst array<struct<l:double,v:array<double>>>"), "mixture-sums")
        names = ["key", "k", "start"]
        total = part.select(*names, F.posexplode("s").alias("i", "a")).groupBy(*names, "i").agg(F.sum("a").alias("a")).groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("i", "a"))).alias("s"))
        worst = part.select(*names, F.explode("worst").alias("q")).groupBy(*names).agg(F.slice(F.sort_array(F.collect_list("q")), 1, MOST_COMPONENTS).alias("worst"))  # k rows a block
        met = left.join(total.select(*names, F.col("s.a").alias("s")), names).join(worst, names)
        moved = met.groupBy("key").applyInPandas(step, state)
        now = cut(now.where("done").unionByName(moved), "mixtures")

    def end(pdf):
        out = []
        for _, own in pdf.groupby("k"):
            r = own.sort_values(["loglik", "start"], ascending=[False, True]).iloc[0]
            k, d = int(r["k"]), len(r["mu"])
            mean, var = np.asarray(r["mean"]).reshape(k, d) * r["sd"] + r["mu"], np.asarray(r["var"]).reshape(k, d) * np.asarray(r["sd"]) ** 2
            out.append(pd.DataFrame({"key": r["key"], "k": k, "comp": range(k), "weight": r["w"], "mean": list(mean), "var": list(var), "loglik": r["loglik"], "bic": criterion(r["loglik"], k, d, int(r["n"]))}))
        return pd.concat(out)

    return now.groupBy("key").applyInPandas(end, f"key {kind}, {FIT}")


def fit_packed(packed: DataFrame, members: DataFrame, ks: list[int], seed: int = 0, rows: int = ROWS) -> DataFrame:
    """(key, k, comp, weight, mean, var, loglik, bic) for each key of members (key, src) and number of components: the likeliest of STARTS fits to its sources' vectors."""
    kind = members.schema["key"].dataType.simpleString()
    counts = packed.groupBy("src").agg(F.sum("n").alias("n"))
    sizes = cut(members.join(counts, "src").groupBy("key").agg(F.sum("n").alias("_n")), "mixture-sizes")
    blocks = packed.join(_few(members), "src").join(_few(sizes), "key")
    small = _small(blocks.where(F.col("_n") <= rows), kind, ks, seed)
    if sizes.where(F.col("_n") > rows).isEmpty():
        return small
    return small.unionByName(_large(blocks.where(F.col("_n") > rows), kind, ks, seed))


def fit_gmm(df: DataFrame, key: str, vector: str, ks: list[int], seed: int = 0, rows: int = ROWS) -> DataFrame:
    """(key, k, comp, weight, mean, var, loglik, bic): one mixture per key and number of components, over any number of rows."""
    packed = pack(df, key, vector, rows)
    fits = fit_packed(packed, packed.select(F.col("src").alias("key"), "src").distinct(), ks, seed, rows)
    return fits.withColumnRenamed("key", key)


def aic_table(df: DataFrame, key: str, vector: str, ks: list[int], seed: int = 0) -> DataFrame:
    """(key, k, loglik, aic, bic) of one mixture per key and number of components: AIC is twice the free parameters less twice the log likelihood."""
    free = 2 * F.col("k") * F.size("mean") + F.col("k") - 1
    return fit_gmm(df, key, vector, ks, seed).where("comp = 0").select(key, "k", "loglik", (2 * free - 2 * F.col("loglik")).alias("aic"), "bic")


def select_gmm(df: DataFrame, key: str, vector: str, ks: list[int], seed: int = 0, rows: int = ROWS) -> DataFrame:
    """The mixtures of the least BIC per key: of ks, and then, while BIC falls below the least so far, of one component more than
    the most of ks, two more, and so on up to MOST_COMPONENTS (and to the number of the key's rows). Keys that go on are fitted together, a round for each number of components."""
    packed = pack(df, key, vector, rows)
    sizes = packed.groupBy(F.col("src").alias("key")).agg(F.sum("n").alias("_n"))
    fits = cut(fit_packed(packed, sizes.select("key", F.col("key").alias("src")), ks, seed, rows), "fits")
    best = cut(fits.where("comp = 0").groupBy("key").agg(F.min(F.struct("bic", "k")).alias("m")).select("key", "m.bic", "m.k"), "best-fits")
    go = best.select("key")
    for k in range(max(ks) + 1, MOST_COMPONENTS + 1):
        go = go.join(sizes.where(F.col("_n") >= k).select("key"), "key", "left_semi")
        more = cut(fit_packed(packed, go.select("key", F.col("key").alias("src")), [k], seed, rows), "fits")
        better = more.where("comp = 0").select("key", F.col("bic").alias("_b")).join(best.select("key", "bic"), "key").where("_b < bic").select("key", F.col("_b").alias("bic"), F.lit(k).alias("k"))
        better = cut(better, "best-fits")
        if better.isEmpty():
            break
        fits = fits.unionByName(more)
        best = cut(best.join(better, "key", "left_anti").unionByName(better), "best-fits")
        go = better.select("key")
    return fits.join(best.select("key", "k"), ["key", "k"], "left_semi").withColumnRenamed("key", key)
