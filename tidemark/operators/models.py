"""Supervised models and clusterings by merging."""

from __future__ import annotations

from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import ElementwiseProduct, PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.relational import folds
from tidemark.operators.mixtures import ROWS, fit_gmm, fit_packed, pack, select_gmm
from tidemark.operators.vectors import score_gmm
from tidemark.sources.scratch import cut

MOVEMENT_FEATURES = ("body_energy_ave", "body_abs_mean", "body_std")
STRESS_FEATURES = ("mean_rr", "rmssd", "pnn50", "skewness", "lf", "hf", "lf_hf")


def svm(features: tuple[str, ...], label: str, degree: int = 1, reg: float = 0.01) -> Pipeline:
    """Standardised features, their products up to a degree, and a linear support vector machine."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="skip"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True)]
    if degree > 1:
        stages.append(PolynomialExpansion(degree=degree, inputCol="_scaled", outputCol="_wide"))
    return Pipeline(stages=[*stages, LinearSVC(featuresCol="_wide" if degree > 1 else "_scaled", labelCol=label, regParam=reg, maxIter=50)])


def train_movement(feats: DataFrame, label: str = "label"):
    return svm(MOVEMENT_FEATURES, label).fit(feats)


def cubic_weights(n: int, degree: int = 3) -> list[float]:
    """Square roots of the coefficients of (1 + x . z)^degree, in the order of Spark's polynomial expansion of n places: with them the expansion's products are the kernel's (less its constant). The
    order is read off the expansion of n primes, whose products tell their factors."""
    primes = [q for q in range(2, 10 * n + 20) if all(q % d for d in range(2, int(q**0.5) + 1))][:n]
    out = []
    for v in _expanded(primes, degree):
        powers, rest = [], round(v)
        for q in primes:
            powers.append(0)
            while rest % q == 0:
                rest, powers[-1] = rest // q, powers[-1] + 1
        c = factorial(degree) // factorial(degree - sum(powers))
        for k in powers:
            c //= factorial(k)
        out.append(c**0.5)
    return out


def _expanded(x: list[float], degree: int) -> list[float]:
    """PolynomialExpansion of one vector."""
    one = SparkSession.active().createDataFrame([(Vectors.dense([float(v) for v in x]),)], ["x"])
    return PolynomialExpansion(degree=degree, inputCol="x", outputCol="y").transform(one).first()["y"].toArray().tolist()


#: What is added to the curvature, and how far the steps go, in the search for a better place.
DAMPING, LENGTHS = (0.0, 0.01, 1.0, 100.0), (1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 0.001)


def hinge_fit(rows: DataFrame, size: int, box: float, widths: tuple[float, ...] = (2.0, 0.3, 0.03, 0.003, 0.0005), steps: int = 25) -> np.ndarray:
    """Weights and, last, the intercept that make |w|^2 / 2 + box * sum of hinge losses least, of rows (v ARRAY<DOUBLE>, y 0 or 1). The hinge's corner is rounded over ever smaller widths, and each problem is solved
    by Newton's steps. A pass over the rows gives a step's gradient and curvature, another the losses that it and shorter ones lead to; tasks send sums of (size + 1)^2 numbers."""
    w = np.zeros(size + 1)

    def margins(b, w):
        x = np.concatenate([np.stack(b["v"].to_numpy()), np.ones((len(b), 1))], axis=1)
        side = np.where(b["y"].to_numpy() > 0.5, 1.0, -1.0)
        return x, side, 1 - side * (x @ w)

    def loss(z, h):
        return np.where(z >= h, z, np.where(z > -h, (z + h) ** 2 / (4 * h), 0.0))

    def summed(run) -> np.ndarray:
        part = rows.mapInPandas(run, "s array<double>").select(F.posexplode("s").alias("i", "a")).groupBy("i").agg(F.sum("a").alias("a")).orderBy("i").collect()
        return np.array([r["a"] for r in part])

    for h in widths:
        for _ in range(steps):

            def slopes(batches, w=w, h=h):
                total = np.zeros((size + 1) * (size + 2))
                for b in batches:
                    if len(b):
                        x, side, z = margins(b, w)
                        near = x[np.abs(z) < h]
                        total += np.concatenate([-(side * np.clip((z + h) / (2 * h), 0, 1)) @ x, (near.T @ near / (2 * h)).ravel()])
                yield pd.DataFrame({"s": [total.tolist()]})

            got = summed(slopes)
            if not len(got):
                return w
            flat = np.append(np.ones(size), 0.0)
            grad, bent = flat * w + box * got[: size + 1], box * got[size + 1 :].reshape(size + 1, size + 1)
            # where few rows lie in the corner the curvature changes within a step: damped and shortened ones are tried, too
            moves = np.array([t * -np.linalg.solve(np.diag(flat + 1e-9 + m) + bent, grad) for m in DAMPING for t in LENGTHS] + [np.zeros(size + 1)])

            def along(batches, w=w, h=h, moves=moves):
                total = np.zeros(len(moves))
                for b in batches:
                    if len(b):
                        x, side, z = margins(b, w)
                        total += loss(z[:, None] - side[:, None] * (x @ moves.T), h).sum(axis=0)
                yield pd.DataFrame({"s": [total.tolist()]})

            at = box * summed(along) + 0.5 * ((w + moves)[:, :-1] ** 2).sum(axis=1)
            best = int(np.argmin(at))
            if at[-1] - at[best] <= 1e-9 * max(1.0, abs(at[-1])):
                break
            w = w + moves[best]
    return w


class KernelMachine:
    """A fitted KernelSVM: transform adds decision and prediction."""

    def __init__(self, products, weights: np.ndarray):
        self.products, self.weights = products, weights

    def transform(self, df: DataFrame) -> DataFrame:
        w = F.array(*(F.lit(float(v)) for v in self.weights[:-1]))
        decision = F.aggregate(F.zip_with(vector_to_array("_wide"), w, lambda a, b: a * b), F.lit(float(self.weights[-1])), lambda s, a: s + a)
        wide = self.products.transform(df).withColumn("decision", decision)
        return wide.select(*df.columns, "decision", (F.col("decision") > 0).cast("double").alias("prediction"))

    def save(self, path: str) -> None:
        """Stages in the format of Spark's own writer, weights as Parquet; what stood there is replaced."""
        self.products.write().overwrite().save(f"{path}/products")
        spark = SparkSession.active()
        spark.createDataFrame([(i, float(v)) for i, v in enumerate(self.weights)], "place int, weight double").coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")

    @staticmethod
    def load(path: str) -> KernelMachine:
        rows = SparkSession.active().read.parquet(f"{path}/weights").orderBy("place").collect()
        return KernelMachine(PipelineModel.load(f"{path}/products"), np.array([r["weight"] for r in rows]))


class KernelSVM:
    """A support vector machine with kernel (1 + x . z / scale^2)^degree over standardised features and box constraint box. Few features have few products (119 of seven,
    at degree 3), so the kernel is written out, each product weighted so that inner products are the kernel's, and the machine is fitted to them as a linear one: its work grows with
    the rows and not with their square. scale is by default the root of the number of features. Rows with a missing feature are left out."""

    def __init__(self, features: tuple[str, ...], label: str = "label", box: float = 1.0, scale: float | None = None, degree: int = 3):
        self.features, self.label, self.box, self.scale, self.degree = features, label, box, float(scale or len(features) ** 0.5), degree

    def fit(self, df: DataFrame) -> KernelMachine:
        n, weights = len(self.features), cubic_weights(len(self.features), self.degree)
        products = Pipeline(
            stages=[
                VectorAssembler(inputCols=list(self.features), outputCol="_raw", handleInvalid="skip"), StandardScaler(inputCol="_raw", outputCol="_standard", withMean=True),
                ElementwiseProduct(scalingVec=Vectors.dense([1 / self.scale] * n), inputCol="_standard", outputCol="_scaled"), PolynomialExpansion(degree=self.degree, inputCol="_scaled", outputCol="_products"),
                ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol="_products", outputCol="_wide"),
            ]
        ).fit(df)
        rows = cut(products.transform(df.where(F.col(self.label).isNotNull())).select(vector_to_array("_wide").alias("v"), F.col(self.label).cast("double").alias("y")), "products")
        return KernelMachine(products, hinge_fit(rows, len(weights), self.box))


def train_stress(feats: DataFrame, label: str = "label", features: tuple[str, ...] = STRESS_FEATURES, box: float = 1.0, scale: float | None = None) -> KernelMachine:
    return KernelSVM(features, label, box, scale).fit(feats)


def fold_predictions(feats: DataFrame, pipeline: Pipeline | KernelSVM, key: str, n: int = 5) -> DataFrame:
    """Rows with fold and the prediction of a model of the other folds; folds by checksum of the key."""
    d, out = folds(feats, key, n), None
    for k in range(n):
        own = pipeline.fit(d.where(F.col("fold") != k)).transform(d.where(F.col("fold") == k)).select(*d.columns, "prediction")
        out = own if out is None else out.unionByName(own)
    return out


def fold_accuracy(feats: DataFrame, pipeline: Pipeline | KernelSVM, key: str, label: str = "label", n: int = 5) -> list[float]:
    """Accuracy on each fold of a model of the others; folds by checksum of the key."""
    d, out = folds(feats, key, n), []
    for k in range(n):
        model = pipeline.fit(d.where(F.col("fold") != k))
        out.append(model.transform(d.where(F.col("fold") == k)).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0])
    return out


def initial_clusters(feats: DataFrame, key: str, vector: str, ks: list[int]) -> DataFrame:
    """Rows with the component (of the mixture with the least BIC, weights taken as equal) that is likeliest; of any number of rows a key."""
    fits = select_gmm(feats, key, vector, ks)
    params = fits.withColumn("weight", F.lit(1.0)).groupBy(key).agg(F.collect_list(F.struct("comp", "weight", "mean", "var")).alias("_p"))
    z = f"aggregate(zip_with(zip_with({vector}, p.mean, (a, b) -> (a - b) * (a - b)), p.var, (d, s) -> d / s + ln(s)), 0D, (a, b) -> a + b)"
    return feats.join(params, key).withColumn("cluster", F.expr(f"array_min(transform(_p, p -> named_struct('d', {z}, 'comp', p.comp))).comp")).drop("_p")


class Merging:
    """Clusters of recordings that are merged by pairs. Frames are packed once by the cluster they begin in; a merge only changes which cluster a beginning belongs to. Scores of clusters and pairs
    are kept, and a round fits only those that the last one touched; fitted counts the pairs that were."""

    def __init__(self, frames: DataFrame, g: int, rows: int = ROWS):
        self.g, self.rows, self.fitted = g, rows, 0
        own = frames.select("rec_id", "label", F.col("v"), F.to_json(F.struct("rec_id", "label")).alias("_src"))
        self.packed = pack(own, "_src", "v", rows)
        self.now = cut(own.select("rec_id", F.col("label").alias("_base"), "label", "_src").distinct(), "clusters")
        self.scores = None

    def _fit(self, members: DataFrame, k: int) -> DataFrame:
        return fit_packed(self.packed, members, [k], rows=self.rows).where("comp = 0").select("key", "bic")

    def round(self) -> int:
        """Merges of each recording at most the pair of the least change of BIC, if not over zero; how many were merged."""
        keys = lambda *c: F.to_json(F.struct("rec_id", *c))
        names = self.now.select("rec_id", "label").distinct()
        own = self.now.select(keys("label").alias("key"), F.col("_src").alias("src"))
        ends = names.select("rec_id", F.col("label").alias("a")).join(names.select("rec_id", F.col("label").alias("b")), "rec_id").where("a < b").withColumn("key", keys("a", "b"))
        wanted, both = own.select("key").distinct(), ends
        if self.scores is not None:
            wanted, both = wanted.join(self.scores, "key", "left_anti"), ends.join(self.scores, "key", "left_anti")
        both = cut(both, "pairs")
        self.fitted += both.count()
        pair = both.join(self.now, "rec_id").where("label = a OR label = b").select("key", F.col("_src").alias("src"))
        new = self._fit(own.join(wanted, "key", "left_semi"), self.g).unionByName(self._fit(pair, 2 * self.g))
        self.scores = cut(new if self.scores is None else self.scores.unionByName(new), "scores")
        at = ends.withColumns({"_ka": keys(F.col("a").alias("label")), "_kb": keys(F.col("b").alias("label"))}).join(self.scores, "key").drop("key")
        at = at.join(self.scores.select(F.col("key").alias("_ka"), F.col("bic").alias("ba")), "_ka").join(self.scores.select(F.col("key").alias("_kb"), F.col("bic").alias("bb")), "_kb")
        best = cut(at.withColumn("d", F.col("bic") - F.col("ba") - F.col("bb")).groupBy("rec_id").agg(F.min(F.struct("d", "a", "b")).alias("m")).where("m.d <= 0"), "merges")
        merged = best.count()
        if merged:
            self.now = cut(self.now.join(best, "rec_id", "left").withColumn("label", F.when(F.col("label") == F.col("m.b"), F.col("m.a")).otherwise(F.col("label"))).drop("m"), "clusters")
            touched = best.select("rec_id", F.explode(F.array("m.a", "m.b")).alias("_t"))
            gone = touched.select(keys(F.col("_t").alias("label")).alias("key")).unionByName(ends.join(touched, "rec_id").where("a = _t OR b = _t").select("key")).distinct()
            self.scores = cut(self.scores.join(gone, "key", "left_anti"), "scores")
        return merged

    def labels(self, frames: DataFrame) -> DataFrame:
        """The frames with the labels of now."""
        return frames.withColumnRenamed("label", "_base").join(self.now.select("rec_id", "_base", "label"), ["rec_id", "_base"]).select(*frames.columns)


def merge_round(frames: DataFrame, g: int) -> DataFrame:
    """frames (rec_id, label, v) after at most one merge per recording: of all pairs of clusters the one with the least change of BIC, if it is not over
    zero. Clusters are fitted with g Gaussians, pairs with 2 g."""
    merging = Merging(frames, g)
    merging.round()
    return merging.labels(frames)


def merge_clusters(frames: DataFrame, g: int, rounds: int = 25) -> DataFrame:
    """Rounds of merge_round until nothing changes; only what a merge touched is fitted again."""
    merging = Merging(frames, g)
    for _ in range(rounds):
        if not merging.round():
            break
    return merging.labels(frames)


def drop_worst(feats: DataFrame, params: DataFrame, key: str, vector: str, share: float = 0.1) -> DataFrame:
    """Rows but those whose log density under a mixture is in its lowest share, by exact rank within the whole."""
    s = score_gmm(feats, params, key, vector)
    # the rank's value is within a band around the approximate one (10 times its error to each side); only the band's values are sorted in one task
    band = s.agg(F.ceil(F.lit(share) * F.count("log_density") - 1e-9).alias("_rank"), *(F.percentile_approx("log_density", min(1.0, max(0.0, share + d)), 10_000).alias(n) for n, d in (("_lo", -1e-3), ("_hi", 1e-3))))
    counts = s.groupBy("log_density").agg(F.count("*").alias("_m")).join(F.broadcast(band), F.col("log_density") <= F.col("_hi"))
    counts = counts.groupBy(F.greatest("log_density", "_lo").alias("_c"), "_rank").agg(F.sum("_m").alias("_m"))  # all below the band as one
    cut = counts.withColumn("_m", F.sum("_m").over(Window.orderBy("_c"))).where("_m >= _rank AND _rank > 0").agg(F.coalesce(F.min("_c"), F.lit(float("-inf"))).alias("_c"))
    return feats.join(s.join(F.broadcast(cut), F.col("log_density") > F.col("_c")).select(key), key, "left_semi")


def lda_fit(df: DataFrame, vector: str, label: str, n: int) -> np.ndarray:
    """Matrix [place, n] of the n directions with the largest ratio of scatter between classes to scatter within. Each task adds up its rows' products in one matrix and its classes' sums; tasks'
    sums are added by place, and a small eigenproblem is solved here. Null vectors and labels are left out."""
    rows = df.select(F.col(label).cast("string").alias("c"), F.col(vector).cast("array<double>").alias("v")).where("c IS NOT NULL AND v IS NOT NULL")

    def add_up(batches):
        total, classes = None, {}
        for b in batches:
            if not len(b):
                continue
            z = np.stack(b["v"].to_numpy())
            total = z.T @ z if total is None else total + z.T @ z
            for c, own in b.groupby("c").indices.items():
                m, s = classes.get(c, (0, 0.0))
                classes[c] = (m + len(own), s + z[own].sum(axis=0))
        if total is not None:
            yield pd.DataFrame({"c": [None, *classes], "n": [0, *(m for m, _ in classes.values())], "s": [total.ravel().tolist(), *(s.tolist() for _, s in classes.values())]})

    part = rows.mapInPandas(add_up, "c string, n bigint, s array<double>")
    sums = part.select("c", "n", F.posexplode("s").alias("k", "a")).groupBy("c", "k").agg(F.sum("n").alias("n"), F.sum("a").alias("a"))
    got = sums.groupBy("c").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("k", "a"))).alias("s")).collect()  # a row a class, and one of places squared
    one = {r["c"]: (r["n"], np.array([q["a"] for q in r["s"]])) for r in got}
    total = one.pop(None)[1]
    size = round(len(total) ** 0.5)
    total = total.reshape(size, size)
    counts = np.array([m for m, _ in one.values()], float)
    m = np.array([s for _, s in one.values()]) / counts[:, None]
    grand = counts @ m / counts.sum()
    within = total - (m * counts[:, None]).T @ m
    between = ((m - grand) * counts[:, None]).T @ (m - grand)
    half = np.linalg.inv(np.linalg.cholesky(within + 1e-9 * np.trace(within) * np.eye(size)))
    values, vectors = np.linalg.eigh(half @ between @ half.T)
    return half.T @ vectors[:, np.argsort(values)[::-1][:n]]
