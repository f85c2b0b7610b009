"""Speech, silence and noise by class models that are fitted again to each recording, and speakers by merging with frames assigned anew between merges.
Recordings are keyed tables of frames; models are rows (rec_id, label, comp, weight, mean, var), joined by recording. Rounds are few and fixed, and each
cuts its lineage by a table in the shared folder."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.aggregates import quantile_n1, quantiles_n1
from tidemark.operators.chunks import CHUNK
from tidemark.operators.models import merge_round
from tidemark.operators.mixtures import fit_gmm, fit_packed, pack
from tidemark.operators.signal import viterbi_labels
from tidemark.sources.scratch import cut

#: Components of each class's first mixture, and its least stay in frames of 10 ms.
COMPONENTS = {"noise": 8, "silence": 6, "speech": 12}
LEAST_FRAMES = {"noise": 25, "silence": 25, "speech": 75}

#: Components of a recording's own speech mixture, and rounds of each step of training.
OWN_SPEECH, BACKGROUND_ROUNDS, ALL_ROUNDS, FINAL_ROUNDS = 8, 3, 3, 4

#: Frames of a window whose energy tells silence and noise; first number of components of each class where all are fitted, what each round adds, and the most.
WINDOW_FRAMES = 25
GROWTH, MOST_GROWN = {"speech": (4, 2), "silence": (2, 1), "noise": (4, 2)}, 10
GROWTH_WITHOUT_NOISE = {"speech": (6, 2), "silence": (2, 1)}

#: Parameters of a mixture's rows are few, so they go to tasks by closure while they are at most so many numbers.
MOST_NUMBERS = 200_000


def fit_large_gmm(df: DataFrame, vector: str, k: int, rounds: int = 30, seed: int = 0, tolerance: float = 1e-4) -> DataFrame:
    """(comp, weight, mean, var) of a diagonal mixture over all rows, of whatever number: each task adds up what its rows give to each component, and those
    sums are added by component. Starts from k rows with the least seeded checksums; components without rows keep their places. Nulls are left out;
    with fewer rows than k, so many components; no rows, no components."""
    x = df.select(F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    spark = df.sparkSession
    first = x.withColumn("h", F.xxhash64("v", F.lit(seed))).orderBy("h", "v").limit(k).collect()
    schema = "comp int, weight double, mean array<double>, var array<double>"
    if not first:
        return spark.createDataFrame([], schema)
    size = len(first[0]["v"])
    if len(first) * size > MOST_NUMBERS:
        raise ValueError(f"{len(first)} components of {size} places are too many for one task's parameters")
    whole = x.select(F.posexplode("v").alias("i", "a")).groupBy("i").agg(F.var_pop("a").alias("s")).orderBy("i").collect()  # one row a place
    base = np.maximum([r["s"] for r in whole], 1e-12)
    mean = np.array([r["v"] for r in first])
    var, w, last = np.tile(base, (len(mean), 1)), np.full(len(mean), 1 / len(mean)), None
    for _ in range(rounds):

        def add_up(batches: Iterator[pd.DataFrame], mean=mean, var=var, w=w):
            n, s1, s2, ll = np.zeros(len(w)), np.zeros(mean.shape), np.zeros(mean.shape), 0.0
            for b in batches:
                if not len(b):
                    continue
                z = np.stack(b["v"].to_numpy())
                # squared distances by their three sums: memory is rows x components, not times places
                l = np.log(w) - 0.5 * ((z**2) @ (1 / var).T - 2 * z @ (mean / var).T + (mean**2 / var).sum(axis=1) + np.log(2 * np.pi * var).sum(axis=1))  # noqa: E741
                top = l.max(axis=1, keepdims=True)
                p = np.exp(l - top)
                ll += float((top[:, 0] + np.log(p.sum(axis=1))).sum())
                p /= p.sum(axis=1, keepdims=True)
                n, s1, s2 = n + p.sum(axis=0), s1 + p.T @ z, s2 + p.T @ z**2
            yield pd.DataFrame({"comp": range(len(w)), "n": n, "s": [np.concatenate([a, b]).tolist() for a, b in zip(s1, s2, strict=True)], "ll": [ll] + [0.0] * (len(w) - 1)})

        part = x.mapInPandas(add_up, "comp int, n double, s array<double>, ll double")
        each = part.select("comp", "n", "ll", F.posexplode("s").alias("i", "a")).groupBy("comp", "i").agg(F.sum("a").alias("a"), F.sum("n").alias("n"), F.sum("ll").alias("ll"))
        got = each.groupBy("comp").agg(F.sort_array(F.collect_list(F.struct("i", "a"))).alias("s"), F.first("n").alias("n"), F.first("ll").alias("ll")).orderBy("comp").collect()  # k rows
        n = np.array([r["n"] for r in got])
        sums = np.array([[a["a"] for a in r["s"]] for r in got])
        m = np.maximum(n, 1e-12)[:, None]
        live = (n > 1e-3)[:, None]
        mean, old = np.where(live, sums[:, :size] / m, mean), mean
        var = np.where(live, np.maximum(sums[:, size:] / m - mean**2, 1e-6 * base), var)
        w = np.maximum(n, 1e-3) / np.maximum(n, 1e-3).sum()
        ll = got[0]["ll"]
        if last is not None and ll - last <= tolerance * n.sum():
            break
        last = ll
    return spark.createDataFrame([(i, float(w[i]), mean[i].tolist(), var[i].tolist()) for i in range(len(w))], schema)


def bootstrap_hmm(feats: DataFrame, label: str = "label", vector: str = "feats", components: dict | None = None, seed: int = 0) -> DataFrame:
    """(label, comp, weight, mean, var): one mixture of each class's labelled frames, over all of them; the chains' least stays are LEAST_FRAMES. Classes without
    frames have no rows. Save and load it as features are."""
    parts = [fit_large_gmm(feats.where(F.col(label) == c), vector, k, seed=seed).select(F.lit(c).alias("label"), "*") for c, k in sorted((components or COMPONENTS).items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def class_logliks(frames: DataFrame, params: DataFrame, vector: str, least: dict | int) -> DataFrame:
    """Frames with loglik ARRAY (log density of each class of their recording's models), classes and lens, in order of class names. Recordings without models drop out."""
    lens = F.create_map(*(F.lit(v) for c in least.items() for v in c)) if isinstance(least, dict) else None
    one = params.groupBy("rec_id", "label").agg(F.sort_array(F.collect_list(F.struct("comp", "weight", "mean", "var"))).alias("p"))
    all_ = one.groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("label", "p"))).alias("_m"))
    names = F.transform("_m", lambda m: m["label"].cast("string"))
    all_ = all_.withColumns({"classes": names, "lens": F.transform(names, lambda c: F.coalesce(lens[c], F.lit(1)) if lens is not None else F.lit(least))})

    def log_p(p):
        z = F.zip_with(F.zip_with(F.col(vector).cast("array<double>"), p["mean"], lambda a, b: (a - b) * (a - b)), p["var"], lambda d, s: d / s + F.log(2 * F.pi() * s))
        return F.log(p["weight"]) - 0.5 * F.aggregate(z, F.lit(0.0), lambda a, b: a + b)

    def log_class(ls):
        top = F.array_max(ls)
        return top + F.log(F.aggregate(ls, F.lit(0.0), lambda s, l: s + F.exp(l - top)))

    scored = frames.join(all_, "rec_id").withColumn("_l", F.transform("_m", lambda m: F.transform(m["p"], log_p)))
    return scored.withColumn("loglik", F.transform("_l", log_class)).drop("_l", "_m")


def relabel(frames: DataFrame, params: DataFrame, vector: str, least: dict | int) -> DataFrame:
    """Frames with the labels of the likeliest sequence under their recording's models."""
    out = viterbi_labels(class_logliks(frames.drop("label"), params, vector, least).select("rec_id", "seq", "loglik", "classes", "lens"))
    return frames.drop("label").join(out, ["rec_id", "seq"])


def numbered(df: DataFrame, keys: list[str], order: str = "seq", size: int = CHUNK) -> DataFrame:
    """Rows with _i, their rank from 0 among their keys' rows by order (unique there), and _n, how many those are. Ranks are told within stretches of `size` of order and shifted by
    the counts of the stretches before, so a window holds a stretch at most, or a row a stretch."""
    d = df.withColumn("_stretch", F.floor(F.col(order) / size))
    all_of = Window.partitionBy(*keys)
    so_far = all_of.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy(*keys, "_stretch").agg(F.count("*").alias("_c"))
    counts = counts.select(*keys, "_stretch", F.coalesce(F.sum("_c").over(so_far), F.lit(0)).alias("_before"), F.sum("_c").over(all_of).alias("_n"))
    own = Window.partitionBy(*keys, "_stretch").orderBy(order)
    return d.join(counts, [*keys, "_stretch"]).withColumn("_i", F.row_number().over(own) - 1 + F.col("_before")).drop("_stretch", "_before")


def class_windows(frames: DataFrame, size: int = WINDOW_FRAMES, hop: int | None = None) -> DataFrame:
    """Frames once for each window that they lie in, with _w and _at (their place in it): a recording's frames of one label, put end to end, in windows of size frames, one every hop (half a window);
    frames after the last whole window have none."""
    hop = hop or max(size // 2, 1)
    d = numbered(frames, ["rec_id", "label"]).where(F.col("_n") >= size)
    d = d.withColumns({"_from": F.greatest(F.lit(0), F.ceil((F.col("_i") - size + 1) / hop)), "_to": F.least(F.floor(F.col("_i") / hop), F.floor((F.col("_n") - size) / hop))}).where("_from <= _to")
    return d.withColumn("_w", F.explode(F.sequence("_from", "_to"))).withColumn("_at", F.col("_i") - F.col("_w") * hop).drop("_from", "_to", "_i", "_n")


def confident_background(frames: DataFrame, level: float | None = None, size: int = WINDOW_FRAMES, hop: int | None = None, name: str = "windows") -> DataFrame:
    """Frames (rec_id, seq, label, energy, zcr, ..) of silence and noise that there's little doubt about, once for each window chosen. Windows are class_windows of the frames called
    silence and of those called noise; a window's energy adds its frames' with squared Hamming weights, its crossings are their mean.

    With a level: silence is the silent windows whose energy is not over their third quartile by more than 1.5 ranges. Noise is, of the noise windows and the silent ones over by more than
    3 ranges, those not under that bound nor under the quantile `level` of them all. Without a level (nothing but the first labels is known), labels don't count: quartiles are those of the
    quietest quarter of all windows, silence lies below the first bound, and noise is over the second and not under the median of the loudest quarter. In both, crossings of noise are not
    under the silence's third quartile by 1.5 ranges more. Recordings without silence give nothing."""
    apart = cut(class_windows(frames.where("label IN ('silence', 'noise')"), size, hop), name)
    weight = F.pow(0.54 - 0.46 * F.cos(2 * F.pi() * F.col("_at") / size), 2)
    each = cut(apart.groupBy("rec_id", "label", "_w").agg(F.sum(weight * F.col("energy")).alias("e"), F.avg("zcr").alias("z")), name)

    def bounds(of: DataFrame, col: str) -> DataFrame:
        q = quantiles_n1(of, "rec_id", col, {"q1": 0.25, "q3": 0.75})
        return q.select("rec_id", (2.5 * F.col("q3") - 1.5 * F.col("q1")).alias("_mild"), (4 * F.col("q3") - 3 * F.col("q1")).alias("_far"))

    if level is None:
        q = quantiles_n1(each, "rec_id", "e", {"_low": 0.25, "_high": 0.75})
        d = each.join(q, "rec_id")
        d = d.join(bounds(d.where("e <= _low"), "e"), "rec_id").join(quantile_n1(d.where("e >= _high"), "rec_id", "e", 0.5).withColumnRenamed("quantile", "_loud"), "rec_id")
        calm, loud = d.where("e < _mild"), d.where("e >= _loud AND e > _far")
    else:
        d = each.join(bounds(each.where("label = 'silence'"), "e"), "rec_id")
        calm, loud = d.where("label = 'silence' AND e <= _mild"), d.where("label = 'noise' OR e > _far")
        loud = loud.join(quantile_n1(loud, "rec_id", "e", level).withColumnRenamed("quantile", "_loud"), "rec_id").where("e >= _far AND e >= _loud")
    crossing = bounds(calm, "z").select("rec_id", F.col("_mild").alias("_z"))
    key = ["rec_id", "label", "_w"]
    chosen = calm.select(*key, F.lit("silence").alias("_new")).unionByName(loud.join(crossing, "rec_id").where("z >= _z").select(*key, F.lit("noise").alias("_new")))
    return apart.join(chosen, key).withColumn("label", F.col("_new")).select(*frames.columns)


def own_models(frames: DataFrame, vector: str, most: dict, seed: int, by_rows: bool = False) -> DataFrame:
    """(rec_id, label, comp, weight, mean, var, bic) of one mixture per recording and label, with the label's number of components or, by rows, one for each 4 rows a place of the vectors,
    two at least and that number at most. Of fewer frames than two a component (by rows: than places) no model is made."""
    keyed = frames.withColumn("_key", F.to_json(F.struct("rec_id", "label")))
    kind = frames.schema["rec_id"].dataType.simpleString()
    out = None
    for label, k in sorted(most.items()):
        some = keyed.where(F.col("label") == label)
        sizes = some.where(F.col(vector).isNotNull()).groupBy("_key").agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d"))
        wanted = F.least(F.lit(k), F.greatest(F.lit(2), F.round(F.col("n") / (4 * F.col("d"))))).cast("int") if by_rows else F.lit(k)
        sizes = cut(sizes.where(F.col("n") >= (F.col("d") if by_rows else 2 * k)).select("_key", wanted.alias("k")), "components")
        packed = pack(some.join(sizes, "_key", "left_semi"), "_key", vector)
        for each in [r["k"] for r in sizes.select("k").distinct().orderBy("k").collect()] or [k]:  # k different numbers at most
            fit = fit_packed(packed, sizes.where(F.col("k") == each).select(F.col("_key").alias("key"), F.col("_key").alias("src")), [each], seed)
            fit = fit.select(F.from_json("key", f"rec_id {kind}").alias("r"), F.lit(label).alias("label"), "comp", "weight", "mean", "var", "bic").select("r.rec_id", "label", "comp", "weight", "mean", "var", "bic")
            out = fit if out is None else out.unionByName(fit)
    return out


def grown(labels, i: int) -> dict:
    """Components of each class in the i-th round (from 0) in which all are fitted."""
    return {c: min(first + i * more, MOST_GROWN) for c, (first, more) in (GROWTH if "noise" in labels else GROWTH_WITHOUT_NOISE).items() if c in labels}


def vad_hmm(frames: DataFrame, bootstrap: DataFrame, vector: str = "feats", seed: int = 0, components: dict | None = None, least: dict | None = None, rounds: tuple[int, int, int] = (BACKGROUND_ROUNDS, ALL_ROUNDS, FINAL_ROUNDS), drop_noise: str = "larger", window: int = WINDOW_FRAMES) -> DataFrame:
    """(rec_id, seq, label) of frames (rec_id, seq, feats ARRAY, energy, zcr). Labels come from the bootstrap models first; then silence and noise are fitted
    again on confident windows of so many frames (the first time by thresholds of all windows, then rounds[0] times by class, without frames that the bootstrap called speech), with
    numbers of components by rows, `components` at most. Then speech is fitted on its windows, and, rounds[1] - 1 times, all classes on their own windows with `grown` numbers. Where speech
    and noise in one mixture have a larger BIC (drop_noise "larger": noise counts as speech where it is unlike it) or a smaller one ("smaller") than in two, the noise model is dropped and
    the others are fitted again, rounds[2] - 1 times. A class that a recording has too few frames for keeps its model from before; rounds don't end early where a round chooses the same
    windows, as later thresholds differ. No frames, no rows."""
    most = {**{c: k for c, k in COMPONENTS.items() if c != "speech"}, "speech": OWN_SPEECH} if components is None else components
    least = least or LEAST_FRAMES
    base = frames.select("rec_id", "seq", vector, "energy", "zcr")
    names = ["rec_id", "label", "comp", "weight", "mean", "var"]
    params = base.select("rec_id").distinct().crossJoin(F.broadcast(bootstrap.select(*names[1:])))  # a model's rows are few: MOST_NUMBERS bounds them
    now = first = cut(relabel(base, params, vector, least))
    if first.isEmpty():
        return first.select("rec_id", "seq", "label")

    def renewed(params: DataFrame, fits: DataFrame) -> DataFrame:
        return params.join(fits.select("rec_id", "label").distinct(), ["rec_id", "label"], "left_anti").unionByName(fits.select(*names))

    def windows(now: DataFrame, label: str) -> DataFrame:
        n = least.get(label, window) if isinstance(least, dict) else least
        return class_windows(now.where(F.col("label") == label), n).select(*now.columns)

    def fitted(now: DataFrame, most: dict, by_rows: bool = False) -> DataFrame:
        each = [own_models(windows(now, c), vector, {c: k}, seed, by_rows) for c, k in sorted(most.items())]
        return cut(functools.reduce(DataFrame.unionByName, each))

    background = {c: k for c, k in most.items() if c != "speech"}
    spoken = first.where("label = 'speech'").select("rec_id", "seq")
    for i in range(rounds[0] + 1):
        sure = confident_background(now, None, window) if i == 0 else confident_background(now.join(spoken, ["rec_id", "seq"], "left_anti"), max(0.7 - 0.1 * i, 0.4), window)
        params = cut(renewed(params, cut(own_models(cut(sure), vector, background, seed, by_rows=True))))
        now = cut(relabel(base, params, vector, least))
    for i in range(rounds[1]):
        fits = fitted(now, {"speech": most["speech"]}, True) if i == 0 else fitted(now, grown(most, i - 1))
        params = cut(renewed(params, fits))
        now = cut(relabel(base, params, vector, least))
    if not rounds[1] or "noise" not in most:
        return now.select("rec_id", "seq", "label")
    # both models and their union on the same frames: those that are speech or noise now
    sizes = grown(most, max(rounds[1] - 2, 0))
    apart = fitted(now, {c: sizes[c] for c in ("speech", "noise")}).where("comp = 0").groupBy("rec_id").agg(F.sum("bic").alias("apart"), F.count("*").alias("n")).where("n = 2")
    both = windows(now, "speech").unionByName(windows(now, "noise")).withColumn("label", F.lit("both"))
    joint = own_models(both, vector, {"both": sizes["speech"] + sizes["noise"]}, seed).where("comp = 0").select("rec_id", F.col("bic").alias("joint"))
    same = cut(apart.join(joint, "rec_id").where({"larger": "joint > apart", "smaller": "joint < apart"}[drop_noise]).select("rec_id"))
    done = now.join(same, "rec_id", "left_anti").select("rec_id", "seq", "label")
    if same.isEmpty():
        return done
    params = cut(params.join(same, "rec_id", "left_semi").where("label <> 'noise'"))
    redo = base.join(same, "rec_id", "left_semi")
    now = cut(relabel(redo, params, vector, least))
    for i in range(rounds[2] - 1):
        params = cut(renewed(params, fitted(now, grown([c for c in most if c != "noise"], i))))
        now = cut(relabel(redo, params, vector, least))
    return done.unionByName(now.select("rec_id", "seq", "label"))


def resegment(frames: DataFrame, g: int, least: int, seed: int = 0) -> DataFrame:
    """frames (rec_id, seq, label, v) with labels of the likeliest sequence under mixtures of g Gaussians that are fitted to each label's frames; a label that no
    stay of least frames goes to is gone."""
    kind = frames.schema["rec_id"].dataType.simpleString()
    keyed = frames.withColumn("label", F.col("label").cast("string")).withColumn("_key", F.to_json(F.struct("rec_id", "label")))
    fits = fit_gmm(keyed, "_key", "v", [g], seed).withColumn("_r", F.from_json("_key", f"rec_id {kind}, label string"))
    params = fits.select("_r.rec_id", "_r.label", "comp", "weight", "mean", "var")
    out = relabel(frames.select("rec_id", "seq", "v"), params, "v", least)
    return out.withColumn("label", F.col("label").cast(frames.schema["label"].dataType)).select(*frames.columns)


def diarise(frames: DataFrame, g: int, least: int = 250, rounds: int = 25, seed: int = 0) -> DataFrame:
    """frames (rec_id, seq, label, v) after training, assignment and merging in turn: each round fits the labels' mixtures, assigns frames anew and merges the pair of
    the least change of BIC, if not over zero. Ends when no recording merges."""
    own = frames.select("rec_id", "seq", "label", "v")
    for _ in range(rounds):
        own = cut(resegment(own, g, least, seed))
        before = own.select("rec_id", "label").distinct().count()
        own = cut(merge_round(own, g).select("rec_id", "seq", "label", "v"))
        if own.select("rec_id", "label").distinct().count() == before:
            break
    return own

