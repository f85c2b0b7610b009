"""Frames and aggregates of samples."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import at_ranks
from tidemark.operators.vectors import _few
from tidemark.operators.windows import REC, q1_of, q3_of
from tidemark.sources.scratch import cut


def with_tail(df: DataFrame, size: int, hop: int, tail: str, col: str = "x") -> DataFrame:
    """Samples (seq from 0) with rows after the end, as many as one more frame needs that the full ones leave samples for: zeros ("zero"), or the last samples
    in turned order, the last one first ("reflect"). Columns but rec_id, seq and col are null in added rows."""
    end = df.groupBy("rec_id").agg(F.count("*").alias("_n"))
    full = F.greatest(F.floor((F.col("_n") - size) / hop) + 1, F.lit(0))
    need = end.withColumn("_f", full).where((F.col("_n") > F.col("_f") * hop + size - hop) & (F.col("_n") < F.col("_f") * hop + size))
    added = need.select("rec_id", "_n", F.explode(F.sequence("_n", F.col("_f") * hop + size - 1)).alias("seq"))
    if tail == "zero":
        added = added.select("rec_id", "seq", F.lit(0).cast(df.schema[col].dataType).alias(col))
    else:
        place = F.col("seq") % (2 * F.col("_n"))
        added = added.withColumn("_from", F.when(place < F.col("_n"), place).otherwise(2 * F.col("_n") - 1 - place)).select("rec_id", "seq", "_from")
        added = added.join(df.select("rec_id", F.col("seq").alias("_from"), col), ["rec_id", "_from"]).drop("_from")
    return df.unionByName(added.withColumn("seq", F.col("seq").cast(df.schema["seq"].dataType)), allowMissingColumns=True)


def frames(df: DataFrame, size: int, hop: int, tail: str | None = None) -> DataFrame:
    """Samples (seq from 0) once for each full frame that holds them: frame, k (place in the frame). tail fills a last frame up, as with_tail does."""
    if tail:
        df = with_tail(df, size, hop, tail)
    d = df.withColumn("_n", F.count("*").over(REC())).where(F.col("_n") >= size)
    lo = F.greatest(F.ceil((F.col("seq") - size + 1) / hop), F.lit(0))
    hi = F.least(F.floor(F.col("seq") / hop), F.floor((F.col("_n") - size) / hop))
    d = d.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi").withColumn("frame", F.explode(F.sequence("_lo", "_hi")))
    return d.withColumn("k", F.col("seq") - F.col("frame") * hop).drop("_lo", "_hi", "_n")


def window_weight(kind: str, n: int, k: str = "k") -> Column:
    """Periodic Hamming or Hann weight of place k."""
    a, b = {"hamming": (0.54, 0.46), "hann": (0.5, 0.5)}[kind]
    return F.lit(a) - F.lit(b) * F.cos(F.lit(2) * F.pi() * F.col(k) / F.lit(n))


def window_weights(kind: str, n: int) -> Column:
    a, b = {"hamming": (0.54, 0.46), "hann": (0.5, 0.5)}[kind]
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.lit(a) - F.lit(b) * F.cos(F.lit(2) * F.pi() * k / F.lit(n)))


def acc_features(body: DataFrame, size: int = 25, hop: int = 13, cols: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Per frame of Hamming-weighted samples: energy, mean magnitude and standard deviation, each summed over the axes."""
    w = frames(body, size, hop).withColumns({f"_{c}": F.col(c) * window_weight("hamming", size) for c in cols})
    add = lambda f: reduce(Column.__add__, [f(f"_{c}") for c in cols])
    return w.groupBy("rec_id", "frame").agg(add(lambda c: F.sum(F.col(c) * F.col(c)) / size).alias("body_energy_ave"), add(lambda c: F.avg(F.abs(F.col(c)))).alias("body_abs_mean"), add(F.stddev_samp).alias("body_std"))


def majority_label(framed: DataFrame, size: int, frac: float = 0.7) -> DataFrame:
    """(rec_id, frame, label) of frames where one label has more than floor(frac * size) samples."""
    n = framed.groupBy("rec_id", "frame", "label").agg(F.count("*").alias("n"))
    return n.groupBy("rec_id", "frame").agg(F.max(F.struct("n", "label")).alias("m")).where(F.col("m.n") > int(frac * size)).select("rec_id", "frame", "m.label")


def hrv_time_features(rr: DataFrame, key: tuple[str, ...] = ("rec_id", "win"), order: str = "seq") -> DataFrame:
    """Of intervals in seconds: mean (ms), root mean square of differences (ms), share of differences of 50 ms or more (%), population skewness."""
    d = rr.withColumn("_d", F.col("rr") - F.lag("rr").over(Window.partitionBy(*key).orderBy(order)))
    return d.groupBy(*key).agg(
        (F.avg("rr") * 1000).alias("mean_rr"), (F.sqrt(F.avg(F.col("_d") * F.col("_d"))) * 1000).alias("rmssd"),
        (F.avg((F.abs(F.col("_d")) >= 0.05).cast("double")) * 100).alias("pnn50"), F.skewness("rr").alias("skewness"))


def band_powers(psd: DataFrame, fs: float, key: tuple[str, ...] = ("rec_id", "win"), edges: tuple[float, float, float] = (0.04, 0.15, 0.4)) -> DataFrame:
    """From (key, f, p): power of the very low, low and high bands and the whole, each the mean density times the band's width, by a million."""
    v, lo, hi = edges
    bands = {"vlf": (F.col("f") <= v, v), "lf": ((F.col("f") > v) & (F.col("f") <= lo), lo - v), "hf": ((F.col("f") > lo) & (F.col("f") <= hi), hi - lo)}
    agg = [(F.sum(F.when(c, F.col("p"))) / F.count(F.when(c, 1)) * w * 1e6).alias(n) for n, (c, w) in bands.items()]
    return psd.groupBy(*key).agg(*agg, (F.avg("p") * fs / 2 * 1e6).alias("tp")).withColumn("lf_hf", F.expr("try_divide(lf, hf)"))


def quantiles_n1(df: DataFrame, key: str, col: str, named: dict[str, float]) -> DataFrame:
    """(key, a column for each name): quantiles of rank (n + 1) p, interpolated; ranks outside 1..n are clamped. Rows are counted and picked by at_ranks, so no key's rows meet in one task."""
    n = df.where(F.col(col).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    ps = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in named.items()))
    m = F.greatest(F.least((F.col("_n") + 1) * F.col("q.p"), F.col("_n").cast("double")), F.lit(1.0))
    wanted = cut(n.withColumn("q", F.explode(ps)).select(key, "q.name", m.alias("_m"), F.floor(m).alias("_lo"), F.least(F.floor(m) + 1, F.col("_n")).alias("_hi")), "wanted-ranks")
    found = cut(at_ranks(df, wanted.select(key, F.explode(F.array("_lo", "_hi")).alias("rank")), key, col).select(key, "rank", F.col("value").cast("double").alias("value")), "found-ranks")
    both = wanted.join(found.select(key, F.col("rank").alias("_lo"), F.col("value").alias("_a")), [key, "_lo"]).join(found.select(key, F.col("rank").alias("_hi"), F.col("value").alias("_b")), [key, "_hi"])
    value = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_m") - F.col("_lo"))
    return both.groupBy(key).agg(*(F.max(F.when(F.col("name") == name, value)).alias(name) for name in named))


def quantile_n1(df: DataFrame, key: str, col: str, p: float) -> DataFrame:
    """Quantile of rank (n + 1) p, interpolated; ranks outside 1..n are clamped."""
    return quantiles_n1(df, key, col, {"quantile": p})


def quartiles_mid(df: DataFrame, key: str, col: str) -> DataFrame:
    """q1 and q3 by the midpoint rule, of groups of bounded size (windows, frames)."""
    a = df.groupBy(key).agg(F.sort_array(F.collect_list(col)).alias("a")).where("size(a) > 1")
    return a.select(key, q1_of("a").alias("q1"), q3_of("a").alias("q3"))


def energy_confidence(framed: DataFrame, key: str = "label", energy: str = "energy") -> DataFrame:
    """Frames with their class's thresholds Q3 + 1.5 IQR and Q3 + 3 IQR, and where they lie: 0 under, 1 between, 2 over."""
    t = quantiles_n1(framed, key, energy, {"q1": 0.25, "q3": 0.75})
    t = t.select(key, (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("mild"), (F.col("q3") + 3 * (F.col("q3") - F.col("q1"))).alias("extreme"))
    return framed.join(_few(t), key).withColumn("level", (F.col(energy) > F.col("mild")).cast("int") + (F.col(energy) > F.col("extreme")).cast("int"))


def confusion(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    p, y = F.col(pred), F.col(label)
    return df.agg(n((p == 1) & (y == 1)).alias("tp"), n((p == 1) & (y == 0)).alias("fp"), n((p == 0) & (y == 1)).alias("fn"), n(p == y).alias("correct"), F.count("*").alias("total"))


def prosody_summary(df: DataFrame, key: str, pitch: str = "pitch", harmonicity: str = "harmonicity", f4: str = "f4", f5: str = "f5", dispersion: str = "dispersion") -> DataFrame:
    """Per segment: median, 5 % quantile and mean of pitch, mean harmonicity, spread, 5 % quantile and mean of formants four and five, mean dispersion."""
    out = df.groupBy(key).agg(F.avg(pitch).alias("pitch_mean"), F.avg(harmonicity).alias("harmonicity_mean"), *(f(c).alias(f"{n}_{s}") for c, n in ((f4, "f4"), (f5, "f5")) for f, s in ((F.stddev_samp, "std"), (F.avg, "mean"))), F.avg(dispersion).alias("dispersion_mean"))
    for c, named in ((pitch, {"pitch_median": 0.5, "pitch_p05": 0.05}), (f4, {"f4_p05": 0.05}), (f5, {"f5_p05": 0.05})):
        out = out.join(quantiles_n1(df, key, c, named), key)
    return out


def gaussians_per_cluster(segs: DataFrame, fs: float) -> DataFrame:
    """(rec_id, label, seconds, g): g = max(3, floor(s / ((0.01 s + 2.6) K))) with K clusters in the recording."""
    s = segs.groupBy("rec_id", "label").agg((F.sum(F.col("end") - F.col("begin") + 1) / fs).alias("seconds"))
    k = F.count("*").over(REC())
    return s.withColumn("g", F.greatest(F.lit(3), F.floor(F.col("seconds") / ((0.01 * F.col("seconds") + 2.6) * k))))


def n_clusters(segs: DataFrame) -> DataFrame:
    return segs.groupBy("rec_id").agg(F.countDistinct("label").alias("k"))


def normalize_balanced(df: DataFrame, cls: str, col: str, order: str) -> DataFrame:
    """z-scores by the mean and deviation over equally long beginnings of the classes, less their mean over all rows. A class's beginning ends at the value of order whose rank is the
    smallest class's size; rows that tie there share what is left of the beginning."""
    counts = df.where(F.col(cls).isNotNull()).groupBy(cls).agg(F.count("*").alias("_m"))
    least = counts.agg(F.min("_m")).first()[0]
    ends = at_ranks(df, counts.select(cls, F.lit(least).alias("rank")), cls, order).select(cls, F.col("value").alias("_end"), ((F.lit(least) - F.col("below")) / F.col("ties")).alias("_part"))
    share = F.when(F.col(order) < F.col("_end"), 1.0).when(F.col(order) == F.col("_end"), F.col("_part")).otherwise(0.0)
    r = df.join(_few(cut(ends, "class-ends")), cls).withColumn("_w", share).where(F.col("_w") > 0)
    mean = r.agg((F.sum(F.col("_w") * F.col(col)) / F.sum("_w")).alias("_mu"))
    stats = r.join(F.broadcast(mean), F.lit(True)).agg(F.first("_mu").alias("_mu"), F.sqrt(F.sum(F.col("_w") * F.pow(F.col(col) - F.col("_mu"), 2)) / (F.sum("_w") - 1)).alias("_sd"))
    z = df.join(F.broadcast(stats), F.lit(True)).withColumn("_z", F.expr(f"try_divide({col} - _mu, _sd)"))  # one row
    mean = z.agg(F.avg("_z").alias("_mean"))
    return z.join(F.broadcast(mean), F.lit(True)).withColumn("z", F.col("_z") - F.col("_mean")).drop("_mu", "_sd", "_z", "_mean")


def hist_nd(df: DataFrame, cols: list[str], bins: list[int], lo: list[float] | None = None, hi: list[float] | None = None, prob: bool = False) -> DataFrame:
    """Counts (or probabilities) of the bins that have rows; ranges default to those of the data, slightly widened."""
    if lo is None or hi is None:
        r = df.agg(*(f(c).alias(f"{n}_{c}") for c in cols for f, n in ((F.min, "a"), (F.max, "b")))).first()
        width = [(r[f"b_{c}"] - r[f"a_{c}"]) / (n - 0.001) for c, n in zip(cols, bins, strict=True)]
        lo, hi = [r[f"a_{c}"] - 0.0005 * w for c, w in zip(cols, width, strict=True)], [r[f"b_{c}"] + 0.0005 * w for c, w in zip(cols, width, strict=True)]
    out = df
    for c, n, a, b in zip(cols, bins, lo, hi, strict=True):
        out = out.withColumn(f"bin_{c}", F.ceil((F.col(c) - a) * n / (b - a))).where(F.col(f"bin_{c}").between(1, n))
    out = out.groupBy(*(f"bin_{c}" for c in cols)).agg(F.count("*").alias("n"))
    return out.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy())) if prob else out


def bernoulli_entropy(p: Column) -> Column:
    """Entropy in bits of a variable that is true with probability p; 0 at 0 and 1."""
    part = lambda q: F.when(q > 0, -q * F.log2(q)).otherwise(0.0)
    return F.when(p.isNotNull(), part(p) + part(1 - p))


def entropy(df: DataFrame, cols: list[str], given: list[str] | None = None, by: list[str] | None = None, steps: list[float] | None = None) -> DataFrame:
    """Entropy in bits of the joint counts of cols, or the conditional one given others; one for each value of by, if given. With steps, the widths of the bins that
    cols count, the differential entropy of what they cut up."""
    by = by or []

    def h(keys: list[str], name: str) -> DataFrame:
        n = df.groupBy(*by, *keys).agg(F.count("*").alias("n"))
        return n.groupBy(*by).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s")).select(*by, (F.log2("t") - F.col("s") / F.col("t")).alias(name))

    out = h([*cols, *(given or [])], "entropy")
    if given:
        base = h(given, "_g")
        out = (out.join(base, by) if by else out.join(F.broadcast(base), F.lit(True))).withColumn("entropy", F.col("entropy") - F.col("_g")).drop("_g")
    return out.withColumn("entropy", F.col("entropy") + sum(math.log2(s) for s in steps)) if steps else out


def log_sum_exp(df: DataFrame, key: str, x: str, k: str | None = None) -> DataFrame:
    top = df.groupBy(key).agg(F.max(x).alias("_top"))
    w = F.col(k) if k else F.lit(1.0)
    return df.join(top, key).groupBy(key).agg((F.first("_top") + F.log(F.sum(w * F.exp(F.col(x) - F.col("_top"))))).alias("lse"))


def moments(df: DataFrame, key: str, col: str) -> DataFrame:
    """Mean, and second to fourth central moments and cumulants, from raw sums."""
    r = df.groupBy(key).agg(*(F.avg(F.pow(F.col(col).cast("double"), i)).alias(f"r{i}") for i in range(1, 5)))
    c2, c3 = "(r2 - r1 * r1)", "(r3 - 3 * r1 * r2 + 2 * r1 * r1 * r1)"
    c4 = "(r4 - 4 * r1 * r3 + 6 * r1 * r1 * r2 - 3 * r1 * r1 * r1 * r1)"
    return r.selectExpr(key, "r1 AS mean", f"{c2} AS c2", f"{c3} AS c3", f"{c4} AS c4", f"{c4} - 3 * {c2} * {c2} AS k4")


def snr_seg(sig: DataFrame, ref: DataFrame, size: int, limit: float = 100.0, active: DataFrame | None = None, shifted: bool = False) -> DataFrame:
    """(rec_id, seg_snr, glo_snr): mean over frames, each clipped, and overall, in dB. Of active samples (rec_id, seq), if given, a frame must hold more than half
    its size. If shifted, each frame's signal is moved by up to one sample, to the side and as far as leaves the least error; frames then begin at sample 1."""
    both = sig.select("rec_id", "seq", "x").join(ref.select("rec_id", "seq", F.col("x").alias("r")), ["rec_id", "seq"])
    if active is not None:
        both = both.join(active.select("rec_id", "seq").distinct().withColumn("_on", F.lit(1)), ["rec_id", "seq"], "left")
    else:
        both = both.withColumn("_on", F.lit(1))
    parts = [F.sum(F.col("r") * F.col("r")).alias("s"), F.sum(F.pow(F.col("x") - F.col("r"), 2)).alias("e"), F.count("*").alias("n"), F.count("_on").alias("on")]
    if shifted:
        w = Window.partitionBy("rec_id").orderBy("seq")
        both = both.withColumns({"_a": F.col("x") - F.lead("x").over(w), "_b": F.col("x") - F.lag("x").over(w)}).where("_a IS NOT NULL AND _b IS NOT NULL")
        parts += [F.sum((F.col("x") - F.col("r")) * F.col(c)).alias(f"d{c}") for c in ("_a", "_b")] + [F.sum(F.col(c) * F.col(c)).alias(f"q{c}") for c in ("_a", "_b")]
    f = both.groupBy("rec_id", F.floor((F.col("seq") - int(shifted)) / size).alias("frame")).agg(*parts)
    f = f.where((F.col("n") == size) & (F.col("on") > (size / 2)))
    if shifted:
        for c in ("_a", "_b"):  # how far to move, and the error's fall
            f = f.withColumn("m", F.least(F.greatest(F.coalesce(F.try_divide(f"d{c}", f"q{c}"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
            f = f.withColumn(f"f{c}", F.col("m") * (2 * F.col(f"d{c}") - F.col("m") * F.col(f"q{c}")))
        f = f.withColumn("e", F.greatest(F.col("e") - F.greatest("f_a", "f_b"), F.lit(0.0)))
    db = F.when(F.col("s") == 0, -limit).when(F.col("e") == 0, limit).otherwise(F.greatest(F.least(10 * F.log10(F.col("s") / F.col("e")), F.lit(limit)), F.lit(-limit)))
    return f.groupBy("rec_id").agg(F.avg(db).alias("seg_snr"), (10 * F.log10(F.expr("try_divide(sum(s), sum(e))"))).alias("glo_snr"))


def overlap_add(framed: DataFrame, hop: int, v: str = "v") -> DataFrame:
    """Sums the samples (frame, k, v) of overlapping frames back to one signal."""
    return framed.groupBy("rec_id", (F.col("frame") * hop + F.col("k")).alias("seq")).agg(F.sum(v).alias("x"))


def zcr(framed: DataFrame, col: str = "x") -> DataFrame:
    """Share of neighbours in a frame whose signs differ."""
    w = Window.partitionBy("rec_id", "frame").orderBy("k")
    d = framed.withColumn("_c", (F.signum(col) != F.signum(F.lag(col).over(w))).cast("int"))
    return d.groupBy("rec_id", "frame").agg(F.avg("_c").alias("zcr"))


def frame_energy(framed: DataFrame, col: str = "x") -> DataFrame:
    return framed.groupBy("rec_id", "frame").agg(F.sum(F.col(col) * F.col(col)).alias("energy"))


def peak_normalize(df: DataFrame, key: str = "rec_id", x: str = "x") -> DataFrame:
    """Samples over their key's largest magnitude; a key without any magnitude stays as it is."""
    peak = df.groupBy(key).agg(F.max(F.abs(x)).alias("_peak"))
    return df.join(peak, key).withColumn(x, F.when(F.col("_peak") > 0, F.col(x) / F.col("_peak")).otherwise(F.col(x))).drop("_peak")


def add_noise(df: DataFrame, snr_db: float, seed: int = 0, key: str = "rec_id", x: str = "x") -> DataFrame:
    """Samples with white normal noise at snr_db below their key's mean power. The noise follows from (seed, key, seq), so a repeated task gives the same, but for the last bits of the mean power."""
    power = df.groupBy(key).agg(F.avg(F.col(x) * F.col(x)).alias("_power"))

    def uniform(k: int) -> Column:
        return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), key, "seq"), 11) + 0.5) / float(1 << 53)

    normal = F.sqrt(-2 * F.log(uniform(0))) * F.cos(2 * math.pi * uniform(1))
    return df.join(power, key).withColumn(x, F.col(x) + F.sqrt(F.col("_power") / 10 ** (snr_db / 10)) * normal).drop("_power")
