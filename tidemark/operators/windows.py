"""Window operators over samples (rec_id, seq, x), one row per sample. All share one partitioning by rec_id."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import cut

#: Rounds in which near peaks are thinned before rows move again.
AT_ONCE = 16


def REC():  # noqa: N802  a window needs a session, so it is made on use
    return Window.partitionBy("rec_id")


def SEQ():  # noqa: N802
    return Window.partitionBy("rec_id").orderBy("seq")


def around(k: int):
    """The frame of a centred window of k rows: k // 2 before, (k - 1) // 2 after."""
    return SEQ().rowsBetween(-(k // 2), (k - 1) // 2)


def rr_intervals(peaks: DataFrame, t: str = "t") -> DataFrame:
    """Differences to the next event; the last event has none."""
    return peaks.withColumn("rr", F.lead(t).over(SEQ()) - F.col(t)).where("rr IS NOT NULL")


def beat_time(rr: DataFrame, start_zero: bool = False) -> DataFrame:
    """Running sum of intervals, from the first interval or from zero."""
    total = F.sum("rr").over(SEQ().rowsBetween(Window.unboundedPreceding, 0))
    return rr.withColumn("t", total - F.first("rr").over(SEQ()) if start_zero else total)


def moving_mean(df: DataFrame, k: int, col: str = "x", out: str = "mean") -> DataFrame:
    return df.withColumn(out, F.avg(col).over(around(k)))


def split_gravity(df: DataFrame, k: int, cols: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Gravity (moving mean) and body movement (the rest) of each axis."""
    df = df.withColumns({f"gravity_{c}": F.avg(c).over(around(k)) for c in cols})
    return df.withColumns({f"body_{c}": F.col(c) - F.col(f"gravity_{c}") for c in cols})


def median3(df: DataFrame, col: str = "x", out: str = "median") -> DataFrame:
    """Median of a sample and its neighbours; zeros beyond the ends."""
    a, b, c = F.lag(col, 1, 0.0).over(SEQ()), F.col(col), F.lead(col, 1, 0.0).over(SEQ())
    return df.withColumn(out, F.greatest(F.least(a, b), F.least(F.greatest(a, b), c)))


def q1_of(a: str) -> Column:
    """First quartile by the midpoint rule, of a sorted array column or expression."""
    p = f"((size({a}) + 1) div 4)"
    return F.expr(f"CASE WHEN {p} = 0 THEN {a}[0] WHEN (size({a}) + 1) % 4 = 0 THEN {a}[{p} - 1] ELSE ({a}[{p} - 1] + {a}[{p}]) / 2 END")


def q3_of(a: str) -> Column:
    p = f"(3 * (size({a}) + 1) div 4)"
    return F.expr(f"CASE WHEN 3 * (size({a}) + 1) % 4 = 0 THEN {a}[{p} - 1] WHEN {p} >= size({a}) THEN {a}[1] ELSE ({a}[{p} - 1] + {a}[{p}]) / 2 END")


def outlier_flags(df: DataFrame, width: int, k: float = 3.0, col: str = "x") -> DataFrame:
    """Whether a sample lies k interquartile ranges outside the quartiles of its window, which shrinks symmetrically at the ends."""
    j, n = "_j", "_n"
    near = f"(CASE WHEN {j} = 1 THEN 1 WHEN {j} < {(width + 1) / 2} THEN 1 WHEN {j} = {n} THEN {n} - 1 WHEN {j} > {n} - {(width + 1) / 2} + 1 THEN {j} - ({n} - {j}) ELSE {j} - {(width - 1) // 2} END)"
    far = f"(CASE WHEN {j} = 1 THEN 2 WHEN {j} < {(width + 1) / 2} THEN 2 * {j} - 1 WHEN {j} = {n} THEN {n} WHEN {j} > {n} - {(width + 1) / 2} + 1 THEN {n} ELSE {j} + {-(-(width - 1) // 2)} END)"
    half = -(-width // 2)
    df = df.withColumns({j: F.row_number().over(SEQ()), n: F.count("*").over(REC()), "_a": F.collect_list(col).over(SEQ().rowsBetween(-half, half))})
    df = df.withColumn("_w", F.expr(f"sort_array(slice(_a, cast(greatest({near}, 1) - greatest({j} - {half}, 1) + 1 AS int), cast(least({far}, {n}) - greatest({near}, 1) + 1 AS int)))"))
    df = df.withColumns({"_q1": q1_of("_w"), "_q3": q3_of("_w")})
    out = (F.col(col) < F.col("_q1") - k * (F.col("_q3") - F.col("_q1"))) | (F.col(col) > F.col("_q3") + k * (F.col("_q3") - F.col("_q1")))
    return df.withColumn("outlier", F.when(F.col(n) >= 2, out).otherwise(F.lit(False))).drop(j, n, "_a", "_w", "_q1", "_q3")


def label_runs(df: DataFrame, label: str = "label") -> DataFrame:
    """(rec_id, run, label, begin, end, n): stretches of one label."""
    change = (~F.col(label).eqNullSafe(F.lag(label).over(SEQ())) | (F.row_number().over(SEQ()) == 1)).cast("int")
    run = df.withColumn("_c", change).withColumn("run", F.sum("_c").over(SEQ().rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("rec_id", "run").agg(F.first(label).alias("label"), F.min("seq").alias("begin"), F.max("seq").alias("end"), F.count("*").alias("n"))


def zero_crossings(df: DataFrame, mode: str = "b", col: str = "x") -> DataFrame:
    """(rec_id, seq, at, slope): where the line through neighbours crosses zero; mode p: rising, n: falling, b: both."""
    nxt = F.lead(col).over(SEQ())
    up, down = (F.col(col) < 0) & (F.col("_next") >= 0), (F.col(col) >= 0) & (F.col("_next") < 0)
    kept = df.withColumn("_next", nxt).where({"p": up, "n": down, "b": up | down}[mode])
    return kept.select("rec_id", "seq", (F.col("seq") - F.col(col) / (F.col("_next") - F.col(col))).alias("at"), (F.col("_next") - F.col(col)).alias("slope"))


def find_peaks(df: DataFrame, valleys: bool = False, col: str = "x", width: float = 0.0) -> DataFrame:
    """(rec_id, at, height): local maxima; a plateau counts once, at its middle; a single peak is placed by a parabola through its neighbours. With a width,
    of two neighbouring peaks that lie no further apart the lower one (of equal ones the second) goes, until none lie so near."""
    s = -1 if valleys else 1
    runs = label_runs(df.select("rec_id", "seq", (F.col(col) * s).alias("label")))
    w = Window.partitionBy("rec_id").orderBy("run")
    runs = runs.withColumns({"p": F.lag("label").over(w), "q": F.lead("label").over(w)}).where("p < label AND q < label")
    shift = F.when(F.col("n") == 1, (F.col("q") - F.col("p")) / (2 * (2 * F.col("label") - F.col("p") - F.col("q")))).otherwise(0.0)
    rise = F.when(F.col("n") == 1, (F.col("q") - F.col("p")) * shift / 4).otherwise(0.0)
    peaks = runs.select("rec_id", ((F.col("begin") + F.col("end")) / 2 + shift).alias("at"), ((F.col("label") + rise) * s).alias("height"))
    return peaks if width <= 0 else apart_peaks(peaks, width, s)


def apart_peaks(peaks: DataFrame, width: float, sign: int = 1, stretch: float | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """Peaks (rec_id, at, height) thinned by width, in rounds: in each, of every two neighbours no further apart the lower goes. Whether a peak is left after a round depends on its
    neighbours within width, so a stretch of a recording, with one width more than at_once on both sides, has the same peaks after so many rounds as the whole, and tells whether one of its own
    still has a near neighbour. A round leaves at most every other peak of a dense row, so one pass nearly always suffices; where a near pair is left there is another."""
    stretch = stretch or max(float(1 << 16), 64 * width)
    reach = (at_once + 1) * width
    kind = peaks.schema["rec_id"].dataType.simpleString()
    names = peaks.select("rec_id", "at", "height").schema
    schema = f"rec_id {kind}, at {names['at'].dataType.simpleString()}, height {names['height'].dataType.simpleString()}, more boolean"

    def thin(pdf):
        pdf = pdf.sort_values("at")
        for _ in range(at_once):
            at, h = pdf["at"].to_numpy(), pdf["height"].to_numpy() * sign
            near = np.flatnonzero(np.diff(at) <= width)
            if not len(near):
                break
            pdf = pdf.drop(pdf.index[np.where(h[near] >= h[near + 1], near + 1, near)])
        gap = np.diff(pdf["at"].to_numpy()) <= width
        more = np.concatenate([[False], gap]) | np.concatenate([gap, [False]])
        return pdf.assign(more=more[: len(pdf)])[pdf["_own"]][["rec_id", "at", "height", "more"]]

    left = peaks.select("rec_id", "at", "height")
    while True:
        places = F.sequence(F.floor((F.col("at") - reach) / stretch), F.floor((F.col("at") + reach) / stretch))
        spread = left.withColumn("_place", F.explode(places)).withColumn("_own", F.col("_place") == F.floor(F.col("at") / stretch))
        done = cut(spread.groupBy("rec_id", "_place").applyInPandas(thin, schema), "peaks")
        left = done.drop("more")
        if done.where("more").isEmpty():
            return left


def moving_moments(df: DataFrame, r: int, k: int, col: str = "x", weights: list[float] | None = None, central: bool = False) -> DataFrame:
    """Moments 1..r over the last k samples; weights (k of them, the last for the newest sample) if given, and from the second on about the mean if central.
    A recording's first samples have those weights that meet samples; nulls are left out with theirs."""
    w = SEQ().rowsBetween(-(k - 1), 0)
    if weights or central:
        weights = weights or [1.0] * k
        near = df.withColumn("_a", F.collect_list(F.struct(F.col(col).cast("double").alias("x"))).over(w))
        wa = F.slice(F.array(*(F.lit(float(v)) for v in weights)), F.lit(k + 1) - F.size("_a"), F.size("_a"))
        near = near.withColumn("_w", F.filter(F.zip_with("_a", wa, lambda s, v: F.struct(s["x"].alias("x"), v.alias("w"))), lambda s: s["x"].isNotNull()))
        total = lambda f: F.try_divide(F.aggregate(F.transform("_w", f), F.lit(0.0), lambda s, v: s + v), F.aggregate("_w", F.lit(0.0), lambda s, v: s + v["w"]))
        near = near.withColumn("m1", total(lambda s: s["w"] * s["x"]))
        about = F.col("m1") if central else F.lit(0.0)

        def power(i: int):  # a second parameter would be the place in the array
            return lambda s: s["w"] * F.pow(s["x"] - about, i)

        return near.withColumns({f"m{i}": total(power(i)) for i in range(2, r + 1)}).drop("_a", "_w")
    return df.withColumns({f"m{i}": F.avg(F.pow(F.col(col), i)).over(w) for i in range(1, r + 1)})


def moving_max(df: DataFrame, n: int | None = None, forget: float = 1.0, col: str = "x") -> DataFrame:
    """Running maximum over the last n samples (all, if None) of a positive series, older ones scaled by forget per sample."""
    w = SEQ().rowsBetween(Window.unboundedPreceding if n is None else -(n - 1), 0)
    if forget == 1.0:
        return df.withColumn("running_max", F.max(col).over(w))
    log = F.max(F.log(col) - F.col("seq") * F.log(F.lit(forget))).over(w) + F.col("seq") * F.log(F.lit(forget))
    return df.withColumn("running_max", F.exp(log))


def teager(df: DataFrame, col: str = "x") -> DataFrame:
    """x squared less the product of the neighbours; ends extrapolated along a line."""
    inner = df.withColumns({"_e": F.pow(F.col(col), 2) - F.lag(col).over(SEQ()) * F.lead(col).over(SEQ()), "_n": F.count("*").over(REC()), "_j": F.row_number().over(SEQ())})
    first, last = 2 * F.lead("_e", 1).over(SEQ()) - F.lead("_e", 2).over(SEQ()), 2 * F.lag("_e", 1).over(SEQ()) - F.lag("_e", 2).over(SEQ())
    return inner.withColumn("teager", F.when(F.col("_j") == 1, first).when(F.col("_j") == F.col("_n"), last).otherwise(F.col("_e"))).drop("_e", "_n", "_j")


def schmitt(df: DataFrame, low: float, high: float, col: str = "x", min_width: int = 0) -> DataFrame:
    """State 1 above high, -1 below low, else as before; 0 until either. Pulses that the next change ends before min_width samples are left out."""
    so_far = SEQ().rowsBetween(Window.unboundedPreceding, 0)
    state = F.last(F.when(F.col(col) > high, 1).when(F.col(col) < low, -1), ignorenulls=True).over(so_far)
    d = df.withColumn("state", F.coalesce(state, F.lit(0)))
    if min_width < 2:
        return d
    d = d.withColumn("_at", F.when((F.col("state") != 0) & (F.col("state") != F.lag("state", 1, 0).over(SEQ())), F.col("seq")))
    d = d.withColumn("_next", F.first("_at", ignorenulls=True).over(SEQ().rowsBetween(1, Window.unboundedFollowing)))
    long = F.col("_at").isNotNull() & (F.col("_next").isNull() | (F.col("_next") - F.col("_at") >= min_width))
    return d.withColumn("state", F.coalesce(F.last(F.when(long, F.col("state")), ignorenulls=True).over(so_far), F.lit(0))).drop("_at", "_next")


def deltas(df: DataFrame, col: str = "x") -> DataFrame:
    """Slopes over nine samples and, of those, over three; ends repeated."""

    def at(c: str, k: int) -> Column:
        first, last = F.first(c).over(SEQ().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(c).over(SEQ().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return F.coalesce(F.lead(c, k).over(SEQ()), last) if k > 0 else F.coalesce(F.lag(c, -k).over(SEQ()), first)

    d = df.withColumn("delta", sum((at(col, k) - at(col, -k)) * k for k in range(1, 5)) / 60)
    return d.withColumn("delta2", (at("delta", 1) - at("delta", -1)) / 2)


def nearest_nonzero(df: DataFrame, col: str = "x") -> DataFrame:
    """The closest value other than zero and how far it is; of equally far ones the later."""
    own = F.when(F.col(col) != 0, F.struct("seq", F.col(col).alias("v")))
    d = df.withColumns({"_b": F.last(own, True).over(SEQ().rowsBetween(Window.unboundedPreceding, 0)), "_a": F.first(own, True).over(SEQ().rowsBetween(0, Window.unboundedFollowing))})
    later = F.col("_b").isNull() | (F.col("_a.seq") - F.col("seq") <= F.col("seq") - F.col("_b.seq"))
    best = F.when(F.col("_a").isNotNull() & later, F.col("_a")).otherwise(F.col("_b"))
    return d.withColumn("_x", best).withColumns({"nearest": F.col("_x.v"), "offset": F.col("_x.seq") - F.col("seq")}).drop("_a", "_b", "_x")


def signed_power(df: DataFrame, p: float, col: str = "x") -> DataFrame:
    return df.withColumn("powered", F.signum(col) * F.pow(F.abs(F.col(col)), p))


def trim_edges(df: DataFrame, n: int) -> DataFrame:
    """Without the first and last n samples of each recording."""
    d = df.withColumns({"_j": F.row_number().over(SEQ()), "_n": F.count("*").over(REC())})
    return d.where((F.col("_j") > n) & (F.col("_j") <= F.col("_n") - n)).drop("_j", "_n")


def amplitude_gate(peaks: DataFrame, samples: DataFrame, col: str = "x") -> DataFrame:
    """Peaks whose height is not below the root mean square of their recording."""
    rms = samples.groupBy("rec_id").agg(F.sqrt(F.avg(F.col(col) * F.col(col))).alias("_rms"))
    return peaks.join(rms, "rec_id").where(F.abs(F.col("height")) >= F.col("_rms")).drop("_rms")


def track_regions(tracks: DataFrame, length: str = "length", order: str = "turn") -> DataFrame:
    """begin and end of pieces laid end to end, counted from 1."""
    total = F.sum(length).over(REC().orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return tracks.withColumns({"begin": total - F.col(length) + 1, "end": total})


def stitch_chunks(segs: DataFrame, chunk_len: int) -> DataFrame:
    """Segments of chunks on the recording's time, cluster ids shifted by the clusters of earlier chunks."""
    per = segs.groupBy("rec_id", "chunk").agg(F.countDistinct("label").alias("_k"))
    before = F.coalesce(F.sum("_k").over(REC().orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return segs.join(per.withColumn("_before", before).drop("_k"), ["rec_id", "chunk"]).withColumns({
        "begin": F.col("begin") + F.col("chunk") * chunk_len, "end": F.col("end") + F.col("chunk") * chunk_len, "label": F.col("label") + F.col("_before")}).drop("_before")


def ema(df: DataFrame, lam: float, col: str = "x", size: int | None = None) -> DataFrame:
    """(rec_id, seq, ema): y = lam y(-1) + (1 - lam) x, from zero, over recordings of any length."""
    from tidemark.operators import chunks  # its Spark jobs need nothing of this module

    return chunks.linear_scan(df, chunks.Linear([[lam]], [1 - lam], [1.0]), col, "ema", size or chunks.CHUNK)
