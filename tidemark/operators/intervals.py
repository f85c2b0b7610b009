"""Interval operators on segments (rec_id, begin, end, label), both ends inclusive. Range joins go through equal keys:
(rec_id, bucket of time), intervals entering all buckets that they touch; a pair met in several buckets counts in the
bucket of the later begin only, so nothing has to be made distinct afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 1 << 16


def _buckets(df: DataFrame, width: int) -> DataFrame:
    return df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("begin") / width), F.floor(F.col("end") / width))))


def label_points(samples: DataFrame, intervals: DataFrame, at: str = "seq", width: int = BUCKET, how: str = "inner") -> DataFrame:
    """Samples with the label of the interval that holds them; of several, the one with the largest row."""
    own = _buckets(intervals.select("rec_id", "begin", "end", F.col("label").alias("_label"), F.col("row").alias("_row")), width).alias("i")
    s = samples.withColumn("_bucket", F.floor(F.col(at) / width)).alias("s")
    cond = (F.col("s.rec_id") == F.col("i.rec_id")) & (F.col("s._bucket") == F.col("i._bucket")) & F.col(f"s.{at}").between(F.col("i.begin"), F.col("i.end"))
    hit = s.join(own, cond).groupBy("s.rec_id", f"s.{at}").agg(F.max(F.struct("_row", "_label")).alias("_m")).select("rec_id", at, F.col("_m._label").alias("label"))
    return hit if how == "inner" else samples.join(hit, ["rec_id", at], "left")


def overlap_join(a: DataFrame, b: DataFrame, width: int = BUCKET) -> DataFrame:
    """Pairs of segments that overlap: (rec_id, a_begin, a_end, a_label, b_begin, b_end, b_label, begin, end), the last two of the intersection."""
    x = _buckets(a.select("rec_id", "begin", "end", "label"), width).alias("x")
    y = _buckets(b.select("rec_id", "begin", "end", "label"), width).alias("y")
    begin = F.greatest(F.col("x.begin"), F.col("y.begin"))
    cond = (F.col("x.rec_id") == F.col("y.rec_id")) & (F.col("x._bucket") == F.col("y._bucket")) & (F.col("x.begin") <= F.col("y.end")) & (F.col("y.begin") <= F.col("x.end")) & (F.col("x._bucket") == F.floor(begin / width))
    names = [F.col(f"{t}.{c}").alias(f"{n}_{c}") for t, n in (("x", "a"), ("y", "b")) for c in ("begin", "end", "label")]
    return x.join(y, cond).select(F.col("x.rec_id").alias("rec_id"), *names, begin.alias("begin"), F.least(F.col("x.end"), F.col("y.end")).alias("end"))


def contain_join(inner: DataFrame, outer: DataFrame, width: int = BUCKET) -> DataFrame:
    """inner with the label of an outer segment that contains it (the least label of several), else 0."""
    pairs = overlap_join(inner, outer, width).where("b_begin <= a_begin AND b_end >= a_end")
    hit = pairs.groupBy("rec_id", F.col("a_begin").alias("begin"), F.col("a_end").alias("end")).agg(F.min("b_label").alias("outer_label"))
    return inner.join(hit, ["rec_id", "begin", "end"], "left").withColumn("outer_label", F.coalesce("outer_label", F.lit(0)))


def _hits(truth: DataFrame, guess: DataFrame, width: int) -> DataFrame:
    return overlap_join(truth, guess, width).select("rec_id", F.col("a_begin").alias("begin"), F.col("a_end").alias("end")).distinct()


def hit_segments(truth: DataFrame, guess: DataFrame, width: int = BUCKET) -> DataFrame:
    return truth.join(_hits(truth, guess, width), ["rec_id", "begin", "end"], "left_semi")


def missed_segments(truth: DataFrame, guess: DataFrame, width: int = BUCKET) -> DataFrame:
    return truth.join(_hits(truth, guess, width), ["rec_id", "begin", "end"], "left_anti")


def coalesce_intervals(segs: DataFrame, gap: int) -> DataFrame:
    """(rec_id, begin, end): segments with less than gap between them become one."""
    w = Window.partitionBy("rec_id").orderBy("begin", "end")
    top = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(top.isNull() | (F.col("begin") - top > gap), 1).otherwise(0)
    island = segs.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("rec_id", "_island").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("_island")


def subtract_intervals(a: DataFrame, b: DataFrame, width: int = BUCKET) -> DataFrame:
    """(rec_id, begin, end, label): what is left of a's segments outside b's."""
    cover = coalesce_intervals(b, 1).withColumn("label", F.lit(0))
    cuts = overlap_join(a, cover, width).select("rec_id", F.col("a_begin").alias("begin"), F.col("a_end").alias("end"), F.col("a_label").alias("label"), F.struct(F.col("begin").alias("cb"), F.col("end").alias("ce")).alias("cut"))
    each = cuts.groupBy("rec_id", "begin", "end", "label").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    left = a.select("rec_id", "begin", "end", "label").join(each, ["rec_id", "begin", "end", "label"], "left")
    edges = "transform(sequence(0, size(cuts)), i -> named_struct('begin', if(i = 0, begin, cuts[i - 1].ce + 1), 'end', if(i = size(cuts), end, cuts[i].cb - 1)))"
    parts = F.expr(f"CASE WHEN cuts IS NULL THEN array(named_struct('begin', begin, 'end', end)) ELSE filter({edges}, p -> p.begin <= p.end) END")
    return left.select("rec_id", "label", F.explode(parts).alias("p")).select("rec_id", "p.begin", "p.end", "label")


def diarization_error(truth: DataFrame, guess: DataFrame, tol: int, least: int, width: int = BUCKET) -> DataFrame:
    """One row of miss, fa, se and der, as percentages of the truth's length. tol and least are in samples."""

    def missed(a: DataFrame, b: DataFrame) -> DataFrame:
        """Per segment of a: what b leaves uncovered beyond the tolerance, and whether nothing overlaps."""
        w = Window.partitionBy("rec_id", "a_begin", "a_end").orderBy("begin", "end")
        cut = overlap_join(a, b, width).withColumn("gap", F.greatest(F.col("begin") - F.coalesce(F.lag("end").over(w), F.col("a_begin") - 1) - 1 - tol, F.lit(0)))
        per = cut.groupBy("rec_id", "a_begin", "a_end").agg(F.sum("gap").alias("gaps"), F.greatest(F.max("a_end") - F.max("end") - tol, F.lit(0)).alias("tail"))
        own = a.select("rec_id", "begin", "end").join(per, (a["rec_id"] == per["rec_id"]) & (F.col("begin") == F.col("a_begin")) & (F.col("end") == F.col("a_end")), "left")
        size = F.col("end") - F.col("begin") + 1
        alone = F.col("gaps").isNull()
        return own.agg(
            F.sum(F.when(alone & (size >= least), F.greatest(size - tol, F.lit(0))).when(~alone, F.col("gaps") + F.col("tail")).otherwise(0)).alias("open"),
            F.sum(F.when(alone & (size < least), F.greatest(size - tol, F.lit(0))).otherwise(0)).alias("short"), F.sum(size).alias("total"))

    miss, false = missed(truth, guess), missed(guess, truth).select(F.col("open").alias("fa_open"), F.col("short").alias("fa_short"))
    wrong = overlap_join(truth, guess, width).where("a_label != b_label").agg(F.coalesce(F.sum(F.col("a_end") - F.col("a_begin") + 1), F.lit(0)).alias("wrong"))
    one = miss.join(F.broadcast(false), F.lit(True)).join(F.broadcast(wrong), F.lit(True))  # one row each
    pct = lambda c: F.expr(f"try_divide(100D * ({c}), total)")
    one = one.select(pct("open").alias("miss"), pct("fa_open").alias("fa"), pct("short + wrong").alias("se"))
    return one.withColumn("der", F.col("miss") + F.col("fa") + F.col("se"))


def speak_stats(segs: DataFrame, fs: float = 1.0) -> DataFrame:
    """Per speaker: turns (runs of own segments), total duration, longest phrase (segment) and longest turn."""
    w = Window.partitionBy("rec_id").orderBy("begin", "end")
    run = segs.withColumn("_new", F.coalesce((F.col("label") != F.lag("label").over(w)).cast("int"), F.lit(1))).withColumn("_turn", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = (F.col("end") - F.col("begin") + 1) / fs
    turns = run.groupBy("rec_id", "label", "_turn").agg(F.sum(size).alias("d"), F.max(size).alias("p"))
    return turns.groupBy("rec_id", "label").agg(F.count("*").alias("turns"), F.sum("d").alias("total"), F.max("p").alias("longest_phrase"), F.max("d").alias("longest_turn"))


def assign_windows(events: DataFrame, size: float, step: float, t: str = "t") -> DataFrame:
    """Events with the sliding windows that hold them: k steps from zero, while a window ends before the last event. An event belongs
    to window k when its time, rounded up, is past the begin and, rounded down, not past the end."""
    last = F.max(t).over(Window.partitionBy("rec_id"))
    lo = F.greatest(F.ceil((F.floor(t) - size) / step), F.lit(0))
    hi = F.least(F.ceil(F.ceil(t) / step) - 1, F.ceil((F.col("_last") - size) / step) - 1)
    d = events.withColumn("_last", last).withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi")
    return d.withColumn("win", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi", "_last")


def peak_in_interval(samples: DataFrame, bounds: DataFrame, width: int = BUCKET) -> DataFrame:
    """(rec_id, begin, end, at, height): the sample of the largest magnitude in each interval, the first of equal ones."""
    own = _buckets(bounds.select("rec_id", "begin", "end"), width).alias("i")
    s = samples.withColumn("_bucket", F.floor(F.col("seq") / width)).alias("s")
    cond = (F.col("s.rec_id") == F.col("i.rec_id")) & (F.col("s._bucket") == F.col("i._bucket")) & F.col("s.seq").between(F.col("i.begin"), F.col("i.end"))
    m = s.join(own, cond).groupBy("i.rec_id", "begin", "end").agg(F.max(F.struct(F.abs("x").alias("m"), (-F.col("seq")).alias("k"), "x")).alias("m"))
    return m.select("rec_id", "begin", "end", (-F.col("m.k")).alias("at"), F.col("m.x").alias("height"))


def best_lag(sig: DataFrame, ref: DataFrame, lo: int, hi: int, mode: str = "correlation") -> DataFrame:
    """(rec_id, lag, gain): the lag with the largest correlation coefficient of the signal with the shifted reference (mode "correlation"), or with the
    largest product of the two whatever its sign, the most energy in common (mode "energy"), and sum(rs) / sum(rr); of equal lags the least."""
    shifted = ref.select("rec_id", "seq", F.col("x").alias("r")).withColumn("lag", F.explode(F.sequence(F.lit(lo), F.lit(hi)))).withColumn("seq", F.col("seq") + F.col("lag"))
    sums = sig.join(shifted, ["rec_id", "seq"]).groupBy("rec_id", "lag").agg(F.sum(F.col("x") * F.col("r")).alias("rs"), F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    scored = sums.withColumn("c", F.expr({"correlation": "try_divide(rs, sqrt(rr * ss))", "energy": "abs(rs)"}[mode]))
    return scored.groupBy("rec_id").agg(F.max(F.struct("c", (-F.col("lag")).alias("k"), "rs", "rr")).alias("m")).select("rec_id", (-F.col("m.k")).alias("lag"), F.expr("try_divide(m.rs, m.rr)").alias("gain"))


def cut_segments(chunks: DataFrame, segs: DataFrame, chunk_len: int) -> DataFrame:
    """(rec_id, label, begin, part, pcm): the audio of segments (from 0, inclusive), one row per chunk that a segment touches."""
    s = segs.withColumn("chunk_id", F.explode(F.sequence(F.floor(F.col("begin") / chunk_len), F.floor(F.col("end") / chunk_len))))
    lo = F.greatest(F.col("begin") - F.col("chunk_id") * chunk_len, F.lit(0))
    hi = F.least(F.col("end") - F.col("chunk_id") * chunk_len, F.lit(chunk_len - 1))
    return s.join(chunks.select("rec_id", "chunk_id", "pcm"), ["rec_id", "chunk_id"]).select("rec_id", "label", "begin", F.col("chunk_id").alias("part"), F.slice("pcm", (lo + 1).cast("int"), (hi - lo + 1).cast("int")).alias("pcm"))


def regrid_decisions(decisions: DataFrame, grid: DataFrame, width: int = BUCKET) -> DataFrame:
    """grid segments with flag = 1 where more than half of their length lies under active (label 1) decision segments."""
    over = overlap_join(grid.withColumn("label", F.lit(0)), decisions.where("label = 1"), width)
    hit = over.groupBy("rec_id", F.col("a_begin").alias("begin"), F.col("a_end").alias("end")).agg(F.sum(F.col("end") - F.col("begin") + 1).alias("_n"))
    out = grid.join(hit.select("rec_id", "begin", "end", "_n"), ["rec_id", "begin", "end"], "left")
    return out.withColumn("flag", (F.coalesce("_n", F.lit(0)) * 2 > F.col("end") - F.col("begin") + 1).cast("int")).drop("_n")


def label_windows(samples: DataFrame, size: float, step: float, frac: float = 0.7) -> DataFrame:
    """(rec_id, win, label): windows of time where one label has more than frac of the samples; others are left out."""
    n = assign_windows(samples, size, step).groupBy("rec_id", "win", "label").agg(F.count("*").alias("n"))
    m = n.groupBy("rec_id", "win").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("total"))
    return m.where(F.col("m.n") > F.floor(F.lit(frac) * F.col("total"))).select("rec_id", "win", "m.label")


def cluster_pairs(models: DataFrame) -> DataFrame:
    """(rec_id, a, b): each two clusters of a recording once; a recording has few clusters."""
    x, y = models.select("rec_id", F.col("label").alias("a")).distinct(), models.select("rec_id", F.col("label").alias("b")).distinct()
    return x.join(y, "rec_id").where("a < b")


def with_subject(feats: DataFrame, patients: DataFrame, key: str = "device_id") -> DataFrame:
    """Features with their subject's metadata; rows without a subject keep nulls."""
    return feats.join(patients, key, "left")


def long_windows(segs: DataFrame, size: int) -> DataFrame:
    """(rec_id, seg_begin, begin, end): windows of size samples, half overlapping, inside each segment; the last one ends with the segment. Shorter segments have none."""
    n = F.col("end") - F.col("begin") + 1
    hop = size // 2
    w = segs.where(n >= size).withColumn("_k", F.floor((n - size) / hop)).select("rec_id", F.col("begin").alias("seg_begin"), F.col("end").alias("_e"), "_k", F.explode(F.sequence(F.lit(0), F.col("_k").cast("int"))).alias("k"))
    begin = F.col("seg_begin") + F.col("k") * hop
    return w.select("rec_id", "seg_begin", begin.alias("begin"), F.when(F.col("k") == F.col("_k"), F.col("_e")).otherwise(begin + size - 1).alias("end"))
