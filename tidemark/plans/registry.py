"""Queries over the driver tables, each with its DuckDB counterpart. Events play the samples: a user is a recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scales
from tidemark.operators import aggregates as ag
from tidemark.operators import audio
from tidemark.operators import diarisation as dia
from tidemark.operators import intervals as iv
from tidemark.operators import mixtures, models
from tidemark.operators import relational as rel
from tidemark.operators import signal as sig
from tidemark.operators import vectors as vec
from tidemark.operators import windows as win
from tidemark.sources import readers

QUERIES: dict = {}
ORACLES: dict = {}  # of the queries that SQL can express


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """(rec_id, seq, t, x, label) of events; t in seconds."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select(F.col("user_id").alias("rec_id"), (F.row_number().over(w) - 1).cast("bigint").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("value").alias("x"), F.col("event_type").alias("label"))


def axes(df: DataFrame) -> DataFrame:
    """Three axes: a sample and the two before it, less 50."""
    return df.withColumns({"y": F.lag("x", 1, 0.0).over(win.SEQ()) - 50, "z": F.lag("x", 2, 0.0).over(win.SEQ()) - 50}).withColumn("x", F.col("x") - 50)


def orders_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as intervals of days per customer: from the order date, as long as the order's key says; label by key."""
    d = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("rec_id"), d.alias("begin"), (d + F.col("o_orderkey") % 90).cast("int").alias("end"), (F.col("o_orderkey") % 3).alias("label"), F.col("o_orderkey").alias("row"))


def truth(spark: SparkSession, sf: str) -> DataFrame:
    return orders_spans(spark, sf).where("row % 2 = 0").dropDuplicates(["rec_id", "begin", "end"]).select("rec_id", "begin", "end", F.lit(1).alias("label"))


def guess(spark: SparkSession, sf: str) -> DataFrame:
    return orders_spans(spark, sf).where("row % 2 = 1").dropDuplicates(["rec_id", "begin", "end"]).select("rec_id", "begin", "end", F.lit(1).alias("label"))


def speech(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations laid end to end, as long as their texts."""
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("rec_id"), F.col("turn"), F.col("role").alias("label"), F.greatest(F.length("text"), F.lit(1)).cast("bigint").alias("length"))
    return win.track_regions(t)


#: Shared parts of the SQL.
S = "s AS (SELECT user_id AS rec_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, epoch_us(ts) / 1e6 AS t, value AS x, event_type AS label FROM events)"
SPANS = "o AS (SELECT o_custkey AS rec_id, datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS \"begin\", datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + o_orderkey % 90 AS \"end\", o_orderkey % 3 AS label, o_orderkey AS row FROM orders)"
TG = SPANS + ", tr AS (SELECT DISTINCT rec_id, \"begin\", \"end\" FROM o WHERE row % 2 = 0), gu AS (SELECT DISTINCT rec_id, \"begin\", \"end\" FROM o WHERE row % 2 = 1)"
AXES = S + ", a AS (SELECT rec_id, seq, x - 50 AS x, lag(x, 1, 0.0) OVER w - 50 AS y, lag(x, 2, 0.0) OVER w - 50 AS z FROM s WINDOW w AS (PARTITION BY rec_id ORDER BY seq))"
FR = ", n AS (SELECT rec_id, count(*) AS n FROM {0} GROUP BY 1), f AS (SELECT v.*, g.frame, v.seq - g.frame * {2} AS k FROM {0} v JOIN n USING (rec_id), LATERAL (SELECT unnest(range(0, CAST(floor((n - {1}) / {2}) AS BIGINT) + 1)) AS frame) g WHERE v.seq BETWEEN g.frame * {2} AND g.frame * {2} + {1} - 1)"
SPEECH = "sp AS (SELECT conv_id AS rec_id, turn, role AS label, greatest(length(text), 1) AS length, sum(greatest(length(text), 1)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS e FROM conversations)"


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles to so many digits, as the oracle has them; no negative zero."""
    return df.select(*(F.round(F.col(c), digits).alias(c) + F.lit(0.0) if k in ("double", "float") else F.col(c) for c, k in df.dtypes)).toDF(*df.columns)


def add(name: str, query, sql: str) -> None:
    QUERIES[name] = query
    ORACLES[name] = sql


def over_samples(name: str, op, cols: str, sql: str, digits: int = 4) -> None:
    """A query of samples that keeps rec_id, seq and the named columns."""
    add(name, lambda s, d: rounded(op(samples(s, d)).select("rec_id", "seq", *cols.split()), digits), f"WITH {S} {sql}")


W = "WINDOW w AS (PARTITION BY rec_id ORDER BY seq)"

# windows
over_samples("moving_mean", lambda d: win.moving_mean(d, 8), "mean", ", q AS (SELECT *, avg(x) OVER (PARTITION BY rec_id ORDER BY seq ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) AS mean FROM s) SELECT rec_id, seq, round(mean, 7) AS mean FROM q", 7)
over_samples("median3", win.median3, "median", f"SELECT rec_id, seq, round(list_sort([lag(x, 1, 0.0) OVER w, x, lead(x, 1, 0.0) OVER w])[2], 4) AS median FROM s {W}")
over_samples("teager", win.teager, "teager", f", e AS (SELECT *, x * x - lag(x) OVER w * lead(x) OVER w AS e, row_number() OVER w AS j, count(*) OVER (PARTITION BY rec_id) AS n FROM s {W}) SELECT rec_id, seq, round(CASE WHEN j = 1 THEN 2 * lead(e, 1) OVER w - lead(e, 2) OVER w WHEN j = n THEN 2 * lag(e, 1) OVER w - lag(e, 2) OVER w ELSE e END, 7) + 0.0 AS teager FROM e {W}", 7)
over_samples("peak_normalize", ag.peak_normalize, "x", ", m AS (SELECT rec_id, max(abs(x)) AS p FROM s GROUP BY 1) SELECT s.rec_id, seq, round(CASE WHEN p > 0 THEN x / p ELSE x END, 7) + 0.0 AS x FROM s JOIN m ON m.rec_id = s.rec_id", 7)
over_samples("schmitt", lambda d: win.schmitt(d, 20.0, 60.0), "state", "SELECT rec_id, seq, CAST(coalesce(last_value(CASE WHEN x > 60 THEN 1 WHEN x < 20 THEN -1 END IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS INTEGER) AS state FROM s")
over_samples("schmitt_min_width", lambda d: win.schmitt(d, 20.0, 60.0, min_width=4), "state", ", c AS (SELECT rec_id, seq, coalesce(last_value(CASE WHEN x > 60 THEN 1 WHEN x < 20 THEN -1 END IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS c FROM s), h AS (SELECT *, c <> 0 AND c <> coalesce(lag(c) OVER (PARTITION BY rec_id ORDER BY seq), 0) AS h FROM c), e AS (SELECT rec_id, seq, c, lead(seq) OVER (PARTITION BY rec_id ORDER BY seq) AS nxt FROM h WHERE h), k AS (SELECT * FROM e WHERE nxt IS NULL OR nxt - seq >= 4) SELECT s.rec_id, s.seq, CAST(coalesce((SELECT arg_max(c, k.seq) FROM k WHERE k.rec_id = s.rec_id AND k.seq <= s.seq), 0) AS INTEGER) AS state FROM s")
over_samples("moving_max", lambda d: win.moving_max(d, 5), "running_max", "SELECT rec_id, seq, round(max(x) OVER (PARTITION BY rec_id ORDER BY seq ROWS 4 PRECEDING), 4) AS running_max FROM s")
over_samples("moving_moments", lambda d: win.moving_moments(d, 2, 6), "m1 m2", "SELECT rec_id, seq, round(avg(x) OVER v, 7) AS m1, round(avg(x * x) OVER v, 7) AS m2 FROM s WINDOW v AS (PARTITION BY rec_id ORDER BY seq ROWS 5 PRECEDING)", 7)
# as for ema below: 1e-9 more, in both, for sums that lie half way between two roundings
over_samples("moving_moments_weighted", lambda d: win.moving_moments(d, 2, 3, weights=[1.0, 2.0, 3.0], central=True).withColumns({"m1": F.col("m1") + 1e-9, "m2": F.col("m2") + 1e-9}), "m1 m2", ", w AS (SELECT rec_id, seq, x, seq AS p, 3 AS w FROM s UNION ALL SELECT rec_id, seq, x, seq + 1, 2 FROM s UNION ALL SELECT rec_id, seq, x, seq + 2, 1 FROM s), m AS (SELECT rec_id, p, sum(w * x) / sum(w) AS m1 FROM w GROUP BY 1, 2) SELECT s.rec_id, s.seq, round(any_value(m1) + 1e-9, 5) AS m1, round(sum(w.w * pow(w.x - m1, 2)) / sum(w.w) + 1e-9, 5) AS m2 FROM s JOIN m ON m.rec_id = s.rec_id AND m.p = s.seq JOIN w ON w.rec_id = s.rec_id AND w.p = s.seq GROUP BY 1, 2", 5)
over_samples("signed_power", lambda d: win.signed_power(d.withColumn("x", F.col("x") - 50), 0.5), "powered", "SELECT rec_id, seq, round(sign(x - 50) * pow(abs(x - 50), 0.5), 4) + 0.0 AS powered FROM s")
over_samples("rr_intervals", win.rr_intervals, "rr", f", q AS (SELECT rec_id, seq, lead(t) OVER w - t AS rr FROM s {W}) SELECT rec_id, seq, round(rr, 3) AS rr FROM q WHERE rr IS NOT NULL", 3)
over_samples("beat_time", lambda d: win.beat_time(d.withColumn("rr", F.col("x") / 100), True), "t", "SELECT rec_id, seq, round(sum(x / 100) OVER (PARTITION BY rec_id ORDER BY seq ROWS UNBOUNDED PRECEDING) - first_value(x / 100) OVER (PARTITION BY rec_id ORDER BY seq), 4) + 0.0 AS t FROM s")
over_samples("trim_edges", lambda d: win.trim_edges(d, 3), "x", f", q AS (SELECT *, row_number() OVER w AS j, count(*) OVER (PARTITION BY rec_id) AS n FROM s {W}) SELECT rec_id, seq, round(x, 4) AS x FROM q WHERE j > 3 AND j <= n - 3")
over_samples("deltas", win.deltas, "delta", ", q AS (SELECT *, " + " + ".join(f"{k} * (coalesce(lead(x, {k}) OVER w, last_value(x) OVER v) - coalesce(lag(x, {k}) OVER w, first_value(x) OVER v))" for k in range(1, 5)) + " AS d FROM s WINDOW w AS (PARTITION BY rec_id ORDER BY seq), v AS (PARTITION BY rec_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT rec_id, seq, round(d / 60, 4) + 0.0 AS delta FROM q")
over_samples("nearest_nonzero", lambda d: win.nearest_nonzero(d.withColumn("x", F.when(F.col("x") > 40, F.col("x")).otherwise(0.0))), "nearest offset",
             ", z AS (SELECT rec_id, seq, CASE WHEN x > 40 THEN x ELSE 0 END AS x FROM s), p AS (SELECT a.rec_id, a.seq, arg_min(b.x, abs(b.seq - a.seq) * 2 + (b.seq < a.seq)::INT) AS nearest, arg_min(b.seq - a.seq, abs(b.seq - a.seq) * 2 + (b.seq < a.seq)::INT) AS \"offset\" FROM z a LEFT JOIN z b ON a.rec_id = b.rec_id AND b.x <> 0 GROUP BY 1, 2) SELECT rec_id, seq, round(nearest, 4) AS nearest, \"offset\" FROM p")
over_samples("outlier_flags", lambda d: win.outlier_flags(d, 16, 1.5), "outlier",
             ", j AS (SELECT *, row_number() OVER w AS j, count(*) OVER (PARTITION BY rec_id) AS n FROM s WINDOW w AS (PARTITION BY rec_id ORDER BY seq)), b AS (SELECT *, CASE WHEN j = 1 THEN 1 WHEN j < 8.5 THEN 1 WHEN j = n THEN n - 1 WHEN j > n - 7.5 THEN 2 * j - n ELSE j - 7 END AS lo, CASE WHEN j = 1 THEN 2 WHEN j < 8.5 THEN 2 * j - 1 WHEN j = n THEN n WHEN j > n - 7.5 THEN n ELSE j + 8 END AS hi FROM j), c AS (SELECT a.rec_id, a.seq, a.x, a.n AS total, list_sort(list(v.x)) AS l FROM b a JOIN j v ON v.rec_id = a.rec_id AND v.j BETWEEN greatest(a.lo, 1) AND least(a.hi, a.n) GROUP BY ALL), q AS (SELECT *, len(l) AS m FROM c), r AS (SELECT *, CASE WHEN (m + 1) // 4 = 0 THEN l[1] WHEN (m + 1) % 4 = 0 THEN l[(m + 1) // 4] ELSE (l[(m + 1) // 4] + l[(m + 1) // 4 + 1]) / 2 END AS q1, CASE WHEN 3 * (m + 1) % 4 = 0 THEN l[3 * (m + 1) // 4] WHEN 3 * (m + 1) // 4 >= m THEN l[2] ELSE (l[3 * (m + 1) // 4] + l[3 * (m + 1) // 4 + 1]) / 2 END AS q3 FROM q) SELECT rec_id, seq, total >= 2 AND (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outlier FROM r")
add("split_gravity", lambda s, d: rounded(win.split_gravity(axes(samples(s, d)), 6).select("rec_id", "seq", "gravity_x", "body_x", "body_y", "body_z"), 7),
    f"WITH {AXES} SELECT rec_id, seq, round(avg(x) OVER v, 7) AS gravity_x, round(x - avg(x) OVER v, 7) + 0.0 AS body_x, round(y - avg(y) OVER v, 7) + 0.0 AS body_y, round(z - avg(z) OVER v, 7) + 0.0 AS body_z FROM a WINDOW v AS (PARTITION BY rec_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)")
add("zero_crossings", lambda s, d: rounded(win.zero_crossings(axes(samples(s, d)))), f"WITH {AXES}, q AS (SELECT rec_id, seq, x, lead(x) OVER w AS m FROM a {W}) SELECT rec_id, seq, round(seq - x / (m - x), 4) AS at, round(m - x, 4) AS slope FROM q WHERE (x < 0 AND m >= 0) OR (x >= 0 AND m < 0)")
RUNS = ", c AS (SELECT *, CASE WHEN lag(label) OVER w IS DISTINCT FROM label OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM s WINDOW w AS (PARTITION BY rec_id ORDER BY seq)), u AS (SELECT *, sum(c) OVER (PARTITION BY rec_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM c)"
add("label_runs", lambda s, d: win.label_runs(samples(s, d)), f"WITH {S}{RUNS} SELECT rec_id, run, min(label) AS label, min(seq) AS \"begin\", max(seq) AS \"end\", count(*) AS n FROM u GROUP BY rec_id, run")
add("find_peaks", lambda s, d: rounded(win.find_peaks(samples(s, d).withColumn("x", F.floor(F.col("x") / 20).cast("double")))),
    f"WITH {S.replace('value AS x, event_type AS label', 'floor(value / 20) AS label')}{RUNS}, g AS (SELECT rec_id, run, min(label) AS v, min(seq) AS b, max(seq) AS e, count(*) AS n FROM u GROUP BY 1, 2), h AS (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS q FROM g WINDOW w AS (PARTITION BY rec_id ORDER BY run)), i AS (SELECT *, CASE WHEN n = 1 THEN (q - p) / (2 * (2 * v - p - q)) ELSE 0 END AS sh FROM h WHERE p < v AND q < v) SELECT rec_id, round((b + e) / 2 + sh, 4) AS at, round(v + CASE WHEN n = 1 THEN (q - p) * sh / 4 ELSE 0 END, 4) AS height FROM i")
add("class_windows", lambda s, d: rounded(dia.class_windows(samples(s, d), 10).groupBy("rec_id", "label", F.col("_w").alias("w")).agg(F.min("seq").alias("begin"), F.max("seq").alias("end"), F.sum(F.col("x") * (F.col("_at") + 1)).alias("weighted"))),
    f"WITH {S}, i AS (SELECT *, row_number() OVER p - 1 AS i, count(*) OVER (PARTITION BY rec_id, label) AS n FROM s WINDOW p AS (PARTITION BY rec_id, label ORDER BY seq)), k AS (SELECT *, i // 5 - unnest([0, 1]) AS w FROM i) SELECT rec_id, label, w, min(seq) AS \"begin\", max(seq) AS \"end\", round(sum(x * (i - 5 * w + 1)), 4) AS weighted FROM k WHERE w >= 0 AND 5 * w + 10 <= n GROUP BY rec_id, label, w")
add("amplitude_gate", lambda s, d: rounded(win.amplitude_gate(samples(s, d).withColumn("height", F.col("x")), samples(s, d)).select("rec_id", "seq", "height")), f"WITH {S}, r AS (SELECT rec_id, sqrt(avg(x * x)) AS m FROM s GROUP BY 1) SELECT rec_id, seq, round(x, 4) AS height FROM s JOIN r USING (rec_id) WHERE abs(x) >= m")

# relations
add("sample_rate", lambda s, d: rel.sample_rate(samples(s, d).withColumn("t", F.col("t") / 60)), f"WITH {S} SELECT rec_id, round(CASE WHEN max(t) > min(t) THEN (count(*) - 1) / (max(t / 60) - min(t / 60)) END, 2) AS fs FROM s GROUP BY 1")
add("having_enough", lambda s, d: rel.having_enough(samples(s, d), "rec_id", 70).select("rec_id", "seq"), f"WITH {S}, n AS (SELECT rec_id FROM s GROUP BY 1 HAVING count(*) >= 70) SELECT rec_id, seq FROM s JOIN n USING (rec_id)")
add("binarize_label", lambda s, d: rel.binarize_label(samples(s, d), positive=["click", "view"]).select("rec_id", "seq", "binary"), f"WITH {S} SELECT rec_id, seq, CAST(label IN ('click', 'view') AS INTEGER) AS binary FROM s")
add("drop_labels", lambda s, d: rel.drop_labels(samples(s, d).withColumn("label", F.col("seq") % 8)).select("rec_id", "seq", "label"), f"WITH {S} SELECT rec_id, seq, seq % 8 AS label FROM s WHERE seq % 8 NOT IN (0, 5, 6, 7)")
add("scale", lambda s, d: rounded(rel.scale(samples(s, d), ["x"]).select("rec_id", "seq", "x"), 6), f"WITH {S} SELECT rec_id, seq, round(x / 1000, 6) AS x FROM s")
#: Checksums of the digits of a key, by a table of 256 remainders of eight halvings each.
CRC = "h AS (SELECT list(v ORDER BY i) AS h FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM range(256) r(i))), k AS (SELECT DISTINCT doc_id FROM labels), crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, h[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM k, h)"
add("holdout", lambda s, d: rel.folds(rel.holdout(table(s, d, "labels"), "doc_id"), "doc_id", 7).select("doc_id", "quality", "held_out", "fold"), f"WITH {CRC} SELECT doc_id, quality, crc % 5 = 0 AS held_out, crc % 7 AS fold FROM labels JOIN crc USING (doc_id)")
add("best", lambda s, d: rounded(rel.best(samples(s, d), "rec_id", "x", "seq")), f"WITH {S} SELECT rec_id, arg_min(seq, x) AS seq, round(min(x), 4) AS x FROM s GROUP BY 1")
add("worst_rows", lambda s, d: table(s, d, "events").transform(lambda e: rel.worst_rows(e, "value", 20, "event_id")).select("event_id", "value"), "SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 20")
add("compact_labels", lambda s, d: rel.compact_labels(orders_spans(s, d)).select("row", "compact"), f"WITH {SPANS} SELECT row, CAST(dense_rank() OVER (PARTITION BY rec_id ORDER BY label) AS INTEGER) AS compact FROM o")
add("merge_classes", lambda s, d: rel.merge_classes(orders_spans(s, d), {2: 1}).select("row", F.col("label").cast("bigint").alias("label")), f"WITH {SPANS} SELECT row, CASE WHEN label = 2 THEN 1 ELSE label END AS label FROM o")
add("min_duration", lambda s, d: rel.min_duration(orders_spans(s, d), 45).select("row", "begin", "end", "label"), f"WITH {SPANS} SELECT row, CAST(\"begin\" AS INTEGER) AS \"begin\", CAST(\"end\" AS INTEGER) AS \"end\", label FROM o WHERE \"end\" - \"begin\" >= 45")

# frames and aggregates
add("frames", lambda s, d: rounded(ag.frames(samples(s, d), 10, 4).select("rec_id", "frame", "k", "x")), f"WITH {S}{FR.format('s', 10, 4)} SELECT rec_id, frame, k, round(x, 4) AS x FROM f")
add("frames_reflected", lambda s, d: rounded(ag.frames(samples(s, d).select("rec_id", "seq", "x"), 10, 4, "reflect").select("rec_id", "frame", "k", "x")),
    f"WITH {S}, n AS (SELECT rec_id, count(*) AS n, greatest(CAST(floor((count(*) - 10) / 4.0) AS BIGINT) + 1, 0) AS f FROM s GROUP BY 1), t AS (SELECT *, f + CASE WHEN n > f * 4 + 6 AND n < f * 4 + 10 THEN 1 ELSE 0 END AS fs FROM n), g AS (SELECT rec_id, n, unnest(range(0, fs)) AS frame FROM t), k AS (SELECT *, unnest(range(0, 10)) AS k FROM g), p AS (SELECT rec_id, frame, k, n, (frame * 4 + k) % (2 * n) AS q FROM k) SELECT p.rec_id, frame, k, round(x, 4) AS x FROM p JOIN s ON s.rec_id = p.rec_id AND s.seq = CASE WHEN q < n THEN q ELSE 2 * n - 1 - q END")
add("frame_energy", lambda s, d: rounded(ag.frame_energy(ag.frames(samples(s, d), 10, 4)), 6), f"WITH {S}{FR.format('s', 10, 4)} SELECT rec_id, frame, round(sum(x * x), 6) AS energy FROM f GROUP BY 1, 2")
add("zcr", lambda s, d: rounded(ag.zcr(ag.frames(axes(samples(s, d)), 10, 4))), f"WITH {AXES}{FR.format('a', 10, 4)}, c AS (SELECT rec_id, frame, CASE WHEN sign(x) <> sign(lag(x) OVER (PARTITION BY rec_id, frame ORDER BY k)) THEN 1.0 WHEN k > 0 THEN 0.0 END AS c FROM f) SELECT rec_id, frame, round(avg(c), 4) AS zcr FROM c GROUP BY 1, 2")
add("overlap_add", lambda s, d: rounded(ag.overlap_add(ag.frames(samples(s, d), 10, 5).withColumn("v", F.col("x") * ag.window_weight("hann", 10)), 5)), f"WITH {S}{FR.format('s', 10, 5)} SELECT rec_id, frame * 5 + k AS seq, round(sum(x * (0.5 - 0.5 * cos(2 * pi() * k / 10))), 4) + 0.0 AS x FROM f GROUP BY 1, 2")
HAM = "(0.54 - 0.46 * cos(2 * pi() * k / 25))"
FEATS = f"WITH {AXES}{FR.format('a', 25, 13)}, v AS (SELECT rec_id, frame, x * {HAM} AS x, y * {HAM} AS y, z * {HAM} AS z FROM f), q AS (SELECT rec_id, frame, (sum(x * x) + sum(y * y) + sum(z * z)) / 25 AS e, avg(abs(x)) + avg(abs(y)) + avg(abs(z)) AS m, stddev_samp(x) + stddev_samp(y) + stddev_samp(z) AS d FROM v GROUP BY 1, 2)"
add("acc_features", lambda s, d: rounded(ag.acc_features(axes(samples(s, d)))), FEATS + " SELECT rec_id, frame, round(e, 4) AS body_energy_ave, round(m, 4) AS body_abs_mean, round(d, 4) AS body_std FROM q")
VOTE = {"body_energy_ave": 3500.0, "body_abs_mean": 72.0, "body_std": 80.0}
add("threshold_vote", lambda s, d: rel.threshold_vote(ag.acc_features(axes(samples(s, d))), VOTE).select("rec_id", "frame", "movement"), FEATS + " SELECT rec_id, frame, CAST((e >= 3500)::INT + (m >= 72)::INT + (d >= 80)::INT >= 2 AS INTEGER) AS movement FROM q")
add("movement_regions", lambda s, d: win.label_runs(rel.threshold_vote(ag.acc_features(axes(samples(s, d))), VOTE).select("rec_id", F.col("frame").alias("seq"), F.col("movement").alias("label"))),
    FEATS + ", s AS (SELECT rec_id, frame AS seq, CAST((e >= 3500)::INT + (m >= 72)::INT + (d >= 80)::INT >= 2 AS INTEGER) AS label FROM q)".replace("s AS", "s2 AS") + RUNS.replace("FROM s ", "FROM s2 ") + " SELECT rec_id, run, min(label) AS label, min(seq) AS \"begin\", max(seq) AS \"end\", count(*) AS n FROM u GROUP BY rec_id, run")
add("majority_label", lambda s, d: ag.majority_label(ag.frames(samples(s, d), 6, 2), 6, 0.5), f"WITH {S}{FR.format('s', 6, 2)}, c AS (SELECT rec_id, frame, label, count(*) AS n FROM f GROUP BY 1, 2, 3) SELECT rec_id, frame, label FROM c WHERE n > 3")
add("assign_windows", lambda s, d: iv.assign_windows(_relative(s, d), 300.0, 75.0).select("rec_id", "seq", "win"),
    f"WITH {S}, z AS (SELECT rec_id, seq, (t - min(t) OVER (PARTITION BY rec_id)) / 1000 AS t FROM s), m AS (SELECT rec_id, max(t) AS m FROM z GROUP BY 1), k AS (SELECT rec_id, unnest(range(0, 1 + CAST(floor(m / 75) AS BIGINT))) AS win, m FROM m) SELECT z.rec_id, seq, win FROM z JOIN k ON k.rec_id = z.rec_id AND win * 75 + 300 < m AND ceil(t) > win * 75 AND floor(t) <= win * 75 + 300")
add("hrv_time_features", lambda s, d: rounded(ag.hrv_time_features(samples(s, d).withColumns({"win": F.floor(F.col("seq") / 20), "rr": 0.6 + F.col("x") / 500}))),
    f"WITH {S}, r AS (SELECT rec_id, seq // 20 AS win, seq, 0.6 + x / 500 AS rr FROM s), g AS (SELECT *, rr - lag(rr) OVER (PARTITION BY rec_id, win ORDER BY seq) AS d, rr - avg(rr) OVER (PARTITION BY rec_id, win) AS c FROM r) SELECT rec_id, win, round(avg(rr) * 1000, 4) AS mean_rr, round(sqrt(avg(d * d)) * 1000, 4) AS rmssd, round(avg(CASE WHEN abs(d) >= 0.05 THEN 1.0 WHEN d IS NOT NULL THEN 0 END) * 100, 4) AS pnn50, round(CASE WHEN avg(c * c) > 1e-20 THEN avg(c * c * c) / pow(avg(c * c), 1.5) END, 4) AS skewness FROM g GROUP BY 1, 2")
add("quantile_n1", lambda s, d: rounded(ag.quantile_n1(samples(s, d), "label", "x", 0.3), 7), f"WITH {S}, r AS (SELECT label, x, row_number() OVER (PARTITION BY label ORDER BY x) AS rn, count(*) OVER (PARTITION BY label) AS n FROM s), m AS (SELECT *, greatest(least((n + 1) * CAST(0.3 AS DOUBLE), n), 1) AS m FROM r), q AS (SELECT label, max(CASE WHEN rn = floor(m) THEN x END) AS a, max(CASE WHEN rn = least(floor(m) + 1, n) THEN x END) AS b, max(m) AS m FROM m GROUP BY 1) SELECT label, round(a + (b - a) * (m - floor(m)), 7) AS quantile FROM q")
add("quartiles_mid", lambda s, d: rounded(ag.quartiles_mid(samples(s, d), "rec_id", "x"), 7), f"WITH {S}, q AS (SELECT rec_id, list_sort(list(x)) AS l, count(*) AS m FROM s GROUP BY 1 HAVING count(*) > 1) SELECT rec_id, round(CASE WHEN (m + 1) // 4 = 0 THEN l[1] WHEN (m + 1) % 4 = 0 THEN l[(m + 1) // 4] ELSE (l[(m + 1) // 4] + l[(m + 1) // 4 + 1]) / 2 END, 7) AS q1, round(CASE WHEN 3 * (m + 1) % 4 = 0 THEN l[3 * (m + 1) // 4] WHEN 3 * (m + 1) // 4 >= m THEN l[2] ELSE (l[3 * (m + 1) // 4] + l[3 * (m + 1) // 4 + 1]) / 2 END, 7) AS q3 FROM q")
add("confusion", lambda s, d: ag.confusion(table(s, d, "labels"), "quality", "toxic"), "SELECT CAST(sum((quality = 1 AND toxic = 1)::INT) AS BIGINT) AS tp, CAST(sum((quality = 1 AND toxic = 0)::INT) AS BIGINT) AS fp, CAST(sum((quality = 0 AND toxic = 1)::INT) AS BIGINT) AS fn, CAST(sum((quality = toxic)::INT) AS BIGINT) AS correct, count(*) AS total FROM labels")
add("hist_nd", lambda s, d: ag.hist_nd(table(s, d, "lineitem"), ["l_quantity", "l_discount"], [10, 5], [0.0, -0.01], [51.0, 0.12]), "SELECT CAST(ceil(l_quantity * 10 / 51.0) AS BIGINT) AS bin_l_quantity, CAST(ceil((l_discount + 0.01) * 5 / (CAST(0.12 AS DOUBLE) + 0.01)) AS BIGINT) AS bin_l_discount, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING bin_l_quantity BETWEEN 1 AND 10 AND bin_l_discount BETWEEN 1 AND 5")
add("entropy", lambda s, d: rounded(ag.entropy(table(s, d, "lineitem"), ["l_returnflag"], ["l_linestatus"]), 6), "WITH j AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2), g AS (SELECT l_linestatus, count(*) AS n FROM lineitem GROUP BY 1) SELECT round((SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM j) - (SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM g), 6) AS entropy")
add("entropy_by", lambda s, d: rounded(ag.entropy(table(s, d, "lineitem"), ["l_returnflag"], by=["l_linestatus"], steps=[0.25]), 6), "WITH j AS (SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_linestatus, round(log2(sum(n)) - sum(n * log2(n)) / sum(n) - 2, 6) AS entropy FROM j GROUP BY 1")
add("log_sum_exp", lambda s, d: rounded(ag.log_sum_exp(table(s, d, "lineitem"), "l_returnflag", "l_quantity"), 6), "WITH m AS (SELECT l_returnflag, max(l_quantity) AS m FROM lineitem GROUP BY 1) SELECT l_returnflag, round(max(m) + ln(sum(exp(l_quantity - m))), 6) AS lse FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1")
add("moments", lambda s, d: rounded(ag.moments(table(s, d, "lineitem"), "l_returnflag", "l_quantity"), 2), "WITH r AS (SELECT l_returnflag, avg(l_quantity) AS m FROM lineitem GROUP BY 1), c AS (SELECT l_returnflag, max(m) AS m, avg(pow(l_quantity - m, 2)) AS c2, avg(pow(l_quantity - m, 3)) AS c3, avg(pow(l_quantity - m, 4)) AS c4 FROM lineitem JOIN r USING (l_returnflag) GROUP BY 1) SELECT l_returnflag, round(m, 2) AS mean, round(c2, 2) AS c2, round(c3, 2) + 0.0 AS c3, round(c4, 2) AS c4, round(c4 - 3 * c2 * c2, 2) AS k4 FROM c")
add("energy_confidence", lambda s, d: ag.energy_confidence(samples(s, d).withColumn("energy", F.col("x") * F.col("x"))).select("rec_id", "seq", "label", "level"), f"WITH {S}, r AS (SELECT rec_id, seq, label, x * x AS e, row_number() OVER (PARTITION BY label ORDER BY x * x) AS rn, count(*) OVER (PARTITION BY label) AS n FROM s), m AS (SELECT *, greatest(least((n + 1) * 0.25::DOUBLE, n), 1) AS a, greatest(least((n + 1) * 0.75::DOUBLE, n), 1) AS b FROM r), q AS (SELECT label, max(CASE WHEN rn = floor(a) THEN e END) AS l1, max(CASE WHEN rn = least(floor(a) + 1, n) THEN e END) AS h1, max(CASE WHEN rn = floor(b) THEN e END) AS l3, max(CASE WHEN rn = least(floor(b) + 1, n) THEN e END) AS h3, max(a) AS a, max(b) AS b FROM m GROUP BY 1), t AS (SELECT label, l1 + (h1 - l1) * (a - floor(a)) AS q1, l3 + (h3 - l3) * (b - floor(b)) AS q3 FROM q) SELECT rec_id, seq, label, CAST((e > q3 + 1.5 * (q3 - q1))::INT + (e > q3 + 3 * (q3 - q1))::INT AS INTEGER) AS level FROM r JOIN t USING (label)")
add("normalize_balanced", lambda s, d: rounded(ag.normalize_balanced(table(s, d, "lineitem").withColumn("o", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "l_returnflag", "l_quantity", "o").select("o", "z")),
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey * 10 + l_linenumber) AS rn FROM lineitem), k AS (SELECT min(c) AS k FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_returnflag)), t AS (SELECT avg(l_quantity) AS mu, stddev_samp(l_quantity) AS sd FROM r, k WHERE rn <= k), z AS (SELECT l_orderkey * 10 + l_linenumber AS o, (l_quantity - mu) / sd AS z FROM lineitem, t) SELECT o, round(z - (SELECT avg(z) FROM z), 4) + 0.0 AS z FROM z")
add("snr_seg", lambda s, d: rounded(ag.snr_seg(samples(s, d), samples(s, d).withColumn("x", F.col("x") * 0.9 + F.col("seq") % 3), 8)), f"WITH {S}, r AS (SELECT rec_id, seq // 8 AS f, x, x * 0.9 + seq % 3 AS r FROM s), g AS (SELECT rec_id, f, sum(r * r) AS a, sum(pow(x - r, 2)) AS e FROM r GROUP BY 1, 2 HAVING count(*) = 8) SELECT rec_id, round(avg(CASE WHEN a = 0 THEN -100 WHEN e = 0 THEN 100 ELSE greatest(least(10 * log10(a / e), 100), -100) END), 4) AS seg_snr, round(10 * log10(sum(a) / sum(e)), 4) AS glo_snr FROM g GROUP BY 1")

# intervals
add("label_points", lambda s, d: iv.label_points(_ship_days(s, d), orders_spans(s, d), "seq", 32), f"WITH {SPANS}, p AS (SELECT DISTINCT o_custkey AS rec_id, datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS seq FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT p.rec_id, CAST(seq AS INTEGER) AS seq, arg_max(label, row) AS label FROM p JOIN o ON p.rec_id = o.rec_id AND seq BETWEEN \"begin\" AND \"end\" GROUP BY 1, 2")
add("overlap_join", lambda s, d: iv.overlap_join(truth(s, d), guess(s, d), 64).select("rec_id", "a_begin", "b_begin", "begin", "end"), f"WITH {TG} SELECT t.rec_id, t.\"begin\" AS a_begin, g.\"begin\" AS b_begin, greatest(t.\"begin\", g.\"begin\") AS \"begin\", least(t.\"end\", g.\"end\") AS \"end\" FROM tr t JOIN gu g ON t.rec_id = g.rec_id AND t.\"begin\" <= g.\"end\" AND g.\"begin\" <= t.\"end\"")
add("contain_join", lambda s, d: iv.contain_join(truth(s, d).select("rec_id", "begin", "end", "label"), guess(s, d), 64).select("rec_id", "begin", "end", "outer_label"), f"WITH {TG} SELECT t.rec_id, t.\"begin\", t.\"end\", CAST(EXISTS (SELECT 1 FROM gu g WHERE g.rec_id = t.rec_id AND g.\"begin\" <= t.\"begin\" AND g.\"end\" >= t.\"end\") AS INTEGER) AS outer_label FROM tr t")
HIT = "EXISTS (SELECT 1 FROM gu g WHERE g.rec_id = t.rec_id AND g.\"begin\" <= t.\"end\" AND t.\"begin\" <= g.\"end\")"
add("hit_segments", lambda s, d: iv.hit_segments(truth(s, d), guess(s, d), 64).select("rec_id", "begin", "end"), f"WITH {TG} SELECT * FROM tr t WHERE {HIT}")
add("missed_segments", lambda s, d: iv.missed_segments(truth(s, d), guess(s, d), 64).select("rec_id", "begin", "end"), f"WITH {TG} SELECT * FROM tr t WHERE NOT {HIT}")
add("coalesce_intervals", lambda s, d: iv.coalesce_intervals(orders_spans(s, d), 30), f"WITH {SPANS}, m AS (SELECT *, max(\"end\") OVER (PARTITION BY rec_id ORDER BY \"begin\", \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM o), i AS (SELECT *, sum(CASE WHEN p IS NULL OR \"begin\" - p > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY \"begin\", \"end\" ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT rec_id, min(\"begin\") AS \"begin\", max(\"end\") AS \"end\" FROM i GROUP BY rec_id, k")
add("subtract_intervals", lambda s, d: iv.subtract_intervals(truth(s, d), guess(s, d), 64).select("rec_id", "begin", "end"),
    f"WITH {TG}, x AS (SELECT t.rec_id, t.\"begin\" AS b, t.\"end\" AS e, unnest(range(t.\"begin\", t.\"end\" + 1)) AS x FROM tr t), d AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM gu g WHERE g.rec_id = x.rec_id AND x.x BETWEEN g.\"begin\" AND g.\"end\")), r AS (SELECT *, x - row_number() OVER (PARTITION BY rec_id, b, e ORDER BY x) AS part FROM d) SELECT rec_id, CAST(min(x) AS INTEGER) AS \"begin\", CAST(max(x) AS INTEGER) AS \"end\" FROM r GROUP BY rec_id, b, e, part")
add("speak_stats", lambda s, d: rounded(iv.speak_stats(speech(s, d))), f"WITH {SPEECH}, r AS (SELECT *, CASE WHEN lag(label) OVER w = label THEN 0 ELSE 1 END AS c FROM sp WINDOW w AS (PARTITION BY rec_id ORDER BY turn)), u AS (SELECT *, sum(c) OVER (PARTITION BY rec_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS k FROM r), g AS (SELECT rec_id, label, k, sum(length) AS d, max(length) AS p FROM u GROUP BY 1, 2, 3) SELECT rec_id, label, count(*) AS turns, CAST(sum(d) AS DOUBLE) AS total, CAST(max(p) AS DOUBLE) AS longest_phrase, CAST(max(d) AS DOUBLE) AS longest_turn FROM g GROUP BY 1, 2")
add("track_regions", lambda s, d: speech(s, d).select("rec_id", "turn", "begin", "end"), f"WITH {SPEECH} SELECT rec_id, turn, CAST(e - length + 1 AS BIGINT) AS \"begin\", CAST(e AS BIGINT) AS \"end\" FROM sp")
add("peak_in_interval", lambda s, d: rounded(iv.peak_in_interval(samples(s, d), samples(s, d).where("seq % 10 = 0").select("rec_id", F.col("seq").alias("begin"), (F.col("seq") + 6).alias("end")), 16)), f"WITH {S} SELECT a.rec_id, a.seq AS \"begin\", a.seq + 6 AS \"end\", arg_max(b.seq, abs(b.x) * 1e6 - b.seq * 1e-3) AS at, round(max(b.x), 4) AS height FROM s a JOIN s b ON a.rec_id = b.rec_id AND b.seq BETWEEN a.seq AND a.seq + 6 WHERE a.seq % 10 = 0 GROUP BY 1, 2")
add("gaussians_per_cluster", lambda s, d: rounded(ag.gaussians_per_cluster(speech(s, d), 10.0)), f"WITH {SPEECH}, g AS (SELECT rec_id, label, sum(length) / 10 AS seconds FROM sp GROUP BY 1, 2) SELECT rec_id, label, round(seconds, 4) AS seconds, CAST(greatest(3, floor(seconds / ((0.01 * seconds + 2.6) * count(*) OVER (PARTITION BY rec_id)))) AS BIGINT) AS g FROM g")
add("n_clusters", lambda s, d: ag.n_clusters(speech(s, d)), f"WITH {SPEECH} SELECT rec_id, count(DISTINCT label) AS k FROM sp GROUP BY 1")
add("stitch_chunks", lambda s, d: win.stitch_chunks(samples(s, d).select("rec_id", F.floor(F.col("seq") / 25).alias("chunk"), (F.col("seq") % 25).alias("begin"), (F.col("seq") % 25 + 1).alias("end"), (F.col("seq") % (2 + F.floor(F.col("seq") / 25) % 3)).alias("label")), 25), f"WITH {S}, c AS (SELECT rec_id, seq // 25 AS chunk, seq % 25 AS b, seq % (2 + seq // 25 % 3) AS label FROM s), k AS (SELECT rec_id, chunk, count(DISTINCT label) AS k FROM c GROUP BY 1, 2), p AS (SELECT rec_id, chunk, coalesce(sum(k) OVER (PARTITION BY rec_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM k) SELECT rec_id, chunk, b + chunk * 25 AS \"begin\", b + 1 + chunk * 25 AS \"end\", CAST(label + p AS BIGINT) AS label FROM c JOIN p USING (rec_id, chunk)")

add("best_lag", lambda s, d: rounded(iv.best_lag(samples(s, d), samples(s, d).withColumn("x", F.col("x") * 2).withColumn("seq", F.col("seq") - 2), 0, 4)),
    f"WITH {S}, j AS (SELECT a.rec_id, b.seq - 2 + l.lag AS at, l.lag, a.x, b.x * 2 AS r FROM s a JOIN s b ON a.rec_id = b.rec_id, (SELECT unnest(range(0, 5)) AS lag) l WHERE a.seq = b.seq - 2 + l.lag), g AS (SELECT rec_id, lag, sum(x * r) AS rs, sum(r * r) AS rr, sum(x * x) AS ss FROM j GROUP BY 1, 2) SELECT rec_id, CAST(arg_max(lag, rs / sqrt(rr * ss)) AS INTEGER) AS lag, round(arg_max(rs / rr, rs / sqrt(rr * ss)), 4) AS gain FROM g GROUP BY 1")
GAPS = "SELECT t.rec_id, t.\"begin\" AS b, t.\"end\" AS e, greatest(t.\"begin\", g.\"begin\") AS x, least(t.\"end\", g.\"end\") AS y FROM {0} t JOIN {1} g ON t.rec_id = g.rec_id AND t.\"begin\" <= g.\"end\" AND g.\"begin\" <= t.\"end\""
OPEN = "SELECT sum(CASE WHEN p.b IS NULL AND t.\"end\" - t.\"begin\" + 1 >= 20 THEN greatest(t.\"end\" - t.\"begin\" + 1 - 5, 0) WHEN p.b IS NOT NULL THEN p.gaps + p.tail ELSE 0 END) AS o, sum(CASE WHEN p.b IS NULL AND t.\"end\" - t.\"begin\" + 1 < 20 THEN greatest(t.\"end\" - t.\"begin\" + 1 - 5, 0) ELSE 0 END) AS k, sum(t.\"end\" - t.\"begin\" + 1) AS total FROM {0} t LEFT JOIN {1} p ON p.rec_id = t.rec_id AND p.b = t.\"begin\" AND p.e = t.\"end\""
PER = "SELECT rec_id, b, e, sum(gap) AS gaps, greatest(max(e) - max(y) - 5, 0) AS tail FROM (SELECT *, greatest(x - coalesce(lag(y) OVER (PARTITION BY rec_id, b, e ORDER BY x, y), b - 1) - 1 - 5, 0) AS gap FROM {0}) GROUP BY 1, 2, 3"
add("diarization_error", lambda s, d: rounded(iv.diarization_error(truth(s, d), guess(s, d), 5, 20, 64)),
    f"WITH {TG}, c1 AS ({GAPS.format('tr', 'gu')}), c2 AS ({GAPS.format('gu', 'tr')}), p1 AS ({PER.format('c1')}), p2 AS ({PER.format('c2')}), m AS ({OPEN.format('tr', 'p1')}), f AS ({OPEN.format('gu', 'p2')}) SELECT round(100 * m.o / m.total, 4) AS miss, round(100 * f.o / m.total, 4) AS fa, round(100 * m.k / m.total, 4) AS se, round(100 * m.o / m.total + 100 * f.o / m.total + 100 * m.k / m.total, 4) AS der FROM m, f")
add("regrid_decisions", lambda s, d: iv.regrid_decisions(win.label_runs(samples(s, d).withColumn("label", (F.col("x") > 30).cast("int"))), samples(s, d).where("seq % 7 = 0").select("rec_id", F.col("seq").alias("begin"), (F.col("seq") + 6).alias("end")), 32).select("rec_id", "begin", "flag"),
    f"WITH {S} SELECT a.rec_id, a.seq AS \"begin\", CAST(2 * sum(CASE WHEN b.x > 30 THEN 1 ELSE 0 END) > 7 AS INTEGER) AS flag FROM s a JOIN s b ON a.rec_id = b.rec_id AND b.seq BETWEEN a.seq AND a.seq + 6 WHERE a.seq % 7 = 0 GROUP BY 1, 2")
add("label_windows", lambda s, d: iv.label_windows(_relative(s, d).withColumn("label", (F.col("x") > 15).cast("int")), 300.0, 150.0),
    f"WITH {S}, z AS (SELECT rec_id, (t - min(t) OVER (PARTITION BY rec_id)) / 1000 AS t, CAST(x > 15 AS INTEGER) AS label FROM s), m AS (SELECT rec_id, max(t) AS m FROM z GROUP BY 1), k AS (SELECT rec_id, unnest(range(0, 1 + CAST(floor(m / 150) AS BIGINT))) AS win, m FROM m), c AS (SELECT z.rec_id, win, label, count(*) AS n FROM z JOIN k ON k.rec_id = z.rec_id AND win * 150 + 300 < m AND ceil(t) > win * 150 AND floor(t) <= win * 150 + 300 GROUP BY 1, 2, 3) SELECT rec_id, win, label FROM (SELECT *, sum(n) OVER (PARTITION BY rec_id, win) AS total FROM c) WHERE n > floor(CAST(0.7 AS DOUBLE) * total)")
add("cluster_pairs", lambda s, d: iv.cluster_pairs(orders_spans(s, d)).select("rec_id", "a", "b"), f"WITH {SPANS}, l AS (SELECT DISTINCT rec_id, label FROM o) SELECT a.rec_id, a.label AS a, b.label AS b FROM l a JOIN l b ON a.rec_id = b.rec_id AND a.label < b.label")
add("with_subject", lambda s, d: iv.with_subject(table(s, d, "customer").select(F.col("c_custkey"), F.col("c_nationkey").alias("device_id")), table(s, d, "nation").select(F.col("n_nationkey").alias("device_id"), "n_name")).select("c_custkey", "n_name"), "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
add("long_windows", lambda s, d: iv.long_windows(truth(s, d), 20).select("rec_id", "seg_begin", "begin", "end").distinct(), f"WITH {TG}, w AS (SELECT rec_id, \"begin\" AS b, \"end\" AS e, unnest(range(0, CAST(floor((\"end\" - \"begin\" + 1 - 20) / 10) AS BIGINT) + 1)) AS k FROM tr WHERE \"end\" - \"begin\" + 1 >= 20) SELECT DISTINCT rec_id, b AS seg_begin, CAST(b + k * 10 AS BIGINT) AS \"begin\", CASE WHEN k = floor((e - b + 1 - 20) / 10) THEN e ELSE b + k * 10 + 19 END AS \"end\" FROM w")

# scalars
add("shex2dec", lambda s, d: table(s, d, "events").select("event_id", scales.shex2dec(F.lpad(F.hex(F.col("event_id") * 37 % 65536), 4, "0")).alias("v")), "SELECT event_id, CASE WHEN event_id * 37 % 65536 > 32768 THEN event_id * 37 % 65536 - 65536 ELSE event_id * 37 % 65536 END AS v FROM events")
add("frequency_scales", lambda s, d: rounded(table(s, d, "events").withColumn("f", F.col("value") * 40 - 500).select("event_id", scales.hz_to_mel(F.col("f")).alias("mel"), scales.mel_to_hz(F.col("f")).alias("hz"), scales.hz_to_bark(F.col("f"), "linear", "linear").alias("bark"), scales.hz_to_bark(F.col("f")).alias("bark_smooth"), scales.bark_to_hz(F.col("value") / 5).alias("from_bark"), scales.hz_to_midi(F.col("f")).alias("midi"), scales.midi_to_hz(F.col("value") / 10).alias("from_midi")), 3),
    "WITH e AS (SELECT event_id, value, value * 40 - 500 AS f FROM events), b AS (SELECT *, 26.81 * abs(f) / (1960 + abs(f)) - 0.53 AS b, CASE WHEN abs(value / 5) < 3 THEN 3 - (1 - sqrt(greatest(1 - 4 * 0.53 / pow(3.53, 2) * (3 - abs(value / 5)), 0))) / (2 * 0.53 / pow(3.53, 2)) WHEN abs(value / 5) > 21.65 THEN (abs(value / 5) + 5.1) / 1.25 WHEN abs(value / 5) > 19.4 THEN 19.4 + 8 * (sqrt(1 + (abs(value / 5) - 19.4) / 4) - 1) ELSE abs(value / 5) END AS r FROM e) SELECT event_id, round(sign(f) * ln(1 + abs(f) / 700) * 1127.01048, 3) + 0.0 AS mel, round(sign(f) * 700 * (exp(abs(f) / 1127.01048) - 1), 3) + 0.0 AS hz, round(sign(f) * CASE WHEN b < 2 THEN b + 0.15 * (2 - b) WHEN b > 20.1 THEN b + 0.22 * (b - 20.1) ELSE b END, 3) + 0.0 AS bark, round(sign(f) * CASE WHEN b < 3 THEN b + 0.53 / pow(3.53, 2) * pow(3 - b, 2) WHEN b > 21.4 THEN 1.25 * b - 5.1 WHEN b > 19.4 THEN b + pow(b - 19.4, 2) / 16 ELSE b END, 3) + 0.0 AS bark_smooth, round(CASE WHEN r < 26.28 THEN sign(value) * 1960 * (r + 0.53) / (26.28 - r) END, 3) + 0.0 AS from_bark, round(69 + 12 * log2(nullif(abs(f), 0) / 440), 3) + 0.0 AS midi, round(440 * pow(2, (value / 10 - 69) / 12), 3) AS from_midi FROM b")

add("file_names", lambda s, d: table(s, d, "customer").withColumn("f", F.concat(F.lit("acc_exp"), "c_custkey", F.lit("_user"), "c_nationkey", F.lit(".v1.txt"))).select("c_custkey", F.element_at(scales.name_numbers(F.col("f")), 1).alias("exp"), F.element_at(scales.name_numbers(F.col("f")), 2).alias("user"), scales.strip_ext(F.col("f")).alias("stem")), "SELECT c_custkey, c_custkey AS exp, CAST(c_nationkey AS BIGINT) AS \"user\", 'acc_exp' || c_custkey || '_user' || c_nationkey || '.v1' AS stem FROM customer")
add("at_offset", lambda s, d: table(s, d, "events").select("event_id", F.unix_micros(scales.at_offset(F.col("ts").cast("timestamp"), F.col("value"))).alias("us")), "SELECT event_id, epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT) AS us FROM events")
PAIRS = "p AS (SELECT rec_id, seq // 8 AS g, x + 1 AS a, lead(x, 1, 50.0) OVER (PARTITION BY rec_id ORDER BY seq) + 2 AS b, CASE WHEN seq % 8 IN (0, 7) THEN 0.5 ELSE 1 END AS w FROM s)"
add("spectral_distances", lambda s, d: rounded(_spectra(s, d), 6), f"WITH {S}, {PAIRS} SELECT rec_id, g, round(sum(w * (a / b - ln(a / b))) / 7 - 1, 6) AS itakura_saito, round(ln(sum(w * a / b) / 7) - sum(w * ln(a / b)) / 7, 6) AS itakura, round(sum(w * (a / b + b / a) / 2) / 7 - 1, 6) AS cosh FROM p GROUP BY 1, 2 HAVING count(*) = 8")
add("band_powers", lambda s, d: rounded(ag.band_powers(samples(s, d).select("rec_id", F.floor(F.col("seq") / 32).alias("win"), (F.col("seq") % 32 / 64).alias("f"), F.col("x").alias("p")), 1.0), 2), f"WITH {S}, p AS (SELECT rec_id, seq // 32 AS win, seq % 32 / 64 AS f, x AS p FROM s), b AS (SELECT rec_id, win, avg(p) FILTER (f <= 0.04) * 0.04 * 1e6 AS vlf, avg(p) FILTER (f > 0.04 AND f <= 0.15) * (0.15 - 0.04)::DOUBLE * 1e6 AS lf, avg(p) FILTER (f > 0.15 AND f <= 0.4) * (0.4 - 0.15)::DOUBLE * 1e6 AS hf, avg(p) / 2 * 1e6 AS tp FROM p GROUP BY 1, 2) SELECT rec_id, win, round(vlf, 2) AS vlf, round(lf, 2) AS lf, round(hf, 2) AS hf, round(tp, 2) AS tp, round(CASE WHEN hf <> 0 THEN lf / hf END, 2) AS lf_hf FROM b")
add("select_label", lambda s, d: rel.select_label(orders_spans(s, d), 1).select("row"), f"WITH {SPANS} SELECT row FROM o WHERE label = 1")
add("drop_unlabelled", lambda s, d: rel.drop_unlabelled(orders_spans(s, d)).select("row", "label"), f"WITH {SPANS} SELECT row, label FROM o WHERE label <> 0")
add("keep_beats", lambda s, d: rel.keep_beats(table(s, d, "lineitem"), "l_returnflag").select("l_orderkey", "l_linenumber", "l_returnflag"), "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag IN ('N', 'L', 'R', 'B', 'A', 'a', 'J', 'S', 'V', 'r', 'F', 'e', 'j', 'n', 'E')")
add("union_all", lambda s, d: rel.union_all([truth(s, d), guess(s, d)]).select("rec_id", "begin", "end"), f"WITH {TG} SELECT rec_id, CAST(\"begin\" AS INTEGER) AS \"begin\", CAST(\"end\" AS INTEGER) AS \"end\" FROM tr UNION ALL SELECT rec_id, \"begin\", \"end\" FROM gu")
Q = "l[CAST(floor({m}) AS BIGINT)] + (l[CAST(least(floor({m}) + 1, n) AS BIGINT)] - l[CAST(floor({m}) AS BIGINT)]) * ({m} - floor({m}))"
M = "greatest(least((n + 1) * CAST({p} AS DOUBLE), n), 1)"
QUANTILE = {p: Q.format(m=M.format(p=p)) for p in (0.5, 0.05)}
add("prosody_summary", lambda s, d: rounded(ag.prosody_summary(samples(s, d).select("rec_id", F.col("x").alias("pitch"), (F.col("x") * 2).alias("harmonicity"), (F.col("x") * 3).alias("f4"), (F.col("x") + 7).alias("f5"), (F.col("x") - 5).alias("dispersion")), "rec_id")),
    f"WITH {S}, q AS (SELECT rec_id, list_sort(list(x)) AS l, count(*) AS n, avg(x) AS m, stddev_samp(x) AS sd FROM s GROUP BY 1), r AS (SELECT *, {QUANTILE[0.5]} AS p50, {QUANTILE[0.05]} AS p05 FROM q) SELECT rec_id, round(m, 4) AS pitch_mean, round(2 * m, 4) AS harmonicity_mean, round(3 * sd, 4) AS f4_std, round(3 * m, 4) AS f4_mean, round(sd, 4) AS f5_std, round(m + 7, 4) AS f5_mean, round(m - 5, 4) AS dispersion_mean, round(p50, 4) AS pitch_median, round(p05, 4) AS pitch_p05, round(3 * p05, 4) AS f4_p05, round(p05 + 7, 4) AS f5_p05 FROM r")

# vectors
E = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS k FROM embeddings), c AS (SELECT label, k, avg(v) AS m FROM e GROUP BY 1, 2)"
add("distances", lambda s, d: rounded(vec.nearest(table(s, d, "embeddings"), vec.class_means(table(s, d, "embeddings"), "embedding", "label"), "vec_id", "embedding"), 4), f"WITH {E}, d AS (SELECT vec_id, c.label AS center, sum(pow(v - m, 2)) AS d FROM e JOIN c USING (k) GROUP BY 1, 2) SELECT vec_id, arg_min(center, d) AS center, round(min(d), 4) AS distance FROM d GROUP BY 1")
add("all_distances", lambda s, d: rounded(vec.distances(table(s, d, "embeddings"), vec.class_means(table(s, d, "embeddings"), "embedding", "label"), "embedding").select("vec_id", "center", "distance"), 4), f"WITH {E} SELECT vec_id, c.label AS center, round(sum(pow(v - m, 2)), 4) AS distance FROM e JOIN c USING (k) GROUP BY 1, 2")
add("row_distances", lambda s, d: rounded(vec.row_distances(table(s, d, "embeddings"), table(s, d, "embeddings").withColumn("vec_id", F.col("vec_id") + 1), "vec_id", "embedding", root=True), 4), "WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS k, unnest(embedding) AS v FROM embeddings) SELECT a.vec_id, round(sqrt(sum(pow(CAST(a.v AS DOUBLE) - CAST(b.v AS DOUBLE), 2))), 4) AS distance FROM e a JOIN e b ON a.vec_id = b.vec_id + 1 AND a.k = b.k GROUP BY 1")
add("kmeans", lambda s, d: rounded(vec.kmeans_step(table(s, d, "embeddings"), vec.class_means(table(s, d, "embeddings"), "embedding", "label"), "vec_id", "embedding").select("center", F.posexplode("mean").alias("k", "m")), 4), f"WITH {E}, d AS (SELECT vec_id, c.label AS center, sum(pow(v - m, 2)) AS d FROM e JOIN c USING (k) GROUP BY 1, 2), n AS (SELECT vec_id, arg_min(center, d) AS center FROM d GROUP BY 1) SELECT center, CAST(k AS INTEGER) AS k, round(avg(v), 4) + 0.0 AS m FROM e JOIN n USING (vec_id) GROUP BY 1, 2")
#: Rounds of a codebook's k-means, as kmeans_lbg has them.
ROUNDS = 5
ROUND = "d{i} AS (SELECT vec_id, c{i}.label AS center, sum(pow(v - m, 2)) AS d FROM e JOIN c{i} USING (k) GROUP BY 1, 2), n{i} AS (SELECT vec_id, arg_min(center, d) AS center FROM d{i} GROUP BY 1), c{j} AS (SELECT center AS label, k, avg(v) AS m FROM e JOIN n{i} USING (vec_id) GROUP BY 1, 2)"
add("kmeans_rounds", lambda s, d: rounded(vec.kmeans(table(s, d, "embeddings"), vec.class_means(table(s, d, "embeddings"), "embedding", "label"), "vec_id", "embedding", ROUNDS).select("center", F.posexplode("mean").alias("k", "m")), 4), f"WITH {E}, c0 AS (SELECT * FROM c), {', '.join(ROUND.format(i=i, j=i + 1) for i in range(ROUNDS))} SELECT label AS center, CAST(k AS INTEGER) AS k, round(m, 4) + 0.0 AS m FROM c{ROUNDS}")
add("gmm_global", lambda s, d: rounded(vec.gmm_global(vec.class_gaussians(table(s, d, "embeddings"), "embedding", "label")), 5), f"WITH {E} SELECT CAST(k AS INTEGER) AS k, round(avg(v), 5) + 0.0 AS mean, round(var_pop(v), 5) AS var FROM e GROUP BY 1")
add("class_scatter", lambda s, d: rounded(vec.scatter_traces(table(s, d, "embeddings"), "embedding", "label"), 3), f"WITH {E}, g AS (SELECT k, avg(v) AS g FROM e GROUP BY 1) SELECT round(sum(pow(v - m, 2)), 3) AS within, round(sum(pow(m - g, 2)), 3) AS between FROM e JOIN c USING (label, k) JOIN g USING (k)")
add("score_gmm", lambda s, d: rounded(vec.score_gmm(table(s, d, "embeddings"), vec.class_gaussians(table(s, d, "embeddings"), "embedding", "label"), "vec_id", "embedding"), 3), f"WITH {E.replace('avg(v) AS m', 'avg(v) AS m, var_pop(v) AS s, count(*) AS n')}, t AS (SELECT count(*) AS t FROM embeddings), l AS (SELECT vec_id, c.label AS comp, ln(max(n) / max(t)) - 0.5 * sum(ln(2 * pi() * s) + pow(v - m, 2) / s) AS l FROM e JOIN c USING (k), t GROUP BY 1, 2), m AS (SELECT vec_id, max(l) AS m FROM l GROUP BY 1) SELECT vec_id, round(max(m) + ln(sum(exp(l - m))), 3) AS log_density, arg_max(comp, l) AS comp FROM l JOIN m USING (vec_id) GROUP BY 1")
add("gmm_kl", lambda s, d: rounded(vec.gmm_kl(vec.class_gaussians(table(s, d, "embeddings"), "embedding", "label")), 3), f"WITH {E.replace('avg(v) AS m', 'avg(v) AS m, var_pop(v) AS s')} SELECT a.label AS a, b.label AS b, round(0.5 * sum(a.s / b.s + pow(a.m - b.m, 2) / b.s - 1 + ln(b.s / a.s)), 3) AS kl FROM c a JOIN c b USING (k) WHERE a.label <> b.label GROUP BY 1, 2")


def _relative(spark: SparkSession, sf: str) -> DataFrame:
    """Samples with t in thousands of seconds since the recording's first."""
    return samples(spark, sf).withColumn("t", (F.col("t") - F.min("t").over(win.REC())) / 1000)


def _ship_days(spark: SparkSession, sf: str) -> DataFrame:
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date"))
    return table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("rec_id"), day.alias("seq")).distinct()


def _spectra(spark: SparkSession, sf: str) -> DataFrame:
    """Distances of eight samples in a row, as a spectrum, to the eight one later."""
    p = samples(spark, sf).withColumn("b", F.lead("x", 1, 50.0).over(win.SEQ()) + 2).groupBy("rec_id", F.floor(F.col("seq") / 8).alias("g")).agg(F.sort_array(F.collect_list(F.struct("seq", (F.col("x") + 1).alias("a"), "b"))).alias("p"))
    a, b = F.col("p.a"), F.col("p.b")
    return p.where(F.size("p") == 8).select("rec_id", "g", scales.dist_is(a, b).alias("itakura_saito"), scales.dist_itakura(a, b).alias("itakura"), scales.dist_cosh(a, b).alias("cosh"))


# recursions over recordings, by recursive SQL
# values of few decimals lie half way between two roundings; 1e-9 more, in both, and the sums' last bits don't decide
add("ema", lambda s, d: rounded(win.ema(samples(s, d), 0.7).withColumn("ema", F.col("ema") + 1e-9), 6), f"WITH RECURSIVE {S}, r AS (SELECT rec_id, seq, 0.3::DOUBLE * x AS ema FROM s WHERE seq = 0 UNION ALL SELECT s.rec_id, s.seq, 0.7::DOUBLE * r.ema + 0.3::DOUBLE * s.x FROM r JOIN s ON s.rec_id = r.rec_id AND s.seq = r.seq + 1) SELECT rec_id, seq, round(ema + 1e-9, 6) AS ema FROM r")
add(
    "group_events", lambda s, d: sig.group_events(samples(s, d).withColumn("event", F.col("x") > 60), 12, 4),
    f"""WITH RECURSIVE {S}, n AS (SELECT rec_id, count(*) AS n FROM s GROUP BY 1), ev AS (SELECT rec_id, seq + 1 AS loc FROM s WHERE x > 60 QUALIFY seq < max(seq) OVER (PARTITION BY rec_id)),
    nx AS (SELECT e.rec_id, e.loc, min(f.loc) FILTER (f.loc > e.loc + 12) AS nxt, max(f.loc) FILTER (f.loc <= e.loc + 12) AS last FROM ev e JOIN ev f ON f.rec_id = e.rec_id AND f.loc >= e.loc GROUP BY 1, 2),
    a AS (SELECT rec_id, min(loc) AS loc FROM ev GROUP BY 1 UNION ALL SELECT a.rec_id, nx.nxt FROM a JOIN nx USING (rec_id, loc) WHERE nx.nxt IS NOT NULL),
    g AS (SELECT rec_id, CASE WHEN last - loc + 2 > 4 THEN loc ELSE floor(loc - (4 - (last - loc)) / 2.0) END AS lo, CASE WHEN last - loc + 2 > 4 THEN last ELSE least(n, ceil(last + (4 - (last - loc)) / 2.0)) END AS hi FROM a JOIN nx USING (rec_id, loc) JOIN n USING (rec_id))
    SELECT rec_id, CAST(lo - 1 AS BIGINT) AS "begin", CAST(hi - 1 AS BIGINT) AS "end" FROM g WHERE lo > 0""",
)
add(
    "min_run", lambda s, d: audio.min_run(win.label_runs(samples(s, d).withColumn("label", (F.col("x") > 40).cast("int"))), {0: 4, 1: 3}, 1),
    f"""WITH {S}, b AS (SELECT rec_id, seq, CAST(x > 40 AS INTEGER) AS label FROM s), c AS (SELECT *, sum(ch) OVER (PARTITION BY rec_id ORDER BY seq) AS run FROM (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY rec_id ORDER BY seq) THEN 1 ELSE 0 END AS ch FROM b)),
    r AS (SELECT rec_id, run, any_value(label) AS label, min(seq) AS lo, max(seq) AS hi FROM c GROUP BY 1, 2), k AS (SELECT *, last_value(CASE WHEN hi - lo + 1 >= CASE label WHEN 0 THEN 3 ELSE 2 END OR lo = 0 THEN label END IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY lo) AS own FROM r),
    m AS (SELECT *, sum(ch) OVER (PARTITION BY rec_id ORDER BY lo) AS run2 FROM (SELECT *, CASE WHEN own IS DISTINCT FROM lag(own) OVER (PARTITION BY rec_id ORDER BY lo) THEN 1 ELSE 0 END AS ch FROM k)) SELECT rec_id, min(lo)::BIGINT AS "begin", max(hi)::BIGINT AS "end", any_value(own) AS label FROM m GROUP BY rec_id, run2""",
)

# clustering that loses no centre: an eleventh centre begins where no row is
FAR = "WITH {e}, c0 AS (SELECT label, k, m FROM c UNION ALL SELECT 10, k, 1000.0 FROM (SELECT DISTINCT k FROM c)), {rounds} SELECT CAST(label AS INTEGER) AS center, CAST(k AS INTEGER) AS k, round(m, 4) + 0.0 AS m FROM c3"
MOVED = (
    "d{i} AS (SELECT vec_id, c{i}.label AS center, sum(pow(v - m, 2)) AS d FROM e JOIN c{i} USING (k) GROUP BY 1, 2), n{i} AS (SELECT vec_id, arg_min(center, d) AS center, min(d) AS d FROM d{i} GROUP BY 1), "
    "u{i} AS (SELECT label, row_number() OVER (ORDER BY label) AS r FROM (SELECT DISTINCT label FROM c{i}) WHERE label NOT IN (SELECT center FROM n{i})), f{i} AS (SELECT vec_id, row_number() OVER (ORDER BY d DESC, vec_id) AS r FROM n{i} WHERE d > 0), "
    "c{j} AS (SELECT center AS label, k, avg(v) AS m FROM e JOIN n{i} USING (vec_id) GROUP BY 1, 2 UNION ALL SELECT u.label, k, v FROM u{i} u JOIN f{i} f USING (r) JOIN e USING (vec_id))"
)


def _with_a_far_centre(spark: SparkSession, sf: str) -> DataFrame:
    c = vec.class_means(table(spark, sf, "embeddings"), "embedding", "label")
    return c.unionByName(c.limit(1).select(F.lit(10).cast(c.schema["center"].dataType).alias("center"), F.transform("mean", lambda v: F.lit(1000.0)).alias("mean")))


add("kmeans_moved", lambda s, d: rounded(vec.kmeans(table(s, d, "embeddings"), _with_a_far_centre(s, d), "vec_id", "embedding", 3).select(F.col("center").cast("int").alias("center"), F.posexplode("mean").alias("k", "m")), 4), FAR.format(e=E, rounds=", ".join(MOVED.format(i=i, j=i + 1) for i in range(3))))


def _utterances(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("file"), F.col("role").alias("speaker"), F.greatest(F.length("text"), F.lit(1)).cast("bigint").alias("length"))


def _mixed(spark: SparkSession, sf: str) -> DataFrame:
    """As many turns as there are utterances."""
    pool = _utterances(spark, sf)
    return readers.mix_tracks(pool, pool.count())


add(
    "mix_tracks", _mixed,
    """WITH u AS (SELECT conv_id * 1000 + turn AS file, role AS speaker, greatest(length(text), 1) AS length FROM conversations), p AS (SELECT *, row_number() OVER (ORDER BY speaker, file) AS k FROM u),
    sp AS (SELECT speaker, min(k) AS first, count(*) AS files, row_number() OVER (ORDER BY speaker) AS s FROM p GROUP BY speaker), t AS (SELECT unnest(range(1, (SELECT count(*) + 1 FROM u))) AS turn),
    d AS (SELECT turn, ('0x' || substr(md5('speaker:' || turn || ':0'), 1, 15))::BIGINT % (SELECT count(*) FROM sp) + 1 AS s, ('0x' || substr(md5('file:' || turn || ':0'), 1, 15))::BIGINT AS f FROM t),
    j AS (SELECT turn, p.speaker, p.file, p.length FROM d JOIN sp USING (s) JOIN p ON p.k = sp.first + d.f % sp.files)
    SELECT turn, speaker, file, length, sum(length) OVER (ORDER BY turn)::BIGINT - length + 1 AS "begin", sum(length) OVER (ORDER BY turn)::BIGINT AS "end" FROM j""",
)


def _drawn(spark: SparkSession, sf: str) -> DataFrame:
    """As many draws of event types as there are events, each type as likely as it is frequent."""
    counts = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return rel.sample_weighted(counts, "event_type", "n", table(spark, sf, "events").count())


add("sample_weighted", _drawn, "WITH c AS (SELECT event_type, sum(n) OVER (ORDER BY event_type) AS hi, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)), t AS (SELECT unnest(range(0, (SELECT count(*) FROM events))) AS draw), d AS (SELECT draw, ('0x' || substr(md5('draw:' || draw || ':0'), 1, 13))::BIGINT::DOUBLE / pow(16, 13) * (SELECT sum(n) FROM c) AS u FROM t) SELECT draw, event_type FROM d JOIN c ON u >= hi - n AND u < hi")
add("window_weights", lambda s, d: rounded(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(ag.window_weights("hamming", 8), F.col("l_linenumber").cast("int")).alias("w")), 6), "SELECT l_orderkey, l_linenumber, round(0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * (l_linenumber - 1) / 8), 6) AS w FROM lineitem")


def _cut(spark: SparkSession, sf: str) -> DataFrame:
    """Samples 5 to 25 of each recording, out of chunks of ten samples."""
    chunks = samples(spark, sf).groupBy("rec_id", F.floor(F.col("seq") / 10).alias("chunk_id")).agg(F.sort_array(F.collect_list(F.struct("seq", "x"))).alias("a")).select("rec_id", "chunk_id", F.col("a.x").alias("pcm"))
    segs = samples(spark, sf).select("rec_id").distinct().select("rec_id", F.lit(5).alias("begin"), F.lit(25).alias("end"), F.lit(1).alias("label"))
    return iv.cut_segments(chunks, segs, 10).select("rec_id", "part", F.posexplode("pcm").alias("k", "x"))


add("cut_segments", _cut, f"WITH {S} SELECT rec_id, seq // 10 AS part, CAST(CASE WHEN seq < 10 THEN seq - 5 ELSE seq % 10 END AS INTEGER) AS k, x FROM s WHERE seq BETWEEN 5 AND 25")
add("subject_table", lambda s, d: readers.build_subject_table(*(samples(s, d).select("rec_id", "seq", c) for c in ("x", "t", "label")), samples(s, d).select("rec_id", "seq", (F.col("x") * 2).alias("resp"))), f"WITH {S} SELECT rec_id, seq, x, t, label, x * 2 AS resp FROM s")


# without SQL: solutions of equations, recursions over arrays and iterations that it can't express; tests hold them against plain re-computations
def _frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of eight samples as spectra of five bins."""
    v = samples(spark, sf).groupBy("rec_id", F.floor(F.col("seq") / 8).alias("seq")).agg(F.sort_array(F.collect_list(F.struct(F.col("t").alias("k"), "x"))).alias("a")).where("size(a) = 8")
    return v.select("rec_id", "seq", F.col("a.x").alias("v")).withColumn("power", sig.power_spectrum("v"))


def _likelihoods(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("x")
    return samples(spark, sf).select("rec_id", "seq", F.array(*(-(x - m) * (x - m) / 800 for m in (20.0, 50.0, 90.0))).alias("loglik"))


def _stress(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions for a fifth of the recordings of whether most of their samples are over 50, from their mean, deviation and range."""
    f = samples(spark, sf).groupBy("rec_id").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), (F.max("x") - F.min("x")).alias("r"), (F.avg((F.col("x") > 50).cast("double")) > 0.4).cast("double").alias("label"))
    d = rel.folds(f, "rec_id", 5)
    return models.train_stress(d.where("fold != 0"), features=("m", "s", "r")).transform(d.where("fold = 0")).select("rec_id", "label", "prediction")


def _directions(spark: SparkSession, sf: str) -> DataFrame:
    m = models.lda_fit(table(spark, sf, "embeddings"), "embedding", "label", 2)
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], "place int, first double, second double")


QUERIES |= {
    "resample_spline": lambda s, d: sig.resample_spline(samples(s, d).withColumn("t", F.col("seq") / 4.0), 10.0),
    "resample_makima": lambda s, d: sig.resample_makima(samples(s, d).withColumn("t", F.col("seq") / 4.0), 10.0),
    "lowpass_zero_phase": lambda s, d: sig.lowpass_zero_phase(samples(s, d), 50.0, 5.0),
    "detrend_priors": lambda s, d: sig.detrend_priors(samples(s, d), 20.0),
    "outlier_repair": lambda s, d: sig.outlier_repair(samples(s, d), 16),
    "viterbi": lambda s, d: sig.viterbi(_likelihoods(s, d), 5),
    "noise_minstat": lambda s, d: audio.noise_minstat(_frames(s, d)),
    "enhance": lambda s, d: audio.enhance(_frames(s, d)),
    "vad": lambda s, d: audio.vad(_frames(s, d)),
    "swt_band": lambda s, d: audio.swt_band(samples(s, d), (1, 2)),
    "find_peaks_apart": lambda s, d: win.find_peaks(samples(s, d), width=5.0),
    "detect_rpeaks": lambda s, d: audio.detect_rpeaks(samples(s, d), 50.0),
    "active_level": lambda s, d: audio.active_level(samples(s, d), 20.0),
    "fit_gmm": lambda s, d: mixtures.fit_gmm(table(s, d, "embeddings").select("label", F.slice("embedding", 1, 4).alias("v")), "label", "v", [2]),
    "train_stress": _stress,
    "lda_fit": _directions,
}
