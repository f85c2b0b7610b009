import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import aggregates, audio, signal, windows
from tidemark.streaming import streams


def played(spark, tmp_path, df, parts, build, mode="append"):
    """Rows of a stream over files of df cut by seq."""
    for a, b in parts:
        df.where(F.col("seq").between(a, b)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = build(stream).writeStream.outputMode(mode).format("memory").queryName("out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table("out").collect()


def test_state_over_batches_equals_one_pass(spark, tmp_path):
    df = spark.range(60).select((F.col("id") % 2).alias("rec_id"), (F.col("id") / 2).cast("bigint").alias("seq"), (F.abs(F.sin("id")) + 0.1).alias("x"))
    got = {(r.rec_id, r.seq): r.ema for r in played(spark, tmp_path / "a", df, [(0, 9), (10, 11), (12, 99)], lambda s: streams.stream_ema(s, 0.8))}
    want = {(r.rec_id, r.seq): r.ema for r in windows.ema(df, 0.8).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    got = {(r.rec_id, r.seq): r.running_max for r in played(spark, tmp_path / "b", df, [(0, 9), (10, 99)], lambda s: streams.stream_running_max(s, 0.9))}
    want = {(r.rec_id, r.seq): r.running_max for r in windows.moving_max(df, None, 0.9).collect()}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    power = df.withColumn("power", F.array(F.col("x"), F.col("x") * 2))
    got = {(r.rec_id, r.seq): r.noise for r in played(spark, tmp_path / "c", power, [(0, 9), (10, 99)], streams.stream_noise)}
    want = {(r.rec_id, r.seq): r.noise for r in signal.noise_mmse(power).collect()}
    assert all(np.allclose(got[k], want[k]) for k in want) and got.keys() == want.keys()

    wave = power.withColumn("v", F.array(*(F.sin(F.col("seq") * 8 + k) * F.col("x") for k in range(8)))).select("rec_id", "seq", "v", F.array(F.lit(1.0), "x", F.col("x") * 3).alias("power"))
    got = {(r.rec_id, r.seq): r.v for r in played(spark, tmp_path / "d", wave, [(0, 11), (12, 99)], streams.stream_enhance)}
    want = {(r.rec_id, r.seq): r.v for r in audio.enhance(wave.select("rec_id", "seq", "v")).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    got = {(r.rec_id, r.seq): r.p for r in played(spark, tmp_path / "e", wave, [(0, 11), (12, 99)], streams.stream_vad)}
    want = {(r.rec_id, r.seq): r.p for r in audio.vad(wave.select("rec_id", "seq", "power")).collect()}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_short_first_batches_change_nothing(spark, tmp_path):
    power = spark.range(60).select((F.col("id") % 2).alias("rec_id"), (F.col("id") / 2).cast("bigint").alias("seq"), F.array(F.lit(1.0), F.abs(F.sin("id")) + 0.1, F.abs(F.cos("id")) + 0.1).alias("power"))
    parts = [(0, 0), (1, 2), (3, 7), (8, 12), (13, 99)]
    got = {(r.rec_id, r.seq): r.noise for r in played(spark, tmp_path / "a", power, parts, streams.stream_noise)}
    want = {(r.rec_id, r.seq): r.noise for r in signal.noise_mmse(power).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    got = {(r.rec_id, r.seq): r.p for r in played(spark, tmp_path / "b", power, parts, streams.stream_vad)}
    want = {(r.rec_id, r.seq): r.p for r in audio.vad(power).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_sliding_windows(spark, tmp_path):
    df = spark.range(40).select(F.lit(1).cast("bigint").alias("rec_id"), F.col("id").alias("seq"), F.timestamp_micros(F.col("id") * 50_000).alias("ts"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z"))
    rows = played(spark, tmp_path, df, [(0, 99)], streams.stream_acc_features, "complete")
    full = [r for r in rows if r.n == 10]
    assert len(full) == 7 and all(abs(r.body_abs_mean - (r.begin.timestamp() * 20 + 4.5 + 1)) < 1e-9 for r in full)


def test_level_so_far_ends_as_one_pass(spark, tmp_path):
    df = spark.range(4000).select((F.col("id") % 2).alias("rec_id"), F.expr("id div 2").alias("seq"), (F.sin(F.col("id") / 7.0) * F.when(F.col("id") % 1000 < 600, 1.0).otherwise(0.01) * (1 + F.col("id") % 2)).alias("x"))
    rows = played(spark, tmp_path, df, [(0, 99), (100, 1100), (1101, 1999)], lambda s: streams.stream_active_level(s, 400.0))
    got = {r.rec_id: r for r in sorted(rows, key=lambda r: r.seq)}
    want = {r.rec_id: r for r in audio.active_level(df, 400.0).collect()}
    assert got.keys() == want.keys() == {0, 1}
    assert all(got[k].seq == 1999 and abs(got[k].level_db - want[k].level_db) < 1e-9 and abs(got[k].activity - want[k].activity) < 1e-9 for k in want)


def timed(spark, n=60):
    """Two recordings, a sample a second in turn from the tenth minute on, with frames of several kinds."""
    x = F.abs(F.sin("id")) + 0.1
    d = spark.range(2 * n).select((F.col("id") % 2).alias("rec_id"), F.expr("id div 2").alias("seq"), F.timestamp_micros(F.col("id") * 1_000_000 + 600_000_000).alias("ts"), x.alias("x"), F.cos("id").alias("y"), F.sin(F.col("id") / 3).alias("z"))
    return d.withColumns({"power": F.array(F.lit(1.0), F.col("x"), F.col("x") * 3), "v": F.array(*(F.sin(F.col("seq") * 8 + k) * F.col("x") for k in range(8)))})


def late(spark, tmp_path, df, build, shuffled=True):
    """Rows of a stream whose micro-batches bring df's rows up to 20 s late and in no order, and then one row of another recording, so much later that all others are over."""
    t = F.col("ts").cast("double") - 600 + (F.pmod(F.hash("rec_id", "seq"), F.lit(20)) if shuffled else 0)
    parts = [df.where((t >= a) & (t < b)) for a, b in ((0, 10), (10, 11), (11, 45), (45, 80), (80, 1e6))]
    end = df.limit(1).withColumns({"rec_id": F.lit(99).cast("bigint"), "seq": F.lit(0).cast("bigint"), "ts": F.timestamp_micros(F.lit(10_000_000_000))})
    for p in (*parts, end):
        p.repartition(1, F.hash("seq")).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = build(stream).writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(240)
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return spark.table("late").where("rec_id < 99").collect(), states[-1]


def test_late_and_shuffled_batches_give_the_batch_result(spark, tmp_path):
    df, order = timed(spark), {"delay": "30 seconds", "expire": "5 minutes"}
    same = lambda rows, want, col: {(r.rec_id, r.seq): r[col] for r in rows}.keys() == {(r.rec_id, r.seq) for r in want} and len(rows) == len(want) and all(np.allclose({(r.rec_id, r.seq): r[col] for r in rows}[r.rec_id, r.seq], r[col], atol=1e-9) for r in want)
    cases = (("ema", lambda s: streams.stream_ema(s, 0.8, **order), windows.ema(df, 0.8)), ("noise", lambda s: streams.stream_noise(s, "minstat", **order), audio.noise_minstat(df)), ("p", lambda s: streams.stream_vad(s, **order), audio.vad(df)))
    for i, (col, build, want) in enumerate(cases):
        rows, states = late(spark, tmp_path / str(i), df, build)
        assert same(rows, want.collect(), col), col
        assert states == 1  # of the recording that has just begun


def test_samples_of_enhanced_frames_and_their_tails(spark, tmp_path):
    df = timed(spark, 40)
    rows, states = late(spark, tmp_path, df, lambda s: streams.stream_enhance_samples(s, 4, delay="30 seconds", expire="5 minutes"))
    w = np.hamming(9)[:-1] ** 0.5
    w = w / np.sqrt((w[::4] ** 2).sum())
    clean = audio.enhance(df.select("rec_id", "seq", "v")).select("rec_id", F.col("seq").alias("frame"), F.posexplode("v").alias("k", "v"))
    each = clean.withColumn("v", F.col("v") * F.element_at(F.array(*map(F.lit, w.tolist())), F.col("k") + 1))
    want = {(r.rec_id, r.seq): r.x for r in aggregates.overlap_add(each, 4).collect()}
    got = {(r.rec_id, r.seq): r.x for r in rows}
    assert got.keys() == want.keys() and len(rows) == len(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want) and states == 1


def test_recordings_shorter_than_a_start_come_out_when_they_end(spark, tmp_path):
    df = timed(spark, 3)
    rows, states = late(spark, tmp_path, df, lambda s: streams.stream_noise(s, delay="30 seconds", expire="5 minutes"))
    want = {(r.rec_id, r.seq): r.noise for r in signal.noise_mmse(df).collect()}
    assert len(rows) == 6 and all(np.allclose(r.noise, want[r.rec_id, r.seq]) for r in rows) and states == 1


def test_body_features_and_chunks_with_samples(spark, tmp_path):
    df = timed(spark, 60)
    rows, _ = late(spark, tmp_path / "a", df, lambda s: streams.stream_body_features(s, 7, 10, 4, delay="30 seconds", expire="5 minutes"))
    body = windows.split_gravity(df, 7).select("rec_id", "seq", *(F.col(f"body_{c}").alias(c) for c in "xyz"))
    want = {(r.rec_id, r.frame): r for r in aggregates.acc_features(body, 10, 4).collect()}
    got = {(r.rec_id, r.frame): r for r in rows}
    assert got.keys() == want.keys() and all(np.allclose(got[k][2:], [want[k].body_energy_ave, want[k].body_abs_mean, want[k].body_std]) for k in want)
    rows, _ = late(spark, tmp_path / "b", df, lambda s: streams.stream_chunks(s, 1, "30 seconds"))
    assert sorted((r.rec_id, [q.seq for q in r.samples]) for r in rows) == [(k, list(range(30 * i, 30 * i + 30))) for k in (0, 1) for i in (0, 1)]
    assert all(r.n == len(r.samples) == 30 for r in rows)
