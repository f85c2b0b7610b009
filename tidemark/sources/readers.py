"""Readers and writers of session files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import cut

PATIENT = "DeviceID STRING, PatientID INT, Gender STRING, Age INT"


def read_patients(spark: SparkSession, path: str) -> DataFrame:
    """Session metadata; the session's id is the first number in the file's name."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return spark.read.schema(PATIENT).option("header", True).csv(path).select("*", F.regexp_extract(name, "([0-9]+)", 1).cast("int").alias("session_id"))


def read_acc_text(spark: SparkSession, glob: str) -> DataFrame:
    """(exp, user, seq, x, y, z) of acc_exp<E>_user<U>.txt files, in the files' line order. A file is one recording and read whole."""
    name = F.col("_metadata.file_path")
    raw = spark.read.text(glob, wholetext=True).select(F.regexp_extract(name, "exp([0-9]+)", 1).cast("int").alias("exp"), F.regexp_extract(name, "user([0-9]+)", 1).cast("int").alias("user"), F.posexplode(F.split(F.rtrim("value"), "\r?\n")).alias("seq", "line"))
    v = F.split(F.trim("line"), "[ \t]+")
    return raw.where(F.trim("line") != "").select("exp", "user", F.col("seq").cast("bigint").alias("seq"), *(v[i].cast("double").alias(c) for i, c in enumerate("xyz")))


def read_interval_labels(spark: SparkSession, path: str) -> DataFrame:
    """(exp, user, label, begin, end, row); row is the line's place in its file, however the file is split. A label file is read whole."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), "\r?\n")).alias("row", "line")).where(F.trim("line") != "")
    v = F.split(F.trim("line"), "[ \t]+")
    names = {"exp": "int", "user": "int", "label": "int", "begin": "bigint", "end": "bigint"}
    return raw.select(*(v[i].cast(t).alias(c) for i, (c, t) in enumerate(names.items())), F.col("row").cast("bigint").alias("row"))


def read_word_times(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("begin BIGINT, end BIGINT, word STRING").option("sep", " ").csv(path)


def build_subject_table(acc: DataFrame, ecg: DataFrame, resp: DataFrame, label: DataFrame) -> DataFrame:
    """One row per sample with all signals of a subject, by (rec_id, seq)."""
    return acc.join(ecg, ["rec_id", "seq"]).join(resp, ["rec_id", "seq"]).join(label, ["rec_id", "seq"])


def write_subjects(df: DataFrame, path: str, subject: str = "rec_id") -> None:
    df.write.mode("overwrite").partitionBy(subject).parquet(path)


def load_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_features(df: DataFrame, path: str) -> None:
    """Features, or a mixture's parameters, as Parquet; what stood there is replaced."""
    df.write.mode("overwrite").parquet(path)


def save_model(model, path: str) -> None:
    """A fitted pipeline, as of train_movement(), in the format of Spark's own writer; what stood there is replaced. A KernelMachine of train_stress() has save() and load() of its own."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def wav_samples(raw: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in -1..1 and the rate, of PCM data of 8, 16, 24 or 32 bits."""
    import io
    import wave

    with wave.open(io.BytesIO(raw), "rb") as w:
        n, width, channels, rate = w.getnframes(), w.getsampwidth(), w.getnchannels(), w.getframerate()
        data = w.readframes(n)
    if width == 1:
        x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(data, f"<i{width}").astype(np.float32) / (1 << 8 * width - 1)
    return x.reshape(-1, channels).mean(axis=1), rate


def read_audio(spark: SparkSession, glob: str, chunk_s: float = 300.0) -> DataFrame:
    """(path, chunk_id, start, fs, pcm ARRAY<FLOAT>): WAV files cut in chunks."""

    def build(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, fs = wav_samples(content)
                size = int(chunk_s * fs)
                for k in range(0, max(1, -(-len(x) // size))):
                    part = x[k * size : (k + 1) * size]
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([k], pa.int32()), pa.array([k * size], pa.int64()), pa.array([fs], pa.int32()), pa.array([part], pa.list_(pa.float32()))], ["path", "chunk_id", "start", "fs", "pcm"])

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInArrow(build, "path string, chunk_id int, start bigint, fs int, pcm array<float>")


def running_total(df: DataFrame, order: str, col: Column, out: str) -> DataFrame:
    """df with the sum of col over all rows up to each in the order of a column without ties, and the columns of df: rows are dealt by ranges of order, each range sums on its own, and the sums of the ranges
    before it (a row each) are added. No task has more than a range."""
    dealt = cut(df.withColumn("_c", col).repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    parts = dealt.groupBy("_part").agg(F.sum("_c").alias("_s"))
    before = parts.alias("a").join(F.broadcast(parts.alias("b")), F.col("b._part") < F.col("a._part"), "left").groupBy(F.col("a._part").alias("_part")).agg(F.coalesce(F.sum("b._s"), F.lit(0)).alias("_before"))  # a row a range
    return dealt.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.sum("_c").over(own)).drop("_part", "_c", "_before")


def mix_tracks(utterances: DataFrame, n_turns: int, seed: int = 0) -> DataFrame:
    """(turn, speaker, file, length, begin, end) from utterances (file, speaker, length): each turn draws a speaker and then one of their files, all alike, by seeded checksums (with replacement), and turns are laid
    end to end, in samples counted from 1. No utterances, no turns."""
    own = utterances.select("file", "speaker", "length").where("file IS NOT NULL AND speaker IS NOT NULL").withColumn("_o", F.struct("speaker", "file"))
    pool = cut(running_total(own, "_o", F.lit(1), "_k").drop("_o"), "pool")
    speakers = cut(running_total(pool.groupBy("speaker").agg(F.min("_k").alias("_first"), F.count("*").alias("_files")), "speaker", F.lit(1), "_s"), "speakers")
    n = speakers.count()

    def drawn(what: str) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(what), F.col("turn"), F.lit(seed))), 1, 15), 16, 10).cast("bigint")

    turns = utterances.sparkSession.range(1, n_turns + 1).withColumnRenamed("id", "turn").withColumn("_s", F.pmod(drawn("speaker"), F.lit(max(n, 1))) + 1)
    turns = turns.join(speakers.drop("speaker"), "_s").withColumn("_k", F.col("_first") + F.pmod(drawn("file"), F.col("_files"))).select("turn", "_k")
    laid = running_total(turns.join(pool, "_k").drop("_k"), "turn", F.col("length"), "end")
    return laid.select("turn", "speaker", "file", "length", (F.col("end") - F.col("length") + 1).alias("begin"), "end")


def mixed_audio(turns: DataFrame, audio: DataFrame) -> DataFrame:
    """(turn, speaker, start, fs, pcm): the samples of mix_tracks' turns, whose files are the paths of read_audio's chunks; start is a chunk's first sample in the track, from 1. Chunks stay chunks: put in order of start they
    are the track."""
    parts = audio.select(F.col("path").alias("file"), F.col("start").alias("_at"), "fs", "pcm")
    return turns.join(parts, "file").select("turn", "speaker", (F.col("begin") + F.col("_at")).alias("start"), "fs", "pcm")
