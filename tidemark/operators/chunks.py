"""Recursions and transforms over recordings of any length, in chunks.

A recording's rows (rec_id, seq, ...) are cut into chunks by seq; a chunk is a group of its own and so a task's work, whatever share of all rows its recording holds. What
passes from chunk to chunk goes one of three ways, each exact:

* with_halo: a chunk gets copies of its neighbours' rows, as far as they matter (interpolation; solutions whose influence dies out).
* linear_scan: a linear recursion's chunk is an affine map of the state that enters it. Each chunk's map comes from a pass over its rows from a zero state; maps are
  composed over a recording's chunks (a row each); a second pass over the rows starts from the right states.
* fixpoint: for any other recursion. All chunks run from a guess at once; those that another state enters than they ran from run again, all at once, until none does.
  Recursions that forget are done after two rounds; none takes more rounds than a recording has chunks.

by_many serves tables of many short recordings: a call takes many whole chunks, and nothing passes between them.

Tables between rounds have a row a chunk and are written to the shared folder. seq counts a recording's rows one by one; it need not begin at 0.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import cut

#: Rows of a chunk.
CHUNK = 1 << 16
#: Samples that a linear recursion takes in one matrix product.
BLOCK = 64
#: Rows of short chunks that a task takes into one call.
TOGETHER = 1 << 17


def chunked(df: DataFrame, size: int) -> DataFrame:
    return df.withColumn("chunk", F.floor(F.col("seq") / size).cast("bigint"))


def with_halo(df: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """Rows with chunk and own (whether they lie in the chunk); a chunk also has the `before` rows before its own and the `after` rows after them."""
    first, last = F.floor((F.col("seq") - after) / size), F.floor((F.col("seq") + before) / size)
    d = df.withColumn("chunk", F.explode(F.sequence(first, last)))
    return d.withColumn("own", F.col("chunk") == F.floor(F.col("seq") / size))


def extent(df: DataFrame, *more) -> DataFrame:
    """(rec_id, _first, _n, ...): where a recording's seq begins, and its number of rows."""
    return df.groupBy("rec_id").agg(F.min("seq").alias("_first"), F.count("*").alias("_n"), *more)


def key_type(df: DataFrame) -> str:
    return df.schema["rec_id"].dataType.simpleString()


def per_chunk(rows: DataFrame, run, added: str) -> DataFrame:
    """(rec_id, *added) from run(a chunk's rows by seq) -> DataFrame without rec_id, or None."""
    empty = [a.split()[0] for a in added.split(", ")]

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        out = run(pdf) if "own" not in pdf or pdf["own"].any() else None
        if out is None:
            return pd.DataFrame(columns=["rec_id", *empty])
        out.insert(0, "rec_id", pdf["rec_id"].iloc[0])
        return out

    return rows.groupBy("rec_id", "chunk").applyInPandas(group, f"rec_id {key_type(rows)}, {added}")


def by_many(rows: DataFrame, run) -> DataFrame:
    """(rec_id, chunk, seq, x) from run(x of some whole chunks by seq, one chunk after another; where each begins) -> as many values. Short chunks share a call, since a
    call for each would cost more than its rows; a task holds TOGETHER rows and a chunk."""
    first = F.row_number().over(Window.partitionBy("rec_id", "chunk").orderBy("seq")) == 1
    rows = rows.select("rec_id", "chunk", "seq", F.col("x").cast("double").alias("x"), first.alias("_first")).sortWithinPartitions("rec_id", "chunk", "seq")

    def call(held):
        t = pa.Table.from_batches(held)
        y = run(t["x"].to_numpy(), np.flatnonzero(t["_first"].to_numpy()))
        return t.drop_columns("_first").set_column(3, "x", pa.array(y, from_pandas=True)).to_batches()

    def task(batches):
        held, n = [], 0
        for batch in batches:
            begins = np.flatnonzero(batch.column("_first").to_numpy(zero_copy_only=False))
            if n + batch.num_rows >= TOGETHER and len(begins) and n + begins[-1]:
                yield from call([*held, batch.slice(0, begins[-1])])
                held, n, batch = [], 0, batch.slice(begins[-1])
            held.append(batch)
            n += batch.num_rows
        if n:
            yield from call(held)

    kind = rows.schema["seq"].dataType.simpleString()
    return rows.mapInArrow(task, f"rec_id {key_type(rows)}, chunk bigint, seq {kind}, x double")


def one_chunk_each(rows: DataFrame) -> bool:
    """Whether no recording has more than one chunk: then nothing passes between chunks."""
    own = rows.where("own") if "own" in rows.columns else rows
    return own.groupBy("rec_id").agg(F.max("chunk").alias("a"), F.min("chunk").alias("b")).where("a > b").isEmpty()


class Linear:
    """s = A s(-1) + b u, y = c . s + d u: a recursion of few states."""

    def __init__(self, a, b, c, d: float = 0.0):
        self.a, self.b, self.c, self.d = np.atleast_2d(np.asarray(a, float)), np.asarray(b, float), np.asarray(c, float), float(d)
        p = [np.linalg.matrix_power(self.a, j) for j in range(BLOCK + 1)]
        h = np.array([self.c @ x @ self.b for x in p[:BLOCK]])
        lag = np.arange(BLOCK)[:, None] - np.arange(BLOCK)
        self.answer = np.where(lag >= 0, h[np.maximum(lag, 0)], 0.0) + self.d * np.eye(BLOCK)
        self.seen = np.array([self.c @ x for x in p[1:]])
        self.gather = np.array([p[BLOCK - 1 - j] @ self.b for j in range(BLOCK)])
        self.step = p[BLOCK]

    def run(self, u: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs, and the state after the last input."""
        n = len(u) // BLOCK
        head, s, entered = u[: n * BLOCK].reshape(n, BLOCK), np.asarray(state, float), np.empty((n, len(self.b)))
        ends = head @ self.gather
        for i in range(n):
            entered[i] = s
            s = self.step @ s + ends[i]
        out = [(head @ self.answer.T + entered @ self.seen.T).ravel()]
        tail = np.empty(len(u) - n * BLOCK)
        for i, v in enumerate(u[n * BLOCK :].tolist()):
            s = self.a @ s + self.b * v
            tail[i] = self.c @ s + self.d * v
        return np.concatenate([*out, tail]), s

    def after(self, n: int, state: np.ndarray) -> np.ndarray:
        return np.linalg.matrix_power(self.a, n) @ state

    def steady(self, u: float) -> np.ndarray:
        """The state that a constant input ends in."""
        return np.linalg.solve(np.eye(len(self.b)) - self.a, self.b * u)


def in_series(first: Linear, second: Linear) -> Linear:
    """The recursion whose input goes through both."""
    n, m = len(first.b), len(second.b)
    a = np.zeros((n + m, n + m))
    a[:n, :n], a[n:, n:] = first.a, second.a
    a[n:, :n] = np.outer(second.b, first.c @ first.a)
    b = np.concatenate([first.b, second.b * (first.c @ first.b + first.d)])
    # the second's input is c . s + d u of the first, after its own step
    c = np.concatenate([first.c * second.d, second.c])
    return Linear(a, b, c, second.d * first.d)


def linear_scan(df: DataFrame, system: Linear, col: str = "x", out: str = "y", size: int = CHUNK, steady: bool = False, backwards: bool = False) -> DataFrame:
    """(rec_id, seq, out): the system's outputs along each recording, from a zero state or, if steady, from the state that its first input would keep; backwards from the last row on."""
    rows = chunked(df.select("rec_id", "seq", F.col(col).cast("double").alias("_u")), size)
    turn = slice(None, None, -1) if backwards else slice(None)
    zero, kind = np.zeros(len(system.b)), df.schema["seq"].dataType.simpleString()

    def whole(pdf):
        u = pdf["_u"].to_numpy()[turn]
        y, _ = system.run(u, system.steady(u[0]) if steady else zero)
        return pd.DataFrame({"seq": pdf["seq"].to_numpy(), out: y[turn]})

    if one_chunk_each(rows):
        return per_chunk(rows, whole, f"seq {kind}, {out} double")

    def summary(pdf):
        u = pdf["_u"].to_numpy()[turn]
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "_n": [len(u)], "_u0": [u[0]], "_end": [system.run(u, zero)[1]]})

    def compose(pdf):
        pdf = pdf.sort_values("chunk", ascending=not backwards)
        s, states = system.steady(pdf["_u0"].iloc[0]) if steady else zero, []
        for n, end in zip(pdf["_n"], pdf["_end"], strict=True):
            states.append(s)
            s = system.after(int(n), s) + end
        return pdf.assign(_s=states)[["rec_id", "chunk", "_s"]]

    ends = cut(per_chunk(rows, summary, "chunk bigint, _n bigint, _u0 double, _end array<double>"), "chunk-ends")
    states = cut(ends.groupBy("rec_id").applyInPandas(compose, f"rec_id {key_type(df)}, chunk bigint, _s array<double>"), "chunk-states")  # a row a chunk

    def apply(pdf, own):
        pdf = pdf.sort_values("seq")
        y, _ = system.run(pdf["_u"].to_numpy()[turn], np.asarray(own["_s"].iloc[0], float))
        return pd.DataFrame({"rec_id": pdf["rec_id"], "seq": pdf["seq"], out: y[turn]})

    return rows.groupBy("rec_id", "chunk").cogroup(states.groupBy("rec_id", "chunk")).applyInPandas(apply, f"rec_id {key_type(df)}, seq {kind}, {out} double")


def alike(a, b, tolerance: float = 1e-12) -> bool:
    """Whether two states are equal, numbers to a relative tolerance."""
    if a is None or b is None:
        return a is b
    if isinstance(a, (tuple, list)):
        return len(a) == len(b) and all(alike(x, y, tolerance) for x, y in zip(a, b, strict=True))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(alike(a[k], b[k], tolerance) for k in a)
    a, b = np.asarray(a), np.asarray(b)
    if a.shape != b.shape:
        return False
    return bool(np.array_equal(a, b)) if a.dtype.kind not in "fc" else bool(np.allclose(a, b, rtol=tolerance, atol=1e-300, equal_nan=True))


def fixpoint(rows: DataFrame, run, tolerance: float = 1e-12) -> DataFrame:
    """(rec_id, chunk, state BINARY): the state that enters each chunk. rows have chunk (and own, if a chunk has a halo); run(a chunk's rows by seq, state or None for the recording's start)
    -> (DataFrame or None, the state after its own rows). States are pickled."""
    schema = f"rec_id {key_type(rows)}, chunk bigint, state binary, after binary"

    def one(pdf, state: bytes) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        if not len(pdf) or "own" in pdf and not pdf["own"].any():
            return pd.DataFrame(columns=["rec_id", "chunk", "state", "after"])
        return pd.DataFrame({"rec_id": [pdf["rec_id"].iloc[0]], "chunk": [pdf["chunk"].iloc[0]], "state": [state], "after": [pickle.dumps(run(pdf, pickle.loads(state))[1])]})

    def follow(pdf):
        """Chunks with the state that really enters them; after is null where it isn't the one they ran from."""
        pdf = pdf.sort_values("chunk").reset_index(drop=True)
        state, after = pdf["state"].tolist(), pdf["after"].tolist()
        stale = [i > 0 and after[i - 1] != state[i] and not alike(pickle.loads(after[i - 1]), pickle.loads(state[i]), tolerance) for i in range(len(pdf))]
        return pdf.assign(state=[after[i - 1] if s else state[i] for i, s in enumerate(stale)], after=[None if s else after[i] for i, s in enumerate(stale)])

    start = pickle.dumps(None)
    if one_chunk_each(rows):
        own = rows.where("own") if "own" in rows.columns else rows
        return cut(own.select("rec_id", "chunk").distinct().withColumn("state", F.lit(start)), "chunk-states")
    now = rows.groupBy("rec_id", "chunk").applyInPandas(lambda pdf: one(pdf, start), schema)
    while True:
        now = cut(cut(now, "chunk-runs").groupBy("rec_id").applyInPandas(follow, schema), "chunk-states")  # a row a chunk
        stale = now.where("after IS NULL")
        if stale.isEmpty():
            return now.select("rec_id", "chunk", "state")
        again = rows.join(stale.select("rec_id", "chunk"), ["rec_id", "chunk"], "left_semi").groupBy("rec_id", "chunk").cogroup(stale.groupBy("rec_id", "chunk"))
        now = now.where("after IS NOT NULL").unionByName(again.applyInPandas(lambda pdf, own: one(pdf, own["state"].iloc[0]), schema))


def from_states(rows: DataFrame, states: DataFrame, run, added: str) -> DataFrame:
    """(rec_id, *added): run's rows for each chunk, from the state that enters it."""
    empty = [a.split()[0] for a in added.split(", ")]

    def group(pdf, own):
        pdf = pdf.sort_values("seq")
        out = run(pdf, pickle.loads(own["state"].iloc[0]))[0] if len(own) and len(pdf) else None
        if out is None:
            return pd.DataFrame(columns=["rec_id", *empty])
        out.insert(0, "rec_id", pdf["rec_id"].iloc[0])
        return out

    return rows.groupBy("rec_id", "chunk").cogroup(states.groupBy("rec_id", "chunk")).applyInPandas(group, f"rec_id {key_type(rows)}, {added}")


def recursion(rows: DataFrame, run, added: str, tolerance: float = 1e-12) -> DataFrame:
    """run's rows of recordings from their starts on, whatever their chunks."""
    if one_chunk_each(rows):
        return per_chunk(rows, lambda pdf: run(pdf, None)[0], added)
    return from_states(rows, fixpoint(rows, run, tolerance), run, added)
