"""Training of a head with any number of classes over frozen features, batch by batch.

`Head` is the last, fully connected layer of a network: the parameters it learns fit the driver, whatever the table's size. An epoch is one
barrier stage: each task streams its share of every batch, adds up gradients, losses and hits, and meets the others for their sum after each
batch; all then take the same step of Adam. So a step costs a message to and from each task, not a job, and large batches have all tasks at work.

Heads of more than `TOGETHER` parameters, and sessions with dynamic allocation, which know no barriers, make one job for each step: tasks
return rows of sums, which are added up in a tree, at most `FAN` of them by the driver, where Adam changes the parameters.

The rows of all epochs' batches are written once, sorted by batch, so an epoch, or a step that is a job, reads its own row groups only. Each epoch
deals the rows to batches in another order (`sampling.epoch_batches`). A fitted body is any function from a matrix of inputs to a matrix
of features; it is applied inside the tasks.

Two loops: `fine_tuned` evaluates after each epoch on rows held out, weighs losses by rows and keeps the best head; `prototype` runs through the
batches only, without validation, and averages the losses of batches as they are, so a short last batch weighs as much as the others.
"""

from __future__ import annotations

import json
import math
import os
import secrets
import socket
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from multiprocessing.connection import Client, Connection, Listener

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom import tables
from gridloom.operators import evaluation, sampling

Body = Callable[[np.ndarray], np.ndarray]
#: Rows of sums that are added up by one task, or by the driver.
FAN = 64
#: Parameters of a head that tasks exchange after each batch; with more, a step is a job.
TOGETHER = 1 << 15
#: Rows of a batch that are worth a task.
SHARE = 16


@dataclass
class Head:
    """Scores of classes as a linear function of features: weights (features, classes) and bias (classes)."""

    weights: np.ndarray
    bias: np.ndarray
    body: Body | None = None

    @classmethod
    def new(cls, width: int, classes: int, body: Body | None = None, seed: int = 0) -> Head:
        """Small random weights; width: of the features, behind the body if there is one."""
        bound = 1 / math.sqrt(width)
        r = np.random.default_rng(seed)
        return cls(r.uniform(-bound, bound, (width, classes)), r.uniform(-bound, bound, classes), body)

    def features(self, x: np.ndarray) -> np.ndarray:
        return self.body(x) if self.body else x

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights + self.bias

    @property
    def flat(self) -> np.ndarray:
        return np.concatenate([self.weights.ravel(), self.bias])

    def with_flat(self, values: np.ndarray) -> Head:
        n = self.weights.size
        return Head(values[:n].reshape(self.weights.shape), values[n:].copy(), self.body)

    def save(self, spark: SparkSession, path: str) -> None:
        """As one row at `path`, in place of what is there; the body is not saved."""
        row = (json.dumps(self.weights.tolist()), json.dumps(self.bias.tolist()))
        spark.createDataFrame([row], "weights string, bias string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, body: Body | None = None) -> Head:
        row = spark.read.parquet(path).first()
        return cls(np.array(json.loads(row["weights"])), np.array(json.loads(row["bias"])), body)


class Adam:
    """Moments of the gradients, and steps by them."""

    def __init__(self, size: int, rate: float = 1e-4, decay: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8) -> None:
        self.rate, self.decay, self.eps = rate, decay, eps
        self.first, self.second, self.steps = np.zeros(size), np.zeros(size), 0

    def step(self, values: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        a, b = self.decay
        self.steps += 1
        self.first = a * self.first + (1 - a) * gradient
        self.second = b * self.second + (1 - b) * gradient**2
        mean, square = self.first / (1 - a**self.steps), self.second / (1 - b**self.steps)
        return values - self.rate * mean / (np.sqrt(square) + self.eps)


def _sums(head: Head, x: np.ndarray, y: np.ndarray, gradients: bool) -> np.ndarray:
    """Rows, summed cross entropy, hits and, if asked for, summed gradients."""
    f = head.features(x)
    scores = f @ head.weights + head.bias
    shifted = scores - scores.max(axis=1, keepdims=True)
    total = np.exp(shifted).sum(axis=1)
    rows = np.arange(len(y))
    out = [len(y), (np.log(total) - shifted[rows, y]).sum(), (scores.argmax(axis=1) == y).sum()]
    if not gradients:
        return np.array(out, dtype=np.float64)
    p = np.exp(shifted) / total[:, None]
    p[rows, y] -= 1
    return np.concatenate([out, (f.T @ p).ravel(), p.sum(axis=0)])


def _matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _added(parts: DataFrame) -> np.ndarray:
    """The sum of the arrays `s`, by a tree of tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in _matrix(batch.column("s")) if batch.num_rows else ():
                total = row if total is None else total + row
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["s"])

    many = parts.rdd.getNumPartitions()
    while many > FAN:
        many = -(-many // FAN)
        parts = parts.repartition(many).mapInArrow(add, "s array<double>")
    got = [np.array(r["s"]) for r in parts.collect()]
    return np.sum(got, axis=0) if got else np.zeros(3)


def summed(rows: DataFrame, head: Head, gradients: bool = False) -> np.ndarray:
    """Rows, loss, hits and gradients of rows (x, y), each task's added up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                mine = _sums(head, _matrix(batch.column("x")), batch.column("y").to_numpy(), gradients)
                total = mine if total is None else total + mine
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["s"])

    return _added(rows.select("x", "y").mapInArrow(run, "s array<double>"))


def _inputs(rows: DataFrame, features: str, label: str, *more: str) -> DataFrame:
    """x, y and more of the rows that have both; all of x have one length."""
    return rows.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("long").alias("y"), *more).filter("x is not null and y is not null")


def _by_batch(rows: DataFrame, features: str, label: str, key: str, size: int, seed: str, epochs: int) -> DataFrame:
    """epoch, batch, x and y, as a table sorted by epoch and batch; a large batch lies in several ranges, for as many tasks."""
    d = sampling.epoch_batches(_inputs(rows, features, label, key), key, epochs, size, seed)
    d = d.repartitionByRange("epoch", "batch", F.xxhash64(key)).sortWithinPartitions("epoch", "batch")
    return tables.written(d.select("epoch", "batch", "x", "y"), "batches")


def _plain(c: Connection) -> Connection:
    """c, which sends at once."""
    with socket.socket(fileno=os.dup(c.fileno())) as s:
        s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
    return c


def _adder(context: BarrierTaskContext) -> Callable[[np.ndarray], np.ndarray]:
    """A function that each task of the stage calls as often as the others, for the sum of what they give; the first task adds, in the order of tasks."""
    hosts, me = [t.address.rsplit(":", 1)[0] for t in context.getTaskInfos()], context.partitionId()
    if len(hosts) == 1:
        return lambda mine: mine
    secret = secrets.token_hex(16)
    home = Listener(("0.0.0.0", 0), backlog=len(hosts), authkey=secret.encode()) if me == 0 else None
    port, key = context.allGather(f"{home.address[1]} {secret}" if home else "")[0].split()
    if not home:
        there = _plain(Client((hosts[0], int(port)), authkey=key.encode()))
        there.send_bytes(str(me).encode())

        def added(mine: np.ndarray) -> np.ndarray:
            there.send_bytes(mine.tobytes())
            return np.frombuffer(there.recv_bytes())

        return added
    came = [_plain(home.accept()) for _ in hosts[1:]]
    others = [came[k] for _, k in sorted((int(c.recv_bytes()), k) for k, c in enumerate(came))]

    def add(mine: np.ndarray) -> np.ndarray:
        total = mine
        for c in others:
            total = total + np.frombuffer(c.recv_bytes())
        for c in others:
            c.send_bytes(total.tobytes())
        return total

    return add


def _shares(arrow: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """batch, x and y of rows that are sorted by batch; a batch may come in several pieces."""
    for some in arrow:
        batch = some.column("batch").to_numpy()
        cuts = [0, *(np.flatnonzero(batch[1:] != batch[:-1]) + 1).tolist(), len(batch)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i < j:
                yield int(batch[i]), _matrix(some.column("x").slice(i, j - i)), some.column("y").slice(i, j - i).to_numpy()


def _slots(spark: SparkSession) -> int:
    """Tasks that run at once, 0 where their number may change."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 0
    context = spark.sparkContext._jsc.sc()
    return context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())


def _epoch(batches: DataFrame, epoch: int, last: int, head: Head, adam: Adam, size: int) -> tuple[Head, list[np.ndarray]]:
    """One step for each batch of `size` rows; the head after them, and rows, loss and hits of each batch before its step."""
    many = min(_slots(batches.sparkSession), -(-size // SHARE))
    if last < 0:
        return head, []
    if head.flat.size > TOGETHER or not many:
        return _epoch_by_jobs(batches, epoch, last, head, adam)

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        added, shares, values, now, said = _adder(context), _shares(arrow), head.flat, head, []
        share = next(shares, None)
        for batch in range(last + 1):
            mine = np.zeros(3 + values.size)
            while share and share[0] == batch:
                mine += _sums(now, *share[1:], True)
                share = next(shares, None)
            s = added(mine)
            said.append(s[:3])
            values = adam.step(values, s[3:] / s[0])
            now = head.with_flat(values)
        if context.partitionId() == 0:
            rows = [*said, np.concatenate([values, adam.first, adam.second])]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], names=["k", "s"])

    own = batches.filter(F.col("epoch") == epoch).select("batch", "x", "y").repartition(many).sortWithinPartitions("batch")
    got = [np.array(r["s"]) for r in sorted(own.mapInArrow(run, "k long, s array<double>", barrier=True).collect())]
    values, adam.first, adam.second = np.split(got[-1], 3)
    adam.steps += last + 1
    return head.with_flat(values), got[:-1]


def _epoch_by_jobs(batches: DataFrame, epoch: int, last: int, head: Head, adam: Adam) -> tuple[Head, list[np.ndarray]]:
    """The same with a job for each step."""
    values, said = head.flat, []
    for batch in range(last + 1):
        s = summed(batches.filter((F.col("epoch") == epoch) & (F.col("batch") == batch)), head, gradients=True)
        said.append(s[:3])
        values = adam.step(values, s[3:] / s[0])
        head = head.with_flat(values)
    return head, said


def fine_tuned(
    train: DataFrame, val: DataFrame, features: str, label: str, key: str, head: Head, epochs: int = 10, batch_size: int = 32, rate: float = 1e-4, seed: str = "epoch", path: str | None = None
) -> tuple[Head, DataFrame]:
    """The head with the best accuracy on val (the earliest of equals; the first head if none is over 0) and the series of epochs.

    Columns of the series: epoch, train_loss, train_acc (as the batches were met), val_loss, val_acc, best_before, improved. path: where each best head is
    saved.
    """
    spark = train.sparkSession
    batches = _by_batch(train, features, label, key, batch_size, seed, epochs)
    held = tables.written(_inputs(val, features, label), "held")
    last = batches.agg(F.max("batch")).first()[0]
    adam, best, best_head, series = Adam(head.flat.size, rate), 0.0, head, []
    for epoch in range(1, epochs + 1):
        head, said = _epoch(batches, epoch, -1 if last is None else last, head, adam, batch_size)
        n, loss, hits = np.sum(said, axis=0) if said else np.zeros(3)
        v_n, v_loss, v_hits = summed(held, head)
        accuracy = float(v_hits / max(v_n, 1))
        if accuracy > best:
            best, best_head = accuracy, head
            if path:
                head.save(spark, path)
        series.append((epoch, float(loss / max(n, 1)), float(hits / max(n, 1)), float(v_loss / max(v_n, 1)), accuracy))
    columns = "epoch int, train_loss double, train_acc double, val_loss double, val_acc double"
    return best_head, evaluation.improvements(spark.createDataFrame(series, columns))


def prototype(rows: DataFrame, features: str, label: str, key: str, head: Head, epochs: int = 5, batch_size: int = 32, rate: float = 1e-3, seed: str = "epoch") -> tuple[Head, DataFrame]:
    """The head after the last epoch, and a row for each batch: epoch, batch, n, loss. `evaluation.losses` by epoch has the loop's loss as mean_of_batches."""
    batches = _by_batch(rows, features, label, key, batch_size, seed, epochs)
    last = batches.agg(F.max("batch")).first()[0]
    adam, series = Adam(head.flat.size, rate), []
    for epoch in range(1, epochs + 1):
        head, said = _epoch(batches, epoch, -1 if last is None else last, head, adam, batch_size)
        series += [(epoch, k, int(n), float(loss / n)) for k, (n, loss, _) in enumerate(said)]
    return head, rows.sparkSession.createDataFrame(series, "epoch int, batch int, n long, loss double")


def classified(rows: DataFrame, features: str, head: Head) -> DataFrame:
    """rows with scores (array of doubles, for `scoring.softmax`) and pred, the first of the best; both null where features are."""
    kept = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = np.flatnonzero(batch.column("__x").is_valid().to_numpy(zero_copy_only=False))
            scores: list[list[float] | None] = [None] * batch.num_rows
            pred: list[int | None] = [None] * batch.num_rows
            if len(there):
                s = head.scores(_matrix(batch.column("__x").take(pa.array(there))))
                for k, row, best in zip(there.tolist(), s.tolist(), s.argmax(axis=1).tolist(), strict=True):
                    scores[k], pred[k] = row, best
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores, pa.list_(pa.float64())), pa.array(pred, pa.int32())], names=[*kept, "scores", "pred"])

    schema = T.StructType([*rows.schema.fields, T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("pred", T.IntegerType())])
    return rows.withColumn("__x", F.col(features).cast("array<double>")).mapInArrow(run, schema)
