"""Data-parallel training by parameter averaging.

The training rows are dealt into a fixed number of shards once and pinned there.
Each epoch is one job: every shard runs mini-batch Adam from the broadcast state
over its rows as they stream by, and the shard results are averaged, weighted by
rows. The average is taken on the executors, piece by piece of the parameter
vector, so the driver only receives one state whatever the number of shards.
With one shard this is ordinary mini-batch Adam.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halosift.models.nets import Adam, Net
from halosift.models.score import matrix
from halosift.session import pin_partitions
from halosift.sources.catalogue import quoted
from halosift.sources.runs import FIRST_THRESHOLD, RunStore, best_checkpoint, metric_row, params_row, state_row

# Usual batch size, early stopping, and the number of area thresholds while training.
BATCH_ROWS = 100
STOP_MIN_DELTA, STOP_FROM_EPOCH = 1e-6, 80
AREA_THRESHOLDS = 200
LOSS_FLOOR = 1e-7

PIECE = 8192  # parameters that travel in one row
PIECES_SCHEMA = "piece int, shard int, values array<double>"
METRICS = -1  # piece number of the metric sums


def pin_shards(
    df: DataFrame, classes: Sequence[int], shards: int, key: Sequence[str] | None = None
) -> DataFrame:
    """Rows (x, y) dealt into ``shards`` partitions and written to the shared folder.

    ``y`` is the index of the label among the sorted classes; a row of another
    label is refused, and so is a missing or infinite input. The deal is by a hash
    of the key and the whole row, so a key with many rows is spread; rows that are
    equal in all that are counted first and their copies dealt apart. It depends on
    the rows only. Without a key it is by the row alone.
    """
    ordered = sorted(classes)
    index = F.array_position(F.array(*[F.lit(c).cast("bigint") for c in ordered]), F.col("label").cast("bigint"))
    named = [F.col(quoted(k)).alias(f"_k{n}") for n, k in enumerate(key or [])]
    whole = [f"_k{n}" for n in range(len(named))]
    rows = df.select(*named, "x", (F.nullif(index, F.lit(0)) - 1).cast("int").alias("y"))
    rows = rows.groupBy(*whole, "x", "y").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))))
    rows = rows.withColumn("_place", F.xxhash64(*whole, "x", "y", "_copy"))
    dealt = rows.repartition(shards, "_place").sortWithinPartitions("_place").select("x", "y")
    pinned = pin_partitions(dealt)
    bad = pinned.agg(
        F.count_if(F.col("y").isNull()).alias("other"),
        F.count_if(F.expr("x IS NULL OR exists(x, v -> v IS NULL OR isnan(v) OR abs(v) = double('Infinity'))")).alias("holes"),
    ).first()
    if bad["other"]:
        raise ValueError(f"{bad['other']} training rows have a label outside {ordered}; select the classes first")
    if bad["holes"]:
        raise ValueError(f"{bad['holes']} training rows have missing features; drop them first (or infinite ones)")
    return pinned


def _batches(stream: Iterator[pa.RecordBatch], width: int, rng, size: int = BATCH_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Mini-batches in an order shuffled within what arrives together."""
    rest_x, rest_y = np.zeros((0, width)), np.zeros(0, dtype=int)
    for batch in stream:
        x, y = matrix(batch.column(0), width), batch.column(1).to_numpy()
        order = rng.permutation(len(y)) if rng else np.arange(len(y))
        x, y = np.concatenate([rest_x, x[order]]), np.concatenate([rest_y, y[order]])
        whole = len(y) - len(y) % size
        for at in range(0, whole, size):
            yield x[at:at + size], y[at:at + size]
        rest_x, rest_y = x[whole:], y[whole:]
    if len(rest_y):
        yield rest_x, rest_y


def metric_sums(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    """[rows, loss, correct, positives by score bucket..., negatives by score bucket...]."""
    own = np.clip(p[np.arange(len(y)), y], LOSS_FLOOR, None)
    buckets = AREA_THRESHOLDS - 1
    at = np.clip(np.ceil(p * buckets).astype(int) - 1, 0, buckets - 1)
    at[np.arange(len(y)), y] += buckets
    counts = np.bincount(at.ravel(), minlength=2 * buckets)
    return np.concatenate([
        [len(y), -np.log(own).sum(), (p.argmax(axis=1) == y).sum()], counts[buckets:], counts[:buckets],
    ])


SUMMED_ROWS = 1 << 14  # rows whose metrics are summed, or whose gradient is taken, at once


class MetricSums:
    """`metric_sums` of many small batches, taken over ``SUMMED_ROWS`` rows at a time."""

    def __init__(self, classes: int):
        self.total = metric_sums(np.zeros((0, classes)), np.zeros(0, dtype=int))
        self.p, self.y, self.rows = [], [], 0

    def add(self, p: np.ndarray, y: np.ndarray) -> None:
        self.p.append(p)
        self.y.append(y)
        self.rows += len(y)
        if self.rows >= SUMMED_ROWS:
            self.flush()

    def flush(self) -> np.ndarray:
        if self.rows:
            self.total = self.total + metric_sums(np.concatenate(self.p), np.concatenate(self.y))
            self.p, self.y, self.rows = [], [], 0
        return self.total


def metrics_from(sums: np.ndarray) -> dict[str, float]:
    """Loss, accuracy and area (by thresholds, over all (row, class) entries)."""
    buckets = AREA_THRESHOLDS - 1
    pos, neg = sums[3:3 + buckets], sums[3 + buckets:]
    tpr = np.concatenate([[0], np.cumsum(pos[::-1])]) / max(pos.sum(), 1)
    fpr = np.concatenate([[0], np.cumsum(neg[::-1])]) / max(neg.sum(), 1)
    area = float(((fpr[1:] - fpr[:-1]) * (tpr[1:] + tpr[:-1]) / 2).sum())
    n = max(sums[0], 1)
    return {"loss": sums[1] / n, "accuracy": sums[2] / n, "auc": area}


def _pieces(number: int, shard: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number], pa.int32()),
            pa.array([shard], pa.int32()),
            pa.array([values], pa.list_(pa.float64())),
        ],
        names=["piece", "shard", "values"],
    )


def _total(pieces: DataFrame, tasks: int) -> dict[int, np.ndarray]:
    """Sum of the rows of each piece, taken on the executors in shard order. What
    reaches the driver is one row per piece: the size of the model."""

    def add(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = None, None
        for batch in stream:
            for row in range(batch.num_rows):
                piece = batch.column(0)[row].as_py()
                values = batch.column(2)[row].values.to_numpy()
                if piece == number:
                    total = total + values
                    continue
                if number is not None:
                    yield _pieces(number, 0, total)
                number, total = piece, values
        if number is not None:
            yield _pieces(number, 0, total)

    summed = pieces.repartition(tasks, "piece").sortWithinPartitions("piece", "shard").mapInArrow(
        add, PIECES_SCHEMA
    )
    table = summed.toArrow()
    if not table.num_rows:
        raise ValueError("there are no rows to train or evaluate on")
    return {
        piece.as_py(): values.values.to_numpy()
        for piece, values in zip(table.column("piece"), table.column("values"))
    }


def train_epoch(
    rows: DataFrame, net: Net, state: Adam, seed: int, epoch: int, shuffle: bool = True, batch_rows: int = BATCH_ROWS
):
    """(next state, train metrics) after one pass of every shard over its rows."""
    vector = np.concatenate([state.params, state.first, state.second, [state.steps]])
    shared = rows.sparkSession.sparkContext.broadcast(vector)
    n, width = net.n_params, net.n_inputs

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        rng = np.random.default_rng([seed, epoch, shard]) if shuffle else None
        start = shared.value
        mine = Adam(start[:n].copy(), start[n:2 * n].copy(), start[2 * n:3 * n].copy(), float(start[-1]))
        seen, batches = MetricSums(net.classes), net.batches()
        for x, y in _batches(stream, width, rng, batch_rows):
            p, grad = batches.gradient(mine.params, x, y)
            seen.add(p, y)
            mine.step(grad)
        sums = seen.flush()
        if not sums[0]:  # no rows in this shard
            return
        out = np.concatenate([mine.params, mine.first, mine.second, [mine.steps]]) * sums[0]
        for k in range(0, len(out), PIECE):
            yield _pieces(k // PIECE, shard, out[k:k + PIECE])
        yield _pieces(METRICS, shard, sums)

    pieces = rows.mapInArrow(run, PIECES_SCHEMA)
    count = -(-len(vector) // PIECE)
    total = _total(pieces, min(count + 1, 64))
    shared.destroy()
    sums = total[METRICS]
    out = np.concatenate([total[k] for k in range(count)]) / sums[0]
    after = Adam(out[:n].copy(), out[n:2 * n].copy(), out[2 * n:3 * n].copy(), float(out[-1]))
    return after, metrics_from(sums)


def evaluate(rows: DataFrame, net: Net, params: np.ndarray) -> dict[str, float]:
    """Metrics of (x, y) rows: one sum per task, added on the executors."""
    shared = rows.sparkSession.sparkContext.broadcast(np.asarray(params, dtype=float))
    width = net.n_inputs

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = 0.0
        for batch in stream:
            p = net.predict(shared.value, matrix(batch.column(0), width))
            sums = sums + metric_sums(p, batch.column(1).to_numpy())
        if np.ndim(sums):
            yield _pieces(METRICS, TaskContext.get().partitionId(), sums)

    total = _total(rows.mapInArrow(run, PIECES_SCHEMA), 1)
    shared.destroy()
    return metrics_from(total[METRICS])


@dataclass(frozen=True)
class Trained:
    run: str
    net: Net
    params: np.ndarray  # of the best checkpoint
    epochs: int
    store: RunStore


def train(
    fit_rows: DataFrame,
    validation_rows: DataFrame,
    net: Net,
    store: RunStore,
    run: str,
    epochs: int,
    seed: int = 43,
    save_best: bool = True,
    early_stop: bool = False,
    start: np.ndarray | None = None,
    batch_rows: int = BATCH_ROWS,
    resume: bool = False,
) -> Trained:
    """Train on pinned (x, y) rows and keep history and improving checkpoints.

    Without ``save_best`` only the last state is kept. Early stopping ends at the
    first epoch, from epoch 80 on, that does not improve the validation loss.
    History, checkpoint and state of an epoch are saved together; ``resume`` goes on after the
    last one that the run's log holds.
    """
    if epochs < 1:
        raise ValueError("training needs at least one epoch")
    state = Adam.begin(net.initial(seed) if start is None else np.asarray(start, dtype=float))
    best, stop_best, done, held = FIRST_THRESHOLD, float("inf"), 0, {"loss": float("inf")}
    before = store.state(run) if resume else None
    if before:
        done, best, stop_best, n = before["epoch"], before["best"], before["stop_best"], net.n_params
        vector = np.array(before["vector"])
        state, held = Adam(vector[:n], vector[n:2 * n], vector[2 * n:3 * n], float(vector[-1])), {"loss": before["val_loss"]}
    else:
        store.start(run)
    for epoch in range(done, epochs):
        state, seen = train_epoch(fit_rows, net, state, seed, epoch, batch_rows=batch_rows)
        held = evaluate(validation_rows, net, state.params)
        done = epoch + 1
        rows = [metric_row(done, m, seen[m], held[m]) for m in seen]
        if save_best and held["loss"] < best:
            best = held["loss"]
            rows.append(params_row(done, best, state.params))
        stop = early_stop and epoch >= STOP_FROM_EPOCH and held["loss"] >= stop_best - STOP_MIN_DELTA
        if early_stop and epoch >= STOP_FROM_EPOCH and not stop:
            stop_best = held["loss"]
        vector = np.concatenate([state.params, state.first, state.second, [state.steps]])
        store.append(run, [*rows, state_row(done, best, stop_best, held["loss"], vector)])
        if stop:
            break
    if not save_best:
        store.save_checkpoint(run, done, held["loss"], state.params)
    chosen = best_checkpoint(store.checkpoints(run)).first()
    if chosen is None:
        raise RuntimeError(f"no epoch of {run} brought the validation loss below {FIRST_THRESHOLD}")
    return Trained(run, net, np.array(chosen["params"]), done, store)
