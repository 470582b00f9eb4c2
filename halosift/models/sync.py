"""Synchronous training: every step is one step on one global batch, however many shards.

The training rows are numbered once. An epoch is an order of those numbers, and a
batch is a run of them; each shard holds some rows of every batch. In a step each
shard takes the gradient over its own rows of the batch, all shards add their
gradients up (`BarrierTaskContext.allGather`, in one barrier stage) and make the
same Adam step. So n shards train as one shard does, but for the rounding of
sums.

Several nets may be trained together: they share rows, order and batches, each on
its own columns of the input and for its own number of epochs. One scan feeds all of
them, and one exchange a step carries all their gradients.

A job covers ``epochs_per_job`` epochs; between jobs states are saved, so a lost
executor costs at most one job's epochs (a barrier stage runs anew as a whole) and
a stopped training resumes there. Jobs do not depend on the number of nets.

An exchange takes about a second, as barrier stages wait in such steps, and sends the
gradient of every shard to all shards through the driver. More than one shard
pays where a batch is much work; `train` (averages once an epoch) is for many shards and
small batches. An exchange may send ``SENT_AT_MOST`` bytes; this is checked.

Shards of at most ``HELD_AT_MOST`` bytes of inputs are held in memory. Larger tables stream by: an epoch's
rows are dealt by Spark into segments of its order, and the steps are the same ones. Batches of
``WIDE_BATCH`` rows or more are one job a step, in which all tasks take the gradient of the rows they read
and the gradients are added up on executors. Smaller ones follow each other in one task for each net, one segment a
job, and the state passes from segment to segment. So memory, and what a task reads, do
not grow with the rows.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from halosift.models.nets import Adam, DenseBatches, Net
from halosift.models.score import matrix
from halosift.models.train import (
    BATCH_ROWS,
    PIECE,
    PIECES_SCHEMA,
    STOP_FROM_EPOCH,
    STOP_MIN_DELTA,
    SUMMED_ROWS,
    MetricSums,
    Trained,
    _batches,
    _pieces,
    _total,
    metrics_from,
)
from halosift.operators.order import POSITION, in_order_of
from halosift.operators.sampling import row_hash
from halosift.session import delete, pin, pin_partitions, shared_dir
from halosift.sources.catalogue import quoted
from halosift.sources.runs import FIRST_THRESHOLD, RunStore, best_checkpoint, metric_row, params_row, state_row

EPOCHS_PER_JOB = 25
HELD_AT_MOST = 1 << 27
SENT_AT_MOST = 1 << 30
SEGMENT_ROWS = 1 << 21  # rows of a segment that one task reads
FILE_ROWS = 1 << 19  # rows of a segment's file, written by one task
WIDE_BATCH = 1 << 18
PREDICTED_ROWS = 1 << 9  # rows predicted at once: what is in between stays in a processor's cache
NETS_AT_ONCE = 12
ORDER_SEED = 47
ROWS_AT_MOST = 1 << 40

_RESULTS = "model int, epoch int, kind string, `values` array<double>"


@dataclass(frozen=True)
class Model:
    """A net to train: on which columns of ``x`` (all, if None), and how long."""

    run: str
    net: Net
    epochs: int
    columns: tuple[int, ...] | None = None
    early_stop: bool = False
    seed: int = 43
    start: tuple[float, ...] | None = None


@dataclass
class Progress:
    """What one net needs to go on."""

    adam: Adam
    epoch: int = 0
    best: float = FIRST_THRESHOLD
    stop_best: float = float("inf")
    val_loss: float = float("inf")
    stopped: bool = False

    def vector(self) -> np.ndarray:
        return np.concatenate([self.adam.params, self.adam.first, self.adam.second, [self.adam.steps]])

    @staticmethod
    def of(vector: np.ndarray, n: int, **more) -> "Progress":
        return Progress(Adam(vector[:n].copy(), vector[n:2 * n].copy(), vector[2 * n:3 * n].copy(), float(vector[-1])), **more)

    def goes_on(self, model: Model) -> bool:
        return not self.stopped and self.epoch < model.epochs


def numbered_rows(
    fit: DataFrame, held: DataFrame, classes: Sequence[int], shards: int, key: Sequence[str]
) -> DataFrame:
    """Rows (position, held, x, y) dealt into ``shards`` partitions and written to the shared folder; rows that
    are too many to be held in memory are written undealt.

    Positions follow the md5 of the seed and the key, then a hash of the whole row; rows that are
    equal in everything are counted first and told apart by their copy, so no key and no row can fill a task.
    Held rows have none. Other labels than ``classes`` and missing or infinite inputs are refused.
    """
    ordered = sorted(classes)
    index = F.array_position(F.array(*[F.lit(c).cast("bigint") for c in ordered]), F.col("label").cast("bigint"))
    names = [f"_k{n}" for n in range(len(key))]

    def plain(df: DataFrame) -> DataFrame:
        rows = df.select(*[F.col(quoted(k)).alias(n) for k, n in zip(key, names)], "x", (F.nullif(index, F.lit(0)) - 1).cast("int").alias("y"))
        rows = rows.groupBy(*names, "x", "y").agg(F.count(F.lit(1)).alias("_n"))
        rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))))
        return rows.withColumn("_place", F.xxhash64(*names, "x", "y", "_copy"))

    placed = in_order_of(plain(fit), [row_hash(ORDER_SEED, names, names), F.col("_place")])
    rows = placed.select(F.col(POSITION).alias("position"), F.lit(False).alias("held"), "x", "y").unionByName(
        plain(held).select(F.col("_place").alias("position"), F.lit(True).alias("held"), "x", "y"))
    whole = pin(rows)
    seen = whole.agg(
        *_sizes(), F.count_if("held").alias("held"), F.count_if(F.col("y").isNull()).alias("other"),
        F.count_if(F.expr("x IS NULL OR exists(x, v -> v IS NULL OR isnan(v) OR abs(v) = double('Infinity'))")).alias("holes"),
    ).first()
    if seen["other"]:
        raise ValueError(f"{seen['other']} training rows have a label outside {ordered}; select the classes first")
    if seen["holes"]:
        raise ValueError(f"{seen['holes']} training rows have missing features; drop them first (or infinite ones)")
    if not seen["fit"] or not seen["held"]:
        raise ValueError("there are no rows to train or evaluate on")
    if seen["fit"] >= ROWS_AT_MOST:
        raise ValueError(f"synchronous training numbers fewer than {ROWS_AT_MOST} rows")
    if not are_held(seen, shards):
        return whole
    return pin_partitions(whole.repartitionById(shards, F.pmod("position", F.lit(shards)).cast("int")).sortWithinPartitions("held", "position"))


def _sizes() -> list[Column]:
    return [F.count_if(~F.col("held")).alias("fit"), F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width")]


def are_held(sizes: Row, shards: int) -> bool:
    """Whether each shard of rows of these sizes is held in memory."""
    return sizes["n"] * max(sizes["width"] or 0, 1) * 8 <= HELD_AT_MOST * shards


def _order(rows: int, seed: int, epoch: int) -> tuple[int, int, int]:
    """(high, low, offset) of an epoch's factor, high * 2 ** 20 + low, and offset."""
    rng = np.random.default_rng([seed, epoch])
    factor, offset = int(rng.integers(1, rows)), int(rng.integers(rows))
    while gcd(factor, rows) != 1:
        factor = int(rng.integers(1, rows))
    return *divmod(factor, 1 << 20), offset  # products stay below 2 ** 62


def epoch_order(position: np.ndarray, rows: int, seed: int, epoch: int) -> np.ndarray:
    """Where each row stands in an epoch: a multiple of its position plus an offset, modulo the number of rows."""
    if rows < 2:
        return position
    high, low, offset = _order(rows, seed, epoch)
    return (((high * position % rows) << 20) + low * position % rows + offset) % rows


def epoch_place(rows: int, seed: int, epoch: int) -> Column:
    """`epoch_order` of the column ``position``."""
    if rows < 2:
        return F.col("position")
    high, low, offset = _order(rows, seed, epoch)
    return F.expr(f"(shiftleft({high}L * position % {rows}L, 20) + {low}L * position % {rows}L + {offset}L) % {rows}L")


class _Shard:
    """The rows a task holds, and its part in the exchange."""

    def __init__(self, stream: Iterator[pa.RecordBatch], width: int, shards: int):
        from pyspark import BarrierTaskContext

        self.context, self.shards = BarrierTaskContext.get(), shards
        position, held, x, y = [], [], [], []
        for batch in stream:
            position.append(batch.column(0).to_numpy())
            held.append(batch.column(1).to_numpy(zero_copy_only=False))
            x.append(matrix(batch.column(2), width))
            y.append(batch.column(3).to_numpy())
        out = np.concatenate(held) if held else np.zeros(0, bool)
        whole = lambda parts, none: np.concatenate(parts) if parts else none
        position, x, y = whole(position, np.zeros(0, np.int64)), whole(x, np.zeros((0, width))), whole(y, np.zeros(0, int))
        self.position, self.x, self.y = position[~out], x[~out], y[~out]
        self.held_x, self.held_y = x[out], y[out]

    @property
    def first(self) -> bool:
        return self.context.partitionId() == 0

    def total(self, vector: np.ndarray) -> np.ndarray:
        """Sum of all shards' vectors, in the order of the shards."""
        if self.shards == 1:
            return vector
        got = self.context.allGather(base64.b64encode(vector.tobytes()).decode())
        out = np.zeros_like(vector)
        for text in got:
            out = out + np.frombuffer(base64.b64decode(text))
        return out


def _inputs(x: np.ndarray, model: Model) -> np.ndarray:
    return x if model.columns is None else x[:, list(model.columns)]


def _add_gradient(net: Net | DenseBatches, params: np.ndarray, x: np.ndarray, y: np.ndarray, seen: MetricSums) -> np.ndarray:
    """Sum of the gradients of all rows, taken over ``SUMMED_ROWS`` at a time; their metrics are added to ``seen``."""
    if 0 < len(y) <= SUMMED_ROWS:
        p, grad = net.gradient(params, x, y)
        seen.add(p, y)
        grad *= len(p)
        return grad
    total = np.zeros_like(params)
    for at in range(0, len(y), SUMMED_ROWS):
        p, grad = net.gradient(params, x[at:at + SUMMED_ROWS], y[at:at + SUMMED_ROWS])
        seen.add(p, y[at:at + SUMMED_ROWS])
        grad *= len(p)
        total += grad
    return total


def _predicted_sums(net: Net, params: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    seen, batches = MetricSums(net.classes), net.batches()
    for at in range(0, len(y), PREDICTED_ROWS):
        seen.add(batches.predict(params, x[at:at + PREDICTED_ROWS]), y[at:at + PREDICTED_ROWS])
    return seen.flush()


def _epoch(shard: _Shard, models: Sequence[Model], states: Sequence[Progress], order: np.ndarray, rows: int, size: int) -> np.ndarray:
    """One pass over all batches; the models' metric sums, over all shards, train before held."""
    sort = np.argsort(order, kind="stable")
    place, x, y = order[sort], shard.x[sort], shard.y[sort]
    inputs = [_inputs(x, m) for m in models]
    cut = np.searchsorted(place, np.arange(0, rows + size, size))
    ends = np.cumsum([0] + [m.net.n_params for m in models])
    parts_of = [slice(a, b) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    seen, batches = [MetricSums(m.net.classes) for m in models], [m.net.batches() for m in models]
    for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
        parts = [_add_gradient(net, s.adam.params, own[a:b], y[a:b], so_far) for net, s, own, so_far in zip(batches, states, inputs, seen)]
        grad = shard.total(np.concatenate(parts) if len(parts) > 1 else parts[0])
        grad /= min(size, rows - k * size)
        for s, part in zip(states, parts_of):
            s.adam.step(grad[part])
    sums = []
    for m, s, so_far in zip(models, states, seen):
        sums += [so_far.flush(), _predicted_sums(m.net, s.adam.params, _inputs(shard.held_x, m), shard.held_y)]
    return shard.total(np.concatenate(sums)).reshape(2 * len(models), -1)


def _result(model: int, epoch: int, kind: str, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([model], pa.int32()), pa.array([epoch], pa.int32()), pa.array([kind]), pa.array([values], pa.list_(pa.float64()))],
        names=["model", "epoch", "kind", "values"])


Results = list[tuple[int, int, str, np.ndarray]]


def _ended(number: int, model: Model, s: Progress, train_sums: np.ndarray, held_sums: np.ndarray) -> Results:
    """What is kept of an epoch; moves ``s`` on to the next."""
    epoch = s.epoch
    s.epoch, s.val_loss = epoch + 1, metrics_from(held_sums)["loss"]
    improved = s.val_loss < s.best
    s.best = min(s.best, s.val_loss)
    if model.early_stop and epoch >= STOP_FROM_EPOCH:
        s.stopped = s.val_loss >= s.stop_best - STOP_MIN_DELTA
        s.stop_best = min(s.stop_best, s.val_loss) if not s.stopped else s.stop_best
    out = [(number, s.epoch, "train", train_sums), (number, s.epoch, "val", held_sums)]
    return [*out, (number, s.epoch, "params", np.concatenate([[s.val_loss], s.adam.params]))] if improved else out


def _last_state(number: int, s: Progress) -> tuple[int, int, str, np.ndarray]:
    return number, s.epoch, "state", np.concatenate([[s.best, s.stop_best, s.val_loss, float(s.stopped)], s.vector()])


def run_epochs(
    rows: DataFrame, models: Sequence[Model], states: Sequence[Progress], count: int, epochs: int,
    shards: int, shuffle: bool = True, batch_rows: int = BATCH_ROWS,
) -> Results:
    """One barrier job of at most ``epochs`` epochs on the ``count`` fit rows of `numbered_rows`.

    Gives (model, epoch, kind, values): ``train`` and ``val`` metric sums of each epoch, ``params`` where the
    validation loss is the best so far, and the last ``state``."""
    spark = rows.sparkSession
    sent = 2 * sum(m.net.n_params for m in models) * 8 * shards**2
    if sent > SENT_AT_MOST and shards > 1:
        raise ValueError(f"{shards} shards would send {sent} bytes a step; choose fewer, or average by epoch")
    width = len(rows.select("x").first()["x"])
    shared = spark.sparkContext.broadcast([
        (s.vector(), s.epoch, s.best, s.stop_best, s.val_loss, s.stopped) for s in states])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(stream, width, shards)
        own = [
            Progress.of(v, m.net.n_params, epoch=e, best=b, stop_best=sb, val_loss=vl, stopped=st)
            for m, (v, e, b, sb, vl, st) in zip(models, shared.value)]
        for _ in range(epochs):
            going = [i for i, (m, s) in enumerate(zip(models, own)) if s.goes_on(m)]
            if not going:
                break
            epoch = own[going[0]].epoch
            some, those = [models[i] for i in going], [own[i] for i in going]
            order = epoch_order(shard.position, count, some[0].seed, epoch) if shuffle else shard.position
            sums = _epoch(shard, some, those, order, count, batch_rows)
            for k, (i, model, s) in enumerate(zip(going, some, those)):
                for result in _ended(i, model, s, sums[2 * k], sums[2 * k + 1]):
                    if shard.first:
                        yield _result(*result)
        if shard.first:
            for i, s in enumerate(own):
                yield _result(*_last_state(i, s))

    got = rows.select("position", "held", "x", "y").mapInArrow(run, _RESULTS, barrier=True).toArrow()
    shared.destroy()
    return [(m.as_py(), e.as_py(), k.as_py(), v.values.to_numpy()) for m, e, k, v in zip(*got.columns)]


# --- rows that stream by ---------------------------------------------------------------


def _summed(rows: DataFrame, models: Sequence[Model], states: Sequence[Progress], gradients: bool) -> list[np.ndarray]:
    """For each model the metric sums of the rows, after the sum of their gradients if wanted; one
    sum for each task, added up on executors."""
    width = len(rows.select("x").first()["x"])
    shared = rows.sparkSession.sparkContext.broadcast([s.adam.params for s in states])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [MetricSums(m.net.classes) for m in models]
        total = [np.zeros(m.net.n_params) for m in models]
        for batch in stream:
            x, y = matrix(batch.column(0), width), batch.column(1).to_numpy()
            for i, (m, params) in enumerate(zip(models, shared.value)):
                if gradients:
                    total[i] += _add_gradient(m.net, params, _inputs(x, m), y, seen[i])
                else:
                    seen[i].add(m.net.predict(params, _inputs(x, m)), y)
        out = np.concatenate([v for t, s in zip(total, seen) for v in ([t] if gradients else []) + [s.flush()]])
        for k in range(0, len(out), PIECE):
            yield _pieces(k // PIECE, TaskContext.get().partitionId(), out[k:k + PIECE])

    empty = len(MetricSums(1).total)
    ends = np.cumsum([(m.net.n_params if gradients else 0) + empty for m in models])
    total = _total(rows.select("x", "y").mapInArrow(run, PIECES_SCHEMA), min(-(-int(ends[-1]) // PIECE), 64))
    shared.destroy()
    return np.split(np.concatenate([total[k] for k in sorted(total)]), ends[:-1])


def _in_sequence(segments: Sequence[DataFrame], model: Model, state: Progress, batch_rows: int) -> np.ndarray:
    """All steps of a model over the rows (place, x, y) of the segments, in the order of ``place``: one task a segment.
    Moves the state on and gives the metric sums."""
    spark, net, total = segments[0].sparkSession, model.net, MetricSums(model.net.classes).total
    width = len(segments[0].select("x").first()["x"])

    for segment in segments:
        shared = spark.sparkContext.broadcast(state.vector())

        def run(stream: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            adam, seen, batches = Progress.of(shared.value, net.n_params).adam, MetricSums(net.classes), net.batches()
            for x, y in _batches(stream, width, None, batch_rows):
                grad = _add_gradient(batches, adam.params, _inputs(x, model), y, seen)
                grad /= len(y)
                adam.step(grad)
            if adam.steps > shared.value[-1]:
                yield _result(0, 0, "sums", seen.flush())
                yield _result(0, 0, "state", Progress(adam).vector())

        got = segment.coalesce(1).sortWithinPartitions("place").select("x", "y").mapInArrow(run, _RESULTS).toArrow()
        shared.destroy()
        values = {kind.as_py(): v.values.to_numpy() for kind, v in zip(got.column("kind"), got.column("values"))}
        total, state.adam = total + values["sums"], Progress.of(values["state"], net.n_params).adam
    return total


def stream_epoch(
    rows: DataFrame, models: Sequence[Model], states: Sequence[Progress], count: int,
    shuffle: bool = True, batch_rows: int = BATCH_ROWS,
) -> Results:
    """One epoch over rows that are not held in memory; the same results as `run_epochs`."""
    spark, first = rows.sparkSession, states[0]
    place = epoch_place(count, models[0].seed, first.epoch) if shuffle else F.col("position")
    wide = batch_rows >= WIDE_BATCH
    size = batch_rows if wide else max(SEGMENT_ROWS - SEGMENT_ROWS % batch_rows, batch_rows)  # whole batches
    n, files = -(-count // size), -(-min(size, count) // FILE_ROWS)
    dealt = rows.filter("NOT held").select(place.alias("place"), "x", "y").withColumn("segment", F.expr(f"place div {size}L"))
    file = F.expr(f"segment * {files} + place % {size}L div {FILE_ROWS}L").cast("int")
    path = f"{shared_dir(spark)}/pinned/{uuid.uuid4().hex}"
    try:
        dealt.repartitionById(n * files, file).write.partitionBy("segment").parquet(path)
        dealt = spark.read.schema(dealt.schema).parquet(path)
        segments = [dealt.filter(F.col("segment") == k).select("place", "x", "y") for k in range(n)]
        if wide:
            sums = [MetricSums(m.net.classes).total for m in models]
            for k, segment in enumerate(segments):
                got = _summed(segment, models, states, gradients=True)
                for i, (m, s) in enumerate(zip(models, states)):
                    s.adam.step(got[i][:m.net.n_params] / min(size, count - k * size))
                    sums[i] = sums[i] + got[i][m.net.n_params:]
        else:  # nets do not wait for each other
            with ThreadPoolExecutor(min(len(models), NETS_AT_ONCE)) as pool:
                sums = list(pool.map(lambda m, s: _in_sequence(segments, m, s, batch_rows), models, states))
    finally:
        delete(spark, path)
    held = _summed(rows.filter("held"), models, states, gradients=False)
    results = [r for i, (m, s) in enumerate(zip(models, states)) for r in _ended(i, m, s, sums[i], held[i])]
    return results + [_last_state(i, s) for i, s in enumerate(states)]


def fit(
    rows: DataFrame, models: Sequence[Model], store: RunStore, shards: int, shuffle: bool = True,
    batch_rows: int = BATCH_ROWS, epochs_per_job: int = EPOCHS_PER_JOB, resume: bool = False,
) -> dict[str, Trained]:
    """Train all models on the rows of `numbered_rows`, with history, improving checkpoints and early
    stop as in `train`. The orders of epochs follow the first model's seed. By run name."""
    if not models or any(m.epochs < 1 for m in models):
        raise ValueError("training needs a model and at least one epoch")
    if len({m.run for m in models}) < len(models):
        raise ValueError("each model needs a run name of its own")
    states = []
    for m in models:
        before = store.state(m.run) if resume else None
        if before:
            vector = np.array(before["vector"])
            states.append(Progress.of(vector, m.net.n_params, epoch=before["epoch"], best=before["best"], stop_best=before["stop_best"],
                                      val_loss=before["val_loss"], stopped=m.early_stop and before["stop_best"] == float("-inf")))
        else:
            store.start(m.run)
            states.append(Progress(Adam.begin(m.net.initial(m.seed) if m.start is None else np.array(m.start, dtype=float))))
    sizes = rows.agg(*_sizes()).first()
    count, held_here = sizes["fit"], are_held(sizes, shards)
    while any(s.goes_on(m) for m, s in zip(models, states)):
        # models that were saved at different epochs catch up before they share an order again
        least = min(s.epoch for m, s in zip(models, states) if s.goes_on(m))
        now = [i for i, (m, s) in enumerate(zip(models, states)) if s.goes_on(m) and s.epoch == least]
        others = [s.epoch - least for m, s in zip(models, states) if s.goes_on(m) and s.epoch > least]
        span = min([epochs_per_job, *others])
        some, those = [models[i] for i in now], [states[i] for i in now]
        if held_here:
            results = run_epochs(rows, some, those, count, span, shards, shuffle, batch_rows)
        else:
            results = stream_epoch(rows, some, those, count, shuffle, batch_rows)
        for k, i in enumerate(now):
            m, mine = models[i], [r for r in results if r[0] == k]
            sums = {(e, kind): metrics_from(v) for _, e, kind, v in mine if kind in ("train", "val")}
            log = [metric_row(e, name, sums[e, "train"][name], sums[e, "val"][name])
                   for e in sorted({e for e, _ in sums}) for name in ("loss", "accuracy", "auc")]
            log += [params_row(e, v[0], v[1:]) for _, e, kind, v in mine if kind == "params"]
            _, e, _, v = next(r for r in mine if r[2] == "state")
            states[i] = Progress.of(v[4:], m.net.n_params, epoch=e, best=v[0], stop_best=v[1], val_loss=v[2], stopped=bool(v[3]))
            store.append(m.run, [*log, state_row(e, v[0], float("-inf") if v[3] else v[1], v[2], v[4:])])
    out = {}
    for m, s in zip(models, states):
        chosen = best_checkpoint(store.checkpoints(m.run)).first()
        if chosen is None:
            raise RuntimeError(f"no epoch of {m.run} brought the validation loss below {FIRST_THRESHOLD}")
        out[m.run] = Trained(m.run, m.net, np.array(chosen["params"]), s.epoch, store)
    return out
