"""Training runs as tables: checkpoints, metric history and state of each run, kept in one log.

An epoch (or the epochs of one job) is one append to the run's log, so its history,
checkpoint and state are there together or not at all. After ``COMPACT_AFTER`` appends the
log is written anew as one file into the next generation's folder; the latest
generation that was written to its end counts, and older ones are deleted then. So a run
has a bounded number of files however many epochs it has, and a crash at any point
leaves a log that can be read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halosift.session import shared_dir

LOG_SCHEMA = "epoch int, kind string, metric string, train double, val double, best double, stop_best double, `values` array<double>"
METRIC, PARAMS, STATE = "metric", "params", "state"  # kinds of log rows

COMPACT_AFTER = 64  # appends

# Fixed value: a checkpoint is kept only when its validation loss is below this start value.
FIRST_THRESHOLD = 999.0


def metric_row(epoch: int, metric: str, train: float, val: float) -> tuple:
    return (epoch, METRIC, metric, float(train), float(val), None, None, None)


def params_row(epoch: int, val_loss: float, params: Iterable[float]) -> tuple:
    return (epoch, PARAMS, None, None, float(val_loss), None, None, [float(v) for v in params])


def state_row(epoch: int, best: float, stop_best: float, val_loss: float, vector: Iterable[float]) -> tuple:
    """What training needs to go on after ``epoch``."""
    return (epoch, STATE, None, None, float(val_loss), float(best), float(stop_best), [float(v) for v in vector])


class RunStore:
    """Logs in Parquet folders ``<root>/<run>/log-<generation>``."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or f"{shared_dir(spark)}/runs"
        self._appends: dict[str, int] = {}  # since the last compaction, by run

    # --- folders -----------------------------------------------------------------------

    def _at(self, path: str):
        """(file system, path) of the cluster's storage."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _folder(self, run: str, generation: int) -> str:
        return f"{self.root}/{run}/log-{generation:06d}"

    def _generations(self, run: str) -> list[int]:
        """Generations that were written to their end, in order."""
        fs, at = self._at(f"{self.root}/{run}")
        if not fs.exists(at):
            return []
        found = []
        for status in fs.listStatus(at):
            m = re.fullmatch(r"log-(\d+)", status.getPath().getName())
            if m and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found.append(int(m[1]))
        return sorted(found)

    def _delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    # --- writing -----------------------------------------------------------------------

    def start(self, run: str) -> None:
        """Empty the log of this run only; other runs are left alone."""
        self._delete(f"{self.root}/{run}")
        self._write([], self._folder(run, 0))
        self._appends[run] = 0

    def _write(self, rows: list[tuple], folder: str) -> None:
        fields = [f.split() for f in LOG_SCHEMA.replace("`", "").split(", ")]
        kinds = {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
        table = pa.table({name: pa.array([r[k] for r in rows], kinds[kind]) for k, (name, kind) in enumerate(fields)})
        self.spark.createDataFrame(table, LOG_SCHEMA).coalesce(1).write.mode("append").parquet(folder)

    def append(self, run: str, rows: list[tuple]) -> None:
        """Add log rows in one write; they become visible together."""
        done = self._generations(run)
        if not done:
            self.start(run)
            done = [0]
        self._write(rows, self._folder(run, done[-1]))
        # after a resume the appends of the session before are not known: count files once
        self._appends[run] = self._appends[run] + 1 if run in self._appends else self.files(run)
        if self._appends[run] >= COMPACT_AFTER:
            self.compact(run)

    def files(self, run: str) -> int:
        """Data files of the run, in all its folders."""
        fs, at = self._at(f"{self.root}/{run}")
        if not fs.exists(at):
            return 0
        found, walk = 0, fs.listFiles(at, True)
        while walk.hasNext():
            found += walk.next().getPath().getName().startswith("part-")
        return found

    def compact(self, run: str) -> None:
        """Write the log as one file, of all states the last only. A folder that a crash left
        unfinished is no generation and is replaced; old ones go when the new one counts."""
        done = self._generations(run)
        if not done:
            return
        log = self.log(run)
        last = log.filter(F.col("kind") == STATE).agg(F.max("epoch").alias("epoch")).first()["epoch"]
        kept = log if last is None else log.filter((F.col("kind") != STATE) | (F.col("epoch") == last))
        folder = self._folder(run, done[-1] + 1)
        kept.coalesce(1).write.mode("overwrite").parquet(folder)
        for generation in done:
            self._delete(self._folder(run, generation))
        self._appends[run] = 1

    def save_state(
        self, run: str, epoch: int, best: float, stop_best: float, val_loss: float, vector: Sequence[float]
    ) -> None:
        self.append(run, [state_row(epoch, best, stop_best, val_loss, vector)])

    def save_checkpoint(self, run: str, epoch: int, val_loss: float, params: Sequence[float]) -> None:
        self.append(run, [params_row(epoch, val_loss, params)])

    def save_history(self, rows: list[tuple]) -> None:
        """Rows (run, epoch, metric, train, val) of one run."""
        self.append(rows[0][0], [metric_row(*row[1:]) for row in rows])

    # --- reading -----------------------------------------------------------------------

    def log(self, run: str) -> DataFrame:
        done = self._generations(run)
        if not done:
            raise ValueError(f"there is no run {run} in {self.root}")
        return self.spark.read.schema(LOG_SCHEMA).parquet(self._folder(run, done[-1]))

    def _rows(self, run: str, kind: str) -> DataFrame:
        return self.log(run).filter(F.col("kind") == kind)

    def states(self, run: str) -> DataFrame:
        """The saved states, the last of them with the highest epoch."""
        return self._rows(run, STATE).select("epoch", "best", "stop_best", F.col("val").alias("val_loss"), F.col("values").alias("vector"))

    def state(self, run: str) -> dict | None:
        """The last saved state, or None."""
        if not self._generations(run):
            return None
        last = self.states(run).orderBy(F.desc("epoch")).first()
        return last and last.asDict()

    def checkpoints(self, run: str) -> DataFrame:
        return self._rows(run, PARAMS).select(F.lit(run).alias("run"), "epoch", F.col("val").alias("val_loss"), F.col("values").alias("params"))

    def history(self, run: str) -> DataFrame:
        return self._rows(run, METRIC).select(F.lit(run).alias("run"), "epoch", "metric", "train", "val")


def improved_epochs(losses: DataFrame, threshold: float = FIRST_THRESHOLD) -> DataFrame:
    """Rows whose ``val_loss`` is below that of every earlier epoch of the run."""
    earlier = Window.partitionBy("run").orderBy("epoch").rowsBetween(
        Window.unboundedPreceding, -1
    )
    best = F.least(F.lit(threshold), F.min("val_loss").over(earlier))
    return losses.withColumn("_best", best).filter("val_loss < _best").drop("_best")


def best_checkpoint(checkpoints: DataFrame, per_run: bool = False) -> DataFrame:
    """The checkpoint with the lowest loss as a number; the earlier epoch on a tie."""
    if not per_run:
        return checkpoints.orderBy("val_loss", "epoch").limit(1)
    others = [c for c in checkpoints.columns if c != "run"]
    return checkpoints.groupBy("run").agg(
        F.min_by(F.struct(*others), F.struct("val_loss", "epoch")).alias("best")
    ).select("run", "best.*")
