"""Session helpers: where intermediates go and how they are pinned."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_open: list[list[str]] = []  # paths pinned inside each `released` block
_flows: list[str] = []  # folder of each open `resumable` block


def local_session(name: str = "halosift", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a single-machine session may do without the setting; it then gets a
    temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        _local_dirs[app] = tempfile.mkdtemp(prefix="halosift-")
    return _local_dirs[app]


def pin(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Lineage ends there: later passes read only the columns they use, and a lost
    executor costs a re-read instead of the work before. With ``path`` the table
    goes there, in place of what an interrupted write left.
    """
    if path is None:
        path = f"{shared_dir(df.sparkSession)}/pinned/{uuid.uuid4().hex}"
        if _open:
            _open[-1].append(path)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files_of(df: DataFrame) -> list[str] | None:
    """The input files of ``df`` with length and time of change; None if it reads anything but files."""
    leaves, found = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for k in range(leaves.size()):
        relation = leaves.apply(k).relation() if leaves.apply(k).getClass().getSimpleName() == "LogicalRelation" else None
        if relation is None or relation.getClass().getSimpleName() != "HadoopFsRelation":
            return None
        listed = relation.location().allFiles().mkString("\n")  # the listing the plan was made from, in one call
        found.append(re.sub(r"access_time=\d+", "", listed))
    return found


def step_folder(df: DataFrame, *more: object) -> str | None:
    """The folder of a step in the open `resumable` block: named by its plan, its input files and ``more``.

    None outside such a block, and for plans that read anything but files or run Python, since
    their text does not say what they compute."""
    files = _files_of(df) if _flows else None
    if not files:
        return None
    spark, name = df.sparkSession, "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(name)
    spark.conf.set(name, "1000000")
    try:
        plan, optimized = (f().toString() for f in (df._jdf.queryExecution().analyzed, df._jdf.queryExecution().optimizedPlan))
    finally:
        spark.conf.set(name, before)
    if re.search(r"Python|MapIn|InPandas|InArrow|UDF", plan + optimized):
        return None
    said = "\n".join([re.sub(r"#\d+L?", "", plan), *files, *map(str, more)])
    return f"{_flows[-1]}/{hashlib.sha256(said.encode()).hexdigest()}"


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


@contextmanager
def resumable(spark: SparkSession, name: str) -> Iterator[None]:
    """A flow that fails inside goes on from its pinned rows when it is run again in a block of this
    ``name``, also in another session. They are found by the step's plan and its input files, so a flow
    with other cuts, columns or files makes its own. When the block ends without an error they are
    deleted: write what is wanted of the flow's tables before."""
    folder = f"{shared_dir(spark)}/flows/{name}"
    _flows.append(folder)
    try:
        yield
    finally:
        _flows.pop()
    delete(spark, folder)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that were pinned inside, at the end. Write what is wanted
    of them before: a flow's tables read them. Shards that training checkpoints go
    when Spark cleans checkpoints (``spark.cleaner.referenceTracking.cleanCheckpoints``)."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            delete(spark, path)


def pin_partitions(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` to the shared folder, keeping its partitions as they are."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_dir(spark)}/checkpoints")
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    """Number of ranges or slices to cut a large sorted problem into."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
