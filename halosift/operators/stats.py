"""Counts by class and sample, and the cut flow."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from halosift.operators.cuts import relabelled
from halosift.session import finished, pin, step_folder
from halosift.sources.catalogue import quoted

# Class measures of the detector and of the benchmark convention.
DETECTOR_CLASSES = {"phys": 1, "bh": 2, "spike": 3}
BENCHMARK_CLASSES = {"sig": 1, "nom": 0, "bh": 2}

# Sample measures; the first three are substrings, the data samples whole names.
SAMPLE_TEXTS = {"gjets": "GJets", "qcd": "QCD", "gmsb": "GMSB"}
DATA_SAMPLES = ["METPD", "EGamma"]


def class_tests(classes: Mapping[str, int], label: Column) -> dict[str, Column]:
    return {name: label == code for name, code in classes.items()}


def sample_tests() -> dict[str, Column]:
    sample = F.col("sample")
    tests = {"data": sample.isin(*DATA_SAMPLES)}
    tests.update({name: sample.contains(text) for name, text in SAMPLE_TEXTS.items()})
    return tests


def _with_fractions(counts: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return counts.select(
        *keep,
        "total",
        *[F.col(f"n_{n}") for n in names],
        *[F.try_divide(f"n_{n}", "total").alias(f"f_{n}") for n in names],
    )


def summary(
    df: DataFrame,
    classes: Mapping[str, int] = DETECTOR_CLASSES,
    samples: bool = True,
    by: Sequence[str] = (),
) -> DataFrame:
    """Counts and fractions of total of every class and sample in one pass.

    ``by=["sample"]`` gives the per-process breakdown. A fraction of an empty
    table is NULL.
    """
    tests = class_tests(classes, F.col("label"))
    if samples:
        tests.update(sample_tests())
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(test).alias(f"n_{name}") for name, test in tests.items()],
    )
    return _with_fractions(counts, list(tests), by)


def class_sizes(df: DataFrame, labels: Sequence[int] | None = None) -> DataFrame:
    if labels is not None:
        df = df.filter(F.col("label").isin(*labels))
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def smallest_class(df: DataFrame, labels: Sequence[int] | None = None) -> DataFrame:
    """The smallest class; the lower label on a tie."""
    return class_sizes(df, labels).orderBy("n", "label").limit(1)


def distinct_labels(df: DataFrame) -> DataFrame:
    return df.select("label").filter("label is not null").distinct().orderBy("label")


def class_list(df: DataFrame, at_most: int = 1000) -> list[int]:
    """Sorted class codes on the driver. Refuses a column that is not a class."""
    found = [r[0] for r in distinct_labels(df).limit(at_most + 1).collect()]
    if len(found) > at_most:
        raise ValueError(f"label has more than {at_most} values; it is not a class column")
    return found


# --- cut flow --------------------------------------------------------------------------


@dataclass(frozen=True)
class Cut:
    """A row-level stage: ``keep`` maps the label as it is at that stage to a predicate."""

    name: str
    keep: Callable[[Column], Column]


@dataclass(frozen=True)
class Relabel:
    """A stage that changes labels; later stages see and count the new ones."""

    name: str
    mapping: Mapping[int, int]


@dataclass(frozen=True)
class TableStep:
    """A stage that needs the whole table, such as a group cut or a balanced sample."""

    name: str
    apply: Callable[[DataFrame], DataFrame]


Step = Cut | Relabel | TableStep


def apply_steps(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """The table after all stages."""
    for step in steps:
        if isinstance(step, Cut):
            df = df.filter(step.keep(F.col("label")))
        elif isinstance(step, Relabel):
            df = df.withColumn("label", relabelled(step.mapping))
        else:
            df = step.apply(df)
    return df


def cut_flow(
    df: DataFrame,
    steps: Sequence[Step],
    classes: Mapping[str, int] = DETECTOR_CLASSES,
    samples: bool = True,
) -> DataFrame:
    """``summary`` of the input and after every stage.

    Consecutive row-level stages share one pass: each row is tagged with the
    first stage it fails, one aggregate counts by tag, and the few tag rows are
    summed into survivors. A table-level stage starts the next pass.
    """
    return run_steps(df, steps, classes, samples)[1]


def run_steps(
    df: DataFrame,
    steps: Sequence[Step],
    classes: Mapping[str, int] = DETECTOR_CLASSES,
    samples: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(table after all stages, cut flow). Table-level stages are applied once."""
    parts: list[DataFrame] = []
    first, name, run = 0, "input", []
    for step in [*steps, None]:
        if step is not None and not isinstance(step, TableStep):
            run.append(step)
            continue
        parts.append(_one_pass(df, first, name, run, classes, samples))
        df = apply_steps(df, run)
        if step is not None:
            df = step.apply(df)
            first, name, run = first + len(run) + 1, step.name, []
    return df, reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class _Stages:
    """Row-level stages: until which one a row is left, its label in the end, and what to count."""

    names: list[str]
    alive_for: Column
    label: Column
    tests: dict[str, Column]
    version: list[int]  # which label each stage counts
    versions: int


def _stages(name: str, steps: Sequence[Step], classes: Mapping[str, int], samples: bool) -> _Stages:
    names = [name] + [s.name for s in steps]
    label = F.col("label")
    labels, version = [label], [0]  # label after each relabelling; which one a stage counts
    failed = None
    for number, step in enumerate(steps, start=1):
        if isinstance(step, Relabel):
            label = relabelled(step.mapping, label)
            labels.append(label)
        else:
            fails = ~step.keep(label)
            failed = F.when(fails, number) if failed is None else failed.when(fails, number)
        version.append(len(labels) - 1)
    alive_for = F.lit(len(names)) if failed is None else failed.otherwise(len(names))

    tests = {
        f"{n}_v{v}": t for v, lab in enumerate(labels) for n, t in class_tests(classes, lab).items()
    }
    if samples:
        tests.update(sample_tests())
    return _Stages(names, alive_for, label, tests, version, len(labels))


def run_while_writing(
    df: DataFrame,
    steps: Sequence[Cut | Relabel],
    columns: Sequence[str],
    classes: Mapping[str, int] = DETECTOR_CLASSES,
    samples: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(these columns of the rows that row-level stages leave, written to the shared folder; cut flow).

    The stages are counted while the rows are written, so the input is read once. The write has no
    shuffle, so no task that was counted runs again. In a `resumable` block the counts are written
    after the rows, and a step that has both is read instead of run."""
    of = _stages("input", steps, classes, samples)
    last = len(of.names)
    kept = [F.col(quoted(c)) if c != "label" else of.label.alias("label") for c in columns]
    tagged = df.select(*kept, of.alive_for.alias("_alive"), *[t.alias(f"_t_{n}") for n, t in of.tests.items()])
    shown = {n: n for n in sample_tests()} if samples else {}
    counted: list[Column] = []
    for stage in range(last):
        alive = F.col("_alive") > stage
        named = {n: f"{n}_v{of.version[stage]}" for n in classes} | shown
        counted.append(F.count_if(alive).alias(f"{stage}:total"))
        counted += [F.count_if(alive & F.col(f"_t_{t}")).alias(f"{stage}:n_{n}") for n, t in named.items()]
    left = lambda t: t.filter(F.col("_alive") == last).select(*[quoted(c) for c in columns])
    spark, seen = df.sparkSession, Observation()
    measures = ["total", *[f"n_{n}" for n in [*classes, *shown]]]
    layout = "stage int, cut string, " + ", ".join(f"`{m}` bigint" for m in measures)
    folder = step_folder(left(tagged), of.names, of.version, measures)
    if folder and finished(spark, f"{folder}/counts"):
        rows = spark.read.schema(left(tagged).schema).parquet(f"{folder}/rows")
        flow = spark.read.schema(layout).parquet(f"{folder}/counts")
    else:
        rows = pin(left(tagged.observe(seen, *counted)), folder and f"{folder}/rows")
        found = seen.get
        flow = spark.createDataFrame(
            [(stage, name, *[int(found.get(f"{stage}:{m}", 0)) for m in measures]) for stage, name in enumerate(of.names)], layout)
        flow = pin(flow, f"{folder}/counts") if folder else flow
    return rows, _with_fractions(flow, [m[2:] for m in measures[1:]], ["stage", "cut"])


def _one_pass(
    df: DataFrame,
    first: int,
    name: str,
    steps: Sequence[Step],
    classes: Mapping[str, int],
    samples: bool,
) -> DataFrame:
    of = _stages(name, steps, classes, samples)
    names, alive_for, tests, version = of.names, of.alive_for, of.tests, of.version
    tagged = df.select(alive_for.alias("alive_for"), *[t.alias(n) for n, t in tests.items()])
    counts = tagged.groupBy("alive_for").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(n).alias(n) for n in tests],
    )
    none = df.sparkSession.range(1).select(
        F.lit(len(names)).alias("alive_for"), *[F.lit(0).alias(c) for c in counts.columns[1:]]
    )
    survivors = (
        counts.unionByName(none)
        .withColumn("_stage", F.explode(F.sequence(F.lit(0), F.col("alive_for") - 1)))
        .groupBy("_stage")
        .agg(*[F.sum(c).alias(c) for c in counts.columns[1:]])
    )
    which = F.element_at(F.array(*[F.lit(v) for v in version]), F.col("_stage") + 1)
    shown = {n: _pick(which, [f"{n}_v{v}" for v in range(of.versions)]) for n in classes}
    if samples:
        shown.update({n: F.col(n) for n in sample_tests()})
    counted = survivors.select(
        (F.col("_stage") + first).alias("stage"),
        F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_stage") + 1).alias("cut"),
        "total",
        *[c.alias(f"n_{n}") for n, c in shown.items()],
    )
    return _with_fractions(counted, list(shown), ["stage", "cut"])


def _pick(which: Column, columns: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.col(c) for c in columns]), which + 1)
