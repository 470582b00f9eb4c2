"""Reading CSV and Parquet tables of subclusters."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Mapping
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halosift.sources.catalogue import MISSING_TEXTS, column_kind, quoted


def present_text(text: Column) -> Column:
    return F.when(~text.isin(MISSING_TEXTS), text)


def typed_cell(text: Column, kind: str) -> Column:
    """Turn CSV text into a typed value; missing texts, NaN and what is no such
    value become NULL."""
    present = present_text(text)
    if kind == "text":
        return present
    real = present.try_cast("double")
    if kind == "real":
        return F.when(~F.isnan(real), real)
    # Whole numbers of a column with missing cells are often written as "1.0".
    return F.coalesce(
        F.trim(present).try_cast("bigint"),
        F.when(real == F.floor(real), real).try_cast("bigint"),
    )


def checked_cell(text: Column, kind: str, name: str) -> Column:
    """`typed_cell` that fails on a present text which is no value of its kind."""
    value = typed_cell(text, kind)
    if kind == "text":
        return value
    bad = present_text(text).isNotNull() & value.isNull() & ~F.coalesce(F.isnan(text.try_cast("double")), F.lit(False))
    said = F.concat(F.lit(f"column {name} holds no {kind} number: "), text)
    return F.when(bad, F.raise_error(said).cast(value_type(kind))).otherwise(value)


def value_type(kind: str) -> str:
    return {"text": "string", "real": "double", "whole": "bigint"}[kind]


def found_kinds(raws: Iterable[DataFrame], names: Iterable[str]) -> dict[str, str]:
    """Kinds of columns outside the catalogue, from one pass over all their cells:
    whole if every present cell is a whole number, else real if every one is a
    number, else text. A column without any present cell is real."""
    not_real, not_whole, kinds = {}, {}, {}
    for raw in raws:
        own = [n for n in names if n in raw.columns]
        if not own:
            continue
        def counts(n: str) -> list[Column]:
            there, number = present_text(F.col(quoted(n))), F.col(quoted(n)).try_cast("double")
            some = F.count_if(there.isNotNull())
            return [F.count_if(there.isNotNull() & number.isNull()), F.count_if(there.isNotNull() & typed_cell(there, "whole").isNull()), some]
        row = raw.agg(*[c.alias(f"{k}_{n}") for n, name in enumerate(own) for k, c in enumerate(counts(name))]).first()
        for n, name in enumerate(own):
            not_real[name] = not_real.get(name, 0) + row[f"0_{n}"]
            # a column that holds nothing is no sign of whole numbers
            not_whole[name] = not_whole.get(name, 0) + (row[f"1_{n}"] if row[f"2_{n}"] else 0)
            kinds[name] = kinds.get(name, 0) + row[f"2_{n}"]
    return {
        name: "text" if not_real[name] else "real" if not_whole[name] or not some else "whole"
        for name, some in kinds.items()
    }


CORRUPT = "_corrupt_record"
LAYOUTS_AT_MOST = 1000  # different header lines of one read


def _first_lines(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (file, number, line): the first row of each file. A task holds names of files and one batch."""
    seen: set[str] = set()
    for batch in stream:
        files = batch.column(0).dictionary_encode()
        names, first = np.unique(files.indices.to_numpy(), return_index=True)
        own = [(k, files.dictionary[n].as_py()) for n, k in zip(names.tolist(), first.tolist())]
        yield batch.take(pa.array([k for k, name in own if name not in seen], pa.int64()))
        seen.update(name for _, name in own)


def file_layouts(spark: SparkSession, paths: Iterable[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by the column names of their header, in the order of paths and names.

    One scan finds the first line of every file, whatever their number: the first line that is not blank
    in the part of the file that begins at byte 0, which one task reads. Lines are not sorted for
    that, and only first ones leave their task. Files without one are left out."""
    scans = []
    for number, path in enumerate(paths):
        scans.append(spark.read.text(path).filter("_metadata.file_block_start = 0 AND trim(value) <> ''").select(
            F.col("_metadata.file_path").alias("file"), F.lit(number).alias("number"), F.col("value").alias("line")))
    if not scans:
        return {}
    lines = reduce(DataFrame.unionByName, scans)
    firsts: dict[str, Row] = {}
    for r in lines.mapInArrow(_first_lines, lines.schema).collect():
        if r["file"] not in firsts or r["number"] < firsts[r["file"]]["number"]:  # a file may be in several paths
            firsts[r["file"]] = r
    found = sorted(firsts.values(), key=lambda r: (r["number"], r["file"]))
    distinct = list(dict.fromkeys(r["line"] for r in found))
    if len(distinct) > LAYOUTS_AT_MOST:
        raise ValueError(f"the files have more than {LAYOUTS_AT_MOST} different headers; do they have headers?")
    names = {line: tuple(spark.read.option("header", True).csv(spark.sparkContext.parallelize([line], 1)).columns) for line in distinct}
    out: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for r in found:
        out[names[r["line"]]].append(_literal(unquote(r["file"])))
    return out


def _literal(path: str) -> str:
    """A path whose characters all stand for themselves, not for a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def read_csv(
    spark: SparkSession,
    paths: str | Iterable[str],
    kinds: Mapping[str, str] | None = None,
    with_source: bool = False,
    bad: str = "raise",
) -> DataFrame:
    """Read CSV files with headers into one table, columns matched by name.

    A path may be a file, a folder or a glob; its files may differ in their
    headers. One scan finds all headers, and files with the same header become a
    single scan, so plan and jobs grow with the number of layouts and not with the
    number of files.

    Columns of the catalogue have the catalogue's kind. Others have the kind that
    ``kinds`` names, or the one that a pass over all their cells finds. A cell that
    is no value of its column's kind, and a line with more or fewer fields than the
    header, fail the read; with ``bad="null"`` such cells are missing, and fields
    beyond the header are left out.
    """
    if bad not in ("raise", "null"):
        raise ValueError(f"bad is 'raise' or 'null', not {bad!r}")
    paths = [paths] if isinstance(paths, str) else list(paths)
    kinds = dict(kinds or {})
    layouts = file_layouts(spark, paths)

    raws = []
    for header, group in layouts.items():
        schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
        reader = spark.read.option("header", True).option("enforceSchema", False)
        if bad == "raise":  # whole lines are parsed, so their fields can be counted
            schema = schema.add(CORRUPT, T.StringType())
            reader = reader.option("columnPruning", False).option("columnNameOfCorruptRecord", CORRUPT)
        raws.append((header, reader.schema(schema).csv(group)))

    unknown = list(dict.fromkeys(n for header in layouts for n in header if n not in kinds and column_kind(n) is None))
    kinds |= found_kinds([raw for _, raw in raws], unknown)
    parts = []
    for header, raw in raws:
        cell = typed_cell if bad == "null" else checked_cell
        cells = []
        for n in header:
            kind = kinds.get(n) or column_kind(n) or "text"
            text = F.col(quoted(n))
            cells.append((cell(text, kind) if bad == "null" else cell(text, kind, n)).alias(n))
        if with_source:
            cells.append(F.col("_metadata.file_path").alias("source_file"))
        if bad == "raise":
            said = F.concat(F.lit("a line has more or fewer fields than its header: "), F.col(CORRUPT))
            raw = raw.filter(F.when(F.col(CORRUPT).isNotNull(), F.raise_error(said).cast("boolean")).otherwise(True))
        parts.append(raw.select(*cells))
    return append_tables(parts)


def read_parquet(spark: SparkSession, *paths: str, nan_as_missing: bool = False) -> DataFrame:
    """Read landed tables. ``land`` writes missing values as NULL already, and a
    plain column keeps its filters in the scan; ``nan_as_missing`` is for tables
    that come from elsewhere."""
    raw = spark.read.parquet(*paths)
    return nan_to_null(raw) if nan_as_missing else raw


def nan_to_null(df: DataFrame) -> DataFrame:
    """NULL as the one missing value in all real columns."""
    return df.select(*[
        F.when(~F.isnan(quoted(f.name)), F.col(quoted(f.name))).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(quoted(f.name))
        for f in df.schema.fields
    ])


def append_tables(tables: Iterable[DataFrame]) -> DataFrame:
    """All rows of all tables; a column one of them lacks is NULL there."""
    tables = list(tables)
    if not tables:
        raise ValueError("no table to append")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def read_datasets(spark: SparkSession, datasets: Mapping[str, Iterable[str]]) -> DataFrame:
    """Read named file lists (signal, simulated background, data, ...) into one
    table with the list's name in ``dataset`` and the file in ``source_file``."""
    return append_tables(
        read_csv(spark, paths, with_source=True).withColumn("dataset", F.lit(name))
        for name, paths in datasets.items()
    )


def land(df: DataFrame, path: str, by_sample: bool = True) -> None:
    """Write a table as Parquet once, so later cuts push down and prune columns."""
    writer = df.write.mode("overwrite")
    if by_sample and "sample" in df.columns:
        writer = writer.partitionBy("sample")
    writer.parquet(path)
