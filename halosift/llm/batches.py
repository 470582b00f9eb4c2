"""Add what a function over Arrow batches computes as one struct column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from halosift.llm.tables import small_batches


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it new in ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def add_struct(df: DataFrame, out: str, ddl: str, make: Callable[[], Callable[[dict], dict]],
               inputs: dict[str, str]) -> DataFrame:
    """``df`` with a struct column ``out`` of type ``ddl`` last.

    ``make()`` runs once in each task and gives the function. That gets
    ``{name: array}`` for the columns that ``inputs`` names and returns one
    array for each field. All columns of ``df`` are handed through.
    """
    small_batches(df.sparkSession)
    kind = T._parse_datatype_string(ddl)
    schema = T.StructType([*df.schema.fields, T.StructField(out, kind)])
    place = {name: df.columns.index(column) for name, column in inputs.items()}
    names = [f.name for f in kind.fields]
    types = [to_arrow_type(f.dataType) for f in kind.fields]
    columns = [*df.columns, out]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in stream:
            got = work({name: batch.column(i) for name, i in place.items()})
            parts = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in (got[n] for n in names)]
            parts = [(x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x).cast(t) for x, t in zip(parts, types)]
            made = pa.StructArray.from_arrays(parts, fields=[pa.field(n, t) for n, t in zip(names, types)])
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=columns)

    return df.mapInArrow(run, schema)


def flat(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    return df.select(*keys, F.col(out + ".*"))
