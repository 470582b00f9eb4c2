"""Global row numbers without moving everything to one task.

A number is the row's place inside its own piece plus the rows of all pieces before.
Pieces are the files of a table (`in_file_order`) or ranges of a sort (`in_order_of`).
Only one count for each piece is summed up and joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halosift.session import pin

POSITION = "_position"
_PLACE_BITS = 33  # of monotonically_increasing_id: the row in its partition; the partition above


def _numbered(rows: DataFrame, piece: str, place: str, name: str) -> DataFrame:
    """``rows`` with the number ``name`` in place of the columns ``piece`` and ``place``.

    The starts of the pieces are broadcast, so rows stay where they are and a large piece is read by many tasks. They are as many
    as ranges, or as files, which the driver lists anyway."""
    counts = rows.groupBy(piece).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)  # one row for each piece
    starts = counts.select(piece, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), piece).withColumn(name, F.col("_start") + F.col(place)).drop(piece, place, "_start")


def in_file_order(table: DataFrame, name: str = POSITION) -> DataFrame:
    """A table just read from Parquet files, its rows numbered from 0 as they stand in
    the files, files in the order of their paths."""
    rows = table.select("*", F.col("_metadata.file_path").alias("_piece"), F.col("_metadata.row_index").alias("_place"))
    return _numbered(rows, "_piece", "_place", name)


def in_order_of(df: DataFrame, order: Sequence[Column], name: str = POSITION, ranges: int | None = None) -> DataFrame:
    """``df`` with its rows numbered from 0 in ascending order of the columns. The sorted rows are written
    to the shared folder, so numbers stay if a task is lost. Unless ``ranges`` are stated, small ones are joined by their bytes."""
    sort = [f"_o{k}" for k in range(len(order))]
    keyed = df.select("*", *[c.alias(s) for c, s in zip(order, sort)])
    dealt = keyed.repartitionByRange(ranges, *sort) if ranges else keyed.repartitionByRange(*sort)
    placed = pin(dealt.sortWithinPartitions(*sort).drop(*sort).withColumn(
        "_at", F.monotonically_increasing_id()))
    rows = placed.withColumn("_piece", F.shiftright("_at", _PLACE_BITS)).withColumn(
        "_place", F.col("_at").bitwiseAND((1 << _PLACE_BITS) - 1)).drop("_at")
    return _numbered(rows, "_piece", "_place", name)


def first_rows(numbered: DataFrame, n: int, name: str = POSITION) -> DataFrame:
    """The first ``n`` rows (all, if there are fewer)."""
    return numbered.filter(F.col(name) < n)


def last_fifth(numbered: DataFrame, name: str = POSITION) -> tuple[DataFrame, DataFrame]:
    """(the first floor(0.8 n) rows, the others), as a fit that holds back its last rows cuts them."""
    n = numbered.count()
    first = n * 4 // 5
    return numbered.filter(F.col(name) < first), numbered.filter(F.col(name) >= first)
