"""Min-max scaling. Missing values neither count nor move; a constant column maps to 0."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halosift.sources.catalogue import quoted


def real(name: str | Column) -> Column:
    """Column as double with NaN as NULL."""
    col = F.col(quoted(name)) if isinstance(name, str) else name
    col = col.cast("double")
    return F.when(~F.isnan(col), col)


def scaled(x: Column, lo: float | None, hi: float | None) -> Column:
    if lo is None or hi is None:
        return F.lit(None).cast("double")
    if hi == lo:
        return F.when(x.isNotNull(), x - F.lit(lo))
    return (x - F.lit(lo)) / F.lit(hi - lo)


def unscaled(x: Column, lo: float | None, hi: float | None) -> Column:
    if lo is None or hi is None:
        return F.lit(None).cast("double")
    width = 1.0 if hi == lo else hi - lo
    return x * F.lit(width) + F.lit(lo)


def column_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (feature, lo, hi) per column, from one aggregate over the table."""
    wide = df.agg(*[
        f(real(c)).alias(f"{tag}{i}")
        for i, c in enumerate(columns)
        for tag, f in (("lo", F.min), ("hi", F.max))
    ])
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"))
        for i, c in enumerate(columns)
    ])
    return wide.select(F.inline(rows))


@dataclass(frozen=True)
class MinMax:
    """Fitted ranges by column."""

    ranges: Mapping[str, tuple[float | None, float | None]]

    @staticmethod
    def fit(df: DataFrame, columns: Sequence[str]) -> "MinMax":
        found = column_ranges(df, columns).collect()  # one row per feature
        return MinMax({r["feature"]: (r["lo"], r["hi"]) for r in found})

    def scale(self, df: DataFrame) -> DataFrame:
        return self._replace(df, scaled)

    def unscale(self, df: DataFrame) -> DataFrame:
        return self._replace(df, unscaled)

    def _replace(self, df: DataFrame, change) -> DataFrame:
        return df.select(*[
            change(real(c), *self.ranges[c]).alias(c) if c in self.ranges else F.col(quoted(c))
            for c in df.columns
        ])
