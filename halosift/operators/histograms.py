"""Per-class feature histograms and the closure test built on their bins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halosift.functions.scaling import real

# Fixed value: number of equal bins.
BINS = 50


@dataclass(frozen=True)
class Ranges:
    """Plotted range of every (feature, label): as many numbers as there are pairs.

    They enter later plans as constants, looked up by position ``f * len(labels) + y``.
    """

    features: list[str]
    labels: list[int]
    lo: list[float | None]
    hi: list[float | None]
    label_type: str = "int"

    def at(self, f: Column, y: Column) -> tuple[Column, Column]:
        place = f * len(self.labels) + y
        return tuple(
            F.array(*[F.lit(v).cast("double") for v in side])[place] for side in (self.lo, self.hi)
        )

    def names(self, f: Column, y: Column) -> tuple[Column, Column]:
        feature = F.array(*[F.lit(n) for n in self.features])[f]
        label = F.array(*[F.lit(v) for v in self.labels])[y].cast(self.label_type)
        return feature.alias("feature"), label.alias("label")

    def all_bins(self, spark: SparkSession, bins: int) -> DataFrame:
        """(f, y, bin) of every pair that has a range."""
        k = len(self.labels)
        at = F.col("id")
        grid = spark.range(0, len(self.features) * k * bins, 1, 1).select(
            F.floor(at / (k * bins)).cast("int").alias("f"),
            (F.floor(at / bins) % k).cast("int").alias("y"),
            (at % bins).cast("int").alias("bin"),
        )
        return grid.filter(self.at(F.col("f"), F.col("y"))[0].isNotNull())


def class_ranges(df: DataFrame, features: Sequence[str], labels: Sequence[int]) -> Ranges:
    """Ranges fitted in one pass: one wide aggregate by label, so the table is not
    multiplied by its features, and one row per listed label comes back. A
    single-valued feature gets the range one half to either side."""
    labels = sorted(labels)
    wide = df.filter(F.col("label").isin(*labels)).groupBy("label").agg(*[
        f(real(c)).alias(f"{tag}{i}")
        for i, c in enumerate(features)
        for tag, f in (("lo", F.min), ("hi", F.max))
    ])
    rows = {r["label"]: r for r in wide.collect()}
    lo, hi = [], []
    for i in range(len(features)):
        for y in labels:
            a, b = (rows[y][f"lo{i}"], rows[y][f"hi{i}"]) if y in rows else (None, None)
            flat = a is not None and a == b
            lo.append(a - 0.5 if flat else a)
            hi.append(b + 0.5 if flat else b)
    return Ranges(list(features), labels, lo, hi, df.schema["label"].dataType.simpleString())


def bin_edge(number: Column, lo: Column, hi: Column, bins: int = BINS) -> Column:
    """Left edge of bin ``number``; the edge after the last bin is ``hi`` itself."""
    return F.when(number == bins, hi).otherwise(number * ((hi - lo) / bins) + lo)


def with_bin(df: DataFrame, bins: int = BINS) -> DataFrame:
    """Rows (value, lo, hi, ...) inside their range with ``bin``: left edge in,
    right edge out, the last bin holds both. A first guess is moved by one where
    rounding put a value on the wrong side of the edge it is compared with."""
    value, lo, hi, guess = F.col("value"), F.col("lo"), F.col("hi"), F.col("_guess")
    first = F.least(F.lit(bins - 1), F.floor((value - lo) / (hi - lo) * bins).cast("int"))
    moved = (
        F.when(value < bin_edge(guess, lo, hi, bins), guess - 1)
        .when((value >= bin_edge(guess + 1, lo, hi, bins)) & (guess < bins - 1), guess + 1)
        .otherwise(guess)
    )
    inside = df.filter((value >= lo) & (value <= hi)).withColumn("_guess", first)
    return inside.withColumn("bin", moved)


def _class_position(labels: Sequence[int]) -> Column:
    out = F.lit(None).cast("int")
    for position, label in enumerate(labels):
        out = F.when(F.col("label") == label, position).otherwise(out)
    return out


def _values(features: Sequence[str]) -> Column:
    """Unfolds a row into (f, value), f being the position of the feature."""
    return F.posexplode(F.array(*[real(c) for c in features])).alias("f", "value")


def _counts(df: DataFrame, ranges: Ranges, bins: int) -> DataFrame:
    """(f, y, bin, n) of the bins that are not empty."""
    lo, hi = ranges.at(F.col("f"), F.col("y"))
    placed = (
        df.filter(F.col("label").isin(*ranges.labels))
        .select(_class_position(ranges.labels).alias("y"), _values(ranges.features))
        .filter("value is not null")
        .select("f", "y", "value", lo.alias("lo"), hi.alias("hi"))
    )
    return with_bin(placed, bins).groupBy("f", "y", "bin").agg(F.count(F.lit(1)).alias("n"))


def _predicted(scored: DataFrame, ranges: Ranges, bins: int) -> DataFrame:
    """(f, y, bin, pred): every row enters the histogram of every label, weighted
    by its predicted probability of that label."""
    lo, hi = ranges.at(F.col("f"), F.col("y"))
    placed = (
        scored.select("p", _values(ranges.features))
        .filter("value is not null")
        .select("f", "value", F.posexplode_outer("p").alias("y", "weight"))
        .select("f", "y", "value", "weight", lo.alias("lo"), hi.alias("hi"))
    )
    return with_bin(placed, bins).groupBy("f", "y", "bin").agg(F.sum("weight").alias("pred"))


def class_histograms(
    df: DataFrame,
    features: Sequence[str],
    labels: Sequence[int],
    bins: int = BINS,
    ranges: Ranges | None = None,
) -> DataFrame:
    """(feature, label, bin, lo, hi, n) with empty bins; lo and hi are the bin's
    edges. Counts are combined in each task before they move; there are at most
    features x labels x bins of them."""
    ranges = ranges or class_ranges(df, features, labels)
    full = ranges.all_bins(df.sparkSession, bins).join(
        F.broadcast(_counts(df, ranges, bins)), ["f", "y", "bin"], "left"
    )
    b = F.col("bin")
    lo, hi = ranges.at(F.col("f"), F.col("y"))
    return full.select(
        *ranges.names(F.col("f"), F.col("y")),
        b,
        bin_edge(b, lo, hi, bins).alias("lo"),
        bin_edge(b + 1, lo, hi, bins).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def predicted_histograms(scored: DataFrame, ranges: Ranges, bins: int = BINS) -> DataFrame:
    """(feature, label, bin, pred) of the bins that are not empty; values outside a
    label's range are left out. ``p`` holds one probability per label of ``ranges``."""
    return _predicted(scored, ranges, bins).select(
        *ranges.names(F.col("f"), F.col("y")), "bin", "pred"
    )


def closure(
    scored: DataFrame, features: Sequence[str], labels: Sequence[int], bins: int = BINS
) -> DataFrame:
    """Predicted against true counts per bin, with their ratio.

    The ratio is -1 where either side is empty. ``ymax`` is the largest
    true/predicted of the (feature, label), an empty predicted bin counting as 1.
    """
    ranges = class_ranges(scored, features, labels)
    true = class_histograms(scored, features, labels, bins, ranges)
    pred = predicted_histograms(scored, ranges, bins)
    both = true.join(F.broadcast(pred), ["feature", "label", "bin"], "left").withColumn(
        "pred", F.coalesce("pred", F.lit(0.0))
    )
    empty = (F.col("n") == 0) | (F.col("pred") == 0)
    against = F.when(empty, F.lit(1.0)).otherwise(F.col("pred"))
    top = F.max(F.col("n") / against).over(Window.partitionBy("feature", "label"))
    return both.select(
        "feature", "label", "bin", "lo", "hi",
        F.col("n").alias("true"),
        "pred",
        F.when(empty, F.lit(-1.0)).otherwise(F.try_divide("pred", "n")).alias("ratio"),
        top.alias("ymax"),
    )
