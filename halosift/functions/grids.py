"""Image grids from pixel columns: normalise, multiply, choose and stack channels.

The pixel columns of a channel become one array at once. From there every step
is an array expression, so the plan stays small however many pixels there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halosift.functions.scaling import scaled
from halosift.operators.cuts import grid_columns
from halosift.sources.catalogue import GRID_FORMAT, quoted, require_columns

# Stacking order of the channels and of their products.
CHANNEL_ORDER = ["E", "t", "r"]
PRODUCT_ORDER = [("E", "r"), ("E", "t"), ("t", "r")]


@dataclass(frozen=True)
class GridSpec:
    """What goes into an image. Products, if any, replace the plain channels."""

    channels: Sequence[str] = ("E", "t", "r")
    normalize: Sequence[str] = ()
    products: Sequence[tuple[str, str]] = ()

    def __post_init__(self):
        unknown = [c for c in (*self.channels, *self.normalize) if c not in CHANNEL_ORDER]
        allowed = {frozenset(p) for p in PRODUCT_ORDER}
        unknown += ["*".join(p) for p in self.products if frozenset(p) not in allowed]
        if unknown:
            raise ValueError(f"unknown channels or products: {', '.join(unknown)}")

    @property
    def products_in_order(self) -> list[tuple[str, str]]:
        asked = {frozenset(p) for p in self.products}
        return [p for p in PRODUCT_ORDER if frozenset(p) in asked]

    @property
    def names(self) -> list[str]:
        """Channel names in the order of the data."""
        if self.products:
            return ["".join(p) for p in self.products_in_order]
        return [c for c in CHANNEL_ORDER if c in self.channels]


@dataclass(frozen=True)
class Images:
    """A table with ``x`` (array, row-major over i, j, channel) and its layout."""

    df: DataFrame
    side: int
    names: list[str]
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.side, self.side, len(self.names)


def pixel_names(channel: str, half: int) -> list[str]:
    return [
        GRID_FORMAT.format(channel=channel, i=i, j=j)
        for i in range(-half, half + 1)
        for j in range(-half, half + 1)
    ]


def pixel_array(channel: str, half: int) -> Column:
    """Pixels of a channel in one array, i outer and j inner, NaN as NULL."""
    cells = ", ".join(map(quoted, pixel_names(channel, half)))
    return F.expr(
        f"transform(cast(array({cells}) AS array<double>), v -> if(isnan(v), NULL, v))"
    )


def normalized(pixels: Column, total: Column) -> Column:
    """Pixels divided by their sum over the row. A missing pixel stays missing;
    an image of sum zero becomes all zeros."""
    return F.transform(
        pixels, lambda v: F.when(v.isNotNull() & (total == 0), 0.0).otherwise(F.try_divide(v, total))
    )


def pixel_sum(pixels: Column) -> Column:
    """Sum of the pixels that are present."""
    return F.aggregate(pixels, F.lit(0.0), lambda total, v: total + F.coalesce(v, F.lit(0.0)))


def channel_arrays(
    df: DataFrame, spec: GridSpec, keep: Sequence[str] = ()
) -> tuple[DataFrame, int]:
    """(table of ``keep`` and one pixel array per output channel, side of the grid)."""
    columns, half = grid_columns(df)
    if not columns:
        raise ValueError("channel_arrays needs pixel columns and finds none")
    used = {c for p in spec.products_in_order for c in p} if spec.products else set(spec.names)
    used = [c for c in CHANNEL_ORDER if c in used]
    for ch in used:
        require_columns(df, pixel_names(ch, half), f"channel {ch}")
    kept = [F.col(quoted(c)) for c in keep]
    out = df.select(*kept, *[pixel_array(ch, half).alias(ch) for ch in used])
    for ch in (c for c in used if c in spec.normalize):
        out = out.withColumn("_sum", pixel_sum(F.col(ch)))
        out = out.withColumn(ch, normalized(F.col(ch), F.col("_sum"))).drop("_sum")
    if spec.products:
        out = out.select(*kept, *[
            F.zip_with(a, b, lambda x, y: x * y).alias(a + b) for a, b in spec.products_in_order
        ])
    return out, 2 * half + 1


def channel_ranges(arrays: DataFrame, names: Sequence[str]) -> DataFrame:
    """(channel, lo, hi) over all pixels and rows, in one aggregate without exploding."""
    wide = arrays.agg(*[
        expression.alias(f"{tag}_{n}")
        for n in names
        for tag, expression in (("lo", F.min(F.array_min(n))), ("hi", F.max(F.array_max(n))))
    ])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("channel"), F.col(f"lo_{n}").alias("lo"), F.col(f"hi_{n}").alias("hi"))
        for n in names
    ])))


def stacked(names: Sequence[str], ranges: dict[str, tuple[float | None, float | None]]) -> Column:
    """One array per row, channel varying fastest; scaled where a range is given."""

    def value(name: str, v: Column) -> Column:
        return scaled(v, *ranges[name]) if name in ranges else v

    if len(names) == 1:
        return F.transform(names[0], lambda v: value(names[0], v))
    # Zipped first: a lambda that reads another computed array would compute it
    # once per pixel.
    return F.flatten(F.transform(
        F.arrays_zip(*names), lambda pixel: F.array(*[value(n, pixel[n]) for n in names])
    ))


def build_images(
    df: DataFrame,
    spec: GridSpec,
    keep: Sequence[str] = (),
    scale: bool = True,
    fit_on: DataFrame | None = None,
) -> Images:
    """Table of ``keep`` columns and the image array ``x``.

    ``scale`` maps each channel to [0, 1] by its global range, fitted on all rows
    or on ``fit_on`` (the training rows).
    """
    arrays, side = channel_arrays(df, spec, keep)
    ranges = {}
    if scale:
        source = arrays if fit_on is None else channel_arrays(fit_on, spec)[0]
        ranges = {r["channel"]: (r["lo"], r["hi"]) for r in channel_ranges(source, spec.names).collect()}
    kept = [F.col(quoted(c)) for c in keep]
    return Images(arrays.select(*kept, stacked(spec.names, ranges).alias("x")), side, spec.names, ranges)
