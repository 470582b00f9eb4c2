"""Batch scoring: the parameters are broadcast, only the input array visits Python."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halosift.models.nets import Net


def matrix(x: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; missing entries are NaN."""
    if x.null_count:
        x = x.fill_null([None] * width)
    return x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def list_column(values: np.ndarray, missing: np.ndarray) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(values.ravel()), mask=pa.array(missing)
    )


def _array_udf(df: DataFrame, net: Net, params: Sequence[float], compute) -> Column:
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(params, dtype=float))
    width = net.n_inputs

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = shared.value
        for batch in batches:
            x = matrix(batch, width)
            missing = ~np.isfinite(x).all(axis=1)
            out = compute(weights, np.where(missing[:, None], 0.0, x))
            yield list_column(out.reshape(len(x), -1), missing)

    return run


def score(df: DataFrame, net: Net, params: Sequence[float], column: str = "x") -> DataFrame:
    """Add ``p``, one probability per class; NULL where an input is missing or infinite."""
    return df.withColumn("p", _array_udf(df, net, params, net.predict)(F.col(column)))


def conv_layers(net: Net) -> list[str]:
    """Convolution layers whose output has more than one pixel."""
    return [
        lay.name for b in net.branch_layers for lay in b if lay.out_shape[0] * lay.out_shape[1] > 1
    ]


def activations(
    df: DataFrame, net: Net, params: Sequence[float], layer: str, keep: Sequence[str], column: str = "x"
) -> DataFrame:
    """(keep..., layer, kernel, i, j, value) of one convolution layer."""
    shape = next(lay.out_shape for b in net.branch_layers for lay in b if lay.name == layer)
    _, w, f = shape
    udf = _array_udf(df, net, params, lambda weights, x: net.activations(weights, x, layer))
    at = F.col("at")
    return df.select(*keep, udf(F.col(column)).alias("a")).select(
        *keep, F.posexplode_outer("a").alias("at", "value")
    ).select(
        *keep,
        F.lit(layer).alias("layer"),
        (at % f).alias("kernel"),
        F.floor(at / (f * w)).cast("int").alias("i"),
        (F.floor(at / f).cast("int") % w).alias("j"),
        "value",
    )
