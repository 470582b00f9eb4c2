"""Feature attribution of one class, by DeepLIFT multipliers or by sampled-permutation Shapley values.

Multipliers (`by_multipliers`) take one backward pass for each pair of an explained and a
background row, averaged over the background. Shapley values (`attributions`): for every explained row, permutations of the features are walked from a background
row to the row itself; a feature's attribution is the mean change of the class
probability when it is switched. Each background row starts the same number of
walks, so the attributions of a row add up exactly to its probability minus the
mean background probability.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halosift.models.deeplift import attribute
from halosift.models.nets import Net
from halosift.models.score import matrix
from halosift.operators.sampling import take_random
from halosift.session import pin
from halosift.sources.catalogue import quoted

# Rows explained and background rows, unless the caller names others.
EXPLAINED_ROWS, BACKGROUND_ROWS = 500, 100
BACKGROUND_AT_MOST = 10_000  # rows that are broadcast, unless the caller names another bound
WALKS_AT_ONCE = 64  # walks scored together in a task


def _background(background: DataFrame, at_most: int) -> np.ndarray:
    base = [r["x"] for r in background.select("x").limit(at_most + 1).collect()]
    if not 0 < len(base) <= at_most:
        raise ValueError(f"background must have 1 to {at_most} rows")
    return np.array(base, dtype=float)


def _long(batch: pa.RecordBatch, keys: int, values: np.ndarray) -> pa.RecordBatch:
    """(key..., feature, value) of a batch whose first columns are the key, one row for each value."""
    rows, width = values.shape
    repeated = pa.array(np.repeat(np.arange(rows), width))
    return pa.RecordBatch.from_arrays(
        [*[batch.column(k).take(repeated) for k in range(keys)],
         pa.array(np.tile(np.arange(width, dtype=np.int32), rows)), pa.array(values.ravel())],
        names=[*[batch.schema.field(k).name for k in range(keys)], "feature", "value"],
    )


def _long_schema(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join([*[f"{quoted(k)} {df.schema[k].dataType.simpleString()}" for k in keys], "feature int", "value double"])


def by_multipliers(
    explained: DataFrame,
    background: DataFrame,
    net: Net,
    params: Sequence[float],
    key: str | Sequence[str],
    class_index: int = 0,
    background_at_most: int = BACKGROUND_AT_MOST,
) -> DataFrame:
    """(key..., feature, value) for every row of ``explained``: DeepLIFT attributions, averaged over the background.

    A row's values add up to its class probability minus the mean one of the background."""
    keys = [key] if isinstance(key, str) else list(key)
    spark, width = explained.sparkSession, net.n_inputs
    shared = spark.sparkContext.broadcast((_background(background, background_at_most), np.asarray(params, dtype=float)))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, weights = shared.value
        for batch in stream:
            yield _long(batch, len(keys), attribute(net, weights, matrix(batch.column(len(keys)), width), base, class_index))

    rows = explained.select(*[F.col(quoted(k)) for k in keys], "x").repartition(spark.sparkContext.defaultParallelism)
    return rows.mapInArrow(run, _long_schema(explained, keys))


def attributions(
    explained: DataFrame,
    background: DataFrame,
    net: Net,
    params: Sequence[float],
    key: str | Sequence[str],
    class_index: int = 0,
    walks_per_background: int = 1,
    seed: int = 43,
    background_at_most: int = BACKGROUND_AT_MOST,
) -> DataFrame:
    """(key..., feature, value) for every row of ``explained``, ``feature`` being the
    position in ``x``. ``background`` is a small sample and is checked to be one.

    A row's walks are made and averaged where the row is, so rows with one key
    stay apart; walks are drawn by the key's text and the row's inputs.
    """
    keys = [key] if isinstance(key, str) else list(key)
    spark = explained.sparkSession
    base = _background(background, background_at_most)
    shared = spark.sparkContext.broadcast((base, np.asarray(params, dtype=float)))
    width, n_walks = net.n_inputs, len(base) * walks_per_background

    def walk(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, weights = shared.value
        for batch in stream:
            x = matrix(batch.column(batch.num_columns - 2), width)
            tokens = batch.column(batch.num_columns - 1).to_pylist()
            total = np.zeros((len(x), width))
            for r, token in enumerate(tokens):
                for first in range(0, n_walks, WALKS_AT_ONCE):
                    numbers = np.arange(first, min(first + WALKS_AT_ONCE, n_walks))
                    order = np.array([
                        np.random.default_rng([seed, int(token, 16), int(n)]).permutation(width) for n in numbers
                    ])
                    place = np.argsort(order, axis=1)
                    switched = np.arange(width + 1)[None, :, None] > place[:, None, :]
                    path = np.where(switched, x[r], start[numbers % len(start)][:, None, :])
                    p = net.predict(weights, path.reshape(-1, width))[:, class_index]
                    np.add.at(total[r], order.ravel(), np.diff(p.reshape(len(numbers), width + 1), axis=1).ravel())
            yield _long(batch, len(keys), total / n_walks)

    texts = [F.coalesce(F.col(quoted(k)).cast("string"), F.lit("")) for k in keys]
    token = F.md5(F.concat_ws("|", *texts)).substr(1, 8) if len(keys) == 1 else F.md5(
        F.concat_ws("|", *texts, F.xxhash64("x"))).substr(1, 8)
    rows = explained.select(*[F.col(quoted(k)) for k in keys], "x", token.alias("token"))
    spread = rows.repartition(spark.sparkContext.defaultParallelism)
    return spread.mapInArrow(walk, _long_schema(explained, keys))


def importance(values: DataFrame, names: Sequence[str]) -> DataFrame:
    """(feature, importance): mean absolute attribution of each feature."""
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("feature") + 1)
    return values.groupBy("feature").agg(F.avg(F.abs("value")).alias("importance")).select(
        named.alias("feature"), "importance"
    )


def explain_sample(
    train_rows: DataFrame,
    net: Net,
    params: Sequence[float],
    key: str | Sequence[str],
    class_index: int = 0,
    seed: int = 43,
    explained_rows: int = EXPLAINED_ROWS,
    background_rows: int = BACKGROUND_ROWS,
    multipliers: bool = False,
) -> DataFrame:
    """Attributions of random rows against random background rows, drawn
    independently of each other (all rows, if there are fewer)."""
    keys = [key] if isinstance(key, str) else list(key)
    rows = train_rows.select(*map(quoted, keys), "x")
    background = take_random(rows, background_rows, seed, keys)
    explained = pin(take_random(rows, explained_rows, seed + 1, keys))
    if multipliers:
        return by_multipliers(explained, background, net, params, keys, class_index)
    return attributions(explained, background, net, params, keys, class_index, seed=seed)
