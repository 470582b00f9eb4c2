"""Exact-size samples without replacement, decided by a hash of the row key.

Rows of a stratum are ordered by ``md5(seed|key...)`` and the first n are taken.
The n-th smallest hash is found by counting, first by hash prefix and then inside
the one prefix where the n-th row lies; the sample is then a plain filter
``hash <= threshold``. Nothing is sorted or moved but small count tables, and the
result does not depend on partitioning, so a recomputed task picks the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halosift.operators.stats import class_sizes
from halosift.sources.catalogue import quoted

# The seeds of class balancing and of the train/test split.
BALANCE_SEED = 111
SPLIT_SEED = 43

PREFIX_STEP = 3  # hex digits added per counting round: at most 4,096 counts per stratum
RANKED_AT_MOST = 2_000_000  # rows of the last prefix that are ranked by their full hash
HASH_DIGITS = 32
COPIES_PER_ROW = 1_000_000  # copies of one row that a single task makes

Quota = Callable[[dict], Mapping]


def row_hash(seed: int, key: Sequence[str] | None, columns: Sequence[str]) -> Column:
    """Hash that orders the rows. Keys should be whole numbers or text; with no
    key the whole row is hashed, and equal rows are interchangeable."""
    if key:
        return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(quoted(k)).cast("string") for k in key]))
    whole = F.struct(*[quoted(c) for c in columns])
    # The text form orders the rows but shortens some types (timestamps); two hashes
    # of the values themselves tell rows apart whose texts are equal.
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.to_json(whole), F.xxhash64(whole), F.hash(whole)))


def partition_exact(
    df: DataFrame,
    quota: Quota,
    seed: int,
    key: Sequence[str] | None = None,
    stratum: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(sampled rows, the other rows).

    ``quota`` maps the stratum sizes to the number of rows wanted of each; a
    stratum it does not name is not sampled. The stratum column must be a class
    column, with few values. If the key is not unique and copies
    straddle the n-th place, those copies are told apart by the whole row, and
    equal rows by count.
    """
    columns = df.columns
    hashed = df.withColumn("_hash", row_hash(seed, key, columns)).withColumn(
        "_stratum", F.col(quoted(stratum)) if stratum else F.lit(0)
    )
    totals, found = _thresholds(hashed, quota)
    wanted = {s: n for s, n in quota(totals).items() if n > 0}

    in_sample, in_tie = F.lit(False), F.lit(False)
    ties = []
    for s in wanted:
        here = F.col("_stratum") == F.lit(s)
        if s not in found:  # the stratum is wanted whole
            in_sample = in_sample | here
            continue
        threshold, below, through = found[s]
        if through == wanted[s]:
            in_sample = in_sample | (here & (F.col("_hash") <= threshold))
        else:
            in_sample = in_sample | (here & (F.col("_hash") < threshold))
            tie = here & (F.col("_hash") == threshold)
            in_tie = in_tie | tie
            ties.append((tie, wanted[s] - below, through - below))
    in_sample, in_tie = F.coalesce(in_sample, F.lit(False)), F.coalesce(in_tie, F.lit(False))

    taken = [hashed.filter(in_sample).select(*map(quoted, columns))]
    left = [hashed.filter(~in_sample & ~in_tie).select(*map(quoted, columns))]
    for tie, take, have in ties:
        tied = hashed.filter(tie).select(*map(quoted, columns))
        if key:
            inside, outside = partition_exact(tied, lambda _, n=take: {0: n}, seed)
        else:
            one = tied.limit(1)
            inside, outside = _copies(one, take), _copies(one, have - take)
        taken.append(inside)
        left.append(outside)
    return reduce(DataFrame.unionByName, taken), reduce(DataFrame.unionByName, left)


def _thresholds(hashed: DataFrame, quota: Quota) -> tuple[dict, dict]:
    """Stratum sizes, and for each sampled stratum the hash of its n-th row with
    the number of rows below it and up to it."""
    counted = _prefix_counts(hashed.filter("_stratum is not null"), PREFIX_STEP)
    totals = {s: sum(n for _, n in counts) for s, counts in counted.items()}
    wanted = {}
    for s, n in quota(totals).items():
        if n > totals.get(s, 0):
            raise ValueError(f"{n} rows wanted of {s!r}, which has {totals.get(s, 0)}")
        if 0 < n < totals[s]:
            wanted[s] = n
    if not wanted:
        return totals, {}
    found = {s: _crossing(counted[s], 0, n) for s, n in wanted.items()}
    digits = PREFIX_STEP
    while digits + PREFIX_STEP < HASH_DIGITS and max(b - a for _, a, b in found.values()) > RANKED_AT_MOST:
        counted = _prefix_counts(hashed.filter(_inside(found, digits)), digits + PREFIX_STEP)
        digits += PREFIX_STEP
        found = {s: _crossing(counted[s], found[s][1], n) for s, n in wanted.items()}
    return totals, _ranked(hashed.filter(_inside(found, digits)), found, wanted)


def _prefix_counts(hashed: DataFrame, digits: int) -> dict:
    """Per stratum the sorted (prefix, rows). Only the last ``PREFIX_STEP`` digits
    vary, so a stratum has at most 4,096 entries whatever the size of the table."""
    counts = hashed.groupBy("_stratum", F.substring("_hash", 1, digits).alias("_prefix")).agg(
        F.count(F.lit(1)).alias("n")
    )
    found: dict = {}
    for r in counts.collect():
        found.setdefault(r["_stratum"], []).append((r["_prefix"], r["n"]))
    return {s: sorted(pairs) for s, pairs in found.items()}


def _crossing(counts: Sequence[tuple[str, int]], below: int, need: int) -> tuple[str, int, int]:
    """The prefix where the running count reaches ``need``, with the count before
    and through it."""
    for prefix, n in counts:
        if below + n >= need:
            return prefix, below, below + n
        below += n
    raise ValueError("fewer rows than counted before; the table changed between passes")


def _inside(found: Mapping, digits: int) -> Column:
    return reduce(
        Column.__or__,
        [
            (F.col("_stratum") == F.lit(s)) & (F.substring("_hash", 1, digits) == prefix)
            for s, (prefix, _, _) in found.items()
        ],
    )


def _ranked(inside: DataFrame, found: Mapping, wanted: Mapping) -> dict:
    """The same for full hashes, among the few rows of the crossing prefixes."""
    counts = inside.groupBy("_stratum", "_hash").agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("_stratum").orderBy("_hash").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    need, start = F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    for s, n in wanted.items():
        here = F.col("_stratum") == F.lit(s)
        need = F.when(here, F.lit(n).cast("bigint")).otherwise(need)
        start = F.when(here, F.lit(found[s][1]).cast("bigint")).otherwise(start)
    rows = (
        counts.withColumn("_through", start + F.sum("n").over(running))
        .filter((F.col("_through") >= need) & (F.col("_through") - F.col("n") < need))
        .collect()
    )
    return {r["_stratum"]: (r["_hash"], r["_through"] - r["n"], r["_through"]) for r in rows}


def _copies(one: DataFrame, n: int) -> DataFrame:
    """``n`` copies of a single row, made in slices by many tasks."""
    slices = -(-n // COPIES_PER_ROW)
    sliced = one.withColumn("_slice", F.explode(F.sequence(F.lit(1), F.lit(slices)))) if n else (
        one.withColumn("_slice", F.lit(1)).limit(0)
    )
    if slices > 1:
        sliced = sliced.repartition("_slice")
    size = F.when(F.col("_slice") == slices, n - (slices - 1) * COPIES_PER_ROW).otherwise(COPIES_PER_ROW)
    return sliced.withColumn("_copy", F.explode(F.sequence(F.lit(1), size.cast("int")))).drop(
        "_slice", "_copy"
    )


# --- the samples in use ----------------------------------------------------------------


def balance_classes(
    df: DataFrame,
    labels: Sequence[int],
    key: Sequence[str] | None = None,
    seed: int = BALANCE_SEED,
) -> DataFrame:
    """Every listed class cut down to the size of the smallest; other labels are dropped."""

    def smallest(totals: dict) -> dict:
        absent = [c for c in labels if not totals.get(c)]
        if absent:
            raise ValueError(f"class(es) without rows cannot be balanced: {absent}")
        n = min(totals[c] for c in labels)
        return {c: n for c in labels}

    listed = df.filter(F.col("label").isin(*labels))
    return partition_exact(listed, smallest, seed, key, "label")[0]


def undersample_larger(
    df: DataFrame, key: Sequence[str] | None = None, seed: int = BALANCE_SEED,
    labels: tuple[int, int] = (0, 1),
) -> DataFrame:
    """Of two classes, cut the larger down to the smaller; all other rows stay."""
    listed = F.coalesce(F.col("label").isin(*labels), F.lit(False))

    def smaller(totals: dict) -> dict:
        n = min(totals.get(c, 0) for c in labels)
        return {c: n for c in labels}

    sampled, _ = partition_exact(df.filter(listed), smaller, seed, key, "label")
    return sampled.unionByName(df.filter(~listed))


def train_test(
    df: DataFrame, key: Sequence[str] | None = None, seed: int = SPLIT_SEED
) -> tuple[DataFrame, DataFrame]:
    """(80% train, 20% test); the test part has ``ceil(n / 5)`` rows."""
    test, train = partition_exact(df, lambda t: {0: -(-t.get(0, 0) // 5)}, seed, key)
    return train, test


def fit_validation(
    train: DataFrame, key: Sequence[str] | None = None, seed: int = SPLIT_SEED + 1
) -> tuple[DataFrame, DataFrame]:
    """(80% fit, 20% validation); the fit part has ``floor(0.8 n)`` rows."""
    return partition_exact(train, lambda t: {0: t.get(0, 0) * 4 // 5}, seed, key)


def take_random(
    df: DataFrame, n: int, seed: int, key: Sequence[str] | None = None
) -> DataFrame:
    """``n`` random rows without replacement (all rows if there are fewer)."""
    return partition_exact(df, lambda t: {0: min(n, t.get(0, 0))}, seed, key)[0]
