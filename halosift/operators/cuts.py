"""Row selection. Every rule is first a *keep* predicate that is never NULL, so
rules can be stacked into one Filter, or tagged stage by stage in a cut flow.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halosift.functions.bloom import bloom
from halosift.session import pin
from halosift.sources.catalogue import (
    FEATURE_SETS,
    GRID_PATTERN,
    IDENTITY_COLUMNS,
    quoted,
    require_columns,
)

# Codes used by the cuts.
UNMATCHED_LABEL = -1
BACKGROUND_LABEL = 1
SIGNAL_SAMPLE_TEXT = "GMSB"
NOT_MATCHED_VALUE = -999.0

SINGLE_AT_MOST = 100_000  # keys that are broadcast; more are joined by a shuffle


def _label(label: Column | None) -> Column:
    return F.col("label") if label is None else label


def _surely(condition: Column) -> Column:
    """True only where the condition is known to hold; a missing value is no match."""
    return F.coalesce(condition, F.lit(False))


# --- keep predicates -------------------------------------------------------------------


def is_matched(label: Column | None = None) -> Column:
    """Label is not -1; a missing label stays."""
    return ~_label(label).eqNullSafe(F.lit(UNMATCHED_LABEL))


def is_not_signal_sample_background(label: Column | None = None) -> Column:
    """Not a background-labelled row of a signal sample."""
    in_signal = _surely(F.col("sample").contains(SIGNAL_SAMPLE_TEXT))
    return ~(in_signal & _label(label).eqNullSafe(F.lit(BACKGROUND_LABEL)))


def is_class_from(nclass: int, samp: str, label: Column | None = None) -> Column:
    """Class and sample pattern go together: rows of the sample are of the class
    and rows of the class are of the sample. A missing sample says neither."""
    matches = F.col("sample").rlike(samp)
    of_class = _label(label).eqNullSafe(F.lit(nclass))
    return ~((_surely(matches) & ~of_class) | (_surely(~matches) & of_class))


def is_leading(column: str = "subcl") -> Column:
    return F.col(column).eqNullSafe(F.lit(0))


def is_not_sentinel(column: str = "R9", value: float = NOT_MATCHED_VALUE) -> Column:
    """Column differs from the sentinel; a missing value stays."""
    return ~F.col(quoted(column)).eqNullSafe(F.lit(value))


def is_lead_photon() -> Column:
    return F.col("lead").eqNullSafe(F.lit(1))


def relabelled(mapping: Mapping[int, int], label: Column | None = None) -> Column:
    """Label after replacing codes; codes not listed and missing labels stay."""
    label = _label(label)
    out = label
    for old, new in mapping.items():
        out = F.when(label == old, F.lit(new)).otherwise(out)
    return out


# --- table operators -------------------------------------------------------------------


def drop_unmatched(df: DataFrame) -> DataFrame:
    require_columns(df, ["label"], "drop_unmatched")
    return df.filter(is_matched())


def drop_signal_sample_background(df: DataFrame) -> DataFrame:
    require_columns(df, ["sample", "label"], "drop_signal_sample_background")
    return df.filter(is_not_signal_sample_background())


def clean(df: DataFrame, drop_incomplete: bool = False) -> DataFrame:
    """The standard cleaning. Rows with missing values stay unless asked otherwise."""
    out = drop_signal_sample_background(drop_unmatched(df))
    return out.dropna() if drop_incomplete else out


def select_class(df: DataFrame, nclass: int, samp: str) -> DataFrame:
    require_columns(df, ["sample", "label"], "select_class")
    return df.filter(is_class_from(nclass, samp))


def split_leading(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leading rows, all other rows)."""
    require_columns(df, ["subcl"], "split_leading")
    return df.filter(is_leading()), df.filter(~is_leading())


def drop_sentinel(df: DataFrame, column: str = "R9", value: float = NOT_MATCHED_VALUE) -> DataFrame:
    require_columns(df, [column], "drop_sentinel")
    return df.filter(is_not_sentinel(column, value))


def lead_photons(df: DataFrame) -> DataFrame:
    require_columns(df, ["lead"], "lead_photons")
    return df.filter(is_lead_photon())


def relabel(df: DataFrame, mapping: Mapping[int, int]) -> DataFrame:
    return df.withColumn("label", relabelled(mapping))


def single_subcluster_only(
    df: DataFrame, keys: Sequence[str] = ("sample", "event", "object")
) -> DataFrame:
    """Keep rows whose parent (``keys``) has exactly one row.

    Rows stay where they are. Only hashes of the keys are counted by a shuffle, combined
    map-side, so a parent holding a large share of all rows is one record a task. Hashes
    found twice or more fill a Bloom filter; a row that misses it has a parent of its own and
    passes. Of the rows that hit it, keys are counted exactly, and those found once, which are
    the filter's few errors, pass too. Rows whose event or object is missing or negative have no
    parent to share and always stay.

    ``df`` is read three times, twice only in its keys, so it should be a table and not long work.
    """
    require_columns(df, list(keys), "single_subcluster_only")
    no_parent = F.lit(False)
    for key in (k for k in keys if k in ("event", "object")):
        no_parent = no_parent | F.col(quoted(key)).isNull() | (F.col(quoted(key)) < 0)
    key_columns = [F.col(quoted(k)) for k in keys]
    hashed = F.xxhash64(*key_columns)
    parents = df.filter(~no_parent)
    repeated = pin(parents.select(hashed.alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"))
    maybe = bloom(repeated, "h", repeated.count())
    named = [c.alias(f"_k{n}") for n, c in enumerate(key_columns)]
    counted = parents.filter(maybe(hashed)).select(*named).groupBy(*[f"_k{n}" for n in range(len(keys))]).agg(F.count(F.lit(1)).alias("_rows"))
    single = pin(counted.filter("_rows = 1").drop("_rows"))
    tagged = df.withColumn("_hit", F.coalesce(F.when(~no_parent, maybe(hashed)), F.lit(False)))
    passed = tagged.filter(~F.col("_hit")).drop("_hit")
    few = single.count()
    if not few:
        return passed
    same = reduce(Column.__and__, [c.eqNullSafe(F.col(f"_k{n}")) for n, c in enumerate(key_columns)])
    kept = tagged.filter("_hit").drop("_hit").join(F.broadcast(single) if few <= SINGLE_AT_MOST else single, same, "left_semi")
    return passed.unionByName(kept)


def features_only(df: DataFrame) -> DataFrame:
    """Drop the identity columns; what is left are features."""
    return df.drop(*IDENTITY_COLUMNS)


def feature_columns(
    features: str | Iterable[str], exclude: str | None = None
) -> tuple[list[str], str | None]:
    """Column list of a feature set without ``exclude``, and a warning text if
    the excluded feature was not in the set."""
    cols = list(FEATURE_SETS[features]) if isinstance(features, str) else list(features)
    if exclude is None:
        return cols, None
    if exclude not in cols:
        return cols, f"feature to exclude is not in the selection: {exclude}"
    return [c for c in cols if c != exclude], None


def select_features(
    df: DataFrame, features: str | Iterable[str], exclude: str | None = None
) -> DataFrame:
    """Identity columns and one feature set."""
    cols, warning = feature_columns(features, exclude)
    if warning:
        print(warning)
    require_columns(df, IDENTITY_COLUMNS + cols, "select_features")
    return df.select(*[quoted(c) for c in IDENTITY_COLUMNS[:-1] + cols + ["label"]])


def grid_columns(df: DataFrame) -> tuple[list[str], int]:
    """Names of the pixel columns and the half width of the grid, from the schema."""
    cols = [c for c in df.columns if GRID_PATTERN.fullmatch(c)]
    half = int(((len(cols) / 3) ** 0.5 - 1) / 2)
    return cols, half


def select_classes(df: DataFrame, *labels: int) -> DataFrame:
    """Rows of the given classes (for a pair: the two-class mask)."""
    return df.filter(F.col("label").isin(*labels))
