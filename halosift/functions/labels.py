"""Label encodings as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from halosift.sources.catalogue import LABEL_NAMES


def one_hot(label: Column, classes: Sequence[int]) -> Column:
    """Indicator array over the sorted classes; two classes also give two entries."""
    return F.array(*[
        F.when(label.eqNullSafe(F.lit(c)), 1).otherwise(0) for c in sorted(classes)
    ])


def from_one_hot(indicator: Column, classes: Sequence[int]) -> Column:
    """Label whose entry is 1; NULL when there is none."""
    codes = F.array(*[F.lit(c) for c in sorted(classes)])
    return F.try_element_at(codes, F.nullif(F.array_position(indicator, 1), F.lit(0)).cast("int"))


def label_name(label: Column, names: Mapping[int, str] = LABEL_NAMES) -> Column:
    pairs = chain.from_iterable((F.lit(code), F.lit(name)) for code, name in names.items())
    return F.try_element_at(F.create_map(*pairs), label.cast("int"))


def is_scored(p: Column) -> Column:
    """Whether all probabilities are there; never NULL."""
    return F.coalesce(~F.exists(p, lambda v: v.isNull() | F.isnan(v)), F.lit(False))


def predicted_label(p: Column, classes: Sequence[int]) -> Column:
    """Class of the largest probability; the first class on a tie, NULL where a
    probability is missing."""
    codes = F.array(*[F.lit(c) for c in sorted(classes)])
    return F.when(is_scored(p), F.element_at(codes, F.array_position(p, F.array_max(p)).cast("int")))


def probability_of(p: Column, label: Column, classes: Sequence[int]) -> Column:
    """Predicted probability of the row's own class."""
    out = F.lit(None).cast("double")
    for index, code in enumerate(sorted(classes)):
        out = F.when(label == code, p[index]).otherwise(out)
    return out


def pairs_of(classes: Sequence[int]) -> list[tuple[int, int]]:
    ordered = sorted(classes)
    return [(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1:]]
