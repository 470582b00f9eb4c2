"""Accuracy, cross-entropy and micro-averaged area of a scored table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halosift.functions.labels import is_scored, predicted_label, probability_of
from halosift.operators.roc import auc, every_class_against_rest

# Fixed value: smallest probability a loss looks at.
LOSS_FLOOR = 1e-7


def accuracy_and_loss(scored: DataFrame, classes: Sequence[int]) -> DataFrame:
    """One row (n, n_scored, accuracy, loss). Rows without probabilities or whose
    label is none of the classes are in ``n`` only."""
    p, label = F.col("p"), F.col("label")
    own = F.when(is_scored(p), probability_of(p, label, classes))
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(own).alias("n_scored"),
        F.avg(F.when(own.isNotNull(), (predicted_label(p, classes) == label).cast("int"))).alias("accuracy"),
        F.avg(F.when(own.isNotNull(), -F.log(F.greatest(own, F.lit(LOSS_FLOOR))))).alias("loss"),
    )


def micro_auc(scored: DataFrame, classes: Sequence[int]) -> DataFrame:
    """One row (auc): every (row, class) entry is one score, positive where it is the label."""
    return auc(every_class_against_rest(scored, classes).drop("class"))
