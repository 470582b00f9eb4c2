"""ROC curves, working points and areas on scored tables.

A curve needs running sums over all scores in order. Equal scores are first
combined, then scores are cut into ranges; sums run inside a range and the totals
of the ranges above are added from a small table. Range boundaries come from
approximate quantiles: they spread the work and do not change the result. The
combined counts are written once; boundaries, sums and offsets read those, and
their number sets the number of ranges. Rows without a score are refused, unless
``unscored="skip"`` asks to leave them out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halosift.functions.labels import pairs_of
from halosift.session import parallelism, pin

# Misidentification target of the working point, and the zoomed plot range.
TARGET_MISS = 0.01
ZOOM_FPR = (0.0, 0.1)
ZOOM_MISS = (1e-2, 5e-1)

SCORES_PER_RANGE = 5_000_000  # distinct scores that one task sorts, about


def score_ranges(df: DataFrame, ranges: int) -> list[float]:
    """Boundaries that cut ``score`` into about equally full ranges. The accuracy
    follows the number of ranges, which keeps the sketches that are merged small."""
    steps = [k / ranges for k in range(1, ranges)]
    found = df.agg(F.percentile_approx("score", steps, 4 * ranges).alias("q")).first()["q"]
    return sorted(set(found or []))


def _counts_in_order(
    df: DataFrame, by: Sequence[str], ranges: int | None = None, unscored: str = "refuse"
) -> DataFrame:
    """From rows (by..., score, positive): one row per distinct score with its
    counts, the running counts from the highest score down, and the totals."""
    if unscored not in ("refuse", "skip"):
        raise ValueError(f"unscored is 'refuse' or 'skip', not {unscored!r}")
    combined = pin(df.groupBy(*by, F.nanvl("score", F.lit(None)).alias("score")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg"),
    ))
    size = combined.agg(
        F.count("score").alias("scores"), F.sum(F.when(F.col("score").isNull(), F.col("n"))).alias("without")
    ).first()
    if size["without"] and unscored == "refuse":
        raise ValueError(f"{size['without']} rows of a curve have no score; drop them first or ask to skip them")
    combined = combined.filter("score is not null").drop("n")
    ranges = ranges or max(parallelism(df.sparkSession), -(-size["scores"] // SCORES_PER_RANGE))
    cuts = score_ranges(combined, ranges) if ranges > 1 else []
    edges = [float("-inf"), *cuts, float("inf")]
    if len(edges) > 2:
        placed = Bucketizer(splits=edges, inputCol="score", outputCol="part").transform(combined)
    else:
        placed = combined.withColumn("part", F.lit(0.0))

    inside = Window.partitionBy(*by, "part").orderBy(F.desc("score"))
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = placed.select(
        *by, "part", "score", "pos", "neg",
        F.sum("pos").over(so_far).alias("_pos"),
        F.sum("neg").over(so_far).alias("_neg"),
        F.lead(F.struct("pos", "neg")).over(inside).alias("_next"),
    )

    # One row per range of each curve: small, so it may be sorted as a whole.
    parts = placed.groupBy(*by, "part").agg(
        F.sum("pos").alias("part_pos"),
        F.sum("neg").alias("part_neg"),
        F.max_by("pos", "score").alias("first_pos"),
        F.max_by("neg", "score").alias("first_neg"),
    )
    down = Window.partitionBy(*by).orderBy(F.desc("part"))
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = parts.select(
        *by, "part",
        F.coalesce(F.sum("part_pos").over(above), F.lit(0)).alias("pos_above"),
        F.coalesce(F.sum("part_neg").over(above), F.lit(0)).alias("neg_above"),
        F.lead(F.struct(F.col("first_pos").alias("pos"), F.col("first_neg").alias("neg")))
        .over(down).alias("below_first"),
        F.sum("part_pos").over(whole).alias("all_pos"),
        F.sum("part_neg").over(whole).alias("all_neg"),
    )
    return running.join(offsets, [*by, "part"]).select(
        *by, "score", "pos", "neg",
        (F.col("_pos") + F.col("pos_above")).alias("cum_pos"),
        (F.col("_neg") + F.col("neg_above")).alias("cum_neg"),
        F.coalesce("_next", "below_first").alias("next"),
        "all_pos", "all_neg",
    )


def roc_points(
    df: DataFrame,
    by: Sequence[str] = (),
    drop_collinear: bool = True,
    ranges: int | None = None,
    unscored: str = "refuse",
) -> DataFrame:
    """Curve (by..., threshold, fpr, tpr, miss) of rows (by..., score, positive).

    Each curve starts at (0, 0) with an infinite threshold. ``drop_collinear``
    leaves out inner points that continue the step before them. A rate whose
    class has no rows is NULL.
    """
    points = _counts_in_order(df, by, ranges, unscored)
    is_first = (F.col("cum_pos") + F.col("cum_neg")) == (F.col("pos") + F.col("neg"))
    if drop_collinear:
        bends = (F.col("next.pos") != F.col("pos")) | (F.col("next.neg") != F.col("neg"))
        points = points.filter(is_first | F.col("next").isNull() | bends)
    here = F.struct(
        F.col("score").alias("threshold"), F.col("cum_neg").alias("fp"), F.col("cum_pos").alias("tp")
    )
    start = F.struct(
        F.lit(float("inf")).alias("threshold"),
        F.lit(0).cast("bigint").alias("fp"),
        F.lit(0).cast("bigint").alias("tp"),
    )
    opened = points.select(
        *by, "all_pos", "all_neg",
        F.inline(F.when(is_first, F.array(start, here)).otherwise(F.array(here))),
    )
    tpr = F.try_divide(F.col("tp").cast("double"), F.col("all_pos"))
    return opened.select(
        *by,
        "threshold",
        F.try_divide(F.col("fp").cast("double"), F.col("all_neg")).alias("fpr"),
        tpr.alias("tpr"),
        (1 - tpr).alias("miss"),
    )


def auc(
    df: DataFrame, by: Sequence[str] = (), ranges: int | None = None, unscored: str = "refuse"
) -> DataFrame:
    """Area under each curve of rows (by..., score, positive), by the trapezoid rule."""
    points = _counts_in_order(df, by, ranges, unscored)
    strip = F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2)
    return points.groupBy(*by).agg(
        F.sum(strip).alias("_area"), F.max("all_pos").alias("_p"), F.max("all_neg").alias("_n")
    ).select(
        *by,
        F.try_divide(
            F.try_divide(F.col("_area"), F.col("_p").cast("double")), F.col("_n").cast("double")
        ).alias("auc"),
    )


# --- which rows enter a curve ----------------------------------------------------------


def against_rest(scored: DataFrame, label: int, classes: Sequence[int]) -> DataFrame:
    """Rows (score, positive) of one class against all others."""
    index = sorted(classes).index(label)
    return scored.select(F.col("p")[index].alias("score"), (F.col("label") == label).alias("positive"))


def every_class_against_rest(scored: DataFrame, classes: Sequence[int]) -> DataFrame:
    """Rows (class, score, positive) of each class against all others."""
    entries = F.array(*[
        F.struct(
            F.lit(c).alias("class"), F.col("p")[k].alias("score"), (F.col("label") == c).alias("positive")
        )
        for k, c in enumerate(sorted(classes))
    ])
    return scored.select(F.inline(entries))


def pair_entries(scored: DataFrame, classes: Sequence[int], first_only: bool = False) -> DataFrame:
    """Rows (cat1, cat2, scored_by, score, positive): a row enters each pair its
    label belongs to, once with the score of either class, or only of the first."""
    at = {c: k for k, c in enumerate(sorted(classes))}

    def entries(label: int) -> Column:
        return F.array(*[
            F.struct(
                F.lit(a).alias("cat1"),
                F.lit(b).alias("cat2"),
                F.lit(c).alias("scored_by"),
                F.col("p")[at[c]].alias("score"),
                F.lit(c == label).alias("positive"),
            )
            for a, b in pairs_of(classes)
            if label in (a, b)
            for c in ((a,) if first_only else (a, b))
        ])

    first, *others = sorted(classes)
    chosen = F.when(F.col("label") == first, entries(first))
    for c in others:
        chosen = chosen.when(F.col("label") == c, entries(c))
    # The outer form, because the inner one adds a filter that builds the entries
    # a second time; every row that is left has some.
    return scored.filter(F.col("label").isin(*classes)).select(F.inline_outer(chosen))


PAIR_KEYS = ["cat1", "cat2", "scored_by"]


def pair_curves(scored: DataFrame, classes: Sequence[int], first_only: bool = False, **options) -> DataFrame:
    """One-vs-one curves of all pairs, in both directions or scored by the first class only."""
    return roc_points(pair_entries(scored, classes, first_only), PAIR_KEYS, **options)


def zoom(
    curve: DataFrame,
    fpr: tuple[float, float] = ZOOM_FPR,
    miss: tuple[float, float] = ZOOM_MISS,
) -> DataFrame:
    """Points of a curve inside the plotted range."""
    return curve.filter(F.col("fpr").between(*fpr) & F.col("miss").between(*miss))


def working_points(
    curve: DataFrame, by: Sequence[str] = ("cat1", "cat2"), target: float = TARGET_MISS
) -> DataFrame:
    """Per curve the point whose miss rate is nearest to ``target``; of equally
    near points the one with the highest threshold."""
    order = F.struct(F.abs(F.col("miss") - F.lit(target)), -F.col("threshold"), F.col("fpr"))
    return curve.filter("miss is not null").groupBy(*by).agg(
        F.min_by(F.struct("fpr", "miss", "threshold"), order).alias("at")
    ).select(*by, "at.fpr", "at.miss", "at.threshold")


def first_direction(curve: DataFrame) -> DataFrame:
    """The plotted half of the pair curves: scored by the first class of the pair."""
    return curve.filter("scored_by = cat1")
