"""Mean input maps of image tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halosift.functions.grids import Images


def mean_maps(images: Images) -> DataFrame:
    """(label, channel, i, j, value): sum of the images of a class, divided by its
    own total, so each (label, channel) map sums to 1.

    Pixels are summed by (label, position) in each task before anything moves;
    what moves is one small map per class and task. ``i`` is local ieta and ``j``
    local iphi.
    """
    # The outer form, because the inner one adds a size filter that repeats the
    # whole image expression below it; images are never empty.
    side, _, depth = images.shape
    half = side // 2
    at = F.col("at")
    sums = (
        images.df.select("label", F.posexplode_outer("x").alias("at", "v"))
        .groupBy("label", "at")
        .agg(F.sum("v").alias("s"))
    )
    whole = Window.partitionBy("label", "channel")
    return sums.select(
        "label",
        F.element_at(F.array(*[F.lit(n) for n in images.names]), at % depth + 1).alias("channel"),
        (F.floor(at / (depth * side)).cast("int") - half).alias("i"),
        (F.floor(at / depth).cast("int") % side - half).alias("j"),
        "s",
    ).select(
        "label", "channel", "i", "j", F.try_divide(F.col("s"), F.sum("s").over(whole)).alias("value")
    )
