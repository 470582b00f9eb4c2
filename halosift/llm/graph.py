"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halosift.llm.tables import fitted, pin

#: Up to so many edges, the least neighbours (two rows of 16 bytes for an edge at most) are broadcast; more are joined by a shuffle.
BROADCAST_EDGES = 250_000
#: Edges of a task.
PER_TASK = 50_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def tidy(edges: DataFrame, about: int | None = None) -> DataFrame:
    """The edges once each, the larger id in ``a``, pinned; ``about`` is how many are expected."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    return pin(e if about is None else fitted(e, about, PER_TASK))


def stars(e: DataFrame) -> tuple[DataFrame, int]:
    """Edges (a, b) from every other id to the smallest of its component, and their number; ``e`` is tidy.

    Minima combine before the shuffle, so an id with very many edges is one row
    of each task there; the joins that follow may be split by the engine. Every
    round is written to the shared folder, so rounds do not pile up. Few edges
    are worked on by few tasks, however many partitions a shuffle has: an edge
    costs next to nothing, a task and its file do not.
    """
    before = _state(e)
    while before[0]:
        near = F.broadcast if before[0] <= BROADCAST_EDGES else lambda x: x
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(near(fitted(least, before[0], PER_TASK)), "a").filter("b > a AND b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(near(fitted(down, before[0], PER_TASK)), "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
        )).alias("x")).select("x.a", "x.b").filter("a > b").distinct()
        e = pin(fitted(small, before[0], PER_TASK))
        now = _state(e)
        if now == before:
            break
        before = now
    return e, before[0]


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every id that has an edge (a, b); label is the smallest id of its component."""
    e, _ = stars(tidy(edges))
    return e.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(
        e.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())
