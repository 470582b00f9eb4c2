"""What five filters remove, and what they owe to their order.

A document fails A with under 200 words, B if under half its words are distinct,
C if over 3 % of its code points are A-Z, D if it holds one of ``#$%&*|``, and E if
its text is identical to that of a smaller doc_id. Every document gets a mask of
the filters it fails; all figures for all 120 orders are sums over counts of masks,
of which there are 32 a part.

E needs the texts to meet, which is what costs. A prepass keeps most at home: every
task adds its texts' hashes to a counting Bloom filter of ``CELLS`` cells a text
(rows of cells and counts, summed block by block on the executors). A text one of
whose cells counts one is the only one of its kind. Only the others, which are the
repeats and a few per cent more, are grouped by their full text for the smallest
id, equal texts of one task combined before the shuffle. The cells of two or more
are broadcast as bits; there are at most ``MOST_CELLS`` (32 MB), enough for some
30 million rows. With more rows the filter fills: it then clears fewer texts, more
are grouped, and the result stays the same.

Null and empty texts are the empty text. A null lang is the part ``''``. Rows without a doc_id
have no smaller one and are none for others: they never fail E
and have no labels. Rows equal in
doc_id and text are no repeats of each other; each row counts. A document that ``labels``
holds several times is good or toxic if one of its rows says so. An empty table has no
parts. Long texts are counted byte by byte in runs of bounded memory. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halosift.llm import words as W
from halosift.llm.batches import add_struct
from halosift.llm.tables import pin, send, spread

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 3, "#$%&*|"
CELLS, PROBES, MOST_CELLS, BLOCK = 8, 3, 1 << 28, 1 << 16
_MANY = 1 << 20  # hashes a task holds before it gives out their cells

_CAPITAL = W.byte_set((0x41, 0x5A))
_SYMBOL = W.byte_set(SYMBOLS)


# --- filters of one text ---------------------------------------------------------------


def failed(t: W.Texts) -> np.ndarray:
    """Mask of the filters A to D that each row fails: 1, 2, 4, 8."""
    out = np.zeros(t.rows, np.int64)
    w = W.words(t, W.NOT_SPACE)
    n = w.counts
    out[n < LEAST_WORDS] |= 1
    h = W.span_hashes(t.data, w.start, w.end)
    row = w.row()
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (np.diff(h[order]) != 0) | (np.diff(row[order]) != 0)
    out[100 * np.bincount(row[order][new], minlength=t.rows) < DISTINCT_PERCENT * n] |= 2
    count = lambda which: W.per_row(which[t.data], t.at)
    out[100 * count(_CAPITAL) > CAPITAL_PERCENT * count(W.FIRST_BYTE)] |= 4
    out[count(_SYMBOL) > 0] |= 8
    return out


def marks(docs: DataFrame) -> DataFrame:
    """(id, part, h, mask) of every row; h is the hash of the text."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        _hash().alias("h"), "text")

    def make():
        def work(batch: dict) -> dict:
            got = [failed(t) for t in W.texts_of(batch["text"])]
            return {"mask": np.concatenate(got) if got else np.zeros(0, np.int64)}
        return work

    return add_struct(rows, "m", "mask bigint", make, {"text": "text"}).select("id", "part", "h", "m.mask")


def _hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


# --- counting Bloom filter -------------------------------------------------------------


def cells_of(h: np.ndarray, bits: int) -> np.ndarray:
    """The cells of each hash, a row of ``PROBES``."""
    h = h.view(np.uint64)[:, None] + np.arange(1, PROBES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (W.mix(h) >> np.uint64(64 - bits)).astype(np.int64)


def _partial(bits: int):
    """Of (h): for each block of cells, which cells the rows hit and how often, from two on as two."""
    def give(hashes: np.ndarray) -> pa.RecordBatch:
        # a text twice in one task has all its cells counted twice; a text once whose probes meet in a cell, once
        one, n = np.unique(hashes, return_counts=True)
        cell = np.sort(cells_of(one, bits), axis=1)
        first = np.ones(cell.shape, bool)
        first[:, 1:] = cell[:, 1:] != cell[:, :-1]
        cell, at = np.unique(cell[first], return_inverse=True)
        total = np.minimum(np.bincount(at, np.broadcast_to(n[:, None], first.shape)[first], minlength=len(cell)), 2).astype(np.uint8)
        block, begin = np.unique(cell // BLOCK, return_index=True)
        end = [*begin[1:], len(cell)]
        place = (cell % BLOCK).astype(np.uint16)
        return pa.RecordBatch.from_arrays([
            pa.array(block), pa.array([place[a:b].tobytes() for a, b in zip(begin, end)], pa.binary()),
            pa.array([total[a:b].tobytes() for a, b in zip(begin, end)], pa.binary())], names=["block", "cells", "counts"])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in stream:
            held.append(batch.column(0).to_numpy())
            size += len(held[-1])
            if size >= _MANY:
                yield give(np.concatenate(held))
                held, size = [], 0
        if size:
            yield give(np.concatenate(held))
    return run


def _merged(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (block, cells, counts), sorted by block: the cells of two or more, as bits. Counts add up and stop at two."""
    def give(block: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(total > 1).tobytes()], pa.binary())], names=["block", "bits"])

    now, total = None, None
    for batch in stream:
        for block, cells, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            if block != now:
                if now is not None:
                    yield give(now, total)
                now, total = block, np.zeros(BLOCK, np.uint8)
            place = np.frombuffer(cells.as_py(), np.uint16)
            total[place] = np.minimum(total[place] + np.frombuffer(counts.as_py(), np.uint8), 2)
    if now is not None:
        yield give(now, total)


def sketch_bits(rows: int, most: int = MOST_CELLS) -> int:
    """The filter has 2 ** this many cells."""
    return max(BLOCK.bit_length() - 1, min(most.bit_length() - 1, (CELLS * rows).bit_length()))


def repeated_cells(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bits of the cells that count two or more, over all rows of (h)."""
    partial = hashes.select("h").mapInArrow(_partial(bits), "block bigint, cells binary, counts binary")
    merged = partial.repartition(spread(hashes), "block").sortWithinPartitions("block").mapInArrow(_merged, "block bigint, bits binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in merged.toLocalIterator():
        out[r["block"] * BLOCK // 8:(r["block"] + 1) * BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _maybe(bits: int, table):
    """A column function: whether a text of this hash may occur more than once."""
    held: list[np.ndarray] = []

    def probe(h):
        if not held:
            held.append(table())
        where, cell = held[0], cells_of(np.ascontiguousarray(h.to_numpy(zero_copy_only=False)), bits)
        hit = (where[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1
        return pa.array(hit.all(axis=1))
    return F.arrow_udf(probe, "boolean")


# --- repeats ---------------------------------------------------------------------------


def repeats(docs: DataFrame, marked: DataFrame, most: int = MOST_CELLS) -> DataFrame:
    """(id, h) of the rows whose text a smaller doc_id has; ``marked`` has (id, h) of all rows of ``docs``."""
    known = marked.filter("id IS NOT NULL")
    bits = sketch_bits(known.count(), most)
    maybe = _maybe(bits, send(docs.sparkSession, repeated_cells(known, bits)))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"), _hash().alias("h"))
    least = texts.filter(F.col("id").isNotNull()).filter(maybe("h")).groupBy("text").agg(F.min("id").alias("id"))
    first = pin(least.select("id", F.xxhash64("text").alias("h")))
    return known.select("id", "h").filter(maybe("h")).distinct().join(first, ["id", "h"], "left_anti")


# --- counts of masks -------------------------------------------------------------------


def mask_counts(docs: DataFrame, labels: DataFrame, most: int = MOST_CELLS) -> DataFrame:
    """(part, mask, n, good, toxic): documents, those of quality 1 and the toxic ones, for each mask."""
    marked = pin(marks(docs))
    again = repeats(docs, marked, most).withColumn("again", F.lit(16))
    said = labels.select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic").groupBy("id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = marked.join(again, ["id", "h"], "left").join(said, "id", "left")
    one = lambda c: F.sum(F.coalesce(c, F.lit(0)).cast("long")).alias(c)
    mask = (F.col("mask") + F.coalesce("again", F.lit(0))).cast("int").alias("mask")
    return rows.select("part", mask, "good", "toxic").groupBy("part", "mask").agg(F.count("*").alias("n"), one("good"), one("toxic"))


def orders() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, the step's bit, bits of the filters before it), for all orders."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            out.append(("".join(order), step, bit, before))
            before |= bit
    return out


def report(docs: DataFrame, labels: DataFrame, most: int = MOST_CELLS) -> DataFrame:
    counts = mask_counts(docs, labels, most)
    kind = "array<struct<filter_order: string, step: int, bit: int, before: int>>"
    steps = F.from_json(F.lit("[" + ",".join(
        f'{{"filter_order":"{o}","step":{s},"bit":{b},"before":{p}}}' for o, s, b, p in orders()) + "]"), kind)
    rows = counts.withColumn("s", F.explode(steps)).select("*", "s.*")
    fails, earlier = F.expr("mask & bit <> 0"), F.expr("mask & before <> 0")
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    orders_first = F.col("n") * (F.lit(120) / F.greatest(F.bit_count("mask"), F.lit(1))).cast("long")  # of the filters a text fails, each comes first equally often
    return rows.groupBy("part", "filter_order", "step").agg(
        total(F.expr("mask & (before | bit) = 0")).alias("kept"), total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"), total(F.expr("mask = bit")).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"), total(fails & ~earlier, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, orders_first).otherwise(0)).cast("long").alias("shapley"))
