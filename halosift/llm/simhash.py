"""Near-duplicates of SimHash fingerprints by anchor points of a covering code.

A fingerprint has 64 bits; a bit is set if it is set in over half the XXH64 hashes
(seed 42) of a text's shingles, repeats included. Fingerprints link at ``BITS`` or
fewer differing bits.

The fingerprint is cut into three blocks, each a word of the binary Golay code's
23 bits. That code is perfect: every word is within 3 bits of exactly one code
word. An anchor is a pick of ``depth`` blocks with a code word for each, so the
anchors of one pick cover all fingerprints with radius 3 a block. A fingerprint is
at home at the anchor it is within the radius of, and it visits all anchors of
which it exceeds the radius by no more bits in all than ``depth`` thirds of
``BITS``. Of two fingerprints at the threshold, some pick of blocks holds no more
than that share of the differing bits; there the one visits the other's home. So
comparing those at home with the visitors, for each anchor, finds every link.

A fingerprint goes to some 16 anchors at depth 1 (3 * 2^12 anchors) and to some
180 at depth 2 (3 * 2^24 anchors). The comparisons at an anchor grow with the
square of the rows, so depth 2 is taken from ``DEEP`` fingerprints on; both give
the same links. Anchors with more than ``ROWS`` fingerprints are dealt out in
tiles, each a part of those at home with a part of the visitors, so no task holds
a whole hot anchor. In a tile only links that join different groups are given out,
and what is joined already is not compared again.

Equal fingerprints are one row from the start, so a text that a third of all rows
hold costs one comparison. Null and empty texts have fingerprint zero and are
linked like any other. Rows with the same doc_id count as one document, whatever
their texts; rows without a doc_id keep their fingerprint, are linked with
nothing and have no component. Texts of any length are hashed in runs of bounded
memory. An empty table gives an empty result. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halosift.llm import words as W
from halosift.llm.batches import add_struct
from halosift.llm.graph import components
from halosift.llm.near import _groups, _runs
from halosift.llm.tables import pin, send, spread

WORDS, BITS, SEED = 4, 4, 42
DEEP = 1 << 24
ROWS = 4096
#: A fingerprint that more than one in so many rows have is looked up by broadcast; there are at most so many of them.
HOT = 20_000
_AT_ONCE = 1 << 15  # shingles whose bits are counted together

# Golay code of 23 bits: its generator polynomial, radius, and how fingerprints are cut.
GENERATOR, LENGTH, CHECKS, RADIUS = 0xC75, 23, 11, 3
BLOCKS = ((0, 22), (22, 21), (43, 21))  # first bit, bits


# --- fingerprints ----------------------------------------------------------------------


def _joined(t: W.Texts) -> tuple[bytes, np.ndarray, np.ndarray, W.Spans]:
    """The texts with one space between words, and where the words are in them."""
    w = W.words(t, W.NOT_SPACE)
    keep = W.NOT_SPACE[t.data]
    after = w.end[w.end < len(t.data)]
    keep[after] = True  # the byte after a word: white space, or the next text's first letter
    place = np.concatenate([[0], np.cumsum(keep)])
    data = np.where(W.SPACE[t.data], np.uint8(32), t.data)[keep]
    return data.tobytes(), place[w.start], place[w.start] + (w.end - w.start), w


def fingerprints(t: W.Texts, size: int = WORDS) -> np.ndarray:
    """One unsigned 64-bit fingerprint for each row."""
    from xxhash import xxh64_intdigest

    data, start, end, w = _joined(t.lower())
    n = np.where(w.counts > 0, np.maximum(w.counts - size + 1, 1), 0)  # shingles of each row
    row = np.repeat(np.arange(t.rows), n)
    first = w.at[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]
    last = np.minimum(first + size, w.at[row + 1]) - 1
    ones = np.zeros((t.rows, 64), np.int64)
    for i in range(0, len(row), _AT_ONCE):
        now = slice(i, i + _AT_ONCE)
        spans = zip(start[first[now]].tolist(), end[last[now]].tolist())
        h = np.fromiter((xxh64_intdigest(data[a:b], SEED) for a, b in spans), np.uint64, len(row[now]))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own, begin = np.unique(row[now], return_index=True)
        ones[own] += np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)


def _marks(size: int) -> Callable[[], Callable[[dict], dict]]:
    def make():
        def work(batch: dict) -> dict:
            got = [fingerprints(t, size) for t in W.texts_of(batch["text"])]
            return {"fp": W.signed(np.concatenate(got)) if got else np.zeros(0, np.int64)}
        return work
    return make


# --- anchors ---------------------------------------------------------------------------


class Anchors:
    """The anchors of ``depth`` blocks that a fingerprint is at home at or visits."""

    def __init__(self, depth: int, bits: int = BITS):
        self.picks = list(combinations(range(len(BLOCKS)), depth))
        self.beyond = depth * bits // len(BLOCKS)
        every = np.arange(1 << LENGTH, dtype=np.int64)
        error = every[np.bitwise_count(every) <= RADIUS + self.beyond]
        rest, weight = self.remainder(error), np.bitwise_count(error).astype(np.int64)
        over = np.maximum(weight - RADIUS, 0)
        order = np.lexsort((error, over, rest))
        self.error, self.over = error[order], over[order]
        #: upto[r, x]: end of the errors with remainder r that exceed the radius by at most x
        key = rest[order] * (self.beyond + 1) + self.over
        self.upto = np.searchsorted(key, np.arange((self.beyond + 1) << CHECKS), "right").reshape(-1, self.beyond + 1)
        self.begin = np.concatenate([[0], self.upto[:-1, -1]])

    @staticmethod
    def remainder(word: np.ndarray) -> np.ndarray:
        """Of the words as polynomials, divided by the generator: zero for code words."""
        word = word.copy()
        for bit in range(LENGTH - 1, CHECKS - 1, -1):
            word ^= ((word >> bit) & 1) * (GENERATOR << (bit - CHECKS))
        return word

    def of(self, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, anchor, whether at home) for each pick of blocks."""
        cut = [((fp >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in BLOCKS]
        rest = [self.remainder(x) for x in cut]
        for number, pick in enumerate(self.picks):
            row = np.arange(len(fp))
            anchor, over = np.full(len(fp), number, np.int64), np.zeros(len(fp), np.int64)
            for b in pick:
                r = rest[b][row]
                begin = self.begin[r]
                many = self.upto[r, self.beyond - over] - begin
                at = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())
                row, anchor, over = (np.repeat(x, many) for x in (row, anchor, over))
                anchor = (anchor << (LENGTH - CHECKS)) | ((cut[b][row] ^ self.error[at]) >> CHECKS)
                over = over + self.over[at]
            yield row, anchor, over == 0


def _send_out(anchors: Callable[[], Anchors]):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of (fp, id): a row for each anchor."""
        code = None
        for batch in stream:
            code = code or anchors()
            fp = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(fp), 2048):
                part = batch.slice(i, 2048)
                for row, anchor, home in code.of(fp[i:i + 2048]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(home)],
                        names=["anchor", "fp", "id", "home"])
    return run


def _tiled(rows: DataFrame) -> DataFrame:
    """(place, fp, id, home, visits): anchors with many rows go to several places."""
    half = ROWS // 2
    heavy = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("long")).alias("homes")).filter(F.col("n") > ROWS).select(
        "anchor", F.ceil(F.greatest("homes", F.lit(1)) / half).cast("int").alias("across"), F.ceil(F.col("n") / half).cast("int").alias("down"))
    rows = rows.join(pin(heavy), "anchor", "left")
    own = lambda n, salt: F.pmod(F.xxhash64("fp", F.lit(salt)), F.col(n)).cast("int")
    tile = lambda a, d, home, visits: F.struct(
        F.xxhash64("anchor", a, d).alias("place"), F.lit(home).alias("home"), F.lit(visits).alias("visits"))
    at_home = F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda d: tile(own("across", 1), d, True, False))
    visiting = F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda a: tile(a, own("down", 2), False, True))
    whole = F.array(F.struct(F.xxhash64("anchor").alias("place"), F.col("home"), F.lit(True).alias("visits")))
    places = F.when(F.col("across").isNull(), whole).when(F.col("home"), F.concat(at_home, visiting)).otherwise(visiting)
    return rows.select("fp", "id", F.explode(places).alias("t")).select("t.place", "fp", "id", "t.home", "t.visits")


def linked(fp: np.ndarray, home: np.ndarray, visits: np.ndarray, bits: int) -> Iterator[tuple[int, int]]:
    """Links (i, j) of those at home with visitors that join all that is connected by them."""
    group = np.unique(fp, return_inverse=True)[1].astype(np.int64)  # a fingerprint in both roles is one
    left, seen = np.flatnonzero(home), np.flatnonzero(visits)
    while len(left):
        left = left[np.argsort(group[left], kind="stable")]
        now, left = left[:64], left[64:]
        other = seen[group[seen] != group[now[0]]] if group[now[0]] == group[now[-1]] else seen
        close = np.bitwise_count(fp[now][:, None] ^ fp[other][None, :]) <= bits
        for k in np.flatnonzero(close.any(axis=1)).tolist():
            i, near = now[k], other[close[k]]
            near = near[group[near] != group[i]]
            if len(near):
                joined, one_of = np.unique(group[near], return_index=True)
                yield from ((i, j) for j in near[one_of].tolist())
                group[np.isin(group, joined)] = group[i]


def _compare(bits: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of (place, fp, id, home, visits), sorted by place: links of ids."""
        for table in _runs(stream):
            fp = table["fp"].to_numpy().view(np.uint64)
            ids, home, visits = (table[c].to_numpy() for c in ("id", "home", "visits"))
            found = [(a + i, a + j) for a, b in _groups(table) if b - a > 1 and home[a:b].any()
                     for i, j in linked(fp[a:b], home[a:b], visits[a:b], bits)]
            if found:
                i, j = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], names=["a", "b"])
    return run


def near_pairs(classes: DataFrame, bits: int = BITS, depth: int | None = None) -> DataFrame:
    """Of (fp, id), one row for each fingerprint: links (a, b) of ids that connect what is within ``bits`` bits."""
    spark = classes.sparkSession
    if depth is None:
        depth = 1 if classes.count() < DEEP else 2
    rows = classes.select("fp", "id").repartition(spread(classes)).mapInArrow(
        _send_out(send(spark, Anchors(depth, bits))), "anchor bigint, fp bigint, id bigint, home boolean")
    placed = _tiled(rows).repartition(spread(classes), "place").sortWithinPartitions("place")
    return placed.mapInArrow(_compare(bits), "a bigint, b bigint")


# --- components ------------------------------------------------------------------------


def _component_of(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (id, fp) with the component of their fingerprint, from (fp, n, component).

    Fingerprints of very many rows are few and go by broadcast; their rows need no shuffle by fingerprint."""
    total = found.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * HOT > total
    hot = found.filter(often).select("fp", F.col("component").alias("hot"))
    cold = found.filter(~often).select(F.col("fp").alias("key"), F.lit(True).alias("cold"), "component")
    rows = rows.join(F.broadcast(hot), "fp", "left").withColumn("cold", F.col("hot").isNull())
    rows = rows.withColumn("key", F.when(F.col("cold"), F.col("fp")).otherwise(F.xxhash64("id", F.monotonically_increasing_id())))
    return rows.join(cold, ["key", "cold"], "left").select(
        "id", "fp", F.when(F.col("id").isNotNull(), F.coalesce("hot", "component")).alias("component"))


def link(docs: DataFrame, size: int = WORDS, bits: int = BITS, depth: int | None = None) -> DataFrame:
    """(id, fp, component) of every row; fp as a signed integer."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    marked = pin(add_struct(texts, "m", "fp bigint", _marks(size), {"text": "text"}).select("id", "m.fp"))
    known = marked.filter("id IS NOT NULL")
    classes = pin(known.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    # a document of several fingerprints joins their classes
    several = known.groupBy("id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo < hi").select("id")
    repeated = known.join(several, "id").join(classes.select("fp", F.col("id").alias("b")), "fp").select(F.col("id").alias("a"), "b")
    labels = components(pin(near_pairs(classes, bits, depth).unionByName(repeated)))
    found = pin(classes.join(labels, "id", "left").select("fp", "n", F.coalesce("label", "id").alias("component")))
    return _component_of(marked, found)


def report(docs: DataFrame, **how) -> DataFrame:
    return link(docs, **how).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
