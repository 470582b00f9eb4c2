"""Benchmark decontamination by Wu-Manber search over words.

A pattern is a window of ``size`` consecutive item words (an item of fewer
words is one pattern). The symbols are words, as 64-bit hashes; a block is two
words. The shift table says how far a window may move on when a given block
ends it; most blocks are in no pattern, so nearly all of a text is skipped in
steps of ``size - 1`` words. Where the shift is 0, the hash of the last block
selects the patterns of one bucket, and every word of them is compared. Many
places of a text (``STRIDE`` window ends each) are searched together.

Items travel to the tasks in blocks of at most ``block_bytes``, so what is
broadcast is bounded; further blocks mean further passes over the texts.

Null and empty texts and items have no words: they are hit by nothing and hit
nothing. Items without an item_id hit like others; together they count as one item, which
has no part in the names. Repeated items all count; repeated documents are judged alike. Other
columns, whatever their names, are handed through by `find`. An empty
benchmark hits nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halosift.llm import words as W
from halosift.llm.batches import add_struct, fresh
from halosift.llm.tables import pin, send

WINDOW = 10  # words
BLOCK_BYTES = 32 << 20  # of item texts that are broadcast at once
STRIDE = 64
TABLE_BITS = 20
_ONE, _TWO = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xD6E8FEB86659FD93)

FOUND = "n_words bigint, hits array<int>, items array<string>"


class Patterns:
    """Patterns of one length with their shift table and suffix buckets."""

    def __init__(self, patterns: np.ndarray, at: np.ndarray, items: np.ndarray, names: list[str | None]):
        """Pattern k is a window of the items ``names[items[at[k]:at[k + 1]]]``."""
        m = patterns.shape[1]
        self.length, self.block = m, min(2, m)
        last = self._blocks(patterns, m - 1)
        order = np.argsort(last, kind="stable")
        self.patterns, self.last = patterns[order], last[order]
        self.begin, self.end, self.items, self.names = at[:-1][order], at[1:][order], items, names
        self.longest = m - self.block + 1
        self.shift = np.full(1 << TABLE_BITS, self.longest, np.uint8)
        for end in range(self.block - 1, m):
            np.minimum.at(self.shift, self._slot(self._blocks(patterns, end)), m - 1 - end)

    def owners(self, pattern: int) -> list[str | None]:
        return [self.names[i] for i in self.items[self.begin[pattern]:self.end[pattern]]]

    def _blocks(self, rows: np.ndarray, end: int) -> np.ndarray:
        return self.hash_of(rows[:, end - 1] if self.block == 2 else rows[:, end], rows[:, end])

    @staticmethod
    def hash_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a * _ONE + b * _TWO

    @staticmethod
    def _slot(block: np.ndarray) -> np.ndarray:
        return (block >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words and pattern numbers of all occurrences; row i has words at[i]:at[i+1]."""
        m, back = self.length, self.block - 1
        low, high = at[:-1] + m - 1, at[1:]
        pieces = np.maximum(0, -(-(high - low) // STRIDE))
        row = np.repeat(np.arange(len(low)), pieces)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        pos = low[row] + nth * STRIDE
        end = np.minimum(pos + STRIDE, high[row])
        ends, marks = [], []
        while len(pos):
            block = self.hash_of(h[pos - back], h[pos])
            step = self.shift[self._slot(block)]
            zero = step == 0
            if zero.any():
                ends.append(pos[zero])
                marks.append(block[zero])
            pos = pos + np.maximum(step, 1)
            live = pos < end
            pos, end = pos[live], end[live]
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends, marks = np.concatenate(ends), np.concatenate(marks)
        a, b = np.searchsorted(self.last, marks), np.searchsorted(self.last, marks, "right")
        # a bucket at a time in each step, so places in a full bucket do not multiply in memory
        first, which, nth = [], [], 0
        while True:
            more = a + nth < b
            if not more.any():
                break
            a, b, ends = a[more], b[more], ends[more]
            e, p = ends, a + nth
            for back in range(m):
                same = self.patterns[p, m - 1 - back] == h[e - back]
                e, p = e[same], p[same]
            first.append(e - m + 1)
            which.append(p)
            nth += 1
        if not first:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(first), np.concatenate(which)


def compile_items(ids: list, texts: list, size: int) -> list[Patterns]:
    """Search tables for the windows of some items, one for each length. Windows are rows of hashes, never objects."""
    names = list(dict.fromkeys(ids))
    number = {n: k for k, n in enumerate(names)}
    by_length: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
    for t in W.texts_of(pa.array(texts, pa.string())):
        item = np.array([number[i] for i in ids[t.first:t.first + t.rows]], np.int64)
        t = t.lower()
        w = W.words(t, W.ALNUM)
        h = W.span_hashes(t.data, w.start, w.end)
        length = np.minimum(w.counts, size)
        for n in np.unique(length[length > 0]).tolist():
            rows = np.flatnonzero(length == n)
            many = w.counts[rows] - n + 1
            first = np.repeat(w.at[rows] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            by_length[n].append((h[first[:, None] + np.arange(n)], np.repeat(item[rows], many)))
    out = []
    for n, parts in sorted(by_length.items()):
        windows, item = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((item, *windows.T[::-1]))
        windows, item = windows[order], item[order]
        new = np.ones(len(item), bool)
        new[1:] = (windows[1:] != windows[:-1]).any(axis=1)
        own = new.copy()
        own[1:] |= item[1:] != item[:-1]
        at = np.append(np.cumsum(own)[new] - 1, own.sum())
        out.append(Patterns(windows[new], at, item[own], names))
    return out


def _in_order(items: set) -> list:
    """Names sorted, the missing one last."""
    return sorted(items, key=lambda i: (i is None, i or ""))


def _searcher(tables: list[Patterns], again: bool) -> Callable[[], Callable[[dict], dict]]:
    def make():
        def work(batch: dict) -> dict:
            counts, hits, items = [], [], []
            for t in W.texts_of(batch["text"]):
                t = t.lower()
                w = W.words(t, W.ALNUM)
                h = W.span_hashes(t.data, w.start, w.end)
                counts.append(w.counts)
                change = np.zeros(len(h) + 1, np.int64)
                named: dict[int, set[str]] = defaultdict(set)
                for p in tables:
                    first, which = p.search(h, w.at)
                    np.add.at(change, first, 1)
                    np.add.at(change, first + p.length, -1)
                    rows = np.searchsorted(w.at, first, "right") - 1
                    for r, k in set(zip(rows.tolist(), which.tolist())):
                        named[r].update(p.owners(k))
                hit = np.flatnonzero(np.cumsum(change[:-1]) > 0)
                cut = np.searchsorted(hit, w.at)
                for r in range(t.rows):
                    hits.append((hit[cut[r]:cut[r + 1]] - w.at[r]).tolist())
                    items.append(_in_order(named[r]) if r in named else [])
            if again:  # what earlier passes found
                for r, old in enumerate(batch["found"].to_pylist()):
                    hits[r] = sorted({*hits[r], *old["hits"]})
                    items[r] = _in_order({*items[r], *old["items"]})
            return {"n_words": np.concatenate(counts) if counts else np.zeros(0, np.int64),
                    "hits": pa.array(hits, pa.list_(pa.int32())), "items": pa.array(items, pa.list_(pa.string()))}
        return work
    return make


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
         item_text: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """``docs`` with a struct column of words, hit words and items; and that column's name."""
    out = fresh(docs, "found")
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("string").alias("id"), F.col(item_text).alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    frame = docs
    for k in range(blocks):
        rows = items.filter(part == k).collect()  # about block_bytes
        sent = send(spark, compile_items([r.id for r in rows], [r.text for r in rows], size))

        def make(sent=sent, again=k > 0):
            return _searcher(sent(), again)()

        inputs = {"text": text} | ({"found": out} if k else {})
        if k:
            frame = pin(frame)
            new = fresh(frame, out)
            frame = add_struct(frame, new, FOUND, make, inputs).drop(out).withColumnRenamed(new, out)
        else:
            frame = add_struct(frame, out, FOUND, make, inputs)
    return frame, out


def report(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    got, f = find(docs.select("doc_id", "text"), benchmark, **how)
    return got.select(
        "doc_id", f"{f}.n_words", F.size(f"{f}.hits").cast("long").alias("n_hit"),
        F.size(f"{f}.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(f"{f}.items")), 256).alias("items_sha256"),
        (F.size(f"{f}.hits") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents in which no window of the benchmark occurs, columns as they were."""
    got, f = find(docs, benchmark, **how)
    return got.filter(F.size(f"{f}.hits") == 0).select(*docs.columns)
