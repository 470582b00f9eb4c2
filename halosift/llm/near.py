"""Near-duplicates by a chosen-path set similarity join.

A document's set is its distinct shingles of ``WORDS`` words, as 64-bit
hashes. Documents with equal sets form one class at once; the rest works on
classes. A signature holds ``COORDINATES`` minwise tokens of the set. Each of
``TREES`` trees sends a class to the node named by one of its minwise tokens;
a node of more than ``SMALL`` classes, or of more than ``WEIGHT`` shingles in
all its sets, is branched again by two tokens, chosen by the path that leads
there, and so on; smaller nodes are compared exhaustively. A pair at the threshold meets in one tree with a
probability of about 0.75 or more, so ten independent trees miss it about once
in a million times, and the comparison of signatures about once in a hundred
thousand times. Every link is confirmed on full sets.

Pairs already known to be connected are never compared again: a node whose
classes all have one label is done. In a large node pivots are compared with
all its classes first and then leave it. So a group of thousands of near
copies costs a few comparisons for each copy and not for each pair, and no
link between different labels is given up.

Null and empty texts have no set and are linked with nothing. Rows with the
same doc_id count as one document; rows without a doc_id are linked with
nothing, their component is null and they stay. Other columns, whatever their
names, are handed through by `drop_near_copies`. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halosift.llm import words as W
from halosift.llm.batches import add_struct
from halosift.llm.graph import stars, tidy
from halosift.llm.tables import fitted, pin, spread

WORDS, PERCENT = 5, 75
COORDINATES, TREES, SMALL = 64, 10, 8192
#: Fewest equal coordinates of a pair that is confirmed on full sets; 32 of 64 is four and
#: a half standard deviations below what a pair at the threshold has.
AGREEING = 32
#: Shingles (8 bytes each) in the sets of a node that one task compares; in a heavier node pivots are compared,
#: pair by pair. Two classes make no node heavy beyond their own sets, since all its classes are pivots then.
WEIGHT = 1 << 23
#: Shingles of sets that a set is compared with at once.
AT_ONCE = 1 << 20
#: The name of a set, of the columns of its marks.
NAME = "xxhash64(hi, lo, n)"
#: At most so many ids (8 bytes each) are broadcast to pick texts; more are joined by a shuffle.
IDS_AT_MOST = 1_000_000
#: Rows of a task where a table is only grouped. Where nodes are compared, rows are no measure of the work; they are dealt over all partitions.
PER_TASK = 20_000

MARKS = "n bigint, hi bigint, lo bigint, sig array<int>"


def shingles(t: W.Texts, size: int = WORDS) -> Iterator[np.ndarray]:
    """The distinct shingles of each row, sorted."""
    t = t.lower()
    w = W.words(t, W.NOT_SPACE)
    h = W.span_hashes(t.data, w.start, w.end)
    win, first = W.window_hashes(h, w.at, size)
    cut = np.searchsorted(first, w.at)
    for r in range(t.rows):
        n = w.at[r + 1] - w.at[r]
        if n >= size:
            yield np.unique(win[cut[r]:cut[r + 1]])
        elif n:
            yield W.window_hashes(h[w.at[r]:w.at[r + 1]], np.array([0, n]), int(n))[0]
        else:
            yield np.zeros(0, np.uint64)


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    a = W.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    return a, W.mix(a) | np.uint64(1)


def _name(s: np.ndarray) -> tuple[int, int, int]:
    """Size of a set and two hashes of it."""
    if not len(s):
        return 0, 0, 0
    a = W.mix(s)
    return len(s), int(np.bitwise_xor.reduce(a)), int(a.sum(dtype=np.uint64))


def _whole(x: list[int]) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def _marks(size: int) -> Callable[[], Callable[[dict], dict]]:
    def make():
        flip, factor = _seeds()

        def work(batch: dict) -> dict:
            n, hi, lo, sig = [], [], [], []
            for t in W.texts_of(batch["text"]):
                for s in shingles(t, size):
                    for x, own in zip((n, hi, lo), _name(s)):
                        x.append(own)
                    if not len(s):
                        sig.append(None)
                        continue
                    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
                    for at in range(0, len(s), 8192):
                        part = (s[at:at + 8192, None] ^ flip[None, :]) * factor[None, :]
                        np.minimum(least, part.min(axis=0), out=least)
                    sig.append((least >> np.uint64(32)).astype(np.uint32).view(np.int32))
            return {"n": np.array(n, np.int64), "hi": _whole(hi), "lo": _whole(lo), "sig": pa.array(sig, pa.list_(pa.int32()))}
        return work
    return make


def _runs(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold whole nodes, of a stream sorted by its first column."""
    rest: list[pa.RecordBatch] = []
    for batch in stream:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1]))  # the last node may go on
        if last:
            yield pa.Table.from_batches([*rest, batch.slice(0, last)])
            rest = [batch.slice(last)]
        elif rest and rest[-1].column(0)[0].as_py() != key[0]:
            yield pa.Table.from_batches(rest)
            rest = [batch]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


def _groups(table: pa.Table) -> Iterator[tuple[int, int]]:
    key = table.column(0).to_numpy()
    cut = np.flatnonzero(np.diff(key)) + 1
    yield from zip([0, *cut.tolist()], [*cut.tolist(), len(key)])


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)


def _sets(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The sets of some rows one after another, and where each begins."""
    every, size = [], []
    for chunk in column.chunks:
        at = np.frombuffer(chunk.buffers()[1], np.int32, len(chunk) + 1, 4 * chunk.offset)
        every.append(np.frombuffer(chunk.buffers()[2], np.uint8)[at[0]:at[-1]].view(np.uint64))
        size.append(np.diff(at) // 8)
    return np.concatenate(every), np.concatenate([[0], np.cumsum(np.concatenate(size), dtype=np.int64)])


def _equal(sig: np.ndarray, rest: np.ndarray, i: int) -> np.ndarray:
    """In how many coordinates each of the rows ``rest`` (ascending) equals row i."""
    some = sig[rest] if rest[-1] - rest[0] >= len(rest) else sig[rest[0]:rest[-1] + 1]
    return np.bitwise_count(np.packbits(some == sig[i], axis=1).view(np.uint64)).sum(axis=1, dtype=np.int64)


def _with_partner(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (node, id, label, sig): the rows with a partner in their node worth confirming."""
    for table in _runs(stream):
        label, sig = table["label"].to_numpy(), _signatures(table["sig"])
        keep = np.zeros(len(label), bool)
        for a, b in _groups(table):
            for i in range(a, b - 1):
                other = label[i + 1:b] != label[i]
                rest = np.flatnonzero(other & ~keep[i + 1:b] if keep[i] else other) + i + 1  # two rows that stay already need no look
                if len(rest) and len(close := rest[_equal(sig, rest, i) >= AGREEING]):
                    keep[i] = keep[close] = True
        yield from table.filter(pa.array(keep)).combine_chunks().to_batches()


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def shared(one: np.ndarray, every: np.ndarray, at: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of a sorted set with the sets every[at[k]:at[k+1]] for k in ``which``."""
    size = at[which + 1] - at[which]
    begin = np.cumsum(size) - size
    values = every[np.repeat(at[which] - begin, size) + np.arange(size.sum())]
    place = np.minimum(np.searchsorted(one, values), len(one) - 1)
    return np.add.reduceat((one[place] == values).astype(np.int64), begin)


def _confirm(percent: int):
    def node(label: np.ndarray, sig: np.ndarray, every: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links (i, j) that join different labels; set i is every[at[i]:at[i+1]]. What is connected already is not compared again."""
        own, size = label.copy(), np.diff(at)
        for i in range(len(own) - 1):
            big, less = np.maximum(size[i + 1:], size[i]), np.minimum(size[i + 1:], size[i])
            j = np.flatnonzero((own[i + 1:] != own[i]) & (100 * less >= percent * big)) + i + 1
            if not len(j):
                continue
            equal = _equal(sig, j, i)
            j, equal = j[equal >= AGREEING], equal[equal >= AGREEING]
            j = j[np.argsort(-equal, kind="stable")]
            step = 2
            while len(j):
                take = max(1, min(step, int(np.searchsorted(np.cumsum(size[j[:step]]), AT_ONCE, "right"))))
                now, j = j[:take], j[take:]
                both = shared(every[at[i]:at[i + 1]], every, at, now)
                for k in now[100 * both >= percent * (size[i] + size[now] - both)].tolist():
                    if own[k] != own[i]:
                        x, y = max(own[k], own[i]), min(own[k], own[i])
                        own[own == x] = y
                        yield i, k
                j = j[own[j] != own[i]]
                step = min(4 * step, 512)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of (node, id, label, sig, shingles): links that join different labels."""
        for table in _runs(stream):
            ids, label, sig = table["id"].to_numpy(), table["label"].to_numpy(), _signatures(table["sig"])
            left, right = [], []
            for a, b in _groups(table):
                if b - a > 1:
                    for i, j in node(label[a:b], sig[a:b], *_sets(table["shingles"].slice(a, b - a))):
                        left.append(ids[a + i])
                        right.append(ids[a + j])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
    return run


def _confirm_pairs(percent: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of (a, b, one set, other set): the pairs that are similar."""
        for batch in stream:
            keep = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent)
                    for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return run


def _near(table: DataFrame, rows: int) -> DataFrame:
    """A table to join with, broadcast if its rows are few."""
    return F.broadcast(table) if rows <= IDS_AT_MOST // 4 else table


class Join:
    """One run of the join over the classes of some documents."""

    def __init__(self, docs: DataFrame, size: int, percent: int, trees: int, small: int, weight: int):
        self.texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
        self.spark, self.parts = docs.sparkSession, spread(docs)
        self.size, self.percent, self.trees, self.small, self.weight = size, percent, trees, small, weight
        marked = add_struct(self.texts, "m", MARKS, _marks(size), {"text": "text"}).select("id", "m.*")
        self.marks = pin(marked)
        own = self.marks.filter("n > 0 AND id IS NOT NULL")
        rows = own.count()
        self.classes = pin(fitted(own.groupBy("hi", "lo", "n").agg(
            F.min("id").alias("id"), F.count("*").alias("copies"), F.first("sig").alias("sig")).withColumn("name", F.expr(NAME)), rows, PER_TASK))
        self.count = self.classes.count()
        of = self.classes.filter("copies > 1").select("hi", "lo", "n", F.col("id").alias("b"))
        #: Documents whose set a smaller doc_id has. They need no other links, unless a document has several sets (a repeated id).
        self.copies = tidy(own.select("hi", "lo", "n", F.col("id").alias("a")).join(_near(of, of.count()), ["hi", "lo", "n"]).select("a", "b"), rows)
        #: Such a document has one label and several classes, told apart by the set's name; its sets are all compared.
        firsts = fitted(self.classes.select(F.col("id").alias("a")).distinct(), self.count, PER_TASK)
        several = self.copies.select("a").unionAll(firsts).groupBy("a").count().filter("count > 1").select("a")
        several = pin(fitted(several, rows, PER_TASK))
        self.links, self.labels, self.linked = [], None, 0
        if found := several.count():
            self._learn(self.copies.join(_near(several, found), "a", "left_semi"))

    def _labelled(self, rows: DataFrame) -> DataFrame:
        if not self.linked:
            return rows.withColumn("label", F.col("id"))
        return rows.join(_near(self.labels, self.linked), "id", "left").withColumn("label", F.coalesce("label", "id"))

    def _live(self, rows: DataFrame, about: int) -> dict[bool, tuple[DataFrame, int]]:
        """Rows (node, id, name, n, label, sig) of nodes that hold more than one label and their number; by whether the nodes are large."""
        rows = self._labelled(rows)
        nodes = rows.groupBy("node").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        large = (F.col("size") > self.small) | (F.col("weight") > self.weight)
        nodes = pin(fitted(nodes.filter("lo < hi").select("node", "size", large.alias("large")), about, PER_TASK))
        live = {}
        for kind, count, size in nodes.groupBy("large").agg(F.count("*"), F.sum("size")).collect():
            chosen = nodes.filter("large" if kind else "NOT large").select("node")
            live[kind] = rows.join(_near(chosen, count), "node").select("node", "id", "name", "n", "label", "sig"), size
        return live

    def _with_sets(self, rows: DataFrame, about: int, *classes: str) -> DataFrame:
        """About so many ``rows`` with the full sets of the classes (structs of id and name) in these columns, as set_<column>."""
        wanted = rows.select(F.explode(F.array(*[F.col(f"{c}.id") for c in classes])).alias("id")).distinct()
        wanted = pin(fitted(wanted, about, PER_TASK))
        few = wanted.count() <= IDS_AT_MOST
        texts = self.texts.join(F.broadcast(wanted) if few else wanted, "id", "left_semi")
        size = self.size

        def make():
            def work(batch: dict) -> dict:
                sets = [s for t in W.texts_of(batch["text"]) for s in shingles(t, size)]
                n, hi, lo = zip(*map(_name, sets)) if sets else ((), (), ())
                return {"s": pa.array([s.tobytes() for s in sets], pa.binary()),
                        "n": np.array(n, np.int64), "hi": _whole(hi), "lo": _whole(lo)}
            return work

        made = add_struct(texts, "x", "s binary, n bigint, hi bigint, lo bigint", make, {"text": "text"}).select("x.*")
        sets = made.select(F.expr(NAME).alias("name"), "s").dropDuplicates(["name"])  # an id may have several, and equal ones
        if len(classes) > 1:
            sets = pin(sets)
        for c in classes:
            own = sets.select(F.col("name").alias("_name"), F.col("s").alias(f"set_{c}"))
            rows = rows.join(own, F.col(f"{c}.name") == F.col("_name")).drop("_name")
        return rows

    def _by_node(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.parts, "node").sortWithinPartitions("node", "id", "name")

    def _small(self, rows: DataFrame, about: int) -> DataFrame:
        """Links within nodes that are small enough to compare exhaustively."""
        rows = self._by_node(rows.select("node", "id", "name", "label", "sig"))
        close = pin(rows.mapInArrow(_with_partner, rows.schema))
        full = self._with_sets(close.withColumn("own", F.struct("id", "name")), about, "own")
        full = full.select("node", "id", "name", "label", "sig", F.col("set_own").alias("shingles"))
        return self._by_node(full).mapInArrow(_confirm(self.percent), "a bigint, b bigint")

    def _pivots(self, rows: DataFrame, about: int, level: int) -> tuple[DataFrame, DataFrame]:
        """Links of large nodes with their pivots; and the pivots (node, name)."""
        me = F.struct("id", "name", "label", "sig")
        draw = F.xxhash64("node", "id", F.lit(level))
        picked = rows.groupBy("node").agg(
            F.array(F.min_by(me, draw), F.max_by(me, draw), F.min_by(me, "label"), F.max_by(me, F.struct("label", "id"))).alias("p"))
        picked = pin(picked.select("node", F.explode(F.array_distinct("p")).alias("p")))
        pairs = rows.join(picked, "node").filter("label <> p.label")
        equal = F.aggregate(F.zip_with("sig", "p.sig", lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)
        one, two = F.struct("id", "name"), F.struct(F.col("p.id").alias("id"), F.col("p.name").alias("name"))
        pairs = pairs.filter(equal >= AGREEING).select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).distinct()
        full = self._with_sets(pin(pairs), about, "a", "b").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "set_a", "set_b")
        return full.mapInArrow(_confirm_pairs(self.percent), "a bigint, b bigint"), picked.select("node", "p.name")

    def _learn(self, *links: DataFrame) -> None:
        self.links = [tidy(reduce(DataFrame.unionByName, [*self.links, *links]), self.count)]  # its exchange makes few files of many tasks' few links
        ends, self.linked = stars(self.links[0])
        self.labels = ends.select(F.col("a").alias("id"), F.col("b").alias("label"))  # others are their own label

    def roots(self, trees: range) -> DataFrame:
        node = F.xxhash64(F.lit("root"), F.col("tree"), F.element_at("sig", F.col("tree") + 1))
        rows = self.classes.select("id", "name", "n", "sig", F.explode(F.lit(list(trees))).alias("tree"))
        return rows.select(node.alias("node"), "id", "name", "n", "sig")

    def _children(self, rows: DataFrame) -> DataFrame:
        one = F.pmod(F.xxhash64("node", F.lit("one")), F.lit(COORDINATES))
        two = F.pmod(one + 1 + F.pmod(F.xxhash64("node", F.lit("two")), F.lit(COORDINATES - 1)), F.lit(COORDINATES))
        child = lambda c: F.xxhash64("node", c, F.element_at("sig", (c + 1).cast("int")))
        return rows.select(F.explode(F.array(child(one), child(two))).alias("node"), "id", "name", "n", "sig")

    def _descend(self, rows: DataFrame, about: int, levels: int | None) -> bool:
        """Whether the levels were enough: then no pair of these trees needs another look."""
        level = 0
        while live := self._live(rows, about):
            found = [self._small(*live[False])] if False in live else []
            if True in live:
                large, about = pin(live[True][0]), 2 * live[True][1]
                links, pivots = self._pivots(large, about, level)
                found.append(links)
            self._learn(*found)
            level += 1
            if True not in live:
                return True
            if level == levels:
                return False
            rows = self._children(large.join(pivots, ["node", "name"], "left_anti"))
        return True

    def run(self) -> tuple[DataFrame, int]:
        """(id, label) of every document with a link, and how many they are."""
        done = self._descend(self.roots(range(1)), self.count, 1)  # the first tree finds most links and so saves the others most work
        self._descend(self.roots(range(int(done), self.trees)), self.trees * self.count, None)
        copies = self._labelled(self.copies.withColumnRenamed("b", "id"))
        found = copies.select(F.explode(F.array(F.struct(F.col("a").alias("id"), "label"), F.struct("id", "label"))).alias("x"))
        if self.linked:
            ends = F.array(F.struct("id", "label"), F.struct(F.col("label").alias("id"), "label"))
            found = found.unionByName(self.labels.select(F.explode(ends).alias("x")))
        labels = pin(fitted(found.select("x.*").groupBy("id").agg(F.min("label").alias("label")), self.count, PER_TASK))
        return labels, labels.count()


def link(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, trees: int = TREES,
         small: int = SMALL, weight: int = WEIGHT) -> tuple[DataFrame, DataFrame]:
    """Marks (id, n, ...) of all rows, and (id, label) of the ids with a link, broadcast if they are few."""
    join = Join(docs, size, percent, trees, small, weight)
    return join.marks, _near(*join.run())


def report(docs: DataFrame, **how) -> DataFrame:
    marks, labels = link(docs.select("doc_id", "text"), **how)
    label = F.coalesce("label", "id")
    return marks.join(labels, "id", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), label.alias("component_id"),
        F.coalesce(F.col("id") == label, F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, **how) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id; columns as they were."""
    _, labels = link(docs.select("doc_id", "text"), **how)
    gone = labels.filter("id > label").select(F.col("id").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
