"""Line dedup by pairwise alignment of documents.

A key is a run of whole lines: the fewest consecutive lines, from each line on
and also up to each line, that hold ``LEAST_WORDS`` words or more. Documents
that share a key overlap there. For a rare key (at most ``RARE`` documents)
every later document is aligned with every earlier one that holds it. For a key
of more documents the later ones are aligned with its first holder only, which
takes one pair for each document and not one for each pair of them. That loses
nothing: let two documents share a block of ``LEAST_WORDS`` words or more. A
line of it that is in no key from a line on within the block has that many
words before it there, so the key up to this line lies within the block. Every
line of the block is so in a key that both hold, and goes with that key's own
first holder.

Two documents are aligned by a patience diff on line hashes: lines that occur
once in both are anchors, their longest rising sequence is kept, the gaps
between them are aligned likewise, and equal neighbours join. Aligned blocks of
``LEAST_WORDS`` words or more are deleted from the later document (the larger
doc_id). A line is only deleted for an equal line of an earlier document, so
its first copy always stays. A key that sits in another place of the earlier
document (a moved passage, which one alignment cannot follow) is deleted too:
the pair shares it and it is long enough.

Lines are compared without white space at their ends. Lines without words are
part of no key; they go with a block that is deleted on both sides of them. A
document of which no word is left is dropped; documents that had no words stay
as they are, and so do rows without a doc_id. Rows with the same doc_id are
told apart by their text, the smaller one first; equal rows (same doc_id, same
text) are one document and are cut alike. An empty table gives an empty
result. Other columns, whatever their names, are handed through.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halosift.llm import words as W
from halosift.llm.batches import add_struct, fresh
from halosift.llm.tables import pin

LEAST_WORDS, RARE = 50, 4
HOT = 1000  # pairs of one earlier document that go to one task

LINES = "who bigint, lines array<bigint>, words array<int>, keys array<bigint>"


def trimmed(t: W.Texts, li: W.Spans, w: W.Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and words of every line without the white space at its ends."""
    a, b = np.searchsorted(w.start, li.start), np.searchsorted(w.start, li.end)
    filled = b > a
    start, end = li.start.copy(), li.start.copy()
    start[filled], end[filled] = w.start[a[filled]], w.end[b[filled] - 1]
    return start, end, b - a


def keys_of(hashes: np.ndarray, words: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(hash, first line, line after the last) of the keys of one document."""
    out = []
    filled = np.flatnonzero(words).tolist()  # lines without words are in no key
    add, count = hashes[filled].tolist(), words[filled].tolist()

    def take(i: int, j: int) -> None:
        h = 0
        for x in add[i:j + 1]:
            h = (h * 0x9E3779B97F4A7C15 + x) & 0xFFFFFFFFFFFFFFFF
        out.append((h, filled[i], filled[j] + 1))

    i = total = 0  # the first line whose key is not known, and the words from it on
    for j, n in enumerate(count):
        total += n
        if total >= least:
            while total >= least:
                take(i, j)
                total -= count[i]
                i += 1
        elif i:  # no key from a line on ends here; from the line before i on are the fewest that do
            take(i - 1, j)
    return out


def hashed(t: W.Texts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row: a hash of all its lines in order, and hash and words of each line."""
    w, li = W.words(t, W.NOT_SPACE), W.lines(t)
    start, end, count = trimmed(t, li, w)
    h = np.zeros(len(start), np.uint64)  # a line without words has hash 0
    h[count > 0] = W.span_hashes(t.data, start[count > 0], end[count > 0])
    for a, b in zip(li.at[:-1], li.at[1:]):
        place = np.arange(b - a, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        yield int(np.bitwise_xor.reduce(W.mix(h[a:b] + place)).view(np.int64)), h[a:b], count[a:b]


def _lines(least: int):
    def make():
        def work(batch: dict) -> dict:
            who, lines, words, keys = [], [], [], []
            for t in W.texts_of(batch["text"]):
                for own, h, count in hashed(t):
                    who.append(own)
                    lines.append(h.view(np.int64))
                    words.append(count.astype(np.int32))
                    keys.append(np.unique(np.array([k for k, _, _ in keys_of(h, count, least)], np.uint64)).view(np.int64))
            return {"who": np.array(who, np.int64), "lines": pa.array(lines, pa.list_(pa.int64())),
                    "words": pa.array(words, pa.list_(pa.int32())), "keys": pa.array(keys, pa.list_(pa.int64()))}
        return work
    return make


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs, ascending by the first, that also rises in the second."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(y)
            at.append(k)
        else:
            tops[pile], at[pile] = y, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned lines (i, j) with a[i] == b[j], rising in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i0, i1, j0, j1 = work.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 >= i1 or j0 >= j1:
            continue
        ca, cb = Counter(a[i0:i1]), Counter(b[j0:j1])
        place = {x: j for j, x in enumerate(b[j0:j1], j0) if cb[x] == 1}
        anchors = _rising([(i, place[x]) for i, x in enumerate(a[i0:i1], i0) if ca[x] == 1 and x in place])
        if not anchors:
            continue
        last = (i0, j0)
        for i, j in anchors:
            work.append((last[0], i, last[1], j))
            out.append((i, j))
            last = (i + 1, j + 1)
        work.append((last[0], i1, last[1], j1))
    return sorted(out)


def blocks(earlier: list[int], keys: set[int], later: list[int], words: list[int], least: int) -> list[int]:
    """Lines of ``later`` to delete for what it shares with ``earlier``, which holds ``keys``."""
    # lines without words (0) do not count as lines of the alignment
    x = [h for h in earlier if h]
    own = [i for i, n in enumerate(words) if n]
    y = [later[i] for i in own]
    n = [words[i] for i in own]
    found: set[int] = set()

    def take(run: list[int]) -> None:
        if sum(n[j] for j in run) >= least:
            found.update(run)

    run: list[int] = []
    prior = None
    for i, j in patience(x, y):
        if prior is not None and (i, j) == (prior[0] + 1, prior[1] + 1):
            run.append(j)
        else:
            take(run)
            run = [j]
        prior = (i, j)
    take(run)
    # keys that the alignment left, because they were moved or repeated
    for h, a, b in keys_of(np.array(y, np.uint64), np.array(n), least):
        if h in keys:
            found.update(range(a, b))
    gone = {own[j] for j in found}
    # lines without words between deleted ones
    out = set(gone)
    for p, q in zip(own, own[1:]):
        if p in gone and q in gone:
            out.update(range(p, q))
    return sorted(out)


def _align(least: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = 0xFFFFFFFFFFFFFFFF
        for batch in stream:
            lost = []
            for early, keys, late, words in zip(*(batch[c].to_pylist() for c in ("early", "keys", "late", "words"))):
                lost.append(blocks([h & mask for h in early], {h & mask for h in keys}, [h & mask for h in late], words, least))
            made = pa.RecordBatch.from_arrays([batch["id"], batch["who"], pa.array(lost, pa.list_(pa.int32()))], names=["id", "who", "lost"])
            yield made.filter(pa.array([bool(x) for x in lost], pa.bool_()))
    return run


def overlaps(lines: DataFrame, rare: int = RARE) -> DataFrame:
    """Pairs (early, late) of documents (id, who) that share a key."""
    me = F.struct("id", "who").alias("me")
    held = pin(lines.select(me, F.explode("keys").alias("key")).distinct())
    first = held.groupBy("key").agg(F.min("me").alias("early"), F.count("*").alias("n")).filter("n > 1")
    shared = pin(held.join(first, "key").filter("me > early OR n <= %d" % rare))
    star = shared.filter("me > early").select("early", F.col("me").alias("late"))
    few = shared.filter(F.col("n").between(3, rare)).select("key", "me")
    more = few.select("key", F.col("me").alias("early")).join(few.select("key", F.col("me").alias("late")), "key").filter("early < late")
    return pin(star.unionByName(more.select("early", "late")).distinct())


def lost_lines(docs: DataFrame, least: int = LEAST_WORDS, rare: int = RARE) -> DataFrame:
    """(id, who, lost): numbers of the lines to delete, for documents that lose any."""
    rows = docs.select(F.col("doc_id").alias("id"), "text").filter("id IS NOT NULL")
    made = add_struct(rows, "x", LINES, _lines(least), {"text": "text"})
    lines = pin(made.select("id", "x.who", "x.lines", "x.words", "x.keys").filter("size(keys) > 0").dropDuplicates(["id", "who"]))
    pairs = overlaps(lines, rare)
    # an earlier document with very many later ones is copied, so no task gets all of them
    many = pairs.groupBy("early").count().select("early", F.ceil(F.col("count") / HOT).cast("int").alias("copies"))
    salt = F.pmod(F.xxhash64("late"), F.col("copies")).cast("int")
    pairs = pairs.join(many, "early").select("early", "late", salt.alias("salt"))
    sources = lines.select(F.struct("id", "who").alias("early"), F.col("lines").alias("early_lines"), "keys").join(many, "early")
    sources = sources.select("early", "early_lines", "keys", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    both = pairs.join(sources, ["early", "salt"]).join(
        lines.select(F.struct("id", "who").alias("late"), "lines", "words"), "late")
    ready = both.select("late.id", "late.who", F.col("early_lines").alias("early"), F.col("lines").alias("late"), "words", "keys")
    lost = ready.mapInArrow(_align(least), "id bigint, who bigint, lost array<int>")
    return lost.groupBy("id", "who").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lost")))).alias("lost"))


def _strip():
    def work(batch: dict) -> dict:
        """The text without its lost lines, by the hash of the row's lines."""
        text, n_lines, n_lost, n_words = [], [], [], []
        lost = [dict(x) if x else {} for x in batch["lost"].to_pylist()]
        at = 0
        for t in W.texts_of(batch["text"]):
            for who, _, words in hashed(t):
                own = lost[at].get(who, ())
                whole = batch["text"][at].as_py()
                if own:
                    gone = set(own)
                    whole = "\n".join(x for i, x in enumerate(whole.split("\n")) if i not in gone)
                text.append(whole)
                n_lines.append(len(words))
                n_lost.append(len(own))
                n_words.append(int(words.sum() - words[list(own)].sum()))
                at += 1
        return {"text": pa.array(text, pa.string()), "n_lines": pa.array(n_lines, pa.int64()),
                "n_lost": pa.array(n_lost, pa.int64()), "n_words": pa.array(n_words, pa.int64())}
    return work


def cut(docs: DataFrame, **how) -> tuple[DataFrame, str]:
    """``docs`` with a struct column: text without the lost lines, n_lines before, n_lost, n_words left; and its name."""
    name, out = fresh(docs, "lost"), fresh(docs, "cut")
    key = fresh(docs, "cut_id")
    lost = lost_lines(docs.select("doc_id", "text"), **how)
    lost = lost.groupBy(F.col("id").alias(key)).agg(F.map_from_entries(F.collect_list(F.struct("who", "lost"))).alias(name))
    both = docs.join(lost, docs["doc_id"].cast("long") == F.col(key), "left").drop(key)
    made = add_struct(both, out, "text string, n_lines bigint, n_lost bigint, n_words bigint", _strip, {"text": "text", "lost": name})
    return made.drop(name), out


def report(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, n_lines, n_lost, n_words left, text_sha256 of what is left, kept."""
    got, c = cut(docs.select("doc_id", "text"), **how)
    return got.select("doc_id", f"{c}.n_lines", f"{c}.n_lost", f"{c}.n_words",
                      F.sha2(F.coalesce(f"{c}.text", F.lit("")), 256).alias("text_sha256"),
                      ((F.col(f"{c}.n_lost") == 0) | (F.col(f"{c}.n_words") > 0)).alias("kept"))


def without_copies(docs: DataFrame, **how) -> DataFrame:
    """The documents without lost lines; those of which no word is left go. n_chars follows a changed text."""
    got, c = cut(docs, **how)
    got = got.filter((F.col(f"{c}.n_lost") == 0) | (F.col(f"{c}.n_words") > 0))
    new = {"text": F.col(f"{c}.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(f"{c}.n_lost") > 0, F.length(f"{c}.text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return got.select(*[new[x].alias(x) if x in new else F.col(x) for x in docs.columns])
