"""Alignment of two tokenizers over the bytes of whole documents, in Arrow.

Both tokenizers cut the same bytes (a space and the text). A batch's tokens are one
flat list with parent indices; segmented running sums of their lengths give the
byte where each token ends. Documents lie one behind the other, so (document, end)
is a key. An Acero join of the two sides on that key leaves the shared ends, which
cut a document into groups. A full outer join, sorted, cuts it into stretches with one token
of either side each; since two tokens overlap in one stretch at most, the stretches are
exactly the links. What one side lacks is filled from the next row: the token that
goes on to there.

Counts of id pairs are taken by ``Table.group_by`` in each task and summed by Spark.
The highest count of an id of B is one of at most as many rows as B has pieces, so
it goes out by broadcast. The counts themselves go back to the documents in two ways: the
most frequent pairs, at most ``OFTEN`` of them (some 13 bytes each), by broadcast and a search
in sorted arrays; links of all rarer pairs, of which there are few, by a join. Nothing is left out.

Null and empty texts have no tokens, nor have texts whose tokens do not give back their bytes (as
those that hold the word mark U+2581). Strings of special tokens are plain text.
Rows are kept apart by a number of their own, so repeated and null doc_ids are each
a row of the result, and every row counts. Texts go in runs of about ``RUN`` bytes, one text at least, so a very
long text bounds the memory. An empty table gives an empty result. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halosift.llm import words as W
from halosift.llm.tables import pin, send, small_batches

BYTES, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
# Fixed value: how the byte-level tokenizer cuts text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RUN = 1 << 19
OFTEN = 1 << 21
_PAIRS = 1 << 20  # distinct pairs that a task holds before it gives them out
_SIDE = 1 << 16  # ids of a side; both are below it

_FIGURES = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
FIGURES = [part.split()[0] for part in _FIGURES.split(", ")]


def _binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.large_binary())


class Tokenizers:
    """Both tokenizers, built in the task from what their files hold, and the bytes of their tokens."""

    def __init__(self, byte_file: str = BYTES, piece_file: str = PIECES):
        with open(byte_file, encoding="utf-8") as f:
            whole = json.load(f)
        special = {t["content"] for t in whole["added_tokens"] if t["special"]}
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
        other = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
        self.a_bytes = {i: bytes(byte_of[c] for c in t) for t, i in whole["model"]["vocab"].items() if t not in special}
        with open(piece_file, "rb") as f:
            self.pieces = f.read()

    def start(self) -> "Tokenizers":
        import sentencepiece
        import tiktoken

        self.a = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in self.a_bytes.items()}, special_tokens={})
        p = self.b = sentencepiece.SentencePieceProcessor(model_proto=self.pieces)
        text = lambda i: bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode()
        self.b_pieces = _binary([text(i) for i in range(p.vocab_size())])
        self.a_pieces = _binary([self.a_bytes.get(i, b"") for i in range(max(self.a_bytes) + 1)])
        return self

    def ids(self, texts: list[str]) -> tuple[pa.Array, pa.Array]:
        many = pa.large_list(pa.int64())
        return (pa.array([self.a.encode_ordinary(" " + x) for x in texts], many),
                pa.array(self.b.encode(texts, num_threads=1), many))


def runs(column: pa.Array) -> Iterator[pa.Array]:
    """The texts in runs of about ``RUN`` bytes; null is empty."""
    for t in W.texts_of(column, RUN):
        yield pc.fill_null(column.slice(t.first, t.rows), "")


def _bytes_of(tokens: pa.Array, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens, joined; the length of each token; where each document begins."""
    joined = pieces.take(tokens.flatten())
    size = pc.binary_length(joined).to_numpy()
    data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)[:size.sum()]
    place = np.concatenate([[0], np.cumsum(size)])
    return data, size, place[tokens.offsets.to_numpy() - tokens.offsets[0].as_py()]


def _same(data: np.ndarray, at: np.ndarray, expected: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Whether each document's bytes are the expected ones."""
    if np.array_equal(at, begin) and np.array_equal(data, expected):
        return np.ones(len(at) - 1, bool)
    return np.array([np.array_equal(data[i:j], expected[k:m]) for i, j, k, m in zip(at, at[1:], begin, begin[1:])], bool)


def _ends(tokens: pa.Array, size: np.ndarray) -> pa.Table:
    """(doc, end, at) of every token: its document, the byte there it ends before, its place in the flat list."""
    doc = pc.list_parent_indices(tokens)
    total = pc.cumulative_sum(pa.array(size))
    before = np.concatenate([[0], np.cumsum(size)])[tokens.offsets.to_numpy()[:-1] - tokens.offsets[0].as_py()]
    return pa.table({"doc": doc, "end": pc.subtract(total, pa.array(before).take(doc)), "at": pa.array(np.arange(len(size)))})


def _grouped(tokens: pa.Array, last: pa.Array) -> pa.Array:
    """The tokens as text, joined by commas in each group; ``last`` are the places of the groups' last tokens."""
    offsets = pa.array(np.concatenate([[0], last.to_numpy() + 1]).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, tokens.flatten().cast(pa.string())), ",")


def _digests(text: pa.Array, doc: np.ndarray, rows: int) -> list[str]:
    """Of each document's groups, joined by semicolons; empty without groups."""
    offsets = pa.array(np.searchsorted(doc, np.arange(rows + 1)).astype(np.int32))
    whole = pc.binary_join(pa.ListArray.from_arrays(offsets, text), ";")
    return [hashlib.sha256(x.as_buffer()).hexdigest() if len(x.as_buffer()) else "" for x in whole.cast(pa.binary())]


def aligned(texts: pa.Array, both: Tokenizers) -> dict[str, pa.Array]:
    """Figures, digest and links (a * 2^16 + b) of each text."""
    rows = len(texts)
    words = texts.to_pylist()
    a, b = both.ids(words)
    raw = [b" " + x.encode() if x else b"" for x in words]
    expected, begin = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    fine = np.diff(begin) > 0
    for tokens, pieces in ((a, both.a_pieces), (b, both.b_pieces)):
        data, _, at = _bytes_of(tokens, pieces)
        fine &= _same(data, at, expected, begin)
    empty = pa.scalar([], pa.large_list(pa.int64()))
    if not fine.all():
        a, b = (pc.if_else(pa.array(fine), x, empty) for x in (a, b))
    left, right = (_ends(x, _bytes_of(x, p)[1]) for x, p in ((a, both.a_pieces), (b, both.b_pieces)))
    key = ["doc", "end"]
    every = left.join(right, key, right_suffix="_b", join_type="full outer", use_threads=False).sort_by([(k, "ascending") for k in key])
    shared = every.filter(pc.and_(pc.is_valid(every["at"]), pc.is_valid(every["at_b"])))
    doc, group = every["doc"].to_numpy(), shared["doc"].to_numpy()
    text = pc.binary_join_element_wise(
        _grouped(a, shared["at"].combine_chunks()), _grouped(b, shared["at_b"].combine_chunks()), "|")
    id_a, id_b = (x.flatten().take(pc.fill_null_backward(every[c]).combine_chunks()) for x, c in ((a, "at"), (b, "at_b")))
    pairs = pc.add(pc.multiply(id_a, _SIDE), id_b)
    per = lambda x: pa.array(np.bincount(x, minlength=rows).astype(np.int64))
    return {
        "n_a": pc.list_value_length(a).cast(pa.int64()), "n_b": pc.list_value_length(b).cast(pa.int64()),
        "n_groups": per(group), "n_links": per(doc), "groups_sha256": pa.array(_digests(text, group, rows), pa.string()),
        "links": pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(rows + 1)).astype(np.int32)), pairs)}


def align(docs: DataFrame, byte_file: str = BYTES, piece_file: str = PIECES) -> DataFrame:
    """Every row with its figures and links, written to the shared folder."""
    small_batches(docs.sparkSession)
    given = send(docs.sparkSession, Tokenizers(byte_file, piece_file))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = given().start()
        for batch in stream:
            at = 0
            for texts in runs(batch.column(2)):
                part = batch.slice(at, len(texts))
                at += len(texts)
                got = aligned(texts, both)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *got.values()], names=["row", "doc_id", *got])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return pin(rows.mapInArrow(run, f"{_FIGURES}, links array<bigint>"))


# --- counts of pairs -------------------------------------------------------------------


def _counted(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (links): pairs of the task with their counts."""
    def summed(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])

    held: list[pa.Table] = []
    for batch in stream:
        links = batch.column(0).flatten()
        held.append(pa.table({"pair": links, "n": pa.array(np.ones(len(links), np.int64))}))
        if sum(map(len, held)) >= _PAIRS:
            held = [summed(held)]
            if len(held[0]) >= _PAIRS // 2:
                yield from held.pop().to_batches()
    if held:
        yield from summed(held).to_batches()


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): links of each id pair over all rows, and whether no other pair of its B id has more."""
    partial = rows.select("links").mapInArrow(_counted, "pair bigint, n bigint")
    counts = pin(partial.groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.col("pair") % _SIDE
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # at most as many rows as B has pieces
    return pin(counts.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def _least_often(counts: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` pairs have it or more, in steps of an eighth of a power of two."""
    step = F.floor(F.log2("n") * 8).cast("int")
    rows = counts.groupBy(step.alias("s")).agg(F.count("*").alias("pairs"), F.min("n").alias("n")).orderBy(F.desc("s")).collect()
    total, least = 0, (1 << 62)
    for r in rows:
        total += r["pairs"]
        if total > most:
            break
        least = r["n"]
    return least


class Often:
    """Counts of the frequent pairs, by search in sorted pairs."""

    def __init__(self, pair: np.ndarray, n: np.ndarray, best: np.ndarray):
        order = np.argsort(pair)
        self.pair, self.n, self.best = pair[order], n[order], best[order]

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each pair is known, its count and whether it is best."""
        if not len(self.pair):
            return np.zeros(len(pairs), bool), np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        at = np.minimum(np.searchsorted(self.pair, pairs), len(self.pair) - 1)
        known = self.pair[at] == pairs
        return known, np.where(known, self.n[at], 0), known & self.best[at]


def _weighed(rows: DataFrame, given) -> DataFrame:
    """``FIGURES`` of the rows (with links last), sums over their frequent pairs, and the other pairs."""
    names = [*FIGURES, "best", "total", "rest"]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = given()
        for batch in stream:
            links = batch.column(len(FIGURES))
            pairs, at = links.flatten().to_numpy(), links.offsets.to_numpy().astype(np.int64)
            known, n, best = often.look_up(pairs)
            at = at - at[0]
            offsets = np.concatenate([[0], np.cumsum(W.per_row(~known, at))]).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(offsets), pa.array(pairs[~known]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(FIGURES)], pa.array(W.per_row(best, at)), pa.array(W.per_row(n, at)), rest], names=names)

    return rows.select(*FIGURES, "links").mapInArrow(run, f"{_FIGURES}, best bigint, total bigint, rest array<bigint>")


def report(docs: DataFrame, byte_file: str = BYTES, piece_file: str = PIECES, often: int = OFTEN) -> DataFrame:
    rows = align(docs, byte_file, piece_file)
    counts = pair_counts(rows)
    least = _least_often(counts, often)
    top = counts.filter(F.col("n") >= least).toPandas()
    known = send(docs.sparkSession, Often(top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best"].to_numpy(bool)))
    weighed, rare = _weighed(rows, known), counts.filter(F.col("n") < least)
    if not rare.isEmpty():
        weighed = pin(weighed)
        links = weighed.select("row", F.explode("rest").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("k"))
        more = links.join(rare, "pair").groupBy("row").agg(
            F.sum(F.col("k") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("k") * F.col("n")).alias("more"))
        weighed = weighed.join(more, "row", "left").withColumn("best", F.col("best") + F.coalesce("more_best", F.lit(0))).withColumn(
            "total", F.col("total") + F.coalesce("more", F.lit(0)))
    return weighed.select(*FIGURES[1:-1], F.col("best").alias("n_best"), F.col("total").alias("count_sum"), FIGURES[-1])
