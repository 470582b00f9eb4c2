r"""Language-model scores by a log-bilinear model trained with noise-contrastive estimation.

Counts of all training tokens are made by Spark and stay there; only their
sums and the most frequent tokens, at most ``FREQUENT``, reach the driver. The model
speaks of classes: the ``TOP`` most frequent tokens are classes of their own,
all others share ``GROUPS`` classes by a hash of their last bytes. It predicts
the class of a token from the two classes before it:

    score(w | a, b) = one_w . rep_a + two_w . rep_b + bias_w

(a text begins with two end tokens). Training is noise-contrastive: each batch
shares some noise classes drawn from the class frequencies, so a step is a few
matrix products. Every training token is used once: all partitions train on
their part, in ``ROUNDS`` of growing size, and parameters are averaged after
each, weighted by tokens, piece by piece on the executors.

Since the score is a sum, the normaliser of all pairs of classes is one matrix
product of exponentials, after which every token's log-probability is three
look-ups. A token that shares its class has the class's probability times its
smoothed share (count + 0.1) of that class; with the one unseen token of each
class all sums to 1.

Tokens are compared by 64-bit hashes. Null and empty texts are the end token
alone. Rows that are equal in doc_id and text get the same result, a null
doc_id is the empty text in the checksum. With nothing to train on, N and V are
0, so both scores treat every token alike. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halosift.llm import words as W
from halosift.llm.batches import add_struct
from halosift.llm.tables import checksum, pin, send, spread

ADD = 0.1
TOP, GROUPS = 960, 64
CLASSES = TOP + GROUPS
FREQUENT = 1 << 16
WIDTH, NOISE, BATCH, RATE = 24, 48, 4096, 0.15
ROUNDS = (0.1, 0.3, 0.6)
PIECE = 8192  # parameters that travel in one row
END = int(W.mix(np.array([0x456E64], np.uint64))[0])  # hash of the end token


def tokens(t: W.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and groups of the tokens of some rows, the end token last; and where each row begins."""
    t = t.lower()
    w = W.words(t, W.NOT_SPACE)
    h = W.span_hashes(t.data, w.start, w.end)
    last = t.data[w.end - 1].astype(np.uint64)
    before = np.where(w.end - w.start > 1, t.data[np.maximum(w.end - 2, 0)], 0).astype(np.uint64)
    group = (W.mix(last * np.uint64(256) + before + np.uint64(1)) % np.uint64(GROUPS)).astype(np.int64)
    at = w.at + np.arange(len(w.at))
    every = np.full(at[-1], END, np.uint64)
    groups = np.zeros(at[-1], np.int64)
    place = np.ones(at[-1], bool)
    place[at[1:] - 1] = False
    every[place], groups[place] = h, group
    return every, groups, at


def _counts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (text): tokens with their group and count, for each batch."""
    for batch in stream:
        parts = [tokens(t)[:2] for t in W.texts_of(batch.column(0))]
        if parts:
            h, first, n = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_counts=True)
            g = np.concatenate([p[1] for p in parts])[first]
            yield pa.RecordBatch.from_arrays([pa.array(W.signed(h)), pa.array(g), pa.array(n)], names=["token", "grp", "n"])


class Vocabulary:
    """The most frequent tokens with their counts, and what the rest of each class holds."""

    def __init__(self, least: int, frequent: list[tuple[int, int, int]], totals: list[tuple[int, int, int]]):
        """frequent: (token, group, count) of all tokens from the step ``least`` on, most frequent first;
        totals: (group, tokens, different ones) of all."""
        self.least = least
        token = np.array([x[0] for x in frequent], np.int64).view(np.uint64)
        count = np.array([x[2] for x in frequent], np.int64)
        group = np.array([x[1] for x in frequent], np.int64)
        of_class = np.where(np.arange(len(token)) < TOP, np.arange(len(token)), TOP + group)
        n, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
        for g, a, b in totals:
            n[TOP + g], kinds[TOP + g] = a, b
        top = min(TOP, len(token))
        np.subtract.at(n, TOP + group[:top], count[:top])
        np.subtract.at(kinds, TOP + group[:top], 1)
        n[:top] = count[:top]
        self.total, self.kinds = float(sum(x[1] for x in totals)), float(sum(x[2] for x in totals))
        order = np.argsort(token)
        self.token, self.count, self.of_class = token[order], count[order], of_class[order]
        self.noise = (n + ADD) / (n + ADD).sum()
        #: log10 of what a class's own probability is shared by; nothing for tokens that are a class
        self.shared = np.where(np.arange(CLASSES) < TOP, 0.0, np.log10(n + ADD * (kinds + 1)))
        hit = np.flatnonzero(self.token == np.uint64(END))
        self.end = int(self.of_class[hit[0]]) if len(hit) else TOP  # the end token's group is 0

    def look(self, h: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and count of tokens; count -1 for those that are not among the frequent."""
        if not len(self.token):
            return TOP + group, np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.token, h), len(self.token) - 1)
        known = self.token[at] == h
        return np.where(known, self.of_class[at], TOP + group), np.where(known, self.count[at], -1)


def _read(vocabulary: Callable[[], Vocabulary]):
    def make():
        v = vocabulary()

        def work(batch: dict) -> dict:
            n, known, base, own, rare, classes, tok, num = [], [], [], [], [], [], [], []
            for t in W.texts_of(batch["text"]):
                h, group, at = tokens(t)
                cls, count = v.look(h, group)
                log = np.where(count >= 0, np.log10(np.maximum(count, 0) + ADD), 0.0)
                # row sums by reduceat: a difference of running sums would depend on the batch
                n.append(np.diff(at))
                known.append(np.add.reduceat((count > 0).astype(np.int64), at[:-1]))
                base.append(np.add.reduceat(log, at[:-1]))
                own.append(np.add.reduceat(np.where(cls < TOP, 0.0, log) - v.shared[cls], at[:-1]))
                rare.append(np.add.reduceat((count < 0).astype(np.int64), at[:-1]))
                cls = cls.astype(np.uint16)
                for a, b in zip(at[:-1], at[1:]):
                    classes.append(cls[a:b].tobytes())
                    x, m = np.unique(h[a:b][count[a:b] < 0], return_counts=True)
                    tok.append(W.signed(x))
                    num.append(m.astype(np.int32))
            join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
            return {"n": join(n, int), "known": join(known, int), "base": join(base, float), "own": join(own, float), "rare": join(rare, int),
                    "classes": pa.array(classes, pa.binary()), "tokens": pa.array(tok, pa.list_(pa.int64())), "counts": pa.array(num, pa.list_(pa.int32()))}
        return work
    return make


READ = "n bigint, known bigint, base double, own double, rare bigint, classes binary, tokens array<bigint>, counts array<int>"


#: Counts in steps of an eighth of a power of two: a few hundred at most.
STEP = "floor(log2(n) * 8)"


def _frequent(counts: DataFrame) -> tuple[int, list[tuple[int, int, int]]]:
    """The least step such that at most ``FREQUENT`` tokens are at or over it, and those tokens."""
    sizes = sorted(((r["s"], r["tokens"]) for r in counts.groupBy(F.expr(STEP).alias("s")).agg(F.count("*").alias("tokens")).collect()), reverse=True)
    least, total = (sizes[0][0] + 1 if sizes else 0), 0
    for step, tokens in sizes:
        total += tokens
        if total > FREQUENT:
            break
        least = step
    rows = counts.filter(f"{STEP} >= {least}").select("token", "grp", "n").collect()
    return least, sorted(map(tuple, rows), key=lambda r: (-r[2], r[0]))


class Net:
    """Parameters rep, one, two (classes x WIDTH) and bias, with their step sizes' memory."""

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray | None = None, seed: int = 7):
        m = CLASSES * WIDTH
        if flat is None:
            rng = np.random.default_rng(seed)
            flat = np.concatenate([rng.normal(0, 0.1, 3 * m), np.log(vocabulary.noise), np.full(3 * m + CLASSES, 1e-2)]).astype(np.float32)
        self.flat = flat
        half = len(flat) // 2
        view = lambda x: [*(x[k * m:(k + 1) * m].reshape(CLASSES, WIDTH) for k in range(3)), x[3 * m:]]
        self.params, self.memory = view(flat[:half]), view(flat[half:])

    def step(self, k: int, rows: np.ndarray, grad: np.ndarray) -> None:
        """Adagrad on some rows of a parameter; gradients of one row are added up first."""
        order = np.argsort(rows, kind="stable")
        single, first = np.unique(rows[order], return_index=True)
        total = np.add.reduceat(grad[order], first, axis=0)
        self.memory[k][single] += total * total
        self.params[k][single] += RATE * total / np.sqrt(self.memory[k][single])

    def learn(self, a: np.ndarray, b: np.ndarray, w: np.ndarray, log_noise: np.ndarray, noise: np.ndarray) -> None:
        """One step of noise-contrastive estimation on targets w after b, a; noise holds the noise classes."""
        rep, one, two, bias = self.params
        ra, rb = rep[a], rep[b]
        lift = np.float32(np.log(len(noise)))
        good = (one[w] * ra + two[w] * rb).sum(axis=1) + bias[w] - log_noise[w] - lift
        bad = ra @ one[noise].T + rb @ two[noise].T + (bias[noise] - log_noise[noise] - lift)
        up = (1 / (1 + np.exp(np.clip(good, -30, 30)))).astype(np.float32) / len(w)
        down = (-1 / (1 + np.exp(np.clip(-bad, -30, 30)))).astype(np.float32) / len(w)
        scale = np.float32(len(w) ** 0.5)  # steps do not shrink with the batch
        up, down = up * scale, down * scale
        gone = np.concatenate([up[:, None] * ra, down.T @ ra])
        gtwo = np.concatenate([up[:, None] * rb, down.T @ rb])
        gbias = np.concatenate([up, down.sum(axis=0)])
        grep_a = up[:, None] * one[w] + down @ one[noise]
        grep_b = up[:, None] * two[w] + down @ two[noise]
        target = np.concatenate([w, noise])
        self.step(0, np.concatenate([a, b]), np.concatenate([grep_a, grep_b]))
        self.step(1, target, gone)
        self.step(2, target, gtwo)
        self.step(3, target, gbias)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """first[w, a], second[w, b] with the bias, and norm[a, b]; log p(w | a, b) = first + second - norm."""
        rep, one, two, bias = self.params
        first, second = one @ rep.T, two @ rep.T + bias[:, None]
        x, y = first.max(axis=0), second.max(axis=0)
        norm = np.log(np.maximum(np.exp(first - x).T @ np.exp(second - y), 1e-37)) + x[:, None] + y[None, :]
        return first, second, norm


def _contexts(classes: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(previous, the one before, token, where rows begin) of class streams."""
    rows = [np.frombuffer(x, np.uint16) for x in classes]
    at = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
    w = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
    a, b = np.full(len(w), end), np.full(len(w), end)
    a[1:], b[2:] = w[:-1], w[:-2]
    a[at[:-1]] = end
    b[at[:-1]] = end
    second = at[:-1] + 1
    b[second[second < at[1:]]] = end
    return a, b, w, at


def _train(params: Callable[[], tuple[Vocabulary, np.ndarray | None]]):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of (classes): the parameters after this partition, in pieces, with the number of its tokens."""
        v, flat = params()
        net, seen = Net(v, None if flat is None else flat.copy()), 0
        log_noise = np.log(v.noise).astype(np.float32)
        edge = np.cumsum(v.noise)
        rng = np.random.default_rng([11, TaskContext.get().partitionId()])
        for batch in stream:
            a, b, w, _ = _contexts(batch.column(0).to_pylist(), v.end)
            order = rng.permutation(len(w))
            for k in range(0, len(w), BATCH):
                own = order[k:k + BATCH]
                noise = np.minimum(np.searchsorted(edge, rng.random(NOISE)), CLASSES - 1)
                net.learn(a[own], b[own], w[own], log_noise, noise)
            seen += len(w)
        if seen:
            pieces = range(0, len(net.flat), PIECE)
            yield pa.RecordBatch.from_arrays([
                pa.array([k // PIECE for k in pieces], pa.int32()), pa.array([seen] * len(pieces), pa.int64()),
                pa.array([net.flat[k:k + PIECE] for k in pieces], pa.list_(pa.float32()))], names=["piece", "weight", "numbers"])
    return run


def _average(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted means of the pieces that meet here, one running sum each."""
    total: dict[int, np.ndarray] = {}
    weight: dict[int, int] = {}
    for batch in stream:
        for k, n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            x = x.values.to_numpy().astype(np.float64) * n
            total[k] = total[k] + x if k in total else x
            weight[k] = weight.get(k, 0) + n
    yield pa.RecordBatch.from_arrays([
        pa.array(list(total), pa.int32()), pa.array([weight[k] for k in total], pa.int64()),
        pa.array([(total[k] / weight[k]).astype(np.float32) for k in total], pa.list_(pa.float32()))], names=["piece", "weight", "numbers"])


def train(streams: DataFrame, vocabulary: Vocabulary, draw, parts: int) -> np.ndarray | None:
    """Parameters after all rounds over (classes); ``draw`` deals rows to rounds by a number below 10."""
    flat, low = None, 0
    kind = "piece int, weight bigint, numbers array<float>"
    for share in ROUNDS:
        high = low + round(10 * share)
        rows = streams.filter((draw >= low) & (draw < high)).select("classes")
        low = high
        got = rows.mapInArrow(_train(send(streams.sparkSession, (vocabulary, flat))), kind)
        made = got.repartition(parts, "piece").mapInArrow(_average, kind).orderBy("piece").collect()  # one net
        if made:
            flat = np.concatenate([np.array(r.numbers, np.float32) for r in made])
    return flat


def _score(params: Callable[[], tuple[Vocabulary, np.ndarray | None]]):
    def make():
        v, flat = params()
        first, second, norm = Net(v, flat).tables()

        def work(batch: dict) -> dict:
            a, b, w, at = _contexts(batch["classes"].to_pylist(), v.end)
            if not len(w):
                return {"model": np.zeros(len(at) - 1)}
            log = (first[w, a] + second[w, b] - norm[a, b]).astype(np.float64)
            return {"model": np.add.reduceat(log, at[:-1]) / np.log(10)}
        return work
    return make


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    held = checksum("doc_id", 10) == 0
    docs = docs.select("doc_id", "text")
    counted = docs.filter(~held).select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_counts, "token bigint, grp bigint, n bigint")
    counts = pin(counted.groupBy("token").agg(F.sum("n").alias("n"), F.first("grp").alias("grp")))
    totals = counts.groupBy("grp").agg(F.sum("n"), F.count("*")).collect()  # GROUPS rows
    v = Vocabulary(*_frequent(counts), [tuple(r) for r in totals])

    named = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("k1"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k2"))
    read = add_struct(named, "x", READ, _read(send(spark, v)), {"text": "text"}).select("doc_id", "k1", "k2", "x.*")
    read = pin(read)
    draw = F.pmod(F.xxhash64("k1", F.lit("round")), F.lit(10))
    flat = train(read.filter(~held), v, draw, spread(docs))
    scored = add_struct(read.select("doc_id", "k1", "k2", "n", "known", "base", "own", "rare", "classes"),
                        "y", "model double", _score(send(spark, (v, flat))), {"classes": "classes"}).drop("classes")

    # tokens that are not among the frequent meet their counts; none of them is hot
    rare = read.select("k1", "k2", F.explode(F.arrays_zip("tokens", "counts")).alias("z")).select("k1", "k2", F.col("z.tokens").alias("token"), F.col("z.counts").alias("m"))
    met = rare.join(counts.filter(f"{STEP} < {v.least}").select("token", "n"), "token", "left")
    n = F.coalesce("n", F.lit(0))
    sums = met.groupBy("k1", "k2").agg(
        F.sum("m").alias("all"), F.sum(F.when(n > 0, F.col("m")).otherwise(0)).alias("more"), F.sum(F.col("m") * F.log10(n + ADD)).alias("logs"))
    both = scored.join(sums, ["k1", "k2"], "left")
    # rows of equal id and text each brought their tokens
    times = F.coalesce(F.col("all") / F.col("rare"), F.lit(1.0))
    logs, more = F.coalesce(F.col("logs") / times, F.lit(0.0)), F.coalesce(F.col("more") / times, F.lit(0))
    whole = v.total + ADD * (v.kinds + 1)
    return both.select(
        "doc_id", held.alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + F.round(more).cast("long")).alias("n_known"),
        F.lit(int(v.total)).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n") * F.lit(float(np.log10(whole)))).alias("base_score"),
        (F.col("y.model") + F.col("own") + logs).alias("score"))
