"""Quality rules as weak supervision.

Each rule looks at a text's figures and votes good (1), bad (-1) or abstains
(0). Nothing is labelled: expectation-maximisation over the counts of vote
patterns estimates how often every rule votes each way on good and on bad
texts, and the posterior probability of a good text replaces passing all rules.
There are at most 3 ** len(RULES) patterns, whatever the number of documents,
so the counts are collected and the estimates go back as constants.

A null or empty text has no words; it fails the base rule. Equal texts get
equal verdicts. An empty table gives an empty result. Other columns, whatever
their names, are handed through by `judge`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halosift.llm import words as W
from halosift.llm.batches import add_struct, fresh
from halosift.llm.tables import pin

LEAST_WORDS, REPEATED_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = W.byte_set("#*$%&|<>")
UPPER, LETTER = W.byte_set((0x41, 0x5A)), W.byte_set((0x41, 0x5A), (0x61, 0x7A))
STOP = W.byte_set(".!?:;\"')")
_OTHER = W.byte_set((0xC0, 0xFF))

# Common short words of the languages at hand, a sign of running prose. These languages are written nearly
# all in A-Z: a text with a larger share of other letters is in none of them, and the rule abstains.
OTHER_LETTERS = 0.08
PROSE = "the and of to in a is that for it de la le les et que en des el los se del der die und das ist nicht ein von".split()

#: (name, bad when the figure is over (high) or under (low) this, good when beyond that).
#: Having no fault is no sign of quality, so most rules never vote good.
RULES = [
    ("words", "low", 20, None),
    ("symbols", "high", 0.1, None),  # a word
    ("capitals", "high", 0.5, None),  # of A-Z, a-z
    ("repeats", "high", 0.30, None),  # of words
    ("copied_lines", "high", 0.30, None),
    ("shouts", "high", 0.2, None),  # words that end in !
    ("word_length", "high", 14.0, None),
    ("prose", "low", 0.01, 0.08),  # common words
    ("variety", "low", 2.0, 4.0),  # different words by the root of words
    ("line_ends", "low", 0.1, 0.5),  # lines that end a sentence
]
BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
FIGURES = BASE + ", votes int"
ROUNDS, PRIOR = 100, 1.0


def _copies(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keyed spans: which equal an earlier one of their row, and which any other of it."""
    keys = W.mix(keys + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ordered = np.sort(keys)
    double = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    later, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(double):
        at = np.flatnonzero(np.isin(keys, double))
        any_[at] = True
        _, first = np.unique(keys[at], return_index=True)
        later[at] = True
        later[at[first]] = False
    return later, any_


def figures(t: W.Texts, prose: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base figures of some rows and their votes, packed to base 3."""
    w = W.words(t, W.NOT_SPACE)
    n = w.counts
    h = W.span_hashes(t.data, w.start, w.end)
    starts_char = W.FIRST_BYTE[t.data] & W.NOT_SPACE[t.data]
    chars = W.per_row(starts_char, t.at)
    symbols = W.per_row(SYMBOLS[t.data], t.at)
    # lines with a word that equal an earlier line
    li = W.lines(t)
    filled = np.searchsorted(w.start, li.end) > np.searchsorted(w.start, li.start)
    rows = li.row()[filled]
    again, _ = _copies(W.span_hashes(t.data, li.start[filled], li.end[filled]), rows)
    dup_lines = np.bincount(rows[again], minlength=t.rows)
    n_lines = np.bincount(rows, minlength=t.rows)
    last = t.data[li.end[filled] - 1]
    ended = np.bincount(rows[STOP[last]], minlength=t.rows)
    # words in windows that the text holds twice
    win, first = W.window_hashes(h, w.at, WINDOW)
    row_of_word = w.row()
    _, twice = _copies(win, row_of_word[first])
    change = np.zeros(len(h) + 1, np.int64)
    np.add.at(change, first[twice], 1)
    np.add.at(change, first[twice] + WINDOW, -1)
    repeats = W.per_row(np.cumsum(change[:-1]) > 0, w.at)
    # for the votes only
    upper, letters = W.per_row(UPPER[t.data], t.at), W.per_row(LETTER[t.data], t.at)
    shouts = W.per_row(t.data[w.end - 1] == 0x21, w.at)
    seen_before, _ = _copies(h, row_of_word)
    distinct = n - W.per_row(seen_before, w.at)
    lowered = W.span_hashes(W.LOWER[t.data], w.start, w.end)
    common = W.per_row(np.isin(lowered, prose), w.at)
    d = np.maximum(n, 1)
    value = {
        "words": n.astype(float), "symbols": symbols / d, "capitals": upper / np.maximum(letters, 1),
        "repeats": repeats / d, "copied_lines": dup_lines / np.maximum(n_lines, 1), "shouts": shouts / d,
        "word_length": chars / d, "prose": common / d, "variety": distinct / np.sqrt(d),
        "line_ends": ended / np.maximum(n_lines, 1),
    }
    other = W.per_row(_OTHER[t.data], t.at)  # first bytes of longer code points
    foreign = other > OTHER_LETTERS * (letters + other)
    votes = np.zeros(t.rows, np.int64)
    for name, side, bad, good in RULES:
        v = value[name]
        vote = np.where((v > bad) if side == "high" else (v < bad), 0, 1)
        if good is not None:
            vote = np.where((v < good) if side == "high" else (v > good), 2, vote)
        if name == "prose":
            vote = np.where((vote == 0) & foreign, 1, vote)
        votes = votes * 3 + vote
    return {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeats}, votes


def _work():
    text = W.texts_of(pa.array([" ".join(PROSE)]))
    t = next(text)
    w = W.words(t, W.NOT_SPACE)
    prose = np.sort(W.span_hashes(t.data, w.start, w.end))

    def work(batch: dict) -> dict:
        parts: dict[str, list] = {}
        for t in W.texts_of(batch["text"]):
            got, votes = figures(t, prose)
            for k, v in (got | {"votes": votes}).items():
                parts.setdefault(k, []).append(np.asarray(v, np.int64))
        names = [x.split()[0] for x in FIGURES.split(", ")]
        return {k: np.concatenate(parts[k]) if parts else np.zeros(0, np.int64) for k in names}

    return work


def unpack(votes: np.ndarray) -> np.ndarray:
    """Patterns x rules of -1, 0, 1."""
    return np.stack([(votes // 3 ** k) % 3 - 1 for k in range(len(RULES) - 1, -1, -1)], axis=-1)


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation: posterior of each pattern, rates[class, rule, vote], share of good texts.

    The start trusts a bad vote more than a good one, which names the two
    classes; to every count a little is added that leans to votes being right.
    """
    v, weight = unpack(votes), counts.astype(float)
    one_hot = np.stack([v == -1, v == 0, v == 1], axis=-1).astype(float)
    good = 1 / (1 + np.exp(4.0 * (v < 0).sum(axis=1) - 0.5 * (v > 0).sum(axis=1) - 1))
    lean = np.array([[2.0, 1.0, 0.5], [0.5, 1.0, 2.0]]) * PRIOR
    share, rates = 0.5, None
    for _ in range(rounds):
        mass = np.stack([weight * (1 - good), weight * good])
        rates = np.einsum("cp,prv->crv", mass, one_hot) + lean[:, None, :]
        rates /= rates.sum(axis=2, keepdims=True)
        share = (mass[1].sum() + PRIOR) / (weight.sum() + 2 * PRIOR)
        logs = np.einsum("prv,crv->cp", one_hot, np.log(rates))
        new = 1 / (1 + np.exp(np.clip(logs[0] + np.log(1 - share) - logs[1] - np.log(share), -700, 700)))
        if np.abs(new - good).max(initial=0) < 1e-9:
            good = new
            break
        good = new
    return good, rates, float(share)


def judge(docs: DataFrame, text: str = "text", least: float = 0.5,
          carry: list[str] | None = None) -> tuple[DataFrame, str]:
    """``docs`` with a struct column: the base figures, base_failed, quality (posterior), kept; and its name.

    ``carry`` names the columns to hand through, all unless given. Without the
    texts among them the figures are written once and read twice; with them they
    are worked out twice, which takes less than a copy of the texts.
    """
    raw, out = fresh(docs, "figures"), fresh(docs, "quality")
    carry = docs.columns if carry is None else carry
    frame = add_struct(docs, raw, FIGURES, _work, {"text": text}).select(*carry, raw)
    if text not in carry:
        frame = pin(frame)
    patterns = frame.groupBy(F.col(f"{raw}.votes").alias("votes")).count().collect()  # 3 ** len(RULES) at most
    patterns.sort()
    votes = np.array([r["votes"] for r in patterns], np.int64)
    good, _, _ = estimate(votes, np.array([r["count"] for r in patterns], np.int64)) if patterns else (np.zeros(0), None, 0)
    spark, pattern, posterior = docs.sparkSession, fresh(frame, "pattern"), fresh(frame, "posterior")
    known = spark.createDataFrame([(int(v), float(round(p, 12))) for v, p in zip(votes, good)], f"`{pattern}` int, `{posterior}` double")
    joined = frame.join(F.broadcast(known), F.col(f"{raw}.votes") == F.col(pattern), "left")
    f = F.col(raw)
    failed = (f.n_words < LEAST_WORDS) | (100 * f.n_repeat_words > REPEATED_PERCENT * f.n_words)
    kept = ~failed & (F.col(posterior) >= least)
    made = F.struct(f.n_words.alias("n_words"), f.word_chars.alias("word_chars"), f.n_symbols.alias("n_symbols"),
                    f.n_dup_lines.alias("n_dup_lines"), f.n_repeat_words.alias("n_repeat_words"),
                    failed.alias("base_failed"), kept.alias("kept"), F.col(posterior).alias("quality"))
    return joined.select(*carry, made.alias(out)), out


def report(docs: DataFrame) -> DataFrame:
    got, q = judge(docs.select("doc_id", "text"), carry=["doc_id"])
    return got.select("doc_id", q + ".*")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, columns as they were."""
    got, q = judge(docs)
    return got.filter(f"{q}.kept").select(*docs.columns)
