r"""Language identification of mixed texts.

A word is a run of letters and of marks on them. The range of code points that its first letter is in gives its script, and
only languages that were seen in that script are candidates (all, if none was).
Every candidate scores a word by its character trigrams, borders included; a
Viterbi search over the words of a text, with a penalty for each change of
language, labels spans. The language of a text is that with most letters.

The trigram counts are fitted on about ``SAMPLE`` labelled rows of each language
(all, if there are fewer), with their whole texts: of n rows, those whose hash is
in the first SAMPLE / n of its range, so no text moves to be chosen. Trigrams share ``BUCKETS`` buckets by hash. More than ``LANGUAGES``
different labels raise an error.

Null texts and texts without a letter are ``und`` with score 0; so is all, if
there is nothing to learn from. Rows without a label are not learned from. Ties
go to the language that sorts first. Equal texts get equal results. Other
columns, whatever their names, are handed through by `spans`.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halosift.llm import words as W
from halosift.llm.batches import add_struct, fresh
from halosift.llm.tables import checksum, send

SAMPLE, LANGUAGES = 2000, 200
BITS = 16
BUCKETS = 1 << BITS
SWITCH = 14.0  # nats that a change of language costs
SEEN_IN = 0.02  # least share of a language's letters in one of its scripts

# Ranges of code points by script, from the public block names.
RANGES = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F), (0xFB13, 0xFB17)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "oriya": [(0xB00, 0xB7F)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "tibetan": [(0xF00, 0xFFF)],
    "myanmar": [(0x1000, 0x109F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)],
    "ethiopic": [(0x1200, 0x139F), (0x2D80, 0x2DDF)],
    "khmer": [(0x1780, 0x17FF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "han": [(0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
SCRIPTS = len(RANGES) + 2  # 0: no letter; the last: letters of all other scripts

_cache: dict[str, np.ndarray] = {}


def script_table() -> np.ndarray:
    """Script of every code point; letters and the marks written on them have one, all others 0."""
    if "script" not in _cache:
        table = np.zeros(0x110000, np.uint8)
        low = 0x20000  # beyond it there are only letters, marks of variants and private places
        table[:low] = [SCRIPTS - 1 if unicodedata.category(chr(c))[0] in "LM" else 0 for c in range(low)]
        table[low:0x40000] = SCRIPTS - 1
        for k, ranges in enumerate(RANGES.values(), 1):
            for a, b in ranges:
                part = table[a:b + 1]
                part[part > 0] = k
        _cache["script"] = table
    return _cache["script"]


def script_of_bytes(data: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 the script of the code point it belongs to."""
    table = script_table()
    out = table[data]  # right for ASCII; the rest is set below
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return out
    first = data[lead].astype(np.int64)
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    point = first & (0x7F >> size)
    for k in range(1, 4):
        more = size > k
        point[more] = (point[more] << 6) | (data[lead[more] + k] & 0x3F)
    script = table[point]
    out[lead] = script
    for k in range(1, 4):
        more = size > k
        out[lead[more] + k] = script[more]
    return out


def _apart(t: W.Texts) -> W.Texts:
    """The rows with a space after each, so that no trigram spans two."""
    data = np.insert(t.data, t.at[1:], 0x20)
    return W.Texts(t.first, data, t.at + np.arange(len(t.at)))


def trigrams(t: W.Texts) -> tuple[W.Spans, np.ndarray, np.ndarray, np.ndarray]:
    """Words of rows that `_apart` made, buckets of their trigrams, where each word's begin, and scripts."""
    d = W.LOWER[t.data]
    script = script_of_bytes(t.data)
    inside = script > 0
    w = W.runs(t, inside)
    c = np.where(inside, d, 0x20).astype(np.uint64)
    one = np.concatenate([[np.uint64(0x20)], c[:-1]])
    two = np.concatenate([[np.uint64(0x20)], one[:-1]])
    two = np.where(one == 0x20, np.uint64(0x20), two)
    code = ((two << np.uint64(16)) | (one << np.uint64(8)) | c) * np.uint64(0x9E3779B97F4A7C15)
    use = inside.copy()
    use[1:] |= inside[:-1]  # the space that ends a word counts
    begin = np.cumsum(use) - use
    return w, (code[use] >> np.uint64(64 - BITS)).astype(np.int64), begin[w.start], script[w.start].astype(np.int64)


def _counts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (lang, text): for each language of the partition, counts of trigrams and of letters by script."""
    total: dict[str, np.ndarray] = {}
    for batch in stream:
        langs = batch.column(0).to_pylist()
        for t in W.texts_of(batch.column(1)):
            a = _apart(t)
            w, tri, begin, script = trigrams(a)
            cut = np.append(begin, len(tri))[w.at]
            size = w.end - w.start
            for r in range(t.rows):
                own = total.setdefault(langs[t.first + r], np.zeros(BUCKETS + SCRIPTS, np.int64))
                own[:BUCKETS] += np.bincount(tri[cut[r]:cut[r + 1]], minlength=BUCKETS)
                part = slice(w.at[r], w.at[r + 1])
                own[BUCKETS:] += np.bincount(script[part], size[part], SCRIPTS).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.list_(pa.int64()))], names=["lang", "counts"])


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        tri, script = counts[:, :BUCKETS].astype(float) + 0.05, counts[:, BUCKETS:].astype(float)
        self.logs = np.log(tri / tri.sum(axis=1, keepdims=True)).astype(np.float32)
        share = script / np.maximum(script.sum(axis=1, keepdims=True), 1)
        self.seen = share.T >= SEEN_IN  # script x language
        self.seen[~self.seen.any(axis=1)] = True

    def emissions(self, t: W.Texts) -> tuple[W.Spans, np.ndarray]:
        """Words and words x languages of scores."""
        w, tri, begin, script = trigrams(_apart(t))
        if not len(begin):
            return w, np.zeros((0, len(self.langs)), np.float32)
        score = np.stack([np.add.reduceat(row[tri], begin) for row in self.logs], axis=1)
        return w, np.where(self.seen[script], score, np.float32(-1e9))


def viterbi(score: np.ndarray, at: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Language of every word; the n-th words of all rows advance together."""
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    begin, size = at[:-1][order], size[order]
    most, langs = int(size.max(initial=0)), score.shape[1]
    live = np.searchsorted(-size, -np.arange(most), "left")  # rows with more than n words
    came = np.zeros(score.shape, np.int16)
    out = np.zeros(len(score), np.int64)
    if not most:
        return out
    own = np.arange(langs)
    s = score[begin[:live[0]]]
    came[begin[:live[0]]] = own
    final = np.zeros(len(size), np.int64)
    for n in range(1, most):
        k = live[n]
        if k < len(s):
            final[k:len(s)] = s[k:].argmax(axis=1)
            s = s[:k]
        best = s.argmax(axis=1)
        leave = s[np.arange(k), best][:, None] - np.float32(switch)
        moved = leave > s
        place = begin[:k] + n
        came[place] = np.where(moved, best[:, None], own)
        s = np.where(moved, leave, s) + score[place]
        s -= s.max(axis=1, keepdims=True)
    final[:len(s)] = s.argmax(axis=1)
    state = final
    for n in range(most - 1, -1, -1):
        k = live[n]
        place = begin[:k] + n
        out[place] = state[:k]
        state[:k] = came[place, state[:k]]
    return out


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model | None:
    """Trigram counts of about ``sample`` rows of each language."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = dict(map(tuple, rows.groupBy(lang).count().limit(LANGUAGES + 1).collect()))
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return None
    langs = sorted(sizes)
    share = F.create_map(*[F.lit(x) for name in langs for x in (name, min(1.0, sample / sizes[name]))])
    draw = F.pmod(F.xxhash64(key, text), F.lit(1 << 31)) / F.lit(float(1 << 31))
    some = rows.filter(draw < share[F.col(lang)]).select(lang, text)
    got = some.repartition(8).mapInArrow(_counts, "lang string, counts array<bigint>").collect()  # at most 8 x LANGUAGES arrays
    counts = np.zeros((len(langs), BUCKETS + SCRIPTS), np.int64)
    for r in got:
        counts[langs.index(r.lang)] += np.array(r.counts)
    return Model(langs, counts)


RESULT = "lang string, score double, n_spans int, spans array<struct<lang:string,first:int,last:int>>"


def _label(sent, want_spans: bool) -> Callable[[], Callable[[dict], dict]]:
    def make():
        model: Model | None = sent()

        def work(batch: dict) -> dict:
            text = batch["text"]
            n = len(text)
            lang, share, n_spans, spans = ["und"] * n, np.zeros(n), np.zeros(n, np.int32), [[] for _ in range(n)]
            parts = [(t, *model.emissions(t)) for t in W.texts_of(text)] if model else []
            if parts:
                at = np.concatenate([[0], np.cumsum(np.concatenate([w.counts for _, w, _ in parts]))])
                label = viterbi(np.concatenate([e for _, _, e in parts]), at)
                size = np.concatenate([w.end - w.start for _, w, _ in parts])
                langs = len(model.langs)
                row = np.repeat(np.arange(n), np.diff(at))
                votes = np.bincount(row * langs + label, size, n * langs).reshape(n, langs)
                best = votes.argmax(axis=1)
                change = np.ones(len(label), bool)
                change[1:] = (label[1:] != label[:-1]) | (row[1:] != row[:-1])
                n_spans = W.per_row(change, at).astype(np.int32)
                for r in np.flatnonzero(np.diff(at)).tolist():
                    one = votes[r].sum()
                    if not any(c.isalpha() for c in text[r].as_py()):  # ends at the first letter
                        n_spans[r] = 0
                        continue
                    lang[r], share[r] = model.langs[best[r]], votes[r, best[r]] / one
                if want_spans:
                    first = np.flatnonzero(change)
                    last = np.append(first[1:], len(label)) - 1
                    for f, e in zip(first.tolist(), last.tolist()):
                        r = row[f]
                        if lang[r] != "und":
                            spans[r].append({"lang": model.langs[label[f]], "first": int(f - at[r]), "last": int(e - at[r])})
            kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))
            return {"lang": pa.array(lang, pa.string()), "score": pa.array(share, pa.float64()),
                    "n_spans": pa.array(n_spans, pa.int32()), "spans": pa.array(spans, kind)}
        return work
    return make


def spans(docs: DataFrame, model: Model | None, text: str = "text", want_spans: bool = True) -> tuple[DataFrame, str]:
    """``docs`` with a struct column: lang, score (its share of letters), n_spans, spans of words; and its name."""
    out = fresh(docs, "language")
    sent = send(docs.sparkSession, model)  # LANGUAGES x BUCKETS numbers at most
    return add_struct(docs, out, RESULT, _label(sent, want_spans), {"text": text}), out


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans; learned from the rows that are not held out."""
    held = checksum("doc_id", 3) == 1
    model = fit(docs.filter(~held).select("doc_id", "text", "lang"))
    got, s = spans(docs.select("doc_id", "text"), model, want_spans=False)
    return got.select("doc_id", held.alias("held_out"), F.col(f"{s}.lang").alias("lang_pred"), f"{s}.score", f"{s}.n_spans")
