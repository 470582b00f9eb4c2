"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

The model at hand is of the BPE kind, where the best sum of scores is not the
right encoding. What is right has a simple sign: a chain of pieces is the BPE
encoding exactly when every two neighbours are the encoding of their own
concatenation. (No merge ever crosses the border of two final pieces, so
merging goes on between them as if they stood alone.) So the search runs over
piece ends like any Viterbi search, with that sign as its transition: for each
place it takes the best piece whose predecessor agrees with it, and keeps the
way back. Whether two pieces agree is worked out once for each pair that turns up.

Texts are cut where no piece can reach across: before a run of spaces, and
around characters that only occur alone. Equal parts are encoded once in each
batch, and what a task encoded before is looked up by the hash of its bytes.
Parts of like length advance together: hashes of all their substrings probe
the sorted keys of the pieces.

A part of more than ``LONG`` code points (a text without spaces, of any length)
becomes windows that overlap, and these advance together too. Two windows are
joined at a place in their overlap where both have a border and the pieces
beside it agree: then all neighbours of the joined chain agree, so it is the
encoding. Where no place will do, a window is begun at a border of the first; if
that does not help either, the part is searched as a whole.

Characters without a piece become the pieces of their UTF-8 bytes. Decoding
joins pieces, turns the word mark into a space and drops the space that
encoding put first. Null and empty texts have no pieces and decode to the
empty text. Texts that hold the word mark U+2581 itself come back with spaces;
all others come back as they were. Other columns, whatever their names, are
handed through by `encode` and `decode`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from halosift.llm import words as W
from halosift.llm.batches import add_struct, fresh
from halosift.llm.tables import send

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
FAR = 1 << 20  # more than there are symbols
CODES = 1 << 18  # code points of parts that advance together
TRIES = 4  # borders tried before a part is searched as a whole
LONG, SPAN, LAP = 512, 256, 64  # longer parts are encoded in windows of SPAN, LAP of them shared with the next
EQUAL = 24  # longer parts are padded to a length of four significant bits
KEEP = 1_000_000  # parts a task remembers, in some 45 bytes each, before it starts anew
SEEN_BITS, PAIR_BITS = 20, 20


def load(model: str = MODEL) -> list[tuple[str, float, str]]:
    """(text, score, kind) of all pieces of a model file; kind is normal, byte or other."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    kind = lambda i: "byte" if p.is_byte(i) else "other" if p.is_control(i) or p.is_unknown(i) or p.is_unused(i) else "normal"
    return [(p.id_to_piece(i), p.get_score(i), kind(i)) for i in range(p.vocab_size())]


def _lengthen(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    return h * _BASE + W.mix(code.astype(np.uint64) + np.uint64(1))


def _places(text: str) -> range:
    """Where the windows of a part begin; a part that is not long is its own window."""
    return range(0, len(text) - LAP, SPAN - LAP) if len(text) > LONG else range(1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _string(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of every range, one range after another."""
    total = np.cumsum(size)
    return np.repeat(begin - (total - size), size) + np.arange(total[-1] if len(total) else 0)


class Remembered:
    """Ids of parts by the hash of their bytes. Iteration gives the ids of each part."""

    def __init__(self):
        self.key, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.at, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def __iter__(self) -> Iterator[np.ndarray]:
        return (self.ids[a:b] for a, b in zip(self.at[:-1], self.at[1:]))

    def find(self, key: np.ndarray) -> np.ndarray:
        """Row of each part, or -1."""
        if not len(self.key):
            return np.full(len(key), -1, np.int64)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.row[at], -1)

    def add(self, key: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Parts that are not there yet, by ascending hash."""
        if len(self.key) + len(key) > KEEP:
            self.__init__()
        key, size, place = key[:KEEP], size[:KEEP], np.searchsorted(self.key, key[:KEEP])
        rows = np.arange(len(self.key), len(self.key) + len(key), dtype=np.int32)
        self.key, self.row = np.insert(self.key, place, key), np.insert(self.row, place, rows)
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(size)])
        self.ids = np.concatenate([self.ids, ids[:size.sum()]])


class Pieces:
    """The pieces with what encoding and decoding look up."""

    def __init__(self, table: list[tuple[str, float, str]]):
        self.table = table
        normal = {t: i for i, (t, _, k) in enumerate(table) if k == "normal"}
        self.byte = {int(t[3:5], 16): i for i, (t, _, k) in enumerate(table) if k == "byte"}
        inner = {c for t in normal if len(t) > 1 for c in t}
        self.text = {i: t for t, i in normal.items()}
        self.id_of = dict(normal)
        for c in sorted(inner - set(normal)):  # occurs in pieces but is none
            self.id_of[c] = len(table) + 1 + len(self.id_of) - len(normal)
            self.text[self.id_of[c]] = c
        self.unknown = len(table)
        self.score = {t: s for t, s, k in table if k == "normal"}
        # a piece that its own text is not merged to never occurs
        self.traces: dict[int, tuple] = {}
        for t, i in self.id_of.items():
            parts, trace = self.merge(t)
            if len(parts) == 1:
                self.traces[i] = trace
        whole = [self.text[i] for i in self.traces]
        self.longest = max(map(len, whole))
        keys = []
        for t in whole:
            h = np.zeros(1, np.uint64)
            for c in t:
                h = _lengthen(h, np.array([ord(c)]))
            keys.append(int(self.key(h, len(t))[0]))
        order = np.argsort(np.array(keys, np.uint64))
        self.keys = np.array(keys, np.uint64)[order]
        self.ids = np.array([self.id_of[t] for t in whole], np.int32)[order]
        self.seen = np.zeros(1 << SEEN_BITS, bool)
        self.seen[(self.keys >> np.uint64(64 - SEEN_BITS)).astype(np.int64)] = True
        top = max(self.id_of.values(), default=0) + 1
        self.value = np.full(max(top, self.unknown + 1), -np.inf)
        self.value[self.unknown] = -1e300
        self.length = np.full(len(self.value), FAR, np.int64)  # of the unknown character: joins nothing
        for t in whole:
            self.value[self.id_of[t]] = self.score.get(t, 0.0)
            self.length[self.id_of[t]] = len(t)
        self.known = np.full(1 << PAIR_BITS, -1, np.int64)
        self.agrees = np.zeros(1 << PAIR_BITS, bool)
        self.alone = {c for c in "\n\t\r" if c not in inner}
        self.done = Remembered()

    @staticmethod
    def key(h: np.ndarray, length: int) -> np.ndarray:
        return W.mix(h + np.uint64(length))

    def probe(self, h: np.ndarray, length: int) -> np.ndarray:
        """Piece numbers of substrings by their hash, or -1."""
        k = self.key(h, length)
        out = np.full(len(k), -1, np.int32)
        ask = np.flatnonzero(self.seen[(k >> np.uint64(64 - SEEN_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, k[ask]), len(self.keys) - 1)
        out[ask] = np.where(self.keys[at] == k[ask], self.ids[at], -1)
        return out

    def merge(self, text: str) -> tuple[list[str], tuple]:
        """Plain BPE: join the neighbours whose joint piece scores best, the first of equals, again and again.

        Also its trace: the score of each merge, and the first and the last part
        before each merge and at the end.
        """
        parts, score = list(text), self.score
        scores, firsts, lasts = [], [parts[0]], [parts[-1]]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            scores.append(best)
            firsts.append(parts[0])
            lasts.append(parts[-1])
        return parts, (scores, firsts, lasts)

    def stay(self, a: int, b: int) -> bool:
        """Whether plain BPE of the concatenation of two pieces ends with them.

        Up to the first merge across their border both are merged as they are
        alone, the better merge of the two first and the left one of equals; it
        is enough to see whether a merge across is ever better.
        """
        (sa, _, lasts), (sb, firsts, _) = self.traces[a], self.traces[b]
        score, i, j = self.score, 0, 0
        while True:
            across = score.get(lasts[i] + firsts[j])
            x = sa[i] if i < len(sa) else None
            y = sb[j] if j < len(sb) else None
            if across is not None and (x is None or across > x) and (y is None or across >= y):
                return False
            if x is None and y is None:
                return True
            if y is None or (x is not None and x >= y):
                i += 1
            else:
                j += 1

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b stay as they are side by side. Recent results are remembered."""
        code = a.astype(np.int64) * FAR + b
        slot = (W.mix(code.view(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.agrees[slot]
        new = np.flatnonzero(self.known[slot] != code)
        if len(new):
            single, first, back = np.unique(code[new], return_index=True, return_inverse=True)
            free = self.unknown  # a character without a piece is merged with nothing
            verdict = np.array([c // FAR == free or c % FAR == free or self.stay(c // FAR, c % FAR) for c in single.tolist()], bool)
            out[new] = verdict[back]
            self.known[slot[new[first]]] = single
            self.agrees[slot[new[first]]] = verdict
        return out

    def search(self, codes: np.ndarray, size_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodings, as symbols, of parts of like length: a row of code points each, padded at its end.

        A row of symbols for each, at its end, and how many they are.
        """
        rows, n = codes.shape
        h = np.zeros((n + 1, rows), np.uint64)
        for i in range(n):
            h[i + 1] = _lengthen(h[i], codes[:, i])
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, _BASE)]))
        last = np.full((n + 1, rows), -1, np.int32)
        step = np.zeros((n + 1, rows), np.int8)
        for i in range(1, n + 1):
            found = np.full((min(i, self.longest) + 1, rows), -1, np.int32)  # by size
            for size in range(1, len(found)):
                found[size] = self.probe(h[i] - h[i - size] * power[size], size)
            found[1][found[1] < 0] = self.unknown
            size, who = np.nonzero(found >= 0)
            piece, prior = found[size, who], last[i - size, who]
            fits = (prior >= 0) | (size == i)
            # pieces whose concatenation is a piece never stand side by side
            joint = size + np.where(prior >= 0, self.length[prior], FAR)
            fits[joint < len(found)] &= found[joint[joint < len(found)], who[joint < len(found)]] < 0
            ask = np.flatnonzero(fits & (size < i))
            fits[ask] = self.agree(prior[ask], piece[ask])
            value = np.where(fits, self.value[piece], -np.inf)
            best = np.full(rows, -np.inf)
            np.maximum.at(best, who, value)
            won = np.flatnonzero(fits & (value == best[who]))
            last[i, who[won]], step[i, who[won]] = piece[won], size[won]
        # the way back, all rows together
        out = np.full((rows, n), -1, np.int32)
        at, used = size_of.copy(), np.zeros(rows, np.int64)
        for k in range(n):
            live = np.flatnonzero(at > 0)
            if not len(live):
                break
            out[live, n - 1 - k] = last[at[live], live]
            at[live] -= step[at[live], live]
            used[live] += 1
        return out, used

    def symbols(self, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodings, as symbols, of the parts codes[at[i]:at[i+1]], one after another, and the size of each.

        Parts of like length advance together.
        """
        lens = np.diff(at)
        grain = 1 << np.maximum(np.frexp(lens)[1].astype(np.int64) - 4, 0)
        padded = np.where(lens <= EQUAL, lens, -(-lens // grain) * grain)
        order = np.argsort(padded, kind="stable")
        cut = np.flatnonzero(np.diff(padded[order], prepend=-1, append=-1))
        size, found = np.zeros(len(lens), np.int64), []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            n = int(padded[order[a]])
            for k in range(a, b, max(1, CODES // n)):
                some = order[k:min(b, k + max(1, CODES // n))]
                inside = np.arange(n) < lens[some, None]
                block = np.zeros(inside.shape, np.uint32)
                block[inside] = codes[_ranges(at[some], lens[some])]
                rows, size[some] = self.search(block, lens[some])
                found.append(rows[np.arange(n) >= n - size[some, None]])
        begin = np.empty(len(lens), np.int64)
        begin[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate([*found, np.zeros(0, np.int32)])[_ranges(begin, size)], size

    def windows(self, texts: set[str]) -> dict[str, np.ndarray]:
        """Encodings, as symbols, of texts."""
        own = list(texts)
        flat, size = self.symbols(_codes("".join(own)), np.cumsum([0, *map(len, own)]))
        return dict(zip(own, np.split(flat, np.cumsum(size)[:-1])))

    def joined(self, text: str, windows: dict[str, np.ndarray]) -> np.ndarray:
        """Symbols of a long part from those of its windows."""
        done, last, last_at = [], windows[text[:SPAN]], 0
        for at in _places(text)[1:]:
            following = windows[text[at:at + SPAN]]
            ends = last_at + np.cumsum(self.sizes(last))
            begins = at + np.cumsum(self.sizes(following)) - self.sizes(following)
            _, i, j = np.intersect1d(ends, begins, assume_unique=True, return_indices=True)
            fit = np.flatnonzero(self.agree(last[i], following[j])) if len(i) else i
            if len(fit):
                i, j = i[fit[0]], j[fit[0]]
                done.append(last[:i + 1])
                last, last_at = following[j:], int(begins[j])
                continue
            # runs out of step: a window from a border of the chain (windows of a periodic text are alike)
            for i in np.flatnonzero((ends >= at) & (ends < at + LAP))[:TRIES]:
                own = text[ends[i]:ends[i] + SPAN]
                if own not in windows:
                    windows |= self.windows({own})
                if self.agree(last[i:i + 1], windows[own][:1])[0]:
                    done.append(last[:i + 1])
                    last, last_at = windows[own], int(ends[i])
                    break
            else:
                return self.windows({text})[text]
        return np.concatenate([*done, last])

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        """Code points of symbols."""
        return np.where(symbols == self.unknown, 1, self.length[symbols])

    def parts(self, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts codes[at[i]:at[i+1]], one after another, and the size of each."""
        lens = np.diff(at)
        long = np.flatnonzero(lens > LONG)
        texts = {i: _string(codes[at[i]:at[i + 1]]) for i in long.tolist()}
        found = self.windows({t[k:k + SPAN] for t in texts.values() for k in _places(t)}) if texts else {}
        other = {i: self.spell(t, self.joined(t, found)) for i, t in texts.items()}
        short = np.flatnonzero(lens <= LONG)
        size = np.zeros(len(lens), np.int64)
        begin = np.cumsum(lens[short]) - lens[short]
        flat, size[short] = self.symbols(codes[_ranges(at[short], lens[short])] if len(long) else codes, np.append(begin, lens[short].sum()))
        end = np.cumsum(size)
        for i in np.unique(np.searchsorted(end, np.flatnonzero(flat >= len(self.table)), "right")).tolist():
            other[i] = self.spell(_string(codes[at[i]:at[i + 1]]), flat[end[i] - size[i]:end[i]])
        chunks, last = [], 0
        for i in sorted(other):
            chunks += [flat[last:end[i] - size[i]], other[i]]
            last = end[i]
        for i, ids in other.items():
            size[i] = len(ids)
        return np.concatenate([*chunks, flat[last:]]), size

    def spell(self, text: str, symbols: np.ndarray) -> np.ndarray:
        """Ids for symbols; characters without a piece become bytes."""
        if not len(symbols) or symbols.max() < len(self.table):
            return symbols
        ids, at = [], 0
        for s in symbols.tolist():
            if s >= len(self.table):
                ids += [self.byte[b] for b in text[at].encode("utf-8", "surrogatepass")]
                at += 1
            else:
                ids.append(s)
                at += len(self.text[s])
        return np.array(ids, np.int32)

    @staticmethod
    def read(data: np.ndarray, first: np.ndarray, end: np.ndarray, leads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points of the spans data[first:end], with word marks for spaces and before those that lead, and where each begins."""
        raw = data[_ranges(first, end - first)]
        inner = _codes(raw.tobytes().decode("utf-8", "surrogatepass"))
        whole = np.concatenate([[0], np.cumsum(W.FIRST_BYTE[raw])])
        at = np.concatenate([[0], np.cumsum(np.diff(whole[np.append(0, np.cumsum(end - first))]) + leads)])
        own = np.ones(at[-1], bool)
        own[at[:-1][leads]] = False
        codes = np.full(at[-1], ord(MARK), np.uint32)
        codes[own] = np.where(inner == 0x20, ord(MARK), inner)
        return codes, at

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of every row."""
        out = []
        for t in W.texts_of(column, 4 * W.CHUNK):
            d = t.data
            start = np.zeros(len(d), bool)
            if len(d):
                start[1:] = (d[1:] == 0x20) & (d[:-1] != 0x20)
                for c in self.alone:
                    only = d == ord(c)
                    start |= only
                    start[1:] |= only[:-1]
            filled = t.at[:-1][np.diff(t.at) > 0]
            start[filled] = True
            first = np.flatnonzero(start)
            end = np.append(first[1:], len(d)) if len(first) else first
            leads = np.zeros(len(first), bool)
            leads[np.searchsorted(first, filled)] = True
            h = W.span_hashes(d, first, end)
            h[leads] = W.mix(h[leads] ^ np.uint64(0x5851F42D4C957F2D))
            key, one, back = np.unique(h, return_index=True, return_inverse=True)
            row = self.done.find(key)
            new, old = np.flatnonzero(row < 0), np.flatnonzero(row >= 0)
            size, begin = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
            begin[old], size[old] = self.done.at[row[old]], self.done.at[row[old] + 1] - self.done.at[row[old]]
            codes, at = self.read(d, first[one[new]], end[one[new]], leads[one[new]])
            ids, size[new] = self.parts(codes, at)
            begin[new] = len(self.done.ids) + np.cumsum(size[new]) - size[new]
            every = np.concatenate([self.done.ids, ids])
            short = np.diff(at) <= LONG
            self.done.add(key[new[short]], ids[np.repeat(short, size[new])], size[new[short]])
            lens = size[back]
            total = np.concatenate([[0], np.cumsum(lens)])
            flat = every[_ranges(begin[back], lens)]
            cut = total[np.searchsorted(first, t.at)]
            out += [flat[a:b] for a, b in zip(cut[:-1], cut[1:])]
        return out

    def decoder(self) -> Callable[[np.ndarray], str]:
        """A function from ids to text."""
        raw = [bytes([int(t[3:5], 16)]) if k == "byte" else b"" if k == "other" else t.replace(MARK, " ").encode()
               for t, _, k in self.table]

        def decode(ids: np.ndarray) -> str:
            text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
            return text[1:] if text.startswith(" ") else text

        return decode


def digest(ids: np.ndarray) -> str:
    """sha256 of the ids as 4-byte little-endian numbers."""
    return hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()


def _shared(docs: DataFrame, model: str):
    """The look-up of all pieces, made once; its size is that of the model."""
    return send(docs.sparkSession, Pieces(load(model)))


def encode(docs: DataFrame, model: str = MODEL, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct column that holds ids; and its name."""
    out, sent = fresh(docs, "pieces"), _shared(docs, model)

    def make():
        own = sent()
        return lambda batch: {"ids": pa.array(own.encode(batch["text"]), pa.list_(pa.int32()))}

    return add_struct(docs, out, "ids array<int>", make, {"text": text}), out


def decode(rows: DataFrame, ids: str, model: str = MODEL) -> tuple[DataFrame, str]:
    """``rows`` with a struct column that holds the text of an array column of ids; and its name."""
    out, sent = fresh(rows, "decoded"), _shared(rows, model)

    def make():
        back = sent().decoder()
        return lambda batch: {"text": pa.array([back(np.array(x or [], np.int32)) for x in batch["ids"].to_pylist()], pa.string())}

    return add_struct(rows, out, "text string", make, {"ids": ids}), out


SUMMARY = "n_pieces bigint, n_bytes bigint, ids_sha256 string, round_trip boolean"


def report(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """One row per document: doc_id, n_pieces, n_bytes, ids_sha256, and whether decoding gives the text back."""
    docs = docs.select("doc_id", "text")
    sent = _shared(docs, model)

    def make():
        own = sent()
        back = own.decoder()
        is_byte = np.zeros(len(own.table), bool)
        is_byte[list(own.byte.values())] = True

        def work(batch: dict) -> dict:
            ids = own.encode(batch["text"])
            return {"n_pieces": pa.array([len(x) for x in ids], pa.int64()),
                    "n_bytes": pa.array([int(is_byte[x].sum()) for x in ids], pa.int64()),
                    "ids_sha256": pa.array([digest(x) for x in ids], pa.string()),
                    "round_trip": pa.array([back(x) == (t.as_py() or "") for x, t in zip(ids, batch["text"])], pa.bool_())}
        return work

    return add_struct(docs, "x", SUMMARY, make, {"text": "text"}).select("doc_id", "x.*")
