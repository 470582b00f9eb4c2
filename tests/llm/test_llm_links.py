"""Operators 11 to 13 against plain Python."""

import collections
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
import tokenizers
import xxhash

from halosift.llm import align, audit, simhash
from halosift.llm import words as W

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id bigint, text string, lang string, source string, fp string, anchor int, id string, place string, mask string, `row` int, n string"


def frame(spark, rows):
    """Documents (doc_id, text, lang), with columns whose names clash with those the operators make."""
    return spark.createDataFrame([(i, t, x, "s", "f", 1, "i", "p", "m", 7, "n") for i, t, x in rows], DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(n))


def joined(pairs, ids):
    least = {i: i for i in ids}

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        least[b] = a
    return {i: top(i) for i in ids}


# --- 11: SimHash -----------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(WORD, (text or "").translate(LOW))
    if not words:
        return 0
    k = min(4, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_match_plain_python():
    rng = np.random.default_rng(3)
    texts = ["", None, "one", "Two WORDS", "a b c d", " a\tb  c\x0bd\ne ", "é\x1cx y É z\x85w", prose(rng, 400), "x " * 40_000, "b" * 300_000, "   "]
    got = np.concatenate([simhash.fingerprints(t) for t in W.texts_of(pa.array(texts), 1000)])
    assert got.tolist() == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("depth", [1, 2])
def test_anchors_are_one_home_and_all_visits(depth):
    """Whatever bits differ, the two meet at the home of either."""
    rng = np.random.default_rng(5)
    code = simhash.Anchors(depth)
    n = 40 if depth == 2 else 400
    one = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
    two = one.copy()
    for k in range(4):
        two ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    homes, visits = [set() for _ in range(n)], [set() for _ in range(n)]
    for row, anchor, home in code.of(one):
        for r, a in zip(row[home], anchor[home]):
            homes[r].add(int(a))
    for row, anchor, _ in code.of(two):
        for r, a in zip(row, anchor):
            assert int(a) not in visits[r]
            visits[r].add(int(a))
    assert all(len(h) == len(code.picks) for h in homes)
    assert all(h & v for h, v in zip(homes, visits))


def test_code_is_perfect():
    code = simhash.Anchors(1)
    assert (code.begin[1:] > code.begin[:-1]).all()
    within = code.upto[:, 0] - code.begin
    assert (within == 1).all()  # one word of weight three or less for each remainder


def all_links(fps, bits=4):
    ids = sorted(fps)
    v = np.array([fps[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(v[k + 1:] ^ v[k]) <= bits):
            yield i, ids[k + 1 + j]


@pytest.mark.parametrize("rows, depth", [(4096, 1), (64, 1), (4096, 2)])
def test_simhash_links_match_all_pairs(spark, monkeypatch, rows, depth):
    """Random fingerprints, a dense ball that fills anchors beyond a tile, and chains."""
    monkeypatch.setattr(simhash, "ROWS", rows)
    rng = np.random.default_rng(7)
    ball = {int(x) for x in (0x0123456789ABCDEF ^ int(rng.integers(0, 1 << 12)) for _ in range(600))}
    chain, x = set(), 0xFEDCBA9876543210
    for _ in range(30):
        for b in rng.choice(64, 4, replace=False):
            x ^= 1 << int(b)
        chain.add(x)
    fps = {k: v for k, v in enumerate(sorted(ball | chain | {int(v) for v in rng.integers(0, 1 << 63, 400)}))}
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, k) for k, v in fps.items()], "fp bigint, id bigint")
    got = [(r["a"], r["b"]) for r in simhash.near_pairs(df, depth=depth).collect()]
    want = list(all_links(fps))
    assert {tuple(sorted(p)) for p in got} <= set(want)
    assert joined(got, fps) == joined(want, fps)


def test_simhash_report(spark):
    rng = np.random.default_rng(11)
    base = [prose(rng, 300) for _ in range(12)]
    near = [t.replace(t.split()[50], "changed", 1) for t in base]
    rows = [(k, t, "en") for k, t in enumerate(base + near + base[:3])]
    rows += [(100, None, None), (101, "", "de"), (102, " \n", "de"), (103, base[0] + " ", "en"), (None, base[1], "en"), (None, "", None),
             (200, base[4], "en"), (200, base[5], "en"), (200, base[5], "en")]
    got = simhash.report(frame(spark, rows))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    out = got.collect()
    assert len(out) == len(rows)
    want = collections.Counter((i, f"{plain_fingerprint(t):016x}") for i, t, _ in rows)
    assert collections.Counter((r["doc_id"], r["fingerprint"]) for r in out) == want
    per = collections.defaultdict(set)
    for i, t, _ in rows:
        if i is not None:
            per[i].add(plain_fingerprint(t))
    pairs = [(i, j) for i, j in itertools.combinations(per, 2) if any((a ^ b).bit_count() <= 4 for a in per[i] for b in per[j])]
    want = joined(pairs, per)
    assert all(r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]]) for r in out)
    assert want[101] == want[102] == 100 and want[5] == 4
    assert simhash.report(frame(spark, [])).collect() == []


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_simhash_query_matches_all_pairs(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.select("doc_id", "text").collect()}
    want = joined(all_links(fps), fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.report(docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    assert len(set(want.values())) < len(want)


def test_hot_fingerprint_needs_no_shuffle_of_its_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 3)
    rows = [(k, "the same few words again" if k % 2 else f"{k} other words {k}", "en") for k in range(60)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.report(frame(spark, rows)).collect()}
    assert all(got[k] == 1 for k in range(1, 60, 2))


# --- 12: filter audit ------------------------------------------------------------------


def plain_audit(rows, labels):
    docs = [(i, t or "", x or "") for i, t, x in rows]
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t] = min(first.get(t, i), i)
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, q in labels if q == 1 and i is not None}

    def fails(i, t):
        w = re.findall(WORD, t)
        return {f for f, x in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            re.search(r"[#$%&*|]", t) is not None, i is not None and i > first[t])) if x}

    failed = [(x, i, fails(i, t)) for i, t, x in docs]
    out = {}
    for part in {x for x, _, _ in failed}:
        own = [(i, f) for x, i, f in failed if x == part]
        shares = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                here = [(i, m) for i, m in own if f in m and not m & set(order[:k])]
                shares[f] += len(here)
                out[part, order, k + 1] = [
                    sum(not m & set(order[:k + 1]) for _, m in own), len(here), sum(f in m and bool(m & set(order[:k])) for _, m in own),
                    sum(m == {f} for _, m in own), sum(i in good for i, _ in here), sum(i in toxic for i, _ in here)]
        for (p, order, k), x in out.items():
            if p == part:
                x.append(shares[order[k - 1]])
    return out


FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit_of(spark, rows, labels, **how):
    said = spark.createDataFrame([(*x, 1) for x in labels], "doc_id bigint, quality int, toxic int, good int")
    got = audit.report(frame(spark, rows), said, **how)
    assert got.columns == ["part", "filter_order", "step", *FIGURES]
    out = {(r["part"], r["filter_order"], r["step"]): [r[f] for f in FIGURES] for r in got.collect()}
    return out


@pytest.mark.parametrize("most", [audit.MOST_CELLS, 1 << 16])
def test_audit_matches_plain_python(spark, most):
    rng = np.random.default_rng(13)
    long = [prose(rng, 220) for _ in range(6)]
    texts = [*long, long[0], long[0], long[1].upper(), long[2] + " #", "w " * 300, "w " * 300, "w " * 30, "", None, "Ab é" * 10, "é" * 40 + "A",
             "a\x0bb\x1cc " * 100, "x" * 200_000, "Q " * 60_000, long[3] + " end", "50 50 50", "\n"]
    rows = [(k, t, ["en", "de", None, ""][k % 4]) for k, t in enumerate(texts)]
    rows += [(None, long[0], "en"), (None, "", None), (3, long[3], "en"), (3, "", "en"), (40, long[5], "fr"), (39, long[5], "fr")]
    labels = [(0, 1, 0), (6, 1, None), (7, 0, 1), (7, 1, 0), (11, None, 1), (None, 1, 1), (500, 1, 1), (13, 1, 1), (14, 1, 1), (40, 1, 1)]
    got = audit_of(spark, rows, labels, most=most)
    assert got == plain_audit(rows, labels)
    assert len(got) == 600 * 4


def test_audit_of_empty_tables(spark):
    assert audit_of(spark, [], [(1, 1, 1)]) == {}
    assert audit_of(spark, [(1, "a", "en")], []) == plain_audit([(1, "a", "en")], [])


def test_sketch_clears_only_unique_texts(spark):
    """Small filters clear fewer, but never a repeat; counts of tasks add up."""
    rng = np.random.default_rng(17)
    h = rng.integers(-(1 << 62), 1 << 62, 5000)
    every = np.concatenate([h, h[:200], h[:50]])
    df = spark.createDataFrame([(int(x),) for x in every], "h bigint").repartition(7)
    cleared = {}
    for bits in (16, 18):
        where = audit.repeated_cells(df, bits)
        cell = audit.cells_of(h, bits)
        hit = ((where[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1).all(axis=1)
        assert hit[:200].all()
        cleared[bits] = (~hit).mean()
    assert cleared[18] >= cleared[16] > 0.9


def test_only_possible_repeats_shuffle_texts(spark):
    rows = [(k, f"text {k // 2 if k < 10 else k}", "en") for k in range(400)]
    docs = frame(spark, rows)
    got = {r["id"] for r in audit.repeats(docs, audit.marks(docs)).collect()}
    assert got == {1, 3, 5, 7, 9}


# --- 13: alignment ---------------------------------------------------------------------


class Plain:
    """Both tokenizers by their libraries, and links by comparing byte ranges."""

    def __init__(self):
        import json

        import sentencepiece

        self.a = tokenizers.Tokenizer.from_file(align.BYTES)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=align.PIECES)
        plain = [b for b in range(256) if chr(b).isprintable() and b != 0x20 and b != 0xAD]
        names = {chr(b): b for b in plain}
        names |= {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}
        self.text_a = {i: bytes(names[c] for c in t) for t, i in json.load(open(align.BYTES))["model"]["vocab"].items() if i != 50256}

    def text_b(self, i):
        return bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()

    def groups_and_links(self, text):
        if not text:
            return [], [], [], []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        sides = [[self.text_a[i] for i in a], [self.text_b(i) for i in b]]
        if any(b"".join(s) != (" " + text).encode() for s in sides):
            return [], [], [], []
        ends = [list(itertools.accumulate(map(len, s))) for s in sides]
        groups, links, i, j = [], [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
            groups.append((a[i:x], b[j:y]))
            links += [(a[p], b[q]) for p in range(i, x) for q in range(j, y)
                      if max(ends[0][p] - len(sides[0][p]), ends[1][q] - len(sides[1][q])) < min(ends[0][p], ends[1][q])]
            i, j = x, y
        return a, b, groups, links

    def report(self, rows):
        per = [(i, *self.groups_and_links(t)) for i, t in rows]
        count = collections.Counter(x for *_, links in per for x in links)
        best = collections.defaultdict(int)
        for (_, b), n in count.items():
            best[b] = max(best[b], n)
        out = []
        for i, a, b, groups, links in per:
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            out.append((i, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
                        hashlib.sha256(text.encode()).hexdigest() if text else ""))
        return out


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


ODD = ["", None, "one", " two  spaces", "<|endoftext|> and </s><s> <unk>", "a▁b", "▁", "naïve café 中文字 🙂 é", "tab\there\r\n\x00end ", "don't I'll 'S",
       "0x00 <0x41>", "x" * 3000, " " * 500, "中" * 800, "１２３４", "ǅ ﬁ ﬃ", "one", "\n", " a b", "supercalifragilistic " * 40]


@pytest.mark.parametrize("often", [align.OFTEN, 40, 0])
def test_alignment_matches_plain_python(spark, monkeypatch, often):
    monkeypatch.setattr(align, "RUN", 2000)
    rows = [(k if k != 5 else None, t) for k, t in enumerate(ODD)] + [(2, "one"), (None, "last of all")]
    got = align.report(frame(spark, [(i, t, "en") for i, t in rows]).repartition(3), often=often)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert in_order(got.collect()) == in_order(Plain().report(rows))


def test_alignment_of_an_empty_table(spark):
    assert align.report(frame(spark, [])).collect() == []
    got = align.report(frame(spark, [(1, None, "en"), (2, "", "en")])).collect()
    assert in_order(got) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_alignment_query_matches_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert in_order(align.report(docs, often=2000).collect()) == in_order(Plain().report(rows))


def test_pair_counts_of_tasks_add_up(spark):
    rows = spark.createDataFrame([([65536 + 1, 65536 + 1, 131072 + 1],), ([131072 + 1, 65536 + 2],), ([],)], "links array<bigint>").repartition(3)
    got = {r["pair"]: (r["n"], r["best"]) for r in align.pair_counts(rows).collect()}
    assert got == {65537: (2, True), 131073: (2, True), 65538: (1, True)}
