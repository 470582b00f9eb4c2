"""Operators 1, 3, 5 and 9 against plain Python over small tables."""

import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from halosift.llm import graph, leaks, near, passages, quality
from halosift.llm import words as W

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def frame(spark, texts, **more):
    """A documents table of texts, with columns whose names clash with results."""
    rows = [(k, t, None, f"s{k % 2}", len(t or ""), "x", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, quality int")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def prose(seed, n=120):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(n))


# --- words -----------------------------------------------------------------------------


def test_words_and_lines_match_plain_python():
    texts = ["a bb  c", "", " é\n\nx ", None, "\x0bq\x00r", "last\n"]
    (t,) = W.texts_of(pa.array(texts))
    w, li = W.words(t, W.NOT_SPACE), W.lines(t)
    raw = bytes(t.data)
    got = [[raw[a:b].decode() for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.at, w.at[1:])]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", x or "") for x in texts]
    got = [[raw[a:b].decode() for a, b in zip(li.start[i:j], li.end[i:j])] for i, j in zip(li.at, li.at[1:])]
    assert got == [(x or "").split("\n") for x in texts]
    h = W.span_hashes(t.data, w.start, w.end)
    flat = [x for row in texts for x in re.findall(r"[^\x20\x09-\x0D]+", row or "")]
    assert len(set(h.tolist())) == len(set(flat))


def test_hashes_do_not_depend_on_the_place():
    long = "ab cd " * 100_000
    (t,) = W.texts_of(pa.array([long]))
    w = W.words(t, W.NOT_SPACE)
    assert len(set(W.span_hashes(t.data, w.start, w.end).tolist())) == 2


def test_windows_stay_in_their_rows():
    h = np.arange(7, dtype=np.uint64)
    _, first = W.window_hashes(h, np.array([0, 2, 2, 7]), 3)
    assert first.tolist() == [2, 3, 4]


# --- 1: quality rules ------------------------------------------------------------------


def test_quality_figures_and_verdicts(spark):
    good = [f"The {prose(k, 60)} of the day and the {prose(k + 100, 30)}.\nAnd it is the end of {prose(k + 50, 20)}." for k in range(30)]
    junk = [" ".join(w + "###" for w in prose(k + 500, 50).split()) for k in range(8)]
    odd = ["", None, "short one", ("one two three four five six seven eight nine ten " * 9).strip(), good[0], "é " * 25]
    texts = good + junk + odd
    got = by_id(quality.report(frame(spark, texts)))
    for k, x in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", x or "")
        seen, dup = set(), 0
        for line in (x or "").split("\n"):
            if line.strip():
                dup += line in seen
                seen.add(line)
        c = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        twice = {j for i in range(len(words) - 7) if c[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), dup, len(twice))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", x or ""))
        assert r.base_failed == (len(words) < 20 or 100 * len(twice) > 30 * len(words))
        assert not (r.base_failed and r.kept)
    assert all(got[k].kept for k in range(30)) and not any(got[30 + k].kept for k in range(8))
    assert got[0].kept == got[len(texts) - 2].kept


def test_quality_on_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r["doc_id"]: r["kept"] for r in quality.report(docs).filter("not base_failed").collect()}
    right = [kept[r["doc_id"]] == (r["quality"] == 1) for r in labels.collect() if r["doc_id"] in kept]
    assert np.mean(right) > 0.95


def test_quality_keeps_columns_and_bears_empty_tables(spark):
    df = frame(spark, [prose(1) + " the of and.", "x"])
    assert quality.keep_good(df).columns == df.columns
    assert quality.report(df.limit(0)).count() == 0 and quality.keep_good(df.limit(0)).count() == 0


# --- 9: decontamination ----------------------------------------------------------------


def plain_leaks(texts, items):
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(LOW))
    out = []
    for x in texts:
        w, hit, found = words(x), set(), set()
        for name, text in items:
            q = words(text)
            n = min(10, len(q))
            for i in range(len(q) - n + 1 if q else 0):
                for j in range(len(w) - n + 1):
                    if w[j:j + n] == q[i:i + n]:
                        hit.update(range(j, j + n))
                        found.add(str(name))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_leaks_match_plain_search(spark, block_bytes):
    items = [(3, prose(1, 25)), (10, prose(2, 12).upper()), (4, "one two"), (5, "Zeta"), (6, None), (7, "..."), (3, prose(1, 25)), (8, "a a a a a a a a a a a")]
    texts = [prose(1, 25), "x " + prose(1, 25).replace(" ", ", ") + " y", " ".join(prose(2, 12).split()[:9]), prose(2, 12) + " " + prose(1, 14),
             "say ONE-two and zeta!", None, "", "zeta", " ".join(["a"] * 30), prose(9, 3000) + " " + prose(2, 12), prose(1, 25)]
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = by_id(leaks.report(frame(spark, texts), bench, block_bytes=block_bytes))
    for k, want in enumerate(plain_leaks(texts, items)):
        assert tuple(got[k])[1:] == want


def test_leaks_on_empty_tables(spark):
    df = frame(spark, ["a b", "c"])
    bench = spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert leaks.clean(df, bench).columns == df.columns and leaks.clean(df, bench).count() == 1
    assert leaks.clean(df, bench.limit(0)).count() == 2 and leaks.report(df.limit(0), bench).count() == 0


# --- 5: near-duplicates ----------------------------------------------------------------


def plain_near(texts):
    sets = []
    for x in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(LOW))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(len(s), find(k), find(k) == k) for k, s in enumerate(sets)]


def edited(text, seed, share):
    rng = np.random.default_rng(seed)
    return " ".join(w if rng.random() > share else f"z{rng.integers(1 << 30)}" for w in text.split())


@pytest.mark.parametrize("small", [near.SMALL, 3])
def test_near_matches_all_pairs(spark, small):
    base = [prose(k, 90) for k in range(6)]
    texts = [edited(b, 31 * k + n, s) for k, b in enumerate(base) for n, s in enumerate([0, 0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.06])]
    passage = prose(77, 60)
    texts += [passage + " " + prose(200 + k, 50) for k in range(12)]
    texts += ["", None, "one two", "One  two", "three", base[0].upper(), base[0], " \n", prose(5, 4000)]
    got = by_id(near.report(frame(spark, texts), small=small))
    assert [tuple(got[k])[1:] for k in range(len(texts))] == plain_near(texts)


@pytest.mark.parametrize("weight", [1500, 100])
def test_near_compares_no_more_sets_at_once_than_their_bound(spark, monkeypatch, weight):
    """Long texts that all share a passage, and near copies of them: few classes, many shingles."""
    confirm, passage = near._confirm, prose(78, 150)

    def bounded(percent):
        run = confirm(percent)

        def watched(stream):
            def batches():
                for batch in stream:
                    of = {}
                    for node, raw in zip(batch.column(0).to_pylist(), batch.column("shingles").to_pylist()):
                        of[node] = of.get(node, 0) + len(raw) // 8
                    assert max(of.values(), default=0) <= weight
                    yield batch
            return run(batches())
        return watched

    monkeypatch.setattr(near, "_confirm", bounded)
    texts = [edited(f"{passage} {prose(400 + k // 4, 60)}", 900 + k, 0.015 * (k % 4)) for k in range(24)]
    got = by_id(near.report(frame(spark, texts), weight=weight))
    assert [tuple(got[k])[1:] for k in range(len(texts))] == plain_near(texts)


def test_near_stage_keeps_one_of_each_group(spark):
    texts = [prose(1), prose(2), prose(1), None, None, "", "short"]
    df = frame(spark, texts)
    left = near.drop_near_copies(df)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [0, 1, 3, 4, 5, 6]
    assert near.report(df.limit(0)).count() == 0


def test_batches_of_long_texts_are_bounded_in_bytes(spark):
    near.link(frame(spark, [prose(1)]))
    rows = spark.range(0, 40, 1, 1).selectExpr("repeat('abcdefgh', 131072) AS text")

    def sizes(stream):
        for batch in stream:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    assert max(r["n"] for r in rows.mapInArrow(sizes, "n bigint").collect()) <= 17


def test_near_few_rows_take_few_tasks(spark):
    """Also where a shuffle has many partitions and none are merged, as on a table with large groups."""
    base = [prose(k, 60) for k in range(6)]
    texts = [edited(b, 31 * k + n, s) for k, b in enumerate(base) for n, s in enumerate([0, 0, 0.01, 0.02])]
    held = {"spark.sql.shuffle.partitions": "100", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in held}
    sc = spark.sparkContext
    try:
        for name, value in held.items():
            spark.conf.set(name, value)
        sc.setJobGroup("few rows", "")
        got = by_id(near.report(frame(spark, texts)))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for name, value in before.items():
            spark.conf.set(name, value)
    assert [tuple(got[k])[1:] for k in range(len(texts))] == plain_near(texts)
    track = sc.statusTracker()
    stages = [track.getStageInfo(k) for job in track.getJobIdsForGroup("few rows") for k in track.getJobInfo(job).stageIds]
    assert 0 < sum(s.numCompletedTasks for s in stages if s) < 2000


def test_near_of_tables_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(near, "IDS_AT_MOST", 0)
    monkeypatch.setattr(graph, "BROADCAST_EDGES", 0)
    texts = [edited(prose(k, 60), 31 * k + n, s) for k in range(6) for n, s in enumerate([0, 0, 0.01, 0.02])]
    got = by_id(near.report(frame(spark, texts)))
    assert [tuple(got[k])[1:] for k in range(len(texts))] == plain_near(texts)


def test_near_bears_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, prose(1)), (None, prose(1)), (4, prose(1)), (4, prose(1)), (4, prose(2)), (9, prose(2))], "doc_id int, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in near.report(df).collect())
    assert got == [(-1, -1, True)] * 2 + [(4, 4, True)] * 3 + [(9, 4, False)]


@pytest.mark.parametrize("small", [near.SMALL, 2])
def test_near_copies_of_every_text_of_a_repeated_id(spark, small):
    rows = []
    for k in range(8):
        a, b = prose(200 + k), prose(300 + k)
        rows += [(k, a), (k, b), (k, b.upper()), (100 + k, a + " end"), (200 + k, b + " end"), (300 + k, "start " + b)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {(r["doc_id"], r["component_id"]) for r in near.report(df, small=small).collect()}
    assert got == {(x, x % 100) for x, _ in rows}


# --- 3: line dedup ---------------------------------------------------------------------


@pytest.mark.parametrize("holders", [4, 6])
def test_tails_of_repeated_passages_go_in_groups_of_any_size(spark, holders):
    x, y, z = prose(70, 60), prose(71, 30), prose(72, 5)
    texts = [x] + [f"{x}\n\n{y}\nown {k}" for k in range(holders - 1)] + [f"{x}\n{y}\n{z}", f"{x}\n{y}\n{z}\n{prose(73, 9)}"]
    left = {r["doc_id"]: r["text"] for r in passages.without_copies(frame(spark, texts)).collect()}
    want = {0: x, 1: f"\n{y}\nown 0"} | {k + 1: f"own {k}" for k in range(1, holders - 1)} | {holders: z, holders + 1: prose(73, 9)}
    assert left == want


def test_keys_cover_all_lines_of_shared_blocks():
    rng = np.random.default_rng(3)
    for _ in range(300):
        words = rng.choice([0, 1, 4, 9, 20, 60], rng.integers(1, 14))
        h = np.where(words > 0, rng.integers(1, 1 << 62, len(words)), 0).astype(np.uint64)
        keys = passages.keys_of(h, words, 50)
        for a in range(len(words)):
            for b in range(a + 1, len(words) + 1):
                if words[a:b].sum() >= 50:
                    inside = {i for _, i0, i1 in keys if a <= i0 and i1 <= b for i in range(i0, i1)}
                    assert {i for i in range(a, b) if words[i]} <= inside
        assert all(words[i:j].sum() >= 50 for _, i, j in keys)


def test_repeated_passages_go_from_later_documents(spark):
    a, b, c = prose(1, 60), prose(2, 30), prose(3, 30)
    texts = [f"intro\n{a}\nend one", f"other\n\n  {a} \nend two", f"{b}\n{c}\nx", f"y\n{b}\n{c}\nz", f"{c}\n{b}", a, f"{a}\n{a}", None, "", f"q\n{b}\nr",
             f"{b}\n\n{c}"]
    left = {r["doc_id"]: r["text"] for r in passages.without_copies(frame(spark, texts)).collect()}
    assert left[0] == texts[0] and left[2] == texts[2]
    assert left[1] == "other\n\nend two" and left[3] == "y\nz"
    assert 5 not in left and 6 not in left and 10 not in left
    assert left[4] == texts[4] and left[9] == texts[9]  # each part alone is short
    assert left[7] is None and left[8] == ""


def test_moved_and_scattered_blocks(spark):
    parts = [prose(k, 55) for k in range(4)]
    texts = ["\n".join(parts), "\n".join(["new", parts[3], parts[0], "more"]), "\n".join([prose(9, 20), parts[1]]), parts[2] + " tail"]
    left = {r["doc_id"]: r["text"] for r in passages.without_copies(frame(spark, texts)).collect()}
    assert left[1] == "new\nmore" and left[2] == prose(9, 20) and left[3] == texts[3]


def test_every_deleted_line_has_an_earlier_copy_and_no_long_line_twice(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    left = {r["doc_id"]: r["text"] for r in passages.without_copies(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    seen = set()
    for k, text in docs:
        lines = [x.strip(" \t\r\x0b\x0c") for x in text.split("\n")]
        kept = collections.Counter(x.strip(" \t\r\x0b\x0c") for x in left.get(k, "").split("\n"))
        assert all(x in seen for x in (collections.Counter(lines) - kept) if x)
        assert not any(kept[x] for x in lines if len(x.split()) >= 50 and x in seen)
        seen.update(lines)


def test_a_line_that_many_documents_share(spark):
    hot = prose(1, 70)
    texts = [f"{prose(k + 10, 20)}\n{hot}\n{prose(k + 1000, 20)}" for k in range(60)]
    got = by_id(passages.report(frame(spark, texts)))
    assert [got[k].n_lost for k in range(60)] == [0] + [1] * 59
    assert passages.report(frame(spark, texts).limit(0)).count() == 0


def test_patience_takes_unique_lines_first():
    assert passages.patience([1, 2, 3, 4], [9, 2, 8, 4]) == [(1, 1), (3, 3)]
    assert passages.patience([1, 5, 2, 5, 3], [1, 5, 3]) == [(0, 0), (1, 1), (4, 2)]
    assert passages.patience([], [1]) == []


def test_equal_ids_are_told_apart_by_text(spark):
    a, b = prose(1, 60), prose(2, 60)
    df = spark.createDataFrame([(1, a), (1, b), (2, a + "\nx"), (3, b + "\ny"), (None, a)], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or -1, r["text"]) for r in passages.without_copies(df).collect())
    assert got == sorted([(1, a), (1, b), (2, "x"), (3, "y"), (-1, a)])
    assert passages.without_copies(df.withColumn("lost", F.lit(1))).columns == ["doc_id", "text", "lost"]
