"""Cases found in review: markup in odd attributes, items without an id, clashing names, other alphabets."""

import itertools
import os
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from halosift.llm import html, leaks, pieces, quality
from halosift.llm import words as W


# --- 2: HTML extraction ----------------------------------------------------------------


@pytest.mark.parametrize("page, text", [
    ('<p class=a"b>one</p>', "one"), ("<p title=don't>one</p>", "one"), ("<p title='a>b'>one</p>", "one"), ('<p title="a>b" x>one</p>', "one"),
    ('<p title = "a>b">one</p>', "one"), ("<p a=>one</p>", "one"), ('<p "a>one</p>', "one"), ("<p title=\"it's\">one</p>", "one"),
    ('<img alt=5" src=x>one', "one"), ("<p x='a' y=\"b>c\" z=d'e>one</p>", "one"), ("<p =a>one</p>", "one"), ("<p a==\"b>c\">one</p>", "one"),
    ('<a href=/x?a="b>one</a>', "one"), ("<p a='b'c='d>e'>one</p>", "one"), ("<p\n title\n=\n'a>b'\n>one</p>", "one"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ('<p style="a:\'b\'">one</p>', "one"), ("<br/ \">one", "one"), ('<p a="b"">one</p>', "one"), ("<p data-x=a'b'c>one</p>", "one"),
])
def test_quotes_count_right_after_an_equals_sign_only(page, text):
    assert " ".join(b.text for b in html.blocks(page)) == text


def test_attributes_take_linear_time():
    import time

    start = time.time()
    for page in ("<p " + 'a="b ' * 20_000, "<p " + "=" * 50_000, "<p " + "='" * 30_000 + ">x", "<p " + "a=b'c " * 30_000 + ">x"):
        html.blocks(page)
    assert time.time() - start < 20


def test_decoding_takes_the_best_of_all_labellings():
    rng = np.random.default_rng(2)
    chain = html.Chain()
    for _ in range(40):
        chain.unary[:] = rng.normal(size=chain.unary.shape)
        chain.pair[:] = rng.normal(size=(2, 2)) * 2
        page = [rng.choice(len(chain.unary), 3, replace=False).tolist() for _ in range(rng.integers(1, 8))]
        s = chain.scores(page)
        best = max(itertools.product((0, 1), repeat=len(page)),
                   key=lambda y: sum(s[i, k] for i, k in enumerate(y)) + sum(chain.pair[a, b] for a, b in zip(y, y[1:])))
        assert chain.decode(page) == [bool(k) for k in best]


@pytest.fixture(scope="module")
def chain():
    import duckdb

    pages = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall()
    return html.learn([p for (p,) in pages if re.search("(?i)<(article|main)[ >]", p or "")][:html.PAGES])


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>"])
def test_links_of_an_article_stay(chain, wrap):
    nav = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav>'
    own = "<h1>A title</h1><p>Some words of a plain sentence stand here, and more of them follow.</p>"
    for links in (["One link", "Two link"], ["First of three", "Second", "Third one here"], ["Only"]):
        items = "".join(f'<li><a href="/{k}">{x}</a></li>' for k, x in enumerate(links))
        page = f"<html><body>{nav}{wrap.format(own + '<ul>' + items + '</ul>')}<footer><p>Imprint</p></footer></body></html>"
        got = html.text_of(page, chain).split("\n")
        assert got == ["A title", "Some words of a plain sentence stand here, and more of them follow.", *links]


# --- 9: decontamination ----------------------------------------------------------------


def plain_leaks(docs, items, size):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    out = {}
    for d, text in docs:
        w, hit, names = words(text), set(), set()
        for i, item in items:
            v = words(item)
            n = min(size, len(v))
            for a in range(len(v) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b:b + n] == v[a:a + n]:
                        hit |= set(range(b, b + n))
                        names.add(i)
        out[d] = len(w), len(hit), len(names), ",".join(sorted(str(n) for n in names if n is not None))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_items_without_an_id_and_several_blocks(spark, block_bytes):
    import hashlib

    items = [(5, "alpha beta gamma delta"), (None, "alpha beta gamma delta"), (None, "kappa lambda mu nu"), (6, "one"), (6, "two three four"), (7, ""), (8, None),
             (9, "beta gamma delta epsilon"), (10, "one")]
    docs = [(1, "x alpha beta gamma delta epsilon y"), (2, "kappa lambda mu nu"), (3, "only One here"), (4, ""), (None, "two three four"), (6, "nothing")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = spark.createDataFrame([(*d, "f") for d in docs], "doc_id bigint, text string, found string")
    got = {r["doc_id"]: r for r in leaks.report(df, bench, size=3, block_bytes=block_bytes).collect()}
    for d, (n_words, n_hit, n_items, names) in plain_leaks(docs, items, 3).items():
        r = got[d]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (
            n_words, n_hit, n_items, hashlib.sha256(names.encode()).hexdigest(), n_hit > 0)
    assert leaks.clean(df, bench, size=3, block_bytes=block_bytes).columns == df.columns


def test_owners_of_windows_are_those_of_plain_python():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abc"), rng.integers(0, 9))) for _ in range(60)]
    ids = [str(k // 2) if k % 7 else None for k in range(60)]
    want = {}
    for i, t in zip(ids, texts):
        w = t.split()
        n = min(4, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            want.setdefault(tuple(w[a:a + n]), set()).add(i)
    got = leaks.compile_items(ids, texts, 4)
    assert sum(len(p.patterns) for p in got) == len(want) == len({tuple(r) for p in got for r in p.patterns.tolist()})
    (t,) = W.texts_of(pa.array(["a b c"]))
    letters = dict(zip("abc", (W.span_hashes(t.data, np.array([k]), np.array([k + 1]))[0] for k in (0, 2, 4))))
    for p in got:
        rows = {tuple(r): k for k, r in enumerate(p.patterns.tolist())}
        for w, own in want.items():
            if len(w) == p.length:
                assert set(p.owners(rows[tuple(int(letters[x]) for x in w)])) == own


# --- 1: quality rules ------------------------------------------------------------------


def test_names_of_the_verdict_may_be_taken(spark):
    df = spark.createDataFrame([(1, "some words " * 30, 1, 2.0, "f")], "doc_id bigint, text string, _pattern int, _posterior double, figures string")
    assert quality.keep_good(df).columns == df.columns
    assert quality.report(df).count() == 1


def test_texts_in_other_letters_have_no_bad_vote_for_their_words():
    russian = "Мы шли по дороге к дому и говорили о том что было вчера вечером на площади у старой церкви. " * 8
    vietnamese = "Chúng tôi đi trên con đường về nhà và nói chuyện về những điều đã xảy ra tối hôm qua. " * 8
    french = "Nous étions à la maison et les enfants jouaient dans le jardin près de la forêt. " * 8
    salad = "qwer tyui opas dfgh jklz xcvb nmqw erty uiop asdf ghjk lzxc vbnm qazw sxed crfv. " * 8
    rule = [r[0] for r in quality.RULES].index("prose")
    (t,) = W.texts_of(pa.array([russian, vietnamese, french, salad]))
    text = next(W.texts_of(pa.array([" ".join(quality.PROSE)])))
    w = W.words(text, W.NOT_SPACE)
    _, votes = quality.figures(t, np.sort(W.span_hashes(text.data, w.start, w.end)))
    assert quality.unpack(votes)[:, rule].tolist() == [0, 0, 1, -1]


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="the vocabulary file is not here")
def test_long_parts_without_spaces_are_joined_from_windows():
    """Texts without spaces: letters of one and of many alphabets, runs, periods, and lengths about the window's."""
    own, other = pieces.Pieces(pieces.load()), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = np.random.default_rng(5)
    stock = ["the", "ing", "É", "12", "_", "//", "ation", "ción", "HE", "日本", "😀", "\x00", "ния", "при", "漢", "==", "aa"]
    texts = ["".join(rng.choice(stock, rng.integers(300, 1500))) for _ in range(40)]
    texts += ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, n))) for n in (513, 704, 705, 3000)]
    texts += ["".join(map(chr, rng.integers(97, 123, n))) for n in range(505, 1300, 53)]
    texts += [c * n for c in ("a", "ab", "=", "_", "abc", "12") for n in (511, 577, 1001)]
    texts += [f"x {t} y\n{t}" for t in texts[:5]]
    assert [x.tolist() for x in own.encode(pa.array(texts))] == [other.encode(t) for t in texts]
    long = "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 50_000)))
    begun = time.process_time()
    assert own.encode(pa.array([long]))[0].tolist() == other.encode(long)
    assert time.process_time() - begun < 15 and not any(len(t) > pieces.LONG for t in own.done)


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="the vocabulary file is not here")
def test_parts_of_a_task_are_searched_once(monkeypatch):
    """A quarter of a million different words, then all again; and with room for few of them."""
    own, other = pieces.Pieces(pieces.load()), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [" ".join(f"{'É日x'[k % 3]}{n:05x}" for n in range(k, k + 25_000)) for k in range(0, 250_000, 25_000)]
    texts += ["x" * 600, "\n", " a  b", "", None]
    expected = [other.encode(t or "") for t in texts]
    assert [x.tolist() for x in own.encode(pa.array(texts))] == expected
    with monkeypatch.context() as m:
        m.setattr(own, "windows", None)
        m.setattr(own, "search", None)
        assert [x.tolist() for x in own.encode(pa.array(texts[:10]))] == expected[:10]
    monkeypatch.setattr(pieces, "KEEP", 1000)
    few = pieces.Pieces(own.table)
    for t, ids in zip(texts[:2] + texts[10:], expected[:2] + expected[10:]):
        for part in (t, t and t[:9000], t):
            assert few.encode(pa.array([part], pa.string()))[0].tolist() == (ids if part == t else other.encode(part))
        assert len(list(few.done)) <= 1000


def test_long_parts_without_a_common_border_are_searched_whole(monkeypatch):
    table = [("<unk>", 0.0, "other"), *[(t, s, "normal") for t, s in [("a", -9.0), ("b", -8.0), ("aa", -1.0), ("▁", -7.0), ("aaaa", -2.0)]]]
    own = pieces.Pieces(table)
    text = "a" * 700 + "b" + "a" * 601
    parts, _ = own.merge("▁" + text)
    expected = [own.id_of[p] for p in parts]
    assert own.encode(pa.array([text]))[0].tolist() == expected
    monkeypatch.setattr(pieces, "TRIES", 0)
    assert pieces.Pieces(table).encode(pa.array([text]))[0].tolist() == expected
