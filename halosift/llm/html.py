r"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: stretches of text between the borders of block
elements, in page order, each with the tags and names (class, id, role) of its
ancestors. Scripts, styles and the like are no text. Binary features of
ancestors, of the text and of its place feed a chain with two labels, main and
other; Viterbi picks the best labelling of all blocks of a page, and the main
blocks are its text.

Training pages are labelled in two ways. Pages of the table that mark their
article (``<article>`` or ``<main>``) label themselves; at most ``PAGES`` of
them are used, those with the smallest hashes of their page_id. Pages made by a
rule add what those may lack: sidebars, notices, forms, comments and articles
in unmarked elements; their layouts are drawn from the lists below and filled
with blocks of the table's own training pages. Both are fitted together by
gradient ascent on the exact likelihood.

Inside a block white space becomes one space and ends are trimmed, character
references are decoded; ``<br>`` is white space. Null and empty pages have no
text. Text outside any tag is a block; unclosed and stray tags are borne: an
unclosed script, style, noscript, template, textarea or title runs to the end of
the page, another skipped element without an end to the next block border. Equal
pages get equal texts. With no page to learn from the rule's pages alone are
used. Other columns, whatever their names, are handed through by `extract`.
"""

from __future__ import annotations

import html as entities
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halosift.llm.batches import add_struct, fresh
from halosift.llm.tables import send

PAGES, MADE = 400, 600  # labelled pages of the table and of the rule
EPOCHS, RATE, SHRINK = 100, 0.5, 1e-5

# Elements whose content is no text of the page. The first run to the end of a page that does not close them.
TO_THE_END = "script style noscript template textarea title".split()
SKIPPED = set("svg math iframe object select button option canvas audio video".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
# Elements that end an open paragraph; and those that end an open one of their own kind.
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

# Borders for an unclosed svg or math, whose own elements are no blocks; and what is no border in other skipped elements.
BORDERS = CLOSES_P | set(LIKE) | {"html", "body", "tbody", "thead", "tfoot", "caption"}
NO_BORDERS = INLINE | (VOID - {"hr"}) | SKIPPED | set(TO_THE_END) | {"optgroup"}

# Quotes count right after an equals sign only; elsewhere they are characters like others.
_ATTRS = r"(?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+"
_PASSED = r"<!--.*?(?:-->|\Z)|<(" + "|".join(TO_THE_END) + r")(?=[\s/>])" + _ATTRS + r">.*?(?:</\1\s*>|\Z)"
_TOKEN = re.compile(_PASSED + r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(" + _ATTRS + ")>|<[!?][^>]*>", re.S | re.I)
_SKIP = re.compile(_PASSED + r"|<(/?)(" + "|".join(sorted(SKIPPED)) + r")(?=[\s/>])(" + _ATTRS + ")>", re.S | re.I)
_BORDER = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)" + _ATTRS + ">")
_NAMES = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PART = re.compile(r"[a-z]+")
_HREF = re.compile(r"\bhref\b", re.I)

# Names that speak for a kind of block; a name counts by its parts.
KINDS = {
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner outbrain taboola",
    "nav": "nav navigation navbar menu menubar breadcrumb breadcrumbs pagination pager toolbar tabs links",
    "head": "header masthead topbar logo branding",
    "foot": "footer foot copyright colophon legal",
    "side": "sidebar side aside widget related recommended trending popular rail more",
    "notice": "cookie cookies consent notice gdpr popup modal overlay alert privacy subscribe newsletter signup paywall",
    "comment": "comment comments reply replies disqus discussion respond reader",
    "form": "form search login signin register input",
    "share": "share social sharing follow tags meta byline author date",
    "main": "article main content body post entry story text page prose blog",
}
_KIND_OF = {w: k for k, words in KINDS.items() for w in words.split()}
TAGS = "article main nav header footer aside form section div p h1 h2 h3 ul ol li table td blockquote pre figure figcaption dl body".split()
SECTION = {"nav", "header", "footer", "aside", "form", "article", "main"}


@dataclass
class Block:
    text: str
    path: tuple  # of (tag, kinds of its names)
    linked: float  # share of the text inside links
    marked: bool  # inside <article> or <main>


def skips(page: str) -> dict[int, int]:
    """Where the skipped elements that are closed begin and end; an end tag closes the last open one of its name."""
    out: dict[int, int] = {}
    begun: dict[str, list[int]] = {}
    for m in _SKIP.finditer(page):
        if m[3] is None:
            continue
        tag = m[3].lower()
        if not m[2]:
            if tag in ("svg", "math") and m[4].endswith("/"):
                out[m.start()] = m.end()
            else:
                begun.setdefault(tag, []).append(m.start())
        elif begun.get(tag):
            out[begun[tag].pop()] = m.end()
    return out


def border(page: str, at: int, tag: str) -> int:
    """The next block border from ``at`` on, for an unclosed skipped element."""
    for m in _BORDER.finditer(page, at):
        name = m[1].lower()
        if name in BORDERS if tag in ("svg", "math") else name not in NO_BORDERS:
            return m.start()
    return len(page)


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple]] = []
    text: list[str] = []
    in_link, linked, whole = 0, 0, 0

    def close() -> None:
        nonlocal text, linked, whole
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                out.append(Block(joined, tuple(stack), linked / max(1, whole), any(t in ("article", "main") for t, _ in stack)))
            text, linked, whole = [], 0, 0

    def add(piece: str) -> None:
        nonlocal linked, whole
        if piece:
            text.append(piece)
            n = len(piece.strip())
            whole += n
            linked += n if in_link else 0

    at = 0
    closed: dict[int, int] | None = None
    while m := _TOKEN.search(page, at):
        add(page[at:m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in SKIPPED and not m[2]:
            if closed is None:
                closed = skips(page)
            at = closed.get(m.start()) or border(page, at, tag)
            continue
        if tag == "a":
            in_link = 0 if m[2] else 1 if _HREF.search(m[4]) else in_link
        if tag == "br":
            text.append(" ")
        elif tag in INLINE or (tag in VOID and tag != "hr"):
            continue
        elif m[2]:
            close()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag == "p" or (stack[k][0] in SECTION and tag not in SECTION and tag not in ("body", "html", "div", "section")):
                    break
        else:
            close()
            in_link = 0
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] in SECTION or stack[k][0] in ("div", "td", "li"):
                        break
            ends = LIKE.get(tag)
            if ends:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ends:
                        del stack[k:]
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table"):
                        break
            if tag not in VOID:
                names = " ".join(x or y or z for x, y, z in _NAMES.findall(m[4])) if m[4] else ""
                kinds = tuple(sorted({_KIND_OF[w] for w in _PART.findall(names.lower()) if w in _KIND_OF})) if names else ()
                stack.append((tag, kinds))
    add(page[at:])
    close()
    return out


def names() -> list[str]:
    out = ["always", "first", "last"]
    out += [f"tag {t}" for t in TAGS] + [f"own {t}" for t in TAGS]
    out += [f"kind {k}" for k in KINDS] + [f"near {k}" for k in KINDS]
    out += [f"words {k}" for k in range(6)] + [f"linked {k}" for k in range(3)]
    out += ["ends sentence", "copyright", "no letters", "capitals", "says cookie", "says login", "says share", "bare"]
    return out


_FEATURE = {n: i for i, n in enumerate(names())}
_BARE_SIGN = re.compile(r"©|\(c\)\s*\d{4}|copyright|all rights reserved", re.I)
_COOKIE = re.compile(r"\bcookies?\b|\bconsent\b|\bprivacy policy\b|\bsubscribe\b|\bnewsletter\b", re.I)
_LOGIN = re.compile(r"\b(log ?in|sign ?(in|up)|password|e-?mail address|search)\b", re.I)
_SHARE = re.compile(r"\b(share|tweet|follow us|posted (by|on|in)|repl(y|ies)|comments?)\b", re.I)


def features(page: list[Block]) -> list[list[int]]:
    """Numbers of the features of every block."""
    out = []
    path_cache: dict[tuple, list[int]] = {}
    for i, b in enumerate(page):
        known = path_cache.get(b.path)
        if known is None:
            f = {0}
            for depth, (tag, kinds) in enumerate(reversed(b.path)):
                if tag in TAGS:
                    f.add(_FEATURE[f"tag {tag}"])
                    if depth == 0:
                        f.add(_FEATURE[f"own {tag}"])
                for k in kinds:
                    f.add(_FEATURE[f"kind {k}"])
                    if depth <= 1:
                        f.add(_FEATURE[f"near {k}"])
            if not b.path or b.path[-1][0] in ("body", "html"):
                f.add(_FEATURE["bare"])
            known = path_cache[b.path] = sorted(f)
        f = list(known)
        if i == 0:
            f.append(_FEATURE["first"])
        if i == len(page) - 1:
            f.append(_FEATURE["last"])
        n = b.text.count(" ") + 1
        f.append(_FEATURE[f"words {0 if n < 3 else 1 if n < 6 else 2 if n < 12 else 3 if n < 25 else 4 if n < 60 else 5}"])
        f.append(_FEATURE[f"linked {0 if b.linked < 0.2 else 1 if b.linked < 0.8 else 2}"])
        if b.text[-1] in ".!?\"')…”":
            f.append(_FEATURE["ends sentence"])
        if n < 40:
            if _BARE_SIGN.search(b.text):
                f.append(_FEATURE["copyright"])
            if _COOKIE.search(b.text):
                f.append(_FEATURE["says cookie"])
            if _LOGIN.search(b.text):
                f.append(_FEATURE["says login"])
            if _SHARE.search(b.text):
                f.append(_FEATURE["says share"])
        if not any(c.isalpha() for c in b.text):
            f.append(_FEATURE["no letters"])
        elif b.text.isupper():
            f.append(_FEATURE["capitals"])
        out.append(f)
    return out


class Chain:
    """Weights features x labels (other, main) and labels x labels; log-linear in both."""

    def __init__(self):
        self.unary = np.zeros((len(_FEATURE), 2))
        self.pair = np.zeros((2, 2))

    def scores(self, page: list[list[int]]) -> np.ndarray:
        flat = np.concatenate([np.array(f) for f in page])
        return np.add.reduceat(self.unary[flat], np.cumsum([0, *map(len, page)])[:-1], axis=0)

    def decode(self, page: list[list[int]]) -> list[bool]:
        """Viterbi; a tie stays with the label other."""
        if not page:
            return []
        s = self.scores(page).tolist()
        (p00, p01), (p10, p11) = self.pair.tolist()
        a, b = s[0]
        back = []
        for x, y in s[1:]:
            stay0, turn0, turn1, stay1 = a + p00, b + p10, a + p01, b + p11
            back.append((turn0 > stay0, stay1 > turn1))
            a, b = max(stay0, turn0) + x, max(stay1, turn1) + y
        state = b > a
        out = [state]
        for to_other, to_main in reversed(back):
            state = to_main if state else to_other
            out.append(bool(state))
        return out[::-1]

    def fit(self, pages: list[tuple[list[list[int]], list[bool]]]) -> "Chain":
        """Full-batch gradient ascent (Adagrad) on the likelihood, all pages padded to one array."""
        pages = [p for p in pages if p[0]]
        if not pages:
            return self
        most = max(len(f) for f, _ in pages)
        rows = len(pages)
        live = np.zeros((rows, most), bool)
        y = np.zeros((rows, most), int)
        at, which = [], []
        for r, (f, label) in enumerate(pages):
            live[r, :len(f)] = True
            y[r, :len(f)] = label
            for i, fs in enumerate(f):
                at += [r * most + i] * len(fs)
                which += fs
        at, which = np.array(at), np.array(which)
        memory_u, memory_p = np.full_like(self.unary, 1e-6), np.full_like(self.pair, 1e-6)
        total = live.sum()
        truth_pair = np.zeros((2, 2))
        both = live[:, 1:] & live[:, :-1]
        np.add.at(truth_pair, (y[:, :-1][both], y[:, 1:][both]), 1)
        for _ in range(EPOCHS):
            s = np.zeros((rows * most, 2))
            for k in (0, 1):
                s[:, k] = np.bincount(at, self.unary[which, k], rows * most)
            s = s.reshape(rows, most, 2)
            fwd, bwd = np.zeros_like(s), np.zeros_like(s)
            fwd[:, 0] = s[:, 0]
            for i in range(1, most):
                step = np.logaddexp(fwd[:, i - 1, 0, None] + self.pair[0], fwd[:, i - 1, 1, None] + self.pair[1]) + s[:, i]
                fwd[:, i] = np.where(live[:, i, None], step, fwd[:, i - 1])
            for i in range(most - 2, -1, -1):
                nxt = s[:, i + 1] + bwd[:, i + 1]
                step = np.logaddexp(nxt[:, 0, None] + self.pair[:, 0], nxt[:, 1, None] + self.pair[:, 1])
                bwd[:, i] = np.where(live[:, i + 1, None], step, 0)
            norm = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
            p = np.exp(fwd + bwd - norm[:, None, None]) * live[:, :, None]
            wanted = np.stack([1 - y, y], axis=-1) * live[:, :, None] - p
            wanted = wanted.reshape(-1, 2)
            grad_u = np.stack([np.bincount(which, wanted[at, k], len(_FEATURE)) for k in (0, 1)], axis=1) / total - SHRINK * self.unary
            pairs = np.exp(fwd[:, :-1, :, None] + self.pair + (s + bwd)[:, 1:, None, :] - norm[:, None, None, None]) * both[:, :, None, None]
            grad_p = (truth_pair - pairs.sum(axis=(0, 1))) / total - SHRINK * self.pair
            memory_u += grad_u ** 2
            memory_p += grad_p ** 2
            self.unary += RATE * grad_u / np.sqrt(memory_u)
            self.pair += RATE * grad_p / np.sqrt(memory_p)
        return self


# Layouts of the rule's pages: what may stand around an article, and in what it may stand.
_WRAPS = ['<article>{}</article>', '<main>{}</main>', '<div class="content">{}</div>', '<div id="main-content"><div class="post-body">{}</div></div>',
          '<div class="entry">{}</div>', '<section class="story">{}</section>', '<main><div class="text">{}</div></main>', '<div>{}</div>']
_AROUND_BEFORE = ['<nav><ul>{links}</ul></nav>', '<div class="menu"><ul>{links}</ul></div>', '<header><p>{short}</p></header>', '<div id="header">{short}</div>',
                  '<div class="breadcrumbs">{inline}</div>', '<div class="cookie-notice"><p>We use cookies. {text}</p></div>', '<div class="ad">{text}</div>',
                  '<form class="search"><label>Search</label><input></form>', '<div class="banner">{text}</div>']
_AROUND_AFTER = ['<footer>&copy; {short}</footer>', '<footer><p>{text}</p></footer>', '<aside><h2>{short}</h2><ul>{links}</ul></aside>', '<div class="sidebar"><p>{text}</p><p>{text}</p></div>',
                 '<section class="comments"><h2>Comments</h2><p>{text}</p><p>{text}</p></section>', '<div id="comments"><div class="comment"><p>{text}</p></div></div>',
                 '<div class="related"><h3>{short}</h3><ul>{links}</ul></div>', '<form><p>{short}</p><p>{text}</p></form>', '<div class="newsletter"><p>{text}</p></div>',
                 '<div id="footer">{text}</div>', '<div class="ads">{text}</div>', '<aside><p>{text}</p></aside>', '<div class="consent"><p>{text}</p></div>']
_INSIDE = ['<div class="ad">{text}</div>', '<aside><p>{text}</p></aside>', '<div class="share">{inline}</div>', '<div class="promo"><p>{text}</p></div>', '<form><p>{short}</p></form>']
_MAIN_BLOCKS = ['<p>{}</p>'] * 6 + ['<h2>{}</h2>', '<ul><li>{}</li></ul>', '<blockquote><p>{}</p></blockquote>', '<pre>{}</pre>', '<div>{}</div>', '<table><tr><td>{}</td></tr></table>']
_FILL = ["Some words of a plain sentence stand here.", "Another one follows, and it is a little longer than the first.", "Short.", "More of it"]


def made_pages(fill: list[str], count: int, seed: int = 5) -> list[tuple[list[Block], list[bool]]]:
    """Pages by the rule with their labels; a mark in the text of main blocks tells them, and goes again."""
    rng = random.Random(seed)
    fill = [entities.escape(x, quote=False) for x in fill] or _FILL
    sign = "⁠"
    some = lambda n: " ".join(rng.choice(fill).split()[:n])

    def put(form: str) -> str:
        while "{" in form:
            for key, make in (("{text}", lambda: some(rng.choice([6, 12, 30, 80]))), ("{short}", lambda: some(rng.choice([2, 4, 7]))),
                              ("{links}", lambda: "".join(f'<li><a href="/{k}">{some(rng.choice([1, 2, 5]))}</a></li>' for k in range(rng.randint(2, 7)))),
                              ("{inline}", lambda: " ".join(f'<a href="/{k}">{some(1)}</a>' for k in range(3)))):
                if key in form:
                    form = form.replace(key, make(), 1)
        return form

    out = []
    for _ in range(count):
        parts = [f"<h1>{sign}{some(10)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 9)):
            parts.append(rng.choice(_MAIN_BLOCKS).format(sign + some(rng.choice([1, 4, 10, 30, 60, 200]))))
            if rng.random() < 0.25:
                parts.append(put(rng.choice(_INSIDE)))
        wrap = rng.choice(_WRAPS)
        if re.match("<(article|main)", wrap) and rng.random() < 0.3:  # links may be a part of the article
            items = "".join(f'<li><a href="/{k}">{sign}{some(rng.choice([1, 2, 4]))}</a></li>' for k in range(rng.randint(1, 5)))
            parts.insert(rng.choice([len(parts), rng.randint(0, len(parts))]), f"<ul>{items}</ul>")
        main = wrap.format("".join(parts))
        before = "".join(put(x) for x in rng.sample(_AROUND_BEFORE, rng.randint(0, 4)))
        after = "".join(put(x) for x in rng.sample(_AROUND_AFTER, rng.randint(0, 5)))
        page = blocks(f"<html><body>{before}{main}{after}</body></html>")
        label = [b.text.startswith(sign) for b in page]
        for b in page:
            b.text = b.text.replace(sign, "") or "x"
        out.append((page, label))
    return out


def learn(pages: list[str]) -> Chain:
    """A chain fitted on pages that mark their article and on pages by the rule."""
    own = [blocks(p) for p in pages]
    own = [p for p in own if any(b.marked for b in p)]
    label = [[b.marked and not any(t in SECTION - {"article", "main"} for t, _ in b.path) for b in p] for p in own]
    fill = [b.text for p in own for b in p if b.marked]
    every = list(zip(own, label)) + made_pages(fill, MADE)
    return Chain().fit([(features(p), y) for p, y in every])


def text_of(page: str, chain: Chain) -> str:
    own = blocks(page)
    return "\n".join(b.text for b, keep in zip(own, chain.decode(features(own))) if keep) if own else ""


def extract(pages: DataFrame, html: str = "html", key: str = "page_id", most: int = PAGES) -> tuple[DataFrame, str]:
    """``pages`` with a struct column: text and n_chars of the main text; and its name."""
    some = pages.filter(F.col(html).rlike("(?i)<(article|main)[ >]"))
    keys = some.select(F.xxhash64(key).alias("_h")).distinct().orderBy("_h").limit(most)  # numbers only go to one task
    chosen = [r["_h"] for r in keys.collect()]
    rows = some.filter(F.xxhash64(key).isin(chosen)).select(html, F.xxhash64(key).alias("_h")).orderBy("_h", F.xxhash64(html), html).limit(most).collect()
    chain = learn([r[html] for r in sorted(rows, key=lambda r: (r["_h"], r[html]))])
    out = fresh(pages, "main")
    sent = send(pages.sparkSession, chain)

    def make():
        own = sent()

        def work(batch: dict) -> dict:
            text = [text_of(x.as_py() or "", own) for x in batch["html"]]
            return {"text": pa.array(text, pa.string()), "n_chars": pa.array([len(x) for x in text], pa.int64())}

        return work

    return add_struct(pages, out, "text string, n_chars bigint", make, {"html": html}), out


def report(pages: DataFrame) -> DataFrame:
    got, m = extract(pages.select("page_id", "url", "html"))
    return got.select("page_id", "url", f"{m}.text", f"{m}.n_chars")

