"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page becomes its leaf blocks in order: the text between the borders of block elements, without scripts, styles, the
head and other text that isn't shown.  Each block has features of its ancestors (tags, words of class and id) and of its
text (length, share of link text, punctuation, signs), hashed into a weight vector; two labels, main and other, with
transitions, are trained by maximum conditional likelihood (forward-backward, Adam) on labelled pages and decoded by
Viterbi.  Labelled pages are (html, texts of the main blocks); `sample_pages` makes such pages in many layouts.

Character references are decoded, white space in a block (line breaks too) becomes one space, blocks are trimmed and
joined by an empty line.  Defined cases: null or empty html has no blocks and gives the empty text; broken mark-up is
read as browsers do, as far as implied ends of p, li and table cells go; a page's text may be long: one page at a time
is in memory; repeated rows and null ids are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

FEATURES = 1 << 12
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("head script style noscript template title svg iframe object textarea select option datalist audio video canvas".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mover mroot mrow ms mspace msqrt msub msubsup msup mtext munder munderover q s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag that ends open elements of these kinds, up to the nearest of the barriers.
P_BLOCKS = "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
CLOSES = {t: ({"p"}, {"table", "td", "th", "button"}) for t in P_BLOCKS} | {
    "li": ({"li", "p"}, {"ul", "ol", "menu", "table"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}), "body": ({"head"}, set()),
}
_PART = re.compile(r"[a-z]+")


class _Blocks(HTMLParser):
    """blocks: (text, share of its characters in links, ancestors as (tag, words), innermost last)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, float, tuple]] = []
        self.open: list[tuple[str, tuple]] = []
        self.hidden = self.links = 0
        self.held: list[str] = []
        self.linked = 0
        self.at: tuple = ()

    def border(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            if text:
                self.blocks.append((text, min(1.0, self.linked / len(text)), self.at))
            self.held, self.linked = [], 0

    def pop_to(self, k: int) -> None:
        for tag, _ in self.open[k:]:
            self.hidden -= tag in HIDDEN
            self.links -= tag == "a"
            if tag not in INLINE:
                self.border()
        del self.open[k:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES and self.open:
            ends, barriers = CLOSES[tag]
            found = None
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] in barriers:
                    break
                if self.open[k][0] in ends:
                    found = k
            if found is not None:
                self.pop_to(found)
        if tag == "br":
            self.handle_data(" ")
            return
        if tag not in INLINE:
            self.border()
        if tag not in VOID:
            words = tuple(sorted({w for k, v in attrs if k in ("class", "id", "role", "itemprop") and v for w in _PART.findall(v.lower())}))
            self.open.append((tag, words))
            self.hidden += tag in HIDDEN
            self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.pop_to(k)
                return
            if tag in INLINE and self.open[k][0] not in INLINE:
                return  # an inline end tag closes nothing outside its block

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            if not self.held:
                self.at = tuple(x for x in self.open if x[0] not in INLINE)
            self.held.append(data)
            if self.links:
                self.linked += len(data.strip())


def leaf_blocks(page: str | None) -> list[tuple[str, float, tuple]]:
    p = _Blocks()
    p.feed(page or "")
    p.close()
    p.pop_to(0)
    p.border()
    return p.blocks


_hashes: dict[str, int] = {}


def _bucket(name: str) -> int:
    if name not in _hashes:
        if len(_hashes) > 100_000:
            _hashes.clear()
        _hashes[name] = zlib.crc32(name.encode()) % FEATURES
    return _hashes[name]


def _level(x: float, cuts: tuple) -> int:
    return sum(x >= c for c in cuts)


def features(block: tuple[str, float, tuple]) -> list[int]:
    text, linked, at = block
    names = {"bias", f"words{_level(text.count(' ') + 1, (3, 6, 12, 25, 60))}", f"links{_level(linked, (0.01, 0.35, 0.8))}", f"end{text[-1] in '.!?…。'}"}
    names |= {f"comma{_level(text.count(',') / len(text), (0.002, 0.01))}"}
    if re.search(r"[©®|»›·]|\(c\)", text):
        names.add("sign")
    for tag, words in at:
        names.add(f"in:{tag}")
        names.update(f"word:{w}" for w in words)
    if at:
        names.add(f"own:{at[-1][0]}")
    return sorted({_bucket(x) for x in names})


def _forward_backward(scores: np.ndarray, mask: np.ndarray, trans: np.ndarray, first: np.ndarray):
    """Marginals [n, t, 2], pair marginals [2, 2] summed, log partition; scores: [n, t, 2]."""
    n, t, _ = scores.shape
    a, b = np.zeros_like(scores), np.zeros_like(scores)
    a[:, 0] = scores[:, 0] + first
    for i in range(1, t):
        a[:, i] = np.where(mask[:, i, None], np.logaddexp.reduce(a[:, i - 1, :, None] + trans, axis=1) + scores[:, i], a[:, i - 1])
    for i in range(t - 2, -1, -1):
        b[:, i] = np.where(mask[:, i + 1, None], np.logaddexp.reduce(trans + (scores[:, i + 1] + b[:, i + 1])[:, None, :], axis=2), b[:, i + 1])
    z = np.logaddexp.reduce(a[:, -1], axis=1)
    gamma = np.exp(a + b - z[:, None, None]) * mask[:, :, None]
    pairs = a[:, :-1, :, None] + trans + (scores[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]
    return gamma, (np.exp(pairs) * mask[:, 1:, None, None]).sum((0, 1)), z


Model = tuple[np.ndarray, np.ndarray, np.ndarray]


def train(pages: list[tuple[str, set[str]]], rounds: int = 150, l2: float = 1e-3, rate: float = 0.1) -> Model:
    """(weights [features, 2], transitions [from, to], start) from pages with the texts of their main blocks."""
    read = [(b, main) for page, main in pages if (b := leaf_blocks(page))]
    n, t = len(read), max(len(b) for b, _ in read)
    mask, gold = np.zeros((n, t), bool), np.zeros((n, t), np.int64)
    at, of = [], []
    for i, (blocks, main) in enumerate(read):
        for j, b in enumerate(blocks):
            mask[i, j], gold[i, j] = True, b[0] in main
            f = features(b)
            at += f
            of += [i * t + j] * len(f)
    at, of = np.array(at), np.array(of)
    truth = np.eye(2)[gold] * mask[:, :, None]
    gold_pairs = np.zeros((2, 2))
    np.add.at(gold_pairs, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
    theta = [np.zeros((FEATURES, 2)), np.zeros((2, 2)), np.zeros(2)]
    m, v = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    for step in range(1, rounds + 1):
        w, trans, first = theta
        scores = np.stack([np.bincount(of, w[at, y], n * t) for y in range(2)], -1).reshape(n, t, 2)
        gamma, pairs, _ = _forward_backward(scores, mask, trans, first)
        miss = (gamma - truth).reshape(n * t, 2)
        grads = [np.stack([np.bincount(at, miss[of, y], FEATURES) for y in range(2)], -1), pairs - gold_pairs, (gamma[:, 0] - truth[:, 0]).sum(0)]
        for k, g in enumerate(grads):
            g = g / n + l2 * theta[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            theta[k] = theta[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return theta[0], theta[1], theta[2]


def decode(blocks: list, model: Model) -> list[bool]:
    """Which blocks are main text, by Viterbi."""
    w, trans, first = model
    if not blocks:
        return []
    scores = [w[features(b)].sum(0).tolist() for b in blocks]
    (t00, t01), (t10, t11) = trans.tolist()
    other, main = scores[0][0] + float(first[0]), scores[0][1] + float(first[1])
    back = []
    for s0, s1 in scores[1:]:
        to0, to1 = (other + t00, main + t10), (other + t01, main + t11)
        back.append((to0[1] > to0[0], to1[1] > to1[0]))
        other, main = max(to0) + s0, max(to1) + s1
    state = main > other
    out = [state]
    for b in reversed(back):
        state = b[state]
        out.append(state)
    return out[::-1]


def main_text(page: str | None, model: Model) -> str:
    blocks = leaf_blocks(page)
    return "\n\n".join(b[0] for b, keep in zip(blocks, decode(blocks, model), strict=True) if keep)


def sample_pages(n: int = 600, seed: int = 11) -> list[tuple[str, set[str]]]:
    """Labelled pages in varied layouts: what surrounds an article, in the elements and classes that sites use for it."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzéñü") for _ in range(r.randint(1, 9)))
    some = lambda lo, hi: " ".join(word() for _ in range(r.randint(lo, hi)))
    said = lambda lo, hi: ". ".join(some(max(1, lo // 3), max(2, hi // 3)).capitalize() + r.choice(["", f", {word()}"]) for _ in range(r.randint(1, 3))) + "."
    any_text = lambda: r.choice([some(1, 6), said(2, 20), said(10, 60)])
    links = lambda: "".join(f'<li><a href="/{word()}">{some(1, 3)}</a>' + r.choice(["</li>", ""]) for _ in range(r.randint(1, 7)))

    def attr(*names: str) -> str:
        name = r.choice(names)
        return r.choice([f' class="{name}"', f' id="{name}"', f' class="{word()} {name}"', f' class="{name} {word()}"'])

    def box(names: tuple, inner: str, tags: tuple = ("div", "section", "aside", "div")) -> str:
        tag = r.choice(tags)
        return f"<{tag}{attr(*names)}>{inner}</{tag}>"

    def other() -> str:
        text = r.choice([any_text(), f"<p>{any_text()}</p>", f"<h3>{some(1, 4)}</h3><p>{any_text()}</p>", f"<ul>{links()}</ul>", f"<span>{any_text()}</span><br>{some(1, 5)}"])
        return r.choice([
            lambda: f"<nav{r.choice(['', attr('menu', 'nav', 'main-nav', 'breadcrumb')])}>" + r.choice([f"<ul>{links()}</ul>", f"<a href='/'>{some(1, 2)}</a> | <a href='/x'>{some(1, 2)}</a>"]) + "</nav>",
            lambda: f"<header{r.choice(['', attr('site-header', 'masthead')])}>{text}</header>",
            lambda: f"<footer{r.choice(['', attr('footer', 'site-footer')])}>{r.choice(['&copy; ', '', '&middot; '])}{text}</footer>",
            lambda: f"<aside{r.choice(['', attr('sidebar', 'side')])}>{text}</aside>",
            lambda: f"<form{r.choice(['', attr('search', 'login', 'newsletter', 'subscribe')])}><label>{some(1, 4)}</label><input name=q><p>{any_text()}</p><button>{some(1, 2)}</button></form>",
            lambda: box(("menu", "navbar", "nav", "navigation", "breadcrumbs", "topbar", "toc"), f"<ul>{links()}</ul>"),
            lambda: box(("ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored", "sponsor", "adsbygoogle"), text),
            lambda: box(("sidebar", "side", "widget", "related", "recommended", "popular", "trending", "tags", "share", "social", "author-box", "pagination"), text),
            lambda: box(("cookie", "cookies", "consent", "notice", "alert", "gdpr", "modal", "popup", "disclaimer", "warning", "overlay", "newsletter", "subscribe", "paywall"), text),
            lambda: box(("header", "masthead", "site-header", "logo", "top"), text),
            lambda: box(("footer", "site-footer", "copyright", "legal", "bottom", "credits"), r.choice(["&copy; ", ""]) + text),
            lambda: box(("comments", "comment-list", "commentlist", "replies", "disqus", "responses", "reader-comments", "comment"), "".join(f"<div{attr('comment', 'reply')}><b>{some(1, 2)}</b><p>{any_text()}</p></div>" for _ in range(r.randint(1, 4))), ("div", "section", "ol")),
        ])()

    out = []
    for _ in range(n):
        main: set[str] = set()

        def own(text: str, main: set[str] = main) -> str:
            text = " ".join(text.split())
            main.add(text)
            return text.replace("&", "&amp;")

        def part() -> str:
            kind = r.random()
            if kind < 0.6:
                return f"<p>{own(r.choice([any_text(), said(20, 90), said(2, 6)]))}" + r.choice(["</p>", "</p>", ""])
            if kind < 0.7:
                return f"<p><b>{own(any_text())}<br>"
            if kind < 0.78:
                return f"<h{(k := r.randint(1, 4))}>{own(some(1, 9))}</h{k}>"
            if kind < 0.85:
                return "<ul>" + "".join(f"<li>{own(any_text())}</li>" for _ in range(r.randint(1, 4))) + "</ul>"
            if kind < 0.9:
                return f"<blockquote><p>{own(said(5, 30))}</p></blockquote>"
            if kind < 0.94:
                return f"<pre>{own(some(3, 20))}</pre>"
            if kind < 0.97:
                return "<table>" + "".join(f"<tr><td>{own(some(1, 4))}</td><td>{own(some(1, 6))}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>"
            return f"<figure><img src=x><figcaption>{own(some(2, 9))}</figcaption></figure>"

        body = (f"<h1>{own(some(2, 10))}</h1>" if r.random() < 0.8 else "") + "".join(part() + (other() if r.random() < 0.08 else "") for _ in range(r.choice([1, 2, 4, 8, 16])))
        wrap = r.random()
        if wrap < 0.5:
            body = f"<article{r.choice(['', '', attr('post', 'article', 'entry')])}>{body}</article>"
        elif wrap < 0.65:
            body = f"<main{r.choice(['', attr('main', 'content')])}>{body}</main>"
        elif wrap < 0.93:
            body = box(("content", "main", "article", "post", "entry", "entry-content", "post-content", "article-body", "body", "text", "story", "main-content"), body, ("div", "section", "div"))
        if wrap < 0.5 and r.random() < 0.3:
            body = f"<main>{body}</main>"
        around = lambda most: "".join(other() for _ in range(r.randint(0, most)))
        inner = around(4) + body + around(4)
        inner = r.choice([inner, inner, f'<div class="{word()}">{inner}</div>', f'<div id="page" class="wrapper container">{inner}</div>'])
        out.append((f"<!DOCTYPE html><html><head><title>{some(1, 5)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{inner}" + r.choice(["</body></html>", ""]), main))
    return out


_model: list[Model] = []


def default_model() -> Model:
    """The model of sample_pages, trained once in a process."""
    if not _model:
        _model.append(train(sample_pages()))
    return _model[0]


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    prepare(spark := pages.sparkSession)
    shared = spark.sparkContext.broadcast(model or default_model())

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["text"] = [main_text(page, shared.value) for page in f.pop("html")]
            yield f

    kept = pages.select(F.to_json(F.struct("page_id", "url")).alias("k"), "html")
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    out = kept.mapInPandas(each, "k string, text string").withColumn("k", F.from_json("k", f"struct<page_id:{id_type},url:{url_type}>"))
    return out.select("k.page_id", "k.url", "text", F.length("text").cast("bigint").alias("n_chars"))
