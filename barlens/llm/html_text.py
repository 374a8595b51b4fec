"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into its leaf blocks: the text between block-level tags, with the tags, classes, ids and roles of
all its ancestors.  The field scores each block from ancestor and text features and each pair of neighbours, and
Viterbi decoding marks the blocks of the article.  It is trained on labelled pages: a bounded sample of the table's
own pages that mark their article with ``article`` or ``main``, as they are and with their blocks set into other
layouts (named containers instead of semantic tags; menus, notices, adverts, forms, sidebars and comments around
and inside the article).
"""

from __future__ import annotations

import html as _html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<(/?)([a-zA-Z][\w:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][\w:-]*)([^>]*+)>|<[!?][^>]*+>""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")
# fixed values of HTML: elements that do not break a line, that hold no text of the page, that have no end tag
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img"
                    " math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd maction semantics annotation annotation-xml".split())
_RAW = frozenset("script style".split())
_SILENT = frozenset("template title noscript svg iframe object canvas audio video select datalist".split())
_SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/\s*$|^[^=]*/\s*$""")  # not the slash that ends an unquoted value
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass
class Block:
    text: str
    features: list[str]
    marked: bool = False  # inside ``article`` or ``main``
    foreign: bool = False  # inside a foreign container within that


class _Open:
    """The open elements, outermost first, with running counts: no step looks at all of them.  An inline element
    that ends inside others leaves a gap, so places stay as they are."""

    def __init__(self):
        self.tags: list[str | None] = []
        self.names: list[tuple[str, ...]] = []
        self.places: dict[str, list[int]] = {}  # by tag
        self.blocks: list[int] = []  # of elements that break a line
        self.marked: list[int] = []
        self.foreign: list[int] = []
        self.features: dict[str, int] = {}

    def __len__(self) -> int:
        return len(self.tags)

    def push(self, tag: str, attrs: str = "", silent: bool = False) -> None:
        k = len(self.tags)
        names, foreign = ((), False) if silent else _names(tag, attrs)
        self.tags.append(tag)
        self.names.append(names)
        self.places.setdefault(tag, []).append(k)
        if tag not in _INLINE:
            self.blocks.append(k)
        if tag in ("article", "main"):
            self.marked.append(k)
        if foreign:
            self.foreign.append(k)
        for f in names:
            self.features[f] = self.features.get(f, 0) + 1

    def _forget(self, k: int) -> None:
        for f in self.names[k]:
            if self.features[f] == 1:
                del self.features[f]
            else:
                self.features[f] -= 1
        for places in (self.places[self.tags[k]], self.blocks, self.marked, self.foreign):
            if places and places[-1] == k:
                places.pop()
        self.tags[k], self.names[k] = None, ()

    def cut(self, to: int) -> bool:
        """Close everything from place ``to`` on; whether an element that breaks a line was among it."""
        broke = bool(self.blocks) and self.blocks[-1] >= to
        for k in range(len(self.tags) - 1, to - 1, -1):
            if self.tags[k] is not None:
                self._forget(k)
        del self.tags[to:], self.names[to:]
        return broke

    def drop(self, k: int) -> None:
        """Close the inline element at place ``k`` alone, the last one of its tag."""
        self._forget(k)
        while self.tags and self.tags[-1] is None:
            self.tags.pop()
            self.names.pop()

    def last(self, tag: str) -> int | None:
        places = self.places.get(tag)
        return places[-1] if places else None


def blocks(page: str | None) -> list[Block]:
    """The page's leaf blocks in order, character references decoded, white space inside as one space.  Scripts and
    style sheets go up to their end tag; other silent elements (``_SILENT``) to their end tag or, without one, to the
    end of the element they stand in.  Work grows with the page, however deep its elements are nested."""
    page = page or ""
    stack = _Open()
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    pos, n = 0, len(page)
    hush: int | None = None  # place in the stack of the outermost silent element
    loose = False  # that element has no end tag
    last_end: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked
        if not parts or hush is not None:
            return
        text = " ".join(_html.unescape("".join(parts)).split())
        if text:
            marked = bool(stack.marked)
            out.append(Block(text, _features(stack, text, linked), marked, marked and bool(stack.foreign) and stack.foreign[-1] > stack.marked[0]))
        parts.clear()
        linked = 0

    def speak(to: int) -> None:
        nonlocal hush
        if hush is not None and to <= hush:
            stack.cut(hush)
            hush = None

    def ended(name: str) -> bool:
        if name not in last_end:
            last_end[name] = max((m.start() for m in re.finditer(rf"</{re.escape(name)}\s*>", page, re.I)), default=-1)
        return last_end[name] >= pos

    def close(to: int) -> None:
        speak(to)
        if stack.blocks and stack.blocks[-1] >= to:
            flush()
        stack.cut(to)

    def say(piece: str) -> None:
        nonlocal linked
        if piece and hush is None:
            parts.append(piece)
            if stack.last("a") is not None:
                linked += len(piece)

    while pos < n:
        m = _TAG.search(page, pos)
        if m is None:
            say(page[pos:])
            break
        say(page[pos: m.start()])
        pos = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA["):
                say(_html.escape(m[0][9:-3]))
            continue
        name = name.lower()
        if m[1] or m[4]:
            k = stack.last(name)
            if k is None:
                if name not in _INLINE:
                    flush()
            elif name in _INLINE:
                speak(k)
                stack.drop(k)
            else:
                close(k)
            continue
        if name == "br":
            say(" ")
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, pos)
            pos = end.end() if end else n
            continue
        attrs = m[3] or m[6] or ""
        if name in _SILENT:
            if name != "template":
                flush()
            if not _SELF_CLOSED.search(attrs):
                if hush is None:
                    hush, loose = len(stack), not ended(name)
                stack.push(name, silent=True)
            continue
        if name not in _INLINE:
            flush()
            gone = _CLOSES.get(name, {"p"} if name in _CLOSES_P else ())
            for k in reversed(stack.blocks):  # it ends at the first that is no paragraph
                if stack.tags[k] in gone:
                    close(k)
                    break
                if stack.tags[k] != "p" and not (loose and k == hush):
                    break
        if name not in _VOID and not attrs.rstrip().endswith("/"):
            stack.push(name, attrs)
    speak(0)
    flush()
    return out


def _names(tag: str, attrs: str) -> tuple[tuple[str, ...], bool]:
    """Features of an element, and whether it is a foreign container inside an article: by its tag, or by a whole
    class, id or role (``site-title`` does not make ``site`` foreign)."""
    got, tokens = ["t:" + tag], []
    if attrs:
        for a in _ATTR.finditer(attrs):
            value = (a[2] or a[3] or a[4] or "").lower()
            got += ["c:" + w for w in _NAME.findall(value)]
            tokens += value.split()
        got += ["k:" + t for t in tokens if not t.isalpha()]
    return tuple(dict.fromkeys(got)), tag in _FOREIGN_TAGS or not _FOREIGN.isdisjoint(tokens)


def _features(stack: _Open, text: str, linked: int) -> list[str]:
    words = text.count(" ") + 1
    own = stack.tags[stack.blocks[-1]] if stack.blocks else "none"
    link = linked / max(len(text), 1)
    return [*stack.features, "o:" + own, f"w:{min(words.bit_length(), 7)}", "l:" + ("none" if not linked else "some" if link < 0.5 else "all"),
            "e:" + ("stop" if text[-1] in ".!?:;…\"”" else "open"), "s:" + ("copy" if "©" in text else "plain"), "bias"]


@dataclass(frozen=True)
class Plan:
    """sample_rows: expected number of pages the labelled sample is made of (the bound of the fit).  layouts: other
    layouts per sampled page.  steps, rate, ridge: of the gradient ascent.  most_blocks: longer pages teach no
    more than their first and last blocks."""

    sample_rows: int = 240
    layouts: int = 4
    steps: int = 250
    rate: float = 0.15
    ridge: float = 5e-4
    most_blocks: int = 80


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    trans: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])
    start: list[float] = field(default_factory=lambda: [0.0, 0.0])

    def decode(self, page: list[Block]) -> list[bool]:
        """Viterbi: True for the blocks of the article."""
        w, ((a, b), (c, d)) = self.weights, self.trans
        s0, s1 = self.start
        back = []
        for i, blk in enumerate(page):
            e = sum(w.get(f, 0.0) for f in blk.features)
            if i:
                from0, from1 = (s0 + a < s1 + c), (s0 + b < s1 + d)
                back.append((from0, from1))
                s0, s1 = max(s0 + a, s1 + c), max(s0 + b, s1 + d) + e
            else:
                s1 += e
        out = [s1 > s0]
        for from0, from1 in reversed(back):
            out.append(from1 if out[-1] else from0)
        return out[::-1] if page else []

    def text(self, page: str | None) -> str:
        got = blocks(page)
        return " ".join(b.text for b, keep in zip(got, self.decode(got), strict=True) if keep)


# fixed values: containers of the layouts, as (tag, attributes); {} takes nothing
_ARTICLE = [("article", ""), ("main", ""), ("div", 'class="content"'), ("div", 'id="main-content"'), ("div", 'class="post-body"'), ("div", 'class="entry-content"'),
            ("section", 'class="article-body"'), ("div", 'class="story"'), ("div", 'role="main"'), ("article", 'class="post"'), ("div", 'class="text"'), ("div", 'itemprop="articleBody"'), ("div", 'id="article"')]
_AROUND = {
    "menu": [("nav", ""), ("div", 'class="menu"'), ("ul", 'class="nav"'), ("div", 'class="breadcrumbs"'), ("div", 'id="navbar"'), ("div", 'role="navigation"'), ("div", 'class="topnav"'), ("div", 'class="pagination"')],
    "header": [("header", ""), ("div", 'id="header"'), ("div", 'class="masthead"'), ("div", 'class="topbar"'), ("header", 'class="site-header"'), ("div", 'class="site-title"'), ("div", 'role="banner"')],
    "side": [("aside", ""), ("div", 'class="sidebar"'), ("div", 'id="sidebar"'), ("div", 'class="related"'), ("div", 'class="widget"'), ("div", 'class="recommended"'), ("div", 'class="right-rail"'), ("aside", 'class="related-posts"'), ("div", 'class="popular trending"'), ("div", 'role="complementary"')],
    "ad": [("div", 'class="ad"'), ("div", 'class="ads"'), ("div", 'class="advert"'), ("div", 'class="advertisement"'), ("div", 'class="sponsored"'), ("div", 'id="banner-ad"'), ("div", 'class="promo"'), ("section", 'class="promotion sponsor"'), ("ins", 'class="adsbygoogle"'), ("aside", 'class="ad-slot"')],
    "notice": [("div", 'class="cookie"'), ("div", 'id="cookie-notice"'), ("div", 'class="cookie-banner"'), ("div", 'class="notice"'), ("div", 'class="consent gdpr"'), ("div", 'class="newsletter subscribe"'), ("div", 'class="alert"'), ("div", 'class="popup modal"'), ("div", 'role="alert"'), ("div", 'class="paywall overlay"'), ("div", 'role="dialog"')],
    "form": [("form", ""), ("form", 'class="search"'), ("form", 'id="signup"'), ("form", 'class="login"'), ("fieldset", "")],
    "share": [("div", 'class="share"'), ("ul", 'class="social"'), ("div", 'class="share-buttons"'), ("div", 'class="tags"')],
    "comments": [("section", 'class="comments"'), ("div", 'id="comments"'), ("ol", 'class="commentlist"'), ("div", 'class="comment"'), ("div", 'class="comment-thread"'), ("div", 'id="disqus-thread"'), ("section", 'id="discussion"'), ("div", 'class="replies"'), ("div", 'class="user-comments reviews"'), ("section", 'class="reader-comments"')],
    "footer": [("footer", ""), ("div", 'id="footer"'), ("div", 'class="footer"'), ("div", 'class="site-footer"'), ("div", 'class="copyright"'), ("div", 'class="legal"'), ("div", 'role="contentinfo"'), ("div", 'class="disclaimer"')],
}
#: whole classes, ids and roles of these containers, and their tags: no part of an article that they stand in
_FOREIGN = frozenset(t for places in _AROUND.values() for _, attrs in places for a in _ATTR.finditer(attrs) for t in (a[2] or "").lower().split())
_FOREIGN_TAGS = frozenset(tag for places in _AROUND.values() for tag, _ in places) - frozenset("div ul ol section header ins fieldset".split())


def own_labels(page: list[Block]) -> list[bool] | None:
    """Labels of a page that marks its article itself: inside ``article`` or ``main``, but in no foreign container there.
    None for pages that do not."""
    return [b.marked and not b.foreign for b in page] if any(b.marked for b in page) else None


def layout(body: list[str], other: list[str], rng: random.Random) -> tuple[list[Block], list[bool]]:
    """One page of another layout: ``body`` as its article, ``other`` texts around and inside it."""
    esc, labels = _html.escape, {}

    def mark(text: str, keep: bool) -> str:
        tag = f"{len(labels)}"  # tells the blocks apart after parsing
        labels[tag] = keep
        return tag + esc(text)

    def some(n: int) -> list[str]:
        return [" ".join(rng.choice(other).split()[: rng.choice((1, 2, 4, 8, 16, 40))]) or "x" for _ in range(n)]

    def around(kind: str) -> str:
        tag, attrs = rng.choice(_AROUND[kind])
        if kind == "menu" or tag == "ul":
            inner = "".join(f"<li><a href='/x'>{mark(t[:30], False)}</a></li>" for t in some(rng.randint(2, 7)))
        elif kind == "form":
            inner = "".join(f"<label>{mark(t[:40], False)}</label><input name=q><button>{mark('ok', False)}</button>" for t in some(rng.randint(1, 2)))
        elif kind == "side":
            inner = "".join(rng.choice((f"<h3>{mark(t[:50], False)}</h3>", f"<p>{mark(t, False)}</p>", f"<p><a href='/y'>{mark(t, False)}</a></p>")) for t in some(rng.randint(1, 5)))
        elif tag == "ol":
            inner = "".join(f"<li><b>{mark(t, False)}</b></li>" for t in some(rng.randint(1, 4)))
        elif kind == "comments":
            inner = "".join(f"<div><b>{mark(a[:20], False)}</b><p>{mark(t, False)}</p></div>" for a, t in zip(some(4), some(rng.randint(1, 4)), strict=False))
        elif kind == "header":
            inner = f"<{(h := rng.choice(('div', 'p', 'h1', 'h2')))}>{mark(some(1)[0], False)}</{h}>"
        elif kind == "footer":
            inner = f"<p>&copy; {mark(some(1)[0], False)}</p>" if rng.random() < 0.5 else mark(some(1)[0], False)
        else:
            inner = "".join(rng.choice(("<p>{}</p>", "{}<br>", "<span>{}</span><hr>")).format(mark(t, False)) for t in some(rng.randint(1, 2)))
        return f"<{tag} {attrs}>{inner}</{tag}>"

    tag, attrs = rng.choice(_ARTICLE)
    inner = []
    for i, t in enumerate(body):
        form = rng.choices(("p", "h2", "li", "blockquote", "pre", "div", "td", "figcaption"), (60, 6, 8, 4, 2, 12, 3, 3))[0] if i else rng.choice(("h1", "h1", "h2", "p"))
        if rng.random() < 0.25:  # articles hold short lines too
            t = " ".join(t.split()[: rng.randint(1, 4)])
        t = mark(t, True)
        if rng.random() < 0.15:
            t = f"<a href='/z'>{t}</a>"
        inner.append({"li": f"<ul><li>{t}</li></ul>", "td": f"<table><tr><td>{t}</td></tr></table>", "figcaption": f"<figure><figcaption>{t}</figcaption></figure>"}.get(form, f"<{form}>{t}</{form}>"))
        if rng.random() < 0.12:
            inner.append(around(rng.choice(("ad", "notice", "share", "side", "form", "menu"))))
    if len(inner) > 2 and rng.random() < 0.4:  # plain sections of the article
        k, wrap = rng.randint(1, len(inner) - 1), rng.choice(("section", "div", "section"))
        inner[k:] = [f"<{wrap}>{''.join(inner[k:])}</{wrap}>"]
    if rng.random() < 0.35:
        inner.append(around("comments"))
    if rng.random() < 0.3:
        inner[0] = f"<header>{inner[0]}</header>"
    article = f"<{tag} {attrs}>{''.join(inner)}</{tag}>"
    if rng.random() < 0.3:
        article = f"<div class='{rng.choice(('wrapper', 'container', 'page', 'site', 'row'))}'>{article}</div>"
    before = [around(k) for k in ("notice", "header", "menu", "ad", "side", "form") if rng.random() < 0.5]
    after = [around(k) for k in ("share", "ad", "side", "comments", "notice", "form", "footer") if rng.random() < 0.5]
    rng.shuffle(before)
    page = blocks("<html><body>" + "".join(before) + article + "".join(after) + "</body></html>")
    got, keep = [], []
    for b in page:
        tags = re.findall("\\d+", b.text)
        text = " ".join(re.sub("\\d+", "", b.text).split())
        got.append(Block(text, b.features))
        keep.append(bool(tags) and labels[tags[0]])
    return got, keep


def train(pages: list[str], plan: Plan = Plan(), seed: int = 11) -> Model:
    """The field of the labelled pages; without one, of the layouts of stock phrases."""
    rng = random.Random(seed)
    labelled, bodies, others = [], [], []
    for p in pages:
        b = blocks(p)
        own = own_labels(b)
        if own is None:
            continue
        labelled.append((b, own))
        bodies.append([x.text for x, k in zip(b, own, strict=True) if k][: plan.most_blocks // 2])
        others += [x.text for x, k in zip(b, own, strict=True) if not k]
        others += [x.text for x, k in zip(b, own, strict=True) if k][1:3]  # foreign blocks can be prose as well
    bodies = [b for b in bodies if b] or [["A heading", "Some words of an article, and a few more of them.", "The end of it."]]
    others = others or ["Home", "About us", "Read more here", "All rights reserved", "Some words that stand beside an article."]
    for body in bodies:
        for _ in range(plan.layouts):
            labelled.append(layout(body[: rng.randint(1, len(body))], others, rng))
    while len(labelled) < 200:
        labelled.append(layout(rng.choice(bodies), others, rng))
    half = plan.most_blocks // 2
    cut = [(b, k) if len(b) <= plan.most_blocks else (b[:half] + b[-half:], k[:half] + k[-half:]) for b, k in labelled if b]
    return _ascend(cut, plan)


def _ascend(data: list[tuple[list[Block], list[bool]]], plan: Plan) -> Model:
    """Maximum likelihood with a ridge, by Adam steps on the exact gradient (forward-backward over all pages at once)."""
    names = {f: i for i, f in enumerate(sorted({f for b, _ in data for x in b for f in x.features}))}
    S, T = len(data), max(len(b) for b, _ in data)
    length = np.array([len(b) for b, _ in data])
    flat = [np.array([names[f] for f in x.features]) for b, _ in data for x in b]
    idx, cuts = np.concatenate(flat), np.concatenate([[0], np.cumsum([len(f) for f in flat])[:-1]])
    owner = np.repeat(np.arange(len(flat)), [len(f) for f in flat])
    row, col = np.repeat(np.arange(S), length), np.concatenate([np.arange(n) for n in length])
    y = np.zeros((S, T), int)
    y[row, col] = np.concatenate([np.array(k, int) for _, k in data])
    live = np.arange(T)[None, :] < length[:, None]
    pair = live[:, 1:]
    want_t = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & pair).sum() for b in (0, 1)] for a in (0, 1)], float)
    want_s = np.array([(y[:, 0] == 0).sum(), (y[:, 0] == 1).sum()], float)
    theta, m, v = np.zeros(len(names) + 6), np.zeros(len(names) + 6), np.zeros(len(names) + 6)
    for step in range(1, plan.steps + 1):
        w, tr, st = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
        emit = np.zeros((S, T, 2))
        emit[row, col, 1] = np.add.reduceat(w[idx], cuts)
        alpha, beta = np.zeros((S, T, 2)), np.zeros((S, T, 2))
        alpha[:, 0] = st + emit[:, 0]
        for t in range(1, T):
            nxt = np.logaddexp(alpha[:, t - 1, 0, None] + tr[0], alpha[:, t - 1, 1, None] + tr[1]) + emit[:, t]
            alpha[:, t] = np.where(live[:, t, None], nxt, alpha[:, t - 1])
        for t in range(T - 2, -1, -1):
            z = emit[:, t + 1] + beta[:, t + 1]
            nxt = np.logaddexp(tr[:, 0] + z[:, 0, None], tr[:, 1] + z[:, 1, None])
            beta[:, t] = np.where(live[:, t + 1, None], nxt, 0.0)
        log_z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p1 = np.exp(alpha[:, :, 1] + beta[:, :, 1] - log_z[:, None])
        g = np.zeros_like(theta)
        g[:-6] = np.bincount(idx, (y - p1)[row, col][owner], len(names))
        for a in (0, 1):
            for b in (0, 1):
                p = np.exp(alpha[:, :-1, a] + tr[a, b] + emit[:, 1:, b] + beta[:, 1:, b] - log_z[:, None])
                g[-6 + 2 * a + b] = want_t[a, b] - p[pair].sum()
        g[-2:] = want_s - np.array([(1 - p1[:, 0]).sum(), p1[:, 0].sum()])
        g = g / S - plan.ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + plan.rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    weights = {f: float(theta[i]) for f, i in names.items() if abs(theta[i]) > 1e-6}
    return Model(weights, theta[-6:-2].reshape(2, 2).tolist(), theta[-2:].tolist())


def fit(pages: DataFrame, plan: Plan = Plan(), id_col: str = "page_id", html_col: str = "html") -> Model:
    """The field of a bounded sample of the table's pages (by a hash of the id and the markup)."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html")).where("html is not null")
    n = rows.count()
    u = F.pmod(F.xxhash64(F.lit("crf"), "id", "html"), F.lit(1_000_000))
    some = rows.where(u < int(1_000_000 * min(1.0, plan.sample_rows / max(n, 1)))).select(u.alias("u"), "html").toPandas()
    return train(some.sort_values(["u", "html"])["html"].tolist(), plan)


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks`` per input row: the article's blocks, joined by one space.  Null and
    empty pages, and pages without an article block, have the empty text.  Null ids are carried along."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text, n = [], []
            for page in b["html"]:
                got = blocks(page)
                text.append(" ".join(x.text for x, keep in zip(got, shared.value.decode(got), strict=True) if keep))
                n.append(len(got))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text], "n_blocks": n})

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long, n_blocks long")
