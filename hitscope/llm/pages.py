"""Main-text extraction from HTML by gradient-boosted trees over DOM nodes.

A page is parsed into a tree of elements and text runs. Each node gets features: its tag's kind, tokens of its
class, id and role, the same of its ancestors, depth, place among siblings, text and link density of its subtree,
its share of the page. Boosted trees give the probability that a node holds or belongs to the main text. Decoding
is hierarchical: the likeliest choice for the whole tree under the rule that below a dropped node all is dropped.

The trees are trained here, on labelled pages that `labelled_pages` writes from templates (PAGES of them); no
row of a table is a training row. Defined cases: null or empty html, and pages without main text, give an empty text;
markup that is never closed is closed where HTML would; repeated rows are extracted alike; extra columns are kept.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitscope.llm.common import beside

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: What stands between attributes, and an attribute with its value. Each match is decided by its next character alone.
BETWEEN, NAME, VALUE = re.compile(r"[\s/]*"), re.compile(r"=?[^\s/>=]*"), re.compile(r"\s*=\s*")
BARE = re.compile(r"[^\s>]*")


def tag_end(page: str, at: int) -> tuple[int, bool]:
    """The place after the tag whose attributes start at `at`, -1 if it is never closed; whether it ends with a slash.

    A quote counts only where a value starts, as in browsers, and each character is passed once.
    """
    n = len(page)
    while at < n:
        m = BETWEEN.match(page, at)
        at = m.end()
        if at < n and page[at] == ">":
            return at + 1, m[0].endswith("/")
        at = NAME.match(page, at).end()
        m = VALUE.match(page, at)
        if m:
            at = m.end()
            if at < n and page[at] in "\"'":
                end = page.find(page[at], at + 1)
                if end < 0:
                    return -1, False
                at = end + 1
            else:
                at = BARE.match(page, at).end()
    return -1, False


@dataclass
class Token:
    """A tag, or with an empty name what is no content (comments, declarations); end: the place after it."""

    start: int
    end: int
    name: str = ""
    closing: bool = False
    attributes: str = ""
    slash: bool = False


def next_token(page: str, at: int) -> Token | None:
    """The first tag, comment or declaration from `at` on. One that is never closed takes the rest of the page."""
    n = len(page)
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            return Token(start, n if end < 0 else end + 3)
        if page.startswith("<![CDATA[", start):
            end = page.find("]]>", start + 9)
            return Token(start, n if end < 0 else end + 3)
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            return Token(start, n if end < 0 else end + 1)
        m = TAG.match(page, start)
        if m:
            end, slash = tag_end(page, m.end())
            if end < 0:
                return Token(start, n)
            return Token(start, end, m[2].lower(), bool(m[1]), page[m.end() : end - 1], slash)
        at = start + 1
    return None


RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "template", "noscript", "iframe", "textarea", "title", "svg", "object")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag closes these open ones, unless one of the fences is in between.
CLOSES = {t: ("p",) for t in BLOCK - {"html", "body", "head", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}} | {
    "li": ("p", "li"), "dd": ("p", "dd", "dt"), "dt": ("p", "dd", "dt"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "tr": ("p", "td", "th", "tr"),
    "tbody": ("p", "td", "th", "tr", "thead", "tbody"), "tfoot": ("p", "td", "th", "tr", "tbody"), "option": ("option",), "body": ("p", "head"),
}
FENCES = frozenset("article aside blockquote body div dl fieldset footer form header html main nav ol section table td th tr ul button".split())

KINDS = [
    "nav", "header", "footer", "aside", "form button input select label fieldset option", "article", "main", "section", "div body html",
    "p blockquote pre", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dd dt", "a", "table tbody thead tfoot tr td th caption", "figure figcaption img picture",
    "head", "dialog details summary", "#text", "ins",
]
TOKENS = [
    "nav navigation menu menubar navbar breadcrumb breadcrumbs pagination pager toc tabs",
    "header masthead banner topbar logo sitename", "footer copyright colophon legal contentinfo bottom", "sidebar aside rail widget complementary side",
    "ad ads advert advertisement advertising sponsor sponsored promo promotion dfp banner adslot",
    "notice cookie cookies consent gdpr alert warning popup modal dialog overlay announcement",
    "comment comments reply replies respond disqus discussion feedback commentlist", "share social follow tweet sharing",
    "related recommended recommendations more popular trending latest", "form search login signup subscribe newsletter register",
    "hidden invisible offscreen", "article content post entry story body text main prose markdown", "byline author date meta tags tag",
]
_KIND_OF = {t: i for i, ts in enumerate(KINDS) for t in ts.split()}
_TOKEN_OF: dict[str, int] = {}
for _i, _ts in enumerate(TOKENS):
    for _t in _ts.split():
        _TOKEN_OF[_t] = _TOKEN_OF.get(_t, 0) | 1 << (len(KINDS) + _i)
N_BITS = len(KINDS) + len(TOKENS)
ATTRIBUTE = re.compile(r"(class|id|role|style|aria-label|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
HIDDEN = 1 << (len(KINDS) + 10)


@lru_cache(maxsize=20_000)
def flags(tag: str, attributes: str) -> int:
    """The kind of a tag and the tokens of its attributes as bits."""
    out = 1 << _KIND_OF[tag] if tag in _KIND_OF else 0
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "style":
            out |= HIDDEN if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) else 0
        elif name == "hidden" or name == "aria-hidden":
            out |= HIDDEN if value.lower() in ("", "true", "hidden") else 0
        else:
            for piece in PIECE.findall(value):
                out |= _TOKEN_OF.get(piece.lower(), 0)
    return out


class Tree:
    """Nodes in page order: parent, end of the subtree, own flags, those of the ancestors, text."""

    __slots__ = ("tag", "parent", "end", "own", "above", "depth", "place", "text", "link")

    def __init__(self, page: str):
        self.tag, self.parent, self.end, self.own, self.above = ["#root"], [-1], [0], [0], [0]
        self.depth, self.place, self.text, self.link = [0], [0], [""], [False]
        stack = [0]
        kids = [0]
        opened = Counter()
        in_link = 0
        at, n = 0, len(page)

        def add(tag: str, bits: int, text: str) -> int:
            up = stack[-1]
            self.tag.append(tag)
            self.parent.append(up)
            self.end.append(0)
            self.own.append(bits)
            self.above.append(self.above[up] | self.own[up])
            self.depth.append(len(stack))
            self.place.append(kids[-1])
            self.text.append(text)
            self.link.append(in_link > 0)
            kids[-1] += 1
            return len(self.tag) - 1

        def close(to: int) -> None:
            nonlocal in_link
            while len(stack) > to:
                node = stack.pop()
                kids.pop()
                opened[self.tag[node]] -= 1
                self.end[node] = len(self.tag)
                if self.tag[node] == "a":
                    in_link -= 1

        text_bits = 1 << _KIND_OF["#text"]
        while at < n:
            token = next_token(page, at)
            stop = token.start if token else n
            if stop > at:
                raw = page[at:stop]
                if not raw.isspace():
                    add("#text", text_bits, raw)
                elif self.tag[-1] == "#text" or len(stack) > 1:
                    add("#space", 0, " ")
            if not token:
                break
            at, name = token.end, token.name
            if not name:
                continue
            if token.closing:
                if not opened[name]:
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == name:
                        close(k)
                        break
                continue
            if name in RAW:
                # a slash closes such an element in embedded drawings only
                if not (token.slash and name == "svg"):
                    e = RAW[name].search(page, at)
                    at = e.end() if e else n
                continue
            if any(opened[t] for t in CLOSES.get(name, ())):
                for k in range(len(stack) - 1, 0, -1):
                    t = self.tag[stack[k]]
                    if t in CLOSES[name]:
                        close(k)
                    elif t in FENCES:
                        break
            if name in VOID:
                add("#space" if name in ("br", "wbr") else name, 0, " " if name == "br" else "")
                continue
            node = add(name, flags(name, token.attributes), "")
            if token.slash and name not in BLOCK and name != "a":
                self.end[node] = len(self.tag)
                continue
            stack.append(node)
            kids.append(0)
            opened[name] += 1
            in_link += name == "a"
        close(0)
        self.end = [e or i + 1 for i, e in enumerate(self.end)]


def features(trees: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each node of the trees, and the first row of each tree (and the end)."""
    sizes = np.array([len(t.tag) for t in trees])
    first = np.concatenate(([0], np.cumsum(sizes)))
    base = np.repeat(first[:-1], sizes)
    total = int(first[-1])
    col = lambda f, kind=np.int64: np.fromiter((x for t in trees for x in f(t)), kind, total)
    parent = np.maximum(col(lambda t: t.parent), 0) + base
    end = col(lambda t: t.end) + base
    own, above = col(lambda t: t.own), col(lambda t: t.above)
    length = col(lambda t: map(len, t.text))
    link = col(lambda t: t.link, bool)
    is_text = own >> _KIND_OF["#text"] & 1
    element = (own > 0) & (is_text == 0)
    rows = np.arange(total)

    def below(x: np.ndarray) -> np.ndarray:
        s = np.concatenate(([0], np.cumsum(x)))
        return s[end] - s[rows]

    text, linked, tags = below(length * is_text), below(length * is_text * link), below(element)
    bit = lambda x, names: ((x >> np.array([_KIND_OF[k] for k in names.split()])[:, None]) & 1).any(0)
    paragraphs = below(bit(own, "p"))
    heads = below(bit(own, "h1"))
    long_text = below((length > 80) & (is_text > 0) & ~link)
    inner = below(bit(own, "article") | bit(own, "main"))
    whole = np.repeat(text[first[:-1]], sizes)
    n_kids = np.bincount(parent[rows != base], minlength=total)
    place = col(lambda t: t.place)
    siblings = n_kids[parent]
    numbers = np.stack([
        col(lambda t: t.depth), place, siblings, place / np.maximum(siblings, 1), np.log1p(text), np.log1p(length), linked / np.maximum(text, 1),
        text / np.maximum(whole, 1), np.log1p(paragraphs), text / (tags + 1), long_text, heads, inner, np.log1p(text[parent]), linked[parent] / np.maximum(text[parent], 1),
        paragraphs[parent], rows[:] * 0 + (rows - base) / np.repeat(np.maximum(sizes, 1), sizes),
    ], 1)
    places = np.arange(N_BITS)
    return np.concatenate([numbers, (own[:, None] >> places) & 1, (above[:, None] >> places) & 1], 1).astype(np.float32), first


TREES, DEPTH, RATE, BINS, PENALTY = 50, 4, 0.25, 24, 1.0


@dataclass
class Boosted:
    """Trees of fixed depth: feature and threshold of each inner node, value of each leaf."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start, np.float32)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Gradient boosting with logistic loss; splits by histograms of gradients and curvatures."""
    n, k = x.shape
    numeric = np.flatnonzero(((x != 0) & (x != 1)).any(0))
    binary = np.setdiff1d(np.arange(k), numeric)
    flag = np.ascontiguousarray(x[:, binary])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1], method="lower")) for j in range(k)]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    prior = float(np.log(y.mean() / (1 - y.mean())))
    score = np.full(n, prior)
    inner = 2**DEPTH - 1
    feature, cut, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf, np.float32), np.zeros((TREES, 2**DEPTH), np.float32)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(DEPTH):
            low, wide = 2**level - 1, 2**level
            slot = at - low
            best = np.full(wide, 1e-6)
            gt, ht = np.bincount(slot, g, wide), np.bincount(slot, h, wide)
            g0 = gt[:, None] - np.stack([flag[slot == w].T @ g[slot == w] for w in range(wide)])
            h0 = ht[:, None] - np.stack([flag[slot == w].T @ h[slot == w] for w in range(wide)])
            gain = g0**2 / (h0 + PENALTY) + (gt[:, None] - g0) ** 2 / (ht[:, None] - h0 + PENALTY) - (gt**2 / (ht + PENALTY))[:, None]
            top = gain.argmax(1)
            found = gain[np.arange(wide), top]
            for w in np.flatnonzero(found > best):
                best[w], feature[t, low + w], cut[t, low + w] = found[w], binary[top[w]], 0.5
            for j in numeric:
                if not len(cuts[j]):
                    continue
                m = len(cuts[j]) + 1
                key = slot * m + code[:, j]
                gl = np.bincount(key, g, wide * m).reshape(wide, m).cumsum(1)[:, :-1]
                hl = np.bincount(key, h, wide * m).reshape(wide, m).cumsum(1)[:, :-1]
                gain = gl**2 / (hl + PENALTY) + (gt[:, None] - gl) ** 2 / (ht[:, None] - hl + PENALTY) - (gt**2 / (ht + PENALTY))[:, None]
                top = gain.argmax(1)
                found = gain[np.arange(wide), top]
                for w in np.flatnonzero(found > best):
                    best[w], feature[t, low + w], cut[t, low + w] = found[w], j, cuts[j][top[w]]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > cut[t, at])
        slot = at - inner
        leaf[t] = RATE * np.bincount(slot, g, 2**DEPTH) / (np.bincount(slot, h, 2**DEPTH) + PENALTY)
        score += leaf[t][slot]
    return Boosted(feature, cut, leaf, prior)


PAGES, MARK = 400, "\ue000"


def labelled_pages(n: int = PAGES, seed: int = 11) -> list[str]:
    """Pages in which each word of the main text ends with MARK."""
    rnd = random.Random(seed)
    pick = rnd.choice

    def sentence(lo: int, hi: int, good: bool) -> str:
        words = ["".join(pick("bcdfglmnprstv") + pick("aeiou") for _ in range(rnd.randint(1, 4))) + (MARK if good else "") for _ in range(rnd.randint(lo, hi))]
        if rnd.random() < 0.15:
            i = rnd.randrange(len(words))
            words[i] = f"<{pick(['b', 'i', 'em', 'strong', 'span'])}>{words[i]}</{pick(['b', 'i', 'em', 'strong', 'span'])}>" if rnd.random() < 0.5 else f'<a href="/x">{words[i]}</a>'
        return " ".join(words) + "."

    def attr(tokens: str) -> str:
        t = pick(tokens.split())
        t = pick([t, t, f"{pick(['page', 'site', 'block', 'box', 'x', 'js'])}-{t}", f"{t}-{pick(['wrap', 'inner', 'box', 'area', '1'])}", f"{t}_{pick(['left', 'top', 'main2'])}"])
        return f' {pick(["class", "class", "id"])}="{t}"'

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{sentence(1, 4, False)}</a></li>' for i in range(k)) + "</ul>"

    def prose(k: int, good: bool) -> str:
        return "".join(f"<p>{sentence(3, 60, good)}{'' if rnd.random() < 0.1 else '</p>'}" for _ in range(k))

    def noise(kind: str) -> str:
        if kind == "nav":
            return pick([f"<nav{attr('menu x y')}>{links(rnd.randint(2, 9))}</nav>", f"<div{attr(TOKENS[0])}>{links(rnd.randint(2, 9))}</div>", f'<div role="navigation">{links(4)}</div>', f"<ul{attr('menu nav')}><li><a href='/'>{sentence(1, 2, False)}</a></ul>"])
        if kind == "header":
            return pick([f"<header{attr('top x banner')}>{pick(['', '<h1>' + sentence(1, 4, False) + '</h1>', '<p>' + sentence(2, 9, False) + '</p>'])}{pick(['', noise('nav')])}{sentence(1, 5, False)}</header>", f"<div{attr(TOKENS[1])}><a href='/'>{sentence(1, 3, False)}</a><p>{sentence(2, 12, False)}</p></div>"])
        if kind == "footer":
            return pick([f"<footer{attr('x foot bottom')}>&copy; {sentence(2, 20, False)}</footer>", f"<footer><p>{sentence(2, 30, False)}</p>{links(4)}</footer>", f"<div{attr(TOKENS[2])}><p>&copy; {sentence(2, 20, False)}</p></div>"])
        if kind == "side":
            inside = pick([links(rnd.randint(2, 8)), prose(rnd.randint(1, 3), False), f"<h3>{sentence(1, 4, False)}</h3>{links(3)}"])
            return pick([f"<aside{attr('x right rail')}>{inside}</aside>", f"<div{attr(TOKENS[3])}>{inside}</div>", f"<section{attr(TOKENS[8])}><h2>{sentence(1, 3, False)}</h2>{inside}</section>"])
        if kind == "ad":
            return pick([f"<div{attr(TOKENS[4])}>{sentence(3, 30, False)}</div>", f"<div{attr(TOKENS[4])}><p>{sentence(3, 30, False)}</p></div>", f"<ins>{sentence(2, 9, False)}</ins>", f"<aside{attr(TOKENS[4])}>{prose(1, False)}</aside>"])
        if kind == "notice":
            return pick([f"<div{attr(TOKENS[5])}>{pick([sentence(4, 40, False), prose(2, False)])}<button>{sentence(1, 2, False)}</button></div>", f'<div role="{pick(["dialog", "alert"])}"><p>{sentence(4, 30, False)}</p></div>', f"<section{attr(TOKENS[5])}>{prose(1, False)}</section>"])
        if kind == "comments":
            each = pick(["<div class='comment'>{}</div>", "<li>{}</li>", "<article class='comment'>{}</article>", "<p>{}</p>", "<div>{}</div>"])
            body = "".join(each.format(pick([sentence(3, 60, False), prose(rnd.randint(1, 3), False)])) for _ in range(rnd.randint(1, 6)))
            return pick([f"<section{attr(TOKENS[6])}><h2>{sentence(1, 3, False)}</h2>{body}</section>", f"<div{attr(TOKENS[6])}>{body}</div>", f"<ol{attr('comments commentlist replies')}>{body}</ol>"])
        if kind == "form":
            return pick([f"<form{attr('x y search')}><label>{sentence(1, 5, False)}</label><input name=q><button>{sentence(1, 2, False)}</button></form>", f"<div{attr(TOKENS[9])}><p>{sentence(3, 20, False)}</p><form><input></form></div>"])
        if kind == "hidden":
            return pick([f"<div hidden>{prose(1, False)}</div>", f"<div style='display:none'>{prose(1, False)}</div>", f"<p{attr('hidden')}>{sentence(3, 20, False)}</p>"])
        return pick([f"<div{attr(TOKENS[7])}>{links(3)}</div>", f"<div{attr(TOKENS[7])}><a href=x>{sentence(1, 2, False)}</a> <a href=y>{sentence(1, 2, False)}</a></div>"])

    kinds = ["nav", "header", "footer", "side", "ad", "notice", "comments", "form", "hidden", "share"]

    def article() -> str:
        out = [f"<{h}>{sentence(2, 12, True)}</{h}>"] if (h := pick(["h1", "h1", "h2", ""])) else []
        for _ in range(rnd.choice([1, 1, 2, 3, 6, 12])):
            r = rnd.random()
            if r < 0.62:
                out.append(prose(rnd.randint(1, 4), True))
            elif r < 0.68:
                out.append(f"<h2>{sentence(1, 8, True)}</h2>" + prose(1, True))
            elif r < 0.74:
                out.append(f"<ul>{''.join(f'<li>{sentence(1, 20, True)}</li>' for _ in range(rnd.randint(2, 6)))}</ul>")
            elif r < 0.78:
                out.append(f"<blockquote>{pick([prose(1, True), sentence(4, 30, True)])}</blockquote>")
            elif r < 0.82:
                out.append("<table>" + "".join(f"<tr><td>{sentence(1, 5, True)}</td><td>{sentence(1, 5, True)}</td></tr>" for _ in range(3)) + "</table>")
            elif r < 0.86:
                out.append(f"<pre>{sentence(3, 30, True)}</pre>")
            elif r < 0.89:
                out.append(f"<figure><img src=x><figcaption>{sentence(2, 12, True)}</figcaption></figure>")
            elif r < 0.92:
                out.append(f"<section>{prose(2, True)}</section>" if rnd.random() < 0.5 else f"<div>{prose(2, True)}</div>")
            elif r < 0.94:
                out.append(f"<p><b>{sentence(3, 30, True)}<br><p>")
            else:
                out.append(noise(pick(["ad", "share", "side", "notice", "form", "ad", "comments"])))
        body = "".join(out)
        form = rnd.random()
        if form < 0.45:
            return f"<article{pick(['', '', attr(TOKENS[11])])}>{body}</article>"
        if form < 0.6:
            return f"<main{pick(['', attr(TOKENS[11])])}>{pick([body, f'<article>{body}</article>'])}</main>"
        if form < 0.95:
            return f"<div{attr(TOKENS[11])}>{body}</div>"
        return f"<div>{body}</div>"

    pages = []
    for _ in range(n):
        before = "".join(noise(k) for k in rnd.sample(["nav", "header", "ad", "notice", "form", "hidden", "side"], rnd.randint(0, 4)))
        after = "".join(noise(k) for k in rnd.sample(["side", "comments", "footer", "ad", "share", "notice", "form"], rnd.randint(0, 4)))
        inside = before + (article() if rnd.random() < 0.95 else "") + after
        for _ in range(rnd.randint(0, 2)):
            inside = f"<div{pick(['', attr('wrapper container page layout row grid')])}>{inside}</div>"
        top, tail = (noise(k) if rnd.random() < 0.6 else "" for k in ("nav", "footer"))
        pages.append(f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{sentence(2, 8, False)}</title></head><body>{top}{inside}{tail}</body></html>")
    return pages


@lru_cache(maxsize=1)
def trained() -> Boosted:
    trees = [Tree(p) for p in labelled_pages()]
    x, first = features(trees)
    has = np.array([MARK in s for t in trees for s in t.text], np.int64)
    end = np.concatenate([np.array(t.end) + f for t, f in zip(trees, first[:-1], strict=True)])
    s = np.concatenate(([0], np.cumsum(has)))
    y = (s[end] - s[np.arange(len(end))] > 0).astype(float)
    use = x[:, len(x[0]) - 2 * N_BITS :].any(1)
    return boost(x[use], y[use])


def decode(tree: Tree, odds: np.ndarray) -> np.ndarray:
    """Which nodes to keep: the likeliest labelling in which nothing is kept below a dropped node."""
    n = len(tree.tag)
    keep = np.minimum(0, odds) - np.log1p(np.exp(-np.abs(odds)))  # log p
    drop = keep - odds  # log (1 - p)
    space = [t == "#space" for t in tree.tag]
    k, d = keep.tolist(), drop.tolist()
    for i in range(n):
        if space[i]:
            k[i] = d[i] = 0.0
    k[0], d[0] = 0.0, 0.0
    parent = tree.parent
    for i in range(n - 1, 0, -1):
        p = parent[i]
        k[p] += k[i] if k[i] > d[i] else d[i]
        d[p] += d[i]
    kept = [False] * n
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[parent[i]] and (k[i] > d[i] or space[i])
    return np.array(kept)


def text_of(tree: Tree, kept: np.ndarray) -> str:
    """The text of kept nodes: one line for each block, white space made single, character references decoded."""
    lines: list[str] = []
    held: list[str] = []
    tag, end, parent = tree.tag, tree.end, tree.parent
    closing: list[int] = []

    def flush() -> None:
        if held:
            line = " ".join("".join(held).split())
            if line:
                lines.append(line)
            held.clear()

    for i in range(1, len(tag)):
        while closing and closing[-1] <= i:
            closing.pop()
            flush()
        if tag[i] in BLOCK:
            flush()
            closing.append(end[i])
        elif kept[i] and tree.text[i]:
            held.append(html.unescape(tree.text[i]))
    flush()
    return "\n".join(lines)


def extract(pages: list[str | None], model: Boosted) -> list[str]:
    out: list[str] = []
    for i in range(0, len(pages), 100):
        trees = [Tree(p or "") for p in pages[i : i + 100]]
        x, first = features(trees)
        odds = model.log_odds(x)
        for j, t in enumerate(trees):
            out.append(text_of(t, decode(t, odds[first[j] : first[j + 1]])))
    return out


def extract_text(df: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """Adds the main text of each page."""
    sent = df.sparkSession.sparkContext.broadcast(trained())
    return beside(df, [page], [(out, T.StringType(), pa.string())], lambda pages: (extract(pages, sent.value),), dropped=(page,))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages).withColumn("n_chars", F.char_length("text").cast("long"))
