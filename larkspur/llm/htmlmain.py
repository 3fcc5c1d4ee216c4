"""Main text of web pages by a linear-chain conditional random field.

A page is read into its leaf blocks: the runs of text between block-level tags.
A block's features are the tags it stands in, the words of their class, id and
role attributes by kind, and the look of its text.  A linear chain over the
blocks decides between main text and the rest; Viterbi decoding gives the best
labelling of the page.  The chain is trained on labelled pages made by
:func:`labelled_pages`, which places articles and the usual surroundings in
varied mark-up; the pages' words are random, so only structure is learned.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from larkspur.llm.runtime import Shield, ship

#: HTML's tag classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp template noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A start tag that ends an open element of these names, looked for up to the given ones.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
#: Kinds of class, id and role words.
KINDS = {
    "main": "main article content post entry story body text articlebody maincontent prose",
    "nav": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager tabs toc sitemap skip",
    "head": "header masthead topbar banner logo branding",
    "foot": "footer copyright contentinfo legal colophon imprint bottom",
    "side": "sidebar side aside complementary related recommend recommended recommendations widget rail popular trending teaser more",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion adsense adslot adbox dfp",
    "note": "notice notices cookie cookies consent gdpr alert alerts warning modal popup overlay paywall newsletter subscribe subscription signup message",
    "form": "form login search searchbox contact register signin",
    "comment": "comment comments commentlist reply replies respond discussion disqus thread reviews feedback",
    "share": "share sharing social follow like tags meta byline toolbar actions",
}
KIND_OF = {w: k for k, ws in KINDS.items() for w in ws.split()}
#: Tags that are features where they enclose a block.
TOLD = frozenset("article main section nav header footer aside form button select fieldset dialog menu ul ol dl li table td th p pre blockquote figure figcaption address h1 h2 h3 h4 h5 h6 div body details".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>",
    re.S,
)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?until)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
WORDS = re.compile(r"[a-z]+")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"[^"]*"?|'[^']*'?|[^\s"'>]+))?""")
#: Attributes that tell of an element; what stands in others' values does not.
TELLING = frozenset("class id role hidden aria-hidden style".split())
#: Attributes of this many characters are read like others but not remembered.
LONG = 2_000


class Block:
    __slots__ = ("features", "text", "linked")

    def __init__(self, features: tuple[str, ...], text: str, linked: int):
        self.features, self.text, self.linked = features, text, linked


@lru_cache(maxsize=20_000)
def _told(tag: str, attrs: str) -> tuple[str, ...]:
    """Features that an element gives to the blocks in it."""
    out = {f"in:{tag}"} if tag in TOLD else set()
    if attrs:
        attrs = " ".join(m[0] for m in ATTRIBUTE.finditer(attrs) if m[1].lower() in TELLING)
        for _, value in NAMED.findall(attrs):
            value = re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()
            out |= {f"kind:{KIND_OF[w]}" for w in WORDS.findall(value) if w in KIND_OF}
        if HIDDEN.search(attrs):
            out.add("hidden")
    return tuple(sorted(out))


def blocks(page: str) -> list[Block]:
    """Leaf blocks that have text, in page order, references decoded and white space made single."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = links = 0
    here: tuple[str, ...] = ()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(here, text, linked))
            parts.clear()
        linked = 0

    def pop(at: int) -> None:
        nonlocal here, links
        links -= sum(1 for t, _ in stack[at:] if t == "a")
        del stack[at:]
        here = stack[-1][1] if stack else ()

    def close(names: Iterable[str], within: Iterable[str]) -> None:
        for at in range(len(stack) - 1, -1, -1):
            if stack[at][0] in names:
                flush()
                pop(at)
                return
            if stack[at][0] in within:
                return

    def say(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked += len(text)

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            tail = page[at:]
            cut = re.search(r"<[/!?a-zA-Z][^>]*\Z", tail)  # a tag that the page's end cuts off
            say(tail[: cut.start()] if cut else tail)
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        block = tag not in INLINE
        if m["end"] or m["end2"]:
            if block:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
                if not block and stack[i][0] not in INLINE:
                    break
            continue
        if block:
            flush()
        elif tag == "br":
            parts.append("\n")
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if tag in CLOSES_P:
            close(("p",), ("button", "td", "th", "table", "object"))
        if tag in SIBLINGS:
            close(*SIBLINGS[tag])
        attrs = m["attrs"] or m["attrs2"] or ""
        if tag in VOID:
            continue
        told = _told(tag, attrs) if len(attrs) < LONG else _told.__wrapped__(tag, attrs)
        here = tuple(dict.fromkeys((*here, *told))) if told else here
        stack.append((tag, here))
        links += tag == "a"
    flush()
    return out


def _look(b: Block) -> list[str]:
    """Features of a block's text."""
    n = b.text.count(" ") + 1
    share = b.linked / len(b.text)
    size = "1" if n < 3 else "2" if n < 8 else "3" if n < 20 else "4"
    return [f"size:{size}", "linked:all" if share > 0.8 else "linked:some" if share > 0.3 else "linked:few", "stop" if b.text[-1] in ".!?…\"”" else "open", *(["mark"] if b.text[0] in "©|»›" else [])]


class Chain:
    """Weights of the field: of each feature for each label, of each pair of labels, of the first label."""

    def __init__(self, names: list[str]):
        self.at = {f: i for i, f in enumerate(names)}
        self.weights = np.zeros((len(names), 2))
        self.pairs = np.zeros((2, 2))
        self.cache: dict[tuple[str, ...], tuple[float, float]] = {}

    def _score(self, features: tuple[str, ...]) -> tuple[float, float]:
        found = self.cache.get(features)
        if found is None:
            rows = [self.at[f] for f in features if f in self.at]
            s = self.weights[rows].sum(axis=0) if rows else np.zeros(2)
            if len(self.cache) > 50_000:
                self.cache.clear()
            found = self.cache[features] = (float(s[0]), float(s[1]))
        return found

    def scores(self, page: list[Block]) -> list[tuple[float, float]]:
        out = []
        for b in page:
            a, c = self._score(("bias", *b.features)), self._score(tuple(_look(b)))
            out.append((a[0] + c[0], a[1] + c[1]))
        return out

    def decode(self, page: list[Block]) -> list[int]:
        """Labels of the best path (1: main text); a tie is for the rest."""
        if not page:
            return []
        (aa, ab), (ba, bb) = self.pairs.tolist()
        s = self.scores(page)
        x, y = s[0]
        back = []
        for p, q in s[1:]:
            to_a, to_b = x + aa >= y + ba, x + ab >= y + bb
            back.append((to_a, to_b))
            x, y = p + (x + aa if to_a else y + ba), q + (x + ab if to_b else y + bb)
        label = 0 if x >= y else 1
        labels = [label]
        for choice in reversed(back):
            label = 0 if choice[label] else 1
            labels.append(label)
        return labels[::-1]

    def fit(self, pages: list[tuple[list[Block], list[int]]], steps: int = 120, rate: float = 0.3, ridge: float = 1e-3) -> Chain:
        """Ascent on the penalised log likelihood; all pages' forward and backward sums run in step."""
        n, longest = len(pages), max(len(b) for b, _ in pages)
        f = np.zeros((n, longest, len(self.at)), np.float32)
        y = np.zeros((n, longest), np.int64)
        on = np.zeros((n, longest), bool)
        for i, (page, labels) in enumerate(pages):
            on[i, : len(page)], y[i, : len(page)] = True, labels
            for j, b in enumerate(page):
                f[i, j, [self.at[k] for k in ("bias", *b.features, *_look(b)) if k in self.at]] = 1
        flat = f.reshape(-1, len(self.at))
        own = np.eye(2)[y] * on[..., None]
        seen = np.einsum("ija,ijb->ab", own[:, :-1], own[:, 1:])
        gw, gp = np.full_like(self.weights, 1e-8), np.full((2, 2), 1e-8)
        for _ in range(steps):
            s = (flat @ self.weights).reshape(n, longest, 2)
            a, b = np.zeros_like(s), np.zeros_like(s)
            a[:, 0] = s[:, 0]
            for j in range(1, longest):
                a[:, j] = np.where(on[:, j, None], s[:, j] + np.logaddexp.reduce(a[:, j - 1, :, None] + self.pairs, axis=1), a[:, j - 1])
            for j in range(longest - 2, -1, -1):
                b[:, j] = np.where(on[:, j + 1, None], np.logaddexp.reduce(self.pairs + (s[:, j + 1] + b[:, j + 1])[:, None, :], axis=2), b[:, j])
            z = np.logaddexp.reduce(a[:, -1], axis=1)
            p = np.exp(a + b - z[:, None, None]) * on[..., None]
            two = np.exp(a[:, :-1, :, None] + self.pairs + (s[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * on[:, 1:, None, None]
            dw = flat.T @ (own - p).reshape(-1, 2) / n - ridge * self.weights
            dp = (seen - two.sum(axis=(0, 1))) / n - ridge * self.pairs
            gw += dw * dw
            gp += dp * dp
            self.weights += rate * dw / np.sqrt(gw)
            self.pairs += rate * dp / np.sqrt(gp)
        self.cache.clear()
        return self


def labelled_pages(n: int = 240, seed: int = 5) -> list[tuple[str, list[str]]]:
    """Pages and, of each, the texts of its main blocks: articles among varied surroundings, words at random."""
    r = random.Random(seed)
    say = lambda lo, hi: " ".join("".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(r.randint(lo, hi)))
    sentence = lambda lo, hi: say(lo, hi).capitalize() + "."

    def some(kind: str) -> str:
        return r.choice(KINDS[kind].split())

    def links(k: int, wrap: str) -> str:
        return f"<{wrap}>" + "".join(f'<li><a href="/x">{say(1, 3)}</a></li>' for _ in range(k)) + f"</{wrap}>"

    def part(kind: str) -> str:
        text = sentence(2, 14)
        if kind == "nav":
            inner = links(r.randint(3, 8), "ul")
            return r.choice([f"<nav>{inner}</nav>", f'<div class="{some("nav")}">{inner}</div>', f'<ul class="{some("nav")}">{inner[4:-5]}</ul>'])
        if kind == "head":
            return r.choice([f"<header><div>{say(1, 4)}</div>{links(3, 'ul')}</header>", f"<header><p>{text}</p></header>", f'<div id="{some("head")}">{text}</div>'])
        if kind == "foot":
            return r.choice([f"<footer>&copy; {say(1, 3)} &middot; {text}</footer>", f"<footer><p>{text}</p></footer>", f'<div class="{some("foot")}"><p>{text}</p></div>'])
        if kind == "side":
            body = r.choice([links(4, "ul"), f"<h3>{say(1, 3)}</h3><p>{text}</p>", f"<p>{sentence(20, 40)}</p>"])
            return r.choice([f"<aside>{body}</aside>", f'<div class="{some("side")}">{body}</div>', f'<section class="{some("side")}">{body}</section>'])
        if kind == "form":
            return r.choice([f"<form><label>{say(1, 2)}</label><input><button>{say(1, 1)}</button></form>", f'<form class="{some("form")}"><p>{text}</p><select><option>{say(1, 1)}<option>{say(1, 1)}</select></form>', f'<div class="{some("form")}"><p>{text}</p></div>'])
        if kind == "comment":
            body = "".join(r.choice([f"<p>{sentence(4, 30)}</p>", f"<article><p>{sentence(4, 30)}</p></article>", f"<li>{sentence(4, 30)}</li>"]) for _ in range(r.randint(1, 5)))
            return r.choice([f'<section class="{some("comment")}"><h2>{say(1, 2)}</h2>{body}</section>', f'<div id="{some("comment")}">{body}</div>', f'<ol class="{some("comment")}">{body}</ol>'])
        body = r.choice([text, f"<p>{text}</p>", f"<p>{sentence(15, 40)}</p>"])
        tag = r.choice(["div", "div", "section", "aside", "p"]) if "<p>" not in body else r.choice(["div", "section"])
        return f'<{tag} class="{some(kind)}">{body}</{tag}>'

    out = []
    for k in range(n):
        main: list[str] = []
        inner = ""
        title = say(2, 10).capitalize()
        if r.random() < 0.8:
            main.append(title)
            inner += r.choice([f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>" if k % 3 == 0 else f"<h1>{title}</h1>"])
        for _ in range(r.randint(1, 14)):
            text = r.choice([sentence(1, 4), sentence(5, 20), sentence(20, 90), sentence(20, 90)])
            form = r.random()
            if form < 0.1:
                text = say(1, 5)
                inner += f"<h2>{text}</h2>"
            elif form < 0.2:
                inner += f"<ul><li>{text}</li></ul>"
            elif form < 0.25:
                inner += f"<blockquote>{text}</blockquote>"
            elif form < 0.3:
                inner += f"<table><tr><td>{text}</td></tr></table>"
            elif form < 0.35:
                inner += f"<pre>{text}</pre>"
            elif form < 0.45:
                inner += f"<p><b>{text}<br>"
            elif form < 0.5:
                inner += f'<p><a href="/y">{text}</a></p>'
            else:
                inner += f"<p>{text}</p>"
            main.append(text)
            if r.random() < 0.12:
                inner += part(r.choice(["ad", "share", "side", "note", "form", "comment", "nav"]))
        body = r.choice([f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main><article>{inner}</article></main>", f"<main>{inner}</main>", f'<div class="{some("main")}">{inner}</div>', f'<div id="main"><div class="{some("main")}">{inner}</div></div>'])
        before = [part(x) for x in r.sample(["nav", "head", "ad", "note", "form", "side", "share"], r.randint(0, 5))]
        after = [part(x) for x in r.sample(["comment", "foot", "ad", "side", "share", "nav", "form", "note"], r.randint(0, 5))]
        shell = r.choice(["{}", "<div>{}</div>", '<div id="page">{}</div>'])
        page = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>" + shell.format("".join(before) + body + "".join(after)) + r.choice(["</body></html>", ""])
        out.append((page, main))
    return out


@lru_cache(maxsize=1)
def chain() -> Chain:
    """The field trained on the labelled pages."""
    pages = []
    names: dict[str, None] = {"bias": None}
    for page, main in labelled_pages():
        found = blocks(page)
        wanted = list(main)
        labels = []
        for b in found:
            labels.append(int(bool(wanted) and b.text == wanted[0]))
            if labels[-1]:
                wanted.pop(0)
        names |= dict.fromkeys(f for b in found for f in (*b.features, *_look(b)))
        pages.append((found, labels))
    return Chain([*names]).fit(pages)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    return " ".join(b.text for b, label in zip(found, chain().decode(found), strict=True) if label)


def extract(pages: DataFrame, page: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with each page's main text in column ``into`` (replaced if there).

    Null, empty and textless pages give an empty text; pages are read whole,
    whatever their size; repeated rows are alike; an empty table stays empty.
    Every worker trains the small chain once, always to the same weights.
    """
    ship(pages.sparkSession)

    @arrow_udf("string")
    def found(column: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in column], pa.string())

    own = Shield(pages)
    return own.restore(own.inner.withColumn(into, found(F.col(own(page)))), into)
