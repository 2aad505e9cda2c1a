r"""Main text of pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, that is the text between two block-level tags, each with the tags, classes, ids and roles of
its ancestors. Blocks are labelled text or not by a chain of two labels: the sum of a block's feature weights, and a
weight for each pair of neighbouring labels; the best sequence is found by Viterbi. The weights are the maximum of
the penalised likelihood on labelled pages, which `labelled_pages` makes in many layouts, with invented words: no word
of a language is learnt, only tags, naming habits of web pages and the shape of the text.

Training sees a fixed number of pages and takes a few seconds on the driver, once a session.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

PAGES, SEED, STEPS, PENALTY = 1000, 5, 200, 2e-6

#: Elements whose content is never text of the page: code, drawings, what isn't shown, and notices in place of media. What `noscript` and `object` hold is
#: text as any other.
RAW = ("script", "style", "template", "svg", "iframe", "canvas", "audio", "video")
#: Their ends, which those of other names and with attributes are not taken for.
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.I) for t in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr object q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr br input".split()) | frozenset(
    "math maction annotation annotation-xml menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
SAME = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr"}, "tbody": {"thead", "tr"}, "body": {"head"}}
#: What such an end stays within.
WALLS = frozenset("table td th ul ol dl html body button caption".split())
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][\w:-]*+)((?:[^<>"']|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][\w:-]*+)([^>]*+)>|[^<]++|<""",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([\w:-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


class Block(NamedTuple):
    text: str
    path: tuple[str, ...]  # features of the ancestors
    tag: str
    linked: int  # characters in links


def _marks(tag: str, attributes: str) -> tuple[str, ...]:
    out = [f"in:{tag}"]
    if attributes and not attributes.isspace():
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id", "role", "itemprop"):
                out += [f"name:{p.lower()}" for p in PART.findall(value)]
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                out.append("hidden")
    return tuple(out)


def _tokens(html: str) -> Iterator[re.Match]:
    """The matches of TOKEN but for raw elements. Without an end tag, scripts and styles last to the page's end, of others only the start tag goes."""
    at: int | None = 0
    unclosed = set()
    while at is not None:
        start, at = at, None
        for m in TOKEN.finditer(html, start):
            tag = (m[2] or m[5] or "").lower()
            if tag not in RAW_END or m[1] or m[4]:
                yield m
            elif tag not in unclosed and not (tag == "svg" and (m[3] or m[6] or "").endswith("/")):
                if end := RAW_END[tag].search(html, m.end()):
                    at = end.end()
                    break
                if tag in ("script", "style"):
                    break
                unclosed.add(tag)


def blocks(html: str | None) -> list[Block]:
    """The leaf blocks of a page in order. Character references are decoded, white space is one space, blocks without text are none."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    linked, link = 0, False

    def flush() -> None:
        nonlocal linked, link
        if held:
            if text := " ".join("".join(held).split()):
                out.append(Block(text, stack[-1][1] if stack else (), stack[-1][0] if stack else "", linked))
            held.clear()
        linked, link = 0, False

    def close(tags, walls=WALLS) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                del stack[k:]
                return
            if stack[k][0] in walls:
                return

    for m in _tokens(html or ""):
        tag = m[2] or m[5]
        if tag is None:
            s = m[0]
            if not s.startswith(("<!", "<?")):
                s = unescape(s) if "&" in s else s
                held.append(s)
                if link:
                    linked += len(s)
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                held.append(" ")
            elif tag == "a":
                link = not (m[1] or m[4])
            continue
        flush()
        if m[1] or m[4]:
            close({tag}, ())
            continue
        if tag in ENDS_P:
            close({"p"})
        if tag in SAME:
            if tag in ("td", "th"):
                close(SAME[tag], {"tr", "table"})
            else:
                close(SAME[tag], {"table"} if tag in ("tr", "tbody", "thead") else {"ul", "ol", "dl", "table"})
        if tag not in VOID:
            before = stack[-1][1] if stack else ()
            stack.append((tag, tuple(dict.fromkeys((*before, *_marks(tag, m[3] or m[6] or ""))))))
    flush()
    return out


SAYS = re.compile(r"cookie|consent|privacy|copyright|©|\(c\)|all rights|subscribe|newsletter|sign (?:in|up)|log ?in|password|advert|sponsored|comments?\b|repl(?:y|ies)\b|share\b|read more|related|menu|search|e-?mail|accept|terms", re.I)
ENDS = re.compile(r"[.!?…:;\"'”»)]$")


def shape(b: Block) -> list[str]:
    """Features of a block's text."""
    t = b.text
    n, words = len(t), t.count(" ") + 1
    out = [f"own:{b.tag}", f"words:{min(words.bit_length(), 8)}", f"links:{min(4 * b.linked // n, 4)}", "ends" if ENDS.search(t) else "open", f"stops:{min(t.count('. ') + t.count(', '), 4)}"]
    if words <= 40:
        out += {f"says:{x.lower()}" for x in SAYS.findall(t)}
    if words > 8 and b.linked * 5 < n:
        out.append("prose")
    return out


def features(page: list[Block]) -> list[list[str]]:
    last = len(page) - 1
    return [[*b.path, *shape(b), "first" if i == 0 else "last" if i == last else "inner"] for i, b in enumerate(page)]


# --- labelled pages


def labelled_pages(count: int = PAGES, seed: int = SEED) -> Iterator[tuple[str, list[str]]]:
    """Invented pages, each with the blocks of its main text."""
    r = random.Random(seed)
    syllables = [c + v + e for c in "b c d f g l m n p r s t v".split() for v in "a e i o u".split() for e in ("", "n", "r", "s")]
    word = lambda: "".join(r.choices(syllables, k=r.choice((1, 2, 2, 3))))

    def some(lo: int, hi: int, stop: str = "") -> str:
        w = [word() + ("," if r.random() < 0.08 else "") for _ in range(r.randint(lo, hi))]
        return " ".join(w).rstrip(",").capitalize() + stop

    prose = lambda lo=1, hi=6: " ".join(some(3, 22, r.choice("....!?")) for _ in range(r.randint(lo, hi)))
    link = lambda s: f'<a href="/{word()}">{s}</a>'

    def named(tag: str, *names: str) -> tuple[str, str]:
        """A start and an end tag, with a telling name in most cases."""
        how = r.random()
        if how < 0.15 and tag not in ("div", "section", "p", "span", "ul", "ol"):
            return f"<{tag}>", f"</{tag}>"
        name = r.choice(names)
        name = r.choice((name, f"{word()}-{name}", f"{name}-{r.choice(('wrap', 'box', 'inner', 'area', word()))}", f"{name}_{word()}"))
        return f'<{tag} {r.choice(("class", "class", "id"))}="{name}">', f"</{tag}>"

    def menu() -> str:
        a, b = named(r.choice(("nav", "nav", "div", "ul")), "nav", "menu", "navigation", "navbar", "breadcrumbs", "breadcrumb", "pagination", "toc")
        items = [link(some(1, 3)) for _ in range(r.randint(2, 9))]
        if a.startswith("<ul"):
            return a + "".join(f"<li>{x}</li>" for x in items) + b
        body = "<ul>" + "".join(f"<li>{x}" + r.choice(("</li>", "")) for x in items) + "</ul>" if r.random() < 0.75 else r.choice((" ", " | ", " › ")).join(items)
        return a + body + b

    def advert() -> str:
        a, b = named(r.choice(("div", "div", "aside", "section", "p")), "ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "adsbox")
        return a + r.choice((prose(1, 4), f"<p>{prose(1, 3)}</p>", link(some(3, 9)), f"<p>{r.choice(('Advertisement', 'Sponsored'))}</p><p>{prose(1, 2)}</p>")) + b

    def notice() -> str:
        if r.random() < 0.1:
            return f"<noscript>{r.choice((prose(1, 2), f'<p>{prose(1, 2)}</p>', some(2, 6)))}</noscript>"
        a, b = named(r.choice(("div", "div", "section", "p", "aside")), "notice", "cookie", "cookie-banner", "cookie-notice", "consent", "alert", "gdpr", "paywall", "message", "warning", "popup", "modal", "disclaimer")
        if r.random() < 0.3:
            a = a.replace(">", f' role="{r.choice(("alert", "dialog", "status"))}">', 1)
        text = r.choice((prose(1, 3), "We use cookies. " + prose(1, 2), some(2, 6)))
        return a + (text if a.startswith("<p") else r.choice((text, f"<p>{text}</p>", f"<p>{text}</p><button>{r.choice(('OK', 'Accept', some(1, 2)))}</button>"))) + b

    def side() -> str:
        a, b = named(r.choice(("aside", "aside", "div", "section")), "sidebar", "side", "widget", "related", "rail", "complementary", "secondary", "aside", "recommended", "trending", "tags")
        parts = [f"<h{(k := r.choice((2, 3, 4)))}>{r.choice(('Related', some(1, 3)))}</h{k}>" + r.choice(("<ul>" + "".join(f"<li>{link(some(2, 8))}</li>" for _ in range(r.randint(2, 6))) + "</ul>", f"<p>{prose(1, 3)}</p>", f"<p>{prose(1, 2)}</p><p>{link(some(2, 4))}</p>")) for _ in range(r.randint(1, 3))]
        return a + "".join(parts) + b

    def form() -> str:
        a, b = named("form", "search", "newsletter", "signup", "login", "contact", "subscribe")
        inner = f"<label>{some(1, 3)}</label><input type=text>" + r.choice(("", f"<p>{prose(1, 2)}</p>", f"<select><option>{word()}</option><option>{word()}</option></select>")) + f"<button>{r.choice(('Search', 'Subscribe', some(1, 2)))}</button>"
        out = a + inner + b
        if r.random() < 0.4:
            c, d = named("div", "newsletter", "subscribe", "signup", "search")
            out = c + r.choice(("", f"<h3>{some(2, 4)}</h3>", f"<p>{prose(1, 2)}</p>")) + out + d
        return out

    def comments() -> str:
        a, b = named(r.choice(("section", "section", "div", "ol", "aside")), "comments", "comments", "comment-list", "responses", "discussion", "replies", "disqus", "reader-comments")
        inner = r.choice(("", f"<h{(k := r.choice((2, 3)))}>{r.choice(('Comments', some(1, 2)))}</h{k}>"))
        for _ in range(r.randint(1, 5)):
            c, d = named(r.choice(("div", "div", "article", "li", "p")), "comment", "comment", "reply", "response", "comment-body")
            inner += c + (prose(1, 4) if c.startswith("<p") else r.choice((f"<p>{prose(1, 4)}</p>", f"<b>{some(1, 2)}</b> <p>{prose(1, 3)}</p>", prose(1, 3)))) + d
        return a + inner + (form() if r.random() < 0.25 else "") + b

    def head() -> str:
        a, b = named(r.choice(("header", "header", "div")), "header", "masthead", "site-header", "topbar", "banner", "branding", "page-header")
        return a + r.choice(("", f"<div>{link(some(1, 3))}</div>", f"<p>{some(2, 7)}</p>", f"<h1>{some(1, 3)}</h1>", f"<p>{prose(1, 2)}</p>")) + (menu() if r.random() < 0.5 else "") + b

    def foot() -> str:
        a, b = named(r.choice(("footer", "footer", "footer", "div")), "footer", "site-footer", "contentinfo", "bottom", "copyright", "colophon", "legal")
        return a + r.choice((f"&copy; {word()}.example &middot; {some(3, 8, '.')}", f"<p>{prose(1, 3)}</p>", f"<p>&copy; {some(2, 5)}</p>" + "".join(f"<p>{link(some(1, 3))}</p>" for _ in range(r.randint(0, 4))), prose(1, 3))) + b

    def share() -> str:
        a, b = named(r.choice(("div", "ul", "p")), "share", "social", "sharing", "byline", "meta", "author", "post-meta", "dateline", "tags")
        text = r.choice((some(2, 6), " ".join(link(some(1, 2)) for _ in range(4)), f"{some(1, 3)}, {r.randint(1, 28)}.{r.randint(1, 12)}.20{r.randint(10, 25)}"))
        return a + (f"<li>{text}</li>" if a.startswith("<ul") else text) + b

    def text_block() -> tuple[str, list[str]]:
        how = r.random()
        if how < 0.64:
            s = prose(1, 8) if r.random() < 0.8 else some(1, 6, r.choice(("", ".")))
            plain, marked = s, s
            if r.random() < 0.3:
                w = s.split(" ")
                k = r.randrange(len(w))
                w[k] = r.choice(("<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<code>{}</code>", "<span>{}</span>")).format(w[k])
                marked = " ".join(w)
            whole = f"<p>{marked}" + r.choice(("</p>", "</p>", "</p>", ""))
            return r.choice(("<noscript>{}</noscript>", "<object data=x>{}</object>")).format(whole) if r.random() < 0.02 else whole, [plain]
        if how < 0.72:
            k, s = r.choice((2, 2, 3, 4)), some(1, 8)
            return f"<h{k}>{s}</h{k}>", [s]
        if how < 0.8:
            own = [some(2, 14, r.choice(("", "."))) for _ in range(r.randint(2, 6))]
            t = r.choice(("ul", "ol"))
            return f"<{t}>" + "".join(f"<li>{x}" + r.choice(("</li>", "</li>", "")) for x in own) + f"</{t}>", own
        if how < 0.86:
            s = prose(1, 3)
            return r.choice((f"<blockquote>{s}</blockquote>", f"<blockquote><p>{s}</p></blockquote>", f"<pre>{s}</pre>", f"<div>{s}</div>", f"<figure><img src=x><figcaption>{s}</figcaption></figure>")), [s]
        if how < 0.92:
            a, b = some(1, 6), prose(1, 4)
            return f"<p><b>{a}<br><p>{b}</p>", [a, b]
        own = [some(1, 5) for _ in range(2 * r.randint(2, 4))]
        return "<table>" + "".join(f"<tr><td>{own[i]}</td><td>{own[i + 1]}</td></tr>" for i in range(0, len(own), 2)) + "</table>", own

    for _ in range(count):
        title = some(2, 12)
        a, b = r.choice(
            (
                ("<article>", "</article>"),
                ("<article>", "</article>"),
                ("<main>", "</main>"),
                ("<main><article>", "</article></main>"),
                named("div", "content", "article", "post", "entry", "story", "main", "article-body", "post-content", "entry-content", "body", "text"),
                named("section", "content", "article", "post", "story", "main"),
                named("article", "post", "entry", "story"),
                ("<div role=main>", "</div>"),
                ("<div>", "</div>"),
            )
        )
        texts = [title] if r.random() < 0.9 else []
        inside = [f"<h1>{title}</h1>"] if texts else []
        if inside and r.random() < 0.12:
            inside = ["<header>", *inside, share() if r.random() < 0.6 else "", "</header>"]
        for _ in range(r.choice((0, 1, 2, 3, 5, 8, 13, 20))):
            piece, own = text_block()
            inside.append(piece)
            texts += own
            if r.random() < 0.12:
                inside.append(r.choice((advert, advert, side, notice, form, share))())
        if r.random() < 0.15:
            inside.append(r.choice((share, comments, advert, foot))())
        before = [f() for f in r.sample((head, menu, menu, advert, notice, side, form, share), r.randint(0, 4))]
        after = [f() for f in r.sample((foot, foot, comments, side, advert, notice, form, menu), r.randint(0, 5))]
        whole = "".join(before) + a + "".join(inside) + b + "".join(after)
        if r.random() < 0.3:
            c, d = named("div", "wrapper", "page", "container", "layout", "site", "row", "col")
            whole = c + whole + d
        lead = f'<!DOCTYPE html><html lang="{r.choice(("en", "de", "fr", "es"))}"><head><meta charset="utf-8"><title>{title}</title><script>var t="</p>";</script></head><body>' if r.random() < 0.9 else ""
        yield lead + whole + r.choice(("</body></html>", "")), texts


# --- the model


class Model(NamedTuple):
    weights: dict[str, float]
    step: tuple[float, float, float, float]  # from label i to label j at 2 * i + j


def labels(page: list[Block], texts: list[str]) -> list[int]:
    """1 for the blocks that are the main text's, in order."""
    out, k = [], 0
    for b in page:
        hit = k < len(texts) and b.text == texts[k] and "in:title" not in b.path
        out.append(int(hit))
        k += hit
    return out


def train(pages: int = PAGES, seed: int = SEED, steps: int = STEPS, penalty: float = PENALTY) -> Model:
    """Penalised maximum likelihood by gradient steps (Adam), forward and backward over all pages at once."""
    names: dict[str, int] = {}
    count: dict[str, int] = {}
    seen = []
    for html, texts in labelled_pages(pages, seed):
        page = blocks(html)
        if not page:
            continue
        y = labels(page, texts)
        f = features(page)
        seen.append((f, y))
        for x in {n for own in f for n in own}:
            count[x] = count.get(x, 0) + 1
    for x, n in count.items():
        if n >= 4:
            names[x] = len(names)
    width, size = max(len(y) for _, y in seen), len(seen)
    most = max(len(own) for f, _ in seen for own in f)
    at = np.full((size, width, most), len(names), np.int64)
    y = np.zeros((size, width), np.int64)
    live = np.zeros((size, width), bool)
    for i, (f, own) in enumerate(seen):
        y[i, : len(own)], live[i, : len(own)] = own, True
        for t, x in enumerate(f):
            k = [names[n] for n in x if n in names]
            at[i, t, : len(k)] = k
    w, step = np.zeros(len(names) + 1), np.zeros((2, 2))
    pair = live[:, 1:] & live[:, :-1]
    gold = np.array([[(pair & (y[:, :-1] == i) & (y[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    m = [np.zeros_like(w), np.zeros_like(step)]
    v = [np.zeros_like(w), np.zeros_like(step)]
    total = live.sum()
    for n in range(1, steps + 1):
        unary = np.zeros((size, width, 2))
        unary[:, :, 1] = w[at].sum(2) * live
        fore, back = unary.copy(), np.zeros_like(unary)
        for t in range(1, width):
            new = np.logaddexp.reduce(fore[:, t - 1, :, None] + step, axis=1) + unary[:, t]
            fore[:, t] = np.where(live[:, t, None], new, fore[:, t - 1])
        for t in range(width - 2, -1, -1):
            new = np.logaddexp.reduce(step + (unary[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
            back[:, t] = np.where(live[:, t + 1, None], new, 0.0)
        z = np.logaddexp.reduce(fore[:, -1], axis=1)
        p = np.exp(fore[:, :, 1] + back[:, :, 1] - z[:, None]) * live
        both = np.exp(fore[:, :-1, :, None] + step + (unary[:, 1:] + back[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pair[:, :, None, None]
        gw = np.bincount(at.ravel(), np.repeat(((y - p) * live).ravel(), most), len(w)) / total - penalty * w
        gw[-1] = 0
        for k, (g, target) in enumerate(((gw, w), ((gold - both.sum((0, 1))) / total - penalty * step, step))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            target += 0.15 * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)
    return Model({x: round(float(w[k]), 6) for x, k in names.items()}, tuple(round(float(x), 6) for x in step.ravel()))


@lru_cache(4)
def trained(pages: int = PAGES, seed: int = SEED) -> Model:
    return train(pages, seed)


def viterbi(scores: list[float], step: tuple[float, float, float, float]) -> list[int]:
    """The best labels for a chain; scores: of label 1 against label 0."""
    if not scores:
        return []
    s00, s01, s10, s11 = step
    a, b, back = 0.0, scores[0], []
    for s in scores[1:]:
        to0, to1 = b + s10 > a + s00, b + s11 > a + s01
        back.append((to0, to1))
        a, b = (b + s10 if to0 else a + s00), (b + s11 if to1 else a + s01) + s
    out = [int(b > a)]
    for to in reversed(back):
        out.append(int(to[out[-1]]))
    return out[::-1]


class Extractor:
    def __init__(self, model: Model):
        self.model = model
        self.paths: dict[tuple[str, ...], float] = {}

    def path(self, p: tuple[str, ...]) -> float:
        if (s := self.paths.get(p)) is None:
            if len(self.paths) > 50_000:
                self.paths.clear()
            s = self.paths[p] = sum(self.model.weights.get(x, 0.0) for x in p)
        return s

    def text(self, html: str | None) -> str:
        page = blocks(html)
        w = self.model.weights.get
        last = len(page) - 1
        scores = [self.path(b.path) + sum(w(x, 0.0) for x in shape(b)) + w("first" if i == 0 else "last" if i == last else "inner", 0.0) for i, b in enumerate(page)]
        return "\n".join(b.text for b, y in zip(page, viterbi(scores, self.model.step), strict=True) if y)


@lru_cache(4)
def _extractor(weights: tuple, step: tuple) -> Extractor:
    return Extractor(Model(dict(weights), step))


def main_text(pages: DataFrame, html: str = "html", into: str = "text", model: Model | None = None) -> DataFrame:
    """pages with the main text (string, empty if there is none) of column html in column into, which replaces one of that name.

    A null or empty page has no text; repeated rows, null ids and other columns stay as they are; an empty table gives an empty
    result. A page is never cut, however long.
    """
    ship(pages.sparkSession)
    given = model or trained()
    weights, step = tuple(given.weights.items()), given.step

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        own = _extractor(weights, step).text
        return pd.Series([own(h) for h in pages], dtype="object")

    return pages.withColumn(into, text(F.col(html)))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
