"""Main text of web pages: boosted trees over DOM nodes and hierarchical decoding.

Trees score each block node from subtree density, attribute words, depth and siblings. Decoding
chooses the likeliest consistent labelling of the tree: the trees give the chance that a node is
kept if its parent is, and a dropped node takes its whole subtree with it, so no descendant is kept
under a dropped ancestor. The trees are trained here, on pages that a
generator lays out in many ways with the kept parts marked (no page of the input is read for it).
"""

import math
import random
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gbdt
from .common import text_of
from .html_tree import Page, parse

TAGS = (
    ("article",), ("main",), ("section",), ("div",), ("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "menu", "dl"), ("li", "dt", "dd"), ("nav",), ("header",),
    ("footer",), ("aside",), ("form", "fieldset", "button"), ("table", "tbody", "tr", "td", "th"), ("blockquote", "pre"), ("figure", "figcaption"), ("#page",), ("dialog", "details"),
    ("noscript", "object", "canvas", "audio", "video", "svg"),
)
WORDS = {
    "content": "article|post|content|entry|story|main|body|text|page",
    "menu": r"nav|menu|breadcrumb|crumb|pagination|pager|toc|toolbar|tabs",
    "head": "header|masthead|banner|topbar|brand|logo|hero",
    "foot": "footer|copyright|colophon|legal|imprint|bottom",
    "side": "sidebar|aside|widget|related|recommend|popular|trending|more-|rail|complementary|teaser",
    "notice": "cookie|consent|notice|gdpr|popup|modal|alert|overlay|banner|disclaimer|paywall|message|hidden",
    "advert": r"(?:^|[\s_-])(?:ads?|adv|advert\w*|sponsor\w*|promo\w*|dfp|adsense|commercial)(?:$|[\s_-])",
    "comment": "comment|reply|replies|respond|disqus|discussion|review|guestbook|feedback",
    "form": "form|login|search|subscribe|newsletter|signup|sign-up|register|contact",
    "share": "share|social|follow|tags|byline|author|meta|date|rating|print|tools",
}
PATTERNS = [re.compile(p) for p in WORDS.values()]
TAG_OF = {t: i for i, ts in enumerate(TAGS) for t in ts}
MARKS = re.compile(r"[.,;:!?]")


def _words(attributes: str) -> tuple[float, ...]:
    return tuple(float(bool(p.search(attributes))) for p in PATTERNS)


def features(page: Page) -> np.ndarray:
    """One row per node."""
    nodes = page.nodes
    n = len(nodes)
    own = np.array([x.own for x in nodes], float)
    marks = np.zeros(n)
    words = np.zeros(n)
    start = np.zeros(n)
    seen, began = 0, [False] * n
    for k, text in page.pieces:
        if len(text) > 1:
            marks[k] += len(MARKS.findall(text))
            words[k] += len(text.split())
        if not began[k]:
            began[k], start[k] = True, seen
        seen += len(text)
    total = {"text": own.copy(), "links": np.array([x.links for x in nodes], float), "nodes": np.ones(n), "marks": marks.copy(), "words": words.copy(), "inputs": np.array([x.inputs for x in nodes], float), "p": np.array([x.tag == "p" for x in nodes], float), "li": np.array([x.tag == "li" for x in nodes], float)}
    for k in range(n - 1, 0, -1):
        for v in total.values():
            v[nodes[k].parent] += v[k]
    out = np.zeros((n, WIDTH))
    # the place among the siblings, and their mean size, once for each parent
    place, mean = np.zeros(n, int), total["text"].copy()
    for x in nodes:
        if x.children:
            place[x.children] = np.arange(len(x.children))
            mean[x.children] = total["text"][x.children].mean()
    whole = max(1.0, total["text"][0])
    longest = max([1.0, *total["text"][1:].tolist()])
    for k, x in enumerate(nodes):
        row = out[k]
        tag = TAG_OF.get(x.tag, -1)
        if tag >= 0:
            row[tag] = 1
        at = len(TAGS)
        if x.attributes:
            row[at : at + len(WORDS)] = _words(x.attributes)
        at += len(WORDS)
        if x.parent >= 0:  # what any ancestor is
            up = out[x.parent]
            row[at : at + len(TAGS) + len(WORDS)] = np.maximum(up[: len(TAGS) + len(WORDS)], up[at : at + len(TAGS) + len(WORDS)])
        at += len(TAGS) + len(WORDS)
        text, siblings = total["text"][k], nodes[x.parent].children if x.parent >= 0 else [k]
        i = place[k]
        row[at:] = (
            math.log1p(text), math.log1p(own[k]), total["links"][k] / max(1.0, text), text / whole, text / longest, total["nodes"][k] / max(1.0, text) * 100, math.log1p(total["words"][k]),
            total["marks"][k] / max(1.0, total["words"][k]), x.depth, len(x.children), len(siblings), i / len(siblings), math.log1p(text) - math.log1p(mean[k]),
            math.log1p(total["text"][siblings[i - 1]]) if i else -1, math.log1p(total["text"][siblings[i + 1]]) if i < len(siblings) - 1 else -1,
            start[k] / max(1, seen), total["inputs"][k], total["p"][k], total["li"][k], total["text"][x.parent] / whole if x.parent >= 0 else 1,
        )
    return out


WIDTH = 2 * (len(TAGS) + len(WORDS)) + 20


def decode(page: Page, logits: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the likeliest labelling in which a dropped node takes its subtree along.

    ``logits`` are log-odds that a node is kept if its parent is. From the leaves up, keeping a
    node costs -log p and the best of each child, dropping it costs -log(1 - p) and nothing below.
    """
    nodes = page.nodes
    keep, drop = np.logaddexp(0, -logits), np.logaddexp(0, logits)
    for k in range(len(nodes) - 1, 0, -1):
        keep[nodes[k].parent] += min(keep[k], drop[k])
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    for k in range(1, len(nodes)):
        kept[k] = kept[nodes[k].parent] and keep[k] < drop[k]
    return kept


def joined(page: Page, kept: np.ndarray) -> str:
    return " ".join("".join(t for k, t in page.pieces if kept[k]).split())


# the generator


class Layout:
    """One random page; elements that belong to the main text carry ``data-y="1"``, cut-outs in it ``data-y="0"``."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "ti", "or", "ch", "ei", "ß", "ü", "é", "è", "ç", "au", "ció", "ñ", "mente", "que", "ung", "heit", "la", "lo"]
        self.vocabulary = ["".join(self.r.choices(syllables, k=self.r.choice((1, 1, 2, 2, 3)))) for _ in range(120)]
        self.style = self.r.choice(("plain", "plain", "plain", "caps", "symbols", "bars", "repeat"))

    def sentence(self, least: int = 3, most: int = 18, style: str = "plain") -> str:
        w = self.r.choices(self.vocabulary, k=self.r.randint(least, most))
        if style == "caps":
            return " ".join(x.upper() + "!!" for x in w)
        if style == "symbols":
            return " ".join(x + self.r.choice(("###", "%%%", "&amp;&amp;", "***", "$$$")) for x in w)
        if style == "bars":
            return " | ".join(w)
        if style == "repeat":
            return " ".join(w[:1] * len(w))
        return " ".join(w).capitalize() + ("" if least < 3 and self.r.random() < 0.7 else ".")  # labels and titles seldom end with a stop

    def text(self, sentences: int, style: str = "plain") -> str:
        return self.r.choice((" ", " ", "\n")).join(self.sentence(style=style) for _ in range(sentences))

    def box(self, tag: str, names: str, inner: str, plain: float = 0.15) -> str:
        """A semantic tag or a div with a telling class or id, at times a div that tells nothing."""
        if self.r.random() < 0.45 and tag:
            return f"<{tag}>{inner}</{tag}>"
        if self.r.random() < plain:
            return f"<div>{inner}</div>"
        name = self.r.choice(names.split())
        name = self.r.choice(("{}", "{}", "site-{}", "c-{}", "{}-wrap", "js-{} {}", "{}1", "main-{}", "{}-box"))
        name = name.replace("{}", self.r.choice(names.split()))
        tag = self.r.choice(("div", "div", "section"))
        return f'<{tag} {self.r.choice(("class", "id"))}="{name}">{inner}</{tag}>'

    def links(self, n: int) -> str:
        items = [f'<a href="/{i}">{self.sentence(1, 4)}</a>' for i in range(n)]
        return self.r.choice((lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<span>{x}</span>" for x in items)))()

    def some(self, p: float, make) -> str:
        return make() if self.r.random() < p else ""

    def nav(self) -> str:
        return self.box("nav", "nav menu navigation navbar topnav breadcrumb breadcrumbs", self.links(self.r.randint(2, 9)))

    def header(self) -> str:
        return self.box("header", "header masthead topbar site-title branding", f"<div>{self.sentence(1, 4)}</div>" + self.some(0.5, self.nav) + self.some(0.4, lambda: f"<p>{self.sentence()}</p>"), 0.05)

    def footer(self) -> str:
        body = self.r.choice((lambda: f"&copy; {self.sentence(1, 3)} &middot; {self.text(self.r.randint(1, 3))}", lambda: f"<p>{self.text(self.r.randint(1, 4))}</p>" + self.links(4), lambda: self.links(6) + f"<small>&copy; 2021 {self.sentence(1, 4)}</small>"))()
        return self.box("footer", "footer footer-links copyright colophon legal bottom", body, 0.03)

    def aside(self) -> str:
        return self.box("aside", "sidebar side widget related related-posts recommended popular rail trending", f"<h3>{self.sentence(1, 3)}</h3>" + self.r.choice((lambda: self.links(5), lambda: f"<p>{self.text(self.r.randint(1, 4))}</p>"))(), 0.03)

    def notice(self) -> str:
        return self.box("", "cookie-notice cookie consent notice gdpr popup modal alert cookie-banner overlay newsletter-popup", f"<p>{self.text(self.r.randint(1, 3))}</p>" + self.some(0.6, lambda: f"<button>{self.sentence(1, 2)}</button>"), 0)

    def advert(self) -> str:
        return f'<div class="{self.r.choice(("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad", "ad top", "sponsor-box"))}">{self.r.choice((lambda: self.text(self.r.randint(1, 3)), lambda: f"<p>{self.text(2)}</p>", lambda: f"<a href=x>{self.sentence()}</a>"))()}</div>'

    def form(self) -> str:
        return self.box("form", "search login subscribe newsletter signup contact-form", f"<label>{self.r.choice((self.r.choice(self.vocabulary), self.sentence(1, 3), self.sentence(1, 3)))}</label><input name=q><button>{self.sentence(1, 1)}</button>" + self.some(0.4, lambda: f"<p>{self.sentence()}</p>"), 0)

    def comments(self) -> str:
        one = lambda: self.r.choice(('<div class="comment">{}</div>', '<li class="comment">{}</li>', "<article>{}</article>", "<div>{}</div>")).format(f"<b>{self.sentence(1, 2)}</b><p>{self.text(self.r.randint(1, 4))}</p>")
        names = self.r.choice(("comments", "comment-list", "responses", "replies", "disqus_thread", "discussion", "reader-comments", "user-comments"))
        tag = self.r.choice(("div", "section", "ol"))
        return f'<{tag} {self.r.choice(("id", "class"))}="{names}"><h2>{self.sentence(1, 3)}</h2>' + "".join(one() for _ in range(self.r.randint(1, 5))) + self.some(0.4, self.form) + f"</{tag}>"

    def share(self) -> str:
        return f'<div class="{self.r.choice(("share", "social", "share-buttons", "social-links", "follow-us"))}" data-y="0">{self.links(3)}</div>'

    def article(self) -> str:
        out = [self.some(0.85, lambda: f"<h1>{self.sentence(2, 9, self.style)}</h1>")]
        blocks = self.r.choice((0, 1, 1, 2, 3, 5, 8, 14)) if self.r.random() < 0.95 else self.r.choice((40, 80, 200))
        for i in range(blocks):
            style = self.style if self.r.random() < 0.9 else "plain"
            body = self.text(self.r.choice((1, 1, 2, 5, 12) if blocks < 40 else (1, 1, 2)), style)
            if self.r.random() < 0.2:
                body = f"<b>{body}<br>"
            elif self.r.random() < 0.2:
                body += f" <a href=/x>{self.sentence(1, 5)}</a> <em>{self.sentence(1, 3)}</em>"
            out.append(self.r.choice((lambda b: f"<p>{b}</p>", lambda b: f"<p>{b}</p>", lambda b: f"<p>{b}", lambda b: f"<div>{b}</div>"))(body))
            if self.r.random() < 0.12:
                out.append(self.r.choice((f"<h2>{self.sentence(1, 6)}</h2>", "<ul>" + "".join(f"<li>{self.sentence(1, 9)}</li>" for _ in range(4)) + "</ul>", f"<blockquote>{self.text(2)}</blockquote>", f"<pre>{self.text(2)}</pre>", "<table>" + f"<tr><td>{self.sentence(1, 3)}</td><td>{self.sentence(1, 3)}</td></tr>" * 3 + "</table>", f"<figure><figcaption>{self.sentence()}</figcaption></figure>")))
            if self.r.random() < 0.02:
                tag = self.r.choice(TAGS[-1])
                out.append(f'<{tag} data-y="0">{self.sentence()}</{tag}>')
            if i and self.r.random() < (0.08 if blocks < 40 else 0.01):
                out.append(self.r.choice((self.advert, self.aside, self.notice, self.form))().replace(">", ' data-y="0">', 1))
        if self.r.random() < 0.15:
            out.append(self.share())
        if self.r.random() < 0.12:
            out.append(self.comments().replace(">", ' data-y="0">', 1))
        kind = self.r.choice(('<article data-y="1">{}</article>', '<article data-y="1" class="post">{}</article>', '<main data-y="1">{}</main>', '<div class="{n}" data-y="1">{}</div>', '<div id="{n}" data-y="1">{}</div>', '<div data-y="1">{}</div>', '<section class="{n}" data-y="1">{}</section>'))
        name = self.r.choice(("content", "post-content", "entry-content", "article-body", "story", "main-content", "text", "post", "entry", "page-body"))
        out = kind.replace("{n}", name).replace("{}", "".join(out))
        for _ in range(self.r.choice((0, 0, 1, 2))):
            out = self.r.choice(("<main>{}</main>", '<div class="wrapper">{}</div>', "<div>{}</div>", '<div id="page">{}</div>', '<div class="container">{}</div>')).replace("{}", self.some(0.1, self.advert) + out + self.some(0.1, self.aside))
        return out

    def html(self) -> str:
        above = [self.some(0.5, self.header), self.some(0.7, self.nav), self.some(0.3, self.notice), self.some(0.5, self.advert), self.some(0.3, self.form), self.some(0.25, self.aside)]
        below = [self.some(0.35, self.comments), self.some(0.4, self.aside), self.some(0.3, self.advert), self.some(0.35, self.form), self.some(0.15, self.nav), self.some(0.1, self.notice)]
        above.append(self.some(0.08, lambda: f"<noscript>{self.text(1)}</noscript>"))
        self.r.shuffle(above)
        self.r.shuffle(below)
        return f"<!DOCTYPE html><html><head><title>{self.sentence()}</title></head><body>" + "".join(above) + self.article() + "".join(below) + self.some(0.85, self.footer) + self.some(0.1, self.notice) + "</body></html>"


def truth(page: Page) -> np.ndarray:
    """Kept nodes of a generated page: the marked part without its cut-outs, and all its ancestors."""
    nodes = page.nodes
    inside = np.zeros(len(nodes), bool)
    path = np.zeros(len(nodes), bool)
    for k in range(1, len(nodes)):
        inside[k] = nodes[k].label == "1" or inside[nodes[k].parent] and nodes[k].label != "0"
        if nodes[k].label == "1":
            up = nodes[k].parent
            while up >= 0:
                path[up] = True
                up = nodes[up].parent
    return inside | path


@cache
def model(pages: int = 2000, trees: int = 110, seed: int = 1) -> gbdt.Trees:
    """Trees fitted on ``pages`` generated pages; the same on every call."""
    xs, ys = [], []
    for i in range(pages):
        page = parse(Layout(seed * 1_000_003 + i).html())
        kept = truth(page)
        asked = np.array([k > 0 and kept[x.parent] for k, x in enumerate(page.nodes)])
        xs.append(features(page)[asked])
        ys.append(kept[asked].astype(float))
    return gbdt.fit(np.vstack(xs), np.concatenate(ys), trees=trees)


def main_text(html: Column, trees: gbdt.Trees | None = None, slice_rows: int = 64) -> Column:
    """The main text of each page. Pages of a slice are scored together."""
    trees = trees or model()

    @F.arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        out = []
        for i in range(0, len(pages), slice_rows):
            some = [parse(x.as_py() or "") for x in pages[i : i + slice_rows]]
            rows = [features(p) for p in some]
            logits = trees.logits(np.vstack(rows))
            at = 0
            for p, r in zip(some, rows, strict=True):
                out.append(joined(p, decode(p, logits[at : at + len(r)])))
                at += len(r)
        return pa.array(out, pa.string())

    return extract(html)


def extract_pages(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html`` in column ``name`` (replaced if it exists).

    Null and empty pages, and pages without main text, give the empty string; pages are worked on
    alone and whole, so repeated rows are alike and an empty table stays empty.
    """
    return pages.withColumn(name, main_text(text_of(html)))
