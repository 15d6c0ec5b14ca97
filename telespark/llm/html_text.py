"""Operator 4: main text of web pages by a tree-structured graphical model over the DOM.

Every block element is a variable (content or not); inline elements belong to the block around them.
A node potential comes from a logistic regression over the element's tag, its class and id words, the
length of its text, links and sentence marks; a potential for each kind of child couples parent and
child. Sum-product messages go from the leaves to the root and back, which gives exact marginals; a
block's text is kept if its marginal is over one half.

Both potentials are trained from labelled pages: a bounded sample of the given pages, labelled by
their own ``article`` or ``main`` element, and pages written by ``labelled_page`` with the parts that
a page may have around and inside its article (menus, notices, adverts, side bars, forms, comments).

Defined cases: a null or empty page has an empty text; a page cut off anywhere keeps what was read
(an unfinished tag is dropped); very long pages are read whole and iteratively, however deep; pages are independent, so
repeated rows give repeated results; an empty table gives an empty one; extra columns are carried along.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 200            # pages drawn for training; five times as many are written
SAMPLE_CHARS = 200_000  # longer pages are not drawn

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
                   "hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul button select option label legend textarea".split())
SILENT = frozenset("script style noscript template iframe object svg title textarea select head".split())     # text in them is never content
RAW = frozenset("script style textarea title iframe noscript".split())                                       # read up to their end tag
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body html div article section main aside nav form select blockquote".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

KINDS = ("p", "heading", "list", "item", "table", "plain", "quote", "article", "main", "nav", "header", "footer", "aside", "form", "head", "root", "other")
_KIND = {"p": "p", "ul": "list", "ol": "list", "dl": "list", "menu": "nav", "li": "item", "dt": "item", "dd": "item", "div": "plain", "section": "plain", "center": "plain", "details": "plain", "summary": "plain",
         "blockquote": "quote", "pre": "quote", "figure": "quote", "figcaption": "quote", "article": "article", "main": "main", "nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "dialog": "aside",
         "form": "form", "fieldset": "form", "button": "form", "select": "form", "option": "form", "label": "form", "legend": "form", "textarea": "form", "head": "head", "title": "head", "html": "root", "body": "root",
         **{f"h{i}": "heading" for i in range(1, 7)}, **{t: "table" for t in "table tbody thead tfoot tr td th caption".split()}}
ASIDE = frozenset(("nav", "footer", "aside", "form", "header"))
GOOD = frozenset("article content story entry post main text prose body richtext".split())
BAD = {w: i for i, words in enumerate((
    "nav navbar menu breadcrumb breadcrumbs pagination pager toolbar topbar sidebar side rail widget",
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored",
    "comment comments reply replies respond discussion disqus feedback reactions reader",
    "cookie cookies consent notice notices alert popup modal overlay gdpr privacy disclaimer",
    "footer foot copyright legal header masthead head logo login signup signin search form subscribe newsletter share sharing social related recommended more tags meta byline")) for w in words.split()}
N_BAD = 5
LENGTHS = (1, 20, 80, 300)
NEAR = 4                # levels up to which an ancestor that looks like a side part counts
SIZE = len(KINDS) + 1 + N_BAD + len(LENGTHS) + 4 + 3

#: Attributes: names, each with a value after "=" that is quoted or goes up to white space; a quote elsewhere is part of a name.
_ATTRIBUTES = r"(?>[\s/]+|[^\s/>][^\s/>=]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)?)?)*+"
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:class|id|role|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*))", re.I)
_LABEL = re.compile(r"data-label=\"([01])\"")
_WORD = re.compile(r"[a-z]+")


class Page:
    """The block tree: nodes in the order of their start tags, so a parent comes before its children."""

    def __init__(self, source: str):
        self.tag, self.parent, self.words, self.label = ["html"], [0], [()], [1 if source.startswith('<html data-label="1"') else None]
        self.pieces: list[tuple[int, str]] = []          # text in page order, with its block
        self.linked: list[int] = [0]                     # characters inside links, by block
        stack, links, at, size = [0], 0, 0, len(source)
        while at < size:
            found = _TAG.search(source, at)
            text = source[at:found.start()] if found else source[at:]
            if text:
                self._text(stack[-1], html.unescape(text), links)
            if not found:
                break
            at = found.end()
            name = (found[2] or "").lower()
            if not name or not found[4]:
                continue
            if name == "a":
                links = 0 if found[1] else 1
            elif name == "br" or name == "hr" or name == "img":
                self.pieces.append((stack[-1], " "))
            elif found[1]:
                self._close(stack, name)
            elif name in RAW:
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else size
            elif name in BLOCKS and name != "html":
                links = 0
                self._open(stack, name, found[3])

    def _text(self, node: int, text: str, links: int) -> None:
        self.pieces.append((node, text))
        if links:
            self.linked[node] += len(text)

    def _open(self, stack: list[int], name: str, attributes: str) -> None:
        tags = self.tag
        if name not in ("button", "label") and tags[stack[-1]] == "p":
            stack.pop()
        for depth in range(len(stack) - 1, 0, -1):
            if tags[stack[depth]] in CLOSES.get(name, ()):
                del stack[depth:]
            elif tags[stack[depth]] in SCOPES or name not in CLOSES:
                break
        if tags[stack[-1]] == "head" and name != "head":
            stack.pop()
        tags.append(name)
        self.parent.append(stack[-1])
        label = _LABEL.search(attributes) if attributes else None
        self.label.append(int(label[1]) if label else None)
        self.words.append(tuple(_WORD.findall(" ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower())) if attributes else ())
        self.linked.append(0)
        stack.append(len(tags) - 1)

    def _close(self, stack: list[int], name: str) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if self.tag[stack[depth]] == name:
                del stack[depth:]
                return

    def features(self) -> np.ndarray:
        n = len(self.tag)
        out = np.zeros((n, SIZE), dtype=np.float32)
        chars, far = [0] * n, [NEAR + 1] * n             # far: levels up to the next element that looks like a side part
        for node, text in self.pieces:
            chars[node] += len(text.strip())
        for i in range(n):
            row, k = out[i], len(KINDS)
            row[KINDS.index(_KIND.get(self.tag[i], "other"))] = 1
            words = self.words[i]
            if words:
                bad = {BAD[w] for w in words if w in BAD}
                for b in bad:
                    row[k + 1 + b] = 1
                row[k] = not bad and any(w in GOOD for w in words)
            k += 1 + N_BAD
            level = sum(chars[i] >= x for x in LENGTHS)
            if level:
                row[k + level - 1] = 1
                share = self.linked[i] / chars[i]
                row[k + len(LENGTHS) + (0 if not self.linked[i] else 1 if share < 0.3 else 2 if share < 0.7 else 3)] = 1
            up = far[self.parent[i]] if i else NEAR + 1
            far[i] = 0 if any(w in BAD for w in words) or _KIND.get(self.tag[i]) in ASIDE else min(up + 1, NEAR + 1)
            row[-3] = up < NEAR
            row[-2] = self.tag[self.parent[i]] == "body"
            row[-1] = 1
        return out

    def kinds(self) -> list[int]:
        return [KINDS.index(_KIND.get(t, "other")) for t in self.tag]

    def inherited(self) -> list[int]:
        """Labels of marked elements, handed down."""
        out = []
        for i, label in enumerate(self.label):
            out.append(label if label is not None else out[self.parent[i]] if i else 0)
        return out

    def own(self) -> list[int] | None:
        """Labels of an unmarked page by its article or main element; None if it has none."""
        if not {"article", "main"} & set(self.tag):
            return None
        out = []
        for i, tag in enumerate(self.tag):
            kind = _KIND.get(tag, "other")
            bad = kind in ASIDE or any(w in BAD for w in self.words[i])
            out.append(0 if bad else 1 if kind in ("article", "main") else out[self.parent[i]] if i else 0)
        return out

    def text(self, keep) -> str:
        parts, last = [], None
        for node, text in self.pieces:
            if keep[node] and self.tag[node] not in SILENT:
                if node != last:
                    parts.append(" ")
                parts.append(text)
            last = node
        return " ".join("".join(parts).split())


class Model:
    """Node weights, and log potentials by kind of child, label of the parent and of the child."""

    def __init__(self, pages: list[tuple[Page, list[int]]], ridge: float = 0.02, steps: int = 30):
        x = np.concatenate([p.features() for p, _ in pages]).astype(np.float64)
        y = np.concatenate([np.array(labels, dtype=np.float64) for _, labels in pages])
        w = np.zeros(SIZE)
        for _ in range(steps):                              # Newton steps of a ridge-penalised logistic regression
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (y - p) - ridge * w
            w += np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(SIZE), slope)
        self.weights = w
        counts = np.full((len(KINDS), 2, 2), 0.1)
        counts[:, [0, 1], [0, 1]] += 0.9
        for page, labels in pages:
            for i, kind in enumerate(page.kinds()):
                if i:
                    counts[kind, labels[page.parent[i]], labels[i]] += 1
        joint = counts / counts.sum(axis=(1, 2), keepdims=True)
        # what parent and child say beyond either alone, as the node potentials hold the rest
        self.pair = np.log(joint) - np.log(joint.sum(axis=1, keepdims=True)) - np.log(joint.sum(axis=2, keepdims=True))

    def marginals(self, page: Page) -> np.ndarray:
        """P(content) of each node: messages upward in reverse order of start tags, then downward."""
        n, parent, pair = len(page.tag), page.parent, self.pair[page.kinds()].tolist()
        node = np.clip(page.features() @ self.weights, -20, 20).tolist()
        zero, one = [0.0] * n, node[:]                      # log potential times messages from below, by label
        up0, up1 = [0.0] * n, [0.0] * n
        for i in range(n - 1, 0, -1):
            (a, b), (c, d) = pair[i]
            up0[i], up1[i] = _sum(a + zero[i], b + one[i]), _sum(c + zero[i], d + one[i])
            zero[parent[i]] += up0[i]
            one[parent[i]] += up1[i]
        for i in range(1, n):                               # the parent's belief without this child's own message
            p = parent[i]
            x, y = zero[p] - up0[i], one[p] - up1[i]
            (a, b), (c, d) = pair[i]
            zero[i] += _sum(x + a, y + c)
            one[i] += _sum(x + b, y + d)
        return 1 / (1 + np.exp(np.clip(np.array(zero) - np.array(one), -50, 50)))

    def extract(self, source: str | None) -> str:
        if not source:
            return ""
        page = Page(source)
        return page.text(self.marginals(page) > 0.5)


def _sum(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if a - b < 40 else a


# ------------------------------------------------------------------------------------------- training

def labelled_page(seed: int) -> str:
    """A page whose elements carry their label in ``data-label``; parts, containers and their order vary with the seed."""
    r = random.Random(seed)
    brief = r.random() < 0.15
    word = lambda: "".join(r.choice("aeioulnrstdm") for _ in range(r.randint(1, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentences = lambda a, b: " ".join(words(3, 18).capitalize() + r.choice(".!?") for _ in range(r.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{words(1, 4)}</a>'
    attr = lambda *names: r.choice(["", *[f' {r.choice(("class", "id"))}="{x}"' for x in names]])
    named = lambda *names: f' {r.choice(("class", "id"))}="{r.choice(names)}"'

    def links() -> str:
        return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 9))) + "</ul>" if r.random() < 0.7 else " | ".join(link() for _ in range(r.randint(2, 6)))

    def paragraphs(a: int, b: int) -> str:
        return "".join(f"<p>{words(1, 3) if brief or r.random() < 0.1 else sentences(1, 6)}" + ("</p>" if r.random() < 0.8 else "") for _ in range(r.randint(a, b)))

    def box(names: tuple[str, ...], inside: str, *tags: str) -> str:
        tag = r.choice([*tags, "div", "section"])
        return f'<{tag}{attr(*names) if tag in tags else named(*names)} data-label="0">{inside}</{tag}>'

    def part() -> str:
        kind = r.randrange(8)
        if kind == 0:
            return box(("nav", "menu", "breadcrumb", "pagination"), links(), "nav", "menu")
        if kind == 1:
            return box(("ad", "ads", "advert", "banner", "promo", "sponsored"), r.choice([sentences(1, 3), paragraphs(1, 2), link()]))
        if kind == 2:
            return box(("comments", "comment-list", "discussion", "replies", "reader-comments"), "<h3>" + words(1, 3) + "</h3>" + "".join(r.choice(['<div class="comment">', "<div>", "<div>", "<li>", '<div class="reply">', '<article class="comment">', "<article>"]) + paragraphs(1, 3) + r.choice(["</div>", "</article>"]) for _ in range(r.randint(1, 5))))
        if kind == 3:
            return box(("cookie-notice", "notice", "alert", "consent", "popup"), r.choice([sentences(1, 3), paragraphs(1, 2)]) + r.choice(["", f"<button>{word()}</button>"]), "dialog", "aside")
        if kind == 4:
            return box(("sidebar", "widget", "related", "newsletter", "share"), r.choice([links(), paragraphs(1, 3), "<h4>" + words(1, 3) + "</h4>" + links()]), "aside")
        if kind == 5:
            return f'<form{attr("search", "subscribe", "login")} data-label="0"><label>{words(1, 3)}</label><input name="q">{r.choice(["", paragraphs(1, 1)])}<button>{word()}</button></form>'
        if kind == 6:
            return f'<header{attr("masthead", "top")} data-label="0">{r.choice([words(1, 5), "<h1>" + words(1, 4) + "</h1>", links(), paragraphs(1, 1)])}</header>'
        return f'<footer data-label="0">{r.choice(["&copy; ", ""])}{r.choice([words(2, 8), links(), paragraphs(1, 2)])}</footer>'

    def body() -> str:
        out = []
        for _ in range(r.randint(1, 10)):
            kind = r.random()
            out.append(paragraphs(1, 4) if kind < 0.6 else f"<h{r.randint(2, 4)}>{words(1, 7)}</h2>" if kind < 0.7 else "<ul>" + "".join(f"<li>{sentences(1, 2)}</li>" for _ in range(r.randint(2, 5))) + "</ul>" if kind < 0.78
                       else f"<blockquote>{sentences(1, 3)}</blockquote>" if kind < 0.84 else f"<table><tr><td>{words(1, 3)}<td>{words(1, 3)}</table>" if kind < 0.88 else f"<pre>{words(3, 9)}</pre>" if kind < 0.91 else f"<div>{sentences(1, 4)}</div>" if kind < 0.95 else part())
        return "".join(out)

    tag = r.choice(["article", "article", "article", "main", "div", "section"])
    name = attr("content", "post", "entry", "story", "main-text") if tag in ("article", "main") else r.choice([attr, lambda *names: "", named, named])("content", "post", "entry", "story", "article-body", "main")
    inside = r.choice([f"<h1>{words(2, 9)}</h1>", "", f"<h1>{words(2, 9)}</h1>"]) + body() + "".join(part() for _ in range(r.choice([0, 0, 1, 2])))
    before, after = "".join(part() for _ in range(r.randint(0, 4))), "".join(part() for _ in range(r.randint(0, 4)))
    if r.random() < 0.2:                                    # an article straight in the body, or bare
        return f'<html data-label="1"><body>{before}{inside}{after}</body></html>' if r.random() < 0.5 else f'<{tag}{name} data-label="1">{inside}</{tag}>'
    return f'<html><head><title>{words(2, 5)}</title></head><body data-label="0">{before}<{tag}{name} data-label="1">{inside}</{tag}>{after}</body></html>'


def fit(pages: DataFrame) -> Model:
    """A model of the written pages and of at most ``SAMPLE`` given ones, drawn by a hash of the page id."""
    drawn = pages.where(F.col("html").isNotNull() & (F.length("html") <= SAMPLE_CHARS)).select("page_id", F.xxhash64("page_id").alias("lot")).orderBy("lot", "page_id").limit(SAMPLE)
    ids = [r.page_id for r in drawn.collect()]
    found = pages.where(F.col("page_id").isin(ids) & F.col("html").isNotNull()).select("html").distinct().orderBy("html").limit(SAMPLE).collect() if ids else []
    train = [(p, p.inherited()) for p in map(Page, map(labelled_page, range(5 * SAMPLE)))]
    for row in found:
        page = Page(row.html)
        labels = page.own()
        if labels:
            train.append((page, labels))
    return Model(train)


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """``pages`` with a column ``main_text``."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StringType())
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sources in batches:
            yield pd.Series([shared.value.extract(x) for x in sources], dtype=object)

    return pages.withColumn("main_text", main_text(F.col("html").cast("string")))
