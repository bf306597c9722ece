"""Main text of web pages by a tree-structured graphical model.

Every element of a page is a node that is either part of the article or not. A node's
own evidence (its tag, the words in class, id and role, how long its text is, how much
of it are links) gives unary potentials; potentials between parent and child, by the
kind of the child, connect the nodes. Sum-product messages, upward and then downward,
give each node's marginal, for all pages of a batch at once and level by level. Text
runs of nodes with a marginal of at least a half are the main text.

The weights are trained by gradient ascent on the likelihood, on labelled pages of many
layouts that ``labelled_pages`` makes from a seed; their number is a parameter.

Block elements divide blocks, line breaks count as white space. Character references
are decoded, white space (with no-break spaces) becomes one space. Null, empty and
text-only pages are pages of one node. Unclosed, stray and cut-off tags are taken as
browsers take them, more or less. Repeated rows give equal results; other columns pass.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PAGES = 400  # labelled ones made for the training

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr img br input button select".split())
CLOSES = {  # an opening tag ends these open ones, up to the boundary
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)", re.S)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
WHOLE = "<!--1-->"  # before a labelled page that is an article without a frame
LABEL = re.compile(r'data-y="([01])"')

TAGS = {name: k for k, names in enumerate([
    "p", "h1 h2 h3 h4 h5 h6", "li dt dd", "a", "nav menu", "header", "footer", "aside", "form fieldset button input label "
    "select option textarea legend", "script style noscript template head title iframe svg object canvas", "article", "main",
    "section", "div center", "ul ol dl", "table tbody thead tfoot tr td th caption", "blockquote pre code q", "b i em strong "
    "span small sup sub mark u s font abbr cite time br", "figure figcaption picture img", "body", "html", "#root", "ins"])
    for name in names.split()}
N_TAGS = max(TAGS.values()) + 2
HINTS = [re.compile(x, re.I) for x in (
    r"\b(ad|ads|advert\w*|adsense|adsby\w*|sponsor\w*|promo\w*|banner\w*|commercial|outbrain|taboola)\b",
    r"\b(nav\w*|menu\w*|breadcrumb\w*|pag(er|ination|ing)|toolbar|tabs?|skip|toc)\b",
    r"\b(header|masthead|site-?head\w*|topbar|top|logo|brand\w*)\b",
    r"\b(footer|foot|copyright|legal|colophon|bottom|credits)\b",
    r"\b(side\w*|aside|widgets?|related|recommend\w*|popular|trending|share\w*|sharing|social|tags?|rail|more|latest)\b",
    r"\b(cookies?|notice\w*|consent|gdpr|alert\w*|popup\w*|modal\w*|overlay\w*|newsletter|subscri\w*|sign-?up|warning|paywall)\b",
    r"\b(comment\w*|disqus|repl(y|ies)|respond\w*|discuss\w*|feedback|reviews?|responses?)\b",
    r"\b(content\w*|article\w*|post|posts|entry\w*|main\w*|story\w*|body|text|prose|blog-?post|copy)\b")]
SPLIT = re.compile(r"[_\s]+|(?<=[a-z])(?=[A-Z])")
N_FEATURES = N_TAGS + len(HINTS) + 18
KINDS = 5  # of parent-child potentials


@dataclass
class Page:
    parents: list[int] = field(default_factory=lambda: [-1])
    tags: list[str] = field(default_factory=lambda: ["#root"])
    names: list[str] = field(default_factory=lambda: [""])  # class, id and role
    labels: list[int] = field(default_factory=lambda: [0])
    runs: list[tuple[int, int, str]] = field(default_factory=list)  # node, block, text


def parse(source: str | None, labelled: bool = False) -> Page:
    """The element tree of a page and its text runs in page order."""
    page, source = Page(), source or ""
    stack, block, at, end = [0], 0, 0, len(source)
    page.labels[0] = int(labelled and source.startswith(WHOLE))
    tags = page.tags
    while at < end:
        found = TOKEN.search(source, at)
        start = found.start() if found else end
        if start > at:
            page.runs.append((stack[-1], block, source[at:start]))
        if not found:
            break
        at = found.end()
        tag = found.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            block += 1
        elif tag == "br":
            page.runs.append((stack[-1], block, " "))
            continue
        if found.group(1):
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] == tag:
                    del stack[k:]
                    break
                if tag in INLINE and tags[stack[k]] not in INLINE:
                    break
            continue
        if tag not in INLINE:  # a block ends an open paragraph
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] == "p":
                    del stack[k:]
                    break
                if tags[stack[k]] not in INLINE:
                    break
        if tag in CLOSES:
            ends, bound = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] in bound:
                    break
                if tags[stack[k]] in ends:
                    del stack[k:]
                    if tag != "tr":
                        break
        attributes = found.group(3)
        node = len(tags)
        page.parents.append(stack[-1])
        tags.append(tag)
        page.names.append(" ".join(m[1].strip("\"'") for m in NAMES.findall(attributes)) if attributes else "")
        if labelled:
            label = LABEL.search(attributes)
            page.labels.append(int(label[1]) if label else page.labels[stack[-1]])
        if tag in VOID or attributes.endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            close = re.compile(f"</{tag}\\b[^>]*(?:>|\\Z)", re.I).search(source, at)
            stop = close.start() if close else end
            if stop > at and tag not in ("script", "style"):
                page.runs.append((node, block, source[at:stop]))
            at = close.end() if close else end
            block += 1
            continue
        stack.append(node)
    return page


_hinted: dict[str, list[int]] = {}


def _hints(names: str) -> list[int]:
    found = _hinted.get(names)
    if found is None:
        plain = SPLIT.sub(" ", names).replace("-", " ")
        found = [k for k, hint in enumerate(HINTS) if hint.search(plain)]
        if len(_hinted) < 50_000:
            _hinted[names] = found
    return found


@dataclass
class Forest:
    """All nodes of several pages; parents come before their children."""

    parents: np.ndarray
    kinds: np.ndarray
    features: np.ndarray
    levels: list[np.ndarray]


def _kind(tag: str) -> int:
    if tag in INLINE:
        return 0 if tag != "a" else 1
    if TAGS.get(tag, 0) in (0, 1, 2, 16):
        return 2
    return 3 if TAGS.get(tag, N_TAGS - 1) in (4, 5, 6, 7, 8, 9) else 4


def forest(pages: list[Page]) -> Forest:
    sizes = [len(p.tags) for p in pages]
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    n = int(sum(sizes))
    parents = np.concatenate([np.array(p.parents, np.int64) + f for p, f in zip(pages, first)])
    parents[first] = -1
    tags = [t for p in pages for t in p.tags]
    x = np.zeros((n, N_FEATURES), np.float32)
    x[np.arange(n), [TAGS.get(t, N_TAGS - 1) for t in tags]] = 1
    for i, names in enumerate(name for p in pages for name in p.names):
        if names:
            for k in _hints(names):
                x[i, N_TAGS + k] = 1
    own, linked, stops = (np.zeros(n) for _ in range(3))
    for p, f in zip(pages, first.tolist()):
        for node, _, text in p.runs:
            m = len(text) if len(text) < 2 else len(text.strip())
            own[f + node] += m
            stops[f + node] += text.count(". ") + text.rstrip().endswith((".", "!", "?")) if m > 1 else 0
    depth = np.zeros(n, np.int64)
    is_link = np.array([t == "a" for t in tags])
    is_p = np.array([t == "p" for t in tags])
    for i in range(n):
        if parents[i] >= 0:
            depth[i] = depth[parents[i]] + 1
            is_link[i] |= is_link[parents[i]]
    linked[is_link] = own[is_link]
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
    whole, links, ends, under, paragraphs = own.copy(), linked.copy(), stops.copy(), np.zeros(n), np.zeros(n)
    for level in reversed(levels[1:]):
        up = parents[level]
        for values in (whole, links, ends):
            np.add.at(values, up, values[level])
        np.add.at(under, up, 1)
    np.add.at(paragraphs, parents[parents >= 0], is_p[parents >= 0])
    density = links / np.maximum(whole, 1)
    bare = np.repeat([not {"html", "body"}.intersection(p.tags) for p in pages], sizes)
    at = N_TAGS + len(HINTS)
    tests = [own > 0, own > 40, own > 200, whole > 0, whole > 80, whole > 400, density > .2, density > .6, ends > 0, ends > 3,
             paragraphs > 0, paragraphs > 2, under > 3, (own > 0) & (stops == 0), depth <= 1, np.ones(n, bool), (depth == 0) & (own > 0), (depth == 0) & bare]
    for k, test in enumerate(tests):
        x[:, at + k] = test
    kinds = np.array([_kind(t) for t in tags])
    return Forest(parents, kinds, x, levels)


def marginals(f: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of label 1 per node, and of (parent, child) labels per node with a parent.
    ``unary``: log potential of label 1; ``pair``: log potentials [kind, parent, child]."""
    n = len(f.parents)
    up = np.zeros((n, 2))  # log potential with all messages from below
    up[:, 1] = unary
    message = np.zeros((n, 2))  # to the parent
    for level in reversed(f.levels[1:]):
        message[level] = np.logaddexp.reduce(up[level][:, None, :] + pair[f.kinds[level]], axis=2)
        np.add.at(up, f.parents[level], message[level])
    down, joint = np.zeros((n, 2)), np.zeros((n, 2, 2))
    for level in f.levels[1:]:
        p = f.parents[level]
        rest = up[p] + down[p] - message[level]  # the parent without this child
        both = rest[:, :, None] + pair[f.kinds[level]] + up[level][:, None, :]
        both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
        joint[level] = both / both.sum(axis=(1, 2), keepdims=True)
        down[level] = np.logaddexp.reduce(rest[:, :, None] + pair[f.kinds[level]], axis=1)
    belief = up + down
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -60, 60))), joint


@dataclass
class Model:
    weights: np.ndarray
    pair: np.ndarray

    def marginals(self, pages: list[Page]) -> list[np.ndarray]:
        f = forest(pages)
        p, _ = marginals(f, f.features @ self.weights, self.pair)
        return np.split(p, np.cumsum([len(x.tags) for x in pages])[:-1])


def train(pages: list[Page], rounds: int = 200, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Weights of greatest likelihood, by Adam steps on exact gradients."""
    f = forest(pages)
    y = np.concatenate([np.array(p.labels) for p in pages])
    has = f.parents >= 0
    seen = np.zeros((len(y), 2, 2))
    seen[np.flatnonzero(has), y[f.parents[has]], y[has]] = 1
    sizes = [N_FEATURES, KINDS * 4]
    at, mean, square = (np.zeros(sum(sizes)) for _ in range(3))
    x = f.features.astype(np.float64)
    for t in range(1, rounds + 1):
        p, joint = marginals(f, x @ at[:N_FEATURES], at[N_FEATURES:].reshape(KINDS, 2, 2))
        edge = np.zeros((KINDS, 2, 2))
        np.add.at(edge, f.kinds[has], (seen - joint)[has])
        gradient = np.concatenate([x.T @ (y - p), edge.ravel()]) / len(pages) - decay * at
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        at = at + rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return Model(at[:N_FEATURES], at[N_FEATURES:].reshape(KINDS, 2, 2))


def main_text(page: Page, chance: np.ndarray) -> str:
    """Content blocks of a page, joined by an empty line."""
    blocks: dict[int, list[str]] = {}
    for node, block, text in page.runs:
        if chance[node] >= 0.5:
            blocks.setdefault(block, []).append(html.unescape(text) if "&" in text else text)
    joined = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(x for x in joined if x)


class _Maker:
    """Random labelled pages. Layout, markup and wording vary by the seed."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def pick(self, text: str, sep: str = "|") -> str:
        return self.r.choice(text.split(sep))

    def words(self, n: int) -> str:
        part = "ba co de fi gu ha jo ka le mi no pu ra se ti vo wy xa lo ne".split()
        return " ".join("".join(self.r.choices(part, k=self.r.randint(1, 4))) for _ in range(n))

    def sentence(self, low: int = 3, high: int = 18) -> str:
        return self.words(self.r.randint(low, high)).capitalize() + self.pick(".|.|.|?|!|.")

    def prose(self, most: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(1, most)))

    def inline(self, text: str) -> str:
        kind = self.r.random()
        if kind < .15:
            return f"<b>{text}<br>"
        if kind < .3:
            tag = self.pick("em|b|strong|i|span|code|a href='/x'")
            return f"{self.sentence()} <{tag}>{self.words(2)}</{tag.split()[0]}> {text}"
        return text

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{self.words(1)}">{self.words(self.r.randint(1, 4))}</a></li>' for _ in range(n))

    def box(self, tags: str, names: str, inner: str, label: int = 0) -> str:
        tag = self.pick(tags)
        name = self.pick(names)
        shown = f' {self.pick("class|id|class")}="{name}"' if name else ""
        return f'<{tag}{shown} data-y="{label}">{inner}</{tag}>'

    def nav(self) -> str:
        items = self.links(self.r.randint(1, 9))
        return self.box("nav|nav|nav|div|ul|div", "|nav|menu|main-menu|navbar|breadcrumbs|site-nav|pagination",
                        f"<ul>{items}</ul>" if self.r.random() < .7 else re.sub("</?li>", " ", items))

    def ad(self) -> str:
        inner = self.prose(2) if self.r.random() < .6 else f"<p>{self.prose(2)}</p><a href='/buy'>{self.words(2)}</a>"
        return self.box("div|div|div|aside|ins|section", "ad|ads|advert|advertisement|sponsored|promo|banner-ad|ad-slot|adsbygoogle", inner)

    def sidebar(self) -> str:
        parts = [self.pick("<h3>%s</h3>|<h2>%s</h2>|<h4>%s</h4>") % self.words(2)]
        parts += [f"<ul>{self.links(self.r.randint(2, 7))}</ul>" if self.r.random() < .6 else f"<p>{self.prose(2)}</p>"
                  for _ in range(self.r.randint(1, 3))]
        return self.box("aside|aside|div|section", "sidebar|widget|related|side|popular-posts|right-rail|recommended|share-tools", "".join(parts))

    def notice(self) -> str:
        return self.box("div|div|section|aside|p", "cookie-notice|cookie-banner|consent|notice|alert|newsletter|popup|gdpr|modal|subscribe-box",
                        (f"<p>{self.prose(2)}</p>" if self.r.random() < .6 else self.prose(2)) + self.pick("|<button>%s</button>" % self.words(1)))

    def form(self) -> str:
        return (f'<form data-y="0"><label>{self.words(2)}</label><input type="text"><select><option>{self.words(1)}<option>'
                f"{self.words(1)}</select><textarea>{self.words(3)}</textarea><button>{self.words(1)}</button>"
                f'{self.pick("|<p>%s</p>" % self.prose(1))}</form>')

    def comments(self) -> str:
        each = "".join(self.box("div|li|article", "comment|comment-body|reply", f"<p>{self.prose(3)}</p>"
                                if self.r.random() < .7 else f"<b>{self.words(2)}</b> {self.prose(3)}")
                       for _ in range(self.r.randint(1, 6)))
        return self.box("section|div|div|ol", "comments|comment-list|disqus|responses|discussion", f"<h3>{self.words(2)}</h3>{each}")

    def header(self) -> str:
        inner = self.pick("<h1>%s</h1>|<div class='logo'>%s</div>|<a href='/'>%s</a>|<p>%s</p>") % self.words(self.r.randint(1, 5))
        return self.box("header|header|header|div", "|header|masthead|site-header|top-bar", inner + (self.nav() if self.r.random() < .5 else "")) \
            if self.r.random() < .7 else f'<header data-y="0">{inner}</header>'

    def footer(self) -> str:
        inner = self.pick("&copy; |© |||Copyright ") + self.words(1) + self.pick(" &middot; | | - | <br> ") + self.prose(2)
        if self.r.random() < .4:
            inner = f"<p>{inner}</p>" + (f"<ul>{self.links(3)}</ul>" if self.r.random() < .5 else "")
        if self.r.random() < .8:
            return f'<footer data-y="0">{inner}</footer>'
        return self.box("footer|div|div", "footer|site-footer|copyright|legal|footer", inner)

    def article(self, noise: bool) -> str:
        parts = [f"<h1>{self.sentence(1, 10)}</h1>"] if self.r.random() < .8 else []
        for _ in range(self.r.choice([1, 1, 2, 3, 4, 6, 9])):
            kind = self.r.random()
            if kind < .72:
                close = "</p>" if self.r.random() < .8 else ""
                parts.append(f"<p>{self.inline(self.prose())}{close}")
            elif kind < .78:
                parts.append(f"<h2>{self.words(self.r.randint(1, 6))}</h2>")
            elif kind < .83:
                parts.append("<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(self.r.randint(1, 5))) + "</ul>")
            elif kind < .87:
                parts.append(f"<blockquote>{self.pick('<p>%s</p>|%s') % self.prose(2)}</blockquote>")
            elif kind < .9:
                parts.append(f"<pre>{self.words(8)}</pre>")
            elif kind < .93:
                cells = "".join(f"<tr><td>{self.words(1)}</td><td>{self.words(3)}</td></tr>" for _ in range(self.r.randint(1, 4)))
                parts.append(f"<table>{cells}</table>")
            elif kind < .96:
                parts.append(f"<figure><img src='x.png'><figcaption>{self.sentence()}</figcaption></figure>")
            else:
                parts.append(f"<div>{self.prose()}</div>")
            if noise and self.r.random() < .12:
                parts.append(self.r.choice([self.ad, self.sidebar, self.notice, self.form, self.script])())
        return "".join(parts)

    def script(self) -> str:
        return self.pick("<script data-y='0'>var t=\"</p>\";go(1);</script>|<style data-y='0'>p{margin:0}</style>|"
                         "<noscript data-y='0'>please enable</noscript>").replace("'0'", '"0"')

    def page(self) -> str:
        r, body = self.r, self.article(self.r.random() < .5)
        shape = r.random()
        if shape < .5:
            body = f'<article data-y="1">{body}</article>'
        elif shape < .7:
            body = self.box("div|section|main|div", "content|post|entry-content|article-body|main|story|post-text", body, 1)
        elif shape < .8:
            body = f'<main data-y="{int(r.random() < .5)}">' + self.box("article|div|section", "|post|entry|content", body, 1) + "</main>"
        else:
            return self.frame(self.script() * (r.random() < .3) + body, 1)
        before = [x() for x in (self.header, self.nav, self.notice, self.ad, self.script, self.form) if r.random() < .4]
        after = [x() for x in (self.comments, self.sidebar, self.ad, self.form, self.nav, self.notice) if r.random() < .3]
        r.shuffle(before)
        r.shuffle(after)
        inner = "".join(before) + body + "".join(after)
        if r.random() < .3:
            inner = self.box("div", "wrapper|page|container|site", inner)
        return self.frame(inner + (self.footer() if r.random() < .8 else ""), 0)

    def frame(self, inner: str, label: int) -> str:
        """``label`` 1: the body itself is the article, plain or without any frame."""
        if label and self.r.random() < .6:
            kind = self.pick("section|div|bare|bare|text|text")
            return f'<{kind} data-y="1">{inner}</{kind}>' if kind in ("section", "div") else \
                WHOLE + (inner if kind == "bare" else self.pick("%s|%s|%s <b>x</b>.|<p>%s|<p>%s<p>x y|<div>%s</div>")
                         % (self.words(self.r.randint(1, 4)) if self.r.random() < .5 else self.prose(5)))
        head = f"<head data-y=\"0\"><meta charset='utf-8'><title>{self.words(4)}</title><style>p{{}}</style></head>"
        text = f'<!DOCTYPE html><html lang="en" data-y="0">{head}<body data-y="{label}">{inner}</body></html>'
        if self.r.random() < .08:
            text = text[:int(len(text) * self.r.uniform(.6, 1))]
        return text


def labelled_pages(n: int = PAGES, seed: int = 1) -> list[str]:
    """Pages with a ``data-y`` attribute that labels an element and what is inside it."""
    maker = _Maker(seed)
    return [maker.page() for _ in range(n)]


def fit(pages: int = PAGES) -> Model:
    return train([parse(x, labelled=True) for x in labelled_pages(pages)])


def extract(pages: DataFrame, model: Model, source: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text in place of ``source``; the other columns pass through."""
    names = [c for c in pages.columns if c not in (source, into)]
    schema = pages.select(*names).schema.add(into, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column(len(names)).to_pylist()
            texts: list[str] = []
            for at in range(0, len(sources), 200):
                parsed = [parse(x) for x in sources[at:at + 200]]
                texts += map(main_text, parsed, model.marginals(parsed))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), pa.array(texts, pa.string())], names=[*names, into])

    return pages.select(*names, source).mapInArrow(run, schema)
