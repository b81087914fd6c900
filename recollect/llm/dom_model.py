"""Main text of HTML pages by a tree-structured graphical model.

A page becomes a tree of its block elements, with a leaf for each run of text between block borders. Each
node is content or not. A node's potential is log-linear in its tag, the words of its class, id and role, and
for leaves in the text's size, links and signs. Each parent-child pair has a potential for its kind: what the
child's own tag and names speak of (furniture, an article, nothing; or it is a text), and whether the parent is the
page's frame; so a form or comments inside an article needn't pull the article along. Sum-product
messages go up and down the tree, exact as it is a tree, and give each leaf's marginal; the leaves of one half
or more are the page's text. Potentials are fitted to labelled pages by the gradient of their
likelihood, which the same messages give.

The labelled pages are made here (``labelled_pages``): layouts of many kinds whose elements carry their label,
parsed like any page.

Defined results: null, empty and text-free pages give empty text; unclosed, misnested and cut-off markup is
taken as far as it goes, an element whose insides are no text hides the rest of the page only if browsers do so too;
character references are decoded, also those without a semicolon that HTML knows. Pages are read whole, whatever
their length. A marginal of exactly one half is content. Repeated rows and null ids are kept, a row each; a kept
column named ``text`` or ``n_chars`` gets a ``_`` before its name.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre section select summary svg table tbody td template textarea tfoot th thead title tr ul video audio canvas xmp".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe svg".split())
#: Of these the end must be there, else only the tag is skipped.
CLOSED = frozenset("svg iframe template".split())
#: An opening tag that ends these open ones, within the nearest of the second set.
_LIST, _TABLE = frozenset(("ul", "ol", "menu", "dir")), frozenset(("table",))
ENDS = {"li": (frozenset(("li",)), _LIST), "dt": (frozenset(("dt", "dd")), frozenset(("dl",))), "dd": (frozenset(("dt", "dd")), frozenset(("dl",))), "tr": (frozenset(("tr", "td", "th")), _TABLE), "td": (frozenset(("td", "th")), _TABLE | {"tr"}), "th": (frozenset(("td", "th")), _TABLE | {"tr"}), "option": (frozenset(("option",)), frozenset(("select",)))}
_P = frozenset(("p",))
_P_STOPS = frozenset(("button", "td", "th", "caption", "table", "object", "html", "body"))
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|data-y)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")
DEEPEST = 512
#: Begins a labelled page without a frame.
ALL = "<!--1-->"

KEYS = (
    "ad ads advert advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login form search nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead top footer bottom copyright legal sidebar side aside widget rail related recommended trending popular tags share social comment comments reply replies respond discussion disqus reader byline meta author toolbar skip hidden "
    "content article post entry story main body text page blog news markdown prose paragraph"
).split()
TAGS = sorted(BLOCKS)
_TAG_NO, _KEY_NO = {t: i for i, t in enumerate(TAGS)}, {k: len(TAGS) + 1 + i for i, k in enumerate(KEYS)}
_LEAF = len(TAGS) + 1 + len(KEYS)
WIDTH = _LEAF + 16
#: Names and tags that speak of furniture, and of an article.
_GOOD = frozenset("content article post entry story main body text page blog news markdown prose paragraph".split())
_FURNITURE = frozenset([_KEY_NO[k] for k in KEYS if k not in _GOOD] + [_TAG_NO[t] for t in "aside button dialog fieldset footer form header legend menu nav noscript optgroup option select textarea".split()])
_ARTICLE = frozenset([_KEY_NO[k] for k in _GOOD] + [_TAG_NO[t] for t in ("article", "main")])
_PLAIN = frozenset(_TAG_NO[t] for t in "div section p li ul ol dl dd dt table tbody tr td th blockquote center".split())
#: What holds a whole page: its children's labels tell little of its own. Kinds of pairs: the child is a plain element, a text, furniture or an article; each below a frame or not.
_FRAME, KINDS = {_TAG_NO["html"], _TAG_NO["body"], len(TAGS)}, 8


@dataclass
class Forest:
    """Trees of pages, one after the other; parents come before their children."""

    parent: list[int] = field(default_factory=list)
    leaf: list[bool] = field(default_factory=list)
    features: list[list[int]] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    page: list[int] = field(default_factory=list)

    def node(self, page: int, parent: int, leaf: bool, features: list[int], label: int, text: str = "") -> int:
        for values, x in ((self.page, page), (self.parent, parent), (self.leaf, leaf), (self.features, features), (self.label, label), (self.text, text)):
            values.append(x)
        return len(self.parent) - 1

    def add(self, page: int, source: str, labelled: bool = False) -> None:
        """Parses one page; elements nested deeper than ``DEEPEST`` stand beside each other there, but for plain ones, whose text is the outer one's."""
        root = self.node(page, -1, False, [len(TAGS)], int(labelled and source.startswith(ALL)))
        stack = [("", root, root)]  # tag, its node or the nearest block's, and the block
        open_ = Counter()
        run, links, in_link = [], 0, 0

        def close_run():
            nonlocal run, links
            if run:
                text = " ".join(entities.unescape("".join(run)).split())
                if text:
                    block = stack[-1][2]
                    self.node(page, block, True, _leaf(text, links), self.label[block], text)
                run, links = [], 0

        def pop_to(depth: int):
            nonlocal in_link
            while len(stack) > depth:
                tag = stack[-1][0]
                if tag in BLOCKS:
                    close_run()
                in_link -= tag == "a"
                open_[tag] -= 1
                stack.pop()

        def end_open(ends, stops):
            if not any(open_[t] for t in ends):
                return
            for d in range(len(stack) - 1, 0, -1):
                if stack[d][0] in stops:
                    return
                if stack[d][0] in ends:
                    pop_to(d)
                    return

        at = 0
        while at < len(source):
            m = _TAG.search(source, at)
            piece = source[at : m.start()] if m else source[at:]
            if piece:
                run.append(piece)
                links += len(piece) if in_link else 0
            if m is None:
                break
            at = m.end()
            close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if close:
                for d in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                    if stack[d][0] == tag:
                        pop_to(d)
                        break
                continue
            if tag == "br":
                run.append(" ")
                continue
            if tag in ENDS:
                end_open(*ENDS[tag])
            if tag in BLOCKS:
                if tag not in ("option", "optgroup"):
                    end_open(_P, _P_STOPS)
                close_run()
            if tag in VOID or attributes.endswith("/") and tag in ("svg", "iframe"):
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else at if tag in CLOSED else len(source)
                continue
            block = stack[-1][2]
            if tag in BLOCKS:
                f, label = _element(tag, attributes, self.label[block], labelled)
                if len(stack) < DEEPEST or len(f) > 1 or not _PLAIN.issuperset(f):
                    block = self.node(page, stack[min(len(stack), DEEPEST) - 1][2], False, f, label)
            in_link += tag == "a"
            open_[tag] += 1
            stack.append((tag, block, block))
        pop_to(1)
        close_run()


def _element(tag: str, attributes: str, label: int, labelled: bool) -> tuple[list[int], int]:
    f = [_TAG_NO[tag]]
    if attributes:
        for m in _ATTR.finditer(attributes):
            value = m[2].strip("\"'")
            if m[1].lower() == "data-y":
                label = int(value) if labelled else label
                continue
            f += [_KEY_NO[w] for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()) if w in _KEY_NO]
    return f, label


def _leaf(text: str, links: int) -> list[int]:
    words, f = text.count(" ") + 1, []
    f.append(0 if words < 4 else 1 if words < 9 else 2 if words < 20 else 3 if words < 60 else 4)
    share = links / max(1, len(text))
    f.append(5 if share < 0.05 else 6 if share < 0.5 else 7)
    f.append(8 if text[-1] in ".!?:;\"'”»)" else 9)
    if "©" in text or "·" in text:
        f.append(10)
    if text.count(",") * 12 >= words:
        f.append(11)
    return [_LEAF + x for x in f]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class Messages:
    """Sum-product over a forest: levels by depth, all pages at once."""

    def __init__(self, forest: Forest):
        self.parent = np.array(forest.parent, np.int64)
        n = len(self.parent)
        framed = np.array([f[0] in _FRAME if f else False for f in forest.features], bool)
        own = np.array([1 if leaf else 2 if _FURNITURE.intersection(f) else 3 if _ARTICLE.intersection(f) else 0 for leaf, f in zip(forest.leaf, forest.features)], np.int64)
        self.kind = own + 4 * (framed[self.parent] & (self.parent >= 0)) if n else own
        size = np.array([len(f) for f in forest.features], np.int64)
        self.rows, self.columns = np.repeat(np.arange(n), size), np.array([x for f in forest.features for x in f], np.int64)
        depth = np.zeros(n, np.int64)
        for i, p in enumerate(forest.parent):
            if p >= 0:
                depth[i] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(depth.max(initial=0) + 2))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])][1:]

    def run(self, w: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals [nodes, 2], and of each node's pair with its parent [nodes, parent label, label]."""
        n = len(self.parent)
        own = np.zeros((n, 2))
        own[:, 1] = np.bincount(self.rows, weights=w[self.columns], minlength=n)
        up, to_parent = own.copy(), np.zeros((n, 2))
        for level in reversed(self.levels):
            m = _log_sum(pair[self.kind[level]] + up[level][:, None, :], 2)
            to_parent[level] = m
            for k in (0, 1):
                up[:, k] += np.bincount(self.parent[level], weights=m[:, k], minlength=n)
        down = np.zeros((n, 2))
        joint = np.zeros((n, 2, 2))
        for level in self.levels:
            p = self.parent[level]
            rest = (up[p] - to_parent[level] + down[p])[:, :, None] + pair[self.kind[level]]
            down[level] = _log_sum(rest, 1)
            j = rest + up[level][:, None, :]
            j -= _log_sum(j.reshape(len(level), 4), 1)[:, None, None]
            joint[level] = np.exp(j)
        belief = up + down
        belief -= _log_sum(belief, 1)[:, None]
        return np.exp(belief), joint


def fit(pages: list[str], steps: int = 200, l2: float = 0.003) -> tuple[np.ndarray, np.ndarray]:
    """Potentials that maximise the likelihood of labelled pages (elements with ``data-y``)."""
    forest = Forest()
    for i, p in enumerate(pages):
        forest.add(i, p, True)
    messages, y = Messages(forest), np.array(forest.label)
    below = messages.parent >= 0
    seen = np.zeros((KINDS, 2, 2))
    np.add.at(seen, (messages.kind[below], y[messages.parent[below]], y[below]), 1)
    x = np.zeros(WIDTH + 4 * KINDS)
    m, v = np.zeros_like(x), np.zeros_like(x)
    weight = np.full(len(x), l2)
    weight[_LEAF:WIDTH] *= 30  # what a text looks like tells less than where it stands
    for t in range(1, steps + 1):
        p, joint = messages.run(x[:WIDTH], x[WIDTH:].reshape(KINDS, 2, 2))
        g = np.bincount(messages.columns, weights=(y - p[:, 1])[messages.rows], minlength=WIDTH)
        expected = np.zeros((KINDS, 2, 2))
        np.add.at(expected, messages.kind[below], joint[below])
        g = np.concatenate([g, (seen - expected).ravel()]) / len(pages) - weight * x
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x + 0.15 * min(1, 2 - 2 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x[:WIDTH], x[WIDTH:].reshape(KINDS, 2, 2)


def labelled_pages(count: int = 400, seed: int = 1) -> list[str]:
    """Pages of many layouts; ``data-y`` gives an element's label, which its descendants share up to the next one."""
    r = random.Random(seed)

    def words(a: int, b: int) -> str:
        out = ["".join(r.choice("bdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(a, b))]
        return " ".join(w + r.choice(("", "", "", "", ",")) for w in out)

    def sentence(a: int = 5, b: int = 40) -> str:
        kind = r.random()
        if kind < 0.04:
            return " ".join([words(1, 1).rstrip(",")] * r.randint(2, 60))
        if kind < 0.08:
            return words(a, b).upper()
        if kind < 0.12:
            return " ".join(w + r.choice(("###", "%%%", "$$$", " |", "!!")) for w in words(a, b).split())
        if kind < 0.15:
            return words(1, 3)
        return words(a, b).rstrip(",").capitalize() + r.choice((".", ".", ".", "!", "?", ""))

    def attr(*names: str) -> str:
        name = r.choice(names)
        return r.choice(("", f' class="{name}"', f' class="{name}"', f" id='{name}'", f' class="box {name} x1"', f" class={name.split()[0]}"))

    def named(*names: str) -> str:
        name = r.choice(names)
        return r.choice((f' class="{name}"', f' id="{name}"', f' class="box {name}"', f" class={name.split()[0]}"))

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 3)}</a>' + r.choice(("</li>", "")) for i in range(n))

    def paragraph() -> str:
        kind = r.random()
        if kind < 0.06:
            return "<ul>" + "".join(f"<li>{sentence(2, 20)}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
        if kind < 0.1:
            return f"<blockquote><p>{sentence()}</p></blockquote>"
        if kind < 0.13:
            return f"<pre>{words(3, 20)}</pre>"
        if kind < 0.16:
            return "<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 4)}</td></tr>" for _ in range(3)) + "</table>"
        if kind < 0.19:
            return f"<figure><img src=x><figcaption>{sentence(2, 12)}</figcaption></figure>"
        if kind < 0.27:
            return f"<h{r.randint(2, 4)}>{words(1, 7)}</h{r.randint(2, 4)}>"
        if kind < 0.33:
            return f"<p><b>{words(2, 30)}<br>"
        text = " ".join(sentence(1, 30) for _ in range(r.choice((1, 1, 1, 2, 3, 6, 9))))
        if r.random() < 0.2:
            text += f' <a href="/y">{words(1, 4)}</a> {words(1, 6)}'
        return f"<p{attr('lead', 'text', 'p1')}>{text}" + r.choice(("</p>", "</p>", "</p>", ""))

    def noise(inside: bool = False) -> str:
        line = sentence(3, 25)
        some = [
            lambda: f"<div{named('ad', 'ads', 'advert', 'ad-slot', 'sponsored', 'banner', 'promo', 'advertisement')} data-y=0>{line}</div>",
            lambda: f"<aside{attr('sidebar', 'related', 'widget')} data-y=0><h3>{words(1, 3)}</h3><p>{line}</p><ul>{links(3)}</ul></aside>",
            lambda: f"<div{named('share', 'social-links', 'related', 'recommended', 'tags', 'newsletter signup', 'popular')} data-y=0><h4>{words(1, 3)}</h4><ul>{links(4)}</ul><p>{line}</p></div>",
            lambda: f"<form{attr('newsletter', 'search', 'subscribe')} data-y=0><label>{words(1, 4)}</label><input name=q><select><option>{words(1, 2)}<option>{words(1, 2)}</select><p>{line}</p><button>{words(1, 2)}</button></form>",
        ]
        if not inside:
            some += [
                lambda: f"<div{named('cookie-banner', 'consent', 'notice', 'cookie notice', 'gdpr', 'alert', 'popup')} data-y=0><p>{line}</p><button>{words(1, 2)}</button></div>",
                lambda: f"<div{named('sidebar', 'side', 'widget', 'rail')} data-y=0><h3>{words(1, 4)}</h3><p>{sentence()}</p><ul>{links(5)}</ul></div>",
                lambda: f"<nav{attr('breadcrumbs', 'menu')} data-y=0><ul>{links(r.randint(1, 7))}</ul></nav>",
            ]
        found = r.choice(some)()
        if r.random() < 0.1:
            n = r.choice((1, 2, 6, 12, 30))
            found = found.replace(line, "<div>" * n + line + "</div>" * n)
        return found

    def comments() -> str:
        tag = r.choice(("section", "div", "ol"))
        one = lambda: f"<{'li' if tag == 'ol' else 'div'}{named('comment', 'reply', 'comment-body')}><p>{' '.join(sentence() for _ in range(r.randint(1, 4)))}</p></{'li' if tag == 'ol' else 'div'}>"
        return f"<{tag}{named('comments', 'comment-list', 'discussion', 'reader-comments', 'disqus_thread', 'responses comments')} data-y=0>{'' if tag == 'ol' else '<h3>' + words(1, 3) + '</h3>'}{''.join(one() for _ in range(r.randint(1, 4)))}</{tag}>"

    pages = []
    for i in range(count):
        if r.random() < 0.06:
            pages.append(ALL + "".join(paragraph() if r.random() < 0.8 else sentence() for _ in range(r.choice((1, 1, 2, 3)))))
            continue
        title = words(2, 12)
        parts = [f"<h1>{title}</h1>"] if r.random() < 0.85 else []
        if r.random() < 0.1:
            parts = [f"<header>{''.join(parts)}</header>"]
        for _ in range(r.choice((0, 1, 1, 2, 3, 5, 8, 12))):
            parts.append(paragraph())
            if r.random() < 0.15:
                parts.append(noise(True))
        if r.random() < 0.15:
            parts.append(comments())
        if r.random() < 0.15:
            at, n = r.randint(0, len(parts)), r.choice((1, 2, 3, 6, 12, 30))
            parts[at:] = ["<div>" * n + "".join(parts[at:]) + "</div>" * n] if at < len(parts) else []
        kind, frame = r.random(), ""
        if kind < 0.14:
            frame = " data-y=1"
            body = "".join(sentence() if r.random() < 0.1 else x for x in parts) or f"<p>{sentence()}</p>"
        elif kind < 0.22:
            body = f"<{(t := r.choice(('div', 'div', 'section')))} data-y=1>{''.join(parts)}</{t}>"
        elif kind < 0.5:
            body = f"<article{attr('post', 'story', 'entry')} data-y=1>{''.join(parts)}</article>"
        elif kind < 0.65:
            body = f"<main{attr('content', 'main')} data-y=1>{''.join(parts)}</main>"
        elif kind < 0.75:
            body = f"<main data-y=1><article>{''.join(parts)}</article></main>"
        else:
            body = f"<{(t := r.choice(('div', 'div', 'section')))}{named('content', 'post-content', 'entry-content', 'article-body', 'story', 'main-content', 'article', 'post', 'page-content', 'markdown-body')} data-y=1>{''.join(parts)}</{t}>"
        before, after = [], []
        if r.random() < 0.5:
            before.append(f"<header{attr('site-header', 'masthead', 'top')} data-y=0><a href=/>{words(1, 4)}</a><p>{words(1, 8)}</p>{'<nav><ul>' + links(5) + '</ul></nav>' if r.random() < 0.5 else ''}</header>")
        elif r.random() < 0.4:
            before.append(f"<div{named('header', 'top', 'masthead', 'site-header')} data-y=0><a href=/>{words(1, 4)}</a><p>{words(1, 8)}</p></div>")
        if r.random() < 0.75:
            before.append(f"<nav{attr('navbar', 'menu')} data-y=0><ul>{links(r.randint(1, 7))}</ul></nav>")
        for _ in range(r.choice((0, 1, 1, 2))):
            before.append("<!-- x -->" + noise())
        for _ in range(r.choice((0, 0, 1, 2))):
            after.append(noise())
        if r.random() < 0.35:
            after.append(comments())
        if r.random() < 0.85:
            tag = r.choice(("footer", "footer", "footer", "div"))
            after.append(f"<{tag}{attr('footer') if tag == 'footer' else named('footer', 'bottom', 'site-footer')} data-y=0>{r.choice(('&copy; ', '', ''))}{words(1, 4)} {r.choice(('&middot; ', ''))}{sentence(2, 20)}</{tag}>")
        if frame and r.random() < 0.4:
            before, after = [], []
            if r.random() < 0.5:
                pages.append(f"<div data-y=1>{body}</div>" if r.random() < 0.3 else f"{ALL}{body}")
                continue
        inner = "".join(before) + body + "".join(after)
        if r.random() < 0.3:
            inner = f"<div{attr('wrapper', 'container', 'page')}{frame}>{inner}</div>"
        pages.append(f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body{frame}>{inner}" + r.choice(("</body></html>", "")))
    return pages


@lru_cache(maxsize=1)
def _fitted() -> tuple[np.ndarray, np.ndarray]:
    return fit(labelled_pages())


def texts(pages: list[str | None], model) -> list[str]:
    """Main text of each page."""
    forest = Forest()
    for i, p in enumerate(pages):
        forest.add(i, p or "")
    out: list[list[str]] = [[] for _ in pages]
    if pages:
        belief, _ = Messages(forest).run(*model)
        for k in np.flatnonzero((belief[:, 1] >= 0.5) & np.array(forest.leaf, bool)).tolist():
            out[forest.page[k]].append(forest.text[k])
    return ["\n".join(x) for x in out]


def _extract(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                found = texts(part.column(part.num_columns - 1).to_pylist(), model.value)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=[*part.schema.names[:-1], "text", "n_chars"])

    return run


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``text, n_chars`` of each row, after the columns ``keep``."""
    small_batches(pages.sparkSession)
    model = pages.sparkSession.sparkContext.broadcast(_fitted())
    rows = pages.select(*(F.col(c).alias(f"_{c}" if c in ("text", "n_chars") else c) for c in keep), F.col(html_col))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", text string, n_chars long"
    return rows.mapInArrow(_extract(model), schema)
