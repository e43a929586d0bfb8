"""Main text of web pages: a graphical model on the tree of blocks.

Each block element is a node that is content or not. A node's own potential
comes from its tag, the words of its class and id, and the amount, links and
punctuation of its text; parent and child share a potential. Messages passed
from the leaves to the root and back (sum-product, exact on a tree) give each
node's probability of being content. Weights are learned by maximum likelihood
on labelled pages; their gradient uses the same messages. The labelled pages
are made by `labelled_pages`, which lays out articles and the usual things
around them in many ways and knows which nodes are which.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Their content is no text of the page.
SKIPPED = frozenset("script style noscript template title textarea select iframe object svg math canvas audio video button head".split())
RAW = frozenset("script style title textarea noscript iframe template xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag closes an open element of these kinds, up to the given boundary.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
TAGS = tuple("article main section div p h1 h2 h3 li ul ol table td blockquote pre figure header footer nav aside form body html dl".split())
GROUPS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar tabs skip toc",
    "head": "header masthead topbar branding logo sitehead",
    "foot": "footer foot bottom copyright legal colophon imprint",
    "side": "sidebar side aside rail widget widgets related recommended recommendations popular trending more",
    "note": "cookie cookies consent notice notices alert gdpr privacy popup modal overlay banner newsletter subscribe subscription signup paywall disclaimer warning message",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored sponsoring promo promotion promoted adsense teaser affiliate",
    "comment": "comment comments commentlist discussion discuss reply replies respond responses disqus reviews thread",
    "share": "share sharing social follow twitter facebook tags meta byline author",
    "form": "form login search searchbox register input contact poll",
    "content": "article content post entry story main body text maincontent articlebody postcontent page prose copy",
}
_GROUP_OF = {w: i for i, ws in enumerate(GROUPS.values()) for w in ws.split()}
N_FEATURES = len(TAGS) + len(GROUPS) + 13
_CONTENT = len(GROUPS) - 1
#: Groups and tags of what stands around articles.
_AROUND = frozenset(i for i, g in enumerate(GROUPS) if g not in ("content", "share"))
_AROUND_TAGS = frozenset("nav aside footer form dialog menu search".split())

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)([^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_CLOSE = {t: re.compile(rf"</{t}\s*(?:[\s/][^>]*)?(?:>|\Z)", re.I) for t in RAW}


class Page:
    """The tree of blocks: tag, names, parent of each node, parents first; runs of text in page order."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.names, self.hidden = ["html"], [-1], [()], [False]
        self.runs: list[tuple[int, str]] = []
        self.linked: list[int] = []  # characters inside links, by run
        self._build(source)

    def _build(self, s: str) -> None:
        stack, skip, links = [0], 0, 0
        parts: list[str] = []
        in_link = at = 0
        skipped: list[str] = []

        def flush() -> None:
            nonlocal in_link
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.runs.append((stack[-1], text))
                    self.linked.append(min(in_link, len(text)))
                parts.clear()
            in_link = 0

        def say(raw: str) -> None:
            nonlocal in_link
            if raw and not skipped:
                text = html.unescape(raw) if "&" in raw else raw
                parts.append(text)
                if links:
                    in_link += len(text)

        pos, n = 0, len(s)
        while pos < n:
            m = _MARK.search(s, pos)
            if m is None:
                say(s[pos:])
                break
            say(s[pos : m.start()])
            pos = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            name, end, attrs = name.lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
            if skipped:
                if end and name == skipped[-1]:
                    skipped.pop()
                elif not end and name == skipped[-1] and not attrs.endswith("/"):
                    skipped.append(name)
                elif name in ("body", "article", "main") and skipped[0] == "head":
                    skipped.clear()
                if skipped or end:
                    if not end and name in RAW and skipped:
                        c = _CLOSE[name].search(s, pos)
                        pos = c.end() if c else n
                        if skipped[-1] == name:
                            skipped.pop()
                    continue
            if end:
                if name == "a":
                    links = max(0, links - 1)
                elif name in BLOCKS:
                    flush()
                    links = 0
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[k]] == name:
                            del stack[k:]
                            break
                continue
            if name in VOID:
                if name == "br":
                    say(" ")
                elif name == "hr":
                    flush()
                continue
            if name in RAW:
                c = _CLOSE[name].search(s, pos)
                pos = c.end() if c else n
                continue
            if name in SKIPPED:
                if not attrs.endswith("/"):
                    skipped.append(name)
                continue
            if name == "a":
                links += 1
                continue
            if name not in BLOCKS:
                continue
            flush()
            links = 0
            if name == "html":
                continue
            if name in CLOSES:
                own, limit = CLOSES[name]
                for k in range(len(stack) - 1, 0, -1):
                    t = self.tag[stack[k]]
                    if t in limit:
                        break
                    if t in own:
                        del stack[k:]
                        if name in ("li", "dt", "dd", "td", "th", "tbody", "tfoot"):
                            break
            if self.tag[stack[-1]] == "p":
                stack.pop()
            found = [a or b or c for a, b, c in _NAMES.findall(attrs)] if attrs else ()
            groups = {_GROUP_OF[w] for x in found for part in _WORD.findall(x) if (w := part.lower()) in _GROUP_OF}
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.names.append(tuple(groups))
            self.hidden.append(bool(attrs) and bool(_HIDDEN.search(attrs)))
            stack.append(len(self.tag) - 1)
        flush()

    def features(self) -> np.ndarray:
        n = len(self.tag)
        chars, linked, marks, own = [0] * n, [0] * n, [0] * n, [0] * n
        for (node, text), k in zip(self.runs, self.linked, strict=True):
            chars[node] += len(text)
            own[node] += len(text)
            linked[node] += k
            marks[node] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
        depth = [0] * n
        around, within = [False] * n, [False] * n  # below a block of the one kind or the other, the nearest deciding
        for i in range(1, n):
            p, names = self.parent[i], self.names[i]
            depth[i] = depth[p] + 1
            odd = self.odd(i)
            box = self.tag[i] in ("article", "main") or _CONTENT in names
            around[i] = around[p] or odd
            within[i] = not odd and (within[p] or box and not around[i])
        boxed = any(within)
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            chars[p] += chars[i]
            linked[p] += linked[i]
            marks[p] += marks[i]
        x = np.zeros((n, N_FEATURES))
        base = len(TAGS) + len(GROUPS)
        total = max(1, chars[0])
        for i in range(n):
            t = _TAG_AT.get(self.tag[i])
            if t is not None:
                x[i, t] = 1
            for g in self.names[i]:
                x[i, len(TAGS) + g] = 1
            c = max(1, chars[i])
            x[i, base:] = (1, math.log1p(chars[i]) / 5, linked[i] / c, min(1.0, 20 * marks[i] / c), chars[i] / total, own[i] > 0, own[i] > 80, self.hidden[i], depth[i] > 1, within[i], around[i], not boxed and not around[i], not boxed and not around[i] and own[i] > 0)
        return x

    def odd(self, i: int) -> bool:
        """Whether a block's own tag or names speak of what stands around articles."""
        return self.tag[i] in _AROUND_TAGS or any(g in _AROUND for g in self.names[i])

    def content(self, model: tuple[np.ndarray, tuple]) -> list[float]:
        """Each node's probability of being content."""
        return marginals(self.parent, (self.features() @ model[0]).tolist(), model[1], self.kinds())[0]

    def kinds(self) -> list[int]:
        """The table of (parent, child) potentials that each node has with its parent: such blocks have one of their own."""
        return [int(self.odd(i)) for i in range(len(self.tag))]


_TAG_AT = {t: i for i, t in enumerate(TAGS)}


def marginals(parent: list[int], unary: list[float], pair: tuple, kinds: list[int] | None = None) -> tuple[list[float], float, list]:
    """Sum-product on a tree whose parents come first: probabilities of label 1, the log partition and edge beliefs (p00, p01, p10, p11).

    `unary`: log odds of label 1; `pair`: log potentials for (parent, child) as
    00, 01, 10, 11, four for each kind of child.
    """
    n = len(parent)
    tables = [tuple(map(math.exp, pair[k : k + 4])) for k in range(0, len(pair), 4)]
    kinds = kinds or [0] * n
    up0, up1 = [0.5] * n, [0.5] * n  # a node's own potential times the messages of its children, as a pair that sums to one
    logz = 0.0
    for i, u in enumerate(unary):
        z = math.exp(-abs(u))
        a, b = (1.0, z) if u < 0 else (z, 1.0)
        up0[i], up1[i] = a / (a + b), b / (a + b)
        logz += math.log(a + b) + max(0.0, u)
    m0, m1 = [1.0] * n, [1.0] * n
    for i in range(n - 1, -1, -1):
        s = up0[i] + up1[i]
        up0[i] /= s
        up1[i] /= s
        logz += math.log(s)
        p = parent[i]
        if p >= 0:
            t00, t01, t10, t11 = tables[kinds[i]]
            a, b = t00 * up0[i] + t01 * up1[i], t10 * up0[i] + t11 * up1[i]
            m0[i], m1[i] = a, b
            up0[p] *= a
            up1[p] *= b
            s = up0[p] + up1[p]
            if not 1e-100 < s < 1e100:
                up0[p] /= s
                up1[p] /= s
                logz += math.log(s)
    out, edges = [0.0] * n, [None] * n
    d0, d1 = [0.0] * n, [0.0] * n  # full beliefs
    d0[0], d1[0] = up0[0], up1[0]
    out[0] = up1[0]
    for i in range(1, n):
        p = parent[i]
        t00, t01, t10, t11 = tables[kinds[i]]
        a, b = d0[p] / m0[i], d1[p] / m1[i]  # the parent's belief without this child
        e00, e01, e10, e11 = a * t00 * up0[i], a * t01 * up1[i], b * t10 * up0[i], b * t11 * up1[i]
        s = e00 + e01 + e10 + e11
        e00, e01, e10, e11 = e00 / s, e01 / s, e10 / s, e11 / s
        edges[i] = (e00, e01, e10, e11)
        d0[i], d1[i] = e00 + e10, e01 + e11
        out[i] = min(1.0, d1[i])
    return out, logz, edges


def labelled_pages(count: int = 700, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Pages with a label for each block in page order; blocks of the article are marked by an attribute that is taken out again."""
    rng = random.Random(seed)
    syllables = "an be co da el fi go ha in jo ka le mi no or pa qui re sto tu un va we".split()

    def words(a: int, b: int) -> str:
        w = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(a, b))]
        for i in range(rng.randint(4, 9), len(w) - 1, rng.randint(6, 12)):
            w[i] += rng.choice([",", "."])
        return " ".join(w).capitalize()

    def sentence(a: int, b: int) -> str:
        return words(a, b) + rng.choice([".", ".", ".", "!", "?"])

    def links(k: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/x">{words(1, 4)}</a></{tag}>' for _ in range(k))

    def junk() -> str:
        pick = rng.choice
        return pick(
            [
                lambda: f"<nav{pick(['', ' class=menu', ' id=nav'])}><ul>{links(rng.randint(2, 8))}</ul></nav>",
                lambda: f'<div class="{pick(["menu", "main-menu", "breadcrumb", "navbar"])}"><ul>{links(rng.randint(2, 7))}</ul></div>',
                lambda: f"<header{pick(['', ' class=site-header'])}><div>{words(1, 4)}</div><p>{words(2, 9)}</p></header>",
                lambda: f"<footer{pick(['', ' id=footer'])}><p>&copy; {sentence(2, 14)}</p>{pick(['', '<ul>' + links(3) + '</ul>'])}</footer>",
                lambda: f"<footer>&copy; {words(1, 3)} &middot; {sentence(2, 14)}</footer>",
                lambda: f'<div class="{pick(["footer", "copyright", "legal"])}"><p>{sentence(4, 20)}</p></div>',
                lambda: f"<aside{pick(['', ' class=sidebar'])}><h3>{words(1, 3)}</h3><ul>{links(rng.randint(2, 6))}</ul><p>{sentence(3, 25)}</p></aside>",
                lambda: f'<div class="{pick(["sidebar", "related-posts", "widget", "right-rail"])}"><h3>{words(1, 3)}</h3><p>{sentence(4, 30)}</p></div>',
                lambda: f'<div class="{pick(["cookie-notice", "consent", "gdpr-banner", "notice", "newsletter-signup"])}"><p>{sentence(8, 40)} {sentence(3, 20)}</p></div>',
                lambda: f'<div {pick(["class", "id"])}="{pick(["ad", "ads", "advert", "sponsored", "promo-box", "ad-slot"])}">{pick(["", "<p>"])}{sentence(2, 40)}</div>',
                lambda: f"<form{pick(['', ' class=search'])}><p>{words(1, 5)} <input name=q></p><div>{words(1, 6)}</div></form>",
                lambda: f'<{(t := pick(["section", "div"]))} {pick(["class", "id"])}="{pick(["comments", "comment-list", "discussion", "replies"])}"><h2>{words(1, 2)}</h2>'
                + "".join(f'<div class="comment"><p>{sentence(3, 60)}</p></div>' for _ in range(rng.randint(1, 5)))
                + f"</{t}>",
                lambda: f'<div {pick(["hidden", "style=display:none", "class=skip hidden"])}><p>{sentence(3, 40)}</p></div>',
                lambda: f'<section id="{pick(["comments", "replies"])}"><article class="comment"><p>{sentence(3, 60)}</p></article></section>',
                lambda: f"<nav><p>{words(2, 12)}</p></nav>",
                lambda: f"<header><h1>{words(1, 5)}</h1>{pick(['', '<p>' + words(2, 8) + '</p>'])}</header>",
                lambda: f'<div class="{pick(["header", "masthead", "topbar"])}"><h1>{words(1, 4)}</h1><p>{sentence(2, 10)}</p></div>',
                lambda: f'<div class="{pick(["notice", "alert", "banner", "disclaimer", "message"])}">{sentence(2, 20)}</div>',
                lambda: f"<form><div>{words(1, 4)}</div><p>{sentence(2, 12)}</p></form>",
                lambda: f"<aside><p>{sentence(5, 60)}</p></aside>",
                lambda: f'<div class="{pick(["share", "social-links", "tags"])}">{links(3, "p")}</div>',
            ]
        )()

    def piece() -> str:
        pick = rng.choice
        roll = rng.random()
        if roll < 0.56:
            return f"<p +>{pick([sentence, sentence, words])(1, rng.choice([3, 12, 90]))}" + pick(["</p>", "</p>", ""])
        if roll < 0.65:
            return f"<p +><a href=/y>{words(2, 9)}</a></p>"
        if roll < 0.70:
            return f"<p +><b>{words(3, 12)}<br>"
        if roll < 0.80:
            return f"<h2 +>{words(1, 6)}</h2><p +>{sentence(10, 60)}</p>"
        if roll < 0.86:
            return "<ul +>" + "".join(f"<li +>{sentence(2, 15)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if roll < 0.90:
            return f"<blockquote +><p +>{sentence(6, 40)}</p></blockquote>"
        if roll < 0.93:
            return "<table +><tr +>" + "".join(f"<td +>{words(1, 4)}</td>" for _ in range(3)) + "</tr></table>"
        if roll < 0.96:
            return f"<figure +><figcaption +>{sentence(3, 12)}</figcaption></figure>"
        return f"<pre +>{words(3, 30)}</pre>"

    def article() -> str:
        inner = []
        if rng.random() < 0.8:
            h = f"<h1 +>{words(2, 12)}</h1>"
            inner.append(f"<header +>{h}</header>" if rng.random() < 0.15 else h)
        inner += [piece() for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 14]))]
        for _ in range(rng.choice([0, 0, 0, 1, 2, 4])):
            j = junk()
            if "<header" not in j and "<h1" not in j:  # an article's own header is part of it
                inner.insert(rng.randint(1, len(inner)), j)
        body = "".join(inner)
        box = rng.random()
        if box < 0.45:
            return f"<article +>{body}</article>"
        if box < 0.55:
            return f"<main +>{body}</main>"
        if box < 0.65:
            return f"<main><article +>{body}</article></main>"
        if box < 0.70:
            return f"<div><div +>{body}</div></div>"
        if box < 0.90:
            return f'<div {rng.choice(["class", "id"])}="{rng.choice(["content", "post", "entry-content", "story-body", "article-text", "main-content"])}" +>{body}</div>'
        return body

    out = []
    for _ in range(count):
        before, after = [junk() for _ in range(rng.randint(0, 4))], [junk() for _ in range(rng.randint(0, 4))]
        body = "".join(before) + article() + "".join(after)
        if rng.random() < 0.3:
            body = f'<div {rng.choice(["class", "id"])}="{rng.choice(["wrapper", "container", "layout", "page"])}">{body}</div>'
        marked = f"<html><head><title>{words(2, 8)}</title></head><body>{body}</body></html>"
        tree = Page(marked.replace(" +>", ' data-in="1">'))
        labels, blocks = [0], iter(re.findall(r"<([a-z0-9]+)([^>]*)>", marked[marked.index("<body>") :]))
        for tag, attrs in blocks:
            if tag in BLOCKS:
                labels.append(int(attrs.endswith("+")))
        if len(labels) == len(tree.tag):
            out.append((marked.replace(" +>", ">"), labels))
    return out


@lru_cache(maxsize=1)
def train(epochs: int = 25, seed: int = 3) -> tuple[np.ndarray, tuple]:
    """Weights of the nodes and log potentials of (parent, child), by stochastic gradient of the likelihood of labelled pages."""
    data = []
    for source, labels in labelled_pages():
        page = Page(source)
        data.append((page.parent, page.features(), np.array(labels), page.kinds()))
    rng = np.random.default_rng(seed)
    w, pair = np.zeros(N_FEATURES), np.zeros(8)
    sw, sp = np.full(N_FEATURES, 1e-3), np.full(8, 1e-3)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            parent, x, y, kinds = data[k]
            p, _, edges = marginals(parent, (x @ w).tolist(), tuple(pair), kinds)
            gw = x.T @ (y - np.array(p)) - 0.002 * w
            gp = -0.002 * pair
            for i in range(1, len(parent)):
                at = 4 * kinds[i]
                gp[at + 2 * y[parent[i]] + y[i]] += 1
                gp[at : at + 4] -= edges[i]
            sw += gw**2
            sp += gp**2
            w += 0.5 * gw / np.sqrt(sw)
            pair += 0.5 * gp / np.sqrt(sp)
    return w, tuple(pair.tolist())


def main_text(source: str | None, model: tuple[np.ndarray, tuple]) -> str:
    """The text of the runs whose block is content with a probability of a half or more, joined by blanks."""
    if not source:
        return ""
    page = Page(source)
    if not page.runs:
        return ""
    p = page.content(model)
    return " ".join(text for node, text in page.runs if p[node] >= 0.5)


def extract(pages: DataFrame, model: tuple[np.ndarray, tuple] | None = None, html_col: str = "html") -> DataFrame:
    """`pages` without `html_col`, plus text and n_chars (code points), which replace earlier columns of these names. Null and empty pages have an empty text. No other column passes through Python."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())

    @F.arrow_udf("string")
    def extracted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = shared.value
        for column in batches:
            yield pa.array([main_text(s, weights) for s in column.to_pylist()], pa.string())

    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    read = pages.select(*[F.col(f"`{c}`") for c in keep], extracted(pages[html_col].cast("string")).alias("text"))
    return read.withColumn("n_chars", F.char_length("text").cast("long"))
