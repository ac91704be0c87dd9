"""Main text of web pages by a linear-chain conditional random field.

A page becomes the sequence of its DOM's leaf blocks (text between block-level
tag boundaries).  Features of a block are its ancestors' tags, the words of
their classes and ids, and properties of the text (length, share of link text,
punctuation, stock phrases, place).  Two labels, main text or not, form a
chain; weights are fitted by maximum likelihood (forward-backward, AdaGrad) on
labelled pages and pages are decoded by Viterbi, one by one where they are
read: nothing is shuffled.

Labelled pages: a bounded sample (SAMPLE pages, by hash of the page) of those
whose markup names its main part itself (article or main elements).  Each is
used as it is and, with the labels kept, re-dressed in other markup (division
classes for elements, more kinds of page furniture), so that the model does
not rest on the element that gave the label.
"""

from __future__ import annotations

import html
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitlake.llm.base import for_python, query, read

#: Labelled pages for training, passes over them, and dressings of each.
SAMPLE, PASSES, DRESSINGS = 200, 6, 4

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_CLASS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Fixed values of HTML: elements without content, with raw content, whose content is not text of the page, inside a line,
# start tags that end an open svg.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
HIDDEN = frozenset("noscript template svg object select button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta "
                     "nobr ol p pre ruby s small span strike strong sub sup table tt u ul var article section main header "
                     "footer nav aside form figure".split())
_LINKS = frozenset({"a"})


def blocks(page: str | None) -> list[tuple[tuple, str, int]]:
    """The leaf blocks of a page in order: (ancestors, text, characters in
    links).  An ancestor is (tag, words of class, id and role).  Character
    references are decoded, white space becomes single spaces.

    An element of RAW holds no tags and ends at its end tag, or with the page.
    One of HIDDEN may hold others; its blocks are dropped at its own end tag.
    Without one it ends with its parent and what it holds is text of the page;
    an svg ends at the first start tag of BREAKOUT.
    """
    out: list[tuple[tuple, str, int]] = []
    if not page:
        return out
    stack: list[tuple] = []
    parts: list[str] = []
    hidden: list[tuple[int, int, int]] = []  # open ones: place on the stack, blocks and links before
    links = link_chars = 0
    pos = 0

    def flush():
        nonlocal link_chars
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((tuple(a for a in stack if a[0] not in HIDDEN) if hidden else tuple(stack), text, link_chars))
            parts.clear()
        link_chars = 0

    def leave(i: int, drop: bool) -> None:
        """Closes the stack from place i on; drops what the hidden element
        there holds."""
        nonlocal links
        del stack[i:]
        while hidden and hidden[-1][0] >= i:
            at, blocks_before, links_before = hidden.pop()
            if drop and at == i:
                del out[blocks_before:]
                links = links_before

    def words(raw: str) -> None:
        nonlocal link_chars
        t = html.unescape(raw) if "&" in raw else raw
        parts.append(t)
        if links:
            link_chars += len(t)

    while True:
        m = _TAG.search(page, pos)
        if m is None:
            if pos < len(page):
                words(page[pos:])
            break
        if m.start() > pos:
            words(page[pos:m.start()])
        pos = m.end()
        name = m[2] or m[5]
        if name is None:
            if page.startswith("<![CDATA[", m.start()):
                words(m[0][9:].removesuffix("]]>"))
            continue
        name, closing, attrs = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if hidden and not closing and name in BREAKOUT and stack[hidden[-1][0]][0] == "svg" and not any(
                t == "foreignobject" for t, _ in stack[hidden[-1][0]:]):
            flush()
            leave(hidden[-1][0], True)
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            elif name in _LINKS:
                links = max(0, links - 1) if closing else links + 1
            continue
        if name in RAW and not closing:
            flush()
            if not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, pos)
                pos = end.end() if end else len(page)
            continue
        flush()
        if name in HIDDEN and not closing:
            if not attrs.endswith("/"):
                hidden.append((len(stack), len(out), links))
                stack.append((name, ()))
            continue
        if not (closing and name in HIDDEN):
            links = 0
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    leave(i, name in HIDDEN)
                    break
                if name == "p" and stack[i][0] in HIDDEN and stack[i][0] != "svg":
                    break
        elif name not in VOID and not attrs.endswith("/"):
            if stack and stack[-1][0] == "p":
                stack.pop()
            elif name == "li" and stack and stack[-1][0] == "li":
                stack.pop()
            found = "".join(" " + (a or b or c) for a, b, c in _CLASS.findall(attrs)) if "=" in attrs else ""
            stack.append((name, tuple(x.lower() for x in _PART.findall(found))))
    flush()
    return out


# Words of classes and ids, by what they usually mean.
_MEANS = {w: k for k, ws in {
    "furniture": "ad ads advert advertisement adverts banner bottom breadcrumb breadcrumbs cookie cookies consent copyright "
                 "dialog disclaimer footer form gdpr header login masthead menu modal nav navbar navigation newsletter "
                 "notice notices notification pagination popup popular promo recommended related search share sharing "
                 "sidebar signup social sponsor sponsored subscribe tags toolbar top widget widgets alert aside",
    "comments": "comment comments commenter disqus discussion replies reply responses respond",
    "main": "article body content entry main post story text page single",
}.items() for w in ws.split()}
_STOCK = re.compile(r"cookie|subscri|newsletter|sign up|log ?in|privacy|all rights reserved|copyright|©|advert|sponsored"
                    r"|read more|share this|related|comments?\b|repl(?:y|ies)\b|click here|terms of|accept", re.I)


def features(page_blocks) -> list[list[str]]:
    """The feature names of each block."""
    out = []
    n = len(page_blocks)
    for k, (above, text, link_chars) in enumerate(page_blocks):
        f = ["bias"]
        tags = {t for t, _ in above}
        f += ["in:" + t for t in tags if t not in ("html", "body", "div", "header")]
        if "header" in tags:  # a page's own or that of its main part
            before = above[:[t for t, _ in above].index("header")]
            f.append("header:" + ("inner" if any(
                t in ("article", "main", "section") or any(_MEANS.get(w) == "main" for w in ws) for t, ws in before) else "page"))
        f.append("tag:" + (above[-1][0] if above else "none"))
        means = {_MEANS[w] for _, ws in above for w in ws if w in _MEANS}
        f += ["class:" + w for w in means]
        if "furniture" in means and "main" in means:  # whichever is nearer
            f.append("near:" + next(_MEANS[w] for _, ws in reversed(above) for w in ws if w in _MEANS))
        size = len(text)
        f.append(f"size:{min(8, int(math.log2(size + 1)))}")
        f.append(f"links:{min(4, int(5 * link_chars / size)) if link_chars else 'none'}")
        f.append("end:" + ("stop" if text[-1] in ".!?…\"'”»)" else "other"))
        if _STOCK.search(text):
            f.append("stock" if size < 200 else "stock:long")
        f.append("at:" + ("first" if k == 0 else "last" if k == n - 1 else "within"))
        out.append(f)
    return out


class Chain:
    """Weights of the chain: a pair for each feature, and the transitions."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.w = np.zeros((0, 2))
        self.t = np.zeros((3, 2))  # from label 0, from label 1, from the start

    def _emission(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.w[r].sum(axis=0) for r in rows])

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], passes: int, rate: float = 0.3, decay: float = 1e-4):
        for fs, _ in pages:
            for f in fs:
                for x in f:
                    self.index.setdefault(x, len(self.index))
        self.w = np.zeros((len(self.index), 2))
        data = [([np.array([self.index[x] for x in f]) for f in fs], np.array(y)) for fs, y in pages if fs]
        gw, gt = np.full_like(self.w, 1e-6), np.full_like(self.t, 1e-6)
        order = random.Random(1)
        for _ in range(passes):
            order.shuffle(data)
            for rows, y in data:
                e, n = self._emission(rows), len(rows)
                a, b = np.zeros((n, 2)), np.zeros((n, 2))
                a[0] = e[0] + self.t[2]
                for i in range(1, n):
                    a[i] = e[i] + np.logaddexp(a[i - 1, 0] + self.t[0], a[i - 1, 1] + self.t[1])
                for i in range(n - 2, -1, -1):
                    x = e[i + 1] + b[i + 1]
                    b[i] = np.logaddexp(self.t[:2, 0] + x[0], self.t[:2, 1] + x[1])
                z = np.logaddexp(*a[-1])
                node = np.exp(a + b - z)
                dt = np.zeros((3, 2))
                if n > 1:
                    pair = np.exp(a[:-1, :, None] + self.t[None, :2] + (e[1:] + b[1:])[:, None, :] - z)
                    dt[:2] -= pair.sum(axis=0)
                    np.add.at(dt, (y[:-1], y[1:]), 1.0)
                dt[2] -= node[0]
                dt[2, y[0]] += 1.0
                miss = -node
                miss[np.arange(n), y] += 1.0
                dw = np.zeros_like(self.w)
                np.add.at(dw, np.concatenate(rows), np.repeat(miss, [len(r) for r in rows], axis=0))
                dw -= decay * self.w
                gw += dw * dw
                gt += dt * dt
                self.w += rate * dw / np.sqrt(gw)
                self.t += rate * dt / np.sqrt(gt)
        return self

    def tables(self):
        """What decoding needs, as plain numbers: score of label 1 less that
        of label 0 for each feature, and the transitions."""
        return {x: float(self.w[i, 1] - self.w[i, 0]) for x, i in self.index.items()}, self.t.tolist()


def decode(fs: list[list[str]], weight: dict[str, float], t) -> list[int]:
    """The likeliest labels of a page's blocks (Viterbi)."""
    if not fs:
        return []
    back = []
    e = sum(weight.get(x, 0.0) for x in fs[0])
    s0, s1 = t[2][0], t[2][1] + e
    for f in fs[1:]:
        e = sum(weight.get(x, 0.0) for x in f)
        b0, b1 = s1 + t[1][0] > s0 + t[0][0], s1 + t[1][1] > s0 + t[0][1]
        s0, s1 = (s1 + t[1][0] if b0 else s0 + t[0][0]), (s1 + t[1][1] if b1 else s0 + t[0][1]) + e
        back.append((b0, b1))
    y = [int(s1 > s0)]
    for b in reversed(back):
        y.append(int(b[y[-1]]))
    return y[::-1]


# --- labelled pages -------------------------------------------------------

_OUT = frozenset("nav footer aside form dialog".split())
#: Kinds of page furniture for dressing: ancestors, texts, whether links.
_FURNITURE = (
    ((("header", ()),), ("{w}", "{w} {w}"), True), ((("div", ("header",)),), ("{w}", "{s}"), False),
    ((("header", ()), ("p", ())), ("{s}", "{w} {w}"), False), ((("header", ()), ("h1", ())), ("{w} {w}",), False),
    ((("header", ()), ("ul", ()), ("li", ())), ("{w}",), True), ((("nav", ()), ("p", ())), ("{s}", "{w}"), False),
    ((("footer", ()), ("p", ())), ("{s}", "{s} {s}"), False), ((("aside", ()), ("h3", ())), ("{w}",), False),
    ((("nav", ()), ("ul", ()), ("li", ())), ("{w}",), True),
    ((("div", ("menu",)), ("ul", ()), ("li", ())), ("{w}", "{w} {w}"), True),
    ((("aside", ()), ("p", ())), ("{s}", "{w} {w} {w}"), False),
    ((("div", ("sidebar",)), ("p", ())), ("{s}",), False),
    ((("div", ("sidebar", "widget")), ("ul", ()), ("li", ())), ("{w} {w} {w}",), True),
    ((("div", ("cookie", "notice")), ("p", ())), ("We use cookies. {s}", "{s}", "Accept all cookies to go on."), False),
    ((("div", ("notice",)),), ("{s}",), False), ((("div", ("ad",)),), ("{s}", "Advertisement"), False),
    ((("div", ("ads", "banner")), ("p", ())), ("{s}",), False), ((("section", ("promo",)),), ("{s}",), True),
    ((("form", ()), ("p", ())), ("Subscribe to our newsletter", "Your name", "{w}"), False),
    ((("form", ()), ("div", ())), ("Search", "{w}"), False),
    ((("section", ("comments",)), ("p", ())), ("{s}", "{s} {s}"), False),
    ((("div", ("comments",)), ("div", ("comment",)), ("p", ())), ("{s}", "{s} {s}"), False),
    ((("div", ("comments",)), ("h", ())), ("Comments", "Replies"), False),
    ((("ol", ("comment", "list")), ("li", ("comment",)), ("p", ())), ("{s}",), False),
    ((("div", ("related",)), ("ul", ()), ("li", ())), ("{w} {w} {w} {w}",), True),
    ((("div", ("share",)),), ("Share this", "{w}"), True),
    ((("footer", ()),), ("© {w}. All rights reserved.", "{s}"), False),
    ((("div", ("footer",)), ("p", ())), ("© {w}", "{s}"), False),
)
_MAIN = ((("article", ()),), (("main", ()),), (("main", ()), ("article", ())), (("div", ("content",)),),
         (("div", ("post", "body")),), (("div", ("entry", "content")),), (("section", ()),), (("div", ("article",)),),
         (("div", ("story",)),), (("div", ()),), (("div", ("main",)), ("div", ("text",))))


#: Other elements that main text stands in.
_OWN = ((("ul", ()), ("li", ())), (("ol", ()), ("li", ())), (("blockquote", ()),), (("blockquote", ()), ("p", ())),
        (("h2", ()),), (("h3", ()),), (("pre", ()),), (("table", ()), ("tr", ()), ("td", ())), (("p", ()),),
        (("figure", ()), ("figcaption", ())), (("div", ()),), (("section", ()), ("p", ())), (("header", ()), ("h1", ())),
        (("header", ()), ("p", ())), (("dl", ()), ("dd", ())))


def labelled(page_blocks) -> list[int]:
    """Labels by the page's own markup: inside article or main, and there not
    inside furniture or comments."""
    y = []
    for above, _, _ in page_blocks:
        inside = max((i for i, (t, _) in enumerate(above) if t in ("article", "main")), default=None)
        # the outermost main part counts: what stands below it may still be furniture
        first = next((i for i, (t, _) in enumerate(above) if t in ("article", "main")), None)
        ok = inside is not None and not any(
            t in _OUT or any(_MEANS.get(w) in ("furniture", "comments") for w in ws) for t, ws in above[first:])
        y.append(int(ok))
    return y


def dressed(page_blocks, y, rng: random.Random):
    """The page with its main part in other markup and furniture around it."""
    main = [b for b, k in zip(page_blocks, y) if k]
    if not main:
        return None
    texts = [t for _, t, _ in page_blocks]
    some = " ".join(rng.sample(texts, min(3, len(texts)))).split() or ["text"]
    outer = (("html", ()), ("body", ())) + ((("div", rng.choice(((), ("wrapper",), ("page",)))),) if rng.random() < .5 else ())
    shell = outer + rng.choice(_MAIN)

    def furniture():
        above, forms, links = rng.choice(_FURNITURE)
        out = []
        for _ in range(rng.choice((1, 1, 2, 3, 5))):
            s = " ".join(rng.choice(some) for _ in range(rng.randint(4, 25))).rstrip(",") + rng.choice((".", ".", ""))
            t = re.sub(r"\{(\w)\}", lambda m: s if m[1] == "s" else rng.choice(some), rng.choice(forms))
            out.append(((outer + above, t, len(t) if links else 0), 0))
        return out

    page = [x for _ in range(rng.randint(1, 4)) for x in furniture()]
    for above, t, n in main:
        own = above[next(i for i, (g, _) in enumerate(above) if g in ("article", "main")) + 1:]
        if rng.random() < .3:
            own = rng.choice(_OWN)
            if own[-1][0] not in ("p", "pre", "div") and rng.random() < .6:
                t = " ".join(t.split()[:rng.randint(1, 8)])
                n = len(t) if rng.random() < .1 else 0
        page.append(((shell + own, t, n), 1))
        if rng.random() < .05:  # an advert amid the text
            inside = rng.choice([f for f in _FURNITURE if f[0][0][0] in ("div", "aside", "form", "section")])
            page.append(((shell + inside[0], rng.choice(inside[1]).replace("{s}", " ".join(some[:12])).replace(
                "{w}", some[0]), 0), 0))
    page += [x for _ in range(rng.randint(1, 5)) for x in furniture()]
    return [b for b, _ in page], [k for _, k in page]


#: Makes up the number where a table has fewer labelled pages than LEAST.
LEAST = 20
_PLAIN = "<article><h1>A title of some words</h1><p>One sentence of plain text follows another.</p><p>Short.</p>" \
         "<p>This is a longer paragraph, as they are found in most articles, with commas and a full stop.</p></article>"


def train(pages: list[str]) -> Chain:
    """Fits the chain on labelled pages (and their dressings)."""
    rng, data = random.Random(0), []
    for page in pages + [_PLAIN] * max(0, LEAST - len(pages)):
        b = blocks(page)
        y = labelled(b)
        data.append((features(b), y))
        for _ in range(DRESSINGS):
            d = dressed(b, y, rng)
            if d:
                data.append((features(d[0]), d[1]))
    return Chain().fit(data, PASSES)


def labelled_sample(pages: DataFrame, n: int = SAMPLE) -> list[str]:
    """At most n pages of those that mark their main part, by hash: the n
    smallest hashes first, then one page for each."""
    marked = pages.filter(F.col("html").rlike(r"(?i)<(article|main)[\s>]") & (F.length("html") < 200_000)).select(
        F.xxhash64("html").alias("hash"), "html")
    least = marked.select("hash").distinct().orderBy("hash").limit(n).agg(F.max("hash")).first()[0]
    if least is None:
        return []
    rows = marked.filter(F.col("hash") <= least).groupBy("hash").agg(F.min("html").alias("html")).collect()
    return [r["html"] for r in sorted(rows, key=lambda r: r["hash"])]


def main_text(page: str | None, weight, t) -> str:
    b = blocks(page)
    return "\n".join(text for (_, text, _), y in zip(b, decode(features(b), weight, t)) if y)


def extracted(pages: DataFrame, model: Chain | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of `pages`
    (page_id, url, html and any other columns).

    text: the main blocks joined by line feeds, empty if there are none; a
    null or empty page has none.  Repeated rows and null ids or urls are
    carried; an empty table gives no rows.  A page without markup is one
    block, judged by its text alone.
    """
    weight, t = (model or train(labelled_sample(pages))).tables()
    shared = pages.sparkSession.sparkContext.broadcast((weight, t))

    def run(batches):
        weight, t = shared.value
        for b in batches:
            texts = [main_text(x.as_py(), weight, t) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return for_python(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")


@query("op5_html_main_text")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read(spark, sf_dir, "pages"))
