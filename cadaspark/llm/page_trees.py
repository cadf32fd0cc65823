"""Main text of web pages: boosted trees over the nodes of the page, decoded so that no choice contradicts an ancestor's.

Each block element is a node with figures about itself (tag, words of its attributes, depth), its subtree (text, links, density,
punctuation), its ancestors and its siblings. The trees give the probability that a node holds main text. A keep-or-drop
choice for all nodes is then made at once: a dropped node drops all below it, and the choice with the greatest likelihood under that
rule is found from the leaves upwards.

The trees are trained in the driver on at most about ``SAMPLE`` pages (taken by a hash of the id) whose article is marked by its
tag, and on pages laid out anew from their sentences with menus, banners, notices, sidebars, forms, comments and footers around
and inside the article, some without any telling tag.

Edge cases: a null or empty page gives an empty text; text outside any element counts to the page's root; unclosed and
crossing tags are closed as browsers do for paragraphs, list items and table cells; repeated rows are judged each for itself.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Callable
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadaspark.llm import boosting
from cadaspark.llm.arrow import map_text

SAMPLE = 300
MADE = 900
TREES = 80
# Elements of HTML by how they stand in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup "
    "time tt u var wbr img br acronym nobr ruby rb rt rp picture source audio video canvas meter output progress".split()
)
NEVER = set(
    "head title script style noscript template iframe object embed svg math button select textarea input option label legend "
    "datalist dialog".split()
)
CLOSES = {  # an opening tag ends these open ones, up to the nearest of the stops
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
TAGS = [
    ("p",), ("div", "section"), ("article", "main"), ("nav", "menu"), ("header",), ("footer",), ("aside",),
    ("ul", "ol", "dl"), ("li", "dt", "dd"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("table", "tbody", "tr", "td", "th"),
    ("blockquote", "pre", "figure", "figcaption"),
]
TOKENS = {
    "main": "article content main post entry story body text prose page hentry blog",
    "menu": "nav navigation menu navbar breadcrumb breadcrumbs pagination pager tabs toc skip links topbar toolbar",
    "edge": "header masthead banner footer foot colophon copyright legal site logo brand top bottom contentinfo",
    "side": "sidebar side aside widget rail related recommended popular trending more teaser complementary archive tags",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion dfp adsense outbrain taboola commercial",
    "notice": "notice cookie cookies consent gdpr alert warning popup modal overlay message paywall announcement disclaimer",
    "talk": "comment comments reply replies respond disqus discussion thread reader feedback reviews",
    "state": "has with no is right left site open enabled on single layout",
    "act": "form search login signup subscribe newsletter share social follow like signin register contact donate button",
}
_GROUPS = {t: g for g, words in TOKENS.items() for t in words.split()}


class Page(HTMLParser):
    """The block elements of a page in order, with the text that each holds itself."""

    def __init__(self, html: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.words, self.link_chars = ["#root"], [-1], [set()], [0]
        self.never = [False]
        self.pieces: list[tuple[int, str]] = []  # text of a node between two block borders
        self._open: list[tuple[str, int]] = [("#root", 0)]  # inline elements carry the node they lie in
        self._text: list[str] = []
        self._links = 0
        self.feed(html or "")
        self.close()
        self._flush()
        self._small_forms()

    def _small_forms(self) -> None:
        """Nothing in a form is main text, unless the form wraps most of the page; then only its controls go."""
        if "form" not in self.tag:
            return
        chars = [0] * len(self.tag)
        for node, text in self.pieces:
            chars[node] += 0 if self.never[node] else len(text)
        for v in range(len(chars) - 1, 0, -1):
            chars[self.parent[v]] += chars[v]
        for v in range(1, len(chars)):
            small = self.tag[v] == "form" and 2 * chars[v] <= chars[0]
            self.never[v] = self.never[v] or self.never[self.parent[v]] or small

    @property
    def node(self) -> int:
        return self._open[-1][1]

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self.pieces.append((self.node, text))
        self._text = []

    def _leave(self, count: int) -> None:
        for _ in range(count):
            tag, node = self._open[-1]
            if self._open[-2][1] != node:
                self._flush()
            if tag == "a":
                self._links -= 1
            self._open.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        words = attribute_words(attrs)
        block = tag not in INLINE or bool({_GROUPS.get(w) for w in words} & {"advert", "notice", "talk", "side"})
        if tag == "br":
            self._text.append(" ")
        if tag not in INLINE:
            self._close_paragraph(tag)
        if tag in VOID:
            return
        if block:
            self._flush()
            self.tag.append(tag)
            self.parent.append(self.node)
            self.words.append(words)
            self.link_chars.append(0)
            self.never.append(self.never[self.node] or tag in NEVER)
            self._open.append((tag, len(self.tag) - 1))
        else:
            self._open.append((tag, self.node))
        if tag == "a":
            self._links += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash does not close an element that is not void

    def _close_paragraph(self, tag: str) -> None:
        ends, stops = CLOSES.get(tag, ({"p"}, {"td", "th", "button", "div", "li", "blockquote"}))
        for depth in range(len(self._open) - 1, 0, -1):
            name = self._open[depth][0]
            if name in ends:
                self._leave(len(self._open) - depth)
                if tag not in CLOSES:
                    return
            elif name in stops:
                return

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self._open) - 1, 0, -1):
            if self._open[depth][0] == tag:
                self._leave(len(self._open) - depth)
                return

    def handle_data(self, data: str) -> None:
        self._text.append(data)
        if self._links > 0:
            self.link_chars[self.node] += len(data)


def attribute_words(attrs: list[tuple[str, str | None]]) -> set[str]:
    """Words of class, id, role and label, in lower case and without a plural s."""
    found: set[str] = set()
    for name, value in attrs:
        if name in ("class", "id", "role", "aria-label", "itemprop") and value:
            parts = re.sub(r"([a-z])([A-Z])", r"\1 \2", value)
            found.update(w.lower() for w in re.split("[^A-Za-z]+", parts) if w)
    return found


FIGURES = (
    ["depth", "children", "place", "siblings", "own_chars", "chars", "words", "link_share", "density", "stops", "word_length",
     "blocks", "share_of_page", "before", "after", "sibling_mean", "in_menu", "in_edge", "in_aside", "in_article", "from_start", "heads", "beside_p"]
    + ["tag_" + t[0] for t in TAGS] + ["own_" + g for g in TOKENS] + ["above_" + g for g in TOKENS]
)


def figures(page: Page) -> np.ndarray:
    """One row per node, in the order of ``FIGURES``."""
    n = len(page.tag)
    own_chars, own_words, stops = np.zeros(n), np.zeros(n), np.zeros(n)
    for node, text in page.pieces:
        if not page.never[node]:
            own_chars[node] += len(text)
            own_words[node] += text.count(" ") + 1
            stops[node] += sum(text.count(c) for c in ".!?,;:")
    chars, words, marks, links, blocks = own_chars.copy(), own_words.copy(), stops.copy(), np.array(page.link_chars, float), np.ones(n)
    depth, children = np.zeros(n), np.zeros(n)
    kids: list[list[int]] = [[] for _ in range(n)]
    for v in range(1, n):
        depth[v] = depth[page.parent[v]] + 1
        children[page.parent[v]] += 1
        kids[page.parent[v]].append(v)
    for v in range(n - 1, 0, -1):
        u = page.parent[v]
        for sums in (chars, words, marks, links, blocks):
            sums[u] += sums[v]
    groups = list(TOKENS)
    own = np.array([[any(_GROUPS.get(w) == g for w in page.words[v]) for g in groups] for v in range(n)], float)
    above = np.zeros_like(own)
    inside = np.zeros((n, 4))
    kinds = ({"nav", "menu"}, {"header", "footer"}, {"aside"}, {"article", "main"})
    for v in range(1, n):
        u = page.parent[v]
        above[v] = np.maximum(above[u], own[u])
        inside[v] = np.maximum(inside[u], [page.tag[v] in k for k in kinds])
    tags = np.array([[page.tag[v] in t for t in TAGS] for v in range(n)], float)
    place, siblings, before, after, mean = np.zeros(n), np.ones(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for family in kids:
        total = sum(chars[v] for v in family)
        for i, v in enumerate(family):
            place[v], siblings[v] = i / len(family), len(family)
            before[v] = chars[family[i - 1]] if i else 0
            after[v] = chars[family[i + 1]] if i + 1 < len(family) else 0
            mean[v] = (total - chars[v]) / max(len(family) - 1, 1)
    start = np.concatenate([[0], np.cumsum(own_chars)[:-1]]) / max(chars[0], 1)
    heads = np.array([t == "h1" for t in page.tag], float)
    for v in range(n - 1, 0, -1):
        heads[page.parent[v]] += heads[v]
    paragraphs = [sum(page.tag[v] == "p" for v in family) for family in kids]
    beside = np.array([0.0] + [paragraphs[page.parent[v]] - (page.tag[v] == "p") for v in range(1, n)])
    log = np.log1p
    numbers = [
        depth, log(children), place, log(siblings), log(own_chars), log(chars), log(words), links / np.maximum(chars, 1),
        log(chars / blocks), marks / np.maximum(words, 1), chars / np.maximum(words, 1), log(blocks), chars / max(chars[0], 1),
        log(before), log(after), log(mean), *inside.T, start, heads, log(beside),
    ]
    return np.column_stack([*numbers, tags, own, above])


def decode(page: Page, probability: np.ndarray) -> list[bool]:
    """The likeliest choice in which a dropped node drops everything below it; the root stays."""
    p = np.clip(probability, 1e-6, 1 - 1e-6)
    n = len(p)
    drop, keep = np.log(1 - p), np.log(p)
    for v in range(n - 1, 0, -1):
        u = page.parent[v]
        if page.never[v]:
            keep[v] = -math.inf
        keep[u] += max(keep[v], drop[v])
        drop[u] += drop[v]
    kept = [True] * n
    for v in range(1, n):
        kept[v] = bool(kept[page.parent[v]] and keep[v] > drop[v])
    if not any(kept[node] for node, _ in page.pieces):
        best = running_text(page)
        below = {best}
        for v in range(best + 1, n) if best else ():
            if page.parent[v] in below and not page.never[v] and (page.tag[v] in ("p", "h1") or keep[v] > drop[v]):
                below.add(v)
                kept[v] = True
        while best > 0:
            kept[best] = True
            best = page.parent[best]
    return kept


def running_text(page: Page) -> int:
    """The node whose own paragraphs hold most text, outside menus, asides and footers; 0 if that is less than two or 40 words."""
    n = len(page.tag)
    outside = [False] * n
    for v in range(1, n):
        outside[v] = outside[page.parent[v]] or page.never[v] or page.tag[v] in ("nav", "menu", "aside", "footer")
    words, count = [0] * n, [0] * n
    for node, text in page.pieces:
        if page.tag[node] == "p" and not outside[node] and page.link_chars[node] * 2 < len(text):
            words[page.parent[node]] += text.count(" ") + 1
            count[page.parent[node]] += 1
    best = max(range(n), key=lambda v: words[v])
    return best if count[best] > 1 and words[best] >= 40 else 0


def main_text(page: Page, kept: list[bool]) -> str:
    return "\n".join(text for node, text in page.pieces if kept[node])


# --- training pages -----------------------------------------------------------------------------------------------------

MAIN_MARK = "data-main"


class _Marked(Page):
    """A training page: notes which nodes lie in the part that is marked as main."""

    def __init__(self, html: str) -> None:
        self.main = [False]
        super().__init__(html)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        before = len(self.tag)
        super().handle_starttag(tag, attrs)
        if len(self.tag) > before:
            mark = dict(attrs).get(MAIN_MARK)
            self.main.append(mark == "1" if mark is not None else self.main[self.parent[-1]])

    def labels(self) -> np.ndarray:
        """A node is good if main text lies in it or below it."""
        out = np.zeros(len(self.tag), dtype=bool)
        for node, _ in self.pieces:
            if self.main[node]:
                while node >= 0 and not out[node]:
                    out[node] = True
                    node = self.parent[node]
        return out


def marked_article(html: str | None) -> str | None:
    """A page whose only article gets the mark; None if there is not exactly one, or a telling part lies in it."""
    if not html or len(re.findall(r"(?i)<article\b", html)) != 1:
        return None
    inner = re.search(r"(?is)<article\b.*?</article", html)
    if inner and re.search(r"(?i)<(aside|form|nav|footer|header)\b|class=", inner.group()[8:]):
        return None
    return re.sub(r"(?i)<article\b", f'<article {MAIN_MARK}="1"', html, count=1)


def make_page(rng: random.Random, sentences: list[str]) -> str:
    """A page laid out at random around paragraphs of the given sentences, with its main part marked."""

    def some(low: int, high: int) -> str:
        return escape(" ".join(rng.choice(sentences) for _ in range(rng.randint(low, high))))

    def words(low: int, high: int) -> str:
        return escape(" ".join(rng.choice(sentences).split()[: rng.randint(low, high)]))

    def named(group: str) -> str:
        if rng.random() < 0.12:
            return ""
        name = rng.choice(TOKENS[group].split())
        if rng.random() < 0.4:
            name += rng.choice(["-box", "-wrap", "_1", "-area", "-inner", " block", "-list", "-section"])
        return f' {rng.choice(["class", "class", "id"])}="{name}"'

    def mixed() -> str:
        """A name that says what a page has besides, as bodies, wrappers and articles carry it."""
        word = rng.choice(TOKENS[rng.choice(["side", "talk", "edge", "menu", "advert", "notice", "act"])].split())
        lead = rng.choice(["has-", "with-", "right-", "left-", "no-", "is-", "site-", ""])
        more = rng.choice(["", "", "-open", "-news", "-enabled", "-on"]) if lead else rng.choice(["-open", "-enabled", "-news", "-on"])
        other = rng.choice(["", "post ", "single ", "page ", "entry ", "el ", "layout "])
        return f' class="{other}{lead}{word}{more}"' if rng.random() < 0.9 else f' id="{lead}{word}{more}"'

    def menu(tag: str) -> str:
        items = "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(rng.randint(3, 9)))
        return f'<{tag}{named("menu") if tag != "nav" or rng.random() < 0.4 else ""}><ul>{items}</ul></{tag}>'

    def head() -> str:
        body = rng.choice([f"<h1>{words(1, 4)}</h1>", f"<p>{words(2, 8)}</p>", words(1, 5), menu("div")])
        return rng.choice([f"<header>{body}</header>", f'<div{named("edge")}>{body}</div>'])

    def advert() -> str:
        tag = rng.choice(["div", "div", "aside", "section", "p"])
        link = f'<a href="/x">{words(2, 8)}</a>'
        body = rng.choice([some(1, 2), link] if tag == "p" else [some(1, 2), link, f"<p>{some(1, 2)}</p>"])
        return f'<{tag} class="{rng.choice(TOKENS["advert"].split())}">{body}</{tag}>'

    def notice() -> str:
        tag = rng.choice(["div", "section", "p"])
        body = some(1, 3) if tag == "p" else rng.choice([some(1, 3), f"<p>{some(1, 3)}</p>"])
        return f'<{tag} class="{rng.choice(TOKENS["notice"].split())}">{body}</{tag}>'

    def side() -> str:
        body = f"<h3>{words(1, 4)}</h3>" + rng.choice([menu("div"), f"<p>{some(1, 4)}</p>", f"<p>{some(1, 2)}</p><p>{some(1, 2)}</p>"])
        tag = rng.choice(["aside", "aside", "div"])
        return f'<{tag}{named("side") if tag == "aside" else f" class={chr(34)}{rng.choice(TOKENS["side"].split())}{chr(34)}"}>{body}</{tag}>'

    def form() -> str:
        return f'<form action="/s"><label>{words(1, 4)}</label><input name="q"><p>{some(1, 1)}</p><button>{words(1, 2)}</button></form>'

    def talk() -> str:
        one = rng.choice(["div", "li", "article", "p"])
        box = "ul" if one == "li" else rng.choice(["div", "section", "aside"])
        each = "".join(
            f'<{one}{named("talk")}>{rng.choice([some(1, 4), f"<p>{some(1, 4)}</p>"]) if one != "p" else some(1, 4)}</{one}>'
            for _ in range(rng.randint(1, 6))
        )
        return f'<{box} class="{rng.choice(TOKENS["talk"].split())}"><h3>{words(1, 3)}</h3>{each}</{box}>'

    def foot() -> str:
        body = rng.choice([f"&copy; {words(2, 6)} &middot; {some(1, 2)}", f"<p>{some(1, 2)}</p>", menu("div")])
        return rng.choice([f"<footer>{body}</footer>", f'<div{named("edge")}>{body}</div>' if rng.random() < 0.3 else f"<footer><div>{body}</div></footer>"])

    def block() -> str:
        kind = rng.random()
        if kind < 0.68:
            return rng.choice([f"<p>{some(1, 8)}</p>", f"<p>{some(1, 5)}", f"<p><b>{words(2, 8)}</b> {some(1, 5)}</p>", f"<p><b>{some(1, 2)}<br>"])
        if kind < 0.76:
            return f"<h2>{words(2, 8)}</h2>"
        if kind < 0.83:
            return f"<ul>{''.join(f'<li>{words(3, 12)}</li>' for _ in range(rng.randint(2, 6)))}</ul>"
        if kind < 0.88:
            return f"<blockquote>{rng.choice([some(1, 3), f'<p>{some(1, 3)}</p>'])}</blockquote>"
        if kind < 0.92:
            return f"<table><tr><td>{words(1, 5)}</td><td>{words(1, 5)}</td></tr><tr><td>{words(1, 5)}</td><td>{words(1, 5)}</td></tr></table>"
        return f"<div>{some(1, 6)}</div>"

    def marked(html: str) -> str:
        return re.sub(r"^<(\w+)", rf'<\1 {MAIN_MARK}="0"', html)

    extras = [advert, notice, side, form, talk, lambda: menu("div")]
    title = f"<h1>{words(3, 12)}</h1>"
    parts = [title] if rng.random() < 0.8 else []
    if parts and rng.random() < 0.45:
        note = rng.choice(["", "", f"<p>{words(2, 6)}</p>"])
        parts = [rng.choice([f"<header>{title}{note}</header>", f'<div class="{rng.choice(["entry", "post", "article", "page"])}-header">{title}{note}</div>'])]
    for _ in range(rng.randint(1, 14)):
        parts.append(block())
        if rng.random() < 0.12:
            parts.append(marked(rng.choice(extras)()))
    if rng.random() < 0.25:
        parts.append(marked(rng.choice([talk, side, advert])()))
    wrap = rng.choice(["article", "article", "main", "div", "section", "td"])
    if wrap == "td":
        core = f'<table><tr><td {MAIN_MARK}="1">{"".join(parts)}</td><td>{side()}</td></tr></table>'
    else:
        name = named("main") if wrap in ("div", "section") or rng.random() < 0.3 else ""
        if wrap != "div" and rng.random() < 0.35:
            name = mixed()
        core = f'<{wrap}{name} {MAIN_MARK}="1">{"".join(parts)}</{wrap}>'
    before = [f() for f in (head, lambda: menu("nav"), lambda: menu("div"), advert, notice, form, side) if rng.random() < 0.45]
    behind = [f() for f in (side, advert, talk, foot, foot, form, notice) if rng.random() < 0.45]
    rng.shuffle(before)
    inner = "".join(before) + core + "".join(behind)
    if rng.random() < 0.25:  # a wrapper of its own around the article
        inner = "".join(before) + f"<div{mixed()}>{core}</div>" + "".join(behind)
    for _ in range(rng.randint(0, 2)):
        inner = f"<div{rng.choice(['', '', ' id=wrapper', ' class=container', mixed()])}>{inner}</div>"
    if rng.random() < 0.08:
        inner = f'<form method="post" action="/page">{inner}</form>'
    body = mixed() if rng.random() < 0.4 else ""
    return f"<html><head><title>{words(2, 8)}</title><style>p{{}}</style></head><body{body}>{inner}<script>var a=1;</script></body></html>"


def fit(pages: DataFrame, key: str = "page_id", html: str = "html", sample: int = SAMPLE) -> boosting.Forest:
    """Train on a bounded sample of pages and on pages made from their sentences."""
    total = pages.count()
    share = int(min(1.0, sample / max(total, 1)) * (1 << 30))
    picked = pages.where(F.pmod(F.xxhash64(key, F.lit(9)), F.lit(1 << 30)) < share).select(key, html)
    shown = [r[html] for r in picked.orderBy(key, html).limit(2 * sample).collect()]
    real = [m for m in map(marked_article, shown) if m]
    sentences = sorted({s.strip() for h in shown if h for _, t in Page(h).pieces for s in re.split(r"(?<=[.!?])\s", t) if s.strip()})
    rng = random.Random(9)
    stock = sentences or ["A plain sentence of a few words.", "Another one, with a comma, to end it."]
    made = [_Marked(make_page(rng, rng.sample(stock, min(len(stock), 40)))) for _ in range(MADE)]
    known = [_Marked(h) for h in real] + made
    x = np.concatenate([figures(p) for p in known])
    y = np.concatenate([p.labels() for p in known])
    told = np.array([not n for p in known for n in p.never])
    return boosting.train(x[told], y[told], trees=TREES, depth=5, rate=0.2)


def extract(pages: DataFrame, forest: boosting.Forest, carry: list[str], html: str = "html") -> DataFrame:
    """``carry`` columns and ``text``, the main text of each whole page."""
    shared = pages.sparkSession.sparkContext.broadcast(forest)

    def build() -> Callable:
        trees = shared.value

        def work(htmls: list[str | None]) -> list[pa.Array]:
            read = [Page(h) for h in htmls]
            rows = [figures(p) for p in read]
            chance = trees.probability(np.concatenate(rows))
            bounds = np.cumsum([0, *map(len, rows)])
            texts = [main_text(p, decode(p, chance[a:b])) for p, a, b in zip(read, bounds[:-1], bounds[1:], strict=True)]
            return [pa.array(texts, pa.string())]

        return work

    return map_text(pages, html, carry, "text string", build)
