"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. A logistic classifier over a block's words, links, tag and
place in the document tree gives its log-odds to be content, which are capacities to the
terminals. Neighbouring blocks, and blocks of one parent, are joined by edges; an edge's capacity
is half the log-odds that such two blocks have one label. The minimum cut parts content from
boilerplate at the least total cost, so that a short paragraph stays with its article and a
long advert doesn't pull in its neighbours.

Classifier and edges are learned from pages that are made by a rule (``made_page``), whose blocks
are content or not by construction. They don't depend on the pages that are read.
"""

from __future__ import annotations

import random
import re
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm.arrow import map_texts
from corpusmill.sources.tables import read_table

#: Elements whose content is never text of the page.
RAW = frozenset("script style template title textarea iframe xmp noembed noframes".split())
#: Elements whose text stands in for something else; it costs what a link's does, up to the block's end.
INSTEAD = frozenset("audio canvas object svg video".split())
#: Lists of choices: they don't end a paragraph, and any block but their options ends them.
CHOICES, OPTIONS = frozenset("select datalist".split()), frozenset("option optgroup".split())
BLOCKS = frozenset("address article aside blockquote body button caption center datalist dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: A new element ends an open one of these kinds, unless one of the barriers stands between.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th"), "body": ("head",)}
BARRIERS = frozenset("ul ol dl menu table body article section div".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption summary".split())

#: Elements that lead away.
APART = frozenset("nav aside footer form button menu dialog fieldset search head select datalist".split())
#: Marks of an element, which its blocks have from all around them.
ARTICLE, MAIN, ASIDE, HEADER, TITLING, HIDDEN, LED_AWAY, LED_HERE, NAMED_HEADER = (1 << i for i in range(9))
#: Words of class, id and role names that lead away: the last word of a name, or the first if the others are GENERIC (outside of articles, any first one); and words that lead here.
AWAY = frozenset("ad ads adv advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright disclaimer disqus footer form gdpr login masthead menu modal nav navbar navigation navigator newsletter notice notification pager pagination paywall popup promo promoted promotion recommended related reply replies respond search share sharing sidebar signup skip skyscraper social sponsor sponsored subscribe subscription tags toc toolbar tooltip tracking warning widget widgets".split())
HERE = frozenset("article body content entry main post story text".split())
GENERIC = frozenset("area bar block box bottom col column container entry field group header holder icon image inner item items left line link links list main menu module outer panel right row section slot space text title top unit widget wrap wrapper zone".split())
#: Such a word and those after it say what an element has or is filed under, not what it is.
QUALIFIERS = frozenset("author cat category format has hide label layout no tag tagged term topic type with without".split())
#: A block of more words than this is running text.
RUNNING = 15
#: Pages that the classifier learns from.
PAGES = 400
ODD = re.compile(r"©|\b(?:all rights reserved|cookies?|copyright|log ?in|newsletter|privacy policy|sign ?(?:in|up)|subscribe|terms of (?:service|use))\b", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PARTS = re.compile(r"[a-z]+")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}


_BODY = re.compile(r"</head(?=[\s/>])|<body(?=[\s/>])", re.I)


@dataclass(slots=True)
class Element:
    name: str
    number: int  # its own, among all elements
    marks: int  # its own, and at the end its ancestors' too
    away: bool  # whether its names lead away, unless it holds the article
    article: bool  # in an article or main, or one itself
    in_article: bool  # in an article, or one itself
    parent: int
    depth: int


@dataclass(slots=True)
class Block:
    text: str
    place: Element  # the innermost element
    holder: int  # the element that holds the paragraphs
    link: int  # characters in links and of INSTEAD


def _marks(name: str, attributes: str, article: bool, in_article: bool) -> tuple[int, bool]:
    """An element's own marks, and whether its names lead away.

    An article or main is what it is by whatever name; only an article in an article may be a comment.
    """
    marks = {"article": ARTICLE, "main": MAIN, "header": TITLING if article else HEADER}.get(name, ASIDE if name in APART else 0)
    away = False
    if attributes and name not in ("html", "body"):
        parts: set[str] = set()
        for key, a, b, c in _NAMES.findall(attributes):
            value, key = (a or b or c).lower(), key.lower()
            if key == "style":
                if "display:none" in value.replace(" ", ""):
                    marks |= HIDDEN
            elif key == "hidden" or key == "aria-hidden":
                if key == "hidden" or value == "true":
                    marks |= HIDDEN
            else:
                for token in value.split():
                    words = _PARTS.findall(token)
                    for i, word in enumerate(words):
                        if word in QUALIFIERS:
                            del words[i:]
                            break
                    if words:
                        parts.update(words)
                        away = away or words[-1] in AWAY or words[0] in AWAY and (not in_article or GENERIC.issuperset(words[1:]))
        if "header" in parts:
            marks |= TITLING if article or parts & HERE else NAMED_HEADER
        elif parts & HERE:
            marks |= LED_HERE
    return marks, away and (in_article or name not in ("article", "main"))


def blocks_of(html: str) -> list[Block]:
    """The page's blocks of text in order, decoded, with white space as single spaces.

    Names in AWAY don't count on elements around a main, nor on those around the articles, unless
    there are articles (not within another) that stand free of such names: then the others are
    teasers or comments. On a page without an article or main they don't count on an element that holds all running text.
    """
    stack = [Element("", 0, 0, False, False, False, 0, 0)]
    elements, found = stack[:], []
    wraps: list[Element] = []  # around articles
    free = False
    pieces: list[str] = []
    linked = at = 0
    in_link = instead = False

    def end() -> None:
        nonlocal linked, instead
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                top = stack[-1]
                found.append(Block(text, top, top.parent if top.name in LEAVES else top.number, linked))
            pieces.clear()
        linked, instead = 0, False

    while True:
        m = _TOKEN.search(html, at)
        piece = html[at : m.start()] if m else html[at:]
        if piece:
            pieces.append(piece)
            if in_link or instead:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name == "a":
            in_link = not closing
        elif name == "br":
            pieces.append(" ")
        elif name in INSTEAD:
            pieces.append(" ")
            instead = not closing and not attributes.endswith("/")
        elif name in RAW:
            if not closing and not attributes.endswith("/"):
                over = _CLOSE[name].search(html, at)
                if name == "title" and not over:
                    over = _BODY.search(html, at)  # a title that isn't closed ends where the body begins
                    at = over.start() if over else len(html)
                else:
                    at = over.end() if over else len(html)
        elif name in BLOCKS:
            end()
            if name == "hr":
                continue
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name:
                        del stack[i:]
                        break
                continue
            for i in range(len(stack) - 1, 0, -1):
                over = stack[i].name
                if over in CHOICES and name in OPTIONS:
                    break
                if over == "p" and name not in CHOICES or over in CHOICES or over in ENDS.get(name, ()):
                    del stack[i:]
                elif over in BARRIERS:
                    break
            top = stack[-1]
            holds = name in ("article", "main")
            if holds and not top.in_article:
                around = [e for e in stack if e.away]
                if name == "main":
                    for e in around:
                        e.away = False
                else:
                    wraps += around
                    free = free or not around
            marks, away = _marks(name, attributes, top.article, top.in_article)
            stack.append(Element(name, len(elements), marks, away, top.article or holds, top.in_article or name == "article", top.number, top.depth + 1))
            elements.append(stack[-1])
    end()
    if not free:
        for e in wraps:
            e.away = False
    if not any(e.article for e in elements):
        held = [0] * len(elements)
        for b in found:
            held[b.place.number] += b.text.count(" ") >= RUNNING and 2 * b.link < len(b.text)
        for e in reversed(elements[1:]):
            held[e.parent] += held[e.number]
        for e in elements[1:]:
            e.away = e.away and not held[e.number] == held[0] > 0
    for e in elements[1:]:
        e.marks |= (LED_AWAY if e.away else 0) | elements[e.parent].marks
    return found


def features(block: Block, has_article: bool) -> list[float]:
    """What the classifier sees of a block; the first is always 1."""
    n, text, place, marks = block.text.count(" ") + 1, block.text, block.place, block.place.marks
    link, ends = min(1.0, block.link / len(text)), text[-1] in ".!?…:;\"'”’)"
    outside, led = not place.article, bool(marks & (ASIDE | LED_AWAY | HIDDEN))
    own = not outside and not led
    return [
        1.0, min(n, 30) / 10, 2 * link, ends, not ends and n < 4, place.name in ("p", "blockquote", "pre", "h1", "h2", "h3", "h4"),
        place.name in ("li", "option", "legend") and link > 0.5 and not own, outside and has_article, 10 / max(n, 10) if outside and ODD.search(text) else 0.0, min(place.depth, 20) / 20,
        *(marks >> i & 1 for i in range(9)), bool(marks & ARTICLE and marks & LED_AWAY), not place.name,
        2 * link if own else 0.0, place.name in ("td", "th"), own and n < 4,
    ]


#: Kinds of edges by place, times what the two blocks are to each other.
PLACES, PAIRS = 5, 3


def neighbours(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Edges (i, j, kind) between blocks.

    By place they follow each other in one holder (0), in one article with the same marks (1), in holders side by side (2)
    or elsewhere (3), or are next ones of a holder (4). ``PLACES`` is added where the first is a heading and the
    other isn't, for a heading belongs to what it leads, and twice where one is marked as leading away and the other isn't.
    """
    edges, last = [], {}

    def pair(a: Block, b: Block) -> int:
        if (a.place.marks ^ b.place.marks) & (ASIDE | LED_AWAY | HIDDEN):
            return 2
        return int(a.place.name in HEADINGS and b.place.name not in HEADINGS)

    for j, b in enumerate(blocks):
        if j:
            a = blocks[j - 1]
            alike = a.place.article == b.place.article and a.place.marks == b.place.marks
            place = 0 if a.holder == b.holder else 1 if alike and b.place.article else 2 if alike and a.place.parent == b.place.parent else 3
            edges.append((j - 1, j, place + PLACES * pair(a, b)))
        i = last.get(b.holder)
        if i is not None and i < j - 1:
            edges.append((i, j, 4 + PLACES * pair(blocks[i], b)))
        last[b.holder] = j
    return edges


class Labeller(NamedTuple):
    """Weights of the classifier, and capacities of the kinds of edges."""

    weights: tuple[float, ...]
    edges: tuple[float, ...]


def made_page(rng: random.Random) -> tuple[str, dict[str, bool]]:
    """A page made by a rule, and whether each of its blocks is content."""
    label: dict[str, bool] = {}

    def text(words: int, content: bool, lead: str = "", end: str = ".") -> str:
        made = " ".join("".join(rng.choices("aeioubcdfglmnprst", k=rng.randint(2, 9))) for _ in range(words))
        label[f"{lead}{made}{end}"] = content
        return f"{lead}{made}{end}"

    few, many = lambda: rng.randint(1, 6), lambda: rng.randint(6, 70)
    end = lambda: rng.choice((".", ".", ".", "!", "?", ":", ""))

    def links(n: int, name: str) -> str:
        return f"<{name}><ul>{''.join(f'<li><a href=x>{text(few(), False, end=rng.choice(('', '', '.')))}</a></li>' for _ in range(n))}</ul></{name.split()[0]}>"

    def away(inside: bool = False) -> str:
        odd = rng.choice(("", "We use cookies, ", "Subscribe to our newsletter, ", "Sign up, ", "© All rights reserved, ", "Copyright "))
        kind = rng.choice((0, 2, 3, 4, 5, 6, 7)) if inside else rng.randrange(11)
        if kind > 7:  # a box that nothing names: only its blocks, taken together, tell
            tag = rng.choice(("p", "li", "div", "span"))
            one = lambda: text(rng.choice((1, 2, 3, 4, 5, 8)), False, odd if rng.random() < 0.2 else "", rng.choice(("", "", "", ".")))
            return f"<div>{''.join(f'<{tag}>{one()}</{tag}><br>' if tag != 'span' else f'<div>{one()}</div>' for _ in range(rng.randint(2, 6)))}</div>"
        if kind == 0:
            return links(rng.randint(2, 8), rng.choice(("nav", 'div class="menu"', 'div id="site-nav"', 'div class="share"' if inside else "div", 'ul class="related"')))
        if kind == 1:
            return f"<{rng.choice(('header', 'div class=header', 'div id=masthead'))}><p>{text(few(), False, end=end())}</p></header></div>"
        if kind == 2:
            return f"<footer>{text(rng.randint(1, 25), False, odd, end())}</footer>"
        if kind == 3:
            return f"<aside><h3>{text(few(), False, end='')}</h3><p>{text(many(), False, odd)}</p></aside>"
        if kind == 4:
            return f"<form><label>{text(few(), False, end='')}</label><p>{text(rng.randint(2, 20), False, odd)}</p><button>{text(1, False, end='')}</button></form>"
        if kind == 5:
            return f'<div class="comments"><{rng.choice(("div", "article"))} class="comment"><p>{text(many(), False)}</p></div></article></div>'
        name = rng.choice(('class="ad"', 'class="cookie-notice"', 'id="sidebar"', 'class="promo box"', 'class="share"', 'role="banner"', 'style="display: none"', "hidden"))
        inner = text(rng.randint(2, 40), False, odd, end())
        return f"<div {name}>{rng.choice((f'<p>{inner}</p>', inner))}</div>"

    def body() -> str:
        parts = [f"<h1>{text(rng.randint(1, 12), True, end=rng.choice(('', '.')))}</h1>"] if rng.random() < 0.8 else []
        p = "p" if rng.random() < 0.8 else "div"
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.7:
                lead = rng.choice(("They use cookies, ", "Copyright ")) if rng.random() < 0.05 else ""
                parts.append(f"<{p}>{text(few() if rng.random() < 0.25 else many(), True, lead, end())}</{p}>")
            elif kind < 0.8:
                parts.append(f"<{rng.choice(('h2', 'blockquote', 'pre'))}>{text(rng.randint(2, 12), True, end=end())}</{'h2'}>")
            elif kind < 0.9:
                parts.append(f"<ul>{''.join(f'<li>{text(rng.randint(1, 15), True, end=end())}</li>' for _ in range(rng.randint(1, 4)))}</ul>")
            elif kind < 0.92:
                parts.append(f"<div>{text(many(), True)}</div>")
            elif kind < 0.935:  # a list of sources
                parts.append(f"<ul>{''.join(f'<li><a href=x>{text(few(), True, end=rng.choice(('', '.')))}</a></li>' for _ in range(rng.randint(1, 5)))}</ul>")
            elif kind < 0.95:
                parts.append(f"<table>{''.join(f'<tr>{"".join(f"<{c}>{text(rng.choice((1, 1, 2, 5)), True, end='')}</{c}>" for _ in range(rng.randint(2, 4)))}</tr>' for c in rng.choices(('td', 'td', 'th'), k=rng.randint(1, 4)))}</table>")
            elif kind < 0.965:  # names that only look as if they led away, and bylines
                name = rng.choice(('class="search-history"', 'id="form-of-a-river"', 'class="notice-of-change"', 'id="share-prices"', 'class="byline"', 'class="alert-levels"'))
                parts.append(f"<{rng.choice(('div', 'section'))} {name}><p>{text(few() if 'byline' in name else many(), True, end=end())}</p></div></section>")
            else:
                parts.append(rng.choice((lambda: away(True), lambda: f"<header><h2>{text(few(), True, end='')}</h2></header>"))())
        return "".join(parts)

    if rng.random() < 0.08:  # text without an element, or a single one
        return rng.choice(("", "", "<body><div>")) + text(rng.randint(5, 70), True, end=end()), label
    before, after = rng.choice((("<article>", "</article>"), ("<article>", "</article>"), ('<article class="post tag-login">', "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main-text">', "</div>"), ("<div>", "</div>"), ("<div><div>", "</div></div>"), ("", "")))
    out = "".join(away() for _ in range(rng.randint(0, 3)))
    return f"<html><body>{out}{before}{body()}{after}{''.join(away() for _ in range(rng.randint(0, 3)))}</body></html>", label


@lru_cache(maxsize=2)
def learn(pages: int = PAGES, decay: float = 1.0, seed: int = 9) -> Labeller:
    """Fit the logistic classifier (by Newton's method, weights decayed) and count equal neighbours on made pages."""
    rng = random.Random(seed)
    rows, labels, same = [], [], np.ones((PLACES * PAIRS, 2))
    for _ in range(pages):
        html, label = made_page(rng)
        blocks = blocks_of(html)
        has_article = any(b.place.article for b in blocks)
        y = [label[b.text] for b in blocks]
        rows += [features(b, has_article) for b in blocks]
        labels += y
        for i, j, kind in neighbours(blocks):
            same[kind, int(y[i] == y[j])] += 1
    x, y = np.array(rows, float), np.array(labels, float)
    w = np.zeros(x.shape[1])
    keep = decay * np.eye(len(w))
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - decay * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    edges = np.maximum(0.0, np.log(same[:, 1] / same[:, 0]) / 2)
    return Labeller(tuple(w.round(6).tolist()), tuple(edges.round(6).tolist()))


def log_odds(block: Block, has_article: bool, weights: Sequence[float]) -> float:
    """How much the classifier takes the block for content (above zero) or boilerplate."""
    return sum(w * f for w, f in zip(weights, features(block, has_article), strict=True))


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stand on the source's side of the minimum cut, by Dinic's algorithm.

    A positive score is the capacity from the source, a negative one that to the sink. Capacities
    are counted in hundredths. Nodes that either side could hold go to the source's.
    """
    n = len(scores)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to, room = [], []

    def arc(u: int, v: int, there: int, back: int) -> None:
        head[u].append(len(to))
        to.append(v)
        room.append(there)
        head[v].append(len(to))
        to.append(u)
        room.append(back)

    for i, s in enumerate(scores):
        c = round(100 * abs(s))
        arc(source, i, c, 0) if s > 0 else arc(i, sink, c, 0)
    for i, j, c in edges:
        arc(i, j, round(100 * c), round(100 * c))

    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in head[u]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            break
        place = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(room[e] for e in path)
                for k, e in enumerate(path):
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if not room[e])
                u = to[path[k] ^ 1]
                del path[k:]
            while place[u] < len(head[u]) and not (room[e := head[u][place[u]]] and level[to[e]] == level[u] + 1):
                place[u] += 1
            if place[u] < len(head[u]):
                path.append(e)
                u = to[e]
            elif path:
                u = to[path.pop() ^ 1]
                place[u] += 1
            else:
                break
    away, queue = [False] * (n + 2), deque([sink])  # what still reaches the sink
    away[sink] = True
    while queue:
        v = queue.popleft()
        for e in head[v]:
            if room[e ^ 1] and not away[to[e]]:
                away[to[e]] = True
                queue.append(to[e])
    return [not a for a in away[:n]]


def label_blocks(blocks: list[Block], labeller: Labeller) -> tuple[list[float], list[bool]]:
    """Each block's log-odds, and whether the minimum cut leaves it with the content."""
    has_article = any(b.place.article for b in blocks)
    odds = [log_odds(b, has_article, labeller.weights) for b in blocks]
    return odds, minimum_cut(odds, [(i, j, labeller.edges[kind]) for i, j, kind in neighbours(blocks)])


def main_text(html: str | None, labeller: Labeller | None = None) -> str:
    """The page's content blocks, one a line."""
    blocks = blocks_of(html or "")
    kept = label_blocks(blocks, labeller or learn())[1] if blocks else []
    return "\n".join(b.text for b, k in zip(blocks, kept, strict=True) if k)


def _extract(pages: list[str | None], labeller: Labeller) -> dict[str, list]:
    texts = [main_text(h, labeller).encode("utf-8", "replace").decode() for h in pages]
    return {"text": texts, "n_chars": [len(t) for t in texts]}


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of the whole html of every row of ``pages``: page_id, url, text, n_chars.

    Null or empty html, and a page without content, give an empty text. Cut-off pages end where they
    end: open elements, comments and scripts run to there. Each row is judged by itself; an
    empty table gives an empty result. Other columns of ``pages`` are not read.
    """
    rows = pages.selectExpr(f"`{id_col}` AS page_id", f"`{url_col}` AS url", f"CAST(`{html_col}` AS string) AS html")
    labeller = learn()
    return map_texts(rows, "html", lambda htmls: _extract(htmls, labeller), "text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))


QUERIES = {"op9_html_text": op9_html_text}
SQL: dict[str, str] = {}
