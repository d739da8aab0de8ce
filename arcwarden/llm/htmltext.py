"""Main text of web pages by minimum-cut labelling.

A page is split into blocks, the runs of text between block-level tags. A logistic classifier gives each block the odds of
being content, from its shape (length, links, sentences, commas, headings) and its place (elements, class and id words and
roles of its ancestors). The odds become capacities from the source (content) or to the sink (boilerplate). Smoothness edges
tie neighbours in page order, the less the farther apart they are in the DOM, blocks of one container, and neighbours in one
article. Text beside an article or main element of at least its length leans to boilerplate. A minimum cut then labels all blocks at once, so that a short odd paragraph stays with its article, and a long advert
inside a menu goes with the menu.

The classifier starts from the weights of ``CutConfig`` and learns from the pages themselves: blocks inside ``article`` or
``main`` are taken for content, those of ``nav``, ``aside``, ``footer`` and page headers for boilerplate, and weights of shape
and class words are fitted to them, with the start as their prior; the weights of the elements that gave the labels stay.
Block tags other than headings say nothing, as a corpus that marks paragraphs one way would teach to drop all others.
The sample is bounded by ``sample_pages`` and ``sample_blocks``; without blocks of both kinds the start stands.

Scripts, styles, form controls and other parts that never hold reading matter are left out while parsing. A form, or an element
with a boilerplate class, around an article or main heading says nothing about what is in it. Character references are
decoded; white space inside a block becomes one space; blocks are joined in page order by one space.

Edge cases: a null html is empty; a page without content has an empty text; an unfinished tag at the end is dropped; unclosed
elements, skipped ones too, end where their parent does, and a skipped one that the page never closes also before the next
article or other section. Any depth of nesting takes time in proportion to the page. Repeated rows and extra columns pass
through; ``text`` and ``n_chars`` are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwarden.llm.common import positional, schema_with, small_batches, table

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>\x00]*)([^>]*+)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is never parsed as markup.
RAW = frozenset("script style title textarea iframe xmp noembed noframes plaintext".split())
#: Their content is markup, but no reading matter.
SKIPPED = frozenset("head noscript template svg math object canvas audio video select button datalist dialog map applet".split())
#: Inline elements don't end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split())
#: A start tag of the key ends open elements of the values within the nearest of the scopes.
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table tbody article section main div body aside nav header footer blockquote form".split())

#: Their start tags end a skipped element that has no end tag in the rest of the page.
SECTIONS = frozenset("article main section nav aside header footer".split())

NEGATIVE = frozenset("ad ads advert adverts advertisement advertising banner menu menus nav navbar navigation sidebar footer header masthead comment comments reply replies disqus discussion discussions responses respond talkback guestbook cookie cookies consent notice notices alert promo promotion sponsor sponsored recommended subscribe newsletter signup login popup modal overlay breadcrumb breadcrumbs pagination pager widget toolbar skip".split())
#: Names of boilerplate that parts of articles carry as well: they only lean towards it, and the neighbours decide.
AMBIGUOUS = frozenset("share sharing social related copyright legal disclaimer".split())
POSITIVE = frozenset("article content main post entry story body text".split())
NEGATIVE_ROLES = frozenset("navigation banner contentinfo complementary search menu alert dialog".split())
POSITIVE_ROLES = frozenset("main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: What an element's place says, inherited by all below it.
BOILER, HEADER, ARTICLE, BAD_ROLE, GOOD_ROLE, GOOD_NAME, WEAK_NAME = (1 << k for k in range(7))
FEATURES = ("bias", "length", "links", "sentence", "commas", "heading", "good_name", "bad_name", "weak_name", "boiler", "header", "article", "outside", "bad_role", "good_role", "form")
#: Weights that labels from elements can't teach: those of the elements themselves.
FIXED = frozenset("boiler header article outside bad_role good_role form".split())


def _start() -> dict[str, float]:
    return {"bias": -2.5, "length": 0.5, "links": -4.0, "sentence": 0.5, "commas": 0.5, "heading": 1.0, "good_name": 1.0, "bad_name": -11.0, "weak_name": -1.5, "boiler": -8.0, "header": -5.0, "article": 2.0, "outside": -3.0, "bad_role": -8.0, "good_role": 2.0, "form": -8.0}


@dataclass(frozen=True)
class CutConfig:
    """Start of the classifier, how far it may learn, and capacities of the smoothness edges."""

    start: dict[str, float] = field(default_factory=_start)
    #: About so many pages, and blocks of each, teach; together they weigh as much as ``evidence`` blocks, each weight's prior
    #: having the standard deviation ``spread``.
    sample_pages: int = 2000
    sample_blocks: int = 40
    evidence: float = 300.0
    spread: float = 0.7
    #: Capacities: of neighbours (halved at a DOM distance of two), of neighbours in one article, of one container's blocks.
    adjacent: float = 1.6
    together: float = 1.5
    siblings: float = 1.0
    seed: int = 13


@dataclass
class Block:
    text: str
    tag: str
    bits: int
    element: int
    container: int
    article: int
    depth: int
    distance: int  # to the block before it, in steps through the DOM
    link_share: float
    bad_name: bool = False
    form: bool = False
    #: Beside the page's article or main element, which has text of its own.
    outside: bool = False


def blocks(page: str) -> list[Block]:
    """The page's blocks in order."""
    out: list[Block] = []
    parts: list[str] = []
    link_chars = chars = 0
    in_link = False
    stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]  # name, bits, number, whether it is hidden
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack elements of a name, scopes and skipped elements stand
    scopes, skipped, articles = [0], [], [0]
    parent, bad, form, trusted = [0], [False], [False], [True]  # by element number
    last_end: dict[str, int] = {}
    low = last_depth = 1

    def flush() -> None:
        nonlocal link_chars, chars, low, last_depth
        if parts and (text := " ".join("".join(parts).split())):
            name, bits, number, _ = stack[-1]
            depth = len(stack)
            low = min(low, depth)
            out.append(Block(text, name, bits, number, parent[number], articles[-1], depth, last_depth + depth - 2 * low, link_chars / max(1, chars)))
            low = last_depth = depth
        parts.clear()
        link_chars = chars = 0

    def add(raw: str) -> None:
        nonlocal link_chars, chars
        if not stack[-1][3] and raw:
            parts.append(htmllib.unescape(raw) if "&" in raw else raw)
            n = len(raw.strip())
            chars += n
            link_chars += n * in_link

    def push(name: str, bits: int, hidden: bool, bad_name: bool) -> None:
        parent.append(stack[-1][2])
        bad.append(bad_name)
        form.append(name == "form")
        trusted.append(True)
        places[name].append(len(stack))
        for names, own in ((SCOPES, scopes), (SKIPPED, skipped)):
            if name in names:
                own.append(len(stack))
        if name in ("article", "main"):
            articles.append(len(parent) - 1)
        stack.append((name, bits, len(parent) - 1, hidden))
        if name in ("article", "main", "h1") and not bad_name:  # what stands around it isn't boilerplate because of its name
            number = parent[-1]
            while number and trusted[number]:
                trusted[number] = False
                number = parent[number]

    def cut_to(k: int) -> None:
        """End the elements from place ``k`` of the stack on."""
        nonlocal low
        for name, *_ in stack[k:]:
            places[name].pop()
            if name in ("article", "main"):
                articles.pop()
        for own in (scopes, skipped):
            while own and own[-1] >= k:
                own.pop()
        del stack[k:]
        low = min(low, k)

    def closes(name: str, at: int) -> bool:
        """Whether an end tag of the name stands at or after a place."""
        if name not in last_end:
            last_end[name] = max((m.start() for m in re.finditer(rf"</{name}[\s/>]", page, re.I)), default=-1)
        return last_end[name] >= at

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        after = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = close + 3 if close >= 0 else end
            continue
        if after in ("!", "?") or after == "/" and not page[lt + 2 : lt + 3].isalpha():
            close = page.find(">", lt)
            at = close + 1 if close >= 0 else end
            continue
        if not after:
            break
        if after != "/" and not (after.isascii() and after.isalpha()):
            add("<")
            at = lt + 1
            continue
        m = TAG.match(page, lt) or LOOSE_TAG.match(page, lt)
        if not m:
            break  # an unfinished tag
        at = m.end()
        closing, name, attributes = m[1], m[2].lower(), m[3]
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                close = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
                at = close.start() if close else end
            continue
        own_end = attributes.endswith("/")
        hidden = stack[-1][3]
        if hidden and not closing:
            first = skipped[0]
            if name == "body" or not closes(stack[first][0], at) and (name in SECTIONS or stack[first][0] == "head" and name not in VOID and name not in SKIPPED):
                cut_to(first)
                hidden = False
            elif own_end:
                continue
        if hidden and name in INLINE:
            continue
        if name in INLINE:
            if name == "a":
                in_link = not closing
            elif name == "br":
                parts.append(" ")
            continue
        flush()
        skips = name in SKIPPED and not closing and not own_end
        if not hidden and not skips:
            in_link = False
        if closing:
            found = places[name][-1] if places[name] else 0
            if found and not (name in ENDS and scopes[-1] > found):
                in_link = in_link and stack[found][3]  # an outer end tag ends links, that of a skipped element doesn't
                cut_to(found)
            continue
        if name in VOID:
            continue
        if name in ENDS or name in SCOPES:
            least = max(scopes[-1], skipped[-1] if skipped else 0)
            ended = [own[k] for e in ENDS.get(name, ("p",)) if (own := places[e]) and (k := bisect_right(own, least)) < len(own)]
            if ended:
                cut_to(min(ended))
        bits, bad_name = _place(name, attributes, stack[-1][1])
        push(name, bits, hidden or skips, bad_name)
    flush()
    under_bad, under_form = [False], [False]
    for number in range(1, len(parent)):
        under_bad.append(under_bad[parent[number]] or bad[number] and trusted[number])
        under_form.append(under_form[parent[number]] or form[number] and trusted[number])
    marked = sum(len(b.text) for b in out if b.bits & ARTICLE and not b.bits & BOILER)
    for block in out:
        block.bad_name, block.form = under_bad[block.element], under_form[block.element]
        block.outside = not block.bits & ARTICLE and marked >= len(block.text)
    return out


def _place(name: str, attributes: str, bits: int) -> tuple[int, bool]:
    """What an element below ``bits`` says about the blocks in it, and whether its names are those of boilerplate."""
    bad = False
    if name in ("nav", "aside", "menu", "footer"):
        bits |= BOILER
    elif name == "header" and not bits & ARTICLE:
        bits |= HEADER
    elif name in ("article", "main"):
        bits |= ARTICLE
    if attributes and name not in ("html", "body"):
        for key, *values in ATTRIBUTE.findall(attributes):
            value = next((v for v in values if v), "")
            if key.lower() == "role":
                role = value.strip().lower()
                bits |= BAD_ROLE if role in NEGATIVE_ROLES else GOOD_ROLE if role in POSITIVE_ROLES else 0
            else:
                names = {w.lower() for w in NAME_WORD.findall(value)}
                bad = bad or bool(names & NEGATIVE)
                bits |= GOOD_NAME if names & POSITIVE and not names & NEGATIVE else 0
                bits |= WEAK_NAME if names & AMBIGUOUS else 0
    return bits, bad


SENTENCE = re.compile(r"[.!?…。](?:\s|$)")


def features(block: Block) -> tuple[float, ...]:
    """The numbers that the classifier looks at, in the order of ``FEATURES``."""
    words = block.text.count(" ") + 1
    has = lambda bit: float(bool(block.bits & bit))
    return (
        1.0, min(5.0, math.log2(1 + words)), block.link_share, float(bool(SENTENCE.search(block.text))), min(1.0, 10 * block.text.count(",") / words),
        float(block.tag in HEADINGS), has(GOOD_NAME), float(block.bad_name), has(WEAK_NAME), has(BOILER), has(HEADER), has(ARTICLE), float(block.outside), has(BAD_ROLE), has(GOOD_ROLE), float(block.form),
    )


def element_label(block: Block) -> int | None:
    """1 or 0 where the elements around a block say that it is content or boilerplate, else None."""
    if block.bits & (BOILER | HEADER):
        return 0
    return 1 if block.bits & ARTICLE and not block.bad_name and not block.form else None


def fit(pages: DataFrame, config: CutConfig = CutConfig()) -> tuple[float, ...]:
    """Weights of the classifier, learned from a bounded sample of ``pages(page_id, url, html)``."""
    start = np.array([config.start[f] for f in FEATURES])
    small_batches(pages.sparkSession)
    n = pages.count()
    hashed = pages.select("html", F.xxhash64("page_id", "url", "html", F.lit(config.seed)).alias("h")).where("html is not null")
    drawn = hashed.where(F.pmod("h", F.lit(1 << 24)) < F.lit(float(config.sample_pages) / max(1, n) * (1 << 24))).dropDuplicates(["h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for html in batch.column(0):
                labelled = [(x, b) for b in blocks(html.as_py()) if (x := element_label(b)) is not None]
                step = max(1, -(-len(labelled) // config.sample_blocks))
                rows += [(*features(b), float(x)) for x, b in labelled[::step]]
            yield pa.RecordBatch.from_arrays([pa.array([list(r) for r in rows], pa.list_(pa.float64()))], ["row"])

    rows = sorted(tuple(r["row"]) for r in drawn.mapInArrow(run, "row array<double>").collect())
    if len({r[-1] for r in rows}) < 2:
        return tuple(start.tolist())
    x, y = np.array(rows)[:, :-1], np.array(rows)[:, -1]
    learns = np.array([f not in FIXED for f in FEATURES])
    z, prior = x[:, learns], start[learns]
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y == 0).sum()) * config.evidence
    w, penalty = prior.copy(), np.eye(len(prior)) / config.spread**2
    for _ in range(30):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (share * (p - y)) + penalty @ (w - prior)
        w = w - np.linalg.solve((z * (share * p * (1 - p))[:, None]).T @ z + penalty, gradient)
    start[learns] = w
    return tuple(start.tolist())


def block_costs(found: list[Block], weights: tuple[float, ...]) -> list[float]:
    """Log odds of content, weighted by length, as longer blocks are surer and matter more; not beyond 8 either way."""
    return [max(-8.0, min(8.0, sum(w * x for w, x in zip(weights, row, strict=True)))) * (0.5 + 0.2 * row[1]) for row in map(features, found)]


def block_edges(found: list[Block], config: CutConfig) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours by DOM distance, more so inside one article, and blocks of one container."""
    edges, last = [], {}
    for k, block in enumerate(found):
        if k:
            near = config.adjacent * 2 / (2 + block.distance)
            edges.append((k - 1, k, near + (config.together if block.article and block.article == found[k - 1].article else 0.0)))
        if block.container in last:
            edges.append((last[block.container], k, config.siblings))
        last[block.container] = k
    return edges


def min_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source: maximum flow by level graphs and blocking flows.

    A positive ``unary`` is what is left of the edge from the source, a negative one of the edge to the sink, after the flow
    that takes only those two; ``edges`` are undirected.
    """
    excess = list(unary)
    to: list[int] = []
    room: list[float] = []
    at: list[list[int]] = [[] for _ in unary]
    for i, j, capacity in edges:
        at[i].append(len(to))
        to.append(j)
        room.append(capacity)
        at[j].append(len(to))
        to.append(i)
        room.append(capacity)
    tiny = 1e-9
    while True:
        level = [-1] * len(excess)
        queue = [i for i, e in enumerate(excess) if e > tiny]
        for i in queue:
            level[i] = 0
        reached = False
        for i in queue:
            if excess[i] < -tiny:
                reached = True
                continue
            for k in at[i]:
                if room[k] > tiny and level[to[k]] < 0:
                    level[to[k]] = level[i] + 1
                    queue.append(to[k])
        if not reached:
            return [x >= 0 for x in level]
        arc = [0] * len(excess)
        for source in [i for i, e in enumerate(excess) if e > tiny]:
            path: list[int] = []
            node = source
            while excess[source] > tiny:
                if excess[node] < -tiny:
                    amount = min(excess[source], -excess[node], *[room[k] for k in path])
                    excess[source] -= amount
                    excess[node] += amount
                    for k in path:
                        room[k] -= amount
                        room[k ^ 1] += amount
                    path, node = [], source
                    continue
                arcs = at[node]
                while arc[node] < len(arcs) and not (room[arcs[arc[node]]] > tiny and level[to[arcs[arc[node]]]] == level[node] + 1):
                    arc[node] += 1
                if arc[node] < len(arcs):
                    path.append(arcs[arc[node]])
                    node = to[path[-1]]
                elif path:
                    node = to[path.pop() ^ 1]
                    arc[node] += 1
                else:
                    break


def main_text(page: str | None, weights: tuple[float, ...] | None = None, config: CutConfig = CutConfig()) -> str:
    """The blocks that the cut leaves with the content, joined by one space."""
    found = blocks(page or "")
    if not found:
        return ""
    content = min_cut(block_costs(found, weights or tuple(config.start[f] for f in FEATURES)), block_edges(found, config))
    return " ".join(b.text for b, kept in zip(found, content, strict=True) if kept)


def extract_text(pages: DataFrame, config: CutConfig = CutConfig(), weights: tuple[float, ...] | None = None) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` in place of ``html``; without ``weights`` they are learned from ``pages``."""
    pages = pages.drop("text", "n_chars")
    weights = weights or fit(pages, config)
    plain, names = positional(pages)
    at, others = plain.columns.index(names["html"]), [c for c in pages.columns if c != "html"]
    rest = plain.drop(names["html"])
    columns = [*rest.columns, "text", "n_chars"]
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py(), weights, config) for v in batch.column(at)]
            kept = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], columns)

    return plain.mapInArrow(run, schema_with(rest, "text string, n_chars long")).toDF(*others, "text", "n_chars")


def op4_htmltext(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
