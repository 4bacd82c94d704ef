"""Main text of web pages: boosted trees over DOM nodes, decoded along the hierarchy.

Every element gets features of its subtree (text, links, text for each element), of
its attributes (tokens that speak for or against content), of its depth and
siblings, and of its ancestors. Boosted trees give its log odds of being content.
Decoding gives every element one of three states: main (its text counts), mixed (a
container without text of its own) or out. Below out all is out, below main all is
main or out; of all assignments that obey this the one with the largest sum of log
odds is taken, so no element is kept inside a rejected one. Inline elements (links,
emphasis) go with the block they are in.

Training, at most `SAMPLE_PAGES` pages: layouts (the containers of a page with their
attributes) are counted over all pages; the commonest are in the sample, each by its
share and once at least. Elements are labelled by the semantic markup around them; where
a page has none, by attribute tokens for content, else by the block with most text in
paragraphs. The same content set into other page layouts, with the labels known, keeps
the trees from leaning on one layout. If no page gives labels of both kinds, invented
content in such layouts takes their place.

Text: character references are decoded, white space inside a block becomes one
space, blocks follow each other by line ends. Scripts, styles, comments and markup
are never text.

Edge cases: null html is empty and gives empty text. Unclosed, crossed and cut-off
tags are closed as browsers do, roughly. Repeated rows are extracted one by one. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from absentia.llm.boosting import Boosted, boost
from absentia.llm.texts import map_batches, slices
from absentia.sources.storage import settle

SAMPLE_PAGES = 200
MIXED_COST = 0.05
# Characters of paragraphs that make a block content by themselves, and how many layouts
# of invented content stand in for labels.
DENSE_CHARS = 140
INVENTED_PAGES = 100

# Element names and attribute tokens of the web.
_CONTAINERS = r"(?i)<((?:body|main|article|section|div|nav|header|footer|aside|form|table)\b[^>]*)>"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg select option".split())
_INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small "
    "span strike strong sub sup time tt u var wbr br".split()
)
_CONTENT_TAGS = frozenset(("article", "main"))
_OTHER_TAGS = frozenset("nav header footer aside form button menu dialog fieldset".split())
_CONTENT_TOKENS = frozenset("article content entry main post story text body".split())
_OTHER_TOKENS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent "
    "contentinfo cookie cookies copyright discussion disqus feedback foot footer form gdpr head header "
    "login masthead menu menubar meta modal nav navbar navigation newsletter notice notices notification "
    "overlay pager pagination popup promo promoted promotion recommended related replies reply respond "
    "responses search share sharing side sidebar signup skip social sponsor sponsored subscribe tags "
    "teaser toolbar top topbar logo brand widget widgets".split()
)
_KINDS = {"p": 1, "h1": 2, "h2": 2, "h3": 2, "h4": 2, "h5": 2, "h6": 2, "li": 3, "td": 4, "th": 4,
          "blockquote": 1, "pre": 1, "ul": 5, "ol": 5, "table": 5}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
# One attribute after the other, each with its value, so that values are never names.
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
# A slash at the end that is not part of a value without quotes.
_SELF_CLOSED = re.compile(r"(?<!\S)/\s*\Z|[\"']/\s*\Z|(?:\A|\s)[^\s=\"']*/\s*\Z")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Element:
    tag: str
    parent: int
    depth: int
    content: int = 0
    other: int = 0
    marked: int = -1
    # Where it is in the page: its tag's start and end, its content's end, its own end.
    span: list[int] = field(default_factory=lambda: [0, 0, -1, -1])
    children: list[int] = field(default_factory=list)


@dataclass
class Page:
    """Elements in page order, and pieces of text as (element, text), text None for a
    break between blocks."""

    elements: list[Element]
    pieces: list[tuple[int, str | None]]


def parse(html: str, mark: str | None = None) -> Page:
    """mark: the attribute that holds training marks, if the page has any."""
    elements = [Element("#page", -1, 0)]
    pieces: list[tuple[int, str | None]] = []
    now, at, known = 0, 0, {}

    def close(to: int, start: int, end: int):
        """Up to `to`; the outermost one closed ends at `end`, behind its end tag."""
        nonlocal now
        while now != to:
            elements[now].span[2:] = start, end if elements[now].parent == to else start
            if elements[now].tag not in _INLINE:
                pieces.append((now, None))
            now = elements[now].parent

    def nearest(names, stop=()) -> int | None:
        node = now
        while node > 0:
            if elements[node].tag in names:
                return node
            if elements[node].tag in stop:
                return None
            node = elements[node].parent
        return None

    # Always from the end of what was read, so that nothing in a raw element begins a tag.
    while (m := _MARKUP.search(html, at)) is not None:
        if m.start() > at:
            pieces.append((now, html[at : m.start()]))
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            found = nearest((name,))
            if found is not None:
                close(elements[found].parent, m.start(), at)
            continue
        if name in _VOID:
            pieces.append((now, " " if name in _INLINE else None))
            continue
        if name in _RAW:
            if name == "svg" and _SELF_CLOSED.search(m.group(3)):
                continue
            if name == "option":
                # Ended by itself, by the next one, or with an element around it.
                around, node = {"datalist", "select"}, now
                while node > 0:
                    around.add(elements[node].tag)
                    node = elements[node].parent
                ends = "|".join(map(re.escape, sorted(around)))
                end = re.compile(rf"</option\s*>?|(?=<option\b|<optgroup\b|</(?:optgroup|{ends})[\s/>])", re.I).search(html, at)
            else:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name not in _INLINE:
            # A block ends an open paragraph; items and cells end their like.
            if (open_p := nearest(("p",), ("table", "li", "div", "section"))) is not None:
                close(elements[open_p].parent, m.start(), m.start())
            like = {"li": (("li",), ("ul", "ol")), "td": (("td", "th"), ("tr", "table")),
                    "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)),
                    "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",))}.get(name)
            if like and (same := nearest(*like)) is not None:
                close(elements[same].parent, m.start(), m.start())
            pieces.append((now, None))
        raw = m.group(3)
        if raw and not raw.isspace():
            found = known.get(raw)
            if found is None:
                found = known[raw] = _tokens(raw, mark)
            content, other, marked = found
        else:
            content, other, marked = 0, 0, -1
        child = Element(name, now, elements[now].depth + 1, content, other, marked, [m.start(), m.end(), -1, -1])
        elements[now].children.append(len(elements))
        elements.append(child)
        now = len(elements) - 1
    if at < len(html):
        pieces.append((now, html[at:]))
    close(0, len(html), len(html))
    return Page(elements, pieces)


def _tokens(raw: str, mark: str | None = None) -> tuple[int, int, int]:
    """Tokens of class, id and role for content and against it; a training mark."""
    content = other = 0
    marked = -1
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        value = a or b or c
        if name == mark:
            marked = int(value == "1")
        elif name.lower() in ("class", "id", "role"):
            words = {w.lower() for w in _TOKEN.findall(value)}
            content += len(words & _CONTENT_TOKENS)
            other += len(words & _OTHER_TOKENS)
    return content, other, marked


N_FEATURES = 19


def features(page: Page) -> np.ndarray:
    """One row for each element; all but the first are elements of the page."""
    e = page.elements
    n = len(e)
    own, links = np.zeros(n), np.zeros(n)
    for node, text in page.pieces:
        if text is not None:
            own[node] += len(text) - text.count(" ")
    parent = np.array([x.parent for x in e])
    tag_side = np.array([(x.tag in _CONTENT_TAGS) - (x.tag in _OTHER_TAGS) for x in e], float)
    content = np.array([x.content for x in e], float)
    other = np.array([x.other for x in e], float)
    is_link = [x.tag == "a" for x in e]
    total, size = own.copy(), np.ones(n)
    links[:] = np.where(is_link, own, 0.0)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        total[p] += total[i]
        size[p] += size[i]
        links[p] += total[i] if is_link[i] else links[i]
    near_tag, near_token = tag_side.copy(), np.sign(content - 2 * other)
    bad, good = (tag_side < 0) + other, (tag_side > 0) + content
    for i in range(1, n):
        p = parent[i]
        if not near_tag[i]:
            near_tag[i] = near_tag[p]
        if not near_token[i]:
            near_token[i] = near_token[p]
        bad[i] += bad[p]
        good[i] += good[p]
    place, siblings, alike, beside = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for x in e:
        if x.children:
            k = len(x.children)
            mean = sum(total[c] for c in x.children) / k
            tags: dict[str, int] = {}
            for c in x.children:
                tags[e[c].tag] = tags.get(e[c].tag, 0) + 1
            for j, c in enumerate(x.children):
                place[c], siblings[c], beside[c] = j / k, k, mean
                alike[c] = tags[e[c].tag] / k
    before = np.cumsum(own) - own
    return np.stack([
        np.array([x.depth for x in e], float), np.log1p(own), np.log1p(total),
        links / np.maximum(total, 1), np.log1p(total / size),
        np.array([len(x.children) for x in e], float), siblings, place, alike, np.log1p(beside),
        tag_side, content, other, near_tag, near_token, np.minimum(bad, 3), np.minimum(good, 3),
        np.array([_KINDS.get(x.tag, 6 if x.tag in _INLINE else 0) for x in e], float),
        before / max(total[0], 1),
    ], axis=1)


_OUT, _MIXED, _MAIN = 0, 1, 2


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """The best state of each element that no ancestor contradicts."""
    e = page.elements
    n = len(e)
    has_text = np.zeros(n, bool)
    for node, text in page.pieces:
        if text is not None and not text.isspace():
            has_text[node] = True
    best = np.zeros((n, 3))
    best[:, _OUT], best[:, _MAIN] = -odds, odds
    # A container costs a little, so that nothing is one for its own sake.
    best[:, _MIXED] = np.where(has_text, -np.abs(odds), 0.0) - MIXED_COST
    best[0] = (-1e9, 0.0, -1e9)
    # Inline elements of a main block go with it, unless their attributes speak against it.
    goes_along = [x.tag in _INLINE and not x.other for x in e]
    for i in range(n - 1, 0, -1):
        p = e[i].parent
        out, mixed, main = best[i]
        best[p, _OUT] += out
        best[p, _MIXED] += max(out, mixed, main)
        best[p, _MAIN] += main - odds[i] if goes_along[i] else max(out, main)
    state = np.zeros(n, np.int64)
    state[0] = _MIXED
    for i in range(1, n):
        above = state[e[i].parent]
        out, mixed, main = best[i]
        if above == _MIXED:
            state[i] = int(np.argmax(best[i]))
        elif above == _MAIN:
            state[i] = _MAIN if goes_along[i] or main > out else _OUT
    return state


def text_of(page: Page, keep: np.ndarray) -> str:
    blocks, run = [], []

    def flush():
        text = " ".join(entities.unescape("".join(run)).split())
        if text:
            blocks.append(text)
        run.clear()

    for node, text in page.pieces:
        if text is None:
            flush()
        elif keep[node]:
            run.append(text)
    flush()
    return "\n".join(blocks)


def extract(html: str, model: Boosted) -> str:
    return extract_all([html], model)[0]


def extract_all(pages: list[str], model: Boosted) -> list[str]:
    """The main text of each page; the trees run over all their elements at once."""
    parsed = [parse(h) for h in pages]
    if not parsed:
        return []
    found = [features(p) for p in parsed]
    odds = model.log_odds(np.concatenate(found))
    ends = np.cumsum([len(f) for f in found])
    return [
        text_of(p, decode(p, o) == _MAIN) for p, o in zip(parsed, np.split(odds, ends[:-1]))
    ]


# Training.

def _speaks_against(x: Element) -> bool:
    return x.tag in _OTHER_TAGS or (x.other > 0 and x.tag not in _CONTENT_TAGS)


def _content_roots(page: Page) -> set[int]:
    """Elements that hold the content: by their names, else by their attributes, else the
    block with most text in its own paragraphs."""
    e = page.elements
    n = len(e)
    out, own, prose, beyond_links = np.zeros(n, bool), np.zeros(n), np.zeros(n), np.ones(n, bool)
    for i, x in enumerate(e[1:], 1):
        out[i] = out[x.parent] or _speaks_against(x)
        beyond_links[i] = beyond_links[x.parent] and x.tag != "a"
    named = {i for i, x in enumerate(e) if x.tag in _CONTENT_TAGS and not out[i]}
    if named:
        return named
    for node, text in page.pieces:
        if text is not None and beyond_links[node]:
            own[node] += len(text) - text.count(" ")
    for i in range(n - 1, 0, -1):
        own[e[i].parent] += own[i] if e[i].tag in _INLINE else 0
    # Text in paragraphs: of a block's own, and of all below it.
    below = np.zeros(n)
    for i in range(n - 1, 0, -1):
        if _KINDS.get(e[i].tag) in (1, 2) and not out[i]:
            prose[e[i].parent] += own[i]
            below[i] += own[i]
        below[e[i].parent] += 0 if out[i] else below[i]
    able = [i for i, x in enumerate(e) if i and not out[i] and x.tag not in ("html", "body")
            and x.tag not in _INLINE]
    told = [i for i in able if e[i].content > 0 and below[i] > 0]
    if told:
        most = max(below[i] for i in told)
        return {i for i in told if 2 * below[i] >= most}
    dense = max((i for i in range(n) if not out[i]), key=lambda i: (prose[i], -i))
    if prose[dense] < DENSE_CHARS:
        return set()
    # Paragraphs right below the body are content, not all else that is there.
    if dense in able:
        return {dense}
    return {c for c in e[dense].children if _KINDS.get(e[c].tag) in (1, 2) and not out[c]}


def _labels(page: Page) -> np.ndarray:
    """1 in content, 0 out of it, -1 unknown: by marks, else by what the page tells."""
    e = page.elements
    out = np.full(len(e), -1)
    marks = any(x.marked >= 0 for x in e)
    roots = set() if marks else _content_roots(page)
    for i, x in enumerate(e[1:], 1):
        if marks:
            own = x.marked
        else:
            own = 0 if _speaks_against(x) else 1 if i in roots else -1
        above = out[x.parent]
        out[i] = 0 if above == 0 else own if own >= 0 else above
    return out


def _content(html: str) -> str | None:
    """The markup of a page's content, without what is labelled as none."""
    found = _ARTICLE.search(html)
    if found:
        return found.group(1)
    page = parse(html)
    e, y = page.elements, _labels(page)
    parts = []
    for i, x in enumerate(e[1:], 1):
        if y[i] == 1 and y[x.parent] != 1:
            paragraph = _KINDS.get(x.tag) in (1, 2)
            at, end = (x.span[0], x.span[3]) if paragraph else (x.span[1], x.span[2])
            for j in range(i + 1, len(e)):
                if e[j].span[0] >= end:
                    break
                if y[j] == 0 and y[e[j].parent] == 1:
                    parts.append(html[at : e[j].span[0]])
                    at = e[j].span[3]
            parts.append(html[at:end])
    return "".join(parts) if parts else None


_ARTICLE = re.compile(r"<article\b[^>]*>(.*?)</article>", re.S | re.I)


def _mark_for(html: str) -> str:
    """A name for training marks that the page itself has nowhere."""
    mark = "y"
    while mark in html:
        mark += "y"
    return mark


def _other_layout(html: str, rng: random.Random, mark: str = "y") -> str | None:
    """The content of a page within another layout, marked by the attribute `mark`."""
    body = _content(html)
    return None if body is None else _layout(body, rng, mark)


def _invented(rng: random.Random) -> str:
    """A heading and paragraphs of words that mean nothing."""
    def some(a: int, b: int) -> str:
        return " ".join("x" * rng.randint(2, 9) for _ in range(rng.randint(a, b)))

    return f"<h1>{some(2, 8)}</h1>" + "".join(f"<p>{some(10, 90)}.</p>" for _ in range(rng.randint(2, 12)))


def _layout(body: str, rng: random.Random, mark: str) -> str:
    words = re.sub(r"<[^>]*>", " ", body).split() or ["x"]

    def some(a: int, b: int) -> str:
        return " ".join(rng.choice(words) for _ in range(rng.randint(a, b)))

    def links(n: int) -> str:
        return "".join(f'<li><a href="#">{some(1, 3)}</a></li>' for _ in range(n))

    def box(choices: list[str], inner: str) -> str:
        tag, _, attributes = rng.choice(choices).partition(" ")
        return f'<{tag} {attributes} {mark}="0">{inner}</{tag}>'

    def maybe(text: str, chance: float = 0.6) -> str:
        return text if rng.random() < chance else ""

    menu = box(["nav", 'div class="menu"', 'ul id="nav"', 'div role="navigation"'], f"<ul>{links(rng.randint(3, 9))}</ul>")
    head = box(["header", 'div id="header"', 'div class="site-head"'], f"<p>{some(2, 8)}</p>")
    foot = box(["footer", 'div id="footer"', 'div class="foot"'], f"<p>&copy; {some(4, 20)}</p>")
    side = box(["aside", 'div class="sidebar"', 'div id="side"'], f"<h3>{some(1, 4)}</h3><p>{some(8, 40)}</p>")
    note = box(['div class="cookie-notice"', 'div class="notice"', 'div id="consent"'], f"<p>{some(5, 25)}</p>")
    advert = box(['div class="ad"', 'div class="advert"', 'section class="sponsored"'], f"<p>{some(4, 30)}</p>")
    form = box(["form", 'div class="newsletter"'], f"<label>{some(2, 6)}</label><button>{some(1, 2)}</button>")
    talk = box(['section class="comments"', 'div id="comments"', 'div class="replies"'],
               "".join(f"<div><p>{some(6, 40)}</p></div>" for _ in range(rng.randint(1, 5))))
    more = box(['div class="related"', 'div class="share"'], f"<ul>{links(rng.randint(2, 5))}</ul>")
    inside = maybe(advert, 0.3) + maybe(form, 0.2) + maybe(talk, 0.3) + maybe(more, 0.3)
    tag, _, attributes = rng.choice([
        "article", "main", 'div class="post-content"', 'div id="content"', 'section class="entry"',
        'div class="story"', "div",
    ]).partition(" ")
    middle = f'<{tag} {attributes} {mark}="1">{body}{inside}</{tag}>'
    if rng.random() < 0.4:
        middle = f"<div>{middle}{maybe(side)}{maybe(talk, 0.3)}</div>"
    return (
        f"<html><body>{maybe(note, 0.4)}{maybe(head)}{maybe(menu)}{maybe(advert, 0.4)}{middle}"
        f"{maybe(side, 0.4)}{maybe(talk, 0.3)}{maybe(form, 0.3)}{foot}</body></html>"
    )


def _sample(pages: DataFrame, limit: int) -> list[str]:
    """At most `limit` different pages, of the commonest layouts, each by its share."""
    own = pages.where(F.col("html").isNotNull()).withColumn("h", F.xxhash64("page_id", "html"))
    tags = F.regexp_extract_all(F.col("html"), F.lit(_CONTAINERS), 1)
    # Numbers in attributes are those of the page, not of its layout.
    tags = F.array_sort(F.array_distinct(F.transform(tags, lambda t: F.regexp_replace(t, "[0-9]+", ""))))
    prints = settle(own.select(F.xxhash64(F.array_join(tags, " ")).alias("layout"), "h"), "layouts")
    sizes = prints.groupBy("layout").agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n"), "layout").limit(limit).collect()
    if not top:
        return []
    free, every = limit - len(top), sum(r.n for r in top)
    # Whole parts of what is left after one each; the commonest first get the rest.
    quota = {r.layout: 1 + free * r.n // every for r in top}
    for r in top[: limit - sum(quota.values())]:
        quota[r.layout] += 1
    # More by hash first, so that no task ranks many.
    thin = [(r.layout, quota[r.layout], int(min(1.0, (2 * quota[r.layout] + 20) / r.n) * (1 << 40))) for r in top]
    spark = pages.sparkSession
    few = spark.createDataFrame(thin, "layout long, quota long, share long")
    ranked = prints.join(F.broadcast(few), "layout").where(F.pmod("h", F.lit(1 << 40)) < F.col("share")).distinct()
    rank = F.row_number().over(Window.partitionBy("layout").orderBy(F.pmod("h", F.lit(1 << 40)), "h"))
    chosen = [r.h for r in ranked.withColumn("rank", rank).where("rank <= quota").select("h").collect()]
    wanted = F.broadcast(spark.createDataFrame([(h,) for h in chosen], "h long"))
    found = own.select("h", "html").join(wanted, "h").dropDuplicates(["h"]).collect()
    return [r.html for r in sorted(found, key=lambda r: (r.h, r.html))]


def train(pages: DataFrame, limit: int = SAMPLE_PAGES) -> Boosted:
    """Trees from at most `limit` pages, on the driver."""
    rng, xs, ys = random.Random(0), [], []

    def learn(html: str, mark: str | None):
        page = parse(html, mark)
        y = _labels(page)
        xs.append(features(page)[y >= 0])
        ys.append(y[y >= 0])

    chosen = _sample(pages, limit)
    for html in chosen:
        mark = _mark_for(html)
        others = [_other_layout(html, rng, mark) for _ in range(2)]
        learn(html, None)
        for other in others:
            if other is not None:
                learn(other, mark)
    if not chosen:
        return Boosted(0.0, [])
    if len(set(np.concatenate(ys))) < 2:
        for _ in range(INVENTED_PAGES):
            learn(_layout(_invented(rng), rng, "y"), "y")
    return boost(np.concatenate(xs), np.concatenate(ys).astype(float))


def main_text(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    trees = train(pages) if model is None else model

    def run(batches):
        for rows, texts in slices(batches, "html"):
            found = extract_all([t.decode("utf-8", "replace") for t in texts], trees)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(found, pa.string()),
                 pa.array([len(t) for t in found], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    return map_batches(source, run, "page_id long, url string, text string, n_chars long")
