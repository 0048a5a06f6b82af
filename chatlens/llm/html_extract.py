"""Main text of web pages by minimum-cut labelling of their text blocks.

A linear classifier gives every block a cost of being called content and one
of being called boilerplate; these are its terminal capacities.  Neighbours on
the page and blocks close together in the DOM are joined by smoothness
edges.  The minimum cut is the labelling of least total cost.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.tables import small_batches

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes svg math canvas object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong "
                   "sub sup time tt u var wbr img br input button select option output meter progress audio video picture map area nobr".split())
#: Elements that a new one closes, and those beyond which it does not look.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = frozenset("ul ol dl table body article section div main".split())
#: What may stand in a head; any other element, and any text, ends it.
HEAD = frozenset("head title meta link base style script noscript template basefont bgsound".split())
#: Blocks that hold one text; their parent is where they belong.
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li pre td blockquote".split())

#: Weights of the classifier: positive for content.
TAGS = {"nav": -9.0, "aside": -8.0, "footer": -8.0, "header": -5.0, "form": -8.0, "button": -8.0, "select": -9.0, "menu": -8.0, "dialog": -8.0,
        "figcaption": -0.5, "label": -3.0, "address": -1.0, "article": 4.0, "main": 3.0, "p": 1.0, "pre": 1.0, "blockquote": 1.0,
        "h1": 2.0, "h2": 1.0, "h3": 1.0, "h4": 0.5, "li": -0.5, "td": -0.5}
BAD_NAMES = frozenset("ad ads advert advertisement adverts advertising adbox adsense banner sponsor sponsored promo promotion promoted cookie cookies consent notice "
                      "notices alert gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social sidebar related "
                      "recommend recommended recommendations comment comments reply replies respond disqus breadcrumb breadcrumbs pagination pager menu nav "
                      "navbar navigation footer masthead copyright search widget widgets toolbar hidden tags sitemap topbar".split())
GOOD_NAMES = frozenset("article content post entry story main body text".split())
#: Parts of a class that says something about its page: ``has-sidebar`` is no sidebar.
STATES = frozenset("has no not with without is enabled disabled open closed supports show hide".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NAME_WEIGHT, GOOD_WEIGHT, ROLE_WEIGHT = -9.0, 2.0, -9.0
LINK_WEIGHT, LENGTH_WEIGHT, STOP_WEIGHT, BIAS = -5.0, 0.4, 0.5, -1.5
#: Capacity of an edge between blocks of one parent, less by distance.
NEXT, KIN = 1.0, 0.8


class Element:
    """An element of the page and what lies around it; blocks share the elements above them."""

    __slots__ = ("above", "tag", "names", "home", "depth", "wraps", "plain", "seen", "total", "named")

    def __init__(self, above: Element | None, tag: str, names: float):
        self.above, self.tag, self.names = above, tag, names
        self.home = above.home if above and tag in INLINE else self  # the innermost element that isn't inline
        self.depth = above.home.depth + 1 if above and self.home is self else 0
        self.wraps, self.plain, self.seen, self.total, self.named = False, 0, frozenset(), 0.0, 0.0

    def up(self) -> Element:
        return self.above.home


class Block:
    __slots__ = ("text", "place", "linked")

    def __init__(self, text: str, place: Element, linked: int):
        self.text, self.place, self.linked = text, place, linked


def name_weight(value: str) -> float:
    """Weight of a class list or id: whole names count, by their parts."""
    weight = 0.0
    for name in value.split():
        parts = {x.lower() for x in _PART.findall(name)}
        if parts & BAD_NAMES and not parts & STATES:
            return NAME_WEIGHT
        if parts & GOOD_NAMES:
            weight = GOOD_WEIGHT
    return weight


def weigh(elements: list[Element], found: list[Block]) -> None:
    """Sum up, from the page downwards, what the tags and names around each element say.

    An element that wraps the page's main part says nothing by its names, nor
    as a form: one around a ``main`` or the page's only ``article``, and on pages
    with neither, one that holds most of the unlinked text.
    """
    cores = [e for e in elements if e.tag == "main"] or [e for e in elements if e.tag == "article"]
    if cores and (cores[0].tag == "main" or len(cores) == 1):
        for e in cores:
            while e and not e.wraps:
                e.wraps, e = True, e.above
    else:
        for b in found:
            b.place.plain += len(b.text) - b.linked
        for e in reversed(elements[1:]):  # each comes after the one above it
            e.above.plain += e.plain
        for e in elements:
            e.wraps = e.tag in ("html", "body") or e.tag != "article" and 2 * e.plain > elements[0].plain
    for e in elements[1:]:
        names = 0.0 if e.wraps and e.names < 0 else e.names
        e.named = min(e.above.named, names) if names < 0 or e.above.named < 0 else max(e.above.named, names)
        weight = TAGS.get(e.tag, 0.0)
        e.seen, e.total = e.above.seen, e.above.total
        if weight and e.tag not in e.seen and not (e.tag == "form" and e.wraps) and not (e.tag == "header" and e.seen & {"article", "main"}):
            e.seen, e.total = e.seen | {e.tag}, e.total + weight


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order, each with the elements around it.

    Unclosed and misnested markup is taken as a browser would for text: a new
    block closes an open paragraph, a list item the one before, an end tag all
    that is still open inside, and what can't be in a head ends it.  Raw
    elements and the head have no text.
    """
    out: list[Block] = []
    elements = [Element(None, "", 0.0)]
    stack: list[Element] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked = at = in_head = anchors = 0
    size = len(page)

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, stack[-1] if stack else elements[0], min(linked, len(text))))
            parts, linked = [], 0

    def say(raw: str) -> None:
        nonlocal linked
        if in_head and raw and not raw.isspace():
            end_head()
        if raw and not in_head:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if anchors:
                linked += len(text.strip())

    def close(to: int) -> None:
        nonlocal in_head, anchors
        for e in stack[to:]:
            opened[e.tag] -= 1
            in_head -= e.tag == "head"
            anchors -= e.tag == "a"
        del stack[to:]

    def end_head() -> None:
        flush()
        close(next(k for k, e in enumerate(stack) if e.tag == "head"))

    while at < size:
        m = _MARKUP.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at: m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ending, rest = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if ending:
            if tag not in INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        if in_head and tag not in HEAD:
            end_head()
        if tag in RAW:
            if rest.rstrip().endswith("/") and tag in ("svg", "math"):
                continue
            end = re.compile(rf"</{re.escape(tag)}[\s>/]", re.I).search(page, at)
            if end is None:
                if tag in ("svg", "math", "object", "canvas", "noscript"):
                    continue
                break
            stop = page.find(">", end.end() - 1)
            at = size if stop < 0 else stop + 1
            continue
        if tag == "br":
            say(" ")
            continue
        if tag not in INLINE:
            flush()
            shut = CLOSES.get(tag, ())
            for k in range(len(stack) - 1, -1, -1):
                name = stack[k].tag
                if name in shut or name == "p" and tag not in ("tr", "td", "th"):
                    close(k)
                    break
                if name in SCOPE and name not in shut:
                    break
        if tag in VOID:
            continue
        weight = 0.0
        if rest:
            for name, x, y, z in _ATTRIBUTE.findall(rest):
                name, value = name.lower(), x or y or z
                if name in ("class", "id"):
                    weight += name_weight(value)
                elif (name == "role" and value.lower() in BAD_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true"
                      or name == "style" and "display:none" in value.lower().replace(" ", "")):
                    weight += ROLE_WEIGHT
        if not rest.rstrip().endswith("/") or tag not in INLINE:
            elements.append(Element(stack[-1] if stack else elements[0], tag, weight))
            stack.append(elements[-1])
            opened[tag] += 1
            in_head += tag == "head"
            anchors += tag == "a"
    flush()
    weigh(elements, out)
    return out


def score(block: Block) -> float:
    """Log-odds that a block is content."""
    n = len(block.text)
    total = BIAS + block.place.total + block.place.named + LENGTH_WEIGHT * min(5.0, n / 40) + LINK_WEIGHT * block.linked / n
    return total + (STOP_WEIGHT if block.text[-1] in ".!?:;\"'”»)" else 0.0)


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours on the page, and the next block with the same parent."""
    out: list[tuple[int, int, float]] = []
    last: dict[Element, int] = {}
    before = None
    for i, b in enumerate(found):
        home = b.place.home
        home = home.up() if home.tag in LEAF else home
        if before is not None:
            x, y, steps = before, home, 0
            while x is not y:  # up to where both meet, over what was closed and opened between them
                steps += 1
                if x.depth >= y.depth:
                    x = x.up()
                else:
                    y = y.up()
            out.append((i - 1, i, NEXT / (1 + steps)))
        if home in last and last[home] != i - 1:
            out.append((last[home], i, KIN))
        last[home], before = i, home
    return out


def minimum_cut(scores: list[float], smooth: list[tuple[int, int, float]]) -> list[bool]:
    """Content labels of least cost, by maximum flow (breadth-first levels, depth-first pushes).

    A block on the source's side is content.  Only the difference of a block's two
    terminal capacities matters, so one of them is 0.
    """
    n = len(scores)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: float, back: float) -> None:
        at[a].append(len(to))
        to.append(b)
        room.append(there)
        at[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, s in enumerate(scores):
        if s > 0:
            join(source, i, s, 0.0)
        elif s < 0:
            join(i, sink, -s, 0.0)
    for a, b, w in smooth:
        join(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in at[u]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                k = next(k for k, e in enumerate(path) if room[e] <= tiny)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[u] < len(at[u]):
                e = at[u][turn[u]]
                if room[e] > tiny and level[to[e]] == level[u] + 1:
                    break
                turn[u] += 1
            else:
                if u == source:
                    break
                e = path.pop()
                u = to[e ^ 1]
                turn[u] += 1
                continue
            path.append(e)
            u = to[e]


def main_text(page: str | None) -> str:
    """Text of a page's content blocks, joined by line breaks."""
    if not page:
        return ""
    found = blocks(page)
    keep = minimum_cut([score(b) for b in found], edges(found))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page, each page on its own and no shuffle.

    Defined results: a null or empty page, and one without content, has the
    empty text; broken markup is read as far as it goes; repeated rows and null
    ids or addresses stay as they are; an empty table gives no rows; other
    columns are not read, whatever their names.
    """
    small_batches(pages.sparkSession)
    kind, url_kind = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))

    def run(batches):
        for b in batches:
            text = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(
        run, f"page_id {kind}, url {url_kind}, text string, n_chars long")
