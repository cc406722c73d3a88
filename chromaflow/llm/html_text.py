"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. A linear classifier gives each block a cost for
being called content and one for being called boilerplate, the capacities of its edges
to the two terminals: from its words, its links, its tag, and from what the elements
around it say by tag and name. That evidence has finite weight: nothing but scripts,
styles and controls is dropped without being asked. Smoothness edges join blocks that
follow one another, the heavier the nearer they stand in the tree, and blocks with the
same parent. The maximum flow between the terminals gives the cheapest labelling, in
which neighbours overrule a classifier that is unsure; blocks that their own terminal
edge decides whatever the others do are settled first, which leaves the same cut.

Pages are independent, so this is one pass without a shuffle. Elements know their
parents by pointer: memory and time grow with the page, not with its depth.

Defined cases: null or empty html gives an empty text with 0 characters; a script,
style or comment that never closes runs to the end of its page, any other element ends
with the block around it; where nothing is content, the text that nothing speaks
against is (a page of a few unmarked words); repeated rows give repeated results; a null
page_id or url is passed on; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from functools import lru_cache
from html import unescape

from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, table

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
      |<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
      |<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>
      |<[!?][^>]*+>?
      |<(/?)([a-zA-Z][^\s/>]*+)[^>]*+\Z""",
    re.S | re.X,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Their text is not the page's: dropped as markup. The first hold raw text up to their own end tag.
_RAW = frozenset("script style title textarea iframe".split())
_MUTE = frozenset("noscript template svg object embed canvas audio video map head select option datalist button label".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
_CELL = frozenset(("td", "th", "br", "wbr", "img", "input"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "button": ("button",)}
_LIMITS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}

_AWAY_TAGS = frozenset("nav footer aside menu dialog".split())
_FORM_TAGS = frozenset("form fieldset".split())
_AWAY_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adslot adsense aside banner complementary breadcrumb breadcrumbs byline comment comments commentlist
    consent contentinfo cookie cookies copyright disclaimer disqus footer gdpr header legal login masthead menu menubar modal nav navbar navigation navmenu
    newsletter notice notices notification pager paging pagination popup promo promos promotion recommended related reply replies respond search
    share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets""".split()
)
#: Words that hold for all inside but in the main element; the other words yield to an article and to names of content inside.
_HARD_WORDS = frozenset("ad ads advert comment comments commentlist cookie disqus footer nav navigation sidebar".split())
_STAY_WORDS = frozenset("article articlebody content entry main post story text".split())
#: First parts of names that tell a state or a topic, not what the element is; and parts that may follow the word that decides.
_STATES = frozenset("category cat disable enable format has hide is layout no not show status tag template topic type with without".split())
_PARTS = frozenset(
    """area bar block body bottom box button buttons card container default dark fixed form group heading icon icons info inner item items law left light line
    link links list main meta outer panel primary results right row secondary section slot text this title top trail unit wrap wrapper zone""".split()
)
_LEGAL = re.compile("©|\\(c\\) *[0-9]{4}|all rights reserved|cookie|privacy policy|terms of (?:use|service)|subscribe|sign (?:in|up)|log in", re.I)
_END = re.compile("[.!?…:;][\"'”’)»]*(?:\\s|$)")


class _Element:
    """An open element: its tag, what it says of its text, the block element around it and its depth."""

    __slots__ = ("tag", "evidence", "up", "depth", "mute")

    def __init__(self, tag: str, evidence: tuple, up: "_Element | None", mute: bool):
        self.tag, self.evidence, self.up, self.mute = tag, evidence, up, mute
        self.depth = up.depth + 1 if up else 0


#: Evidence of the elements around a block, in log odds: (against, whether that holds in an article inside too, for).
_NOTHING = (0.0, False, 0.0)
_AGAINST, _AGAINST_HEADER, _FOR, _YIELDS = -12.0, -8.0, 5.0, 0.25


@lru_cache(maxsize=65536)
def _word(name: str) -> str | None:
    """The word that says what an element of this whole class or id is; None where no word does.

    A word speaks alone, as the last part (site-footer), before parts of a layout (sidebar-left), or before a name of content
    (related-posts, comment-text); not in states and topics (has-sidebar, comments-open, category-legal).
    """
    parts = [x for x in re.split("[^a-z]+", name) if x]
    if not parts or (len(parts) > 1 and parts[0] in _STATES):
        return None
    if parts[-1] in _AWAY_WORDS:
        return parts[-1]
    if parts[-1] in _STAY_WORDS:
        return next((x for x in parts if x in _AWAY_WORDS), parts[-1])
    if parts[0] in _AWAY_WORDS | _STAY_WORDS and all(x in _PARTS for x in parts[1:]):
        return parts[0]
    return None


def _evidence(tag: str, attributes: str, outer: tuple) -> tuple:
    """What an element says of the text in it, beside what those around it say."""
    against, firm, for_ = outer
    if tag in _AWAY_TAGS:
        return _AGAINST, True, for_
    if tag in _FORM_TAGS:
        against = min(against, _AGAINST)
    elif tag in ("article", "main"):
        against, for_ = against if firm else against * _YIELDS, _FOR
    elif tag == "header" and not for_:
        against = min(against, _AGAINST_HEADER)
    if not attributes or tag in ("body", "html"):
        return against, firm, for_
    names: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key in ("class", "id", "role", "itemprop"):
            names.update(value.split())
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _HIDDEN.search(value)):
            return _AGAINST, True, for_
    words = {_word(x) for x in names}
    away, stay = words & _AWAY_WORDS, words & _STAY_WORDS
    if away == {"header"}:
        if not (for_ or stay or any(x in _STAY_WORDS for n in names for x in re.split("[^a-z]+", n))):
            against = min(against, _AGAINST_HEADER)
        return against, firm, for_
    if away and not (tag == "main" or ((tag == "article" or stay) and not away & _HARD_WORDS)):
        return _AGAINST, firm or bool(for_ or away & _HARD_WORDS), for_
    if stay or away:
        against, for_ = against if firm else against * _YIELDS, _FOR
    return against, firm, for_


class Block:
    """A block of text: the element it stands in, and the characters of it that are links."""

    __slots__ = ("text", "home", "evidence", "linked")

    def __init__(self, text: str, home: _Element, evidence: tuple, linked: int):
        self.text, self.home, self.evidence, self.linked = text, home, evidence, linked


def blocks_of(html: str) -> list[Block]:
    """The blocks of a page in its order."""
    out: list[Block] = []
    root = _Element("", _NOTHING, None, False)
    stack = [root]
    blocks = [root]  # the block elements of the stack
    open_: dict[str, int] = {}  # open elements by tag
    inline: list[dict[str, int]] = [{}]  # open inline elements by tag since each of ``blocks``
    buffer: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                out.append(Block(text, blocks[-1], stack[-1].evidence, min(linked, len(text))))
            buffer.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1].mute:
            text = unescape(raw) if "&" in raw else raw
            buffer.append(text)
            if in_link:
                linked += len(text)

    def pop() -> str:
        nonlocal in_link
        gone = stack.pop()
        open_[gone.tag] -= 1
        if gone is blocks[-1]:
            blocks.pop()
            inline.pop()
        else:
            inline[-1][gone.tag] -= 1
        if gone.tag == "a":
            in_link -= 1
        return gone.tag

    def push(tag: str, attributes: str) -> None:
        nonlocal in_link
        outer = stack[-1]
        asked = tag in _BLOCK or tag in ("span", "td", "th", "a")
        evidence = _NOTHING if tag == "body" else _evidence(tag, attributes, outer.evidence) if asked else outer.evidence
        own = _Element(tag, evidence, blocks[-1], tag != "body" and (outer.mute or tag in _MUTE))
        stack.append(own)
        open_[tag] = open_.get(tag, 0) + 1
        if tag in _BLOCK:
            blocks.append(own)
            inline.append({})
        else:
            inline[-1][tag] = inline[-1].get(tag, 0) + 1
        if tag == "a":
            in_link += 1

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if not m:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5] or m[8]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4] or m[7], m[3] or m[6] or ""
        if closing:
            if tag in _BLOCK:
                flush()
                if open_.get(tag):
                    while pop() != tag:
                        pass
            else:
                if tag in _CELL:
                    buffer.append(" ")
                # an inline element ends only in the block that it began in
                if inline[-1].get(tag):
                    while pop() != tag:
                        pass
            continue
        if tag in _RAW:
            if not attributes.endswith("/"):
                close = _end_of(tag).search(html, at)
                at = close.end() if close else end
            buffer.append(" ")
            continue
        if tag in _BLOCK:
            flush()
            while stack[-1].tag == "head":
                pop()
        elif tag in _CELL or tag in _MUTE:
            buffer.append(" ")
        if tag in _CLOSES and any(open_.get(x) for x in _CLOSES[tag]):
            stop = _LIMITS.get(tag, ())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _CLOSES[tag]:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k].tag in stop or (tag in ("p", "option", "button") and stack[k].tag in _BLOCK):
                    break
        elif tag in _BLOCK and stack[-1].tag == "p":
            pop()
        if tag not in _VOID and not attributes.endswith("/"):
            push(tag, attributes)
    flush()
    return out


@lru_cache(16)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I)


#: Smoothness: of neighbours by their distance in the tree, of blocks with one parent, and what is left of it between unlike evidence.
_ADJACENT, _FAR, _SIBLING, _UNLIKE = 2.2, 0.2, 0.8, 0.3
_SCALE = 1000


def odds(block: Block) -> float:
    """Log odds that a block is content, by the classifier alone."""
    text, tag = block.text, block.home.tag
    against, _, for_ = block.evidence
    words = text.count(" ") + 1
    z = against + for_ - 1.0 + 0.09 * min(words, 45) - 4.5 * block.linked / len(text)
    if tag in ("p", "blockquote", "pre"):
        z += 1.4
    elif tag in ("h1", "h2", "h3", "h4"):
        z += 1.0
    elif tag in ("li", "dt", "dd", "tr"):
        z -= 0.3
    if _END.search(text):
        z += 0.6
    if words < 60 and _LEGAL.search(text):
        z -= 2.5
    return z


def _steps(a: _Element | None, b: _Element | None, most: int = 8) -> int:
    """Steps from one block element to another through the tree, at most ``most``."""
    for n in range(most):
        if a is b:
            return n
        if a is None or (b is not None and b.depth > a.depth):
            b = b.up
        else:
            a = a.up
    return most


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges of a page's blocks."""
    out, before = [], {}

    def join(i: int, k: int, weight: float) -> None:
        a, b = blocks[i].evidence, blocks[k].evidence
        out.append((i, k, weight if a[0] == b[0] else weight * _UNLIKE))

    for k, block in enumerate(blocks):
        if k:
            steps = _steps(blocks[k - 1].home, block.home)
            join(k - 1, k, _ADJACENT / (1 + 0.5 * steps) if steps < 8 else _FAR)
        parent = block.home.up
        if parent is not None:
            if parent in before:
                join(before[parent], k, _SIBLING)
            before[parent] = k
    return out


def cut(z: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling (True: content) of least cost: -z of each block on the wrong side of 0, plus the weight of each edge between labels."""
    n = len(z)
    unary = [round(_SCALE * x) for x in z]
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, w in edges:
        w = round(_SCALE * w)
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None or abs(unary[i]) < sum(near[i].values()):
            continue
        label[i] = unary[i] > 0
        for j, w in near[i].items():
            del near[j][i]
            unary[j] += w if label[i] else -w
            todo.append(j)
        near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, _max_flow(rest, unary, near)):
            label[i] = side
    return [bool(x) for x in label]


def _max_flow(rest: list[int], unary: list[int], near: list[dict[int, int]]) -> list[bool]:
    """Dinic's algorithm from the content terminal to the boilerplate terminal; the source side of the minimum cut is content."""
    place = {i: k for k, i in enumerate(rest)}
    s, t = len(rest), len(rest) + 1
    graph: list[dict[int, int]] = [{} for _ in range(t + 1)]
    for i, k in place.items():
        if unary[i] > 0:
            graph[s][k], graph[k][s] = unary[i], 0
        elif unary[i] < 0:
            graph[k][t], graph[t][k] = -unary[i], 0
        for j, w in near[i].items():
            graph[k][place[j]] = w
    while True:
        level = {s: 0}
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for b, room in graph[a].items():
                if room and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if t not in level:
            return [k in level for k in range(len(rest))]
        ways = {a: iter(list(graph[a])) for a in level}
        path = [s]
        while path:
            a = path[-1]
            if a == t:
                least = min(graph[x][y] for x, y in zip(path, path[1:]))
                for x, y in zip(path, path[1:]):
                    graph[x][y] -= least
                    graph[y][x] = graph[y].get(x, 0) + least
                first = next(k for k, (x, y) in enumerate(zip(path, path[1:])) if not graph[x][y])
                ways_back = path[first + 1 :]
                del path[first + 1 :]
                for x in ways_back[:-1]:
                    ways[x] = iter(list(graph[x]))
                continue
            for b in ways[a]:
                if graph[a][b] and level.get(b) == level[a] + 1:
                    path.append(b)
                    break
            else:
                path.pop()


def labels_of(blocks: list[Block]) -> list[bool]:
    """Which blocks are content."""
    z, edges = [odds(b) for b in blocks], edges_of(blocks)
    labels = cut(z, edges)
    if any(labels):
        return labels
    # nothing stands out: what nothing speaks against is the page's text
    return [not b.evidence[0] and 2 * b.linked < len(b.text) and any(c.isalnum() for c in b.text) for b in blocks]


def main_text(html: str | None) -> str:
    """The main text of a page, its blocks joined by one line feed."""
    blocks = blocks_of(html or "")
    return "\n".join(b.text for b, keep in zip(blocks, labels_of(blocks)) if keep)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""

    def run(batch):
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(x) for x in texts]}

    return map_arrow(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
