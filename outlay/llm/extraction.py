"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with its path of tags from the root. Blocks in
places that never hold an article (navigation, footers, forms, scripts, adverts, comments
and the like, by tag, role or name) are left out first. For the others, text length and
punctuation are summed up per path, since the paragraphs of an article share a path while
menus and notices have paths with little text and punctuation; what stands in links counts
for less. The ratios of a path are smoothed over its neighbours in page order and fused with
those of all containers it stands in, nearer ones counting more, and paths beyond a threshold
are content: all their blocks are returned.

The main container is found from the root down: as long as one child holds most of what
speaks for content, the search goes on in it, and it ends in an ``article``. Within it titles,
lists and quotes profit from the paragraphs around them. Paths elsewhere have their own ratio
only, times the share of the branch they stand in. ``article`` and ``main`` are a factor on
ratios and shares; they decide nothing alone.

Defined results: a null or empty page, or one without content, has the text ``""``; markup
that is never closed ends with the page; repeated rows are read alike; an empty table gives
no rows.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from math import exp, log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlay.llm.base import in_batches, only, text_or_empty

#: Share of the best path's score from which a path is content.
THRESHOLD = 0.2
#: What a container passes on to the paths in it, for every level between.
DECAY = 0.7
#: Share of a container's content that a child needs to be searched instead of it.
MOST = 0.75
#: Factor of what stands in ``article`` or ``main``, and loss of a path that is all links.
MARKED = 1.5
LINK_LOSS = 0.7
#: Blocks to either side that smoothing reaches, and its width.
REACH, WIDTH = 2, 1.0

# Names of elements and what they mean.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt"
    " ruby s samp small span strike strong sub sup time tt u var wbr br img".split()
)
NEVER = set(
    "head script style noscript template svg math iframe object embed applet canvas audio video map"
    " nav footer aside form fieldset button select option datalist textarea dialog menu".split()
)
CONTENT = ("article", "main")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
NEVER_ROLES = set(
    "navigation banner contentinfo complementary search form menu menubar toolbar dialog alert"
    " alertdialog tablist".split()
)
NEVER_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo"
    " promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer"
    " sidebar aside widget widgets related recommended recommendations share sharing social"
    " comment comments disqus replies respond discussion cookie cookies consent gdpr notice"
    " notices notification alert popup modal overlay newsletter subscribe subscription signup"
    " login pagination pager paging toolbar skip hidden".split()
)
# Words that change nothing beside one of those, as in "site-header" or "comment-list".
PLAIN_NAMES = set(
    "site page main top bottom left right list box bar wrap wrapper container block section area"
    " links link buttons button item items slot global primary secondary form panel unit inner"
    " outer group row col post posts user text message js the".split()
)
CLOSED_BY = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>"""
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(
    r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""",
    re.IGNORECASE,
)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：«»“”\"()\-–—]")


class Paths:
    """The tree of tag paths of a page: a number for each, greater than that of its parent.
    Path 0 is the root. However deep a page is nested, a path takes one entry."""

    def __init__(self) -> None:
        self.parent, self.label = [0], [""]
        self._numbers: dict[tuple[int, str], int] = {}

    def below(self, parent: int, label: str) -> int:
        number = self._numbers.setdefault((parent, label), len(self.parent))
        if number == len(self.parent):
            self.parent.append(parent)
            self.label.append(label)
        return number


@dataclass
class Element:
    tag: str
    path: int
    never: bool
    content: bool
    link: bool


@dataclass
class Block:
    path: int
    text: str
    content: bool
    linked: float = 0.0


def main_text(page: str) -> str:
    paths = Paths()
    blocks = blocks_of(page, paths)
    chosen = content_paths(blocks, paths)
    return "\n\n".join(b.text for b in blocks if b.path in chosen)


def blocks_of(page: str, paths: Paths) -> list[Block]:
    """Blocks of text outside places that never hold an article, in page order."""
    blocks: list[Block] = []
    stack = [Element("", 0, False, False, False)]
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            block = next(e for e in reversed(stack) if e.tag not in INLINE)
            if text:
                share = 0.0 if block.tag in HEADINGS else min(1.0, linked / len(text))
                blocks.append(Block(block.path, text, block.content, share))
            parts.clear()
            linked = 0

    def leave(down_to: int) -> None:
        if any(e.tag not in INLINE for e in stack[down_to:]):
            flush()
        del stack[down_to:]

    at = 0
    while True:
        found = _MARKUP.search(page, at)
        if not stack[-1].never:
            parts.append(page[at : found.start() if found else len(page)])
            linked += len(parts[-1].strip()) if stack[-1].link else 0
        if not found:
            break
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            if found[0].startswith("<![CDATA[") and not stack[-1].never:
                parts.append(html.escape(found[0][9:].removesuffix("]]>")))
            continue
        if found[1] or found[4]:
            open_at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if open_at:
                leave(open_at)
            elif tag == "p":
                flush()
            continue
        attributes = found[3] or found[6] or ""
        if tag not in INLINE:
            _close_implied(tag, stack, leave)
            flush()
        if tag in VOID:
            if not stack[-1].never:
                parts.append(" ")
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>|\Z", re.IGNORECASE).search(page, at)
            at = close.end()
            continue
        if not attributes.rstrip().endswith("/") or tag not in ("svg", "math"):
            stack.append(_element(tag, attributes, stack[-1], paths))
    flush()
    return blocks


def _close_implied(tag: str, stack: list[Element], leave) -> None:
    """Elements that the start of ``tag`` ends: an open paragraph, an item of the same list."""
    closes = CLOSED_BY.get(tag, set())
    for i in range(len(stack) - 1, 0, -1):
        name = stack[i].tag
        if name == "p" or name in closes:
            leave(i)
            return
        if name not in INLINE and not (closes and name in HEADINGS):
            return


def _element(tag: str, attributes: str, parent: Element, paths: Paths) -> Element:
    names = ""
    never = parent.never or tag in NEVER or (tag == "header" and not parent.content)
    content = parent.content or tag in CONTENT
    if attributes and tag not in ("html", "body"):
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name == "class":
                names = re.sub(r"\d+", "", value).strip()
            if tag in CONTENT:
                continue
            if name in ("class", "id"):
                never |= any(_never_name(name) for name in value.split())
            elif name == "role":
                never |= value.lower() in NEVER_ROLES
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                never = True
            elif name == "style":
                never |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    label = f"{tag}.{names}" if names else tag
    path = parent.path if tag in INLINE and tag != "a" else paths.below(parent.path, label)
    return Element(tag, path, never, content, parent.link or tag == "a")


def _never_name(name: str) -> bool:
    """Whether a whole name says that no article is here: ``share-buttons`` does, but
    ``market-share`` doesn't."""
    words = {w.lower() for w in _NAME.findall(name)}
    return not words.isdisjoint(NEVER_NAMES) and words <= NEVER_NAMES | PLAIN_NAMES


@dataclass
class Sums:
    """What is counted of a path: characters, those in links, punctuation and blocks."""

    length: int = 0
    linked: float = 0.0
    marks: int = 0
    number: int = 0
    content: bool = False

    def ratio(self) -> float:
        value = log1p(self.length / self.number) * log1p(1 + self.marks / self.number) * log1p(self.length)
        return value * (1 - LINK_LOSS * self.linked / self.length) * (MARKED if self.content else 1)


def content_paths(blocks: list[Block], paths: Paths) -> set[int]:
    """Paths whose fused ratio passes the threshold."""
    sums: dict[int, Sums] = {}
    for b in blocks:
        own = sums.setdefault(b.path, Sums(content=b.content))
        own.length += len(b.text)
        own.linked += b.linked * len(b.text)
        own.marks += len(_PUNCTUATION.findall(b.text))
        own.number += 1
    if not sums:
        return set()
    ratio = {p: own.ratio() for p, own in sums.items()}
    fused = _fused(paths, sums, ratio, _smoothed(blocks, ratio))
    best = max(fused.values())
    return {p for p, score in fused.items() if score >= THRESHOLD * best}


def _smoothed(blocks: list[Block], ratio: dict[int, float]) -> dict[int, float]:
    """The mean over a path's blocks of the ratios around them, nearer ones counting more."""
    weights = [exp(-(d * d) / (2 * WIDTH * WIDTH)) for d in range(REACH + 1)]
    series = [ratio[b.path] for b in blocks]
    total: dict[int, float] = {}
    count: dict[int, int] = {}
    for i, b in enumerate(blocks):
        near = range(max(0, i - REACH), min(len(blocks), i + REACH + 1))
        weight = sum(weights[abs(i - j)] for j in near)
        value = sum(series[j] * weights[abs(i - j)] for j in near) / weight
        total[b.path] = total.get(b.path, 0.0) + value
        count[b.path] = count.get(b.path, 0) + 1
    return {p: total[p] / count[p] for p in total}


def _fused(
    paths: Paths, sums: dict[int, Sums], ratio: dict[int, float], smooth: dict[int, float]
) -> dict[int, float]:
    """The ratio of every path, fused with those of its containers."""
    parent, number = paths.parent, len(paths.parent)
    length = [sums[p].length if p in sums else 0 for p in range(number)]
    mass = [length[p] * smooth.get(p, 0.0) for p in range(number)]
    for p in range(number - 1, 0, -1):
        length[parent[p]] += length[p]
        mass[parent[p]] += mass[p]
    main = _main_container(paths, mass)
    above, at = {0}, main
    while at:
        above.add(at)
        at = parent[at]
    # What containers within the main one pass on to a path; the share of a branch elsewhere.
    passed, branch = [0.0] * number, [0.0] * number
    fused = {}
    for p in range(number):
        if not length[p]:
            continue
        here = mass[p] / length[p]
        inside = p == main or passed[parent[p]] > 0
        if inside:
            passed[p] = max(here, DECAY * passed[parent[p]])
        elif p not in above:
            branch[p] = mass[p] if parent[p] in above else branch[parent[p]]
        if p not in sums:
            continue
        if inside:
            links = 1 - LINK_LOSS * sums[p].linked / sums[p].length
            given = here if p == main else passed[parent[p]]
            fused[p] = max(smooth[p], DECAY * given * links)
        else:
            own = branch[p] or sums[p].length * smooth[p]
            fused[p] = min(ratio[p], smooth[p]) * own / mass[0]
    return fused


def _main_container(paths: Paths, mass: list[float]) -> int:
    """The container that holds most of the content, or the ``article`` on the way there."""
    children: dict[int, list[int]] = {}
    for p in range(1, len(mass)):
        if mass[p]:
            children.setdefault(paths.parent[p], []).append(p)
    at = 0
    while paths.label[at].partition(".")[0] != "article":
        holders = [c for c in children.get(at, ()) if c in children]
        child = max(holders, key=lambda c: mass[c], default=at)
        if child == at or mass[child] < MOST * mass[at]:
            break
        at = child
    return at


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    def work(rows: pa.RecordBatch) -> dict:
        texts = [main_text(page) for page in rows.column("html").to_pylist()]
        out = {c: rows.column(c) for c in ("page_id", "url")}
        return out | {"text": texts, "n_chars": [len(t) for t in texts]}

    pages = only(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), text_or_empty("html").alias("html")
    )
    return in_batches(pages, work, "page_id long, url string, text string, n_chars long")
