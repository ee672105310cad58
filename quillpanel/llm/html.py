"""Main text of web pages by line-block distribution.

The markup is stripped to one line for each block; containers of menus, adverts, forms and the like go with it. A line weighs what it has of characters outside links, a
heading all of its characters. Sums of the weights over sliding windows of lines surge where the main text begins and dive where it ends; the text between is kept, with
the lines that adjoin it. Articles, main parts and the rest are zones, each with a surge and a dive of its own: an article begins and ends with its first and last line that is
more than links, other zones must reach a share of the page's heaviest window.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RAW = "script|style|noscript|template|iframe|textarea|title|object|canvas|svg|math|select|audio|video"
_TOKEN = regex.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    regex.S | regex.I,
)
_NAMED = regex.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", regex.I)
_HIDDEN = regex.compile(r"(?:^|\s)(?:hidden(?=\s|$|/)|aria-hidden\s*=\s*[\"']?true)|display\s*:\s*none", regex.I)
_SPACE = regex.compile(r"\s+")
_PART = regex.compile(r"[a-z]+")

_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html"
    " legend li link main menu meta nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("nav footer aside form button head dialog menu fieldset input option".split())
#: Names in class, id and role that mark what is not the article: a name counts if all its parts are of these or of the plain ones below.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies dialog disqus footer gdpr login"
    " masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted recommended related respond search share sharing"
    " sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
_TALK = frozenset("comment comments commentlist replies reply discussion".split())
_PLAIN = frozenset(
    "article area banner bar block body bottom box button buttons col column container content entry feed first form global group head header heading holder icon icons id inner item items last left line link"
    " links list main module outer page panel post primary region right row secondary section simple site small sticky sub text the title top user view wrap wrapper".split()
)
_WHOLE = frozenset("html body main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: How much a character weighs inside an article, inside main alone, and outside both.
WEIGHTS = {"article": 16, "main": 4, "": 1}


@dataclass
class Line:
    text: str
    plain: int  # characters outside links
    zone: int  # lines of one article, of main outside articles, or between these have one zone
    kind: str  # article, main or neither
    run: int  # lines of one run have no dropped container between them

    @property
    def weight(self) -> int:
        return WEIGHTS[self.kind] * self.plain


def _boilerplate(tag: str, attributes: str, inside: bool) -> bool:
    if tag in _DROPPED:
        return True
    if tag == "header" and not inside:
        return True
    if not attributes or tag in _WHOLE:
        return False
    if _HIDDEN.search(attributes):
        return True
    for m in _NAMED.finditer(attributes):
        topic = tag == "article" or (inside and m[0][:2].lower() == "id")  # an id inside an article names what a section is about
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = {x for x in _PART.findall(name) if len(x) > 1}
            marks = (_TALK if topic else _TALK | _MARKS) & parts
            if parts <= _MARKS | _TALK | _PLAIN and (marks or ("header" in parts and tag != "article" and not inside)):
                return True
    return False


def lines(page: str) -> list[Line]:
    """Each block that holds text, in page order. Dropped containers give none."""
    out: list[Line] = []
    stack: list[str] = []
    opened: Counter[str] = Counter()  # how often each tag is on the stack
    parts: list[str] = []
    inside = {"article": 0, "main": 0}
    dropped, linked, in_link, in_heading, last, zone, run = 0, 0, 0, 0, 0, 0, 0  # dropped: height of the stack at which the outermost dropped container stands

    def kind() -> str:
        return "article" if inside["article"] else "main" if inside["main"] else ""

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Line(text, max(0, len(text) - linked), zone, kind(), run))
            parts, linked = [], 0

    def entered(tag: str, step: int) -> None:
        nonlocal zone
        if tag in inside:
            before = kind()
            inside[tag] += step
            zone += kind() != before or (tag == "article" and inside["article"] == 1 and step > 0)

    def pop(last_tag: str) -> None:
        """Closes what stands above the tag's last opening, and that."""
        nonlocal dropped, in_link, in_heading
        while True:
            tag = stack.pop()
            opened[tag] -= 1
            entered(tag, -1)
            in_link -= tag == "a"
            in_heading -= tag in _HEADINGS
            if tag == last_tag:
                break
        if dropped > len(stack):
            dropped = 0

    for m in _TOKEN.finditer(page):
        if m.start() > last and not dropped:
            text = unescape(page[last : m.start()])
            parts.append(text)
            linked += len(text) if in_link and not in_heading else 0
        last = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in _BLOCKS:
            close()
        if m[2]:
            if opened[tag]:
                pop(tag)
            continue
        if tag in _VOID or m[4].endswith("/"):
            continue
        if tag in ("p", "li", "a", "td", "tr") and stack and stack[-1] == tag:
            pop(tag)
        held = bool(kind())
        stack.append(tag)
        opened[tag] += 1
        entered(tag, 1)
        in_link += tag == "a"
        in_heading += tag in _HEADINGS
        if not dropped and _boilerplate(tag, m[4], held):
            dropped, run = len(stack), run + 1
    if last < len(page) and not dropped:
        parts.append(unescape(page[last:]))
    close()
    return out


def surge_and_dive(weights: np.ndarray, window: int, least: float) -> tuple[int, int]:
    """First line, and end, of the text between the first surge and the last dive of the window sums; (0, 0) if they never reach `least`."""
    if not len(weights):
        return 0, 0
    sums = np.convolve(weights, np.ones(window))
    ahead, behind = sums[window - 1 :], sums[: len(weights)]
    begin, end = np.flatnonzero((weights > 0) & (ahead >= least)), np.flatnonzero((weights > 0) & (behind >= least))
    return (int(begin[0]), int(end[-1]) + 1) if len(begin) and len(end) else (0, 0)


def main_text(page: str | None, window: int = 3, share: float = 0.3) -> str:
    """In each zone, the lines from the surge to the dive of its window sums, and those that adjoin them.

    In an article the sums surge and dive with its first and last line that has text outside links (a heading's count), however short it is beside the rest of the page; an
    article of links alone has none. Elsewhere a window must reach `share` of the page's heaviest one, and lines adjoin that have text outside links and no dropped container
    between; main adjoins as a whole. Windows don't reach over a zone's ends.
    """
    zones = [list(z) for _, z in itertools.groupby(lines(page or ""), key=lambda line: line.zone)]
    weights = [np.array([line.weight for line in z], float) for z in zones]
    heaviest = max((np.convolve(w, np.ones(window)).max() for w in weights), default=0)
    kept: list[str] = []
    for zone, w in zip(zones, weights, strict=True):
        begin, end = surge_and_dive(w, window, 1.0 if zone[0].kind == "article" else max(1.0, share * heaviest))
        if begin < end and zone[0].kind == "main":
            begin, end = 0, len(zone)
        while 0 < begin < end and zone[begin - 1].plain and zone[begin - 1].run == zone[begin].run:
            begin -= 1
        while begin < end < len(zone) and zone[end].plain and zone[end].run == zone[end - 1].run:
            end += 1
        kept += [line.text for line in zone[begin:end]]
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """pages with the columns text and n_chars, from html; columns of these names are replaced. A null, empty or textless page has an empty text."""
    source = pages.select(*[c for c in pages.columns if c not in ("text", "n_chars")])
    at = source.columns.index("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                found = [main_text(h.as_py()) for h in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], names=[*part.schema.names, "text"])

    from pyspark.sql.types import StringType, StructType

    return source.mapInArrow(run, StructType([*source.schema.fields]).add("text", StringType())).withColumn("n_chars", F.char_length("text").cast("long"))
