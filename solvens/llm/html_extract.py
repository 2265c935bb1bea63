"""Main text of web pages by tag-path ratios.

The page is cut into blocks: stretches of text between tags that aren't inline.  Each block
has a path, its tags from the root down (inline tags left out, classes and ids kept where
they tell).  Per path, text length and punctuation are summed and divided by the number of blocks; both ratios are
fused, lowered by the share of linked text, and smoothed with the best ratio of the elements that
enclose the path below the body, so that a heading or a short paragraph follows the article around it.
Paths that reach ``SHARE`` of the best one are content.  Elements that say what they are (navigation,
footers, forms, adverts, comments and so on) are left out before; where the best path lies
in an article or main element, only paths in such elements count.  A page without such an element is followed from the root down
into the element that outweighs all beside it, by the same ratios of whole elements.

Text of a block: character references decoded, white space turned into one space, trimmed; blocks
are joined by one newline in page order.  ``br`` is white space.  Null and empty pages, and pages without
content, give the empty text.  Unclosed and stray tags, comments and broken references do no harm.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField

from solvens.llm.common import add_columns

#: Share of the best path's ratio that content reaches.
SHARE = 0.2

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)"
    r"(?P<attrs>[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*|[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden|aria-label)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split()
)
RAW = {"script", "style", "textarea", "title", "xmp"}
LEFT_OUT = set(
    "script style noscript template iframe object svg canvas audio video head title nav footer aside form button select textarea input menu dialog".split()
)
#: Words of class, id and role that mark an element as no part of the article.
MARKS = set(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars nav navbar navigation menu menus
    breadcrumb breadcrumbs footer foot comment comments commentlist disqus reply replies respond discussion cookie cookies consent gdpr notice notices
    alert popup modal overlay newsletter subscribe signup social share sharing related recommended recommendations widget widgets pager pagination
    toolbar skip login search complementary contentinfo""".split()
)
#: These mark it only outside an article: inside, they hold its headline.
OUTER_MARKS = {"header", "masthead", "topbar"}
MAIN = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An opening tag closes these open ones first.
BLOCKS_IN_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "table", "dl", "body", "html", "article", "div", "section", "td"}


class Element:
    """An open or closed element; ``path`` is a Path, ``up`` the element around it."""

    __slots__ = ("tag", "path", "up", "out", "main")

    def __init__(self, tag: str, path: Path, up: Element | None, out: bool, main: bool):
        self.tag, self.path, self.up, self.out, self.main = tag, path, up, out, main


class Path:
    """A tag path of a page: its last tag and the path around it, one object for all elements that share it."""

    __slots__ = ("label", "up", "below")

    def __init__(self, label: str, up: Path | None):
        self.label, self.up = label, up
        self.below: dict[str, Path] = {}

    def child(self, label: str) -> Path:
        own = self.below.get(label)
        if own is None:
            own = self.below[label] = Path(label, self)
        return own


def _child(parent: Element, tag: str, attrs: str) -> Element:
    words, out = set(), False
    if attrs and not attrs.isspace():
        for name, value in ATTRIBUTE.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id", "role"):
                words.update(re.findall(r"[a-z0-9]+", value))
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                out = True
    out = out or parent.out or tag in LEFT_OUT or bool(words & MARKS and tag not in ("html", "body"))
    if not parent.main and (tag == "header" or words & OUTER_MARKS) and tag not in MAIN | {"html", "body"}:
        out = True
    telling = ".".join(sorted(words)[:3])
    main = parent.main or tag in MAIN or ("main" in words and tag not in ("html", "body"))
    return Element(tag, parent.path.child(f"{tag}.{telling}" if telling else tag), parent, out, main)


def blocks(page: str) -> list[tuple[str, Element, int]]:
    """Text, element and linked characters of every block with text."""
    root = Element("", Path("", None), None, False, False)
    stack = [root]
    found, pieces = [], []
    linked = links = 0
    at = 0

    def close():
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                found.append((text, stack[-1], linked))
            pieces.clear()
        linked = 0

    end = len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            pieces.append(page[at:])
            break
        if m.start() > at:
            pieces.append(page[at : m.start()])
            if links:
                linked += m.start() - at
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                pieces.append(" ")
            elif tag == "a":
                links = 0 if m["close"] else 1
            continue
        close()
        if m["close"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in BLOCKS_IN_P:
            if stack[-1].tag == "p":
                stack.pop()
        elif tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES[tag]:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPES:
                    break
        if tag in VOID:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if not m["attrs"].endswith("/") or tag not in ("svg", "path"):
            stack.append(_child(stack[-1], tag, m["attrs"]))
    close()
    return found


def _downwards(ends: Iterable) -> list:
    """All elements (or paths) from the given ones up, each after the one around it."""
    order, seen = [], set()
    for own in ends:
        chain = []
        while own is not None and own not in seen:
            seen.add(own)
            chain.append(own)
            own = own.up
        order.extend(reversed(chain))
    return order


def _fused(n: int, marks: int, linked: int, k: int = 1) -> float:
    """Text and punctuation per occurrence, lowered by the share of linked text."""
    return math.sqrt((n / k) * (marks / k)) * (1 - linked / n)


def _measures(text: str, linked: int) -> tuple[int, int, int, int]:
    return len(text), 1 + len(PUNCTUATION.findall(text)), min(linked, len(text)), 1


def ratios(found: list) -> dict[Path, float]:
    """Fused and smoothed ratio of each path."""
    sums: dict[Path, list[int]] = {}
    for text, element, linked in found:
        own = sums.setdefault(element.path, [0, 0, 0, 0])
        for i, x in enumerate(_measures(text, linked)):
            own[i] += x
    fused = {p: _fused(*own) for p, own in sums.items()}
    order = _downwards(sums)
    #: Of all paths below: text times ratio, and text.
    within = {p: [0.0, 0] for p in order}
    for path in reversed(order):
        if path.up is not None:
            n = sums[path][0] if path in sums else 0
            within[path.up][0] += within[path][0] + n * fused.get(path, 0.0)
            within[path.up][1] += within[path][1] + n
    out, around = {}, {}
    for path in order:
        up = path.up
        best = around.get(up, 0.0)
        if up is not None and up.label and not up.label.startswith(("html", "body")):
            best = max(best, within[up][0] / within[up][1])
        around[path] = best
        if path in fused:
            out[path] = (fused[path] + max(fused[path], best)) / 2
    return out


def content_part(found: list) -> list:
    """The blocks of the element that holds most, for pages that don't name their article.

    From the root down, an element of several blocks whose fused ratio exceeds that of all beside it together takes their place;
    headings beside it stay.
    """
    order = _downwards(element for _, element, _ in found)
    sums = {e: [0, 0, 0, 0] for e in order}
    direct = {e: 0.0 for e in order}
    for text, element, linked in found:
        own = _measures(text, linked)
        sums[element] = [a + b for a, b in zip(sums[element], own, strict=True)]
        direct[element] += _fused(*own)
    children: dict[Element, list[Element]] = {}
    for e in reversed(order):
        if e.up is not None:
            sums[e.up] = [a + b for a, b in zip(sums[e.up], sums[e], strict=True)]
            children.setdefault(e.up, []).append(e)
    at, chain = order[0], set()
    while at in children:
        score = {e: _fused(*sums[e][:3]) for e in children[at]}
        best = max((e for e in score if sums[e][3] > 1), key=score.get, default=None)
        if best is None or score[best] <= direct[at] + sum(score.values()) - score[best]:
            break
        chain.add(at)
        at = best
    inside = {}
    for e in order:
        inside[e] = e is at or inside.get(e.up, False)
    return [b for b in found if inside[b[1]] or (b[1].tag in HEADINGS and b[1].up in chain)]


def extract(page: str | None) -> str:
    """Main text of one page."""
    found = [b for b in blocks(page or "") if not b[1].out]
    if not found:
        return ""
    ratio = ratios(found)
    in_main = {b[1].path: b[1].main for b in found}
    best = max(ratio, key=lambda p: (in_main[p], ratio[p]))
    found = [b for b in found if b[1].main] if in_main[best] else content_part(found)
    least = SHARE * max(ratio[b[1].path] for b in found)
    return "\n".join(text for text, element, _ in found if ratio[element.path] >= least)


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with text and n_chars (code points)."""

    def run(column):
        texts = [extract(x.as_py()) for x in column]
        return pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())

    return add_columns(pages, [html_col], [StructField("text", StringType()), StructField("n_chars", LongType())], run)
