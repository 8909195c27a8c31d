"""Main text of web pages by tag-path ratios.

A forgiving parser, linear in the page, turns it into lines: the text of a
block element, each with the tag path from the root to that element.  For every
path the length of its text, the punctuation and the linked text in it are
summed and divided by the number of its lines (Wu et al. 2013: text and
punctuation to tag path ratios).  Length and punctuation are smoothed along the
page and fused with the share of text that is not linked and with weights for
what tags, classes and ids say of the element.  Lines whose fused score reaches
the threshold, a share of the page's mean, are content; no line is content by
its tag alone.  Shorter lines beside or between them (titles, list items, table
cells) go with the lines they stand with: they are kept if an element close
above them holds content lines directly, unless they are links.  What a class
name or an id hints at stays or goes as a whole, by its mean score.

Never content: <nav>, <footer>, <aside>, forms, dialogs, <header> outside an
article, hidden elements and those with such roles, scripts and styles.

Defined results: a null or empty page has an empty text; repeated pages are
extracted alike; nothing is cut short.  Elements nested deeper than DEPTH count
as part of the element at that depth.  A quote that is never closed does not
swallow the page: from where no tag can be closed with quotes, quotes are
ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tagwatch.llm.scratch import blocks, map_arrow

#: A line is content if its fused score is this share of the page's mean, weighted by text.
SHARE = 0.4
#: Weights of the two neighbours on either side in smoothing.
SMOOTH = (1.0, 0.5, 0.14)
#: How much a line in <article> counts, or in <main> where there is no <article>.
INSIDE = 8.0
#: How much a line counts below an element whose class or id hints that it is not content, weakly or strongly: there, and elsewhere.
HINTED_INSIDE, HINTED = (1.0, 0.5, 0.25), (1.0, 0.2, 0.2)
#: Lines that are linked text beyond this share, of a path that is so, too, are links.
LINKS = 0.5
#: How far above a shorter line the element may be that holds content, and the depth of nesting that is told apart.
NEAR, DEPTH = 4, 512

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?:[^>\"'=]+|=\s*(?:\"[^\"]*\"|'[^']*')?|[\"'])*+>")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
# HTML element classes and hints: fixed values.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe template svg math object audio video canvas".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
_OUT = frozenset("nav footer aside form menu select button label dialog head".split())
_CLOSES_P = _BLOCK - frozenset("html body head option td th tr tbody thead tfoot caption legend dd dt li".split())
_SAME = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_SAME |= {f"h{k}": " ".join(f"h{j}" for j in range(1, 7)) for k in range(1, 7)}
_SCOPE = frozenset("ul ol dl table div article section main body".split())
_HINT = (
    r"nav|navbar|navigation|menu|header|masthead|footer|sidebar|side|aside|banner|ad|ads|adv|advert\w*|sponsor\w*|promo\w*|"
    r"cookies?|consent|gdpr|notice|alert|popup|modal|overlay|share|sharing|social|comments?|commentlist|disqus|respond|reply|replies|related|recommend\w*|"
    r"breadcrumbs?|pagination|pager|subscribe|newsletter|login|signup|widget|toolbar|skip|hidden|copyright|disclaimer|legal"
)
#: Words of layout that may stand beside a hint; with any other word, a name is no hint (entry-header, no-sidebar, related-work).
_LAYOUT = r"site|main|top|bottom|left|right|primary|secondary|bar|box|block|area|wrap|wrapper|container|list|links?|buttons?|icons?|slot|unit|posts|articles|form|policy"
_HINTED = re.compile(rf"(?:(?:{_LAYOUT})[_-]+)*(?:{_HINT})(?:[_-]+(?:{_HINT}|{_LAYOUT}))*", re.I)
_WEAK = re.compile(r"(?:[_-]*(?:header|side|aside|social|respond|reply|replies|related|recommend\w*|widget|skip|copyright|disclaimer|legal|alert))+", re.I)
#: Elements that are no part of a page's layout; their ids are anchors.
_TEXTUAL = frozenset("a b dd dt em h1 h2 h3 h4 h5 h6 i li p span strong".split())
_WHOLE = frozenset("html body article main".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
_MARKS = re.compile(r"[.,;:!?…。，、！？；：¿¡]")


@dataclass(slots=True, eq=False)
class Open:
    """An open element; path: its number among the page's tag paths; own, held, over: whether it, an element right in it, or one right in that is a block with content."""

    name: str
    above: Open | None
    path: int
    out: bool
    article: bool
    main: bool
    link: bool
    hinting: tuple[Open, ...]
    hints: int = 0
    own: bool = False
    held: bool = False
    over: bool = False

    def block(self) -> Open:
        """The element itself if it is a block, or the nearest one above."""
        at = self
        while at.above and at.name not in _BLOCK:
            at = at.above
        return at


@dataclass(slots=True, eq=False)
class Line:
    """What stands in one block between two tags of blocks."""

    at: Open
    block: int
    linked: int = 0
    parts: list[str] = field(default_factory=list)
    text: str = ""

    def hint(self) -> Open | None:
        """The outermost element around the line that hints at other than content."""
        return next((x for x in self.at.hinting if x.hints), None)


@lru_cache(4096)
def _hints(key: str, value: str) -> int:
    """Only whole class names, or a whole id, are hints; those of words that texts have sections about are weak ones."""
    found = [x for x in (value.split() if key == "class" else [value.strip()]) if _HINTED.fullmatch(x)]
    return max((1 if _WEAK.fullmatch(x) else 2 for x in found), default=0)


def _opened(name: str, rest: str, above: Open, paths: dict[tuple[int, str], int]) -> Open:
    label, out, hints = name, above.out, 0
    if rest and ("=" in rest or "hidden" in rest):
        for key, a, b, c, hidden in _ATTRIBUTE.findall(rest):
            key, value = key.lower(), a or b or c
            if hidden or key == "style" and "display:none" in value.replace(" ", "").lower() or key == "aria-hidden" and value == "true":
                out = True
            elif key in ("class", "id") and value:
                label += f".{value}"
                if name not in _WHOLE and not (key == "id" and name in _TEXTUAL):
                    hints = max(hints, _hints(key, value))
            elif key == "role":
                out = out or value.lower() in _ROLES
    article, main = above.article or name == "article", above.main or name == "main"
    path = paths.setdefault((above.path, label), len(paths)) if name in _BLOCK else above.path
    new = Open(name, above, path, out or name in _OUT or name == "header" and not (article or main), article, main, above.link or name == "a", above.hinting, hints)
    if hints:
        new.hinting += (new,)
    elif name in ("article", "main"):
        for x in above.hinting:  # what holds an article is no margin of the page
            x.hints = 0
    return new


def parse(page: str) -> list[Line]:
    """The page's lines in order, without those of elements that are never content."""
    lines: list[Line] = []
    paths: dict[tuple[int, str], int] = {}
    stack = [Open("", None, -1, False, False, False, False, ())]
    names: Counter[str] = Counter()
    deeper: Counter[str] = Counter()  # open elements beyond DEPTH, by name
    block = at = 0
    quotes = True

    def text(data: str) -> None:
        top = stack[-1]
        if not data or top.out:
            return
        if not lines or lines[-1].block != block or lines[-1].at.path != top.path:
            if data.isspace():
                return
            lines.append(Line(top, block))
        line = lines[-1]
        line.parts.append(data)
        line.linked += len(data) * top.link

    def close(own: tuple[str, ...], scope: frozenset[str]) -> None:
        if not any(names[x] for x in own):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in own:
                names.subtract(x.name for x in stack[k:])
                del stack[k:]
                return
            if stack[k].name in scope:
                return

    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            text(page[at:start])
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        found = _NAME.match(page, start)
        if not found:
            end = page.find(">", start) if page[start + 1 : start + 2] in ("!", "?", "/") else -1
            text(page[at : start + (end < 0)])
            at = end + 1 if end >= 0 else start + 1
            continue
        end = _REST.match(page, found.end()) if quotes else None
        last = end.end() if end else page.find(">", found.end()) + 1
        quotes = quotes and end is not None
        if not last:  # no tag can end any more
            break
        text(page[at:start])
        at, name, rest = last, found[1].lower(), page[found.end() : last - 1]
        if page[start + 1] == "/":
            if deeper[name]:
                deeper[name] -= 1
            else:
                close((name,), frozenset() if name in _BLOCK else _BLOCK - {name})
        else:
            if name in _SAME:
                close(tuple(_SAME[name].split()), _SCOPE)
            if name in _CLOSES_P:
                close(("p",), _SCOPE)
            if name in _RAW:
                if not rest.endswith("/"):
                    raw = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                    at = raw.start() if raw else len(page)
            elif name == "br":
                text(" ")
            elif name in _VOID:
                pass
            elif len(stack) > DEPTH:
                deeper[name] += 1
            else:
                stack.append(_opened(name, rest, stack[-1], paths))
                names[name] += 1
        if name in _BLOCK:
            block += 1
    text(page[at:])
    for line in lines:
        line.text = " ".join(html.unescape("".join(line.parts)).split())
    return [x for x in lines if x.text]


def _smoothed(values: list[float]) -> list[float]:
    n, out = len(values), []
    for k in range(n):
        total = weight = 0.0
        for d, w in enumerate(SMOOTH):
            for j in {k - d, k + d}:
                if 0 <= j < n:
                    total, weight = total + w * values[j], weight + w
        out.append(total / weight)
    return out


def scored(lines: list[Line]) -> list[float]:
    """The fused score of every line, by its path."""
    sums: dict[int, list[int]] = {}
    for line in lines:
        own = sums.setdefault(line.at.path, [0, 0, 0, 0])
        own[0] += 1
        own[1] += len(line.text)
        own[2] += len(_MARKS.findall(line.text))
        own[3] += min(line.linked, len(line.text))
    told = [sums[x.at.path] for x in lines]
    lengths = _smoothed([math.log1p(size / n) for n, size, _, _ in told])
    marks = _smoothed([min(2.0, mark / n) for n, _, mark, _ in told])
    article = any(x.at.article for x in lines)
    scores = []
    for line, (_, size, _, linked), length, mark in zip(lines, told, lengths, marks, strict=True):
        inside = line.at.article if article else line.at.main
        hint = line.hint()
        weight = (INSIDE if inside else 1.0) * (HINTED_INSIDE if inside else HINTED)[hint.hints if hint else 0]
        share = linked / size
        link = share > LINKS and line.linked > LINKS * len(line.text)
        scores.append(0.0 if link else length * (0.5 + mark) * max(0.01, 1 - share) * weight)
    return scores


def content(lines: list[Line]) -> list[Line]:
    """The lines that are content, and those that go with them."""
    scores, hints = scored(lines), [x.hint() for x in lines]
    # the mean is that of lines without hints, if the page has any
    sized = [(len(x.text), s) for x, h, s in zip(lines, hints, scores, strict=True) if s > 0 and not h] or [(len(x.text), s) for x, s in zip(lines, scores, strict=True) if s > 0]
    if not sized:
        return []
    least = SHARE * sum(n * s for n, s in sized) / sum(n for n, _ in sized)
    parts: dict[Open, list[float]] = {}
    for line, hint, score in zip(lines, hints, scores, strict=True):
        if hint:
            own = parts.setdefault(hint, [0.0, 0.0])
            own[0] += len(line.text) * score
            own[1] += len(line.text)
    able = [s > 0 and (h is None or parts[h][0] >= least * parts[h][1]) for h, s in zip(hints, scores, strict=True)]
    for line, score, may in zip(lines, scores, able, strict=True):
        if may and score >= least:
            own = line.at.block()
            own.own = True
            if own.above:
                own = own.above.block()
                own.held = True
            if own.above:
                own.above.block().over = True

    def goes_with(line: Line) -> bool:
        at = line.at.block()
        title = re.fullmatch("h[1-6]", at.name) is not None
        for k in range(NEAR + 1):
            if at.own or at.held or title and k == 1 and at.over:
                return True
            if at.above is None or at.name in _WHOLE:
                break
            at = at.above.block()
        return False

    return [x for x, s, may in zip(lines, scores, able, strict=True) if may and (s >= least or goes_with(x))]


def main_text(page: str | None) -> str:
    return "\n".join(x.text for x in content(parse(page or "")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return map_arrow(pages.select("page_id", "url", "html"), kernel, "page_id long, url string, text string, n_chars long")
