"""Main text of web pages by line-block distribution.

A page becomes lines, one for each block of text, each weighing its length; text of links weighs nothing. Over
the weights slides a window of ``WIDTH`` lines. A stretch is what lies between two dives, where more than ``GAP``
lines in a row weigh nothing; where its windows surge to ``SURGE`` or more it is main text. All stretches that surge
together are the article.

Elements that are no article by their kind (menus, footers, forms, scripts and the like) have no lines. Classes and ids
only change weights:

* A mark of the article adds ``SURGE`` to each line inside, and no window reaches across its edges. A stretch
  outside of all marks has to outweigh everything inside.
* An element whose class or id names another part of a page (``PART_WORDS``), or just has a word that often does
  (``SUSPECT_WORDS``), weighs nothing as long as other text outweighs it: a suspect weighs in full if no text
  without a mark against it weighs as much, a part if
  nothing else on the page surges and it weighs ``PART_TIMES`` as much.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, to_python

WIDTH = 3
#: Characters in a window from which a stretch of text may begin.
SURGE = 86
#: Lines without weight that a stretch may run across.
GAP = 2
#: How many times the rest of a page, which doesn't surge, a part has to weigh to count.
PART_TIMES = 8
SCHEMA = "page_id long, url string, text string, n_chars long"

#: Fixed values, of HTML: elements without content, elements whose content is no markup, and elements that begin a new line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table
    tbody tfoot thead tr ul
    """.split()
)
#: Elements that an opening tag of the same kind ends.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CELL = frozenset(("td", "th"))
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())

#: What is never main text (elements, roles), and words of a class or id that speak against it.
NEVER = frozenset("head nav footer aside form button select menu dialog noscript template svg math canvas audio video object datalist search".split()) | RAW
PART_WORDS = frozenset(
    """
    ad ads adbox adslot advert adverts advertisement advertisements advertising sponsor sponsored sponsors nav navbar navigation menu
    menus submenu breadcrumb breadcrumbs pagination pager sidebar sidebars sidebox footer masthead topbar cookie cookies consent gdpr
    notice notices newsletter subscribe comment comments disqus replies respond
    """.split()
)
SUSPECT_WORDS = PART_WORDS | frozenset(
    """
    promo promos promotion banner widget widgets toolbar alert popup modal overlay subscription signup login search share sharing
    social related recommended recommendations trending teaser skip copyright disclaimer header
    """.split()
)
#: Words at the end of a class or id that say nothing about what is inside.
CONTAINER_WORDS = frozenset("content wrapper wrap container inner outer area section box block list item items bar row col column group holder slot unit zone region panel pane text body main".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status".split())
#: Words that turn a word after them into a remark on something else.
REMARKS = frozenset("no has with without is not hide".split())
#: Elements that a class does not rule out, and what marks an article.
TRUSTED = frozenset("html body main article".split())
ARTICLE_WORDS = frozenset("article articlebody article-body article-content article-text content main main-content post post-content post-body entry entry-content story story-body".split())
#: Last lines that belong to the page, where nothing marks its end.
CLOSING = re.compile(r"©|\(c\) ?[0-9]{4}|copyright\b|all rights reserved", re.IGNORECASE)

_TAG = re.compile(
    r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+(?:>|\Z)|/(?![a-zA-Z])[^>]*+(?:>|\Z)
    |(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z)))""",
    re.DOTALL | re.VERBOSE,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[a-z]+|[0-9]+")


@dataclass
class Line:
    """A block of text. ``article`` numbers the marked element that it is in, ``against`` the element whose class or id speaks against it (0: none), ``part`` whether as a part of its own."""

    text: str
    weight: int
    article: int = 0
    heading: bool = False
    against: int = 0
    part: bool = False


@dataclass
class _Open:
    name: str
    out: bool  # what is in it is never main text
    article: int
    link: bool
    against: int = 0
    part: bool = False


@dataclass
class _Builder:
    lines: list[Line] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    heading: bool = False

    def add(self, raw: str, link: bool) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if link:
                self.linked += sum(map(len, text.split()))

    def end(self, top: _Open) -> None:
        if self.parts:
            words = "".join(self.parts).split()
            if words:
                size = sum(map(len, words))
                self.lines.append(Line(" ".join(words), 0 if 2 * self.linked > size else size - self.linked, top.article, self.heading, top.against, top.part))
            self.parts = []
        self.linked, self.heading = 0, False


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)}


#: What the tag of an element says about it.
_OUT, _PLAIN, _MARKED, _PART, _SUSPECT = range(5)


def _grade(name: str, rest: str, in_article: bool) -> int:
    """What an opening tag says about its element."""
    if name in NEVER or (name == "header" and not in_article):
        return _OUT
    if len(rest) < 4:
        return _MARKED if name in ("article", "main") else _PLAIN
    found = _attributes(rest.rstrip(">"))
    marks = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    role = found.get("role", "").lower()
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", "").lower()) or role in NEVER_ROLES:
        return _OUT
    if name in ("article", "main") or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody" or not ARTICLE_WORDS.isdisjoint(marks):
        return _MARKED
    return min((_of_name(mark, in_article) for mark in marks), key=(_PART, _SUSPECT, _PLAIN).index, default=_PLAIN) if name not in TRUSTED else _PLAIN


def _of_name(mark: str, in_article: bool) -> int:
    """What one class or id says: its last word that is no container names the element, the others are hints."""
    words = _WORDS.findall(mark)
    while len(words) > 1 and (words[-1] in CONTAINER_WORDS or words[-1].isdigit()):
        words.pop()
    grade = _PLAIN
    for before, word in zip(["", *words], words, strict=False):
        if word in SUSPECT_WORDS and before not in REMARKS and not (in_article and word == "header"):
            grade = _PART if word in PART_WORDS and word is words[-1] else _SUSPECT
    return grade


def lines_of(page: str) -> list[Line]:
    """The lines of a page that may be main text, in page order."""
    build, stack, at, articles, doubts = _Builder(), [_Open("", False, 0, False)], 0, 0, 0
    while at < len(page):
        tag = _TAG.search(page, at)
        top = stack[-1]
        if not top.out:
            build.add(page[at : tag.start() if tag else len(page)], top.link)
        if not tag:
            break
        at = tag.end()
        name = (tag["name"] or "").lower()
        if not name:
            continue
        if tag["close"]:
            if name == "p" and not any(o.name == "p" for o in stack):
                build.end(top)
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    if name in BLOCK or any(o.name in BLOCK for o in stack[depth:]):
                        build.end(top)
                    del stack[depth:]
                    break
                if stack[depth].name in CELL and name in ("span", "a", "b", "i", "em", "strong"):
                    break
            continue
        if name in BLOCK:
            build.end(top)
            _close(stack, ("p",), stop=BLOCK - {"p"})
        if name in SIBLINGS:
            _close(stack, SIBLINGS[name], stop=frozenset(("ul", "ol", "dl", "table", "select", "menu")))
        top = stack[-1]
        if name == "br" or name in CELL:
            build.add(" ", False)
        if name in HEADING and not top.out:
            build.heading = True
        if name in VOID or (tag["rest"].endswith("/>") and name in ("svg", "path", "use", "circle", "rect")):
            continue
        grade = _OUT if top.out else _grade(name, tag["rest"], top.article > 0)
        if name in RAW:  # runs to its closing tag, whatever looks like markup in it
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = end.start() if end else len(page)
        article, against, part = top.article, top.against, top.part
        if grade == _MARKED:
            articles += not article  # an inner mark changes nothing, but it lifts what stands against the element around it
            article, against, part = article or articles, 0, False
        elif grade in (_PART, _SUSPECT) and not part:
            doubts += 1
            article, against, part = 0, doubts, grade == _PART
        stack.append(_Open(name, grade == _OUT, article, top.link or name == "a", against, part))
    build.end(stack[-1])
    return build.lines


def _close(stack: list[_Open], names: tuple[str, ...], stop: frozenset[str]) -> None:
    """End the innermost open element of these names, unless one of ``stop`` stands between."""
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].name in names:
            del stack[depth:]
            return
        if stack[depth].name in stop:
            return


def stretches(weights: list[int], surge: int = SURGE, width: int = WIDTH, gap: int = GAP) -> list[tuple[int, int]]:
    """Stretches between dives, runs of more than ``gap`` lines without weight, in which a window's sum reaches the surge; (first line, line after the last)."""
    found, first, last = [], -1, -1
    for i, w in enumerate([*weights, *[0] * (gap + 1)]):
        if w:
            first, last = (i if first < 0 else first), i
        elif first >= 0 and i - last > gap:
            if any(sum(weights[k : min(k + width, last + 1)]) >= surge for k in range(first, last + 1)):
                found.append((first, last + 1))
            first = -1
    return found


def main_lines(lines: list[Line]) -> list[Line]:
    """The lines of the article: every stretch that surges, with the headings above it."""
    lines = _weighed(lines)
    marked = sum(line.weight for line in lines if line.article)
    weights = [line.weight + SURGE * (line.article > 0) for line in lines]
    runs = [[i for i, _ in run] for _, run in groupby(enumerate(lines), key=lambda x: x[1].article)]
    found = _in_runs(weights, runs, SURGE) or _in_runs(weights, runs, 1)
    found = [(a, b) for a, b in found if lines[a].article or sum(weights[a:b]) > marked]
    kept: list[Line] = []
    at = 0
    for start, end in found:
        if not lines[start].article:
            while start > at and lines[start - 1].heading and not lines[start - 1].article:
                start -= 1
            if end == found[-1][1]:
                while end > start and (kept or end - start > 1) and CLOSING.match(lines[end - 1].text):
                    end -= 1
        kept += lines[start:end]
        at = end
    return kept


def _weighed(lines: list[Line]) -> list[Line]:
    """The lines without those that others outweigh: see the marks at the top."""
    if not any(line.against for line in lines):
        return lines
    if any(line.article and line.weight for line in lines):
        return [line for line in lines if not line.against]
    mass: dict[int, int] = {}
    for line in lines:
        mass[line.against] = mass.get(line.against, 0) + line.weight
    plain = mass.get(0, 0)
    stay = {line.against for line in lines if not line.part and (not line.against or mass[line.against] > plain)}
    if (rest := sum(mass[k] for k in stay)) < SURGE:
        stay |= {line.against for line in lines if line.part and mass[line.against] >= max(SURGE, PART_TIMES * rest)}
    return [line for line in lines if line.against in stay]


def _in_runs(weights: list[int], runs: list[list[int]], surge: int) -> list[tuple[int, int]]:
    """Stretches of each run of lines, so that no window reaches across the edge of a marked part."""
    return [(run[0] + start, run[0] + end) for run in runs for start, end in stretches(weights[run[0] : run[-1] + 1], surge)]


def extract(page: str | None) -> str:
    """The main text of a page, its blocks joined by an empty line; empty where there is none."""
    return "\n\n".join(line.text for line in main_lines(lines_of(page or "")))


def main_text(pages: DataFrame) -> DataFrame:
    """Every row's id, address, main text and its length, in one pass without a shuffle.

    A null page is an empty one, with an empty text; a null id or address stays null; rows with equal ids, and rows
    that repeat, each get a row; a long page is read whole, in one piece; stretches of equal weight all stay, so there are
    no ties; an empty table gives an empty one; other columns stay behind, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "html"):
            texts = [extract(p) for p in block.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column("page_id"), block.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[c.split()[0] for c in SCHEMA.split(", ")])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return to_python(rows, run, SCHEMA)
