"""Main text of web pages from streamed parser events (operator 1).

The standard library's parser reports tags and text; they become lines, one per block element, each with its text and its
number of tags. A stack of open elements follows HTML's implied end tags, so that an element without its end tag takes
nothing that comes after it; it is indexed by name, so a page takes time in proportion to its length however deep it is.

A line's score is the logarithm of its text-to-tag ratio. Text in links counts little, and a tag weighs more or less by
where it stands: e**KEEP times less in an article or main element, e**MARK times more in an element, role, class or id of
menus, headers, footers, sidebars, notices, adverts, forms and comments, e**SOFT times more under a name that only mentions
one of these. Scores are smoothed with a Gaussian window within a region (neighbouring lines that stand alike), which
carries short lines among long ones, and clustered: two means in one dimension, again in the upper cluster while it mixes
lines that stand differently, and once in lines outside of articles. Lines above the cut are content; nothing else decides.

On a page without an article or main element, headings and paragraphs next to content lines belong to it too, as short ones
have low ratios. Within a block all white space becomes one space, blocks without text vanish, and blocks are joined by
line feeds. A null or empty page, and one that holds marked text only, gives the empty text.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements that begin and end a line.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
KEPT = frozenset(("article", "main"))
#: Elements and roles whose text is marked.
MARKED = frozenset("aside button canvas datalist dialog footer header iframe menu nav noscript object select svg template textarea title".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Words of class and id names that mark if they are a name's last word, layout words left out, or the block's in block__element.
WORDS = frozenset("ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion related share sharing sidebar social sponsor sponsored subscribe widget widgets".split())
#: Words after which the one before says what an element is.
LAYOUT = frozenset("area articles aside bar block body bottom box btn button buttons card cell col column container content dialog field form frame group head holder icon icons inner item items label large layout left link links list main media module outer page panel position post posts reply respond right row section site slot small stories thread title top trail unit view wrap wrapper zone".split())
#: Marks that an article within them, as an unclosed or page-wide element has it, takes no part in.
LOOSE = frozenset(("form", "header", "menu", "nav", "search"))
#: Blocks of running text.
PROSE = frozenset("blockquote dd dt h1 h2 h3 h4 h5 h6 li p pre".split())
#: Start tags that end an open paragraph.
ENDS_P = BLOCKS - {"body", "caption", "head", "html", "legend", "tbody", "td", "tfoot", "th", "thead", "title", "tr"}
#: Start tags that end open elements of these names, up to an element of the second set.
_LISTS, _TABLE = frozenset(("ul", "ol", "menu")), frozenset(("table",))
ENDS = {
    "li": (frozenset(("li",)), _LISTS), "dd": (frozenset(("dd", "dt")), frozenset(("dl",))), "dt": (frozenset(("dd", "dt")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))), "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "tr": (frozenset(("tr", "td", "th", "caption")), _TABLE), "td": (frozenset(("td", "th", "caption")), frozenset(("table", "tr"))), "th": (frozenset(("td", "th", "caption")), frozenset(("table", "tr"))),
    **{x: (frozenset(("thead", "tbody", "tfoot", "tr", "td", "th", "caption")), _TABLE) for x in ("thead", "tbody", "tfoot")},
    "body": (frozenset(("head",)), frozenset()),
}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_P_SCOPE = frozenset("button caption html object table td template th".split())
_NAME = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Logarithms of what a tag weighs by its place.
KEEP, MARK, SOFT = 5.0, 5.0, 1.5
#: (the share of its length that text in links counts, the window's width in lines) in articles, where lists of links may
#: stand among prose, and elsewhere.
WITHIN, ELSEWHERE = (0.1, 2.5), (0.01, 1.0)
#: The ratio of prose, and how much of it there must be in blocks of some length, for a form around it not to mark it.
PROSE_RATIO, PROSE_TEXT, PROSE_LINE = 25, 200, 80
#: Ratios below this one count as it.
LEAST_RATIO = 0.1
#: Clusters' means must be so far apart; the first splits part lines that stand differently, the last those that stand alike.
APART, ALIKE = math.log(8), math.log(2)


@dataclass
class Mark:
    """What an element's mark rests on; which lines it holds is counted when the page has ended."""

    kind: str  # "firm", "loose" (not within an article), "form" (as loose, and not around prose) or "soft" (a weight only)
    main: bool = False
    ended: int | None = None  # the line from which it no longer holds, where its blocks stay open


@dataclass
class Line:
    text: str
    tags: int
    link: int
    container: int
    marks: tuple[Mark, ...]
    block: str


@lru_cache(maxsize=4096)
def named(value: str) -> str:
    """Whether a class or id value marks: "firm", "soft" or ""."""
    found = ""
    for token in value.split():
        for part in dict.fromkeys((token, token.split("__")[0])):
            words = [x.lower() for x in _NAME.findall(_CAMEL.sub(" ", part))]
            told = list(words)
            while len(told) > 1 and (told[-1] in LAYOUT or len(told[-1]) == 1):
                told.pop()
            if told and told[-1] in WORDS:
                return "firm"
            if any(x in WORDS for x in words):
                found = "soft"
    return found


class Lines(HTMLParser):
    """Collects lines from parser events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.beside: list[str] = []  # marked text within an unmarked line
        self.tags, self.link = 0, 0
        self.open: list[tuple[str, tuple[Mark, ...], int]] = [("", (), 0)]  # open elements: name, marks, container
        self.places: dict[str, list[int]] = defaultdict(list)  # where elements of each name are open
        self.blocks: list[int] = []  # and blocks
        self.n_containers = 0
        self.at: tuple[tuple[Mark, ...], int] | None = None  # where the line began
        self.block = ""  # and the block there
        self.beside_at: tuple[tuple[Mark, ...], int] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split()) if self.parts else ""
        if text or self.tags:
            marks, container = self.at or self.here()
            self.lines.append(Line(text, self.tags, min(self.link, len(text)), container, marks, self.block))
        if self.beside and (text := " ".join("".join(self.beside).split())):
            self.lines.append(Line(text, 1, 0, self.beside_at[1], self.beside_at[0], ""))
        self.parts, self.beside, self.tags, self.link, self.at = [], [], 0, 0, None

    def here(self) -> tuple[tuple[Mark, ...], int]:
        """(marks that hold, container) at this place; marks are few, as an element adds none of a kind that holds."""
        _, marks, container = self.open[-1]
        if marks and any(m.ended is not None for m in marks):
            marks = tuple(m for m in marks if m.ended is None)
        return marks, container

    @staticmethod
    def mark(tag: str, attrs: list[tuple[str, str | None]]) -> Mark | None:
        if tag in MARKED:
            return Mark("loose" if tag in LOOSE else "firm")
        found = Mark("form") if tag == "form" else None
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true" or value and name == "role" and value.lower() in ROLES:
                return Mark("firm")
            if value and name in ("class", "id") and tag not in ("html", "body", "main"):
                kind = named(value)
                if kind == "firm":
                    return Mark("firm")
                if kind and found is None:
                    found = Mark("soft")
        return found

    def push(self, tag: str, marks: tuple[Mark, ...], container: int) -> None:
        self.places[tag].append(len(self.open))
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append((tag, marks, container))

    def close_to(self, at: int) -> None:
        """Ends the open elements from that place on."""
        if self.blocks and self.blocks[-1] >= at:
            self.flush()
        while len(self.open) > at:
            name = self.open.pop()[0]
            if name:
                self.places[name].pop()
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()

    def close_around(self, at: int) -> None:
        """Ends an inline element whose blocks stay open: its name goes, and its mark holds up to here."""
        name, marks, container = self.open[at]
        before = self.open[at - 1][1]
        if own := [m for m in marks if not any(m is x for x in before)]:
            self.flush()
            for m in own:
                m.ended = len(self.lines)
        self.places[name].remove(at) if self.places[name][-1] != at else self.places[name].pop()
        self.open[at] = ("", marks, container)

    def last(self, names, scope) -> int:
        """The place of the innermost open element of those names within the scope, or 0."""
        found, places = 0, self.places
        for x in names:
            if (own := places.get(x)) and own[-1] > found:
                found = own[-1]
        if found:
            for x in scope:
                if (own := places.get(x)) and own[-1] > found and x not in names:
                    return 0
        return found

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P and (at := self.last(("p",), _P_SCOPE)):
            self.close_to(at)
        if tag in _HEADINGS and self.open[-1][0] in _HEADINGS:
            self.close_to(len(self.open) - 1)
        if tag in ENDS:
            while at := self.last(*ENDS[tag]):
                self.close_to(at)
        if tag == "a" and (at := self.last(("a",), _P_SCOPE)):
            self.close_around(at)
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            (self.beside if self.beside else self.parts).append(" ")
        self.tags += 1
        if tag in VOID:
            return
        marks, container = self.here()
        if tag in KEPT:
            self.n_containers += 1
            container = self.n_containers
            for m in marks:
                m.main |= tag == "main"
            marks = tuple(m for m in marks if m.kind in ("firm", "soft"))
        if marks:
            marks = tuple(m for m in marks if not m.main)
        own = self.mark(tag, attrs)
        if own is not None and not any(m.kind == own.kind for m in marks):
            marks = (*marks, own)
        self.push(tag, marks, container)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math") or tag not in VOID and (self.places.get("svg") or self.places.get("math")):  # only foreign elements end with "/>"
            self.close_to(len(self.open) - 1)

    def handle_endtag(self, tag):
        self.tags += 1
        at = self.last((tag,), ())
        if not at:
            if tag in BLOCKS:
                self.flush()
        elif tag not in BLOCKS and self.blocks and self.blocks[-1] > at:
            self.close_around(at)
        else:
            self.close_to(at)

    def start(self, here: tuple[tuple[Mark, ...], int]) -> None:
        self.at, self.block = here, self.open[self.blocks[-1]][0] if self.blocks else ""

    def handle_data(self, data):
        if self.open[-1][0] in ("script", "style"):
            return
        here = self.here()
        if self.at is None:
            if not data.strip():
                if self.parts or self.tags:
                    self.parts.append(data)
                return
            self.start(here)
        if len(here[0]) > len(self.at[0]):
            self.beside.append(data)
            self.beside_at = here
            return
        if len(here[0]) < len(self.at[0]):  # a marked inline element has ended
            self.flush()
            self.start(here)
        self.parts.append(data)
        if self.places.get("a"):
            self.link += len(data.strip())


def smoothed(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """values under a Gaussian window; at the ends its weights are renewed."""
    reach = max(1, math.ceil(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    n = len(values)
    return np.convolve(values, weights)[reach : reach + n] / np.convolve(np.ones(n), weights)[reach : reach + n]


def threshold(values: np.ndarray, apart: float) -> float:
    """Between the means of two clusters on a line; below all values if the clusters' means are not apart."""
    cut = (float(values.min()) + float(values.max())) / 2
    low = high = 0.0
    for _ in range(50):
        upper = values > cut
        if upper.all() or not upper.any():
            return -math.inf
        low, high = float(values[~upper].mean()), float(values[upper].mean())
        if abs((low + high) / 2 - cut) < 1e-9:
            break
        cut = (low + high) / 2
    return cut if high - low >= apart else -math.inf


def content_cut(scores: np.ndarray, standing: np.ndarray) -> float:
    """The cut under content: splits go on in the upper cluster while it mixes lines that stand differently."""
    cut, upper = -math.inf, np.ones(len(scores), bool)
    while True:
        own = np.unique(standing[upper])
        mixed = len(own) > 1
        if not mixed and own[0] > 0:  # an article's own lines are one cluster
            return cut
        found = threshold(scores[upper], APART if mixed else ALIKE)
        if found == -math.inf:
            return cut
        cut, upper = found, scores > found
        if not mixed:
            return cut


def placed(lines: list[Line]) -> tuple[list[Line], np.ndarray, np.ndarray]:
    """(lines with text, how each stands: 1 in an article, 0 plain, -1 marked, its tags' weight as a logarithm)."""
    size: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0])
    for x in lines:
        for m in x.marks:
            if m.kind == "form":
                own = size[id(m)]
                own[0] += len(x.text) - x.link
                own[1] += x.tags
                own[2] += len(x.text) if x.block in PROSE and len(x.text) - x.link >= PROSE_LINE else 0

    def counts(m: Mark, line: int) -> bool:
        if m.main or m.ended is not None and line >= m.ended:
            return False
        text, tags, prose = size[id(m)] if m.kind == "form" else (0, 0, 0)
        return m.kind != "form" or text < PROSE_RATIO * max(1, tags) or prose < PROSE_TEXT

    kept, standing, weight = [], [], []
    for i, x in enumerate(lines):
        if x.text:
            kinds = {m.kind for m in x.marks if counts(m, i)}
            stand = -1 if kinds - {"soft"} else 1 if x.container else 0
            kept.append(x)
            standing.append(stand)
            weight.append((MARK if stand < 0 else -KEEP if stand > 0 else 0.0) + (SOFT if "soft" in kinds and stand >= 0 else 0.0))
    return kept, np.array(standing, int), np.array(weight)


def scores(lines: list[Line], standing: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The smoothed logarithm of each line's text-to-tag ratio. A region is a run of lines that stand alike in one article."""
    link = np.where(standing > 0, WITHIN[0], ELSEWHERE[0])
    ratio = np.array([(len(x.text) - (1 - k) * x.link) / max(1, x.tags) for x, k in zip(lines, link, strict=True)])
    out = np.log(np.maximum(ratio, LEAST_RATIO)) - weight
    keys = [(s, x.container) for s, x in zip(standing.tolist(), lines, strict=True)]
    starts = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]
    for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
        out[a:b] = smoothed(out[a:b], (WITHIN if standing[a] > 0 else ELSEWHERE)[1])
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines, standing, weight = placed(parser.lines)
    if not lines:
        return ""
    score = scores(lines, standing, weight)
    cut = content_cut(score, standing)
    if cut == -math.inf and (standing < 0).all():
        return ""
    content = score > cut
    if not (standing > 0).any():  # headings and paragraphs between and next to content lines
        rows = np.flatnonzero(standing == 0).tolist()
        at = [k for k, i in enumerate(rows) if content[i]]
        if at:
            a, b = at[0], at[-1]
            while a and lines[rows[a - 1]].block in PROSE:
                a -= 1
            while b + 1 < len(rows) and lines[rows[b + 1]].block in PROSE:
                b += 1
            content[rows[a : b + 1]] = True
    return "\n".join(x.text for x, keep in zip(lines, content, strict=True) if keep)


@F.arrow_udf(T.StringType())
def _extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for pages in batches:
        yield pa.array([main_text(x.as_py()) for x in pages], pa.string())


def extract_main_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text of each row's html; a column of that name is replaced.

    Null and empty html give the empty text, repeated rows one each, an empty table none; other columns are left as they are.
    """
    return pages.withColumn(out, _extract(F.col(html)))
