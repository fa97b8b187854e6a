"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

A page is read by the standard library's streaming parser. Its events make lines: a line ends where a block element
begins or ends, whether or not the markup is well formed. A line has its characters of text, those of them in links, the number of
tags since the line before, and where it stands: inside ``article`` or ``main``, and inside an element whose class, id or role
has a word such as ``ad`` or ``sidebar``, a hint. Elements that never hold main text (``nav``, ``footer``, ``form``, ``script`` ...) have no lines.

The text-to-tag ratio of a line is at most ``FULL``, so that a long block counts no more than a paragraph; a hint leaves a tenth of it, and three
or more neighbouring lines that are mostly links have none. The ratios are smoothed by a Gaussian and split at a share of their standard deviation; lines above
it are the seeds of clusters. A cluster grows over the lines next to it that are text rather than markup; it does not grow over runs of links,
over lines with a hint whose own ratio is below the threshold, or past an element without lines. The clusters are the content, with such lines of
the same region apart from them. Where most of the text stands in marked regions, to stand outside of them is a hint too.

A hint is weak evidence: it does not count on ``article``, ``main`` and ``body``, on headings inside a region, nor on an element that holds more than half of the
page's text while no region stands outside it, so no word can take the article away.

Null, empty and text-free pages give an empty text. Repeated pages are rows of their own; columns other than the three
named are ignored; nothing is dropped or shortened within a line. An end tag that nothing opened is ignored; elements left open end
with the page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import by_bytes

SIGMA = 1.5
#: Share of the standard deviation of the smoothed ratios above which a line belongs to a cluster.
CUT = 0.5
#: Characters per tag from which a line is text and nothing else; with ``CUT`` no such line by itself falls below the cut.
FULL = 100.0
#: What a hint leaves of a line's ratio, the least threshold for the own ratio of a doubtful line, and lines of links that make a list.
HINT, FLOOR, LINKS = 0.1, 15.0, 3
#: The hint of lines outside of the regions that have most of the text.
OUTSIDE = -1
#: A line of more tags than this and fewer characters per tag is mostly markup.
FEW_TAGS, SPARSE = 3, 10.0

# Element names of HTML.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noframes noscript ol option p pre search section select summary table tbody td template tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("aside button canvas datalist dialog footer form head header iframe map menu nav noembed noframes noscript object option script search select style svg template textarea title".split())
REGIONS = frozenset(("article", "main"))
#: Elements on which a hint does not count.
EXEMPT = REGIONS | {"html", "body"}
#: Elements whose start or end closes an open paragraph.
CLOSES_P = BLOCKS - {"br", "body", "html"}
#: Words of a class, id or role that mark what is not main text.
NOISE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|footer|foot|gdpr|header|masthead|menu|nav|navbar|navigation|newsletter|notice|popup|modal|overlay|promo\w*|recommend\w*|related|replies|respond|share|sharing|sidebar|side|skip|social|sponsor\w*|subscribe|toolbar|topbar|widget|contentinfo|complementary|alert\w*|signup|login|search)(?:$|[\s_-])")
BLANK = re.compile(r"\s+")


HEADINGS = frozenset(f"h{i}" for i in range(1, 7))


class Line(NamedTuple):
    """``off``: no text of its own, where an element without lines stood; ``hint``: number of the outermost hinted element."""

    text: str
    tags: int
    off: bool
    region: int
    hint: int
    links: int


class Lines(HTMLParser):
    """Collects the lines of one page from the parser's events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        # element, whether it never holds text, region, hint, whether in a link
        self.open: list[tuple[str, bool, int, int, bool]] = []
        self.parts: list[str] = []
        self.region = self.hint = self.dropped = self.tags = self.regions = self.hints = self.links = 0

    def _end_line(self) -> None:
        text = BLANK.sub(" ", "".join(self.parts)).strip()
        if text or self.dropped:
            self.lines.append(Line(text, self.tags, not text, self.region, self.hint, self.links))
            self.tags = 0
        self.parts, self.dropped, self.links = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._end_line()
        self.tags += 1
        if tag in VOID:
            return
        if tag == "body" and any(x[0] == "head" for x in self.open):
            self._close("head")  # a head that nothing closed
        if tag in CLOSES_P and any(x[0] == "p" for x in self.open):
            self._close("p")
        _, off, region, hint, link = self.open[-1] if self.open else ("", False, 0, 0, False)
        if not off and tag not in ("html", "body"):
            # a heading block of the article itself is content, that of the page is not
            off = (tag in NEVER and not (tag == "header" and region)) or any(k == "hidden" for k, _ in attrs)
        if tag in REGIONS and not region:
            self.regions += 1
            region = self.regions
        if tag in HEADINGS and region:
            hint = 0
        elif not hint and not off and tag not in EXEMPT and attrs and not (tag == "header" and region) and any(v and k in ("class", "id", "role") and NOISE.search(v.lower()) for k, v in attrs):
            self.hints += 1
            hint = self.hints
        self.open.append((tag, bool(off), region, hint, link or tag == "a"))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            # an inline end tag does not close the blocks around it
            if tag not in BLOCKS and self.open[i][0] in BLOCKS:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_line()
        self.tags += 1
        self._close(tag)

    def handle_data(self, data: str) -> None:
        _, off, region, hint, link = self.open[-1] if self.open else ("", False, 0, 0, False)
        if off:
            self.dropped += not data.isspace()
        else:
            self.parts.append(data)
            if not data.isspace():
                self.region, self.hint = region, hint
                self.links += len(data.strip()) if link else 0

    def close(self) -> None:
        super().close()
        self._end_line()


def lines_of(html: str | None) -> list[Line]:
    """The lines of a page; hints that would take most of it away are left out."""
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    lines = parser.lines
    sizes, outside = Counter(), Counter()
    for x in lines:
        sizes[x.hint] += len(x.text) - x.links
        outside[x.hint] += len(x.text) if x.region else 0
    total, marked = sum(sizes.values()), sum(outside.values())
    weak = {h for h, n in sizes.items() if h and 2 * n > total and marked == outside[h]}
    lines = [x._replace(hint=0) if x.hint in weak else x for x in lines] if weak else lines
    # where most of the text without a hint stands in regions, to stand outside of them is a hint
    inside = sum(len(x.text) for x in lines if x.region and not x.hint)
    if inside and 2 * inside >= sum(len(x.text) - x.links for x in lines if not x.hint):
        lines = [x if x.region or x.hint else x._replace(hint=OUTSIDE) for x in lines]
    return lines


def link_runs(lines: list[Line]) -> np.ndarray:
    """The lines of runs of at least ``LINKS`` lines that are mostly links."""
    mostly = np.array([not x.off and 2 * x.links > len(x.text) for x in lines], bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mostly.astype(np.int8), [0]])))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        mostly[a:b] = b - a >= LINKS
    return mostly


def ratios(lines: list[Line]) -> np.ndarray:
    """Characters per tag of every line, ``FULL`` at most; a tenth with a hint, none for elements without lines and lists of links."""
    raw = np.array([0.0 if x.off else min(len(x.text) / max(x.tags, 1), FULL) * (HINT if x.hint else 1.0) for x in lines])
    raw[link_runs(lines)] = 0.0
    return raw


def smoothed(raw: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(raw, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def _is_text(line: Line) -> bool:
    return not line.off and (line.tags <= FEW_TAGS or len(line.text) / line.tags >= SPARSE)


def main_text(html: str | None, cut: float = CUT) -> str:
    """Blocks of main text in page order, joined by an empty line. ``cut`` is the share of the standard deviation that splits lines."""
    lines = lines_of(html)
    if not lines:
        return ""
    raw = ratios(lines)
    smooth = smoothed(raw)
    edge = cut * smooth.std()
    high, some = smooth >= edge, np.array([not x.off for x in lines])
    # what a cluster grows over: lines of text, and lines above the edge; with a hint or in a list of links by their own ratio
    region = np.array([x.region for x in lines])
    marked = region > 0
    doubtful = np.array([bool(x.hint) for x in lines]) | link_runs(lines)
    fit = some & (high | np.array([_is_text(x) for x in lines])) & (~doubtful | (raw >= (max(edge, FLOOR) if cut > 0 else edge)))
    seeds = fit & high
    if not seeds.any():
        return ""
    run = np.cumsum(np.concatenate([[True], fit[1:] != fit[:-1]]))
    kept = fit & np.isin(run, np.unique(run[seeds]))
    if (seeds & marked).any():  # what stands in a region apart from its clusters
        kept |= fit & marked & np.isin(region, np.unique(region[seeds & marked]))
    return "\n\n".join(lines[i].text for i in np.flatnonzero(kept))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                for a, b in by_bytes(map(len, texts)):
                    yield pa.RecordBatch.from_arrays([part.column(0)[a:b], part.column(1)[a:b], pa.array(texts[a:b], pa.string())], ["page_id", "url", "text"])

    picked = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = picked.mapInArrow(run, f"page_id {picked.schema['page_id'].dataType.simpleString()}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
