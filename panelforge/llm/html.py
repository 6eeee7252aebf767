"""Main text of web pages: clusters of smoothed text-to-tag ratios over parser events.

The standard parser's events are read once. A line is what stands between two block-level
tags; its text-to-tag ratio is its number of characters for each tag met since the line
before, the one that ends it included. Lines of elements that are no article by their very tag (menus, page headers,
footers, asides, forms, scripts, styles) or by a class, id or role made of nothing but
such words (``cookie-notice``, but not ``related-work``) are *suspects*: their ratio
counts as zero. Ratios are smoothed with a Gaussian; a run of lines whose smoothed ratio
passes the threshold is a cluster, and a line of a cluster that passes it by itself too
is a core line. The threshold is the ratios' standard deviation, and ``PROSE`` where that
is more, so that one huge line does not hide a page's other paragraphs.

Core lines choose what is read:
* the region is the smallest container that covers every core line, and every h1 unless
  an article holds one; of several article elements those with a core line count;
* inside it a suspect element is left out where it has no core line, and all other lines
  are kept, short ones too. Words of a class that also name ordinary things (``related``,
  ``social``, ``menu``) take nothing from the ratios: such an element goes only where the
  clusters find no content in it.
* A class is not believed where the element holds prose and half of the page's text or more
  and neither prose nor an article element is outside it.

Character references are decoded, white space inside a line is one space, lines are
trimmed and joined by a line feed; ``<br>`` is white space. A header in an article is
part of it. An article or main element ends a suspect element that was left open before,
unless its tag says by itself that it is no article.

Defined cases: null and empty pages give an empty text; markup that ends early is read
as far as it goes; text outside any tag is a line; a page without a core line is read
whole but for its suspects; repeated rows are read each by itself; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_columns, slices, text_strings

SIGMA = 1.0
RADIUS = 2
#: Characters a tag from which a line is prose whatever the rest of the page is like.
PROSE = 20.0

VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINER = frozenset("article body div main section table td center".split())
#: Elements that are never part of the article.
HARD = frozenset(
    "head script style noscript template iframe svg canvas object nav menu aside footer form button select "
    "textarea dialog".split()
)
HARD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu form".split())
#: Words of a class or id that name what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer header masthead modal nav navbar navigation newsletter notice popup promo promoted sidebar sponsor "
    "sponsored subscribe".split()
)
#: The same for words with another everyday meaning: the clusters have the last word.
WEAK = frozenset("menu related respond share sharing social toolbar widget widgets".split())
#: Words that may stand beside a mark and say nothing of their own.
BESIDE = frozenset(
    "area bar block body bottom box center col column container content desktop div fixed global gpt inner item items left link links "
    "list main mobile outer overlay page primary reader right row secondary section signup site slot small sticky top "
    "unit user wrap wrapper".split()
)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: An open paragraph ends where one of these begins.
_ENDS_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
NOT, WEAKLY, MARKED, SURELY = range(4)


def suspicion_of_name(name: str) -> int:
    """How far a class or id says that an element is no article: by whole names only."""
    named = [w.lower() for w in _WORDS.findall(name) if not w.isdigit() and w.lower() not in BESIDE]
    if not named or not all(w in MARKS or w in WEAK for w in named):
        return NOT
    return MARKED if any(w in MARKS for w in named) else WEAKLY


def suspicion(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> int:
    if tag in HARD or tag == "header" and not in_article:
        return SURELY
    if tag in ("body", "html", "main") or tag in HEADINGS:
        return NOT
    found = NOT
    for name, value in attrs:
        if name in ("class", "id") and value:
            names = (n for n in value.split() if not (in_article and "header" in n.lower()))
            found = max([found, *map(suspicion_of_name, names)])
        elif name == "role" and (value or "").lower() in HARD_ROLES:
            return SURELY
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return SURELY
        elif name == "style" and value and _HIDDEN.search(value):
            return SURELY
    return found


class Lines(HTMLParser):
    """The lines of a page (text, tags before it, node) and its nodes.

    A node is a container or a suspect element: its parent, tag and suspicion.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        #: Open elements: tag, suspicion, node outside of it.
        self.open: list[tuple[str, int, int]] = []
        self.count: Counter[str] = Counter()
        #: Tags of open suspect elements, and how many of them are so by their tag.
        self.suspects: list[str] = []
        self.sure = 0
        self.in_article = 0
        self.parents, self.kinds, self.suspicions = [-1], ["root"], [NOT]
        self.node = 0
        self.parts: list[str] = []
        self.part_node = 0
        #: Text of a suspect element inside a line, kept apart from it, and its node.
        self.aside: list[str] = []
        self.aside_node = 0
        self.tags = 0
        self.lines: list[tuple[str, int, int]] = []
        #: Places of lines that stand in an h1.
        self.headlines: set[int] = set()

    def end_line(self) -> None:
        for parts, node in ((self.parts, self.part_node), (self.aside, self.aside_node)):
            if parts:
                if text := " ".join("".join(parts).split()):
                    if parts is self.parts and self.count["h1"]:
                        self.headlines.add(len(self.lines))
                    self.lines.append((text, self.tags, node))
                    self.tags = 0
                parts.clear()

    def handle_starttag(self, tag: str, attrs) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.end_line()
            if tag in _ENDS_P and self.open and self.open[-1][0] != tag:
                self._close_inline_to("p")
            elif tag == "p" or tag == "li":
                self._close_inline_to(tag)
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            return
        if tag in ("article", "main"):
            while self.suspects and not self.sure:
                self._pop()
        found = suspicion(tag, attrs, self.in_article > 0)
        if found == WEAKLY and tag not in BLOCK:
            found = NOT
        self.open.append((tag, found, self.node))
        self.count[tag] += 1
        if found >= MARKED:
            self.suspects.append(tag)
        self.sure += found == SURELY
        self.in_article += tag in ("article", "main")
        if tag in CONTAINER or found:
            self.parents.append(self.node)
            self.kinds.append(tag)
            self.suspicions.append(found)
            self.node = len(self.parents) - 1

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _pop(self) -> None:
        tag, found, self.node = self.open.pop()
        self.count[tag] -= 1
        if found >= MARKED:
            self.suspects.pop()
        self.sure -= found == SURELY
        self.in_article -= tag in ("article", "main")

    def _close_inline_to(self, tag: str) -> None:
        """Close an open ``tag`` that only inline elements stand inside of."""
        if not self.count[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name == tag:
                while len(self.open) > k:
                    self._pop()
                return
            if name in BLOCK:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.end_line()
        if not self.count[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                while len(self.open) > k:
                    self._pop()
                return
            if self.open[k][0] in ("article", "main") and tag not in ("body", "html"):
                return

    def handle_data(self, data: str) -> None:
        if self.suspects and self.suspects[-1] not in BLOCK:
            self.aside_node = self.node
            self.aside.append(data)
        else:
            if not self.parts:
                self.part_node = self.node
            self.parts.append(data)

    def unknown_decl(self, data: str) -> None:
        """Marked sections are markup."""


def page_lines(html: str) -> Lines:
    reader = Lines()
    reader.feed(html)
    reader.close()
    reader.end_line()
    return reader


def smoothed(ratios: np.ndarray, sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, radius, mode="edge"), kernel / kernel.sum(), mode="valid")


def text_to_tags(lines: list[tuple[str, int, int]], believed: np.ndarray) -> np.ndarray:
    """Each line's ratio; lines of believed suspects (by node) count as zero."""
    return np.array([0.0 if believed[node] else len(t) / max(1, tags) for t, tags, node in lines])


def core_lines(ratios: np.ndarray) -> np.ndarray:
    """Which lines pass the threshold in a cluster and by themselves."""
    threshold = min(float(ratios.std()), PROSE)
    return (smoothed(ratios) > threshold) & (ratios > threshold)


def _inherited(reader: Lines, own: list[bool]) -> np.ndarray:
    """``own`` of a node or of any node outside of it; parents come before children."""
    out = np.array(own, bool)
    for c, p in enumerate(reader.parents):
        if p >= 0 and out[p]:
            out[c] = True
    return out


def _summed(reader: Lines, values: np.ndarray) -> list[int]:
    """Sums of lines' ``values`` over each node and all nodes inside it."""
    total = [0] * len(reader.parents)
    for (_, _, node), v in zip(reader.lines, values.tolist()):
        total[node] += v
    for c in range(len(total) - 1, 0, -1):
        total[reader.parents[c]] += total[c]
    return total


def _believed(reader: Lines) -> np.ndarray:
    """Nodes whose lines have no ratio: suspects by tag, and by class where that can be."""
    surely = _inherited(reader, [s == SURELY for s in reader.suspicions])
    own = [s >= MARKED for s in reader.suspicions]
    if not any(s == MARKED for s in reader.suspicions):
        return surely
    sizes = np.array([0 if surely[node] else len(t) for t, _, node in reader.lines], np.int64)
    inside = _summed(reader, sizes)
    ratios = text_to_tags(reader.lines, surely)
    before = np.maximum.accumulate(np.r_[0.0, ratios])
    after = np.maximum.accumulate(np.r_[ratios, 0.0][::-1])[::-1]
    articles = np.cumsum(np.r_[0, _inherited(reader, [k in ("article", "main") for k in reader.kinds])[[n for _, _, n in reader.lines]] & (sizes > 0)])
    first, last = _extents(reader)
    for c, s in enumerate(reader.suspicions):
        if s == MARKED and not surely[c] and 2 * inside[c] >= inside[0] > 0:
            a, b = first[c], last[c] + 1
            prose = max(before[a], after[b]) > PROSE or ratios[a:b].max() <= PROSE
            own[c] = prose or articles[-1] - articles[b] + articles[a] > 0
    return _inherited(reader, own)


def _extents(reader: Lines) -> tuple[list[int], list[int]]:
    """First and last line of each node with all nodes inside it."""
    first, last = [len(reader.lines)] * len(reader.parents), [-1] * len(reader.parents)
    for k, (_, _, node) in enumerate(reader.lines):
        first[node], last[node] = min(first[node], k), max(last[node], k)
    for c in range(len(first) - 1, 0, -1):
        p = reader.parents[c]
        first[p], last[p] = min(first[p], first[c]), max(last[p], last[c])
    return first, last


def region(reader: Lines, core: np.ndarray, out: np.ndarray) -> int:
    """The smallest container that covers all that counts as content."""
    nodes = np.array([node for _, _, node in reader.lines])
    may = ~out[nodes]
    cores = _summed(reader, core.astype(int))
    article = [k in ("article", "main") and not out[c] for c, k in enumerate(reader.kinds)]
    with_core = [a and cores[c] > 0 for c, a in enumerate(article)]
    own = _inherited(reader, with_core if any(with_core) else article)
    in_own = own[nodes] & may
    headline = np.zeros(len(nodes), bool)
    headline[list(reader.headlines)] = True
    counts = core | in_own
    if not (headline & in_own).any():
        counts |= headline & may
    inside = _summed(reader, counts.astype(int) * np.array([len(t) for t, _, _ in reader.lines]))
    lines = _summed(reader, may.astype(int))
    children: dict[int, list[int]] = {}
    for c, p in enumerate(reader.parents):
        children.setdefault(p, []).append(c)
    here, total = 0, inside[0]
    while reader.kinds[here] not in ("article", "main"):
        best = max(children.get(here, []), key=lambda c: inside[c], default=-1)
        if best < 0 or inside[best] < total:
            break
        if lines[best] < 2 and lines[here] > 1 and reader.kinds[best] not in ("article", "main"):
            break
        here = best
    return here


def main_text(html: str) -> str:
    reader = page_lines(html)
    if not reader.lines:
        return ""
    believed = _believed(reader)
    core = core_lines(text_to_tags(reader.lines, believed))
    if not core.any():
        core = ~believed[[node for _, _, node in reader.lines]]
        if not core.any():
            return ""
    cores = _summed(reader, core.astype(int))
    out = _inherited(reader, [s > NOT and not cores[c] for c, s in enumerate(reader.suspicions)])
    chosen = region(reader, core, out)
    within = _inherited(reader, [c == chosen for c in range(len(reader.parents))])
    return "\n".join(t for t, _, node in reader.lines if within[node] and not out[node])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, one row for each page row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(h) for h in text_strings(part, "html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string())],
                    names=["page_id", "url", "text"],
                )

    found = kept_columns(pages, ["page_id", "url", "html"]).mapInArrow(
        read, "page_id long, url string, text string"
    )
    return found.withColumn("n_chars", F.length("text").cast("long"))
