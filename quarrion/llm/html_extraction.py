"""Main text of web pages from text-to-tag ratios.

The standard library's parser streams events; they are cut into lines, one per block-level element. A line's ratio is its
characters over its tags. Markup does nothing but set a ratio to 0: of lines inside menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments; where the page marks its article (article, main,
role=main), of lines outside it; elsewhere, of lines that are mostly links and neither paragraphs nor headings.

On every page, marked or not, clusters of the smoothed ratios choose the lines. Ratios are cut at their lower quartile by
characters (a quarter of the text is in lines of at most that ratio), so that one long line doesn't outweigh the others, and
smoothed with a Gaussian kernel; the threshold is one standard deviation of the smoothed ratios. A line at or above
it is in a cluster if it is prose (a paragraph, heading, item or cell), or if it or a line beside it, of the same element and
parent, reaches the quartile on its own: smoothing alone lifts no menu, advert or footer that is a short block by itself.

A cluster grows in both directions, inside the innermost element that holds all clusters, over prose, and over blocks of which
one of the same element and parent reaches the quartile (but for those at the top of the page). Other lines are left out; more
than GAP of them in a row, or the end of that element, end the growth. Lines of ratio 0 are never taken. A footer that
nothing but its text tells from a paragraph is taken.

An element isn't content if a class or its id begins or ends with a word that names such a part (STRONG_NAMES:
`user-comments`, `ad-300x250`), or is made of such words, NOT_NAMES and LAYOUT words only (`share-buttons`, but not
`share-price`). Headings and paragraphs are never dropped by their own names.

Defined results: a null or empty page gives the empty text; white space is what str.split takes as such; unclosed
elements end with their parent, and a paragraph where the next block starts. Rows are independent, so repeated rows
give repeated results. The id keeps its type. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.llm.arrow import slices, texts
from quarrion.shipping import shipped

# HTML elements by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
BREAK_P = BLOCK - {"html", "head", "body", "title"}
NEVER = frozenset("aside audio button canvas dialog footer form head iframe menu nav noscript object option script search select style svg template textarea title video".split())
MARKED = frozenset(("article", "main"))
NOT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
NOT_NAMES = frozenset(
    "ad ads adslot advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice pagination paywall popup promo promoted promotion related share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Names that say enough at the start or the end of a longer one.
STRONG_NAMES = frozenset("ad ads adslot advert advertisement advertising adverts breadcrumb breadcrumbs comments cookie cookies disqus gdpr newsletter paywall popup promo sidebar sponsored".split())
#: What a class that names such a part adds to it.
LAYOUT = frozenset("area bar block bottom box button buttons container content form global icons inner item items left link links list main outer page panel post posts primary right row secondary section site slot sub top unit wrap wrapper".split())
NAMELESS = frozenset("html body main p h1 h2 h3 h4 h5 h6".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: A line with a larger share of link text is part of a menu, where the page doesn't mark its article.
LINK_SHARE = 0.6
#: Elements whose lines are prose.
PROSE = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
#: Of these, the ones that stay if they are one link.
LINKED = frozenset("blockquote h1 h2 h3 h4 h5 h6 p".split())
#: Elements whose children aren't siblings in one block of text.
TOP = frozenset(("", "html", "body"))
#: Lines in a row that a cluster grows over without taking them.
GAP = 3
#: Standard deviation of the smoothing, in lines.
SIGMA = 1.0


class Lines(HTMLParser):
    """Collects (text, tags, inside, links, node) per line; inside is True in a marked article, False in what isn't content,
    else None; links is the number of its characters that are link text; node is its innermost block-level element, of
    which names has the tag and parent the node around it (0 is the page)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool | None, int]] = []
        self.out: list[tuple[str, int, bool | None, int, int]] = []
        self.names, self.parent = [""], [0]
        self.words: list[str] = []
        self.tags = self.links = 0

    def inside(self) -> bool | None:
        return self.open[-1][1] if self.open else None

    def node(self) -> int:
        return self.open[-1][2] if self.open else 0

    def block(self) -> bool | None:
        """What the innermost block means."""
        return next((inside for tag, inside, _ in reversed(self.open) if tag in BLOCK), None)

    def cut(self) -> None:
        if text := " ".join("".join(self.words).split()):
            self.out.append((text, self.tags, self.block(), self.links, self.node()))
        self.words, self.tags, self.links = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BREAK_P:
            self.leave("p")
        if tag in BLOCK:
            self.cut()
        self.tags += 1
        if tag == "br":
            self.words.append(" ")
        if tag not in VOID:
            node = self.node()
            if tag in BLOCK:
                self.names.append(tag)
                self.parent.append(node)
                node = len(self.parent) - 1
            self.open.append((tag, self.meant(tag, dict(attrs)), node))

    def meant(self, tag: str, attrs: dict[str, str | None]) -> bool | None:
        inside = self.inside()
        if inside is False or tag in NEVER or (tag == "header" and not inside):
            return False
        role = (attrs.get("role") or "").lower()
        if role in NOT_ROLES or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or HIDDEN.search(attrs.get("style") or ""):
            return False
        if tag not in NAMELESS and self.named_away([*(attrs.get("class") or "").lower().split(), (attrs.get("id") or "").lower()]):
            return False
        return True if tag in MARKED or role == "main" else inside

    @staticmethod
    def named_away(names: list[str]) -> bool:
        parts = [re.split("[_-]+", n) for n in names]
        return any(not STRONG_NAMES.isdisjoint((p[0], p[-1])) or (not NOT_NAMES.isdisjoint(p) and NOT_NAMES | LAYOUT >= set(p)) for p in parts)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def leave(self, tag: str) -> None:
        """Closes the innermost open element of that name, and a paragraph only within its own block."""
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                if any(t in BLOCK for t, _, _ in self.open[at:]):
                    self.cut()
                del self.open[at:]
                return
            if tag == "p" and self.open[at][0] in BLOCK:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.cut()
        self.leave(tag)

    def handle_data(self, data: str) -> None:
        if self.inside() is False and self.block() is not False:
            return  # an inline element that isn't content, in a block that may be
        self.words.append(data)
        if any(tag == "a" for tag, _, _ in self.open):
            self.links += len(data.strip())


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), "valid")


def cut_ratios(ratios: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Ratios, at most the one up to which a quarter of the characters lie in lines that can be content."""
    order = np.argsort(ratios, kind="stable")
    order = order[ratios[order] > 0]
    reached = np.cumsum(chars[order])
    return np.minimum(ratios, ratios[order[np.searchsorted(reached, reached[-1] / 4)]])


def chosen(ratios: np.ndarray, chars: np.ndarray, nodes: list[int], names: list[str], parent: list[int]) -> list[bool]:
    """Which lines the clusters take. Lines that can't be content have ratio 0."""
    out = [False] * len(nodes)
    if not ratios.any():
        return out
    own = cut_ratios(ratios, chars)
    even = smoothed(own)
    least, full = even.std(), own.max()
    kinds = {(parent[nodes[k]], names[nodes[k]]) for k in np.flatnonzero(own >= full).tolist()}

    def alike(k: int) -> bool:
        return (parent[nodes[k]], names[nodes[k]]) in kinds

    clusters = [k for k in np.flatnonzero((even >= least) & (ratios > 0)).tolist() if names[nodes[k]] in PROSE or alike(k)]
    clusters = clusters or [int(ratios.argmax())]
    around = parent[nodes[clusters[0]]]
    for node in (parent[nodes[k]] for k in clusters):
        while node != around:  # an element comes after those around it
            node, around = (parent[node], around) if node > around else (node, parent[around])
    within = [False] * len(parent)
    within[around] = True
    for node in range(around + 1, len(parent)):
        within[node] = within[parent[node]]

    def grows(k: int) -> bool:
        return names[nodes[k]] in PROSE or (alike(k) and names[parent[nodes[k]]] not in TOP)

    for k in clusters:
        out[k] = True
    for step, ends in ((1, clusters), (-1, clusters[::-1])):
        for at in ends:
            k, left = at + step, GAP
            while 0 <= k < len(nodes) and not out[k] and within[nodes[k]] and left >= 0:
                if ratios[k] > 0:
                    out[k] = grows(k)
                    left = GAP if out[k] else left - 1
                k += step
    return out


def main_text(html: str) -> str:
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.cut()
    if not parser.out:
        return ""
    marks = any(inside is True for _, _, inside, _, _ in parser.out)

    def ratio(text: str, tags: int, inside: bool | None, links: int, node: int) -> float:
        menu = inside is None and links > LINK_SHARE * len(text) and parser.names[node] not in LINKED
        return 0.0 if inside is False or (marks and not inside) or menu else len(text) / max(1, tags)

    ratios = np.array([ratio(*line) for line in parser.out])
    chars = np.array([len(line[0]) for line in parser.out])
    take = chosen(ratios, chars, [line[-1] for line in parser.out], parser.names, parser.parent)
    return "\n\n".join(line[0] for line, own in zip(parser.out, take, strict=True) if own)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 128):
        found = [main_text(x.decode()) for x in texts(batch.column("html"))]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    rows = shipped(pages).select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extracted, f"page_id {pages.schema[id_col].dataType.simpleString()}, url string, text string, n_chars long")
