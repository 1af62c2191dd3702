"""Main text of web pages from parser events.

The standard library's parser streams events once over the page. Text is cut into lines at block tags; every line
carries the length of its text, the number of tags that stood in it, and how much of the text is links. Lines inside
elements that never hold an article (menus, headers, footers, sidebars, forms, notices, adverts, comments of readers,
scripts, styles) are out of the running. The text-to-tag ratios of the other lines are smoothed with a Gaussian over
their neighbours, and a threshold from two clusters of the logarithms tells content from the rest. Contiguous content
is widened to the whole of an article or main element that holds most of it, so that short paragraphs and headings
between long ones stay.

Null pages give an empty text. Character references are decoded, white space inside a block becomes one space, blocks
are joined by an empty line.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame

from grainmill.llm.text import Slice, map_text

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody
    td tfoot th thead tr ul""".split())
NEVER = frozenset("""script style noscript template nav footer aside form select button textarea input head iframe
    svg canvas object dialog menu title option""".split())
CLOSES_P = BLOCKS - frozenset("body html".split())
#: Words of class, id and role attributes that mark what is no part of an article.
OUTSIDE = re.compile(r"(?:^|[^a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|popup|modal"
                     r"|comments?|commentlist|disqus|replies|respond|sidebar|side|nav\w*|menu\w*|breadcrumbs?|footer"
                     r"|header|masthead|social|share|sharing|related|recommend\w*|newsletter|subscribe|login|search"
                     r"|widget\w*|pagination|pager|toolbar|alert|gdpr|copyright|complementary|contentinfo|navigation"
                     r"|skip|hidden|toc)(?![a-z])")
HOLDS = frozenset(("article", "main"))
SPACE = re.compile(r"\s+")


class Lines(HTMLParser):
    """Collects (text, tags, link characters, holder, inside) for each block; holder numbers article elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.stack: list[tuple[str, bool]] = []
        self.out = self.links = self.tags = self.linked = self.holders = 0
        self.inside: list[int] = []
        self.text: list[str] = []

    def cut(self) -> None:
        text = SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append((text, self.tags, self.linked, self.inside[-1] if self.inside else 0))
        self.text, self.tags, self.linked = [], 0, 0

    def leave(self, at: int) -> None:
        """Close the open elements from `at` on."""
        while len(self.stack) > at:
            name, out = self.stack.pop()
            if name in BLOCKS:
                self.cut()
            self.out -= out
            self.links -= name == "a"
            if name in HOLDS and self.inside:
                self.inside.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        if tag in CLOSES_P:
            for at in range(len(self.stack) - 1, -1, -1):
                if self.stack[at][0] == "p":
                    self.leave(at)
                    break
                if self.stack[at][0] in BLOCKS:
                    break
        if tag in BLOCKS:
            self.cut()
        self.tags += 1
        if tag in VOID:
            return
        named = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower()
        hidden = any(k == "hidden" for k, _ in attrs)
        article = tag in HOLDS or any(n in HOLDS for n, _ in self.stack) and tag in ("header", "h1")
        out = (tag in NEVER or hidden or tag == "header" and not article
               or bool(named) and tag not in ("body", "html", "article", "main") and bool(OUTSIDE.search(named)))
        self.stack.append((tag, out))
        self.out += out
        self.links += tag == "a"
        if tag in HOLDS:
            self.holders += 1
            self.inside.append(self.holders)

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                self.leave(at)
                return
            if self.stack[at][0] in BLOCKS and tag not in BLOCKS:
                return  # an inline end tag does not close a block
        self.tags += 1

    def handle_data(self, data: str) -> None:
        if self.out == 0:
            self.text.append(data)
            self.linked += len(data) if self.links else 0

    def finish(self, page: str) -> list[tuple[str, int, int, int]]:
        self.feed(page)
        self.close()
        self.leave(0)
        self.cut()
        return self.lines


def smooth(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian mean over neighbouring lines, weights renewed at the edges."""
    reach = int(3 * sigma)
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma**2))
    return (np.convolve(values, kernel, "full")[reach:reach + len(values)]
            / np.convolve(np.ones(len(values)), kernel, "full")[reach:reach + len(values)])


def split_point(values: np.ndarray) -> float:
    """The middle between two cluster means (k-means on a line); below all values if they hardly differ."""
    low, high = float(values.min()), float(values.max())
    if high - low < 1:
        return low - 1
    for _ in range(20):
        middle = (low + high) / 2
        a, b = values[values <= middle].mean(), values[values > middle].mean()
        if abs(a - low) + abs(b - high) < 1e-9:
            break
        low, high = float(a), float(b)
    return (low + high) / 2


def main_text(page: str | None) -> str:
    """The article of one page."""
    if not page:
        return ""
    lines = Lines().finish(page)
    if not lines:
        return ""
    lengths = np.array([len(t) for t, _, _, _ in lines], float)
    ratio = (lengths - np.array([x for _, _, x, _ in lines])) / (1 + np.array([n for _, n, _, _ in lines]))
    score = smooth(np.log1p(np.maximum(ratio, 0)))
    content = score > split_point(score)
    holder = np.array([h for *_, h in lines])
    if holder.any():  # whole articles that have content
        inside = np.unique(holder[content & (holder > 0)]) if (content & (holder > 0)).any() else np.unique(holder[holder > 0])
        content = np.isin(holder, inside) & (holder > 0)
    else:  # from the first to the last line of content, without lines that are links
        found = np.flatnonzero(content)
        span = np.zeros(len(lines), bool)
        span[found[0]:found[-1] + 1] = True
        content = span & (np.array([x for _, _, x, _ in lines]) < 0.5 * lengths)
    return "\n\n".join(t for (t, *_), keep in zip(lines, content, strict=True) if keep)


def extract(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """`keep` columns, text and n_chars."""
    def judge(part: Slice) -> dict:
        texts = [main_text(bytes(part.bytes_of(r)).decode("utf-8")) for r in range(part.rows)]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return map_text(pages, html, {"text": "string", "n_chars": "long"}, judge, keep)
