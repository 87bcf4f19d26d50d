"""The main block of a page without marked article: text and link density of its blocks, over a parse tree, in Arrow batches."""

from __future__ import annotations

from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.batches import by_few, small_batches

#: Elements that hold other blocks, those that end a block of text, those that never hold an article, and those without an end tag.
_HOLDERS = frozenset("html body div section article main table tbody tr td ul ol dl center figure".split())
_BREAKS = _HOLDERS | frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 li dt dd th hr br address figcaption".split())
_SKIPPED = frozenset("head script style nav header footer aside form noscript template iframe svg select button".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

LEAST = 25  # characters of a block that counts
LEVELS = 8  # how far up a block's weight is felt, halved at each level
SHARE = 0.2  # a neighbour of the main block with this share of its score belongs to it
LINKED = 0.5  # blocks with more of their text in links go


class _Blocks(HTMLParser):
    """Blocks of text in order: (number of the holder, text, characters in links); and the holder of each holder."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parents, self.blocks = [-1], []
        self.open: list[tuple[str, int]] = [("", 0)]  # open holders
        self.skips: list[str] = []
        self.parts: list[str] = []
        self.linked, self.in_link = 0, False

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((self.open[-1][1], text, min(self.linked, len(text))))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SKIPPED:
            self.flush()
            self.skips.append(tag)
        elif not self.skips:
            if tag in _BREAKS:
                self.flush()
            if tag in _HOLDERS:
                self.parents.append(self.open[-1][1])
                self.open.append((tag, len(self.parents) - 1))
            elif tag == "a":
                self.in_link = True

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in _VOID or tag not in _SKIPPED:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.skips:
            if tag in self.skips:
                while self.skips.pop() != tag:
                    pass
            return
        if tag == "a":
            self.in_link = False
        elif tag in _BREAKS:
            self.flush()
            at = next((k for k in range(len(self.open) - 1, max(0, len(self.open) - 64), -1) if self.open[k][0] == tag), None)
            if at is not None:
                self.in_link = False
                del self.open[at:]

    def handle_data(self, data: str) -> None:
        if not self.skips:
            self.parts.append(data)
            if self.in_link:
                self.linked += len(data.strip())


def main_text(page: str | None) -> str | None:
    """The paragraphs of the main block, each as <p>, escaped; null where no block has 25 characters beside links.

    A block's weight is its length times the square of the share outside links. A holder's score is the weight of its own blocks, half that of its
    children's, and so on; the holder with the highest score, the first of equal ones, is the main block. Its neighbours under the same holder with a fifth
    of its score belong to it. Blocks that are mostly links go."""
    if not page:
        return None
    tree = _Blocks()
    tree.feed(page)
    tree.close()
    tree.flush()
    scores = [0.0] * len(tree.parents)
    for holder, text, linked in tree.blocks:
        weight = len(text) * (1 - linked / len(text)) ** 2 if len(text) >= LEAST else 0.0
        for _ in range(LEVELS):
            if holder < 0 or not weight:
                break
            scores[holder] += weight
            holder, weight = tree.parents[holder], weight / 2
    best = max(range(len(scores)), key=scores.__getitem__)
    if not scores[best]:
        return None
    within: list[bool] = []  # holders come after those that hold them
    for k, parent in enumerate(tree.parents):
        beside = parent >= 0 and parent == tree.parents[best] and scores[k] >= SHARE * scores[best]
        within.append(k == best or beside or (parent >= 0 and within[parent]))
    return "".join(f"<p>{escape(text, quote=False)}</p>" for holder, text, linked in tree.blocks if within[holder] and linked <= LINKED * len(text))


@F.arrow_udf(T.StringType())
def _main(pages: pa.Array) -> pa.Array:
    return by_few(main_text, pages.type, pages)


def main_block(page: str | Column) -> Column:
    """main_text() of a column. Pages that are null cost nothing."""
    small_batches()
    return _main(page)
