"""The main text of web pages: the run of tokens with the largest sum of weights, found in one pass with a stack of open tags.

A page is a row of tokens: texts, tags, and things that are never seen (comments, scripts, styles). A word of a text weighs +1, but -1 inside a link, a menu or the
like; a tag weighs -2 if it starts a block, else 0. The main text is the run of tokens whose weights have the largest sum: dense text holds together across its own
tags, menus and link lists are left out. Of equal sums the run that begins first, then the shortest, is taken; if no sum is above 0 there is no main text.

Broken markup has a defined meaning: a tag that nothing closes stays open to the end of the page; a closing tag closes the innermost open one of its name and
what is open inside it, and is nothing where none is open; a ``<`` without a ``>`` after it is text; a comment, script or style without its end is a tag.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow

_TAG = re.compile(r"<(/?)([a-z][a-z0-9]*)\b", re.I)
#: Elements that are never seen, and their ends.
_UNSEEN = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style", "noscript", "template")}
#: Elements whose words count against a run, and elements that do not interrupt a line.
APART = frozenset("a nav header footer aside form button select menu figcaption".split())
INLINE = frozenset("a abbr b bdi bdo cite code em font i img kbd mark q s samp small span strong sub sup time u var wbr".split())
BLOCK_WEIGHT = -2


def _parts(page: str) -> Iterator[tuple[str, str, bool]]:
    """(kind, text or tag, whether it closes): kind is text, tag or unseen. Every character is looked at once: what has no end is found to have none once."""
    i, n, last = 0, len(page), page.rfind(">")
    unended = {"--": page.rfind("-->")}  # the last end of a kind, where it is known
    while i < n:
        if page[i] != "<" or i > last:
            j = page.find("<", i + 1) if i < last else n
            j = n if j < 0 else j
            yield "text", page[i:j], False
            i = j
            continue
        if page.startswith("<!--", i) and unended["--"] >= i + 4:
            i = page.index("-->", i + 4) + 3
            yield "unseen", "", False
            continue
        m, end = _TAG.match(page, i), page.index(">", i) + 1
        if m and not m[1] and (tag := m[2].lower()) in _UNSEEN and unended.get(tag, n) > i:
            if close := _UNSEEN[tag].search(page, end):
                i = close.end()
                yield "unseen", "", False
                continue
            unended[tag] = i
        if m:
            yield "tag", m[2].lower(), bool(m[1])
        elif page[i + 1] in "!?/":
            yield "unseen", "", False
        else:
            end = i + 1
            yield "text", "<", False
        i = end


def tokens(page: str) -> Iterator[tuple[int, str]]:
    """(weight, text) of each token; a block's tag has a line feed, an inline one nothing, as their text."""
    open_: list[str] = []  # the elements apart that are open, innermost last
    count: Counter = Counter()
    for kind, what, closes in _parts(page):
        if kind == "text":
            words = len(what.split())
            yield (-words if open_ else words), entities.unescape(what)
        elif kind == "unseen":
            yield 0, ""
        else:
            if what in APART and not closes:
                open_.append(what)
                count[what] += 1
            elif count[what]:
                inner = None
                while inner != what:
                    inner = open_.pop()
                    count[inner] -= 1
            yield (0, "") if what in INLINE else (BLOCK_WEIGHT, "\n")


def best_run(weights: list[int]) -> tuple[int, int, int]:
    """(sum, first, end) of the run with the largest sum above 0; of equal ones the first, then the shortest. (0, 0, 0) if there is none.

    The best run that ends at a token goes on from the one that ends before it unless that one's sum is below 0: at 0 it goes on, to begin first.
    """
    best, total, first = (0, 0, 0), 0, 0
    for i, w in enumerate(weights):
        if total < 0:
            total, first = 0, i
        total += w
        if total > best[0]:
            best = total, first, i + 1
    return best


def main_text(page: str | None) -> tuple[str, int, int]:
    """The main text of a page, one line for each block, and the range of its tokens."""
    all_ = list(tokens(page or ""))
    _, first, end = best_run([w for w, _ in all_])
    lines = (" ".join(x.split()) for x in "".join(t for _, t in all_[first:end]).split("\n"))
    return "\n".join(x for x in lines if x), first, end


def main_texts(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, text, first, end) of every row; a null page has no main text. Pages go one by one through their task, their results leave it some megabytes at a time, nothing is shuffled."""

    def run(batches):
        for batch in arrow.parts(batches):
            made = [main_text(x) for x in batch.column(1).to_pylist()]
            texts, first, end = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(first, pa.int32()), pa.array(end, pa.int32())], [key, "text", "first", "end"])

    return pages.select(F.col(key).cast("long").alias(key), F.col(html).cast("string").alias(html)).mapInArrow(run, f"`{key}` long, text string, first int, end int")
