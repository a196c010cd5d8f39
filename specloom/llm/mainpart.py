"""Main text of web pages by the distribution of text over lines.

1. Markup is stripped. Each block of the page is a line; what stands in menus, headers, footers, side
   bars, notices, adverts, forms, scripts, styles and comments is left out, and as many lines without text
   as a window is long stand in its place (none inside of an article or main element). Of a line its
   characters outside of links are measured; the cells of a table row and the items of a list are
   measured as one line, unless all of them are links. On a page with an article or main element lines
   outside of it have none.
2. These lengths are summed over a sliding window of lines. The main part surges where a sum reaches a
   threshold and reaches back, and on, until a window holds nothing: there it dives.
3. The lines between the first surge and the last dive are the text, whatever stands between them.

So an article loses a run of links that begins or ends it, if it is as long as a window, and a page
without an article keeps short first and last lines beside long ones.
"""

from __future__ import annotations

import html as references
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from specloom.llm.bpe import small_batches
from specloom.llm.common import ship

#: Lines of a window, and the characters in it from which on it belongs to a main part.
WINDOW, SURGE = 3, 80

# Kinds of elements, and words of classes, ids and roles that mark what isn't main text.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas audio video textarea title xmp".split())
OUTSIDE = frozenset("nav footer aside form menu dialog button select datalist head".split())
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
LISTS, ROWS = frozenset("ul ol dl menu dir".split()), frozenset("tr table".split())
CELLS = frozenset("td th li dt dd ul ol dl menu dir".split())  # may stand in a line that is measured as one
MAIN = frozenset(("article", "main"))
NEVER_AROUND_MAIN = frozenset(("nav", "header", "footer", "menu", "form"))
# Elements that a class, id or role may mark; on others a class names an advert, or nothing.
CONTAINERS = frozenset("div section ul ol dl table center fieldset details".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion".split())
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
MARKS = ADVERTS | COMMENTS | frozenset(
    "sidebar nav navbar navigation menu breadcrumb breadcrumbs masthead footer cookie cookies consent notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget "
    "widgets toolbar pagination pager complementary contentinfo search banner".split()
)
# Words that may stand before a mark in a class or id (site-footer), and behind it (comment-list-2).
BEFORE = frozenset("site page main post article blog global top bottom left right primary secondary mobile user reader".split())
BEHIND = frozenset(
    "area bar block body bottom box button buttons col column container entry form group holder inner item items left link links "
    "list message outer panel placeholder posts right row section slot thread top unit wrap wrapper".split()
)

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S,
)
OPENS_MAIN = re.compile(r"<(?:article|main)\b", re.I)
ATTRIBUTE = re.compile(r"(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORD = re.compile(r"[a-z0-9]+")
# Elements around or of the main part, whose classes, ids and roles mark nothing.
NEVER_MARKED = frozenset("html body article main".split())


def _is_mark(token: str, marks: frozenset[str] = MARKS) -> bool:
    """Whether a whole class, id or role names what isn't main text: nothing in it means anything else."""
    words = [w for w in WORD.findall(token) if not w.isdigit()]
    while words and words[0] in BEFORE and words[0] not in marks:
        words.pop(0)
    while words and words[-1] in BEHIND and words[-1] not in marks:
        words.pop()
    return bool(words) and all(w in marks for w in words)


def _values(attributes: str):
    for m in ATTRIBUTE.finditer(attributes):
        yield m[1].lower(), (m[2] or m[3] or m[4] or "").lower()


def _is_main(name: str, attributes: str) -> bool:
    return name in MAIN or "role" in attributes and bool(re.search(r"role\s*=\s*[\"']?main\b", attributes, re.I))


def _is_outside(name: str, attributes: str, in_main: bool) -> bool:
    if name in OUTSIDE or name == "header" and not in_main:
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for key, value in _values(attributes):
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return True
        if key not in ("class", "id", "role") or name in NEVER_MARKED:
            continue
        if name in CONTAINERS:
            # a section of an article may have its id from its heading
            marks = COMMENTS if key == "id" and name == "section" and in_main else MARKS
            if any(_is_mark(t, marks) or t == "header" and not in_main for t in value.split()):
                return True
        elif key == "class" and name not in CLOSED_BY_BLOCK - {"p"} and any(t in ADVERTS for t in value.split()):
            return True
    return False


def _is_marked(attributes: str) -> bool:
    """Whether the class, id or role of an article is one of the marks."""
    return any(key in ("class", "id", "role") and any(map(_is_mark, value.split())) for key, value in _values(attributes))


def lines(page: str, opened: bool = False, marked: bool = False) -> list[tuple[str, int, bool, int]]:
    """Of each block: text, characters outside of links, whether it is inside an article or main element,
    and a number that the cells of a row and the items of a list share.

    ``opened``: an article or main element that isn't marked itself counts also inside of marked ones, and
    a form is nothing special. ``marked``: marked articles count, too; else they are left out.
    """
    out: list[tuple[str, int, bool, int]] = []
    parts: list[str] = []
    linked = main = skipped = 0  # characters in links; open main elements; depth inside what is left out
    skipping, link, at, raw, by_mark = "", False, 0, "", False
    lists = number = 0  # open lists; number of the row, list or line
    joint = False  # inside of a row or list that has held no other block so far

    def close() -> None:
        nonlocal linked, number
        text = " ".join("".join(parts).split())
        if text:
            number += not joint
            out.append((text, max(len(text) - linked, 0), main > 0, number))
        parts.clear()
        linked = 0

    def skip_line() -> None:
        nonlocal number
        close()
        for _ in range(1 if main else WINDOW):
            number += not joint
            out.append(("", 0, main > 0, number))

    for tag in TAG.finditer(page):
        if tag.start() > at and not skipped and not raw:
            text = references.unescape(page[at : tag.start()])
            parts.append(text)
            if link:
                linked += len(text.strip())
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        closing, attributes = bool(tag[1]), tag[3] or ""
        if raw:
            if closing and name == raw:
                raw = ""
            continue
        if not closing and name in RAW and not attributes.endswith("/"):
            raw = name
            continue
        if skipped and not closing and name in MAIN and skipping in NEVER_AROUND_MAIN:
            skipped = 0  # it was never closed
        if opened and skipped and by_mark and not closing and name in MAIN and not _is_marked(attributes):
            skipped = 0  # it stands around the main part
        if skipped:
            if skipping in CLOSED_BY_BLOCK and name in BLOCKS:
                skipped = 0  # a paragraph ends where another block begins or ends
                if closing and name == skipping:
                    continue
            else:
                if name == skipping:
                    skipped += -1 if closing else 1
                elif closing and name in ("body", "html") or closing and name in MAIN and main:
                    skipped = 0  # it was never closed
                if skipped or closing and name == skipping:
                    continue
        if name in VOID:
            if name == "br":
                parts.append(" ")
            elif name == "hr":
                close()
            continue
        if closing:
            if name == "a":
                link = False
            elif name in BLOCKS:
                close()
                if name in LISTS:
                    lists = max(lists - 1, 0)
                if name in ROWS or name in LISTS and not lists:
                    joint = False
                if name in MAIN and main:
                    main -= 1
            continue
        outside = _is_outside(name, attributes, main > 0) and not (opened and name == "form")
        if outside or name == "article" and not marked and attributes and _is_marked(attributes):
            skip_line()
            skipped, skipping, by_mark = 1, name, name not in OUTSIDE and name != "header"
            continue
        if name == "a":
            link = True
        elif name in BLOCKS:
            close()
            if name == "tr" or name in LISTS and not joint:
                joint, number = True, number + 1
            elif name not in CELLS:
                joint = False
            lists += name in LISTS
            if _is_main(name, attributes) and name in MAIN:
                main += 1
            link = False
    if not skipped and not raw and at < len(page):
        parts.append(references.unescape(page[at:]))
    close()
    return out


def between(lengths: np.ndarray, surge: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Parts (first line, line behind the last): runs of windows with anything in them, one of which at
    least reaches the threshold; a part begins and ends with a line that isn't empty."""
    if not len(lengths):
        return []
    total = np.concatenate([[0], np.cumsum(lengths)])
    n = len(lengths)
    starts = np.arange(-(window - 1), n)
    sums = total[np.minimum(starts + window, n)] - total[np.maximum(starts, 0)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (sums > 0).astype(np.int8), [0]])))
    parts = []
    for first, last in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # windows first to last - 1
        if sums[first:last].max() >= surge:
            parts.append((first, last - window + 1))  # the first one ends with a line of the part, the last begins with one
    return parts


def _measured(found: list[tuple[str, int, bool, int]], marked: bool) -> tuple[np.ndarray, np.ndarray]:
    """The measured line of each block, and the lengths of the measured lines."""
    given = np.array([i for *_, i in found])
    each = np.array([n if m or not marked else 0 for _, n, m, _ in found], np.int64)
    # a row or list of links alone stays as many lines as it has
    apart = (np.bincount(given, each)[given] == 0) | (np.diff(given, prepend=-1) != 0)
    numbers = np.cumsum(apart) - 1
    return numbers, np.bincount(numbers, each).astype(np.int64)


def main_text(page: str | None) -> str:
    """Blocks of the main part, one per line."""
    found = lines(page or "")
    inside, nothing = sum(len(t) for t, _, m, _ in found if m), not any(t for t, *_ in found)
    if not inside and page and (nothing or OPENS_MAIN.search(page)):
        for marked in (False, True):
            inner = lines(page, opened=True, marked=marked)
            inside = sum(len(t) for t, _, m, _ in inner if m)
            if inside > sum(n for _, n, *_ in found) or nothing and any(t for t, *_ in inner):
                found = inner
                break
            inside = 0
    if not found:
        return ""
    numbers, lengths = _measured(found, inside > 0)
    if inside and not lengths.any():  # an article of links alone
        return "\n".join(t for t, _, m, _ in found if t and m)
    parts = between(lengths, max(1, min(SURGE, int(lengths.sum()) // 2)))
    if not parts:
        return ""
    first, last = parts[0][0], parts[-1][1]
    if inside:  # fewer lines of links than a window has end no article
        own = {i for (t, _, m, _), i in zip(found, numbers.tolist(), strict=True) if t and m}
        before, behind = [i for i in own if i < first], [i for i in own if i >= last]
        first = min([first, *before]) if len(before) < WINDOW else first
        last = max([last - 1, *behind]) + 1 if len(behind) < WINDOW else last
    return "\n".join(t for (t, _, m, _), i in zip(found, numbers, strict=True) if t and (m or not inside) and first <= i < last)


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """All columns of ``pages``, and the main text of each page; empty if there is none.

    A null or empty page has an empty text. White space inside a block (line breaks too) is one blank,
    character references are decoded, markup that never ends is dropped. Pages are handled one by one,
    whole, a very long one in a batch of its own, so repeated rows give repeated rows; a column that has
    the name of the result is replaced.
    """
    ship(pages.sparkSession)
    pages = pages.drop(text) if text != html else pages

    def run(batches):
        for whole in batches:
            for batch in small_batches([whole], html):
                done = pa.array([main_text(p) for p in batch[html].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, done], [*batch.schema.names, text])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(text, T.StringType())]))
