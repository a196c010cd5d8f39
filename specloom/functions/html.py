"""One pass over the markup of a page.

This is the one place where page content is read in Python: tag soup has no column expression.
The helper only separates markup from text; cleaning, titles, links and filters are columns.
"""

from __future__ import annotations

import html
import re
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specloom import patterns as p

PARSED = (
    "STRUCT<title: STRING, heading: STRING, body: STRING, samples: ARRAY<STRING>, "
    "links: ARRAY<STRING>>"
)
_CONTENT_CLASS = re.compile(p.CONTENT_CLASS)
# Pages whose texts are Python objects at one time.
AT_ONCE = 32
_BLANK = re.compile(r"[ \t\n\f\r]+\Z")
# Text inside these is no text of the elements around them.
_ASIDE_TAGS = ("script", "style", "template", "rt", "rp")


class PageParser(HTMLParser):
    """Collects text nodes, and for the elements of interest which nodes they span."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.open = []  # (tag, removed, aside, spans) of every open element
        self.data = []  # pieces of the text node being read
        self.texts = []  # all text nodes
        self.kept = []  # text nodes outside of removed elements
        self.codes = {"code": [], "pre": []}
        self.links = []
        self.heading = None
        self.content = {}  # first main, article, content div and body: span in `kept`
        self.title = None
        self.title_chain = None  # depth of the only child expected next inside <title>
        self.closed_voids = []

    # -- text ---------------------------------------------------------------------------------

    def end_text(self, markup=False):
        """Close the current text node; ``markup`` for nodes that are not text (comments)."""
        if not self.data:
            return
        text = "".join(self.data)
        self.data = []
        if not any(tag in ("pre", "textarea") for tag, *_ in self.open) and _BLANK.match(text):
            text = "\n" if "\n" in text else " "
        if self.title_chain is not None:
            # Only a title made of one text node (however deep) counts.
            self.title = text if len(self.open) == self.title_chain else None
            self.title_chain = -1
        removed, aside = self.open[-1][1:3] if self.open else (False, False)
        if markup or aside:
            return
        self.texts.append(text)
        if not removed and "<!--" not in text:
            self.kept.append(text)

    def handle_data(self, data):
        self.data.append(data)

    def handle_charref(self, name):
        self.data.append(html.unescape(f"&#{name};"))

    def handle_entityref(self, name):
        self.data.append(html5.get(f"{name};", f"&{name}"))

    def _other_node(self, data):
        self.end_text()
        self.data.append(data)
        self.end_text(markup=True)

    handle_comment = handle_decl = handle_pi = _other_node

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            self.end_text()
            self.data.append(data[len("CDATA[") :])
            self.end_text()
        else:
            self._other_node(data)

    # -- elements -----------------------------------------------------------------------------

    def handle_starttag(self, tag, attrs):
        self.start(tag, dict(attrs))
        if tag in p.VOID_TAGS:
            self.close_to(tag)
            self.closed_voids.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.start(tag, dict(attrs))
        self.end(tag)

    def handle_endtag(self, tag):
        self.end(tag)

    def start(self, tag, attrs):
        self.end_text()
        if self.title_chain is not None:
            inside = len(self.open) == self.title_chain
            self.title_chain = self.title_chain + 1 if inside else -1
            self.title = None
        elif tag == "title" and not hasattr(self, "title_seen"):
            self.title_seen = True
            self.title_chain = len(self.open) + 1
        removed, aside = self.open[-1][1:3] if self.open else (False, False)
        removed = removed or tag in p.REMOVED_TAGS
        spans = []
        if tag == "a" and "href" in attrs:
            self.links.append(attrs["href"] or "")
        if tag in self.codes:
            span = [len(self.texts), None]
            self.codes[tag].append(span)
            spans.append((span, self.texts))
        if tag == "h1" and self.heading is None:
            self.heading = [len(self.texts), None]
            spans.append((self.heading, self.texts))
        kind = tag if tag in ("main", "article", "body") else None
        if tag == "div" and _CONTENT_CLASS.search(attrs.get("class") or ""):
            kind = "div"
        if kind and not removed and kind not in self.content:
            self.content[kind] = [len(self.kept), None]
            spans.append((self.content[kind], self.kept))
        self.open.append((tag, removed, aside or tag in _ASIDE_TAGS, spans))

    def end(self, tag):
        if tag in self.closed_voids:
            self.closed_voids.remove(tag)
        else:
            self.close_to(tag)

    def close_to(self, tag):
        self.end_text()
        if any(name == tag for name, *_ in self.open):
            while self.pop() != tag:
                pass

    def pop(self):
        tag, _, _, spans = self.open.pop()
        for span, nodes in spans:
            span[1] = len(nodes)
        if tag == "title" and not any(name == "title" for name, *_ in self.open):
            self.title_chain = None
        return tag

    # -- results ------------------------------------------------------------------------------

    def read(self, markup):
        self.feed(markup)
        self.close()
        self.end_text()
        while self.open:
            self.pop()
        return self

    def result(self):
        found = [self.content[k] for k in ("main", "article", "div", "body") if k in self.content]
        first, last = found[0] if found else (0, len(self.kept))
        nodes = (text.strip() for text in self.kept[first:last])
        spans = self.codes["code"] + self.codes["pre"]
        return {
            "title": self.title,
            "heading": "".join(self.texts[slice(*self.heading)]) if self.heading else None,
            "body": "\n".join(text for text in nodes if text),
            "samples": ["".join(self.texts[slice(*span)]) for span in spans],
            "links": self.links,
        }


def slices(batches, rows: int = AT_ONCE):
    """Batches cut into small ones: what Python holds at one time follows the slice, not the batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _parse(markup):
    try:
        return PageParser().read(markup).result()
    except AssertionError:  # markup the tokenizer gives up on
        return None


def with_parsed_html(pages: DataFrame, html_column: str = "html", out: str = "parsed") -> DataFrame:
    """Replace the html column by the struct ``PARSED`` (null for unreadable markup).

    A narrow map over Arrow batches: no shuffle, and the markup itself leaves the plan here. Select
    the columns needed before calling.
    """
    kept = [c for c in pages.columns if c != html_column]
    schema = pages.select(*kept, F.lit(None).cast(PARSED).alias(out)).schema
    parsed_type = pa.struct(
        [
            ("title", pa.string()),
            ("heading", pa.string()),
            ("body", pa.string()),
            ("samples", pa.list_(pa.string())),
            ("links", pa.list_(pa.string())),
        ]
    )

    def convert(batches):
        for batch in slices(batches):
            column = batch.column(batch.schema.get_field_index(html_column))
            values = [_parse(v.as_py()) if v.is_valid else None for v in column]
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            arrays.append(pa.array(values, parsed_type))
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, out])

    return pages.select(*kept, html_column).mapInArrow(convert, schema)


@F.pandas_udf(T.IntegerType())
def visible_length(markup: pd.Series) -> pd.Series:
    """Length of the stripped text of a page, scripts and styles left out; null stays null."""

    def one(text):
        if text is None:
            return None
        try:
            return len("".join(PageParser().read(text).texts).strip())
        except AssertionError:
            return None

    return pd.Series([one(text) for text in markup], dtype="Int32")
