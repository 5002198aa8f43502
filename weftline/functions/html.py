"""Text, links and rows from HTML. Parsing runs in small Python helpers over Arrow batches."""

from __future__ import annotations

import html as entities
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F

# Tags that end a line, those that also begin one, and those whose content is dropped.
ENDS = frozenset("p div section article header footer main aside ul ol li table thead tbody tfoot tr td th h1 h2 h3 h4 h5 h6 pre blockquote hr br dl dt dd".split())
BEGINS = frozenset("br tr li dt p div section article header footer main aside h1 h2 h3 h4 h5 h6 pre blockquote ul ol dl".split())
SKIPPED = frozenset(("script", "style"))


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        self.hidden += tag in SKIPPED
        if tag in BEGINS:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.hidden = max(0, self.hidden - 1)
        if tag in ENDS:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(data)


def block_text(source: str) -> str:
    parser = _Blocks()
    parser.feed(source)
    parser.close()
    return "\n".join(x for line in "".join(parser.out).splitlines() if (x := line.strip()))


def _each(f):
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(x) for x in column], dtype=object)

    return run


def to_text(source: Column) -> Column:
    """Text with a line for each block; scripts and styles are left out; null stays null."""
    return F.pandas_udf(_each(block_text), "string")(source)


def stripped(source: Column) -> Column:
    """Text without tags, entities resolved, single-spaced; null if nothing is left."""
    bare = F.pandas_udf(_each(entities.unescape), "string")(F.regexp_replace(source, "<[^>]+>", ""))
    return F.nullif(F.trim(F.regexp_replace(bare, r"[\s\x{a0}]+", " ")), F.lit(""))


def links(source: Column) -> Column:
    """Targets of links in order, each once."""
    return F.array_distinct(F.regexp_extract_all(source, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1)))


def labelled(source: Column, label: str) -> Column:
    """The text of the element that follows a heading, term or cell with this label; null where there is none."""
    found = F.regexp_extract(source, rf"(?is)<(h[1-6]|dt|th|strong|b|label)\b[^>]*>\s*{label}\s*:?\s*</\1>\s*(?:<[^>]+>\s*)*([^<]+)", 2)
    return F.nullif(F.trim(F.regexp_replace(found, r"\s+", " ")), F.lit(""))


def table_rows(source: Column) -> Column:
    """Cells of each table row, in order: array of arrays of text."""
    rows = F.regexp_extract_all(source, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda row: F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"\s+", " ")))
    return F.filter(F.transform(rows, cells), lambda x: F.size(x) > 0)
