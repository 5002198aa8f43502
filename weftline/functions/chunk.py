"""Text chunks for embedding: paragraphs packed up to a size, long ones cut at sentences, then at words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F

from weftline.functions import text as T

SIZE = 3000
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _packed(parts: list[str], between: str, size: int, split=None) -> list[str]:
    """Parts joined while they fit; one that is too long is split, and its last piece stays open for the next."""
    out: list[str] = []
    for part in parts:
        if out and len(out[-1]) + len(between) + len(part) <= size:
            out[-1] += between + part
        elif split and len(part) > size:
            out += split(part)
        else:
            out.append(part)
    return out


def _pieces(text: str, size: int) -> list[str]:
    if len(text) <= size:
        return [text]
    sentences = [s for s in map(str.strip, _SENTENCE.split(text)) if s]
    return _packed(sentences, " ", size, lambda s: _packed(s.split(), " ", size))


def pieces(text: str, size: int) -> list[str]:
    """The chunks of one cleaned text, equal ones (in any case and spacing) once."""
    first: dict[str, str] = {}
    for piece in _pieces(text, size) if text else []:
        first.setdefault(" ".join(piece.lower().split()), piece)
    return list(first.values())


def chunked(text: Column, size: int = SIZE) -> Column:
    """Chunks of at most `size` characters (200 at least) of the cleaned lines of a text.

    Cleaning drops blank lines, so a text is one paragraph. A single word that is longer stays whole.
    Null and blank texts have no chunk.
    """
    limit = max(200, size)

    def run(column: pd.Series) -> pd.Series:
        return pd.Series([pieces(x or "", limit) for x in column], dtype=object)

    return F.pandas_udf(run, "array<string>")(T.clean_lines(F.coalesce(text, F.lit(""))))
