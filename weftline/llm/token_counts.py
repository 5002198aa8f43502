"""Token counts: pieces of the best segmentation under a unigram vocabulary, without the pieces.

An Aho-Corasick automaton over the vocabulary lists every piece that ends at a character; the
dynamic programme keeps, for each position, the best score and the number of pieces on the way.
Ties follow the exact unigram tokenizer: of equally good ways to a position the first found wins,
that is the one whose last piece starts earliest. A character that no single-character piece
covers may also be an unknown of the lowest score less ten; a run of unknowns counts as the
bytes it has (byte fallback).
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.llm import utf8
from weftline.session import table

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 500_000
CACHED_LENGTH = 64


def vocabulary(model_path: str) -> list[tuple[str, float]]:
    """(piece, score) of a public model's ordinary pieces, used as a unigram vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]


class Counter:
    """Counts pieces of texts. Texts are cut where no piece can cross: before a space mark that follows another character."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        # Cutting is exact if no piece has a space mark after another character and the mark itself is a piece.
        self.cuts = SPACE in self.single and not any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece, _ in pieces)
        self.known: dict[str, tuple[float, int]] = {}

    def best(self, text: str) -> tuple[float, int]:
        """(score, pieces) of the best segmentation of a marked text."""
        n = len(text)
        score: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        at = 0
        ends: list = []
        found = self.automaton.iter(text)
        nxt = next(found, None)
        single = self.single
        for end in range(1, n + 1):
            ends.clear()
            while nxt is not None and nxt[0] == end - 1:
                ends.append(nxt[1])
                nxt = next(found, None)
            top, number = None, 0
            ends.sort(reverse=True)  # longest first: earliest start
            for length, value in ends:
                before = score[end - length]
                if before is not None and (top is None or before + value > top):
                    top, number = before + value, count[end - length] + 1
            if text[end - 1] not in single:
                before = score[end - 1]
                if before is not None and (top is None or before + self.unknown > top):
                    top, number = before + self.unknown, count[end - 1] + len(text[end - 1].encode())
            score[end], count[end] = top, number
        return score[n], count[n]

    def count(self, text: str) -> tuple[float, int]:
        """(score, pieces) of a text; the empty text has none."""
        if not text:
            return 0.0, 0
        marked = SPACE + text.replace(" ", SPACE)
        if not self.cuts:
            return self.best(marked)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        total, pieces, known = 0.0, 0, self.known
        words = marked[1:].split(SPACE) if SPACE * 2 not in marked and not marked.endswith(SPACE) else None
        for word in [SPACE + w for w in words] if words else re.findall(f"{SPACE}+[^{SPACE}]*", marked):
            found = known.get(word)
            if found is None:
                found = self.best(word)
                if len(word) <= CACHED_LENGTH:
                    known[word] = found
            total += found[0]
            pieces += found[1]
        return total, pieces


@lru_cache(1)
def _counter(model_path: str) -> Counter:
    return Counter(vocabulary(model_path))


def token_counts(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, score for every row. A null or empty text has no tokens and score 0.

    Each row is counted by its own text, whole, however long: repeated rows and ids alike, null ids
    too. Of equally good segmentations the tokenizer's rule decides (see Counter). Other columns are
    not used; an empty table gives an empty table.
    """

    def run(batches):
        counter = _counter(model_path)
        for batch in batches:
            for part in utf8.slices(batch.column("text")):
                found = [counter.count(part.raw(i).decode()) for i in range(len(part))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(part.first, len(part)), pa.array([n for _, n in found], pa.int64()), pa.array([s for s, _ in found], pa.float64())],
                    names=[id_column, "n_tokens", "score"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"`{id_column}` {kind}, n_tokens bigint, score double")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), default_model())


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLES: dict[str, str] = {}
