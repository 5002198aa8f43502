"""Substring dedup by words: prefix-partitioned suffix trees.

The suffixes to compare (see `repeats` for which these are) are split by their first words, and a
group that is too large by one word more, until each fits the limit. A group's subtree follows from
sorting its suffixes: neighbours' common prefixes give the internal nodes, and a node `window`
words deep or more is a repeat, with all suffixes below it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.llm import repeats
from weftline.session import table

WINDOW = 13
GRAM = 6
GROUP_LIMIT = 50_000


def subtree(suffixes: np.ndarray, symbols: np.ndarray, depth: int, window: int) -> list[np.ndarray]:
    """The deep internal nodes and leaves of one subtree: sets of suffixes with `window` equal symbols."""
    keys = symbols[suffixes[:, None] + np.arange(depth, window)]
    order = np.lexsort(keys.T[::-1]) if keys.shape[1] else np.arange(len(suffixes))
    keys = keys[order]
    differs = keys[1:] != keys[:-1]
    common = depth + np.where(differs.any(1), differs.argmax(1), window - depth) if keys.shape[1] else np.full(len(order) - 1, window)
    return np.split(suffixes[order], np.flatnonzero(common < window) + 1)


def nodes(suffixes: np.ndarray, symbols: np.ndarray, window: int, limit: int = GROUP_LIMIT):
    """Suffixes split by prefixes of varying length into groups under `limit`, and each group's subtree."""
    stack = [(suffixes, 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) <= limit or depth == window:
            yield from subtree(group, symbols, depth, window)
            continue
        word = symbols[group + depth]
        order = np.argsort(word, kind="stable")
        stack += [(x, depth + 1) for x in np.split(group[order], np.flatnonzero(np.diff(word[order])) + 1)]


def window_classes(strings: list[np.ndarray], window: int) -> list[np.ndarray]:
    """For each string the class of every window, by the node it lies under."""
    _, symbols = np.unique(np.concatenate(strings), return_inverse=True)
    lengths = np.array([len(s) for s in strings])
    n_windows = lengths - window + 1
    base = np.cumsum(lengths) - lengths
    first = np.cumsum(n_windows) - n_windows
    suffixes = np.repeat(base - first, n_windows) + np.arange(int(n_windows.sum()))
    of = np.empty(int(lengths.sum()), np.int64)
    for number, node in enumerate(nodes(suffixes, symbols, window)):
        of[node] = number
    return [of[b : b + n] for b, n in zip(base, n_windows)]


def dedup_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text for every row of docs(doc_id, text, ...).

    Words are runs of bytes other than space and 0x09-0x0D. A word goes if a window of `window`
    words over it also starts in a document with a smaller id; kept words are joined by one space.
    A null text has no words; a text shorter than the window keeps all. Rows with null doc_id stay
    whole and take nothing from others. Rows that repeat a doc_id and text are one document; other
    texts under a doc_id are documents of their own, in the order of their md5. Texts count whole,
    however long; other columns are not used. An empty table gives an empty table.
    """

    def run(batches):
        for batch in batches:
            out: list[tuple[int, int, bytes]] = []
            for text, ranges in zip(batch.column("text"), batch.column("ranges")):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                n, removed = len(words), 0
                if ranges.is_valid:
                    found = ranges.values
                    first, stop = repeats.covered(found.field("start").to_numpy(), found.field("size").to_numpy())
                    removed = int((stop - first).sum())
                    words = [w for a, b in zip([0, *stop.tolist()], [*first.tolist(), n]) for w in words[a:b]]
                out.append((n, removed, b" ".join(words)))
            n, removed, kept = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return repeats.with_ranges(docs, "words", window, gram, window_classes).mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_text string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_words(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


# For each word position: is it inside a window that also starts in a smaller document?
ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS p FROM d WHERE len(w) >= {WINDOW}),
k AS (SELECT doc_id, p, array_to_string(w[p:p + {WINDOW} - 1], ' ') AS k FROM s),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS least FROM k) WHERE doc_id > least),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + {WINDOW})) AS q FROM r),
l AS (SELECT doc_id, list(q) AS gone FROM c GROUP BY doc_id),
e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
t AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.q) AS kept FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.q = c.q WHERE c.q IS NULL GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLES = {"op5_substring_dedup": ORACLE}
