"""Operators whose results are exact, against brute force or the public tokenizers themselves."""

import base64
import hashlib
import io
import zlib
from array import array

import pytest

from test_operators import SCHEMA, WORD, documents
from weftline.llm import packing, suffix_arrays, suffix_trees, token_counts, warc


def rows():
    """The shared fixture and texts that overlap in shifted, nested and self-repeating passages."""
    found = documents()
    words = " ".join(found[n][1].replace("\n", " ") for n in (20, 21)).split(" ")
    join = " ".join
    texts = [
        join(words[5:40]),
        join(words[12:30] + ["between"] + words[20:45]),
        join(["ahead"] + words[0:13] + words[0:13]),
        join(["again"] * 60),
        join(["again"] * 45),
        "ab" * 120,
        "ba" * 70 + "é" * 40,
        "ü" * 90,
        "é" * 60,
        "tab\tand\x0bmarks\x1c\x85   é " * 12,
        "word " + "x" * 5000,
        "x" * 4000 + " tail",
    ]
    return found + [(len(found) + n, t, "en", "hot", len(t), "clash") for n, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def covered(items, window):
    """id -> (items, flag of each that is inside a window which also starts under a smaller id)."""
    least = {}
    for i in sorted(items):
        for at in range(len(items[i]) - window + 1):
            least.setdefault(tuple(items[i][at : at + window]), i)
    out = {}
    for i, x in items.items():
        gone = [False] * len(x)
        for at in range(len(x) - window + 1):
            if least[tuple(x[at : at + window])] < i:
                gone[at : at + window] = [True] * window
        out[i] = (x, gone)
    return out


def test_words_that_start_earlier(docs):
    want = covered({r[0]: WORD.findall(r[1] or "") for r in rows()}, 13)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in suffix_trees.dedup_words(docs).collect()}
    assert got == {i: (len(x), sum(gone), " ".join(w for w, g in zip(x, gone) if not g)) for i, (x, gone) in want.items()}
    assert sum(n for _, n, _ in got.values()) > 300


def test_bytes_that_start_earlier(docs):
    want = covered({r[0]: (r[1] or "").encode() for r in rows()}, 50)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_arrays.dedup_bytes(docs).collect()}
    spans = {i: sum(g and not b for g, b in zip(gone, [False, *gone])) for i, (_, gone) in want.items()}
    assert got == {i: (len(x), sum(gone), spans[i], bytes(b for b, g in zip(x, gone) if not g)) for i, (x, gone) in want.items()}
    assert max(spans.values()) > 1


@pytest.mark.parametrize("text", ["", "a", "aaaaaa", "banana", "mississippi", "abababab", "dcba", "aabaaabaaaab"])
def test_suffix_array(text):
    assert suffix_arrays.suffix_array([ord(c) for c in text]) == sorted(range(len(text)), key=lambda i: text[i:])


def test_subtrees_split_by_longer_prefixes():
    import numpy as np

    symbols = np.array([1, 2, 1, 2, 1, 2, 3, 1, 2, 1, 2, 1])
    for limit in (1, 3, 100):
        found = {frozenset(x.tolist()) for x in suffix_trees.nodes(np.arange(9), symbols, 4, limit)}
        want = {}
        for i in range(9):
            want.setdefault(tuple(symbols[i : i + 4]), set()).add(i)
        assert found == {frozenset(x) for x in want.values()}


def test_pieces_are_the_tokenizers(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = {}
    for i, text, *_ in rows():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 64)):
            cut = ids[start : start + 64]
            want[i, piece] = (start, len(cut), zlib.crc32(array("I", cut).tobytes()))
    got = packing.pieces(docs, packing.default_tokenizer(), 64).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)


def test_counts_are_the_unigram_models(docs):
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    pieces = token_counts.vocabulary(token_counts.default_model())
    least = min(score for _, score in pieces)
    others = [("<unk>", least), *((f"<0x{b:02X}>", least) for b in range(256))]
    model = Tokenizer(Unigram(others + pieces, 0, True))
    texts = {r[0]: r[1] or "" for r in rows()} | {900: "  two  spaces ", 901: "日本語 ☃☃ \U0001f600x", 902: " "}
    more = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame([(i, texts[i]) for i in (900, 901, 902)], "doc_id bigint, text string"))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(more, token_counts.default_model()).collect()}
    assert got == {i: len(model.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0 for i, t in texts.items()}


def test_archives_round_trip(spark, tmp_path):
    pages = [(1, "http://a/ b", "same"), (2, None, "same"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "é\r\n\r\n" * 400_000), (6, "http://f", "same"), (7, "", "x")]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    payload = {i: (h or "").encode() for i, _, h in pages}
    last = {p: max(i for i, q in payload.items() if q == p) for p in payload.values()}
    for least in (0, 2):
        got = warc.round_trip(frame, f"{tmp_path}/{least}", least).collect()
        want = {i: (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), *(("response", None) if last[p] == i or len(p) < least else ("revisit", last[p]))) for i, p in payload.items()}
        assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == want
    assert warc.round_trip(frame.limit(0), f"{tmp_path}/none").count() == 0


def test_reader_finds_damage():
    one, two = warc.member(1, "http://a", b"first payload", None), warc.member(2, "http://b", b"second", 1)
    assert [r["payload"] for r in warc.records(io.BytesIO(one + two), payloads=True)] == [b"first payload", None]
    raw = zlib.decompress(one, 31).replace(b"first", b"FIRST")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(pack.compress(raw) + pack.flush())))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(two + one[:-12])))
