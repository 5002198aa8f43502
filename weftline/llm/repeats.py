"""Windows of a corpus that also start in a document with a smaller id: the shared plan of the two
exact substring operators, which differ in their unit (words or bytes) and in how they order suffixes.

1. In each document, runs of consecutive windows that have the same minimizer (the least hashed
   gram inside the window) form a segment. Equal windows have equal minimizers at equal places, so
   they lie in segments with the same gram.
2. Segments are dealt by gram. Grams of a single document go. Where all segments of a gram are
   equal, all but those of the smallest document are repeats. Copies inside one unit of input
   are settled before the shuffle, so a hot passage reaches a bucket once per unit.
3. For grams with several different segments the bytes of one of each are fetched, and the
   operator's suffix structure sorts their windows; each window's smallest document follows.
4. Ranges found go back to their documents.

So hashes do most of the work: equal segments are recognised by hash (48 bits of the gram and 48 of
the content, in one unit of input 64 bits of both together), and only windows whose 64-bit hash
stands in two different segments reach the suffix structures. These compare bytes, and for words
64-bit hashes of the words. See the README for what this departs from and why.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from weftline.llm import utf8
from weftline.session import forget, written

#: Bytes of text whose segments are combined and sent together.
UNIT_BYTES = 8 << 20
LOW = np.uint64((1 << 48) - 1)

#: Windows of several strings -> class of each: equal exactly where the windows are equal.
Order = Callable[[list[np.ndarray], int], list[np.ndarray]]


def segments(values: np.ndarray, text: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer hash, first and end element of each run of windows with one minimizer."""
    n = len(values)
    if n < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = utf8.grams(values, gram)
    mask = np.uint64((1 << int(n).bit_length()) - 1)
    placed = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)  # least hash, leftmost of equal ones
    least = utf8.window_min(placed, window - gram + 1)
    at = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
    where = (least[at] & mask).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = where[1:] != where[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    return hashes[where[first]], at[first], at[last] + window


def _elements(part: utf8.Texts, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text of each element, elements before each text, and each element's byte range."""
    if unit == "bytes":
        n = len(part.data)
        text = np.repeat(np.arange(len(part)), np.diff(part.starts))
        place = np.arange(n)
        return part.data.astype(np.uint64) + np.uint64(1), text, part.starts, place, place + 1
    words = utf8.words(part)
    return utf8.range_hashes(utf8.byte_sums(part.data), words.start, words.end), words.text, words.first, words.start, words.end


FIELDS = ("doc", "start", "size", "byte", "bytes")


def _pack(columns: dict[str, np.ndarray]) -> bytes:
    """Six bytes of both hashes as they are, the other columns as compressed differences."""
    head = b"".join(np.ascontiguousarray(columns[k].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes() for k in ("gram", "content"))
    rest = np.stack([columns[k] for k in FIELDS])
    packed = zstandard.ZstdCompressor(level=1).compress(np.diff(rest, axis=1, prepend=0).astype(np.int64).tobytes())
    return len(columns["gram"]).to_bytes(8, "little") + head + packed


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    out = {}
    for i, k in enumerate(("gram", "content")):
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :6] = np.frombuffer(blob, np.uint8, 6 * n, 8 + 6 * n * i).reshape(n, 6)
        out[k] = wide.view(np.uint64).ravel()
    rest = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8 + 12 * n :]), np.int64).reshape(len(FIELDS), n)
    return out | dict(zip(FIELDS, np.cumsum(rest, axis=1)))


def _scan(docs: DataFrame, unit: str, window: int, gram: int, buckets: int) -> DataFrame:
    """(bucket, blob) rows; `kind` 0 holds segments, 1 holds ranges settled within the unit of input."""

    def flush(held: list[dict[str, np.ndarray]], salt: int) -> pa.RecordBatch:
        c = {k: np.concatenate([x.pop(k) for x in held]) for k in [*held[0]]}
        # Of equal segments only those of the smallest document go on; the others are repeats.
        key = utf8.mix(c["gram"]) ^ c["content"]
        order = np.lexsort((c["doc"], key))
        key, doc = key[order], c["doc"][order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        repeat = np.zeros(len(key), bool)
        repeat[order] = doc > least
        out: list[tuple[int, int, bytes]] = []
        if repeat.any():
            doc, first, end = _merged(c["doc"][repeat], c["start"][repeat], c["start"][repeat] + c["size"][repeat])
            zero = np.zeros(len(doc), np.int64)
            out.append((salt % buckets, 1, _pack({"gram": zero.view(np.uint64), "content": zero.view(np.uint64), "doc": doc, "start": first, "size": end - first, "byte": zero, "bytes": zero})))
        c = {k: v[~repeat] for k, v in c.items()}
        # Least hashes are small numbers: they are mixed again, so that buckets are even.
        bucket = ((utf8.mix(c["gram"]) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            if len(rows):
                out.append((int(bucket[rows[0]]), 0, _pack({k: v[rows] for k, v in c.items()})))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.binary())], names=["bucket", "kind", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, salt = [], 0, 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for part in utf8.slices(batch.column("text")):
                values, text, before, byte, byte_end = _elements(part, unit)
                if len(values) >= window:
                    hashes, first, end = segments(values, text, window, gram)
                    own = text[first] if len(first) else np.zeros(0, np.int64)
                    sums = utf8.byte_sums(part.data) if unit == "bytes" else np.concatenate([np.zeros(1, np.uint64), np.cumsum(utf8.mix(values) * utf8.powers(utf8.BASE, len(values)))])
                    content = utf8.range_hashes(sums, first, end)
                    at = byte[first]
                    held.append({"gram": hashes, "content": content & LOW, "doc": ids[part.first + own].astype(np.int64), "start": first - before[own], "size": end - first, "byte": at - part.starts[own], "bytes": byte_end[end - 1] - at})
                    salt += int(hashes[0] & LOW) if len(hashes) else 0
                size += len(part.data)
                if held and size >= UNIT_BYTES:
                    yield flush(held, salt)
                    held, size = [], 0
        if held:
            yield flush(held, salt)

    return docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(run, "bucket bigint, kind bigint, blob binary")


def _merged(doc: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each document joined where they touch or overlap."""
    order = np.lexsort((first, doc))
    doc, first, end = doc[order], first[order], end[order]
    _, group = np.unique(doc, return_inverse=True)
    far = (end.max() + 2) if len(end) else 1
    start, stop = utf8.runs(first + group * far, end + group * far)
    names = np.unique(doc)
    return names[start // far], start % far, stop - start // far * far


SETTLED = "doc bigint, start bigint, stop bigint, gram bigint, byte bigint, bytes bigint, docs array<bigint>, starts array<bigint>"


def _settle(table: pa.Table) -> pa.Table:
    """A bucket's segments -> ranges of repeats, and one row per different segment of a mixed gram."""
    kinds = table.column("kind").to_numpy()
    blobs = table.column("blob").to_pylist()
    done = [_unpack(b) for b, k in zip(blobs, kinds) if k == 1]
    ranges = [(d["doc"], d["start"], d["start"] + d["size"]) for d in done]
    mixed: list[pa.Table] = []
    parts = [_unpack(b) for b, k in zip(blobs, kinds) if k == 0]
    if parts:
        c = {k: np.concatenate([x[k] for x in parts]) for k in parts[0]}
        order = np.lexsort((c["doc"], c["content"], c["gram"]))
        c = {k: v[order] for k, v in c.items()}
        gram = np.ones(len(order), bool)
        gram[1:] = c["gram"][1:] != c["gram"][:-1]
        content = gram.copy()
        content[1:] |= c["content"][1:] != c["content"][:-1]
        at = np.flatnonzero(gram)
        low, high = np.minimum.reduceat(c["doc"], at), np.maximum.reduceat(c["doc"], at)
        number = np.cumsum(gram) - 1
        shared = (low < high)[number]
        n_contents = np.add.reduceat(content.astype(np.int64), at)[number]
        single = shared & (n_contents == 1) & (c["doc"] > low[number])
        ranges.append((c["doc"][single], c["start"][single], c["start"][single] + c["size"][single]))
        rows = np.flatnonzero(shared & (n_contents > 1))
        if len(rows):
            first = np.flatnonzero(content[rows])
            offsets = pa.array(np.append(first, len(rows)), pa.int32())
            lead = rows[first]  # ordered by document: the smallest
            mixed.append(
                pa.table(
                    [
                        pa.array(c["doc"][lead]),
                        pa.array(c["start"][lead]),
                        pa.array(c["start"][lead] + c["size"][lead]),
                        pa.array(c["gram"][lead].view(np.int64)),
                        pa.array(c["byte"][lead]),
                        pa.array(c["bytes"][lead]),
                        pa.ListArray.from_arrays(offsets, pa.array(c["doc"][rows])),
                        pa.ListArray.from_arrays(offsets, pa.array(c["start"][rows])),
                    ],
                    names=_NAMES,
                )
            )
    return pa.concat_tables([_range_rows(ranges), *mixed])


_NAMES = [x.split()[0] for x in SETTLED.split(", ")]
_SCHEMA = pa.schema([(n, pa.list_(pa.int64()) if n in ("docs", "starts") else pa.int64()) for n in _NAMES])


def _range_rows(ranges: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    if not ranges or not sum(len(x[0]) for x in ranges):
        return _SCHEMA.empty_table()
    doc, first, end = (np.concatenate(x) for x in zip(*ranges))
    doc, first, end = _merged(doc, first, end)
    return pa.table([pa.array(doc), pa.array(first), pa.array(end), *(pa.nulls(len(doc), _SCHEMA.field(n).type) for n in _NAMES[3:])], names=_NAMES)


def _sort_mixed(table: pa.Table, unit: str, window: int, order: Order) -> pa.Table:
    """Mixed grams of a bucket, with bytes -> ranges of repeats."""
    table = table.sort_by("gram").combine_chunks()
    grams, least = table.column("gram").to_numpy(), table.column("doc").to_numpy()
    sizes = table.column("stop").to_numpy() - table.column("start").to_numpy()
    docs, starts = table.column("docs").combine_chunks(), table.column("starts").combine_chunks()
    offsets = docs.offsets.to_numpy()
    owner = np.repeat(np.arange(len(grams)), np.diff(offsets))
    flat_doc, flat_start = docs.values.to_numpy()[offsets[0] : offsets[-1]], starts.values.to_numpy()[starts.offsets[0].as_py() :][: len(owner)]
    # A segment that equals one of a smaller document is a repeat as a whole.
    whole = flat_doc > least[owner]
    ranges = [(flat_doc[whole], flat_start[whole], flat_start[whole] + sizes[owner[whole]])]
    strings = [_symbols(x.as_py(), unit) for x in table.column("text")]
    lengths = np.array([len(s) for s in strings], np.int64)
    base = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
    joined = np.concatenate(strings) if strings else np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(utf8.mix(joined.astype(np.uint64)) * utf8.powers(utf8.BASE, len(joined)))])
    n_windows = np.maximum(lengths - window + 1, 0)
    string = np.repeat(np.arange(len(strings)), n_windows)
    place = np.arange(len(string)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    # Only windows whose hash stands in two strings of the gram can be shared: strings are trimmed to these.
    at = base[string] + place
    key = utf8.range_hashes(sums, at, at + window) ^ utf8.mix(grams[string].view(np.uint64))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[inverse] > 1)
    if len(twice):
        who, first = np.unique(string[twice], return_index=True)
        last = np.append(first[1:], len(twice)) - 1
        begin, end = place[twice[first]], place[twice[last]] + window
        for low, high in _blocks(grams[who], end - begin):
            ranges += _ordered(who[low:high], begin[low:high], end[low:high], strings, grams, least, owner, flat_doc, flat_start, offsets, window, order)
    return _range_rows(ranges).select(["doc", "start", "stop"])


def _blocks(grams: np.ndarray, sizes: np.ndarray, limit: int = 200_000) -> Iterator[tuple[int, int]]:
    """Consecutive rows of whole grams, of about `limit` symbols each."""
    edges = np.append(np.flatnonzero(np.diff(grams, prepend=grams[0] ^ 1)), len(grams))
    total = np.append(0, np.cumsum(sizes))
    low = 0
    while low < len(grams):
        high = edges[max(np.searchsorted(edges, low, side="right"), np.searchsorted(total[edges], total[low] + limit, side="right") - 1)]
        yield low, int(high)
        low = int(high)


def _ordered(who, begin, end, strings, grams, least, owner, flat_doc, flat_start, offsets, window, order):
    trimmed: dict[tuple[int, bytes], int] = {}
    number = np.empty(len(who), np.int64)
    for i, (w, b, e) in enumerate(zip(who, begin, end)):
        number[i] = trimmed.setdefault((int(grams[w]), strings[w][b:e].tobytes()), len(trimmed))
    unique = list(trimmed)
    doc = np.full(len(unique), np.iinfo(np.int64).max)
    np.minimum.at(doc, number, least[who])
    per_gram: dict[int, int] = {}
    for gram, _ in unique:
        per_gram[gram] = per_gram.get(gram, 0) + 1
    dtype = strings[who[0]].dtype
    pick = [i for i, (gram, _) in enumerate(unique) if per_gram[gram] > 1]  # one string is its own order
    classes = dict(zip(pick, order([np.frombuffer(unique[i][1], dtype) for i in pick], window))) if pick else {}
    smallest: dict[int, np.ndarray] = {}
    if classes:
        flat = np.concatenate([classes[i] for i in pick])
        low = np.full(int(flat.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, flat, np.repeat(doc[pick], [len(classes[i]) for i in pick]))
        smallest = {i: low[classes[i]] for i in pick}
    out = []
    for i, (w, b) in enumerate(zip(who, begin)):
        low = smallest.get(int(number[i]))
        if low is None:
            low = np.full(end[i] - b - window + 1, doc[number[i]])
        repeat = np.flatnonzero(low < least[w])
        if len(repeat):
            first, stop = utf8.runs(repeat + b, repeat + b + window)
            rows = np.arange(offsets[w] - offsets[0], offsets[w + 1] - offsets[0])
            rows = rows[flat_doc[rows] == least[w]]  # the others are repeats as a whole
            for f, s in zip(first, stop):
                out.append((flat_doc[rows], flat_start[rows] + f, flat_start[rows] + s))
    return out


def _symbols(text: bytes, unit: str) -> np.ndarray:
    if unit == "bytes":
        return np.frombuffer(text, np.uint8)
    part = utf8.Texts(np.frombuffer(text, np.uint8), np.array([0, len(text)], np.int64), 0)
    return _elements(part, unit)[0]


def repeated_ranges(docs: DataFrame, unit: str, window: int, gram: int, order: Order) -> DataFrame:
    """(doc_id, starts, sizes) of ranges covered by windows that also start in a smaller document.

    Rows with a null doc_id have no order and are left out; doc_ids must stand for one text each.
    """
    spark = docs.sparkSession
    size = docs.select(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(math.ceil(size / (64 << 20)), min(16 * spark.sparkContext.defaultParallelism, math.ceil(size / (2 << 20))), 1)
    # Written steps: the shuffle files of each are gone before the next fills the disk, and a bucket is settled once.
    settled = written(_scan(docs, unit, window, gram, buckets).groupBy("bucket").applyInArrow(_settle, SETTLED), "settled")
    bytes_of = F.substring(F.col("text").cast("binary"), F.col("byte").cast("int") + 1, F.col("bytes").cast("int"))
    texts = _texts(docs)
    mixed = settled.filter("gram IS NOT NULL").join(texts, F.col("doc") == F.col("doc_id")).select(*_NAMES, bytes_of.alias("text"))
    mixed = mixed.withColumn("part", _part(F.col("gram"), buckets)).groupBy("part")
    sorted_out = mixed.applyInArrow(lambda t: _sort_mixed(t, unit, window, order), "doc bigint, start bigint, stop bigint")
    ranges = written(settled.filter("gram IS NULL").select("doc", "start", "stop").unionByName(sorted_out), "ranges")
    forget(settled)
    packed = F.struct(F.col("start"), (F.col("stop") - F.col("start")).cast("int").alias("size"))
    return ranges.select(F.col("doc").alias("doc_id"), packed.alias("range")).groupBy("doc_id").agg(F.collect_list("range").alias("ranges"))


def _part(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets))


def _texts(docs: DataFrame) -> DataFrame:
    """The texts that have a place in the order, as the joins take them."""
    return docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull())


def with_ranges(docs: DataFrame, unit: str, window: int, gram: int, order: Order) -> DataFrame:
    """doc_id, text and the ranges (null where there are none).

    Ranges lie in one text, so a doc_id has to stand for one. Where some stand for several, documents
    go by numbers in the order of (doc_id, md5 of the text) instead, equal rows by one number.
    """
    nameless = docs.filter(F.col("doc_id").isNull()).select("doc_id", "text")
    named = docs.filter(F.col("doc_id").isNotNull())
    if named.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        found = repeated_ranges(docs, unit, window, gram, order)
        rows = _texts(docs).join(found, "doc_id", "left")
    else:
        keyed = named.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
        # Sorted partitions in turn have rising numbers.
        numbers = written(keyed.select("doc_id", "text_key").distinct().orderBy("doc_id", "text_key").withColumn("number", F.monotonically_increasing_id()), "numbers")
        keyed = written(keyed.join(numbers, ["doc_id", "text_key"]).select("doc_id", "number", "text"), "numbered")
        found = repeated_ranges(keyed.select(F.col("number").alias("doc_id"), "text").dropDuplicates(["doc_id"]), unit, window, gram, order)
        rows = keyed.join(found.withColumnRenamed("doc_id", "number"), "number", "left").select("doc_id", "text", "ranges")
    return rows.unionByName(nameless.withColumn("ranges", F.lit(None).cast(found.schema["ranges"].dataType)))


def covered(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal disjoint ranges of a document's list."""
    return utf8.runs(starts, starts + sizes)
