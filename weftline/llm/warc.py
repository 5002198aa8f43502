"""WARC: archives of one gzip member per record, written and read in tasks.

A record's block is an HTTP response. Of records with equal payloads the one with the largest id
is kept as a response; the others are revisits, whose block has the HTTP header alone, with the
payload's length, and which name the response and the payload's digest. The reader goes through
an archive once: chunks of the file are decompressed as they come, a record's header ends at the
blank line, its block is as long as Content-Length says, and block and payload are held against
their SHA-1 digests while they pass.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.session import shared_dir, table, written

CHUNK = 1 << 20
RECORD = "urn:x-weftline:record:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(number: int | None) -> str:
    """A record's URI; a row without an id gets a random one."""
    return f"{RECORD}{number}" if number is not None else f"{RECORD}none:{uuid.uuid4()}"


def _number(name: str) -> int | None:
    bare = name.strip("<>").removeprefix(RECORD)
    return None if bare.startswith("none:") else int(bare)


def _uri(url: str | None, name: str) -> str:
    """Header values hold one line: white space and control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else name


def member(number: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE, level: int = 6) -> bytes:
    """One record as a gzip member; with `refers_to` a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block, name = http if refers_to is not None else http + payload, _name(number)
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{name}>",
        "WARC-Date": date,
        "WARC-Target-URI": _uri(url, name),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{_name(refers_to)}>"}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(text.encode()) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


class _Members:
    """Decompressed bytes of a file, member after member, a chunk at a time."""

    def __init__(self, stream):
        self.stream, self.raw, self.unzip, self.ready = stream, b"", None, bytearray()

    def begin(self) -> bool:
        """Go to the next member; False at the end of the file."""
        if not self.raw:
            self.raw = self.stream.read(CHUNK)
        if not self.raw:
            return False
        self.unzip, self.ready = zlib.decompressobj(31), bytearray()
        return True

    def more(self) -> bool:
        """Decompress another chunk of this member into `ready`; False at the member's end."""
        if self.unzip.eof:
            return False
        data = self.unzip.unconsumed_tail or self.raw or self.stream.read(CHUNK)
        if not data:
            raise ValueError("archive ends inside a record")
        if not self.unzip.unconsumed_tail:
            self.raw = b""
        self.ready += self.unzip.decompress(data, CHUNK)
        if self.unzip.eof:
            self.raw = self.unzip.unused_data or self.raw
        return True


def records(stream, payloads: bool = False) -> Iterator[dict]:
    """The records of an archive in order. Raises ValueError where framing or a digest is wrong."""
    members = _Members(stream)
    while members.begin():
        while (end := members.ready.find(b"\r\n\r\n")) < 0:
            if not members.more():
                raise ValueError("record header without end")
        lines = bytes(members.ready[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        head = dict(line.split(": ", 1) for line in lines[1:])
        del members.ready[: end + 4]
        left, block, body, http, kept = int(head["Content-Length"]), hashlib.sha1(), hashlib.sha1(), b"", []
        size, inside = 0, False
        while left:
            if not members.ready and not members.more():
                raise ValueError("block shorter than Content-Length")
            data = bytes(members.ready[:left])
            del members.ready[: len(data)]
            left -= len(data)
            block.update(data)
            if not inside:
                http += data
                if (cut := http.find(b"\r\n\r\n")) < 0:
                    continue
                http, data, inside = http[:cut], http[cut + 4 :], True
            body.update(data)
            size += len(data)
            if payloads:
                kept.append(data)
        while members.more():
            pass
        if members.ready != b"\r\n\r\n":
            raise ValueError("block longer than Content-Length")
        if f"sha1:{base64.b32encode(block.digest()).decode()}" != head["WARC-Block-Digest"]:
            raise ValueError(f"block digest of {head['WARC-Record-ID']} does not match")
        fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
        if head["WARC-Type"] == "response":
            if f"sha1:{base64.b32encode(body.digest()).decode()}" != head["WARC-Payload-Digest"] or size != int(fields["Content-Length"]):
                raise ValueError(f"payload digest of {head['WARC-Record-ID']} does not match")
        yield {
            "id": _number(head["WARC-Record-ID"]),
            "url": head["WARC-Target-URI"],
            "payload_bytes": int(fields["Content-Length"]),
            "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:"),
            "record_type": head["WARC-Type"],
            "refers_to": _number(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None,
            "payload": b"".join(kept) if payloads and head["WARC-Type"] == "response" else None,
        }


def with_responses(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """rows(id, url, payload) plus refers_to: the largest id among equal payloads, null for that id itself.

    Payloads under `min_bytes` are all responses. Counts are combined before the shuffle, and the
    group's id comes back by a join that adaptive execution splits where one payload is hot.
    """
    keyed = rows.withColumn("__key", F.sha2("payload", 256)).withColumn("__size", F.octet_length("payload"))
    last = keyed.filter(F.col("__size") >= min_bytes).groupBy("__key", "__size").agg(F.max("id").alias("__last"), F.count("*").alias("__n"))
    last = last.filter("__n > 1").select(F.col("__key").alias("__same"), "__last")
    joined = keyed.join(last, F.col("__key") == F.col("__same"), "left")
    refers = F.when(~F.col("id").eqNullSafe(F.col("__last")), F.col("__last"))
    return joined.select("id", "url", "payload", refers.alias("refers_to"))


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = 64 << 20) -> DataFrame:
    """Write rows(id, url, payload, refers_to) as archives; a written table of their paths and sizes.

    An attempt writes files of its own name; only those that a finished attempt reports are in
    the table, so a lost executor leaves at most files that nobody reads.
    """

    def run(batches):
        target, base, out, size, count = None, "", None, 0, 0
        attempt = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        files = 0

        def report():
            return pa.RecordBatch.from_arrays([pa.array([base]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], names=["path", "n_records", "n_bytes"])

        for batch in batches:
            for number, url, payload, refers in zip(*(batch.column(c) for c in ("id", "url", "payload", "refers_to"))):
                if out is None:
                    base, size, count, files = f"{folder}/part-{attempt}-{files:04d}.warc.gz", 0, 0, files + 1
                    target, path = _open(base)
                    target.create_dir(path.rpartition("/")[0], recursive=True)
                    out = target.open_output_stream(path)
                data = member(number.as_py(), url.as_py(), payload.as_py(), refers.as_py())
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield report()
        if out is not None:
            out.close()
            yield report()

    return written(rows.select("id", "url", "payload", "refers_to").mapInArrow(run, "path string, n_records bigint, n_bytes bigint"), "archives")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the archives in `archives` (a column `path`), one row each."""

    def run(batches):
        names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for base in batch.column("path").to_pylist():
                system, path = _open(base)
                with system.open_input_stream(path) as stream:
                    rows: list[dict] = []
                    held = 0
                    for record in records(stream, payloads):
                        rows.append(record)
                        held += len(record["payload"] or b"")
                        if len(rows) >= 4096 or held >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)

    spread = archives.select("path").repartition(max(archives.sparkSession.sparkContext.defaultParallelism * 4, 1), "path")
    schema = "id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    return spread.mapInArrow(run, schema)


def round_trip(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Archive pages(page_id, url, html) and read the archives back.

    A null html is an empty payload, a null url gets the record's own URI. Each row is a record, also
    where rows or ids repeat: rows that repeat the largest id of a payload are all responses. A row
    without an id is read back without one; it revisits a page of the same payload that has an id,
    and is never referred to. Payloads are kept whole, however long, other columns are not used.
    An empty table gives an empty table.
    """
    rows = pages.select(F.col("page_id").alias("id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    archives = write_archives(with_responses(rows, min_bytes), folder)
    return read_archives(archives).drop("payload").withColumnRenamed("id", "page_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = round_trip(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc")
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# Base 32 from the digest's hexadecimal digits: five of them are four characters.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM s
"""

QUERIES = {"op10_warc": op10_warc}
ORACLES = {"op10_warc": ORACLE}
