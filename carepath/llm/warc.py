"""WARC archives through a chunked record table.

Writing: each page is a record, cut into chunks of at most ``CHUNK_CHARS``
characters. A chunk is a row (record, chunk number, bytes, running digest) and becomes
one WARC record of its own; payloads of several chunks use the standard's
segmentation (``WARC-Segment-Number``, continuation records, total length in the
last). A row therefore never exceeds a chunk, whatever the payload's size. Of
equal payloads the one with the smallest id is the response, the others are
revisits that name it.

Spark's text writer puts the rows of a task into one gzip file, whatever their number,
as a payload must not go on in another file (its committer makes the files safe
against lost tasks); the separator of the rows is the blank pair of lines that
ends a WARC record.

Reading: files are streamed as text; a small state machine gives back the chunk
rows, checking lengths and carrying the SHA-1 state from chunk to chunk of a
record, so the payload's digest is known without ever holding the payload.

Duplicates are found from (digest, smallest id), aggregated partially; only digests
that occur twice are joined back, by broadcast if their measured size is small.

Defined cases: a null html is an empty payload; a null id is written as an
unnamed record and read back as null, and ranks after all ids; rows with one id and
payload are all responses if the id is the smallest; white space in a url is
percent-encoded; an empty table gives an empty archive; only the named columns
are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath.llm.common import map_arrow, small_side
from carepath.session import shared_path

CHUNK_CHARS = 256 * 1024
MIN_REVISIT_BYTES = 0
_END = "\r\n\r\n"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
CHUNK_ROWS = ("page_id long, url string, record_type string, refers_to long, chunk_no int, is_last boolean, "
              "chunk binary, payload_bytes long, payload_digest string")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def _record(headers: list[tuple[str, str]], body: str, length: int) -> str:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {length}"]
    return "\r\n".join(lines) + _END + body


def records(page_id, url: str | None, html: str, refers_to, chunk_chars: int = CHUNK_CHARS) -> Iterator[str]:
    """The WARC records of a page: one revisit, or its payload in chunks."""
    name = "" if page_id is None else str(page_id)
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url is not None else None
    common = [("WARC-Date", "1970-01-01T00:00:00Z"), ("X-Page-Id", name)]
    if target is not None:
        common.append(("WARC-Target-URI", target))
    if refers_to is not None:
        raw = html.encode()
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", _urn(page_id)), *common,
                       ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                       ("WARC-Refers-To", _urn(refers_to)), ("X-Refers-To-Page", str(refers_to)),
                       ("X-Payload-Length", str(len(raw))), ("WARC-Payload-Digest", f"sha1:{base32_sha1(raw)}")], "", 0)
        return
    state, total, n = hashlib.sha1(), 0, max(1, -(-len(html) // chunk_chars))
    for k in range(n):
        body = html[k * chunk_chars:(k + 1) * chunk_chars]
        raw = body.encode()
        state.update(raw)
        total += len(raw)
        headers = [("WARC-Type", "continuation" if k else "response"),
                   ("WARC-Record-ID", _urn(f"{page_id}/{k}" if k else page_id)), *common]
        if n > 1:
            headers.append(("WARC-Segment-Number", str(k + 1)))
        if k:
            headers.append(("WARC-Segment-Origin-ID", _urn(page_id)))
        if k == n - 1 and n > 1:
            headers.append(("WARC-Segment-Total-Length", str(total)))
        running = base64.b32encode(state.digest()).decode()
        headers += [("X-Running-Digest", f"sha1:{running}"), ("X-Last", str(int(k == n - 1)))]
        yield _record(headers, body, len(raw))


def with_references(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                    min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, refers_to): the page a revisit points to, null for a response."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    read = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"),
                        F.sha1(html.cast("binary")).alias("sha"))
    again = (read.where((F.octet_length("html") >= min_bytes)).groupBy("sha")
             .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first"))
    points = (F.col("first").isNotNull()) & (F.coalesce(F.col("page_id") != F.col("first"), F.lit(True)))
    return read.join(small_side(again, 96), "sha", "left").select(
        "page_id", "url", "html", F.when(points, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, path: str, *, chunk_chars: int = CHUNK_CHARS, **how) -> None:
    """Write the pages as gzip WARC files under ``path``."""
    def run(batch):
        out, size = [], 0
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for record in records(*row, chunk_chars):
                out.append(record)
                size += len(record)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    (map_arrow(with_references(pages, **how), run, "value string").write.option("lineSep", _END)
     .option("compression", "gzip").option("maxRecordsPerFile", 0).text(path))


class _Reader:
    """Chunk rows from a stream of bytes; holds one chunk at most."""

    def __init__(self):
        self.held = bytearray()
        self.head: dict[str, str] | None = None
        self.state, self.total, self.left = hashlib.sha1(), 0, 0

    def feed(self, piece: bytes) -> Iterator[tuple]:
        """``piece``: what stood before the next separator; its separator is put back, as it may be payload."""
        self.held += piece + _END.encode()
        while True:
            if self.head is None:
                blank = len(self.held) - len(self.held.lstrip(b"\r\n"))
                del self.held[:blank]
                end = self.held.find(_END.encode())
                if end < 0:
                    return
                lines = self.held[:end].decode("utf-8", "replace").split("\r\n")
                if lines[0] != "WARC/1.1":
                    raise ValueError(f"not the start of a record: {lines[0][:60]!r}")
                self.head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
                self.left = int(self.head["Content-Length"])
                del self.held[:end + len(_END)]
            if len(self.held) < self.left + len(_END):
                return
            body = bytes(self.held[:self.left])
            if self.held[self.left:self.left + len(_END)] != _END.encode():
                raise ValueError("a record does not end where it says")
            del self.held[:self.left + len(_END)]
            yield self._row(body)
            self.head = None

    def _row(self, body: bytes) -> tuple:
        h = self.head
        page = int(h["X-Page-Id"]) if h.get("X-Page-Id") else None
        if h["WARC-Type"] == "revisit":
            return (page, h.get("WARC-Target-URI"), "revisit", int(h["X-Refers-To-Page"]), 0, True, b"",
                    int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"))
        number = int(h.get("WARC-Segment-Number", 1)) - 1
        if number == 0:
            self.state, self.total = hashlib.sha1(), 0
        self.state.update(body)
        self.total += len(body)
        digest = base64.b32encode(self.state.digest()).decode()
        if h["X-Running-Digest"] != f"sha1:{digest}":
            raise ValueError(f"digest of page {page}, chunk {number} differs")
        return (page, h.get("WARC-Target-URI"), "response", None, number, h["X-Last"] == "1", body, self.total, digest)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk rows of the archives under ``path``: ``payload_bytes`` and ``payload_digest`` run from chunk
    to chunk; those of the last chunk are the payload's."""
    names = [x.split()[0] for x in CHUNK_ROWS.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.string()]

    def run(batches):
        reader = _Reader()      # one gzip file is one split; files follow each other whole
        for batch in batches:
            out, size = [], 0
            for piece in batch.column(0).cast(pa.large_binary()).to_pylist():
                for row in reader.feed(piece):
                    out.append(row)
                    size += len(row[6])
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        if reader.head is not None:
            raise ValueError("the archive ends inside a record")

    return spark.read.option("lineSep", _END).text(path).mapInArrow(run, CHUNK_ROWS)


def payloads(chunks: DataFrame) -> DataFrame:
    """One row per record: type, reference, full length and digest, from its last chunk."""
    return chunks.where("is_last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives into the shared folder and read these back."""
    path = shared_path(pages.sparkSession, "warc")
    write(pages, path)
    return payloads(read_chunks(pages.sparkSession, path))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT p.*, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (1 + ((('0x' || substr(h, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::INT, 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""
