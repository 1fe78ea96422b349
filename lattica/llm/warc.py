"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Writer: one record for each page, each its own gzip member. Of pages with equal payloads of at least
``least`` bytes, the one with the smallest id is a ``response``; the others are ``revisit`` records
that name it and carry no payload. Which pages repeat is found on (id, digest) rows; the payloads
shuffle once, by page id, so that a very common payload doesn't gather in one task. A file is written
under another name and then renamed.

Reader: every record is checked (gzip's CRC, the header block, Content-Length, the block digest).
After a failed check it searches on for the next valid start: a gzip member that decompresses to a
version line, or in a plain file a version line whose header block is complete. Skipped bytes become gaps with
their offset, length and reason; nothing is read twice, and all later records come through. Files
are read in pieces; memory is bounded by the largest record. A record larger than a cell of a table can be (2 GiB) becomes a gap.

A payload's SHA-1 is taken in the JVM before it is written and once more by the reader, whose check of the block is
also the payload's digest.

``page_rows`` fails at the first gap, unless it is told to leave gaps out; ``gaps`` is the log of all.

Defined cases: a null payload is empty. Pages with a null id are written and come back with one.
Rows that repeat the first page's id and payload are all responses. Empty tables give no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.shared import open_fs, stored, whole_text

VERSION = b"WARC/1.1"
GZIP = b"\x1f\x8b\x08"
PIECE = 1 << 20
#: What a cell of a table can hold, less room for headers.
MOST_BYTES = (1 << 31) - (1 << 20)


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(uri: str | None) -> int | None:
    text = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


NOTHING = digest(b"")


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """The bytes of one record, uncompressed. Its block is the payload, or nothing."""
    body = b"" if revisit else payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_uri(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join((url or "").split())),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
        ("WARC-Block-Digest", f"sha1:{NOTHING if revisit else payload_digest}"),
        ("X-Payload-Length", str(len(payload))),
        *([("WARC-Refers-To", record_uri(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] if revisit else []),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(body))),
    ]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """data as a gzip member."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    body: bytes
    #: The SHA-1 of the body, as read.
    digest: str


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


@dataclass
class _Window:
    """A file's bytes from ``at`` on, read when asked for."""

    file: BinaryIO
    at: int = 0
    data: bytearray = field(default_factory=bytearray)
    ended: bool = False

    def want(self, n: int) -> int:
        """Have n bytes if the file has them; how many there are."""
        while len(self.data) < n and not self.ended:
            piece = self.file.read(max(PIECE, n - len(self.data)))
            self.ended = not piece
            self.data += piece
        return len(self.data)

    def skip(self, n: int) -> None:
        del self.data[:n]
        self.at += n


def parsed(data: bytes) -> tuple[dict[str, str], bytes, str, int]:
    """Headers, body, its digest and length of the record at the start of data. ValueError if it isn't valid, EOFError if data is too short."""
    if not data.startswith(b"WARC/1."):
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise EOFError("header block not ended")
    headers: dict[str, str] = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, sep, value = line.partition(b":")
        if not sep or not name.strip() or name != name.strip():
            raise ValueError("bad header line")
        headers[name.decode("utf-8", "replace").lower()] = value.decode("utf-8", "replace").strip()
    size = headers.get("content-length", "")
    if not size.isdigit():
        raise ValueError("bad Content-Length")
    if int(size) > MOST_BYTES:
        raise ValueError("record larger than a cell")
    if "warc-type" not in headers:
        raise ValueError("no WARC-Type")
    stop = end + 4 + int(size)
    if len(data) < stop + 4:
        raise EOFError("cut short")
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("record not ended where Content-Length says")
    body = bytes(data[end + 4 : stop])
    want, own = headers.get("warc-block-digest", ""), digest(body)
    if want.startswith("sha1:") and want[5:] != own:
        raise ValueError("block digest differs")
    return headers, body, own, stop + 4


def _member(window: _Window) -> tuple[dict[str, str], bytes, str, int]:
    """The record in the gzip member at the window's start, and the member's length."""
    d, out, used, size, begins = zlib.decompressobj(31), [], 0, 0, b""
    step = 1 << 12
    try:
        while not d.eof:
            have = window.want(used + 1)
            if have <= used:
                raise ValueError("member cut short")
            stop = min(have, used + step)
            piece = d.decompress(bytes(memoryview(window.data)[used:stop]))
            out.append(piece)
            used, size, step = stop - len(d.unused_data), size + len(piece), min(step * 2, 1 << 16)
            begins = (begins + piece)[:7]
            if len(begins) == 7 and begins != b"WARC/1.":
                raise ValueError("no version line")
            if size > MOST_BYTES + (1 << 19):
                raise ValueError("record larger than a cell")
    except zlib.error as e:
        raise ValueError(f"gzip: {e}") from None
    try:
        headers, body, own, n = parsed(b"".join(out))
    except EOFError as e:
        raise ValueError(str(e)) from None
    if n != size:
        raise ValueError("bytes after the record in its member")
    return headers, body, own, used


def _plain(window: _Window) -> tuple[dict[str, str], bytes, str, int]:
    """The record at the window's start."""
    n = 1 << 16
    while True:
        have = window.want(n)
        try:
            return parsed(bytes(window.data[:n]))
        except EOFError as e:
            if have < n or n > 2 * MOST_BYTES:
                raise ValueError(str(e)) from None
            n *= 4


def salvage(file: BinaryIO) -> Iterator[Record | Gap]:
    """All valid records of a file in order, gzip members or plain, and the gaps between them."""
    w = _Window(file)
    lost, why, tried = 0, "", 0
    while w.want(max(tried + 7, 1)) > tried:
        start = 0 if not tried and w.data.startswith((GZIP, b"WARC/1.")) else min((i for i in (w.data.find(GZIP, tried), w.data.find(b"WARC/1.", tried)) if i >= 0), default=-1)
        if start < 0:  # keep what may be the beginning of a mark
            rest = len(w.data) if w.ended else max(0, len(w.data) - 6)
            if rest:
                lost, why, tried = lost + rest, why or "no record begins here", 0
                w.skip(rest)
            w.want(len(w.data) + PIECE)
            continue
        if start:
            lost, why, tried = lost + start, why or "no record begins here", 0
            w.skip(start)
        try:
            headers, body, own, n = _member(w) if w.data.startswith(GZIP) else _plain(w)
        except ValueError as e:
            lost, why = lost + 1, why or str(e)
            w.skip(1)
            continue
        if lost:
            yield Gap(w.at - lost, lost, why)
            lost, why = 0, ""
        yield Record(w.at, n, headers, body, own)
        w.skip(n)
    if lost:
        yield Gap(w.at - lost, lost, why)


def _sha1(payload: Column) -> Column:
    return F.sha1(F.encode(payload, "UTF-8"))


def repeats(pages: DataFrame, id_col: str, payload_col: str, least: int) -> DataFrame:
    """page, refers_to: for each page that repeats the payload of another with a smaller id."""
    payload = whole_text(payload_col)
    found = pages.select(F.col(id_col).cast("long").alias("page"), _sha1(payload).alias("sha"), F.octet_length(payload).cast("long").alias("bytes"))
    rows = stored(found.where((F.col("bytes") >= least) & F.col("page").isNotNull()).select("page", "sha"), "payload-digests")
    first = stored(rows.groupBy("sha").agg(F.min("page").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first-payloads")
    # joined with a written table, so that AQE can split a common digest
    return rows.join(first, "sha").where("page <> refers_to").select("page", "sha", "refers_to").distinct()


def _write(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(uri)
        name, n, at, f = f"part-{TaskContext.get().partitionId():06d}.warc.gz", 0, 0, None
        part = f"{path}/.{name}.{uuid.uuid4().hex}"
        for b in batches:
            for page, url, html, sha, refers_to in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if not f:
                    fs.create_dir(path, recursive=True)
                    f = fs.open_output_stream(part, compression=None)
                payload = html.encode("utf-8", "surrogatepass")
                data = member(record(page, url, payload, base64.b32encode(bytes.fromhex(sha)).decode(), refers_to, refers_to is not None))
                f.write(data)
                n, at = n + 1, at + len(data)
        if f:
            f.close()
            fs.move(part, f"{path}/{name}")
            yield pa.RecordBatch.from_pydict({"path": [f"{uri}/{name}"], "records": [n], "bytes": [at]})

    return run


def write_archives(pages: DataFrame, uri: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> list[dict]:
    """Write a record for each page; the files, with their records and bytes."""
    again = repeats(pages, id_col, payload_col, least)
    payload = whole_text(payload_col)
    rows = pages.select(F.col(id_col).cast("long").alias("p"), F.col(url_col).cast("string").alias("url"), payload.alias("html"), _sha1(payload).alias("own"))
    out = ["p", "url", "html", "own", "refers_to"]
    joined = rows.where("p IS NOT NULL").join(again, (rows["p"] == again["page"]) & (rows["own"] == again["sha"]), "left").select(*out)
    # pages without an id repeat nothing, so they aren't dealt by it
    joined = joined.unionByName(rows.where("p IS NULL").withColumn("refers_to", F.lit(None).cast("long")).select(*out))
    files = joined.mapInArrow(_write(uri), "path string, records long, bytes long").collect()
    return sorted((f.asDict() for f in files), key=lambda f: f["path"])


ROWS = "file string, offset long, length long, gap string, headers map<string,string>, body binary, digest string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("gap", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary()), ("digest", pa.string())])
    for b in batches:
        for uri in b.column(0).to_pylist():
            fs, path = open_fs(uri)
            rows: list[tuple] = []
            size = 0
            with fs.open_input_stream(path, compression=None) as f:  # members are told apart here
                for x in salvage(f):
                    rows.append((uri, x.offset, x.length, x.reason, None, None, None) if isinstance(x, Gap) else (uri, x.offset, x.length, None, list(x.headers.items()), x.body, x.digest))
                    size += x.length if isinstance(x, Gap) else len(x.body)
                    if len(rows) >= 1000 or size >= 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_archives(spark: SparkSession, uris: list[str]) -> DataFrame:
    """A row for each record (headers, body) and each quarantined gap (its reason) of the files."""
    paths = spark.createDataFrame([(u,) for u in uris], "uri string")
    return paths.repartition(max(1, len(uris))).mapInArrow(_read, ROWS)


def gaps(records: DataFrame) -> DataFrame:
    """The log of quarantined bytes: file, offset, length, reason."""
    return records.where("gap IS NOT NULL").select("file", "offset", "length", F.col("gap").alias("reason"))


def page_rows(records: DataFrame, leave_gaps: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records read. A gap raises an error, or is left out if so told."""
    h = F.col("headers")
    own = F.regexp_extract(h["warc-record-id"], r"^<urn:page:(-?\d+)>$", 1)
    to = F.regexp_extract(F.coalesce(h["warc-refers-to"], F.lit("")), r"^<urn:page:(-?\d+)>$", 1)
    kind = h["warc-type"]
    lost = F.concat(F.lit("damage in "), "file", F.lit(" at byte "), F.col("offset").cast("string"), F.lit(": "), "gap")
    whole = F.col("gap").isNull()
    return records.where(whole if leave_gaps else F.when(whole, F.lit(True)).otherwise(F.raise_error(lost).cast("boolean"))).select(
        F.when(own != "", own.cast("long")).alias("page_id"),
        F.when(kind == "response", F.length("body").cast("long")).otherwise(h["x-payload-length"].cast("long")).alias("payload_bytes"),
        F.when(kind == "response", F.col("digest")).otherwise(F.regexp_replace(h["warc-payload-digest"], "^sha1:", "")).alias("payload_digest"),
        kind.alias("record_type"),
        F.when(to != "", to.cast("long")).alias("refers_to"),
    )
