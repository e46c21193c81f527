"""WARC archives: a writer, and a reader that salvages what damaged archives still hold.

Archives go through Spark's text source, which reads and writes raw bytes, splits large files over
tasks and commits like any table. The reader lets it part a file at the mark that begins a member
(gzip's first three bytes) or a record (``WARC/1.``), so a row is what may be one. A candidate is
tried with as many rows as it takes, as the mark may also occur inside. If a check fails (gzip's
own, version line, headers, length, end of record, digests), the row is quarantined and the search
goes on at the next mark; inside a member, at the next version line. What a task cannot decide at
the edges of its split is put together again per file in a second pass.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.llm.registry import query, table
from panelwright.llm.store import stored
from panelwright.session import fresh_path

GZIP_MARK, PLAIN_MARK = b"\x1f\x8b\x08", b"WARC/1."
_VERSION = re.compile(rb"(?:^|(?<=\n))WARC/1\.")
_CONTROL = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|\r(?!\n)|(?<!\r)\n")
_SALTS = 16
_FLUSH = 4 << 20  # bytes of an Arrow batch of records
LONGEST = 1 << 30  # a record that claims more fails the check of its length: a row holds no more


# Records


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record; line breaks in values become blanks."""
    lines = [f"{k}: {' '.join(v.split())}" for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose last byte is zero: one of 16 MiB or more is followed by an empty one."""
    def pack(x: bytes) -> bytes:
        c = zlib.compressobj(level, zlib.DEFLATED, 31)
        return c.compress(x) + c.flush()

    made = pack(data)
    return made if made.endswith(b"\0") else made + pack(b"")


def labelled(digest: bytes) -> str:
    return f"sha1:{base64.b32encode(digest).decode()}"


def digest_hex(label: str | None) -> str | None:
    """Bare lower-case hex of a SHA-1 label in base 32 or base 16, None for anything else."""
    name, _, value = (label or "").partition(":")
    if name.lower() != "sha1":
        return None
    try:
        raw = base64.b32decode(value) if len(value) == 32 else bytes.fromhex(value)
    except ValueError:
        return None
    return raw.hex() if len(raw) == 20 else None


def _head(data: bytes, begin: int, strict: bool = True) -> tuple[dict[str, str], int] | None:
    """Header fields (names in lower case) from ``begin`` on and where what follows them begins; ``strict`` takes no control characters."""
    end = data.find(b"\r\n\r\n", begin)
    if end < 0 or strict and _CONTROL.search(data, begin, end):
        return None
    fields: dict[str, str] = {}
    name = None
    for line in data[begin:end].decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
            continue
        name, sep, value = line.partition(":")
        if not sep or not name.strip():
            return None
        name = name.strip().lower()
        fields[name] = value.strip()
    return fields, end + 4


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes
    size: int  # bytes of the whole record


def parse_record(data: bytes, begin: int = 0) -> Record | str:
    """The record at ``begin``, or the check that it fails: version, headers, length, truncated, end, digest."""
    if not data.startswith(PLAIN_MARK, begin):
        return "version"
    got = _head(data, begin)
    if got is None:
        return "headers"
    headers, start = got
    claimed = headers.get("content-length", "")
    if not (claimed.isascii() and claimed.isdigit()) or int(claimed) > LONGEST:
        return "length"
    stop = start + int(claimed)
    if stop > len(data):
        return "truncated"
    if data[stop: stop + 4] != b"\r\n\r\n":
        return "end"
    block = data[start:stop]
    http, payload = {}, block
    if headers.get("content-type", "").startswith("application/http") and (inner := _head(block, 0, strict=False)):
        http, payload = inner[0], block[inner[1]:]
    wanted = [(digest_hex(headers.get("warc-block-digest")), block)]
    if headers.get("warc-type") != "revisit":
        wanted.append((digest_hex(headers.get("warc-payload-digest")), payload))
    if any(d and hashlib.sha1(x).hexdigest() != d for d, x in wanted):
        return "digest"
    return Record(headers, http, payload, stop + 4 - begin)


def records_in(data: bytes) -> Iterator[tuple[int, Record | tuple[int, str]]]:
    """(place, record) and (place, (length, reason)) for the gaps between the records of a member."""
    at = 0
    while at < len(data):
        got = parse_record(data, at)
        if isinstance(got, Record):
            yield at, got
            at += got.size
            continue
        found = _VERSION.search(data, at + 1)
        after = found.start() if found else len(data)
        yield at, (after - at, got)
        at = after


# Salvage


class _Gzip:
    """A member that is being read; ``feed`` gives None while more is needed, else the bytes after it or a failed check."""

    mark = GZIP_MARK

    def __init__(self):
        self.inflate, self.parts = zlib.decompressobj(31), []

    def feed(self, chunk: bytes, room: int) -> int | str | None:
        try:
            self.parts.append(self.inflate.decompress(chunk))
        except zlib.error:
            return "gzip"
        return len(self.inflate.unused_data) if self.inflate.eof else None

    def data(self) -> bytes:
        return b"".join(self.parts)


class _Plain:
    """A record that is being read."""

    mark = PLAIN_MARK

    def __init__(self):
        self.held, self.need = bytearray(), 0

    def feed(self, chunk: bytes, room: int) -> int | str | None:
        self.held += chunk
        if not self.need:
            if self.held.find(b"\r\n\r\n") < 0:
                return None if len(self.held) < 1 << 20 else "headers"
            got = _head(bytes(self.held), 0)
            if got is None:
                return "headers"
            claimed = got[0].get("content-length", "")
            if not (claimed.isascii() and claimed.isdigit()) or int(claimed) > LONGEST or got[1] + int(claimed) > room:
                return "length"
            self.need = got[1] + int(claimed) + 4
        if len(self.held) < self.need:
            return None
        got = parse_record(bytes(self.held[: self.need]))
        return got if isinstance(got, str) else len(self.held) - self.need

    def data(self) -> bytes:
        return bytes(self.held[: self.need])


@dataclass
class _Scan:
    """Search through rows that follow one another in a file.

    ``final`` is off in the first pass: rows before the first good member and rows that wait for more
    at the end are loose and go to the second pass.
    """

    kind: type
    final: bool
    room: int  # bytes of the file
    rows: list[tuple[int, bytes]] = field(default_factory=list)
    begun: bool = False
    reader: object = None
    tried: int = 0

    def _quarantine(self, at: int, raw: bytes, reason: str):
        if self.begun or self.final:
            yield "gap", at, len(raw), -1, reason
        else:
            yield "loose", at, len(raw), -1, raw

    def push(self, at: int, raw: bytes):
        self.rows.append((at, raw))
        while self.tried < len(self.rows):
            if self.reader is None:
                self.reader = self.kind()
            begin = self.rows[0][0]
            status = self.reader.feed(self.rows[self.tried][1], self.room - begin)
            self.tried += 1
            if isinstance(status, str):
                yield from self._skip(status)
            elif status is not None:
                self.begun = True
                end = self.rows[self.tried - 1][0] + len(self.rows[self.tried - 1][1])
                yield "data", begin, end - status - begin, -1, self.reader.data()
                if status:
                    yield "gap", end - status, status, -1, "between"
                del self.rows[: self.tried]
                self.reader, self.tried = None, 0

    def _skip(self, reason: str):
        """The first row is no good; the next one is tried from its start."""
        at, raw = self.rows.pop(0)
        self.reader, self.tried = None, 0
        yield from self._quarantine(at, raw, reason)

    def finish(self):
        while self.rows:
            if self.final:
                rest = self.rows[1:]
                self.rows = self.rows[:1]
                yield from self._skip("truncated")
                for at, raw in rest:
                    yield from self.push(at, raw)
            else:
                for at, raw in self.rows:
                    yield "loose", at, len(raw), -1, raw
                self.rows = []


_SCHEMA = ("kind string, file string, block long, at long, length long, inside long, reason string, headers map<string,string>, http map<string,string>, "
           "payload_bytes long, payload_digest string, payload binary, raw binary, declared_digest string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    pairs = pa.map_(pa.string(), pa.string())
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pairs, pairs, pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in _SCHEMA.split(", ")])


def _opened(events, file: str, block: int, with_payload: bool) -> Iterator[tuple]:
    """What a scan found as rows; members are opened to their records."""
    for kind, at, length, _, x in events:
        if kind == "gap":
            yield "gap", file, block, at, length, None, x, *[None] * 7
        elif kind == "loose":
            yield "loose", file, block, at, length, *[None] * 7, x, None
        else:
            for inside, got in records_in(x):
                if isinstance(got, Record):
                    h, hs = list(got.headers.items()), list(got.http.items())
                    yield ("record", file, block, at, length, inside, None, h, hs, len(got.payload), hashlib.sha1(got.payload).hexdigest(),
                           got.payload if with_payload else None, None, digest_hex(got.headers.get("warc-payload-digest")))
                else:
                    yield "gap", file, block, at, got[0], inside, got[1], *[None] * 7


def _flushed(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[11] or b"") + len(row[12] or b"") + 200
        if size >= _FLUSH:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _first_pass(kind: type, with_payload: bool):
    """Arrow function over the rows of splits in order; places are counted from the split's first row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, scan, at = None, None, 0
        mark = kind.mark
        for batch in batches:
            columns = [batch.column(c) for c in ("value", "file", "block", "size")]
            for i in range(batch.num_rows):
                value, file, block, size = (c[i].as_py() for c in columns)
                if (file, block) != now:
                    if scan:
                        yield from _opened(scan.finish(), *now, with_payload)
                    now, scan, at = (file, block), _Scan(kind, False, size), 0
                    if not block:  # what comes before a file's first mark
                        if value:
                            yield from _opened([("loose", 0, len(value), -1, value)], *now, with_payload)
                        at = len(value)
                        continue
                yield from _opened(scan.push(at, mark + value), *now, with_payload)
                at += len(mark) + len(value)
        if scan:
            yield from _opened(scan.finish(), *now, with_payload)

    return lambda batches: _flushed(rows(batches))


def _second_pass(kind: type, with_payload: bool):
    """Arrow function over loose rows by file and place: those that touch are searched together."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        name, scan, end = None, None, None
        for batch in batches:
            columns = [batch.column(c) for c in ("raw", "file", "at", "size")]
            for i in range(batch.num_rows):
                raw, file, at, size = (c[i].as_py() for c in columns)
                if file != name or at != end:
                    if scan:
                        yield from _opened(scan.finish(), name, 0, with_payload)
                    name, scan = file, _Scan(kind, True, size)
                end = at + len(raw)
                if raw.startswith(kind.mark):
                    yield from _opened(scan.push(at, raw), name, 0, with_payload)
                else:
                    yield from _opened([("gap", at, len(raw), -1, "version")], name, 0, with_payload)
        if scan:
            yield from _opened(scan.finish(), name, 0, with_payload)

    return lambda batches: _flushed(rows(batches))


def read_archives(spark: SparkSession, path: str | list[str], compressed: bool = True, with_payload: bool = True) -> DataFrame:
    """Records and quarantined gaps of archives, by kind ``record`` or ``gap``.

    Both have file, at (the member's or record's first byte in the file) and length (its bytes there),
    and inside (place in the unpacked member). A gap has the reason of the first check it failed; with
    inside set its length counts unpacked bytes. Records have headers and http (maps, names in lower
    case), payload (without HTTP headers), payload_bytes and payload_digest, computed from what was
    read. Members of a file that are whole and pass all checks are always found; every byte of a file
    is in a member or in a gap. Files may be of any size and are read in splits; empty files give no rows.
    """
    kind = _Gzip if compressed else _Plain
    mark = kind.mark
    rows = (
        spark.read.option("lineSep", mark.decode("latin-1")).option("encoding", "ISO-8859-1").option("recursiveFileLookup", "true").text(path)
        .select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                F.col("_metadata.file_size").alias("size"))
    )
    # bytes of a split's rows with their marks; the first row of a file has none
    marks = F.when(F.col("block") == 0, F.count("*") - 1).otherwise(F.count("*")) * len(mark)
    splits = stored(rows.groupBy("file", "block").agg((F.sum(F.octet_length("value")) + marks).alias("n"), F.first("size").alias("size")), "warc-splits")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per split of the file
    base = splits.select("file", "block", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    found = rows.mapInArrow(_first_pass(kind, with_payload), _SCHEMA).join(base, ["file", "block"]).withColumn("at", F.col("at") + F.col("base")).drop("base", "block")
    found = stored(found, "warc-found")  # for both kinds of rows
    columns = ["kind", "file", "at", "length", "inside", "reason", "headers", "http", "payload_bytes", "payload_digest", "declared_digest", "payload"]
    loose = found.filter("kind = 'loose'").select("raw", "file", "at", "size").repartition("file").sortWithinPartitions("file", "at")
    late = loose.mapInArrow(_second_pass(kind, with_payload), _SCHEMA)
    # a mark at the very end of a file begins no row
    read = splits.groupBy("file").agg(F.sum("n").alias("at"), F.first("size").alias("size")).filter("at < size")
    rest = read.select(F.lit("gap").alias("kind"), "file", "at", (F.col("size") - F.col("at")).alias("length"), F.lit("truncated").alias("reason"))
    return found.filter("kind <> 'loose'").select(*columns).unionByName(late.select(*columns)).unionByName(rest, allowMissingColumns=True)


# Pages


def with_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload, refers_to: of equal payloads of ``least`` bytes or more the largest page_id is the response, others revisit it.

    A null html is an empty payload. A null page_id comes before all others; rows that repeat the
    response's id are responses too. Payloads are told by SHA-256. A payload that a third of the pages
    share is met in ``_SALTS`` places.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    large = F.octet_length("payload") >= least
    own = F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))  # is no digest
    rows = rows.withColumn("key", F.when(large, F.sha2("payload", 256)).otherwise(own)).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(_SALTS)).cast("int"))
    again = rows.filter(large).groupBy("key").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1 and response is not null")
    again = again.select("key", "response", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    return rows.join(again, ["key", "salt"], "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", url))
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", labelled(hashlib.sha1(payload).digest())),
                ("WARC-Block-Digest", labelled(hashlib.sha1(block).digest()))]
    if refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return warc_record(headers, block)


def write_archives(pages: DataFrame, path: str, compressed: bool = True, date: str = "2000-01-01T00:00:00Z", least: int = 1000) -> None:
    """Write a record per page (page_id, url, html), a gzip member each or plain; every file begins with a warcinfo record.

    A record ends with a byte that is always the same (zero for a member, a line feed for plain ones),
    which the text source writes as its line separator. Other columns are ignored; an empty table
    gives a folder without records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:info>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")],
                           b"format: WARC File Format 1.1\r\n")
        held, size = [info], 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "refers_to")]
            payloads = batch.column("payload").cast(pa.binary())
            for i in range(batch.num_rows):
                page_id, url, refers_to = (c[i].as_py() for c in columns)
                held.append(page_record(page_id, url, payloads[i].as_py(), refers_to, date))
                size += len(held[-1])
                if size >= _FLUSH:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    def packed(held: list[bytes]) -> pa.RecordBatch:
        made = [gzip_member(r) if compressed else r for r in held]
        return pa.RecordBatch.from_arrays([pa.array([m[:-1] for m in made], pa.binary())], names=["value"])

    rows = with_revisits(pages, least).mapInArrow(run, "value binary")
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0" if compressed else "\n").text(path)


def pages_of(found: DataFrame) -> DataFrame:
    """Pages by the records of ``read_archives``: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's payload is the one it refers to: its length is in the HTTP header, its digest in the record's.
    """
    urn = r"^<urn:page:(-?\d*)>$"
    number = lambda c: F.regexp_extract(c, urn, 1).try_cast("long")
    records = found.filter("kind = 'record'").select(
        "headers", "http", "payload_bytes", "payload_digest", "declared_digest", F.col("headers")["warc-type"].alias("record_type"))
    revisit = F.col("record_type") == "revisit"
    return records.filter(F.col("record_type").isin("response", "revisit")).select(
        number(F.col("headers")["warc-record-id"]).alias("page_id"),
        F.when(revisit, F.col("http")["content-length"].try_cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", F.when(revisit, number(F.col("headers")["warc-refers-to"])).alias("refers_to"))


@query("op13_warc")
def op13_warc(spark, folder):
    path = fresh_path(spark, "warc")
    write_archives(table(spark, folder, "pages"), path)
    return pages_of(read_archives(spark, path, with_payload=False))
