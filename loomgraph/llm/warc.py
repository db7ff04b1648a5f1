"""WARC archives: a writer with revisit records, and a salvage reader.

Writing: one file a task, every record a gzip member of its own. Of records with equal
payloads the one with the least id is the response; the others are revisits without
payload that name it. Only ids and digests are grouped; a page's html is shuffled once, by
its id.

Reading: a file is read as it streams, member by member. Each record must inflate whole
and pass its checks (gzip crc, version line, lengths, block and payload digests). After a
failed check the reader searches on from the next byte for a gzip member whose content
begins with a version line, or for a bare version line (uncompressed records), recovers
what follows, and logs the bytes between as quarantined.

Defined results: null html counts as an empty payload; null ids are dropped; rows that
repeat an id with one payload are written once (with several payloads: once for each); an
empty table writes no files; other columns are not stored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.shared_files import AtomicFile, open_uri
from loomgraph.llm.token_store import _schema
from loomgraph.llm.workers import mapped
from loomgraph.scratch import materialize, scratch_path

VERSION = re.compile(rb"WARC/1\.[01]\r\n")
GZIP = b"\x1f\x8b\x08"
ID = "urn:x-page:"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 1 << 20


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed; a revisit keeps the HTTP header of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID}{page_id}>", f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_32(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if " " < c else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    data = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    return data


def member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> list[str]:
    """Writes the archives; returns their paths (one a task)."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload")).where("page_id is not null")
    keyed = materialize(rows.select("page_id", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("bytes")).distinct(), "payloads")
    first = keyed.where(F.col("bytes") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "first")
    first = materialize(first, "first-payloads")  # as a table, so that the join can split a hot payload
    revisits = materialize(keyed.join(first, "sha1").where("page_id > first").select("page_id", "sha1", "first"), "revisits")
    marked = rows.withColumn("sha1", F.sha1("payload")).join(revisits, ["page_id", "sha1"], "left")
    ordered = marked.select("page_id", "url", "payload", "sha1", "first").repartition("page_id").sortWithinPartitions("page_id", "sha1", "url")

    def write(batches):
        from pyspark import TaskContext

        out, target, last = None, f"{path}/part-{TaskContext.get().partitionId():06d}.warc.gz", None
        try:
            for b in batches:
                for page, url_, payload, sha1, first_ in zip(*(c.to_pylist() for c in b.columns)):
                    if (page, sha1) == last:
                        continue
                    last = page, sha1
                    out = out or AtomicFile(target)
                    out.write(member(record(page, url_, payload, base64.b32encode(bytes.fromhex(sha1)).decode(), first_)))
        except BaseException as e:
            if out:
                out.__exit__(type(e))
            raise
        if out:
            out.__exit__(None)
            yield pa.RecordBatch.from_arrays([pa.array([target])], names=["path"])

    return sorted(r.path for r in ordered.transform(mapped, write, "path string").collect())


@dataclass
class Record:
    offset: int
    kind: str
    page_id: int
    url: str | None
    payload_bytes: int
    digest: str
    refers_to: int | None
    payload: bytes | None


class Damaged(Exception):
    pass


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, bytes used) of a record at a place of data; raises Damaged, or EOFError if data end too soon."""
    m = VERSION.match(data, at)
    if not m:
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", m.end() - 2)
    if end < 0:
        raise EOFError
    headers = {}
    for line in data[m.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise Damaged("no usable length")
    begin = end + 4
    stop = begin + int(length)
    if len(data) < stop + 4:
        raise EOFError
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("no end of record after its length")
    return headers, data[begin:stop], stop + 4 - at


def check(headers: dict[str, str], block: bytes, offset: int) -> Record:
    """The record, its digests held against its bytes."""
    named = headers.get("warc-record-id", "").strip("<>")
    digest = headers.get("warc-payload-digest", "")
    kind = headers.get("warc-type", "")
    head, blank, payload = block.partition(b"\r\n\r\n")
    stated = re.search(rb"^content-length:\s*(\d+)\s*$", head, re.I | re.M)
    if not (named.startswith(ID) and named[len(ID) :].lstrip("-").isdigit() and digest.startswith("sha1:") and blank and stated) or kind not in ("response", "revisit"):
        raise Damaged("headers are missing")
    if headers.get("warc-block-digest") not in (None, "sha1:" + sha1_32(block)):
        raise Damaged("block digest differs")
    refers = headers.get("warc-refers-to", "").strip("<>")
    if kind == "response" and (len(payload) != int(stated[1]) or sha1_32(payload) != digest[5:]):
        raise Damaged("payload digest differs")
    if kind == "revisit" and not refers.startswith(ID):
        raise Damaged("a revisit names no response")
    return Record(offset, kind, int(named[len(ID) :]), headers.get("warc-target-uri"), int(stated[1]), digest[5:], int(refers[len(ID) :]) if kind == "revisit" else None, payload if kind == "response" else None)


class Salvage:
    """Iterates the good records of a file; ``gaps`` then lists (begin, end, reason) of quarantined bytes."""

    def __init__(self, file, size: int):
        self.file, self.size, self.gaps = file, size, []
        self.buffer, self.base = b"", 0  # bytes of the file from base on

    def _more(self) -> bool:
        """Reads on, as much again as the buffer holds, so that a long record is not copied for every block."""
        data = self.file.read(max(READ_BYTES, len(self.buffer)))
        self.buffer += data
        return bool(data)

    def _drop(self, at: int) -> None:
        """Bytes before a place are not needed any more; they go a block at a time."""
        if at - self.base >= min(READ_BYTES, len(self.buffer)):
            self.buffer, self.base = self.buffer[at - self.base :], at

    def _member(self, at: int) -> tuple[bytes, int]:
        """Content of the gzip member at a place, and its end."""
        z, parts, total, i = zlib.decompressobj(31), [], 0, at - self.base
        while True:
            chunk = self.buffer[i : i + READ_BYTES]
            if not chunk:
                if not self._more():
                    raise Damaged("the file ends within a member")
                continue
            try:
                parts.append(z.decompress(chunk))
            except zlib.error as e:
                raise Damaged(f"gzip: {e}") from None
            total += len(parts[-1])
            i += len(chunk) - len(z.unused_data)
            if parts and total >= 8 and len(parts[0]) >= 8 and not parts[0].startswith(b"WARC/1."):
                raise Damaged("no version line in the member")
            if z.eof:
                return b"".join(parts), self.base + i

    def _plain(self, at: int) -> tuple[dict[str, str], bytes, int]:
        while True:
            try:
                headers, block, used = parse_record(self.buffer, at - self.base)
                return headers, block, at + used
            except EOFError:
                if not self._more():
                    raise Damaged("the file ends within a record") from None

    def _one(self, at: int) -> tuple[Record, int]:
        while len(self.buffer) - (at - self.base) < 16 and self._more():
            pass
        start = self.buffer[at - self.base : at - self.base + 10]
        if start.startswith(GZIP):
            data, end = self._member(at)
            try:
                headers, block, used = parse_record(data)
            except EOFError:
                raise Damaged("the member ends within its record") from None
            if used != len(data):
                raise Damaged("bytes after the record in its member")
            return check(headers, block, at), end
        if VERSION.match(start):
            headers, block, end = self._plain(at)
            return check(headers, block, at), end
        raise Damaged("neither a member nor a version line")

    def _next_place(self, at: int) -> int:
        """The next byte that may begin a member or a record; the file's end if none."""
        while True:
            places = [i for i in (self.buffer.find(x, at - self.base) for x in (GZIP, b"WARC/1.")) if i >= 0]
            if places:
                return self.base + min(places)
            at = max(at, self.base + len(self.buffer) - 8)
            self._drop(at)
            if not self._more():
                return self.base + len(self.buffer)

    def __iter__(self) -> Iterator[Record]:
        at, bad, reason = 0, None, ""
        while at < self.size:
            try:
                found, end = self._one(at)
            except Damaged as e:
                if bad is None:
                    bad, reason = at, str(e)
                at = self._next_place(at + 1)
                self._drop(at)
                continue
            if bad is not None:
                self.gaps.append((bad, at, reason))
                bad = None
            yield found
            at = end
            self._drop(at)
        if bad is not None:
            self.gaps.append((bad, self.size, reason))


READ = "path string, offset long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"
GAPS = "path string, gap_begin long, gap_end long, reason string"


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 10_000)))


def _salvaged(path: str):
    fs, where = open_uri(path)
    with fs.open_input_stream(where, compression=None) as file:
        yield from (s := Salvage(file, fs.get_file_info(where).size))
        yield s.gaps


def read_archives(spark: SparkSession, paths: list[str], payloads: bool = True) -> DataFrame:
    """All good records of the files (payload text of responses, if wanted)."""
    if not paths:
        return spark.createDataFrame([], READ)

    def read(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, size = [], 0
                for r in _salvaged(path):
                    if isinstance(r, Record):
                        text = r.payload.decode("utf-8", "replace") if payloads and r.payload is not None else None
                        rows.append((path, r.offset, r.page_id, r.url, r.payload_bytes, r.digest, r.kind, r.refers_to, text))
                        size += len(text or "") + 200
                    if rows and (size > 4 << 20 or not isinstance(r, Record)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _schema(READ))], schema=_schema(READ))
                        rows, size = [], 0

    return _files(spark, paths).transform(mapped, read, READ)


def quarantined(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The byte gaps that the salvage reader skipped, with the first failed check of each."""
    if not paths:
        return spark.createDataFrame([], GAPS)

    def read(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                *_, gaps = _salvaged(path)
                if gaps:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*((path, *g) for g in gaps)), _schema(GAPS))], schema=_schema(GAPS))

    return _files(spark, paths).transform(mapped, read, GAPS)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch_path(spark, "warc"), least_bytes=0)
    return read_archives(spark, paths, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) b, sha1(coalesce(html, '')) h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) lead FROM p)
SELECT page_id, CAST(octet_length(b) AS BIGINT) payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS BIGINT) + 1, 1)), '') payload_digest,
       CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END record_type, CASE WHEN page_id <> lead THEN lead END refers_to
FROM f
"""
