"""WARC archives as a PySpark data source.

spark.read.format("warc").schema(...).load(path) reads a folder of archives (*.warc.gz, *.warc) or one archive, and plans
a partition for each file. Archives written here are split further: a gzip member's header says how long the member is (an
extra field, as in other archive formats), so that records which a predicate rules out are passed over without being
inflated beyond their header block; in plain archives their Content-Length does. Other gzip files are inflated through,
without keeping what isn't wanted. Filters on record_type and any header column are pushed down; headers are read first,
in large blocks, and a payload only if the record passes and the requested schema has it, or what is made from it.

df.write.format("warc").mode("append").save(folder) writes a member for each row; a task writes to a file of its own,
and the folder's manifest, written when all tasks have ended, names the files that count: what failed or repeated
attempts left is not read.

Columns: see FIELDS. The payload is the HTTP body of response records, none of revisits, and else the whole block. Rows to
write need page_id, url, record_type, payload, payload_digest, payload_bytes, refers_to; page_id and refers_to are null in
archives from elsewhere, whose record_id and refers_to_id say the same.

Edge cases: null payloads are empty ones; empty tables give a folder without archives, which reads as no rows; a folder
without manifest and archives, or what isn't a WARC record, is an error; payloads of any length are written whole and
records of equal pages each; URLs come back as they were, line breaks included; header names may be in any case.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from telemill.llm.files import locate, make_folder
from telemill.plans.lineage import new_path, sized_join, written

FIELDS = "page_id long, url string, record_type string, record_id string, date string, payload_digest string, declared_bytes long, refers_to long, refers_to_id string, payload binary, payload_bytes long, actual_digest string"
_LONG = {"page_id", "declared_bytes", "refers_to", "payload_bytes"}
#: Columns that need the payload; the others are in headers.
DECODED = {"payload", "payload_bytes", "actual_digest"}
#: Bytes of one partition of a file, and of one read.
SPLIT, BLOCK = 64 << 20, 1 << 20
_EXTRA = b"sl"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field holds its own length."""
    body = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = body.compress(data) + body.flush()
    total = 12 + 8 + len(packed) + 8
    extra = _EXTRA + (4).to_bytes(2, "little") + total.to_bytes(4, "little")
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + len(extra).to_bytes(2, "little") + extra
    return head + packed + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


def record(page_id: int | None, url: str | None, kind: str, payload: bytes, payload_digest: str, payload_bytes: int, refers_to: int | None) -> bytes:
    """A response or revisit record; a revisit's block is the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_bytes
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{payload_digest}", f"X-Payload-Length: {payload_bytes}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
        if re.search(r"[\r\n]|^\s|\s$", url):
            head.append("X-Target-URI: " + json.dumps(url))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(block: bytes) -> dict[str, str]:
    """A record's named fields, their names in small letters."""
    first, *lines = block.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    found: dict[str, str] = {}
    name = None
    for line in lines:
        if name and line[:1] in (" ", "\t"):  # goes on with the field before
            found[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def columns(found: dict[str, str]) -> dict[str, object]:
    """The header columns of a record's fields."""
    page = lambda x: int(m[1]) if x and (m := re.fullmatch(r"<urn:page:(-?\d+)>", x)) else None
    url = found.get("warc-target-uri")
    if "x-target-uri" in found:
        url = json.loads(found["x-target-uri"])
    elif url and re.fullmatch("<.*>", url):  # as older archives write it
        url = url[1:-1]
    return {
        "page_id": page(found.get("warc-record-id")), "url": url, "record_type": found.get("warc-type"), "record_id": found.get("warc-record-id"), "date": found.get("warc-date"),
        "payload_digest": re.sub("(?i)^sha1:", "", found["warc-payload-digest"]) if "warc-payload-digest" in found else None, "declared_bytes": int(found["x-payload-length"]) if "x-payload-length" in found else None,
        "refers_to": page(found.get("warc-refers-to")), "refers_to_id": found.get("warc-refers-to"),
    }


class Ahead:
    """A file, read in blocks."""

    def __init__(self, file, at: int = 0):
        self.file, self.size, self.start, self.held = file, file.size(), at, b""

    def at(self, at: int, n: int) -> bytes:
        """Up to n bytes from a place on."""
        if not (self.start <= at and at + n <= self.start + len(self.held)):
            self.start, self.held = at, self.file.read_at(max(n, BLOCK), at) if at < self.size else b""
        return self.held[at - self.start : at - self.start + n]


class Plain:
    """The bytes of an archive that isn't compressed."""

    def __init__(self, file: Ahead, at: int):
        self.file, self.place = file, at

    def take(self, n: int) -> bytes:
        data = self.file.at(self.place, n)
        self.place += len(data)
        return data

    def leave(self, n: int) -> None:
        self.place += n


class Inflated:
    """The inflated bytes of successive gzip members. place: where the next member begins, once one is read through."""

    def __init__(self, file: Ahead, at: int):
        self.file, self.place, self.inflate = file, at, None

    def _open(self) -> None:
        head = self.file.at(self.place, 20)
        self.end = self.place + int.from_bytes(head[16:20], "little") if len(head) == 20 and head[3] & 4 and head[12:14] == _EXTRA else None
        self.inflate, self.made = zlib.decompressobj(31), 0

    def take(self, n: int) -> bytes:
        """Up to n bytes, none at the end of the file."""
        while True:
            if self.inflate is None:
                if self.place >= self.file.size:
                    return b""
                self._open()
            given = self.file.at(self.place, min(max(n // 4, 4096), BLOCK))
            data = self.inflate.decompress(given, n)
            self.place += len(given) - len(self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail)
            self.made += len(data)
            if self.inflate.eof:
                self.inflate = None
            elif not given:
                raise ValueError("the archive ends within a gzip member")
            if data:
                return data

    def leave(self, n: int) -> None:
        """Pass over n bytes: by a jump, if the member's length is known and it holds no more than them.

        How much it holds, modulo 4 GiB, is what its last four bytes say. Up to four bytes more, the line ends behind a
        record, are passed over as well.
        """
        if self.inflate is not None and self.end is not None:
            size = self.file.at(self.end - 4, 4)
            if len(size) == 4 and (int.from_bytes(size, "little") - self.made - n) % (1 << 32) <= 4:
                self.place, self.inflate = self.end, None
                return
        while n > 0 and (data := self.take(min(n, BLOCK))):
            n -= len(data)


def blocks(stream: Plain | Inflated, end: int, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """The fields of each record that begins before end, and its block if wanted(fields)."""
    text = b""
    while True:
        text = text.lstrip(b"\r\n")
        while b"\r\n\r\n" not in text:
            if not text and stream.place >= end and getattr(stream, "inflate", None) is None:
                return
            more = stream.take(4096)
            if not more:
                if text.strip():
                    raise ValueError("the archive ends within a record's header")
                return
            text = (text + more).lstrip(b"\r\n")
        head, _, text = text.partition(b"\r\n\r\n")
        found = fields(head)
        n = int(found.get("content-length", 0))
        if wanted(found):
            parts, have = [text], len(text)
            while have < n:
                more = stream.take(n + 4 - have)
                if not more:
                    raise ValueError("the archive ends within a record")
                parts.append(more)
                have += len(more)
            text = b"".join(parts)
            yield found, text[:n]
            text = text[n:]
        else:
            yield found, None
            if len(text) < n:
                stream.leave(n - len(text))
                text = b""
            else:
                text = text[n:]


@dataclass
class Span(InputPartition):
    path: str
    start: int
    end: int


class WarcReader(DataSourceReader):
    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names, self.equal = folder, names, []

    def pushFilters(self, filters: list[Filter]):
        own = set(x.split()[0] for x in FIELDS.split(", ")) - DECODED
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in own:
                self.equal.append((f.attribute[0], {f.value}))
            elif isinstance(f, In) and len(f.attribute) == 1 and f.attribute[0] in own:
                self.equal.append((f.attribute[0], set(f.value)))
            else:
                yield f

    def partitions(self) -> list[Span]:
        disk, inner = locate(f"{self.folder}/manifest.json")
        if disk.get_file_info(inner).type != fs.FileType.NotFound:
            with disk.open_input_stream(inner) as f:
                files = json.loads(f.read())
            return [Span(f"{self.folder}/{x['name']}", a, b) for x in files for a, b in zip(x["cuts"], [*x["cuts"][1:], x["bytes"]], strict=True)]
        disk, inner = locate(self.folder)
        if disk.get_file_info(inner).type == fs.FileType.File:
            return [Span(self.folder, 0, disk.get_file_info(inner).size)]
        found = disk.get_file_info(fs.FileSelector(inner, allow_not_found=True, recursive=True))
        root = inner.rstrip("/")
        out = [Span(self.folder.rstrip("/") + x.path.removeprefix(root), 0, x.size) for x in sorted(found, key=lambda x: x.path) if x.path.endswith((".warc", ".warc.gz"))]
        if not out:
            raise FileNotFoundError(f"{self.folder} holds no manifest and no archives (*.warc, *.warc.gz)")
        return out

    def read(self, span: Span | None) -> Iterator[pa.RecordBatch]:
        if span is None:  # there are no archives
            return
        disk, inner = locate(span.path)
        decode = bool(set(self.names) & DECODED)
        schema = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n in _LONG else pa.string()) for n in self.names])
        rows, held = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        fits = lambda found: all(columns(found)[k] in v for k, v in self.equal)
        with disk.open_input_file(inner) as f:
            file = Ahead(f, span.start)
            packed = file.at(span.start, 2) == b"\x1f\x8b"
            for found, block in blocks((Inflated if packed else Plain)(file, span.start), span.end, (lambda x: decode and fits(x))):
                if block is None and not fits(found):
                    continue
                row = columns(found)
                if decode:
                    row |= contents(row, found, block)
                    held += len(block)
                rows.append(tuple(row[n] for n in self.names))
                if held > 8 << 20 or len(rows) >= 5000:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


def contents(row: dict, found: dict[str, str], block: bytes) -> dict[str, object]:
    """The columns made from a record's block; a revisit's are those that its header declares."""
    if row["record_type"] == "revisit":
        return {"payload": None, "payload_bytes": row["declared_bytes"], "actual_digest": row["payload_digest"]}
    http = row["record_type"] in ("response", "request") and found.get("content-type", "").lower().startswith("application/http")
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    return {"payload": payload, "payload_bytes": len(payload), "actual_digest": digest(payload)}


@dataclass
class Written(WriterCommitMessage):
    file: dict | None


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        out, at, cuts, name = None, 0, [0], f"{uuid.uuid4().hex}.warc.gz"
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    disk, inner = locate(f"{self.folder}/{name}")
                    out = disk.open_output_stream(inner, compression=None)
                data = member(record(r["page_id"], r["url"], r["record_type"], r["payload"] or b"", r["payload_digest"], r["payload_bytes"], r["refers_to"]))
                if at - cuts[-1] > SPLIT:
                    cuts.append(at)
                out.write(data)
                at += len(data)
        if out is None:
            return Written(None)
        out.close()
        return Written({"name": name, "bytes": at, "cuts": cuts})

    def commit(self, messages: list[Written | None]) -> None:
        disk, inner = locate(f"{self.folder}/manifest.json")
        files = []
        if disk.get_file_info(inner).type != fs.FileType.NotFound:
            with disk.open_input_stream(inner) as f:
                files = json.loads(f.read())
        with disk.open_output_stream(inner) as f:
            f.write(json.dumps(files + [m.file for m in messages if m is not None and m.file]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and m.file:
                disk, inner = locate(f"{self.folder}/{m.file['name']}")
                disk.delete_file(inner)


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], schema.names)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        make_folder(self.options["path"])
        return WarcWriter(self.options["path"])


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Rows to write: of pages with equal payloads of at least least_bytes, the smallest page_id is response, others
    revisit it. Payloads are told apart by SHA-256 in one pass over them, which keeps digests only; who revisits whom
    is found among these and joined back by page (by the page's id and a cheap hash, as rows may share an id)."""
    made = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    made = made.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "__row": F.xxhash64("payload")})
    digests = written(made.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "__row", F.unhex(F.sha2("payload", 256)).alias("__sha")), "digests")
    groups = digests.groupBy("__sha").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("__last")).where("refers_to < __last").drop("__last")
    again = sized_join(digests, written(groups, "repeated"), "__sha").where("page_id > refers_to").select("page_id", "__row", "refers_to").distinct()
    made = sized_join(made, written(again, "revisits"), ["page_id", "__row"], "left")
    revisit = F.col("refers_to").isNotNull()
    return made.select("page_id", "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(~revisit, F.col("payload")).alias("payload"), _base32(F.upper(F.sha1("payload"))).alias("payload_digest"), "payload_bytes", "refers_to")


def _base32(hexed):
    """The base32 text of 40 hexadecimal digits: four blocks of ten digits give eight letters each."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for block in range(4):
        number = F.conv(F.substring(hexed, 10 * block + 1, 10), 16, 10).cast("long")
        out += [F.substring(letters, (F.shiftright(number, 5 * (7 - i)).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for i in range(8)]
    return F.concat(*out)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


def archive(pages: DataFrame, least_bytes: int = 0) -> str:
    """Write pages (page_id, url, html) as WARC archives to a new shared folder; gives the folder."""
    spark = pages.sparkSession
    register(spark)
    folder = new_path(spark, "warc")
    records(pages, least_bytes).write.format("warc").mode("append").save(folder)
    return folder


def read(spark, folder: str, schema: str = FIELDS) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(schema).load(folder)


_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, {at}, 10))::bigint >> {shift}) & 31) + 1)::int, 1)"
#: The rows of all pages: digests in base32 by blocks of ten hexadecimal digits.
ORACLE = f"""
with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as h from pages), f as (select body, min(page_id) as first from p group by 1)
select page_id, strlen(body)::bigint as payload_bytes, concat({", ".join(_LETTER.format(at=10 * block + 1, shift=5 * (7 - i)) for block in range(4) for i in range(8))}) as payload_digest,
  case when page_id > first then 'revisit' else 'response' end as record_type, case when page_id > first then first end as refers_to from p join f using (body)
"""
