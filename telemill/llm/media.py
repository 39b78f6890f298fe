"""Media columns: content-addressed payloads in tar shards.

A payload (the UTF-8 text, padded with bytes 255 to whole rows) is stored as an 8-bit grey PNG image of ROW samples a
row, in a tar shard, under the SHA-256 of the payload. Each task writes one shard and stores equal payloads once; equal
payloads of several tasks get one address (the least), which is the one that rows carry: digest, shard, offset, length.
Payloads are never shuffled. Metadata columns are filled by reading the first HEADER bytes of each object only.

A task writes to a name of its own, so that repeated and speculative attempts don't meet; the index of addresses is
written before it is used, so that what it names exists whichever executors are lost.

Edge cases: null and empty texts are one row of bytes 255; repeated rows and equal texts share an object; an empty
table gives an empty index; texts of any length are stored whole; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
from collections.abc import Iterator
from zlib import compress, crc32, decompress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.files import locate, make_folder
from telemill.plans.lineage import drop_written, new_path, sized_join, written

ROW = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and the image header chunk.
HEADER = 33
LEVEL = 7
#: Bytes of objects that one task reads.
TASK = 64 << 20


def payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b"\xff" * (-len(data) % ROW if data else ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", crc32(kind + data))


def encode(data: bytes, width: int = ROW) -> bytes:
    """A PNG whose samples are these bytes."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def header(start: bytes) -> dict[str, int]:
    """Width, height and bit depth from the first HEADER bytes."""
    if start[:8] != SIGNATURE or start[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    width, height, depth = struct.unpack(">IIB", start[16:25])
    return {"width": width, "height": height, "depth": depth}


def decode(image: bytes) -> np.ndarray:
    """The samples of an image written by encode()."""
    size, at, data = header(image[:HEADER]), HEADER, b""
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        if kind == b"IDAT":
            data += image[at + 8 : at + 8 + n]
        at += n + 12
    lines = np.frombuffer(decompress(data), np.uint8).reshape(size["height"], size["width"] + 1)
    if lines[:, 0].any():
        raise ValueError("row filters are not used here")
    return lines[:, 1:]


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, digest, shard, offset, length of each row's payload, stored."""
    folder = new_path(docs.sparkSession, "media")
    make_folder(folder)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at, own, out = f"{folder}/{uuid.uuid4().hex}.tar", 0, {}, None
        for b in batches:
            rows = []
            for x in b.column(1):
                data = payload(x.as_py())
                digest = hashlib.sha256(data).digest()
                if digest not in own:
                    if out is None:
                        disk, inner = locate(shard)
                        out = disk.open_output_stream(inner)
                    image = encode(data)
                    info = tarfile.TarInfo(f"{digest.hex()}.png")
                    info.size = len(image)
                    out.write(info.tobuf(tarfile.USTAR_FORMAT) + image + b"\0" * (-len(image) % 512))
                    own[digest] = (at + 512, len(image))
                    at += 512 + len(image) + -len(image) % 512
                rows.append((digest, shard, *own[digest]))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.string(), pa.int64(), pa.int64()), strict=True)]], [key, "digest", "shard", "offset", "length"])
        if out is not None:
            out.write(b"\0" * 1024)
            out.close()

    index = written(docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, digest binary, shard string, offset long, length long"), "media-index")
    # written, so that the join's two sides are nothing but shuffles, which are split where one digest has very many rows
    objects = written(index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*"), "media-objects")
    rows = written(sized_join(index.select(key, "digest"), objects, "digest").select(key, F.lower(F.hex("digest")).alias("digest"), "shard", "offset", "length"), "media-rows")
    drop_written(index)
    drop_written(objects)
    return rows


def read(objects: DataFrame, schema: str, use, whole: bool) -> DataFrame:
    """use(bytes) for each row of objects (digest, shard, offset, length), as digest and the columns of schema.

    whole: read objects, not only their first HEADER bytes. Objects are read in the order in which they are stored.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, opened = None, None
        for b in batches:
            rows = []
            for digest, shard, offset, length in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if shard != name:
                    disk, inner = locate(shard)
                    name, opened = shard, disk.open_input_file(inner)
                rows.append({"digest": digest} | use(opened.read_at(length if whole else HEADER, offset)))
            yield from pa.Table.from_pylist(rows, pa.schema([("digest", pa.binary()), *[(n, pa.string() if " string" in x else pa.int64()) for n, x in zip(names, schema.split(", "), strict=True)]])).to_batches()

    objects = objects.select(F.unhex("digest").alias("digest"), "shard", "offset", "length").distinct()  # half as many bytes to shuffle
    # addresses are few bytes, what they name isn't: tasks are made by the latter
    tasks = max(4 * objects.sparkSession.sparkContext.defaultParallelism, (objects.agg(F.sum("length")).first()[0] or 0) // TASK)
    objects = objects.repartitionByRange(tasks, "shard", "offset").sortWithinPartitions("shard", "offset")
    return objects.mapInArrow(run, "digest binary, " + schema)


def _with(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (digest in hexadecimal) with the columns of found (digest in bytes, as which both are shuffled)."""
    both = sized_join(rows.withColumn("digest", F.unhex("digest")), written(found, "media-columns"), "digest")
    return both.withColumn("digest", F.lower(F.hex("digest")))


def with_metadata(rows: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """rows (digest, shard, offset, length) with width, height and depth, from header-only range reads.

    objects: where the addresses are taken from, if rows has columns that needn't be made anew for them.
    """
    return _with(rows, read(rows if objects is None else objects, "width long, height long, depth long", header, False))


def described(image: bytes) -> dict:
    """What a stored object holds: digests, and a feature text of size, mean, contrast and a histogram of 16 bins."""
    samples = decode(image)
    data = samples.tobytes()
    bins = np.bincount(samples.ravel() >> 4, minlength=16)
    mean, spread = int(samples.mean() * 1000), int(samples.std() * 1000)
    return {
        "n_bytes": len(data.rstrip(b"\xff")), "payload_bytes": len(data), "payload_sha256": hashlib.sha256(data).hexdigest(), "tail_crc32": crc32(data[-32:]), "media_bytes": len(image),
        "media_sha256": hashlib.sha256(image).hexdigest(), "feature": f"{samples.shape[1]}x{samples.shape[0]} mean {mean} spread {spread} bins {','.join(map(str, bins))}",
    }


def with_features(rows: DataFrame) -> DataFrame:
    """rows with the columns of described(), from the stored bytes."""
    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _with(rows, read(rows, schema, described, True))
