"""Capture folders as a data source, `telemetry`: NDJSON files of observations, numbered in the order of their names.

    register(spark); spark.read.format("telemetry").load(folder), and spark.readStream likewise

Files appear whole, each with a name behind those before it (writers number them, or name them by time). An observation's
obs_seq is its file's number and its line's, so that it is the same whenever and however the folder is read; the offset of
a stream is the number and name of the last file taken. Filters on source and kind are tried before a line's fields are
made. Lines that aren't observations are left out, as readers.observations does.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "host string, source string, kind string, obs_seq long, t long, pid long, payload string"
#: Lines that a file may have.
LINES = 1 << 32
BATCH = 10_000


def _located(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"(file:)?/", path):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def _files(folder: str) -> list[str]:
    store, inner = _located(folder)
    found = store.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file and not f.base_name.startswith((".", "_")))


@dataclass
class File(InputPartition):
    name: str
    number: int


def _rows(folder: str, file: File, only: dict[str, set]) -> Iterator[pa.RecordBatch]:
    store, inner = _located(folder)
    columns = [f.split()[0] for f in SCHEMA.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64()}[f.split()[1]] for f in SCHEMA.split(", ")]
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        values = list(zip(*rows, strict=True)) or [()] * len(columns)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], columns)

    with store.open_input_stream(f"{inner.rstrip('/')}/{file.name}") as stream:
        for n, line in enumerate(_lines(stream)):
            try:
                o = json.loads(line)
                at, source, payload = o["timestamp"], o["source"], o.get("payload")
                mono, anchor = int(at["mono_ns"]), int(at.get("wall_anchor_ns") or 0)
            except (ValueError, TypeError, KeyError):
                continue
            kind = payload.get("kind") if isinstance(payload, dict) else None
            if source is None or "source" in only and source not in only["source"] or "kind" in only and kind not in only["kind"]:
                continue
            pid = o.get("pid") if isinstance(o.get("pid"), int) else None
            rows.append((o.get("host"), source, kind if isinstance(kind, str) else None, file.number * LINES + n, mono + anchor, pid, json.dumps(payload)))
            if len(rows) >= BATCH:
                yield batch()
                rows.clear()
    if rows:
        yield batch()


def _lines(stream) -> Iterator[bytes]:
    """The lines of a stream, read by pieces."""
    rest = b""
    while piece := stream.read(1 << 20):
        *whole, rest = (rest + piece).split(b"\n")
        yield from whole
    if rest:
        yield rest


class Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.only = folder, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute in (("source",), ("kind",)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.only[name] = self.only.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [File(name, i) for i, name in enumerate(_files(self.folder))]

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        return _rows(self.folder, partition, self.only) if partition is not None else iter(())


class StreamReader(DataSourceStreamReader):
    """most: files that one micro-batch takes."""

    def __init__(self, folder: str, most: int):
        self.folder, self.most, self.at = folder, most, None

    def initialOffset(self) -> dict:
        return {"number": 0, "last": ""}

    def latestOffset(self) -> dict:
        """Behind the offset given out last, or behind the one a restart goes on from."""
        names = _files(self.folder)
        done = self.at["number"] if self.at else 0
        to = min(len(names), done + self.most) if self.at else min(len(names), self.most)
        return {"number": to, "last": names[to - 1]} if to else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        names = _files(self.folder)
        if end["number"] and names[end["number"] - 1] != end["last"]:
            raise ValueError(f"{self.folder}: a file came before {end['last']!r} by name, or one was removed")
        self.at = end
        return [File(names[i], i) for i in range(start["number"], end["number"])]

    def commit(self, end: dict) -> None:
        self.at = end

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        return _rows(self.folder, partition, {})


class Telemetry(DataSource):
    """Options: path, and for streams maxFilesPerTrigger (1000)."""

    @classmethod
    def name(cls) -> str:
        return "telemetry"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"])

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options["path"], int(self.options.get("maxFilesPerTrigger", "1000")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Telemetry)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
