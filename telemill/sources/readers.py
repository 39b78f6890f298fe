"""NDJSON observations and events, resolver logs, socket tables, graph files; batch, and as streams where files arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.functions.scalars import dns_fields, unix_ns

OBSERVATION = "timestamp struct<mono_ns:long,wall_anchor_ns:long>, source string, pid long, payload string, tags string"
EVENT = "schema_version int, timestamp struct<mono_ns:long,wall_anchor_ns:long>, kind string, pid long, payload string"
KINDS = ("process_birth", "process_death", "app_focus", "connection_opened", "connection_closed", "connection_completed", "file_changed", "dns_query")
# The payload's fields by kind of observation.
PAYLOADS = {
    "process": "ppid long, uid long, gid long, pgid long, comm string, name string, exec_path string, start_unix_secs long, status long, nfiles long",
    "socket": "proto string, local_addr string, foreign_addr string, state string, rxbytes long, txbytes long, process_name string",
    "dns": "kind string, qname string, qtype string, name_hash string, interface_index int, client_process_name string, masked boolean",
    "file": "path string, flags array<string>, event_id long",
    "window": "transition string, from struct<pid:long,bundle_id:string,name:string,exec_path:string>, to struct<pid:long,bundle_id:string,name:string,exec_path:string>",
    "system": "ncpu long, memsize long, model string, ostype string, osrelease string, osversion string, loadavg_1m double, loadavg_5m double, loadavg_15m double",
}
OPTIONS = {"mode": "PERMISSIVE"}


def _lines(spark: SparkSession, path: str, stream: bool) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.text(path).where(F.length(F.trim("value")) > 0)


def observations(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Rows of NDJSON observations; lines that aren't are skipped."""
    o = _lines(spark, path, stream).select(F.from_json("value", OBSERVATION, OPTIONS).alias("o")).where("o.source is not null and o.timestamp is not null").select("o.*")
    return o.withColumn("t", unix_ns("timestamp.mono_ns", "timestamp.wall_anchor_ns"))


def events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Rows of NDJSON events; other lines are skipped. A missing schema version is 1."""
    e = _lines(spark, path, stream).select(F.from_json("value", EVENT, OPTIONS).alias("e")).where(F.col("e.kind").isin(*KINDS) & F.col("e.timestamp").isNotNull()).select("e.*")
    return e.withColumns({"schema_version": F.coalesce("schema_version", F.lit(1)), "t": unix_ns("timestamp.mono_ns", "timestamp.wall_anchor_ns")})


def mixed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Observations (lines with a source), events (else with a kind), and counts of all lines by what they are."""
    lines = _lines(spark, path, False)
    what = F.when(F.get_json_object("value", "$.source").isNotNull(), "observation").when(F.get_json_object("value", "$.kind").isNotNull(), "event").otherwise("skipped")
    return observations(spark, path), events(spark, path), lines.groupBy(what.alias("what")).count()


def payload(frame: DataFrame, kind: str) -> DataFrame:
    """frame with the typed fields of its payload; values of the wrong kind are null."""
    return frame.withColumn("__p", F.from_json("payload", PAYLOADS[kind], OPTIONS)).select("*", "__p.*").drop("__p")


def endpoint_security(spark: SparkSession, path: str) -> DataFrame:
    """Raw endpoint-security records as observations, the pid taken from their audit token."""
    pid = F.get_json_object("value", "$.process.audit_token.pid").try_cast("long")
    return _lines(spark, path, False).where(F.get_json_object("value", "$.event").isNotNull()).select(F.lit("process").alias("source"), pid.alias("pid"), F.col("value").alias("payload"))


def dns_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Query-start messages of a resolver's NDJSON log as DNS observations."""
    m = _lines(spark, path, stream).select(F.get_json_object("value", "$.eventMessage").alias("message")).where(F.col("message").contains("DNSServiceQueryRecord START"))
    f = dns_fields("message")
    out = m.select(F.lit("network").alias("source"), F.lit("dns_query").alias("kind"), *[c.alias(k) for k, c in f.items()])
    return out.where("qname is not null and qtype is not null and interface_index is not null and pid is not null")


def netstat(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows of a socket table in text: proto, local_addr, foreign_addr, state, rxbytes, txbytes, process_name, pid.

    A process is the last `name:pid` left of the eight trailing columns; words before it that aren't numbers belong to
    its name. Lines before the header and other protocols than TCP and UDP give no row.
    """
    names = ["proto", "local_addr", "foreign_addr", "state", "rxbytes", "txbytes", "process_name", "pid"]

    def parse(line: str | None) -> tuple | None:
        w = (line or "").split()
        if len(w) < 14 or not w[0].startswith(("tcp", "udp")):
            return None
        named = [i for i in range(len(w) - 8) if w[i].rpartition(":")[0] and w[i].rpartition(":")[2].isdecimal() and w[i].rpartition(":")[2].isascii()]
        if not named:
            return None
        first = last = named[-1]
        while first > 0 and not (w[first - 1].isascii() and w[first - 1].isdecimal()):
            first -= 1
        if first < 4:
            return None
        name, _, pid = w[last].rpartition(":")
        number = lambda x: int(x) if x.isascii() and x.isdecimal() else None
        rx = first - 4
        return w[0], w[3], w[4], w[5] if rx == 6 else None, number(w[rx]), number(w[rx + 1]), " ".join([*w[first:last], name]), int(pid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.string(), pa.int64()]
        for b in batches:
            rows = [r for r in map(parse, b.column(0).to_pylist()) if r]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 8, types, strict=True)], names)

    return lines.select(column).mapInArrow(run, "proto string, local_addr string, foreign_addr string, state string, rxbytes long, txbytes long, process_name string, pid long")


def graph_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The parts of a graph file: processes, apps, sockets, files, domains (none in old files), edges."""
    g = spark.read.option("multiLine", True).json(path)
    parts = ("processes", "apps", "sockets", "files", "domains", "edges")
    return {p: g.select(F.explode(p).alias("x")).select("x.*") for p in parts if p in g.columns and not g.schema[p].dataType.simpleString().startswith("array<string")}


def write_ndjson(frame: DataFrame, path: str, kinds: list[str] | None = None) -> None:
    """Write events as NDJSON, of some kinds only; this filter stays above what made them."""
    (frame.where(F.col("kind").isin(kinds)) if kinds else frame).write.mode("append").json(path)


def bus_stats(frame: DataFrame) -> DataFrame:
    """source, sent, dropped: nothing is dropped, as sources wait for the engine."""
    return frame.groupBy("source").agg(F.count(F.lit(1)).alias("sent"), F.lit(0).cast("long").alias("dropped"))
