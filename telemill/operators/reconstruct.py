"""From observations of a machine to its canonical events of all eight kinds, each with the process behind it.

Observations (readers.observations, with obs_seq, their order of arrival) are routed to the stages of operators.lifecycle;
what these find is one table of events. emit_seq is the observation at whose arrival an event is known, nth its number
among those that are known then, by kind and key. Connections and DNS queries get the process and its ancestors as known
when they came out (operators.enrich). streaming.reconstruct gives the same rows on a stream.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.scalars import process_key, socket_key
from telemill.operators import enrich, lifecycle
from telemill.operators.ticks import GAP

#: Fields of all payloads, as observations have them.
PAYLOAD = (
    "kind string, start_unix_secs long, ppid long, uid long, comm string, name string, exec_path string, proto string, local_addr string, foreign_addr string, state string, rxbytes long, txbytes long, "
    "process_name string, qname string, qtype string, name_hash string, interface_index int, client_process_name string, masked boolean, path string, flags array<string>, event_id long, "
    "from struct<pid:long,bundle_id:string,name:string,exec_path:string>, to struct<pid:long,bundle_id:string,name:string,exec_path:string>"
)
#: Columns of events behind emit_seq, nth, kind, t and pid.
FIELDS = {
    "start": "long", "ppid": "long", "uid": "long", "comm": "string", "name": "string", "exec_path": "string", "proto": "string", "local_addr": "string", "foreign_addr": "string", "state": "string",
    "process_name": "string", "rx": "long", "tx": "long", "first_seen": "long", "last_seen": "long", "duration_ns": "long", "path": "string", "flags": "array<string>", "event_ids": "array<long>", "count": "long",
    "qname": "string", "qtype": "string", "masked": "boolean", "name_hash": "string", "interface_index": "int", "client": "string", "from_bundle": "string", "from_name": "string", "to_bundle": "string", "to_name": "string", "to_exec_path": "string",
}
ATTRS = ("comm", "name", "exec_path", "uid")
PROCESS = "struct<pid:bigint,start:bigint,alive:boolean,comm:string,name:string,exec_path:string,uid:bigint>"
ANCESTORS = "array<struct<pid:bigint,start:bigint,comm:string,name:string,exec_path:string,uid:bigint>>"


def typed(obs: DataFrame) -> DataFrame:
    """Observations (source, obs_seq, t, pid, payload) with the fields of their payloads; wrong values are null."""
    more = [c for c in ("host",) if c in obs.columns]
    p = obs.select(*more, "source", "obs_seq", "t", "pid", F.from_json("payload", PAYLOAD, {"mode": "PERMISSIVE"}).alias("p"))
    return p.select(
        *more, "source", "obs_seq", "t", "pid", "p.kind", F.col("p.start_unix_secs").alias("start"), *[f"p.{c}" for c in ("ppid", "uid", "comm", "name", "exec_path", "proto", "local_addr", "foreign_addr", "state", "process_name")],
        F.col("p.rxbytes").alias("rx"), F.col("p.txbytes").alias("tx"), *[f"p.{c}" for c in ("qname", "qtype", "name_hash", "interface_index")], F.col("p.client_process_name").alias("client"), *[f"p.{c}" for c in ("masked", "path", "flags", "event_id")],
        F.col("p.from.bundle_id").alias("from_bundle"), F.col("p.from.name").alias("from_name"), F.col("p.to.bundle_id").alias("to_bundle"), F.col("p.to.name").alias("to_name"), F.col("p.to.exec_path").alias("to_exec_path"), F.col("p.to.pid").alias("to_pid"),
    )


def _shaped(frame: DataFrame, key) -> DataFrame:
    columns = [(F.col(c) if c in frame.columns else F.lit(None)).cast(k).alias(c) for c, k in FIELDS.items()]
    return frame.select("emit_seq", "kind", F.col("t").cast("long").alias("t"), F.col("pid").cast("long").alias("pid"), *columns, key.alias("__key"))


def events(obs: DataFrame, gap_ns: int = GAP, window_ns: int = lifecycle.WINDOW, flush_tail: bool = False) -> DataFrame:
    """emit_seq, nth, kind, t, pid and FIELDS of all events of typed observations of one machine."""
    o = lifecycle.route(obs)
    of = lambda stage: o.where(F.col("stage") == stage).drop("stage")
    born = lifecycle.process_events(of("process"), ["ppid", "uid", "comm", "name", "exec_path"], gap_ns, flush_tail)
    open_ = lifecycle.connection_events(of("connection"), attrs=["pid", "state", "process_name", "rx", "tx"], gap_ns=gap_ns, flush_tail=flush_tail)
    files = lifecycle.file_events(of("file"), window_ns, flush_tail).withColumns({"kind": F.lit("file_changed"), "pid": F.lit(None).cast("long")})
    focus = lifecycle.focus_events(of("focus").drop("kind", "name", "exec_path")).withColumns({"kind": F.lit("app_focus"), "emit_seq": F.col("obs_seq")})
    focus = focus.select("kind", "emit_seq", "t", "pid", "from_bundle", "from_name", "to_bundle", "to_name", "to_exec_path")
    dns = lifecycle.dns_events(of("dns")).withColumn("emit_seq", F.col("obs_seq")).select("kind", "emit_seq", "t", "pid", "qname", "qtype", "masked", "name_hash", "interface_index", "client")
    none = F.lit("")
    parts = [_shaped(born, process_key("pid", "start")), _shaped(open_, socket_key("proto", "local_addr", "foreign_addr")), _shaped(files, F.col("path")), _shaped(focus, none), _shaped(dns, none)]
    nth = F.row_number().over(Window.partitionBy("emit_seq").orderBy("kind", "__key"))  # what one tick or window brings out
    out = reduce(DataFrame.union, parts).withColumn("nth", nth)
    return out.select("emit_seq", "nth", "kind", "t", "pid", *FIELDS)


def reconstruct(obs: DataFrame, gap_ns: int = GAP, window_ns: int = lifecycle.WINDOW, flush_tail: bool = False, depth: int = enrich.DEPTH) -> DataFrame:
    """events() of raw observations, with process and ancestors."""
    from telemill.plans.lineage import written

    e = written(events(typed(obs), gap_ns, window_ns, flush_tail), "events")
    births, deaths = e.where("kind = 'process_birth'"), e.where("kind = 'process_death'")
    return enrich.enriched(e, births, deaths, "emit_seq", ATTRS, depth)
