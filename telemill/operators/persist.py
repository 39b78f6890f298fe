"""Between the entity graph and the store: nodes and edges as rows with times, and typed nodes and edges back from rows.

A graph is a dict of frames: processes (pid, start, comm, name, exec_path, ppid, uid, birth, death), apps (id, name,
exec_path, intervals), sockets (proto, local_addr, foreign_addr, state, process_name, pid_at_open, opened, closed, rx,
tx), files (path, flags, first_seen, last_seen, touch_count), domains (name, qtypes, masked, first_seen, last_seen,
query_count), and edges by kind: parent_of (parent_id, child_id), frontmost_during (app, process_id, from, to),
opened_socket (process_id, socket_id), queried_domain (process_id, domain, count). Parts that are missing are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.functions.scalars import process_key, socket_key
from telemill.operators import graph as G

_INTERVALS = "array<struct<from:bigint,to:bigint>>"
#: Columns of the store's node rows behind the key and the times, by kind.
NODE = {
    "process": {"pid": "long", "start": "long", "comm": "string", "name": "string", "exec_path": "string", "ppid": "long", "uid": "long", "death": "long"},
    "app": {"name": "string", "exec_path": "string", "intervals": _INTERVALS},
    "socket": {"state": "string", "process_name": "string", "pid_at_open": "long", "rx": "long", "tx": "long", "proto": "string", "local_addr": "string", "foreign_addr": "string"},
    "file": {"flags": "array<string>", "touch_count": "long"},
    "domain": {"qtypes": "array<string>", "masked": "boolean", "query_count": "long"},
}
ATTRIBUTES = {c: t for columns in NODE.values() for c, t in columns.items()}
#: The same of edge rows.
EDGE = {"overlap_from": "long", "overlap_to": "long", "queries": "long"}
ENDS = {"parent_of": ("process", "process"), "frontmost_during": ("app", "process"), "opened_socket": ("process", "socket"), "queried_domain": ("process", "domain")}


def build(events: DataFrame, per_range: int = G.RANGE) -> dict[str, DataFrame]:
    """The graph of an event history."""
    p = G.process_nodes(events)
    spans = G.app_intervals(events)
    sockets = G.socket_nodes(events)
    parts = F.split("id", r"\|", 3)
    sockets = sockets.withColumns({"proto": parts[0], "local_addr": parts[1]})
    at_open = sockets.select(F.col("pid_at_open").alias("pid"), F.col("opened").alias("t"), F.col("id").alias("socket_id"))
    asked = G.attributed(G.domain_tally(events), p, "first_t")
    names = events.where("kind = 'app_focus'").groupBy(F.col("to_bundle").alias("app")).agg(F.max_by("to_name", "seq").alias("name"))
    apps = spans.groupBy("app").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("intervals")).join(names, "app", "left")
    return {
        "processes": p, "apps": apps.withColumnRenamed("app", "id"), "sockets": sockets, "files": G.file_nodes(events), "domains": G.domain_nodes(events), "parent_of": G.parent_edges(p),
        "frontmost_during": G.frontmost_edges(spans, p, per_range), "opened_socket": G.attributed(at_open, p, "t").select("process_id", "socket_id"), "queried_domain": asked.select("process_id", "domain", "count"),
    }


def _row(frame: DataFrame, kind: str, id_: Column, first: Column, last: Column) -> DataFrame:
    own = NODE[kind]
    attrs = [(F.col(c) if c in own and c in frame.columns else F.lit(None)).cast(t).alias(c) for c, t in ATTRIBUTES.items()]
    return frame.select(F.lit(kind).alias("kind"), id_.alias("id"), first.cast("long").alias("first_seen"), last.cast("long").alias("last_seen"), *attrs)


def node_rows(graph: dict[str, DataFrame]) -> DataFrame:
    """The store's rows of all nodes. A process lasts from birth to death, or is seen at birth only; an app from its first
    interval to the last that has an end (else its beginning; 0 without any); a socket from its opening to its close."""
    c = F.col
    first = F.array_min(F.transform("intervals", lambda i: i["from"]))
    last = F.array_max(F.filter(F.transform("intervals", lambda i: i["to"]), lambda t: t.isNotNull()))
    ends = {
        "processes": ("process", process_key("pid", "start"), c("birth"), F.coalesce("death", "birth")),
        "apps": ("app", c("id"), F.coalesce(first, F.lit(0)), F.coalesce(last, first, F.lit(0))),
        "sockets": ("socket", socket_key("proto", "local_addr", "foreign_addr"), c("opened"), F.coalesce("closed", "opened")),
        "files": ("file", c("path"), c("first_seen"), c("last_seen")),
        "domains": ("domain", c("name"), c("first_seen"), c("last_seen")),
    }
    out = None
    for part, how in ends.items():
        if part in graph:
            rows = _row(graph[part], *how)
            out = rows if out is None else out.union(rows)
    return out


def edge_rows(graph: dict[str, DataFrame], nodes: DataFrame) -> DataFrame:
    """The store's rows of all edges, with seen_at: of parent_of, opened_socket and queried_domain when their target was
    seen last (nodes: merged rows; 0 if it isn't there), of frontmost_during the end of the overlap, else its beginning."""
    c, none = F.col, F.lit(None).cast("long")
    ends = {
        "parent_of": (c("parent_id"), c("child_id"), none, none, none),
        "frontmost_during": (c("app"), c("process_id"), c("from"), c("to"), none),
        "opened_socket": (c("process_id"), c("socket_id"), none, none, none),
        "queried_domain": (c("process_id"), c("domain"), none, none, c("count")),
    }
    out = None
    for kind, (a, b, start, end, queries) in ends.items():
        if kind in graph:
            rows = graph[kind].select(F.lit(kind).alias("kind"), F.lit(ENDS[kind][0]).alias("from_kind"), a.alias("from_id"), F.lit(ENDS[kind][1]).alias("to_kind"), b.alias("to_id"), start.alias("overlap_from"), end.alias("overlap_to"), queries.alias("queries"))
            out = rows if out is None else out.union(rows)
    seen = nodes.select(c("kind").alias("to_kind"), c("id").alias("to_id"), c("last_seen").alias("__last"))
    out = out.join(seen, ["to_kind", "to_id"], "left")
    at = F.when(c("kind") == "frontmost_during", F.coalesce("overlap_to", "overlap_from")).otherwise(F.coalesce("__last", F.lit(0)))
    return out.select("kind", "from_kind", "from_id", "to_kind", "to_id", at.alias("seen_at"), *EDGE)


def process_id(text: Column | str) -> tuple[Column, Column]:
    """pid and start of a process key; what isn't a number is 0."""
    t = F.col(text) if isinstance(text, str) else text
    part = lambda x: F.coalesce(x.try_cast("long"), F.lit(0).cast("long"))
    cut = F.split(t, ":", 2)
    return part(cut[0]), part(F.get(cut, 1))


def load(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The typed graph of stored rows. A socket is closed if it was seen after its opening; missing parts of its id are
    '?'; edges to sockets whose id has no three parts, and edges of unknown kinds, are left out."""
    of = lambda kind: nodes.where(F.col("kind") == kind)
    pid, start = process_id("id")
    q = F.lit("?")
    no_names, zero = F.array().cast("array<string>"), F.lit(0).cast("long")
    to = lambda kind: edges.where(F.col("kind") == kind)
    return {
        "processes": of("process").select(pid.alias("pid"), start.alias("start"), "comm", "name", "exec_path", "ppid", "uid", F.col("first_seen").alias("birth"), "death"),
        "apps": of("app").select("id", "name", "exec_path", F.coalesce("intervals", F.array().cast(_INTERVALS)).alias("intervals")),
        "sockets": of("socket").select(F.coalesce("proto", q).alias("proto"), F.coalesce("local_addr", q).alias("local_addr"), F.coalesce("foreign_addr", q).alias("foreign_addr"), "state", "process_name", "pid_at_open", F.col("first_seen").alias("opened"), F.when(F.col("last_seen") > F.col("first_seen"), F.col("last_seen")).alias("closed"), "rx", "tx"),
        "files": of("file").select(F.col("id").alias("path"), F.coalesce("flags", no_names).alias("flags"), "first_seen", "last_seen", F.coalesce("touch_count", zero).alias("touch_count")),
        "domains": of("domain").select(F.col("id").alias("name"), F.coalesce("qtypes", no_names).alias("qtypes"), F.coalesce("masked", F.lit(False)).alias("masked"), "first_seen", "last_seen", F.coalesce("query_count", zero).alias("query_count")),
        "parent_of": to("parent_of").select(F.col("from_id").alias("parent_id"), F.col("to_id").alias("child_id")),
        "frontmost_during": to("frontmost_during").select(F.col("from_id").alias("app"), F.col("to_id").alias("process_id"), F.coalesce("overlap_from", zero).alias("from"), F.col("overlap_to").alias("to")),
        "opened_socket": to("opened_socket").where(F.size(F.split("to_id", r"\|", 3)) == 3).select(F.col("from_id").alias("process_id"), F.col("to_id").alias("socket_id")),
        "queried_domain": to("queried_domain").select(F.col("from_id").alias("process_id"), F.col("to_id").alias("domain"), F.coalesce("queries", F.lit(1).cast("long")).alias("count")),
    }


def counts(graph: dict[str, DataFrame]) -> DataFrame:
    """part, n: how many nodes and edges of each kind a graph has."""
    out = None
    for part, frame in graph.items():
        one = frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
        out = one if out is None else out.union(one)
    return out


def write_json(graph: dict[str, DataFrame], path: str) -> None:
    """A graph as a folder with a folder of JSON lines for each part."""
    for part, frame in graph.items():
        frame.write.mode("overwrite").json(f"{path}/{part}")


def read_json(spark: SparkSession, path: str, graph: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """What write_json() wrote; graph: frames with the schemas to read by, else these are inferred."""
    parts = graph or dict.fromkeys(("processes", "apps", "sockets", "files", "domains", *ENDS))
    return {p: (spark.read.schema(f.schema) if f is not None else spark.read).json(f"{path}/{p}") for p, f in parts.items()}
