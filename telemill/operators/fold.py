"""The entity graph as a fold over batches of events: a state that is combined with each batch's, and the graph of a state.

A state is a dict of tables, a row for each process, socket, file, domain and so on, whose columns are combined by least,
greatest, sum or conjunction: combining is associative, so that however a history is cut into batches, and in whichever
order they come, the state is that of the whole. Which of two rows is later is told by seq, which is unique. graph() makes
of a state what persist.build() makes of the history.
"""

from __future__ import annotations

from collections import defaultdict
from copy import deepcopy
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions.scalars import socket_key
from telemill.operators import graph as G
from telemill.operators import persist
from telemill.plans.lineage import drop_written, written

#: Keys of each table, and how its other columns are combined.
TABLES = {
    "process": (["pid", "start"], {"birth": "max", "death": "max"}),
    "socket": (["id"], {"opened": "max", "closed": "max"}),
    "file": (["path"], {"first": "min", "last": "max", "touched": "sum"}),
    "flag": (["path", "flag"], {"at": "min"}),
    "domain": (["name"], {"first": "min", "last": "max", "masked": "and", "queries": "sum"}),
    "qtype": (["name", "qtype"], {}),
    "tally": (["pid", "domain"], {"count": "sum", "first_t": "min"}),
    "focus": (["seq"], {"row": "max"}),
}
_RULE = {"max": F.max, "min": F.min, "sum": F.sum, "and": F.bool_and}
ATTRIBUTES = ("comm", "name", "exec_path", "ppid", "uid")


def table_name(part: str) -> str:
    return f"fold_{part}"


def of_events(events: DataFrame) -> dict[str, DataFrame]:
    """The state of some events (seq, t, kind, pid and the fields of their kinds)."""
    kind = F.col("kind")

    def last(of: str, *fields: str) -> Column:
        return F.max(F.when(kind == of, F.struct("seq", "t", *fields)))

    p = events.where(kind.isin("process_birth", "process_death"))
    s = events.where(kind.isin("connection_opened", "connection_closed")).withColumn("id", socket_key("proto", "local_addr", "foreign_addr"))
    f = events.where((kind == "file_changed") & F.col("path").isNotNull())
    d = G.with_domain(events)
    own = ("pid", "process_name", "rx", "tx")
    return {
        "process": p.groupBy("pid", "start").agg(last("process_birth", *ATTRIBUTES).alias("birth"), last("process_death", *ATTRIBUTES).alias("death")),
        "socket": s.groupBy("id").agg(last("connection_opened", *own).alias("opened"), last("connection_closed", *own).alias("closed")),
        "file": f.groupBy("path").agg(F.min(F.struct("seq", "t")).alias("first"), F.max(F.struct("seq", "t")).alias("last"), F.sum("count").alias("touched")),
        "flag": f.select("path", "seq", F.posexplode("flags").alias("i", "flag")).groupBy("path", "flag").agg(F.min(F.struct("seq", "i")).alias("at")),
        "domain": d.groupBy(F.col("domain").alias("name")).agg(F.min("t").alias("first"), F.max("t").alias("last"), F.bool_and(F.coalesce("masked", F.lit(False))).alias("masked"), F.count(F.lit(1)).alias("queries")),
        "qtype": d.where("qtype is not null").select(F.col("domain").alias("name"), "qtype").distinct(),
        "tally": G.domain_tally(events),
        "focus": events.where((kind == "app_focus") & F.col("to_bundle").isNotNull()).select("seq", F.struct("t", "to_bundle", "to_name").alias("row")),
    }


def combined(part: str, old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Two tables of a state as one."""
    keys, rules = TABLES[part]
    both = new if old is None else old.unionByName(new)
    return both.groupBy(*keys).agg(*[_RULE[r](c).alias(c) for c, r in rules.items()]) if rules else both.distinct()


def graph(state: dict[str, DataFrame], per_range: int = G.RANGE) -> dict[str, DataFrame]:
    """The typed graph of a state: see persist.build()."""
    b, d = F.col("birth"), F.col("death")
    died = b.isNull() | (d["seq"] > b["seq"])
    attrs = [F.coalesce(b[a], F.when(b.isNull(), d[a])).alias(a) for a in ATTRIBUTES]
    p = state["process"].select("pid", "start", *attrs, F.coalesce(b["t"], d["t"]).alias("birth"), F.when(died, d["t"]).alias("death"))

    o, c = F.col("opened"), F.col("closed")
    closed = o.isNull() | (c["seq"] > o["seq"])
    after = lambda f: F.when(closed, F.coalesce(c[f], o[f])).otherwise(o[f]).alias(f)
    parts = F.split("id", r"\|", 3)
    sockets = state["socket"].select(
        "id", parts[2].alias("foreign_addr"), F.coalesce(o["process_name"], c["process_name"]).alias("process_name"), F.coalesce(o["pid"], c["pid"]).alias("pid_at_open"),
        F.coalesce(o["t"], c["t"]).alias("opened"), F.when(closed, c["t"]).alias("closed"), after("rx"), after("tx"), parts[0].alias("proto"), parts[1].alias("local_addr"),
    )
    at_open = sockets.select(F.col("pid_at_open").alias("pid"), F.col("opened").alias("t"), F.col("id").alias("socket_id"))

    flags = state["flag"].groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "flag"))).alias("f"))  # a row a known flag
    no_names = F.array().cast("array<string>")
    files = state["file"].join(flags, "path", "left").select("path", F.coalesce(F.col("f.flag"), no_names).alias("flags"), F.col("first.t").alias("first_seen"), F.col("last.t").alias("last_seen"), F.col("touched").alias("touch_count"))
    types = state["qtype"].groupBy("name").agg(F.array_sort(F.collect_set("qtype")).alias("qtypes"))  # a row a type of record
    domains = state["domain"].join(types, "name", "left").select("name", F.coalesce("qtypes", no_names).alias("qtypes"), "masked", F.col("first").alias("first_seen"), F.col("last").alias("last_seen"), F.col("queries").alias("query_count"))

    focus = state["focus"].select("seq", "row.*", F.lit("app_focus").alias("kind"))
    spans = G.app_intervals(focus)
    names = focus.groupBy(F.col("to_bundle").alias("app")).agg(F.max_by("to_name", "seq").alias("name"))
    apps = spans.groupBy("app").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("intervals")).join(names, "app", "left")
    asked = G.attributed(state["tally"], p, "first_t")
    return {
        "processes": p, "apps": apps.withColumnRenamed("app", "id"), "sockets": sockets, "files": files, "domains": domains, "parent_of": G.parent_edges(p), "frontmost_during": G.frontmost_edges(spans, p, per_range),
        "opened_socket": G.attributed(at_open, p, "t").select("process_id", "socket_id"), "queried_domain": asked.select("process_id", "domain", "count"),
    }


def absorb(tx, events: DataFrame) -> None:
    """Combine a batch of events with the state that a store's transaction holds, bucket by bucket. The first batch of a
    capture finds none: what the store has then is what the capture's graph is merged with."""
    begun = any(table_name(p) in tx.tables for p in TABLES)
    if not begun:
        for t in ("nodes", "edges"):
            if t in tx.tables:
                tx.tables[f"base_{t}"] = deepcopy(tx.tables[t])
    new, touched = of_events(events), defaultdict(list)
    where = [rows.select(F.lit(p).alias("part"), tx.store.bucket(TABLES[p][0]).alias("bucket")) for p, rows in new.items()]
    for r in reduce(DataFrame.union, where).distinct().collect():  # a row a table and bucket
        touched[r["part"]].append(r["bucket"])
    for part, rows in new.items():
        name, buckets = table_name(part), touched[part]
        tx.declare(name, rows)
        if buckets:
            tx.put(name, combined(part, tx.read(name, buckets), rows), TABLES[part][0], buckets)


def refresh(tx, per_range: int = G.RANGE) -> dict[str, list[int]]:
    """Make a store's nodes and edges those of its state, merged with what it had before; which buckets have changed."""
    from telemill.operators.store import KEYS, merge_edges, merge_nodes, prune

    g = graph({p: tx.read(table_name(p)) for p in TABLES}, per_range)
    rows = persist.node_rows(g)
    base = {t: tx.read(f"base_{t}") for t in ("nodes", "edges")}
    cutoff = int(tx.meta.get("pruned_before", 0))
    nodes = merge_nodes(base["nodes"] if base["nodes"] is not None else rows.limit(0), rows).drop("how")
    nodes = written(nodes, "nodes")
    new = persist.edge_rows(g, nodes)
    empty = new.limit(0).select(*KEYS["edges"], F.lit(0).cast("long").alias("count"), F.col("seen_at").alias("first_seen"), F.col("seen_at").alias("last_seen"), *persist.EDGE)
    edges = merge_edges(base["edges"] if base["edges"] is not None else empty, new).drop("how")
    if cutoff:
        kept = prune(nodes, edges, nodes.limit(0).select("kind", F.lit(0).cast("long").alias("ts_ns")), cutoff)
        edges = kept["edges"]
    edges = written(edges, "edges")
    changed = {t: tx.put_changed(t, f, KEYS[t]) for t, f in (("nodes", nodes.where(F.col("last_seen") >= cutoff) if cutoff else nodes), ("edges", edges))}
    for f in (nodes, edges):
        drop_written(f)
    return changed


def trim(tx, cutoff: int) -> None:
    """Leave out of a state what ended before the cutoff: dead processes, closed sockets, files and domains that weren't
    seen since, with their flags, types and tallies. Applications, living processes and open sockets stay."""
    tables = {p: tx.read(table_name(p)) for p in TABLES}
    if all(t is None for t in tables.values()):
        return
    tx.meta["pruned_before"] = str(max(cutoff, int(tx.meta.get("pruned_before", cutoff))))
    ended = lambda begin, end: F.coalesce((F.col(end)["t"] < cutoff) & (F.col(begin).isNull() | (F.col(end)["seq"] > F.col(begin)["seq"])), F.lit(False))
    kept = {"process": tables["process"].where(~ended("birth", "death")), "socket": tables["socket"].where(~ended("opened", "closed")), "file": tables["file"].where(F.col("last.t") >= cutoff), "domain": tables["domain"].where(F.col("last") >= cutoff)}
    kept["flag"] = tables["flag"].join(kept["file"].select("path"), "path", "left_semi")
    kept["qtype"] = tables["qtype"].join(kept["domain"].select("name"), "name", "left_semi")
    kept["tally"] = tables["tally"].join(kept["domain"].select(F.col("name").alias("domain")), "domain", "left_semi").select(*tables["tally"].columns)
    for part, rows in kept.items():
        tx.put_changed(table_name(part), rows, TABLES[part][0])
