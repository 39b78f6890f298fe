"""python -m telemill.cli STORE COMMAND: the store's queries as JSON lines or as tables."""

from __future__ import annotations

import argparse
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.functions.scalars import DAY, SECOND
from telemill import report
from telemill.operators import analytics, narrate, persist, store

COMMANDS = ("summary", "processes", "endpoints", "domains", "focus", "events", "topology", "prune", "graph", "dot", "candidates", "facts")

EMPTY_NODES = "kind string, id string, first_seen long, last_seen long, " + ", ".join(f"`{c}` {t}" for c, t in persist.ATTRIBUTES.items())
EMPTY_EDGES = "kind string, from_kind string, from_id string, to_kind string, to_id string, count long, first_seen long, last_seen long, " + ", ".join(f"{c} {t}" for c, t in persist.EDGE.items())


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="telemill")
    p.add_argument("store")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--since-mins", type=int, default=60)
    p.add_argument("--limit", type=int)
    p.add_argument("--kinds", type=lambda s: s.split(","))
    p.add_argument("--older-than-days", type=int, default=30)
    p.add_argument("--pretty", action="store_true")
    return p.parse_args(argv)


def answer(s: store.Store, a: argparse.Namespace, now: int) -> DataFrame:
    since, n = now - a.since_mins * 60 * SECOND, a.limit or (200 if a.command == "events" else store.CAP)
    if a.command == "prune":
        return s.spark.createDataFrame([s.prune_before(now - a.older_than_days * DAY)])
    if a.command in ("graph", "candidates", "facts"):
        g = s.load_graph()
        if a.command == "graph":
            return persist.counts(g)
        if a.command == "candidates":
            return narrate.candidate_lines(narrate.graph_candidates(g["processes"]), g["processes"]).orderBy("pid")
        facts = narrate.graph_facts(g)
        lines = [f.select(F.lit(k).alias("fact"), F.to_json(F.struct("*")).alias("line")) for k, f in facts.items()]
        return reduce(DataFrame.union, lines)
    nodes, edges, events = s.read("nodes"), s.read("edges"), s.read("events")
    nodes = s.spark.createDataFrame([], EMPTY_NODES) if nodes is None else nodes
    edges = s.spark.createDataFrame([], EMPTY_EDGES) if edges is None else edges
    events = s.spark.createDataFrame([], "seq long, ts_ns long, kind string") if events is None else events
    if a.command == "dot":
        label = analytics.node_label()
        return report.dot_lines(nodes.select("*", label.alias("label"), F.col("id").alias("tooltip")), edges).orderBy("part", "line").select("line")
    if a.command == "summary":
        return store.summary(nodes, edges, events)
    if a.command == "processes":
        return nodes.where((F.col("kind") == "process") & (F.col("last_seen") >= since)).orderBy(F.desc("last_seen"), "id").limit(n)
    if a.command == "endpoints":
        return store.top_endpoints(nodes, n)
    if a.command == "domains":
        return store.top_domains(nodes, edges, n)
    if a.command == "focus":
        return store.focus_segments(edges, nodes, since, now).orderBy("start_ns").limit(n)
    if a.command == "events":
        return store.events_in_window(events, since, now, a.kinds, n)
    e = edges.select(F.concat_ws(" ", "from_kind", "from_id").alias("src"), F.concat_ws(" ", "to_kind", "to_id").alias("dst"), F.when(F.col("kind") == "queried_domain", F.col("count")).otherwise(1).alias("weight"))
    return analytics.topology(nodes.select(F.concat_ws(" ", "kind", "id").alias("id"), F.col("id").alias("label")), e, n)[0]


def main(argv: list[str] | None = None) -> None:
    a = parse(argv)
    spark = SparkSession.builder.appName("telemill").getOrCreate()
    rows = answer(store.Store(spark, a.store), a, time.time_ns())
    if a.pretty:
        rows.show(1000, truncate=120)
    else:
        for r in rows.toJSON().toLocalIterator():
            print(r)


if __name__ == "__main__":
    main()
