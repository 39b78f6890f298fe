"""The entity graph: folding events into nodes, and attributing them to processes as edges.

Events: seq, t, kind, pid and the fields of their kind. Nodes: kind, id, first_seen, last_seen and typed attributes.
Edges: kind, from_kind, from_id, to_kind, to_id, weight, overlap_from, overlap_to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions.scalars import DAY, domain_id, process_key, socket_key
from telemill.operators.overlaps import OPEN, RANGE, overlaps
from telemill.operators.ticks import neighbours, running


def process_nodes(events: DataFrame) -> DataFrame:
    """pid, start, attributes, birth, death: the last birth of an identity, and the last death behind it; a death
    without birth makes a node with birth = death."""
    attrs = [c for c in ("comm", "name", "exec_path", "ppid", "uid") if c in events.columns]
    is_birth = F.col("kind") == "process_birth"
    e = events.where(F.col("kind").isin("process_birth", "process_death"))
    g = e.groupBy("pid", "start").agg(
        F.max_by(F.when(is_birth, F.struct("t", "seq", *attrs)), F.when(is_birth, F.col("seq"))).alias("b"),
        F.max_by(F.when(~is_birth, F.struct("t", "seq", *attrs)), F.when(~is_birth, F.col("seq"))).alias("d"),
    )
    pick = [F.coalesce(F.col(f"b.{a}"), F.when(F.col("b").isNull(), F.col(f"d.{a}"))).alias(a) for a in attrs]
    return g.select("pid", "start", *pick, F.coalesce("b.t", "d.t").alias("birth"), F.when(F.col("b").isNull() | (F.col("d.seq") > F.col("b.seq")), F.col("d.t")).alias("death"))


def app_intervals(events: DataFrame, last_t: Column | None = None, app: str = "to_bundle", by: str | None = None) -> DataFrame:
    """app, from, to: an application is in front from its focus event to the next one, the last one to the end of the
    capture. A repeated focus on the same application keeps its first beginning, once more."""
    e = events.where((F.col("kind") == "app_focus") & F.col(app).isNotNull()).withColumnRenamed(app, "app")
    groups = [by] if by else []
    e = neighbours(neighbours(e, ["app"], "seq", groups), ["t"], "seq", groups, following=True)
    begins = ~F.coalesce(F.col("previous_app") == F.col("app"), F.lit(False))
    e = running(e.withColumn("__all", F.lit(0)), groups or ["__all"], ["seq"], F.when(begins, F.struct("seq", "t")), "__run").drop("__all")
    return e.select(*groups, "app", F.col("__run.t").alias("from"), F.coalesce("next_t", last_t if last_t is not None else F.lit(None).cast("long")).alias("to"))


def socket_nodes(events: DataFrame) -> DataFrame:
    """One node for each (proto, local_addr, foreign_addr): the last opening, closed and its bytes by what came after."""
    e = events.where(F.col("kind").isin("connection_opened", "connection_closed")).withColumn("id", socket_key("proto", "local_addr", "foreign_addr"))
    is_open = F.col("kind") == "connection_opened"
    own = F.struct("t", "seq", "pid", "process_name", "rx", "tx")
    g = e.groupBy("id").agg(F.max_by(F.when(is_open, own), F.when(is_open, F.col("seq"))).alias("o"), F.max_by(F.when(~is_open, own), F.when(~is_open, F.col("seq"))).alias("c"), F.first("foreign_addr").alias("foreign_addr"))
    closed = F.col("o").isNull() | (F.col("c.seq") > F.col("o.seq"))
    after = lambda f: F.when(closed, F.coalesce(F.col(f"c.{f}"), F.col(f"o.{f}"))).otherwise(F.col(f"o.{f}"))
    return g.select("id", "foreign_addr", F.coalesce("o.process_name", "c.process_name").alias("process_name"), F.coalesce("o.pid", "c.pid").alias("pid_at_open"), F.coalesce("o.t", "c.t").alias("opened"), F.when(closed, F.col("c.t")).alias("closed"), after("rx").alias("rx"), after("tx").alias("tx"))


def file_nodes(events: DataFrame) -> DataFrame:
    """path, flags (union), first_seen, last_seen, touch_count."""
    e = events.where(F.col("kind") == "file_changed")
    g = e.groupBy("path").agg(F.min_by("t", "seq").alias("first_seen"), F.max_by("t", "seq").alias("last_seen"), F.sum("count").alias("touch_count"))
    each = e.select("path", "seq", F.posexplode("flags").alias("i", "flag")).groupBy("path", "flag").agg(F.min(F.struct("seq", "i")).alias("at"))
    flags = each.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "flag"))).alias("f"))  # a row a known flag
    none = F.array().cast("array<string>")
    return g.join(flags, "path", "left").select("path", F.coalesce(F.col("f.flag"), none).alias("flags"), "first_seen", "last_seen", "touch_count")


def with_domain(events: DataFrame) -> DataFrame:
    return events.where(F.col("kind") == "dns_query").withColumn("domain", domain_id("qname", "masked", "name_hash")).where("domain is not null")


def domain_nodes(events: DataFrame) -> DataFrame:
    """name, qtypes, masked (of all), first_seen, last_seen, query_count."""
    return with_domain(events).groupBy(F.col("domain").alias("name")).agg(F.array_sort(F.collect_set("qtype")).alias("qtypes"), F.bool_and(F.coalesce("masked", F.lit(False))).alias("masked"), F.min("t").alias("first_seen"), F.max("t").alias("last_seen"), F.count(F.lit(1)).alias("query_count"))


def domain_tally(events: DataFrame) -> DataFrame:
    """pid, domain, count, first_t."""
    return with_domain(events).where("pid is not null").groupBy("pid", "domain").agg(F.count(F.lit(1)).alias("count"), F.min("t").alias("first_t"))


def parent_edges(processes: DataFrame) -> DataFrame:
    """parent_id, child_id by ppid; of a reused pid the newest identity is the parent."""
    p = processes.groupBy("pid").agg(F.max_by(F.struct("pid", "start"), F.struct("start", "birth")).alias("p")).select(F.col("pid").alias("ppid"), process_key("p.pid", "p.start").alias("parent_id"))
    return processes.where("ppid is not null").select("ppid", process_key("pid", "start").alias("child_id")).join(p, "ppid").where("parent_id <> child_id").select("parent_id", "child_id")


def frontmost_edges(intervals: DataFrame, processes: DataFrame, per_range: int = RANGE, end: Column | None = None) -> DataFrame:
    """app, process_id, from, to: overlaps of intervals and lifetimes, by a sweep over ranges of time (see overlaps). An
    interval without end lasts to `end`, else it is open, as is the overlap of two that are."""
    stop = F.coalesce("to", end) if end is not None else F.col("to")
    spans = intervals.select(F.col("app").alias("id"), F.col("from").alias("begin"), stop.alias("end"))
    lives = processes.select(process_key("pid", "start").alias("id"), F.col("birth").alias("begin"), F.col("death").alias("end"))
    met = overlaps(spans, lives, per_range)
    return met.select(F.col("left").alias("app"), F.col("right").alias("process_id"), F.col("begin").alias("from"), F.when(F.col("end") < OPEN, F.col("end")).alias("to"))


def attributed(rows: DataFrame, processes: DataFrame, at: str) -> DataFrame:
    """rows (pid, at) with process_id of the youngest process of that pid that lived then; rows without one go."""
    p = processes.where("pid is not null").select("pid", F.col("birth").alias("__at"), F.struct("birth", "start", "death").alias("__born"))
    probe = rows.where("pid is not null").select("pid", F.col(at).alias("__at")).distinct().withColumn("__born", F.lit(None).cast(p.schema["__born"].dataType))
    both = running(p.union(probe).withColumn("__turn", F.col("__born").isNull().cast("int")), ["pid"], ["__at", "__turn"], F.col("__born"), "__young", f"__at div {DAY}")
    young = both.where("__turn = 1 and __young is not null").select("pid", "__at", "__young")
    lives = F.coalesce(F.col("__at") <= F.col("__young.death"), F.lit(True))
    one = young.where(lives).select("pid", "__at", process_key("pid", "__young.start").alias("process_id"))
    # of the youngest having died by then, an older one may live: few, and only they meet all processes of their pid
    rest = young.where(~lives).select("pid", "__at").join(processes.select("pid", "start", "birth", "death"), "pid")
    rest = rest.where((F.col("birth") <= F.col("__at")) & (F.col("__at") <= F.coalesce("death", F.lit(OPEN))))
    two = rest.groupBy("pid", "__at").agg(F.max_by(process_key("pid", "start"), F.struct("birth", "start")).alias("process_id"))
    return rows.join(one.union(two).withColumnRenamed("__at", at), ["pid", at])


def trim(frame: DataFrame, cutoff_ns: int, ended: str, keep_open: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rows that stay and those that go: ended before the cutoff; open ones stay."""
    old = F.coalesce(F.col(ended) < cutoff_ns, F.lit(not keep_open))
    return frame.where(~old), frame.where(old)
