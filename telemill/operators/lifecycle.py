"""Events from observations: snapshot differences, coalesced file changes, focus changes, DNS queries, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.scalars import domain_id, past
from telemill.operators.ticks import GAP, neighbours, tick_table, with_ticks

WINDOW = 500_000_000
#: emit_seq of what only the end of the input brings out.
END = (1 << 62) - 1


def route(obs: DataFrame) -> DataFrame:
    """obs (source, kind) with stage: process, connection, dns, file, focus, or null for what no stage takes."""
    dns = F.coalesce(F.col("kind") == "dns_query", F.lit(False))
    s = F.col("source")
    return obs.withColumn("stage", F.when(s == "process", "process").when(s == "window", "focus").when(s == "file_system", "file").when((s == "network") & dns, "dns").when(s == "network", "connection"))


def snapshot_diff(obs: DataFrame, keys: list[str], attrs: list[str] = (), gap_ns: int = GAP, flush_tail: bool = False) -> DataFrame:
    """Births and deaths of keys between successive ticks of a source.

    obs: source, obs_seq, t, keys, attrs; rows with a null key are left out and begin no tick. Gives source, keys, attrs
    (of the key's last observation in its tick), what ('birth' or 'death'), t, first_seen, last_seen, emit_seq: the
    obs_seq at whose arrival the event is known. The first tick is silent; the last one is not compared unless
    flush_tail. first_seen reaches back over ticks without a gap.
    """
    o = with_ticks(obs.dropna(subset=keys), gap_ns)
    ticks = tick_table(o)
    k = ["source", *keys]
    last = F.max_by(F.struct("t", *attrs), "obs_seq").alias("l")
    seen = o.groupBy(*k, "tick").agg(F.min_by("t", "obs_seq").alias("first_t"), last).select(*k, "tick", "first_t", F.col("l.t").alias("key_t"), *[F.col(f"l.{a}").alias(a) for a in attrs])
    w = Window.partitionBy(*k).orderBy("tick")
    seen = seen.withColumns({"new": ~F.lag("tick").over(w).eqNullSafe(F.col("tick") - 1), "gone": ~F.lead("tick").over(w).eqNullSafe(F.col("tick") + 1)})
    seen = seen.withColumn("island", F.sum(F.col("new").cast("int")).over(w))
    seen = seen.withColumn("first_seen", F.min("first_t").over(Window.partitionBy(*k, "island").orderBy("tick")))
    j = seen.where("new or gone").join(ticks.select("source", "tick", "seq1", "seq2", "last1", "last_tick"), ["source", "tick"])
    m = F.col("last_tick") - (0 if flush_tail else 1)
    born = j.where(F.col("new") & (F.col("tick") > 0) & (F.col("tick") <= m)).select(*k, *attrs, F.lit("birth").alias("what"), F.col("key_t").alias("t"), "first_seen", F.col("key_t").alias("last_seen"), F.coalesce("seq1", F.lit(END)).alias("emit_seq"))
    died = j.where(F.col("gone") & (F.col("tick") < m)).select(*k, *attrs, F.lit("death").alias("what"), F.col("last1").alias("t"), "first_seen", F.col("key_t").alias("last_seen"), F.coalesce("seq2", F.lit(END)).alias("emit_seq"))
    return born.unionByName(died)


def process_events(obs: DataFrame, attrs: list[str] = (), gap_ns: int = GAP, flush_tail: bool = False) -> DataFrame:
    """process_birth and process_death events; the key is (pid, start)."""
    e = snapshot_diff(obs, ["pid", "start"], attrs, gap_ns, flush_tail)
    return e.withColumn("kind", F.concat(F.lit("process_"), F.col("what"))).drop("what")


def connection_events(obs: DataFrame, keys: list[str] = ("proto", "local_addr", "foreign_addr"), attrs: list[str] = (), gap_ns: int = GAP, flush_tail: bool = False) -> DataFrame:
    """connection_opened, and for each end connection_closed and connection_completed with duration_ns."""
    e = snapshot_diff(obs, list(keys), attrs, gap_ns, flush_tail)
    kinds = F.when(F.col("what") == "birth", F.array(F.lit("connection_opened"))).otherwise(F.array(F.lit("connection_closed"), F.lit("connection_completed")))
    e = e.withColumn("kind", F.explode(kinds)).drop("what")
    return e.withColumn("duration_ns", F.when(F.col("kind") == "connection_completed", past("last_seen", "first_seen")))


def file_events(obs: DataFrame, window_ns: int = WINDOW, flush_tail: bool = False) -> DataFrame:
    """Changes of a path in a tumbling window as one event.

    obs: obs_seq, t, path, flags (array), event_id. Gives path, flags (union in order of arrival), event_ids (without 0),
    count, first_seen, last_seen, t (the window's last time over all paths), emit_seq. The newest window is held back
    unless flush_tail. Only combined rows of a path and window meet.
    """
    o = obs.where(F.length("path") > 0).withColumn("window_id", F.expr(f"t div {window_ns}"))
    g = o.groupBy("window_id", "path").agg(F.array_sort(F.collect_list(F.struct("obs_seq", "flags", "event_id"))).alias("r"), F.min_by("t", "obs_seq").alias("first_seen"), F.max_by("t", "obs_seq").alias("last_seen"))
    ids = F.filter(F.col("r.event_id"), lambda i: i.isNotNull() & (i != 0))
    g = g.withColumns({"flags": F.array_distinct(F.flatten(F.filter(F.col("r.flags"), lambda f: f.isNotNull()))), "event_ids": ids, "count": F.size(ids).cast("long")}).drop("r")
    w = o.groupBy("window_id").agg(F.max_by("t", "obs_seq").alias("t"), F.min("obs_seq").alias("first_seq"))
    w = neighbours(w, ["first_seq"], "window_id", following=True).withColumnRenamed("next_first_seq", "emit_seq").drop("first_seq")
    if flush_tail:
        w = w.withColumn("emit_seq", F.coalesce("emit_seq", F.lit(END)))
    return g.join(w.where("emit_seq is not null"), "window_id")


def focus_events(obs: DataFrame) -> DataFrame:
    """app_focus events of (to_*, from_*) observations; those that stay in an application are dropped."""
    o = obs.where(F.col("to_bundle").isNotNull() | F.col("to_exec_path").isNotNull() if "to_exec_path" in obs.columns else F.col("to_bundle").isNotNull())
    o = o.where(~F.coalesce(F.col("from_bundle") == F.col("to_bundle"), F.lit(False)))
    return o.withColumn("pid", F.coalesce("to_pid", "pid") if "to_pid" in obs.columns else F.col("pid"))


def frontmost_changes(readings: DataFrame, columns: list[str], order: str = "obs_seq", by: str | None = None) -> DataFrame:
    """Polled readings that differ from the one before, with the old values as from_*; the first has none."""
    now = F.struct(*columns)
    r = neighbours(readings.withColumn("__now", now), ["__now"], order, [by] if by else [])
    before = F.col("previous___now")
    r = r.where(before.isNull() | ~before.eqNullSafe(F.col("__now"))).withColumns({f"from_{c}": before[c] for c in columns})
    return r.drop("__now", "previous___now")


def dns_events(obs: DataFrame) -> DataFrame:
    """dns_query events: masked defaults to false; with the domain's id."""
    return obs.withColumn("masked", F.coalesce("masked", F.lit(False))).withColumn("domain", domain_id("qname", "masked", "name_hash"))
