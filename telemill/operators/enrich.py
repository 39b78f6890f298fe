"""Joining events with the process that was known when they came out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.operators.ticks import running
from telemill.plans.lineage import drop_written, written

DEPTH = 32


def latest_by_pid(births: DataFrame) -> DataFrame:
    """Of births (pid, start, emit_seq, ...), the row of the newest start of each pid, the last such birth."""
    cols = [c for c in births.columns if c != "pid"]
    return births.groupBy("pid").agg(F.max_by(F.struct(*cols), F.struct("start", "emit_seq")).alias("r")).select("pid", "r.*")


def as_of(events: DataFrame, births: DataFrame, deaths: DataFrame, key: str = "seq", attrs: list[str] = ()) -> DataFrame:
    """events (key, pid) with start, attrs and alive of the process known before the event came out: births and deaths
    (pid, start, emit_seq) count if their emit_seq is less than key. Null where none is known.

    Events, births and deaths are put in one order of time by pid, and the newest birth is carried forward to the events,
    and to these the last death of its identity: no event meets all births of its pid.
    """
    b = births.where("pid is not null").select("pid", F.col("emit_seq").alias("__k"), F.struct("start", F.col("emit_seq").alias("__b"), *attrs).alias("__born"))
    probe = events.where("pid is not null").select("pid", F.col(key).alias("__k")).distinct().withColumn("__born", F.lit(None).cast(b.schema["__born"].dataType))
    both = b.union(probe).withColumn("__turn", F.col("__born").isNotNull().cast("int"))  # of an equal time, events go first
    known = running(both, ["pid"], ["__k", "__turn"], F.col("__born"), "r").where("__turn = 0 and r is not null").select("pid", "__k", "r.*")
    d = deaths.select("pid", "start", F.col("emit_seq").alias("__k"), F.lit(1).alias("__turn"), F.col("emit_seq").alias("__dead"))
    asked = known.select("pid", "start", "__k", F.lit(0).alias("__turn"), F.lit(None).cast("long").alias("__dead"))
    gone = running(asked.union(d), ["pid", "start"], ["__k", "__turn"], F.col("__dead"), "__d").where("__turn = 0").select("pid", "start", "__k", "__d")
    best = known.join(gone, ["pid", "start", "__k"]).withColumn("alive", F.col("__d").isNull() | (F.col("__b") >= F.col("__d")))
    return events.join(best.withColumnRenamed("__k", key).drop("__b", "__d"), ["pid", key], "left")


#: Kinds of events that get their process; births and deaths make the index, focus and file changes are left as they are.
ENRICHED = ("connection_opened", "connection_closed", "connection_completed", "dns_query")


def enriched(events: DataFrame, births: DataFrame, deaths: DataFrame, key: str = "seq", attrs: list[str] = ("comm", "exec_path"), depth: int = DEPTH, stop_at: int = 1) -> DataFrame:
    """All events (key, pid, kind) with process (pid, start, alive and attrs) and ancestors (an array of pid, start and
    attrs, parent first), as they were known before the event came out; both null where no process is known.

    Events of one key may have different pids. births need ppid and attrs. Each hop up is one as-of join of the events whose chain goes on: it ends at pids up to
    stop_at, at unknown parents, where a pid would come again, and after depth hops.
    """
    attrs = list(attrs)
    mine = events.where(F.col("kind").isin(*ENRICHED) & F.col("pid").isNotNull()).select(F.col(key).alias("__k"), "pid", F.col("pid").alias("__p")).distinct()
    found = written(as_of(mine, births, deaths, "__k", ["ppid", *attrs]).where("start is not null"), "hop")
    one = F.struct("pid", "start", *attrs)
    now = found.select("__k", "__p", F.col("ppid").alias("pid"), F.array("pid").alias("path"))
    chain = None
    for hop in range(1, depth + 1):
        now = now.where((F.col("pid") > stop_at) & ~F.array_contains("path", F.col("pid")))
        step = written(as_of(now, births, deaths, "__k", ["ppid", *attrs]).where("start is not null"), "hop")
        if step.isEmpty():
            break
        rows = step.select("__k", "__p", F.lit(hop).alias("hop"), one.alias("process"))
        chain = rows if chain is None else chain.union(rows)
        now = step.select("__k", "__p", F.col("ppid").alias("pid"), F.concat("path", F.array("pid")).alias("path"))
    known = found.select("__k", "__p", F.struct("pid", "start", "alive", *attrs).alias("process"), F.array().cast(f"array<{found.select(one.alias('x')).schema['x'].dataType.simpleString()}>").alias("none"))
    if chain is None:
        known = known.withColumnRenamed("none", "ancestors")
    else:
        up = chain.groupBy("__k", "__p").agg(F.array_sort(F.collect_list(F.struct("hop", "process"))).alias("up"))  # depth rows at most
        known = known.join(up, ["__k", "__p"], "left").select("__k", "__p", "process", F.coalesce(F.col("up.process"), "none").alias("ancestors"))
    own = known.withColumnsRenamed({"__k": key, "__p": "pid"})
    plain = ~F.col("kind").isin(*ENRICHED)
    out = events.join(own, [key, "pid"], "left")
    return out.withColumns({c: F.when(~plain, F.col(c)) for c in ("process", "ancestors")})


def ancestors(start: DataFrame, parents: DataFrame, depth: int = DEPTH, stop_at: int = 1) -> DataFrame:
    """(id, hop, ancestor): the chains of parents (child, parent) of every start id, child to root.

    A chain stops at ids up to stop_at, at unknown parents, where it would repeat an id, and after depth hops; a child of
    several parents has a chain by each. Chains double: one of 2^k hops is joined with that of its end, so that depth 32
    takes five joins. Repeated starts and parents count once; null ids have no ancestors.
    """
    kind = start.schema["id"].dataType.simpleString()
    if depth < 1:
        return start.sparkSession.createDataFrame([], f"id {kind}, hop int, ancestor {kind}")
    step = parents.where((F.col("parent") > stop_at) & F.col("child").isNotNull() & (F.col("child") != F.col("parent"))).distinct()
    up = written(step.select("child", F.array("parent").alias("path"), F.col("parent").alias("last"), F.lit(True).alias("goes_on")), "chains")
    reach = 1
    while reach < depth and not up.where("goes_on").isEmpty():
        # what repeats an id of the chain, and all behind it, is cut off
        more = up.select(F.col("child").alias("last"), F.col("path").alias("more"), F.col("goes_on").alias("then"))
        on = up.where("goes_on").join(more.hint("merge"), "last", "left").withColumn("own", F.array_append("path", F.col("child")))
        known = F.array_min(F.filter(F.transform("more", lambda x, i: F.when(F.array_contains("own", x), i)), lambda i: i.isNotNull()))
        on = on.withColumn("known", known).withColumn("more", F.when(F.col("known").isNull(), F.coalesce("more", F.array().cast(up.schema["path"].dataType))).otherwise(F.slice("more", 1, F.coalesce("known", F.lit(0)))))
        on = on.select("child", F.concat("path", "more").alias("path"), (F.coalesce("then", F.lit(False)) & F.col("known").isNull()).alias("goes_on")).distinct()
        longer = written(up.where("not goes_on").union(on.select("child", "path", F.element_at("path", -1).alias("last"), "goes_on")), "chains")
        drop_written(up)
        up, reach = longer, 2 * reach
    chains = start.select("id").distinct().join(up.withColumnRenamed("child", "id"), "id").select("id", F.slice("path", 1, depth).alias("path"))
    upto = chains.select("id", F.explode(F.transform("path", lambda x, i: F.slice("path", F.lit(1), i + 1))).alias("path")).distinct()
    return upto.select("id", F.size("path").alias("hop"), F.element_at("path", -1).alias("ancestor"))


def ancestors_sql(spark: SparkSession, edges: DataFrame, start: str, depth: int) -> DataFrame:
    """(hop, ancestor) of one id over edges (parent, child), without a cycle test: a cycle repeats until depth."""
    edges.createOrReplaceTempView("__edges")
    return spark.sql(
        "with recursive up(hop, ancestor) as (select 1, parent from __edges where child = :start and :depth > 0 "
        "union all select hop + 1, e.parent from up join __edges e on e.child = up.ancestor where hop < :depth) select * from up",
        {"start": start, "depth": depth},
    )
