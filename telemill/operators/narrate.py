"""Facts and lines for narration: a window's summary from the graph alone, what is new, and candidates of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions.scalars import SECOND, directory_bucket, fmt_unix_ns, process_key
from telemill.operators.summary import NOISY, PROLIFIC, TOP_CLIENTS, TOP_DIRECTORIES, TOP_ENDPOINTS, TOP_PROCESSES, TRUSTED

#: Novel entities of each kind that are told.
TOLD = 8


def graph_facts(graph: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The summary of a window from its graph (see persist): span (of all times but 0), counts by part, and top lists of
    processes, endpoints, directories and domains; ties go by name."""
    c = F.col
    bounds = {"processes": ("birth", F.coalesce("death", "birth")), "sockets": ("opened", F.coalesce("closed", "opened")), "files": ("first_seen", c("last_seen")), "domains": ("first_seen", c("last_seen"))}
    times = None
    for part, (first, last) in bounds.items():
        t = graph[part].select(F.explode(F.array(c(first), last)).alias("t")).where("t <> 0")
        times = t if times is None else times.union(t)
    span = times.agg(F.min("t").alias("first_t"), F.max("t").alias("last_t")).withColumn("secs", F.expr(f"coalesce((last_t - first_t) div {SECOND}, 0)"))
    things = None
    for part in ("processes", "apps", "sockets", "files", "domains"):
        one = graph[part].agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
        things = one if things is None else things.union(one)
    named = graph["processes"].where(c("comm").isNotNull() & ~c("comm").isin(*NOISY))
    one = F.lit(1)
    total = F.sum(F.coalesce("rx", F.lit(0)) + F.coalesce("tx", F.lit(0)))
    ends = graph["sockets"].groupBy(F.coalesce("foreign_addr", F.lit("?")).alias("foreign_addr"), F.coalesce("process_name", F.lit("?")).alias("process_name"))
    return {
        "span": span, "things": things,
        "processes": named.groupBy("comm").agg(F.count(one).alias("spawns")).orderBy(F.desc("spawns"), "comm").limit(TOP_PROCESSES),
        "endpoints": ends.agg(total.alias("bytes_total"), F.bool_or(c("closed").isNull()).alias("still_open")).orderBy(F.desc("bytes_total"), "foreign_addr", "process_name").limit(TOP_ENDPOINTS),
        "directories": graph["files"].groupBy(directory_bucket("path").alias("directory")).agg(F.sum("touch_count").alias("changes")).orderBy(F.desc("changes"), "directory").limit(TOP_DIRECTORIES),
        "domains": graph["domains"].select("name", "query_count").orderBy(F.desc("query_count"), "name").limit(TOP_CLIENTS),
    }


def novelty_lines(novel: dict[str, DataFrame], cold: bool, now_ns: int) -> DataFrame:
    """rank, text: a line for each thing seen for the first time (frames of store.novel_*, by the names processes, domains,
    endpoints, apps), at most TOLD of a kind. With a cold baseline all is new: then one line says so and nothing else."""
    spark = next(iter(novel.values())).sparkSession
    if cold:
        return spark.createDataFrame([(0, "the history is too short to tell what is new")], "rank int, text string")
    what = {
        "processes": F.concat(F.lit("new program "), F.coalesce("comm", "exec_path", F.lit("?")), F.lit(", "), F.col("instances").cast("string"), F.lit(" started")),
        "domains": F.concat(F.lit("new domain "), "id"),
        "endpoints": F.concat(F.lit("new endpoint "), "foreign_addr", F.lit(" of "), F.coalesce("example", F.lit("?")), F.lit(", "), F.col("connections").cast("string"), F.lit(" connections")),
        "apps": F.concat(F.lit("new app "), F.coalesce("name", "id")),
    }
    out = None
    for i, (kind, text) in enumerate(what.items()):
        if kind in novel:
            line = F.concat(text, F.lit(", first at "), fmt_unix_ns("first_seen", F.lit(now_ns)))
            one = novel[kind].orderBy("first_seen", text).limit(TOLD).select((F.lit(TOLD * i)).alias("rank"), "first_seen", line.alias("text"))
            out = one if out is None else out.union(one)
    return out.orderBy("rank", "first_seen", "text").select("rank", "text")


def graph_candidates(processes: DataFrame, prefixes: tuple = TRUSTED, prolific: int = PROLIFIC) -> DataFrame:
    """pid, reasons (in fixed order) of a graph's processes: root whose parent (by ppid, the newest of that pid) isn't,
    those outside trusted paths, and pids that are the parent of many."""
    newest = processes.groupBy(F.col("pid").alias("ppid")).agg(F.max_by("uid", F.struct("start", "birth")).alias("parent_uid"))
    a = processes.where("uid = 0").join(newest, "ppid").where("parent_uid > 0").select("pid", F.lit("1 root_under_user").alias("r"))
    inside: Column = F.lit(False)
    for p in prefixes:
        inside = inside | F.coalesce(F.col("exec_path").startswith(p), F.lit(False))
    b = processes.where(~inside).select("pid", F.lit("2 outside_trusted").alias("r"))
    many = processes.where("ppid is not null").groupBy(F.col("ppid").alias("pid")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= prolific)
    c = many.join(processes.select("pid").distinct(), "pid", "left_semi").select("pid", F.lit("3 prolific_parent").alias("r"))
    g = a.union(b).union(c).groupBy("pid").agg(F.array_sort(F.collect_set("r")).alias("r"))
    return g.select("pid", F.array_join(F.transform("r", lambda x: F.substring(x, 3, 99)), ",").alias("reasons"))


def candidate_lines(candidates: DataFrame, processes: DataFrame) -> DataFrame:
    """pid, line: a candidate with its process and its parent's command; what isn't known is ?."""
    q = F.lit("?")
    show = lambda c: F.coalesce(F.col(c).cast("string"), q)
    own = processes.groupBy("pid").agg(F.max_by(F.struct("pid", "start", "comm", "exec_path", "uid", "ppid"), F.struct("start", "birth")).alias("p")).select("p.*")
    parent = own.select(F.col("pid").alias("ppid"), F.col("comm").alias("parent_comm"))
    rows = candidates.join(own, "pid", "left").join(parent, "ppid", "left")
    key = F.coalesce(process_key("pid", "start"), q)
    line = F.concat(F.lit("process="), key, F.lit(" comm="), show("comm"), F.lit(" path="), show("exec_path"), F.lit(" uid="), show("uid"), F.lit(" parent="), show("ppid"), F.lit(" parent_comm="), show("parent_comm"), F.lit(" reasons="), F.col("reasons"))
    return rows.select("pid", line.alias("line"))
