"""The store: versioned Parquet tables of nodes, edges, events and metadata, and the queries over them.

Merges follow fixed rules: of a node (kind, id) the attributes come from the newer row, first_seen is the least and
last_seen the greatest; of an edge (kind, from, to) count grows by each row merged, last_seen is the greatest, and
first_seen stays as it was. Changes are written as a new version, which one file then names, so that readers see the old
version or the new one.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import Counter
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from telemill.functions.scalars import DAY, HOUR, SECOND, past
from telemill.plans.lineage import drop_written, written

NODE_KEY, EDGE_KEY = ["kind", "id"], ["kind", "from_kind", "from_id", "to_kind", "to_id"]
SCHEMA_VERSION = 2
CAP = 20


def merge_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (kind, id, first_seen, last_seen, attributes...) of both by the rules above, with how: inserted, updated, kept."""
    attrs = [c for c in old.columns if c not in (*NODE_KEY, "first_seen", "last_seen")]
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    g = both.groupBy(*NODE_KEY).agg(F.max_by(F.struct(*attrs, F.lit(1)), F.struct("__new", "last_seen")).alias("a"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min("__new").alias("lo"), F.max("__new").alias("hi"))
    how = F.when(F.col("lo") == 1, "inserted").when(F.col("hi") == 1, "updated").otherwise("kept")
    return g.select(*NODE_KEY, *[F.col(f"a.{c}").alias(c) for c in attrs], "first_seen", "last_seen", how.alias("how"))


def merge_edges(old: DataFrame, new: DataFrame, order: str = "seen_at") -> DataFrame:
    """old (key, count, first_seen, last_seen) with new (key, seen_at) merged; how as for nodes. Further columns that both
    have come from the new row that is last by order, else from the old one."""
    attrs = [c for c in old.columns if c in new.columns and c not in (*EDGE_KEY, "count", "first_seen", "last_seen", order)]
    whole = F.struct(*attrs, F.lit(1).alias("__x"))
    a = old.select(*EDGE_KEY, "count", "first_seen", "last_seen", F.lit(None).cast("long").alias("first_new"), whole.alias("was"), F.lit(None).cast(old.select(whole.alias("w")).schema["w"].dataType).alias("now"))
    b = new.groupBy(*EDGE_KEY).agg(F.count(F.lit(1)).alias("count"), F.lit(None).cast("long").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.min_by("seen_at", order).alias("first_new"), F.max_by(whole, order).alias("now"))
    b = b.withColumn("was", F.lit(None).cast(a.schema["was"].dataType))
    g = a.unionByName(b).groupBy(*EDGE_KEY).agg(F.sum("count").alias("count"), F.max("first_seen").alias("f"), F.max("last_seen").alias("last_seen"), F.max("first_new").alias("n"), F.max("was").alias("was"), F.max("now").alias("now"))
    how = F.when(F.col("f").isNull(), "inserted").when(F.col("n").isNotNull(), "updated").otherwise("kept")
    held = F.coalesce("now", "was")
    return g.select(*EDGE_KEY, "count", F.coalesce("f", "n").alias("first_seen"), "last_seen", *[held[c].alias(c) for c in attrs], how.alias("how"))


def prune(nodes: DataFrame, edges: DataFrame, events: DataFrame, cutoff: int) -> dict[str, DataFrame]:
    """What stays of each table, and counts of what goes: old events, old edges, old nodes, then edges of missing nodes."""
    n = nodes.where(F.col("last_seen") >= cutoff)
    young = edges.where(F.col("last_seen") >= cutoff)
    keys = n.select("kind", "id")
    kept = young.join(keys.select(F.col("kind").alias("from_kind"), F.col("id").alias("from_id")), ["from_kind", "from_id"], "left_semi").join(keys.select(F.col("kind").alias("to_kind"), F.col("id").alias("to_id")), ["to_kind", "to_id"], "left_semi").select(*edges.columns)
    e = events.where(F.col("ts_ns") >= cutoff)
    count = lambda f, name: f.agg(F.count(F.lit(1)).alias(name))
    report = count(nodes, "n0").crossJoin(count(n, "n1")).crossJoin(count(edges, "e0")).crossJoin(count(kept, "e1")).crossJoin(count(events, "v0")).crossJoin(count(e, "v1"))  # one row each
    return {"nodes": n, "edges": kept, "events": e, "report": report.select((F.col("n0") - F.col("n1")).alias("nodes"), (F.col("e0") - F.col("e1")).alias("edges"), (F.col("v0") - F.col("v1")).alias("events"))}


# -- queries; times are unix ns, windows inclusive at both ends


def summary(nodes: DataFrame, edges: DataFrame, events: DataFrame) -> DataFrame:
    """what, kind, n: nodes and edges by kind, events; and the span of nodes as first and last."""
    a = nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("what"), "kind", "n")
    b = edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("what"), "kind", "n")
    c = events.agg(F.count(F.lit(1)).alias("n")).select(F.lit("events").alias("what"), F.lit("").alias("kind"), "n")
    s = nodes.agg(F.min("first_seen").alias("first"), F.max("last_seen").alias("last")).select(F.expr("stack(2, 'span', 'first', first, 'span', 'last', last) as (what, kind, n)"))
    return a.union(b).union(c).union(s)


def processes_seen_since(processes: DataFrame, since: int) -> DataFrame:
    return processes.where(F.coalesce("death", "birth") >= since)


def _parents(nodes: DataFrame, edges: DataFrame, since: int) -> DataFrame:
    p = nodes.where("kind = 'process'")
    e = edges.where("kind = 'parent_of'").select("from_id", "to_id")
    child = p.where(F.col("last_seen") >= since).select(F.col("id").alias("to_id"), F.col("comm").alias("comm"), F.col("exec_path").alias("exec_path"), F.col("uid").alias("uid"))
    parent = p.select(F.col("id").alias("from_id"), F.col("comm").alias("parent_comm"), F.col("uid").alias("parent_uid"))
    return e.join(child, "to_id").join(parent, "from_id")


def root_under_user(nodes: DataFrame, edges: DataFrame, since: int = 0) -> DataFrame:
    """id, comm, exec_path of root processes whose parent isn't root."""
    return _parents(nodes, edges, since).where("uid = 0 and parent_uid > 0").select(F.col("to_id").alias("id"), "comm", "exec_path", F.col("from_id").alias("parent_id"))


def outside_paths(nodes: DataFrame, prefixes: list[str], since: int = 0) -> DataFrame:
    """Processes whose path begins with none of the prefixes; a missing path does not."""
    inside = F.lit(False)
    for p in prefixes:
        inside = inside | F.coalesce(F.col("exec_path").startswith(p), F.lit(False))
    return nodes.where((F.col("kind") == "process") & (F.col("last_seen") >= since) & ~inside)


def in_window(nodes: DataFrame, edges: DataFrame, start: int, end: int) -> tuple[DataFrame, DataFrame]:
    """Nodes that overlap a window, and the edges between them."""
    n = nodes.where((F.col("first_seen") <= end) & (F.col("last_seen") >= start))
    keys = n.select("kind", "id")
    e = edges.join(keys.select(F.col("kind").alias("from_kind"), F.col("id").alias("from_id")), ["from_kind", "from_id"], "left_semi").join(keys.select(F.col("kind").alias("to_kind"), F.col("id").alias("to_id")), ["to_kind", "to_id"], "left_semi")
    return n, e.select(*edges.columns)


def top_endpoints(nodes: DataFrame, n: int = CAP) -> DataFrame:
    s = nodes.where("kind = 'socket'").groupBy(F.coalesce("foreign_addr", F.lit("?")).alias("foreign_addr")).agg(F.sum(F.coalesce("rx", F.lit(0)) + F.coalesce("tx", F.lit(0))).alias("bytes_total"), F.count_distinct("pid_at_open").alias("processes"), F.count(F.lit(1)).alias("sockets"))
    return s.orderBy(F.desc("bytes_total"), "foreign_addr").limit(n)


def focus_segments(edges: DataFrame, nodes: DataFrame, start: int, end: int) -> DataFrame:
    """app_id, name, start_ns, end_ns, secs of frontmost edges in a window, clipped to it."""
    apps = nodes.where("kind = 'app'").select(F.col("id").alias("from_id"), F.col("name").alias("app_name"))
    e = edges.where("kind = 'frontmost_during'").join(apps, "from_id", "left").withColumn("until", F.coalesce("overlap_to", F.lit(end)))
    e = e.where((F.col("overlap_from") <= end) & (F.col("until") >= start)).withColumns({"start_ns": F.greatest("overlap_from", F.lit(start)), "end_ns": F.least("until", F.lit(end))})
    return e.select(F.col("from_id").alias("app_id"), "to_id", F.coalesce("app_name", "from_id").alias("name"), "start_ns", "end_ns", F.expr(f"(end_ns - start_ns) div {SECOND}").alias("secs"))


def parents_with_many_children(nodes: DataFrame, edges: DataFrame, least: int, since: int = 0) -> DataFrame:
    g = _parents(nodes, edges, since).groupBy(F.col("from_id").alias("id"), F.col("parent_comm").alias("comm")).agg(F.count(F.lit(1)).alias("children"))
    return g.where(F.col("children") >= least)


def top_domains(nodes: DataFrame, edges: DataFrame, n: int = CAP) -> DataFrame:
    asked = edges.where("kind = 'queried_domain'").groupBy(F.col("to_id").alias("id")).agg(F.count_distinct("from_id").alias("processes"))
    d = nodes.where("kind = 'domain'").join(asked, "id", "left")
    return d.select("id", "query_count", "masked", F.coalesce("processes", F.lit(0).cast("long")).alias("processes")).orderBy(F.desc("query_count"), "id").limit(n)


def novel_processes(nodes: DataFrame, since: int, cap: int = CAP) -> DataFrame:
    g = nodes.where("kind = 'process'").groupBy("comm", "exec_path").agg(F.min("first_seen").alias("first_seen"), F.count(F.lit(1)).alias("instances"))
    return g.where((F.col("first_seen") >= since) & (F.col("comm").isNotNull() | F.col("exec_path").isNotNull())).orderBy("first_seen", "comm", "exec_path").limit(cap)


def novel_domains(nodes: DataFrame, since: int, cap: int = CAP) -> DataFrame:
    return nodes.where((F.col("kind") == "domain") & (F.col("first_seen") >= since) & ~F.coalesce("masked", F.lit(False))).select("id", "first_seen").orderBy("first_seen", "id").limit(cap)


def novel_endpoints(nodes: DataFrame, since: int, cap: int = CAP) -> DataFrame:
    g = nodes.where("kind = 'socket' and foreign_addr is not null").groupBy("foreign_addr").agg(F.min("first_seen").alias("first_seen"), F.count(F.lit(1)).alias("connections"), F.max("process_name").alias("example"))
    return g.where(F.col("first_seen") >= since).orderBy("first_seen", "foreign_addr").limit(cap)


def novel_apps(nodes: DataFrame, since: int, cap: int = CAP) -> DataFrame:
    return nodes.where((F.col("kind") == "app") & (F.col("first_seen") >= since)).select("id", "name", "first_seen").orderBy("first_seen", "id").limit(cap)


def oldest(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.min("first_seen").alias("oldest"))


def baseline_cold(nodes: DataFrame, since: int, slack_ns: int = 30 * 60 * SECOND) -> DataFrame:
    """cold: whether history is too short to call anything new."""
    return oldest(nodes).select(F.coalesce(F.col("oldest") > since - slack_ns, F.lit(True)).alias("cold"))


def events_in_window(events: DataFrame, start: int, end: int, kinds: list[str] | None = None, n: int | None = None) -> DataFrame:
    e = events.where(F.col("ts_ns").between(start, end))
    e = e.where(F.col("kind").isin(kinds)) if kinds else e
    e = e.orderBy("ts_ns", "seq")
    return e if n is None else e.limit(n)


def hourly_profile(events: DataFrame, since: int = 0) -> DataFrame:
    return events.where(F.col("ts_ns") >= since).groupBy("kind", F.expr(f"(ts_ns div {HOUR}) % 24").alias("hour_of_day")).agg(F.count(F.lit(1)).alias("n"))


def field_window_counts(events: DataFrame, kind: str, field: str, since: int = 0, width: int = HOUR) -> DataFrame:
    """value, window_start, n of a field of one kind of events; events without it don't count."""
    e = events.where((F.col("kind") == kind) & (F.col("ts_ns") >= since) & F.col(field).isNotNull())
    return e.groupBy(F.col(field).cast("string").alias("value"), F.expr(f"(ts_ns div {width}) * {width}").alias("window_start")).agg(F.count(F.lit(1)).alias("n"))


def edge_rates(edges: DataFrame, kind: str) -> DataFrame:
    return edges.where(F.col("kind") == kind).select("from_id", "to_id", "count", "first_seen", "last_seen")


def daemon_status(pid, heartbeat_ns, now_ns, stale_ns: int = 120 * SECOND):
    """never ran, stopped cleanly, alive or stale."""
    return F.when(heartbeat_ns.isNull(), "never ran").when(pid.isNull(), "stopped cleanly").when(past(now_ns, heartbeat_ns) > stale_ns, "stale").otherwise("alive")


#: Tables that are dealt into buckets, by the hash of their keys.
KEYS = {"nodes": NODE_KEY, "edges": EDGE_KEY}


class Transaction:
    """Changes of a store that come into being together, or not at all.

    Tables are written to the folder of the version to come; commit() names it by creating one file, which holds the
    folders of all tables, their schemas and bounds, and the metadata. Whatever stops before that leaves files that no
    version names. read() sees what the transaction has written.
    """

    def __init__(self, store: Store):
        self.store, self.version = store, store.version() + 1
        self.about = store._about(self.version - 1)
        self.meta: dict[str, str] = self.about.setdefault("meta", {})
        self.tables: dict[str, dict] = self.about.setdefault("tables", {})

    def read(self, table: str, buckets: list[int] | None = None, since: int | None = None, until: int | None = None) -> DataFrame | None:
        """A table, or some of its buckets, or its parts that may hold times from since to until; None if there is none."""
        about = self.tables.get(table)
        if about is None:
            return None
        if "parts" in about:
            folders = [p["folder"] for p in about["parts"] if (since is None or p["high"] >= since) and (until is None or p["low"] <= until)]
        else:
            folders = [f for b, f in about["buckets"].items() if buckets is None or int(b) in buckets]
        schema, spark = StructType.fromJson(about["schema"]), self.store.spark
        return spark.read.schema(schema).parquet(*[f"{self.store.path}/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)

    def _folder(self, table: str) -> str:
        """Where the table's files of this version go, a new folder each time."""
        return f"version-{self.version}/{table}-{uuid.uuid4().hex[:8]}"

    def put(self, table: str, frame: DataFrame, keys: list[str], buckets: list[int] | None = None) -> None:
        """Replace the whole table, or these buckets of it, by the rows of frame (that belong there)."""
        about = self.tables.setdefault(table, {"buckets": {}})
        about["schema"], folder = json.loads(frame.schema.json()), self._folder(table)
        rows = frame.withColumn("__bucket", self.store.bucket(keys))
        if buckets is not None:
            rows = rows.where(F.col("__bucket").isin(buckets))
        rows.repartition("__bucket").sortWithinPartitions("__bucket", *keys).write.partitionBy("__bucket").parquet(f"{self.store.path}/{folder}")
        there = {int(n.split("=")[1]): f"{folder}/{n}" for n in self.store._names(folder) if "=" in n}
        for b in [int(x) for x in about["buckets"]] if buckets is None else buckets:
            about["buckets"].pop(str(b), None)
        about["buckets"].update({str(b): f for b, f in there.items()})
        about["prints"] = {b: x for b, x in about.get("prints", {}).items() if buckets is not None and int(b) not in buckets}

    def declare(self, table: str, frame: DataFrame) -> None:
        """Have a table of this schema, empty if there is none."""
        self.tables.setdefault(table, {"schema": json.loads(frame.schema.json()), "buckets": {}})

    def put_changed(self, table: str, frame: DataFrame, keys: list[str]) -> list[int]:
        """Make the table equal to frame, writing only buckets whose rows differ, by two 64-bit fingerprints and the count
        of each; which. frame is read twice."""
        whole = [F.to_json(F.struct(*frame.columns))]
        prints = [F.bit_xor(F.xxhash64(*whole)), F.bit_xor(F.xxhash64(F.lit(1), *whole)), F.count(F.lit(1))]
        now = {str(r[0]): ":".join(str(x) for x in r[1:]) for r in frame.groupBy(self.store.bucket(keys)).agg(*prints).collect()}  # a row a bucket
        self.declare(table, frame)
        about = self.tables[table]
        was = about.get("prints", {})
        changed = sorted(int(b) for b in {*now, *about["buckets"]} if b not in now or now[b] != was.get(b))
        if changed:
            self.put(table, frame, keys, changed)
        about["prints"] = now
        return changed

    def fold(self, table: str, frame: DataFrame, keys: list[str], merged) -> None:
        """Combine rows with those of the table that lie in the same buckets: merged(old or None, new)."""
        touched = [r[0] for r in frame.select(self.store.bucket(keys).alias("b")).distinct().collect()]  # at most as many as buckets
        if touched:
            self.put(table, merged(self.read(table, touched), frame), keys, touched)

    def append(self, table: str, frame: DataFrame, time_column: str = "ts_ns") -> int:
        """Add rows as new parts, a part a day, with the bounds of their times. A day of FAN parts becomes one."""
        about = self.tables.get(table)
        if about is not None:
            names = [f["name"] for f in about["schema"]["fields"]]
            frame = frame.select(*names, *[c for c in frame.columns if c not in names])
            about["schema"] = json.loads(frame.schema.json())
        about = self.tables.setdefault(table, {"schema": json.loads(frame.schema.json()), "parts": []})
        fresh = self._parts(table, frame, time_column)
        about["parts"] += fresh
        days = Counter(p["day"] for p in about["parts"])
        full = [d for d, n in days.items() if n >= self.store.FAN]
        if full:
            old = [p for p in about["parts"] if p["day"] in full]
            whole = self.store.spark.read.schema(frame.schema).parquet(*[f"{self.store.path}/{p['folder']}" for p in old])
            about["parts"] = [p for p in about["parts"] if p["day"] not in full] + self._parts(table, whole, time_column)
        return sum(p["rows"] for p in fresh)

    def _parts(self, table: str, frame: DataFrame, time_column: str) -> list[dict]:
        folder = self._folder(table)
        rows = frame.withColumn("__day", F.expr(f"{time_column} div {DAY}"))
        rows.sortWithinPartitions("__day", *[c for c in ("kind", time_column) if c in frame.columns]).write.partitionBy("__day").parquet(f"{self.store.path}/{folder}")
        back = self.store.spark.read.schema(StructType([*frame.schema.fields, StructField("__day", LongType())])).parquet(f"{self.store.path}/{folder}")
        bounds = back.groupBy("__day").agg(F.min(time_column), F.max(time_column), F.count(F.lit(1))).collect()  # a row a day
        of = lambda d: "__HIVE_DEFAULT_PARTITION__" if d is None else d
        return [{"folder": f"{folder}/__day={of(d)}", "day": d, "low": lo or 0, "high": hi or 0, "rows": n} for d, lo, hi, n in bounds]

    def cut(self, table: str, cutoff: int, time_column: str = "ts_ns") -> int:
        """Drop rows before the cutoff: parts that end before it unread, those that begin before it rewritten; how many."""
        about = self.tables.get(table)
        if about is None:
            return 0
        split = [p for p in about["parts"] if p["low"] < cutoff <= p["high"]]
        kept = [p for p in about["parts"] if p["low"] >= cutoff]
        if split:
            rows = self.store.spark.read.schema(StructType.fromJson(about["schema"])).parquet(*[f"{self.store.path}/{p['folder']}" for p in split])
            kept += self._parts(table, rows.where(F.col(time_column) >= cutoff), time_column)
        gone = sum(p["rows"] for p in about["parts"]) - sum(p["rows"] for p in kept)
        about["parts"] = kept
        return gone

    def drop(self, *tables: str) -> None:
        for t in tables:
            self.tables.pop(t, None)

    def commit(self) -> int:
        """Name the version; an error if another writer has."""
        if not self.store._put(f"versions/{self.version}", json.dumps(self.about), over=False):
            raise RuntimeError(f"version {self.version} was written by another writer")
        self.store._clear()
        return self.version


class Store:
    """Tables in a folder: nodes and edges in buckets of their keys, events in parts by day, and metadata.

    A version is one small file in `versions` that names the folders of all tables and holds the metadata: the highest
    one counts. It is created, whole, after its tables are written (see Transaction), so that a crash at any point leaves
    the version before. A new version names the folders of the one before wherever nothing has changed: a merge writes
    the buckets that its keys lie in, new events are new parts. Versions other than the newest KEPT are removed, with the
    folders that only they name. There is one writer at a time: see lock().
    """

    KEPT, BUCKETS, FAN, STALE_NS = 2, 16, 16, 120 * SECOND

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        """buckets: of a new store; as many as a task each can hold a share of the nodes."""
        self.spark, self.path = spark, path.rstrip("/")
        found = json.loads(self._get("meta.json") or "{}")
        version = int(found.get("schema_version", SCHEMA_VERSION))
        if version > SCHEMA_VERSION:
            raise ValueError(f"the store has schema version {version}, newer than {SCHEMA_VERSION}")
        if version < SCHEMA_VERSION:
            raise ValueError(f"the store has schema version {version}; this library writes {SCHEMA_VERSION} and reads no older one")
        if not found:
            found = {"schema_version": str(SCHEMA_VERSION), "buckets": buckets or self.BUCKETS}
            self._put("meta.json", json.dumps(found))
        self.buckets = int(found["buckets"])

    def bucket(self, keys: list[str]):
        return F.expr(f"cast(pmod(xxhash64({', '.join(f'`{k}`' for k in keys)}), {self.buckets}) as int)")

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _get(self, name: str) -> str | None:
        fs, p = self._fs(name)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(b & 0xFF for b in stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, name: str, text: str, over: bool = True) -> bool:
        """Write a small file; without over, only if there is none yet. It is written under another name first, so that
        it is there whole or not at all."""
        fs, p = self._fs(name)
        if not over and fs.exists(p):
            return False
        _, draft = self._fs(f"drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.mkdirs(p.getParent())
        if over:
            fs.delete(p, False)
        done = fs.rename(draft, p)
        if not done:
            fs.delete(draft, False)
            if over or not fs.exists(p):
                raise OSError(f"{self.path}/{name} can't be written")
        return done

    def _delete(self, name: str, whole: bool = False) -> None:
        fs, p = self._fs(name)
        fs.delete(p, whole)

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _versions(self) -> list[int]:
        return sorted(int(x) for x in self._names("versions") if x.isdigit())

    def version(self) -> int:
        return max(self._versions(), default=0)

    def _about(self, v: int) -> dict:
        """What a version names: tables and meta."""
        return json.loads(self._get(f"versions/{v}")) if v else {}

    def begin(self) -> Transaction:
        return Transaction(self)

    def get_meta(self, key: str) -> str | None:
        if key == "schema_version":
            return str(SCHEMA_VERSION)
        return self._about(self.version()).get("meta", {}).get(key)

    def set_meta(self, key: str, value: str | None) -> None:
        if key == "schema_version":
            raise ValueError("schema_version can't be set")
        tx = self.begin()
        tx.meta.pop(key, None) if value is None else tx.meta.update({key: value})
        tx.commit()

    @contextmanager
    def lock(self):
        """Hold the store for writing; an error if another does. A lock whose holder hasn't shown itself for STALE_NS (see
        beat()) was left by a crash and is taken over; should its holder live after all, the version file that both would
        create goes to one of them."""
        held = self._get("LOCK")
        if held is not None and time.time_ns() - int(held.split()[0]) > self.STALE_NS:
            self._delete("LOCK")
        self.owner = uuid.uuid4().hex
        if not self._put("LOCK", f"{time.time_ns()} {self.owner}", over=False):
            raise RuntimeError(f"{self.path} is held by another writer (LOCK)")
        try:
            yield self
        finally:
            if (self._get("LOCK") or "").endswith(self.owner):
                self._delete("LOCK")

    def beat(self) -> None:
        """Show that the holder of the lock lives; an error if it was taken over."""
        owner = getattr(self, "owner", None)
        if owner is not None and (held := self._get("LOCK")) is not None:
            if not held.endswith(owner):
                raise RuntimeError(f"the lock of {self.path} was taken over")
            self._put("LOCK", f"{time.time_ns()} {owner}")

    def read(self, table: str, since: int | None = None, until: int | None = None) -> DataFrame | None:
        """A table; of events, only the parts that may hold times from since to until."""
        return self.begin().read(table, since=since, until=until)

    def events_in_window(self, start: int, end: int, kinds: list[str] | None = None, n: int | None = None) -> DataFrame | None:
        """events_in_window() over the parts whose bounds meet the window; no other file is opened."""
        e = self.read("events", start, end)
        return None if e is None else events_in_window(e, start, end, kinds, n)

    def _clear(self) -> None:
        """Remove versions but the newest ones, and folders that these don't name."""
        versions = self._versions()
        named = set()
        for v in versions[-self.KEPT :]:
            for t in self._about(v).get("tables", {}).values():
                named |= {f for f in t.get("buckets", {}).values()} | {p["folder"] for p in t.get("parts", [])}
        for v in versions[: -self.KEPT]:
            self._delete(f"versions/{v}")
        for top in self._names("."):
            if top.startswith("version-"):
                live = {f for f in named if f.startswith(top + "/")}
                if not live:
                    self._delete(top, True)
                    continue
                for table in self._names(top):
                    inside = {f.split("/")[2] for f in live if f.split("/")[1] == table}
                    if not inside:
                        self._delete(f"{top}/{table}", True)
                        continue
                    for part in self._names(f"{top}/{table}"):
                        if "=" in part and part not in inside:
                            self._delete(f"{top}/{table}/{part}", True)

    def merge_graph(self, nodes: DataFrame, edges: DataFrame) -> dict[str, int]:
        """Merge nodes and edges (with seen_at), writing only buckets with keys of theirs; how many were inserted and
        updated. What a capture has folded so far becomes part of what is merged with."""
        tx, seen = self.begin(), {}
        nodes, edges = written(nodes, "new-nodes"), written(edges, "new-edges")
        none = edges.limit(0).select(*EDGE_KEY, F.lit(0).cast("long").alias("count"), F.col("seen_at").alias("first_seen"), F.col("seen_at").alias("last_seen"), *[c for c in edges.columns if c not in (*EDGE_KEY, "seen_at", "count", "first_seen", "last_seen")])

        def by(table: str, rule, empty: DataFrame):
            def merged(old: DataFrame | None, new: DataFrame) -> DataFrame:
                rows = written(rule(old if old is not None else empty, new), "merged")
                seen.update({f"{table}_{r['how']}": r["count"] for r in rows.where("how <> 'kept'").groupBy("how").count().collect()})
                scratch.append(rows)
                return rows.drop("how")

            return merged

        scratch = [nodes, edges]
        tx.fold("nodes", nodes, NODE_KEY, by("nodes", merge_nodes, nodes.limit(0)))
        tx.fold("edges", edges, EDGE_KEY, by("edges", merge_edges, none))
        for t, empty in (("nodes", nodes.limit(0)), ("edges", none)):
            if t not in tx.tables:
                tx.put(t, empty, KEYS[t])
        tx.drop(*[t for t in tx.tables if t.startswith(("fold_", "base_"))])
        tx.commit()
        for rows in scratch:
            drop_written(rows)
        return seen

    def merge_typed(self, graph: dict[str, DataFrame]) -> dict[str, int]:
        """Merge a typed graph (see persist): edges are seen when their target was, by the merged nodes."""
        from telemill.operators.persist import edge_rows, node_rows

        new = node_rows(graph)
        old = self.read("nodes")
        merged = new if old is None else merge_nodes(old, new)
        return self.merge_graph(new, edge_rows(graph, merged))

    def load_graph(self) -> dict[str, DataFrame]:
        """The typed graph of the store, empty if it has none."""
        from telemill.operators.persist import ATTRIBUTES, EDGE, load

        columns = lambda more: ", ".join(f"`{c}` {t}" for c, t in more.items())
        nodes, edges = self.read("nodes"), self.read("edges")
        if nodes is None:
            nodes = self.spark.createDataFrame([], "kind string, id string, first_seen long, last_seen long, " + columns(ATTRIBUTES))
            edges = self.spark.createDataFrame([], "kind string, from_kind string, from_id string, to_kind string, to_id string, count long, first_seen long, last_seen long, " + columns(EDGE))
        return load(nodes, edges)

    def append_events(self, events: DataFrame) -> int:
        """Add events (with ts_ns and kind); how many."""
        tx = self.begin()
        n = tx.append("events", events)
        tx.commit()
        return n

    def prune_before(self, cutoff: int, meta: dict[str, str] | None = None) -> dict[str, int]:
        """Drop what is older than the cutoff; counts of what went. A store without a table has nothing of it to prune."""
        from telemill.operators.fold import trim

        tx = self.begin()
        n, e = tx.read("nodes"), tx.read("edges")
        empty_n, empty_e, empty_v = "kind string, id string, last_seen long", "kind string, from_kind string, from_id string, to_kind string, to_id string, last_seen long", "kind string, ts_ns long"
        none = lambda text: self.spark.createDataFrame([], text)
        out = prune(n if n is not None else none(empty_n), e if e is not None else none(empty_e), none(empty_v), cutoff)
        report = out["report"].first().asDict() | {"events": tx.cut("events", cutoff)}
        if any(report.values()):
            for t, had in (("nodes", n), ("edges", e)):
                if had is not None:
                    rows = written(out[t], "kept")
                    tx.put_changed(t, rows, KEYS[t])
                    drop_written(rows)
            trim(tx, cutoff)
        if any(report.values()) or meta:
            tx.meta.update(meta or {})
            tx.commit()
        return report
