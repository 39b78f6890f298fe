"""Telemetry derived from the test tables, as DataFrames, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.functions.scalars import DAY, SECOND, held

GAP = 600 * SECOND
EPOCH = 788918400 * SECOND


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _ns(c: str):
    return F.unix_micros(F.col(c).cast("timestamp")) * 1000


def obs(spark: SparkSession, d: str) -> DataFrame:
    """obs_seq, t, source, pid, k, start, path, flags, event_id of every event."""
    e = _table(spark, d, "events")
    source = F.element_at(F.create_map(*[F.lit(x) for x in ("signup", "process", "view", "network", "purchase", "file_system", "click", "window", "error", "dns")]), F.col("event_type"))
    k = F.get_json_object("props", "$.k").cast("long")
    o = e.select(F.col("event_id").alias("obs_seq"), _ns("ts").alias("t"), source.alias("source"), F.col("user_id").alias("pid"), k.alias("k"), "value")
    return o.withColumns({"start": F.expr("k div 50"), "path": F.expr("concat('/p/', k % 7, '/', k)"), "flags": F.expr("array(concat('f', k % 5), concat('g', k % 2))"), "event_id": F.expr("k % 4"), "local_addr": F.expr("concat('l', pid)"), "foreign_addr": F.expr("concat('f', k)"), "proto": F.lit("tcp4")})


OBS = """obs as (select event_id as obs_seq, epoch_us(ts) * 1000 as t, case event_type when 'signup' then 'process' when 'view' then 'network' when 'purchase' then 'file_system' when 'click' then 'window' else 'dns' end as source,
  user_id as pid, cast(json_extract_string(props, '$.k') as bigint) as k, value, cast(json_extract_string(props, '$.k') as bigint) // 50 as start from events)"""


def ev(spark: SparkSession, d: str) -> DataFrame:
    """A canonical event history: seq, t, ts_ns, kind, pid and the fields of all kinds."""
    e = _table(spark, d, "events").select(F.col("event_id").alias("seq"), _ns("ts").alias("t"), "event_type", F.col("user_id").alias("pid"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.selectExpr(
        "seq", "t", "t as ts_ns", "pid", "k",
        "case event_type when 'signup' then if(k % 2 = 0, 'process_birth', 'process_death') when 'view' then element_at(array('connection_opened', 'connection_closed', 'connection_completed'), cast(k % 3 + 1 as int)) when 'purchase' then 'file_changed' when 'click' then 'app_focus' else 'dns_query' end as kind",
        "k div 50 as start", "concat('proc', pid % 20) as comm", "cast(null as string) as name", "case k % 4 when 0 then concat('/usr/bin/p', pid % 7) when 1 then concat('/opt/x/p', pid % 7) when 2 then concat('/bin/p', pid % 7) end as exec_path",
        "pid div 10 as ppid", "if(pid % 5 = 0, 0, 500 + pid % 5) as uid", "'tcp4' as proto", "concat('10.0.0.', pid % 250, '.', 1000 + k) as local_addr",
        "case k % 6 when 0 then concat('1.2.3.', pid % 9, '.22') when 1 then concat('1.2.3.', pid % 9, '.443') when 2 then '2607:f8b0::200e.4444' when 3 then 'example.com' when 4 then '9.9.9.9.3389' else '8.8.8.8.53' end as foreign_addr",
        "concat('proc', pid % 20) as process_name", "cast(floor(value * 100) as bigint) as rx", "k * 10 as tx", "k * 1234567 as duration_ns", "concat('/p/', k % 7, '/', k % 3, '/a/b/', k) as path", "array(concat('f', k % 5), concat('g', k % 2)) as flags", "1 + k % 3 as count",
        "concat('app', k % 10) as to_bundle", "if(k % 10 = 3, null, concat('App ', k % 10)) as to_name", "concat('d', k, '.example.') as qname", "if(k % 2 = 0, 'A', 'AAAA') as qtype", "k % 4 = 0 as masked", "concat('h', k) as name_hash", "concat('proc', pid % 20) as client",
    )


EV = """raw as (select event_id as seq, epoch_us(ts) * 1000 as t, event_type, user_id as pid, value, cast(json_extract_string(props, '$.k') as bigint) as k from events),
ev as (select seq, t, t as ts_ns, pid, k,
  case event_type when 'signup' then case when k % 2 = 0 then 'process_birth' else 'process_death' end when 'view' then ['connection_opened', 'connection_closed', 'connection_completed'][k % 3 + 1] when 'purchase' then 'file_changed' when 'click' then 'app_focus' else 'dns_query' end as kind,
  k // 50 as start, concat('proc', pid % 20) as comm, case k % 4 when 0 then concat('/usr/bin/p', pid % 7) when 1 then concat('/opt/x/p', pid % 7) when 2 then concat('/bin/p', pid % 7) end as exec_path,
  pid // 10 as ppid, case when pid % 5 = 0 then 0 else 500 + pid % 5 end as uid, 'tcp4' as proto, concat('10.0.0.', pid % 250, '.', 1000 + k) as local_addr,
  case k % 6 when 0 then concat('1.2.3.', pid % 9, '.22') when 1 then concat('1.2.3.', pid % 9, '.443') when 2 then '2607:f8b0::200e.4444' when 3 then 'example.com' when 4 then '9.9.9.9.3389' else '8.8.8.8.53' end as foreign_addr,
  case k % 6 when 0 then 22 when 1 then 443 when 2 then 4444 when 4 then 3389 when 5 then 53 end as port,
  concat('proc', pid % 20) as process_name, cast(floor(value * 100) as bigint) as rx, k * 10 as tx, k * 1234567 as duration_ns, concat('/p/', k % 7, '/', k % 3, '/a/b/', k) as path, [concat('f', k % 5), concat('g', k % 2)] as flags, 1 + k % 3 as count,
  concat('app', k % 10) as to_bundle, case when k % 10 = 3 then null else concat('App ', k % 10) end as to_name, concat('d', k, '.example.') as qname, case when k % 2 = 0 then 'A' else 'AAAA' end as qtype, k % 4 = 0 as masked, concat('h', k) as name_hash, concat('proc', pid % 20) as client,
  case when k % 4 = 0 then concat('hash:h', k) else concat('d', k, '.example') end as domain from raw)"""

_NODE = ["kind", "id", "first_seen", "last_seen", "pid", "comm", "exec_path", "uid", "foreign_addr", "rx", "tx", "pid_at_open", "process_name", "name", "query_count", "masked"]
_TYPES = dict(zip(_NODE, "string string bigint bigint bigint string string bigint string bigint bigint bigint string string bigint boolean".split(), strict=True))


def _as_nodes(frame: DataFrame, kind: str) -> DataFrame:
    f = frame.withColumn("kind", F.lit(kind))
    return f.select(*[(F.col(c) if c in f.columns else F.lit(None)).cast(t).alias(c) for c, t in _TYPES.items()])


def people(spark: SparkSession, d: str) -> DataFrame:
    """Customers with orders as processes."""
    seen = _table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(_ns("o_orderdate")).alias("first_seen"), F.max(_ns("o_orderdate")).alias("last_seen"))
    c = _table(spark, d, "customer").join(seen, "c_custkey")
    return c.selectExpr("concat(c_custkey, ':', c_nationkey) as id", "first_seen", "last_seen", "c_custkey as pid", "c_nationkey", "concat('c', c_custkey % 50) as comm", "case c_custkey % 4 when 0 then concat('/usr/bin/x', c_custkey % 9) when 1 then concat('/opt/tool', c_custkey % 9) when 2 then '/bin/y' end as exec_path", "if(c_custkey % 7 = 0, 0, 500 + c_nationkey) as uid")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    p = people(spark, d)
    o = _table(spark, d, "orders").withColumn("first_seen", _ns("o_orderdate"))
    s = o.selectExpr("concat('s', o_orderkey) as id", "if(o_orderkey % 30 = 0, null, concat('10.0.', o_custkey % 20, '.', o_orderkey % 50, '.443')) as foreign_addr", "cast(floor(o_totalprice) as bigint) as rx", "if(o_orderkey % 9 = 0, null, o_orderkey % 1000) as tx", "o_custkey as pid_at_open", "concat('c', o_custkey % 50) as process_name", "first_seen", f"first_seen + (o_orderkey % 5) * {DAY} as last_seen")
    g = _table(spark, d, "part").groupBy("p_brand").agg(F.sum("p_size").alias("query_count"), F.min("p_partkey").alias("a"), F.max("p_partkey").alias("b"))
    m = g.select(F.expr("concat(lower(p_brand), '.example') as id"), "query_count", F.expr("a % 4 = 0 as masked"), held(EPOCH, "a", DAY).alias("first_seen"), held(EPOCH, "b", DAY).alias("last_seen"))
    n = p.groupBy("c_nationkey").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")).join(_table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    a = n.selectExpr("concat('app', n_nationkey) as id", "if(n_nationkey % 5 = 0, null, n_name) as name", "first_seen", "last_seen")
    return _as_nodes(p, "process").union(_as_nodes(s, "socket")).union(_as_nodes(m, "domain")).union(_as_nodes(a, "app"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    p = people(spark, d).select("id", "pid", "first_seen", "last_seen", "c_nationkey")
    parents = p.select(F.col("pid").alias("ppid"), F.col("id").alias("from_id"))
    none = [F.lit(None).cast("long").alias("overlap_from"), F.lit(None).cast("long").alias("overlap_to")]

    def edge(f: DataFrame, kind: str, a: str, b: str, *overlap) -> DataFrame:
        return f.select(F.lit(kind).alias("kind"), F.lit(a).alias("from_kind"), "from_id", F.lit(b).alias("to_kind"), "to_id", F.lit(1).cast("long").alias("count"), "first_seen", "last_seen", *(overlap or none))

    one = p.withColumn("ppid", F.expr("pid div 10")).join(parents, "ppid").where("ppid <> pid").withColumnRenamed("id", "to_id")
    o = _table(spark, d, "orders").select(F.col("o_custkey").alias("pid"), F.concat(F.lit("s"), "o_orderkey").alias("to_id"), _ns("o_orderdate").alias("first_seen"), (_ns("o_orderdate") + F.expr(f"(o_orderkey % 5) * {DAY}")).alias("last_seen"))
    two = o.join(p.select("pid", F.col("id").alias("from_id")), "pid")
    part = _table(spark, d, "part").select(F.col("p_partkey").alias("pid"), F.expr("concat(lower(p_brand), '.example')").alias("to_id"))
    three = p.where("pid % 5 = 0").join(part, "pid").withColumnRenamed("id", "from_id")
    four = p.where("pid % 3 = 0").select(F.expr("concat('app', c_nationkey)").alias("from_id"), F.col("id").alias("to_id"), "first_seen", "last_seen", F.col("first_seen").alias("overlap_from"), F.expr("if(pid % 4 = 0, null, last_seen)").alias("overlap_to"))
    return edge(one, "parent_of", "process", "process").union(edge(two, "opened_socket", "process", "socket")).union(edge(three, "queried_domain", "process", "domain")).union(edge(four, "frontmost_during", "app", "process", "overlap_from", "overlap_to"))


STORE = f"""people as (select concat(c_custkey, ':', c_nationkey) as id, first_seen, last_seen, c_custkey as pid, c_nationkey, concat('c', c_custkey % 50) as comm,
  case c_custkey % 4 when 0 then concat('/usr/bin/x', c_custkey % 9) when 1 then concat('/opt/tool', c_custkey % 9) when 2 then '/bin/y' end as exec_path, case when c_custkey % 7 = 0 then 0 else 500 + c_nationkey end::bigint as uid
  from customer join (select o_custkey as c_custkey, min(epoch_us(o_orderdate)) * 1000 as first_seen, max(epoch_us(o_orderdate)) * 1000 as last_seen from orders group by 1) using (c_custkey)),
sockets as (select concat('s', o_orderkey) as id, case when o_orderkey % 30 = 0 then null else concat('10.0.', o_custkey % 20, '.', o_orderkey % 50, '.443') end as foreign_addr, cast(floor(o_totalprice) as bigint) as rx,
  case when o_orderkey % 9 = 0 then null else o_orderkey % 1000 end as tx, o_custkey as pid_at_open, concat('c', o_custkey % 50) as process_name, epoch_us(o_orderdate) * 1000 as first_seen, epoch_us(o_orderdate) * 1000 + (o_orderkey % 5) * {DAY} as last_seen from orders),
domains as (select concat(lower(p_brand), '.example') as id, sum(p_size)::bigint as query_count, min(p_partkey) % 4 = 0 as masked, {EPOCH} + min(p_partkey) * {DAY} as first_seen, {EPOCH} + max(p_partkey) * {DAY} as last_seen from part group by p_brand),
apps as (select concat('app', n_nationkey) as id, case when n_nationkey % 5 = 0 then null else n_name end as name, f as first_seen, l as last_seen from nation join (select c_nationkey, min(first_seen) as f, max(last_seen) as l from people group by 1) x on c_nationkey = n_nationkey),
nodes as (select 'process' as kind, id, first_seen, last_seen from people union all select 'socket', id, first_seen, last_seen from sockets union all select 'domain', id, first_seen, last_seen from domains union all select 'app', id, first_seen, last_seen from apps),
edges as (select 'parent_of' as kind, 'process' as from_kind, p.id as from_id, 'process' as to_kind, c.id as to_id, 1::bigint as count, c.first_seen, c.last_seen, null::bigint as overlap_from, null::bigint as overlap_to from people c join people p on p.pid = c.pid // 10 and p.pid <> c.pid
  union all select 'opened_socket', 'process', p.id, 'socket', s.id, 1, s.first_seen, s.last_seen, null, null from sockets s join people p on p.pid = s.pid_at_open
  union all select 'queried_domain', 'process', p.id, 'domain', concat(lower(p_brand), '.example'), 1, p.first_seen, p.last_seen, null, null from people p join part on p_partkey = p.pid where p.pid % 5 = 0
  union all select 'frontmost_during', 'app', concat('app', c_nationkey), 'process', id, 1, first_seen, last_seen, first_seen, case when pid % 4 = 0 then null else last_seen end from people where pid % 3 = 0)"""


#: The first second of 2024, and the middle of the events' month.
START = 1704067200 * SECOND
MIDDLE = START + 15 * DAY


def bipartite(spark: SparkSession, d: str, until: int | None = None, since: int = 0) -> tuple[DataFrame, DataFrame]:
    """Users and keys of errors, by day of the week, as a graph: nodes (id, label), edges (src, dst, weight)."""
    e = ev(spark, d).where((F.col("kind") == "dns_query") & (F.col("t") >= since))
    e = e if until is None else e.where(F.col("t") < until)
    day = F.expr(f"concat('@', (t div {DAY}) % 7)")
    e = e.select(F.concat(F.lit("u"), "pid", day).alias("src"), F.concat(F.lit("k"), "k", day).alias("dst"), F.lit(1).cast("long").alias("weight"))
    n = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return n.withColumn("label", F.upper("id")), e


def bipartite_sql(name: str, until: int | None = None, since: int = 0) -> str:
    """The same graph (name_e, name_n), degrees (name_d) and components (name_c)."""
    before = "" if until is None else f" and t < {until}"
    return f"""{name}_e as (select concat('u', pid, '@', (t // {DAY}) % 7) as src, concat('k', k, '@', (t // {DAY}) % 7) as dst, 1::bigint as weight from ev where kind = 'dns_query' and t >= {since}{before}),
{name}_n as (select distinct id, upper(id) as label from (select src as id from {name}_e union all select dst from {name}_e)),
{name}_b as (select src as node, dst as other, weight from {name}_e union all select dst, src, weight from {name}_e),
{name}_d as (select n.id, n.label, count(b.node)::bigint as degree, count(distinct b.other)::bigint as distinct_degree, coalesce(sum(b.weight), 0)::bigint as weighted from {name}_n n left join {name}_b b on b.node = n.id group by 1, 2),
{name}_c(id, component) using key (id) as (select id, id from {name}_n union (
  select b.node, min(c.component) from {name}_c c join {name}_b b on b.other = c.id join recurring.{name}_c p on p.id = b.node where c.component < p.component group by 1))"""
