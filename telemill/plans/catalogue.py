"""The queries: each operator on the derived telemetry, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.functions import scalars as S
from telemill.functions.scalars import DAY, HOUR, SECOND
from telemill.operators import analytics, baseline, enrich, graph, lifecycle, narrate, persist, store, summary, ticks
from telemill.plans import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

T0, MID, SINCE = V.START, 978307200 * SECOND, 946684800 * SECOND  # 2024, 2001, 2000
SHORT = 2 * DAY
PREFIXES = ("/usr/bin/", "/bin/")


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def with_(*ctes: str, select: str) -> str:
    return "with recursive " + ",\n".join(c for c in ctes if c) + "\n" + select


# -- ticks and snapshot differences

TICKED = f"""g as (select *, case when t - lag(t) over (partition by source order by obs_seq) > {V.GAP} then 1 else 0 end as nw from obs),
ticked as (select *, sum(nw) over (partition by source order by obs_seq rows unbounded preceding)::bigint as tick from g),
tt as (select source, tick, count(*) as n, min(t) as first_t, max(t) as last_t, min(obs_seq) as first_seq from ticked group by 1, 2),
tl as (select *, lead(first_seq) over w as seq1, lead(first_seq, 2) over w as seq2, lead(last_t) over w as last1, max(tick) over (partition by source) as last_tick from tt window w as (partition by source order by tick))"""


@query(with_(V.OBS, TICKED, select="select source, tick, n, first_t, last_t from tt"))
def tick_sessions(spark, d):
    return ticks.tick_table(ticks.with_ticks(V.obs(spark, d), V.GAP)).select("source", "tick", "n", "first_t", "last_t")


@query(with_(V.OBS, TICKED, select="select source, tick, n from tl where tick > 0 and tick < last_tick"))
def tick_first_suppressed(spark, d):
    t = ticks.tick_table(ticks.with_ticks(V.obs(spark, d), V.GAP))
    return t.where("tick > 0 and tick < last_tick").select("source", "tick", "n")


def diff_sql(source: str, keys: str) -> str:
    return f"""s as (select {keys}, tick, min(t) as first_t, max(t) as key_t from ticked where source = '{source}' group by {keys}, tick),
s1 as (select *, lag(tick) over w is distinct from tick - 1 as nw, lead(tick) over w is distinct from tick + 1 as gone from s window w as (partition by {keys} order by tick)),
s2 as (select *, sum(nw::int) over (partition by {keys} order by tick rows unbounded preceding) as island from s1),
s3 as (select *, min(first_t) over (partition by {keys}, island) as first_seen from s2),
j as (select s3.*, seq1, seq2, last1, last_tick from s3 join tl on tl.source = '{source}' and tl.tick = s3.tick)"""


BIRTHS = "select pid, start, key_t as t, first_seen, seq1 as emit_seq from j where nw and tick > 0 and tick <= last_tick - 1"
DEATHS = "select pid, start, last1 as t, first_seen, key_t as last_seen, seq2 as emit_seq from j where gone and tick < last_tick - 1"


def _process_events(spark, d):
    return lifecycle.process_events(V.obs(spark, d).where("source = 'process'"), gap_ns=V.GAP)


@query(with_(V.OBS, TICKED, diff_sql("process", "pid, start"), select=BIRTHS))
def process_births(spark, d):
    return _process_events(spark, d).where("kind = 'process_birth'").select("pid", "start", "t", "first_seen", "emit_seq")


@query(with_(V.OBS, TICKED, diff_sql("process", "pid, start"), select=DEATHS))
def process_deaths(spark, d):
    return _process_events(spark, d).where("kind = 'process_death'").select("pid", "start", "t", "first_seen", "last_seen", "emit_seq")


def _connections(spark, d):
    return lifecycle.connection_events(V.obs(spark, d).where("source = 'network'"), gap_ns=V.GAP)


@query(with_(V.OBS, TICKED, diff_sql("network", "pid, k"), select="select concat('l', pid) as local_addr, concat('f', k) as foreign_addr, key_t as t, seq1 as emit_seq from j where nw and tick > 0 and tick <= last_tick - 1"))
def connection_opened(spark, d):
    return _connections(spark, d).where("kind = 'connection_opened'").select("local_addr", "foreign_addr", "t", "emit_seq")


@query(with_(V.OBS, TICKED, diff_sql("network", "pid, k"), select="select concat('l', pid) as local_addr, concat('f', k) as foreign_addr, last1 as t, key_t as last_seen, seq2 as emit_seq from j where gone and tick < last_tick - 1"))
def connection_closed(spark, d):
    return _connections(spark, d).where("kind = 'connection_closed'").select("local_addr", "foreign_addr", "t", "last_seen", "emit_seq")


@query(with_(V.OBS, TICKED, diff_sql("network", "pid, k"), select="select concat('l', pid) as local_addr, concat('f', k) as foreign_addr, first_seen, key_t as last_seen, greatest(key_t - first_seen, 0)::bigint as duration_ns from j where gone and tick < last_tick - 1"))
def connection_completed(spark, d):
    return _connections(spark, d).where("kind = 'connection_completed'").select("local_addr", "foreign_addr", "first_seen", "last_seen", "duration_ns")


@query(with_(V.OBS, f"""f as (select *, t // {HOUR} as w, concat('/p/', k % 7, '/', k) as path from obs where source = 'file_system'),
wn as (select w, max(t) as t, lead(min(obs_seq)) over (order by w) as emit_seq from f group by w),
fl as (select w, path, unnest([concat('f', k % 5), concat('g', k % 2)]) as flag, unnest([0, 1]) as i, obs_seq from f),
ff as (select w, path, flag, min((obs_seq, i)) as o from fl group by 1, 2, 3),
fa as (select w, path, array_to_string(list(flag order by o), ',') as flags from ff group by 1, 2)""",
    select="select f.path, wn.t, wn.emit_seq, min(f.t) as first_seen, max(f.t) as last_seen, any_value(fa.flags) as flags, count(*) filter (where k % 4 <> 0) as n from f join wn on wn.w = f.w join fa on fa.w = f.w and fa.path = f.path where wn.emit_seq is not null group by f.path, wn.t, wn.emit_seq, f.w"))
def file_changed_coalesced(spark, d):
    e = lifecycle.file_events(V.obs(spark, d).where("source = 'file_system'"), HOUR)
    return e.select("path", "t", "emit_seq", "first_seen", "last_seen", F.array_join("flags", ",").alias("flags"), F.col("count").alias("n"))


@query(with_(V.OBS, "c as (select *, k % 10 as app, lag(k % 10) over (order by obs_seq) as prev from obs where source = 'window')", select="select obs_seq, pid, prev as from_app, app as to_app from c where prev is distinct from app"))
def focus_noop_drop(spark, d):
    r = V.obs(spark, d).where("source = 'window'").withColumn("app", F.expr("k % 10"))
    c = lifecycle.frontmost_changes(r, ["app"]).withColumnRenamed("from_app", "from_bundle").withColumn("to_bundle", F.col("app"))
    return lifecycle.focus_events(c).select("obs_seq", "pid", F.col("from_bundle").alias("from_app"), F.col("to_bundle").alias("to_app"))


@query(with_(V.EV, select="select seq, pid, qname, qtype, masked, domain from ev where kind = 'dns_query'"))
def dns_shape(spark, d):
    return lifecycle.dns_events(V.ev(spark, d).where("kind = 'dns_query'")).select("seq", "pid", "qname", "qtype", "masked", "domain")


@query(with_(V.OBS, select="select case source when 'network' then case when k % 2 = 0 then 'dns' else 'connection' end when 'window' then 'focus' when 'file_system' then 'file' when 'process' then 'process' end as stage, count(*) as n from obs group by 1"))
def route_counts(spark, d):
    o = V.obs(spark, d).withColumn("kind", F.when(F.col("k") % 2 == 0, "dns_query"))
    return lifecycle.route(o).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@query(with_(V.OBS, "s(source) as (values ('file_system'), ('process'), ('network'), ('window'), ('system'))", select="select s.source, count(o.source) as n, count(o.source) = 0 as silent from s left join obs o using (source) group by 1"))
def source_health(spark, d):
    every = spark.createDataFrame([(s,) for s in ("file_system", "process", "network", "window", "system")], "source string")
    n = V.obs(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, "source", "left").select("source", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.col("n").isNull().alias("silent"))


# -- enrichment


@query(with_(V.OBS, TICKED, diff_sql("process", "pid, start"), f"b as ({BIRTHS})", select="select pid, arg_max(start, (start, emit_seq)) as start, arg_max(t, (start, emit_seq)) as t from b group by pid"))
def pid_latest(spark, d):
    return enrich.latest_by_pid(_process_events(spark, d).where("kind = 'process_birth'")).select("pid", "start", "t")


@query(with_(V.OBS, TICKED, diff_sql("process", "pid, start"), f"b as ({BIRTHS}), dd as ({DEATHS})", "m as (select o.obs_seq as seq, o.pid, max((b.start, b.emit_seq)) as r from obs o join b on b.pid = o.pid and b.emit_seq < o.obs_seq where o.source = 'dns' group by 1, 2)",
    "x as (select m.seq, any_value(m.r) as r, max(dd.emit_seq) as died from m left join dd on dd.pid = m.pid and dd.start = m.r[1] and dd.emit_seq < m.seq group by 1)",
    select="select o.obs_seq as seq, o.pid, x.r[1] as start, case when x.seq is null then null else x.died is null or x.r[2] >= x.died end as alive from obs o left join x on x.seq = o.obs_seq where o.source = 'dns'"))
def asof_enrichment(spark, d):
    e = _process_events(spark, d)
    rows = V.obs(spark, d).where("source = 'dns'").select(F.col("obs_seq").alias("seq"), "pid")
    return enrich.as_of(rows, e.where("kind = 'process_birth'"), e.where("kind = 'process_death'")).select("seq", "pid", "start", "alive")


UP = """st as (select o.obs_seq as seq, o.source, o.pid, max((b.start, b.emit_seq)) as r from obs o join b on b.pid = o.pid and b.emit_seq < o.obs_seq where o.source in ('dns', 'network') group by 1, 2, 3),
up(seq, hop, pid, start) as (select seq, 0, pid, r[1] from st union all select u.seq, u.hop + 1, b.pid, max((b.start, b.emit_seq))[1] from up u join b on b.pid = u.pid // 10 and b.pid > 1 and b.emit_seq < u.seq where u.hop < 32 group by 1, 2, 3)"""


@query(with_(V.OBS, TICKED, diff_sql("process", "pid, start"), f"b as ({BIRTHS})", UP, select="""select o.obs_seq as seq, case o.source when 'dns' then 'dns_query' when 'network' then 'connection_opened' when 'window' then 'app_focus' else 'file_changed' end as kind, st.r[1] as start,
  case when st.seq is not null then coalesce((select array_to_string(list(concat(u.pid, ':', u.start) order by hop), ' ') from up u where u.seq = o.obs_seq and hop > 0), '') end as ancestors from obs o left join st on st.seq = o.obs_seq where o.source <> 'process'"""))
def enriched_events(spark, d):
    e = _process_events(spark, d).withColumns({"ppid": F.expr("pid div 10"), "comm": F.concat(F.lit("c"), "pid")})
    kind = F.when(F.col("source") == "dns", "dns_query").when(F.col("source") == "network", "connection_opened").when(F.col("source") == "window", "app_focus").otherwise("file_changed")
    rows = V.obs(spark, d).where("source <> 'process'").select(F.col("obs_seq").alias("seq"), "pid", kind.alias("kind"))
    r = enrich.enriched(rows, e.where("kind = 'process_birth'"), e.where("kind = 'process_death'"), attrs=["comm"])
    shown = F.array_join(F.transform("ancestors", lambda x: F.concat_ws(":", x.pid, x.start)), " ")
    return r.select("seq", "kind", F.col("process.start").alias("start"), shown.alias("ancestors"))


@query("with recursive p as (select conv_id, turn from conversations), up as (select c.conv_id, c.turn, 1 as hop, p.turn as ancestor from p c join p on p.conv_id = c.conv_id and p.turn = c.turn - 1 union all select u.conv_id, u.turn, hop + 1, p.turn from up u join p on p.conv_id = u.conv_id and p.turn = u.ancestor - 1) select conv_id, turn, hop, ancestor from up")
def ancestors_chain(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn") + 1000).alias("id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") + 999).alias("parent"))
    known = c.select(F.col("id").alias("parent"))
    parents = c.where("parent is not null").join(known, "parent", "left_semi").select(F.col("id").alias("child"), "parent")
    a = enrich.ancestors(c.select("id"), parents)
    return a.select(F.expr("id div 1000 - 1").alias("conv_id"), F.expr("id % 1000").alias("turn"), "hop", F.expr("ancestor % 1000").alias("ancestor"))


@query(with_(V.STORE, "e as (select from_id as parent, to_id as child from edges where kind = 'parent_of')", "up as (select child as id, 1 as hop, parent as ancestor from e union all select u.id, hop + 1, e.parent from up u join e on e.child = u.ancestor where hop < 32)", select="select id, hop, ancestor from up"))
def ancestors_of_store(spark, d):
    e = V.edges(spark, d).where("kind = 'parent_of'").select(F.col("from_id").alias("parent"), F.col("to_id").alias("child"))
    return enrich.ancestors(e.select(F.col("child").alias("id")), e, stop_at="").select("id", "hop", "ancestor")


# -- graph


@query(with_(V.EV, """b as (select pid, start, max(seq) as bs, arg_max(t, seq) as birth, arg_max(comm, seq) as comm from ev where kind = 'process_birth' group by 1, 2), x as (select pid, start, max(seq) as ds, arg_max(t, seq) as death, arg_max(comm, seq) as comm from ev where kind = 'process_death' group by 1, 2)""", select="select coalesce(b.pid, x.pid) as pid, coalesce(b.start, x.start) as start, coalesce(b.comm, x.comm) as comm, coalesce(birth, death) as birth, case when bs is null or ds > bs then death end as death from b full join x on b.pid = x.pid and b.start = x.start"))
def process_fold(spark, d):
    return graph.process_nodes(V.ev(spark, d)).select("pid", "start", "comm", "birth", "death")


@query(with_(V.EV, "f as (select seq, t, to_bundle as app, lead(t) over (order by seq) as nxt, lag(to_bundle) over (order by seq) as prev from ev where kind = 'app_focus')", "r as (select *, sum(case when prev is distinct from app then 1 else 0 end) over (order by seq rows unbounded preceding) as run from f)", select='select app, min(t) over (partition by run) as "from", coalesce(nxt, (select max(t) from ev)) as "to" from r'))
def app_intervals(spark, d):
    e = V.ev(spark, d)
    last = e.agg(F.max("t").alias("last"))
    return graph.app_intervals(e).crossJoin(F.broadcast(last)).select("app", "from", F.coalesce("to", "last").alias("to"))  # one row


@query(with_(V.EV, """s as (select concat_ws('|', proto, local_addr, foreign_addr) as id, * from ev where kind in ('connection_opened', 'connection_closed')),
o as (select id, max(seq) as s, arg_max(t, seq) as t, arg_max(pid, seq) as pid, arg_max(rx, seq) as rx, arg_max(tx, seq) as tx from s where kind = 'connection_opened' group by 1), c as (select id, max(seq) as s, arg_max(t, seq) as t, arg_max(pid, seq) as pid, arg_max(rx, seq) as rx, arg_max(tx, seq) as tx from s where kind = 'connection_closed' group by 1)""",
    select="select coalesce(o.id, c.id) as id, coalesce(o.pid, c.pid) as pid_at_open, coalesce(o.t, c.t) as opened, case when o.id is null or c.s > o.s then c.t end as closed, case when o.id is null or c.s > o.s then c.rx else o.rx end as rx, case when o.id is null or c.s > o.s then c.tx else o.tx end as tx from o full join c on o.id = c.id"))
def socket_fold(spark, d):
    return graph.socket_nodes(V.ev(spark, d)).select("id", "pid_at_open", "opened", "closed", "rx", "tx")


@query(with_(V.EV, "f as (select path, unnest(flags) as flag, unnest([0, 1]) as i, seq from ev where kind = 'file_changed')", "ff as (select path, flag, min((seq, i)) as o from f group by 1, 2)", "fa as (select path, array_to_string(list(flag order by o), ',') as flags from ff group by 1)", select="select e.path, any_value(fa.flags) as flags, min(t) as first_seen, max(t) as last_seen, sum(count)::bigint as touch_count from ev e join fa using (path) where kind = 'file_changed' group by 1"))
def file_nodes(spark, d):
    return graph.file_nodes(V.ev(spark, d)).withColumn("flags", F.array_join("flags", ","))


@query(with_(V.EV, select="select domain as name, array_to_string(list_sort(list(distinct qtype)), ',') as qtypes, bool_and(masked) as masked, min(t) as first_seen, max(t) as last_seen, count(*) as query_count from ev where kind = 'dns_query' group by 1"))
def domain_nodes(spark, d):
    return graph.domain_nodes(V.ev(spark, d)).withColumn("qtypes", F.array_join("qtypes", ","))


PROC = """pn as (select pid, start, any_value(ppid) as ppid, min(t) as birth, case when count(*) > 2 then max(t) end as death from ev where kind in ('process_birth', 'process_death') group by 1, 2)"""


def _lives(spark, d):
    """Identities that live from their first to their last event, or on if they have only two."""
    e = V.ev(spark, d).where(F.col("kind").isin("process_birth", "process_death"))
    return e.groupBy("pid", "start").agg(F.first("ppid").alias("ppid"), F.min("t").alias("birth"), F.when(F.count(F.lit(1)) > 2, F.max("t")).alias("death"))


@query(with_(V.EV, PROC, select="select concat(p.pid, ':', p.start) as parent_id, concat(c.pid, ':', c.start) as child_id from pn c join (select pid, max(start) as start from pn group by 1) p on p.pid = c.ppid where not (p.pid = c.pid and p.start = c.start)"))
def parent_of_edges(spark, d):
    return graph.parent_edges(_lives(spark, d))


SPANS = f"""sp as (select pid, k as start, min(t) as birth, max(t) + {HOUR} as death from ev where kind in ('process_birth', 'process_death') group by 1, 2)"""
INTERVALS = "ai as (select to_bundle as app, t as \"from\", lead(t) over (order by seq) as \"to\" from ev where kind = 'app_focus')"
MET = f"""mt as (select app, pid, start, greatest("from", birth) as "from", nullif(least(coalesce("to", {graph.OPEN}), death), {graph.OPEN}) as "to" from ai join sp on "from" < death and birth < coalesce("to", {graph.OPEN}))"""


@query(with_(V.EV, SPANS, INTERVALS, MET, select='select app, concat(pid, \':\', start) as process_id, "from", "to" from mt where "from" < "to"'))
def frontmost_overlap(spark, d):
    e = V.ev(spark, d).where(F.col("kind").isin("process_birth", "process_death"))
    spans = e.groupBy("pid", F.col("k").alias("start")).agg(F.min("t").alias("birth"), (F.max("t") + HOUR).alias("death"))
    w = lifecycle.neighbours(V.ev(spark, d).where("kind = 'app_focus'"), ["t"], following=True)
    return graph.frontmost_edges(w.select(F.col("to_bundle").alias("app"), F.col("t").alias("from"), F.col("next_t").alias("to")), spans)


AT = "select e.seq, arg_max(concat(p.pid, ':', p.start), (p.birth, p.start)) as process_id from ev e join pn p on p.pid = e.pid and p.birth <= e.t and e.t <= coalesce(p.death, e.t) where e.kind = 'connection_opened' group by 1"


@query(with_(V.EV, PROC, select=AT))
def socket_attribution(spark, d):
    rows = V.ev(spark, d).where("kind = 'connection_opened'").select("seq", "pid", "t")
    return graph.attributed(rows, _lives(spark, d), "t").select("seq", "process_id")


@query(with_(V.EV, PROC, "dt as (select pid, domain, count(*) as n, min(t) as first_t from ev where kind = 'dns_query' group by 1, 2)", select="select domain, n, first_t, arg_max(concat(p.pid, ':', p.start), (p.birth, p.start)) as process_id from dt join pn p on p.pid = dt.pid and p.birth <= first_t and first_t <= coalesce(p.death, first_t) group by dt.pid, domain, n, first_t"))
def domain_attribution(spark, d):
    return graph.attributed(graph.domain_tally(V.ev(spark, d)), _lives(spark, d), "first_t").select("domain", F.col("count").alias("n"), "first_t", "process_id")


FOLDED = """pb as (select pid, start, max(seq) as bs, arg_max(t, seq) as birth, arg_max(ppid, seq) as ppid from ev where kind = 'process_birth' group by 1, 2), pd as (select pid, start, max(seq) as ds, arg_max(t, seq) as death, arg_max(ppid, seq) as ppid from ev where kind = 'process_death' group by 1, 2),
pf as (select coalesce(b.pid, x.pid) as pid, coalesce(b.start, x.start) as start, coalesce(b.ppid, x.ppid) as ppid, coalesce(birth, death) as birth, case when bs is null or ds > bs then death end as death from pb b full join pd x on b.pid = x.pid and b.start = x.start),
af as (select to_bundle as id, min(t) as first_seen, max(nxt) as last_end from (select *, lead(t) over (order by seq) as nxt from ev where kind = 'app_focus') group by 1),
sc as (select concat_ws('|', proto, local_addr, foreign_addr) as id, * from ev where kind in ('connection_opened', 'connection_closed')),
so as (select id, max(seq) as s, arg_max(t, seq) as t, arg_max(pid, seq) as pid from sc where kind = 'connection_opened' group by 1), sd as (select id, max(seq) as s, arg_max(t, seq) as t, arg_max(pid, seq) as pid from sc where kind = 'connection_closed' group by 1),
sf as (select coalesce(o.id, c.id) as id, coalesce(o.pid, c.pid) as pid, coalesce(o.t, c.t) as opened, case when o.id is null or c.s > o.s then c.t end as closed from so o full join sd c on o.id = c.id),
gn as (select 'process' as kind, concat(pid, ':', start) as id, birth as first_seen, coalesce(death, birth) as last_seen from pf union all select 'app', id, first_seen, coalesce(last_end, first_seen) from af union all select 'socket', id, opened, coalesce(closed, opened) from sf
  union all select 'file', path, min(t), max(t) from ev where kind = 'file_changed' group by 2 union all select 'domain', domain, min(t), max(t) from ev where kind = 'dns_query' group by 2)"""
LINKED = """dt as (select pid, domain, count(*) as n, min(t) as first_t from ev where kind = 'dns_query' group by 1, 2),
ge as (select 'parent_of' as kind, concat(p.pid, ':', p.start) as from_id, concat(c.pid, ':', c.start) as to_id, null::bigint as queries from pf c join (select pid, max(start) as start from pf group by 1) p on p.pid = c.ppid where not (p.pid = c.pid and p.start = c.start)
  union all select 'opened_socket', arg_max(concat(p.pid, ':', p.start), (p.birth, p.start)), s.id, null from sf s join pf p on p.pid = s.pid and p.birth <= s.opened and s.opened <= coalesce(p.death, s.opened) group by s.id
  union all select 'queried_domain', arg_max(concat(p.pid, ':', p.start), (p.birth, p.start)), domain, n from dt join pf p on p.pid = dt.pid and p.birth <= first_t and first_t <= coalesce(p.death, first_t) group by dt.pid, domain, n, first_t)"""


def _graph(spark, d):
    """The graph of the history but for overlaps, which frontmost_overlap has."""
    g = persist.build(V.ev(spark, d))
    return {k: f for k, f in g.items() if k != "frontmost_during"}


@query(with_(V.EV, FOLDED, select="select kind, id, first_seen, last_seen from gn"))
def store_rows_of_graph(spark, d):
    return persist.node_rows(_graph(spark, d)).select("kind", "id", "first_seen", "last_seen")


@query(with_(V.EV, FOLDED, LINKED, select="select e.kind, from_id, to_id, queries, coalesce(last_seen, 0)::bigint as seen_at from ge e left join gn n on n.id = e.to_id and n.kind = case e.kind when 'parent_of' then 'process' when 'opened_socket' then 'socket' else 'domain' end"))
def store_edges_of_graph(spark, d):
    g = _graph(spark, d)
    return persist.edge_rows(g, persist.node_rows(g)).select("kind", "from_id", "to_id", "queries", "seen_at")


@query(with_(V.EV, FOLDED, LINKED, select="""select 'processes' as part, id, first_seen as a, nullif(last_seen, case when (select death from pf where concat(pid, ':', start) = gn.id) is null then last_seen end) as b from gn where kind = 'process' union all select 'sockets', id, first_seen, case when last_seen > first_seen then last_seen end from gn where kind = 'socket'
union all select 'domains', id, first_seen, last_seen from gn where kind = 'domain' union all select 'files', id, first_seen, last_seen from gn where kind = 'file' union all select 'queried_domain', concat(from_id, ' ', to_id), queries, null from ge where kind = 'queried_domain' union all select kind, concat(from_id, ' ', to_id), null, null from ge where kind <> 'queried_domain'"""))
def graph_of_store(spark, d):
    g = _graph(spark, d)
    n = persist.node_rows(g)
    back = persist.load(n, persist.edge_rows(g, n))
    p, s, m, f = back["processes"], back["sockets"], back["domains"], back["files"]
    none = F.lit(None).cast("long")
    two = lambda a, b: F.concat_ws(" ", a, b)
    rows = [
        (p, "processes", S.process_key("pid", "start"), F.col("birth"), F.col("death")), (s, "sockets", S.socket_key("proto", "local_addr", "foreign_addr"), F.col("opened"), F.col("closed")),
        (m, "domains", F.col("name"), F.col("first_seen"), F.col("last_seen")), (f, "files", F.col("path"), F.col("first_seen"), F.col("last_seen")),
        (back["queried_domain"], "queried_domain", two("process_id", "domain"), F.col("count"), none), (back["parent_of"], "parent_of", two("parent_id", "child_id"), none, none), (back["opened_socket"], "opened_socket", two("process_id", "socket_id"), none, none),
    ]
    out = None
    for frame, part, id_, a, b in rows:
        one = frame.select(F.lit(part).alias("part"), id_.alias("id"), a.alias("a"), b.alias("b"))
        out = one if out is None else out.union(one)
    return out


CUT = T0 + 15 * DAY


@query(with_(V.EV, PROC, select=f"select count(*) filter (where death < {CUT}) as gone, count(*) filter (where not coalesce(death < {CUT}, false)) as kept from pn"))
def trim_counts(spark, d):
    kept, gone = graph.trim(_lives(spark, d), CUT, "death")
    return gone.agg(F.count(F.lit(1)).alias("gone")).crossJoin(kept.agg(F.count(F.lit(1)).alias("kept")))  # one row each


# -- analytics

G = V.bipartite_sql("g")


@query(with_(V.EV, G, select="select id, degree from g_d"))
def degree(spark, d):
    return analytics.degrees(*V.bipartite(spark, d)).select("id", "degree")


@query(with_(V.EV, G, select="select id, distinct_degree from g_d"))
def degree_distinct(spark, d):
    return analytics.degrees(*V.bipartite(spark, d)).select("id", "distinct_degree")


@query(with_(V.EV, G, select="select id, weighted from g_d"))
def weighted_degree(spark, d):
    return analytics.degrees(*V.bipartite(spark, d)).select("id", "weighted")


@query(with_(V.EV, G, select="select id, component from g_c"))
def components(spark, d):
    return analytics.components(*V.bipartite(spark, d))


@query(with_(V.EV, G, select="select component, count(*) as size from g_c group by 1"))
def component_sizes(spark, d):
    return analytics.component_sizes(*V.bipartite(spark, d))


@query(with_(V.EV, G, select="select label, degree, weighted from g_d order by degree desc, label, id limit 10"))
def topology_top(spark, d):
    return analytics.topology(*V.bipartite(spark, d))[0].select("label", "degree", "weighted")


@query(with_(V.EV, G, select="select count(*) as components, max(n) as largest from (select component, count(*) as n from g_c group by 1)"))
def graph_summary(spark, d):
    return analytics.component_sizes(*V.bipartite(spark, d)).agg(F.count(F.lit(1)).alias("components"), F.max("size").alias("largest"))


P, Q = V.bipartite_sql("p", V.MIDDLE), V.bipartite_sql("q", None, V.MIDDLE)


def _snapshots(spark, d):
    """The table's first half against its second."""
    return analytics.snapshot_diff(*V.bipartite(spark, d, V.MIDDLE), *V.bipartite(spark, d, None, V.MIDDLE))


@query(with_(V.EV, P, Q, "f as (select c.component, count(*) as n, count(p.id) as k, max((d.degree, d.label)) as top from q_c c join q_d d using (id) left join p_n p using (id) group by 1)", select="select top[2] as entity, n as observed from f where n >= 2 and k = 0"))
def new_component(spark, d):
    return _snapshots(spark, d).where("metric = 'new_component'").select("entity", "observed")


@query(with_(V.EV, P, Q, "b as (select component from p_c group by 1 having count(*) >= 2)", select="select p_c.component as entity, count(distinct q_c.component) as observed from p_c join b using (component) join q_c using (id) group by 1 having count(distinct q_c.component) > 1"))
def component_split(spark, d):
    return _snapshots(spark, d).where("metric = 'component_merge'").select("entity", "observed")


@query(with_(V.EV, P, Q, select="select d.label as entity, d.degree as observed, coalesce(p.degree, 0)::bigint as baseline from q_d d left join p_d p using (id) where d.degree - coalesce(p.degree, 0) >= 5"))
def degree_spike(spark, d):
    return _snapshots(spark, d).where("metric = 'degree_spike'").select("entity", "observed", "baseline")


# -- store


#: Two overlapping captures of the store: what was seen before the first time, and what was seen from the second on.
CAPTURED, AGAIN = V.EPOCH + 1500 * DAY, V.EPOCH + 1000 * DAY


@query(with_(V.STORE, f"""o as (select id, comm, first_seen, last_seen, 0 as b from people where first_seen < {CAPTURED}), n as (select id, concat(comm, 'x') as comm, first_seen - {DAY} as first_seen, last_seen - {DAY} as last_seen, 1 as b from people where last_seen >= {V.EPOCH + 2300 * DAY})""", select="select id, arg_max(comm, b) as comm, min(first_seen) as first_seen, max(last_seen) as last_seen, case when min(b) = 1 then 'inserted' when max(b) = 1 then 'updated' else 'kept' end as how from (select * from o union all select * from n) group by 1"))
def merge_nodes(spark, d):
    n = V.nodes(spark, d).where("kind = 'process'")
    old, new = n.where(F.col("first_seen") < CAPTURED), n.where(F.col("last_seen") >= V.EPOCH + 2300 * DAY)
    new = new.withColumns({"comm": F.concat("comm", F.lit("x")), "first_seen": F.col("first_seen") - DAY, "last_seen": F.col("last_seen") - DAY})
    return store.merge_nodes(old, new).select("id", "comm", "first_seen", "last_seen", "how")


@query(with_(V.STORE, "e as (select * from edges where kind = 'opened_socket')", f"""x as (select from_id, to_id, count, first_seen, last_seen, 0 as b from e where first_seen < {CAPTURED} union all select from_id, to_id, 1, last_seen + {DAY}, last_seen + {DAY}, 1 from e where last_seen >= {AGAIN} union all select from_id, to_id, 1, last_seen + {DAY}, last_seen + {DAY}, 1 from e where last_seen >= {AGAIN} and last_seen < {CAPTURED + 300 * DAY})""", select="select from_id, to_id, sum(count)::bigint as count, coalesce(max(first_seen) filter (where b = 0), min(first_seen)) as first_seen, max(last_seen) as last_seen, case when min(b) = 1 then 'inserted' when max(b) = 1 then 'updated' else 'kept' end as how from x group by 1, 2"))
def merge_edges(spark, d):
    e = V.edges(spark, d).where("kind = 'opened_socket'")
    again = e.where(F.col("last_seen") >= AGAIN).withColumn("seen_at", F.col("last_seen") + DAY)
    new = again.union(again.where(F.col("last_seen") < CAPTURED + 300 * DAY))  # some are seen twice
    return store.merge_edges(e.where(F.col("first_seen") < CAPTURED), new).select("from_id", "to_id", "count", "first_seen", "last_seen", "how")


@query(with_(V.STORE, f"""k as (select kind, id from nodes where last_seen >= {MID}), ke as (select e.* from edges e where last_seen >= {MID} and exists (select 1 from k where k.kind = e.from_kind and k.id = e.from_id) and exists (select 1 from k where k.kind = e.to_kind and k.id = e.to_id))""", select=f"select (select count(*) from nodes) - (select count(*) from k) as nodes, (select count(*) from edges) - (select count(*) from ke) as edges, (select count(*) from orders where epoch_us(o_orderdate) * 1000 < {MID}) as events"))
def prune_report(spark, d):
    events = spark.read.parquet(f"{d}/orders.parquet").select((F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("ts_ns"))
    return store.prune(V.nodes(spark, d), V.edges(spark, d), events, MID)["report"]


@query(with_(V.STORE, select="select 'nodes' as what, kind, count(*) as n from nodes group by 2 union all select 'edges', kind, count(*) from edges group by 2 union all select 'events', '', count(*) from events union all select 'span', 'first', min(first_seen) from nodes union all select 'span', 'last', max(last_seen) from nodes"))
def store_summary(spark, d):
    return store.summary(V.nodes(spark, d), V.edges(spark, d), spark.read.parquet(f"{d}/events.parquet"))


@query(with_(V.EV, PROC, select=f"select pid, start from pn where coalesce(death, birth) >= {CUT}"))
def processes_seen_since(spark, d):
    return store.processes_seen_since(_lives(spark, d), CUT).select("pid", "start")


JOINED = "pc as (select c.id, c.comm, c.exec_path, c.uid, c.last_seen, p.id as parent_id, p.comm as parent_comm, p.uid as parent_uid from edges e join people c on c.id = e.to_id join people p on p.id = e.from_id where e.kind = 'parent_of')"


@query(with_(V.STORE, JOINED, select=f"select id, comm, exec_path, parent_id from pc where uid = 0 and parent_uid > 0 and last_seen >= {SINCE}"))
def escalation(spark, d):
    return store.root_under_user(V.nodes(spark, d), V.edges(spark, d), SINCE)


@query(with_(V.STORE, select=f"select id, comm, exec_path from people where last_seen >= {SINCE} and not coalesce(starts_with(exec_path, '/usr/bin/') or starts_with(exec_path, '/bin/'), false)"))
def outside_prefixes(spark, d):
    return store.outside_paths(V.nodes(spark, d), list(PREFIXES), SINCE).select("id", "comm", "exec_path")


@query("select page_id, url from pages where not coalesce(starts_with(url, 'https://www.') or starts_with(url, 'https://blog.'), false)")
def outside_url_prefixes(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").select(F.lit("process").alias("kind"), F.lit(0).alias("last_seen"), F.col("url").alias("exec_path"), "page_id", "url")
    return store.outside_paths(p, ["https://www.", "https://blog."]).select("page_id", "url")


INSIDE = f"k as (select kind, id from nodes where first_seen <= {MID + 90 * DAY} and last_seen >= {MID})"


@query(with_(V.STORE, INSIDE, select="select kind, id from k"))
def window_nodes(spark, d):
    return store.in_window(V.nodes(spark, d), V.edges(spark, d), MID, MID + 90 * DAY)[0].select("kind", "id")


@query(with_(V.STORE, INSIDE, select="select e.kind, from_id, to_id from edges e join k a on a.kind = from_kind and a.id = from_id join k b on b.kind = to_kind and b.id = to_id"))
def window_edges(spark, d):
    return store.in_window(V.nodes(spark, d), V.edges(spark, d), MID, MID + 90 * DAY)[1].select("kind", "from_id", "to_id")


@query(with_(V.STORE, select="select coalesce(foreign_addr, '?') as foreign_addr, sum(coalesce(rx, 0) + coalesce(tx, 0))::bigint as bytes_total, count(distinct pid_at_open) as processes, count(*) as sockets from sockets group by 1 order by bytes_total desc, foreign_addr limit 20"))
def top_endpoints(spark, d):
    return store.top_endpoints(V.nodes(spark, d))


@query(with_(V.STORE, select=f"select from_id as app_id, to_id, coalesce(name, from_id) as name, greatest(overlap_from, {MID}) as start_ns, least(coalesce(overlap_to, {MID + 30 * DAY}), {MID + 30 * DAY}) as end_ns, (least(coalesce(overlap_to, {MID + 30 * DAY}), {MID + 30 * DAY}) - greatest(overlap_from, {MID})) // {SECOND} as secs from edges e left join apps a on a.id = e.from_id where e.kind = 'frontmost_during' and overlap_from <= {MID + 30 * DAY} and coalesce(overlap_to, {MID + 30 * DAY}) >= {MID}"))
def focus_clipped(spark, d):
    return store.focus_segments(V.edges(spark, d), V.nodes(spark, d), MID, MID + 30 * DAY)


@query(with_(V.STORE, JOINED, select=f"select parent_id as id, parent_comm as comm, count(*) as children from pc where last_seen >= {SINCE} group by 1, 2 having count(*) >= 6"))
def prolific_parents(spark, d):
    return store.parents_with_many_children(V.nodes(spark, d), V.edges(spark, d), 6, SINCE)


@query(with_(V.STORE, select="select id, query_count, masked, (select count(distinct from_id) from edges e where e.kind = 'queried_domain' and e.to_id = m.id) as processes from domains m order by query_count desc, id limit 20"))
def top_domains(spark, d):
    return store.top_domains(V.nodes(spark, d), V.edges(spark, d))


@query(with_(V.STORE, select=f"select comm, exec_path, min(first_seen) as first_seen, count(*) as instances from people group by 1, 2 having min(first_seen) >= {V.EPOCH + 60 * DAY} order by first_seen, comm, exec_path nulls first limit 20"))
def novel_processes(spark, d):
    return store.novel_processes(V.nodes(spark, d), V.EPOCH + 60 * DAY)


@query(with_(V.STORE, select=f"select id, first_seen from domains where first_seen >= {V.EPOCH + 5 * DAY} and not masked order by first_seen, id limit 20"))
def novel_domains(spark, d):
    return store.novel_domains(V.nodes(spark, d), V.EPOCH + 5 * DAY)


@query(with_(V.STORE, select=f"select foreign_addr, min(first_seen) as first_seen, count(*) as connections, max(process_name) as example from sockets where foreign_addr is not null group by 1 having min(first_seen) >= {V.EPOCH + 200 * DAY} order by first_seen, foreign_addr limit 20"))
def novel_endpoints(spark, d):
    return store.novel_endpoints(V.nodes(spark, d), V.EPOCH + 200 * DAY)


@query(with_(V.STORE, select=f"select id, name, first_seen from apps where first_seen >= {V.EPOCH + DAY} order by first_seen, id limit 20"))
def novel_apps(spark, d):
    return store.novel_apps(V.nodes(spark, d), V.EPOCH + DAY)


@query(with_(V.STORE, select=f"select min(first_seen) as oldest, min(first_seen) > {SINCE - 1800 * SECOND} as cold from nodes"))
def novelty_cold(spark, d):
    n = V.nodes(spark, d)
    return store.oldest(n).crossJoin(store.baseline_cold(n, SINCE))  # one row each


@query(with_(V.EV, select=f"select seq, ts_ns, kind from ev where ts_ns between {T0 + DAY} and {T0 + 10 * DAY} and kind in ('dns_query', 'app_focus') order by ts_ns, seq limit 200"))
def events_window(spark, d):
    return store.events_in_window(V.ev(spark, d), T0 + DAY, T0 + 10 * DAY, ["dns_query", "app_focus"], 200).select("seq", "ts_ns", "kind")


@query(with_(V.EV, select=f"select kind, (ts_ns // {HOUR}) % 24 as hour_of_day, count(*) as n from ev where ts_ns >= {CUT} group by 1, 2"))
def hourly_profile(spark, d):
    return store.hourly_profile(V.ev(spark, d), CUT)


@query(with_(V.EV, select=f"select comm as value, (ts_ns // {DAY}) * {DAY} as window_start, count(*) as n from ev where kind = 'process_death' and ts_ns >= {T0} group by 1, 2"))
def field_window_counts(spark, d):
    return store.field_window_counts(V.ev(spark, d), "process_death", "comm", T0, DAY)


@query(with_(V.STORE, select="select from_id, to_id, count, first_seen, last_seen from edges where kind = 'parent_of'"))
def edge_rates(spark, d):
    return store.edge_rates(V.edges(spark, d), "parent_of")


@query("select c_custkey, case when c_custkey % 4 = 0 then 'never ran' when c_custkey % 4 = 1 then 'stopped cleanly' when 1000 - c_custkey % 400 > 800 then 'stale' else 'alive' end as status from customer")
def daemon_status(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    heart = F.when(F.col("c_custkey") % 4 != 0, (F.col("c_custkey") % 400) * SECOND)
    pid = F.when(F.col("c_custkey") % 4 > 1, F.col("c_custkey"))
    return c.select("c_custkey", store.daemon_status(pid, heart, F.lit(1000 * SECOND), 800 * SECOND).alias("status"))


# -- summaries


@query(with_(V.EV, select=f"select min(t) as first_t, max(t) as last_t, count(*) as n, (max(t) - min(t)) // {SECOND} as secs from ev"))
def capture_span(spark, d):
    return summary.span(V.ev(spark, d))


@query(with_(V.EV, select=f"select seq, coalesce(to_name, '(unknown)') as name, t, (coalesce(lead(t) over (order by t, seq), (select max(t) from ev)) - t) // {SECOND} as secs from ev where kind = 'app_focus'"))
def focus_segments(spark, d):
    return summary.focus_segments(V.ev(spark, d))


@query(with_(V.EV, select="select comm, count(*) as spawns from ev where kind = 'process_birth' group by 1 order by spawns desc, comm limit 8"))
def top_processes(spark, d):
    return summary.top_processes(V.ev(spark, d))


@query(with_(V.EV, """c as (select foreign_addr, process_name, sum(rx + tx)::bigint as b from ev where kind = 'connection_completed' and k % 4 <> 2 group by 1, 2), o as (select foreign_addr, process_name, sum(rx + tx)::bigint as b from ev where kind = 'connection_opened' and not exists (select 1 from c where c.foreign_addr = ev.foreign_addr and c.process_name = ev.process_name) group by 1, 2),
u as (select *, false as still_open from c union all select *, true from o), r as (select *, row_number() over (order by b desc, foreign_addr, process_name) as r from u), s as (select *, row_number() over (order by r) as x from r where r > 8 and still_open)""", select="select foreign_addr, process_name, b as bytes_total, still_open, r::int as rank from r where r <= 8 union all select foreign_addr, process_name, b, still_open, (8 + x)::int from s where x <= 2"))
def endpoints_with_open(spark, d):
    return summary.endpoints(V.ev(spark, d).where("not (kind = 'connection_completed' and k % 4 = 2)"))


@query(with_(V.EV, select="select concat('/', array_to_string(list_filter(string_split(path, '/'), lambda c: c <> '')[1:4], '/')) as directory, count(*) as changes from ev where kind = 'file_changed' group by 1 order by changes desc, directory limit 6"))
def directory_buckets(spark, d):
    return summary.directories(V.ev(spark, d))


@query(with_(V.EV, "c as (select client, count(distinct name_hash) as unique_names, count(*) as total from ev where kind = 'dns_query' group by 1 order by total desc, client limit 6)", "n as (select client, rtrim(qname, '.') as name, min(seq) as s from ev where kind = 'dns_query' and not masked group by 1, 2)", "x as (select *, row_number() over (partition by client order by s) as r from n)", select="select c.*, (select array_to_string(list(name order by r), ',') from x where x.client = c.client and r <= 3) as examples from c"))
def dns_clients(spark, d):
    return summary.dns_clients(V.ev(spark, d)).withColumn("examples", F.array_join("examples", ","))


@query(with_(V.EV, select="select kind, count(*) as n from ev group by 1"))
def kind_counts(spark, d):
    return summary.kind_counts(V.ev(spark, d))


PORTS = "sp as (select process_name, foreign_addr, any_value(port) as port, min(seq) as seq, arg_min(t, seq) as t, case any_value(port) when 22 then 'ssh' when 4444 then 'common reverse-shell port' else 'rdp' end as label from ev where kind in ('connection_opened', 'connection_completed') and port in (22, 4444, 3389) group by 1, 2)"


@query(with_(V.EV, PORTS, select="select process_name, foreign_addr, port, label, seq from sp"))
def sensitive_ports(spark, d):
    return summary.sensitive_ports(V.ev(spark, d)).select("process_name", "foreign_addr", "port", "label", "seq")


SHORT_LIVED = f"bb as (select pid, arg_max(t, seq) as born from ev where kind = 'process_birth' group by 1), sl as (select comm, count(*) as n, arg_max(t, seq) as last_t from ev join bb using (pid) where kind = 'process_death' and greatest(t - born, 0) < {SHORT} group by 1)"


@query(with_(V.EV, SHORT_LIVED, select="select comm, n from sl where n >= 5"))
def short_lived_bursts(spark, d):
    return summary.short_lived(V.ev(spark, d), SHORT).where("n >= 5").select("comm", "n")


FLAGS = """fl as (select 1 as part, lpad(seq::varchar, 20, '0') as o, concat(process_name, ' reached ', foreign_addr, ', ', label, ' on port ', port) as text from sp
union all select 2, comm, concat(n, ' runs of ', comm, ' were over within seconds each') from sl where n >= 5
union all select 3, lpad((1099511627776 - total)::varchar, 20, '0'), concat(client, ' asked for ', unique_names, ' different names') from (select client, count(distinct name_hash) as unique_names, count(*) as total from ev where kind = 'dns_query' group by 1 order by total desc, client limit 6) where unique_names >= 50)"""


@query(with_(V.EV, PORTS, SHORT_LIVED, FLAGS, select="select row_number() over (order by part, o, text)::int as rank, text from fl order by part, o, text limit 8"))
def event_suspicions(spark, d):
    return summary.event_suspicions(V.ev(spark, d), SHORT)


@query(with_(V.EV, select=f"select seq from ev where t >= (select max(t) from ev) - {DAY}"))
def newest_window(spark, d):
    return summary.newest_window(V.ev(spark, d), DAY).select("seq")


@query(with_(V.EV, f"w as (select kind, (t // {HOUR}) * {HOUR} - unnest([0, 1, 2, 3, 4]) * {HOUR} as window_start from ev)", select="select window_start, kind, count(*) as n from w group by 1, 2"))
def sliding_window_counts(spark, d):
    return summary.sliding_counts(V.ev(spark, d), 5 * HOUR, HOUR)


@query(with_(V.EV, r"c as (select *, case when contains(foreign_addr, '.') then regexp_extract(foreign_addr, '^(.*)\.[^.]*$', 1) else foreign_addr end as host, case when contains(foreign_addr, '.') then regexp_extract(foreign_addr, '([^.]*)$', 1) else '?' end as p from ev where kind = 'connection_completed')", select="select host, p as port, process_name, count(*) as connections, sum(rx)::bigint as rx, sum(tx)::bigint as tx, sum(duration_ns // 1000000)::bigint as duration_ms from c group by 1, 2, 3"))
def net_conversations(spark, d):
    return summary.conversations(V.ev(spark, d))


@query(with_(V.EV, select="select domain, client, count(*) as queries, array_to_string(list_sort(list(distinct qtype)), ',') as qtypes, bool_and(masked) as masked from ev where kind = 'dns_query' group by 1, 2"))
def dns_review(spark, d):
    return summary.dns_review(V.ev(spark, d)).withColumn("qtypes", F.array_join("qtypes", ","))


CAND = """cd as (select id, '1 root_under_user' as r from pc where uid = 0 and parent_uid > 0 union all select id, '2 outside_trusted' from people where not coalesce(starts_with(exec_path, '/usr/bin/') or starts_with(exec_path, '/bin/'), false) union all select parent_id, '3 prolific_parent' from pc group by parent_id having count(*) >= 8)"""


@query(with_(V.STORE, JOINED, CAND, select="select split_part(id, ':', 1)::bigint as pid, array_to_string(list_transform(list_sort(list(distinct r)), lambda x: x[3:]), ',') as reasons from cd group by 1"))
def candidates(spark, d):
    return summary.candidates(V.nodes(spark, d), V.edges(spark, d), PREFIXES)


@query(with_(V.STORE, JOINED, """a as (select concat('uid 0 below a user: ', comm, ', pid ', split_part(id, ':', 1), ', ', coalesce(exec_path, '?')) as text, row_number() over (order by id) as r, count(*) over () as n from pc where uid = 0 and parent_uid > 0),
b0 as (select distinct comm, exec_path from people where not coalesce(starts_with(exec_path, '/usr/bin/') or starts_with(exec_path, '/bin/'), false)), b as (select concat('outside trusted paths: ', comm, ', ', coalesce(exec_path, '?')) as text, row_number() over (order by comm nulls first, exec_path nulls first) as r, count(*) over () as n from b0),
c0 as (select parent_id, parent_comm, count(*) as k from pc group by 1, 2 having count(*) >= 8), c as (select concat('many children: ', parent_comm, ', pid ', split_part(parent_id, ':', 1), ', ', k) as text, row_number() over (order by k desc, parent_id) as r, count(*) over () as n from c0)""",
    select=" union all ".join(f"select {i} as part, r::int as rank, text from {t} where r <= 6 union all (select {i}, 7, concat('(+', n - 6, ' {more})') from {t} where r = 1 and n > 6)" for i, t, more in ((1, "a", "of uid 0 below a user"), (2, "b", "outside trusted paths"), (3, "c", "of many children")))))
def capped_flags(spark, d):
    return summary.store_flags(V.nodes(spark, d), V.edges(spark, d), PREFIXES)


# -- narration of a graph

OWNED = """pa as (select pid, start, max(seq) as s, arg_max({e: exec_path}, seq).e as exec_path from ev where kind = 'process_birth' group by 1, 2), pz as (select pid, start, arg_max({e: exec_path}, seq).e as exec_path from ev where kind = 'process_death' group by 1, 2),
px as (select f.*, concat('proc', f.pid % 20) as comm, case when f.pid % 5 = 0 then 0 else 500 + f.pid % 5 end as uid, case when a.s is null then z.exec_path else a.exec_path end as exec_path from pf f left join pa a on a.pid = f.pid and a.start = f.start left join pz z on z.pid = f.pid and z.start = f.start),
pw as (select pid, arg_max({start: start, exec_path: exec_path}, (start, birth)) as p from px group by 1)"""
SOCKETS = """sa as (select id, max(seq) as s, arg_max({f: foreign_addr, n: process_name, rx: rx, tx: tx}, seq) as r from sc where kind = 'connection_opened' group by 1), sb as (select id, max(seq) as s, arg_max({f: foreign_addr, n: process_name, rx: rx, tx: tx}, seq) as r from sc where kind = 'connection_closed' group by 1),
sx as (select coalesce(a.r.f, b.r.f) as f, coalesce(a.r.n, b.r.n) as n, case when a.id is null or b.s > a.s then coalesce(b.r.rx, a.r.rx) else a.r.rx end as rx, case when a.id is null or b.s > a.s then coalesce(b.r.tx, a.r.tx) else a.r.tx end as tx, a.id is null or coalesce(b.s > a.s, false) as closed from sa a full join sb b on a.id = b.id)"""


@query(with_(V.EV, FOLDED, SOCKETS, select=f"""select 'first' as fact, '' as name, min(first_seen)::bigint as n from gn where kind <> 'app' union all select 'last', '', max(last_seen)::bigint from gn where kind <> 'app'
union all select 'things', case kind when 'process' then 'processes' else concat(kind, 's') end, count(*) from gn group by 2
union all (select 'processes', concat('proc', pid % 20) as comm, count(*) as k from pf group by 2 order by k desc, comm limit {summary.TOP_PROCESSES})
union all (select 'endpoints', concat_ws(' ', f, n, case when bool_or(not closed) then 'true' else 'false' end), sum(coalesce(rx, 0) + coalesce(tx, 0))::bigint as b from sx group by f, n order by b desc, f, n limit {summary.TOP_ENDPOINTS})
union all (select 'directories', concat('/', array_to_string(string_split(path, '/')[2:5], '/')) as dir, sum(count)::bigint as c from ev where kind = 'file_changed' group by 2 order by c desc, dir limit {summary.TOP_DIRECTORIES})
union all (select 'domains', domain, count(*) as q from ev where kind = 'dns_query' group by 2 order by q desc, domain limit {summary.TOP_CLIENTS})"""))  # fmt: skip
def graph_facts(spark, d):
    f = narrate.graph_facts(_graph(spark, d))
    one = lambda frame, fact, name, n: frame.select(F.lit(fact).alias("fact"), name.alias("name"), F.col(n).cast("long").alias("n"))
    ends = F.concat_ws(" ", "foreign_addr", "process_name", F.col("still_open").cast("string"))
    rows = [
        one(f["span"], "first", F.lit(""), "first_t"), one(f["span"], "last", F.lit(""), "last_t"), one(f["things"], "things", F.col("part"), "n"), one(f["processes"], "processes", F.col("comm"), "spawns"),
        one(f["endpoints"], "endpoints", ends, "bytes_total"), one(f["directories"], "directories", F.col("directory"), "changes"), one(f["domains"], "domains", F.col("name"), "query_count"),
    ]
    return reduce(DataFrame.union, rows)


CANDIDATES = """ca as (select pid, '1 root_under_user' as r from px where uid = 0 and exists (select 1 from pf q where q.pid = px.ppid) and ppid % 5 <> 0 union select pid, '2 outside_trusted' from px where not coalesce(starts_with(exec_path, '/usr/bin/') or starts_with(exec_path, '/bin/'), false)
  union select ppid, '3 prolific_parent' from pf where ppid in (select pid from pf) group by 1, 2 having count(*) >= 3),
cb as (select pid, string_agg(substr(r, 3), ',' order by r) as reasons from ca group by 1)"""
PARENT = "(select any_value(concat('proc', q.pid % 20)) from pf q where q.pid = c.pid // 10)"


@query(with_(V.EV, FOLDED, OWNED, CANDIDATES, select=f"select c.pid, concat('process=', c.pid, ':', p.start, ' comm=proc', c.pid % 20, ' path=', coalesce(p.exec_path, '?'), ' uid=', case when c.pid % 5 = 0 then 0 else 500 + c.pid % 5 end, ' parent=', c.pid // 10, ' parent_comm=', coalesce({PARENT}, '?'), ' reasons=', reasons) as line from cb c join pw using (pid)"))
def graph_candidates(spark, d):
    p = _graph(spark, d)["processes"]
    return narrate.candidate_lines(narrate.graph_candidates(p, PREFIXES, 3), p)


# -- baselines

FOLD = "list_reduce(list_prepend({m: 0.0::double, v: 0.0::double, n: 0, x: 0.0::double}, list_transform(a, lambda y: {m: 0.0::double, v: 0.0::double, n: 0, x: y::double})), lambda s, y: {m: case when s.n = 0 then y.x else s.m + 0.3 * (y.x - s.m) end, v: case when s.n = 0 then 0.0 else (1 - 0.3) * (s.v + 0.3 * (y.x - s.m) * (y.x - s.m)) end, n: s.n + 1, x: 0.0::double})"


@query(with_(V.EV, "q as (select pid, list(rx::double order by seq) as a from ev where kind = 'dns_query' group by 1)", f"r as (select pid, {FOLD} as e from q)", select="select pid, round(e.m, 4) as mean, round(e.v, 2) as var from r"))
def ewma(spark, d):
    e = baseline.weighted(V.ev(spark, d).where("kind = 'dns_query'"), ["pid"], "seq", F.col("rx"), f"seq div {ticks.BLOCK}")
    return e.select("pid", F.round("mean", 4).alias("mean"), F.round("var", 2).alias("var"))


@query(with_(V.EV, select="select kind, percentile_disc(0.99) within group (order by rx)::double as p99 from ev group by 1"))
def p99(spark, d):
    return V.ev(spark, d).groupBy("kind").agg(S.nearest_rank("cast(rx as double)", 0.99).alias("p99"))


def metric_sql(name: str, kind: str, field: str) -> str:
    return f"""{name}_c as (select {field} as value, (ts_ns // {HOUR}) * {HOUR} as w, count(*) as n from ev where kind = '{kind}' and ts_ns >= {T0} group by 1, 2),
{name}_a as (select value, percentile_disc(0.99) within group (order by n)::double as p99, list(n::double order by w) as a from {name}_c group by 1),
{name}_m as (select value, p99, greatest(p99, e.m + 3 * greatest(sqrt(e.v), 1.0)) as threshold from (select value, p99, {FOLD} as e from {name}_a)),
{name}_d as (select percentile_disc(0.99) within group (order by threshold) as d from {name}_m)"""


@query(with_(V.EV, metric_sql("b", "process_death", "comm"), select="select value, p99, round(threshold, 6) as threshold from b_m"))
def metric_baseline(spark, d):
    return baseline.metric_baseline(store.field_window_counts(V.ev(spark, d), "process_death", "comm", T0)).withColumn("threshold", F.round("threshold", 6))


@query(with_(V.EV, metric_sql("b", "process_death", "comm"), "v as (select distinct concat('proc', pid % 30) as value from ev)", select="select value, round(coalesce(threshold, case when d > 0 then d end, 5.0), 6) as threshold from v left join b_m using (value) cross join b_d"))
def threshold_lookup(spark, d):
    e = V.ev(spark, d)
    b = baseline.metric_baseline(store.field_window_counts(e, "process_death", "comm", T0))
    rows = e.select(F.concat(F.lit("proc"), F.col("pid") % 30).alias("value")).distinct()
    return baseline.with_threshold(rows, b, 5.0, False).withColumn("threshold", F.round("threshold", 6))


RARE = f"hp as (select kind, (ts_ns // {HOUR}) % 24 as h, count(*) as n from ev where ts_ns >= {T0} group by 1, 2), ra as (select k.kind, h.h as h, 1 - coalesce(hp.n, 0) / k.top as rarity from (select kind, max(n)::double as top from hp group by 1) k cross join (select unnest(range(24)) as h) h left join hp on hp.kind = k.kind and hp.h = h.h)"


@query(with_(V.EV, RARE, select="select kind, h as hour_of_day, round(rarity, 9) as rarity from ra"))
def hour_rarity(spark, d):
    return baseline.hour_rarity(V.ev(spark, d), T0).withColumn("rarity", F.round("rarity", 9))


def _engine(spark, d):
    e = V.ev(spark, d)
    parents = V.edges(spark, d).where("kind = 'parent_of'")
    return e, baseline.Baseline(e, parents, T0 + 30 * DAY, 30)


WINDOW = f"wi as (select * from ev where t >= {T0 + 20 * DAY})"
OUT = "concat('{e}', {x}) as entity, n::double as observed, round(threshold, 6) as baseline_p99, round(3.0 * n / greatest(threshold, 1.0) + 2.0 * coalesce(rarity, 0), 6) as score"


def _shown(rows):
    return rows.select("entity", "observed", F.round("baseline_p99", 6).alias("baseline_p99"), F.round("score", 6).alias("score"))


def _window(e):
    return e.where(F.col("t") >= T0 + 20 * DAY)


@query(with_(V.EV, metric_sql("b", "process_death", "comm"), RARE, WINDOW, SHORT_LIVED.replace("from ev", "from wi"), f"x as (select comm, n, coalesce(threshold, case when d > 0 then d end, 5.0) as threshold, rarity from sl left join b_m on value = comm cross join b_d left join ra on ra.kind = 'process_death' and ra.h = (last_t // {HOUR}) % 24)", select="select " + OUT.format(e="process:", x="comm") + " from x where n >= threshold"))
def spawn_burst_scores(spark, d):
    e, b = _engine(spark, d)
    return _shown(b.spawn_bursts(_window(e), SHORT))


@query(with_(V.EV, metric_sql("b", "dns_query", "client"), RARE, WINDOW, "dc as (select client, count(*) as n, arg_max(t, seq) as last_t from wi where kind = 'dns_query' group by 1)", f"x as (select client, n, coalesce(threshold, case when d > 0 then d end, 50.0) as threshold, rarity from dc left join b_m on value = client cross join b_d left join ra on ra.kind = 'dns_query' and ra.h = (last_t // {HOUR}) % 24)", select="select " + OUT.format(e="dns_client:", x="client") + " from x where n >= threshold"))
def dns_fanout_scores(spark, d):
    e, b = _engine(spark, d)
    return _shown(b.dns_fanout(_window(e)))


@query(with_(V.EV, V.STORE, RARE, WINDOW, "pd as (select percentile_disc(0.99) within group (order by n)::double as threshold from (select from_id, count(*) as n from edges where kind = 'parent_of' group by 1))", "ch as (select ppid, count(*) as n, arg_max(t, seq) as last_t from wi where kind = 'process_birth' group by 1)", f"x as (select ppid, n, threshold, rarity from ch cross join pd left join ra on ra.kind = 'process_birth' and ra.h = (last_t // {HOUR}) % 24)", select="select " + OUT.format(e="parent:", x="ppid") + " from x where n >= threshold"))
def prolific_parent_scores(spark, d):
    e, b = _engine(spark, d)
    return _shown(b.prolific_parents(_window(e)))


@query(with_(V.EV, RARE, WINDOW, PORTS.replace("from ev", "from wi"), select=f"select concat('endpoint:', foreign_addr) as entity, port::double as observed, 0.0::double as baseline_p99, round(5.0 + 2.0 * coalesce(rarity, 0), 6) as score from sp left join ra on ra.kind = 'connection_opened' and ra.h = (t // {HOUR}) % 24"))
def sensitive_port_scores(spark, d):
    e, b = _engine(spark, d)
    return _shown(b.ports(_window(e)))


@query(with_("o as (select o_orderkey % 40 as k, o_orderkey, o_orderkey % 3 as p, (o_custkey % 100)::double as score from orders)", "r as (select concat('flag ', k) as text, case when p = 2 then 1.0 else score end as score, p from o)", "x as (select *, row_number() over (partition by text order by p, score desc) as r from r)", select="select text, score::double as score from x where r = 1 order by score desc, text limit 8"))
def suspicion_merge(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").selectExpr("concat('flag ', o_orderkey % 40) as text", "o_orderkey % 3 as p", "cast(o_custkey % 100 as double) as score")
    return baseline.merge_suspicions(o.where("p = 0"), o.where("p = 1"), o.where("p = 2"))


# -- functions


@query("select o_orderkey, case when s < 60 then concat(s, 's') when s < 3600 then concat(s // 60, 'm', case when s % 60 = 0 then '' else concat(s % 60, 's') end) when s < 86400 then concat(s // 3600, 'h', case when s % 3600 // 60 = 0 then '' else concat(s % 3600 // 60, 'm') end) else concat(s // 86400, 'd', case when s % 86400 // 3600 = 0 then '' else concat(s % 86400 // 3600, 'h') end) end as text from (select o_orderkey, (o_orderkey * o_orderkey // 7)::bigint as s from orders)")
def fmt_duration(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", S.fmt_duration(F.expr("o_orderkey * o_orderkey div 7")).alias("text"))


@query("select page_id, case when length(html) > 120 then concat(html[1:120], '…') else html end as text from pages")
def payload_shortened(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", S.shortened("html").alias("text"))


@query(with_(V.EV, select="select seq, concat('d', k, '.example') as qname, qtype, k % 5 as interface_index, pid, client, concat('h', k) as name_hash from ev where kind = 'dns_query'"))
def dns_parse(spark, d):
    m = V.ev(spark, d).where("kind = 'dns_query'").withColumn("message", F.expr("concat('[R1] DNSServiceQueryRecord START -- qname: d', k, '.example, qtype: ', qtype, ', flags: 0x0, interface index: ', k % 5, ', client pid: ', pid, ' (', client, '), name hash: h', k)"))
    f = S.dns_fields("message")
    return m.select("seq", f["qname"].alias("qname"), f["qtype"].alias("qtype"), f["interface_index"].cast("long").alias("interface_index"), f["pid"].alias("pid"), f["client_process_name"].alias("client"), f["name_hash"].alias("name_hash"))


@query(with_(V.EV, select="select seq, concat(case when pid % 3 = 0 then '*' else concat('10.0.0.', pid) end, '.', case when k % 10 = 0 then '*' else (k * 7 % 100)::varchar end) as addr from ev"))
def address_format(spark, d):
    e = V.ev(spark, d)
    host = F.when(F.col("pid") % 3 == 0, "0.0.0.0").otherwise(F.concat(F.lit("10.0.0."), "pid"))
    port = F.when(F.col("k") % 10 == 0, 0).otherwise(F.col("k") * 7 % 100)
    return e.select("seq", S.format_address(host, port).alias("addr"))


@query(with_(V.EV, select="select seq, port from ev"))
def foreign_ports(spark, d):
    return V.ev(spark, d).select("seq", S.foreign_port("foreign_addr").alias("port"))


#: All 23 bits come up.
MASK = "k * 4194301 % 8388608"


@query(with_(V.EV, f"b as (select unnest({list(S.FILE_FLAGS)}) as bit, unnest({list(S.FILE_FLAGS.values())}) as name)", select=f"select seq, coalesce((select array_to_string(list(name order by bit), ',') from b where (({MASK}) & bit) <> 0), '') as flags from ev"))
def flag_names(spark, d):
    return V.ev(spark, d).select("seq", F.array_join(S.file_flags(F.expr(MASK)), ",").alias("flags"))


@query(with_(V.EV, "s as (select ['CLOSED', 'LISTEN', 'SYN_SENT', 'SYN_RCVD', 'ESTABLISHED', 'CLOSE_WAIT', 'FIN_WAIT_1', 'CLOSING', 'LAST_ACK', 'FIN_WAIT_2', 'TIME_WAIT'] as a)", select="select seq, case when k % 13 < 11 then a[k % 13 + 1] end as state, case when k % 4 = 0 then null else k + pid + 3 end as bytes from ev cross join s"))
def tcp_states(spark, d):
    return V.ev(spark, d).select("seq", S.tcp_state(F.expr("cast(k % 13 as int)")).alias("state"), S.class_bytes(F.expr("array(k, pid, if(k % 4 = 0, null, 1), 2)")).alias("bytes"))


@query(with_(V.EV, select="select seq, concat(comm, ' (pid ', pid, ')') as label, concat('p_', pid, '_', start) as dot_id, case when uid = 0 then '#ffd0d0' when uid between 501 and 600 then '#d0e6ff' else '#e8e8e8' end as color from ev where kind = 'process_birth'"))
def node_labels(spark, d):
    e = V.ev(spark, d).where("kind = 'process_birth'").withColumn("kind", F.lit("process")).withColumns({"id": F.lit(""), "name": F.lit(None).cast("string")})
    return e.select("seq", analytics.node_label().alias("label"), S.dot_slug("p_", F.concat_ws("_", "pid", "start")).alias("dot_id"), S.uid_color("uid").alias("color"))


@query(with_(V.EV, select="""select 'app' as kind, to_bundle as id, coalesce(to_name, to_bundle) as label from ev where kind = 'app_focus' union select 'socket', concat_ws('|', proto, local_addr, foreign_addr), concat(proto, ' ', foreign_addr) from ev where kind = 'connection_opened'
union select 'file', path, k::varchar from ev where kind = 'file_changed' union select 'domain', domain, domain from ev where kind = 'dns_query'"""))
def node_labels_of_things(spark, d):
    e = V.ev(spark, d)
    none = F.lit(None).cast("string")
    parts = [
        ("app_focus", "app", F.col("to_bundle"), F.col("to_name")), ("connection_opened", "socket", S.socket_key("proto", "local_addr", "foreign_addr"), none), ("file_changed", "file", F.col("path"), none),
        ("dns_query", "domain", S.domain_id("qname", "masked", "name_hash"), S.domain_id("qname", "masked", "name_hash")),
    ]
    out = None
    for event, kind, id_, name in parts:
        rows = e.where(F.col("kind") == event).select(F.lit(kind).alias("kind"), id_.alias("id"), name.alias("name"), "pid", none.alias("comm"), "proto", "foreign_addr")
        one = rows.select("kind", "id", analytics.node_label().alias("label"))
        out = one if out is None else out.union(one)
    return out.distinct()


@query(with_(V.EV, "d as (select *, case when seq > 2000 then null else concat(' (', case when 2000 - seq < 60 then concat(2000 - seq, 's') when 2000 - seq < 3600 then concat((2000 - seq) // 60, 'm', case when (2000 - seq) % 60 = 0 then '' else concat((2000 - seq) % 60, 's') end) end, ' ago)') end as age from ev)", select="select seq, concat('unix ', seq, age) as text  from d"))
def fmt_unix(spark, d):
    return V.ev(spark, d).select("seq", S.fmt_unix_ns(F.col("seq") * SECOND, F.lit(2000 * SECOND)).alias("text"))
