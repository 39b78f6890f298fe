"""Scenarios of event reconstruction, the graph, the store and the scores on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from telemill.functions import scalars as S
from telemill.operators import analytics, baseline, enrich, graph, lifecycle, store, summary, ticks

SEC = 1_000_000_000


def values(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.select(*columns).collect()), key=repr)


def processes(spark, rows):
    return spark.createDataFrame([("process", i, t, pid, start, comm) for i, (t, pid, start, comm) in enumerate(rows)], "source string, obs_seq long, t long, pid long, start long, comm string")


def test_ticks_break_strictly_behind_the_gap_and_over_blocks(spark):
    obs = spark.createDataFrame([("a", i, t) for i, t in enumerate([0, 100, 350, 601, 601, 500, 900])], "source string, obs_seq long, t long")
    for block in (1, 2, 3, 100):
        assert values(ticks.with_ticks(obs, 250, block), "obs_seq", "tick") == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, 2)]


def test_births_come_out_at_the_next_tick_and_the_first_is_silent(spark):
    e = lifecycle.process_events(processes(spark, [(1, 1, 5, "init"), (SEC + 1, 1, 5, "init"), (SEC + 2, 100, 6, "sh"), (2 * SEC, 1, 5, "init")]), ["comm"])
    assert values(e, "kind", "pid", "t", "emit_seq") == [("process_birth", 100, SEC + 2, 3)]


def test_deaths_and_flush(spark):
    obs = processes(spark, [(1, 1, 5, "a"), (1, 2, 5, "b"), (SEC, 1, 5, "a"), (2 * SEC, 1, 5, "a")])
    assert values(lifecycle.process_events(obs), "kind", "pid", "t", "last_seen", "emit_seq") == [("process_death", 2, SEC, 1, 3)]
    assert values(lifecycle.process_events(obs.where("obs_seq < 3"), flush_tail=True), "kind", "pid", "emit_seq") == [("process_death", 2, lifecycle.END)]


def test_null_keys_begin_no_tick(spark):
    obs = processes(spark, [(1, 1, 5, "a"), (SEC, 1, None, "x"), (2 * SEC, None, 5, "x")])
    assert lifecycle.process_events(obs).count() == 0


def test_completed_duration_reaches_over_ticks(spark):
    rows = [(1, "x"), (SEC, "x"), (SEC + 5, "t"), (2 * SEC, "t"), (2 * SEC + 1, "x"), (3 * SEC, "x"), (4 * SEC, "x")]
    obs = spark.createDataFrame([("network", i, t, "tcp4", "l", f) for i, (t, f) in enumerate(rows)], "source string, obs_seq long, t long, proto string, local_addr string, foreign_addr string")
    done = lifecycle.connection_events(obs)
    assert values(done.where("foreign_addr = 't'"), "kind", "duration_ns") == [("connection_closed", None), ("connection_completed", SEC - 5), ("connection_opened", None)]


def test_files_coalesce_by_window(spark):
    rows = [(1, "/tmp/x", ["created"], 7), (100, "/tmp/x", ["modified"], 8), (300, "/tmp/x", ["created", "is_file"], 0), (600, "/tmp/y", [], 9)]
    obs = spark.createDataFrame([(i, t * 1_000_000, p, f, e) for i, (t, p, f, e) in enumerate(rows)], "obs_seq long, t long, path string, flags array<string>, event_id long")
    assert values(lifecycle.file_events(obs), "path", "flags", "event_ids", "count", "t") == [("/tmp/x", ["created", "modified", "is_file"], [7, 8], 2, 300_000_000)]
    assert lifecycle.file_events(obs, flush_tail=True).count() == 2


def test_focus_and_routing(spark):
    f = spark.createDataFrame([(0, 1, None, "a"), (1, 1, "a", "a"), (2, 1, "a", None), (3, 1, "a", "b")], "obs_seq long, pid long, from_bundle string, to_bundle string")
    assert values(lifecycle.focus_events(f), "obs_seq") == [(0,), (3,)]
    o = spark.createDataFrame([("process", None), ("network", "dns_query"), ("network", None), ("system", None)], "source string, kind string")
    assert values(lifecycle.route(o), "stage") == [("connection",), ("dns",), ("process",), (None,)]


def test_as_of_uses_what_had_come_out(spark):
    births = spark.createDataFrame([(1, 10, 5, "old"), (1, 20, 9, "new")], "pid long, start long, emit_seq long, comm string")
    deaths = spark.createDataFrame([(1, 10, 7)], "pid long, start long, emit_seq long")
    events = spark.createDataFrame([(5, 1), (6, 1), (8, 1), (10, 1), (11, 2), (12, None)], "seq long, pid long")
    got = enrich.as_of(events, births, deaths, attrs=["comm"])
    assert values(got, "seq", "comm", "alive") == [(10, "new", True), (11, None, None), (12, None, None), (5, None, None), (6, "old", True), (8, "old", False)]


def test_ancestors_stop_at_cycles_and_depth(spark):
    parents = spark.createDataFrame([(2, 3), (3, 4), (4, 2), (9, 8), (8, 1)], "child long, parent long")
    start = spark.createDataFrame([(2,), (9,)], "id long")
    assert values(enrich.ancestors(start, parents), "id", "hop", "ancestor") == [(2, 1, 3), (2, 2, 4), (9, 1, 8)]
    assert enrich.ancestors(start, parents, depth=1).count() == 2
    assert enrich.ancestors(start, parents.limit(0)).count() == 0
    assert values(enrich.ancestors_sql(spark, parents, 9, 5), "hop", "ancestor") == [(1, 8), (2, 1)]


def test_ancestors_equal_a_walk(spark):
    """Doubled chains against a walk: long chains, several parents, cycles, repeated rows and nulls."""
    r = random.Random(5)
    pairs = [(i, i - 1) for i in range(100, 150)] + [(i, r.randint(0, 40)) for i in range(2, 40)] + [(200, 201), (201, 202), (202, 200), (203, 200), (300, 2), (300, 3), (300, 3), (7, 7), (None, 3), (5, None)]
    ids = [*range(2, 40, 3), 105, 149, 200, 203, 300, 7, None, 300]
    parents, start = spark.createDataFrame(pairs, "child long, parent long"), spark.createDataFrame([(i,) for i in ids], "id long")
    for depth in (1, 2, 3, 32):
        want, now = [], {(i,) for i in ids if i is not None}
        for hop in range(1, depth + 1):
            now = {(*path, p) for path in now for c, p in pairs if c == path[-1] and p is not None and p > 1 and p not in path}
            want += [(path[0], hop, path[-1]) for path in now]
        assert sorted(values(enrich.ancestors(start, parents, depth), "id", "hop", "ancestor")) == sorted(want)


def events(spark, rows):
    names = "seq long, t long, kind string, pid long, start long, ppid long, uid long, comm string, name string, exec_path string, proto string, local_addr string, foreign_addr string, process_name string, rx long, tx long, path string, flags array<string>, count long, qname string, qtype string, masked boolean, name_hash string, client string, to_bundle string, to_name string, duration_ns long"
    columns = [c.split()[0] for c in names.split(", ")]
    return spark.createDataFrame([tuple({"seq": i, "t": i, **r}.get(c) for c in columns) for i, r in enumerate(rows)], names)


def test_nodes(spark):
    e = events(spark, [
        {"kind": "process_birth", "pid": 1, "start": 1, "comm": "a"}, {"kind": "process_death", "pid": 1, "start": 1, "comm": "a"}, {"kind": "process_death", "pid": 2, "start": 1, "comm": "b"},
        {"kind": "connection_opened", "pid": 1, "proto": "tcp4", "local_addr": "l", "foreign_addr": "f", "rx": 5, "tx": 6}, {"kind": "connection_closed", "pid": 1, "proto": "tcp4", "local_addr": "l", "foreign_addr": "f", "rx": 7},
        {"kind": "file_changed", "path": "/x", "flags": ["a"], "count": 2}, {"kind": "file_changed", "path": "/x", "flags": ["b", "a"], "count": 1},
        {"kind": "dns_query", "pid": 1, "qname": "e.com.", "qtype": "A", "masked": False}, {"kind": "dns_query", "qname": "x", "masked": True, "name_hash": "h"}, {"kind": "dns_query", "qname": ""},
    ])
    assert values(graph.process_nodes(e), "pid", "birth", "death") == [(1, 0, 1), (2, 2, 2)]
    assert values(graph.socket_nodes(e), "id", "opened", "closed", "rx", "tx") == [("tcp4|l|f", 3, 4, 7, 6)]
    assert values(graph.file_nodes(e), "path", "flags", "touch_count", "first_seen", "last_seen") == [("/x", ["a", "b"], 3, 5, 6)]
    assert values(graph.domain_nodes(e), "name", "masked", "query_count") == [("e.com", False, 1), ("hash:h", True, 1)]
    assert values(graph.domain_tally(e), "pid", "domain", "count") == [(1, "e.com", 1)]


def test_app_intervals_keep_the_first_beginning(spark):
    e = events(spark, [{"kind": "app_focus", "to_bundle": b} for b in "aab"])
    assert values(graph.app_intervals(e, F.lit(9)), "app", "from", "to") == [("a", 0, 1), ("a", 0, 2), ("b", 2, 9)]


def test_edges(spark):
    p = spark.createDataFrame([(1, 1, None, 0, None), (100, 1000, 1, 10, 30), (100, 1001, 1, 40, None)], "pid long, start long, ppid long, birth long, death long")
    assert values(graph.parent_edges(p), "parent_id", "child_id") == [("1:1", "100:1000"), ("1:1", "100:1001")]
    rows = spark.createDataFrame([(100, 50), (100, 30), (100, 35), (7, 1)], "pid long, opened long")
    assert values(graph.attributed(rows, p, "opened"), "opened", "process_id") == [(30, "100:1000"), (50, "100:1001")]
    i = spark.createDataFrame([("a", 15, 45), ("b", 60, None), ("c", 30, 40)], "app string, from long, to long")
    want = [("a", "100:1000", 15, 30), ("a", "100:1001", 40, 45), ("a", "1:1", 15, 45), ("b", "100:1001", 60, None), ("b", "1:1", 60, None), ("c", "1:1", 30, 40)]
    for bucket in (1, 7, 1000):
        assert values(graph.frontmost_edges(i, p, bucket), "app", "process_id", "from", "to") == sorted(want, key=repr)
    kept, gone = graph.trim(p, 35, "death")
    assert (kept.count(), gone.count()) == (2, 1)


def test_analytics(spark):
    n = spark.createDataFrame([(x, x.upper()) for x in "abcdx"], "id string, label string")
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("a", "b", 5)], "src string, dst string, weight long")
    assert values(analytics.degrees(n, e), "id", "degree", "distinct_degree", "weighted") == [("a", 2, 1, 6), ("b", 3, 2, 7), ("c", 1, 1, 1), ("d", 0, 0, 0), ("x", 0, 0, 0)]
    assert values(analytics.components(n, e), "id", "component") == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("x", "x")]
    assert values(analytics.component_sizes(n, e.limit(0)), "size") == [(1,)] * 5
    top, sizes = analytics.topology(n, e, 1)
    assert values(top, "label") == [("B",)] and sizes.first()["size"] == 3


def test_components_with_hubs(spark, monkeypatch):
    """Stars of many edges, chained, among other edges: components equal a union of sets, and no task holds a hub."""
    from telemill.operators import components

    monkeypatch.setattr(components, "HUB", 100)
    r = random.Random(2)
    pairs = [(5000, i) for i in range(3000)] + [(6000, 5001 + i) for i in range(900)] + [(6000, 5000)] + [(r.randint(7000, 7400), r.randint(7000, 7400)) for _ in range(300)] + [(8000, 8000), (None, 3), (3, None), (7000, 7001), (7001, 7000)]
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = sorted((root(a), root(b)))
            top[b] = a
    e = spark.createDataFrame(pairs, "a long, b long")
    assert sorted(values(components.connected_components(e), "node", "component")) == sorted((x, root(x)) for x in top)
    assert components.connected_components(e.limit(0)).count() == 0
    star = spark.range(20_000).select(F.lit(-1).cast("long").alias("u"), F.col("id").alias("v")).union(spark.range(1000).select("id", F.col("id") + 1))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = components.with_least(star, 21_000)
        sizes = [x["n"] for x in out.groupBy(F.spark_partition_id()).agg(F.count("m").alias("n")).collect()]
        assert len(sizes) == 3, sizes
        assert max(sizes) < 1.3 * min(sizes), sizes
        assert out.where("m <> greatest(u + 1, 0)").isEmpty()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_components_of_a_long_path(spark):
    from telemill.operators.components import connected_components

    e = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "a long, b long")
    assert values(connected_components(e).groupBy("component").count(), "component", "count") == [(0, 61), (100, 2)]


def test_classes_after_more_links(spark):
    """Merged classes are those of all links; links inside a class change nothing and take no round."""
    from telemill.operators.components import connected_components, merged

    pairs = lambda p: spark.createDataFrame(p, "a long, b long")
    first, more = [(2, 1), (3, 2), (10, 11), (20, 21)], [(3, 11), (40, 41), (41, 5), (50, 20), (10, 10)]
    classes = connected_components(pairs(first)).select(F.col("node").alias("doc"), F.col("component").alias("c"))
    assert values(merged(classes, pairs(more)), "doc", "c") == values(connected_components(pairs(first + more)), "node", "component")
    assert merged(classes, pairs([(1, 3), (11, 10), (7, 7)])) is None
    assert values(merged(classes.limit(0), pairs(first)), "doc", "c") == values(classes, "doc", "c")


def test_few_edges_are_not_sorted(spark):
    """Where no node can be a hub, a round shuffles its edges once for each least one and joins by broadcast."""
    from telemill.operators.components import HUB, with_least

    e = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "u long, v long")
    for rows, sorted_ in ((3, False), (HUB + 1, True)):
        out = with_least(e, rows)
        assert values(out, "u", "v", "m") == [(1, 2, 2), (1, 3, 2), (2, 3, 3)]
        assert ("SortMergeJoin" in out._jdf.queryExecution().sparkPlan().toString()) == sorted_


def test_snapshot_differences(spark):
    none = spark.createDataFrame([], "id string, label string"), spark.createDataFrame([], "src string, dst string, weight long")
    n = spark.createDataFrame([(x, x) for x in "abcdefg"], "id string, label string")
    star = spark.createDataFrame([("a", x, 1) for x in "bcdefg"], "src string, dst string, weight long")
    assert ("new_component", "a", 7, 0) in values(analytics.snapshot_diff(*none, n, star), "metric", "entity", "observed", "baseline")
    d = values(analytics.snapshot_diff(n, star, n, star.where("dst < 'd'")), "metric", "entity", "observed")
    assert d == [("component_merge", "a", 5)]
    assert ("degree_spike", "a", 6, 1) in values(analytics.snapshot_diff(n, star.limit(1), n, star), "metric", "entity", "observed", "baseline")


def test_merges(spark):
    node = "kind string, id string, first_seen long, last_seen long, comm string"
    old, new = spark.createDataFrame([("process", "1", 100, 100, "a"), ("process", "2", 1, 1, "k")], node), spark.createDataFrame([("process", "1", 20, 50, "b"), ("process", "3", 5, 5, "c")], node)
    assert values(store.merge_nodes(old, new), "id", "comm", "first_seen", "last_seen", "how") == [("1", "b", 20, 100, "updated"), ("2", "k", 1, 1, "kept"), ("3", "c", 5, 5, "inserted")]
    key = "kind string, from_kind string, from_id string, to_kind string, to_id string"
    e = ("parent_of", "process", "1", "process", "2")
    a = spark.createDataFrame([(*e, 1, 50, 50)], key + ", count long, first_seen long, last_seen long")
    b = spark.createDataFrame([(*e, 20), (*e, 60)], key + ", seen_at long")
    assert values(store.merge_edges(a, b), "count", "first_seen", "last_seen", "how") == [(3, 50, 60, "updated")]
    assert values(store.merge_edges(a.limit(0), b), "count", "first_seen", "how") == [(2, 20, "inserted")]


def test_store_keeps_versions(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    nodes = spark.createDataFrame([("process", "1", 1, 9, "a"), ("process", "2", 1, 3, "b")], "kind string, id string, first_seen long, last_seen long, comm string")
    edges = spark.createDataFrame([("parent_of", "process", "1", "process", "2", 9)], "kind string, from_kind string, from_id string, to_kind string, to_id string, seen_at long")
    assert s.merge_graph(nodes, edges) == {"nodes_inserted": 2, "edges_inserted": 1}
    assert s.merge_graph(nodes, edges) == {"nodes_updated": 2, "edges_updated": 1}
    assert s.read("edges").first()["count"] == 2 and s.version() == 2
    assert s.append_events(spark.createDataFrame([(0, 5, "dns_query"), (1, 50, "dns_query")], "seq long, ts_ns long, kind string")) == 2
    assert s.prune_before(5) == {"nodes": 1, "edges": 1, "events": 0}
    assert s.read("nodes").count() == 1 and s.read("edges").count() == 0 and s.read("events").count() == 2
    s.set_meta("pid", "7")
    assert s.get_meta("pid") == "7"
    with pytest.raises(ValueError):
        s.set_meta("schema_version", "9")


def test_summaries(spark):
    e = events(spark, [
        *[{"kind": "process_birth", "pid": i, "comm": c} for i, c in enumerate(["mdworker_shared", "git", "git", "bash"])],
        {"kind": "connection_completed", "foreign_addr": "1.1.1.1.80", "process_name": "x", "rx": 100, "tx": 50, "duration_ns": 1_900_000}, {"kind": "connection_opened", "foreign_addr": "1.1.1.1.80", "process_name": "x", "rx": 999},
        {"kind": "connection_opened", "foreign_addr": "2.2.2.2.4444", "process_name": "nc", "rx": 10},
        *[{"kind": "dns_query", "client": "git", "name_hash": h, "qname": q, "masked": m} for h, q, m in (("aa", "github.com.", False), ("aa", "github.com..", False), ("bb", "secret", True))],
        *[{"kind": "file_changed", "path": p} for p in ("/Users/me/Projects/x/.git/F", "/Users/me/Projects/x/y", "/tmp/x")],
    ])
    assert values(summary.top_processes(e), "comm", "spawns") == [("bash", 1), ("git", 2)]
    assert values(summary.endpoints(e), "foreign_addr", "bytes_total", "still_open", "rank") == [("1.1.1.1.80", 150, False, 1), ("2.2.2.2.4444", 10, True, 2)]
    assert values(summary.dns_clients(e), "client", "unique_names", "total", "examples") == [("git", 2, 3, ["github.com"])]
    assert values(summary.directories(e), "directory", "changes") == [("/Users/me/Projects/x", 2), ("/tmp/x", 1)]
    assert values(summary.conversations(e), "host", "port", "rx", "duration_ms") == [("1.1.1.1", "80", 100, 1)]
    assert values(summary.event_suspicions(e), "text") == [("nc reached 2.2.2.2.4444, common reverse-shell port on port 4444",)]


def test_endpoints_still_open_stay_visible(spark):
    e = events(spark, [{"kind": "connection_completed", "foreign_addr": f"a{i}", "process_name": "x", "rx": 100 + i, "tx": 0} for i in range(9)] + [{"kind": "connection_opened", "foreign_addr": f"o{i}", "process_name": "x", "rx": i, "tx": 0} for i in range(4)])
    assert values(summary.endpoints(e).where("rank > 8"), "foreign_addr", "rank") == [("o2", 10), ("o3", 9)]


def test_short_lived_bursts(spark):
    rows = [{"kind": "process_birth", "pid": i, "comm": "w", "t": i * SEC} for i in range(5)] + [{"kind": "process_death", "pid": i, "comm": "w", "t": i * SEC + 2 * SEC} for i in range(5)]
    e = events(spark, rows)
    assert values(summary.short_lived(e), "comm", "n") == [("w", 5)]
    assert "5 runs of w were over" in summary.event_suspicions(e).first()["text"]


def test_flags_are_capped(spark):
    nodes = spark.createDataFrame([("process", f"{i}:1", 0, 9, f"c{i}", f"/tmp/{i}", 501) for i in range(10)], "kind string, id string, first_seen long, last_seen long, comm string, exec_path string, uid long")
    edges = spark.createDataFrame([], "kind string, from_id string, to_id string")
    rows = values(summary.store_flags(nodes, edges), "rank", "text")
    assert len(rows) == 7 and rows[-1] == (7, "(+4 outside trusted paths)")


def test_baselines(spark):
    a = spark.createDataFrame([(list(map(float, range(1, 101))),)], "a array<double>").select(F.explode("a").alias("x"))
    assert a.agg(S.nearest_rank("x", 0.99).alias("p")).first()["p"] == 99 and a.limit(0).agg(S.nearest_rank("x", 0.5).alias("p")).first()["p"] == 0
    m = spark.createDataFrame([([10.0, 20.0],)], "a array<double>").select(S.ewma("a").alias("e")).first()["e"]
    assert (m["mean"], round(m["var"], 6)) == (13.0, 21.0)
    r = random.Random(2)
    rows = [(k, i, r.uniform(-5, 1000)) for k in ("a", None) for i in range(40)] + [("one", 3, 7.0)]
    long = spark.createDataFrame(rows, "k string, o long, x double")
    want = {k: long.where(F.col("k").eqNullSafe(k)).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "x"))), lambda s: s["x"]).alias("a")).select(S.ewma("a").alias("e")).first()["e"] for k in ("a", None, "one")}
    for block in ("o div 1", "o div 7", "o div 100"):
        got = {x["k"]: x for x in baseline.weighted(long, ["k"], "o", F.col("x"), block).collect()}
        assert all(abs(got[k]["mean"] - e["mean"]) < 1e-6 and abs(got[k]["var"] - e["var"]) < 1e-4 for k, e in want.items()) and len(got) == 3
    hist = spark.createDataFrame([(i, (i // 2) * 3600 * SEC, "dns_query", "chrome") for i in range(240)], "seq long, ts_ns long, kind string, client string").withColumns({"comm": F.lit(None).cast("string"), "t": F.col("ts_ns")})
    edges = spark.createDataFrame([], "from_id string")
    warm = baseline.Baseline(hist, edges, 5 * 24 * 3600 * SEC)
    live = lambda n: spark.createDataFrame([(i, i, "dns_query", "chrome", f"h{i}") for i in range(n)], "seq long, t long, kind string, client string, name_hash string")
    assert not warm.cold and warm.dns_fanout(live(2)).count() == 0 and warm.dns_fanout(live(40)).first()["baseline_p99"] < 40
    cold = baseline.Baseline(hist.limit(1), edges, SEC)
    assert cold.cold and cold.dns_fanout(live(40)).count() == 0 and cold.dns_fanout(live(60)).count() == 1


def test_functions(spark):
    d = spark.createDataFrame([(s,) for s in (0, 45, 60, 125, 3600, 3725, 90000, 86400)], "s long")
    assert [r[0] for r in d.select(S.fmt_duration("s")).collect()] == ["0s", "45s", "1m", "2m5s", "1h", "1h2m", "1d1h", "1d"]
    a = spark.createDataFrame([(x,) for x in ("140.82.112.4.443", "2607:f8b0::200e.443", "1.2.3.4", "example.com", "::1.80", "1.2.3.4.99999", "*.*", "::.1", "1:2:3:4:5:6:7:8.9", "1::2::3.4")], "a string")
    assert [r[0] for r in a.select(S.foreign_port("a")).collect()] == [443, 443, None, None, 80, None, None, 1, 9, None]
    q = spark.createDataFrame([("e.com.", False, "h"), ("e.com", None, None), ("x", True, "h"), ("", False, ""), (None, None, None)], "q string, m boolean, h string")
    assert [r[0] for r in q.select(S.domain_id("q", "m", "h")).collect()] == ["e.com", "e.com", "hash:h", None, None]
    f = spark.createDataFrame([(0x100 | 0x10000,)], "m long").select(S.file_flags("m")).first()[0]
    assert f == ["created", "is_file"]
    m = spark.createDataFrame([("DNSServiceQueryRecord START -- qname: <mask.hash: 'x'>, qtype: PTR, flags: 0, interface index: -1, client pid: 17 (gk_3 (x)), name hash: 1f",)], "message string")
    g = m.select(*[c.alias(k) for k, c in S.dns_fields("message").items()]).first().asDict()
    assert g == {"qname": "<mask.hash: 'x'>", "qtype": "PTR", "interface_index": -1, "pid": 17, "client_process_name": "gk_3 (x", "name_hash": "1f", "masked": True}


def history(spark):
    """A small capture of all kinds of events."""
    return events(spark, [
        {"kind": "process_birth", "pid": 10, "start": 1, "comm": "sh", "uid": 500, "exec_path": "/bin/sh"}, {"kind": "process_birth", "pid": 100, "start": 2, "comm": "x", "uid": 0, "ppid": 10, "exec_path": "/tmp/x"},
        {"kind": "app_focus", "to_bundle": "app", "to_name": "App"}, {"kind": "connection_opened", "pid": 100, "proto": "tcp4", "local_addr": "l.1", "foreign_addr": "f.2", "rx": 5, "tx": 6, "process_name": "x"},
        {"kind": "file_changed", "path": "/a/b/c", "flags": ["m"], "count": 2}, {"kind": "dns_query", "pid": 100, "qname": "e.com.", "qtype": "A", "masked": False},
        {"kind": "app_focus", "to_bundle": "other", "to_name": "Other"}, {"kind": "connection_closed", "pid": 100, "proto": "tcp4", "local_addr": "l.1", "foreign_addr": "f.2", "rx": 7, "tx": 8, "process_name": "x"}, {"kind": "process_death", "pid": 100, "start": 2, "comm": "x"},
    ])


def test_graph_goes_to_the_store_and_back(spark, tmp_path):
    from telemill.operators import persist

    g = persist.build(history(spark))
    s = store.Store(spark, str(tmp_path / "s"))
    assert {k: v.count() for k, v in s.load_graph().items()} == dict.fromkeys(g, 0)
    first = s.merge_typed(g)
    assert first["nodes_inserted"] == 7 and first["edges_inserted"] == g["frontmost_during"].count() + 3
    s.merge_typed(g)
    assert values(s.read("edges").where("kind <> 'frontmost_during'"), "kind", "count", "first_seen", "last_seen") == [("opened_socket", 2, 7, 7), ("parent_of", 2, 8, 8), ("queried_domain", 2, 5, 5)]
    back = s.load_graph()
    for part in ("processes", "sockets", "files", "domains", "parent_of", "frontmost_during", "opened_socket", "queried_domain"):
        same = [c for c in back[part].columns if c in g[part].columns]
        assert values(back[part], *same) == values(g[part], *same), part
    assert values(back["apps"], "id", "name", "intervals") == values(g["apps"], "id", "name", "intervals")
    assert values(store.focus_segments(s.read("edges"), s.read("nodes"), 0, 100 * SEC), "app_id", "name")
    assert [r["pid"] for r in spark.sql("select 'x:7' as id union all select '5' union all select '3:b'").select(persist.process_id("id")[0].alias("pid")).orderBy("pid").collect()] == [0, 3, 5]
    assert {r["part"]: r["n"] for r in persist.counts(back).collect()}["sockets"] == 1
    persist.write_json({"processes": g["processes"]}, str(tmp_path / "json"))
    assert values(persist.read_json(spark, str(tmp_path / "json"), {"processes": g["processes"]})["processes"], "pid", "comm") == values(g["processes"], "pid", "comm")


def test_store_survives_crashes(spark, tmp_path):
    """What a crash leaves behind (files of a version that isn't named, a lock) is neither read nor lost."""
    s = store.Store(spark, str(tmp_path / "s"))
    assert s.prune_before(5) == {"nodes": 0, "edges": 0, "events": 0} and s.version() == 0 and s.read("nodes") is None
    node = "kind string, id string, first_seen long, last_seen long, comm string"
    edge = "kind string, from_kind string, from_id string, to_kind string, to_id string, seen_at long"
    nodes, edges = spark.createDataFrame([("process", "1", 1, 9, "a")], node), spark.createDataFrame([("parent_of", "process", "1", "process", "1", 9)], edge)
    s.merge_graph(nodes, edges)
    nodes.write.parquet(str(tmp_path / "s" / "version-2" / "nodes"))  # a crash before version 2 is named
    again = store.Store(spark, str(tmp_path / "s"))
    assert again.version() == 1 and again.read("nodes").count() == 1
    for i in range(3):
        again.merge_graph(nodes, edges)
    assert again.version() == 4 and again.read("edges").first()["count"] == 4
    assert sorted(x.name for x in (tmp_path / "s").iterdir() if x.name.startswith("version-")) == ["version-3", "version-4"]
    with s.lock():
        with pytest.raises(RuntimeError), again.lock():
            pass
    with again.lock():
        pass


def test_enrichment_of_all_kinds_with_ancestors(spark):
    """The process and its chain as known before an event came out; what comes later, and focus changes, don't count."""
    births = spark.createDataFrame([(1, 1, 0, 0, "init"), (10, 5, 1, 1, "sh"), (100, 6, 10, 2, "cc"), (100, 9, 10, 20, "new"), (7, 1, 8, 3, "a"), (8, 1, 7, 4, "b")], "pid long, start long, ppid long, emit_seq long, comm string")
    deaths = spark.createDataFrame([(10, 5, 12)], "pid long, start long, emit_seq long")
    rows = spark.createDataFrame([(11, 100, "dns_query"), (13, 100, "connection_opened"), (2, 100, "connection_closed"), (21, 100, "connection_completed"), (30, 100, "app_focus"), (31, None, "dns_query"), (32, 99, "dns_query"), (33, 7, "dns_query")], "seq long, pid long, kind string")
    got = {r["seq"]: (r["process"] and (r["process"]["start"], r["process"]["comm"], r["process"]["alive"]), r["ancestors"] and [(x["pid"], x["comm"]) for x in r["ancestors"]]) for r in enrich.enriched(rows, births, deaths, attrs=["comm"]).collect()}
    assert got == {11: ((6, "cc", True), [(10, "sh")]), 13: ((6, "cc", True), [(10, "sh")]), 2: (None, None), 21: ((9, "new", True), [(10, "sh")]), 30: (None, None), 31: (None, None), 32: (None, None), 33: ((1, "a", True), [(8, "b")])}


def test_narration(spark):
    from telemill.operators import narrate, persist
    from telemill.report import bar, window_prompt

    g = persist.build(history(spark))
    facts = narrate.graph_facts(g)
    assert values(facts["things"], "part", "n") == [("apps", 2), ("domains", 1), ("files", 1), ("processes", 2), ("sockets", 1)]
    assert facts["span"].first()["last_t"] == 8 and values(facts["endpoints"], "foreign_addr", "bytes_total", "still_open") == [("f.2", 15, False)]
    c = narrate.graph_candidates(g["processes"], ("/bin/",), 1)
    assert values(c, "pid", "reasons") == [(10, "prolific_parent"), (100, "root_under_user,outside_trusted")]
    assert "parent_comm=sh" in {r["pid"]: r["line"] for r in narrate.candidate_lines(c, g["processes"]).collect()}[100]
    novel = {"domains": spark.createDataFrame([("e.com", 5 * SEC)], "id string, first_seen long"), "apps": spark.createDataFrame([("a", None, 6 * SEC)], "id string, name string, first_seen long")}
    assert [r["text"] for r in narrate.novelty_lines(novel, False, 65 * SEC).collect()] == ["new domain e.com, first at unix 5 (1m ago)", "new app a, first at unix 6 (59s ago)"]
    assert narrate.novelty_lines(novel, True, 0).count() == 1
    text = window_prompt({"domains": facts["domains"], "processes": facts["processes"]}, "head", "say")
    assert text.index("## processes") < text.index("## domains") and text.startswith("head") and text.endswith("say")
    assert bar("x", 9) == "=== x ==="


def test_stream_of_events_to_the_store(spark, tmp_path):
    from telemill.operators import persist
    from telemill.streaming import capture

    h = history(spark).withColumn("ts_ns", F.col("t"))
    h.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(h.schema).parquet(str(tmp_path / "in"))
    s = store.Store(spark, str(tmp_path / "s"))
    capture.capture(stream, s, str(tmp_path / "ck"), retention_days=0)
    assert s.read("events").count() == h.count() and {r["part"]: r["n"] for r in persist.counts(s.load_graph()).collect()}["processes"] == 2
    sink = capture.StoreSink(s, 1, lambda: 10 * 86400 * SEC)
    sink(h, 0)  # the same batch again
    assert s.read("events").count() == h.count()
    assert sink.prune()["events"] == h.count() and sink.prune() is None


def test_command_line(spark, tmp_path):
    from telemill import cli
    from telemill.operators import persist

    s = store.Store(spark, str(tmp_path / "s"))
    for command in cli.COMMANDS:  # a store without anything
        assert cli.answer(s, cli.parse([str(tmp_path / "s"), command]), 100 * SEC).count() >= 0
    s.merge_typed(persist.build(history(spark)))
    s.append_events(history(spark).withColumn("ts_ns", F.col("t")))
    n = {c: cli.answer(s, cli.parse([str(tmp_path / "s"), c]), 100 * SEC).count() for c in cli.COMMANDS if c != "prune"}
    assert n["processes"] == 2 and n["endpoints"] == 1 and n["events"] == 9 and n["graph"] == 9 and n["candidates"] >= 1 and n["dot"] > 7
