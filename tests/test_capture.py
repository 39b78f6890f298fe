"""The store under streams: any cut into batches, crashes at any write, buckets, parts, locks."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from telemill.operators import fold, persist, store
from telemill.streaming import capture
from test_operators import SEC, events, history, values

DAY = 86_400 * SEC


def random_history(spark, seed, n=60):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        pid, start = r.randint(1, 5), r.randint(1, 2)
        kind = r.choice(["process_birth"] * 3 + ["process_death", "app_focus", "app_focus", "connection_opened", "connection_closed", "connection_completed", "file_changed", "dns_query", "dns_query"])
        rows.append({
            "t": i // 2, "kind": kind, "pid": pid, "start": start, "ppid": r.choice([None, 1, 2, 3]), "uid": r.choice([0, 501]), "comm": f"c{i}", "proto": "tcp4", "local_addr": f"l.{r.randint(1, 2)}", "foreign_addr": f"f.{r.randint(1, 2)}", "rx": r.choice([None, i]), "tx": i, "process_name": f"p{pid}",
            "path": f"/{r.randint(1, 3)}", "flags": r.sample(["a", "b", "c"], r.randint(0, 3)), "count": r.randint(0, 2), "qname": r.choice(["x.com.", "y.com", ""]), "qtype": r.choice(["A", "AAAA", None]), "masked": r.choice([None, True, False]), "name_hash": r.choice(["h", None]), "to_bundle": r.choice(["app1", "app2", None]), "to_name": r.choice(["One", None]),
        })
    return events(spark, rows).withColumn("ts_ns", F.col("t") * 3600 * SEC)


def whole(s):
    """All rows of a store, whatever their order and files."""
    out = {}
    for t in ("nodes", "edges", "events"):
        f = s.read(t)
        out[t] = None if f is None else sorted((tuple(repr(r[c]) for c in sorted(f.columns)) for r in f.collect()))
    return out


def at_once(spark, h, path):
    s = store.Store(spark, path)
    s.merge_typed(persist.build(h))
    s.append_events(h)
    return s


def cuts(h, seed, n):
    r = random.Random(seed)
    borders = sorted(r.sample(range(1, n), r.randint(1, 4)))
    return [h.where((F.col("seq") >= a) & (F.col("seq") < b)) for a, b in zip([0, *borders], [*borders, n], strict=True)]


@pytest.mark.parametrize("seed", [1])
def test_any_cut_of_a_history_makes_the_same_store(spark, tmp_path, seed):
    h = random_history(spark, seed).coalesce(1).cache()
    want = whole(at_once(spark, h, str(tmp_path / "one")))
    s = store.Store(spark, str(tmp_path / "many"), buckets=3)
    sink = capture.StoreSink(s, 0)
    for k, batch in enumerate(cuts(h, seed, 60)):
        sink(batch, k)
    assert whole(s) == want
    late = store.Store(spark, str(tmp_path / "late"), buckets=2)
    sink = capture.StoreSink(late, 0, graph_every_ns=10**30)
    for k, batch in enumerate(cuts(h, seed + 7, 60)):
        sink(batch, k)
    sink.finish()
    assert whole(late) == want


def test_a_state_is_that_of_the_whole_in_any_order(spark):
    h = random_history(spark, 5).coalesce(1).cache()
    want = fold.of_events(h)
    parts = [fold.of_events(b) for b in cuts(h, 3, 60)][::-1]
    for p in fold.TABLES:
        got = parts[0][p]
        for other in parts[1:]:
            got = fold.combined(p, got, other[p])
        assert values(got, *got.columns) == values(want[p], *got.columns), p
    g, b = fold.graph(want), persist.build(h)
    for part, frame in b.items():
        assert values(g[part], *frame.columns) == values(frame, *frame.columns), part


class Crash(Exception):
    pass


def crashing(monkeypatch, cls, name, at):
    """Let the at-th call of a method fail, before or after it has done its work by turns."""
    real, calls = getattr(cls, name), [0]

    def maybe(self, *args, **kwargs):
        calls[0] += 1
        if calls[0] == at and at % 2:
            raise Crash(name)
        out = real(self, *args, **kwargs)
        if calls[0] == at:
            raise Crash(name)
        return out

    monkeypatch.setattr(cls, name, maybe)


def test_a_crash_at_any_step_changes_nothing(spark, tmp_path, monkeypatch):
    h = history(spark).withColumn("ts_ns", F.col("t")).coalesce(1).cache()
    want = whole(at_once(spark, h, str(tmp_path / "one")))
    steps = [(store.Transaction, "put", 1), (store.Transaction, "put", 4), (store.Transaction, "append", 1), (store.Transaction, "put_changed", 2), (store.Transaction, "commit", 1)]
    for k, batch in enumerate([h.where("seq < 5"), h.where("seq >= 5")]):
        for cls, name, at in [*steps, (store.Store, "_clear", 1)]:
            with monkeypatch.context() as m:
                crashing(m, cls, name, at)
                with pytest.raises(Crash):
                    capture.StoreSink(store.Store(spark, str(tmp_path / "s"), buckets=2), 0)(batch, k)
    s = store.Store(spark, str(tmp_path / "s"))
    assert s.version() == 2 and whole(s) == want
    for k, batch in enumerate([h.where("seq < 5"), h.where("seq >= 5")]):  # all again, as after a restart from an old checkpoint
        capture.StoreSink(s, 0)(batch, k)
    assert s.version() == 2 and whole(s) == want


def test_a_stream_of_many_files_is_merged_with_what_the_store_had(spark, tmp_path):
    h = history(spark).withColumn("ts_ns", F.col("t")).coalesce(1).cache()
    for i in range(3):
        h.where(F.expr(f"seq div 3 = {i}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    s = at_once(spark, h, str(tmp_path / "s"))
    stream = spark.readStream.schema(h.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    capture.capture(stream, s, str(tmp_path / "ck"), retention_days=0)
    twice = at_once(spark, h, str(tmp_path / "t"))
    twice.merge_typed(persist.build(h))
    twice.append_events(h)
    assert whole(s) == whole(twice)
    capture.capture(stream, s, str(tmp_path / "ck"), retention_days=0)  # goes on where it was: nothing new
    assert whole(s) == whole(twice)
    capture.capture(spark.readStream.schema(h.schema).parquet(str(tmp_path / "in")), s, str(tmp_path / "other"), retention_days=0)  # another stream, merged once more
    assert s.read("edges").where("kind = 'parent_of'").first()["count"] == 3 and s.read("events").count() == 27


def test_timed_capture_ends(spark, tmp_path):
    h = history(spark).withColumn("ts_ns", F.col("t"))
    h.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = store.Store(spark, str(tmp_path / "s"))
    began = time.time()
    capture.capture(spark.readStream.schema(h.schema).parquet(str(tmp_path / "in")), s, str(tmp_path / "ck"), seconds=8, every="1 second", retention_days=0)
    assert 8 <= time.time() - began < 40 and s.read("events").count() == 9 and s.get_meta("heartbeat_ns")


def files(s, table):
    return dict(s._about(s.version())["tables"][table]["buckets"])


def test_a_merge_leaves_other_buckets_alone(spark, tmp_path):
    node = "kind string, id string, first_seen long, last_seen long, comm string"
    edge = "kind string, from_kind string, from_id string, to_kind string, to_id string, seen_at long"
    many = spark.createDataFrame([("process", str(i), i, i, "c") for i in range(200)], node)
    e = spark.createDataFrame([("parent_of", "process", str(i), "process", str(i + 1), i) for i in range(100)], edge)
    s = store.Store(spark, str(tmp_path / "s"), buckets=8)
    s.merge_graph(many, e)
    before = files(s, "nodes"), files(s, "edges")
    assert len(before[0]) == 8
    assert s.merge_graph(many.where("id = '7'").withColumn("comm", F.lit("new")), e.where("from_id = '7'")) == {"nodes_updated": 1, "edges_updated": 1}
    after = files(s, "nodes"), files(s, "edges")
    assert [sum(a[b] != x[b] for b in x) for x, a in zip(before, after, strict=True)] == [1, 1]
    want = store.merge_nodes(many, many.where("id = '7'").withColumn("comm", F.lit("new")))
    assert values(s.read("nodes"), "id", "comm", "first_seen") == values(want, "id", "comm", "first_seen")
    assert s.read("edges").agg(F.sum("count")).first()[0] == 101
    s.prune_before(5)
    assert s.read("nodes").count() == 195 and s.read("edges").count() == 95


def test_a_window_opens_its_own_days_only(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    rows = spark.range(0, 400).select(F.col("id").alias("seq"), (F.col("id") * (DAY // 4) + 5).alias("ts_ns"), F.expr("if(id % 2 = 0, 'dns_query', 'app_focus')").alias("kind"))
    for k in range(4):
        s.append_events(rows.where(F.col("seq") % 4 == k))
    got = s.events_in_window(20 * DAY, 30 * DAY - 1, ["dns_query"])
    opened = {f.split("__day=")[1].split("/")[0] for f in got.inputFiles()}
    assert opened == {str(d) for d in range(20, 30)}
    assert [r["seq"] for r in got.collect()] == list(range(80, 120, 2))
    plan = got._jdf.queryExecution().toString()
    assert "kind" in plan and "PushedFilters" in plan
    assert s.prune_before(50 * DAY + 10)["events"] == 201 and s.read("events").count() == 199
    assert s.events_in_window(0, 40 * DAY).count() == 0


def test_parts_of_a_day_are_gathered(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    for k in range(store.Store.FAN + 2):
        s.append_events(spark.createDataFrame([(k, k, "dns_query")], "seq long, ts_ns long, kind string"))
    assert len(s._about(s.version())["tables"]["events"]["parts"]) == 3 and s.read("events").count() == store.Store.FAN + 2
    kept = [d for d in os.listdir(tmp_path / "s") if d.startswith("version-")]
    assert len(kept) <= 4  # what the newest versions name


def test_pruning_trims_the_state(spark, tmp_path):
    h = history(spark).withColumn("ts_ns", F.col("t")).coalesce(1)
    s = store.Store(spark, str(tmp_path / "s"), buckets=2)
    sink = capture.StoreSink(s, 0)
    sink(h, 0)
    assert s.prune_before(6) == {"nodes": 3, "edges": 4, "events": 6}
    assert s.read("fold_file").count() == 0 and s.read("fold_tally").count() == 0 and s.read("fold_process").count() == 2
    again = events(spark, [{"seq": 20, "t": 20, "kind": "file_changed", "path": "/a/b/c", "flags": ["z"], "count": 1}]).withColumn("ts_ns", F.col("t"))
    sink(again, 1)
    assert values(s.read("nodes").where("kind = 'file'"), "id", "flags", "touch_count") == [("/a/b/c", ["z"], 1)]
    assert s.read("nodes").where("last_seen < 6").count() == 0 and s.read("events").count() == 4


def test_locks_and_schema_versions(spark, tmp_path):
    s, other = (store.Store(spark, str(tmp_path / "s")) for _ in range(2))
    s._put("LOCK", f"{time.time_ns() - 2 * store.Store.STALE_NS} gone")
    with other.lock():  # left by a crash
        other.beat()
        with pytest.raises(RuntimeError), s.lock():
            pass
        other._put("LOCK", f"{time.time_ns()} somebody")
        with pytest.raises(RuntimeError):
            other.beat()
    assert other._get("LOCK").endswith("somebody")
    one, two = s.begin(), other.begin()
    one.commit()
    with pytest.raises(RuntimeError):
        two.commit()
    for v in ("1", "99"):
        s._put("meta.json", '{"schema_version": "%s"}' % v)
        with pytest.raises(ValueError):
            store.Store(spark, str(tmp_path / "s"))
