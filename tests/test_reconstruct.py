"""Observations to events: the stream against the batch, the process index against brute force."""

import json
import random

from pyspark.sql import functions as F

from telemill.operators import reconstruct as batch
from telemill.operators import store
from telemill.streaming import capture
from telemill.streaming import reconstruct as live

MS, SEC = 1_000_000, 1_000_000_000
RAW = "host string, source string, obs_seq long, t long, pid long, payload string"


def machine(seed, host="", ticks=9):
    """Observations of all sources: snapshots of processes and connections, bursts of file changes, focus, DNS."""
    r, out, t = random.Random(seed), [], 1_700_000_000 * SEC
    say = lambda source, pid, **p: out.append((host, source, len(out), t, pid, json.dumps(p)))
    live_p, live_c = {(1, 1): (0, "init")}, set()
    for _ in range(ticks):
        t += SEC
        for pid in list(live_p):
            if pid != (1, 1) and r.random() < 0.25:
                del live_p[pid]
        for _ in range(r.randint(0, 3)):
            pid = r.randint(2, 9)
            live_p = {k: v for k, v in live_p.items() if k[0] != pid} | {(pid, r.randint(1, 4)): (r.choice([k[0] for k in live_p if k[0] > 1] or [1]), f"c{r.randint(1, 5)}")}
        for (pid, start), (ppid, comm) in live_p.items():
            t += MS
            say("process", pid, start_unix_secs=start, ppid=ppid, uid=r.choice([0, 501]), comm=comm, name=r.choice([None, comm]), exec_path=f"/bin/{comm}")
        say("process", None, start_unix_secs=1)
        t += 300 * MS
        live_c = {c for c in sorted(live_c) if r.random() < 0.6} | {f"9.9.9.{r.randint(1, 4)}.443" for _ in range(r.randint(0, 2))}
        for c in sorted(live_c):
            t += MS
            say("network", r.choice([k[0] for k in live_p]), proto="tcp4", local_addr="l.1", foreign_addr=c, state="ESTABLISHED", rxbytes=r.choice([None, r.randint(0, 99)]), txbytes=1, process_name="p")
        say("network", 5, proto="tcp4", local_addr=None, foreign_addr="x")
        for _ in range(r.randint(0, 3)):
            t += MS
            say("network", r.choice([None, 99, *[k[0] for k in live_p]]), kind="dns_query", qname=r.choice(["a.com.", "b.com"]), qtype="A", name_hash="h", masked=r.choice([None, True]), client_process_name="q")
            say("file_system", None, path=r.choice(["/a", "/b", ""]), flags=r.sample(["m", "c", "r"], r.randint(0, 3)), event_id=r.choice([0, 7, 8]))
            say("window", 3, **{"from": r.choice([None, {"bundle_id": "x", "name": "X"}]), "to": r.choice([None, {"bundle_id": r.choice(["x", "y"]), "name": "Y", "pid": r.choice([None, 4])}])})
        say("system", None, ncpu=8)
    return out


COLUMNS = ["emit_seq", "nth", "kind", "t", "pid", *batch.FIELDS, "process", "ancestors"]


def rows_of(frame):
    return sorted(tuple(repr(r[c]) for c in COLUMNS) for r in frame.collect())


def run(spark, tmp_path, folder, name, **how):
    stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).json(f"{folder}/*")
    q = live.reconstruct(stream, **how).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name)


def write(spark, folder, parts):
    import os
    import time

    for i, part in enumerate(parts):
        os.makedirs(f"{folder}/{i:03}")
        with open(f"{folder}/{i:03}/part.json", "w") as f:
            f.writelines(json.dumps(dict(zip(RAW.replace(" string", "").replace(" long", "").split(", "), o, strict=True))) + "\n" for o in part)
        time.sleep(0.02)


def test_the_stream_gives_the_events_of_the_batch(spark, tmp_path):
    a, b = machine(1), machine(2, "other")
    cut = lambda o, n: [o[i : i + n] for i in range(0, len(o), n)]
    write(spark, str(tmp_path / "in"), [[*x, *y] for x, y in zip(cut(a, 40), [*cut(b, 40), [], [], []], strict=False)] + [x for x in cut(b, 40)[len(cut(a, 40)) :]])
    got = run(spark, tmp_path, tmp_path / "in", "events").cache()
    kinds, chains, dead = set(), 0, 0
    for host, obs in (("", a), ("other", b)):
        want = batch.reconstruct(spark.createDataFrame(obs, RAW).drop("host")).cache()
        mine = got.where(F.col("host") == host)
        assert rows_of(mine) == rows_of(want)
        order = [r["seq"] for r in mine.orderBy("emit_seq", "nth").collect()]
        assert order == list(range(1, len(order) + 1))
        kinds |= {r["kind"] for r in want.select("kind").distinct().collect()}
        chains, dead = chains + want.where("size(ancestors) > 0").count(), dead + want.where("not process.alive").count()
    assert len(kinds) == 8 and chains and dead


def test_rows_that_come_late_wait_for_their_turn(spark, tmp_path):
    a = machine(3, ticks=6)
    shuffled = a[:]
    r = random.Random(1)
    for i in range(0, len(shuffled) - 12, 12):  # out of order within and across files
        part = shuffled[i : i + 12]
        r.shuffle(part)
        shuffled[i : i + 12] = part
    end = [("", "system", len(a), a[-1][3] + 100 * SEC, None, "{}"), ("", "system", len(a) + 1, a[-1][3] + 101 * SEC, None, "{}")]
    write(spark, str(tmp_path / "in"), [*[shuffled[i : i + 31] for i in range(0, len(a), 31)], end[:1], end[1:]])
    got = run(spark, tmp_path, tmp_path / "in", "late_events", delay="20 seconds")
    want = batch.reconstruct(spark.createDataFrame(a, RAW).drop("host"))
    assert rows_of(got) == rows_of(want)


def test_from_observations_to_the_store(spark, tmp_path):
    from telemill.operators import persist

    a = machine(4, ticks=5)
    write(spark, str(tmp_path / "in"), [a[:60], a[60:]])
    stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
    s = store.Store(spark, str(tmp_path / "s"))
    capture.capture_observations(stream, s, str(tmp_path / "ck"), retention_days=0)
    events = batch.reconstruct(spark.createDataFrame(a, RAW).drop("host")).withColumns({"seq": F.col("emit_seq") * 1000 + F.col("nth"), "ts_ns": F.col("t")})
    one = store.Store(spark, str(tmp_path / "one"))
    one.merge_typed(persist.build(events))
    for t in ("nodes", "edges"):
        have, want = ([tuple(repr(r[c]) for c in sorted(f.columns)) for f in [x.read(t)] for r in f.collect()] for x in (s, one))
        assert sorted(have) == sorted(want), t
    assert s.read("events").count() == events.count()


def test_the_index_keeps_the_latest_of_each_pid():
    r = random.Random(7)
    for cap in (0, 1, 3, 6):
        index, log = live.Index({}, cap), []
        for n in range(300):
            pid, start = r.randint(1, 5), r.randint(1, 6)
            if r.random() < 0.7:
                index.insert(pid, start, {"ppid": r.randint(0, 6), "comm": f"c{n}", "name": None, "exec_path": None, "uid": None})
                log.append((pid, start, n))
            else:
                index.mark_dead(pid, start)
                log.append((pid, start, None))
            if n % 50 == 0:  # as the state store gives it back
                index = live.Index({k: json.loads(json.dumps(v)) for k, v in index.entries.items()}, cap)
            births = [x for x in log if x[2] is not None]
            for p in range(1, 6):
                mine = [x for x in births if x[0] == p]
                found = index.by_pid(p)
                if not mine:
                    assert found is None
                    continue
                newest = max(mine, key=lambda x: (x[1], x[2]))
                after = [x for x in log[log.index(newest) :] if x[:2] == newest[:2] and x[2] is None]
                assert found[0] == newest[:2] and found[1]["comm"] == f"c{newest[2]}" and found[1]["alive"] == (not after)
            assert len(index.entries) <= max(cap, len(index.latest))
