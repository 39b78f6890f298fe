import json

from telemill import report
from telemill.sources import readers
from telemill.streaming import live


def write(path, *lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(path)


OBS = {"timestamp": {"mono_ns": 5, "wall_anchor_ns": 10}, "source": "process", "pid": 1, "payload": {"comm": "sh", "uid": 501, "start_unix_secs": 9}}
EVENT = {"timestamp": {"mono_ns": 5, "wall_anchor_ns": 0}, "kind": "dns_query", "payload": {"qname": "x"}}


def test_ndjson(spark, tmp_path):
    p = write(tmp_path / "a", OBS, "", "junk", EVENT)
    o = readers.observations(spark, p)
    assert [(r["source"], r["t"]) for r in o.collect()] == [("process", 15)]
    assert readers.payload(o, "process").first()["uid"] == 501
    e = readers.events(spark, p).first()
    assert (e["schema_version"], e["kind"], e["t"]) == (1, "dns_query", 5)
    assert {r["what"]: r["count"] for r in readers.mixed(spark, p)[2].collect()} == {"observation": 1, "event": 1, "skipped": 1}


def test_dns_log_and_netstat(spark, tmp_path):
    message = "[R1] DNSServiceQueryRecord START -- qname: e.com, qtype: A, flags: 0, interface index: 0, client pid: 17 (git), name hash: ab"
    p = write(tmp_path / "d", {"eventMessage": message}, {"eventMessage": "other"}, "no")
    assert [(r["pid"], r["qname"], r["client_process_name"]) for r in readers.dns_log(spark, p).collect()] == [(17, "e.com", "git")]
    tail = " 131072 131072 Google Chrome H:123 00102 0 0 0 0 0 1 x"
    p = write(tmp_path / "n", "Active Internet connections", "Proto Recv-Q ...", "tcp4 0 0 10.0.0.1.5 1.1.1.1.443 ESTABLISHED 10 20" + tail, "udp4 0 0 *.53 *.* 1 2 9 9 mdns:7 0 0 0 0 0 0 0 0")
    got = {tuple(r) for r in readers.netstat(spark.read.text(p)).collect()}
    assert ("udp4", "*.53", "*.*", None, 1, 2, "mdns", 7) in got and ("tcp4", "10.0.0.1.5", "1.1.1.1.443", "ESTABLISHED", 10, 20, "Google Chrome H", 123) in got


def test_dot_and_prompts(spark):
    n = spark.createDataFrame([("process", "1:2", 'a"b\n', None, 0, None), ("domain", "e.com", "e.com", None, None, True)], "kind string, id string, label string, tooltip string, uid long, masked boolean")
    e = spark.createDataFrame([("queried_domain", "process", "1:2", "domain", "e.com", 3)], "kind string, from_kind string, from_id string, to_kind string, to_id string, count long")
    text = report.to_dot(n, e)
    assert '"p_1_2" -> "d_e.com"' in text and 'label="3"' in text and "#ffd0d0" in text and 'a\\"b\\n' in text and "#e0e0e0" in text
    c = report.Canned('{"summary": "s"}', "plain")
    assert report.ask(c, report.prompt({"Nodes": n.select("id"), "None": n.limit(0)}))["summary"] == "s" and "## None" not in c.calls[0]
    assert report.ask(c, "")["details"] == {"findings": []}


def test_streams_equal_batches(spark, tmp_path):
    from pyspark.sql import functions as F

    from telemill.operators import lifecycle

    times = [0, 1, 400, 401, 800, 801, 1300]
    pids = [100, 101, 100, 102, 100, 102, 100]
    rows = [("process", i, t * 1_000_000, p, 1) for i, (t, p) in enumerate(zip(times, pids, strict=True))]
    schema = "source string, obs_seq long, t long, pid long, start long"
    for i in range(0, 7, 3):
        spark.createDataFrame(rows[i : i + 3], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = live.snapshot_diff(stream, ["pid", "start"]).writeStream.format("memory").queryName("diffs").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = lifecycle.snapshot_diff(spark.createDataFrame(rows, schema), ["pid", "start"]).withColumn("key", F.concat_ws("|", "pid", "start"))
    columns = ["key", "what", "t", "first_seen", "last_seen", "emit_seq"]
    assert sorted(map(tuple, spark.table("diffs").select(*columns).collect())) == sorted(map(tuple, batch.select(*columns).collect()))


def test_tick_windows(spark):
    obs = spark.createDataFrame([("a", t * 1_000_000) for t in (0, 250, 501, 900)], "source string, t long")
    assert sorted((r["first_t"], r["n"]) for r in live.tick_windows(obs).collect()) == [(0, 2), (501_000_000, 1), (900_000_000, 1)]


def test_adaptive_interval():
    assert live.adaptive_interval([True] * 3 + [False] * 10, 500)[-1] == 500
    assert live.adaptive_interval([True] * 30, 100)[-1] == 4000
