"""The registered source of capture folders: order, filters, restarts."""

import json

from pyspark.sql import functions as F

from telemill.operators import reconstruct as batch
from telemill.sources import capture, readers
from telemill.streaming import reconstruct as live
from test_reconstruct import COLUMNS, machine


def write(folder, number, obs):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"timestamp": {"mono_ns": t, "wall_anchor_ns": 0}, "source": source, "pid": pid, "payload": json.loads(payload)}) for _, source, _, t, pid, payload in obs]
    (folder / f"{number:04}.ndjson").write_text("\n".join([*lines, "no observation", '{"source": "x"}', "[1]"]))


def rows(frame, *columns):
    return sorted(tuple(repr(r[c]) for c in columns) for r in frame.collect())


def test_batch_reads_with_filters(spark, tmp_path):
    capture.register(spark)
    a = machine(6, ticks=4)
    for i in range(0, len(a), 30):
        write(tmp_path / "in", i // 30, a[i : i + 30])
    got = spark.read.format("telemetry").load(str(tmp_path / "in"))
    assert got.count() == len(a) and rows(got, "source", "t", "pid") == rows(readers.observations(spark, str(tmp_path / "in")), "source", "t", "pid")
    assert [r["t"] for r in got.orderBy("obs_seq").collect()] == [o[3] for o in a]
    dns = got.where("source = 'network' and kind = 'dns_query' and pid > 1")
    assert dns.count() == sum(o[1] == "network" and "dns_query" in o[5] and (o[4] or 0) > 1 for o in a)
    reader = capture.Reader(str(tmp_path / "in"))
    kept = list(reader.pushFilters([capture.EqualTo(("source",), "network"), capture.In(("kind",), ("dns_query",)), capture.EqualTo(("pid",), 3)]))
    assert [f.attribute for f in kept] == [("pid",)] and reader.only == {"source": {"network"}, "kind": {"dns_query"}}
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == sum(o[1] == "network" and "dns_query" in o[5] for o in a)
    assert spark.read.format("telemetry").load(str(tmp_path / "none")).count() == 0


def test_a_restart_repeats_nothing(spark, tmp_path):
    capture.register(spark)
    a = machine(7, ticks=6)
    cut = [a[i : i + 40] for i in range(0, len(a), 40)]
    seen = []

    def run():
        stream = spark.readStream.format("telemetry").option("maxFilesPerTrigger", 2).load(str(tmp_path / "in"))
        q = live.reconstruct(stream.drop("kind")).writeStream.foreachBatch(lambda f, n: seen.extend(f.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start()
        q.awaitTermination(300)

    for i, part in enumerate(cut[:3]):
        write(tmp_path / "in", i, part)
    for _ in range(2):
        run()
    for i, part in enumerate(cut[3:], 3):
        write(tmp_path / "in", i, part)
    for _ in range(len(cut)):
        run()
    whole = spark.read.format("telemetry").load(str(tmp_path / "in")).drop("host", "kind")
    want = batch.reconstruct(whole)
    assert sorted(tuple(repr(r[c]) for c in COLUMNS) for r in seen) == rows(want, *COLUMNS)
    assert want.where(F.col("kind") == "process_birth").count() > 0
