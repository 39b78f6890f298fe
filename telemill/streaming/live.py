"""Ticks, coalesced file changes, sliding windows and snapshot differences on streams.

Times (t) are ns; watermarks and windows work on microseconds. Late rows beyond the watermark are dropped, which batch
runs never do.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from telemill.operators.lifecycle import WINDOW
from telemill.operators.ticks import GAP


def timed(frame: DataFrame, delay: str) -> DataFrame:
    """frame with ts of t, and a watermark."""
    return frame.withColumn("ts", F.timestamp_micros(F.expr("t div 1000"))).withWatermark("ts", delay)


def tick_windows(obs: DataFrame, gap_ns: int = GAP, delay: str = "1 second") -> DataFrame:
    """source, first_ts, last_ts, n of ticks: sessions whose gaps are at most gap_ns."""
    s = timed(obs, delay).groupBy(F.session_window("ts", f"{gap_ns // 1000} microseconds"), "source")
    return s.agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t")).select("source", "n", "first_t", "last_t")


def file_windows(obs: DataFrame, window_ns: int = WINDOW, delay: str = "1 second") -> DataFrame:
    """path, window start, flags, count, first_seen, last_seen of file changes in tumbling windows."""
    o = timed(obs.where(F.length("path") > 0), delay)
    g = o.groupBy(F.window("ts", f"{window_ns // 1000} microseconds"), "path").agg(F.array_sort(F.collect_list(F.struct("obs_seq", "flags", "event_id"))).alias("r"), F.min("t").alias("first_seen"), F.max("t").alias("last_seen"))
    return g.select("path", F.array_distinct(F.flatten("r.flags")).alias("flags"), F.size(F.filter("r.event_id", lambda i: i != 0)).cast("long").alias("count"), "first_seen", "last_seen")


def sliding_counts(events: DataFrame, width: str = "300 seconds", step: str = "60 seconds", delay: str = "600 seconds") -> DataFrame:
    """kind, window_start, n of sliding windows."""
    return timed(events, delay).groupBy(F.window("ts", width, step), "kind").agg(F.count(F.lit(1)).alias("n")).select("kind", F.unix_micros("window.start").alias("window_start"), "n")


class SnapshotDiff(StatefulProcessor):
    """Births and deaths of keys between ticks of one source; rows of a micro-batch are taken in order of obs_seq.

    State: the last time, whether a tick has ended, and the keys of the tick before and of the running one, each with
    first and last time; one source's state holds two snapshots at most.
    """

    def __init__(self, gap_ns: int = GAP):
        self.gap_ns = gap_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "s string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        s = json.loads(held[0]) if held else {"last": None, "primed": False, "prior": {}, "now": {}}
        out = []
        for seq, t, k in sorted(pd.concat(list(rows))[["obs_seq", "t", "key"]].itertuples(index=False)):
            if s["last"] is not None and t - s["last"] > self.gap_ns:
                if s["primed"]:
                    out += [(key[0], k1, "birth", v[1], v[0], v[1], seq) for k1, v in s["now"].items() if k1 not in s["prior"]]
                    out += [(key[0], k1, "death", s["last"], v[0], v[1], seq) for k1, v in s["prior"].items() if k1 not in s["now"]]
                s |= {"primed": True, "prior": s["now"], "now": {}}
            first = (s["now"].get(k) or s["prior"].get(k) or [t])[0]
            s["now"][k], s["last"] = [first, int(t)], int(t)
        self.state.update((json.dumps(s, default=int),))
        yield pd.DataFrame(out, columns=["source", "key", "what", "t", "first_seen", "last_seen", "emit_seq"])

    def close(self) -> None:
        pass


DIFF = "source string, key string, what string, t long, first_seen long, last_seen long, emit_seq long"


def snapshot_diff(obs: DataFrame, keys: list[str], gap_ns: int = GAP) -> DataFrame:
    """The stream of operators.lifecycle.snapshot_diff, keys joined by '|'. Needs the RocksDB state store."""
    rows = obs.dropna(subset=keys).select("source", "obs_seq", "t", F.concat_ws("|", *keys).alias("key"))
    return rows.groupBy("source").transformWithStateInPandas(SnapshotDiff(gap_ns), DIFF, "Append", "None")


def adaptive_interval(ticks: list[bool], base_ms: int, least_ms: int = 500, most: int = 8, dirty: int = 3, clean: int = 10) -> list[int]:
    """Poll intervals by tick (True: something was dropped): doubled after `dirty` dirty ticks in a row, up to most times
    the base; halved after `clean` clean ones, down to the base."""
    base = max(base_ms, least_ms)
    now, bad, good, out = base, 0, 0, []
    for t in ticks:
        bad, good = (bad + 1, 0) if t else (0, good + 1)
        if bad == dirty:
            now, bad = min(now * 2, base * most), 0
        if good == clean:
            now, good = max(now // 2, base), 0
        out.append(now)
    return out
