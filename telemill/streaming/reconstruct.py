"""From observations to enriched events as one keyed stream: operators.reconstruct on rows as they arrive.

Rows are keyed by machine; a machine's are taken in order of obs_seq, since ticks, coalescing windows and what is known of
processes depend on that order over all of its sources. State lies in the state store, an entry a process, connection,
path or index entry: a batch rewrites those that it touches. Machines are spread over tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from telemill.operators.enrich import DEPTH, ENRICHED
from telemill.operators.lifecycle import WINDOW
from telemill.operators.reconstruct import ANCESTORS, ATTRS, FIELDS, PROCESS, typed
from telemill.operators.ticks import GAP

#: Entries of a machine's process index beyond which the oldest goes that isn't the latest of its pid.
CAP = 8192
_SNAPSHOT = {"process": ("pid", "start"), "network": ("proto", "local_addr", "foreign_addr")}
_ATTRIBUTES = {"process": ("ppid", "uid", "comm", "name", "exec_path"), "network": ("pid", "state", "process_name", "rx", "tx")}


class Index:
    """Processes by identity (pid, start), the latest of each pid, at most cap of them if as many aren't the latest."""

    def __init__(self, entries: dict[tuple[int, int], dict], cap: int = CAP):
        self.entries, self.cap, self.changed = entries, cap, set()
        self.latest: dict[int, tuple[int, int]] = {}
        self.next = 1 + max((e["nth"] for e in entries.values()), default=-1)
        for k in sorted(entries, key=lambda k: (k[1], entries[k]["nth"])):
            self.latest[k[0]] = k

    def insert(self, pid: int, start: int, known: dict) -> None:
        k = (pid, start)
        self.entries[k] = known | {"alive": True, "nth": self.next}
        self.next += 1
        self.changed.add(k)
        if pid not in self.latest or start >= self.latest[pid][1]:
            self.latest[pid] = k
        if len(self.entries) > self.cap:
            old = min((x for x in self.entries if self.latest[x[0]] != x), key=lambda x: self.entries[x]["nth"], default=None)
            if old is not None:
                del self.entries[old]
                self.changed.add(old)

    def mark_dead(self, pid: int, start: int) -> None:
        if (pid, start) in self.entries:
            self.entries[pid, start]["alive"] = False
            self.changed.add((pid, start))

    def by_pid(self, pid: int | None) -> tuple[tuple[int, int], dict] | None:
        k = self.latest.get(pid)
        return None if k is None else (k, self.entries[k])

    def ancestors(self, pid: int, depth: int = DEPTH, stop_at: int = 1) -> list[dict]:
        """Parent first, up to pids that are stop_at or less, unknown, or there already."""
        out, path, at = [], {pid}, self.by_pid(pid)[1]["ppid"]
        while len(out) < depth and at is not None and at > stop_at and at not in path and (found := self.by_pid(at)):
            out.append({"pid": found[0][0], "start": found[0][1]} | {a: found[1][a] for a in ATTRS})
            path.add(at)
            at = found[1]["ppid"]
        return out


class Reconstruct(StatefulProcessor):
    """Rows host, obs_seq, t, row (a typed observation as JSON). With a delay, rows wait until the watermark has passed
    them, and are taken in order however late they came; without, a micro-batch's rows are taken as they are, in order."""

    def __init__(self, gap_ns: int, window_ns: int, cap: int, wait: bool):
        self.gap_ns, self.window_ns, self.cap, self.wait = gap_ns, window_ns, cap, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "c string")
        self.seen = handle.getMapState("seen", "source string, key string", "v string")
        self.files = handle.getMapState("files", "path string", "v string")
        self.index = handle.getMapState("index", "pid long, start long", "v string")
        self.waiting = handle.getListState("waiting", "obs_seq long, t long, row string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r for f in rows for r in f[["obs_seq", "t", "row"]].itertuples(index=False, name=None)]
        if not self.wait:
            yield self._taken(key[0], new)
            return
        self.waiting.appendList([(int(s), int(t), r) for s, t, r in new])
        for ms in {int(t) // 1_000_000 + 1 for _, t, _ in new}:
            self.handle.registerTimer(ms)
        yield self._due(key[0], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._due(key[0], timerValues.getCurrentWatermarkInMs())

    def _due(self, host: str, watermark_ms: int) -> pd.DataFrame:
        held = list(self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in held if r[1] // 1_000_000 < watermark_ms]
        if due:
            rest = [tuple(r) for r in held if r[1] // 1_000_000 >= watermark_ms]
            self.waiting.put(rest) if rest else self.waiting.clear()
        return self._taken(host, due)

    def _taken(self, host: str, rows: list[tuple]) -> pd.DataFrame:
        out: list[dict] = []
        if rows:
            self._load()
            for seq, t, row in sorted(rows, key=lambda r: (r[0], r[2])):
                self._observe(int(seq), int(t), json.loads(row), out)
            self._save()
        columns = ["host", "seq", "emit_seq", "nth", "kind", "t", "pid", *FIELDS, "process", "ancestors"]
        return pd.DataFrame([[host, *[e.get(c) for c in columns[1:]]] for e in out], columns=columns, dtype=object)

    def _load(self) -> None:
        read = lambda state: {tuple(k): json.loads(v[0]) for k, v in state.iterator()}
        self.now = json.loads(self.clock.get()[0]) if self.clock.exists() else {"seq": 0}
        self.held = {"seen": read(self.seen), "files": read(self.files)}
        self.table = Index(read(self.index), self.cap)
        self.touched = {"seen": set(), "files": set()}

    def _save(self) -> None:
        parts = [(self.seen, self.held["seen"], self.touched["seen"]), (self.files, self.held["files"], self.touched["files"]), (self.index, self.table.entries, self.table.changed)]
        for state, held, touched in parts:
            for k in touched:
                if k in held:
                    state.updateValue(k, (json.dumps(held[k]),))
                elif state.containsKey(k):
                    state.removeKey(k)
        self.clock.update((json.dumps(self.now),))

    def _observe(self, seq: int, t: int, o: dict, out: list[dict]) -> None:
        source, found = o.get("source"), []
        if source == "process" or source == "network" and o.get("kind") != "dns_query":
            found = self._snapshot(source, seq, t, o)
        elif source == "network":
            found = [("", {"kind": "dns_query", "t": t, "pid": o.get("pid"), "masked": bool(o.get("masked"))} | {c: o.get(c) for c in ("qname", "qtype", "name_hash", "interface_index", "client")})]
        elif source == "file_system" and o.get("path"):
            found = self._file(t, o)
        elif source == "window" and (o.get("to_bundle") is not None or o.get("to_exec_path") is not None) and (o.get("from_bundle") is None or o["from_bundle"] != o.get("to_bundle")):
            pid = o["to_pid"] if o.get("to_pid") is not None else o.get("pid")
            found = [("", {"kind": "app_focus", "t": t, "pid": pid} | {c: o.get(c) for c in ("from_bundle", "from_name", "to_bundle", "to_name", "to_exec_path")})]
        for nth, (_, e) in enumerate(sorted(found, key=lambda x: (x[1]["kind"], x[0])), 1):
            self._enrich(e)
            self.now["seq"] += 1
            out.append(e | {"seq": self.now["seq"], "emit_seq": seq, "nth": nth})

    def _snapshot(self, source: str, seq: int, t: int, o: dict) -> list[tuple[str, dict]]:
        """Note a key of the running tick; a gap before it ends the tick, and tells births and deaths."""
        parts = [o.get(c) for c in _SNAPSHOT[source]]
        if any(p is None for p in parts):
            return []
        s = self.now.setdefault(source, {"tick": 0, "last": None})
        seen, found = self.held["seen"], []
        if s["last"] is not None and t - s["last"] > self.gap_ns:
            if s["tick"] > 0:
                for k, v in list(seen.items()):
                    if k[0] == source and v["tick"] == s["tick"] and v["since"] == s["tick"]:
                        found += self._change(source, k[1], v, True, v["last"])
                    elif k[0] == source and v["tick"] < s["tick"]:
                        found += self._change(source, k[1], v, False, s["last"])
                        del seen[k]
                        self.touched["seen"].add(k)
            s["tick"] += 1
        key = (source, ("|" if source == "network" else ":").join(str(p) for p in parts))
        old = seen.get(key)
        on = {"since": s["tick"], "first": t} if old is None else {"since": old["since"], "first": old["first"]}
        seen[key] = on | {"tick": s["tick"], "last": t, "own": {c: o.get(c) for c in (*_SNAPSHOT[source], *_ATTRIBUTES[source])}}
        self.touched["seen"].add(key)
        s["last"] = t
        return found

    @staticmethod
    def _change(source: str, key: str, v: dict, born: bool, t: int) -> list[tuple[str, dict]]:
        kinds = {("process", True): ["birth"], ("process", False): ["death"], ("network", True): ["opened"], ("network", False): ["closed", "completed"]}[source, born]
        stem = "process" if source == "process" else "connection"
        out = []
        for k in kinds:
            e = v["own"] | {"kind": f"{stem}_{k}", "t": t, "first_seen": v["first"], "last_seen": v["last"]}
            out.append((key, e | ({"duration_ns": max(0, v["last"] - v["first"])} if k == "completed" else {})))
        return out

    def _file(self, t: int, o: dict) -> list[tuple[str, dict]]:
        """Note a change of a path; a later window than the running one brings that out."""
        f, found, files = self.now.setdefault("file", {"window": None, "last": None}), [], self.held["files"]
        window = t // self.window_ns
        if f["window"] is not None and window > f["window"]:
            for k, v in files.items():
                found.append((k[0], {"kind": "file_changed", "t": f["last"], "path": k[0], "flags": v["flags"], "event_ids": v["ids"], "count": len(v["ids"]), "first_seen": v["first"], "last_seen": v["last"]}))
            self.touched["files"] |= set(files)
            files.clear()
        k = (o["path"],)
        v = files.setdefault(k, {"flags": [], "ids": [], "first": t})
        v["flags"] += [x for x in dict.fromkeys(o.get("flags") or []) if x is not None and x not in v["flags"]]
        v["ids"] += [o["event_id"]] if o.get("event_id") else []
        v["last"] = t
        self.touched["files"].add(k)
        f |= {"window": window, "last": t}
        return found

    def _enrich(self, e: dict) -> None:
        if e["kind"] == "process_birth":
            self.table.insert(e["pid"], e["start"], {c: e.get(c) for c in _ATTRIBUTES["process"]})
        elif e["kind"] == "process_death":
            self.table.mark_dead(e["pid"], e["start"])
        elif e["kind"] in ENRICHED and (found := self.table.by_pid(e.get("pid"))):
            (pid, start), p = found
            e["process"] = json.dumps({"pid": pid, "start": start, "alive": p["alive"]} | {a: p[a] for a in ATTRS})
            e["ancestors"] = json.dumps(self.table.ancestors(pid))

    def close(self) -> None:
        pass


def reconstruct(obs: DataFrame, gap_ns: int = GAP, window_ns: int = WINDOW, cap: int = CAP, delay: str | None = None) -> DataFrame:
    """host, seq (from 1 by host), and the columns of operators.reconstruct.reconstruct() of a stream of observations.

    What only the end of the input would bring out stays in the state. delay: how far t may lie behind the latest one (rows
    wait that long, and later ones are dropped); None takes rows as micro-batches bring them. host is '' where the
    observations have none. Needs the RocksDB state store.
    """
    o = typed(obs)
    host = F.coalesce("host", F.lit("")) if "host" in o.columns else F.lit("")
    rows = o.select(host.alias("host"), "obs_seq", "t", F.to_json(F.struct(*[c for c in o.columns if c not in ("host", "obs_seq", "t")])).alias("row"))
    if delay is not None:
        rows = rows.withColumn("ts", F.timestamp_micros(F.expr("t div 1000"))).withWatermark("ts", delay)
    columns = {"host": "string", "seq": "long", "emit_seq": "long", "nth": "int", "kind": "string", "t": "long", "pid": "long", **FIELDS, "process": "string", "ancestors": "string"}
    out = rows.groupBy("host").transformWithStateInPandas(Reconstruct(gap_ns, window_ns, cap, delay is not None), ", ".join(f"`{c}` {k}" for c, k in columns.items()), "Append", "None" if delay is None else "EventTime")
    return out.withColumns({"process": F.from_json("process", PROCESS), "ancestors": F.from_json("ancestors", ANCESTORS)})
