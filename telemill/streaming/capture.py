"""From a stream of events to the store: merging by micro-batch, hourly pruning, timed capture, one writer at a time."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from telemill.functions.scalars import DAY, HOUR
from telemill.operators.fold import absorb, refresh
from telemill.operators.store import Store, Transaction
from telemill.streaming.reconstruct import reconstruct

# How often sources are polled, in ms, and how long events are kept.
CADENCES = {"process": 1000, "network": 1000, "window": 500, "system": 5000}
RETENTION_DAYS = 30


class StoreSink:
    """Takes micro-batches of events (seq, t, ts_ns, kind, pid and the fields of all kinds; seq is unique in a stream).

    A batch's events are combined with the state that the store keeps of the stream (see operators.fold), appended, and
    the graph of the state is merged with what the store had before the stream began: however a history is cut into
    batches, the store is the one that it makes as a whole. All of a batch, its number included, is one version of the
    store. A batch that comes again after a crash finds its number there and is passed over, or finds nothing of what was
    written before the crash. Nodes and edges are made anew if graph_every_ns have gone by since the last time (0: with
    each batch), and by finish(). Once an hour, what is older than the retention goes (0: nothing).

    stream names what the batches are numbered by: another one than the store's last begins a new state, which is merged
    with all that the store has. None goes on with the last.
    """

    def __init__(self, store: Store, retention_days: int = RETENTION_DAYS, now: Callable[[], int] = time.time_ns, stream: str | None = None, graph_every_ns: int = 0):
        self.store, self.retention, self.now, self.stream, self.graph_every_ns = store, retention_days, now, stream, graph_every_ns

    def __call__(self, events: DataFrame, batch: int) -> None:
        self.store.beat()
        tx = self.store.begin()
        if self.stream is not None and tx.meta.get("stream") != self.stream:
            tx.drop(*[t for t in tx.tables if t.startswith(("fold_", "base_"))])
            tx.meta.pop("batch", None)
            tx.meta["stream"] = self.stream
        if int(tx.meta.get("batch", -1)) >= batch:
            return
        events = events.persist()
        try:
            if not events.isEmpty():
                absorb(tx, events)
                tx.append("events", events)
                tx.meta["graph_due"] = "1"
                if self.now() - int(tx.meta.get("graph_ns", 0)) >= self.graph_every_ns:
                    self._refresh(tx)
            tx.meta |= {"batch": str(batch), "heartbeat_ns": str(self.now())}
            tx.commit()
        finally:
            events.unpersist()
        self.prune()

    def _refresh(self, tx: Transaction) -> None:
        refresh(tx)
        tx.meta.pop("graph_due", None)
        tx.meta["graph_ns"] = str(self.now())

    def finish(self) -> None:
        """Make nodes and edges of what has come since they were made."""
        tx = self.store.begin()
        if "graph_due" in tx.meta:
            self._refresh(tx)
            tx.commit()

    def prune(self) -> dict[str, int] | None:
        """Prune if the last time is an hour ago; what went."""
        now = self.now()
        if not self.retention or now - int(self.store.get_meta("pruned_ns") or 0) < HOUR:
            return None
        return self.store.prune_before(now - self.retention * DAY, {"pruned_ns": str(now)})


def start(events: DataFrame, sink: StoreSink, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Begin to write a stream of events; every: the trigger's interval, or all that is there and then stop."""
    writer = events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def capture(events: DataFrame, store: Store, checkpoint: str, seconds: float | None = None, every: str = "10 seconds", retention_days: int = RETENTION_DAYS, graph_every_ns: int = 0) -> None:
    """Write a stream to a store that is held for it: for so many seconds, or all that is there."""
    with store.lock():
        sink = StoreSink(store, retention_days, stream=checkpoint, graph_every_ns=graph_every_ns)
        query = start(events, sink, checkpoint, every if seconds else None)
        try:
            query.awaitTermination(seconds) if seconds else query.awaitTermination()
            while query.isActive and query.status["isTriggerActive"]:  # the batch that has begun is ended
                time.sleep(0.05)
        finally:
            query.stop()
        sink.finish()


def capture_observations(obs: DataFrame, store: Store, checkpoint: str, seconds: float | None = None, every: str = "10 seconds", retention_days: int = RETENTION_DAYS, graph_every_ns: int = 0, **how) -> None:
    """From observations of one machine (see streaming.reconstruct, which takes `how`) to the store, all stages as one stream."""
    events = reconstruct(obs, **how).withColumn("ts_ns", F.col("t"))
    capture(events, store, checkpoint, seconds, every, retention_days, graph_every_ns)
