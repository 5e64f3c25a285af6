"""Chunk quality as state with timers.

Every chunk is a key with its counters, the ids of the events that it has counted and a timer for the next midnight, by event time. An event
counts once however often it comes. When the watermark passes midnight, quality is given anew without any event, for freshness falls
each day. Ids are remembered for REMEMBERED days, and a chunk's state ends when it is deleted.

The session's state store must be RocksDB's (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docweave.operators.stats import quality_score

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
#: Days for which a repeated event is known as one.
REMEMBERED = 30
KINDS = ("hit", "like", "dislike", "correction")
_OUT = "chunk_id long, hit long, like long, dislike long, correction long, created_at timestamp, as_of timestamp"


class ChunkQuality(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "hit long, like long, dislike long, correction long, created_ms long")
        self.seen = handle.getMapState("seen", "event_id long", "ms long")

    def _row(self, key: int, ms: int) -> pd.DataFrame:
        *counts, created = self.counts.get()
        at = lambda x: None if x is None else datetime.fromtimestamp(x / 1000, timezone.utc)
        return pd.DataFrame({"chunk_id": [key], **{k: [n] for k, n in zip(KINDS, counts)}, "created_at": pd.Series([at(created)], dtype="datetime64[us, UTC]"), "as_of": pd.Series([at(ms // DAY_MS * DAY_MS)], dtype="datetime64[us, UTC]")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counts = list(self.counts.get()) if self.counts.exists() else [0, 0, 0, 0, None]
        last, deleted, fresh = None, False, not self.counts.exists()
        for frame in rows:
            for event, kind, ms in zip(frame.event_id, frame.kind, frame.ms):
                if self.seen.containsKey((int(event),)):
                    continue
                self.seen.updateValue((int(event),), (int(ms),))
                last = int(ms) if last is None else max(last, int(ms))
                if kind == "created":
                    counts[4] = int(ms)
                elif kind == "deleted":
                    deleted = True
                elif kind in KINDS:
                    counts[KINDS.index(kind)] += 1
        if deleted:
            self.counts.clear()
            self.seen.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            return
        if last is None:
            return
        self.counts.update(tuple(counts))
        if fresh:
            self.handle.registerTimer((max(last, timerValues.getCurrentWatermarkInMs()) // DAY_MS + 1) * DAY_MS)
        yield self._row(key[0], last)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        if not self.counts.exists():
            return
        old = [k for k, (ms,) in self.seen.iterator() if ms < now - REMEMBERED * DAY_MS]
        for k in old:
            self.seen.removeKey(k)
        self.handle.registerTimer((now // DAY_MS + 1) * DAY_MS)
        yield self._row(key[0], now)

    def close(self) -> None:
        pass


def quality_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """chunk_id, as_of (a midnight), quality_score, needs_review (update mode): a row for a chunk after its events, and one each time the watermark passes a midnight.

    ``events``: chunk_id, event_id, kind (hit, like, dislike, correction, created, deleted), ts (timestamp).
    """
    rows = events.withWatermark("ts", late).select("chunk_id", "event_id", "kind", "ts", F.unix_millis("ts").alias("ms"))
    state = rows.groupBy("chunk_id").transformWithStateInPandas(ChunkQuality(), _OUT, "Update", "EventTime")
    score = quality_score(F.col("hit"), F.col("like"), F.col("dislike"), F.col("correction"), F.col("created_at"), F.col("as_of"))
    scored = state.withColumn("quality_score", score)
    return scored.select("chunk_id", "as_of", "quality_score", ((F.col("quality_score") < 0.25) | (F.col("dislike") >= 3)).alias("needs_review"))
