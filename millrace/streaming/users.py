"""Running totals of users over a stream, with state that ends.

Needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass =
org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "user_id long, n long, total double, kinds long, most string, closed boolean"


class Totals(StatefulProcessor):
    """Events, their value, and the number of each type of a user; a timer of event time ends the state some while after the last event."""

    def __init__(self, idle_ms: int):
        self.idle = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "n long, total double, last long")
        self.kinds = handle.getMapState("kinds", "event_type string", "n long")

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentWatermarkInMs()
        rows = [own for b in rows if len(own := b[b["ms"] >= now])]
        if not rows:
            return
        n, total, last = self.totals.get() if self.totals.exists() else (0, 0.0, None)
        if last is not None and last + self.idle < now:  # had ended before these came
            yield self._row(key, n, total, True)
            self.handle.deleteTimer(last + self.idle)
            self.kinds.clear()
            n, total, last = 0, 0.0, None
        before = last
        for b in rows:
            n, total = n + len(b), total + float(b["value"].sum())
            newest = int(b["ms"].max())
            last = newest if last is None else max(last, newest)
            for kind, own in b["event_type"].value_counts().items():
                self.kinds.updateValue((kind,), ((self.kinds.getValue((kind,))[0] if self.kinds.containsKey((kind,)) else 0) + int(own),))
        self.totals.update((n, total, last))
        if before != last:
            if before is not None:
                self.handle.deleteTimer(before + self.idle)
            self.handle.registerTimer(last + self.idle)
        yield self._row(key, n, total, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.totals.exists():
            n, total, _ = self.totals.get()
            yield self._row(key, n, total, True)
            self.totals.clear()
            self.kinds.clear()

    def _row(self, key, n, total, closed):
        held = sorted((-own[0], kind[0]) for kind, own in self.kinds.iterator())
        return pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total], "kinds": [len(held)], "most": [held[0][1] if held else None], "closed": [closed]})

    def close(self) -> None:
        pass


def user_totals(events: DataFrame, idle_seconds: int, late: str = "1 hour") -> DataFrame:
    """A row for each user whenever new events came, and a last one, `closed`, when the watermark is so long after the user's last event; then the user's state is gone.

    `most` is the type with the most events so far, of ties the first by name. A user who comes back begins anew. Events behind the watermark that their batch began with are left out, null
    users are a user, null types and values count as events only.
    """
    rows = events.withWatermark("ts", late).select("user_id", "ts", F.unix_millis("ts").alias("ms"), "event_type", "value")
    return rows.groupBy("user_id").transformWithStateInPandas(statefulProcessor=Totals(idle_seconds * 1000), outputStructType=SCHEMA, outputMode="Update", timeMode="EventTime")
