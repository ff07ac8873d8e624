"""Sessions that expire: state with timers over a stream, session windows over a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

EXPIRED = "user_id long, started timestamp, expires timestamp, n long"
OPEN = "started array<long>, last array<long>, n array<long>"
#: State with timers is kept in this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Sessions(StatefulProcessor):
    """A user's open sessions, in microseconds. An event within `gap` of a session on either side belongs to it and may join two; a session is given out, and
    forgotten, when the watermark passes its end, which a timer says."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", OPEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(zip(*self.open.get())) if self.open.exists() else []
        for part in rows:
            held += [(t, t, 1) for t in (part["ts"].astype("datetime64[us]").astype("int64")).tolist()]
        merged: list[list[int]] = []
        for started, last, n in sorted(held):
            if merged and started < merged[-1][1] + self.gap:
                merged[-1] = [merged[-1][0], max(merged[-1][1], last), merged[-1][2] + n]
            else:
                merged.append([started, last, n])
        self.open.update(tuple([int(m[i]) for m in merged] for i in range(3)))
        for _, last, _ in merged:
            self.handle.registerTimer(-(-(last + self.gap) // 1000))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        held = list(zip(*self.open.get())) if self.open.exists() else []
        over = [s for s in held if s[1] + self.gap <= now]
        left = [s for s in held if s[1] + self.gap > now]
        if left:
            self.open.update(tuple([int(s[i]) for s in left] for i in range(3)))
        else:
            self.open.clear()
        if over:
            moment = lambda i, more=0: pd.to_datetime([s[i] + more for s in over], unit="us")
            yield pd.DataFrame({"user_id": [key[0]] * len(over), "started": moment(0), "expires": moment(1, self.gap), "n": [s[2] for s in over]})

    def close(self) -> None:
        pass


def expired(events: DataFrame, hours: int = 12, late: str = "1 hour") -> DataFrame:
    """user_id, started, expires, n: runs of a user's events (user_id, ts) of which none comes `hours` or more after the one before. A table gives all of them, a
    stream each when it has expired; events later than `late` are dropped there. Streams need the session's state store to be STORE. Rows without user or time aren't counted."""
    rows = events.filter("user_id IS NOT NULL AND ts IS NOT NULL").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    if not events.isStreaming:
        own = rows.groupBy("user_id", F.session_window("ts", f"{hours} hours").alias("w")).agg(F.min("ts").alias("started"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
        # The window's own end isn't given out: a filter on it would be pushed down to the events, before they are merged.
        return own.select("user_id", "started", (F.col("last") + F.expr(f"INTERVAL {hours} HOURS")).alias("expires"), "n")
    timed = rows.withWatermark("ts", late).groupBy("user_id")
    return timed.transformWithStateInPandas(Sessions(hours * 3_600_000_000), EXPIRED, "Append", "EventTime")


def use_store(spark: SparkSession) -> None:
    """Sets the state store that timers need, unless the session has one."""
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
