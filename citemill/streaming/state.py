"""Streams with keyed state that expires: sessions, and a cache whose entries have an age."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TTL_DAYS = 21  # fixed value: how long a fetched work stays good
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession):
    """Within it, streams that start keep their state in RocksDB, which stateful processors need; the setting is put back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class CacheLookups(StatefulProcessor):
    """Says of each lookup (id, at in microseconds) of a key whether an entry was good: fetched at most ``ttl`` before.

    A miss fetches the entry anew.  Within a batch lookups are taken in the order of their time; a timer drops the
    entry once the watermark has passed its end, so state holds only entries that can still be hit.
    """

    def __init__(self, ttl_days: float):
        self.ttl = int(ttl_days * 86_400_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fetched = handle.getValueState("fetched", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        lookups = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        fetched = self.fetched.get()[0] if self.fetched.exists() else None
        start, hits = fetched, []
        for at in lookups["at"].tolist():
            hits.append(fetched is not None and fetched <= at <= fetched + self.ttl)
            if not hits[-1] and (fetched is None or at > fetched):  # a lookup from before the entry leaves it
                fetched = at
        if fetched != start:
            if start is not None:
                self.handle.deleteTimer(self._end(start))
            self.fetched.update((fetched,))
            self.handle.registerTimer(self._end(fetched))
        yield pd.DataFrame({"id": lookups["id"].astype("int64"), "hit": hits})

    def _end(self, fetched: int) -> int:
        return (fetched + self.ttl) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.fetched.exists() and self._end(self.fetched.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.fetched.clear()
        yield pd.DataFrame({"id": pd.Series([], dtype="int64"), "hit": pd.Series([], dtype="bool")})

    def close(self) -> None:
        pass


def cache_lookups(lookups: DataFrame, key: str, ttl_days: float = TTL_DAYS, late: str = "1 day") -> DataFrame:
    """(id, hit) of a stream (id, ts, key): see CacheLookups.  Lookups later than ``late`` behind the newest are left out; start it within keyed_state()."""
    rows = lookups.withWatermark("ts", late).select("ts", F.col(key).alias("key"), F.col("id").cast("long").alias("id"), F.unix_micros("ts").alias("at"))
    return rows.groupBy("key").transformWithStateInPandas(CacheLookups(ttl_days), "id long, hit boolean", "Append", "EventTime")


def waves(calls: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, calls, cost) of waves of calls, a stream or a table with ts and cost: calls of a key no more than ``gap`` apart.

    In a stream a wave comes out once, when the watermark has passed its end, which is ``gap`` after its last call.
    """
    wave = calls.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), F.col(key).alias("key"))
    return wave.agg(F.count("*").alias("calls"), F.sum("cost").alias("cost")).select("key", "w.start", "w.end", "calls", "cost")
