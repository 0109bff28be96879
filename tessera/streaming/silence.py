"""State per key: when it was last heard of, and a timer that goes off when nothing follows."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# As in ``trail``: the processor travels with its code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SILENCE = T.StructType([
    T.StructField("worker_id", T.StringType()),
    T.StructField("last_seen", T.TimestampType()),
    T.StructField("alert_at", T.TimestampType()),
])


class SilenceTimer(StatefulProcessor):
    """Every arrival sets the key's timer anew; a timer that runs out gives one alert and forgets the key."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last_seen timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stamps = [part["last_seen"].max() for part in rows]
        if self.seen.exists():
            stamps.append(pd.Timestamp(self.seen.get()[0]))
        known = [s.tz_localize(None) if s.tzinfo else s for s in stamps if not pd.isna(s)]
        self.seen.update((max(known).to_pydatetime() if known else None,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.gap_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.seen.get()[0] if self.seen.exists() else None
        self.seen.clear()
        yield pd.DataFrame({"worker_id": pd.Series([key[0]], dtype=object),
                            "last_seen": pd.to_datetime(pd.Series([last])),
                            "alert_at": pd.to_datetime(pd.Series([expiredTimerInfo.getExpiryTimeInMs()]), unit="ms")})

    def close(self) -> None:
        pass
