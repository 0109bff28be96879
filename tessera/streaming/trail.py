"""State per task: the last status, and whether each move is allowed."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.plans.lifecycle import TASK_MOVES

# The process that sets up a stateful query does not see shipped packages, so the
# processor travels with its code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TRAIL = T.StructType([
    T.StructField("task_uuid", T.StringType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("from_status", T.StringType()),
    T.StructField("to_status", T.StringType()),
    T.StructField("legal", T.BooleanType()),
])


class TaskTrail(StatefulProcessor):
    """Keeps the last state per task and judges each move against the allowed ones."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "status string")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        trail = pd.concat(list(rows)).sort_values(["created_at", "event_id"])
        before = self.last.get()[0] if self.last.exists() else None
        sources = [before, *trail["to_status"].iloc[:-1]]
        self.last.update((trail["to_status"].iloc[-1],))
        yield pd.DataFrame({
            "task_uuid": key[0],
            "event_id": trail["event_id"].to_numpy(),
            "from_status": pd.Series(sources, dtype=object).to_numpy(),
            "to_status": trail["to_status"].to_numpy(),
            "legal": [s is None or t in TASK_MOVES[s] for s, t in zip(sources, trail["to_status"])],
        })

    def close(self) -> None:
        pass
