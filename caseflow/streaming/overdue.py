"""An alert when a deadline passes unresolved, driven by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CHANGES = "complaint_id LONG, ts TIMESTAMP, kind STRING, due_at TIMESTAMP"
ALERTS = "complaint_id LONG, due_at TIMESTAMP, alerted_at TIMESTAMP"


def _ms(moment: pd.Timestamp) -> int:
    return int(moment.timestamp() * 1000)


class DueDateWatch(StatefulProcessor):
    """Per complaint, one timer at its current deadline; resolving cancels it, re-triage moves it.

    State is one deadline, the moment that set it, and one flag, whatever the number of changes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("watch", "due_ms LONG, set_ms LONG, resolved BOOLEAN")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due, set_at, resolved = self.state.get() if self.state.exists() else (-1, -1, False)
        before = due if not resolved else -1
        # Chunk by chunk: a busy complaint's rows are never held together.
        for chunk in rows:
            triaged = chunk[(chunk["kind"] == "triage") & chunk["due_at"].notna()]
            if len(triaged):
                last = triaged.sort_values("ts", kind="stable").iloc[-1]
                if _ms(last["ts"]) >= set_at:
                    due, set_at = _ms(last["due_at"]), _ms(last["ts"])
            # The first resolution stands: reopening does not bring the deadline back.
            resolved = resolved or bool((chunk["kind"] == "resolved").any())
        self.state.update((due, set_at, resolved))
        after = due if not resolved else -1
        if after != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if after >= 0:
                # A deadline already behind the watermark fires as soon as possible.
                self.handle.registerTimer(max(after + 1, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, _, resolved = self.state.get()
        if due >= 0 and not resolved:
            yield pd.DataFrame({
                "complaint_id": [key[0]],
                "due_at": [pd.Timestamp(due, unit="ms")],
                "alerted_at": [pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")],
            })

    def close(self) -> None:
        pass


def overdue_alerts(changes: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """``changes`` (CHANGES) are triage rows with the deadline they set, and resolved rows."""
    return (
        changes.withWatermark("ts", lateness)
        .groupBy("complaint_id")
        .transformWithStateInPandas(DueDateWatch(), ALERTS, outputMode="append", timeMode="eventtime")
    )
