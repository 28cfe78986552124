"""Failures in a row over an outcome stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "store_id long, ts timestamp, sequence long, failures long, open_until timestamp"


class _Runs(StatefulProcessor):
    """Counts one store's failures since its last success or long pause."""

    def __init__(self, threshold: int, open_seconds: int, memory_seconds: int | None) -> None:
        self.threshold, self.open, self.memory = threshold, open_seconds, memory_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._run = handle.getValueState("run", "failures long, last_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failures, last = (int(x) for x in self._run.get()) if self._run.exists() else (0, 0)
        # One micro-batch of one store; the source's per-trigger limit bounds it.
        batch = pd.concat(list(rows)).sort_values(["ts", "sequence"])
        found = []
        for ts, sequence, success in zip(batch["ts"], batch["sequence"], batch["success"]):
            now = int(pd.Timestamp(ts).value // 1000)
            if success:
                failures = 0
                continue
            if self.memory is not None and failures and now - last > self.memory * 1_000_000:
                failures = 0
            failures, last = failures + 1, now
            until = ts + pd.Timedelta(seconds=self.open) if failures >= self.threshold else None
            found.append((key[0], ts, sequence, failures, until))
        self._run.update((failures, last))
        if found:
            frame = pd.DataFrame(
                found, columns=["store_id", "ts", "sequence", "failures", "open_until"]
            )
            frame["open_until"] = pd.to_datetime(frame["open_until"])
            yield frame

    def close(self) -> None:
        pass


def stream_failure_runs(
    outcomes: DataFrame, threshold: int = 3, open_seconds: int = 30, memory_seconds: int | None = 60
) -> DataFrame:
    """Update stream of failures with their count and the period they open.

    `outcomes` is (store_id, ts, sequence, success) and must arrive in time order per store
    between micro-batches; each micro-batch is ordered here.
    """
    return outcomes.groupBy("store_id").transformWithStateInPandas(
        statefulProcessor=_Runs(threshold, open_seconds, memory_seconds),
        outputStructType=OUTPUT, outputMode="Update", timeMode="None",
    )
