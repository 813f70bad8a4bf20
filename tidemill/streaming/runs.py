"""Windows of recommended steps from a stream of horizon rows: each is given out as soon as it is certain."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

#: Keyed state with timers needs this store; the session that starts the query must name it.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
QUARTER = 15 * 60 * 1000
_STATE = "anchor_ms long, steps array<int>, safe array<int>, done int, start int, length int, all_safe int"


class RunDetector(StatefulProcessor):
    """Steps that the watermark has passed are final; a run ends at the first final step that doesn't belong to it.

    The state of a horizon holds its recommended steps that aren't final yet and the run that is open; a timer wakes it
    at its next step, and nothing is left of it when its last step is final.
    """

    def __init__(self, least: int, horizon: int):
        self.least, self.horizon = least, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("horizon", _STATE)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        for part in rows:
            for ms, step, rec, empty in zip(part["step_ms"], part["step"], part["rec"], part["empty"]):
                if held is None:
                    held = {"anchor_ms": int(ms) - int(step) * QUARTER, "steps": {}, "done": 0, "start": 0, "length": 0, "all_safe": 1}
                if rec and step > held["done"]:
                    held["steps"][int(step)] = int(empty)
        yield from self._advance(key, held, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, self._held(), timerValues)

    def _held(self) -> dict | None:
        if not self.state.exists():
            return None
        anchor, steps, safe, *rest = self.state.get()
        return {"anchor_ms": anchor, "steps": dict(zip(steps or [], safe or []))} | dict(zip(("done", "start", "length", "all_safe"), rest))

    def _advance(self, key: tuple, held: dict | None, timerValues) -> Iterator[pd.DataFrame]:
        """Walks over the steps that have become final."""
        if held is None:
            return
        passed, out = (timerValues.getCurrentWatermarkInMs() - held["anchor_ms"]) // QUARTER, []

        def ended(at: int) -> None:
            if held["length"] >= self.least:
                out.append((*key, held["start"], at, held["length"], held["all_safe"]))
            held["length"] = 0

        for step in range(held["done"] + 1, min(self.horizon, passed) + 1):
            if step not in held["steps"]:
                ended(step)
                continue
            if not held["length"]:
                held["start"], held["all_safe"] = step, 1
            held["length"] += 1
            held["all_safe"] = min(held["all_safe"], held["steps"].pop(step))
        held["done"] = max(held["done"], min(self.horizon, passed))
        if held["done"] >= self.horizon:
            ended(self.horizon + 1)
            self.state.clear()
        else:
            self.state.update((held["anchor_ms"], list(held["steps"]), list(held["steps"].values()), held["done"], held["start"], held["length"], held["all_safe"]))
            self.handle.registerTimer(held["anchor_ms"] + (held["done"] + 1) * QUARTER)
        if out:
            names = [f"k{i}" for i in range(len(key))] + ["start_step", "end_step_excl", "length", "safe"]
            yield pd.DataFrame(out, columns=names)


def stream_windows(rows: DataFrame, keys: Sequence[str], time: str = "target_time", late: str = "1 hour", least: int = 1, horizon: int = 96) -> DataFrame:
    """(keys, start_step, end_step_excl, length, safe) for a stream of (keys, time, step, rec, empty), ``keys`` those of a horizon.

    A step is 15 minutes after the one before it.  Rows may come in any order within ``late``; a step that hasn't come
    by then is no part of a run.  Later rows are dropped and counted, see ``late_rows``.  A window of ``least`` steps or
    more comes once, when the step after it, or the horizon's last, is final.  The session needs ``STORE``.
    """
    kinds = dict(rows.dtypes)
    out = ", ".join(f"k{i} {kinds[k]}" for i, k in enumerate(keys)) + ", start_step int, end_step_excl int, length int, safe int"
    watched = rows.withWatermark(time, late)
    picked = watched.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), time, F.unix_millis(time).alias("step_ms"), "step", "rec", "empty")
    runs = picked.groupBy(*(f"k{i}" for i in range(len(keys)))).transformWithStateInPandas(RunDetector(least, horizon), out, "Append", "EventTime")
    return runs.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), "start_step", "end_step_excl", "length", "safe")


def late_rows(query: StreamingQuery) -> int:
    """Rows that the query's operators with state have dropped as later than the watermark allows, by its reported progress."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
