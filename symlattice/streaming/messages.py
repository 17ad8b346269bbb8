"""Messages put together while their fragments stream in, late and out of order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.shipping import ship
from ..operators.chat import MESSAGE

_FIELDS = ["content", "reasoning", "tool_index", "tool_id", "tool_name", "arguments", "done"]
_VALUE = "content string, reasoning string, tool_index int, tool_id string, tool_name string, arguments string, done boolean"


def whole_message(message: str, parts: list[tuple]) -> dict:
    """A message of its fragments, (seq, content, reasoning, tool_index, tool_id, tool_name, arguments, done) each, as ``merged_messages`` says."""
    calls: dict[int, dict] = {}
    out = {"message": message, "content": "", "reasoning": "", "n_fragments": len(parts), "done": False}
    for _, content, reasoning, index, call, name, arguments, done in sorted(parts, key=lambda p: p[0]):
        out["content"] += content or ""
        out["reasoning"] += reasoning or ""
        out["done"] |= bool(done)
        if index is not None:
            c = calls.setdefault(int(index), {"index": int(index), "id": "", "name": "", "arguments": ""})
            c["id"], c["name"] = c["id"] or call or "", c["name"] or name or ""
            c["arguments"] += arguments or ""
    return out | {"tool_calls": [calls[i] for i in sorted(calls)]}


class Assembly(StatefulProcessor):
    """State of a message: its fragments by ``seq``, so that one that comes twice counts once. It ends by a timer.

    A message that has paused for ``idle_ms`` is emitted and forgotten; one that has its last fragment waits only
    ``done_ms`` for stragglers.
    """

    def __init__(self, idle_ms: int, done_ms: int) -> None:
        self.idle_ms, self.done_ms = idle_ms, done_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "seq long", _VALUE)
        self.ends = handle.getValueState("ends", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = False
        for f in rows:
            for r in f.astype(object).where(f.notna(), None).itertuples(index=False):
                at, new = (int(r.seq),), (r.content, r.reasoning, None if r.tool_index is None else int(r.tool_index), r.tool_id, r.tool_name, r.arguments, None if r.done is None else bool(r.done))
                if not self.parts.containsKey(at):
                    self.parts.updateValue(at, new)
                done = done or bool(r.done)
        before = self.ends.get()
        if before:
            self.handle.deleteTimer(before[0])
            done = done or any(v[6] for v in self.parts.values())
        at = timerValues.getCurrentProcessingTimeInMs() + (self.done_ms if done else self.idle_ms)
        self.handle.registerTimer(at)
        self.ends.update((at,))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        parts = [(k[0], *v) for k, v in self.parts.iterator()]
        self.parts.clear()
        self.ends.clear()
        columns = [c.split()[0] for c in MESSAGE.split(", ")[:3]] + ["tool_calls", "n_fragments", "done"]
        yield pd.DataFrame([whole_message(key[0], parts)], columns=columns)

    def close(self) -> None:
        pass


def assembled(fragments: DataFrame, idle: int = 3000, done: int = 500) -> DataFrame:
    """Messages (columns as in ``MESSAGE``) of a stream of fragments (as in ``FRAGMENTS``), each once it has paused for ``idle`` ms or, after its last fragment, ``done`` ms.

    State is kept by message in RocksDB and its checkpoint, so a lost executor loses none; the output is that of
    ``merged_messages`` over all fragments that came before the pause.
    """
    spark = fragments.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return fragments.groupBy("message").transformWithStateInPandas(Assembly(idle, done), outputStructType=MESSAGE, outputMode="append", timeMode="processingTime")
