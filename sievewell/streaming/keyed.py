"""Counters and appeals over a stream with state of their own that expires with the watermark.

Trailing counts: the state of a (group, counter) is cut into slots of `window / SLOTS`. A slot
holds its facts; the sums of all slots are one value. A new fact adds up the whole slots in its window and looks into
two, its own and the one that the window begins in. All facts of a micro-batch are answered by one search in sorted sums,
and each slot is read and written at most once. A key has a timer for its earliest slot, which removes every slot that no
fact in time can reach and sets the next one, so that state holds one window and the lateness, and
nothing of a key that has gone quiet. Each fact is answered in the micro-batch that brings it,
by what has arrived until then; a fact that arrives out of order changes no earlier answer.

Appeals: an id's first appeal is accepted (of one micro-batch the earliest by time, then
rationale) and later ones are rejected as duplicates while the id is remembered.

Facts and appeals later than `late` behind the newest are dropped by the watermark. All rows
of one key go to one task of a micro-batch, as each must be answered in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SLOTS = 168
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started within use the state store that keyed state with timers needs."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


class _Trailing(StatefulProcessor):
    def __init__(self, window_us: int):
        self.slot_us = -(-window_us // SLOTS)
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "slots array<long>, totals array<long>, due long")
        self.facts = handle.getMapState("facts", "slot long", "at array<long>, delta array<long>")

    def _held(self) -> tuple[np.ndarray, np.ndarray, int | None]:
        """The slots that have facts, in order, their sums, and when the next timer is due."""
        slots, totals, due = self.held.get() or ([], [], None)
        return np.array(slots, np.int64), np.array(totals, np.int64), due

    def _keep(self, slots: np.ndarray, totals: np.ndarray, due: int | None) -> None:
        """A key has one timer, for its earliest slot."""
        ends = self._ends(int(slots[0]))
        if due is None or ends < due:
            self.handle.registerTimer(ends)
            due = ends
        self.held.update((slots.tolist(), totals.tolist(), due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        at, delta = new["at"].to_numpy(np.int64), new["delta"].to_numpy(np.int64)
        own, edge = at // self.slot_us, (at - self.window_us) // self.slot_us  # a slot is no longer than the window, so these differ
        slots, totals, due = self._held()
        touched = np.unique(own)
        looked = np.intersect1d(slots, np.concatenate([touched, edge]))
        old = [tuple(np.array(x, np.int64) for x in self.facts.getValue((slot,))) for slot in looked.tolist()]
        when, what = (np.concatenate([*[o[i] for o in old], x]) for i, x in ((0, at), (1, delta)))
        order = np.argsort(when, kind="stable")
        when, what = when[order], what[order]
        sums = np.concatenate([[0], np.cumsum(what)])
        begins, ends = (np.searchsorted(when, (touched + i) * self.slot_us) for i in (0, 1))
        for slot, x, y in zip(touched.tolist(), begins.tolist(), ends.tolist(), strict=True):
            self.facts.updateValue((slot,), (when[x:y].tolist(), what[x:y].tolist()))
        rest = ~np.isin(slots, touched)
        slots, totals = np.concatenate([slots[rest], touched]), np.concatenate([totals[rest], sums[ends] - sums[begins]])
        order = np.argsort(slots)
        slots, totals = slots[order], totals[order]
        self._keep(slots, totals, due)
        whole = np.concatenate([[0], np.cumsum(totals)])
        count = whole[np.searchsorted(slots, own)] - whole[np.searchsorted(slots, edge, "right")]
        count += sums[np.searchsorted(when, at, "right")] - sums[np.searchsorted(when, own * self.slot_us)]
        count += sums[np.searchsorted(when, (edge + 1) * self.slot_us)] - sums[np.searchsorted(when, at - self.window_us)]
        yield pd.DataFrame({"event_id": new["event_id"], "group_id": key[0], "counter_id": key[1], "count": count})

    def _ends(self, slot: int) -> int:
        """Milliseconds at which no fact in time reaches back to the slot."""
        return ((slot + 1) * self.slot_us + self.window_us) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        slots, totals, due = self._held()
        fired = expiredTimerInfo.getExpiryTimeInMs()
        now = max(fired, timerValues.getCurrentWatermarkInMs())
        gone = np.array([self._ends(s) <= now for s in slots.tolist()], bool)
        if gone.all():
            self.facts.clear()
            self.held.clear()
            return iter([])
        for slot in slots[gone].tolist():
            self.facts.removeKey((slot,))
        self._keep(slots[~gone], totals[~gone], due if due is not None and due > now else None)
        return iter([])

    def close(self) -> None:
        pass


def trailing(facts: DataFrame, seconds: int, late: str = "1 day") -> DataFrame:
    """event_id, group_id, counter_id and count, the key's deltas over the window that ends with the fact, for a stream of facts."""
    kinds = {f.name: f.dataType.simpleString() for f in facts.schema}
    rows = facts.withWatermark("ts", late).select("event_id", "group_id", "counter_id", "ts", F.unix_micros("ts").alias("at"), F.col("delta").cast("long").alias("delta"))
    schema = f"event_id {kinds['event_id']}, group_id {kinds['group_id']}, counter_id {kinds['counter_id']}, count long"
    return rows.groupBy("group_id", "counter_id").transformWithStateInPandas(_Trailing(seconds * 1_000_000), schema, "Append", "EventTime")


class _First(StatefulProcessor):
    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["at", "rationale_id"], kind="stable")
        first = not self.seen.exists()
        new["reason"] = "duplicate"
        if first:
            new.loc[new.index[0], "reason"] = ""
            new["reason"] = ["", *["duplicate"] * (len(new) - 1)]
            until = int(new["at"].iloc[0]) // 1000 + self.keep_ms
            self.seen.update((until,))
            self.handle.registerTimer(until)
        yield new.drop(columns=["ts"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def judged_appeals(good: DataFrame, malformed: DataFrame, late: str = "1 day", remember_days: int = 365) -> DataFrame:
    """A stream of appeals with `reason`: empty if accepted, else `duplicate` or `malformed`; `at` is the time in microseconds."""
    columns = ["appeal_id", "skill_id", "category", "severity", "rationale_id", "user_context", F.unix_micros("ts").alias("at")]
    keyed = good.withWatermark("ts", late).select(*columns, "ts")
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in keyed.drop("ts").schema] + ["reason string"]
    first = keyed.groupBy("appeal_id").transformWithStateInPandas(_First(remember_days * 86_400_000), ", ".join(kinds), "Append", "EventTime")
    return first.unionByName(malformed.select(*columns, F.lit("malformed").alias("reason")))


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands `sink` what there is, a micro-batch after another, with keyed state; returns the query's progress reports."""
    with keyed_state(stream.sparkSession):
        query = stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(sink).start()
        query.awaitTermination()
    return query.recentProgress


def numbered_sink(**paths: tuple[str, str]) -> Callable[[DataFrame, int], None]:
    """A sink that writes the rows of each (path, condition) under the number of the micro-batch: repeated, it writes the same again."""

    def put(batch: DataFrame, number: int) -> None:
        if len(paths) > 1:
            batch = batch.persist()
        for path, condition in paths.values():
            batch.filter(condition).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if len(paths) > 1:
            batch.unpersist()

    return put
