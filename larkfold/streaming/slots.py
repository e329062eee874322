"""Slots of a feature stream that close by event time: rows wait for their slot's timer, empty slots carry forward, and the state can be exported and restored.

A symbol's rows lie in map state, packed in pieces of one slot each, until the watermark has passed the end of their slot. A timer at the end of the oldest open slot
then takes the slots that are over in order: the rows of one (sorted by time and id, so the order of arrival doesn't matter) move the features on; a slot
without rows repeats the last value while that is young enough, and is stale from then on. State is the open slots' rows, one row of features and one timer a symbol;
what a task holds at once is one slot's rows, or HELD rows that come in.

Defined cases: a row of a slot that is closed already is dropped and counted; a null value or symbol is dropped; an empty input gives nothing; a restored
stream goes on as if it had never stopped, its open rows and its timer included.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from larkfold.operators.series import _scan

HOUR = 3_600_000
#: A row as it lies in a piece, and rows that come in that are packed together.
ROW, HELD = np.dtype([("time_msc", "<i8"), ("event_id", "<i8"), ("value", "<f8")]), 1 << 18
FEATURES = "next_slot long, n long, late long, ema double, high double, low double, value double, at long"
OUT = "symbol string, slot long, n long, total long, close double, high double, low double, ema double, status string"
NAMES = [c.split()[0] for c in OUT.split(", ")]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=NAMES).astype({"symbol": object, "status": object, "close": float})


class Slots(StatefulProcessor):
    """``slot_ms``: the grid; ``alpha``: of the average; ``stale_ms``: the greatest age, at a slot's end, of a value that is carried."""

    def __init__(self, slot_ms: int = HOUR, alpha: float = 0.1, stale_ms: int = 3 * HOUR) -> None:
        self.slot_ms, self.alpha, self.stale_ms = slot_ms, alpha, stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getMapState("pieces", "slot long, piece long", "rows binary")
        self.counts = handle.getMapState("counts", "slot long", "pieces long")
        self.features = handle.getValueState("features", FEATURES)

    def _wait(self, slot: int) -> None:
        self.handle.registerTimer(int((slot + 1) * self.slot_ms))

    def _keep(self, batches: list[pd.DataFrame]) -> int:
        """Packs rows into pieces of their slots; the first of these."""
        rows = np.empty(sum(map(len, batches)), ROW)
        for c in ROW.names:
            rows[c] = np.concatenate([b[c].to_numpy() for b in batches])
        slots = rows["time_msc"] // self.slot_ms
        order = np.argsort(slots, kind="stable")
        own, starts = np.unique(slots[order], return_index=True)
        for slot, part in zip(own.tolist(), np.split(rows[order], starts[1:]), strict=True):
            n = self.counts.getValue((slot,))[0] if self.counts.containsKey((slot,)) else 0
            self.pieces.updateValue((slot, n), (part.tobytes(),))
            self.counts.updateValue((slot,), (n + 1,))
        return int(own[0])

    def _take(self, slot: int) -> np.ndarray | None:
        """The rows of a slot in order; its pieces are dropped."""
        if not self.counts.containsKey((slot,)):
            return None
        keys = [(slot, i) for i in range(self.counts.getValue((slot,))[0])]
        rows = np.concatenate([np.frombuffer(self.pieces.getValue(k)[0], ROW) for k in keys])
        for k in keys:
            self.pieces.removeKey(k)
        self.counts.removeKey((slot,))
        return rows[np.lexsort((rows["event_id"], rows["time_msc"]))]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.features.get() if self.features.exists() else None
        first, late = (state[0], state[2]) if state else (None, 0)
        earliest, held = None, []
        for batch in rows:
            slots = batch["time_msc"] // self.slot_ms
            if first is not None:
                late += int((slots < first).sum())
                batch, slots = batch[slots >= first], slots[slots >= first]
            if len(batch):
                held.append(batch[list(ROW.names)])
                earliest = min(int(slots.min()), earliest if earliest is not None else int(slots.min()))
            if sum(map(len, held)) >= HELD:
                self._keep(held)
                held = []
        if held:
            self._keep(held)
        if state is None and earliest is not None:
            # nothing is closed yet: the first slot may still become an older one
            for timer in self.handle.listTimers():
                earliest = min(earliest, timer // self.slot_ms - 1)
            self._wait(earliest)
        elif state is not None and late != state[2]:
            self.features.update((*state[:2], late, *state[3:]))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = timerValues.getCurrentWatermarkInMs()
        state = self.features.get() if self.features.exists() else None
        if state is None:
            slot = int(min(*(k[0] for k in self.counts.keys()), (expiredTimerInfo.getExpiryTimeInMs() - 1) // self.slot_ms))
            n, late, ema, high, low, value, at = 0, 0, 0.0, float("-inf"), float("inf"), float("nan"), 0
        else:
            slot, n, late, ema, high, low, value, at = state
        out = []
        while (slot + 1) * self.slot_ms <= over:
            g = self._take(slot)
            if g is not None:
                x = g["value"]
                gain = np.full(len(x), self.alpha)
                if n == 0:
                    gain[0] = 1.0
                y, left = _scan(gain * x, 1 - gain)
                ema = float(y[-1] + left[-1] * ema)
                n, high, low, value, at = n + len(x), max(high, float(x.max())), min(low, float(x.min())), float(x[-1]), int(g["time_msc"][-1])
            age = (slot + 1) * self.slot_ms - at
            status = "fresh" if g is not None else "carried" if age <= self.stale_ms else "stale"
            out.append((key[0], slot, 0 if g is None else len(g), n, value if age <= self.stale_ms else None, high, low, ema, status))
            slot += 1
            if len(out) == 4096:
                yield _frame(out)
                out = []
        self.features.update((int(slot), int(n), int(late), float(ema), float(high), float(low), float(value), int(at)))
        self._wait(slot)
        if out:
            yield _frame(out)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        """Goes on from an exported state: a row with the features, and a row for each row that still waits."""
        for r in initialState.itertuples(index=False):
            if r.kind == "features":
                self.features.update((int(r.next_slot), int(r.n), int(r.late), float(r.ema), float(r.high), float(r.low), float(r.value), int(r.at)))
                self._wait(int(r.next_slot))
        rows = initialState[initialState["kind"] == "row"]
        if len(rows):
            first = self._keep([rows])
            if not (initialState["kind"] == "features").any():
                self._wait(first)


def slots(events: DataFrame, processor: Slots | None = None, late: str = "10 minutes", initial: DataFrame | None = None) -> DataFrame:
    """The closed slots of each symbol of an event stream. ``initial``: what ``exported`` gave of an earlier one."""
    rows = events.where("event_type is not null and value is not null").select(F.col("event_type").alias("symbol"), "time", "time_msc", "event_id", "value").withWatermark("time", late)
    start = initial.groupBy("symbol") if initial is not None else None
    return rows.groupBy("symbol").transformWithStateInPandas(processor or Slots(), OUT, "append", "eventTime", start)


def exported(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state of a stopped stream as a table: features of each symbol, and the rows that wait for their slot's end."""
    read = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    own = [c.split() for c in FEATURES.split(", ")]
    features = read("features").select(F.col("key.symbol").alias("symbol"), F.lit("features").alias("kind"), *[F.col(f"value.{c}").alias(c) for c, _ in own], none("time_msc", "long"), none("event_id", "long"))
    fields = "symbol string, kind string, " + FEATURES + ", time_msc long, event_id long"
    names = [c.split()[0] for c in fields.split(", ")]

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for symbol, piece in zip(frame["symbol"], frame["rows"], strict=True):
                yield pd.DataFrame(np.frombuffer(piece, ROW)).assign(symbol=symbol, kind="row").reindex(columns=names)

    waiting = read("pieces").select(F.col("key.symbol").alias("symbol"), F.col("user_map_value.rows").alias("rows")).mapInPandas(unpack, fields)
    return features.unionByName(waiting)


@contextmanager
def state_on_disk(spark: SparkSession):
    """Keyed state with timers needs the store that keeps it on disk; the session's setting comes back after."""
    had = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if had is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, had)
