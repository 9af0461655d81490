"""Streams with state: holdings by market, tables kept current, and the latest targets published."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.rolling import holdings
from ..operators.weights import latest_targets

HELD = "market string, ts timestamp, held double"
#: Rows so far; entry and exit flags of the rows that a later row's state still depends on.
CARRY = "entry array<double>, leave array<double>"


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LateHoldings(StatefulProcessor):
    """The holdings of one market whose rows come in any order: rows wait in a map by time until the watermark has passed them, a timer
    stands at the earliest one that waits, and what it releases is folded in order of time. A row that comes twice counts as
    it came last, until it is released."""

    def __init__(self, cooldown: int, longest: int | None) -> None:
        self.cooldown, self.longest = cooldown, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "entry double, leave double")
        self.carry = handle.getValueState("carry", CARRY)
        self.first = handle.getValueState("first", "at long")

    def _stand(self, at: int | None) -> None:
        """The timer at the earliest time that waits; it fires when the watermark is past it."""
        if at is not None and (not self.first.exists() or at < self.first.get()[0]):
            self.first.update((at,))
            self.handle.registerTimer(at // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        low, passed = None, timerValues.getCurrentWatermarkInMs() * 1000
        for pdf in rows:
            for at, entry, leave in zip(pdf["ts"].astype("datetime64[us]").astype("int64").tolist(), pdf["entry"].tolist(), pdf["leave"].tolist(), strict=True):
                if at >= passed:
                    self.waiting.updateValue((at,), (float("nan") if entry is None else float(entry), float("nan") if leave is None else float(leave)))
                    low = at if low is None else min(low, at)
        self._stand(low)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        every = sorted((k[0], *v) for k, v in self.waiting.iterator())
        ready = [r for r in every if r[0] < passed]
        self.first.clear()
        self._stand(every[len(ready)][0] if len(ready) < len(every) else None)
        if not ready:
            return iter([])
        entry, leave = (np.array(x, float) for x in self.carry.get()) if self.carry.exists() else (np.zeros(0), np.zeros(0))
        before = len(entry)
        entry, leave = (np.concatenate([old, [r[k] for r in ready]]) for old, k in ((entry, 1), (leave, 2)))
        held, resume = holdings(entry, leave, self.cooldown, self.longest)
        self.carry.update((entry[resume:].tolist(), leave[resume:].tolist()))
        for r in ready:
            self.waiting.removeKey((r[0],))
        at = pd.to_datetime([r[0] for r in ready], unit="us")
        return iter([pd.DataFrame({"market": key[0], "ts": at, "held": held[before:]})])

    def close(self) -> None:
        pass


def late_holdings(flags: DataFrame, lateness: str, cooldown: int = 0, longest: int | None = None) -> DataFrame:
    """As stream_holdings, for rows that come up to `lateness` late, in any order and in any batch: a time's state is given once the
    watermark is past it, and rows that come later than that are left out. Needs the RocksDB state store (see ROCKSDB) and session
    time in UTC."""
    if flags.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {ROCKSDB}")
    marked = flags.withWatermark("ts", lateness).groupBy("market")
    return marked.transformWithStateInPandas(LateHoldings(cooldown, longest), HELD, "append", "eventTime")


def stream_holdings(flags: DataFrame, cooldown: int = 0, longest: int | None = None) -> DataFrame:
    """held of rolling.holding_state() over a stream of market, ts, entry, leave whose batches come in order of time; a row at or before
    a time that was there already raises (late_holdings takes such rows). What is kept of a market are its flags since the start of a
    holding that is not over, cooled down and open to an entry, so the state is as long as one holding and its cooldown."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(parts)).sort_values("ts", ignore_index=True)
        *flags_so_far, last = state.get if state.exists else ([], [], None)
        if last is not None and len(new) and new["ts"].iloc[0] <= pd.Timestamp(last):
            raise ValueError(f"{key[0]}: rows out of order of time")
        entry, leave = (np.array(x, float) for x in flags_so_far)
        before = len(entry)
        entry, leave = (np.concatenate([old, new[c].to_numpy(float)]) for old, c in ((entry, "entry"), (leave, "leave")))
        held, resume = holdings(entry, leave, cooldown, longest)
        state.update((entry[resume:].tolist(), leave[resume:].tolist(), new["ts"].iloc[-1].to_pydatetime()))
        yield pd.DataFrame({"market": key[0], "ts": new["ts"], "held": held[before:]})

    return flags.groupBy("market").applyInPandasWithState(step, HELD, f"{CARRY}, last timestamp", "append", GroupStateTimeout.NoTimeout)


def read_version(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{path}/v={number}")


def publish_latest(stream: DataFrame, path: str, target: str, checkpoint: str):
    """After each batch, path/v=N holds each market's latest target so far."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select("ts", "market", target)
        if number:
            rows = rows.unionByName(read_version(batch.sparkSession, path, number - 1))
        latest_targets(rows, target, F.lit("9999-12-31").cast("timestamp")).write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
