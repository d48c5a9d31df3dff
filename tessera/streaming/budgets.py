"""Budgets over a stream with keyed state that forgets: reservations by payment, and admission by scope and day.

State is kept in the state store by key, a payment a row, so that a key's payments need not fit into one value. Timers of event
time remove what was finished long enough ago: the state follows the open payments and the recent ones, not all that ever
came. Events are taken in the order of their ids within a micro-batch; results equal those of the batch folds where the
micro-batches follow each other in that order.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Setting of the state store that keyed maps and timers need; the session's owner makes it.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _millis(ts) -> int:
    return int(ts.timestamp() * 1000)


class Reservations(StatefulProcessor):
    """reserve, settle, release and unknown by payment of a key, over rows (id, payment, kind, amount, ts).

    Repeats change nothing, and an unknown outcome keeps its reservation. A finished payment is remembered for `keep` of event
    time, so that its repeats are known, an open one for as long as it is open; a repeat after that is a new payment.
    """

    def __init__(self, keep: timedelta):
        self.keep = int(keep.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "payment string", "amount long")
        self.done = handle.getMapState("done", "payment string", "until long")
        self.sums = handle.getValueState("sums", "reserved long, settled long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        reserved, settled = self.sums.get() if self.sums.exists() else (0, 0)
        out, timers = [], set()
        for r in sorted(rows, key=lambda r: r.id):
            p = (r.payment,)
            if r.kind == "reserve" and not self.held.containsKey(p) and not self.done.containsKey(p):
                self.held.updateValue(p, (r.amount,))
                reserved += r.amount
            elif r.kind in ("settle", "release") and self.held.containsKey(p):
                reserved -= self.held.getValue(p)[0]
                self.held.removeKey(p)
                until = _millis(r.ts) + self.keep
                self.done.updateValue(p, (until,))
                timers.add(until)
                settled += r.amount if r.kind == "settle" else 0
            out.append(Row(id=r.id, reserved=reserved, settled=settled))
        self.sums.update((reserved, settled))
        for t in timers:
            self.handle.registerTimer(t)
        yield from out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for payment in [p for p, (until,) in self.done.iterator() if until <= now]:
            self.done.removeKey(payment)
        yield from ()

    def close(self) -> None:
        pass


class DailyBudget(StatefulProcessor):
    """Admits amounts of a scope's day, in order, while their sum stays within a limit, over rows (id, amount, ends), ends being the
    end of the day. A day's state goes once the watermark is `keep` past its end; rows that come later than the watermark
    allows have been dropped by then."""

    def __init__(self, limit: int, keep: timedelta):
        self.limit, self.keep = limit, int(keep.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spent = handle.getValueState("spent", "spent long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = not self.spent.exists()
        spent = 0 if new else self.spent.get()[0]
        ends, out = 0, []
        for r in sorted(rows, key=lambda r: r.id):
            ok = spent + r.amount <= self.limit
            spent += r.amount if ok else 0
            ends = _millis(r.ends)
            out.append(Row(id=r.id, admitted=ok, spent=spent))
        self.spent.update((spent,))
        if new:
            self.handle.registerTimer(ends + self.keep)
        yield from out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.spent.clear()
        yield from ()

    def close(self) -> None:
        pass


def reservations_stream(events: DataFrame, key: str, keep: timedelta, late: str = "0 seconds") -> DataFrame:
    """(id, reserved, settled) of a stream (key, id long, payment, kind, amount long, ts timestamp). Needs STATE_STORE."""
    given = events.select(key, "id", F.col("payment").cast("string").alias("payment"), "kind", "amount", "ts").withWatermark("ts", late)
    return given.groupBy(key).transformWithState(Reservations(keep), "id long, reserved long, settled long", "Append", "EventTime")


def daily_budget_stream(events: DataFrame, scope: str, limit: int, keep: timedelta, late: str = "0 seconds") -> DataFrame:
    """(id, admitted, spent) of a stream (scope, id long, amount long, ts timestamp); each scope's day is a key of its own. Needs
    STATE_STORE."""
    given = events.withWatermark("ts", late).select(scope, "id", "amount", "ts", F.to_date("ts").alias("day"), (F.date_trunc("day", "ts") + F.expr("interval 1 day")).alias("ends"))
    return given.groupBy("day", scope).transformWithState(DailyBudget(limit, keep), "id long, admitted boolean, spent long", "Append", "EventTime")
