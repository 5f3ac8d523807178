"""Keyed streams with list and map state and event-time timers.

Rows may come in any order and in any number of files: they wait in list state
until the watermark has passed them, and a timer then takes them in order. So a
stream gives what a batch gives, for all rows that come within the watermark's
delay; later ones are dropped by Spark. State is written entry by entry, not
whole, and needs the RocksDB state store. Rows come and go as rows: a frame for
each key of a few rows would cost more than its state.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillmill.streaming.reviewlog import OUTCOME, fold

#: The state store that these streams need.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Takes a key's rows by (time, tie) once the watermark has passed them.

    ``columns`` names the row's columns and ``schema`` their types; ``time``
    is the place of the microseconds among them.
    """

    columns: tuple[str, ...] = ()
    schema = ""
    output: tuple[str, ...] = ()
    time, tie = 0, 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.schema)
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """State of the operator's own."""

    def take(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        """Output rows for these input rows, which come in order."""
        raise NotImplementedError

    def expire(self, key: tuple, watermark: int) -> list[tuple]:
        """Output rows for what the passing of time (microseconds) ends."""
        return []

    def next_timer(self) -> int | None:
        """When time would end something, in microseconds."""
        return None

    def _wake(self, rows: list[tuple]) -> None:
        for at in {min((r[self.time] for r in rows), default=None), self.next_timer()} - {None}:
            self.handle.registerTimer(at // 1000 + 1)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        got = [tuple(r[c] for c in self.columns) for r in rows]
        if got:
            self.pending.appendList(got)
            self._wake(got)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(r) for r in self.pending.get()]
        due = sorted((r for r in waiting if r[self.time] < passed), key=lambda r: (r[self.time], r[self.tie]))
        left = [r for r in waiting if r[self.time] >= passed]
        out = self.take(key, due) if due else []
        out += self.expire(key, passed)
        if due:
            self.pending.put(left) if left else self.pending.clear()
        self._wake(left)
        named = Row(*self.output)
        return iter([named(*r) for r in out])

    def close(self) -> None:
        pass


class Reviews(InOrder):
    """L1, L2: the stack of active reviews of a question as a map from depth to review."""

    columns = ("at", "event", "action", "verdict", "expected")
    schema = "at long, event long, action string, verdict string, expected long"
    output = ("run", "question", "event", "outcome", "active")

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.depth = handle.getValueState("depth", "n long")
        self.stack = handle.getMapState("stack", "n long", "event long, verdict string")

    def take(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        base = depth = (self.depth.get() or (0,))[0]
        # only what is on top is read, and only what has changed is written
        own: list[tuple[int, str]] = []
        out = []
        for _, event, action, verdict, expected in rows:
            if not own and base:
                base -= 1
                own.append(tuple(self.stack.getValue((base,))))
            out.append((*key, event, fold(own, event, action, verdict, expected), None))
            if not own and base:
                base -= 1
                own.append(tuple(self.stack.getValue((base,))))
            out[-1] = (*out[-1][:-1], own[-1][0] if own else None)
        for n in range(base + len(own), depth):
            self.stack.removeKey((n,))
        for n, review in enumerate(own, base):
            self.stack.updateValue((n,), review)
        self.depth.update((base + len(own),))
        return out


class Admissions(InOrder):
    """L4: a sliding-log rate limit; the times of admitted requests are list state, rejected ones stay out."""

    columns, schema, output = ("at", "event"), "at long, event long", ("client", "bucket", "event", "admitted")

    def __init__(self, limits: dict[str, int], default: int, seconds: int):
        self.limits, self.default, self.span = limits, default, seconds * 1_000_000

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getListState("window", "at long")

    def _times(self) -> list[int]:
        return [r[0] for r in self.window.get()] if self.window.exists() else []

    def take(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        times, most, out = self._times(), self.limits.get(key[1], self.default), []
        for at, event in rows:
            times = [t for t in times if t > at - self.span]
            ok = len(times) < most
            times += [at] * ok
            out.append((*key, event, ok))
        self.window.put([(t,) for t in times]) if times else self.window.clear()
        return out

    def expire(self, key: tuple, watermark: int) -> list[tuple]:
        times = self._times()
        kept = [t for t in times if t > watermark - self.span]
        if len(kept) < len(times):
            self.window.put([(t,) for t in kept]) if kept else self.window.clear()
        return []

    def next_timer(self) -> int | None:
        """When the newest admitted request leaves the window, so that idle clients hold no state."""
        times = self._times()
        return times[-1] + self.span if times else None


class Sessions(InOrder):
    """A session lives ``seconds`` from its first request; a later one opens another. A timer ends it."""

    columns, schema, output = ("at", "event"), "at long, event long", ("client", "event", "created", "state")

    def __init__(self, seconds: int):
        self.ttl = seconds * 1_000_000

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.created = handle.getValueState("created", "at long")

    def take(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        created, out = self.created.get()[0] if self.created.exists() else None, []
        for at, event in rows:
            if created is not None and at - created > self.ttl:
                out.append((*key, None, created, "expired"))
                created = None
            out.append((*key, event, at if created is None else created, "opened" if created is None else "live"))
            created = at if created is None else created
        self.created.update((created,))
        return out

    def expire(self, key: tuple, watermark: int) -> list[tuple]:
        created = self.created.get()[0] if self.created.exists() else None
        if created is None or created + self.ttl >= watermark:
            return []
        self.created.clear()
        return [(*key, None, created, "expired")]

    def next_timer(self) -> int | None:
        return self.created.get()[0] + self.ttl + 1 if self.created.exists() else None


class Ring(InOrder):
    """The last ``size`` rows of a context, as a map from place to row; a new row takes the place of the oldest."""

    columns, schema, output = ("at", "event"), "at long, event long", ("context", "event", "held", "evicted")

    def __init__(self, size: int):
        self.size = size

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")
        self.ring = handle.getMapState("ring", "place long", "event long")

    def take(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        n, out = self.count.get()[0] if self.count.exists() else 0, []
        held: dict[int, int] = {}
        for _, event in rows:
            place = n % self.size
            old = None
            if n >= self.size:
                old = held[place] if place in held else self.ring.getValue((place,))[0]
            held[place] = event
            n += 1
            out.append((*key, event, min(n, self.size), old))
        for place, event in held.items():
            self.ring.updateValue((place,), (event,))
        self.count.update((n,))
        return out


def _run(rows: DataFrame, keys: list[str], time: str, delay: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    """``rows`` have a timestamp column ``time``; a row without one is left out, since no watermark ever passes it."""
    timed = rows.filter(F.col(time).isNotNull()).withColumn("at", F.unix_micros(time)).withWatermark(time, delay)
    return timed.groupBy(*keys).transformWithState(processor, schema, "Append", "EventTime")


def replay_stream(log: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """L1, L2: outcomes of the actions of a log (run, question, event, action, verdict, expected) in the order of time and event."""
    return _run(log, ["run", "question"], time, delay, Reviews(), OUTCOME)


def admitted_stream(requests: DataFrame, limits: dict[str, int], default: int = 120, seconds: int = 60, time: str = "ts", delay: str = "1 minute") -> DataFrame:
    """L4: whether each request (client, bucket, event) is admitted."""
    return _run(requests, ["client", "bucket"], time, delay, Admissions(limits, default, seconds), "client string, bucket string, event long, admitted boolean")


def session_stream(requests: DataFrame, seconds: int = 1800, time: str = "ts", delay: str = "1 minute") -> DataFrame:
    """The session of each request (client, event), and a row for each session that ends."""
    return _run(requests, ["client"], time, delay, Sessions(seconds), "client string, event long, created long, state string")


def ring_stream(rows: DataFrame, size: int = 500, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each row (context, event) as it enters its context's ring, how many the ring then holds, and the row that leaves."""
    return _run(rows, ["context"], time, delay, Ring(size), "context string, event long, held long, evicted long")
