"""Keyed streams with re-armed timers and entries that run out: alerts by incident, and a cache of verdicts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brindle.operators.decisions import VERDICT_HOURS
from brindle.streaming.stateful import Folding, _folded, in_order

#: Failures in a row that open an incident, and how long a failed alert waits.
THRESHOLD, COOLDOWN_MS = 3, 6 * 3_600_000


class SourceAlerts(Folding):
    """One alert an incident and one when it is over; an alert that could not be sent is tried again when its pause ends, if it still holds.

    State: failures in a row, whether an incident's alert is out, and until when the source is paused (-1: it is not). `at` is in milliseconds. A pause that ends before a row is dealt with before
    that row, so what is sent does not depend on how rows are cut into batches; a timer ends those after which nothing comes, and is set anew by each failure.
    """

    STATE = "streak bigint, opened boolean, until bigint"
    OUT = Row("key", "at", "kind", "sent")
    sends: Callable[[int], bool] = staticmethod(lambda at: True)

    def begin(self) -> tuple:
        return 0, False, -1

    def _tell(self, streak: int, opened: bool, at: int) -> tuple[tuple, list[tuple]]:
        """An attempt at `at`, if there is something to say."""
        kind = "incident" if streak >= THRESHOLD and not opened else "recovery" if streak == 0 and opened else None
        if kind is None:
            return (streak, opened, -1), []
        ok = self.sends(at)
        return (streak, kind == "incident" if ok else opened, -1 if ok else at + COOLDOWN_MS), [(at, kind, ok)]

    def _ended(self, state: tuple, upto: int) -> tuple[tuple, list[tuple]]:
        out = []
        while 0 <= state[2] <= upto:
            state, more = self._tell(state[0], state[1], state[2])
            out += more
        return state, out

    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        state, out = self._ended(state, row.at)
        streak = 0 if row.ok else state[0] + 1
        if state[2] >= 0:
            return (streak, *state[1:]), out
        state, more = self._tell(streak, state[1], row.at)
        return state, out + more

    def deadline(self, state: tuple) -> int:
        return state[2]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        kept = self.state.get()
        if kept is not None:
            fired = expiredTimerInfo.getExpiryTimeInMs()
            state, out = self._ended(tuple(kept), timerValues.getCurrentWatermarkInMs())
            self.state.update(state)
            self.settle(-1 if fired == kept[2] else kept[2], state)  # the timer that went off is gone by itself
            for values in out:
                yield self.OUT(key[0], *values)


def source_alerts(stream: DataFrame, sends: Callable[[int], bool], event_time: str, delay: str) -> DataFrame:
    """`stream`: key, at (milliseconds), tie, ok and the timestamp `event_time`. (key, at, kind, sent) of every attempt to alert."""
    processor = SourceAlerts()
    processor.sends = sends
    return _folded(stream.withWatermark(event_time, delay), processor, "at bigint, kind string, sent boolean", "Append", "EventTime")


class VerdictCache(StatefulProcessor):
    """Verdicts by id, each for the time that its class lasts; a row whose id has a live one takes it, another is looked up and kept.

    State is a map from id to (verdict, when it runs out), in event time. Timers take entries away once the watermark is past them, so the state does not grow with ids seen once.
    """

    OUT = Row("key", "tie", "verdict", "cached")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("verdicts", "id bigint", "verdict string, until bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known, changed = {}, set()
        for row in sorted(rows, key=in_order):
            if row.id not in known:
                known[row.id] = self.kept.getValue((row.id,)) if self.kept.containsKey((row.id,)) else None
            live = known[row.id]
            if live is not None and live[1] > row.at:
                yield self.OUT(key[0], row.tie, live[0], True)
                continue
            until = row.at + (VERDICT_HOURS[row.verdict] * 3_600_000 if row.verdict in VERDICT_HOURS else 60_000)
            known[row.id] = (row.verdict, until)
            changed.add(row.id)
            yield self.OUT(key[0], row.tie, row.verdict, False)
        for name in changed:  # each id's last verdict is all that is kept
            self.kept.updateValue((name,), known[name])
            self.handle.registerTimer(known[name][1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        for entry in [k for k, v in self.kept.iterator() if v[1] <= now]:
            self.kept.removeKey(tuple(entry))
        yield from ()

    def close(self) -> None:
        pass


def cached_verdicts(stream: DataFrame, event_time: str, delay: str) -> DataFrame:
    """`stream`: key, id, at (milliseconds), tie, verdict (what a look-up gives) and `event_time`. (key, tie, verdict, cached) of every row."""
    return _folded(stream.withWatermark(event_time, delay), VerdictCache(), "tie bigint, verdict string, cached boolean", "Append", "EventTime")


def deadline_sends(at: int) -> bool:
    """A channel that takes what comes in three of every seven seconds: for queries and tests."""
    return at // 1000 % 7 >= 4


