"""Stateful processors whose rows wait for the watermark and leave in order.

Rows arrive in any order. A key is a group of users or chains, and its rows wait in
buckets of time; a bucket registers one timer, at its end. When the watermark has
passed that, no row of the bucket can come any more, and all buckets that are due
are worked off in order of time. A call to the state costs far more than a row, so
calls grow with groups and buckets, not with rows, users or chains. Input comes in
Arrow batches; at most ``HELD`` rows are held before they go to the state.
"""

from __future__ import annotations

import json
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gavel.operators.tasks import SESSION_OUT

LIMITER_OUT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
                            T.StructField("ts_unit", T.LongType()), T.StructField("allowed", T.BooleanType())])


HELD = 50_000  # rows of a group that a task holds before it writes them to the state
SLOTS = 16  # values that the chains of a group share by hash


def _held(frames: Iterator[pd.DataFrame], columns: list[str], numbers: set[str]) -> Iterator[list[tuple]]:
    """The rows of all frames but closing ones, in lists of about ``HELD``."""
    rows = []
    for frame in frames:
        frame = frame[~frame["closing"].astype(bool)]
        rows += zip(*[(frame[c].astype("int64") if c in numbers else frame[c]).tolist() for c in columns])
        if len(rows) >= HELD:
            yield rows
            rows = []
    if rows:
        yield rows


class _Buckets(StatefulProcessor):
    """What both processors share: which buckets of a group are due.

    ``handled``: group -> the watermark up to which this task has worked it off;
    further timers of the same watermark have nothing left to do."""

    def __init__(self, width_ms: int):
        self.width_ms, self.handled = width_ms, {}

    def _end(self, bucket: int) -> int:
        return (bucket + 1) * self.width_ms

    def _due(self, key, timerValues, expiredTimerInfo, names) -> list[int] | None:
        """Buckets of ``names`` to work off in order; None if that is done."""
        mark = timerValues.getCurrentWatermarkInMs()
        if self.handled.get(key[0]) == mark:
            return None
        self.handled[key[0]] = mark
        self.upto = max(mark, expiredTimerInfo.getExpiryTimeInMs())
        return sorted(b for (b,) in names() if self._end(b) <= self.upto)

    def close(self) -> None:
        pass


class LimiterProcessor(_Buckets):
    """Greedy limiter of a group of users.

    ``waiting``: bucket -> the ``limit`` smallest ids of each user and unit that came
    for it; of one unit no other can be allowed, so the rest are denied at once.
    ``kept``: user -> allowed times that still count. A timer, a window after the
    newest of them, empties ``kept``. Users are texts, empty for none."""

    def __init__(self, window: int, limit: int, unit_ms: int, width: int):
        super().__init__(width * unit_ms)
        self.window, self.limit, self.unit_ms, self.width = window, limit, unit_ms, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket bigint", "users array<string>, units array<bigint>, ids array<bigint>")
        self.kept = handle.getMapState("kept", "user string", "times array<bigint>")

    def _rows(self, rows: list) -> pd.DataFrame:
        rows = [(i, int(user) if user else None, unit, allowed) for i, user, unit, allowed in rows]
        return pd.DataFrame(rows, columns=[f.name for f in LIMITER_OUT.fields], dtype=object)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in _held(rows, ["user", "ts_unit", "event_id"], {"ts_unit", "event_id"}):
            buckets, denied = defaultdict(lambda: defaultdict(list)), []
            for user, unit, event in part:
                buckets[unit // self.width][user, unit].append(event)
            for bucket, fresh in buckets.items():
                held = self.waiting.getValue((bucket,))
                if held is None:
                    self.handle.registerTimer(self._end(bucket))
                for user, unit, event in zip(*(held or ((), (), ()))):
                    fresh[user, unit].append(event)
                keep = []
                for (user, unit), ids in fresh.items():
                    ids.sort()
                    keep += [(user, unit, i) for i in ids[:self.limit]]
                    denied += [(i, user, unit, False) for i in ids[self.limit:]]
                self.waiting.updateValue((bucket,), tuple(list(c) for c in zip(*keep)))
            if denied:
                yield self._rows(denied)

    def _counts(self, times) -> bool:
        """Whether allowed times can still count for a request to come."""
        return bool(times) and (times[-1] + self.window) * self.unit_ms > self.upto

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = self._due(key, timerValues, expiredTimerInfo, self.waiting.keys)
        if due is None:
            return
        stored = {user: times for (user,), (times,) in self.kept.iterator()}
        kept = {user: deque(times) for user, times in stored.items()}
        for bucket in due:
            users, units, ids = self.waiting.getValue((bucket,))
            out = []
            for unit, event, user in sorted(zip(units, ids, users)):
                times = kept.setdefault(user, deque())
                while times and times[0] <= unit - self.window:
                    times.popleft()
                out.append((event, user, unit, len(times) < self.limit))
                if out[-1][3]:
                    times.append(unit)
            self.waiting.removeKey((bucket,))
            yield self._rows(out)
        last = None
        for user, times in kept.items():
            if not self._counts(times):
                if user in stored:
                    self.kept.removeKey((user,))
                continue
            if list(times) != list(stored.get(user, ())):
                self.kept.updateValue((user,), (list(times),))
                last = max(last or times[-1], times[-1])
        if last is not None:
            self.handle.registerTimer((last + self.window) * self.unit_ms)


class SessionProcessor(_Buckets):
    """Session log of a group of chains.

    ``parts``: bucket -> the number of its parts; ``waiting``: (bucket, part) -> the
    events that came together; ``chains``: slot -> its chains with the number of
    applied events, and their live ids with owners. Chains are texts, empty for none."""

    def __init__(self, as_op: Callable, width_ms: int):
        super().__init__(width_ms)
        self.as_op = as_op

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "bucket bigint", "n bigint")
        self.waiting = handle.getMapState("waiting", "bucket bigint, part bigint",
                                          "at array<bigint>, tie array<bigint>, chain array<string>, event array<string>")
        self.chains = handle.getMapState("chains", "slot int", "chain array<string>, applied array<bigint>, "
                                         "of array<string>, id array<string>, owner array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for held in _held(rows, ["at", "tie", "chain", "event"], {"at", "tie"}):
            buckets = defaultdict(list)
            for row in held:
                buckets[row[0] // 1000 // self.width_ms].append(row)
            for bucket, fresh in buckets.items():
                before = self.parts.getValue((bucket,))
                part = before[0] if before else 0
                if not part:
                    self.handle.registerTimer(self._end(bucket))
                self.waiting.updateValue((bucket, part), tuple(list(c) for c in zip(*fresh)))
                self.parts.updateValue((bucket,), (part + 1,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = self._due(key, timerValues, expiredTimerInfo, self.parts.keys)
        if not due:
            return
        slots = {}  # slot -> (chain -> applied events, (chain, id) -> owner)
        for bucket in due:
            events, out = [], []
            for part in range(self.parts.getValue((bucket,))[0]):
                events += zip(*self.waiting.getValue((bucket, part)))
                self.waiting.removeKey((bucket, part))
            self.parts.removeKey((bucket,))
            for _, _, chain, event in sorted(events):
                slot = crc32(chain.encode()) % SLOTS
                if slot not in slots:
                    names, counts, of, ids, owners = self.chains.getValue((slot,)) or ((),) * 5
                    slots[slot] = dict(zip(names, counts)), dict(zip(zip(of, ids), owners))
                applied, live = slots[slot]
                k = applied[chain] = applied.get(chain, 0) + 1
                op, session_id, user_id, new_id = self.as_op(k, json.loads(event))
                owner = user_id if op == "create" else live.pop((chain, session_id), None)
                issued = {"create": session_id, "rotate": new_id}.get(op)
                alive = op == "create" or (issued is not None and owner is not None)
                if alive:
                    live[chain, issued] = owner
                out.append((int(chain) if chain else None, k, op, new_id if op == "rotate" else session_id, owner, alive,
                            "unknown session id" if op == "rotate" and owner is None else None))
            yield pd.DataFrame(out, columns=[f.name for f in SESSION_OUT.fields], dtype=object)
        for slot, (applied, live) in slots.items():
            self.chains.updateValue((slot,), (list(applied), list(applied.values()), [c for c, _ in live], [i for _, i in live], list(live.values())))
