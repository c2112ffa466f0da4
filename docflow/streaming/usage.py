"""Exact usage and admissions on a stream of requests (user_id, event_id, ts, chars)."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docflow.operators.usage import DAILY_QUOTA, DAY, Admission
from docflow.streaming.progress import bucket

ROLLING = "user_id long, event_id long, at long, chars long, rolling long, seq long"


def _stored(*columns: np.ndarray) -> tuple[bytes, ...]:
    return tuple(c.astype(np.int64).tobytes() for c in columns)


def _runs(users: np.ndarray) -> Iterator[slice]:
    """The places of each user in sorted ``users``."""
    cuts = [0, *(np.flatnonzero(np.diff(users)) + 1).tolist(), len(users)]
    return (slice(a, b) for a, b in itertools.pairwise(cuts) if a < b)


class RollingUsage(StatefulProcessor):
    """The events of the last window of a group's users, and the totals that new ones give or change."""

    def __init__(self, seconds: int) -> None:
        self.span = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value a group: each call on a state is a round trip
        self.held = handle.getValueState("held", "users binary, at binary, events binary, chars binary, seq long, timer long")

    def _load(self, floor: int) -> tuple[list[np.ndarray], int, int]:
        """Users, times, events and characters not before ``floor``; the last seq; the timer."""
        held = self.held.get() or (b"", b"", b"", b"", 0, 0)
        columns = [np.frombuffer(x, np.int64) for x in held[:4]]
        return [c[columns[1] >= floor] for c in columns], held[4], held[5]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old, seq, timer = self._load(timerValues.getCurrentWatermarkInMs() * 1000 - self.span)
        told = pd.concat(list(rows))
        new = [told[c].to_numpy(np.int64) for c in ("user_id", "at", "event_id", "chars")]
        fresh = np.concatenate([np.zeros(len(old[0]), bool), np.ones(len(new[0]), bool)])
        every = [np.concatenate(pair) for pair in zip(old, new, strict=True)]
        order = np.lexsort(every[::-1])
        users, at, events, chars = every = [c[order] for c in every]
        fresh, rolling, some = fresh[order], np.zeros(len(order), np.int64), np.zeros(len(order), bool)
        for own in _runs(users):
            mine, sums, young = at[own], np.concatenate([[0], np.cumsum(chars[own])]), at[own][fresh[own]]
            begin = mine - self.span
            rolling[own] = sums[np.searchsorted(mine, mine, "right")] - sums[np.searchsorted(mine, begin)]
            some[own] = np.searchsorted(young, mine, "right") > np.searchsorted(young, begin)  # totals with a new event in their window are new or changed
        if not timer:
            timer = self._due(at)
            self.handle.registerTimer(timer)
        self.held.update((*_stored(*every), seq + 1, timer))
        yield pd.DataFrame({"user_id": users[some], "event_id": events[some], "at": at[some], "chars": chars[some], "rolling": rolling[some], "seq": np.full(int(some.sum()), seq + 1)})

    def _due(self, at: np.ndarray) -> int:
        return (int(at.max()) + self.span) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        left, seq, _ = self._load(timerValues.getCurrentWatermarkInMs() * 1000 - self.span)
        if len(left[1]):
            due = self._due(left[1])
            self.handle.registerTimer(due)
            self.held.update((*_stored(*left), seq, due))
        else:
            self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def _requests(requests: DataFrame, delay: str, *more: str) -> DataFrame:
    usable = requests.where("user_id IS NOT NULL AND ts IS NOT NULL")
    return usable.select("user_id", "ts", F.unix_micros("ts").alias("at"), F.coalesce("chars", F.lit(0)).cast("long").alias("chars"), *more, bucket("user_id")).withWatermark("ts", delay)


def rolling_usage_stream(usage: DataFrame, seconds: int = DAY, delay: str = "1 hour") -> DataFrame:
    """user_id, event_id, ts, chars, rolling, seq: the user's characters in the ``seconds`` up to each event.

    An event that comes late also brings new totals of the events behind it; of an event the row
    with the largest ``seq`` holds. A user's events are held until no event to come can need them.
    Defined cases: null characters are 0; rows without a user or time are left out; event ids tell
    rows apart, so they must not be null; events at one time count each other, as in the batch form.
    """
    held = _requests(usage.where("event_id IS NOT NULL"), delay, "event_id").groupBy("bucket")
    rows = held.transformWithStateInPandas(statefulProcessor=RollingUsage(seconds), outputStructType=ROLLING, outputMode="Update", timeMode="EventTime")
    return rows.withColumn("ts", F.timestamp_micros("at")).drop("at")


def last_totals(rows: DataFrame) -> DataFrame:
    """The last row of each event, from what a rolling usage stream wrote in any number of batches."""
    last = F.max_by(F.struct("ts", "chars", "rolling"), "seq").alias("x")
    return rows.groupBy("user_id", "event_id").agg(last).select("user_id", "event_id", "x.*")


ADMITTED = "user_id long, at long, chars long, admitted boolean"


class AdmissionReplay(StatefulProcessor):
    """Requests of a group's users wait until the watermark has passed them, then are decided in order of time."""

    def __init__(self, quota: int, seconds: int) -> None:
        self.quota, self.span = quota, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # users, times and characters of what waits and of the open windows, in one value a group
        self.held = handle.getValueState("held", "users binary, at binary, chars binary, open_users binary, open_at binary, open_chars binary, timer long")

    def _load(self) -> tuple[list[np.ndarray], list[np.ndarray], int]:
        held = self.held.get() or (b"",) * 6 + (0,)
        columns = [np.frombuffer(x, np.int64) for x in held[:6]]
        return columns[:3], columns[3:], held[6]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting, window, timer = self._load()
        told = pd.concat(list(rows))
        waiting = [np.concatenate([old, told[c].to_numpy(np.int64)]) for old, c in zip(waiting, ("user_id", "at", "chars"), strict=True)]
        due = -(-int(told["at"].min()) // 1000)
        if not timer or due < timer:
            timer = due
            self.handle.registerTimer(timer)
        self.held.update((*_stored(*waiting, *window), timer))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting, window, timer = self._load()
        now = timerValues.getCurrentWatermarkInMs() * 1000
        ready = waiting[1] <= now
        order = np.lexsort([c[ready] for c in waiting[::-1]])
        users, at, chars = due = [c[ready][order] for c in waiting]
        windows: dict[int, Admission] = {}
        for user, held in itertools.groupby(zip(*(c.tolist() for c in window), strict=True), lambda x: x[0]):
            windows[user] = Admission(self.quota, self.span, [x[1:] for x in held])
        admitted = np.zeros(len(users), bool)
        for own in _runs(users):
            mine = windows.setdefault(int(users[own.start]), Admission(self.quota, self.span))
            admitted[own] = [mine.decide(*x) for x in zip(at[own].tolist(), chars[own].tolist(), strict=True)]
        for mine in windows.values():
            mine.forget(now - self.span)
        rows = [(user, *x) for user, mine in windows.items() for x in mine.held]
        window = list(np.array(rows, np.int64).reshape(-1, 3).T)
        waiting = [c[~ready] for c in waiting]
        if len(waiting[1]):
            timer = -(-int(waiting[1].min()) // 1000)
        elif rows:
            timer = (int(window[1].max()) + self.span) // 1000 + 1
        if len(waiting[1]) or rows:
            self.handle.registerTimer(timer)
            self.held.update((*_stored(*waiting, *window), timer))
        else:
            self.held.clear()
        if len(users):
            yield pd.DataFrame(dict(zip(("user_id", "at", "chars"), due, strict=True)) | {"admitted": admitted})

    def close(self) -> None:
        pass


def admission_stream(requests: DataFrame, quota: int = DAILY_QUOTA, seconds: int = DAY, delay: str = "1 hour") -> DataFrame:
    """user_id, ts, chars, admitted, as the batch replay decides them, for any order of arrival within ``delay``.

    A request is decided when the watermark has passed it, so the newest ones wait for later events
    of anyone. Rows without a user or time are left out; null characters are 0; repeated rows are
    requests each; of requests at one time the smaller one is decided first.
    """
    waiting = _requests(requests, delay).groupBy("bucket")
    rows = waiting.transformWithStateInPandas(statefulProcessor=AdmissionReplay(quota, seconds), outputStructType=ADMITTED, outputMode="Append", timeMode="EventTime")
    return rows.select("user_id", F.timestamp_micros("at").alias("ts"), "chars", "admitted")
