"""Quotas and rates."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400
DAILY_QUOTA = 10_000


def chars_used(usage: DataFrame, now: Column, seconds: int = DAY) -> DataFrame:
    """user_id, used: characters of the trailing ``seconds`` before ``now``."""
    recent = usage.where((F.col("ts") >= now - F.make_dt_interval(secs=F.lit(seconds))) & (F.col("ts") <= now))
    return recent.groupBy("user_id").agg(F.sum("chars").alias("used"))


def check_quota(df: DataFrame, quota: int = DAILY_QUOTA) -> DataFrame:
    """``df`` (used, want) with ok and remaining."""
    return df.withColumns(
        {"ok": F.col("used") + F.col("want") <= quota, "remaining": F.greatest(F.lit(0).cast("long"), F.lit(quota).cast("long") - F.col("used"))}
    )


def rolling_usage(usage: DataFrame, seconds: int = DAY) -> DataFrame:
    """``usage`` with ``rolling``: the user's characters in the ``seconds`` up to each event.

    Defined cases: events at one time count for each other, repeated rows are events each; those
    without a user are one user's; those without a time see only each other; null characters add
    nothing, and where no event in sight has any, the sum is null.
    """
    order = F.unix_micros(F.col("ts").cast("timestamp"))
    span = Window.partitionBy("user_id").orderBy(order).rangeBetween(-seconds * 1_000_000, 0)
    return usage.withColumn("rolling", F.sum("chars").over(span))


class Admission:
    """What was admitted in the window before the present request."""

    def __init__(self, quota: int, span: int, held: Iterable[tuple[int, int]] = ()):
        self.quota, self.span, self.held = quota, span, deque(held)
        self.sum = sum(chars for _, chars in self.held)

    def forget(self, before: int) -> None:
        while self.held and self.held[0][0] < before:
            self.sum -= self.held.popleft()[1]

    def decide(self, at: int, chars: int) -> bool:
        """Whether a request is admitted; requests come in order of time."""
        self.forget(at - self.span)
        ok = self.sum + chars <= self.quota
        if ok:
            self.held.append((at, chars))
            self.sum += chars
        return ok


def replay_admission(requests: DataFrame, quota: int = DAILY_QUOTA, seconds: int = DAY) -> DataFrame:
    """user_id, ts, chars, admitted: each request against what was admitted in the window before it.

    A rejected request adds nothing, so decisions depend on decisions: rows come sorted by time,
    and a task walks through them with the open window in memory. A pause of over ``seconds``
    forgets all that was, so a user's requests are dealt out by the runs between such pauses; the
    bound of a task is one run, and of its memory the admitted requests of one window.

    Defined cases: requests without a user share one quota; null characters are 0; rows without a
    time are left out; repeated rows are requests each; of requests at one time the smaller one is
    decided first; an empty table gives no rows. Ids keep all their bits.
    """
    span = seconds * 1_000_000

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, window = None, Admission(quota, span)
        for b in batches:
            out = []
            for user, at, chars, run in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (user, run) != now:
                    now, window = (user, run), Admission(quota, span)
                out.append(window.decide(at, chars))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.bool_())], ["user_id", "us", "chars", "admitted"])

    rows = requests.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.coalesce("chars", F.lit(0)).cast("long").alias("chars")).where("us IS NOT NULL")
    order = Window.partitionBy("user_id").orderBy("us")
    pause = F.coalesce(F.col("us") - F.lag("us").over(order) > span, F.lit(False)).cast("int")
    runs = rows.withColumn("pause", pause).withColumn("run", F.sum("pause").over(order)).drop("pause")
    ordered = runs.repartition("user_id", "run").sortWithinPartitions("user_id", "run", "us", "chars")
    walked = ordered.select("user_id", "us", "chars", "run").mapInArrow(walk, f"user_id {requests.schema['user_id'].dataType.simpleString()}, us long, chars long, admitted boolean")
    return walked.select("user_id", F.timestamp_micros("us").alias("ts"), "chars", "admitted")


def rate_limit(requests: DataFrame, key: str, most: int, minutes: int = 15) -> DataFrame:
    """``requests`` with window_start, nth and limited: over ``most`` a key and aligned window."""
    ts = F.col("ts").cast("timestamp")
    start = F.window(ts, f"{minutes} minutes")["start"]
    nth = F.row_number().over(Window.partitionBy(key, "window_start").orderBy("ts", "event_id"))
    return requests.withColumn("window_start", start).withColumn("nth", nth).withColumn("limited", F.col("nth") > most)
