"""Streams: chunk progress, usage windows, rates, positions, stale work.

Event shapes: chunk events (document_id, idx, status, ts) and job events (document_id, job_status, ts)
share one stream with nulls where a field isn't told; both may carry a job_id. What a stream says of a
document or chunk is a function of the set of its events: the event times decide, not the order in
which events arrive or how they are cut into micro-batches. Events over ``delay`` behind the newest
one may be left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docflow.operators.chunks import chunk_text

TERMINAL = ("succeeded", "failed")
#: Of two statuses of a chunk at one time the one further on counts.
STAGES = ("pending", "processing", "failed", "done")
#: How long a document is remembered after its last event.
KEEP_MS = 7 * 24 * 3_600_000
#: Groups of documents, chunks or users whose state a processor holds together, so that its calls, which cost a
#: thousand times a row's share, don't grow with them. Fixed for the life of a checkpoint.
BUCKETS = 4096
PROGRESS = "document_id long, kind string, total long, done long, failed long, pending long, seq long"
#: The chunks of documents that only a snapshot told of: their columns, and the types in which they are held.
QUIET = {"document_id": np.int64, "total": np.int64, "idx": np.int32, "at": np.int64, "stage": np.int8}


def bucket(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("long") for k in keys]), F.lit(BUCKETS)).cast("int").alias("bucket")


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    """A frame whose whole numbers stay whole, with or without rows."""
    fields = [c.split() for c in schema.split(", ")]
    df = pd.DataFrame(rows, columns=[n for n, _ in fields])
    return df.astype({n: {"long": "int64", "int": "int32"}.get(t, "object") for n, t in fields})


class ProgressFold(StatefulProcessor):
    """Progress of a group's documents from the versions (time, status) of their chunks and the ends of their jobs.

    A job covers the events up to its end. After the last end the document is closed: later chunk
    events wait until a newer job shows, by a job event that isn't an end, by a larger job_id, or by
    an end of its own. Versions older than the watermark are cut down to those that can still count.
    Documents of a snapshot are held as columns, without an object each, until an event tells of them.
    """

    def __init__(self, keep_ms: int = KEEP_MS) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value a group: each call on a state is a round trip
        quiet = ", ".join(f"quiet_{c} binary" for c in QUIET)
        self.doc = handle.getValueState("doc", f"body string, timer long, {quiet}, shown long")

    def _load(self) -> tuple[dict[int, tuple[dict, dict]], int, dict[str, np.ndarray], int]:
        """document_id -> what is known of it, and idx -> versions of its chunks; the timer; the quiet
        documents' chunks by document and idx; the watermark at which their rows went out, 0 before."""
        body, timer, *quiet, shown = self.doc.get() or ("{}", 0, *[b""] * len(QUIET), 0)
        docs = {int(d): (doc, {int(k): v for k, v in own.items()}) for d, (doc, own) in json.loads(body).items()}
        return docs, timer, {c: np.frombuffer(x, t) for (c, t), x in zip(QUIET.items(), quiet, strict=True)}, shown

    def _keep(self, docs: dict, timer: int, quiet: dict[str, np.ndarray], shown: int) -> None:
        self.doc.update((json.dumps(docs), timer, *(quiet[c].astype(t, copy=False).tobytes() for c, t in QUIET.items()), shown))

    @staticmethod
    def _unknown() -> tuple[dict, dict]:
        return {"total": None, "unshown": False, "ends": [], "starts": {}, "told": None, "seq": 0, "last": 0}, {}

    def handleInitialState(self, key, initialState, timerValues) -> None:
        rows = initialState if isinstance(initialState, pd.DataFrame) else pd.concat(list(initialState))
        docs, timer, quiet, shown = self._load()
        if "document_id" not in rows.columns:  # the key is one document
            rows = rows.assign(document_id=key[0])
        rows = rows.assign(stage=rows["status"].map({x: n for n, x in enumerate(STAGES)}).fillna(-1))
        every = {c: np.concatenate([quiet[c], rows[c].to_numpy(t)]) for c, t in QUIET.items()}
        # of a chunk's rows the last one with a known status counts, so it comes last
        order = np.lexsort([every["stage"] >= 0, every["idx"], every["document_id"]])
        every = {c: x[order] for c, x in every.items()}
        for d, job in zip(*(rows[c][rows["job_status"].isin(TERMINAL)].tolist() for c in ("document_id", "job_status")), strict=True):
            doc, _ = docs.setdefault(d, self._unknown())
            doc["ends"] = [max([*doc["ends"], [0, job, -1]])]
        quiet = self._heard(docs, list(docs), every, shown)
        self.handle.registerTimer(1)  # comes with the first watermark, for documents that get no event
        self._keep(docs, timer, quiet, shown)

    def _heard(self, docs: dict, ids: list[int], quiet: dict[str, np.ndarray], shown: int) -> dict[str, np.ndarray]:
        """The quiet documents but ``ids``, of which those that are quiet go to ``docs``."""
        mine = np.isin(quiet["document_id"], np.array(ids, np.int64))
        if not mine.any():
            return quiet
        own = {c: x[mine].tolist() for c, x in quiet.items()}
        found = set()
        for d, total, idx, at, stage in zip(*(own[c] for c in QUIET), strict=True):
            doc, versions = docs.setdefault(d, self._unknown())
            doc |= {"total": max(total, doc["total"] or 0), "unshown": True}
            if stage >= 0:
                versions[idx] = [[at, stage]]
            found.add(d)
        for d in found if shown else ():
            self._snapshot(d, *docs[d])  # what went out then
            docs[d][0]["last"] = shown * 1000
        return {c: x[~mine] for c, x in quiet.items()}

    @staticmethod
    def _first_rows(quiet: dict[str, np.ndarray]) -> pd.DataFrame:
        """The row of the snapshot of each quiet document."""
        documents, idx, stages = quiet["document_id"], quiet["idx"], quiet["stage"]
        other = np.diff(documents) != 0
        first, last = np.append(True, other).nonzero()[0], np.append(other | (np.diff(idx) != 0), True)
        total = np.maximum(np.maximum.reduceat(quiet["total"], first), 0)
        done, failed = (np.add.reduceat((last & (stages == STAGES.index(x))).astype(np.int64), first) for x in ("done", "failed"))
        row = {"document_id": documents[first], "kind": "snapshot", "total": total, "done": done, "failed": failed}
        return pd.DataFrame(row | {"pending": np.maximum(total - done - failed, 0), "seq": np.ones(len(first), np.int64)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        docs, timer, quiet, shown = self._load()
        told = pd.concat(list(rows))
        events: dict[int, list[tuple]] = {}
        for d, *e in zip(*(told[c].tolist() for c in ("document_id", "at", "idx", "status", "job_status", "job_id")), strict=True):
            events.setdefault(d, []).append(e)
        out: list[tuple] = []
        floor = timerValues.getCurrentWatermarkInMs() * 1000
        quiet = self._heard(docs, list(events), quiet, shown)
        for d, own in events.items():
            if d not in docs:
                docs[d] = self._unknown()
            out += self._fold(d, own, *docs[d], floor)
        due = min(self._due(docs[d][0]) for d in events)
        if not timer or due < timer:
            timer = due
            self.handle.registerTimer(timer)
        self._keep(docs, timer, quiet, shown)
        if out:
            yield _frame(out, PROGRESS)

    def _fold(self, key: int, events: list[tuple], doc: dict, versions: dict, floor: int) -> list[tuple]:
        """The rows that new events of a document give."""
        out = self._snapshot(key, doc, versions)
        before = max(doc["ends"], default=[-1])
        changed = set()
        for at, idx, status, job_status, job in events:
            doc["last"] = max(doc["last"], at)
            if job_status in TERMINAL:
                doc["ends"].append([at, job_status, job])
            elif job_status or job >= 0:
                doc["starts"][str(job)] = max(at, doc["starts"].get(str(job), 0))
            if idx >= 0 and status in STAGES:
                versions.setdefault(idx, []).append([at, STAGES.index(status)])
                changed.add(idx)
        for end in sorted(x for x in doc["ends"] if x > before):
            out += self._told(key, doc, end[1], versions, end[0])
        limit, kind = self._now(doc)
        out += self._told(key, doc, kind, versions, limit)
        self._compact(doc, versions, changed, floor)
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        docs, timer, quiet, shown = self._load()
        now = timerValues.getCurrentWatermarkInMs()
        out: list[tuple] = []
        first = None
        for d, (doc, versions) in docs.items():
            if doc["unshown"]:  # of the snapshot, and without an event so far
                out += self._snapshot(d, doc, versions)
                doc["last"] = now * 1000
        if len(quiet["total"]) and not shown:
            first, shown = self._first_rows(quiet), now
        left = {d: own for d, own in docs.items() if self._due(own[0]) > now}
        dues = [self._due(doc) for doc, _ in left.values()]
        forgotten = len(quiet["total"]) > 0 and shown + self.keep_ms <= now
        if forgotten:
            quiet = {c: x[:0] for c, x in quiet.items()}
        elif len(quiet["total"]):
            dues.append(shown + self.keep_ms)
        due = min(dues, default=0)
        if not dues:
            self.doc.clear()
        elif out or first is not None or forgotten or due != timer or len(left) < len(docs):
            if due != timer:
                self.handle.registerTimer(due)
            self._keep(left, due, quiet, shown)
        if out:
            yield _frame(out, PROGRESS)
        if first is not None:
            yield first

    def _due(self, doc: dict) -> int:
        return doc["last"] // 1000 + self.keep_ms

    @staticmethod
    def _now(doc: dict) -> tuple[int | None, str]:
        """Up to when events count, None for all, and the kind of row that says so."""
        if not doc["ends"]:
            return None, "progress"
        at, status, ended = max(doc["ends"])
        newer = any(t > at and (int(job) < 0 or ended < 0 or int(job) > ended) for job, t in doc["starts"].items())
        return (None, "progress") if newer else (at, status)

    def _snapshot(self, key, doc: dict, versions: dict) -> list[tuple]:
        """The row of the snapshot, once, and that of its end."""
        if not doc["unshown"]:
            return []
        doc["unshown"] = False
        out = self._told(key, doc, "snapshot", versions, None)
        limit, kind = self._now(doc)
        return out + (self._told(key, doc, kind, versions, limit) if kind in TERMINAL else [])

    @staticmethod
    def _told(key, doc: dict, kind: str, versions: dict, limit: int | None) -> list[tuple]:
        """The row of the events up to ``limit``, or none if it is what was told last."""
        newest = [max((v for v in own if limit is None or v[0] <= limit), default=None) for own in versions.values()]
        states = [STAGES[v[1]] for v in newest if v]
        done, failed = states.count("done"), states.count("failed")
        total = len(states) if doc["total"] is None else doc["total"]
        row = [kind, total, done, failed, max(0, total - done - failed)]
        if row == doc["told"]:
            return []
        doc["told"], doc["seq"] = row, doc["seq"] + 1
        return [(key, *row, doc["seq"])]

    def _compact(self, doc: dict, versions: dict, changed: set[int], floor: int) -> None:
        """Leave out what no event after the watermark ``floor`` can bring back."""
        past = max((x for x in doc["ends"] if x[0] <= floor), default=None)
        doc["ends"] = sorted([x for x in doc["ends"] if x[0] > floor] + ([past] if past else []))
        for idx in changed:
            own = versions[idx]
            old = [max((v for v in own if v[0] <= t), default=None) for t in {floor, min(floor, past[0]) if past else floor}]
            versions[idx] = sorted({tuple(v) for v in [*old, *(v for v in own if v[0] > floor)] if v})

    def close(self) -> None:
        pass


def progress_stream(events: DataFrame, snapshot: DataFrame | None = None, keep_ms: int = KEEP_MS, delay: str = "1 hour") -> DataFrame:
    """Rows that say how far each document is; of a document the row with the largest ``seq`` holds.

    With a snapshot (document_id, total, idx, status, and if wanted job_status and ts), its row comes
    first and once, also for documents without an event (with the first watermark, so the stream needs
    some event), and that of its end if it has one. A row goes out only if it differs from the last.
    A snapshot that takes joins is best written out first: Spark plans it anew with each batch, and from
    the second on fails on a join of rows dealt out by ``repartition``.
    A document is forgotten ``keep_ms`` of event time after its last event. Defined cases: events
    without a document or time are left out, repeated events change nothing, of events at one time
    the status further on counts, unknown statuses are no chunks. Rows of a snapshot without a document
    are left out, those without an idx tell the total only, a null total is 0.
    """
    told = events.where("document_id IS NOT NULL AND ts IS NOT NULL").select(
        "document_id", "ts", F.unix_micros("ts").alias("at"), F.coalesce(F.col("idx").cast("int"), F.lit(-1)).alias("idx"), F.coalesce("status", F.lit("")).alias("status"),
        F.coalesce("job_status", F.lit("")).alias("job_status"), F.coalesce(F.col("job_id") if "job_id" in events.columns else F.lit(-1), F.lit(-1)).cast("long").alias("job_id"), bucket("document_id"),
    )
    initial = None
    if snapshot is not None:
        at = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0)) if "ts" in snapshot.columns else F.lit(0)
        ended = F.coalesce("job_status", F.lit("")) if "job_status" in snapshot.columns else F.lit("")
        initial = snapshot.where("document_id IS NOT NULL").select(
            "document_id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce(F.col("idx").cast("int"), F.lit(-1)).alias("idx"), F.when(F.col("idx").isNotNull(), F.col("status")).alias("status"),
            at.cast("long").alias("at"), ended.alias("job_status"), bucket("document_id"),
        ).groupBy("bucket")
    return told.withWatermark("ts", delay).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=ProgressFold(keep_ms), outputStructType=PROGRESS, outputMode="Update", timeMode="EventTime", initialState=initial
    )


def last_rows(rows: DataFrame) -> DataFrame:
    """The last row of each document, from what a progress stream wrote in any number of batches."""
    fields = [c.split()[0] for c in PROGRESS.split(", ")]
    return rows.where("kind <> 'snapshot'").groupBy("document_id").agg(F.max_by(F.struct(*fields[1:]), "seq").alias("x")).select("document_id", "x.*")


def until_terminal(events: DataFrame) -> DataFrame:
    """Only the rows that close a document: one for each end of a job, in order of ``seq``."""
    return progress_stream(events).where(F.col("kind").isin(*TERMINAL))


STALE = "document_id long, idx int, stale_at long"


class StaleTimer(StatefulProcessor):
    """Emits a requeue row for each processing chunk of a group that hasn't been heard of for some event time.

    The newest event of a chunk decides, so an older one that comes late changes nothing. What is
    known of a chunk that isn't processing goes when no older event can come any more.
    """

    def __init__(self, minutes: int) -> None:
        self.ms = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the newest events of a group's chunks in one value: each call on a state is a round trip
        self.newest = handle.getValueState("newest", "documents binary, idx binary, at binary, stages binary, timer long")

    def _load(self) -> tuple[list[np.ndarray], int]:
        """Documents, chunks, times and stages of the newest events; the timer, which is the group's only one."""
        held = self.newest.get() or (b"",) * 4 + (0,)
        return [np.frombuffer(x, np.int64) for x in held[:4]], held[4]

    def _keep(self, every: list[np.ndarray], timer: int) -> None:
        self.newest.update((*(c.astype(np.int64).tobytes() for c in every), timer))

    def _due(self, every: list[np.ndarray]) -> np.ndarray:
        return every[2] // 1000 + np.where(every[3] == STAGES.index("processing"), self.ms, 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old, timer = self._load()
        told = pd.concat(list(rows))
        if "document_id" not in told.columns:  # the key is one chunk
            told = told.assign(document_id=key[0], idx=key[1])
        every = [np.concatenate([c, told[n].to_numpy(np.int64)]) for c, n in zip(old, ("document_id", "idx", "at", "stage"), strict=True)]
        order = np.lexsort(every[::-1])
        documents, idx, *_ = every = [c[order] for c in every]
        last = np.append((np.diff(documents) != 0) | (np.diff(idx) != 0), True)
        every = [c[last] for c in every]
        due = int(self._due(every).min())
        if due != timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self._keep(every, due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        every, _ = self._load()
        due = self._due(every)
        over = due <= timerValues.getCurrentWatermarkInMs()
        if over.all():
            self.newest.clear()
        else:
            timer = int(due[~over].min())
            self.handle.registerTimer(timer)
            self._keep([c[~over] for c in every], timer)
        stale = over & (every[3] == STAGES.index("processing"))
        if stale.any():
            yield pd.DataFrame({"document_id": every[0][stale], "idx": every[1][stale].astype(np.int32), "stale_at": due[stale]})

    def close(self) -> None:
        pass


def stale_stream(chunks: DataFrame, minutes: int = 10, delay: str = "0 seconds") -> DataFrame:
    """(document_id, idx, stale_at in ms) of chunks (document_id, idx, status, ts) to requeue.

    Timers run on the watermark, so an idle stream needs a later event to fire them. Events without
    a document, idx, known status or time are left out; repeated events change nothing.
    """
    stage = F.array_position(F.array(*[F.lit(x) for x in STAGES]), F.col("status")).cast("int") - 1
    told = chunks.where("document_id IS NOT NULL AND idx IS NOT NULL AND ts IS NOT NULL").withColumn("stage", stage).where("stage >= 0")
    marked = told.select("document_id", F.col("idx").cast("int").alias("idx"), "ts", F.unix_micros("ts").alias("at"), "stage", bucket("document_id", "idx")).withWatermark("ts", delay)
    return marked.groupBy("bucket").transformWithStateInPandas(statefulProcessor=StaleTimer(minutes), outputStructType=STALE, outputMode="Update", timeMode="EventTime")


def chunk_stream(docs: DataFrame, cache: DataFrame, voice: str, model: str, max_chars: int = 2000, delay: str = "1 hour") -> DataFrame:
    """Chunks of incoming documents (document_id, user_id, text, ts) that need synthesis: not in
    the static cache, and each user's content once within the watermark.

    Which of several documents with the same content is kept is left open. A null user has no
    cache; texts without words and null ones have no chunks; repeated cache rows count once.
    """
    from docflow.operators.planning import with_hash

    chunks = chunk_text(docs.withWatermark("ts", delay), max_chars, key="document_id", keep=("user_id", "ts"))
    known = cache.select("user_id", "content_hash").distinct().withColumn("cached", F.lit(True)).hint("merge")
    probed = with_hash(chunks, voice, model).join(known, ["user_id", "content_hash"], "left")
    return probed.where("cached IS NULL").dropDuplicatesWithinWatermark(["user_id", "content_hash"]).drop("cached")


def usage_stream(usage: DataFrame, window: str = "24 hours", slide: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """user_id, window_start, window_end, chars of (user_id, ts, chars)."""
    grouped = usage.withWatermark("ts", delay).groupBy("user_id", F.window("ts", window, slide).alias("w"))
    return grouped.agg(F.sum("chars").alias("chars")).select("user_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "chars")


def rate_stream(requests: DataFrame, most: int, minutes: int = 15, delay: str = "1 hour") -> DataFrame:
    """user_id, window_start, requests, limited: how many came and were over the limit."""
    grouped = requests.withWatermark("ts", delay).groupBy("user_id", F.window("ts", f"{minutes} minutes").alias("w"))
    counted = grouped.agg(F.count(F.lit(1)).alias("requests"))
    return counted.select("user_id", F.col("w.start").alias("window_start"), "requests", F.greatest(F.lit(0).cast("long"), F.col("requests") - most).alias("limited"))


def position_stream(updates: DataFrame) -> DataFrame:
    """user_id, document_id, position_ms, updated_at: last write wins (update or complete mode)."""
    last = F.max_by(F.struct("position_ms", F.col("ts").alias("updated_at")), F.struct("ts", "position_id"))
    return updates.where("position_ms >= 0").groupBy("user_id", "document_id").agg(last.alias("x")).select("user_id", "document_id", "x.position_ms", "x.updated_at")
