"""Current states of jobs from a stream of their events, with state of constant size per job.

The state of a job is its last event, the last progress reached, and a mark. A call to the state store costs far more than the
fold, so jobs share one value of the store with others of their bucket: a batch reads and writes a bucket once, however many
of its jobs have rows. An event that can still turn out to come after a cancellation is kept apart, at most ``delay`` worth
of events, until a batch with rows of its job finds that the watermark has passed it; no timer is spent on it. A finished job
is forgotten ``keep`` after its last event, by the one timer of its bucket, which waits for the first job that is due; its mark
(cancelled where, closed) stays, so that a late event cannot bring it back. What can no longer be counted is not dropped: it
comes out as a row of its own, the side output.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from plinth.operators.jobs import TERMINAL, event_progress

#: A bucket: JSON of each job's ``[cut, closed, last_id, stage, reached_id, reached, last_at, [[id, at, reached], ...]]``, of a closed
#: one ``[cut, true]``; and the time of the bucket's timer.
BUCKET = "jobs string, due long"
#: Values of the store that the jobs of a stream share; fixed by the first run over a checkpoint.
BUCKETS = 1024
NEW = [None, False, -1, None, -1, None, 0, []]
TOLD = "job_id string, status string, stage string, progress int, last_id long, late_id long, late_stage string"
TOLD_NAMES = [f.split()[0] for f in TOLD.split(", ")]
#: The arbitrary-state operators need this state store (``spark.sql.streaming.stateStore.providerClass``).
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class JobStates(StatefulProcessor):
    """Folds events (``job_id, id, stage, reached, at`` in milliseconds) of a bucket's jobs in any order; rows without a
    ``job_id`` are of the job that the key names."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", BUCKET)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        events: dict[str, list] = {}
        for row in rows:
            job_id = row["job_id"] if "job_id" in row else key[0]
            events.setdefault(job_id, []).append((row["id"], row["stage"], row["reached"], row["at"]))
        yield from (Row(**dict(zip(TOLD_NAMES, told, strict=True))) for told in self._met(events, timerValues.getCurrentWatermarkInMs()))

    def _met(self, events: dict[str, list], watermark: int) -> list[tuple]:
        """Folds events (``id, stage, reached, at``) by job into the bucket; what there is to tell."""
        jobs, due = self._read()
        told = []
        for job_id, own in events.items():
            state = jobs.get(job_id, NEW)
            if state[1]:
                jobs[job_id], late = self._after_closing(state, own)
            else:
                jobs[job_id], late, shown = self._folded(state, own, watermark)
                stage = jobs[job_id][3]
                status = stage if stage in TERMINAL else "queued" if stage == "resuming" else "processing"
                told.append((job_id, status, stage, 0 if shown is None else shown, jobs[job_id][2], None, None))
            told += [(job_id, None, None, None, None, i, stage) for i, stage in late]
        self._write(jobs, due, events)
        return told

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        jobs, due = self._read()
        for job_id, state in jobs.items():
            end = self._end(state)
            if end is not None and end <= watermark:
                jobs[job_id] = [state[0], True]
        self._write(jobs, None if due is None or due <= watermark else due, jobs)
        return iter(())

    def _read(self) -> tuple[dict[str, list], int | None]:
        held = self.bucket.get()
        return (json.loads(held[0]), held[1]) if held else ({}, None)

    def _write(self, jobs: dict[str, list], due: int | None, changed: dict) -> None:
        """Stores the bucket; a timer is set where one of the ``changed`` jobs is due before the one that waits."""
        first = min((end for end in (self._end(jobs[job_id]) for job_id in changed) if end is not None), default=None)
        if first is not None and (due is None or first < due):
            due = first
            self.handle.registerTimer(due)
        self.bucket.update((json.dumps(jobs, separators=(",", ":")), due))

    def _end(self, state: list) -> int | None:
        """When a finished job is to be forgotten; none for others."""
        return state[6] + self.keep_ms if not state[1] and state[3] in TERMINAL else None

    @staticmethod
    def _after_closing(state: list, rows: list) -> tuple[list, list]:
        cuts = [i for i in (state[0], *(i for i, stage, _, _ in rows if stage == "canceled")) if i is not None]
        return [min(cuts, default=None), True], [(i, stage) for i, stage, _, _ in rows]

    def _folded(self, state: list, rows: list, watermark: int) -> tuple[list, list, int | None]:
        """The job's state after ``rows``, events that came too late to count, and the progress to show."""
        cut, _, last_id, stage, reached_id, reached, last_at, held = state
        late = []
        reached_id, reached, waiting = self._settled(reached_id, reached, {e[0]: (e[1], e[2]) for e in held}, watermark)
        for i, told, own, at in rows:
            if cut is not None and i > cut:
                continue
            last_at = max(last_at, at)
            if i > last_id:
                last_id, stage = i, told
            if own is not None:
                if at > watermark:
                    waiting[i] = at, own
                elif i > reached_id:
                    reached_id, reached = i, own
            if told == "canceled":
                cut = i
                last_id, stage = cut, "canceled"
                waiting = {k: e for k, e in waiting.items() if k <= cut}
                if reached_id > cut:  # what came after it was settled before it arrived
                    late.append((i, told))
        _, shown = max([(reached_id, reached), *((k, e[1]) for k, e in waiting.items())])
        return [cut, False, last_id, stage, reached_id, reached, last_at, [(k, *e) for k, e in waiting.items()]], late, shown

    @staticmethod
    def _settled(reached_id: int, reached: int | None, waiting: dict, watermark: int) -> tuple:
        """Progress with all waiting events that the watermark has passed, and the others."""
        done = [(i, e[1]) for i, e in waiting.items() if e[0] <= watermark]
        reached_id, reached = max([(reached_id, reached), *done], key=lambda x: x[0])
        return reached_id, reached, {i: e for i, e in waiting.items() if e[0] > watermark}

    def close(self) -> None:
        pass


class JobColumns(JobStates):
    """The same over columns: what a batch brings for a bucket, and what it tells, are not taken apart into rows on the way."""

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        events: dict[str, list] = {}
        for part in rows:
            reached = [None if v is None or v != v else int(v) for v in part["reached"].tolist()]
            for job_id, *event in zip(part["job_id"].tolist(), part["id"].tolist(), part["stage"].tolist(), reached, part["at"].tolist(), strict=True):
                events.setdefault(job_id, []).append(event)
        told = self._met(events, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(told, columns=TOLD_NAMES, dtype=object)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        return super().handleExpiredTimer(key, timerValues, expiredTimerInfo)


def job_state(events: DataFrame, delay: str = "7 days", keep_days: float = 30.0, buckets: int = BUCKETS) -> DataFrame:
    """``TOLD`` rows in update mode: the state of every job that a batch touches, and late events (``late_id`` not null).

    ``events``: ``job_id, id, stage, progress, done, total, created_at``. The state equals that of the batch form as long
    as no cancellation arrives more than ``delay`` after a later event; such a one still ends its job and is also
    reported as late, because progress told after it was counted. Repeated events have no effect. Rows without a job, an
    id or a time are left out; jobs never finish by themselves, so an unfinished one is kept, at a size bounded by its events
    of one ``delay``. A value of the store holds the jobs of one of ``buckets``, which stay the same over a checkpoint.
    """
    reached = event_progress(F.col("stage"), F.col("progress"), F.col("done"), F.col("total"))
    timed = events.filter("job_id IS NOT NULL AND id IS NOT NULL AND created_at IS NOT NULL").withWatermark("created_at", delay)
    # As a plain number the time is no watermark column, so late events reach the processor.
    told = timed.select("job_id", "id", "stage", reached.alias("reached"), F.unix_millis("created_at").alias("at"), F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int").alias("bucket"))
    return told.groupBy("bucket").transformWithStateInPandas(JobColumns(int(keep_days * 86_400_000)), TOLD, "update", "eventTime")


def latest_states(told: DataFrame) -> DataFrame:
    """``job_id, status, stage, progress, last_id``: the last state of each job of stored ``TOLD`` rows with their ``batch``."""
    kept = told.filter("late_id IS NULL").groupBy("job_id").agg(F.max_by(F.struct("status", "stage", "progress", "last_id"), "batch").alias("s"))
    return kept.select("job_id", "s.*")


def late_events(told: DataFrame) -> DataFrame:
    """``job_id, id, stage``: the side output of stored ``TOLD`` rows."""
    return told.filter("late_id IS NOT NULL").select("job_id", F.col("late_id").alias("id"), F.col("late_stage").alias("stage"))
