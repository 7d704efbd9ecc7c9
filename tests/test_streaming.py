"""Streams against their batch forms, out of order, late and repeated."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from plinth.operators.jobs import job_state
from plinth.session import shared_folder
from plinth.streaming import jobstate, stored
from plinth.streaming.replay import replay, told_to

STAGES = ["content_analysis", "generating_slides", "generating_slides", "ready", "canceled", "ready", "failed"]
KINDS = "job_id string, id bigint, stage string, progress int, done int, total int"
DAY = 86_400


def rows():
    return [(f"j{j}", j * 100 + i, STAGES[(i + j) % 7], 10 * i, i, 8) for j in range(12) for i in range(5)]


def events_of(spark, found, days=1):
    """The i-th event of a job happens ``days`` after the one before."""
    return spark.createDataFrame(found, KINDS).withColumn("created_at", F.timestamp_seconds((F.col("id") % 100) * (days * DAY))).repartition(3)


def told(spark, events, arrival, periods=3, **options):
    folder = shared_folder(spark, "told")
    replay(events, arrival, told_to(folder, lambda s: jobstate.job_state(s, **options), "update"), periods)
    return spark.read.schema(f"{jobstate.TOLD}, batch long").parquet(folder)


def test_state_equals_batch_out_of_order(spark):
    events = events_of(spark, rows() + rows()[:9])
    found = told(spark, events, F.unix_seconds("created_at") + F.pmod(F.xxhash64("id"), F.lit(2 * DAY)), delay="3 days")
    assert found.select("batch").distinct().count() > 1
    assert sorted(map(tuple, jobstate.latest_states(found).collect())) == sorted(map(tuple, job_state(events).collect()))
    assert jobstate.late_events(found).count() == 0


def test_late_cancellation_ends_the_job_and_is_reported(spark):
    found = [("a", 1, "content_analysis", 5, None, None), ("a", 2, "canceled", None, None, None), ("a", 3, "generating_slides", 40, None, None), ("b", 60, "ready", None, None, None)]
    events = events_of(spark, found)
    late = told(spark, events, F.when(F.col("id") == 2, 100.0 * DAY).otherwise(F.unix_seconds("created_at")), 4, delay="1 day")
    states = {r.job_id: (r.status, r.stage, r.last_id) for r in jobstate.latest_states(late).collect()}
    assert states == {"a": ("canceled", "canceled", 2), "b": ("ready", "ready", 60)}
    assert [tuple(r) for r in jobstate.late_events(late).collect()] == [("a", 2, "canceled")]


def test_events_after_expiry_go_aside(spark):
    found = [("a", 1, "ready", None, None, None), ("b", 2, "content_analysis", 7, None, None), ("c", 60, "ready", None, None, None), ("a", 3, "generating_slides", 40, None, None), ("b", 4, "failed", None, None, None)]
    events = events_of(spark, found)
    found = told(spark, events, F.when(F.col("id").isin(3, 4), 200.0 * DAY).otherwise(F.unix_seconds("created_at")), 4, delay="1 day", keep_days=5)
    states = {r.job_id: (r.status, r.stage, r.progress, r.last_id) for r in jobstate.latest_states(found).collect()}
    assert states == {"a": ("ready", "ready", 100, 1), "b": ("failed", "failed", 7, 4), "c": ("ready", "ready", 100, 60)}
    assert [tuple(r) for r in jobstate.late_events(found).collect()] == [("a", 3, "generating_slides")]


def test_feed_stores_repeated_events_once(spark):
    found = rows()
    random.Random(1).shuffle(found)
    events = events_of(spark, found + found[:7]).withColumn("k", F.monotonically_increasing_id())
    folder = shared_folder(spark, "feed")
    replay(events, F.pmod(F.xxhash64("k"), F.lit(1000)), lambda s, marks: stored.feed_events(s.drop("k"), folder, marks), 3)
    assert sorted((r.job_id, r.id) for r in stored.stored_events(spark, folder, KINDS).collect()) == sorted((r[0], r[1]) for r in found)


def test_windows_take_late_lines_and_repeated_batches(spark):
    def line(hour, n):
        return [(f"INFO llm_call job=j stage=s attempt=1 latency=1.5 output_tokens=3 outcome=success error_category=none n={n}", hour * 3600)]

    kinds = "value string, ts long"
    windows = stored.CallWindows(spark, shared_folder(spark, "windows"), merge_every=2)
    for batch, hours in enumerate([[0, 0, 1], [5, 6], [0, 6], [30], [5], [55, 1]]):
        frame = spark.createDataFrame([r for n, h in enumerate(hours) for r in line(h, n)], kinds).withColumn("ts", F.timestamp_seconds("ts"))
        windows.add(frame, batch)
        if batch == 4:
            windows.add(frame, batch)
    got = {r.window_start.hour + 24 * (r.window_start.day - 1): (r.attempts, r.latency_sum, r.output_tokens, r.late) for r in windows.windows().collect()}
    assert got == {0: (3, 4.5, 9, 1), 1: (2, 3.0, 6, 1), 5: (2, 3.0, 6, 1), 6: (2, 3.0, 6, 0), 30: (1, 1.5, 3, 0), 55: (1, 1.5, 3, 0)}


def test_a_stream_that_does_not_end_raises(spark):
    slow = F.udf(lambda x: __import__("time").sleep(20) or x, "long")
    with pytest.raises(TimeoutError):
        replay(spark.range(1), F.lit(0), told_to(shared_folder(spark, "slow"), lambda s: s.select(slow("id").alias("id")), "append"), 1, wait=2)


class Store:
    """A state store that counts the calls made to it."""

    def __init__(self):
        self.calls, self.held = [], None

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.held

    def update(self, value):
        self.calls.append("update")
        self.held = value

    def registerTimer(self, at):
        self.calls.append("timer")

    def getCurrentWatermarkInMs(self):
        return 5


def test_an_unfinished_job_costs_one_read_and_one_write_a_batch():
    store, states = Store(), jobstate.JobStates(1000)
    states.init(store)
    for at in (10, 20):
        found = list(states.handleInputRows(("a",), iter([Row(id=at, stage="generating_slides", reached=at, at=at)]), store))
        assert [(r.status, r.progress, r.last_id) for r in found] == [("processing", at, at)]
    assert store.calls == ["get", "update"] * 2


def test_jobs_of_a_bucket_share_a_read_and_a_write():
    store, states = Store(), jobstate.JobStates(1000)
    states.init(store)
    for at in (10, 20):
        told = [Row(job_id=job, id=at + k, stage="generating_slides", reached=at + k, at=at) for k, job in enumerate("abc")]
        found = list(states.handleInputRows((7,), iter(told), store))
        assert [(r.job_id, r.status, r.progress, r.last_id) for r in found] == [(job, "processing", at + k, at + k) for k, job in enumerate("abc")]
    assert store.calls == ["get", "update"] * 2


def test_few_buckets_tell_what_many_do(spark):
    events = events_of(spark, rows() + rows()[:9])
    arrival = F.unix_seconds("created_at") + F.pmod(F.xxhash64("id"), F.lit(9 * DAY))
    few, many = (told(spark, events, arrival, 4, delay="1 day", keep_days=2, buckets=n).drop("batch") for n in (2, 4096))
    assert sorted(map(repr, few.collect())) == sorted(map(repr, many.collect()))
    assert few.filter("late_id IS NOT NULL").count() > 0
