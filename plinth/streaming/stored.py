"""Streams that keep what they know in stored tables instead of growing state.

Windows are sums of partial results. A batch writes its part of each window it touches, nothing else; parts of windows
that the watermark has closed are folded into the stored table in a new version, day by day. A row that is late for
its window is one more part, counted as late and folded into the window's stored row like any other. Events are told
apart from their repetitions by the stored feed of the months that a batch holds. No state stays in the query itself.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from plinth.operators.jobs import parse_call_log
from plinth.sources.sinks import publish_tables, published, tables_of

KEYS = ["window_start", "stage", "outcome", "error_category"]
PARTS = "window_start timestamp, stage string, outcome string, error_category string, attempts long, latency_sum decimal(28,3), output_tokens long, late long, newest timestamp, batch long"
#: Tables of folded days before all are folded into one.
RUNS = 8
_SUMS = ["attempts", "latency_sum", "output_tokens", "late"]


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _summed(parts: DataFrame) -> DataFrame:
    """One row per window and group; sums of the parts."""
    sums = [F.sum(c).cast("decimal(28,3)" if c == "latency_sum" else "long").alias(c) for c in _SUMS]
    return parts.groupBy(*KEYS).agg(*sums, F.max("newest").alias("newest"))


class CallWindows:
    """Call metrics per window, stage, outcome and error category, stored below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, size: str = "1 hour", delay: str = "2 hours", merge_every: int = 4) -> None:
        self.spark, self.folder, self.size, self.merge_every = spark, folder.rstrip("/"), size, merge_every
        self.delay = F.expr(f"INTERVAL {delay}")

    def _parts(self) -> DataFrame:
        return _stored(self.spark, f"{self.folder}/parts", PARTS)

    def _tables(self) -> list[int]:
        """Last batches of the stored tables, each of which holds whole windows of some days."""
        return sorted(int(t.partition("-")[2]) for t in tables_of(self.spark, f"{self.folder}/closed"))

    def add(self, lines: DataFrame, batch: int, time: str = "ts") -> None:
        """One batch of log lines (``value`` and an event time). A batch that runs again replaces its own parts."""
        watermark = F.lit(self._parts().filter(F.col("batch") < batch).agg(F.max("newest") - self.delay).first()[0]).cast("timestamp")
        calls = parse_call_log(lines.withColumn(time, F.col(time).cast("timestamp"))).filter(F.col(time).isNotNull())
        window = F.window(time, self.size)
        timed = calls.withColumns({"window_start": window["start"], "window_end": window["end"]})
        part = timed.groupBy(*KEYS).agg(
            F.count(F.lit(1)).alias("attempts"), F.sum(F.col("latency").cast("decimal(18,3)")).cast("decimal(28,3)").alias("latency_sum"), F.sum("output_tokens").alias("output_tokens"),
            F.count_if(F.col("window_end") <= watermark).alias("late"), F.max(time).alias("newest"),
        )
        part.write.mode("overwrite").parquet(f"{self.folder}/parts/batch={batch}")
        if (batch + 1) % self.merge_every == 0:
            self.merge(batch)

    def merge(self, batch: int) -> None:
        """Folds all parts up to ``batch`` into a new table of the days they touch; of a day the newest table counts.

        After RUNS tables all days are folded into one, so a day is read from few places and rewritten seldom.
        """
        tables = self._tables()
        fresh = self._parts().filter((F.col("batch") > max([-1, *tables])) & (F.col("batch") <= batch)).drop("batch")
        if fresh.isEmpty():
            return
        whole = len(tables) >= RUNS
        if tables:
            days = fresh.select(F.to_date("window_start").alias("day")).distinct()
            stored = self._closed(tables)
            fresh = fresh.unionByName((stored if whole else stored.join(days, "day", "left_semi")).drop("day"))
        name = f"upto-{batch}"
        publish_tables({name: _summed(fresh).withColumn("day", F.to_date("window_start"))}, f"{self.folder}/closed", {name: ["day"]}, keep=not whole)

    def _closed(self, tables: list[int]) -> DataFrame:
        """Stored windows with their ``day``."""
        found = None
        for n in tables:
            one = published(self.spark, f"{self.folder}/closed", f"upto-{n}").withColumn("upto", F.lit(n))
            found = one if found is None else found.unionByName(one)
        newest = found.groupBy("day").agg(F.max("upto").alias("upto"))
        return found.join(newest, ["day", "upto"], "left_semi").drop("upto")

    def windows(self) -> DataFrame:
        """``KEYS, attempts, latency_sum, output_tokens, late``: all windows, those still open included."""
        tables = self._tables()
        fresh = self._parts().filter(F.col("batch") > max([-1, *tables])).drop("batch")
        return _summed(fresh.unionByName(self._closed(tables).drop("day")) if tables else fresh).drop("newest").withColumn("latency_sum", F.col("latency_sum").cast("double"))

    def start(self, lines: DataFrame, checkpoint: str, time: str = "ts") -> StreamingQuery:
        """Adds a stream of lines until it ends."""
        return lines.writeStream.foreachBatch(lambda rows, batch: self.add(rows, batch, time)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


EVENT_KEY = ["month", "job_id", "id"]


def add_events(events: DataFrame, folder: str, batch: int) -> None:
    """Appends those of a batch that are not stored yet, once each; a repetition carries the time of its event.

    Only stored months that the batch holds are read. Null ids are told apart like others; a null time is a month of its own.
    """
    spark = events.sparkSession
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    fresh = events.withColumn("month", F.trunc("created_at", "month")).dropDuplicates(EVENT_KEY)
    seen = _stored(spark, f"{folder}/events", f"{kinds}, batch long, month date").filter(F.col("batch") < batch).select(*[F.col(c).alias(f"seen_{c}") for c in EVENT_KEY])
    same: Column = F.lit(True)
    for c in EVENT_KEY:
        same = same & F.col(c).eqNullSafe(F.col(f"seen_{c}"))
    fresh.join(seen, same, "left_anti").write.mode("overwrite").partitionBy("month").parquet(f"{folder}/events/batch={batch}")


def stored_events(spark: SparkSession, folder: str, kinds: str) -> DataFrame:
    """The feed so far: ``kinds`` are the columns of the events."""
    return _stored(spark, f"{folder}/events", f"{kinds}, batch long, month date").drop("month")


def feed_events(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    return events.writeStream.foreachBatch(lambda rows, batch: add_events(rows, folder, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
