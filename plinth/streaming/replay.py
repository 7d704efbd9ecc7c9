"""Run a streaming form over stored rows in the order of their arrival."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from plinth.session import shared_folder
from plinth.streaming.feeds import event_stream
from plinth.streaming.jobstate import STORE

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def replay(rows: DataFrame, arrival: Column, start: Callable[[DataFrame, str], StreamingQuery], periods: int = 4, files_per_trigger: int = 1000, wait: int = 3600) -> int:
    """Deliver ``rows`` in ``periods`` by ``arrival`` and stream each as it comes; returns the number of rows.

    ``start(stream, checkpoint)`` starts a query that ends when nothing is left; it is started after each delivery with
    the same checkpoint, as a job that runs now and then would be. A query that has not ended after ``wait`` seconds is
    stopped and raises TimeoutError.
    """
    spark = rows.sparkSession
    source, marks, staged = (shared_folder(spark, name) for name in ("events", "marks", "staged"))
    told = rows.withColumn("_arrival", arrival.cast("double"))
    low, high, count = told.agg(F.min("_arrival"), F.max("_arrival"), F.count(F.lit(1))).first()
    width = max(1e-9, ((high or 0) - (low or 0)) / periods)
    period = F.least(F.lit(periods - 1), F.floor((F.col("_arrival") - F.lit(low or 0.0)) / width)).cast("int")
    told.withColumn("period", period).drop("_arrival").write.partitionBy("period").parquet(staged)
    stored = spark.read.schema(f"{_ddl(rows)}, period int").parquet(staged)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, STORE)
    try:
        for k in range(periods):
            stored.filter(F.col("period") == k).drop("period").write.mode("append").parquet(source)
            query = start(event_stream(spark, source, files_per_trigger, _ddl(rows)), marks)
            if not query.awaitTermination(wait):
                query.stop()
                raise TimeoutError(f"the stream did not end within {wait} seconds")
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return count


def told_to(folder: str, transform: Callable[[DataFrame], DataFrame], mode: str) -> Callable[[DataFrame, str], StreamingQuery]:
    """A query that stores what ``transform`` gives below ``folder`` with its ``batch``; a batch that runs again replaces its own rows."""

    def start(stream: DataFrame, checkpoint: str) -> StreamingQuery:
        def store(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

        return transform(stream).writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    return start


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
