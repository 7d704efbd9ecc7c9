"""Session helpers: defaults for local runs and fault-tolerant lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

#: Whether Spark removes the shuffle files of an execution when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "plinth", cpus: int | str = "*") -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    parallel = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parallel))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint directory.

    The directory comes from ``spark.checkpoint.dir``. Only a local master, where driver and
    executors share one disk, may fall back to a temporary folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="plinth-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate files, below ``spark.checkpoint.dir`` where that is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="plinth-shared-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def set_down(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` written as compressed columns and read again; the shuffle files of its making are freed when they are written.

    For intermediates of queries with many steps: a checkpoint holds plain rows, and shuffles that nobody reads again stay on the
    executors' disks until the driver collects garbage. A void column keeps its place as a null.
    """
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, name)
    void = [f.name for f in df.schema.fields if f.dataType == NullType()]
    held = df.drop(*void)
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        held.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    again = spark.read.schema(held.schema).parquet(folder)
    return again.withColumns({c: F.lit(None) for c in void}).select(*df.columns) if void else again


def in_turn(frames: Iterable[DataFrame], name: str = "part") -> DataFrame:
    """The union of ``frames``, each made and set down before the next one, so that their shuffles are never on disk together.
    For frames with few rows out of much work, as the issues of a rule."""
    return reduce(DataFrame.unionByName, [set_down(df, name) for df in frames])


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again. Unlike a checkpoint it has the size of its files, so a small table is broadcast and a large
    one is not; estimates multiply with every join."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of at most ``rows`` rows go to Python in jobs run inside; for rows that are whole documents."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
