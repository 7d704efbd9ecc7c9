"""Publication of results by versions: data folders never change, and one pointer, written last, decides what counts.

``folder/data/<unique>/<table>`` holds what one publication wrote and ``folder/versions/version=<n>`` a single file of one
row per table. A version is there once that file is there, so nothing has to be renamed or taken back: the data of a
publication that failed is named by no version and never read. Earlier versions stay readable. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTERS = "table string, path string, keys array<string>, version int"


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """``table, path, keys, version`` of all publications below ``folder``; no rows before the first one."""
    try:
        return spark.read.schema(POINTERS).parquet(f"{folder.rstrip('/')}/versions").select("table", "path", "keys", "version")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], POINTERS)


def tables_of(spark: SparkSession, folder: str) -> list[str]:
    """Names of the tables of the latest version."""
    return sorted(_current(spark, folder.rstrip("/")))


def _current(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, tuple[str, int]]:
    """Paths of the tables of ``version`` (the latest): a handful of rows, one per table."""
    found = versions(spark, folder)
    rows = found.join(F.broadcast(found.agg(F.max("version").alias("version"))), "version") if version is None else found.filter(F.col("version") == version)
    return {r["table"]: (r["path"], r["version"]) for r in rows.collect()}


def publish_tables(tables: dict[str, DataFrame], folder: str, partition_by: dict[str, list[str]] | None = None, replace: bool = False, keep: bool = True) -> int:
    """Write all ``tables`` and point a new version at them; returns its number, 0 where ``tables`` is empty.

    Tables of the version before that are not in ``tables`` are part of the new one, as they are, where ``keep``. A table that exists is
    an error (``FileExistsError``, before anything is written) unless ``replace``. Where a write fails no version is made
    and readers see what they saw before.
    """
    if not tables:
        return 0
    spark = next(iter(tables.values())).sparkSession
    folder = folder.rstrip("/")
    before = _current(spark, folder)
    taken = sorted(set(tables) & set(before))
    if taken and not replace:
        raise FileExistsError(f"output already exists: {', '.join(f'{folder}: {t}' for t in taken)}")
    data = f"{folder}/data/{uuid.uuid4().hex}"
    for name, df in tables.items():
        keys = (partition_by or {}).get(name)
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(*keys) if keys else writer).parquet(f"{data}/{name}")
    number = max([0, *(v for _, v in before.values())]) + 1
    pointed = {t: path for t, (path, _) in before.items() if keep} | {t: f"{data}/{t}" for t in tables}
    rows = [(t, path, list((partition_by or {}).get(t, []))) for t, path in sorted(pointed.items())]
    spark.createDataFrame(rows, "table string, path string, keys array<string>").coalesce(1).write.mode("errorifexists").parquet(f"{folder}/versions/version={number}")
    return number


def published(spark: SparkSession, folder: str, table: str, version: int | None = None) -> DataFrame:
    """A published table, of the latest ``version`` unless one is named."""
    found = _current(spark, folder, version)
    if table not in found:
        raise FileNotFoundError(f"no published table {table} below {folder}" + ("" if version is None else f" in version {version}"))
    return spark.read.parquet(found[table][0])
